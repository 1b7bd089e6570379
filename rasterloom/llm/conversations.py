"""Conversation repair: the cheapest edits that make a conversation's roles follow the grammar (s?(ua)+)?.

Rows reach their conversation's task sorted by turn and stream through it, whatever their number: a forward
Viterbi pass over the grammar's four states (nothing yet, after s, after u, after a) carries for each state
the smallest (cost, audit string), and beside it the running digest of the repaired conversation, so nothing
is traced back and no text is held. After each row the layer is closed by inserts, at most three in a row, for
a longer run of inserts comes back to a state it left. A path is told by its audit string alone, hence two
paths of equal cost are never prefixes of each other, and comparing strings so far is exact.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterloom.llm.common import BLANKS, slices, written

#: Conversations of more rows have their repeated rows found by Spark and not by a set of digests in the task.
LARGE = 50_000
#: Conversations of so many rows whose ids may be broadcast; more are joined by shuffling.
BROADCAST_LARGE = 100_000
#: Layers after which audit strings are moved to a chain that paths share.
FREEZE = 64
#: A path that costs more than this beyond the cheapest can't win: any state can copy another's future by two inserts more, or by a deleted or changed row more.
SPAN = 6

NOTHING, SYSTEM, USER, ASSISTANT = range(4)
#: Where a kept row leads, by state and initial; where an inserted or changed row leads, by state.
KEPT = {(NOTHING, "s"): SYSTEM, (NOTHING, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
MADE = {NOTHING: (USER, "user"), SYSTEM: (USER, "user"), USER: (ASSISTANT, "assistant"), ASSISTANT: (USER, "user")}

_SOLID = re.compile(r"[^\x20\x09-\x0D]")
_STRIP = BLANKS.decode()


class Path:
    """The cheapest way to a state: cost, rank and chain of what is frozen of its audit string, the rest of it, the digest so far."""

    __slots__ = ("cost", "rank", "tail", "chain", "digest")

    def __init__(self, cost: int, rank: int, tail: str, chain, digest):
        self.cost, self.rank, self.tail, self.chain, self.digest = cost, rank, tail, chain, digest

    def key(self) -> tuple[int, int, str]:
        return self.cost, self.rank, self.tail


class Repair:
    """One conversation's layers; rows are added in order."""

    def __init__(self):
        self.paths: dict[int, Path] = {NOTHING: Path(0, 0, "", None, hashlib.sha256())}
        self.rows = 0
        self.closed()

    def entered(self, candidates: dict[int, tuple[tuple[int, int, str], Path, bytes | None]], state: int, path: Path, cost: int, letter: str, made: bytes | None) -> None:
        key = (path.cost + cost, path.rank, path.tail + letter)
        if state not in candidates or key < candidates[state][0]:
            candidates[state] = (key, path, made)

    def settled(self, candidates: dict[int, tuple[tuple[int, int, str], Path, bytes | None]]) -> dict[int, Path]:
        """Candidates as paths: a digest is copied only where text is added."""
        out = {}
        for state, ((cost, rank, tail), path, made) in candidates.items():
            digest = path.digest
            if made is not None:
                digest = digest.copy()
                digest.update(made)
            out[state] = Path(cost, rank, tail, path.chain, digest)
        return out

    def closed(self) -> None:
        """Inserts after the layer: at most three in a row."""
        for _ in range(3):
            found: dict[int, tuple[tuple[int, int, str], Path, bytes | None]] = {}
            for state, path in self.paths.items():
                to, role = MADE[state]
                if to not in self.paths or (path.cost + 2, path.rank, path.tail + "I") < self.paths[to].key():
                    self.entered(found, to, path, 2, "I", _line(state, role, b""))
            if not found:
                break
            self.paths |= self.settled(found)
        least = min(p.cost for p in self.paths.values())
        self.paths = {s: p for s, p in self.paths.items() if p.cost <= least + SPAN}

    def add(self, role: str, text: str, drop: bool, truncated: bool) -> None:
        candidates: dict[int, tuple[tuple[int, int, str], Path, bytes | None]] = {}
        body = None if drop else text.encode()
        for state, path in self.paths.items():
            self.entered(candidates, state, path, 3, "D", None)
            if drop:
                continue
            to = KEPT.get((state, role[:1]))
            if to is not None:
                self.entered(candidates, to, path, int(truncated), "K", _line(state, role, body))
            to, new = MADE[state]
            self.entered(candidates, to, path, 2 + truncated, "R", _line(state, new, body))
        self.paths = self.settled(candidates)
        self.closed()
        self.rows += 1
        if self.rows % FREEZE == 0:
            self.frozen()

    def frozen(self) -> None:
        """Moves the audit strings, up to the last row's letter, to chains. As each has a letter for each row and ends with one, equal or decided is what two of them are."""
        parts = {s: (p.rank, p.tail.rstrip("I")) for s, p in self.paths.items()}
        order = {key: k for k, key in enumerate(sorted(set(parts.values())))}
        chains: dict[tuple[int, str], tuple] = {}
        for state, p in self.paths.items():
            key = parts[state]
            p.chain = chains.setdefault(key, (p.chain, key[1]))
            p.rank, p.tail = order[key], p.tail[len(key[1]) :]

    def result(self) -> tuple[int, str, str]:
        """Cost, audit string and digest of the cheapest way to an end of the grammar."""
        best = min((p for s, p in self.paths.items() if s in (NOTHING, ASSISTANT)), key=Path.key)
        pieces, chain = [best.tail], best.chain
        while chain is not None:
            chain, piece = chain
            pieces.append(piece)
        return best.cost, "".join(reversed(pieces)), best.digest.hexdigest()


def _line(state: int, role: str, body: bytes) -> bytes:
    """A line of the repaired conversation; only the first has no line feed before it."""
    return (b"" if state == NOTHING else b"\n") + role.encode() + b":" + body


class Conversation:
    """Counts and repair of one conversation, row by row."""

    def __init__(self):
        self.repair, self.seen = Repair(), set()
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.first = self.last = self.before = None

    def add(self, turn: int | None, role: str, text: str, later: bool | None) -> None:
        """later: whether an earlier turn has the same role and text; None where that is found here."""
        if turn is not None:
            self.first = turn if self.first is None else self.first
            self.turns += turn != self.last
            self.last = turn
        initials = None if self.before is None else self.before[0][:1] + role[:1]
        self.illegal += initials is not None and initials not in ("su", "ua", "au")
        blank = not _SOLID.search(text)
        duplicate = truncated = False
        if not blank:
            if later is None:
                digest = hashlib.md5(role.encode() + b"\0" + text.encode()).digest()
                duplicate = digest in self.seen
                self.seen.add(digest)
            else:
                # Equal rows of one turn stand next to each other.
                duplicate = later or self.before == (role, text)
            truncated = not duplicate and text.rstrip(_STRIP)[-1] not in ".!?"
        self.before = (role, text)
        self.blank += blank
        self.duplicate += duplicate
        self.truncated += truncated
        self.repair.add(role, text, blank or duplicate, truncated)

    def result(self) -> tuple:
        gaps = 0 if self.first is None else self.last - self.first + 1 - self.turns
        return (gaps, self.blank, self.duplicate, self.truncated, self.illegal, *self.repair.result())


NAMES = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def _streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by conversation and turn; a row a conversation comes out. Conversations never cross tasks."""
    kinds = [None, *[pa.int64()] * 6, pa.string(), pa.string()]
    own, current, out = None, None, []

    def packed() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(v, k or conv) for v, k in zip(zip(*out, strict=True), kinds, strict=True)], NAMES)

    conv = None
    for batch in slices(batches, "text"):
        conv = batch.column("conv_id").type
        for key, turn, role, text, later in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text", "later")), strict=True):
            if current is None or key != own:
                if current is not None:
                    out.append((own, *current.result()))
                    if len(out) >= 1000:
                        yield packed()
                        out = []
                own, current = key, Conversation()
            if role is not None:
                current.add(turn, role, text, later)
    if current is not None:
        out.append((own, *current.result()))
        yield packed()


def repaired(rows: DataFrame, large: int = LARGE) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256, a row for each conv_id of rows.

    rows: conv_id, turn (whole numbers), role, text. A row whose role and text are both null stands for a
    conversation only, and is no row of it. Otherwise a null role or text counts as one space; a null conv_id is a
    conversation of its own. Rows are taken by turn, null turns first, then by role and text. A role's initial is
    its first character; a role without one, or with another initial than s, u, a, can't be kept. Empty and blank
    texts are blank. Equal rows are duplicates of the first. A conversation of any length streams through one task
    (its digest is of one string), which holds a letter a row, and no text but the last row's. Other columns are
    ignored, whatever their names. An empty table gives no rows.
    """
    space = F.lit(" ")
    named = F.col("role").isNotNull() | F.col("text").isNotNull()
    own = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), F.when(named, F.coalesce("role", space)).alias("role"), F.when(named, F.coalesce("text", space)).alias("text"))
    own = own.withColumn("later", F.lit(None).cast("boolean"))
    long = written(rows.groupBy("conv_id").count().where(F.col("count") > large).select(F.col("conv_id").alias("l_id")))
    n = long.count()
    if n:
        ids = F.broadcast(long) if n <= BROADCAST_LARGE else long
        same = F.col("conv_id").eqNullSafe(F.col("l_id"))
        own = own.join(ids, same, "left_anti").unionByName(_with_later(own.join(ids, same, "left_semi")))
    sorted_rows = own.repartition("conv_id").sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "role", "text")
    kind = rows.schema["conv_id"].dataType.simpleString()
    return sorted_rows.mapInArrow(_streamed, f"conv_id {kind}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string")


def _with_later(rows: DataFrame) -> DataFrame:
    """rows with later: whether an earlier turn of the conversation has the same role and text. Equal rows are summed up before they are shuffled."""
    key = F.md5(F.concat_ws("\0", F.isnull("conv_id").cast("string"), F.coalesce(F.col("conv_id").cast("string"), F.lit("")), "role", "text"))
    keyed = rows.withColumn("key", F.when(F.col("role").isNotNull(), key).otherwise(F.lit("")))
    # False sorts before true, so a null turn is the earliest.
    place = F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn").alias("turn"))
    firsts = keyed.groupBy("key").agg(F.min(place).alias("first"))
    return keyed.join(firsts, "key").withColumn("later", place > F.col("first")).drop("key", "first")


def damaged(rows: DataFrame) -> DataFrame:
    """Rows as a known fault leaves them, by the digest of conversation and turn: dropped (role and text null), emptied, without sentence ends, twice, or as a user's."""
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.crc32(F.concat(part("conv_id"), F.lit(":"), part("turn"))) % 20
    own = rows.select("conv_id", "turn", part("role").alias("role"), part("text").alias("text"), fault.alias("fault"), F.explode(F.when(fault == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"))
    text = F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("fault") == 4, "user").otherwise(F.col("role"))
    there: Column = F.col("fault") != 0
    return own.select("conv_id", "turn", F.when(there, role).alias("role"), F.when(there, text).alias("text"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repaired(damaged(spark.read.parquet(f"{sf_dir}/conversations.parquet")))


#: The digest by key, bit by bit, and the pass over layers as a recursion over each conversation's rows.
SQL = r"""
WITH RECURSIVE
k AS (SELECT DISTINCT coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key FROM conversations),
crc AS (SELECT key, (xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, [ascii(c)::BIGINT FOR c IN string_split(key, '')]),
  lambda r, b: list_reduce(list_prepend(xor(r, b), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda s, z: xor(s >> 1, 3988292384 * (s & 1)))))) % 20 AS fault FROM k),
damaged AS (SELECT conv_id, turn, CASE WHEN fault = 4 THEN 'user' ELSE coalesce(role, ' ') END AS role,
    CASE fault WHEN 1 THEN '' WHEN 2 THEN translate(coalesce(text, ' '), '.!?', '') ELSE coalesce(text, ' ') END AS text, fault
  FROM conversations JOIN crc ON key = coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')),
rows AS (SELECT conv_id, turn, role, text FROM damaged WHERE fault <> 0 UNION ALL SELECT conv_id, turn, role, text FROM damaged WHERE fault = 3),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS n FROM rows),
faults AS (SELECT *, rtrim(text, E' \t\n\x0b\f\r') AS solid, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY n) > 1 AS again, lag(role[1]) OVER (PARTITION BY conv_id ORDER BY n) || role[1] AS pair FROM placed),
judged AS (SELECT *, ltrim(solid, E' \t\n\x0b\f\r') = '' AS blank FROM faults),
seen AS (SELECT conv_id, turn, n, role, text, pair, blank, again AND NOT blank AS duplicate, NOT again AND NOT blank AND right(solid, 1) NOT IN ('.', '!', '?') AS truncated FROM judged),
counts AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (duplicate) AS duplicate, count(*) FILTER (truncated) AS truncated,
    count(*) FILTER (n > 1 AND pair NOT IN ('su', 'ua', 'au')) AS illegal FROM seen GROUP BY conv_id),
start AS (SELECT DISTINCT conv_id FROM conversations),
-- A state's path: cost, audit string, lines. N: nothing yet, S, U, A: after that role. Inserts close a layer: at most two lead anywhere.
walk AS (
  SELECT conv_id, 0::BIGINT AS n, {'c': 0, 'a': '', 'l': ''} AS pn, NULL::STRUCT(c INTEGER, a VARCHAR, l VARCHAR) AS ps, {'c': 2, 'a': 'I', 'l': 'user:'} AS pu, {'c': 4, 'a': 'II', 'l': E'user:\nassistant:'} AS pa FROM start
  UNION ALL
  SELECT conv_id, n, pn, ps, list_min(list_filter([u, CASE WHEN pn IS NOT NULL THEN {'c': pn.c + 2, 'a': pn.a || 'I', 'l': pn.l || 'user:'} END, CASE WHEN ps IS NOT NULL THEN {'c': ps.c + 2, 'a': ps.a || 'I', 'l': ps.l || E'\nuser:'} END,
      CASE WHEN a IS NOT NULL THEN {'c': a.c + 2, 'a': a.a || 'I', 'l': a.l || E'\nuser:'} END], lambda x: x IS NOT NULL)) AS pu,
    list_min(list_filter([a, CASE WHEN u IS NOT NULL THEN {'c': u.c + 2, 'a': u.a || 'I', 'l': u.l || E'\nassistant:'} END, CASE WHEN pn IS NOT NULL THEN {'c': pn.c + 4, 'a': pn.a || 'II', 'l': pn.l || E'user:\nassistant:'} END,
      CASE WHEN ps IS NOT NULL THEN {'c': ps.c + 4, 'a': ps.a || 'II', 'l': ps.l || E'\nuser:\nassistant:'} END], lambda x: x IS NOT NULL)) AS pa
  FROM (SELECT conv_id, n, {'c': pn.c + 3, 'a': pn.a || 'D', 'l': pn.l} AS pn,
      list_min(list_filter([CASE WHEN ps IS NOT NULL THEN {'c': ps.c + 3, 'a': ps.a || 'D', 'l': ps.l} END, CASE WHEN free AND i = 's' THEN {'c': pn.c + t, 'a': pn.a || 'K', 'l': pn.l || line} END], lambda x: x IS NOT NULL)) AS ps,
      list_min(list_filter([{'c': pu.c + 3, 'a': pu.a || 'D', 'l': pu.l}, CASE WHEN free AND i = 'u' THEN {'c': pn.c + t, 'a': pn.a || 'K', 'l': pn.l || line} END, CASE WHEN free AND i = 'u' AND ps IS NOT NULL THEN {'c': ps.c + t, 'a': ps.a || 'K', 'l': ps.l || chr(10) || line} END,
        CASE WHEN free AND i = 'u' THEN {'c': pa.c + t, 'a': pa.a || 'K', 'l': pa.l || chr(10) || line} END, CASE WHEN free THEN {'c': pn.c + t + 2, 'a': pn.a || 'R', 'l': pn.l || 'user:' || text} END,
        CASE WHEN free AND ps IS NOT NULL THEN {'c': ps.c + t + 2, 'a': ps.a || 'R', 'l': ps.l || E'\nuser:' || text} END, CASE WHEN free THEN {'c': pa.c + t + 2, 'a': pa.a || 'R', 'l': pa.l || E'\nuser:' || text} END], lambda x: x IS NOT NULL)) AS u,
      list_min(list_filter([{'c': pa.c + 3, 'a': pa.a || 'D', 'l': pa.l}, CASE WHEN free AND i = 'a' THEN {'c': pu.c + t, 'a': pu.a || 'K', 'l': pu.l || chr(10) || line} END,
        CASE WHEN free THEN {'c': pu.c + t + 2, 'a': pu.a || 'R', 'l': pu.l || E'\nassistant:' || text} END], lambda x: x IS NOT NULL)) AS a
    FROM (SELECT w.*, s.n AS m, NOT s.blank AND NOT s.duplicate AS free, CAST(s.truncated AS INTEGER) AS t, s.role[1] AS i, s.role || ':' || s.text AS line, s.text FROM walk w JOIN seen s ON w.conv_id IS NOT DISTINCT FROM s.conv_id AND s.n = w.n + 1) AS x(conv_id, before, pn, ps, pu, pa, n, free, t, i, line, text))),
done AS (SELECT conv_id, CASE WHEN (pa.c, pa.a) < (pn.c, pn.a) THEN pa ELSE pn END AS p FROM walk QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY n DESC) = 1)
SELECT d.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, CAST(p.c AS BIGINT) AS cost, p.a AS audit, sha256(p.l) AS repaired_sha256
FROM done d LEFT JOIN counts c ON d.conv_id IS NOT DISTINCT FROM c.conv_id
"""
