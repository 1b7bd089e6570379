"""Conversation repair against plain Python: all edits of short conversations, a plain pass for long ones."""

import hashlib
import itertools
import random
import re
import zlib

import pytest

from rasterloom.llm import conversations

ROWS = "conv_id long, turn long, role string, text string"
BLANK = " \t\n\x0b\x0c\r"


def faults(rows):
    """Each row's first fault, and the counts before repair. rows: (turn, role, text) in order."""
    out, seen = [], set()
    for _, role, text in rows:
        solid = text.rstrip(BLANK)
        out.append("blank" if not solid.strip(BLANK) else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else "")
        seen.add((role, text))
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    pairs = [a[1][:1] + b[1][:1] for a, b in zip(rows, rows[1:])]
    return out, (gaps, *(out.count(f) for f in ("blank", "duplicate", "truncated")), sum(p not in ("su", "ua", "au") for p in pairs))


def fits(roles):
    return re.fullmatch("(s?(ua)+)?", "".join(r[:1] for r in roles)) is not None and all(r for r in roles)


def by_force(rows, inserts=2):
    """Cheapest edits by trying them all, with up to `inserts` inserts in each place."""
    found, _ = faults(rows)
    best = None
    spots = [list(itertools.chain.from_iterable(itertools.product(("user", "assistant"), repeat=n) for n in range(inserts + 1)))] * (len(rows) + 1)
    choices = []
    for (_, role, text), f in zip(rows, found):
        own = [("D", 3, None)]
        if f not in ("blank", "duplicate"):
            own += [("K", f == "truncated", (role, text))] + [("R", 2 + (f == "truncated"), (r, text)) for r in ("user", "assistant")]
        choices.append(own)
    for edits in itertools.product(*choices):
        for made in itertools.product(*spots):
            lines, audit, cost = [(r, "") for r in made[0]], "I" * len(made[0]), 2 * len(made[0])
            for (letter, price, line), more in zip(edits, made[1:]):
                audit, cost = audit + letter + "I" * len(more), cost + price + 2 * len(more)
                lines += ([line] if line else []) + [(r, "") for r in more]
            if fits([r for r, _ in lines]) and (best is None or (cost, audit) < best[:2]):
                best = (cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in lines).encode()).hexdigest())
    return best


def by_plain_pass(rows):
    """The same by a pass that keeps whole strings and lines."""
    found, _ = faults(rows)
    kept = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
    made = {"": "user", "s": "user", "u": "assistant", "a": "user"}

    def closed(paths):
        for _ in range(4):
            for state, (cost, audit, lines) in list(paths.items()):
                to, new = made[state][0], (cost + 2, audit + "I", (lines, (made[state], "")))
                if to not in paths or new[:2] < paths[to][:2]:
                    paths[to] = new
        return paths

    paths = closed({"": (0, "", None)})
    for (_, role, text), f in zip(rows, found):
        new = {}

        def enter(state, item, new=new):
            if state not in new or item[:2] < new[state][:2]:
                new[state] = item

        for state, (cost, audit, lines) in paths.items():
            enter(state, (cost + 3, audit + "D", lines))
            if f in ("blank", "duplicate"):
                continue
            t = f == "truncated"
            if (state, role[:1]) in kept:
                enter(kept[state, role[:1]], (cost + t, audit + "K", (lines, (role, text))))
            enter(made[state][0], (cost + 2 + t, audit + "R", (lines, (made[state], text))))
        paths = closed(new)
    cost, audit, lines = min((paths[s] for s in ("", "a") if s in paths), key=lambda p: p[:2])
    out = []
    while lines is not None:
        lines, line = lines
        out.append(line)
    return cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in reversed(out)).encode()).hexdigest()


def order(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))


def wanted(rows):
    by = {}
    for conv, turn, role, text in rows:
        own = by.setdefault(conv, [])
        if role is not None or text is not None:
            own.append((turn, " " if role is None else role, " " if text is None else text))
    return {c: (*faults(order(r))[1], *by_plain_pass(order(r))) for c, r in by.items()}


def got(df):
    return {r[0]: tuple(r)[1:] for r in df.select(*conversations.NAMES).collect()}


def draw(rng, n):
    roles = ["user", "assistant", "system", "user", "assistant", "tool", ""]
    return [(k, rng.choice(roles), rng.choice([f"t{k}.", f"u{k}", "same.", "same", "", " \n", f"x{k}?"])) for k in range(n)]


def test_plain_pass_against_all_edits():
    rng = random.Random(1)
    for n in (0, 1, 1, 2, 2, 2, *[3] * 12):
        rows = draw(rng, n)
        assert by_plain_pass(rows) == by_force(rows), rows


def test_repair_against_the_plain_pass(spark, monkeypatch):
    rng = random.Random(2)
    rows = [(c, *r) for c in range(120) for r in draw(rng, rng.randrange(0, 14))]
    rows += [(1000, k, rng.choice(["user", "assistant"]), f"long {k}{rng.choice(['.', ''])}") for k in range(1500)]
    rows += [(1001, k, "user", f"only users {k}.") for k in range(700)] + [(1002, k, "system", f"only systems {k}.") for k in range(300)] + [(1003, k, "user", " ") for k in range(300)]
    rows += [(None, 1, "user", "no id."), (None, None, "assistant", "no turn."), (None, None, None, "no role."), (5000, 2, None, None), (5001, None, "user", "a."), (5001, None, "assistant", "b."), (5002, -3, "user", "a."), (5002, 9, "assistant", "b.")]
    rows += rows[40:60]
    rng.shuffle(rows)
    want = wanted(rows)
    df = spark.createDataFrame(rows, ROWS)
    assert got(conversations.repaired(df)) == want
    # Repeated rows found by Spark, ids broadcast or not; another number of layers between freezing.
    assert got(conversations.repaired(df, large=5)) == want
    monkeypatch.setattr(conversations, "BROADCAST_LARGE", 0)
    assert got(conversations.repaired(df, large=5)) == want


@pytest.mark.parametrize("freeze", [1, 3])
def test_freezing_changes_nothing(monkeypatch, freeze):
    monkeypatch.setattr(conversations, "FREEZE", freeze)
    rng = random.Random(freeze)
    for n in (1, 5, 40, 200):
        for roles in (["user"], ["user", "assistant"], ["user", "assistant", "system"], ["system"], ["tool"]):
            rows = [(k, rng.choice(roles), rng.choice([f"t{k}.", f"t{k}", "", "same."])) for k in range(n)]
            c = conversations.Conversation()
            for r in rows:
                c.add(*r, None)
            assert c.result() == (*faults(rows)[1], *by_plain_pass(rows))


def test_odd_tables(spark):
    clashing = spark.createDataFrame([(1, 0, "user", "Hi.", "x", True, 3), (1, 1, "assistant", "Yes.", "y", False, 4)], ROWS + ", l_id string, later boolean, copy int")
    assert got(conversations.repaired(clashing))[1][:7] == (0, 0, 0, 0, 0, 0, "KK")
    assert conversations.repaired(spark.createDataFrame([], ROWS)).count() == 0
    long = spark.createDataFrame([(1, 0, "user", "word " * 300000 + "."), (1, 1, "assistant", "a" * 1500000)], ROWS)
    assert got(conversations.repaired(long))[1][:7] == (0, 0, 0, 1, 0, 1, "KK")


def test_query_against_plain_python(spark, tmp_path):
    rng = random.Random(3)
    rows = [(c, *r) for c in range(200) for r in draw(rng, rng.randrange(1, 9))] + [(None, 3, "user", "a."), (7, None, None, None)]
    spark.createDataFrame(rows, ROWS).write.parquet(str(tmp_path / "conversations.parquet"))
    after = []
    for conv, turn, role, text in rows:
        fault = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
        row = (conv, turn, "user" if fault == 4 else role, text)
        after += [(conv, turn, None, None)] if fault == 0 else [row, row] if fault == 3 else [row]
    assert got(conversations.query(spark, str(tmp_path))) == wanted(after)
