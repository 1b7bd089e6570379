"""Toxicity: a bidirectional gated recurrent network with attention pooling, trained here in numpy.

Inputs of a word are a vector of its own, if training met it often enough, and the mean of vectors of its
character runs, so that inflected forms share what their stems teach. Every text is read in overlapping
windows; each window's states are pooled by attention into one probability, and the text's score is
the largest of its windows'.
"""

from __future__ import annotations

import math
import pickle
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterloom.llm.common import LOWER, mixed, slices, span_hashes, text_buffer, word_bounds

#: Labelled rows that the network learns from, at most: the first in the order of a hash of doc_id.
TRAIN_ROWS = 4000
#: Bytes of their texts, at most; in the same order, a text that does not fit is left out.
TRAIN_BYTES = 32 << 20
#: From the second epoch on, windows of rows labelled 0 that the network gives less than this probability take no step; all windows are looked at in each epoch.
SETTLED = 0.02
WINDOW, STRIDE = 32, 16  #: words of a window, and between the starts of two
HIDDEN, EMBED = 8, 8
GRAM = 4  #: bytes of a character run; words carry a mark before and after
PIECE = 40  #: bytes of a word; longer ones (text without blanks) are several words
GRAM_ROWS, WORD_ROWS = 1 << 14, 1 << 14  #: rows of the two tables of vectors, reached by hash
WORD_MIN = 6  #: training rows in which a word must occur to have a vector of its own
EPOCHS, RATE, BATCH = 3, 0.01, 256
TRIM = np.zeros(256, bool)
TRIM[list(b".,;:!?\"'()[]{}*#&%$<>|-_")] = True
HELD_OUT = 5  #: rows with crc32(doc_id as text) mod 5 = 0 are never learned from


@dataclass
class Texts:
    """Words of some texts: number of the distinct word, each text's first word, and the distinct words' features."""

    word: np.ndarray
    rows: np.ndarray
    hashes: np.ndarray
    grams: np.ndarray
    gram_rows: np.ndarray


def _pieces(starts: np.ndarray, ends: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words over PIECE bytes as pieces of at most that, each a word of its own; they overlap so that each character run lies within one."""
    step = PIECE - GRAM + 1
    count = 1 + np.maximum(0, -(-(ends - starts - PIECE) // step))
    at = np.concatenate([[0], np.cumsum(count)])
    first = np.repeat(starts, count) + step * (np.arange(at[-1]) - np.repeat(at[:-1], count))
    return first, np.minimum(first + PIECE, np.repeat(ends, count)), at[rows]


def read(column) -> Texts:
    """Cuts texts into lower-cased words without punctuation at their ends, long words into pieces."""
    data, offsets = text_buffer(column)
    data = np.frombuffer(LOWER, np.uint8)[data]
    starts, ends, rows = word_bounds(data, offsets)
    for _ in range(3):  # up to three marks at either end
        starts = starts + (TRIM[data[starts]] & (ends - starts > 1)) if len(starts) else starts
        ends = ends - (TRIM[data[ends - 1]] & (ends - starts > 1)) if len(starts) else ends
    starts, ends, rows = _pieces(starts, ends, rows)
    hashes = span_hashes(data, starts, ends)
    distinct, first, word = np.unique(hashes, return_index=True, return_inverse=True)
    s, n = starts[first], ends[first] - starts[first]
    # Each distinct word between two marks, all in one array; runs of GRAM bytes are numbered by hash.
    sizes = np.maximum(n + 2, GRAM)
    at = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    flat = np.zeros(at[-1] + GRAM, np.uint64)
    inner = np.repeat(at[:-1] + 1 - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
    flat[inner] = data[np.repeat(s - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())]
    flat[at[:-1]] = 1
    flat[at[:-1] + 1 + n] = 2
    code = np.zeros(at[-1], np.uint64)
    for j in range(GRAM):
        code = code << np.uint64(8) | flat[j : j + at[-1]]
    counts = sizes - GRAM + 1
    rows_of = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)
    place = np.repeat(at[:-1] - rows_of[:-1], counts) + np.arange(rows_of[-1])
    grams = (mixed(code[place]) % np.uint64(GRAM_ROWS)).astype(np.int64)
    return Texts(word, rows, distinct, grams, rows_of)


def windows_of(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Overlapping windows that cover every word: text, first word, number of words. A text without words has none."""
    n = np.diff(rows)
    per = np.where(n == 0, 0, 1 + np.maximum(0, -(-(n - WINDOW) // STRIDE)))
    text = np.repeat(np.arange(len(n)), per)
    k = np.arange(per.sum()) - np.repeat(np.concatenate([[0], np.cumsum(per)[:-1]]), per)
    first = rows[:-1][text] + k * STRIDE
    return text, first, np.minimum(WINDOW, rows[1:][text] - first)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return np.float32(0.5) * np.tanh(np.float32(0.5) * x) + np.float32(0.5)


@dataclass
class Network:
    weights: dict[str, np.ndarray]
    known: np.ndarray  # sorted hashes of the words with a vector of their own
    bias: float = 0.0
    moments: dict = field(default_factory=dict, repr=False)

    @classmethod
    def new(cls, known: np.ndarray, rng: np.random.Generator) -> Network:
        inputs = 2 * EMBED
        g = lambda *shape, scale: rng.normal(0, scale, shape).astype(np.float32)
        w = {"word": g(WORD_ROWS, EMBED, scale=0.1), "gram": g(GRAM_ROWS, EMBED, scale=0.3)}
        w["word"][0] = 0  # of words without a vector
        for way in ("f", "b"):
            w |= {f"x{way}": g(inputs, 3 * HIDDEN, scale=inputs**-0.5), f"h{way}": g(HIDDEN, 3 * HIDDEN, scale=HIDDEN**-0.5), f"c{way}": np.zeros(3 * HIDDEN, np.float32)}
        w |= {"a": g(2 * HIDDEN, 2 * HIDDEN, scale=(2 * HIDDEN) ** -0.5), "v": g(2 * HIDDEN, scale=0.5), "o": g(2 * HIDDEN, scale=0.5), "ob": np.array([-2], np.float32)}
        return cls(w, known)

    def slots(self, hashes: np.ndarray) -> np.ndarray:
        """Row of the table of word vectors: 0 for a word that training met too seldom."""
        if not len(self.known):
            return np.zeros(len(hashes), np.int64)
        at = np.minimum(np.searchsorted(self.known, hashes), len(self.known) - 1)
        return np.where(self.known[at] == hashes, 1 + (self.known[at] % np.uint64(WORD_ROWS - 1)).astype(np.int64), 0)

    def inputs(self, t: Texts) -> np.ndarray:
        """The input vector of each distinct word."""
        w = self.weights
        if not len(t.hashes):
            return np.zeros((0, 2 * EMBED), np.float32)
        sums = np.add.reduceat(w["gram"][t.grams], t.gram_rows[:-1], axis=0)
        return np.concatenate([w["word"][self.slots(t.hashes)], sums / np.diff(t.gram_rows)[:, None].astype(np.float32)], axis=1)

    def _run(self, way: str, gates: np.ndarray, live: np.ndarray, keep: list | None) -> np.ndarray:
        """States (time, window, HIDDEN). gates: (time, window, 3 * HIDDEN), the inputs' part; a window that has ended keeps its state."""
        u, h = self.weights[f"h{way}"], np.zeros((gates.shape[1], HIDDEN), np.float32)
        out = np.empty((*gates.shape[:2], HIDDEN), np.float32)
        full = live.all(axis=1)
        order = range(len(gates)) if way == "f" else range(len(gates) - 1, -1, -1)
        for t in order:
            x, y = gates[t], h @ u
            zr = _sigmoid(x[:, : 2 * HIDDEN] + y[:, : 2 * HIDDEN])
            z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
            n = np.tanh(x[:, 2 * HIDDEN :] + r * y[:, 2 * HIDDEN :])
            new = n + z * (h - n)
            if not full[t]:
                new = np.where(live[t][:, None], new, h)
            if keep is not None:
                keep.append((t, h, z, r, n, y[:, 2 * HIDDEN :]))
            out[t] = h = new
        return out

    def forward(self, x: np.ndarray, words: np.ndarray, live: np.ndarray, keep: dict | None = None) -> np.ndarray:
        """Log-odds of each window. x: inputs of the distinct words; words, live: (time, window)."""
        w, states = self.weights, []
        for way in ("f", "b"):
            trace: list | None = [] if keep is not None else None
            states.append(self._run(way, (x @ w[f"x{way}"] + w[f"c{way}"])[words], live, trace))
            if keep is not None:
                keep[way] = trace
        h = np.concatenate(states, axis=2)
        q = np.tanh(h @ w["a"])
        s = np.where(live, q @ w["v"], np.float32(-1e9))
        e = np.exp(s - s.max(axis=0))
        a = e / e.sum(axis=0)
        pooled = (a[:, :, None] * h).sum(axis=0)
        if keep is not None:
            keep |= {"h": h, "q": q, "a": a, "pooled": pooled}
        return pooled @ w["o"] + w["ob"][0]

    def backward(self, x: np.ndarray, words: np.ndarray, live: np.ndarray, keep: dict, d: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray]:
        """Gradients of the weights and of the distinct words' inputs, given those of the log-odds."""
        w, g = self.weights, {}
        h, q, a, pooled = keep["h"], keep["q"], keep["a"], keep["pooled"]
        g["o"], g["ob"] = pooled.T @ d, np.array([d.sum()], np.float32)
        dp = d[:, None] * w["o"]
        dh = a[:, :, None] * dp
        da = (h * dp).sum(axis=2)
        ds = a * (da - (a * da).sum(axis=0))
        g["v"] = np.einsum("tb,tbk->k", ds, q)
        dq = ds[:, :, None] * w["v"] * (1 - q * q)
        g["a"] = np.einsum("tbi,tbj->ij", h, dq)
        dh = dh + dq @ w["a"].T
        dx = np.zeros_like(x)
        for k, way in enumerate(("f", "b")):
            u, dgates = w[f"h{way}"], np.zeros((*words.shape, 3 * HIDDEN), np.float32)
            gu, back = np.zeros_like(u), np.zeros((words.shape[1], HIDDEN), np.float32)
            for t, before, z, r, n, yn in reversed(keep[way]):
                dt = back + dh[t][:, k * HIDDEN : (k + 1) * HIDDEN]
                on = live[t][:, None]
                dn = dt * (1 - z) * (1 - n * n) * on
                dz = dt * (before - n) * z * (1 - z) * on
                dr = dn * yn * r * (1 - r)
                dy = np.concatenate([dz, dr, dn * r], axis=1)
                dgates[t] = np.concatenate([dz, dr, dn], axis=1)
                gu += before.T @ dy
                back = np.where(on, dt * z, dt) + dy @ u.T
            flat = dgates.reshape(-1, 3 * HIDDEN)
            sums = np.zeros((len(x), 3 * HIDDEN), np.float32)
            np.add.at(sums, words.ravel(), flat)
            g[f"x{way}"], g[f"h{way}"], g[f"c{way}"] = x.T @ sums, gu, flat.sum(axis=0)
            dx += sums @ w[f"x{way}"].T
        return g, dx

    def step(self, name: str, grad: np.ndarray, at: np.ndarray | None, rate: float) -> None:
        """One step of Adam; of a table of vectors, only of the rows in use."""
        m, v, n = self.moments.setdefault(name, (np.zeros_like(self.weights[name]), np.zeros_like(self.weights[name]), np.zeros(len(self.weights[name]) if at is not None else 1, np.int64)))
        i = at if at is not None else slice(None)
        n[i if at is not None else 0] += 1
        count = n[i][:, None] if at is not None else n[0]
        m[i] = 0.9 * m[i] + 0.1 * grad
        v[i] = 0.99 * v[i] + 0.01 * grad * grad
        self.weights[name][i] -= (rate * (m[i] / (1 - 0.9**count)) / (np.sqrt(v[i] / (1 - 0.99**count)) + 1e-6)).astype(np.float32)

    def windows(self, t: Texts, x: np.ndarray, first: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.arange(int(size.max(initial=1)))[:, None]
        live = at < size
        return np.where(live, t.word[np.minimum(first + at, max(0, len(t.word) - 1))], 0), live

    def scores(self, t: Texts) -> np.ndarray:
        """Score of each text: of its windows' probabilities the largest; without words, what the bias says."""
        text, first, size = windows_of(t.rows)
        out = np.full(len(t.rows) - 1, -np.inf)
        x = self.inputs(t)
        order = np.argsort(size, kind="stable")  # windows of one length together
        for lo in range(0, len(order), 2048):
            part = order[lo : lo + 2048]
            odds = self.forward(x, *self.windows(t, x, first[part], size[part]))
            np.maximum.at(out, text[part], odds)
        out[np.diff(t.rows) == 0] = self.bias
        return 1 / (1 + np.exp(-out))


def train(texts: list[str], labels: list[int], seed: int = 1) -> Network:
    """Fits the network. A text's label belongs to its most suspicious window, and 0 to all windows of a text labelled 0.

    Of a text labelled 1, each epoch takes the window that scores highest so far; in the first epoch, the
    one with the word that most speaks for label 1 by its counts in the sample.
    """
    rng = np.random.default_rng(seed)
    t = read(pa.array(texts, pa.string()))
    y = np.array(labels, np.float32)
    rows = np.diff(t.rows)
    owner = np.repeat(np.arange(len(rows)), rows)
    pairs = np.unique(t.word * max(1, len(rows)) + owner) if len(t.word) else np.zeros(0, np.int64)
    held, where = pairs // max(1, len(rows)), pairs % max(1, len(rows))
    frequent = np.bincount(held, minlength=len(t.hashes))
    toxic = np.bincount(held, y[where], minlength=len(t.hashes)) if len(held) else np.zeros(len(t.hashes))
    net = Network.new(np.sort(t.hashes[frequent >= WORD_MIN]), rng)
    share = float(np.clip(y.mean() if len(y) else 0.1, 0.01, 0.99))
    net.bias = float(np.log(share / (1 - share)))
    if not len(t.word) or y.min() == y.max():
        net.weights["o"][:] = 0
        net.weights["ob"][:] = net.bias
        return net
    # How character runs and words speak for label 1, for the first choice of windows.
    gram_word = np.repeat(np.arange(len(t.hashes)), np.diff(t.gram_rows))
    for_gram = np.bincount(t.grams, toxic[gram_word], minlength=GRAM_ROWS) + 10 * share
    gram_odds = np.log(for_gram / (np.bincount(t.grams, (frequent - toxic)[gram_word], minlength=GRAM_ROWS) + 10 * (1 - share)))
    speaks = np.maximum.reduceat(gram_odds[t.grams], t.gram_rows[:-1])
    speaks = np.maximum(speaks, np.log((toxic + 5 * share) / (frequent - toxic + 5 * (1 - share))))
    text, first, size = windows_of(t.rows)
    at = np.arange(WINDOW)[:, None]
    best = np.empty(len(first))
    for lo in range(0, len(first), 8192):
        cut = slice(lo, lo + 8192)
        best[cut] = np.where(at < size[cut], speaks[t.word[np.minimum(first[cut] + at, len(t.word) - 1)]], -np.inf).max(axis=0)
    def ranked(by: np.ndarray) -> np.ndarray:
        order = np.lexsort((-by, text))
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order)) - np.searchsorted(text[order], np.arange(len(rows)))[text[order]]
        return rank

    # A long text labelled 0 weighs more than a short one, but not as much as its windows are more.
    share_of = 1 / np.bincount(text, minlength=len(rows))[text] ** 0.5
    weight = np.where(y[text] > 0, 1.0, share_of).astype(np.float32)
    live_zero = y[text] == 0
    for epoch in range(EPOCHS):
        if epoch:
            x = net.inputs(t)
            for lo in range(0, len(first), 2048):
                cut = slice(lo, lo + 2048)
                best[cut] = net.forward(x, *net.windows(t, x, first[cut], size[cut]))
            live_zero = (y[text] == 0) & (best > math.log(SETTLED / (1 - SETTLED)))
        picked = rng.permutation(np.flatnonzero(live_zero | ((y[text] > 0) & (ranked(best) == 0))))
        rate = RATE * 0.6**epoch
        for lo in range(0, len(picked), BATCH):
            part = picked[lo : lo + BATCH]
            words, live = net.windows(t, None, first[part], size[part])
            distinct, inverse = np.unique(words, return_inverse=True)
            sizes = np.diff(t.gram_rows)[distinct]
            cuts = np.concatenate([[0], np.cumsum(sizes)])
            grams = t.grams[np.repeat(t.gram_rows[:-1][distinct] - cuts[:-1], sizes) + np.arange(cuts[-1])]
            sub = Texts(inverse.reshape(words.shape), t.rows, t.hashes[distinct], grams, cuts)
            x, keep = net.inputs(sub), {}
            odds = net.forward(x, sub.word, live, keep)
            d = ((1 / (1 + np.exp(-odds)) - y[text[part]]) * weight[part] / len(part)).astype(np.float32)
            g, dx = net.backward(x, sub.word, live, keep, d)
            for name, grad in g.items():
                net.step(name, grad, None, rate)
            used, inv = np.unique(grams, return_inverse=True)
            sums = np.zeros((len(used), EMBED), np.float32)
            np.add.at(sums, inv, np.repeat(dx[:, EMBED:] / sizes[:, None], sizes, axis=0))
            net.step("gram", sums, used, rate * 2)
            slot = net.slots(sub.hashes)
            used, inv = np.unique(slot, return_inverse=True)
            sums = np.zeros((len(used), EMBED), np.float32)
            np.add.at(sums, inv, dx[:, :EMBED])
            if used[0] == 0:
                used, sums = used[1:], sums[1:]
            net.step("word", sums, used, rate * 2)
    net.moments = {}
    return net


def remainder(key) -> F.Column:
    """crc32 of a key's decimal text, modulo HELD_OUT; of a null key, null."""
    return F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(HELD_OUT))


def fitted(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, size: int = TRAIN_BYTES) -> Network:
    """A network that has learned from at most `rows` labelled documents that are not held out, of `size` bytes of text in all.

    Rows without a label, doc_id or text teach nothing. They are taken in the order of crc32 of doc_id,
    which is the same in every run and at every size. Of texts of one doc_id the least teaches; a text that
    alone is over `size` bytes never does. Without rows of both labels every score is their share. One task
    learns, from rows whose number and bytes are bounded; only the network comes to the driver.
    """
    order = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    wanted = labels.select("doc_id", F.col("toxic").cast("int").alias("y")).where((remainder(F.col("doc_id")) != 0) & F.col("y").isNotNull())
    wanted = wanted.groupBy("doc_id").agg(F.max("y").alias("y")).orderBy(order, "doc_id").limit(rows)
    # The bound on rows is this side's size: it may be sent to all tasks.
    found = docs.select("doc_id", "text").where(F.octet_length("text") <= size).join(F.broadcast(wanted), "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text"))

    def fit(batches):
        texts, given, held = [], [], 0
        for batch in batches:
            for text, y in zip(batch.column("text").to_pylist(), batch.column("y").to_pylist(), strict=True):
                if held + len(text.encode()) <= size:
                    held += len(text.encode())
                    texts.append(text)
                    given.append(y)
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(train(texts, given))], pa.binary())], ["network"])

    made = found.repartition(1).sortWithinPartitions(order, "doc_id").select("text", "y").mapInArrow(fit, "network binary").first()
    return pickle.loads(made.network) if made else train([], [])


def score(docs: DataFrame, network: Network) -> DataFrame:
    """doc_id, score and predicted for every whole text, by all its overlapping windows.

    Null and empty texts score what the labels' share says. Rows whose doc_id repeats or is null are
    scored one by one; other columns are ignored, whatever their names. An empty table gives no rows. A text of any length is read whole, but must fit in a task's memory.
    """
    shared = docs.sparkSession.sparkContext.broadcast(network)

    def run(batches):
        for batch in slices(batches, "text", 1 << 20):
            s = shared.value.scores(read(batch.column("text")))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(s, pa.float64()), pa.array((s >= 0.5).astype(np.int32))], ["doc_id", "score", "predicted"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double, predicted int")


def harmless(docs: DataFrame, network: Network, threshold: float = 0.5) -> DataFrame:
    """The rows of docs whose whole text scores under the threshold, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(network)

    def run(batches):
        for batch in slices(batches, "text", 1 << 20):
            yield batch.filter(pa.array(shared.value.scores(read(batch.column("text"))) < threshold))

    return docs.mapInArrow(run, docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    network = fitted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(docs, network).select("doc_id", F.coalesce(remainder(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"), "score", "predicted")
