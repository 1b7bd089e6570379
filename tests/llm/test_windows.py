"""Substring and suffix-array dedup against plain Python, in both lanes."""

import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest

from rasterloom.llm import substring_dedup, suffix_dedup, windows
from tests.llm.helpers import clashing, documents, varied, words


def brute_words(rows, size):
    own = [(k, words(t)) for k, t in rows]
    count = Counter(tuple(w[i : i + size]) for _, w in own for i in range(len(w) - size + 1))
    out = []
    for k, w in own:
        gone = set()
        for i in range(len(w) - size + 1):
            if count[tuple(w[i : i + size])] > 1:
                gone.update(range(i, i + size))
        out.append((k, len(w), len(gone), hashlib.sha256(" ".join(x for i, x in enumerate(w) if i not in gone).encode()).hexdigest()))
    return sorted(out, key=str)


def brute_bytes(rows, size):
    own = [(k, (t or "").encode()) for k, t in rows]
    first = {}
    for k, b in own:
        for i in range(len(b) - size + 1):
            s = b[i : i + size]
            if k is not None and k < first.get(s, k + 1):
                first[s] = k
    out = []
    for k, b in own:
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - size + 1):
            if first.get(b[i : i + size], 1 << 62) < (1 << 62 if k is None else k):
                gone[i : i + size] = True
        spans = int(np.diff(np.concatenate([[0], gone.astype(int)])).clip(0).sum())
        out.append((k, len(b), int(gone.sum()), spans, hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[~gone])).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("hot", [2000, 2])
def test_words(spark, hot, monkeypatch):
    monkeypatch.setattr(windows, "HOT", hot)
    monkeypatch.setattr(windows, "BLOCK_BYTES", 20_000)
    monkeypatch.setattr(windows, "BUCKET_BYTES", 20_000)
    rows = [*varied(random.Random(1)), (3, varied(random.Random(1))[3][1]), (None, "x y " * 30)]
    got = substring_dedup.dedup(documents(spark, rows)).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()
    assert sorted(map(tuple, got), key=str) == brute_words(rows, 35)


@pytest.mark.parametrize("hot", [2000, 2])
def test_bytes(spark, hot, monkeypatch):
    monkeypatch.setattr(windows, "HOT", hot)
    monkeypatch.setattr(windows, "BLOCK_BYTES", 20_000)
    monkeypatch.setattr(windows, "BUCKET_BYTES", 20_000)
    rows = [*varied(random.Random(2)), (None, varied(random.Random(2))[4][1])]
    got = suffix_dedup.dedup(documents(spark, rows)).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    assert sorted(map(tuple, got), key=str) == brute_bytes(rows, 50)


class Steps:
    """Stands for a DataFrame and keeps the functions of its steps."""

    def __init__(self):
        self.kept = []

    def groupBy(self, *_):  # noqa: N802
        return self

    def cogroup(self, _):
        return self

    def applyInArrow(self, f, _):  # noqa: N802
        self.kept.append(f)
        return self


def test_common_line_is_one_string_a_block(monkeypatch):
    """Places don't make a minimiser hot, only different strings do; and what blocks send to buckets, a row for each of both, stays few."""
    steps = Steps()
    monkeypatch.setattr(windows, "in_blocks", lambda *_: (steps, 2, 20_000))
    monkeypatch.setattr(windows, "dealt", lambda df, *_: df)
    monkeypatch.setattr(windows, "HOT", 20)
    windows.repeated(None, words=False, size=50, gram=16, by_document=True, compare=suffix_dedup._smallest(50), finish=lambda block, firsts, owners: (block.ids, firsts, owners), result="")
    send, tell, pack, meet, settle = steps.kept
    line = "".join(random.Random(5).choice("abcdefgh ") for _ in range(300))
    blocks = [pa.table({"doc_id": [30 * b + k for k in range(30)], "text": [line] * 30, "block": [b] * 30}) for b in (0, 1)]
    sent = pa.concat_tables([send(b) for b in blocks])
    kinds = pa.concat_tables([tell(sent.filter(pc.equal(sent.column("bucket"), k))) for k in set(sent.column("bucket").to_pylist())])
    packed = pa.concat_tables([pack(b, kinds.filter(pc.equal(kinds.column("block"), k))) for k, b in enumerate(blocks)])
    assert sum(len(windows._restored(x)) for x in packed.column("strings").to_pylist()) < 2 * 10 * len(line)
    answers = pa.concat_tables([meet(packed.filter(pc.equal(packed.column("bucket"), k))) for k in set(packed.column("bucket").to_pylist())])
    for k, block in enumerate(blocks):
        ids, firsts, owners = settle(block, answers.filter(pc.equal(answers.column("block"), k)))
        assert sorted(firsts.tolist()) == [300 * d + i for d in range(30) for i in range(251)] and not owners.any()
    assert (10e9 / windows.BLOCK_BYTES) * (10e9 / windows.BUCKET_BYTES) < 2e6


def test_other_columns_and_empty_tables(spark):
    rows = [(1, "a b " * 40), (2, "c")]
    for module, count in ((substring_dedup, "n_words"), (suffix_dedup, "n_bytes")):
        plain = module.dedup(documents(spark, rows)).select("doc_id", count, "n_removed").collect()
        assert sorted(module.dedup(clashing(spark, rows)).select("doc_id", count, "n_removed").collect()) == sorted(plain)
        assert module.dedup(documents(spark, [])).count() == 0
        assert module.dedup(documents(spark, [(1, None)])).first().n_removed == 0


def test_refinement():
    rng = random.Random(3)
    strings = ["".join(rng.choice("ab") for _ in range(rng.randrange(5, 60))).encode() for _ in range(50)]
    data = np.frombuffer(b"".join(strings), np.uint8)
    lengths = np.array([*map(len, strings)])
    limits = np.repeat(np.cumsum(lengths), lengths)
    for size in (5, 8, 13, 20):
        bucket = suffix_dedup.refined(data, limits, size)
        text = data.tobytes()
        names = {}
        for i in range(len(text)):
            if limits[i] - i < size:
                assert bucket[i] == -1
            else:
                assert names.setdefault(text[i : i + size], bucket[i]) == bucket[i]
        assert len(set(names.values())) == len(names)


def test_counter_by_text():
    text = b"a b c"
    lo, hi = np.array([0, 2, 0]), np.array([1, 3, 1])
    assert substring_dedup._by_text(text, lo, hi, np.array([1, 2, 3])).tolist() == [4, 2, 4]
