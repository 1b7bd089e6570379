"""The pipeline's stages on planted cases, each on its own input, and the whole against the stages one by one."""

import hashlib
import os
import random
import zlib

import pytest

import corpus_pipeline
from rasterloom.llm import bpe
from tests.llm.helpers import documents, prose
from tests.llm.test_decontaminate import brute_of_shorter as item_brute
from tests.llm.test_minhash import brute as near_brute

DATA = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
STAGE = dict(corpus_pipeline.STAGES)


@pytest.fixture(scope="module")
def clean(spark):
    rng = random.Random(20)
    spell = str.maketrans("0123456789", "abcdefghij")
    return [(k, "\n".join(prose(rng, 30, 10**6) for _ in range(4)).translate(spell)) for k in range(40)]


def test_order():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "near_dedup", "decontamination", "bpe"]


def test_line_stage(spark, clean):
    line = "this notice of more than eight words stands in every document here"
    rows = [(k, t + "\n" + line) for k, t in clean] + [(100, line), (101, ""), (102, None), (103, clean[0][1])]
    got = {r.doc_id: r for r in STAGE["line_dedup"](spark, documents(spark, rows), DATA).collect()}
    assert set(got) == {*range(40), 101, 102}  # of 103, each line stands in document 0 too
    assert got[0].text.endswith(line) and all(got[k].text == t for k, t in clean[1:])
    assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in got.values()) and list(got[0].asDict()) == COLUMNS


def test_near_stage(spark, clean):
    rows = clean + [(200 + k, t) for k, t in clean[:5]] + [(300, clean[7][1] + " more"), (301, ""), (302, None), (None, clean[0][1])]
    out = STAGE["near_dedup"](spark, documents(spark, rows), DATA)
    assert out.columns == COLUMNS
    assert sorted((r.doc_id for r in out.collect()), key=str) == sorted([*range(40), 301, 302, None], key=str)


def test_near_stage_between_80_and_85(spark, clean):
    """Of some 116 shingles two changed words take 10, and three take 15."""

    def shingles(t):
        w = t.lower().split()
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}

    def changed(t, places):
        w = t.split(" ")
        for i in places:
            w[i] = w[i].replace(w[i].split("\n")[0], f"changed{'abc'[i % 3]}", 1)
        return " ".join(w)

    def alike(a, b):
        return len(shingles(a) & shingles(b)) / len(shingles(a) | shingles(b))

    close = [(500 + k, changed(clean[k][1], (20, 60))) for k in range(5)]
    other = [(600 + k, changed(clean[k][1], (20, 50, 80))) for k in range(5, 10)]
    assert all(0.8 < alike(t, clean[k - 500][1]) < 0.85 for k, t in close) and all(alike(t, clean[k - 600][1]) < 0.8 for k, t in other)
    got = {r.doc_id for r in STAGE["near_dedup"](spark, documents(spark, clean + close + other), DATA).collect()}
    assert got == {*range(40), *(k for k, _ in other)}


def test_decontamination_stage(spark, clean):
    item = spark.read.parquet(f"{DATA}/benchmark.parquet").first().text
    rows = clean + [(400, f"{clean[1][1]} {item} end"), (401, item.upper()), (402, None)]
    out = STAGE["decontamination"](spark, documents(spark, rows), DATA)
    assert out.columns == COLUMNS and sorted(r.doc_id for r in out.collect()) == [*range(40), 402]


def test_toxicity_stage(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    out = STAGE["toxicity"](spark, docs, DATA)
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    kept = {r.doc_id for r in out.collect()}
    clean = [k for k, y in labels.items() if y == 0]
    assert out.columns == COLUMNS and sum(k in kept for k in clean) >= 0.97 * len(clean)


def test_toxicity_stage_drops(spark):
    """Of documents that the network does not learn from, toxic ones go and others stay."""
    large = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{large}/documents.parquet").join(spark.read.parquet(f"{large}/labels.parquet").select("doc_id"), "doc_id", "left_semi")
    kept = {r.doc_id for r in STAGE["toxicity"](spark, docs, large).select("doc_id").collect()}
    held = {r.doc_id: r.toxic for r in spark.read.parquet(f"{large}/labels.parquet").collect() if zlib.crc32(str(r.doc_id).encode()) % 5 == 0}
    gone = {y: sum(k not in kept for k in held if held[k] == y) / sum(v == y for v in held.values()) for y in (0, 1)}
    assert gone[1] > 0.85 and gone[0] < 0.02


@pytest.mark.parametrize("name", ["toxicity", "line_dedup", "near_dedup", "decontamination", "bpe"])
def test_stage_on_odd_rows(spark, clean, name):
    """Nulls, empty texts, repeated rows, a very long text, clashing columns, and no rows at all."""
    line = "one line that stands in several documents and has more than eight words"
    rows = [*clean[:6], (6, None), (7, ""), (8, " \n\t"), (None, clean[6][1]), (None, None), (9, clean[7][1]), (9, clean[7][1]), (10, " ".join(t for _, t in clean) * 5), (11, line + "\n" + clean[8][1]), (12, line + "\n" + clean[9][1])]
    schema = "doc_id long, text string, n_lines long, n_removed long, key string, a long, b long, score double, bands string, line long, component_id long, block long"
    docs = spark.createDataFrame([(k, t, 7, 8, "k", 1, 2, 0.5, "x", 3, 4, 5) for k, t in rows], schema)
    out = STAGE[name](spark, docs, DATA)
    got = out.collect()
    if name == "bpe":
        assert len(got) == len(rows) and [r.n_tokens for r in got if r.doc_id in (6, 7)] == [0, 0]
    else:
        assert out.columns == docs.columns and {(r.n_lines, r.n_removed, r.key, r.component_id) for r in got} == {(7, 8, "k", 4)}
        assert {6, 7, 8, 9, 11, 12, None} <= {r.doc_id for r in got}
    assert STAGE[name](spark, docs.limit(0), DATA).count() == 0


def test_whole(spark):
    got = corpus_pipeline.run(spark, DATA)
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    for name in ("toxicity", "line_dedup", "near_dedup", "decontamination"):
        docs = STAGE[name](spark, docs, DATA)
    want = bpe.digests(docs, bpe.vocabulary_text())
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_later_stages_against_plain_python(spark):
    """Near dedup at 0.8, decontamination and encoding of one small corpus, each worked out without the operators."""
    tokenizers, public = pytest.importorskip("tokenizers"), pytest.importorskip("public_tokenizers")
    rng = random.Random(41)
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").limit(12).collect()]
    base = [prose(rng, 80, 10**6) for _ in range(12)]
    texts = [*base]
    for k in range(30):
        w = rng.choice(base).split()
        for _ in range(rng.randrange(4)):
            w[rng.randrange(len(w))] = f"v{k}"
        texts.append(" ".join(w) + (f" {rng.choice(items)[1]}" if k % 4 == 0 else ""))
    rows = list(enumerate(texts)) + [(100, None), (101, "")]
    docs = spark.createDataFrame([(k, t, "en", "s", None if t is None else len(t)) for k, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    near = STAGE["near_dedup"](spark, docs, DATA)
    kept = [(k, dict(rows)[k]) for k, _, _, own in near_brute(rows, 80) if own]
    assert sorted(r.doc_id for r in near.collect()) == sorted(k for k, _ in kept)
    every = [(r.item_id, r.text) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    clean_ = STAGE["decontamination"](spark, near, DATA)
    found = {k for k, *_ in item_brute(kept, every)}
    want = [(k, t) for k, t in kept if k not in found]
    assert found and sorted(r.doc_id for r in clean_.collect()) == sorted(k for k, _ in want)
    library = tokenizers.Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    coded = {k: library.encode(t or "", add_special_tokens=False).ids for k, t in want}
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in STAGE["bpe"](spark, clean_, DATA).collect()}
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    assert got == {k: (len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False))) for k, ids in coded.items()}
