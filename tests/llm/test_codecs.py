"""URL filter, BPE and media columns: brute force, the reference library, exact round trips."""

import hashlib
import math
import random
import struct
import zlib

import numpy as np
import pytest

from rasterloom.llm import bpe, media, url_filter
from tests.llm.helpers import clashing, documents, varied

URLS = [None, "", "no scheme", "http://", "HTTP://WWW.Example.NET/en/x?q=/de/", "http://example.net/en", "http://a.b.net", "http://a.b.net/", "http://net/x", "http://xnet/x", "http://example.com/de/1#f", "http://Example.com/DE/", "http://x.org/fr/", "http://x.org/fr?x", "http://x.org/france/", "a://b://c.net/", "http://x.net:80/", "http://a..net//en//", "http://.net/", "http://x.org\n/fr/"]


def verdict(url):
    if url is None or "://" not in url:
        return "", "", None, "allow"
    rest = url.split("://", 1)[1]
    end = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:end])
    tail = rest[end:]
    path = tail[: min((tail.find(c) for c in "?#" if c in tail), default=len(tail))]
    fits = [(h, p, v) for v, h, p in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    if not fits:
        return host, path, None, "allow"
    h, p, v = max(fits, key=lambda r: (len(r[0]), len(r[1])))
    return host, path, h + p, v


def test_urls(spark):
    pages = spark.createDataFrame([(k if k % 3 else None, u, "h", "p", "r") for k, u in enumerate(URLS * 2)], "page_id long, url string, host string, path string, rule string")
    got = url_filter.judge(pages, url_filter.rules_table(spark)).collect()
    want = [(k if k % 3 else None, *verdict(u)) for k, u in enumerate(URLS * 2)]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert url_filter.judge(pages.limit(0), url_filter.rules_table(spark)).count() == 0


def test_rules_within_a_directory_and_large_tables(spark, monkeypatch):
    rules = spark.createDataFrame([("b.c", "/x/ab", "block"), ("b.c", "/x/", "allow"), ("b.c", "/x/ab", "allow"), ("", "", "block")], "host string, path string, verdict string")
    pages = spark.createDataFrame([(1, "http://a.b.c/x/abc"), (2, "http://a.b.c/x/a"), (3, "http://q/"), (4, None)], "page_id long, url string")
    for limit in (100_000, 1):
        monkeypatch.setattr(url_filter, "BROADCAST_RULES", limit)
        got = {r.page_id: (r.rule, r.verdict) for r in url_filter.judge(pages, rules).collect()}
        assert got == {1: ("b.c/x/ab", "allow"), 2: ("b.c/x/", "allow"), 3: (None, "allow"), 4: ("", "block")}


TEXTS = [t for _, t in varied(random.Random(5))] + ["<|endoftext|>", "a<|endoftext|> b", "don't I'll we've 'S", "x'll'd  's\n's", "\x1c \x85 \u3000 \u2003x", "日本語 12½ é́", "aaaaaaa " * 9, "\r\n\t  end  ", "a" * 3000, "'", " '", "\x00"]


def test_bpe_against_the_library(spark):
    tokenizers = pytest.importorskip("tokenizers")
    public = pytest.importorskip("public_tokenizers")
    t = tokenizers.Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    vocabulary = bpe.vocabulary_text()
    rows = list(enumerate(TEXTS)) + [(None, "null key"), (0, TEXTS[0])]
    for make in (documents, clashing):
        encoded = bpe.encode(make(spark, rows), vocabulary)
        got = sorted(((r.doc_id, list(r.ids)) for r in encoded.collect()), key=str)
        assert got == sorted(((k, t.encode(x or "", add_special_tokens=False).ids) for k, x in rows), key=str)
        back = sorted(((r.doc_id, r.text) for r in bpe.decode(encoded, vocabulary).collect()), key=str)
        assert back == sorted(((k, x or "") for k, x in rows), key=str)
    digests = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.digests(documents(spark, rows), vocabulary).collect()}
    for k, x in rows:
        ids = t.encode(x or "", add_special_tokens=False).ids
        assert digests[k] == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((x or "").encode()).hexdigest())
    assert bpe.encode(documents(spark, []), vocabulary).count() == 0


def test_bpe_forgets_pieces(monkeypatch):
    monkeypatch.setattr(bpe, "PIECES_HELD", 5)
    v = bpe.Vocabulary(bpe.vocabulary_text())
    coder, whole = bpe.Coder(v), bpe.Coder(v)
    texts = [t or "" for t in TEXTS]
    assert [coder.encode([t])[0] for t in texts] == whole.encode(texts)
    assert [bpe.Coder(v).encode_alone(t) for t in texts[:6]] == whole.encode(texts[:6])


def test_media_round_trip(spark):
    rows = list(enumerate(TEXTS)) + [(None, "null key"), (1, TEXTS[1])]
    for make in (documents, clashing):
        got = media.features(media.pngs(make(spark, rows))).collect()
        assert len(got) == len(rows)
        by = {}
        for r in got:
            data = (dict(rows)[r.doc_id] or "").encode()
            payload = data + bytes(max(64, -(-len(data) // 64) * 64) - len(data))
            assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
            assert by.setdefault(data, (r.media_sha256, r.feature)) == (r.media_sha256, r.feature)
    assert media.pngs(documents(spark, [])).count() == 0


def test_every_row_filter():
    rng = np.random.default_rng(6)
    pixels = rng.integers(0, 256, (40, 64), dtype=np.uint8)
    kinds = rng.integers(0, 5, 40)
    raw = np.zeros((40, 65), np.uint8)
    for y in range(40):
        for x in range(64):
            a = int(pixels[y, x - 1]) if x else 0
            b = int(pixels[y - 1, x]) if y else 0
            c = int(pixels[y - 1, x - 1]) if x and y else 0
            p = a + b - c
            paeth = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
            raw[y, x + 1] = (int(pixels[y, x]) - [0, a, b, (a + b) // 2, paeth][kinds[y]]) % 256
        raw[y, 0] = kinds[y]
    head = struct.pack(">IIBBBBB", 64, 40, 8, 0, 0, 0, 0)
    body = zlib.compress(raw.tobytes())
    file = media.SIGNATURE + media._chunk(b"IHDR", head) + media._chunk(b"IDAT", body[:50]) + media._chunk(b"tEXt", b"note") + media._chunk(b"IDAT", body[50:]) + media._chunk(b"IEND", b"")
    assert (media.png_decode(file) == pixels).all()


def test_broken_files():
    good = media.png_encode(np.arange(128, dtype=np.uint8).reshape(2, 64))
    for bad in (good[:-4], b"x" + good[1:], good[:40] + bytes([good[40] ^ 1]) + good[41:], good[:8]):
        with pytest.raises((media.PngError, zlib.error)):
            media.png_decode(bad)
    assert media.cosine_hash(media.png_decode(good)) == media.cosine_hash(np.arange(128, dtype=np.uint8).reshape(2, 64))


def test_null_files_and_unknown_ids(spark):
    tokenizers, public = pytest.importorskip("tokenizers"), pytest.importorskip("public_tokenizers")
    r = media.features(spark.createDataFrame([(1, 3, None)], "doc_id long, n_bytes long, media binary")).first()
    assert (r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32, r.media_bytes, r.media_sha256, r.feature) == (1, 3, *[None] * 6)
    ids = [10, 10**6, 20, 30]
    library = tokenizers.Tokenizer.from_file(public.path("byte_bpe_50k.json")).decode(ids, skip_special_tokens=False)
    got = bpe.decode(spark.createDataFrame([(1, ids), (2, None), (3, [])], "doc_id long, ids array<int>"), bpe.vocabulary_text()).collect()
    assert {r.doc_id: r.text for r in got} == {1: library, 2: "", 3: ""}


def test_feature_against_a_transform_by_hand():
    """The 64 lowest frequencies of the two-dimensional cosine transform, summed term by term."""
    rng = np.random.default_rng(16)
    pixels = rng.integers(0, 256, (96, 64), dtype=np.uint8)
    n, low = media.SIDE, media.LOW
    small = np.zeros((n, n))
    for i in range(n):
        for j in range(n):
            small[i, j] = pixels[i * 96 // n : (i + 1) * 96 // n, j * 64 // n : (j + 1) * 64 // n].astype(float).mean()
    terms = []
    for u in range(low):
        for v in range(low):
            total = sum(small[i, j] * math.cos(math.pi * (2 * i + 1) * u / (2 * n)) * math.cos(math.pi * (2 * j + 1) * v / (2 * n)) for i in range(n) for j in range(n))
            terms.append(round(total * 2 / n * (0.5**0.5 if u == 0 else 1) * (0.5**0.5 if v == 0 else 1), 6))
    middle = sorted(terms[1:])[len(terms[1:]) // 2]
    bits = "".join("1" if t > middle else "0" for t in terms)
    assert media.cosine_hash(pixels) == f"{int(bits, 2):0{len(bits) // 4}x}"


def test_url_of_very_many_directories(spark):
    url = "http://" + "a." * 300 + "example.com/de/" + "x/" * 20000
    got = url_filter.judge(spark.createDataFrame([(1, url)], "page_id long, url string"), url_filter.rules_table(spark)).first()
    assert (got.rule, got.verdict) == ("example.com/de/", "block")
