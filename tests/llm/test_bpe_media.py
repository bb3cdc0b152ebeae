import hashlib
import io
import math
import random
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken

from roundwise.llm import bpe, media


@pytest.fixture(scope="module")
def codec():
    return bpe.codec(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)


def texts():
    pick = random.Random(7)
    yield from ["", "a", "  two  spaces\n\n", "naïve Straße 東京 🎉", "x" * 3000, "don't we'll 123 4567 !!!", "\x00\t\r\n", "ththththth" * 50]
    for _ in range(200):
        yield "".join(pick.choice("abcdeth  \n.,é9ßñ'") for _ in range(pick.randrange(60)))


def test_same_ids_as_the_library_and_round_trip(codec):
    known = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=codec.ranks, special_tokens={})
    for t in texts():
        ids = codec.encode(t)
        assert np.frombuffer(ids, "<u4").tolist() == known.encode_ordinary(t)
        assert codec.decode(ids) == t.encode()


def test_perfect_hash_is_minimal_and_exact():
    keys = [str(i).encode() * (i % 3 + 1) for i in range(997)]
    keys = list(dict.fromkeys(keys))
    h = bpe.PerfectHash(keys)
    assert sorted(h.slot) == list(range(len(keys)))
    assert [h.find(k) for k in keys] == list(range(len(keys)))
    assert h.find(b"absent") == -1 and bpe.PerfectHash([]).find(b"x") == -1


@pytest.mark.parametrize("shape", [(1, 64), (7, 5), (3, 4, 3), (6, 1)])
def test_media_round_trips(shape):
    a = np.random.default_rng(3).integers(0, 256, shape, dtype=np.uint8)
    assert (media.read_netpbm(media.write_netpbm(a)) == a).all()
    assert (media.read_bmp(media.write_bmp(a)) == a).all()


def test_resize_is_the_area_mean():
    a = np.random.default_rng(5).integers(0, 256, (10, 12), dtype=np.uint8)
    fine = np.repeat(np.repeat(a, 8, 0), 9, 1).astype(float)
    exact = fine.reshape(8, 10, 9, 12).mean(axis=(1, 3))
    assert np.allclose(media.resized(a, 8, 9), exact)


def test_queries_on_odd_rows(spark):
    rows = spark.createDataFrame([(1, None, "x"), (1, "", "x"), (2, "Ab c" * 40, "y"), (2, "Ab c" * 40, "y")], "doc_id long, text string, ids string")
    got = bpe.tokenize(rows).toPandas()
    assert got.n_tokens.tolist()[:2] == [0, 0] and got.n_tokens[2] == got.n_tokens[3] > 0
    made = media.as_media(rows, "bmp", ("n_bytes", "payload_bytes", "feature")).toPandas()
    assert made.payload_bytes.tolist() == [64, 64, 192, 192]
    assert made.feature[0] == made.feature[1] and made.feature[2] == made.feature[3]
    assert bpe.tokenize(rows.limit(0)).count() == 0


def brute_media(text):
    """The query's columns by plain loops: bytes, area means as fractions, bits."""
    raw = (text or "").encode()
    whole = raw + bytes(-len(raw) % 64 if raw else 64)
    h = len(whole) // 64
    if zlib.crc32(whole) % 2 == 0:
        stored = b"P5\n64 %d\n255\n" % h + whole
    else:
        palette = b"".join(bytes([i, i, i, 0]) for i in range(256))
        le = lambda n, k=4: n.to_bytes(k, "little")
        stored = b"BM" + le(54 + 1024 + len(whole)) + le(0) + le(54 + 1024) + le(40) + le(64) + le(h) + le(1, 2) + le(8, 2) + le(0) + le(len(whole)) + le(2835) * 2 + le(256) + le(0) + palette
        stored += b"".join(whole[i * 64 : i * 64 + 64] for i in reversed(range(h)))

    def overlap(i, n, m, j):  # of source cell i with target cell j
        return max(Fraction(0), min(Fraction(i + 1), Fraction((j + 1) * n, m)) - max(Fraction(i), Fraction(j * n, m)))

    tile = [[math.floor(sum(whole[y * 64 + x] * overlap(y, h, 8, r) * overlap(x, 64, 9, c) for y in range(h) for x in range(64)) / (Fraction(h, 8) * Fraction(64, 9)) + Fraction(1, 2)) for c in range(9)] for r in range(8)]
    code = bytes(sum((tile[r][c + 1] > tile[r][c]) << (7 - c) for c in range(8)) for r in range(8)).hex()
    return len(raw), len(whole), hashlib.sha256(whole).hexdigest(), zlib.crc32(whole[-64:]), len(stored), hashlib.sha256(stored).hexdigest(), code, tile


def test_media_query_equals_brute_force(spark, tmp_path):
    pick = random.Random(3)
    texts = [None, "", "a", "b" * 64, "é" * 33, "a", "ab" * 700] + ["".join(pick.choice("abc é日\n") for _ in range(pick.randrange(300))) for _ in range(20)]
    spark.createDataFrame([(i % 5, t, "x") for i, t in enumerate([*texts, "long text " * 300_000])], "doc_id long, text string, tile string").write.parquet(f"{tmp_path}/documents.parquet")
    got = media.op7_media_columns(spark, str(tmp_path)).collect()
    want = Counter(repr(brute_media(t)) for t in texts)
    short = [r for r in got if r.n_bytes < 3_000_000]
    assert Counter(repr((r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32, r.media_bytes, r.media_sha256, r.feature.split(":")[0], np.load(io.BytesIO(r.tile)).tolist())) for r in short) == want
    assert len(got) == len(texts) + 1 and {r.media_bytes - r.payload_bytes > 1000 for r in got} == {True, False}
    assert all(r.feature.split(":")[1] == f"{zlib.crc32(r.tile):08x}" for r in got)
    assert media.as_media(spark.read.parquet(f"{tmp_path}/documents.parquet").limit(0)).count() == 0
