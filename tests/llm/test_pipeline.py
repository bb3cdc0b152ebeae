import hashlib
import random
import re

import corpus_pipeline
import numpy as np
import public_tokenizers as P
import tiktoken

from roundwise.llm import bpe, common, simhash
from tests.llm.test_pii import brute as pii_spans
from tests.llm.test_quality import brute as quality_of

NAMES = ("EMAIL", "IP", "CARD", "PHONE")


def redacted(text):
    out, at = "", 0
    for a, k, b in pii_spans(text):
        if a >= at:
            out += text[at:a] + f"<{NAMES[k]}>"
        at = max(at, b)
    return out + text[at:]


def test_pipeline_equals_brute_force(spark, tmp_path):
    pick = random.Random(12)
    body = lambda: " ".join(f"w{pick.randrange(5000)}" for _ in range(90))
    rows = [(i, body() + (" mail me@x.org" if i % 5 == 0 else ""), "en", f"s{i % 3}", 0) for i in range(60)]
    rows += [(100 + i, rows[i][1].upper(), "en", "s0", 0) for i in range(10)]
    rows += [(200, "too short", "en", "s1", 0), (201, None, None, None, 0), (202, "", "en", "s1", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()

    docs = {i: t for i, t, *_ in rows if not quality_of(t)[-1]}
    stay = {}
    for i in sorted(docs):
        stay.setdefault(simhash.fingerprint(docs[i]), i)
    assert len(stay) == 60
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(P.path("byte_bpe_50k.tiktoken")), special_tokens={})
    sizes = {s: sum(len(re.findall(r"\S+", redacted(docs[i]))) for i in stay.values() if i % 3 == s) for s in range(3)}
    total, taken = sum(sizes.values()), dict.fromkeys(range(3), 0)
    for r in got:
        clean = redacted(docs[r.doc_id])
        ids = library.encode_ordinary(clean)
        assert r.doc_id in stay.values() and r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(clean.encode()).hexdigest()
        taken[r.doc_id % 3] += len(re.findall(r"\S+", clean))
    for s, w in enumerate((5, 2, 1)):
        assert abs(taken[s] - total * w / 8) <= 95


def test_stages_on_empty_tables(spark, tmp_path):
    """No documents, or none that stay: every stage gives no rows and its columns."""
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    for rows in ([], [(1, "too short", "en", "s", 9), (None, None, None, None, None)]):
        path = f"{tmp_path}/{len(rows)}"
        spark.createDataFrame(rows, schema).write.parquet(f"{path}/documents.parquet")
        spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
        assert corpus_pipeline.run(spark, path).count() == 0
        docs = spark.read.parquet(f"{path}/documents.parquet")
        for name, stage in corpus_pipeline.STAGES[:-1]:
            assert stage(spark, docs, path).columns == docs.columns, name


def test_sweep_removes_what_was_staged(spark):
    kept = common.staged(spark.range(3), "numbers")
    assert kept.count() == 3
    common.sweep(spark)
    at = spark._jvm.org.apache.hadoop.fs.Path(common.staging_dir(spark))
    assert not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)
