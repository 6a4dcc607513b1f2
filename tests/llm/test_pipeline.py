"""The stages one after another, each held against what its contract says of its own input."""

import re

import pytest
from pyspark.sql import functions as F

from larkspan.llm import minhash, pii, quality

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def test_stages(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "line dedup", "near dedup", "personal data", "packing"]
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf).write.parquet(f"{tmp_path}/{i}")
        out = spark.read.parquet(f"{tmp_path}/{i}")
        before, after = {r.doc_id: r.text for r in docs.collect()}, out.collect()
        if i < 4:
            assert out.columns == columns
            assert {r.doc_id for r in after} <= set(before) and len({r.doc_id for r in after}) == len(after)
        if name == "quality rules":
            policy = quality.POLICIES[quality.PRODUCTION]
            kept = {r.doc_id for r in quality.judge(quality.ledger(docs), policy).filter("kept").collect()}
            assert {r.doc_id: r.text for r in after} == {d: before[d] for d in kept}
        if name == "line dedup":
            lines = [" ".join(re.findall(r"[^\W_]+", x.lower())) for r in after for x in r.text.split("\n")]
            lines = [x for x in lines if x]
            assert len(lines) == len(set(lines))
            assert all(r.text == before[r.doc_id] or r.n_chars == len(r.text) for r in after)
        if name == "near dedup":
            sets = [minhash.shingles_of(r.text, 5) for r in after]
            assert not any(a and b and 100 * len(a & b) >= 80 * len(a | b) for j, a in enumerate(sets) for b in sets[:j])
            assert {r.doc_id: r.text for r in after} == {r.doc_id: before[r.doc_id] for r in after}
        if name == "personal data":
            assert len(after) == len(before) and all(not pii.base_spans(r.text) for r in after)
            assert all(r.text == before[r.doc_id] for r in after if not pii.base_spans(before[r.doc_id]) and "<" not in r.text)
        if name == "packing":
            assert {r.doc_id for r in after} == set(before)
            assert out.groupBy("sequence_id").agg(F.sum("length").alias("n")).filter("n > 1024").isEmpty()
        docs = out


def test_odd_rows(spark, sf, tmp_path):
    """Null, empty and blank texts, null keys, repeated rows and clashing names go through every stage as its docstring says."""
    names = "gone n_dropped n_lines g_doc _print f_key f_print found node uid row_id bucket start ids part _0 _1 key print".split()
    long_ = " ".join(f"word{i}" for i in range(40))
    texts = [(1, long_), (1, long_), (2, long_ + " more"), (3, None), (4, ""), (5, " \n"), (6, "mail a.b@c.de " + " ".join(f"other{i}" for i in range(30))), (None, "keyless " + long_), (7, "x " * 60_000)]
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in texts], "doc_id long, text string, lang string, source string, n_chars long")
    for i, name in enumerate(names):
        df = df.withColumn(name, F.lit(i))
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, df, sf)
        rows = got.collect()
        if name != "packing":
            assert got.columns == df.columns, name
            assert all(r[n] == i for r in rows for i, n in enumerate(names)), name
        ids = sorted((r.doc_id is not None, r.doc_id or 0) for r in rows)
        if name == "quality rules":
            assert {r.doc_id for r in rows} == {1, 2, 6, None} and len(rows) == 5
        if name == "line dedup":
            # the keyless row comes first and its line is the one that stays
            assert [i for _, i in ids] == [0, 3, 4, 5, 6, 7]
        if name == "near dedup":
            assert [i for _, i in ids] == [1, 3, 4, 5, 6, 7]
        if name == "personal data":
            assert len(rows) == len(texts) and next(r.text for r in rows if r.doc_id == 6).startswith("mail <EMAIL> ")
            assert next(r for r in rows if r.doc_id == 3).text is None
        if name == "packing":
            assert {r.doc_id for r in rows} == {1, 2, 3, 4, 5, 6, 7, None}
            assert all(len(r.ids) == 4 * r.length for r in rows)


def test_empty(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        got = stage(spark, docs, sf)
        assert got.count() == 0
