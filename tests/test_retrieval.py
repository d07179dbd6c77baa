"""BM25 against the formula in plain Python."""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.operators import retrieval as R


def _plain_bm25(docs, queries, k):
    """Of (doc_id, text) and (query_id, question): the k best of each query, by the formula."""
    words = lambda x: re.findall("[a-z0-9]+", (x or "").lower())
    tf = {d: Counter(words(x)) for d, x in docs}
    df = Counter(t for c in tf.values() for t in c)
    n, avgdl = len(docs), sum(sum(c.values()) for c in tf.values()) / len(docs)
    raw = {t: math.log(n - f + 0.5) - math.log(f + 0.5) for t, f in df.items()}
    mean = sum(raw.values()) / len(raw)
    idf = {t: v if v >= 0 else R.EPSILON * mean for t, v in raw.items()}
    first, out = sorted(tf)[:k], []
    for q, asked in queries:
        for d, c in tf.items():
            mine = [idf[t] * c[t] * (R.K1 + 1) / (c[t] + R.K1 * (1 - R.B + R.B * sum(c.values()) / avgdl)) for t in words(asked) if t in c]
            out += [(q, round(sum(mine), 6), d)] if mine or d in first else []
    return sorted((q, i + 1, d, s) for q, _ in queries for i, (_, s, d) in enumerate(sorted((x for x in out if x[0] == q), key=lambda x: (-x[1], x[2]))[:k]))


@pytest.mark.parametrize("parts, held, batch, most", [(2_000_000, 200_000, 10_000, 500_000), (1, 1, 1, 500_000), (7, 3, 5, 500_000), (1, 1, 1, 0)])
def test_bm25_is_the_same_in_small_batches_and_by_a_join(spark, monkeypatch, parts, held, batch, most):
    docs = [(f"d{i:02}", " ".join("abcdefgh"[(i * j) % 8] * (1 + j % 2) for j in range(i % 9))) for i in range(60)] + [("zz", None), ("z", "a copy"), ("y", "a copy")]
    queries = [((1, "x"), "a bb c"), ((1, "y"), "copy copy a"), ((2, "x"), "unknown"), ((2, "y"), ""), ((3, "x"), "h gg ff e")]
    for name, value in (("PARTS", parts), ("HELD", held), ("BROADCAST_TERMS", most)):
        monkeypatch.setattr(R, name, value)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        found = R.bm25_top_k(spark.createDataFrame(docs, "doc_id string, text string"), spark.createDataFrame(queries, "query_id struct<n:int,form:string>, question string"), 4)
        got = sorted((tuple(r["query_id"]), r["rank"], r["doc_id"], r["score"]) for r in found.collect())
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert got == [(q, i, d, pytest.approx(s, abs=2e-6)) for q, i, d, s in _plain_bm25(docs, queries, 4)]


def test_scores_are_rounded_as_by_spark(spark):
    x = [0.0, 1.0000005, 2.0000015, 0.1234565, 1.2345675, 7.0000004999, 12.3456785, -1.0000005, -0.1234565, 123.4567895, 3.3]
    rows = spark.createDataFrame([(v,) for v in x], "x double").select("x", F.round("x", 6).alias("r")).collect()
    assert [r["r"] for r in rows] == list(R._rounded(np.array([r["x"] for r in rows]), 6))


@pytest.mark.parametrize("name", ["bm25_topk", "hybrid_topk", "tree_search"])
def test_pairs_of_query_and_document_are_not_shuffled(spark, name):
    from quillspark.plans import registry

    from .oracle import DATA

    plan = registry.QUERIES[name](spark, str(DATA / "sf0.001"))._jdf.queryExecution().optimizedPlan().toString()
    assert "sum(part" not in plan


def test_tasks_of_the_index_do_not_grow_with_the_input(spark, monkeypatch):
    from .oracle import DATA

    docs = spark.read.parquet(str(DATA / "sf0.001" / "documents.parquet")).select("doc_id", "text")
    assert R._deals(docs) == []
    assert R._deals(spark.createDataFrame([(1, "a")], "doc_id long, text string")) == []  # of unknown size
    whole = sorted(map(tuple, R.bm25_index(docs).frequencies.collect()))
    monkeypatch.setattr(R, "DEALT_BYTES", 10_000)
    assert R._deals(docs)[0] > 4
    assert sorted(map(tuple, R.bm25_index(docs).frequencies.collect())) == whole
