from __future__ import annotations

from collections import Counter

import corpus_pipeline
from quillspark.llm import packing, queries, secrets
from quillspark.storage import materialize
from tests.oracle import DATA

from .fixtures import empty
from .test_operators import near, words
from .test_registered import plain_mixture


def test_stages_one_by_one(spark):
    sf = str(DATA / "sf0.001")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, ids = docs.columns, []
    for name, stage in corpus_pipeline.STAGES:
        out = materialize(stage(spark, docs, sf), name)
        ids.append(sorted(r[0] for r in out.select("doc_id").collect()))
        if name != "packing":
            assert out.columns == columns
        docs = out
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    kept = set(ids[0])
    good = [d for d, q in labels.items() if q == 1]
    assert sum(d in kept for d in good) / len(good) > 0.97 and sum(d in kept for d, q in labels.items() if q == 0) <= 2
    assert set(ids[1]) < set(ids[0]) and len(set(ids[1])) == len(ids[1])
    assert ids[2] == ids[1] and set(ids[3]) <= set(ids[2]) and set(ids[4]) == set(ids[3])
    whole = sorted(map(str, corpus_pipeline.run(spark, sf).collect()))
    assert whole == sorted(map(str, docs.collect()))


def test_run_against_plain_python(spark):
    """The registered pipeline on the whole smallest table: what the ranking keeps is taken from op10, all else is made anew."""
    sf = str(DATA / "sf0.001")
    table = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang", "source").collect()]
    good = {r["doc_id"] for r in queries.op10_ranking(spark, sf).collect() if r["predicted"]}
    rows = sorted(r for r in table if r[0] in good)
    first = near([r[1] for r in rows], 5, 0.8)[1]
    rows = [r for i, r in enumerate(rows) if first[i] == i]

    def redacted(t):
        spans = sorted((s, k, e, r.kind) for k, r in enumerate(secrets.RULES) for s, e in r.spans(t or ""))
        return t and secrets.masked(t, spans)

    rows = [(r[0], redacted(r[1]), *r[2:]) for r in rows]
    want = Counter()
    for d, copies in plain_mixture(spark, rows).items():
        w = words(next(r[1] for r in rows if r[0] == d))
        for piece in range(max(1, -(-len(w) // packing.MAX_TOKENS))):
            want[d, piece, " ".join(w[piece * packing.MAX_TOKENS : (piece + 1) * packing.MAX_TOKENS])] += copies
    got = corpus_pipeline.run(spark, sf).collect()
    assert Counter((r["doc_id"], r["piece"], r["text"]) for r in got) == want
    slots = Counter((r["bucket"], r["batch"], r["slot"]) for r in got)
    assert max(slots.values()) == 1 and all(r["n_tokens"] == len(words(r["text"])) <= r["padded_tokens"] for r in got)


def test_the_packed_text_is_in_the_result(spark):
    docs = spark.createDataFrame([(1, "one two password = abcdefgh12345678 three", "en", "s", 42)], "doc_id long, text string, lang string, source string, n_chars long")
    redacted = corpus_pipeline.STAGES[2][1](spark, docs, "")
    (row,) = corpus_pipeline.STAGES[-1][1](spark, redacted, "").collect()
    assert row["text"] == "one two [assign] three" and row["n_tokens"] == 4


def test_empty_tables_pass_through(spark):
    sf = str(DATA / "sf0.001")
    docs = empty(spark).select("doc_id", "text", "lang", "source", "n_chars")
    for name, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(spark, docs, sf), name)
        assert docs.count() == 0
