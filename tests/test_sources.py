from __future__ import annotations

import io
import json
import tarfile
import zipfile

import pytest
from pyspark.sql import functions as F

from quillspark import storage
from quillspark.functions import models
from quillspark.operators import actions, retrieval
from quillspark.sources import archives, benchmarks, config, index_store, jsonl, prepare
from quillspark.streaming import steps as streaming


def test_jsonl_round_trip_append_and_replace(spark, tmp_path):
    path = str(tmp_path / "rows")
    df = spark.createDataFrame([(1, "ä"), (2, None)], "i long, t string")
    assert jsonl.write_jsonl(df, path) == 2
    assert jsonl.write_jsonl(df, path, append=True) == 2
    back = jsonl.read_jsonl(spark, path, df.schema)
    assert sorted(map(tuple, back.collect()), key=str) == [(1, "ä"), (1, "ä"), (2, None), (2, None)]
    assert jsonl.replace_jsonl(back.where("i = 1"), path) == 2
    assert jsonl.read_jsonl(spark, path, df.schema).count() == 2


def test_blank_lines_are_skipped(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"i": 1}\n\n  \n{"i": 2}\n')
    assert jsonl.read_jsonl(spark, str(tmp_path / "x.jsonl"), "i int").where("i is not null").count() == 2


def test_builtin_world_is_retrievable(spark):
    queries, corpus = benchmarks.load_benchmark(spark, "anything", builtin=True)
    assert queries.count() == 100 and corpus.count() == 25
    top = retrieval.bm25_top_k(corpus, queries, 3).join(queries.select("query_id", F.col("metadata")["supporting_doc"].alias("want")), "query_id")
    assert top.where("doc_id = want").count() / 100 >= 0.8


def test_load_benchmark(spark, tmp_path):
    (tmp_path / "infoseek_queries.jsonl").write_text('{"query_id": 7, "question": "q", "gold_answers": ["a"]}\n{"query_id": "b", "question": "r"}\n')
    (tmp_path / "infoseek_corpus.jsonl").write_text('{"doc_id": "d", "text": "t"}\n')
    q, c = benchmarks.load_benchmark(spark, "Info-Seek", str(tmp_path))
    assert {r["query_id"]: r["gold_answers"] for r in q.collect()} == {"7": ["a"], "b": []}
    assert c.first()["title"] == ""
    assert benchmarks.load_benchmark(spark, "infoseek", str(tmp_path), n=1)[0].count() == 1
    with pytest.raises(ValueError):
        benchmarks.load_benchmark(spark, "gqa")


def test_index_is_built_again_only_for_another_corpus(spark, tmp_path):
    built = []

    def build(corpus):
        built.append(1)
        return models.encoded(retrieval.units(corpus), "text")

    _, corpus = benchmarks.builtin_world(spark)
    path = str(tmp_path / "index")
    one = index_store.load_or_build(corpus, path, build).count()
    index_store.load_or_build(corpus.orderBy(F.col("doc_id").desc()), path, build)
    assert len(built) == 1 and one == 25
    index_store.load_or_build(corpus.withColumn("text", F.concat("text", F.lit("!"))), path, build)
    assert len(built) == 2
    assert index_store.invalidate(spark, path, str(tmp_path / "none")) == 1


def test_archives(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("m.json", json.dumps({"1": {"x": 1}, "2": {"x": 2}}))
        z.writestr("n.txt", "no")
    (tmp_path / "b.zip").write_bytes(b"damaged")
    (tmp_path / "c.zip").write_bytes(b"")
    got = archives.zipped_maps(spark, str(tmp_path / "*.zip"), spark.createDataFrame([("2",)], "key string"))
    assert [tuple(r) for r in got.collect()] == [("2", '{"x": 2}')]
    (tmp_path / "ids").write_text("a\n\nb\n")
    (tmp_path / "map.csv").write_text("a,p\nb,q\nc,r\n")
    assert archives.wanted_targets(spark, str(tmp_path / "ids"), str(tmp_path / "map.csv")).count() == 2
    (tmp_path / "ids").write_text("a\nz\n")
    with pytest.raises(ValueError):
        archives.wanted_targets(spark, str(tmp_path / "ids"), str(tmp_path / "map.csv"))


def test_tar_members(spark, tmp_path):
    with tarfile.open(tmp_path / "a.tar.gz", "w:gz") as t:
        for name in ("d/x1.jpg", "d/x2.jpg"):
            info = tarfile.TarInfo(name)
            info.size = 3
            t.addfile(info, io.BytesIO(b"abc"))
    (tmp_path / "b.tar.gz").write_bytes(b"damaged")
    got = archives.tar_members(spark, str(tmp_path / "*.tar.gz"), spark.createDataFrame([("x2",)], "stem string")).collect()
    assert [(r["stem"], r["name"], bytes(r["content"])) for r in got] == [("x2", "d/x2.jpg", b"abc")]


def test_undecodable_images_are_left_out(spark):
    df = spark.createDataFrame([(1, bytearray(b"ok")), (2, bytearray(b"\xff")), (3, None)], "i int, content binary")
    assert [r["i"] for r in models.decodable(df, "content", lambda b: bytes(b).decode()).collect()] == [1]


def test_config(tmp_path):
    (tmp_path / "c.json").write_text('{"a": {"b": 1}}')
    c = config.load_config(tmp_path / "c.json", ["a.c=true", "d.e=[1, 2]", "f=text"])
    assert c == {"a": {"b": 1, "c": True}, "d": {"e": [1, 2]}, "f": "text"}
    assert config.get(c, "a.b") == 1 and config.get(c, "a.x.y", 5) == 5
    with pytest.raises(ValueError):
        config.load_config(tmp_path / "c.json", ["novalue"])
    assert config.tagged("x/y.jsonl", True).name == "mock_y.jsonl"


def test_executor(spark):
    queries, corpus = benchmarks.builtin_world(spark)
    units = models.encoded(retrieval.units(corpus), "text").withColumn("unit_id", F.monotonically_increasing_id())
    asked = models.encoded(queries, "question")
    for backend in actions.BACKENDS:
        ex = actions.build_executor(corpus, units, backend)
        assert ex.execute("text_search", asked).select("query_id").distinct().count() == 100
    with pytest.raises(ValueError):
        ex.execute("dance", asked)
    with pytest.raises(ValueError):
        ex.execute("image_search", queries)
    with pytest.raises(ValueError):
        ex.execute("text_search", asked.withColumn("final_answer", F.lit("x")))
    ex.register("dance", lambda q: q)
    assert ex.execute("dance", asked).count() == 100
    with pytest.raises(ValueError):
        actions.build_executor(corpus, units, "other")


def test_dedupe_keeps_one_unit_per_entity(spark):
    rows = [(i, "e%d" % (i // 3), [1.0, i / 10]) for i in range(9)]
    units = spark.createDataFrame(rows, "unit_id long, entity_key string, embedding array<float>")
    got = retrieval.vector_top_k(units, spark.createDataFrame([(1, [1.0, 0.0])], "query_id int, embedding array<float>"), 5, dedupe="entity_key").orderBy("rank").collect()
    assert [r["unit_id"] for r in got] == [0, 3, 6]


def test_vectors_without_a_direction_take_no_part(spark):
    """Null, empty, with null or non-finite components; and vectors of another length meet none of these queries."""
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, None), (2, []), (3, [1.0, None]), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [0.0, 1.0]), (7, [1.0, 0.0, 0.0]), (8, [0.0, 0.0])]
    units = spark.createDataFrame(rows, "unit_id long, embedding array<float>")
    asked = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, [nan, 0.0]), (4, [0.0, 0.0, 2.0])], "query_id int, embedding array<float>")
    got = sorted((r["query_id"], r["rank"], r["unit_id"], r["score"]) for r in retrieval.vector_top_k(units, asked, 5).collect())
    assert got == [(1, 1, 0, 1.0), (1, 2, 6, 0.0), (1, 3, 8, 0.0), (4, 1, 7, 0.0)]
    assert retrieval.vector_top_k(units.where("false"), asked, 5).count() == 0 and retrieval.vector_top_k(units, asked.where("false"), 5).count() == 0


def test_bm25_of_nothing(spark):
    docs = spark.createDataFrame([(1, None, None), (2, "", "")], "doc_id long, title string, text string")
    asked = spark.createDataFrame([(1, "where"), (2, None)], "query_id int, question string")
    assert [(r["doc_id"], r["score"]) for r in retrieval.bm25_top_k(docs, asked, 3).where("query_id = 1").orderBy("rank").collect()] == [(1, 0.0), (2, 0.0)]
    assert retrieval.bm25_top_k(docs.where("false"), asked, 3).count() == 0


def test_what_is_short_raises(spark):
    rows = spark.createDataFrame([("a", "i"), ("a", "j"), ("b", ""), (None, "k")], "id string, imageId string")
    assert [r["id"] for r in prepare.chosen_instructions(rows, 3).collect()] == ["a"]
    with pytest.raises(ValueError):
        prepare.chosen_instructions(rows, 3, complete=True)
    images = spark.createDataFrame([("x", "s", b"1"), ("y", "s", b"")], "image_id string, source string, content binary")
    wanted = spark.createDataFrame([("x",), ("y",)], "image_id string")
    assert prepare.wanted_images(images, wanted).count() == 1
    with pytest.raises(ValueError, match="'y'"):
        prepare.wanted_images(images, wanted, complete=True)
    asked = spark.createDataFrame([(1, "q?", ["a", "b", "c", "d"], "b", "B", "p", "s", "t")], "id int, question string, choices array<string>, answer string, answer_choice string, image_path string, scenario string, aspect string")
    assert prepare.visual_questions(asked, 1).first()["gold_answers"] == ["b", "B", "B. b"]
    with pytest.raises(ValueError):
        prepare.visual_questions(asked, 2)


def test_a_cluster_needs_a_shared_folder():
    class Conf:
        get = staticmethod(lambda key, default=None: default)

    class Session:
        conf = Conf
        sparkContext = type("C", (), {"master": "spark://host:7077", "applicationId": "a"})

    with pytest.raises(RuntimeError):
        storage.shared_dir(Session)


def test_stream_takes_each_key_once_over_runs(spark, tmp_path):
    src, out, state = (str(tmp_path / x) for x in ("src", "out", "state"))
    schema = "k long, ts timestamp"
    row = lambda k: (k, None)
    frame = lambda ks: spark.createDataFrame([row(k) for k in ks], schema).withColumn("ts", F.lit("2024-01-01").cast("timestamp"))
    frame([1, 2, 2]).write.parquet(src)
    streaming.collect_once(streaming.step_stream(spark, src, schema), "k", out, state).awaitTermination()
    frame([2, 3]).write.mode("append").parquet(src)
    streaming.collect_once(streaming.step_stream(spark, src, schema), "k", out, state).awaitTermination()
    assert sorted(r["k"] for r in spark.read.option("basePath", out).parquet(f"{out}/_batch=*").collect()) == [1, 2, 3]
    assert streaming.collected(spark, out, spark.read.parquet(src).schema).count() == 3
