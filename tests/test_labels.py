from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from quillspark.operators import labels as L
from quillspark.operators import quality as Q
from quillspark.operators import rationales

STEP = "traj_id string, query_id string, question string, step_index int, action_type string, action_input string, outcome double, evidence array<struct<evidence_id:string,title:string,text:string,image_path:string>>"


def ev(i, text):
    return [(f"e{i}", "T", text, None)]


@pytest.fixture
def steps(spark):
    rows = [
        ("q#t0", "q", "Where is the tower?", 0, "text_search", "A", 1.0, ev(0, "the tower is in Rome")),
        ("q#t0", "q", "Where is the tower?", 1, "answer", "right", 1.0, []),
        ("q#t1", "q", "Where is the tower?", 0, "text_search", "A", 0.0, ev(0, "nothing")),
        ("q#t1", "q", "Where is the tower?", 1, "answer", "wrong", 0.0, []),
        ("p#t0", "p", "Where is the tower?", 0, "text_search", "A", 0.0, []),
    ]
    return spark.createDataFrame(rows, STEP)


def test_credit_is_per_node_and_query(steps):
    rows = {(r["query_id"], tuple(p["action_input"] for p in r["prefix"])): (r["credit"], r["n"]) for r in L.prefix_credit(steps).collect()}
    assert rows == {("q", ("A",)): (0.5, 2), ("q", ("A", "right")): (1.0, 1), ("q", ("A", "wrong")): (0.0, 1), ("p", ("A",)): (0.0, 1)}


def test_labels(steps):
    rows = {r["sample_id"]: r for r in L.label_steps(steps).collect()}
    first, answer = rows["q#t0#s0"], rows["q#t0#s1"]
    assert first["actions_before"] == [] and answer["actions_before"] == ["text_search(A)"]
    assert [e["evidence_id"] for e in answer["evidence_before"]] == ["e0"]
    assert first["local_grounding"] == 1.0 and first["score"] == pytest.approx(0.75)
    assert answer["local_grounding"] is None and answer["answer_support"] == 0.0
    assert answer["score"] == pytest.approx(0.3) and answer["unsupported_correct"] and answer["score_source"] == "answer_support"
    assert rows["p#t0#s0"]["local_grounding"] == 0.0


def test_nested_form_and_back(steps):
    back = L.exploded_steps(L.trajectory_rows(steps)).select(*steps.columns)
    key = lambda r: (r["traj_id"], r["step_index"])
    assert sorted(back.collect(), key=key) == sorted(steps.collect(), key=key)


GOOD = "The text_search step used [e0] which shows the place that was asked for and so it moves the search forward because the found text names the thing the question asks about and little remains to be found afterwards here.\nVERDICT: good"


@pytest.mark.parametrize(
    "text, score, faults",
    [
        (GOOD, 0.9, []),
        (GOOD.replace("[e0]", "[e7]"), 0.9, ["cites no visible evidence"]),
        (GOOD.replace("text_search", "look"), 0.9, ["does not mention the action type"]),
        ("text_search [e0]\nVERDICT: good", 0.9, ["length 2 outside [30, 150]"]),
        (GOOD.replace("\nVERDICT: good", ""), 0.9, ["missing verdict"]),
        (GOOD, 0.2, ["verdict 'good' contradicts score 0.20"]),
        (GOOD.replace("good", "poor"), 0.7, ["verdict 'poor' contradicts score 0.70"]),
        ("By the ground truth, " + GOOD, 0.9, ["leaks the outcome: ground truth"]),
        ("Carson City. " + GOOD, 0.9, ["mentions a gold answer that no evidence shows"]),
        ("VERDICT: poor " + GOOD, 0.9, []),
    ],
)
def test_rationale_rules(spark, text, score, faults):
    row = spark.createDataFrame([(text, score)], "t string, s double").withColumn("golds", F.array(F.lit("Carson City"), F.lit("yes")))
    seen = F.array(F.struct(F.lit("e0").alias("evidence_id"), F.lit("T").alias("title"), F.lit("a place").alias("text")))
    none = F.array().cast("array<struct<evidence_id:string,title:string,text:string>>")
    out = row.select(Q.rationale_faults(F.col("t"), F.lit("text_search"), F.lit("in"), F.lit("q"), none, seen, F.col("golds"), F.col("s")).alias("f")).first()["f"]
    assert out == faults


def test_retries_stop_when_rules_are_kept(spark, steps):
    samples = L.label_steps(steps).withColumn("gold_answers", F.array(F.lit("none")))

    def generate(df):
        good = Q.template_rationale(F.col("action_type"), F.col("action_input"), F.col("evidence_before"), F.col("evidence"), F.col("score"))
        return df.withColumn("raw", F.when(F.size("rationale_qc_reasons") > 0, good).otherwise("too short"))

    rows = rationales.with_rationales(samples, generate).collect()
    assert len(rows) == 5 and {r["rationale_attempts"] for r in rows if r["rationale_qc_pass"]} == {2}
    assert [r["sample_id"] for r in rows if not r["rationale_qc_pass"]] == ["p#t0#s0"]  # nothing visible to cite
    assert [r["rationale_attempts"] for r in rows if not r["rationale_qc_pass"]] == [3]


def test_filter_order_and_split(spark):
    rows = [("a", "q1", None, 1.0, True), ("b", "q1", 0.0, 1.0, False), ("b", "q1", 0.5, 1.0, False), ("c", "q2", 0.5, 1.0, True), ("c", "q2", None, 0.0, True)]
    df = spark.createDataFrame(rows, "traj_id string, query_id string, local_grounding double, outcome_credit double, rationale_qc_pass boolean")
    got = sorted(str(r["drop_reason"]) for r in Q.filtered(df).collect())
    assert got == ["None", "None", "grounding_outcome_gap", "rationale_qc", "traj_length"]
    leaks = Q.split_leaks({"train": df.where("query_id = 'q1'"), "val": df})
    assert [(r["key"], r["splits"]) for r in leaks.collect()] == [("q1", ["train", "val"])]


def test_prefix_keys_are_equal_where_prefixes_are(spark):
    odd = [None, "", "-", "1:-", "0:", "a", "ab", "1:a", "a1:b", "é"]
    rows = [(f"t{i}.{j}", n, kind, said) for i, a in enumerate(odd) for j, b in enumerate(odd) for n, (kind, said) in enumerate([("x", a), (b, "a"), ("x", b)])]
    rows += [("again" + t, *rest) for t, *rest in rows]
    steps = L.with_prefix_key(L.with_prefix(spark.createDataFrame(rows, "traj_id string, step_index int, action_type string, action_input string")))
    got = steps.select(F.to_json("prefix", {"ignoreNullFields": "false"}).alias("p"), "prefix_key").collect()
    assert len({r["p"] for r in got}) == len({r["prefix_key"] for r in got}) == len({tuple(r) for r in got}) < len(got)


def test_labels_are_read_once_and_carry_no_snapshots_through_shuffles(spark):
    from quillspark.plans import registry

    from .oracle import DATA

    plan = registry.QUERIES["release_violations"](spark, str(DATA / "sf0.001"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("parquet") <= 2  # samples, and credits of prefixes
    join = plan[plan.index("Join Inner") :]
    assert "prefix_key" in join and "evidence_before" not in join and "actions_before" not in join


def test_summary_counts_repeated_and_missing_ids(spark):
    ids = [("a#s1", "t"), ("a#s1", "t"), ("a#s1", "u"), (None, None), (None, None), ("b#s1", "t")]
    kinds = {"question": "string", "action_type": "string", "action_input": "string", "local_grounding": "double", "outcome_credit": "double", "n_traj_through": "long", "alpha": "double", "support_floor": "double", "score": "double", "answer_support": "double", "rationale": "string", "rationale_verdict": "string", "rationale_qc_pass": "boolean", "image_path": "string"}
    seen = "array<struct<evidence_id:string,title:string,text:string,image_path:string>>"
    s = spark.createDataFrame(ids, "sample_id string, traj_id string").withColumn("query_id", F.lit("q"))
    s = s.select("*", *[F.lit(None).cast(t).alias(c) for c, t in kinds.items()], F.array().cast(seen).alias("evidence_before"), F.array().cast(seen).alias("evidence"))
    got = {r["violation"]: r["n"] for r in Q.violation_summary(s, most=2).collect()}
    table = {r["violation"]: r["n"] for r in Q.table_violations(s, most=2).groupBy("violation").agg(F.sum("n").alias("n")).collect()}
    assert {k: got.get(k) for k in table} == table == {"duplicate sample_id": 3, "too many samples": 1}
    assert got["missing question"] == 6 and got["missing sample_id"] == got["missing traj_id"] == 2
