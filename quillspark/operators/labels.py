"""Step labels: prefix credit, state snapshots, fused scores.

A table of steps has a row per (traj_id, step_index) with query_id, question, action_type, action_input, outcome (of its
trajectory) and evidence (array of structs with evidence_id, title, text, image_path).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scores as S


def _up_to(offset: int):
    """The steps of a trajectory from its first to the one ``offset`` from this."""
    return Window.partitionBy("traj_id").orderBy("step_index").rowsBetween(Window.unboundedPreceding, offset)


def with_prefix(steps: DataFrame) -> DataFrame:
    """Adds ``prefix``: the (type, input) pairs of the trajectory up to and with this step."""
    return steps.withColumn("prefix", F.collect_list(F.struct("action_type", "action_input")).over(_up_to(0)))


def with_prefix_key(steps: DataFrame) -> DataFrame:
    """Adds ``prefix_key``: equal where the prefixes are, but of one length. A digest of the steps' digests, so texts aren't
    gathered step after step; null differs from all strings."""
    part = lambda c: F.coalesce(F.concat(F.length(c).cast("string"), F.lit(":"), c), F.lit("-"))
    step = F.sha2(F.concat(part("action_type"), part("action_input")).cast("binary"), 256)
    return steps.withColumn("prefix_key", F.sha2(F.array_join(F.collect_list(step).over(_up_to(0)), "").cast("binary"), 256))


def prefix_credit(steps: DataFrame) -> DataFrame:
    """query_id, prefix, credit, n: mean outcome and number of the trajectories through each node of a query's tree.

    Every step of a trajectory counts once for its own prefix, so a trajectory counts at each of its nodes.
    """
    return with_prefix(steps).groupBy("query_id", "prefix").agg(F.avg("outcome").alias("credit"), F.count("*").alias("n"))


def with_snapshot(steps: DataFrame) -> DataFrame:
    """Adds the state before each step: actions_before ("type(input)") and evidence_before."""
    said = F.concat("action_type", F.lit("("), "action_input", F.lit(")"))
    return steps.withColumn("actions_before", F.collect_list(said).over(_up_to(-1))).withColumn("evidence_before", F.flatten(F.collect_list("evidence").over(_up_to(-1))))


def sample_id(traj_id: Column, step_index: Column) -> Column:
    return F.concat(traj_id, F.lit("#s"), step_index.cast("string"))


def label_steps(steps: DataFrame, alpha: float = 0.5, floor: float = 0.3, threshold: float = 0.3, judge: bool = True) -> DataFrame:
    """A training sample per step: its snapshot, local grounding, outcome credit, answer support, fused score and its source.

    Grounding and support see the texts of the evidence, not its titles. Without ``judge`` answers have no support.
    Snapshots grow with the square of a trajectory's steps: they are made after all shuffles of single steps.
    """
    keyed = with_prefix_key(steps)
    credit = keyed.groupBy("query_id", "prefix_key").agg(F.avg("outcome").alias("outcome_credit"), F.count("*").alias("n_traj_through"))
    rows = with_snapshot(keyed.join(credit, ["query_id", "prefix_key"]).drop("prefix_key"))
    texts = lambda c: F.transform(F.col(c), lambda e: e["text"])
    images = F.transform(F.col("evidence"), lambda e: e["image_path"])
    answers = F.col("action_type") == "answer"
    local = S.grounding(F.col("action_type"), F.col("question"), texts("evidence"), images)
    none = F.struct(F.lit(None).cast("string").alias("label"), F.lit(None).cast("double").alias("support"))
    judged = F.when(answers, S.answer_support(F.col("action_input"), texts("evidence_before"))) if judge else none
    rows = rows.withColumn("local_grounding", local).withColumn("_s", judged)
    rows = rows.withColumn("answer_support", F.col("_s.support")).withColumn("answer_support_label", F.col("_s.label")).drop("_s")
    outcome, support = F.col("outcome_credit"), F.col("answer_support")
    score = F.when(answers, S.fuse_answer(outcome, support, floor)).otherwise(S.fuse(F.col("local_grounding"), outcome, alpha))
    return (
        rows.withColumn("sample_id", sample_id(F.col("traj_id"), F.col("step_index")))
        .withColumn("alpha", F.lit(alpha))
        .withColumn("support_floor", F.lit(floor))
        .withColumn("score", score)
        .withColumn("unsupported_correct", answers & S.unsupported_correct(outcome, support, threshold))
        .withColumn("score_source", S.score_source(F.col("action_type"), F.col("local_grounding"), support))
    )


def label_statistics(samples: DataFrame) -> DataFrame:
    """One row: counts, means of what isn't null, unsupported answers, and the distribution of support labels."""
    counts = samples.where("answer_support_label is not null").groupBy("answer_support_label").agg(F.count("*").alias("c"))
    labels = counts.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("answer_support_label", "c")))).alias("labels"))
    whole = samples.agg(
        F.count("*").alias("n"),
        F.avg("local_grounding").alias("mean_local"),
        F.avg("outcome_credit").alias("mean_credit"),
        F.avg("answer_support").alias("mean_support"),
        F.avg("score").alias("mean_score"),
        F.count_if("unsupported_correct").alias("unsupported"),
    )
    return whole.crossJoin(F.broadcast(labels))


def trajectory_statistics(steps: DataFrame) -> DataFrame:
    """One row: trajectories, mean steps, share of good outcomes."""
    per = steps.groupBy("traj_id").agg(F.count("*").alias("steps"), F.max("outcome").alias("outcome"))
    return per.agg(F.count("*").alias("n"), F.coalesce(F.avg("steps"), F.lit(0.0)).alias("mean_steps"), F.coalesce(F.avg("outcome"), F.lit(0.0)).alias("outcome_rate"))


def observation(evidence: Column) -> Column:
    """The evidence of a step on one line: "title: text", or the text alone, joined by bars."""
    return F.array_join(F.transform(evidence, lambda e: F.when(F.coalesce(e["title"], F.lit("")) != "", F.concat_ws(": ", e["title"], e["text"])).otherwise(e["text"])), " | ")


def trajectory_text(steps: DataFrame) -> DataFrame:
    """traj_id and a text block: question, numbered steps with their evidence, final answer (of the answer step, else empty)."""
    seen = observation(F.col("evidence"))
    line = F.concat(F.lit("Step "), (F.col("step_index") + 1).cast("string"), F.lit(" ["), F.col("action_type"), F.lit("]: "), F.col("action_input"), F.when(seen != "", F.concat(F.lit("\n  Evidence: "), seen)).otherwise(""))
    rows = steps.select("traj_id", "question", F.struct("step_index", line.alias("line"), F.when(F.col("action_type") == "answer", F.col("action_input")).alias("answer")).alias("s"))
    whole = rows.groupBy("traj_id").agg(F.first("question").alias("question"), F.array_sort(F.collect_list("s")).alias("s"))
    answer = F.coalesce(F.try_element_at(F.array_compact(F.transform("s", lambda x: x["answer"])), F.lit(-1)), F.lit(""))
    return whole.select("traj_id", F.concat_ws("\n", F.concat(F.lit("Question: "), "question"), F.array_join(F.transform("s", lambda x: x["line"]), "\n"), F.concat(F.lit("Final answer: "), answer)).alias("text"))


def trajectory_rows(steps: DataFrame) -> DataFrame:
    """The nested form: one row per trajectory with its steps, each with the evidence it saw."""
    parts = F.struct("step_index", "action_type", "action_input", "evidence")
    return steps.groupBy("traj_id", "query_id", "question").agg(F.max("outcome").alias("outcome_em"), F.array_sort(F.collect_list(parts), lambda a, b: a["step_index"].cast("int") - b["step_index"].cast("int")).alias("steps"))


def exploded_steps(trajectories: DataFrame) -> DataFrame:
    """The inverse: a row per step of nested trajectories."""
    return trajectories.select("traj_id", "query_id", "question", F.col("outcome_em").alias("outcome"), F.explode("steps").alias("s")).select("traj_id", "query_id", "question", "outcome", "s.*")


def pairs(samples: DataFrame, margin: float = 0.3) -> DataFrame:
    """Preference pairs: two different actions from the same state of a query whose scores differ by at least ``margin``.

    An extension for preference training; for each state its best and worst action, so states of any size give one row.
    """
    rank = F.struct("score", "sample_id", "action_type", "action_input")
    best = samples.groupBy("query_id", "actions_before").agg(F.max(rank).alias("chosen"), F.min(rank).alias("rejected"))
    return best.where(F.col("chosen.score") - F.col("rejected.score") >= margin)
