"""Summaries of search runs over seeds, and filters for looking into trajectories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scores import seeded_hash


def run_summary(records: DataFrame, by: list[str] = ["seed"]) -> DataFrame:  # noqa: B006
    """Per run: n, accuracy, mean rollouts, mean best reward. Records: query_id, outcome, rollouts, best_reward, actions (array)."""
    return records.groupBy(*by).agg(F.count("*").alias("n"), F.avg("outcome").alias("accuracy"), F.avg("rollouts").alias("mean_rollouts"), F.avg("best_reward").alias("mean_best_reward"))


def action_usage(records: DataFrame, by: list[str] = ["seed"]) -> DataFrame:  # noqa: B006
    """How often each action type is on the best paths, per run."""
    return records.select(*by, F.explode("actions").alias("action")).groupBy(*by, "action").agg(F.count("*").alias("uses"))


def seed_aggregate(summaries: DataFrame) -> DataFrame:
    """One row over runs: mean accuracy, its sample deviation (0 for one run), the accuracies in order of seed, mean rollouts."""
    per = F.transform(F.array_sort(F.collect_list(F.struct("seed", "accuracy"))), lambda s: s["accuracy"])
    return summaries.agg(
        F.count("*").alias("seeds"), F.avg("accuracy").alias("accuracy"), F.coalesce(F.stddev_samp("accuracy"), F.lit(0.0)).alias("accuracy_std"), per.alias("accuracy_per_seed"), F.avg("mean_rollouts").alias("mean_rollouts")
    )


def usage_totals(records: DataFrame) -> DataFrame:
    """How often each action type is on the best paths of all runs together."""
    return action_usage(records, by=[])


def tagged_runs(runs: dict[int, DataFrame]) -> DataFrame:
    """The records of several runs, each with the seed of its run."""
    parts = [df.withColumn("seed", F.lit(seed)) for seed, df in sorted(runs.items())]
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    return whole


def with_gold_hints(questions: DataFrame, queries: DataFrame) -> DataFrame:
    """Adds the gold answers of the query that asks the same question, of several the last (by query_id); for smoke tests only."""
    known = queries.groupBy("question").agg(F.max_by("gold_answers", "query_id").alias("hint"))
    return questions.join(known, "question", "left")


def inspected(trajectories: DataFrame, query_id: str | None = None, action_type: str | None = None, first: int | None = None, order: list[str] | None = None) -> DataFrame:
    """Nested trajectories of a query, with a step of a type, the first few in order: any of the three."""
    if query_id is not None:
        trajectories = trajectories.where(F.col("query_id") == query_id)
    if action_type is not None:
        trajectories = trajectories.where(F.exists("steps", lambda s: s["action_type"] == action_type))
    return trajectories if first is None else trajectories.orderBy(*(order or ["traj_id"])).limit(first)


def usage_counts(trajectories: DataFrame) -> DataFrame:
    return trajectories.select(F.explode("steps").alias("s")).groupBy(F.col("s.action_type").alias("action_type")).agg(F.count("*").alias("n"))


def sampled(df: DataFrame, key: str, n: int, seed: int = 0) -> DataFrame:
    """n rows in the order of a seeded hash of their key: the same sample wherever it is drawn."""
    return df.orderBy(seeded_hash(F.lit(seed), F.col(key)), key).limit(n)


def multiset_overlap(a: Column, b: Column) -> Column:
    """Number of common items of two arrays, each as often as both have it."""
    count = lambda xs, t: F.size(F.filter(xs, lambda x: x == t))
    return F.aggregate(F.array_intersect(a, b), F.lit(0), lambda n, t: n + F.least(count(a, t), count(b, t)))
