"""Rationales with a bounded number of attempts: what fails its checks is written anew, told why."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import materialize
from . import quality as Q


def with_rationales(samples: DataFrame, generate: Callable[[DataFrame], DataFrame], attempts: int = 3) -> DataFrame:
    """Adds rationale, rationale_verdict, rationale_attempts, rationale_qc_pass, rationale_qc_reasons.

    generate(df) adds ``raw`` to samples that carry ``rationale_qc_reasons`` of the attempt before (empty at first). Each
    attempt is written before the next, so a model is asked once for each text.
    """
    todo = samples.withColumn("rationale_qc_reasons", F.array().cast("array<string>"))
    done: list[DataFrame] = []
    for n in range(1, max(1, attempts) + 1):
        told = generate(todo)
        faults = Q.rationale_faults(F.col("raw"), F.col("action_type"), F.col("action_input"), F.col("question"), F.col("evidence_before"), F.col("evidence"), F.col("gold_answers"), F.col("score"))
        out = materialize(told.withColumn("rationale_qc_reasons", faults).withColumn("rationale_qc_pass", F.size("rationale_qc_reasons") == 0).withColumn("rationale_attempts", F.lit(n)), "rationales")
        failed = out.where("not rationale_qc_pass")
        if n >= attempts or failed.isEmpty():
            done.append(out)
            break
        done.append(out.where("rationale_qc_pass"))
        todo = failed.select(*todo.columns)
    whole = done[0]
    for d in done[1:]:
        whole = whole.unionByName(d)
    return whole.withColumn("rationale", Q.body(F.col("raw"))).withColumn("rationale_verdict", Q.verdict(F.col("raw"))).drop("raw")
