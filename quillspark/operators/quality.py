"""Rationale checks, dataset filters, splits and release validation, as Column expressions and aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import in_validation, let

# Phrases that give an outcome away.
LEAKS = ["gold answer", "ground truth", "ground-truth", "correct answer", "标准答案", "参考答案", "正确答案"]
# Marks of failures that another attempt may mend.
RETRY_MARKS = [
    "generation exception:", "connection error", "timed out", "timeout",
    "insufficient balance", "error code: 402", "rate limit", "server disconnected",
]
# Golds that are too short or too common to be given away.
COMMON_GOLDS = ["yes", "no", "none", "true", "false"]
ACTIONS = ["text_search", "image_search", "answer"]
SHORTEST, LONGEST = 30, 150
_VERDICT = r"(?i)VERDICT:\s*(good|mixed|poor)\b"
TOLERANCE = 1e-6


def verdict(text: Column) -> Column:
    """The last verdict a text gives, lower-cased; null without one."""
    return F.lower(F.try_element_at(F.regexp_extract_all(text, F.lit(_VERDICT), F.lit(1)), F.lit(-1)))


def body(text: Column) -> Column:
    """The text without its last verdict, trimmed."""
    cut = F.regexp_replace(text, r"(?is)^(.*)VERDICT:\s*(?:good|mixed|poor)\b", "$1")
    return F.regexp_replace(cut, r"(?U)^\s+|\s+$", "")


def word_count(text: Column) -> Column:
    return F.size(F.filter(F.split(text, r"(?U)\s+"), lambda w: w != ""))


def visible_ids(before: Column, seen: Column) -> Column:
    return F.array_distinct(F.concat(F.transform(before, lambda e: e["evidence_id"]), F.transform(seen, lambda e: e["evidence_id"])))


def cited_ids(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"\be\d+\b"), F.lit(0))


def gold_strings(golds: Column) -> Column:
    """Comparable golds: lower case, of three characters or more, none of the common ones; of a mapping its central value."""
    value = lambda g: F.coalesce(F.get_json_object(F.replace(g, F.lit("'"), F.lit('"')), "$.wikidata"), g)
    return F.filter(F.transform(golds, lambda g: F.lower(F.trim(F.when(g.startswith("{"), value(g)).otherwise(g)))), lambda g: (F.length(g) >= 3) & ~g.isin(COMMON_GOLDS))


def contradiction(found: Column, score: Column) -> Column:
    """The rule by which a verdict contradicts a score, or null."""
    shown = F.format_number(score, 2)
    return F.when((score >= 0.6) & (found == "poor"), F.concat(F.lit("verdict 'poor' contradicts score "), shown)).when((score <= 0.4) & (found == "good"), F.concat(F.lit("verdict 'good' contradicts score "), shown))


def rationale_faults(text: Column, action_type: Column, action_input: Column, question: Column, before: Column, seen: Column, golds: Column, score: Column) -> Column:
    """The rules a rationale breaks, in their order; empty if none.

    Length, naming the action, citing visible evidence, not giving the outcome away by phrase or by a gold that the
    evidence doesn't show, and a verdict that fits the score. Where nothing is visible, no citation can be valid.
    """

    def rules(b: Column) -> Column:
        low = F.lower(b)
        n = word_count(b)
        shown = F.concat(F.transform(before, lambda e: F.concat_ws(" ", e["text"], e["title"])), F.transform(seen, lambda e: F.concat_ws(" ", e["text"], e["title"])), F.array(question, action_input))
        visible = F.lower(F.array_join(shown, " "))
        words = F.regexp_extract_all(low, F.lit("[a-z0-9']+"), F.lit(0))
        said = lambda g: F.when(F.instr(g, " ") > 0, F.contains(low, g)).otherwise(F.array_contains(words, g))
        leak = F.try_element_at(F.filter(F.array(*map(F.lit, LEAKS)), lambda p: F.contains(low, p)), F.lit(1))
        found = verdict(text)
        return F.array_compact(
            F.array(
                F.when(~n.between(SHORTEST, LONGEST), F.concat(F.lit("length "), n.cast("string"), F.lit(f" outside [{SHORTEST}, {LONGEST}]"))),
                F.when(~F.contains(b, action_type), F.lit("does not mention the action type")),
                F.when(~F.arrays_overlap(cited_ids(b), visible_ids(before, seen)), F.lit("cites no visible evidence")),
                F.when(leak.isNotNull(), F.concat(F.lit("leaks the outcome: "), leak)),
                F.when(F.exists(gold_strings(golds), lambda g: said(g) & ~F.contains(visible, g)), F.lit("mentions a gold answer that no evidence shows")),
                F.when(found.isNull(), F.lit("missing verdict")).otherwise(contradiction(found, score)),
            )
        )

    return let(body(text), rules)


def template_rationale(action_type: Column, action_input: Column, before: Column, seen: Column, score: Column) -> Column:
    """A deterministic rationale that keeps the rules: stands in for a model."""
    first = F.coalesce(F.array_min(visible_ids(before, seen)), F.lit("none"))
    said = F.when(score >= 0.6, "good").when(score <= 0.4, "poor").otherwise("mixed")
    return F.concat(
        F.lit("The value "), F.format_number(score, 2), F.lit(" for this "), action_type, F.lit(" rests on two observations: what it found under ["), first,
        F.lit("] shares its main words with the question that was asked, and the share of later paths through this point that ended well agrees with the estimate. Its input was: "),
        action_input, F.lit(". Taken together these make the number plausible.\nVERDICT: "), said,
    )


def retryable(passed: Column, reasons: Column, rationale: Column) -> Column:
    """Failures worth another attempt: marks of transport trouble among the reasons, or no text at all."""
    told = F.lower(F.array_join(F.coalesce(reasons, F.lit([]).cast("array<string>")), "\n"))
    trouble = F.exists(F.array(*map(F.lit, RETRY_MARKS)), lambda m: F.contains(told, m))
    blank = F.regexp_replace(F.coalesce(rationale, F.lit("")), r"(?U)\s+", "") == ""
    return ~F.coalesce(passed, F.lit(False)) & (trouble | blank)


def remaining(todo: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """What an earlier run hasn't done yet."""
    return todo.join(done.select(key).distinct(), key, "left_anti")


def filtered(samples: DataFrame, least: int = 2, most: int = 8, gap: float = 0.7, fraction: float = 0.05) -> DataFrame:
    """Adds drop_reason (the first rule a sample fails; null: kept) and split (train or val; null: dropped).

    Rules in order: its trajectory has fewer than ``least`` or more than ``most`` samples; grounding and outcome differ by
    more than ``gap``; the rationale failed. Samples need traj_id, query_id, local_grounding, outcome_credit,
    rationale_qc_pass.
    """
    n = F.count("*").over(Window.partitionBy("traj_id"))
    far = F.coalesce(F.abs(F.col("local_grounding") - F.col("outcome_credit")) > gap, F.lit(False))
    reason = F.when(~F.col("_n").between(least, most), "traj_length").when(far, "grounding_outcome_gap").when(~F.coalesce("rationale_qc_pass", F.lit(False)), "rationale_qc")
    split = F.when(F.col("drop_reason").isNull(), F.when(in_validation(F.col("query_id"), fraction), "val").otherwise("train"))
    return samples.withColumn("_n", n).withColumn("drop_reason", reason).drop("_n").withColumn("split", split)


def filter_statistics(marked: DataFrame) -> DataFrame:
    """One row of counts and means over what ``filtered`` marked."""
    kept = F.col("split").isNotNull()
    counts = [F.count_if(F.col("drop_reason") == r).alias(f"dropped_{r}") for r in ("traj_length", "grounding_outcome_gap", "rationale_qc")]
    kinds = [F.count_if(kept & (F.col("action_type") == a)).alias(f"kept_{a}") for a in ACTIONS]
    mean = lambda c: F.coalesce(F.avg(F.when(kept, F.col(c))), F.lit(0.0))
    return marked.agg(
        F.count("*").alias("input_samples"), F.countDistinct("traj_id").alias("input_trajectories"), *counts, F.count_if(kept).alias("kept"),
        F.count_if(F.col("split") == "train").alias("train"), F.count_if(F.col("split") == "val").alias("val"), *kinds, mean("score").alias("mean_score"), mean("outcome_credit").alias("mean_outcome_credit"),
    )


def score_histogram(samples: DataFrame, column: str, bins: int = 10) -> DataFrame:
    """Counts in equal bins of 0..1, numbered from 1; 1.0 belongs to the last."""
    place = F.least(F.lit(bins), F.floor(F.col(column) * bins).cast("int") + 1)
    return samples.where(F.col(column).isNotNull()).groupBy(place.alias("bin")).agg(F.count("*").alias("n"))


def _unit(c: Column) -> Column:
    return c.between(-TOLERANCE, 1 + TOLERANCE)


def violations(samples: DataFrame, gap: float = 0.7, provenance: bool = False) -> DataFrame:
    """Adds ``violations``: names of the release rules that a sample breaks, in their order.

    Samples are flat: sample_id, traj_id, query_id, question, action_type, action_input, local_grounding,
    outcome_credit, n_traj_through, alpha, score, rationale, rationale_verdict, rationale_qc_pass, answer_support,
    support_floor, image_path, evidence_before, evidence; gen_provenance where required.
    """
    c = F.col
    answer = c("action_type") == "answer"
    missing = [F.when(c(x).isNull(), F.lit(f"missing {x}")) for x in ("sample_id", "traj_id", "query_id", "question", "action_type", "outcome_credit", "n_traj_through", "alpha", "score", "rationale", "rationale_qc_pass")]
    local, outcome, support = c("local_grounding"), c("outcome_credit"), c("answer_support")
    expected = F.when(answer, F.coalesce(outcome * (c("support_floor") + (1 - c("support_floor")) * support), outcome)).otherwise(F.coalesce(c("alpha") * local + (1 - c("alpha")) * outcome, outcome))
    words = word_count(c("rationale"))
    visible = visible_ids(c("evidence_before"), c("evidence"))
    path = c("image_path")
    told = c("rationale_qc_pass")
    rules = [
        (~c("action_type").isin(ACTIONS), "unknown action type"),
        (F.coalesce(c("action_input"), F.lit("")) == "", "empty action input"),
        (~_unit(outcome), "outcome_credit out of range"),
        (~_unit(c("alpha")), "alpha out of range"),
        (~_unit(c("score")), "score out of range"),
        (answer & local.isNotNull(), "answer with local grounding"),
        (~answer & local.isNull(), "search without local grounding"),
        (~answer & ~_unit(local), "local_grounding out of range"),
        (~_unit(support), "answer_support out of range"),
        (~answer & support.isNotNull(), "search with answer support"),
        (F.abs(c("score") - expected) > 1e-4, "score is not the fusion"),
        (c("n_traj_through") < 1, "no trajectory through"),
        (F.abs(local - outcome) > gap + TOLERANCE, "grounding and outcome too far apart"),
        (~c("sample_id").rlike(r"#s\d+$"), "sample_id without step"),
        (~told, "rationale failed its checks"),
        (told & ~words.between(SHORTEST, LONGEST), "rationale length"),
        (told & ~F.contains(c("rationale"), c("action_type")), "rationale without action type"),
        (told & (F.size(visible) > 0) & ~F.arrays_overlap(cited_ids(c("rationale")), visible), "rationale cites nothing visible"),
        (told & contradiction(c("rationale_verdict"), c("score")).isNotNull(), "verdict contradicts score"),
        (path.startswith("/") | path.startswith("~") | (F.substring(path, 2, 1) == ":"), "absolute image path"),
    ]
    if provenance:
        rules.append((c("gen_provenance").isNull() if "gen_provenance" in samples.columns else F.lit(True), "missing gen_provenance"))
    gaps = F.array_compact(F.array(*missing))
    broken = F.array_compact(F.array(*[F.when(F.coalesce(when, F.lit(False)), F.lit(name)) for when, name in rules]))
    return samples.withColumn("violations", F.when(F.size(gaps) > 0, gaps).otherwise(broken))


def table_violations(samples: DataFrame, most: int = 8) -> DataFrame:
    """violation, key: sample ids that appear again (once for each further row), and trajectories of too many samples."""
    again = samples.groupBy("sample_id").agg((F.count("*") - 1).alias("n")).where("n > 0").select(F.lit("duplicate sample_id").alias("violation"), F.col("sample_id").alias("key"), F.col("n"))
    long = samples.groupBy("traj_id").agg(F.count("*").alias("c")).where(F.col("c") > most).select(F.lit("too many samples").alias("violation"), F.col("traj_id").alias("key"), F.lit(1).cast("long").alias("n"))
    return again.unionByName(long)


def violation_summary(samples: DataFrame, most: int = 8, **options) -> DataFrame:
    """Counts of violations by kind, of rows and of the table."""
    # each sample tells its violations, its id and its trajectory: one pass does for rows and table
    one = lambda name, key: F.struct(name.alias("violation"), key.cast("string").alias("key"))
    again, long = F.lit("duplicate sample_id"), F.lit("too many samples")
    told = F.concat(F.transform("violations", lambda v: one(v, F.lit(None))), F.array(one(again, F.col("sample_id")), one(long, F.col("traj_id"))))
    counts = violations(samples, **options).select(F.explode(told).alias("x")).groupBy("x.violation", "x.key").agg(F.count("*").alias("n"))
    n = F.when(F.col("violation") == again, F.col("n") - 1).when(F.col("violation") == long, (F.col("n") > most).cast("long")).otherwise(F.col("n"))
    return counts.select("violation", n.alias("n")).where("n > 0").groupBy("violation").agg(F.sum("n").alias("n"))


def sample_statistics(samples: DataFrame, least: int = 2) -> DataFrame:
    """One row: samples, trajectories, how many of these have fewer than ``least`` samples (which is no violation), and the
    number of samples by action type, as a map."""
    per = samples.groupBy("traj_id", "action_type").agg(F.count("*").alias("n"))
    # both histograms in one table, of which a row per type and one for the trajectories are left
    long = per.groupBy("traj_id").agg(F.sum("n").alias("n")).agg(F.lit(None).cast("string").alias("action_type"), F.sum("n").alias("n"), F.count("*").alias("t"), F.count_if(F.col("n") < least).alias("o"))
    types = per.groupBy("action_type").agg(F.sum("n").alias("n")).select("action_type", "n", F.lit(0).cast("long").alias("t"), F.lit(0).cast("long").alias("o")).where("action_type is not null")
    entries = F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("action_type").isNotNull(), F.struct("action_type", "n")))))
    total = F.coalesce(F.sum(F.when(F.col("action_type").isNull(), F.col("n"))), F.lit(0))
    return long.unionByName(types).agg(total.alias("samples"), F.sum("t").alias("trajectories"), F.sum("o").alias("orphans"), entries.alias("types"))


def split_leaks(splits: dict[str, DataFrame], key: str = "query_id") -> DataFrame:
    """Keys that more than one split holds, with the names of the splits."""
    parts = [df.select(F.col(key).alias("key"), F.lit(name).alias("split")) for name, df in splits.items()]
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    return whole.groupBy("key").agg(F.array_sort(F.collect_set("split")).alias("splits")).where(F.size("splits") > 1)
