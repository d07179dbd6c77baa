"""Step-labelling and quality queries: conversations are trajectories, their turns the steps; sessions of events as well."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import let
from ..operators import labels as L
from ..operators import quality as Q
from .common import sql_content, table


def conversation_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    conv = Window.partitionBy("conv_id")
    t = table(spark, sf_dir, "conversations").withColumn("i", F.row_number().over(conv.orderBy("turn", "role", "text")) - 1).withColumn("m", F.max("i").over(conv))
    kind = F.when(F.col("i") == F.col("m"), "answer").when(F.col("i") % 3 == 1, "image_search").otherwise("text_search")
    image = F.when(F.col("action_type") == "image_search", F.concat(F.lit("img/"), F.col("conv_id").cast("string"), F.lit(".jpg")))
    one = F.struct(F.concat(F.lit("e"), F.col("step_index").cast("string")).alias("evidence_id"), F.col("role").alias("title"), F.col("text"), image.alias("image_path"))
    question = F.first("text").over(conv.orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    rows = t.select("conv_id", "text", "role", F.col("i").alias("step_index"), kind.alias("action_type"), question.alias("question"))
    evidence = F.when(F.col("action_type") != "answer", F.array(one)).otherwise(F.array().cast(f"array<struct<evidence_id:string,title:string,text:string,image_path:string>>"))
    return rows.select(
        F.concat(F.lit("c"), F.col("conv_id").cast("string")).alias("traj_id"),
        F.concat(F.lit("q"), (F.col("conv_id") % 20).cast("string")).alias("query_id"),
        "question", "step_index", "action_type", F.col("text").alias("action_input"),
        (F.col("conv_id") % 3 > 0).cast("double").alias("outcome"), evidence.alias("evidence"), "conv_id",
    )


def event_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's day is a trajectory of the day's query; it ends well if it holds a purchase."""
    day = F.date_format("ts", "yyyy-MM-dd")
    traj = Window.partitionBy("query_id", "user_id")
    e = table(spark, sf_dir, "events").select(day.alias("query_id"), "user_id", "ts", "event_id", F.col("event_type").alias("action_type"))
    return e.select(
        "query_id",
        F.concat(F.col("user_id").cast("string"), F.lit("@"), "query_id").alias("traj_id"),
        (F.row_number().over(traj.orderBy("ts", "event_id")) - 1).alias("step_index"),
        "action_type",
        F.lit("").alias("action_input"),
        F.max((F.col("action_type") == "purchase").cast("double")).over(traj).alias("outcome"),
    )


def prefix_credit(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = L.prefix_credit(event_steps(spark, sf_dir))
    return c.select("query_id", F.array_join(F.transform("prefix", lambda p: p["action_type"]), ">").alias("prefix"), F.round("credit", 6).alias("credit"), "n")


def state_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = L.with_snapshot(conversation_steps(spark, sf_dir))
    ids = F.array_join(F.transform("evidence_before", lambda e: e["evidence_id"]), ",")
    return s.select(L.sample_id(F.col("traj_id"), F.col("step_index")).alias("sample_id"), F.md5(F.array_join("actions_before", "\n").cast("binary")).alias("actions_md5"), ids.alias("evidence_ids"))


def labelled_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = L.label_steps(conversation_steps(spark, sf_dir))
    r = lambda c: F.round(c, 6).alias(c)
    return s.select("sample_id", "action_type", r("local_grounding"), r("outcome_credit"), "n_traj_through", r("answer_support"), "answer_support_label", r("score"), "unsupported_correct", "score_source")


def label_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = L.label_statistics(L.label_steps(conversation_steps(spark, sf_dir)))
    r = lambda c: F.round(c, 6).alias(c)
    told = F.array_join(F.transform(F.array_sort(F.map_entries("labels")), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",")
    return s.select("n", r("mean_local"), r("mean_credit"), r("mean_support"), r("mean_score"), "unsupported", told.alias("labels"))


def trajectory_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.trajectory_statistics(conversation_steps(spark, sf_dir)).select("n", F.round("mean_steps", 6).alias("mean_steps"), F.round("outcome_rate", 6).alias("outcome_rate"))


def trajectory_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.trajectory_text(conversation_steps(spark, sf_dir)).select("traj_id", F.md5(F.col("text").cast("binary")).alias("text_md5"))


def nested_trajectories(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = L.trajectory_rows(conversation_steps(spark, sf_dir))
    return t.select("traj_id", "outcome_em", F.array_join(F.transform("steps", lambda s: F.concat(s["action_type"], F.lit(":"), F.size(s["evidence"]).cast("string"))), ",").alias("path"))


def preference_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = L.pairs(L.label_steps(conversation_steps(spark, sf_dir)).withColumn("score", F.round("score", 6)))
    return p.select("query_id", F.md5(F.array_join("actions_before", "\n").cast("binary")).alias("state_md5"), F.col("chosen.sample_id").alias("chosen"), F.col("rejected.sample_id").alias("rejected"))


GOLD = "zanzibar"


def rationale_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled steps with rationales, seven of eight with a fault of their own kind."""
    s = L.label_steps(conversation_steps(spark, sf_dir)).withColumn("score", F.round("score", 6)).withColumn("gold_answers", F.array(F.lit(GOLD), F.lit("yes"), F.lit("{'wikidata': 12345.0, 'range': [1, 2]}")))
    s = s.withColumn("action_input", F.regexp_replace("action_input", r"\s+", " "))
    clean = Q.template_rationale(F.col("action_type"), F.col("action_input"), F.col("evidence_before"), F.col("evidence"), F.col("score"))
    kind = F.pmod(F.col("conv_id") + F.col("step_index"), F.lit(8))

    def spoilt(c: Column) -> Column:
        return (
            F.when(kind == 1, F.regexp_replace(c, r"\nVERDICT.*$", ""))
            .when(kind == 2, F.regexp_replace(F.regexp_replace(c, "VERDICT: good$", "VERDICT: x"), "VERDICT: (poor|x)$", F.when(F.col("score") >= 0.6, "verdict: POOR").otherwise("Verdict: Good")))
            .when(kind == 3, F.concat(F.lit("As the Ground Truth says: "), c))
            .when(kind == 4, F.concat(F.col("action_type"), F.lit(" saw [e0].\nVERDICT: mixed")))
            .when(kind == 5, F.regexp_replace(c, r"\[(e\d+|none)\]", "[e999]"))
            .when(kind == 6, F.replace(c, F.col("action_type"), F.lit("move")))
            .when(kind == 7, F.concat(F.lit(f"Surely {GOLD}. "), c))
            .otherwise(c)
        )

    text = let(clean, spoilt)
    s = s.withColumn("raw", text)
    faults = Q.rationale_faults(F.col("raw"), F.col("action_type"), F.col("action_input"), F.col("question"), F.col("evidence_before"), F.col("evidence"), F.col("gold_answers"), F.col("score"))
    return (
        s.withColumn("rationale_qc_reasons", faults)
        .withColumn("rationale_qc_pass", F.size("rationale_qc_reasons") == 0)
        .withColumn("rationale", Q.body(F.col("raw")))
        .withColumn("rationale_verdict", Q.verdict(F.col("raw")))
    )


def rationale_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = rationale_samples(spark, sf_dir)
    return s.select("sample_id", F.md5(F.col("rationale").cast("binary")).alias("rationale_md5"), "rationale_verdict", "rationale_qc_pass", F.array_join("rationale_qc_reasons", "; ").alias("reasons"))


def quality_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.filtered(rationale_samples(spark, sf_dir), 2, 8, 0.7, 0.2).select("sample_id", "drop_reason", "split")


def filter_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = Q.filter_statistics(Q.filtered(rationale_samples(spark, sf_dir), 2, 8, 0.7, 0.2))
    return s.withColumn("mean_score", F.round("mean_score", 5)).withColumn("mean_outcome_credit", F.round("mean_outcome_credit", 5))


def score_histograms(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = L.label_steps(conversation_steps(spark, sf_dir)).withColumn("score", F.round("score", 6)).withColumn("local_grounding", F.round("local_grounding", 6))
    one = lambda c: Q.score_histogram(s, c).withColumn("measure", F.lit(c))
    return one("score").unionByName(one("local_grounding")).unionByName(one("outcome_credit"))


def _released(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples as released, with faults planted in some of them."""
    s = rationale_samples(spark, sf_dir)
    k = F.pmod(F.col("conv_id") * 7 + F.col("step_index"), F.lit(23))
    when = lambda n, c, v: F.when(k == n, v).otherwise(F.col(c)).alias(c)
    none = F.lit(None).cast("double")
    sid = F.when(k == 9, F.concat("traj_id", F.lit("-x"))).when(k == 10, F.lit("c0#s0")).otherwise(F.col("sample_id"))
    return s.select(
        sid.alias("sample_id"), "traj_id", "query_id", when(1, "question", F.lit(None).cast("string")), when(2, "action_type", F.lit("dance")), when(3, "action_input", F.lit("")),
        F.when(k == 4, none).when(k == 5, F.lit(1.5)).otherwise(F.col("local_grounding")).alias("local_grounding"), "outcome_credit", when(6, "n_traj_through", F.lit(0).cast("long")), "alpha", "support_floor",
        F.when(k == 7, F.lit(1.2)).when(k == 8, F.col("score") / 2).otherwise(F.col("score")).alias("score"), "answer_support", "rationale", "rationale_verdict", "rationale_qc_pass", "evidence_before", "evidence",
        F.when(k == 11, "/data/x.jpg").when(k == 12, "C:\\x.jpg").when(k == 13, "~/x.jpg").otherwise("img/x.jpg").alias("image_path"),
    )


def release_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.violation_summary(_released(spark, sf_dir), most=5)


def split_purity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three overlapping splits by trajectory; query ids that more than one of them holds."""
    s = conversation_steps(spark, sf_dir)
    part = lambda cond: s.where(cond).select("query_id")
    leaks = Q.split_leaks({"train": part("conv_id % 20 < 15"), "val": part("conv_id % 20 between 14 and 17"), "test": part("conv_id % 20 >= 17")})
    return leaks.select(F.col("key").alias("query_id"), F.array_join("splits", ",").alias("splits"))


def retryable_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    marks = [None, "Connection Error: reset", "cites no visible evidence", "RATE LIMIT hit", "error code: 402", "request timed out"]
    reason = F.element_at(F.array(*[F.lit(m) for m in marks]), (F.col("doc_id") % 6 + 1).cast("int"))
    rationale = F.when(F.col("doc_id") % 7 == 0, "  \n").otherwise("text")
    d = table(spark, sf_dir, "documents").select("doc_id", Q.retryable(F.col("doc_id") % 5 == 0, F.array_compact(F.array(F.lit("x"), reason)), rationale).alias("again"))
    return d.where("again").select("doc_id")


def resumed_work(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose labels aren't there yet."""
    return Q.remaining(table(spark, sf_dir, "documents").select("doc_id", "source"), table(spark, sf_dir, "labels"), "doc_id")


QUERIES = {
    f.__name__: f
    for f in (
        prefix_credit, state_snapshots, labelled_steps, label_statistics, trajectory_statistics, trajectory_texts, nested_trajectories, preference_pairs, rationale_checks,
        quality_filter, filter_statistics, score_histograms, release_violations, split_purity, retryable_failures, resumed_work,
    )
}

_STEPS = """conv AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1 AS i, count(*) OVER (PARTITION BY conv_id) - 1 AS m FROM conversations),
steps AS (SELECT conv_id, 'c' || conv_id AS traj_id, 'q' || (conv_id % 20) AS query_id, first_value(text) OVER (PARTITION BY conv_id ORDER BY i) AS question, i::INT AS step_index, role, text,
 CASE WHEN i = m THEN 'answer' WHEN i % 3 = 1 THEN 'image_search' ELSE 'text_search' END AS action_type, text AS action_input, (conv_id % 3 > 0)::INT::DOUBLE AS outcome FROM conv)"""
_LABELS = f"""{_STEPS},
pre AS (SELECT *, string_agg(action_type || '(' || action_input || ')', chr(10)) OVER (PARTITION BY traj_id ORDER BY step_index) AS prefix FROM steps),
credit AS (SELECT query_id, prefix, avg(outcome) AS outcome_credit, count(*) AS n_traj_through FROM pre GROUP BY 1, 2),
tok AS (SELECT pre.*, outcome_credit, n_traj_through, {sql_content("question")} AS qt, {sql_content("text")} AS tt, {sql_content("action_input")} AS att FROM pre JOIN credit USING (query_id, prefix)),
loc AS (SELECT *, flatten(coalesce(list(tt) OVER (PARTITION BY traj_id ORDER BY step_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), [])) AS held,
 CASE WHEN action_type <> 'answer' THEN greatest(CASE WHEN len(qt) = 0 OR text = '' THEN 0e0 ELSE len(list_intersect(qt, tt))::DOUBLE / len(qt) END, CASE WHEN action_type = 'image_search' THEN 0.5e0 ELSE 0e0 END) END AS lg,
 list_filter(att, lambda t: regexp_full_match(t, '\\d+(?:\\.\\d+)?')) AS nu, list_filter(att, lambda t: not regexp_full_match(t, '\\d+(?:\\.\\d+)?')) AS wo FROM tok),
sup AS (SELECT *, CASE WHEN action_type <> 'answer' THEN NULL WHEN step_index = 0 THEN 'no_evidence' WHEN lower(trim(action_input)) IN ('yes','no','none','true','false','unknown','n/a') OR len(att) = 0 THEN 'unverifiable' ELSE 'lexical' END AS sl,
 least(CASE WHEN len(wo) = 0 THEN 1e0 ELSE len(list_intersect(wo, held))::DOUBLE / len(wo) END, CASE WHEN len(nu) = 0 THEN 1e0 ELSE len(list_intersect(nu, held))::DOUBLE / len(nu) END) AS lx FROM loc),
lab AS (SELECT *, traj_id || '#s' || step_index AS sample_id, CASE sl WHEN 'no_evidence' THEN 0e0 WHEN 'lexical' THEN lx END AS sp FROM sup),
sam AS (SELECT *, CASE WHEN action_type = 'answer' THEN coalesce(outcome_credit * (0.3e0 + 0.7e0 * sp), outcome_credit) ELSE 0.5e0 * lg + 0.5e0 * outcome_credit END AS score,
 action_type = 'answer' AND coalesce(sp <= 0.3e0 AND outcome_credit >= 0.5e0, false) AS unsupported_correct,
 CASE WHEN action_type = 'answer' AND sp IS NOT NULL THEN 'answer_support' WHEN action_type = 'answer' THEN 'outcome_only' ELSE 'local_plus_outcome' END AS score_source FROM lab)"""
_RATIONALES = f"""{_LABELS},
r0 AS (SELECT * REPLACE (round(score, 6) AS score, regexp_replace(action_input, '\\s+', ' ', 'g') AS action_input), (conv_id + step_index) % 8 AS k,
 list(CASE WHEN action_type <> 'answer' THEN 'e' || step_index END) OVER w AS ids, list(CASE WHEN action_type <> 'answer' THEN text || ' ' || role ELSE '' END) OVER w AS shown FROM sam WINDOW w AS (PARTITION BY traj_id ORDER BY step_index)),
r1 AS (SELECT *, list_filter(ids, lambda x: x IS NOT NULL) AS vis, lower(array_to_string(shown, ' ') || ' ' || question || ' ' || action_input) AS visible,
 'The value ' || format('{{:.2f}}', score) || ' for this ' || action_type || ' rests on two observations: what it found under [' || coalesce(list_min(list_filter(ids, lambda x: x IS NOT NULL)), 'none')
 || '] shares its main words with the question that was asked, and the share of later paths through this point that ended well agrees with the estimate. Its input was: ' || action_input
 || '. Taken together these make the number plausible.' AS clean, CASE WHEN score >= 0.6 THEN 'good' WHEN score <= 0.4 THEN 'poor' ELSE 'mixed' END AS said FROM r0),
r2 AS (SELECT *, CASE k WHEN 3 THEN 'As the Ground Truth says: ' || clean WHEN 4 THEN CASE WHEN true THEN action_type || ' saw [e0].' END WHEN 5 THEN regexp_replace(clean, '\\[(e\\d+|none)\\]', '[e999]') WHEN 6 THEN replace(clean, action_type, 'move')
 WHEN 7 THEN 'Surely {GOLD}. ' || clean ELSE clean END AS body, CASE WHEN k = 1 THEN NULL WHEN k = 4 THEN 'mixed' WHEN k = 2 AND said <> 'mixed' THEN CASE WHEN score >= 0.6 THEN 'poor' ELSE 'good' END ELSE said END AS verdict FROM r1),
r3 AS (SELECT *, len(list_filter(regexp_split_to_array(body, '\\s+'), lambda x: x <> '')) AS n FROM r2),
rat AS (SELECT *, list_filter([CASE WHEN n < 30 OR n > 150 THEN 'length ' || n || ' outside [30, 150]' END, CASE WHEN NOT contains(body, action_type) THEN 'does not mention the action type' END,
 CASE WHEN NOT list_has_any(regexp_extract_all(body, '\\be\\d+\\b'), vis) THEN 'cites no visible evidence' END, CASE WHEN contains(lower(body), 'ground truth') THEN 'leaks the outcome: ground truth' END,
 CASE WHEN list_contains(regexp_extract_all(lower(body), '[a-z0-9'']+'), '{GOLD}') AND NOT contains(visible, '{GOLD}') THEN 'mentions a gold answer that no evidence shows' END,
 CASE WHEN verdict IS NULL THEN 'missing verdict' WHEN score >= 0.6 AND verdict = 'poor' THEN 'verdict ''poor'' contradicts score ' || format('{{:.2f}}', score) WHEN score <= 0.4 AND verdict = 'good' THEN 'verdict ''good'' contradicts score ' || format('{{:.2f}}', score) END],
 lambda x: x IS NOT NULL) AS reasons FROM r3),
fil AS (SELECT *, len(reasons) = 0 AS ok, CASE WHEN count(*) OVER (PARTITION BY traj_id) NOT BETWEEN 2 AND 8 THEN 'traj_length' WHEN coalesce(abs(lg - outcome_credit) > 0.7, false) THEN 'grounding_outcome_gap' WHEN len(reasons) > 0 THEN 'rationale_qc' END AS drop_reason, md5(query_id) AS h FROM rat),
spl AS (SELECT *, CASE WHEN drop_reason IS NULL THEN CASE WHEN ((((((('0x' || substr(h, 1, 8))::BIGINT % 10000) * 4294967296 + ('0x' || substr(h, 9, 8))::BIGINT) % 10000) * 4294967296 + ('0x' || substr(h, 17, 8))::BIGINT) % 10000) * 4294967296 + ('0x' || substr(h, 25, 8))::BIGINT) % 10000 < 2000 THEN 'val' ELSE 'train' END END AS split FROM fil)"""
ORACLE_SQL = {
    "prefix_credit": """WITH t AS (SELECT strftime(ts, '%Y-%m-%d') AS q, user_id, event_type, row_number() OVER w AS i, max((event_type = 'purchase')::INT::DOUBLE) OVER (PARTITION BY strftime(ts, '%Y-%m-%d'), user_id) AS o,
 string_agg(event_type, '>') OVER w AS p FROM events WINDOW w AS (PARTITION BY strftime(ts, '%Y-%m-%d'), user_id ORDER BY ts, event_id))
SELECT q AS query_id, p AS prefix, round(avg(o), 6) AS credit, count(*) AS n FROM t GROUP BY 1, 2""",
    "state_snapshots": f"""WITH {_STEPS} SELECT traj_id || '#s' || step_index AS sample_id, md5(coalesce(string_agg(action_type || '(' || action_input || ')', chr(10)) OVER b, '')) AS actions_md5,
 coalesce(string_agg('e' || step_index, ',') OVER b, '') AS evidence_ids FROM steps WINDOW b AS (PARTITION BY traj_id ORDER BY step_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""",
    "labelled_steps": f"""WITH {_LABELS} SELECT sample_id, action_type, round(lg, 6) AS local_grounding, round(outcome_credit, 6) AS outcome_credit, n_traj_through, round(sp, 6) AS answer_support, sl AS answer_support_label,
 round(score, 6) AS score, unsupported_correct, score_source FROM sam""",
    "label_statistics": f"""WITH {_LABELS} SELECT count(*) AS n, round(avg(lg), 6) AS mean_local, round(avg(outcome_credit), 6) AS mean_credit, round(avg(sp), 6) AS mean_support, round(avg(score), 6) AS mean_score,
 count(*) FILTER (unsupported_correct) AS unsupported, (SELECT string_agg(sl || '=' || c, ',' ORDER BY sl) FROM (SELECT sl, count(*) AS c FROM sam WHERE sl IS NOT NULL GROUP BY 1)) AS labels FROM sam""",
    "trajectory_statistics": f"""WITH {_STEPS}, t AS (SELECT traj_id, count(*) AS s, max(outcome) AS o FROM steps GROUP BY 1) SELECT count(*) AS n, round(avg(s), 6) AS mean_steps, round(avg(o), 6) AS outcome_rate FROM t""",
    "trajectory_texts": f"""WITH {_STEPS} SELECT traj_id, md5('Question: ' || any_value(question) || chr(10) || string_agg('Step ' || (step_index + 1) || ' [' || action_type || ']: ' || action_input
 || CASE WHEN action_type <> 'answer' THEN chr(10) || '  Evidence: ' || role || ': ' || text ELSE '' END, chr(10) ORDER BY step_index) || chr(10) || 'Final answer: ' || coalesce(max(CASE WHEN action_type = 'answer' THEN action_input END), '')) AS text_md5 FROM steps GROUP BY 1""",
    "nested_trajectories": f"""WITH {_STEPS} SELECT traj_id, max(outcome) AS outcome_em, string_agg(action_type || ':' || CASE WHEN action_type = 'answer' THEN '0' ELSE '1' END, ',' ORDER BY step_index) AS path FROM steps GROUP BY 1""",
    "preference_pairs": f"""WITH {_LABELS}, s AS (SELECT query_id, coalesce(string_agg(action_type || '(' || action_input || ')', chr(10)) OVER (PARTITION BY traj_id ORDER BY step_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS before,
 round(score, 6) AS score, sample_id FROM sam),
g AS (SELECT query_id, before, max({{'s': score, 'i': sample_id}}) AS hi, min({{'s': score, 'i': sample_id}}) AS lo FROM s GROUP BY 1, 2)
SELECT query_id, md5(before) AS state_md5, hi.i AS chosen, lo.i AS rejected FROM g WHERE hi.s - lo.s >= 0.3""",
    "rationale_checks": f"WITH {_RATIONALES} SELECT sample_id, md5(body) AS rationale_md5, verdict AS rationale_verdict, ok AS rationale_qc_pass, array_to_string(reasons, '; ') AS reasons FROM spl",
    "quality_filter": f"WITH {_RATIONALES} SELECT sample_id, drop_reason, split FROM spl",
    "filter_statistics": f"""WITH {_RATIONALES} SELECT count(*) AS input_samples, count(DISTINCT traj_id) AS input_trajectories, count(*) FILTER (drop_reason = 'traj_length') AS dropped_traj_length,
 count(*) FILTER (drop_reason = 'grounding_outcome_gap') AS dropped_grounding_outcome_gap, count(*) FILTER (drop_reason = 'rationale_qc') AS dropped_rationale_qc, count(split) AS kept, count(*) FILTER (split = 'train') AS train, count(*) FILTER (split = 'val') AS val,
 count(*) FILTER (split IS NOT NULL AND action_type = 'text_search') AS kept_text_search, count(*) FILTER (split IS NOT NULL AND action_type = 'image_search') AS kept_image_search, count(*) FILTER (split IS NOT NULL AND action_type = 'answer') AS kept_answer,
 round(coalesce(avg(score) FILTER (split IS NOT NULL), 0), 5) AS mean_score, round(coalesce(avg(outcome_credit) FILTER (split IS NOT NULL), 0), 5) AS mean_outcome_credit FROM spl""",
    "score_histograms": f"""WITH {_LABELS}, u AS (SELECT 'score' AS measure, round(score, 6) AS v FROM sam UNION ALL SELECT 'local_grounding', round(lg, 6) FROM sam UNION ALL SELECT 'outcome_credit', outcome_credit FROM sam)
SELECT measure, least(10, floor(v * 10)::INT + 1) AS bin, count(*) AS n FROM u WHERE v IS NOT NULL GROUP BY 1, 2""",
    "release_violations": f"""WITH {_RATIONALES}, k AS (SELECT *, (conv_id * 7 + step_index) % 23 AS k2 FROM spl),
s AS (SELECT CASE k2 WHEN 9 THEN traj_id || '-x' WHEN 10 THEN 'c0#s0' ELSE sample_id END AS sid, traj_id, k2, k2 = 1 AS gone, CASE WHEN k2 = 2 THEN 'dance' ELSE action_type END AS a, CASE WHEN k2 = 3 THEN '' ELSE action_input END AS inp,
 CASE k2 WHEN 4 THEN NULL WHEN 5 THEN 1.5e0 ELSE lg END AS l, outcome_credit AS o, CASE WHEN k2 = 6 THEN 0 ELSE n_traj_through END AS nt, CASE k2 WHEN 7 THEN 1.2e0 WHEN 8 THEN score / 2 ELSE score END AS sc, sp, body, verdict, ok, vis, n FROM k),
e AS (SELECT *, CASE WHEN a = 'answer' THEN coalesce(o * (0.3e0 + 0.7e0 * sp), o) ELSE coalesce(0.5e0 * l + 0.5e0 * o, o) END AS x FROM s),
v AS (SELECT CASE WHEN gone THEN ['missing question'] ELSE list_filter([CASE WHEN a NOT IN ('text_search', 'image_search', 'answer') THEN 'unknown action type' END, CASE WHEN inp = '' THEN 'empty action input' END,
 CASE WHEN sc > 1.000001 OR sc < -0.000001 THEN 'score out of range' END, CASE WHEN a = 'answer' AND l IS NOT NULL THEN 'answer with local grounding' END, CASE WHEN a <> 'answer' AND l IS NULL THEN 'search without local grounding' END,
 CASE WHEN a <> 'answer' AND (l > 1.000001 OR l < -0.000001) THEN 'local_grounding out of range' END, CASE WHEN a <> 'answer' AND sp IS NOT NULL THEN 'search with answer support' END, CASE WHEN abs(sc - x) > 1e-4 THEN 'score is not the fusion' END,
 CASE WHEN nt < 1 THEN 'no trajectory through' END, CASE WHEN abs(l - o) > 0.700001 THEN 'grounding and outcome too far apart' END, CASE WHEN NOT regexp_matches(sid, '#s\\d+$') THEN 'sample_id without step' END,
 CASE WHEN NOT ok THEN 'rationale failed its checks' END, CASE WHEN ok AND (n < 30 OR n > 150) THEN 'rationale length' END, CASE WHEN ok AND NOT contains(body, a) THEN 'rationale without action type' END,
 CASE WHEN ok AND len(vis) > 0 AND NOT list_has_any(regexp_extract_all(body, '\\be\\d+\\b'), vis) THEN 'rationale cites nothing visible' END,
 CASE WHEN ok AND ((sc >= 0.6 AND verdict = 'poor') OR (sc <= 0.4 AND verdict = 'good')) THEN 'verdict contradicts score' END, CASE WHEN k2 IN (11, 12, 13) THEN 'absolute image path' END], lambda z: z IS NOT NULL) END AS vs FROM e),
u AS (SELECT unnest(vs) AS violation, 1 AS n FROM v UNION ALL SELECT 'duplicate sample_id', count(*) - 1 FROM s GROUP BY sid HAVING count(*) > 1 UNION ALL SELECT 'too many samples', 1 FROM s GROUP BY traj_id HAVING count(*) > 5)
SELECT violation, sum(n)::BIGINT AS n FROM u GROUP BY 1""",
    "split_purity": f"""WITH {_STEPS}, u AS (SELECT query_id, 'train' AS s FROM steps WHERE conv_id % 20 < 15 UNION SELECT query_id, 'val' FROM steps WHERE conv_id % 20 BETWEEN 14 AND 17 UNION SELECT query_id, 'test' FROM steps WHERE conv_id % 20 >= 17)
SELECT query_id, string_agg(s, ',' ORDER BY s) AS splits FROM u GROUP BY 1 HAVING count(*) > 1""",
    "retryable_failures": "SELECT doc_id FROM documents WHERE doc_id % 5 <> 0 AND (doc_id % 6 IN (1, 3, 4, 5) OR doc_id % 7 = 0)",
    "resumed_work": "SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
}
