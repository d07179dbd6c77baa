"""Reward, support and search-score queries over documents, labels, events and line items."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scores as S
from .common import first_and_rest, sql_content, sql_first_and_rest, table


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """a: a text's first line, b: all after it, c: its source and language."""
    first, rest = first_and_rest()
    return table(spark, sf_dir, "documents").select("doc_id", "n_chars", first.alias("a"), rest.alias("b"), F.concat_ws(" ", "source", "lang").alias("c"))


def lexical_grounding(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("doc_id") % 5 == 0, "answer").when(F.col("doc_id") % 5 == 1, "image_search").otherwise("text_search")
    images = F.when(F.col("doc_id") % 4 == 0, F.array(F.lit("x.jpg"))).otherwise(F.array(F.lit("")))
    g = S.grounding(kind, F.col("a"), F.array("b", "c"), images)
    return _lines(spark, sf_dir).select("doc_id", F.round(g, 6).alias("grounding"))


def state_groundings(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = lambda kind, title, text: F.struct(F.lit(kind).alias("source_action"), title.alias("title"), F.col(text).alias("text"), F.lit(None).cast("string").alias("image_path"))
    evidence = F.array(one("text_search", F.lit(""), "b"), one("image_search", F.lit("x"), "a"), one("text_search", F.col("a"), "c"))
    kind = F.when(F.col("doc_id") % 4 == 0, "answer").otherwise("text_search")
    return _lines(spark, sf_dir).select("doc_id", F.round(S.state_grounding(kind, F.col("a"), evidence), 6).alias("grounding"))


def answer_supports(spark: SparkSession, sf_dir: str) -> DataFrame:
    answer = F.when(F.col("doc_id") % 6 == 0, " Yes ").when(F.col("doc_id") % 6 == 1, F.concat(F.col("a"), F.lit(" 42"))).when(F.col("doc_id") % 6 == 2, F.lit("the of")).otherwise(F.col("a"))
    evidence = F.when(F.col("doc_id") % 7 == 0, F.array(F.lit(""))).otherwise(F.array("b", F.concat("c", F.lit(" 42"))))
    r = _lines(spark, sf_dir).select("doc_id", S.answer_support(answer, evidence).alias("r"))
    return r.select("doc_id", F.col("r.label").alias("label"), F.round("r.support", 6).alias("support"))


def judged_supports(spark: SparkSession, sf_dir: str) -> DataFrame:
    replies = ["supported.", "Unsupported", "PARTIAL support", "not required", "NOT_REQUIRED: unsupported", "", "no idea"]
    reply = F.element_at(F.array(*map(F.lit, replies)), (F.col("doc_id") % 7 + 1).cast("int"))
    r = table(spark, sf_dir, "documents").select("doc_id", S.judged_support(reply).alias("r"))
    return r.select("doc_id", F.col("r.label").alias("label"), F.col("r.support").alias("support"))


def overlap_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    answer = F.when(F.col("doc_id") % 9 == 0, F.lit("")).otherwise(F.col("b"))
    return _lines(spark, sf_dir).select("doc_id", F.round(S.overlap_score(F.array("a", "c"), answer), 6).alias("score"))


def fused_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    local = F.when(F.col("doc_id") % 4 != 0, S.band((F.col("n_chars") % 1000) / F.lit(1000.0), *S.TEXT_BAND))
    outcome = F.col("quality").cast("double")
    support = F.when(F.col("doc_id") % 3 != 0, (F.col("n_chars") % 11) / F.lit(10.0))
    kind = F.when(F.col("doc_id") % 2 == 0, "answer").otherwise("text_search")
    vector = S.vector_grounding(kind, F.array((F.col("n_chars") % 97) / F.lit(97.0)), F.when(F.col("doc_id") % 3 == 0, F.array((F.col("n_chars") % 31) / F.lit(100.0), F.lit(-0.2))))
    return rows.select(
        "doc_id",
        F.round(S.fuse(local, outcome), 6).alias("step_score"),
        F.round(S.fuse_answer(outcome, support), 6).alias("answer_score"),
        S.unsupported_correct(outcome, support).alias("unsupported_correct"),
        S.score_source(kind, local, support).alias("source"),
        F.round(vector, 6).alias("vector_grounding"),
    )


def synthetic_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores that follow labels as closely as asked: noise is a hash of the id."""
    rows = table(spark, sf_dir, "labels")
    return rows.select("doc_id", F.round(S.synthetic_score(F.col("quality").cast("double"), S.uniform(F.lit(0), F.col("doc_id")), 0.4), 9).alias("score"))


def uct_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Children of a user's node are event types; the child with the highest bound, ties to the higher prior, then by name."""
    kids = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count_if(F.col("value") > 0.5).alias("visits"), F.round(F.sum(F.when(F.col("value") > 0.5, F.col("value") % 1).otherwise(0.0)), 6).alias("total"))
    around = Window.partitionBy("user_id")
    q = S.q_value(F.col("total"), F.col("visits"), F.lit(0.25))
    scored = kids.select("user_id", "event_type", F.round(S.uct(q, F.col("visits"), F.sum("visits").over(around)), 6).alias("uct"))
    best = Window.partitionBy("user_id").orderBy(F.col("uct").desc(), "event_type")
    return scored.withColumn("n", F.row_number().over(best)).where("n = 1").drop("n")


def crop_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = table(spark, sf_dir, "lineitem")  # noqa: E741
    width, height = (F.col("l_quantity") * 7).cast("int"), (F.col("l_quantity") * 5).cast("int")
    shares = F.array(F.col("l_discount") * 8, F.col("l_tax") * 10, F.lit(0.95), F.col("l_discount"))
    pixels = F.array(F.col("l_linenumber") * 10.5 - 20, F.lit(3.5), F.col("l_quantity") * 6.5, F.lit(1e9))
    region = F.when(F.col("l_linenumber") % 3 == 0, shares).when(F.col("l_linenumber") % 3 == 1, pixels).otherwise(F.array(F.lit(float("nan")), F.lit(0.1), F.lit(0.5), F.lit(0.5)))
    box = S.crop_box(width, height, region)
    return l.select("l_orderkey", "l_linenumber", F.array_join(F.transform(box, lambda v: v.cast("string")), ",").alias("box"))


QUERIES = {f.__name__: f for f in (lexical_grounding, state_groundings, answer_supports, judged_supports, overlap_scores, fused_scores, synthetic_scores, uct_selection, crop_boxes)}

_L = f"WITH t AS (SELECT doc_id, n_chars, {sql_first_and_rest('a', 'b')}, concat_ws(' ', source, lang) AS c FROM documents)"
ORACLE_SQL = {
    "synthetic_scores": """WITH n AS (SELECT doc_id, quality::DOUBLE AS q, ('0x' || substr(md5('0:' || doc_id), 1, 8))::BIGINT / 4294967296e0 AS u, 0.4e0 / sqrt(3e0 * (1e0 - 0.4e0 * 0.4e0)) AS r FROM labels)
SELECT doc_id, round(coalesce(greatest(0e0, least(1e0, r / (1e0 + r) * q + (1e0 - r / (1e0 + r)) * u)), u), 9) AS score FROM n""",
    "lexical_grounding": _L
    + f""", w AS (SELECT doc_id, b, c, {sql_content("a")} AS qa, {sql_content("b")} AS wb, {sql_content("c")} AS wc FROM t),
s AS (SELECT doc_id, CASE WHEN len(qa) = 0 OR (b = '' AND c = '') THEN 0e0 ELSE greatest(len(list_intersect(qa, wb)), len(list_intersect(qa, wc)))::DOUBLE / len(qa) END AS r FROM w)
SELECT doc_id, CASE WHEN doc_id % 5 <> 0 THEN round(greatest(r, CASE WHEN doc_id % 4 = 0 THEN 0.5e0 ELSE 0e0 END), 6) END AS grounding FROM s""",
    "state_groundings": _L
    + f""", u AS (SELECT doc_id, b, c, a AS h, CASE WHEN a = '' THEN c ELSE a || ': ' || c END AS hc, a FROM t),
w AS (SELECT doc_id, b, hc, {sql_content("a")} AS qa, {sql_content("b")} AS wb, {sql_content("hc")} AS wc FROM u)
SELECT doc_id, CASE WHEN doc_id % 4 <> 0 THEN CASE WHEN len(qa) = 0 OR (b = '' AND hc = '') THEN 0e0 ELSE round(greatest(len(list_intersect(qa, wb)), len(list_intersect(qa, wc)))::DOUBLE / len(qa), 6) END END AS grounding FROM w""",
    "answer_supports": _L
    + f""", x AS (SELECT doc_id, CASE WHEN doc_id % 6 = 0 THEN ' Yes ' WHEN doc_id % 6 = 1 THEN a || ' 42' WHEN doc_id % 6 = 2 THEN 'the of' ELSE a END AS ans, b, c || ' 42' AS c FROM t),
y AS (SELECT doc_id, ans, {sql_content("ans")} AS m, list_concat({sql_content("b")}, {sql_content("c")}) AS h FROM x),
z AS (SELECT *, list_filter(m, lambda t: regexp_full_match(t, '\\d+(?:\\.\\d+)?')) AS nu, list_filter(m, lambda t: not regexp_full_match(t, '\\d+(?:\\.\\d+)?')) AS wo FROM y),
v AS (SELECT *, CASE WHEN len(wo) = 0 THEN 1e0 ELSE len(list_intersect(wo, h))::DOUBLE / len(wo) END AS sw, CASE WHEN len(nu) = 0 THEN NULL ELSE len(list_intersect(nu, h))::DOUBLE / len(nu) END AS sn FROM z)
SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'no_evidence' WHEN lower(trim(ans)) IN ('yes','no','none','true','false','unknown','n/a') OR len(m) = 0 THEN 'unverifiable' ELSE 'lexical' END AS label,
 CASE WHEN doc_id % 7 = 0 THEN 0e0 WHEN lower(trim(ans)) IN ('yes','no','none','true','false','unknown','n/a') OR len(m) = 0 THEN NULL ELSE round(least(sw, coalesce(sn, sw)), 6) END AS support FROM v""",
    "judged_supports": """SELECT doc_id, ['supported','unsupported','partial','not_required','not_required','unparseable','unparseable'][doc_id % 7 + 1] AS label,
 [1e0, 0e0, 0.5e0, NULL, NULL, NULL, NULL][doc_id % 7 + 1] AS support FROM documents""",
    "overlap_scores": _L
    + """, x AS (SELECT doc_id, lower(a || ' ' || c) AS o, list_filter(regexp_split_to_array(lower(CASE WHEN doc_id % 9 = 0 THEN '' ELSE b END), '\\s+'), lambda t: t <> '') AS w FROM t)
SELECT doc_id, CASE WHEN len(w) = 0 THEN 0e0 ELSE round(least(1e0, CASE WHEN trim(o) <> '' THEN 0.2e0 ELSE 0e0 END + 0.8e0 * len(list_filter(w, lambda t: contains(o, t)))::DOUBLE / len(w)), 6) END AS score FROM x""",
    "fused_scores": """WITH r AS (SELECT doc_id, CASE WHEN doc_id % 4 <> 0 THEN least(1e0, greatest(0e0, ((n_chars % 1000) / 1000e0 - 0.5e0) / 0.4e0)) END AS lo, quality::DOUBLE AS o,
 CASE WHEN doc_id % 3 <> 0 THEN (n_chars % 11) / 10e0 END AS s, CASE WHEN doc_id % 2 = 0 THEN 'answer' ELSE 'text_search' END AS k, n_chars FROM documents JOIN labels USING (doc_id))
SELECT doc_id, round(coalesce(0.5e0 * lo + 0.5e0 * o, o), 6) AS step_score, round(coalesce(o * (0.3e0 + 0.7e0 * s), o), 6) AS answer_score, coalesce(s <= 0.3e0 AND o >= 0.5e0, false) AS unsupported_correct,
 CASE WHEN k = 'answer' AND s IS NOT NULL THEN 'answer_support' WHEN k = 'answer' OR lo IS NULL THEN 'outcome_only' ELSE 'local_plus_outcome' END AS source,
 CASE WHEN k <> 'answer' THEN round(greatest(least(1e0, greatest(0e0, ((n_chars % 97) / 97e0 - 0.5e0) / 0.4e0)), CASE WHEN doc_id % 3 = 0 THEN least(1e0, greatest(0e0, ((n_chars % 31) / 100e0 - 0.15e0) / 0.17e0)) ELSE 0e0 END), 6) END AS vector_grounding FROM r""",
    "uct_selection": """WITH k AS (SELECT user_id, event_type, count(*) FILTER (value > 0.5e0) AS visits, round(sum(CASE WHEN value > 0.5e0 THEN value % 1 ELSE 0e0 END), 6) AS total FROM events GROUP BY 1, 2),
u AS (SELECT *, CASE WHEN visits > 0 THEN total / visits ELSE 0.25e0 END AS q, sum(visits) OVER (PARTITION BY user_id) AS pv FROM k),
s AS (SELECT user_id, event_type, round(CASE WHEN visits = 0 THEN 1e6 + q ELSE q + sqrt(ln(greatest(pv, 1)::DOUBLE) / visits) END, 6) AS uct FROM u)
SELECT user_id, event_type, uct FROM s QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY uct DESC, event_type) = 1""",
    "crop_boxes": """WITH r AS (SELECT l_orderkey, l_linenumber, (l_quantity * 7)::INT AS w, (l_quantity * 5)::INT AS h, l_linenumber % 3 AS k,
 CASE WHEN l_linenumber % 3 = 0 THEN [l_discount * 8, l_tax * 10, 0.95e0, l_discount] ELSE [l_linenumber * 10.5e0 - 20, 3.5e0, l_quantity * 6.5e0, 1e9] END AS r FROM lineitem),
a AS (SELECT *, list_max(list_transform(r, lambda v: abs(v))) <= 1 AS share FROM r),
e AS (SELECT *, CASE WHEN share THEN r[1] * w ELSE r[1] END AS x1, CASE WHEN share THEN r[2] * h ELSE r[2] END AS y1, CASE WHEN share THEN r[3] * w ELSE r[3] END AS x2, CASE WHEN share THEN r[4] * h ELSE r[4] END AS y2 FROM a),
b AS (SELECT l_orderkey, l_linenumber, k, w, h, round_even(greatest(0e0, least(w::DOUBLE, least(x1, x2))), 0)::BIGINT AS l, round_even(greatest(0e0, least(w::DOUBLE, greatest(x1, x2))), 0)::BIGINT AS rr,
 round_even(greatest(0e0, least(h::DOUBLE, least(y1, y2))), 0)::BIGINT AS t, round_even(greatest(0e0, least(h::DOUBLE, greatest(y1, y2))), 0)::BIGINT AS bb FROM e)
SELECT l_orderkey, l_linenumber, CASE WHEN k <> 2 AND w > 0 AND h > 0 AND rr - l >= 1 AND bb - t >= 1 THEN l || ',' || t || ',' || rr || ',' || bb END AS box FROM b""",
}
