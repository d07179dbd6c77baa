"""Text and answer-metric queries: parts of documents are predictions and golds, line items are numbers with ranges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import metrics as M
from ..functions import text as T
from .common import first_and_rest, sql_content, sql_first_and_rest, sql_normalized, sql_tokens, table


def text_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.size(T.tokens(F.col("text"))).cast("long").alias("n_tokens"), F.size(T.content_tokens(F.col("text"))).cast("long").alias("n_content")
    )


def keyword_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select("item_id", T.keyword_query(F.col("text")).alias("query"))


def normalized_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(T.normalize_answer(F.col("text")).cast("binary")).alias("normalized_md5"))


def _predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A text's first line is the prediction; all after it, and the line with an article or the text's last one, are golds."""
    first, rest = first_and_rest()
    wrapped = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("The "), first, F.lit(" !"))).otherwise(F.element_at(F.split("text", "\n"), -1))
    return table(spark, sf_dir, "documents").select("doc_id", first.alias("prediction"), F.array(rest, wrapped).alias("golds"))


def answer_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, g = F.col("prediction"), F.col("golds")
    return _predictions(spark, sf_dir).select("doc_id", M.exact_match(p, g).alias("em"), F.round(M.f1(p, g), 6).alias("f1"))


def metrics_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = answer_metrics(spark, sf_dir)
    return rows.agg(F.coalesce(F.round(F.avg("em"), 6), F.lit(0.0)).alias("exact_match"), F.coalesce(F.round(F.avg("f1"), 4), F.lit(0.0)).alias("f1"), F.count("*").cast("double").alias("n"))


def range_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    price = F.floor("l_extendedprice").cast("long")
    low, high = price + (F.col("l_linenumber") - 4) * 100, price + (F.col("l_linenumber") - 3) * 150
    as_text = lambda c: c.cast("string")
    gold = F.concat(F.lit("{'wikidata': "), as_text(price), F.lit(".0, 'range': ["), as_text(low), F.lit(", "), as_text(high), F.lit("]}"))
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.concat(F.lit("about "), F.format_number(price, 0), F.lit(" coins")).alias("p"), F.array(F.lit("a fortune"), gold).alias("g"))
    rows = rows.select("l_orderkey", "l_linenumber", M.metrics(F.col("p"), F.col("g")).alias("m"))
    return rows.select("l_orderkey", "l_linenumber", "m.em", F.round("m.f1", 6).alias("f1"), "m.accuracy")


def text_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(T.chunks(F.col("text"))).alias("i", "chunk"))
    name = F.concat(F.col("doc_id").cast("string"), F.lit("_p"), F.col("i").cast("string"))
    return rows.select(name.alias("chunk_id"), F.length("chunk").cast("long").alias("n_chars"), F.md5(F.col("chunk").cast("binary")).alias("chunk_md5"))


def validation_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.concat(F.lit("q_"), F.col("doc_id").cast("string"))
    return table(spark, sf_dir, "documents").select("doc_id", T.md5_bucket(key).alias("bucket"), T.in_validation(key, 0.05).alias("is_validation"))


def url_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    url, kind = F.col("url"), F.when(F.col("page_id") % 3 == 0, "image/png").when(F.col("page_id") % 3 == 1, "image/webp; q=1").otherwise("text/html")
    named = F.concat(F.lit("ILSVRC2012_"), F.col("page_id").cast("string"), F.lit("00042_gt_redCar%20640x480_"), T.file_name(url))
    return table(spark, sf_dir, "pages").select(
        "page_id",
        T.safe_id(url).alias("safe_id"),
        T.image_suffix(url, kind).alias("suffix"),
        T.file_name(url).alias("file_name"),
        T.entity_of(F.concat(F.lit("Q"), F.col("page_id").cast("string"), F.lit("_p3_p4"))).alias("entity"),
        T.weak_label(named).alias("label"),
        T.clipped(F.col("html"), 80).alias("shown"),
    )


def question_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = F.split("text", "\n")
    context = F.when(F.col("doc_id") % 4 == 0, F.lit([]).cast("array<string>")).otherwise(F.slice(lines, F.lit(2), F.size(lines)))
    built = T.prompt(T.with_choices(F.element_at(lines, 1), F.array(F.col("lang"), F.col("source"))), context)
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(built.cast("binary")).alias("prompt_md5"), T.last_capitalized(F.transform(context, lambda c: F.regexp_replace(c, "[^ -~]", "#"))).alias("guess"))


def hashed_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of a text's tokens in 24 hash bins: the text side of the offline encoder."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.explode(T.tokens(F.col("text"))).alias("t"))
    return rows.groupBy("doc_id", F.pmod(F.crc32(F.col("t").cast("binary")), F.lit(24)).alias("bin")).agg(F.count("*").alias("n"))


QUERIES = {f.__name__: f for f in (text_tokens, keyword_queries, normalized_answers, answer_metrics, metrics_summary, range_metrics, text_chunks, validation_split, url_fields, question_prompts, hashed_words)}

_PRED = """WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS l, {lines} FROM documents),
p AS (SELECT doc_id, first AS prediction, [rest, CASE WHEN doc_id % 3 = 0 THEN 'The ' || first || ' !' ELSE l[-1] END] AS golds FROM l),
t AS (SELECT doc_id, string_split({p}, ' ') AS p0, {p} AS pn, string_split({a}, ' ') AS a0, {a} AS an, string_split({b}, ' ') AS b0, {b} AS bn FROM p),
u AS (SELECT doc_id, pn, an, bn, list_filter(p0, lambda x: x <> '') AS p, list_filter(a0, lambda x: x <> '') AS a, list_filter(b0, lambda x: x <> '') AS b FROM t),
c AS (SELECT doc_id, pn, an, bn, len(p)::DOUBLE AS np, len(a)::DOUBLE AS na, len(b)::DOUBLE AS nb,
 coalesce(list_sum(list_transform(list_distinct(p), lambda x: least(len(list_filter(p, lambda y: y = x)), len(list_filter(a, lambda y: y = x))))), 0)::DOUBLE AS ca,
 coalesce(list_sum(list_transform(list_distinct(p), lambda x: least(len(list_filter(p, lambda y: y = x)), len(list_filter(b, lambda y: y = x))))), 0)::DOUBLE AS cb FROM u),
f AS (SELECT doc_id, (pn = an OR pn = bn)::INT::DOUBLE AS em,
 CASE WHEN np = 0 OR na = 0 THEN (np = na)::INT::DOUBLE WHEN ca = 0 THEN 0e0 ELSE 2e0 * (ca / np) * (ca / na) / (ca / np + ca / na) END AS fa,
 CASE WHEN np = 0 OR nb = 0 THEN (np = nb)::INT::DOUBLE WHEN cb = 0 THEN 0e0 ELSE 2e0 * (cb / np) * (cb / nb) / (cb / np + cb / nb) END AS fb FROM c),
m AS (SELECT doc_id, em, round(greatest(fa, fb), 6) AS f1 FROM f) """
_PRED = _PRED.replace("{lines}", sql_first_and_rest("first", "rest"))
for _key, _expr in (("{p}", "prediction"), ("{a}", "golds[1]"), ("{b}", "golds[2]")):
    _PRED = _PRED.replace(_key, sql_normalized(_expr))

ORACLE_SQL = {
    "hashed_words": f"""WITH b AS (SELECT list_transform(range(256), lambda n: list_reduce(list_concat([n::BIGINT], range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END)) AS t),
w AS (SELECT doc_id, unnest({sql_tokens('text')}) AS t FROM documents), d AS (SELECT DISTINCT t AS w FROM w),
h AS (SELECT w, xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(w, ''), lambda x: ascii(x)::BIGINT)), lambda c, x: xor(c >> 8, t[((xor(c, x)) & 255) + 1])), 4294967295::BIGINT) AS crc FROM d, b)
SELECT doc_id, (crc % 24)::BIGINT AS bin, count(*) AS n FROM w JOIN h ON h.w = w.t GROUP BY 1, 2""",
    "text_tokens": f"SELECT doc_id, len({sql_tokens('text')})::BIGINT AS n_tokens, len({sql_content('text')})::BIGINT AS n_content FROM documents",
    "keyword_queries": "SELECT item_id, array_to_string(list_filter(regexp_extract_all(text, '[A-Za-z0-9'']+'), lambda t: not list_contains("
    + "['a','an','the','in','on','at','of','to','is','are','was','were','which','what','who','whom','whose','where','when','how','name','can','be','found','located','does','do','did']"
    + ", lower(t))), ' ') AS query FROM benchmark",
    "normalized_answers": f"SELECT doc_id, md5({sql_normalized('text')}) AS normalized_md5 FROM documents",
    "answer_metrics": _PRED + "SELECT doc_id, em, f1 FROM m",
    "metrics_summary": _PRED + "SELECT coalesce(round(avg(em), 6), 0e0) AS exact_match, coalesce(round(avg(f1), 4), 0e0) AS f1, count(*)::DOUBLE AS n FROM m",
    "range_metrics": """WITH r AS (SELECT l_orderkey, l_linenumber, floor(l_extendedprice)::BIGINT AS p FROM lineitem),
b AS (SELECT *, least(p + (l_linenumber - 4) * 100, p + (l_linenumber - 3) * 150) AS lo, greatest(p + (l_linenumber - 4) * 100, p + (l_linenumber - 3) * 150) AS hi FROM r),
h AS (SELECT *, (p BETWEEN lo AND hi)::INT::DOUBLE AS hit FROM b)
SELECT l_orderkey, l_linenumber, hit AS em, hit AS f1, hit AS accuracy FROM h""",
    "text_chunks": """WITH RECURSIVE p AS (SELECT doc_id, list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: trim(x)), lambda x: x <> '') AS ps FROM documents),
r AS (SELECT doc_id, ps, 1 AS i, 0 AS chunk, length(ps[1]) AS size FROM p WHERE len(ps) > 0
UNION ALL SELECT doc_id, ps, i + 1, CASE WHEN size + length(ps[i + 1]) + 1 > 1200 THEN chunk + 1 ELSE chunk END,
 CASE WHEN size + length(ps[i + 1]) + 1 > 1200 THEN length(ps[i + 1]) ELSE size + 1 + length(ps[i + 1]) END FROM r WHERE i < len(ps)),
c AS (SELECT doc_id, chunk, string_agg(ps[i], chr(10) ORDER BY i) AS t FROM r GROUP BY 1, 2)
SELECT doc_id || '_p' || chunk AS chunk_id, length(t)::BIGINT AS n_chars, md5(t) AS chunk_md5 FROM c""",
    "validation_split": """WITH m AS (SELECT doc_id, md5('q_' || doc_id) AS h FROM documents),
w AS (SELECT doc_id, ('0x' || substr(h, 1, 8))::BIGINT AS a, ('0x' || substr(h, 9, 8))::BIGINT AS b, ('0x' || substr(h, 17, 8))::BIGINT AS c, ('0x' || substr(h, 25, 8))::BIGINT AS d FROM m),
x AS (SELECT doc_id, ((((((a % 10000) * 4294967296 + b) % 10000) * 4294967296 + c) % 10000) * 4294967296 + d) % 10000 AS bucket FROM w)
SELECT doc_id, bucket, bucket < 500 AS is_validation FROM x""",
    "url_fields": r"""WITH u AS (SELECT page_id, url, html, url_decode(string_split(string_split(url, '?')[1], '/')[-1]) AS fn,
 CASE WHEN page_id % 3 = 0 THEN 'image/png' WHEN page_id % 3 = 1 THEN 'image/webp; q=1' ELSE 'text/html' END AS kind, lower(string_split(url, '?')[1]) AS path FROM pages),
w AS (SELECT *, 'redCar 640x480_' || fn AS s0 FROM u),
x AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(regexp_replace(s0, '\b\d{2,}x\d{2,}\b', ' ', 'gi'), '\b\d{5,}\b', ' ', 'g'), '[_+%./\\-]+', ' ', 'g'), '([a-z])([A-Z])', '\1 \2', 'g') AS s1 FROM w),
y AS (SELECT *, array_to_string(list_filter(regexp_extract_all(s1, '[A-Za-z0-9]+'), lambda t: not list_contains(['archive','by','car','class','data','gt','image','imagenet','input','test','train','val'], lower(t))
 AND NOT regexp_full_match(t, '\d{5,}') AND (length(t) > 1 OR regexp_full_match(t, '\d'))), ' ') AS label FROM x),
z AS (SELECT *, trim(regexp_replace(html, '\s+', ' ', 'g')) AS flat FROM y)
SELECT page_id, left(trim(regexp_replace(url, '[^A-Za-z0-9]+', '_', 'g'), '_'), 120) AS safe_id,
 CASE WHEN regexp_matches(path, '\.jpe?g$') THEN '.jpg' WHEN path LIKE '%.png' THEN '.png' WHEN path LIKE '%.webp' THEN '.webp' WHEN contains(kind, 'png') THEN '.png' WHEN contains(kind, 'webp') THEN '.webp' ELSE '.jpg' END AS suffix,
 fn AS file_name, 'Q' || page_id AS entity, label, CASE WHEN length(flat) <= 80 THEN flat ELSE left(flat, 79) || '…' END AS shown FROM z""",
    "question_prompts": r"""WITH l AS (SELECT doc_id, lang, source, string_split(text, chr(10)) AS l FROM documents),
c AS (SELECT doc_id, l[1] || chr(10) || 'Choices: A. ' || lang || '; B. ' || source AS q, CASE WHEN doc_id % 4 = 0 THEN [] ELSE l[2:] END AS c FROM l),
n AS (SELECT *, list_transform(c, lambda x, i: '[' || i || '] ' || x) AS lines, list_filter(list_transform(c, lambda x: regexp_extract_all(regexp_replace(x, '[^ -~]', '#', 'g'), '\b([A-Z][a-zA-Z]+)\b', 1)), lambda w: len(w) > 0) AS caps FROM c)
SELECT doc_id, md5(CASE WHEN len(c) > 0 THEN 'Context:' || chr(10) || array_to_string(lines, chr(10)) || chr(10) || chr(10) || 'Question: ' || q || chr(10) || 'Answer:' ELSE q END) AS prompt_md5,
 CASE WHEN len(caps) > 0 THEN caps[1][-1] ELSE 'unknown' END AS guess FROM n""",
}
