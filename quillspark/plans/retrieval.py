"""Retrieval queries: documents are the corpus, benchmark items the questions, embeddings the encoded units."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scores import lexical_recall
from ..operators import retrieval as R
from .common import sql_content, sql_tokens, table


def _corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("title"), "text")


def _questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("question"))


def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.bm25_top_k(_corpus(spark, sf_dir), _questions(spark, sf_dir), 5).select("query_id", "rank", "doc_id", "score")


def bm25_grounded(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = bm25_topk(spark, sf_dir)
    found = top.join(_corpus(spark, sf_dir), "doc_id").join(_questions(spark, sf_dir), "query_id")
    return found.select("query_id", "rank", "doc_id", "score", F.round(lexical_recall(F.col("question"), F.array("text")), 6).alias("grounding"))


def bm25_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = R.corpus_statistics(_corpus(spark, sf_dir))
    return s.select("n", F.round("avgdl", 6).alias("avgdl"), "vocabulary", F.round("mean_idf", 6).alias("mean_idf"))


def retrieval_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(
        "doc_id",
        F.when(F.col("doc_id") % 3 != 0, F.col("source")).alias("title"),
        F.when(F.col("doc_id") % 5 != 0, F.col("text")).alias("text"),
        F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit("img/"), F.col("doc_id").cast("string"), F.lit(".jpg"))).alias("image_path"),
        F.when(F.col("doc_id") % 2 == 0, F.col("lang")).alias("entity_id"),
    )
    return R.units(docs).select("doc_id", "modality", F.length("text").cast("long").alias("text_chars"), "title", "image_path", "entity_key")


def _vectors(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("unit_id"), "embedding", "label")
    return e, e.where("unit_id % 50 = 0").select(F.col("unit_id").alias("query_id"), "embedding")


def vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, q = _vectors(spark, sf_dir)
    return R.vector_top_k(e, q, 5).select("query_id", "rank", "unit_id", "score")


def vector_entity_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, q = _vectors(spark, sf_dir)
    return R.vector_top_k(e, q, 5, dedupe="label").select("query_id", "rank", "unit_id", "label", "score")


def _vector_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark item i is encoded as vector i; unit j belongs to document j // 2, even ones are texts."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("unit_id"), "embedding")
    q = e.join(_questions(spark, sf_dir).select(F.col("query_id").alias("unit_id")), "unit_id", "left_semi").select(F.col("unit_id").alias("query_id"), "embedding")
    hits = R.vector_top_k(e, q, 5)
    return hits.select("query_id", "rank", F.expr("unit_id div 2").alias("doc_id"), F.when(F.col("unit_id") % 2 == 0, "text").otherwise("image").alias("modality"))


def hybrid_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    lexical = bm25_topk(spark, sf_dir).select("query_id", "rank", "doc_id", F.lit(None).cast("string").alias("modality"))
    return R.interleaved(lexical, _vector_hits(spark, sf_dir), 5)


def evidence_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lexical hits of four consecutive questions are the steps of a trajectory."""
    hits = bm25_topk(spark, sf_dir).select(F.expr("query_id div 4").alias("traj_id"), (F.col("query_id") % 4).alias("step_index"), "rank", "doc_id")
    return R.numbered_evidence(hits)


QUERIES = {f.__name__: f for f in (bm25_topk, bm25_grounded, bm25_statistics, retrieval_units, vector_topk, vector_entity_topk, hybrid_topk, evidence_ids)}

_BM25 = f"""
WITH tok AS (SELECT doc_id, unnest({sql_tokens("coalesce(source,'') || ' ' || coalesce(text,'')")}) AS t FROM documents),
dl AS (SELECT d.doc_id, count(k.t) AS dl FROM documents d LEFT JOIN tok k ON d.doc_id = k.doc_id GROUP BY 1),
st AS (SELECT count(*)::DOUBLE AS n, avg(dl::DOUBLE) AS avgdl FROM dl),
tf AS (SELECT doc_id, t, count(*)::DOUBLE AS tf FROM tok GROUP BY 1, 2),
df AS (SELECT t, count(*)::DOUBLE AS df FROM tf GROUP BY 1),
raw AS (SELECT t, ln(n - df + 0.5e0) - ln(df + 0.5e0) AS idf FROM df, st),
me AS (SELECT avg(idf) AS m FROM raw),
idf AS (SELECT t, CASE WHEN idf < 0 THEN 0.25e0 * m ELSE idf END AS idf FROM raw, me),
q AS (SELECT item_id AS query_id, unnest({sql_tokens("text")}) AS t FROM benchmark),
sc AS (SELECT query_id, tf.doc_id, round(sum(idf.idf * tf.tf * 2.5e0 / (tf.tf + 1.5e0 * (0.25e0 + 0.75e0 * dl.dl / st.avgdl))), 6) AS score
  FROM q JOIN tf USING (t) JOIN idf USING (t) JOIN dl ON dl.doc_id = tf.doc_id, st GROUP BY 1, 2),
al AS (SELECT * FROM sc UNION ALL
  SELECT b.item_id, f.doc_id, 0e0 FROM benchmark b, (SELECT doc_id FROM documents ORDER BY doc_id LIMIT 5) f
  WHERE NOT EXISTS (SELECT 1 FROM sc WHERE sc.query_id = b.item_id AND sc.doc_id = f.doc_id)),
top AS (SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id))::INT AS rank, doc_id, score FROM al QUALIFY rank <= 5)
"""
_COSINE = """
e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings),
nv AS (SELECT vec_id, label, list_transform(v, lambda x: x / greatest(sqrt(list_inner_product(v, v)), 1e-12)) AS v FROM e)
"""


def _vector_sql(where: str, dedupe: str = "") -> str:
    key = ", label" if dedupe else ""
    return f"""sim AS (SELECT a.vec_id AS query_id, b.vec_id AS unit_id, b.label, round(list_inner_product(a.v, b.v), 6) AS score FROM nv a, nv b WHERE {where}),
one AS (SELECT * FROM sim {"QUALIFY row_number() OVER (PARTITION BY query_id, label ORDER BY score DESC, unit_id) = 1" if dedupe else ""}),
vt AS (SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, unit_id))::INT AS rank, unit_id{key}, score FROM one QUALIFY rank <= 5)"""


ORACLE_SQL = {
    "bm25_topk": _BM25 + "SELECT query_id, rank, doc_id, score FROM top",
    "bm25_grounded": _BM25
    + f"""SELECT query_id, rank, top.doc_id, score, round(CASE WHEN len(qt) = 0 OR d.text = '' THEN 0e0 ELSE len(list_intersect(qt, {sql_content("d.text")}))::DOUBLE / len(qt) END, 6) AS grounding
FROM top JOIN documents d ON d.doc_id = top.doc_id JOIN (SELECT item_id, {sql_content("text")} AS qt FROM benchmark) b ON b.item_id = query_id""",
    "bm25_statistics": _BM25 + "SELECT n::BIGINT AS n, round(avgdl, 6) AS avgdl, (SELECT count(*) FROM raw) AS vocabulary, round(m, 6) AS mean_idf FROM st, me",
    "retrieval_units": """WITH d AS (SELECT doc_id, CASE WHEN doc_id % 3 <> 0 THEN source END AS title, CASE WHEN doc_id % 5 <> 0 THEN text END AS text,
  CASE WHEN doc_id % 4 = 0 THEN 'img/' || doc_id || '.jpg' END AS image_path, CASE WHEN doc_id % 2 = 0 THEN lang END AS entity_id FROM documents)
SELECT doc_id, modality, text_chars, coalesce(title, '') AS title, image_path, coalesce(nullif(entity_id, ''), nullif(title, ''), doc_id::VARCHAR) AS entity_key FROM (
SELECT doc_id, 'text' AS modality, length(coalesce(text, ''))::BIGINT AS text_chars, title, NULL::VARCHAR AS image_path, entity_id FROM d WHERE trim(coalesce(title, '') || ' ' || coalesce(text, '')) <> ''
UNION ALL SELECT doc_id, 'image', 0, title, image_path, entity_id FROM d WHERE image_path IS NOT NULL)""",
    "vector_topk": "WITH " + _COSINE + ", " + _vector_sql("a.vec_id % 50 = 0") + " SELECT query_id, rank, unit_id, score FROM vt",
    "vector_entity_topk": "WITH " + _COSINE + ", " + _vector_sql("a.vec_id % 50 = 0", "label") + " SELECT query_id, rank, unit_id, label, score FROM vt",
    "hybrid_topk": _BM25
    + ", "
    + _COSINE
    + ", "
    + _vector_sql("a.vec_id IN (SELECT item_id FROM benchmark)")
    + """, b AS (SELECT query_id, doc_id, NULL::VARCHAR AS modality, 2 * rank AS turn FROM top
UNION ALL SELECT query_id, unit_id // 2, CASE WHEN unit_id % 2 = 0 THEN 'text' ELSE 'image' END, 2 * rank + 1 FROM vt),
k AS (SELECT *, row_number() OVER (PARTITION BY query_id, doc_id, modality ORDER BY turn) AS n, coalesce(bool_or(modality IS NULL) OVER (PARTITION BY query_id, doc_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS plain FROM b)
SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY turn))::INT AS rank, doc_id, modality FROM k WHERE n = 1 AND NOT plain QUALIFY rank <= 5""",
    "evidence_ids": _BM25
    + """SELECT query_id // 4 AS traj_id, query_id % 4 AS step_index, rank, doc_id, 'e' || (row_number() OVER (PARTITION BY query_id // 4 ORDER BY query_id % 4, rank) - 1) AS evidence_id FROM top""",
}
