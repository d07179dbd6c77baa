"""The registered queries of this subpackage, each over the whole of its table, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import jaccard, kmeans_tree, mixing, packing, ranking, rans, rlz, secrets, suffix_tree, telephony
from .common import crc_mod, documents


def op1_rlz(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = rlz.remove_repeats(documents(spark, sf_dir))
    return cut.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir))


def op3_kmeans_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return kmeans_tree.Index(table).search(table.where("vec_id % 20 = 0"), 20)


def op4_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_copies(documents(spark, sf_dir)).select("doc_id", "class_id", "n_links")


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.scan(documents(spark, sf_dir)))


def op6_telephony(spark: SparkSession, sf_dir: str) -> DataFrame:
    return telephony.stored(documents(spark, sf_dir))


def op7_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_tree.score(documents(spark, sf_dir))


def op8_rans(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return rans.round_trip(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), ids_column=False)


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang", "source")
    return mixing.select(docs).select("doc_id", F.col("_domain").alias("domain"), "lang", "source", packing.count_words(F.col("text")).alias("n_tokens"), F.col("_copies").alias("copies"))


def op10_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = ranking.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = ranking.score(docs, model)
    return scored.select("doc_id", (crc_mod(F.col("doc_id"), 4) == 2).alias("held_out"), "score", "predicted")


QUERIES = {
    "op1_rlz": op1_rlz,
    "op2_packing": op2_packing,
    "op3_kmeans_tree": op3_kmeans_tree,
    "op4_jaccard": op4_jaccard,
    "op5_secrets": op5_secrets,
    "op6_telephony": op6_telephony,
    "op7_suffix_tree": op7_suffix_tree,
    "op8_rans": op8_rans,
    "op9_mixing": op9_mixing,
    "op10_ranking": op10_ranking,
}
_WORDS = r"""w AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents)"""


def _spans_sql() -> str:
    """Matches of each kind, placed by the lengths of what lies between them (a run of 16 is asked for at once: the same runs)."""
    parts = []
    for i, r in enumerate(secrets.RULES):
        pattern = (f"[{r.run[0]}-9a-f]{{{r.least},}}" if r.run else r.pattern).replace("'", "''")
        parts.append(
            f"SELECT doc_id, '{r.kind}' AS kind, {i} AS o, {r.least} AS least, regexp_extract_all(x, '{pattern}', 0) AS m, regexp_extract_all(x, '{pattern}', {r.group}) AS g, "
            f"regexp_split_to_array(x, '{pattern}') AS p FROM t WHERE regexp_matches(x, '{pattern}')"
        )
    counts = ", ".join(f"count(*) FILTER (kind = '{r.kind}') AS n_{r.kind}" for r in secrets.BASE)
    return f"""WITH t AS (SELECT doc_id, coalesce(text, '') AS x FROM documents), k AS ({" UNION ALL ".join(parts)}),
s AS (SELECT doc_id, kind, o, list_sum(list_transform(p[1:i], lambda y: length(y))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda y: length(y))), 0) AS a, length(m[i]) AS n FROM k, unnest(range(1, len(m) + 1)) AS u(i) WHERE length(g[i]) >= least),
d AS (SELECT doc_id, {counts}, string_agg(kind || ':' || a || ':' || (a + n), ',' ORDER BY a, o) FILTER (o < {len(secrets.BASE)}) AS base, string_agg(kind || ':' || a || ':' || (a + n), ',' ORDER BY a, o) AS spans FROM s GROUP BY 1)
SELECT doc_id, {", ".join(f"coalesce(n_{r.kind}, 0) AS n_{r.kind}" for r in secrets.BASE)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM documents LEFT JOIN d USING (doc_id)"""


#: The other operators choose, encode, fit or approximate in ways that SQL can't express: they are tested against brute force.
ORACLE_SQL: dict[str, str] = {
    "op1_rlz": f"""WITH {_WORDS}, p AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS j FROM w),
g AS (SELECT doc_id, j, word, string_agg(word, ' ') OVER f AS s, count(*) OVER f AS n FROM p WINDOW f AS (PARTITION BY doc_id ORDER BY j ROWS BETWEEN CURRENT ROW AND 34 FOLLOWING)),
h AS (SELECT doc_id, j, md5(s) AS h FROM g WHERE n = 35), d AS (SELECT h FROM h GROUP BY 1 HAVING count(*) > 1), o AS (SELECT doc_id, j FROM h WHERE h IN (SELECT h FROM d)),
m AS (SELECT p.doc_id, p.j, p.word, max(o.j) OVER (PARTITION BY p.doc_id ORDER BY p.j ROWS BETWEEN 34 PRECEDING AND CURRENT ROW) IS NOT NULL AS gone FROM p LEFT JOIN o ON o.doc_id = p.doc_id AND o.j = p.j),
k AS (SELECT doc_id, count(*) AS n_words, count(*) FILTER (gone) AS n_removed, string_agg(word, ' ' ORDER BY j) FILTER (NOT gone) AS kept FROM m GROUP BY 1)
SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM documents LEFT JOIN k USING (doc_id)""",
    "op5_secrets": _spans_sql(),
    "op4_jaccard": f"""WITH RECURSIVE {_WORDS}, p AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS j, len(w) AS n FROM w),
g AS (SELECT doc_id, n, string_agg(word, ' ') OVER f AS s, count(*) OVER f AS c, j FROM p WINDOW f AS (PARTITION BY doc_id ORDER BY j ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING)),
u AS (SELECT DISTINCT doc_id, md5(s) AS s FROM g WHERE c = 5 OR (n < 5 AND j = 1)), z AS (SELECT doc_id, count(*) AS n FROM u GROUP BY 1),
o AS (SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM z)),
c AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM u x JOIN u y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM c JOIN z za ON za.doc_id = a JOIN z zb ON zb.doc_id = b WHERE c >= 0.8e0 * (za.n + zb.n - c) - 1e-9 UNION ALL SELECT x.doc_id, y.doc_id FROM o x JOIN o y ON x.doc_id <> y.doc_id),
r AS (SELECT doc_id AS a, doc_id AS m FROM documents UNION SELECT l.b, r.m FROM r JOIN l ON l.a = r.a WHERE r.m < l.b),
k AS (SELECT a, min(m) AS class_id FROM r GROUP BY 1), n AS (SELECT a, count(*) AS n_links FROM l GROUP BY 1)
SELECT k.a AS doc_id, class_id, coalesce(n_links, 0) AS n_links FROM k LEFT JOIN n USING (a)""",
}
