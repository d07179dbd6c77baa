"""Corpus-preparation queries over stand-ins built from the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import entity_of
from ..sources import prepare as P
from .common import table


def annotated_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders are annotations, customers' orders the knowledge base (several lines each), parts the image files."""
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    s = lambda c: c.cast("string")
    empty = F.array().cast("array<string>")
    ann = o.select(
        s(k).alias("data_id"), F.concat(F.lit("img"), s(k % 300)).alias("image_id"), F.col("o_orderpriority").alias("question"),
        F.when(k % 5 == 0, empty).when(k % 5 != 1, F.array("o_orderstatus", s(k))).alias("answer"), F.when(k % 3 == 0, F.array(F.lit("eval"))).when(k % 3 == 1, empty).alias("answer_eval"), F.when(k % 2 == 0, F.lit("val")).alias("data_split"),
    )
    kb = o.select(s(F.expr("o_orderkey div 2 * 2")).alias("data_id"), F.concat(F.lit("Q"), s(F.col("o_custkey"))).alias("entity_id"), F.col("o_orderstatus").alias("entity_text"), k.alias("line"))
    files = table(spark, sf_dir, "part").select(F.concat(F.lit("img"), s(F.col("p_partkey") % 150)).alias("stem"), F.concat(F.lit("dir/"), s(F.col("p_partkey")), F.lit(".jpg")).alias("path"))
    q = P.annotated_queries(ann, kb, files)
    return q.select("query_id", "question", F.array_join("gold_answers", "|").alias("golds"), "image_path", F.col("metadata.data_split").alias("data_split"), F.col("metadata.entity_id").alias("entity_id"), F.col("metadata.entity_text").alias("entity_text"))


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.concat(F.lit("Q"), F.col("doc_id").cast("string")).alias("entity_id"), F.col("source").alias("title"), F.when(F.col("doc_id") % 7 != 0, F.col("text")).otherwise("").alias("text"))


def page_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = table(spark, sf_dir, "labels").select(F.concat(F.lit("Q"), F.col("doc_id").cast("string")).alias("entity_id"))
    c = P.page_chunks(_pages(spark, sf_dir), wanted, 400)
    return c.groupBy(entity_of(F.col("doc_id")).alias("entity_id")).agg(F.count("*").alias("n_chunks"), F.sum(F.length("text")).alias("n_chars"), F.max(F.length("text")).cast("long").alias("longest"))


def pages_to_fetch(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "documents").select(F.concat(F.lit("Q"), F.col("doc_id").cast("string")).alias("entity_id"), F.col("lang").alias("entity_text"))
    titles = table(spark, sf_dir, "labels").select(F.concat(F.lit("Q"), F.col("doc_id").cast("string")).alias("entity_id"), F.when(F.col("quality") == 1, F.lit("known")).otherwise("").alias("title"))
    return P.pages_to_fetch(e, _pages(spark, sf_dir), titles)


def entity_image_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items are the big scan's records, orders the cache, parts the needed entities."""
    s = lambda c: F.col(c).cast("string")
    line = lambda *cs: F.concat_ws("-", *[F.lpad(s(c), 9, "0") for c in cs])
    records = table(spark, sf_dir, "lineitem").select(s("l_partkey").alias("wikidata_id"), F.col("l_returnflag").alias("wikipedia_title"), F.concat_ws("/", s("l_orderkey"), s("l_suppkey")).alias("wikipedia_image_url"), line("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey").alias("line"))
    cached = table(spark, sf_dir, "orders").select(s("o_custkey").alias("entity_id"), F.col("o_orderstatus").alias("title"), s("o_orderkey").alias("image_url"), line("o_orderkey").alias("line"))
    return P.entity_image_urls(records, table(spark, sf_dir, "part").where("p_size < 20").select(s("p_partkey").alias("entity_id")), cached)


def attached_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").select(F.concat(F.lit("E"), (F.col("conv_id") % 50).cast("string"), F.lit("_p"), F.col("conv_id").cast("string"), F.lit("_"), F.col("turn").cast("string")).alias("doc_id"), F.col("role").alias("title"), F.lit("t").alias("text"))
    images = table(spark, sf_dir, "nation").select(F.concat(F.lit("E"), (F.col("n_nationkey") * 2).cast("string")).alias("entity_id"), F.concat("n_name", F.lit(".png")).alias("image_path"))
    return P.attached_images(c, images).select("doc_id", "title", "image_path", "entity_id")


def image_manifests(spark: SparkSession, sf_dir: str) -> DataFrame:
    targets = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("image_id"), F.col("p_name").alias("source_path"))
    present = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("image_id"), F.col("s_name").alias("path"))
    there, missing = P.image_manifest(targets, present)
    return there.unionByName(missing.join(targets, "image_id"), allowMissingColumns=True).select("image_id", "source_path", "path", P.image_stem(F.col("image_id").cast("string"), F.col("source_path")).alias("stem"))


def choice_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    rows = p.select(
        F.lpad(k.cast("string"), 12, "0").alias("pid"), F.when(k % 4 != 0, F.col("p_brand").cast("binary")).alias("image"), F.col("p_name").alias("question"), F.array("p_type", "p_brand", F.col("p_size").cast("string")).alias("choices"),
        (k % 3).cast("int").alias("answer"), F.when(k % 2 == 0, "a hint").otherwise("").alias("hint"), F.when(k % 5 == 0, "a lecture").alias("lecture"), F.col("p_type").alias("subject"), F.col("p_brand").alias("topic"), k.alias("k"),
    )
    split = lambda c: rows.where(c).drop("k")
    q, d = P.choice_questions({"train": split("k % 3 = 0"), "validation": split("k % 3 = 1"), "test": split("k % 3 = 2")}, "scienceqa")
    q = q.select(F.col("query_id").alias("id"), F.md5(F.concat_ws("|", "question", F.array_join("gold_answers", "|")).cast("binary")).alias("body_md5"), F.col("metadata.split").alias("split"))
    return q.unionByName(d.select(F.col("doc_id").alias("id"), F.md5(F.concat_ws("|", "title", "text").cast("binary")).alias("body_md5"), F.lit(None).cast("string").alias("split")))


def visual_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as picture questions, all of them."""
    p = table(spark, sf_dir, "part")
    choices = F.array("p_type", "p_brand", F.col("p_size").cast("string"), F.lit("none"))
    letter = F.col("p_partkey") % 4
    rows = p.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("question"), choices.alias("choices"), F.element_at(choices, (letter + 1).cast("int")).alias("answer"), F.char(letter + 65).alias("answer_choice"), F.concat(F.lit("img/"), F.col("p_partkey").cast("string")).alias("image_path"), F.col("p_type").alias("scenario"), F.col("p_brand").alias("aspect"))
    q = P.visual_questions(rows, p.count())
    return q.select("query_id", F.md5(F.concat_ws("|", "question", F.array_join("gold_answers", "|")).cast("binary")).alias("body_md5"), "image_path", F.col("metadata.scenario").alias("scenario"))


def semantic_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order priorities as questions' types; those of open orders have none."""
    o = table(spark, sf_dir, "orders").select(F.when(F.col("o_orderstatus") != "O", F.col("o_orderpriority")).alias("semantic"))
    return P.type_histogram(o, "semantic")


def unseen_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select((F.col("doc_id") % 10 == 0).alias("asked"), F.concat("source", F.when(F.col("doc_id") % 9 == 0, "_input.").otherwise("."), F.lit("jpg")).alias("name"), F.col("text").cast("binary").alias("content"), "doc_id")
    kept = P.unseen_images(d.where("not asked").withColumn("name", F.concat(F.col("doc_id").cast("string"), F.lit("_"), "name")), d.where("asked"))
    return kept.select("name", "label")


def entity_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.entity_documents(_annotated_images(spark, sf_dir))


def _annotated_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers are images: nation and segment name what they show."""
    c = table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    s = lambda x: x.cast("string")
    return c.select(
        F.lpad(s(k), 9, "0").alias("image_id"),
        F.when(k % 5 == 0, F.array().cast("array<string>")).otherwise(F.array(F.concat(F.lit("Name "), s(F.col("c_nationkey"))), F.col("c_mktsegment"))).alias("entities"),
        F.when(k % 4 == 0, F.array().cast("array<string>")).otherwise(F.array(F.concat(F.lit("Q"), s(F.col("c_nationkey"))), F.concat(F.lit("S"), F.col("c_mktsegment")))).alias("qids"),
        F.concat(F.lit(" caption  "), s(k % 3)).alias("caption"),
        F.array(F.lit("who?"), F.col("c_name"), F.lit("why?")).alias("questions"), F.array("c_mktsegment", s(k)).alias("answers"), F.array(F.lit("t0")).alias("types"),
    )


def paired_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = P.paired_questions(_annotated_images(spark, sf_dir))
    return q.select("query_id", "question", F.array_join("gold_answers", "|").alias("golds"), "type")


def scene_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders are images, line items the objects of the even ones' scenes, order priorities the questions' programs."""
    l = table(spark, sf_dir, "lineitem")  # noqa: E741
    ident = F.concat(F.lpad(F.col("l_linenumber").cast("string"), 2, "0"), F.lit("-"), F.col("l_partkey").cast("string"))
    obj = F.struct(
        ident.alias("id"), F.concat(F.lit("part "), F.col("l_partkey").cast("string")).alias("name"), F.array("l_returnflag", F.lit(" "), "l_linestatus").alias("attributes"),
        F.array(F.struct(F.lit("left  of").alias("name"), F.concat(F.lit("01-"), F.col("l_partkey").cast("string")).alias("object")), F.struct(F.lit("").alias("name"), F.lit("x").alias("object"))).alias("relations"),
    )
    distinct = l.select("l_orderkey", obj.alias("o")).groupBy("l_orderkey", "o.id").agg(F.min("o").alias("o"))
    scenes = distinct.groupBy(F.col("l_orderkey").alias("image_id")).agg(P.scene_text(F.array_sort(F.collect_list("o"))).alias("scene"))
    o = table(spark, sf_dir, "orders")
    program = P.program_text(
        F.when(F.col("o_orderkey") % 3 == 0, F.array(F.struct(F.lit("select").alias("operation"), F.col("o_orderpriority").alias("argument")), F.struct(F.lit("verify").alias("operation"), F.lit("").alias("argument")))).otherwise(F.array().cast("array<struct<operation:string,argument:string>>")),
        F.when(F.col("o_orderkey") % 3 == 1, F.lit("raw  form")).otherwise(""),
        F.create_map(F.lit("semantic"), F.when(F.col("o_orderkey") % 5 != 0, F.col("o_orderstatus"))),
    )
    questions = o.select(F.col("o_orderkey").alias("image_id"), F.col("o_orderkey").alias("question_id"), program.alias("program"))
    d = P.image_corpus(questions, scenes)
    return d.select("image_id", F.md5(F.col("text").cast("binary")).alias("text_md5"), "questions", "has_scene")


def full_golds(spark: SparkSession, sf_dir: str) -> DataFrame:
    full = F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderpriority")).when(F.col("o_orderkey") % 3 == 1, F.concat(F.lit("It is "), "o_orderpriority"))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.array_join(P.golds(F.col("o_orderpriority"), full), "|").alias("golds"))


def top_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.answer_statistics(table(spark, sf_dir, "orders").select(F.concat_ws("/", "o_orderpriority", "o_orderstatus").alias("answer")))


def wanted_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    images = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("image_id"), F.concat_ws("-", F.lpad(F.col("l_orderkey").cast("string"), 9, "0"), F.col("l_linenumber").cast("string"), F.col("l_suppkey").cast("string")).alias("source"), F.when(F.col("l_linenumber") > 1, F.col("l_returnflag").cast("binary")).alias("content"))
    found = P.wanted_images(images, table(spark, sf_dir, "part").where("p_size > 25").select(F.col("p_partkey").alias("image_id")))
    return found.select("image_id", "source")


def chosen_instructions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """200 distinct questions by hash order (the feature)."""
    rows = table(spark, sf_dir, "lineitem").select(F.when(F.col("l_linenumber") != 7, F.col("l_orderkey").cast("string")).alias("id"), F.lit("i").alias("imageId"))
    return P.chosen_instructions(rows, 200).select("id")


QUERIES = {
    f.__name__: f
    for f in (
        annotated_queries, page_chunks, pages_to_fetch, entity_image_urls, attached_images, image_manifests, choice_questions, unseen_images, entity_documents, paired_questions, scene_documents, full_golds,
        top_answers, wanted_images, chosen_instructions, visual_questions, semantic_types,
    )
}

_IMAGES = """i AS (SELECT lpad(c_custkey::VARCHAR, 9, '0') AS image_id, CASE WHEN c_custkey % 5 = 0 THEN [] ELSE ['Name ' || c_nationkey, c_mktsegment] END AS entities,
 CASE WHEN c_custkey % 4 = 0 THEN [] ELSE ['Q' || c_nationkey, 'S' || c_mktsegment] END AS qids, 'caption ' || (c_custkey % 3) AS caption, c_name, c_mktsegment, c_custkey FROM customer)"""
ORACLE_SQL = {
    "visual_questions": """WITH p AS (SELECT *, [p_type, p_brand, p_size::VARCHAR, 'none'] AS c, (p_partkey % 4)::INT AS k FROM part)
SELECT 'mrag-' || p_partkey AS query_id, md5(p_name || chr(10) || 'Choices: A. ' || c[1] || '; B. ' || c[2] || '; C. ' || c[3] || '; D. ' || c[4] || '|' || c[k + 1] || '|' || chr(65 + k) || '|' || chr(65 + k) || '. ' || c[k + 1]) AS body_md5, 'img/' || p_partkey AS image_path, p_type AS scenario FROM p""",
    "semantic_types": "SELECT CASE WHEN o_orderstatus <> 'O' THEN o_orderpriority END AS value, count(*) AS n FROM orders GROUP BY 1",
    "chosen_instructions": "SELECT id FROM (SELECT DISTINCT l_orderkey::VARCHAR AS id FROM lineitem WHERE l_linenumber <> 7) ORDER BY md5('0:' || id), id LIMIT 200",
    "annotated_queries": """WITH a AS (SELECT o_orderkey AS k, o_orderkey::VARCHAR AS data_id, 'img' || (o_orderkey % 300) AS image_id, o_orderpriority AS question,
 CASE WHEN k % 5 = 0 THEN [] WHEN k % 5 <> 1 THEN [o_orderstatus, k::VARCHAR] END AS answer, CASE WHEN k % 3 = 0 THEN ['eval'] WHEN k % 3 = 1 THEN [] END AS ae, CASE WHEN k % 2 = 0 THEN 'val' END AS ds FROM orders),
b AS (SELECT (o_orderkey // 2 * 2)::VARCHAR AS data_id, 'Q' || o_custkey AS entity_id, o_orderstatus AS entity_text FROM orders QUALIFY row_number() OVER (PARTITION BY o_orderkey // 2 ORDER BY o_orderkey DESC) = 1),
f AS (SELECT 'img' || (p_partkey % 150) AS stem, min('dir/' || p_partkey || '.jpg') AS path FROM part GROUP BY 1)
SELECT data_id AS query_id, question, array_to_string(CASE WHEN len(ae) > 0 THEN ae WHEN len(answer) > 0 THEN answer ELSE [] END, '|') AS golds, path AS image_path, coalesce(ds, '') AS data_split, entity_id, entity_text
FROM a LEFT JOIN b USING (data_id) LEFT JOIN f ON f.stem = a.image_id""",
    "page_chunks": """WITH RECURSIVE p AS (SELECT 'Q' || doc_id AS e, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '') AS ps FROM documents WHERE doc_id % 7 <> 0 AND doc_id IN (SELECT doc_id FROM labels)),
r AS (SELECT e, ps, 1 AS i, 0 AS chunk, length(ps[1]) AS size FROM p WHERE len(ps) > 0
UNION ALL SELECT e, ps, i + 1, CASE WHEN size + length(ps[i + 1]) + 1 > 400 THEN chunk + 1 ELSE chunk END, CASE WHEN size + length(ps[i + 1]) + 1 > 400 THEN length(ps[i + 1]) ELSE size + 1 + length(ps[i + 1]) END FROM r WHERE i < len(ps)),
c AS (SELECT e, chunk, max(size) AS n FROM r GROUP BY 1, 2) SELECT e AS entity_id, count(*) AS n_chunks, sum(n)::BIGINT AS n_chars, max(n)::BIGINT AS longest FROM c GROUP BY 1""",
    "pages_to_fetch": """SELECT 'Q' || d.doc_id AS entity_id, CASE WHEN quality = 1 THEN 'known' ELSE lang END AS title FROM documents d LEFT JOIN labels USING (doc_id) WHERE d.doc_id % 7 = 0 OR text = ''""",
    "entity_image_urls": """WITH n AS (SELECT p_partkey AS k FROM part WHERE p_size < 20),
c AS (SELECT o_custkey AS k, o_orderstatus AS title, o_orderkey::VARCHAR AS url FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) = 1),
r AS (SELECT l_partkey AS k, l_returnflag AS title, l_orderkey || '/' || l_suppkey AS url FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber, l_suppkey) = 1)
SELECT k::VARCHAR AS entity_id, coalesce(c.title, r.title) AS title, coalesce(c.url, r.url) AS image_url FROM n LEFT JOIN c USING (k) LEFT JOIN r USING (k) WHERE coalesce(c.url, r.url) IS NOT NULL""",
    "attached_images": """SELECT 'E' || (conv_id % 50) || '_p' || conv_id || '_' || turn AS doc_id, role AS title, n_name || '.png' AS image_path, 'E' || (conv_id % 50) AS entity_id FROM conversations LEFT JOIN nation ON n_nationkey * 2 = conv_id % 50""",
    "image_manifests": """SELECT p_partkey AS image_id, p_name AS source_path, s_name AS path, left(trim(regexp_replace(p_partkey || '_' || p_name, '[^A-Za-z0-9]+', '_', 'g'), '_'), 120) AS stem FROM part LEFT JOIN supplier ON s_suppkey = p_partkey""",
    "choice_questions": """WITH r AS (SELECT *, p_partkey AS k, row_number() OVER (ORDER BY p_partkey % 3, lpad(p_partkey::VARCHAR, 12, '0')) - 1 AS i, [p_type, p_brand, p_size::VARCHAR] AS c FROM part WHERE p_partkey % 4 <> 0 AND length(p_brand) > 0),
x AS (SELECT *, p_name || chr(10) || 'Choices: A. ' || c[1] || '; B. ' || c[2] || '; C. ' || c[3] AS q, c[k % 3 + 1] AS a, chr((65 + k % 3)::INT) AS le, CASE WHEN k % 2 = 0 THEN 'a hint' END AS hint, CASE WHEN k % 5 = 0 THEN 'a lecture' END AS lecture FROM r)
SELECT 'scienceqa-smoke-' || i AS id, md5(q || '|' || a || '|' || le || '|' || le || '. ' || a) AS body_md5, ['train', 'validation', 'test'][k % 3 + 1] AS split FROM x
UNION ALL SELECT 'scienceqa-' || i || '-lecture', md5('Science lesson ' || (i + 1) || '|' || coalesce(lecture, hint, q)), NULL FROM x
UNION ALL SELECT 'scienceqa-' || i || '-hint', md5('Question context ' || (i + 1) || '|' || coalesce(hint, 'Use the pictured scientific evidence.')), NULL FROM x""",
    "unseen_images": """WITH d AS (SELECT doc_id, text, doc_id || '_' || source || '.jpg' AS name FROM documents WHERE doc_id % 10 <> 0 AND doc_id % 9 <> 0 AND text NOT IN (SELECT text FROM documents WHERE doc_id % 10 = 0)),
l AS (SELECT name, array_to_string(list_filter(regexp_extract_all(regexp_replace(replace(name, '.jpg', ''), '[_+%./\\\\-]+', ' ', 'g'), '[A-Za-z0-9]+'), lambda t: (length(t) > 1 OR regexp_full_match(t, '[0-9]')) AND NOT regexp_full_match(t, '[0-9]{5,}')), ' ') AS label FROM d)
SELECT name, label FROM l""",
    "entity_documents": f"""WITH {_IMAGES}, n AS (SELECT image_id, caption, CASE WHEN len(qids) > 0 THEN qids ELSE ['kvqa-image-' || image_id] END AS q, entities FROM i),
m AS (SELECT image_id, caption, q, CASE WHEN len(entities) > 0 THEN entities ELSE list_transform(q, lambda x: '') END AS e FROM n),
z AS (SELECT image_id, caption, p, q[p] AS doc_id, e[p] AS name FROM m, unnest(range(1, 3)) AS t(p) WHERE p <= least(len(q), len(e))),
f AS (SELECT doc_id, arg_min(name, image_id || p) AS name FROM z GROUP BY 1), c AS (SELECT doc_id, caption, min(image_id || p) AS at1 FROM z GROUP BY 1, 2),
g AS (SELECT doc_id, string_agg(caption, ' ' ORDER BY at1) AS caps FROM c GROUP BY 1)
SELECT doc_id, coalesce(nullif(name, ''), doc_id) AS title, 'Entity name: ' || coalesce(nullif(name, ''), doc_id) || '. Wiki caption: ' || caps || ' Wikidata QID: ' || doc_id || '.' AS text FROM f JOIN g USING (doc_id)""",
    "paired_questions": f"""WITH {_IMAGES} SELECT 'kvqa-' || image_id || '-00' AS query_id, 'who?' AS question, c_mktsegment AS golds, 't0' AS type FROM i UNION ALL SELECT 'kvqa-' || image_id || '-01', c_name, c_custkey::VARCHAR, NULL FROM i""",
    "scene_documents": """WITH o0 AS (SELECT l_orderkey AS k, lpad(l_linenumber::VARCHAR, 2, '0') || '-' || l_partkey AS id, 'part ' || l_partkey AS name, l_partkey, min([l_returnflag, l_linestatus]) AS att FROM lineitem GROUP BY 1, 2, 3, 4),
o1 AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY id) AS n FROM o0), ob AS (SELECT * FROM o1 WHERE n <= 80),
p AS (SELECT k, string_agg(name || ' with attributes ' || att[1] || ', ' || att[2] || '.', ' ' ORDER BY id) AS plain FROM ob GROUP BY 1),
t AS (SELECT a.k, string_agg(a.name || ' left of ' || coalesce(b.name, '01-' || a.l_partkey) || '.', ' ' ORDER BY a.id) AS ties FROM ob a LEFT JOIN ob b ON a.k = b.k AND b.id = '01-' || a.l_partkey GROUP BY 1),
s AS (SELECT p.k, plain || ' ' || ties AS scene FROM p JOIN t USING (k)),
q AS (SELECT o_orderkey AS k, array_to_string(list_concat(CASE WHEN o_orderkey % 3 = 0 THEN ['select: ' || o_orderpriority, 'verify'] WHEN o_orderkey % 3 = 1 THEN ['raw form'] ELSE [] END, CASE WHEN o_orderkey % 5 <> 0 THEN ['question_type: semantic=' || o_orderstatus] ELSE [] END), '. ') AS pr FROM orders),
g AS (SELECT k, string_agg(CASE WHEN pr <> '' THEN pr END, ' ') AS pr, count(*) AS n FROM q GROUP BY 1)
SELECT g.k AS image_id, md5(coalesce(scene, pr, 'Visual scene without a description.')) AS text_md5, n AS questions, scene IS NOT NULL AS has_scene FROM g LEFT JOIN s USING (k)""",
    "full_golds": "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 1 THEN o_orderpriority || '|It is ' || o_orderpriority ELSE o_orderpriority END AS golds FROM orders",
    "top_answers": "SELECT o_orderpriority || '/' || o_orderstatus AS answer, count(*) AS n FROM orders GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20",
    "wanted_images": "SELECT l_partkey AS image_id, min(lpad(l_orderkey::VARCHAR, 9, '0') || '-' || l_linenumber || '-' || l_suppkey) AS source FROM lineitem WHERE l_linenumber > 1 AND length(l_returnflag) > 0 AND l_partkey IN (SELECT p_partkey FROM part WHERE p_size > 25) GROUP BY 1",
}
