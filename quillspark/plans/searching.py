"""Tree-search and evaluation queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import keyword_query
from ..operators import evaluation as E
from ..operators import quality as Q
from ..operators import retrieval as R
from ..operators import search as M
from .common import first_and_rest, sql_first_and_rest, table
from .labelling import conversation_steps, event_steps


def tree_backup(spark: SparkSession, sf_dir: str) -> DataFrame:
    steps = event_steps(spark, sf_dir)
    leaves = steps.groupBy("query_id", "traj_id").agg(F.array_sort(F.collect_list(F.struct("step_index", "action_type"))).alias("s"), F.max("outcome").alias("reward"))
    leaves = leaves.select("query_id", "reward", F.transform("s", lambda s: s["action_type"]).alias("path"))
    n = M.backed_up(leaves)
    return n.select("query_id", F.array_join("path", ">").alias("path"), "visits", F.round("total", 6).alias("total"), F.round("q", 6).alias("q"))


def _children(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Children of a customer's node are order priorities; visits are finished orders."""
    o = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("parent"), F.col("o_orderpriority").alias("child"))
    done = F.col("o_orderstatus") == "F"
    return o.agg(F.count_if(done).alias("visits"), F.count_if(done & (F.col("o_totalprice") > 200000)).cast("double").alias("total")).select(
        "*", F.substring("child", 1, 1).cast("int").alias("position"), (F.length("child") / F.lit(20.0)).alias("prior")
    )


def best_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = M.best_children(_children(spark, sf_dir).withColumn("total", F.round("total", 6)))
    return b.select("parent", "child", F.round("uct", 6).alias("uct"))


def most_visited_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.most_visited(_children(spark, sf_dir))


def kept_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.kept_children(_children(spark, sf_dir), 2).select("parent", "child", "place")


def _rollouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A supplier's line items are its rollouts."""
    l = table(spark, sf_dir, "lineitem")  # noqa: E741
    t = F.expr("row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice) - 1")
    return l.select(F.col("l_suppkey").alias("query_id"), t.alias("t"), F.round(F.col("l_discount") * 10, 3).alias("reward"), F.concat_ws(",", "l_returnflag", "l_linestatus", F.col("l_linenumber").cast("string")).alias("actions"))


def stopped_rollouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.until_stop(_rollouts(spark, sf_dir), 0.95).select("query_id", "t", "reward")


def best_rollouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.best_rollouts(_rollouts(spark, sf_dir))


def distinct_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.distinct_sequences(_rollouts(spark, sf_dir)).select("query_id", "t", "actions", "traj_id")


def _states(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("question"), "source")
    k = F.col("doc_id") % 4
    direct = M.action("text_search", F.col("question"))
    taken = F.when(k == 1, F.array(direct)).when(k == 2, F.array(direct, M.action("image_search"))).when(k == 3, F.array(direct, M.action("text_search", keyword_query(F.col("question"))), M.action("image_search")))
    return d.select("doc_id", "question", "source", (F.col("doc_id") % 3 != 0).alias("has_image"), (k > 0).alias("has_evidence"), F.coalesce(taken, F.array().cast(M.ACTION)).alias("taken"))


def seed_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Uses of action types over all seeds, of records that are tagged with the seed of their run."""
    runs = {n: _records(spark, sf_dir).where(F.col("seed") == n).drop("seed") for n in range(1, 8)}
    return E.usage_totals(E.tagged_runs(runs))


def sample_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as samples, user days as trajectories."""
    s = Q.sample_statistics(event_steps(spark, sf_dir), 3)
    return s.select("samples", "trajectories", "orphans", F.array_join(F.transform(F.map_entries("types"), lambda e: F.concat_ws(":", e["key"], e["value"].cast("string"))), ",").alias("types"))


def _shown(actions) -> F.Column:
    return F.array_join(F.transform(actions, lambda a: F.concat_ws(":", a["type"], F.md5(F.coalesce(a["query"], a["text"], F.lit("")).cast("binary")))), ",")


def heuristic_proposals(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = M.heuristic_actions(F.col("question"), F.col("has_image"), F.col("has_evidence"), F.col("taken"), F.col("source"), 3)
    return _states(spark, sf_dir).select("doc_id", _shown(a).alias("actions"))


def gated_proposals(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = M.heuristic_actions(F.col("question"), F.col("has_image"), F.col("has_evidence"), F.col("taken"), F.col("source"), 6)
    s = _states(spark, sf_dir).withColumn("proposed", a)  # of which every gate takes its own
    types = lambda b, mode: F.array_join(F.transform(M.gated_actions(F.col("proposed"), F.concat(F.lit("Identify "), F.col("question")), F.col("has_image"), F.col("has_evidence"), 4, b, mode, 3), lambda x: x["type"]), ",")
    return s.select("doc_id", types("infoseek", "heuristic").alias("infoseek"), types("science-qa", "strict").alias("scienceqa"), types("", "dataset").alias("plain"), types("scienceqa", "off").alias("off"))


def policy_proposals(spark: SparkSession, sf_dir: str) -> DataFrame:
    replies = ['{"type": "answer", "text": "Rome"}', '```\n{"type": "text_search", "query": "q"}\n{"type": "image_search"}\n```', "nothing", '{"type": "image_search"}\n{"type": "dance"}\n{broken}']
    reply = F.element_at(F.array(*map(F.lit, replies)), (F.expr("doc_id div 4") % 4 + 1).cast("int"))
    s = _states(spark, sf_dir)
    fallback = M.heuristic_actions(F.col("question"), F.col("has_image"), F.col("has_evidence"), F.col("taken"), F.lit("?"), 4)
    titles = F.when(F.col("has_evidence"), F.array("source")).otherwise(F.array().cast("array<string>"))
    a = M.completed_actions(M.parsed_actions(reply, F.col("has_image")), fallback, F.col("question"), F.col("has_image"), titles, F.col("has_evidence"), F.col("taken"), 4)
    s = s.select("doc_id", a.alias("a"))
    return s.select("doc_id", F.array_join(F.transform("a", lambda x: x["type"]), ",").alias("types"), _shown(F.col("a")).alias("actions"))


def parsed_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replies with regions, and with a text search for the text's first line, which must be the question or its source word for word."""
    first, _ = first_and_rest()
    d = table(spark, sf_dir, "documents").select("doc_id", "text", "source", first.alias("line"))
    region = F.when(F.col("doc_id") % 3 == 0, F.lit(', "region": [0.25, 0.5, 0.75, 1]')).when(F.col("doc_id") % 3 == 1, F.lit(', "region": []')).otherwise("")
    asked = F.when(F.col("doc_id") % 2 == 0, F.col("line")).otherwise(F.concat(F.lit("  "), F.col("source"), F.lit(" ")))
    line = F.to_json(F.struct(F.lit("text_search").alias("type"), asked.alias("query")))
    reply = F.concat(F.lit("```\n"), line, F.lit('\n{"type": "image_search"'), region, F.lit("}\n```"))
    a = M.parsed_actions(reply, F.col("doc_id") % 5 != 0, lambda q: M.frozen_query(q, F.col("text"), F.array("source")))
    shown = lambda x: F.concat_ws(":", x["type"], F.md5(x["query"].cast("binary")), F.array_join(F.transform(x["region"], lambda v: F.format_number(v, 2)), "/"))
    return d.select("doc_id", F.array_join(F.transform(a, shown), ",").alias("actions"))


def search_trajectories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders are rollouts of their customers' searches, nations and regions what these find."""
    c = table(spark, sf_dir, "customer")
    one = lambda name, kind, query, region: F.struct(F.lit(name).alias("name"), F.lit(kind).alias("type"), query.cast("string").alias("query"), F.lit(None).cast("string").alias("image_path"), region.cast("array<double>").alias("region"))
    none = F.lit(None)
    queries = c.select(
        F.col("c_custkey").alias("query_id"), F.col("c_name").alias("question"), F.concat(F.lit("img/"), F.col("c_custkey").cast("string")).alias("image_path"), F.array("c_mktsegment").alias("gold_answers"),
        F.array(one("direct", "text_search", F.col("c_name"), none), one("image", "image_search", none, F.when(F.col("c_custkey") % 2 == 0, F.array(*map(F.lit, (0.0, 0.25, 1.0, 0.5)))))).alias("searches"),
    )
    place = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")) - 1
    found = F.when(F.col("o_orderstatus") == "F", F.lit("image,direct,answer")).when(F.col("o_orderstatus") == "O", F.lit("direct,answer")).otherwise("answer")
    answer = F.when(F.col("o_orderkey") % 3 == 0, F.lit("building")).otherwise("The machinery!")
    rollouts = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("query_id"), place.alias("t"), found.alias("actions"), answer.alias("answer"), F.round("o_totalprice", 2).alias("reward"))
    hit = lambda name, rank, doc, title, kind: c.join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select(
        F.col("c_custkey").alias("query_id"), F.lit(name).alias("action"), F.lit(rank).alias("rank"), doc.cast("string").alias("doc_id"), title.alias("title"), F.col("c_mktsegment").alias("text"), F.lit(None).cast("string").alias("image_path"), F.lit(0.5).alias("score"), F.lit(kind).alias("modality")
    )
    hits = hit("direct", 1, F.col("n_nationkey"), F.col("n_name"), "text").unionByName(hit("direct", 2, F.col("n_regionkey") + 100, F.lit(""), "text")).unionByName(hit("image", 1, F.col("n_nationkey") + 200, F.col("n_name"), "image"))
    t = M.trajectories(queries, rollouts, hits)
    text = lambda x: F.coalesce(x, F.lit("-"))
    seen = lambda s: F.array_join(F.transform(s["evidence"], lambda e: F.concat_ws("/", e["evidence_id"], e["doc_id"], e["title"], e["text"], e["result_modality"])), "+")
    region = lambda s: text(F.array_join(F.transform(s["region"], lambda v: F.format_number(v, 2)), "/"))
    steps = F.array_join(F.transform("steps", lambda s: F.concat_ws("|", s["step_index"].cast("string"), s["action_type"], s["action_input"], region(s), text(s["image_path"]), seen(s))), ";")
    return t.select("traj_id", "question", "image_path", "rollout_t", "gen_reward", "final_answer", "outcome_em", steps.alias("steps"))


def searches(spark: SparkSession, sf_dir: str, config: M.SearchConfig = M.SearchConfig()) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("title"), "text")
    q = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("question"))
    words = q.withColumn("words", keyword_query(F.col("question")))
    has = (F.col("words") != "") & (F.col("words") != F.col("question"))
    # both forms of a question are asked in one pass
    form = lambda name, question: [F.struct(F.col("query_id"), F.lit(name).alias("action")).alias("query_id"), F.col(question).alias("question")]
    asked = q.select(*form("direct", "question")).unionByName(words.where(has).select(*form("keywords", "words")))
    hits = R.bm25_top_k(docs, asked, 3).select("query_id.query_id", "query_id.action", "rank", "doc_id")
    hits = hits.join(docs, "doc_id").select("query_id", "action", "rank", "title", "text")
    queries = words.select("query_id", "question", F.lit(False).alias("has_image"), has.alias("keywords"))
    return M.tree_search(queries, hits, config)


def tree_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rollouts of the benchmark's questions over BM25 hits (a state machine, not expressible in SQL)."""
    return searches(spark, sf_dir)


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line numbers are seeds, line items the searched queries."""
    kinds = F.when(F.col("l_returnflag") == "A", F.array(F.lit("text_search"), F.lit("answer"))).when(F.col("l_returnflag") == "N", F.array(F.lit("image_search"), F.lit("text_search"), F.lit("answer"))).otherwise(F.array(F.lit("answer")))
    return table(spark, sf_dir, "lineitem").select(F.col("l_linenumber").alias("seed"), (F.col("l_discount") > 0.045).cast("double").alias("outcome"), F.col("l_quantity").alias("rollouts"), F.col("l_tax").alias("best_reward"), kinds.alias("actions"))


def run_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _records(spark, sf_dir)
    s = E.run_summary(r).join(E.action_usage(r).groupBy("seed").pivot("action", ["answer", "image_search", "text_search"]).agg(F.first("uses")), "seed")
    return s.select("seed", "n", *[F.round(c, 6).alias(c) for c in ("accuracy", "mean_rollouts", "mean_best_reward")], "answer", "image_search", "text_search")


def seed_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = E.seed_aggregate(E.run_summary(_records(spark, sf_dir)))
    per = F.array_join(F.transform("accuracy_per_seed", lambda x: F.format_number(x, 6)), ",")
    return s.select("seeds", F.round("accuracy", 6).alias("accuracy"), F.round("accuracy_std", 6).alias("accuracy_std"), per.alias("accuracy_per_seed"), F.round("mean_rollouts", 6).alias("mean_rollouts"))


def inspected_trajectories(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.labels import trajectory_rows

    t = E.inspected(trajectory_rows(conversation_steps(spark, sf_dir)), action_type="image_search", query_id="q3")
    return t.select("traj_id", F.size("steps").cast("long").alias("steps"))


def usage_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.labels import trajectory_rows

    return E.usage_counts(trajectory_rows(conversation_steps(spark, sf_dir)))


def gold_hints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order priorities are questions, customers' segments what is asked: the last query of a question gives the hint."""
    queries = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("query_id"), F.col("o_orderpriority").alias("question"), F.array(F.col("o_orderkey").cast("string")).alias("gold_answers"))
    asked = table(spark, sf_dir, "customer").select("c_custkey", F.when(F.col("c_custkey") % 3 == 0, "1-URGENT").when(F.col("c_custkey") % 3 == 1, "5-LOW").otherwise("?").alias("question"))
    return E.with_gold_hints(asked, queries).select("c_custkey", "question", F.array_join("hint", "|").alias("hint"))


def token_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Union, intersection, difference, multiset overlap and ordered distinct of the words of a document's first line and of the rest."""
    first, rest = (F.split(F.lower(c), " ") for c in first_and_rest())
    d = table(spark, sf_dir, "documents").select("doc_id", first.alias("a"), rest.alias("b"))
    n = lambda c, name: F.size(c).cast("long").alias(name)
    return d.select(
        "doc_id", n(F.array_union("a", "b"), "n_union"), n(F.array_intersect("a", "b"), "n_both"), n(F.array_except("a", "b"), "n_only"),
        E.multiset_overlap(F.col("a"), F.col("b")).cast("long").alias("n_overlap"), F.md5(F.array_join(F.array_distinct("a"), " ").cast("binary")).alias("ordered_md5"),
    )


def seeded_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sample of 100 (the feature) by hash order."""
    return E.sampled(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", 100, seed=3)


QUERIES = {
    f.__name__: f
    for f in (
        parsed_replies, search_trajectories, tree_backup, best_children, most_visited_children, kept_children, stopped_rollouts, best_rollouts, distinct_sequences, heuristic_proposals, gated_proposals, policy_proposals,
        tree_search, run_summaries, seed_usage, sample_statistics, seed_aggregate, inspected_trajectories, usage_counts, gold_hints, token_sets, seeded_sample,
    )
}

_KIDS = """k AS (SELECT o_custkey AS parent, o_orderpriority AS child, count(*) FILTER (o_orderstatus = 'F') AS visits, count(*) FILTER (o_orderstatus = 'F' AND o_totalprice > 200000)::DOUBLE AS total,
 left(o_orderpriority, 1)::INT AS position, length(o_orderpriority) / 20e0 AS prior FROM orders GROUP BY 1, 2)"""
_ROLL = """r AS (SELECT l_suppkey AS query_id, (row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice) - 1)::INT AS t, round(l_discount * 10, 3) AS reward,
 concat_ws(',', l_returnflag, l_linestatus, l_linenumber::VARCHAR) AS actions FROM lineitem)"""
_STATES = """kw AS (SELECT doc_id, source, text AS q FROM documents),
st AS (SELECT doc_id, source, q, array_to_string(list_filter(regexp_extract_all(q, '[A-Za-z0-9'']+'), lambda t: not list_contains(['a','an','the','in','on','at','of','to','is','are','was','were','which','what','who','whom','whose','where','when','how','name','can','be','found','located','does','do','did'], lower(t))), ' ') AS w,
 doc_id % 3 <> 0 AS img, doc_id % 4 > 0 AS ev, doc_id % 4 AS k FROM kw),
ca AS (SELECT *, list_filter([CASE WHEN k = 0 THEN {'t': 'text_search', 'v': q} END, CASE WHEN w <> '' AND w <> q AND k <> 3 THEN {'t': 'text_search', 'v': w} END, CASE WHEN img AND k < 2 THEN {'t': 'image_search', 'v': ''} END], lambda x: x IS NOT NULL) AS c FROM st)"""


def _proposals(k: int) -> str:
    return f"(CASE WHEN (ev OR len(c) = 0) AND len(c) < {k} THEN list_append(c, {{'t': 'answer', 'v': source}}) ELSE c END)[1:{k}]"


_FMT = "array_to_string(list_transform({}, lambda x: x.t || ':' || md5(x.v)), ',')"
_USE = "(SELECT unnest(CASE l_returnflag WHEN 'A' THEN ['text_search', 'answer'] WHEN 'N' THEN ['image_search', 'text_search', 'answer'] ELSE ['answer'] END) AS a, l_linenumber AS seed FROM lineitem)"
_CONV = """c AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1 AS i, count(*) OVER (PARTITION BY conv_id) - 1 AS m FROM conversations),
s AS (SELECT conv_id, CASE WHEN i = m THEN 'answer' WHEN i % 3 = 1 THEN 'image_search' ELSE 'text_search' END AS a FROM c)"""
ORACLE_SQL = {
    "seed_usage": f"SELECT a AS action, count(*) AS uses FROM {_USE} WHERE seed BETWEEN 1 AND 7 GROUP BY 1",
    "sample_statistics": """WITH t AS (SELECT strftime(ts, '%Y-%m-%d') AS d, user_id, count(*) AS n FROM events GROUP BY 1, 2), k AS (SELECT event_type AS e, count(*) AS n FROM events GROUP BY 1)
SELECT (SELECT sum(n) FROM t)::BIGINT AS samples, (SELECT count(*) FROM t) AS trajectories, (SELECT count(*) FROM t WHERE n < 3) AS orphans, (SELECT string_agg(e || ':' || n, ',' ORDER BY e) FROM k) AS types""",
    "seeded_sample": "SELECT doc_id FROM documents ORDER BY md5('3:' || doc_id), doc_id LIMIT 100",
    "parsed_replies": f"""WITH d AS (SELECT doc_id, text, source, {sql_first_and_rest("line", "rest")} FROM documents), q AS (SELECT *, CASE WHEN doc_id % 2 = 0 THEN line ELSE source END AS asked FROM d),
f AS (SELECT *, CASE WHEN trim(asked, chr(32) || chr(9) || chr(13)) = trim(text, chr(32) || chr(9) || chr(10) || chr(13)) AND asked <> '' THEN text WHEN trim(asked, chr(32) || chr(9) || chr(13)) = source THEN source ELSE text END AS query FROM q)
SELECT doc_id, concat_ws(',', CASE WHEN asked <> '' THEN 'text_search:' || md5(query) END, CASE WHEN doc_id % 5 <> 0 THEN 'image_search' || CASE WHEN doc_id % 3 = 0 THEN ':0.25/0.50/0.75/1.00' ELSE '' END END) AS actions FROM f""",
    "search_trajectories": """WITH r AS (SELECT o_custkey AS k, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS t, CASE o_orderstatus WHEN 'F' THEN ['image', 'direct', 'answer'] WHEN 'O' THEN ['direct', 'answer'] ELSE ['answer'] END AS a,
 CASE WHEN o_orderkey % 3 = 0 THEN 'building' ELSE 'The machinery!' END AS ans, round(o_totalprice, 2) AS reward FROM orders),
s AS (SELECT k, t, reward, ans, i - 1 AS i, a[i] AS name FROM r, unnest(range(1, len(a) + 1)) AS u(i)),
c AS (SELECT c_custkey AS k, c_name, c_mktsegment, n_nationkey AS n, n_regionkey AS g, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey),
h AS (SELECT k, 'direct' AS name, 1 AS rank, n AS doc, n_name AS title, c_mktsegment AS text, 'text' AS m FROM c UNION ALL SELECT k, 'direct', 2, g + 100, '', c_mktsegment, 'text' FROM c UNION ALL SELECT k, 'image', 1, n + 200, n_name, c_mktsegment, 'image' FROM c),
e AS (SELECT s.k, s.t, s.i, rank, concat_ws('/', 'e' || (row_number() OVER (PARTITION BY s.k, s.t ORDER BY s.i, rank) - 1), doc, title, text, m) AS x FROM s JOIN h USING (k, name)),
v AS (SELECT k, t, i, string_agg(x, '+' ORDER BY rank) AS x FROM e GROUP BY 1, 2, 3),
w AS (SELECT s.k, s.t, string_agg(concat_ws('|', s.i, CASE name WHEN 'direct' THEN 'text_search' WHEN 'image' THEN 'image_search' ELSE 'answer' END, CASE name WHEN 'direct' THEN c_name WHEN 'image' THEN 'image_search' ELSE ans END,
 CASE WHEN name = 'image' AND s.k % 2 = 0 THEN '0.00/0.25/1.00/0.50' ELSE '-' END, CASE WHEN name = 'image' THEN 'img/' || s.k ELSE '-' END, coalesce(x, '')), ';' ORDER BY s.i) AS steps FROM s JOIN c USING (k) LEFT JOIN v ON v.k = s.k AND v.t = s.t AND v.i = s.i GROUP BY 1, 2)
SELECT r.k || '#t' || r.t AS traj_id, c_name AS question, 'img/' || r.k AS image_path, r.t::INT AS rollout_t, reward AS gen_reward, ans AS final_answer,
 (lower(c_mktsegment) = CASE WHEN ans = 'building' THEN 'building' ELSE 'machinery' END)::INT::DOUBLE AS outcome_em, steps FROM r JOIN c USING (k) JOIN w ON w.k = r.k AND w.t = r.t""",
    "tree_backup": """WITH t AS (SELECT strftime(ts, '%Y-%m-%d') AS q, user_id, list(event_type ORDER BY ts, event_id) AS p, max((event_type = 'purchase')::INT::DOUBLE) AS r FROM events GROUP BY 1, 2),
u AS (SELECT q, r, p[1:n] AS p FROM t, unnest(range(0, len(p) + 1)) AS x(n))
SELECT q AS query_id, array_to_string(p, '>') AS path, count(*) AS visits, round(sum(r), 6) AS total, round(sum(r) / count(*), 6) AS q FROM u GROUP BY u.q, u.p""",
    "best_children": f"""WITH {_KIDS}, u AS (SELECT *, CASE WHEN visits > 0 THEN total / visits ELSE prior END AS q, sum(visits) OVER (PARTITION BY parent) AS pv FROM k),
s AS (SELECT *, CASE WHEN visits = 0 THEN 1e6 + q ELSE q + sqrt(ln(greatest(pv, 1)::DOUBLE) / visits) END AS uct FROM u)
SELECT parent, child, round(uct, 6) AS uct FROM s QUALIFY row_number() OVER (PARTITION BY parent ORDER BY uct DESC, position) = 1""",
    "most_visited_children": f"WITH {_KIDS} SELECT parent, child, visits FROM k QUALIFY row_number() OVER (PARTITION BY parent ORDER BY visits DESC, position) = 1",
    "kept_children": f"WITH {_KIDS} SELECT parent, child, (row_number() OVER (PARTITION BY parent ORDER BY prior DESC, position))::INT AS place FROM k QUALIFY place <= 2",
    "stopped_rollouts": f"WITH {_ROLL} SELECT query_id, t, reward FROM r QUALIFY coalesce(bool_or(reward >= 0.95) OVER (PARTITION BY query_id ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) = false",
    "best_rollouts": f"WITH {_ROLL}, n AS (SELECT *, count(*) OVER (PARTITION BY query_id) AS rollouts FROM r) SELECT query_id, t, reward, rollouts FROM n QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY reward DESC, t) = 1",
    "distinct_sequences": f"""WITH {_ROLL}, o AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY query_id, actions ORDER BY t) = 1)
SELECT query_id, t, actions, query_id || '#t' || (row_number() OVER (PARTITION BY query_id ORDER BY t) - 1) AS traj_id FROM o""",
    "heuristic_proposals": f"WITH {_STATES} SELECT doc_id, {_FMT.format(_proposals(3))} AS actions FROM ca",
    "gated_proposals": f"""WITH {_STATES}, p AS (SELECT doc_id, img, ev, q, list_transform({_proposals(6)}, lambda x: x.t) AS a FROM ca),
g AS (SELECT *, list_filter(a, lambda x: x = 'text_search') AS tx, list_filter(a, lambda x: x = 'image_search') AS im, list_filter(a, lambda x: x = 'answer') AS an,
 len(list_filter(['passage', 'weather', 'climate', 'expected ratio', 'offspring', 'experiment', 'best answer', 'select the best'], lambda w: contains(lower(q), w))) > 0 AS told FROM p)
SELECT doc_id, array_to_string(list_concat(CASE WHEN img AND NOT told THEN im ELSE [] END, list_concat(tx, an))[1:3], ',') AS infoseek, array_to_string(list_concat(tx, an)[1:3], ',') AS scienceqa,
 array_to_string(list_concat(tx, list_concat(im, an))[1:3], ',') AS plain,
 array_to_string((CASE WHEN ev THEN list_concat(tx, list_concat(an, im)) ELSE list_concat(tx, list_concat(im, an)) END)[1:3], ',') AS off FROM g""",
    "run_summaries": f"""WITH s AS (SELECT l_linenumber AS seed, count(*) AS n, round(avg((l_discount > 0.045)::INT::DOUBLE), 6) AS accuracy, round(avg(l_quantity), 6) AS mean_rollouts, round(avg(l_tax), 6) AS mean_best_reward FROM lineitem GROUP BY 1),
u AS (SELECT seed, count(*) FILTER (a = 'answer') AS answer, count(*) FILTER (a = 'image_search') AS image_search, count(*) FILTER (a = 'text_search') AS text_search FROM {_USE} GROUP BY 1) SELECT * FROM s JOIN u USING (seed)""",
    "seed_aggregate": """WITH s AS (SELECT l_linenumber AS seed, avg((l_discount > 0.045)::INT::DOUBLE) AS a, avg(l_quantity) AS r FROM lineitem GROUP BY 1)
SELECT count(*) AS seeds, round(avg(a), 6) AS accuracy, round(coalesce(stddev_samp(a), 0e0), 6) AS accuracy_std, string_agg(format('{:.6f}', a), ',' ORDER BY seed) AS accuracy_per_seed, round(avg(r), 6) AS mean_rollouts FROM s""",
    "inspected_trajectories": f"WITH {_CONV} SELECT 'c' || conv_id AS traj_id, count(*) AS steps FROM s WHERE conv_id % 20 = 3 GROUP BY conv_id HAVING bool_or(a = 'image_search')",
    "usage_counts": f"WITH {_CONV} SELECT a AS action_type, count(*) AS n FROM s GROUP BY 1",
    "gold_hints": """WITH c AS (SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN '1-URGENT' WHEN 1 THEN '5-LOW' ELSE '?' END AS question FROM customer),
h AS (SELECT o_orderpriority AS question, max(o_orderkey)::VARCHAR AS hint FROM orders GROUP BY 1) SELECT c_custkey, question, hint FROM c LEFT JOIN h USING (question)""",
    "token_sets": """WITH l AS (SELECT doc_id, """ + sql_first_and_rest("x", "y") + """ FROM documents), t AS (SELECT doc_id, string_split(lower(x), ' ') AS a, string_split(lower(y), ' ') AS b FROM l)
SELECT doc_id, len(list_distinct(list_concat(a, b)))::BIGINT AS n_union, len(list_intersect(a, b))::BIGINT AS n_both, len(list_filter(list_distinct(a), lambda x: not list_contains(b, x)))::BIGINT AS n_only,
 coalesce(list_sum(list_transform(list_distinct(a), lambda t: least(len(list_filter(a, lambda x: x = t)), len(list_filter(b, lambda x: x = t))))), 0)::BIGINT AS n_overlap,
 md5(array_to_string(list_filter(a, lambda x, i: list_position(a, x) = i), ' ')) AS ordered_md5 FROM t""",
}
