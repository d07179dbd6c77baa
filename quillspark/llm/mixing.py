"""Mixing sources to target weights by hierarchical budgeting.

A tree domain - language - source has a weight at each node. A token budget flows from the root to the leaves in
proportion to the weights of siblings. A node can take no more than its leaves hold in ``max_epochs`` passes; what it
can't take goes to its siblings first, and only what no sibling can take goes back to their parent's siblings. A leaf
gives whole passes over its documents, then a prefix of one more pass in that pass's own seeded order.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import discard, materialize
from .common import text_key
from .packing import SLICE_ROWS, _spread, count_words

LEVELS = ("domain", "language", "source")
#: Nodes that the driver holds, and leaves that are broadcast, at most; of larger trees it holds the inner nodes only.
MOST_LEAVES = 200_000
KEY = ["_domain", "_language", "_source"]
NULL = "\0"


def default_domain(source: Column) -> Column:
    """Sources fall into four domains by crc32 of their name."""
    return F.concat(F.lit("domain"), F.pmod(F.crc32(F.coalesce(source.cast("string"), F.lit("")).cast("binary")), F.lit(4)).cast("string"))


@dataclass(frozen=True)
class Mix:
    """weights: by path of the tree, such as ("domain1", "en"); siblings without one have weight 1."""

    weights: dict[tuple[str, ...], float] = field(default_factory=dict)
    by_language: dict[str, float] = field(default_factory=lambda: {"en": 0.4, "fr": 0.2, "de": 0.2, "es": 0.2})
    share: float = 1.0  # budget, as a share of the tokens there are
    max_epochs: int = 4
    seed: int = 11

    def weight(self, path: tuple[str, ...]) -> float:
        if path in self.weights:
            return self.weights[path]
        return self.by_language.get(path[1], 1.0) if len(path) == 2 and self.by_language else 1.0


def share_out(budget: float, weights: list[float], most: list[float]) -> list[float]:
    """The budget in proportion to the weights; none above its most; what one can't take goes to the others."""
    given = [0.0] * len(weights)
    open_ = [i for i, w in enumerate(weights) if w > 0 and most[i] > 0]
    while open_ and budget > 0:
        total = sum(weights[i] for i in open_)
        full = [i for i in open_ if most[i] <= budget * weights[i] / total]
        if not full:
            for i in open_:
                given[i] = budget * weights[i] / total
            break
        for i in full:
            given[i] = most[i]
            budget -= most[i]
        open_ = [i for i in open_ if i not in set(full)]
    return given


def budgets(tokens: dict[tuple[str, ...], int], mix: Mix, room: dict[tuple[str, ...], float] | None = None) -> dict[tuple[str, ...], int]:
    """Tokens that each leaf gives; with ``room``, the share of each node that can take so many, before it is rounded."""
    most: dict[tuple[str, ...], float] = {}
    children: dict[tuple[str, ...], set] = {}
    for leaf, n in tokens.items():
        for d in range(len(leaf) + 1):
            # a node of weight 0 takes nothing, so it is no room for its parent's share either
            if all(mix.weight(leaf[:e]) > 0 for e in range(d + 1, len(leaf) + 1)):
                most[leaf[:d]] = most.get(leaf[:d], 0) + (n * mix.max_epochs if room is None else room[leaf])
            if d < len(leaf):
                children.setdefault(leaf[:d], set()).add(leaf[: d + 1])
    out: dict[tuple[str, ...], int] = {}
    todo = [((), min(mix.share * sum(tokens.values()), most.get((), 0)))]
    while todo:
        node, budget = todo.pop()
        if node not in children:
            out[node] = int(budget + 1e-6) if room is None else budget
            continue
        below = sorted(children[node])
        todo += zip(below, share_out(budget, [mix.weight(b) for b in below], [most.get(b, 0) for b in below]))
    return out


def _leaf_columns(docs: DataFrame, domain: Callable[[Column], Column]) -> list[Column]:
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(NULL)) if c in docs.columns else F.lit(NULL)
    return [F.coalesce(domain(F.col("source") if "source" in docs.columns else F.lit(None)).cast("string"), F.lit(NULL)).alias("_domain"), text("lang").alias("_language"), text("source").alias("_source")]


def _held_tree(leaves: DataFrame, mix: Mix) -> DataFrame:
    rows = leaves.collect()  # MOST_LEAVES at most
    given = budgets({tuple(r[c] for c in KEY): r["tokens"] for r in rows}, mix)
    table = [(*(r[c] for c in KEY), r["tokens"], r["rows"], given[tuple(r[c] for c in KEY)]) for r in rows]
    return leaves.sparkSession.createDataFrame(table, "_domain string, _language string, _source string, tokens long, rows long, given long")


def _spread_tree(leaves: DataFrame, mix: Mix, most_nodes: int) -> DataFrame:
    """The same for any number of leaves: of each inner node the driver holds the share of a leaf of weight 1, which rises
    until no further leaf is full."""
    spark = leaves.sparkSession
    inner = KEY[:2]
    own = {"\1".join(path): w for path, w in mix.weights.items() if len(path) == 3}
    weight = F.lit(1.0)
    if own:
        weight = F.coalesce(F.create_map(*[F.lit(x) for kv in own.items() for x in (kv[0], float(kv[1]))])[F.concat_ws("\1", *KEY)], F.lit(1.0))
    leaves = leaves.withColumn("w", weight).withColumn("most", F.when(F.col("w") > 0, F.col("tokens") * F.lit(float(mix.max_epochs))).otherwise(0.0))
    nodes = leaves.groupBy(*inner).agg(F.sum("tokens").alias("n"), F.sum("most").alias("room"), F.sum(F.when(F.col("most") > 0, F.col("w")).otherwise(0.0)).alias("w")).limit(most_nodes + 1).collect()
    if len(nodes) > most_nodes:
        raise ValueError(f"more than {most_nodes} domains and languages")
    name = lambda r: (r["_domain"], r["_language"])
    share = budgets({name(r): r["n"] for r in nodes}, mix, {name(r): r["room"] for r in nodes})
    level = {name(r): share[name(r)] / r["w"] if r["w"] else 0.0 for r in nodes}
    full: dict = {}
    while True:
        table = F.broadcast(spark.createDataFrame([(*k, v) for k, v in level.items()], "_domain string, _language string, level double"))
        filled = F.col("most") <= F.col("level") * F.col("w")
        sums = leaves.join(table, inner).groupBy(*inner).agg(F.count_if(filled).alias("c"), F.sum(F.when(filled, F.col("most")).otherwise(0.0)).alias("taken"), F.sum(F.when(~filled, F.col("w")).otherwise(0.0)).alias("w")).collect()
        now = {name(r): r["c"] for r in sums}
        if now == full:
            break
        full = now
        level = {name(r): (share[name(r)] - r["taken"]) / r["w"] if r["w"] else level[name(r)] for r in sums}
    given = F.floor(F.least(F.col("most"), F.col("level") * F.col("w")) + 1e-6).cast("long")
    return leaves.join(table, inner).select(*KEY, "tokens", "rows", given.alias("given"))


def plan(docs: DataFrame, mix: Mix, domain: Callable[[Column], Column], most_leaves: int = MOST_LEAVES) -> tuple[DataFrame, bool]:
    """Per leaf: passes (whole ones), last (order value up to which the next pass goes; null: not begun), and of the rows of
    that value, which are equal in id and text, take (how many the pass takes) and of (how many there are). And whether
    that table is small."""
    key = KEY
    rows = materialize(docs.select("doc_id", *text_key(F.col("text")), *_leaf_columns(docs, domain), count_words(F.col("text")).alias("_n")), "rows")
    leaves = materialize(rows.groupBy(*key).agg(F.sum("_n").alias("tokens"), F.count("*").alias("rows")), "leaves")
    small = leaves.limit(most_leaves + 1).count() <= most_leaves
    near = F.broadcast if small else lambda table: table
    tree = _held_tree(leaves, mix) if small else _spread_tree(leaves, mix, most_leaves)
    passes = F.when(F.col("tokens") > 0, F.expr("given div tokens")).otherwise(0).cast("int")
    rest = F.when(F.col("tokens") > 0, F.expr("given % tokens")).otherwise(0)
    tree = tree.select(*key, passes.alias("_passes"), rest.cast("long").alias("_rest"), F.ceil(F.col("rows") / SLICE_ROWS).alias("_slices"))
    keyed = rows.join(near(tree.where("_rest > 0")), key).withColumn("_u", order_value(mix))
    keyed = keyed.withColumn("_slice", _spread(F.col("_u"), F.col("_slices")))
    # equal rows have equal values: they are counted before anything is ordered
    keyed = keyed.groupBy(*key, "_slice", "_rest", "_u").agg(F.sum("_n").alias("_n"), F.count("*").alias("_c"))
    # the slice in which a leaf's running sum reaches its rest, then the value in that slice
    sums = keyed.groupBy(*key, "_slice", "_rest").agg(F.sum("_n").alias("_t"))
    run = F.sum("_t").over(Window.partitionBy(*key).orderBy("_slice"))
    crossing = sums.withColumn("_after", run).withColumn("_before", F.col("_after") - F.col("_t")).where("_before < _rest and _after >= _rest").select(*key, "_slice", "_before")
    close = keyed.join(near(crossing), [*key, "_slice"])
    reached = F.sum("_n").over(Window.partitionBy(*key).orderBy("_u")) + F.col("_before")
    cut = close.withColumn("_reached", reached).where("_reached >= _rest").groupBy(*key)
    cut = cut.agg(F.min_by(F.struct("_u", "_c", F.expr("cast(ceil((_rest - (_reached - _n)) * _c / _n) as long)").alias("_take")), "_u").alias("c"))
    table = tree.join(near(cut), key, "left").select(*key, "_passes", F.col("c._u").alias("_last"), F.col("c._take").alias("_take"), F.col("c._c").alias("_of"))
    table = materialize(table, "plan")
    for done in (rows, leaves):
        discard(done)
    return table, small


def order_value(mix: Mix, passes: str = "_passes", text: tuple[str, str] = ("_k1", "_k2")) -> Column:
    return F.xxhash64(F.lit(mix.seed), F.col(passes), F.col("doc_id"), *text)


def _marked(docs: DataFrame, mix: Mix, domain: Callable[[Column], Column], most_leaves: int) -> DataFrame:
    """The rows that are taken, with __copies and __domain."""
    table, small = plan(docs, mix, domain, most_leaves)
    split = table.where("_take < _of").limit(1).count() > 0
    table = table.select(*[F.col(c).alias(f"_{c}") for c in table.columns])
    leaf = [c.alias(name) for c, name in zip(_leaf_columns(docs, domain), ("__domain", "__language", "__source"))]
    key = [c.alias(name) for c, name in zip(text_key(F.col("text")), ("__k1", "__k2"))]
    rows = docs.select("*", *leaf, *key).join(F.broadcast(table) if small else table, ["__domain", "__language", "__source"]).withColumn("__u", order_value(mix, "__passes", ("__k1", "__k2")))
    more = F.coalesce(F.col("__u") <= F.col("__last"), F.lit(False))
    if split:
        # only some of the rows at a leaf's last value: they are numbered within the parts they are written in, and by part
        at = F.coalesce((F.col("__u") == F.col("__last")) & (F.col("__take") < F.col("__of")), F.lit(False))
        equal = materialize(rows.where(at).withColumn("__part", F.spark_partition_id()).withColumn("__row", F.monotonically_increasing_id()), "equal")
        leaf = ["__domain", "__language", "__source"]
        parts = equal.groupBy(*leaf, "__part").agg(F.count("*").alias("__c"))
        parts = parts.select(*leaf, "__part", (F.sum("__c").over(Window.partitionBy(*leaf).orderBy("__part")) - F.col("__c")).alias("__before"))
        place = F.row_number().over(Window.partitionBy(*leaf, "__part").orderBy("__row"))
        numbered = equal.withColumn("__place", place).join(parts, [*leaf, "__part"]).withColumn("__more", F.col("__before") + F.col("__place") <= F.col("__take"))
        rows = rows.where(~at).withColumn("__more", more).unionByName(numbered.select(*rows.columns, "__more"))
    else:
        rows = rows.withColumn("__more", more)
    return rows.withColumn("__copies", F.col("__passes") + F.col("__more").cast("int")).where("__copies > 0")


def select(docs: DataFrame, mix: Mix = Mix(), domain: Callable[[Column], Column] = default_domain, most_leaves: int = MOST_LEAVES) -> DataFrame:
    """The rows that the mix takes at least once, with all their columns and ``_copies``, the number of times, and ``_domain``
    (columns of these two names are replaced).

    Tokens are words. Documents are taken whole, however long, so a leaf exceeds its budget by less than its last document.
    A null language or source is a child of its own; a null text has no tokens. Each pass has its own order, a hash of
    seed, pass, doc_id and text; rows that tie in all of these, null ids among them, are taken one by one, any of them
    first. An empty table gives an empty one. Only narrow rows are shuffled: the texts are filtered where they lie, by
    each leaf's last order value (but where this parts equal rows, these are written and numbered). A tree of more than
    ``most_leaves`` leaves isn't held by the driver nor broadcast: its leaves share out in rounds, and texts are joined
    with their leaves by shuffle.
    """
    rest = [c for c in docs.columns if c not in ("_copies", "_domain")]
    return _marked(docs, mix, domain, most_leaves).select(*rest, F.col("__copies").alias("_copies"), F.col("__domain").alias("_domain"))


def mixed(docs: DataFrame, mix: Mix = Mix(), domain: Callable[[Column], Column] = default_domain, most_leaves: int = MOST_LEAVES) -> DataFrame:
    """The mixture itself: rows as they are, each as often as it is taken."""
    return _marked(docs, mix, domain, most_leaves).withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies")))).select(*docs.columns)
