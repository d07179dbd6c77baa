"""Approximate nearest neighbours by a hierarchical k-means tree, searched best bin first.

The tree is fitted on a bounded sample and assigns every row to a leaf. A query walks the tree with a priority queue of
bins, nearest centre first, and visits as many leaves as calibration found to reach the wanted recall against brute
force over all rows; the recall is then measured, likewise, with rows that neither the tree nor the calibration saw. Leaves are searched in blocks of bounded size, so that a leaf may hold any share of the rows.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from ..storage import materialize

#: Rows that the tree is fitted on, and leaves, at most; rows of a leaf aimed at; queries that calibrate the visits, and
#: as many that measure the recall.
SAMPLE_ROWS, MOST_LEAVES, LEAF_ROWS, CALIBRATION = 20_000, 2048, 256, 128
BLOCK_ROWS, BRANCHES, RECALL = 4096, 8, 0.97


def vectors(ids: pa.Array, column: pa.Array, dim: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Ids and double vectors of the rows that take part: of ``dim`` finite components, not all zero, with an id."""
    lists = column.cast(pa.large_list(pa.float64()))
    offsets = lists.offsets.to_numpy()
    size = np.diff(offsets)
    flat = pa.chunked_array([lists.values]).combine_chunks()
    values = flat.fill_null(np.nan).to_numpy(zero_copy_only=False)
    if dim is None:
        dim = int(np.bincount(size[size > 0]).argmax()) if (size > 0).any() else 0
    fit = np.flatnonzero((size == dim) & lists.is_valid().to_numpy(zero_copy_only=False) & ids.is_valid().to_numpy(zero_copy_only=False) & (dim > 0))
    x = values[offsets[:-1][fit][:, None] + np.arange(dim)] if len(fit) else np.zeros((0, dim))
    ok = np.isfinite(x).all(axis=1) & (x != 0).any(axis=1)
    return ids.fill_null(0).to_numpy(zero_copy_only=False)[fit[ok]], x[ok]


def inner_products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """All inner products, each summed in the order of the components: equal vectors get equal values, to the last bit."""
    out = np.zeros((len(q), len(x)))
    columns = np.ascontiguousarray(x.T)
    for lo in range(0, len(q), 64):
        part = out[lo : lo + 64]
        for d in range(len(columns)):
            part += q[lo : lo + 64, d, None] * columns[d]
    return out


def best(scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of each row's k greatest scores; of ties the smaller columns."""
    m = scores.shape[1]
    if m > k:
        least = np.partition(scores, m - k, axis=1)[:, m - k]
        row, col = np.nonzero(scores >= least[:, None])
    else:
        row, col = np.nonzero(np.isfinite(scores))
    order = np.lexsort((col, -scores[row, col], row))
    row, col = row[order], col[order]
    stay = _rank(row) < k
    return row[stay], col[stay]


def nearest(q_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query, row and score of each query's k best ids among sorted ``ids`` but its own; an id with several rows counts by its best."""
    scores = inner_products(q, x)
    scores[q_ids[:, None] == ids[None, :]] = -np.inf
    first = np.flatnonzero(np.append(True, ids[1:] != ids[:-1])[: len(ids)])
    single = len(first) == len(ids)
    top = scores if single else np.maximum.reduceat(scores, first, axis=1)
    row, col = best(top, k)
    ok = np.isfinite(top[row, col])
    row, col = row[ok], col[ok]
    value = top[row, col]
    if not single:
        ends = np.append(first[1:], len(ids))
        col = np.array([a + scores[r, a:b].argmax() for r, a, b in zip(row, first[col], ends[col])], dtype=np.int64)
    return row, col, value


def _rank(sorted_keys: np.ndarray) -> np.ndarray:
    """Place of each item among those of its key."""
    if not len(sorted_keys):
        return np.zeros(0, dtype=np.int64)
    begin = np.append(True, sorted_keys[1:] != sorted_keys[:-1])
    at = np.flatnonzero(begin)
    return np.arange(len(sorted_keys)) - np.repeat(at, np.diff(np.append(at, len(sorted_keys))))


@dataclass
class Tree:
    """centres[i] of node i; below[i]: its children, none for a leaf; leaf[i]: number of a leaf. Node 0 is the root."""

    centres: np.ndarray
    below: list[np.ndarray]
    leaf: np.ndarray

    @property
    def leaves(self) -> int:
        return int(self.leaf.max()) + 1

    def assign(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row: at each node down to the child with the nearest centre."""
        out = np.zeros(len(x), dtype=np.int32)
        todo = [(0, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            if not len(rows):
                continue
            kids = self.below[node]
            if not len(kids):
                out[rows] = self.leaf[node]
                continue
            c = self.centres[kids]
            near = (x[rows] @ c.T - (c * c).sum(axis=1) / 2).argmax(axis=1)
            todo += [(int(kid), rows[near == i]) for i, kid in enumerate(kids)]
        return out

    def order(self, q: np.ndarray, visits: int, counts: np.ndarray, least: int) -> list[int]:
        """Leaves in the order of a best-bin-first walk, until ``visits`` are seen that hold at least ``least`` by ``counts``."""
        near = self.centres @ q
        heap, seen, held = [(0.0, 0)], [], 0
        while heap and (len(seen) < visits or held < least):
            _, node = heapq.heappop(heap)
            kids = self.below[node]
            if len(kids):
                for kid in kids:
                    heapq.heappush(heap, (-near[kid], int(kid)))
            else:
                seen.append(int(self.leaf[node]))
                held += int(counts[self.leaf[node]])
        return seen


def fit_tree(x: np.ndarray, leaves: int, seed: int = 5) -> Tree:
    """Lloyd's iterations in each node, nodes split by size until there are about ``leaves``."""
    rng = np.random.default_rng(seed)
    centres, below = [x.mean(axis=0) if len(x) else np.zeros(x.shape[1])], [np.zeros(0, dtype=int)]
    heap, count, parts = [(-len(x), 0)], 1, {0: x}
    while heap and count < leaves:
        _, node = heapq.heappop(heap)
        own = parts.pop(node)
        distinct = np.unique(own, axis=0)
        k = min(BRANCHES, len(distinct), leaves - count + 1)
        if k < 2:
            continue
        c = distinct[rng.choice(len(distinct), k, replace=False)]
        for _ in range(8):
            near = (own @ c.T - (c * c).sum(axis=1) / 2).argmax(axis=1)
            c = np.array([own[near == i].mean(axis=0) if (near == i).any() else c[i] for i in range(k)])
        near = (own @ c.T - (c * c).sum(axis=1) / 2).argmax(axis=1)
        used = [i for i in range(k) if (near == i).any()]
        if len(used) < 2:
            continue
        below[node] = len(centres) + np.arange(len(used))
        for kid, i in zip(below[node], used):
            centres.append(c[i])
            below.append(np.zeros(0, dtype=int))
            parts[int(kid)] = own[near == i]
            heapq.heappush(heap, (-len(parts[int(kid)]), int(kid)))
        count += len(used) - 1
    leaf = np.full(len(centres), -1)
    ends = [i for i, b in enumerate(below) if not len(b)]
    leaf[ends] = np.arange(len(ends))
    return Tree(np.array(centres), below, leaf)


def _tagged(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, bool]]:
    """Batches of one (leaf, block) each, in order; True where a new group begins."""
    key = None
    for b in batches:
        if not b.num_rows:
            continue
        keys = np.stack([b.column(c).to_numpy() for c in ("leaf", "block", "is_query")])
        cuts = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1
        for lo, hi in zip([0, *cuts], [*cuts, b.num_rows]):
            own = tuple(keys[:2, lo])
            yield b.slice(lo, hi - lo), own != key
            key = own


def _search_batches(batches: Iterator[pa.RecordBatch], k: int, dim: int) -> Iterator[pa.RecordBatch]:
    """For each block: its rows come first, then its queries. Of all blocks of a task, a query's best k are handed on."""
    found: list[tuple[np.ndarray, ...]] = []
    held = 0
    rows: list[tuple[np.ndarray, np.ndarray]] = []
    ids = x = None

    def handed():
        q, v, s = (np.concatenate(c) for c in zip(*found))
        order = np.lexsort((-s, v, q))
        q, v, s = q[order], v[order], s[order]
        fresh = np.append(True, (q[1:] != q[:-1]) | (v[1:] != v[:-1]))  # of a repeated id its best
        q, v, s = q[fresh], v[fresh], s[fresh]
        order = np.lexsort((v, -s, q))
        q, v, s = q[order], v[order], s[order]
        stay = _rank(q) < k
        return q[stay], v[stay], s[stay]

    for b, new in _tagged(batches):
        if new:
            rows, x = [], None
        own, v = vectors(b.column("vec_id"), b.column("embedding"), dim)
        if not b.column("is_query")[0].as_py():
            rows.append((own, v))
            continue
        if not rows:
            continue
        if x is None:
            ids, x = np.concatenate([r[0] for r in rows]), np.concatenate([r[1] for r in rows])
            order = np.argsort(ids, kind="stable")
            ids, x = ids[order], x[order]
        for lo in range(0, len(own), 512):
            q = own[lo : lo + 512]
            row, col, value = nearest(q, v[lo : lo + 512], ids, x, k)
            found.append((q[row], ids[col], value))
            held += len(row)
        if held > 400_000:
            found = [handed()]
            held = len(found[0][0])
            if held > 200_000:
                yield _rows(*found[0])
                found, held = [], 0
    if found:
        yield _rows(*handed())


def _rows(q, v, s) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(q), pa.array(v), pa.array(s)], names=["query_id", "vec_id", "score"])


def _typed(table: DataFrame) -> DataFrame:
    kind = table.schema["vec_id"].dataType
    if not isinstance(kind, IntegralType):
        raise TypeError(f"vec_id is {kind.simpleString()}, not a whole number")
    return table.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))


class Index:
    """A fitted tree with every row of ``table`` (vec_id, embedding) assigned to a leaf.

    Rows whose vector is null, zero, holds a null or a non-finite component, or has another length than most, and rows
    without an id, take no part. Rows that are there more than once (id and vector) are kept once. An empty table gives an
    index that finds nothing. Ids are whole numbers; others raise TypeError. Other columns are ignored.
    """

    def __init__(self, table: DataFrame, sample_rows: int = SAMPLE_ROWS, leaf_rows: int = LEAF_ROWS):
        table = _typed(table)
        self.spark = table.sparkSession
        table = materialize(table.where("vec_id is not null and embedding is not null").dropDuplicates(), "vectors")
        chosen = table.orderBy(F.xxhash64("vec_id", "embedding"), "vec_id").limit(sample_rows + 2 * CALIBRATION)
        few = chosen.toArrow()  # bounded
        ids, x = vectors(*(pa.concat_arrays(few[c].chunks) if few.num_rows else pa.array([], few.schema.field(c).type) for c in ("vec_id", "embedding")))
        self.dim = x.shape[1]
        # rows that calibrate and measure, in turn; the others, but for a handful of rows, fit the tree
        own = min(2 * CALIBRATION, len(x) // 5)
        self.probe_ids, self.probe = (ids[:own], x[:own]) if own > 1 else (ids, x)
        x = x[own:]
        rows = table.count()
        self.tree = tree = fit_tree(x, max(1, min(MOST_LEAVES, rows // leaf_rows, len(x) // 4 or 1)))
        dim = self.dim

        def assigned(batches):
            for b in batches:
                ids, v = vectors(b.column("vec_id"), b.column("embedding"), dim)
                if len(ids):
                    flat = pa.ListArray.from_arrays(pa.array(np.arange(len(ids) + 1) * dim, pa.int32()), pa.array(v.reshape(-1)))
                    yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(tree.assign(v)), flat], names=["vec_id", "leaf", "embedding"])

        # leaves are needed by several jobs; vectors are stored with them
        self.rows = materialize(table.mapInArrow(assigned, "vec_id long, leaf int, embedding array<double>"), "leaves")
        self.counts = self._by_leaf(self.rows)
        #: Ids by the first of their leaves: what some leaves sum up to, they hold in different ids at least.
        self.ids = self._by_leaf(self.rows.groupBy("vec_id").agg(F.min("leaf").alias("leaf")))

    def _by_leaf(self, rows: DataFrame) -> np.ndarray:
        out = np.zeros(self.tree.leaves, dtype=np.int64)
        for r in rows.groupBy("leaf").agg(F.count("*").alias("c")).collect():  # MOST_LEAVES at most
            out[r["leaf"]] = r["c"]
        return out

    def calibrate(self, k: int, recall: float = RECALL) -> tuple[int, float | None]:
        """Leaves to visit so that, on average over sampled queries, that share of the k nearest by brute force is found;
        and the share that so many leaves hold for other queries (None without any)."""
        q, own, dim, tree = self.probe, self.probe_ids, self.dim, self.tree
        if not len(q):
            return 1, None

        def exact(batches):
            for b in batches:
                ids, v = vectors(b.column("vec_id"), b.column("embedding"), dim)
                order = np.argsort(ids, kind="stable")
                ids, v, leaf = ids[order], v[order], b.column("leaf").to_numpy()[order]
                row, col, value = nearest(own, q, ids, v, k)
                yield pa.RecordBatch.from_arrays([pa.array(row), pa.array(ids[col]), pa.array(value), pa.array(leaf[col].astype(np.int32))], names=["q", "vec_id", "score", "leaf"])

        near = self.rows.mapInArrow(exact, "q long, vec_id long, score double, leaf int")
        near = near.groupBy("q", "vec_id").agg(F.max("score").alias("score"), F.max_by("leaf", "score").alias("leaf"))
        order = Window.partitionBy("q").orderBy(F.col("score").desc(), "vec_id")
        top = near.withColumn("r", F.row_number().over(order)).where(f"r <= {k}").select("q", "leaf").collect()  # k * queries
        place = [{leaf: i for i, leaf in enumerate(tree.order(v, tree.leaves, self.counts, 0))} for v in q]
        placed = [(r["q"], place[r["q"]][r["leaf"]]) for r in top]
        odd = np.sort([p for i, p in placed if i % 2]) if len(q) > 1 else np.array([])
        even = np.sort([p for i, p in placed if i % 2 == 0])
        if not len(even):
            return 1, None
        visits = int(even[min(len(even) - 1, int(np.ceil(recall * len(even))) - 1)]) + 1
        return visits, float((odd < visits).mean()) if len(odd) else None

    def search(self, queries: DataFrame, k: int, recall: float = RECALL, visits: int | None = None) -> DataFrame:
        """query_id, rank, vec_id, score, recall: of each query's visited leaves the k rows of the greatest inner product.

        recall is what calibration measured, null where ``visits`` are given or nothing could be measured. Nearest first, ties to the smaller vec_id; the row of the query's own id isn't a candidate. Rows that are there
        more than once, and ids with several vectors, count once. Leaves are visited until ``visits`` (calibrated unless
        given) and at least 2 * k ids are seen.
        """
        visits, measured = self.calibrate(k, recall) if visits is None else (visits, None)
        tree, counts, dim = self.tree, self.ids, self.dim
        blocks = np.maximum(1, -(-self.counts // BLOCK_ROWS))
        per_leaf = F.element_at(F.array(*[F.lit(int(n)) for n in blocks]), F.col("leaf") + 1) if (blocks > 1).any() else F.lit(1)

        def walk(batches):
            for b in batches:
                ids, v = vectors(b.column("vec_id"), b.column("embedding"), dim)
                for lo in range(0, len(ids), 256):
                    leaves = [tree.order(q, visits, counts, 2 * k + 1) for q in v[lo : lo + 256]]
                    n = len(leaves)
                    flat = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * dim, pa.int32()), pa.array(v[lo : lo + n].reshape(-1)))
                    yield pa.RecordBatch.from_arrays([pa.array(ids[lo : lo + n]), flat, pa.array(leaves, pa.list_(pa.int32()))], names=["vec_id", "embedding", "leaves"])

        asked = _typed(queries).mapInArrow(walk, "vec_id long, embedding array<double>, leaves array<int>")
        asked = asked.select("vec_id", "embedding", F.explode("leaves").alias("leaf")).withColumn("block", F.explode(F.sequence(F.lit(0), per_leaf - 1)))
        held = self.rows.select("vec_id", "embedding", "leaf", F.pmod(F.xxhash64("vec_id", "embedding"), per_leaf).cast("int").alias("block"))
        both = held.withColumn("is_query", F.lit(0)).unionByName(asked.withColumn("is_query", F.lit(1)))
        found = both.repartition("leaf", "block").sortWithinPartitions("leaf", "block", "is_query").mapInArrow(lambda it: _search_batches(it, k, dim), "query_id long, vec_id long, score double")
        found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
        order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
        return found.withColumn("rank", F.row_number().over(order)).where(f"rank <= {k}").select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score", F.lit(measured).cast("double").alias("recall"))
