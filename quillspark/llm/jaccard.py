"""N-gram Jaccard join by MinHash banding.

Texts with the same set of n-grams are one node. Nodes that share a band of their MinHash signature are candidates; a
band's group is written as a star around its least node, so that no group is expanded into pairs. All texts of a
connected group of candidates meet once - large groups in pairs of bounded chunks - where each pair is verified on the
full n-gram sets, counted, and reduced to a spanning forest.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import discard, materialize
from .common import U64, Words, gram_hashes, i64, mix64, slices, span_hashes, text_key
from .components import connected

N, SIMILARITY, RECALL, MOST_HASHES = 5, 0.8, 0.999, 320
#: Texts, and n-grams, that a chunk holds about.
CHUNK_TEXTS, CHUNK_GRAMS = 512, 1_500_000
_DOC = U64(48)


def bands_for(similarity: float = SIMILARITY, recall: float = RECALL, most: int = MOST_HASHES) -> tuple[int, int]:
    """Bands and rows: the most selective (most rows a band) that find pairs of that similarity with that probability,
    out of at most ``most`` hashes; where even one row a band needs more, as many bands of one row as it needs."""
    if similarity >= 1:
        return 1, most
    best = None
    for rows in range(1, most + 1):
        bands = max(1, math.ceil(math.log(1 - recall) / math.log(1 - similarity**rows)))
        if best is not None and bands * rows > most:
            break
        best = (bands, rows)
    return best


def grams(w: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Texts of all n-grams of a slice, and their hashes. A text of fewer than n words, but some, has one gram: all of it."""
    found = gram_hashes(w.hashes, n)
    inside = w.text_of[: len(found)] == w.text_of[n - 1 :] if len(found) else np.zeros(0, dtype=bool)
    at = np.flatnonzero(inside)
    short = np.flatnonzero((w.counts > 0) & (w.counts < n))
    whole = span_hashes(w.hashes, w.first[short], w.first[short + 1], salt=n)
    return np.concatenate([w.text_of[at], short]), np.concatenate([found[at], whole])


def gram_sets(w: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct n-grams of all texts of a slice, as text << 48 | 48 bits of hash, and the n + 1 bounds of the texts."""
    count = len(w.counts)
    owner, keys = grams(w, n)
    keys = np.sort((owner.astype(U64) << _DOC) | (keys >> U64(16)))
    keys = keys[np.append(True, keys[1:] != keys[:-1])] if len(keys) else keys
    return keys, np.searchsorted(keys, np.arange(count + 1).astype(U64) << _DOC)


def signatures(keys: np.ndarray, bounds: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """Band hashes (texts, bands) of the n-gram sets; all texts must have n-grams."""
    x = (mix64(keys & U64((1 << 48) - 1)) >> U64(32)).astype(np.uint32)
    scale = mix64(np.arange(1, 2 * bands * rows + 1, dtype=U64) * U64(0x9E3779B97F4A7C15))
    a, b = (scale[0::2] | U64(1)).astype(np.uint32), scale[1::2].astype(np.uint32)
    first = bounds[:-1]
    out = np.zeros((len(first), bands), dtype=U64)
    for i in range(bands * rows):
        low = np.minimum.reduceat(x * a[i] + b[i], first)
        out[:, i // rows] = mix64(out[:, i // rows] + low + U64(i + 1))
    return out


def _sign_batches(batches: Iterator[pa.RecordBatch], n: int, bands: int, rows: int) -> Iterator[pa.RecordBatch]:
    for b in slices(batches):
        keys, bounds = gram_sets(Words(b.column("text")), n)
        size = np.diff(bounds)
        low = mix64(keys & U64((1 << 48) - 1))
        sums = np.zeros(len(keys) + 1, dtype=U64)
        np.cumsum(low, out=sums[1:])
        node = mix64(sums[bounds[1:]] - sums[bounds[:-1]] + size.astype(U64) * U64(0x9E3779B97F4A7C15))
        some = np.flatnonzero(size)
        signed = np.zeros((len(size), bands), dtype=U64)
        if len(some):
            signed[some] = signatures(keys, np.append(bounds[:-1][some], bounds[-1]), bands, rows)
        ends = np.zeros(len(size) + 1, dtype=np.int32)
        np.cumsum(np.where(size > 0, bands, 0), out=ends[1:])
        array = pa.ListArray.from_arrays(pa.array(ends), i64(signed[some].reshape(-1)))
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("_k1"), b.column("_k2"), i64(node), i64(size), array], names=["doc_id", "_k1", "_k2", "node", "grams", "bands"])


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of each (root, i, j), which come one after the other."""
    held: list[pa.RecordBatch] = []
    key = None
    for b in batches:
        if not b.num_rows:
            continue
        keys = np.stack([b.column(c).to_numpy() for c in ("root", "i", "j")])
        cuts = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1
        for lo, hi in zip([0, *cuts], [*cuts, b.num_rows]):
            own = tuple(keys[:, lo])
            if own != key and held:
                yield pa.Table.from_batches(held)
                held = []
            key = own
            held.append(b.slice(lo, hi - lo))
    if held:
        yield pa.Table.from_batches(held)


def intersections(owner: np.ndarray, keys: np.ndarray, m: int, width: int = 1 << 14) -> tuple[np.ndarray, np.ndarray]:
    """Sizes of the n-gram sets of m texts, and of the common part of all pairs, by products of blocks of the incidence matrix."""
    gram = np.unique(keys, return_inverse=True)[1].astype(np.int64)
    owner, gram = np.divmod(np.unique(owner * (int(gram.max(initial=0)) + 1) + gram), int(gram.max(initial=0)) + 1)  # each once a text
    own = np.bincount(owner, minlength=m)
    often = np.bincount(gram)
    stay = often[gram] > 1
    number = np.cumsum(often > 1) - 1
    owner, gram = owner[stay], number[gram[stay]]
    order = np.argsort(gram, kind="stable")
    owner, gram = owner[order], gram[order]
    out = np.zeros((m, m))
    total = int(gram[-1]) + 1 if len(gram) else 0
    for lo in range(0, total, width):
        a, e = np.searchsorted(gram, [lo, lo + width])
        block = np.zeros((m, min(width, total - lo)), dtype=np.float32)
        block[owner[a:e], gram[a:e] - lo] = 1
        out += block @ block.T
    out[np.arange(m), np.arange(m)] = own
    return own, out


def _roots(linked: np.ndarray) -> np.ndarray:
    """The first member of each member's component in a symmetric boolean matrix."""
    root = np.full(len(linked), -1)
    for s in range(len(linked)):
        if root[s] >= 0:
            continue
        front = np.zeros(len(linked), dtype=bool)
        front[s] = True
        while front.any():
            root[front] = s
            front = linked[front].any(axis=0) & (root < 0)
    return root


def _verify_batches(batches: Iterator[pa.RecordBatch], n: int, similarity: float) -> Iterator[pa.RecordBatch]:
    for t in _groups(batches):
        i, j = t["i"][0].as_py(), t["j"][0].as_py()
        t = t.take(pa.array(np.unique(t["node"].to_numpy(), return_index=True)[1]))
        node, chunk, size = (t[c].to_numpy() for c in ("node", "chunk", "size"))
        own, common = intersections(*grams(Words(t["text"].combine_chunks()), n), len(node))
        union = own[:, None] + own[None, :] - common
        linked = common >= similarity * union - 1e-9
        linked &= (chunk[:, None] == i) & (chunk[None, :] == j) | (chunk[:, None] == j) & (chunk[None, :] == i)
        np.fill_diagonal(linked, False)
        yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(node[_roots(linked)]), pa.array((linked @ size.astype(np.int64)).astype(np.int64))], names=["node", "root", "links"])


def near_copies(docs: DataFrame, n: int = N, similarity: float = SIMILARITY, recall: float = RECALL) -> DataFrame:
    """doc_id, class_id, n_links of every row, and _k1, _k2 (the text's key), _class (one value for each class).

    Two rows are linked if the Jaccard similarity of their sets of word n-grams is ``similarity`` or more (two empty sets:
    1). n_links counts the other rows linked to a row; class_id is the least doc_id of all that links connect, null if
    they have none. A null text counts as empty; a text counts whole, however long. Repeated rows are copies of each
    other; ties don't arise, as all links count. An empty table gives an empty one. Ids are of any type that has an order.
    Other columns are ignored, whatever their names.
    """
    bands, rows = bands_for(similarity, recall)
    id_type = docs.schema["doc_id"].dataType.simpleString()
    texts = docs.select("doc_id", *text_key(F.col("text")), F.coalesce("text", F.lit("")).alias("text"))
    signed = materialize(
        texts.mapInArrow(lambda it: _sign_batches(it, n, bands, rows), f"doc_id {id_type}, _k1 long, _k2 long, node long, grams long, bands array<long>"), "signed"
    )
    nodes = materialize(
        signed.groupBy("node").agg(F.count("*").alias("size"), F.min("doc_id").alias("least_id"), F.max("grams").alias("grams"), F.min(F.struct("_k1", "_k2")).alias("key")).select("node", "size", "least_id", "grams", "key._k1", "key._k2"), "nodes"
    )
    keys = signed.groupBy("node").agg(F.first("bands").alias("bands")).select("node", F.posexplode("bands")).select("node", F.xxhash64("pos", "col").alias("band"))
    keys = materialize(keys, "bands")
    stars = keys.groupBy("band").agg(F.count("*").alias("c"), F.min("node").alias("centre")).where("c > 1").select("band", "centre")
    candidates = connected(keys.hint("merge").join(stars, "band").select(F.col("node").alias("a"), F.col("centre").alias("b")))
    discard(keys)
    inside = candidates.join(nodes, "node")
    groups = inside.groupBy("root").agg(F.count("*").alias("m"), F.sum("grams").alias("g")).select("root", F.greatest(F.ceil(F.col("m") / CHUNK_TEXTS), F.ceil(F.col("g") / CHUNK_GRAMS)).cast("int").alias("chunks"))
    placed = materialize(inside.join(groups, "root").withColumn("chunk", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int")).select("node", "root", "size", "_k1", "_k2", "chunks", "chunk"), "placed")
    # one text for each node; of its copies in a partition only one is shuffled. Sides that grow with the corpus are never
    # broadcast, so the plan is the same at every size
    bodies = texts.select("_k1", "_k2", "text").mapInArrow(_first_of_each, "_k1 long, _k2 long, text string")
    meet = placed.hint("merge").join(bodies, ["_k1", "_k2"]).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    meet = meet.select("root", F.least("chunk", "other").alias("i"), F.greatest("chunk", "other").alias("j"), "node", "chunk", "size", "text")
    checked = materialize(
        meet.repartition("root", "i", "j").sortWithinPartitions("root", "i", "j").mapInArrow(lambda it: _verify_batches(it, n, similarity), "node long, root long, links long"), "verified"
    )
    classes = connected(checked.where("node != root").select(F.col("node").alias("a"), F.col("root").alias("b")))
    links = checked.groupBy("node").agg(F.sum("links").alias("links"))
    whole = nodes.join(links, "node", "left").join(classes, "node", "left").select("node", "size", "least_id", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("root", "node").alias("root"))
    whole = materialize(whole, "classes")
    first = whole.groupBy("root").agg(F.min("least_id").alias("class_id"))
    whole = materialize(whole.join(first, "root").select("node", "root", "class_id", (F.col("links") + F.col("size") - 1).alias("n_links")), "classes")
    return signed.select("doc_id", "_k1", "_k2", "node").hint("merge").join(whole, "node").select("doc_id", "class_id", "n_links", "_k1", "_k2", F.col("root").alias("_class"))


def _first_of_each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: set[tuple[int, int]] = set()
    for b in batches:
        stay = []
        for i, k in enumerate(zip(b.column("_k1").to_pylist(), b.column("_k2").to_pylist())):
            if k not in seen:
                seen.add(k)
                stay.append(i)
        yield b.take(pa.array(stay, pa.int64()))


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """The rows, all columns, that are the first of their class: the least doc_id; of rows of that id the one with the least
    text key; of repeated rows one, whichever. Classes without any id keep one row as well. An empty table stays empty; columns
    may have any names."""
    found = materialize(near_copies(docs, **options), "classes")
    rank = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), "_k1", "_k2")
    best = found.groupBy("_class").agg(F.min(rank).alias("b")).select("b.id", "b._k1", "b._k2")
    often = found.groupBy("doc_id", "_k1", "_k2").agg(F.count("*").alias("__often"))
    chosen = best.alias("x").join(often.alias("y"), F.expr("x.id <=> y.doc_id and x._k1 = y._k1 and x._k2 = y._k2")).select(F.col("x.id").alias("__id"), F.col("x._k1").alias("__k1"), F.col("x._k2").alias("__k2"), "__often")
    k1, k2 = text_key(F.col("text"))
    rows = docs.select("*", k1.alias("__a"), k2.alias("__b")).join(chosen, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__a") == F.col("__k1")) & (F.col("__b") == F.col("__k2")))
    once = rows.where("__often = 1").select(*docs.columns)
    again = rows.where("__often > 1").dropDuplicates(["__id", "__k1", "__k2"]).select(*docs.columns)
    return once.unionByName(again)
