"""Retrieval: BM25, vector search over mixed units, rank-interleaved hybrids, evidence numbering."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from ..functions.text import tokens
from ..storage import materialize

K1, B, EPSILON = 1.5, 0.75, 0.25
#: Queries of a block, which a task holds.
QUERY_BLOCK = 4096
#: (query, token) pairs that are broadcast, at most; more are left to a join by shuffle on the token, which splits hot tokens.
BROADCAST_TERMS = 500_000
#: Bytes of input whose tokens a task counts at a time.
DEALT_BYTES = 4 << 20
#: Parts of scores that a task adds up at a time, and hits that it holds before it leaves each query's best.
PARTS, HELD = 2_000_000, 200_000


def units(docs: DataFrame) -> DataFrame:
    """Retrieval units of documents (doc_id, title, text, image_path, entity_id): a text unit where title or text says
    anything, an image unit (title, no text) where there is an image. entity_key: entity, else title, else doc_id."""
    filled = lambda c: F.coalesce(F.col(c), F.lit(""))
    has_text = F.regexp_replace(F.concat(filled("title"), F.lit(" "), filled("text")), r"(?U)\s+", "") != ""
    text = F.struct(F.lit("text").alias("modality"), filled("text").alias("text"), F.lit(None).cast("string").alias("image_path"))
    image = F.struct(F.lit("image").alias("modality"), F.lit("").alias("text"), F.col("image_path").alias("image_path"))
    both = F.array_compact(F.array(F.when(has_text, text), F.when(filled("image_path") != "", image)))
    key = F.coalesce(F.nullif(F.col("entity_id"), F.lit("")), F.nullif(F.col("title"), F.lit("")), F.col("doc_id").cast("string"))
    return docs.select("doc_id", filled("title").alias("title"), key.alias("entity_key"), F.explode(both).alias("u")).select("doc_id", "u.modality", "u.text", "title", "u.image_path", "entity_key")


def corpus_statistics(docs: DataFrame) -> DataFrame:
    """One row: documents n, mean length avgdl, vocabulary size, mean idf."""
    index = bm25_index(docs)
    size = index.frequencies.agg(F.count("*").alias("vocabulary"))
    return size.select(F.lit(index.n).cast("long").alias("n"), F.lit(index.avgdl).alias("avgdl"), "vocabulary", F.when(F.col("vocabulary") > 0, F.lit(index.mean_idf)).alias("mean_idf"))


def with_terms(docs: DataFrame) -> DataFrame:
    """doc_id and terms: the tokens of title and text."""
    title = F.coalesce(F.col("title"), F.lit("")) if "title" in docs.columns else F.lit("")
    return docs.select("doc_id", tokens(F.concat(title, F.lit(" "), F.coalesce("text", F.lit("")))).alias("terms"))


@dataclass(frozen=True)
class Bm25Index:
    """Postings (doc_id, dl, t, tf; those of a document lie together), document frequencies (t, df), and the corpus's numbers."""

    postings: DataFrame
    frequencies: DataFrame
    n: int
    avgdl: float
    mean_idf: float


def _idf(n: int) -> Column:
    return F.ln(F.lit(float(n)) - F.col("df") + F.lit(0.5)) - F.ln(F.col("df") + F.lit(0.5))


def _deals(texts: DataFrame) -> list[int]:
    """The number of partitions, where the input asks for more than the session has: a task counts the tokens of all its texts."""
    size = int(str(texts._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    wanted = -(-size // DEALT_BYTES) if size < 1 << 50 else 0  # else unknown
    return [wanted] if wanted > int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")) else []


def bm25_index(docs: DataFrame) -> Bm25Index:
    """Reads and tokenizes the documents once; what queries need is written to the shared folder."""
    texts = docs.select("doc_id", *[c for c in ("title", "text") if c in docs.columns])
    terms = with_terms(texts.repartition(*_deals(texts), "doc_id"))  # texts are smaller than their tokens
    postings = terms.select("doc_id", F.size("terms").alias("dl"), F.explode("terms").alias("t")).groupBy("doc_id", "dl", "t").agg(F.count("*").cast("int").alias("tf"))
    postings = materialize(postings, "postings")
    frequencies = materialize(postings.groupBy("t").agg(F.count("*").alias("df")), "frequencies")
    n = docs.select("doc_id").count()
    total = postings.agg(F.sum("tf").alias("s")).first()["s"] or 0
    mean = frequencies.agg(F.avg(_idf(n)).alias("m")).first()["m"]
    return Bm25Index(postings, frequencies, n, total / n if n else 0.0, mean or 0.0)


def query_terms(index: Bm25Index, queries: DataFrame) -> DataFrame:
    """query_id, t, weight of the tokens that queries ask for and documents have.

    Okapi BM25; an idf below 0 is replaced by EPSILON times the mean idf of the vocabulary. A token that a query repeats
    counts each time.
    """
    asked = queries.select("query_id", F.explode(tokens(F.col("question"))).alias("t")).groupBy("query_id", "t").agg(F.count("*").alias("times"))
    raw = _idf(index.n)
    idf = index.frequencies.select("t", F.when(raw < 0, F.lit(EPSILON * index.mean_idf)).otherwise(raw).alias("idf"))
    return materialize(asked.join(idf, "t").select("query_id", "t", (F.col("times") * F.col("idf")).alias("weight")), "terms")


def bm25(index: Bm25Index, queries: DataFrame, also: DataFrame | None = None, terms: DataFrame | None = None) -> DataFrame:
    """query_id, doc_id, score of all pairs that share a token, and of the pairs ``also`` (query_id, doc_id): by a join, for
    any number of queries."""
    terms = query_terms(index, queries) if terms is None else terms
    saturated = F.col("tf") * F.lit(K1 + 1) / (F.col("tf") + F.lit(K1) * (F.lit(1.0 - B) + F.lit(B) * F.col("dl") / F.lit(index.avgdl)))
    parts = index.postings.join(terms, "t").select("query_id", "doc_id", (F.col("weight") * saturated).alias("part"))
    if also is not None:
        parts = parts.unionByName(also.select("query_id", "doc_id", F.lit(0.0).alias("part")))
    return parts.groupBy("query_id", "doc_id").agg(F.sum("part").alias("score"))


def bm25_top_k(docs: DataFrame, queries: DataFrame, k: int = 5, digits: int = 6, index: Bm25Index | None = None) -> DataFrame:
    """query_id, rank, doc_id, score: the k best, ties in corpus order (doc_id); where fewer than k documents score, the
    first others of the corpus with score 0. An empty corpus finds nothing."""
    first = [r["doc_id"] for r in docs.select("doc_id").orderBy("doc_id").limit(k).collect()]  # k at most
    kind = docs.schema["doc_id"].dataType
    index = index or bm25_index(docs)
    terms = query_terms(index, queries)
    names = queries.select("query_id").distinct()
    if terms.count() + names.count() <= BROADCAST_TERMS:
        return ranked(_best_by_document(index, terms, names, docs.sparkSession.createDataFrame([(d,) for d in first], docs.select("doc_id").schema), k, digits), k)
    also = queries.select("query_id", F.explode(F.array(*[F.lit(d) for d in first]).cast(ArrayType(kind))).alias("doc_id"))
    return ranked(bm25(index, queries, also, terms).withColumn("score", F.round("score", digits)), k)


def _rounded(x: np.ndarray, digits: int) -> np.ndarray:
    """As Spark rounds: halves of the shortest decimal form go up, away from 0."""
    scaled = np.abs(x) * 10.0**digits
    out = np.copysign(np.floor(scaled + 0.5) / 10.0**digits, x)
    for i in np.flatnonzero(np.abs(scaled - np.floor(scaled) - 0.5) < 1e-3):
        out[i] = float(Decimal(repr(float(x[i]))).quantize(Decimal(1).scaleb(-digits), ROUND_HALF_UP))
    return out + 0.0


def _best_by_document(index: Bm25Index, terms: DataFrame, names: DataFrame, first: DataFrame, k: int, digits: int) -> DataFrame:
    """query_id, doc_id, score of each task's k best of each query; documents of ``first`` count for every query.

    Postings of asked tokens are dealt by document, so that a document's scores are summed in one task, some documents at a
    time; pairs of query and document are neither shuffled nor held.
    """
    spark, avgdl = terms.sparkSession, index.avgdl
    ids = [r["query_id"] for r in names.collect()]  # BROADCAST_TERMS at most, as the terms
    number = {q: i for i, q in enumerate(ids)}
    told = terms.collect()
    tokens_ = {t: i for i, t in enumerate(sorted({r["t"] for r in told}))}
    of = np.array([tokens_[r["t"]] for r in told], dtype=np.int64)
    order = np.argsort(of, kind="stable")
    who = np.array([number[r["query_id"]] for r in told], dtype=np.int64)[order]
    weight = np.array([r["weight"] for r in told], dtype=float)[order]
    many = np.bincount(of, minlength=len(tokens_)) if len(of) else np.zeros(0, dtype=np.int64)
    held = spark.sparkContext.broadcast((who, weight, np.append(many, 0), np.append(np.cumsum(many) - many, 0), len(ids)))  # the last: token -1
    kind = index.postings.schema["doc_id"].dataType
    codes = spark.createDataFrame(list(tokens_.items()), "t string, ti int")
    asked = index.postings.join(F.broadcast(codes), "t").select("doc_id", "dl", "tf", "ti")
    marks = first.select("doc_id", F.lit(1).alias("dl"), F.lit(0).alias("tf"), F.lit(-1).alias("ti"))
    rows = asked.unionByName(marks).repartition("doc_id").sortWithinPartitions("doc_id")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        who, weight, many, start, n = held.value
        least, best, open_, found, size = np.full(n, -np.inf), None, None, [], 0

        def leave() -> None:
            """Of the hits so far each query's k best stay."""
            nonlocal best, found, size
            t = pa.concat_tables(([best] if best is not None else []) + found)
            t = t.take(pc.sort_indices(t, sort_keys=[("q", "ascending"), ("score", "descending"), ("doc_id", "ascending")], null_placement="at_start"))
            q = t.column("q").to_numpy()
            at = np.flatnonzero(np.append(True, q[1:] != q[:-1])) if len(q) else np.zeros(0, dtype=np.int64)
            place = np.arange(len(q)) - np.repeat(at, np.diff(np.append(at, len(q))))
            best, found, size = t.filter(pa.array(place < k)), [], 0
            last = place == k - 1
            least[q[last]] = t.column("score").to_numpy()[last]

        def add(docs: pa.Array, dl: np.ndarray, tf: np.ndarray, ti: np.ndarray, row: np.ndarray) -> None:
            """Hits of whole documents; ``row`` numbers them from 0."""
            nonlocal size
            counts = many[ti]
            at = np.repeat(start[ti] - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())
            value = tf * (K1 + 1) / (tf + K1 * ((1.0 - B) + B * dl / avgdl)) if avgdl else np.zeros(len(tf))
            key, part = np.repeat(row, counts) * n + who[at], np.repeat(value, counts) * weight[at]
            if len(own := np.unique(row[ti < 0])):
                key, part = np.append(key, (own[:, None] * n + np.arange(n)).ravel()), np.append(part, np.zeros(len(own) * n))
            if (cells := (row[-1] + 1) * n) <= 4 * len(key):
                pairs = np.flatnonzero(np.bincount(key, minlength=cells))
                score = np.bincount(key, part, cells)[pairs]
            else:
                pairs, inverse = np.unique(key, return_inverse=True)
                score = np.bincount(inverse, part, len(pairs))
            near = score >= least[pairs % n] - 10.0**-digits  # what rounding may lift is rounded
            pairs, score = pairs[near], _rounded(score[near], digits)
            place = np.flatnonzero(np.append(True, row[1:] != row[:-1]))[pairs // n]
            found.append(pa.table({"q": pa.array(pairs % n), "doc_id": docs.take(pa.array(place)), "score": pa.array(score)}))
            size += len(pairs)
            if size > HELD:
                leave()

        def whole(b: pa.RecordBatch) -> None:
            docs = b.column("doc_id")
            dl, tf, ti = (b.column(c).to_numpy().astype(t) for c, t in (("dl", float), ("tf", float), ("ti", np.int64)))
            row = np.cumsum(changes(docs))
            upto = np.cumsum(many[ti] + (ti < 0) * n)
            lo = 0
            while lo < len(row):
                hi = max(lo + 1, int(np.searchsorted(upto, (upto[lo - 1] if lo else 0) + PARTS, "right")))
                if hi < len(row):  # at a document's border: before it, else after the first document
                    border = int(np.searchsorted(row, row[hi], "left"))
                    hi = border if border > lo else int(np.searchsorted(row, row[hi], "right"))
                add(docs.slice(lo, hi - lo), dl[lo:hi], tf[lo:hi], ti[lo:hi], row[lo:hi] - row[lo])
                lo = hi

        for b in batches:
            if not b.num_rows:
                continue
            if open_ is not None:
                b = pa.Table.from_batches([open_, b]).combine_chunks().to_batches()[0]
            last = int(np.flatnonzero(np.append(1, changes(b.column("doc_id"))[1:]))[-1])
            open_ = b.slice(last)  # a document may go on in the next batch
            if last:
                whole(b.slice(0, last))
        if open_ is not None:
            whole(open_)
            leave()
            yield from pa.table({"q": best.column("q").cast(pa.int32()), "doc_id": best.column("doc_id"), "score": best.column("score")}).to_batches()

    def changes(docs: pa.Array) -> np.ndarray:
        """1 where a document isn't the one before it; 0 at the start."""
        a, b = docs.slice(0, len(docs) - 1), docs.slice(1)
        other = pc.or_(pc.fill_null(pc.not_equal(a, b), False), pc.xor(pc.is_null(a), pc.is_null(b)))
        return np.append(0, other.to_numpy(zero_copy_only=False).astype(np.int64))

    hits = rows.mapInArrow(search, f"q int, doc_id {kind.simpleString()}, score double")
    back = spark.createDataFrame([(i, q) for i, q in enumerate(ids)], f"q int, query_id {names.schema['query_id'].dataType.simpleString()}")
    return hits.join(F.broadcast(back), "q").select("query_id", "doc_id", "score")


def ranked(hits: DataFrame, k: int, by: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The k best of each query by score, ties by the given columns, with their rank from 1."""
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), *by)
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _unit_rows(v: np.ndarray) -> np.ndarray:
    return v / np.maximum(np.sqrt((v * v).sum(axis=1, keepdims=True)), 1e-12)


def usable(vector: Column) -> Column:
    """Vectors that have a direction: not null, no null or non-finite component, not empty."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))
    return F.coalesce((F.size(vector) > 0) & F.forall(vector, lambda x: finite(x.cast("double"))), F.lit(False))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1)


def vector_top_k(table: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "unit_id", dedupe: str | None = None, digits: int = 6) -> DataFrame:
    """query_id, rank, unit, score (and the dedupe key): cosine top k over all units.

    ``dedupe`` names a column of which each value may appear once, with its best unit. Scores are rounded before they are
    ranked; ties by id. Vectors that are null, empty, or hold null or non-finite components take no part, nor do queries
    and units of different lengths meet. Queries and units are dealt into blocks; each pair of blocks is multiplied once,
    in batches, and hands on each query's own top k only.
    """
    cols = [id_col, *([dedupe] if dedupe else [])]
    types = [table.schema[c].dataType.simpleString() for c in cols]
    schema = ", ".join([f"query_id {queries.schema['query_id'].dataType.simpleString()}", *(f"{c} {t}" for c, t in zip(cols, types)), "score double"])
    ask = queries.where(usable(F.col("embedding"))).select("query_id", F.col("embedding").cast("array<double>").alias("embedding"), F.size("embedding").alias("_dim"))
    have = table.where(usable(F.col("embedding"))).select(*cols, F.col("embedding").cast("array<double>").alias("embedding"), F.size("embedding").alias("_dim"))
    asked = ask.count()
    query_blocks, unit_blocks = max(1, -(-asked // QUERY_BLOCK)), max(1, int(table.sparkSession.conf.get("spark.sql.shuffle.partitions")) // max(1, -(-asked // QUERY_BLOCK)))
    ask = ask.withColumn("_q", F.pmod(F.xxhash64("query_id"), F.lit(query_blocks)).cast("int")).withColumn("_u", F.explode(F.sequence(F.lit(0), F.lit(unit_blocks - 1))))
    have = have.withColumn("_u", F.pmod(F.xxhash64(id_col), F.lit(unit_blocks)).cast("int")).withColumn("_q", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))))
    none = lambda c, t: F.lit(None).cast(t).alias(c)
    both = ask.select("_q", "_u", "_dim", F.lit(0).alias("_unit"), "query_id", *map(none, cols, types), "embedding").unionAll(
        have.select("_q", "_u", "_dim", F.lit(1).alias("_unit"), none("query_id", queries.schema["query_id"].dataType), *cols, "embedding")
    )

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of rows sorted by block pair, length, queries first."""
        key, held, names, q = None, [], None, None
        for b in batches:
            if not b.num_rows:
                continue
            keys = np.stack([b.column(c).to_numpy() for c in ("_q", "_u", "_dim", "_unit")])
            cuts = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1
            for lo, hi in zip([0, *cuts], [*cuts, b.num_rows]):
                part = b.slice(lo, hi - lo)
                if tuple(keys[:3, lo]) != key:
                    key, held, names, q = tuple(keys[:3, lo]), [], None, None
                if not keys[3, lo]:
                    held.append(part)
                    continue
                if not held:
                    continue
                if q is None:
                    names = pa.concat_arrays([h.column("query_id") for h in held])
                    q = _unit_rows(np.concatenate([_matrix(h.column("embedding")) for h in held]))
                yield best(part, names, q)

    def best(b: pa.RecordBatch, names: pa.Array, q: np.ndarray) -> pa.RecordBatch:
        order = np.argsort(b.column(id_col).to_numpy(zero_copy_only=False), kind="stable")
        keys = b.column(dedupe).to_numpy(zero_copy_only=False)[order] if dedupe else None
        scores = np.round(_unit_rows(_matrix(b.column("embedding")))[order] @ q.T, digits)
        rows, of = [], []
        for j in range(scores.shape[1]):
            top = np.argsort(-scores[:, j], kind="stable")
            if dedupe:
                top = top[np.sort(np.unique(keys[top], return_index=True)[1])]
            rows.append(top[:k])
            of.append(np.full(len(rows[-1]), j))
        row, col = np.concatenate(rows), np.concatenate(of)
        return pa.RecordBatch.from_arrays([names.take(pa.array(col)), *(b.column(c).take(pa.array(order[row])) for c in cols), pa.array(scores[row, col])], names=["query_id", *cols, "score"])

    hits = both.repartition("_q", "_u").sortWithinPartitions("_q", "_u", "_dim", "_unit").mapInArrow(search, schema)
    if dedupe:
        first = Window.partitionBy("query_id", dedupe).orderBy(F.col("score").desc(), id_col)
        hits = hits.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")
    return ranked(hits, k, (id_col,))


def interleaved(lexical: DataFrame, semantic: DataFrame, k: int) -> DataFrame:
    """Rank-interleaved hits (query_id, rank, doc_id, modality): lexical 1, semantic 1, lexical 2, ...

    A hit is dropped if the same (doc_id, modality) came before, or the document came without a modality.
    """
    both = lexical.select("query_id", "doc_id", "modality", (2 * F.col("rank")).alias("turn")).unionByName(semantic.select("query_id", "doc_id", "modality", (2 * F.col("rank") + 1).alias("turn")))
    same = Window.partitionBy("query_id", "doc_id", "modality").orderBy("turn")
    before = Window.partitionBy("query_id", "doc_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    plain = F.coalesce(F.max(F.col("modality").isNull()).over(before), F.lit(False))
    kept = both.select("*", F.row_number().over(same).alias("_n"), plain.alias("_plain")).where("_n = 1 and not _plain")
    order = Window.partitionBy("query_id").orderBy("turn")
    return kept.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "doc_id", "modality")


def numbered_evidence(hits: DataFrame) -> DataFrame:
    """Adds evidence_id (e0, e1, ... along a trajectory, by step and rank) to hits (traj_id, step_index, rank, ...)."""
    along = Window.partitionBy("traj_id").orderBy("step_index", "rank")
    return hits.withColumn("evidence_id", F.concat(F.lit("e"), (F.row_number().over(along) - 1).cast("string")))
