"""Packing into optimal length buckets.

The histogram of piece lengths over the whole corpus has at most ``max_tokens`` + 1 bars, so the boundaries that minimise
padding come from dynamic programming on the driver. Inside each bucket, pieces form batches of equal token budgets.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import materialize

MAX_TOKENS, BUCKETS, BUDGET = 2048, 12, 65536
#: Pieces that one task ranks at a time, about.
SLICE_ROWS = 4096
WORD = r"[^\x20\x09-\x0D]+"


def count_words(text: Column) -> Column:
    """Number of words of a text; 0 for a null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def boundaries(histogram: dict[int, int], buckets: int) -> list[int]:
    """At most ``buckets`` upper lengths with the least total padding for pieces of the given lengths; the last is the longest.

    Among equally good choices, the one with fewest buckets, then with the shortest boundaries from the right.
    """
    lengths = np.array(sorted(n for n, c in histogram.items() if c), dtype=np.int64)
    if not len(lengths):
        return []
    counts = np.array([histogram[int(n)] for n in lengths], dtype=float)
    items = np.concatenate([[0], np.cumsum(counts)])
    tokens = np.concatenate([[0], np.cumsum(counts * lengths)])
    m = len(lengths)
    best = np.full(m + 1, np.inf)
    best[0] = 0
    back = []
    for _ in range(min(buckets, m)):
        row, come = np.full(m + 1, np.inf), np.zeros(m + 1, dtype=np.int64)
        row[0] = 0
        for j in range(1, m + 1):
            cost = best[:j] + lengths[j - 1] * (items[j] - items[:j]) - (tokens[j] - tokens[:j])
            come[j] = int(cost.argmin())
            row[j] = cost[come[j]]
        back.append(come)
        if row[m] == best[m]:
            back.pop()
            break
        best = row
    out, j = [], m
    for come in reversed(back):
        if j == 0:
            break
        out.append(int(lengths[j - 1]))
        j = int(come[j])
    return out[::-1]


def _spread(h: Column, slices: Column) -> Column:
    """The slice, of ``slices`` equal parts of the range of a 64-bit hash, that h lies in: slices ascend as hashes do."""
    return F.floor((F.shiftright(h, 33) + F.lit(1 << 30)) * slices / F.lit(float(1 << 31))).cast("long")


def pack(docs: DataFrame, max_tokens: int = MAX_TOKENS, buckets: int = BUCKETS, budget: int = BUDGET, seed: int = 1, with_text: bool = False) -> DataFrame:
    """A row per piece: doc_id, piece (from 0), first_token, n_tokens, bucket (from 0), padded_tokens, batch, slot.

    Tokens are words. Texts of more than ``max_tokens`` are cut into pieces of that length, the rest last; nothing is
    dropped: a null or empty text is one piece of no tokens. A bucket's pieces, in the order of a seeded hash, fill
    batches of ``budget`` // padded_tokens pieces (at least one), numbered from 0 in each bucket; slot is the place in a
    batch. Repeated rows are packed each; which of them comes first is of no matter. With ``with_text`` also the
    piece's words, joined by one space. Pieces that tie in their hash come by id and place. An empty table gives an empty
    one. Ids may be null and of any type. Other columns are ignored, whatever their names.
    """
    base = docs.select("doc_id", F.xxhash64(F.lit(seed), "doc_id", "text").alias("_h"), count_words(F.col("text")).alias("_n"), *(["text"] if with_text else []))
    sized = materialize(base, "sized")
    last = F.greatest(F.ceil(F.col("_n") / max_tokens) - 1, F.lit(0)).cast("int")
    pieces = sized.withColumn("piece", F.explode(F.sequence(F.lit(0), last))).withColumn("first_token", F.col("piece").cast("long") * max_tokens)
    pieces = pieces.withColumn("n_tokens", F.least(F.col("_n") - F.col("first_token"), F.lit(max_tokens)).cast("int"))
    bars = {r["n_tokens"]: r["c"] for r in pieces.groupBy("n_tokens").agg(F.count("*").alias("c")).collect()}  # max_tokens + 1 at most
    edges = boundaries(bars, buckets) or [0]
    totals = [sum(c for n, c in bars.items() if (not k or n > edges[k - 1]) and n <= e) for k, e in enumerate(edges)]

    def by_bucket(values: list[int], kind: str) -> Column:
        return F.element_at(F.array(*[F.lit(v).cast(kind) for v in values]), F.col("bucket") + 1)

    bucket = F.size(F.filter(F.array(*[F.lit(e) for e in edges[:-1]]).cast("array<int>"), lambda e: e < F.col("n_tokens"))) if len(edges) > 1 else F.lit(0)
    placed = (
        pieces.withColumn("bucket", bucket)
        .withColumn("padded_tokens", by_bucket(edges, "int"))
        .withColumn("_order", F.xxhash64("_h", "piece"))
        .withColumn("_slice", _spread(F.col("_order"), by_bucket([-(-t // SLICE_ROWS) or 1 for t in totals], "long")))
    )
    # ranks in a bucket: pieces in the slices before, and the place in the slice
    sizes = placed.groupBy("bucket", "_slice").agg(F.count("*").alias("_c"))
    before = sizes.select("bucket", "_slice", (F.sum("_c").over(Window.partitionBy("bucket").orderBy("_slice")) - F.col("_c")).alias("_before"))
    inner = F.row_number().over(Window.partitionBy("bucket", "_slice").orderBy("_order", "doc_id", "piece")) - 1
    ranked = placed.withColumn("_inner", inner).join(before, ["bucket", "_slice"]).withColumn("_rank", F.col("_before") + F.col("_inner"))
    each = by_bucket([max(1, budget // max(e, 1)) for e in edges], "long")
    out = ["doc_id", "piece", "first_token", "n_tokens", "bucket", "padded_tokens", F.floor(F.col("_rank") / each).alias("batch"), (F.col("_rank") % each).cast("int").alias("slot")]
    if with_text:
        out.append(F.array_join(F.slice(F.regexp_extract_all("text", F.lit(WORD), F.lit(0)), (F.col("first_token") + 1).cast("int"), F.greatest("n_tokens", F.lit(0))), " ").alias("text"))
    return ranked.select(*out)
