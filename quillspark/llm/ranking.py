"""Quality scores by Bradley-Terry pairwise ranking.

P(text i is preferred to text j) = sigmoid(s_i - s_j) with s linear in features of the text. The weights minimise the
logistic loss over feature differences of preference pairs (one text labelled 1, one labelled 0). The texts kept are
those above a quantile of the training texts' scores.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, crc_mod, gram_hashes, mix64, slices, span_hashes, text_key

#: Labelled rows that the model is fitted on, at most: those of the smallest hash of doc_id.
SAMPLE_ROWS = 20_000
PAIRS = 200_000
CUT = 0.7

_CLASSES = {"upper": range(65, 91), "digit": range(48, 58), "bang": b"!?", "sign": b"*#%&$@^~=+<>_", "bar": b"|\\/", "stop": b".,;:"}
FEATURES = ["log_words", "word_length", *_CLASSES, "other", "break", "same_word", "old_word", "old_gram", "old_line", "long_word", "signed_word"]


def _share(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return a / np.maximum(b, 1)


def _repeats(owner: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """For each of n owners, how many of its values are not the first of their kind."""
    if not len(values):
        return np.zeros(n)
    order = np.argsort(mix64(values) ^ mix64(owner.astype(np.uint64) + np.uint64(1)))
    o, v = owner[order], values[order]
    again = (o[1:] == o[:-1]) & (v[1:] == v[:-1])
    return np.bincount(o[1:][again], minlength=n)[:n].astype(float)


def features(texts: pa.Array) -> np.ndarray:
    """A row of len(FEATURES) numbers for each text (null: as empty). Uses the whole text and nothing else."""
    w = Words(texts)
    n, data = len(texts), w.data
    size = np.diff(w.bounds)
    first, last = w.bounds[:-1], w.bounds[1:]

    def count(mask: np.ndarray) -> np.ndarray:
        sums = np.zeros(len(mask) + 1, dtype=np.int64)
        np.cumsum(mask, out=sums[1:])
        return sums[last] - sums[first]

    table = np.zeros(256, dtype=np.int8)
    for i, chars in enumerate(_CLASSES.values(), 1):
        table[list(chars)] = i
    known = np.zeros(256, dtype=bool)
    known[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256), 32, *range(9, 14)]] = True
    kind = table[data]
    shares = [_share(count(kind == i), size) for i in range(1, len(_CLASSES) + 1)]
    other = _share(count(~known[data] & (kind == 0)), size)
    line = data == 10
    words = w.counts
    length = w.ends - w.starts
    same = np.zeros(len(w), dtype=bool)
    same[1:] = (w.hashes[1:] == w.hashes[:-1]) & (w.text_of[1:] == w.text_of[:-1])
    grams = gram_hashes(w.hashes, 3)
    inner = w.text_of[: len(grams)] == w.text_of[2:] if len(grams) else np.zeros(0, dtype=bool)
    # lines as runs of words: a line begins at a text's first word or where a break lies between two words
    breaks = np.zeros(len(data) + 1, dtype=np.int64)
    np.cumsum(line, out=breaks[1:])
    starts_line = np.zeros(len(w), dtype=bool)
    if len(w):
        starts_line[0] = True
        starts_line[1:] = (breaks[w.starts[1:]] != breaks[w.starts[:-1]]) | (w.text_of[1:] != w.text_of[:-1])
    begin = np.flatnonzero(starts_line)
    lines = span_hashes(w.hashes, begin, np.append(begin[1:], len(w))) if len(w) else np.zeros(0, dtype=np.uint64)
    line_of = w.text_of[begin]
    per = lambda mask: np.bincount(w.text_of[mask], minlength=n)[:n]
    signs = np.zeros(len(data) + 1, dtype=np.int64)
    np.cumsum((kind == 3) | (kind == 4) | (kind == 5), out=signs[1:])
    columns = [
        np.log1p(words),
        _share(np.bincount(w.text_of, weights=length, minlength=n)[:n], words) / 10,
        *shares,
        other,
        _share(count(line), words + 1),
        _share(per(same), words),
        _share(_repeats(w.text_of, w.hashes, n), words),
        _share(_repeats(w.text_of[: len(grams)][inner], grams[inner], n), words),
        _share(_repeats(line_of, lines, n), np.bincount(line_of, minlength=n)[:n]),
        _share(per(length > 24), words),
        _share(per(signs[w.ends] > signs[w.starts]), words),
    ]
    return np.stack(columns, axis=1).astype(float)


def expand(x: np.ndarray) -> np.ndarray:
    """The shares once as they are and once on a logarithmic scale, where small shares tell apart."""
    return np.concatenate([x, np.log(np.maximum(x[:, 1:], 0) + 1e-3)], axis=1)


@dataclass
class Ranker:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    cut: float  # strength at the quantile
    spread: float

    def strength(self, x: np.ndarray) -> np.ndarray:
        """Summed in the order of the features, so that equal texts get equal values in batches of any size."""
        z = np.clip((expand(x) - self.mean) / self.scale, -8, 8)
        out = np.zeros(len(x))
        for column, weight in zip(z.T, self.weights):
            out += column * weight
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        """0 to 1, increasing in strength; CUT exactly where the strength is that of the quantile."""
        z = (self.strength(x) - self.cut) / self.spread + np.log(CUT / (1 - CUT))
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def fit(x: np.ndarray, y: np.ndarray, pairs: int = PAIRS, penalty: float = 1e-3, quantile: float | None = None, seed: int = 17) -> Ranker:
    """Newton steps on the mean logistic loss of pair differences, with a ridge penalty.

    quantile: of the training scores, below which texts are rejected; unless given, the one whose threshold has the
    best balanced accuracy on the training rows. Without rows of both labels every text gets the same strength.
    """
    if not len(x) or y.min() == y.max():
        d = 2 * len(FEATURES) - 1
        return Ranker(np.zeros(d), np.ones(d), np.zeros(d), 0.0 if not len(y) or y.max() == 1 else 1.0, 1.0)
    wide = expand(x)
    mean, scale = wide.mean(axis=0), wide.std(axis=0) + 1e-6
    z = np.clip((wide - mean) / scale, -8, 8)
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    rng = np.random.default_rng(seed)
    d = z[rng.choice(good, pairs)] - z[rng.choice(bad, pairs)]
    weights = np.zeros(d.shape[1])
    for _ in range(25):
        p = 1 / (1 + np.exp(np.clip(d @ weights, -40, 40)))
        gradient = -(d * p[:, None]).mean(axis=0) + penalty * weights
        curve = (d * (p * (1 - p))[:, None]).T @ d / pairs + penalty * np.eye(len(weights))
        step = np.linalg.solve(curve, gradient)
        weights -= step
        if np.abs(step).max() < 1e-6:
            break
    s = z @ weights
    order = np.sort(s)
    if quantile is None:
        n0, n1 = len(bad), len(good)
        at = np.arange(len(s))
        below0 = np.searchsorted(np.sort(s[bad]), order, side="left")
        below1 = np.searchsorted(np.sort(s[good]), order, side="left")
        gain = below0 / n0 + 1 - below1 / n1
        # among equally good thresholds the lowest: a clean text is dearer than junk that stays
        quantile = at[np.flatnonzero(gain >= gain.max() - 5e-4)[0]] / len(s)
    i = min(int(quantile * len(s)), len(s) - 1)
    cut = order[i] if i == 0 else (order[i] + order[i - 1]) / 2
    return Ranker(mean, scale, weights, float(cut), float(max(s.std() / 2, 1e-6)))


def _feature_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.float64())
    for b in slices(batches):
        yield b.drop_columns(["text"]).append_column("x", pa.array(list(features(b.column("text"))), kind))


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, quantile: float | None = None, held_out: tuple[int, int] = (4, 2)) -> Ranker:
    """Fits on labelled rows whose id's crc32 modulo held_out[0] isn't held_out[1].

    Of the labels, at most ``sample_rows`` (those of the smallest hash of the id) take part; this bounded set is sent to
    the executors, so that the texts needn't be shuffled. Labels that are null, or of ids that are null, take no part;
    of contradicting labels the greater counts. An id counts once: of its rows the one with the least text key. Empty
    tables, or labels of one kind only, give a model that scores all texts alike.
    """
    chosen = (
        labels.where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & (crc_mod(F.col("doc_id"), held_out[0]) != held_out[1]))
        .groupBy("doc_id")
        .agg(F.max("quality").alias("y"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(sample_rows)
    )
    spark = docs.sparkSession
    rows = chosen.collect()  # at most sample_rows
    few = spark.createDataFrame(rows, chosen.schema)
    found = docs.select("doc_id", "text", *text_key(F.col("text"))).join(F.broadcast(few), "doc_id").select("doc_id", "y", "_k1", "_k2", "text")
    id_type = docs.schema["doc_id"].dataType.simpleString()
    found = found.mapInArrow(_feature_batches, f"doc_id {id_type}, y int, _k1 long, _k2 long, x array<double>")
    one = found.groupBy("doc_id").agg(F.min_by(F.struct("y", "x"), F.struct("_k1", "_k2")).alias("r"))  # at most sample_rows
    pdf = one.select("r.y", "r.x").toPandas().sort_values(["y"], kind="stable")
    x = np.array(pdf["x"].tolist(), dtype=float).reshape(-1, len(FEATURES))
    order = np.lexsort(x.T)  # the order in which executors answer must not matter
    return fit(x[order], pdf["y"].to_numpy()[order], quantile=quantile)


def score(docs: DataFrame, model: Ranker) -> DataFrame:
    """doc_id, score (0 to 1) and predicted (1 if score >= CUT) of every row.

    A null or empty text gets the score of the empty text; a text is read whole, however long; equal texts get equal
    scores. Repeated rows are scored each, rows without an id as well; an empty table gives an empty one. Other columns
    are ignored, whatever their names.
    """

    def run(batches):
        for b in slices(batches):
            s = model.score(features(b.column("text")))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(s), pa.array((s >= CUT).astype(np.int32))], names=["doc_id", "score", "predicted"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double, predicted int")


def keep(docs: DataFrame, model: Ranker) -> DataFrame:
    """The rows, all columns, that the model doesn't reject: those that ``score`` predicts 1 for, repeated ones each."""

    def run(batches):
        for b in slices(batches):
            yield b.filter(pa.array(model.score(features(b.column("text"))) >= CUT))

    return docs.mapInArrow(run, docs.schema)
