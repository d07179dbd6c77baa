"""Places where models plug in, with deterministic stand-ins: encoders, scorers, generators.

An encoder maps a list of texts to vectors, a scorer trajectory texts to scores, a generator prompts to replies. All are
called on batches by executors; a factory is called once a task, so a model is loaded once for many batches.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import scores as S
from .scores import normalized
from .text import last_capitalized

Encoder = Callable[[Sequence[str]], np.ndarray]
Scorer = Callable[[Sequence[str]], Sequence[float]]
Generator = Callable[[Sequence[str]], Sequence[str]]
# Colour words, each with the corner of the colour cube (red 4, green 2, blue 1) it stands for, the weight of
# a colour word, and that of white, the background, in an image.
CORNERS = {"red": 4, "green": 2, "blue": 1, "yellow": 6, "purple": 5}
COLOUR_WEIGHT, WHITE_WEIGHT = 2.0, 0.15
DIM = 32
#: Answers of a generator that errs.
WRONG = ["granite", "harbour", "lantern", "meadow", "orchid", "pepper", "quarry", "saddle", "thistle", "walnut"]


def word_vector(text: Column) -> Column:
    """A text's vector without a model, of the space of ``image_vector``: in the first 8 components its colour words by
    corner, in the others the number of its words by checksum."""
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("([a-z0-9]+)"))
    corner = F.create_map(*[F.lit(x) for pair in CORNERS.items() for x in pair])
    places = F.concat(
        F.transform(words, lambda w: F.struct((F.pmod(F.crc32(w.cast("binary")), F.lit(DIM - 8)) + 8).cast("int").alias("d"), F.lit(1.0).alias("x"))),
        F.transform(F.filter(words, lambda w: corner[w].isNotNull()), lambda w: F.struct(corner[w].alias("d"), F.lit(COLOUR_WEIGHT).alias("x"))),
    )
    return F.transform(F.sequence(F.lit(0), F.lit(DIM - 1)), lambda d: F.aggregate(places, F.lit(0.0), lambda s, p: s + F.when(p["d"] == d, p["x"]).otherwise(0.0)))


def image_vector(pixels: Column) -> Column:
    """The vector of an image given as an array of (red, green, blue) arrays: pixels by the nearest corner of the cube."""
    corners = F.transform(pixels, lambda p: F.aggregate(F.slice(p, 1, 3), F.lit(0), lambda s, c: 2 * s + (c >= 128).cast("int")))
    count = lambda d: F.size(F.filter(corners, lambda c: c == d)).cast("double")
    return F.transform(F.sequence(F.lit(0), F.lit(DIM - 1)), lambda d: count(d) * F.when(d == 7, F.lit(WHITE_WEIGHT)).otherwise(1.0))


def unit_rows(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12)


def _batched(df: DataFrame, column: str, name: str, kind: str, make: Callable[[], Callable]) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = make()
        for b in batches:
            yield b.assign(**{name: list(model(b[column].fillna("").tolist()))})

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema), f"`{name}` {kind}"])
    return df.mapInPandas(run, schema)


def encoded(df: DataFrame, column: str, make: Callable[[], Encoder] | None = None, name: str = "embedding") -> DataFrame:
    """Adds vectors of length 1, of a model or else ``word_vector``. Rows whose input can't be encoded should be left out before."""
    if make is None:
        return df.withColumn(name, normalized(word_vector(F.col(column))).cast("array<float>"))
    return _batched(df, column, name, "array<float>", lambda: (lambda model: lambda xs: unit_rows(np.asarray(model(xs), dtype=np.float32)).tolist())(make()))


def scored(df: DataFrame, column: str, make: Callable[[], Scorer], name: str = "score") -> DataFrame:
    return _batched(df, column, name, "double", make)


def generated(df: DataFrame, column: str, make: Callable[[], Generator], name: str = "reply") -> DataFrame:
    return _batched(df, column, name, "string", make)


def decodable(df: DataFrame, column: str, decode: Callable[[bytes], object]) -> DataFrame:
    """The rows whose bytes a decoder reads without raising; null bytes are left out."""

    def reads(content) -> bool:
        try:
            decode(content)
        except Exception:  # noqa: BLE001 - whatever a decoder raises, the row can't be used
            return False
        return True

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b[[reads(c) if c is not None else False for c in b[column]]]

    return df.mapInPandas(run, df.schema)


def two_way_score(yes: Column, no: Column) -> Column:
    """A score from the logits of two answers: the share of the first in their softmax."""
    return F.lit(1.0) / (F.lit(1.0) + F.exp(no - yes))


def stand_in_answer(key: Column, context: Column, gold: Column, accuracy: float = 0.6, seed: int = 0) -> Column:
    """A generator without a model: with a gold it gives that with the given probability, else a wrong one; without, the
    last capitalised word of the context. Draws depend on the key only, not on the order of rows."""
    wrong = F.filter(F.array(*map(F.lit, WRONG)), lambda w: F.lower(w) != F.lower(gold))
    pick = F.element_at(wrong, (F.pmod(F.xxhash64(F.lit(seed + 1), key), F.size(wrong).cast("long")) + 1).cast("int"))
    return F.when(gold.isNull(), last_capitalized(context)).otherwise(F.when(S.uniform(F.lit(seed), key) < accuracy, gold).otherwise(pick))
