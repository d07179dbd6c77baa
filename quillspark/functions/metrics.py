"""Answer metrics as Column expressions. Golds are an array of strings; a gold may be a literal such as
``{'wikidata': 153.0, 'range': [137.7, 168.3]}``, which stands for a range of numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let, normalize_answer, numbers


def gold_range(gold: Column) -> Column:
    """struct(lo, hi) of a gold that is a range, else null."""
    read = F.from_json(gold, "wikidata double, range array<double>", {"mode": "PERMISSIVE", "allowSingleQuotes": "true"})["range"]
    whole = lambda r: (F.size(r) == 2) & ~F.exists(r, lambda x: x.isNull())
    ends = lambda r: F.when(whole(r), F.struct(F.array_min(r).alias("lo"), F.array_max(r).alias("hi")))
    return F.when(gold.contains("{") & gold.contains("range"), let(read, ends))


def _ranges(golds: Column) -> Column:
    return F.filter(F.transform(golds, gold_range), lambda r: r.isNotNull())


def _any_in(found: Column, r: Column) -> Column:
    return F.exists(found, lambda n: n.between(r["lo"], r["hi"]))


def in_some_range(prediction: Column, golds: Column) -> Column:
    """Whether any number of the prediction lies in any of the golds' ranges."""
    return let(numbers(prediction), lambda found: _some(found, _ranges(golds)))


def _some(found: Column, ranges: Column) -> Column:
    return F.coalesce(F.exists(ranges, lambda r: _any_in(found, r)), F.lit(False))


def exact_match(prediction: Column, golds: Column) -> Column:
    """1.0 if a number fits a range or the normalised prediction equals a normalised gold, else 0.0."""
    same = let(normalize_answer(F.coalesce(prediction, F.lit(""))), lambda mine: F.exists(golds, lambda g: normalize_answer(g) == mine))
    return (in_some_range(prediction, golds) | F.coalesce(same, F.lit(False))).cast("double")


def _split(normalized: Column) -> Column:
    return F.filter(F.split(normalized, " "), lambda t: t != "")


def _tokens(text: Column) -> Column:
    return _split(normalize_answer(text))


def _count(tokens: Column, t: Column) -> Column:
    return F.size(F.filter(tokens, lambda x: x == t))


def _overlap_f1(p: Column, g: Column) -> Column:
    """F1 of two token arrays as multisets; both empty: 1, one empty: 0."""
    common = F.array_intersect(p, g)
    same = F.aggregate(common, F.lit(0), lambda n, t: n + F.least(_count(p, t), _count(g, t)))

    def mean(n: Column) -> Column:
        precision, recall = n / F.size(p), n / F.size(g)
        return F.when(n == 0, F.lit(0.0)).otherwise(F.lit(2.0) * precision * recall / (precision + recall))

    return F.when((F.size(p) == 0) | (F.size(g) == 0), (F.size(p) == F.size(g)).cast("double")).otherwise(let(same, mean))


def token_f1(prediction: Column, gold: Column) -> Column:
    return let(_tokens(prediction), lambda p: let(_tokens(gold), lambda g: _overlap_f1(p, g)))


def f1(prediction: Column, golds: Column) -> Column:
    """The best token F1 against any gold; 1.0 where a number fits a range; 0.0 without golds."""
    best = let(_tokens(F.coalesce(prediction, F.lit(""))), lambda p: F.array_max(F.transform(golds, lambda x: let(_tokens(x), lambda g: _overlap_f1(p, g)))))
    return F.when(in_some_range(prediction, golds), F.lit(1.0)).otherwise(F.coalesce(best, F.lit(0.0)))


def range_accuracy(prediction: Column, golds: Column) -> Column:
    """Where a gold is a range, whether a number lies in the first one; else exact match."""
    numeric = let(_ranges(golds), lambda found: F.when(F.size(found) > 0, let(F.try_element_at(found, F.lit(1)), lambda r: F.coalesce(_any_in(numbers(prediction), r), F.lit(False)).cast("double"))))
    return F.coalesce(numeric, exact_match(prediction, golds))


def metrics(prediction: Column, golds: Column) -> Column:
    """struct(em, f1, accuracy): ``exact_match``, ``f1`` and ``range_accuracy``; each text is read once for all three, and
    normalised only where no number fits."""

    def by_words(x: Column) -> Column:
        same = F.coalesce(F.exists(x["golds"], lambda g: g == x["mine"]), F.lit(False))
        best = let(_split(x["mine"]), lambda p: F.array_max(F.transform(x["golds"], lambda t: let(_split(t), lambda g: _overlap_f1(p, g)))))
        return F.struct(same.cast("double").alias("em"), F.coalesce(best, F.lit(0.0)).alias("f1"))

    def of(x: Column) -> Column:
        words = F.struct(normalize_answer(F.coalesce(prediction, F.lit(""))).alias("mine"), F.transform(golds, normalize_answer).alias("golds"))
        both = F.when(_some(x["found"], x["ranges"]), F.struct(F.lit(1.0).alias("em"), F.lit(1.0).alias("f1"))).otherwise(let(words, by_words))
        first = let(F.try_element_at(x["ranges"], F.lit(1)), lambda r: F.coalesce(_any_in(x["found"], r), F.lit(False)).cast("double"))
        return let(both, lambda b: F.struct(b["em"].alias("em"), b["f1"].alias("f1"), F.when(F.size(x["ranges"]) > 0, first).otherwise(b["em"]).alias("accuracy")))

    return let(F.struct(numbers(prediction).alias("found"), _ranges(golds).alias("ranges")), of)
