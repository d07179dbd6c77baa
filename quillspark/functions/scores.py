"""Rewards, supports, priors and search scores as Column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import UNVERIFIABLE, content_tokens, let

TEXT_BAND, IMAGE_BAND = (0.5, 0.9), (0.15, 0.32)
UNVISITED = 1e6
EVIDENCE_BONUS = 0.2


def _nonempty(texts: Column) -> Column:
    return F.filter(F.coalesce(texts, F.lit([]).cast("array<string>")), lambda t: F.coalesce(t != "", F.lit(False)))


def fuse(local: Column, outcome: Column, alpha: Column | float = 0.5) -> Column:
    """alpha * local + (1 - alpha) * outcome; without a local score the outcome."""
    a = F.lit(alpha) if isinstance(alpha, float) else alpha
    return F.coalesce(a * local + (F.lit(1.0) - a) * outcome, outcome)


def fuse_answer(outcome: Column, support: Column, floor: Column | float = 0.3) -> Column:
    """The outcome, reduced towards ``floor`` of it as evidence support falls; without a support the outcome."""
    f = F.lit(floor) if isinstance(floor, float) else floor
    return F.coalesce(outcome * (f + (F.lit(1.0) - f) * support), outcome)


def unsupported_correct(outcome: Column, support: Column, threshold: float = 0.3) -> Column:
    return F.coalesce((support <= threshold) & (outcome >= 0.5), F.lit(False))


def score_source(action_type: Column, local: Column, support: Column) -> Column:
    return (
        F.when((action_type == "answer") & support.isNotNull(), "answer_support")
        .when((action_type == "answer") | local.isNull(), "outcome_only")
        .otherwise("local_plus_outcome")
    )


def lexical_recall(question: Column, texts: Column) -> Column:
    """Share of the question's content words in the text that has most of them."""

    def recall(asked: Column) -> Column:
        best = F.array_max(F.transform(_nonempty(texts), lambda t: F.size(F.array_intersect(asked, content_tokens(t)))))
        return F.when((F.size(asked) > 0) & best.isNotNull(), best / F.size(asked)).otherwise(F.lit(0.0))

    return let(content_tokens(question), recall)


def band(cosine: Column, lo: float, hi: float) -> Column:
    """A cosine mapped from lo..hi to 0..1, clamped."""
    if hi <= lo:
        raise ValueError("hi must exceed lo")
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), (cosine - F.lit(lo)) / F.lit(hi - lo)))


def grounding(action_type: Column, question: Column, texts: Column, images: Column) -> Column:
    """Relevance of a step's results to its question: null for answers, 0 without results, else the better of the words'
    recall and, for images, one half."""
    t, i = _nonempty(texts), _nonempty(images)
    by_image = F.when(F.size(i) > 0, F.lit(0.5)).otherwise(F.lit(0.0))
    by_text = F.when(F.size(t) > 0, lexical_recall(question, t)).otherwise(F.lit(0.0))
    return F.when(action_type != "answer", F.greatest(by_text, by_image))


def state_grounding(action_type: Column, question: Column, evidence: Column) -> Column:
    """Grounding of an action type in a whole state: all its evidence (source_action, title, text, image_path), titles included."""

    def of(own: Column) -> Column:
        texts = F.transform(own, lambda e: F.when(F.coalesce(e["title"], F.lit("")) != "", F.concat_ws(": ", e["title"], e["text"])).otherwise(e["text"]))
        return grounding(action_type, question, texts, F.transform(own, lambda e: e["image_path"]))

    return let(F.filter(evidence, lambda e: e["source_action"] == action_type), of)


def vector_grounding(action_type: Column, text_cosines: Column, image_cosines: Column) -> Column:
    """The same from cosines: the best of each modality, mapped by its band (image cosines count from 0)."""
    by_text = F.coalesce(band(F.array_max(text_cosines), *TEXT_BAND), F.lit(0.0))
    by_image = F.coalesce(band(F.greatest(F.array_max(image_cosines), F.lit(0.0)), *IMAGE_BAND), F.lit(0.0))
    return F.when(action_type != "answer", F.greatest(by_text, by_image))


def answer_support(answer: Column, texts: Column) -> Column:
    """struct(label, support): which share of the answer's words, and of its numbers, the evidence holds; the lesser counts."""
    evidence = _nonempty(texts)
    mine = content_tokens(answer)
    figures = F.filter(mine, lambda t: t.rlike(r"^\d+(?:\.\d+)?$"))
    words = F.array_except(mine, figures)
    held = F.flatten(F.transform(evidence, content_tokens))
    share = lambda part: F.size(F.array_intersect(part, held)) / F.size(part)
    by_words = F.when(F.size(words) > 0, share(words)).otherwise(F.lit(1.0))
    value = F.when(F.size(figures) == 0, by_words).otherwise(F.least(share(figures), by_words))
    unclear = F.lower(F.regexp_replace(answer, r"(?U)^\s+|\s+$", "")).isin(UNVERIFIABLE) | (F.size(mine) == 0)
    none = F.lit(None).cast("double")
    return (
        F.when(F.size(evidence) == 0, F.struct(F.lit("no_evidence").alias("label"), F.lit(0.0).alias("support")))
        .when(unclear, F.struct(F.lit("unverifiable").alias("label"), none.alias("support")))
        .otherwise(F.struct(F.lit("lexical").alias("label"), value.alias("support")))
    )


def judged_support(reply: Column) -> Column:
    """struct(label, support) of a judge's reply; the order of the tests matters, as one label holds another."""
    text = F.upper(F.coalesce(reply, F.lit("")))
    pair = lambda label, v: F.struct(F.lit(label).alias("label"), F.lit(v).cast("double").alias("support"))
    return (
        F.when(text.contains("NOT_REQUIRED") | text.contains("NOT REQUIRED"), pair("not_required", None))
        .when(text.contains("UNSUPPORTED"), pair("unsupported", 0.0))
        .when(text.contains("PARTIAL"), pair("partial", 0.5))
        .when(text.contains("SUPPORTED"), pair("supported", 1.0))
        .otherwise(pair("unparseable", None))
    )


def overlap_score(observations: Column, answer: Column) -> Column:
    """Share of the answer's words found anywhere in the observations, with a bonus for having any observation."""
    seen = F.lower(F.array_join(observations, " "))
    asked = F.filter(F.split(F.lower(F.coalesce(answer, F.lit(""))), r"(?U)\s+"), lambda t: t != "")
    found = F.size(F.filter(asked, lambda t: F.contains(seen, t)))
    bonus = F.when(F.regexp_replace(seen, r"(?U)\s+", "") != "", F.lit(EVIDENCE_BONUS)).otherwise(F.lit(0.0))
    return F.when(F.size(asked) == 0, F.lit(0.0)).otherwise(F.least(F.lit(1.0), bonus + F.lit(1.0 - EVIDENCE_BONUS) * (found / F.size(asked))))


def seeded_hash(*keys: Column) -> Column:
    """Hexadecimal digits that order rows at random, the same wherever they are taken: md5 of the keys joined by colons."""
    return F.md5(F.concat_ws(":", *[k.cast("string") for k in keys]).cast("binary"))


def uniform(*keys: Column) -> Column:
    """A number in [0, 1) that only depends on the keys: stands in for a random draw, whatever the order of rows."""
    return F.conv(F.substring(seeded_hash(*keys), 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))


def synthetic_score(hint: Column, noise: Column, correlation: float = 0.2) -> Column:
    """A blend of an outcome hint and uniform noise that correlates with a balanced outcome as asked; without a hint the noise."""
    rho = min(max(correlation, 0.0), 0.999)
    ratio = rho / math.sqrt(3.0 * (1.0 - rho * rho))
    a = ratio / (1.0 + ratio)
    return F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.lit(a) * hint + F.lit(1.0 - a) * noise)), noise)


def q_value(total: Column, visits: Column, prior: Column) -> Column:
    return F.when(visits > 0, total / visits).otherwise(prior)


def uct(q: Column, visits: Column, parent_visits: Column, c: float = 1.0) -> Column:
    """Upper confidence bound of a child; an unvisited one comes before all others, by its q."""
    wide = F.lit(c) * F.sqrt(F.ln(F.greatest(parent_visits, F.lit(1)).cast("double")) / visits)
    return F.when(visits == 0, F.lit(UNVISITED) + q).otherwise(q + wide)


def crop_box(width: Column, height: Column, region: Column) -> Column:
    """Whole-pixel box [left, top, right, bottom] of a region inside an image; null where nothing is left.

    Regions within [-1, 1] are shares of the sides. Halves round to even.
    """
    r = F.transform(region, lambda v: v.cast("double"))
    sane = (F.size(r) == 4) & (width > 0) & (height > 0) & ~F.exists(r, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    share = F.forall(r, lambda v: F.abs(v) <= 1.0)

    def side(i: int, size: Column) -> list[Column]:
        ends = [F.try_element_at(r, F.lit(i)), F.try_element_at(r, F.lit(i + 2))]
        ends = [F.when(share, e * size).otherwise(e) for e in ends]
        clamp = lambda v: F.rint(F.greatest(F.lit(0.0), F.least(size.cast("double"), v))).cast("long")
        return [clamp(F.least(*ends)), clamp(F.greatest(*ends))]

    (left, right), (top, bottom) = side(1, width), side(2, height)
    return F.when(F.coalesce(sane, F.lit(False)) & (right - left >= 1) & (bottom - top >= 1), F.array(left, top, right, bottom))


def normalized(vector: Column) -> Column:
    """A vector of length 1 (of its own length where that is below 1e-12)."""
    v = F.transform(vector, lambda x: x.cast("double"))
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    return F.transform(v, lambda x: x / F.greatest(norm, F.lit(1e-12)))
