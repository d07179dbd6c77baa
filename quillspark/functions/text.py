"""Text functions as Column expressions: all stay in the JVM."""

from __future__ import annotations

import string

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that carry no content in questions.
QUESTION_STOPWORDS = [
    "a", "an", "the", "in", "on", "at", "of", "to", "is", "are", "was", "were",
    "which", "what", "who", "whom", "whose", "where", "when", "how", "name",
    "can", "be", "found", "located", "does", "do", "did",
]
CONTENT_STOPWORDS = [*QUESTION_STOPWORDS, "this", "that", "it"]
# Answers that evidence can neither confirm nor deny.
UNVERIFIABLE = ["yes", "no", "none", "true", "false", "unknown", "n/a"]
# Tokens of image file names that name no thing.
NOISE_TOKENS = ["archive", "by", "car", "class", "data", "gt", "image", "imagenet", "input", "test", "train", "val"]


def _all(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def let(value: Column, body) -> Column:
    """body(value) with the value computed once: lambdas evaluate what they close over for every element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _words(values: list[str]) -> Column:
    return F.array(*map(F.lit, values))


def collapse(text: Column) -> Column:
    """Runs of white space (any of Unicode's) become one space; none at the ends; null becomes empty."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s+", " "))


def tokens(text: Column) -> Column:
    """Runs of ASCII letters and digits of the lower-cased text."""
    return _all(F.lower(text), "[a-z0-9]+")


def content_tokens(text: Column) -> Column:
    """The set of words, apostrophes included, without stopwords."""
    return F.array_distinct(F.array_except(_all(F.lower(text), "[a-z0-9']+"), _words(CONTENT_STOPWORDS)))


def keyword_query(question: Column) -> Column:
    """The question's words in their order and case, without stopwords: the pattern leaves these out, so that no lambda runs a word."""
    stop = "|".join(QUESTION_STOPWORDS)
    return F.array_join(_all(question, rf"(?<![A-Za-z0-9'])(?!(?i:{stop})(?![A-Za-z0-9']))[A-Za-z0-9']+"), " ")


def normalize_answer(text: Column) -> Column:
    """Lower case, no ASCII punctuation, no articles, single spaces."""
    bare = F.translate(F.lower(text), string.punctuation, "")
    return collapse(F.regexp_replace(bare, r"(?U)\b(a|an|the)\b", " "))


def numbers(text: Column) -> Column:
    """Numbers in a text, thousands separators removed; what doesn't parse is left out."""
    found = _all(text, r"-?\d[\d,]*\.?\d*")
    return F.filter(F.transform(found, lambda x: F.replace(x, F.lit(","), F.lit("")).try_cast("double")), lambda x: x.isNotNull())


def chunks(text: Column, most: int = 1200) -> Column:
    """Paragraphs packed greedily, in order, into chunks of about ``most`` characters.

    A paragraph is never cut; a chunk ends where the next paragraph and a line break would exceed ``most``.
    """
    paragraphs = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), lambda p: F.regexp_replace(p, r"(?U)^\s+|\s+$", "")), lambda p: p != "")

    def step(state: Column, p: Column) -> Column:
        full = (F.length(state["open"]) + F.length(p) + 1 > most) & (state["open"] != "")
        done = F.when(full, F.concat(state["done"], F.array(state["open"]))).otherwise(state["done"])
        now = F.when(full | (state["open"] == ""), p).otherwise(F.concat_ws("\n", state["open"], p))
        return F.struct(done.alias("done"), now.alias("open"))

    start = F.struct(F.lit([]).cast("array<string>").alias("done"), F.lit("").alias("open"))
    return F.aggregate(paragraphs, start, step, lambda s: F.when(s["open"] == "", s["done"]).otherwise(F.concat(s["done"], F.array(s["open"]))))


def md5_bucket(key: Column, buckets: int = 10_000) -> Column:
    """The key's md5 as a 128-bit number, modulo ``buckets``: word by word, so that no step leaves 64 bits."""
    digest = F.md5(key.cast("binary"))
    rest = F.lit(0).cast("long")
    for i in range(4):
        word = F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long")
        rest = (rest * (1 << 32) + word) % buckets
    return rest


def in_validation(query_id: Column, fraction: float) -> Column:
    return md5_bucket(query_id) < int(fraction * 10_000)


def entity_of(doc_id: Column) -> Column:
    """What stands before the first ``_p``."""
    return F.substring_index(doc_id, "_p", 1)


def safe_id(text: Column) -> Column:
    """Letters and digits, all else single underscores, at most 120 characters; never empty."""
    cleaned = F.regexp_replace(F.regexp_replace(text, "[^A-Za-z0-9]+", "_"), "^_+|_+$", "")
    return F.coalesce(F.nullif(F.left(cleaned, F.lit(120)), F.lit("")), F.lit("entity"))


def image_suffix(url: Column, content_type: Column) -> Column:
    """File suffix of an image: from the address, else from the content type, else .jpg."""
    path = F.lower(F.substring_index(url, "?", 1))
    return (
        F.when(path.rlike(r"\.jpe?g$"), ".jpg")
        .when(path.endswith(".png"), ".png")
        .when(path.endswith(".webp"), ".webp")
        .when(content_type.contains("png"), ".png")
        .when(content_type.contains("webp"), ".webp")
        .otherwise(".jpg")
    )


def file_name(url: Column) -> Column:
    """The last part of an address's path, percent-decoded (a plus stays a plus)."""
    raw = F.substring_index(F.substring_index(url, "?", 1), "/", -1)
    return F.coalesce(F.try_url_decode(F.replace(raw, F.lit("+"), F.lit("%2B"))), raw)


def thumbnail_url(url: Column, width: int, base: str) -> Column:
    """Redirect to a thumbnail of the file: its name percent-encoded below ``base``."""
    name = F.replace(F.replace(F.url_encode(file_name(url)), F.lit("+"), F.lit("%20")), F.lit("%7E"), F.lit("~"))
    return F.concat(F.lit(base), F.replace(name, F.lit("*"), F.lit("%2A")), F.lit(f"?width={width}"))


def weak_label(name: Column) -> Column:
    """A label from an image's file name without its suffix: marks, sizes, long numbers and noise tokens go."""
    stem = F.coalesce(F.try_url_decode(F.replace(name, F.lit("+"), F.lit("%2B"))), name)
    after = F.regexp_extract(stem, "(?s)^.*?_gt_(.*)$", 1)
    part = F.when(F.instr(stem, "_gt_") > 0, after).when(F.instr(stem, "_input") > 0, F.substring_index(stem, "_input", 1)).otherwise(stem)
    for pattern in (r"(?i)ILSVRC\d*", r"(?i)\b\d{2,}x\d{2,}\b", r"\b\d{5,}\b", r"[_+%./\\-]+", r"(?<=[a-z])(?=[A-Z])"):
        part = F.regexp_replace(part, pattern, " ")
    noise = _words(NOISE_TOKENS)

    def says(t: Column) -> Column:
        low = F.lower(t)
        return ~F.array_contains(noise, low) & ~low.rlike(r"^\d{5,}$") & ((F.length(low) > 1) | low.rlike(r"^\d$"))

    return F.coalesce(F.nullif(F.array_join(F.filter(_all(part, "[A-Za-z0-9]+"), says), " "), F.lit("")), name)


def clipped(text: Column, most: int) -> Column:
    """White space collapsed; beyond ``most`` characters cut and marked by an ellipsis."""
    flat = collapse(text)
    return F.when(F.length(flat) <= most, flat).otherwise(F.concat(F.left(flat, F.lit(max(most - 1, 0))), F.lit("…")))


def letter(i: Column) -> Column:
    return F.char(i + 65)


def with_choices(question: Column, choices: Column) -> Column:
    """The question, then its choices lettered from A."""
    lettered = F.transform(choices, lambda c, i: F.concat(letter(i), F.lit(". "), c))
    return F.concat(question, F.lit("\nChoices: "), F.array_join(lettered, "; "))


def prompt(question: Column, context: Column) -> Column:
    """A question under its numbered context; verbatim where there is none."""
    lines = F.array_join(F.transform(context, lambda d, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), d)), "\n")
    return F.when(F.size(context) > 0, F.concat(F.lit("Context:\n"), lines, F.lit("\n\nQuestion: "), question, F.lit("\nAnswer:"))).otherwise(question)


def last_capitalized(context: Column) -> Column:
    """The last capitalised word of the first context text that has one, else "unknown"."""
    found = F.filter(F.transform(context, lambda d: _all(d, r"(?U)\b([A-Z][a-zA-Z]+)\b", 1)), lambda w: F.size(w) > 0)
    return F.when(F.size(found) > 0, F.element_at(F.element_at(found, 1), -1)).otherwise("unknown")
