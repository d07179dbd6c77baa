"""Tables, and SQL that several oracles share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Python's string.punctuation, for DuckDB's translate.
PUNCTUATION = "!\"#$%&''()*+,-./:;<=>?@[\\]^_`{|}~"
STOP = "['a','an','the','in','on','at','of','to','is','are','was','were','which','what','who','whom','whose','where','when','how','name','can','be','found','located','does','do','did']"
STOP_ALL = STOP[:-1] + ",'this','that','it']"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sql_tokens(text: str) -> str:
    return f"regexp_extract_all(lower({text}), '[a-z0-9]+')"


def sql_content(text: str) -> str:
    return f"list_distinct(list_filter(regexp_extract_all(lower({text}), '[a-z0-9'']+'), lambda t: not list_contains({STOP_ALL}, t)))"


def first_and_rest(text: str = "text") -> tuple[Column, Column]:
    """A text's first line, and all after it."""
    parts = F.split(F.coalesce(text, F.lit("")), "\n", 2)
    return F.element_at(parts, 1), F.coalesce(F.try_element_at(parts, F.lit(2)), F.lit(""))


def sql_first_and_rest(first: str, rest: str) -> str:
    """The same as columns of these names."""
    at = "strpos(coalesce(text, ''), chr(10))"
    return f"CASE WHEN {at} > 0 THEN left(text, {at} - 1) ELSE coalesce(text, '') END AS {first}, CASE WHEN {at} > 0 THEN substr(text, {at} + 1) ELSE '' END AS {rest}"


def sql_normalized(text: str) -> str:
    """Deletion of punctuation, then of article words: the ASCII word borders of DuckDB's engine would differ."""
    bare = f"translate(lower({text}), '{PUNCTUATION}', '')"
    return f"array_to_string(list_filter(regexp_split_to_array({bare}, '\\s+'), lambda t: not list_contains(['a','an','the',''], t)), ' ')"
