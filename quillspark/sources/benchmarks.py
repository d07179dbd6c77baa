"""Benchmarks as (queries, corpus): loaded from JSON lines, or a small built-in world for tests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scores import seeded_hash
from .jsonl import read_jsonl

QUERY = "query_id string, question string, gold_answers array<string>, image_path string, metadata map<string,string>"
DOCUMENT = "doc_id string, text string, title string, image_path string, entity_id string"

# A small world of our own: entity, kind of place, place, what a document says of it.
FACTS = [
    ("Atomium", "city", "Brussels", "Nine steel spheres joined by tubes make up the Atomium, a landmark of Brussels."),
    ("Kilimanjaro", "country", "Tanzania", "Snow lies on top of Kilimanjaro, a dormant volcano that rises from the plains of Tanzania."),
    ("Charles Bridge", "city", "Prague", "Thirty statues line the Charles Bridge, which crosses the river in the old town of Prague."),
    ("Geysir", "country", "Iceland", "Hot springs everywhere are named after Geysir, a fountain of boiling water in Iceland."),
    ("Belem Tower", "city", "Lisbon", "The Belem Tower guarded the harbour of Lisbon when ships left for the Indies."),
    ("Lake Bled", "country", "Slovenia", "A church stands on the island in Lake Bled, below the mountains of Slovenia."),
    ("Wawel Castle", "city", "Krakow", "Kings were crowned on the hill of Wawel Castle above the river in Krakow."),
    ("Ngorongoro Crater", "country", "Tanzania", "Herds graze all year inside the Ngorongoro Crater, a collapsed volcano of Tanzania."),
    ("Sibenik Cathedral", "country", "Croatia", "Stone heads of citizens look down from Sibenik Cathedral on the coast of Croatia."),
    ("Registan", "city", "Samarkand", "Three tiled schools face each other across the Registan, the square of Samarkand."),
    ("Salar de Uyuni", "country", "Bolivia", "After rain the Salar de Uyuni, a plain of salt in Bolivia, mirrors the sky."),
    ("Meiji Shrine", "city", "Tokyo", "A forest planted by volunteers surrounds the Meiji Shrine in Tokyo."),
    ("Band-e Amir", "country", "Afghanistan", "Walls of travertine hold the lakes of Band-e Amir in Afghanistan."),
    ("Hallgrimskirkja", "city", "Reykjavik", "Columns of basalt inspired Hallgrimskirkja, the tallest church of Reykjavik."),
    ("Plitvice Lakes", "country", "Croatia", "Waterfalls join the Plitvice Lakes, sixteen of them, in the woods of Croatia."),
    ("Gyeongbokgung", "city", "Seoul", "Guards change each morning before Gyeongbokgung, a palace in Seoul."),
    ("Lake Titicaca", "country", "Peru", "People live on islands of reeds in Lake Titicaca, high in the mountains of Peru."),
    ("Tsingy Forest", "country", "Madagascar", "Needles of limestone make the Tsingy Forest of Madagascar hard to cross."),
    ("Vigeland Park", "city", "Oslo", "More than two hundred sculptures stand in Vigeland Park, open day and night in Oslo."),
    ("Galle Fort", "country", "Sri Lanka", "The ramparts of Galle Fort kept the sea out of the old streets in Sri Lanka."),
]
TEMPLATES = [
    "In which {kind} would I find the {entity}?", "Which {kind} has the {entity} within its borders?", "To see the {entity}, which {kind} must one visit?",
    "The {entity} belongs to what {kind}?", "Name the {kind} of the {entity}.",
]
DISTRACTORS = [
    "Bees tell each other by dancing where flowers are.", "Salt lowers the temperature at which water freezes.", "Bread rises because yeast gives off gas.",
    "A violin has four strings tuned in fifths.", "Glass is made by melting sand with soda and lime.",
]


def builtin_world(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    """Questions made of each fact by each template, and documents: a titled one for each fact, untitled distractors."""
    facts = spark.createDataFrame([(i, *f) for i, f in enumerate(FACTS)], "i int, entity string, kind string, value string, fact string")
    forms = spark.createDataFrame([(v, t) for v, t in enumerate(TEMPLATES)], "v int, form string")
    name = F.concat(F.lit("doc_"), F.col("i").cast("string"))
    said = F.replace(F.replace("form", F.lit("{kind}"), F.col("kind")), F.lit("{entity}"), F.col("entity"))
    queries = facts.crossJoin(F.broadcast(forms)).select(
        F.concat_ws("_", F.lit("q"), F.col("i").cast("string"), F.col("v").cast("string")).alias("query_id"), said.alias("question"), F.array("value").alias("gold_answers"),
        F.lit(None).cast("string").alias("image_path"), F.create_map(F.lit("supporting_doc"), name, F.lit("attr"), F.col("kind")).alias("metadata"),
    )
    none = F.lit(None).cast("string")
    docs = facts.select(name.alias("doc_id"), F.concat_ws(". ", "entity", "fact").alias("text"), F.col("entity").alias("title"), none.alias("image_path"), none.alias("entity_id"))
    others = spark.createDataFrame([(f"distractor_{j}", t, "", None, None) for j, t in enumerate(DISTRACTORS)], DOCUMENT)
    return queries, docs.unionByName(others)


def load_benchmark(spark: SparkSession, name: str, data_dir: str | None = None, n: int | None = None, builtin: bool = False, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """Queries and corpus of a benchmark; ``n`` draws that many queries by a seeded hash of their id.

    Names are compared without case, hyphens and underscores. Infoseek's files carry its name as a prefix. Any other
    benchmark needs a data_dir.
    """
    key = name.lower().replace("-", "").replace("_", "")
    if builtin:
        queries, corpus = builtin_world(spark)
    else:
        if not data_dir:
            raise ValueError(f"benchmark {name!r} needs a data_dir")
        prefix = "infoseek_" if key == "infoseek" else ""
        raw = read_jsonl(spark, f"{data_dir}/{prefix}queries.jsonl", QUERY)
        queries = raw.withColumn("gold_answers", F.coalesce("gold_answers", F.array().cast("array<string>")))
        docs = read_jsonl(spark, f"{data_dir}/{prefix}corpus.jsonl", DOCUMENT)
        corpus = docs.withColumn("title", F.coalesce("title", F.lit(""))).withColumn("text", F.coalesce("text", F.lit("")))
    if n is not None:
        queries = queries.orderBy(seeded_hash(F.lit(seed), F.col("query_id")), "query_id").limit(n)
    return queries, corpus
