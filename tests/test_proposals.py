"""Proposals against plain Python, and queries without SQL against the standard library."""

from __future__ import annotations

import json
import random
import re
import zlib
from collections import Counter

from pyspark.sql import functions as F

from quillspark.functions.text import QUESTION_STOPWORDS
from quillspark.operators import search as M
from quillspark.plans import registry

from .oracle import DATA

REPLIES = [
    '{"type": "answer", "text": "Rome"}', '```\n{"type": "text_search", "query": "q"}\n{"type": "image_search"}\n```', "nothing", '{"type": "image_search"}\n{"type": "dance"}\n{broken}',
    '`{"type": "text_search", "query": ""}`\n  {"type": "answer", "text": "x"}  ', '{"type": "text_search", "query": "Where is it?"}', "",
]


def keywords(q):
    return " ".join(t for t in re.findall("[A-Za-z0-9']+", q) if t.lower() not in QUESTION_STOPWORDS)


def fallback(q, image, evidence, taken, k):
    found = [("text_search", q)]
    kw = keywords(q)
    if kw and kw != q:
        found.append(("text_search", kw))
    if image:
        found.append(("image_search", None))
    found = [a for a in found if a not in taken]
    if (evidence or not found) and len(found) < k:
        found.append(("answer", "?"))
    return found[:k]


def completed(reply, q, image, titles, evidence, taken, k):
    actions = []
    for line in reply.splitlines():
        line = line.strip().strip("`")
        if line.startswith("{") and line.endswith("}"):
            try:
                o = json.loads(line)
            except ValueError:
                continue
            if o.get("type") == "text_search" and o.get("query"):
                actions.append(("text_search", o["query"]))
            elif o.get("type") == "image_search" and image:
                actions.append(("image_search", None))
            elif o.get("type") == "answer" and o.get("text"):
                actions.append(("answer", o["text"]))
    actions = actions or fallback(q, image, evidence, taken, k)
    if not evidence:
        actions = [a for a in actions if a[0] != "answer"]
    if image and ("image_search", None) not in taken and not any(a[0] == "image_search" for a in actions):
        actions = actions[:1] + [("image_search", None)] + actions[1:]
    if not any(a[0] == "text_search" for a in actions):
        kw = keywords(q)
        for c in ([f"{titles[0]} {kw}".strip()] if titles and kw else []) + [kw or q]:
            if ("text_search", c) not in taken and ("text_search", c) not in actions:
                actions = [*actions, ("text_search", c)]
                break
    if not actions:
        actions = fallback(q, image, evidence, taken, k)
    return [a for a in actions if a not in taken][:k]


def test_policy_actions(spark):
    rng = random.Random(9)
    rows = []
    for i in range(120):
        q = rng.choice(["Where is it?", "the of", "Old tower", "In which city is the Tower?"])
        image, titles = rng.random() < 0.5, rng.choice([[], ["Tower"]])
        options = [("text_search", q), ("image_search", None)] + [("text_search", keywords(q))] * bool(keywords(q))
        rows.append((i, rng.choice(REPLIES), q, image, titles, rng.random() < 0.5, list(dict.fromkeys(rng.sample(options, rng.randrange(0, 3)))), rng.choice([2, 4])))
    for k in (2, 4):
        own = [r for r in rows if r[7] == k]
        df = spark.createDataFrame([(*r[:6], [(t, v, None, None, None) for t, v in r[6]]) for r in own], f"i int, reply string, q string, image boolean, titles array<string>, evidence boolean, taken {M.ACTION}")
        back = M.heuristic_actions(F.col("q"), F.col("image"), F.col("evidence"), F.col("taken"), F.lit("?"), k)
        a = M.completed_actions(M.parsed_actions(F.col("reply"), F.col("image")), back, F.col("q"), F.col("image"), F.col("titles"), F.col("evidence"), F.col("taken"), k)
        got = {r["i"]: [(x["type"], x["query"] if x["type"] != "answer" else x["text"]) for x in r["a"]] for r in df.select("i", a.alias("a")).collect()}
        for r in own:
            assert got[r[0]] == completed(*r[1:7], k), r


def test_frozen_queries(spark):
    df = spark.createDataFrame([(" a title ", "q?"), ("new", "q?"), ("q?", "q?")], "query string, question string")
    out = [r[0] for r in df.select(M.frozen_query(F.col("query"), F.col("question"), F.array(F.lit("a title"), F.lit("")))).collect()]
    assert out == ["a title", "q?", "q?"]


def test_hashed_words(spark):
    sf = str(DATA / "sf0.001")
    want = {}
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        for b, n in Counter(zlib.crc32(t.encode()) % 24 for t in re.findall("[a-z0-9]+", r["text"].lower())).items():
            want[r["doc_id"], b] = n
    assert {(r["doc_id"], r["bin"]): r["n"] for r in registry.QUERIES["hashed_words"](spark, sf).collect()} == want
