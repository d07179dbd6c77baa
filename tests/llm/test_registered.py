"""Registered queries without SQL against plain Python, over the whole of the smallest tables."""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.llm import mixing, packing, queries
from quillspark.llm.common import text_key
from tests.oracle import DATA

from .test_operators import features_of, plain_tree, unigram, words, LOW

SF = str(DATA / "sf0.001")


@pytest.fixture(scope="module")
def table(spark):
    return [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source").orderBy("doc_id").collect()]


def test_packing(spark, table):
    got = queries.op2_packing(spark, SF).collect()
    by = defaultdict(list)
    for r in got:
        by[r["doc_id"]].append(r)
    lengths = Counter()
    for i, t, *_ in table:
        own = sorted(by[i], key=lambda r: r["piece"])
        n = len(words(t))
        assert [r["n_tokens"] for r in own] == [min(packing.MAX_TOKENS, n - k) for k in range(0, n, packing.MAX_TOKENS)] or (n == 0 and len(own) == 1)
        lengths.update(r["n_tokens"] for r in own)
    sizes = sorted(lengths)
    best = {0: {-1: 0}}  # plain optimum: padding with k buckets, the last of which ends at each length
    for k in range(1, packing.BUCKETS + 1):
        best[k] = {j: min(c + sum(lengths[s] * (sizes[j] - s) for s in sizes[i + 1 : j + 1]) for i, c in best[k - 1].items() if i < j) for j in range(len(sizes)) if any(i < j for i in best[k - 1])}
    least = min(b[len(sizes) - 1] for k, b in best.items() if k and len(sizes) - 1 in b)
    assert sum(r["padded_tokens"] - r["n_tokens"] for r in got) == least
    places = defaultdict(set)
    for r in got:
        assert r["padded_tokens"] >= r["n_tokens"] and (r["slot"] + 1) * r["padded_tokens"] <= max(packing.BUDGET, r["padded_tokens"])
        places[r["bucket"]].add((r["batch"], r["slot"]))
    for b, found in places.items():
        each = max(1, packing.BUDGET // max(1, next(r["padded_tokens"] for r in got if r["bucket"] == b)))
        assert found == {divmod(i, each) for i in range(sum(r["bucket"] == b for r in got))}


def test_nearest_neighbours(spark):
    rows = [(r["vec_id"], np.array(r["embedding"], dtype=float)) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect() if r["embedding"] is not None]
    ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
    got = defaultdict(list)
    for r in queries.op3_kmeans_tree(spark, SF).collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"], r["recall"]))
    hit = total = 0
    for q in [i for i in ids.tolist() if i % 20 == 0]:
        s = x @ x[ids == q][0]
        want = [i for i in ids[np.lexsort((ids, -s))].tolist() if i != q][:20]
        own = sorted(got[q])
        assert [r[0] for r in own] == list(range(1, 21)) and all(abs(r[2] - s[ids == r[1]][0]) < 1e-12 for r in own)
        assert [r[1] for r in own] == [r[1] for r in sorted(own, key=lambda r: (-r[2], r[1]))]
        hit, total = hit + len({r[1] for r in own} & set(want)), total + 20
        assert own[0][3] is None or 0.8 <= own[0][3] <= 1
    assert hit / total >= 0.9


def test_telephony(spark, table):
    got = {r["doc_id"]: r for r in queries.op6_telephony(spark, SF).collect()}
    from quillspark.llm import telephony

    assert len(got) == len(table)
    for i, t, *_ in table:
        raw = (t or "").encode()
        payload = raw + b" " * ((-len(raw)) % 192 or (192 if not raw else 0))
        media = telephony.wave_file(payload)
        pcm = np.repeat(telephony.MULAW[np.frombuffer(payload, np.uint8)].astype(int), 2)
        pcm[1:-1:2] = pcm[0:-2:2] + pcm[2::2] >> 1
        r = got[i]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
        assert (r["media_bytes"], r["media_sha256"], r["feature"]) == (len(media), hashlib.sha256(media).hexdigest(), features_of(payload, pcm.astype("<i2")))


def test_suffix_tree(spark, table):
    base, *_ = unigram(table, LOW)
    scores, kept, *_ = plain_tree(table)
    got = sorted(tuple(r) for r in queries.op7_suffix_tree(spark, SF).collect())
    assert len(kept) > 100
    for g, b, (_, s) in zip(got, sorted(base), scores):
        assert g[:5] == b[:5] and g[5] == pytest.approx(b[5], rel=1e-9) and g[6] == pytest.approx(s, rel=1e-5)


def test_token_files(spark, table):
    import public_tokenizers as P
    from tokenizers import Tokenizer

    tokenizer, start = Tokenizer.from_file(P.path("byte_bpe_50k.json")), 0
    got = sorted(tuple(r) for r in queries.op8_rans(spark, SF).collect())
    assert len(got) == len(table)
    for g, (i, t, *_) in zip(got, table):
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0]
        assert g == (i, start, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes()))
        start += len(ids)


def plain_mixture(spark, table):
    """Copies of each document (doc_id, text, lang, source) that the production mix takes."""
    mix = mixing.Mix()
    leaf = lambda r: ("domain%d" % (zlib.crc32((r[3] or "").encode()) % 4), r[2] or "\0", r[3] or "\0")
    by = defaultdict(list)
    for r in table:
        by[leaf(r)].append((r[0], r[1], len(words(r[1]))))
    given = mixing.budgets({k: sum(n for *_, n in v) for k, v in by.items()}, mix)
    want = {}
    for k, v in by.items():
        total = sum(n for *_, n in v)
        passes, rest = divmod(given[k], total) if total else (0, 0)
        keyed = spark.createDataFrame([x[:2] for x in v], "doc_id long, text string").select("doc_id", *text_key(F.col("text")))
        u = dict(tuple(r) for r in keyed.select("doc_id", F.xxhash64(F.lit(mix.seed), F.lit(passes).cast("int"), "doc_id", "_k1", "_k2")).collect())
        run = 0
        for d, _, n in sorted(v, key=lambda x: u[x[0]]):
            if passes + (run < rest):
                want[d] = passes + (run < rest)
            run += n
    return want


def test_mixture(spark, table):
    rows = {r[0]: r for r in table}
    want = {d: ("domain%d" % (zlib.crc32(rows[d][3].encode()) % 4), len(words(rows[d][1])), c) for d, c in plain_mixture(spark, table).items()}
    got = {r["doc_id"]: (r["domain"], r["n_tokens"], r["copies"]) for r in queries.op9_mixing(spark, SF).collect()}
    assert got == want


def test_ranking_on_what_it_did_not_see(spark):
    sf = str(DATA / "sf0.01")
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    got = [(labels[r["doc_id"]], r["score"], r["predicted"]) for r in queries.op10_ranking(spark, sf).collect() if r["held_out"] and labels.get(r["doc_id"]) is not None]
    good, bad = [s for q, s, _ in got if q == 1], [s for q, s, _ in got if q == 0]
    assert good and bad
    assert sum((a > b) + (a == b) / 2 for a in good for b in bad) / len(good) / len(bad) > 0.95
    assert sum(p == q for q, _, p in got) / len(got) > 0.9
