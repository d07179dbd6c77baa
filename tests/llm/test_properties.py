"""Properties over arbitrary inputs, without Spark."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillspark.llm import packing, ranking, rans, rlz, secrets, telephony
from quillspark.llm.common import Words, slices

text = st.text(alphabet=st.sampled_from("ab \n\t\x0b\x0c\x0d\x1c\xa0é日🙂AK="), max_size=40)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), text), max_size=8))
def test_words_of_any_texts(texts):
    w = Words(pa.array(texts, pa.string()))
    got = [w.data[s:e].tobytes().decode() for s, e in zip(w.starts, w.ends)]
    want = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    assert got == [x for ws in want for x in ws] and w.counts.tolist() == list(map(len, want))
    by_word = {}
    for g, h in zip(got, w.hashes.tolist()):
        assert by_word.setdefault(g, h) == h
    assert len(set(by_word.values())) == len(by_word)
    assert ranking.features(pa.array(texts, pa.string())).shape == (len(texts), len(ranking.FEATURES))


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 5), max_size=300), st.lists(st.integers(0, 1000), min_size=6, max_size=6))
def test_coding_any_ids(ids, counts):
    table = rans.Table.of(counts)
    assert rans.decode(rans.encode(np.array(ids, dtype=np.uint32), table), table).tolist() == ids


@settings(max_examples=60, deadline=None)
@given(st.lists(text, min_size=1, max_size=6))
def test_pieces_part_where_the_library_parts(texts):
    P = pytest.importorskip("public_tokenizers")
    path = P.path("byte_bpe_50k.json")
    tokenizer = rans._tokenizers.setdefault(path, None) or rans.CachedTokenizer(path)
    rans._tokenizers[path] = tokenizer
    assert tokenizer.encode(texts, rans.odd_spacing(*rans.text_bytes(pa.array(texts)))) == tokenizer.plain(texts)


@settings(max_examples=40, deadline=None)
@given(st.binary(max_size=500))
def test_any_payload_is_stored_whole(raw):
    payload = telephony.padded(raw)
    assert len(payload) % telephony.UNIT == 0 and payload[: len(raw)] == raw and payload[len(raw) :].strip(b" ") == b""
    assert bytes(telephony.parse_wave(telephony.wave_file(payload))[2]) == payload


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=60), st.integers(2, 4), st.integers(5, 9))
def test_equal_windows_share_anchor_and_offset(values, anchor, window):
    w = Words(pa.array([" ".join("w%d" % v for v in values)]))
    _, first, count, lead, block, _ = rlz.passages(w, window, anchor)
    assert count.sum() == max(0, len(values) - window + 1)
    seen = {}
    for f, c, a, b in zip(first, count, lead, block):
        for s in range(f, f + c):
            assert 0 <= a - (s - f) <= window - anchor
            assert seen.setdefault(tuple(values[s : s + window]), (b, a - (s - f))) == (b, a - (s - f))


@settings(max_examples=40, deadline=None)
@given(st.lists(st.text(max_size=30), max_size=20), st.integers(1, 50))
def test_slices_lose_nothing(texts, limit):
    batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], names=["text"])
    assert [t for b in slices(iter([batch]), limit=limit) for t in b.column("text").to_pylist()] == texts


@settings(max_examples=40, deadline=None)
@given(st.dictionaries(st.integers(0, 60), st.integers(1, 9), min_size=1, max_size=12), st.integers(1, 5))
def test_boundaries_cover_all_lengths(histogram, buckets):
    edges = packing.boundaries(histogram, buckets)
    assert edges == sorted(set(edges)) and len(edges) <= buckets and edges[-1] == max(histogram) and set(edges) <= set(histogram)


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet=st.sampled_from("tokenTOKEN:= abcdef0123456789AKI'\"🙂"), max_size=60))
def test_masking_keeps_what_is_no_secret(t):
    found = sorted((s, i, e, r.kind) for i, r in enumerate(secrets.RULES) for s, e in r.spans(t))
    gone = set().union(*(range(s, e) for s, _, e, _ in found))
    rest = "".join(c for i, c in enumerate(t) if i not in gone)
    assert re.sub(r"\[(assign|access|hex|\w+_\w+)\]", "", secrets.masked(t, found)) == rest
