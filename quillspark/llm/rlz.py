"""Substring dedup by relative Lempel-Ziv parsing against indexed blocks of the whole corpus.

Blocks. Every window of ``window`` words is given to its anchor: of the ``anchor`` words' n-grams inside, the one with
the least hash, the leftmost if tied. A passage is a run of consecutive windows with the same anchor. The distinct
passages of all documents are the reference; those of one anchor form a block. Equal windows have equal anchors, so a
document need be parsed only against the blocks that its own anchors name.

Factors. A passage that the reference holds elsewhere is one factor as a whole. Any other passage is parsed against the
block's other passages, which are indexed by their place around the anchor: greedily from left to right, at each
position the longest match of any of them. A factor of ``window`` words or more is a duplicate span, and the parse goes
on at the first window that crosses the factor's end; there, and wherever no factor is long enough, it moves on by one
word, so that each window at a factor's boundary is checked by itself. Together that finds exactly the windows that
occur twice. A block of more than ``most`` passages isn't held by one task: its single windows are compared by hash, in
slices of these, of equal windows that meet before one for all.

Passages are matched by 64 bits of the anchor and 64 of their words, or word by word.

Scale: about 2 / (window - anchor + 2) passages a word are shuffled, and words only of passages in blocks with several
passages. Counts combine before each shuffle, so no group is ever collected; sums by block are written before they are
joined, so that a hot block's side of the join can be split.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import discard, materialize
from .common import U64, Words, gram_hashes, i64, slices, span_hashes, text_key

WINDOW, ANCHOR = 35, 8
#: Passages of a block that one task parses against each other, at most.
MOST = 256
_PASSAGE = "block long, n long, _k1 long, _k2 long, at int, windows int, lead int, often int, words binary"


def passages(w: Words, window: int, anchor: int) -> tuple[np.ndarray, ...]:
    """Per passage: text, first word (of the slice), number of windows, words before the anchor, anchor's hash, hash of its words."""
    n = len(w)
    none = np.zeros(0, dtype=np.int64)
    if n < window:
        return none, none, none, none, none.view(U64), none.view(U64)
    grams = gram_hashes(w.hashes, anchor)
    # leftmost least n-gram of each window, by doubling
    width = window - anchor + 1
    low, at, have = grams, np.arange(len(grams), dtype=np.int32), 1
    while have < width:
        step = min(have, width - have)
        left = low[: len(low) - step] <= low[step:]
        low, at = np.where(left, low[: len(left)], low[step:]), np.where(left, at[: len(left)], at[step:])
        have += step
    inside = w.text_of[: n - window + 1] == w.text_of[window - 1 :]
    begin = inside.copy()
    begin[1:] &= (at[1:] != at[:-1]) | ~inside[:-1]
    first = np.flatnonzero(begin)
    stop = inside.copy()
    stop[:-1] &= (at[1:] != at[:-1]) | ~inside[1:]
    last = np.flatnonzero(stop)
    place = at[first]
    own = span_hashes(w.hashes, first, last + window, salt=1) ^ (place - first).astype(U64)
    return w.text_of[first], first, last - first + 1, place - first, grams[place], own


def _index_batches(batches: Iterator[pa.RecordBatch], window: int, anchor: int) -> Iterator[pa.RecordBatch]:
    for b in slices(batches):
        w = Words(b.column("text"))
        text, first, count, lead, block, passage = passages(w, window, anchor)
        k1, k2 = (b.column(c).to_numpy(zero_copy_only=False) for c in ("_k1", "_k2"))
        yield pa.RecordBatch.from_arrays(
            [i64(k1[text]), i64(k2[text]), *(pa.array(x.astype(np.int32)) for x in (first - w.first[text], count, lead)), i64(block), i64(passage)],
            names=["_k1", "_k2", "at", "windows", "lead", "block", "passage"],
        )


def _passage_batches(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """For texts with an array ``found`` of passages: each passage with the hashes of its words. Of copies that meet here, one counts."""
    previous = None
    for b in slices(batches):
        keys = list(zip(b.column("_k1").to_pylist(), b.column("_k2").to_pylist()))
        b = b.filter(pa.array([k != p for k, p in zip(keys, [previous, *keys])]))
        previous = keys[-1]
        if not b.num_rows:
            continue
        w = Words(b.column("text"))
        found = b.column("found")
        of = np.repeat(np.arange(b.num_rows), np.diff(found.offsets.to_numpy()))
        rows = found.flatten()
        start = w.first[of] + rows.field("at").to_numpy()
        stop = start + rows.field("windows").to_numpy() + window - 1
        raw = w.hashes.tobytes()
        words = [raw[8 * a : 8 * e] for a, e in zip(start.tolist(), stop.tolist())]
        keys = [b.column(c).take(pa.array(of)) for c in ("_k1", "_k2")]
        yield pa.RecordBatch.from_arrays(
            [rows.field("block"), rows.field("n"), *keys, *(rows.field(c) for c in ("at", "windows", "lead", "often")), pa.array(words, pa.binary())],
            names=["block", "n", "_k1", "_k2", "at", "windows", "lead", "often", "words"],
        )


def _words_of(b: pa.RecordBatch | pa.Table, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all passages' words, one passage after the other, and where each passage begins."""
    size = b.column("windows").to_numpy().astype(np.int64) + window - 1
    return np.frombuffer(b"".join(b.column("words").to_pylist()), dtype=U64), np.cumsum(size) - size


def parse(block: np.ndarray, often: np.ndarray, lead: np.ndarray, windows: np.ndarray, flat: np.ndarray, first: np.ndarray, window: int, anchor: int, pairs: int = 1 << 14) -> np.ndarray:
    """Bit masks of the duplicate windows of all passages that stand once; rows are sorted by block.

    The greedy parse runs in step for all passages: column ``left`` of a passage's row is its anchor's first word.
    """
    m, left = len(block), window - anchor
    width = 2 * left + anchor
    size = windows + window - 1
    row = np.repeat(np.arange(m), size)
    column = np.arange(len(flat)) - np.repeat(first, size) + np.repeat(left - lead, size)
    words, there = np.zeros((m, width), dtype=U64), np.zeros((m, width), dtype=bool)
    words[row, column], there[row, column] = flat, True
    low, high = np.searchsorted(block, block, side="left"), np.searchsorted(block, block, side="right")
    best = np.zeros((m, left + 1), dtype=np.int64)
    once = np.flatnonzero((often == 1) & (high - low > 1))
    ends = np.cumsum((high - low)[once])
    done = 0
    while done < len(once):
        to = max(done + 1, int(np.searchsorted(ends, (ends[done - 1] if done else 0) + pairs, side="right")))
        own = once[done:to]
        n = (high - low)[own]
        p = np.repeat(own, n)
        q = np.arange(len(p)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low[own], n)
        p, q = p[p != q], q[p != q]
        same = (words[p] == words[q]) & there[p] & there[q]
        same_left = np.append(same[:, :left][:, ::-1], np.zeros((len(p), 1), dtype=bool), axis=1).argmin(axis=1)
        same_right = np.append(same[:, left + anchor :], np.zeros((len(p), 1), dtype=bool), axis=1).argmin(axis=1)
        ok = same[:, left : left + anchor].all(axis=1)
        np.maximum.at(best, (p[ok], (left - same_left)[ok]), (left + anchor + same_right)[ok])
        done = to
    # reach[i, c]: where the longest match of passage i that covers column c ends
    reach = np.maximum.accumulate(best, axis=1)
    mask = np.zeros(m, dtype=U64)
    at, begin = (left - lead)[once].astype(np.int64), (left - lead)[once]
    last = begin + windows[once] - 1
    while len(once):
        end = reach[once, at]
        factor = end - at >= window
        n = np.where(factor, end - at - window + 1, 0).astype(U64)
        mask[once] |= ((U64(1) << n) - U64(1)) << (at - begin).astype(U64)
        at = np.where(factor, end - window + 1, at + 1)
        on = at <= last
        once, at, begin, last = once[on], at[on], begin[on], last[on]
    return mask


def _parse_batches(batches: Iterator[pa.RecordBatch], window: int, anchor: int, rows: int = 4096) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by block: the masks of the passages that have any duplicate window."""

    def parsed(t: pa.Table) -> pa.RecordBatch:
        block, often, lead, windows = (t.column(c).to_numpy() for c in ("block", "often", "lead", "windows"))
        mask = parse(block, often, lead, windows, *_words_of(t, window), window, anchor)
        some = pa.array(np.flatnonzero(mask))
        return pa.RecordBatch.from_arrays([*(t.column(c).take(some).combine_chunks() for c in ("_k1", "_k2", "at", "windows")), i64(mask).take(some)], names=["_k1", "_k2", "at", "windows", "mask"])

    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        held.append(b)
        if sum(x.num_rows for x in held) >= rows:
            t = pa.Table.from_batches(held)
            block = t.column("block").to_numpy()
            cut = int(np.searchsorted(block, block[-1]))
            if cut:
                yield parsed(t.slice(0, cut))
            held = t.slice(cut).to_batches()
    if held:
        yield parsed(pa.Table.from_batches(held))


_ENTRY = np.dtype([("window", "<u8"), ("_k1", "<i8"), ("_k2", "<i8"), ("at", "<i4"), ("windows", "u1"), ("offset", "u1"), ("often", "u1")])
#: Passages whose windows are dealt at once, and windows that a slice of a block holds, about.
DEALT, SLICE_WINDOWS = 8192, 65536


def _deal_batches(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """The windows of large blocks' passages, packed by block and slice of their hashes.

    Of equal windows that meet here one is dealt, as occurring twice; these are known to be duplicates, in slices below 0.
    """

    def dealt(t: pa.Table) -> Iterator[tuple[int, int, bytes]]:
        flat, first = _words_of(t, window)
        count = t.column("windows").to_numpy()
        which = np.repeat(np.arange(len(count)), count)
        e = np.zeros(len(which), dtype=_ENTRY)
        e["offset"] = np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count)
        e["window"] = gram_hashes(flat, window, salt=2)[first[which] + e["offset"]]
        for c in ("_k1", "_k2", "at", "windows", "often"):
            e[c] = t.column(c).to_numpy()[which]
        blocks = t.column("block").to_numpy()[which]
        slices_ = np.maximum(1, t.column("n").to_numpy()[which] * (window - 1) // SLICE_WINDOWS)
        order = np.lexsort((e["window"], blocks))
        e, blocks, slices_ = e[order], blocks[order], slices_[order]
        begin = np.flatnonzero(np.append(True, (blocks[1:] != blocks[:-1]) | (e["window"][1:] != e["window"][:-1])))
        twice = np.add.reduceat(e["often"].astype(np.int64), begin) > 1
        size = np.diff(np.append(begin, len(e)))
        known = np.repeat(twice, size) & (e["often"] == 1)
        to = np.full(len(e), -1)
        to[begin] = (e["window"][begin] >> U64(32)).astype(np.int64) % slices_[begin]
        sent = e[begin]
        sent["often"] = np.where(twice, 2, 1)
        for part, slice_, block in ((e[known], np.full(known.sum(), -1 - TaskContext.get().partitionId()), blocks[known]), (sent, to[begin], blocks[begin])):
            order = np.lexsort((slice_, block))
            part, slice_, block = part[order], slice_[order], block[order]
            cuts = np.flatnonzero((slice_[1:] != slice_[:-1]) | (block[1:] != block[:-1])) + 1
            for lo, hi in zip([0, *cuts], [*cuts, len(part)]):
                if hi > lo:
                    yield int(block[lo]), int(slice_[lo]), part[lo:hi].tobytes()

    def rows(held):
        found = list(dealt(pa.Table.from_batches(held)))
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found), (pa.int64(), pa.int32(), pa.binary()))], names=["block", "slice", "entries"])

    held: list[pa.RecordBatch] = []
    for b in batches:
        if b.num_rows:
            held.append(b)
        if sum(x.num_rows for x in held) >= DEALT:
            yield rows(held)
            held = []
    if held:
        yield rows(held)


def _slice_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by block and slice: the masks of the passages with windows that occur twice in their slice."""

    def masks(slice_: int, entries: list[bytes]) -> pa.RecordBatch:
        e = np.frombuffer(b"".join(entries), dtype=_ENTRY)
        if slice_ >= 0:
            e = e[np.argsort(e["window"], kind="stable")]
            begin = np.flatnonzero(np.append(True, e["window"][1:] != e["window"][:-1]))
            often = np.repeat(np.add.reduceat(e["often"].astype(np.int64), begin), np.diff(np.append(begin, len(e))))
            e = e[(often > 1) & (e["often"] == 1)]
        e = e[np.lexsort((e["at"], e["_k2"], e["_k1"]))]
        begin = np.flatnonzero(np.append(True, (e["_k1"][1:] != e["_k1"][:-1]) | (e["_k2"][1:] != e["_k2"][:-1]) | (e["at"][1:] != e["at"][:-1]))[: len(e)])
        mask = np.bitwise_or.reduceat(U64(1) << e["offset"].astype(U64), begin) if len(e) else np.zeros(0, dtype=U64)
        return pa.RecordBatch.from_arrays([pa.array(e[c][begin].astype(k)) for c, k in (("_k1", "i8"), ("_k2", "i8"), ("at", "i4"), ("windows", "i4"))] + [i64(mask)], names=["_k1", "_k2", "at", "windows", "mask"])

    key, held = None, []
    for b in batches:
        for block, slice_, entries in zip(*(b.column(c).to_pylist() for c in ("block", "slice", "entries"))):
            if held and (key != (block, slice_) or slice_ < 0):
                yield masks(key[1], held)
                held = []
            key = (block, slice_)
            held.append(entries)
    if held:
        yield masks(key[1], held)


def find_spans(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, most: int = MOST) -> DataFrame:
    """Per distinct text ``_k1, _k2`` the array ``spans`` of its duplicate windows: at (first word of
    the passage), mask (bit i: the window at word ``at + i``; null: all), windows."""
    texts = docs.select(*text_key(F.col("text")), F.coalesce("text", F.lit("")).alias("text"))
    every = materialize(texts.mapInArrow(lambda it: _index_batches(it, window, anchor), "_k1 long, _k2 long, at int, windows int, lead int, block long, passage long"), "every")
    # an anchor that stands in one place only matches nothing
    shared = materialize(every.groupBy("block").agg(F.count("*").alias("n")).where("n > 1").select("block"), "shared")
    found = materialize(every.join(shared, "block", "left_semi"), "found")
    where = F.min(F.struct("_k1", "_k2", "at", "windows", "lead")).alias("where")
    distinct = found.groupBy("block", "passage").agg(F.count("*").alias("c"), where)
    reference = materialize(distinct.select("block", "passage", F.least("c", F.lit(2)).cast("int").alias("often"), "where.*"), "reference")
    # blocks in which a passage that stands once meets other passages
    mixed = materialize(reference.groupBy("block").agg(F.count("*").alias("n"), F.min("often").alias("least")).where("n > 1 and least = 1").select("block", "n"), "mixed")
    wanted = reference.join(mixed, "block").groupBy("_k1", "_k2").agg(F.collect_list(F.struct("at", "windows", "lead", "block", "n", "often")).alias("found"))
    met = materialize(wanted.join(texts.mapInArrow(_first_of_each, texts.schema), ["_k1", "_k2"]).mapInArrow(lambda it: _passage_batches(it, window), _PASSAGE), "passages")
    parsed = met.where(F.col("n") <= most).repartition("block").sortWithinPartitions("block").mapInArrow(lambda it: _parse_batches(it, window, anchor), "_k1 long, _k2 long, at int, windows int, mask long")
    dealt = materialize(met.where(F.col("n") > most).mapInArrow(lambda it: _deal_batches(it, window), "block long, slice int, entries binary"), "dealt")
    compared = dealt.repartition("block", "slice").sortWithinPartitions("block", "slice").mapInArrow(_slice_batches, "_k1 long, _k2 long, at int, windows int, mask long")
    repeated = reference.where("often > 1").select("block", "passage")
    whole = found.join(repeated, ["block", "passage"], "left_semi").select("_k1", "_k2", "at", "windows", F.lit(None).cast("long").alias("mask"))
    spans = whole.unionByName(parsed).unionByName(compared).groupBy("_k1", "_k2").agg(F.collect_set(F.struct("at", "windows", "mask")).alias("spans"))
    spans = materialize(spans, "spans")
    for done in (every, shared, found, reference, mixed, met, dealt):
        discard(done)
    return spans


def _first_of_each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of equal texts in a partition the first: combines copies before they are shuffled."""
    seen: set[tuple[int, int]] = set()
    for b in batches:
        stay = []
        for i, k in enumerate(zip(b.column("_k1").to_pylist(), b.column("_k2").to_pylist())):
            if k not in seen:
                seen.add(k)
                stay.append(i)
        yield b.take(pa.array(stay, pa.int64()))


def cut_batches(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    for b in slices(batches):
        w = Words(b.column("text"))
        spans = b.column("spans")
        spans = spans.fill_null([]) if spans.null_count else spans
        of = np.repeat(np.arange(b.num_rows), np.diff(spans.offsets.to_numpy()))
        rows = spans.flatten()
        at, count = w.first[of] + rows.field("at").to_numpy(), rows.field("windows").to_numpy()
        mask = rows.field("mask")
        all_ = mask.is_null().to_numpy(zero_copy_only=False)
        bits = mask.fill_null(0).to_numpy()
        # whole passages cover all their words; of others, each window whose bit is set covers its own
        begins, ends = [at[all_]], [at[all_] + count[all_] + window - 1]
        part_at, part_bits = at[~all_], bits[~all_]
        for i in range(int(count[~all_].max(initial=0))):
            s = part_at[(part_bits >> i) & 1 == 1] + i
            begins.append(s)
            ends.append(s + window)
        covered = np.bincount(np.concatenate(begins), minlength=len(w) + 1) - np.bincount(np.concatenate(ends), minlength=len(w) + 1)
        gone = np.cumsum(covered[:-1]) > 0
        removed = np.bincount(w.text_of[gone], minlength=b.num_rows)[: b.num_rows]
        raw, kept = w.data, []
        for i in range(b.num_rows):
            part = slice(w.first[i], w.first[i + 1])
            stay = ~gone[part]
            if removed[i] == 0:
                kept.append(b" ".join(raw[w.bounds[i] : w.bounds[i + 1]].tobytes().split()))
            else:
                s, e = w.starts[part][stay].tolist(), w.ends[part][stay].tolist()
                text = raw.data
                kept.append(b" ".join([bytes(text[x:y]) for x, y in zip(s, e)]))
        yield pa.RecordBatch.from_arrays(
            [b.column("doc_id"), pa.array(w.counts.astype(np.int64)), pa.array(removed.astype(np.int64)), pa.array([k.decode() for k in kept])], names=["doc_id", "n_words", "n_removed", "kept_text"]
        )


def remove_repeats(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, most: int = MOST) -> DataFrame:
    """doc_id, n_words, n_removed and kept_text (the words that stay, joined by one space) of every row.

    A word goes if it lies in a window of ``window`` words whose sequence also starts anywhere else, in this row or
    another; repeated rows count as occurrences of each other, and of equal passages (ties) all go. A null or empty text
    has no words; texts of fewer words than a window lose none; a text is cut whole, however long. An empty table gives
    an empty one. Null and repeated ids, of any type, are allowed, as texts are matched by their contents. Other columns
    are ignored, whatever their names.
    """
    if not anchor < window <= anchor + 62:
        raise ValueError("anchor < window <= anchor + 62")
    spans = find_spans(docs, window, anchor, most)
    rows = docs.select("doc_id", "text", *text_key(F.col("text"))).join(spans, ["_k1", "_k2"], "left").select("doc_id", "text", "spans")
    return rows.mapInArrow(lambda it: cut_batches(it, window), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_words long, n_removed long, kept_text string")


def factors(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """doc_id, first word and number of words of each duplicate span: the long factors, joined where they overlap."""
    spans = find_spans(docs, window, anchor)
    rows = docs.select("doc_id", *text_key(F.col("text"))).join(spans, ["_k1", "_k2"]).select("doc_id", F.explode("spans").alias("s")).select("doc_id", "s.*")
    starts = F.expr(
        f"case when mask is null then array(named_struct('a', at, 'n', windows + {window - 1}))"
        f" else transform(filter(sequence(0, windows - 1), i -> getbit(mask, i) = 1), i -> named_struct('a', at + i, 'n', {window})) end"
    )
    pieces = rows.select("doc_id", F.explode(starts).alias("p")).groupBy("doc_id").agg(F.array_sort(F.collect_set("p")).alias("p"))
    empty = F.expr("cast(array() as array<struct<a:int,n:int>>)")
    merged = F.aggregate(
        "p",
        empty,
        lambda acc, x: F.when(
            (F.size(acc) > 0) & (F.element_at(acc, -1)["a"] + F.element_at(acc, -1)["n"] >= x["a"]),
            F.concat(
                F.slice(acc, F.lit(1), F.size(acc) - 1),
                F.array(F.struct(F.element_at(acc, -1)["a"].alias("a"), (F.greatest(F.element_at(acc, -1)["a"] + F.element_at(acc, -1)["n"], x["a"] + x["n"]) - F.element_at(acc, -1)["a"]).alias("n"))),
            ),
        ).otherwise(F.concat(acc, F.array(F.struct(x["a"].alias("a"), x["n"].cast("int").alias("n"))))),
    )
    return pieces.select("doc_id", F.explode(merged).alias("f")).select("doc_id", F.col("f.a").alias("first_word"), F.col("f.n").alias("n_words"))
