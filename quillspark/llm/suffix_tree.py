"""Language-model scoring by a probabilistic suffix tree over words.

The tree's contexts are runs of tokens before a token. A context holds the next tokens that follow it ``ENTRY_LEAST``
times or more; among pairs of tokens, where chance alone makes many of these, only those whose count's log likelihood
ratio is ``ENTRY_GAIN`` or more. The context stays if the distribution of its next tokens diverges from that of the next
shorter context by ``DIVERGENCE`` a token. Only contexts that stay are lengthened, by tokens that go before them, as such
entries, ``CONTEXT_LEAST`` times. All these are constants, so that the tree grows with the input. A context hands the
weight of all other next tokens to the shorter context, which shares it among these, and as much weight as it has entries,
and one, to the shorter context for all tokens; the root is the smoothed unigram distribution. A token is scored in the
longest context that stays.

Nothing of the tree is gathered: texts lie in blocks, and a block lists its distinct keys (words, contexts with their
next token, contexts), with what it knows of them, in as many parts by hash as there is work for. A part sums over all
blocks and hands back an answer for each key. A key is listed once a block, so common keys don't pile up in a part. Blocks
meet their answers and their state. Levels read the texts again as long as these are smaller than the contexts and tokens of
the places that are left; then the state holds these, each distinct one's hash once a block, and the texts stay behind. A
state is written once a level, and what was asked leaves the disk as soon as it is answered.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..storage import discard, materialize
from .common import SLICE_BYTES, U64, Words, crc_mod, mix64, slices, text_bytes

CONTEXT_LEAST, ENTRY_LEAST, ENTRY_GAIN = 5, 2, 6.0
DIVERGENCE, ALPHA = 0.01, 0.1
#: Probabilities are held in 32 bits, so less than this isn't told from nothing left.
LEAST_REST = 1e-6
#: Text bytes of a block, about; of four blocks the keys fill a part.
BLOCK_BYTES = 4 << 20
#: Of compression, of texts and of others: most of these are hashes, which no level makes smaller.
TEXT_LEVEL, LEVEL = 3, 1
END = np.uint64(0x5BD1E995A1B2C3D5)
_LEFT = U64(0x9FB21C651E98DF25)
_ROW = "block long, part int, ids array<{id}>, held array<boolean>, data array<binary>"


def tokens(w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all texts' tokens, each text followed by END; the text of each token; the bounds of the texts."""
    n = len(w.counts)
    ends = np.cumsum(w.counts + 1)
    out = np.full(len(w) + n, END, dtype=U64)
    own = np.ones(len(out), dtype=bool)
    own[ends - 1] = False
    out[own] = w.hashes
    return out, np.repeat(np.arange(n), w.counts + 1), np.append(0, ends)


def distinct(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct values in order, a place of each, and which of them each value is. (np.unique sorts stably for this, which
    takes three times as long.)"""
    order = np.argsort(values)
    ascending = values[order]
    begin = np.append(True, ascending[1:] != ascending[:-1])[: len(values)]
    which = np.empty(len(values), dtype="<i4")
    which[order] = np.cumsum(begin) - 1
    return ascending[begin], order[begin], which


def pack(*columns: np.ndarray, level: int = LEVEL) -> bytes:
    """Columns of equal length, compressed as one, byte by byte of the items' width."""
    if not len(columns[0]):
        return b""
    raw = b"".join(np.ascontiguousarray(np.ascontiguousarray(c).view(np.uint8).reshape(-1, c.dtype.itemsize).T).tobytes() for c in columns)
    return len(raw).to_bytes(8, "little") + pa.Codec("zstd", level).compress(raw, asbytes=True)


def unpacked(data: bytes, *kinds: str) -> list[np.ndarray]:
    if not data:
        return [np.zeros(0, k) for k in kinds]
    size = int.from_bytes(data[:8], "little")
    raw = np.frombuffer(pa.decompress(data[8:], size, codec="zstd", asbytes=True), np.uint8)
    widths = np.array([np.dtype(k).itemsize for k in kinds])
    n = size // int(widths.sum())
    ends = n * np.cumsum(widths)
    return [np.ascontiguousarray(raw[e - n * w : e].reshape(w, n).T).reshape(-1).view(k) for k, w, e in zip(kinds, widths, ends)]


def unpack(data: bytes, kind) -> np.ndarray:
    return unpacked(data, kind)[0]


def gaps(places: np.ndarray) -> np.ndarray:
    return np.diff(places, prepend=0).astype("<i4")


def _groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[tuple[int, list[dict]]]:
    """Rows of each key, of batches sorted by it."""
    rows: list[dict] = []
    for b in batches:
        for i in range(b.num_rows):
            row = {n: b.column(n)[i] for n in b.schema.names}
            row = row | {"block": row["block"].as_py(), "part": row["part"].as_py(), "data": row["data"].as_py()}
            if rows and rows[0][key] != row[key]:
                yield rows[0][key], rows
                rows = []
            rows.append(row)
    if rows:
        yield rows[0][key], rows


def _batch(rows: list[tuple], id_type: pa.DataType) -> pa.RecordBatch:
    block, part, ids, held, data = zip(*rows)
    wrap = lambda xs, kind: pa.concat_arrays([pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) if x is not None else pa.nulls(1, pa.list_(kind)) for x in xs])
    return pa.RecordBatch.from_arrays([pa.array(block, pa.int64()), pa.array(part, pa.int32()), wrap(ids, id_type), wrap(held, pa.bool_()), pa.array(data, pa.list_(pa.binary()))], names=["block", "part", "ids", "held", "data"])


def _asks(block: int, keys: np.ndarray, columns: list[np.ndarray], parts: int, first: int = 0, some: list[np.ndarray] | None = None) -> list[tuple]:
    """Rows that hand a block's sorted keys, with what it knows of them, to parts ``first`` and following. ``some`` are columns
    handed only where the last of ``columns`` isn't 0."""
    cuts = np.searchsorted(keys, np.arange(1, parts, dtype=U64) * U64((1 << 64) // parts))
    out = []
    for i, (lo, hi) in enumerate(zip([0, *cuts], [*cuts, len(keys)])):
        if hi > lo:
            data = [pack(np.diff(keys[lo:hi], prepend=U64(0)), *(c[lo:hi] for c in columns))]
            if some is not None:
                there = lo + np.flatnonzero(columns[-1][lo:hi])
                data.append(pack(*(c[there] for c in some)))
            out.append((block, first + i, None, None, data))
    return out


def _merged(rows: list[dict], *kinds: str) -> tuple[np.ndarray, ...]:
    """Of the keys of all rows of a part: their order, where equal ones begin, which group each is of; the rows' sizes; then the
    columns beside the keys, row after row."""
    held = [unpacked(r["data"][0], U64, *kinds) for r in rows]
    keys, *columns = (np.concatenate(c) for c in zip(*([np.cumsum(h[0]), *h[1:]] for h in held)))
    order = np.argsort(keys)
    keys = keys[order]
    begin = np.append(True, keys[1:] != keys[:-1])
    return order, np.flatnonzero(begin), np.cumsum(begin) - 1, np.cumsum([len(h[0]) for h in held])[:-1], *columns


def _count_batches(batches: Iterator[pa.RecordBatch], words: int, id_type: pa.DataType) -> Iterator[pa.RecordBatch]:
    """Answers 2 * count, plus 1 in one of the blocks that counted the key; for parts below ``words`` also tokens and kinds (block -1)."""
    for part, rows in _groups(batches, "part"):
        order, first, group, cuts, n = _merged(rows, "<i4")
        n = n[order].astype(np.int64)
        total = np.add.reduceat(n, first)
        answer = 2 * total[group]
        counted = np.flatnonzero(n)
        of = group[counted]
        answer[counted[np.append(True, of[1:] != of[:-1])[: len(of)]]] += 1
        back = np.empty_like(answer)
        back[order] = answer
        out = [(r["block"], part, None, None, [pack(a)]) for r, a in zip(rows, np.split(back, cuts))]
        if part < words:
            out.append((-1, part, None, None, [pack(np.array([total.sum(), (total > 0).sum()]))]))
        yield _batch(out, id_type)


def _context_batches(batches: Iterator[pa.RecordBatch], id_type: pa.DataType) -> Iterator[pa.RecordBatch]:
    """Answers the number of a context's entries if it stays, -1 of others; and of those that stay, by how much what is added
    for the shorter context is greater for a token that is no entry. Also how often those that stay occur (block -1)."""
    for part, rows in _groups(batches, "part"):
        order, first, group, cuts, occurs, kinds = _merged(rows, "<i4", "<i4")
        occurs = occurs[order][first].astype(float)
        sums = np.zeros((3, len(kinds)))
        sums[:, kinds > 0] = np.concatenate([np.stack([x.astype(float) for x in unpacked(r["data"][1], "<i4", "<f8", "<f8")]) for r in rows], axis=1)
        weight, inside, shorter = np.add.reduceat(sums[:, order], first, axis=1)
        kinds = np.add.reduceat(kinds[order], first)
        # divergence of the entries, and of all else as one, from the shorter context's distribution
        left, left0 = np.maximum(1 - weight / occurs, 1e-12), np.maximum(1 - shorter, LEAST_REST)
        stay = (inside - weight * np.log(occurs)) / occurs + left * np.log(left / left0) >= DIVERGENCE
        back, other = np.empty(len(order), "<i4"), np.empty(len(order), "<f4")
        back[order] = np.where(stay, kinds, -1)[group]
        other[order] = ((occurs - weight) / left0)[group]
        out = [(r["block"], part, None, None, [pack(a), pack(o[a >= 0])]) for r, a, o in zip(rows, np.split(back, cuts), np.split(other, cuts))]
        yield _batch([*out, (-1, part, None, None, [pack(np.array([int(occurs[stay].sum()), 0]))])], id_type)


#: Part numbers of a block's own rows: its texts, its state, the counts of its entries from the second level on.
TEXTS, STATE, COUNTS = -3, -2, -1
#: What a block's state holds after known, base and score by text: for the first level the counts of the distinct tokens and of
#: entries by place; for later ones the places, their tokens' probabilities in the shorter context (32 bits), whether a token
#: follows that one ``ENTRY_LEAST`` times (else it can't be an entry of the longer one, and isn't asked for), the counts of the
#: distinct contexts, and if texts stay behind these contexts, that of each place, the distinct tokens, that of each place.
#: Counts of entries: 0 of what follows less than ``ENTRY_LEAST`` times, -1 of what follows so often by chance.
FIRST, LATER = ("<i4", "<i4"), ("<i4", "<f4", "?", "<i4", U64, "<i4", U64, "<i4")
#: Texts stay behind when contexts that stay have less than this share of all tokens. About half of these places are left then,
#: which take about twice as many bytes as tokens of the texts.
TEXTS_SHARE = 0.6


class Block:
    """What a block's rows tell: of texts their tokens' hashes, of the state its numbers, of others the answers."""

    def __init__(self, rows: list[dict]):
        by = {r["part"]: r for r in rows if r["part"] < 0}
        self.row = by.get(TEXTS) or by[STATE]
        self.number = self.row["block"]
        self.answered = [r for r in rows if r["part"] >= 0]
        self.data = by[STATE]["data"] if STATE in by else []
        self.counts = unpack(by[COUNTS]["data"][0], "<i4") if COUNTS in by else None
        self.hashes = None
        if TEXTS in by:
            data = by[TEXTS]["data"]
            bounds = unpack(data[1], "<i8")
            texts = pa.LargeStringArray.from_buffers(len(bounds) - 1, pa.py_buffer(bounds), pa.py_buffer(unpack(data[0], np.uint8)))
            self.hashes, self.of, self.bounds = tokens(Words(texts, lower=True))
        else:
            self.bounds = unpack(self.data[0], "<i8")
        self.texts = len(self.bounds) - 1

    def answers(self, kind: str, low: int = 0, high: int = 1 << 31, item: int = 0) -> np.ndarray:
        return np.concatenate([np.zeros(0, kind), *(unpack(r["data"][item], kind) for r in self.answered if low <= r["part"] < high)])

    def numbers(self, *kinds: str) -> list[np.ndarray]:
        """Arrays of the state after the bounds."""
        return [unpack(x, k) for x, k in zip(self.data[1:], ("<i8", "<f8", "<f8", *kinds))]

    def first_level(self, counts: np.ndarray, n: int, v: int) -> tuple[np.ndarray, ...]:
        """From the counts of the distinct tokens each token's, its probability; then, of places whose context may stay, as
        ``later_level``."""
        words, _, token = distinct(self.hashes)
        before = np.append(token[-1:], token[:-1])  # a block's last token is an end, as the one before a text
        chance = (counts + ALPHA) / (n + ALPHA * (v + 1))
        at = np.flatnonzero(counts[before] >= CONTEXT_LEAST)
        before = before[at]
        there = np.zeros(len(words), dtype=bool)
        there[before] = True
        return counts[token], chance[token], at, chance.astype("<f4")[token[at]], np.ones(len(at), dtype=bool), counts[there], words[there], (np.cumsum(there) - 1)[before], self.hashes[at]

    def later_level(self, d: int) -> tuple[np.ndarray, ...]:
        """Of places with a context of d tokens that may stay: the places, their tokens' probabilities, whether these may be
        entries, the counts of the distinct contexts, these, that of each place, the tokens' hashes."""
        at, q, able, occurs, *coded = self.numbers(*LATER)[3:]
        at = np.cumsum(at)
        if coded:
            contexts, of, words, token = coded
            return at, q, able, occurs, contexts, of, words[token]
        context = np.append(END, self.hashes[:-1])
        for _ in range(d - 1):
            context = np.append(END, mix64(context * _LEFT + self.hashes)[:-1])
        contexts, _, of = distinct(context[at])
        return at, q, able, occurs, contexts, of, self.hashes[at]

    def text(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.bounds, at, side="right") - 1

    def listed(self, keys: np.ndarray, texts: np.ndarray, parts: int, first: int = 0) -> list[tuple]:
        """The distinct keys of places in texts, with how many of each are learned from."""
        own = ~self.row["held"].values.to_numpy(zero_copy_only=False)[texts]
        u, _, which = distinct(keys)
        return _asks(self.number, u, [np.bincount(which[own], minlength=len(u)).astype("<i4")], parts, first)

    def state(self, *data: np.ndarray) -> tuple:
        return (self.number, STATE, self.row["ids"].values, self.row["held"].values, [*map(pack, (self.bounds, *data))])


def _block_batches(batches: Iterator[pa.RecordBatch], block_bytes: int, id_type: pa.DataType) -> Iterator[pa.RecordBatch]:
    part, number, size = TaskContext.get().partitionId(), 0, 0
    held: list[pa.RecordBatch] = []

    def block():
        ids, texts, out = (pa.concat_arrays([b.column(c) for b in held]) for c in ("doc_id", "text", "held"))
        return _batch([((part << 32) | number, TEXTS, ids, out, [pack(x, level=TEXT_LEVEL) for x in text_bytes(texts)])], id_type)

    for b in slices(batches, limit=min(block_bytes, SLICE_BYTES)):
        held.append(b)
        size += b.column("text").nbytes
        if size >= block_bytes:
            yield block()
            held, size, number = [], 0, number + 1
    if held:
        yield block()


def _first_batches(batches: Iterator[pa.RecordBatch], parts: int, id_type: pa.DataType) -> Iterator[pa.RecordBatch]:
    for _, rows in _groups(batches, "block"):
        b = Block(rows)
        context = np.append(END, b.hashes[:-1])  # that of a text's first token is the end before it
        yield _batch(b.listed(b.hashes, b.of, parts) + b.listed(mix64(context * _LEFT + b.hashes), b.of, parts, parts), id_type)


def significant(n: np.ndarray, occurs: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Where n next tokens out of ``occurs`` are many more than a probability of q tells."""
    want = occurs * q.astype(float)
    return (n >= ENTRY_LEAST) & (n > want) & (n * np.log(np.maximum(n, 1) / want) - n + want >= ENTRY_GAIN)


def _counted_batches(batches: Iterator[pa.RecordBatch], d: int, n: int, v: int, parts: int, id_type: pa.DataType) -> Iterator[pa.RecordBatch]:
    """Each block's counts of entries, with the first level's state, and its contexts with the sums of the entries it answers for."""
    for _, rows in _groups(batches, "block"):
        b = Block(rows)
        if d == 1:
            counts = (b.answers("<i8", 0, parts) >> 1).astype("<i4")
            count, chance, at, q, _, occurs, contexts, of, _ = b.first_level(counts, n, v)
            asked, where = at, slice(None)
            entry = mix64(np.append(END, b.hashes[:-1]) * _LEFT + b.hashes)
        else:
            _, q, able, occurs, contexts, of, token = b.later_level(d)
            asked, where = slice(None), np.flatnonzero(able)
            entry = mix64(contexts[of[where]] * _LEFT + token[where])
        place, inverse = distinct(entry)[1:]
        answer = b.answers("<i8", parts, 2 * parts)
        owned = np.zeros(len(entry), dtype=bool)
        owned[place[(answer & 1) > 0]] = True
        found = (answer >> 1)[inverse[asked]].astype("<i4")
        found[found < ENTRY_LEAST] = 0
        if d == 1:
            found[(found > 0) & ~significant(found, occurs[of], q)] = -1
        c = np.zeros(len(of), dtype="<i4")
        c[where] = found
        own = np.arange(len(of))[where][owned[asked] & (found > 0)]
        to, k, f = of[own], c[own].astype(float), q[own].astype(float)
        weight, kinds, inside, shorter = (np.bincount(to, x, len(contexts)) for x in (k, np.ones(len(own)), k * (np.log(k) - np.log(f)), f))
        asks = _asks(b.number, contexts, [occurs, kinds.astype("<i4")], parts, 0, [weight.astype("<i4"), inside, shorter])
        if d == 1:
            base = np.bincount(b.of, np.log10(chance), b.texts)
            yield _batch([b.state(np.bincount(b.of, count > 0, b.texts).astype("<i8"), base, base, counts, c), *asks], id_type)
        else:
            yield _batch([(b.number, COUNTS, None, None, [pack(c)]), *asks], id_type)


def _scored_batches(batches: Iterator[pa.RecordBatch], d: int, n: int, v: int, parts: int, coded: bool, id_type: pa.DataType) -> Iterator[pa.RecordBatch]:
    """With the contexts that stay: each block's state, and the longer contexts with their next tokens. ``coded``: the next level
    is without the texts."""
    for _, rows in _groups(batches, "block"):
        b = Block(rows)
        if d == 1:
            known, base, score, counts, c = b.numbers(*FIRST)
            at, q, _, occurs, contexts, of, token = b.first_level(counts, n, v)[2:]
        else:
            known, base, score = b.numbers()
            (at, q, _, occurs, contexts, of, token), c = b.later_level(d), b.counts
        able, c = c != 0, np.maximum(c, 0)
        kinds = b.answers("<i4")
        other = np.zeros(len(kinds))
        other[kinds >= 0] = b.answers("<f4", item=1)
        stay, total, shared, other = (x[of] for x in (kinds >= 0, occurs + kinds + 1.0, kinds + 1.0, other))
        q = q.astype(float)
        p = np.where(stay, (c + (shared + np.where(c > 0, 0, other)) * q) / np.where(stay, total, 1.0), q).astype("<f4")
        score = score + np.bincount(b.text(at), np.log10(p.astype(float)) - np.log10(q), b.texts)
        # a place whose context stays, after a place whose token is an entry
        longer = np.flatnonzero((at[1:] == at[:-1] + 1) & stay[1:] & (c[:-1] >= CONTEXT_LEAST) & (token[:-1] != END))
        contexts, first, of = distinct(mix64(contexts[of[longer]] * _LEFT + token[longer]))
        at, token, occurs, q, able = at[longer + 1], token[longer + 1], c[longer][first], p[longer + 1], able[longer + 1]
        state = [known, base, score, gaps(at), q, able, occurs]
        if coded:
            words, _, which = distinct(token)
            state += [contexts, of, words, which]
        yield _batch([b.state(*state), *b.listed(mix64(contexts[of[able]] * _LEFT + token[able]), b.text(at[able]), parts, parts)], id_type)


def _result_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for _, rows in _groups(batches, "block"):
        b = Block(rows)
        known, base, score = b.numbers()
        yield pa.RecordBatch.from_arrays([b.row["ids"].values, b.row["held"].values, *map(pa.array, (np.diff(b.bounds), known, base, score))], names=["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"])


def score(docs: DataFrame, held_out: tuple[int, int] = (10, 0), depth: int | None = None, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row.

    Rows whose id's crc32 modulo held_out[0] is held_out[1] are scored only; the tree learns from all others, repeated
    rows and null ids among them, each as often as it is there. Tokens are words with A-Z lower-cased, then one end; a
    null or empty text has the end only; a text is scored whole, however long. An empty table gives an empty one. Scores
    are sums of log10 probabilities; equal texts have equal ones. Contexts have ``depth`` tokens at most; None: as many as
    pass the test. Ids may be of any type. Other columns are ignored, whatever their names.
    """
    spark = docs.sparkSession
    id_type = docs.schema["doc_id"].dataType.simpleString()
    arrow_id = to_arrow_type(docs.schema["doc_id"].dataType)
    schema = _ROW.format(id=id_type)
    out = crc_mod(F.col("doc_id"), held_out[0]) == held_out[1]

    def met(own: list[DataFrame], asked: DataFrame, combine, then, used: list[DataFrame]) -> tuple[DataFrame, list[int]]:
        """What follows from the blocks' own rows and the answers to what was asked; and the sums of these. What was asked,
        in the tables ``used``, leaves the disk when it is answered."""
        answers = materialize(asked.repartition("part").sortWithinPartitions("part").mapInArrow(combine, schema), "answers", level=1)
        for table in used:
            discard(table, "asked=1")
        totals = [unpack(r["data"][0], "<i8") for r in answers.where("block < 0").select("data").collect()]  # a row a part
        sums = [int(x) for x in np.sum([[0, 0], *totals], axis=0)]
        both = answers.where("block >= 0")
        for table in own:
            both = both.unionByName(table)
        rows = both.repartition("block").sortWithinPartitions("block", "part").mapInArrow(then(*sums), schema)
        made = materialize(rows.withColumn("asked", (F.col("part") >= 0).cast("int")), "state", partition_by=["asked"], level=1)
        discard(answers)
        return made, sums

    held = docs.select("doc_id", "text", out.alias("held"))
    blocks = materialize(held.mapInArrow(lambda it: _block_batches(it, block_bytes, arrow_id), schema), "blocks", level=1)
    parts = max(8, blocks.count() // 4)
    split = lambda table: tuple(table.where(F.col("asked") == i).drop("asked") for i in (0, 1))
    counted = lambda d, n, v: lambda it: _counted_batches(it, d, n, v, parts, arrow_id)
    scored = lambda d, n, v, coded: lambda it: _scored_batches(it, d, n, v, parts, coded, arrow_id)
    texts, own, used, d, n, v = [blocks], [], [], 1, 0, 0
    asked = blocks.mapInArrow(lambda it: _first_batches(it, parts, arrow_id), schema)
    while True:
        if d == 1:
            counts, (n, v) = met(texts, asked, lambda it: _count_batches(it, parts, arrow_id), lambda n, v: counted(1, n, v), [])
        else:
            counts, _ = met([*texts, *own], asked, lambda it: _count_batches(it, 0, arrow_id), lambda *_: counted(d, n, v), used)
        kept, asked = split(counts)
        few = lambda left: not texts or left <= TEXTS_SHARE * n
        made, (left, _) = met([*texts, *own, kept], asked, lambda it: _context_batches(it, arrow_id), lambda left, _: scored(d, n, v, few(left)), [counts])
        for table in (*used, counts, *(texts if few(left) else [])):
            discard(table)
        texts = [] if few(left) else texts
        state, asked = split(made)
        own, used, d = [state], [made], d + 1
        if (depth is not None and d > depth) or asked.isEmpty():
            break
    result = state.mapInArrow(_result_batches, f"doc_id {id_type}, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return result.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score")
