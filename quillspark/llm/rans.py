"""Token ids in files, coded by a static range asymmetric numeral system.

All segments share one frequency table, counted over the whole corpus. A segment holds the ids of consecutive
documents; its ids are cut into blocks of equal length, a block deals its ids to interleaved lanes, and each lane is a
coder of its own. The final states are the checkpoints from which any block can be decoded alone; each block has a
checksum. numpy runs all lanes of all blocks of a segment in step.

Files: under a path, Parquet in ``table`` (one row: the ids' frequencies, uint32) and in ``segments`` (part, segment, start,
doc_ids, sizes, payload; ids and lengths of documents are columns beside the payload). Nothing else is needed to decode.

Payload of a segment (little-endian): header ``_HEAD`` (magic, version, precision, lanes, ids, ids a block, blocks,
checksum of the table); states uint64[blocks, lanes]; words uint32[blocks, lanes], the number of each lane's words;
checksums uint32[blocks], crc32 of the block's ids as uint32; then all lanes' words uint32 in decoding order.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..storage import discard, materialize, new_path
from .common import IS_SPACE, SLICE_BYTES, slices, text_bytes

PRECISION, LANES, BLOCK, SEGMENT = 20, 32, 8192, 1 << 20
_LOW = np.uint64(1 << 31)
_HEAD = struct.Struct("<4sBBHQIII")
END_ID = 0


class Table:
    """Frequencies of all ids, summing to 2**PRECISION, none zero: so any id can be coded."""

    def __init__(self, freq: np.ndarray):
        self.freq = freq.astype(np.uint64)
        self.below = np.cumsum(self.freq) - self.freq
        self.symbol = np.repeat(np.arange(len(freq), dtype=np.int32), freq.astype(np.int64))
        self.both = self.freq << np.uint64(32) | self.below
        self.crc = zlib.crc32(self.freq.astype("<u4").tobytes())

    @classmethod
    def of(cls, counts: list[int]) -> Table:
        whole, n = sum(counts), len(counts)
        rest = (1 << PRECISION) - n
        if rest < 0:
            raise ValueError(f"{n} ids don't fit a precision of {PRECISION} bits")
        freq = [1 + (c * rest // whole if whole else 0) for c in counts]
        freq[max(range(n), key=counts.__getitem__)] += (1 << PRECISION) - sum(freq)
        return cls(np.array(freq, dtype=np.uint64))


def encode(ids: np.ndarray, table: Table) -> bytes:
    n = len(ids)
    blocks = max(1, -(-n // BLOCK))
    raw = np.zeros(blocks * BLOCK, dtype=np.uint32)
    raw[:n] = ids
    crcs = [zlib.crc32(raw[i * BLOCK : min(n, (i + 1) * BLOCK)].astype("<u4").tobytes()) for i in range(blocks)]
    steps = np.ascontiguousarray(raw.reshape(blocks, BLOCK // LANES, LANES).transpose(1, 0, 2), dtype=np.intp).reshape(BLOCK // LANES, -1)
    x = np.full(steps.shape[1], _LOW, dtype=np.uint64)
    words = np.zeros(steps.shape, dtype=np.uint32)
    used = np.zeros(steps.shape, dtype=bool)
    top, shift, half, low = np.uint64(63 - PRECISION), np.uint64(PRECISION), np.uint64(32), np.uint64(0xFFFFFFFF)
    both, f, q, limit = (np.empty_like(x) for _ in range(4))
    for t in range(len(steps) - 1, -1, -1):
        np.take(table.both, steps[t], out=both, mode="clip")  # an unchecked index is faster; ids are below the table's size
        np.right_shift(both, half, out=f)
        both &= low
        np.left_shift(f, top, out=limit)
        np.greater_equal(x, limit, out=used[t])
        words[t] = x  # the low half
        np.multiply(used[t], half, out=limit)  # shifts by 32 or 0 take a quarter of the time of masked ones
        x >>= limit
        np.floor_divide(x, f, out=q)
        f *= q
        x -= f
        x += both
        q <<= shift
        x += q
    body = np.ascontiguousarray(words.T)[np.ascontiguousarray(used.T)]
    head = _HEAD.pack(b"QRAN", 1, PRECISION, LANES, n, BLOCK, blocks, table.crc)
    return b"".join([head, x.astype("<u8").tobytes(), used.sum(axis=0).astype("<u4").tobytes(), np.array(crcs, dtype="<u4").tobytes(), body.astype("<u4").tobytes()])


def decode(payload: bytes, table: Table, blocks: range | None = None) -> np.ndarray:
    """The ids of all blocks, or of some consecutive ones; raises ValueError where a checksum differs."""
    magic, version, precision, lanes, n, size, total, crc = _HEAD.unpack_from(payload)
    if (magic, version, precision, crc) != (b"QRAN", 1, PRECISION, table.crc):
        raise ValueError("not a segment of this table")
    chosen = range(total) if blocks is None else blocks
    at = _HEAD.size
    states = np.frombuffer(payload, "<u8", total * lanes, at)
    lengths = np.frombuffer(payload, "<u4", total * lanes, at + 8 * total * lanes).astype(np.int64)
    crcs = np.frombuffer(payload, "<u4", total, at + 12 * total * lanes)
    words = np.frombuffer(payload, "<u4", -1, at + 12 * total * lanes + 4 * total)
    part = slice(chosen.start * lanes, chosen.stop * lanes)
    x = states[part].astype(np.uint64)
    place = (np.cumsum(lengths) - lengths)[part]
    words = np.append(words, np.uint32(0)).astype(np.uint64)
    out = np.empty((size // lanes, len(x)), dtype=np.int32)
    mask, shift, half, low = np.uint64((1 << PRECISION) - 1), np.uint64(PRECISION), np.uint64(32), np.uint64(0xFFFFFFFF)
    slot, both, f, more = (np.empty_like(x) for _ in range(4))
    empty = np.empty(len(x), dtype=bool)
    for s in out:
        np.bitwise_and(x, mask, out=slot)
        np.take(table.symbol, slot.view(np.int64), out=s, mode="clip")
        np.take(table.both, s, out=both, mode="clip")
        np.right_shift(both, half, out=f)
        both &= low
        x >>= shift
        x *= f
        x += slot
        x -= both
        np.less(x, _LOW, out=empty)
        np.take(words, place, out=more, mode="clip")
        more *= empty
        np.multiply(empty, half, out=slot)  # shifts by 32 or 0 take a quarter of the time of masked ones
        x <<= slot
        x |= more
        place += empty
    out = out.view(np.uint32)
    ids = out.reshape(size // lanes, len(chosen), lanes).transpose(1, 0, 2).reshape(len(chosen), size)
    found = []
    for row, i in zip(ids, chosen):
        row = row[: max(0, min(size, n - i * size))]
        if zlib.crc32(row.astype("<u4").tobytes()) != crcs[i]:
            raise ValueError(f"block {i}: checksum differs")
        found.append(row)
    return np.concatenate(found) if found else np.zeros(0, dtype=np.uint32)


class CachedTokenizer:
    """encode() of the tokenizers library over whole texts, with the ids of pieces seen before taken from a cache.

    The byte-level pre-tokenizer always parts a text before a single space or line break between other characters, so
    such pieces are encoded apart; texts with other white space, or with an added token, go to the library whole.
    """

    #: Pieces in each of the cache's two generations, at most: about 400 MB for both. When the younger is full it replaces
    #: the older, from which pieces come back as they are met again; results don't depend on it.
    MOST = 1_000_000
    #: New pieces that are joined to one text for the library.
    JOINED = 2_000

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.size = self.tokenizer.get_vocab_size()
        self.code = "H" if self.size <= 1 << 16 else "I"
        self.cache: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.width = np.zeros(self.size, dtype=np.int64)  # bytes that an id stands for: its token has a character for each
        for token, i in self.tokenizer.get_vocab(with_added_tokens=False).items():
            self.width[i] = len(token)
        self.parts = self._parts()

    def _parts(self) -> bool:
        pre = self.tokenizer.pre_tokenizer
        own = type(pre).__name__ == "ByteLevel" and pre.use_regex and not pre.add_prefix_space and self.tokenizer.normalizer is None
        return own and len(self.plain(["\n"])[0]) == struct.calcsize(self.code)

    def plain(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [struct.pack(f"<{len(e.ids)}{self.code}", *e.ids) for e in found]

    def learn(self, pieces: list[str]) -> None:
        """Take the ids of new pieces into the cache. They are encoded joined, which parts them where they meet."""
        item = struct.calcsize(self.code)
        lines = [p for p in pieces if p[0] == "\n"]
        inner = [p for p in pieces if p[0] != "\n"]
        groups = [(g := lines[i : i + self.JOINED], "".join(g)) for i in range(0, len(lines), self.JOINED)]
        groups += [(g := inner[i : i + self.JOINED], " " + " ".join(g)) for i in range(0, len(inner), self.JOINED)]
        for (group, text), ids in zip(groups, self.plain([t for _, t in groups])):
            ends = np.cumsum(self.width[np.frombuffer(ids, dtype=f"<u{item}")])
            raw = np.frombuffer(text.encode(), dtype=np.uint8)
            # a piece begins with its only space or line break
            stops = np.append(np.flatnonzero((raw == 32) | (raw == 10))[1:], len(raw))
            last = np.searchsorted(ends, stops) + 1
            if len(last) != len(group) or not np.array_equal(ends[last - 1], stops):
                raise ValueError("pieces don't part where they meet")
            parts = (last * item).tolist()
            self.cache.update(zip(group, map(ids.__getitem__, map(slice, [0, *parts[:-1]], parts))))

    def encode(self, texts: list[str], odd: np.ndarray) -> list[bytes]:
        """Ids of each text, packed; ``odd`` marks the texts that must not be parted."""
        pieces: list[list[str] | None] = [
            None if o or not t or not self.parts or any(a in t for a in self.added) else ("\n" + t.replace("\n", " \n")).split(" ") for t, o in zip(texts, odd)
        ]
        new = set().union(*(p for p in pieces if p)) - self.cache.keys()
        if len(self.cache) + len(new) > self.MOST:
            self.older, self.cache = self.cache, {}
            new = set().union(*(p for p in pieces if p))
        known = new & self.older.keys()
        self.cache.update({p: self.older[p] for p in known})
        self.learn(list(new - known))
        get, skip = self.cache.__getitem__, struct.calcsize(self.code)
        whole = iter(self.plain([t for t, p in zip(texts, pieces) if p is None]))
        return [next(whole) if p is None else b"".join(map(get, p))[skip:] for p in pieces]


_tokenizers: dict[str, CachedTokenizer] = {}
# 1: white space; 2: may begin white space, or end it, beyond ASCII
_ODD = IS_SPACE.astype(np.uint8)
_ODD[0x1C:0x20] = 1
_ODD[[0xC2, 0xE1, 0xE2, 0xE3]] = 2


def odd_spacing(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Texts with two white-space characters in a row, one at an end, or one beyond ASCII."""
    out = np.zeros(len(bounds) - 1, dtype=bool)
    if not len(data):
        return out
    kind = _ODD[data]
    hit = kind >> 1
    hit[:-1] |= kind[:-1] & kind[1:] & 1
    some = np.flatnonzero(bounds[1:] > bounds[:-1])
    first, last = bounds[:-1][some], bounds[1:][some] - 1
    out[some] = (np.maximum.reduceat(hit, first) > 0) | (kind[first] == 1) | (kind[last] == 1)
    return out


def _segments(batches: Iterator[pa.RecordBatch], path: str, id_type: pa.DataType) -> Iterator[pa.RecordBatch]:
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    tokenizer = _tokenizers.setdefault(path, None) or CachedTokenizer(path)
    _tokenizers[path] = tokenizer
    part, number, before = TaskContext.get().partitionId(), 0, 0
    end = struct.pack(f"<{tokenizer.code}", END_ID)
    kind = np.dtype("<u2" if tokenizer.code == "H" else "<u4")
    ids: list[bytes] = []
    docs: list = []
    held = 0

    def segment():
        sizes = [len(x) // kind.itemsize for x in ids]
        joined = b"".join(ids)
        counts = np.bincount(np.frombuffer(joined, kind), minlength=tokenizer.size).astype("<u4")
        columns = [pa.array([part], pa.int32()), pa.array([number], pa.int32()), pa.array([docs], pa.list_(id_type)), pa.array([sizes], pa.list_(pa.int64())), pa.array([before], pa.int64()), pa.array([joined], pa.binary()), pa.array([counts.tobytes()], pa.binary())]
        return pa.RecordBatch.from_arrays(columns, names=["part", "segment", "doc_ids", "sizes", "before", "ids", "counts"])

    for batch in slices(batches, limit=3 * SLICE_BYTES):
        texts = batch.column("text")
        coded = tokenizer.encode([t or "" for t in texts.to_pylist()], odd_spacing(*text_bytes(texts)))
        for doc, c in zip(batch.column("doc_id").to_pylist(), coded):
            ids.append(c + end)
            docs.append(doc)
            held += len(c) // kind.itemsize + 1
            if held >= SEGMENT:
                yield segment()
                before += held
                ids, docs, held, number = [], [], 0, number + 1
    if ids:
        yield segment()


def _by_range(docs: DataFrame, parts: int) -> DataFrame:
    """Rows in partitions that ascend by doc_id. For whole numbers the borders come from quantiles of the ids alone, as a
    range partitioning would sample whole rows and so read all texts twice. Ids of other types are partitioned by range."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    if kind not in ("bigint", "int", "smallint", "tinyint"):
        return docs.repartitionByRange(parts, F.col("doc_id").asc_nulls_first())
    whole = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)))
    borders = sorted(int(b) for b in docs.select(whole.alias("i")).approxQuantile("i", [i / parts for i in range(1, parts)], 0.2 / parts) or [])
    distinct = sorted(set(borders))
    # an id that is several borders has as many parts, which its rows are spread over
    last = {b: borders.index(b) + borders.count(b) for b in distinct}
    hot = {b: borders.count(b) for b in distinct if borders.count(b) > 1}
    above = F.size(F.filter(F.array(*[F.lit(b) for b in distinct]).cast("array<bigint>"), lambda b: b <= whole))
    part = F.element_at(F.array(F.lit(0), *[F.lit(last[b]) for b in distinct]), above + 1)
    for b, n in hot.items():
        part = F.when(whole == b, F.lit(last[b] - n + 1) + F.pmod(F.xxhash64("text"), F.lit(n)).cast("int")).otherwise(part)
    return docs.repartitionById(parts, part)


def write_ids(docs: DataFrame, tokenizer_path: str, path: str) -> None:
    """Encode all texts (null: empty), append END_ID to each, and write the segments under ``path`` in ascending doc_id order.

    Null ids come first; rows of equal ids stay next to each other, in no further order; an empty table gives no segment.
    A document is never parted between segments, however long. Other columns are ignored, whatever their names.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    id_type = docs.schema["doc_id"].dataType.simpleString()
    arrow_id = to_arrow_type(docs.schema["doc_id"].dataType)
    ordered = _by_range(docs.select("doc_id", "text"), parts).sortWithinPartitions(F.col("doc_id").asc_nulls_first())
    raw = materialize(
        ordered.mapInArrow(lambda it: _segments(it, tokenizer_path, arrow_id), f"part int, segment int, doc_ids array<{id_type}>, sizes array<bigint>, before bigint, ids binary, counts binary"), "ids"
    )
    from tokenizers import Tokenizer

    size = Tokenizer.from_file(tokenizer_path).get_vocab_size()
    kind = "<u2" if size <= 1 << 16 else "<u4"

    def count(batches):
        total = np.zeros(size, dtype=np.int64)
        for b in batches:
            for x in b.column("counts"):
                total += np.frombuffer(x.as_buffer(), "<u4")
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["id", "c"])

    counts = [0] * size
    for r in raw.select("counts").mapInArrow(count, "id long, c long").groupBy("id").agg(F.sum("c").alias("c")).collect():  # a row for each id of the vocabulary at most
        counts[r["id"]] = r["c"]

    freq = Table.of(counts).freq
    # ids before each part: a row for each partition of the range shuffle, whose number is a setting
    ends = raw.groupBy("part").agg(F.max(F.col("before") + F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x)).alias("n"))
    bases = ends.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("base"))

    def code(batches):
        table = Table(freq)
        for b in batches:
            for i in range(b.num_rows):
                payload = encode(np.frombuffer(b.column("ids")[i].as_buffer(), kind), table)
                row = b.slice(i, 1)
                yield pa.RecordBatch.from_arrays([*(row.column(c) for c in ("part", "segment", "start", "doc_ids", "sizes")), pa.array([payload], pa.binary())], names=["part", "segment", "start", "doc_ids", "sizes", "payload"])

    schema = f"part int, segment int, start bigint, doc_ids array<{id_type}>, sizes array<bigint>, payload binary"
    coded = raw.join(F.broadcast(bases), "part").select("part", "segment", (F.col("base") + F.col("before")).alias("start"), "doc_ids", "sizes", "ids").mapInArrow(code, schema)
    # the number of a part is the number of its file, so that files and rows ascend
    coded.repartitionById(parts, F.col("part")).sortWithinPartitions("segment").write.option("compression", "none").parquet(f"{path}/segments")
    spark.createDataFrame([(bytearray(freq.astype("<u4").tobytes()),)], "freq binary").coalesce(1).write.parquet(f"{path}/table")
    discard(raw)


def read_ids(spark: SparkSession, path: str, ids_column: bool = True) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 and ids (little-endian uint32) of every document in the files under ``path``.

    The checksum is of the ids as they are read; without ``ids_column`` the ids themselves stay with the reader.
    """
    files = spark.read.parquet(f"{path}/segments")
    freq = np.frombuffer(bytes(spark.read.parquet(f"{path}/table").first()["freq"]), "<u4")  # an item for each id of the vocabulary
    id_type = files.schema["doc_ids"].dataType.elementType.simpleString()

    def run(batches):
        table = Table(freq)
        for b in batches:
            for i in range(b.num_rows):
                ids = decode(b.column("payload")[i].as_py(), table).astype("<u4")
                sizes = np.array(b.column("sizes")[i].as_py(), dtype=np.int64)
                ends = np.cumsum(sizes)
                starts = ends - sizes
                raw = [ids[a:e].data for a, e in zip(starts, ends)]
                base = b.column("start")[i].as_py()
                columns = [b.column("doc_ids")[i].values, pa.array(starts + base), pa.array(sizes), pa.array(np.array([zlib.crc32(r) for r in raw], dtype=np.int64))]
                if ids_column:
                    columns.append(pa.array([bytes(r) for r in raw], pa.binary()))
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "n_tokens", "ids_crc32", "ids"][: len(columns)])

    schema = f"doc_id {id_type}, start long, n_tokens long, ids_crc32 long" + ", ids binary" * ids_column
    return files.select("start", "doc_ids", "sizes", "payload").mapInArrow(run, schema)


def round_trip(docs: DataFrame, tokenizer_path: str, ids_column: bool = True) -> DataFrame:
    """Writes the files in the shared folder and reads them back."""
    path = new_path(docs.sparkSession, "rans")
    write_ids(docs, tokenizer_path, path)
    return read_ids(docs.sparkSession, path, ids_column)
