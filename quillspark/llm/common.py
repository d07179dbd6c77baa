"""Vectorized text primitives shared by the operators: words, 64-bit word and n-gram hashes, Arrow slices."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

U64 = np.uint64
#: Text bytes that one vectorized step holds; a single longer text forms a step of its own.
SLICE_BYTES = 2 << 20

_LEFT, _RIGHT = U64(0x9E3779B97F4A7C15), U64(0xC2B2AE3D27D4EB4F)
#: The low 0 to 8 bytes of a little-endian number.
_LOW_BYTES = np.array([(1 << (8 * i)) - 1 for i in range(9)], dtype=U64)
#: Words of more bytes are hashed one at a time.
_LONG_WORD = 256

IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finalizer on uint64 (splitmix64)."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of data[start:end] for each span of bytes: eight bytes a step, each step mixed, so that no two short words and no
    pattern of longer ones collide by structure."""
    size = ends - starts
    h = size.astype(U64) * _LEFT
    if not len(size):
        return h
    padded = np.zeros(len(data) + 8, dtype=np.uint8)
    padded[: len(data)] = data
    eight = np.ndarray((len(data) + 1,), dtype="<u8", buffer=padded, strides=(1,))
    h = mix64(h ^ (eight[starts] & _LOW_BYTES[np.minimum(size, 8)]))
    at = np.flatnonzero((size > 8) & (size <= _LONG_WORD))
    step = 8
    while len(at):
        h[at] = mix64(h[at] * _LEFT + (eight[starts[at] + step] & _LOW_BYTES[np.minimum(size[at] - step, 8)]))
        step += 8
        at = at[size[at] > step]
    for i in np.flatnonzero(size > _LONG_WORD):
        h[i] = xxhash.xxh3_64_intdigest(data[starts[i] : ends[i]].data)
    return h


def _joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix64(mix64(a * _LEFT + U64(1)) + b * _RIGHT)


def gram_hashes(values: np.ndarray, k: int, salt: int = 0) -> np.ndarray:
    """Hashes of all k consecutive values (no regard to document borders), joined by doubling: each join is mixed."""
    n = len(values) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=U64)
    out, done, power, size = None, 0, values, 1
    while True:
        if k & size:
            part = power[done : done + n]
            out = part if out is None else _joined(out, part)
            done += size
        if 2 * size > k:
            break
        power, size = _joined(power[:-size], power[size:]), 2 * size
    return mix64(out + U64(salt)) if salt else out


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, salt: int = 0) -> np.ndarray:
    """Hash of values[start:end] for each span: of the two runs of 2**i values, as long as fit, that begin and end it."""
    size = ends - starts
    out = np.full(len(size), salt, dtype=U64)
    level = np.frexp(size)[1] - 1
    power, run = values, 1
    for i in range(int(level.max(initial=-1)) + 1):
        own = np.flatnonzero(level == i)
        out[own] = _joined(power[starts[own]], power[ends[own] - run]) + U64(salt)
        if i < level.max():
            power, run = _joined(power[:-run], power[run:]), 2 * run
    return mix64(out + size.astype(U64) * U64(0xA24BAED4963EE407))


class Words:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a slice of texts, as arrays.

    hashes, starts and ends (bytes in ``data``) of all words in order; ``first[i]:first[i + 1]`` are those of text i.
    """

    def __init__(self, texts: pa.Array, lower: bool = False):
        data, bounds = text_bytes(texts)
        self.data = LOWER[data] if lower else data
        self.bounds = bounds
        solid = ~IS_SPACE[data]
        begin = solid.copy()
        begin[1:] &= ~solid[:-1]
        inner = bounds[1:-1]
        inner = inner[inner < len(data)]
        begin[inner] |= solid[inner]
        self.starts = np.flatnonzero(begin)
        stop = np.append(~solid[1:], True)[: len(data)] & solid
        before = inner[inner > 0] - 1
        stop[before] |= solid[before]
        self.ends = np.flatnonzero(stop) + 1
        self.hashes = word_hashes(self.data, self.starts, self.ends)
        self.first = np.searchsorted(self.starts, bounds)
        self.counts = np.diff(self.first)
        self.text_of = np.repeat(np.arange(len(texts)), self.counts)

    def __len__(self) -> int:
        return len(self.hashes)


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts, one after the other (null: empty), and the n + 1 bounds."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    bounds = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    if texts.buffers()[2] is None or not len(texts):
        return np.zeros(0, dtype=np.uint8), np.zeros(len(texts) + 1, dtype=np.int64)
    data = np.frombuffer(texts.buffers()[2], dtype=np.uint8)[bounds[0] : bounds[-1]]
    return data, bounds - bounds[0]


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches, cut so that the texts of each hold about ``limit`` bytes."""
    for batch in batches:
        if not batch.num_rows:
            continue
        total = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
        at = 0
        while at < batch.num_rows:
            base = total[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(total, base + limit, side="right")))
            yield batch.slice(at, to - at)
            at = to


def i64(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64) if x.dtype == U64 else x.astype(np.int64))


def text_key(text: Column) -> list[Column]:
    """128 bits that stand for a text: equal texts share them, whatever the other columns hold."""
    text = F.coalesce(text, F.lit(""))
    return [F.xxhash64(text).alias("_k1"), F.xxhash64(F.lit(7), text, F.length(text)).alias("_k2")]


def crc_mod(doc_id: Column, n: int) -> Column:
    """crc32 of the id's decimal text, modulo n; -1 for a null id."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(n)), F.lit(-1))


def documents(spark, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
