"""Telephony audio in media columns: mu-law, A-law and IMA ADPCM, decoded with numpy and resampled to linear PCM.

The stored form is a WAVE file of one channel at 8 kHz (format tag 7: mu-law, 6: A-law, 17: IMA ADPCM in blocks of UNIT
bytes). Companded samples expand by lookup tables built from the codecs' rules; ADPCM runs sample by sample but over all
blocks of a slice at once. The resampled PCM is stored without loss: its even samples, then what its odd samples differ
from the mean of their neighbours (``coded``, ``plain``), which packs better than the samples.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ..storage import materialize
from .common import slices, text_bytes

_SCHEMA = "doc_id {id}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
_COLUMNS = [c.split(" ")[0] for c in _SCHEMA.split(", ")][1:]
#: Compression level of the stored table: the bytes lie there for long.
LEVEL = 9
#: Samples a second of the recordings, and of the stored PCM.
RATE, TARGET = 8000, 16000
UNIT = 192
MULAW_TAG, ALAW_TAG, ADPCM_TAG = 7, 6, 17

#: Fixed values of the IMA ADPCM format: step sizes, and changes of the step index by code.
STEPS = np.array(
    [7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118, 130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060, 1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132, 7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767],
    dtype=np.int32,
)
SHIFTS = np.array([-1, -1, -1, -1, 2, 4, 6, 8] * 2, dtype=np.int32)


def mulaw_table() -> np.ndarray:
    """16-bit values of the 256 mu-law codes: complemented sign, 3-bit segment, 4-bit step, bias 132."""
    code = ~np.arange(256, dtype=np.int32) & 0xFF
    size = ((((code & 15) << 3) + 132) << ((code >> 4) & 7)) - 132
    return np.where(code & 128, -size, size).astype(np.int16)


def alaw_table() -> np.ndarray:
    """16-bit values of the 256 A-law codes: even bits inverted, linear in the lowest segment."""
    code = np.arange(256, dtype=np.int32) ^ 0x55
    segment, step = (code >> 4) & 7, ((code & 15) << 4) + 8
    size = np.where(segment == 0, step, (step + 256) << np.maximum(segment - 1, 0))
    return np.where(code & 128, size, -size).astype(np.int16)


MULAW, ALAW = mulaw_table(), alaw_table()


def adpcm_decode(blocks: np.ndarray) -> np.ndarray:
    """Samples (n, 1 + 2 * (width - 4)) of n mono IMA ADPCM blocks (n, width) of bytes, all blocks in step.

    A header index above 88 counts as 88.
    """
    head = blocks[:, :4].astype(np.int32)
    value = (head[:, 0] | (head[:, 1] << 8)).astype(np.uint16).view(np.int16).astype(np.int32)
    index = np.minimum(head[:, 2], 88)
    codes = np.empty((2 * (blocks.shape[1] - 4), len(blocks)), dtype=np.uint8)
    codes[0::2] = (blocks[:, 4:] & 15).T
    codes[1::2] = (blocks[:, 4:] >> 4).T
    out = np.empty((len(codes) + 1, len(blocks)), dtype=np.int16)
    out[0] = value
    for t, code in enumerate(codes, 1):
        step = STEPS[index]
        change = step >> 3
        change += np.where(code & 4, step, 0)
        change += np.where(code & 2, step >> 1, 0)
        change += np.where(code & 1, step >> 2, 0)
        value = np.clip(np.where(code & 8, value - change, value + change), -32768, 32767)
        index = np.clip(index + SHIFTS[code], 0, 88)
        out[t] = value
    return out.T


def wave_file(payload: bytes, tag: int = MULAW_TAG, rate: int = RATE) -> bytes:
    """A WAVE file around one-byte samples (mu-law, A-law) or IMA blocks of UNIT bytes; struct.error beyond 4 GiB."""
    if tag == ADPCM_TAG:
        each = 2 * (UNIT - 4) + 1
        form = struct.pack("<HHIIHHHH", tag, 1, rate, rate * UNIT // each, UNIT, 4, 2, each)
    else:
        form = struct.pack("<HHIIHHH", tag, 1, rate, rate, 1, 8, 0)
    body = b"WAVEfmt " + struct.pack("<I", len(form)) + form + b"data" + struct.pack("<I", len(payload)) + payload + b"\0" * (len(payload) & 1)
    return b"RIFF" + struct.pack("<I", len(body)) + body


def parse_wave(media: bytes) -> tuple[int, int, memoryview]:
    """Format tag, rate and data bytes of a WAVE file; raises ValueError if it isn't one."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAVE file")
    at, tag, rate = 12, 0, 0
    while at + 8 <= len(media):
        name, n = media[at : at + 4], struct.unpack_from("<I", media, at + 4)[0]
        if name == b"fmt ":
            tag, _, rate = struct.unpack_from("<HHI", media, at + 8)
        elif name == b"data":
            return tag, rate, memoryview(media)[at + 8 : at + 8 + n]
        at += 8 + n + (n & 1)
    raise ValueError("no data chunk")


def decode(media: bytes) -> tuple[int, np.ndarray]:
    """Rate and 16-bit samples of a stored file of any of the three codecs."""
    tag, rate, data = parse_wave(media)
    codes = np.frombuffer(data, dtype=np.uint8)
    if tag == ADPCM_TAG:
        return rate, adpcm_decode(codes.reshape(-1, UNIT)).reshape(-1)
    if tag not in (MULAW_TAG, ALAW_TAG):
        raise ValueError(f"format tag {tag}")
    return rate, (MULAW if tag == MULAW_TAG else ALAW)[codes]


def resample(samples: np.ndarray, last: np.ndarray, rate: int = RATE, target: int = TARGET) -> tuple[np.ndarray, np.ndarray]:
    """16-bit samples at another rate by linear interpolation, rounded down, and the places of the recordings' ends.

    ``last`` has the places of each recording's last sample, which repeats; each second of a recording keeps its length.
    """
    x = samples.astype(np.int64)
    after = np.append(x[1:], x[-1:])
    after[last] = x[last]
    size = np.diff(last, prepend=-1)
    made = -(-size * target // rate)
    ends = np.cumsum(made)
    at = np.arange(int(made.sum())) - np.repeat(ends - made, made)
    if target == 2 * rate:
        place, part = at >> 1, at & 1
        place += np.repeat(last + 1 - size, made)
        return (x[place] + (part * (after[place] - x[place]) >> 1)).astype(np.int16), ends
    place, part = np.divmod(at * rate, target)
    place += np.repeat(last + 1 - size, made)
    return (x[place] + (after[place] - x[place]) * part // target).astype(np.int16), ends


def coded(pcm: np.ndarray) -> bytes:
    """The even samples, then the odd ones less the mean of their neighbours (modulo 2**16), little-endian."""
    even, odd = pcm[0::2].astype(np.int32), pcm[1::2].astype(np.int32)
    after = np.append(even[1:], even[-1:])[: len(odd)]
    return even.astype("<i2").tobytes() + (odd - (even[: len(odd)] + after >> 1)).astype("<i2").tobytes()


def plain(stored: bytes) -> np.ndarray:
    """The samples of what ``coded`` made."""
    parts = np.frombuffer(stored, dtype="<i2").astype(np.int32)
    n = len(parts) // 2
    even, rest = parts[: len(parts) - n], parts[len(parts) - n :]
    out = np.empty(len(parts), dtype="<i2")
    out[0::2] = even
    out[1::2] = rest + (even[:n] + np.append(even[1:], even[-1:])[:n] >> 1)
    return out


def padded(raw: bytes) -> bytes:
    """Bytes 32 appended up to a positive multiple of UNIT."""
    return raw.ljust(max(UNIT, -(-len(raw) // UNIT) * UNIT), b" ")


def _sums(x: np.ndarray, first: np.ndarray) -> np.ndarray:
    return np.add.reduceat(x, first)


def _described(n_bytes: np.ndarray, files: list, streams: list | None = None) -> dict:
    """Columns of files, and of their PCM where it is given: else it is made, and handed back as ``pcm``."""
    tags, _, back = zip(*map(parse_wave, files))
    codes = np.frombuffer(b"".join(back), dtype=np.uint8)
    size = np.array([len(b) for b in back], dtype=np.int64)
    end = np.cumsum(size)
    first = end - size
    linear, other = MULAW[codes], ALAW[codes]
    adaptive = adpcm_decode(codes.reshape(-1, UNIT))
    power = _sums(np.square(linear.astype(np.int64)), first)
    power_a = _sums(np.square(other.astype(np.int64)), first)
    power_d = _sums(np.square(adaptive.astype(np.int64)).sum(axis=1), first // UNIT)
    turns = np.zeros(len(linear), dtype=np.int64)
    turns[1:] = (linear[1:] < 0) != (linear[:-1] < 0)
    turns[first] = 0
    turns = _sums(turns, first)
    peak = np.maximum.reduceat(np.abs(linear.astype(np.int32)), first)
    made = {}
    if streams is None:
        heard = {MULAW_TAG: linear, ALAW_TAG: other, ADPCM_TAG: adaptive.reshape(-1)}[tags[0]]
        wide, ends = resample(heard, end * len(heard) // len(codes) - 1)
        streams = np.split(wide, ends[:-1])
        made["pcm"] = [coded(s) for s in streams]
    return {
        "n_bytes": n_bytes,
        "payload_bytes": size,
        "payload_sha256": [hashlib.sha256(b).hexdigest() for b in back],
        "tail_crc32": np.array([zlib.crc32(b[-16:]) for b in back], dtype=np.int64),
        "media_bytes": np.array([len(f) for f in files], dtype=np.int64),
        "media_sha256": [hashlib.sha256(f).hexdigest() for f in files],
        "feature": [
            f"mulaw rms {np.sqrt(p / n):.3f} peak {k} turns {z}; alaw rms {np.sqrt(a / n):.3f}; adpcm rms {np.sqrt(d / (n // UNIT * 377)):.3f}; pcm {TARGET} Hz {len(s)} crc {zlib.crc32(s.astype('<i2').tobytes()):08x}"
            for p, a, d, k, z, n, s in zip(power, power_a, power_d, peak, turns, size, streams)
        ],
    } | made


def store_batches(batches: Iterator[pa.RecordBatch], tag: int, kept: tuple[str, ...]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        data, bounds = text_bytes(batch.column("text"))
        out = {"media": [wave_file(padded(data[a:b].tobytes()), tag) for a, b in zip(bounds[:-1], bounds[1:])]}
        out |= _described(np.diff(bounds), out["media"])
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(out[c], pa.binary()) if c in ("media", "pcm") else pa.array(out[c]) for c in kept)], names=["doc_id", *kept])


def read_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The columns of ``store`` but media and pcm, all but n_bytes from the stored file and the stored PCM."""
    for batch in slices(batches, "media"):
        out = _described(batch.column("n_bytes").to_numpy(), batch.column("media").to_pylist(), [plain(x) for x in batch.column("pcm").to_pylist()])
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *map(pa.array, out.values())], names=["doc_id", *out])


def stored(docs: DataFrame, tag: int = MULAW_TAG) -> DataFrame:
    """What ``store`` tells of each text, derived from its media and pcm as they are read again from the shared folder."""
    table = materialize(store(docs, tag, ("n_bytes", "media", "pcm")), "media", level=LEVEL)
    return table.mapInArrow(read_batches, _SCHEMA.format(id=docs.schema["doc_id"].dataType.simpleString()))


def store(docs: DataFrame, tag: int = MULAW_TAG, columns: tuple[str, ...] = (*_COLUMNS, "media", "pcm")) -> DataFrame:
    """Each text's UTF-8 bytes (null: none), padded, as a recording of the codec ``tag``: the stored file in ``media``, its
    resampled 16-bit PCM in ``pcm`` (as ``coded``), and features of what is read back.

    Features: root mean square, peak and sign changes of the bytes as mu-law samples, root mean squares of the same bytes
    as A-law samples and as ADPCM blocks, length and checksum of the resampled PCM. Equal texts, repeated rows among them,
    give equal values; the features of an empty text are those of UNIT spaces; a text is stored whole, however long. An
    empty table gives an empty one. Ids may be null and of any type. Other columns are ignored, whatever their names.
    Nothing is shuffled.
    """
    kinds = dict(c.split(" ") for c in _SCHEMA.format(id="").split(", ")[1:]) | {"media": "binary", "pcm": "binary"}
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}" + "".join(f", {c} {kinds[c]}" for c in columns)
    return docs.select("doc_id", "text").mapInArrow(lambda it: store_batches(it, tag, columns), schema)
