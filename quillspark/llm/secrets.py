"""Secret scans by a trigram inverted index.

Each rule's regular expression is parsed into a Boolean query over trigrams that every match must contain. Texts are
indexed in segments: a segment's postings say which of its texts hold which trigram. The query, evaluated on whole
postings at once, leaves candidates that the expression itself verifies. A rule without mandatory trigrams scans
every text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from re import _constants as K
from re import _parser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, slices, text_bytes

ANY = True


@dataclass(frozen=True)
class Rule:
    """A kind of secret. ``group`` (0: the match) must have ``least`` characters; ``run`` marks a rule that is one run of a
    character class, so that a full scan may look for long enough runs first."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    run: str = ""
    compiled: re.Pattern = field(init=False, compare=False)

    def __post_init__(self):
        object.__setattr__(self, "compiled", re.compile(self.pattern, re.ASCII))

    def spans(self, text: str) -> list[tuple[int, int]]:
        return [m.span() for m in self.compiled.finditer(text) if m.end(self.group) - m.start(self.group) >= self.least]


#: The kinds that results are counted by.
BASE = (
    Rule("assign", r"""(?:(?i:(password|passwd|secret|token|api_?key)))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 18),
    Rule("hex", r"[0-9a-f]+", 0, 16, run="0123456789abcdef"),
)
#: Public token formats that the scan adds.
ADDED = (
    Rule("repo_token", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat_token", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("map_key", r"AIza[0-9A-Za-z_-]{35}"),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
    # with its body: to the END line, or where none follows before other dashes, as far as header and base64 lines go
    Rule(
        "private_key",
        r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----(?:(?:[^-]|-{1,4}[^-])*-----END [A-Z ]{0,20}PRIVATE KEY-----|(?:[\x20\t\r\n]+(?:Proc-Type|DEK-Info):[^\r\n]*|[\x20\t\r\n]*[A-Za-z0-9+/]{40,}={0,2})*(?:[\x20\t\r\n]+[A-Za-z0-9+/]{16,}={0,2}|[\x20\t\r\n]+[A-Za-z0-9+/]+={1,2})?)",
    ),
)
RULES = BASE + ADDED
SPANS = "array<struct<kind:string,start:int,end:int>>"


def trigram_query(pattern: str, most: int = 64):
    """A nested ("and" | "or", [...]) over lower-cased trigrams which holds for every text with a match; True if none is mandatory.

    Walks the parsed expression keeping the finite set of strings that the part read last must spell. Where that set
    would exceed ``most`` strings or isn't finite, its trigrams are required and it begins anew.
    """

    def both(a, b):
        return b if a is ANY else a if b is ANY else ("and", [a, b])

    def required(strings: set[str]):
        if min(map(len, strings)) < 3:
            return ANY
        return ("or", [("and", sorted({s[i : i + 3] for i in range(len(s) - 2)})) for s in sorted(strings)])

    def one(op, arg):
        """The finite set of strings of one parsed item, or None; and the query of its inside."""
        if op is K.LITERAL:
            return {chr(arg).lower()}, ANY
        if op is K.IN:
            if all(o is K.LITERAL for o, _ in arg):
                return {chr(c).lower() for _, c in arg}, ANY
            return None, ANY
        if op is K.SUBPATTERN:
            return sequence(arg[-1])
        if op is K.BRANCH:
            parts = [sequence(p) for p in arg[1]]
            if all(s is not None for s, _ in parts):
                return set().union(*(s for s, _ in parts)), ANY
            asked = [q if s is None else required(s) for s, q in parts]
            return None, ANY if any(q is ANY for q in asked) else ("or", asked)
        if op in (K.MAX_REPEAT, K.MIN_REPEAT):
            low, high, inner = arg
            strings, query = sequence(inner)
            if strings is not None and (low, high) == (0, 1):
                return strings | {""}, ANY
            if low == 0:
                return None, ANY
            return None, query if strings is None else required(strings)
        return None, ANY

    def sequence(items):
        strings, query, finite = {""}, ANY, True
        for op, arg in items:
            if op is K.AT:
                continue
            own, inside = one(op, arg)
            query = both(query, inside)
            if own is not None and len(strings) * len(own) <= most:
                strings = {a + b for a in strings for b in own}
            else:
                query, finite = both(query, required(strings)), False
                strings = own if own is not None and len(own) <= most else {""}
        return (strings, ANY) if finite else (None, both(query, required(strings)))

    strings, query = sequence(_parser.parse(pattern))
    return query if strings is None else required(strings)


def trigrams_of(query) -> set[str]:
    return set() if query is ANY else {query} if isinstance(query, str) else set().union(*map(trigrams_of, query[1]))


class Segment:
    """The inverted index of one slice of texts: for each trigram that rules ask for, the texts that hold it (case folded)."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray, number: dict[str, int], lookup: np.ndarray):
        self.number = number
        self.size = len(bounds) - 1
        self.postings = np.zeros((len(number) + 1, self.size), dtype=bool)
        if len(data) > 2:
            low = LOWER[data].astype(np.int32)
            which = lookup[(low[:-2] << 16) | (low[1:-1] << 8) | low[2:]]
            at = np.flatnonzero(which)
            self.postings[which[at] - 1, np.searchsorted(bounds, at, side="right") - 1] = True

    def ask(self, query) -> np.ndarray:
        if query is ANY:
            return np.ones(self.size, dtype=bool)
        if isinstance(query, str):
            return self.postings[self.number[query]]
        parts = [self.ask(q) for q in query[1]]
        return (np.logical_and if query[0] == "and" else np.logical_or).reduce(parts)


def runs_of(data: np.ndarray, bounds: np.ndarray, letters: str, least: int) -> np.ndarray:
    """Texts that hold ``least`` bytes of a class in a row; borders between texts may add candidates."""
    table = np.zeros(256, dtype=bool)
    table[list(letters.encode())] = True
    found, have = table[data], 1
    while have < least and len(found):
        step = min(have, least - have)
        found = found[: len(found) - step] & found[step:]
        have += step
    out = np.zeros(len(bounds) - 1, dtype=bool)
    out[np.searchsorted(bounds, np.flatnonzero(found), side="right") - 1] = True
    return out


def scan_batches(batches: Iterator[pa.RecordBatch], rules=RULES, redact: bool = False) -> Iterator[pa.RecordBatch]:
    """Adds ``spans`` to each batch, or with ``redact`` replaces them in ``text``."""
    asked = {r: trigram_query(r.pattern) for r in rules}
    number = {t: i for i, t in enumerate(sorted(set().union(*map(trigrams_of, asked.values()))))}
    lookup = np.zeros(1 << 24, dtype=np.int16)
    for t, i in number.items():
        a, b, c = t.encode("ascii")
        lookup[(a << 16) | (b << 8) | c] = i + 1
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
    order = {r.kind: i for i, r in enumerate(rules)}
    for batch in slices(batches):
        texts = batch.column("text")
        data, bounds = text_bytes(texts)
        segment = Segment(data, bounds, number, lookup)
        found: list[list[tuple]] = [[] for _ in range(batch.num_rows)]
        for r in rules:
            may = segment.ask(asked[r])
            if asked[r] is ANY and r.run:
                may = runs_of(data, bounds, r.run, r.least)
            for i in np.flatnonzero(may):
                found[i] += [(s, order[r.kind], e, r.kind) for s, e in r.spans(texts[int(i)].as_py() or "")]
        for x in found:
            x.sort()
        if not redact:
            rows = [[{"kind": k, "start": s, "end": e} for s, _, e, k in x] for x in found]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rows, kind)], names=[*batch.schema.names, "spans"])
            continue
        hit = [i for i, x in enumerate(found) if x]
        if hit:
            new = texts.to_pylist()
            for i in hit:
                new[i] = masked(new[i], found[i])
            n = batch.schema.get_field_index("text")
            batch = batch.set_column(n, batch.schema.field(n), pa.array(new, batch.schema.field(n).type))
        yield batch


def masked(text: str, spans: list[tuple]) -> str:
    """The text with each maximal union of overlapping spans replaced by [kind] of the first."""
    out, at = [], 0
    for s, _, e, k in spans:
        if s >= at:
            out += [text[at:s], f"[{k}]"]
        at = max(at, e)
    return "".join([*out, text[at:]])


def scan(docs: DataFrame, rules=RULES) -> DataFrame:
    """doc_id and the array ``spans`` (kind, start, end in code points, end exclusive), by start, then kind as listed.

    A null text counts as empty: no spans. Repeated rows give repeated rows; an empty table gives an empty one. Other
    columns are ignored, whatever their names. Memory: one slice of texts a task; nothing is shuffled.
    """
    return docs.select("doc_id", "text").mapInArrow(
        lambda it: (b.drop_columns(["text"]) for b in scan_batches(it, rules)), docs.select("doc_id").schema.add("spans", _spans_type(docs.sparkSession))
    )


def _spans_type(spark):
    from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

    return ArrayType(StructType([StructField("kind", StringType()), StructField("start", IntegerType()), StructField("end", IntegerType())]))


def redact(docs: DataFrame, rules=RULES) -> DataFrame:
    """All rows and columns, each secret in ``text`` replaced by its kind in brackets; n_chars, where there, counts anew.

    Rows with a null text stay as they are.
    """
    out = docs.mapInArrow(lambda it: scan_batches(it, rules, redact=True), docs.schema)
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast(kind)))
    return out


def joined(spans, kinds=None):
    """kind:start:end of the spans, comma-joined."""
    chosen = spans if kinds is None else F.filter(spans, lambda s: s["kind"].isin(*kinds))
    return F.concat_ws(",", F.transform(chosen, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))


def digest(scanned: DataFrame) -> DataFrame:
    """The result contract: counts by kind, hash of the base spans, all spans."""
    spans = F.col("spans")

    def count(kind: str):
        return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")

    return scanned.select(
        "doc_id",
        *[count(r.kind).alias(f"n_{r.kind}") for r in BASE],
        F.sha2(joined(spans, [r.kind for r in BASE]).cast("binary"), 256).alias("base_sha256"),
        joined(spans).alias("spans"),
    )
