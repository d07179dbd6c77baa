"""Action types and their handlers, and the stack that serves them."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from . import retrieval as R

Handler = Callable[[DataFrame], DataFrame]


@dataclass
class Executor:
    """Runs one action type over many states at once. A handler takes queries (query_id, question or embedding) and returns
    hits. New action types are registered with their handlers."""

    handlers: dict[str, Handler] = field(default_factory=dict)

    def register(self, kind: str, handler: Handler) -> None:
        if not kind:
            raise ValueError("an action type needs a name")
        self.handlers[kind] = handler

    def execute(self, kind: str, states: DataFrame) -> DataFrame:
        """Hits of all states; states that have ended (final_answer) are refused, as are unknown types."""
        if kind not in self.handlers:
            raise ValueError(f"no handler for action type {kind!r}")
        if "final_answer" in states.columns and not states.where("final_answer is not null").isEmpty():
            raise ValueError("some states have ended")
        if kind == "image_search" and "embedding" not in states.columns:
            raise ValueError("image_search needs the image's embedding")
        return self.handlers[kind](states)


BACKENDS = ("unified", "bm25", "hybrid")


def build_executor(corpus: DataFrame, units: DataFrame | None = None, backend: str = "bm25", text_k: int = 5, image_k: int = 3, dedupe: str | None = "entity_key", images: bool = True) -> Executor:
    """Wires text and image search: BM25 alone, vectors alone, or both interleaved; without encoded units only BM25.

    Image search comes with encoded units. ``dedupe``: at most one hit per value of that column of the units.
    """
    if backend not in BACKENDS:
        raise ValueError(f"unknown backend {backend!r}; one of {BACKENDS}")
    if units is None:
        backend = "bm25"
    stack = Executor()
    vector = lambda q, k: R.vector_top_k(units, q, k, dedupe=dedupe)
    if backend == "bm25":
        stack.register("text_search", lambda q: R.bm25_top_k(corpus, q, text_k))
    elif backend == "unified":
        stack.register("text_search", lambda q: vector(q, text_k))
    else:

        def both(q: DataFrame) -> DataFrame:
            from pyspark.sql import functions as F

            lexical = R.bm25_top_k(corpus, q, text_k).select("query_id", "rank", "doc_id", F.lit(None).cast("string").alias("modality"))
            semantic = vector(q, text_k).join(units.select("unit_id", "doc_id", "modality"), "unit_id").select("query_id", "rank", "doc_id", "modality")
            return R.interleaved(lexical, semantic, text_k)

        stack.register("text_search", both)
    if images and units is not None:
        stack.register("image_search", lambda q: vector(q, image_k))
    stack.register("answer", lambda q: q)
    return stack
