"""Tree search over retrieval actions.

Proposals and rankings are Column expressions; backups and selections over a stored tree are relational; the rollouts of a
query depend on each other, so they run as one state machine per query, over hits that were retrieved beforehand: the
actions of a query are a closed set, so retrieval needn't run inside.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scores as S
from ..functions.metrics import exact_match
from ..functions.text import keyword_query, let

ACTION = "array<struct<type:string,query:string,text:string,region:array<double>,image_path:string>>"
_WORD = re.compile(r"\b([A-Z][a-zA-Z]+)\b")
# Words of a question that ask for its image, and that ask for text only.
VISUAL_TERMS = [
    "this building", "this aircraft", "this animal", "this car", "this model", "this image", "this object", "this bird",
    "this lake", "this mountain", "identify", "which animal", "what is shown", "package", "flower on the package",
]
TEXT_TERMS = ["passage", "weather", "climate", "expected ratio", "offspring", "experiment", "best answer", "select the best"]
# Priority of image and text searches by benchmark; of answers with and without evidence.
PRIORITIES = {"scienceqa": (0.2, 1.0), "mragbench": (1.0, 0.45), "infoseek": (1.0, 0.85), "": (0.75, 0.9)}
ANSWER_PRIORITY = (0.55, -1.0)


def action(kind: str | Column, query: Column | None = None, text: Column | None = None, region: Column | None = None, image_path: Column | None = None) -> Column:
    """A text search has a query, an answer a text, an image search may have a region (x1, y1, x2, y2) and an image of its own."""
    given = [F.lit(kind) if isinstance(kind, str) else kind, query, text, region, image_path]
    kinds = ["string", "string", "string", "array<double>", "string"]
    return F.struct(*[(F.lit(None).cast(t) if c is None else c.cast(t)).alias(n) for n, c, t in zip(("type", "query", "text", "region", "image_path"), given, kinds)])


def _without(actions: Column, taken: Column) -> Column:
    return F.filter(actions, lambda a: ~F.exists(taken, lambda t: t.eqNullSafe(a)))


def heuristic_actions(question: Column, has_image: Column, has_evidence: Column, taken: Column, answer: Column, k: int = 4, reformulate: bool = True, images: bool = True) -> Column:
    """At most k actions in order: the question as a text search, its keywords, an image search, an answer.

    Actions taken before are left out. The answer comes in if there is evidence or nothing else, and room.
    """

    def searches(words: Column) -> Column:
        asked = [action("text_search", question)]
        if reformulate:
            asked.append(F.when((words != "") & (words != question), action("text_search", words)))
        if images:
            asked.append(F.when(has_image, action("image_search")))
        return F.array_compact(F.array(*asked))

    found = let(taken, lambda t: _without(let(keyword_query(question), searches), t))
    with_answer = lambda c: F.when((has_evidence | (F.size(c) == 0)) & (F.size(c) < k), F.concat(c, F.array(action("answer", None, answer)))).otherwise(c)
    return F.slice(let(found, with_answer), 1, k)


def benchmark_key(name: str) -> str:
    return name.lower().replace("-", "").replace("_", "")


def allowed_types(question: Column, has_image: Column, benchmark: str = "", mode: str = "dataset") -> Column:
    """Action types that a gate lets through: by benchmark, or in heuristic and strict mode by the question's terms; all of
    them in mode off."""
    name = "" if mode.lower() == "off" else benchmark_key(benchmark)
    all_ = F.array(F.lit("text_search"), F.lit("image_search"), F.lit("answer"))
    plain = F.array(F.lit("text_search"), F.lit("answer"))
    if name == "scienceqa":
        return plain
    if mode.lower() not in ("heuristic", "strict") or name == "cragmm":
        return all_
    says = lambda terms: let(F.lower(question), lambda low: F.exists(F.array(*map(F.lit, terms)), lambda t: F.contains(low, t)))
    look = has_image & (F.lit(True) if name == "mragbench" else says(VISUAL_TERMS))
    if name != "mragbench":
        look = look & ~says(TEXT_TERMS)
    return F.when(look, all_).otherwise(plain)


def priority(a: Column, has_evidence: Column, benchmark: str = "", mode: str = "dataset") -> Column:
    name = benchmark_key(benchmark)
    image, text = PRIORITIES.get(name, PRIORITIES[""])
    if mode.lower() == "strict" and name == "scienceqa":
        image -= 0.4
    return (
        F.when(a["type"] == "answer", F.when(has_evidence, F.lit(ANSWER_PRIORITY[0])).otherwise(F.lit(ANSWER_PRIORITY[1])))
        .when(a["type"] == "image_search", F.lit(image))
        .when(a["type"] == "text_search", F.lit(text))
        .otherwise(F.lit(0.0))
    )


def asked_actions(k: int, most: int | None = None) -> int:
    """Actions that a gate asks its proposer for, so that k are left: more than k, unless one is asked for."""
    return k if k <= 1 else max(k, most or k, 6)


def gated_actions(actions: Column, question: Column, has_image: Column, has_evidence: Column, k: int, benchmark: str = "", mode: str = "dataset", most: int | None = None, available: list[str] | None = None) -> Column:
    """Proposed actions of allowed and available types by falling priority, order kept among equals; answers alone if none is left."""
    types = allowed_types(question, has_image, benchmark, mode)
    if available is not None:
        types = F.array_union(F.array_intersect(types, F.array(*map(F.lit, available))), F.array(F.lit("answer")))

    def allowed(given: Column) -> Column:
        answers = F.filter(given, lambda a: a["type"] == "answer")
        own = let(types, lambda t: F.filter(given, lambda a: F.array_contains(t, a["type"])))
        return let(own, lambda kept: F.when(F.size(kept) > 0, kept).otherwise(answers))

    some = let(actions, allowed)
    keyed = F.array_sort(F.transform(some, lambda a, i: F.struct((-priority(a, has_evidence, benchmark, mode)).alias("p"), i.alias("i"), a.alias("a"))))
    return F.slice(F.transform(keyed, lambda s: s["a"]), 1, min(k, most or k))


def parsed_actions(raw: Column, has_image: Column, frozen: Callable[[Column], Column] | None = None) -> Column:
    """Actions of a policy's reply: one JSON object a line, code marks around it ignored; other lines are skipped. ``frozen``
    maps a text search's query to the one that may be asked."""
    lines = F.filter(F.transform(F.split(raw, r"\r\n|[\n\r\x0B\f]"), lambda l: F.regexp_replace(F.regexp_replace(l, r"(?U)^\s+|\s+$", ""), "^`+|`+$", "")), lambda l: l.startswith("{") & l.endswith("}"))  # noqa: E741
    read = F.transform(lines, lambda l: F.from_json(l, "type string, query string, text string, region array<double>", {"mode": "PERMISSIVE"}))  # noqa: E741
    said = lambda c: F.coalesce(c, F.lit("")) != ""
    good = F.filter(read, lambda o: ((o["type"] == "text_search") & said(o["query"])) | ((o["type"] == "image_search") & has_image) | ((o["type"] == "answer") & said(o["text"])))
    asked = lambda o: F.when(o["type"] == "text_search", frozen(o["query"]) if frozen else o["query"])
    return F.transform(good, lambda o: action(o["type"], asked(o), F.when(o["type"] == "answer", o["text"]), F.when((o["type"] == "image_search") & (F.size(o["region"]) > 0), o["region"])))


def frozen_query(query: Column, question: Column, evidence: Column) -> Column:
    """A query that is the question or one of the evidence strings, word for word; else the question."""
    trim = lambda c: F.regexp_replace(c, r"(?U)^\s+|\s+$", "")
    choices = F.filter(F.concat(F.array(question), evidence), lambda c: F.coalesce(c != "", F.lit(False)))
    return let(trim(query), lambda q: F.coalesce(F.try_element_at(F.filter(choices, lambda c: trim(c) == q), F.lit(1)), question))


def completed_actions(parsed: Column, fallback: Column, question: Column, has_image: Column, titles: Column, has_evidence: Column, taken: Column, k: int, images: bool = True) -> Column:
    """A policy's actions with its guarantees: the fallback's where it gave none; no answer without evidence; an image
    branch at the second place; a text branch (first title and keywords, else keywords) at the end; none taken before."""
    # lambdas compute what they close over for every element: each of these once
    return let(
        F.struct(parsed.alias("parsed"), fallback.alias("fallback"), taken.alias("taken"), titles.alias("titles"), keyword_query(question).alias("words")),
        lambda once: _completed(once["parsed"], once["fallback"], question, has_image, once["titles"], has_evidence, once["taken"], once["words"], k, images),
    )


def _completed(parsed: Column, fallback: Column, question: Column, has_image: Column, titles: Column, has_evidence: Column, taken: Column, words: Column, k: int, images: bool) -> Column:
    base = F.when(F.size(parsed) > 0, parsed).otherwise(fallback)
    if not images:
        base = F.filter(base, lambda a: a["type"] != "image_search")
    has = lambda c, kind: F.exists(c, lambda a: a["type"] == kind)

    def fill(c: Column) -> Column:
        if not images:
            return c
        missing = has_image & ~F.exists(taken, lambda t: t.eqNullSafe(action("image_search"))) & ~has(c, "image_search")
        return F.when(missing, F.concat(F.slice(c, 1, 1), F.array(action("image_search")), F.slice(c, F.lit(2), F.greatest(F.size(c), F.lit(1))))).otherwise(c)

    def text(c: Column) -> Column:
        first = F.when((F.size(titles) > 0) & (words != ""), action("text_search", F.trim(F.concat_ws(" ", F.try_element_at(titles, F.lit(1)), words))))
        second = action("text_search", F.when(words != "", words).otherwise(question))
        add = F.slice(_without(_without(F.array_compact(F.array(first, second)), taken), c), 1, 1)
        return F.when(has(c, "text_search"), c).otherwise(F.concat(c, add))

    start = F.when(has_evidence, base).otherwise(F.filter(base, lambda a: a["type"] != "answer"))
    whole = let(let(start, fill), text)
    return F.slice(_without(let(whole, lambda w: F.when(F.size(w) > 0, w).otherwise(fallback)), taken), 1, k)


def backed_up(leaves: DataFrame) -> DataFrame:
    """query_id, path, visits, total, q of every node: each leaf's rewards (query_id, path array, reward) count at it and
    all its ancestors, the root (empty path) among them."""
    up = leaves.select("query_id", "reward", F.explode(F.transform(F.sequence(F.lit(0), F.size("path")), lambda n: F.slice("path", F.lit(1), n))).alias("path"))
    nodes = up.groupBy("query_id", "path").agg(F.count("*").alias("visits"), F.sum("reward").alias("total"))
    return nodes.withColumn("q", F.col("total") / F.col("visits"))


def best_children(children: DataFrame, c: float = 1.0) -> DataFrame:
    """Per parent the child with the highest bound, the first of equals by position: (parent, position, visits, total, prior)."""
    q = S.q_value(F.col("total"), F.col("visits"), F.col("prior"))
    parent_visits = F.sum("visits").over(Window.partitionBy("parent"))
    scored = children.withColumn("uct", S.uct(q, F.col("visits"), parent_visits, c))
    return scored.withColumn("_n", F.row_number().over(Window.partitionBy("parent").orderBy(F.col("uct").desc(), "position"))).where("_n = 1").drop("_n")


def most_visited(children: DataFrame) -> DataFrame:
    """Per parent the child with the most visits, the first of equals."""
    return children.groupBy("parent").agg(F.max_by("child", F.struct("visits", -F.col("position"))).alias("child"), F.max("visits").alias("visits"))


def kept_children(proposed: DataFrame, k: int = 3) -> DataFrame:
    """Per parent the k proposals with the highest prior, order of proposal among equals."""
    order = Window.partitionBy("parent").orderBy(F.col("prior").desc(), "position")
    return proposed.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)


def until_stop(rollouts: DataFrame, threshold: float) -> DataFrame:
    """Rollouts (query_id, t, reward) up to and with the first that reaches the threshold."""
    before = Window.partitionBy("query_id").orderBy("t").rowsBetween(Window.unboundedPreceding, -1)
    return rollouts.withColumn("_done", F.coalesce(F.max(F.col("reward") >= threshold).over(before), F.lit(False))).where("not _done").drop("_done")


def best_rollouts(rollouts: DataFrame) -> DataFrame:
    """Per query the rollout of the highest reward, the earliest of equals, and how many there were."""
    return rollouts.groupBy("query_id").agg(F.min_by("t", F.struct(-F.col("reward"), "t")).alias("t"), F.max("reward").alias("reward"), F.count("*").alias("rollouts"))


def distinct_sequences(rollouts: DataFrame) -> DataFrame:
    """Rollouts whose action sequence didn't come before in their query, renumbered as traj_id ``<query>#t<n>``."""
    first = Window.partitionBy("query_id", "actions").orderBy("t")
    once = rollouts.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")
    n = F.row_number().over(Window.partitionBy("query_id").orderBy("t")) - 1
    return once.withColumn("traj_id", F.concat(F.col("query_id").cast("string"), F.lit("#t"), n.cast("string")))


@dataclass(frozen=True)
class SearchConfig:
    rollouts: int = 10
    max_depth: int = 3
    top_k_children: int = 3
    c_uct: float = 1.0
    early_stop_q: float = 0.9

    @classmethod
    def from_dict(cls, config: dict | None) -> SearchConfig:
        given = (config or {}).get("search", {})
        return cls(**{k: v for k, v in given.items() if k in cls.__dataclass_fields__})


@dataclass(frozen=True)
class State:
    """What a policy sees: the question, the searches that it may ask for (name to type), the names of actions taken, and for
    each taken one the (title, text) it found."""

    question: str
    searches: dict[str, str]
    taken: tuple[str, ...] = ()
    evidence: tuple[tuple[tuple[str, str], ...], ...] = ()

    @property
    def ended(self) -> bool:
        return "answer" in self.taken

    def texts(self) -> list[list[str]]:
        return [[f"{title}: {text}" if title else text for title, text in step] for step in self.evidence]


class Rules:
    """A policy without a model: untried searches in their order, then an answer by rule, scored by how much of it was seen."""

    def propose(self, state: State, k: int) -> list[str]:
        new = [name for name in state.searches if name not in state.taken]
        if (any(state.evidence) or not new) and len(new) < k:
            new.append("answer")
        return new[:k]

    def answer(self, state: State) -> str:
        """The last capitalised word of the first evidence text that has one."""
        for text in (x for step in state.texts() for x in step):
            found = _WORD.findall(text)
            if found:
                return found[-1]
        return "unknown"

    def score(self, state: State, answer: str | None) -> float:
        """Of a state, and of its answer where it has ended (else None)."""
        if answer is None:
            return 0.0
        seen = " ".join(" | ".join(step) for step in [*state.texts(), []]).lower()
        asked = answer.lower().split()
        share = sum(t in seen for t in asked) / len(asked) if asked else 0.0
        return min(1.0, (S.EVIDENCE_BONUS if seen.strip() else 0.0) + (1.0 - S.EVIDENCE_BONUS) * share) if asked else 0.0


@dataclass(frozen=True)
class Gated:
    """Another policy's proposals behind a gate, as ``gated_actions`` are."""

    base: object
    benchmark: str = ""
    mode: str = "dataset"
    most: int | None = None
    available: tuple[str, ...] | None = None

    def types(self, state: State) -> set[str]:
        mode, name = self.mode.lower(), benchmark_key(self.benchmark)
        found = {"text_search", "image_search", "answer"}
        if mode != "off" and name == "scienceqa":
            found.discard("image_search")
        elif mode in ("heuristic", "strict") and name != "cragmm":
            low = state.question.lower()
            look = "image_search" in state.searches.values()
            if name != "mragbench":
                look = look and any(t in low for t in VISUAL_TERMS) and not any(t in low for t in TEXT_TERMS)
            if not look:
                found.discard("image_search")
        return found if self.available is None else found & set(self.available) | {"answer"}

    def propose(self, state: State, k: int) -> list[str]:
        kind = lambda name: "answer" if name == "answer" else state.searches[name]
        image, text = PRIORITIES.get(benchmark_key(self.benchmark), PRIORITIES[""])
        if self.mode.lower() == "strict" and benchmark_key(self.benchmark) == "scienceqa":
            image -= 0.4
        worth = {"image_search": image, "text_search": text, "answer": ANSWER_PRIORITY[0 if any(state.evidence) else 1]}
        said = self.base.propose(state, asked_actions(k, self.most))
        types = self.types(state)
        kept = [n for n in said if kind(n) in types] or [n for n in said if n == "answer"]
        return sorted(kept, key=lambda n: -worth.get(kind(n), 0.0))[: min(k, self.most or k)]

    def answer(self, state: State) -> str:
        return self.base.answer(state)

    def score(self, state: State, answer: str | None) -> float:
        return self.base.score(state, answer)


class _Tree:
    """The search tree of one query. A node is the tuple of actions taken; ``answer`` ends it."""

    def __init__(self, question: str, searches: dict[str, str], hits: dict[str, list[tuple[str, str]]], config: SearchConfig, policy, trace: list | None = None):
        self.question, self.searches, self.hits, self.cfg, self.policy, self.trace = question, searches, hits, config, policy, trace
        self.visits, self.total, self.prior = {(): 0}, {(): 0.0}, {(): 0.0}
        self.below: dict[tuple, list[tuple]] = {}

    def told(self, event: str, node: tuple, value: float) -> None:
        if self.trace is not None:
            self.trace.append((event, ",".join(node), value))

    def state(self, node: tuple) -> State:
        return State(self.question, self.searches, node, tuple(tuple(self.hits.get(a, ())) for a in node if a != "answer"))

    def answer(self, node: tuple) -> str:
        return self.policy.answer(self.state(node[:-1]))

    def score(self, node: tuple) -> float:
        return float(self.policy.score(self.state(node), self.answer(node) if "answer" in node else None))

    def bound(self, node: tuple, parent: tuple) -> float:
        n = self.visits[node]
        if not n:
            return S.UNVISITED + self.prior[node]
        return self.total[node] / n + self.cfg.c_uct * math.sqrt(math.log(max(self.visits[parent], 1)) / n)

    def best_child(self, node: tuple) -> tuple:
        best = max(self.below[node], key=lambda child: self.bound(child, node))
        self.told("select", best, self.bound(best, node))
        return best

    def expand(self, node: tuple) -> None:
        names = dict.fromkeys(self.policy.propose(self.state(node), self.cfg.top_k_children + 2))
        priors = {node + (a,): self.score(node + (a,)) for a in names}
        kept = sorted(priors, key=lambda kid: -priors[kid])[: self.cfg.top_k_children]
        if kept:
            self.below[node] = kept
        for kid in kept:
            self.visits[kid], self.total[kid], self.prior[kid] = 0, 0.0, priors[kid]
            self.told("expand", kid, priors[kid])

    def rollout(self) -> tuple[tuple, float]:
        node: tuple = ()
        while node in self.below and "answer" not in node:
            node = self.best_child(node)
        if "answer" not in node and len(node) < self.cfg.max_depth:
            self.expand(node)
            if node in self.below:
                node = self.best_child(node)
        end = node
        while "answer" not in end and len(end) < self.cfg.max_depth:
            step = self.policy.propose(self.state(end), 1)
            if not step:
                break
            end = end + (step[0],)
        if "answer" not in end:
            end = end + ("answer",)
        reward = self.score(end)
        self.told("simulate", end, reward)
        for depth in range(len(node) + 1):
            self.visits[node[:depth]] += 1
            self.total[node[:depth]] += reward
            self.told("backup", node[:depth], self.total[node[:depth]] / self.visits[node[:depth]])
        return end, reward

    def search(self) -> Iterator[tuple[int, tuple, float]]:
        for t in range(self.cfg.rollouts):
            end, reward = self.rollout()
            yield t, end, reward
            if reward >= self.cfg.early_stop_q:
                break


def default_searches(queries: DataFrame) -> Column:
    """The closed set of a query's searches as (name, type): the question itself, its keywords (where the column ``keywords`` says so), its image."""
    one = lambda name, kind: F.struct(F.lit(name).alias("name"), F.lit(kind).alias("type"))
    keywords = F.col("keywords") if "keywords" in queries.columns else F.lit(False)
    return F.array_compact(F.array(one("direct", "text_search"), F.when(keywords, one("keywords", "text_search")), F.when(F.col("has_image"), one("image", "image_search"))))


def _searched(queries: DataFrame, hits: DataFrame, config: SearchConfig, policy, most_hits: int, traced: bool) -> DataFrame:
    key = queries.schema["query_id"].dataType.simpleString()
    few = hits.where(F.col("rank") <= most_hits).select("query_id", F.struct("action", "rank", "title", "text").alias("h"))
    parts = few.groupBy("query_id").agg(F.array_sort(F.collect_list("h")).alias("hits"))
    names = F.col("searches") if "searches" in queries.columns else default_searches(queries)
    rows = queries.select("query_id", "question", names.alias("searches")).join(parts, "query_id", "left")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for r in b.itertuples(index=False):
                found: dict[str, list] = {}
                for h in r.hits if r.hits is not None else []:
                    found.setdefault(h["action"], []).append((h["title"] or "", h["text"] or ""))
                trace: list | None = [] if traced else None
                tree = _Tree(r.question or "", {s["name"]: s["type"] for s in r.searches}, found, config, policy, trace)
                for t, end, reward in tree.search():
                    if traced:
                        out += [(r.query_id, t, i, *event) for i, event in enumerate(trace)]
                        trace.clear()
                    else:
                        out.append((r.query_id, t, ",".join(end), len(end), tree.answer(end), reward))
            yield pd.DataFrame(out, columns=["query_id", "t", "i", "event", "actions", "value"] if traced else ["query_id", "t", "actions", "depth", "answer", "reward"])

    rest = "i int, event string, actions string, value double" if traced else "actions string, depth int, answer string, reward double"
    return rows.mapInPandas(run, f"query_id {key}, t int, {rest}")


def tree_search(queries: DataFrame, hits: DataFrame, config: SearchConfig = SearchConfig(), policy=Rules(), most_hits: int = 50) -> DataFrame:
    """query_id, t, actions, depth, answer, reward of each rollout.

    queries: query_id, question, and searches (array of name and type) or has_image and keywords, from which
    ``default_searches`` makes them; hits: query_id, action (a search's name), rank, title, text, of which those up to rank
    ``most_hits`` count. ``policy`` proposes, answers and scores (see ``Rules``); it is shipped to executors, so a model
    should be loaded when first asked. max_depth bounds search steps: a forced answer may follow.
    """
    return _searched(queries, hits, config, policy, most_hits, False)


def search_trace(queries: DataFrame, hits: DataFrame, config: SearchConfig = SearchConfig(), policy=Rules(), most_hits: int = 50) -> DataFrame:
    """query_id, t, i, event (select, expand, simulate, backup), actions, value of every step of ``tree_search``: the bound
    of a selected node, the prior of a new one, the reward of a simulation, a node's mean after the backup."""
    return _searched(queries, hits, config, policy, most_hits, True)


def trajectories(queries: DataFrame, rollouts: DataFrame, hits: DataFrame) -> DataFrame:
    """Nested rows of rollouts: traj_id, query_id, question, image_path, gold_answers, rollout_t, gen_reward, final_answer,
    outcome_em, and steps with their evidence numbered along the trajectory.

    queries: query_id, question, image_path, gold_answers, searches (array of name, type, query, image_path, region);
    rollouts as of ``tree_search``; hits: query_id, action, rank, doc_id, title, text, image_path, score, modality. A step's
    input is its query or answer, else its type; an image search has its region and its image, or the query's.
    """
    names = F.split("actions", ",")
    q = queries.select("query_id", "question", F.col("image_path").alias("_image"), "gold_answers", "searches")
    steps = rollouts.select("query_id", F.col("t").alias("rollout_t"), F.col("reward").alias("gen_reward"), F.col("answer").alias("final_answer"), F.posexplode(names).alias("step_index", "name")).join(q, "query_id")
    own = F.try_element_at(F.filter("searches", lambda x: x["name"] == F.col("name")), F.lit(1))
    kind = F.when(F.col("name") == "answer", F.lit("answer")).otherwise(own["type"])
    said = F.when(F.col("name") == "answer", F.col("final_answer")).otherwise(F.coalesce(own["query"], kind))
    look = kind == "image_search"
    steps = steps.select(
        "query_id", "question", "_image", "gold_answers", "rollout_t", "gen_reward", "final_answer", "step_index", "name", kind.alias("action_type"), said.alias("action_input"),
        F.when(look, own["region"]).alias("region"), F.when(look, F.coalesce(own["image_path"], F.col("_image"))).alias("step_image"),
    )
    seen = steps.select("query_id", "rollout_t", "step_index", "name").join(hits.withColumnRenamed("action", "name"), ["query_id", "name"])
    along = Window.partitionBy("query_id", "rollout_t").orderBy("step_index", "rank", "doc_id")
    seen = seen.withColumn("evidence_id", F.concat(F.lit("e"), (F.row_number().over(along) - 1).cast("string")))
    one = F.struct("rank", "evidence_id", "doc_id", "title", "text", "image_path", "score", F.col("modality").alias("result_modality"))
    seen = seen.groupBy("query_id", "rollout_t", "step_index").agg(F.array_sort(F.collect_list(one)).alias("evidence"))
    evidence = F.transform(F.coalesce("evidence", F.array().cast(seen.schema["evidence"].dataType)), lambda e: e.dropFields("rank"))
    step = F.struct("step_index", "action_type", "action_input", "region", F.col("step_image").alias("image_path"), evidence.alias("evidence"))
    whole = steps.join(seen, ["query_id", "rollout_t", "step_index"], "left").groupBy("query_id", "rollout_t").agg(
        *[F.first(c).alias(c) for c in ("question", "_image", "gold_answers", "gen_reward", "final_answer")], F.sort_array(F.collect_list(F.struct("step_index", step.alias("s")))).alias("_s")
    )
    return whole.select(
        F.concat(F.col("query_id").cast("string"), F.lit("#t"), F.col("rollout_t").cast("string")).alias("traj_id"), "query_id", "question", F.col("_image").alias("image_path"), "gold_answers",
        "rollout_t", "gen_reward", "final_answer", exact_match(F.coalesce("final_answer", F.lit("")), F.col("gold_answers")).alias("outcome_em"), F.transform("_s", lambda x: x["s"]).alias("steps"),
    )
