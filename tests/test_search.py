"""The state machine against a plain search written for this test: nodes as objects, states as lists."""

from __future__ import annotations

import math
import random
import re

import pytest
from pyspark.sql import functions as F

from quillspark.operators import search as M


class Node:
    def __init__(self, state, prior=0.0, parent=None):
        self.state, self.prior, self.parent = state, prior, parent
        self.kids, self.n, self.w = [], 0, 0.0


class Plain:
    def __init__(self, hits, image, cfg):
        self.hits, self.image, self.cfg = hits, image, cfg
        self.root = Node([])

    def docs(self, state):
        return [d for a in state if a != "answer" for d in self.hits.get(a, [])]

    def options(self, state, k):
        found = ["direct"] if "direct" not in state else []
        if "keywords" in self.hits and "keywords" not in state:
            found.append("keywords")
        if self.image and "image" not in state:
            found.append("image")
        if len(found) < k and (self.docs(state) or not found):
            found.append("answer")
        return found[:k]

    def answer(self, state):
        for t, x in self.docs(state):
            caps = re.findall(r"\b[A-Z][a-zA-Z]+\b", f"{t}: {x}" if t else x)
            if caps:
                return caps[-1]
        return "unknown"

    def value(self, state):
        if not state or state[-1] != "answer":
            return 0.0
        per = [" | ".join(f"{t}: {x}" if t else x for t, x in self.hits.get(a, [])) for a in state[:-1]] + [""]
        seen = " ".join(per).lower()
        words = self.answer(state[:-1]).lower().split()
        return min(1.0, (0.2 if seen.strip() else 0) + 0.8 * sum(w in seen for w in words) / len(words))

    def pick(self, node):
        def u(k):
            return 1e6 + k.prior if k.n == 0 else k.w / k.n + self.cfg.c_uct * math.sqrt(math.log(max(node.n, 1)) / k.n)

        best = node.kids[0]
        for k in node.kids[1:]:
            if u(k) > u(best):
                best = k
        return best

    def run(self):
        log = []
        for t in range(self.cfg.rollouts):
            node = self.root
            while node.kids and node.state[-1:] != ["answer"]:
                node = self.pick(node)
            if node.state[-1:] != ["answer"] and len(node.state) < self.cfg.max_depth:
                kids = [Node(node.state + [a], self.value(node.state + [a]), node) for a in self.options(node.state, self.cfg.top_k_children + 2)]
                kids.sort(key=lambda k: k.prior, reverse=True)
                node.kids = kids[: self.cfg.top_k_children]
                node = self.pick(node) if node.kids else node
            s = list(node.state)
            while s[-1:] != ["answer"] and len(s) < self.cfg.max_depth:
                s += self.options(s, 1)
            if s[-1:] != ["answer"]:
                s.append("answer")
            r = self.value(s)
            up = node
            while up:
                up.n, up.w, up = up.n + 1, up.w + r, up.parent
            log.append((t, ",".join(s), len(s), self.answer(s[:-1]), r))
            if r >= self.cfg.early_stop_q:
                break
        return log


@pytest.mark.parametrize("stop", [0.9, 2.0])
def test_rollouts_agree_with_plain_search(spark, stop):
    rng = random.Random(4)
    cfg = M.SearchConfig(rollouts=8, early_stop_q=stop)
    words = ["Rome", "old", "Paris", "tower", "of", "Big", "x"]
    queries, hits, expected = [], [], []
    for q in range(25):
        image, keywords = rng.random() < 0.5, rng.random() < 0.6
        own = {"keywords": []} if keywords else {}
        for a in ("direct", "keywords", "image"):
            if (a == "keywords" and not keywords) or (a == "image" and not image):
                continue
            for r in range(rng.randrange(0, 3)):
                d = (rng.choice(["", "Title", "note"]), " ".join(rng.choices(words, k=3)))
                own.setdefault(a, []).append(d)
                hits.append((q, a, r + 1, *d))
        queries.append((q, "question", image, keywords))
        expected += [(q, *row) for row in Plain(own, image, cfg).run()]
    found = M.tree_search(spark.createDataFrame(queries, "query_id long, question string, has_image boolean, keywords boolean"), spark.createDataFrame(hits, "query_id long, action string, rank int, title string, text string"), cfg)
    got = sorted((r["query_id"], r["t"], r["actions"], r["depth"], r["answer"], r["reward"]) for r in found.collect())
    assert len(got) == len(expected)
    for g, e in zip(got, sorted(expected)):
        assert g[:5] == e[:5] and g[5] == pytest.approx(e[5])


def test_config():
    assert M.SearchConfig.from_dict({"search": {"rollouts": 3, "seed": 1}}) == M.SearchConfig(rollouts=3)
    assert M.SearchConfig.from_dict(None) == M.SearchConfig()


def test_visits_of_the_root_are_the_rollouts(spark):
    leaves = spark.createDataFrame([(1, ["a", "b"], 1.0), (1, ["a"], 0.0), (1, [], 0.5)], "query_id int, path array<string>, reward double")
    rows = {tuple(r["path"]): (r["visits"], r["total"]) for r in M.backed_up(leaves).collect()}
    assert rows == {(): (3, 1.5), ("a",): (2, 1.0), ("a", "b"): (1, 1.0)}


class Counting(M.Rules):
    """A policy of the caller's own: searches in reverse, answers by how many hits it saw, fewer being better."""

    def propose(self, state, k):
        new = [n for n in reversed(list(state.searches)) if n not in state.taken]
        return (new or ["answer"])[:k]

    def answer(self, state):
        return str(sum(map(len, state.evidence)))

    def score(self, state, answer):
        return 0.0 if answer is None else 1 / (1 + int(answer))


def test_policies_plug_in(spark):
    queries = spark.createDataFrame([(1, "q", [("a", "text_search"), ("b", "image_search")])], "query_id int, question string, searches array<struct<name:string,type:string>>")
    hits = spark.createDataFrame([(1, "a", r, "", "x") for r in (1, 2)] + [(1, "b", 1, "", "y")], "query_id int, action string, rank int, title string, text string")
    cfg = M.SearchConfig(rollouts=3, early_stop_q=2.0)
    got = [(r["actions"], r["answer"], r["reward"]) for r in M.tree_search(queries, hits, cfg, Counting()).orderBy("t").collect()]
    assert got[0] == ("b,a,answer", "3", 0.25) and all(g[0].endswith("answer") for g in got)
    kept = [r["actions"] for r in M.tree_search(queries, hits, cfg, M.Gated(Counting(), "science-qa")).collect()]
    assert all("b" not in k for k in kept) and any("b" in r["actions"] for r in M.tree_search(queries, hits, cfg, M.Gated(Counting(), "science-qa", "off")).collect())
    assert M.tree_search(queries, hits, cfg, Counting(), most_hits=1).where("answer = '2'").count() > 0
    trace = M.search_trace(queries, hits, cfg, Counting()).orderBy("t", "i").collect()
    assert [r["event"] for r in trace if r["t"] == 0][:2] == ["expand", "expand"] and {r["event"] for r in trace} == {"expand", "select", "simulate", "backup"}
    root = [r["value"] for r in trace if r["event"] == "backup" and r["actions"] == ""]
    assert len(root) == 3 and root[0] == 0.25
    # of the first actions, one is the rollout's own
    firsts = {r["actions"].split(",")[0] for r in trace if r["event"] == "simulate"}
    assert firsts <= {"a", "b"}


def test_gates_agree_with_the_column_form(spark):
    rng = random.Random(5)
    asked = ["Identify this bird", "the expected ratio of this bird", "Where is Rome?"]
    for benchmark in ("", "infoseek", "ScienceQA", "mragbench", "crag-mm"):
        for mode in ("dataset", "heuristic", "strict", "off"):
            q, image, evidence = rng.choice(asked), rng.random() < 0.7, rng.random() < 0.5
            names = {"t": "text_search", "u": "text_search", **({"i": "image_search"} if image else {})}
            state = M.State(q, names, ("t",) if evidence else (), (((("", "x")),),) if evidence else ())
            mine = M.Gated(M.Rules(), benchmark, mode, most=3).propose(state, 4)
            said = M.Rules().propose(state, M.asked_actions(4, 3))
            raw = F.array(*[M.action("answer" if n == "answer" else names[n], F.lit(n), F.lit(n)) for n in said])
            gate = M.gated_actions(raw, F.lit(q), F.lit(image), F.lit(evidence), 4, benchmark, mode, 3)
            theirs = spark.range(1).select(F.transform(gate, lambda a: a["query"]).alias("a")).first()["a"]
            assert mine == theirs
    assert [M.asked_actions(k, m) for k, m in ((1, 9), (2, None), (8, 3), (4, 7))] == [1, 6, 8, 7]
