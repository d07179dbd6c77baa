"""What the plans of some queries must keep: pruned columns, no products, limits inside windows."""

from __future__ import annotations

import pytest

from quillspark.plans import registry

from .oracle import DATA


def plan(spark, name: str) -> str:
    return registry.QUERIES[name](spark, str(DATA / "sf0.001"))._jdf.queryExecution().executedPlan().toString()


def optimized(spark, name: str) -> str:
    return registry.QUERIES[name](spark, str(DATA / "sf0.001"))._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("name, schema", [("validation_split", "struct<doc_id:bigint>"), ("text_tokens", "struct<doc_id:bigint,text:string>"), ("full_golds", "struct<o_orderkey:bigint,o_orderpriority:string>")])
def test_scans_read_only_what_is_asked(spark, name, schema):
    assert f"ReadSchema: {schema}" in plan(spark, name)


@pytest.mark.parametrize("name", ["bm25_topk", "prefix_credit", "labelled_steps", "quality_filter", "annotated_queries", "unseen_images", "tree_backup", "best_children", "scene_documents", "bm25_grounded", "hybrid_topk", "evidence_ids"])
def test_no_products(spark, name):
    assert not any(x in plan(spark, name) for x in ("CartesianProduct", "NestedLoop"))


@pytest.mark.parametrize("name", ["bm25_topk", "vector_topk", "kept_children"])
def test_top_k_is_limited_before_the_shuffle(spark, name):
    assert "WindowGroupLimit" in plan(spark, name)


@pytest.mark.parametrize("name", ["text_tokens", "answer_metrics", "fused_scores", "labelled_steps", "rationale_checks", "quality_filter", "best_rollouts"])
def test_relational_queries_stay_in_the_jvm(spark, name):
    assert not any(x in plan(spark, name) for x in ("Python", "Pandas", "Arrow"))


def test_filters_reach_the_scan(spark):
    assert "PushedFilters: [IsNotNull(p_size), GreaterThan(p_size,25)" in plan(spark, "wanted_images").replace("[IsNotNull(p_partkey), ", "[").replace(", IsNotNull(p_partkey)", "")


@pytest.mark.parametrize("name", ["gated_proposals"])
def test_texts_are_searched_for_words_once(spark, name):
    """By the proposals, and by the searches taken before."""
    words = optimized(spark, name).count("regexp_extract_all(")
    assert 0 < words <= 2


def test_replies_are_parsed_once(spark):
    plan = optimized(spark, "policy_proposals")
    assert plan.count("from_json(") == 1 and 0 < plan.count("regexp_extract_all(") <= 3
