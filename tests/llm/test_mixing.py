"""Mixing: weights, budgets, repeats."""

import math
import os

import pytest
from pyspark.sql import functions as F

from quillgraph.llm import registry
from quillgraph.llm.mixing import bisect, entropy_exponent, mix_sources, plan_mix

DOCS = "doc_id bigint, source string, n_tokens bigint, weight double"
GOALS = "source string, target_share double, max_repeats int"


def docs(spark):
    rows = [(i, "Big ", 100 + i % 7, 1.0) for i in range(3000)] + [(10_000 + i, "small", 90 + i % 11, 1.0) for i in range(200)] + [(20_000 + i, None, 50, 1.0) for i in range(50)]
    rows += [(30_000, "big", 0, 1.0), (30_001, "small", None, 1.0), (30_002, "other", 10, 1.0)]
    return spark.createDataFrame(rows, DOCS)


def test_targets_are_met(spark):
    goals = spark.createDataFrame([("big", 0.7, 1), ("small", 0.2, 4), ("absent", 0.1, 3)], GOALS)
    mix, report = mix_sources(docs(spark), goals, block_tokens=20_000)
    r = {x.source: x for x in report.collect()}
    assert abs(r["small"].actual_share - 2 / 9) < 0.005 and abs(r["big"].actual_share - 7 / 9) < 0.005
    assert r["small"].most_copies <= 4 and r["big"].most_copies == 1
    assert r["absent"].tokens_used == 0 and r[""].tokens_used == 0 and r["other"].tokens_used == 0
    assert mix.groupBy("doc_id", "copy").count().where("count > 1").count() == 0
    assert mix.where("n_tokens = 0").count() == 0
    shares = mix.groupBy("block").agg((F.sum(F.when(F.col("source") == "small", F.col("n_tokens")).otherwise(0)) / F.sum("n_tokens")).alias("s")).collect()
    assert all(abs(x.s - 2 / 9) < 0.08 for x in shares)


def test_too_large_a_total_lowers_the_exponent(spark):
    goals = spark.createDataFrame([("big", 0.1, 1), ("small", 0.9, 2)], GOALS)
    mix, report = mix_sources(docs(spark), goals, total_tokens=200_000)
    r = {x.source: x for x in report.collect()}
    assert r["small"].exponent < 1 and r["small"].most_copies <= 2
    assert r["small"].tokens_used <= 2 * r["small"].tokens
    assert abs(mix.agg(F.sum("n_tokens")).first()[0] - 200_000) < 300


@pytest.mark.parametrize("step_bits", [0, 2, 10])
def test_budgets_to_within_a_document(spark, step_bits):
    """Whatever the steps, each source comes to its budget, whole passes hold every document
    once, and a permutation is taken from its start."""
    goals = spark.createDataFrame([("big", 0.4, 1), ("small", 0.6, 3)], GOALS)
    mix, report = mix_sources(docs(spark), goals, total_tokens=75_000, step_bits=step_bits)
    rows, r = mix.collect(), {x.source: x for x in report.collect()}
    assert all(abs(r[s].tokens_used - r[s].weight * 75_000) <= 107 for s in ("big", "small"))
    small = [x for x in rows if x.source == "small"]
    full = r["small"].tokens_used // r["small"].tokens
    assert full == 2 and all(sum(x.copy == k + 1 for x in small) == 200 for k in range(full))
    assert len({(x.doc_id, x.copy) for x in rows}) == len(rows)


def test_documents_are_not_shuffled(spark):
    """Only sizes are: a document meets broadcast tables."""
    goals = spark.createDataFrame([("big", 0.4, 1), ("small", 0.6, 3)], GOALS)
    mix, _ = mix_sources(docs(spark), goals, total_tokens=75_000)
    assert "Exchange" not in mix._jdf.queryExecution().executedPlan().toString()


def test_plan():
    w, total, x = plan_mix({"a": 100, "b": 900}, {"a": (0.5, 2), "b": (0.5, 1)})
    assert x == 1.0 and total == 400 and w == {"a": 0.5, "b": 0.5}
    w, total, _ = plan_mix({"a": 100, "b": 900}, {"a": (0.5, 2), "b": (0.5, 1)}, 10_000)
    assert total == 1100 and math.isclose(sum(w.values()), 1)
    assert plan_mix({}, {"a": (1.0, 1)}) == ({}, 0.0, 1.0)


def test_entropy():
    q = {"a": 0.9, "b": 0.1}
    assert entropy_exponent(q, 10.0) == 0.0
    x = entropy_exponent(q, 0.5)
    w = {s: v**x for s, v in q.items()}
    z = sum(w.values())
    assert math.isclose(-sum(v / z * math.log(v / z) for v in w.values()), 0.5, abs_tol=1e-6)
    assert bisect(lambda v: v <= 0.25, 0, 1) == pytest.approx(0.25)


def test_mix_to_an_entropy(spark):
    goals = spark.createDataFrame([("big", 0.1, 1), ("small", 0.9, 4)], GOALS)
    mix, report = mix_sources(docs(spark), goals, entropy=0.5)
    r = {x.source: x for x in report.collect()}
    share = r["small"].actual_share
    assert abs(-share * math.log(share) - (1 - share) * math.log(1 - share) - 0.5) < 0.01
    assert 0 < r["small"].exponent < 1 and r["small"].most_copies <= 4 and r["big"].most_copies == 1
    w, total, _ = plan_mix({"a": 100, "b": 900}, {"a": (0.5, 1), "b": (0.5, 1)}, 1000, entropy=10.0)
    assert total == 1000 and math.isclose(w["a"], 0.1) and math.isclose(w["b"], 0.9)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables here")
def test_half_mix_needs_an_exponent(spark):
    r = registry.QUERIES["p7_half_report"](spark, "/root/testdata/sf0.001").collect()
    assert all(0 < x.exponent < 1 for x in r) and all(x.tokens_used <= x.max_repeats * x.tokens for x in r)
    least = registry.QUERIES["p7_report"](spark, "/root/testdata/sf0.001").collect()
    assert sum(x.tokens_used for x in r) > sum(x.tokens_used for x in least)


def test_empty(spark):
    goals = spark.createDataFrame([("big", 1.0, 1)], GOALS)
    mix, report = mix_sources(spark.createDataFrame([], DOCS), goals)
    assert mix.count() == 0 and [x.tokens_used for x in report.collect()] == [0]
    mix, report = mix_sources(docs(spark), spark.createDataFrame([], GOALS))
    assert mix.count() == 0 and all(x.tokens_used == 0 for x in report.collect())
