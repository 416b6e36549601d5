"""Missing records: binary search over ranges against a plain loop."""

import random
from datetime import datetime, timedelta

import numpy as np
from pyspark.sql import functions as F

from quillgraph.operators.orphans import lex_search, number_written, orphan_counts, orphan_references, running_max

DAY = datetime(2025, 1, 1)
REFS = "table_name string, row_id bigint, key bigint, t timestamp"
STAYS = "key bigint, valid_from timestamp, valid_to timestamp, row_id bigint"


def brute(refs, stays):
    out = []
    for table, row, key, t in refs:
        if key is None:
            continue
        ok = t is not None and any(k == key and a is not None and a <= t and (b is None or t < b) for k, a, b, _ in stays)
        if not ok:
            out.append((table, t.strftime("%Y-%m") if t else None, row))
    return sorted(out, key=str)


def test_against_brute_force(spark):
    rng = random.Random(5)
    day = lambda: DAY + timedelta(days=rng.randint(0, 60), seconds=rng.randint(0, 9))
    stays = []
    for i in range(400):
        a = day()
        stays.append((1 if i % 3 == 0 else rng.randint(1, 40), a, rng.choice([None, a, a + timedelta(days=rng.randint(1, 9))]), i))
    stays += [(None, DAY, None, 900), (7, None, None, 901), stays[0]]
    refs = [("a" if i % 2 else "b", i, rng.choice([1, 1, rng.randint(1, 45), None]), rng.choice([day(), day(), None])) for i in range(900)]
    refs += refs[:5]
    got = orphan_references(spark.createDataFrame(refs, REFS), spark.createDataFrame(stays, STAYS), range_rows=16, batch_rows=50)
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(refs, stays)


def test_empty_sides(spark):
    refs = spark.createDataFrame([("a", 1, 5, DAY)], REFS)
    stays = spark.createDataFrame([], STAYS)
    assert [tuple(r) for r in orphan_references(refs, stays).collect()] == [("a", "2025-01", 1)]
    assert orphan_references(refs.where(F.lit(False)), stays).count() == 0


def test_bounds_of_a_stay(spark, rows):
    stays = spark.createDataFrame([(5, DAY, DAY + timedelta(days=1), 1)], STAYS)
    refs = spark.createDataFrame([("a", 1, 5, DAY), ("a", 2, 5, DAY + timedelta(days=1)), ("a", 3, 5, DAY - timedelta(microseconds=1)), ("a", 4, -1, DAY)], REFS)
    found = orphan_references(refs, stays)
    assert [r.row_id for r in found.orderBy("row_id").collect()] == [2, 3, 4]
    assert rows(orphan_counts(found)) == [("a", "2024-12", 1), ("a", "2025-01", 2)]


def test_numbers(spark):
    texts = ["PMC123", " 0123 ", "123.0", "pmc-123;", "PMCID: PMC1,234", "１２３", "none", "", None, "9" * 30]
    df = spark.createDataFrame([(t,) for t in texts], "x string").select(number_written(F.col("x")).alias("n"))
    assert [r.n for r in df.collect()] == [123, 123, 123, 123, 1234, 123, None, None, None, -1]


def test_array_helpers():
    keys, times = np.array([1, 1, 2, 2, 2]), np.array([3, 5, 1, 4, 9])
    assert lex_search(keys, times, np.array([0, 1, 1, 2, 2, 3]), np.array([9, 3, 4, 0, 9, 0])).tolist() == [0, 1, 1, 2, 5, 5]
    assert running_max(np.array([1, 1, 1, 2, 2]), np.array([5, 3, 7, 1, 0])).tolist() == [5, 5, 7, 1, 1]
    assert lex_search(np.array([], int), np.array([], int), np.array([1]), np.array([1])).tolist() == [0]
