"""The ledger of canonical keys against a plain dictionary."""

import random

from pyspark.sql import functions as F

from quillgraph import runtime
from quillgraph.llm.ledger import Ledger, build_ledger, distinct_records, duplicate_rows, keyed_rows

COLS = ["a", "b", "c"]
SHAPE = "id bigint, a string, b string, c string, copies string"


def canon(v):
    return "".join(c for c in (v or "").upper().lower().replace("ς", "σ") if c.isalnum())


def brute(data):
    first, out = {}, []
    for i, *vals in sorted((r[:4] for r in data), key=lambda r: r[0]):
        k = tuple(sorted(map(canon, vals)))
        if k in first and first[k] != i:
            out.append((first[k], i))
        first.setdefault(k, i)
    return sorted(out)


def data(n=600):
    rng = random.Random(2)
    words = ["Status Epilepticus", "status-epilepticus", "GABA β", "gaba Β", "Straße", "STRASSE", "ΟΔΟΣ", "οδος", None, "", "--", "x1", "x​1", "\xa0x 1"]
    out = [(i, rng.choice(words), rng.choice(words), rng.choice(words), "y") for i in range(n)]
    return out + [(n + i, "same", "hot", "row", "y") for i in range(n // 2)]


def test_against_brute_force(spark, rows):
    d = data()
    df = spark.createDataFrame(d, SHAPE)
    for batches in (1, 3):
        assert rows(duplicate_rows(df, "id", COLS, batches).select("keep_row_id", "row_id")) == sorted(brute(d), key=lambda t: tuple((True, str(x)) for x in t))


def test_copies_add_up(spark):
    df = spark.createDataFrame(data(), SHAPE)
    records = distinct_records(df, "id", COLS)
    assert records.agg(F.sum("copies")).first()[0] == df.count()
    assert records.count() == df.count() - duplicate_rows(df, "id", COLS).count()


def test_batches_in_any_number_agree(spark, rows):
    keyed = keyed_rows(spark.createDataFrame(data(90), SHAPE), "id", COLS)
    one, many = (rows(build_ledger(keyed, n).entries().select(F.hex("key"), "copies", "keep_id")) for n in (1, 7))
    assert one == many


def test_empty_and_nulls(spark):
    empty = spark.createDataFrame([], SHAPE)
    assert duplicate_rows(empty, "id", COLS).count() == 0
    nulls = spark.createDataFrame([(1, None, "", "-", None), (2, None, None, None, None), (None, None, None, None, None)], SHAPE)
    assert sorted((r.keep_row_id, str(r.row_id)) for r in duplicate_rows(nulls, "id", COLS).collect()) == [(1, "2"), (1, "None")]


def test_a_ledger_lasts(spark, rows, tmp_path):
    """A second session opens it by its path; a batch reads and writes its own parts only."""
    df = spark.createDataFrame(data(), SHAPE).where("id is not null")
    path = f"{tmp_path}/ledger"
    first, second = df.where("id < 500"), df.where("id >= 500")
    Ledger(spark, path, kept=COLS).add(keyed_rows(first, "id", COLS, COLS))
    other = spark.newSession()
    again = Ledger(other, path)
    assert again.version == 1 and again.kept == COLS
    again.add(keyed_rows(second, "id", COLS, COLS))
    whole = distinct_records(df, "id", COLS)
    got = Ledger(spark, path).entries().select(F.col("keep_id").alias("keep_row_id"), "copies", *[F.col("first")[c].alias(c) for c in COLS])
    assert rows(got) == rows(whole)
    one = spark.createDataFrame([(5000, "quite", "another", "thing", "z")], SHAPE)
    ledger = Ledger(spark, path)
    before = dict(ledger.places)
    touched = ledger.add(keyed_rows(one, "id", COLS, COLS))
    assert len(touched) == 1 and {p for p, v in ledger.places.items() if before.get(p) != v} == set(touched)
    assert "Exchange hashpartitioning(key" not in ledger.entries().where("copies > 1")._jdf.queryExecution().toString()
    assert ledger.entries().count() == whole.count() + 1
    earlier = spark.createDataFrame([(-7, "QUITE", "thing", "a-n-o-t-h-e-r", "z")], SHAPE)
    ledger.add(keyed_rows(earlier, "id", COLS, COLS))
    kept = ledger.entries().where("keep_id = -7").first()
    assert (kept.copies, kept.first.a) == (2, "QUITE")


def test_the_ledger_side_is_not_shuffled(spark, tmp_path):
    ledger = Ledger(spark, f"{tmp_path}/ledger")
    keyed = keyed_rows(spark.createDataFrame(data(), SHAPE), "id", COLS)
    ledger.add(keyed)
    batch = keyed.groupBy("key").count()
    plan = ledger.entries().join(batch, "key", "full_outer")._jdf.queryExecution().executedPlan().toString()
    left = plan[plan.index("SortMergeJoin") :].split("Exchange")[0]
    assert "Bucketed: true" in left or "SelectedBucketsCount" in left


def test_cleanup_drops_tables(spark):
    other = Ledger(spark)
    other.add(keyed_rows(spark.createDataFrame(data(20), SHAPE), "id", COLS))
    mine = dict(runtime._SCRATCH), dict(runtime._TABLES)
    runtime.cleanup(spark)
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("ledger_")] and mine
