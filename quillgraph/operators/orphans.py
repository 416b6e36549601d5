"""References to records that are not there: range-partitioned binary search.

Parents are stays ``(key, from, to)`` of records in a store; a reference
``(key, t)`` is an orphan if no stay of its key covers ``t``.

* Parent stays are cut into ranges of the composite ``(key, from)``, each about
  ``range_rows`` long, so one key with very many stays spans several ranges.
* Inside a range the stays are sorted arrays with a running maximum of ``to``
  per key; what earlier ranges hold of a range's first key is carried in as one
  number.  A reference is then covered exactly if the last stay at or before
  ``(key, t)`` has a running maximum above ``t``.
* References are written once with their range, counted per range, and ranges
  with many references are cut into ``batch_rows`` pieces over which the
  (bounded) parent arrays are repeated: a hot key never makes a hot task.
* Each piece is one Arrow batch probed by vectorised binary search.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgraph.runtime import cut, need

FOREVER = np.iinfo(np.int64).max
BEFORE_ALL = np.iinfo(np.int64).min
MAX_RANGES = 32_768
# Digits of other scripts and their ASCII forms.
OTHER_DIGITS = "０１２３４５６７８９٠١٢٣٤٥٦٧٨٩۰۱۲۳۴۵۶۷۸۹"
ASCII_DIGITS = "0123456789" * 3


def number_written(c: Column) -> Column:
    """The whole number that a text writes in whatever form ('PMC0123', '123.0',
    'PMCID: 1,234'), as BIGINT.  Null and texts without a digit give null; a
    number beyond BIGINT gives -1, which no record has."""
    ascii_ = F.translate(c, OTHER_DIGITS, ASCII_DIGITS)
    joined = F.regexp_replace(ascii_, r"(?<=[0-9]),(?=[0-9]{3}(?![0-9]))", "")
    digits = F.regexp_extract(joined, r"([0-9]+)", 1)
    return F.when(digits != "", F.coalesce(digits.try_cast("bigint"), F.lit(-1).cast("bigint")))


def wall_micros(name: str) -> Column:
    """Microseconds of a timestamp's wall clock since 1970, whatever the session's
    time zone; for ``TIMESTAMP`` the wall clock is the session's."""
    c = F.col(name).cast("timestamp_ntz")
    second = F.expr(f"cast(extract(SECOND FROM cast({name} as timestamp_ntz)) * 1000000 as bigint)")
    day = F.unix_date(c.cast("date")).cast("bigint")
    return ((day * 24 + F.hour(c)) * 60 + F.minute(c)) * 60_000_000 + second


def lex_search(keys: np.ndarray, times: np.ndarray, k: np.ndarray, t: np.ndarray) -> np.ndarray:
    """For each (k, t): how many of the sorted pairs (keys, times) are <= it."""
    low = np.searchsorted(keys, k, "left")
    high = np.searchsorted(keys, k, "right")
    while True:
        open_ = low < high
        if not open_.any():
            return low
        mid = (low + high) // 2
        at = np.minimum(mid, max(len(keys) - 1, 0))
        below = open_ & (times[at] <= t)
        low = np.where(below, mid + 1, low)
        high = np.where(open_ & ~below, mid, high)


def _bounds(parents: DataFrame, range_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Lower bounds of all ranges but the first, from a bounded sample: some 20 rows a range,
    40 x MAX_RANGES at most, reach the driver.  Bounds only balance the work: above
    MAX_RANGES x ``range_rows`` stays (2.1 billion) ranges, and their arrays, grow."""
    n = parents.count()
    ranges = int(min(MAX_RANGES, max(1, -(-n // range_rows))))
    if ranges == 1:
        return np.array([], np.int64), np.array([], np.int64)
    share = min(1.0, 20.0 * ranges / n)
    s = parents.sample(False, share, seed=7).select("key", "t0").limit(40 * MAX_RANGES).toPandas().sort_values(["key", "t0"])
    at = np.linspace(0, len(s), ranges + 1)[1:-1].astype(int)
    b = s.iloc[at].drop_duplicates() if len(s) else s
    return b["key"].to_numpy(np.int64), b["t0"].to_numpy(np.int64)


def orphan_references(
    refs: DataFrame, parents: DataFrame, *, range_rows: int = 65_536, batch_rows: int = 200_000
) -> DataFrame:
    """Rows of ``refs`` whose key has no stay in ``parents`` at their time.

    ``refs``: ``table_name STRING, row_id BIGINT, key BIGINT, t TIMESTAMP``;
    ``parents``: ``key BIGINT, valid_from TIMESTAMP, valid_to TIMESTAMP`` (null
    ``valid_to``: still there).  Gives ``table_name, period 'yyyy-MM', row_id``.

    A null key refers to nothing and is no orphan.  A null time is covered by no
    stay, so the row comes out with a null period.  Stays without key or start
    are ignored; with no stays at all every reference is an orphan.  Repeated
    references come out as often as they are there.
    """
    need(refs, "table_name", "row_id", "key", "t")
    need(parents, "key", "valid_from", "valid_to")
    stays = cut(
        parents.where("key is not null and valid_from is not null")
        .select(
            F.col("key").cast("bigint"),
            wall_micros("valid_from").alias("t0"),
            F.coalesce(wall_micros("valid_to"), F.lit(int(FOREVER))).alias("t1"),
        )
        .groupBy("key", "t0")
        .agg(F.max("t1").alias("t1")),
        "stays",
    )
    bk, bt = _bounds(stays, range_rows)

    @F.pandas_udf("int")
    def range_of(k: pd.Series, t: pd.Series) -> pd.Series:
        return pd.Series(lex_search(bk, bt, k.to_numpy(np.int64), t.to_numpy(np.int64)).astype(np.int32))

    stays = stays.withColumn("rng", range_of("key", "t0"))
    carry = _carry(stays, bk)
    placed = cut(
        refs.where("key is not null").select(
            "table_name",
            "row_id",
            F.col("key").cast("bigint"),
            F.coalesce(wall_micros("t"), F.lit(int(BEFORE_ALL))).alias("t"),
        ).withColumn("rng", range_of("key", "t")),
        "refs",
    )
    # MAX_RANGES rows at most: one broadcast for both sides
    pieces = F.broadcast(cut(placed.groupBy("rng").agg(F.ceil(F.count("*") / batch_rows).cast("int").alias("pieces")), "pieces"))
    left = placed.join(pieces, "rng").withColumn("piece", F.pmod(F.xxhash64("row_id", "table_name"), F.col("pieces")).cast("int")).drop("pieces")
    right = stays.join(pieces, "rng").withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1))).drop("pieces")

    def probe(group: tuple, ref: pa.Table, par: pa.Table) -> pa.Table:
        k, t = ref["key"].to_numpy(), ref["t"].to_numpy()
        ck, cm = carry.get(int(group[0].as_py()), (None, BEFORE_ALL))
        reach = np.full(len(k), BEFORE_ALL)
        if par.num_rows:
            par = par.sort_by([("key", "ascending"), ("t0", "ascending")])
            pk, p0, p1 = par["key"].to_numpy(), par["t0"].to_numpy(), par["t1"].to_numpy()
            best = running_max(pk, p1)
            at = lex_search(pk, p0, k, t) - 1
            safe = np.maximum(at, 0)
            hit = (at >= 0) & (pk[safe] == k)
            reach[hit] = best[safe[hit]]
        if ck is not None:
            reach = np.where(k == ck, np.maximum(reach, cm), reach)
        miss = reach <= t
        out = ref.filter(pa.array(miss))
        when = out["t"].to_numpy()
        period = pd.Series(when.astype("datetime64[us]")).dt.strftime("%Y-%m").where(when != BEFORE_ALL, None)
        return pa.table({"table_name": out["table_name"], "period": pa.array(period, pa.string(), from_pandas=True), "row_id": out["row_id"]})

    return (
        left.groupBy("rng", "piece")
        .cogroup(right.groupBy("rng", "piece"))
        .applyInArrow(probe, "table_name string, period string, row_id bigint")
    )


def running_max(keys: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Running maximum of ``ends`` within each run of equal ``keys``."""
    if not len(keys):
        return ends
    start = np.r_[True, keys[1:] != keys[:-1]]
    run = np.cumsum(start)
    if start.all():
        return ends
    order = np.argsort(ends, kind="stable")
    rank = np.empty(len(ends), np.int64)
    rank[order] = np.arange(len(ends))
    top = np.maximum.accumulate(run * len(ends) + rank) - run * len(ends)
    return ends[order[top]]


def _carry(stays: DataFrame, bk: np.ndarray) -> dict[int, tuple[int, int]]:
    """For each range: its first key and the latest end that earlier ranges hold
    of it.  Only keys at a bound count, so at most 2 x MAX_RANGES rows come back."""
    if not len(bk):
        return {}
    spark = stays.sparkSession
    edge = spark.createDataFrame([(int(k),) for k in sorted(set(bk.tolist()))], "key bigint")
    found = stays.join(F.broadcast(edge), "key").groupBy("key", "rng").agg(F.max("t1").alias("t1")).collect()
    ends: dict[int, list[tuple[int, int]]] = {}
    for r in found:
        ends.setdefault(r["key"], []).append((r["rng"], r["t1"]))
    out = {}
    for i, k in enumerate(bk.tolist(), start=1):
        before = [t1 for rng, t1 in ends.get(k, []) if rng < i]
        if before:
            out[i] = (k, max(before))
    return out


def orphan_counts(orphans: DataFrame) -> DataFrame:
    """Orphans per table and month: ``table_name, period, orphans``."""
    return orphans.groupBy("table_name", "period").agg(F.count("*").alias("orphans"))
