"""Duplicates hidden by formatting: an incremental ledger of canonical keys.

The ledger is a folder that any session can open: ``key, copies, keep_id`` and, if
wanted, the values first written, cut into parts by key and each part into buckets.
A batch is aggregated to one row per key (map-side first, so a key that is a third of
the batch costs one row per task), full-outer-joined bucket by bucket with the parts its
keys fall into, and these parts are written anew; the others stay as they lie.  The
ledger side of that join is never shuffled, the batch side shuffles its aggregate only.
A version is a small file that names where each part lies; it is written last.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.runtime import cut, discard, frequency_join, names_in, need, own_table, read_small, scratch, shuffle_width, write_small


def letters_and_digits(c: Column) -> Column:
    """Letters and digits of a text in order, case folded; '' for null and for texts
    without any.  Upper then lower case folds what has more than one lower form ('ς'); 'ß' is 'ss'."""
    folded = F.translate(F.lower(F.upper(F.coalesce(c, F.lit("")))), "ςſ", "σs")
    folded = F.replace(folded, F.lit("ß"), F.lit("ss"))
    return F.regexp_replace(folded, r"[^\p{L}\p{Nd}]+", "")


def unordered_key(columns: Sequence[str]) -> Column:
    """128-bit key of the canonical values, in whichever column each stands.

    Two different value sets share a key with probability below n² / 2^129.
    """
    values = F.array_sort(F.array(*[letters_and_digits(F.col(c)) for c in columns]))
    return F.unhex(F.md5(F.concat_ws("\x1f", values)))


class Ledger:
    """The ledger at ``path`` (a scratch folder if none is given), as it stands there.

    ``kept``: text columns whose first written values it holds.  ``parts`` and
    ``buckets`` are those of the stored ledger where there is one.  One writer at a time.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, *, kept: Sequence[str] = (), parts: int = 16, buckets: int | None = None):
        self.spark, self.path = spark, path or scratch(spark, "ledger")
        self.version, self.places = 0, {}
        self.kept, self.parts, self.buckets = list(kept), parts, buckets or shuffle_width(spark)
        stored = [n for n in names_in(spark, self.path) if n.startswith("version-") and n.endswith(".json")]
        if stored:
            was = json.loads(read_small(spark, f"{self.path}/{max(stored)}"))
            self.version, self.places = was["version"], {int(p): v for p, v in was["places"].items()}
            if kept and list(kept) != was["kept"]:
                raise ValueError(f"this ledger keeps {was['kept']}")
            self.kept, self.parts, self.buckets = was["kept"], was["parts"], was["buckets"]
        self.name = ""
        self._register()

    def _columns(self) -> str:
        values = f", first STRUCT<{', '.join(f'`{c}`: STRING' for c in self.kept)}>" if self.kept else ""
        return f"key BINARY, copies BIGINT, keep_id BIGINT{values}"

    def _register(self) -> None:
        """Show this version's folders to the session as one bucketed table."""
        before, self.name = self.name, own_table(self.spark, f"ledger_{uuid.uuid4().hex}")
        self.spark.sql(
            f"CREATE TABLE {self.name} ({self._columns()}, part INT) USING parquet PARTITIONED BY (part) CLUSTERED BY (key) INTO {self.buckets} BUCKETS LOCATION '{self.path}/none'"
        )
        if self.places:
            self.spark.sql(f"ALTER TABLE {self.name} ADD " + " ".join(f"PARTITION (part = {p}) LOCATION '{self.path}/{v}/part={p}'" for p, v in sorted(self.places.items())))
        if before:
            self.spark.sql(f"DROP TABLE IF EXISTS {before}")

    def entries(self) -> DataFrame:
        """The ledger as it stands; no rows before the first batch."""
        return self.spark.table(self.name).drop("part")

    def add(self, keyed: DataFrame) -> list[int]:
        """Count a batch ``key, id`` (and the kept columns) in: copies add up, the smallest
        id and its values stay.  Gives the parts that were written anew.  ``keyed`` is read
        twice and should be a written table."""
        part = F.pmod(F.xxhash64("key"), F.lit(self.parts)).cast("int")
        values = [F.min_by(F.struct(*[F.col(c).cast("string").alias(c) for c in self.kept]), "id").alias("said")] if self.kept else []
        batch = keyed.groupBy("key").agg(F.count("*").alias("n"), F.min("id").alias("first_id"), *values)
        touched = sorted(r["part"] for r in keyed.select(part.alias("part")).distinct().collect())  # as many as there are parts at most
        if not touched:
            return []
        old = self.spark.table(self.name).where(F.col("part").isin(touched)).drop("part")
        merged = old.join(batch, "key", "full_outer").select(
            "key",
            (F.coalesce("copies", F.lit(0)) + F.coalesce("n", F.lit(0))).alias("copies"),
            F.least("keep_id", "first_id").alias("keep_id"),
            *([F.when(F.col("first_id") < F.coalesce("keep_id", F.lit((1 << 63) - 1)), F.col("said")).otherwise(F.coalesce("first", "said")).alias("first")] if self.kept else []),
            part.alias("part"),
        )
        folder, writing = f"v{self.version + 1}-{uuid.uuid4().hex}", f"ledger_{uuid.uuid4().hex}"
        merged.write.format("parquet").option("path", f"{self.path}/{folder}").partitionBy("part").bucketBy(self.buckets, "key").saveAsTable(writing)
        self.spark.sql(f"DROP TABLE {writing}")  # the files stay
        left = [f"{v}/part={p}" for p, v in self.places.items() if p in touched]
        self.version += 1
        self.places |= {p: folder for p in touched}
        told = {"version": self.version, "places": self.places, "kept": self.kept, "parts": self.parts, "buckets": self.buckets}
        write_small(self.spark, f"{self.path}/version-{self.version:09}.json", json.dumps(told))
        self._register()
        for place in left:  # the new version is whole
            discard(self.spark, f"{self.path}/{place}")
        return touched


def keyed_rows(df: DataFrame, id_col: str, columns: Sequence[str], kept: Sequence[str] = ()) -> DataFrame:
    """``id, key`` of every row, and the ``kept`` columns; others are not read."""
    need(df, id_col, *columns, *kept)
    return df.select(F.col(id_col).cast("bigint").alias("id"), unordered_key(columns).alias("key"), *kept)


def build_ledger(keyed: DataFrame, batches: int = 3, kept: Sequence[str] = (), path: str | None = None) -> Ledger:
    """Feed ``keyed`` to the ledger at ``path`` in ``batches`` runs of ids, as it would have
    arrived.  The result doesn't depend on the number of batches."""
    ledger = Ledger(keyed.sparkSession, path, kept=kept)
    low, high = keyed.agg(F.min("id"), F.max("id")).first()
    if low is None or batches <= 1:
        ledger.add(keyed)
        return ledger
    edges = [low + (high - low + 1) * i // batches for i in range(batches + 1)]
    for i, (a, b) in enumerate(zip(edges, edges[1:])):
        if a < b:
            part = keyed.where((F.col("id") >= a) & (F.col("id") < b))
            ledger.add(keyed.where(F.col("id").isNull() | (F.col("id") < b)) if i == 0 else part)
    return ledger


def duplicate_rows(df: DataFrame, id_col: str, columns: Sequence[str], batches: int = 3) -> DataFrame:
    """Each row that repeats an earlier one: ``keep_row_id, row_id``.

    Rows are equal if their canonical values are equal in whichever column each
    stands.  Null, empty and letterless values are all the same value, so rows of
    nulls only are copies of each other.  A row with a null id counts as a copy and
    comes out with a null ``row_id``; rows repeated under one id come out only if
    that id isn't the kept one.  No rows give no rows.
    """
    keyed = cut(keyed_rows(df, id_col, columns), "keys")
    ledger = build_ledger(keyed, batches)
    repeated = ledger.entries().where("copies > 1")
    copies = frequency_join(keyed, repeated, "key", "copies")
    return copies.select(F.col("keep_id").alias("keep_row_id"), F.col("id").alias("row_id")).where(~F.col("row_id").eqNullSafe(F.col("keep_row_id")))


def distinct_records(df: DataFrame, id_col: str, columns: Sequence[str], batches: int = 3) -> DataFrame:
    """One row per record: ``keep_row_id, copies`` and the columns as first written, all from
    the ledger."""
    keyed = cut(keyed_rows(df, id_col, columns, columns), "keys")
    entries = build_ledger(keyed, batches, columns).entries()
    return entries.select(F.col("keep_id").alias("keep_row_id"), "copies", *[F.col("first")[c].alias(c) for c in columns])
