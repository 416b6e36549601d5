"""Writers: delta appends, snapshots, delimited exports."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from datetime import datetime, timezone

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.operators.triples import delta
from quillgraph.runtime import discard, write_small


def append_new(new: DataFrame, path: str, keys: Sequence[str], order: str) -> None:
    """Append the rows of ``new`` that the table at ``path`` doesn't have; by name."""
    spark = new.sparkSession
    old = spark.read.parquet(path)
    delta(new, old, keys, order).select(*old.columns).write.mode("append").parquet(path)


def write_snapshot(df: DataFrame, root: str, version: str) -> str:
    """Write a whole snapshot beside the others; a reader sees it when it is complete."""
    path = f"{root}/version={version}"
    df.write.mode("overwrite").parquet(path)
    return path


def drop_snapshot(df: DataFrame, root: str, version: str) -> None:
    discard(df.sparkSession, f"{root}/version={version}")


def write_tsv(df: DataFrame, path: str) -> None:
    """Tab-separated text with a header, one file a partition."""
    df.write.mode("overwrite").option("sep", "\t").option("header", True).csv(path)


def write_csv(df: DataFrame, path: str, one_line: Sequence[str] = ()) -> None:
    """CSV with a header; line breaks in the ``one_line`` columns become spaces."""
    flat = {c: F.regexp_replace(c, r"\s*[\r\n]+\s*", " ") for c in one_line}
    df.withColumns(flat).write.mode("overwrite").option("header", True).option("quote", '"').option("escape", '"').csv(path)


def write_record(spark, record: Mapping[str, object], path: str, by: str = "") -> dict:
    """A small settings record as one JSON file, with who wrote it and when; there as a
    whole or not at all."""
    told = dict(record) | {"updated_at": datetime.now(timezone.utc).isoformat(), "updated_by": by}
    discard(spark, path)
    write_small(spark, path, json.dumps(told, indent=2))
    return told
