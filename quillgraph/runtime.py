"""Session-level helpers: table access and the shared work folder."""

from __future__ import annotations

import gc
import os
import tempfile
import time
import uuid
import zipfile
from collections.abc import Iterable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_LOCAL_WORK: dict[str, str] = {}
_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give the package to the executors' Python workers, once per application."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    _SHIPPED.add(app)
    here = Path(__file__).resolve().parent
    if not here.is_dir():  # this is the shipped copy itself
        return
    fd, name = tempfile.mkstemp(prefix="quillgraph-", suffix=".zip")
    with os.fdopen(fd, "wb") as f, zipfile.ZipFile(f, "w") as z:
        for p in sorted(here.rglob("*.py")):
            z.write(p, p.relative_to(here.parent))
    spark.sparkContext.addPyFile(name)


def table(spark: SparkSession, sf_dir: str, name: str, columns: Iterable[str] | None = None, spread: bool = False) -> DataFrame:
    """Read one Parquet table of a data folder, pruned to ``columns`` if given; for work that
    costs much a row, ``spread`` over the cores."""
    ship(spark)
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    df = df.select(*columns) if columns else df
    return over_cores(df) if spread else df


#: Tasks that rows of one scan task are spread over at most.
SPREAD_TASKS = 64


def over_cores(df: DataFrame) -> DataFrame:
    """``df`` of a scan, its rows dealt out where a few small files would leave half of the
    cores idle.  A table of as many scan tasks as cores, so any large one, stays as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    tasks = df._jdf.queryExecution().toRdd().getNumPartitions()
    return df.repartition(min(cores, SPREAD_TASKS * max(1, tasks))) if 2 * tasks <= cores else df


def work_root(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``.

    Only where a session on one machine has none (unit tests) a temporary folder is
    made and set; on a cluster, which must name its own, this raises.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL_WORK:
        _LOCAL_WORK[app] = tempfile.mkdtemp(prefix="quillgraph-")
        spark.sparkContext.setCheckpointDir(_LOCAL_WORK[app])
    return _LOCAL_WORK[app]


_SCRATCH: dict[str, list[str]] = {}


def scratch(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared work folder."""
    path = f"{work_root(spark)}/{label}-{uuid.uuid4().hex}"
    _SCRATCH.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


_TABLES: dict[str, list[str]] = {}


def own_table(spark: SparkSession, name: str) -> str:
    """Note a catalogue table that ``cleanup`` is to drop."""
    _TABLES.setdefault(spark.sparkContext.applicationId, []).append(name)
    return name


def cleanup(spark: SparkSession) -> int:
    """Delete what this application wrote below the shared folder, and drop its tables;
    gives the number of paths.  For a session that goes on after its results are stored."""
    for name in _TABLES.pop(spark.sparkContext.applicationId, []):
        spark.sql(f"DROP TABLE IF EXISTS {name}")
    paths = _SCRATCH.pop(spark.sparkContext.applicationId, [])
    for path in paths:
        discard(spark, path)
    return len(paths)


def cut(df: DataFrame, label: str, path: str | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends here and
    a lost executor costs only the tasks that read the files again."""
    path = path or scratch(df.sparkSession, label)
    df.write.mode("overwrite").parquet(path)
    release(df.sparkSession)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Seconds between two rounds of ``release`` at least, and the share of the driver's heap in use from which it doesn't wait.
RELEASE_S, RELEASE_SHARE = 3, 0.25
_RELEASED: dict[str, float] = {}


def release(spark: SparkSession) -> None:
    """Let go of plans that are done and of their shuffle files.  Spark deletes these when the
    driver's garbage is collected, which a quiet driver does every half hour only; one that plans
    many short jobs lets its heap grow instead, and doesn't give it back soon."""
    app, now = spark.sparkContext.applicationId, time.monotonic()
    heap = spark.sparkContext._jvm.java.lang.Runtime.getRuntime()
    if now - _RELEASED.get(app, -RELEASE_S) >= RELEASE_S or heap.totalMemory() - heap.freeMemory() > RELEASE_SHARE * heap.maxMemory():
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        _RELEASED[app] = time.monotonic()


def shuffle_width(spark: SparkSession) -> int:
    """Number of shuffle partitions of the session."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def files(spark: SparkSession, path: str):
    """The Hadoop file system of a path, and the path."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def discard(spark: SparkSession, path: str) -> None:
    """Delete a folder that nothing reads any more."""
    fs, p = files(spark, path)
    fs.delete(p, True)


def names_in(spark: SparkSession, path: str) -> list[str]:
    """Names of what lies in a folder; none if it isn't there."""
    fs, p = files(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


def write_small(spark: SparkSession, path: str, text: str) -> None:
    """A small text file, there as a whole or not at all."""
    fs, p = files(spark, path + ".part")
    out = fs.create(p, True)
    out.write(bytearray(text.encode("utf-8")))
    out.close()
    fs.rename(p, files(spark, path)[1])


def read_small(spark: SparkSession, path: str) -> str:
    return spark.read.option("wholetext", True).text(path).first()[0]


def need(df: DataFrame, *columns: str) -> DataFrame:
    """Raise a clear error where a required column is missing."""
    gone = [c for c in columns if c not in df.columns]
    if gone:
        raise ValueError(f"missing columns: {', '.join(gone)}; there are {', '.join(df.columns)}")
    return df


def blank(c) -> F.Column:
    """True for null and for text of white space only (no-break ones too)."""
    return F.coalesce(~F.col(c).rlike(r"(?U)\S") if isinstance(c, str) else ~c.rlike(r"(?U)\S"), F.lit(True))


#: Keys broadcast by ``frequency_join``: a hot key holds 1/HOT_KEYS of all rows or more.
HOT_KEYS = 4096


def frequency_join(rows: DataFrame, lookup: DataFrame, key: str, occurrences: str) -> DataFrame:
    """Inner join with a lookup of unique keys that knows how often each occurs.

    Keys with 1/HOT_KEYS of all occurrences or more (so HOT_KEYS of them at most)
    are broadcast and their rows never shuffled; the other keys are joined by
    shuffle and are small.  ``lookup`` is read twice and should be a written table.
    """
    total = lookup.agg(F.sum(occurrences)).first()[0] or 0
    hot_from = max(1024, -(-total // HOT_KEYS))
    hot = lookup.where(F.col(occurrences) >= hot_from).withColumn("__hot", F.lit(True))
    cold = lookup.where(F.col(occurrences) < hot_from)
    tagged = rows.join(F.broadcast(hot), key, "left")
    of_cold = tagged.where("__hot is null").select(*rows.columns).join(cold, key)
    return tagged.where("__hot").drop("__hot").unionByName(of_cold)
