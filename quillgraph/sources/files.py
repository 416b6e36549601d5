"""Readers of the formats at the engine's edge; everything inside is Parquet."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as S

from quillgraph.runtime import need


def _strings(columns: Sequence[str]) -> S.StructType:
    return S.StructType([S.StructField(c, S.StringType()) for c in columns])


def read_csv(spark: SparkSession, path: str, columns: Sequence[str], encoding: str | None = None, sep: str = ",") -> DataFrame:
    """Delimited text with a header, all columns text, null as ''.

    Raises if a column isn't in the header.  The schema is given, so nothing is scanned
    to infer it.  Without an ``encoding`` the files are read once to see whether all are
    UTF-8; if not they are taken for Windows-1252, else Latin-1.
    """
    if encoding is None:
        valid = spark.read.format("binaryFile").load(path).agg(F.bool_and(F.expr("is_valid_utf8(cast(content as string))"))).first()[0]
        if valid is False:
            old = read_csv(spark, path, columns, "ISO-8859-1", sep)
            return old.select(*[windows_letters(F.col(c)).alias(c) for c in columns])
        encoding = "UTF-8"
    head = spark.read.csv(path, header=True, sep=sep, encoding=encoding, inferSchema=False, multiLine=False)
    need(head, *columns)
    return spark.read.csv(path, header=True, sep=sep, encoding=encoding, schema=_strings(head.columns), quote='"', escape='"').select(*columns).na.fill("")


def read_tsv(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    return read_csv(spark, path, columns, sep="\t")


#: Letters that Windows-1252 puts where Latin-1 has control codes, and those codes.
_WINDOWS = "".join(bytes([b]).decode("cp1252", "ignore") for b in range(0x80, 0xA0))
_CONTROLS = "".join(chr(b) for b in range(0x80, 0xA0) if bytes([b]).decode("cp1252", "ignore"))


def windows_letters(c: Column) -> Column:
    """Text read as Latin-1, taken for Windows-1252 unless it has a code that this lacks."""
    return F.when(c.rlike(r"[\x{81}\x{8D}\x{8F}\x{90}\x{9D}]"), c).otherwise(F.translate(c, _CONTROLS, _WINDOWS))


def decoded(content: Column) -> Column:
    """Bytes as text: UTF-8 where it is valid, else Windows-1252, else Latin-1; a
    byte-order mark goes."""
    text = F.when(F.expr("is_valid_utf8(cast(content as string))"), content.cast("string")).otherwise(windows_letters(F.decode(content, "ISO-8859-1")))
    return F.regexp_replace(text, "^\ufeff", "")


def latest_change(spark: SparkSession, path: str):
    """When the newest and the oldest of some files were changed: ``newest, oldest``."""
    return spark.read.format("binaryFile").load(path).agg(F.max("modificationTime").alias("newest"), F.min("modificationTime").alias("oldest"))


def read_texts(spark: SparkSession, path: str, max_chars: int | None = None) -> DataFrame:
    """``path, text`` of whole files in an unknown encoding."""
    text = decoded(F.col("content"))
    return spark.read.format("binaryFile").load(path).select("path", (F.left(text, F.lit(max_chars)) if max_chars else text).alias("text"))


def read_json_records(spark: SparkSession, path: str, schema: str, defaults: dict[str, object]) -> DataFrame:
    """Small JSON files; missing or broken values take their default."""
    df = spark.read.schema(schema).option("mode", "PERMISSIVE").option("multiLine", True).json(path)
    return df.select(*[F.coalesce(F.col(f.name), F.lit(defaults[f.name])).alias(f.name) if f.name in defaults else F.col(f.name) for f in df.schema])


def read_table(spark: SparkSession, url: str, name: str, columns: Sequence[str], partition_on: str, bounds: tuple[int, int], parts: int) -> DataFrame:
    """A database table over JDBC, read in ``parts`` ranges of a whole-number column."""
    df = spark.read.jdbc(url, name, column=partition_on, lowerBound=bounds[0], upperBound=bounds[1], numPartitions=parts)
    return df.select(*[c for c in columns if c in df.columns])


def is_pdf(content: Column, kind: Column | None = None) -> Column:
    """PDF by its first bytes, or by its stated kind."""
    magic = F.substring(content, 1, 4) == F.lit(b"%PDF")
    return magic | F.lower(kind).contains("pdf") if kind is not None else magic
