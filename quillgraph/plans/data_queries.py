"""Queries over the operators for packed fields and missing records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.operators.orphans import number_written, orphan_counts, orphan_references
from quillgraph.operators.packed import split_packed
from quillgraph.runtime import table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every author of every article row, with its place."""
    return split_packed(table(spark, sf_dir, "article", ["row_id", "authors"], spread=True), "row_id", "authors").select("row_id", "pos", "author")


def p1_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many values the parser read under each error flag."""
    out = split_packed(table(spark, sf_dir, "article", ["row_id", "authors"], spread=True), "row_id", "authors")
    return out.groupBy("flag").agg(F.count("*").alias("values_read"), F.countDistinct("row_id").alias("rows_read"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that name an article which was not in the store at their time."""
    rejected = table(spark, sf_dir, "kg_triples_rejected").select(
        F.lit("kg_triples_rejected").alias("table_name"), "row_id", number_written(F.col("PMCID")).alias("key"), F.col("rejected_at").alias("t")
    )
    ingest = table(spark, sf_dir, "ingest_result").select(
        F.lit("ingest_result").alias("table_name"), "row_id", F.col("pmcid").alias("key"), F.col("run_at").alias("t")
    )
    parents = table(spark, sf_dir, "article").select(F.col("pmcid").alias("key"), F.col("loaded_at").alias("valid_from"), F.col("removed_at").alias("valid_to"))
    return orphan_references(rejected.unionByName(ingest), parents)


def p2_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orphans per table and month."""
    return orphan_counts(p2_found(spark, sf_dir))


_P2 = """
WITH refs AS (
  SELECT 'kg_triples_rejected' AS table_name, row_id,
         TRY_CAST(regexp_extract(PMCID, '([0-9]+)', 1) AS BIGINT) AS k, rejected_at AS t
  FROM kg_triples_rejected WHERE regexp_matches(PMCID, '[0-9]')
  UNION ALL
  SELECT 'ingest_result', row_id, pmcid, run_at FROM ingest_result WHERE pmcid IS NOT NULL
), missed AS (
  SELECT table_name, strftime(t, '%Y-%m') AS period, row_id FROM refs r
  WHERE NOT EXISTS (SELECT 1 FROM article a WHERE a.pmcid = r.k AND a.loaded_at <= r.t
                    AND (a.removed_at IS NULL OR r.t < a.removed_at))
)
"""

QUERIES = {"p1_found": p1_found, "p1_flags": p1_flags, "p2_found": p2_found, "p2_report": p2_report}
ORACLES = {
    "p2_found": _P2 + "SELECT table_name, period, row_id FROM missed",
    "p2_report": _P2 + "SELECT table_name, period, count(*)::BIGINT AS orphans FROM missed GROUP BY ALL",
}
