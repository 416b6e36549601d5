"""All queries of the subpackage and their SQL, by name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.llm.canonical import OPPOSITE, typed_values, map_values, near_entries
from quillgraph.llm.ledger import distinct_records, duplicate_rows
from quillgraph.llm.mixing import mix_sources, source_key
from quillgraph.llm.names import link_names, variant_pairs
from quillgraph.llm.residue import residue_documents, residue_windows
from quillgraph.llm.tokens import encode_corpus, token_counts
from quillgraph.operators.packed import split_packed
from quillgraph.runtime import cut, table

TRIPLE = ["Subject", "Predicate", "Object"]


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rejected triples that repeat an earlier one in other writing."""
    return duplicate_rows(table(spark, sf_dir, "kg_triples_rejected", ["row_id", *TRIPLE], spread=True), "row_id", TRIPLE)


def p3_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per triple with the number of its copies, as first written."""
    return distinct_records(table(spark, sf_dir, "kg_triples_rejected", ["row_id", *TRIPLE], spread=True), "row_id", TRIPLE)


def _entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    article = table(spark, sf_dir, "article", ["row_id", "authors", "first_author"], spread=True)
    authors = split_packed(article, "row_id", "authors").select(F.col("author").alias("name"))
    first = article.select(F.trim(F.regexp_replace("first_author", r"(?U)\s+", " ")).alias("name"))
    return link_names(authors.unionByName(first))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs of spellings of one person or organisation."""
    return variant_pairs(_entities(spark, sf_dir))


def p4_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each spelling with its entity: what p4_found says in pairs, one row a spelling."""
    return _entities(spark, sf_dir)


def p4_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number of spellings of each entity."""
    return _entities(spark, sf_dir).groupBy("entity").agg(F.count("*").alias("spellings"))


def _mapped(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = table(spark, sf_dir, "kg_triples_rejected", ["row_id", *TRIPLE], spread=True)
    return map_values(rows, "row_id", TRIPLE, table(spark, sf_dir, "canonical_label"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values of rejected triples with the canonical entry they mean."""
    return _mapped(spark, sf_dir)[0]


def p5_unmatched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct values that mean no entry, with how often they occur."""
    return _mapped(spark, sf_dir)[1]


def p5_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All entries within the distance of each distinct value, nearest or not."""
    values = typed_values(table(spark, sf_dir, "kg_triples_rejected", ["row_id", *TRIPLE], spread=True), "row_id", TRIPLE)
    near = near_entries(values, table(spark, sf_dir, "canonical_label"))
    return near.select("value_key", "occurrences", F.explode("near").alias("n")).select("value_key", "occurrences", "n.entry_id", "n.distance").where(F.col("entry_id") != OPPOSITE)


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document."""
    return encode_corpus(table(spark, sf_dir, "documents", ["doc_id", "text"], spread=True), "doc_id", "text")


def _mixed(spark: SparkSession, sf_dir: str, *, half: bool = False, entropy: float | None = None) -> tuple[DataFrame, DataFrame]:
    docs = cut(token_counts(table(spark, sf_dir, "documents", ["doc_id", "source", "text"], spread=True), "text"), "token-counts")
    targets = table(spark, sf_dir, "mix_target")
    if entropy is not None:
        return mix_sources(docs, targets, entropy=entropy)
    if not half:
        return mix_sources(docs, targets)
    named = targets.where("target_share > 0 and max_repeats > 0").select(source_key(F.col("source")).alias("key"))
    tokens = docs.join(named, source_key(docs["source"]) == named["key"], "left_semi").agg(F.sum("n_tokens")).first()[0]
    return mix_sources(docs, targets, total_tokens=(tokens or 0) // 2)


def p7_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The training mix, of the largest total at which every source reaches its share."""
    return _mixed(spark, sf_dir)[0]


def p7_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wanted and reached share of each source."""
    return _mixed(spark, sf_dir)[1]


def p7_half_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix of half as many tokens as the targeted sources hold, more than small sources
    can give their shares of: shares come as near to the wanted ones as one exponent and
    the repeats allow."""
    return _mixed(spark, sf_dir, half=True)[0]


def p7_half_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wanted and reached share of each source in that mix."""
    return _mixed(spark, sf_dir, half=True)[1]


def p7_entropy_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Natural shares tempered to an entropy of 1.4 nats, as four equal sources would have."""
    return _mixed(spark, sf_dir, entropy=1.4)[1]


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that are, or hold, what a broken page, form or template left behind."""
    return residue_documents(table(spark, sf_dir, "documents", ["doc_id", "text"], spread=True), "doc_id", "text")


def p8_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containment of each document's most residual window, where any retrieves an exemplar."""
    scored = residue_windows(table(spark, sf_dir, "documents", ["doc_id", "text"], spread=True), "doc_id", "text")
    return scored.groupBy(F.col("id").alias("doc_id")).agg(F.round(F.max("containment"), 6).alias("containment"))


def _canon(c: str) -> str:
    return f"regexp_replace(lower(upper(coalesce({c}, ''))), '[^\\p{{L}}\\p{{Nd}}]+', '', 'g')"


_P3 = f"""
WITH keyed AS (
  SELECT *, list_sort([{_canon('Subject')}, {_canon('Predicate')}, {_canon('Object')}]) AS k FROM kg_triples_rejected
), w AS (
  SELECT *, min(row_id) OVER (PARTITION BY k) AS keep_row_id, count(*) OVER (PARTITION BY k) AS copies FROM keyed
)
"""

QUERIES = {"p3_found": p3_found, "p3_ledger": p3_ledger, "p4_found": p4_found, "p4_members": p4_members, "p4_entities": p4_entities, "p5_found": p5_found, "p5_unmatched": p5_unmatched, "p5_candidates": p5_candidates, "p6_ids": p6_ids, "p7_mix": p7_mix, "p7_report": p7_report, "p7_half_mix": p7_half_mix, "p7_half_report": p7_half_report, "p7_entropy_report": p7_entropy_report, "p8_found": p8_found, "p8_scores": p8_scores}
ORACLES = {
    "p3_found": _P3 + "SELECT keep_row_id, row_id FROM w WHERE row_id <> keep_row_id",
    "p3_ledger": _P3 + "SELECT keep_row_id, copies::BIGINT AS copies, Subject, Predicate, Object FROM w WHERE row_id = keep_row_id",
}
