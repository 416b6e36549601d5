"""The compact graph: dictionary encoding, resolving, validating, references."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.functions.text import normalize_label, pmcid_number, squeeze, strip_ws, text_or_empty
from quillgraph.runtime import cut, shuffle_width

SPO = ["Subject", "Predicate", "Object"]


def unique_triples(refs: DataFrame) -> DataFrame:
    """Distinct stripped triples; rows with an empty value stay, as written."""
    return refs.select(*[strip_ws(text_or_empty(F.col(c))).alias(c) for c in SPO]).distinct()


def dense_ids(labels: DataFrame, prefix: str, id_name: str) -> DataFrame:
    """``<id_name>, label``: 1-based ids in code-point order of the labels.

    Range-partitioned, numbered within each partition, and shifted by how much stands
    in the partitions before: no task ever sees all labels.  The offsets are one
    number per partition.
    """
    spark = labels.sparkSession
    ranged = cut(
        labels.select("label").distinct().repartitionByRange(shuffle_width(spark), "label").withColumn("part", F.spark_partition_id()), "labels"
    )
    sizes = sorted((r["part"], r["n"]) for r in ranged.groupBy("part").agg(F.count("*").alias("n")).collect())
    before, total = [], 0
    for part, n in sizes:
        before.append((part, total))
        total += n
    offsets = spark.createDataFrame(before, "part int, before bigint")
    ranged = ranged.join(F.broadcast(offsets), "part")
    place = F.row_number().over(Window.partitionBy("part").orderBy("label")) + F.col("before")
    return ranged.select(F.concat(F.lit(prefix), place.cast("string")).alias(id_name), "label")


def nodes(triples: DataFrame) -> DataFrame:
    """``node_id, label`` of all subjects and objects."""
    return dense_ids(triples.select(F.col("Subject").alias("label")).union(triples.select("Object")), "n", "node_id")


def predicates(triples: DataFrame) -> DataFrame:
    """``pred_id, label``."""
    return dense_ids(triples.select(F.col("Predicate").alias("label")), "p", "pred_id")


def edges(triples: DataFrame, node: DataFrame, pred: DataFrame) -> DataFrame:
    """``s, p, o`` as ids.  The planner broadcasts a dictionary only if it is small."""
    return (
        triples.join(node.select(F.col("node_id").alias("s"), F.col("label").alias("Subject")), "Subject")
        .join(pred.select(F.col("pred_id").alias("p"), F.col("label").alias("Predicate")), "Predicate")
        .join(node.select(F.col("node_id").alias("o"), F.col("label").alias("Object")), "Object")
        .select("s", "p", "o")
    )


def resolve(edge: DataFrame, node: DataFrame, pred: DataFrame) -> DataFrame:
    """Edges with labels added; an unknown id stands for itself."""
    return (
        edge.join(node.select(F.col("node_id").alias("s"), F.col("label").alias("ls")), "s", "left")
        .join(pred.select(F.col("pred_id").alias("p"), F.col("label").alias("lp")), "p", "left")
        .join(node.select(F.col("node_id").alias("o"), F.col("label").alias("lo")), "o", "left")
        .select("s", "p", "o", F.coalesce("ls", "s").alias("Subject"), F.coalesce("lp", "p").alias("Predicate"), F.coalesce("lo", "o").alias("Object"))
    )


def ids_by_norm(dictionary: DataFrame, id_name: str) -> DataFrame:
    """``norm, id``: the id of a normalised label, the last label of equal ones."""
    return dictionary.groupBy(normalize_label(F.col("label")).alias("norm")).agg(F.max_by(id_name, "label").alias("id"))


def validate(candidates: DataFrame, edge: DataFrame, node: DataFrame, pred: DataFrame, order: str) -> DataFrame:
    """``<order>, s, p, o`` of candidate triples that are edges, each edge once, at its
    first candidate.  Labels are compared normalised."""
    n, p = ids_by_norm(node, "node_id"), ids_by_norm(pred, "pred_id")
    return (
        candidates.select(order, *[normalize_label(F.col(c)).alias(f"n{c}") for c in SPO])
        .join(n.select(F.col("norm").alias("nSubject"), F.col("id").alias("s")), "nSubject")
        .join(p.select(F.col("norm").alias("nPredicate"), F.col("id").alias("p")), "nPredicate")
        .join(n.select(F.col("norm").alias("nObject"), F.col("id").alias("o")), "nObject")
        .groupBy("s", "p", "o")
        .agg(F.min(order).alias(order))
        .join(edge, ["s", "p", "o"], "left_semi")
        .select(order, "s", "p", "o")
    )


def reference_index(refs: DataFrame) -> DataFrame:
    """References keyed by normalised triple: ``ns, np, no, Section, pmcid, ref_id``."""
    return refs.select(
        normalize_label(F.col("Subject")).alias("ns"),
        normalize_label(F.col("Predicate")).alias("np"),
        normalize_label(F.col("Object")).alias("no"),
        squeeze(F.col("Section")).alias("Section"),
        pmcid_number(F.col("PMCID")).alias("pmcid"),
        "ref_id",
    )


def references_of(triples: DataFrame, refs: DataFrame, order: str) -> DataFrame:
    """All references of each triple: ``<order>, pmcid, Section, ref_id``."""
    keyed = triples.select(order, *[normalize_label(F.col(c)).alias(k) for c, k in zip(SPO, ("ns", "np", "no"))])
    return keyed.join(reference_index(refs), ["ns", "np", "no"]).select(order, "pmcid", "Section", "ref_id")


def results_first(found: DataFrame, order: str) -> DataFrame:
    """``pmcid, later, first_row, first_ref``: each article once with its sort key: those
    with a Results row first (``later`` = 0), then by triple and reference.  No global
    window: sort by the key, or take the first n of it."""
    best = (
        found.where("pmcid is not null")
        .groupBy("pmcid")
        .agg(F.min(F.struct((F.lower("Section") != "results").cast("int").alias("later"), F.col(order).alias("first_row"), F.col("ref_id").alias("first_ref"))).alias("b"))
    )
    return best.select("pmcid", "b.later", "b.first_row", "b.first_ref")


def results_first_of(triples: DataFrame, refs: DataFrame, order: str) -> DataFrame:
    """``results_first`` of all references of some triples, without meeting each row of a
    repeated triple with each of its references: both sides are aggregated first."""
    keys = ["ns", "np", "no"]
    rows = triples.groupBy(*[normalize_label(F.col(c)).alias(k) for c, k in zip(SPO, keys)]).agg(F.min(order).alias("first_row"))
    later = (F.lower("Section") != "results").cast("int").alias("later")
    told = reference_index(refs).where("pmcid is not null").groupBy(*keys, "pmcid", later).agg(F.min("ref_id").alias("first_ref"))
    best = rows.join(told, keys).groupBy("pmcid").agg(F.min(F.struct("later", "first_row", "first_ref")).alias("b"))
    return best.select("pmcid", "b.later", "b.first_row", "b.first_ref")


def stats(triples: DataFrame) -> DataFrame:
    """``nodes, predicates, edges``."""
    return triples.select(F.explode(F.array("Subject", "Object")).alias("x"), "Predicate").agg(
        F.countDistinct("x").alias("nodes"), F.countDistinct("Predicate").alias("predicates")
    ).crossJoin(triples.agg(F.count("*").alias("edges")))


def signature(triples: DataFrame) -> DataFrame:
    """One row that changes if and only if the set of triples does (up to 2^-60): sums and
    exclusive or of digests, so that no order and no single task is needed."""
    digest = F.md5(F.concat_ws("\x1f", *SPO))
    part = lambda at, n: F.conv(F.substring(digest, at, n), 16, 10).cast("bigint")
    return triples.agg(F.count("*").alias("edges"), F.sum(part(1, 7)).alias("sum_a"), F.sum(part(8, 7)).alias("sum_b"), F.bit_xor(part(16, 15)).alias("mix"))
