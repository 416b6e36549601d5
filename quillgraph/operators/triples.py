"""Triples: normalisation, quality checks, duplicates by section rank, deltas."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgraph.functions import constants as C
from quillgraph.functions import text as T
from quillgraph.runtime import cut

SPO = ["Subject", "Predicate", "Object"]


def normalized(df: DataFrame, scope: Sequence[str] = (), order: str = "row_id") -> DataFrame:
    """Rows with clean values and a known section, the first of equal ones.

    Equal: the same values and section, whatever the case, within ``scope``.  Rows
    with an empty value or unknown section are left out.
    """
    clean = df.select(*scope, order, *[T.triple_value(F.col(c)).alias(c) for c in SPO], T.section(F.col("Section")).alias("Section"))
    clean = cut(clean, "clean")  # read twice: for the first of each key and for its row
    whole = clean.where(" and ".join(f"{c} <> ''" for c in [*SPO, "Section"]))
    return first_of(whole, [*scope, *[f"lower({c})" for c in [*SPO, "Section"]]], order)


def first_of(df: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """The row with the smallest ``order`` of each key: pre-aggregated, not windowed, so
    a key that holds a third of all rows sends one row per task."""
    named = df
    cols = []
    for i, k in enumerate(keys):
        named = named.withColumn(f"__k{i}", F.expr(k))
        cols.append(f"__k{i}")
    first = named.groupBy(*cols).agg(F.min(order).alias("__first"))
    keep = first.select(F.col("__first").alias(order)).distinct()
    return df.join(keep, order, "left_semi").select(*df.columns)


def judged(accept_introduction: bool = True) -> Column:
    """Struct of a triple's canonical labels, its section, and ``reasons`` against it.

    One expression: labels are made once and bound, not repeated in every test.
    """
    labels = F.struct(
        T.entity_label(F.col("Subject")).alias("Subject"),
        T.predicate_label(F.col("Predicate")).alias("Predicate"),
        T.entity_label(F.col("Object")).alias("Object"),
        T.section(F.col("Section")).alias("Section"),
    )

    def judge(t: Column) -> Column:
        reasons = rejection_reasons(t["Subject"], t["Predicate"], t["Object"], t["Section"], accept_introduction)
        return F.struct(*[t[c].alias(c) for c in [*SPO, "Section"]], F.array_join(reasons, ";").alias("reasons"))

    return T.let(labels, judge)


def rejection_reasons(s: Column, p: Column, o: Column, sec: Column, accept_introduction: bool = True) -> Column:
    """All reasons against a labelled triple, in order; [] for a good one."""
    joined = F.concat_ws(" ", s, p, o)
    tests = [
        (s == "", "missing_subject"),
        (p == "", "missing_predicate"),
        (o == "", "missing_object"),
        (~sec.isin(*C.SECTION_RANK), "invalid_section"),
        ((sec == "Introduction") & F.lit(not accept_introduction), "introduction_triples_disabled"),
        (F.lower(s).isin(*C.GENERIC_ENTITIES), "generic_subject"),
        (F.lower(o).isin(*C.GENERIC_ENTITIES), "generic_object"),
        (F.lower(p).isin(*C.GENERIC_PREDICATES), "generic_predicate"),
        (F.length(s) > C.MAX_ENTITY_CHARS, "subject_too_long"),
        (F.length(o) > C.MAX_ENTITY_CHARS, "object_too_long"),
        (F.length(p) > C.MAX_PREDICATE_CHARS, "predicate_too_long"),
        (T.looks_like_sentence(s), "subject_looks_like_sentence"),
        (T.looks_like_sentence(o), "object_looks_like_sentence"),
        (T.word_count(p) > C.MAX_PREDICATE_WORDS, "predicate_too_many_words"),
        (joined.rlike(r"(?i)https?://|www\.|doi:|PMID|PMCID"), "contains_citation_or_url"),
        (joined.contains("```") | joined.contains("{") | joined.contains("}") | joined.contains("[EMPTY]"), "contains_formatting_artifact"),
        ((s != "") & (o != "") & (F.lower(s) == F.lower(o)), "subject_equals_object"),
    ]
    return F.filter(F.array(*[F.when(c, F.lit(name)) for c, name in tests]), lambda r: r.isNotNull())


def reviewed(df: DataFrame, article: str = "PMCID", order: str = "row_id", accept_introduction: bool = True) -> DataFrame:
    """Labelled triples with ``Reason``: '' for accepted ones, else why not.

    Of equal triples of an article the section of highest rank wins, the earliest of
    equals; a row that was best until a better one came is 'replaced', every other
    loser is a plain duplicate.  Only rows without other reasons take part.  ``order``
    must be unique.

    A row was best for a while exactly if it is the first of all with its rank or a
    higher one.  So one aggregate with a minimum for each rank finds all such rows, four
    at most of each triple, and they are joined back by their unique order: however
    often one triple is repeated, no task sees all its copies.
    """
    marked = df.select(order, article, judged(accept_introduction).alias("t")).select(order, article, "t.*").withColumnRenamed("reasons", "own")
    marked = cut(marked, "judged")  # the labels cost much and are read twice
    rank = T.lookup(F.col("Section"), C.SECTION_RANK, F.lit(0))
    good = marked.where("own = ''").select(article, *[F.lower(c).alias(f"k{c}") for c in SPO], order, rank.alias("rank"))
    first = lambda r: F.min(F.when(F.col("rank") >= r, F.struct(order, "rank")))
    ranks = sorted(C.SECTION_RANK.values())
    leads = good.groupBy(article, *[f"k{c}" for c in SPO]).agg(F.max("rank").alias("top"), *[first(r).alias(f"l{r}") for r in ranks])
    led = leads.select("top", F.explode(F.array_distinct(F.array(*[f"l{r}" for r in ranks]))).alias("l")).where("l is not null")
    held = led.select(F.col(f"l.{order}").alias(order), F.when(F.col("l.rank") == F.col("top"), "").otherwise("lower_priority_duplicate_replaced").alias("held"))
    reason = F.when(F.col("own") != "", F.col("own")).otherwise(F.coalesce("held", F.lit("lower_priority_duplicate")))
    return marked.join(held, order, "left").select(order, article, *SPO, "Section", reason.alias("Reason"))


def reason_counts(df: DataFrame, column: str = "Reason") -> DataFrame:
    """``reason, n`` over lists joined by ';'."""
    return df.select(F.explode(F.split(column, ";")).alias("reason")).where("reason <> ''").groupBy("reason").agg(F.count("*").alias("n"))


def delta(new: DataFrame, old: DataFrame, columns: Sequence[str], order: str) -> DataFrame:
    """Rows of ``new`` whose key (the columns, whatever the case) ``old`` doesn't have,
    the first of equal ones.  Applied again after appending, it gives nothing."""
    keys = [F.lower(T.text_or_empty(F.col(c))).alias(f"k{i}") for i, c in enumerate(columns)]
    names = [f"k{i}" for i in range(len(columns))]
    first = new.select(F.col(order), *keys).groupBy(*names).agg(F.min(order).alias(order))
    fresh = first.join(old.select(*keys).distinct(), names, "left_anti").select(order)
    return new.join(fresh, order, "left_semi").select(*new.columns)


REJECTED_KEY = ["Subject", "Predicate", "Object", "Section", "PMCID", "Reason"]


def rejected_delta(new: DataFrame, stored: DataFrame, order: str) -> DataFrame:
    """Rows of ``new`` (REJECTED_KEY and ``order``) that the rejected table doesn't have, the
    first of equal ones.

    Stored rows are compared by clean values, known section, article and reason, whatever
    the case, and count only with all but the reason; new ones are compared as they are.
    """
    low = lambda c: F.lower(T.text_or_empty(F.col(c)))
    reason = F.lower(T.squeeze(F.col("Reason")))
    names = [f"k{c}" for c in REJECTED_KEY]
    there = stored.select(*[F.lower(T.triple_value(F.col(c))).alias(f"k{c}") for c in SPO], F.lower(T.section(F.col("Section"))).alias("kSection"), T.strip_ws(T.text_or_empty(F.col("PMCID"))).alias("kPMCID"), reason.alias("kReason"))
    there = there.where(" and ".join(f"{n} <> ''" for n in names[:-1])).distinct()
    keyed = new.select(order, *[low(c).alias(f"k{c}") for c in REJECTED_KEY[:4]], T.text_or_empty(F.col("PMCID")).alias("kPMCID"), reason.alias("kReason"))
    fresh = keyed.groupBy(*names).agg(F.min(order).alias(order)).join(there, names, "left_anti").select(order)
    return new.join(fresh, order, "left_semi").select(*new.columns)
