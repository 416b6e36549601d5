"""Browsing articles: filters and facet counts."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgraph.functions.text import squeeze, strip_ws, text_or_empty

#: Days of the named date windows.
WINDOWS = {"week": 7, "month": 30, "year": 365}


def present_columns(df: DataFrame, wanted: Sequence[str]) -> DataFrame:
    """The wanted columns that the table has."""
    return df.select(*[c for c in wanted if c in df.columns])


def filter_articles(
    df: DataFrame,
    *,
    window: str | None = None,
    as_of: date | None = None,
    start: date | None = None,
    end: date | None = None,
    ds: str | None = None,
    organisms: Sequence[str] = (),
    types: Sequence[str] = (),
    axes: Sequence[str] = (),
    text: str | None = None,
    pmcids: Sequence[int] = (),
) -> DataFrame:
    """Articles under the chosen filters; an empty choice filters nothing.

    Windows count back from ``as_of`` and include both ends.  ``ds`` counts only if
    it is Yes or No.  ``text`` is looked for in title and abstract as it is, whatever
    the case.  A null never passes a filter.
    """
    cond: list[Column] = []
    if window in WINDOWS:
        cond.append(F.col("date") >= F.date_sub(F.lit(as_of), WINDOWS[window]) if as_of else F.col("date") >= F.date_sub(F.current_date(), WINDOWS[window]))
    if start:
        cond.append(F.col("date") >= F.lit(start))
    if end:
        cond.append(F.col("date") <= F.lit(end))
    if ds in ("Yes", "No"):
        cond.append(F.col("ds") == ds)
    for column, values in (("organism", organisms), ("type", types), ("axis", axes), ("pmcid", pmcids)):
        if values:
            cond.append(F.col(column).isin(*values))
    if text:
        low = text.lower()
        cond.append(F.coalesce(F.lower("title").contains(low), F.lit(False)) | F.coalesce(F.lower("abstract").contains(low), F.lit(False)))
    for c in cond:
        df = df.where(c)
    return df


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """``<column>, n, pct`` of all rows, nulls included, to one place."""
    counted = df.groupBy(column).agg(F.count("*").alias("n"))
    return _with_percent(counted)


def _with_percent(counted: DataFrame) -> DataFrame:
    """Shares of counts in their sum: one row with the sum meets all, and no task holds all
    values, however many there are."""
    whole = counted.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("__whole"))
    return counted.crossJoin(F.broadcast(whole)).withColumn("pct", percent(F.col("n"), F.col("__whole"))).drop("__whole")


def percent(part: Column, whole: Column) -> Column:
    """Percentage to one place, halves away from zero, decided on whole numbers."""
    return F.when(whole > 0, F.floor((part * 2000 + whole) / (whole * 2)) / 10).otherwise(F.lit(0.0))


def type_label(c: Column) -> Column:
    """Reading of an article type: null for blank ones, case reports and series as one,
    others in title case."""
    t = F.lower(squeeze(c))
    titled = F.array_join(F.transform(F.split(t, "(?<=[^a-z])|(?=[^a-z])"), lambda w: F.concat(F.upper(F.left(w, F.lit(1))), F.substring(w, 2, 1 << 30))), "")
    return (
        F.when(t.isin("", "null", "none", "unknown"), None).when(t.isin("case", "case report", "case reports", "case series"), "Case report").otherwise(titled)
    )


def type_counts(df: DataFrame) -> DataFrame:
    """``type, n, pct``: labelled types, percentage of all labelled rows.

    Grouped by the raw type first, so labels are made once per distinct type.
    """
    raw = df.groupBy("type").agg(F.count("*").alias("n"))
    labelled = raw.select(type_label(F.col("type")).alias("type"), "n").where("type is not null").groupBy("type").agg(F.sum("n").alias("n"))
    return _with_percent(labelled)


def all_facets(df: DataFrame) -> DataFrame:
    """Counts by type, axis and organism and of all rows from one pass."""
    return (
        df.groupingSets([["type"], ["axis"], ["organism"], []], "type", "axis", "organism")
        .agg(F.count("*").alias("n"), F.grouping_id().alias("gid"))
        .select(
            F.expr("case gid when 3 then 'type' when 5 then 'axis' when 6 then 'organism' else 'all' end").alias("facet"),
            F.expr("case gid when 3 then type when 5 then axis when 6 then organism end").alias("value"),
            "n",
        )
    )


def article_list(df: DataFrame) -> DataFrame:
    """Articles by date, newest first, then title, then row."""
    return df.orderBy(F.col("date").desc_nulls_last(), F.col("title").asc_nulls_first(), "row_id")


def search_log(df: DataFrame, text: str, columns: Sequence[str]) -> DataFrame:
    """Rows that hold ``text`` in any of the columns, whatever the case."""
    low = text.lower()
    cond = F.lit(False)
    for c in columns:
        cond = cond | F.lower(text_or_empty(F.col(c))).contains(low)
    return df.where(cond)


def short_text(c: Column, n: int = 80) -> Column:
    """The first ``n`` letters and an ellipsis if there is more."""
    t = strip_ws(text_or_empty(c))
    return F.when(F.length(t) > n, F.concat(F.left(t, F.lit(n)), F.lit("…"))).otherwise(t)
