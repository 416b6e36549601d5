"""Queries over browsing, ingest and settings."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.functions import text as T
from quillgraph.operators import classify, control, facets, ingest
from quillgraph.operators.articles import current_articles
from quillgraph.plans import duck as D
from quillgraph.runtime import table

AS_OF = date(2026, 1, 1)
BASE = "https://articles.example.org"


def facet_type_counts(spark: SparkSession, d: str) -> DataFrame:
    return facets.type_counts(table(spark, d, "article", ["type"]))


def facet_axis_counts(spark: SparkSession, d: str) -> DataFrame:
    return facets.value_counts(table(spark, d, "article", ["axis"]), "axis")


def facet_organism_counts(spark: SparkSession, d: str) -> DataFrame:
    return facets.value_counts(table(spark, d, "article", ["organism"]), "organism")


def facet_all(spark: SparkSession, d: str) -> DataFrame:
    return facets.all_facets(table(spark, d, "article", ["type", "axis", "organism"]))


def facet_date_window(spark: SparkSession, d: str) -> DataFrame:
    return facets.filter_articles(table(spark, d, "article", ["row_id", "date"]), window="year", as_of=AS_OF).select("row_id", F.col("date").cast("string"))


def facet_filters(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "article", ["row_id", "date", "ds", "organism", "type", "axis"])
    kept = facets.filter_articles(a, start=date(2020, 1, 1), end=date(2025, 12, 31), ds="Yes", types=["Original", "Review"], organisms=["Human", "Mouse"])
    return kept.select("row_id", "type", "organism")


def facet_text_search(spark: SparkSession, d: str) -> DataFrame:
    return facets.filter_articles(table(spark, d, "article", ["row_id", "title", "abstract"]), text="Seizure").select("row_id", "title")


def facet_article_list(spark: SparkSession, d: str) -> DataFrame:
    return facets.article_list(table(spark, d, "article", ["row_id", "pmcid", "title", "journal", "date"])).withColumn("date", F.col("date").cast("string"))


def chatlog_search(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents", ["doc_id", "text", "source", "lang"])
    return facets.search_log(docs, "Ataxia", ["text", "source"]).select("doc_id", facets.short_text(F.col("text")).alias("short"))


def article_snapshot(spark: SparkSession, d: str) -> DataFrame:
    return current_articles(table(spark, d, "article", ["pmcid", "row_id", "title", "journal", "year"]))


def article_upsert(spark: SparkSession, d: str) -> DataFrame:
    old = current_articles(table(spark, d, "article", ["pmcid", "row_id", "type", "ds", "organism"])).select("pmcid", "type", "ds", "organism")
    return ingest.upsert(old, table(spark, d, "ingest_result", ["pmcid", "row_id", "ds", "axis"]), "pmcid", "row_id")


def author_split(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "article", ["row_id", "authors", "first_author"])
    return a.select(
        "row_id",
        F.array_join(T.authors(F.col("authors")), "\x1f").alias("names"),
        T.first_author(F.col("first_author"), F.col("authors")).alias("lead"),
        T.several_authors(F.col("authors")).alias("several"),
    )


def preprint_gate(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "article", ["row_id", "title", "journal", "type", "doi"])
    return a.where(classify.is_preprint(*[F.col(c) for c in ("title", "journal", "type", "doi")])).select("row_id")


def ingest_outcome_counts(spark: SparkSession, d: str) -> DataFrame:
    return ingest.outcome_counts(table(spark, d, "ingest_result"))


def queue_candidates(spark: SparkSession, d: str) -> DataFrame:
    return ingest.queue_candidates(table(spark, d, "ingest_result"))


def queue_ordered_dedup(spark: SparkSession, d: str) -> DataFrame:
    return ingest.ordered_distinct(queue_candidates(spark, d), "pmcid", "row_id")


def queue_pop(spark: SparkSession, d: str) -> DataFrame:
    head, rest = ingest.pop(queue_ordered_dedup(spark, d), "row_id", 20)
    return head.withColumn("part", F.lit("head")).unionByName(rest.withColumn("part", F.lit("rest")))


def processed_pmcids(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "kg_triples_references", ["PMCID"]).where(F.col("PMCID").rlike("^[0-9]+$")).select(F.col("PMCID").cast("bigint").alias("pmcid")).distinct()


def eligible_articles(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "article", ["row_id", "pmcid", "type", "ds", "fulltext_path", "pdf_path"])
    return a.where("type = 'Original' and ds = 'Yes' and (fulltext_path > '' or pdf_path > '')").select("row_id", "pmcid")


def unprocessed_articles(spark: SparkSession, d: str) -> DataFrame:
    return ingest.without(eligible_articles(spark, d), processed_pmcids(spark, d), "pmcid").select("row_id", "pmcid")


def pages_link_candidates(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "article", ["row_id", "url", "pdf_path"])
    link = lambda c: F.replace(T.text_or_empty(F.col(c)), F.lit('"'), F.lit(""))
    html = F.concat(F.lit('<html><head><meta name="citation_pdf_url" content="'), link("pdf_path"), F.lit('"></head><a href="'), link("url"), F.lit('#top">x</a><a href="'), link("url"), F.lit('">y</a></html>'))
    return ingest.page_links(a.select("row_id", html.alias("html")), "row_id", "html", BASE)


def control_normalize(spark: SparkSession, d: str) -> DataFrame:
    raw = table(spark, d, "ingest_result", ["row_id", "pmcid", "axis", "created"]).select(
        "row_id",
        F.col("pmcid").alias("pmc_sync_retmax"),
        F.col("row_id").alias("kg_cache_ttl_minutes"),
        F.lower("axis").alias("kg_cache_mode"),
        F.col("created").alias("automated_kg_cache_reset_enabled"),
    )
    return control.normalized_settings(raw)


def jats_sections(spark: SparkSession, d: str) -> DataFrame:
    """Documents written as article XML and parsed again: a round trip of every text."""
    docs = table(spark, d, "documents", ["doc_id", "text", "section"], spread=True)
    esc = lambda c: F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    body = esc(F.regexp_replace(T.text_or_empty(F.col("text")), r"[^\x{20}-\x{D7FF}\x{E000}-\x{FFFD}\x{10000}-\x{10FFFF}]", " "))
    xml = F.concat(F.lit("<!DOCTYPE article SYSTEM 'a.dtd'><article><body><sec><title>"), esc(T.text_or_empty(F.col("section"))), F.lit("</title><p>"), body, F.lit("</p></sec></body></article>"))
    got = ingest.parse_articles(docs.select("doc_id", xml.alias("xml")), "doc_id", "xml")
    return got.select("doc_id", "ok", F.size("sections").alias("n_sections"), F.coalesce(F.get("sections", F.lit(0))["label"], F.lit("")).alias("label"))


QUERIES = {
    f.__name__: f
    for f in (
        facet_type_counts, facet_axis_counts, facet_organism_counts, facet_all, facet_date_window, facet_filters, facet_text_search, facet_article_list, chatlog_search, article_snapshot, article_upsert, author_split, preprint_gate,
        ingest_outcome_counts, queue_candidates, queue_ordered_dedup, queue_pop, processed_pmcids, eligible_articles, unprocessed_articles, pages_link_candidates, control_normalize, jats_sections,
    )
}

_PCT = "floor((n * 2000 + sum(n) OVER ()) / (2.0 * sum(n) OVER ())) / 10.0"


def _counts(c: str) -> str:
    return f"SELECT {c}, n::BIGINT AS n, ({_PCT})::DOUBLE AS pct FROM (SELECT {c}, count(*) AS n FROM article GROUP BY 1)"


_TITLED = f"array_to_string(list_transform(regexp_extract_all({D.norm('type')}, '[a-z]+|[^a-z]'), lambda w: upper(left(w, 1)) || substring(w, 2)), '')"
_QUEUE = "SELECT pmcid, row_id FROM ingest_result WHERE (created OR updated) AND (has_xml OR has_pdf) AND article_type = 'Original' AND ds = 'Yes' AND pmcid IS NOT NULL"
_DEDUP = f"SELECT pmcid, min(row_id) AS row_id FROM ({_QUEUE}) GROUP BY 1"
_DONE = "SELECT DISTINCT PMCID::BIGINT AS pmcid FROM kg_triples_references WHERE regexp_matches(PMCID, '^[0-9]+$')"
_ELIGIBLE = "SELECT row_id, pmcid FROM article WHERE type = 'Original' AND ds = 'Yes' AND (fulltext_path > '' OR pdf_path > '')"
_SNAP = "SELECT * FROM article WHERE pmcid IS NOT NULL QUALIFY row_number() OVER (PARTITION BY pmcid ORDER BY row_id DESC) = 1"
_AU = D.squeeze("authors")
_NAMES = (
    f"list_filter(list_transform(CASE WHEN contains({_AU}, ';') THEN string_split({_AU}, ';') WHEN contains({_AU}, '|') THEN string_split({_AU}, '|') WHEN contains({_AU}, ',') THEN string_split({_AU}, ',') "
    f"WHEN contains(lower({_AU}), ' and ') THEN regexp_split_to_array({_AU}, '(?i) and ') ELSE [{_AU}] END, lambda p: {D.strip('p')}), lambda p: p <> '')"
)

ORACLES = {
    "facet_type_counts": f"WITH t AS (SELECT CASE WHEN {D.norm('type')} IN ('', 'null', 'none', 'unknown') THEN NULL WHEN {D.norm('type')} IN ('case', 'case report', 'case reports', 'case series') THEN 'Case report' ELSE {_TITLED} END AS type FROM article), c AS (SELECT type, count(*) AS n FROM t WHERE type IS NOT NULL GROUP BY 1) SELECT type, n::BIGINT AS n, ({_PCT})::DOUBLE AS pct FROM c",
    "facet_axis_counts": _counts("axis"),
    "facet_organism_counts": _counts("organism"),
    "facet_all": "SELECT 'type' AS facet, type AS value, count(*)::BIGINT AS n FROM article GROUP BY 2 UNION ALL SELECT 'axis', axis, count(*) FROM article GROUP BY 2 UNION ALL SELECT 'organism', organism, count(*) FROM article GROUP BY 2 UNION ALL SELECT 'all', NULL, count(*) FROM article",
    "facet_date_window": "SELECT row_id, date::VARCHAR AS date FROM article WHERE date >= DATE '2026-01-01' - INTERVAL 365 DAY",
    "facet_filters": "SELECT row_id, type, organism FROM article WHERE date BETWEEN DATE '2020-01-01' AND DATE '2025-12-31' AND ds = 'Yes' AND type IN ('Original', 'Review') AND organism IN ('Human', 'Mouse')",
    "facet_text_search": "SELECT row_id, title FROM article WHERE contains(lower(title), 'seizure') OR contains(lower(abstract), 'seizure')",
    "facet_article_list": "SELECT row_id, pmcid, title, journal, date::VARCHAR AS date FROM article ORDER BY article.date DESC NULLS LAST, title ASC NULLS FIRST, row_id",
    "chatlog_search": f"SELECT doc_id, CASE WHEN length({D.strip('text')}) > 80 THEN left({D.strip('text')}, 80) || '…' ELSE {D.strip('text')} END AS short FROM documents WHERE contains(lower(text), 'ataxia') OR contains(lower(coalesce(source, '')), 'ataxia')",
    "article_snapshot": f"SELECT pmcid, row_id, title, journal, year FROM ({_SNAP})",
    "article_upsert": f"WITH o AS ({_SNAP}), n AS (SELECT pmcid, ds, axis FROM ingest_result WHERE pmcid IS NOT NULL QUALIFY row_number() OVER (PARTITION BY pmcid ORDER BY row_id DESC) = 1), d AS (SELECT pmcid, arg_max(ds, row_id) FILTER (ds IS NOT NULL) AS ds, arg_max(axis, row_id) FILTER (axis IS NOT NULL) AS axis FROM ingest_result WHERE pmcid IS NOT NULL GROUP BY 1) "
    "SELECT coalesce(o.pmcid, n.pmcid) AS pmcid, o.type, CASE WHEN n.pmcid IS NOT NULL THEN n.ds ELSE o.ds END AS ds, o.organism, n.axis FROM o FULL OUTER JOIN n ON o.pmcid = n.pmcid",
    "author_split": f"SELECT row_id, array_to_string({_NAMES}, chr(31)) AS names, CASE WHEN {D.strip("coalesce(first_author, '')")} <> '' THEN {D.strip('first_author')} ELSE coalesce({_NAMES}[1], '') END AS lead, (len({_NAMES}) > 1 OR contains({D.strip("coalesce(authors, '')")}, ';') OR contains({D.strip("coalesce(authors, '')")}, '|') OR contains({D.strip("coalesce(authors, '')")}, ' and ')) AS several FROM article",
    "preprint_gate": f"WITH h AS (SELECT row_id, lower({D.strip("coalesce(doi, '')")}) AS d, lower(concat_ws(' ', coalesce(title, ''), coalesce(journal, ''), coalesce(type, ''), lower({D.strip("coalesce(doi, '')")}))) AS h FROM article) SELECT row_id FROM h WHERE {D.any_of('h', ['biorxiv', 'bioarxiv', 'bio archive', 'medrxiv', 'medarxiv', 'med archive'])} OR (contains(h, 'preprint') AND (contains(h, 'rxiv') OR contains(h, 'archive'))) OR starts_with(d, '10.1101/') OR starts_with(d, '10.64898/')",
    "ingest_outcome_counts": "SELECT CASE WHEN skipped_preprint THEN 'skipped_preprint' WHEN skipped_duplicate THEN 'skipped_duplicate' WHEN created THEN 'created' WHEN updated THEN 'updated' ELSE 'none' END AS outcome, count(*)::BIGINT AS n FROM ingest_result GROUP BY 1",
    "queue_candidates": _QUEUE,
    "queue_ordered_dedup": _DEDUP,
    "queue_pop": f"SELECT pmcid, row_id, CASE WHEN row_number() OVER (ORDER BY row_id) <= 20 THEN 'head' ELSE 'rest' END AS part FROM ({_DEDUP})",
    "processed_pmcids": _DONE,
    "eligible_articles": _ELIGIBLE,
    "unprocessed_articles": f"SELECT row_id, pmcid FROM ({_ELIGIBLE}) e WHERE NOT EXISTS (SELECT 1 FROM ({_DONE}) p WHERE p.pmcid = e.pmcid)",
    "pages_link_candidates": "WITH l AS (SELECT row_id, list_filter([replace(coalesce(pdf_path, ''), '\"', ''), replace(coalesce(url, ''), '\"', '') || '#top', replace(coalesce(url, ''), '\"', '')], lambda x: x <> '') AS l FROM article), e AS (SELECT row_id, unnest(l) AS x, unnest(range(len(l))) AS pos FROM l), "
    f"c AS (SELECT row_id, pos, {D.strip("regexp_replace(replace(x, '&amp;', '&'), '#.*$', '')")} AS x FROM e), u AS (SELECT row_id, pos, CASE WHEN regexp_matches(x, '(?i)^https?://') THEN x WHEN starts_with(x, '//') THEN 'https:' || x WHEN starts_with(x, '/') THEN '{BASE}' || x ELSE '{BASE}/' || x END AS url FROM c WHERE x <> '' AND NOT regexp_matches(x, '(?i)^(mailto|javascript|data):')) "
    "SELECT row_id, url, (CASE WHEN contains(lower(url), '/pmc/') AND contains(lower(url), 'pdf') THEN 0 WHEN regexp_matches(lower(url), '\\.pdf(\\?|$)') THEN 1 ELSE 2 END)::INT AS priority, min(pos)::INT AS pos FROM u GROUP BY row_id, url",
    "control_normalize": "SELECT row_id, least(greatest(coalesce(TRY_CAST(pmcid AS INT), 200), 1), 1000)::INT AS pmc_sync_retmax, least(greatest(coalesce(TRY_CAST(row_id AS INT), 30), 5), 1440)::INT AS kg_cache_ttl_minutes, 'on_demand' AS kg_cache_mode, false AS automated_kg_cache_reset_enabled FROM ingest_result",
    "jats_sections": "SELECT doc_id, true AS ok, (CASE WHEN length(regexp_replace(regexp_replace(coalesce(section, '') || coalesce(text, ''), '[^\\x{20}-\\x{D7FF}\\x{E000}-\\x{FFFD}\\x{10000}-\\x{10FFFF}]', ' ', 'g'), '[\\s\\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]', '', 'g')) > 0 THEN 1 ELSE 0 END)::INT AS n_sections, "
    "CASE WHEN n_sections = 0 THEN '' WHEN contains(lower(section), 'method') THEN 'methods' WHEN contains(lower(section), 'result') THEN 'results' WHEN contains(lower(section), 'discussion') THEN 'discussion' WHEN contains(lower(section), 'introduction') THEN 'introduction' ELSE 'default' END AS label FROM documents",
}
