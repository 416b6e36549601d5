"""Queries over the edges of the pipeline: what is stored, demoted, linked, recovered."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.functions import text as T
from quillgraph.operators import classify, control, ingest, triples
from quillgraph.operators.articles import current_articles
from quillgraph.plans import duck as D
from quillgraph.plans.browse_queries import _SNAP
from quillgraph.runtime import cut, table

SPO = ["Subject", "Predicate", "Object"]
ARRIVED = "2025-07-01"


def preprint_demotion(spark: SparkSession, d: str) -> DataFrame:
    """Stored articles of which a later reading says that they are preprints."""
    a = table(spark, d, "article", ["pmcid", "row_id", "title", "journal", "type", "doi", "ds", "organism", "axis", "pdf_path", "fulltext_path", "fulltext_format"])
    now = cut(current_articles(a), "current")
    is_one = classify.is_preprint(F.col("title"), F.col("journal"), F.col("type"), F.col("doi"))
    preprints = now.where(is_one).select("pmcid", F.upper("title").alias("title"), "journal", "doi")
    return ingest.demote_preprints(now, preprints, "pmcid").select("pmcid", "title", "type", "ds", "organism", "axis", "pdf_path", "fulltext_path", "fulltext_format")


def rejected_store_delta(spark: SparkSession, d: str) -> DataFrame:
    """Rejected rows that came from ARRIVED on and that the earlier ones don't hold."""
    r = table(spark, d, "kg_triples_rejected", ["row_id", *triples.REJECTED_KEY, "rejected_at"])
    late = F.col("rejected_at") >= F.lit(ARRIVED).cast("timestamp")
    new = r.where(late).select("row_id", *triples.REJECTED_KEY)
    return triples.rejected_delta(new, r.where(~late), "row_id")


def pdf_link_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Pages made of article rows, with tags of each kind, escapes, broken ones among them."""
    a = table(spark, d, "article", ["row_id", "pmcid", "url", "pdf_path"]).where("pmcid is not null")
    bare = lambda c: F.regexp_replace(T.text_or_empty(F.col(c)), r"[\"'<>\\#]", "")
    say = F.lit
    html = F.concat(
        say('<html><head><meta content="'), bare("pdf_path"), say('" name="citation_pdf_url"><meta name="x" content="no">'), say("<a class='pdf' href='#top'>PDF</a><a href=\"pdf/"), F.col("row_id").cast("string"), say('.pdf">x</a>'),
        say('<a href="'), bare("url"), say('">Full text</a><a href="mailto:a.pdf">m</a><a href="/downloadPdf?id=1" title="get pdf">d</a>'), say('<div data-pdf-url="/pdf/'), bare("pdf_path"), say('?a=1&amp;b=2">'),
        say("<script>var u = \"https:\\/\\/pmc.ncbi.nlm.nih.gov\\/pdf\\/"), F.col("row_id").cast("string"), say(".pdf\"; load('https://x.example.org/a.full.pdf?v=1')</script><a href="),
    )
    return ingest.pdf_links(a.select("row_id", "pmcid", html.alias("html")), "row_id", "html", T.article_address(F.col("pmcid"))).drop("pos")


def chatlog_update(spark: SparkSession, d: str) -> DataFrame:
    """A log whose answered entries get response and outcome later."""
    log = table(spark, d, "documents", ["doc_id", "text", "source"]).select("doc_id", "source", F.lit(None).cast("string").alias("response"), F.lit(None).cast("boolean").alias("was_success"))
    answers = table(spark, d, "documents", ["doc_id", "text", "source"]).where("source = 'chat_answer'").select("doc_id", T.strip_ws(T.text_or_empty(F.col("text"))).alias("response"), F.lit(True).alias("was_success"))
    return ingest.upsert(log, answers, "doc_id")


def raw_triples_fallback(spark: SparkSession, d: str) -> DataFrame:
    """Responses made of rejected rows, every other with a marker, with noise around."""
    r = table(spark, d, "kg_triples_rejected", ["row_id", *SPO])
    bare = [F.regexp_replace(T.squeeze(F.col(c)), r"[|`*_\x{85}\x{2028}\x{2029}]", "") for c in SPO]
    line = F.concat(F.lit("1. `x` no triple\n  2) **"), bare[0], F.lit("** |"), bare[1], F.lit("| "), bare[2], F.lit(" | more\n\n a | b"))
    text = F.when(F.col("row_id") % 2 == 0, F.concat(F.lit("lead | in | here\n[[RAW_TRIPLES]]\n"), line, F.lit("\n---***---\nq | r | s"))).otherwise(line)
    return r.select("row_id", T.triples_text(text).alias("triples"))


def answer_with_triples(spark: SparkSession, d: str) -> DataFrame:
    """Answers with hidden triples behind them, markers written unevenly; some without."""
    body = F.regexp_replace(T.text_or_empty(F.col("text")), r"\[\[|\]\]", "")
    t = F.when(F.col("doc_id") % 3 == 0, body).otherwise(F.concat(body, F.lit("\n[[ raw_Triples ]]\n a | b | c \n [[KG_SUMMARY]] s")))
    got = T.answer_and_triples(t)
    return table(spark, d, "documents", ["doc_id", "text"]).select("doc_id", got.answer.alias("answer"), got.triples.alias("triples"))


def article_metadata(spark: SparkSession, d: str) -> DataFrame:
    """Article rows written as XML and read again, every tenth broken."""
    a = table(spark, d, "article", ["row_id", "title", "journal", "doi", "pmcid", "pmid", "year", "abstract"])
    clean = lambda c: F.regexp_replace(T.text_or_empty(F.col(c)), r"[^\x{20}-\x{D7FF}\x{E000}-\x{FFFD}\x{10000}-\x{10FFFF}]", " ")
    esc = lambda c: F.replace(F.replace(F.replace(clean(c), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    say = F.lit
    xml = F.concat(
        say('<pmc-articleset><article article-type="research-article"><front><journal-meta><journal-title>'), esc("journal"), say('</journal-title></journal-meta><article-meta><article-id pub-id-type="doi">'), esc("doi"), say('</article-id><article-id pub-id-type="pmc">'), esc("pmcid"),
        say('</article-id><title-group><article-title>'), esc("title"), say('</article-title></title-group><pub-date pub-type="epub"><year>'), esc("year"), say("</year></pub-date><abstract><p>"), esc("abstract"), say("</p></abstract></article-meta></front><body><sec><title>Methods</title><p>"), esc("title"),
        say("</p><sec><title>Results</title><p>r</p></sec></sec><sec><title>Other</title><p>o</p></sec></body></article>"), F.when(F.col("row_id") % 10 == 0, "").otherwise("</pmc-articleset>"),
    )
    got = ingest.parse_articles(a.select("row_id", xml.alias("xml")), "row_id", "xml")
    return got.select("row_id", "ok", "title", "journal", "doi", "pmcid", "year", "kind", "abstract", F.size("sections").alias("n_sections"), F.col("by_section")["Results"].alias("results"), F.array_join(F.array_sort(F.map_keys("by_section")), ",").alias("roles"))


def cache_records(spark: SparkSession, d: str) -> DataFrame:
    """Ingest rows read as cache records: which are current, and what caches they name."""
    r = table(spark, d, "ingest_result", ["row_id", "article_type", "organism", "axis", "ds"]).select(
        "row_id", F.when(F.col("article_type") != "Original", F.lower("article_type")).alias("status"), F.col("organism").alias("model_name"), F.col("axis").alias("kg_signature_hash"), F.nullif("ds", F.lit("No")).alias("cache_name")
    )
    roles = F.array(F.col("model_name"), F.col("cache_name"), F.lit(""), F.col("kg_signature_hash"))
    return r.select("row_id", control.is_current(F.lit("Human"), F.lit("Clinical")).alias("current"), F.array_join(control.cache_names(F.col("cache_name"), roles), ",").alias("names"))


def control_flags(spark: SparkSession, d: str) -> DataFrame:
    """Settings made of ingest rows: what is on, and seconds to live."""
    raw = table(spark, d, "ingest_result", ["row_id", "created", "has_pdf", "has_xml"]).select(
        "row_id", F.col("row_id").alias("kg_cache_ttl_minutes"), F.when(F.col("has_pdf"), "scheduled").when(F.col("has_xml"), "off").otherwise("?").alias("kg_cache_mode"), F.col("created").alias("automated_kg_cache_reset_enabled"), F.col("has_xml").alias("kg_cache_enabled")
    )
    return control.flags(control.normalized_settings(raw)).select("row_id", "reset_on", "cache_open", "ttl_seconds")


def queue_size(spark: SparkSession, d: str) -> DataFrame:
    """How many articles wait."""
    r = table(spark, d, "ingest_result")
    return ingest.ordered_distinct(ingest.queue_candidates(r), "pmcid", "row_id").agg(F.count("*").alias("waiting"))


def article_addresses(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "article", ["row_id", "pmcid"]).where("pmcid is not null").select("row_id", T.article_address(F.col("pmcid")).alias("url"))


QUERIES = {
    f.__name__: f
    for f in (preprint_demotion, rejected_store_delta, pdf_link_candidates, chatlog_update, raw_triples_fallback, answer_with_triples, article_metadata, cache_records, control_flags, queue_size, article_addresses)
}

_IS = f"({D.any_of('h', ['biorxiv', 'bioarxiv', 'bio archive', 'medrxiv', 'medarxiv', 'med archive'])} OR (contains(h, 'preprint') AND (contains(h, 'rxiv') OR contains(h, 'archive'))) OR starts_with(x, '10.1101/') OR starts_with(x, '10.64898/'))"
_SET = ", ".join(f"CASE WHEN p THEN '{v}' ELSE {c} END AS {c}" for c, v in ingest.PREPRINT.items())
_K6 = f"lower(coalesce(Subject, '')) AS s, lower(coalesce(Predicate, '')) AS p, lower(coalesce(Object, '')) AS o, lower(coalesce(Section, '')) AS c, coalesce(PMCID, '') AS i, lower({D.squeeze('Reason')}) AS r"
_VALUE = lambda c: f"lower({D.rep(D.squeeze(c), r'^\|+|\|+$')})"
_BARE = lambda c: f"regexp_replace(coalesce({c}, ''), '[\"''<>\\\\#]', '', 'g')"
_PIPE = lambda c: D.strip(D.rep(D.squeeze(c), "[|`*_\\x{85}\\x{2028}\\x{2029}]"))
_XML = lambda c: f"trim(regexp_replace(regexp_replace(coalesce({c}::VARCHAR, ''), '[^\\x{{20}}-\\x{{D7FF}}\\x{{E000}}-\\x{{FFFD}}\\x{{10000}}-\\x{{10FFFF}}]', ' ', 'g'), '[\\s\\x{{85}}\\x{{A0}}\\x{{1680}}\\x{{2000}}-\\x{{200A}}\\x{{2028}}\\x{{2029}}\\x{{202F}}\\x{{205F}}\\x{{3000}}]+', ' ', 'g'))"

ORACLES = {
    "preprint_demotion": f"WITH o AS ({_SNAP}), h AS (SELECT *, lower({D.strip("coalesce(doi, '')")}) AS x, lower(concat_ws(' ', coalesce(title, ''), coalesce(journal, ''), coalesce(type, ''), lower({D.strip("coalesce(doi, '')")}))) AS h FROM o), m AS (SELECT *, {_IS} AS p FROM h) SELECT pmcid, CASE WHEN p THEN upper(title) ELSE title END AS title, {_SET} FROM m",
    "rejected_store_delta": f"WITH n AS (SELECT row_id, Subject, Predicate, Object, Section, PMCID, Reason, {_K6} FROM kg_triples_rejected WHERE rejected_at >= TIMESTAMP '{ARRIVED}' QUALIFY row_number() OVER (PARTITION BY s, p, o, c, i, r ORDER BY row_id) = 1), "
    f"t AS (SELECT {_VALUE('Subject')} AS s, {_VALUE('Predicate')} AS p, {_VALUE('Object')} AS o, lower({D.section('Section')}) AS c, {D.strip("coalesce(PMCID, '')")} AS i, lower({D.squeeze('Reason')}) AS r FROM kg_triples_rejected WHERE rejected_at < TIMESTAMP '{ARRIVED}') "
    "SELECT row_id, Subject, Predicate, Object, Section, PMCID, Reason FROM n WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.s <> '' AND t.p <> '' AND t.o <> '' AND t.c <> '' AND t.i <> '' AND (t.s, t.p, t.o, t.c, t.i, t.r) = (n.s, n.p, n.o, n.c, n.i, n.r))",
    # the page's links in the order of their kinds, as it is made
    "pdf_link_candidates": f"WITH p AS (SELECT row_id, 'https://pmc.ncbi.nlm.nih.gov/articles/PMC' || pmcid || '/' AS base, {D.strip(_BARE('pdf_path'))} AS meta, {_BARE('pdf_path')} AS path, {D.strip(_BARE('url'))} AS url FROM article WHERE pmcid IS NOT NULL), "
    "l AS (SELECT row_id, base, unnest([meta, 'pdf/' || row_id || '.pdf', url, '/downloadPdf?id=1', '/pdf/' || path || '?a=1&b=2', 'https://x.example.org/a.full.pdf?v=1']) AS x FROM p), "
    "k AS (SELECT row_id, base, x FROM l WHERE x <> '' AND NOT regexp_matches(x, '^(#|javascript:|mailto:)') AND (contains(lower(x), '.pdf') OR contains(lower(x), '/pdf/') OR contains(lower(x), 'downloadpdf'))), "
    "u AS (SELECT DISTINCT row_id, CASE WHEN regexp_matches(x, '(?i)^[a-z][a-z0-9+.-]*:') THEN x WHEN starts_with(x, '//') THEN 'https:' || x WHEN starts_with(x, '/') THEN 'https://pmc.ncbi.nlm.nih.gov' || x ELSE base || x END AS url FROM k) "
    "SELECT row_id, url, (CASE WHEN contains(lower(url), 'pmc.ncbi.nlm.nih.gov') AND contains(lower(url), '/pdf/') THEN 0 WHEN lower(url) LIKE '%.pdf' OR contains(lower(url), '.pdf?') THEN 1 ELSE 2 END)::INT AS priority FROM u",
    "chatlog_update": f"SELECT doc_id, source, CASE WHEN source = 'chat_answer' THEN {D.strip("coalesce(text, '')")} END AS response, CASE WHEN source = 'chat_answer' THEN true END AS was_success FROM documents",
    "raw_triples_fallback": f"SELECT row_id, {_PIPE('Subject')} || ' | ' || {_PIPE('Predicate')} || ' | ' || {_PIPE('Object')} AS triples FROM kg_triples_rejected",
    "answer_with_triples": f"WITH b AS (SELECT doc_id, {D.strip("regexp_replace(coalesce(text, ''), '\\[\\[|\\]\\]', '', 'g')")} AS body FROM documents) SELECT doc_id, body AS answer, CASE WHEN doc_id % 3 = 0 THEN '' ELSE 'a | b | c' END AS triples FROM b",
    "article_metadata": f"WITH a AS (SELECT row_id, row_id % 10 <> 0 AS ok, {_XML('title')} AS t, {_XML('journal')} AS j, {_XML('doi')} AS d, coalesce(pmcid::VARCHAR, '') AS p, year AS y, {_XML('abstract')} AS b FROM article) "
    "SELECT row_id, ok, CASE WHEN ok THEN t END AS title, CASE WHEN ok THEN j END AS journal, CASE WHEN ok THEN d END AS doi, CASE WHEN ok THEN p END AS pmcid, CASE WHEN ok THEN coalesce(y, 1900) END::INT AS year, CASE WHEN ok THEN 'research-article' END AS kind, CASE WHEN ok THEN b END AS abstract, "
    "CASE WHEN ok THEN (2 + (t <> '')::INT + (b <> '')::INT)::INT END AS n_sections, CASE WHEN ok THEN 'Resultsr' END AS results, CASE WHEN ok THEN 'Methods,Results' END AS roles FROM a",
    "cache_records": "SELECT row_id, coalesce((article_type IS NULL OR article_type = 'Original' OR lower(article_type) = 'active') AND organism = 'Human' AND axis = 'Clinical' AND ds <> 'No' AND ds <> '', false) AS current, "
    "array_to_string(list_filter([nullif(ds, 'No'), CASE WHEN organism IS DISTINCT FROM nullif(ds, 'No') THEN organism END, CASE WHEN axis IS DISTINCT FROM nullif(ds, 'No') AND axis IS DISTINCT FROM organism THEN axis END], lambda n: n IS NOT NULL AND n <> ''), ',') AS names FROM ingest_result",
    "control_flags": "WITH s AS (SELECT row_id, least(greatest(coalesce(TRY_CAST(row_id AS INT), 30), 5), 1440) AS m, CASE WHEN has_pdf THEN 'scheduled' WHEN has_xml THEN 'off' ELSE 'on_demand' END AS mode, coalesce(created, false) AS c, coalesce(has_xml, true) AS e FROM ingest_result) SELECT row_id, e AND mode = 'scheduled' AND c AS reset_on, e AND mode <> 'off' AS cache_open, (m * 60)::INT AS ttl_seconds FROM s",
    "queue_size": "SELECT count(DISTINCT pmcid)::BIGINT AS waiting FROM ingest_result WHERE (created OR updated) AND (has_xml OR has_pdf) AND article_type = 'Original' AND ds = 'Yes'",
    "article_addresses": "SELECT row_id, 'https://pmc.ncbi.nlm.nih.gov/articles/PMC' || pmcid || '/' AS url FROM article WHERE pmcid IS NOT NULL",
    "kg_signature": "WITH t AS (SELECT DISTINCT " + ", ".join(f"{D.strip(f"coalesce({c}, '')")} AS {c}" for c in SPO) + " FROM kg_triples_references), h AS (SELECT md5(concat_ws(chr(31), Subject, Predicate, Object)) AS h FROM t) "
    "SELECT count(*)::BIGINT AS edges, sum(('0x' || substr(h, 1, 7))::BIGINT)::BIGINT AS sum_a, sum(('0x' || substr(h, 8, 7))::BIGINT)::BIGINT AS sum_b, bit_xor(('0x' || substr(h, 16, 15))::BIGINT)::BIGINT AS mix FROM h",
}
