"""Ingest: upsert snapshots, outcome counts, the extraction queue, links of pages, XML articles."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgraph.functions import constants as C
from quillgraph.functions import text as T
from quillgraph.runtime import ship


def upsert(old: DataFrame, new: DataFrame, key: str, order: str | None = None) -> DataFrame:
    """The snapshot after an upsert: rows of ``new`` replace or join those of ``old``.

    Columns that ``new`` lacks keep their old value; of several new rows with one key the
    last by ``order`` counts (a unique column of ``new`` that isn't stored), without one the
    last by all columns; null keys of ``new`` are left out.
    """
    cols = [c for c in new.columns if c not in (key, order)]
    last = F.max_by(F.struct(*cols), order) if order else F.max(F.struct(*cols))
    one = new.where(F.col(key).isNotNull()).groupBy(key).agg(last.alias("__n"))
    both = old.join(one, key, "full_outer")
    take = {c: F.when(F.col("__n").isNotNull(), F.col(f"__n.{c}")).otherwise(F.col(c)) if c in old.columns else F.col(f"__n.{c}") for c in cols}
    return both.select(*[take.get(c, F.col(c)).alias(c) for c in old.columns], *[take[c].alias(c) for c in cols if c not in old.columns])


# What an article that turns out to be a preprint is stored as.
PREPRINT = {"type": "Preprint", "ds": "No", "organism": "", "axis": "", "pdf_path": "", "fulltext_path": "", "fulltext_format": ""}


def demote_preprints(old: DataFrame, preprints: DataFrame, key: str) -> DataFrame:
    """``old`` with the articles named in ``preprints`` made ineligible: they take the
    metadata of ``preprints`` (one row a key) and the PREPRINT values.  Preprints that
    aren't stored aren't added."""
    told = [c for c in preprints.columns if c != key and c in old.columns and c not in PREPRINT]
    new = preprints.where(F.col(key).isNotNull()).select(key, F.struct(F.lit(True).alias("__is"), *told).alias("__p"))
    is_one = F.coalesce(F.col("__p.__is"), F.lit(False))
    take = {c: F.when(is_one, F.col(f"__p.{c}")).otherwise(F.col(c)) for c in told} | {c: F.when(is_one, F.lit(v)).otherwise(F.col(c)) for c, v in PREPRINT.items() if c in old.columns}
    return old.join(new, key, "left").select(*[take.get(c, F.col(c)).alias(c) for c in old.columns])


def exists(df: DataFrame, key: str, value: object) -> bool:
    """Is there a row with this key?"""
    return not df.where(F.col(key) == F.lit(value)).limit(1).isEmpty()


def outcome(created: Column, updated: Column, duplicate: Column, preprint: Column) -> Column:
    """What became of an article: the first of preprint, duplicate, created, updated."""
    yes = lambda c: F.coalesce(c, F.lit(False))
    return F.when(yes(preprint), "skipped_preprint").when(yes(duplicate), "skipped_duplicate").when(yes(created), "created").when(yes(updated), "updated").otherwise("none")


def outcome_counts(results: DataFrame) -> DataFrame:
    """``outcome, n``."""
    return results.groupBy(outcome(*[F.col(c) for c in ("created", "updated", "skipped_duplicate", "skipped_preprint")]).alias("outcome")).agg(F.count("*").alias("n"))


def queue_candidates(results: DataFrame) -> DataFrame:
    """Newly stored original articles on topic with a text: ``pmcid, row_id``."""
    stored = F.coalesce("created", F.lit(False)) | F.coalesce("updated", F.lit(False))
    text = F.coalesce("has_xml", F.lit(False)) | F.coalesce("has_pdf", F.lit(False))
    return results.where(stored & text & (F.col("article_type") == "Original") & (F.col("ds") == "Yes") & F.col("pmcid").isNotNull()).select("pmcid", "row_id")


def ordered_distinct(df: DataFrame, key: str, order: str) -> DataFrame:
    """Each key once at its first place."""
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(order).alias(order))


def pop(queue: DataFrame, order: str, n: int) -> tuple[DataFrame, DataFrame]:
    """The first n of a queue, and the rest."""
    head = queue.orderBy(order).limit(n)
    return head, queue.join(head.select(order), order, "left_anti").select(*queue.columns)


def without(df: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows whose key isn't in ``done``."""
    return df.join(done.select(key).distinct(), key, "left_anti").select(*df.columns)


def page_links(pages: DataFrame, id_col: str, html: str, base: str = "") -> DataFrame:
    """``<id_col>, url, priority, pos``: links of a page, each once, in order of use.

    Escapes are undone, fragments dropped, relative links joined to ``base``; links to a
    PDF of the archive come first, other PDFs second.
    """
    raw = F.regexp_extract_all(T.text_or_empty(F.col(html)), F.lit(r"(?is)(?:href|src|content|data-[\w-]*url|value)\s*=\s*[\"']([^\"'<>]+)[\"']"))
    each = pages.select(id_col, F.posexplode(raw).alias("pos", "link"))
    link = T.strip_ws(F.regexp_replace(F.replace(F.replace("link", F.lit("\\/"), F.lit("/")), F.lit("&amp;"), F.lit("&")), "#.*$", ""))
    full = F.when(link.rlike("(?i)^https?://"), link).when(link.startswith("//"), F.concat(F.lit("https:"), link)).when(link.startswith("/"), F.concat(F.lit(base), link)).otherwise(F.concat(F.lit(base + "/"), link))
    low = F.lower("url")
    priority = F.when(low.contains("/pmc/") & low.contains("pdf"), 0).when(low.rlike(r"\.pdf(?:\?|$)"), 1).otherwise(2)
    found = each.withColumn("ok", (link != "") & ~link.rlike("(?i)^(?:mailto|javascript|data):")).where("ok").select(id_col, "pos", full.alias("url"))
    return found.groupBy(id_col, "url").agg(F.min("pos").alias("pos")).select(id_col, "url", priority.alias("priority"), "pos")


def pdf_links(pages: DataFrame, id_col: str, html: str, address: Column | str) -> DataFrame:
    """``<id_col>, url, priority, pos``: links of a page to PDF files, each once.

    From meta tags, then links, then any attribute, then quoted addresses anywhere; a link
    counts if it names a PDF.  Relative ones are joined to the page's ``address`` (which
    ends in a slash).  Those on the archive's own host come first, files by name second;
    among equals the place in the page decides.  Order by priority and pos.
    """
    attribute = lambda tag, name: F.regexp_extract(tag, rf"(?is)\b{name}\s*=\s*(?:\"([^\"]*)\"|'([^']*)')", 1)
    either = lambda tag, name: F.concat(attribute(tag, name), F.regexp_extract(tag, rf"(?is)\b{name}\s*=\s*'([^']*)'", 1))
    low, page = F.lower, T.text_or_empty(F.col(html))
    has_pdf = lambda c: low(c).contains(".pdf") | low(c).contains("/pdf/")
    metas = F.filter(
        F.transform(F.regexp_extract_all(page, F.lit(r"(?is)(<meta\b[^>]*>)")), lambda t: F.struct(low(F.concat(either(t, "name"), either(t, "property"))).alias("name"), T.strip_ws(either(t, "content")).alias("link"))),
        lambda m: m["name"].contains("pdf") | low(m["link"]).endswith(".pdf"),
    )
    anchors = F.filter(
        F.transform(F.regexp_extract_all(page, F.lit(r"(?is)(<a\b[^>]*>.*?</a>)")), lambda t: F.struct(low(t).alias("all"), T.strip_ws(either(t, "href")).alias("link"))),
        lambda a: has_pdf(a["link"]) | F.regexp_replace(a["all"], r"(?s)\bhref\s*=\s*(?:\"[^\"]*\"|'[^']*')", "").contains("pdf"),
    )
    tags = F.flatten(F.transform(F.regexp_extract_all(page, F.lit(r"(?is)(<[a-z][^>]*>)")), lambda t: F.regexp_extract_all(t, F.lit(r"(?is)([\w:-]+\s*=\s*(?:\"[^\"]*\"|'[^']*'))"))))
    attributes = F.filter(
        F.transform(tags, lambda x: F.struct(low(F.regexp_extract(x, r"^([\w:-]+)", 1)).alias("name"), F.regexp_extract(x, r"(?s)=\s*[\"'](.*)[\"']$", 1).alias("link"))), lambda a: a["name"].contains("pdf") | has_pdf(a["link"])
    )
    quoted = [r"(?i)[\"'](https?://[^\"']+?\.pdf(?:\?[^\"']*)?)[\"']", r"(?i)[\"'](/[^\"']+?\.pdf(?:\?[^\"']*)?)[\"']", r"(?i)[\"'](pdf/[^\"']+?\.pdf(?:\?[^\"']*)?)[\"']", r"(?i)(https?://[^\s\"'<>]+?\.full\.pdf(?:\?[^\s\"'<>]*)?)"]
    links = F.concat(*[F.transform(c, lambda x: x["link"]) for c in (metas, anchors, attributes)], *[F.regexp_extract_all(page, F.lit(q), 1) for q in quoted])
    base = F.lit(address) if isinstance(address, str) else address
    each = pages.select(id_col, base.alias("base"), F.posexplode(links).alias("pos", "raw"))
    each = each.withColumn("link", F.replace(F.replace(T.strip_ws(F.col("raw")), F.lit("\\/"), F.lit("/")), F.lit("&amp;"), F.lit("&")))
    named = has_pdf(F.col("link")) | low("link").contains("downloadpdf")
    each = each.where((F.col("link") != "") & ~F.col("link").rlike("^(?:#|javascript:|mailto:)") & named)
    host = F.regexp_extract("base", r"^(https?://[^/]+)", 1)
    scheme = F.regexp_extract("base", r"^(https?:)", 1)
    url = F.when(F.col("link").rlike("(?i)^[a-z][a-z0-9+.-]*:"), F.col("link")).when(F.col("link").startswith("//"), F.concat(scheme, "link")).when(F.col("link").startswith("/"), F.concat(host, "link")).otherwise(F.concat("base", "link"))
    once = each.select(id_col, "pos", url.alias("url")).groupBy(id_col, "url").agg(F.min("pos").alias("pos"))
    small = low("url")
    priority = F.when(small.contains("pmc.ncbi.nlm.nih.gov") & small.contains("/pdf/"), 0).when(small.endswith(".pdf") | small.contains(".pdf?"), 1).otherwise(2)
    return once.select(id_col, "url", priority.alias("priority"), "pos")


SECTION_SHAPE = "array<struct<label:string,text:string,weight:double>>"
ARTICLE_SHAPE = f"title string, abstract string, journal string, authors array<string>, doi string, pmcid string, pmid string, year int, date date, kind string, subjects array<string>, sections {SECTION_SHAPE}, by_section map<string,string>, body string"


def parse_articles(df: DataFrame, id_col: str, xml: str, most: int | None = None) -> DataFrame:
    """Article XML to columns: ``<id_col>, ok`` and ARTICLE_SHAPE.

    Sections nest, so this one operator parses in Python, in Arrow batches.  Document
    types are cut off first (nothing is fetched); broken or null XML gives ``ok`` =
    false and nulls.  Sections by role are whole, or of ``most`` letters.
    """
    ship(df.sparkSession)
    id_type = df.schema[id_col].dataType.simpleString()
    schema = pa.schema(
        [
            ("ok", pa.bool_()), ("title", pa.string()), ("abstract", pa.string()), ("journal", pa.string()), ("authors", pa.list_(pa.string())), ("doi", pa.string()), ("pmcid", pa.string()), ("pmid", pa.string()),
            ("year", pa.int32()), ("date", pa.date32()), ("kind", pa.string()), ("subjects", pa.list_(pa.string())), ("sections", pa.list_(pa.struct([("label", pa.string()), ("text", pa.string()), ("weight", pa.float64())]))),
            ("by_section", pa.map_(pa.string(), pa.string())), ("body", pa.string()),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from quillgraph.sources.jats import read_article

        for batch in batches:
            rows = [read_article(x, most) for x in batch.column(1).to_pylist()]
            cols = [pa.array([r.get(f.name) for r in rows], f.type) for f in schema]
            yield pa.RecordBatch.from_arrays([batch.column(0), *cols], names=["id", *schema.names])

    return df.select(F.col(id_col).alias("id"), F.col(xml).alias("xml")).mapInArrow(run, f"id {id_type}, ok boolean, {ARTICLE_SHAPE}").withColumnRenamed("id", id_col)


def plain_sections(columns: Sequence[tuple[str, Column]]) -> Column:
    """Sections of an article without XML: (label, text) with the label's weight."""
    items = [F.struct(F.lit(label).alias("label"), T.text_or_empty(c).alias("text"), F.lit(C.SECTION_WEIGHTS[label]).alias("weight")) for label, c in columns]
    return F.filter(F.array(*items), lambda s: s["text"] != "")
