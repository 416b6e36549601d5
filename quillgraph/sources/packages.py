"""Texts inside containers: archive members, PDF pages, service replies."""

from __future__ import annotations

import io
import tarfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgraph.runtime import ship


def _map_bytes(df: DataFrame, id_col: str, content: str, read) -> DataFrame:
    """``<id_col>, text`` of binary values through ``read``; null for what it can't read."""
    ship(df.sparkSession)
    id_type = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):  # one at a time: a value can be large
                data = batch.column(1)[i].as_py()
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 1), pa.array([read(data) if data else None], pa.string())], names=["id", "text"])

    return df.select(F.col(id_col).alias("id"), F.col(content).alias("data")).mapInArrow(run, f"id {id_type}, text string").withColumnRenamed("id", id_col)


def _article_member(data: bytes) -> str | None:
    try:
        with tarfile.open(fileobj=io.BytesIO(data)) as t:
            names = [m for m in t.getmembers() if m.isfile() and m.name.lower().endswith((".nxml", ".xml"))]
            if not names:
                return None
            best = min(names, key=lambda m: (not m.name.lower().endswith(".nxml"), m.name))
            return t.extractfile(best).read().decode("utf-8", "replace")
    except (tarfile.TarError, OSError, EOFError):
        return None


def package_articles(df: DataFrame, id_col: str, content: str) -> DataFrame:
    """Article XML of archives (tar, compressed or not): an .nxml member before an .xml
    one, by name; null for broken archives and ones without."""
    return _map_bytes(df, id_col, content, _article_member)


def pdf_texts(df: DataFrame, id_col: str, content: str) -> DataFrame:
    """Text of PDF files, pages joined by line breaks, unreadable pages left out.

    Needs the optional package pypdf on the workers; without it the driver says so.
    """
    try:
        import pypdf  # noqa: F401
    except ImportError as e:
        raise RuntimeError("reading PDF files needs the optional package pypdf") from e

    def read(data: bytes) -> str | None:
        import pypdf

        pages = []
        try:
            for page in pypdf.PdfReader(io.BytesIO(data)).pages:
                try:
                    pages.append(page.extract_text() or "")
                except Exception:  # noqa: BLE001, S112 - a bad page is left out
                    continue
        except Exception:  # noqa: BLE001 - not a PDF
            return None
        return "\n".join(pages)

    return _map_bytes(df, id_col, content, read)


def search_ids(reply: Column) -> Column:
    """Ids of a search reply in JSON, in order; [] for anything else."""
    got = F.from_json(reply, "esearchresult struct<idlist:array<string>>")["esearchresult"]["idlist"]
    return F.filter(F.transform(F.coalesce(got, F.array().cast("array<string>")), lambda x: x.try_cast("bigint")), lambda x: x.isNotNull())


def archive_link(reply: Column, kind: str = "pdf") -> Column:
    """Address of the wanted kind in an archive service's XML reply, over https; '' if none."""
    tag = F.regexp_extract(F.coalesce(reply, F.lit("")), rf"(?is)<link\b(?=[^>]*\bformat\s*=\s*[\"']{kind}[\"'])[^>]*>", 0)
    return F.regexp_replace(F.regexp_extract(tag, r"(?i)\bhref\s*=\s*[\"']([^\"']*)[\"']", 1), "^ftp://", "https://")


def chosen_sections(from_xml: Column, from_pdf: Column, least: int = 1000, most: int | None = None) -> Column:
    """Sections by role from XML if they hold ``least`` letters, else the PDF's text, all
    of it (or ``most`` letters) as Discussion; an empty map without either."""
    size = F.aggregate(F.map_values(from_xml), F.lit(0), lambda a, t: a + F.length(t))
    pdf = F.when(F.coalesce(from_pdf, F.lit("")) != "", F.create_map(F.lit("Discussion"), from_pdf if most is None else F.left(from_pdf, F.lit(most))))
    return F.coalesce(F.when(size >= least, from_xml), pdf, F.expr("cast(map() as map<string,string>)"))
