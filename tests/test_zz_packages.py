"""Archives, service replies, the choice between XML and PDF."""

import io
import tarfile

import pytest
from pyspark.sql import functions as F

from quillgraph.runtime import cleanup, cut
from quillgraph.sources import packages


def archive(**members):
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w:gz") as t:
        for name, text in members.items():
            data = text.encode()
            info = tarfile.TarInfo(name.replace("_", "."))
            info.size = len(data)
            t.addfile(info, io.BytesIO(data))
    return bytearray(out.getvalue())


def test_archives(spark):
    rows = [(1, archive(a_xml="<x/>", b_nxml="<n>é</n>")), (2, archive(a_txt="t")), (3, bytearray(b"no archive")), (4, None), (5, archive(z_xml="<z/>"))]
    got = packages.package_articles(spark.createDataFrame(rows, "id int, content binary"), "id", "content")
    assert {r.id: r.text for r in got.collect()} == {1: "<n>é</n>", 2: None, 3: None, 4: None, 5: "<z/>"}


def test_replies(spark):
    df = spark.createDataFrame([('{"esearchresult": {"idlist": ["12", "x", "7"]}}', '<OA><link format="tgz" href="ftp://a/b.tgz"/><link href=\'ftp://a/b.pdf\' format="pdf"/></OA>'), ("broken", None), (None, "<OA/>")], "j string, x string")
    got = df.select(packages.search_ids(F.col("j")), packages.archive_link(F.col("x"))).collect()
    assert [tuple(r) for r in got] == [([12, 7], "https://a/b.pdf"), ([], ""), ([], "")]


def test_choice(spark):
    df = spark.createDataFrame([({"Methods": "m" * 1200}, "pdf"), ({"Methods": "short"}, "pdf"), (None, None)], "s map<string,string>, p string")
    got = [r[0] for r in df.select(packages.chosen_sections(F.col("s"), F.col("p"))).collect()]
    assert got == [{"Methods": "m" * 1200}, {"Discussion": "pdf"}, {}]


def test_pdf_needs_its_package(spark):
    df = spark.createDataFrame([(1, bytearray(b"x"))], "id int, content binary")
    try:
        import pypdf  # noqa: F401
    except ImportError:
        with pytest.raises(RuntimeError, match="pypdf"):
            packages.pdf_texts(df, "id", "content")
    else:
        assert packages.pdf_texts(df, "id", "content").first().text is None


def test_cleanup_comes_last(spark):
    df = cut(spark.range(3), "gone")
    assert df.count() == 3 and cleanup(spark) >= 1
