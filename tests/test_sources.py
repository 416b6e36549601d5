"""Readers, writers and the queue as a stream."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from quillgraph.operators.ingest import ordered_distinct, queue_candidates
from quillgraph.sources import files, sinks
from quillgraph.streaming.queue import arrivals, queue_stream


def test_delimited(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("Subject,Object,Extra\n\"a, b\",é,1\n,NA,2\n".encode("latin-1"))
    df = files.read_csv(spark, str(tmp_path / "a.csv"), ["Subject", "Object"], encoding="ISO-8859-1")
    assert [tuple(r) for r in df.collect()] == [("a, b", "é"), ("", "NA")]
    with pytest.raises(ValueError, match="missing columns: None_"):
        files.read_csv(spark, str(tmp_path / "a.csv"), ["None_"])
    sinks.write_tsv(df, str(tmp_path / "out"))
    assert files.read_tsv(spark, str(tmp_path / "out"), ["Subject", "Object"]).count() == 2


def test_texts_in_unknown_encoding(spark, tmp_path):
    (tmp_path / "u.txt").write_bytes("﻿α".encode())
    (tmp_path / "l.txt").write_bytes("é".encode("latin-1"))
    got = {r.path.rsplit("/", 1)[1]: r.text for r in files.read_texts(spark, str(tmp_path) + "/*.txt", 5).collect()}
    assert got == {"u.txt": "α", "l.txt": "é"}


def test_json_defaults(spark, tmp_path):
    (tmp_path / "c.json").write_text('{"a": null, "b": 2}')
    assert tuple(files.read_json_records(spark, str(tmp_path / "c.json"), "a int, b int, c string", {"a": 7, "c": "z"}).first()) == (7, 2, "z")


def test_pdf_magic(spark):
    df = spark.createDataFrame([(bytearray(b"%PDF-1"), None), (bytearray(b"<html"), "application/pdf"), (bytearray(b"<html"), "text/html")], "content binary, kind string")
    assert [r[0] for r in df.select(files.is_pdf(F.col("content"), F.coalesce("kind", F.lit("")))).collect()] == [True, True, False]


def test_append_and_snapshots(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.createDataFrame([("A", "x")], "k string, v string").write.parquet(path)
    new = spark.createDataFrame([(1, "new", "v"), (2, "a", "v"), (3, "NEW", "w")], "row_id int, k string, v string")
    for _ in range(2):
        sinks.append_new(new, path, ["k"], "row_id")
    assert sorted(r.k for r in spark.read.parquet(path).collect()) == ["A", "new"]
    root = str(tmp_path / "s")
    sinks.write_snapshot(new, root, "1")
    sinks.write_snapshot(new, root, "2")
    sinks.drop_snapshot(new, root, "1")
    assert spark.read.parquet(root).count() == 3
    sinks.write_csv(spark.createDataFrame([("a\r\nb",)], "r string"), str(tmp_path / "c"), ["r"])
    assert files.read_csv(spark, str(tmp_path / "c"), ["r"]).first()[0] == "a b"


def test_queue_stream(spark, tmp_path):
    src, queue, check = (str(tmp_path / x) for x in ("src", "queue", "check"))
    shape = "row_id bigint, run_at timestamp, pmcid bigint, created boolean, updated boolean, has_pdf boolean, has_xml boolean, article_type string, ds string"
    t = datetime(2025, 1, 1)
    rows = [(1, t, 5, True, None, True, False, "Original", "Yes"), (2, t, 5, False, True, True, False, "Original", "Yes"), (3, t, 6, True, False, False, False, "Original", "Yes"), (4, t, 7, True, False, False, True, "Original", "Yes")]
    spark.createDataFrame(rows, shape).write.parquet(src)
    for _ in range(2):
        q = queue_stream(arrivals(spark, src, spark.createDataFrame([], shape).schema), queue, check)
        q.awaitTermination(60)
        assert q.exception() is None
    assert sorted(r.pmcid for r in spark.read.parquet(queue).collect()) == [5, 7]


def test_queue_stream_keeps_late_rows_and_repeats_nothing(spark, tmp_path):
    src, queue, check = (str(tmp_path / x) for x in ("src", "queue", "check"))
    shape = "row_id bigint, run_at timestamp, pmcid bigint, created boolean, updated boolean, has_pdf boolean, has_xml boolean, article_type string, ds string"
    days = [[(1, datetime(2025, 6, 1), 5)], [(2, datetime(2025, 6, 2), 6)], [(3, datetime(2025, 1, 1), 7)], [(4, datetime(2025, 9, 1), 5), (5, datetime(2025, 9, 1), 8), (6, datetime(2025, 9, 2), 8)]]
    every = []
    for day in days:
        rows = [(*r, True, None, True, False, "Original", "Yes") for r in day]
        every += rows
        spark.createDataFrame(rows, shape).coalesce(1).write.mode("append").parquet(src)
        q = queue_stream(arrivals(spark, src, spark.createDataFrame([], shape).schema), queue, check)
        q.awaitTermination(60)
        assert q.exception() is None
    want = ordered_distinct(queue_candidates(spark.createDataFrame(every, shape)), "pmcid", "row_id")
    got = spark.read.parquet(queue).select("pmcid", "row_id").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want.collect())) == [(5, 1), (6, 2), (7, 3), (8, 5)]


def test_encodings(spark, tmp_path):
    """UTF-8, else Windows-1252, else Latin-1, for texts and for CSV."""
    from quillgraph.sources.files import latest_change, read_csv, read_texts

    texts = {"a": "ü – “x”".encode(), "b": "ü – “x”".encode("cp1252"), "c": "ü \x81".encode("latin-1"), "d": b"\xef\xbb\xbfx"}
    for name, raw in texts.items():
        (tmp_path / f"{name}.txt").write_bytes(raw)
    got = {r.path[-5]: r.text for r in read_texts(spark, f"{tmp_path}/*.txt").collect()}
    assert got == {"a": "ü – “x”", "b": "ü – “x”", "c": "ü \x81", "d": "x"}
    changed = latest_change(spark, f"{tmp_path}/*.txt").first()
    assert changed.newest >= changed.oldest
    for i, encoding in enumerate(("utf-8", "cp1252")):
        (tmp_path / f"{i}.csv").write_bytes("Subject,Note\r\nGen “A”,naïve – x\r\n".encode(encoding))
        assert [tuple(r) for r in read_csv(spark, f"{tmp_path}/{i}.csv", ["Subject", "Note"]).collect()] == [("Gen “A”", "naïve – x")]


def test_a_record_is_written_whole(spark, tmp_path):
    from quillgraph.sources.files import read_json_records
    from quillgraph.sources.sinks import write_record

    path = f"{tmp_path}/control.json"
    write_record(spark, {"kg_cache_mode": "off"}, path, "a")
    told = write_record(spark, {"kg_cache_mode": "scheduled", "kg_cache_ttl_minutes": 60}, path, "b")
    r = read_json_records(spark, path, "kg_cache_mode string, kg_cache_ttl_minutes int, updated_by string, updated_at string", {}).first()
    assert (r.kg_cache_mode, r.kg_cache_ttl_minutes, r.updated_by, r.updated_at) == ("scheduled", 60, "b", told["updated_at"])


def test_exists(spark):
    from quillgraph.operators.ingest import exists

    df = spark.createDataFrame([(1,), (None,)], "pmcid bigint")
    assert exists(df, "pmcid", 1) and not exists(df, "pmcid", 2) and not exists(df.limit(0), "pmcid", 1)
