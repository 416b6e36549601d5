"""Hand-made cases and properties of the core operators."""

import random
import time
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from quillgraph import runtime
from quillgraph.functions import text as T
from quillgraph.operators import articles, classify, compact, control, facets, ingest, retrieval, triples
from quillgraph.runtime import frequency_join

SPO = ["Subject", "Predicate", "Object"]


def one(spark, expression, *values):
    df = spark.createDataFrame([(v,) for v in values], "x string")
    return [r[0] for r in df.select(expression(F.col("x"))).collect()]


@pytest.mark.parametrize(
    "function, cases",
    [
        (T.normalize_label, {"  Status \xa0Epilepticus ": "status epilepticus", None: ""}),
        (T.split_camel, {"SCN1AVariant": "scn1 avariant", "a_b/C-d": "a b c d", None: ""}),
        (T.singular, {"oligonucleotides": "oligonucleotide", "studies": "study", "cases": "case", "diseases": "diseas", "class": "class", "mass": "mass"}),
        (T.section, {"Patients and Methods": "Methods", "2. Results": "", "overview": "Introduction", None: ""}),
        (T.section_label, {"2. Results and Discussion": "results", "": "default", None: "default"}),
        (T.predicate_label, {"is associated with": "isAssociatedWith", "treated with": "hasTreatment", "had": "had", "inhibits strongly": "InhibitsStrongly"}),
        (T.entity_label, {"sudden unexpected death": "SuddenUnexpectedDeath", "NaV1.1 channel": "NaV1.1Channel", "SUDEP": "SUDEP", "the  'brain' ": "brain", None: ""}),
        (T.pmcid_number, {"10994531": 10994531, "PMC10994531": 10994531, "x1": None, "": None, None: None}),
        (T.id_list, {"13041439, PMC13052111; 13041439": [13041439, 13052111], "": [], None: []}),
        (T.authors, {"A; B, C": ["A", "B, C"], "A and B": ["A", "B"], "": [], None: []}),
        (T.sanitized, {"a (x KG-grounded y)  b https://q.de/z c": "a b c", None: ""}),
        (T.plain_text, {"# T\n- **b** `c`": "T\nb c", None: ""}),
        (T.finalized, {"[[ANSWER]] yes [[ raw_triples ]] a|b|c": "yes", "x ---***--- y": "x"}),
    ],
)
def test_text(spark, function, cases):
    assert one(spark, function, *cases) == list(cases.values())


def test_marked_sections_and_lines(spark):
    got = one(spark, T.marked_sections, "[[Answer]] a [[KG_SUMMARY]] s\n[[RAW_TRIPLES]] 1. **x** | y | z | w", "none", None)
    assert tuple(got[0]) == ("a", "s", "1. **x** | y | z | w") and tuple(got[1]) == tuple(got[2]) == ("", "", "")
    assert [[tuple(t) for t in r] for r in one(spark, T.triple_lines, "1. **x** | y | z | w\nno bars\n`a|b|c`", None)] == [[("x", "y", "z"), ("a", "b", "c")], []]


def test_answer_and_triples(spark):
    got = one(spark, T.answer_and_triples, " yes [[ RAW_triples ]] a|b|c\n [[KG_SUMMARY]] s", "only", None)
    assert [tuple(g) for g in got] == [("yes", "a|b|c"), ("only", ""), ("", "")]


def test_json_triples(spark):
    row = '[{"subject": "a", "predicate": "b", "object": "c", "section": "Results"}]'
    for text in (row, f"```json\n{row}\n```", f"Here: {row} done"):
        assert [tuple(t) for t in one(spark, T.json_triples, text)[0]] == [("a", "b", "c", "Results")]
    assert one(spark, T.json_triples, '{"subject": "a"}', "not json", "", None) == [[], [], [], []]


def test_review(spark):
    rows = [(1, 5, "Gene X", "causes", "Disease Y", "Introduction"), (2, 5, "gene X", "Causes", "disease Y", "Results"), (3, 5, "Gene X", "causes", "Disease Y", "Discussion"), (4, 5, "study", "had", "x", "Methods"), (5, 6, "Gene X", "causes", "Disease Y", "Methods")]
    got = triples.reviewed(spark.createDataFrame(rows, "row_id int, PMCID int, Subject string, Predicate string, Object string, Section string")).orderBy("row_id").collect()
    assert [r.Reason for r in got] == ["lower_priority_duplicate_replaced", "", "lower_priority_duplicate", "generic_subject;generic_predicate", ""]
    assert [r.reason for r in triples.reason_counts(spark.createDataFrame([("a;b",), ("",), (None,)], "Reason string")).orderBy("reason").collect()] == ["a", "b"]


def test_review_against_a_loop(spark):
    import random

    rng = random.Random(4)
    secs = {"Results": 4, "Methods": 3, "Discussion": 2, "Introduction": 1}
    rows = [(i, rng.randint(1, 3), rng.choice("ab") + "one", "causes", "b", rng.choice(list(secs))) for i in range(150)]
    best, want = {}, {}
    for i, art, s, _, _, sec in rows:
        k = (art, s)
        if k not in best:
            best[k] = (i, sec)
            want[i] = ""
        elif secs[sec] > secs[best[k][1]]:
            want[best[k][0]] = "lower_priority_duplicate_replaced"
            best[k], want[i] = (i, sec), ""
        else:
            want[i] = "lower_priority_duplicate"
    got = triples.reviewed(spark.createDataFrame(rows, "row_id int, PMCID int, Subject string, Predicate string, Object string, Section string"))
    assert {r.row_id: r.Reason for r in got.collect()} == want


def test_delta_applied_twice_is_delta_once(spark):
    new = spark.createDataFrame([(1, "A", "p", "b"), (2, "a", "P", "B"), (3, None, "p", ""), (4, "c", "p", "d")], "row_id int, Subject string, Predicate string, Object string")
    old = spark.createDataFrame([("C", "p", "D")], "Subject string, Predicate string, Object string")
    first = triples.delta(new, old, SPO, "row_id")
    assert [r.row_id for r in first.orderBy("row_id").collect()] == [1, 3]
    assert triples.delta(new, old.unionByName(first.select(*SPO)), SPO, "row_id").count() == 0
    assert triples.normalized(new.withColumn("Section", F.lit("Results"))).count() == 2


def test_compact_round_trip(spark):
    refs = spark.createDataFrame([("b", "p", "a", "Results", "7", 1), ("b ", "p", "a", "Results", "PMC5", 2), ("a", "q", "é", "Methods", "x", 3)], "Subject string, Predicate string, Object string, Section string, PMCID string, ref_id int")
    t = compact.unique_triples(refs)
    n, p = compact.nodes(t), compact.predicates(t)
    assert [(r.node_id, r.label) for r in n.orderBy("label").collect()] == [("n1", "a"), ("n2", "b"), ("n3", "é")]
    e = compact.edges(t, n, p)
    back = compact.resolve(e, n, p).select(*SPO)
    assert back.exceptAll(t).count() == t.exceptAll(back).count() == 0
    assert tuple(compact.stats(t).first()) == (3, 2, 2)
    cand = spark.createDataFrame([(1, "B", " p", "A"), (2, "b", "p", "a"), (3, "b", "q", "a")], "row_id int, Subject string, Predicate string, Object string")
    assert [r.row_id for r in compact.validate(cand, e, n, p, "row_id").collect()] == [1]
    found = compact.references_of(cand, refs, "row_id")
    assert [r.pmcid for r in compact.results_first(found, "row_id").orderBy("later", "first_row", "first_ref").collect()] == [7, 5]
    assert compact.signature(t).collect() == compact.signature(t.repartition(3)).collect()
    assert compact.nodes(t.limit(0)).count() == 0


def test_results_first_order(spark):
    rows = [(1, 5, "Discussion", 1), (1, 3, "Results", 2), (1, 5, "Results", 3), (1, 7, "Methods", 4)]
    got = compact.results_first(spark.createDataFrame(rows, "row_id int, pmcid int, Section string, ref_id int"), "row_id")
    assert [r.pmcid for r in got.orderBy("later", "first_row", "first_ref").collect()] == [3, 5, 7]


def test_facets(spark):
    rows = [("Case report",)] * 2 + [("case series",), (None,), (" ",), ("unknown",), ("review",)]
    got = facets.type_counts(spark.createDataFrame(rows, "type string")).orderBy("type").collect()
    assert [(r.type, r.n, r.pct) for r in got] == [("Case report", 3, 75.0), ("Review", 1, 25.0)]
    df = spark.createDataFrame([(1, date(2025, 1, 1), "100% of", None), (2, None, None, "b")], "row_id int, date date, title string, abstract string")
    assert facets.filter_articles(df, window="week", as_of=date(2025, 1, 8)).count() == 1
    assert facets.filter_articles(df, window="week", as_of=date(2025, 1, 9)).count() == 0
    assert facets.filter_articles(df, text="0% O").count() == 1 and facets.filter_articles(df).count() == 2
    assert facets.type_counts(df.select(F.lit(None).cast("string").alias("type")).limit(0)).count() == 0


def test_rank_articles_scores_every_candidate(spark):
    terms = spark.createDataFrame([(1, ["sodium channel"], ["sodium", "fever"], [])], "qid int, phrases array<string>, anchors array<string>, intents array<string>")
    row = lambda i, more="": (i, f"sodium channel{more}", None, None, None, None, None)
    df = spark.createDataFrame([*[row(i) for i in range(1, 100)], row(500, " in fever")], "pmcid int, title string, abstract string, journal string, first_author string, authors string, year int")
    assert [r.pmcid for r in articles.rank_articles(df, terms, 2).orderBy("rank").collect()] == [500, 1]
    assert [r.pmcid for r in articles.rank_articles(df, terms, 2, articles.REFERENCE_CAPS).orderBy("rank").collect()] == [1, 2]
    one = terms.withColumn("anchors", F.array(F.lit("sodium")))
    more = df.union(spark.createDataFrame([(600, "sodium channel", None, "sodium channel sodium", None, "A", 2020)], df.schema))
    assert [r.pmcid for r in articles.rank_articles(more, one, 1).collect()] == [600]
    assert [r.pmcid for r in articles.rank_articles(more, one, 1, articles.REFERENCE_CAPS).collect()] == [1]


def test_merge_ranked(spark):
    a = spark.createDataFrame([(1, 10, 1), (1, 20, 2)], "qid int, pmcid int, rank int")
    b = spark.createDataFrame([(1, 20, 1), (1, 30, 2), (1, None, 3)], "qid int, pmcid int, rank int")
    assert [(r.pmcid, r.place) for r in articles.merge_ranked([a, b]).orderBy("place").collect()] == [(10, 1), (20, 2), (30, 3)]
    assert articles.merge_ranked([a, b], 2).count() == 2


def test_merge_ranked_fallback(spark):
    shape = "qid int, pmcid int, rank int"
    a = spark.createDataFrame([(1, 10, 1), (1, 20, 2), (2, 10, 1), (2, 10, 2), (4, None, 1), (4, 5, 2)], shape)
    b = spark.createDataFrame([(q, 30, 1) for q in (1, 2, 3, 4)], shape)
    got = sorted((r.qid, r.place, r.pmcid) for r in articles.merge_ranked([a], fallback=b).collect())
    assert got == [(1, 1, 10), (1, 2, 20), (2, 1, 10), (2, 2, 30), (3, 1, 30), (4, 1, 5), (4, 2, 30)]


def test_contains_join(spark):
    texts = spark.createDataFrame([(1, "the cat sat"), (2, "concatenate"), (3, None), (4, "")], "id int, text string")
    terms = spark.createDataFrame([(9, "cat"), (9, "dog"), (8, "cat sat"), (8, "ca")], "qid int, term string")
    assert sorted((r.qid, r.id, r.term) for r in retrieval.contains_join(texts, terms).collect()) == [(8, 1, "cat sat"), (9, 1, "cat"), (9, 2, "cat")]


def test_term_hits_against_all_pairs(spark):
    rng = random.Random(5)
    words = ["the", "seizure", "seizures", "of", "a", "epilepsy", "5", "drug", "xdrug", "", "é\U0001d518"]
    made = lambda n: " ".join(rng.choice(words) for _ in range(n))
    texts = [(i, made(rng.randint(0, 9))) for i in range(300)] + [(300, None), (301, " the  seizure of a drug ")]
    asked = sorted({(made(rng.randint(1, 6)), rng.choice([None, None, "drug", "of"])) for _ in range(200)} | {("he seizure of a", None), ("   ", None), ("eiz", "the")}, key=str)
    got = retrieval.term_hits(spark.createDataFrame(texts, "id int, text string"), spark.createDataFrame(asked * 2, "term string, also string"))
    want = {(t, a, i) for t, a in asked if len(t) >= 3 for i, x in texts if x and len(x) >= 3 and t in x and (a is None or a in x)}
    rows = [tuple(r) for r in got.collect()]
    assert set(rows) == want and len(rows) == len(want)


def test_cut_frees_the_shuffles_of_what_is_written(spark):
    def shuffles():
        files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {n for n in (files.apply(i).getName() for i in range(files.size())) if n.startswith("shuffle_")}

    before = shuffles()
    runtime._RELEASED.clear()
    runtime.cut(spark.range(1000).repartition(3, "id"), "freed")
    made = shuffles() - before
    runtime._RELEASED.clear()
    runtime.cut(spark.range(1), "next")  # by then the plan before is done
    ends = time.monotonic() + 15
    while (left := shuffles() & made) and time.monotonic() < ends:
        time.sleep(0.2)
    assert not left


def test_rank_articles_meets_each_article_once(spark):
    """An article that meets a question by several terms and stages stands once on the list, with the stages it is in."""
    shape = "qid int, phrases array<string>, anchors array<string>, intents array<string>"
    terms = spark.createDataFrame([(1, ["sodium channel", "channel fever"], ["sodium", "fever"], []), (2, ["no such words"], ["fever", "cramp"], []), (3, [], ["absent"], ["chan", "fever"]), (4, ["whole abstract words"], ["rare", "thing"], [])], shape)
    df = spark.createDataFrame([(1, "sodium channel fever", "sodium channel fever", None, None, None, None), (2, "fever", "cramp fever", None, None, None, None), (3, "rare", "a whole abstract words", None, None, None, None)], "pmcid int, title string, abstract string, journal string, first_author string, authors string, year int")
    for caps in (None, articles.REFERENCE_CAPS):
        got = sorted((r.qid, r.rank, r.pmcid, r.score) for r in articles.rank_articles(df, terms, 5, caps).collect())
        assert got == [(1, 1, 1, 1600 + 240 + 70 + 250 + 500 + 200 + 40 + 2.0), (2, 1, 2, 120 + 35 + 40 + 2.0), (4, 1, 3, 120 + 35 + 40 + 2.0)]


def test_idf(spark):
    docs = retrieval.documents(spark.createDataFrame([(i, "Gene" if i < 3 else f"Thing{i}x", "p", "q") for i in range(10)], "ref_id int, Subject string, Predicate string, Object string"), "ref_id")
    got = {r.token: r.idf for r in retrieval.inverse_frequency(docs).collect()}
    assert abs(got["gene"] - 2.0116009116784799) < 1e-9


def test_preprints(spark):
    df = spark.createDataFrame([("T", "bioRxiv", None, None), ("T", "J", "preprint rxiv", ""), ("T", "J", "", " 10.1101/9 "), ("T", None, None, "10.1/1")], "t string, j string, k string, d string")
    assert [r[0] for r in df.select(classify.is_preprint(*[F.col(c) for c in "tjkd"])).collect()] == [True, True, True, False]


def test_classify(spark):
    df = spark.createDataFrame([("Dravet syndrome in mice", "We studied patients with Dravet syndrome.", "A mouse model of seizures."), (None, None, None)], "title string, abstract string, body string")
    df = df.withColumn("sections", ingest.plain_sections([("title", F.col("title")), ("abstract", F.col("abstract")), ("default", F.col("body"))]))
    got = classify.classify(df).collect()
    assert got[0].ds_read == "Yes" and got[1].ds_read == "No" and got[1].organism_read == ""
    tie = spark.createDataFrame([("a systematic review",)], "x string").select(classify.article_type(F.col("x"))["label"]).first()[0]
    assert tie == "Review"


def test_classify_reads_whole_bodies(spark):
    df = spark.createDataFrame([("x " * 9000 + "Dravet syndrome in a mouse with sudden death. Case report.",)], "body string").selectExpr("'A' title", "'' abstract", "body")
    first = lambda chars: df.select(classify.first_reading(F.col("title"), F.col("abstract"), F.col("body"), F.lit(""), chars).alias("r")).select("r.*").first()
    assert first(None).ds == "Yes" and "Mouse" in first(None).organism
    assert first(classify.REFERENCE_CHARS).ds == "No"
    df = df.withColumn("sections", ingest.plain_sections([("title", F.col("title")), ("default", F.col("body"))]))
    assert classify.classify(df).first().type_read == "Case report"
    assert classify.classify(df, chars=classify.REFERENCE_CHARS).first().type_read == "Original"


def test_stored_values_fall_back(spark):
    df = spark.createDataFrame([("Rat larvae", "", "")], "title string, abstract string, body string").withColumn("sections", F.expr("cast(array() as array<struct<label:string,text:string,weight:double>>)"))
    r = classify.classify(df).first()
    assert (r.organism_read, r.axis_read) == ("", "") and r.organism_stored == "Zebrafish, Rat" and r.axis_stored == "Other"
    assert (r.type_stored, r.ds_stored) == (r.type_read, r.ds_read)


def test_sections_are_whole():
    from quillgraph.sources.jats import read_article

    xml = f"<article><body><sec><title>Methods</title><p>{'m' * 20_000}</p></sec></body></article>"
    assert len(dict(read_article(xml)["by_section"])["Methods"]) == 20_007
    assert len(dict(read_article(xml, 18_000)["by_section"])["Methods"]) == 18_000


def test_settings(spark):
    df = spark.createDataFrame(
        [("5000", "1", "weird", True, None, "09:00", " "), ("x", None, "scheduled", True, "", None, "UTC"), (None, "9999", "Scheduled", True, "07:00", "09:00", None)],
        "pmc_sync_retmax string, kg_cache_ttl_minutes string, kg_cache_mode string, automated_kg_cache_reset_enabled boolean, kg_cache_scheduled_time string, kg_cache_reset_time string, timezone string",
    )
    got = [tuple(r) for r in control.normalized_settings(df).collect()]
    assert got == [
        (1000, 5, "on_demand", False, "09:00", "09:00", "America/New_York"),
        (200, 30, "scheduled", True, "08:00", "08:00", "UTC"),
        (200, 1440, "on_demand", False, "07:00", "07:00", "America/New_York"),
    ]


def test_upsert_and_queue(spark, rows):
    old = spark.createDataFrame([(1, "a", "x"), (2, "b", "y")], "pmcid int, ds string, type string")
    new = spark.createDataFrame([(2, None), (3, "c"), (None, "d")], "pmcid int, ds string")
    assert rows(ingest.upsert(old, new, "pmcid")) == [(1, "a", "x"), (2, None, "y"), (3, "c", None)]
    queue = spark.createDataFrame([(5, 1), (6, 2), (5, 3), (None, 4)], "pmcid int, row_id int")
    head, rest = ingest.pop(ingest.ordered_distinct(queue, "pmcid", "row_id"), "row_id", 1)
    assert rows(head) == [(5, 1)] and rows(rest) == [(6, 2)]


def test_links(spark):
    html = '<meta content="/pmc/a.pdf"><a href=\'x.pdf?y=1&amp;z=2#p\'>x</a><a href="mailto:q">m</a><a href="https:\\/\\/h.org\\/b">b</a><a href="x.pdf?y=1&amp;z=2">x</a>'
    got = ingest.page_links(spark.createDataFrame([(1, html), (2, None)], "id int, html string"), "id", "html", "https://b.org").orderBy("priority", "pos").collect()
    assert [(r.url, r.priority) for r in got] == [("https://b.org/pmc/a.pdf", 0), ("https://b.org/x.pdf?y=1&z=2", 1), ("https://h.org/b", 2)]


def test_frequency_join(spark):
    rows = spark.createDataFrame([("hot", i) for i in range(3000)] + [(f"c{i % 50}", i) for i in range(500)] + [(None, 1), ("none", 2)], "k string, v int")
    lookup = spark.createDataFrame([("hot", 3000, "H")] + [(f"c{i}", 10, f"C{i}") for i in range(50)], "k string, n int, val string")
    got = frequency_join(rows, lookup, "k", "n")
    assert got.count() == 3500 and got.where("val is null").count() == 0
    assert frequency_join(rows, lookup.limit(0), "k", "n").count() == 0


def test_article_xml(spark):
    xml = """<!DOCTYPE article PUBLIC "x" "http://no.where/a.dtd"><pmc-articleset><article article-type="research-article"><front><article-meta><article-id pub-id-type="doi">10.1/x</article-id><article-title>A <i>b</i> c</article-title>
    <contrib-group><contrib contrib-type="author"><name><surname>Roe</surname><given-names>Jane</given-names></name></contrib></contrib-group><pub-date pub-type="epub"><year>2024</year></pub-date><abstract><p>Short.</p></abstract></article-meta></front>
    <body><sec><title>Methods</title><p>m</p><sec><title>Detail</title><p>d</p></sec></sec><sec><title>Odd</title><p>o</p></sec></body></article></pmc-articleset>"""
    got = {r.id: r for r in ingest.parse_articles(spark.createDataFrame([(1, xml), (2, "<broken"), (3, None), (4, "<article><body>all</body></article>")], "id int, xml string"), "id", "xml").collect()}
    a = got[1]
    assert (a.ok, a.title, a.doi, a.authors, a.year, a.abstract, a.kind) == (True, "A b c", "10.1/x", ["Roe Jane"], 2024, "Short.", "research-article")
    assert [s.label for s in a.sections] == ["title", "abstract", "methods", "default"] and list(a.by_section) == ["Methods"]
    assert a.by_section["Methods"] == "MethodsmDetaild\n\nDetaild" and a.date == date(2024, 1, 1)
    assert not got[2].ok and not got[3].ok and got[4].by_section == {"Discussion": "all"} and got[4].date == date(1900, 1, 1)
    assert datetime is not None


def test_merged_queries_share_what_both_lists_need(spark, monkeypatch):
    """F2, F8: the driver held the plans of questions, triples and focus once for each list of one query."""
    from quillgraph.plans import graph_queries

    made, empty = [], spark.createDataFrame([], "qid bigint, pmcid bigint, rank int")
    counted = lambda name, gives: lambda *a, **k: made.append(name) or gives
    monkeypatch.setattr(graph_queries, "_sought", counted("sought", (None, None, None, (None, None))))
    monkeypatch.setattr(graph_queries, "_ranked", counted("ranked", empty))
    monkeypatch.setattr(graph_queries, "references", counted("references", None))
    for name in ("scored", "selected", "article_rank"):
        monkeypatch.setattr(graph_queries.retrieval, name, counted(name, empty))
    for query in (graph_queries.merge_ranked_ids, graph_queries.merge_ranked_fallback):
        made.clear()
        assert query(spark, "").count() == 0
        assert sorted(made) == ["article_rank", "ranked", "references", "scored", "selected", "sought"]


def test_fallback_searches_the_graph_only_for_what_lacks_articles(spark, monkeypatch):
    """F8: all questions were held against the graph, though only those with fewer than two articles take what it finds."""
    from quillgraph.plans import graph_queries

    shape, without = "qid bigint, pmcid bigint, rank int", []
    ranked = spark.createDataFrame([(1, 10, 1), (1, 20, 2), (2, 10, 1), (2, 10, 2), (4, None, 1), (4, 5, 2)], shape)
    monkeypatch.setattr(graph_queries, "_sought", lambda *a: (None, None, None, (None, None)))
    monkeypatch.setattr(graph_queries, "_ranked", lambda *a, **k: ranked)
    monkeypatch.setattr(graph_queries, "references", lambda *a: None)
    monkeypatch.setattr(graph_queries.retrieval, "scored", lambda *a, **k: without.append(k.get("without")))
    monkeypatch.setattr(graph_queries.retrieval, "selected", lambda found: found)
    monkeypatch.setattr(graph_queries.retrieval, "article_rank", lambda *a: spark.createDataFrame([(q, 30, 1) for q in (2, 3, 4)], shape))
    got = sorted((r.qid, r.place, r.pmcid) for r in graph_queries.merge_ranked_fallback(spark, "").collect())
    assert got == [(1, 1, 10), (1, 2, 20), (2, 1, 10), (2, 2, 30), (3, 1, 30), (4, 1, 5), (4, 2, 30)]
    assert [r.qid for r in without.pop().collect()] == [1]
    graph_queries.merge_ranked_ids(spark, "")
    assert without == [None]


def test_release_does_not_wait_while_the_heap_fills(spark, monkeypatch):
    """F8: plans of short jobs filled the driver's heap between two rounds."""
    rounds = []
    monkeypatch.setattr(runtime.gc, "collect", lambda: rounds.append(1))
    runtime.release(spark)
    rounds.clear()
    monkeypatch.setattr(runtime, "RELEASE_S", 1e6)
    for share, n in ((1.0, 0), (0.0, 1)):
        monkeypatch.setattr(runtime, "RELEASE_SHARE", share)
        runtime.release(spark)
        assert len(rounds) == n
