"""Residue: held-out lines of either kind, windows, the Spark plan against plain Python."""

import math
import time
from collections import Counter

import pytest
import residue_lines as L
from pyspark.sql import functions as F

from quillgraph.llm.residue import COVERAGE, WINDOW, Index, document_frequencies, lines_ended, lines_of, pieces, residue_documents, residue_windows, sentences, tokens, without_residue

CONTENT = [
    "Seizure frequency fell in most children after the dose was raised.", "Parents kept a diary for twelve weeks and sleep improved.", "Two raters scored video recordings independently of the clinic visit.", "Recordings from neurons showed a sustained increase of firing.",
    "Variants were found in a third of the families in the registry.", "The committee approved the protocol and all families gave consent.", "Serum levels rose after the second drug was added to the first.", "Future work should compare both drugs in adults with late onset.",
]
RESIDUE = [
    "You must switch on JavaScript on this device to read the full text.", "Error 502: Bad Gateway", "Lorem ipsum dolor elit tempor magna aliqua sed veniam nostrud.", "Title: ${article_name}", "Dear [INSERT author HERE], your manuscript @@title@@ has been received by <<journal>>.",
    "The requested file could not be located on this server.", "asdf asdf asdf asdf", "Sample text for the table. Replace it with your own words.", "Veuillez autoriser JavaScript dans votre navigateur pour lire l’article.", "Uncaught TypeError: x is undefined (viewer.js:1:2)",
    "Your session has expired. Please sign in again to continue.", "<%= summary %>", "This service is down for maintenance. Back at 3:00.", "本文を読むには、ブラウザのJavaScriptをオンにしてください。",
]
MENTIONS = [
    "Of the caregivers, 12% had to enable JavaScript before the diary opened; training solved this within days.", "Error rates were low; error 404 in the log denotes a lost electrode of the montage.", "Reading of filler text (lorem ipsum) served as the control task for children in both arms.",
    "Records that held an unfilled field such as {{age}} were returned to the site and completed by nurses.", "Access was denied to nine requests for the registry, which lowers the response rate of families.", "Let $x_{i}$ be the count in week i and \\frac{{a}}{{b}} the ratio of both.",
]
PLAIN = ["Home | Browse | About | Contact", "Skip to main content", "Results", "Copyright notice. All rights reserved."]
SHAPE = "doc_id bigint, text string, containment string"


@pytest.fixture(scope="module")
def corpus(spark):
    rows = [(i, " ".join(CONTENT[(i + k) % len(CONTENT)] for k in range(3)), "x") for i in range(160)]
    rows += [(1000 + i, t, "x") for i, t in enumerate(RESIDUE)]
    rows += [(2000 + i, f"{CONTENT[i % 8]}\n\n{t}\n{CONTENT[(i + 1) % 8]}", "x") for i, t in enumerate(RESIDUE)]
    rows += [(3000 + i, f"{CONTENT[i % 8]} {t} {CONTENT[(i + 2) % 8]}", "x") for i, t in enumerate(MENTIONS)]
    rows += [(4000 + i, f"{t}\n{CONTENT[i % 8]}", "x") for i, t in enumerate(PLAIN)]
    rows += [(5000, None, "x"), (5001, "", "x"), (5002, " \n\t", "x"), (5003, (CONTENT[0] + " ") * 3000, "x"), (5004, (CONTENT[1] + "\n") * 2000 + RESIDUE[0], "x"), (1000, RESIDUE[0], "x"), (None, RESIDUE[1], "x")]
    return spark.createDataFrame(rows, SHAPE)


def test_found(corpus):
    found = [r.doc_id for r in residue_documents(corpus, "doc_id", "text").collect()]
    want = {1000 + i for i in range(len(RESIDUE))} | {2000 + i for i in range(len(RESIDUE))} | {5004, None}
    assert set(found) == want and len(found) == len(want)


def test_rest_keeps_all_columns(corpus):
    rest = without_residue(corpus, "doc_id", "text")
    assert rest.columns == corpus.columns
    assert rest.where("doc_id between 1000 and 2999").count() == 0 and rest.where("doc_id >= 3000").count() == corpus.where("doc_id >= 3000").count() - 1


def passages(index, text):
    lines = lines_of(text)
    return list(index.passages(lines, *index.retrieved({t for _, found in lines for t in found})))


def containments(freq, n, index, text):
    out = []
    for every, held in passages(index, text):
        weight = {t: k * (math.log((n + 1) / (freq[t] + 1)) + 0.1) for t, k in every.items()}
        out.append(sum(weight[t] * held[t] / every[t] for t in weight) / sum(weight.values()))
    return out


def test_against_plain_python(corpus):
    df = corpus.where("text is not null and doc_id < 5000").select("doc_id", "text").distinct()
    rows = df.collect()
    freq = Counter(t for r in rows for t in set(tokens(lines_ended(r.text))))
    assert {r.token: r.df for r in document_frequencies(df, "text").collect()} == dict(freq)
    index = Index()
    want = {(r.doc_id, k): c for r in rows for k, c in enumerate(containments(freq, len(rows), index, r.text))}
    got = {(r.id, r.window): r.containment for r in residue_windows(df, "doc_id", "text").collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in got)


def test_retrieval_loses_no_exemplar():
    """Every exemplar that a sentence fits is retrieved through the index."""
    index = Index()
    lines = [x for part in (L.DEV, L.DEV_2, L.DEV_3, L.DEV_4, L.HELD_OUT) for f in part.values() for x in f] + MENTIONS + CONTENT + RESIDUE
    for line in lines:
        found = Counter(tokens(line))
        assert {id(e) for e in index.retrieved(set(found))[0]} >= {id(e) for e in index.exemplars if e.fits(found)}


@pytest.mark.parametrize("part, recall", [("DEV", 0.95), ("DEV_2", 0.95), ("DEV_3", 0.93), ("DEV_4", 0.93), ("HELD_OUT", 0.89)])
def test_labelled_lines(spark, part, recall):
    """Recall and precision on lines split by family; HELD_OUT had no part in the exemplars."""
    docs = [r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").where("text is not null").collect()]
    freq = Counter(t for text in docs for t in set(tokens(lines_ended(text))))
    index = Index()
    found = lambda line: max(containments(freq, len(docs), index, line), default=0.0) >= COVERAGE
    lines = [x for f in getattr(L, part).values() for x in f]
    hits, wrong = sum(map(found, lines)), sum(map(found, getattr(L, f"{part}_PLAIN")))
    assert hits / len(lines) >= recall and hits / (hits + wrong) >= 0.95


def test_words_scattered_over_exemplars_add_up_to_nothing(spark):
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(L.DEV_PLAIN[:3])], SHAPE)
    assert residue_documents(df.unionByName(spark.createDataFrame([(9, RESIDUE[0], "x")], SHAPE)), "doc_id", "text").collect()[0].doc_id == 9


def test_windows_cover_everything():
    line = " ".join("w" + "abcdefghij"[i % 10] * (1 + i % 7) for i in range(301))
    cut = [s for s, _ in pieces(sentences(line))]
    assert sum(map(len, cut)) == len(tokens(line)) and max(map(len, cut)) <= WINDOW and min(map(len, cut)) > WINDOW // 2


@pytest.mark.parametrize("text", ["{a" + " " * 50_000, "« a" + " " * 50_000, "[" * 50_000, "<" * 50_000, "__" * 50_000, "a." * 50_000 + "error", "/a" * 50_000 + ".js ", "a" * 50_000 + " ()", "%a" * 50_000, "xxxx a" + " " * 50_000, '"' * 50_000, "at " * 50_000])
def test_long_runs_take_linear_time(text):
    began = time.perf_counter()
    passages(Index(), text)
    assert time.perf_counter() - began < 5


def test_residue_within_a_long_line(spark):
    df = spark.createDataFrame([(1, " ".join([*CONTENT, RESIDUE[0], *CONTENT]), "x"), (2, " ".join(CONTENT * 3), "x"), (3, " ".join([*CONTENT, f'The page said "{RESIDUE[0]}" to most families.', *CONTENT]), "x")], SHAPE)
    assert [r.doc_id for r in residue_documents(df, "doc_id", "text").collect()] == [1]


@pytest.mark.parametrize("slot", ["{{x}}", "${x}", "<%= x %>", "{% block x %}", "[INSERT x HERE]", "[x to be added]", "<<x>>", "[[x]]", "&lt;x&gt;", "<your x>", "«x»", "@@x@@", "__NAME__", "%NAME%", "$name$", "XXXX name XXXX", "{name}", "#NAME#", "[Your name]", "{{" + "x" * 200 + "}}"])
def test_slots(slot):
    assert tokens(f"Title: {slot}") == ["title", "SLOT"]


def test_no_slots():
    assert "SLOT" not in tokens("5% of patients and 6% of controls paid $5 or $6 [1] {") 


@pytest.mark.parametrize("gap", ["\u2028", "\u2029", "\x85", "\v", "<br>", "<BR />", "</p><p class='x'>", "</li><li>"])
def test_other_line_breaks(spark, gap):
    text = gap.join([" ".join(CONTENT[:6]), RESIDUE[0], " ".join(CONTENT[2:8])])
    df = spark.createDataFrame([(1, text, "x"), (2, gap.join(CONTENT), "x"), (3, gap.join(MENTIONS), "x")], SHAPE)
    assert [r.doc_id for r in residue_documents(df, "doc_id", "text").collect()] == [1]
    assert passages(Index(), text) == passages(Index(), text.replace(gap, "\n"))


def test_empty(spark):
    assert residue_documents(spark.createDataFrame([], SHAPE), "doc_id", "text").count() == 0
    assert 0 < COVERAGE < 1
    assert F is not None
