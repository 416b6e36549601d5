"""Packed fields: the grammar, its flags and its edge cases."""

import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillgraph.operators.packed import parse_names, split_packed

CASES = [
    ("Ada Byron, Mary Ann Evans and Jane Roe", ["Ada Byron", "Mary Ann Evans", "Jane Roe"]),
    ("Byron, A., Evans, M. A., & Roe, J.", ["Byron, A.", "Evans, M. A.", "Roe, J."]),
    ("Byron, Ada; Roe Jane", ["Byron, Ada", "Roe Jane"]),
    ("Ada Byron, MD; Jane Roe, MSc", ["Ada Byron, MD", "Jane Roe, MSc"]),
    ('["Ada Byron", "Roe, Jane"]', ["Ada Byron", "Roe, Jane"]),
    ('{"Ada Byron", "Jane Roe"}', ["Ada Byron", "Jane Roe"]),
    ('"Byron, Ada ""Countess""";"Jane Roe"', ['Byron, Ada "Countess"', "Jane Roe"]),
    ('Charles "Chuck" Dodge, Jane (Jenny) Roe', ['Charles "Chuck" Dodge', "Jane (Jenny) Roe"]),
    ("Foundation for Genetics and Health and Jane Roe", ["Foundation for Genetics and Health", "Jane Roe"]),
    ("Lund Network for Epilepsy & Ataxia;Jane Roe", ["Lund Network for Epilepsy & Ataxia", "Jane Roe"]),
    ("Jane Roe, Lund Network for Epilepsy and Ataxia, et al.", ["Jane Roe", "Lund Network for Epilepsy and Ataxia"]),
    ("Ada Byron\tRoe LA\r\nJane  Doe", ["Ada Byron", "Roe LA", "Jane Doe"]),
    ("Jane Roe; Kate Poe, Dmitri Voe | Ursula Zoe", ["Jane Roe", "Kate Poe", "Dmitri Voe", "Ursula Zoe"]),
    ("Jane\xa0Roe ,, ; et al", ["Jane Roe"]),
    ("Jane Roe and others", ["Jane Roe"]),
    ("Roe, Jane", ["Roe, Jane"]),
    ("ROE, Jane / Poe, K.", ["ROE, Jane", "Poe, K."]),
    ("Jane Roe||Ada Byron|", ["Jane Roe", "Ada Byron"]),
    ("  ", []),
    ("", []),
    (None, []),
    ('""', []),
    (";;,|", []),
]


@pytest.mark.parametrize("text, names", CASES)
def test_names(text, names):
    found = parse_names(text)
    assert [n for _, n, _ in found] == names
    assert [p for p, _, _ in found] == list(range(1, len(names) + 1))


def test_open_quote_backtracks():
    found = parse_names('"Ada Byron; Jane Roe')
    assert [n.strip('"') for _, n, _ in found] == ["Ada Byron", "Jane Roe"]
    assert found[0][2] == "open_quote"


def test_open_list_is_flagged():
    assert {f for _, _, f in parse_names('["Ada Byron", "Jane Roe"')} == {"open_list"}


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet='ab ,;|"&()[]{}\n\t.', max_size=60))
def test_any_text_is_read(text):
    found = parse_names(text)
    assert [p for p, _, _ in found] == list(range(1, len(found) + 1))
    assert all(n == " ".join(n.split()) and n for _, n, _ in found)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["Ada", "Jane", "Mary", "Kenji"]), st.sampled_from(["Byron", "Roe", "Evans", "Okada"])), min_size=1, max_size=6), st.sampled_from(["; ", ";", " | ", "\n", ", ", " & ", " and "]))
def test_round_trip(people, separator):
    names = [f"{a} {b}" for a, b in people]
    assert [n for _, n, _ in parse_names(separator.join(names))] == names


def test_long_text():
    assert len(parse_names("; ".join(["Jane Roe"] * 20_000))) == 20_000


def test_frame(spark, rows):
    df = spark.createDataFrame([(1, "Jane Roe; Ada Byron", "x"), (1, "Jane Roe; Ada Byron", "x"), (2, None, "y"), (3, " ", "z"), (None, "Jane Roe", "w")], "row_id bigint, authors string, author string")
    assert rows(split_packed(df, "row_id", "authors").select("row_id", "pos", "author")) == [(None, 1, "Jane Roe"), (1, 1, "Jane Roe"), (1, 1, "Jane Roe"), (1, 2, "Ada Byron"), (1, 2, "Ada Byron")]
    assert split_packed(df.where(F.lit(False)), "row_id", "authors").count() == 0
    with pytest.raises(ValueError, match="missing columns"):
        split_packed(df, "row_id", "names")


def test_long_fields_take_linear_time():
    began = time.perf_counter()
    names = "; ".join(f"Byron{i}, Ada (Ad{i})" for i in range(4000)), ", ".join(f'Ada "A{i}" Byron{i}' for i in range(8000)), ", ".join(f"Ada (A{i}) Byron{i}" for i in range(8000))
    assert [len(parse_names(n)) for n in names] == [4000, 8000, 8000]
    assert time.perf_counter() - began < 6


def test_any_number_of_initials():
    assert [n for _, n, _ in parse_names("Byron, A. B. C. D. E.; Lovelace, Q.")] == ["Byron, A. B. C. D. E.", "Lovelace, Q."]
