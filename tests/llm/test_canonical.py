"""Trie and automaton against plain edit distance, and what values mean."""

import random

import pytest

from quillgraph.llm.canonical import OPPOSITE, Lexicon, Trie, candidates, distance_allowed, map_values, meanings, near_entries, words_of

ENTRIES = [
    (1, "entity", "StatusEpilepticus", "continuous seizure state"),
    (2, "entity", "Hypertonia", None),
    (3, "entity", "VagusNerveStimulation", "VNS"),
    (4, "predicate", "raisesRiskOf", "increases risk of"),
    (5, "predicate", "isLinkedTo", "tied to"),
    (6, "entity", "SkinRash", "exanthem"),
]


def osa(a, b):
    d = {(-1, -1): 0}
    for i in range(len(a)):
        d[i, -1] = i + 1
    for j in range(len(b)):
        d[-1, j] = j + 1
    for i in range(len(a)):
        for j in range(len(b)):
            d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i] != b[j]))
            if i and j and a[i] == b[j - 1] and a[i - 1] == b[j]:
                d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
    return d[len(a) - 1, len(b) - 1]


@pytest.fixture(scope="module")
def trie():
    return Trie(ENTRIES)


def paths(node, prefix=""):
    for entry, edits in node[1]:
        yield prefix, entry, edits
    for c, child in node[0].items():
        yield from paths(child, prefix + c)


def test_search_is_exact(trie):
    rng = random.Random(1)
    every = list(paths(trie.root))
    values = []
    for _ in range(250):
        s = rng.choice(every)[0]
        for _ in range(rng.randint(0, 3)):
            i = rng.randrange(len(s))
            s = rng.choice([s[:i] + s[i + 1 :], s[:i] + rng.choice("aeßz9") + s[i:], s[:i] + s[i + 1 : i + 2] + s[i : i + 1] + s[i + 2 :]]) or "a"
        values.append(s)
    values += ["", "zz", "x" * 500]
    got = set(zip(*(x.tolist() for x in trie.search(values))))
    want = {(i, e, osa(v, p)) for i, v in enumerate(values) if v and len(v) < 60 for p, e, k in every if abs(len(v) - len(p)) <= 2 and osa(v, p) <= min(k, distance_allowed(len(v)))}
    assert got == want


@pytest.mark.parametrize(
    "value, entry",
    [
        ("statusepilepticus", 1), ("epilepticusstatus", 1), ("statusepilep", 1), ("statuseplptcs", 1), ("continuousseizurestate", 1), ("anobservedstatusepilpeticus", 1), ("statusepilepticusnos", 1), ("hypertonia", 2), ("hypotonia", None), ("hypotonias", None),
        ("nohypertonia", None), ("stimulationvagusnerve", 3), ("vns", 3), ("vnt", None), ("raiseriskof", 4), ("mayraiseriskof", 4), ("alsoraisesriskof", 4), ("lowersriskof", None), ("islinkedto", 5), ("werelinkedto", 5), ("isnotlinkedto", None), ("isntlinkedto", None),
        ("exanthem", 6), ("gardenparty", None),
    ],
)
def test_meanings(trie, value, entry):
    assert meanings(trie, [value]) == [entry]


def test_opposites_never_come_out(trie):
    assert OPPOSITE not in [m for m in meanings(trie, ["hypotonia", "isnotlinkedto", "notlinkedto"]) if m is not None]


def test_words():
    assert words_of("VagusNerveStimulation") == ["vagus", "nerve", "stimulation"]
    assert words_of("SIME syndrome") == ["sime", "syndrome"]


def test_frame(spark, rows):
    df = spark.createDataFrame([(1, "Status Epilepticus", "is_linked_to", None, "x"), (2, " ", "--", "VNS.", "x"), (2, " ", "--", "VNS.", "x"), (3, "garden party", "", "Hypotonia", "x")], "row_id bigint, Subject string, Predicate string, Object string, entry_id string")
    entries = spark.createDataFrame(ENTRIES, "entry_id int, kind string, label string, aliases string")
    found, unmatched = map_values(df, "row_id", ["Subject", "Predicate", "Object"], entries)
    assert rows(found) == [(1, "Predicate", 5), (1, "Subject", 1), (2, "Object", 3), (2, "Object", 3)]
    assert rows(unmatched) == [("Hypotonia", 1), ("garden party", 1)]
    found, unmatched = map_values(df, "row_id", ["Subject"], entries.limit(0))
    assert found.count() == 0 and unmatched.count() == 2
    assert map_values(df.limit(0), "row_id", ["Subject"], entries)[0].count() == 0


def test_all_entries_within_distance():
    trie = Trie([(1, "entity", "Hypertonia", None), (2, "entity", "Hypertoniac", None)], Lexicon(contrary=()))
    assert {e: d for e, d in candidates(trie, ["hypertonia"])[0].items() if e != OPPOSITE} == {1: 0, 2: 1}


def test_blocks_agree_with_one_trie(spark, rows):
    """A list longer than a block is cut; nothing changes."""
    entries = spark.createDataFrame([*ENTRIES, (7, "entity", None, "gone"), (8, "entity", "Hypertoniac", None)], "entry_id int, kind string, label string, aliases string")
    words = ["statusepilepticus", "hypertonia", "hypotonia", "isnotlinkedto", "islinkedto", "vns", "gardenparty", "skinrahs", "hypertonic"]
    values = spark.createDataFrame([(w,) for i, w in enumerate(words) for _ in range(1 + i % 3)], "value_key string")
    one, many = (rows(near_entries(values, entries, block=n)) for n in (1000, 2))
    assert one == many and len(one) == len(words)
