"""Names: segments and distances against brute force, and what is linked."""

import itertools
import random

import pytest

from quillgraph.llm.name_forms import read_name
from quillgraph.llm.names import banded_distance, components, edits_allowed, indexed_segments, link_names, partner_counts, probed_substrings, segments_of, similar_keys, variant_pairs

LETTERS = "abc"


def mutated(rng, s, n):
    for _ in range(n):
        i = rng.randrange(len(s))
        s = rng.choice([s[:i] + s[i + 1 :], s[:i] + rng.choice(LETTERS) + s[i:], s[:i] + rng.choice(LETTERS) + s[i + 1 :], s[:i] + s[i + 1 : i + 2] + s[i : i + 1] + s[i + 2 :]]) or "a"
    return s


def keys(n=60):
    rng = random.Random(3)
    base = ["".join(rng.choice(LETTERS) for _ in range(rng.randint(4, 13))) for _ in range(n)]
    return sorted(set(base) | {mutated(rng, b, rng.randint(1, 2)) for b in base for _ in range(3)})


def near(a, b):
    limit = edits_allowed(min(len(a), len(b)))
    return limit and banded_distance(a, b, limit) <= limit


def plain_distance(a, b):
    d = [[i + j if i * j == 0 else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i, j in itertools.product(range(1, len(a) + 1), range(1, len(b) + 1)):
        d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
        if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
            d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
    return d[-1][-1]


def test_banded_distance():
    for a, b in itertools.combinations(keys(25), 2):
        assert banded_distance(a, b, 2) == min(plain_distance(a, b), 3)


def test_segments_lose_no_pair():
    for a, b in itertools.combinations(keys(), 2):
        if near(a, b):
            short, long_ = sorted((a, b), key=len)
            k = edits_allowed(len(short))
            assert indexed_segments(short, k) & probed_substrings(long_, len(short), k)
    assert segments_of(7, 2) == [(0, 2), (2, 4), (4, 7)]


def test_similar_keys(spark):
    k = keys()
    got = {(r.key_a, r.key_b) for r in similar_keys(spark.createDataFrame([(x,) for x in k], "key string"), probes=20).collect()}
    assert got == {(a, b) for a, b in itertools.combinations(k, 2) if near(a, b)}


def test_components(spark):
    chain = [(f"n{i:03}", f"n{i + 1:03}") for i in range(40)] + [("x", "y"), ("y", "z"), ("z", "x")]
    got = {r.node: r.root for r in components(spark.createDataFrame(chain, "a string, b string")).collect()}
    assert set(got.values()) == {"n000", "x"} and len(got) == 44
    assert components(spark.createDataFrame([], "a string, b string")).count() == 0


@pytest.mark.parametrize(
    "text, surname, given, initials",
    [("Byrondale, Ada M.", "byrondale", "ada", "m"), ("A. M. Byrondale", "byrondale", "", "am"), ("de Byrondale Ada", "debyrondale", "ada", ""), ("BYRONDALE Ada", "byrondale", "ada", ""), ("Byrondale AM", "byrondale", "", "am"), ("Prof. A. Byröndale", "byrondale", "", "a")],
)
def test_forms(text, surname, given, initials):
    f = read_name(text)
    assert (f.surname, f.given[0] if f.given else "", "".join(f.initials)) == (surname, given, initials)


GROUPS = [
    ["Byrondale Katherine", "Katherine Byrondale", "Byrondale, K. M.", "Kate Byrondale", "BYRONDALE Katherine", "Katherine M. Byrondale, PhD", "Byrondale Kath.", "Katherine Byrondle", "Byrondlae KM", "Katehrine Byrondale"],
    ["Byrondale Anthony", "Byrondale, Anthony \"Tony\"", "A. Byrondale"],
    ["Lundmark Registry Working Group", "Registry Working Group of Lundmark", "The Lundmark Registry Working Grp."],
    ["Lundmark Epilepsy Consortium", "LUNDMARK EPILEPSY CONSORTIUM", "Lundmark Epilepsy Cons."],
    ["Okadaro Robert", "Okadaro, Robert (Bob)", "R. Okadaro"],
]
PADDING = [f"{s} {g}" for s in ("Velinora", "Strudomak", "Pekrusia", "Hanoberi", "Mirusko", "Tobranek", "Zulikova", "Fergadin", "Quorilas", "Wexomani") for g in ("Katherine", "Anthony", "Robert", "Priya")]


def test_links(spark):
    names = [n for g in GROUPS for n in g] + PADDING + [None, "", "--"]
    df = spark.createDataFrame([(n, "x") for n in [*names, *names]], "name string, entity string")
    entities = {r.name: r.entity for r in link_names(df).collect()}
    for g in GROUPS:
        assert len({entities[n] for n in g}) == 1, g
    assert len({entities[g[0]] for g in GROUPS}) == len(GROUPS)
    assert None not in entities and "" not in entities


def test_links_do_not_depend_on_the_corpus(spark):
    """A handful of spellings link as they would among many."""
    groups = [["Jonathan Peterson", "Jonathon Petersen"], ["Elisabeth Schmidt", "Betty Schmidt"], ["Li Wei", "Wei Li"], ["Andrew Bekukrihof", "Andew Bekukrihof", "Bekukrihof, A."], ["Silvano, Maria"], ["Silvano, Mario"], ["Okafor, Martin"], ["Okafor, Martina"]]
    for extra in ([], PADDING):
        df = spark.createDataFrame([(n,) for g in groups for n in g] + [(n,) for n in extra], "name string")
        entities = {r.name: r.entity for r in link_names(df).collect()}
        for g in groups:
            assert len({entities[n] for n in g}) == 1, g
        assert len({entities[g[0]] for g in groups}) == len(groups)


def test_pairs(spark, rows):
    e = spark.createDataFrame([("b", 1), ("a", 1), ("c", 1), ("d", 2)], "name string, entity int")
    assert rows(variant_pairs(e)) == [("a", "b"), ("a", "c"), ("b", "c")]
    assert variant_pairs(e.limit(0)).count() == 0


def test_no_names(spark):
    assert link_names(spark.createDataFrame([], "name string")).count() == 0


def test_partners_are_counted_exactly(spark):
    df = spark.range(60_000).selectExpr("concat('w', id % 20) word", "if(id < 40, null, concat('p', id div 40)) partner", "id % 2 giv")
    got = {r.word: (r.giv, r.n) for r in partner_counts(df, "word", "partner", "n", "giv").collect()}
    assert got == {f"w{i}": (3000 * (i % 2), 1499) for i in range(20)}
