"""Variant spellings of one person or organisation: pigeonhole segment join.

1. Each distinct spelling is read once (``name_forms``): surname, given name,
   initials, short form.  Where order is open ("Ada Byron", "Byron Ada"), the
   corpus decides: which word, with its near spellings, is written as a surname or as a
   given name where the form leaves no doubt, and how many different partners it has.
2. Near words are found by one operator, ``similar_keys``: every key is cut into k + 1
   segments, one of which must survive k edits unharmed; the segments are an inverted
   index that is probed with the substrings of the other keys at positions shifted by at
   most what k edits allow; what meets is verified by banded edit distance.
3. Near given names of one surname are one, however often each is written; only names
   that differ in a last vowel ("Maria", "Mario") need one to be a rare slip of the other.
   Short forms, nicknames and initials join the one full name of their surname they
   agree with; where two could be meant they join none.  Names under near surnames
   with the same or a near given name are linked, links are closed by components.

All work is on distinct keys: a name that fills a third of all rows is one row here.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.llm.name_forms import BODY_WORDS, NICKNAMES, read_name
from quillgraph.runtime import cut, discard, need, scratch, shuffle_width


def edits_allowed(length: int) -> int:
    """Edits (insert, delete, replace, swap) allowed between keys of this length."""
    return 0 if length < 5 else 1 if length < 8 else 2


def segments_of(length: int, k: int) -> list[tuple[int, int]]:
    """(start, end) of k + 1 segments as even as can be, the shorter ones first."""
    n, rest = divmod(length, k + 1)
    out, at = [], 0
    for i in range(k + 1):
        size = n + (1 if i >= k + 1 - rest else 0)
        out.append((at, at + size))
        at += size
    return out


def banded_distance(a: str, b: str, limit: int) -> int:
    """Edit distance with swaps of neighbours, in a band; ``limit + 1`` if above."""
    la, lb = len(a), len(b)
    if abs(la - lb) > limit:
        return limit + 1
    big = limit + 1
    before: list[int] = []
    prev = [j if j <= limit else big for j in range(lb + 1)]
    for i in range(1, la + 1):
        cur = [big] * (lb + 1)
        if i <= limit:
            cur[0] = i
        lo, hi = max(1, i - limit), min(lb, i + limit)
        for j in range(lo, hi + 1):
            d = min(prev[j - 1] + (a[i - 1] != b[j - 1]), prev[j] + 1, cur[j - 1] + 1)
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d = min(d, before[j - 2] + 1)
            cur[j] = min(d, big)
        if min(cur[lo - 1 : hi + 1]) > limit:
            return big
        before, prev = prev, cur
    return prev[lb]


def indexed_segments(key: str, k: int) -> set[tuple[int, str]]:
    """(number, text) of the key's segments.

    A swap of neighbours across a border is one edit that harms two segments; so the
    segments of the key with such swaps made stand in the index as well, and k edits
    always leave one of the k + 1 segments of some version unharmed.
    """
    cuts = segments_of(len(key), k)
    versions = {key}
    for _, at in cuts[:-1]:
        versions |= {v[: at - 1] + v[at] + v[at - 1] + v[at + 1 :] for v in versions if 0 < at < len(v)}
    return {(i, v[a:b]) for v in versions for i, (a, b) in enumerate(cuts)}


def probed_substrings(key: str, size: int, k: int) -> set[tuple[int, str]]:
    """(number, text) of substrings that can be segment i of a key of length ``size``:
    i edits at most lie before it and k - i behind it."""
    n, d = len(key), len(key) - size
    out = set()
    for i, (a, b) in enumerate(segments_of(size, k)):
        for start in range(max(0, a - i, a + d - (k - i)), min(n - (b - a), a + i, a + d + (k - i)) + 1):
            out.add((i, key[start : start + b - a]))
    return out


#: Probes of one segment that one task meets with its index at most, unless there are
#: more than HOT_SEGMENTS such segments; then the commonest so many.
PROBES, HOT_SEGMENTS = 20_000, 100_000


def similar_keys(keys: DataFrame, key: str = "key", probes: int = PROBES) -> DataFrame:
    """All pairs of near keys: ``key_a, key_b, distance`` with key_a < key_b.

    ``keys`` are distinct strings.  Exact: two keys within the edits their shorter one
    allows share an unharmed segment.  Keys too short for an edit have no partner.
    A segment that many keys probe is split: its probes into pieces of about ``probes``,
    its index repeated for each piece.
    """
    spark = keys.sparkSession
    width = shuffle_width(spark)
    one = cut(keys.select(F.col(key).alias("key")).repartition(width), "keys")

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(len(s), i, t, s) for s in batch.column(0).to_pylist() if (k := edits_allowed(len(s))) for i, t in indexed_segments(s, k)]
            yield _batch(rows, ["size", "no", "piece", "indexed"])

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for s in batch.column(0).to_pylist():
                for size in range(max(1, len(s) - 2), len(s) + 1):  # partners as long or shorter
                    k = edits_allowed(size)
                    if k and len(s) - size <= k:
                        rows += [(size, i, t, s) for i, t in probed_substrings(s, size, k)]
            yield _batch(rows, ["size", "no", "piece", "probing"])

    shape = "size int, no int, piece string, {} string"
    place = ["size", "no", "piece"]
    at = [*place, "salt"]
    left, right = one.mapInArrow(probe, shape.format("probing")), one.mapInArrow(index, shape.format("indexed"))
    counts = cut(left.groupBy(*place).agg(F.count("*").alias("n")).where(F.col("n") > probes).select(*place, F.ceil(F.col("n") / probes).alias("salts")), "segments")
    hot = F.broadcast(counts.orderBy(F.col("salts").desc()).limit(HOT_SEGMENTS))
    left = left.join(hot, place, "left").withColumn("salt", F.coalesce(F.pmod(F.xxhash64("probing"), F.col("salts")), F.lit(0).cast("bigint"))).drop("salts")
    right = right.join(hot, place, "left").withColumn("salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.coalesce(F.col("salts"), F.lit(1).cast("bigint")) - 1))).drop("salts")
    allowed = F.when(F.col("size") < 5, 0).when(F.col("size") < 8, 1).otherwise(2)
    # a swap is two edits to the JVM's distance: twice the edits are a bound, checked exactly after
    met = (
        left.repartition(width, *at)
        .join(right.repartition(width, *at), at)
        .where((F.col("size") < F.length("probing")) | (F.col("probing") < F.col("indexed")))
        .withColumn("allowed", allowed)
        .where(F.when(F.col("allowed") == 1, F.levenshtein("probing", "indexed", 2)).otherwise(F.levenshtein("probing", "indexed", 4)) >= 0)
        .select("probing", "indexed", "allowed")
        .distinct()
    )

    @F.pandas_udf("int")
    def verify(a: pd.Series, b: pd.Series, limit: pd.Series) -> pd.Series:
        return pd.Series([banded_distance(x, y, n) for x, y, n in zip(a, b, limit)], dtype="int32")

    return (
        met.withColumn("distance", verify("probing", "indexed", "allowed"))
        .where("distance <= allowed")
        .select(F.least("probing", "indexed").alias("key_a"), F.greatest("probing", "indexed").alias("key_b"), "distance")
    )


def _batch(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    cols = list(zip(*rows)) if rows else [[] for _ in names]
    types = [pa.int32(), pa.int32(), pa.string(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=names)


def components(edges: DataFrame, label: str = "components") -> DataFrame:
    """``node, root``: connected components of ``a, b``; root is the smallest node.

    Every round each node takes the smallest root among its own and its neighbours'
    and then jumps to that root's root, so long chains halve; rounds are written to
    the shared folder and end when nothing changes.
    """
    spark = edges.sparkSession
    both = cut(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), f"{label}-edges")
    path = scratch(spark, label)
    state = cut(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("root")), label, path)
    while True:
        near = both.join(state.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("near"))
        closer = state.join(near, "node", "left").select("node", F.col("root").alias("old"), F.least("root", "near").alias("root"))
        jump = closer.select(F.col("node").alias("root"), F.col("root").alias("further"))
        before, path = path, scratch(spark, label)
        after = cut(closer.join(jump, "root", "left").select("node", "old", F.least("root", "further").alias("root")), label, path)
        discard(spark, before)  # the new round is written
        state = after.select("node", "root")
        if after.where("old <> root").isEmpty():
            return state


def _read(spellings: DataFrame) -> DataFrame:
    schema = "name string, kind string, surname string, given string, initials string, short string, nick string, words array<string>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(s, read_name(s)) for s in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([s for s, _ in rows], pa.string()),
                    pa.array([f.kind for _, f in rows], pa.string()),
                    pa.array([f.surname for _, f in rows], pa.string()),
                    pa.array([f.given[0] if f.given else "" for _, f in rows], pa.string()),
                    pa.array(["".join(([g[0] for g in f.given[1:]] if f.given else []) + f.initials) for _, f in rows], pa.string()),
                    pa.array([f.short for _, f in rows], pa.string()),
                    pa.array([f.nick for _, f in rows], pa.string()),
                    pa.array([f.tokens for _, f in rows], pa.list_(pa.string())),
                ],
                names=["name", "kind", "surname", "given", "initials", "short", "nick", "words"],
            )

    return spellings.select("name").mapInArrow(run, schema)


def partner_counts(rows: DataFrame, key: str, partner: str, n: str, *sums: str) -> DataFrame:
    """``key``, the ``sums`` and, as ``n``, its exact number of distinct partners (null is
    none): pairs are aggregated before keys, so no task holds the partners of a key."""
    pairs = rows.groupBy(key, partner).agg(F.count("*").alias("__rows"), *[F.sum(c).alias(c) for c in sums])
    return pairs.groupBy(key).agg(*[F.sum(c).alias(c) for c in sums], F.count(partner).alias(n))


def _oriented(forms: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(named, near)``: which open word is the surname (of organisations: the rarest
    word is the name, the others say what kind of body it is), and all near pairs of
    words.  Every surname and given name is a word, so one segment join serves all steps.
    """
    sure = forms.where("kind = 'person' and surname <> ''")
    open_ = forms.where("size(words) > 0")
    roles = (
        sure.select(F.col("surname").alias("word"), F.lit(1).alias("sur"), F.lit(0).alias("giv"), F.col("given").alias("partner"))
        .unionByName(sure.where("given <> ''").select(F.col("given").alias("word"), F.lit(0).alias("sur"), F.lit(1).alias("giv"), F.col("surname").alias("partner")))
        .unionByName(
            open_.select(F.explode("words").alias("word"), "words").select(
                "word", F.lit(0).alias("sur"), F.lit(0).alias("giv"), F.array_join(F.array_except("words", F.array("word")), " ").alias("partner")
            )
        )
    )
    stats = cut(partner_counts(roles, "word", "partner", "partners", "sur", "giv"), "words")
    known = sorted({*NICKNAMES, *(w for v in NICKNAMES.values() for w in v.split())})
    known = forms.sparkSession.createDataFrame([(w, 0, 1, 0) for w in known], "word string, sur bigint, giv bigint, partners bigint")
    near = cut(similar_keys(stats.select("word").unionByName(known.select("word")).distinct(), "word"), "near")
    seen = stats.select("word", "sur", "giv", "partners").unionByName(known)
    # a word is read as its near spellings are: a mistyped given name among given names
    around = both_ways(near).select(F.col("a").alias("word"), F.col("b").alias("like")).join(seen.withColumnRenamed("word", "like"), "like")
    stats = (
        seen.unionByName(around.select(*seen.columns))
        .groupBy("word")
        .agg(*[F.sum(c).alias(c) for c in ("sur", "giv", "partners")])
        .join(stats.select("word", F.col("partners").alias("own")), "word")
        .select("word", F.col("own").alias("partners"), (F.log((F.col("giv") + 0.5) / (F.col("sur") + 0.5)) + F.log("partners")).alias("givenness"))
    )
    stats = cut(stats, "roles")
    # words for kinds of bodies are no body's own name, however rare here
    common = F.when(F.col("word").isin(*sorted(BODY_WORDS)), 1e12).otherwise(0.0)
    placed = (
        open_.select("name", "kind", "initials", "short", "nick", F.explode("words").alias("word"))
        .join(stats.select("word", "givenness", "partners"), "word")
        .groupBy("name", "kind", "initials", "short", "nick")
        .agg(F.sort_array(F.collect_list(F.struct(F.when(F.col("kind") == "person", F.col("givenness")).otherwise(F.col("partners") + common).alias("score"), "word"))).alias("w"))
    )
    # lowest score: the surname, or an organisation's own name; highest: the given name
    person = placed.where("kind = 'person'").select(
        "name",
        "kind",
        F.col("w")[0]["word"].alias("surname"),
        F.when(F.size("w") > 1, F.element_at("w", -1)["word"]).otherwise("").alias("given"),
        F.concat(F.when(F.size("w") > 2, F.substring(F.col("w")[1]["word"], 1, 1)).otherwise(""), "initials").alias("initials"),
        "short",
        "nick",
    )
    body = placed.where("kind <> 'person'").select(
        "name",
        "kind",
        F.col("w")[0]["word"].alias("surname"),
        F.array_join(F.array_sort(F.transform(F.expr("slice(w, 2, size(w))"), lambda x: x["word"])), " ").alias("given"),
        "initials",
        "short",
        "nick",
    )
    return sure.drop("words").unionByName(person).unionByName(body), near


def both_ways(near: DataFrame) -> DataFrame:
    """``a, b`` of near pairs, each way."""
    return near.select(F.col("key_a").alias("a"), F.col("key_b").alias("b")).unionByName(near.select(F.col("key_b").alias("a"), F.col("key_a").alias("b")))


def _agreeing(named: DataFrame, near: DataFrame) -> DataFrame:
    """``a, b``: near given names that can be one, each way.

    All near pairs, but those that differ in a last vowel only ("Maria", "Mario",
    "Martin", "Martina"): these are two names, unless one is written with so many more
    surnames that the other is a slip.
    """
    bare = lambda c: F.regexp_replace(c, "[aeiouy]$", "")
    n = partner_counts(named.where("kind = 'person' and given <> ''"), "given", "surname", "n")
    pairs = both_ways(near)
    endings = pairs.where(bare(F.col("a")) == bare(F.col("b")))
    slips = (
        endings.join(n.select(F.col("given").alias("a"), "n"), "a")
        .join(n.select(F.col("given").alias("b"), F.col("n").alias("m")), "b")
        .where("m >= 4 * n or n >= 4 * m")
        .select("a", "b")
    )
    return pairs.where(bare(F.col("a")) != bare(F.col("b"))).unionByName(slips)


def _corrected(named: DataFrame, one_name: DataFrame) -> DataFrame:
    """Each given name is written as the commonest of those of its surname that it can be,
    whatever the size of the corpus."""
    people = named.where("kind = 'person' and length(given) >= 5").select("surname", "given").distinct()
    n = partner_counts(named.where("kind = 'person' and given <> ''"), "given", "surname", "n")
    others = people.join(n, "given").select("surname", F.col("given").alias("other"), "n")
    better = (
        people.join(one_name.select(F.col("a").alias("given"), F.col("b").alias("other")), "given")
        .unionByName(people.withColumn("other", F.col("given")))
        .join(others, ["surname", "other"])
        .groupBy("surname", "given")
        .agg(F.max(F.struct("n", "other"))["other"].alias("better"), F.count("*").alias("choices"))
        .where("choices > 1")
        .select("surname", "given", "better", F.lit("person").alias("kind"))
    )
    return named.join(better, ["kind", "surname", "given"], "left").withColumn("given", F.coalesce("better", "given")).drop("better")


def link_names(spellings: DataFrame) -> DataFrame:
    """``name, entity``: the entity of each spelling (``name`` of ``spellings``).

    Spellings are taken once each; null and blank ones, and ones without a letter,
    are left out.  A spelling alone in its entity comes out too.
    """
    need(spellings, "name")
    names = spellings.where("name is not null and name <> ''").select("name").distinct()
    forms = cut(_read(names), "forms")
    oriented, near = _oriented(forms)
    oriented = cut(oriented.where("surname <> ''"), "oriented")
    one_name = cut(_agreeing(oriented, near), "agreeing")
    named = cut(_corrected(oriented, one_name), "named")
    nick = spellings.sparkSession.createDataFrame([(k, v.split()) for k, v in NICKNAMES.items()], "nick string, alternatives array<string>")

    # nicknames: the full name of this surname they can stand for, else the commonest
    full = named.where("given <> ''").select("kind", "surname", "given").distinct()
    by_nick = (
        named.where("kind = 'person'").select("surname", F.when(F.col("given") != "", F.col("given")).otherwise(F.col("nick")).alias("nick"))
        .distinct()
        .join(F.broadcast(nick), "nick")
    )
    stands_for = by_nick.select("surname", "nick", F.explode("alternatives").alias("given"))
    like = stands_for.join(one_name.select(F.col("a").alias("given"), "b"), "given").select("surname", "nick", F.col("b").alias("given"))
    meant = (
        stands_for.unionByName(like)
        .join(full.where("kind = 'person'"), ["surname", "given"])
        .groupBy("surname", "nick")
        .agg(F.min("given").alias("one"), F.max("given").alias("other"))
        .where("one = other")
    )
    formal = cut(
        by_nick.join(meant, ["surname", "nick"], "left").select("surname", "nick", F.coalesce("one", F.col("alternatives")[0]).alias("formal")), "nicknames"
    )
    as_given = formal.select("surname", F.col("nick").alias("given"), "formal")
    as_nick = formal.withColumnRenamed("formal", "from_nick")
    named = (
        named.join(as_given, ["surname", "given"], "left")
        .join(as_nick, ["surname", "nick"], "left")
        .withColumn("given", F.coalesce(F.when(F.col("kind") == "person", F.col("formal")), F.when(F.col("given") != "", F.col("given")), "from_nick", F.lit("")))
        .drop("formal", "from_nick")
        .withColumn("first", F.substring(F.when(F.col("given") != "", F.col("given")).when(F.col("short") != "", F.col("short")).otherwise(F.col("initials")), 1, 1))
        .withColumn("middle", F.when((F.col("given") != "") | (F.col("short") != ""), F.substring("initials", 1, 1)).otherwise(F.substring("initials", 2, 1)))
    )
    named = cut(named, "resolved")

    # full names: one node each, split only where middle initials contradict each other
    people = named.where("given <> ''")
    middles = people.groupBy("kind", "surname", "given", "first").agg(F.collect_set(F.when(F.col("middle") != "", F.col("middle"))).alias("middles"))
    node = F.concat_ws("|", "kind", "surname", "given")
    full_nodes = cut(middles.withColumn("node", node), "full")
    of_full = people.join(full_nodes, ["kind", "surname", "given", "first"]).select(
        "name", "kind", "surname", "first", F.when(F.size("middles") > 1, F.concat_ws("|", "node", "middle")).otherwise(F.col("node")).alias("node")
    )
    # short forms and initials: the one full name they agree with
    bare = named.where("given = ''").select("surname", "first", "short", "middle").distinct()
    agree = (
        bare.join(full_nodes.where("kind = 'person'"), ["surname", "first"])
        .where("startswith(given, short) and (middle = '' or size(middles) = 0 or array_contains(middles, middle))")
        .withColumn("exact", F.expr("middle <> '' and array_contains(middles, middle)"))
        .withColumn("target", F.when((F.size("middles") > 1) & F.col("exact"), F.concat_ws("|", "node", "middle")).otherwise(F.col("node")))
    )
    chosen = (
        agree.groupBy("surname", "first", "short", "middle")
        .agg(
            F.min(F.when(F.col("exact"), F.col("target"))).alias("e1"),
            F.max(F.when(F.col("exact"), F.col("target"))).alias("e2"),
            F.min("target").alias("t1"),
            F.max("target").alias("t2"),
        )
        .select("surname", "first", "short", "middle", F.when(F.col("e1") == F.col("e2"), F.col("e1")).when(F.col("t1") == F.col("t2"), F.col("t1")).alias("target"), F.lit(True).alias("seen"))
    )
    # without any full name: all that share surname and first letter, if their middles agree
    loners = bare.join(chosen, ["surname", "first", "short", "middle"], "left")
    alone = bare.groupBy("surname", "first").agg(F.count_distinct(F.when(F.col("middle") != "", F.col("middle"))).alias("m"))
    loners = loners.join(alone, ["surname", "first"])
    own = F.concat_ws("|", F.lit("person"), "surname", F.concat(F.lit("~"), "first"))
    bare_nodes = loners.select(
        "surname",
        "first",
        "short",
        "middle",
        F.coalesce("target", F.when(F.col("m") > 1, F.concat_ws("|", own, "middle")).otherwise(own)).alias("node"),
    )
    of_bare = named.where("given = ''").join(bare_nodes, ["surname", "first", "short", "middle"]).select("name", "kind", "surname", "first", "node")
    members = cut(of_full.unionByName(of_bare), "members")

    # near surnames
    nodes = members.select("node", "kind", "surname", "first").distinct()
    pairs = both_ways(near).select(F.col("a").alias("surname"), F.col("b").alias("other"))
    keyed = cut(nodes.withColumn("rest", F.expr("substring(node, length(kind) + length(surname) + 3)")), "nodes")
    others = keyed.select(F.col("surname").alias("other"), "kind", "first", F.col("rest").alias("other_rest"), F.col("node").alias("other_node"))
    met = keyed.join(pairs, "surname").join(others, ["other", "kind", "first"])
    full = keyed.where("not startswith(rest, '~')").withColumn("given", F.substring_index("rest", "|", 1)).withColumn("more", F.expr("substring(rest, length(given) + 1)"))
    full = full.select("node", "kind", "surname", "given", "more")
    turned = full.join(pairs, "surname")
    # the same given name, or one that can be it, as the partner's
    said = turned.select("node", "kind", "other", "given", "more").unionByName(
        turned.unionByName(full.withColumn("other", F.col("surname"))).where("kind = 'person'").join(one_name.select(F.col("a").alias("given"), F.col("b").alias("meant")), "given").select("node", "kind", "other", F.col("meant").alias("given"), "more")
    )
    theirs = full.select("kind", F.col("surname").alias("other"), "given", "more", F.col("node").alias("b"))
    same = said.join(theirs, ["kind", "other", "given", "more"]).where("node < b").select(F.col("node").alias("a"), "b")
    # a spelling without full given name and a near surname: if just one full name there agrees
    of_initial = (
        met.where("startswith(rest, '~') and not startswith(other_rest, '~')")
        .groupBy("node")
        .agg(F.min("other_node").alias("b"), F.max("other_node").alias("c"), F.min("other_rest").alias("r1"), F.max("other_rest").alias("r2"))
        .where("r1 = r2")
        .select(F.col("node").alias("a"), "b")
    )
    linked = components(same.unionByName(of_initial), "names").withColumnRenamed("node", "n")
    return members.join(linked, F.col("node") == F.col("n"), "left").select("name", F.coalesce("root", "node").alias("entity"))


def variant_pairs(entities: DataFrame) -> DataFrame:
    """``name_a, name_b``: all pairs of spellings of one entity, name_a < name_b."""
    left, right = entities.select(F.col("name").alias("name_a"), "entity"), entities.select(F.col("name").alias("name_b"), "entity")
    return left.join(right, "entity").where("name_a < name_b").select("name_a", "name_b")
