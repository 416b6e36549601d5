"""Freely typed values to the entries of a canonical list: trie and Levenshtein automaton.

The list becomes a trie of spelling paths: labels and aliases, their inflections
and turned word orders, shortened words, and as *opposites* the spellings that
mean the contrary ("hypo-" for "hyper-", "is not").  A value means the entry whose
path is nearest; if an opposite is nearer, it means nothing on the list.

The automaton is run for a whole batch of values at once: a depth-first walk over
the trie carries, for the values still alive, the band of the edit-distance row
that the automaton's state stands for (insert, delete, replace, swap of
neighbours).  A branch is left as soon as no value can come within its distance.

A list of up to BLOCK entries goes to the workers whole, and each worker builds its trie
once.  A longer one is cut into blocks of entries: every value meets every block, each
in its own trie, and what the blocks found is put together.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgraph.llm.ledger import letters_and_digits
from quillgraph.runtime import cut, frequency_join, need, shuffle_width

K = 2  # widest distance
BIG = 99
OPPOSITE = -1
#: Entries of one trie; some 300 nodes each.
BLOCK = 1000
# English words that leave a value's meaning as it is.
LEADING = ("the", "a", "an", "any", "some", "reported", "observed", "anobserved", "areported", "also", "may", "can", "often")
TRAILING = ("nos", "unspecified", "reported", "observed", "nototherwisespecified")
# Pairs of contrary word parts, each way.
CONTRARY = [
    ("hyper", "hypo"), ("brady", "tachy"), ("penia", "osis"), ("penia", "philia"), ("loss", "gain"), ("low", "high"),
    ("raises", "lowers"), ("raises", "reduces"), ("increases", "decreases"), ("increases", "reduces"), ("improves", "worsens"), ("betters", "worsens"),
    ("shortens", "prolongs"), ("activates", "inhibits"), ("activates", "deactivates"), ("prevents", "causes"), ("prevents", "promotes"),
    ("triggers", "prevents"), ("provokes", "prevents"), ("delayed", "early"), ("delays", "speeds"), ("treated", "untreated"), ("cuts", "raises"),
    ("cuts", "increases"), ("linked", "unlinked"), ("used", "unused"), ("adverse", "beneficial"), ("preferred", "avoided"), ("excluded", "included"),
]


@dataclass(frozen=True)
class Lexicon:
    """Words of the values' language and field: what may stand before or behind a value
    without changing it, and pairs of word parts that turn its meaning round."""

    leading: tuple[str, ...] = LEADING
    trailing: tuple[str, ...] = TRAILING
    contrary: tuple[tuple[str, str], ...] = tuple(CONTRARY)


def distance_allowed(length: int) -> int:
    """Edits allowed for a text of so many letters."""
    return 0 if length <= 4 else 1 if length <= 7 else K


def words_of(label: str) -> list[str]:
    """Lower-case words of a label in camel case or with blanks."""
    return [w.lower() for w in re.findall(r"[A-Z]{2,}(?![a-z])|[A-Z]?[^\W\d_A-Z]+|[A-Z]+|\d+", label)]


def _letters(words: Iterable[str]) -> str:
    return "".join(c for w in words for c in w if c.isalnum())


def _verb_forms(word: str) -> list[str]:
    """Other forms of a predicate's first word."""
    if word == "is":
        return ["are", "was", "were", "be", "been", ""]
    if word == "has":
        return ["have", "had", "having"]
    if not word.endswith("s") or len(word) < 4:
        return []
    base = word[:-1]
    out = [base, base + ("d" if base.endswith("e") else "ed"), (base[:-1] if base.endswith("e") else base) + "ing"]
    if word.endswith("ies"):
        out += [word[:-3] + "y", word[:-3] + "ied", word[:-3] + "ying"]
    return out


def _plurals(word: str) -> list[str]:
    if word.endswith("s"):
        return [word[:-1], word + "es"]
    return [word + "s"] + ([word[:-1] + "ies"] if word.endswith("y") else [])


def _skeletons(word: str) -> set[str]:
    """A word written without its inner vowels."""
    out = set()
    for keep in (1, 2, 3):
        for tail in (0, 1):
            inner = word[keep : len(word) - tail] if tail else word[keep:]
            out.add(word[:keep] + re.sub("[aeiou]", "", inner) + (word[len(word) - tail :] if tail else ""))
    return out - {word}


def spellings(label: str, kind: str) -> tuple[set[str], set[str]]:
    """Paths of one label: (those that edits may follow, shortened ones read exactly)."""
    words = words_of(label)
    forms = [words]
    if kind == "predicate":
        forms += [[f, *words[1:]] for f in _verb_forms(words[0])]
    else:
        forms += [[*words[:-1], p] for p in _plurals(words[-1])]
    loose = {_letters(f) for f in forms}
    if kind != "predicate":
        for f in forms:
            for i in range(1, len(f)):
                loose.add(_letters(f[i:] + f[:i]))
    exact = set()
    for i, w in enumerate(words):
        cuts = {w[:n] for n in range(4, len(w) - 1)} | (_skeletons(w) if len(w) >= 6 else set())
        for c in cuts:
            short = _letters([*words[:i], c, *words[i + 1 :]])
            if len(short) >= 4 and (len(words) > 1 or len(short) >= 5):
                exact.add(short)
    return loose - {""}, exact - loose


def opposites(label: str, kind: str, contrary: Iterable[tuple[str, str]] = tuple(CONTRARY)) -> set[str]:
    """Spellings that mean the contrary of a label."""
    words, out = words_of(label), set()
    for a, b in contrary:
        for x, y in ((a, b), (b, a)):
            for i, w in enumerate(words):
                if w == x or (len(x) >= 4 and kind != "predicate" and (w.startswith(x) or w.endswith(x))):
                    turned = [*words[:i], w.replace(x, y, 1), *words[i + 1 :]]
                    loose, _ = spellings(" ".join(turned), kind)
                    out |= loose
    if kind == "predicate":
        if words[0] in ("is", "should", "treated", "tied"):
            rest = words[1:] if words[0] == "is" else words
            out |= {_letters([f, "not", *rest]) for f in ("is", "are", "was", "were", "")}
        elif words[0] == "has":
            out |= {_letters([f, "no", *words[1:]]) for f in ("has", "have", "had", "having")}
        forms = [words[0], *_verb_forms(words[0])]
        out |= {_letters([n, f, *words[1:]]) for f in forms for n in ("not", "doesnot", "didnot", "donot", "never")}
    else:
        out |= {_letters([n, *words]) for n in ("no", "non", "not", "without", "absenceof", "absent")}
    return out


class Trie:
    """Paths to (entry, edits allowed); ``OPPOSITE`` marks contrary spellings."""

    def __init__(self, entries: Iterable[tuple[int, str, str, str | None]], lexicon: Lexicon = Lexicon()):
        self.lexicon = lexicon
        loose: dict[str, set[int]] = {}
        exact: dict[str, set[int]] = {}
        contrary: set[str] = set()
        plain: set[str] = set()
        for entry, kind, label, aliases in entries:
            for name in [label, *(aliases.split("; ") if aliases else [])]:
                if not name or not _letters(words_of(name)):
                    continue
                plain.add(_letters(words_of(name)))
                a, b = spellings(name, kind)
                for path in a:
                    loose.setdefault(path, set()).add(entry)
                for path in b:
                    exact.setdefault(path, set()).add(entry)
                contrary |= opposites(name, kind, lexicon.contrary)
        self.root: tuple[dict, list] = ({}, [])
        self.longest = 0
        self.alphabet: set[str] = set()
        for path, ids in loose.items():
            for e in ids:
                self._put(path, e, distance_allowed(len(path)))
        for path, ids in exact.items():
            if len(ids) == 1 and path not in loose:  # a shortening of two entries says nothing
                self._put(path, next(iter(ids)), 0)
        for path in contrary - set(loose):
            self._put(path, OPPOSITE, distance_allowed(len(path)))

    def _put(self, path: str, entry: int, edits: int) -> None:
        node = self.root
        for c in path:
            node = node[0].setdefault(c, ({}, []))
        node[1].append((entry, edits))
        self.longest = max(self.longest, len(path))
        self.alphabet.update(path)

    def search(self, values: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All (index of the value, entry, distance) within the allowed distances."""
        # a letter that no path has costs an edit wherever it stands
        foreign = re.compile("[^" + re.escape("".join(sorted(self.alphabet))) + "]" if self.alphabet else ".")
        keep = [i for i, v in enumerate(values) if 0 < len(v) <= self.longest + K and len(foreign.findall(v)) <= distance_allowed(len(v))]
        index = np.array(keep, np.int64)
        n = len(keep)
        if not n:
            return index, index, index
        length = np.array([len(values[i]) for i in keep], np.int16)
        pad, wide = 2 * K + 2, self.longest + 2 * K
        chars = np.zeros((n, pad + wide + pad), np.uint32)
        for row, i in enumerate(keep):
            chars[row, pad : pad + len(values[i])] = np.frombuffer(values[i].encode("utf-32-le"), np.uint32)
        allowed = np.array([distance_allowed(x) for x in range(int(length.max()) + 1)], np.int8)[length]
        band = np.tile(np.where(np.arange(2 * K + 1) >= K, np.arange(2 * K + 1) - K, BIG).astype(np.int8), (n, 1))
        hits: list[tuple[np.ndarray, int, np.ndarray]] = []
        everyone = np.arange(n)
        stack = [(child, ord(c), 0, 1, everyone, band, None) for c, child in self.root[0].items()]
        while stack:
            node, c, c_before, depth, alive, prev, prev2 = stack.pop()
            window = chars[alive, pad + depth - K - 1 : pad + depth + K] if len(alive) == n else chars[alive, pad + depth - K - 1 : pad + depth + K]
            same = window == c
            cur = prev + ~same
            cur[:, :-1] = np.minimum(cur[:, :-1], prev[:, 1:] + 1)
            if prev2 is not None:
                before = chars[alive, pad + depth - K - 2 : pad + depth + K - 1]
                cur = np.where((window == c_before) & (before == c), np.minimum(cur, prev2 + 1), cur)
            if depth < K:
                cur[:, : K - depth] = BIG
            for o in range(1, 2 * K + 1):
                np.minimum(cur[:, o], cur[:, o - 1] + 1, out=cur[:, o])
            ok = cur.min(axis=1) <= allowed[alive]
            if not ok.any():
                continue
            if not ok.all():
                alive, cur, prev = alive[ok], cur[ok], prev[ok]
            if node[1]:
                at = length[alive] - depth + K
                inside = np.flatnonzero((at >= 0) & (at <= 2 * K))
                if len(inside):
                    d = cur[inside, at[inside]]
                    for entry, edits in node[1]:
                        good = d <= np.minimum(edits, allowed[alive[inside]])
                        if good.any():
                            hits.append((alive[inside[good]], entry, d[good]))
            stack += [(child, ord(x), c, depth + 1, alive, cur, prev) for x, child in node[0].items()]
        if not hits:
            none = np.array([], np.int64)
            return none, none, none
        return (
            index[np.concatenate([h[0] for h in hits])],
            np.concatenate([np.full(len(h[0]), h[1], np.int64) for h in hits]),
            np.concatenate([h[2] for h in hits]).astype(np.int64),
        )


def without_fillers(value: str, lexicon: Lexicon = Lexicon()) -> list[str]:
    """The value and what is left of it without words that add nothing."""
    out = [value]
    for w in lexicon.leading:
        if value.startswith(w) and len(value) - len(w) >= 3:
            out.append(value[len(w) :])
    for v in list(out):
        out += [v[: -len(w)] for w in lexicon.trailing if v.endswith(w) and len(v) - len(w) >= 3]
    return out


def candidates(trie: Trie, values: list[str]) -> list[dict[int, int]]:
    """For each canonical value all entries within the allowed distance, with the smallest
    distance; a contrary spelling counts as entry OPPOSITE."""
    queries: list[str] = []
    owner: list[int] = []
    for i, v in enumerate(values):
        for q in without_fillers(v, trie.lexicon):
            queries.append(q)
            owner.append(i)
    out: list[dict[int, int]] = [{} for _ in values]
    for k, e, d in zip(*(x.tolist() for x in trie.search(queries))):
        now = out[owner[k]]
        now[e] = min(d, now.get(e, d))
    return out


def meaning(near: dict[int, int]) -> int | None:
    """The one nearest entry; None if there is none, if an opposite is nearer, or if two
    entries are as near as each other."""
    least = min(near.values(), default=0)
    nearest = {e for e, d in near.items() if d == least} - {OPPOSITE}
    return next(iter(nearest)) if len(nearest) == 1 else None


def meanings(trie: Trie, values: list[str]) -> list[int | None]:
    """``meaning`` of each canonical value."""
    return [meaning(c) for c in candidates(trie, values)]


_TRIES: dict[int, Trie] = {}


def _trie(entries: list[tuple], lexicon: Lexicon) -> Trie:
    """The trie of these entries, built once in a Python worker; the last two are kept."""
    key = hash((tuple(entries), lexicon))
    if key not in _TRIES:
        while len(_TRIES) > 1:
            _TRIES.pop(next(iter(_TRIES)))
        _TRIES[key] = Trie(entries, lexicon)
    return _TRIES[key]


NEAR = pa.list_(pa.struct([("entry_id", pa.int32()), ("distance", pa.int32())]))
NEAR_SHAPE = "near array<struct<entry_id: int, distance: int>>"


def _near(trie: Trie, keys: pa.Array) -> pa.Array:
    return pa.array([[{"entry_id": e, "distance": d} for e, d in sorted(c.items())] for c in candidates(trie, keys.to_pylist())], NEAR)


def typed_values(df: DataFrame, id_col: str, fields: list[str], written: bool = False) -> DataFrame:
    """``<id_col>, field_name, value_key`` of the values with a letter or digit, and the
    ``value`` as ``written``.  The key is made before the values become rows, so that the
    filter on it doesn't make it again."""
    one = lambda f: [F.lit(f).alias("field_name"), letters_and_digits(F.col(f)).alias("value_key"), *([F.col(f).cast("string").alias("value")] if written else [])]
    pairs = F.explode(F.array(*[F.struct(*one(f)) for f in fields]))
    return df.select(F.col(id_col), pairs.alias("v")).select(id_col, "v.*").where("value_key <> ''")


def near_entries(values: DataFrame, entries: DataFrame, lexicon: Lexicon = Lexicon(), block: int = BLOCK) -> DataFrame:
    """``value_key, occurrences, near``: each distinct value with all entries within its
    distance and how far each is; OPPOSITE stands for contrary spellings.

    ``values``: ``value_key``, as often as it occurs.  Each is looked up once.  Across
    blocks a spelling of one entry that is contrary to another's stays listed as both, and
    a shortening of two entries as either: what a value means is the same.
    """
    need(entries, "entry_id", "kind", "label", "aliases")
    listed = entries.select("entry_id", "kind", "label", "aliases").where("label is not null")
    distinct = values.groupBy("value_key").agg(F.count("*").alias("occurrences"))
    rows = [tuple(r) for r in listed.limit(block + 1).collect()]
    if len(rows) <= block:
        shared = values.sparkSession.sparkContext.broadcast(sorted(rows, key=str))

        def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), _near(_trie(shared.value, lexicon), batch.column(0))], names=["value_key", "occurrences", "near"])

        return cut(distinct.mapInArrow(look_up, f"value_key string, occurrences bigint, {NEAR_SHAPE}"), "meanings")

    blocks = -(-listed.count() // block)
    pieces = shuffle_width(values.sparkSession)
    distinct = cut(distinct, "values").withColumn("piece", F.pmod(F.xxhash64("value_key"), F.lit(pieces)))
    each = distinct.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    lists = listed.withColumn("block", F.pmod(F.xxhash64("entry_id"), F.lit(blocks)).cast("int")).withColumn("piece", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(pieces - 1).cast("bigint"))))

    def meet(_: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        columns = [right[c].to_pylist() for c in ("entry_id", "kind", "label", "aliases")]
        trie = _trie(sorted(zip(*columns), key=str), lexicon)
        keys = left["value_key"].combine_chunks()
        return pa.table({"value_key": keys, "occurrences": left["occurrences"], "near": _near(trie, keys)})

    met = each.groupBy("block", "piece").cogroup(lists.groupBy("block", "piece")).applyInArrow(meet, f"value_key string, occurrences bigint, {NEAR_SHAPE}")
    # an entry and OPPOSITE may come from several blocks: the nearest of each
    together = met.where("value_key is not null").select("value_key", "occurrences", F.explode_outer("near").alias("n")).groupBy("value_key", "occurrences", "n.entry_id").agg(F.min("n.distance").alias("distance"))
    listed_again = F.array_sort(F.collect_list(F.when(F.col("entry_id").isNotNull(), F.struct("entry_id", "distance")))).alias("near")
    return cut(together.groupBy("value_key", "occurrences").agg(listed_again), "meanings")


def _meant() -> Column:
    """``meaning`` as an expression over ``near``."""
    least = F.array_min(F.transform("near", lambda c: c["distance"]))
    nearest = F.array_except(F.transform(F.filter("near", lambda c: c["distance"] == least), lambda c: c["entry_id"]), F.array(F.lit(OPPOSITE)))
    return F.when(F.size(nearest) == 1, nearest[0])


def map_values(df: DataFrame, id_col: str, fields: list[str], entries: DataFrame, lexicon: Lexicon = Lexicon(), block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """``(found, unmatched)``.

    ``found``: ``<id_col>, field_name, entry_id`` for each value that means an entry;
    ``unmatched``: ``value, occurrences`` of the distinct values that mean none, each as it
    is typed (the first by code point of writings that differ in case and marks only).
    ``entries``: ``entry_id, kind, label, aliases``.

    Each distinct value, by its letters and digits, is looked up once.  Null, blank
    and letterless values come out in neither.  Repeated rows come out repeated;
    without entries every value is unmatched.  Extra columns aren't read.
    """
    need(df, id_col, *fields)
    values = typed_values(df, id_col, fields)
    known = near_entries(values, entries, lexicon, block).select("value_key", "occurrences", _meant().alias("entry_id"))
    found = frequency_join(values, known.where("entry_id is not null"), "value_key", "occurrences").select(id_col, "field_name", "entry_id")
    none = frequency_join(typed_values(df, id_col, fields, True).select("value_key", "value"), known.where("entry_id is null").drop("entry_id"), "value_key", "occurrences")
    return found, none.groupBy("value_key", "occurrences").agg(F.min("value").alias("value")).select("value", "occurrences")
