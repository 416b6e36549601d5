"""Several values packed in one field: a parsing expression grammar for name lists.

Grammar (``/`` is ordered choice; a failing alternative gives its input back)::

    field    <- blank* (listing / series) blank*
    listing  <- '[' items ']' / '{' items '}'
    items    <- slot (',' slot)*
    series   <- slot (strong slot)*
    slot     <- quoted / bare
    quoted   <- '"' ('""' / '\\"' / !'"' .)* '"' &(blank* (separator / end))
    bare     <- (bracketed / inner / !separator .)*
    bracketed<- '(' (!')' .)* ')'
    inner    <- '"' (!'"' .)* '"'
    strong   <- ';'+ / '|'+ / line break / tab / ' / '
    name     <- surname ',' given (',' degree)* / full (',' degree)*
    names    <- name ((',' / 'and' / '&') name)*

A quote that never closes fails ``quoted``; the parser backtracks, reads the slot
as bare text and marks it ``open_quote``.  Line breaks, tabs and conjunctions
separate only if what they cut off can be a name by itself; otherwise they
belong to the name ("Foundation for Genetics and Health").
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.runtime import need

# Words that the grammar treats specially.
DEGREES = frozenset(
    "md phd msc bsc mph mbbs mbchb dphil dsc ma ba ms bs mba rn do dds dvm pharmd mphil frcp frcpch facs mrcp edd jd llm llb meng beng jr sr ii iii iv dr prof".split()
)
PARTICLES = frozenset("de da di do du dos das del della den der van von vom zu zur la le les el al bin ibn ten ter te".split())
UNNAMED = re.compile(
    r"^(?:(?:and|&)\s+)?(?:et\.?\s*al(?:ii|ia|\b)\.?|(?:\d+\s+)?(?:others?|more|colleagues|co-?workers|associates|(?-i:u\.\s?a\.)|etc\.?|coll\.?|further authors|et\s+coll\.?|…|\.\.\.))\W*$",
    re.I,
)
ET_AL_TAIL = re.compile(r"[\s,]+(?:et\.?\s*al(?:ii)?\.?|(?:and|&)\s+(?:others|colleagues|co-?workers))\s*$", re.I)
STRONG = re.compile(r"\s*(?:;[;\s]*|\|[|\s]*)")
BREAK = re.compile(r"[ \xa0]*[\r\n\t]+\s*")
SLASH = re.compile(r"\s+/\s+")
CONJ = re.compile(r"\s*,?\s*(?:\s(?:and|AND|And)\s|\s?&\s?)\s*")
QUOTED_JOIN = re.compile(r"\s*,\s*(?:(?:and|&)\s+)?|\s+(?:&|and|AND)\s+(?=\")|(?<=\")\s+(?:&|and|AND)\s+")
SPACES = re.compile(r"\s+")
INITIALS = re.compile(r"^(?:[^\W\d_](?:[.\s-]+[^\W\d_])*\.?|[^\W\d_]{1,4}\.?)$")
EDGE = " \t\r\n\f\v\xa0  ﻿​"


class _Open(Exception):
    """A quote without an end: the alternative fails."""


def _quoted(text: str, at: int, ends: str) -> tuple[str, int]:
    """Match ``quoted`` at ``at``; gives the value and the place behind it."""
    out, i, n = [], at + 1, len(text)
    while i < n:
        c = text[i]
        if c == "\\" and i + 1 < n and text[i + 1] in '"\\':
            out.append(text[i + 1])
            i += 2
        elif c == '"' and i + 1 < n and text[i + 1] == '"' and not (out == [] and _closes(text, i + 2, ends) and i + 2 >= n):
            out.append('"')
            i += 2
        elif c == '"':
            if not _closes(text, i + 1, ends):
                raise _Open
            return "".join(out), i + 1
        else:
            out.append(c)
            i += 1
    raise _Open


def _closes(text: str, at: int, ends: str) -> bool:
    """Lookahead of ``quoted``: only blanks up to a separator or the end."""
    while at < len(text) and text[at] in " \xa0":
        at += 1
    return at >= len(text) or text[at] in ends or text[at] in "\r\n\t" or (text[at] in "/&" and "&" in ends) or ("&" in ends and bool(re.match(r"and\s", text[at:], re.I)))


def _slots(text: str, separators: re.Pattern, ends: str) -> list[tuple[str, bool, str]]:
    """Cut ``text`` at the separators outside quotes and brackets: (value, quoted, flag)."""
    out: list[tuple[str, bool, str]] = []
    i, n = 0, len(text)
    while i <= n:
        while i < n and text[i] in EDGE and not separators.match(text, i):
            i += 1
        flag, value, was_quoted = "", None, False
        if i < n and text[i] == '"':
            try:
                value, i = _quoted(text, i, ends)
                was_quoted = True
            except _Open:
                flag = "open_quote"  # backtrack: the slot is bare
        start = i
        while i < n:
            m = separators.match(text, i)
            if m and m.end() > i:
                break
            if text[i] in '("':
                close = text.find(")" if text[i] == "(" else '"', i + 1)
                if close < 0:
                    flag = flag or ("open_bracket" if text[i] == "(" else "open_quote")
                    i += 1
                elif text[i] == '"' and i == start and value is None and separators.search(text, i, close):
                    i += 1
                else:
                    i = close + 1
                continue
            i += 1
        rest = text[start:i]
        if value is None:
            value = rest
        elif rest.strip(EDGE):
            value, was_quoted = value + rest, False
        out.append((value, was_quoted, flag))
        if i >= n:
            break
        i = separators.match(text, i).end()
    return out


@lru_cache(maxsize=65536)
def _words(piece: str) -> int:
    """Words that can carry a name: no bracketed nickname, particle or degree."""
    bare = re.sub(r"\([^)]*\)|\"[^\"]*\"", " ", piece)
    words = bare.split()
    # a particle stands before another word; behind it the same letters are initials
    return sum(1 for i, w in enumerate(words) if (i + 1 == len(words) or w.lower().strip(".,") not in PARTICLES) and any(c.isalnum() for c in w))


def _degree(piece: str) -> bool:
    words = piece.replace(".", "").replace("(", " ").replace(")", " ").lower().split()
    return bool(words) and all(w in DEGREES for w in words)


def _given(piece: str) -> bool:
    """Can ``piece`` stand behind the comma of an inverted name?"""
    return bool(INITIALS.match(piece)) or _words(piece) == 1 or (bool(re.match(r"^[^\W\d_]+(?:[\s-]+[^\W\d_]\.?){1,3}(?:\s*[(\"].*)?$", piece)))


def _stands(piece: str) -> bool:
    """Can ``piece`` be a name by itself?"""
    return "," in piece or _words(piece) >= 2


def _names(text: str) -> list[str]:
    """Match ``names`` in a slot that holds no strong separator."""
    parts: list[tuple[str, str]] = []  # (joiner as written, piece)
    at, joiner = 0, ""
    cutter = re.compile(rf"{CONJ.pattern}|\s*,\s*")
    depth_free = _outside(text)
    for m in cutter.finditer(text):
        if not depth_free(m.start()):
            continue
        parts.append((joiner, text[at : m.start()]))
        joiner, at = m.group(), m.end()
    parts.append((joiner, text[at:]))
    out: list[str] = []
    surname_open = False  # the last name is a surname that waits for its given name
    for k, (joiner, piece) in enumerate(parts):
        piece = piece.strip(EDGE)
        if not piece or UNNAMED.match(piece):
            continue
        comma = joiner.strip().startswith(",") and not re.search(r"and|&", joiner, re.I)
        if not out or not joiner:
            out.append(piece)
            surname_open = _words(piece) <= 1
        elif comma and _degree(piece):
            out[-1] += f", {piece}"
        elif comma and surname_open and _given(piece):
            out[-1] += f", {piece}"
            surname_open = False
        elif comma and _words(piece) <= 1 and _given(piece) and "," not in out[-1] and len(parts) == 2:
            out[-1] += f", {piece}"
            surname_open = False
        elif not comma and _words(piece) <= 1 and not _followed(parts, k):
            out[-1] += joiner + piece  # the conjunction belongs to the name
            surname_open = False
        else:
            out.append(piece)
            surname_open = _words(piece) <= 1
    return out


def _followed(parts: list[tuple[str, str]], k: int) -> bool:
    """Is the single word of part ``k`` a surname whose given name comes next?"""
    if k + 1 == len(parts):
        return False
    joiner, after = parts[k + 1]
    after = after.strip(EDGE)
    return joiner.strip() == "," and (bool(INITIALS.match(after)) or len(after.split()) == 1) and not _degree(after) and not UNNAMED.match(after)


def _outside(text: str):
    """A test whether a place is outside brackets and quotes."""
    if "(" not in text and '"' not in text:
        return lambda i: True
    spans = [m.span() for m in re.finditer(r"\([^)]*\)|\"[^\"]*\"", text)]  # in order and apart
    starts = [a for a, _ in spans]

    def outside(i: int) -> bool:
        k = bisect_right(starts, i) - 1
        return k < 0 or spans[k][1] <= i

    return outside


def _clean(value: str) -> str:
    value = SPACES.sub(" ", value).strip(EDGE)
    while len(value) > 1 and value[0] == value[-1] == '"' and '"' not in value[1:-1]:
        value = value[1:-1].strip(EDGE)
    value = ET_AL_TAIL.sub("", value).strip(EDGE)
    return value.rstrip(",;|").strip(EDGE)


def parse_names(text: str | None) -> list[tuple[int, str, str]]:
    """All names of one packed field as ``(position, name, flag)``.

    ``flag`` is '' for well-formed input, else ``open_quote``, ``open_bracket`` or
    ``open_list``.  Null, empty and blank texts give no name.
    """
    if text is None or not text.strip(EDGE):
        return []
    body, outer = text.strip(EDGE), ""
    slots: list[tuple[str, bool, str]]
    if body[0] in "[{":
        closer = "]" if body[0] == "[" else "}"
        if body.endswith(closer):
            inner = body[1:-1]
        else:
            inner, outer = body[1:], "open_list"
        slots = _slots(inner, re.compile(r"\s*,\s*"), ",")
        if not any(q for _, q, _ in slots):  # bare words in brackets: an ordinary series
            return [(p, v, f or outer) for p, v, f in parse_names(inner)]
    else:
        # a series of quoted values may be cut by plain commas
        slots = _series(body)
    out: list[tuple[int, str, str]] = []
    for value, was_quoted, flag in slots:
        if was_quoted and len(slots) > 1 or was_quoted and body[0] in "[{":
            names = [value]
        else:
            names = _names(value)
        for name in names:
            name = _clean(name)
            if name and any(c.isalnum() for c in name) and not UNNAMED.match(name):
                out.append((len(out) + 1, name, flag or outer))
    return out


def _series(body: str) -> list[tuple[str, bool, str]]:
    """Cut a series at its strong separators, then at breaks and slashes that
    leave only whole names, then bare slots at commas between quoted values."""
    slots = _slots(body, STRONG, ";|,&")
    for weak in (BREAK, SLASH):
        wide = []
        for value, quoted, flag in slots:
            if quoted or not weak.search(value):
                wide.append((value, quoted, flag))
                continue
            cut = [s for s in _slots(value, weak, ";|,&/") if s[0].strip(EDGE)]
            whole = all(s[1] or _stands(s[0]) or UNNAMED.match(s[0].strip(EDGE)) for s in cut)
            wide += [(v, q, f or flag) for v, q, f in cut] if whole else [(value, quoted, flag)]
        slots = wide
    out = []
    for value, quoted, flag in slots:
        if not quoted and '"' in value:
            cut = _slots(value, QUOTED_JOIN, ",&")
            if any(q for _, q, _ in cut):
                run: list[str] = []  # neighbouring bare slots stay one text: they may be inverted names
                for v, q, f in cut:
                    if q:
                        out += [(", ".join(run), False, flag)] if run else []
                        out.append((v, True, f or flag))
                        run = []
                    else:
                        run.append(v)
                out += [(", ".join(run), False, flag)] if run else []
                continue
        out.append((value, quoted, flag))
    return out


def split_packed(df: DataFrame, id_col: str, packed_col: str) -> DataFrame:
    """One row per value: ``<id_col>, pos INT, author STRING, flag STRING``.

    Narrow: an Arrow map over the two columns, no shuffle, whatever the length of
    the field.  Null, empty and blank fields, empty places and words for unnamed
    authors give no row; repeated rows are parsed once each; further columns of
    ``df`` are not read.  A null id is kept as null.
    """
    need(df, id_col, packed_col)
    id_type = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            take, pos, author, flag = [], [], [], []
            for i, text in enumerate(texts):
                for p, name, f in parse_names(text):
                    take.append(i)
                    pos.append(p)
                    author.append(name)
                    flag.append(f)
            ids = batch.column(0).take(pa.array(take, pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(pos, pa.int32()), pa.array(author, pa.string()), pa.array(flag, pa.string())], names=["id", "pos", "author", "flag"]
            )

    out = df.select(F.col(id_col).alias("id"), F.col(packed_col).alias("packed")).where(F.col("packed").isNotNull())
    return out.mapInArrow(run, f"id {id_type}, pos int, author string, flag string").withColumnRenamed("id", id_col)
