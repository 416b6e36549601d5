"""Template residue, filler and error-page text: exemplars by inverted index, TF-IDF containment.

A text is cut into passage windows: its lines (long lines in pieces of about WINDOW
tokens, at sentence ends), and within a line every run of sentences that each retrieve
an exemplar.  A sentence retrieves labelled exemplars through an inverted index over
the tokens that set them apart, and keeps the one it fits best: an exemplar is fit only
if the sentence fills FILLED of its places, so common words scattered over many
exemplars add up to nothing.  A window's containment is the TF-IDF share of its tokens
that the exemplars of its sentences hold, each those of its own sentence only.

Placeholders of any syntax, stack frames, exception names, files, status codes and
quoted names are one token each.  Document frequencies are counted over the whole
corpus in the same pass, in two steps: per Arrow batch in Python, then by token.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.llm.residue_exemplars import ANYWHERE, EVERYDAY, EXEMPLARS, FIELD, FUNCTION_WORDS, NEGATION, PLAIN, THING
from quillgraph.runtime import cut, frequency_join, need

WINDOW = 64
BATCH_ROWS = 200_000
LISTS = {"@thing": THING, "@field": FIELD, "@neg": NEGATION}
#: Share of an exemplar's places that a sentence must fill.
FILLED = 0.7
#: Share of a window's weight that exemplars must hold.
COVERAGE = 0.62
#: Weight of a place of function words against one of other words.
FUNCTION_PLACE = 0.25
#: So many words around a quote make it one, not a sentence of its own.
OWN_WORDS = 3

BLOCK = re.compile(r"(?<!<)</?(?:p|br|hr|div|li|ul|ol|h[1-6]|tr|table|section|article|blockquote)(?:\s[^<>]*)?/?>(?!>)", re.I)
LINES = re.compile(r"[\r\n\f\v\x85  ]+")
#: Ends of sentences; what stands between quotes belongs to the sentence around it.
SENTENCES = re.compile(r"[“\"«][^“”\"«»\n]*[”\"»]|([.!?…]+(?=\s)|(?<!&lt)(?<!&gt);(?=\s)|[。！？]|\s[-–—]\s)")
_NAME = r"[^\W\d_][\w .\-]*"
_LETTERS = r"[^\W\d_]+(?:[ _.\-]+[^\W\d_]+)*"
#: What one of these needs to be there, the pattern, and its mark; in this order, on lower-case text.
MARKS = [
    (needles, re.compile(pattern), mark)
    for needles, pattern, mark in (
        (("{",), r"\$?\{\{[^{}\n]+\}\}|\$\{[^{}\n]+\}|\{%[^%\n]+%\}|(?<![\w\\^}]){\s*" + _NAME + "}", " SLOT "),
        (("<",), r"<%=?[^%\n]+%>|<<\s*" + _NAME + r">>|<(?:your|insert|enter)\s[^<>\n]+>", " SLOT "),
        (("[",), r"\[\s*(?:insert|your|enter|add|type)\s[^\[\]\n]+\]|\[[^\[\]\n]+\sto\s+be\s+added\s*\]|\[\[\s*" + _NAME + r"\]\]", " SLOT "),
        (("&lt;",), r"&lt;\s*" + _NAME + "&gt;", " SLOT "),
        (("«",), r"«\s*" + _NAME + "»", " SLOT "),
        (("@@",), f"@@{_NAME}@@", " SLOT "),
        (("__",), r"__[^\W\d_](?:(?!__)[\w .\-])*__", " SLOT "),
        (("#",), f"#{_LETTERS}#", " SLOT "),
        (("%",), rf"%{_LETTERS}%(?!\w)", " SLOT "),
        (("$",), rf"\${_LETTERS}\$", " SLOT "),
        (("xxxx",), r"xxxx +[^\W\d_](?:(?! xxxx)[\w .\-])* +xxxx\b", " SLOT "),
        (("<",), r"</?[a-z!?][^<>\n]*>", " "),
        (("at ",), r"at\s+[\w.$]+\([\w.]+(?::\d+)?\)", " FRAME "),
        (("()",), r"(?<![\w.])[\w.]+\(\)", " FRAME "),
        (("error", "exception", "java."), r"(?<![\w.])(?:\w+\.)*[a-z]+(?:error|exception)\b|\bjava\.lang\.\w+", " TROUBLE "),
        ((".js", ".py", ".php", ".java", ".go", ".htm"), r"(?<![\w./])[\w./]*\b\w+\.(?:js|py|php|java|go|html?)\b(?::\d+)*", " FILE "),
        (("4", "5"), r"[45]\d\d(?<![\d.,\-][45]\d\d)(?![\w%]|[.,]\d)", " CODE "),
        (("\"", "'", "“", "‘", "`"), r"[\"'“‘`]\w[\w.]*[\"'”’`](?!\s*:)", " NAME "),
    )
]
_CJK = "぀-ヿ㐀-鿿豈-﫿"
WORD = re.compile(rf"(?:n\.){{2}}|[{_CJK}]+|[^\W\d_{_CJK}]+(?:['’][^\W\d_]+)?")
ASCII_WORD = re.compile(r"(?:n\.){2}|[A-Za-z]{2,}(?:'[a-z]+)?|[a-z]'[a-z]+")
CJK = re.compile(f"[{_CJK}]")


def marked(text: str) -> str:
    """A text in lower case, each placeholder, frame, exception, file, code and quoted
    name replaced by its mark."""
    text = text.lower()
    for needles, pattern, mark in MARKS:
        for n in needles:
            if n in text:
                text = pattern.sub(mark, text)
                break
    return text


def words(passage: str) -> list[str]:
    """Tokens of a marked passage; runs of CJK letters give pairs of neighbours; lone ASCII
    letters carry nothing and are left out."""
    if passage.isascii():
        return ASCII_WORD.findall(passage)
    out: list[str] = []
    for w in WORD.findall(passage):
        if len(w) > 1:
            if w[0] > "\u303f" and CJK.match(w):
                out += [w[i : i + 2] for i in range(len(w) - 1)]
            else:
                out.append(w)
        elif not w.isascii():
            out.append(w)
    return out


def tokens(text: str) -> list[str]:
    """Tokens of a text as it is written."""
    return words(marked(text))


def lines_ended(text: str) -> str:
    """A text with a line break for each block tag."""
    return BLOCK.sub("\n", text) if "<" in text else text


def lines_of(text: str) -> list[tuple[str, set[str]]]:
    """The marked lines of a text and the tokens of each."""
    return [(line, set(words(line))) for line in LINES.split(marked(lines_ended(text))) if line]


def sentences(line: str) -> Iterator[tuple[list[str], list[str]]]:
    """Of each sentence of a marked line its tokens, and those that are its own: without
    what it quotes, if OWN_WORDS words that say something stand around the quotes."""
    at = 0
    quotes: list[tuple[int, int]] = []
    for m in SENTENCES.finditer(line):
        if m.group(1) is None:
            quotes.append(m.span())
        else:
            yield from _sentence(line, at, m.end(), quotes)
            at, quotes = m.end(), []
    yield from _sentence(line, at, len(line), quotes)


def _sentence(line: str, at: int, end: int, quotes: list[tuple[int, int]]) -> Iterator[tuple[list[str], list[str]]]:
    found = words(line[at:end])
    if not found:
        return
    if quotes:
        around = line[at : quotes[0][0]] + " ".join(line[b:a] for (_, b), (a, _) in zip(quotes, [*quotes[1:], (end, end)]))
        own = words(around)
        if sum(1 for t in own if t not in FUNCTION_WORDS and not t.isupper()) >= OWN_WORDS:
            yield found, [*own, *(t for t in words(" ".join(line[a:b] for a, b in quotes)) if t.isupper())]
            return
    yield found, found


def pieces(found: Iterator[tuple[list[str], list[str]]]) -> Iterator[tuple[list[str], list[str]]]:
    """Sentences, those above WINDOW tokens in even pieces."""
    for s, own in found:
        if len(s) <= WINDOW:
            yield s, own
        else:
            size = -(-len(s) // -(-len(s) // WINDOW))
            yield from ((s[i : i + size], s[i : i + size]) for i in range(0, len(s), size))


class Exemplar:
    """Places of one exemplar: ``required`` as (words, how many of them, weight), those
    with the rarest words first."""

    def __init__(self, kind: str, written: str):
        self.kind = kind
        self.words: set[str] = set(ANYWHERE) if kind != "filler" else set()
        self.required: list[tuple[frozenset[str], int, float]] = []
        for place in written.split():
            least, star, rest = place.partition("*")
            least, rest = (int(least), rest) if star else (1, place)
            words = frozenset(w for p in rest.rstrip("?").split("|") for w in LISTS.get(p, p).split("|"))
            self.words |= words
            if not rest.endswith("?"):
                self.required.append((words, least, FUNCTION_PLACE if words <= FUNCTION_WORDS else 1.0))
        self.whole = sum(w for _, _, w in self.required)
        self.slack = 0.0

    def order(self, use: Counter, filled: float) -> None:
        """Put the places that say most first, and note what weight may stay empty."""
        self.required.sort(key=lambda r: (r[2] < 1, not FUNCTION_WORDS.isdisjoint(r[0]), not EVERYDAY.isdisjoint(r[0]), max(use[t] for t in r[0])))
        self.slack = self.whole * (1 - filled) + 1e-9

    def anchors(self) -> set[str]:
        """Words of the first places: one of these is filled wherever enough places are."""
        out: set[str] = set()
        left = self.slack
        for words, _, weight in self.required:
            out |= words
            left -= weight
            if left < 0:
                break
        return out

    def fits(self, found: Counter | set[str]) -> bool:
        """Are enough places filled?  A set of tokens is taken to hold each often enough."""
        left = self.slack
        counted = isinstance(found, Counter)
        for words, least, weight in self.required:
            if words.isdisjoint(found) or (counted and least > 1 and sum(found[t] for t in words if t in found) < least):
                left -= weight
                if left < 0:
                    return False
        return True


class Index:
    """Inverted index from the tokens that set exemplars apart to exemplars."""

    def __init__(self, exemplars: list[tuple[str, str]] = EXEMPLARS, plain: list[str] = PLAIN, filled: float = FILLED):
        self.plain = [frozenset(tokens(t)) for t in plain]
        self.exemplars = [Exemplar(kind, t) for kind, t in exemplars]
        use = Counter(t for e in self.exemplars for words, _, _ in e.required for t in words)
        self.posting: dict[str, list[Exemplar]] = {}
        for e in self.exemplars:
            e.order(use, filled)
            for t in e.anchors():
                self.posting.setdefault(t, []).append(e)
        self.anchors = frozenset(self.posting)

    def retrieved(self, found: set[str]) -> tuple[list[Exemplar], frozenset[str]]:
        """Exemplars that a text with these tokens could hold, and the tokens that led to them."""
        by: dict[Exemplar, list[str]] = {}
        for t in self.anchors.intersection(found):
            for e in self.posting[t]:
                by.setdefault(e, []).append(t)
        by = {e: led for e, led in by.items() if e.fits(found)}
        return list(by), frozenset(t for led in by.values() for t in led)

    def fit(self, sentence: list[str], among: list[Exemplar]) -> Exemplar | None:
        """The exemplar that holds most of a sentence, of those it fills enough of."""
        held = Counter(sentence)
        best, most = None, 0.0
        for e in among:
            if e.fits(held):
                share = sum(FUNCTION_PLACE if t in FUNCTION_WORDS else 1.0 for t in held if t in e.words)
                if share > most:
                    best, most = e, share
        return best

    def passages(self, lines: list[tuple[str, set[str]]], among: list[Exemplar], led: frozenset[str]) -> Iterator[tuple[Counter, Counter]]:
        """For each window of a text's lines that retrieves an exemplar: its tokens, and those held."""
        for line, distinct in lines:
            if led.isdisjoint(distinct):
                continue
            here = [e for e in among if e.fits(distinct)]
            if not here:
                continue
            window: list[tuple[list[str], Exemplar | None]] = []
            size = 0
            for s, own in pieces(sentences(line)):
                if window and size + len(s) > WINDOW:
                    yield from self._windows(window)
                    window, size = [], 0
                window.append((s, self.fit(own, here)))
                size += len(s)
            yield from self._windows(window)

    def _windows(self, window: list[tuple[list[str], Exemplar | None]]) -> Iterator[tuple[Counter, Counter]]:
        if not any(e for _, e in window):
            return
        distinct = {t for s, _ in window for t in s}
        if not any(distinct <= p for p in self.plain):
            yield _counted(window)
        run: list[tuple[list[str], Exemplar | None]] = []
        if len(window) > 1 and not all(e for _, e in window):
            for s, e in [*window, ([], None)]:
                if e:
                    run.append((s, e))
                elif run:
                    if not any({t for s, _ in run for t in s} <= p for p in self.plain):
                        yield _counted(run)
                    run = []


def _counted(window: list[tuple[list[str], Exemplar | None]]) -> tuple[Counter, Counter]:
    """Tokens of a window and how many of each are held; function words, which say nothing
    for or against, only where there are no others."""
    every, held = Counter(), Counter()
    for s, e in window:
        every.update(s)
        if e:
            held.update(t for t in s if t in e.words)
    telling = Counter({t: n for t, n in every.items() if t not in FUNCTION_WORDS})
    return telling or every, held

_INDEX: list[Index] = []


def _index() -> Index:
    if not _INDEX:
        _INDEX.append(Index())
    return _INDEX[0]


COUNTED = -1


def _passages(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One pass over the texts: ``id, window, token, n, held``.

    For windows that retrieve an exemplar their distinct tokens, how often each stands
    there and how often its sentence's exemplar holds it; and, as window COUNTED without
    an id, in how many texts of an Arrow batch each token stands.
    """
    id_type = df.schema[id_col].dataType.simpleString()
    types = [pa.int32(), pa.string(), pa.int64(), pa.int64()]
    names = ["id", "window", "token", "n", "held"]

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = _index()
        for batch in batches:
            seen: Counter = Counter()
            row: list[int] = []
            cols: list[list] = [[], [], [], []]

            def made() -> pa.RecordBatch:
                ids = batch.column(0).take(pa.array(row, pa.int64()))  # noqa: B023
                out = pa.RecordBatch.from_arrays([ids, *[pa.array(c, t) for c, t in zip(cols, types)]], names=names)  # noqa: B023
                row.clear()  # noqa: B023
                for c in cols:  # noqa: B023
                    c.clear()
                return out

            for i, text in enumerate(batch.column(1)):
                lines = lines_of(text.as_py())
                here: set[str] = set().union(*[found for _, found in lines])
                seen.update(here)
                among, led = index.retrieved(here)
                for k, (every, held) in enumerate(index.passages(lines, among, led) if among else ()):
                    for t, n in every.items():
                        row.append(i)
                        for c, v in zip(cols, (k, t, n, held[t])):
                            c.append(v)
                    if len(row) > BATCH_ROWS:  # long texts: pass on what there is
                        yield made()
            yield made()
            none = pa.nulls(len(seen), batch.column(0).type)
            counted = [pa.array([COUNTED] * len(seen), pa.int32()), pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64()), pa.nulls(len(seen), pa.int64())]
            yield pa.RecordBatch.from_arrays([none, *counted], names=names)

    out = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("text is not null")
    return out.mapInArrow(find, f"id {id_type}, window int, token string, n bigint, held bigint")


def _frequencies(passages: DataFrame) -> DataFrame:
    return passages.where(F.col("window") == COUNTED).groupBy("token").agg(F.sum("n").alias("df"))


def document_frequencies(df: DataFrame, text_col: str) -> DataFrame:
    """``token, df``: in how many texts of the whole corpus each token stands."""
    return _frequencies(_passages(df.select(F.lit(0).alias("id"), text_col), "id", text_col))


def residue_windows(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id, window, containment, weight`` of every window that retrieves an exemplar."""
    need(df, id_col, text_col)
    passages = cut(_passages(df, id_col, text_col), "passages")  # read for counts and for both halves of the join
    frequencies = cut(_frequencies(passages), "frequencies")
    n = F.lit(max(1, df.count()))
    candidates = passages.where(F.col("window") != COUNTED).withColumnRenamed("n", "tf")
    weighed = frequency_join(candidates, frequencies, "token", "df")
    idf = F.log((n + 1) / (F.col("df") + 1)) + 0.1
    return (
        weighed.groupBy("id", "window")
        .agg(F.sum(F.col("tf") * idf).alias("weight"), F.sum(F.col("held") * idf).alias("held_weight"))
        .select("id", "window", (F.col("held_weight") / F.col("weight")).alias("containment"), "weight")
    )


def residue_documents(df: DataFrame, id_col: str, text_col: str, coverage: float = COVERAGE) -> DataFrame:
    """``<id_col>`` of the texts that hold a window of residue, once per id.

    Null, empty and blank texts hold nothing.  Long texts are read whole, window by
    window.  A repeated row gives its id once; a null id comes out as null.
    """
    found = residue_windows(df, id_col, text_col).where(F.col("containment") >= coverage)
    return found.select(F.col("id").alias(id_col)).distinct()


def without_residue(df: DataFrame, id_col: str, text_col: str, coverage: float = COVERAGE) -> DataFrame:
    """``df`` without the rows whose text holds residue; all columns stay."""
    return df.join(residue_documents(df, id_col, text_col, coverage).where(F.col(id_col).isNotNull()), id_col, "left_anti").select(*df.columns)
