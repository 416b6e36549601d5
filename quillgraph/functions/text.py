"""Text functions as Column expressions: all of them stay in the JVM."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillgraph.functions import constants as C

#: White space of any script, as a character class that other engines read alike.
WS = r"[\t\n\x0B\f\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
WRAPPING = " |\t\n\r'\"`*[]{}()"


def sub(c: Column, pattern: str, by: str = "") -> Column:
    return F.regexp_replace(c, pattern, by)


def text_or_empty(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body uses it."""
    return F.transform(F.array(value), body)[0]


def strip_ws(c: Column) -> Column:
    """Without white space of any script at either end."""
    return sub(c, f"^{WS}+|{WS}+$")


def squeeze(c: Column) -> Column:
    """Stripped, each run of white space one space; '' for null."""
    return sub(strip_ws(text_or_empty(c)), f"{WS}+", " ")


def normalize_label(c: Column) -> Column:
    """A label for comparison: squeezed, lower case."""
    return F.lower(squeeze(c))


def strip_set(c: Column, characters: str) -> Column:
    """Without any of ``characters`` at either end."""
    quoted = "".join("\\" + x if not x.isalnum() and not x.isspace() else x for x in characters)
    return sub(c, f"^[{quoted}]+|[{quoted}]+$")


def split_camel(c: Column) -> Column:
    """Camel case and symbols opened to words, lower case; not trimmed."""
    opened = sub(text_or_empty(c), "([a-z0-9])([A-Z])", "$1 $2")
    return F.lower(sub(sub(opened, r"[_/\\\-]+", " "), "[^A-Za-z0-9]+", " "))


def singular(t: Column) -> Column:
    """A token without its English plural ending."""
    n = F.length(t)
    ending = lambda *ends: t.rlike("(?:" + "|".join(ends) + ")$")
    return (
        F.when((n > 5) & ending("ies"), F.concat(F.left(t, n - 3), F.lit("y")))
        .when((n > 5) & ending("ches", "shes", "xes", "zes", "ses"), F.left(t, n - 2))
        .when((n > 4) & ending("s") & ~ending("ss"), F.left(t, n - 1))
        .otherwise(t)
    )


def words(c: Column) -> Column:
    """Runs of ASCII letters and digits in order."""
    return F.regexp_extract_all(c, F.lit("([a-z0-9]+)"))


def kg_tokens(c: Column) -> Column:
    """Retrieval tokens: singular first, then three letters or more and no stopword."""
    return tokens_of(words(split_camel(c)))


def tokens_of(words: Column) -> Column:
    """Retrieval tokens of words of small letters."""
    stop = F.array(*[F.lit(w) for w in C.STOPWORDS])
    return F.filter(F.transform(words, singular), lambda t: (F.length(t) >= 3) & ~F.array_contains(stop, t))


def article_tokens(c: Column) -> Column:
    """Article tokens: three letters or more first, then singular; stopwords stay."""
    return F.transform(F.filter(words(F.lower(c)), lambda t: F.length(t) >= 3), singular)


def ngrams(tokens: Column, n: int) -> Column:
    """Texts of ``n`` neighbouring tokens in order."""

    def spans(t: Column) -> Column:
        last = F.size(t) - n
        return F.when(last >= 0, F.transform(F.sequence(F.lit(0), last), lambda i: F.array_join(F.slice(t, i + 1, n), " "))).otherwise(F.array().cast("array<string>"))

    return let(tokens, spans)


def phrases(c: Column) -> Column:
    """2-, 3- and 4-grams of words that are no stopword, 5 to 80 letters; repeats stay."""
    stop = F.array(*[F.lit(w) for w in C.STOPWORDS])
    kept = F.filter(words(split_camel(c)), lambda t: (F.length(t) >= 3) & ~F.array_contains(stop, t))
    return let(kept, lambda k: F.filter(F.concat(ngrams(k, 2), ngrams(k, 3), ngrams(k, 4)), lambda p: F.length(p).between(5, 80)))


def lookup(c: Column, table: dict, default: Column | None = None) -> Column:
    """Value of ``c`` in a small fixed table."""
    found = F.element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), c)
    return F.coalesce(found, default) if default is not None else found


def section(c: Column) -> Column:
    """Introduction, Methods, Results, Discussion, or '' (exact titles only)."""
    return lookup(normalize_label(c), C.SECTIONS, F.lit(""))


def section_label(c: Column) -> Column:
    """Label of a section title by the first needle it holds; 'default' without one."""

    def first_held(t: Column) -> Column:
        out = F
        for needle, label in C.SECTION_NEEDLES:
            out = out.when(t.contains(needle), label)
        return out.otherwise("default")

    return let(F.lower(strip_ws(text_or_empty(c))), first_held)


def section_weight(label: Column) -> Column:
    return lookup(label, C.SECTION_WEIGHTS, F.lit(C.SECTION_WEIGHTS["default"]))


def triple_value(c: Column) -> Column:
    """A value of a triple: squeezed, without bars around it."""
    return sub(squeeze(c), r"^\|+|\|+$")


def unwrap(c: Column) -> Column:
    """Without wrapping punctuation, squeezed."""
    return squeeze(strip_set(squeeze(c), WRAPPING))


def camel_label(c: Column) -> Column:
    """Words joined with capitals; one word and words in capitals or with digits stay."""

    def one(p: Column) -> Column:
        kept = ((p == F.upper(p)) & (p != F.lower(p))) | p.rlike("[0-9]")
        return F.when(kept, p).otherwise(F.concat(F.upper(F.left(p, F.lit(1))), F.substring(p, 2, 1 << 30)))

    def joined(value: Column) -> Column:
        parts = F.transform(F.split(value, f"(?:{WS}|_)+"), lambda p: let(strip_set(p, "-/,;:.()[]{}"), one))
        return F.when(value.contains(" ") | value.contains("_"), F.array_join(parts, "")).otherwise(value)

    return let(unwrap(c), joined)


def entity_label(c: Column) -> Column:
    """Label of an entity: no article, no web address, camel case."""
    value = sub(unwrap(c), f"^(?i:a|an|the){WS}+")
    return camel_label(strip_ws(sub(value, "https?://[^\\s]+")))


def predicate_label(c: Column) -> Column:
    """Relation of a predicate: phrase table, then stems in order, then camel case."""

    def relation(raw: Column, low: Column) -> Column:
        tool, use = C.TREATMENT_WORDS
        out = F.when(low.rlike(tool) & low.rlike(use), "hasTreatment")
        for pattern, name in C.PREDICATE_STEMS:
            out = out.when(low.rlike(pattern), name)
        return F.coalesce(lookup(low, C.PREDICATES), out.otherwise(camel_label(raw)))

    bare = squeeze(sub(unwrap(c), f"^(?i:is|are|was|were){WS}+"))
    return let(bare, lambda raw: let(F.lower(raw), lambda low: relation(raw, low)))


def word_count(c: Column) -> Column:
    return F.regexp_count(text_or_empty(c), F.lit("[A-Za-z0-9]+"))


def looks_like_sentence(c: Column) -> Column:
    """Sentence marks, too many words, or a sentence's beginning."""

    def test(value: Column) -> Column:
        starts = F.lower(value).rlike("^(?:this study|the study|we |our |these results|the results|the authors|it |they |there )")
        return (value != "") & (value.contains(". ") | value.contains(";") | value.contains(":") | (word_count(value) > C.MAX_ENTITY_WORDS) | starts)

    return let(squeeze(c), test)


def pmcid_number(c: Column) -> Column:
    """'PMC123' or '123' as BIGINT; null for anything else."""
    return sub(strip_ws(text_or_empty(c)), "^(?i:pmc)(?=[0-9]+$)|^.*[^0-9].*$").try_cast("bigint")


def id_list(c: Column) -> Column:
    """Ids of a list cut at white space, commas or semicolons: numbers only, first place counts."""
    parts = F.transform(F.split(F.upper(text_or_empty(c)), f"(?:{WS}|[,;])+"), lambda p: F.replace(p, F.lit("PMC"), F.lit("")))
    return F.array_distinct(F.transform(F.filter(parts, lambda p: p.rlike("^[0-9]+$")), lambda p: p.cast("bigint")))


def authors(c: Column) -> Column:
    """Names of a plain author list: the first separator present of ``;  |  ,  and``."""

    def cut(t: Column) -> Column:
        parts = (
            F.when(t.contains(";"), F.split(t, ";"))
            .when(t.contains("|"), F.split(t, r"\|"))
            .when(t.contains(","), F.split(t, ","))
            .when(F.lower(t).contains(" and "), F.split(t, f"(?i){WS}+and{WS}+"))
            .otherwise(F.array(t))
        )
        return F.filter(F.transform(parts, strip_ws), lambda p: p != "")

    return let(squeeze(c), cut)


def first_author(first: Column, all_: Column) -> Column:
    """The stated first author, else the first of the list, else ''."""
    return F.coalesce(F.nullif(strip_ws(text_or_empty(first)), F.lit("")), F.get(authors(all_), F.lit(0)), F.lit(""))


def several_authors(all_: Column) -> Column:
    return let(strip_ws(text_or_empty(all_)), lambda t: t.contains(";") | t.contains("|") | t.contains(" and ") | (F.size(authors(t)) > 1))


# The patterns below (marks of answers, of markdown and of hidden parts) are fixed values of
# the format that is read.


def sanitized(c: Column) -> Column:
    """An answer without grounding notes, web addresses and spare blanks."""
    t = text_or_empty(c)
    for pattern, by in (
        (r"(?i)\([^)]*?KG-grounded[^)]*?\)", ""),
        (r"(?i)\([^)]*?example\.org[^)]*?\)", ""),
        (f"(?i)https?://[^{WS[1:-1]}]+", ""),
        (r"(?i)<https?://[^>]+>", ""),
        (r"[ \t]{2,}", " "),
        (r"\n{3,}", "\n\n"),
    ):
        t = sub(t, pattern, by)
    return strip_ws(t)


def plain_text(c: Column) -> Column:
    """Markdown without its marks."""
    t = text_or_empty(c)
    for pattern, by in (
        ("```+", ""),
        (f"(?m)^{WS}{{0,3}}#{{1,6}}{WS}*", ""),
        (f"(?m)^{WS}*[-*+]{WS}+", ""),
        (f"(?m)^{WS}*[0-9]+[.)]{WS}+", ""),
        (r"\*\*(.*?)\*\*", "$1"),
        (r"\*(.*?)\*", "$1"),
        ("__(.*?)__", "$1"),
        ("_(.*?)_", "$1"),
        ("`([^`]*)`", "$1"),
        (r"[ \t]{2,}", " "),
        (r"\n{3,}", "\n\n"),
    ):
        t = sub(t, pattern, by)
    return strip_ws(t)


def finalized(c: Column) -> Column:
    """What a user may see: nothing behind an internal marker, no answer marker."""
    t = sub(text_or_empty(c), r"(?s)---\*\*\*---.*$")
    t = sub(t, rf"(?is)\[\[{WS}*RAW_TRIPLES{WS}*\]\].*$")
    t = sub(t, rf"(?is)\[\[{WS}*KG_SUMMARY{WS}*\]\].*$")
    return sub(strip_ws(sub(t, rf"(?i)\[\[{WS}*ANSWER{WS}*\]\]")), r"\n{3,}", "\n\n")


def marked_sections(c: Column) -> Column:
    """Struct ``answer, kg_summary, raw_triples`` of a marked response."""
    t = text_or_empty(c)
    mark = lambda name: rf"\[\[{WS}*{name}{WS}*\]\]"

    def part(start: str, end: str | None) -> Column:
        stop = rf"(?:{mark(end)}|\z)" if end else r"\z"
        return strip_ws(F.regexp_extract(t, rf"(?is){mark(start)}(.*?){stop}", 1))

    return F.struct(part("ANSWER", "KG_SUMMARY").alias("answer"), part("KG_SUMMARY", "RAW_TRIPLES").alias("kg_summary"), part("RAW_TRIPLES", None).alias("raw_triples"))


def answer_and_triples(c: Column) -> Column:
    """Struct ``answer, triples``: what stands before the hidden triples, and these up to
    the next marker."""
    mark = rf"(?is)\[\[{WS}*RAW_TRIPLES{WS}*\]\]"
    hidden = F.regexp_extract(text_or_empty(c), rf"{mark}(.*)$", 1)
    return F.struct(
        strip_ws(sub(text_or_empty(c), rf"{mark}.*$")).alias("answer"),
        strip_ws(sub(strip_ws(hidden), rf"(?s)\n{WS}*\[\[.*$")).alias("triples"),
    )


def triple_lines(c: Column) -> Column:
    """``array<struct<Subject, Predicate, Object>>`` of lines with two bars or more."""
    lines = F.split(text_or_empty(c), "\r\n|[\n\x0B\f\r\x1c\x1d\x1e\x85  ]")

    def clean(line: Column) -> Column:
        t = sub(strip_ws(line), "^`+|`+$")
        for pattern, by in ((f"^{WS}*[-*+]{WS}+", ""), (f"^{WS}*[0-9]+[.)]{WS}+", ""), (r"\*\*(.*?)\*\*", "$1"), (r"\*(.*?)\*", "$1"), ("__(.*?)__", "$1"), ("_(.*?)_", "$1")):
            t = sub(t, pattern, by)
        return t

    cut = F.transform(F.filter(F.transform(lines, clean), lambda t: F.regexp_count(t, F.lit(r"\|")) >= 2), lambda t: F.transform(F.split(t, r"\|"), strip_ws))
    return F.transform(cut, lambda p: F.struct(p[0].alias("Subject"), p[1].alias("Predicate"), p[2].alias("Object")))


def triples_text(c: Column) -> Column:
    """Plausible triple lines of a whole response, as lines of three values: those behind
    the first hidden-triples marker up to a closing mark, or of all of it without one."""
    t = text_or_empty(c)
    behind = F.substring_index(F.substring(t, F.instr(t, "[[RAW_TRIPLES]]") + 15, 1 << 30), "---***---", 1)
    lines = triple_lines(F.when(t.contains("[[RAW_TRIPLES]]"), behind).otherwise(t))
    return F.array_join(F.transform(lines, lambda x: F.concat_ws(" | ", x["Subject"], x["Predicate"], x["Object"])), "\n")


def article_address(pmcid: Column) -> Column:
    """The page of an article in the public archive."""
    return F.concat(F.lit("https://pmc.ncbi.nlm.nih.gov/articles/PMC"), pmcid.cast("string"), F.lit("/"))


def json_triples(c: Column) -> Column:
    """Items of a JSON array, fenced or inside other text; [] for anything else."""
    bare = strip_ws(sub(sub(strip_ws(text_or_empty(c)), f"^```(?:json)?{WS}*"), f"{WS}*```$"))
    widest = F.regexp_extract(bare, r"(?s)(\[\s*\{.*\}\s*\])", 1)
    shape = "array<struct<subject:string,predicate:string,object:string,section:string>>"
    direct = F.when(bare.startswith("["), F.from_json(bare, shape))
    return F.coalesce(direct, F.when(widest != "", F.from_json(widest, shape)), F.array().cast(shape))


def keyword_hits(c: Column, keywords: Sequence[str]) -> Column:
    """How many of the keywords a normalised text holds, each once."""
    out = F.lit(0)
    for k in keywords:
        out = out + c.contains(k).cast("int")
    return out


def occurrences(c: Column, needle: str) -> Column:
    """Occurrences of a literal that don't overlap."""
    return ((F.length(c) - F.length(F.replace(c, F.lit(needle), F.lit("")))) / len(needle)).cast("int")


def mentions(c: Column, needles: Sequence[str]) -> Column:
    out = F.lit(0)
    for n in needles:
        out = out + occurrences(c, n)
    return out


def contains_any(c: Column, needles: Sequence[str]) -> Column:
    out = F.lit(False)
    for n in needles:
        out = out | c.contains(n)
    return out


def best_label(labels: Sequence[str], scores: Column, default: str = "") -> Column:
    """Struct ``label, confidence, score``: the highest of an array of scores, the earlier
    of equals; the share of the positive total to 3 places.  Without a positive score
    the default and zeros."""
    names = F.array(*[F.lit(x) for x in labels])
    items = F.transform(scores, lambda s, i: F.struct(F.round(s.cast("double"), 3).alias("score"), (-i).alias("place"), F.get(names, i).alias("label")))

    def pick(all_: Column) -> Column:
        top = F.array_max(all_)
        total = F.aggregate(all_, F.lit(0.0), lambda a, x: a + F.greatest(x["score"], F.lit(0.0)))
        good = top["score"] > 0
        return F.struct(
            F.when(good, top["label"]).otherwise(default).alias("label"),
            F.when(good, F.bround(top["score"] / F.greatest(total, top["score"]), 3)).otherwise(0.0).alias("confidence"),
            F.when(good, top["score"]).otherwise(0.0).alias("score"),
        )

    return let(items, pick)
