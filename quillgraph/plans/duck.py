"""Pieces of DuckDB SQL for the oracle texts."""

from __future__ import annotations

from quillgraph.functions import constants as C
from quillgraph.functions.text import WS

TRIM = rf"^{WS}+|{WS}+$"


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def lst(xs) -> str:
    return "[" + ", ".join(q(x) for x in xs) + "]"


def rep(c: str, pattern: str, by: str = "") -> str:
    return f"regexp_replace({c}, {q(pattern)}, {q(by)}, 'g')"


def strip(c: str) -> str:
    return rep(c, TRIM)


def squeeze(c: str) -> str:
    return rep(strip(f"coalesce({c}, '')"), f"{WS}+", " ")


def norm(c: str) -> str:
    return f"lower({squeeze(c)})"


def camel(c: str) -> str:
    return f"lower({rep(rep(rep(f"coalesce({c}, '')", '([a-z0-9])([A-Z])', r'\1 \2'), r'[_/\\\-]+', ' '), '[^A-Za-z0-9]+', ' ')})"


def singular(t: str) -> str:
    return (
        f"CASE WHEN length({t}) > 5 AND {t} LIKE '%ies' THEN left({t}, length({t}) - 3) || 'y' "
        f"WHEN length({t}) > 5 AND regexp_matches({t}, '(ches|shes|xes|zes|ses)$') THEN left({t}, length({t}) - 2) "
        f"WHEN length({t}) > 4 AND {t} LIKE '%s' AND {t} NOT LIKE '%ss' THEN left({t}, length({t}) - 1) ELSE {t} END"
    )


def kg_tokens(c: str) -> str:
    got = f"regexp_extract_all({camel(c)}, '[a-z0-9]+')"
    return f"list_filter(list_transform({got}, lambda t: {singular('t')}), lambda t: length(t) >= 3 AND NOT list_contains({lst(C.STOPWORDS)}, t))"


def ngrams(tokens: str, n: int) -> str:
    return f"list_transform(range(0, greatest(len({tokens}) - {n - 1}, 0)), lambda i: array_to_string({tokens}[i + 1 : i + {n}], ' '))"


def case(c: str, table: dict, default: str = "NULL") -> str:
    return f"CASE {c} " + " ".join(f"WHEN {q(str(k))} THEN {q(v) if isinstance(v, str) else v}" for k, v in table.items()) + f" ELSE {default} END"


def section(c: str) -> str:
    return case(norm(c), C.SECTIONS, "''")


def unwrap(c: str) -> str:
    return squeeze(rep(squeeze(c), r"""^[ |\t\n\r'"`*\[\]{}()]+|[ |\t\n\r'"`*\[\]{}()]+$"""))


def camel_label(value: str) -> str:
    """``value`` is an expression that is already unwrapped."""
    part = rep("p", r"^[\-/,;:.()\[\]{}]+|[\-/,;:.()\[\]{}]+$")
    made = f"list_transform(list_transform(regexp_split_to_array({value}, {q(f'(?:{WS}|_)+')}), lambda p: {part}), lambda p: CASE WHEN (p = upper(p) AND p <> lower(p)) OR regexp_matches(p, '[0-9]') THEN p ELSE upper(left(p, 1)) || substring(p, 2) END)"
    return f"CASE WHEN contains({value}, ' ') OR contains({value}, '_') THEN array_to_string({made}, '') ELSE {value} END"


def entity_label(c: str) -> str:
    value = rep(unwrap(c), rf"^(?i:a|an|the){WS}+")
    return camel_label(unwrap(strip(rep(value, r"https?://[^\s]+"))))


def predicate_label(c: str) -> str:
    raw = squeeze(rep(unwrap(c), rf"^(?i:is|are|was|were){WS}+"))
    low = f"lower({raw})"
    tool, use = C.TREATMENT_WORDS
    stems = f"WHEN regexp_matches({low}, {q(tool)}) AND regexp_matches({low}, {q(use)}) THEN 'hasTreatment' " + " ".join(f"WHEN regexp_matches({low}, {q(p)}) THEN {q(r)}" for p, r in C.PREDICATE_STEMS)
    return f"coalesce({case(low, C.PREDICATES)}, CASE {stems} ELSE {camel_label(unwrap(raw))} END)"


def word_count(c: str) -> str:
    return f"len(regexp_extract_all({c}, '[A-Za-z0-9]+'))"


def sentence(c: str) -> str:
    v = squeeze(c)
    return f"({v} <> '' AND (contains({v}, '. ') OR contains({v}, ';') OR contains({v}, ':') OR {word_count(v)} > {C.MAX_ENTITY_WORDS} OR regexp_matches(lower({v}), '^(this study|the study|we |our |these results|the results|the authors|it |they |there )')))"


def pmcid(c: str) -> str:
    bare = rep(strip(f"coalesce(({c})::VARCHAR, '')"), "^(?i:pmc)")
    return f"CASE WHEN regexp_matches({bare}, '^[0-9]+$') THEN TRY_CAST({bare} AS BIGINT) END"


def count_of(c: str, needle: str) -> str:
    return f"((length({c}) - length(replace({c}, {q(needle)}, ''))) // {len(needle)})"


def mentions(c: str, needles) -> str:
    return "(" + " + ".join(count_of(c, n) for n in needles) + ")"


def hits(c: str, needles) -> str:
    return "(" + " + ".join(f"contains({c}, {q(n)})::INT" for n in needles) + ")"


def any_of(c: str, needles) -> str:
    return "(" + " OR ".join(f"contains({c}, {q(n)})" for n in needles) + ")"


def best(scores: list[tuple[str, str]], default: str = "") -> tuple[str, str]:
    """(label, confidence) expressions; scores are plain column names or short texts."""
    top = f"greatest({', '.join(s for _, s in scores)})"
    total = " + ".join(f"greatest({s}, 0)" for _, s in scores)
    label = f"CASE WHEN {top} <= 0 THEN {q(default)} " + " ".join(f"WHEN {s} = {top} THEN {q(k)}" for k, s in scores) + " END"
    return label, f"CASE WHEN {top} <= 0 THEN 0.0::DOUBLE ELSE round_even(({top})::DOUBLE / greatest({total}, {top}), 3) END"
