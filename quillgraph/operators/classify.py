"""Rule classification of articles: topic, organism, axis and type.

Rules are Column expressions over the columns ``title, abstract, body`` or over
sections ``(label, text, weight)``; keyword tables are ordinary parameters.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgraph.functions import constants as C
from quillgraph.functions import text as T


def is_preprint(title: Column, journal: Column, kinds: Column, doi: Column) -> Column:
    """A preprint by its source's name or its DOI."""
    d = F.lower(T.strip_ws(T.text_or_empty(doi)))
    hay = F.lower(F.concat_ws(" ", T.text_or_empty(title), T.text_or_empty(journal), T.text_or_empty(kinds), d))
    named = hay.contains("preprint") & (hay.contains("rxiv") | hay.contains("archive"))
    prefixed = F.lit(False)
    for p in C.PREPRINT_DOIS:
        prefixed = prefixed | d.startswith(p)
    return T.contains_any(hay, C.PREPRINT_SOURCES) | named | prefixed


def normal_sections(sections: Column) -> Column:
    """Sections with their texts squeezed and in lower case."""
    return F.transform(sections, lambda s: F.struct(s["label"].alias("label"), T.normalize_label(s["text"]).alias("text"), s["weight"].alias("weight")))


def section_score(normal: Column, terms: Sequence[str], bonus: Sequence[str] = (), passing: Sequence[str] = ()) -> Column:
    """Weighted score of terms over normal sections, to 3 places."""

    def one(s: Column, hits: Column) -> Column:
        score = F.when(hits > 0, F.least(hits, F.lit(4)) * s["weight"]).otherwise(0.0)
        if bonus:
            score = score + F.when(T.contains_any(s["text"], bonus), s["weight"] * 1.75).otherwise(0.0)
        if passing:
            score = score - F.when(T.contains_any(s["text"], passing), s["weight"] * 1.1).otherwise(0.0)
        return score + F.when(s["label"].isin(*C.EVIDENCE_SECTIONS) & (hits > 0), s["weight"] * 0.6).otherwise(0.0)

    return F.round(F.aggregate(normal, F.lit(0.0), lambda acc, s: acc + T.let(T.mentions(s["text"], terms), lambda hits: one(s, hits))), 3)


def topic_mentions(normal: Column) -> Column:
    """Mentions of the topic in a normal text; its short form counts only beside a full one."""
    return T.let(
        F.concat(F.lit(" "), normal, F.lit(" ")),
        lambda t: T.let(T.mentions(t, C.TOPIC_TERMS), lambda full: full + F.when(full > 0, T.mentions(t, C.TOPIC_SHORT)).otherwise(0)),
    )


def topic(sections: Column, combined: Column) -> Column:
    """Struct ``ds, confidence, score``: is the article about the topic?"""
    flag = lambda c, v: F.when(c, v).otherwise(0.0)

    def first(normal: Column, label: str) -> Column:
        return F.coalesce(F.get(F.filter(normal, lambda s: s["label"] == label), F.lit(0))["text"], F.lit(""))

    def verdict(score: Column, named: Column) -> Column:
        yes = (score >= 5.0) | ((score >= 3.5) & named)
        sure = F.when(score >= 8.0, 0.95).when(score >= 5.0, 0.82).when(yes, 0.72).when(score <= 1.5, 0.80).otherwise(0.62)
        return F.struct(F.when(yes, "Yes").otherwise("No").alias("ds"), sure.alias("confidence"), score.alias("score"))

    def judge(normal: Column) -> Column:
        named = T.contains_any(first(normal, "title"), C.TOPIC_TERMS)
        evidence = F.array_join(F.transform(F.filter(normal, lambda s: s["label"].isin(*C.EVIDENCE_SECTIONS)), lambda s: s["text"]), " ")
        by_abstract = T.let(topic_mentions(first(normal, "abstract")), lambda n: F.when(n >= 2, 2.5).when(n == 1, 1.0).otherwise(0.0))
        by_evidence = T.let(evidence, lambda e: flag(topic_mentions(e) >= 1, 3.0) + flag(T.contains_any(e, C.TOPIC_PATIENTS), 2.5))
        by_all = T.let(topic_mentions(T.normalize_label(combined)), lambda n: F.when(n >= 5, 1.2).when(n == 0, -1.0).otherwise(0.0))
        score = F.round(section_score(normal, C.TOPIC_TERMS, C.TOPIC_PATIENTS, C.TOPIC_PASSING) + flag(named, 4.0) + by_abstract + by_evidence + by_all, 3)
        return T.let(score, lambda s: verdict(s, named))

    return T.let(normal_sections(sections), judge)


def organism(sections: Column, ds: Column) -> Column:
    """Struct ``label, confidence, score``; '' below a score of 4."""

    def scores(normal: Column) -> Column:
        each = [F.greatest(section_score(normal, words, C.ORGANISM_CONTEXT[name], C.ORGANISM_PASSING), F.lit(0.0)) for name, words in C.ORGANISMS.items()]
        human = list(C.ORGANISMS).index("Human")
        return F.transform(F.array(*each), lambda s, i: F.when((i == human) & (ds != "Yes"), F.greatest(F.lit(0.0), s - 2.0)).otherwise(s))

    def judge(b: Column) -> Column:
        return F.struct(
            F.when(b["score"] >= 4.0, b["label"]).otherwise("").alias("label"),
            F.when(b["score"] >= 7.0, F.greatest(b["confidence"], F.lit(0.90))).when(b["score"] >= 4.0, F.greatest(b["confidence"], F.lit(0.78))).otherwise(0.0).alias("confidence"),
            b["score"].alias("score"),
        )

    return T.let(normal_sections(sections), lambda n: T.let(T.best_label(list(C.ORGANISMS), scores(n)), judge))


def _by_keywords(text: Column, rules: dict, default: str) -> Column:
    best = T.let(text, lambda t: T.best_label(list(rules), F.array(*[T.keyword_hits(t, w) for w in rules.values()]), default))
    return F.struct(best["label"].alias("label"), best["confidence"].alias("confidence"))


def axis(combined: Column) -> Column:
    """Struct ``label, confidence`` by keywords present."""
    return _by_keywords(T.normalize_label(combined), C.AXES, "")


def article_type(combined: Column) -> Column:
    """Struct ``label, confidence`` by keywords present; of equals the first rule."""
    return _by_keywords(T.normalize_label(combined), C.TYPES, "Original")


#: Letters of a body that the reference reads: for the topic, organisms and axis of the
#: first reading, and for topic and axis together and the type of the second.
REFERENCE_CHARS = {"ds": 5000, "organism": 6000, "axis": 8000, "combined": 12000, "type": 5000}


def _upto(body: Column, chars: dict[str, int] | None, part: str) -> Column:
    return F.left(body, F.lit(chars[part])) if chars and part in chars else body


def first_reading(title: Column, abstract: Column, body: Column, kinds: Column, chars: dict[str, int] | None = None) -> Column:
    """Struct ``type, ds, organism, axis`` by first keyword found, in the whole body or in
    its first ``chars`` (as REFERENCE_CHARS)."""
    e = T.text_or_empty
    join = lambda *cs: F.lower(F.concat_ws(" ", *cs))
    named = join(e(kinds), e(title), e(abstract))
    kind = F.when(named.contains("research-article") | named.contains("original"), "Original")
    for label, words in C.FIRST_TYPES:
        kind = kind.when(T.contains_any(named, words), label)
    upto = lambda part: join(e(title), e(abstract), _upto(e(body), chars, part))
    ds = F.when(T.contains_any(upto("ds"), C.TOPIC_TERMS), "Yes").otherwise("No")
    found = F.filter(F.array(*[F.when(T.contains_any(upto("organism"), w), F.lit(k)) for k, w in C.ORGANISMS.items()]), lambda x: x.isNotNull())
    names = F.when(F.size(found) > 0, F.left(F.array_join(found, ", "), F.lit(200))).when(ds == "Yes", "Human").otherwise("Unknown")
    ax = _by_keywords(upto("axis"), C.AXES, "Comorbidities")["label"]
    return F.struct(kind.otherwise("Original").alias("type"), ds.alias("ds"), names.alias("organism"), F.when(ds == "Yes", ax).otherwise("Other").alias("axis"))


def classify(df: DataFrame, sections: str = "sections", title: str = "title", abstract: str = "abstract", body: str = "body", chars: dict[str, int] | None = None, kinds: str | None = None) -> DataFrame:
    """``df`` with ``type, ds, organism, axis`` as read (``_read``) and to be stored
    (``_stored``: as read, or where that is empty by ``first_reading``, which also uses
    the column ``kinds``), and what supports them.

    Off topic, an organism needs a confidence of 0.90 and an axis of 0.85.  Bodies are
    read whole, or their first ``chars`` (as REFERENCE_CHARS).
    """
    t, a, b = (T.text_or_empty(F.col(c)) for c in (title, abstract, body))
    combined = F.concat_ws("\n", t, a, _upto(b, chars, "combined"))
    s = F.col(sections)
    out = df.withColumn("_topic", topic(s, combined))
    out = out.withColumn("_org", organism(s, F.col("_topic.ds"))).withColumn("_axis", axis(combined)).withColumn("_type", article_type(F.concat_ws("\n", t, a, _upto(b, chars, "type"))))
    out = out.withColumn("_first", first_reading(t, a, b, F.lit("") if kinds is None else F.col(kinds), chars))
    on = F.col("_topic.ds") == "Yes"
    read = {
        "type": F.col("_type.label"),
        "ds": F.col("_topic.ds"),
        "organism": F.when(on | (F.col("_org.confidence") >= 0.90), F.col("_org.label")).otherwise(""),
        "axis": F.when(on | (F.col("_axis.confidence") >= 0.85), F.col("_axis.label")).otherwise(""),
    }
    return out.select(
        *df.columns,
        *[c.alias(f"{k}_read") for k, c in read.items()],
        *[F.coalesce(F.nullif(c, F.lit("")), F.col(f"_first.{k}")).alias(f"{k}_stored") for k, c in read.items()],
        F.col("_topic.score").alias("topic_score"),
        F.col("_org.score").alias("organism_score"),
    )
