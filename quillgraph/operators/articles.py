"""Ranking articles for questions and describing them as references."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.functions import constants as C
from quillgraph.functions import text as T
from quillgraph.operators.retrieval import term_hits
from quillgraph.runtime import cut, over_cores


def _ascii_words(c: Column) -> Column:
    return F.filter(F.regexp_extract_all(F.lower(T.text_or_empty(c)), F.lit("([a-z0-9]+)")), lambda t: F.length(t) >= 3)


def search_phrases(questions: DataFrame) -> DataFrame:
    """``qid, phrases, anchors``: at most 20 phrases and 10 anchors of a question.

    First 4-, 3- and 2-grams of the words left without generic ones, as written and
    singular; then 3- and 2-grams of all words that hold a word not generic.
    """
    generic = F.array(*[F.lit(w) for w in C.PHRASE_GENERIC])
    plain = lambda arr: F.filter(arr, lambda t: ~F.array_contains(generic, t))
    q = questions.select("qid", _ascii_words(F.col("text")).alias("raw"))
    q = q.withColumn("canon", F.transform("raw", T.singular))
    q = q.withColumn("content", plain(F.col("raw"))).withColumn("content_canon", plain(F.transform("content", T.singular)))
    told = [T.ngrams(F.col(c), n) for c in ("content", "content_canon") for n in (4, 3, 2)]
    mixed = [F.filter(T.ngrams(F.col(c), n), lambda p: F.size(F.array_except(F.split(p, " "), generic)) > 0) for c in ("raw", "canon") for n in (3, 2)]
    phrases = F.filter(F.array_distinct(F.concat(*told, *mixed)), lambda p: F.length(p) >= 5)
    return q.select("qid", F.slice(phrases, 1, 20).alias("phrases"), F.slice("content_canon", 1, 10).alias("anchors"))


def question_terms(questions: DataFrame, strong: DataFrame, intents: DataFrame) -> DataFrame:
    """``qid, phrases (6), anchors (4), intent_terms (4)`` as used for articles.

    Phrases: those of ``search_phrases`` and all neighbouring words of which one isn't
    generic, most words first, then longest, then by code point.
    """
    generic = F.array(*[F.lit(w) for w in C.ANCHOR_GENERIC])
    base = search_phrases(questions).join(questions.select("qid", _ascii_words(F.col("text")).alias("raw")), "qid")
    pairs = F.filter(
        F.concat(T.ngrams(F.col("raw"), 2), T.ngrams(F.transform("raw", T.singular), 2)),
        lambda p: F.size(F.array_except(F.split(p, " "), generic)) > 0,
    )
    every = F.array_distinct(F.concat("phrases", pairs))
    ordered = F.transform(
        F.array_sort(F.transform(every, lambda p: F.struct((-F.size(F.split(p, " "))).alias("a"), (-F.length(p)).alias("b"), p.alias("p")))), lambda x: x["p"]
    )
    strong_list = strong.groupBy("qid").agg(F.transform(F.sort_array(F.collect_list(F.struct("idf", "token")), False), lambda x: x["token"]).alias("strong"))
    both = base.join(strong_list, "qid", "left").join(intents, "qid", "left")
    anchors = F.filter(
        F.array_distinct(F.transform(F.concat("anchors", F.coalesce("strong", F.array().cast("array<string>"))), T.singular)), lambda t: (t != "") & ~F.array_contains(generic, t)
    )
    return both.select(
        "qid",
        F.slice(ordered, 1, 6).alias("phrases"),
        F.slice(anchors, 1, 4).alias("anchors"),
        F.slice(F.filter(F.coalesce("intent_terms", F.array().cast("array<string>")), lambda t: F.length(t) >= 3), 1, 4).alias("intents"),
    )


def current_articles(articles: DataFrame) -> DataFrame:
    """One row per article: the one that arrived last."""
    cols = [c for c in articles.columns if c != "pmcid"]
    last = articles.where("pmcid is not null").groupBy("pmcid").agg(F.max_by(F.struct(*cols), "row_id").alias("r"))
    return last.select("pmcid", *[F.col(f"r.{c}").alias(c) for c in cols])


#: The reference's candidates of each stage, of the first for each phrase.
REFERENCE_CAPS = {1: 40, 2: 60, 3: 80, 4: 80, 5: 60, 6: 40}


def rank_articles(articles: DataFrame, terms: DataFrame, most: int = 10, caps: dict[int, int] | None = None) -> DataFrame:
    """``qid, pmcid, score, rank``: the best articles of each question.

    Candidates come in stages: titles with a phrase; if fewer than two, titles with both
    first anchors; then abstracts with one of three phrases or both anchors; if none,
    titles with any anchor, then with any intent term.  Every candidate of a stage is
    scored; ``caps`` (as REFERENCE_CAPS) takes only so many, by pmcid.  The broad last
    two are looked for only for the questions that have nothing yet.

    What holds a term is found once for all questions that ask for it.  Questions meet
    these articles only in the stages they come to; without caps each meeting is scored
    where it happens, so that of all candidates only the best are ever shuffled.
    """
    a = articles.where("pmcid is not null").select("pmcid", F.lower(T.text_or_empty(F.col("title"))).alias("low_title"), F.lower(T.text_or_empty(F.col("abstract"))).alias("low_abstract"))
    titles, abstracts = (a.select(F.col("pmcid").alias("id"), F.col(c).alias("text")) for c in ("low_title", "low_abstract"))
    ask = cut(_asked(terms.where("size(anchors) >= 2"), [(2, None), (4, None)]).unionByName(_asked(terms, [(1, F.col("phrases")), (3, F.slice("phrases", 1, 3))])), "asked")
    told = lambda texts, of: term_hits(texts, of.select("term", "also"))
    in_title = cut(told(titles, ask.where("k <= 2")).withColumn("abstract", F.lit(False)), "title-hits")
    hits = in_title.unionByName(cut(told(abstracts, ask.where("k > 2")).withColumn("abstract", F.lit(True)), "abstract-hits"))
    few = cut(_first_of(hits, 2), "few")
    so_far = _meet(ask, few).groupBy("qid").agg(*[F.count_distinct(F.when(F.col("k") < k, F.col("id"))).alias(f"n{k}") for k in (2, 3, 4, 5)])
    fewer = lambda k, n: F.coalesce(F.col(f"n{k}"), F.lit(0)) < n
    guards = cut(terms.join(so_far, "qid", "left").select("*", *[fewer(k, 2).alias(f"g{k}") for k in (2, 3, 4)], fewer(5, 1).alias("none")).drop("n2", "n3", "n4", "n5"), "guards")
    late = _asked(guards.where("none"), [(5, F.col("anchors")), (6, F.col("intents"))])
    late = cut(late, "late-asked")
    late_hits = cut(told(titles, late).withColumn("abstract", F.lit(False)), "late-hits")
    anchored = _meet(late.where("k = 5"), _first_of(late_hits, 1)).select("qid").distinct()
    guards = cut(guards.join(anchored.withColumn("anchored", F.lit(True)), "qid", "left").withColumn("g6", F.col("none") & F.col("anchored").isNull()).drop("anchored"), "guards")
    opened = F.when(F.col("k") == 1, True).when(F.col("k") == 5, F.col("none"))
    for k in (2, 3, 4, 6):
        opened = opened.when(F.col("k") == k, F.col(f"g{k}"))
    ask = cut(ask.unionByName(late).join(guards, "qid").where(opened).select("qid", "k", "term", "also"), "open")
    hits = hits.unionByName(late_hits).distinct()  # a word may be looked for early and late
    if caps:
        first = _first_of(hits, max(caps.values()))
        met = _meet(ask, first).where(F.element_at(F.create_map(*[F.lit(x) for kv in caps.items() for x in kv]), F.col("k")) >= F.col("n"))
        flags = met.groupBy("qid", F.col("id").alias("pmcid")).agg(*[F.max(F.col("k") == k).alias(f"i{k}") for k in range(1, 7)])
        for k in range(2, 7):  # phrases are limited one by one
            place = F.row_number().over(Window.partitionBy("qid", f"i{k}").orderBy("pmcid"))
            flags = flags.withColumn(f"i{k}", F.col(f"i{k}") & (place <= caps[k])) if k in caps else flags
        any_stage = F.greatest(*[F.col(f"i{k}") for k in range(1, 7)])
        candidates = cut(flags.where(any_stage), "candidates").join(terms, "qid")
        return _best(_scored(over_cores(candidates).join(_described(articles, candidates.select("pmcid").distinct()), "pmcid")), most)
    shown = _described(articles, hits.select(F.col("id").alias("pmcid")).distinct()).join(a, "pmcid")
    rows = _meet(ask.join(guards, "qid"), hits.join(shown, F.col("id") == F.col("pmcid")))
    return _best(_scored(_once(rows)), most)


def _asked(terms: DataFrame, stages: list[tuple[int, Column | None]]) -> DataFrame:
    """``qid, k, term, also``: what is looked for in each stage ``k``; without a list, both first anchors."""
    none = F.lit(None).cast("string")
    both = F.array(F.struct(F.get("anchors", F.lit(0)).alias("term"), F.get("anchors", F.lit(1)).alias("also")))
    out = None
    for k, listed in stages:
        each = both if listed is None else F.transform(F.array_distinct(F.filter(listed, lambda p: F.length(p) >= (5 if k <= 4 else 3))), lambda p: F.struct(p.alias("term"), none.alias("also")))
        one = terms.select("qid", F.lit(k).alias("k"), F.explode(each).alias("t")).select("qid", "k", "t.term", "t.also")
        out = one if out is None else out.unionByName(one)
    return out


def _first_of(hits: DataFrame, most: int) -> DataFrame:
    """The first articles of each term, and the place of each."""
    w = Window.partitionBy("term", "also", "abstract").orderBy("id")
    return hits.withColumn("n", F.row_number().over(w)).where(F.col("n") <= most)


def _meet(ask: DataFrame, hits: DataFrame) -> DataFrame:
    """Questions with the articles that hold what they ask for."""
    h = hits.withColumnsRenamed({"term": "h_term", "also": "h_also"})
    stands = F.col("abstract") == F.col("k").isin(3, 4)
    return ask.join(h, (F.col("term") == F.col("h_term")) & (F.coalesce("also", F.lit("")) == F.coalesce("h_also", F.lit(""))) & stands).drop("h_term", "h_also", "abstract")


def _once(met: DataFrame) -> DataFrame:
    """Each question and article once, of those that meet by several terms, with the stages it is in."""
    title, abstract = F.col("low_title"), F.col("low_abstract")
    first = lambda listed, text, least: F.get(F.filter(listed, lambda p: (F.length(p) >= least) & text.contains(p)), F.lit(0))
    both = lambda text: F.coalesce(text.contains(F.get("anchors", F.lit(0))) & text.contains(F.get("anchors", F.lit(1))), F.lit(False))
    by = lambda k, listed, text, least=5: F.when(F.col("k") <= k, first(listed, text, least))
    m = met.select("*", by(4, "phrases", title).alias("f1"), (F.col("g2") & both(title)).alias("i2"), F.when(F.col("g3"), first(F.slice("phrases", 1, 3), abstract, 5)).alias("f3"), (F.col("g4") & both(abstract)).alias("i4"))
    m = m.select("*", by(6, "anchors", title, 3).alias("f5"), by(6, "intents", title, 3).alias("f6"), F.col("f1").isNotNull().alias("i1"), F.col("f3").isNotNull().alias("i3"))
    same = lambda c: F.col("term") == F.col(c)
    new = (
        F.when(F.col("k") == 1, same("f1")).when(F.col("k") == 2, ~F.col("i1")).when(F.col("k") == 3, ~(F.col("i1") | F.col("i2")) & same("f3"))
        .when(F.col("k") == 4, ~(F.col("i1") | F.col("i2") | F.col("i3"))).when(F.col("k") == 5, same("f5")).otherwise(same("f6"))
    )
    return _where(m, new, "i1", "i2", "i3", "i4")


def _where(df: DataFrame, condition: Column, *columns: str) -> DataFrame:
    """``df`` where the condition holds.  A filter is moved down to where the rows are read, and
    its expressions are then computed twice; this stays where it is."""
    others = [c for c in df.columns if c not in columns]
    return df.select(*others, F.explode(F.when(condition, F.array(F.struct(*columns)))).alias("x")).select(*others, "x.*")


def _described(articles: DataFrame, wanted: DataFrame) -> DataFrame:
    """What is compared of the articles ``wanted``: the same for every question that meets one."""
    parts = [F.nullif(T.text_or_empty(F.col(c)), F.lit("")) for c in ("title", "journal")]
    said = lambda c: T.text_or_empty(F.col(c)) != ""
    flag = lambda c, v: F.when(c, v).otherwise(0.0)
    filled = flag(said("title"), 2.0) + flag(said("first_author") | said("authors"), 1.0) + flag(F.col("year").isNotNull() & (F.col("year") != 0), 1.0)
    met = over_cores(articles).join(wanted, "pmcid", "left_semi").select("pmcid", filled.alias("filled"), T.split_camel(F.col("title")).alias("tx"), T.split_camel(F.concat_ws(" ", *parts)).alias("ax"))
    tokens = lambda c: F.array_distinct(T.article_tokens(F.col(c)))
    return cut(met.withColumn("tt", tokens("tx")).withColumn("at", tokens("ax")), "met")


def _scored(met: DataFrame) -> DataFrame:
    """Score of candidates, from their terms and what ``_described`` gives."""
    count = lambda listed, hit: F.size(F.filter(listed, hit))
    s = met.select(
        "*",
        count("phrases", lambda p: F.col("tx").contains(p)).alias("pt"),
        count("phrases", lambda p: F.col("ax").contains(p)).alias("pa"),
        count("anchors", lambda p: F.array_contains("tt", p)).alias("nt"),
        count("anchors", lambda p: F.array_contains("at", p)).alias("na"),
    )
    from_intents = F.aggregate("intents", F.lit(0.0), lambda x, i: x + F.when(F.array_contains(F.col("tt"), i), 4.0).when(F.array_contains(F.col("at"), i), 1.0).otherwise(0.0))
    flag = lambda c, v: F.when(c, v).otherwise(0.0)
    score = (
        F.col("pt") * 800.0 + F.greatest(F.lit(0), F.col("pa") - F.col("pt")) * 200.0 + F.col("nt") * 120.0 + F.col("na") * 35.0 + flag(F.col("na") >= 2, 250.0)
        + flag(F.col("i1"), 500.0) + flag(F.col("i2"), 200.0) + flag(F.col("i3") | F.col("i4"), 40.0)
        + flag((F.col("pa") > 0) | (F.col("na") > 0), from_intents + flag(F.array_contains("at", F.lit("dravet")), 2.0)) + F.col("filled")
    )
    counts = (F.size("anchors") == 0) | (F.col("pa") > 0) | (F.col("na") > 0)
    return _where(s.select("qid", "pmcid", F.when(counts, score).alias("score")), F.col("score") > 0, "score")


def _best(scored: DataFrame, most: int) -> DataFrame:
    w = Window.partitionBy("qid").orderBy(F.col("score").desc(), "pmcid")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most).select("qid", "pmcid", "score", "rank")


def answered(ranked: DataFrame, fewest: int = 2) -> DataFrame:
    """``qid`` of the questions to which a ranked list (``qid, pmcid``) gives ``fewest`` different articles or more."""
    return ranked.groupBy("qid").agg(F.count_distinct("pmcid").alias("n")).where(F.col("n") >= fewest).select("qid")


def merge_ranked(lists: list[DataFrame], most: int = 15, fallback: DataFrame | None = None, fewest: int = 2) -> DataFrame:
    """``qid, pmcid, place``: ranked lists (``qid, pmcid, rank``) one behind the other, each
    article at its first place, the first ``most``.

    The list ``fallback`` comes last, and only for questions to which the others give
    fewer than ``fewest`` articles.
    """
    if fallback is not None:
        lists = [cut(df.select("qid", "pmcid", F.col("rank").cast("int").alias("rank")), "ranked") for df in lists]
        enough = merge_ranked(lists, fewest).groupBy("qid").agg(F.count("*").alias("n")).where(F.col("n") >= fewest)
        lists = [*lists, fallback.join(enough.select("qid"), "qid", "left_anti")]
    all_ = None
    for i, df in enumerate(lists):
        one = df.select("qid", "pmcid", F.struct(F.lit(i).alias("source"), F.col("rank").cast("int").alias("rank")).alias("at"))
        all_ = one if all_ is None else all_.unionByName(one)
    once = all_.where("pmcid is not null").groupBy("qid", "pmcid").agg(F.min("at").alias("at"))
    w = Window.partitionBy("qid").orderBy("at", "pmcid")
    return once.withColumn("place", F.row_number().over(w)).where(F.col("place") <= most).select("qid", "pmcid", "place")


def reference_payload(ranked: DataFrame, articles: DataFrame) -> DataFrame:
    """What is shown of each ranked article (``qid, pmcid, place``), also of unknown ones.

    If three or more of a question's articles have a title of their own, only those.
    """
    known = articles.select("pmcid", "pmid", "title", "first_author", "authors", "journal", "year", F.lit(True).alias("known"))
    j = ranked.join(known, "pmcid", "left")
    k = F.coalesce("known", F.lit(False))
    say = lambda c: F.coalesce(F.when(k, F.nullif(T.text_or_empty(F.col(c)), F.lit("0"))), F.lit(""))
    stand_in = F.concat(F.lit("PubMed Central article PMC"), F.col("pmcid"))
    url = F.concat(F.lit("https://pmc.ncbi.nlm.nih.gov/articles/PMC"), F.col("pmcid"), F.lit("/"))
    out = j.select(
        "qid",
        "place",
        "pmcid",
        say("pmid").alias("pmid"),
        F.coalesce(F.nullif(T.text_or_empty(F.col("title")), F.lit("")), stand_in).alias("title"),
        url.alias("url"),
        F.when(k, T.first_author(F.col("first_author"), F.col("authors"))).otherwise("").alias("first_author"),
        (k & T.several_authors(F.col("authors"))).alias("has_multiple_authors"),
        say("journal").alias("journal"),
        say("year").alias("year"),
    )
    own = ~F.col("title").startswith("PubMed Central article PMC")
    return out.withColumn("whole", F.sum(own.cast("int")).over(Window.partitionBy("qid"))).where((F.col("whole") < 3) | own).drop("whole")
