"""Queries over text functions, triples, the compact graph and retrieval."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.functions import constants as C
from quillgraph.functions import text as T
from quillgraph.operators import articles, classify, compact, retrieval, triples
from quillgraph.runtime import cut, over_cores, table

SPO = ["Subject", "Predicate", "Object"]
REJECTED = ["row_id", *SPO, "Section", "PMCID", "Reason"]


def rejected(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "kg_triples_rejected", REJECTED, spread=True)


def references(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "kg_triples_references")


def joined(c: Column, sep: str = "\x1f") -> Column:
    return F.array_join(c, sep)


def text_normalize_label(spark: SparkSession, d: str) -> DataFrame:
    return rejected(spark, d).select("row_id", *[T.normalize_label(F.col(c)).alias(c.lower()) for c in SPO])


def text_split_camel(spark: SparkSession, d: str) -> DataFrame:
    return rejected(spark, d).select("row_id", *[T.split_camel(F.col(c)).alias(c.lower()) for c in SPO])


def text_singularize(spark: SparkSession, d: str) -> DataFrame:
    words = table(spark, d, "documents", ["text"], spread=True).select(F.explode(T.words(F.lower("text"))).alias("word")).distinct()
    return words.select("word", T.singular(F.col("word")).alias("singular"))


def text_tokenize(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents", ["doc_id", "text"], spread=True).select("doc_id", joined(T.kg_tokens(F.col("text")), " ").alias("tokens"))


def text_article_tokens(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "article", ["row_id", "title"]).select("row_id", joined(T.article_tokens(T.split_camel(F.col("title"))), " ").alias("tokens"))


def text_ngrams(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "article", ["row_id", "title"]).select("row_id", joined(T.phrases(F.col("title"))).alias("phrases"))


def text_strip_markdown(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents", ["doc_id", "text"], spread=True).select("doc_id", T.plain_text(F.col("text")).alias("plain"))


def label_camelize(spark: SparkSession, d: str) -> DataFrame:
    return rejected(spark, d).select("row_id", T.entity_label(F.col("Subject")).alias("subject"), T.entity_label(F.col("Object")).alias("object"))


def predicate_normalize(spark: SparkSession, d: str) -> DataFrame:
    return rejected(spark, d).select("row_id", T.predicate_label(F.col("Predicate")).alias("relation"))


def section_normalize(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents", ["doc_id", "section"]).select("doc_id", T.section(F.col("section")).alias("section"))


def section_label_weight(spark: SparkSession, d: str) -> DataFrame:
    label = T.section_label(F.col("section"))
    return table(spark, d, "documents", ["doc_id", "section"]).select("doc_id", label.alias("label"), T.section_weight(label).alias("weight"))


def parse_id_list(spark: SparkSession, d: str) -> DataFrame:
    ids = F.concat_ws("; ", F.col("PMCID"), F.col("PMCID"), F.col("row_id").cast("string"))
    return rejected(spark, d).select("row_id", joined(T.id_list(ids).cast("array<string>"), ",").alias("ids"), F.coalesce(T.pmcid_number(F.col("PMCID")).cast("string"), F.lit("")).alias("pmcid"))


def json_triples_parse(spark: SparkSession, d: str) -> DataFrame:
    """Each rejected row written as a fenced JSON array and read again."""
    item = F.to_json(F.array(F.struct(*[T.text_or_empty(F.col(c)).alias(n) for c, n in zip([*SPO, "Section"], ["subject", "predicate", "object", "section"])])))
    fenced = F.concat(F.lit("```json\n"), item, F.lit("\n```"))
    return rejected(spark, d).select("row_id", F.explode(T.json_triples(fenced)).alias("t")).select("row_id", "t.*")


def triple_lines_parse(spark: SparkSession, d: str) -> DataFrame:
    line = F.concat(F.lit("text\n- **"), *[x for c in SPO for x in (F.regexp_replace(T.squeeze(F.col(c)), r"[|`*_\x{85}\x{2028}\x{2029}]", ""), F.lit("** | "))][:-1])
    return rejected(spark, d).select("row_id", F.explode(T.triple_lines(line)).alias("t")).select("row_id", "t.*")


def answer_sanitize(spark: SparkSession, d: str) -> DataFrame:
    t = F.concat(T.text_or_empty(F.col("text")), F.lit(" (see KG-grounded note)  https://x.example.org/a end"))
    return table(spark, d, "documents", ["doc_id", "text"], spread=True).select("doc_id", T.sanitized(t).alias("clean"))


def answer_sections(spark: SparkSession, d: str) -> DataFrame:
    body = F.regexp_replace(T.text_or_empty(F.col("text")), r"\[\[|\]\]", "")
    t = F.concat(F.lit("[[ Answer ]]\n"), body, F.lit("\n[[KG_SUMMARY]] sum [[raw_triples ]]\na | b | c"))
    s = T.marked_sections(t)
    return table(spark, d, "documents", ["doc_id", "text"], spread=True).select("doc_id", s.answer.alias("answer"), s.kg_summary.alias("kg_summary"), s.raw_triples.alias("raw_triples"), T.finalized(t).alias("shown"))


def triples_normalized(spark: SparkSession, d: str) -> DataFrame:
    return triples.normalized(rejected(spark, d))


def qa_reasons(spark: SparkSession, d: str) -> DataFrame:
    return rejected(spark, d).select("row_id", triples.judged()["reasons"].alias("reasons"))


def qa_priority_dedup(spark: SparkSession, d: str) -> DataFrame:
    return triples.reviewed(rejected(spark, d))


def qa_section_counts(spark: SparkSession, d: str) -> DataFrame:
    r = triples.reviewed(rejected(spark, d))
    return r.groupBy("Section").agg(F.count(F.when(F.col("Reason") == "", 1)).alias("accepted"), F.count(F.when(F.col("Reason") != "", 1)).alias("rejected"))


def qa_reason_histogram(spark: SparkSession, d: str) -> DataFrame:
    return triples.reason_counts(rejected(spark, d))


def triples_append_delta(spark: SparkSession, d: str) -> DataFrame:
    return triples.delta(rejected(spark, d).select("row_id", *SPO), references(spark, d), SPO, "row_id")


def rejected_append_delta(spark: SparkSession, d: str) -> DataFrame:
    keys = [*SPO, "Section", "PMCID"]
    return triples.delta(rejected(spark, d).select("row_id", *keys), references(spark, d), keys, "row_id")


def _graph(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    t = cut(compact.unique_triples(references(spark, d)), "triples")
    n, p = compact.nodes(t), compact.predicates(t)
    return t, n, p, compact.edges(t, n, p)


def kg_nodes(spark: SparkSession, d: str) -> DataFrame:
    return compact.nodes(compact.unique_triples(references(spark, d)))


def kg_predicates(spark: SparkSession, d: str) -> DataFrame:
    return compact.predicates(compact.unique_triples(references(spark, d)))


def kg_edges_encoded(spark: SparkSession, d: str) -> DataFrame:
    return _graph(spark, d)[3]


def kg_resolve_labels(spark: SparkSession, d: str) -> DataFrame:
    _, n, p, e = _graph(spark, d)
    unknown = spark.createDataFrame([("n0", "p0", "n0")], "s string, p string, o string")
    return compact.resolve(e.unionByName(unknown), n, p)


def kg_validate_triples(spark: SparkSession, d: str) -> DataFrame:
    _, n, p, e = _graph(spark, d)
    return compact.validate(rejected(spark, d), e, n, p, "row_id")


def kg_refs_for_triples(spark: SparkSession, d: str) -> DataFrame:
    return compact.references_of(rejected(spark, d), references(spark, d), "row_id").select("row_id", "pmcid", "Section", "ref_id")


def kg_results_first_refs(spark: SparkSession, d: str) -> DataFrame:
    return compact.results_first_of(rejected(spark, d), references(spark, d), "row_id")


def kg_stats(spark: SparkSession, d: str) -> DataFrame:
    return compact.stats(compact.unique_triples(references(spark, d)))


def kg_signature(spark: SparkSession, d: str) -> DataFrame:
    return compact.signature(compact.unique_triples(references(spark, d)))


def _docs(spark: SparkSession, d: str) -> DataFrame:
    """Unique triples as documents; the id is that of the first reference."""
    r = references(spark, d).select("ref_id", *[T.strip_ws(T.text_or_empty(F.col(c))).alias(c) for c in SPO])
    return over_cores(cut(retrieval.documents(r.groupBy(*SPO).agg(F.min("ref_id").alias("ref_id")), "ref_id"), "docs"))


def questions(spark: SparkSession, d: str) -> DataFrame:
    """The stated query set of searches: documents whose id is divisible by 20."""
    return table(spark, d, "documents", ["doc_id", "text"], spread=True).where("doc_id % 20 = 0 and text is not null").select(F.col("doc_id").alias("qid"), "text")


def kg_token_df(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.document_frequency(_docs(spark, d))


def kg_token_idf(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.inverse_frequency(_docs(spark, d)).select("token", F.round("idf", 6).alias("idf"))


def focus_terms(spark: SparkSession, d: str) -> DataFrame:
    strong, _ = retrieval.question_focus(questions(spark, d), retrieval.inverse_frequency(_docs(spark, d)))
    return strong.select("qid", "token", F.round("idf", 6).alias("idf"))


def question_shape(spark: SparkSession, d: str) -> DataFrame:
    _, shape = retrieval.question_focus(questions(spark, d), retrieval.inverse_frequency(_docs(spark, d)))
    return shape.select("qid", joined(F.col("phrases")).alias("phrases"), joined(F.col("intent_terms")).alias("intent_terms"))


def kg_answer_weights(spark: SparkSession, d: str) -> DataFrame:
    """Weights of the tokens of questions that have an answer: section and source stand for it."""
    docs = table(spark, d, "documents", ["doc_id", "text", "section", "source"], spread=True).where("doc_id % 20 = 0 and text is not null")
    q = docs.select(F.col("doc_id").alias("qid"), "text", F.concat(T.text_or_empty(F.col("section")), F.lit(" "), T.text_or_empty(F.col("source"))).alias("answer"))
    strong, shape = retrieval.question_focus(q, retrieval.inverse_frequency(_docs(spark, d)))
    return retrieval.query_weights(q, strong, shape).select("qid", "token", F.round("w", 6).alias("w"))


def kg_focus_filter(spark: SparkSession, d: str) -> DataFrame:
    docs = _docs(spark, d)
    return retrieval.match_counts(docs, questions(spark, d), cut(retrieval.inverse_frequency(docs), "idf"))


def kg_score_topk(spark: SparkSession, d: str) -> DataFrame:
    docs = _docs(spark, d)
    return retrieval.scored(docs, questions(spark, d), cut(retrieval.inverse_frequency(docs), "idf"), 10, focus=False)


def kg_pmcid_rank(spark: SparkSession, d: str) -> DataFrame:
    docs = _docs(spark, d)
    found = retrieval.selected(retrieval.scored(docs, questions(spark, d), cut(retrieval.inverse_frequency(docs), "idf"), 40))
    return retrieval.article_rank(found, docs, references(spark, d))


def kg_retrieve_support(spark: SparkSession, d: str) -> DataFrame:
    docs = _docs(spark, d)
    q = questions(spark, d)
    named = q.select("qid", F.explode(F.array_distinct(T.words(F.lower("text")))).alias("name"))
    return retrieval.support(docs, references(spark, d), q, cut(retrieval.inverse_frequency(docs), "idf"), named)


def search_phrases(spark: SparkSession, d: str) -> DataFrame:
    s = articles.search_phrases(questions(spark, d))
    return s.select("qid", joined(F.col("phrases")).alias("phrases"), joined(F.col("anchors")).alias("anchors"))


def _sought(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame, tuple[DataFrame, DataFrame]]:
    """Questions, triples, idf and focus, for all that ranks by them."""
    q, docs = cut(questions(spark, d).withColumn("tokens", T.kg_tokens(F.col("text"))), "questions"), _docs(spark, d)
    idf = cut(retrieval.inverse_frequency(docs), "idf")
    strong, shape = retrieval.question_focus(q, idf)
    return q, docs, idf, (cut(strong, "strong"), cut(shape, "shape"))


def _ranked(spark: SparkSession, d: str, q: DataFrame, strong: DataFrame, shape: DataFrame, caps: dict[int, int] | None = None) -> DataFrame:
    terms = cut(articles.question_terms(q, strong, shape.select("qid", "intent_terms")), "terms")
    rows = articles.current_articles(table(spark, d, "article", ["pmcid", "row_id", "pmid", "title", "abstract", "journal", "first_author", "authors", "year"]))
    return articles.rank_articles(over_cores(cut(rows, "articles")), terms, caps=caps)


def article_rank_topk(spark: SparkSession, d: str) -> DataFrame:
    """Of the candidates the reference's limits leave; ``article_rank_whole`` is of all."""
    q, _, _, focused = _sought(spark, d)
    return _ranked(spark, d, q, *focused, articles.REFERENCE_CAPS)


def article_rank_whole(spark: SparkSession, d: str) -> DataFrame:
    q, _, _, focused = _sought(spark, d)
    return _ranked(spark, d, q, *focused)


def _both_ranked(spark: SparkSession, d: str, fallback: bool = False) -> list[DataFrame]:
    """Articles by their own text and by the graph: questions, triples and focus are made once for both,
    and each list is written before the next begins.  As ``fallback`` the graph is searched only for
    questions to which the text gives fewer than two articles."""
    q, docs, idf, focused = _sought(spark, d)
    by_text = cut(_ranked(spark, d, q, *focused, articles.REFERENCE_CAPS).select("qid", "pmcid", "rank"), "by-text")
    enough = cut(articles.answered(by_text), "answered") if fallback else None
    found = retrieval.selected(retrieval.scored(docs, q, idf, 40, focused=focused, without=enough))
    return [by_text, retrieval.article_rank(found, docs, references(spark, d)).select("qid", "pmcid", "rank")]


def merge_ranked_ids(spark: SparkSession, d: str) -> DataFrame:
    return articles.merge_ranked(_both_ranked(spark, d))


def merge_ranked_fallback(spark: SparkSession, d: str) -> DataFrame:
    """As the reference merges: the graph's articles only where the others are fewer than two."""
    return articles.merge_ranked(_both_ranked(spark, d, fallback=True))


def reference_payload(spark: SparkSession, d: str) -> DataFrame:
    known = articles.current_articles(table(spark, d, "article", ["pmcid", "row_id", "pmid", "title", "first_author", "authors", "journal", "year"]))
    ranked = rejected(spark, d).select(F.col("row_id").alias("qid"), T.pmcid_number(F.col("PMCID")).alias("pmcid"), F.lit(1).alias("place")).where("pmcid is not null")
    return articles.reference_payload(ranked, known)


def _doc_sections(spark: SparkSession, d: str) -> DataFrame:
    label = T.section_label(F.col("section"))
    one = F.array(F.struct(label.alias("label"), T.text_or_empty(F.col("text")).alias("text"), T.section_weight(label).alias("weight")))
    return table(spark, d, "documents", ["doc_id", "section", "text"], spread=True).select("doc_id", T.text_or_empty(F.col("text")).alias("text"), one.alias("sections"))


def section_weighted_score(spark: SparkSession, d: str) -> DataFrame:
    return _doc_sections(spark, d).select("doc_id", classify.section_score(classify.normal_sections(F.col("sections")), C.TOPIC_TERMS, C.TOPIC_PATIENTS, C.TOPIC_PASSING).alias("score"))


def classify_topic(spark: SparkSession, d: str) -> DataFrame:
    return _doc_sections(spark, d).select("doc_id", classify.topic(F.col("sections"), F.col("text")).alias("t")).select("doc_id", "t.*")


def classify_organism(spark: SparkSession, d: str) -> DataFrame:
    return _doc_sections(spark, d).select("doc_id", classify.organism(F.col("sections"), F.lit("Yes")).alias("t")).select("doc_id", "t.*")


def classify_axis(spark: SparkSession, d: str) -> DataFrame:
    return _doc_sections(spark, d).select("doc_id", classify.axis(F.col("text")).alias("t")).select("doc_id", "t.*")


def classify_type(spark: SparkSession, d: str) -> DataFrame:
    return _doc_sections(spark, d).select("doc_id", classify.article_type(F.col("text")).alias("t")).select("doc_id", "t.*")


def classify_legacy(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "article", ["row_id", "title", "abstract", "type"])
    return a.select("row_id", classify.first_reading(F.col("title"), F.col("abstract"), F.lit(""), F.col("type")).alias("t")).select("row_id", "t.*")


def classify_legacy_body(spark: SparkSession, d: str) -> DataFrame:
    none = F.lit("")
    return table(spark, d, "documents", ["doc_id", "text"], spread=True).select("doc_id", classify.first_reading(none, none, F.col("text"), none).alias("t")).select("doc_id", "t.*")


QUERIES = {
    f.__name__: f
    for f in (
        text_normalize_label, text_split_camel, text_singularize, text_tokenize, text_article_tokens, text_ngrams, text_strip_markdown, label_camelize, predicate_normalize, section_normalize, section_label_weight, parse_id_list,
        json_triples_parse, triple_lines_parse, answer_sanitize, answer_sections, triples_normalized, qa_reasons, qa_priority_dedup, qa_section_counts, qa_reason_histogram, triples_append_delta, rejected_append_delta,
        kg_nodes, kg_predicates, kg_edges_encoded, kg_resolve_labels, kg_validate_triples, kg_refs_for_triples, kg_results_first_refs, kg_stats, kg_signature, kg_token_df, kg_token_idf, focus_terms, question_shape, kg_answer_weights,
        kg_focus_filter, kg_score_topk, kg_pmcid_rank, kg_retrieve_support, search_phrases, article_rank_topk, article_rank_whole, merge_ranked_ids, merge_ranked_fallback, reference_payload, section_weighted_score, classify_topic, classify_organism, classify_axis,
        classify_type, classify_legacy, classify_legacy_body,
    )
}
