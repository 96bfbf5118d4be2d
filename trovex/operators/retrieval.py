"""Lexical and dense scoring of queries against documents, and ranking metrics; scores are long-form rows."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trovex.functions.text import bm25_tokens, strip_accents, word_tokens
from trovex.operators import dense_cells


def _terms(df: DataFrame, key: str, tokens: Column) -> DataFrame:
    return df.select(F.col(key).alias("id"), F.explode(tokens).alias("term")).groupBy("id", "term").agg(F.count("*").alias("tf"))


@dataclass
class Vectors:
    """Queries and documents as (id, terms, v), of which only terms of the queries are kept, with the row counts they came from. A
    pair's score is the dot product; one that shares no term has none."""

    queries: DataFrame
    docs: DataFrame
    rows: tuple[int, int]

    def scores(self, places: int = 4) -> DataFrame:
        """(query_id, doc_id, score), rounded; made from matrices, so common terms are never joined."""
        return dense_cells.scores(self.queries, self.docs, places, rows=self.rows)

    def top(self, k: int, places: int = 4) -> DataFrame:
        """``ranked`` down to rank ``k``; only the best pairs of each cell become rows."""
        return ranked(dense_cells.top(self.queries, self.docs, k, places, rows=self.rows), k, places)

    def metrics(self, qrels: DataFrame, ks: tuple[int, ...] = (5, 10, 20), places: int = 4) -> DataFrame:
        """``metrics`` without a row for each pair: relevance travels with the documents."""
        rels = qrels.groupBy(F.col("doc_id").alias("id")).agg(F.collect_set("query_id").alias("rels"))
        ranks = dense_cells.ranks(self.queries, self.docs.join(rels, "id", "left"), max(ks), places, rows=self.rows)
        return _metrics(qrels.groupBy("query_id").agg(F.count("*").alias("total")), ranks, ks)


def _listed(weighed: DataFrame) -> DataFrame:
    """(id, term, w) rows as one row an id."""
    lists = weighed.groupBy("id").agg(F.collect_list(F.struct("term", "w")).alias("t"))
    return lists.select("id", F.col("t.term").alias("terms"), F.col("t.w").alias("v"))


def bm25(queries: DataFrame, docs: DataFrame, query_key: str, doc_key: str, text: str = "text", k1: float = 1.5, b: float = 0.75, epsilon: float = 0.25) -> Vectors:
    """Okapi BM25, where negative idf becomes ``epsilon`` times the mean idf: a query's weight of a term is its count times idf.

    Document frequencies are counted from each document's distinct words, added up before they travel. Only words that
    some query holds become postings, so no other word of the corpus is grouped or shuffled; a document's length rides
    along. Null texts hold no word.
    """
    words = docs.select(F.col(doc_key).alias("doc_id"), bm25_tokens(F.col(text)).alias("w"))
    totals = words.agg(F.count("*").alias("n"), F.avg(F.coalesce(F.size("w"), F.lit(0))).alias("avgdl"))
    df = words.select(F.explode(F.array_distinct("w")).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    idf = df.join(totals, F.lit(True)).select("term", "avgdl", (F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)).alias("raw"))
    mean = idf.agg(F.avg("raw").alias("mean"))
    q = _terms(queries, query_key, bm25_tokens(F.col(text))).select(F.col("id").alias("query_id"), "term", F.col("tf").alias("qtf"))
    wanted = q.select("term").distinct()
    idf = idf.join(wanted, "term", "left_semi").join(mean, F.lit(True)).select("term", "avgdl", F.when(F.col("raw") < 0, F.col("mean") * epsilon).otherwise(F.col("raw")).alias("idf"))
    postings = words.select("doc_id", F.size("w").alias("dl"), F.explode("w").alias("term")).join(wanted, "term", "left_semi")
    postings = postings.groupBy("doc_id", "term").agg(F.count("*").alias("tf"), F.first("dl").alias("dl"))
    saturated = F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    told = postings.join(totals.select("avgdl"), F.lit(True)).select(F.col("doc_id").alias("id"), "term", saturated.alias("w"))
    asked = q.join(idf, "term").select(F.col("query_id").alias("id"), "term", (F.col("qtf") * F.col("idf")).alias("w"))
    return Vectors(_listed(asked), _listed(told), (queries.count(), docs.count()))


def tfidf(queries: DataFrame, docs: DataFrame, query_key: str, doc_key: str, text: str = "text", max_df: float = 0.95) -> Vectors:
    """Cosine of sublinear tf-idf vectors fitted on the documents; terms of more than ``max_df`` of
    them are dropped, accents are stripped.

    A document's norm needs all its terms, but only those that a query holds are kept.
    """
    tokens = word_tokens(strip_accents(F.col(text)))
    d = _terms(docs, doc_key, tokens)
    n = docs.agg(F.count("*").alias("n"))
    df = docs.select(F.explode(F.array_distinct(tokens)).alias("term")).groupBy("term").agg(F.count("*").alias("df")).join(n, F.lit(True)).where(F.col("df") <= max_df * F.col("n"))
    idf = df.select("term", (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1).alias("idf"))
    weighed = lambda t: t.join(idf, "term").select("id", "term", ((1 + F.log("tf")) * F.col("idf")).alias("w"))
    norms = lambda w: w.groupBy("id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    q, w = weighed(_terms(queries, query_key, tokens)), weighed(d)
    x = q.join(norms(q), "id").select("id", "term", (F.col("w") / F.col("norm")).alias("w"))
    kept = w.join(q.select("term").distinct(), "term", "left_semi")
    y = _listed(kept).join(norms(w), "id").select("id", "terms", F.transform("v", lambda a: a / F.col("norm")).alias("v"))
    return Vectors(_listed(x), y, (queries.count(), docs.count()))


def dense(queries: DataFrame, docs: DataFrame, places: int = 4) -> DataFrame:
    """(query_id, doc_id, score): rounded dot products of (id, v) vectors. The stated query set is held against all documents."""
    return dense_cells.scores(queries, docs, places)


def dense_top(queries: DataFrame, docs: DataFrame, k: int, places: int = 4) -> DataFrame:
    """``ranked`` of the dot products, down to rank ``k``; only the best pairs of each cell become rows."""
    return ranked(dense_cells.top(queries, docs, k, places), k, places)


def dense_metrics(queries: DataFrame, docs: DataFrame, ks: tuple[int, ...] = (5, 10, 20), places: int = 4) -> DataFrame:
    """``metrics`` of the dot products of (id, v, label) rows, where another document of a query's label is a relevant one. Neither
    the pairs nor the relevant ones among them become rows."""
    n = docs.where("label is not null").groupBy("label").agg(F.count("id").alias("n"))
    same = docs.groupBy("label", "id").agg(F.count("*").alias("same"))
    positives = queries.join(same, ["label", "id"]).join(n, "label").groupBy(F.col("id").alias("query_id")).agg(F.sum(F.col("n") - F.col("same")).alias("total")).where("total > 0")
    return _metrics(positives, dense_cells.ranks(queries, docs, max(ks), places), ks)


def _metrics(positives: DataFrame, ranks: DataFrame, ks: tuple[int, ...]) -> DataFrame:
    """The metrics' row from (query_id, total) and ``dense_cells.ranks``."""
    at = F.filter(F.transform("ranking", lambda x, i: F.when(x, i + 1)), lambda i: i.isNotNull())
    per = positives.join(ranks, "query_id", "left").select("total", F.coalesce(1 / F.col("first"), F.lit(0.0)).alias("rr"), F.coalesce(at, F.array().cast("array<int>")).alias("at"))
    added = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x)
    ideal = lambda k: added(F.transform(F.sequence(F.lit(1), F.least("total", F.lit(k)).cast("int")), lambda i: 1 / F.log2(i + 1.0)))
    upto = lambda k: F.filter("at", lambda i: i <= k)
    out = [F.avg("rr").alias("mrr")]
    for k in ks:
        inside = upto(k)
        out.append(F.avg(added(F.transform(inside, lambda i, h: (h + 1) / i)) / F.least("total", F.lit(k))).alias(f"map_{k}"))
        out.append(F.avg(added(F.transform(inside, lambda i: 1 / F.log2(i + 1.0))) / ideal(k)).alias(f"ndcg_{k}"))
    return per.agg(*out)


def ranked(scores: DataFrame, k: int | None = None, places: int = 4) -> DataFrame:
    """Ranks by score, rounded so that equal scores tie, then doc_id; with ``k`` Spark cuts each partition's rows early."""
    by = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("doc_id"))
    out = scores.withColumn("score", F.round("score", places) + F.lit(0.0)).withColumn("rank", F.row_number().over(by))
    return out if k is None else out.where(F.col("rank") <= k)


def passage_matches(docs: DataFrame, passages: DataFrame, doc_key: str = "doc_id", passage_key: str = "item_id", text: str = "text") -> DataFrame:
    """(query_id, doc_id): which documents hold which passage, character by character.

    A passage's inner words, between blanks, are whole words of every document that holds it; the longest of them leads to
    the documents worth a look. Passages of fewer than three words have none and are held against all documents.
    """
    inner = F.slice(F.split(text, " "), 2, F.greatest(F.size(F.split(text, " ")) - 2, F.lit(0)))
    longest = F.array_max(F.transform(inner, lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))["w"]
    p = passages.where(F.col(text).isNotNull()).select(F.col(passage_key).alias("query_id"), F.col(text).alias("said"), F.nullif(longest, F.lit("")).alias("word"))
    d = docs.select(F.col(doc_key).alias("doc_id"), F.col(text).alias("body"))
    led = p.where("word is not null")
    at = d.select("doc_id", F.explode(F.array_distinct(F.split("body", " "))).alias("word")).join(led.select("word").distinct(), "word", "left_semi")
    pairs = at.join(led, "word").select("query_id", "doc_id", "said").join(d, "doc_id")
    short = d.join(p.where("word is null"), F.contains("body", "said"))
    found = pairs.where(F.contains("body", "said")).select("query_id", "doc_id")
    return found.unionByName(short.select("query_id", "doc_id"))


def metrics(scores: DataFrame, qrels: DataFrame, ks: tuple[int, ...] = (5, 10, 20), places: int = 4) -> DataFrame:
    """One row of MRR and MAP@k, nDCG@k over queries with a positive. No ranking is sorted: a relevant document's rank is 1 plus
    the rows above it, which are counted, added up before they travel. Documents without a score come last."""
    s = scores.select("query_id", "doc_id", (F.round("score", places) + F.lit(0.0)).alias("score"))
    rel = s.join(qrels.select("query_id", "doc_id").distinct(), ["query_id", "doc_id"])
    mine = rel.select("query_id", F.col("doc_id").alias("rel_doc"), F.col("score").alias("rel_score"))
    better = (F.col("score") > F.col("rel_score")) | ((F.col("score") == F.col("rel_score")) & (F.col("doc_id") <= F.col("rel_doc")))
    r = s.join(mine, "query_id").where(better).groupBy("query_id", "rel_doc").agg(F.count("*").alias("rank"))
    w = Window.partitionBy("query_id").orderBy("rank")
    r = r.withColumn("hits", F.row_number().over(w))
    positives = qrels.groupBy("query_id").agg(F.count("*").alias("total"))
    aggs = [F.coalesce(F.max(F.lit(1.0) / F.col("rank")), F.lit(0.0)).alias("rr")]
    for k in ks:
        inside = F.col("rank") <= k
        aggs.append(F.coalesce(F.sum(F.when(inside, F.col("hits") / F.col("rank"))), F.lit(0.0)).alias(f"ap{k}"))
        aggs.append(F.coalesce(F.sum(F.when(inside, 1 / F.log2(F.col("rank") + 1))), F.lit(0.0)).alias(f"dcg{k}"))
    per = positives.join(r, "query_id", "left").groupBy("query_id", "total").agg(*aggs)
    ideal = lambda k: F.aggregate(F.sequence(F.lit(1), F.least("total", F.lit(k)).cast("int")), F.lit(0.0), lambda a, i: a + 1 / F.log2(i + 1.0))
    out = [F.avg("rr").alias("mrr")]
    for k in ks:
        out += [F.avg(F.col(f"ap{k}") / F.least("total", F.lit(k))).alias(f"map_{k}"), F.avg(F.col(f"dcg{k}") / ideal(k)).alias(f"ndcg_{k}")]
    return per.agg(*out)
