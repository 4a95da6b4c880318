"""Inverted index, its statistics, ranked and boolean retrieval."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webloom.functions.text import tokens_ascii


def postings(docs: DataFrame, tokens: Column, id_col: str = "doc_id") -> DataFrame:
    """(doc_id, token, tf): the index as a table, not as lists, so that a frequent token is just many rows."""
    return docs.select(F.col(id_col).alias("doc_id"), F.explode(tokens).alias("token")).groupBy("doc_id", "token").agg(F.count("*").alias("tf"))


def merge(old: DataFrame, new: DataFrame) -> DataFrame:
    """The old index with the documents of the new one put in or replaced."""
    return old.join(new.select("doc_id").distinct(), "doc_id", "left_anti").unionByName(new)


def stemmed(p: DataFrame, stem) -> DataFrame:
    """An index by stems: each distinct token is stemmed once, and joined back."""
    stems = p.select("token").distinct().withColumn("stem", stem("token"))
    return p.join(stems, "token").groupBy("doc_id", F.col("stem").alias("token")).agg(F.sum("tf").alias("tf"))


def doc_length(p: DataFrame) -> DataFrame:
    return p.groupBy("doc_id").agg(F.sqrt(F.sum(F.pow(1 + F.log10("tf"), 2))).alias("len"))


def token_stats(p: DataFrame, n_docs: int) -> DataFrame:
    df = F.count("*")
    return p.groupBy("token").agg(F.sum("tf").alias("cf"), df.alias("df"), (n_docs / df).alias("idf"), F.log(n_docs / df).alias("log_idf"))


def split_query(query: str, legacy_or: bool = False) -> list[list[str]]:
    """Clauses of a query; OR parts them (as a word of its own, unless ``legacy_or``)."""
    parts = query.split("OR") if legacy_or else re.split(r"\bOR\b", query)
    return [c for c in (re.sub("[^A-Za-z]+", " ", p).lower().split() for p in parts) if c]


def search_cosine(p: DataFrame, query: str, n_docs: int, *, distinct: bool = False, legacy_or: bool = False) -> DataFrame:
    """(doc_id, score) of documents with all words of a clause, once for each such clause.

    Query words are few, so they are literals: the scan of the index is filtered by them, and only their postings meet.
    """
    import math
    from collections import Counter

    clauses = split_query(query, legacy_or)
    tf = Counter(w for c in clauses for w in c)
    if not tf:
        return p.select("doc_id", F.lit(0.0).alias("score")).limit(0)
    q_len = math.sqrt(sum((1 + math.log10(n)) ** 2 for n in tf.values()))
    hits = p.where(F.col("token").isin(*tf))
    df = hits.groupBy("token").agg(F.count("*").alias("df"))
    weight = F.element_at(F.create_map(*[F.lit(x) for w, n in tf.items() for x in (w, (1 + math.log10(n)) / q_len)]), F.col("token"))
    idf = F.log10(F.lit(float(n_docs)) / F.col("df"))
    scored = hits.join(df, "token").withColumn("w", (1 + F.log10("tf")) * idf * weight * idf)
    per = scored.groupBy("doc_id").agg(F.sum("w").alias("w"), F.collect_set("token").alias("have"))
    met = F.array(*[F.size(F.array_intersect("have", F.array(*[F.lit(w) for w in set(c)]))) == len(set(c)) for c in clauses])
    times = F.size(F.filter(met, lambda x: x))
    per = per.where(times > 0).withColumn("times", F.lit(1) if distinct else times)
    lens = doc_length(p.join(per.select("doc_id"), "doc_id", "left_semi"))
    out = per.join(lens, "doc_id").withColumn("_", F.explode(F.sequence(F.lit(1), F.col("times"))))
    return out.select("doc_id", (F.col("w") / F.col("len")).alias("score")).orderBy(F.desc("score"), F.desc("doc_id"))


def search_ratio(p: DataFrame, words: list[str], n_docs: int, *, top: int = 50, mode: str = "any") -> DataFrame:
    """The best documents with any word of the query (``mode`` all: with every one); none if a word is unknown.

    Query words count as often as they stand in the query. The inverse document frequency is the plain ratio, the
    length of a document has logarithms to the base 2, and that of the query is the root of the cube of its words.
    """
    from collections import Counter

    tf = Counter(words)
    m = len(words)
    if not m:
        return p.select("doc_id", F.lit(0.0).alias("score")).limit(0)
    hits = p.where(F.col("token").isin(*tf))
    df = hits.groupBy("token").agg(F.count("*").alias("df"))
    known = df.agg((F.count("*") == len(tf)).alias("known"))
    times = F.element_at(F.create_map(*[F.lit(x) for w, n in tf.items() for x in (w, n)]), F.col("token"))
    idf = F.lit(float(n_docs)) / F.col("df")
    part = hits.join(df, "token").groupBy("doc_id").agg(F.sum(times * (1 + F.log10("tf")) * idf * idf).alias("w"), F.count("*").alias("have"))
    part = part.where(F.col("have") >= (len(tf) if mode == "all" else 1))
    norm = p.join(part.select("doc_id"), "doc_id", "left_semi").groupBy("doc_id").agg(F.sqrt(F.sum(F.pow(1 + F.log2("tf"), 2))).alias("norm"))
    out = part.join(norm, "doc_id").join(F.broadcast(known.where("known")))
    return out.select("doc_id", (F.col("w") / F.col("norm") / m**1.5).alias("score")).orderBy(F.desc("score"), "doc_id").limit(top)


def docs_with(p: DataFrame, word: str) -> DataFrame:
    return p.where(F.col("token") == word).select("doc_id").distinct()


def _documents(p: DataFrame | None, side: DataFrame | str) -> DataFrame:
    return docs_with(p, side) if isinstance(side, str) else side


def bool_and(a: DataFrame | str, b: DataFrame | str, p: DataFrame | None = None) -> DataFrame:
    """Documents of both; either side is a table of documents, or a word of the index ``p``."""
    return _documents(p, a).intersect(_documents(p, b))


def bool_or(a: DataFrame | str, b: DataFrame | str, p: DataFrame | None = None) -> DataFrame:
    """Documents of either; none if one of both is empty, that is if its word is unknown."""
    a, b = _documents(p, a), _documents(p, b)
    one = lambda x: x.limit(1).select(F.lit(1).alias("_"))
    return a.union(b).distinct().join(F.broadcast(one(a)), how="cross").drop("_").join(F.broadcast(one(b)), how="cross").drop("_")


def ascii_postings(docs: DataFrame) -> DataFrame:
    return postings(docs, tokens_ascii(F.col("text")))
