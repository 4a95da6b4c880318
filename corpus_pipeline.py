"""A corpus pipeline: toxicity, near-dedup, decontamination, secrets, mixing. Each stage calls one operator of webloom.llm."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from webloom.llm import decontam, mixing, secrets, simhash, toxicity
from webloom.llm.common import free_names, row_key, staged, table, unstage


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go. It learns from the confirmed rows of ``labels`` and all of ``docs``.

    Null and empty texts have the score of a text without a feature and stay; rows with equal texts go or stay together;
    null ids match no label; without labels all stay; an empty table gives an empty one. All columns come back as they are.
    """
    model = toxicity.train(docs.select("doc_id", "text"), table(spark, sf_dir, "labels").select("doc_id", "toxic"))
    score, flag = free_names(docs, "toxicity", "toxic")
    return toxicity.with_score(docs, model, score=score, flag=flag).where(F.col(flag) == 0).drop(score, flag)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents, by SimHash or by near copies of it, the one with the least id stays.

    Null and empty texts are a group like any other. Of rows equal in id and text one stays, that with the least hash of all
    its columns; rows of one id with different texts are one document and stay together. Rows without an id go if their
    group has one; of the others, one of each fingerprint stays. An empty table gives an empty one; all columns come back.
    """
    groups = staged(simhash.near_copies(docs.select("doc_id", "text")), "pipeline-groups")
    named = groups.where("doc_id = component_id").select("doc_id", "text_key").distinct()
    unnamed = groups.where("doc_id is null and component_id is null").groupBy("doc_id", "fingerprint").agg(F.min("text_key").alias("text_key"))
    own_id, own_key, key, place = free_names(docs, "_id", "_key", "_text_key", "_place")
    stay = named.unionByName(unnamed.drop("fingerprint")).toDF(own_id, own_key)
    keyed = docs.withColumn(key, row_key(F.col("text")))
    kept = keyed.join(stay, F.col("doc_id").eqNullSafe(F.col(own_id)) & (F.col(key) == F.col(own_key)), "left_semi")
    plain = [F.col(f"`{f.name}`") for f in docs.schema if "map<" not in f.dataType.simpleString()]
    order = Window.partitionBy("doc_id", key).orderBy(F.xxhash64(*plain))
    return kept.withColumn(place, F.row_number().over(order)).where(F.col(place) == 1).drop(key, place)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap with a benchmark item go.

    Null and empty texts overlap with nothing and stay, null ids and repeated rows too unless their text overlaps; without
    benchmark items all stay; an empty table gives an empty one. All columns come back as they are.
    """
    return decontam.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets, and weak parts of credentials that complete each other, are masked in the texts; all documents stay.

    Null and empty texts stay as they are, repeated rows keep their number, null ids are ids; an empty table gives an empty
    one. All columns come back; only text changes, and n_chars with it.
    """
    return secrets.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row for each time that the mix takes a document: its columns and ``copy``, counted from 1.

    A table that has a column of that name gets ``_copy`` instead. Null and empty texts have no words: they come back as
    often as their source's whole repetitions. Null sources are one source; repeated rows are documents of their own;
    null ids count as the empty id; an empty table gives an empty one.
    """
    mixed = mixing.mix(docs, rows=True).where("copies > 0")
    (copy,) = free_names(docs, "copy")
    return mixed.select("row.*", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias(copy))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_copies", drop_near_copies),
    ("decontamination", drop_leaks),
    ("secrets", mask_secrets),
    ("mixing", mix_sources),
]

#: SimHash groups, the classifier and the spaced seeds have no SQL form; tests/llm/test_pipeline.py runs the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to ``documents``; what a stage has written is deleted as soon as the next one has read it."""
    docs, before = table(spark, sf_dir, "documents"), []
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
        unstage(*before)
        before = [docs]
    return STAGES[-1][1](spark, docs, sf_dir)
