"""Toxicity by non-negative positive-unlabelled learning."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webloom.llm.common import few_texts, fold, small_side, staged, table

#: Training rows at most, about: confirmed toxic ones, and unlabelled ones. A hash of the row picks them.
POSITIVES, UNLABELLED = 4000, 10_000
#: A feature is kept if its share of the positives is so many standard errors above its share of the unlabelled.
LEAST_Z = 4.0
#: Features at most; those with the greatest z stay.
MOST_FEATURES = 20_000
CUT = 0.7
#: Characters of a word's beginning.
START = 5
_WORDS = re.compile(r"[^\W\d_]+")


def features(words: set[str]) -> set[str]:
    """The words of a text, and the beginnings of its longer words: one feature for each count up to three that is reached."""
    starts = Counter(w[:START] for w in words if len(w) > START)
    return words | {f"{s}-{k}" for s, n in starts.items() for k in range(1, min(n, 3) + 1)}


def fit(positive: list[np.ndarray], unlabelled: list[np.ndarray], size: int, prior: float, *, rounds: int = 300, rate: float = 0.05, decay: float = 1e-3) -> tuple[np.ndarray, float]:
    """Weights and intercept of a linear classifier of feature presence, by the non-negative PU risk.

    Texts are given as the numbers of their features, of which there are ``size``. With the share ``prior`` of toxic
    texts, the risk of calling the unlabelled toxic, less the part of it that their toxic ones have, estimates the
    risk on clean texts. When this estimate falls under zero the classifier has begun to fit the sample, and the step
    goes up its gradient instead (Kiryo and others, 2017). Logistic loss, full batches, Adam, all in numpy.
    """
    n_p, n_u = max(1, len(positive)), max(1, len(unlabelled))

    def sparse(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        return np.repeat(np.arange(len(texts)), [len(c) for c in texts]), np.concatenate([np.empty(0, np.int64), *texts]).astype(np.int64)

    (rp, cp), (ru, cu) = sparse(positive), sparse(unlabelled)
    w, m, v = (np.zeros(size + 1) for _ in range(3))
    w[-1] = -2.0
    sigmoid = lambda x: 1 / (1 + np.exp(-np.clip(x, -50, 50)))
    for t in range(1, rounds + 1):
        fp = np.bincount(rp, w[cp], len(positive)) + w[-1]
        fu = np.bincount(ru, w[cu], len(unlabelled)) + w[-1]
        clean = np.logaddexp(0, fu).sum() / n_u - prior * np.logaddexp(0, fp).sum() / n_p
        up, gp, gu = prior * (sigmoid(fp) - 1) / n_p, -prior * sigmoid(fp) / n_p, sigmoid(fu) / n_u
        gp, gu = (up + gp, gu) if clean >= 0 else (-gp, -gu)
        g = np.r_[np.bincount(cp, gp[rp], size) + np.bincount(cu, gu[ru], size), gp.sum() + gu.sum()]
        g[:-1] += decay * prior * w[:-1]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
    return w[:-1], float(w[-1])


def _with_features(docs: DataFrame) -> DataFrame:
    """toxic and features (array<string>) of rows (text, toxic)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in few_texts(batches):
            found = [sorted(features(set(_WORDS.findall((t.as_py() or "").lower())))) for t in b.column("text")]
            yield pa.RecordBatch.from_arrays([b.column("toxic"), pa.array(found, pa.list_(pa.string()))], ["toxic", "features"])

    return docs.select("toxic", F.col("text").cast("string").alias("text")).mapInArrow(run, "toxic int, features array<string>")


def _vocabulary(sample: DataFrame, n_p: int, n_u: int) -> list[str]:
    """The features that stand out among the positives of a sample; counted by a shuffle, MOST_FEATURES at most."""
    per = sample.select("toxic", F.explode("features").alias("f")).groupBy("f").agg(F.sum("toxic").alias("p"), F.sum(1 - F.col("toxic")).alias("u")).where("p >= 3")
    q = (F.col("u") + 1) / (n_u + 2)
    z = (F.col("p") / n_p - q) / F.sqrt(q * (1 - q) / n_p)
    return [r.f for r in per.withColumn("z", z).where(F.col("z") >= LEAST_Z).orderBy(F.desc("z"), "f").limit(MOST_FEATURES).select("f").collect()]


def train(docs: DataFrame, labels: DataFrame, *, prior: float | None = None) -> tuple[dict[str, float], float]:
    """A classifier from ``docs`` (doc_id, text) and the ids that ``labels`` (doc_id, toxic) confirms as toxic.

    All of ``docs`` are the unlabelled texts; of them and of the confirmed ones, samples of about UNLABELLED and
    POSITIVES rows are taken, by a hash of the row; repeated rows count once in them. ``prior``, the share of toxic texts,
    is that of the labelled rows unless given. Labels without an id or a mark are passed over, and of several marks of one
    id the greatest counts; null and empty texts are texts without a feature. Without any confirmed text nothing is toxic.
    """
    marks = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    seen = marks.join(docs.select("doc_id").distinct(), "doc_id", "left_semi").agg(F.count("*"), F.coalesce(F.sum((F.col("toxic") >= 1).cast("int")), F.lit(0))).first()
    rows = docs.count()
    if not seen[1] or not rows:
        return {}, -5.0
    prior = min(0.9, max(0.005, seen[1] / seen[0])) if prior is None else prior
    draw = lambda *of: F.pmod(F.xxhash64(*of, F.lit(7)), F.lit(1 << 30)) / (1 << 30)
    toxic = marks.where("toxic >= 1").where(draw("doc_id") < POSITIVES / seen[1]).select("doc_id")
    positive = docs.join(small_side(toxic, 4 * POSITIVES), "doc_id", "left_semi").dropDuplicates(["doc_id", "text"]).select("text", F.lit(1).alias("toxic"))
    unlabelled = docs.where(draw("doc_id", "text") < UNLABELLED / rows).dropDuplicates(["doc_id", "text"]).select("text", F.lit(0).alias("toxic"))
    sample = staged(_with_features(positive.unionByName(unlabelled)), "toxicity-sample")
    n = {r.toxic: r["count"] for r in sample.groupBy("toxic").count().collect()}
    vocabulary = _vocabulary(sample, n.get(1, 0), n.get(0, 0))
    at = {f: i for i, f in enumerate(vocabulary)}

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            have = [sorted(at[f] for f in x.as_py() if f in at) for x in b.column("features")]
            yield pa.RecordBatch.from_arrays([b.column("toxic"), pa.array(have, pa.list_(pa.int32()))], ["toxic", "at"])

    texts: tuple[list[np.ndarray], list[np.ndarray]] = ([], [])
    for r in sample.mapInArrow(number, "toxic int, at array<int>").toLocalIterator():
        texts[r.toxic].append(np.array(r["at"], np.int64))
    weights, bias = fit(texts[1], texts[0], len(vocabulary), prior)
    return dict(zip(vocabulary, map(float, weights), strict=True)), bias


def with_score(docs: DataFrame, model: tuple[dict[str, float], float], *, cut: float = CUT, score: str = "toxicity", flag: str = "toxic") -> DataFrame:
    """``docs`` with the columns ``score`` (0 to 1) and ``flag`` (1 if that is ``cut`` or more).

    The whole text is read, once, without a shuffle. Null and wordless texts have the score of the intercept alone.
    Repeated rows keep their number. Other columns come back as they are; columns of these two names are replaced (name
    them otherwise to keep such columns); an empty table gives an empty result.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight, bias = sent.value
        starts = {f.partition("-")[0] for f in weight if "-" in f}
        for b in few_texts(batches):
            scores = []
            for t in b.column("text"):
                words = set(_WORDS.findall((t.as_py() or "").lower()))
                have = features({w for w in words if w in weight or w[:START] in starts}) & weight.keys()
                scores.append(1 / (1 + np.exp(-np.clip(bias + sum(weight[f] for f in sorted(have)), -50, 50))))
            found = np.array(scores, float)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(found), pa.array((found >= cut).astype(np.int32))], [*b.schema.names, score, flag])

    kept = docs.drop(score, flag)
    return kept.mapInArrow(run, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema), f"`{score}` double, `{flag}` int"]))


def held_out_model(docs: DataFrame, labels: DataFrame) -> tuple[dict[str, float], float]:
    """The model of the contract: trained without the rows of fold 1 of 3."""
    return train(docs.where(fold("doc_id", 3) != 1).select("doc_id", "text"), labels.where(fold("doc_id", 3) != 1).select("doc_id", "toxic"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = with_score(docs, held_out_model(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", (fold("doc_id", 3) == 1).alias("held_out"), F.col("toxicity").alias("score"), F.col("toxic").alias("predicted"))
