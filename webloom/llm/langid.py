"""Language identification: averaged embeddings of hashed subwords with a linear softmax, and calibrated rejection."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webloom.llm.common import few_texts, fold, small_side, table

#: Buckets of hashed subwords, size of an embedding, training rows of a language at most (about), passes over them.
BUCKETS, SIZE, PER_LANGUAGE, PASSES = 1 << 14, 16, 1000, 5
#: Byte lengths of subwords.
LENGTHS = (3, 4)
#: Bytes hashed at a time, so that a very long text needs no more memory.
PIECE = 1 << 18
#: Of each training text a short piece of so many characters is learned from too.
SHORT = 80
_LETTER = re.compile(r"[^\W\d_]")
#: A-Z lowered; letters and all bytes of other scripts stay; anything else separates words.
_PLAIN = bytes(b if 97 <= b <= 122 or b >= 128 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))


def has_letter(text: str) -> bool:
    """Whether any character is a letter; marks like a half or a square, which are numeric, are none."""
    return any(m[0].isalpha() for m in _LETTER.finditer(text))


def subwords(text: str) -> Iterator[np.ndarray]:
    """Buckets of all subwords of a text, by pieces: byte runs of its words, word ends included."""
    raw = b" " + b" ".join(text.encode().translate(_PLAIN).split()) + b" "
    for at in range(0, len(raw), PIECE):
        b = np.frombuffer(raw[at : at + PIECE + max(LENGTHS) - 1], np.uint8).astype(np.uint32)
        for n in LENGTHS:
            if (size := min(len(b) - n + 1, PIECE)) > 0:
                h = np.full(size, n, np.uint32)
                for i in range(n):
                    h = (h ^ b[i : i + size]) * np.uint32(0x01000193)
                yield (h ^ (h >> 15)) & np.uint32(BUCKETS - 1)


def _counts(docs: DataFrame) -> list[tuple[str, np.ndarray, np.ndarray]]:
    """(language, buckets, counts) of the rows of a bounded sample; counted on the executors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in few_texts(batches):
            made, names = [], []
            for t, lang in zip(b.column("text"), b.column("lang"), strict=True):
                text = t.as_py() or ""
                middle = max(0, (len(text) - SHORT) // 2)
                for part in (text, text[middle : middle + SHORT]):
                    total = np.zeros(BUCKETS, np.int64)
                    for h in subwords(part):
                        total += np.bincount(h, minlength=BUCKETS)
                    at = np.flatnonzero(total)
                    made.append((at.astype(np.int32).tobytes(), total[at].astype(np.float32).tobytes()))
                    names.append(lang.as_py())
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([x for x, _ in made], pa.binary()), pa.array([y for _, y in made], pa.binary())], ["lang", "at", "n"])

    rows = docs.select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text")).mapInArrow(run, "lang string, at binary, n binary").toLocalIterator()
    return [(r.lang, np.frombuffer(bytes(r.at), np.int32), np.frombuffer(bytes(r.n), np.float32)) for r in rows if len(r.at)]


def train(docs: DataFrame, *, seed: int = 42, rate: float = 2.0) -> dict:
    """A model from ``docs`` (doc_id, text, lang): labels, a table of scores by bucket, temperature, rejection level.

    Rows without a language are passed over. Of each language about PER_LANGUAGE rows are taken, by a hash of the row.
    Embeddings and softmax are trained by stochastic gradient descent on the mean embeddings of the sample's texts, of a
    short piece of each, and of made-up texts of random subwords. These are one more class, of no language, as texts in
    unknown scripts look to a hash like them. The product of embeddings and softmax is kept, as one score per bucket and
    class. A tenth of all that is left out: on it the temperature is set that makes the scores likeliest, and the level under
    which 1 % of its right answers fall is the rejection level. Repeated rows count as often as they come, and without any
    language nothing is learned.
    """
    named = docs.where("lang is not null")
    sizes = named.groupBy("lang").count()
    draw = F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(1 << 30)) / (1 << 30)
    picked = named.select("doc_id", "text", "lang").join(small_side(sizes, 10_000), "lang").where(draw * F.col("count") < PER_LANGUAGE)
    data = sorted(_counts(picked), key=lambda r: (r[0], r[1].tobytes(), r[2].tobytes()))
    labels = sorted({r[0] for r in data})
    if not labels:
        return {"labels": [], "scores": np.zeros((BUCKETS, 0), np.float32), "bias": np.zeros(0, np.float32), "temperature": 1.0, "reject": 0.0}
    rng = np.random.default_rng(seed)
    for _ in range(max(20, len(data) // len(labels))):
        at, n = np.unique(rng.integers(0, BUCKETS, int(np.exp(rng.uniform(2, 7)))), return_counts=True)
        data.append(("", at, n.astype(np.float32)))
    order = rng.permutation(len(data))
    aside, used = order[: len(order) // 10], order[len(order) // 10 :]
    number = {x: i for i, x in enumerate(labels)} | {"": len(labels)}
    embed = rng.normal(0, 0.1, (BUCKETS, SIZE)).astype(np.float32)
    soft, bias = np.zeros((SIZE, len(number)), np.float32), np.zeros(len(number), np.float32)

    def dense(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        x = np.zeros((len(rows), BUCKETS), np.float32)
        for i, r in enumerate(rows):
            x[i, data[r][1]] = data[r][2] / data[r][2].sum()
        return x, np.array([number[data[r][0]] for r in rows])

    def softmax(z: np.ndarray) -> np.ndarray:
        e = np.exp(z - z.max(1, keepdims=True))
        return e / e.sum(1, keepdims=True)

    steps = max(1, PASSES * -(-len(used) // 32))
    done = 0
    for _ in range(PASSES):
        rng.shuffle(used)
        for i in range(0, len(used), 32):
            x, y = dense(used[i : i + 32])
            mean = x @ embed
            p = softmax(mean @ soft + bias)
            p[np.arange(len(y)), y] -= 1
            p *= rate * (1 - done / steps) / len(y)
            back = p @ soft.T
            soft -= mean.T @ p * 20
            bias -= p.sum(0)
            embed -= (x.T @ back) * 50
            done += 1
    scores = embed @ soft
    x, y = dense(aside if len(aside) else used[:100])
    z = x @ scores + bias
    # As in Platt's scaling, the right class is expected with (n + 1) of (n + 2) parts, so that no temperature is the limit.
    want = np.full(z.shape, 1 / (len(y) + 2) / len(labels))
    want[np.arange(len(y)), y] = (len(y) + 1) / (len(y) + 2)

    def loss(t: float) -> float:
        u = z / t - (z / t).max(1, keepdims=True)
        return float((want * (np.log(np.exp(u).sum(1, keepdims=True)) - u)).sum())

    temperature = min((float(t) for t in np.geomspace(0.002, 50, 120)), key=loss)
    p = softmax(z / temperature)
    sure = p.max(1)[(p.argmax(1) == y) & (y < len(labels))]
    return {"labels": labels, "scores": scores.astype(np.float32), "bias": bias, "temperature": temperature, "reject": float(np.quantile(sure, 0.01)) if len(sure) else 0.0}


def with_language(docs: DataFrame, model: dict, *, reject: bool = True) -> DataFrame:
    """``docs`` with lang_pred, lang_score (its calibrated probability) and lang_sure (not under the rejection level).

    With ``reject``, a prediction that isn't sure is ``und``; one is not sure either if no language at all is likelier. Null texts and those without a letter are always
    ``und``, with score 0, and so is everything if no language was learned. The whole text is read, once, without a
    shuffle; repeated rows keep their number; other columns come back as they are, but for columns of these three names,
    which are replaced; an empty table gives an empty result.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        table_, labels = m["scores"], m["labels"]
        for b in few_texts(batches):
            names, scores, sure = [], [], []
            for t in b.column("text"):
                text = t.as_py() or ""
                if not labels or not has_letter(text):
                    names.append("und"), scores.append(0.0), sure.append(False)
                    continue
                total, n = np.zeros(len(labels) + 1), 0
                for h in subwords(text):
                    total += table_[h].sum(0, dtype=np.float64)
                    n += len(h)
                z = (total / max(1, n) + m["bias"]) / m["temperature"]
                p = np.exp(z - z.max())
                p /= p.sum()
                best = int(p[:-1].argmax())
                sure.append(bool(p[best] >= max(m["reject"], p[-1])))
                names.append(labels[best] if sure[-1] or not reject else "und")
                scores.append(float(p[best]))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(sure, pa.bool_())], [*b.schema.names, "lang_pred", "lang_score", "lang_sure"])

    kept = docs.drop("lang_pred", "lang_score", "lang_sure")
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema), "lang_pred string, lang_score double, lang_sure boolean"])
    return kept.mapInArrow(run, schema)


def op5_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs.where(fold("doc_id", 3) != 1).select("doc_id", "text", "lang"))
    told = with_language(docs.select("doc_id", "text"), model, reject=False)
    return told.select("doc_id", (fold("doc_id", 3) == 1).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"), (~F.col("lang_sure")).alias("rejected"))
