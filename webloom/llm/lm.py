"""Language-model scores by prediction by partial matching over bytes, and a unigram base."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webloom.llm.common import few_texts, fold, row_key, staged, table

#: Bytes of the longest context.
ORDER = 5
#: Runs of ORDER + 1 bytes, and words, that are sent to the executors, at most: those with the greatest counts. What
#: is known of all others is joined by a shuffle.
MOST_NODES, MOST_WORDS = 1 << 20, 1 << 19
#: The trie is dealt out by so many last bytes of the context; contexts of fewer bytes go to all parts.
DEAL = 2
#: Nodes of a part of the trie, about.
PART_NODES = 1 << 19
#: Bytes scored or counted at a time, so that a very long text needs no more memory.
PIECE = 1 << 20
_EMPTY = np.int64(-1)
_END = b"\n"


def _windows(buffer: bytes) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Keys of all runs of ORDER + 1 bytes, by pieces, and the places of their last bytes."""
    raw = np.frombuffer(buffer, np.uint8)
    for at in range(0, len(raw) - ORDER, PIECE):
        b = raw[at : at + PIECE + ORDER]
        key = np.zeros(len(b) - ORDER, np.int64)
        for i in range(ORDER + 1):
            key <<= 8
            key |= b[i : i + len(key)]
        yield key, np.arange(at + ORDER, at + ORDER + len(key))


def _stream(texts: list[list[bytes]]) -> tuple[bytes, np.ndarray]:
    """The words of texts joined by spaces, an end behind each text, ORDER ends before it; and where each begins."""
    parts, starts, at = [], [], 0
    for words in texts:
        s = _END * ORDER + b" ".join(words) + _END
        starts.append(at)
        parts.append(s)
        at += len(s)
    return b"".join(parts), np.array([*starts, at], np.int64)


def _predicted(places: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each place its text, and whether it is a byte to predict (not one of the ends before a text)."""
    text = np.searchsorted(starts, places, "right") - 1
    return text, places - starts[text] >= ORDER


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(kind, key, n): 0 and the XXH64 of a word, 1 and a run of ORDER + 1 bytes. Summed up per task as far as memory allows."""

    def out(kind: int, key: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(key), kind, np.int8)), pa.array(key), pa.array(n)], ["kind", "key", "n"])

    def words_out(words: Counter) -> pa.RecordBatch:
        return out(0, np.fromiter(map(xxhash.xxh64_intdigest, words, repeat(42)), np.uint64, len(words)).view(np.int64), np.fromiter(words.values(), np.int64, len(words)))

    def merged(keys: list[np.ndarray], ns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        key = np.concatenate(keys)
        by = np.argsort(key, kind="stable")
        key, n = key[by], np.concatenate(ns)[by]
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        return key[first], np.add.reduceat(n, first)

    words: Counter = Counter()
    keys: list[np.ndarray] = []
    ns: list[np.ndarray] = []
    for b in few_texts(batches):
        texts = [(t.as_py() or "").encode().lower().split() for t in b.column("text")]
        for t in texts:
            words.update(t)
        words[_END] += len(texts)
        buffer, starts = _stream(texts)
        for key, places in _windows(buffer):
            key, n = np.unique(key[_predicted(places, starts)[1]], return_counts=True)
            keys.append(key)
            ns.append(n)
        if len(words) > 300_000:
            yield words_out(words)
            words.clear()
        if sum(map(len, keys)) > 3_000_000:
            key, n = merged(keys, ns)
            if len(key) > 1_500_000:
                yield out(1, key, n)
                keys, ns = [], []
            else:
                keys, ns = [key], [n]
    if words:
        yield words_out(words)
    if keys:
        key, n = merged(keys, ns)
        if len(key):
            yield out(1, key, n)


def _at_most(counts: DataFrame, most: int) -> int:
    """The least count that at most ``most`` rows reach, from a histogram with a bounded number of classes."""
    level = F.when(F.col("n") < 64, F.col("n").cast("double")).otherwise(F.floor(F.log2("n") * 32) + 64)
    rows = counts.groupBy(level.alias("level")).agg(F.count("*").alias("rows"), F.min("n").alias("least")).orderBy("level").collect()
    total, least = 0, 1 << 62
    for r in reversed(rows):
        total += r.rows
        if total > most:
            break
        least = r.least
    return least


def trie(nodes: list[tuple[np.ndarray, np.ndarray]]) -> dict:
    """The model from the (key, count) of each order, keys sorted: everything that does not depend on the text.

    A byte seen n times in a context of T bytes of q kinds has (2n - 1) / 2T there, and the escape to the next shorter
    context has q / 2T (method D); with twice each count, less one, for a count, that is n / (T + q) and q / (T + q). Bytes that a longer context has seen are excluded in a shorter one: what is
    left of T and q after that hangs on the longer context, and is kept with it.
    """
    orders = []
    for k, (key, n) in enumerate(nodes):
        n = 2 * n - 1
        ctx, first = np.unique(key >> 8, return_index=True)
        total = np.add.reduceat(n, first) if len(n) else n
        kinds = np.diff(np.r_[first, len(key)])
        order = {"key": key, "log": np.log10(n), "n": n, "ctx": ctx, "total": total, "kinds": kinds}
        order["whole"] = np.log10(total + kinds)
        order["escape"] = np.log10(kinds) - order["whole"]
        if k:  # what the next shorter context has left when this one's bytes are excluded
            low = orders[k - 1]
            mask = (1 << (8 * k)) - 1
            same = low["n"][np.searchsorted(low["key"], key & mask)]
            up = np.searchsorted(low["ctx"], ctx & (mask >> 8))
            left, kinds_left = low["total"][up] - np.add.reduceat(same, first), low["kinds"][up] - kinds
            with np.errstate(divide="ignore"):
                order["left"] = np.log10(left + kinds_left)
                order["left_escape"] = np.where(kinds_left > 0, np.log10(np.maximum(kinds_left, 1)) - order["left"], 0.0)
        orders.append(order)
    model = {"orders": [{x: o[x] for x in ("key", "log", "ctx", "whole", "escape", "left", "left_escape") if x in o} for o in orders]}
    model["unseen"] = -np.log10(max(1, 256 - (len(orders[0]["key"]) if orders else 0)))
    if orders:
        top = orders[-1]
        return model | table_of(top["key"], top["log"] - np.repeat(top["whole"], top["kinds"]))
    return model | table_of(np.empty(0, np.int64), np.empty(0))


def table_of(key: np.ndarray, logp: np.ndarray) -> dict:
    """A hash table of distinct keys and their values: at most half of its slots are taken."""
    bits = max(10, int(2 * len(key)).bit_length())
    slots, value = np.full(1 << bits, _EMPTY), np.zeros(1 << bits, np.float64)
    at, rest = _slot(key, bits), np.arange(len(key))
    while len(rest):
        free = rest[slots[at[rest]] == _EMPTY]
        _, one = np.unique(at[free], return_index=True)
        put = free[one]
        slots[at[put]], value[at[put]] = key[put], logp[put]
        rest = np.setdiff1d(rest, put, assume_unique=True)
        at[rest] = (at[rest] + 1) & ((1 << bits) - 1)
    return {"slots": slots, "value": value}


def _slot(key: np.ndarray, bits: int) -> np.ndarray:
    return ((key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)).astype(np.int64)


def _locate(sorted_: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(sorted_):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(sorted_, wanted), len(sorted_) - 1)
    return at, sorted_[at] == wanted


def look_up(model: dict, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The value of each key in the hash table, 0 if it has none; and the places of those."""
    slots, value = model["slots"], model["value"]
    bits = len(slots).bit_length() - 1
    at = _slot(key, bits)
    there = slots[at]
    out = value[at]
    miss = np.flatnonzero(there != key)
    todo = miss[there[miss] != _EMPTY]
    absent = [miss[there[miss] == _EMPTY]]
    at = at[todo]
    while len(todo):
        at = (at + 1) & (len(slots) - 1)
        there = slots[at]
        hit = there == key[todo]
        out[todo[hit]] = value[at[hit]]
        gone = there == _EMPTY
        absent.append(todo[gone])
        go = ~hit & ~gone
        todo, at = todo[go], at[go]
    rest = np.sort(np.concatenate(absent))
    out[rest] = 0.0
    return out, rest


def log_probability(model: dict, key: np.ndarray) -> np.ndarray:
    """log10 of the probability of each key's last byte after its other bytes."""
    out, rest = look_up(model, key)
    came = np.full(len(rest), -1, np.int64)  # the next longer context, if that was met and left
    for k in range(len(model["orders"]) - 1, -1, -1):
        o = model["orders"][k]
        part = key[rest] & ((1 << (8 * (k + 1))) - 1)
        ctx, known = _locate(o["ctx"], part >> 8)
        via = came >= 0
        up = model["orders"][k + 1] if k + 1 < len(model["orders"]) else None
        node, hit = _locate(o["key"], part)
        hit &= known
        whole, escape = o["whole"][ctx] if len(o["ctx"]) else np.zeros(len(rest)), o["escape"][ctx] if len(o["ctx"]) else np.zeros(len(rest))
        if up is not None and via.any():
            whole = np.where(via, up["left"][np.maximum(came, 0)], whole)
            escape = np.where(via, up["left_escape"][np.maximum(came, 0)], escape)
        if hit.any():
            out[rest[hit]] += o["log"][node[hit]] - whole[hit]
        left = known & ~hit
        out[rest[left]] += escape[left]
        came = np.where(known, ctx, -1)
        rest, came = rest[~hit], came[~hit]
        if not len(rest):
            return out
    out[rest] += model["unseen"]
    return out


def _sorted_nodes(k: np.ndarray, key: np.ndarray, n: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    found = []
    for i in range(ORDER + 1):
        by = np.argsort(key[k == i])
        found.append((key[k == i][by].astype(np.int64), n[k == i][by].astype(np.int64)))
    return found


def _window_scores(runs: DataFrame, asked: DataFrame) -> DataFrame:
    """key and value (log10 of the probability of the last byte) of the distinct keys of ``asked``, by the whole trie ``runs``.

    All contexts that a key meets on its way down, but for those of less than DEAL bytes, end in the same DEAL bytes. So the
    trie is dealt out by these with the keys, and each part answers for its keys as the whole one would.
    """
    spark = runs.sparkSession
    low = runs.where(F.col("k") < DEAL).toArrow()
    sent = spark.sparkContext.broadcast([low.column(c).to_numpy() for c in ("k", "key", "n")])
    last = F.shiftrightunsigned("key", 8).bitwiseAND(F.lit((1 << (8 * DEAL)) - 1)).alias("last")
    both = runs.where(F.col("k") >= DEAL).select(last, F.col("k").cast("int").alias("k"), "key", "n")
    both = both.unionByName(asked.select("key").distinct().select(last, F.lit(-1).alias("k"), "key", F.lit(0).cast("long").alias("n")))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), runs.count() // PART_NODES + 1)

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [[b.column(c).to_numpy() for c in ("k", "key", "n")] for b in batches]
        if not rows:
            return
        k, key, n = (np.concatenate([r[i] for r in rows]) for i in range(3))
        wanted = key[k < 0]
        nodes = [np.concatenate([x, y[k >= 0]]) for x, y in zip(sent.value, (k, key, n), strict=True)]
        model = trie(_sorted_nodes(*nodes)) if len(nodes[0]) else trie([])
        for at in range(0, len(wanted), PIECE):
            w = wanted[at : at + PIECE]
            yield pa.RecordBatch.from_arrays([pa.array(w), pa.array(log_probability(model, w))], ["key", "value"])

    return both.repartition(parts, "last").mapInArrow(answer, "key long, value double")


def with_scores(docs: DataFrame, training: DataFrame) -> tuple[DataFrame, int, int]:
    """Scores of ``docs`` (doc_id, text) by models of ``training`` (text); the training tokens, and how many kinds of them.

    Returned per row: doc_id, text_key, n_tokens, n_known, base_score, score. Texts are read as the words between white
    space, A-Z lowered, and one end. ``score`` is log10 of the probability of that sequence, byte by byte, words
    joined by a space, from prediction by partial matching: a trie of byte contexts up to ORDER bytes, with escapes
    and exclusion. ``base_score`` is that of single words with one added to each count.

    Counts of words and of byte runs cover all training texts: each task sums up its part, and a shuffle adds the parts.
    What is frequent goes to all executors: words with their counts, longest runs with their probabilities. The other
    words and runs of each document, each run once with its number, are joined by a shuffle with the counts and with
    the probabilities by the whole trie; none of them is frequent in training. So both scores are exact, but for words
    that share a 64-bit hash.

    Null texts count as empty: they are an end alone. Repeated rows keep their number; null ids are ids; without
    training texts every byte has 1/256; an empty table gives an empty result; other columns are ignored.
    """
    spark = docs.sparkSession
    text = F.col("text").cast("string").alias("text")
    counts = training.select(text).mapInArrow(_count, "kind byte, key long, n long").groupBy("kind", "key").agg(F.sum("n").alias("n"))
    counts = staged(counts, "lm-counts")
    words = counts.where("kind = 0").select("key", "n")
    tokens, kinds = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    runs = counts.where("kind = 1")
    masks = F.expr(f"array({', '.join(f'struct({k} as k, {(1 << (8 * (k + 1))) - 1}L as mask)' for k in range(ORDER + 1))})")
    runs = runs.withColumn("m", F.explode(masks)).groupBy(F.col("m.k").alias("k"), F.col("key").bitwiseAND(F.col("m.mask")).alias("key")).agg(F.sum("n").alias("n"))
    runs = staged(runs, "lm-runs")
    top = runs.where(F.col("k") == ORDER).select("key", "n")
    kept = top.where(F.col("n") >= _at_most(top, MOST_NODES)).select("key", F.shiftrightunsigned("key", 8).alias("ctx"), (2 * F.col("n") - 1).alias("n"))
    whole = top.groupBy(F.shiftrightunsigned("key", 8).alias("ctx")).agg((F.sum(2 * F.col("n") - 1) + F.count("*")).alias("whole"))
    kept = kept.join(whole, "ctx").select("key", (F.log10("n") - F.log10("whole")).alias("value")).toArrow()
    model = table_of(kept.column("key").to_numpy(), kept.column("value").to_numpy())
    least = _at_most(words, MOST_WORDS)
    often = words.where(F.col("n") >= least).toArrow()
    by = np.argsort(often.column("key").to_numpy())
    model["words"], model["times"] = often.column("key").to_numpy()[by], often.column("n").to_numpy()[by]
    norm = float(np.log10(tokens + kinds + 1))
    model["norm"] = norm
    sent = spark.sparkContext.broadcast(model)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for b in few_texts(batches):
            texts = [(t.as_py() or "").encode().lower().split() for t in b.column("text")]
            size = np.array([len(t) + 1 for t in texts], np.int64)
            hashes = np.fromiter((h for t in texts for part in (t, (_END,)) for h in map(xxhash.xxh64_intdigest, part, repeat(42))), np.uint64, int(size.sum())).view(np.int64)
            first = np.r_[0, np.cumsum(size)[:-1]]
            at, known = _locate(m["words"], hashes)
            times = np.where(known, m["times"][at] if len(m["times"]) else 0, 0)
            base = np.add.reduceat(np.where(known, np.log10(times + 1.0) - m["norm"], 0.0), first) if len(first) else np.zeros(0)
            n_known = np.add.reduceat(known.astype(np.int64), first) if len(first) else np.zeros(0, np.int64)
            buffer, starts = _stream(texts)
            score = np.zeros(len(texts))
            rows, runs_ = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
            for key, places in _windows(buffer):
                row, valid = _predicted(places, starts)
                row, key = row[valid], key[valid]
                value, absent = look_up(m, key)
                score += np.bincount(row, value, len(texts))
                rows.append(row[absent])
                runs_.append(key[absent])
            row, key = np.concatenate(rows), np.concatenate(runs_)
            by = np.lexsort((key, row))
            row, key = row[by], key[by]
            new = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (key[1:] != key[:-1])][: len(row)])
            times = np.diff(np.r_[new, len(row)])
            ends = np.r_[0, np.cumsum(np.bincount(row[new], minlength=len(texts)))].astype(np.int32)
            offsets = np.r_[0, np.cumsum(size - n_known)].astype(np.int32)
            rare = pa.ListArray.from_arrays(pa.array(offsets), pa.array(hashes[~known]))
            windows = (pa.ListArray.from_arrays(pa.array(ends), pa.array(x)) for x in (key[new], times))
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("text_key"), pa.array(size), pa.array(n_known), pa.array(base), pa.array(score), rare, *windows],
                ["doc_id", "text_key", "n_tokens", "often", "base", "part", "rare", "windows", "times"],
            )

    schema = f"doc_id {kind}, text_key long, n_tokens long, often long, base double, part double, rare array<long>, windows array<long>, times array<long>"
    scored = staged(docs.select("doc_id", row_key(F.col("text")).alias("text_key"), text).mapInArrow(run, schema), "lm-scores")
    asked = scored.where(F.size("rare") > 0).dropDuplicates(["doc_id", "text_key"]).select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key"), F.explode("rare").alias("key"))
    seldom = asked.join(words.where(F.col("n") < least), "key", "left").groupBy("_id", "_key").agg(
        F.count("n").alias("_known"), F.sum(F.log10(F.coalesce("n", F.lit(0)) + 1.0) - norm).alias("_base")
    )
    out = scored.drop("rare", "windows", "times").join(seldom, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_key") == F.col("_key")), "left")
    met = scored.where(F.size("windows") > 0).dropDuplicates(["doc_id", "text_key"]).select(F.col("doc_id").alias("w_id"), F.col("text_key").alias("w_key"), F.explode(F.arrays_zip("windows", "times")).alias("w"))
    met = met.select("w_id", "w_key", F.col("w.windows").alias("key"), F.col("w.times").alias("times"))
    values = staged(_window_scores(runs, met), "lm-windows")
    rest = met.join(values, "key").groupBy("w_id", "w_key").agg(F.sum(F.col("times") * F.col("value")).alias("_score"))
    out = out.join(rest, F.col("doc_id").eqNullSafe(F.col("w_id")) & (F.col("text_key") == F.col("w_key")), "left")
    out = out.select(
        "doc_id", "text_key", "n_tokens", (F.col("often") + F.coalesce("_known", F.lit(0))).alias("n_known"),
        (F.col("base") + F.coalesce("_base", F.lit(0.0))).alias("base_score"),
        (F.col("part") + F.coalesce("_score", F.lit(0.0))).alias("score"),
    )
    return out, tokens, kinds


def op3_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out, tokens, _ = with_scores(docs, docs.where(fold("doc_id", 7) != 2))
    return out.select("doc_id", (fold("doc_id", 7) == 2).alias("held_out"), "n_tokens", "n_known", F.lit(tokens).cast("long").alias("train_tokens"), "base_score", "score")
