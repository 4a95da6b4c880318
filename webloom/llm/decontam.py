"""Benchmark decontamination by spaced-seed hashing."""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webloom.llm.common import few_texts, free_names, row_key, staged, table

#: An overlap counts if in some stretch of so many words (or the whole item, if shorter) this share agrees.
STRETCH, AGREE = 13, 0.8
#: Bits of the filter of the benchmark's hashes that goes to the executors: 16 a hash, from 2^15 (one block) to so many.
MOST_BITS = 1 << 27
_BLOCK = 1 << 15
_WORDS = re.compile(r"\w+")


def masks(size: int) -> list[tuple[int, str]]:
    """(first word, mask) for stretches of ``size`` words: whatever words are substituted in an overlap, one mask misses them all.

    With k substitutions allowed, a stretch is cut into parts, and a mask looks at all but k of them and ignores the
    others: three parts for one substitution, four for two. Masks that lie in others, shifted, are left out.
    """
    free = size - int(np.ceil(AGREE * size - 1e-9))
    parts = np.array_split(np.arange(size), {0: 1, 1: min(3, size)}.get(free, free + 2))
    found: set[tuple[int, str]] = set()
    for gone in combinations(range(len(parts)), free):
        at = np.concatenate([p for i, p in enumerate(parts) if i not in gone])
        mask = np.zeros(size, int)
        mask[at] = 1
        found.add((int(at[0]), "".join(map(str, mask[at[0] : at[-1] + 1]))))
    if size < STRETCH:
        return sorted(found)
    every = {m: at for at, m in sorted(found)}
    within = lambda a, b: any(all(b[i + s] == "1" for i, c in enumerate(a) if c == "1") for s in range(len(b) - len(a) + 1))
    return [(at, m) for m, at in every.items() if not any(o != m and within(o, m) for o in every)]


def windows(words: np.ndarray, mask: str) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the windows that a mask looks at; of runs of windows that repeat every one to four words, their ends."""
    n = len(words) - len(mask) + 1
    if n <= 0:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    rng = np.random.default_rng(xxhash.xxh32_intdigest(mask))
    h = np.zeros(n, np.uint64)
    for p, c in enumerate(mask):
        odd = rng.integers(1, 1 << 62, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        if c == "1":
            h += words[p : p + n] * odd
    h ^= h >> np.uint64(32)
    h *= np.uint64(0x9E3779B97F4A7C15)
    inner = np.zeros(n, bool)
    for every in range(1, 5):
        same = h[every:] == h[:-every]
        inner[every:-every] |= same[:-every] & same[every:]
    at = np.flatnonzero(~inner)
    return at, h[at].view(np.int64)


def word_hashes(text: str) -> np.ndarray:
    found = _WORDS.findall(text.lower())
    return np.fromiter(map(xxhash.xxh64_intdigest, found, repeat(7)), np.uint64, len(found))


def overlap(doc: np.ndarray, item: np.ndarray, shifts: list[int]) -> tuple[int, int, int] | None:
    """(agreeing words, minus the first word, word after the last) of the best overlap; ``shifts`` say where the item may lie."""
    best = None
    size = min(STRETCH, len(item))
    for shift in sorted(shifts):
        a, b = max(0, -shift), min(len(item), len(doc) - shift)
        same = doc[a + shift : b + shift] == item[a:b]
        if len(same) < size:
            continue
        total = np.r_[0, np.cumsum(same)]
        good = np.flatnonzero(total[size:] - total[:-size] >= AGREE * size - 1e-9)
        if len(good):
            first, last = int(good[0]), int(good[-1]) + size
            one = (int(total[last] - total[first]), -(a + shift + first), a + shift + last)
            best = one if best is None else max(best, one)
    return best


def _items(benchmark: DataFrame) -> DataFrame:
    """item_id, item_key, words (their hashes) and seeds (offset, hash) of the distinct items that have a word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in few_texts(batches):
            words = [word_hashes(t.as_py()) for t in b.column("text")]
            seeds = []
            for w in words:
                made = [(at, h) for first, m in masks(min(len(w), STRETCH)) for at, h in [windows(w, m)] for keep in [at == first if len(w) < STRETCH else at >= 0] for at, h in [(at[keep], h[keep])]] if len(w) else []
                seeds.append([{"offset": int(o), "hash": int(x)} for at, h in made for o, x in zip(at, h, strict=True)])
            kept = pa.array([bool(len(w)) for w in words])
            out = [b.column("item_id"), b.column("item_key"), pa.array([w.view(np.int64) for w in words], pa.list_(pa.int64())), pa.array(seeds, pa.list_(pa.struct({"offset": pa.int32(), "hash": pa.int64()})))]
            yield pa.RecordBatch.from_arrays(out, ["item_id", "item_key", "words", "seeds"]).filter(kept)

    kind = benchmark.schema["item_id"].dataType.simpleString()
    rows = benchmark.where("text is not null").select("item_id", row_key(F.col("text")).alias("item_key"), F.col("text").cast("string").alias("text")).dropDuplicates(["item_id", "item_key"])
    return rows.mapInArrow(run, f"item_id {kind}, item_key long, words array<long>, seeds array<struct<offset: int, hash: long>>")


def overlaps(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Pairs of a document and a benchmark item that overlap: doc_id, text_key, item_id, first_word, end_word, agreeing.

    Fixed masks pick words out of windows of documents and items, and ignore the others: these may be substituted. The
    windows' hashes are joined. Around each hit the words of the item are laid along those of the document, and the
    overlap is reported if in some 13 words in a row (the whole item if it is shorter) 80 % agree; first_word and
    end_word bound all such stretches. Of 13 words in a row two may differ, and the masks are such that one of them
    misses any two; shorter items have masks of their own. So no overlap is passed over, but for those that lie in
    runs of one to four words over and over: of these the ends are laid along each other. Words are lower-cased runs of
    letters, digits and underscores, and count by their hashes.

    Hashes of documents that no item has are sorted out before the shuffle, by a bit set of bounded size; the larger the
    benchmark, the more others pass it, which the join then drops. Only documents with a hit are looked at again.

    Null and empty texts, and null or wordless items, overlap with nothing; repeated rows of documents give repeated
    results, repeated items count once; ids may be of any type, and null ids are returned as null; empty tables give an
    empty result; other columns are ignored.
    """
    spark = docs.sparkSession
    doc, item = (df.schema[c].dataType.simpleString() for df, c in ((docs, "doc_id"), (benchmark, "item_id")))
    keyed = docs.select("doc_id", row_key(F.col("text")).alias("text_key"), F.col("text").cast("string").alias("text"))
    items = staged(_items(benchmark), "decontam-items")
    short = [r[0] for r in items.select(F.size("words").alias("n")).where(F.col("n") < STRETCH).distinct().collect()]
    looked = sorted({m for n in {*short, STRETCH} for _, m in masks(n)})
    seeds = items.select("item_id", "item_key", F.explode("seeds").alias("s")).select("item_id", "item_key", "s.offset", "s.hash")
    n = seeds.count()
    bits = min(MOST_BITS, max(_BLOCK, 1 << (16 * n).bit_length()))
    # The filter: bit (hash modulo bits) is set if an item has such a hash. Blocks of 4 KB are put together on the executors.
    slot = F.col("hash").bitwiseAND(F.lit(bits - 1))
    blocks = seeds.groupBy(F.floor(slot / _BLOCK).alias("block")).agg(F.bitmap_construct_agg(slot % _BLOCK).alias("bitmap")).collect()
    filled = np.zeros(bits // 8, np.uint8)
    for r in blocks:
        filled[r.block * _BLOCK // 8 : (r.block + 1) * _BLOCK // 8] = np.frombuffer(bytes(r.bitmap), np.uint8)
    sent = spark.sparkContext.broadcast(filled)

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = sent.value
        for b in few_texts(batches):
            row, at, hashes = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0, np.int64)]
            for i, t in enumerate(b.column("text")):
                words = word_hashes(t.as_py() or "")
                for m in looked:
                    where, h = windows(words, m)
                    s = h & (bits - 1)
                    hit = np.flatnonzero(bitmap[s >> 3] >> (s & 7).astype(np.uint8) & 1)
                    row.append(np.full(len(hit), i)), at.append(where[hit]), hashes.append(h[hit])
            take = pa.array(np.concatenate(row))
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id").take(take), b.column("text_key").take(take), pa.array(np.concatenate(at)), pa.array(np.concatenate(hashes))], ["doc_id", "text_key", "at", "hash"]
            )

    hits = keyed.mapInArrow(probe, f"doc_id {doc}, text_key long, at long, hash long")
    lines = hits.join(seeds, "hash").select("doc_id", "text_key", "item_id", "item_key", (F.col("at") - F.col("offset")).alias("shift")).distinct()
    lines = lines.groupBy("doc_id", "text_key", "item_id", "item_key").agg(F.collect_list("shift").alias("shifts"))
    words = items.select(F.col("item_id").alias("_item"), F.col("item_key").alias("_item_key"), "words")
    lines = lines.join(words, F.col("item_id").eqNullSafe(F.col("_item")) & (F.col("item_key") == F.col("_item_key")))
    per = lines.groupBy(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key")).agg(F.collect_list(F.struct("item_id", "words", "shifts")).alias("found"))
    per = staged(per, "decontam-hits")
    tried = keyed.join(per, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_key") == F.col("_key"))).select("doc_id", "text_key", "text", "found")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in few_texts(batches):
            row, place, best = [], [], []
            found = b.column("found")
            ids = found.flatten().field("item_id") if len(b) else found.flatten()
            k = 0
            for i, (t, them) in enumerate(zip(b.column("text"), found, strict=True)):
                words = word_hashes(t.as_py()).view(np.int64)
                for x in them:
                    got = overlap(words, np.array(x["words"].as_py(), np.int64), x["shifts"].as_py())
                    if got:
                        row.append(i), place.append(k), best.append(got)
                    k += 1
            take = pa.array(row, pa.int64())
            numbers = [pa.array([y[0] if j == 2 else -y[1] if j == 0 else y[2] for y in best], pa.int64()) for j in range(3)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id").take(take), b.column("text_key").take(take), ids.take(pa.array(place, pa.int64())), *numbers], ["doc_id", "text_key", "item_id", "first_word", "end_word", "agreeing"])

    return tried.mapInArrow(verify, f"doc_id {doc}, text_key long, item_id {item}, first_word long, end_word long, agreeing long")


def without_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that overlap with no item of ``benchmark``, with all their columns; null and empty texts stay."""
    own_id, own_key = free_names(docs, "_id", "_key")
    found = overlaps(docs.select("doc_id", "text"), benchmark).select(F.col("doc_id").alias(own_id), F.col("text_key").alias(own_key)).distinct()
    return docs.join(found, F.col("doc_id").eqNullSafe(F.col(own_id)) & (row_key(F.col("text")) == F.col(own_key)), "left_anti")


def op6_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("text_key")
