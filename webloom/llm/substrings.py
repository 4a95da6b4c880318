"""Substring dedup by sliding spans of sentences."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webloom.llm.common import few_texts, row_key, staged, table, unstage

#: A span has so many sentences and so many words at least.
SENTENCES, WORDS = 2, 25
#: A sentence of fewer words than SHORT goes with the next one. From its word LONG on, a sentence is also cut behind every
#: word whose hash is 0 modulo CUT.
SHORT, LONG, CUT = 3, 12, 6
#: Bytes hashed at a time, so that a very long text needs no more memory; words of so many bytes are hashed alone.
PIECE, GIANT = 1 << 20, 1 << 16
_SPACE = np.isin(np.arange(256), [32, 9, 10, 11, 12, 13])
_LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint64) + np.uint64(1)
_STOP = np.isin(np.arange(256), list(b".!?"))
_CLOSE = np.isin(np.arange(256), list(b"\"')]}"))
#: Odd multipliers of the rolling hashes of bytes and of words.
_BYTES, _WORDS = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F


def _powers(odd: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The powers 0 to n - 1 of an odd number modulo 2^64, and those of its inverse."""
    out = []
    for base in (odd, pow(odd, -1, 1 << 64)):
        p = np.full(max(n, 1), base, np.uint64)
        p[0] = 1
        out.append(np.cumprod(p, dtype=np.uint64)[:n])
    return out[0], out[1]


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def _rolling(values: np.ndarray, odd: int, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the runs start:end of ``values``: equal runs have equal hashes, wherever they stand."""
    power, inverse = _powers(odd, len(values))
    upto = np.empty(len(values) + 1, np.uint64)
    upto[0] = 0
    np.cumsum(values * power, out=upto[1:])
    return _mixed((upto[end] - upto[start]) * inverse[start] + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def _word_hashes(b: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """One hash per word of the bytes ``b``, A-Z lowered; by pieces of about PIECE bytes."""
    out = np.empty(len(start), np.uint64)
    giant = end - start >= GIANT
    for i in np.flatnonzero(giant):
        out[i] = xxhash.xxh64_intdigest(b[start[i] : end[i]].tobytes().lower())
    rest = np.flatnonzero(~giant)
    s, e = start[rest], end[rest]
    at = 0
    while at < len(rest):
        to = max(at + 1, int(np.searchsorted(e, s[at] + PIECE, "right")))
        # Words beyond a giant one start anew, so that a piece holds no giant.
        far = np.flatnonzero(s[at + 1 : to] - e[at : to - 1] >= GIANT)
        to = at + 1 + int(far[0]) if len(far) else to
        low = s[at]
        out[rest[at:to]] = _rolling(_LOWER[b[low : e[to - 1]]], _BYTES, s[at:to] - low, e[at:to] - low)
        at = to
    return out


def sentences(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The sentences of a text in UTF-8: for each its first byte, for each its first word, and the words' hashes.

    They cover the text: a sentence goes up to the first byte of the next one, and the first one begins at byte 0.
    A sentence ends behind a word that ends with . ! or ? (closing quotes and brackets may follow) and behind a line.
    One of a few words goes with the next. From its word LONG on a sentence is also cut behind words that their hash picks,
    so two copies of a passage are cut alike whatever is around them, from LONG words into it at the latest.
    """
    b = np.frombuffer(raw, np.uint8)
    edges = np.flatnonzero(np.diff(np.r_[True, _SPACE[b], True]))
    start, end = edges[::2], edges[1::2]
    n = len(start)
    if not n:
        return np.zeros(min(1, len(raw)), np.int64), np.zeros(min(1, len(raw)), np.int64), np.empty(0, np.uint64)
    hashes = _word_hashes(b, start, end)
    last = b[end - 1]
    stop = _STOP[last] | (_CLOSE[last] & (end - start > 1) & _STOP[b[np.maximum(end - 2, 0)]])
    lines = np.flatnonzero(b == 10)
    stop |= np.searchsorted(lines, end) < np.searchsorted(lines, np.r_[start[1:], len(b)])
    place = np.flatnonzero(stop)
    stop[place[np.diff(np.r_[-1, place]) < SHORT]] = False
    stop[-1] = True
    place = np.arange(n)
    begins = np.maximum.accumulate(np.where(np.r_[True, stop[:-1]], place, 0))
    cut = stop | ((place - begins >= LONG - 1) & (hashes % np.uint64(CUT) == 0))
    word = np.r_[0, np.flatnonzero(cut[:-1]) + 1]
    at = start[word].copy()
    at[0] = 0
    return at, word, hashes


def spans(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of every span its first sentence, number of sentences, and hash. The case of A-Z and white space do not count.

    From each sentence on the shortest run that is long enough is a span, and so is the shortest one up to each sentence.
    """
    _, word, hashes = sentences(raw)
    k = len(word)
    upto = np.r_[word, len(hashes)]
    place = np.arange(k)
    end = np.maximum(place + SENTENCES, np.searchsorted(upto, upto[:-1] + WORDS))
    first = np.minimum(place + 1 - SENTENCES, np.searchsorted(upto, upto[1:] - WORDS, "right") - 1)
    ahead, back = end <= k, first >= 0
    both = np.unique(np.r_[place[ahead] * (k + 1) + end[ahead], first[back] * (k + 1) + place[back] + 1])
    first, end = both // (k + 1), both % (k + 1)
    if not len(first):
        return first, end, np.empty(0, np.int64)
    return first, end - first, _rolling(hashes, _WORDS, upto[first], upto[end]).view(np.int64)


def strip(raw: bytes, marks: list[dict]) -> tuple[bytes, int, list[tuple[int, int]], list]:
    """The text without the marked spans; how many sentences went; which (first, end); ids with the first copies."""
    at = np.r_[sentences(raw)[0], len(raw)]
    first: dict[int, int] = {}
    for m in marks:
        if m["own"]:
            first[m["hash"]] = min(first.get(m["hash"], m["at"]), m["at"])
    gone = np.zeros(len(at) - 1, bool)
    ids = set()
    for m in marks:
        if not m["own"] or m["at"] != first[m["hash"]]:
            gone[m["at"] : m["at"] + m["n"]] = True
            ids.add(m["first"])
    edges = np.flatnonzero(np.diff(np.r_[0, gone.astype(np.int8), 0]))
    runs = [(int(a), int(z)) for a, z in edges.reshape(-1, 2)]
    bounds = [0, *(int(at[x]) for run in runs for x in run), len(raw)]
    kept = b"".join(raw[a:z] for a, z in zip(bounds[::2], bounds[1::2], strict=True))
    return kept, int(gone.sum()), runs, sorted(i for i in ids if i is not None)


def dedup(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text) as doc_id, text (what is kept), n_removed (sentences), removed (their runs, first:end), kept_in (ids).

    Runs of consecutive sentences are hashed, and hashes are grouped over all documents. The first copy of a
    repeated span is that with the least doc_id, then the least place in it; all sentences that another copy covers
    are removed, and nothing else. ``kept_in`` lists the documents that hold the first copies. Hashes are counted before
    the shuffle, so a span that stands in a third of all rows is one row per task; only the occurrences of repeated hashes
    are joined, and a document gathers no more rows than it has spans, two for each sentence at most.

    Null texts stay null and empty ones empty; texts without a span stay whole. Rows equal in doc_id and text are one
    document, come back as often as they came, and lose nothing to each other; rows that share an id keep a first copy
    each; null ids come last. Columns other than doc_id and text are left out; an empty table gives an empty result.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    keyed = docs.select("doc_id", row_key(F.col("text")).alias("text_key"), F.col("text").cast("string").alias("text"))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in few_texts(batches):
            found = [spans((t.as_py() or "").encode()) for t in b.column("text")]
            at, n, h = (np.concatenate([np.empty(0, np.int64), *[f[k] for f in found]]) for k in range(3))
            take = pa.array(np.repeat(np.arange(len(found)), [len(f[0]) for f in found]))
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id").take(take), b.column("text_key").take(take), pa.array(at.astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(h)],
                ["doc_id", "text_key", "at", "n", "hash"],
            )

    every = staged(keyed.mapInArrow(emit, f"doc_id {kind}, text_key long, at int, n int, hash long"), "spans")
    repeated = staged(every.groupBy("hash").agg(F.count("*").alias("times"), F.min("doc_id").alias("first")).where("times > 1").drop("times"), "repeated")
    found = every.join(repeated, "hash").select("doc_id", "text_key", F.struct("at", "n", "hash", "first", F.col("doc_id").eqNullSafe(F.col("first")).alias("own")).alias("m"))
    marks = found.groupBy("doc_id", "text_key").agg(F.collect_list("m").alias("marks"), F.count("*").alias("all"), F.countDistinct(F.when(F.col("m.own"), F.col("m.hash"))).alias("firsts"))
    marks = marks.where(F.col("all") > F.col("firsts")).select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key"), "marks")
    marks = staged(marks, "marks")
    unstage(every, repeated)
    joined = keyed.join(marks, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_key") == F.col("_key")), "left")

    @F.arrow_udf(f"text string, n_removed int, removed string, kept_in array<{kind}>")
    def stripped(text: pa.Array, marks: pa.Array) -> pa.Array:
        out = []
        for t, m in zip(text, marks, strict=True):
            if not m.is_valid:
                out.append((None, None, None, None))
                continue
            kept, n, runs, ids = strip(t.as_py().encode(), m.as_py())
            out.append((kept.decode(), n, ",".join(f"{x}:{y}" for x, y in runs), ids))
        ids_type = marks.type.value_type.field("first").type
        columns = [pa.array([o[k] for o in out], of) for k, of in enumerate((pa.string(), pa.int32(), pa.string(), pa.list_(ids_type)))]
        return pa.StructArray.from_arrays(columns, ["text", "n_removed", "removed", "kept_in"])

    # Only texts that lose something go to Python.
    out = joined.select("doc_id", "text", stripped(F.when(F.col("marks").isNotNull(), F.col("text")), F.col("marks")).alias("s"))
    none = F.expr(f"cast(array() as array<{kind}>)")
    return out.select(
        "doc_id", F.coalesce("s.text", "text").alias("text"), F.coalesce("s.n_removed", F.lit(0)).alias("n_removed"),
        F.coalesce("s.removed", F.lit("")).alias("removed"), F.coalesce("s.kept_in", none).alias("kept_in"),
    )


def op2_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(table(spark, sf_dir, "documents"))
