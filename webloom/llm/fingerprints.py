"""Document fingerprints: one-permutation MinHash with optimal densification and packed low-order bits."""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from webloom.llm.common import GAP, free_names, staged, table

#: Bins, bits kept of each, words of a shingle.
BINS, BITS, WIDTH = 128, 4, 5
#: Probes of a densified bin that are tried one by one; those that find nothing look at all bins.
PROBES = 16
#: Documents of a block of neighbouring ids, about, until there are so many blocks; then blocks grow.
BLOCK_DOCS, MOST_BLOCKS = 64, 1 << 13
#: Ids from which the bounds of blocks are taken, about; they only place rows in blocks.
IDS = 1 << 20


def shingle_hashes(text: Column, width: int = WIDTH) -> Column:
    """Hashes of all runs of ``width`` words; of the whole text, if it has fewer. The lowest bit is clear."""
    words = F.filter(F.split(F.coalesce(text, F.lit("")), GAP, -1), lambda w: w != "")
    heads = F.transform(words, lambda w: F.xxhash64(w))
    # The array of word hashes is the one argument of each step, so that it is made once.
    one = F.array(F.struct(heads.alias("h")))

    def runs(x: Column) -> Column:
        h = x["h"]
        return F.when(
            F.size(h) >= width,
            F.transform(F.sequence(F.lit(1), F.size(h) - (width - 1)), lambda i: F.xxhash64(*[F.element_at(h, i + j) for j in range(width)])),
        ).otherwise(F.array(F.xxhash64(F.concat_ws(",", F.transform(h, lambda v: v.cast("string"))))))

    return F.transform(F.flatten(F.transform(one, runs)), lambda h: h.bitwiseAND(F.lit(-2)))


def _probes(bins: int, seed: int = 42) -> list[list[int]]:
    """For each bin, all other bins in a fixed pseudo-random order: the hash functions of the densification."""
    rng, table_ = random.Random(seed), []
    for i in range(bins):
        row = [j for j in range(bins) if j != i]
        rng.shuffle(row)
        table_.append(row)
    return table_


def fingerprint(df: DataFrame, text: Column, to: str, *, bins: int = BINS, bits: int = BITS, width: int = WIDTH) -> DataFrame:
    """``df`` with the column ``to``: an array of the ``bits`` low-order bits of each bin.

    A hash falls in the bin of its high-order bits, and the least hash of a bin is kept. One odd number per bin,
    above all hashes of it (they are even), marks its end: after sorting hashes and marks together, the first of
    each bin is its minimum, or its mark if the bin is empty. Empty bins copy the minimum of the first filled bin in
    their own probe order. Texts without words have one fixed hash, so they have equal fingerprints.
    """
    if not 1 <= bits <= 7 or bins & (bins - 1):
        raise ValueError("bins is a power of two, and bits is from 1 to 7")
    shift = 64 - (bins.bit_length() - 1)
    marks = [((b - bins // 2) << shift) + (1 << shift) - 1 for b in range(bins)]
    marks_ = F.expr(f"array({', '.join(f'{m}L' for m in marks)})")
    firsts = F.transform(
        F.array(F.struct(F.sort_array(F.concat(shingle_hashes(text, width), marks_)).alias("a"))),
        lambda x: F.filter(x["a"], lambda v, i: (i == 0) | (F.shiftright(v, shift) != F.shiftright(F.element_at(x["a"], F.greatest(i, F.lit(1))), shift))),
    )
    order = F.expr(f"array({', '.join(f'array({", ".join(map(str, row[:PROBES]))})' for row in _probes(bins))})")

    def filled(v: Column) -> Column:
        return v.bitwiseAND(F.lit(1)) == 0

    def dense(x: Column) -> Column:
        def one(v: Column, i: Column) -> Column:
            tries = [F.element_at(x, F.element_at(F.element_at(order, i + 1), k + 1) + 1) for k in range(PROBES)]
            # None of the first probes is filled: the filled bin that is least by a hash of the pair.
            last = F.array_min(F.transform(F.filter(x, filled), lambda u: F.struct(F.xxhash64(i, u).alias("h"), u.alias("u"))))["u"]
            return F.when(filled(v), v).otherwise(F.coalesce(*[F.when(filled(t), t) for t in tries], last))

        # The bits above the lowest (which is always clear), below those that name the bin.
        return F.transform(x, lambda v, i: F.shiftright(one(v, i), 1).bitwiseAND(F.lit((1 << bits) - 1)).cast("tinyint"))

    return df.withColumn(to, F.flatten(F.transform(firsts, dense)))


def digits(fp: Column) -> Column:
    """A fingerprint as text: one hexadecimal digit for each bin."""
    return F.array_join(F.transform(fp, lambda v: F.substring(F.lit("0123456789abcdef"), v.cast("int") + 1, F.lit(1))), "")


def likeness(a: Column, b: Column, *, bits: int = BITS) -> Column:
    """Jaccard similarity that two fingerprints stand for: agreeing bins, less those that agree by chance."""
    same = F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda same: same))
    chance = 2.0**-bits
    return F.when(a == b, F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), (same / F.size(a) - chance) / (1 - chance)))


def _rank(kind: str, doc_id: Column) -> Column:
    """A double that does not fall from one id to the next: the number itself, or what the first six bytes of a string are."""
    if kind == "string":
        return F.conv(F.hex(F.rpad(F.substring(doc_id.cast("binary"), 1, 6), 6, F.lit(b"\0"))), 16, 10).cast("double")
    if kind in ("date", "timestamp"):
        return F.unix_timestamp(doc_id.cast("timestamp")).cast("double")
    return doc_id.cast("double")


def with_next(docs: DataFrame, carried: list[str], ties: list[str] | None = None) -> DataFrame:
    """``docs`` with next_<column> for each of ``carried``: the values of the row that follows by ascending doc_id.

    The last row is followed by the first; null ids come last; rows of one id, or of none, follow by a hash of
    ``ties`` (of what is carried, unless given). Ids are dealt to blocks by their quantiles (numbers, dates and strings alike, however far apart),
    null ids by that hash, and the first row of each block is also sent to the block before it, so blocks are sorted
    apart and each text is shuffled once. Only one row per block, of which there are at most ``MOST_BLOCKS``, is ever in
    one place. Columns of ``docs`` keep their names and values, but for columns that are called next_<column> already:
    these are replaced. An empty table gives an empty result.
    """
    docs = docs.drop(*[f"next_{c}" for c in carried])
    kind = docs.schema["doc_id"].dataType.simpleString()
    block, tie, head, extra = free_names(docs, "block", "tie", "head", "extra")
    rank = _rank(kind, F.col("doc_id"))
    rows, lost = docs.agg(F.count("*"), F.sum(F.col("doc_id").isNull().cast("long"))).first()
    if not rows:
        return docs.withColumns({f"next_{c}": F.lit(None).cast(docs.schema[c].dataType) for c in carried})
    cuts = max(0, min(MOST_BLOCKS, (rows - lost) // BLOCK_DOCS) - 1)
    bounds: list[float] = []
    if cuts:
        shares = F.expr(f"array({', '.join(f'{i / (cuts + 1)!r}D' for i in range(1, cuts + 1))})")
        some = docs.where(F.shiftrightunsigned(F.xxhash64("doc_id"), 34) < min(1.0, IDS / rows) * (1 << 30))
        bounds = some.agg(F.percentile_approx(rank, shares, 4 * (cuts + 1))).first()[0] or []
    sorted_ = F.expr(f"array({', '.join(f'{b!r}D' for b in bounds)})") if bounds else None
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(len(bounds).bit_length()))])

    def further(low: Column, step: Column) -> Column:
        return F.when(F.when(low + step <= len(bounds), F.element_at(sorted_, low + step) <= rank), low + step).otherwise(low)

    named = F.aggregate(steps, F.lit(0), further) if bounds else F.lit(0)
    unnamed = min(MOST_BLOCKS, lost // BLOCK_DOCS) + 1
    keyed = docs.withColumn(tie, F.xxhash64(*(ties or carried)))
    keyed = keyed.withColumn(block, F.when(F.col("doc_id").isNotNull(), named).otherwise((F.shiftrightunsigned(F.col(tie).bitwiseXOR(F.lit(-(1 << 63))), 40) * unnamed / (1 << 24)).cast("int") + len(bounds) + 1))
    used = Window.orderBy("b_")
    heads = keyed.groupBy(F.col(block).alias("b_")).agg(F.min(F.struct(F.col("doc_id").alias("id"), F.col(tie).alias("tie"))).alias("h"))
    heads = heads.withColumn("to", F.lag("b_").over(used)).withColumn("last", F.max("b_").over(Window.partitionBy()))
    heads = heads.select("b_", F.struct("h.id", "h.tie", F.coalesce("to", "last").alias("to")).alias(head))
    kept = keyed.join(F.broadcast(staged(heads, "blocks")), F.col(block) == F.col("b_"), "left")
    # A row is sent to its own block, and if it is the least of it, as a stand-in to the block before.
    is_head = F.col("doc_id").eqNullSafe(F.col(f"{head}.id")) & (F.col(tie) == F.col(f"{head}.tie"))
    own = F.struct(F.col(block).alias("b"), F.lit(0).alias("x"))
    places = F.when(is_head, F.array(own, F.struct(F.col(f"{head}.to").alias("b"), F.lit(1).alias("x")))).otherwise(F.array(own))
    sent = kept.withColumn(extra, F.explode(places)).withColumn(block, F.col(f"{extra}.b")).withColumn(extra, F.col(f"{extra}.x"))
    along = Window.partitionBy(block).orderBy(extra, F.col("doc_id").asc_nulls_last(), tie)
    out = sent.withColumns({f"next_{c}": F.lead(c).over(along) for c in carried})
    return out.where(F.col(extra) == 0).select(*[F.col(f"`{c}`") for c in docs.columns], *[f"next_{c}" for c in carried])


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    docs = with_next(fingerprint(docs, F.col("text"), "fingerprint"), ["text", "fingerprint"], ["text"])
    n = F.length("text")
    tail = F.floor(n / 4).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - tail), F.substring(F.col("next_text"), F.lit(1), tail))
    docs = docs.select("doc_id", n.cast("long").alias("n_chars"), edited.alias("edited"), "fingerprint", "next_fingerprint")
    docs = fingerprint(docs, F.col("edited"), "edited_fingerprint")
    return docs.select(
        "doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        digits(F.col("fingerprint")).alias("fingerprint"), digits(F.col("edited_fingerprint")).alias("edited_fingerprint"),
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"),
    )
