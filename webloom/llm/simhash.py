"""SimHash near-dedup by meet-in-the-middle ball hashing."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from webloom.llm.common import few_texts, row_key, staged, table

#: Fingerprints with at most so many differing bits are linked. The balls below are those of this radius.
RADIUS = 3
#: Colliding fingerprints of one variant are compared pair by pair up to so many; more are linked through whole balls.
FEW = 64
#: Shingles hashed at a time, so that a very long text needs no more memory.
PIECE = 1 << 16
#: For near copies beyond the fingerprints' radius: words of a shingle, least Jaccard similarity of the sets of shingles, and
#: BANDS times ROWS least hashes. A pair of similarity s shares a band with probability 1 - (1 - s ** ROWS) ** BANDS: 0.998 at 0.8.
WIDE, ALIKE = 5, 0.8
BANDS, ROWS = 20, 6
#: In a band, each of the first NEAREST members is paired with all before it; those after with the first and with LATEST (fewer) before.
#: What that leaves open in a band of more members is settled by rare shingles, exactly.
NEAREST, LATEST = 16, 3
#: Cells in which shingles are counted, to put rare ones first.
CELLS = 1 << 18
#: Pairs of one shingle looked at in one go.
SLICE = 1 << 20


def simhash(raw: bytes, width: int = 3) -> int:
    """The fingerprint of a text in UTF-8: bit by bit the majority of its shingles' XXH64 (seed 42), repeats counted."""
    words = raw.lower().split()  # of bytes: A-Z alone are lowered, and white space is that of the contract
    if not words:
        return 0
    ahead = min(width, len(words))
    runs = map(b" ".join, zip(*(words[i:] for i in range(ahead))))
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, runs, repeat(42)), np.uint64)
    votes = sum(np.unpackbits(hashes[i : i + PIECE].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64) for i in range(0, len(hashes), PIECE))
    return int(np.packbits(votes * 2 > len(hashes), bitorder="little").view("<u8")[0])


def with_simhash(docs: DataFrame, width: int = 3) -> DataFrame:
    """doc_id, text_key and fingerprint (the 64 bits as a long) of every row of ``docs``; a null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in few_texts(batches):
            prints = np.array([simhash((t.as_py() or "").encode(), width) for t in b.column("text")], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("text_key"), pa.array(prints.view(np.int64))], ["doc_id", "text_key", "fingerprint"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", row_key(F.col("text")).alias("text_key"), F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, text_key long, fingerprint long")


def _collide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From (key, fp) sorted by key: verified pairs of keys with up to FEW fingerprints; fingerprints of the others.

    The rows of a key that is not over yet are carried along, FEW of them at most.
    """
    key, fp, over = np.empty(0, np.int64), np.empty(0, np.int64), None

    def out(a: np.ndarray, b: np.ndarray, many: bool) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(np.full(len(a), many))], ["a", "b", "many"])

    def pairs(key: np.ndarray, fp: np.ndarray) -> Iterator[pa.RecordBatch]:
        start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        size = np.diff(np.r_[start, len(key)])
        large = np.repeat(size > FEW, size)
        if large.any():
            yield out(fp[large], fp[large], True)
        key, fp = key[~large & np.repeat(size > 1, size)], fp[~large & np.repeat(size > 1, size)]
        for ahead in range(1, FEW):
            if not (same := key[ahead:] == key[:-ahead]).any():
                break
            a, b = fp[:-ahead][same], fp[ahead:][same]
            near = np.bitwise_count((a ^ b).view(np.uint64)) <= RADIUS
            if near.any():
                yield out(a[near], b[near], False)

    for batch in batches:
        k, f = batch.column("key").to_numpy(), batch.column("fp").to_numpy()
        if not len(k):
            continue
        if over is not None:  # a key with too many rows goes on
            rest = k == over
            if rest.any():
                yield out(f[rest], f[rest], True)
                k, f = k[~rest], f[~rest]
            if not len(k):
                continue
            over = None
        key, fp = np.concatenate([key, k]), np.concatenate([fp, f])
        last = np.searchsorted(key, key[-1])
        if last:
            yield from pairs(key[:last], fp[:last])
            key, fp = key[last:], fp[last:]
        if len(key) > FEW:
            yield out(fp, fp, True)
            over, key, fp = key[-1], key[:0], fp[:0]
    if len(key):
        yield from pairs(key, fp)


def links(prints: DataFrame) -> DataFrame:
    """Links (a, b) that join all of the distinct ``prints`` (column fp) within RADIUS bits of each other.

    The ball of radius three is met in the middle: two fingerprints that differ in three bits differ in at most one
    on one of their 32-bit halves. Every fingerprint emits, for each half, all variants within half the radius, which
    is one bit; halves one bit apart differ in parity, so it is enough that those of even parity emit more than
    themselves. Variants are shuffled, and colliding fingerprints are compared whole.

    A variant on which many fingerprints collide (thousands of near copies, each a little different) is not paired
    up. Its fingerprints emit whole balls: those of odd parity their radius 1, those of even parity their radius 2,
    all of 64 bits. Any two that are linked share such a variant; any two within radius 1 of a variant, and any in
    radius 1 with any in radius 2, are within three bits. So the members of a variant are linked to the least one in
    its radius 1, unseen, and the rows grow with the fingerprints and not with their pairs. No pair is lost either way.
    """
    spark = prints.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = []
    for half, part in enumerate((F.shiftrightunsigned("fp", 32), F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF)))):
        ones = F.expr(f"array({', '.join(f'{1 << i}L' for i in range(32))})")
        own = part + F.lit(half << 32)
        flips = F.transform(ones, own.bitwiseXOR)
        keys.append(F.when(F.bit_count(part) % 2 == 0, F.concat(F.array(own), flips)).otherwise(F.array(own)))
    variants = prints.select("fp", F.explode(F.concat(*keys)).alias("key")).select("key", "fp")
    met = staged(variants.repartition(n, "key").sortWithinPartitions("key").mapInArrow(_collide, "a long, b long, many boolean"), "simhash-met")
    few = met.where("not many").select("a", "b")
    many = met.where("many").select(F.col("a").alias("fp")).distinct()
    one = [1 << i for i in range(64)]
    two = [x | y for x, y in combinations(one, 2)]
    signed = lambda xs: F.expr("array(" + ", ".join(f"{x - (1 << 64) if x >> 63 else x}L".replace("-9223372036854775808L", "(-9223372036854775807L - 1L)") for x in xs) + ")")
    odd = F.bit_count("fp") % 2 == 1

    def ball(masks: list[int], inner: bool):
        return F.transform(signed(masks), lambda m: F.struct(F.col("fp").bitwiseXOR(m).alias("v"), F.lit(inner).alias("inner")))

    balls = F.when(odd, ball([0, *one], True)).otherwise(F.concat(ball(one, True), ball(two, False)))
    at = many.repartition(n, "fp").select("fp", F.explode(balls).alias("x")).select("fp", "x.v", "x.inner")
    least = F.min(F.when(F.col("inner"), F.col("fp"))).over(Window.partitionBy("v"))
    through = at.withColumn("b", least).where("b is not null and b <> fp").select(F.col("fp").alias("a"), "b")
    return few.unionByName(through).distinct()


def components(edges: DataFrame) -> DataFrame:
    """node and root of all nodes of ``edges`` (a, b): nodes of a component, and no others, have the same root.

    In each round every node is merged into the least of its neighbours (or stays, if it is least), by an order that
    is drawn anew each time, so that chains shrink by a part too; then edges are renamed, and loops and repeats go. The
    rounds are written down and put together from the last one back. Everything is a shuffled table.
    """
    rounds: list[DataFrame] = []
    edges = staged(edges, "edges")
    while not edges.isEmpty():
        order = lambda c, seed=len(rounds): F.struct(F.xxhash64(c, F.lit(seed)).alias("h"), F.col(c).alias("id"))
        both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        into = both.groupBy("a").agg(F.min(order("b")).alias("m")).select(F.col("a").alias("node"), F.least(order("a"), F.col("m"))["id"].alias("root"))
        into = staged(into, "merge")
        rounds.append(into)
        a, b = into.toDF("a", "ra"), into.toDF("b", "rb")
        edges = staged(edges.join(a, "a").join(b, "b").where("ra <> rb").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct(), "edges")
    if not rounds:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    found = rounds.pop()
    while rounds:
        later = found.toDF("root", "last")
        found = staged(rounds.pop().join(later, "root", "left").select("node", F.coalesce("last", "root").alias("root")), "merge")
    return found


def near_groups(docs: DataFrame, width: int = 3) -> DataFrame:
    """doc_id, text_key, fingerprint (16 hexadecimal digits) and component_id of every row of ``docs`` (doc_id, text).

    Fingerprints are made per row and compared once for each distinct one, so groups of exact copies of any size cost
    one row. component_id is the smallest doc_id that links reach, itself included.

    Null and empty texts have fingerprint zero and are linked like any others; ties cannot arise; repeated rows keep
    their number; a null doc_id is passed over as a component's smallest (null if a component has no other); an empty
    table gives an empty result; other columns are ignored.
    """
    made = staged(with_simhash(docs, width), "simhash")
    nodes = staged(made.groupBy(F.col("fingerprint").alias("fp")).agg(F.min("doc_id").alias("low")), "prints")
    roots = components(links(nodes.select("fp")))
    named = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    lows = named.groupBy("root").agg(F.min("low").alias("component_id"))
    ids = named.join(lows, "root").select(F.col("fp").alias("fingerprint"), "component_id")
    return made.join(ids, "fingerprint").select("doc_id", "text_key", F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"), "component_id")


def shingle_set(raw: bytes, width: int = WIDE) -> np.ndarray:
    """The distinct 64-bit hashes of a text's shingles (fewer words: of the whole sequence; none: no hash)."""
    words = raw.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    each = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    ahead = min(width, len(words))
    made = np.full(len(words) - ahead + 1, ahead, np.uint64)
    for i in range(ahead):
        made = (made ^ each[i : len(each) - ahead + 1 + i]) * np.uint64(0x9E3779B97F4A7C15)
        made ^= made >> np.uint64(29)
    return np.unique(made)


def band_keys(hashes: np.ndarray) -> np.ndarray:
    """One key for each band: a hash of the least values of the set under ROWS hash functions, and of the band's number."""
    rng = np.random.default_rng(8)
    mask, odd = (rng.integers(0, 1 << 64, BANDS * ROWS, np.uint64, endpoint=False) for _ in range(2))
    odd |= np.uint64(1)
    least = np.full(BANDS * ROWS, np.uint64((1 << 64) - 1))
    for i in range(0, len(hashes), 4096):
        np.minimum(least, ((hashes[i : i + 4096, None] ^ mask) * odd).min(0), out=least)
    return np.array([xxhash.xxh64_intdigest(row.tobytes(), i) for i, row in enumerate(least.reshape(BANDS, ROWS))], np.uint64).view(np.int64)


def with_bands(docs: DataFrame) -> DataFrame:
    """doc_id, n (distinct shingles), whole (a hash of their set) and keys (of the bands) of the rows of ``docs`` with an id and any word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in few_texts(batches):
            sets = [shingle_set(t.as_py().encode()) for t in b.column("text")]
            keys = pa.array([band_keys(s) if len(s) else [] for s in sets], pa.list_(pa.int64()))
            whole = pa.array(np.array([xxhash.xxh64_intdigest(s.tobytes()) for s in sets], np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), whole, keys], ["doc_id", "n", "whole", "keys"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text")).where("doc_id is not null and text is not null")
    return texts.mapInArrow(run, f"doc_id {kind}, n long, whole long, keys array<long>").where("n > 0")


def _alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs (a, b) whose texts have a Jaccard similarity of ALIKE or more."""
    for batch in few_texts(batches, "text_a"):
        keep = []
        for x, y in zip(batch.column("text_a"), batch.column("text_b")):
            one, two = shingle_set(x.as_py().encode()), shingle_set(y.as_py().encode())
            both = len(np.intersect1d(one, two, assume_unique=True))
            keep.append(both >= ALIKE * (len(one) + len(two) - both))
        yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _verified(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """The ``pairs`` (a, b) whose whole texts are alike. Only texts with a partner are shuffled."""
    paired = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    texts = staged(docs.where("text is not null").select("doc_id", F.col("text").cast("string").alias("text")).join(paired, "doc_id", "left_semi"), "near-texts")
    kind = docs.schema["doc_id"].dataType.simpleString()
    whole = pairs.join(texts.toDF("a", "text_a"), "a").join(texts.toDF("b", "text_b"), "b").select("a", "b", "text_a", "text_b")
    return staged(whole.mapInArrow(_alike, f"a {kind}, b {kind}"), "near-links")


def near_links(docs: DataFrame, bands: DataFrame) -> DataFrame:
    """Links (a, b) of documents of different groups that share a band and whose whole texts have a similarity of ALIKE or more.

    ``bands`` has doc_id, n, component_id and keys of one document for each distinct set of shingles.

    A band's members are ordered by a hash, in each band anew. Partners are found in one pass of windows, so rows grow
    with the members and not with their pairs: all pairs of bands with up to NEAREST members, fewer in larger bands
    (crowded_links has the rest). Groups and sizes rule out partners before they are chosen.
    """
    at = bands.select("doc_id", F.explode("keys").alias("key"), F.struct("doc_id", "n", "component_id").alias("me"))
    order = Window.partitionBy("key").orderBy(F.xxhash64("doc_id", "key"), "doc_id")
    before = F.collect_list("me").over(order.rowsBetween(1 - NEAREST, -1))
    first = F.first("me").over(order.rowsBetween(Window.unboundedPreceding, 0))
    seen = at.select("me", before.alias("before"), first.alias("first"), F.row_number().over(order).alias("place")).where("place > 1")

    def able(other):
        return (F.col("me.component_id") != other["component_id"]) & (F.least(F.col("me.n"), other["n"]) >= ALIKE * F.greatest(F.col("me.n"), other["n"]))

    mates = F.filter("before", able)
    mates = F.when(F.col("place") <= NEAREST, mates).otherwise(F.concat(F.slice(F.reverse(mates), 1, LATEST), F.filter(F.array("first"), able)))
    pairs = seen.select("me", F.explode(mates).alias("other"))
    pairs = staged(pairs.select(F.least("me.doc_id", "other.doc_id").alias("a"), F.greatest("me.doc_id", "other.doc_id").alias("b")).distinct(), "near-pairs")
    return _verified(docs, pairs)


def _cells(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(20)).astype(np.int64) & (CELLS - 1)


def _rare_first(batches: Iterator[pa.RecordBatch], counts: np.ndarray) -> Iterator[pa.RecordBatch]:
    """(shingle, n, rest, group, doc_id): of each text the shingles, rare ones first, that a partner must share one of; and how many are not before it."""
    for b in few_texts(batches):
        made, size = [], []
        for t in b.column("text"):
            hashes = shingle_set(t.as_py().encode())
            ahead = int(len(hashes) * (1 - ALIKE) + 1e-6) + 1
            made.append(hashes[np.lexsort((hashes, counts[_cells(hashes)]))][:ahead])
            size.append(len(hashes))
        long = [len(m) for m in made]
        row = np.repeat(np.arange(len(made)), long)
        n = np.repeat(np.array(size, np.int64), long)
        rest = n - np.concatenate([np.empty(0, np.int64), *map(np.arange, long)]).astype(np.int64)
        take = pa.array(row)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate([np.empty(0, np.uint64), *made]).view(np.int64)), pa.array(n), pa.array(rest), b.column("group").take(take), b.column("doc_id").take(take)],
            ["shingle", "n", "rest", "group", "doc_id"],
        )


def _sharing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows of _rare_first, sorted by shingle and n: pairs (a, b) of different groups that can still be alike, by what is not before the shingle in both."""
    reach = (1 + ALIKE) / ALIKE

    def pairs(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        rows = rows.combine_chunks()
        shingle, n, rest, group = (rows.column(c).to_numpy() for c in ("shingle", "n", "rest", "group"))
        ids = rows.column("doc_id")
        run = np.cumsum(np.r_[False, shingle[1:] != shingle[:-1]]) << 32
        most = rest * reach + 1e-6  # both sizes together are at most so much
        low = np.searchsorted(run + n, run + np.ceil(ALIKE * n - 1e-6).astype(np.int64))
        high = np.minimum(np.arange(len(n)), np.searchsorted(run + n, run + np.floor(most - n).astype(np.int64), "right"))
        wide = np.maximum(high - low, 0)
        upto = np.r_[0, np.cumsum(wide)]
        for at in range(0, int(upto[-1]), SLICE):
            k = np.arange(at, min(at + SLICE, int(upto[-1])))
            x = np.searchsorted(upto, k, "right") - 1
            y = low[x] + k - upto[x]
            good = (group[x] != group[y]) & (n[x] + n[y] <= most[y])
            if good.any():
                one, two = ids.take(pa.array(x[good])).combine_chunks(), ids.take(pa.array(y[good])).combine_chunks()
                yield pa.RecordBatch.from_arrays([one, two], ["x", "y"])

    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not len(batch):
            continue
        key = batch.column("shingle").to_numpy()
        if sum(map(len, held)) > 1 << 16 and key[-1] != held[-1].column("shingle")[-1].as_py():
            cut = int(np.searchsorted(key, key[-1]))
            yield from pairs(pa.Table.from_batches([*held, batch.slice(0, cut)]))
            held = []
            batch = batch.slice(cut)
        held.append(batch)
    if held:
        yield from pairs(pa.Table.from_batches(held))


def crowded_links(docs: DataFrame, bands: DataFrame) -> DataFrame:
    """Links (a, b) of all documents of different groups in bands of more than NEAREST members whose whole texts are alike.

    Bands whose members are all of one group by now need none. The members of the others are joined by rare shingles:
    with each set's shingles in one order, those rare among the members first, two sets alike share one that has enough
    shingles from it on, in both sets, for what they must have in common. What a large family shares comes last, and sets
    that share no more than that have too little from there on to meet, so rows grow with the members. No pair is lost.
    """
    at = bands.select("doc_id", "component_id", F.explode("keys").alias("key"))
    open_ = at.groupBy("key").agg(F.count("*").alias("size"), F.min("component_id").alias("low"), F.max("component_id").alias("high")).where(f"size > {NEAREST} and low <> high")
    members = at.join(open_.select("key"), "key", "left_semi").select("doc_id", F.xxhash64("component_id").alias("group")).distinct()
    texts = docs.where("text is not null").select("doc_id", F.col("text").cast("string").alias("text"))
    texts = staged(texts.join(members, "doc_id"), "crowded-texts")
    kind = docs.schema["doc_id"].dataType.simpleString()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros(CELLS, np.int64)
        for b in few_texts(batches):
            for t in b.column("text"):
                np.add.at(found, _cells(shingle_set(t.as_py().encode())), 1)
        some = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(found[some])], ["cell", "times"])

    cells = texts.mapInArrow(count, "cell int, times long").groupBy("cell").agg(F.sum("times").alias("times")).toArrow()
    counts = np.zeros(CELLS, np.int64)
    counts[cells.column("cell").to_numpy()] = cells.column("times").to_numpy()
    sent = docs.sparkSession.sparkContext.broadcast(counts)
    rows = texts.mapInArrow(lambda batches: _rare_first(batches, sent.value), f"shingle long, n long, rest long, group long, doc_id {kind}")
    shared = rows.repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "shingle").sortWithinPartitions("shingle", "n")
    pairs = shared.mapInArrow(_sharing, f"x {kind}, y {kind}").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    return _verified(docs, staged(pairs, "crowded-pairs"))


def _lows(edges: DataFrame) -> DataFrame:
    """component_id and low, the least node of its component, of the nodes of ``edges`` that are not that."""
    roots = staged(components(edges), "near-roots")
    lows = roots.groupBy("root").agg(F.min("node").alias("low"))
    return roots.join(lows, "root").select(F.col("node").alias("component_id"), "low").where("low <> component_id")


def near_copies(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, fingerprint and component_id of every row of ``docs`` (doc_id, text): SimHash groups, joined on by near links.

    SimHash with 64 bits cannot tell a similarity of 0.8 at a radius that balls can cover. So ball hashing groups first, and
    documents of different groups that share a band of least hashes are linked as well, if the similarity of their sets of
    WIDE-word shingles is ALIKE or more. Equal sets count once.

    Rows without an id or any word are grouped by their fingerprint alone; rows that share an id are one document, linked if
    any of them is; ties cannot arise; an empty table gives an empty result; other columns are ignored.
    """
    groups = staged(near_groups(docs), "near-groups")
    bands = staged(with_bands(docs).join(groups.where("doc_id is not null").select("doc_id", "component_id").distinct(), "doc_id"), "near-bands")
    heads = bands.groupBy("whole", "n").agg(F.min("doc_id").alias("doc_id"), F.min_by(F.struct("component_id", "keys"), "doc_id").alias("of"))
    heads = staged(heads.select("whole", "n", "doc_id", "of.*"), "near-heads")
    linked = bands.select("whole", "n", "component_id").distinct().join(heads.select("whole", "n", F.col("doc_id").alias("a")), ["whole", "n"])
    edges = staged(linked.select("a", F.col("component_id").alias("b")).where("a <> b").distinct().unionByName(near_links(docs, heads)), "near-edges")
    now = heads.join(_lows(edges), "component_id", "left").withColumn("component_id", F.coalesce("low", "component_id")).select("doc_id", "component_id", "keys")
    low = _lows(edges.unionByName(crowded_links(docs, staged(now, "near-now"))))
    return groups.join(low, "component_id", "left").select("doc_id", "text_key", "fingerprint", F.coalesce("low", "component_id").alias("component_id"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(table(spark, sf_dir, "documents")).drop("text_key")
