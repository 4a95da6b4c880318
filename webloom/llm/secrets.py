"""Secret scans: fixed patterns, and weak parts of credentials linked by an interval join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from webloom.llm.common import packed, row_key, table

#: The base patterns of the contract, in its order: kind, pattern, group that is measured, fewest characters of it.
BASE = (
    ("assign", r"""((?i)password|passwd|secret|token|api_?key)(?-i)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    ("access", r"AKIA[A-Z0-9]+", 0, 16),
    ("hex", r"[0-9a-f]{32,}", 0, 32),
)
#: Weak parts: alone they are no finding. Identifiers, key-like tokens of mixed characters, and endpoints. Repeats are of
#: single character classes only, and no search looks far back or ahead without a match, so long texts take linear time.
IDENT = r"""(?i)\b(?:user(?:name|_?id)?|login|client_?id|account|access_?key(?:_?id)?)["']?\x20*[:=]\x20*["']?[A-Za-z0-9@._+-]{3,}"""
ENDPOINT = r"""(?i)\b(?:[a-z][a-z0-9+.-]{0,31}://[^\s"'<>]+|(?:host|endpoint|server)["']?\x20*[:=]\x20*["']?[a-z0-9-]+\.[a-z0-9.-]*[a-z0-9](?::[0-9]+)?)"""
KEY = r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*[0-9])(?=[A-Z0-9+/_-]*[a-z])(?=[a-z0-9+/_-]*[A-Z])[A-Za-z0-9+/_-]{20,}"
WEAK = (("ident", IDENT), ("key", KEY), ("endpoint", ENDPOINT))
KINDS = tuple(k for k, *_ in BASE) + tuple(k for k, _ in WEAK)
#: Parts of a credential are linked if their spans are at most so many code points apart.
REACH = 300
#: Code points of a chunk, when texts are masked.
CHUNK = 1024


def _found(text: Column, kind: int, pattern: str, group: int, least: int, where: Column) -> Column:
    """Matches of a pattern as (kind, at, gap, size, good): ``gap`` code points lie between a match and the one before."""
    p = F.lit(pattern)
    gaps = F.transform(F.split(text, pattern, -1), F.length)
    pair = F.arrays_zip(gaps.alias("gap"), F.regexp_extract_all(text, p, F.lit(0)).alias("all"), F.regexp_extract_all(text, p, F.lit(group)).alias("part"))

    def one(x: Column, i: Column) -> Column:
        return F.struct(
            F.lit(kind).alias("kind"), i.alias("at"), x.getField("gap").cast("long").alias("gap"), F.length(x.getField("all")).cast("long").alias("size"),
            (F.length(x.getField("part")) >= least).alias("good"),
        )

    return F.when(where, F.filter(F.transform(pair, one), lambda x: x["size"].isNotNull()))


def secret_spans(docs: DataFrame, *, reach: int = REACH) -> DataFrame:
    """One row for each row of ``docs`` (doc_id, text): doc_id, text_key, spans array<struct<start, rank, kind, end, reached>>.

    Spans are code points, end exclusive, sorted by start, then by kind in the order of ``KINDS``; ``reached`` is the
    greatest end of the spans before. Kinds of ``BASE``
    are always reported. A weak part is reported only where the parts that complete it lie within ``reach`` code
    points: an ident with a secret (assign, hex or key), a key with an identifier (access or ident) or an endpoint,
    an endpoint with an identifier and a secret.

    All parts of a document are laid along its text, and the nearest part of each class before and after each part
    is carried along: that is the interval join of the classes, in one sort and without pairs. A document's parts
    are its unit of work, so neither a source nor a group of copies can become hot.

    Null texts count as empty and have no spans. Rows equal in doc_id and text share one search and come back as often
    as they came; null ids are an id of their own; an empty table gives an empty result; other columns are ignored.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    low = F.lower(text)
    named = F.lit(False)
    for word in ("password", "passwd", "secret", "token", "apikey", "api_key"):
        named = named | F.contains(low, F.lit(word))
    when = {"assign": named, "access": F.contains(text, F.lit("AKIA")), "hex": text.rlike("[0-9a-f]{32}")}
    base = [_found(text, i, p, g, n, when[k]) for i, (k, p, g, n) in enumerate(BASE)]
    partial = text.rlike(IDENT) | text.rlike(ENDPOINT) | when["access"]
    weak = [_found(text, len(BASE) + i, p, 0, 0, partial) for i, (_, p) in enumerate(WEAK)]
    none = F.array(F.struct(F.lit(-1).alias("kind"), F.lit(0).alias("at"), F.lit(0).cast("long").alias("gap"), F.lit(0).cast("long").alias("size"), F.lit(False).alias("good")))
    parts = F.concat(none, *[F.coalesce(x, F.slice(none, 1, 0)) for x in (*base, *weak)])
    rows = docs.select("doc_id", row_key(F.col("text")).alias("text_key"), F.explode(parts).alias("p")).select("doc_id", "text_key", "p.*")
    # Equal rows: the same match several times counts once; the row of kind -1 counts the documents.
    rows = rows.groupBy("doc_id", "text_key", "kind", "at", "gap", "size", "good").agg(F.count("*").alias("times"))
    key = Window.partitionBy("doc_id", "text_key", "kind").orderBy("at")
    done = key.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("end", F.sum(F.col("gap") + F.col("size")).over(done)).withColumn("start", F.col("end") - F.col("size"))
    rows = rows.where(F.col("good") | (F.col("kind") < 0))
    number = {k: i for i, k in enumerate(KINDS)}
    classes = {"id": ("access", "ident"), "secret": ("assign", "hex", "key"), "endpoint": ("endpoint",)}
    along = Window.partitionBy("doc_id", "text_key").orderBy("start", "kind")
    back = Window.partitionBy("doc_id", "text_key").orderBy(F.col("start").desc(), F.col("kind").desc())
    before, after = (w.rowsBetween(Window.unboundedPreceding, -1) for w in (along, back))
    for name, kinds in classes.items():
        own = F.col("kind").isin([number[k] for k in kinds])
        rows = rows.withColumn(f"left_{name}", F.max(F.when(own, F.col("end"))).over(before))
    for name, kinds in classes.items():
        own = F.col("kind").isin([number[k] for k in kinds])
        rows = rows.withColumn(f"right_{name}", F.min(F.when(own, F.col("start"))).over(after))
    for name in classes:
        left, right = F.col("start") - F.col(f"left_{name}") <= reach, F.col(f"right_{name}") - F.col("end") <= reach
        rows = rows.withColumn(f"near_{name}", F.coalesce(left, F.lit(False)) | F.coalesce(right, F.lit(False)))
    keep = (
        F.when(F.col("kind") == number["ident"], F.col("near_secret"))
        .when(F.col("kind") == number["key"], F.col("near_id") | F.col("near_endpoint"))
        .when(F.col("kind") == number["endpoint"], F.col("near_id") & F.col("near_secret"))
        .otherwise(F.lit(True))
    )
    rows = rows.where(keep).withColumn("reached", F.coalesce(F.max(F.when(F.col("kind") >= 0, F.col("end"))).over(before), F.lit(0).cast("long")))
    names = F.array(*[F.lit(k) for k in KINDS])
    span = F.struct("start", F.col("kind").alias("rank"), F.element_at(names, F.col("kind") + 1).alias("kind"), "end", "reached")
    per = rows.groupBy("doc_id", "text_key").agg(
        F.sort_array(F.collect_list(F.when(F.col("kind") >= 0, span))).alias("spans"),
        F.max(F.when(F.col("kind") < 0, F.col("times"))).alias("times"),
    )
    return per.withColumn("_", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times")))).select("doc_id", "text_key", "spans")


def listed(spans: Column) -> Column:
    """Spans as kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def redact(docs: DataFrame, mask: str = "[SECRET]", *, reach: int = REACH) -> DataFrame:
    """``docs`` (doc_id, text, n_chars and any others) with every reported span of the text replaced by ``mask``.

    Overlapping spans are replaced together. Rows without spans, null texts among them, stay as they are; n_chars, where
    there is one, is that of the new text. Repeated rows keep their number, null ids are an id of their own, and all other
    columns come back as they are, whatever their names; an empty table gives an empty result.
    """
    spans = secret_spans(docs.select("doc_id", "text"), reach=reach).where(F.size("spans") > 0).dropDuplicates(["doc_id", "text_key"])
    spans = spans.select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key"), F.col("spans").alias("_spans"))
    keyed = docs.select(packed(docs).alias("row")).withColumn("_text_key", row_key(F.col("row.text")))
    joined = keyed.join(spans, F.col("row.doc_id").eqNullSafe(F.col("_id")) & (F.col("_text_key") == F.col("_key")), "left")
    text = F.col("row.text")
    # Texts are cut into chunks, so that a part of a long text is found without a walk from its beginning.
    joined = joined.withColumn("_chunks", F.when(F.col("_spans").isNotNull(), F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0))))

    def part(start: Column, end: Column) -> Column:
        one, two = F.floor(start / CHUNK).cast("int"), F.floor(end / CHUNK).cast("int")
        head = F.substring(F.try_element_at("_chunks", one + 1), (start % CHUNK + 1).cast("int"), F.when(one == two, (end - start).cast("int")).otherwise(CHUNK))
        tail = F.when(two > one, F.concat(F.array_join(F.slice("_chunks", one + 2, two - one - 1), ""), F.coalesce(F.substring(F.try_element_at("_chunks", two + 1), F.lit(1), (end % CHUNK).cast("int")), F.lit(""))))
        return F.concat(F.coalesce(head, F.lit("")), F.coalesce(tail, F.lit("")))

    apart = F.filter("_spans", lambda x: x["start"] >= x["reached"])
    last = F.greatest(F.element_at("_spans", -1)["reached"], F.element_at("_spans", -1)["end"])
    pieces = F.concat(F.transform(apart, lambda x: F.concat(part(x["reached"], x["start"]), F.lit(mask))), F.array(part(last, F.length(text).cast("long"))))
    clean = F.when(F.col("_spans").isNull(), text).otherwise(F.array_join(pieces, ""))
    fields = {c: F.col(f"row.`{c}`") for c in docs.columns}
    joined = joined.withColumn("_clean", clean)
    if "n_chars" in fields:
        fields["n_chars"] = F.when(F.col("_spans").isNull(), fields["n_chars"]).otherwise(F.length("_clean").cast(docs.schema["n_chars"].dataType))
    fields["text"] = F.col("_clean")
    return joined.select(*[v.alias(c) for c, v in fields.items()])


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_spans(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda x: x["rank"] < len(BASE))

    def count(i: int) -> Column:
        return F.size(F.filter("spans", lambda x: x["rank"] == i)).cast("long")

    return found.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(listed(base).cast("binary"), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"),
    )
