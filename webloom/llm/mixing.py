"""Mixing sources to target weights by capped water-filling."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from webloom.llm.common import WORD, small_side, staged, table

#: Hash cells of a source; only the cell in which a source's cut falls is sorted by document.
CELL_BITS = 10
#: Source tables up to this many rows (under 10 MB) are broadcast; larger ones are joined by a shuffle.
MOST_SOURCES = 50_000


def source_targets(cells: DataFrame, weights: tuple[int, ...], share: float, max_epochs: float) -> DataFrame:
    """Target words of every source of ``cells`` (source, cell, words), one row each.

    Weights are dealt in turn to the sources in code-point order, null last. Sorting the sources by cap / weight
    turns the clamping rounds into one pass: a source is capped if its cap is under the level that the sources
    after it could still reach. One row per source reaches the windows, whatever the size of the corpus.
    """
    names = Window.orderBy(F.col("source").asc_nulls_last())
    fill = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.pmod(F.row_number().over(names) - 1, F.lit(len(weights))) + 1).cast("int"))
    per = cells.groupBy("source").agg(F.sum("words").alias("source_size")).withColumn("weight", weight).withColumn("cap", F.col("source_size") * max_epochs)
    per = per.withColumn("ratio", F.col("cap") / F.col("weight"))
    before = F.coalesce(F.sum("cap").over(fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    per = per.withColumns({
        "level": (F.sum("source_size").over(everything) * share - before) / F.sum("weight").over(fill.rowsBetween(Window.currentRow, Window.unboundedFollowing)),
        "place": F.row_number().over(fill),
    })
    level = F.min(F.when(F.col("ratio") > F.col("level"), F.struct("place", "level"))).over(everything)["level"]
    target = F.least(F.col("cap"), F.coalesce(F.col("weight") * level, F.col("cap")))
    return per.select("source", "source_size", F.greatest(target, F.lit(0.0)).alias("target"))


def mix(
    docs: DataFrame,
    *,
    weights: tuple[int, ...] = (5, 2, 1),
    share: float = 1.5,
    max_epochs: float = 2.0,
    seed: int = 42,
    rows: bool = False,
) -> DataFrame:
    """How many words of each row of ``docs`` (doc_id, text, source) the mix takes.

    Returns doc_id, source, size, source_size, target, copies (whole repetitions taken), taken = copies * size; with
    ``rows``, also row, a struct of all columns of ``docs``.

    Every document is taken floor(target / source_size) times. The fraction that is left is filled with documents
    in the order of a seeded hash of id and text, to the document nearest the target; so a source misses its target by half a
    document at most, reruns agree, and no document is taken more than ``max_epochs`` (rounded up) times. The hash
    puts the documents of a source in cells; cells are summed first, and only the documents of the cell with the
    cut are sorted, so a source that holds a third of all rows is never gathered in one task.

    Null or empty texts have size 0 and take 0 words; null sources are one source, last; null ids count as the
    empty id; repeated rows are documents of their own; an empty table gives an empty result; other columns are ignored.
    """
    words = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.coalesce(F.md5(F.col("text").cast("binary")), F.lit("")))
    draw = F.conv(F.substring(F.md5(name.cast("binary")), 1, 12), 16, 10).cast("long")
    wide = docs.select("doc_id", F.col("source").cast("string").alias("source"), words.alias("size"), draw.alias("draw"), *[F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")] * rows)
    cell = F.shiftright("draw", 48 - CELL_BITS)
    sized = staged(wide.drop("row"), "mix").withColumn("cell", cell)
    cells = sized.groupBy("source", "cell").agg(F.sum("size").alias("words"))
    targets = source_targets(cells, weights, share, max_epochs)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    targets = targets.withColumn("whole", whole).withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))
    up = Window.partitionBy("source").orderBy("cell").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    reached = cells.withColumn("upto", F.sum("words").over(up)).withColumnRenamed("source", "s_")
    cut = F.min(F.when(F.col("upto") >= F.col("rest"), F.struct("cell", (F.col("upto") - F.col("words")).alias("under"))))
    per = (
        targets.join(small_side(staged(reached, "mix-cells"), 64_000), F.col("source").eqNullSafe(F.col("s_")), "left")
        .groupBy("source", "source_size", "target", "whole", "rest").agg(cut.alias("cut"))
        .select(F.col("source").alias("s_"), "source_size", "target", "whole", "rest", F.col("cut.cell").alias("cut_cell"), F.col("cut.under").alias("under"))
    )
    per = small_side(staged(per, "mix-sources"), MOST_SOURCES)
    dealt = (wide.withColumn("cell", cell) if rows else sized).join(per, F.col("source").eqNullSafe(F.col("s_")))
    inside = F.coalesce(F.col("cell") == F.col("cut_cell"), F.lit(False))
    order = Window.partitionBy("source").orderBy("draw", "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    nearest = F.sum("size").over(order) + F.col("under") - F.col("size") / 2 <= F.col("rest")
    split = dealt.where(inside).withColumn("more", nearest.cast("long"))
    plain = dealt.where(~inside).withColumn("more", F.coalesce(F.col("cell") < F.col("cut_cell"), F.lit(False)).cast("long"))
    return plain.unionByName(split).select("doc_id", "source", "size", "source_size", "target", (F.col("whole") + F.col("more")).alias("copies"), *["row"] * rows).withColumn("taken", F.col("copies") * F.col("size"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", F.round("target", 6).alias("target"), "taken")


OP7_SQL = r"""
with sized as (
  select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size,
    ('0x' || substr(md5('42:' || coalesce(doc_id::varchar, '') || ':' || coalesce(md5(text), '')), 1, 12))::bigint as draw
  from documents),
per as (
  select source, sum(size)::bigint as source_size,
    [5, 2, 1][((row_number() over (order by source nulls last) - 1) % 3) + 1] as weight
  from sized group by source),
caps as (select *, source_size * 2.0::double as cap, source_size * 2.0::double / weight as ratio from per),
levels as (
  select *, row_number() over (order by ratio, source nulls last) as place,
    (sum(source_size) over () * 1.5::double - coalesce(sum(cap) over (order by ratio, source nulls last rows between unbounded preceding and 1 preceding), 0))
      / sum(weight) over (order by ratio, source nulls last rows between current row and unbounded following) as level
  from caps),
targets as (
  select source, source_size, least(cap, coalesce(weight * (select arg_min(level, place) from levels where ratio > level), cap)) as target from levels),
shares as (
  select *, case when source_size > 0 then floor(target / source_size) else 0 end::bigint as whole,
    target - (case when source_size > 0 then floor(target / source_size) else 0 end) * source_size as rest from targets),
ranked as (
  select s.doc_id, s.size, t.source_size, t.target, t.whole, t.rest, 
    sum(s.size) over (partition by s.source order by s.draw, s.doc_id, s.size rows unbounded preceding) as upto
  from sized s join shares t on s.source is not distinct from t.source)
select doc_id, size, source_size, round(target, 6) as target,
  ((whole + case when upto - size / 2.0::double <= rest then 1 else 0 end) * size)::bigint as taken
from ranked
"""
