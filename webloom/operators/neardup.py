"""Near-duplicate pairs by shared shingles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webloom.plans.stages import staged


def jaccard_pairs(docs: DataFrame, shingles: Column, least: float) -> DataFrame:
    """(a, b, jaccard) of documents whose sets of shingles have at least that similarity.

    Shingles are joined by a 64-bit hash. With sizes sorted, a pair can only reach ``least`` if they share one of the
    rarest shingles of the smaller set: only the prefix of size n - ceil(least * n) + 1 in order of frequency is joined,
    so frequent shingles, which come last, hardly ever meet. The exact intersection is counted afterwards. The ranked sets
    are written once and read for each step.
    """
    sets = docs.select("doc_id", F.explode(F.array_distinct(shingles)).alias("s")).select("doc_id", F.xxhash64("s").alias("h")).distinct()
    freq = sets.groupBy("h").agg(F.count("*").alias("f"))
    ranked = sets.join(freq, "h").groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("f", "h"))).alias("hs"))
    ranked = staged(ranked.select("doc_id", F.transform("hs", lambda x: x["h"]).alias("hs"), F.transform("hs", lambda x: x["f"] > 1).alias("shared")), "ranked")
    n = F.size("hs")
    first = F.slice(F.arrays_zip("hs", "shared"), F.lit(1), n - F.ceil(n * least - 1e-9).cast("int") + 1)
    prefix = ranked.select("doc_id", n.alias("n"), F.explode(first).alias("x")).where("x.shared").select("doc_id", "n", F.col("x.hs").alias("h"))
    a = prefix.select("doc_id", "n", "h").toDF("a", "na", "h")
    b = prefix.select("doc_id", "n", "h").toDF("b", "nb", "h")
    near = (F.col("a") < F.col("b")) & (F.least("na", "nb") >= F.greatest("na", "nb") * least - 1e-9)
    pairs = a.join(b, "h").where(near).select("a", "b").distinct()
    left, right = ranked.select("doc_id", "hs").toDF("a", "ha"), ranked.select("doc_id", "hs").toDF("b", "hb")
    both = F.size(F.array_intersect("ha", "hb"))
    sim = both / (F.size("ha") + F.size("hb") - both)
    return pairs.join(left, "a").join(right, "b").select("a", "b", sim.alias("jaccard")).where(F.col("jaccard") >= least - 1e-12)
