"""Helpers that the corpus operators share: staged tables, row keys, text as bytes."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word of the contracts is a maximal run of other characters than these: space, tab, LF, VT, FF, CR.
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"


#: Bytes of text, and rows, that a Python function takes on at once; a longer text is taken alone.
TEXT_BYTES, TEXT_ROWS = 2 << 20, 512


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; where that is unset and the master is local, a temporary one, which is then set."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="webloom-")
        atexit.register(shutil.rmtree, folder.removeprefix("file://"), True)
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def staged(df: DataFrame, name: str = "stage") -> DataFrame:
    """``df`` written as Parquet in the shared folder and read again: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def unstage(*dfs: DataFrame) -> None:
    """Deletes the files of tables made by ``staged`` that nothing reads any more."""
    for df in dfs:
        spark = df.sparkSession
        for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
            if folder.replace("file:///", "/").startswith(shared_dir(spark).replace("file:///", "/")):
                path = spark._jvm.org.apache.hadoop.fs.Path(folder)
                path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def row_key(text: Column) -> Column:
    """With the id, this tells rows apart; rows equal in both are one document wherever rows are keyed."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def packed(docs: DataFrame) -> Column:
    """All columns of ``docs`` as one struct, so that columns an operator makes clash with none of them."""
    return F.struct(*[F.col(f"`{c}`") for c in docs.columns])


def free_names(docs: DataFrame, *names: str) -> list[str]:
    """``names``, with underscores put before them as long as ``docs`` has a column of that name."""
    taken, found = {c.lower() for c in docs.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        found.append(name)
    return found


def fold(doc_id: str, mod: int) -> Column:
    """The fold of a document: crc32 of the id as text, modulo ``mod``."""
    return F.pmod(F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")), F.lit(mod))


def small_side(df: DataFrame, most_rows: int) -> DataFrame:
    """``df`` marked for broadcast if it has at most ``most_rows`` rows, else as it is, for a shuffled join."""
    return F.broadcast(df) if df.limit(most_rows + 1).count() <= most_rows else df


def few_texts(batches: Iterator[pa.RecordBatch], column: str = "text") -> Iterator[pa.RecordBatch]:
    """``batches`` cut into runs of up to TEXT_ROWS rows whose texts begin within TEXT_BYTES bytes of each other; nothing is copied."""
    for b in batches:
        size = pc.binary_length(b.column(column)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        part = np.maximum.accumulate((np.cumsum(size) - size) // TEXT_BYTES)
        cuts = np.flatnonzero(np.r_[True, part[1:] != part[:-1]][: len(part)])
        for a, z in zip(cuts.tolist(), [*cuts[1:].tolist(), len(part)], strict=True):
            for at in range(a, z, TEXT_ROWS):
                yield b.slice(at, min(TEXT_ROWS, z - at))
