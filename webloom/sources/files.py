"""Rating files, stored pages, social records, and saved indexes."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webloom.functions.text import unicode_unescape


def read_ratings(spark: SparkSession, path: str) -> DataFrame:
    """Tab-separated user, item, rating and second, Latin-1, without a header."""
    schema = "user_id int, item_id int, rating int, timestamp long"
    return spark.read.schema(schema).option("sep", "\t").option("encoding", "ISO-8859-1").csv(path)


def read_pages(spark: SparkSession, folder: str, most: int = -1, name: str = "content") -> DataFrame:
    """(path, text) of all files called ``name`` under a folder, escapes decoded, unreadable ones left out; by path, ``most`` of them if that is over 0."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", name).load(folder)
    if most > 0:
        files = files.orderBy("path").limit(most)
    return files.select("path", unicode_unescape(F.decode("content", "ISO-8859-1")).alias("text")).where("text is not null")


def read_social(spark: SparkSession, path: str, lower: bool = False) -> DataFrame:
    """(name, friends, summary, review) of records of ``key: value`` lines, parted by blank lines; friends by tabs."""
    text = F.regexp_replace("value", "\r", "")
    text = F.lower(text) if lower else text
    field = lambda k: F.trim(F.regexp_extract(text, rf"(?m)^{k}:[ \t]*(.*)$", 1))
    first = spark.read.text(path, lineSep="\n").first()
    blank = "\r\n\r\n" if first and first.value.endswith("\r") else "\n\n"
    # Records are parted while reading; those of files with other line ends are parted after that.
    rows = spark.read.option("lineSep", blank).text(path).select(F.explode(F.split("value", r"\r?\n[ \t]*\r?\n")).alias("value"))
    friends = F.filter(F.transform(F.split(field("friends"), "\t"), F.trim), lambda x: x != "")
    return rows.select(field("user").alias("name"), friends.alias("friends"), field("summary").alias("summary"), field("review").alias("review")).where("name <> ''")


def edges(users: DataFrame) -> DataFrame:
    """(src, dst) of friends that are users themselves."""
    return users.select(F.col("name").alias("src"), F.explode("friends").alias("dst")).join(users.select(F.col("name").alias("dst")), "dst", "left_semi").select("src", "dst")


def write_index(postings: DataFrame, path: str) -> None:
    """An index sorted by token, so that a query's tokens prune row groups."""
    postings.repartitionByRange("token").sortWithinPartitions("token").write.mode("overwrite").parquet(path)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_pages(pages: DataFrame, path: str) -> None:
    pages.write.mode("append").partitionBy("host").parquet(path)


def as_records(df: DataFrame) -> DataFrame:
    """(record): each row as JSON, times as seconds since 1970 in text."""
    times = {"timestamp", "timestamp_ntz", "date"}
    value = lambda f: F.unix_timestamp(F.col(f"`{f.name}`").cast("timestamp")).cast("string").alias(f.name) if f.dataType.simpleString() in times else F.col(f"`{f.name}`")
    return df.select(F.to_json(F.struct(*[value(f) for f in df.schema])).alias("record"))


def write_tree(lines: DataFrame, path: str, *folders: str) -> None:
    """The column ``line`` as text files, in a tree of folders named by the values of ``folders``; empty values are called index."""
    named = lines.withColumns({c: F.when(F.coalesce(F.col(c).cast("string"), F.lit("")) == "", F.lit("index")).otherwise(F.col(c).cast("string")) for c in folders})
    named.select("line", *folders).write.mode("append").partitionBy(*folders).text(path)


def page_sink(pages: DataFrame, path: str, checkpoint: str):
    """Starts a stream that stores the pages (host, ...) of each batch by host; each batch is stored once, in a folder of its own."""

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").partitionBy("host").parquet(f"{path}/batch={number}")

    return pages.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def save_tables(path: str, **tables: DataFrame) -> None:
    """A snapshot: users, matrices, vectors, or the state of a crawl, each as a table of its own."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")


def load_tables(spark: SparkSession, path: str, *names: str) -> dict[str, DataFrame]:
    return {name: spark.read.parquet(f"{path}/{name}") for name in names}


def restore_crawl(spark: SparkSession, path: str, seeds: DataFrame, now: float) -> tuple[DataFrame, DataFrame]:
    """(front, hosts) of a saved crawl, every host last visited a second ago; if nothing can be read, ``seeds`` (url) and no hosts."""
    try:
        saved = load_tables(spark, path, "front", "hosts")
        return saved["front"], saved["hosts"].withColumn("last_visited", F.lit(now - 1.0))
    except AnalysisException:
        return seeds.select("url"), spark.createDataFrame([], "host string, last_visited double")
