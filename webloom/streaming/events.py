"""Status events of clients (ts, client, type), in batch and in Structured Streaming."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from webloom.plans.numbering import running_sum


def transitions(events: DataFrame) -> DataFrame:
    """Events that change their client's type; ties in time go by event_id."""
    last = F.lag("type").over(Window.partitionBy("client").orderBy("ts", "event_id"))
    return events.withColumn("last", last).where("last is null or last <> type").drop("last")


def transitions_stream(events: DataFrame) -> DataFrame:
    """The same over a stream: the last type of each client is its state; a batch is put in order first."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        pdf = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        keep = pdf["type"] != pdf["type"].shift(fill_value=last if last is not None else "")
        if len(pdf):
            state.update((pdf["type"].iloc[-1],))
        yield pdf[keep][["event_id", "ts", "client", "type"]]

    cols = events.select("event_id", "ts", "client", "type")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in cols.schema)
    return cols.groupBy("client").applyInPandasWithState(step, schema, "type string", "append", "NoTimeout")


def rates(events: DataFrame, width: str = "1 second") -> DataFrame:
    """Events per window; works on batches and, with a watermark, on streams."""
    w = F.window("ts", width)
    return events.groupBy(w.alias("w")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "n")


def latest(events: DataFrame) -> DataFrame:
    """The latest type of each client; error means the client is dead."""
    one = F.max_by("type", F.struct("ts", "event_id"))
    return events.groupBy("client").agg(one.alias("type")).withColumn("dead", F.col("type") == "error")


def unique_urls_stream(urls: DataFrame, delay: str = "1 hour") -> DataFrame:
    """URLs (ts, url) not seen within ``delay``; state is bounded by the watermark."""
    return urls.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["url"])


def cumulative(events: DataFrame, seconds: int = 3600) -> DataFrame:
    """Running total and average per second by window: counts per window first, then a sum over one row per window."""
    per = running_sum(rates(events, f"{seconds} seconds"), ["start"], F.col("n"), "before")
    first = F.broadcast(per.agg(F.min("start").alias("first")))
    since = F.unix_timestamp("start") - F.unix_timestamp("first") + seconds
    out = per.crossJoin(first).withColumn("total", F.col("before") + F.col("n"))
    return out.select("start", "total", (F.col("total") / since).alias("per_second"))
