"""Crawl frontier in rounds: hosts, admission, deduplication, schedule, and one step of a crawl."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from webloom.functions import urls
from webloom.operators.robots import prefix_allowed
from webloom.plans.numbering import numbered
from webloom.plans.stages import staged

#: Bytes of the largest page that is read.
MOST_BYTES = 10_485_760


def host_ids(hosts: DataFrame) -> DataFrame:
    """(host, id) of distinct hosts, numbered from 0 by name."""
    return numbered(hosts.select("host").distinct(), ["host"], "id").withColumn("id", F.col("id").cast("int"))


def admission(pages: DataFrame, most: int = MOST_BYTES) -> DataFrame:
    return pages.withColumn("status", F.when(F.col("size") > most, F.lit("large")).otherwise(F.lit("html")))


def unseen(found: DataFrame, seen: DataFrame) -> DataFrame:
    return found.dropDuplicates(["url"]).join(seen.select("url"), "url", "left_anti")


def schedule(queue: DataFrame, delay: float = 1.0) -> DataFrame:
    """``queue`` (host, url, seq) with the second at which each URL may be fetched: its place in the host's queue times the delay."""
    place = F.row_number().over(Window.partitionBy("host").orderBy("seq", "url")) - 1
    return queue.withColumn("fetch_at", place * F.lit(delay))


def crawl_round(front: DataFrame, visited: DataFrame, pages: DataFrame, rules: DataFrame) -> DataFrame:
    """New URLs (url, found_on) that one round finds: not yet visited, allowed, fetched from ``pages``, links followed."""
    todo = unseen(front, visited).withColumn("host", urls.authority(F.col("url"))).withColumn("path", urls.path(F.col("url")))
    ok = prefix_allowed(todo.select("url", "host", "path"), rules).where("allowed").select("url")
    got = pages.join(ok, "url", "left_semi").select("url", F.explode(urls.anchors(F.col("html"))).alias("href")).where(urls.worth_following(F.col("href")))
    new = got.select(urls.resolve_root(F.col("url"), F.col("href")).alias("to"), "url").where("to is not null")
    new = new.where(urls.wanted(F.col("to")))
    new = new.groupBy(F.col("to").alias("url")).agg(F.min("url").alias("found_on"))
    return new.join(front.select("url"), "url", "left_anti").join(visited.select("url"), "url", "left_anti")


def owners(hosts: DataFrame, clients: int) -> DataFrame:
    """``hosts`` (host) with the client, from 0, that alone fetches from each: it hangs on the name, so all agree without asking."""
    return hosts.withColumn("client", F.pmod(F.conv(F.substring(F.md5(F.col("host").cast("binary")), 1, 8), 16, 10).cast("long"), F.lit(clients)).cast("int"))


def ready(hosts: DataFrame, now: float, delay: float = 1.0) -> DataFrame:
    """``hosts`` (last_visited) with ready: whether more than the delay has gone by since."""
    return hosts.withColumn("ready", F.lit(now) > F.col("last_visited") + delay)


def next_host(hosts: DataFrame) -> DataFrame:
    """Of ``hosts`` (id, ready, queued) with anything queued, the first that is ready; if none is, the first."""
    return hosts.where("queued > 0").orderBy(F.desc("ready"), "id").limit(1)


def by_next_access(hosts: DataFrame, delay: float = 1.0) -> DataFrame:
    """``hosts`` (host, last_visited) with rank: the order in which they may be visited, by owner if there is one."""
    due = hosts.withColumn("next_access", F.col("last_visited") + delay)
    if "client" in hosts.columns:
        return due.withColumn("rank", F.row_number().over(Window.partitionBy("client").orderBy("next_access", "host")))
    return numbered(due, ["next_access", "host"], "rank").withColumn("rank", (F.col("rank") + 1).cast("int"))


def refill(front: DataFrame, most: int = 100) -> DataFrame:
    """The first ``most`` URLs (host, url, seq) of the front queue, with their place in the back queue of their host."""
    moved = front.orderBy("seq", "url").limit(most)
    return moved.withColumn("place", F.row_number().over(Window.partitionBy("host").orderBy("seq", "url")))


def may_extract(visited: int, queued: int, slack: int = 10_000) -> bool:
    """Whether the links of a page are looked at: not while the queue is far ahead of the visits."""
    return visited + slack >= queued


def statistics(front: DataFrame, back: DataFrame, crawled: DataFrame) -> DataFrame:
    """One row: URLs in the front queue, in all back queues, hosts that have one, URLs crawled."""
    one = lambda df, *of: df.agg(*of)
    sizes = one(front, F.count("*").alias("front")).crossJoin(one(back, F.count("*").alias("back"), F.count_distinct("host").alias("hosts")))
    return sizes.crossJoin(one(crawled, F.count("*").alias("crawled")))


def crawl(seeds: DataFrame, pages: DataFrame, rules: DataFrame, rounds: int) -> DataFrame:
    """(url, round) of all that a crawl from ``seeds`` (url) finds in so many rounds; each round is written, and its front is what was new."""
    front = staged(seeds.select("url").distinct(), "crawl")
    found, visited = front.withColumn("round", F.lit(0)), front.limit(0)
    for n in range(1, rounds + 1):
        new = staged(crawl_round(front, visited, pages, rules).select("url"), "crawl")
        if new.isEmpty():
            break
        visited, front = visited.unionByName(front), new
        found = found.unionByName(new.withColumn("round", F.lit(n)))
    return found
