"""robots.txt: parsing to a rules table, and two ways to match paths."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FIELDS = "host string, agent string, kind string, pattern string, ord int"


def parse(files: DataFrame) -> DataFrame:
    """(host, agent, kind, pattern, ord) from (host, robots_txt): one row per directive and agent of its group.

    Comments, carriage returns and blank lines go; agents named in a row share the directives that follow.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for host, text in zip(pdf["host"], pdf["robots_txt"], strict=True):
                agents: list[str] = []
                open_ = False
                for n, raw in enumerate((text or "").replace("\r", "\n").split("\n")):
                    name, colon, value = raw.split("#", 1)[0].strip().partition(":")
                    name, value = name.strip().lower(), value.strip()
                    if not colon:
                        continue
                    if name == "user-agent":
                        agents = [*agents, value.lower()] if open_ else [value.lower()]
                        open_ = True
                    elif name in ("allow", "disallow", "crawl-delay", "sitemap"):
                        open_ = False
                        rows += [(host, a, name, value, n) for a in (["*"] if name == "sitemap" else agents) if value or name == "crawl-delay"]
            yield pd.DataFrame(rows, columns=["host", "agent", "kind", "pattern", "ord"])

    return files.select("host", "robots_txt").mapInPandas(run, FIELDS)


def prefix_allowed(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """``urls`` (host, path) with allowed: any Allow prefix allows, else any Disallow prefix forbids."""
    key = [c for c in urls.columns]
    path = F.when(F.col("path") == "", F.lit("/")).otherwise(F.col("path"))
    hit = path.startswith(F.col("pattern"))
    any_ = lambda kind: F.coalesce(F.bool_or(hit & (F.col("kind") == kind)), F.lit(False))
    out = urls.join(rules.select("host", "kind", "pattern"), "host", "left").groupBy(*key).agg(any_("allow").alias("_a"), any_("disallow").alias("_d"))
    return out.select(*key, (F.col("_a") | ~F.col("_d")).alias("allowed"))


def _segments(path: Column) -> Column:
    return F.split(F.regexp_replace(F.regexp_replace(path, "/+", "/"), "^/", ""), "/")


def segment_allowed(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """``urls`` (host, path) with allowed, by whole segments: the deepest rule on the way decides, of equals the later.

    A rule's segment ``*``, or an empty one at its end, stands for any; one with a star inside matches from its start.
    """
    key = [c for c in urls.columns]
    s, r = _segments(F.col("path")), _segments(F.col("pattern"))

    def fits(x: Column, y: Column) -> Column:
        glob = F.concat(F.lit("^"), F.regexp_replace(F.regexp_replace(y, r"([.+?()\[\]{}|^$\\])", r"\\$1"), r"\*", ".*"))
        return F.when((y == "*") | (y == ""), F.lit(True)).when(F.contains(y, F.lit("*")), F.regexp(x, glob)).otherwise(x == y)

    root = (F.col("pattern") == "/") | (F.col("pattern") == "")
    depth = F.when(root, F.lit(0)).otherwise(F.size(r))
    pairs = F.zip_with(F.slice(s, 1, F.greatest(F.size(r), F.lit(1))), r, lambda x, y: x.isNotNull() & F.coalesce(fits(x, y), F.lit(False)))
    hit = root | ((F.col("path") != "/") & (F.size(s) >= F.size(r)) & F.forall(pairs, lambda b: b))
    found = urls.join(rules.select("host", "kind", "pattern", "ord"), "host", "left")
    best = F.max(F.when(hit, F.struct(depth.alias("depth"), "ord", "kind")))
    return found.groupBy(*key).agg(best.alias("_b")).select(*key, (F.coalesce(F.col("_b.kind"), F.lit("allow")) == "allow").alias("allowed"))


def delays(rules: DataFrame, default: float = 1.0) -> DataFrame:
    return rules.where("kind = 'crawl-delay'").groupBy("host").agg(F.coalesce(F.max(F.expr("try_cast(pattern as double)")), F.lit(default)).alias("delay"))


def for_agent(rules: DataFrame, agent: str) -> DataFrame:
    """The rules that bind an agent: those of all, and those of groups whose name is part of its own, together."""
    return rules.where((F.col("agent") == "*") | F.contains(F.lit(agent.lower()), F.col("agent")))


def decide(urls: DataFrame, files: DataFrame, agent: str, default: float = 1.0) -> DataFrame:
    """``urls`` (host, path) with allowed and delay for an agent, from ``files`` (host, robots_txt).

    Hosts without a file, or with one that has no rule for the agent, allow everything; the delay is at least the default.
    """
    rules = for_agent(parse(files), agent)
    told = prefix_allowed(urls, rules.where("kind in ('allow', 'disallow')"))
    return told.join(delays(rules, default), "host", "left").withColumn("delay", F.greatest(F.coalesce("delay", F.lit(default)), F.lit(default)))
