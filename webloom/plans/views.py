"""Views that the queries share, over the test tables, and the SQL of each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webloom.functions import urls
from webloom.plans.stages import shuffles_freed, staged


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, li = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    joined = o.join(li, o.o_orderkey == li.l_orderkey)
    return joined.groupBy(F.col("o_custkey").alias("user_id"), F.col("l_suppkey").alias("item_id")).agg(F.ceil(F.avg("l_quantity") / 10).cast("int").alias("rating"))


RATINGS = "ratings as (select o_custkey as user_id, l_suppkey as item_id, ceil(avg(l_quantity) / 10)::int as rating from orders join lineitem on o_orderkey = l_orderkey group by 1, 2)"


def ratings_split(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(test, train): a tenth of the ratings, and the rest, of ratings that are written once."""
    with shuffles_freed(spark):
        r = staged(ratings(spark, sf_dir), "ratings")
    own = (F.col("user_id") * 31 + F.col("item_id")) % 10 == 0
    return r.where(own), r.where(~own)


SPLIT = RATINGS + ", test as (select * from ratings where (user_id * 31 + item_id) % 10 = 0), train as (select * from ratings where (user_id * 31 + item_id) % 10 <> 0)"


def social_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    a = o.where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("src"), (F.col("o_orderkey") + 1).alias("k"))
    b = o.select(F.col("o_custkey").alias("dst"), F.col("o_orderkey").alias("k"))
    return a.join(b, "k").where("src <> dst").select("src", "dst").distinct()


EDGES = "edges as (select distinct a.o_custkey as src, b.o_custkey as dst from orders a join orders b on b.o_orderkey = a.o_orderkey + 1 where a.o_orderpriority = '1-URGENT' and a.o_custkey <> b.o_custkey)"

TOKENS = "tokens as (select doc_id, unnest(string_split(lower(regexp_replace(text, '[^A-Za-z]+', ' ', 'g')), ' ')) as token from documents), postings as (select doc_id, token, count(*) as tf from tokens where token <> '' group by 1, 2)"


def hrefs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", "url", F.explode(urls.anchors(F.col("html"))).alias("href"))


_HREF = "case when regexp_matches(h, '^[\"'']') then substr(h, 2, length(h) - 2) else h end"
_ANCHOR = urls.ANCHOR.replace("'", "''")
HREFS = f"""raw as (select page_id, url, unnest(regexp_extract_all(html, '{_ANCHOR}', 1)) as h from pages),
hrefs as (select page_id, url, replace(replace(replace(replace(replace({_HREF}, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&') as href from raw)"""


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = hrefs(spark, sf_dir)
    return h.select(F.col("url").alias("src"), urls.resolve_root(F.col("url"), F.col("href")).alias("dst")).where("dst is not null").distinct()


LINKS = HREFS + r""", links as (select distinct url as src, case when regexp_matches(href, '^(?i)https?://') then href
  when href like '//%' then regexp_extract(url, '^([a-z]+):', 1) || ':' || href
  when href like '/%' then regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) || href end as dst from hrefs
  where regexp_matches(href, '^(?i)https?://') or href like '/%')"""
HOST = "regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)"
