"""Worked cases of the operators, and every query against its SQL on the smallest tables."""

import math

import duckdb
import pytest
from pyspark.sql import functions as F

from webloom import catalog
from webloom.functions import text, urls
from webloom.functions.stem import stem, stem_en
from webloom.operators import recommend, retrieval, robots
from webloom.plans import views
from webloom.streaming import events as ev

SMALL = "/root/testdata/sf0.001"
SLOW = {"rec_grid_rmse"}


def corpus(spark):
    return spark.createDataFrame([(1, "apple banana apple"), (2, "banana cherry"), (3, "apple")], "doc_id long, text string")


def scores(df):
    return sorted((r.doc_id, round(r.score, 6)) for r in df.collect())


def test_search_cosine(spark):
    p = retrieval.ascii_postings(corpus(spark))
    assert scores(retrieval.search_cosine(p, "apple banana", 3)) == [(1, 0.030746)]
    assert scores(retrieval.search_cosine(p, "apple OR banana", 3)) == [(1, 0.030746), (1, 0.030746), (2, 0.015504), (3, 0.021926)]
    assert scores(retrieval.search_cosine(p, "cherry", 3)) == [(2, 0.160969)]
    assert scores(retrieval.search_cosine(p, "zebra apple", 3)) == []


def test_search_ratio(spark):
    p = retrieval.ascii_postings(corpus(spark))
    assert scores(retrieval.search_ratio(p, ["apple", "banana"], 3)) == [(1, 0.818606), (2, 0.5625), (3, 0.795495)]
    assert scores(retrieval.search_ratio(p, ["apple", "apple"], 3)) == [(1, 0.925699), (3, 1.59099)]
    assert scores(retrieval.search_ratio(p, ["apple", "zebra"], 3)) == []


def test_prediction(spark):
    rows = {1: {10: 5, 11: 3, 12: 4}, 2: {10: 4, 11: 2, 12: 3, 13: 5}, 3: {10: 2, 11: 5, 12: 3, 13: 1}, 4: {10: 5, 11: 3, 12: 5, 13: 4}, 5: {10: 3, 13: 2}}
    train = spark.createDataFrame([(u, i, r) for u, x in rows.items() for i, r in x.items()], "user_id int, item_id int, rating int")
    test = spark.createDataFrame([(1, 13, 0)], "user_id int, item_id int, rating int")
    sim = recommend.pearson(train, test.select("user_id"))
    assert {r.v: r.sim for r in sim.collect()} == {2: 1.0, 3: -0.981981, 4: 0.866025}
    for k, threshold, want in ((20, 0.5, 4.687822), (1, 0.5, 5.5), (20, 0.95, 5.5), (20, 1.0, 4.0)):
        assert math.isclose(recommend.predict(test, train, sim, k, threshold).first().pred, want, abs_tol=1e-6)


def test_robots_segments(spark):
    rules = spark.createDataFrame([("h", "disallow", "/search", 0), ("h", "allow", "/search/about", 1), ("h", "disallow", "/u/", 2)], "host string, kind string, pattern string, ord int")
    want = {"/search": False, "/search/x": False, "/search/about": True, "/searching": True, "/u": True, "/u/bob": False, "/u/": False, "//search": False, "/": True}
    paths = spark.createDataFrame([("h", p) for p in want], "host string, path string")
    assert {r.path: r.allowed for r in robots.segment_allowed(paths, rules).collect()} == want


def test_robots_parse(spark):
    files = spark.createDataFrame([("h", "User-agent: *\r\nDisallow: /a # no\nDisallow:\nCrawl-delay: 3\n\nUser-agent: x\nUser-agent: y\nAllow: /b")], "host string, robots_txt string")
    got = {(r.agent, r.kind, r.pattern) for r in robots.parse(files).collect()}
    assert got == {("*", "disallow", "/a"), ("*", "crawl-delay", "3"), ("x", "allow", "/b"), ("y", "allow", "/b")}


@pytest.mark.parametrize(("ref", "want"), [("", "http://a/b/c/d?x=1"), ("../x", "http://a/b/x"), ("g/", "http://a/b/c/g/"), ("..", "http://a/b/"), ("../../../x", "http://a/x"), ("?q=1", "http://a/b/c/d?q=1"), ("#f", "http://a/b/c/d?x=1#f"), ("//h/p", "http://h/p"), ("mailto:z", "mailto:z")])
def test_url_join(spark, ref, want):
    df = spark.createDataFrame([("http://a/b/c/d?x=1", ref)], "b string, r string")
    assert df.select(urls.url_join("b", "r")).first()[0] == want


def test_shingles(spark):
    one = spark.createDataFrame([("a b c",)], "t string")
    assert one.select(text.shingles_tail(F.col("t"), 2)).first()[0] == ["a b", "b c", "c"]
    assert one.select(text.shingles_full(F.col("t"), 2)).first()[0] == ["a b ", "b c "]
    assert one.select(text.shingles_full(F.col("t"), 4)).first()[0] == []


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - SLOW))
def test_query_equals_sql(spark, name):
    df = catalog.QUERIES[name](spark, SMALL)
    cols = sorted(df.columns)
    rows = sorted((tuple(r) for r in df.select(*cols).collect()), key=repr)
    if name in catalog.SQL:
        con = duckdb.connect()
        for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
            con.execute(f"create view {t} as select * from '{SMALL}/{t}.parquet'")
        assert rows == sorted(con.execute(f"select {', '.join(cols)} from ({catalog.SQL[name]})").fetchall(), key=repr)
    else:
        assert rows


STEMS = dict(
    caresses="caress", ponies="poni", ties="tie", cats="cat", agreed="agre", hopping="hop", hoping="hope", relational="relat", generously="generous",
    consistency="consist", knightly="knight", happy="happi", by="by", say="say", cry="cri", luxuriating="luxuri", consigned="consign", communication="communic",
    gas="gas", this="this", kiwis="kiwi", bed="bed", sized="size", falling="fall", controlling="control", news="news", dying="die", possibly="possibl", herring="herring",
)


def test_stems(spark):
    assert {w: stem(w) for w in STEMS} == STEMS
    got = spark.createDataFrame([(w, v) for w, v in [*STEMS.items(), (None, None), ("", "")]], "w string, v string").withColumn("s", stem_en("w"))
    assert got.where("not (s <=> v)").isEmpty()


def test_all_pairs_of_paths(spark):
    edges = [(r.src, r.dst) for r in views.social_edges(spark, SMALL).collect()]
    ahead, want = {}, set()
    for a, b in edges:
        ahead.setdefault(a, []).append(b)
    for source in ahead:
        hops, front = {source: 0}, [source]
        for x in front:
            for y in ahead.get(x, []):
                if y not in hops:
                    hops[y] = hops[x] + 1
                    front.append(y)
        want |= {(source, y, h) for y, h in hops.items()}
    found = catalog.QUERIES["graph_apsp"](spark, SMALL).collect()
    assert len(found) == len(want) and {(r.source, r.id, r.hops) for r in found} == want
    links = set(edges)
    assert all(r.hops == 0 or ((r.pred, r.id) in links and (r.source, r.pred, r.hops - 1) in want) for r in found)


def test_streams_agree_with_batches(spark, tmp_path):
    source = tmp_path / "in"
    rows = [(i, i, i % 3, "abca"[(i * 7 // 3) % 4]) for i in range(60)]
    schema = "event_id long, s long, client int, type string"
    for part in range(3):  # files in order of time; each is one batch
        spark.createDataFrame(rows[part * 20 : part * 20 + 20], schema).coalesce(1).write.mode("append").parquet(str(source))
    named = lambda df: df.select("event_id", F.timestamp_seconds("s").alias("ts"), "client", "type")
    stream = named(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(source)))
    batch = named(spark.read.parquet(str(source)))

    def drained(df, mode, name):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        assert q.awaitTermination(120)
        return sorted(map(tuple, spark.table(name).collect()))

    assert drained(ev.transitions_stream(stream), "append", "changes") == sorted(map(tuple, ev.transitions(batch).select("event_id", "ts", "client", "type").collect()))
    assert drained(ev.rates(stream, "10 seconds"), "complete", "rates") == sorted(map(tuple, ev.rates(batch, "10 seconds").collect()))
    seen = drained(ev.unique_urls_stream(stream.select("ts", F.col("type").alias("url"))).select("url"), "append", "urls")
    assert seen == [("a",), ("b",), ("c",)]


def test_p_values_of_correlations(spark):
    def tail(r, n, cells=200_000):  # Student's density with n - 2 degrees of freedom, in terms of r, by midpoints
        power = (n - 4) / 2
        area = lambda a, b: sum((1 - (a + (b - a) * (i + 0.5) / cells) ** 2) ** power for i in range(cells)) * (b - a) / cells
        return area(abs(r), 1) / area(0, 1)

    cases = [(r, n) for n in (4, 5, 6, 9, 30, 61) for r in (0.0, -0.3, 0.55, 0.9)]
    got = spark.createDataFrame([*cases, (0.5, 3), (1.0, 8), (0.4, 2), (0.4, 1)], "sim double, n long").withColumn("p", recommend.p_value("sim", "n")).collect()
    for row, (r, n) in zip(got, cases):
        assert math.isclose(row.p, tail(r, n), abs_tol=1e-5)
    assert math.isclose(got[-4].p, 2 / 3) and [x.p for x in got[-3:]] == [0.0, 1.0, None]
    train = spark.createDataFrame([(1, 1, 1), (1, 2, 2), (1, 3, 3), (2, 1, 1), (2, 2, 3), (2, 3, 2)], "user_id int, item_id int, rating int")
    assert recommend.pearson(train).first().sim == 0.5 and recommend.pearson(train, similarity="max_r_p").first().sim == 0.666667
