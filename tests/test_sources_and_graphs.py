"""Files, crawls and graphs on small worked cases."""

import heapq
import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from webloom.functions import text, urls
from webloom.operators import frontier, graph, neardup, recommend, robots
from webloom.sources import files


def test_ratings(spark, tmp_path):
    (tmp_path / "u.data").write_bytes("1\t2\t5\t881250949\n3\t4\t1\t891717742\n".encode("latin-1"))
    assert [tuple(r) for r in files.read_ratings(spark, str(tmp_path / "u.data")).orderBy("user_id").collect()] == [(1, 2, 5, 881250949), (3, 4, 1, 891717742)]


def test_pages(spark, tmp_path):
    for name, raw in (("a", b"caf\\xe9 \\u00f8"), ("b", b"bad \\x"), ("c", b"plain")):
        (tmp_path / name).mkdir()
        (tmp_path / name / "content").write_bytes(raw)
        (tmp_path / name / "other").write_bytes(b"no page")
    got = files.read_pages(spark, str(tmp_path)).orderBy("path").collect()
    assert [r.text for r in got] == ["café ø", "plain"]
    assert [r.text for r in files.read_pages(spark, str(tmp_path), most=1).collect()] == ["café ø"]


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_social(spark, tmp_path, end):
    text_ = "user: A\nfriends:\tB\tC\nsummary: s one\nreview: fine\n\nuser: B\nfriends:\tA\tZ\nsummary: *\nreview: *\n\nuser: C\nfriends:\tA\nsummary: *\nreview: *\n"
    (tmp_path / "f.txt").write_bytes(text_.replace("\n", end).encode())
    users = files.read_social(spark, str(tmp_path / "f.txt"))
    got = {r.name: (list(r.friends), r.summary, r.review) for r in users.collect()}
    assert got == {"A": (["B", "C"], "s one", "fine"), "B": (["A", "Z"], "*", "*"), "C": (["A"], "*", "*")}
    assert sorted(map(tuple, files.edges(users).collect())) == [("A", "B"), ("A", "C"), ("B", "A"), ("C", "A")]
    assert {r.name for r in files.read_social(spark, str(tmp_path / "f.txt"), lower=True).collect()} == {"a", "b", "c"}


def test_index_and_snapshots(spark, tmp_path):
    p = spark.createDataFrame([(1, "b", 2), (2, "a", 1)], "doc_id long, token string, tf long")
    files.write_index(p, f"{tmp_path}/index")
    assert sorted(map(tuple, files.read_index(spark, f"{tmp_path}/index").where("token = 'a'").collect())) == [(2, "a", 1)]
    files.write_pages(spark.createDataFrame([("h", "u", "x")], "host string, url string, html string"), f"{tmp_path}/pages")
    assert spark.read.parquet(f"{tmp_path}/pages").where("host = 'h'").count() == 1
    seeds = spark.createDataFrame([("s",)], "url string")
    front, hosts = files.restore_crawl(spark, f"{tmp_path}/none", seeds, 100.0)
    assert [r.url for r in front.collect()] == ["s"] and hosts.count() == 0
    files.save_tables(f"{tmp_path}/crawl", front=spark.createDataFrame([("u",)], "url string"), hosts=spark.createDataFrame([("h", 5.0)], "host string, last_visited double"))
    front, hosts = files.restore_crawl(spark, f"{tmp_path}/crawl", seeds, 100.0)
    assert [r.url for r in front.collect()] == ["u"] and [tuple(r) for r in hosts.collect()] == [("h", 99.0)]


def test_records_and_trees(spark, tmp_path):
    df = spark.sql("select 'h' as host, timestamp'1970-01-01 00:01:00' as at, array('a', 'b') as queue")
    assert json.loads(files.as_records(df).first().record) == {"host": "h", "at": "60", "queue": ["a", "b"]}
    files.write_tree(spark.createDataFrame([("h", "/x", "one"), ("h", "", "two")], "host string, path string, line string"), f"{tmp_path}/tree", "host", "path")
    got = spark.read.text(f"{tmp_path}/tree").collect()
    assert {(r.path, r.value) for r in got} == {("/x", "one"), ("index", "two")}


def test_page_sink(spark, tmp_path):
    spark.createDataFrame([("h", "u1"), ("g", "u2")], "host string, url string").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("host string, url string").parquet(f"{tmp_path}/in")
    for _ in range(2):  # the second run finds nothing new
        files.page_sink(stream, f"{tmp_path}/out", f"{tmp_path}/check").awaitTermination()
    assert sorted(r.url for r in spark.read.parquet(f"{tmp_path}/out").collect()) == ["u1", "u2"]


def test_anchors(spark):
    page = """<a href=foo>x</a> <a data-href="bad" href="good"> <A class='c' HREF='one two'> <a href="/p?a=1&amp;b=2"> <a name=x> <abbr href=no> <a title="href='q'" href=/r>"""
    assert spark.range(1).select(urls.anchors(F.lit(page))).first()[0] == ["foo", "good", "one two", "/p?a=1&b=2", "/r"]
    assert spark.range(1).select(urls.anchors(F.lit("<a " + "x=1 " * 20000 + ">"))).first()[0] == []


def test_html_text(spark):
    page = "<p>A &amp; B&nbsp;&eacute;</p><script>x</script><!-- no -->\n<STYLE>y</STYLE><form>f</form> c<br>d"
    df = spark.createDataFrame([(1, page), (2, None), (3, ""), (4, "plain  text")], "i int, p string")
    assert [r[0] for r in df.orderBy("i").select(text.html_text(F.col("p"))).collect()] == ["A & B é c d", None, "", "plain text"]


def test_html_text_equals_its_sql_on_odd_references(spark, tmp_path):
    import duckdb

    from webloom import catalog

    pages = ["a &amp The &ampb &lt", "&#39;x&nbsp;y&eacute;", "\u00a0 a\u00a0\x0bb \u2028", "&amp;lt; &amp;amp;lt; &lt;b&gt;", " \t<p>&quot;q&quot;</p>\r\n\f&copy;&middot;", "", None, "<b>&AMP;</b>"]
    spark.createDataFrame(list(enumerate(pages)), "page_id long, html string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{tmp_path}/pages.parquet/*.parquet'")
    got = {r.page_id: r.text for r in catalog.QUERIES["html_text"](spark, str(tmp_path)).collect()}
    assert got == dict(con.execute(catalog.SQL["html_text"]).fetchall()) and len(got) == len(pages)


def test_crawl(spark):
    pages = spark.createDataFrame(
        [("http://h/0", '<a href="/1"> <a href="/2.html"> <a href="/no.png"> <a href="mailto:x">'), ("http://h/1", '<a href="/0"> <a href="/bad/3"> <a href="//g/4">'), ("http://g/4", '<a href="/5">')],
        "url string, html string",
    )
    rules = robots.parse(spark.createDataFrame([("h", "User-agent: *\nDisallow: /bad")], "host string, robots_txt string"))
    got = {(r.url, r.round) for r in frontier.crawl(spark.createDataFrame([("http://h/0",)], "url string"), pages, rules, 5).collect()}
    assert got == {("http://h/0", 0), ("http://h/1", 1), ("http://h/2.html", 1), ("http://h/bad/3", 2), ("http://g/4", 2), ("http://g/5", 3)}
    assert frontier.may_extract(0, 10_000) and not frontier.may_extract(0, 10_001)


def test_robots_decide(spark):
    paths = spark.createDataFrame([("h", "/a"), ("h", "/b"), ("g", "/a")], "host string, path string")
    txt = spark.createDataFrame([("h", "User-agent: me\nDisallow: /a\nCrawl-delay: 7\nUser-agent: you\nDisallow: /")], "host string, robots_txt string")
    assert {(r.host, r.path): (r.allowed, r.delay) for r in robots.decide(paths, txt, "Me/2").collect()} == {("h", "/a"): (False, 7.0), ("h", "/b"): (True, 7.0), ("g", "/a"): (True, 1.0)}


def test_capped_split(spark):
    r = spark.createDataFrame([(u, i) for u in range(5) for i in range(6)], "user_id int, item_id int")
    got = {(x.user_id, x.item_id) for x in recommend.split_allbut(r, 2, 3, 5).where("part = 'test'").collect()}
    assert got == {(0, 1), (0, 2), (1, 1), (1, 2), (2, 1)}


def test_cheapest_paths_and_routes(spark):
    rng = random.Random(4)
    weight = {(a, b): float(rng.randrange(1, 9)) for a in range(40) for b in rng.sample(range(40), 3) if a != b}
    edges = spark.createDataFrame([(a, b, w) for (a, b), w in weight.items()], "src int, dst int, weight double")
    best, heap = {}, [(0.0, 0)]
    while heap:
        cost, at = heapq.heappop(heap)
        if at not in best:
            best[at] = cost
            for (a, b), w in weight.items():
                if a == at:
                    heapq.heappush(heap, (cost + w, b))
    source = spark.createDataFrame([(0,)], "id int")
    assert {r.id: r.cost for r in graph.cheapest_paths(edges, source).collect()} == best
    for r in graph.shortest_paths(edges.drop("weight"), source).collect():
        assert len(r.route) == r.hops + 1 and r.route[0] == 0 and r.route[-1] == r.id
        assert all((a, b) in weight for a, b in zip(r.route, r.route[1:]))


def test_fiedler_of_a_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(9)] + [(20, 21)], "src int, dst int")
    got = {r.id: r.coordinate for r in graph.fiedler(edges).collect()}
    want = np.cos(np.pi * (np.arange(10) + 0.5) / 10)
    assert sorted(got) == list(range(10))
    mine = np.array([got[i] for i in range(10)])
    assert np.allclose(abs(mine @ want) / np.linalg.norm(want), 1.0)


def test_jaccard_pairs(spark):
    rng = random.Random(8)
    docs = [(i, [f"w{rng.randrange(30)}" for _ in range(12)]) for i in range(60)]
    docs += [(60 + i, [*w[:11], "other"]) for i, w in docs[:20]]
    df = spark.createDataFrame(docs, "doc_id int, w array<string>")
    got = {(r.a, r.b): round(r.jaccard, 6) for r in neardup.jaccard_pairs(df, F.col("w"), 0.5).collect()}
    sets = {i: set(w) for i, w in docs}
    want = {(a, b): round(len(sets[a] & sets[b]) / len(sets[a] | sets[b]), 6) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 0.5 * len(sets[a] | sets[b])}
    assert got == want


def test_global_order_without_one_task(spark):
    from webloom.plans.numbering import numbered, running_sum

    rows = [(i * 37 % 101, (i * 37 % 101) % 5) for i in range(101)]
    df = spark.createDataFrame(rows, "k int, c int").repartition(7)
    got = {r.k: (r.n, r.s) for r in running_sum(numbered(df, ["k"], "n"), ["k"], F.col("c"), "s").collect()}
    assert got == {k: (k, sum(i % 5 for i in range(k))) for k in range(101)}
    assert numbered(df.limit(0), ["k"], "n").collect() == []
    assert sorted((r.k, r.n) for r in numbered(spark.createDataFrame([(None,), (3,), (1,)], "k int"), ["k"], "n").collect() if r.k) == [(1, 1), (3, 2)]


def test_order_of_hosts_without_owners(spark):
    from webloom.operators import frontier

    hosts = spark.createDataFrame([("b", 5.0), ("a", 5.0), ("c", 1.0)], "host string, last_visited double")
    assert {r.host: (r.next_access, r["rank"]) for r in frontier.by_next_access(hosts, 3.0).collect()} == {"c": (4.0, 1), "a": (8.0, 2), "b": (8.0, 3)}


def test_pairs_of_asked_users_only(spark):
    train = spark.createDataFrame([(u, i, (u * i) % 5 + 1) for u in range(1, 7) for i in range(1, 6)], "user_id int, item_id int, rating int")
    every = {(r.u, r.v): r.sim for r in recommend.pearson(train).collect()}
    asked = spark.createDataFrame([(4,), (4,), (6,)], "user_id int")
    assert all(u < v for u, v in every)
    assert {(r.u, r.v): r.sim for r in recommend.pearson(train, asked).collect()} == {k: s for k, s in every.items() if {4, 6} & set(k)}


def test_power_iteration_agrees_with_dense(spark):
    path = [(1, 2), (2, 3), (3, 4), (90, 91)]  # a path of four vertices, and a smaller component
    edges = spark.createDataFrame(path, "src long, dst long")
    dense = {r.id: r.coordinate for r in graph.fiedler(edges).collect()}
    power = {r.id: r.coordinate for r in graph.fiedler(edges, dense=0, rounds=40, tolerance=1e-4).collect()}
    assert set(dense) == set(power) == {1, 2, 3, 4}
    sign = 1 if dense[1] * power[1] > 0 else -1  # the ends of the path are alike in size
    assert all(abs(dense[i] - sign * power[i]) < 1e-3 for i in dense)


def test_treebank_tokens(spark):
    cases = {
        'They\'ll say "it\'s" (not) theirs, won\'t they?': "They 'll say `` it 's '' ( not ) theirs , wo n't they ?",
        "Good muffins cost $3.88 in New York.": "Good muffins cost $ 3.88 in New York .",
        "I cannot cannot, gimme 1,000 -- 'Tis gonna end...": "I can not can not , gim me 1,000 -- 'T is gon na end ...",
        "  the dogs' food: x:y 12:30 ": "the dogs ' food : x : y 12:30",
        "": "",
    }
    got = spark.createDataFrame([(t, w) for t, w in cases.items()], "t string, w string").select("w", F.array_join(text.tokens_treebank(F.col("t")), " ").alias("g")).collect()
    assert [(r.w, r.g) for r in got] == [(r.w, r.w) for r in got]
    stopped = spark.createDataFrame([("the cat",), (None,)], "t string").select(text.tokens_treebank(F.col("t"), ("the",))).collect()
    assert [r[0] for r in stopped] == [["cat"], None]


def test_forms_of_boolean_search(spark):
    from webloom.operators import retrieval

    p = retrieval.ascii_postings(spark.createDataFrame([(1, "apple banana"), (2, "banana cherry"), (3, "apple")], "doc_id long, text string"))
    ids = lambda df: sorted(r.doc_id for r in df.collect())
    apple, banana = retrieval.docs_with(p, "apple"), retrieval.docs_with(p, "banana")
    for a in ("apple", apple):
        for b in ("banana", banana):
            assert ids(retrieval.bool_and(a, b, p)) == [1] and ids(retrieval.bool_or(a, b, p)) == [1, 2, 3]
    assert ids(retrieval.bool_or("apple", "zebra", p)) == [] and ids(retrieval.bool_and("apple", "zebra", p)) == []


def test_where_or_parts_a_query():
    from webloom.operators import retrieval

    assert retrieval.split_query("FORD cars OR boats") == [["ford", "cars"], ["boats"]]
    assert retrieval.split_query("FORD cars OR boats", legacy_or=True) == [["f"], ["d", "cars"], ["boats"]]
    assert retrieval.split_query("Or and or") == [["or", "and", "or"]]


def _ratings(kind, users=40, items=25):
    rng = random.Random(kind)
    value = {"few": lambda: rng.randrange(1, 6), "signed": lambda: rng.randrange(-9, 10), "large": lambda: rng.randrange(100_000), "null": lambda: rng.choice([1, 2, 3, 5, None])}[kind]
    return {(u, i): value() for u in range(users) for i in range(items) if rng.random() < (0.3 if u % 3 else 0.6)}


def _likeness(found, max_r_p=False):
    """Plain correlations in millionths by pairs of users."""
    by = {}
    for (u, i), r in found.items():
        by.setdefault(u, {})[i] = r
    out = {}
    for u in by:
        for v in by:
            common = by[u].keys() & by[v].keys()
            if u < v and common:
                a, b = (np.array([by[w][i] or 0 for i in sorted(common)], dtype=np.int64) for w in (u, v))
                n, both = len(common), sum((by[u][i] or 0) * (by[v][i] or 0) for i in common)
                low = float(n * (a * a).sum() - a.sum() ** 2) ** 0.5 * float(n * (b * b).sum() - b.sum() ** 2) ** 0.5
                if low:
                    out[u, v] = (n, (n * both - int(a.sum()) * int(b.sum())) / low)
    return out


@pytest.mark.parametrize("kind", ["few", "signed", "large", "null"])
@pytest.mark.parametrize("entries", [1 << 21, 50])
def test_tiles_of_pairs(spark, kind, entries, monkeypatch):
    from webloom.operators import tiles

    monkeypatch.setattr(tiles, "ENTRIES", entries)
    monkeypatch.setattr(tiles, "WIDE", 3)
    found = _ratings(kind)
    train = spark.createDataFrame([(u, i, r) for (u, i), r in found.items()], "user_id int, item_id int, rating int")
    made = recommend.pearson(train)
    plan = made._jdf.queryExecution().toString()
    assert "hashpartitioning(u#" not in plan  # no shuffle has a row for each pair of users and item
    want = _likeness(found)
    got = {(r.u, r.v): (r.n, r.sim) for r in made.collect()}
    assert got.keys() == want.keys() and all(got[k][0] == n and abs(got[k][1] - r) < 1e-6 for k, (n, r) in want.items())
    p = recommend.pearson(train, similarity="max_r_p").join(made.withColumnRenamed("sim", "r"), ["u", "v", "n"]).withColumn("p", F.greatest("r", recommend.p_value("r", "n")))
    assert all(abs(r.sim - r.p) < 2e-6 for r in p.collect()) and p.count() == len(want)


def test_tiles_of_halves_hold_no_earlier_block(spark, monkeypatch):
    from webloom.operators import tiles

    monkeypatch.setattr(tiles, "FINE", 8)
    train = spark.createDataFrame([(u, i, 1 + (u * i) % 5) for u in range(24) for i in range(6)], "user_id int, item_id int, rating int")
    rows = tiles.tiles(train, half=True).collect()
    first = {b: min(u for r in rows if r.ub == b for u in r.u) for b in {r.ub for r in rows}}
    assert len(first) > 4 and all(min(r.v) >= first[r.ub] for r in rows)


def test_tiles_leave_no_files_of_shuffles(spark):
    from webloom.operators import tiles
    from webloom.plans.stages import shuffles_freed, staged

    def files() -> dict[str, int]:
        found = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().toList()
        return {f.getPath(): f.length() for f in map(found.apply, range(found.size())) if "shuffle_" in f.getPath()}

    before, was = files(), spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled")
    with shuffles_freed(spark):
        assert staged(spark.range(20_000).repartition(3), "kept").count() == 20_000
    train = spark.range(20_000).selectExpr("id % 500 as user_id", "id div 500 as item_id", "cast(1 + id % 5 as int) as rating")
    made = tiles.tiles(train, half=True)
    assert sum(size for f, size in files().items() if f not in before) < 5_000  # of a count
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == was
    made.collect()
    plan = made._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert "ReusedExchange" in plan and plan.count("Exchange hashpartitioning(item_id") <= 2  # the second is the one reused


def test_tiles_are_narrow_and_results_are_not(spark):
    from webloom.operators import tiles

    for far, most, kinds in ((100, 5, ("tinyint", "tinyint")), (1 << 20, 40_000, ("int", "int")), (1 << 40, -129, ("bigint", "smallint"))):
        rows = [(u, i, most if u == i else (u * i) % 5) for u in (1, 2, 3, far) for i in range(4)]
        train = spark.createDataFrame(rows, "user_id bigint, item_id int, rating int")
        kind = {f.name: f.dataType.simpleString() for f in tiles.tiles(train, half=True).schema}
        assert (kind["v"], kind["y"]) == tuple(f"array<{k}>" for k in kinds)
        made = recommend.pearson(train)
        want = _likeness({(u, i): r for u, i, r in rows})
        assert made.dtypes[:2] == [("u", "bigint"), ("v", "bigint")] and {(r.u, r.v) for r in made.collect()} == want.keys()
    odd = spark.createDataFrame([("a", 1, 1.0), ("b", 1, 2.0), ("a", 2, 2.0), ("b", 2, 4.0)], "user_id string, item_id int, rating double")
    assert [tuple(r) for r in recommend.pearson(odd).collect()] == [("a", "b", 2, 1.0)]


@pytest.mark.parametrize("entries", [1 << 21, 1])
def test_cells_of_tiles_share_two_items(entries, monkeypatch):
    import pyarrow as pa

    from webloom.operators import tiles

    monkeypatch.setattr(tiles, "ENTRIES", entries)
    for far in ([], list(range(10, 60))):  # with few others by their sums, with many by their keys
        l = [[1, 2], [1, 2], [1, 3, *far]]
        x = [[1 + u % 5 for u in of] for of in l]
        cols = [pa.array([0] * 3), pa.array([0] * 3), pa.array([7, 8, 9]), pa.array([[1]] * 3), pa.array([[2]] * 3), pa.nulls(3, pa.list_(pa.int64())), pa.array(l), pa.array(x), pa.nulls(3, pa.list_(pa.float64()))]
        tile = tiles.Tile([pa.RecordBatch.from_arrays(cols, ["ub", "vb", "item_id", "u", "x", "t", "v", "y", "m"])])
        assert [tile.others[c % tile.wide] for _, _, cells, _ in tile.sums(half=True) for c in cells] == [2]


@pytest.mark.parametrize(("kind", "k"), [("few", 3), ("large", 40), ("null", 4)])
def test_tiles_of_neighbours(spark, kind, k, monkeypatch):
    from webloom.operators import tiles

    monkeypatch.setattr(tiles, "WIDE", 3)
    found = _ratings(kind)
    rows = [(u, i, r) for (u, i), r in found.items()]
    train = spark.createDataFrame([x for x in rows if (x[0] * 7 + x[1]) % 5], "user_id int, item_id int, rating int")
    test = spark.createDataFrame([x for x in rows if not (x[0] * 7 + x[1]) % 5] + [(99, 1, 2), (1, 99, 2)], "user_id int, item_id int, rating int")
    sim = recommend.pearson(train)
    made = recommend.nearest(test, train, k)
    assert "hashpartitioning(lo#" not in made._jdf.queryExecution().toString()
    cols = ["user_id", "item_id", "v", "sim", "rating", "rank"]
    shown = lambda df: sorted(map(tuple, df.select(*cols).collect()), key=repr)
    assert shown(made) == shown(recommend.neighbours(test, train, sim, k))
    for threshold in (0.5, -0.2):
        near = {(r.user_id, r.item_id): r.pred for r in recommend.predict_nearest(test, train, k, threshold).collect()}
        plain = {(r.user_id, r.item_id): r.pred for r in recommend.predict(test, train, sim, k, threshold).collect()}
        assert near.keys() == plain.keys() and (kind == "null" or all(math.isclose(near[x], plain[x], abs_tol=1e-9) for x in plain))


def test_all_hops_equal_paths_by_joins(spark):
    rng = random.Random(5)
    links = {(rng.randrange(60), rng.randrange(60)) for _ in range(110)}
    edges = spark.createDataFrame([(a, b) for a, b in links if a != b], "src long, dst long")
    sources = spark.createDataFrame([(i,) for i in [*range(0, 60, 2), 777]], "id long")  # the last has no edge
    want = sorted(map(tuple, graph.shortest_paths(edges, sources).drop("route").collect()), key=repr)
    made = graph.all_hops(edges, sources)
    assert "paths-" not in "".join(made.inputFiles())  # no round is written
    assert sorted(map(tuple, made.collect()), key=repr) == want
    assert sorted(map(tuple, graph.all_hops(edges, sources, in_memory=1).collect()), key=repr) == want
    assert {r.id for r in graph.all_hops(edges.limit(0), sources).collect()} == {r.id for r in sources.collect()}


def test_lanczos_agrees_with_dense():
    rng = np.random.default_rng(3)
    for n, extra in ((3, 0), (400, 0), (900, 700)):  # a path of three, trees and graphs with long tails
        links = {(v, int(rng.integers(max(0, v - 20), v))) for v in range(1, n)} | {(int(a), int(b)) for a, b in rng.integers(0, n, (extra, 2)) if a > b}
        i, j = np.array([*links, *((b, a) for a, b in links)]).T
        m = np.zeros((n, n))
        m[i, j] = -1
        np.fill_diagonal(m, -m.sum(1))
        values, vectors = np.linalg.eigh(m)
        got = graph.lanczos(i, j, n)
        assert abs(got @ m @ got - values[1]) < 1e-8 and abs(got @ vectors[:, 1]) > 1 - 1e-6


def test_power_iteration_of_graphs_beyond_a_task(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 4)], "src long, dst long")
    dense, lanczos = ({r.id: abs(r.coordinate) for r in graph.fiedler(edges, dense=d).collect()} for d in (10, 0))
    power = {r.id: abs(r.coordinate) for r in graph.fiedler(edges, dense=0, rounds=40, tolerance=1e-4, sparse=0).collect()}
    assert all(abs(dense[i] - lanczos[i]) < 1e-6 and abs(dense[i] - power[i]) < 1e-3 for i in dense)


def test_p_values_of_tiles():
    from webloom.operators import tiles

    assert tiles.p_values(np.array([0.5, 1.0, 0.4, 0.4]), np.array([3, 8, 2, 1]))[:3].round(9).tolist() == [round(2 / 3, 9), 0.0, 1.0]
    assert np.isnan(tiles.p_values(np.array([0.4]), np.array([1]))[0])
