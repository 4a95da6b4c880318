"""Each operator that SQL cannot express against a plain version of it, and long or odd texts."""

import math
import os
import random
import time
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from webloom.llm import common, decontam, fingerprints, htmltext, langid, lm, secrets, simhash, substrings, toxicity

def test_densified_bins(spark):
    """Bins filled and densified one by one, from the hashes that Spark makes."""
    rng = random.Random(1)
    texts = ["", "one", *(" ".join(f"w{rng.randrange(50)}" for _ in range(n)) for n in (3, 5, 6, 12, 40, 200, 900))]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    rows = fingerprints.fingerprint(df.withColumn("h", fingerprints.shingle_hashes(F.col("t"))), F.col("t"), "fp").collect()
    probes = fingerprints._probes(fingerprints.BINS)
    for r in rows:
        bins = {}
        for h in r.h:
            assert h % 2 == 0
            b = (h >> 57) + 64
            bins[b] = min(bins.get(b, h), h)
        for b, got in enumerate(r.fp):
            if b in bins:
                want = bins[b]
            elif found := [p for p in probes[b][: fingerprints.PROBES] if p in bins]:
                want = bins[found[0]]
            else:
                want = None  # beyond the probes: any filled bin, by a hash
            if want is not None:
                assert got == (want >> 1) & 15
            else:
                assert got in {(v >> 1) & 15 for v in bins.values()}


def test_next_row_of_odd_ids(spark):
    rng = random.Random(2)
    ids = sorted({*(rng.randrange(10**6) for _ in range(300)), 2**62, -(2**62), 2**63 - 1, -(2**63)})
    df = spark.createDataFrame([(i, str(i), 7, 8, "x") for i in ids], "doc_id long, text string, block int, extra int, next_text string").repartition(5)
    got = fingerprints.with_next(df, ["text"]).collect()
    assert {r.doc_id: int(r.next_text) for r in got} == dict(zip(ids, ids[1:] + ids[:1])) and all((r.block, r.extra) == (7, 8) for r in got)
    names = sorted({"".join(rng.choice("abé") for _ in range(rng.randrange(9))) for _ in range(400)}, key=str.encode)
    got = fingerprints.with_next(spark.createDataFrame([(i, i) for i in names], "doc_id string, text string").repartition(5), ["text"]).collect()
    assert {r.doc_id: r.next_text for r in got} == dict(zip(names, names[1:] + names[:1]))
    rows = fingerprints.with_next(spark.createDataFrame([(None, str(i)) for i in range(200)] + [(1, "a")], "doc_id long, text string"), ["text"]).collect()
    after, at, seen = {r.text: r.next_text for r in rows}, "a", []
    while at not in seen:
        seen.append(at)
        at = after[at]
    assert len(seen) == 201 and at == "a"


def test_sentences_cover_the_text():
    rng = random.Random(3)
    bits = ["12:30", "http://x.org/a", "a,b", "word", "Word.", "end!", "\n", "  ", "é", "(so.)", "x;", "\t", "tail", "ß?"]
    for _ in range(300):
        raw = "".join(rng.choice(bits) + rng.choice(["", " "]) for _ in range(rng.randrange(120))).encode()
        at, word, hashes = substrings.sentences(raw)
        edges = [*at.tolist(), len(raw)]
        assert (not raw and not len(at)) or edges[0] == 0 and all(a < b for a, b in zip(edges, edges[1:]))
        assert b"".join(raw[a:b] for a, b in zip(edges, edges[1:])) == raw and len(hashes) == len(raw.split())
        gone = [{"at": i, "n": 1, "hash": i, "first": 0, "own": False} for i in range(len(at)) if rng.random() < 0.3]
        kept, n, runs, _ = substrings.strip(raw, gone)
        parts = [raw[a:b] for a, b in zip(edges, edges[1:])]
        assert kept == b"".join(p for i, p in enumerate(parts) if i not in {g["at"] for g in gone}) and n == len(gone) == sum(b - a for a, b in runs)
    assert len(substrings.sentences(b"x" * (1 << 18) + b" y. z")[2]) == 3


def test_dedup_against_all_spans(spark, monkeypatch):
    monkeypatch.setattr(substrings, "WORDS", 8)
    rng = random.Random(4)
    sentence = lambda: " ".join(f"w{rng.randrange(400)}" for _ in range(rng.randrange(1, 20))) + "."
    shared = [" ".join(sentence() for _ in range(4)) for _ in range(6)]
    docs = [(i, " ".join([sentence(), *(rng.choice([rng.choice(shared), sentence()]) for _ in range(rng.randrange(6)))])) for i in range(60)]
    got = {r.doc_id: r for r in substrings.dedup(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    first = {}
    for i, t in docs:
        at, word, hashes = substrings.sentences(t.encode())
        words, upto, k = t.lower().split(), [*word.tolist(), len(hashes)], len(word)
        long = lambda a, b: b - a >= 2 and upto[b] - upto[a] >= 8
        spans = {(a, b) for a in range(k) for b in range(a + 2, k + 1) if long(a, b) and (not long(a, b - 1) or not long(a + 1, b))}
        keep = [True] * k
        for a, b in sorted(spans):
            if first.setdefault(tuple(words[upto[a] : upto[b]]), (i, a)) != (i, a):
                keep[a:b] = [False] * (b - a)
        edges = [*at.tolist(), len(t.encode())]
        assert got[i].text == b"".join(t.encode()[edges[j] : edges[j + 1]] for j in range(k) if keep[j]).decode() and got[i].n_removed == keep.count(False)


def test_long_passages_without_sentences(spark):
    rng = random.Random(5)
    word = lambda: f"w{rng.randrange(10**6)}"
    passage = " ".join(word() for _ in range(80))
    docs = [(i, " ".join([*(word() for _ in range(rng.randrange(5, 30))), passage, *(word() for _ in range(9))])) for i in range(2)]
    got = {r.doc_id: r.text for r in substrings.dedup(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got[0] == docs[0][1] and len(got[1].split()) < len(docs[1][1].split()) - 30 and set(got[1].split()) >= set(docs[1][1].split()) - set(passage.split())


@pytest.mark.parametrize("name", ["dots", "dashes", "mixed", "many", "spaces"])
def test_secrets_in_long_texts(spark, name):
    n = 1 << 20
    text = {
        "dots": "host = a" + ".b" * (n // 2), "dashes": "user=abc " + "a-" * (n // 2), "mixed": "user: abc " + "aB1" * (n // 3),
        "many": "token = abcdefgh12345 " * 5000, "spaces": "user = abc password" + " " * n + "x",
    }[name]
    df = spark.createDataFrame([(1, text, 5)], "doc_id long, text string, _key int")
    began = time.time()
    found, clean = secrets.secret_spans(df).first().spans, secrets.redact(df).first()
    assert time.time() - began < 20 and clean._key == 5
    if name == "many":
        assert len(found) == 5000 and clean.text == "[SECRET] " * 5000
    if name in ("dots", "dashes", "spaces"):
        assert clean.text == text


def test_ppm_against_a_plain_version(spark, monkeypatch):
    rng = random.Random(6)
    texts = [(i, " ".join(rng.choice(["the", "cat", "sat", "mat", f"x{rng.randrange(30)}"]) for _ in range(rng.randrange(25)))) for i in range(40)]
    train, order = [t for i, t in texts if i < 30], lm.ORDER
    counts = [{} for _ in range(order + 1)]
    for t in train:
        s = b"\n" * order + t.encode() + b"\n"
        for at in range(order, len(s)):
            for k in range(order + 1):
                c = counts[k].setdefault(s[at - k : at], {})
                c[s[at]] = c.get(s[at], 0) + 1

    def score(t):
        s, total = b"\n" * order + t.encode() + b"\n", 0.0
        for at in range(order, len(s)):
            out = set()
            for k in range(order, -1, -1):
                if (c := counts[k].get(s[at - k : at])) is None:
                    continue
                rest = {b: 2 * n - 1 for b, n in c.items() if b not in out}
                if not rest:
                    continue
                t_, q = sum(rest.values()), len(rest)
                if s[at] in rest:
                    total += math.log10(rest[s[at]] / (t_ + q))
                    break
                total += math.log10(q / (t_ + q))
                out |= set(c)
            else:
                total -= math.log10(max(1, 256 - len(counts[0].get(b"", {}))))
        return total

    df = spark.createDataFrame(texts, "doc_id long, text string")
    for most in (1 << 20, 10):
        monkeypatch.setattr(lm, "MOST_NODES", most)
        got = {r.doc_id: r.score for r in lm.with_scores(df, df.where("doc_id < 30"))[0].collect()}
        assert all(math.isclose(got[i], score(t), rel_tol=1e-5) for i, t in texts)


def test_language_is_rejected_or_undetermined(spark):
    rng = random.Random(7)
    parts = {"en": "the of and ing tion er".split(), "de": "sch ung ein der und heit".split()}
    docs = [(i, " ".join("".join(rng.choice(parts[x]) for _ in range(3)) for _ in range(40)), x) for i in range(400) for x in [("en", "de")[i % 2]]]
    model = langid.train(spark.createDataFrame(docs, "doc_id long, text string, lang string"))
    assert 0.003 < model["temperature"] < 40
    odd = ["½ ² ³ ¼", "12 34 !!", "", None, "Это длинное предложение на русском языке, которое никто не учил распознавать", docs[0][1], "½ " + docs[1][1]]
    told = {r.doc_id: r for r in langid.with_language(spark.createDataFrame([(i, t) for i, t in enumerate(odd)], "doc_id long, text string"), model).collect()}
    assert [told[i].lang_pred for i in range(len(odd))] == ["und"] * 5 + ["en", "de"] and told[0].lang_score == 0.0 and told[4].lang_score < 0.5


def test_masks_miss_all_substitutions():
    for n in range(1, decontam.STRETCH + 1):
        free = n - math.ceil(decontam.AGREE * n - 1e-9)
        for gone in combinations(range(n), free):
            places = [(s, m) for at, m in decontam.masks(n) for s in ([at] if n < decontam.STRETCH else range(n - len(m) + 1))]
            assert any(all(c == "0" or s + i not in gone for i, c in enumerate(m)) for s, m in places)


@pytest.mark.parametrize("kind", ["short", "string"])
def test_overlaps_against_all_alignments(spark, kind):
    rng = random.Random(8)
    word = lambda: f"w{rng.randrange(40)}"
    items = [[word() for _ in range(rng.choice([3, 5, 7, 9, 11, 13, 20, 40]))] for _ in range(30)]
    docs = []
    for _ in range(120):
        w = [word() for _ in range(rng.randrange(60))]
        for _ in range(rng.randrange(2)):
            part = [x if rng.random() > 0.12 else word() for x in rng.choice(items)]
            at = rng.randrange(len(w) + 1)
            w[at:at] = part
        docs.append(w)
    want = set()
    for i, w in enumerate(docs):
        for j, it in enumerate(items):
            size = min(13, len(it))
            for shift in range(size - len(it), len(w) - size + 1):
                same = [it[a] == w[a + shift] for a in range(max(0, -shift), min(len(it), len(w) - shift))]
                if any(sum(same[k : k + size]) >= 0.8 * size for k in range(len(same) - size + 1)):
                    want.add((i, j))
    d = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(docs)], "doc_id long, text string")
    b = spark.createDataFrame([(j, " ".join(it)) for j, it in enumerate(items)], "item_id long, text string").withColumn("item_id", F.col("item_id").cast(kind))
    assert {(r.doc_id, int(r.item_id)) for r in decontam.overlaps(d, b).collect()} == want


def test_repeated_words_are_looked_at_once():
    item, doc = np.full(800, 5, np.uint64), np.full(4000, 5, np.uint64)
    assert all(len(decontam.windows(x, m)[0]) <= 8 for x in (item, doc) for _, m in decontam.masks(13))


@pytest.mark.parametrize("name", ["with-sidebar", "layout has-sidebar", "page comments-enabled", "no-banner wrap", "site search-results", "share-enabled entry"])
def test_wrappers_are_no_sidebars(name):
    body = "".join(f"<p>Paragraph {i} with a good many words and more of them in it.</p>" for i in range(6))
    for inner in (body, f"<article><h1>T</h1>{body}</article>"):
        got = htmltext.main_text(f"<html><body><nav><a href=1>x</a></nav><div class='{name}'>{inner}<aside>zz</aside></div><footer>f</footer></body></html>")
        assert got.count("Paragraph") == 6 and "zz" not in got


def test_pages_in_linear_time_and_odd_pages(spark):
    for page in ("<b>" * 30000 + "</i>" * 30000 + "x", "<i><div>" + "<b>" * 30000 + "</i>" * 30000 + "x"):
        began = time.time()
        assert htmltext.main_text(page) == "x" and time.time() - began < 3
    assert htmltext.main_text("<p>Let <math><mi>x</mi><mo>=</mo><mn>2</mn></math> hold.</p>") == "Let x=2 hold."
    rows = [(1, "u", None), (1, "u", None), (2, None, ""), (None, "u", "<p>a</p>" * 20000), (3, "u", "<p>x &eacute;</p>")]
    out = htmltext.with_main_text(spark.createDataFrame([(*r, 1, "t") for r in rows], "page_id long, url string, html string, n_chars int, text string")).collect()
    assert sorted((str(r.page_id), len(r.text), r.n_chars) for r in out) == sorted((str(i), n, n) for i, n in ((1, 0), (1, 0), (2, 0), (None, 39999), (3, 3)))


def test_density_by_recursion():
    page = "<body><div><p>Some words here with <a href=1>link</a></p><p>More of the words<br>and on</p></div><div><a href=2>a</a><a href=3>b</a></div><nav>not this</nav></body>"
    root = htmltext.parse(page)
    nodes = htmltext.measure(root)

    def counts(n):
        c = t = lc = lt = 0
        for p in n.parts:
            if isinstance(p, str):
                c += len(p.strip())
            elif p.tag != "nav":
                a = counts(p)
                c, t, lc, lt = c + a[0], t + a[1] + (p.tag != "br"), lc + a[2], lt + a[3] + (p.tag == "a")
        return c, t, c if n.tag == "a" else lc, lt

    all_c, _, all_lc, _ = counts(root)
    assert (all_c, all_lc) == (len("Some words here with") + 4 + len("More of the words") + len("and on") + 2, 6) and "nav" not in [n.tag for n in nodes]
    for n in nodes:
        c, t, lc, lt = counts(n)
        assert (n.chars, n.tags, n.link_chars, n.link_tags) == (c, t, lc, lt)
        if c:
            base = math.log(c / max(1, c - lc) * lc + all_lc / all_c * c + math.e)
            want = c / max(1, t) * math.log(c / max(1, lc) * max(1, t) / max(1, lt) + 1) / math.log(max(base, 1.0001) + 1)
            assert math.isclose(n.density, want)


def test_risk_gradient_by_differences():
    """One step of the fit goes along the gradient of the risk, as differences of it tell."""
    rng = np.random.default_rng(3)
    pos, unl, size, prior = [rng.choice(6, 3, replace=False) for _ in range(20)], [rng.choice(6, 2, replace=False) for _ in range(50)], 6, 0.2

    def risk(w):
        f = lambda texts: np.array([w[t].sum() + w[-1] for t in texts])
        fp, fu = f(pos), f(unl)
        clean = np.logaddexp(0, fu).mean() - prior * np.logaddexp(0, fp).mean()
        assert clean >= 0
        return prior * np.logaddexp(0, -fp).mean() + clean

    weights, bias = toxicity.fit(pos, unl, size, prior, rounds=1, rate=1.0, decay=0.0)
    start = np.r_[np.zeros(size), -2.0]
    gradient = np.array([(risk(start + d) - risk(start - d)) / 2e-5 for d in np.eye(size + 1) * 1e-5])
    # Adam's first step has the length of the rate, against the sign of the gradient.
    assert np.allclose(np.r_[weights, bias] - start, -np.sign(gradient), atol=1e-3)
    weights, bias = toxicity.fit(pos, unl, size, prior, rounds=2000, rate=0.05, decay=0.0)
    assert risk(np.r_[weights, bias]) < risk(start)


def test_toxic_columns_can_be_kept(spark):
    df = spark.createDataFrame([(1, "a", 9)], "doc_id long, text string, toxic int")
    out = toxicity.with_score(df, ({"a": 9.0}, -1.0), score="s", flag="f").first()
    assert (out.toxic, out.f) == (9, 1) and out.s > 0.99
    assert toxicity.with_score(df, ({"a": 9.0}, -1.0)).first().toxic == 1


def test_texts_are_taken_by_bytes():
    import pyarrow as pa

    b = pa.RecordBatch.from_arrays([pa.array(["x" * n if n else None for n in (3 << 20, 10, 1 << 20, 1 << 20, 1 << 20, 0, 5)] + ["y"] * 2000)], ["text"])
    cut = list(common.few_texts([b]))
    assert pa.Table.from_batches(cut).column("text").to_pylist() == b.column("text").to_pylist()
    assert max(c.num_rows for c in cut) <= common.TEXT_ROWS and cut[0].num_rows == 1


def test_stages_are_deleted(spark):
    df = common.staged(spark.range(3), "gone")
    (folder,) = {f.rpartition("/")[0].replace("file://", "") for f in df.inputFiles()}
    assert os.path.isdir(folder)
    common.unstage(df, spark.range(3))
    assert not os.path.exists(folder)


def test_boilerplate_pairs(spark):
    """Pairs at 0.802 among documents that all share boilerplate, the rest at 0.72: none is lost."""
    rng = random.Random(9)
    own = lambda n: [f"o{rng.randrange(10**9)}" for _ in range(n)]
    frame, docs = [f"b{i}" for i in range(92)], []
    for _ in range(150):
        mine = own(9)
        docs += [frame + mine[:1] + own(8), frame + mine[:1] + own(8)]
    runs = lambda w: {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
    sets = [runs(w) for w in docs]
    alike = {(i, j) for i in range(len(docs)) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])}
    got = {r.doc_id: r.component_id for r in simhash.near_copies(spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(docs)], "doc_id long, text string")).collect()}
    assert len(alike) >= 150 and all(got[i] == got[j] for i, j in alike)
