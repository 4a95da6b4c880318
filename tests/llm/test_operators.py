"""Odd rows through every operator, and brute-force comparisons on small tables."""

import hashlib
import math
import os
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from webloom.llm.common import staged
from webloom.llm import decontam, fingerprints, htmltext, langid, lm, mixing, secrets, simhash, substrings, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, target string, toxic string, fingerprint string"


def odd(spark, rows=None):
    words = [f"w{i}" for i in range(300)]
    base = [(1, None), (2, ""), (3, " \t\n"), (4, "one"), (4, "one"), (None, None), (None, "x y z"), (5, "é ñ ß " * 20000), (6, " ".join(words)), (7, " ".join(words)), (8, "1 2 3 !!")]
    rows = base if rows is None else rows
    return spark.createDataFrame([(i, t, None, None if n % 2 else "s", None, None, "c", "d", None) for n, (i, t) in enumerate(rows)], SCHEMA)


def test_odd_rows(spark):
    docs, n = odd(spark), 11
    bench = spark.createDataFrame([(1, None), (2, ""), (3, "w1 w2 w3 w4 w5 w6 w7 w8 w9 w10 w11 w12 w13 w14")], "item_id long, text string")
    labels = spark.createDataFrame([(6, 1), (None, None), (4, 0)], "doc_id long, toxic int")
    assert substrings.dedup(docs).count() == n
    assert secrets.secret_spans(docs).count() == n and secrets.redact(docs).count() == n
    assert secrets.redact(docs).columns == docs.columns
    assert mixing.mix(docs).count() == n
    assert simhash.near_groups(docs).count() == n
    copies = simhash.near_copies(docs).collect()
    assert len(copies) == n and {r.component_id for r in copies if r.doc_id in (6, 7)} == {6} and {r.component_id for r in copies if r.doc_id in (1, 2, 3)} == {1}
    assert lm.with_scores(docs, docs)[0].count() == n
    assert toxicity.with_score(docs.drop("toxic"), toxicity.train(docs, labels)).count() == n
    assert [r.lang_pred for r in langid.with_language(docs, langid.train(docs)).collect()] == ["und"] * n
    assert {r.doc_id for r in decontam.overlaps(docs, bench).collect()} == {6, 7}
    kept = fingerprints.with_next(fingerprints.fingerprint(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), F.col("text"), "fp"), ["text", "fp"])
    assert kept.count() == n
    assert {r.next_text for r in kept.where("doc_id = 8").collect()} <= {"", "x y z"}


def test_empty_tables(spark):
    docs = odd(spark, [])
    bench = spark.createDataFrame([], "item_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    for df in (
        substrings.dedup(docs), secrets.secret_spans(docs), mixing.mix(docs), simhash.near_groups(docs), simhash.near_copies(docs), lm.with_scores(docs, docs)[0],
        toxicity.with_score(docs.drop("toxic"), toxicity.train(docs, labels)), langid.with_language(docs, langid.train(docs)), decontam.overlaps(docs, bench),
        fingerprints.with_next(docs, ["text"]), htmltext.with_main_text(spark.createDataFrame([], "page_id long, url string, html string")),
    ):
        assert df.count() == 0


def test_fingerprints_estimate_similarity(spark):
    rng = random.Random(1)
    a = [f"w{rng.randrange(9999)}" for _ in range(2000)]
    b = a[:1500] + [f"v{i}" for i in range(500)]
    df = spark.createDataFrame([(" ".join(a), " ".join(b), "", "")], "a string, b string, c string, d string")
    for c in "abcd":
        df = fingerprints.fingerprint(df, F.col(c), f"f{c}")
    r = df.select(fingerprints.likeness(F.col("fa"), F.col("fb")), fingerprints.likeness(F.col("fa"), F.col("fa")), fingerprints.likeness(F.col("fc"), F.col("fd")), F.size("fa")).first()
    assert abs(r[0] - 0.6) < 0.15 and r[1] == 1.0 and r[2] == 1.0 and r[3] == fingerprints.BINS


def test_next_row(spark):
    ids = [random.Random(2).randrange(10**6) for _ in range(700)]
    ids = sorted(set(ids))
    got = fingerprints.with_next(spark.createDataFrame([(i, str(i)) for i in ids], "doc_id long, text string").repartition(5), ["text"]).collect()
    assert {r.doc_id: int(r.next_text) for r in got} == dict(zip(ids, ids[1:] + ids[:1]))


def test_repeated_spans(spark):
    passage = " ".join(f"Alpha{i} beta{i} gamma{i} delta{i} eps{i} zeta{i} eta{i}." for i in range(8))
    docs = [(1, f"Own words here one. {passage} And more of one."), (2, f"Other text of two. {passage} The end of two."), (3, "Nothing that repeats is here. At all.")]
    got = {r.doc_id: r for r in substrings.dedup(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got[1].n_removed == 0 and got[1].text == docs[0][1] and got[3].text == docs[2][1]
    assert "gamma" not in got[2].text and got[2].kept_in == [1] and got[2].text == "Other text of two. The end of two."


def test_language_model_is_a_distribution_and_base_is_exact(spark):
    docs = [(i, t) for i, t in enumerate(["the cat sat", "the dog sat", "a cat ran", "", "The CAT"])]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    out, tokens, kinds = lm.with_scores(df, df.where("doc_id < 4"))
    count = Counter(w for _, t in docs[:4] for w in [*t.lower().split(), "\n"])
    assert (tokens, kinds) == (sum(count.values()), len(count))
    for r in out.collect():
        w = [*docs[r.doc_id][1].lower().split(), "\n"]
        assert math.isclose(r.base_score, sum(math.log10((count[x] + 1) / (tokens + kinds + 1)) for x in w))
        assert r.n_known == sum(count[x] > 0 for x in w) and r.score < 0
    text = b"the cat sat the dog sat"
    keys = np.concatenate([k for k, _ in lm._windows(b"\n" * lm.ORDER + text)])
    nodes = []
    for k in range(lm.ORDER + 1):
        key, n = np.unique(keys & ((1 << (8 * (k + 1))) - 1), return_counts=True)
        nodes.append((key, n.astype(np.int64)))
    model = lm.trie(nodes)
    for context in (b"the c", b"xxxxx", b"t sat", b"\n\n\n\n\n", b"qthe "):
        every = np.array([int.from_bytes(context + bytes([s]), "big") for s in range(256)], np.int64)
        assert math.isclose((10 ** lm.log_probability(model, every)).sum(), 1.0, rel_tol=1e-5)


def test_language_model_keeps_rare_contexts(spark, monkeypatch):
    rng = random.Random(3)
    docs = [(i, " ".join(rng.choice(["cat", "dog", "sat", "mats", "ran", f"x{rng.randrange(50)}"]) for _ in range(40))) for i in range(30)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    score = lambda: {r.doc_id: r.score for r in lm.with_scores(df, df.where("doc_id < 20"))[0].collect()}
    want = score()
    for most in (0, 40):
        monkeypatch.setattr(lm, "MOST_NODES", most)
        got = score()
        assert got.keys() == want.keys() and all(math.isclose(got[i], want[i], rel_tol=1e-5) for i in want)


def test_secrets_against_re(spark):
    rng = random.Random(3)
    bits = ["password: hunter2hunter2", "token=short", "AKIA" + "Q" * 16, "AKIAAB", "0a" * 16, "é", 'API_KEY = "abcDEF123456"', "secret: token: abcdefghijk", "words and words", "\n"]
    docs = [(i, " ".join(rng.choice(bits) for _ in range(rng.randrange(8)))) for i in range(200)]
    got = {r.doc_id: r for r in secrets.secret_spans(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    patterns = ((r"""((?:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8, re.I | re.A), (r"AKIA[A-Z0-9]+", 0, 16, 0), (r"[0-9a-f]+", 0, 32, 0))
    for i, t in docs:
        want = sorted((m.start(), k, m.end()) for k, (p, g, n, f) in enumerate(patterns) for m in re.finditer(p, t, f) if len(m[g]) >= n)
        assert [(s["start"], s["rank"], s["end"]) for s in got[i].spans if s["rank"] < 3] == want


def test_linked_parts(spark):
    key = "wJalrXUtnFEMIK7MDENGbPxRfiCYzEXAMPLEKEY1"
    docs = [(1, f"user: alice99 then {key} at https://db.example.com/x"), (2, f"alone {key} here"), (3, "user: alice99 only"), (4, f"user: alice99 {'x ' * 400}{key}")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r.doc_id: [s["kind"] for s in r.spans] for r in secrets.secret_spans(df).collect()}
    assert got == {1: ["ident", "key", "endpoint"], 2: [], 3: [], 4: []}
    clean = {r.doc_id: r.text for r in secrets.redact(df).collect()}
    assert clean[1] == "[SECRET] then [SECRET] at [SECRET]" and clean[2] == docs[1][1]


def test_languages(spark):
    rng = random.Random(4)
    parts = {"en": "the of and ing tion er".split(), "de": "sch ung ein der und heit".split()}
    docs = [(i, " ".join("".join(rng.choice(parts[x]) for _ in range(3)) for _ in range(40)), x) for i in range(300) for x in [("en", "de")[i % 2]]]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    model = langid.train(df.where("doc_id < 200"))
    told = langid.with_language(df.where("doc_id >= 200"), model, reject=False).collect()
    assert np.mean([r.lang == r.lang_pred for r in told]) > 0.97 and all(0 <= r.lang_score <= 1 for r in told)


def test_leaks_with_substitutions(spark):
    item = [f"item{i}" for i in range(40)]
    swapped = [w if i % 9 else "other" for i, w in enumerate(item)]
    docs = [(1, "before " + " ".join(item) + " after"), (2, "x y " + " ".join(swapped)), (3, " ".join(item[:8])), (4, "clean text " * 30), (5, " ".join(reversed(item)))]
    bench = spark.createDataFrame([(7, " ".join(item)), (8, "a b c")], "item_id long, text string")
    got = {(r.doc_id, r.item_id): (r.first_word, r.end_word) for r in decontam.overlaps(spark.createDataFrame(docs, "doc_id long, text string"), bench).collect()}
    assert set(got) == {(1, 7), (2, 7)} and got[1, 7] == (1, 41)


def test_mix_reaches_targets(spark):
    rng = random.Random(5)
    docs = [(i, "w " * rng.randrange(200), rng.choice(["a", "b", "b", "b", "c", None])) for i in range(2000)]
    rows = mixing.mix(spark.createDataFrame(docs, "doc_id long, text string, source string")).collect()
    size, taken, target = Counter(), Counter(), {}
    for r in rows:
        size[r.source] += r.size
        taken[r.source] += r.taken
        target[r.source] = r.target
        assert r.taken <= 2 * r.size
    names, weights = ["a", "b", "c", None], dict(zip(["a", "b", "c", None], [5, 2, 1, 5], strict=True))
    left, want, open_ = 1.5 * sum(size.values()), {}, set(names)
    while over := [s for s in open_ if left * weights[s] / sum(weights[o] for o in open_) > 2 * size[s] + 1e-9]:
        for s in over:
            want[s] = 2.0 * size[s]
        open_ -= set(over)
        left = 1.5 * sum(size.values()) - sum(want.values())
    want |= {s: left * weights[s] / sum(weights[o] for o in open_) for s in open_}
    for s in names:
        assert math.isclose(target[s], want[s]) and abs(taken[s] - target[s]) <= 200


@pytest.mark.parametrize("few", [64, 3])
def test_simhash_groups(spark, few, monkeypatch):
    monkeypatch.setattr(simhash, "FEW", few)
    rng = random.Random(6)
    prints = [rng.getrandbits(64) for _ in range(150)]
    for _ in range(350):
        x = rng.choice(prints)
        for b in rng.sample(range(64), rng.randrange(1, 5)):
            x ^= 1 << b
        prints.append(x)
    prints = sorted(set(prints) | {0})
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    found = {(r.a, r.b) for r in simhash.links(spark.createDataFrame([(p,) for p in signed], "fp long")).collect()}
    root = {p: p for p in signed}

    def up(parents, x):
        while parents[x] != x:
            x = parents[x]
        return x

    mine = dict(root)
    for a, b in found:
        mine[up(mine, a)] = up(mine, b)
    for i, a in enumerate(prints):
        for j in range(i):
            if (a ^ prints[j]).bit_count() <= 3:
                root[up(root, signed[i])] = up(root, signed[j])
    classes = lambda parents: {frozenset(x for x in signed if up(parents, x) == r) for r in {up(parents, x) for x in signed}}
    assert classes(mine) == classes(root)
    comps = {r.node: r.root for r in simhash.components(spark.createDataFrame(sorted(found), "a long, b long")).collect()}
    for a, b in found:
        assert comps[a] == comps[b]
    assert len(set(comps.values())) == sum(len(c) > 1 for c in classes(root))


@pytest.mark.parametrize("nearest", [simhash.LATEST + 1, simhash.NEAREST])
def test_near_copies_against_all_pairs(spark, monkeypatch, nearest):
    monkeypatch.setattr(simhash, "NEAREST", nearest)
    rng = random.Random(9)
    docs = []
    for group in range(40):
        base = [f"g{group}w{rng.randrange(400)}" for _ in range(rng.choice([4, 30, 150]))]
        for _ in range(rng.choice([1, 2, 5, 12])):
            text = [w if rng.random() > 0.01 * rng.randrange(4) else f"v{rng.randrange(10**6)}" for w in base]
            docs.append((len(docs), " ".join(text)))
    runs = lambda w: {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}
    sets = [runs(t.split()) for _, t in docs]
    alike = {(i, j) for i in range(len(docs)) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])}
    df = spark.createDataFrame(docs, "doc_id long, text string")
    found = {r.doc_id: r.component_id for r in simhash.near_copies(df).collect()}
    prints = {r.doc_id: int(r.fingerprint, 16) for r in simhash.near_groups(df).collect()}
    near = {(i, j) for i in range(len(docs)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 3}
    low = list(range(len(docs)))
    for _ in docs:
        for i, j in alike | near:
            low[i] = low[j] = min(low[i], low[j])
    assert len(alike - near) > 20 and found == dict(enumerate(low))


def test_near_copies_in_a_large_family(spark):
    rng = random.Random(5)
    own = lambda n: [f"o{rng.randrange(10**9)}" for _ in range(n)]
    template = [f"t{i}" for i in range(90)]
    texts = [template + own(rng.choice([12, 13])) for _ in range(2000)]  # 0.77 to 0.78 alike
    planted = [(i, len(texts) + i) for i in range(40)]
    texts += [texts[i][:94] + own(8) for i, _ in planted]  # 0.84
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string").repartition(4)
    bands = staged(simhash.with_bands(df).withColumn("component_id", F.col("doc_id")))
    some = {(r.a, r.b) for r in simhash.near_links(df, bands).collect()}
    every = some | {(r.a, r.b) for r in simhash.crowded_links(df, bands).collect()}
    assert some < set(planted) and every == set(planted)


def test_simhash_bits():
    t = "The quick brown fox jumps the quick brown fox jumps".encode()
    w = t.lower().split()
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 3]), 42) for i in range(len(w) - 2)]
    assert simhash.simhash(t) == sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
    assert simhash.simhash(b"") == 0 and simhash.simhash(b"a b") == xxhash.xxh64_intdigest(b"a b", 42)


def test_main_text():
    body = "".join(f"<p>Paragraph {i} with <a href=x>a link</a> and a good many words &amp; more of them.</p>" for i in range(5))
    page = f"<html><head><title>T</title></head><body><header><h2>Site</h2></header><nav><ul><li><a href=1>Home</a></ul></nav><div class='cookie-notice'>We use cookies.</div><article><header><h1>Head</h1></header>{body}<form><input>Send</form></article><aside>Side text</aside><section id=comments><p>I say this and that about it.</p></section><footer>&copy; us</footer></body></html>"
    want = "Head\n" + "\n".join(f"Paragraph {i} with a link and a good many words & more of them." for i in range(5))
    assert htmltext.main_text(page) == want
    assert htmltext.main_text("") == "" and htmltext.main_text("plain  text\n here") == "plain text here"
    assert htmltext.main_text("<div>" * 5000 + "deep") == "deep"


def test_main_text_is_whole():
    p = lambda name, n: f"<p>{(name + ' ') * (n // (len(name) + 1))}</p>"
    parts = "<h1>Head</h1>" + p("lead", 300) + f"<div>{p('body', 300) * 10}</div><div>{p('more', 150) * 5}</div><section><h2>Sub</h2><ul><li>first point</li><li>second point</li></ul></section>bare text"
    links = "<div>" + "".join(f"<a href={i}>Other story {i}</a> " for i in range(20)) + "</div>"
    for page in (f"<article>{parts}<aside>Side</aside></article>", f"<main>{parts}<nav>Side</nav></main>", f"<div>{parts}<div class='sidebar'>Side</div></div>"):
        got = htmltext.main_text(f"<html><body>{links}{page}{links}</body></html>")
        words = Counter(got.split())
        assert (words["lead"], words["body"], words["more"]) == (60, 600, 150)
        assert all(x in got for x in ("Head", "Sub", "first point", "second point", "bare text")) and "Side" not in got and "Other" not in got


def test_toxic_words(spark):
    rng = random.Random(7)
    docs = []
    for i in range(900):
        w = [f"w{chr(97 + rng.randrange(26))}{chr(97 + rng.randrange(26))}" for _ in range(60)]
        if bad := i % 9 == 0:
            w[5], w[30] = "vileword", "nastyword"
        docs.append((i, " ".join(w), bad))
    df = spark.createDataFrame([d[:2] for d in docs], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(bad)) for i, _, bad in docs if i % 2], "doc_id long, toxic int")
    got = {r.doc_id: r.toxic for r in toxicity.with_score(df, toxicity.train(df, labels)).collect()}
    assert np.mean([got[i] == bad for i, _, bad in docs]) > 0.98


def test_contract_folds(spark):
    df = spark.range(50).withColumnRenamed("id", "doc_id").withColumn("f", __import__("webloom.llm.common", fromlist=["fold"]).fold("doc_id", 7))
    assert all(r.f == zlib.crc32(str(r.doc_id).encode()) % 7 for r in df.collect())


def test_edited_text_digest(spark):
    if not os.path.isdir("/root/testdata/sf0.001"):
        pytest.skip("no tables")
    import pandas as pd

    d = pd.read_parquet("/root/testdata/sf0.001/documents.parquet").sort_values("doc_id")
    t = d.text.tolist()
    want = {i: hashlib.sha256((x[: len(x) - len(x) // 4] + n[: len(x) // 4]).encode()).hexdigest() for i, x, n in zip(d.doc_id, t, t[1:] + t[:1], strict=True)}
    assert {r.doc_id: r.edited_sha256 for r in fingerprints.op1_fingerprints(spark, "/root/testdata/sf0.001").collect()} == want
