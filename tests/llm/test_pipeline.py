"""The pipeline's stages on odd rows, on empty tables, and against plain Python."""

import os
import random
import re
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

corpus_pipeline = pytest.importorskip("corpus_pipeline")

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, toxic int, copy string, _id string, _key long, row string, toxicity double"


def rows(texts):
    return [(i, t, "en", s, None if t is None else len(t), 9, "c", "i", 4, "r", 0.5) for i, t, s in texts]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("tables"))
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    item = [word() for _ in range(30)]
    texts, kind = [], {}
    for i in range(240):
        w = [word() for _ in range(rng.randrange(40, 90))]
        if i % 8 == 0:
            kind[i] = "toxic"
            w[3], w[20] = "vilewords", "nastywords"
        elif i % 12 == 5:
            kind[i] = "leak"
            w[10:10] = [x if n != 7 else "swapped" for n, x in enumerate(item)]
        elif i % 12 == 7:
            kind[i] = "secret"
            w[5:5] = ["password:", "hunter2hunter2"]
        texts.append((i, " ".join(w), f"s{i % 3}"))
    for i in range(240, 260):  # near copies of clean documents
        w = texts[(i - 240) * 12 + 2][1].split()
        w[-1] = "other"
        kind[i] = "copy"
        texts.append((i, " ".join(w), "s1"))
    odd = [(300, None, "s0"), (301, "", None), (None, "no name here", "s1"), (None, "no name here", "s1"), (None, "another without one", "s1"), (302, "twice", "s0"), (302, "twice", "s0"), (302, "thrice", "s0")]
    spark.createDataFrame(rows(texts + odd), SCHEMA).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, int(kind.get(i) == "toxic")) for i in range(200)] + [(None, 1), (4, None)], "doc_id long, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(0, " ".join(item)), (1, None), (2, "")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    empty = str(tmp_path_factory.mktemp("empty"))
    for name, schema in (("documents", SCHEMA), ("labels", "doc_id long, toxic int"), ("benchmark", "item_id long, text string")):
        spark.createDataFrame([], schema).write.parquet(f"{empty}/{name}.parquet")
    return folder, empty, kind, len(texts + odd)


def test_stages(spark, tables):
    folder, _, kind, n = tables
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = [f.simpleString() for f in docs.schema]
    own = lambda df: sorted(df.select(*docs.columns).collect(), key=str)
    before = own(docs)
    out = corpus_pipeline.drop_toxic(spark, docs, folder)
    assert [f.simpleString() for f in out.schema] == columns
    assert own(out) == [r for r in before if kind.get(r.doc_id) != "toxic"]
    out = corpus_pipeline.drop_near_copies(spark, docs, folder)
    got = own(out)
    assert [f.simpleString() for f in out.schema] == columns
    assert {r.doc_id for r in got} == {r.doc_id for r in before} - {i for i, k in kind.items() if k == "copy"} - {301}  # 300 and 301 are both empty
    assert sorted(r.text for r in got if r.doc_id is None or r.doc_id == 302) == ["another without one", "no name here", "thrice", "twice"]
    out = corpus_pipeline.drop_leaks(spark, docs, folder)
    assert [f.simpleString() for f in out.schema] == columns and own(out) == [r for r in before if kind.get(r.doc_id) != "leak"]
    out = corpus_pipeline.mask_secrets(spark, docs, folder)
    assert [f.simpleString() for f in out.schema] == columns and out.count() == n
    for r, b in zip(sorted(out.collect(), key=lambda r: str(r.doc_id)), sorted(before, key=lambda r: str(r.doc_id)), strict=True):
        if kind.get(b.doc_id) == "secret":
            assert r.text == re.sub(r"password: hunter2hunter2", "[SECRET]", b.text) and r.n_chars == len(r.text)
    out = corpus_pipeline.mix_sources(spark, docs, folder)
    assert out.columns == [*docs.columns, "_copy"]
    times = {}
    for r in out.collect():
        times.setdefault((r.doc_id, r.text), []).append(r["_copy"])
    assert all(max(v) <= 2 for v in times.values())


def test_run_keeps_clean_documents(spark, tables):
    folder, empty, kind, _ = tables
    ids = {r.doc_id for r in corpus_pipeline.run(spark, folder).collect()}
    assert not ids & {i for i, k in kind.items() if k in ("toxic", "leak", "copy")}
    assert corpus_pipeline.run(spark, empty).count() == 0
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, spark.read.parquet(f"{empty}/documents.parquet"), empty).count() == 0
