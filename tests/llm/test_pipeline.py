"""The pipeline's stages against brute-force versions, each on what the one before kept."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from reelgrid.llm import jaccard
from tests.llm.test_operators import ODD, brute_components, brute_exact, brute_hits, texts


@pytest.fixture(scope="module")
def stages(spark, sf):
    docs, out = spark.read.parquet(f"{sf}/documents.parquet"), []
    for _, stage in pipeline.STAGES:
        docs = pipeline.written(stage(spark, docs, sf), "test")
        out.append(docs)
    return out


def test_stages(spark, sf, stages):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    language, exact, near, clean, packed = stages
    for df in (language, exact, near, clean):
        assert df.columns == docs.columns
    kept = {r["doc_id"] for r in language.collect()}
    assert len(kept) >= 0.97 * docs.count()
    assert {i for i, _ in texts(exact)} == {k[0] for k in brute_exact(texts(language)) if k[3]}
    assert {i for i, _ in texts(near)} == {k[0] for k in brute_components(texts(exact), 5, 8, 10) if k[0] == k[2]}
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    assert {i for i, _ in texts(clean)} == {k[0] for k in brute_hits(texts(near), items, 10) if not k[2]}
    assert {r["doc_id"] for r in packed.collect()} == {i for i, _ in texts(clean)}


def test_odd_rows(spark, sf):
    """Nulls, empty texts and extra columns pass through every stage; an empty table stays empty."""
    rows = [(i, t, lang, None, n, "k", "x") for i, t, lang, n in ODD]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, h string, component_id string")
    for name, stage in pipeline.STAGES:
        assert stage(spark, docs, sf).columns[:1] == ["doc_id"], name
        stage(spark, docs, sf).count()
        assert stage(spark, docs.limit(0), sf).count() == 0


def test_rows_without_unique_ids(spark, sf):
    """Every stage decides by row: whole repeats, rows without an id, and one id with several texts."""
    bad = spark.read.parquet(f"{sf}/benchmark.parquet").where("size(split(text, ' ')) > 12").first()["text"]
    near = " ".join(f"w{k}" for k in range(60))
    extra = [(20, "one text"), (20, "one text"), (20, "another text"), (None, "one text"), (None, "no other has this"), (None, near), (None, near + " x"), (21, near + " y"), (21, "clean with that id"), (22, bad), (22, "clean beside it"), (None, bad)]
    rows = [(i, t) for i, t, *_ in ODD] + extra
    make = lambda some: spark.createDataFrame([(i, t, "en", None, 1) for i, t in some], "doc_id long, text string, lang string, source string, n_chars long")
    exact = texts(pipeline.exact_dedup(spark, make(rows), sf))
    squeeze = lambda t: "".join((t or "").split(" ")).translate({ord(c): None for c in "\t\n\x0b\x0c\r"})
    best = {}
    for i, t in rows:
        order = (-len(t or ""), i is not None, i or 0)
        best[squeeze(t)] = min(best.get(squeeze(t), (order, i, t)), (order, i, t), key=lambda x: x[0])
    assert Counter(exact) == Counter((i, t) for _, i, t in best.values())
    got = texts(pipeline.near_dedup(spark, make(rows), sf))
    groups = {}
    numbered = list(enumerate(t for _, t in rows))
    for n, size, root in brute_components(numbered, 5, 8, 10):
        groups.setdefault(root if size else (n,), []).append(rows[n])
    low = [min(g, key=lambda r: (r[0] is not None, r[0] or 0)) for g in groups.values()]
    assert Counter(i for i, _ in got) == Counter(i for i, _ in low)
    clean = texts(pipeline.decontaminated(spark, make(rows), sf))
    assert Counter(clean) == Counter((i, t) for i, t in rows if t != bad)


def test_run(spark, sf):
    assert pipeline.run(spark, sf).count() > 0 and len(pipeline.STAGES) == 5


def test_hot_cells(spark, monkeypatch):
    """Cells that are dealt with as hot give the same components."""
    monkeypatch.setattr(jaccard, "SAMPLE", 1)
    monkeypatch.setattr(jaccard, "HOT", 10**9)
    words = [f"w{k}" for k in range(60)]
    rows = [(i, " ".join([*words[:30], f"x{i}", *words[30:]])) for i in range(120)] + [(1000 + i, f"alone {i} " * 9) for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for num in (8, 9):
        got = jaccard.near_duplicates(df, shingle=2, num=num)
        assert {tuple(r) for r in got.collect()} == set(brute_components(texts(df), 2, num, 10))


def test_hidden_by_nothing(spark, sf, stages):
    """A clean document is in no contaminated or repeated group, so it reaches the end."""
    end = stages[3].select("doc_id")
    assert end.join(stages[0].groupBy(F.sha2("text", 256).alias("h")).agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("n")).where("n = 1").select("doc_id"), "doc_id").count() > 0
