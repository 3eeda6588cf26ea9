"""Regions of the near-duplicate join: sketches drop what cannot be linked, and nothing else."""

import numpy as np
from pyspark.sql import functions as F

from reelgrid.llm import jaccard


def test_sketches_escape_no_link():
    rng = np.random.default_rng(7)
    new = lambda n: np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
    for num, den in ((8, 10), (90, 100), (1, 3)):
        sets = []
        for n in (1, 2, 3, 9, 40, 41, 43, 85, 300, 2_000):
            base = new(n)
            for change in (0, 0.05, 0.1, 0.12, 0.2, 0.5):  # changed in part, and shortened: on both sides of the threshold
                cut = int(len(base) * change)
                sets += [np.union1d(base[cut:], new(cut // 2)), base[cut:]]
        sets = [s for s in sets if len(s)] + [new(200) for _ in range(20)]
        sizes = np.array([len(s) for s in sets])
        inter = np.array([[len(np.intersect1d(a, b)) for b in sets] for a in sets])
        linked = (den * inter >= num * (sizes[:, None] + sizes - inter)) & ~np.eye(len(sets), dtype=bool)
        found = jaccard.may_link([jaccard.sketch(s) for s in sets], sizes, num, den)
        assert not (linked.any(axis=1) & ~found).any()
        assert num / den < 0.5 or not found[-20:].any()  # sets that share nothing with any other


def test_texts_without_partner_stay(spark, monkeypatch):
    """Documents that share a passage lie in one region; only texts of those that may be linked are asked for."""
    rng = np.random.default_rng(3)
    words = lambda n: [f"w{k}" for k in rng.integers(0, 10**9, n)]
    passage = words(60)
    rows = [(i, " ".join(words(120) + passage + words(20))) for i in range(40)]
    rows += [(100, rows[5][1] + " more words at the end")]
    asked = {}

    def noted(df, name, keep=False, of=jaccard.written):
        asked[name] = of(df, name, keep)
        return asked[name]

    monkeypatch.setattr(jaccard, "written", noted)
    found = jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r["doc_id"]: r["component_id"] for r in found.collect()} == {i: 5 if i == 100 else i for i, _ in rows}
    assert asked["placed"].select(F.countDistinct("node")).first()[0] > 20  # they share parts
    assert asked["keys"].count() == 2
