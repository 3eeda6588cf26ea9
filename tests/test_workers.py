"""Steps that need one pass of Python have one worker a task (the fold of tabs has one before and one after its shuffle): their number bounds an executor's memory, whatever the size of the tables."""

import pytest

import __spark_entry__ as entry


def python_nodes(df):
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return sum(plan.count(name) for name in ("MapInArrow", "MapInPandas", "ArrowEvalPython", "BatchEvalPython"))


@pytest.mark.parametrize(("name", "most"), [("page_media", 1), ("hls_segments", 1), ("tab_outcomes", 2)])
def test_workers(spark, sf, name, most):
    assert python_nodes(entry.queries()[name](spark, sf)) == most


def test_commits(spark, sf, tmp_path, monkeypatch):
    """A batch of a stream commits what it changed of its state."""
    monkeypatch.setattr("reelgrid.queries.shared_dir", lambda spark: f"file://{tmp_path}")
    entry.queries()["stream_pending"](spark, sf).count()
    assert any(tmp_path.rglob("*.changelog"))
