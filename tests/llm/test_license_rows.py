"""Licence scans: units meet their other terms' frequencies, and are not multiplied by templates."""

import re

from reelgrid.llm import licenses


def test_units_are_not_multiplied_by_templates(spark, monkeypatch):
    plans = {}

    def noted(df, name, keep=False, of=licenses.written):
        plans[name] = df._jdf.queryExecution().optimizedPlan().toString()
        return of(df, name, keep)

    monkeypatch.setattr(licenses, "written", noted)
    notice = licenses.NOTICES["MIT"][1].split(" ")
    wrapped = "\n".join(" ".join(notice[i : i + 9]) for i in range(0, len(notice), 9))
    files = [(1, "a/LICENSE", f"Copyright by someone\n{wrapped}"), (2, "a/x.py", "code"), (3, "b/y.py", "# Released under the MIT License, surely\ncode")]
    got = licenses.scan(spark.createDataFrame(files, "doc_id long, path string, text string"))
    assert {r["doc_id"]: (r["license"], r["via"]) for r in got.collect()} == {1: ("MIT", "file"), 2: ("MIT", "inherited"), 3: ("MIT", "header")}
    for name in ("lines", "best"):  # units of single lines, and of runs of lines
        assert len(re.findall(r"Join Inner, \(term#\d+ = term#\d+\)", plans[name])) == 1, name  # one join by term, with the frequencies
