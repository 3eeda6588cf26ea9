"""License scans: sparse TF-IDF cosine of headers and licence files to templates, then nearest-ancestor inheritance by path joins."""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelgrid.session import written

#: Short notices by which licences announce themselves in headers and licence files.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0",
    "MIT": "Released under the MIT License",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3",
    "LGPL-3.0": "This work is licensed under the GNU Lesser General Public License, version 3",
    "BSD-3-Clause": "Licensed under the BSD 3-Clause License",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
    "CC-BY-4.0": "Licensed under CC BY 4.0",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0",
    "Proprietary": "All rights reserved",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2",
    "AGPL-3.0": "This work is licensed under the GNU Affero General Public License, version 3",
    "BSD-2-Clause": "Licensed under the BSD 2-Clause License",
    "ISC": "Released under the ISC License",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
}
#: Longer notices of the same licences: standard headers, and titles with the opening of the full text.
NOTICES = {
    "Apache-2.0": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
        "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION",
    ),
    "MIT": (
        "The MIT License (MIT)",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
    ),
    "GPL-3.0": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
    ),
    "LGPL-3.0": (
        "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
    ),
    "BSD-3-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    ),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.", "Mozilla Public License Version 2.0"),
    "GPL-2.0": (
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
        "GNU GENERAL PUBLIC LICENSE Version 2, June 1991",
    ),
    "AGPL-3.0": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007",
    ),
    "BSD-2-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    ),
    "ISC": ("ISC License", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    "CC-BY-4.0": ("Creative Commons Attribution 4.0 International",),
    "CC-BY-NC-4.0": ("Creative Commons Attribution-NonCommercial 4.0 International",),
    "CC-BY-SA-4.0": ("Creative Commons Attribution-ShareAlike 4.0 International",),
}
#: A tag that names a licence by its SPDX identifier; what is behind it is taken as it stands, not by likeness.
TAG = "SPDX-License-Identifier:[ \\t]*\\(?([A-Za-z0-9][A-Za-z0-9.+-]*)"
#: Where two licences are this near for one unit, it speaks for neither.
MARGIN = 0.01
#: Numbers of adjacent lines that hold a term that make a unit, besides single lines.
SPANS = (2, 3, 4, 5, 6, 7, 8, 10, 12, 16, 20, 24)
#: Texts to be looked at for runs whose keys (16 bytes each) are broadcast at most; more are joined by a shuffle.
MAX_KEYS = 1_000_000
#: Names of licence files (lower case, without what follows a dot).
LICENCE_NAMES = ("license", "licence", "copying", "notice", "unlicense")


def terms(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda t: t != "")


def _counted(words: list[str]) -> dict[str, int]:
    return {w: words.count(w) for w in sorted(set(words))}


def scan(files: DataFrame, *, id_col: str = "doc_id", path_col: str = "path", text_col: str = "text", templates: dict[str, str] = TEMPLATES, notices: dict[str, tuple[str, ...]] = NOTICES, threshold: float = 0.8, margin: float = MARGIN, licence_names: tuple[str, ...] = LICENCE_NAMES) -> DataFrame:
    """One row per file: id, path, own_license, own_score, own_line, license, via (header, file, inherited or none), license_dir.

    Units are the lines of a file, and runs of adjacent lines that hold a term (of SPANS lines, or as many as there are), as headers and licence
    files wrap their text. Templates are `templates` and the longer `notices` of the same licences. A unit's vector has tf * idf of its
    terms, a template's likewise; idf is log((1 + lines) / (1 + lines with the term)) + 1 over all lines of all files,
    for every term, in the templates or not. A unit whose two nearest licences are within `margin` of each other
    speaks for neither. Of the other (unit, template) pairs with a cosine of `threshold` or more the highest wins (then the fewest lines, the earlier line, the licence's name). Files with a line of cosine 1 need no longer units.
    A line with an SPDX tag says what the tag says (without -only, -or-later or +), whether it is among the templates or not, with a score of 1.
    A file without a licence of its own takes that of the nearest ancestor directory that has a licence file (named as in `licence_names`; of several,
    the highest score, then the smallest path). The root directory is ''. Null paths are '' and inherit from the root; null and empty texts have no own
    licence; an empty table gives no rows; rows that repeat an id are rows of their own.

    Equal texts, and then equal units, are scored once. What can reach the threshold is found in each row by a bound, without a join: a line's dot products follow from the
    terms of the templates, and its size is no less than that of these terms and one for each other term, as no idf is under 1. For runs of lines both add up, as a
    run's squared size is no less than the sum of its lines'; they are looked at in texts that hold threshold^2 of a template's weight. Units within the bound are then
    vectorised as a whole. Document frequencies are partial aggregates by term. Broadcast are the templates and their terms, bounded by the parameter; other terms meet their frequencies in a shuffle.
    """
    two = lambda x: [F.xxhash64(F.lit(seed), x) for seed in (5, 23)]
    rows = files.select(F.col(id_col).alias("id"), F.coalesce(F.col(path_col), F.lit("")).alias("path"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    h1, h2 = two(F.col("text"))
    rows = rows.select("*", h1.alias("h1"), h2.alias("h2"))
    every_text = [(name, text) for name, text in templates.items()] + [(name, text) for name in templates for text in notices.get(name, ())]
    words = {(name, k): _counted([t for t in re.split("[^a-z0-9]+", text.lower()) if t]) for k, (name, text) in enumerate(every_text)}
    vocabulary = sorted({t for w in words.values() for t in w})
    lines = rows.select("h1", "h2", F.posexplode(F.split("text", "\n")).alias("line", "unit"))
    # Document frequencies of all terms, over every line; '' counts the lines.
    seen = written(lines.select(F.explode(F.concat(F.array(F.lit("")), F.array_distinct(terms(F.col("unit"))))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n")), "terms")
    counts = {r["term"]: r["n"] for r in seen.where(F.col("term").isin("", *vocabulary)).collect()}
    total = counts.get("", 0)
    idf = {t: math.log((1 + total) / (1 + counts.get(t, 0))) + 1 for t in vocabulary}
    weight = {name: {t: c * idf[t] for t, c in w.items()} for name, w in words.items()}
    norm = {name: math.sqrt(sum(x * x for x in w.values())) for name, w in weight.items()}
    anchors = set()
    for key, w in weight.items():
        rest = sum(x * x for x in w.values())
        for t in sorted(w, key=lambda t: (t not in anchors, -idf[t], t)):
            if math.sqrt(max(0.0, rest)) < threshold * norm[key] - 1e-9:
                break
            anchors.add(t)
            rest -= w[t] * w[t]
    anchored = lambda t: F.arrays_overlap(t, F.array(*[F.lit(t) for t in sorted(anchors)])) if anchors else F.lit(False)
    names = list(words)
    # Of each term of the templates: its idf, and its share in each template's vector. A constant of the plan.
    numbers = {t: [idf[t], *(weight[key].get(t, 0.0) / norm[key] for key in names)] for t in vocabulary}
    table = F.expr("map(" + ", ".join(f"'{t}', array({', '.join(f'{x!r}D' for x in y)})" for t, y in numbers.items()) + ")") if vocabulary else F.expr("map('', array(0D))")
    listed = F.array(*[F.lit(t) for t in vocabulary]).cast("array<string>")
    none = F.array_repeat(F.lit(0.0), len(names))
    weights = seen.select("term", (F.log(F.lit(1.0 + total) / (1 + F.col("n"))) + 1).alias("idf"))

    def with_bound(some: DataFrame) -> DataFrame:
        """known (the squared size of the terms of the templates), low (no more than the whole squared size) and dots (by template) of units t."""
        own = F.transform(F.array_intersect("t", listed), lambda w: F.struct(F.size(F.filter("t", lambda x: x == w)).alias("tf"), F.element_at(table, w).alias("y")))
        rows = some.withColumn("own", own)
        known = F.aggregate("own", F.lit(0.0), lambda acc, e: acc + (e["tf"] * e["y"][0]) ** 2)
        dots = F.aggregate("own", none, lambda acc, e: F.zip_with(acc, F.slice(e["y"], 2, len(names)), lambda d, y: d + e["tf"] * e["y"][0] * y))
        return rows.withColumn("known", known).withColumn("low", F.col("known") + F.size(F.array_distinct("t")) - F.size("own")).withColumn("dots", dots).drop("own")

    def with_unit(some: DataFrame) -> DataFrame:
        u1, u2 = two(F.col("t"))
        return some.withColumn("u1", u1).withColumn("u2", u2)

    def scored(units: DataFrame) -> DataFrame:
        """u1, u2, template, score of the distinct units in `units` (u1, u2, t) that reach the threshold."""
        distinct = written(with_bound(units.groupBy("u1", "u2").agg(F.first("t").alias("t"))).select("u1", "u2", "t", "known", "dots"), "distinct")
        # Terms of the templates are weighed already: only the others of a unit meet their frequencies, and no unit is multiplied by templates.
        others = distinct.select("u1", "u2", F.explode(F.transform(F.array_except("t", listed), lambda w: F.struct(w.alias("term"), F.size(F.filter("t", lambda x: x == w)).alias("tf")))).alias("e")).select("u1", "u2", "e.*")
        sizes = others.join(weights, "term").withColumn("x", F.col("tf") * F.col("idf")).groupBy("u1", "u2").agg(F.sum(F.col("x") * F.col("x")).alias("rest"))
        size = F.sqrt(F.col("known") + F.coalesce("rest", F.lit(0.0)))
        best = lambda name: F.array_max(F.array(*[F.get("dots", F.lit(k)) for k, key in enumerate(names) if key[0] == name]))  # noqa: E731  a licence at most once
        each = F.array(*[F.struct(F.round(best(name) / size, 9).alias("score"), F.lit(name).alias("template")) for name in templates]) if templates else F.array().cast("array<struct<score:double,template:string>>")
        near = F.filter(each, lambda e: e["score"] >= threshold - margin - 5e-10)
        each = distinct.join(sizes, ["u1", "u2"], "left").select("u1", "u2", F.reverse(F.array_sort(near)).alias("x")).where(F.size("x") > 0)
        first, second = F.get("x", F.lit(0)), F.get("x", F.lit(1))
        clear = (first["score"] >= threshold - 5e-10) & (second.isNull() | (first["score"] - second["score"] >= margin - 5e-10))
        return each.where(clear).select("u1", "u2", first["template"].alias("template"), first["score"].alias("score"))

    cut = threshold - 1e-9
    # Without an anchor term, by the Cauchy-Schwarz inequality, no template's cosine reaches the threshold.
    tag = F.regexp_replace(F.regexp_extract("unit", TAG, 1), "(?:-only|-or-later|\\+)$", "")
    tagged = lines.where(F.contains(F.col("unit"), F.lit("SPDX-License-Identifier:"))).select("h1", "h2", F.lit(1).alias("span"), "line", tag.alias("template"), F.lit(1.0).alias("score")).where("template <> ''").distinct()
    found = lines.where(~F.contains(F.col("unit"), F.lit("SPDX-License-Identifier:")))
    found = written(with_unit(found.select("h1", "h2", "line", terms(F.col("unit")).alias("t")).where(anchored(F.col("t")))), "units")
    bounded = with_bound(found.groupBy("u1", "u2").agg(F.first("t").alias("t")))
    # Rows leave through `explode`: a filter would be pushed below the bound and work it out twice.
    near = F.explode(F.array_compact(F.array(F.when(F.array_max("dots") >= F.sqrt("low") * cut, F.col("t")))))
    close = written(bounded.select("u1", "u2", near.alias("t")), "close")
    single = written(found.select("h1", "h2", F.lit(1).alias("span"), "line", "u1", "u2").distinct().join(scored(close), ["u1", "u2"]).drop("u1", "u2").unionByName(tagged), "lines")
    # Runs of lines: of texts without a line of cosine 1 that hold, in all their lines, a template's terms with threshold^2 of its weight.
    open_ = found.select("h1", "h2").distinct().join(single.where("score >= 1").select("h1", "h2").distinct(), ["h1", "h2"], "left_anti")
    open_ = written(open_, "open")
    texts = rows.join(F.broadcast(open_) if open_.count() <= MAX_KEYS else open_, ["h1", "h2"], "left_semi").groupBy("h1", "h2").agg(F.min("text").alias("text"))
    held = F.aggregate(F.transform(F.array_intersect(terms(F.col("text")), listed), lambda w: F.element_at(table, w)), none, lambda acc, y: F.zip_with(acc, F.slice(y, 2, len(names)), lambda m, v: m + v * v))
    enough = lambda m: F.array_max(m) >= threshold * threshold - 1e-9
    able = texts.select("h1", "h2", "text", F.explode(F.filter(F.array(held), enough)).alias("held"))
    full = written(able, "able").select("h1", "h2", "held", F.posexplode(F.split("text", "\n")).alias("line", "unit")).select("h1", "h2", "held", "line", terms(F.col("unit")).alias("t")).where(F.size("t") > 0)
    laid = with_bound(full).groupBy("h1", "h2").agg(F.array_sort(F.collect_list(F.struct("line", "t", "low", "dots"))).alias("x"), F.first("held").alias("held"))
    ks = F.filter(F.transform("held", lambda m, k: F.when(m >= threshold * threshold - 1e-9, k)), lambda k: k.isNotNull())
    laid = laid.where(F.size("x") > 1).select("h1", "h2", "x", F.explode(ks).alias("k"))
    laid = laid.withColumn("d", F.transform("x", lambda e: F.get(e["dots"], F.col("k")))).withColumn("s", F.transform("x", lambda e: e["low"]))
    n = F.size("x")
    total_of = lambda c, i, k: F.aggregate(F.slice(c, i, k), F.lit(0.0), lambda acc, v: acc + v)
    spans = lambda i: F.filter(F.array_distinct(F.transform(F.array(*[F.lit(k) for k in SPANS]), lambda k: F.least(k, n - i + 1))), lambda k: k > 1)
    within = lambda i: F.transform(F.filter(spans(i), lambda k: total_of("d", i, k) >= F.sqrt(total_of("s", i, k)) * cut), lambda k: F.struct(i.alias("i"), k.alias("span")))
    starts = F.filter(F.sequence(F.lit(1), n - 1), lambda i: F.exists(F.slice("d", i, F.lit(max(SPANS))), lambda v: v > 0))
    runs = laid.select("h1", "h2", "x", F.explode(F.flatten(F.transform(starts, within))).alias("r")).select("h1", "h2", "r.span", F.get("x", F.col("r.i") - 1)["line"].alias("line"), F.flatten(F.transform(F.slice("x", F.col("r.i"), F.col("r.span")), lambda e: e["t"])).alias("t"))
    runs = written(with_unit(runs), "runs")
    wide = runs.select("h1", "h2", "span", "line", "u1", "u2").distinct().join(scored(runs), ["u1", "u2"]).drop("u1", "u2")
    best = single.unionByName(wide).groupBy("h1", "h2").agg(F.min(F.struct((-F.col("score")).alias("s"), F.col("span"), F.col("line"), F.col("template"))).alias("b"))
    best = written(best.select("h1", "h2", F.col("b.template").alias("own_license"), (-F.col("b.s")).alias("own_score"), F.col("b.line").alias("own_line")), "best")
    folder = F.when(F.instr("path", "/") > 0, F.regexp_extract("path", "^(.*)/[^/]*$", 1)).otherwise("")
    name = F.lower(F.regexp_extract("path", "([^/]*)$", 1))
    licence_file = F.regexp_extract(name, "^([^.]*)", 1).isin(*licence_names)
    stated = rows.select("h1", "h2", "path").where(licence_file).join(best, ["h1", "h2"]).select(folder.alias("dir"), "own_license", "own_score", "path").groupBy("dir").agg(F.min(F.struct((-F.col("own_score")).alias("s"), F.col("path"), F.col("own_license").alias("license"))).alias("b")).select("dir", F.col("b.license").alias("dir_license"))
    # Every directory meets its ancestors: '', 'a', 'a/b', ...; the longest that states a licence is the nearest.
    dirs = rows.select(folder.alias("dir")).distinct()
    steps = F.split("dir", "/")
    ancestors = F.concat(F.array(F.lit("")), F.when(F.col("dir") != "", F.transform(F.sequence(F.lit(1), F.size(steps)), lambda k: F.array_join(F.slice(steps, F.lit(1), k), "/"))).otherwise(F.array().cast("array<string>")))
    nearest = dirs.select("dir", F.explode(F.array_distinct(ancestors)).alias("up")).join(stated.withColumnRenamed("dir", "up"), "up").groupBy("dir").agg(F.max(F.struct(F.length("up").alias("n"), F.col("up"), F.col("dir_license"))).alias("b")).select("dir", F.col("b.up").alias("license_dir"), F.col("b.dir_license").alias("dir_license"))
    every = rows.select("h1", "h2", "id", "path").withColumn("dir", folder)
    joined = every.join(best, ["h1", "h2"], "left").select("id", "path", "dir", "own_license", "own_score", "own_line").join(nearest, "dir", "left")
    own = F.col("own_license").isNotNull()
    return joined.select(
        F.col("id").alias(id_col),
        F.col("path").alias(path_col),
        "own_license",
        "own_score",
        "own_line",
        F.coalesce("own_license", "dir_license").alias("license"),
        F.when(own & licence_file, "file").when(own, "header").when(F.col("dir_license").isNotNull(), "inherited").otherwise("none").alias("via"),
        F.when(~own, F.col("license_dir")).otherwise(F.when(own & licence_file, F.col("dir"))).alias("license_dir"),
    )
