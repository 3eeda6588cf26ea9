"""Rows that each become much work are dealt to all tasks, however small the file that they come from."""

import pytest

from reelgrid.queries_manifests import children_cap
from reelgrid.queries_stores import box_rows
from reelgrid.sources import fixtures as X


@pytest.mark.parametrize("made", [X.odd_manifests, children_cap, box_rows])
def test_spread(spark, sf, made):
    held = made(spark, sf).rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect()
    assert sum(n > 0 for n in held) == int(spark.conf.get("spark.sql.shuffle.partitions"))
