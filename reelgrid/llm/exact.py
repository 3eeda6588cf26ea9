"""Exact dedup: group by a 128-bit content hash, keep one row, compare bytes inside groups."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelgrid.session import written

#: Hashes of groups of copies (16 bytes each) that are broadcast at most; beyond that all texts are compared.
MAX_KEYS = 1_000_000
#: The ASCII white space that the default normalisation deletes.
BLANKS = " \t\n\x0b\x0c\r"


def without_blanks(text: Column) -> Column:
    """The text without ASCII white space; null counts as empty."""
    return reduce(lambda t, c: F.replace(t, F.lit(c), F.lit("")), BLANKS, F.coalesce(text, F.lit("")))


def exact_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", normalise=without_blanks, content_hash=None) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256.

    Rows with equal normalised text form a group; the row with the most code points in its original text, then
    the smallest id, stays. A null text is an empty text; an empty table gives no rows; rows that repeat an id
    are rows of their own, and all rows with the id that stays are marked as kept. Other columns are not read.

    One pass writes hashes and lengths to the shared folder; groups are counted on those with partial aggregates, so no group is
    gathered. A second pass compares bytes inside groups by the least and the greatest text of each hash, again as partial aggregates: of a
    group of copies each task sends one text. Groups whose bytes differ (a hash collision) are grouped again by the text itself.
    """
    hashed = content_hash or (lambda norm: F.unhex(F.md5(norm)))
    points = F.length(F.coalesce(F.col(text_col), F.lit("")))
    texts = df.select(F.col(id_col).alias("id"), points.alias("points"), normalise(F.col(text_col)).alias("norm")).select("*", hashed(F.col("norm")).alias("h"))
    rows = written(texts.select("id", "points", "h", F.sha2("norm", 256).alias("text_sha256")), "hashes")
    best = F.min(F.struct((-F.col("points")).alias("p"), F.col("id"))).alias("best")
    # Written, so that the join below has two plain shuffles under it and a hot group's rows are split.
    groups = written(rows.groupBy("h").agg(F.count(F.lit(1)).alias("group_size"), best).select("h", "group_size", F.col("best.id").alias("keep_id")), "groups")
    many = groups.where("group_size > 1").select("h")
    shared = texts.join(F.broadcast(many), "h", "left_semi") if many.count() <= MAX_KEYS else texts  # a text alone in its group has no other to differ from
    collided = written(shared.groupBy("h").agg(F.min("norm").alias("a"), F.max("norm").alias("b")).where("a <> b").select("h"), "collided")
    out = rows.join(groups, "h")
    if collided.limit(1).count():
        unsure = texts.join(collided, "h", "left_semi").select("*", F.sha2("norm", 256).alias("text_sha256"))
        split = unsure.groupBy("h", "norm").agg(F.count(F.lit(1)).alias("group_size"), best).select("h", "norm", "group_size", F.col("best.id").alias("keep_id"))
        out = out.join(collided, "h", "left_anti").select("id", "keep_id", "group_size", "text_sha256").unionByName(unsure.join(split, ["h", "norm"]).select("id", "keep_id", "group_size", "text_sha256"))
    return out.select(F.col("id").alias(id_col), "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")
