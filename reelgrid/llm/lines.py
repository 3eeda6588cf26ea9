"""Line dedup: a deletion-neighbourhood join over words, by DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelgrid.session import written

#: Lines of fewer words must be equal to count as repeats; longer ones may differ by one word.
MIN_WORDS = 8
#: Shared halves that are broadcast at most (8 bytes each); more are joined by a shuffle.
MAX_HALVES = 1_000_000


def _plain(line: Column) -> Column:
    """The line's words with one blank between them."""
    odd = line.contains("  ")
    for blank in "\t\x0b\x0c\r":
        odd = odd | line.contains(blank)
    return F.trim(F.when(odd, F.regexp_replace(line, "[\\x20\\x09-\\x0D]+", " ")).otherwise(line))


def _count(plain: Column) -> Column:
    return F.octet_length(plain) - F.octet_length(F.replace(plain, F.lit(" "), F.lit(""))) + 1


def _hashed(plain: Column) -> list[Column]:
    """Two independent 64-bit hashes of a sequence of words."""
    return [F.xxhash64(F.lit(seed), plain) for seed in (11, 29)]


def dedup_lines(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """One row per line with a word: id, line_no (from 0), n_words, kept, first_id, first_line, edits.

    Lines are cut at line feeds and compared as sequences of words. Lines are near if their word edit distance (insert, delete, replace) is 0, or
    1 where the longer has `min_words` words or more. A line is dropped if an earlier line, by (id, line_no), is near it; first_id and
    first_line name the earliest such line, or the line itself where it is kept. Null, empty and blank lines give no row; a null id
    comes first. Rows that repeat an id hold lines of one rank, of which none is earlier: equal or near ones among them are all kept, if no line of an earlier rank is near.

    Equal lines are one class, represented by its earliest line, before anything is compared. Of the classes, those that share a
    half with another (at the places where one edit must leave a half whole) go on; the others are near no line. Those emit every variant
    with one word deleted as a 128-bit key: lines whose variants with the same word place deleted are equal are one replacement apart, and a line
    that equals a variant of a longer one is one deletion apart. Only the earliest line of each key is joined back, so a key with
    many lines costs no pairs; edit distances of the joined lines are then verified on the words.
    """
    docs = df.select(F.col(id_col).alias("id"), F.posexplode(F.split(F.coalesce(F.col(text_col), F.lit("")), "\n")).alias("line_no", "line"))
    lines = docs.select("id", "line_no", _plain(F.col("line")).alias("plain")).where("plain <> ''").withColumn("n", _count(F.col("plain")))
    n = F.col("n")
    halves = []
    for longer in (0, 1):  # this line as the longer one of a pair, or as the shorter
        m = n + longer
        for tag, half in ((0, F.expr("substring_index(plain, ' ', cast(floor((n + %d) / 2) as int))" % longer)), (1, F.expr("substring_index(plain, ' ', cast(floor((n + %d) / 2) as int) - n - %d)" % (longer, longer)))):
            halves.append(F.when(n >= min_words - longer, F.xxhash64(F.lit(tag), m, half)))
    w0, w1 = _hashed(F.col("plain"))
    keyed = written(lines.select("id", "line_no", "n", w0.alias("w0"), w1.alias("w1"), *[h.alias(f"h{k}") for k, h in enumerate(halves)]), "keys")
    classes = keyed.groupBy("w0", "w1", "h0", "h1", "h2", "h3").agg(F.min(F.struct("id", "line_no")).alias("at"))
    # Halves of two classes or more, by partial aggregates (no task gathers a common half); a class that has one of them goes on.
    # One hash names a class here: two classes that share it both go on, and are told apart later.
    half = classes.select("w0", F.explode(F.array_compact(F.array("h0", "h1", "h2", "h3"))).alias("half"))
    common = written(half.groupBy("half").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("half"), "halves")
    common = F.broadcast(common) if common.count() <= MAX_HALVES else common
    near = half.join(common, "half", "left_semi").select("w0").distinct()
    # The words of the classes that go on, numbered in the order of their earliest lines.
    places = classes.join(near, "w0", "left_semi").select("w0", "w1", "at", F.col("at.id").alias("id"), F.col("at.line_no").alias("line_no"))
    worded = lines.alias("l").join(places.alias("p"), F.col("l.id").eqNullSafe(F.col("p.id")) & (F.col("l.line_no") == F.col("p.line_no")))
    w0, w1 = _hashed(F.col("l.plain"))
    worded = worded.where((w0 == F.col("p.w0")) & (w1 == F.col("p.w1"))).select("p.w0", "p.w1", "p.at", "l.plain", "l.n").dropDuplicates(["w0", "w1"])
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    worded = written(worded.repartitionByRange(parts, "at").sortWithinPartitions("at").withColumn("o", F.monotonically_increasing_id()), "lines")
    verified = _one_edit(worded, min_words).join(worded.select("o", "w0", "w1"), "o").join(worded.select(F.col("o").alias("low"), F.col("at").alias("first")), "low").select("w0", "w1", "first")
    # Written, so that the join with all lines has two plain shuffles below it and a line that many documents share is split.
    decided = written(classes.join(verified, ["w0", "w1"], "left").select("w0", "w1", F.coalesce("first", "at").alias("first"), F.when(F.col("first").isNotNull(), 1).otherwise(0).alias("edits")), "decided")
    full = keyed.select("id", "line_no", "n", "w0", "w1").join(decided, ["w0", "w1"])
    own = F.col("first").eqNullSafe(F.struct("id", "line_no"))
    return full.select(F.col("id").alias(id_col), "line_no", F.col("n").alias("n_words"), own.alias("kept"), F.col("first.id").alias("first_id"), F.col("first.line_no").alias("first_line"), F.when(own, 0).otherwise(F.col("edits")).alias("edits"))


def _one_edit(worded: DataFrame, min_words: int) -> DataFrame:
    """Columns o, low: for each line the smallest number of an earlier one that is one word edit away."""
    n, spot, plain = F.col("n"), F.col("spot"), F.col("plain")
    part = lambda count: F.call_function("substring_index", plain, F.lit(" "), count)
    v0, v1 = _hashed(F.trim(F.concat(part(spot - 1), F.lit(" "), part(spot - n))))
    variants = worded.where(n >= min_words).select("o", "plain", "n", F.explode(F.sequence(F.lit(1), n)).alias("spot")).select("o", "spot", v0.alias("v0"), v1.alias("v1"))
    # One replacement apart: the same word place deleted, the rest equal.
    replaced = variants.groupBy("v0", "v1", "spot").agg(F.min("o").alias("low"), F.count(F.lit(1)).alias("m")).where("m > 1").select("v0", "v1", F.struct("spot", "low").alias("by"), F.lit(None).cast("long").alias("short"))
    # One deletion apart: a whole line equals a variant of a longer one.
    short = worded.where(n >= min_words - 1).select(F.col("w0").alias("v0"), F.col("w1").alias("v1"), F.lit(None).cast("struct<spot:int,low:bigint>").alias("by"), F.col("o").alias("short"))
    keys = replaced.unionByName(short).groupBy("v0", "v1").agg(F.collect_list("by").alias("by"), F.min("short").alias("short"))
    hits = variants.join(keys, ["v0", "v1"])
    by_place = F.try_element_at(F.filter("by", lambda b: b["spot"] == F.col("spot")), F.lit(1))["low"]
    found = hits.select(F.explode(F.array(F.struct("o", F.least(by_place, "short").alias("low")), F.struct(F.col("short").alias("o"), F.col("o").alias("low")))).alias("x")).select("x.*").where("low < o").groupBy("o").agg(F.min("low").alias("low"))
    words = F.split("plain", " ")
    pairs = found.join(worded.select("o", words.alias("words")), "o").join(worded.select(F.col("o").alias("low"), words.alias("other")), "low")
    return pairs.where(within_one("words", "other")).select("o", "low")


def within_one(a: str, b: str) -> Column:
    """Whether two word sequences are at most one insertion, deletion or replacement apart."""
    x, y = F.col(a), F.col(b)
    n, m = F.size(x), F.size(y)
    same = F.zip_with(x, y, lambda p, q: p.eqNullSafe(q))
    head = F.coalesce(F.array_position(same, F.lit(False)) - 1, F.lit(0))
    head = F.when(x == y, F.least(n, m)).otherwise(head).cast("int")
    tail_x = F.slice(x, head + F.when(n >= m, 2).otherwise(1), F.greatest(n, m))
    tail_y = F.slice(y, head + F.when(m >= n, 2).otherwise(1), F.greatest(n, m))
    return (F.abs(n - m) <= 1) & ((x == y) | (tail_x == tail_y))
