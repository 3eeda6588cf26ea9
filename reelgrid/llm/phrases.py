"""Phrase collocation mining: merged count-min sketches, an exact count of what survives them, scores, and subsumption."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reelgrid.llm.arrays import LOWER, mix, row_chunks, same_spans, span_hashes, utf8, words
from reelgrid.session import written

#: Cells of one row of a sketch at most: bounds a task's memory (ROWS * CELLS bytes for counts to 127) and the broadcast (an eighth of that).
CELLS = 1 << 26
#: Rows of a sketch, each with a hash of its own.
ROWS = 2
#: Sizes of n-grams that have cells; longer ones survive where both n-grams of one word less survive.
SKETCHED = 3
#: Cells that travel as one piece.
BLOCK = 1 << 14
#: Phrases that a task holds before it passes their counts on, and n-grams it sorts into the sketch at once.
HELD, SORTED = 200_000, 1 << 22
#: Phrases with their counts, or places of languages, that are broadcast at most; more are joined by a shuffle.
MAX_ROWS = 200_000

_U = np.uint64
#: Bytes that end a piece, and bytes of words.
_ENDS = np.zeros(256, bool)
_ENDS[list(b".,;:!?\n\x0b\x0c\r")] = True
_WORD = ~_ENDS
_WORD[[0x20, 0x09]] = False


class Grams:
    """The words of some rows, by piece, in one buffer with a blank behind each word, so that an n-gram is a stretch of it."""

    def __init__(self, langs: pa.Array, column: pa.Array):
        # A line feed behind each row ends its last piece.
        offsets, data = utf8(pc.binary_join_element_wise(pc.fill_null(column, "").cast(pa.large_string()), pa.scalar("\n", pa.large_string()), pa.scalar("", pa.large_string())))
        data = LOWER[data[offsets[0] : offsets[-1]]]
        starts, ends, first = words(data, offsets - offsets[0], _WORD)
        keep = _WORD[data]
        keep[ends] = True
        place = np.cumsum(keep) - keep
        text = data[keep]
        self.starts, self.ends = place[starts], place[ends]
        text[self.ends] = 0x20
        self.text = text
        self.piece = np.cumsum(_ENDS[data])[starts]
        self.names, self.lang = np.unique(np.array(langs.to_pylist(), object).astype(str), return_inverse=True)
        self.lang = np.repeat(self.lang, np.diff(first))
        seeds = np.array([int.from_bytes(blake2b(name.encode(), digest_size=8).digest(), "little") for name in self.names.tolist()], np.uint64)
        self.hashes = mix(span_hashes(text, self.starts, self.ends) ^ seeds[self.lang]) if len(starts) else np.zeros(0, np.uint64)

    def sizes(self, longest: int, alive=None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Each size with the words at which n-grams of it begin inside a piece, and their hashes; `alive(size, hashes)` says which of them to go on with.

        An n-gram is gone on with only where both n-grams of one word less were.
        """
        at, hashes = np.arange(len(self.starts)), self.hashes
        for size in range(1, longest + 1):
            if size > 1:
                was = np.zeros(len(self.starts) + 1, bool)
                was[at] = True
                on = was[at + 1]
                at, hashes = at[on], hashes[on]
                on = self.piece[at] == self.piece[at + size - 1] if len(at) and at[-1] + size <= len(self.piece) else np.zeros(len(at), bool)
                at, hashes = at[on], hashes[on]
                with np.errstate(over="ignore"):
                    hashes = mix(hashes * _U(0xD1342543DE82EF95) + self.hashes[at + size - 1])
            if alive is not None:
                on = alive(size, hashes)
                at, hashes = at[on], hashes[on]
            yield size, at, hashes


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[Grams]:
    for batch in batches:
        offsets, _ = utf8(batch.column(1))
        for i, j in row_chunks(offsets):
            yield Grams(batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i))


class Sketch:
    """Counters of a count-min sketch that stop at `limit`: a sum of such sketches stops there too, and still never underestimates what is below."""

    def __init__(self, cells: int, limit: int):
        self.bits = cells.bit_length() - 1
        self.limit = limit
        self.table = np.zeros((ROWS, cells), kind(limit))
        self.waiting, self.n = [], 0

    @staticmethod
    def cells(hashes: np.ndarray, row: int, bits: int) -> np.ndarray:
        return (hashes >> _U(64 - bits) if row == 0 else hashes & _U((1 << bits) - 1)).astype(np.uint32)

    def add(self, hashes: np.ndarray) -> None:
        self.waiting.append(hashes)
        self.n += len(hashes)
        if self.n >= SORTED:
            self.settle()

    def settle(self) -> None:
        if self.n:
            hashes = np.concatenate(self.waiting)
            for row in range(ROWS):
                cells = np.sort(self.cells(hashes, row, self.bits))
                begin = np.flatnonzero(np.concatenate(([True], cells[1:] != cells[:-1])))
                seen = np.diff(np.append(begin, len(cells)))
                cells = cells[begin]
                self.table[row, cells] = np.minimum(self.table[row, cells] + seen, self.limit)
        self.waiting, self.n = [], 0


def kind(limit: int) -> type:
    """Numbers that hold a sum of two counts up to `limit`."""
    return np.uint8 if limit < 128 else np.uint16 if limit < 1 << 15 else np.uint32


def width(size: int, min_count: int, most: int = CELLS) -> int:
    """Cells for texts of so many bytes, in which about half as many n-grams lie: a cell gets a fifth of `min_count` or so by chance, at any size below the bound."""
    return min(most, 1 << max(14, int(size * 3 // (2 * min_count)).bit_length()))


def survivors(docs: DataFrame, *, lang_col: str, text_col: str, longest: int, min_count: int, cells: int) -> tuple[np.ndarray, int]:
    """For each row of the merged sketch the bits of the cells that reach `min_count`; and log2 of the cells.

    Each task counts its n-grams in a sketch of its own, and sends the blocks of it that aren't empty. Blocks are added up in parallel, as
    they come; what comes to the driver are the bits, ROWS * `cells` / 8 bytes.
    """
    block = min(BLOCK, cells)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = Sketch(cells, min_count)
        for grams in _parts(batches):
            for _, _, hashes in grams.sizes(min(SKETCHED, longest)):
                sketch.add(hashes)
        sketch.settle()
        codec = pa.Codec("zstd", 1)
        for row in range(ROWS):
            full = np.flatnonzero(sketch.table[row].reshape(-1, block).any(axis=1))
            for i in range(0, len(full), 256):
                held = [codec.compress(sketch.table[row, k * block : (k + 1) * block].tobytes(), asbytes=True) for k in full[i : i + 256]]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(held), row), pa.int32()), pa.array(full[i : i + 256], pa.int32()), pa.array(held, pa.binary())], names=["row", "block", "held"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, sums, of = pa.Codec("zstd", 1), {}, kind(min_count)
        for batch in batches:
            for row, k, held in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                own = np.frombuffer(codec.decompress(held, block * np.dtype(of).itemsize, asbytes=True), of)
                sums[row, k] = np.minimum(sums[row, k] + own, min_count).astype(of) if (row, k) in sums else own
        for (row, k), total in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([row], pa.int32()), pa.array([k], pa.int32()), pa.array([np.packbits(total >= min_count, bitorder="little").tobytes()], pa.binary())], names=["row", "block", "held"])

    schema = "row int, block int, held binary"
    sent = docs.select(lang_col, text_col).mapInArrow(count, schema)
    bits = np.zeros((ROWS, cells // 8), np.uint8)
    for r in sent.repartition("row", "block").mapInArrow(merge, schema).collect():
        bits[r["row"], r["block"] * block // 8 : (r["block"] + 1) * block // 8] = np.frombuffer(bytes(r["held"]), np.uint8)
    return bits, cells.bit_length() - 1


def counted(docs: DataFrame, bits: np.ndarray, log_cells: int, *, lang_col: str, text_col: str, longest: int) -> DataFrame:
    """Occurrences of each surviving phrase: lang, size, phrase, n (to be summed); and all words of a language as size 0.

    Each task sends what it counted in sorted, compressed parts, one for each language and bucket of phrases; parts of a bucket meet in one
    task, which adds them up as they come and holds HELD phrases at most.
    """
    spark = docs.sparkSession
    shared, buckets = spark.sparkContext.broadcast(bits), max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, held, totals = shared.value, {}, {}

        def alive(size: int, hashes: np.ndarray) -> np.ndarray:
            out = np.ones(len(hashes), bool)
            for row in range(ROWS if size <= SKETCHED else 0):
                cells = Sketch.cells(hashes, row, log_cells)
                out &= (table[row][cells >> 3] >> (cells & 7).astype(np.uint8) & 1).astype(bool)
            return out

        def told() -> pa.RecordBatch:
            parts: dict[tuple, list] = {}
            for (lang, phrase), n in held.items():
                parts.setdefault((lang, crc32(phrase) % buckets), []).append(b"%s\t%d" % (phrase, n))
            held.clear()
            texts = [b"\n".join(sorted(lines)) for lines in parts.values()]
            codec = pa.Codec("zstd", 3)
            columns = [pa.array([lang for lang, _ in parts], pa.string()), pa.array([k for _, k in parts], pa.int32()), pa.array(map(len, texts), pa.int64()), pa.array([codec.compress(t, asbytes=True) for t in texts], pa.binary())]
            return pa.RecordBatch.from_arrays(columns, names=["lang", "bucket", "size", "lines"])

        for grams in _parts(batches):
            names, raw = grams.names.tolist(), grams.text.tobytes()
            for k, n in enumerate(np.bincount(grams.lang, minlength=len(names)).tolist()):
                totals[names[k]] = totals.get(names[k], 0) + n
            for size, at, hashes in grams.sizes(longest, alive):
                _, first, of, seen = np.unique(hashes, return_index=True, return_inverse=True, return_counts=True)
                start, end, lang = grams.starts[at], grams.ends[at + size - 1] if len(at) else at, grams.lang[at]
                if not ((lang == lang[first[of]]).all() and same_spans(grams.text, start, end, start[first[of]], end[first[of]]).all()):
                    first, seen = np.arange(len(at)), np.ones(len(at), np.int64)  # hashes of different phrases meet: each counts by its bytes
                for a, b, c, n in zip(start[first].tolist(), end[first].tolist(), lang[first].tolist(), seen.tolist(), strict=True):
                    key = (names[c], raw[a:b])
                    held[key] = held.get(key, 0) + n
            if len(held) >= HELD:
                yield told()
        held.update({(name, b""): n for name, n in totals.items()})
        yield told()

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, sums = pa.Codec("zstd", 3), {}

        def told() -> pa.RecordBatch:
            keys = list(sums)
            columns = [pa.array([lang for lang, _ in keys], pa.string()), pa.array([p.count(b" ") + 1 if p else 0 for _, p in keys], pa.int32()), pa.array([p for _, p in keys], pa.binary()).cast(pa.string()), pa.array(list(sums.values()), pa.int64())]
            sums.clear()
            return pa.RecordBatch.from_arrays(columns, names=["lang", "size", "phrase", "n"])

        for batch in batches:
            for lang, _, size, lines in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                for line in codec.decompress(lines, size, asbytes=True).split(b"\n"):
                    phrase, n = line.split(b"\t")
                    sums[lang, phrase] = sums.get((lang, phrase), 0) + int(n)
                if len(sums) >= HELD:
                    yield told()
        yield told()

    sent = docs.select(lang_col, text_col).mapInArrow(count, "lang string, bucket int, size long, lines binary")
    return sent.repartition("bucket").mapInArrow(add, "lang string, size int, phrase string, n long")


def _few(df: DataFrame) -> DataFrame:
    """Broadcast where its rows are few."""
    return F.broadcast(df) if df.count() <= MAX_ROWS else df


def _words(phrase: str, count: Column) -> Column:
    """So many first words, or last ones for a negative count."""
    return F.call_function("substring_index", F.col(phrase), F.lit(" "), count)


def collocations(docs: DataFrame, *, lang_col: str = "lang", text_col: str = "text", longest: int = 5, min_count: int = 100, top: int = 2000, subsume: int = 100, unknown: str = "und", max_cells: int = CELLS) -> DataFrame:
    """Each language's first `top` phrases by score: lang, rank (from 1), phrase, a, l, r, n, score.

    A-Z are lower-cased; texts are cut into pieces at `.,;:!?` and line breaks, and these into words at blanks and tabs. Candidates are phrases of 2 to
    `longest` words that occur `min_count` times (a) or more within pieces of a language of n words. Cut after any of its words, a candidate has parts
    that occur l and r times and the score floor(1000 * a * n / (l * r)); the lowest counts, then the earliest cut. A candidate is dropped if its words lie in a
    longer one that occurs at least `subsume` percent as often. Order: score and a, both falling, then phrase by its bytes.

    First pass: sketches, which overestimate only, say which n-grams may be frequent. Second pass: those, and no others, are counted exactly, and
    the counts decide. The sketch has a cell for each so many bytes of text, up to `max_cells`; with more text more n-grams survive that aren't
    frequent, which costs time but changes no result. Counts meet by phrase after sums in each task, so a common phrase is one
    line a task; ranks come from one range sort, so a language of any size is spread over all tasks.
    A null text is empty, a null language is `unknown`; equal rows count each; no rows give no rows; other columns are left out.
    """
    if longest < 2 or min_count < 1:
        raise ValueError("longest must be 2 or more, min_count 1 or more")
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit(unknown)).alias("lang"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    names = {"lang_col": "lang", "text_col": "text", "longest": longest}
    bits, log_cells = survivors(rows, min_count=min_count, cells=width(size, min_count, max_cells), **names)
    found = counted(rows, bits, log_cells, **names).groupBy("lang", "size", "phrase").agg(F.sum("n").alias("f"))
    found = written(found.where((F.col("size") == 0) | (F.col("f") >= min_count)), "phrases")
    totals = _few(found.where("size = 0").select("lang", F.col("f").alias("n")))
    parts = found.where("size > 0").select("lang", "size", "phrase", "f")
    known = _few(parts.select("lang", F.col("phrase").alias("part"), F.col("f").alias("times")))
    phrases = parts.where("size > 1")
    cuts = phrases.join(totals, "lang").select("lang", "phrase", F.col("f").alias("a"), "n", "size", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    for name, part in (("l", _words("phrase", F.col("k"))), ("r", _words("phrase", F.col("k") - F.col("size")))):
        cuts = cuts.withColumn("part", part).join(known, ["lang", "part"]).withColumnRenamed("times", name).drop("part")
    score = F.expr("cast((cast(a * 1000 as decimal(20, 0)) * cast(n as decimal(18, 0))) div (cast(l as decimal(19, 0)) * cast(r as decimal(19, 0))) as bigint)")
    scored = cuts.withColumn("score", score).groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "l", "r")).alias("low"), F.first("a").alias("a"), F.first("n").alias("n"))
    # A phrase inside a longer one lies inside all phrases between the two, which occur no less often: those of one word more tell.
    inside = parts.where("size > 2").select("lang", F.explode(F.array(_words("phrase", F.col("size") - 1), _words("phrase", 1 - F.col("size")))).alias("phrase"), "f")
    longer = inside.groupBy("lang", "phrase").agg(F.max("f").alias("longer"))
    kept = scored.join(longer, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (F.col("longer") * 100 < F.col("a") * subsume))
    kept = kept.select("lang", "phrase", "a", "low.l", "low.r", "n", "low.score")
    order = [F.col("lang"), F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    deal = int(spark.conf.get("spark.sql.shuffle.partitions"))
    kept = written(kept.repartitionByRange(deal, *order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()), "ranked")
    # A row's rank: its place in its task's stretch of its language, behind the stretches of earlier tasks.
    task = F.shiftright("at", 33)
    stretch = kept.groupBy(task.alias("task"), "lang").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("rows"))
    ahead = F.sum("rows").over(Window.partitionBy("lang").orderBy("task")) - F.col("rows")  # one row a task and language
    ahead = stretch.select("lang", "task", "first", ahead.alias("ahead"))
    ranked = kept.withColumn("task", task).join(_few(ahead.where(F.col("ahead") < top)), ["lang", "task"])
    rank = F.col("ahead") + F.col("at") - F.col("first") + 1
    return ranked.withColumn("rank", rank).where(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
