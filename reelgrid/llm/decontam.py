"""Benchmark decontamination: a prefix-filtered set join of document windows with benchmark windows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelgrid.llm.arrays import ALNUM, LOWER, mix, row_chunks, shingle_hashes, span_hashes, span_ids, utf8, words

#: Words of the shingles that windows are filtered by.
SHINGLE = 3
#: Windows, and bytes of text, of one broadcast block of the benchmark; a larger one is joined block by block. A window of ten words takes some 100 bytes beside its text.
BLOCK_WINDOWS, BLOCK_BYTES = 1_000_000, 16 << 20


class Windows:
    """The distinct windows of a bounded block of items, and the shingle by which each is looked for; all as arrays over one buffer of text.

    A window is a run of `size` words, or all words of a shorter item. Full containment asks for every shingle of a
    window, so its necessary prefix is one shingle: the rarest by the document frequencies in `rarity`.
    """

    def __init__(self, items: list[tuple], size: int):
        self.items = [i for i, _ in items]
        texts = [(t or "").encode() for _, t in items]
        bounds = np.concatenate(([0], np.cumsum([len(t) for t in texts]))).astype(np.int64)
        self.data = LOWER[np.frombuffer(b"".join(texts), np.uint8)]
        starts, ends, first = words(self.data, bounds, ALNUM)
        self.hashes = span_hashes(self.data, starts, ends)
        ids, _ = span_ids(self.data, starts, ends, self.hashes)
        self.starts, self.ends = starts.astype(np.int32), ends.astype(np.int32)
        many = np.diff(first)
        counts = np.where(many > 0, np.maximum(1, many - size + 1), 0)
        at = np.repeat(first[:-1], counts) + np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        lengths = np.repeat(np.minimum(many, size), counts)
        # Equal windows are one: found by a hash of their words' numbers and held against the first of their hash.
        place = np.minimum(at[:, None] + np.arange(size), max(0, len(ids) - 1))
        row = np.where(np.arange(size) < lengths[:, None], ids[place] if len(ids) else 0, -1).astype(np.int32)
        key = np.zeros(len(at), np.uint64)
        for c in range(size):
            key = mix(key ^ row[:, c].astype(np.int64).astype(np.uint64))
        _, kept, of = np.unique(key, return_index=True, return_inverse=True)
        if not (row == row[kept[of]]).all():
            _, kept, of = np.unique(row, axis=0, return_index=True, return_inverse=True)
        self.at, self.lengths = at[kept], lengths[kept]
        owner = np.unique(of.ravel().astype(np.int64) * max(1, len(items)) + np.repeat(np.arange(len(items)), counts))
        self.owner_of, self.owners = np.searchsorted(owner // max(1, len(items)), np.arange(len(kept) + 1)), (owner % max(1, len(items))).astype(np.int32)
        self.vocabulary = {}
        for n in np.unique(np.minimum(SHINGLE, self.lengths)).tolist():
            found = [s.ravel() for _, _, s in self._shingles(n)]
            self.vocabulary[n] = np.unique(np.concatenate(found))
        self.prefix: dict[int, tuple] = {}

    def __len__(self) -> int:
        return len(self.at)

    def _shingles(self, n: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For each length of windows whose shingles have n words: the length, the windows, and a row of shingle hashes for each."""
        every = shingle_hashes(self.hashes, n)
        for length in np.unique(self.lengths[np.minimum(SHINGLE, self.lengths) == n]).tolist():
            at = np.flatnonzero(self.lengths == length)
            yield length, at, every[self.at[at][:, None] + np.arange(length - n + 1)]

    def order(self, rarity: dict[int, np.ndarray]) -> None:
        """Choose each window's prefix shingle; the windows are then sorted by it, with the shingle's place in the window."""
        for n, table in self.vocabulary.items():
            shingles, windows, places = [], [], []
            for _, at, own in self._shingles(n):
                seen = rarity[n][np.searchsorted(table, own)]
                rare = np.where(seen == seen.min(axis=1, keepdims=True), own, np.uint64(2**64 - 1)).argmin(axis=1)
                shingles.append(own[np.arange(len(at)), rare])
                windows.append(at)
                places.append(rare)
            shingles, windows, places = (np.concatenate(x) for x in (shingles, windows, places))
            by = np.lexsort((places, windows, shingles))
            self.prefix[n] = (shingles[by], windows[by].astype(np.int32), places[by].astype(np.int32))

    def words_of(self, k: int) -> list[bytes]:
        at = range(self.at[k], self.at[k] + self.lengths[k])
        return [self.data[self.starts[x] : self.ends[x]].tobytes() for x in at]


def _shingled(column: pa.Array, sizes) -> Iterator[tuple]:
    """For chunks of rows: first row, bytes, word spans, first word of each row, word hashes, and shingle hashes by size."""
    offsets, data = utf8(column)
    for i, j in row_chunks(offsets):
        part = LOWER[data[offsets[i] : offsets[j]]]
        starts, ends, first = words(part, offsets[i : j + 1] - offsets[i], ALNUM)
        hashes = span_hashes(part, starts, ends)
        yield i, part, starts, ends, first, hashes, {n: shingle_hashes(hashes, n) for n in sizes}


def _members(table: np.ndarray, found: np.ndarray) -> np.ndarray:
    """Places in `found` whose value is in the sorted `table`; a bitmap of 2^20 slots rules most out first."""
    slots = np.zeros(1 << 20, bool)
    slots[table >> np.uint64(44)] = True
    at = np.flatnonzero(slots[found >> np.uint64(44)])
    k = np.minimum(np.searchsorted(table, found[at]), len(table) - 1)
    return at[table[k] == found[at]]


def rarity(docs: DataFrame, block: Windows, text_col: str) -> dict[int, np.ndarray]:
    """Occurrences in all documents of each shingle of the block, counted in tasks and summed by Spark."""
    shared = docs.sparkSession.sparkContext.broadcast(block.vocabulary)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = shared.value
        total = {n: np.zeros(len(t), np.int64) for n, t in tables.items()}
        for batch in batches:
            for *_, shingles in _shingled(batch.column(0), tables):
                for n, table in tables.items():
                    at = _members(table, shingles[n])
                    total[n] += np.bincount(np.searchsorted(table, shingles[n][at]), minlength=len(table))
        for n, counts in total.items():
            k = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k), n), pa.int32()), pa.array(k, pa.int32()), pa.array(counts[k])], names=["n", "k", "seen"])

    out = {n: np.zeros(len(t), np.int64) for n, t in block.vocabulary.items()}
    rows = docs.select(text_col).mapInArrow(count, "n int, k int, seen long").groupBy("n", "k").agg(F.sum("seen").alias("seen"))
    found = rows.toArrow()  # 16 bytes for each shingle of the block, whose windows are bounded
    size, at, seen = (found.column(c).to_numpy() for c in ("n", "k", "seen"))
    for n, counts in out.items():
        own = size == n
        counts[at[own]] = seen[own]
    return out


def _hits(docs: DataFrame, block: Windows, id_col: str, text_col: str, keys: list[str]) -> DataFrame:
    """Per document: n_words, runs of hit words (first, end), items as positions in the block; and the columns `keys` (longs)."""
    shared = docs.sparkSession.sparkContext.broadcast(block)
    kind = docs.schema[id_col].dataType.simpleString()

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = shared.value
        for batch in batches:
            totals = np.zeros(batch.num_rows, np.int64)
            runs: list[list] = [[] for _ in range(batch.num_rows)]
            items: list[set] = [set() for _ in range(batch.num_rows)]
            for row, data, starts, ends, first, hashes, shingles in _shingled(batch.column(1), windows.prefix):
                totals[row : row + len(first) - 1] = np.diff(first)
                raw = None
                for n, (table, ks, places) in windows.prefix.items():
                    at = _members(table, shingles[n])
                    low, high = np.searchsorted(table, shingles[n][at], "left"), np.searchsorted(table, shingles[n][at], "right")
                    doc = np.searchsorted(first, at, "right") - 1
                    c = np.repeat(low, high - low) + np.arange((high - low).sum()) - np.repeat(np.cumsum(high - low) - (high - low), high - low)
                    k, d, s = ks[c], np.repeat(doc, high - low), np.repeat(at, high - low) - places[c]
                    inside = (s >= first[d]) & (s + windows.lengths[k] <= first[d + 1])  # the positional and length bounds
                    k, d, s = k[inside], d[inside], s[inside]
                    for x in range(int(windows.lengths[k].max()) if len(k) else 0):  # word by word: first by hash, for all that are left
                        open_ = windows.lengths[k] > x
                        same = ~open_
                        same[open_] = hashes[s[open_] + x] == windows.hashes[windows.at[k[open_]] + x]
                        k, d, s = k[same], d[same], s[same]
                    for w, r, p in zip(k.tolist(), d.tolist(), s.tolist(), strict=True):
                        raw = data.tobytes() if raw is None else raw
                        if all(raw[starts[p + x] : ends[p + x]] == word for x, word in enumerate(windows.words_of(w))):
                            runs[row + r].append((int(p - first[r]), int(p - first[r] + windows.lengths[w])))
                            items[row + r].update(windows.owners[windows.owner_of[w] : windows.owner_of[w + 1]].tolist())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *batch.columns[2:], pa.array(totals), pa.array([merged(r) for r in runs], pa.list_(pa.list_(pa.int64()))), pa.array([sorted(x) for x in items], pa.list_(pa.int32()))],
                names=[id_col, *keys, "n_words", "runs", "items"],
            )

    return docs.select(id_col, text_col, *keys).mapInArrow(find, f"`{id_col}` {kind}, {''.join(f'{k} long, ' for k in keys)}n_words long, runs array<array<long>>, items array<int>")


def merged(runs: list[tuple[int, int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for s, e in sorted(runs):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, window: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block_windows: int = BLOCK_WINDOWS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per document: id, n_words, n_hit, hit_runs, item_ids (sorted strings), n_items, contaminated.

    A document word inside any occurrence of a benchmark window is hit. Each window is sought by its rarest shingle
    (its necessary prefix), bounded by the shingle's place in the window and the document's length, and then verified word by word.
    The benchmark's windows are counted; a block of about `block_windows` windows and `block_bytes` of text is broadcast (some 100 MB), and a larger
    benchmark is joined block by block against all documents, whose results meet by hashes of id and text (128 bits). Documents are never shuffled for a benchmark of one block.
    Null or wordless texts have no words and no hits; null or wordless items no windows; an empty benchmark hits
    nothing; equal items are each reported; rows that repeat an id, or have none, are rows of their own, however many blocks there are.
    """
    spark = docs.sparkSession
    items = benchmark.select(F.col(item_col).cast("string").alias("i"), F.coalesce(F.col(item_text_col), F.lit("")).alias("t"))
    n_words = F.regexp_count("t", F.lit("[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"))
    total = items.agg(F.sum(F.greatest(n_words - window + 1, F.lit(1))).alias("windows"), F.sum(F.octet_length("t")).alias("bytes")).first()
    # Blocks are dealt by hash: twice as many as would do if they were even.
    full = max((total["windows"] or 0) / block_windows, (total["bytes"] or 0) / block_bytes)
    blocks = 1 if full <= 1 else int(np.ceil(2 * full))
    # Rows meet again by id and two hashes of id and text; whole repeats have equal results and are counted.
    keys = ["_k1", "_k2"] if blocks > 1 else []
    text = F.coalesce(F.col(text_col), F.lit(""))
    keyed = docs.select(id_col, text_col, *[h.alias(k) for k, h in zip(keys, (F.xxhash64(F.col(id_col), text), F.xxhash64(text, F.lit(1), F.col(id_col))), strict=False)])
    parts = []
    for b in range(blocks):
        rows = items if blocks == 1 else items.where(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == b)
        block = Windows([tuple(r) for r in rows.orderBy("i", "t").collect()], window)  # about block_bytes
        block.order(rarity(docs, block, text_col) if len(block) else {})
        names = spark.sparkContext.broadcast(block.items)
        found = _hits(keyed, block, id_col, text_col, keys)

        def named(column, names=names):
            @F.pandas_udf("array<string>")
            def look_up(x):
                return x.map(lambda ks: [names.value[k] for k in ks])

            return look_up(column)

        parts.append(found.select(id_col, *keys, "n_words", "runs", named(F.col("items")).alias("item_ids")))
    out = parts[0]
    if len(parts) > 1:
        for part in parts[1:]:
            out = out.unionByName(part)
        one = lambda c: F.flatten(F.collect_set(c)).alias(c)
        out = out.groupBy(id_col, *keys).agg(F.max("n_words").alias("n_words"), one("runs"), one("item_ids"), F.count(F.lit(1)).alias("_rows"))
        out = out.withColumn("_rows", F.explode(F.sequence(F.lit(1), (F.col("_rows") / len(parts)).cast("long"))))
        start = F.array_sort("runs")
        merge = F.aggregate(
            start,
            F.array().cast("array<array<bigint>>"),
            lambda acc, r: F.when((F.size(acc) > 0) & (F.element_at(F.element_at(acc, -1), 2) >= r[0]), F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.array(F.element_at(acc, -1)[0], F.greatest(F.element_at(F.element_at(acc, -1), 2), r[1]))))).otherwise(F.concat(acc, F.array(r))),
        )
        out = out.withColumn("runs", merge)
    out = out.withColumn("item_ids", F.array_sort(F.array_distinct("item_ids"))).withColumn("n_hit", F.aggregate("runs", F.lit(0).cast("long"), lambda acc, r: acc + r[1] - r[0]))
    return out.select(id_col, "n_words", "n_hit", F.col("runs").alias("hit_runs"), "item_ids", F.size("item_ids").cast("long").alias("n_items"), (F.col("n_hit") > 0).alias("contaminated"))


