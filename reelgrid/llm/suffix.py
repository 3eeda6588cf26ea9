"""Suffix-array dedup: every byte covered by a long string that also starts elsewhere is found exactly.

Only a sparse set of suffixes is sorted. Each window of `length` bytes has an anchor: its leftmost 32-byte string with the
smallest hash. The anchor follows from the window's content, so equal windows have equal anchors at equal places, and it
is enough to compare the contexts (the windows' bytes around the anchor) of anchors that begin with the same 32 bytes:

1. tasks emit about one anchor per 185 bytes, with a hash of its context;
2. contexts that occur twice are repeats as a whole; an anchor string with one context is none at all;
3. the remaining contexts, one each, are range-partitioned by the leading bytes of the suffix at the anchor (splitters
   sampled by Spark), each bucket sorts its suffixes to the right and to the left by multikey quicksort, and common
   prefixes of neighbours tell which windows are equal. Suffixes with equal leading bytes meet in one bucket; where too
   many contexts share them for a bucket, their windows are compared across buckets by a 128-bit digest instead.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelgrid.llm.arrays import mix, row_chunks, utf8
from reelgrid.session import written

#: Bytes of an anchor string; contexts of one anchor string that a bucket takes; contexts of a bucket; bytes that are scanned at once.
GRAM = 32
WIDE = 4096
BUCKET = 8_192
SEGMENT = 1 << 22
#: Contexts that hold at least this share (one in HOT) of all anchors are joined by broadcast; there are HOT of them at most.
HOT = 10_000

_U = np.uint64
_PLACE = _U((1 << 24) - 1)


def _gram_hashes(data: np.ndarray) -> np.ndarray:
    """A hash of the GRAM bytes at each place."""
    n = len(data) - GRAM + 1
    raw = np.ascontiguousarray(data)
    words = np.ndarray((len(data) - 7,), "<u8", raw.data, 0, (1,)).astype(np.uint64)
    with np.errstate(over="ignore"):
        words = (words ^ (words >> _U(29))) * _U(0xBF58476D1CE4E5B9)
        words ^= words >> _U(32)
        out = words[:n].copy()
        for j, c in ((8, 0x94D049BB133111EB), (16, 0xD6E8FEB86659FD93), (24, 0x9FB21C651E98DF25)):
            out += words[j : j + n] * _U(c)
    return mix(out)


def window_anchors(data: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """For each window start the place of its anchor, and the hash of the bytes at each place."""
    hashes = _gram_hashes(data)
    width = length - GRAM + 1
    packed = (hashes & ~_PLACE) | np.arange(len(hashes), dtype=np.uint64)
    fill = -len(packed) % width
    table = np.concatenate((packed, np.full(fill, ~_U(0)))).reshape(-1, width)
    before = np.minimum.accumulate(table, axis=1).ravel()
    after = np.minimum.accumulate(table[:, ::-1], axis=1)[:, ::-1].ravel()
    n = len(data) - length + 1
    return (np.minimum(after[:n], before[width - 1 : width - 1 + n]) & _PLACE).astype(np.int64), hashes


def _find(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets, data = utf8(batch.column(2))
            rows, places, firsts, lasts, grams, contexts = [], [], [], [], [], []
            for i, j in row_chunks(offsets, SEGMENT // 4):
                for low in range(int(offsets[i]), max(int(offsets[i]) + 1, int(offsets[j]) - length + 1), SEGMENT):
                    part = data[low : min(int(offsets[j]), low + SEGMENT + length - 1)]
                    if len(part) < length:
                        continue
                    anchor, hashes = window_anchors(part, length)
                    raw = part.tobytes()
                    for r in range(i, j):
                        begin, end = max(int(offsets[r]) - low, 0), min(int(offsets[r + 1]) - low - length + 1, len(anchor))
                        if begin >= end:
                            continue
                        own = anchor[begin:end]
                        starts = np.concatenate(([0], np.flatnonzero(np.diff(own)) + 1)) + begin
                        ends = np.concatenate((starts[1:], [end])) - 1
                        at = anchor[starts]
                        shift = low - int(offsets[r])
                        rows.append(np.full(len(at), r))
                        places.append(at + shift)
                        firsts.append(starts + shift)
                        lasts.append(ends + shift)
                        grams.append(hashes[at].view(np.int64))
                        contexts += [hashlib.blake2b(raw[s : e + length], digest_size=16).digest() for s, e in zip(starts.tolist(), ends.tolist(), strict=True)]
            if rows:
                take = pa.array(np.concatenate(rows))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(take), batch.column(1).take(take), *(pa.array(np.concatenate(x)) for x in (places, firsts, lasts, grams)), pa.array(contexts, pa.binary())],
                    names=["k1", "k2", "a", "s0", "s1", "g", "c"],
                )

    return run


def _cut(length: int):
    """Bytes of the contexts listed for each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets, data = utf8(batch.column(2))
            out: list[list] = [[] for _ in range(9)]
            for r, (k1, k2, listed) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(3).to_pylist(), strict=True)):
                raw = data[offsets[r] : offsets[r + 1]].tobytes()
                for x in listed:
                    a = x["a"]
                    for column, value in zip(out, (x["g"], x["m"], x["n"], k1, k2, a, raw[a : a + GRAM], raw[x["s0"] : a], raw[a : x["s1"] + length]), strict=True):
                        column.append(value)
                if len(out[0]) >= 20_000:
                    yield _rows(out)
                    out = [[] for _ in range(9)]
            yield _rows(out)

    return run


def _rows(out: list[list]) -> pa.RecordBatch:
    types = [pa.int64()] * 6 + [pa.binary()] * 3
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, types, strict=True)], names=["g", "m", "n", "k1", "k2", "a", "lead", "left", "right"])


def multikey_order(strings: list[bytes], rows: list[int]) -> list[int]:
    """Rows in the order of their strings, by multikey quicksort: three-way splits on one 8-byte character at a time."""
    if len(rows) <= 32:
        return sorted(rows, key=lambda i: strings[i])
    size = max(len(strings[i]) for i in rows)
    size += -size % 8
    table = np.frombuffer(b"".join(strings[i].ljust(size, b"\0") for i in rows), ">u8").reshape(len(rows), -1)
    out, stack = [], [(np.arange(len(rows)), 0)]
    while stack:
        part, depth = stack.pop()
        if len(part) <= 32:
            out += sorted((rows[i] for i in part), key=lambda i: strings[i])
            continue
        if depth == table.shape[1] or (table[part, depth:] == table[part[0], depth:]).all():
            out += sorted((rows[i] for i in part), key=lambda i: len(strings[i]))
            continue
        column = table[part, depth]
        pivot = np.partition(column, len(column) // 2)[len(column) // 2]
        stack += [(part[column > pivot], depth), (part[column == pivot], depth + 1), (part[column < pivot], depth)]
    return out


def common_prefixes(strings: list[bytes], order: list[int], size: int) -> np.ndarray:
    """Length of the common prefix of each string with the one before it in the order; at most `size`."""
    out = np.zeros(len(order), np.int64)
    for low in range(0, len(order), 4096):
        part = order[max(0, low - 1) : low + 4096]
        table = np.frombuffer(b"".join(strings[i].ljust(size, b"\0") for i in part), np.uint8).reshape(len(part), -1)
        lengths = np.array([len(strings[i]) for i in part])
        differ = table[1:] != table[:-1]
        same = np.where(differ.any(axis=1), differ.argmax(axis=1), size)
        out[max(1, low) : low + 4096] = np.minimum(same, np.minimum(lengths[1:], lengths[:-1]))
    return out


def repeated_windows(groups: np.ndarray, left: list[bytes], right: list[bytes], length: int) -> np.ndarray:
    """For each context (row) and each distance of the anchor from the window's start, whether another context of its
    group has an equal window. A window is equal where both the bytes left of the anchor and those from it on agree."""
    n = len(groups)
    reach = np.array([len(x) for x in left])
    least = length - np.array([len(x) for x in right])
    backward = [x[::-1] for x in left]
    by_group = np.argsort(groups, kind="stable")
    cuts = np.flatnonzero(np.diff(groups[by_group])) + 1
    sides = []
    for strings, size in ((right, length), (backward, length - GRAM)):
        order: list[int] = []
        for rows in np.split(by_group, cuts):
            order += multikey_order(strings, rows.tolist())
        prefix = common_prefixes(strings, order, size)
        prefix[np.concatenate(([0], cuts)).astype(int)] = -1  # groups are never equal
        sides.append((np.array(order), prefix))
    out = np.zeros((n, length - GRAM + 1), bool)
    classes = np.zeros((2, n), np.int64)
    for o in range(int(reach.max()) + 1):
        for side, depth in ((0, length - o), (1, o)):
            order, prefix = sides[side]
            classes[side, order] = np.cumsum(prefix < depth)
        rows = np.flatnonzero((least <= o) & (o <= reach))
        key = classes[0, rows] * (n + 1) + classes[1, rows]
        _, inverse, counts = np.unique(key, return_inverse=True, return_counts=True)
        out[rows, o] = counts[inverse] > 1
    return out


def _resolve(length: int):
    """Sort a bucket and give the repeated runs of the contexts that occur once.

    Suffixes with other leading bytes have no window in common, so a bucket that came out large is worked off in parts that end between two leads.
    """

    def solve(table: pa.Table) -> pa.RecordBatch:
        column = {c: table.column(c).combine_chunks() for c in table.column_names}
        left, right = column["left"].to_pylist(), column["right"].to_pylist()
        found = repeated_windows(column["g"].to_numpy(), left, right, length)
        found &= (column["n"].to_numpy() == 1)[:, None]
        edge = np.diff(np.pad(found, ((0, 0), (1, 1))).astype(np.int8), axis=1)
        (row, low), (_, high) = np.nonzero(edge == 1), np.nonzero(edge == -1)
        a = column["a"].to_numpy()[row]
        take = pa.array(row)
        return pa.RecordBatch.from_arrays([column["k1"].take(take), column["k2"].take(take), pa.array(a - high + 1), pa.array(a - low + length)], names=["k1", "k2", "b", "e"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)  # about BUCKET rows, from which the number of buckets follows
        table = pa.Table.from_batches(held) if held else None
        if table is None or not table.num_rows:
            return
        if table.num_rows <= 2 * BUCKET:
            yield solve(table)
            return
        table = table.take(pc.sort_indices(table.column("lead")))
        lead = table.column("lead").to_pylist()
        begin = 0
        for k in range(1, len(lead) + 1):
            if k == len(lead) or (k - begin >= BUCKET and lead[k] != lead[k - 1]):
                yield solve(table.slice(begin, k - begin))
                begin = k

    return run


def _digests(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k1, k2, n, a, left, right in zip(*(batch.column(c).to_pylist() for c in ("k1", "k2", "n", "a", "left", "right")), strict=True):
                raw = left + right
                digests = [hashlib.blake2b(raw[s : s + length], digest_size=16).digest() for s in range(len(raw) - length + 1)]
                m = len(digests)
                yield pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), pa.array([k1] * m, pa.int64()), pa.array([k2] * m, pa.int64()), pa.array([n] * m, pa.int64()), pa.array(np.arange(m) + a - len(left))], names=["d", "k1", "k2", "n", "b"])

    return run


def _drop(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Merge each document's runs and leave the other bytes."""
    for batch in batches:
        offsets, data = utf8(batch.column(1))
        sizes, removed, spans, kept = [], [], [], []
        for r, listed in enumerate(batch.column(2).to_pylist()):
            raw = data[offsets[r] : offsets[r + 1]].tobytes()
            runs: list[list[int]] = []
            for x in sorted((y["b"], y["e"]) for y in listed or []):
                if runs and x[0] <= runs[-1][1]:
                    runs[-1][1] = max(runs[-1][1], x[1])
                else:
                    runs.append(list(x))
            edges = [0, *(p for run in runs for p in run), len(raw)]
            sizes.append(len(raw))
            removed.append(sum(e - b for b, e in runs))
            spans.append(runs)
            kept.append(b"".join(raw[b:e] for b, e in zip(edges[::2], edges[1::2], strict=True)))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.list_(pa.list_(pa.int64()))), pa.array(kept, pa.binary())], names=[batch.schema.names[0], "n_bytes", "n_removed", "spans", "kept"])


def remove_repeats(df: DataFrame, *, length: int = 400, id_col: str = "doc_id", text_col: str = "text", wide: int = WIDE) -> DataFrame:
    """One row per input row: id, n_bytes, n_removed, n_spans, spans (begin, end of each maximal removed run), kept (binary).

    Texts are UTF-8 bytes, a null one is empty; matches never cross texts; a string that starts twice in one text
    (overlaps count) repeats as well. Texts shorter than `length` stay whole. Rows that repeat an id are rows of their own
    and repeat each other if their texts are equal. Extra columns are not read. Suffixes are written to the shared folder once.
    """
    if length <= GRAM:
        raise ValueError(f"length must be over {GRAM}")
    text = F.coalesce(F.col(text_col), F.lit(""))
    docs = df.select(F.col(id_col).alias("id"), text.alias("text"), F.xxhash64(F.col(id_col), text).alias("k1"), F.xxhash64(text, F.lit(1), F.col(id_col)).alias("k2"))
    long_docs = docs.where(F.octet_length("text") >= length).select("k1", "k2", "text")
    anchors = written(long_docs.mapInArrow(_find(length), "k1 long, k2 long, a long, s0 long, s1 long, g long, c binary"), "anchors")
    contexts = anchors.groupBy("g", "c").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("k1", "k2", "a", "s0", "s1")).alias("at"))
    groups = contexts.groupBy("g").agg(F.count(F.lit(1)).alias("m"), F.min("n").alias("least")).where("m > 1 and least = 1").select("g", "m")
    listed = contexts.join(groups, "g").groupBy("at.k1", "at.k2").agg(F.collect_list(F.struct("g", "m", "n", "at.a", "at.s0", "at.s1")).alias("listed"))
    cut = long_docs.join(listed, ["k1", "k2"]).mapInArrow(_cut(length), "g long, m long, n long, k1 long, k2 long, a long, lead binary, left binary, right binary")
    cut = written(cut, "contexts")
    parts = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-cut.count() // BUCKET))
    runs = "k1 long, k2 long, b long, e long"
    bucketed = cut.where(F.col("m") <= wide).repartitionByRange(parts, "lead").mapInArrow(_resolve(length), runs)
    windows = cut.where(F.col("m") > wide).mapInArrow(_digests(length), "d binary, k1 long, k2 long, n long, b long")
    twice = windows.groupBy("d").agg(F.sum("n").alias("t")).where("t > 1").select("d")
    across = windows.where("n = 1").join(twice, "d", "left_semi").select("k1", "k2", "b", (F.col("b") + length).alias("e"))
    # At most HOT contexts can hold a share of 1 / HOT of all anchors: those are broadcast, so that no task gathers a hot one.
    share = max(2, -(-anchors.count() // HOT))
    hot = F.broadcast(written(contexts.where(F.col("n") >= share).select("g", "c"), "hot"))
    rest = contexts.where((F.col("n") > 1) & (F.col("n") < share)).select("g", "c")
    whole = anchors.join(hot, ["g", "c"], "left_semi").unionByName(anchors.join(hot, ["g", "c"], "left_anti").join(rest, ["g", "c"], "left_semi")).select("k1", "k2", F.col("s0").alias("b"), (F.col("s1") + length).alias("e"))
    spans = whole.unionByName(bucketed).unionByName(across).groupBy("k1", "k2").agg(F.collect_list(F.struct("b", "e")).alias("runs"))
    kind = df.schema[id_col].dataType.simpleString()
    out = docs.join(spans, ["k1", "k2"], "left").select("id", "text", "runs").mapInArrow(_drop, f"id {kind}, n_bytes long, n_removed long, spans array<array<long>>, kept binary")
    return out.select(F.col("id").alias(id_col), "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), "spans", "kept")
