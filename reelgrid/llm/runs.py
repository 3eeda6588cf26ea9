"""Periodic run detection: maximal repetitions of words by a harmonic grid of longest common extensions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from reelgrid.llm.arrays import NON_SPACE, mix, row_chunks, span_ids, utf8, words

#: Grid points that are looked at together.
GRID = 1 << 19
_BASE = 0xD1342543DE82EF95


class Extensions:
    """Longest common extensions of places of a sequence of numbers: suffix array by prefix doubling, LCP array, and range minima.

    `lce(i, j)` is the length of the longest common prefix of the suffixes at i and j (i and j differ).
    """

    def __init__(self, values: np.ndarray):
        n = len(values)
        _, rank = np.unique(values, return_inverse=True)
        ranks, size = [rank.astype(np.int32)], 1  # ranks[k] orders the stretches of 2^k numbers
        while n and int(ranks[-1].max()) < n - 1:
            low = np.zeros(n, np.int64)
            low[: max(0, n - size)] = ranks[-1][size:] + 1
            key = ranks[-1].astype(np.int64) * (n + 1) + low
            order = np.argsort(key, kind="stable")
            steps = np.concatenate(([0], np.cumsum(key[order[1:]] != key[order[:-1]])))
            rank = np.empty(n, np.int32)
            rank[order] = steps
            ranks.append(rank)
            size *= 2
        self.rank = ranks[-1]
        order = np.empty(n, np.int64)
        order[self.rank] = np.arange(n)
        # Neighbours in the suffix array: the largest equal stretch, then the next smaller one behind it, and so on.
        a, b, common = order[:-1].copy(), order[1:].copy(), np.zeros(max(0, n - 1), np.int32)
        for k in range(len(ranks) - 2, -1, -1):
            inside = (a < n) & (b < n)
            same = np.zeros(len(a), bool)
            same[inside] = ranks[k][a[inside]] == ranks[k][b[inside]]
            # A stretch that the end cuts off is shorter than 2^k and equals none that isn't.
            step = same.astype(np.int64) << k
            a += step
            b += step
            common += step.astype(np.int32)
        del ranks
        self.minima = [common]
        while 2 << (len(self.minima) - 1) <= len(common):
            half = 1 << (len(self.minima) - 1)
            last = self.minima[-1]
            self.minima.append(np.minimum(last[:-half], last[half:]))

    def lce(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        x, y = self.rank[i], self.rank[j]
        low, high = np.minimum(x, y).astype(np.int64), np.maximum(x, y).astype(np.int64)
        level = np.frexp((high - low).astype(np.float64))[1] - 1  # floor of log2
        out = np.zeros(len(low), np.int64)
        for k in np.unique(level):
            at = level == k
            out[at] = np.minimum(self.minima[k][low[at]], self.minima[k][high[at] - (1 << int(k))])
        return out


def _grid(sizes: np.ndarray, times: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Periods and places (multiples of the period) to look at in sequences of falling size that stand behind each other.

    A run of `times` periods p holds times - 1 whole blocks [jp, (j+1)p), so of any times - 2 neighbouring j one begins two equal blocks in it.
    """
    ends = np.cumsum(sizes + 1)
    longest = int(sizes[0]) // times if len(sizes) else 0
    periods = np.arange(1, longest + 1)
    reach = ends[np.searchsorted(-sizes, -times * periods, side="right") - 1]  # places of sequences that can hold such a run
    counts = reach // (periods * (times - 2)) + 1
    upto = np.cumsum(counts)
    i = 0
    while i < longest:
        j = max(i + 1, int(np.searchsorted(upto, (upto[i - 1] if i else 0) + GRID, side="right")))
        p = np.repeat(periods[i:j], counts[i:j])
        first = np.concatenate(([0], np.cumsum(counts[i:j])[:-1]))
        yield p, (np.arange(len(p)) - np.repeat(first, counts[i:j])) * p * (times - 2)
        i = j


def find_runs(sequences: list[np.ndarray], *, times: int = 4, least: int = 6) -> list[np.ndarray]:
    """For each sequence of numbers (0 and more) the rows (start, length, period) of its runs, by start and then period.

    A run is a stretch with smallest period q (values q apart are equal) of at least `times` * q and `least` values that no neighbour extends.
    For each period p, grid points jp and (j+1)p are extended to both sides. Points whose blocks of p values differ by a fingerprint lie in no
    run there and are not extended; the others go by the suffix array of the sequence and that of its reverse. A run is met under multiples of its
    period too, always with the same ends: the smallest counts.
    """
    if times < 3 or least < 1:
        raise ValueError("times must be 3 or more, least 1 or more")
    out = [np.zeros((0, 3), np.int64) for _ in sequences]
    sizes = np.array([len(s) for s in sequences], np.int64)
    order = np.argsort(-sizes, kind="stable")
    order = order[sizes[order] >= max(least, times)]
    if not len(order):
        return out
    sizes = sizes[order]
    top = max(int(sequences[k].max()) for k in order) + 1
    joined = np.concatenate([np.append(sequences[k], top + x) for x, k in enumerate(order)])  # each ends in a number of its own
    n = len(joined)
    with np.errstate(over="ignore"):
        powers = np.full(n + 1, _BASE, np.uint64)
        powers[0] = 1
        powers = np.cumprod(powers)
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(joined.astype(np.uint64) + np.uint64(1)) * powers[:n])))
        ps, at = [], []
        for p, i in _grid(sizes, times):
            inside = i + 2 * p <= n
            p, i = p[inside], i[inside]
            middle = sums[i + p]
            equal = (middle - sums[i]) * powers[p] == sums[i + 2 * p] - middle
            ps.append(p[equal])
            at.append(i[equal])
    p, i = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (ps, at))
    if not len(p):
        return out
    # Suffix arrays only of the sequences that hold such a point.
    ends = np.cumsum(sizes + 1)
    of = np.searchsorted(ends, i, side="right")
    held = np.unique(of)
    shift = ends[held] - sizes[held] - 1
    joined = np.concatenate([joined[s : s + z + 1] for s, z in zip(shift, sizes[held], strict=True)])
    joined = np.concatenate(([joined.max() + 1], joined))
    begin = np.concatenate(([0], np.cumsum(sizes[held] + 1)))[:-1] + 1  # of each held sequence, behind one number of its own
    k = np.searchsorted(held, of)
    i = i - shift[k] + begin[k]
    n = len(joined)
    ahead = Extensions(joined).lce(i, i + p)
    back = Extensions(joined[::-1]).lce(n - i, n - i - p)
    start, size = i - back, back + p + ahead
    good = size >= np.maximum(least, times * p)
    rows = np.stack((start[good], size[good], p[good], k[good]), axis=1)
    rows = rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))]
    first = np.ones(len(rows), bool)
    first[1:] = (rows[1:, 0] != rows[:-1, 0]) | (rows[1:, 1] != rows[:-1, 1])
    rows = rows[first]
    rows = rows[np.lexsort((rows[:, 2], rows[:, 0]))]
    for x in np.unique(rows[:, 3]):
        own = rows[rows[:, 3] == x, :3].copy()
        own[:, 0] -= begin[x]
        out[order[held[x]]] = own
    return out


def strongest(runs: np.ndarray) -> tuple[int, int, int] | None:
    """The run with the greatest exact length over period; then the smallest start, then the smallest period."""
    best = None
    for start, size, period in runs.tolist():  # in the order of start and period
        if best is None or size * best[2] > best[1] * period:
            best = (start, size, period)
    return best


def periodic_runs(docs: DataFrame, *, times: int = 4, least: int = 6, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_words, n_runs, runs (array of start, length, period by start and period), best (the strongest run or null), collapsed.

    Words are numbered from 0. `collapsed` holds the words, joined by one blank, but for those that any run contains after its first period.
    Partitions are worked through where they are read, in parts of bounded size (a longer text is a part of its own): no shuffle, no skew.
    A null, empty or blank text has no words and no runs; repeated rows are rows of their own; an empty table gives no rows; other columns are left out.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    run = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def structs(rows: np.ndarray, mask: np.ndarray | None = None) -> pa.StructArray:
        return pa.StructArray.from_arrays([pa.array(rows[:, c], pa.int64()) for c in range(3)], fields=list(run), mask=None if mask is None else pa.array(mask))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets, data = utf8(batch.column(1))
            for i, j in row_chunks(offsets):
                part = data[offsets[i] : offsets[j]]
                starts, ends, first = words(part, offsets[i : j + 1] - offsets[i], NON_SPACE)
                ids, _ = span_ids(part, starts, ends)
                found = find_runs([ids[a:b] for a, b in zip(first[:-1], first[1:], strict=True)], times=times, least=least)
                covered = np.zeros(len(starts) + 1, np.int64)
                for a, rows in zip(first[:-1], found, strict=True):
                    np.add.at(covered, a + rows[:, 0] + rows[:, 2], 1)
                    np.add.at(covered, a + rows[:, 0] + rows[:, 1], -1)
                kept = np.flatnonzero(np.cumsum(covered[:-1]) == 0)
                # Each kept word and one blank behind it, in one copy.
                size = ends[kept] - starts[kept] + 1
                upto = np.cumsum(size)
                text = np.full(upto[-1] if len(upto) else 0, 0x20, np.uint8)
                inside = np.ones(len(text), bool)
                inside[upto - 1] = False
                total = np.zeros(len(part) + 1, np.int64)
                np.add.at(total, starts[kept], 1)
                np.add.at(total, ends[kept], -1)
                text[inside] = part[np.cumsum(total[:-1]) > 0]
                cut = np.concatenate(([0], upto))[np.searchsorted(kept, first)]
                raw = text.tobytes()
                collapsed = pa.array([raw[a : max(a, b - 1)] for a, b in zip(cut[:-1], cut[1:], strict=True)], pa.binary()).cast(pa.string())
                counts = np.array([len(rows) for rows in found])
                runs = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(counts))), pa.int32()), structs(np.concatenate(found)))
                best = [strongest(rows) for rows in found]
                best = structs(np.array([b or (0, 0, 0) for b in best], np.int64).reshape(-1, 3), np.array([b is None for b in best]))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(np.diff(first)), pa.array(counts, pa.int64()), runs, best, collapsed], names=[id_col, "n_words", "n_runs", "runs", "best", "collapsed"])

    one = "struct<start:bigint,length:bigint,period:bigint>"
    return docs.select(id_col, text_col).mapInArrow(find, f"`{id_col}` {kind}, n_words long, n_runs long, runs array<{one}>, best {one}, collapsed string")
