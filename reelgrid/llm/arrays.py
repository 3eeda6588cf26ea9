"""Numpy helpers over Arrow text columns: bytes, words, shingles and hashes without a Python object per word.

All helpers see a column as one UTF-8 buffer with row offsets, and work through it in chunks of rows so
that memory is bounded by CHUNK bytes of text (or by the longest single text).
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK = 1 << 20
#: Code points of text that are worked on at once where texts are seen as code points.
POINTS = 1 << 18

_U = np.uint64
_TABLE: dict[str, np.ndarray] = {}


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Row offsets (int64) and bytes of a string column; null counts as empty."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None and buffers[2].size else np.zeros(0, np.uint8)
    return offsets, data


def row_chunks(offsets: np.ndarray, limit: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Ranges of rows of at most `limit` bytes together, or of one row."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1
        j = min(n, max(j, i + 1))
        yield i, j
        i = j


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (the published splitmix64 constants)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def blocks(data: np.ndarray) -> np.ndarray:
    """The 8 bytes from each place of `data` as one little-endian number; what lies behind the end is 0."""
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    return np.ndarray((len(data) + 1,), np.dtype("<u8"), padded, 0, (1,))


#: Bytes of a span that are taken 8 at a time for all spans at once; longer spans are few and are digested one by one.
SHORT = 64
_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of data[start:end] for each span: its length and then each 8 bytes, chained by the finaliser."""
    sizes = ends - starts
    at8 = blocks(data)
    out = mix(sizes.astype(np.uint64) + _U(0x9E3779B97F4A7C15))
    at = np.flatnonzero((sizes > 0) & (sizes <= SHORT))
    for done in range(0, SHORT, 8):
        if done:
            at = at[sizes[at] > done]
        if not len(at):
            break
        out[at] = mix(out[at] ^ (at8[starts[at] + done] & _MASKS[np.minimum(sizes[at] - done, 8)]))
    for k in np.flatnonzero(sizes > SHORT):
        out[k] = int.from_bytes(blake2b(data[starts[k] : ends[k]].tobytes(), digest_size=8).digest(), "little")
    return out


def same_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, others: np.ndarray, until: np.ndarray) -> np.ndarray:
    """Whether data[start:end] and data[other:until] are equal, for each pair of spans."""
    sizes = ends - starts
    same = sizes == until - others
    at8 = blocks(data)
    at = np.flatnonzero(same & (starts != others))
    wide = at[sizes[at] > SHORT]
    at = at[sizes[at] <= SHORT]
    for done in range(0, SHORT, 8):
        at = at[sizes[at] > done]
        if not len(at):
            break
        equal = ((at8[starts[at] + done] ^ at8[others[at] + done]) & _MASKS[np.minimum(sizes[at] - done, 8)]) == 0
        same[at[~equal]] = False
        at = at[equal]
    for k in wide:
        same[k] = np.array_equal(data[starts[k] : ends[k]], data[others[k] : until[k]])
    return same


def span_ids(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """A number for each span, equal where and only where the bytes are equal, and the place of one span of each number.

    Spans are grouped by hash and held against the first of their group; if bytes differ, the spans are numbered by their bytes.
    """
    hashes = span_hashes(data, starts, ends) if hashes is None else hashes
    _, first, ids = np.unique(hashes, return_index=True, return_inverse=True)
    if same_spans(data, starts, ends, starts[first[ids]], ends[first[ids]]).all():
        return ids, first
    raw, seen, places = data.tobytes(), {}, []
    ids = np.zeros(len(starts), np.int64)
    for k, (i, j) in enumerate(zip(starts.tolist(), ends.tolist(), strict=True)):
        ids[k] = seen.setdefault(raw[i:j], len(seen))
        if len(seen) > len(places):
            places.append(k)
    return ids, np.array(places, np.int64)


#: Byte classes of the word definitions; bytes of 0x80 and more belong to characters beyond ASCII.
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
NON_SPACE = ~SPACE
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


def words(data: np.ndarray, bounds: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words (runs of bytes of `kind`, never across rows), and each row's first word index.

    `bounds` are row offsets relative to `data`.
    """
    n = len(data)
    inside = np.zeros(n + 1, bool)
    inside[:n] = kind[data]
    cut = np.zeros(n + 1, bool)
    cut[bounds] = True
    before = np.zeros(n + 1, bool)
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | cut))
    ends = np.flatnonzero(before & (~inside | cut))
    return starts, ends, np.searchsorted(starts, bounds)


def shingle_hashes(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hashes of each run of `size` word hashes; the last size-1 are of shorter runs."""
    out = np.zeros(len(hashes), np.uint64)
    with np.errstate(over="ignore"):
        for j in range(size):
            part = hashes[j:] * _U((0x9E3779B97F4A7C15 * (2 * j + 3)) & ((1 << 64) - 1) | 1)
            out[: len(part)] += part
    return mix(out)


def shingle_sets(data: np.ndarray, bounds: np.ndarray, size: int) -> list[np.ndarray]:
    """The sorted distinct shingles of each row: of `size` lower-cased words, or one of the whole row if it has fewer."""
    lowered = LOWER[data]
    starts, ends, first = words(lowered, bounds, NON_SPACE)
    hashes = span_hashes(lowered, starts, ends)
    shingles = shingle_hashes(hashes, size)
    sets = []
    for i, j in zip(first[:-1], first[1:], strict=True):
        if j - i >= size:
            sets.append(np.unique(shingles[i : j - size + 1]))
        elif j > i:
            sets.append(shingle_hashes(hashes[i:j], int(j - i))[:1] ^ _U(int(j - i)))
        else:
            sets.append(np.zeros(0, np.uint64))
    return sets


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base modulo 2^64 and their inverses, for n positions."""
    if len(_TABLE.get("powers", ())) < n:
        n = max(n, CHUNK + 1)
        base = 0xD1342543DE82EF95
        inverse = pow(base, -1, 1 << 64)
        for name, b in (("powers", base), ("inverses", inverse)):
            p = np.full(n, b, np.uint64)
            p[0] = 1
            with np.errstate(over="ignore"):
                _TABLE[name] = np.cumprod(p)
    return _TABLE["powers"], _TABLE["inverses"]


def letters() -> np.ndarray:
    """For each code point, whether it is a letter."""
    if "letters" not in _TABLE:
        _TABLE["letters"] = np.array([chr(c).isalpha() for c in range(0x110000)])
    return _TABLE["letters"]


def code_points(texts: list[str | None], limit: int = POINTS) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Lower-cased texts in chunks: first row, code points (each text between line feeds), and row bounds."""
    i, total, part = 0, 0, []
    for k, text in enumerate([*texts, None]):
        if part and (total >= limit or k == len(texts)):
            codes = np.frombuffer("".join(part).encode("utf-32-le", "surrogatepass"), np.uint32)
            yield i, codes, np.concatenate(([0], np.cumsum([len(x) for x in part])))
            i, total, part = k, 0, []
        if k < len(texts):
            part.append(f"\n{(text or '').lower()}\n")
            total += len(part[-1])


def span_sums(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of values[start:end] for each span of numbers; for short spans, whose polynomials seldom meet."""
    powers, inverses = _tables(len(values) + 1)
    with np.errstate(over="ignore"):
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(values) * powers[: len(values)])))
        return mix((sums[ends] - sums[starts]) * inverses[starts])
