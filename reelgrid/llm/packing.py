"""Packing: vector bin packing of tokenised examples by the dot-product heuristic."""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from reelgrid.llm.arrays import NON_SPACE, span_ids, words

_CACHE: dict = {}
#: Bytes of the longest stretch that is remembered.
KEPT = 64

#: What a whitespace-free stretch of lower-cased text is cut into before byte-pair merging (fixed value of the tokenizer).
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


class WordTokens:
    """Ids of the word-end BPE tokenizer for batches of texts, remembered by stretch and by piece in bounded tables.

    Merges never cross a piece, so remembered ids are the tokenizer's own. Stretches are remembered by their bytes; the few that are longer
    than KEPT bytes are cut and merged each time.
    Texts that hold control characters, a capital sigma or the start of a special token go to the tokenizer whole.
    """

    def __init__(self, path: str, limit: int = 400_000):
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.cut = regex.compile(PIECES).findall
        self.odd = regex.compile("[\\x00-\\x08\\x0e-\\x1f\\x7f-\\x9f\u03a3]|<\\|").search
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # byte-level BPE: other bytes stand for 256 and on
        hidden = (c for c in range(256) if c not in set(shown))
        self.bytes = {c: c for c in shown} | {c: 256 + k for k, c in enumerate(hidden)}
        self.pieces: dict[str, list[int]] = {}
        self.limit = limit
        self._empty()

    def _empty(self) -> None:
        self.places: dict[bytes, int] = {}
        self.pool, self.ends = array("I"), array("q", [0])  # ids of all stretches, and where each ends; stretch 0 is empty

    def _piece(self, piece: str) -> list[int]:
        ids = self.pieces.get(piece)
        if ids is None:
            if len(self.pieces) >= self.limit // 4:
                self.pieces.clear()
            shown = piece if piece.isascii() else piece.encode().decode("latin-1").translate(self.bytes)
            ids = self.pieces[piece] = [t.id for t in self.model.tokenize(shown)]
        return ids

    def _add(self, key: bytes) -> int:
        stretch = key.decode()
        if stretch.isalpha():
            ids = self._piece(stretch)
        elif stretch[-1] in ",." and stretch[:-1].isalpha():
            ids = self._piece(stretch[:-1]) + self._piece(stretch[-1])
        else:
            ids = list(chain.from_iterable(map(self._piece, self.cut(stretch))))
        self.pool.extend(ids)
        k = len(self.ends)
        if len(key) <= KEPT:
            self.places[key] = k
        self.ends.append(len(self.pool))
        return k

    def batch(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text."""
        import unicodedata

        plain, out = [], [None] * len(texts)
        for i, text in enumerate(texts):
            if self.odd(text):
                out[i] = np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)
                plain.append(b"")
            else:
                plain.append((text if text.isascii() else unicodedata.normalize("NFC", text)).lower().encode())
        data = b"\n".join(plain)
        sizes = np.array([len(p) + 1 for p in plain], np.int64)
        bounds = np.concatenate(([0], np.cumsum(sizes)))
        bounds[-1] -= 1
        raw = np.frombuffer(data, np.uint8)
        starts, ends, first = words(raw, bounds, NON_SPACE)
        inverse, at = span_ids(raw, starts, ends)
        if len(self.ends) > self.limit or len(self.pool) > 4 * self.limit:
            self._empty()
        get = self.places.get
        keys = [data[i:j] for i, j in zip(starts[at].tolist(), ends[at].tolist(), strict=True)]
        place = np.array([get(key) or self._add(key) for key in keys], np.int64)[inverse] if keys else np.zeros(0, np.int64)
        until = np.array(self.ends)
        low = until[place - 1]
        sizes = until[place] - low
        total = np.concatenate(([0], np.cumsum(sizes)))
        ids = np.frombuffer(self.pool, np.uint32)[np.arange(total[-1]) + np.repeat(low - total[:-1], sizes)] if total[-1] else np.zeros(0, np.uint32)
        cut = total[first]
        return [ids[i:j] if done is None else done for i, j, done in zip(cut[:-1], cut[1:], out, strict=True)]

    def texts(self, texts: list[str | None], limit: int = 1 << 20) -> Iterator[np.ndarray]:
        """Ids of each text in turn; texts are taken together up to `limit` characters. Null counts as empty."""
        part, size = [], 0
        for text in texts:
            part.append(text or "")
            size += len(part[-1])
            if size >= limit:
                yield from self.batch(part)
                part, size = [], 0
        if part:
            yield from self.batch(part)


def word_tokens(path: str) -> WordTokens:
    if path not in _CACHE:
        _CACHE[path] = WordTokens(path)
    return _CACHE[path]


class Packer:
    """Open bins under limits on tokens, segments and loss-bearing tokens.

    A piece goes to the open bin with the largest dot product of its demand and the bin's remaining room (both in
    shares of the limits) among those it fits. If it fits none, the fullest bin is filled up with a cut of the piece
    and closed. `tokens` is the sequence length; sequences are closed full except where segments or loss run out first.
    """

    def __init__(self, tokens: int, segments: int, loss: int, open_bins: int):
        self.limit = np.array([tokens, segments, loss], float)
        self.tokens = tokens
        self.open_bins = open_bins
        self.room = np.zeros((open_bins, 3))
        self.bins: list[list] = [[] for _ in range(open_bins)]
        self.used = 0
        self.closed: list[list] = []

    @staticmethod
    def demand(piece: tuple) -> tuple[int, int, int]:
        """A piece: (example, start, length, loss prefix sums or None if every token bears loss)."""
        _, start, length, loss = piece
        return length, 1, length if loss is None else int(loss[start + length] - loss[start])

    def _fit(self, piece: tuple, room: np.ndarray) -> int:
        """The most leading tokens of the piece that fit into the room."""
        example, start, length, loss = piece
        n = int(min(length, room[0])) if room[1] >= 1 else 0
        if loss is None:
            return int(min(n, room[2]))
        return min(n, int(np.searchsorted(loss[start + 1 : start + length + 1] - loss[start], room[2], side="right")))

    def _place(self, b: int, piece: tuple) -> None:
        self.bins[b].append(piece)
        self.room[b] -= self.demand(piece)
        if self.room[b, 0] < 1:
            self._close(b)

    def _close(self, b: int) -> None:
        self.closed.append(self.bins[b])
        self.used -= 1
        self.bins[b], self.room[b] = self.bins[self.used], self.room[self.used]
        self.bins[self.used] = []

    def add(self, piece: tuple) -> None:
        example, start, length, loss = piece
        while length:
            piece = (example, start, length, loss)
            whole = self._fit(piece, self.limit)
            if whole >= self.tokens and length >= self.tokens:
                self.closed.append([(example, start, self.tokens, loss)])
                start, length = start + self.tokens, length - self.tokens
                continue
            want = np.array(self.demand(piece), float)
            room = self.room[: self.used]
            fits = (room >= want).all(axis=1)
            if fits.any():
                self._place(int(np.where(fits, room @ (want / self.limit**2), -1.0).argmax()), piece)
                return
            if self.used < self.open_bins:
                self.room[self.used] = self.limit
                self.used += 1
                n = self._fit(piece, self.limit)
                self._place(self.used - 1, (example, start, n, loss))
            else:
                b = int(room[:, 0].argmin())
                n = self._fit(piece, room[b])
                if n:
                    self.bins[b].append((example, start, n, loss))
                self._close(b)
            start, length = start + n, length - n

    def finish(self) -> None:
        """Join what open bins hold: refill bins to the full length, and cut the rest into powers of two, which need no padding."""
        left = sorted((p for b in self.bins[: self.used] for p in b), key=lambda p: -p[2])
        self.used = 0
        self.bins = [[] for _ in range(self.open_bins)]
        total = sum(p[2] for p in left)
        while left:
            size = self.tokens if total >= self.tokens else 1 << (total.bit_length() - 1)
            room, made = self.limit.copy(), []
            room[0] = size
            while left and room[0] >= 1:
                example, start, length, loss = left[-1]
                n = self._fit(left[-1], room)
                if not n:
                    break
                made.append((example, start, n, loss))
                room -= self.demand(made[-1])
                total -= n
                left.pop()
                if n < length:
                    left.append((example, start + n, length - n, loss))
            self.closed.append(made)


def pack(df: DataFrame, tokenizer_path: str, *, tokens: int = 2048, segments: int = 256, loss: int | None = None, end_id: int = 1, open_bins: int = 32, id_col: str = "doc_id", text_col: str = "text", loss_from: str | None = None, with_ids: bool = False) -> DataFrame:
    """Pack each text (its ids, then `end_id`) into sequences; one row per piece.

    Columns: id, start, length, ids_crc32, doc_tokens, sequence_id, offset, loss_tokens, sequence_tokens, and with
    `with_ids` the ids. `loss` bounds the loss-bearing tokens of a sequence (default: no tighter than `tokens`); `loss_from` names a column
    with the first token that bears loss (null: all do), as for instruction data whose prompt carries none.
    Each input partition is packed by the task that reads it, in memory bounded by `open_bins` sequences and one Arrow batch: no shuffle, no
    skew, and the same rows give the same sequences again when an executor is lost. sequence_id is unique over partitions. A null text counts
    as empty and gives the end id alone; an empty table gives no rows; repeated ids are packed as rows of their own.
    """
    if tokens < 1 or segments < 1 or (loss is not None and loss < 1):
        raise ValueError("limits must be positive")
    columns = [id_col, text_col] + ([loss_from] if loss_from else [])
    kind = df.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, loss_tokens long, sequence_tokens long" + (", ids array<long>" if with_ids else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get().partitionId() << 33
        tok = word_tokens(tokenizer_path)
        packer = Packer(tokens, segments, loss or tokens, open_bins)
        number, id_type = 0, None

        def rows() -> pa.RecordBatch:
            nonlocal number
            out: list[list] = [[] for _ in range(9 + with_ids)]
            for sequence in packer.closed:
                offset, size = 0, sum(p[2] for p in sequence)
                for piece in sequence:
                    (key, ids), start, length, _ = piece
                    part = ids[start : start + length]
                    values = [key, start, length, zlib.crc32(part.astype("<u4").tobytes()), len(ids), task + number, offset, Packer.demand(piece)[2], size]
                    for column, value in zip(out, values + [part.astype(np.int64)] * with_ids, strict=True):
                        column.append(value)
                    offset += length
                number += 1
            packer.closed = []
            types = [id_type] + [pa.int64()] * 8 + [pa.list_(pa.int64())] * with_ids
            names = [id_col, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "loss_tokens", "sequence_tokens"] + ["ids"] * with_ids
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], names=names)

        for batch in batches:
            id_type = batch.schema.field(0).type
            for i, ids in enumerate(tok.texts(batch.column(1).to_pylist())):
                ids = np.append(ids, np.uint32(end_id))
                prefix = None
                if loss_from and (first := batch.column(2)[i].as_py()) is not None:
                    prefix = np.concatenate(([0], np.cumsum(np.arange(len(ids)) >= first)))
                packer.add(((batch.column(0)[i].as_py(), ids), 0, len(ids), prefix))
                if len(packer.closed) >= 512:
                    yield rows()
        if id_type is not None:
            packer.finish()
            yield rows()

    return df.select(*columns).mapInArrow(run, schema)
