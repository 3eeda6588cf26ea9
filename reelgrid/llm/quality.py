"""Quality rules: a short-circuit cascade whose order follows from each rule's cost and selectivity on a sample."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelgrid.llm.arrays import NON_SPACE, mix, row_chunks, span_ids, utf8, words

#: Rows of the sample that costs and selectivities are estimated on, about.
SAMPLE_ROWS = 2000
#: Rows that fail are taken out before the next rule once they are this share of a part.
COMPACT = 0.1

SYMBOL = np.zeros(256, bool)
SYMBOL[list(b"#*$%&|<>")] = True
#: Bytes of ASCII letters and of every character beyond ASCII.
LETTER = np.zeros(256, bool)
LETTER[0x41:0x5B] = LETTER[0x61:0x7B] = LETTER[0x80:] = True


class Texts:
    """Some rows' texts, and what rules ask of them; each measure (an array with a number for each row) is made when first asked for."""

    def __init__(self, column: pa.Array):
        self.column = column
        offsets, data = utf8(column)
        self.data = data[offsets[0] : offsets[-1]]
        self.bounds = offsets - offsets[0]
        self.starts, self.ends, self.first = words(self.data, self.bounds, NON_SPACE)

    def __len__(self) -> int:
        return len(self.bounds) - 1

    def take(self, rows: np.ndarray) -> Texts:
        return Texts(self.column.take(pa.array(rows)))

    @staticmethod
    def _per(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        sums = np.concatenate(([0], np.cumsum(flags)))
        return sums[bounds[1:]] - sums[bounds[:-1]]

    @cached_property
    def n_words(self) -> np.ndarray:
        return np.diff(self.first)

    @cached_property
    def word_chars(self) -> np.ndarray:
        """Code points in words."""
        return self._per(NON_SPACE[self.data] & ((self.data & 0xC0) != 0x80), self.bounds)

    @cached_property
    def n_symbols(self) -> np.ndarray:
        return self._per(SYMBOL[self.data], self.bounds)

    @cached_property
    def n_lettered(self) -> np.ndarray:
        """Words with a letter."""
        sums = np.concatenate(([0], np.cumsum(LETTER[self.data])))
        return self._per(sums[self.ends] > sums[self.starts], self.first)

    @cached_property
    def lines(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of each line with a word: its row, start, end, and the places of its first and last word."""
        cuts = np.flatnonzero(self.data == 0x0A)
        starts = np.union1d(cuts + 1, self.bounds[:-1])
        starts = starts[starts < len(self.data)]
        ends = np.append(starts[1:], len(self.data))[: len(starts)]
        ends = ends - (self.data[ends - 1] == 0x0A)
        low, high = np.searchsorted(self.starts, starts), np.searchsorted(self.starts, ends)
        full = high > low
        starts, ends, low, high = starts[full], ends[full], low[full], high[full]
        return np.searchsorted(self.bounds, starts, "right") - 1, starts, ends, low, high - 1

    @cached_property
    def n_lines(self) -> np.ndarray:
        return np.bincount(self.lines[0], minlength=len(self))

    @cached_property
    def n_dup_lines(self) -> np.ndarray:
        """Lines that equal an earlier line of the row."""
        rows, starts, ends, *_ = self.lines
        several = np.flatnonzero(self.n_lines[rows] > 1)
        out = np.zeros(len(self), np.int64)
        if len(several):
            rows = rows[several]
            ids, _ = span_ids(self.data, starts[several], ends[several])
            distinct = np.unique(rows * (int(ids.max()) + 1) + ids) // (int(ids.max()) + 1)
            out += np.bincount(rows, minlength=len(self)) - np.bincount(distinct, minlength=len(self))
        return out

    @cached_property
    def word_ids(self) -> np.ndarray:
        """A number for each word, the same for equal words."""
        return span_ids(self.data, self.starts, self.ends)[0]

    @cached_property
    def n_repeat_words(self) -> np.ndarray:
        """Words in three-word windows that the row has twice or more."""
        n = len(self.starts)
        row = np.repeat(np.arange(len(self)), self.n_words)
        at = np.flatnonzero(row[2:] == row[:-2]) if n > 2 else np.zeros(0, np.int64)
        if not len(at):
            return np.zeros(len(self), np.int64)
        ids = self.word_ids
        parts = (row[at], ids[at], ids[at + 1], ids[at + 2])
        key = np.zeros(len(at), np.uint64)
        for part in parts:
            key = mix(key ^ part.astype(np.uint64))
        _, first, of, seen = np.unique(key, return_index=True, return_inverse=True, return_counts=True)
        if not all((part == part[first[of]]).all() for part in parts):  # keys of different windows meet
            _, of, seen = np.unique(np.stack(parts), axis=1, return_inverse=True, return_counts=True)
        covered = np.zeros(n, bool)
        twice = at[seen[of.ravel()] > 1]
        for k in range(3):
            covered[twice + k] = True
        return self._per(covered, self.first)

    @cached_property
    def top_word(self) -> np.ndarray:
        """Occurrences of the row's most frequent word."""
        out = np.zeros(len(self), np.int64)
        if len(self.starts):
            width = int(self.word_ids.max()) + 1
            keys, seen = np.unique(np.repeat(np.arange(len(self)), self.n_words) * width + self.word_ids, return_counts=True)
            np.maximum.at(out, keys // width, seen)
        return out

    def _words_are(self, at: np.ndarray, until: np.ndarray, what: bytes, first: bool) -> np.ndarray:
        n = len(what)
        place = at if first else until - n
        inside = until - at >= n
        return inside & np.all([self.data[np.where(inside, place, 0) + k] == c for k, c in enumerate(what)], axis=0)

    @cached_property
    def n_bullets(self) -> np.ndarray:
        """Lines whose first word begins with a bullet."""
        rows, _, _, low, _ = self.lines
        at, until = self.starts[low], self.ends[low]
        marked = np.any([self._words_are(at, until, mark.encode(), True) for mark in "-*•"], axis=0) if len(rows) else np.zeros(0, bool)
        return np.bincount(rows[marked], minlength=len(self))

    @cached_property
    def n_ellipses(self) -> np.ndarray:
        """Lines whose last word ends in an ellipsis."""
        rows, _, _, _, high = self.lines
        at, until = self.starts[high], self.ends[high]
        marked = np.any([self._words_are(at, until, mark.encode(), False) for mark in ("...", "…")], axis=0) if len(rows) else np.zeros(0, bool)
        return np.bincount(rows[marked], minlength=len(self))


@dataclass(frozen=True)
class Rule:
    """A rule and the rows that it rejects, as flags."""

    name: str
    rejects: Callable[[Texts], np.ndarray]


@dataclass(frozen=True)
class Estimate:
    """What the sample says of a rule: nanoseconds a row, share of rows that it rejects, rejections per cost where it stands in the order."""

    name: str
    cost: float
    rejected: float
    worth: float


#: What is asked of every row, whatever else is.
BASE = (
    Rule("few_words", lambda t: t.n_words < 50),
    Rule("repeated_windows", lambda t: 100 * t.n_repeat_words > 50 * t.n_words),
)
RULES = (
    Rule("symbols", lambda t: 10 * t.n_symbols > t.n_words),
    Rule("word_length", lambda t: (t.word_chars < 3 * t.n_words) | (t.word_chars > 10 * t.n_words)),
    Rule("letters", lambda t: 100 * t.n_lettered < 80 * t.n_words),
    Rule("equal_lines", lambda t: 100 * t.n_dup_lines > 50 * t.n_lines),
    Rule("bullets", lambda t: 100 * t.n_bullets > 90 * t.n_lines),
    Rule("ellipses", lambda t: 100 * t.n_ellipses > 30 * t.n_lines),
    Rule("one_word", lambda t: 100 * t.top_word > 30 * t.n_words),
)
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def parts(column: pa.Array) -> Iterator[Texts]:
    offsets, _ = utf8(column)
    for i, j in row_chunks(offsets):
        yield Texts(column.slice(i, j - i))


def estimate(docs: DataFrame, rules: Sequence[Rule] = RULES, *, base: Sequence[Rule] = (), text_col: str = "text", sample_rows: int = SAMPLE_ROWS, seed: int = 17) -> list[Estimate]:
    """The rules in the order in which the cascade asks them: by rejections per cost, each among the rows that those before it leave.

    A random sample of about `sample_rows` rows of all partitions is judged by every rule. Tasks report how many rows fail each set of rules, and each
    rule's CPU time (on texts of which nothing has been measured but their words); these sums are all that the driver gets. Rows that fail `base`
    count for nothing. Equal worth: the cheaper rule, then the first by name. Without rows, the rules keep their order.
    """
    rules, base = tuple(rules), tuple(base)
    if len(rules) > 62:
        raise ValueError("at most 62 rules")
    rows = docs.count()
    share = min(1.0, sample_rows / max(1, rows))
    sample = docs.select(text_col).sample(False, share, seed) if share < 1 else docs.select(text_col)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spent, seen, found = np.zeros(len(rules), np.int64), 0, {}
        for batch in batches:
            for texts in parts(batch.column(0)):
                if base:
                    texts = texts.take(np.flatnonzero(~np.any([r.rejects(texts) for r in base], axis=0)))
                mask = np.zeros(len(texts), np.int64)
                for k, rule in enumerate(rules):
                    fresh = texts.take(np.arange(len(texts)))
                    began = time.thread_time_ns()
                    failed = rule.rejects(fresh)
                    spent[k] += time.thread_time_ns() - began
                    mask |= failed.astype(np.int64) << k
                seen += len(texts)
                for m, n in zip(*np.unique(mask, return_counts=True), strict=True):
                    found[int(m)] = found.get(int(m), 0) + int(n)
        out = [("cost", k, int(ns), seen) for k, ns in enumerate(spent)] + [("mask", m, 0, n) for m, n in found.items()]
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out, strict=True), (pa.string(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=["what", "k", "ns", "n"])

    # Two long sums for each rule and each set of rules that rows of the sample fail: bounded by the sample.
    told = sample.mapInArrow(measure, "what string, k long, ns long, n long").groupBy("what", "k").agg(F.sum("ns").alias("ns"), F.sum("n").alias("n")).collect()
    cost = {r["k"]: max(1.0, r["ns"] / max(1, r["n"])) for r in told if r["what"] == "cost"}
    masks = {r["k"]: r["n"] for r in told if r["what"] == "mask"}
    total = max(1, sum(masks.values()))
    left, out = list(range(len(rules))) if cost else [], []
    while left:
        fails = {k: sum(n for m, n in masks.items() if m >> k & 1) for k in left}
        best = min(left, key=lambda k: (-fails[k] / cost[k], cost[k], rules[k].name))
        out.append(Estimate(rules[best].name, cost[best], fails[best] / total, fails[best] / total / cost[best]))
        masks = {m: n for m, n in masks.items() if not m >> best & 1}
        left.remove(best)
    return out or [Estimate(r.name, 0.0, 0.0, 0.0) for r in rules]


def judge(docs: DataFrame, rules: Sequence[Rule] = RULES, *, base: Sequence[Rule] = BASE, measures: Sequence[str] = MEASURES, order: Sequence[str] | None = None, id_col: str = "doc_id", text_col: str = "text", sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """One row per document: id, the measures asked for (long), base_failed, kept, failed_rule.

    `base` is asked of every row, as the measures are. The rest is a cascade: a row goes to the next rule only if it passed those before, and failed_rule names the
    first that it fails (a rule of `base` first). `order` names the rules in the order to ask them; by default `estimate` gives it. kept doesn't
    depend on the order. Each partition is judged where it is read, in parts of bounded size: no shuffle, no skew.
    A null text is empty and has no words; equal rows are judged alike; an empty table gives no rows; other columns are left out.
    """
    rules, base = tuple(rules), tuple(base)
    order = list(order) if order is not None else [e.name for e in estimate(docs, rules, base=base, text_col=text_col, sample_rows=sample_rows)]
    by = {r.name: r for r in rules}
    if sorted(order) != sorted(by):
        raise ValueError("order must name every rule once")
    cascade = [by[name] for name in order]
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = 0
            for texts in parts(batch.column(1)):
                n = len(texts)
                failed = np.full(n, -1)
                for k, rule in enumerate(base):
                    failed[(failed < 0) & rule.rejects(texts)] = k
                of_base = failed >= 0
                numbers = [pa.array(getattr(texts, m), pa.int64()) for m in measures]
                now, rows = texts, np.arange(n)
                for k, rule in enumerate(cascade):
                    open_ = failed[rows] < 0
                    if not open_.any():
                        break
                    if len(rows) - open_.sum() > COMPACT * len(rows):
                        now, rows = now.take(np.flatnonzero(open_)), rows[open_]
                        open_ = open_[open_]
                    failed[rows[open_ & rule.rejects(now)]] = len(base) + k
                names = np.array([r.name for r in (*base, *cascade)] + [None], object)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(done, n), *numbers, pa.array(of_base), pa.array(failed < 0), pa.array(names[failed], pa.string())], names=[id_col, *measures, "base_failed", "kept", "failed_rule"])
                done += n

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, " + "".join(f"{m} long, " for m in measures) + "base_failed boolean, kept boolean, failed_rule string")
