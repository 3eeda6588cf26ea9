"""Language ID by rank-order n-gram profiles and out-of-place distance."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reelgrid.llm.arrays import code_points, letters
from reelgrid.session import written

#: n-grams of one to three letters, word ends marked by a blank; the ranks compared; labelled rows read per language.
ORDERS = (1, 2, 3)
RANKS = 300
FIT_ROWS = 1500
#: Ids of the sample that are broadcast at most; more (with many languages) are joined by a shuffle.
MAX_IDS = 1_000_000



def ngrams(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each whole text the distinct n-grams of its words (as 63-bit codes) and their counts; none without a letter."""
    for _, codes, bounds in code_points(texts):
        inside = letters()[codes]
        after = np.concatenate(([False], inside[:-1]))  # one blank after each word
        ahead = np.concatenate((inside[1:], [False]))  # and one before
        keep = inside | after | ahead
        place = np.concatenate(([0], np.cumsum(keep)))[bounds]
        text = np.where(inside, codes, 0x20)[keep].astype(np.int64)
        blank = text == 0x20
        parts, cuts = [], []
        for n in ORDERS:
            m = max(0, len(text) - n + 1)
            key, bad = np.zeros(m, np.int64), np.zeros(m, bool)
            for j in range(n):
                key = key << 21 | text[j : m + j]
            for j in range(n if n == 1 else 0):
                bad |= blank[j : m + j]
            for j in range(1, n - 1):
                bad |= blank[j : m + j]
            if n == 2:
                bad = blank[:m] & blank[1 : m + 1]
            good = np.concatenate(([0], np.cumsum(~bad)))
            parts.append(key[~bad])
            cuts.append(good[np.minimum(place, m)])
        for r in range(len(bounds) - 1):
            if not inside[bounds[r] : bounds[r + 1]].any():
                yield np.zeros(0, np.int64), np.zeros(0, np.int64)
                continue
            # n-grams that begin in the text; those that would reach into the next one begin with a blank pair
            yield np.unique(np.concatenate([p[c[r] : c[r + 1]] for p, c in zip(parts, cuts, strict=True)]), return_counts=True)


def ranked(keys: np.ndarray, counts: np.ndarray, n: int = RANKS) -> np.ndarray:
    """The most frequent n-grams, most frequent first, ties by code."""
    if len(keys) > 4 * n:  # only those that can be among the first
        least = np.partition(counts, len(counts) - n)[len(counts) - n]
        keys, counts = keys[counts >= least], counts[counts >= least]
    return keys[np.lexsort((keys, -counts))[:n]]


def fit(labelled: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", fit_rows: int = FIT_ROWS, ranks: int = RANKS) -> dict[str, np.ndarray]:
    """Profile of each language: its `ranks` most frequent n-grams over at most `fit_rows` whole texts.

    Those are the rows with the smallest hash of the id; rows without a language or a letter teach nothing. The profiles
    (bounded by languages times `ranks`) are the only thing collected.
    """
    rows = labelled.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    keyed = rows.select(F.col(lang_col).alias("lang"), F.col(id_col).alias("id"), F.pmod(F.xxhash64(id_col), F.lit(1 << 40)).alias("h"))
    # About twice as many as are wanted pass a threshold on the hash before any shuffle: sizes, one row a language, are broadcast (a model holds a profile of each language too).
    sizes = keyed.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    passed = keyed.join(F.broadcast(sizes), "lang").where(F.col("h") < F.lit(2.0 * (fit_rows + 50) * (1 << 40)) / F.col("n"))
    chosen = passed.select("lang", "id", F.row_number().over(Window.partitionBy("lang").orderBy("h", "id")).alias("k")).where(F.col("k") <= fit_rows).select("id").distinct()
    ids = written(chosen, "sample")  # at most `fit_rows` a language
    texts = rows.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).join(F.broadcast(ids) if ids.count() <= MAX_IDS else ids, "id", "left_semi")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: dict[str, list] = {}
            for lang, counted in zip(batch.column(0).to_pylist(), ngrams(batch.column(1).to_pylist()), strict=True):
                found.setdefault(lang, []).append(counted)
            for lang, of in found.items():
                keys, counts = [k for k, _ in of], [c for _, c in of]
                k, at = np.unique(np.concatenate(keys), return_inverse=True)
                c = np.bincount(at, np.concatenate(counts), minlength=len(k)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(k), pa.string()), pa.array(k), pa.array(c)], names=["lang", "gram", "n"])

    grams = texts.select("lang", "text").mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    top = grams.select("*", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram")).alias("r")).where(F.col("r") <= ranks)
    profiles: dict[str, list] = {}
    for row in top.orderBy("lang", "r").collect():
        profiles.setdefault(row["lang"], []).append(row["gram"])
    return {lang: np.array(grams, np.int64) for lang, grams in profiles.items()}


class Profiles:
    def __init__(self, profiles: dict[str, np.ndarray]):
        self.names = sorted(profiles)
        self.worst = max([len(p) for p in profiles.values()], default=1)
        self.tables = []
        for name in self.names:
            order = np.argsort(profiles[name])
            self.tables.append((profiles[name][order], order))

    def predict(self, keys: np.ndarray, counts: np.ndarray) -> tuple[str, float, int]:
        """Nearest language, score (one less the distance in shares of the largest), distance. Ties: first by name."""
        if not len(keys) or not self.names:
            return "und", 0.0, 0
        grams = ranked(keys, counts, self.worst)
        place = np.arange(len(grams))
        best = None
        for name, (table, rank) in zip(self.names, self.tables, strict=True):
            at = np.minimum(np.searchsorted(table, grams), len(table) - 1)
            distance = int(np.where(table[at] == grams, np.abs(rank[at] - place), self.worst).sum())
            if best is None or distance < best[1]:
                best = (name, distance)
        return best[0], 1.0 - best[1] / (self.worst * len(grams)), best[1]


def predict(df: DataFrame, profiles: dict[str, np.ndarray], *, id_col: str = "doc_id", text_col: str = "text", keep: tuple[Column, ...] = ()) -> DataFrame:
    """One row per input row: id, the columns of `keep`, lang_pred, score, distance. `und` (score 0) where a text is null or has no letter."""
    shared = df.sparkSession.sparkContext.broadcast(Profiles(profiles))
    rows = df.select(F.col(id_col), *keep, F.col(text_col).alias("__text"))
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            found = [known.predict(*counted) for counted in ngrams(batch.columns[-1].to_pylist())]
            columns = [pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64()), pa.array([f[2] for f in found], pa.int64())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *columns], names=[*batch.schema.names[:-1], "lang_pred", "score", "distance"])

    return rows.mapInArrow(run, ", ".join([*fields, "lang_pred string", "score double", "distance long"]))


def identify(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", modulus: int = 5, held_out: int = 0, fit_rows: int = FIT_ROWS, ranks: int = RANKS) -> DataFrame:
    """Fit on the labelled rows whose crc32(id as text) mod `modulus` is not `held_out`, predict every row.

    Columns: id, held_out, lang_pred, score, distance. Null ids are not learnt from, and are held_out null. No labelled row: every text is `und`.
    """
    out = F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(modulus)) == held_out
    profiles = fit(df.where(~out), id_col=id_col, text_col=text_col, lang_col=lang_col, fit_rows=fit_rows, ranks=ranks)
    return predict(df, profiles, id_col=id_col, text_col=text_col, keep=(out.alias("held_out"),))
