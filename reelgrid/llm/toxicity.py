"""Toxicity: subword-bag embeddings averaged into a linear softmax, trained jointly in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelgrid.llm.arrays import code_points, letters, span_sums
from reelgrid.session import written

#: Buckets of the hashed subwords, size of the embeddings, lengths of the character n-grams.
BUCKETS = 1 << 16
SIZE = 8
NGRAMS = (3, 4, 5, 6)
#: Labelled rows that the fit reads at most, of each label.
FIT_ROWS = 1500

_U = np.uint64
_PRIME = _U(0x9E3779B97F4A7C15)


def subwords(codes: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the words (runs of letters) in lower-cased code points: each subword's bucket and word, and each row's first word.

    Subwords are the character n-grams of the word with its ends marked, and the word itself if it is longer.
    """
    inside = np.zeros(len(codes) + 1, bool)
    inside[:-1] = letters()[codes]
    starts = np.flatnonzero(inside[:-1] & ~np.concatenate(([False], inside[:-2])))
    ends = np.flatnonzero(inside[:-1] & ~inside[1:]) + 1
    first = np.searchsorted(starts, bounds)
    sizes = ends - starts + 2
    tail = np.cumsum(sizes)
    text = np.zeros(int(tail[-1]) if len(tail) else 0, np.uint64)
    mark = np.zeros(len(text), bool)
    mark[tail - sizes] = mark[tail - 1] = True
    text[~mark] = codes[inside[:-1]]
    text[tail - sizes], text[tail - 1] = 0x3C, 0x3E
    word = np.repeat(np.arange(len(sizes)), sizes)
    room = np.repeat(tail, sizes) - np.arange(len(text))
    key = np.zeros(len(text), np.uint64)
    whole = np.zeros(len(sizes), np.uint64)
    buckets, of = [], []
    with np.errstate(over="ignore"):
        for n in range(1, max(NGRAMS) + 1):
            key = (key[: len(text) - n + 1] ^ text[n - 1 :]) * _PRIME
            key ^= key >> _U(29)
            if n in NGRAMS:
                at = np.flatnonzero(room[: len(key)] >= n)
                buckets.append((key[at] >> _U(20)) % _U(BUCKETS))
                of.append(word[at])
        if len(text):
            whole = span_sums(text, tail - sizes, tail)
    at = np.flatnonzero(sizes > max(NGRAMS))
    buckets.append(whole[at] % _U(BUCKETS))
    of.append(at)
    return np.concatenate(buckets).astype(np.int64), np.concatenate(of), first


def bags(texts: list[str | None]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Buckets of each whole text and their weights; each word weighs the same and shares its weight among its subwords."""
    out = []
    for _, codes, bounds in code_points(texts):
        buckets, of, first = subwords(codes, bounds)
        weight = 1.0 / np.bincount(of, minlength=first[-1])[of] if len(of) else np.zeros(0)
        row = np.searchsorted(first, of, "right") - 1
        key, inverse = np.unique(row * BUCKETS + buckets, return_inverse=True)
        total = np.bincount(inverse, weight, minlength=len(key))
        cut = np.searchsorted(key // BUCKETS, np.arange(len(first)))
        n = np.diff(first)
        out += [((key[i:j] % BUCKETS).astype(np.int32), (total[i:j] / max(1, n[r])).astype(np.float32)) for r, (i, j) in enumerate(zip(cut[:-1], cut[1:], strict=True))]
    return out


class Model:
    """score = softmax(W @ sum(weight * embedding) + b)[1]; since both are linear, a bucket has one number at scoring."""

    def __init__(self, bucket: np.ndarray, b: float):
        self.bucket = bucket.astype(np.float32)
        self.b = float(b)

    def scores(self, texts: list[str | None]) -> np.ndarray:
        out = []
        for _, codes, bounds in code_points(texts):
            buckets, of, first = subwords(codes, bounds)
            words = np.bincount(of, self.bucket[buckets], minlength=first[-1]) / np.maximum(1, np.bincount(of, minlength=first[-1]))
            sums = np.concatenate(([0.0], np.cumsum(words)))
            out.append(self.b + (sums[first[1:]] - sums[first[:-1]]) / np.maximum(1, np.diff(first)))
        return 1.0 / (1.0 + np.exp(-np.clip(np.concatenate(out), -40, 40))) if out else np.zeros(0)


def gradients(data: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, share: np.ndarray, embeddings: np.ndarray, w: np.ndarray, b: float, scale: float) -> tuple:
    """Of the mean weighted cross-entropy of a batch: buckets met, the gradient of their embeddings, of the softmax, and of its constant."""
    ids = np.concatenate([i for i, _ in data])
    weights = np.concatenate([x for _, x in data]) * np.float32(scale)
    sizes = np.array([len(i) for i, _ in data])
    of = np.repeat(np.arange(len(data)), sizes)
    hidden = np.add.reduceat(embeddings[ids] * weights[:, None], np.cumsum(sizes) - sizes)
    p = 1 / (1 + np.exp(-np.clip(hidden @ w + b, -40, 40)))
    error = ((p - labels) * share / len(data)).astype(embeddings.dtype)
    pull = np.bincount(ids, weights * error[of], minlength=len(embeddings)).astype(embeddings.dtype)
    near = np.flatnonzero(pull)
    return near, pull[near, None] * w[None, :], hidden.T @ error, float(error.sum())


def train(data: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, share: np.ndarray, *, epochs: int = 10, batch: int = 32, rate: float = 0.05, seed: int = 7) -> Model:
    """Adam over mini-batches on embeddings and softmax together. `share` weighs rows (the sample may be balanced)."""
    full = np.array([len(i) > 0 for i, _ in data], bool)  # a text without words teaches nothing
    data, labels, share = [x for x, f in zip(data, full, strict=True) if f], labels[full], share[full]
    rng = np.random.default_rng(seed)
    embeddings = (rng.standard_normal((BUCKETS, SIZE)) * 0.05).astype(np.float32)
    w = (rng.standard_normal(SIZE) * 0.5).astype(np.float32)
    b = float(np.log((labels * share).sum() + 1) - np.log(((1 - labels) * share).sum() + 1))
    scale = np.float32(30.0)  # averages over hundreds of words are small
    m, v = np.zeros_like(embeddings), np.zeros_like(embeddings)
    mw, vw, mb, vb, step = np.zeros(SIZE, np.float32), np.zeros(SIZE, np.float32), 0.0, 0.0, 0
    for _ in range(epochs):
        order = rng.permutation(len(data))
        for s in range(0, len(order), batch):
            rows = order[s : s + batch]
            near, grad, gw, gb = gradients([data[r] for r in rows], labels[rows], share[rows], embeddings, w, b, scale)
            grad, gw = grad + 1e-6 * embeddings[near], gw + 1e-5 * w
            step += 1
            f1, f2 = 1 - 0.9**step, 1 - 0.999**step
            m[near] = 0.9 * m[near] + 0.1 * grad
            v[near] = 0.999 * v[near] + 0.001 * grad**2
            embeddings[near] -= rate * (m[near] / f1) / (np.sqrt(v[near] / f2) + 1e-6)
            mw, vw = 0.9 * mw + 0.1 * gw, 0.999 * vw + 0.001 * gw**2
            w = w - rate * (mw / f1) / (np.sqrt(vw / f2) + 1e-6)
            mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb**2
            b -= rate * (mb / f1) / (np.sqrt(vb / f2) + 1e-6)
    return Model(embeddings @ w * scale, b)


def fit(labelled: DataFrame, *, id_col: str, text_col: str, label_col: str, fit_rows: int = FIT_ROWS, texts: DataFrame | None = None) -> Model:
    """Train on at most `fit_rows` rows of each label: those with the smallest hash of the id, whole texts.

    Tasks turn texts into subword bags; of rows that repeat a chosen id those with the smallest hash of the text count, and only the bags of `fit_rows` rows a label come to the driver. Rows are weighted back to the
    labels' shares among all labelled rows. Without rows of both labels, the score is the labels' share.
    The ids are chosen on narrow columns and broadcast (`fit_rows` of each label at most), so that no text is shuffled; `texts`
    gives the texts by id where `labelled` has none.
    """
    rows = labelled.where(F.col(label_col).isin(0, 1)).select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y"))
    shares = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    chosen = None
    for y in (0, 1):
        part = rows.where(F.col("y") == y).distinct().orderBy(F.xxhash64("id"), "id").limit(fit_rows)
        chosen = part if chosen is None else chosen.unionByName(part)
    chosen = F.broadcast(written(chosen, "sample"))
    if texts is None:
        sample = labelled.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y"), F.col(text_col).alias("text")).join(chosen, ["id", "y"], "left_semi")
    else:
        sample = texts.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(chosen, "id")
    sample = sample.select("id", "y", "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("h"))

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = bags(batch.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(3), pa.array([i.tobytes() for i, _ in found], pa.binary()), pa.array([w.astype(np.float16).tobytes() for _, w in found], pa.binary())], names=["id", "y", "h", "ids", "weights"])

    kind = rows.schema["id"].dataType.simpleString()
    bagged = written(sample.mapInArrow(gather, f"id {kind}, y int, h long, ids binary, weights binary"), "bags")
    parts = [bagged.where(F.col("y") == y).orderBy(F.xxhash64("id"), "id", "h").limit(fit_rows) for y in (0, 1)]  # rows, not ids: an id may repeat
    found = parts[0].unionByName(parts[1]).orderBy("id", "y", "h").collect()
    labels = np.array([r["y"] for r in found], np.float64)
    n = np.array([max(1, int((labels == y).sum())) for y in (0, 1)])
    total = sum(shares.values()) or 1
    if len(set(labels)) < 2:
        return Model(np.zeros(BUCKETS), np.log((shares.get(1, 0) + 0.5) / (shares.get(0, 0) + 0.5)))
    share = np.array([shares[int(y)] / total * len(labels) / n[int(y)] for y in labels])
    data = [(np.frombuffer(bytes(r["ids"]), np.int32), np.frombuffer(bytes(r["weights"]), np.float16).astype(np.float32)) for r in found]
    return train(data, labels, share)


def score(df: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text", keep: tuple[Column, ...] = (), threshold: float = 0.3) -> DataFrame:
    """One row per input row: id, the columns of `keep`, score, predicted. Null and wordless texts get the model's constant."""
    shared = df.sparkSession.sparkContext.broadcast((model.bucket, model.b))
    rows = df.select(F.col(id_col), *keep, F.col(text_col).alias("__text"))
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Model(*shared.value)
        for batch in batches:
            found = known.scores(batch.columns[-1].to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(found), pa.array((found >= threshold).astype(np.int32))], names=[*batch.schema.names[:-1], "score", "predicted"])

    return rows.mapInArrow(run, ", ".join([*fields, "score double", "predicted int"]))


def detect(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", modulus: int = 4, held_out: int = 2, fit_rows: int = FIT_ROWS, threshold: float = 0.3) -> DataFrame:
    """Learn from labelled rows whose crc32(id as text) mod `modulus` is not `held_out`; score every row.

    Columns: id, held_out, score, predicted. Labels other than 0 and 1 teach nothing; an id with both labels teaches both.
    """
    out = F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(modulus)) == held_out
    known = labels.select(F.col(id_col).alias("__id"), F.col(label_col).alias("__label")).distinct()
    rows = docs.where(~out).select(F.col(id_col).alias("__doc"), F.col(text_col).alias("__text"))
    joined = rows.select("__doc").join(known, F.col("__doc") == F.col("__id")).select("__doc", "__label")
    model = fit(joined, id_col="__doc", text_col="__text", label_col="__label", fit_rows=fit_rows, texts=rows)
    return score(docs, model, id_col=id_col, text_col=text_col, keep=(out.alias("held_out"),), threshold=threshold)
