"""Corpus pipeline: language ID, exact dedup, near-duplicate join, decontamination, packing; each stage works on what the one before kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelgrid.llm import decontam, exact, jaccard, langid, packing
from reelgrid.session import prepare, scratch, written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: A text whose n-grams are further than this from every language (score of 0 to 1) is no running text.
LEAST_SCORE = 0.3
#: Keys to drop that are broadcast at most; more are joined by a shuffle.
MAX_IDS = 1_000_000


def keyed(docs: DataFrame) -> DataFrame:
    """The documents with row_key: doc_id and two hashes of doc_id and text (128 bits), equal only in rows that repeat both. Keys sort by doc_id, null first."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(*COLUMNS, F.struct("doc_id", F.xxhash64("doc_id", text).alias("k1"), F.xxhash64(text, F.lit(1), F.col("doc_id")).alias("k2")).alias("row_key"))


def without(docs: DataFrame, found: DataFrame) -> DataFrame:
    """The keyed documents but for those that are `gone` by their row_key; of rows with one key that `folds`, one stays, the least by its other columns."""
    decided = found.groupBy(F.col("row_key.k1").alias("k1"), F.col("row_key.k2").alias("k2")).agg(F.max("gone").alias("gone"), (F.count_if("folds") > 1).alias("folds"))
    decided = written(decided.where("gone or folds"), "gone")
    rows = docs.select(*COLUMNS, "row_key.k1", "row_key.k2")
    few = lambda keys, n: F.broadcast(keys) if n <= MAX_IDS else keys
    dropped = few(decided.select("k1", "k2"), decided.count())
    out = rows.join(dropped, ["k1", "k2"], "left_anti").select(*COLUMNS)
    folded = decided.where("folds and not gone").select("k1", "k2")
    if n := folded.count():
        least = rows.join(few(folded, n), ["k1", "k2"]).groupBy("k1", "k2").agg(F.min(F.struct("lang", "source", "n_chars", "doc_id", "text")).alias("row"))
        out = out.unionByName(least.select(*[F.col(f"row.{c}") for c in COLUMNS]))
    return out


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter or unlike every language go; the others get the predicted language as lang.

    Null, empty and letterless texts go; rows with a null id, repeated rows and very long texts are judged by their own text; of languages at one
    distance the first by name counts; without any labelled row nothing is known and all rows go; other columns than those of documents are left out.
    """
    prepare(spark)
    profiles = langid.fit(docs)
    known = langid.predict(docs, profiles, keep=(F.col("text"), F.col("lang"), F.col("source"), F.col("n_chars")))
    return known.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE)).select("doc_id", "text", F.col("lang_pred").alias("lang"), "source", "n_chars")


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts that are equal without white space stays: the longest, of equally long ones that with the smallest id (null first).

    Null texts equal empty ones; of rows that repeat id and text one stays, the least by its other columns; rows with one id and other texts are
    judged apart; an empty table stays empty.
    """
    prepare(spark)
    docs = keyed(docs)
    return without(docs, exact.exact_groups(docs, "row_key").select("row_key", (~F.col("kept")).alias("gone"), F.col("kept").alias("folds")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Five-word shingles, similarity of 0.8 or more: the row with the smallest id (null first) of each component stays.

    Null, empty and wordless texts are like none and all stay; of rows that repeat id and text one stays; rows with one id and other texts are judged
    apart; texts of fewer than five words are near only if equal; an empty table stays empty.
    """
    prepare(spark)
    docs = keyed(docs)
    found = jaccard.near_duplicates(docs, id_col="row_key")
    return without(docs, found.select("row_key", (F.col("row_key") != F.col("component_id")).alias("gone"), (F.col("n_shingles") > 0).alias("folds")))


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark window go.

    Null, empty and wordless texts hold none and stay; repeated rows go or stay together; a row is judged by its text, whatever other rows have its id (or none);
    an empty benchmark takes nothing away.
    """
    prepare(spark)
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    docs = keyed(docs)
    found = decontam.decontaminate(docs, benchmark, window=10, id_col="row_key").where("contaminated")
    return without(docs, found.select("row_key", F.lit(True).alias("gone"), F.lit(False).alias("folds")))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of 2048 tokens, one row per piece.

    A null or empty text is its end token alone; repeated rows and rows without an id are packed as rows of their own; a long text is cut into
    pieces; an empty table gives no rows.
    """
    prepare(spark)
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), tokens=2048)


STAGES = [("language_id", language_id), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup), ("decontamination", decontaminated), ("packing", packed)]

#: Language ID and packing are beyond SQL; tests hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again; the pieces of the last."""
    docs = prepare(spark).read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        with scratch(spark):  # what a stage wrote on its way goes once its result is written
            docs = written(stage(spark, docs, sf_dir), name, keep=True)
    return STAGES[-1][1](spark, docs, sf_dir)
