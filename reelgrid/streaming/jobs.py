"""Download jobs of a stream: rows that a replayed batch writes once, and a keyed store that forgets them after their hour."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelgrid import constants as K
from reelgrid.functions import urls as U

JOB = "job_id string, tab_id long, key string, url string, kind string, title string, page_url string, note string, created timestamp"
#: What is asked of the store: a job is opened, or looked for.
ASK = f"what string, {JOB}"
_NAMES = [c.split()[0] for c in JOB.split(", ")]


def jobs(items: DataFrame) -> DataFrame:
    """A job for each item that the built-in downloader takes. Input: tab_id, key, url, kind, title, page_url, refused, created.

    The id follows from item and time, so that the same request is the same job however often it is read. `refused` tells of a host that turned Chrome's own
    downloader away before.
    """
    note = F.when(F.col("refused"), K.SAYS["refused_before"]).otherwise("")
    name = F.concat_ws(":", U.hash_string(F.col("key")), F.col("tab_id"), F.unix_micros("created"))
    rows = items.where((F.col("kind") != "file") | F.col("refused"))
    return rows.select(U.hash_string(name).alias("job_id"), "tab_id", "key", "url", "kind", F.coalesce("title", F.lit("")).alias("title"), F.coalesce("page_url", F.lit("")).alias("page_url"), note.alias("note"), "created")


def writes_once(folder: str) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: each batch has a folder of its own name, which a replay of the batch writes anew instead of adding to it."""

    def write(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{folder}/batch={batch}")

    return write


def written_jobs(spark: SparkSession, folder: str) -> DataFrame:
    """What `writes_once` has written, whole batches only."""
    return spark.read.schema(f"{JOB}, batch long").parquet(folder).drop("batch")


def _store(ttl_millis: int):
    import pandas as pd
    from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

    class Store(StatefulProcessor):
        """One job. The state store itself lets it go when its time is over; nobody looks for the oldest."""

        def init(self, handle: StatefulProcessorHandle) -> None:
            self.job = handle.getValueState("job", ", ".join(f"{n} {t}" for n, t in (c.split() for c in JOB.split(", ") if not c.startswith("job_id"))), ttl_millis)

        def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
            asked = 0
            for chunk in rows:
                opened = chunk[chunk["what"] == "open"]
                if len(opened):
                    first = opened.sort_values("created").iloc[0]
                    if not self.job.exists():
                        self.job.update(tuple(first[n].to_pydatetime() if n == "created" else int(first[n]) if n == "tab_id" else first[n] for n in _NAMES[1:]))
                asked += int((chunk["what"] == "find").sum())
            found = [(key[0], *self.job.get())] * asked if asked and self.job.exists() else []
            frame = pd.DataFrame(found, columns=_NAMES)
            frame["created"] = pd.to_datetime(frame["created"])
            frame["tab_id"] = frame["tab_id"].astype("int64")
            yield frame

        def close(self) -> None:
            pass

    return Store()


def job_store(asks: DataFrame, minutes: float = K.JOB_MINUTES) -> DataFrame:
    """Answers to what is asked of a stream (columns of ASK): a row for each `find` of a job that was opened and hasn't outlived its time.

    The time is the state's own time to live, by the clock: jobs that nobody asks for vanish as well. Opening a job again changes nothing.
    Needs the RocksDB state store, and a trigger by time: with state that expires by the clock, a query never runs out of batches.
    """
    names = [c.split()[0] for c in ASK.split(", ")]
    return asks.select(*names).groupBy("job_id").transformWithStateInPandas(statefulProcessor=_store(int(minutes * 60_000)), outputStructType=JOB, outputMode="Update", timeMode="ProcessingTime")
