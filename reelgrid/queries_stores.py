"""Queries of the file sources, the table functions and the jobs of a stream."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from reelgrid import constants as K
from reelgrid.functions import tables
from reelgrid.queries import event_stream, shared_dir
from reelgrid.registry import query, sql_text
from reelgrid.session import spread
from reelgrid.sources import files
from reelgrid.sources import fixtures as X
from reelgrid.streaming import jobs

_MOST = 2_000


def _stored(spark, sf_dir, kinds: int):
    """Addresses of pages as text files in a folder that all share: a quarter of them in one, the others by the remainder of their ids."""
    folder = f"{shared_dir(spark)}/reelgrid/files-{uuid.uuid4().hex}"
    pages = X.table(spark, sf_dir, "pages").select(F.when(F.col("page_id") % 4 == 0, 0).otherwise(F.col("page_id") % kinds).alias("kind"), "page_id", "url")
    pages.repartition(kinds, "kind").sortWithinPartitions("kind", "page_id").select("kind", "url").write.partitionBy("kind").text(folder)
    return folder


def _kind():
    return F.regexp_extract("path", "kind=([0-9]+)/", 1).cast("bigint").alias("kind")


_FILES = "WITH f AS (SELECT kind, string_agg(url, chr(10) ORDER BY page_id) || chr(10) AS text FROM (SELECT CASE WHEN page_id % 4 = 0 THEN 0 ELSE page_id % {n} END AS kind, page_id, url FROM pages) GROUP BY kind)"


@query(_FILES.format(n=9) + f" SELECT kind, strlen(text) AS size, CASE WHEN length(text) <= {_MOST} THEN sha256(text) END AS text_sha256, CASE WHEN length(text) > {_MOST} THEN {sql_text(K.SAYS['playlist_large'])} END AS error FROM f")
def stored_texts(spark, sf_dir):
    """Texts of files by the data source; those over the cap are error rows."""
    files.register(spark)
    folder = _stored(spark, sf_dir, 9)
    rows = spark.read.format("media_texts").option("path", folder).option("max_chars", _MOST).option("task_bytes", 20_000).load()
    return rows.select(_kind(), "size", F.sha2("text", 256).alias("text_sha256"), "error")


@query(_FILES.format(n=5) + " SELECT kind, strlen(text) AS size, md5(left(text, 200)) AS head_md5 FROM f")
def stored_heads(spark, sf_dir):
    """The first 200 bytes of files, read as ranges."""
    files.register(spark)
    rows = spark.read.format("media_heads").option("path", _stored(spark, sf_dir, 5)).option("bytes", 200).load()
    return rows.select(_kind(), "size", F.md5("head").alias("head_md5"))


@query("""WITH e AS (SELECT event_id, event_id % 9 AS pad, event_id % 4 = 0 AS cut FROM events)
SELECT event_id, unnest(CASE WHEN cut THEN [{'path': NULL, 'depth': NULL, 'start': NULL, 'end': NULL, 'error': 'Corrupt MP4 box "mdat"'}] ELSE [{'path': 'ftyp', 'depth': 0, 'start': 0, 'end': 8 + pad, 'error': NULL}, {'path': 'moov', 'depth': 0, 'start': 8 + pad, 'end': 36 + pad, 'error': NULL},
 {'path': 'moov/trak', 'depth': 1, 'start': 16 + pad, 'end': 32 + pad, 'error': NULL}, {'path': 'moov/trak/tkhd', 'depth': 2, 'start': 24 + pad, 'end': 32 + pad, 'error': NULL}, {'path': 'mdat', 'depth': 0, 'start': 36 + pad, 'end': 52 + pad, 'error': NULL}] END, recursive := true) FROM e""")
def box_rows(spark, sf_dir):
    """Boxes and nested boxes as rows, by a LATERAL join with a table function; a broken file is one row with its error."""
    tables.register(spark)
    i = F.col("event_id")
    inner = "0000001C" + "6D6F6F76" + "00000010" + "7472616B" + "00000008" + "746B6864" + "00000000"
    data = F.concat(F.lpad(F.hex(8 + i % 9), 8, "0"), F.lit("66747970"), F.repeat(F.lit("AA"), (i % 9).cast("int")), F.lit(inner), F.when(i % 4 == 0, "00000063").otherwise("00000001"), F.lit("6D646174" + "0000000000000010"))
    events = spread(X.table(spark, sf_dir, "events").select("event_id"), "event_id")  # boxes are read row by row in Python
    events.select("event_id", F.unhex(data).alias("body")).createOrReplaceTempView("reelgrid_files")
    return spark.sql("SELECT f.event_id, b.path, b.depth, b.start, b.end, b.error FROM reelgrid_files f, LATERAL mp4_boxes(f.body) b")


_JOBS = f"""WITH i AS (SELECT event_id AS i, user_id // 3 AS tab_id, epoch_us(ts) // {X.PACE} AS us, CAST(json_extract_string(props, '$.k') AS INT) % 12 AS k FROM events),
k AS (SELECT tab_id, us, i, CASE WHEN i % 6 = 0 THEN 'hls' WHEN i % 6 = 3 THEN 'dash' ELSE 'file' END AS kind, i % 7 = 1 AS refused FROM i WHERE i % 997 <> 500 AND i % 97 <> 60)"""


@query(_JOBS + f" SELECT tab_id, make_timestamp(us) AS created, kind, 'page ' || tab_id AS title, CASE WHEN refused THEN {sql_text(K.SAYS['refused_before'])} ELSE '' END AS note FROM k WHERE kind <> 'file' OR refused")
def stream_jobs(spark, sf_dir):
    """Jobs of a stream by a sink that writes each batch once; the batch is handed to it twice, as after a failure."""
    folder = f"{shared_dir(spark)}/reelgrid/jobs-{uuid.uuid4().hex}"
    e = X.tab_events(spark, sf_dir, event_stream(spark, sf_dir)).where("what = 'item'")
    rows = jobs.jobs(e.select("tab_id", "key", "url", "kind", F.concat(F.lit("page "), "tab_id").alias("title"), F.lit("").alias("page_url"), (F.col("event_id") % 7 == 1).alias("refused"), F.col("seen").alias("created")))
    write = jobs.writes_once(f"{folder}/jobs")

    def twice(batch, number):
        write(batch, number)
        write(batch, number)

    rows.writeStream.option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).foreachBatch(twice).start().awaitTermination()
    return jobs.written_jobs(spark, f"{folder}/jobs").select("tab_id", F.col("created").cast("timestamp_ntz").alias("created"), "kind", "title", "note")
