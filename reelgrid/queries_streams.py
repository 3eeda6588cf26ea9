"""Queries of the streaming operators: events read as a stream to its end, and the SQL of what must come out."""

from __future__ import annotations

from pyspark.sql import functions as F

from reelgrid.operators import observe
from reelgrid.queries import OBS, event_stream, ran
from reelgrid.registry import query
from reelgrid.sources import fixtures as X
from reelgrid.streaming.state import pending_items, settled, tab_items, throttled


def _last(rows, *columns):
    last = rows.groupBy("tab_id", "key").agg(F.max_by(F.struct("gone", *columns), "batch").alias("x"))
    return last.select("tab_id", "key", "x.*").where("not gone").drop("gone")


@query(OBS + """, nav AS (SELECT tab_id, max(seen) AS nav FROM obs WHERE event_type = 'signup' GROUP BY tab_id)
SELECT c.tab_id, c.key, count(*) AS sightings FROM cls c LEFT JOIN nav USING (tab_id) WHERE c.tab_id % 7 <> 0 AND (nav IS NULL OR c.seen >= nav) GROUP BY c.tab_id, c.key""")
def stream_tabs(spark, sf_dir):
    """Tabs as a stream: a navigation clears what was seen before it, a closed tab (every seventh number) takes nothing more and shows nothing."""
    obs = X.observations(spark, sf_dir, event_stream(spark, sf_dir)).withColumn("seen", F.col("seen").cast("timestamp"))
    found = observe.classified(obs).withColumn("what", F.when(F.col("tab_id") % 7 == 0, "closed").otherwise("item"))
    moves = obs.where("event_type = 'signup'").select("tab_id", "seen", "event_id", F.lit("navigation").alias("what"))
    return _last(ran(spark, tab_items(found.unionByName(moves, allowMissingColumns=True))), "sightings")


@query("""WITH e AS (SELECT user_id AS tab_id, event_type AS key, min(ts) AS first, bool_or(event_id % 40 = 0) AS verified FROM events GROUP BY user_id, event_type), m AS (SELECT max(ts) AS top FROM events)
SELECT tab_id, key, first + INTERVAL 20 SECOND AS shown FROM e, m WHERE NOT verified AND first + INTERVAL 20 SECOND <= top - INTERVAL 10 DAY""")
def stream_pending(spark, sf_dir):
    """Unverified items that appear once event time (here ten days behind the last event) has passed them by twenty seconds."""
    rows = event_stream(spark, sf_dir).select(F.col("user_id").alias("tab_id"), F.col("event_type").alias("key"), F.col("ts").cast("timestamp").alias("seen"), (F.col("event_id") % 40 == 0).alias("verified"))
    return ran(spark, pending_items(rows, delay="10 days")).select("tab_id", "key", F.col("shown").cast("timestamp_ntz").alias("shown"))


_ANCHORS = """WITH RECURSIVE e AS (SELECT user_id AS tab_id, epoch_us(ts) AS us, event_id FROM events), m AS (SELECT max(us) AS top FROM e),
r(tab_id, us) AS (SELECT tab_id, min(us) FROM e GROUP BY tab_id UNION ALL SELECT r.tab_id, (SELECT min(x.us) FROM e x WHERE x.tab_id = r.tab_id AND x.us >= r.us + {us}) FROM r WHERE r.us IS NOT NULL)
SELECT r.tab_id, make_timestamp(r.us) AS start, count(*) AS reports, arg_max(e.event_id, (e.us, e.event_id)) AS last_event FROM r JOIN e ON e.tab_id = r.tab_id AND e.us >= r.us AND e.us < r.us + {us}, m WHERE r.us + {us} <= m.top - {delay} GROUP BY r.tab_id, r.us"""


@query(_ANCHORS.replace("{us}", str(6 * 3600 * 1_000_000)).replace("{delay}", str(2 * 86400 * 1_000_000)))
def stream_throttled(spark, sf_dir):
    """Reports of each tab, one in six hours at most, each opened by the first event after the last report."""
    rows = event_stream(spark, sf_dir).select(F.col("user_id").alias("tab_id"), F.col("ts").cast("timestamp").alias("seen"), "event_id")
    found = ran(spark, throttled(rows, millis=6 * 3600 * 1000, delay="2 days"), "append")
    return found.select("tab_id", F.col("start").cast("timestamp_ntz").alias("start"), "reports", "last_event")


@query("""WITH e AS (SELECT event_id AS download_id, CASE WHEN event_type = 'error' THEN 'SERVER_FAILED' END AS reason, CAST(floor(value * 4000) AS BIGINT) AS bytes, event_id % 90 AS minutes FROM events)
SELECT download_id, CASE WHEN reason IS NOT NULL THEN 'retry' WHEN bytes < 16384 THEN 'error_page' ELSE 'done' END AS outcome FROM e WHERE minutes <= 60""")
def stream_settled(spark, sf_dir):
    """Completions joined to their downloads as two streams; those that come more than an hour later are not matched."""
    e = event_stream(spark, sf_dir).select("event_id", F.col("ts").cast("timestamp").alias("ts"), "event_type", "value")
    pending = e.select(F.col("event_id").alias("download_id"), F.col("ts").alias("started"))
    completions = e.select(F.col("event_id").alias("download_id"), (F.col("ts") + F.expr("make_interval(0, 0, 0, 0, 0, event_id % 90)")).alias("ended"), F.when(F.col("event_type") == "error", "SERVER_FAILED").alias("reason"), F.lit("video/mp4").alias("mime"), F.floor(F.col("value") * 4000).cast("bigint").alias("bytes"))
    return ran(spark, settled(pending, completions).select("download_id", "outcome"), "append").select("download_id", "outcome")
