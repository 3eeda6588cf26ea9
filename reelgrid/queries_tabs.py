"""Queries of the tab's state machine, as a stream and in batch, and the SQL that replays its rules event by event."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from reelgrid import constants as K
from reelgrid.queries import event_stream, ran
from reelgrid.registry import query, sql_text
from reelgrid.sources import fixtures as X
from reelgrid.streaming import tabs

#: Seconds before the last event at which the lists are looked at: the watermark of every part of the stream has passed it by then.
_CUT = 60

_PICK = "['mp4', 'webm', 'mp3', 'mov', 'mkv', 'flac', 'm4a'][i % 7 + 1]"
_CHANGED = "{{'key': x.key, 'kind': x.kind, 'url': {url}, 'size': {size}, 'mime': {mime}, 'seen': x.seen, 'hidden': {hidden}, 'pending': {pending}, 'asked': {asked}, 'reading': {reading}, 'info': {info}, 'info_at': {info_at}}}"


def _changed(**to: str) -> str:
    return _CHANGED.format(**({n: f"x.{n}" for n in ("url", "size", "mime", "hidden", "pending", "asked", "reading", "info", "info_at")} | to))


#: The replay: s has each tab's state after its n-th row, and what the row came to.
REPLAY = f"""
WITH RECURSIVE e AS (SELECT event_id AS i, user_id // 3 AS tab_id, epoch_us(ts) // {X.PACE} AS us, CAST(json_extract_string(props, '$.k') AS INT) % 12 AS k, value FROM events),
f AS (SELECT *, CASE WHEN i % 6 = 0 THEN 'hls' WHEN i % 6 = 3 THEN 'dash' ELSE 'file' END AS kind, CASE WHEN i % 6 = 0 THEN 'm3u8' WHEN i % 6 = 3 THEN 'mpd' ELSE {_PICK} END AS ext, 'https://cdn' || (tab_id % 7) || '.example.com/v/' AS folder,
 CASE WHEN i % 997 = 500 THEN 'closed' WHEN i % 97 = 60 THEN 'navigation' ELSE 'item' END AS what FROM e),
g AS (SELECT *, folder || k || '.' || ext AS path FROM f),
z AS (SELECT tab_id, us, i, what, CASE what WHEN 'closed' THEN 2 WHEN 'navigation' THEN 1 ELSE 3 END AS rank, path || CASE WHEN i % 2 = 1 THEN '?id=' || k ELSE '' END AS key, kind, i % 5 IN (1, 3) AS player, i % 4 NOT IN (2, 3) OR k % 2 = 0 AS fetchable,
 path || '?token=' || i || CASE WHEN i % 2 = 1 THEN '&id=' || k ELSE '' END AS url, CASE WHEN i % 3 <> 0 THEN CAST(floor(value * 1000) AS BIGINT) END AS size, CASE WHEN i % 4 <> 1 THEN 'video/mp4' ELSE '' END AS mime, false AS reject, '' AS error, CAST([] AS VARCHAR[]) AS named, k, folder FROM g),
told AS (SELECT * FROM z UNION ALL SELECT * REPLACE (us - 2000000 AS us, 'navigating' AS what, 0 AS rank) FROM z WHERE what = 'navigation'
 UNION ALL SELECT * REPLACE (us + i % 30 * 1000000 AS us, 'probe' AS what, 4 AS rank, 20000 + i AS size, 'video/webm' AS mime, i % 4 = 0 AS reject) FROM z WHERE what = 'item' AND kind = 'file' AND i % 5 <> 0
 UNION ALL SELECT * REPLACE (us + i % 18 * 1000000 AS us, 'manifest' AS what, 5 AS rank, CASE WHEN i % 14 = 0 THEN 'HTTP 503' WHEN i % 10 = 4 THEN {sql_text(K.SAYS["playlist"])} ELSE '' END AS error,
  CASE WHEN i % 14 = 0 OR i % 10 = 4 THEN [] ELSE [folder || k || '.mp4?id=' || k, folder || (k + 1) % 12 || '.webm?id=' || (k + 1) % 12, folder || k || '.mp3?id=' || k, folder || (k + 1) % 12 || '.mov?id=' || (k + 1) % 12, folder || k || '.m4a'] END AS named) FROM z WHERE what = 'item' AND kind = 'hls' AND i % 18 <= {K.PLAYLIST_SECONDS}),
r AS (SELECT *, row_number() OVER (PARTITION BY tab_id ORDER BY us, i, rank) AS n FROM told),
s AS (
 SELECT tab_id, 0::BIGINT AS n, NULL::BIGINT AS us, NULL::BIGINT AS i, NULL::VARCHAR AS what, NULL::VARCHAR AS outcome, NULL::VARCHAR AS asks, NULL::VARCHAR AS gone, CAST([] AS STRUCT(key VARCHAR, kind VARCHAR, url VARCHAR, size BIGINT, mime VARCHAR, seen BIGINT, hidden BOOLEAN, pending BOOLEAN, asked BOOLEAN, reading BOOLEAN, info VARCHAR, info_at BIGINT)[]) AS items,
  CAST([] AS VARCHAR[]) AS rejected, CAST([] AS VARCHAR[]) AS children, 0::BIGINT AS probes, NULL::BIGINT AS moving, false AS closed FROM (SELECT DISTINCT tab_id FROM r)
 UNION ALL
 SELECT tab_id, n, us, i, what, outcome, asks, CASE WHEN outcome = 'listed' AND len(after) > {K.MAX_ITEMS} THEN after[away].key END,
  CASE WHEN outcome = 'listed' AND len(after) > {K.MAX_ITEMS} THEN list_concat(after[: away - 1], after[away + 1 :]) ELSE after END,
  CASE WHEN shut OR what IN ('navigation', 'closed') THEN [] WHEN outcome = 'rejected' THEN list_append(rejected, key)[-{K.MAX_REJECTED} :] ELSE rejected END,
  CASE WHEN shut OR what IN ('navigation', 'closed') THEN [] WHEN outcome = 'manifest' THEN known[-{K.MAX_CHILD_URLS} :] ELSE children END,
  CASE WHEN shut OR what IN ('navigation', 'closed') THEN 0 WHEN outcome = 'listed' AND asks = 'probe' THEN probes + 1 ELSE probes END,
  CASE WHEN shut OR what IN ('navigation', 'closed') THEN NULL WHEN what = 'navigating' THEN us ELSE moving END, shut OR what = 'closed'
 FROM (SELECT *, coalesce(list_position(list_transform(after, lambda x: x.hidden), true), list_position(list_transform(after, lambda x: x.kind = 'file'), true), 1) AS away
 FROM (SELECT *, CASE WHEN shut OR what = 'closed' THEN [] WHEN what = 'navigation' THEN list_filter(items, lambda x: x.seen >= coalesce(moving, us))
   WHEN outcome = 'listed' THEN list_append(items, {{'key': key, 'kind': kind, 'url': url, 'size': size, 'mime': mime, 'seen': us, 'hidden': list_contains(children, key), 'pending': coalesce(asks = 'probe', false), 'asked': fetchable, 'reading': coalesce(asks = 'read', false), 'info': NULL::VARCHAR, 'info_at': 0::BIGINT}})
   WHEN outcome = 'again' THEN list_transform(items, lambda x: CASE WHEN x.key <> key THEN x ELSE {_changed(size="CASE WHEN coalesce(x.size, 0) = 0 AND coalesce(size, 0) <> 0 THEN size ELSE x.size END", mime="CASE WHEN x.mime = '' THEN mime ELSE x.mime END", url="CASE WHEN x.kind = 'dash' AND x.info IS NOT NULL THEN x.url ELSE url END", asked="x.asked OR fetchable", reading="x.reading OR coalesce(asks = 'read', false)")} END)
   WHEN outcome = 'rejected' THEN list_filter(items, lambda x: x.key <> key)
   WHEN outcome = 'verified' THEN list_transform(items, lambda x: CASE WHEN x.key <> key THEN x ELSE {_changed(pending="false", size="coalesce(x.size, size)", mime="CASE WHEN x.mime = '' THEN mime ELSE x.mime END")} END)
   WHEN outcome = 'manifest' THEN list_transform(items, lambda x: CASE WHEN x.key = key THEN {_changed(reading="false", info="error", info_at="us")} ELSE {_changed(hidden="x.hidden OR list_contains(known, x.key)")} END)
   ELSE items END AS after
 FROM (SELECT *, CASE WHEN outcome = 'listed' AND kind = 'file' AND (size IS NULL OR player) AND fetchable AND probes < {K.MAX_PROBES} THEN 'probe' WHEN outcome = 'listed' AND kind <> 'file' AND fetchable THEN 'read'
   WHEN outcome = 'again' AND kind <> 'file' AND fetchable AND ((own.info IS NULL AND NOT own.asked) OR (own.info <> '' AND us - own.info_at > {tabs.RETRY_US})) THEN 'read' END AS asks,
   CASE WHEN outcome = 'manifest' THEN list_concat(children, list_filter(named, lambda x: NOT list_contains(children, x))) END AS known
 FROM (SELECT *, CASE WHEN shut THEN NULL WHEN what = 'item' THEN CASE WHEN kind = 'file' AND player AND probes >= {K.MAX_PROBES} THEN 'passed_over' WHEN list_contains(rejected, key) THEN 'refused' WHEN own IS NOT NULL THEN 'again' ELSE 'listed' END
   WHEN what = 'probe' AND own.pending THEN CASE WHEN reject THEN 'rejected' ELSE 'verified' END WHEN what = 'manifest' AND own.reading THEN 'manifest' END AS outcome
 FROM (SELECT r.*, s.items, s.rejected, s.children, s.probes, s.moving, s.closed AS shut, list_filter(s.items, lambda x: x.key = r.key)[1] AS own FROM s JOIN r ON r.tab_id = s.tab_id AND r.n = s.n + 1)))))),
top AS (SELECT max(us) - {_CUT} * 1000000 AS cut FROM z)
"""


def _rows(e, bodies):
    asked = e.where("what = 'item' and kind = 'hls'")
    return X.tab_rows(e).unionByName(tabs.read_manifests(asked, bodies))


def _effects(spark, sf_dir):
    """The stream of effects, up to the cut, as rows. Playlists are read in a join of two streams, whose result goes on to the tabs with its watermark."""
    e = X.tab_events(spark, sf_dir, event_stream(spark, sf_dir)).withWatermark("seen", "10 seconds")
    other = X.tab_events(spark, sf_dir, event_stream(spark, sf_dir))
    bodies = X.tab_bodies(other).withWatermark("at", "10 seconds")
    effects = ran(spark, tabs.tab_effects(_rows(e, bodies)), "append")
    cut = X.tab_events(spark, sf_dir).agg((F.max("seen") - F.expr(f"INTERVAL {_CUT} SECOND")).alias("cut"))
    return effects.join(cut, F.col("at") <= F.col("cut")).drop("cut", "batch")


@query(REPLAY + """, w AS (SELECT tab_id, arg_max(items, n) AS items FROM s, top WHERE us <= cut GROUP BY tab_id)
SELECT tab_id, x.key AS key, x.kind AS kind, x.url AS url, x.size AS size, x.mime AS mime, x.hidden AS hidden, x.pending AS pending, x.info AS info FROM (SELECT tab_id, unnest(items) AS x FROM w)""")
def stream_sessions(spark, sf_dir):
    """Each tab's list: capped, verified, rejected, folded under playlists that the stream itself reads, retried, and cleared by navigations."""
    return tabs.listed(_effects(spark, sf_dir))


@query(REPLAY + """, p AS (SELECT tab_id, n, us, lead(us) OVER (PARTITION BY tab_id ORDER BY n) AS next, unnest(items) AS x FROM s),
 q AS (SELECT tab_id, n, us, x.key AS key, x.seen AS seen, x.hidden AS hidden, x.pending AS pending FROM p)
SELECT tab_id, key, make_timestamp(seen + 20000000) AS shown FROM q JOIN (SELECT tab_id, n, lead(us) OVER (PARTITION BY tab_id ORDER BY n) AS next FROM s) USING (tab_id, n), top
WHERE pending AND NOT hidden AND us < seen + 20000000 AND (next IS NULL OR next >= seen + 20000000) AND seen + 20000000 <= cut""")
def stream_shown(spark, sf_dir):
    """Files that appear unverified because nothing came of their probe in twenty seconds: the machine's timers."""
    return _effects(spark, sf_dir).where("effect = 'shown'").select("tab_id", "key", F.col("at").cast("timestamp_ntz").alias("shown"))


@query(REPLAY + "SELECT tab_id, i AS event_id, gone AS key FROM s, top WHERE gone IS NOT NULL AND us <= cut")
def stream_caps(spark, sf_dir):
    """Which item made room where a tab's list had more than forty: a folded one, else the oldest file, else the oldest."""
    return _effects(spark, sf_dir).where("effect = 'evicted'").select("tab_id", "event_id", "key")


@query(REPLAY + "SELECT tab_id, i AS event_id, outcome, asks, gone FROM s WHERE what = 'item' AND outcome IS NOT NULL")
def tab_outcomes(spark, sf_dir):
    """What became of each candidate, by the fold of stored rows: listed, seen again, refused or passed over; what it asks for, and which item made room for it."""
    e = X.tab_events(spark, sf_dir)
    effects = tabs.replayed(_rows(e, X.tab_bodies(e)))
    own = effects.where(F.col("effect").isin("listed", "again", "evicted", *tabs.UNLISTED))
    out = F.col("effect") == "evicted"
    return own.groupBy("tab_id", "event_id").agg(F.min(F.when(~out, F.col("effect"))).alias("outcome"), F.min(F.when(~out, F.col("asks"))).alias("asks"), F.min(F.when(out, F.col("key"))).alias("gone"))


@query(REPLAY + f""", w AS (SELECT tab_id, items, what, outcome, asks, gone, i FROM s)
SELECT tab_id, max(len(items)) AS most, count(gone) AS evicted, count(*) FILTER (outcome = 'refused') AS refused, count(*) FILTER (outcome = 'passed_over') AS passed_over, count(*) FILTER (outcome = 'listed' AND asks = 'probe') AS probes, count(*) FILTER (outcome = 'again' AND asks = 'read') AS retries FROM w GROUP BY tab_id HAVING count(what) > 0""")
def tab_loads(spark, sf_dir):
    """How full tabs get, and how often items make room, are refused, passed over, probed and read again."""
    e = X.tab_events(spark, sf_dir)
    effects = tabs.replayed(_rows(e, X.tab_bodies(e)))
    is_ = lambda *names: F.col("effect").isin(*names)
    # An item that makes room goes with the event that listed another: lists are counted once both are told.
    steps = effects.groupBy("tab_id", "event_id", "at").agg(F.max("n").alias("n"), F.sum(F.when(is_("listed"), 1).when(is_(*tabs.GONE), -1).otherwise(0)).alias("more"))
    held = steps.withColumn("held", F.sum("more").over(Window.partitionBy("tab_id").orderBy("n"))).groupBy("tab_id").agg(F.max("held").alias("most"))
    counts = effects.groupBy("tab_id").agg(F.count_if(is_("evicted")).alias("evicted"), F.count_if(is_("refused")).alias("refused"), F.count_if(is_("passed_over")).alias("passed_over"), F.count_if(is_("listed") & (F.col("asks") == "probe")).alias("probes"), F.count_if(is_("again") & (F.col("asks") == "read")).alias("retries"))
    return X.tab_events(spark, sf_dir).select("tab_id").distinct().join(counts.join(held, "tab_id"), "tab_id", "left").na.fill(0)
