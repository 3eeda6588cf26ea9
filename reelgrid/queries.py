"""The registered queries of the media operators, and their DuckDB SQL, which computes the expected rows straight from the tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from reelgrid import constants as K
from reelgrid.functions import binary as B
from reelgrid.functions import classify as C
from reelgrid.functions import formats as T
from reelgrid.functions import urls as U
from reelgrid.operators import dash, hls, observe
from reelgrid.registry import ORACLE_SQL, QUERIES, query, sql_in, sql_list
from reelgrid.session import shared_dir, written
from reelgrid.sources import fixtures as X
from reelgrid.streaming.state import tab_items

_list, _in = sql_list, sql_in


#: Observations, their classes and their items, as SQL.
OBS = f"""
WITH o0 AS (SELECT event_id, user_id AS tab_id, ts AS seen, event_type, value, CAST(json_extract_string(props, '$.k') AS INT) AS k,
  {_list(X.EXTS)}[event_id % {len(X.EXTS)} + 1] AS ext0,
  CASE WHEN event_id % 3 = 0 THEN 'application/octet-stream' ELSE {_list(X.MIMES)}[event_id % {len(X.MIMES)} + 1] END AS mime0,
  CASE event_type WHEN 'error' THEN 404 WHEN 'view' THEN 206 ELSE 200 END AS status,
  CASE WHEN event_id % 5 <> 0 THEN CAST(floor(value * 10000) AS BIGINT) END AS size0,
  CASE WHEN event_id % 13 = 0 THEN 'r1.googlevideo.com' ELSE 'cdn' || (user_id % 7) || '.example.com' END AS host,
  'https://www.site' || (user_id % 5) || '.example.org/watch?v=' || event_id AS initiator,
  ['element', 'timing', 'link', 'meta'][event_id % 4 + 1] AS source FROM events),
o1 AS (SELECT *, '/v/' || CASE WHEN event_id % 11 = 0 THEN 'seg-' ELSE '' END || k || CASE WHEN ext0 = '' THEN '' ELSE '.' || ext0 END AS path FROM o0),
obs AS (SELECT *, 'https://' || host || path || '?token=' || event_id || CASE WHEN event_id % 2 = 1 THEN '&id=' || k ELSE '' END AS url,
  'https://' || host || path || CASE WHEN event_id % 2 = 1 THEN '?id=' || k ELSE '' END AS key FROM o1),
c0 AS (SELECT *, mime0 IN {_in(K.GENERIC_MIMES)} AS generic, ext0 IN {_in(K.VIDEO_EXTS)} AS v, ext0 IN {_in(K.AUDIO_EXTS)} AS a FROM obs WHERE status IN (200, 206) AND host <> 'r1.googlevideo.com'),
c1 AS (SELECT *, CASE WHEN mime0 IN {_in(K.HLS_MIMES)} OR (ext0 = 'm3u8' AND generic) THEN 'hls' WHEN mime0 IN {_in(K.DASH_MIMES)} OR (ext0 = 'mpd' AND generic) THEN 'dash'
   WHEN mime0 IN {_in(K.SEGMENT_MIMES)} OR ext0 IN {_in(K.SEGMENT_EXTS)} THEN NULL
   WHEN NOT (mime0 LIKE 'video/%' OR mime0 LIKE 'audio/%' OR (generic AND (v OR a))) THEN NULL
   WHEN size0 < {K.MIN_FILE_BYTES} THEN NULL WHEN event_id % 11 = 0 THEN NULL ELSE 'file' END AS kind FROM c0),
cls AS (SELECT tab_id, seen, event_id, url, initiator, key, kind, CASE WHEN kind <> 'file' THEN 'stream' WHEN mime0 LIKE 'video/%' OR (generic AND v) THEN 'video' ELSE 'audio' END AS media, mime0 AS mime,
  CASE kind WHEN 'hls' THEN '.m3u8' WHEN 'dash' THEN '.mpd' ELSE coalesce(map {{{", ".join(f"'{m}': '{x}'" for m, x in K.MIME_EXT.items())}}}[mime0], CASE WHEN v OR a THEN '.' || ext0 ELSE '' END) END AS ext, size0 AS size FROM c1 WHERE kind IS NOT NULL),
items AS (SELECT tab_id, key, min(seen) AS seen, arg_min(kind, (seen, event_id)) AS kind, arg_min(media, (seen, event_id)) AS media, arg_min(ext, (seen, event_id)) AS ext, arg_min(initiator, (seen, event_id)) AS initiator,
  arg_min(size, (seen, event_id)) FILTER (size > 0) AS size, coalesce(arg_min(mime, (seen, event_id)) FILTER (mime <> ''), '') AS mime, arg_max(url, (seen, event_id)) AS url, count(*) AS sightings FROM cls GROUP BY tab_id, key)
"""

_HIDDEN = """, kids AS (SELECT DISTINCT o.tab_id, o.key, p.key AS parent FROM cls o JOIN items p ON o.tab_id = p.tab_id AND p.kind <> 'file' AND o.kind = 'file' AND o.event_id % 7 = 0 WHERE o.key <> p.key),
shown AS (SELECT i.*, EXISTS (SELECT 1 FROM kids k WHERE k.tab_id = i.tab_id AND k.key = i.key) AS hidden FROM items i)"""


def _classified(spark, sf_dir):
    return observe.classified(X.observations(spark, sf_dir))


def _items(spark, sf_dir):
    return observe.upsert(_classified(spark, sf_dir))


def _hidden(spark, sf_dir):
    """Files of every seventh event are children of the tab's manifests. The first and the last manifest by key stand for all of a tab, so that
    no pairs of all children and manifests are made: a key differs from some manifest's if it differs from one of the two."""
    found = written(_classified(spark, sf_dir), "classified")
    items = observe.upsert(found)
    ends = items.where("kind <> 'file'").groupBy("tab_id").agg(F.array_distinct(F.array(F.min("key"), F.max("key"))).alias("parents"))
    children = found.where("kind = 'file' and event_id % 7 = 0").select("tab_id", "key").distinct().join(ends, "tab_id").select("tab_id", "key", F.explode("parents").alias("parent"))
    return observe.hide_children(items, children)


@query(OBS + _HIDDEN + ", r AS (SELECT *, row_number() OVER (PARTITION BY tab_id ORDER BY hidden, kind = 'file', seen DESC, key) AS rank FROM shown) SELECT tab_id, rank, kind, media, ext, size, mime, hidden, url, sightings FROM r WHERE rank <= 40")
def media_catalog(spark, sf_dir):
    """The flagship: observations to each tab's capped, ranked list of media."""
    return observe.capped(_hidden(spark, sf_dir)).select("tab_id", "rank", "kind", "media", "ext", "size", "mime", "hidden", "url", "sightings")


@query(OBS + "SELECT event_id, kind, media, mime, ext, size, key FROM cls")
def classify_responses(spark, sf_dir):
    return _classified(spark, sf_dir).select("event_id", "kind", "media", "mime", "ext", "size", "key")


@query(OBS + f"""SELECT event_id, CASE WHEN host = 'r1.googlevideo.com' THEN NULL WHEN ext0 = 'm3u8' THEN 'hls' WHEN ext0 = 'mpd' THEN 'dash' WHEN ext0 IN {_in(K.SEGMENT_EXTS)} OR event_id % 11 = 0 THEN NULL
 WHEN ext0 IN {_in(K.VIDEO_EXTS)} OR ext0 IN {_in(K.AUDIO_EXTS)} THEN 'file' END AS kind FROM obs""")
def classify_urls(spark, sf_dir):
    return X.observations(spark, sf_dir).select("event_id", C.classify_url(F.col("url"))["kind"].alias("kind"))


@query(OBS + "SELECT event_id, CASE WHEN status = 404 THEN NULL ELSE size0 END AS size, mime0 AS mime FROM obs")
def response_sizes(spark, sf_dir):
    return X.observations(spark, sf_dir).select("event_id", C.response_size(F.col("status"), F.col("headers")).alias("size"), C.content_type(F.col("headers")).alias("mime"))


@query(OBS + "SELECT event_id, key FROM obs")
def dedupe_keys(spark, sf_dir):
    return X.observations(spark, sf_dir).select("event_id", U.dedupe_key(F.col("url")).alias("key"))


@query(r"""SELECT page_id, regexp_extract(url, '^(https?://[^/?#]+)', 1) || regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1) ||
 CASE WHEN url LIKE '%?page=%' THEN '?page=' || regexp_extract(url, '[?&]page=([^&#]*)', 1) || CASE WHEN url LIKE '%&ref=%' THEN '&ref=' || regexp_extract(url, '&ref=([^&#]*)', 1) ELSE '' END
 WHEN url LIKE '%utm_source=%' THEN '?utm_source=' || regexp_extract(url, 'utm_source=([^&#]*)', 1) ELSE '' END AS key FROM pages""")
def dedupe_pages(spark, sf_dir):
    return X.table(spark, sf_dir, "pages").select("page_id", U.dedupe_key(F.col("url")).alias("key"))


@query(r"""SELECT page_id, regexp_replace(regexp_extract(url, '^https?://([^/?#]+)', 1), '^www\.', '') AS host, regexp_extract(url, '^(https?://[^/?#]+)', 1) AS origin, regexp_extract(url, '^([^?#]*)', 1) AS safe,
 regexp_extract(url, '^https?://[^/?#]+[^?#]*?([^/?#]*)/?(?:[?#].*)?$', 1) AS name FROM pages""")
def url_parts(spark, sf_dir):
    u = F.col("url")
    return X.table(spark, sf_dir, "pages").select("page_id", U.host_of(u).alias("host"), U.origin_of(u).alias("origin"), U.safe_url(u).alias("safe"), U.filename_from_url(u).alias("name"))


_HOSTS = "SELECT page_id, h, CASE WHEN page_id % 9 = 0 THEN 'a.b.shop' || page_id || '.co.uk' WHEN page_id % 9 = 1 THEN '10.0.0.' || (page_id % 250) ELSE h END AS host FROM (SELECT page_id, regexp_extract(url, '^https?://([^/?#]+)', 1) AS h FROM pages)"
_DOMAIN = r"CASE WHEN host LIKE '10.0.0.%' THEN host WHEN host LIKE '%.co.uk' THEN array_to_string(string_split(host, '.')[-3:], '.') ELSE array_to_string(string_split(host, '.')[-2:], '.') END"


def _hosts(spark, sf_dir):
    i = F.col("page_id")
    return X.table(spark, sf_dir, "pages").select("page_id", F.when(i % 9 == 0, F.concat(F.lit("a.b.shop"), i, F.lit(".co.uk"))).when(i % 9 == 1, F.concat(F.lit("10.0.0."), i % 250)).otherwise(U.host(F.col("url"))).alias("host"))


@query(f"SELECT page_id, {_DOMAIN} AS domain FROM ({_HOSTS})")
def registrable_domains(spark, sf_dir):
    return _hosts(spark, sf_dir).select("page_id", U.registrable_domain(F.col("host")).alias("domain"))


@query(f"""WITH d AS (SELECT page_id, {_DOMAIN} AS domain FROM ({_HOSTS})), n AS (SELECT page_id, domain, lead(domain) OVER (ORDER BY page_id) AS other FROM d)
SELECT page_id, domain = other AS same, CASE WHEN domain = other THEN 'include' ELSE 'omit' END AS cookies FROM n WHERE other IS NOT NULL""")
def same_site_pairs(spark, sf_dir):
    """Each page with the next by id."""
    rows = _hosts(spark, sf_dir).select("page_id", F.concat(F.lit("https://"), "host", F.lit("/x")).alias("url"))
    # Ranges of ids are in order, so the next id is in the row's own range or the first of the next range that has rows.
    ranges = written(rows.repartitionByRange("page_id").withColumn("range", F.spark_partition_id()), "ranges")
    firsts = ranges.groupBy("range").agg(F.min_by("url", "page_id").alias("url")).orderBy("range").collect()  # one row a range
    edges = spark.createDataFrame([(a["range"], b["url"]) for a, b in zip(firsts[:-1], firsts[1:], strict=True)], "range int, edge string")
    w = Window.partitionBy("range").orderBy("page_id")
    other = ranges.withColumn("other", F.lead("url").over(w)).join(F.broadcast(edges), "range", "left").withColumn("other", F.coalesce("other", "edge"))
    return other.where("other is not null").select("page_id", U.same_site(F.col("url"), F.col("other")).alias("same"), C.cookies_for(F.col("url"), F.col("other")).alias("cookies"))


@query("""WITH h AS (SELECT page_id, url, list_reduce(list_prepend(2166136261::BIGINT, list_transform(string_split(url, ''), lambda c: unicode(c)::BIGINT)), lambda h, c: (xor(h, c) * 16777619) & 4294967295) AS h FROM pages)
SELECT page_id, lower(to_base(h, 36)) AS id, h % 2000000000 + 1 AS rule_id FROM h""")
def fnv_ids(spark, sf_dir):
    return X.table(spark, sf_dir, "pages").select("page_id", U.hash_string(F.col("url")).alias("id"), U.hash_to_rule_id(F.col("url")).alias("rule_id"))


@query(OBS + "SELECT * FROM items")
def upsert_items(spark, sf_dir):
    return _items(spark, sf_dir)


@query(OBS + "SELECT tab_id, key, kind, sightings FROM items i WHERE NOT EXISTS (SELECT 1 FROM obs r WHERE r.tab_id = i.tab_id AND r.key = i.key AND r.status = 404)")
def rejected_antijoin(spark, sf_dir):
    """Items whose key was never refused on the tab."""
    obs = X.observations(spark, sf_dir)
    rejected = obs.where("status = 404").select("tab_id", U.dedupe_key(F.col("url")).alias("key")).distinct()
    return observe.without_rejected(_items(spark, sf_dir), rejected).select("tab_id", "key", "kind", "sightings")


@query(OBS + _HIDDEN + "SELECT tab_id, key, kind, hidden FROM shown")
def hidden_children(spark, sf_dir):
    return _hidden(spark, sf_dir).select("tab_id", "key", "kind", "hidden")


@query(OBS + ", nav AS (SELECT tab_id, max(seen) AS nav FROM obs WHERE event_type = 'signup' GROUP BY tab_id) SELECT i.tab_id, i.key, i.seen FROM items i LEFT JOIN nav USING (tab_id) WHERE nav IS NULL OR i.seen >= nav")
def since_navigation(spark, sf_dir):
    return observe.since_navigation(_items(spark, sf_dir), X.navigations(X.observations(spark, sf_dir))).select("tab_id", "key", "seen")


@query("SELECT user_id AS tab_id, event_id, left(event_type || ' ' || props, 300) AS message FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n <= 80")
def last80_log(spark, sf_dir):
    """The last 80 messages of each tab's log."""
    e = X.table(spark, sf_dir, "events").withColumnRenamed("user_id", "tab_id")
    return observe.last_rows(e, ["tab_id"], ["ts", "event_id"], K.MAX_LOG).select("tab_id", "event_id", F.substring(F.concat_ws(" ", "event_type", "props"), 1, 300).alias("message"))


@query(OBS + "SELECT tab_id, key, event_id FROM (SELECT *, row_number() OVER (PARTITION BY tab_id ORDER BY seen DESC, event_id DESC) AS n FROM obs WHERE status = 404) WHERE n <= 100")
def last100_rejected(spark, sf_dir):
    refused = X.observations(spark, sf_dir).where("status = 404").select("tab_id", U.dedupe_key(F.col("url")).alias("key"), "seen", "event_id")
    return observe.last_rows(refused, ["tab_id"], ["seen", "event_id"], K.MAX_REJECTED).select("tab_id", "key", "event_id")


@query(OBS + "SELECT tab_id, key AS url, arg_max(source, (CASE source WHEN 'element' THEN 3 WHEN 'timing' THEN 2 ELSE 1 END, -event_id)) AS source FROM obs GROUP BY tab_id, key")
def best_source(spark, sf_dir):
    return observe.best_source(X.observations(spark, sf_dir).select("tab_id", U.dedupe_key(F.col("url")).alias("url"), "source", "event_id"))


@query("SELECT user_id AS tab_id, event_id, event_type FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events) WHERE p IS DISTINCT FROM event_type")
def report_changes(spark, sf_dir):
    e = X.table(spark, sf_dir, "events").withColumnRenamed("user_id", "tab_id")
    return observe.report_changes(e, ["tab_id"], ["ts", "event_id"], F.col("event_type")).select("tab_id", "event_id", "event_type")


@query(OBS + _HIDDEN + ", m AS (SELECT max(seen) AS as_of FROM obs) SELECT tab_id, count(*) FILTER (NOT hidden AND NOT (size IS NULL AND as_of < seen + INTERVAL 20 SECOND)) AS badge FROM shown, m GROUP BY tab_id")
def visible_items(spark, sf_dir):
    """Badge counts: items that are neither hidden nor waiting for verification."""
    now = X.observations(spark, sf_dir).agg(F.max("seen").alias("as_of"))  # one row
    items = _hidden(spark, sf_dir).withColumn("pending", F.col("size").isNull()).join(F.broadcast(now), F.col("seen") <= F.col("as_of"))
    return observe.badge_count(items, F.col("as_of"))


@query(OBS + "SELECT tab_id, key, row_number() OVER (PARTITION BY tab_id ORDER BY (kind <> 'dash') DESC, seen DESC, key) AS place FROM items")
def popup_order(spark, sf_dir):
    return observe.ordered_for_popup(_items(spark, sf_dir).withColumn("downloadable", F.col("kind") != "dash")).select("tab_id", "key", "place")


@query("SELECT user_id AS tab_id, bool_or(event_type = 'error') AS drm, bool_or(event_type = 'click') AS blob, max(CAST(floor(value) AS INT)) AS videos FROM events GROUP BY user_id")
def tab_flags(spark, sf_dir):
    e = X.table(spark, sf_dir, "events")
    return observe.flags(e.select(F.col("user_id").alias("tab_id"), (F.col("event_type") == "error").alias("drm"), (F.col("event_type") == "click").alias("blob"), F.floor("value").cast("int").alias("videos")))


@query(r"SELECT page_id, regexp_matches(left(html, 64), '^\s*(<!doctype|<html|<head|<body|<\?xml|\{\s*\"|\[\s*[{\"])', 'i') AS is_text FROM pages")
def html_sniff(spark, sf_dir):
    return X.table(spark, sf_dir, "pages").select("page_id", C.is_text_start(F.encode(F.col("html"), "UTF-8")).alias("is_text"))


@query(OBS + "SELECT tab_id, key, CASE WHEN sightings % 5 = 4 THEN 'error' WHEN kind <> 'file' OR url LIKE 'https://cdn3.%' THEN 'page' ELSE 'browser' END AS route, CASE kind WHEN 'hls' THEN 'HLS' WHEN 'dash' THEN 'DASH' ELSE CASE WHEN ext <> '' THEN upper(ltrim(ext, '.')) WHEN media = 'audio' THEN 'AUDIO' ELSE 'VIDEO' END END AS badge FROM items")
def routes(spark, sf_dir):
    """Route and badge of each item; hosts that refuse plain requests are joined by host."""
    items = _items(spark, sf_dir).withColumn("host", U.host(F.col("url")))
    refusing = spark.createDataFrame([("cdn3.example.com", True)], "host string, refusing boolean")
    rows = items.join(F.broadcast(refusing), "host", "left")
    return rows.select("tab_id", "key", C.route(F.col("kind"), F.col("host"), F.col("refusing"), F.col("sightings") % 5 == 4, F.lit("")).alias("route"), C.badge(F.col("kind"), F.col("media"), F.col("ext")).alias("badge"))


@query(OBS + r"SELECT tab_id, key, kind, regexp_extract(url, '^([^?#]*)', 1) AS url, regexp_extract(initiator, '^https://www\.([^/]*)', 1) AS page_host FROM items")
def diagnostics(spark, sf_dir):
    return observe.diagnostics(_items(spark, sf_dir)).select("tab_id", "key", "kind", "url", "page_host")


@query("""WITH n AS (SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, CAST(l_quantity AS BIGINT) * 130 AS s, CAST(l_quantity AS BIGINT) * 1048576 AS b FROM lineitem)
SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, CASE WHEN s >= 3600 THEN (s // 3600) || ':' || lpad((s % 3600 // 60)::VARCHAR, 2, '0') ELSE (s // 60)::VARCHAR END || ':' || lpad((s % 60)::VARCHAR, 2, '0') AS duration_text,
 (b // 1048576) || CASE WHEN b >= 104857600 THEN ' MB' ELSE '.0 MB' END AS size_text, (b // 1048576) || CASE WHEN b >= 104857600 THEN ' MB' ELSE '.0 MB' END || '/s' AS rate_text FROM n""")
def format_texts(spark, sf_dir):
    n = F.col("l_quantity").cast("bigint")
    return X.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", T.format_duration((n * 130).cast("double")).alias("duration_text"), T.format_bytes(n * 1048576).alias("size_text"), T.format_rate(n * 1048576).alias("rate_text"))


@query("SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, CAST(l_linenumber * 86400 + l_quantity * 3600 + l_linenumber * 60 + l_suppkey % 60 + 0.5 AS DOUBLE) AS seconds FROM lineitem")
def iso_durations(spark, sf_dir):
    text = F.concat(F.lit("P"), "l_linenumber", F.lit("DT"), F.col("l_quantity").cast("int"), F.lit("H"), "l_linenumber", F.lit("M"), F.col("l_suppkey") % 60, F.lit(".5S"))
    return X.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", T.parse_duration(text).alias("seconds"))


@query("""SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, CASE WHEN l_suppkey >= l_linenumber THEN l_linenumber END AS range_offset, CASE WHEN l_suppkey >= l_linenumber THEN l_suppkey - l_linenumber + 1 END AS range_length,
 l_partkey AS byte_length, CASE WHEN l_linenumber % 2 = 0 THEN l_suppkey END AS byte_offset FROM lineitem""")
def byte_ranges(spark, sf_dir):
    a, b = T.parse_range(F.concat_ws("-", F.col("l_linenumber").cast("string"), F.col("l_suppkey").cast("string"))), T.parse_byte_range(F.concat(F.col("l_partkey"), F.when(F.col("l_linenumber") % 2 == 0, F.concat(F.lit("@"), "l_suppkey")).otherwise("")))
    return X.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", a["offset"].alias("range_offset"), a["length"].alias("range_length"), b["length"].alias("byte_length"), b["offset"].alias("byte_offset"))


_SEG = """WITH s AS (SELECT *, row_number() OVER w - 1 AS i, lag(l_linestatus) OVER w AS status0 FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey)),
g AS (SELECT *, CAST(l_extendedprice AS BIGINT) AS len0, CAST(trunc(l_extendedprice) AS BIGINT) AS len, 'https://media.example.com/a/o' || l_orderkey || '/' || l_partkey || '.ts' AS url FROM s)"""


def _segments(spark, sf_dir, *columns):
    return hls.read_segments(X.playlists(spark, sf_dir), *columns)


@query(_SEG + " SELECT l_orderkey AS playlist_id, i AS index, i + 100 AS sequence, url, l_quantity AS duration, coalesce(l_linestatus <> status0, false) AS discontinuity FROM g")
def hls_segments(spark, sf_dir):
    return _segments(spark, sf_dir, "sequence", "url", "duration", "discontinuity")


@query(_SEG + """, f AS (SELECT *, min(i) OVER (PARTITION BY l_orderkey, url) AS first FROM g)
SELECT l_orderkey AS playlist_id, i AS index, CAST(CASE WHEN first = 0 THEN 1000 ELSE 0 END + coalesce(sum(len) OVER (PARTITION BY l_orderkey, url ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS range_offset, len AS range_length FROM f""")
def hls_byteranges(spark, sf_dir):
    return _segments(spark, sf_dir, "range_offset", "range_length")


@query(_SEG + """, r AS (SELECT *, sum(CASE WHEN prev IS DISTINCT FROM l_returnflag THEN 1 ELSE 0 END) OVER (PARTITION BY l_orderkey ORDER BY i) AS run FROM (SELECT *, lag(l_returnflag) OVER (PARTITION BY l_orderkey ORDER BY i) AS prev FROM g))
SELECT l_orderkey AS playlist_id, i AS index, CASE WHEN l_returnflag <> 'N' THEN 'AES-128' END AS method, CASE WHEN l_returnflag <> 'N' THEN 'https://media.example.com/a/o' || l_orderkey || '/key,' || l_returnflag || '.bin' END AS key_url,
 CASE WHEN l_returnflag <> 'N' THEN lpad(upper(to_base(first_value(l_suppkey) OVER (PARTITION BY l_orderkey, run ORDER BY i), 16)), 32, '0') END AS iv FROM r""")
def hls_keys(spark, sf_dir):
    return _segments(spark, sf_dir, "key").select("playlist_id", "index", F.col("key.method").alias("method"), F.col("key.url").alias("key_url"), F.hex("key.iv").alias("iv"))


@query(_SEG + " SELECT l_orderkey AS playlist_id, count(*) AS segments, sum(l_quantity) AS duration, l_orderkey % 4 = 0 AS live, CASE WHEN bool_or(l_returnflag <> 'N') THEN 'AES-128' ELSE 'NONE' END AS encryption, false AS drm FROM g GROUP BY l_orderkey")
def hls_summary(spark, sf_dir):
    return hls.read_summaries(X.playlists(spark, sf_dir))


@query(_SEG + " SELECT l_orderkey AS playlist_id, i AS index, coalesce(sum(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS start FROM g")
def hls_elapsed(spark, sf_dir):
    return hls.elapsed(_segments(spark, sf_dir, "clock")).select("playlist_id", "index", "start")


_VAR = f"""WITH v AS (SELECT p_brand, p_brand || '/' || (p_partkey // {X.BLOCK}) AS playlist_id, row_number() OVER (PARTITION BY p_brand, p_partkey // {X.BLOCK} ORDER BY p_partkey) - 1 AS index, p_partkey, 'https://media.example.com/m/v/' || p_partkey || '.m3u8' AS url, CAST(floor(p_retailprice * 1000) AS BIGINT) AS bandwidth,
 CASE WHEN p_partkey % 3 = 0 THEN CAST(floor(p_retailprice * 900) AS BIGINT) ELSE 0 END AS avg_bandwidth, CASE WHEN p_partkey % 5 <> 0 THEN p_size * 32 ELSE 0 END AS width, CASE WHEN p_partkey % 5 <> 0 THEN p_size * 18 ELSE 0 END AS height,
 CASE WHEN p_partkey % 2 = 0 THEN 59.94 ELSE 0.0 END::DOUBLE AS frame_rate, {_list(X.CODECS)}[p_partkey % 4 + 1] AS codecs, 'aud' || (p_partkey % 2) AS audio_group FROM part),
r AS (SELECT *, CASE WHEN avg_bandwidth > 0 THEN avg_bandwidth ELSE bandwidth END AS rate FROM v)"""


def _masters(spark, sf_dir):
    return hls.playlists(X.masters(spark, sf_dir))


@query(_VAR + " SELECT playlist_id, index, url, bandwidth, avg_bandwidth, width, height, frame_rate, codecs, audio_group, row_number() OVER (PARTITION BY playlist_id ORDER BY height DESC, rate DESC, index) AS place FROM r")
def hls_variants(spark, sf_dir):
    return hls.sorted_variants(hls.variants(_masters(spark, sf_dir))).drop("subtitle_group")


@query(_VAR + """ SELECT playlist_id, index, concat_ws(' · ', CASE WHEN height > 0 THEN height || 'p' WHEN codecs = 'mp4a.40.2' THEN 'Audio only' END, CASE WHEN frame_rate > 30 THEN '60fps' END,
 CASE WHEN rate >= 1000000 THEN (floor(rate / 1000000.0 * 10 + 0.5)::BIGINT // 10) || '.' || (floor(rate / 1000000.0 * 10 + 0.5)::BIGINT % 10) || ' Mbps' ELSE floor(rate / 1000.0 + 0.5)::BIGINT || ' kbps' END) AS label FROM r""")
def variant_labels(spark, sf_dir):
    v = hls.variants(_masters(spark, sf_dir))
    return v.select("playlist_id", "index", T.variant_label(*[F.col(c) for c in ("height", "width", "codecs", "frame_rate", "bandwidth", "avg_bandwidth")]).alias("label"))


@query(_VAR + " SELECT playlist_id, index, a.name, a.audio_url, a.place FROM r JOIN (VALUES ('Two', 'https://media.example.com/m/a/2.m3u8', 1), ('One, first', 'https://media.example.com/m/a/1.m3u8', 2)) a(name, audio_url, place) ON audio_group = 'aud0'")
def audio_join(spark, sf_dir):
    parsed = _masters(spark, sf_dir)
    return hls.external_audio(hls.variants(parsed), hls.renditions(parsed)).select("playlist_id", "index", "name", "audio_url", "place")


@query(_VAR + """ SELECT playlist_id, count(*) AS variants, nullif(max(height), 0) AS max_height, bool_and(height = 0 AND codecs = 'mp4a.40.2') AS audio_only, any_value((length(p_brand) + ascii(right(p_brand, 1))) % 2 = 1) AS drm, least(500, count(*) + 3) AS children FROM r GROUP BY playlist_id""")
def hls_master_summary(spark, sf_dir):
    parsed = _masters(spark, sf_dir)
    s = hls.summarize_master(hls.variants(parsed), hls.renditions(parsed), hls.session_keys(parsed))
    return s.select("playlist_id", "variants", "max_height", "audio_only", "drm", F.size("child_urls").cast("long").alias("children"))


_MPD = f"WITH p AS (SELECT *, p_partkey % 4 AS mode, p_brand || '/' || (p_partkey // {X.BLOCK}) AS manifest_id, CAST(floor(p_retailprice * 1000) AS BIGINT) AS bandwidth FROM part)"


def _mpd(spark, sf_dir):
    return dash.manifests(X.manifests(spark, sf_dir))


@query(_MPD + """ SELECT manifest_id, 'r' || p_partkey AS id, bandwidth, CAST(p_size * 32 AS BIGINT) AS width, CAST(p_size * 18 AS BIGINT) AS height, p_partkey % 10 = 0 AS protected, CASE WHEN p_partkey % 10 = 0 THEN 'Widevine' ELSE '' END AS systems,
 'https://dash.example.com/x/base/main/' || CASE WHEN mode = 3 THEN 'one-' || p_partkey || '.mp4' ELSE '' END AS base, ['template', 'template', 'list', 'single'][mode + 1] AS mode,
 (p_size * 18) || 'p · ' || CASE WHEN bandwidth >= 1000000 THEN (floor(bandwidth / 1000000.0 * 10 + 0.5)::BIGINT // 10) || '.' || (floor(bandwidth / 1000000.0 * 10 + 0.5)::BIGINT % 10) || ' Mbps' ELSE floor(bandwidth / 1000.0 + 0.5)::BIGINT || ' kbps' END AS label FROM p""")
def mpd_representations(spark, sf_dir):
    reps = dash.representations(dash.periods(_mpd(spark, sf_dir))).where("kind = 'video' and period = 1")
    label = T.representation_label(F.col("kind"), F.col("height"), F.col("bandwidth"), F.lit(""), F.lit(""))
    return dash.plans(reps).select("manifest_id", "id", "bandwidth", "width", "height", "protected", F.array_join("systems", ",").alias("systems"), F.col("url").alias("base"), "mode", label.alias("label"))


@query(_MPD + " SELECT DISTINCT manifest_id, 1 AS period, 20.0::DOUBLE AS start, 80.0::DOUBLE AS duration FROM p")
def main_period(spark, sf_dir):
    return dash.main_period(dash.periods(_mpd(spark, sf_dir))).select("manifest_id", "period", "start", "duration")


@query(_MPD + """ SELECT manifest_id, CASE WHEN count(*) FILTER (p_partkey % 10 <> 0) > 0 THEN count(*) FILTER (p_partkey % 10 <> 0) ELSE 2 END AS variants, CAST(max(p_size * 18) FILTER (p_partkey % 10 <> 0) AS BIGINT) AS max_height, count(*) FILTER (p_partkey % 10 <> 0) = 0 AS audio_only,
 80.0::DOUBLE AS duration, false AS live, false AS drm, count(*) FILTER (p_partkey % 10 = 0) AS hidden_protected, '' AS unsupported, 2 AS periods FROM p GROUP BY manifest_id""")
def mpd_summary(spark, sf_dir):
    p = dash.periods(_mpd(spark, sf_dir))
    return dash.summarize(p, dash.representations(p)).drop("systems")


def _plans(spark, sf_dir):
    return dash.plans(dash.representations(dash.periods(_mpd(spark, sf_dir))))


@query(_MPD + """, e AS (SELECT manifest_id, p_partkey, p_size * 100 AS d, 100 + k * p_size * 100 AS t, k AS i FROM p, (SELECT unnest([0, 1, 2]) AS k) WHERE mode = 0
 UNION ALL SELECT manifest_id, p_partkey, p_size * 50, 100 + 3 * p_size * 100, 3 FROM p WHERE mode = 0
 UNION ALL SELECT manifest_id, p_partkey, 4000, 20000 + k * 4000, 4 + k FROM p, (SELECT unnest(generate_series(0, 15)) AS k) WHERE mode = 0)
SELECT manifest_id, 'r' || p_partkey AS id, CAST(i + 5 AS BIGINT) AS number, CAST(t AS BIGINT) AS time, (t - 100) / 1000.0::DOUBLE AS start, d / 1000.0::DOUBLE AS duration, 'https://dash.example.com/x/base/main/r' || p_partkey || '/' || t || '-' || lpad((i + 5)::VARCHAR, 5, '0') || '.m4s' AS url FROM e""")
def timeline_segments(spark, sf_dir):
    p = _plans(spark, sf_dir)
    return dash.template_segments(p.where("timeline is not null")).select("manifest_id", "id", "number", "time", "start", "duration", "url")


@query(_MPD + """ SELECT manifest_id, 'r' || p_partkey AS id, CAST(k + 1 AS BIGINT) AS number, CAST(k * 7 AS DOUBLE) AS start, 'https://dash.example.com/x/base/main/n' || (k + 1) || '_' || bandwidth || '.m4s' AS url FROM p, (SELECT unnest(generate_series(0, 11)) AS k) WHERE mode = 1
 UNION ALL SELECT DISTINCT manifest_id, a.id, CAST(k + 1 AS BIGINT), k * 2.5, 'https://dash.example.com/x/base/main/a-' || (k + 1) || '.m4s' FROM p, (VALUES ('a1'), ('a2')) a(id), (SELECT unnest(generate_series(0, 31)) AS k)""")
def template_urls(spark, sf_dir):
    p = _plans(spark, sf_dir).where("mode = 'template' and timeline is null")
    return dash.template_segments(p).select("manifest_id", "id", "number", "start", "url")


@query(_MPD + """ SELECT manifest_id, 'r' || p_partkey AS id, CAST(k + 1 AS BIGINT) AS number, k * (p_size / 10.0::DOUBLE) AS start, p_size / 10.0::DOUBLE AS duration, CASE WHEN k = 1 THEN 100 END AS range_offset, CASE WHEN k = 1 THEN 200 END AS range_length,
 'https://dash.example.com/x/base/main/' || CASE WHEN k = 1 THEN '' ELSE 'l' || (k + 1) || '.m4s' END AS url FROM p, (SELECT unnest([0, 1, 2]) AS k) WHERE mode = 2""")
def list_segments(spark, sf_dir):
    p = _plans(spark, sf_dir)
    rows = dash.list_segments(p)
    return rows.select("manifest_id", "id", "number", F.round("start", 9).alias("start"), "duration", F.col("range.offset").alias("range_offset"), F.col("range.length").alias("range_length"), "url")


ORACLE_SQL["list_segments"] = ORACLE_SQL["list_segments"].replace("k * (p_size / 10.0::DOUBLE) AS start", "round(k * (p_size / 10.0::DOUBLE), 9) AS start")


@query("""WITH b AS (SELECT l_orderkey AS manifest_id, CASE WHEN l_returnflag = 'N' THEN 0 ELSE 1 END AS is_audio, row_number() OVER w - 1 AS index, coalesce(sum(l_quantity) OVER (PARTITION BY l_orderkey, l_returnflag = 'N' ORDER BY l_linenumber, l_partkey, l_suppkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
 FROM lineitem WINDOW w AS (PARTITION BY l_orderkey, l_returnflag = 'N' ORDER BY l_linenumber, l_partkey, l_suppkey))
SELECT manifest_id, is_audio, index, start, row_number() OVER (PARTITION BY manifest_id ORDER BY start, is_audio, index) - 1 AS place FROM b""")
def merge_order(spark, sf_dir):
    """Segments of a video and an audio stream in writing order."""
    li = X.table(spark, sf_dir, "lineitem")
    w = Window.partitionBy("l_orderkey", F.col("l_returnflag") == "N").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    start = F.coalesce(F.sum("l_quantity").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rows = li.select(F.col("l_orderkey").alias("manifest_id"), (F.row_number().over(w) - 1).alias("index"), start.alias("start"), "l_returnflag")
    return dash.merge_order(rows.where("l_returnflag = 'N'").drop("l_returnflag"), rows.where("l_returnflag <> 'N'").drop("l_returnflag")).select("manifest_id", "is_audio", "index", "start", "place")


@query("SELECT doc_id, sha256(text) AS clear, length(text) > 0 AS changed, lpad(upper(to_base(doc_id, 16)), 32, '0') AS iv FROM documents")
def aes_roundtrip(spark, sf_dir):
    """Encrypts each text with a plain key and the vector of its number, and decrypts it again."""
    iv = T.iv_from_sequence(F.col("doc_id"))
    key = F.unhex(F.lit("000102030405060708090a0b0c0d0e0f"))
    packed = F.expr("substring(aes_encrypt(encode(text, 'UTF-8'), unhex('000102030405060708090a0b0c0d0e0f'), 'CBC', 'PKCS', unhex(lpad(hex(doc_id), 32, '0'))), 17)")
    rows = X.table(spark, sf_dir, "documents").select("doc_id", "text", packed.alias("data"), iv.alias("iv"))
    return rows.select("doc_id", F.sha2(T.decrypt(F.col("data"), key, F.col("iv")), 256).alias("clear"), ((F.length("text") > 0) & (F.octet_length("data") % 16 == 0)).alias("changed"), F.hex("iv").alias("iv"))


@query("SELECT event_id, 8 + event_id % 9 AS first_end, 8 + event_id % 9 + 16 AS second_end, CASE WHEN event_id % 4 = 0 THEN 'styp' ELSE 'ftyp' END AS type, event_id % 4 = 0 AS fragment FROM events")
def mp4_boxes(spark, sf_dir):
    """Boxes put together from event ids and read again; the second has a 64-bit size."""
    i = F.col("event_id")
    kind = F.when(i % 4 == 0, "styp").otherwise("ftyp")
    first = F.concat(F.lpad(F.hex(8 + i % 9), 8, "0"), F.hex(F.encode(kind, "UTF-8")), F.repeat(F.lit("AA"), (i % 9).cast("int")))
    data = F.unhex(F.concat(first, F.lit("000000016D646174" + "0000000000000010")))
    rows = X.table(spark, sf_dir, "events").select("event_id", data.alias("data")).withColumn("b", B.read_boxes(F.col("data")))
    return rows.select("event_id", F.col("b.boxes")[0]["end"].alias("first_end"), F.col("b.boxes")[1]["end"].alias("second_end"), F.col("b.boxes")[0]["type"].alias("type"), C.is_fragment_start(F.col("data")).alias("fragment"))


@query("SELECT event_id, 27 AS video_type, 257 + event_id % 7 AS video_pid, CASE WHEN event_id % 2 = 0 THEN 15 ELSE 129 END AS audio_type, event_id % 2 = 0 AS remuxable FROM events")
def ts_streams(spark, sf_dir):
    """Program maps put together from event ids and read again."""
    i = F.col("event_id")
    pat = "474000100000B00D0001C100000001E100" + "00000000"
    entry = F.concat(F.lit("1BE"), F.lpad(F.hex(257 + i % 7), 3, "0"), F.lit("F000"), F.when(i % 2 == 0, "0F").otherwise("81"), F.lit("E150F000"))
    pmt = F.concat(F.lit("474100100002B0170001C10000E101F000"), entry, F.lit("00000000"))
    data = F.unhex(F.concat(F.rpad(F.lit(pat), 376, "F"), F.rpad(pmt, 376, "F")))
    rows = X.table(spark, sf_dir, "events").select("event_id", B.read_ts_streams(data).alias("s"))
    return rows.select("event_id", F.col("s")[0]["type"].alias("video_type"), F.col("s")[0]["pid"].cast("long").alias("video_pid"), F.col("s")[1]["type"].alias("audio_type"), B.all_remuxable(F.col("s")).alias("remuxable"))


@query()
def clean_names(spark, sf_dir):
    """File names of texts' first lines (NFKC is beyond SQL)."""
    return X.table(spark, sf_dir, "documents").select("doc_id", T.sanitize_filename(F.element_at(F.split("text", "\n"), 1)).alias("name"))


#: Streams keep their state in RocksDB; a batch's commit writes what it changed, not a snapshot of each store, and writes read nothing to keep a count of rows.
STATE_CONF = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.trackTotalNumberOfRows": "false",
}


def event_stream(spark, sf_dir):
    return spark.readStream.schema(X.table(spark, sf_dir, "events").schema).parquet(f"{sf_dir}/events.parque[t]")


def ran(spark, updates, mode="update"):
    """The rows that a stream puts out, with the batch of each, after all its input has been read."""
    folder = f"{shared_dir(spark)}/reelgrid/stream-{uuid.uuid4().hex}"
    before = {name: spark.conf.get(name, None) for name in STATE_CONF}
    for name, value in STATE_CONF.items():
        spark.conf.set(name, value)
    try:
        updates.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).foreachBatch(lambda rows, n: rows.withColumn("batch", F.lit(n)).write.mode("append").parquet(f"{folder}/out")).start().awaitTermination()
    finally:
        for name, value in before.items():
            spark.conf.set(name, value) if value else spark.conf.unset(name)
    return spark.read.schema(updates.schema.add("batch", "long")).parquet(f"{folder}/out")


@query(OBS + "SELECT tab_id, key, kind, media, ext, size, mime, url, sightings FROM items")
def stream_items(spark, sf_dir):
    """Events read as a stream into keyed state per tab; each item's last update. Equals the batch upsert."""
    found = observe.classified(X.observations(spark, sf_dir, event_stream(spark, sf_dir))).withColumn("what", F.lit("item")).withColumn("seen", F.col("seen").cast("timestamp"))
    rows = ran(spark, tab_items(found))
    last = rows.groupBy("tab_id", "key").agg(F.max_by(F.struct("gone", "kind", "media", "ext", "size", "mime", "url", "sightings"), "batch").alias("x"))
    return last.select("tab_id", "key", "x.*").where("not gone").drop("gone")



