"""Queries of single operators on playlists and manifests, with their SQL: protection, maps, containers, merging, and manifests that are broken."""

from __future__ import annotations

from pyspark.sql import functions as F

from reelgrid import constants as K
from reelgrid.functions import formats as T
from reelgrid.operators import dash, hls, observe
from reelgrid.queries import _MPD, _VAR, _masters, _mpd
from reelgrid.registry import query, sql_text
from reelgrid.session import spread, written
from reelgrid.sources import fixtures as X

#: Playlists of orders: a plain key for every second, a protected one for every third, a map for every fourth.
_ORD = """WITH o AS (SELECT o_orderkey AS playlist_id, o_orderkey % 2 = 0 AS plain, o_orderkey % 3 = 0 AS guarded, o_orderkey % 4 = 0 AS mapped, o_orderkey % 10 = 0 AS odd FROM orders)"""


def _orders(spark, sf_dir):
    return hls.segments(hls.playlists(X.order_playlists(spark, sf_dir)))


@query(_ORD + f""", e AS (SELECT *, guarded AND NOT plain AS drm, plain AND odd AS bad FROM o)
SELECT playlist_id, CASE WHEN drm THEN 'DRM' WHEN bad THEN 'SAMPLE-AES' WHEN plain THEN 'AES-128' ELSE 'NONE' END AS method, NOT drm AND NOT bad AS supported, drm, CASE WHEN drm THEN 'Widevine,com.example.other' ELSE '' END AS systems,
 CASE WHEN drm THEN {sql_text(K.SAYS['drm'].replace('{systems}', 'Widevine, com.example.other'))} WHEN bad THEN {sql_text(K.SAYS['method'].replace('{method}', 'SAMPLE-AES'))} ELSE '' END AS reason FROM e""")
def hls_protection(spark, sf_dir):
    """Encryption of playlists: plain, unsupported, protected or none."""
    return hls.encryption(_orders(spark, sf_dir)).select("playlist_id", "method", "supported", "drm", F.array_join("systems", ",").alias("systems"), "reason")


@query(_ORD + """ SELECT playlist_id, i AS index, CASE WHEN mapped THEN 'https://media.example.com/k/' || playlist_id || '/init.mp4' END AS map_url, CASE WHEN mapped THEN 20 END AS map_offset, CASE WHEN mapped THEN 100 END AS map_length,
 CASE WHEN mapped AND plain THEN 'https://media.example.com/k/' || playlist_id || '/k.bin' END AS map_key, CASE WHEN mapped THEN CASE WHEN guarded THEN 2 ELSE 0 END END AS map_drm, CASE WHEN guarded THEN 2 - i ELSE 0 END AS drm FROM o, (SELECT unnest([0, 1]) AS i)""")
def hls_maps(spark, sf_dir):
    """The map in effect with the keys at its tag, and the protected keys in effect: one of two is taken back before the second segment."""
    n = lambda c: F.size(c)
    return _orders(spark, sf_dir).select("playlist_id", "index", F.col("map.url").alias("map_url"), F.col("map.byte_range.offset").alias("map_offset"), F.col("map.byte_range.length").alias("map_length"), F.col("map.key.url").alias("map_key"), F.when(F.col("map").isNotNull(), n("map.drm")).alias("map_drm"), n("drm").alias("drm"))


@query(_ORD + " SELECT playlist_id, CASE WHEN mapped THEN 'fmp4' ELSE ['ts', 'aac', 'mp3', 'ac3', 'fmp4'][playlist_id % 5 + 1] END AS container FROM o")
def hls_containers(spark, sf_dir):
    return hls.container(_orders(spark, sf_dir))


@query("SELECT r_regionkey, CASE r_regionkey WHEN 0 THEN 'Playlist is too large' WHEN 1 THEN 'Not an HLS playlist' END AS playlist, CASE WHEN r_regionkey = 0 THEN 'XML document is too large' WHEN r_regionkey = 1 THEN 'Not a DASH manifest' WHEN r_regionkey < 4 THEN 'Malformed XML' WHEN r_regionkey = 4 THEN NULL END AS manifest FROM region")
def capped_texts(spark, sf_dir):
    """Texts over the size caps, of another kind, and whole ones."""
    i = F.col("r_regionkey")
    text = F.when(i == 0, F.repeat(F.lit("x"), F.lit(K.MAX_MANIFEST_CHARS + 1))).when(i == 1, "<html/>").when(i == 4, F.lit("#EXTM3U\na.ts")).otherwise(F.lit("#EXTM3U\nb.ts"))
    rows = X.table(spark, sf_dir, "region").select("r_regionkey", F.lit("https://h/x").alias("url"), text.alias("text"))
    lists = hls.playlists(rows.select(F.col("r_regionkey").alias("playlist_id"), F.col("url").alias("base_url"), "text")).select(F.col("playlist_id").alias("r_regionkey"), F.col("error").alias("playlist"))
    parsed = dash.manifests(rows.select(F.col("r_regionkey").alias("manifest_id"), "url", F.when(i == 4, "<MPD/>").otherwise(F.col("text")).alias("text"))).select(F.col("manifest_id").alias("r_regionkey"), F.col("error").alias("manifest"))
    return lists.join(parsed, "r_regionkey")


@query(_VAR + """ SELECT playlist_id, index, height > 0 OR codecs IN ('', 'avc1.4d401f,mp4a.40.2', 'hvc1.1.6.L93,ac-3') AS has_video, codecs IN ('', 'avc1.4d401f,mp4a.40.2', 'mp4a.40.2') AS remuxable FROM v""")
def codec_checks(spark, sf_dir):
    v = hls.variants(_masters(spark, sf_dir))
    return v.select("playlist_id", "index", T.has_video(F.col("height"), F.col("width"), F.col("codecs")).alias("has_video"), T.codecs_remuxable(F.col("codecs")).alias("remuxable"))


@query(_MPD + """ SELECT manifest_id, 'r' || p_partkey AS id, CASE WHEN p_partkey % 6 = 5 THEN 'webm' ELSE 'mp4' END AS container, CASE WHEN p_partkey % 6 = 5 THEN '.webm' ELSE '.mp4' END AS extension FROM p
 UNION ALL SELECT DISTINCT manifest_id, a.id, 'mp4', '.m4a' FROM p, (VALUES ('a1'), ('a2')) a(id)""")
def representation_files(spark, sf_dir):
    """Container and file extension of each representation of the main period."""
    reps = dash.representations(dash.periods(_mpd(spark, sf_dir))).where("period = 1")
    return reps.select("manifest_id", "id", "container", T.representation_extension(F.col("container"), F.col("kind")).alias("extension"))


@query(_MPD + """, v AS (SELECT manifest_id, arg_max(struct_pack(m := mode, w := p_partkey % 6 = 5), (p_size, bandwidth, -p_partkey)) AS x FROM p WHERE p_partkey % 10 <> 0 GROUP BY manifest_id)
SELECT manifest_id, x.m IN (0, 2) AND NOT x.w AS can_merge FROM v""")
def merge_checks(spark, sf_dir):
    """Whether the best video and the first audio of each manifest can be merged into one file."""
    p = dash.periods(_mpd(spark, sf_dir))
    planned = written(dash.plans(dash.taken(dash.representations(p), dash.main_period(p))), "plans")  # both are planned at once
    return dash.can_merge(planned.where("kind = 'video'"), planned.where("kind = 'audio'"))


@query(_MPD + " SELECT manifest_id, 'Widevine' AS systems, false AS protected, count(*) FILTER (p_partkey % 10 = 0) AS hidden_protected FROM p GROUP BY manifest_id HAVING count(*) FILTER (p_partkey % 10 = 0) > 0")
def mpd_protection(spark, sf_dir):
    """Manifests with protected representations: all of it or how many, and the distinct systems."""
    found = dash.protection(dash.representations(dash.periods(_mpd(spark, sf_dir))))
    return found.where("size(systems) > 0").select("manifest_id", F.array_join("systems", ",").alias("systems"), "protected", "hidden_protected")


_AT = "https://dash.example.com/x/"


@query(f"""WITH p AS (SELECT p_partkey AS manifest_id, p_partkey % {len(X.ODD_MANIFESTS)} AS k FROM part)
SELECT manifest_id, [{', '.join(sql_text(c[1]) if c[1] else 'NULL' for c in X.ODD_MANIFESTS)}][k + 1] AS error, [{', '.join(str(c[2]) for c in X.ODD_MANIFESTS)}][k + 1]::BIGINT AS segments,
 [{', '.join(sql_text(_AT + c[3]) if c[3] else 'NULL' for c in X.ODD_MANIFESTS)}][k + 1] AS first_url, [{', '.join(sql_text(_AT + c[4]) if c[4] else 'NULL' for c in X.ODD_MANIFESTS)}][k + 1] AS init_url, [{', '.join(str(c[5]) for c in X.ODD_MANIFESTS)}][k + 1] AS open_ended FROM p""")
def odd_manifests(spark, sf_dir):
    """Manifests that are broken or odd, one a part: the error, or the segments that come of them. None stops the job, none vanishes."""
    parsed = written(dash.manifests(X.odd_manifests(spark, sf_dir)), "manifests")
    plans = written(dash.plans(dash.representations(dash.periods(parsed))), "plans")
    # What is known of a manifest meets in one aggregate: nothing is joined, so nothing of the tables' size can be broadcast.
    segments = [rows.select("manifest_id", F.col("index").cast("bigint").alias("index"), "url") for rows in (dash.template_segments(plans), dash.list_segments(plans))]
    rows = parsed.select("manifest_id", F.col("error").alias("whole"))
    for more in (plans.select("manifest_id", "error", F.col("init.url").alias("init_url"), "open_ended"), *segments):
        rows = rows.unionByName(more, allowMissingColumns=True)
    found = rows.groupBy("manifest_id").agg(F.coalesce(F.max("whole"), F.max("error")).alias("error"), F.count("index").alias("segments"), F.min_by("url", "index").alias("first_url"), F.max("init_url").alias("init_url"), F.coalesce(F.bool_or("open_ended"), F.lit(False)).alias("open_ended"))
    return found.withColumn("init_url", F.when(F.col("error").isNull(), F.col("init_url")))


@query("""WITH e AS (SELECT DISTINCT user_id AS tab_id FROM events), c AS (SELECT tab_id, k, row_number() OVER (PARTITION BY tab_id ORDER BY k DESC) AS n FROM e, (SELECT unnest(generate_series(1, 600)) AS k) WHERE k <= 400 + tab_id % 201)
SELECT tab_id, k AS child FROM c WHERE n <= 500""")
def children_cap(spark, sf_dir):
    """The last 500 children of each tab's manifests."""
    tabs = spread(X.table(spark, sf_dir, "events").select(F.col("user_id").alias("tab_id")), "tab_id").distinct()  # a tab becomes hundreds of rows, so its shuffle's few bytes must not be few tasks
    rows = tabs.select("tab_id", F.explode(F.sequence(F.lit(1), (F.lit(400) + F.col("tab_id") % 201).cast("int"))).alias("child"))
    return observe.last_rows(rows, ["tab_id"], ["child"], K.MAX_CHILD_URLS)
