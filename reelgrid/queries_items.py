"""Queries of single operators on observations, items, downloads and names, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from reelgrid import constants as K
from reelgrid.functions import classify as C
from reelgrid.functions import formats as T
from reelgrid.functions import urls as U
from reelgrid.operators import hls, observe
from reelgrid.queries import OBS, _classified, _items
from reelgrid.registry import query, sql_in, sql_list, sql_text
from reelgrid.session import written
from reelgrid.sources import fixtures as X

_VIA = f"{sql_list(X.VIAS)}[event_id % {len(X.VIAS)} + 1]"


@query(f"SELECT event_id FROM events WHERE {_VIA} <> 'image' AND {_VIA} <> 'script'")
def media_requests(spark, sf_dir):
    """Responses of the request types that can carry media."""
    rows, url = U.with_parts(X.observations(spark, sf_dir), "url")
    return rows.where(C.is_request(F.col("via"), F.col("tab_id"), url)).select("event_id")


@query(OBS + f""", f AS (SELECT c.*, o.source, {_VIA.replace('event_id', 'o.event_id')} AS via, c.tab_id % 3 = 0 AS spent FROM cls c JOIN obs o USING (event_id)),
 d AS (SELECT *, source NOT IN ('link', 'meta') OR tab_id % 4 = 0 AS fetchable, via IN ('xmlhttprequest', 'other') AS from_player FROM f)
 SELECT event_id, fetchable, from_player, NOT (kind = 'file' AND from_player AND spent) AS listed, kind = 'file' AND (size IS NULL OR from_player) AND fetchable AND NOT spent AS probe FROM d""")
def item_decisions(spark, sf_dir):
    """Which candidates are fetched, listed and probed; tabs of every third number have spent their probes, those of every fourth lie on the files' site."""
    obs = X.observations(spark, sf_dir).select("event_id", "source", "via")
    found = _classified(spark, sf_dir).join(obs, "event_id").withColumn("initiator", F.when(F.col("tab_id") % 4 == 0, "https://pages.example.com/").otherwise("https://elsewhere.org/"))
    spent = X.table(spark, sf_dir, "events").select(F.col("user_id").alias("tab_id")).distinct().select("tab_id", F.when(F.col("tab_id") % 3 == 0, K.MAX_PROBES).otherwise(K.MAX_PROBES - 1).alias("probes"))
    return observe.decisions(found, spent).select("event_id", "fetchable", "from_player", "listed", "probe")


@query(OBS + "SELECT tab_id, coalesce(n, 0) AS items FROM (SELECT DISTINCT user_id + k * 1000000 AS tab_id FROM events, (SELECT unnest([0, 1]) AS k)) LEFT JOIN (SELECT tab_id, count(*) AS n FROM items GROUP BY tab_id) USING (tab_id)")
def tab_states(spark, sf_dir):
    """State by tab with a default: tabs without any item have none."""
    tabs = X.table(spark, sf_dir, "events").select(F.explode(F.array(F.col("user_id"), F.col("user_id") + 1_000_000)).alias("tab_id")).distinct()
    return tabs.join(_items(spark, sf_dir).groupBy("tab_id").agg(F.count(F.lit(1)).alias("n")), "tab_id", "left").select("tab_id", F.coalesce("n", F.lit(0)).alias("items"))


@query(OBS + "SELECT tab_id, key, row_number() OVER (PARTITION BY tab_id ORDER BY seen DESC, key) AS place FROM items")
def state_order(spark, sf_dir):
    return _items(spark, sf_dir).select("tab_id", "key", F.row_number().over(Window.partitionBy("tab_id").orderBy(F.desc("seen"), "key")).alias("place"))


_PROBE = """WITH p AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'video/mp4' WHEN 1 THEN 'text/html' WHEN 2 THEN '' ELSE 'image/png' END AS mime, doc_id % 5 = 0 AS fragment, n_chars * 1000 AS size FROM documents WHERE n_chars IS NOT NULL)"""


def _probes(spark, sf_dir):
    i = F.col("doc_id")
    mime = F.when(i % 4 == 0, "video/mp4").when(i % 4 == 1, "Text/HTML; charset=x").when(i % 4 == 2, "").otherwise("image/png")
    headers = F.array(F.struct(F.lit("content-type").alias("name"), mime.alias("value")), F.struct(F.lit("Content-Range").alias("name"), F.concat(F.lit("bytes 0-9/"), F.col("n_chars") * 1000).alias("value")))
    head = F.when(i % 5 == 0, F.lit(b"\0\0\0\x18stypmsdh")).otherwise(F.lit(b"\0\0\0\x18ftypisom"))
    return X.table(spark, sf_dir, "documents").where("n_chars is not null").select("doc_id", C.probe_result(F.lit(206), headers, head, F.lit(None).cast("bigint")).alias("probe"))


@query(_PROBE + " SELECT doc_id, size, mime, fragment, mime IN ('text/html', 'image/png') AS not_media FROM p")
def probe_results(spark, sf_dir):
    """Stored probes of texts as if they were files."""
    return _probes(spark, sf_dir).select("doc_id", "probe.size", "probe.mime", "probe.fragment", "probe.not_media")


@query(_PROBE + f""", q AS (SELECT *, doc_id % 3 <> 0 AS reached FROM p), v AS (SELECT *, NOT reached OR NOT (fragment OR mime IN ('text/html', 'image/png') OR size < {K.MIN_FILE_BYTES}) AS listed FROM q)
 SELECT doc_id, listed, CASE WHEN reached AND listed AND doc_id % 2 = 0 THEN size WHEN doc_id % 2 = 1 THEN 5 END AS size, CASE WHEN reached AND listed THEN mime ELSE '' END AS mime FROM v""")
def probe_verify(spark, sf_dir):
    """Files after verification: what is no media, a fragment or too small goes; the others take what they lacked. A third could not be reached and stays."""
    probes = _probes(spark, sf_dir)
    items = probes.select(F.lit(1).alias("tab_id"), F.col("doc_id").alias("key"), F.when(F.col("doc_id") % 2 == 1, F.lit(5)).cast("bigint").alias("size"), F.lit("").alias("mime"))
    found = probes.where("doc_id % 3 <> 0").select(F.lit(1).alias("tab_id"), F.col("doc_id").alias("key"), "probe")
    return observe.probed(items, found).select(F.col("key").alias("doc_id"), "listed", "size", "mime")


_REASONS = ["SERVER_FORBIDDEN", "FILE_NO_SPACE", "SERVER_FAILED"]


@query(f"""WITH e AS (SELECT event_id, event_type, CASE WHEN event_type = 'error' THEN {sql_list(_REASONS)}[event_id % 3 + 1] END AS reason, ['video/mp4', 'text/html', 'application/json', ''][event_id % 4 + 1] AS mime, CAST(floor(value * 4000) AS BIGINT) - 5 AS bytes FROM events)
SELECT event_id, CASE WHEN reason IN {sql_in(K.RETRY_CODES)} THEN 'retry' WHEN reason IS NOT NULL THEN 'failed' WHEN bytes >= 0 AND (bytes < 16384 OR (mime IN ('text/html', 'application/json') AND bytes < 524288)) THEN 'error_page' ELSE 'done' END AS outcome FROM e""")
def settled_downloads(spark, sf_dir):
    """How downloads ended."""
    i = F.col("event_id")
    reason = F.when(F.col("event_type") == "error", F.get(F.array(*[F.lit(r) for r in _REASONS]), (i % 3).cast("int")))
    mime = F.get(F.array(*[F.lit(m) for m in ("video/mp4", "text/html", "application/json", "")]), (i % 4).cast("int"))
    return X.table(spark, sf_dir, "events").select("event_id", C.outcome(reason, F.floor(F.col("value") * 4000).cast("bigint") - 5, mime).alias("outcome"))


@query("WITH m AS (SELECT max(ts) AS as_of FROM events) SELECT event_id AS job_id FROM events, m WHERE ts >= as_of - INTERVAL 60 MINUTE")
def fresh_jobs(spark, sf_dir):
    """Jobs that have not outlived their hour."""
    jobs = X.table(spark, sf_dir, "events").select(F.col("event_id").alias("job_id"), F.col("ts").alias("created"))
    now = jobs.agg(F.max("created").alias("as_of"))  # one row
    return observe.fresh_jobs(jobs.join(F.broadcast(now), F.col("created") <= F.col("as_of")), F.col("as_of")).select("job_id")


@query(OBS + ", m AS (SELECT max(seen) AS as_of FROM items) SELECT tab_id, key, CASE WHEN sightings % 3 = 0 THEN false WHEN sightings % 3 = 1 THEN true ELSE as_of > seen + INTERVAL 10 SECOND END AS due FROM items, m WHERE kind <> 'file'")
def enrich_retries(spark, sf_dir):
    """Manifests to be read: unread ones, and those whose read failed more than ten seconds ago."""
    items = _items(spark, sf_dir).where("kind <> 'file'")
    items = items.join(F.broadcast(items.agg(F.max("seen").alias("as_of"))), F.col("seen") <= F.col("as_of"))  # one row
    n = F.col("sightings") % 3
    due = C.needs_reading(F.lit(True), F.lit(False), n != 1, F.when(n == 2, "HTTP 500"), F.col("seen"), F.col("as_of"))
    return items.select("tab_id", "key", due.alias("due"))


_INFO = f"""WITH p AS (SELECT p_partkey, p_partkey % 3 AS k, p_size * 18 AS h, p_size AS v, p_partkey % 7 AS d FROM part),
i AS (SELECT *, CASE k WHEN 0 THEN 'file' WHEN 1 THEN 'hls' ELSE 'dash' END AS kind, CASE WHEN p_partkey % 2 = 0 THEN 'https://www.cdn.example.com/v/clip' || p_partkey || '.mp4?x=1' ELSE 'https://cdn.example.com/' END AS url, ['master', 'media', 'mpd'][p_partkey % 3 + 1] AS playlist FROM p)"""


def _described(spark, sf_dir):
    i = F.col("p_partkey")
    pick = lambda values, k: F.get(F.array(*[F.lit(v) for v in values]), k.cast("int"))
    info = F.struct(
        F.when(i % 11 == 0, "HTTP 404").alias("error"), pick(["master", "media", "mpd"], i % 3).alias("playlist"), F.col("p_size").alias("variants"), F.col("p_size").alias("segments"), (F.col("p_size") * 18).alias("max_height"), (i % 13 == 0).alias("audio_only"),
        ((i % 7) * 60).cast("double").alias("duration"), (i % 5 == 0).alias("live"), (i % 4).alias("hidden_protected"), (i % 9 == 0).alias("drm"), pick(["NONE", "AES-128"], i % 2).alias("encryption"), F.lit("").alias("unsupported"),
    )
    url = F.when(i % 2 == 0, F.concat(F.lit("https://www.cdn.example.com/v/clip"), i, F.lit(".mp4?x=1"))).otherwise("https://cdn.example.com/")
    return X.table(spark, sf_dir, "part").select("p_partkey", pick(["file", "hls", "dash"], i % 3).alias("kind"), pick(["video", "audio"], i % 2).alias("media"), url.alias("url"), (F.col("p_size") * 1048576).cast("bigint").alias("size"), info.alias("info"))


@query(_INFO + """ SELECT p_partkey, CASE WHEN kind = 'file' THEN CASE WHEN p_partkey % 2 = 0 THEN 'clip' || p_partkey || '.mp4' ELSE 'Audio file' END WHEN p_partkey % 13 = 0 THEN upper(kind) || ' audio stream' ELSE upper(kind) || ' stream' END AS title,
 concat_ws(' · ', CASE WHEN kind = 'file' THEN v || '.0 MB' ELSE nullif(concat_ws(' · ', CASE WHEN h > 0 THEN 'up to ' || h || 'p' END, CASE WHEN playlist <> 'media' AND v > 1 THEN v || ' qualities' END, CASE WHEN d > 0 THEN d || ':00' END, CASE WHEN p_partkey % 5 = 0 THEN 'live' END,
  CASE WHEN p_partkey % 4 > 0 THEN (p_partkey % 4) || ' DRM hidden' END, CASE WHEN p_partkey % 9 = 0 THEN 'DRM' WHEN p_partkey % 2 = 1 THEN 'AES-128' END), '') END, 'cdn.example.com') AS meta FROM i""")
def described_items(spark, sf_dir):
    """Title and facts of files and streams."""
    return _described(spark, sf_dir).select("p_partkey", T.describe(F.col("kind"), F.col("media"), F.col("url"), F.col("size"), F.col("info")).alias("d")).select("p_partkey", "d.*")


@query(_INFO + """ SELECT p_partkey, CASE WHEN p_partkey % 11 = 0 THEN 'error HTTP 404' WHEN playlist = 'master' THEN 'master, ' || v || ' variants' WHEN playlist = 'mpd' THEN 'mpd, ' || v || ' representations' || CASE WHEN p_partkey % 5 = 0 THEN ', live' ELSE '' END || CASE WHEN p_partkey % 9 = 0 THEN ', DRM' ELSE '' END
 ELSE 'media, ' || v || ' segments' || CASE WHEN p_partkey % 5 = 0 THEN ', live' ELSE '' END END AS line FROM i""")
def info_lines(spark, sf_dir):
    """Log lines of what manifests turned out to be."""
    return _described(spark, sf_dir).select("p_partkey", T.describe_info(F.col("info")).alias("line"))


@query("""SELECT p_partkey, CASE WHEN p_partkey % 9 = 0 THEN CASE p_partkey % 2 WHEN 0 THEN 'DRM-protected (Widevine, PlayReady): this stream can''t be downloaded.' ELSE 'DRM-protected: this stream can''t be downloaded.' END WHEN p_partkey % 5 = 0 THEN 'no way' ELSE '' END AS reason FROM part""")
def blocked_reasons(spark, sf_dir):
    i = F.col("p_partkey")
    systems = F.when(i % 2 == 0, F.array(F.lit("Widevine"), F.lit("PlayReady"))).otherwise(F.array().cast("array<string>"))
    return X.table(spark, sf_dir, "part").select("p_partkey", C.blocked_reason(i % 9 == 0, systems, F.when(i % 5 == 0, "no way").otherwise("")).alias("reason"))


_CODES = [401, 403, 404, 410, 500]
_SAID = {c: K.SAYS["refused" if c < 404 else "gone" if c < 500 else "status"].replace("{status}", str(c)) for c in _CODES}


@query(f"SELECT p_partkey, CASE p_partkey % 7 {' '.join(f'WHEN {k} THEN {sql_text(_SAID[c])}' for k, c in enumerate(_CODES))} WHEN 5 THEN {sql_text(K.SAYS['network'])} ELSE 'so ' || p_partkey END AS text FROM part")
def explained_errors(spark, sf_dir):
    """What went wrong, for people."""
    i = F.col("p_partkey") % 7
    status = F.get(F.array(*[F.lit(c) for c in _CODES]), i.cast("int"))
    return X.table(spark, sf_dir, "part").select("p_partkey", T.explain(status, F.when(i == 5, "TypeError").otherwise("Error"), F.concat(F.lit("so "), "p_partkey")).alias("text"))


@query("""WITH n AS (SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN p_name || '/a:b*?' WHEN 1 THEN '..' || p_name || '. . ' WHEN 2 THEN 'COM' || (p_partkey % 10) WHEN 3 THEN '' WHEN 4 THEN repeat(p_name || ' ', 20) ELSE '  x ' || chr(9) || p_name END AS name FROM part),
c AS (SELECT p_partkey, name, regexp_replace(regexp_replace(regexp_replace(regexp_replace(name, '[\\x00-\\x1f\\x7f<>:"/\\\\|?*]', ' ', 'g'), '\\s+', ' ', 'g'), '^ | $', '', 'g'), '^\\.+', '') AS s FROM n),
d AS (SELECT p_partkey, name, rtrim(left(regexp_replace(s, '[. ]+$', ''), 120)) AS s FROM c)
SELECT p_partkey, CASE WHEN s = '' THEN 'video' WHEN regexp_full_match(s, 'COM[0-9]') THEN '_' || s ELSE s END AS name, CASE WHEN p_partkey % 6 = 3 THEN 'file ' || p_partkey WHEN regexp_full_match(s, 'COM[0-9]') THEN '_' || s WHEN s = '' THEN 'video' ELSE s END AS base FROM d""")
def file_names(spark, sf_dir):
    """File names of odd titles; a missing title gives way to the URL's name."""
    i, name = F.col("p_partkey"), F.col("p_name")
    raw = F.when(i % 6 == 0, F.concat(name, F.lit("/a:b*?"))).when(i % 6 == 1, F.concat(F.lit(".."), name, F.lit(". . "))).when(i % 6 == 2, F.concat(F.lit("COM"), i % 10)).when(i % 6 == 3, "").when(i % 6 == 4, F.repeat(F.concat(name, F.lit(" ")), F.lit(20))).otherwise(F.concat(F.lit("  x \t"), name))
    return X.table(spark, sf_dir, "part").select("p_partkey", T.sanitize_filename(raw).alias("name"), T.base_name(raw, F.concat(F.lit("https://h.org/a/file%20"), i, F.lit(".mp4"))).alias("base"))


@query("SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, CASE WHEN l_linenumber > 3 THEN (CAST(l_quantity AS BIGINT) * 10) || ' B/s' ELSE '' END AS rate FROM lineitem")
def rate_texts(spark, sf_dir):
    """Rates as text: unknown, zero and negative ones are empty."""
    n = F.col("l_linenumber")
    rate = F.when(n > 3, F.col("l_quantity").cast("bigint") * 10).when(n == 3, 0).when(n == 2, -5)
    return X.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", T.format_rate(rate).alias("rate"))


@query(f"SELECT n_nationkey, coalesce(map {{{', '.join(f'{k}: {sql_text(v[0])}' for k, v in K.STREAM_TYPES.items())}}}[n_nationkey * 5 + 2], 'stream type 0x' || lower(to_base(n_nationkey * 5 + 2, 16))) AS label, coalesce(map {{{', '.join(f'{k}: {sql_text(v[1])}' for k, v in K.STREAM_TYPES.items())}}}[n_nationkey * 5 + 2], 'other') AS kind FROM nation")
def stream_labels(spark, sf_dir):
    """Names of elementary stream types."""
    code = F.col("n_nationkey") * 5 + 2
    return X.table(spark, sf_dir, "nation").select("n_nationkey", T.stream_type(code).alias("label"), T.stream_type(code, "kind").alias("kind"))


#: References, and what they name seen from a base with a user and a query; {i} stands for a page's number.
_BASE = "https://Me:pw@base.example.org:443/one/two/index.m3u8?token=1#top"
_ROOT = "https://Me:pw@base.example.org"
_PAIRS = [
    ("x/y.mp4", f"{_ROOT}/one/two/x/y.mp4"), ("/root/{i}.mp4?q=1", f"{_ROOT}/root/{{i}}.mp4?q=1"), ("../up/./{i}.ts", f"{_ROOT}/one/up/{{i}}.ts"), ("?only={i}", f"{_ROOT}/one/two/index.m3u8?only={{i}}"), ("#part", f"{_ROOT}/one/two/index.m3u8?token=1#part"),
    ("", f"{_ROOT}/one/two/index.m3u8?token=1"), ("//Other.example.net:443/p{i}", "https://other.example.net/p{i}"), ("HTTP://h.org:80/a/../b/{i}", "http://h.org/b/{i}"), ("ftp://h/{i}", None), ("data:text/plain,{i}", None), ("javascript:void({i})", None),
    ("\u00e9 {i}.mp4", f"{_ROOT}/one/two/%C3%A9%20{{i}}.mp4"), ("..\\x{i}.mp4", f"{_ROOT}/one/x{{i}}.mp4"), ("%2e%2E/{i}", f"{_ROOT}/one/{{i}}"), (".%2e/%2e/{i}/", f"{_ROOT}/one/{{i}}/"), ("a\tb\n{i}.ts", f"{_ROOT}/one/two/ab{{i}}.ts"), ("  {i}.ts \n", f"{_ROOT}/one/two/{{i}}.ts"),
    ("http://0x7f.1/{i}", "http://127.0.0.1/{i}"), ("http://017700000001/", "http://127.0.0.1/"), ("http://256/{i}", "http://0.0.1.0/{i}"), ("http://1.2.3.256/{i}", None), ("http://08.1/{i}", None), ("http://1.2.3.4.5/", None), ("https://h.1e/{i}", "https://h.1e/{i}"),
    ("https://ex\u00e4mple.com/{i}", "https://xn--exmple-cua.com/{i}"), ("https://fa\u00df.de/", "https://xn--fa-hia.de/"), ("https://\uff25\uff38.com\u3002/{i}", "https://ex.com./{i}"), ("//%65x.org/{i}", "https://ex.org/{i}"), ("https://a%2fb/{i}", None), ("https://a b/{i}", None),
    ("http://[::1]:8080/{i}", "http://[::1]:8080/{i}"), ("http://[1:0:0:2::FFFF:1.2.3.4]/", "http://[1::2:0:ffff:102:304]/"), ("http://[::FFFF:1.2.3.4]/{i}", "http://[::ffff:102:304]/{i}"), ("http://[1::2::3]/{i}", None), ("https://u:p%40@h.org/{i}", "https://u:p%40@h.org/{i}"), ("https://a:b@c@h.org/", "https://a:b%40c@h.org/"),
    ("https://h.org:99999/{i}", None), ("https://h.org:/{i}", "https://h.org/{i}"), ("https://h.org:0443/{i}", "https://h.org/{i}"), ("https:///{i}.org", "https://{i}.org" + "/"), ("https:{i}/x", f"{_ROOT}/one/two/{{i}}/x"), ("http:h{i}.org", "http://h{i}.org/"), ("\\\\h.org\\{i}", "https://h.org/{i}"),
    ("?q='{i}' \"<\u00e9", f"{_ROOT}/one/two/index.m3u8?q=%27{{i}}%27%20%22%3C%C3%A9"), ("#a`{i} <", f"{_ROOT}/one/two/index.m3u8?token=1#a%60{{i}}%20%3C"), ("/a^b|c{d}[{i}]'", f"{_ROOT}/a%5Eb|c%7Bd%7D[{{i}}]'"), ("../../../../{i}", f"{_ROOT}/{{i}}"), ("./", f"{_ROOT}/one/two/"), ("..", f"{_ROOT}/one/"), ("//", None),
]
_PAIRS = [(r.replace("https:///{i}.org", "https:///h{i}.org"), u.replace("https://{i}.org", "https://h{i}.org") if u else u) for r, u in _PAIRS]


@query(f"SELECT page_id, CASE page_id % {len(_PAIRS)} {' '.join(f'WHEN {k} THEN replace({sql_text(u)}, {sql_text(chr(123) + chr(105) + chr(125))}, page_id::VARCHAR)' for k, (_, u) in enumerate(_PAIRS) if u)} END AS url FROM pages")
def resolved_urls(spark, sf_dir):
    """References of all shapes against a base, one a page; what names no http(s) address has no URL."""
    i = F.col("page_id")
    reference = F.replace(F.get(F.array(*[F.lit(r) for r, _ in _PAIRS]), (i % len(_PAIRS)).cast("int")), F.lit("{i}"), i.cast("string"))
    return X.table(spark, sf_dir, "pages").select("page_id", reference.alias("r")).select("page_id", U.resolve(F.col("r"), U.base(F.lit(_BASE))).alias("url"))


@query(f"""WITH t AS (SELECT unnest([{', '.join(f"({k}, {sql_text(t)}, {sql_text(s) if s else 'NULL'})" for k, (t, s) in enumerate(X.FOREIGN))}]) AS x)
SELECT o_orderkey AS playlist_id, CASE WHEN x[3] IS NOT NULL THEN replace({sql_text(K.SAYS["playlist_scheme"])}, '{{scheme}}', x[3]) END AS error, CASE WHEN x[3] IS NULL THEN 1 ELSE 0 END AS named FROM orders JOIN t ON o_orderkey % {len(X.FOREIGN)} = x[1]""")
def playlist_errors(spark, sf_dir):
    """Playlists that name a segment, map, variant or rendition by a foreign scheme have an error and no rows; keys may have one."""
    parsed = written(hls.playlists(X.foreign_playlists(spark, sf_dir)), "playlists")
    rows = hls.segments(parsed).select("playlist_id").unionByName(hls.variants(parsed).select("playlist_id")).groupBy("playlist_id").agg(F.count(F.lit(1)).cast("int").alias("named"))
    return parsed.join(rows, "playlist_id", "left").select("playlist_id", "error", F.coalesce("named", F.lit(0)).alias("named"))


@query(OBS + """, reads AS (SELECT tab_id, key, min(seen) AS read_at FROM cls WHERE kind = 'dash' AND event_id % 2 = 0 GROUP BY tab_id, key)
SELECT c.tab_id, c.key, count(*) AS sightings, arg_max(c.url, (c.seen, c.event_id)) FILTER (read_at IS NULL OR c.seen <= read_at) AS url FROM cls c LEFT JOIN reads USING (tab_id, key) WHERE kind = 'dash' GROUP BY c.tab_id, c.key""")
def read_dash_items(spark, sf_dir):
    """DASH manifests, of which some were read at a sighting: they keep the URL that was read, the others take the latest."""
    found = _classified(spark, sf_dir).where("kind = 'dash'")
    reads = found.where("event_id % 2 = 0").select("tab_id", "key", F.col("seen").alias("read_at"))
    return observe.upsert(found, reads).select("tab_id", "key", "sightings", "url")


@query(r"""WITH n AS (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN repeat('😀', 130) WHEN 1 THEN 'x' || repeat('😀', 70) WHEN 2 THEN p_name || repeat('é', 130) ELSE p_name || '😀' END AS name FROM part)
SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN repeat('😀', 60) WHEN 1 THEN 'x' || repeat('😀', 59) WHEN 2 THEN left(name, 120) ELSE name END AS name FROM n""")
def long_names(spark, sf_dir):
    """Names are cut where UTF-16 units end, and between characters."""
    i, name = F.col("p_partkey"), F.col("p_name")
    raw = F.when(i % 4 == 0, F.repeat(F.lit("😀"), F.lit(130))).when(i % 4 == 1, F.concat(F.lit("x"), F.repeat(F.lit("😀"), F.lit(70)))).when(i % 4 == 2, F.concat(name, F.repeat(F.lit("é"), F.lit(130)))).otherwise(F.concat(name, F.lit("😀")))
    return X.table(spark, sf_dir, "part").select("p_partkey", T.sanitize_filename(raw).alias("name"))


@query("""WITH u AS (SELECT page_id, regexp_extract(url, '^(https?://[^/?#]+)', 1) AS origin FROM pages),
 m AS (SELECT page_id, unnest([(0, origin || '/v/' || page_id || '.mp4', 'element'), (1, origin || '/e/' || page_id || '.mp4?x=1&y=2&copy=3', 'element'), (2, origin || '/s/' || page_id || '.mp3', 'element'), (3, 'https://cdn.example.com/t' || page_id || '.m3u8?x=1', 'timing'),
 (4, origin || '/l/' || page_id || '.webm', 'link'), (5, origin || '/q/' || page_id || '.mp4', 'link'), (6, 'https://player.example.com/embed?id=' || page_id, 'meta')]) AS x FROM u)
SELECT page_id, x[1] - CASE WHEN page_id % 2 = 1 AND x[1] > 3 THEN 1 ELSE 0 END AS place, x[2] AS media_url, x[3] AS source FROM m WHERE page_id % 2 = 0 OR x[3] <> 'timing'""")
def page_media(spark, sf_dir):
    """Media that pages name: their HTML with an element, a link and a player's meta tag put in, and requests of every second page."""
    pages = X.media_pages(spark, sf_dir)
    entries = pages.where("page_id % 2 = 0").select("page_id", F.explode(F.array(F.concat(F.lit("https://cdn.example.com/t"), "page_id", F.lit(".m3u8?x=1")), F.lit("https://cdn.example.com/style.css"))).alias("name"), F.lit(0).alias("place"))
    return observe.page_media(pages, entries)
