"""Inputs derived from the star-schema tables: observations, playlists and manifests with known contents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from reelgrid.session import spread

EXTS = ["mp4", "webm", "m3u8", "mpd", "ts", "m4s", "mp3", "exe", "html", "", "mov", "flac", "mkv", "aac", "m4a"]
MIMES = ["video/mp4", "video/webm", "application/vnd.apple.mpegurl", "application/dash+xml", "video/mp2t", "video/iso.segment", "audio/mpeg", "application/x-msdownload", "text/html", "", "video/quicktime", "audio/flac", "video/x-matroska", "audio/aac", "audio/mp4"]


VIAS = ["xmlhttprequest", "media", "other", "main_frame", "image", "script"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pick(values: list[str], k: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (k % len(values) + 1).cast("int"))


def observations(spark: SparkSession, sf_dir: str, events: DataFrame | None = None) -> DataFrame:
    """Response observations from events (a stream or the table): tab_id, seen, event_id, event_type, url, status, headers, initiator, source, via, size."""
    e = table(spark, sf_dir, "events") if events is None else events
    i = F.col("event_id")
    rows = e.select(
        "event_id",
        F.col("user_id").alias("tab_id"),
        F.col("ts").alias("seen"),
        "event_type",
        F.get_json_object("props", "$.k").cast("int").alias("k"),
        _pick(EXTS, i).alias("ext0"),
        F.when(i % 3 == 0, "application/octet-stream").otherwise(_pick(MIMES, i)).alias("mime0"),
        F.when(F.col("event_type") == "error", 404).when(F.col("event_type") == "view", 206).otherwise(200).alias("status"),
        F.when(i % 5 != 0, F.floor(F.col("value") * 10000).cast("bigint")).alias("size0"),
        F.when(i % 13 == 0, "r1.googlevideo.com").otherwise(F.concat(F.lit("cdn"), F.col("user_id") % 7, F.lit(".example.com"))).alias("host0"),
        F.concat(F.lit("https://www.site"), F.col("user_id") % 5, F.lit(".example.org/watch?v="), i).alias("initiator"),
        _pick(["element", "timing", "link", "meta"], i).alias("source"),
        _pick(VIAS, i).alias("via"),
    )
    path = F.concat(F.lit("/v/"), F.when(i % 11 == 0, "seg-").otherwise(""), F.col("k"), F.when(F.col("ext0") == "", "").otherwise(F.concat(F.lit("."), "ext0")))
    url = F.concat(F.lit("https://"), "host0", path, F.lit("?token="), i, F.when(i % 2 == 1, F.concat(F.lit("&id="), "k")).otherwise(""))
    header = lambda name, value: F.struct(F.lit(name).alias("name"), value.alias("value"))
    length = F.col("size0").cast("string")
    headers = F.filter(F.array(header("Content-Type", F.concat("mime0", F.lit("; charset=binary"))), F.when(F.col("status") == 200, header("Content-Length", length)), F.when(F.col("status") == 206, header("content-range", F.concat(F.lit("bytes 0-1/"), length)))), lambda h: h.isNotNull() & h["value"].isNotNull())
    return rows.withColumn("url", url).withColumn("headers", headers).drop("host0")


def navigations(obs: DataFrame) -> DataFrame:
    return obs.where("event_type = 'signup'").select("tab_id", "seen")


def playlists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One media playlist per order, one segment per line item; the key changes with the return flag ('N': none)."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_returnflag", "l_linestatus", F.lag("l_returnflag").over(w).alias("flag0"), F.lag("l_linestatus").over(w).alias("status0"), F.row_number().over(w).alias("n"))
    key = F.when(F.col("l_returnflag").eqNullSafe(F.col("flag0")), None).when(F.col("l_returnflag") == "N", "#EXT-X-KEY:METHOD=NONE").otherwise(F.concat(F.lit('#EXT-X-KEY:METHOD=AES-128,URI="key,'), "l_returnflag", F.lit('.bin",IV=0x'), F.hex("l_suppkey")))
    gap = F.when((F.col("n") > 1) & (F.col("l_linestatus") != F.col("status0")), "#EXT-X-DISCONTINUITY")
    lines = F.concat_ws("\r\n", key, gap, F.concat(F.lit("#EXTINF:"), F.col("l_quantity").cast("int"), F.lit(",part, "), "l_partkey"), F.concat(F.lit("#EXT-X-BYTERANGE:"), F.col("l_extendedprice").cast("bigint"), F.when(F.col("n") == 1, "@1000").otherwise("")), F.concat("l_partkey", F.lit(".ts")))
    body = rows.groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", lines.alias("x")))), lambda s: s["x"]).alias("body"))  # a segment's lines are one text
    head = F.array(F.lit("﻿#EXTM3U"), F.lit(""), F.lit("#EXT-X-TARGETDURATION:50"), F.lit("#EXT-X-MEDIA-SEQUENCE:100"))
    text = F.array_join(F.concat(head, "body", F.when(F.col("l_orderkey") % 4 != 0, F.array(F.lit("#EXT-X-ENDLIST"))).otherwise(F.array().cast("array<string>"))), "\r\n")
    return body.select(F.col("l_orderkey").alias("playlist_id"), F.concat(F.lit("https://Media.example.com/a/b/../o"), "l_orderkey", F.lit("/index.m3u8?x=1")).alias("base_url"), text.alias("text"))


CODECS = ["avc1.4d401f,mp4a.40.2", "hvc1.1.6.L93,ac-3", "mp4a.40.2", ""]


#: Part keys of a block: with 25 brands, a playlist or manifest has some 200 of them.
BLOCK = 5_000


def block_id() -> Column:
    return F.concat("p_brand", F.lit("/"), F.floor(F.col("p_partkey") / BLOCK))


def masters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One master playlist per brand and block of part keys (so that its size does not grow with the table), one variant per part, three audio renditions, a session key for every other brand."""
    p = table(spark, sf_dir, "part").withColumn("list", block_id())
    i = F.col("p_partkey")
    info = F.concat(F.lit("#EXT-X-STREAM-INF:BANDWIDTH="), F.floor(F.col("p_retailprice") * 1000).cast("bigint"), F.when(i % 3 == 0, F.concat(F.lit(",AVERAGE-BANDWIDTH="), F.floor(F.col("p_retailprice") * 900).cast("bigint"))).otherwise(""), F.when(i % 5 != 0, F.concat(F.lit(",RESOLUTION="), F.col("p_size") * 32, F.lit("x"), F.col("p_size") * 18)).otherwise(""), F.when(i % 2 == 0, ",FRAME-RATE=59.940").otherwise(""), F.lit(',CODECS="'), _pick(CODECS, i), F.lit('",AUDIO="aud'), i % 2, F.lit('"'))
    lines = p.groupBy("list", "p_brand").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", F.array(info, F.concat(F.lit("v/"), "p_partkey", F.lit(".m3u8"))).alias("x")))), lambda s: s["x"])).alias("body"))
    media = F.array(F.lit('#EXT-X-MEDIA:TYPE=AUDIO,GROUP-ID="aud0",NAME="One, first",LANGUAGE="en",URI="a/1.m3u8"'), F.lit('#EXT-X-MEDIA:TYPE=AUDIO,GROUP-ID="aud0",NAME="Two",DEFAULT=YES,URI="a/2.m3u8"'), F.lit('#EXT-X-MEDIA:TYPE=AUDIO,GROUP-ID="aud1",NAME="Muxed"'), F.lit('#EXT-X-MEDIA:TYPE=SUBTITLES,GROUP-ID="aud1",NAME="Text",URI="s/1.m3u8"'))
    odd = F.length("p_brand") + F.ascii(F.substring("p_brand", -1, 1))
    key = F.when(odd % 2 == 1, F.array(F.lit('#EXT-X-SESSION-KEY:METHOD=SAMPLE-AES,KEYFORMAT="com.apple.streamingkeydelivery"'))).otherwise(F.array().cast("array<string>"))
    return lines.select(F.col("list").alias("playlist_id"), F.lit("https://media.example.com/m/index.m3u8").alias("base_url"), F.array_join(F.concat(F.array(F.lit("#EXTM3U")), media, key, "body"), "\n").alias("text"))


def manifests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One MPD per brand and block of part keys: an advertisement period, then a main period with one representation per part: timelines, even durations, lists and single files."""
    p = table(spark, sf_dir, "part").withColumn("list", block_id())
    i, size = F.col("p_partkey"), F.col("p_size")
    timeline = F.concat(F.lit('<SegmentTemplate timescale="1000" startNumber="5" presentationTimeOffset="100" media="$RepresentationID$/$Time$-$Number%05d$.m4s" initialization="$RepresentationID$/init.mp4"><SegmentTimeline><S t="100" d="'), size * 100, F.lit('" r="2"/><S d="'), size * 50, F.lit('"/><S t="20000" d="4000" r="-1"/></SegmentTimeline></SegmentTemplate>'))
    even = F.lit('<SegmentTemplate media="n$Number$_$Bandwidth$.m4s" duration="7"/>')
    listed = F.concat(F.lit('<SegmentList timescale="10" duration="'), size, F.lit('"><Initialization sourceURL="i.mp4" range="0-99"/><SegmentURL media="l1.m4s"/><SegmentURL mediaRange="100-299"/><SegmentURL media="l3.m4s"/></SegmentList>'))
    single = F.concat(F.lit("<BaseURL>one-"), i, F.lit(".mp4</BaseURL>"))
    kind = i % 4
    guard = F.when(i % 10 == 0, '<ContentProtection schemeIdUri="urn:mpeg:dash:mp4protection:2011"/><ContentProtection schemeIdUri="urn:uuid:edef8ba9-79d6-4ace-a3c8-27dcd51d21ed"/>').otherwise("")
    rep = F.concat(F.lit('<Representation id="r'), i, F.lit('" bandwidth="'), F.floor(F.col("p_retailprice") * 1000).cast("bigint"), F.lit('" width="'), size * 32, F.lit('" height="'), size * 18, F.when(i % 6 == 5, '" mimeType="video/webm').otherwise(""), F.lit('">'), guard, F.when(kind == 0, timeline).when(kind == 1, even).when(kind == 2, listed).otherwise(single), F.lit("</Representation>"))
    video = p.groupBy("list").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", rep.alias("x")))), lambda s: s["x"]), "").alias("reps"))
    head = '<?xml version="1.0"?>\n<!-- made -->\n<MPD xmlns="urn:mpeg:dash:schema:mpd:2011" type="static" mediaPresentationDuration="PT1M40S"><BaseURL>base/</BaseURL><Period duration="PT20S"><AdaptationSet mimeType="video/mp4"><Representation id="ad" bandwidth="1"/></AdaptationSet></Period><Period><BaseURL>main/</BaseURL><AdaptationSet mimeType="video/mp4" codecs="avc1.4d401f">'
    tail = '</AdaptationSet><AdaptationSet contentType="audio" mimeType="audio/mp4" lang="de"><SegmentTemplate timescale="2" duration="5" media="a-$Number$.m4s" initialization="a.mp4"/><Representation id="a1" bandwidth="64000" codecs="mp4a.40.2"/><Representation id="a2" bandwidth="128000" codecs="mp4a.40.2"/></AdaptationSet></Period></MPD>'
    return video.select(F.col("list").alias("manifest_id"), F.lit("https://dash.example.com/x/manifest.mpd").alias("url"), F.concat(F.lit(head), "reps", F.lit(tail)).alias("text"))


def order_playlists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One playlist per order with keys of three formats, a map with a byte range, and two segments of one of five kinds."""
    i = F.col("o_orderkey")
    if_ = lambda test, text: F.when(test, text)
    plain, guarded = i % 2 == 0, i % 3 == 0
    method = F.when(i % 10 == 0, "SAMPLE-AES").otherwise("AES-128")
    name = F.get(F.array(*[F.lit(x) for x in ("ts", "aac", "mp3", "ac3", "m4s")]), (i % 5).cast("int"))
    lines = F.array(
        F.lit("#EXTM3U"), if_(plain, F.concat(F.lit("#EXT-X-KEY:METHOD="), method, F.lit(',URI="k.bin"'))), if_(guarded, '#EXT-X-KEY:METHOD=SAMPLE-AES,URI="skd://a",KEYFORMAT="com.widevine.alpha"'),
        if_(guarded, '#EXT-X-KEY:METHOD=SAMPLE-AES,URI="skd://b",KEYFORMAT="com.example.other"'), if_(i % 4 == 0, '#EXT-X-MAP:URI="init.mp4",BYTERANGE="100@20"'), F.lit("#EXTINF:4,"), F.concat(F.lit("s1."), name),
        if_(guarded, '#EXT-X-KEY:METHOD=NONE,KEYFORMAT="com.example.other"'), F.lit("#EXTINF:4,"), F.concat(F.lit("s2."), name),
    )
    return table(spark, sf_dir, "orders").select(i.alias("playlist_id"), F.concat(F.lit("https://media.example.com/k/"), i, F.lit("/i.m3u8")).alias("base_url"), F.array_join(F.array_compact(lines), "\n").alias("text"))


def media_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with media elements, links to films and one to a text, and a player's meta tag put in, among comments, scripts and pictures that name others."""
    i = F.col("page_id")
    tags = F.concat(F.lit('<VIDEO controls src="/v/'), i, F.lit('.mp4"></VIDEO><video src="blob:x"></video><a class="x" href="/l/'), i, F.lit('.webm">film</a><a href="/l/text.html">text</a><a href="/v/'), i, F.lit('.mp4">the same</a><!-- <video src="/no/1.mp4"></video> --><script>var s = "<video src=\'/no/2.mp4\'>";</script><picture><source src="/no/3.mp4"></picture><a title="a>b" href="/q/'), i, F.lit('.mp4">quoted</a><video src="/e/'), i, F.lit('.mp4?x=1&amp;y=2&copy=3"></video><Audio><SOURCE SRC=/s/'), i, F.lit('.mp3></Audio><source src="/no/4.mp4"><meta name="twitter:player:stream" content="https://player.example.com/embed?id='), i, F.lit('">'))
    return table(spark, sf_dir, "pages").select("page_id", "url", F.concat(F.coalesce("html", F.lit("")), tags).alias("html"))


def _rep(inner: str, attrs: str = 'id="v" bandwidth="7"') -> str:
    return f'<Period duration="PT10S"><AdaptationSet mimeType="video/mp4"><Representation {attrs}>{inner}</Representation></AdaptationSet></Period>'


#: Odd manifests: text between the MPD tags (or the whole text), error, segments, first URL, URL of the initialisation segment, open-ended.
ODD_MANIFESTS = [
    (_rep('<SegmentTemplate media="n$Number$.m4s" duration="0"/>'), "Invalid SegmentTemplate duration", 0, None, None, False),
    (_rep('<SegmentTemplate media="n$Number$.m4s" duration="x"/>'), "Invalid SegmentTemplate duration", 0, None, None, False),
    (_rep('<SegmentTemplate media="n$Number$.m4s"/>'), "The SegmentTemplate has neither a SegmentTimeline nor a duration.", 0, None, None, False),
    (_rep('<SegmentTemplate media="t$Time$.m4s"><SegmentTimeline><S d="0" r="-1"/></SegmentTimeline></SegmentTemplate>'), "Invalid SegmentTimeline entry", 0, None, None, False),
    (_rep('<SegmentTemplate media="t$Time$.m4s"><SegmentTimeline><S t="0" d="1" r="4000000"/></SegmentTimeline></SegmentTemplate>'), "The manifest lists too many segments", 0, None, None, False),
    (_rep('<SegmentTemplate timescale="100000" media="n$Number$.m4s" duration="1"/>'), "The manifest lists too many segments", 0, None, None, False),
    (_rep('<SegmentTemplate timescale="0" media="n$Number$.m4s" duration="2" initialization="i-$Bandwidth%03d$.mp4"/>'), None, 5, "n1.m4s", "i-007.mp4", False),
    (_rep('<SegmentTemplate media="t$Time$.m4s"><Initialization sourceURL="i.mp4"/><SegmentTimeline><S t="4" d="2" r="-1"/></SegmentTimeline></SegmentTemplate>').replace(' duration="PT10S"', ""), None, 1, "t4.m4s", "i.mp4", True),
    (_rep('<BaseURL>one.mp4</BaseURL><SegmentList duration="5"><Initialization range="0-99"/><SegmentURL mediaRange="100-199"/><SegmentURL mediaRange="200-299"/></SegmentList>'), None, 2, "one.mp4", "one.mp4", False),
    (_rep('<SegmentList><SegmentTimeline><S/></SegmentTimeline><SegmentURL media="a&amp;b.m4s"/></SegmentList>'), None, 1, "a&b.m4s", None, False),
    (_rep("<BaseURL>ftp://h/x.mp4</BaseURL>"), "Unsupported URL scheme in manifest: ftp:", 0, None, None, False),
    (_rep('<SegmentTemplate media="data:$Number$" duration="2"/>'), "Unsupported URL scheme in manifest: data:", 0, None, None, False),
    (_rep('<SegmentList duration="2"><SegmentURL media="a.m4s"/><SegmentURL media="file:///b.m4s"/></SegmentList>'), "Unsupported URL scheme in manifest: file:", 0, None, None, False),
    ("<MPD><Period></MPD>", "Malformed XML", 0, None, None, False),
    ("<MPD><a><!-- never closed </a></MPD>", "Malformed XML", 0, None, None, False),
    ("<html></html>", "Not a DASH manifest", 0, None, None, False),
    ('<!DOCTYPE a [<!ENTITY b "c">]><MPD/>', "DOCTYPE declarations are not supported", 0, None, None, False),
    ("<MPD>" + '<a x="1>2">' * 70 + "</a>" * 70 + "</MPD>", "XML is nested too deeply", 0, None, None, False),
    (_rep('<SegmentList duration="2"><SegmentURL media="a.m4s?x=1&y=2"/></SegmentList>'), None, 1, "a.m4s?x=1&y=2", None, False),
    (_rep('<BaseURL>b&custom;&#47;&#x63;/</BaseURL><SegmentList duration="2"><SegmentURL media="d.m4s"/></SegmentList>'), None, 1, "b&custom;/c/d.m4s", None, False),
    (_rep('<BaseURL><![CDATA[e&f/]]></BaseURL><SegmentList duration="2"><!-- > --><SegmentURL media="\u00e9 g.m4s"/></SegmentList>'), None, 1, "e&f/%C3%A9%20g.m4s", None, False),
    (_rep('<x:SegmentList xmlns:x="urn:x" x:duration="2"><x:SegmentURL media=\'h"i>.m4s\'/></x:SegmentList>'), None, 1, "h%22i%3E.m4s", None, False),
    ("<MPD/><MPD/>", "Malformed XML", 0, None, None, False),
    ("<MPD><Period></Period>", "Malformed XML", 0, None, None, False),
    ("<MPD><![CDATA[never closed</MPD>", "Malformed XML", 0, None, None, False),
    ("text", "Malformed XML", 0, None, None, False),
    ("<!DOCTYPE MPD><html/>", "Not a DASH manifest", 0, None, None, False),
    (_rep('<SegmentTemplate media="$RepresentationID$_$Number%02d$$$.m4s" duration="2.5" timescale="1"/>', 'id="q&#65;&quot;&lt;" bandwidth="x"'), None, 4, "qA%22%3C_01$.m4s", None, False),
]


def odd_manifests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One odd manifest per part, in turn."""
    texts = [t if not t.startswith("<Period") else f"<MPD>{t}</MPD>" for t, *_ in ODD_MANIFESTS]
    i = F.col("p_partkey")
    parts = spread(table(spark, sf_dir, "part").select("p_partkey"), "p_partkey")  # a text is long beside its key
    return parts.select(i.alias("manifest_id"), F.lit("https://dash.example.com/x/m.mpd").alias("url"), F.get(F.array(*[F.lit(t) for t in texts]), (i % len(texts)).cast("int")).alias("text"))


#: What may stand in a playlist, and the scheme that fails it (none: it can be read).
FOREIGN = [
    ("#EXTINF:4,\nhttps://cdn.example.com/a.ts", None), ("#EXTINF:4,\nftp://h/a.ts", "ftp:"), ('#EXT-X-MAP:URI="data:,x"\n#EXTINF:4,\na.m4s', "data:"), ("#EXTINF:4,\nC:\\a.ts", "c:"), ('#EXT-X-KEY:METHOD=AES-128,URI="skd://k"\n#EXTINF:4,\na.ts', None),
    ("#EXT-X-STREAM-INF:BANDWIDTH=1\nFILE:///v.m3u8", "file:"), ('#EXT-X-MEDIA:TYPE=AUDIO,GROUP-ID="a:b",URI="blob:x"\n#EXT-X-STREAM-INF:BANDWIDTH=1\nv.m3u8', "blob:"), ("#EXTINF:4,\na.ts?u=ftp://h", None), ('#EXT-X-MEDIA:TYPE=AUDIO,GROUP-ID="a:b",NAME="URI=x:y"\n#EXT-X-STREAM-INF:BANDWIDTH=1\nv.m3u8', None), ("#EXTINF:4,\na/b:c.ts", None),
]


def foreign_playlists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One playlist per order, in turn with one of FOREIGN."""
    i = F.col("o_orderkey")
    body = F.get(F.array(*[F.lit(t) for t, _ in FOREIGN]), (i % len(FOREIGN)).cast("int"))
    return table(spark, sf_dir, "orders").select(i.alias("playlist_id"), F.lit("https://media.example.com/f/i.m3u8").alias("base_url"), F.concat(F.lit("#EXTM3U\n"), body).alias("text"))


#: Time of tabs goes this many times faster than that of events.
PACE = 3600


def tab_events(spark: SparkSession, sf_dir: str, events: DataFrame | None = None) -> DataFrame:
    """Events (a stream or the table) as busy tabs of three users each: candidates that come again, navigations, closings, and what probes and reads bring seconds later."""
    e = table(spark, sf_dir, "events") if events is None else events
    i, k = F.col("event_id"), F.get_json_object("props", "$.k").cast("int") % 12
    kind = F.when(i % 6 == 0, "hls").when(i % 6 == 3, "dash").otherwise("file")
    ext = F.when(i % 6 == 0, "m3u8").when(i % 6 == 3, "mpd").otherwise(_pick(["mp4", "webm", "mp3", "mov", "mkv", "flac", "m4a"], i))
    path = F.concat(F.lit("https://cdn"), F.floor(F.col("user_id") / 3) % 7, F.lit(".example.com/v/"), k, F.lit("."), ext)
    named = F.when(i % 2 == 1, F.concat(F.lit("id="), k)).otherwise("")
    seen = F.timestamp_micros(F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / PACE))
    return e.select(
        "event_id",
        F.floor(F.col("user_id") / 3).cast("bigint").alias("tab_id"),
        seen.alias("seen"),
        F.when(i % 997 == 500, "closed").when(i % 97 == 60, "navigation").otherwise("item").alias("what"),
        kind.alias("kind"),
        _pick(["media", "xmlhttprequest", "media", "other", "media"], i).alias("via"),
        (~(i % 4).isin(2, 3) | (k % 2 == 0)).alias("fetchable"),
        F.concat(path, F.when(named == "", "").otherwise(F.concat(F.lit("?"), named))).alias("key"),
        F.concat(path, F.lit("?token="), i, F.when(named == "", "").otherwise(F.concat(F.lit("&"), named))).alias("url"),
        F.when(i % 3 != 0, F.floor(F.col("value") * 1000).cast("bigint")).alias("size"),
        F.when(i % 4 != 1, "video/mp4").otherwise("").alias("mime"),
        k.alias("k"),
    )


def tab_rows(e: DataFrame) -> DataFrame:
    """The rows that tabs are told of: each event's own, the start of its navigation two seconds before, the result of its probe some seconds later."""
    i = F.col("event_id")
    later = lambda seconds: F.col("seen") + F.make_dt_interval(secs=seconds)
    none = F.lit(None)
    row = lambda what, seen, **told: F.struct(*[x.alias(n) for n, x in (("what", F.lit(what) if isinstance(what, str) else what), ("seen", seen), ("size", told.get("size", none.cast("bigint"))), ("mime", told.get("mime", none.cast("string"))), ("reject", told.get("reject", none.cast("boolean"))))])
    own = row(F.col("what"), F.col("seen"), size=F.col("size"), mime=F.col("mime"))
    start = F.when(F.col("what") == "navigation", row("navigating", later(F.lit(-2))))
    probe = F.when((F.col("what") == "item") & (F.col("kind") == "file") & (i % 5 != 0), row("probe", later(i % 30), size=20_000 + i, mime=F.lit("video/webm"), reject=i % 4 == 0))
    rows = e.select("tab_id", "event_id", "key", "kind", "via", "fetchable", "url", F.explode(F.array_compact(F.array(own, start, probe))).alias("x"))
    return rows.select("tab_id", "x.seen", "event_id", "x.what", "key", "kind", "via", "fetchable", "url", "x.size", "x.mime", "x.reject", none.cast("string").alias("error"), none.cast("array<string>").alias("children"))


def tab_bodies(e: DataFrame) -> DataFrame:
    """What came back for playlists, some after the time limit: master playlists that name files of their folder, error pages, and texts that are none."""
    i, k = F.col("event_id"), F.col("k")
    variants = F.concat(*[x for j, ext in enumerate(("mp4", "webm", "mp3", "mov")) for x in (F.lit(f"#EXT-X-STREAM-INF:BANDWIDTH={j + 1}\n"), (k + j % 2) % 12, F.lit(f".{ext}?id="), (k + j % 2) % 12, F.lit("\n"))])
    text = F.when(i % 10 == 4, "<html>no</html>").otherwise(F.concat(F.lit('#EXTM3U\n#EXT-X-MEDIA:TYPE=AUDIO,GROUP-ID="a",URI="'), k, F.lit('.m4a"\n'), variants, k, F.lit(".flac\n")))
    return e.where("what = 'item' and kind = 'hls'").select(i.alias("request_id"), (F.col("seen") + F.make_dt_interval(secs=i % 18)).alias("at"), F.when(i % 14 == 0, 503).otherwise(200).alias("status"), text.alias("text"))
