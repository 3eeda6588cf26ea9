"""Golden rows of the functions and parsers, hostile inputs, and the stream against the batch."""

import struct
import time

import pytest
from pyspark.sql import functions as F

from reelgrid.functions import binary as B
from reelgrid.functions import classify as C
from reelgrid.functions import formats as T
from reelgrid.functions import urls as U
from reelgrid.operators import dash, hls, observe


def evaluate(spark, expression, rows, names):
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "row int, " + names)
    return [r["out"] for r in df.select("row", expression.alias("out")).orderBy("row").collect()]


def test_urls(spark):
    u = F.col("u")
    cases = {
        "https://WWW.Example.com:443/a/b.MP4?x=1#f": ("example.com", "https://www.example.com", "https://www.example.com/a/b.MP4", "b.MP4", "https://www.example.com/a/b.MP4?x=1"),
        "http://h:8080": ("h", "http://h:8080", "http://h:8080/", "", "http://h:8080/"),
        "https://h/a%20b+c.mp4?b=2&token=9&a=1&a=0": ("h", "https://h", "https://h/a%20b+c.mp4", "a b+c.mp4", "https://h/a%20b+c.mp4?a=1&a=0&b=2"),
        "https://h/x?X-Amz-Date=1&id=a+b%2F~": ("h", "https://h", "https://h/x", "x", "https://h/x?id=a+b%2F%7E"),
        "https://h/bad%zz.mp4": ("h", "https://h", "https://h/bad%zz.mp4", "", "https://h/bad%zz.mp4"),
        "blob:abc?x": ("", "", "blob:abc", "", "blob:abc?x"),
        "not a url": ("", "", "not a url", "", "not a url"),
    }
    rows = evaluate(spark, F.struct(U.host_of(u), U.origin_of(u), U.safe_url(u), U.filename_from_url(u), U.dedupe_key(u)), [(k,) for k in cases], "u string")
    assert [tuple(r) for r in rows] == list(cases.values())
    sites = [("https://a.b.example.co.uk/", "http://example.co.uk"), ("https://x.co.uk", "https://y.co.uk"), ("http://10.0.0.1/a", "http://10.0.0.1:8/b"), ("http://10.0.0.1", "http://10.0.0.2"), ("http://localhost:1", "http://localhost:2"), ("http://a.com", "nothing")]
    assert evaluate(spark, U.same_site(F.col("a"), F.col("b")), sites, "a string, b string") == [True, False, True, False, True, False]
    assert evaluate(spark, U.hash_string(u), [("abc",), ("",)], "u string") == ["7aigaz", "ztntfp"]


def test_pieces(spark):
    yes = ["/init.mp4", "/film-init-3.mp4", "/q/seg-7.mp4", "/chunk_0042.m4s", "/frag9.mp4", "/b.fragment12.mp4", "/w_initialization.mp4", "/segment-1.mp4", "/seg%2D3.mp4"]
    no = ["/initial.mp4", "/The%20Segment%204.mp4", "/segovia.mp4", "/holiday.mp4", "/fragment.mp4", "/", "/chunks-of.mp4", "/ourseg2.mp4"]
    assert evaluate(spark, U.looks_like_stream_piece(F.col("p")), [(x,) for x in yes + no], "p string") == [True] * len(yes) + [False] * len(no)


def test_classify(spark):
    def headers(kind, size=None, span=None):
        return [("Content-Type", kind)] + ([("content-length", str(size))] if size is not None else []) + ([("Content-Range", span)] if span else [])

    big = 10_000_000
    cases = [
        (("https://h/v.mp4", 200, headers("video/mp4", big)), ("file", "video", ".mp4", big)),
        (("https://h/v.mp4", 206, headers("video/mp4", 10, f"bytes 0-9/{big}")), ("file", "video", ".mp4", big)),
        (("https://h/v.mp4", 206, headers("video/mp4", 10)), ("file", "video", ".mp4", None)),
        (("https://h/v.mp4", 404, headers("video/mp4", big)), None),
        (("https://h/v.mp4", 200, headers("video/mp4", 100)), None),
        (("https://h/p.m3u8?x", 200, headers("text/plain; charset=x", 10)), ("hls", "stream", ".m3u8", 10)),
        (("https://h/p", 200, headers("Application/X-MpegURL")), ("hls", "stream", ".m3u8", None)),
        (("https://h/p.mpd", 200, headers("text/xml")), ("dash", "stream", ".mpd", None)),
        (("https://h/p.ts", 200, headers("video/mp4", big)), None),
        (("https://h/p.exe", 200, headers("application/octet-stream", big)), None),
        (("https://h/p.exe", 200, headers("video/webm", big)), ("file", "video", ".webm", big)),
        (("https://h/p.mkv", 200, headers("", big)), ("file", "video", ".mkv", big)),
        (("https://h/p.mp3", 200, headers("audio/x-unknown", big)), ("file", "audio", ".mp3", big)),
        (("https://r4.googlevideo.com/p.mp4", 200, headers("video/mp4", big)), None),
        (("https://h/" + "x" * 5000 + ".mp4", 200, headers("video/mp4", big)), None),
        (("blob:https://h/p.mp4", 200, headers("video/mp4", big)), None),
        (("https://h/seg-1.mp4", 200, headers("video/mp4", big)), None),
        ((None, 200, None), None),
    ]
    out = evaluate(spark, C.classify_response(F.col("u"), F.col("s"), F.col("h")), [c[0] for c in cases], "u string, s int, h array<struct<name:string,value:string>>")
    assert [r and (r["kind"], r["media"], r["ext"], r["size"]) for r in out] == [c[1] for c in cases]
    urls = [("https://h/a.m3u8",), ("https://h/a.MPD",), ("https://h/a.webm",), ("https://h/a.opus",), ("https://h/a.m4s",), ("https://h/a",), ("ftp://h/a.mp4",)]
    assert [r and r["kind"] for r in evaluate(spark, C.classify_url(F.col("u")), urls, "u string")] == ["hls", "dash", "file", "file", None, None, None]
    heads = [(b"<!DOCTYPE html>",), (b"  <HTML>",), (b'{"a"',), (b'[{"a"',), (b"<?xml",), (b"\x47" * 10,), (b"\x00\x00\x00\x18ftyp",), (b"[1]",), (b"",)]
    assert evaluate(spark, C.is_text_start(F.col("b")), heads, "b binary") == [True] * 5 + [False] * 4
    assert evaluate(spark, C.is_fragment_start(F.col("b")), [(b"\0\0\0\x08styp",), (b"\0\0\0\x08moof",), (b"\0\0\0\x08ftyp",), (b"abc",)], "b binary") == [True, True, False, False]


def test_formats(spark):
    assert evaluate(spark, T.format_bytes(F.col("n")), [(x,) for x in (None, 0, 1023, 1024, 1536, 102400, 5 * 1024**3, 2 * 1024**5)], "n long") == ["", "0 B", "1023 B", "1.0 KB", "1.5 KB", "100 KB", "5.0 GB", "2048 TB"]
    assert evaluate(spark, T.format_duration(F.col("s")), [(x,) for x in (None, 0.0, -1.0, 5.4, 59.6, 3599.0, 3661.0)], "s double") == ["", "", "", "0:05", "1:00", "59:59", "1:01:01"]
    texts = ["PT4H10M7.25S", "P3DT5H", "P1Y", "P1M1W", "PT", "P", "1H", "PT1X", ""]
    assert evaluate(spark, T.parse_duration(F.col("t")), [(x,) for x in texts], "t string") == [15007.25, 277200.0, 31536000.0, 37 * 86400.0, 0.0, 0.0, None, None, None]
    assert [r and tuple(r) for r in evaluate(spark, T.parse_range(F.col("t")), [("0-99",), ("5-4",), ("x",), ("7-7",)], "t string")] == [(0, 100), None, None, (7, 1)]
    assert [r and tuple(r) for r in evaluate(spark, T.parse_byte_range(F.col("t")), [("10",), ("10@5",), ("x@1",)], "t string")] == [(10, None), (10, 5), None]
    assert [r and bytes(r).hex() for r in evaluate(spark, T.parse_iv(F.col("t")), [("0x1A",), ("zz",), ("",), ("f" * 33,)], "t string")] == ["0" * 30 + "1a", None, None, None]
    names = [("q|r<s>.webm", "q r s .webm"), ("...dots...", "dots"), ("lpt4", "_lpt4"), ("", "video"), ("ﬂower ½", "flower 1⁄2"), ("y" * 150, "y" * 120), ("\n k\u00a0 m ", "k m"), (None, "video")]
    assert evaluate(spark, T.sanitize_filename(F.col("n")), [(n,) for n, _ in names], "n string") == [w for _, w in names]
    assert evaluate(spark, T.format_rate(F.col("n")), [(x,) for x in (None, 0.0, -1.0, float("inf"), 2048.0)], "n double") == ["", "", "", "", "2.0 KB/s"]
    labels = [(540, 960, "avc1,mp4a.40.2", 50.0, 2_300_000, 0, "540p · 50fps · 2.3 Mbps"), (0, 0, "mp4a.40.2", 0.0, 64_000, 0, "Audio only · 64 kbps"), (0, 0, "", 0.0, 0, 0, "Default"), (360, 0, "", 30.0, 900_000, 800_400, "360p · 800 kbps")]
    assert evaluate(spark, T.variant_label(*[F.col(c) for c in "hwcfba"]), [r[:6] for r in labels], "h int, w int, c string, f double, b long, a long") == [r[6] for r in labels]
    templates = [("a$b c$Number$", "r", 3, 1, 1, "a$b c3"), ("$RepresentationID$/$Number%05d$-$Time$.$$.$Other$", "r1", 7, 100, None, "r1/00007-$Time$.$.$Other$"), ("$Number%02d$", "x", 12345, 1, 1, "12345")]
    assert evaluate(spark, F.array_join(T.expand_tokens(T.template_tokens(F.col("t")), RepresentationID=F.col("i"), Number=F.col("n"), Bandwidth=F.col("b"), Time=F.col("m")), ""), [r[:5] for r in templates], "t string, i string, n long, b long, m long") == [r[5] for r in templates]


def parse(spark, text, base="https://h/p/i.m3u8"):
    return hls.playlists(spark.createDataFrame([(1, base, text)], "playlist_id long, base_url string, text string"))


def test_attributes(spark):
    text = 'bandwidth=800000,CODECS="avc1.4d401f,mp4a.40.2",FLAG,NAME="a=b",X= y ,NAME="last",BAD KEY=1,OPEN="x'
    pairs = evaluate(spark, hls.attributes(F.col("t")), [(text,)], "t string")[0]
    assert {p["name"]: p["value"] for p in pairs} == {"BANDWIDTH": "800000", "CODECS": "avc1.4d401f,mp4a.40.2", "NAME": "last", "X": " y ", "OPEN": "x"}


@pytest.mark.parametrize("line", ["A" * 500_000, '"' * 200_000, "," * 500_000, "A=" * 200_000, 'A="' + "," * 400_000])
def test_hostile_attributes(spark, line):
    began = time.time()
    evaluate(spark, F.size(hls.attributes(F.col("t"))), [(line,)], "t string")
    assert time.time() - began < 20


def test_media_playlist(spark):
    text = """#EXTM3U
#EXT-X-MEDIA-SEQUENCE:100
#EXT-X-KEY:METHOD=AES-128,URI="k1",IV=0x1
#EXT-X-KEY:METHOD=SAMPLE-AES,URI="skd://own-key",KEYFORMAT="com.apple.streamingkeydelivery"
#EXT-X-MAP:URI="init.mp4",BYTERANGE="10"
#EXTINF:3.5,title
#EXT-X-BYTERANGE:1000
a.mp4
#EXT-X-BYTERANGE:500
#EXTINF:2
a.mp4
#EXT-X-KEY:METHOD=NONE
#EXT-X-DISCONTINUITY
#EXT-X-BYTERANGE:200@50
a.mp4
#EXT-X-KEY:METHOD=NONE,KEYFORMAT="com.apple.streamingkeydelivery"
../b.ts?x=1
#EXTINF:9
"""
    segs = hls.segments(parse(spark, text))
    rows = segs.orderBy("index").collect()
    assert [(r["sequence"], r["url"], r["duration"], r["range_offset"], r["range_length"], r["discontinuity"]) for r in rows] == [
        (100, "https://h/p/a.mp4", 3.5, 0, 1000, False), (101, "https://h/p/a.mp4", 2.0, 1000, 500, False), (102, "https://h/p/a.mp4", 0.0, 50, 200, True), (103, "https://h/b.ts?x=1", 0.0, None, None, False),
    ]
    assert [r["key"] and r["key"]["url"] for r in rows] == ["https://h/p/k1", "https://h/p/k1", None, None]
    assert [[k["key_format"] for k in r["drm"]] for r in rows] == [["com.apple.streamingkeydelivery"]] * 3 + [[]]
    assert all(r["map"]["url"] == "https://h/p/init.mp4" and tuple(r["map"]["byte_range"]) == (0, 10) and r["map"]["key"]["url"] == "https://h/p/k1" for r in rows)
    e = hls.encryption(segs).first()
    assert (e["method"], e["drm"], e["systems"], e["supported"]) == ("DRM", True, ["FairPlay"], False)
    assert hls.container(segs).first()["container"] == "fmp4"
    for body, want in (('#EXT-X-KEY:METHOD=AES-128,URI="k"', ("AES-128", True)), ('#EXT-X-KEY:METHOD=SAMPLE-AES,URI="k"', ("SAMPLE-AES", False)), ('#EXT-X-KEY:METHOD=AES-128,URI="data:x"', ("AES-128", False)), ("#X", ("NONE", True))):
        got = hls.encryption(hls.segments(parse(spark, f"#EXTM3U\n{body}\na.ts\n"))).first()
        assert (got["method"], got["supported"]) == want
    assert parse(spark, "hello").first()["error"] == "Not an HLS playlist" and parse(spark, None).first()["error"]
    assert hls.segments(parse(spark, "#EXTM3U\n")).count() == 0


def test_decrypted(spark):
    from pyspark.sql import Row

    key = bytes(range(16))
    clear = bytes([0x47] * 100)
    made = spark.createDataFrame([Row(x=clear, k=key)]).select(F.expr("substring(aes_encrypt(x, k, 'CBC', 'PKCS', unhex('00000000000000000000000000000064')), 17)").alias("body")).first()["body"]
    segs = hls.segments(parse(spark, '#EXTM3U\n#EXT-X-MEDIA-SEQUENCE:100\n#EXT-X-KEY:METHOD=AES-128,URI="k"\na.ts\n#EXT-X-KEY:METHOD=NONE\n#EXT-X-BYTERANGE:5@2\nb.ts\n#EXT-X-BYTERANGE:5@9\nb.ts\n'))
    bodies = spark.createDataFrame([("https://h/p/a.ts", made), ("https://h/p/b.ts", bytearray(b"0123456789"))], "url string, body binary")
    keys = spark.createDataFrame([("https://h/p/k", bytearray(key))], "url string, key binary")
    rows = hls.decrypted(segs, bodies, keys).orderBy("index").collect()
    assert bytes(rows[0]["data"]) == clear and bytes(rows[1]["data"]) == b"23456" and rows[2]["error"] == "wrong length"


def mpd(spark, body, attrs='mediaPresentationDuration="PT30S"'):
    return dash.manifests(spark.createDataFrame([(1, "https://h/d/m.mpd", f"<MPD {attrs}>{body}</MPD>")], "manifest_id long, url string, text string"))


def test_dash(spark):
    body = '<Period start="PT0S"/><Period start="PT10S" duration="PT12S"><AdaptationSet mimeType="video/mp4"><SegmentTemplate timescale="10" media="a$Number$" startNumber="0"><SegmentTimeline><S d="20" r="-1"/></SegmentTimeline></SegmentTemplate><Representation id="v" bandwidth="5"><SegmentTemplate media="$RepresentationID$-$Time$"/></Representation></AdaptationSet></Period><Period/>'
    p = dash.periods(mpd(spark, body))
    assert [(r["start"], r["duration"]) for r in p.orderBy("period").collect()] == [(0.0, 10.0), (10.0, 12.0), (22.0, 8.0)]
    assert dash.main_period(p).first()["period"] == 1
    rows = dash.template_segments(dash.plans(dash.representations(p))).orderBy("index").collect()
    assert [(r["number"], r["time"], r["start"], r["duration"], r["url"]) for r in rows] == [(k, 20 * k, 2.0 * k, 2.0, f"https://h/d/v-{20 * k}") for k in range(6)]
    for text in ('<!DOCTYPE a [<!ENTITY b "c">]><MPD/>', "<other/>", "<MPD><Period></MPD>", "x" * 5_000_001):
        assert dash.manifests(spark.createDataFrame([(1, "u", text)], "manifest_id long, url string, text string")).first()["error"]
    live = dash.plans(dash.representations(dash.periods(mpd(spark, '<Period><AdaptationSet mimeType="video/mp4"><Representation id="x"><SegmentTemplate media="a" duration="2"/></Representation></AdaptationSet></Period>', 'type="dynamic"'))))
    assert "wall-clock" in live.first()["error"]
    guarded = '<Period duration="PT9S"><AdaptationSet mimeType="video/mp4"><ContentProtection schemeIdUri="urn:uuid:EDEF8BA9-79d6-4ace-a3c8-27dcd51d21ed"/><Representation id="x"/></AdaptationSet></Period>'
    s = dash.summarize(p2 := dash.periods(mpd(spark, guarded)), dash.representations(p2)).first()
    assert (s["drm"], s["hidden_protected"], s["variants"]) == (True, 0, 0)


def atom(name, *parts):
    return B.wrapped(name, *parts)


def init(*tracks):
    traks = [atom("trak", atom("tkhd", bytes(12) + struct.pack(">I", t) + bytes(60))) for t in tracks]
    return atom("ftyp", b"isom") + atom("moov", atom("mvhd", bytes(100)), *traks, atom("mvex", atom("mehd", bytes(8)), *[atom("trex", struct.pack(">II", 0, t) + bytes(16)) for t in tracks]))


def test_binary(spark):
    for video, audio, want in (((1,), (1,), {1: 2}), ((1,), (3,), {3: 3}), ((1, 2), (2, 1), {2: 3, 1: 4}), ((5,), (1, 5), {1: 1, 5: 6})):
        merged, ids = B.merged_init(init(*video), init(*audio))
        made = B.Init(merged)
        assert ids == want and made.tracks == [*video, *want.values()] == [B.number(merged, p) for p in made.defaults]
        assert B.number(merged, B.field(merged, made.at("moov/mvhd")[0])) == max(made.tracks) + 1
    wide = atom("moov", atom("mvhd", b"\1" + bytes(111)), atom("trak", atom("tkhd", b"\1" + bytes(19) + struct.pack(">I", 7) + bytes(60))), atom("mvex", atom("trex", struct.pack(">II", 0, 7) + bytes(16))))
    assert B.Init(wide).tracks == [7] and B.merged_init(wide, init(7))[1] == {7: 8}  # version 1 boxes
    moof = atom("moof", atom("mfhd", struct.pack(">II", 0, 9)), atom("traf", atom("tfhd", struct.pack(">II", 0, 1))), atom("traf", atom("tfhd", struct.pack(">II", 0, 4))))
    media = atom("styp", b"x") + moof + atom("mdat", b"data") + moof + atom("mdat", b"more")
    out = B.renumbered(media, {1: 2}, 5)
    places = {(b.path, B.number(out, B.field(out, b))) for b in B.boxes(out) if b.path.endswith("hd")}
    assert [b.path for b in B.boxes(out, nested=False)] == ["moof", "mdat", "moof", "mdat"]
    assert places == {("moof/mfhd", 5), ("moof/mfhd", 6), ("moof/traf/tfhd", 2), ("moof/traf/tfhd", 4)}
    df = spark.createDataFrame([(bytearray(init(1)), bytearray(init(3)), bytearray(media))], "v binary, a binary, m binary")
    row = df.select(B.merge_init(F.col("v"), F.col("a")).alias("x"), B.count_moof(F.col("m")).alias("n"), B.read_boxes(F.col("m")).alias("b"), B.read_ts_streams(F.col("m")).alias("t"), B.rewrite_segment(F.col("a"), F.array(F.struct(F.lit(1).alias("old"), F.lit(2).alias("new"))), F.lit(1)).alias("r")).first()
    assert [tuple(t) for t in row["x"]["tracks"]] == [(3, 3)] and row["n"] == 2 and [b["type"] for b in row["b"]["boxes"]] == ["styp", "moof", "mdat", "moof", "mdat"] and row["t"] is None and bytes(row["r"]["data"]) == b""
    for bad in (b"\0\0\0\x04free", b"\0\0\0\x01free\0\0", b"\0\0\0\x20free", atom("moof", atom("mfhd", b"\0"))):
        with pytest.raises(ValueError):
            B.renumbered(bad, {}, 1)
    assert B.boxes(b"\0\0\0\0mdatxyz") == [B.Box("mdat", 0, 8, 11)] and B.boxes(b"abc") == []
    with pytest.raises(ValueError, match="no moov"):
        B.merged_init(atom("ftyp", b""), init(1))
    with pytest.raises(ValueError, match="base data offset"):
        B.renumbered(atom("moof", atom("traf", atom("tfhd", struct.pack(">II", 1, 1)))), {}, 1)


def test_transport_stream():
    """Sections over several packets, after adaptation fields, and streams that are none."""
    def packet(pid, body, first=True, field=0):
        head = bytes([0x47, (0x40 if first else 0) | pid >> 8, pid & 255, 0x30 if field else 0x10]) + (bytes([field - 1]) + bytes(field - 1) if field else b"")
        return (head + (b"\0" if first else b"") + body).ljust(188, b"\xff")

    def section(table, body):
        return bytes([table]) + struct.pack(">H", 0xB000 | len(body) + 4) + body + bytes(4)

    pat = section(0, b"\0\1\xc1\0\0" + struct.pack(">HHHH", 0, 0xE010, 1, 0xE100))
    rows = [(0x1B, 0x101), (0x0F, 0x102), (0x06, 0x103)]
    pmt = section(2, b"\0\1\xc1\0\0\xe1\1\xf0\0" + b"".join(struct.pack(">BHH", t, 0xE000 | p, 0xF000 | 80) + bytes(80) for t, p in rows))
    whole = packet(0, pat, field=20) + packet(0x55, b"x" * 50) + packet(0x100, pmt[:183]) + packet(0x100, pmt[183:], first=False)
    assert B.program_streams(whole) == [{"type": t, "pid": p} for t, p in rows]
    assert B.program_streams(whole[:-188]) is None and B.program_streams(b"") is None and B.program_streams(b"G" * 187) is None
    assert B.program_streams(packet(0, pat) + b"X" * 188 + whole[376:]) is None


def test_stream_equals_batch(spark, sf, tmp_path):
    """Events in several batches and any order give the batch's items; the state of a closed tab is gone."""
    from reelgrid.sources import fixtures as X
    from reelgrid.streaming.state import tab_items

    found = observe.classified(X.observations(spark, sf))
    rows = found.select("tab_id", "seen", "event_id", F.lit("item").alias("what"), "key", "kind", "media", "mime", "ext", "size", "url").withColumn("seen", F.col("seen").cast("timestamp"))
    closed = spark.createDataFrame([(3, 10**9, "closed")], "tab_id long, event_id long, what string").withColumn("seen", F.lit("2024-01-20").cast("timestamp"))
    rows.unionByName(closed, allowMissingColumns=True).repartition(3, F.rand(7)).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = tab_items(stream, delay="60 days").writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).foreachBatch(lambda df, n: df.withColumn("batch", F.lit(n)).write.mode("append").parquet(str(tmp_path / "out"))).start()
    assert q.awaitTermination(180)
    last = spark.read.parquet(str(tmp_path / "out")).groupBy("tab_id", "key").agg(F.max_by(F.struct("gone", "kind", "mime", "size", "url", "sightings"), "batch").alias("x")).select("tab_id", "key", "x.*").where("not gone and tab_id <> 3")
    want = observe.upsert(found.where("tab_id <> 3"))
    columns = ["tab_id", "key", "kind", "mime", "size", "url", "sightings"]
    assert sorted(map(str, last.select(columns).collect())) == sorted(map(str, want.select(columns).collect()))


def test_settled(spark):
    """The stream-stream join gives the same on bounded tables."""
    from reelgrid.streaming.state import settled

    pending = spark.sql("SELECT * FROM VALUES (1L, timestamp'2024-01-01 10:00:00'), (2L, timestamp'2024-01-01 10:00:00'), (3L, timestamp'2024-01-01 10:00:00'), (4L, timestamp'2024-01-01 10:00:00'), (5L, timestamp'2024-01-01 10:00:00') AS t(download_id, started)")
    ended = spark.sql("SELECT * FROM VALUES (1L, timestamp'2024-01-01 10:05:00', null, 'video/mp4', 1000000L), (2L, timestamp'2024-01-01 10:05:00', null, 'text/html', 200000L), (3L, timestamp'2024-01-01 10:05:00', 'SERVER_FORBIDDEN', '', 0L), (4L, timestamp'2024-01-01 10:05:00', 'FILE_NO_SPACE', '', 0L), (5L, timestamp'2024-01-01 12:05:00', null, 'video/mp4', 1000000L) AS t(download_id, ended, reason, mime, bytes)")
    got = {r["download_id"]: r["outcome"] for r in settled(pending, ended).collect()}
    assert got == {1: "done", 2: "error_page", 3: "retry", 4: "failed"}


def test_page_media(spark):
    html = '<video src="/v/a.mp4"></video><audio><source src="blob:q"></audio><a href="b.webm">x</a><a href="c.html">y</a><a href="/v/a.mp4#t">z</a><meta content="e/player" name="twitter:player:stream"><meta property="og:video" content="https://h/no.mp4"><a href="javascript:x.mp4">'
    pages = spark.createDataFrame([(1, "https://h/v/p.html", html), (2, "https://h/", None)], "page_id long, url string, html string")
    entries = spark.createDataFrame([(1, "https://h/v/b.webm", 0), (1, "https://cdn/x.css", 1), (2, "https://cdn/x.mpd?y", 0)], "page_id long, name string, place int")
    assert sorted(map(tuple, observe.page_media(pages, entries).collect())) == [
        (1, "https://h/v/a.mp4", "element", 0), (1, "https://h/v/a.mp4#t", "link", 2), (1, "https://h/v/b.webm", "timing", 1), (1, "https://h/v/e/player", "meta", 3), (2, "https://cdn/x.mpd?y", "timing", 0),
    ]


# state machine of a tab


def tab_frame(spark, rows):
    """Rows of the tab machine: (seconds, event, what, key, rest as a dict)."""
    import datetime

    from reelgrid.streaming import tabs

    names = [c.split()[0] for c in tabs.ROW.split(", ")]
    start = datetime.datetime(2024, 1, 1)
    full = [{"tab_id": 1, "seen": start + datetime.timedelta(seconds=s), "event_id": e, "what": w, "key": k, "kind": "file", "via": "media", "fetchable": True, "url": f"u{e}", "size": 1, "mime": "", **rest} for s, e, w, k, rest in rows]
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in full], tabs.ROW)


def test_tab_rules(spark):
    """Eviction by hidden, file and age; what is evicted may come again; the probe budget; rejected keys; retries; late showing; navigation and closing."""
    from reelgrid.streaming import tabs

    rows = [(k, k, "item", f"s{k}", {"kind": "hls"}) for k in range(38)] + [(38, 38, "item", "f1", {}), (39, 39, "item", "f2", {})]
    rows += [(50, 50, "manifest", "s0", {"children": ["f2", "s5"]}), (51, 51, "item", "new1", {}), (52, 52, "item", "new2", {}), (53, 53, "item", "new3", {}), (54, 54, "item", "s5", {"kind": "hls"})]
    got = tabs.replayed(tab_frame(spark, rows)).orderBy("n").collect()
    assert [r["key"] for r in got if r["effect"] == "folded"] == ["s5", "f2"]
    assert [r["key"] for r in got if r["effect"] == "evicted"] == ["s5", "f2", "f1", "s5"]  # the one that comes again is folded, and so goes first
    rows = [(k, k, "item", f"p{k}", {"via": "other"}) for k in range(32)] + [(33, 90, "item", "q", {"size": None}), (34, 91, "probe", "p1", {"reject": True}), (35, 92, "item", "p1", {}), (36, 93, "probe", "p2", {"size": 7, "mime": "video/x"}), (200, 94, "item", "z", {})]
    got = tabs.replayed(tab_frame(spark, rows)).orderBy("n").collect()
    asks = {r["event_id"]: r["asks"] for r in got if r["effect"] == "listed"}
    assert [asks[k] for k in range(30)] == ["probe"] * 30 and asks[90] is None
    assert [r["event_id"] for r in got if r["effect"] == "passed_over"] == [30, 31]
    assert [(r["effect"], r["key"]) for r in got if r["event_id"] in (91, 92)] == [("rejected", "p1"), ("refused", "p1")]
    shown = [r for r in got if r["effect"] == "shown"]
    # Probes that came before twenty seconds were over would have kept an item back; these came after it was shown.
    assert [r["key"] for r in shown] == [f"p{k}" for k in range(30)] and shown[3]["at"].second == 23
    dash = {"kind": "dash"}
    rows = [(0, 0, "item", "d", dash), (1, 1, "manifest", "d", {"error": "HTTP 500"}), (5, 2, "item", "d", dash), (12, 3, "item", "d", dash), (13, 4, "manifest", "d", {"children": []}), (40, 5, "item", "d", dash), (41, 6, "navigating", None, {}), (42, 7, "item", "e", {}), (43, 8, "navigation", None, {}), (44, 9, "closed", None, {}), (45, 10, "item", "g", {})]
    got = tabs.replayed(tab_frame(spark, rows)).orderBy("n").collect()
    assert [(r["effect"], r["key"], r["asks"]) for r in got] == [("listed", "d", "read"), ("failed", "d", None), ("again", "d", None), ("again", "d", "read"), ("read", "d", None), ("again", "d", None), ("listed", "e", None), ("cleared", "d", None), ("closed", "e", None)]
    assert [r["url"] for r in got if r["key"] == "d"] == ["u0", "u0", "u0", "u0", "u0", "u0", "u0"]


def test_tab_stream_order(spark, tmp_path):
    """Rows that arrive out of order, over several batches, give what the ordered replay gives."""
    from reelgrid.queries import ran
    from reelgrid.streaming import tabs

    rows = [(3 * k, k, "item", f"k{k % 9}", {"via": "other", "size": None}) for k in range(60)] + [(3 * k + 4, 100 + k, "probe", f"k{k % 9}", {"reject": k % 4 == 0}) for k in range(60)] + [(500, 900, "item", "last", {})]
    frame = tab_frame(spark, rows)
    parts = [[r for r in frame.collect() if (2 if r["event_id"] == 900 else (r["event_id"] * 7 + r["event_id"] // 30) % 3) == k] for k in range(3)]
    for k, part in enumerate(parts):
        spark.createDataFrame(part, tabs.ROW).coalesce(1).write.parquet(f"{tmp_path}/{k}")
    stream = spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/*").withWatermark("seen", "20 minutes")
    got = ran(spark, tabs.tab_effects(stream), "append").orderBy("n").collect()
    assert got == []  # the watermark has passed nothing yet
    stream = spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/*").withWatermark("seen", "250 seconds")
    got = [tuple(r)[1:-1] for r in ran(spark, tabs.tab_effects(stream), "append").orderBy("n").collect()]
    want = [tuple(r)[1:] for r in tabs.replayed(frame).orderBy("n").collect()]
    assert got and got == want[: len(got)] and all(r[1].minute * 60 + r[1].second > 240 for r in want[len(got) :])


def test_state_round_trip():
    from reelgrid.streaming.tabs import Item, Tab

    tab = Tab(rejected=["a"], children=["b"], probes=3, moving=5, n=9)
    tab.items["k"] = Item("k", "hls", "u", None, "", 7, False, True, True, False, "HTTP 404", 11)
    assert Tab.unpacked(tab.packed()) == tab and tab.wakes() == [7 + 20_000_000]


# scanners and addresses


def test_markup():
    from reelgrid.functions.markup import decoded, html_tags, page_references

    assert decoded("a&amp;b&#65;&#x42;&eacute;&copy=1&copy;&copyx&nosuch;&amp") == "a&bABé&copy=1©&copyx&nosuch;&"
    assert list(html_tags("<a b='1' B=2 c d=x/y><!--<i>--><p/></a ><br<x")) == [("a", {"b": "1", "c": "", "d": "x/y"}), ("p", {}), ("a", None)]
    assert list(html_tags("<!--><b><!DOCTYPE html><?x <i>?><u></ 3><title><em></title><s>")) == [("b", {}), ("u", {}), ("title", {}), ("title", None), ("s", {})]
    assert page_references("<template><video src=x></video></template><video><source src=a></video><source src=b>") == (None, [("element", "a")])


def test_xml_events():
    from reelgrid.constants import SAYS
    from reelgrid.functions.markup import XmlError, xml_events

    def said(text):
        try:
            return list(xml_events(text, SAYS, deep=3, many=5))
        except XmlError as e:
            return str(e)

    assert said("﻿<?xml version='1.0'?><p:a xmlns='u' p:b='1 &lt;'>t<![CDATA[<&]]><c/></p:a>") == [("start", "a", {"b": "1 <"}), ("text", "t", None), ("text", "<&", None), ("start", "c", {}), ("end", "c", None), ("end", "a", None)]
    for bad in ("<a><b></a>", "<a>", "<a/><b/>", "x", "<a><!-- ", "<a><![CDATA[x</a>", "", "<a", "<a b='>", "< a/>", "</a>", "<a/>x", "<![CDATA[x]]>"):
        assert said(bad) == SAYS["malformed"], bad
    assert said("<!DOCTYPE a [<!ENTITY x 'y'>]><a/>") == SAYS["doctype"] and said("<!DOCTYPE a") == SAYS["doctype"] and said("<!DOCTYPE a><a/>")[0] == ("start", "a", {})
    assert said("<a><a><a><a></a></a></a></a>") == SAYS["deep"] and said("<a><b/><b/><b/><b/><b/></a>") == SAYS["elements"]


# sources, table functions and stores


def test_file_sources(spark, tmp_path):
    from reelgrid.constants import SAYS
    from reelgrid.sources import files

    files.register(spark)
    texts = {"a.m3u8": "x" * 100, "b.m3u8": "é" * 101, "sub/c.m3u8": "z" * 500, "d.txt": "no", "_hidden.m3u8": "no", "e.m3u8": "😀" * 51}
    (tmp_path / "sub").mkdir()
    for name, text in texts.items():
        (tmp_path / name).write_text(text, encoding="utf-8")
    got = {r["path"].removeprefix(f"{tmp_path}/"): (r["size"], r["text"], r["error"]) for r in spark.read.format("media_texts").option("path", str(tmp_path)).option("suffix", ".m3u8").option("max_chars", 100).load().collect()}
    large = SAYS["playlist_large"]
    assert got == {"a.m3u8": (100, "x" * 100, None), "b.m3u8": (202, None, large), "sub/c.m3u8": (500, None, large), "e.m3u8": (204, None, large)}
    reader = files._Texts({"path": f"file://{tmp_path}", "max_chars": "100", "task_bytes": "6000"})
    assert len(reader.partitions()) > 1 and reader.cost(401) == 0
    (tmp_path / "sub/c.m3u8").unlink()  # a file over the cap by its size is never opened
    assert list(reader.read(files.Files([(f"{tmp_path}/sub/c.m3u8", 500)]))) == [(f"{tmp_path}/sub/c.m3u8", 500, None, large)]
    heads = spark.read.format("media_heads").option("path", str(tmp_path)).option("bytes", 3).load().collect()
    assert {bytes(r["head"]) for r in heads if r["path"].endswith("a.m3u8")} == {b"xxx"}
    assert spark.read.format("media_heads").option("path", f"{tmp_path}/none").load().count() == 0


def test_table_functions(spark):
    from reelgrid.functions import tables

    tables.register(spark)
    spark.createDataFrame([(1, "<a href='/x'>y</a><!-- <b> --><video src=v.mp4>"), (2, None)], "id int, html string").createOrReplaceTempView("some_pages")
    rows = spark.sql("SELECT id, t.* FROM some_pages, LATERAL html_tags(html) t ORDER BY n").collect()
    assert [(r["id"], r["name"], r["attributes"]) for r in rows] == [(1, "a", {"href": "/x"}), (1, "video", {"src": "v.mp4"})]
    assert spark.sql("SELECT * FROM mp4_boxes(NULL)").count() == 0 and spark.sql("SELECT * FROM ts_streams(X'00')").count() == 0


def test_job_store(spark, tmp_path):
    """A job is found until its time is over, whoever asks; opening it again changes nothing."""
    import datetime
    import time

    from reelgrid.streaming import jobs

    names = [c.split()[0] for c in jobs.ASK.split(", ")]
    ask = lambda what, note="n", job="j": spark.createDataFrame([tuple({"what": what, "job_id": job, "tab_id": 1, "note": note, "title": "t", "created": datetime.datetime(2024, 1, 1)}.get(n) for n in names)], jobs.ASK)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    (tmp_path / "in").mkdir()
    stream = jobs.job_store(spark.readStream.schema(jobs.ASK).parquet(f"{tmp_path}/in/*"), minutes=0.5)
    found = []
    query = stream.writeStream.outputMode("update").option("checkpointLocation", f"{tmp_path}/checkpoint").trigger(processingTime="1 second").foreachBatch(lambda rows, n: found.extend((r["job_id"], r["note"]) for r in rows.collect())).start()

    def step(frame):
        """The answers to some rows, once they have been read; a query with such state never runs out of batches."""
        seen, told = sum(p["numInputRows"] for p in query.recentProgress), len(found)
        frame.coalesce(1).write.parquet(f"{tmp_path}/in/{time.time_ns()}")
        until = time.time() + 90
        while sum(p["numInputRows"] for p in query.recentProgress) <= seen and time.time() < until:
            assert query.isActive
            time.sleep(0.2)
        return found[told:]

    try:
        opened = time.time()
        assert step(ask("open")) == [] and step(ask("open", note="other")) == []
        answers = step(ask("find"))
        assert answers == ([("j", "n")] if time.time() - opened < 30 else answers)
        assert step(ask("find", job="none")) == []
        time.sleep(max(0, 45 - (time.time() - opened)))
        assert step(ask("find")) == []
    finally:
        query.stop()


def test_segments_stay_where_they_are(spark):
    """A playlist is read in its row: no shuffle, in bounded batches, whatever stands in it."""
    texts = spark.createDataFrame([(1, "https://h/p/i.m3u8", "#EXTM3U\n" + "#EXTINF:2\n#EXT-X-BYTERANGE:3\na.ts\n" * 30_000), (2, None, "#EXTM3U\n#EXT-X-BYTERANGE:+5@-3\nC.ts\n\u3000b.ts\u00a0\n"), (3, "https://h/p/i.m3u8", "#EXTM3U\n#EXT-X-KEY:METHOD=X,KEYFORMAT=f\n#EXT-X-MEDIA-SEQUENCE:7\na b.ts\n#EXT-X-KEY:METHOD=NONE,KEYFORMAT=f\n../c.ts")], "playlist_id long, base_url string, text string")
    segs = hls.segments(hls.playlists(texts))
    assert "Exchange" not in segs._jdf.queryExecution().executedPlan().toString()
    long = segs.where("playlist_id = 1").agg(F.count("*"), F.max("index"), F.max("range_offset"), F.sum("duration")).first()
    assert tuple(long) == (30_000, 29_999, 89_997, 60_000.0)
    rest = segs.where("playlist_id > 1").orderBy("playlist_id", "index").select("sequence", "url", "range_offset", "range_length", F.size("drm")).collect()
    assert list(map(tuple, rest)) == [(0, None, -3, 5, 0), (1, None, None, None, 0), (7, "https://h/p/a%20b.ts", None, None, 1), (8, "https://h/c.ts", None, None, 0)]


def test_representations_carry_no_siblings(spark):
    """What goes to Python for each representation holds neither its period's sets nor its set's representations."""
    reps = dash.representations(dash.periods(mpd(spark, '<Period><AdaptationSet><Representation id="a"/><Representation id="b"/></AdaptationSet></Period>')))
    seen = []

    def walk(node):
        """Explosions at and below a node."""
        below = sum(walk(node.children().apply(i)) for i in range(node.children().size()))
        if node.nodeName() == "ArrowEvalPython":
            seen.append((below, node.schema().simpleString()))
        return below + (node.nodeName() == "Generate")

    walk(reps._jdf.queryExecution().optimizedPlan())
    of_rows = [schema for below, schema in seen if below == 3]
    assert of_rows and not any("AdaptationSet:" in x or "Representation:" in x for x in of_rows)


def test_keyed_state_calls():
    """A key's rows and its timer cost one read and one write of its state, however many rows it has."""
    from types import SimpleNamespace

    from reelgrid.streaming import state

    calls, kept, timers = [], [], set()
    value = SimpleNamespace(get=lambda: calls.append("get") or (kept[-1] if kept else None), update=lambda v: calls.append("update") or kept.append(v), clear=lambda: calls.append("clear") or kept.clear())
    handle = SimpleNamespace(getValueState=lambda *_: value, registerTimer=lambda t: calls.append("register") or timers.add(t), deleteTimer=lambda t: calls.append("delete") or timers.remove(t))
    at = lambda mark: SimpleNamespace(getCurrentWatermarkInMs=lambda: mark)
    fire = lambda p, t: timers.remove(t) or list(p.handleExpiredTimer((7,), at(t), SimpleNamespace(getExpiryTimeInMs=lambda: t)))
    waiting = state._processor(["tab_id", "key", "us"], state._waiting(20_000))
    waiting.init(handle)
    rows = [SimpleNamespace(key=f"k{i % 300}", us=1_000_001 + i, verified=i % 300 == 5) for i in range(25_000)]
    assert list(waiting.handleInputRows((7,), iter(rows), at(0))) == [] and calls == ["get", "update", "register"]
    assert timers == {21_001}
    shown = fire(waiting, 21_001)
    assert [(r.tab_id, r.key, r.us) for r in shown] == [(7, f"k{i}", 21_000_001 + i) for i in range(300) if i != 5]
    assert calls == ["get", "update", "register"] * 2 and timers == {1_025 + state.CLOSED_MILLIS}
    assert fire(waiting, 1_025 + state.CLOSED_MILLIS) == [] and not kept and not timers
    tab = state._processor([c.split()[0] for c in state.OUTPUT.split(", ")], state._tab)
    tab.init(handle)
    calls.clear()
    told = {"kind": "file", "media": "video", "ext": ".mp4", "mime": "", "size": None, "url": "u"}
    rows = [SimpleNamespace(what="item", key=f"k{i % 300}", us=i, event_id=i, **told) for i in range(25_000)]
    assert len(list(tab.handleInputRows((7,), iter(rows), at(0)))) == 300 and calls == ["get", "update"]
    gone = list(tab.handleInputRows((7,), iter([SimpleNamespace(what="closed", us=30_000_000)]), at(0)))
    assert [r.gone for r in gone] == [True] * 300 and timers == {30_000 + state.CLOSED_MILLIS}
    assert list(tab.handleInputRows((7,), iter(rows), at(0))) == []
    assert fire(tab, 30_000 + state.CLOSED_MILLIS) == [] and not kept and not timers


def test_clock_without_shuffle(spark):
    """A playlist's clock and container come of the pass over its lines: no segment is shuffled for them."""
    text = "#EXTM3U\n#EXTINF:4.5,\na.m4s\n#EXTINF:0.1,\nb.ts\n#EXTINF:0.2,\nc.ts\nd.ts"
    segs = hls.segments(hls.playlists(spark.createDataFrame([(1, "https://h/i", text), (2, "https://h/i", "#EXTM3U\nx.aac"), (3, "https://h/i", "#EXTM3U")], "playlist_id int, base_url string, text string")))
    clock, kinds = hls.elapsed(segs).select("playlist_id", "index", "start"), hls.container(segs)
    assert sorted(map(tuple, clock.collect())) == [(1, 0, 0.0), (1, 1, 4.5), (1, 2, 4.6), (1, 3, 4.6 + 0.2), (2, 0, 0.0)]
    assert sorted(map(tuple, kinds.collect())) == [(1, "fmp4"), (2, "aac")]
    for df in (clock, kinds):
        assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()
