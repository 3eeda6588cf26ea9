"""Queries of operators on bytes, with their SQL: boxes are put together from hexadecimal text on both sides."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from reelgrid import constants as K
from reelgrid.functions import binary as B
from reelgrid.operators import hls
from reelgrid.registry import query, sql_text
from reelgrid.sources import fixtures as X


def _box(kind: str, *parts: str) -> str:
    """A box as hexadecimal text; '{x}' stands for eight digits."""
    body = "".join(parts)
    size = 8 + sum(len(p) for p in body.replace("{", "}").split("}")[::2]) // 2 + 4 * body.count("{")
    return f"{size:08X}{kind.encode().hex().upper()}{body}"


def _init(*tracks: str, last: str = "00000000", brand: bool = True) -> str:
    traks = [_box("trak", _box("tkhd", "00" * 12, t, "00" * 60)) for t in tracks]
    trexs = [_box("trex", "00000000", t, "00" * 16) for t in tracks]
    head = _box("mvhd", "00" * 96, last)
    return (_box("ftyp", "69736F6D") if brand else "") + _box("moov", head, *traks, _box("mvex", *trexs))


def _segment(number: str, track: str, extra: bool = True) -> str:
    moof = _box("moof", _box("mfhd", "00000000", number), _box("traf", _box("tfhd", "00000000", track)))
    return (_box("styp", "6D736468") if extra else "") + moof + _box("mdat", "DEADBEEF") + (_box("free", "00") if extra else "")


def _spark_hex(template: str, **values: str) -> str:
    for name, value in values.items():
        template = template.replace(f"{{{name}}}", f"', lpad(hex({value}), 8, '0'), '")
    return f"concat('{template}')"


def _duck_hex(template: str, **values: str) -> str:
    for name, value in values.items():
        template = template.replace(f"{{{name}}}", f"' || lpad(upper(to_base({value}, 16)), 8, '0') || '")
    return f"('{template}')"


_V, _A = "(p_partkey % 3 + 1)", "(p_partkey % 4 + 1)"
_NEW = f"(CASE WHEN {_V} = {_A} THEN {_V} + 1 ELSE {_A} END)"


@query(f"SELECT p_partkey, {_A} AS old_id, {_NEW} AS new_id, {_duck_hex(_init('{v}', '{n}', last='{m}'), v=_V, n=_NEW, m=f'greatest({_V}, {_NEW}) + 1')} AS init FROM part")
def init_merge(spark, sf_dir):
    """Initialisation segments of a video and an audio stream merged into one; equal track ids are numbered on."""
    rows = X.table(spark, sf_dir, "part").select("p_partkey", F.expr(f"unhex({_spark_hex(_init('{v}'), v=_V)})").alias("video"), F.expr(f"unhex({_spark_hex(_init('{a}', brand=False), a=_A)})").alias("audio"))
    merged = rows.select("p_partkey", B.merge_init(F.col("video"), F.col("audio")).alias("m"))
    return merged.select("p_partkey", F.col("m.tracks")[0]["old"].alias("old_id"), F.col("m.tracks")[0]["new"].alias("new_id"), F.hex("m.init").alias("init"))


@query(f"SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN {sql_text(K.SAYS['no_moov'])} WHEN 1 THEN {sql_text(K.SAYS['no_mvex'])} WHEN 2 THEN 'Corrupt MP4 box \"moov\"' END AS error, CASE WHEN p_partkey % 5 > 2 THEN {_V} || ',' || {_A} END AS tracks, CASE WHEN p_partkey % 5 > 2 THEN 9 END AS next_track FROM part")
def init_tracks(spark, sf_dir):
    """Track ids of initialisation segments, or why there are none."""
    i = F.col("p_partkey") % 5
    whole = F.expr(f"unhex({_spark_hex(_init('{v}', '{a}', last='00000009'), v=_V, a=_A)})")
    data = F.when(i == 0, F.unhex(F.lit(_box("ftyp", "69736F6D")))).when(i == 1, F.unhex(F.lit(_box("moov", _box("mvhd", "00" * 100))))).when(i == 2, F.unhex(F.lit("FF000000" + "moov".encode().hex()))).otherwise(whole)
    rows = X.table(spark, sf_dir, "part").select("p_partkey", B.parse_init(data).alias("x"))
    return rows.select("p_partkey", "x.error", F.array_join(F.transform("x.tracks", lambda t: t.cast("string")), ",").alias("tracks"), "x.next_track")


_LINES = "WITH l AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS n FROM lineitem)"


@query(_LINES + f" SELECT l_orderkey, n, {_duck_hex(_segment('{s}', '{t}', extra=False), s='n + 4', t='CASE WHEN l_linenumber = 2 THEN 7 ELSE l_linenumber END')} AS data FROM l")
def segment_rewrite(spark, sf_dir):
    """Media segments rewritten for one file: fragments numbered on through the stream, track 2 made 7, other boxes left out."""
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    rows = X.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.expr(f"unhex({_spark_hex(_segment('{s}', '{t}'), s='l_suppkey', t='l_linenumber')})").alias("data"))
    counted = rows.withColumn("moofs", B.count_moof(F.col("data")))
    before = F.coalesce(F.sum("moofs").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = counted.select("l_orderkey", F.row_number().over(order).alias("n"), "data", (before + 5).alias("first"))
    tracks = F.array(F.struct(F.lit(2).cast("bigint").alias("old"), F.lit(7).cast("bigint").alias("new")))
    return placed.select("l_orderkey", "n", F.hex(B.rewrite_segment(F.col("data"), tracks, F.col("first"))["data"]).alias("data"))


@query("""SELECT o_orderkey AS playlist_id, CASE o_orderkey % 4 WHEN 1 THEN 'Unexpected AES-128 key length (5 bytes)' WHEN 2 THEN 'not media' WHEN 3 THEN 'no usable key' END AS error, CASE WHEN o_orderkey % 4 = 0 THEN sha256('media ' || o_orderkey) END AS digest FROM orders""")
def decrypted_segments(spark, sf_dir):
    """Segments decrypted with plain published keys: one of a wrong length, a page in place of media, and a missing key."""
    i = F.col("o_orderkey")
    secret = "unhex('000102030405060708090a0b0c0d0e0f')"
    orders = X.table(spark, sf_dir, "orders").select(i.alias("playlist_id"), F.concat(F.lit("https://h/"), i, F.lit("/")).alias("folder"), F.when(i % 4 == 2, "<html>sorry").otherwise(F.concat(F.lit("media "), i)).alias("clear"))
    lists = orders.select("playlist_id", F.concat("folder", F.lit("i.m3u8")).alias("base_url"), F.lit('#EXTM3U\n#EXT-X-MEDIA-SEQUENCE:7\n#EXT-X-KEY:METHOD=AES-128,URI="k"\ns.ts').alias("text"))
    bodies = orders.select(F.concat("folder", F.lit("s.ts")).alias("url"), F.expr(f"substring(aes_encrypt(encode(clear, 'UTF-8'), {secret}, 'CBC', 'PKCS', unhex(lpad('7', 32, '0'))), 17)").alias("body"))
    keys = orders.where("playlist_id % 4 <> 3").select(F.concat("folder", F.lit("k")).alias("url"), F.when(F.col("playlist_id") % 4 == 1, F.lit(b"short")).otherwise(F.expr(secret)).alias("key"))
    found = hls.decrypted(hls.read_segments(lists, "sequence", "url", "range_offset", "range_length", "key", "drm"), bodies, keys)
    return found.select("playlist_id", "error", F.sha2("data", 256).alias("digest"))


@query(_LINES + f" SELECT playlist_id, n - 1 AS index, {sql_text(K.SAYS['format'])} AS error FROM (SELECT l_orderkey AS playlist_id, n, l_returnflag, first_value(l_returnflag) OVER (PARTITION BY l_orderkey ORDER BY n) AS f FROM l) WHERE l_returnflag <> f")
def format_changes(spark, sf_dir):
    """Initialisation segments that differ from their stream's first."""
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    maps = X.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("playlist_id"), (F.row_number().over(order) - 1).alias("index"), F.encode("l_returnflag", "UTF-8").alias("data"))
    return hls.format_changes(maps)


@query("SELECT doc_id, md5(coalesce(text, '')) = md5(rtrim(coalesce(text, ''), ' ')) AS same FROM documents")
def same_bytes(spark, sf_dir):
    """Binary equality of texts with and without their last blanks."""
    text = F.coalesce("text", F.lit(""))
    return X.table(spark, sf_dir, "documents").select("doc_id", (F.encode(text, "UTF-8") == F.encode(F.rtrim(text), "UTF-8")).alias("same"))
