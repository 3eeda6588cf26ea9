"""Text forms of sizes, times, rates and labels, and file names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from reelgrid import constants as K
from reelgrid.functions import urls as U


def fixed(x: Column, digits: int) -> Column:
    """Decimal text of a non-negative number, ties up on the exact binary value."""
    return F.format_string(f"%.{digits}f", F.floor(x * 10**digits + F.lit(0.5)) / 10**digits)


def format_bytes(n: Column) -> Column:
    steps = F.when(n < 1024, 0)
    for k in (1, 2, 3):
        steps = steps.when(n < 1024 ** (k + 1), k)
    k = steps.otherwise(4)
    x = n.cast("double") / F.pow(F.lit(1024.0), k)
    unit = F.element_at(F.array(*[F.lit(u) for u in ("B", "KB", "MB", "GB", "TB")]), k + 1)
    return F.when(n.isNull(), "").otherwise(F.concat(F.when((x >= 100) | (k == 0), fixed(x, 0)).otherwise(fixed(x, 1)), F.lit(" "), unit))


def format_duration(seconds: Column) -> Column:
    s = F.floor(seconds + F.lit(0.5)).cast("bigint")
    h, m, r = F.floor(s / 3600), F.floor(s % 3600 / 60), s % 60
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    return F.when(seconds.isNull() | (seconds <= 0), "").when(h > 0, F.concat_ws(":", h.cast("string"), two(m), two(r))).otherwise(F.concat_ws(":", m.cast("string"), two(r)))


def format_rate(bytes_per_second: Column) -> Column:
    """Bytes a second as text; '' for null, zero, negative and endless rates."""
    finite = (bytes_per_second > 0) & (bytes_per_second < float("inf"))
    return F.when(finite, F.concat(format_bytes(bytes_per_second), F.lit("/s"))).otherwise("")


def has_video(height: Column, width: Column, codecs: Column) -> Column:
    return (height > 0) | (width > 0) | (codecs == "") | F.exists(F.split(codecs, ","), lambda c: F.trim(c).rlike(K.VIDEO_CODEC))


def codecs_remuxable(codecs: Column) -> Column:
    named = F.filter(F.transform(F.split(codecs, ","), lambda c: F.trim(c)), lambda c: c != "")
    return F.forall(named, lambda c: c.rlike(K.H264_CODEC) | c.rlike(K.AAC_CODEC))


def _bits(rate: Column) -> Column:
    return F.when(rate >= 1e6, F.concat(fixed(rate / 1e6, 1), F.lit(" Mbps"))).when(rate > 0, F.concat(F.floor(rate / 1e3 + F.lit(0.5)).cast("string"), F.lit(" kbps")))


def variant_label(height: Column, width: Column, codecs: Column, frame_rate: Column, bandwidth: Column, avg_bandwidth: Column) -> Column:
    rate = F.when(avg_bandwidth > 0, avg_bandwidth).otherwise(bandwidth)
    text = F.concat_ws(" · ", F.when(height > 0, F.concat(height.cast("string"), F.lit("p"))).when(~has_video(height, width, codecs), "Audio only"), F.when(frame_rate > 30, F.concat(F.floor(frame_rate + F.lit(0.5)).cast("string"), F.lit("fps"))), _bits(rate))
    return F.when(text == "", "Default").otherwise(text)


def representation_label(kind: Column, height: Column, bandwidth: Column, lang: Column, codecs: Column) -> Column:
    video = F.concat_ws(" · ", F.when(height > 0, F.concat(height.cast("string"), F.lit("p"))).otherwise("Video"), _bits(bandwidth))
    other = F.concat_ws(" · ", F.when(~lang.isin("", "und"), lang), F.nullif(F.element_at(F.split(codecs, r"\."), 1), F.lit("")), F.when(bandwidth > 0, F.concat(F.floor(bandwidth / 1e3 + F.lit(0.5)).cast("string"), F.lit(" kbps"))))
    return F.when(kind == "video", video).otherwise(F.when(other == "", "Audio").otherwise(other))


def container_of(mime: Column) -> Column:
    low = F.lower(F.coalesce(mime, F.lit("")))
    return F.when(low.rlike("mp4|iso"), "mp4").when(low.contains("webm"), "webm").when(low.contains("mp2t"), "ts").otherwise("other")


def representation_extension(container: Column, kind: Column) -> Column:
    audio = kind == "audio"
    return F.when(container == "webm", F.when(audio, ".weba").otherwise(".webm")).when(container == "ts", ".ts").otherwise(F.when(audio, ".m4a").otherwise(".mp4"))


def drm_system(key_format: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in K.HLS_SYSTEMS.items() for x in pair])
    return F.coalesce(F.try_element_at(table, F.lower(key_format)), F.substring(key_format, 1, 40))


def stream_type(code: Column, what: str = "label") -> Column:
    """Label or kind of an elementary stream type."""
    k = 0 if what == "label" else 1
    table = F.create_map(*[x for t, names in K.STREAM_TYPES.items() for x in (F.lit(t), F.lit(names[k]))])
    return F.coalesce(F.try_element_at(table, code.cast("int")), F.concat(F.lit("stream type 0x"), F.lower(F.hex(code))) if k == 0 else F.lit("other"))


def parse_duration(text: Column) -> Column:
    """Seconds of an ISO 8601 duration; years of 365 and months of 30 days; null if it is none."""
    number = r"([0-9]+(?:\.[0-9]+)?)"
    shape = rf"^P(?:{number}Y)?(?:{number}M)?(?:{number}W)?(?:{number}D)?(?:T(?:{number}H)?(?:{number}M)?(?:{number}S)?)?\z"
    value = F.trim(text)
    total = F.lit(0.0)
    for k, seconds in enumerate((365 * 86400, 30 * 86400, 7 * 86400, 86400, 3600, 60, 1), 1):
        total = total + F.coalesce(F.regexp_extract(value, shape, k).try_cast("double"), F.lit(0.0)) * seconds
    return F.when(value.rlike(shape), total)


def parse_range(text: Column) -> Column:
    """'a-b' as offset and length; null if reversed or no range."""
    shape = r"^([0-9]+)-([0-9]+)\z"
    low, high = (F.regexp_extract(F.trim(text), shape, k).try_cast("bigint") for k in (1, 2))
    return F.when(high >= low, F.struct(low.alias("offset"), (high - low + 1).alias("length")))


def parse_byte_range(text: Column) -> Column:
    """'length[@offset]'; null if there is no length."""
    length = F.trim(F.element_at(F.split(text, "@"), 1)).try_cast("bigint")
    return F.when(length.isNotNull(), F.struct(length.alias("length"), F.trim(F.try_element_at(F.split(text, "@"), F.lit(2))).try_cast("bigint").alias("offset")))


def parse_iv(text: Column) -> Column:
    digits = F.regexp_replace(text, "(?i)^0x", "")
    return F.when(digits.rlike(r"(?i)^[0-9a-f]{1,32}\z"), F.unhex(F.lpad(digits, 32, "0")))


def iv_from_sequence(sequence: Column) -> Column:
    return F.unhex(F.lpad(F.hex(sequence.cast("bigint")), 32, "0"))


def decrypt(data: Column, key: Column, iv: Column) -> Column:
    """AES-128-CBC with a plain 16-byte key; null if the key or the vector has another length."""
    return F.when((F.octet_length(key) == 16) & (F.octet_length(iv) == 16), F.aes_decrypt(F.concat(iv, data), key, F.lit("CBC"), F.lit("PKCS")))


def template_tokens(template: Column) -> Column:
    """A template as its identifiers ('$Name$', '$Name%05d$', '$$') and the text between them."""
    return F.regexp_extract_all(template, F.lit(K.TEMPLATE_TOKEN), F.lit(0))


def expand_tokens(tokens: Column, **values: Column) -> Column:
    """The tokens with the given identifiers replaced; unknown names and null values stay as they are."""

    def put(token: Column) -> Column:
        out = F.when(~token.startswith("$") | (token == "$"), token).when(token == "$$", "$")
        for name, value in values.items():
            text, width = value.cast("string"), F.regexp_extract(token, r"%0([0-9]+)d\$\z", 1)
            padded = F.when((width != "") & (F.length(text) < width.try_cast("int")), F.lpad(text, width.try_cast("int"), "0")).otherwise(text)
            out = out.when(token.rlike(rf"^\${name}(%0[0-9]+d)?\$\z") & text.isNotNull(), padded)
        return out.otherwise(token)

    return F.transform(tokens, put)


def first_units(text: Column, n: int) -> Column:
    """The first n UTF-16 units of a text; half a character at the end is left out."""
    points = F.regexp_extract_all(F.substring(text, 1, n), F.lit("(?s)."), F.lit(0))
    start = F.struct(F.lit(0).alias("units"), F.lit(0).alias("points"))
    step = lambda acc, c: F.struct((acc["units"] + F.when(F.octet_length(c) == 4, 2).otherwise(1)).alias("units"), (acc["points"] + F.when(acc["units"] + F.when(F.octet_length(c) == 4, 2).otherwise(1) <= n, 1).otherwise(0)).alias("points"))
    return F.when(text.rlike("[\\x{10000}-\\x{10FFFF}]"), F.substring(text, F.lit(1), F.aggregate(points, start, step)["points"])).otherwise(F.substring(text, 1, n))


def sanitize_filename(name: Column, fallback: str = "video") -> Column:
    """A file name that every system takes: NFKC (the one step that SQL lacks), then K.NAME_RULES, at most 120 UTF-16 units, no reserved name."""

    @F.pandas_udf("string")
    def composed(names):
        return names.str.normalize("NFKC")

    ascii_only = ~F.coalesce(name, F.lit("")).rlike(r"[^\x00-\x7f]")
    text = F.coalesce(F.when(ascii_only, name).otherwise(composed(F.when(~ascii_only, name))), F.lit(""))
    for pattern, put in K.NAME_RULES:
        text = F.regexp_replace(text, pattern, put)
    text = F.regexp_replace(first_units(text, K.MAX_NAME), r"(?U)\s+\z", "")
    text = F.when(text.rlike(K.RESERVED_NAME), F.concat(F.lit("_"), text)).otherwise(text)
    return F.when(text == "", fallback).otherwise(text)


def base_name(title: Column, url: Column) -> Column:
    return sanitize_filename(F.coalesce(F.nullif(F.trim(title), F.lit("")), F.nullif(F.regexp_replace(U.filename_from_url(url), r"(?i)\.[a-z0-9]{2,5}\z", ""), F.lit("")), F.lit("video")))


def describe(kind: Column, media: Column, url: Column, size: Column, info: Column) -> Column:
    """Title and facts of an item. `info` has playlist, variants, max_height, audio_only, duration, live, hidden_protected, drm, encryption."""
    u = U.of(url)
    label = F.when(kind == "dash", "DASH").otherwise("HLS")
    named = F.nullif(U.filename_from_url(u), F.lit(""))
    title = F.when(kind == "file", F.coalesce(named, F.when(media == "audio", "Audio file").otherwise("Video file"))).when(info["audio_only"], F.concat(label, F.lit(" audio stream"))).otherwise(F.concat(label, F.lit(" stream")))
    stream = F.array(
        F.when(info["max_height"] > 0, F.concat(F.lit("up to "), info["max_height"], F.lit("p"))),
        F.when(info["playlist"].isin("master", "mpd") & (info["variants"] > 1), F.concat(info["variants"], F.lit(" qualities"))),
        F.nullif(format_duration(info["duration"]), F.lit("")),
        F.when(info["live"], "live"),
        F.when(info["hidden_protected"] > 0, F.concat(info["hidden_protected"], F.lit(" DRM hidden"))),
        F.when(info["drm"], "DRM").when(info["encryption"] != "NONE", info["encryption"]),
    )
    facts = F.when(kind == "file", F.array(F.when(size > 0, format_bytes(size)))).otherwise(stream)
    return F.struct(title.alias("title"), F.array_join(F.array_compact(F.concat(facts, F.array(F.nullif(U.host_of(u), F.lit(""))))), " · ").alias("meta"))


def describe_info(info: Column) -> Column:
    """What a manifest turned out to be, as a log line. `info` has error, playlist, variants, segments, live, drm."""
    live, drm = F.when(info["live"], ", live").otherwise(""), F.when(info["drm"], ", DRM").otherwise("")
    return (
        F.when(info["error"].isNotNull(), F.concat(F.lit("error "), info["error"]))
        .when(info["playlist"] == "master", F.concat(F.lit("master, "), info["variants"], F.lit(" variants")))
        .when(info["playlist"] == "mpd", F.concat(F.lit("mpd, "), info["variants"], F.lit(" representations"), live, drm))
        .otherwise(F.concat(F.lit("media, "), info["segments"], F.lit(" segments"), live))
    )


def explain(status: Column, name: Column, message: Column) -> Column:
    """What went wrong, for people: a refused or failed response by its status, a network error, or the message itself."""
    says = lambda text: F.replace(F.lit(text), F.lit("{status}"), status.cast("string"))
    return (
        F.when(status.isin(401, 403), says(K.SAYS["refused"]))
        .when(status.isin(404, 410), says(K.SAYS["gone"]))
        .when(status.isNotNull(), says(K.SAYS["status"]))
        .when(name == "TypeError", K.SAYS["network"])
        .otherwise(message)
    )
