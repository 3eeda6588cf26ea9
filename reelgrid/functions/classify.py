"""Classification of responses and URLs, and the small predicates around it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelgrid import constants as K
from reelgrid.functions import urls as U

CLASS_TYPE = "struct<kind:string,media:string,mime:string,ext:string,size:bigint>"


def header_value(headers: Column, name: str) -> Column:
    """Value of the first header of that name, '' if there is none."""
    return F.coalesce(F.try_element_at(F.filter(headers, lambda h: F.lower(h["name"]) == name.lower()), F.lit(1))["value"], F.lit(""))


def content_type(headers: Column) -> Column:
    return F.lower(F.trim(F.element_at(F.split(header_value(headers, "content-type"), ";"), 1)))


def response_size(status: Column, headers: Column) -> Column:
    """Total size if the response tells it; never the size of a partial body."""
    total = F.regexp_extract(header_value(headers, "content-range"), r"/([0-9]+)\s*\z", 1).try_cast("bigint")
    length = F.trim(header_value(headers, "content-length"))
    return F.coalesce(total, F.when(status == 206, None).otherwise(length.try_cast("double").try_cast("bigint")))


def mime_ext(mime: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in K.MIME_EXT.items() for x in pair])
    return F.coalesce(F.try_element_at(table, F.lower(F.coalesce(mime, F.lit("")))), F.lit(""))


def _found(kind: str | Column, media: str | Column, mime: Column, ext: Column, size: Column) -> Column:
    lit = lambda x: F.lit(x) if isinstance(x, str) else x
    return F.struct(lit(kind).alias("kind"), lit(media).alias("media"), mime.alias("mime"), ext.alias("ext"), size.cast("bigint").alias("size"))


def classify_response(url: Column | U.Url, status: Column, headers: Column) -> Column:
    """What a response is, as a struct; null if it is no media. Rules apply in this order."""
    return _classified(url, status, content_type(headers), response_size(status, headers))


def _classified(url: Column | U.Url, status: Column, mime: Column, size: Column) -> Column:
    url = U.of(url)
    ext = U.path_ext(U.path(url))
    generic = mime.isin(*K.GENERIC_MIMES)
    known = ext.isin(*K.VIDEO_EXTS, *K.AUDIO_EXTS)
    media = F.when(mime.startswith("video/"), "video").when(mime.startswith("audio/"), "audio").when(generic & ext.isin(*K.VIDEO_EXTS), "video").when(generic & ext.isin(*K.AUDIO_EXTS), "audio")
    nothing = F.lit(None).cast(CLASS_TYPE)
    unfit = ~status.isin(200, 206) | (F.length(url.text) > K.MAX_URL_LENGTH) | ~U.is_web(url) | U.host(url).rlike(K.IGNORED_HOST)
    named = F.when(mime_ext(mime) != "", mime_ext(mime)).when(known, F.concat(F.lit("."), ext)).otherwise("")
    return (
        F.when(unfit | url.text.isNull() | status.isNull(), nothing)
        .when(mime.isin(*K.HLS_MIMES) | ((ext == "m3u8") & (generic | mime.endswith("mpegurl"))), _found("hls", "stream", mime, F.lit(".m3u8"), size))
        .when(mime.isin(*K.DASH_MIMES) | ((ext == "mpd") & (generic | mime.endswith("xml"))), _found("dash", "stream", mime, F.lit(".mpd"), size))
        .when(mime.isin(*K.SEGMENT_MIMES) | ext.isin(*K.SEGMENT_EXTS) | media.isNull(), nothing)
        .when(size < K.MIN_FILE_BYTES, nothing)
        .when(U.looks_like_stream_piece(U.path(url)), nothing)
        .otherwise(_found("file", media, mime, named, size))
    )


def with_class(obs: DataFrame) -> DataFrame:
    """The observations (url, status, headers) that are media, with `class` and `key`. Each URL and header is taken apart once:
    parts are columns of their own, and rows that are no media leave through `inline`, since a filter would evaluate the class twice."""
    rows, url = U.with_parts(obs, "url")
    rows = rows.withColumn("__mime", content_type(F.col("headers"))).withColumn("__size", response_size(F.col("status"), F.col("headers")))
    found = _classified(url, F.col("status"), F.col("__mime"), F.col("__size"))
    rows = rows.select("*", F.inline(F.array_compact(F.array(F.when(found.isNotNull(), F.struct(found.alias("class")))))))
    return rows.withColumn("key", U.dedupe_key(url)).drop("__url", "__mime", "__size")


def is_request(via: Column, tab_id: Column, url: Column | U.Url) -> Column:
    """Responses that are looked at: of a tab, over http(s), of the six types of requests that can carry media."""
    return via.isin(*K.REQUEST_TYPES) & (tab_id >= 0) & U.is_web(url)


def classify_url(url: Column | U.Url) -> Column:
    """The same by extension alone."""
    url = U.of(url)
    ext = U.path_ext(U.path(url))
    none, empty = F.lit(None).cast("bigint"), F.lit("")
    nothing = F.lit(None).cast(CLASS_TYPE)
    dotted = F.concat(F.lit("."), ext)
    return (
        F.when(url.text.isNull() | (F.length(url.text) > K.MAX_URL_LENGTH) | ~U.is_web(url) | U.host(url).rlike(K.IGNORED_HOST), nothing)
        .when(ext == "m3u8", _found("hls", "stream", empty, F.lit(".m3u8"), none))
        .when(ext == "mpd", _found("dash", "stream", empty, F.lit(".mpd"), none))
        .when(ext.isin(*K.SEGMENT_EXTS) | U.looks_like_stream_piece(U.path(url)), nothing)
        .when(ext.isin(*K.VIDEO_EXTS), _found("file", "video", empty, dotted, none))
        .when(ext.isin(*K.AUDIO_EXTS), _found("file", "audio", empty, dotted, none))
        .otherwise(nothing)
    )


def head_text(data: Column, n: int) -> Column:
    """The first bytes as Latin-1 text."""
    return F.decode(F.substring(data, 1, n), "ISO-8859-1")


def is_fragment_start(data: Column) -> Column:
    return (F.octet_length(data) >= 8) & F.decode(F.substring(data, 5, 4), "ISO-8859-1").isin(*K.FRAGMENT_BOXES)


def is_not_media_mime(mime: Column) -> Column:
    return mime.rlike(K.NOT_MEDIA_MIME)


def is_text_start(data: Column) -> Column:
    """Whether bytes begin like an HTML, XML or JSON document."""
    return head_text(data, 64).rlike(K.TEXT_START)


def probe_result(status: Column, headers: Column, head: Column, body_bytes: Column) -> Column:
    """Size, mime, fragment and not_media of a probe that was stored: its status, headers, first bytes and, if the body ended, its length."""
    total = F.regexp_extract(header_value(headers, "content-range"), r"/([0-9]+)\s*\z", 1).try_cast("bigint")
    partial = status == 206
    declared = F.when(~partial & (header_value(headers, "content-encoding") == ""), F.nullif(header_value(headers, "content-length").try_cast("bigint"), F.lit(0)))
    mime = content_type(headers)
    return F.struct(F.coalesce(total, declared, F.when(~partial, body_bytes)).alias("size"), mime.alias("mime"), is_fragment_start(head).alias("fragment"), is_not_media_mime(mime).alias("not_media"))


def verified(probe: Column) -> Column:
    """Whether a probed file may be listed."""
    return ~(probe["not_media"] | probe["fragment"] | F.coalesce(probe["size"] < K.MIN_FILE_BYTES, F.lit(False)))


def is_visible(hidden: Column, pending: Column, seen: Column, as_of: Column) -> Column:
    """Not hidden, and not pending for less than the waiting time at `as_of`."""
    return ~hidden & ~(pending & (as_of < seen + F.expr(f"INTERVAL {K.PENDING_SECONDS} SECONDS")))


def is_error_page(size: Column, mime: Column) -> Column:
    """Whether a completed download is a small error page; an unknown (negative or null) size is none."""
    return F.coalesce((size >= 0) & ((size < K.ERROR_PAGE_BYTES) | (mime.rlike(K.TEXTUAL_MIME) & (size < K.TEXT_ERROR_PAGE_BYTES))), F.lit(False))


def outcome(reason: Column, size: Column, mime: Column) -> Column:
    """How a download ended: done, error_page, retry (the server refused it) or failed."""
    return F.when(reason.isNull(), F.when(is_error_page(size, mime), "error_page").otherwise("done")).when(reason.isin(*K.RETRY_CODES), "retry").otherwise("failed")


def fetchable(source: Column, url: Column | U.Url, page: Column | U.Url) -> Column:
    """Links and meta tags are followed only on the page's own site."""
    return ~source.isin("link", "meta") | U.same_site(url, page)


def needs_reading(fetchable: Column, asked: Column, has_info: Column, error: Column, read_at: Column, as_of: Column) -> Column:
    """Whether a sighting of a known manifest has it read: not read nor asked for before, or a read that failed more than RETRY_SECONDS ago."""
    unread = ~has_info & ~asked & fetchable
    failed = has_info & error.isNotNull() & (as_of > read_at + F.expr(f"INTERVAL {K.RETRY_SECONDS} SECONDS"))
    return F.coalesce(unread | failed, F.lit(False))


def cookies_for(url: Column, page: Column) -> Column:
    return F.when(U.same_site(url, page), "include").otherwise("omit")


def badge(kind: Column, media: Column, ext: Column) -> Column:
    return F.when(kind == "hls", "HLS").when(kind == "dash", "DASH").when(ext != "", F.upper(F.regexp_replace(ext, r"^\.", ""))).when(media == "audio", "AUDIO").otherwise("VIDEO")


def blocked_reason(drm: Column, systems: Column, unsupported: Column) -> Column:
    names = F.when(F.size(systems) > 0, F.concat(F.lit(" ("), F.array_join(systems, ", "), F.lit(")"))).otherwise("")
    return F.when(drm, F.replace(F.lit(K.SAYS["blocked"]), F.lit("{systems}"), names)).otherwise(F.coalesce(unsupported, F.lit("")))


def route(kind: Column, host: Column, refusing: Column, drm: Column, unsupported: Column) -> Column:
    """Where an item goes: error, page (streams, and files of hosts that refuse plain requests) or browser."""
    return F.when(kind.isNull() | F.coalesce(drm, F.lit(False)) | (F.coalesce(unsupported, F.lit("")) != ""), "error").when((kind != "file") | F.coalesce(refusing, F.lit(False)), "page").otherwise("browser")
