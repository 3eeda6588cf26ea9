"""MPEG-DASH manifests to rows. Input: manifest_id, url, text."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T_

from reelgrid import constants as K
from reelgrid.functions import formats as T
from reelgrid.functions import urls as U
from reelgrid.functions.markup import XmlError, xml_events

_INIT = "struct<_sourceURL:string,_range:string>"
_TIMELINE = "struct<S:array<struct<_t:string,_d:string,_r:string>>>"
_TEMPLATE = f"struct<_media:string,_initialization:string,_timescale:string,_startNumber:string,_duration:string,_presentationTimeOffset:string,Initialization:{_INIT},SegmentTimeline:{_TIMELINE}>"
_LIST = f"struct<_timescale:string,_startNumber:string,_duration:string,Initialization:{_INIT},SegmentTimeline:{_TIMELINE},SegmentURL:array<struct<_media:string,_mediaRange:string>>>"
_LEVEL = f"BaseURL:array<string>,ContentProtection:array<struct<_schemeIdUri:string>>,SegmentTemplate:{_TEMPLATE},SegmentList:{_LIST}"
_MEDIA = "_mimeType:string,_contentType:string,_codecs:string,_width:string,_height:string,_lang:string"
_REP = f"struct<_id:string,_bandwidth:string,{_MEDIA},{_LEVEL}>"
_SET = f"struct<{_MEDIA},{_LEVEL},Representation:array<{_REP}>>"
_PERIOD = f"struct<_id:string,_start:string,_duration:string,{_LEVEL},AdaptationSet:array<{_SET}>>"
_ID = ["manifest_id", "period", "set", "rep"]
SCHEMA = f"_type:string,_mediaPresentationDuration:string,BaseURL:array<string>,Period:array<{_PERIOD}>"


def _tree(text: str, kind: T_.StructType) -> dict:
    """The root element as nested values of `kind`: attributes (_name), texts of elements, the first or all children of a name. Elements that `kind` doesn't name are passed over."""
    root, stack = {}, []  # of each open element: its values and their kind, None where it is passed over, or a list of texts
    for what, name, found in xml_events(text, K.SAYS, deep=K.MAX_DEPTH, many=K.MAX_ELEMENTS):
        if what == "end":
            values, of = stack.pop()
            if of == "text":
                values.append("".join(values.pop()))
        elif what == "text":
            if stack and stack[-1][1] == "text":
                stack[-1][0][-1].append(name)
        elif not stack:
            if name != "MPD":
                root = None
            stack.append((root, kind if root is not None else None))
            if root is not None:
                root |= {f"_{k}": v for k, v in found.items() if f"_{k}" in kind.names}
        else:
            values, of = stack[-1]
            if not isinstance(of, T_.StructType) or name not in of.names:
                stack.append((None, None))
                continue
            own = of[name].dataType
            if isinstance(own, T_.ArrayType) and isinstance(own.elementType, T_.StringType):
                texts = values.setdefault(name, [])
                texts.append([])
                stack.append((texts, "text"))
                continue
            inner = own.elementType if isinstance(own, T_.ArrayType) else own
            child = {f"_{k}": v for k, v in found.items() if f"_{k}" in inner.names}
            if isinstance(own, T_.ArrayType):
                values.setdefault(name, []).append(child)
            else:
                values.setdefault(name, child)
            stack.append((child, inner))
    if root is None:
        raise XmlError(K.SAYS["root"])
    return root


def manifests(texts: DataFrame) -> DataFrame:
    """manifest_id, url, mpd (parsed), error; one parse of each text, in Arrow batches.

    Namespaces are dropped; unknown entities and a plain `&` stay text. Texts over the cap, with a document type subset, that are broken or no manifest get an error.
    """
    rows = texts.select("manifest_id", "url", "text")
    kind = T_.StructType.fromDDL(SCHEMA)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        arrow = to_arrow_type(kind)
        for batch in batches:
            trees, errors = [], []
            for text in batch.column(2).to_pylist():
                tree, error = None, None
                try:
                    if len(text or "") > K.MAX_MANIFEST_CHARS:
                        raise XmlError(K.SAYS["large"])
                    tree = _tree(text or "", kind)
                except XmlError as e:
                    error = str(e)
                trees.append(tree)
                errors.append(error)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(trees, arrow), pa.array(errors, pa.string())], names=["manifest_id", "url", "mpd", "error"])

    ids = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields[:2])
    return rows.mapInArrow(read, f"{ids}, mpd struct<{SCHEMA}>, error string")


def periods(parsed: DataFrame) -> DataFrame:
    """One row per period: index, start, duration. A period starts where it says, or where the one before ends."""
    rows = parsed.where("mpd is not null").select("manifest_id", "url", F.col("mpd._type").alias("kind"), F.col("mpd.BaseURL").alias("mpd_base"), F.col("mpd.Period").alias("elements"), T.parse_duration(F.col("mpd._mediaPresentationDuration")).alias("total"))
    spans = F.transform("elements", lambda p: F.struct(T.parse_duration(p["_start"]).alias("start"), T.parse_duration(p["_duration"]).alias("duration")))
    rows = rows.withColumn("spans", spans).withColumn("numbered", F.transform("spans", lambda s, i: F.struct(s["start"].alias("start"), s["duration"].alias("duration"), F.try_element_at(F.col("spans"), i + 2)["start"].alias("next"))))

    def step(acc: Column, p: Column) -> Column:
        start = F.coalesce(p["start"], acc["cursor"])
        duration = F.coalesce(p["duration"], p["next"] - start, F.col("total") - start)
        return F.struct((start + F.coalesce(duration, F.lit(0.0))).alias("cursor"), F.concat(acc["out"], F.array(F.struct(start.alias("start"), duration.alias("duration")))).alias("out"))

    zero = F.struct(F.lit(0.0).alias("cursor"), F.array().cast("array<struct<start:double,duration:double>>").alias("out"))
    rows = rows.withColumn("times", F.aggregate("numbered", zero, step)["out"])
    out = rows.select("manifest_id", "url", F.coalesce(F.when(F.col("kind") == "dynamic", "dynamic"), F.lit("static")).alias("type"), "total", "mpd_base", F.posexplode(F.arrays_zip(F.col("elements").alias("p"), F.col("times").alias("t"))).alias("period", "x"))
    return out.select("manifest_id", "url", "type", "total", "mpd_base", "period", F.col("x.t.start").alias("start"), F.col("x.t.duration").alias("duration"), F.col("x.p").alias("element"))


def main_period(p: DataFrame) -> DataFrame:
    """The longest period of each manifest; of equal ones the first."""
    w = Window.partitionBy("manifest_id").orderBy(F.desc(F.coalesce("duration", F.lit(0.0))), "period")
    return p.withColumn("n", F.row_number().over(w)).where("n = 1").drop("n")


def _systems(lists: list[Column]) -> Column:
    table = F.create_map(*[F.lit(x) for pair in K.DASH_SYSTEMS.items() for x in pair])
    ids = F.flatten(F.array_compact(F.array(*[F.transform(x, lambda c: F.lower(F.coalesce(c["_schemeIdUri"], F.lit("")))) for x in lists])))
    names = F.array_distinct(F.transform(ids, lambda i: F.coalesce(F.try_element_at(table, i), F.nullif(F.substring(i, 1, 40), F.lit("")), F.lit("DRM"))))
    return F.when(F.size(names) > 1, F.filter(names, lambda n: n != "CENC")).otherwise(names)


def _number(text: Column) -> Column:
    """A number of an attribute; null if it is missing or none."""
    x = F.trim(text).try_cast("double")
    return F.when(~F.isnan(x), x)


def _whole(text: Column) -> Column:
    """The same as a whole number within 2^40, beyond which no count or size is of use."""
    x = F.trim(text).try_cast("double")
    return F.when(x.isNotNull() & ~F.isnan(x), F.floor(F.greatest(F.least(x, F.lit(2.0**40)), F.lit(-(2.0**40)))).cast("bigint"))


def _scheme(reference: Column) -> Column:
    return F.replace(F.lit(K.SAYS["scheme"]), F.lit("{scheme}"), F.coalesce(F.nullif(F.regexp_extract(F.trim(reference), "^([A-Za-z][A-Za-z0-9+.-]*:)", 1), F.lit("")), F.trim(reference)))


def _rebased(rows: DataFrame, level: str) -> DataFrame:
    """`base` (parts for references) after a level's BaseURL, and the first error on the way."""
    text = F.nullif(F.trim(F.get(level, F.lit(0))), F.lit(""))
    rows = rows.withColumn("__text", text).withColumn("__to", U.resolve(F.col("__text"), F.col("base")))
    foreign = F.when(F.col("__text").isNotNull() & F.col("__to").isNull(), _scheme(F.col("__text")))
    return rows.withColumn("error", F.coalesce("error", foreign)).withColumn("base", F.when(F.col("__text").isNull(), F.col("base")).otherwise(F.regexp_replace("__to", "#.*", ""))).drop("__text", "__to")


def representations(p: DataFrame) -> DataFrame:
    """One row per representation, attributes inherited from its adaptation set and period; `error` where a BaseURL is not http(s)."""
    # Of each level only what the next ones need goes on: an element of a period or set holds all its representations, which would be carried with each of them.
    facts = ["manifest_id", "type", "total", "period", "start", "duration"]
    inherited = ("ContentProtection", "SegmentTemplate", "SegmentList")
    level = lambda x: F.struct(*[F.col(f"{x}.{n}") for n in inherited]).alias(x)
    media = ("_mimeType", "_contentType", "_codecs", "_width", "_height", "_lang")
    p = _rebased(_rebased(p.withColumn("base", U.base(F.col("url"))).withColumn("error", F.lit(None).cast("string")), "mpd_base"), "element.BaseURL")
    sets = p.select(*facts, "base", "error", level("element"), F.posexplode("element.AdaptationSet").alias("set", "s"))
    sets = _rebased(sets, "s.BaseURL").select(*facts, "base", "error", "element", "set", F.struct(*[F.col(f"s.{n}") for n in (*media, *inherited)]).alias("own"), F.col("s.Representation").alias("all"))
    reps = sets.select(*facts, "base", "error", "element", "set", F.col("own").alias("s"), F.posexplode("all").alias("rep", "r"))
    reps = _rebased(reps, "r.BaseURL")
    both = lambda k: F.coalesce(F.col(f"r.{k}"), F.col(f"s.{k}"))
    mime = F.coalesce(both("_mimeType"), F.lit(""))
    kind = F.coalesce(both("_contentType"), F.element_at(F.split(mime, "/"), 1))
    kind = F.when(mime.rlike("(?i)ttml|vtt|text|subtitle") | (kind == "text"), "text").when(kind.isin("video", "audio"), kind).otherwise("other")
    marks = [F.col(f"{x}.ContentProtection") for x in ("element", "s", "r")]
    guarded = F.lit(False)
    for m in marks:
        guarded = guarded | F.coalesce(F.size(m) > 0, F.lit(False))
    return reps.select(
        "manifest_id", "type", "total", "period", "start", "duration", "set", "rep",
        F.coalesce("r._id", F.lit("")).alias("id"), kind.alias("kind"), mime.alias("mime"), F.coalesce(both("_codecs"), F.lit("")).alias("codecs"),
        F.coalesce(_whole(F.col("r._bandwidth")), F.lit(0)).alias("bandwidth"), F.coalesce(_whole(both("_width")), F.lit(0)).alias("width"), F.coalesce(_whole(both("_height")), F.lit(0)).alias("height"),
        F.coalesce(both("_lang"), F.lit("")).alias("lang"), T.container_of(mime).alias("container"), guarded.alias("protected"), _systems(marks).alias("systems"),
        F.col("base").alias("url"), "base", "error",
        *[F.array(*[F.col(f"{x}.{n}") for x in ("r", "s", "element")]).alias(n) for n in ("SegmentTemplate", "SegmentList")],
    )


def downloadable(reps: DataFrame, mains: DataFrame, kind: str) -> DataFrame:
    """Clear representations of the main period, best first (video), or by adaptation set and bit rate (audio)."""
    rows = reps.where((F.col("kind") == kind) & ~F.col("protected")).join(mains.select("manifest_id", "period"), ["manifest_id", "period"], "left_semi")
    order = [F.desc("height"), F.desc("bandwidth")] if kind == "video" else [F.asc("set"), F.desc("bandwidth")]
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("manifest_id").orderBy(*order, "set", "rep")))


def taken(reps: DataFrame, mains: DataFrame) -> DataFrame:
    """Of each manifest the representations that would be taken: the first video and the first audio in the orders of `downloadable`."""
    rows = reps.where(F.col("kind").isin("video", "audio") & ~F.col("protected")).join(mains.select("manifest_id", "period"), ["manifest_id", "period"], "left_semi")
    first = F.when(F.col("kind") == "video", -F.col("height")).otherwise(F.col("set"))
    w = Window.partitionBy("manifest_id", "kind").orderBy(first, F.desc("bandwidth"), "set", "rep")
    return rows.withColumn("place", F.row_number().over(w)).where("place = 1").drop("place")


def protection(reps: DataFrame) -> DataFrame:
    """Per manifest over all periods: protected (all of it), hidden_protected, systems."""
    g = reps.where(F.col("kind").isin("video", "audio")).groupBy("manifest_id").agg(F.bool_and("protected").alias("protected"), F.count_if("protected").alias("n"), F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.when(F.col("protected"), F.col("systems")))))).alias("systems"))
    return g.select("manifest_id", "protected", F.when(F.col("protected"), 0).otherwise(F.col("n")).alias("hidden_protected"), "systems")


def summarize(p: DataFrame, reps: DataFrame) -> DataFrame:
    """One row per manifest, by one aggregate over its representations: variants, max_height, audio_only, duration, live, drm, systems, hidden_protected, unsupported, periods.

    Lists are those of the main period, protection is that of all periods. `unsupported` also names what is wrong with the representation that would be taken.
    """
    facts = p.groupBy("manifest_id").agg(F.count(F.lit(1)).alias("periods"), F.max("type").alias("live"), F.max("total").alias("total"), F.max_by(F.struct("period", "duration"), F.struct(F.coalesce("duration", F.lit(0.0)), -F.col("period"))).alias("main"))
    rows = reps.join(facts.select("manifest_id", F.col("main.period").alias("main")), "manifest_id").withColumn("offered", ~F.col("protected") & (F.col("period") == F.col("main")))
    video, audio = F.col("offered") & (F.col("kind") == "video"), F.col("offered") & (F.col("kind") == "audio")
    media = F.col("kind").isin("video", "audio")
    rank = F.when(video, F.struct(F.lit(1), F.col("height"), F.col("bandwidth"), -F.col("set"), -F.col("rep"))).when(audio, F.struct(F.lit(0), (-F.col("set")).cast("bigint").alias("height"), F.col("bandwidth"), -F.col("set"), -F.col("rep")))
    g = rows.groupBy("manifest_id").agg(
        F.count_if(video).alias("videos"), F.count_if(audio).alias("audios"), F.nullif(F.max(F.when(video, F.col("height"))), F.lit(0)).alias("max_height"),
        F.bool_and(F.when(media, F.col("protected"))).alias("drm"), F.count_if(media & F.col("protected")).alias("n"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.when(media & F.col("protected"), F.col("systems")))))).alias("all_systems"), F.max_by(F.struct(*[c for c in reps.columns if c != "manifest_id"]), rank).alias("first"),
    )
    # Only the representation that would be taken is planned.
    counts = ("videos", "audios", "max_height", "drm", "n", "all_systems")
    planned = plans(g.select("manifest_id", *counts, "first.*"), keep=counts).select("manifest_id", *counts, F.col("error").alias("problem")).withColumnRenamed("all_systems", "systems")
    every = facts.join(planned, "manifest_id", "left")
    videos, audios, drm = F.coalesce("videos", F.lit(0)), F.coalesce("audios", F.lit(0)), F.coalesce("drm", F.lit(False))
    names = F.coalesce(F.nullif(F.array_join("systems", ", "), F.lit("")), F.lit("DRM"))
    unsupported = F.when(drm, F.replace(F.lit(K.SAYS["drm"]), F.lit("{systems}"), names)).when(videos + audios == 0, K.SAYS["nothing"]).otherwise(F.coalesce("problem", F.lit("")))
    return every.select(
        "manifest_id", F.when(videos > 0, videos).otherwise(audios).alias("variants"), "max_height", ((videos == 0) & (audios > 0)).alias("audio_only"), F.coalesce("main.duration", "total").alias("duration"),
        (F.col("live") == "dynamic").alias("live"), drm.alias("drm"), F.when(drm, F.col("systems")).otherwise(F.array().cast("array<string>")).alias("systems"), F.when(drm, 0).otherwise(F.coalesce("n", F.lit(0))).alias("hidden_protected"), unsupported.alias("unsupported"), "periods",
    )


def _inherit(levels: str, name: str) -> Column:
    return F.coalesce(*[F.get(levels, F.lit(k))[name] for k in range(3)])


def _own(levels: str, name: str) -> Column:
    """A child of the innermost element of that name only."""
    return F.coalesce(*[F.get(levels, F.lit(k)) for k in range(3)])[name]


def _entries(timeline: Column, seconds: Column, timescale: Column, pto: Column) -> Column:
    """Timeline entries as (time, ticks, repeat, first, open): a fold, since a negative repeat depends on the running time.

    The fold goes by blocks of entries, so that its cost is near linear in their number. Entries without a positive duration must be ruled out before.
    """
    end = seconds * timescale + pto
    numbered = F.transform(timeline, lambda s, i: F.struct(_number(s["_t"]).alias("t"), _number(s["_d"]).alias("d"), F.coalesce(_whole(s["_r"]), F.lit(0)).alias("r"), F.coalesce(_number(F.get(timeline, i + 1)["_t"]), end).alias("next")))
    kind = "array<struct<time:double,ticks:double,repeat:bigint,first:bigint,open:boolean>>"
    zero = lambda time, count: F.struct(time.alias("time"), count.alias("count"), F.array().cast(kind).alias("out"))

    def step(acc: Column, s: Column) -> Column:
        t = F.coalesce(s["t"], acc["time"])
        until = F.greatest(F.lit(0.0), F.least(F.ceil(F.try_divide(s["next"] - t, s["d"])).cast("double") - 1, F.lit(2.0**40))).cast("bigint")
        r = F.when(s["r"] >= 0, s["r"]).otherwise(F.when(s["next"].isNull(), 0).otherwise(until))
        entry = F.struct(t.alias("time"), s["d"].alias("ticks"), r.alias("repeat"), acc["count"].alias("first"), ((s["r"] < 0) & s["next"].isNull()).alias("open"))
        return F.struct((t + (r + 1) * s["d"]).alias("time"), (acc["count"] + r + 1).alias("count"), F.concat(acc["out"], F.array(entry)).alias("out"))

    def block(acc: Column, b: Column) -> Column:
        inner = F.aggregate(b, zero(acc["time"], acc["count"]), step)
        return F.struct(inner["time"].alias("time"), inner["count"].alias("count"), F.concat(acc["out"], F.array(inner["out"])).alias("out"))

    nothing = F.lit(0).cast("bigint")
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(numbered) - 1) / 256).cast("int")), lambda k: F.slice(numbered, k * 256 + 1, F.lit(256)))
    start = F.struct(F.lit(0.0).alias("time"), nothing.alias("count"), F.array().cast(f"array<{kind}>").alias("out"))
    return F.when(F.size(timeline) > 0, F.flatten(F.aggregate(blocks, start, block)["out"])).otherwise(F.array().cast(kind))


def plans(reps: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """How each representation is addressed: mode (template, list or single), the fields that expansion needs, `init` (url, range), open_ended and an error; and the columns of `keep`.

    Nothing a manifest says can stop the job: divisions are guarded, and what cannot be addressed has an error and no segments.
    """
    some = lambda n: F.exists(n, lambda x: x.isNotNull())
    t, li = "SegmentTemplate", "SegmentList"
    mode = F.when(some(t), F.when(_inherit(t, "_media").isNotNull(), "template").otherwise("single")).when(some(li), "list").otherwise("single")
    is_template, is_list = F.col("mode") == "template", F.col("mode") == "list"
    pick = lambda name: F.when(is_template, _inherit(t, name)).when(is_list, _inherit(li, name))
    rows = reps.withColumn("mode", mode)
    tokens = T.expand_tokens(T.template_tokens(_inherit(t, "_media")), RepresentationID=F.col("id"), Bandwidth=F.col("bandwidth"))
    start = T.expand_tokens(T.template_tokens(F.coalesce(_inherit(t, "_initialization"), _own(t, "Initialization")["_sourceURL"])), RepresentationID=F.col("id"), Bandwidth=F.col("bandwidth"))
    init = F.when(is_template, F.array_join(start, "")).otherwise(_inherit(li, "Initialization")["_sourceURL"])
    positive = lambda x: F.when(x != 0, x)
    rows = rows.select(
        "*", F.col("duration").alias("seconds"), F.when(is_template, tokens).alias("media"), init.alias("init_ref"), (is_list & _inherit(li, "Initialization").isNotNull()).alias("listed_init"),
        F.when(is_list, T.parse_range(_inherit(li, "Initialization")["_range"])).alias("init_range"), F.coalesce(positive(_number(pick("_timescale"))), F.lit(1.0)).alias("timescale"),
        F.coalesce(_whole(pick("_startNumber")), F.lit(1)).alias("start_number"), F.nullif(F.trim(pick("_duration")), F.lit("")).alias("said"), F.coalesce(_number(_inherit(t, "_presentationTimeOffset")), F.lit(0.0)).alias("pto"),
        F.when(is_template | is_list, pick("SegmentTimeline")["S"]).alias("timeline"), pick("SegmentTimeline").isNotNull().alias("timed"), _inherit(li, "SegmentURL").alias("urls"),
    ).withColumn("ticks", _number(F.col("said")))
    bad = F.exists("timeline", lambda s: ~F.coalesce(_number(s["_d"]) > 0, F.lit(False)))
    entries = F.when(is_template & F.col("timed") & ~F.coalesce(bad, F.lit(False)), _entries(F.coalesce("timeline", F.array().cast("array<struct<_t:string,_d:string,_r:string>>")), F.col("seconds"), F.col("timescale"), F.col("pto")))
    rows = rows.withColumn("entries", entries)
    count = F.ceil(F.try_divide(F.col("seconds") * F.col("timescale"), F.col("ticks"))).cast("bigint")
    rows = rows.withColumn("count", F.when(F.col("entries").isNotNull(), F.aggregate("entries", F.lit(0).cast("bigint"), lambda n, e: n + e["repeat"] + 1)).when(is_template, count).when(is_list, F.size("urls").cast("bigint")))
    first = T.expand_tokens(F.col("media"), Number=F.col("start_number"), Time=_shown(F.coalesce(F.get("entries", F.lit(0))["time"], F.col("pto"))))
    reference = F.when(is_template, F.array_join(first, ""))
    named = F.filter(F.transform("urls", lambda u: u["_media"]), lambda m: m.isNotNull())
    away = F.get(F.filter(F.zip_with(named, U.resolve_each(named, F.col("base")), lambda m, u: F.when(u.isNull(), m)), lambda m: m.isNotNull()), F.lit(0))
    rows = rows.withColumn("__init", U.resolve(F.nullif(F.col("init_ref"), F.lit("")), F.col("base"))).withColumn("__first", reference).withColumn("__away", away)
    broken = lambda ref, url: F.when(ref.isNotNull() & url.isNull(), _scheme(ref))
    error = F.coalesce(
        "error",
        F.when(F.col("mode") != "single", broken(F.nullif(F.col("init_ref"), F.lit("")), F.col("__init"))),
        F.when(is_template & F.col("timed"), F.when(F.coalesce(bad, F.lit(False)), K.SAYS["entry"]))
        .when(is_template & F.col("said").isNull(), K.SAYS["undated"])
        .when(is_template & ~F.coalesce(F.col("ticks") > 0, F.lit(False)), K.SAYS["duration"])
        .when(is_template & (F.col("seconds").isNull() | (F.col("type") == "dynamic")), K.SAYS["wall_clock"]),
        F.when(F.col("count") > K.MAX_SEGMENTS, K.SAYS["many"]),
        broken(F.col("__first"), U.resolve(F.col("__first"), F.col("base"))),
        F.when(is_list & F.col("__away").isNotNull(), _scheme(F.col("__away"))),
    )
    where = F.when(F.coalesce(F.col("init_ref"), F.lit("")) != "", F.col("__init")).when(F.col("listed_init"), F.col("url"))
    init = F.when((F.col("mode") != "single") & where.isNotNull(), F.struct(where.alias("url"), F.col("init_range").alias("range")))
    return rows.select(
        *_ID, "id", "kind", "container", "protected", "systems", "width", "height", "bandwidth", "url", "base", "mode", "seconds", "media", init.alias("init"), "timescale", "start_number", "ticks", "pto", "timeline", "entries", "count", "urls",
        F.coalesce(F.exists("entries", lambda e: e["open"]), F.lit(False)).alias("open_ended"), error.alias("error"), *keep,
    )



def _shown(x: Column) -> Column:
    """A number as text, whole ones without a fraction."""
    return F.when(x == F.floor(x), F.floor(x).cast("string")).otherwise(x.cast("string"))


def template_segments(p: DataFrame) -> DataFrame:
    """Segments of template-addressed representations without an error: id, index, number, time, start, duration, url."""
    even = F.when(F.col("count") > 0, F.array(F.struct(F.col("pto").alias("time"), F.col("ticks"), (F.col("count") - 1).alias("repeat"), F.lit(0).cast("bigint").alias("first"), F.lit(False).alias("open"))))
    # Plans that yield nothing leave through `explode`: a filter would be pushed below the plan and work it out twice.
    good = (F.col("mode") == "template") & F.col("error").isNull()
    rows = p.select("*", F.explode(F.when(good, F.coalesce("entries", even))).alias("e")).select("*", F.explode(F.sequence(F.lit(0).cast("bigint"), "e.repeat")).alias("k"))
    rows = rows.withColumn("index", F.col("e.first") + F.col("k")).withColumn("time", F.col("e.time") + F.col("k") * F.col("e.ticks")).withColumn("number", F.col("start_number") + F.col("index"))
    name = F.array_join(T.expand_tokens(F.col("media"), Number=F.col("number"), Time=_shown(F.col("time"))), "")
    return rows.select(*_ID, "id", "index", "number", F.floor("time").alias("time"), ((F.col("time") - F.col("pto")) / F.col("timescale")).alias("start"), (F.col("e.ticks") / F.col("timescale")).alias("duration"), U.resolve(name, F.col("base")).alias("url"))


def list_segments(p: DataFrame) -> DataFrame:
    """Segments of list-addressed representations without an error: id, index, number, start, duration, range, url. A timeline entry without a duration lasts NaN."""
    good = (F.col("mode") == "list") & F.col("error").isNull()
    repeat = lambda s: F.least(F.greatest(F.coalesce(_whole(s["_r"]), F.lit(0)), F.lit(0)) + 1, F.lit(K.MAX_SEGMENTS)).cast("int")
    spread = F.flatten(F.transform("timeline", lambda s: F.array_repeat(F.coalesce(s["_d"].try_cast("double"), F.lit(float("nan"))), repeat(s))))
    rows = p.select(*_ID, "id", "url", "base", "timescale", "start_number", "ticks", spread.alias("widths"), F.posexplode(F.when(good, F.col("urls"))).alias("index", "u"))
    width = F.coalesce(F.get("widths", F.col("index")), F.col("ticks"), F.lit(0.0)) / F.col("timescale")
    rows = rows.withColumn("duration", width)
    w = Window.partitionBy(*_ID).orderBy("index").rowsBetween(Window.unboundedPreceding, -1)
    return rows.select(*_ID, "id", "index", (F.col("start_number") + F.col("index")).alias("number"), F.coalesce(F.sum("duration").over(w), F.lit(0.0)).alias("start"), "duration", T.parse_range(F.col("u._mediaRange")).alias("range"), F.when(F.col("u._media").isNull(), F.col("url")).otherwise(U.resolve(F.col("u._media"), F.col("base"))).alias("url"))


def can_merge(video: DataFrame, audio: DataFrame) -> DataFrame:
    """For each pair of a video and an audio plan of a manifest (one of each): whether both are mp4 in segments after an initialisation segment, without an error."""
    fit = F.coalesce((F.col("container") == "mp4") & (F.col("mode") != "single") & F.col("init").isNotNull() & (F.col("count") > 0) & F.col("error").isNull(), F.lit(False))
    both = video.select("manifest_id", fit.alias("v")).join(audio.select("manifest_id", fit.alias("a")), "manifest_id")
    return both.select("manifest_id", (F.col("v") & F.col("a")).alias("can_merge"))


def merge_order(video: DataFrame, audio: DataFrame) -> DataFrame:
    """Segments of both streams by start, video first; place runs from 0."""
    both = video.withColumn("is_audio", F.lit(0)).unionByName(audio.withColumn("is_audio", F.lit(1)))
    return both.withColumn("place", F.row_number().over(Window.partitionBy("manifest_id").orderBy("start", "is_audio", "index")) - 1)
