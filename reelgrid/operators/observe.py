"""Observations of media: upserts, anti-joins, caps, hiding and ranking per tab."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reelgrid import constants as K
from reelgrid.functions import classify as C
from reelgrid.functions import urls as U
from reelgrid.functions.markup import page_references


def classified(obs: DataFrame) -> DataFrame:
    """Observations that are media, with their class and canonical key."""
    return C.with_class(obs).select("tab_id", "seen", "event_id", "url", "initiator", "class.*", "key")


def upsert(items: DataFrame, reads: DataFrame | None = None) -> DataFrame:
    """One row per tab and key: first sighting's class, first known size and mime, latest URL. A partial aggregate: no key is gathered.

    `reads` (tab_id, key, read_at) tells when a manifest was first read: a DASH manifest keeps the URL it had then, as it is what was read.
    """
    first, last = F.struct("seen", "event_id"), F.struct("seen", "event_id")
    known = F.when(F.coalesce("size", F.lit(0)) > 0, F.col("size"))
    named = F.nullif(F.col("mime"), F.lit(""))
    fresh = F.lit(True)
    if reads is not None:
        items = items.join(reads.groupBy("tab_id", "key").agg(F.min("read_at").alias("read_at")), ["tab_id", "key"], "left")
        fresh = (F.col("kind") != "dash") | F.col("read_at").isNull() | (F.col("seen") <= F.col("read_at"))
    return items.groupBy("tab_id", "key").agg(
        F.min("seen").alias("seen"),
        F.min_by("kind", first).alias("kind"),
        F.min_by("media", first).alias("media"),
        F.min_by("ext", first).alias("ext"),
        F.min_by("initiator", first).alias("initiator"),
        F.min_by(known, F.when(known.isNotNull(), first)).alias("size"),
        F.coalesce(F.min_by(named, F.when(named.isNotNull(), first)), F.lit("")).alias("mime"),
        F.max_by("url", F.when(fresh, last)).alias("url"),
        F.count(F.lit(1)).alias("sightings"),
    )


def without_rejected(items: DataFrame, rejected: DataFrame) -> DataFrame:
    return items.join(rejected, ["tab_id", "key"], "left_anti")


def last_rows(rows: DataFrame, keys: list[str], order: list[str], n: int) -> DataFrame:
    """The last n rows of each key (the ring buffers: log 80, rejected 100, children 500)."""
    w = Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order])
    return rows.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= n).drop("__n")


def capped(items: DataFrame, n: int = K.MAX_ITEMS) -> DataFrame:
    """At most n items per tab: visible ones before hidden, streams before files, newer before older."""
    w = Window.partitionBy("tab_id").orderBy(F.col("hidden").asc(), (F.col("kind") == "file").asc(), F.desc("seen"), "key")
    return items.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def since_navigation(items: DataFrame, navigations: DataFrame) -> DataFrame:
    """Items seen since the tab's last navigation began; tabs that never navigated keep all."""
    last = navigations.groupBy("tab_id").agg(F.max("seen").alias("nav"))
    return items.join(last, "tab_id", "left").where(F.col("nav").isNull() | (F.col("seen") >= F.col("nav"))).drop("nav")


def hide_children(items: DataFrame, children: DataFrame) -> DataFrame:
    """hidden: the item's key is a child of a manifest other than itself. `children` has tab_id, key, parent."""
    marks = children.join(items.select("tab_id", F.col("key").alias("parent")), ["tab_id", "parent"], "left_semi").where("key <> parent").select("tab_id", "key").distinct().withColumn("__hidden", F.lit(True))
    return items.join(marks, ["tab_id", "key"], "left").withColumn("hidden", F.coalesce("__hidden", F.lit(False))).drop("__hidden")


def _rank() -> Column:
    return F.create_map(*[F.lit(x) for pair in K.SOURCE_RANK.items() for x in pair])[F.col("source")]


def best_source(found: DataFrame) -> DataFrame:
    """Per tab and URL the most trusted source; of equal rank the first found."""
    return found.groupBy("tab_id", "url").agg(F.max_by("source", F.struct(_rank(), -F.col("event_id"))).alias("source"))


def report_changes(events: DataFrame, keys: list[str], order: list[str], signature: Column) -> DataFrame:
    """Events whose signature differs from the one before of the same key."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return events.withColumn("__s", signature).withColumn("__p", F.lag("__s").over(w)).where(~F.col("__s").eqNullSafe(F.col("__p"))).drop("__s", "__p")


def flags(reports: DataFrame) -> DataFrame:
    return reports.groupBy("tab_id").agg(F.bool_or("drm").alias("drm"), F.bool_or("blob").alias("blob"), F.max("videos").alias("videos"))


def ordered_for_popup(items: DataFrame) -> DataFrame:
    """Place in the list: what can be downloaded first, newest first."""
    w = Window.partitionBy("tab_id").orderBy(F.desc("downloadable"), F.desc("seen"), "key")
    return items.withColumn("place", F.row_number().over(w))


def badge_count(items: DataFrame, as_of: Column) -> DataFrame:
    return items.groupBy("tab_id").agg(F.count_if(C.is_visible(F.col("hidden"), F.col("pending"), F.col("seen"), as_of)).alias("badge"))


def fresh_jobs(jobs: DataFrame, as_of: Column) -> DataFrame:
    return jobs.where(F.col("created") >= as_of - F.expr(f"INTERVAL {K.JOB_MINUTES} MINUTES"))


def diagnostics(items: DataFrame) -> DataFrame:
    """What may be shown to others: no query strings, no titles."""
    return items.select("tab_id", U.hash_string(F.col("key")).alias("id"), "key", "kind", "media", "mime", "ext", "size", U.safe_url(F.col("url")).alias("url"), U.host_of(F.col("initiator")).alias("page_host"))


#: References of pages that are sent on together.
_ROWS = 20_000


def _page_urls(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """URLs that pages (page_id, url, html) name, by their place. A page is read and its references are resolved in the same pass, so that a task has one worker of Python, and none that loads pandas."""
    from reelgrid.functions.weburl import absolute, behind

    def batch_of(ids: pa.Array, rows: list[tuple]) -> pa.RecordBatch:
        of, at, source, url = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays([ids.take(pa.array(of, pa.int64())), pa.array(at, pa.int32()), pa.array(source, pa.string()), pa.array(url, pa.string())], names=["tab_id", "at", "source", "url"])

    for batch in batches:
        rows = []
        for i in range(batch.num_rows):
            named_base, named = page_references(batch.column(2)[i].as_py() or "")
            own = absolute(batch.column(1)[i].as_py())
            other = behind(named_base, own)
            base = own if other is None else other.partition("#")[0]
            named = [(source, reference) for source, reference in named if not (source == "element" and reference.startswith("blob:"))]
            rows += [(i, at, source, url) for at, (source, reference) in enumerate(named) if (url := behind(reference, base)) is not None]
            if len(rows) >= _ROWS:
                yield batch_of(batch.column(0), rows)
                rows = []
        if rows:
            yield batch_of(batch.column(0), rows)


def page_media(pages: DataFrame, entries: DataFrame | None = None, limit: int = 60, links: int = 20) -> DataFrame:
    """Media URLs of stored pages: what elements play, what was requested (`entries`: page_id, name), links and a player's meta tag.

    Pages are scanned as HTML, tag by tag: comments, scripts and other raw text name nothing, references of characters are decoded, `source`
    counts inside `video` and `audio`, and a base element counts. Of each URL the most trusted source counts; at most `links` links and `limit`
    URLs a page, in the order found. Links and requests count by their path's extension; element sources and the meta tag whatever they name. A blob
    source is no URL. Pages come one row each.
    """

    kind = pages.schema["page_id"].dataType.simpleString()
    each = pages.select("page_id", "url", "html").mapInArrow(_page_urls, f"tab_id {kind}, at int, source string, url string")
    media = lambda u: F.regexp_replace(u, "[?#].*", "").rlike(K.MEDIA_PATH)
    each = each.where((F.col("source") != "link") | media(F.col("url")))
    by = Window.partitionBy("tab_id", "source").orderBy("at")
    each = each.withColumn("n", F.row_number().over(by)).where((F.col("source") != "link") | (F.col("n") <= links))
    step = F.when(F.col("source") == "element", 0).when(F.col("source") == "link", 2).otherwise(3)
    each = each.select("tab_id", "source", "url", (step.cast("bigint") * (1 << 40) + F.col("at")).alias("event_id"))
    if entries is not None:
        timed = entries.where(media(F.col("name"))).select(F.col("page_id").alias("tab_id"), F.lit("timing").alias("source"), F.col("name").alias("url"), (F.coalesce(F.col("place"), F.lit(0)).cast("bigint") + F.lit(1 << 40)).alias("event_id"))
        each = each.unionByName(timed)
    best = each.groupBy("tab_id", "url").agg(F.max_by("source", F.struct(_rank(), -F.col("event_id"))).alias("source"), F.min("event_id").alias("first"))
    w = Window.partitionBy("tab_id").orderBy("first", "url")
    return best.withColumn("n", F.row_number().over(w)).where(F.col("n") <= limit).select(F.col("tab_id").alias("page_id"), F.col("url").alias("media_url"), "source", (F.col("n") - 1).alias("place"))


def decisions(found: DataFrame, probe_counts: DataFrame | None = None) -> DataFrame:
    """What is to be done with each candidate (tab_id, url, kind, source, via, size, initiator), as columns: fetchable, from_player, listed, probe.

    `probe_counts` (tab_id, probes) tells how many probes a tab has spent; over its budget, requests of a player are not listed and nothing is probed.
    """
    rows = found if probe_counts is None else found.join(probe_counts, "tab_id", "left")
    over = F.lit(False) if probe_counts is None else F.coalesce(F.col("probes") >= K.MAX_PROBES, F.lit(False))
    fetchable = F.coalesce(C.fetchable(F.col("source"), F.col("url"), F.col("initiator")), F.lit(False))
    player = F.coalesce(F.col("via").isin("xmlhttprequest", "other"), F.lit(False))
    rows = rows.withColumn("fetchable", fetchable).withColumn("from_player", player).withColumn("over", over)
    file = F.col("kind") == "file"
    out = rows.withColumn("listed", ~(file & F.col("from_player") & F.col("over"))).withColumn("probe", file & (F.col("size").isNull() | F.col("from_player")) & F.col("fetchable") & ~F.col("over"))
    return out.drop("over", "probes")


def probed(items: DataFrame, probes: DataFrame) -> DataFrame:
    """Items after verification. `probes` has tab_id, key and probe (from `probe_result`; null where the file could not be reached, which keeps the item).

    listed is false for what turned out to be no media, a fragment or too small; others take the size and the type they lacked.
    """
    joined = items.join(probes, ["tab_id", "key"], "left")
    p = F.col("probe")
    listed = F.col("probe").isNull() | C.verified(p)
    size, mime = F.coalesce("size", p["size"]), F.coalesce(F.nullif(F.col("mime"), F.lit("")), p["mime"], F.lit(""))
    return joined.withColumn("listed", listed).withColumn("size", F.when(F.col("listed"), size).otherwise(F.col("size"))).withColumn("mime", F.when(F.col("listed"), mime).otherwise(F.col("mime"))).drop("probe")
