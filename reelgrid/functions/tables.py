"""Table functions by name, for LATERAL joins in SQL: boxes and tracks of MP4 files, streams of transport streams, tags of pages.

    register(spark)
    spark.sql("SELECT f.path, b.* FROM files f, LATERAL mp4_boxes(f.body) b")
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf


class Mp4Boxes:
    """A row for each box, nested ones behind the one that holds them; a broken file gives one row with its error."""

    def eval(self, body: bytes) -> Iterator[tuple]:
        from reelgrid.functions.binary import boxes

        if body is None:
            return
        try:
            for b in boxes(bytes(body)):
                yield b.path, b.path.count("/"), b.start, b.end, b.body, None
        except ValueError as e:
            yield None, None, None, None, None, str(e)


class TsStreams:
    """A row for each elementary stream that the program map of a transport stream lists; nothing where there is none."""

    def eval(self, body: bytes) -> Iterator[tuple]:
        from reelgrid.constants import STREAM_TYPES
        from reelgrid.functions.binary import program_streams

        for s in (body is not None and program_streams(bytes(body))) or ():
            label, kind = STREAM_TYPES.get(s["type"], (f"stream type 0x{s['type']:x}", "other"))
            yield s["pid"], s["type"], label, kind


class HtmlTags:
    """A row for each start tag of a page with its attributes; comments, scripts and other raw text have none."""

    def eval(self, html: str) -> Iterator[tuple]:
        from reelgrid.functions.markup import html_tags

        for k, (name, found) in enumerate(t for t in html_tags(html or "") if t[1] is not None):
            yield k, name, found


#: Name, function, and the columns that it gives.
FUNCTIONS = {
    "mp4_boxes": (Mp4Boxes, "path: string, depth: int, start: bigint, end: bigint, payload: bigint, error: string"),
    "ts_streams": (TsStreams, "pid: int, type: int, label: string, kind: string"),
    "html_tags": (HtmlTags, "n: int, name: string, attributes: map<string,string>"),
}


def register(spark: SparkSession) -> None:
    """Make the functions known to the session by name; rows go to and from Python in Arrow batches."""
    for name, (handler, columns) in FUNCTIONS.items():
        spark.udtf.register(name, udtf(handler, returnType=columns, useArrow=True))
