"""Bytes of ISO base media files (ISO/IEC 14496-12) and transport streams (ISO/IEC 13818-1), as Arrow-batched functions over binary columns.

A file is read into one flat index of its boxes by path; what merging and rewriting change are 32-bit fields, whose places
the standard gives by box and version. A transport stream is read as a table of packets with numpy.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from reelgrid.constants import REMUXABLE_STREAM_TYPES, SAYS

BOXES = "struct<boxes:array<struct<type:string,start:bigint,end:bigint,payload:bigint>>,error:string>"
INIT = "struct<tracks:array<bigint>,defaults:array<bigint>,next_track:bigint,error:string>"
STREAMS = "array<struct<type:int,pid:int>>"

#: Boxes that hold boxes, as far as they are opened.
NESTING = ("moov", "trak", "mvex", "moof", "traf")
#: Places of 32-bit fields in a box's payload, in versions 0 and 1.
FIELDS = {"mvhd": (96, 108), "tkhd": (12, 20), "trex": (4, 4), "mfhd": (4, 4), "tfhd": (4, 4)}
PACKET = 188


class Box(NamedTuple):
    path: str
    start: int
    body: int
    end: int


def boxes(data: bytes, nested: bool = True) -> list[Box]:
    """All boxes in file order, nested ones by path ('moov/trak/tkhd') after the one that holds them."""
    found, spans = [], [("", 0, len(data))]
    while spans:
        above, at, stop = spans.pop()
        if stop - at < 8:  # too little for a header: left alone
            continue
        size, kind = int.from_bytes(data[at : at + 4], "big"), data[at + 4 : at + 8].decode("latin-1")
        body = at + (16 if size == 1 else 8)
        if body > stop:
            raise ValueError(f'Truncated MP4 box "{kind}"')
        end = stop if size == 0 else at + (int.from_bytes(data[at + 8 : body], "big") if size == 1 else size)
        if not body <= end <= stop:
            raise ValueError(f'Corrupt MP4 box "{kind}"')
        found.append(Box(above + kind, at, body, end))
        spans.append((above, end, stop))
        if nested and kind in NESTING:
            spans.append((f"{above}{kind}/", body, end))
    return found


def field(data: bytes, box: Box) -> int:
    """Place of the box's field of FIELDS."""
    at = box.body + FIELDS[box.path.rsplit("/", 1)[-1]][data[box.body] == 1]
    if at + 4 > box.end:
        raise ValueError(f'Corrupt MP4 box "{box.path.rsplit("/", 1)[-1]}"')
    return at


def number(data: bytes, at: int) -> int:
    return int.from_bytes(data[at : at + 4], "big")


def patched(data: bytes, box: Box, values: dict[int, int]) -> bytes:
    """The bytes of a box with other numbers at some places (of the file)."""
    out = bytearray(data[box.start : box.end])
    for at, value in values.items():
        struct.pack_into(">I", out, at - box.start, value)
    return bytes(out)


def wrapped(kind: str, *parts: bytes) -> bytes:
    """A box of the given parts."""
    return (8 + sum(map(len, parts))).to_bytes(4, "big") + kind.encode("latin-1") + b"".join(parts)


class Init:
    """An initialisation segment: its boxes, the places of its track ids, and the ids."""

    def __init__(self, data: bytes):
        self.data, self.index = data, boxes(data)
        if not self.at("moov"):
            raise ValueError(SAYS["no_moov"])
        if not self.at("moov/mvex"):
            raise ValueError(SAYS["no_mvex"])
        self.heads = [field(data, b) for b in self.at("moov/trak/tkhd")]
        self.defaults = [field(data, b) for b in self.at("moov/mvex/trex")]
        if not self.at("moov/mvhd") or len(self.heads) != len(self.at("moov/trak")):
            raise ValueError('Corrupt MP4 box "moov"')
        self.tracks = [number(data, p) for p in self.heads]

    def at(self, path: str) -> list[Box]:
        return [b for b in self.index if b.path == path]

    def parts(self, ids: dict[int, int]) -> tuple[list[bytes], list[bytes]]:
        """Track boxes and track defaults with other ids."""
        sides = []
        for path, places in (("moov/trak", self.heads), ("moov/mvex/trex", self.defaults)):
            sides.append([patched(self.data, b, {p: ids.get(number(self.data, p), number(self.data, p))}) for b, p in zip(self.at(path), places, strict=True)])
        return sides[0], sides[1]


def merged_init(video: bytes, audio: bytes) -> tuple[bytes, dict[int, int]]:
    """One initialisation segment for both streams, and the audio stream's track ids in it: those that video has too are numbered on."""
    v, a = Init(video), Init(audio)
    free = max([0, *v.tracks])
    ids: dict[int, int] = {}
    for old in a.tracks:
        if old in v.tracks or old in ids.values():
            free = max([free, *ids.values()]) + 1
            ids[old] = free
        else:
            ids[old] = old
    (tracks, defaults), (more_tracks, more_defaults) = v.parts({}), a.parts(ids)
    movie = v.at("moov/mvhd")[0]
    head = patched(video, movie, {field(video, movie): max([0, *v.tracks, *ids.values()]) + 1})
    brand = b"".join(video[b.start : b.end] for b in v.at("ftyp")[:1])
    return brand + wrapped("moov", head, *tracks, *more_tracks, wrapped("mvex", *defaults, *more_defaults)), ids


def renumbered(data: bytes, ids: dict[int, int], sequence: int) -> bytes:
    """A media segment's fragments alone: movie fragments numbered from `sequence`, track ids replaced, and media data."""
    out, values, open_ = [], {}, None
    for b in [*boxes(data), Box("", len(data), len(data), len(data))]:
        if open_ is not None and "/" not in b.path:
            out.append(patched(data, open_, values))
            open_, values = None, {}
        if b.path == "mdat":
            out.append(data[b.start : b.end])
        elif b.path == "moof":
            open_, first = b, True
            sequence += 1
        elif b.path == "moof/mfhd" and first:
            values[field(data, b)], first = sequence - 1, False
        elif b.path == "moof/traf/tfhd":
            if number(data, b.body) & 1:  # base-data-offset-present
                raise ValueError(SAYS["offset"])
            at = field(data, b)
            values[at] = ids.get(number(data, at), number(data, at))
    return b"".join(out)


def _sections(packets: np.ndarray, pid: int, start: int) -> Iterator[tuple[int, bytes]]:
    """Whole sections (tables of program information) of a packet id from packet `start` on, each with the packet that ends it."""
    pids = (packets[:, 1].astype(int) & 0x1F) << 8 | packets[:, 2]
    pending: bytes | None = None
    for row in np.flatnonzero((pids[start:] == pid) & (packets[start:, 3] & 0x10 > 0)) + start:
        packet = packets[row].tobytes()
        at = 4 + (1 + packet[4] if packet[3] & 0x20 else 0)
        body = packet[at:]
        if packet[1] & 0x40:  # a section starts after the pointer
            body = body[1 + body[0] :] if body else b""
            pending = body
        elif pending is not None:
            pending += body
        while pending and len(pending) >= 3 and pending[0] != 0xFF and len(pending) >= (size := 3 + (int.from_bytes(pending[1:3], "big") & 0xFFF)):
            yield int(row), pending[:size]
            pending = pending[size:]
        if not pending or pending[0] == 0xFF:  # stuffing
            pending = None


def program_streams(data: bytes) -> list[dict] | None:
    """Elementary streams (type, pid) of the first program of a transport stream; null where it is none."""
    packets = np.frombuffer(data, np.uint8, len(data) // PACKET * PACKET).reshape(-1, PACKET)
    bad = np.flatnonzero(packets[:, 0] != 0x47)
    packets = packets[: bad[0]] if len(bad) else packets
    for row, table in _sections(packets, 0, 0):
        entries = np.frombuffer(table[8:-4][: (len(table) - 12) // 4 * 4], ">u2").reshape(-1, 2)
        programs = entries[entries[:, 0] > 0]
        if table[0] != 0 or not len(programs):
            continue
        for _, section in _sections(packets, int(programs[0, 1]) & 0x1FFF, row):
            if section[0] != 2 or len(section) < 16:
                continue
            rest, found = section[12 + (int.from_bytes(section[10:12], "big") & 0xFFF) : -4], []
            while len(rest) >= 5:
                kind, pid, more = struct.unpack(">BHH", rest[:5])
                found.append({"type": kind, "pid": pid & 0x1FFF})
                rest = rest[5 + (more & 0xFFF) :]
            return found
        return None
    return None


def _each(kind: str, function, *columns: Column) -> Column:
    @F.pandas_udf(kind)
    def run(*series):
        import pandas as pd

        rows = [None if any(x is None for x in row) else function(*row) for row in zip(*series, strict=True)]
        return pd.DataFrame([r or {} for r in rows]) if kind.startswith("struct") else pd.Series(rows, dtype=object)

    return run(*columns)


def read_boxes(data: Column) -> Column:
    """Top-level boxes, or the error that ends them."""

    def one(raw):
        try:
            return {"boxes": [{"type": b.path, "start": b.start, "end": b.end, "payload": b.body} for b in boxes(bytes(raw), nested=False)], "error": None}
        except ValueError as problem:
            return {"boxes": None, "error": str(problem)}

    return _each(BOXES, one, data)


def parse_init(data: Column) -> Column:
    """Track ids of an initialisation segment, those of its track defaults and its next track id, or an error."""

    def one(raw):
        try:
            x = Init(bytes(raw))
            return {"tracks": x.tracks, "defaults": [number(x.data, p) for p in x.defaults], "next_track": number(x.data, field(x.data, x.at("moov/mvhd")[0])), "error": None}
        except ValueError as problem:
            return {"tracks": None, "defaults": None, "next_track": None, "error": str(problem)}

    return _each(INIT, one, data)


def read_ts_streams(data: Column) -> Column:
    return _each(STREAMS, lambda raw: program_streams(bytes(raw)), data)


def merge_init(video: Column, audio: Column) -> Column:
    """The merged initialisation segment and the audio track ids, or an error."""

    def one(v, a):
        try:
            merged, ids = merged_init(bytes(v), bytes(a))
            return {"init": merged, "tracks": [{"old": k, "new": n} for k, n in ids.items()], "error": None}
        except ValueError as problem:
            return {"init": None, "tracks": None, "error": str(problem)}

    return _each("struct<init:binary,tracks:array<struct<old:bigint,new:bigint>>,error:string>", one, video, audio)


def count_moof(data: Column) -> Column:
    """Movie fragments at the top level; null where the boxes are corrupt."""

    def one(raw):
        try:
            return sum(b.path == "moof" for b in boxes(bytes(raw), nested=False))
        except ValueError:
            return None

    return _each("bigint", one, data)


def rewrite_segment(data: Column, tracks: Column, sequence: Column) -> Column:
    """The rewritten segment or an error. `tracks` is an array of (old, new); `sequence` the first number, a running sum of the moof counts before."""

    def one(raw, listed, first):
        try:
            return {"data": renumbered(bytes(raw), {x["old"]: x["new"] for x in listed}, int(first)), "error": None}
        except ValueError as problem:
            return {"data": None, "error": str(problem)}

    return _each("struct<data:binary,error:string>", one, data, tracks, sequence)


def all_remuxable(streams: Column) -> Column:
    return F.forall(streams, lambda s: s["type"].isin(*REMUXABLE_STREAM_TYPES))
