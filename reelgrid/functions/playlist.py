"""Lines of one HLS playlist: read once, in Arrow batches. Playlists are bounded in characters and lines."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa

from reelgrid import constants as K
from reelgrid.functions.weburl import absolute, behind

#: What Unicode calls white space, which is trimmed from lines.
_BLANK = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
_BREAK = re.compile(r"\r?\n")
#: A line that names what is to be fetched by a scheme other than http(s); "." as Java has it.
_FOREIGN = re.compile(r"""(?:#EXT-X-(?:MAP|MEDIA):(?:|[^\n\r\x85\u2028\u2029]*,)URI="|(?=[^#]))(?!(?i:https?):)([A-Za-z][A-Za-z0-9+.-]*:)""", re.ASCII)
_NAMING = ("#EXT-X-MAP:", "#EXT-X-MEDIA:")
_PAIR = re.compile(r'(?:^|,)([^=,]*+)=(?:"([^"]*+)"?+[^,]*+|([^,"][^,]*+|(?=,)|\Z))')
_NAME = re.compile(r"[A-Z0-9-]{1,64}")
_NUMBER = re.compile(r"[0-9]+(?:\.[0-9]+)?")
_WHOLE = re.compile(r"[+-]?[0-9]+")
_IV = re.compile(r"[0-9A-Fa-f]{1,32}")
#: What a cast to a whole number trims.
_EDGE = "".join(map(chr, [*range(0x21), 0x7F]))
_TOP = 2**63


def split(text: str | None) -> tuple[str | None, str | None, str | None]:
    """Kind (master or media), lines that are not blank, with a line feed between them, and error (then neither)."""
    lines = None
    if text is not None and len(text) <= K.MAX_MANIFEST_CHARS:
        lines = [x for x in (line.strip(_BLANK) for line in _BREAK.split(text.removeprefix("\ufeff"))) if x]
    if lines is None or len(lines) > K.MAX_LINES:
        return None, None, K.SAYS["playlist_large"]
    if not lines or not lines[0].startswith("#EXTM3U"):
        return None, None, K.SAYS["playlist"]
    for line in lines:
        if ":" in line and (line[0] != "#" or line.startswith(_NAMING)) and (found := _FOREIGN.match(line)):
            return None, None, K.SAYS["playlist_scheme"].replace("{scheme}", found[1].lower())
    return "master" if any(x.startswith("#EXT-X-STREAM-INF") for x in lines) else "media", "\n".join(lines), None


def attributes(text: str) -> dict[str, str]:
    """The last value of each attribute."""
    pairs = ((m[1].strip(" ").upper(), (m[2] or "") + (m[3] or "")) for m in _PAIR.finditer(text))
    return {name: value for name, value in pairs if _NAME.fullmatch(name)}


def _number(text: str) -> float:
    found = _NUMBER.match(text.strip(" "))
    return float(found[0]) if found else 0.0


def _whole(text: str) -> int | None:
    if len(text) < 19 and text.isdigit() and text.isascii():
        return int(text)
    text = text.strip(_EDGE)
    value = int(text) if len(text) < 21 and _WHOLE.fullmatch(text) else None
    return value if value is not None and -_TOP <= value < _TOP else None


def _byte_range(text: str) -> tuple[int, int | None] | None:
    """'length[@offset]' as length and offset."""
    parts = text.split("@")
    size = _whole(parts[0])
    return None if size is None else (size, _whole(parts[1]) if len(parts) > 1 else None)


def _iv(text: str) -> bytes | None:
    digits = text[2:] if text[:2] in ("0x", "0X") else text
    return bytes.fromhex(digits.rjust(32, "0")) if _IV.fullmatch(digits) else None


#: A key: method, url, iv, key_format.
Key = tuple[str, str | None, bytes | None, str]


def _order(key: Key) -> tuple:
    return key[0].encode(), key[1] is not None, (key[1] or "").encode(), key[2] is not None, key[2] or b"", key[3].encode()


def segments(lines: list[str], base: str | None) -> Iterator[tuple]:
    """Of a media playlist, for each segment: sequence, url, duration, range_offset, range_length, key, drm (keys), map (url, range, key, drm), discontinuity and the time before it."""
    first, index = 0, 0
    key: Key | None = None
    others: dict[str, Key] = {}
    drm: tuple[Key, ...] = ()
    found_map = None
    ends: dict[str | None, int] = {}  # where the last range of each URL ended
    duration, span, broken, clock = 0.0, None, False, 0.0
    for line in lines:
        if line[:1] != "#":
            url = behind(line, base)
            offset = size = None
            if span is not None:
                size, offset = span
                if offset is None:
                    offset = ends.get(url, 0)
                ends[url] = offset + size
                offset = offset if -_TOP <= offset < _TOP else None
            yield min(first + index, _TOP - 1), url, duration, offset, size, key, drm, found_map, broken, clock
            index += 1
            clock += duration
            duration, span, broken = 0.0, None, False
        elif line.startswith("#EXTINF:"):
            duration = _number(line[8:])
        elif line.startswith("#EXT-X-BYTERANGE:"):
            span = _byte_range(line[17:])
        elif line == "#EXT-X-DISCONTINUITY":
            broken = True
        elif line.startswith("#EXT-X-MEDIA-SEQUENCE:"):
            first = int(min(_number(line[22:]), float(_TOP)))
        elif line.startswith("#EXT-X-KEY:"):
            a = attributes(line[11:])
            kind, uri, method = a.get("KEYFORMAT") or "identity", a.get("URI") or None, a.get("METHOD", "")
            if kind == "identity":
                key = None if method == "NONE" else (method, behind(uri, base), _iv(a.get("IV", "")), kind)
            else:
                others.pop(kind, None)
                if method != "NONE":
                    others[kind] = (method, uri, _iv(a.get("IV", "")), kind)
                drm = tuple(sorted(others.values(), key=_order))
        elif line.startswith("#EXT-X-MAP:"):
            a = attributes(line[11:])
            found_map = None
            if uri := a.get("URI"):
                part = _byte_range(a.get("BYTERANGE", ""))
                found_map = behind(uri, base), None if part is None else (part[1] or 0, part[0]), key, drm


def placed(lines: list[str], base: str | None) -> Iterator[tuple[int | None, tuple]]:
    """The same with its place, and behind the rest whether the playlist is live (has no end tag); where there are no segments, that alone."""
    live, place = "#EXT-X-ENDLIST" not in lines, None
    for place, row in enumerate(segments(lines, base)):
        yield place, (*row, live)
    if place is None:
        yield None, (*[None] * 10, live)


CHILDREN = "error string, children array<string>"


def children(lines: list[str], base: str | None) -> list[str]:
    """URLs of a master playlist's variants and then of its renditions, at most MAX_CHILD_URLS."""
    held = [x for x in lines if x[:1] != "#" or x.startswith("#EXT-X-STREAM-INF:")]
    variants = [x for before, x in zip(["", *held], held, strict=False) if x[:1] != "#" and before[:1] == "#"]  # a URI is one where the line held before it is a stream tag
    renditions = [uri for x in lines if x.startswith("#EXT-X-MEDIA:") and (uri := attributes(x[13:]).get("URI"))]
    return [url for x in variants + renditions if (url := behind(x, base)) is not None][: K.MAX_CHILD_URLS]


def read_children(texts: pa.Array, urls: pa.Array) -> pa.Array:
    """Of each playlist its error, or the children of a master (null for others), read once."""
    rows = []
    for text, url in zip(texts.to_pylist(), urls.to_pylist(), strict=True):
        kind, lines, error = split(text)
        rows.append({"error": error, "children": children(lines.split("\n"), absolute(url)) if kind == "master" else None})
    return pa.array(rows, pa.struct([("error", pa.string()), ("children", pa.list_(pa.string()))]))
