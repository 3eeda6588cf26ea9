"""Tags of HTML and of XML: scanners of one pass that know quotes, comments, raw text and character references."""

from __future__ import annotations

import re
from collections.abc import Iterator

#: Elements whose content is text up to their own end tag (scripts run, so `noscript` is one), and those that never have content.
RAW = {"script", "style", "xmp", "iframe", "noembed", "noframes", "noscript", "textarea", "title"}

_NAME = re.compile(r"[A-Za-z][^\t\n\f\r />]*")
# An attribute: anything but blanks, slashes and ">" up to "=", then a quoted or bare value.
_ATTRIBUTE = re.compile(r"""[\t\n\f\r /]*(?:([^\t\n\f\r />][^\t\n\f\r />=]*)(?:[\t\n\f\r ]*=[\t\n\f\r ]*(?:"([^"]*)"|'([^']*)'|([^\t\n\f\r >"'][^\t\n\f\r >]*)|(?=>)))?)?""")
_COMMENT_END = re.compile("--!?>")
_REFERENCE = re.compile("&(?:#[xX]([0-9A-Fa-f]+)|#([0-9]+)|([A-Za-z][A-Za-z0-9]*));?")


def decoded(text: str) -> str:
    """Character references of an attribute's value. A name without semicolon before "=", a letter or a digit is no reference."""
    from html import unescape
    from html.entities import html5

    def one(m: re.Match) -> str:
        if m[3] is None:
            return unescape(m[0] if m[0].endswith(";") else m[0] + ";")
        if m[0].endswith(";") and m[3] + ";" in html5:
            return html5[m[3] + ";"]
        for end in range(len(m[3]), 1, -1):
            name, rest = m[3][:end], m[3][end:]
            if name in html5:
                follows = rest[:1] or (";" if m[0].endswith(";") else text[m.end() : m.end() + 1])
                return m[0] if follows == "=" or (follows.isalnum() and follows.isascii()) else html5[name] + m[0][1 + end :]
        return m[0]

    return _REFERENCE.sub(one, text) if "&" in text else text


def html_tags(text: str) -> Iterator[tuple[str, dict[str, str] | None]]:
    """Start tags (name, attributes) and end tags (name, None) in order; of an attribute that comes twice the first counts.

    Comments, declarations and raw text hold no tags; a tag that the text ends in is none.
    """
    at, n = 0, len(text)
    while (at := text.find("<", at)) >= 0:
        if text.startswith("<!--", at):
            body = at + 4
            if m := re.compile("-?>").match(text, body):  # <!--> and <!---> end at once
                at = m.end()
            else:
                m = _COMMENT_END.search(text, body)
                at = m.end() if m else n
            continue
        ending = text.startswith("/", at + 1)
        name = _NAME.match(text, at + 1 + ending)
        if name is None:
            at = text.find(">", at) if ending or text[at + 1 : at + 2] in ("!", "?") else at
            if at < 0:
                return
            at += 1
            continue
        tag, at, found = name[0].lower(), name.end(), {}
        while at < n and text[at] != ">":
            m = _ATTRIBUTE.match(text, at)
            if m.end() == at:  # a quote that is never closed
                return
            at = m.end()
            if m[1] is not None:
                found.setdefault(m[1].lower(), decoded(next((x for x in m.groups()[1:] if x is not None), "")))
                if text[at : at + 1] == "=" or (text[at - 1 : at] == "=" and text[at : at + 1] in "\"'"):
                    return
        if at >= n:
            return
        at += 1
        yield (tag, None) if ending else (tag, found)
        if not ending and tag == "plaintext":
            return
        if not ending and tag in RAW:
            close = re.compile(rf"(?i)</{tag}(?=[\t\n\f\r />])").search(text, at)
            at = close.start() if close else n


def page_references(text: str) -> tuple[str | None, list[tuple[str, str]]]:
    """A page's base reference (or None), and what it names: sources of its media elements in order, then links, then the player's meta tag.

    `source` counts inside `video` and `audio` alone; contents of `template` are no part of the page.
    """
    base, templates, media, elements, links, meta = None, 0, [], [], [], None
    for tag, found in html_tags(text):
        if tag == "template":
            templates = max(0, templates + (1 if found is not None else -1))
        elif templates:
            continue
        elif tag in ("video", "audio"):
            if found is not None:
                media.append((tag, own := []))
                elements.append(own)
                own.append(found.get("src"))
            else:
                for k in range(len(media) - 1, -1, -1):
                    if media[k][0] == tag:
                        del media[k:]
                        break
        elif found is None:
            continue
        elif tag == "source":
            for _, own in media:
                own.append(found.get("src"))
        elif tag == "a" and "href" in found:
            links.append(("link", found["href"]))
        elif tag == "base" and "href" in found and base is None:
            base = found["href"]
        elif tag == "meta" and meta is None and found.get("name") == "twitter:player:stream":
            meta = ("meta", found.get("content", ""))
    named = [("element", src) for own in elements for src in own if src]
    return base, named + links + ([meta] if meta and meta[1] else [])


# XML

_TAG = re.compile(r"""(?s)<(?:!--.*?--()>|!\[CDATA\[(.*?)\]\](?P<cdata>)>|\?.*?\?()>|(?P<doctype>!)[^>]*>|/(?P<end>[^>]*)>|(?P<start>(?:[^>"']++|"[^"]*+"|'[^']*+')*+)>)""")
_PAIR = re.compile(r"""([^=\s]+)\s*=\s*(?:"([^"]*)"|'([^']*)')|[^=\s]+(?:\s*=)?|=""")
_PREDEFINED = {"amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'"}
_ENTITY = re.compile("&(?:#x([0-9a-fA-F]+)|#([0-9]+)|([A-Za-z]+));")


class XmlError(ValueError):
    pass


def xml_decoded(text: str) -> str:
    """The five predefined entities and numeric references; all else stays as it is written."""

    def one(m: re.Match) -> str:
        if m[3]:
            return _PREDEFINED.get(m[3], m[0])
        code = int(m[1], 16) if m[1] else int(m[2])
        return chr(code) if 0 < code <= 0x10FFFF and not 0xD800 <= code <= 0xDFFF else m[0]

    return _ENTITY.sub(one, text) if "&" in text else text


def _local(name: str) -> str:
    return name.partition(":")[2] if ":" in name else name


def xml_events(text: str, says: dict[str, str], *, deep: int = 64, many: int = 200_000) -> Iterator[tuple[str, str, dict[str, str] | None]]:
    """("start", name, attributes), ("text", text, None) and ("end", name, None) of a document, in one pass; namespace prefixes are dropped.

    Raises XmlError with a sentence of `says` (malformed, doctype, deep, elements) where the document is broken or over a bound.
    """
    at, stack, count, rooted = 0, [], 0, False
    text = text.removeprefix("﻿")
    while at < len(text):
        low = text.find("<", at)
        between = text[at : low if low >= 0 else len(text)]
        if between.strip():
            if not stack:
                raise XmlError(says["malformed"])
            yield "text", xml_decoded(between), None
        if low < 0:
            break
        m = _TAG.match(text, low)
        opening = text[low + 1 : low + 2]
        if m is None or (opening == "!" and m["doctype"] is not None and text.startswith(("<!--", "<![CDATA["), low)):
            raise XmlError(says["doctype"] if opening == "!" and not text.startswith(("<!--", "<![CDATA["), low) else says["malformed"])
        at = m.end()
        if m["doctype"] is not None:
            if "[" in m[0]:
                raise XmlError(says["doctype"])
        elif m["cdata"] is not None:
            if not stack:
                raise XmlError(says["malformed"])
            yield "text", m[2], None
        elif m["end"] is not None:
            name = _local(m["end"].strip())
            if not stack or stack.pop() != name:
                raise XmlError(says["malformed"])
            yield "end", name, None
        elif m["start"] is not None:
            inner = m["start"]
            empty = inner.endswith("/")
            head = re.match(r"[^\s/>]+", inner)
            if head is None or (not stack and rooted):
                raise XmlError(says["malformed"])
            name, found = _local(head[0]), {}
            for pair in _PAIR.finditer(inner[head.end() : len(inner) - empty]):
                if pair[1] and pair[1] != "xmlns" and not pair[1].startswith("xmlns:"):
                    found[_local(pair[1])] = xml_decoded(pair[2] if pair[2] is not None else pair[3])
            count, rooted = count + 1, True
            if count > many:
                raise XmlError(says["elements"])
            yield "start", name, found
            if empty:
                yield "end", name, None
            else:
                if len(stack) >= deep:
                    raise XmlError(says["deep"])
                stack.append(name)
    if stack or not rooted:
        raise XmlError(says["malformed"])
