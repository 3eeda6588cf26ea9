"""URLs of the web as the URL standard reads and writes them: for references that column functions can't settle."""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass, replace
from functools import lru_cache

PORTS = {"http": "80", "https": "443"}
_EDGE = "".join(map(chr, range(0x21)))
_SCHEME = re.compile(r"([A-Za-z][A-Za-z0-9+.\-]*):")
_ONE, _TWO = re.compile(r"(?i)(?:\.|%2e)\Z"), re.compile(r"(?i)(?:\.|%2e){2}\Z")
_BAD_HOST = re.compile("[\x00-\x20#%/:<>?@\\[\\\\\\]^|\x7f]")
#: Characters that vanish from host names.
_IGNORED = dict.fromkeys([0xAD, 0x200B, 0x2060, 0xFEFF])

# Percent-encode sets of the standard, beside controls and what lies beyond ASCII.
_FRAGMENT = ' "<>`'
_QUERY = " \"#<>'"
_PATH = ' "#<>?^`{}'
_USER = _PATH + "/:;=@[\\]|"


@dataclass(frozen=True)
class WebUrl:
    """An http or https URL in its parts; user is 'name' or 'name:password' as written."""

    scheme: str
    user: str
    host: str
    port: str
    path: tuple[str, ...]
    query: str | None
    fragment: str | None

    def __str__(self) -> str:
        at = f"{self.user}@" if self.user else ""
        port = f":{self.port}" if self.port else ""
        query = "" if self.query is None else f"?{self.query}"
        fragment = "" if self.fragment is None else f"#{self.fragment}"
        return f"{self.scheme}://{at}{self.host}{port}/{'/'.join(self.path)}{query}{fragment}"


@lru_cache(maxsize=16)
def _clean(unsafe: str) -> re.Pattern:
    return re.compile("[" + "".join(re.escape(chr(c)) for c in range(0x20, 0x7F) if chr(c) not in unsafe) + "]*")


def _escaped(text: str, unsafe: str) -> str:
    if _clean(unsafe).fullmatch(text):
        return text
    return "".join(c if " " <= c <= "~" and c not in unsafe else "".join(f"%{b:02X}" for b in c.encode("utf-8", "replace")) for c in text)


def _number(label: str) -> int | None:
    """A number as IPv4 addresses may hold it: decimal, octal or hexadecimal."""
    for start, digits, base in (("0x", "0-9a-f", 16), ("0", "0-7", 8), ("", "0-9", 10)):
        if label.startswith(start) and (start != "0" or len(label) > 1):
            rest = label[len(start) :]
            if start == "0x" and not rest:
                return 0
            return int(rest, base) if re.fullmatch(f"[{digits}]+", rest) else None
    return None


def _ipv4(host: str) -> str | None:
    """Dotted decimal; None if the host is no address. Raises ValueError if it must be one and is not."""
    labels = host.split(".")
    if labels[-1] == "" and len(labels) > 1:
        labels.pop()
    last = labels[-1].lower()
    if not (last.isdigit() and last.isascii()) and _number(last) is None:
        return None
    numbers = [_number(x.lower()) for x in labels]
    if len(numbers) > 4 or None in numbers or any(n > 255 for n in numbers[:-1]) or numbers[-1] >= 256 ** (5 - len(numbers)):
        raise ValueError("no IPv4 address")
    value = numbers[-1] + sum(n << 8 * (3 - k) for k, n in enumerate(numbers[:-1]))
    return ".".join(str(value >> s & 255) for s in (24, 16, 8, 0))


def _ipv6(text: str) -> str:
    import ipaddress

    if "%" in text:
        raise ValueError("no IPv6 address")
    groups = [int.from_bytes(ipaddress.IPv6Address(text).packed[k : k + 2]) for k in range(0, 16, 2)]
    words = [f"{g:x}" for g in groups]
    runs = [(-len(m[0]), m.start()) for m in re.finditer("0{2,}", "".join("0" if g == 0 else "1" for g in groups))]
    if not runs:
        return f"[{':'.join(words)}]"
    size, start = min(runs)
    return f"[{':'.join(words[:start])}::{':'.join(words[start - size :])}]"


def _label(label: str) -> str:
    if label.isascii():
        return label
    return "xn--" + label.encode("punycode").decode("ascii")


def _host(text: str) -> str:
    from urllib.parse import unquote_to_bytes

    if text.startswith("["):
        if not text.endswith("]"):
            raise ValueError("an open bracket")
        return _ipv6(text[1:-1])
    name = unquote_to_bytes(text).decode("utf-8", "replace")
    if not name.isascii():
        name = unicodedata.normalize("NFKC", name.translate(_IGNORED).replace("\u3002", "."))
    name = ".".join(map(_label, name.lower().split(".")))
    if not name or _BAD_HOST.search(name) or "\ufffd" in name:
        raise ValueError("no host")
    return _ipv4(name) or name


def _steps(path: str, onto: tuple[str, ...]) -> tuple[str, ...]:
    """The segments of a path that follows `onto`; dot segments are gone through."""
    out = list(onto)
    parts = re.split(r"[/\\]", path)
    for k, part in enumerate(parts):
        last = k == len(parts) - 1
        if "." not in part and "%" not in part:
            out.append(_escaped(part, _PATH))
            continue
        if _TWO.match(part):
            del out[-1:]
        elif not _ONE.match(part):
            out.append(_escaped(part, _PATH))
            continue
        if last:
            out.append("")
    return tuple(out)


def _tail(rest: str) -> tuple[str, str | None, str | None]:
    rest, sharp, fragment = rest.partition("#")
    path, asked, query = rest.partition("?")
    return path, _escaped(query, _QUERY) if asked else None, _escaped(fragment, _FRAGMENT) if sharp else None


def _absolute(scheme: str, rest: str) -> WebUrl:
    rest = rest.lstrip("/\\")
    end = min((k for k in map(rest.find, "/\\?#") if k >= 0), default=len(rest))
    user, at, place = rest[:end].rpartition("@")
    found = re.fullmatch(r"(\[[^\]]*\]?|[^:]*)(?::([0-9]*))?", place)
    if found is None or not found[1]:
        raise ValueError("no host")
    port = found[2] or ""
    if port and int(port) > 65535:
        raise ValueError("no port")
    port = str(int(port)) if port else ""
    name, _, word = user.partition(":")
    user = _escaped(name, _USER) + (f":{_escaped(word, _USER)}" if word else "")
    path, query, fragment = _tail(rest[end:])
    return WebUrl(scheme, user, _host(found[1]), "" if port == PORTS[scheme] else port, _steps(path[1:], ()), query, fragment)


def parse(text: str, base: WebUrl | None = None) -> WebUrl | None:
    """The http(s) URL that a reference names, seen from a base; None if it names none or another kind of address."""
    text = text.strip(_EDGE).translate({9: None, 10: None, 13: None})
    try:
        named = _SCHEME.match(text)
        if named:
            scheme, rest = named[1].lower(), text[named.end() :]
            if scheme not in PORTS:
                return None
            if base is None or scheme != base.scheme or re.match(r"[/\\]{2}", rest):
                return _absolute(scheme, rest)
            text = rest
        if base is None:
            return None
        if re.match(r"[/\\]{2}", text):
            return _absolute(base.scheme, text)
        path, query, fragment = _tail(text)
        if not path:
            return replace(base, query=base.query if query is None else query, fragment=fragment)
        onto = () if path[0] in "/\\" else base.path[:-1]
        return replace(base, path=_steps(path[1:] if path[0] in "/\\" else path, onto), query=query, fragment=fragment)
    except ValueError:
        return None


@lru_cache(maxsize=1024)
def _base(text: str) -> WebUrl | None:
    return parse(text)


def resolve(reference: str, base: str) -> str | None:
    """The reference's URL against a base URL, as text."""
    start = _base(base)
    found = None if start is None else parse(reference, start)
    return None if found is None else str(found)


#: A name in the base's own folder, which needs no parsing.
_PLAIN = re.compile(r"[A-Za-z0-9_~!$&'()*,;=@+-][A-Za-z0-9_~!$&'()*,;=@+./-]*")


def absolute(url: str | None) -> str | None:
    """A base for references: the URL in canonical form, without its fragment; None if it is no http(s) URL."""
    found = None if url is None else parse(url)
    return None if found is None else str(found).partition("#")[0]


@lru_cache(maxsize=1024)
def _folder(base: str) -> str:
    path = base.partition("?")[0]
    return path[: path.rfind("/") + 1]


def behind(reference: str | None, base: str | None) -> str | None:
    """A reference seen from a base (from `absolute`): plain names are put behind its folder, others read by the standard."""
    if reference is None or base is None:
        return None
    if _PLAIN.fullmatch(reference) and "/." not in reference:
        return _folder(base) + reference
    return resolve(reference, base)
