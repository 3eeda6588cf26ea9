"""URL functions on columns: parts, canonical keys, names, sites and hashes. A URL that cannot be read gives null parts."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reelgrid import constants as K

_SHAPE = r"(?is)^\s*([a-z][a-z0-9+.-]*):[/\\]*(?:[^/?#\\@]*@)?(\[[^\]/?#]*\]|[^/?#:\\]+)(?::([0-9]*))?([^?#]*)(\?[^#]*)?(#.*)?\z"
_CUT = "\x01"


def parsed(url: Column) -> Column:
    """Scheme, host, port, path, query and fragment as an array, by one regular expression; an unreadable URL gives one element."""
    text = F.replace(url, F.lit(_CUT), F.lit("%01"))
    return F.split(F.regexp_replace(text, _SHAPE, _CUT.join(f"${k}" for k in range(1, 7))), _CUT)


class Url:
    """A URL with its parts. Every function here takes a Url or a text; parts held in a column are taken apart once a row."""

    def __init__(self, text: Column, parts: Column):
        self.text, self.parts = text, parts

    def part(self, k: int) -> Column:
        return F.get(self.parts, F.lit(k))


def of(url: Column | Url) -> Url:
    return url if isinstance(url, Url) else Url(url, parsed(url))


def with_parts(df: DataFrame, name: str, column: str = "__url") -> tuple[DataFrame, Url]:
    """The rows with a URL's parts as a column, and the Url that reads them."""
    return df.withColumn(column, parsed(F.col(name))), Url(F.col(name), F.col(column))


def scheme(url: Column | Url) -> Column:
    return F.lower(of(url).part(0))


def is_web(url: Column | Url) -> Column:
    """Whether the URL can be read and is http or https."""
    u = of(url)
    return F.coalesce(F.lower(u.part(0)).isin("http", "https") & u.part(1).isNotNull(), F.lit(False))


def host(url: Column | Url) -> Column:
    return F.lower(F.coalesce(of(url).part(1), F.lit("")))


def path(url: Column | Url) -> Column:
    found = F.coalesce(of(url).part(3), F.lit(""))
    return F.when(found == "", "/").otherwise(found)


def query(url: Column | Url) -> Column:
    return F.substring(F.coalesce(of(url).part(4), F.lit("")), 2, K.MAX_URL_LENGTH * 16)


def _port(u: Url) -> Column:
    """':port', or '' where there is none or it is the scheme's own."""
    port, name = F.coalesce(u.part(2), F.lit("")), F.lower(u.part(0))
    usual = (port == "") | ((name == "http") & (port == "80")) | ((name == "https") & (port == "443"))
    return F.when(usual, "").otherwise(F.concat(F.lit(":"), port))


def origin(url: Column | Url) -> Column:
    """Scheme, host and port; a scheme's own port is left out."""
    u = of(url)
    return F.concat(scheme(u), F.lit("://"), host(u), _port(u))


def origin_of(url: Column | Url) -> Column:
    u = of(url)
    return F.when(is_web(u), origin(u)).otherwise("")


def host_of(url: Column | Url) -> Column:
    u = of(url)
    return F.when(is_web(u), F.regexp_replace(host(u), r"^www\.", "")).otherwise("")


def safe_url(url: Column | Url) -> Column:
    """Origin and path, without query and fragment."""
    u = of(url)
    return F.when(is_web(u), F.concat(origin(u), path(u))).otherwise(F.element_at(F.split(u.text, "[?#]"), 1))


def path_ext(p: Column) -> Column:
    return F.lower(F.regexp_extract(p, r"(?i)\.([a-z0-9]{2,5})\z", 1))


def last_segment(p: Column) -> Column:
    return F.coalesce(F.try_element_at(F.filter(F.split(p, "/"), lambda s: s != ""), F.lit(-1)), F.lit(""))


def _decoded(text: Column) -> Column:
    """Percent-decoded, '+' kept; null where an escape is malformed."""
    return F.try_url_decode(F.replace(text, F.lit("+"), F.lit("%2B")))


def filename_from_url(url: Column | Url) -> Column:
    u = of(url)
    return F.when(is_web(u), F.coalesce(_decoded(last_segment(path(u))), F.lit(""))).otherwise("")


def looks_like_stream_piece(p: Column) -> Column:
    name = last_segment(p)
    return F.regexp_replace(F.coalesce(_decoded(name), name), r"(?i)\.[a-z0-9]{2,5}\z", "").rlike(K.STREAM_PIECE)


def is_volatile(name: Column) -> Column:
    low = F.lower(name)
    out = low.isin(*K.VOLATILE_PARAMS)
    for prefix in K.VOLATILE_PREFIXES:
        out = out | low.startswith(prefix)
    return out


def dedupe_key(url: Column | Url) -> Column:
    """Origin, path and the identifying query parameters in the order of their names; an unreadable URL is its own key."""
    u = of(url)
    pairs = F.transform(
        F.filter(F.split(query(u), "&"), lambda p: p != ""),
        lambda p, i: F.struct(_form(F.regexp_extract(p, "(?s)^([^=]*)", 1)).alias("name"), i.alias("i"), _form(F.regexp_extract(p, "(?s)^[^=]*=(.*)", 1)).alias("value")),
    )
    kept = F.array_sort(F.filter(pairs, lambda p: ~is_volatile(p["name"])))
    text = F.array_join(F.transform(kept, lambda p: F.concat(F.url_encode(p["name"]), F.lit("="), F.url_encode(p["value"]))), "&")
    tail = F.when(query(u) == "", "").otherwise(F.when(text != "", F.concat(F.lit("?"), text)).otherwise(""))
    return F.when(is_web(u), F.concat(origin(u), path(u), tail)).otherwise(u.text)


def _form(text: Column) -> Column:
    return F.coalesce(F.try_url_decode(text), F.replace(text, F.lit("+"), F.lit(" ")))


def registrable_domain(h: Column) -> Column:
    """The part of a host that tells its owner: two labels, three under a short second level of a two-letter top level."""
    labels = F.filter(F.split(F.lower(h), r"\."), lambda x: x != "")
    n = F.size(labels)
    three = (n > 2) & (F.length(F.try_element_at(labels, F.lit(-1))) == 2) & (F.length(F.try_element_at(labels, F.lit(-2))) <= 3)
    return F.when(h.rlike(K.IP_ADDRESS), h).otherwise(F.array_join(F.when(n <= 2, labels).when(three, F.slice(labels, F.greatest(n - 2, F.lit(1)), 3)).otherwise(F.slice(labels, F.greatest(n - 1, F.lit(1)), 2)), "."))


def same_site(a: Column | Url, b: Column | Url) -> Column:
    a, b = of(a), of(b)
    return is_web(a) & is_web(b) & (registrable_domain(host(a)) == registrable_domain(host(b)))


def _fnv(text: Column) -> Column:
    """32-bit FNV-1a as a long."""
    return F.aggregate(F.filter(F.split(text, ""), lambda c: c != ""), F.lit(2166136261).cast("long"), lambda h, c: (h.bitwiseXOR(F.ascii(c).cast("long")) * 16777619).bitwiseAND(F.lit(4294967295).cast("long")))


def hash_string(text: Column) -> Column:
    return F.lower(F.conv(_fnv(text).cast("string"), 10, 36))


def hash_to_rule_id(text: Column) -> Column:
    return _fnv(text) % 2_000_000_000 + 1


#: A name in the base's own folder, which needs no parsing.
_PLAIN = r"^[A-Za-z0-9_~!$&'()*,;=@+-][A-Za-z0-9_~!$&'()*,;=@+./-]*\z"


def _read(references: pd.Series, against: pd.Series) -> pd.Series:
    from reelgrid.functions.weburl import resolve

    return pd.Series([None if r is None or b is None else resolve(r, b) for r, b in zip(references, against, strict=True)], dtype=object)


def _read_each(references: pd.Series, against: pd.Series) -> pd.Series:
    from reelgrid.functions.weburl import resolve

    return pd.Series([None if x is None or b is None else [None if r is None else resolve(r, b) for r in x] for x, b in zip(references, against, strict=True)], dtype=object)


def _canonical(urls: pd.Series) -> pd.Series:
    from reelgrid.functions.weburl import parse

    return pd.Series([None if u is None else (found := parse(u)) and str(found) for u in urls], dtype=object)


def canonical(url: Column) -> Column:
    """An absolute http(s) URL as the URL standard writes it, in Arrow batches; null if it is none."""
    return F.pandas_udf(_canonical, T.StringType())(url)


def base(url: Column) -> Column:
    """A base for references: the URL in canonical form, without its fragment; null if it is no http(s) URL."""
    return F.regexp_replace(canonical(url), "#.*", "")


def _plain(reference: Column) -> Column:
    return reference.rlike(_PLAIN) & ~reference.contains("/.")


def _folder(against: Column) -> Column:
    return F.regexp_extract(against, "^([^?]*/)", 1)


def resolve(reference: Column, against: Column) -> Column:
    """A reference resolved against a base (from `base`) by the URL standard; null where the result is not http(s).

    Plain names are put behind the base's folder; all others are read in Arrow batches.
    """
    other = F.pandas_udf(_read, T.StringType())(F.when(~_plain(reference), reference), against)
    return F.when(_plain(reference), F.concat(_folder(against), reference)).otherwise(other)


def resolve_each(references: Column, against: Column) -> Column:
    """The same of an array of references, in their order."""
    plain = F.forall(references, _plain)
    other = F.pandas_udf(_read_each, T.ArrayType(T.StringType()))(F.when(~plain, references), against)
    return F.when(plain, F.transform(references, lambda r: F.concat(_folder(against), r))).otherwise(other)
