"""Facts from landed HTML and JSON payloads."""

from __future__ import annotations

import json
import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def html_title(page: Column) -> Column:
    return F.trim(F.regexp_extract(page, r"(?is)<title[^>]*>(.*?)</title>", 1))


def html_links(page: Column) -> Column:
    """Targets of all links, in order."""
    return F.regexp_extract_all(page, F.lit(r"""(?i)<a\s[^>]*?href\s*=\s*["']([^"']*)["']"""), F.lit(1))


def sitemap_locations(xml: Column) -> Column:
    return F.regexp_extract_all(xml, F.lit(r"<loc>\s*([^<\s]+)\s*</loc>"), F.lit(1))


def meta_property(page: Column, name: str) -> Column:
    """Content of a meta tag such as og:image."""
    return F.regexp_extract(page, rf"""(?is)<meta\s[^>]*(?:property|name)\s*=\s*["']{re.escape(name)}["'][^>]*content\s*=\s*["']([^"']*)["']""", 1)


def json_ld_blocks(page: Column) -> Column:
    """Text of the page's JSON-LD scripts."""
    return F.regexp_extract_all(page, F.lit(r"""(?is)<script[^>]*type\s*=\s*["']application/ld\+json["'][^>]*>(.*?)</script>"""), F.lit(1))


def embedded_json(page: Column, marker: str) -> Column:
    """JSON text of the script with this id."""
    return F.regexp_extract(page, rf"""(?is)<script[^>]*id\s*=\s*["']{re.escape(marker)}["'][^>]*>(.*?)</script>""", 1)


def unwrap_jsonp(text: Column) -> Column:
    return F.regexp_extract(text, r"(?s)^[\w.$]+\((.*)\)\s*;?\s*$", 1)


EVENT = T.StructType([T.StructField(n, T.StringType()) for n in ("name", "start", "end", "url", "image", "place", "city", "region", "country", "status")])


def _walk(node, wanted: str, depth: int = 0):
    """All objects of a type in nested JSON."""
    if depth > 10:
        return
    if isinstance(node, list):
        for x in node:
            yield from _walk(x, wanted, depth + 1)
    elif isinstance(node, dict):
        kind = node.get("@type")
        if any(str(k).endswith(wanted) for k in (kind if isinstance(kind, list) else [kind])):
            yield node
            return
        for key in ("@graph", "itemListElement", "item", "mainEntity", "subEvent"):
            if key in node:
                yield from _walk(node[key], wanted, depth + 1)


def _event(node: dict) -> dict:
    place = node.get("location")
    place = place[0] if isinstance(place, list) and place else place
    place = place if isinstance(place, dict) else {"name": place}
    address = place.get("address")
    address = address if isinstance(address, dict) else {"streetAddress": address}
    image = node.get("image")
    image = image[0] if isinstance(image, list) and image else image
    image = image.get("url") if isinstance(image, dict) else image
    country = address.get("addressCountry")
    country = country.get("name") if isinstance(country, dict) else country
    values = (node.get("name"), node.get("startDate"), node.get("endDate"), node.get("url"), image, place.get("name"), address.get("addressLocality"), address.get("addressRegion"), country, node.get("eventStatus"))
    return {k: None if v is None else str(v) for k, v in zip(EVENT.names, values, strict=True)}


@F.pandas_udf(T.ArrayType(EVENT))
def json_ld_events(blocks: pd.Series) -> pd.Series:
    """Events of JSON-LD blocks, from lists, graphs and item lists; a block that is not JSON is passed over."""

    def one(texts) -> list[dict]:
        out = []
        for t in texts if texts is not None else []:
            try:
                out += [_event(n) for n in _walk(json.loads(t), "Event")]
            except ValueError:
                continue
        return out

    return blocks.map(one)


@F.pandas_udf(T.StringType())
def json_shape(texts: pd.Series) -> pd.Series:
    """Keys and types of a JSON text, four levels deep, 20 keys a level."""

    def shape(x, depth: int):
        if depth == 0 or not isinstance(x, (dict, list)):
            return type(x).__name__
        if isinstance(x, list):
            return [shape(x[0], depth - 1)] if x else []
        return {k: shape(v, depth - 1) for k, v in list(x.items())[:20]}

    def one(t):
        try:
            return json.dumps(shape(json.loads(t), 4))
        except (TypeError, ValueError):
            return None

    return texts.map(one)


class _Text(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.parts: list[str] = []
        self.hidden = 0

    def handle_starttag(self, tag, attrs):
        self.hidden += tag in ("script", "style")

    def handle_endtag(self, tag):
        self.hidden -= tag in ("script", "style") and self.hidden > 0

    def handle_data(self, data):
        if not self.hidden:
            self.parts.append(data)


@F.pandas_udf(T.StringType())
def visible_text(pages: pd.Series) -> pd.Series:
    """Text that a page shows."""

    def one(page: str | None) -> str | None:
        if page is None:
            return None
        p = _Text()
        p.feed(page)
        p.close()
        return " ".join(" ".join(p.parts).split())

    return pages.map(one)


def city_code_pairs(text: Column) -> Column:
    """Subdivision codes of all 'City - XX' patterns of a text."""
    return F.regexp_extract_all(text, F.lit(r"\p{Lu}[\p{L} ]+?\s*[-/]\s*([A-Z]{2})\b"), F.lit(1))


def query_parameter(url: Column, name: str) -> Column:
    """P25: a parameter of an address."""
    return F.try_url_decode(F.nullif(F.regexp_extract(url, rf"[?&]{re.escape(name)}=([^&#]*)", 1), F.lit("")))


def recent_locations(xml: Column, first: Column) -> Column:
    """Addresses of a sitemap whose lastmod is not before a date, newest first."""
    entry = F.regexp_extract_all(xml, F.lit(r"(?s)<url>(.*?)</url>"), F.lit(1))
    rows = F.transform(entry, lambda e: F.struct(F.try_to_date(F.substring(F.regexp_extract(e, r"<lastmod>\s*([^<\s]+)", 1), 1, 10), "yyyy-MM-dd").alias("day"), F.regexp_extract(e, r"<loc>\s*([^<\s]+)", 1).alias("url")))
    kept = F.filter(rows, lambda r: r["day"] >= first)
    return F.transform(F.reverse(F.array_sort(kept)), lambda r: r["url"])


def name_by_host(url: Column, names: dict[str, str], default: str) -> Column:
    """The name of the first host fragment that the address has."""
    out = F.lit(default)
    for part, name in reversed(names.items()):
        out = F.when(F.contains(F.lower(url), F.lit(part)), F.lit(name)).otherwise(out)
    return out


def signup_state(text: Column, closed: str, opened: str) -> Column:
    """False if the text says closed, else true if it says open, else unknown."""
    return F.when(text.rlike(closed), F.lit(False)).when(text.rlike(opened), F.lit(True))


def decoded(content: Column) -> Column:
    """bytes as UTF-8 where they are valid, else as ISO-8859-1."""
    return F.when(F.is_valid_utf8(content.cast("string")), content.cast("string")).otherwise(F.decode(content, "ISO-8859-1"))


def without_times(text: Column) -> Column:
    """a text without clock times and 'every N km', which are no distances."""
    return F.regexp_replace(text, r"(?i)\b\d{1,2}[h:]\d{2}\b|\b(?:a cada|every|cada)\s+\d+(?:[.,]\d+)?\s*km\b", " ")


def full_year(year: Column) -> Column:
    """two digits mean 20YY."""
    return F.when(F.length(year) == 2, F.concat(F.lit("20"), year)).otherwise(year)


def whole_or_canonical(kms: Column) -> Column:
    """lengths in whole km, or half and full marathons."""
    return F.filter(kms, lambda x: (x == F.floor(x)) | x.isin(21.097, 42.195))


@F.pandas_udf(T.StringType())
def bracketed_array(texts: pd.Series, markers: pd.Series) -> pd.Series:
    """the JSON array that follows a marker in an escaped script, found by its brackets."""

    def one(text: str | None, marker: str) -> str | None:
        text = (text or "").replace('\\"', '"')
        begin = text.find("[", text.find(marker)) if marker in text else -1
        try:
            return json.dumps(json.JSONDecoder().raw_decode(text, begin)[0]) if begin >= 0 else None
        except ValueError:
            return None

    return pd.Series([one(t, m) for t, m in zip(texts, markers, strict=True)], dtype=object)


_START_KEYS = ("startDate", "startTime", "start_date", "start_time", "horario", "hora")
_CLOCK = re.compile(r"T(\d{2}):(\d{2})")


def _start_time(node) -> str | None:
    """The first plausible clock time of nested JSON, fields that name a start before others."""
    if isinstance(node, str):
        m = _CLOCK.search(node)
        return f"{m[1]}:{m[2]}" if m and 4 <= int(m[1]) <= 23 else None
    named = [node[k] for k in _START_KEYS if node.get(k)] if isinstance(node, dict) else []
    rest = list(node.values()) if isinstance(node, dict) else node if isinstance(node, list) else []
    return next(filter(None, map(_start_time, [*named, *rest])), None)


@F.pandas_udf(T.StringType())
def start_time_in(texts: pd.Series) -> pd.Series:
    """F64: the first start time (hours 4 to 23) anywhere in a JSON text."""

    def one(text: str | None) -> str | None:
        try:
            return _start_time(json.loads(text or ""))
        except ValueError:
            return None

    return texts.map(one)
