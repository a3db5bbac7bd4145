"""Parsers for the forms that payloads land in, told by a specification what is where.

A specification names, for each field of an event, a JSON path or a regular expression. Rows come
out with event columns and source_seq; what a payload does not have is null.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadenza.functions import structured
from cadenza.functions.dates import parse_date, parse_time
from cadenza.functions.distance import extract_distances
from cadenza.functions.text import clean_text, normal_title
from cadenza.operators.rules import is_cancelled
from cadenza.schema import RACE_EVENT

PLAIN = ("id", "title", "date", "time", "place", "city", "subdivision", "country", "image", "page", "signup", "status", "distances")


@dataclass(frozen=True)
class Spec:
    """Where the fields are; `constants` fills those that the payload leaves out."""

    source: str
    fields: dict[str, str]
    kind: str = "calendar"
    rows: str | None = None  # JSON path of the list of events, or regex that begins a card
    constants: dict[str, str] = field(default_factory=dict)
    base_url: str = ""
    month_first: bool = False  # dates in numbers are month/day/year


def to_events(rows: DataFrame, spec: Spec) -> DataFrame:
    """Event columns from plain text fields: titles, dates, times and distances are normalized here."""
    value = lambda k: F.coalesce(F.nullif(F.trim(clean_text(F.col(k))), F.lit("")), F.lit(spec.constants.get(k)).cast("string"))
    link = lambda k: F.when(value(k).startswith("http"), value(k)).otherwise(F.concat(F.lit(spec.base_url), value(k)))
    kms = F.transform(extract_distances(F.coalesce(value("distances"), value("title")), value("title")), lambda km: F.struct(km.alias("km"), F.lit(None).cast("string").alias("label"), F.lit(None).cast("date").alias("date"), F.lit(None).cast("string").alias("start_time")))
    listing = F.struct(F.lit(spec.source).alias("name"), link("page").alias("page_url"), F.array_compact(F.array(link("signup"))).alias("signup_urls"), F.lit(spec.kind).alias("kind"))
    written = F.regexp_replace(value("date"), r"^(?<dm>\d{1,2}/\d{1,2}/)(?<y>\d{2})$", "${dm}20${y}")
    columns = {
        "id": F.concat_ws("_", F.lit(spec.source), F.coalesce(value("id"), F.md5(F.concat_ws("|", value("title"), value("date"), value("page"))))),
        "title": normal_title(value("title")),
        "event_date": parse_date(F.regexp_replace(written, r"^(\d{1,2})/(\d{1,2})/(\d{4})", "$2/$1/$3") if spec.month_first else written),
        "start_time": parse_time(value("time")),
        "location_text": F.coalesce(value("place"), F.nullif(F.concat_ws(", ", value("city"), value("subdivision")), F.lit(""))),
        "city": value("city"),
        "subdivision": value("subdivision"),
        "country": value("country"),
        "distances": kms,
        "image_url": value("image"),
        "listings": F.array(listing),
        "is_cancelled": is_cancelled(value("status")),
        "source_seq": F.col("source_seq"),
    }
    known = {c.split(" ", 1)[0]: c.split(" ", 1)[1] for c in _columns(RACE_EVENT)}
    rest = [F.lit(None).cast(t).alias(c) for c, t in known.items() if c not in columns]
    return rows.select(*(x.cast(known[c]).alias(c) if c in known else x.alias(c) for c, x in columns.items()), *rest)


def _columns(ddl: str) -> list[str]:
    out, depth, word = [], 0, ""
    for c in ddl + ",":
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append(word.strip())
            word = ""
        else:
            word += c
    return out


def parse_json_feed(payloads: DataFrame, spec: Spec, text_col: str = "value") -> DataFrame:
    """Feeds (plain, JSONP, or with the events in a list at spec.rows): one row for each event in them."""
    body = F.coalesce(F.nullif(structured.unwrap_jsonp(F.col(text_col)), F.lit("")), F.col(text_col))
    listed = F.get_json_object(body, spec.rows) if spec.rows else body
    items = F.coalesce(F.from_json(listed, "array<string>"), F.array(listed))
    flat = payloads.select(*_payload(payloads), F.posexplode(items).alias("i", "json"))
    fields = [F.get_json_object("json", spec.fields[k]).alias(k) if k in spec.fields else F.lit(None).cast("string").alias(k) for k in PLAIN]
    return to_events(flat.select(*fields, _sequence()), spec)


def _payload(df: DataFrame) -> list[Column]:
    """What orders payloads: the file (column url_file, or the file read), else the payload's own content."""
    file = F.col("url_file") if "url_file" in df.columns else F.input_file_name()
    whole = F.xxhash64(*(F.col(c).cast("string") for c in df.columns if df.schema[c].dataType.typeName() in ("string", "binary")))
    return [file.alias("__file"), whole.alias("__payload")]


def _sequence() -> Column:
    """Order within the source: file, payload, place in it; the same however rows are dealt out."""
    return F.struct(F.col("__file").alias("file"), F.col("__payload").alias("payload"), F.col("i").cast("long").alias("place")).alias("source_seq")


def parse_html_cards(pages: DataFrame, spec: Spec, text_col: str = "html") -> DataFrame:
    """Listing pages: spec.rows begins a card, each field is the first group of its regex in the card."""
    parts = F.split(F.col(text_col), spec.rows)
    cards = F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0)))
    flat = pages.select(*_payload(pages), F.posexplode(cards).alias("i", "card"))
    fields = [F.regexp_extract("card", spec.fields[k], 1).alias(k) if k in spec.fields else F.lit(None).cast("string").alias(k) for k in PLAIN]
    return to_events(flat.select(*fields, _sequence()), spec)


def parse_json_ld(pages: DataFrame, spec: Spec, text_col: str = "html") -> DataFrame:
    """Pages with schema.org events, whatever they are nested in."""
    events = structured.json_ld_events(structured.json_ld_blocks(F.col(text_col)))
    flat = pages.select(*_payload(pages), F.posexplode(events).alias("i", "e"))
    at = {"title": "e.name", "date": "e.start", "place": "e.place", "city": "e.city", "subdivision": "e.region", "country": "e.country", "image": "e.image", "page": "e.url", "signup": "e.url", "status": "e.status"}
    fields = [(F.col(at[k]) if k in at else F.lit(None).cast("string")).alias(k) for k in PLAIN]
    return to_events(flat.select(*fields, _sequence()), spec)


def parse_sitemap(xml: DataFrame, pattern: str, text_col: str = "value") -> DataFrame:
    """Addresses of event pages in sitemaps, each once."""
    return xml.select(F.explode(structured.sitemap_locations(F.col(text_col))).alias("url")).filter(F.col("url").rlike(pattern)).distinct()
