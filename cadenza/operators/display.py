"""What an event card shows, as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadenza.functions.distance import km_label
from cadenza.operators.search import in_period, sorted_distances


def distance_labels(distances: Column) -> Column:
    """Labels in order of length, each once."""
    return F.array_distinct(F.transform(sorted_distances(distances), km_label))


def detail_rows(distances: Column) -> Column:
    """One (label, date, start_time) a label; dates and times are null where all are the same."""
    many = lambda f: F.size(F.array_distinct(F.array_compact(F.transform(distances, lambda d: d[f])))) > 1
    rows = F.transform(sorted_distances(distances), lambda d: F.struct(km_label(d).alias("label"), F.when(many("date"), d["date"]).alias("date"), F.when(many("start_time"), d["start_time"]).alias("start_time")))
    return F.filter(rows, lambda r, i: F.array_position(F.transform(rows, lambda x: x["label"]), r["label"]) == i + 1)


def place_text(city: Column, subdivision_name: Column, country_name: Column, raw: Column) -> Column:
    """subdivision's name, else the city, with the country; else the raw text."""
    first = F.coalesce(F.nullif(subdivision_name, F.lit("")), F.nullif(city, F.lit("")))
    return F.coalesce(F.when(first.isNotNull(), F.concat_ws(", ", first, country_name)), raw)


def relative_day(date: Column, as_of: Column) -> Column:
    """B7."""
    n = F.datediff(date, as_of)
    return F.when(n == 0, "today").when(n == 1, "tomorrow").when(n == -1, "yesterday").when(n > 1, F.format_string("in %d days", n)).when(n < -1, F.format_string("%d days ago", -n))


def shown_time(distances: Column, start_time: Column) -> Column:
    """No start time where the distances are on several dates."""
    return F.when(F.size(F.array_distinct(F.array_compact(F.transform(distances, lambda d: d["date"])))) <= 1, start_time)


def split_recent_past(events: DataFrame, as_of: Column) -> tuple[DataFrame, DataFrame]:
    """The last 15 days, newest first, and what is to come."""
    past = in_period(F.col("event_date"), "past15", as_of) & F.col("event_date").isNotNull()
    return events.filter(past).orderBy(F.col("event_date").desc()), events.filter(~past & in_period(F.col("event_date"), "all", as_of))


def has_several_sources(listings: Column) -> Column:
    """B9."""
    return F.size(listings) > 1
