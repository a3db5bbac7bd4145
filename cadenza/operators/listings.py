"""Joins and folds within one source's payloads, before events of different sources meet."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def grouped_documents(docs: DataFrame, key: str, order: str, km: str, time: str) -> DataFrame:
    """Search-index documents of one event as a row: the first document's fields, all distances, the earliest time."""
    rest = [c for c in docs.columns if c not in (key, km, time)]
    return docs.groupBy(key).agg(*(F.min_by(c, order).alias(c) for c in rest if c != order), F.array_sort(F.collect_set(km)).alias("kms"), F.min(time).alias("start_time"))


def earliest_edition(rows: DataFrame, key: str, date: str) -> DataFrame:
    """The first date of each key and year."""
    return rows.groupBy(key, F.year(date).alias("year")).agg(F.min(date).alias(date))


def with_times(rows: DataFrame, times: DataFrame, keys: list[str]) -> DataFrame:
    """Start times from a map table with a composite key; times that a row has stay."""
    other = times.select(*keys, F.col("start_time").alias("__t"))
    return rows.join(other, keys, "left").withColumn("start_time", F.coalesce("start_time", "__t")).drop("__t")


def nearest_within(km: Column, entries: Column, tolerance: float = 0.5) -> Column:
    """The first entry (struct with km) whose length is within the tolerance."""
    return F.get(F.filter(entries, lambda e: F.abs(e["km"] - km) < tolerance), 0)


def schedule(entries: Column) -> Column:
    """Of (km, date, start_time) entries one for each length: the first day, its earliest time."""
    ordered = F.array_sort(entries, lambda a, b: F.when(a["km"] != b["km"], F.signum(a["km"] - b["km"]).cast("int")).when(a["date"] < b["date"], -1).when(a["date"] > b["date"], 1).when(a["start_time"] < b["start_time"], -1).when(a["start_time"] > b["start_time"], 1).otherwise(0))
    return F.filter(ordered, lambda e, i: (i == 0) | (F.get(F.transform(ordered, lambda x: x["km"]), F.greatest(i - 1, F.lit(0))) != e["km"]))


#: Subdivision codes of two countries that are mixed up in feeds (fixed values).
CANADA = ("AB", "BC", "MB", "NB", "NL", "NS", "NT", "NU", "ON", "PE", "QC", "SK", "YT")


def repaired_country(country: Column, subdivision: Column) -> Column:
    """A country that contradicts its subdivision."""
    return F.when((country == "US") & subdivision.isin(*CANADA), "CA").when((country == "CA") & ~subdivision.isin(*CANADA) & (F.length(subdivision) == 2), "US").otherwise(country)


def display_place(events: DataFrame, names: DataFrame, language: str = "en") -> DataFrame:
    """Display names of country and subdivision, falling back to any language, then to the code.

    names is (kind, code, language, name), kind being country or subdivision.
    """
    out = events
    for kind, column in (("country", "country"), ("subdivision", "subdivision")):
        n = names.filter(F.col("kind") == kind).groupBy(F.col("code").alias("__c")).agg(F.max(F.when(F.col("language") == language, F.col("name"))).alias("__own"), F.min("name").alias("__any"))
        out = out.join(n, F.col(column) == F.col("__c"), "left").withColumn(f"{kind}_name", F.coalesce("__own", "__any", column)).drop("__c", "__own", "__any")
    return out


def leg_sums(legs: Column) -> Column:
    """Total length of a relay's legs."""
    return F.aggregate(legs, F.lit(0.0), lambda s, x: s + F.coalesce(x["km"], F.lit(0.0)))


def pages_in_reach(rows: DataFrame, group: str, page: str, key: str, size: int) -> DataFrame:
    """Rows of landed result pages up to the first that is short or has no key that earlier ones lack.

    Fetching stops there; landed folders may hold pages from an earlier, longer run behind it.
    """
    first = rows.groupBy(group, key).agg(F.min(page).alias("__first"))
    pages = rows.join(first, [group, key]).groupBy(group, page).agg(F.count(F.lit(1)).alias("__n"), F.count_if(F.col(page) == F.col("__first")).alias("__new"))
    end = pages.groupBy(group).agg(F.min(F.when((F.col("__n") < size) | (F.col("__new") == 0), F.col(page))).alias("__end"))
    return rows.join(end, group).filter(F.col("__end").isNull() | (F.col(page) <= F.col("__end"))).drop("__end")
