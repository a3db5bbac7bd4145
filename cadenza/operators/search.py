"""Faceted search over published events: filters, facets, months, ordering and top-k."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadenza.functions.text import fold, matches_all_tokens

PERIODS = {"today": (0, 0), "30": (0, 30), "90": (0, 90), "180": (0, 180), "all": (0, None), "past15": (-15, -1)}


def in_period(date: Column, period: str, as_of: Column, first: Column | None = None, last: Column | None = None) -> Column:
    """A preset period around as_of, or 'custom' bounds. Events without a date pass the presets."""
    if period == "custom":
        low = F.lit(True) if first is None else date >= first
        high = F.lit(True) if last is None else date <= last
        return F.coalesce(low & high, F.lit(False))
    a, b = PERIODS[period]
    inside = date >= F.date_add(as_of, a)
    if b is not None:
        inside = inside & (date <= F.date_add(as_of, b))
    return F.coalesce(inside, F.lit(True))


def in_location(country: Column, subdivision: Column, value: str) -> Column:
    """P15: 'todos' (all), 'CC:' (a country) or 'CC:SUB'."""
    if value == "todos":
        return F.lit(True)
    c, _, s = value.partition(":")
    return (F.coalesce(country, F.lit("BR")) == c) & (F.lit(True) if not s else subdivision == s)


def any_listed(names: Column, wanted: list[str]) -> Column:
    """One of the names is wanted; nothing wanted means all."""
    return F.arrays_overlap(names, F.array(*map(F.lit, wanted))) if wanted else F.lit(True)


def label_tokens(tier: Column, is_major: Column) -> Column:
    return F.array_compact(F.array(tier, F.when(is_major, F.lit("major"))))


def has_distance(distances: Column, pills: list[str], least: float | None = None, most: float | None = None) -> Column:
    """One of the pills (within 0.5 km; 'outros' is any other length or label), or an interval of km."""
    known = (5.0, 10.0, 21.0, 21.097, 42.0, 42.195)
    exact = {"21": 21.097, "42": 42.195}
    if least is not None or most is not None:
        return F.exists(distances, lambda d: F.coalesce(d["km"].between(least if least is not None else 0.0, most if most is not None else 1e9), F.lit(False)))
    if not pills:
        return F.lit(True)

    def one(d: Column, pill: str) -> Column:
        if pill == "outros":
            return d["km"].isNull() | ~d["km"].isin(*known)
        return F.abs(d["km"] - exact.get(pill, float(pill) if pill not in exact else 0.0)) <= 0.5

    def some(d: Column) -> Column:
        out = F.lit(False)
        for p in pills:
            out = out | F.coalesce(one(d, p), F.lit(False))
        return out

    return F.exists(distances, some)


def matches_search(query: str, *columns: Column) -> Column:
    """Every word of the query is in the folded text of the columns."""
    return matches_all_tokens(fold(F.concat_ws(" ", *columns)), query)


def months(events: DataFrame, date: Column, as_of: Column, first_seen: Column, new_days: int = 15) -> DataFrame:
    """Events and whether any is new, by month."""
    return events.groupBy(F.date_format(date, "yyyy-MM").alias("month")).agg(F.count(F.lit(1)).alias("n_events"), F.bool_or(first_seen >= F.date_sub(as_of, new_days)).alias("has_new"))


def first_future_month(months_df: DataFrame, as_of: Column) -> DataFrame:
    """The month to expand first."""
    least = F.min(F.when(F.col("month") >= F.date_format(as_of, "yyyy-MM"), F.col("month"))).over(Window.partitionBy())
    return months_df.withColumn("expanded", F.coalesce(F.col("month") == least, F.lit(False)))


def facet(events: DataFrame, own: str, filters: dict[str, Column], value: Column, *also_without: str) -> DataFrame:
    """Values of a facet with all filters but its own (and those named) applied."""
    for name, condition in filters.items():
        if name != own and name not in also_without:
            events = events.filter(condition)
    return events.groupBy(value.alias("value")).agg(F.count(F.lit(1)).alias("n"))


def sorted_distances(distances: Column) -> Column:
    """Lengths ascending, labels last."""
    return F.array_sort(distances, lambda a, b: F.when(a["km"].isNull() & b["km"].isNull(), 0).when(a["km"].isNull(), 1).when(b["km"].isNull(), -1).when(a["km"] < b["km"], -1).when(a["km"] > b["km"], 1).otherwise(0))


def sorted_listings(listings: Column) -> Column:
    """T4: signup, organizer, calendar, then by name."""
    rank = lambda x: F.when(x["kind"] == "signup", 0).when(x["kind"] == "organizer", 1).otherwise(2)
    keyed = F.transform(listings, lambda x: F.struct(rank(x).alias("r"), x["name"].alias("n"), x.alias("x")))
    return F.transform(F.array_sort(keyed, lambda a, b: F.when(a["r"] != b["r"], F.signum(a["r"] - b["r"]).cast("int")).when(a["n"] < b["n"], -1).when(a["n"] > b["n"], 1).otherwise(0)), lambda k: k["x"])


def best_link(listings: Column) -> Column:
    """The first signup link, else the first page."""
    urls = F.flatten(F.transform(listings, lambda x: F.coalesce(x["signup_urls"], F.array())))
    return F.coalesce(F.get(urls, 0), F.get(F.transform(listings, lambda x: x["page_url"]), 0))


def padded_top(events: DataFrame, wanted: Column, date: Column, ordinal: Column, k: int = 120) -> DataFrame:
    """The k first by date, wanted ones before all others."""
    return events.orderBy(wanted.desc(), date.asc_nulls_last(), ordinal).limit(k)


def stratified_sample(df: DataFrame, stratum: Column, shares: dict, key: Column, n: int, seed: str = "") -> DataFrame:
    """A fixed sample of n rows, each stratum with its share, ordered by a hash of the key."""
    rank = F.row_number().over(Window.partitionBy(stratum).orderBy(F.md5(F.concat(F.lit(seed), key.cast("string")))))
    most = F.create_map(*[F.lit(x) for k, v in shares.items() for x in (k, int(n * v))])
    return df.withColumn("rank", rank).filter(F.col("rank") <= F.try_element_at(most, stratum))


def any_filter_active(filters: dict, defaults: dict) -> bool:
    """Whether a filter differs from what it is at first; lists are compared without order."""
    plain = lambda v: sorted(v) if isinstance(v, (list, set, tuple)) else v
    return any(plain(filters.get(k, d)) != plain(d) for k, d in defaults.items())


def with_default(filters: dict, name: str, default, available: list, touched: bool) -> dict:
    """B2: the filters with a default applied, if its value is still to be had and nobody has changed the filter."""
    return filters if touched or default not in available else {**filters, name: default}


def same_rows(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: rows that only one of two tables has, with repeats; both 0 where they are the same."""
    only = lambda x, y, name: x.exceptAll(y).agg(F.count(F.lit(1)).alias(name))
    return only(a, b, "only_first").crossJoin(only(b, a, "only_second"))  # one row each
