"""Enrichment from small reference tables: locations, postal ranges, labels, majors."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadenza.functions.structured import embedded_json
from cadenza.functions.text import fold, sequence_ratio, title_key, title_tokens
from cadenza.operators.components import written
from cadenza.operators.similar import may_be_alike, similar_titles


def small(df: DataFrame, rows: int = 200_000, size: int = 32 << 20) -> DataFrame:
    """The table marked for broadcast if its rows have been counted and measured to be few and short, else as it is."""
    width = F.sum(F.length(F.to_json(F.struct(*df.columns))))
    n, total = df.limit(rows + 1).agg(F.count(F.lit(1)), width).first()
    return F.broadcast(df) if n <= rows and (total or 0) <= size else df


def resolve_subdivision(events: DataFrame, locations: DataFrame, cutoff: float = 0.8) -> DataFrame:
    """Code of a subdivision given as a code or a name: exact, folded, or the most similar name.

    Adds `code`. All by equality of keys: of country and code, country and folded name, or country and a letter pair that names
    at least `cutoff` alike must share; only what meets by that is compared, once a value.
    """
    table = locations.select("country", F.col("code").alias("__code"), fold("name").alias("__n"))
    asked = events.select("country", "subdivision").distinct().filter("subdivision IS NOT NULL AND subdivision <> ''")
    asked = asked.withColumn("__f", fold("subdivision"))
    codes = table.select("country", F.col("__code").alias("subdivision"), F.col("__code").alias("code")).distinct()
    names = table.groupBy("country", F.col("__n").alias("__f")).agg(F.min("__code").alias("code"))
    hits = asked.join(codes, ["country", "subdivision"]).select("country", "subdivision", "code")
    hits = hits.unionByName(asked.join(names, ["country", "__f"]).select("country", "subdivision", "code"))
    exact = hits.groupBy("country", "subdivision").agg(F.min("code").alias("code"))
    left = asked.join(exact, ["country", "subdivision"], "left_anti")
    near = similar_titles(left.withColumn("key", F.col("__f")), table.withColumn("key", F.col("__n")), ["country"], cutoff, words=1)
    near = near.withColumn("r", sequence_ratio("key_b", "key_a")).filter(F.col("r") >= cutoff)
    close = left.join(near.withColumnRenamed("key_a", "__f"), ["country", "__f"]).select("country", "subdivision", "key_b", "r")
    close = close.join(names.withColumnRenamed("__f", "key_b"), ["country", "key_b"]).groupBy("country", "subdivision").agg(F.max_by("code", F.struct("r", "key_b")).alias("code"))
    return events.join(exact.unionByName(close), ["country", "subdivision"], "left")


def lookup_two_levels(events: DataFrame, cache: DataFrame, key: Column, country: Column) -> DataFrame:
    """The entry of the key in this country, else the key's general entry if its country agrees.

    cache is (key, hint_country, country, subdivision). Adds found_country and found_subdivision.
    """
    own = small(cache.filter("hint_country IS NOT NULL").select(F.col("key").alias("__k1"), F.upper("hint_country").alias("__h"), F.col("country").alias("__c1"), F.col("subdivision").alias("__s1")))
    base = small(cache.filter("hint_country IS NULL").select(F.col("key").alias("__k2"), F.col("country").alias("__c2"), F.col("subdivision").alias("__s2")))
    rows = events.withColumn("__key", fold(key)).withColumn("__country", country)
    rows = rows.join(own, (F.col("__key") == F.col("__k1")) & (F.col("__country") == F.col("__h")), "left").join(base, F.col("__key") == F.col("__k2"), "left")
    agrees = F.col("__country").isNull() | F.col("__country").isin("", "??", "INT") | (F.col("__c2") == F.col("__country"))
    found = {"found_country": F.coalesce("__c1", F.when(agrees, F.col("__c2"))), "found_subdivision": F.when(F.col("__c1").isNotNull(), F.col("__s1")).when(agrees, F.col("__s2"))}
    return rows.withColumns(found).select(*events.columns, *found)


def running_maximum(rows: DataFrame, order: list[str], value: str, name: str) -> DataFrame:
    """`name`: the largest `value` of the rows before each, in the order of `order`; null for the first.

    Rows are sorted by range and written; a range's largest value goes on to the ranges after it, one row each.
    """
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = written(rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("__part", F.spark_partition_id()), "ranges")
    carried, so_far = [], None
    for part, most in sorted(map(tuple, ranged.groupBy("__part").agg(F.max(value)).collect())):  # a row for each range
        carried.append((part, so_far))
        so_far = most if so_far is None else max(so_far, most)
    kind = rows.schema[value].dataType.simpleString()
    before = F.broadcast(spark.createDataFrame(carried, f"__part int, __carried {kind}"))
    own = F.max(value).over(Window.partitionBy("__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    return ranged.withColumn("__own", own).join(before, "__part").withColumn(name, F.greatest("__own", "__carried")).drop("__part", "__own", "__carried")


def lookup_range(df: DataFrame, value: Column, ranges: DataFrame) -> DataFrame:
    """`label` of the range (first, last, label) that holds the value; the first by `first` if several do.

    What earlier ranges cover is taken off later ones, so a value is in one at most; ranges are spread
    over buckets of the mean width, at most two a range on average, and looked up by bucket.
    """
    r = running_maximum(ranges.filter("first <= last"), ["first", "last"], "last", "above").filter("above IS NULL OR last > above")
    low, high, n = r.agg(F.min("first").cast("double"), F.max("last").cast("double"), F.count(F.lit(1))).first()
    if not n:
        return df.withColumn("label", F.lit(None).cast(ranges.schema["label"].dataType))
    bucket = lambda c: F.floor((c.cast("double") - low) / max((high - low) / n, 1e-9))
    spread = F.explode(F.sequence(bucket(F.greatest("first", "above")), bucket(F.col("last")))).alias("__bucket")
    r = small(r.select(F.col("first").alias("__a"), F.col("last").alias("__b"), F.col("above").alias("__above"), F.col("label").alias("__l"), spread))
    rows = df.withColumn("__v", value)
    inside = (bucket(F.col("__v")) == F.col("__bucket")) & F.col("__v").between(F.col("__a"), F.col("__b")) & (F.col("__above").isNull() | (F.col("__v") > F.col("__above")))
    return rows.join(r, inside, "left").select(*df.columns, F.col("__l").alias("label"))


#: Label tiers, the highest last (fixed values).
TIERS = ("label", "elite", "gold", "platinum")


def annotate_labels(events: DataFrame, feed: DataFrame, days: int = 2, similar: float = 0.72) -> DataFrame:
    """label_tier of the best matching feed row; null where none matches.

    feed is (name_norm, city_norm, country, date, tier). A row matches in a compatible country,
    within two days, by title similarity or by city and two words in common.
    """
    f = small(feed.select(F.col("name_norm").alias("__n"), F.col("country").alias("__c"), F.col("date").alias("__d"), F.col("tier").alias("__t"), F.col("city_norm").alias("__w")))
    # Days are spread out, so the join is by equality on the date.
    f = f.select("*", F.explode(F.sequence(F.date_sub("__d", days), F.date_add("__d", days))).alias("__day"))
    rows = events.select("id", "event_date", "country", title_key("title").alias("k"), title_key("city").alias("city_key"))
    near = rows.join(f, (F.col("event_date") == F.col("__day")) & (F.col("__c").isNull() | F.col("country").isNull() | (F.col("__c") == "") | (F.col("country") == "") | (F.col("__c") == F.col("country"))))
    near = near.filter((F.col("k") != "") & (F.col("__n") != ""))
    shared = F.size(F.array_intersect(F.split("k", " "), F.split("__n", " ")))
    in_city = (F.coalesce("__w", F.lit("")) != "") & (F.col("city_key") != "") & F.contains("__n", "city_key") & (shared >= 2)
    # Each two titles are compared once, and only where lengths and edits leave it open.
    titles = near.select("k", "__n").distinct().filter(may_be_alike(F.col("k"), F.col("__n"), similar))
    alike = titles.filter(sequence_ratio("k", "__n") >= similar).withColumn("__alike", F.lit(True))
    hit = near.join(alike, ["k", "__n"], "left").filter(F.coalesce("__alike", F.lit(False)) | in_city)
    rank = F.array_position(F.array(*map(F.lit, TIERS)), F.col("__t"))
    best = hit.groupBy("id").agg(F.max_by("__t", rank).alias("label_tier"))
    return events.drop("label_tier").join(best, "id", "left")


def annotate_majors(events: DataFrame, majors: DataFrame) -> DataFrame:
    """is_major where the country agrees, there is a marathon, and the major's words are in title and city."""
    m = small(majors.select(F.col("country").alias("__c"), title_tokens("name").alias("__t")))
    marathon = F.exists("distances", lambda d: F.coalesce(d["km"].between(42.0, 43.0) | F.regexp_replace(F.lower(d["label"]), r"\s", "").isin("26.2mi", "26mi", "26.1mi", "26.3mi"), F.lit(False)))
    rows = events.filter(marathon).select("id", "country", title_tokens("title").alias("t"), title_tokens("city").alias("w"))
    inside = (F.size("__t") > 0) & (F.size(F.array_except("__t", "t")) == 0) & (F.size(F.array_except("__t", "w")) == 0)
    hit = rows.join(m, (F.col("country") == F.col("__c")) & inside, "left_semi").select("id", F.lit(True).alias("__m")).distinct()
    return events.drop("is_major").join(hit, "id", "left").withColumn("is_major", F.coalesce("__m", F.lit(False))).drop("__m")


def cleared_subdivision(events: DataFrame, locations: DataFrame) -> DataFrame:
    """A subdivision that its country does not have is blanked; countries without known subdivisions keep theirs."""
    known = locations.groupBy(F.col("country").alias("__c")).agg(F.collect_set("code").alias("__codes"))  # a row for each country
    rows = events.join(small(known), F.col("country") == F.col("__c"), "left")
    wrong = ~F.col("subdivision").isin("", "??", "INT") & F.col("__codes").isNotNull() & ~F.array_contains("__codes", F.col("subdivision"))
    return rows.withColumn("subdivision", F.when(wrong, "").otherwise(F.col("subdivision"))).select(*events.columns)


def missing_locations(events: DataFrame, locations: DataFrame, cache: DataFrame) -> DataFrame:
    """Subdivisions and countries that are missing or wrong, looked up by the city in the cache."""
    lacks = lambda c: F.coalesce(F.col(c), F.lit("")).isin("", "??", "INT")
    rows = cleared_subdivision(events, locations).withColumns({c: F.when(F.col(c) == "INT", "").otherwise(F.col(c)) for c in ("country", "subdivision")})
    city = F.trim(F.get(F.split(F.coalesce(F.nullif("city", F.lit("")), "location_text", F.lit("")), ","), 0))
    looked = lookup_two_levels(rows, cache, city, F.when(lacks("country"), "BR").otherwise(F.col("country")))
    found = ~F.coalesce("found_country", F.lit("")).isin("", "??")
    placed = F.coalesce("found_subdivision", F.lit("")) != ""
    country = F.when(found & (lacks("country") | (lacks("subdivision") & placed)), F.col("found_country")).otherwise(F.col("country"))
    subdivision = F.when(lacks("subdivision") & placed, F.col("found_subdivision")).otherwise(F.col("subdivision"))
    return looked.withColumns({"country": country, "subdivision": subdivision}).select(*events.columns)


def repaired_locations(events: DataFrame, locations: DataFrame, cache: DataFrame) -> DataFrame:
    """A stored snapshot with its locations repaired; events without a place, or with a city that is none and no place else, go."""
    kept = missing_locations(events.filter(F.coalesce(F.trim("location_text"), F.lit("")) != ""), locations, cache)
    nowhere = F.lower(F.trim(F.get(F.split(F.coalesce(F.nullif("city", F.lit("")), "location_text"), ","), 0))).isin("anytime", "virtual", "online")
    lacking = F.coalesce("subdivision", F.lit("")).isin("", "??") | F.coalesce("country", F.lit("")).isin("", "??")
    return kept.filter(~(nowhere & lacking))


def merged_cache(cache: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """A cache table with new entries in place of old ones of the same keys."""
    same = reduce(and_, (cache[k].eqNullSafe(new[k]) for k in keys))
    return cache.join(new, same, "left_anti").unionByName(new)


def majors_feed(answers: DataFrame, cached: DataFrame, text_col: str = "value") -> DataFrame:
    """(name, country) of a landed answer of a knowledge graph; where it has none, the cached ones."""
    rows = answers.select(F.explode(F.from_json(F.get_json_object(text_col, "$.results.bindings"), "array<struct<raceLabel:struct<value:string>,iso:struct<value:string>>>")).alias("b"))
    fresh = rows.select(F.col("b.raceLabel.value").alias("name"), F.col("b.iso.value").alias("country")).filter("name <> '' AND country <> ''")
    return fresh.unionByName(cached.select("name", "country").join(fresh.select(F.lit(1).alias("__any")).limit(1), F.lit(True), "left_anti"))


def labels_feed(pages: DataFrame, tiers: dict[str, str], countries: dict[str, str], text_col: str = "html") -> DataFrame:
    """(name_norm, city_norm, country, date, tier) of a landed calendar page's embedded data; tiers maps its groups, countries its codes."""
    item = "array<struct<name:string,competitionSubgroup:string,startDate:string,countryCode:string,venue:string,venueWithoutCountry:string>>"
    data = F.get_json_object(embedded_json(F.col(text_col), "__NEXT_DATA__"), "$.props.pageProps.calendarEvents.results")
    rows = pages.select(F.explode(F.from_json(data, item)).alias("e")).select("e.*")
    of = lambda table, c: F.try_element_at(F.create_map(*(F.lit(v) for kv in table.items() for v in kv)), c)
    out = rows.select(
        title_key(F.coalesce("name", F.lit(""))).alias("name_norm"),
        title_key(F.coalesce(F.nullif("venueWithoutCountry", F.lit("")), "venue", F.lit(""))).alias("city_norm"),
        F.coalesce(of(countries, F.upper(F.trim("countryCode"))), F.lit("")).alias("country"),
        F.try_to_date(F.substring("startDate", 1, 10), "yyyy-MM-dd").alias("date"),
        of(tiers, F.lower(F.trim("competitionSubgroup"))).alias("tier"),
    )
    return out.filter("tier IS NOT NULL AND date IS NOT NULL")


def rebuilt_location(city: Column, subdivision: Column, country: Column, text: Column) -> Column:
    """R8: 'City, UF' for events of one country, the text elsewhere."""
    return F.when((country == "BR") & (city != "") & (subdivision != ""), F.concat_ws(", ", city, subdivision)).otherwise(text)
