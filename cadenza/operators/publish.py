"""Snapshots: active and archived partitions, slim projection, first shard, JSON-LD, sitemap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadenza.operators.search import best_link, sorted_distances


def split_active(events: DataFrame, as_of: Column, days_back: int = 15) -> tuple[DataFrame, DataFrame]:
    """K1: events still shown, and all others for the archive; none is in neither."""
    active = F.coalesce(F.col("event_date") >= F.date_sub(as_of, days_back), F.lit(True))
    return events.filter(active), events.filter(~active)


def upsert_archive(stored: DataFrame, new: DataFrame) -> DataFrame:
    """K2: archive rows by id, new ones first, with their month for partitioning."""
    both = stored.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)), allowMissingColumns=True)
    rank = F.row_number().over(Window.partitionBy("id").orderBy(F.col("__new").desc()))
    kept = both.withColumn("__rank", rank).filter("__rank = 1").drop("__new", "__rank")
    return kept.withColumn("event_month", F.date_format("event_date", "yyyy-MM"))


def slim(events: DataFrame) -> DataFrame:
    """K3: (id, json) with what the site needs; empty and null fields left out, links equal to the page elided."""
    listings = F.transform(
        "listings",
        lambda x: F.struct(
            x["name"].alias("name"),
            x["page_url"].alias("page_url"),
            F.when(x["signup_urls"] != F.array(x["page_url"]), x["signup_urls"]).alias("signup_urls"),
            x["kind"].alias("kind"),
        ),
    )
    empty = lambda c: F.when(F.col(c) != "", F.col(c)).alias(c)
    true = lambda c: F.when(F.col(c), F.col(c)).alias(c)
    fields = [
        F.col("id"),
        F.col("title"),
        F.col("event_date"),
        *map(empty, ("start_time", "location_text", "city", "subdivision", "country", "image_url", "label_tier")),
        sorted_distances(F.col("distances")).alias("distances"),
        F.col("signup_open"),
        listings.alias("listings"),
        *map(true, ("is_major", "is_cancelled")),
        F.to_date("first_seen_at").alias("first_seen"),
    ]
    return events.select("id", F.to_json(F.struct(*fields), {"ignoreNullFields": "true"}).alias("json"))


def boot_window(events: DataFrame, anchor: Column, back: int = 15, ahead: int = 30) -> DataFrame:
    """K4: the shard that is loaded first."""
    return events.filter(F.col("event_date").between(F.date_sub(anchor, back), F.date_add(anchor, ahead)))


def json_ld(events: DataFrame) -> DataFrame:
    """K6: schema.org markup of each event."""
    days = F.array_sort(F.array_distinct(F.array_compact(F.concat(F.array("event_date"), F.transform("distances", lambda d: d["date"])))))
    organizer = F.get(F.filter("listings", lambda x: x["kind"] == "organizer"), 0)["name"]
    place = F.struct(F.lit("Place").alias("@type"), F.col("location_text").alias("name"), F.struct(F.lit("PostalAddress").alias("@type"), F.col("city").alias("addressLocality"), F.col("subdivision").alias("addressRegion"), F.col("country").alias("addressCountry")).alias("address"))
    node = F.struct(
        F.lit("SportsEvent").alias("@type"),
        F.col("title").alias("name"),
        F.col("event_date").alias("startDate"),
        F.when(F.size(days) > 1, F.array_max(days)).alias("endDate"),
        F.when(F.col("is_cancelled"), F.lit("https://schema.org/EventCancelled")).otherwise(F.lit("https://schema.org/EventScheduled")).alias("eventStatus"),
        place.alias("location"),
        F.col("image_url").alias("image"),
        best_link(F.col("listings")).alias("url"),
        F.when(organizer.isNotNull(), F.struct(F.lit("Organization").alias("@type"), organizer.alias("name"))).alias("organizer"),
    )
    return events.select("id", F.to_json(node, {"ignoreNullFields": "true"}).alias("json_ld"))


def sitemap(base: str, languages: list[str], pages: DataFrame) -> DataFrame:
    """K7: url, lang and its alternates for each page (column path) and language."""
    prefix = lambda x: F.when(x == languages[0], F.lit("")).otherwise(F.concat(F.lit("/"), x))
    every = F.array(*map(F.lit, languages))
    rows = pages.select("path", F.explode(every).alias("lang"))
    return rows.select(F.concat(F.lit(base), prefix(F.col("lang")), "path").alias("url"), "lang", F.transform(every, lambda x: F.concat(F.lit(base), prefix(x), F.col("path"))).alias("alternates"))


def replaced_block(text: str, start: str, end: str, block: str) -> str:
    """K8: the text with what stands between two markers replaced; the same if applied again."""
    a = text.index(start) + len(start)
    return text[:a] + "\n" + block + "\n" + text[text.index(end, a) :]


def with_block(text: Column, start: str, end: str, block: Column) -> Column:
    """K8 for a column of pages."""
    found = F.contains(text, F.lit(start)) & F.contains(text, F.lit(end))
    head = F.concat(F.substring_index(text, start, 1), F.lit(start))
    tail = F.concat(F.lit(end), F.substring_index(F.substring(text, F.length(head) + 1, F.length(text)), end, -1))
    return F.when(found, F.concat(head, F.lit("\n"), block, F.lit("\n"), tail)).otherwise(text)
