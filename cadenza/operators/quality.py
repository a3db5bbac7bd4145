"""Quality gates: listings and links shared by too many events, copies of an id, location checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_of(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each key in an order. Rows of a key are pruned before they meet."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("__rank", rank).filter("__rank = 1").drop("__rank")


def completeness(df: DataFrame) -> Column:
    """how much an event record tells."""
    has = lambda c: F.when(F.coalesce(F.col(c).cast("string"), F.lit("")) != "", 1).otherwise(0)
    first_links = F.coalesce(F.size(F.get(F.col("listings"), 0)["signup_urls"]), F.lit(0))
    window = F.col("signup_window")
    return (
        2 * has("title") + 2 * has("event_date") + has("start_time") + has("location_text") + 2 * has("image_url")
        + F.coalesce(F.size("distances"), F.lit(0)) + F.when(F.col("signup_open").isNotNull(), 1).otherwise(0)
        + F.when(window.isNotNull(), 1).otherwise(0) + F.when(window["closes"].isNotNull(), 1).otherwise(0)
        + 2 * F.greatest(first_links, F.lit(0))
    )


def best_copy_of_id(events: DataFrame, ordinal: Column) -> DataFrame:
    """Of copies of an id the one with most listings, distances, image and time; ties to the earliest."""
    filled = lambda c: F.when(F.coalesce(F.col(c), F.lit("")) != "", 1).otherwise(0)
    return first_of(events, ["id"], F.size("listings").desc(), F.size("distances").desc(), filled("image_url").desc(), filled("start_time").desc(), ordinal)


def strip_shared_listings(events: DataFrame, most: int = 3) -> DataFrame:
    """Listings (name, page) that `most` or more events have are taken off, but never an event's last."""
    flat = events.select("id", F.posexplode("listings").alias("at", "listing"))
    uses = flat.groupBy(F.col("listing.name").alias("n"), F.col("listing.page_url").alias("p")).agg(F.countDistinct("id").alias("uses"))
    shared = uses.filter(F.col("uses") >= most).select("n", "p", F.lit(True).alias("shared"))
    marked = flat.join(shared, F.col("listing.name").eqNullSafe(F.col("n")) & F.col("listing.page_url").eqNullSafe(F.col("p")), "left")
    packed = marked.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("at", "listing", F.coalesce("shared", F.lit(False)).alias("shared")))).alias("all"))
    kept = F.filter("all", lambda x: ~x["shared"])
    chosen = F.when(F.size(kept) > 0, kept).otherwise(F.slice("all", -1, 1))
    return events.drop("listings").join(packed.select("id", F.transform(chosen, lambda x: x["listing"]).alias("listings")), "id", "left")


def drop_shared_links(events: DataFrame, link: Column, ordinal: Column, most: int = 3) -> DataFrame:
    """Of `most` or more events with the same link only the fullest stays, judged on the input."""
    keyed = events.select("id", link.alias("link"), F.size("listings").alias("l"), F.size("distances").alias("d"), F.when(F.col("image_url").isNotNull(), 1).otherwise(0).alias("i"), ordinal.alias("o"))
    keyed = keyed.filter(F.col("link").isNotNull())
    many = keyed.groupBy("link").agg(F.countDistinct("id").alias("n"), F.max_by("id", F.struct("l", "d", "i", -F.col("o"))).alias("best")).filter(F.col("n") >= most)
    gone = keyed.join(many, "link").filter(F.col("id") != F.col("best")).select("id").distinct()
    return events.join(gone, "id", "left_anti")


def split_by_location(events: DataFrame, locations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Events whose country and subdivision are known, and the others."""
    keys = locations.select(F.col("country").alias("__c"), F.col("code").alias("__s")).distinct()
    same = (F.col("country") == F.col("__c")) & (F.col("subdivision") == F.col("__s"))
    return events.join(keys, same, "left_semi"), events.join(keys, same, "left_anti")
