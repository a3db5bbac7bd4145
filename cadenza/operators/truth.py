"""Checks of stored events against facts of their own pages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.functions.dates import date_candidates
from cadenza.functions.structured import city_code_pairs, json_ld_blocks, json_ld_events


def page_facts(pages: DataFrame, codes: list[str], least: int = 3) -> DataFrame:
    """(id, regions, dates) of landed pages (id, html).

    Regions come from the page's event data; without any, from 'City - XX' patterns, if three or
    more say the same and none another.
    """
    known = F.array(*map(F.lit, codes))
    events = json_ld_events(json_ld_blocks(F.col("html")))
    rows = pages.select("id", "html", events.alias("events"))
    region = lambda e: F.concat(F.array(F.upper(e["region"])), city_code_pairs(F.concat_ws(" ", e["place"], e["city"])))
    stated = F.array_intersect(F.array_distinct(F.flatten(F.transform("events", region))), known)
    pairs = F.filter(city_code_pairs(F.col("html")), lambda c: F.array_contains(known, c))
    seen = F.array_distinct(pairs)
    dominant = F.when((F.size(pairs) >= least) & (F.size(seen) == 1), seen).otherwise(F.array().cast("array<string>"))
    starts = F.array_compact(F.transform("events", lambda e: F.try_to_date(F.substring(e["start"], 1, 10), "yyyy-MM-dd")))
    return rows.select("id", F.when(F.size(stated) > 0, stated).otherwise(dominant).alias("regions"), F.when(F.size(starts) > 0, starts).otherwise(date_candidates(F.col("html"))).alias("dates"))


def check_truth(events: DataFrame, facts: DataFrame) -> DataFrame:
    """R16: 'error' where the page's regions leave out the stored one, 'warning' where its dates do, else 'ok'."""
    rows = events.select("id", "subdivision", "event_date").join(facts, "id")
    wrong_region = (F.size("regions") > 0) & ~F.array_contains("regions", F.col("subdivision"))
    wrong_date = (F.size("dates") > 0) & ~F.coalesce(F.array_contains("dates", F.col("event_date")), F.lit(False))
    return rows.select("id", F.when(F.coalesce(wrong_region, F.lit(False)), "error").when(wrong_date, "warning").otherwise("ok").alias("verdict"), "regions", "dates")
