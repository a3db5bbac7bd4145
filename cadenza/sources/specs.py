"""Specifications of the largest sources: in which form each one's payloads land, and where its fields are.

A payload is what the source gave, as it came: an answer of its search interface, or a page with
schema.org data. A further source is a further entry.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.operators.listings import grouped_documents
from cadenza.sources.parsers import Spec, parse_html_cards, parse_json_feed, parse_json_ld
from cadenza.sources.readers import read_pages
from cadenza.sources.registry import Registry


@dataclass(frozen=True)
class Form:
    """How payloads of a source are parsed; prepare turns them into what the parser takes."""

    parse: Callable[..., DataFrame]
    spec: Spec
    prepare: Callable[[DataFrame], DataFrame] | None = None

    def events(self, payloads: DataFrame) -> DataFrame:
        """Event columns and source_seq of landed payloads (column html)."""
        rows = payloads if self.prepare is None else self.prepare(payloads)
        return self.parse(rows, self.spec, "html")


def hits_by_event(payloads: DataFrame) -> DataFrame:
    """Answers of a search index, one document a race, as one feed item an event: its first document with all lengths in km."""
    hit = "array<struct<document:struct<eventId:string,eventName:string,raceDistance:double,raceDistanceUnit:string,editionStartDate:string,city:string,countryCode:string,level1:string,slug:string,image:string,raceDate:bigint>>>"
    docs = payloads.select(F.explode(F.from_json(F.get_json_object("html", "$.results[0].hits"), hit)).alias("h")).select("h.document.*").filter("eventId IS NOT NULL AND raceDistance > 0")
    miles = F.lower(F.coalesce("raceDistanceUnit", F.lit("meters"))).rlike("mi")
    km = F.when(~miles, F.round(F.when(F.col("raceDistance") > 500, F.col("raceDistance") / 1000).otherwise(F.col("raceDistance")), 3))
    rows = docs.withColumn("km", F.when(km.between(1, 300), km)).withColumn("order", F.struct("raceDate", "raceDistance")).withColumn("time", F.lit(None).cast("string"))
    events = grouped_documents(rows.drop("raceDistance", "raceDistanceUnit", "raceDate"), "eventId", "order", "km", "time")
    told = F.array_join(F.transform("kms", lambda x: F.concat(x.cast("string"), F.lit(" km"))), ", ")
    return events.select(F.to_json(F.struct("eventId", "eventName", "editionStartDate", "city", "countryCode", "level1", "slug", "image", told.alias("kms"))).alias("html"))


FORMS: dict[str, Form] = {
    "finishers": Form(parse_json_feed, Spec("finishers", {"id": "$.eventId", "title": "$.eventName", "date": "$.editionStartDate", "city": "$.city", "subdivision": "$.level1", "country": "$.countryCode", "page": "$.slug", "image": "$.image", "distances": "$.kms"}, base_url="https://www.finishers.com/en/event/"), hits_by_event),
    "runsignup": Form(parse_json_feed, Spec("runsignup", {"id": "$.race.race_id", "title": "$.race.name", "date": "$.race.next_date", "time": "$.race.events[0].start_time", "city": "$.race.address.city", "subdivision": "$.race.address.state", "country": "$.race.address.country_code", "page": "$.race.url", "signup": "$.race.url", "image": "$.race.logo_url", "distances": "$.race.events[*].distance"}, kind="signup", rows="$.races", constants={"country": "US"}, month_first=True)),
    "raceroster": Form(parse_json_feed, Spec("raceroster", {"id": "$.eventId", "title": "$.name", "date": "$.date", "city": "$.location.city", "subdivision": "$.location.province.abbreviation", "country": "$.location.countryISO", "page": "$.url", "signup": "$.url", "image": "$.logo", "distances": "$.distances"}, kind="signup", rows="$.data", constants={"country": "US"})),
    "tf_sports": Form(parse_json_feed, Spec("tf_sports", {"id": "$.id", "title": "$.attributes.title", "date": "$.attributes.date", "city": "$.attributes.city", "subdivision": "$.attributes.state", "page": "$.attributes.slug", "signup": "$.attributes.slug"}, kind="signup", rows="$.data", constants={"country": "BR"}, base_url="https://www.tfsports.com.br/evento/")),
    "ticket_sports": Form(parse_json_feed, Spec("ticket_sports", {"id": "$.id", "title": "$.title", "date": "$.date", "place": "$.address", "city": "$.city", "subdivision": "$.state", "page": "$.uri", "signup": "$.uri", "image": "$.image"}, kind="signup", rows="$.events", constants={"country": "BR"}, base_url="https://www.ticketsports.com.br")),
    # A table: date, city, name with link, lengths.
    "brazil_table": Form(parse_html_cards, Spec("brazil_table", {"id": r"[?&]c=(\d+)", "title": r"<a[^>]*>\s*([^<]+)", "date": r"<td[^>]*>\s*(\d{1,2}/\d{1,2}/\d{2,4})", "city": r"(?s)^(?:.*?<td[^>]*>){2}\s*([^<]+)", "page": r'href="([^"]+)"', "distances": r"(?s)^(?:.*?<td[^>]*>){4}\s*([^<]+)"}, rows=r'<tr height="35"', constants={"country": "BR"})),
    "worldsmarathons": Form(parse_json_ld, Spec("worldsmarathons", {})),
    "usroadrunning": Form(parse_json_ld, Spec("usroadrunning", {}, kind="organizer", constants={"country": "US"})),
    "atletis": Form(parse_json_ld, Spec("atletis", {}, kind="signup", constants={"country": "BR"})),
    "brazil_portal": Form(parse_json_ld, Spec("brazil_portal", {}, constants={"country": "BR"})),
}


def landed_sources(root: str, names: list[str] | None = None) -> Registry:
    """A registry of the sources whose payloads lie in folders of their names under root."""
    out = Registry()
    for name in names or FORMS:
        out.register_source(name, f"{root.rstrip('/')}/{name}", lambda spark, path: read_pages(spark, path), FORMS[name].events)
    return out


def events_of(spark: SparkSession, root: str, names: list[str] | None = None) -> tuple[DataFrame | None, dict[str, str]]:
    """Events of all landed sources in one table with `source` and `ordinal`, and the sources that could not be opened."""
    return landed_sources(root, names).read(spark, names)
