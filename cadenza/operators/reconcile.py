"""Reconciliation of a new batch with the stored snapshot."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadenza.operators.components import forgotten, written
from cadenza.operators.resolve import PREPARED_FROM, confirmed, prepared, spans, united_distances, united_listings
from cadenza.operators.rules import violations
from cadenza.operators.similar import by_size, counted, met_rows, near_rows, representatives, same_day_rows, similar_rows
from cadenza.schema import RULES, Rules

#: Fields whose change makes an event updated (fixed values).
COMPARED = ("title", "event_date", "start_time", "location_text", "city", "subdivision", "distances", "image_url", "signup_open", "signup_window", "listings", "is_cancelled")

#: Pairs up to which the numbers of their rows are broadcast.
FEW_PAIRS = 500_000


def alive(status: DataFrame, events: DataFrame, rules: Rules = RULES) -> DataFrame:
    """(id, alive) of stored events; alive is null where no link has been looked at.

    status is (url, status); a null status is a failed connection. One good link is enough.
    """
    pages = F.flatten(F.transform("listings", lambda x: F.concat(F.array(x["page_url"]), F.coalesce(x["signup_urls"], F.array()))))
    links = events.select("id", F.explode_outer(F.array_distinct(F.filter(pages, lambda u: F.coalesce(u, F.lit("")) != ""))).alias("url"))
    looked = links.join(status.withColumn("looked", F.lit(True)), "url", "left")
    good = F.coalesce(F.col("status").isin(*rules.alive_status), F.lit(False))
    verdict = F.when(F.max(F.col("url").isNotNull()) & F.max("looked").isNull(), None).otherwise(F.bool_or(good))
    return looked.groupBy("id").agg(verdict.alias("alive"))


def updated(old: str, new: str) -> dict[str, Column]:
    """Each field of a stored event after an incoming one; title, id, city and listings are replaced, blanks fill, a cancellation stays."""
    o, n = (lambda c: F.col(f"{old}.{c}")), (lambda c: F.col(f"{new}.{c}"))
    text = lambda c: F.when(F.coalesce(n(c), F.lit("")) != "", n(c)).otherwise(o(c))
    known = ~F.coalesce(n("country"), F.lit("")).isin("", "??", "INT")
    moved = F.coalesce(n("country") != o("country"), F.lit(False)) & known
    return {
        "id": n("id"),
        "title": n("title"),
        "city": n("city"),
        "country": F.when(known, n("country")).otherwise(o("country")),
        "subdivision": F.when(moved, n("subdivision")).otherwise(text("subdivision")),
        "event_date": F.coalesce(n("event_date"), o("event_date")),
        "start_time": text("start_time"),
        "location_text": text("location_text"),
        "distances": F.when(F.coalesce(F.size(n("distances")), F.lit(0)) > 0, n("distances")).otherwise(o("distances")),
        "image_url": text("image_url"),
        "signup_open": F.coalesce(n("signup_open"), o("signup_open")),
        "signup_window": F.coalesce(n("signup_window"), o("signup_window")),
        "listings": n("listings"),
        "is_cancelled": F.coalesce(o("is_cancelled"), F.lit(False)) | F.coalesce(n("is_cancelled"), F.lit(False)),
        "miss_count": F.lit(0),
    }


def changed(old: str, fields: dict[str, Column]) -> Column:
    """R2: any compared field differs."""
    out = F.lit(False)
    for c in COMPARED:
        out = out | ~fields[c].eqNullSafe(F.col(f"{old}.{c}"))
    return out


def matches(new: DataFrame, stored: DataFrame, generic: DataFrame | None = None, rules: Rules = RULES) -> DataFrame:
    """(n, s): ordinal of each incoming row that has one and of the stored row it updates.

    By id first; else the first stored row in order that is a duplicate, whether or not another incoming row has its id.
    """
    by_id = new.select("id", F.col("ordinal").alias("n")).join(stored.select("id", F.col("ordinal").alias("s")), "id").groupBy("n").agg(F.min("s").alias("s"))
    by_id = written(by_id, "by_id")
    rest = written(new.select(*PREPARED_FROM).join(by_id.select(F.col("n").alias("ordinal")), "ordinal", "left_anti"), "rest")
    # Each side is read by every way of finding pairs: it is written, rows that are alike in all that is compared as one.
    sides = [representatives(prepared(x, generic=generic, rules=rules), counted()) for x in (rest, stored)]
    a, b = (reps for reps, _ in sides)
    # One way at a time: what one has shuffled is gone before the next begins.
    ways = [written(way(a, b, rules), "way") for way in (with_a_link, near_days, same_day_apart, undated)]
    found = written(looked_up(reduce(DataFrame.union, ways), a, b, rules).groupBy("a").agg(F.min("b").alias("s")), "found")
    copies = sides[0][1].join(found, F.col("rep") == F.col("a")).select(F.col("ordinal").alias("n"), "s")
    out = written(by_id.union(found.select(F.col("a").alias("n"), "s")).union(copies), "matches")
    for table in (a, b, found, by_id, rest, *ways):
        forgotten(table)
    return out


def looked_up(pairs: DataFrame, a: DataFrame, b: DataFrame, rules: Rules = RULES) -> DataFrame:
    """(a, b): those of the pairs that the decision confirms. Where they are few, rows that are in none are left out before any is shuffled."""
    pairs = written(pairs.distinct(), "pairs")
    if pairs.count() <= FEW_PAIRS:
        a, b = (rows.join(F.broadcast(pairs.select(F.col(s).alias("ordinal")).distinct()), "ordinal", "left_semi") for rows, s in ((a, "a"), (b, "b")))
    return confirmed(pairs, a.drop(*counted()), rules, others=b.drop(*counted()))


def with_a_link(a: DataFrame, b: DataFrame, rules: Rules = RULES) -> DataFrame:
    """Incoming and stored rows with a link in common."""
    sides = (x.select(F.explode("links").alias("link"), F.col("ordinal").alias(name)) for x, name in ((a, "a"), (b, "b")))
    return next(sides).join(next(sides), "link").select("a", "b")


def near_days(a: DataFrame, b: DataFrame, rules: Rules = RULES) -> DataFrame:
    """Those of a subdivision within the band of days whose titles may be alike enough; spans of days, each row looks into three."""
    dated = lambda x: x.filter("day IS NOT NULL").withColumn("span", spans(F.col("day"), rules.band_days))
    one, two = dated(a), dated(b)
    wide = one.withColumn("span", F.explode(F.array(F.col("span") - 1, F.col("span"), F.col("span") + 1)))
    return near_rows(wide, two, ["sub", "span"], min(rules.close_similarity, rules.strict_similarity), rules.band_days, rules.same_day_similarity)


def same_day_apart(a: DataFrame, b: DataFrame, rules: Rules = RULES, country: str = "BR") -> DataFrame:
    """Those of one country and day in different subdivisions with titles that may be nearly equal."""
    some = lambda x: x.filter((F.col("country") == country) & F.col("day").isNotNull())
    return similar_rows(some(a), some(b), ["day"], rules.strict_similarity, "sub").filter("a_sub <> b_sub").select("a", "b")


def undated(a: DataFrame, b: DataFrame, rules: Rules = RULES) -> DataFrame:
    """Those of a subdivision of which one has no date, which the decision takes as near, with titles that may be alike enough."""
    least = min(rules.close_similarity, rules.strict_similarity)
    one = near_rows(a.filter("day IS NULL"), b, ["sub"], least)
    return one.union(near_rows(a.filter("day IS NOT NULL"), b.filter("day IS NULL"), ["sub"], least))


def reconcile(stored: DataFrame, new: DataFrame, link_status: DataFrame, as_of: Column, generic: DataFrame | None = None, rules: Rules = RULES) -> DataFrame:
    """The next snapshot, with `outcome` telling what happened to each row.

    Both inputs have the columns of an event and `ordinal`. Matched rows are updated or kept as
    they are; unmatched incoming ones are inserted. Of unmatched stored rows, past ones stay,
    invalid ones go, twins of a row that stays are absorbed, and for the others the links decide:
    alive resets the misses, dead counts one and drops the row at the limit, not looked at leaves
    it alone.
    """
    columns = [c for c in stored.columns if c != "ordinal"]
    # Both sides are read by many jobs; how they are made is planned and done in one each, and no later plan holds it.
    stored, new = written(stored, "stored"), written(new, "new")
    every = matches(new, stored, generic, rules)
    # Rows of each side are shuffled once. Of several incoming rows with one stored row the last counts.
    last = F.max("n").over(Window.partitionBy("s"))
    met = new.join(every.select(F.col("n").alias("ordinal"), "s", (F.col("n") == last).alias("last")), "ordinal", "left")
    met = written(met.filter(F.coalesce("last", F.lit(True))).drop("last"), "met")
    forgotten(new)
    o, n = stored.alias("o"), met.filter("s IS NOT NULL").alias("n")
    fields = updated("o", "n")
    found, differs = F.col("n.ordinal").isNotNull(), changed("o", fields)
    value = lambda c: F.when(differs, F.current_timestamp()).otherwise(F.col("o.updated_at")) if c == "updated_at" else fields.get(c, F.col(f"o.{c}"))
    placed = o.join(n, F.col("o.ordinal") == F.col("n.s"), "left")
    placed = placed.select(*(F.when(found, value(c)).otherwise(F.col(f"o.{c}")).alias(c) for c in columns), F.when(found & differs, "updated").when(found, "kept").alias("outcome"), F.coalesce("n.ordinal", "o.ordinal").alias("ordinal"))
    # Only rows that no other case takes are held against the rules; those that break one have no outcome.
    rest = F.when(F.coalesce(F.col("event_date") < as_of, F.lit(False)), "past").when(F.size(violations(placed)) == 0, "ahead")
    placed = written(placed.withColumn("outcome", F.coalesce("outcome", rest)), "placed")
    for table in (stored, every):
        forgotten(table)
    # Twins go into the rows that stay, as these are now.
    present = placed.filter(F.col("outcome").isin("updated", "kept")).unionByName(met.filter("s IS NULL").select(*columns, F.lit("inserted").alias("outcome"), "ordinal"))
    past, ahead = placed.filter("outcome = 'past'"), placed.filter("outcome = 'ahead'").drop("outcome")
    twins = absorbed(ahead, present, generic, rules)
    present = with_twins(present, ahead.join(twins, ahead["ordinal"] == twins["twin"])).drop("ordinal")
    ahead = ahead.join(twins.select(F.col("twin").alias("ordinal")), "ordinal", "left_anti").join(alive(link_status, ahead, rules), "id", "left")
    misses = F.when(F.col("alive"), 0).when(~F.col("alive"), F.coalesce("miss_count", F.lit(0)) + 1).otherwise(F.coalesce("miss_count", F.lit(0)))
    checked = ahead.withColumn("miss_count", misses.cast("int")).filter(F.col("miss_count") < rules.drop_after_misses)
    outcome = F.when(F.col("alive"), "alive").when(~F.col("alive"), "missed").otherwise("deferred")
    return present.unionByName(past.select(*columns, "outcome")).unionByName(checked.select(*columns, outcome.alias("outcome")))


def absorbed(stored: DataFrame, kept: DataFrame, generic: DataFrame | None, rules: Rules = RULES) -> DataFrame:
    """(twin, into): ordinals of stored rows that are a twin, same day and subdivision, of a row that stays, the first such row."""
    none = F.lit("0001-01-01").cast("date")
    sides = [representatives(prepared(x, generic=generic, rules=rules)) for x in (stored, kept)]
    a, b = (reps.withColumn("on_day", F.coalesce("day", none)) for reps, _ in sides)
    on = ["sub", "on_day"]
    # In small groups all rows meet, without their titles.
    small, large = by_size(a, b, on)
    pairs = met_rows(*small, on).select("a", "b")
    if large:
        pairs = pairs.union(same_day_rows(*large, on, min(rules.same_day_similarity, rules.close_similarity, rules.strict_similarity)))
    links = a.select(*on, F.explode("links").alias("link"), F.col("ordinal").alias("a")).join(b.select(*on, F.explode("links").alias("link"), F.col("ordinal").alias("b")), [*on, "link"]).select("a", "b")
    found = looked_up(pairs.union(links), a.drop("on_day"), b.drop("on_day"), rules)
    found = written(found.groupBy("a").agg(F.min("b").alias("into")), "found")
    copies = sides[0][1].join(found, F.col("rep") == F.col("a")).select(F.col("ordinal").alias("twin"), "into")
    out = written(found.select(F.col("a").alias("twin"), "into").union(copies), "twins")
    for table in (a, b, found):
        forgotten(table)
    return out


def with_twins(kept: DataFrame, twins: DataFrame) -> DataFrame:
    """Rows that stay take in what their twins (rows with `into`) have: listings, distances, and what they lack."""
    fill = ("image_url", "signup_open", "signup_window")
    order = F.struct("ordinal")
    gathered = twins.groupBy("into").agg(
        F.array_sort(F.collect_list(F.struct("ordinal", "listings", "distances"))).alias("__twins"),
        *(F.min_by(c, F.when(F.col(c).isNotNull(), order)).alias(f"__{c}") for c in fill),
        F.bool_or(F.coalesce("is_cancelled", F.lit(False))).alias("__cancelled"),
    )
    rows = kept.join(gathered, kept["ordinal"] == gathered["into"], "left")
    several = F.col("into").isNotNull()
    lists = lambda c: F.concat(F.array(c), F.transform("__twins", lambda x: x[c]))
    new = {c: F.coalesce(F.col(c), F.col(f"__{c}")) for c in fill}
    new |= {"listings": F.when(several, united_listings(lists("listings"))).otherwise(F.col("listings")), "distances": F.when(several, united_distances(lists("distances"))).otherwise(F.col("distances"))}
    new["is_cancelled"] = F.coalesce("is_cancelled", F.lit(False)) | F.coalesce("__cancelled", F.lit(False))
    return rows.withColumns(new).select(*kept.columns)


def selective_patch(stored: DataFrame, patch: DataFrame, key: str = "id") -> DataFrame:
    """Rows of the patch replace stored ones of the same key, the rest stays, new ones are added."""
    rows = stored.join(patch.select(key), key, "left_anti")
    return rows.unionByName(patch, allowMissingColumns=True)


def blank_filled(stored: DataFrame, facts: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Blanks filled from facts, nothing overwritten."""
    other = facts.select(F.col(key).alias("__k"), *(F.col(c).alias(f"__{c}") for c in columns))
    joined = stored.join(other, F.col(key) == F.col("__k"), "left")
    fill = {c: F.coalesce(F.when(F.col(c).cast("string") != "", F.col(c)), F.col(f"__{c}")) for c in columns}
    return joined.withColumns(fill).select(*stored.columns)
