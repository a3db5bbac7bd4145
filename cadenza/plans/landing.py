"""Queries over payloads that are landed first, made from whole tables: with bad records, broken files, months that are rewritten."""

from __future__ import annotations

from functools import reduce

import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cadenza.functions.text import by_name
from cadenza.operators import enrich, search
from cadenza.operators.archive import Archive
from cadenza.operators.components import shared_path
from cadenza.plans.events import table
from cadenza.plans.records import AS_OF, EV, made_events, pick
from cadenza.sources import landed, readers

#: A payload in so many is cut short.
CUT = 50


def snapshot_decoded(spark: SparkSession, sf: str) -> DataFrame:
    """Payloads of some hundred records, some with a text for a number, some without an id, some payloads cut short, some ids twice."""
    k = F.col("ordinal")
    e = made_events(spark, sf).drop("c").withColumn("id", F.when(k % 11 != 0, F.col("id")))
    again = e.filter(k % 10 == 0).withColumn("listings", F.slice("listings", 1, 0))
    both = e.withColumn("copy", F.lit(0)).unionByName(again.withColumn("copy", F.lit(1)))
    text = F.to_json(F.struct(*(c for c in e.columns if c != "ordinal")))
    text = F.when(k % 7 == 0, F.regexp_replace(text, '"miss_count":([0-9]+)', '"miss_count":"abc$1"')).otherwise(text)
    group = F.floor(k / 400)
    payload = both.groupBy(group.alias("g")).agg(F.array_sort(F.collect_list(F.struct("copy", "ordinal", text.alias("text")))).alias("x"))
    value = F.concat(F.lit('{"events":['), F.array_join(F.col("x.text"), ","), F.lit("]}"))
    path = shared_path(spark, "payloads")
    payload.select(F.when(F.col("g") % CUT == 7, F.substring(value, 1, 300)).otherwise(value).alias("value")).write.text(path)
    _, bad = readers.snapshot_records(spark, path, multi_line=False)
    good = readers.read_snapshot(spark, path, multi_line=False).select(F.lit("good").alias("kind"), "id", F.size("listings").cast("long").alias("n"))
    what = F.when(F.col("place").isNull(), "payload").otherwise(F.col("reason"))
    return good.union(bad.groupBy(F.lit("bad").alias("kind"), what.alias("id")).agg(F.count(F.lit(1)).alias("n")))


def landed_sources(spark: SparkSession, sf: str) -> DataFrame:
    """Sources in folders of their own, with broken lines and one source that cannot be opened; what can be read stays, and upcoming or undated records are asked for."""
    k = F.col("ordinal")
    e = made_events(spark, sf).select(F.concat(F.lit("s"), F.col("c") % 4).alias("source"), k, F.to_json(F.struct("id", F.col("event_date").alias("date"))).alias("value"))
    path = shared_path(spark, "landed")
    e.select("source", F.when(k % 97 == 0, F.substring("value", 1, 6)).otherwise(F.col("value")).alias("value")).write.partitionBy("source").text(path)
    fs, top = pyarrow.fs.FileSystem.from_uri(path)
    fs.create_dir(f"{top}/source=broken")
    with fs.open_output_stream(f"{top}/source=broken/part.json.gz", compression=None) as out:
        out.write(b"this is not compressed")
    count = lambda df, name: df.groupBy("source").agg(F.count("record").alias(name), F.count("error").alias(f"{name}_bad"))
    return count(landed.read_landed(spark, path), "n").join(count(landed.upcoming(spark, path, AS_OF), "ahead"), "source")


def archive_months(spark: SparkSession, sf: str) -> DataFrame:
    """An archive in months, a batch that rewrites those that it touches and a batch that comes twice; what is read back, and whether other months kept their files."""
    e = made_events(spark, sf).select("ordinal", "id", "event_date", "miss_count")
    archive = Archive(spark, shared_path(spark, "archive"))
    archive.upsert(e.filter("ordinal % 2 = 0"), batch=0)
    before = archive.manifest()["months"]
    few = e.filter("ordinal % 3 = 0 AND (event_date BETWEEN DATE'1996-03-01' AND DATE'1996-05-31' OR event_date IS NULL)")
    for _ in range(2):
        archive.upsert(few.withColumn("miss_count", F.col("miss_count") + 100), F.col("ordinal"), 1)
    after = archive.manifest()["months"]
    same = [m for m in before if before[m] == after[m]]
    return archive.read().select("id", "miss_count", "event_month", F.col("event_month").isin(same).alias("untouched"))


def locations_again(spark: SparkSession, sf: str) -> DataFrame:
    """Nations with the market segments of their customers as reference files, one a nation, and read again."""
    c = table(spark, sf, "customer").join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    places = c.select(F.concat(F.lit("N"), "n_nationkey").alias("country"), F.col("n_name").alias("country_name"), F.substring("c_mktsegment", 1, 3).alias("code"), F.col("c_mktsegment").alias("name")).distinct()
    path = shared_path(spark, "locations")
    readers.write_locations(places, path)
    return readers.read_locations(spark, path)


def cache_merged(spark: SparkSession, sf: str) -> DataFrame:
    """Cached lookups of customers' cities, some with a country and some without, after newer ones have come."""
    k = F.col("c_custkey")
    entry = lambda rows, value: rows.select(F.concat(F.lit("city"), k % 500).alias("key"), F.when(k % 2 == 0, F.lit("BR")).alias("hint_country"), value.cast("long").alias("found"))
    c = table(spark, sf, "customer")
    new = entry(c.filter("c_custkey % 1000 < 150 OR c_custkey % 1000 >= 900"), k % 7 + 100).groupBy("key", "hint_country").agg(F.max("found").alias("found"))
    old = entry(c.filter("c_custkey % 500 < 400"), k % 7).groupBy("key", "hint_country").agg(F.max("found").alias("found"))
    return enrich.merged_cache(old, new, ["key", "hint_country"])


def feeds_read(spark: SparkSession, sf: str) -> DataFrame:
    """A landed answer of a knowledge graph, an empty one for which the cache stands in, and calendar pages with embedded data."""
    n = table(spark, sf, "nation")
    cell = lambda c: F.struct(c.alias("value"))
    binding = F.struct(cell(F.col("n_name")).alias("raceLabel"), cell(F.when(F.col("n_nationkey") % 5 != 0, F.substring("n_name", 1, 2)).otherwise("")).alias("iso"))
    answer = n.groupBy("n_regionkey").agg(F.collect_list(binding).alias("bindings")).select(F.to_json(F.struct(F.struct("bindings").alias("results"))).alias("value"))
    cached = table(spark, sf, "region").select(F.col("r_name").alias("name"), F.lit("XX").alias("country"))
    empty = answer.select(F.lit('{"results":{"bindings":[]}}').alias("value"))
    k = F.col("o_orderkey")
    item = F.struct(F.concat(F.lit("Corrida x"), k).alias("name"), pick(("Gold Label", "elite label", "none"), k % 3).alias("competitionSubgroup"), F.concat(F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("T08:00:00")).alias("startDate"), pick(("bra", "USA", "zzz"), k % 4).alias("countryCode"), F.lit("Praia, BRA").alias("venue"), F.when(k % 2 == 0, "Praia").otherwise("").alias("venueWithoutCountry"))
    data = F.to_json(F.struct(F.struct(F.struct(F.struct(F.col("results")).alias("calendarEvents")).alias("pageProps")).alias("props")))
    pages = table(spark, sf, "orders").groupBy(F.floor(k / 200).alias("page")).agg(F.collect_list(item).alias("results"))
    pages = pages.select(F.concat(F.lit('<html><script id="other">{}</script><script id="__NEXT_DATA__" type="application/json">'), data, F.lit("</script></html>")).alias("html"))
    labels = enrich.labels_feed(pages, {"gold label": "gold", "elite label": "elite"}, {"BRA": "BR", "USA": "US"})
    row = lambda df, kind: df.select(F.lit(kind).alias("kind"), "name", "country", F.lit("").alias("more"))
    told = labels.select(F.lit("label").alias("kind"), F.col("name_norm").alias("name"), "country", F.concat_ws("/", "city_norm", F.date_format("date", "yyyy-MM-dd"), "tier").alias("more"))
    return row(enrich.majors_feed(answer, cached), "fresh").union(row(enrich.majors_feed(empty, cached), "cached")).union(told)


#: Labels in an order that neither bytes nor folded letters give.
LABELS = ("Zé", "água", "Abril", "élan", "Eco", "zebra", "Ábaco", "banco")


def labels_in_order(spark: SparkSession, sf: str) -> DataFrame:
    """How many parts have each label, and the label's place as a language sorts them."""
    p = table(spark, sf, "part").groupBy(pick(LABELS, F.col("p_partkey") % len(LABELS)).alias("label")).agg(F.count(F.lit(1)).alias("n"))
    # One row a label is ranked.
    return p.withColumn("place", F.row_number().over(Window.orderBy(by_name(F.col("label")))).cast("long"))


def default_filters(spark: SparkSession, sf: str) -> DataFrame:
    """What a visitor of each country that is to be had sees first: the filters after its default, whether they count as set, and the records."""
    e = made_events(spark, sf)
    available = sorted(r[0] for r in e.select("country").distinct().collect())  # a row a country
    first = {"country": "all", "sources": []}
    out = []
    for asked, touched in (("BR", False), ("US", False), ("FR", False), ("US", True)):
        filters = search.with_default(first, "country", asked, available, touched)
        rows = e.filter(search.in_location(F.col("country"), F.col("subdivision"), "todos" if filters["country"] == "all" else f"{filters['country']}:"))
        out.append(rows.agg(F.count(F.lit(1)).alias("n")).select(F.lit(asked).alias("asked"), F.lit(touched).alias("touched"), F.lit(search.any_filter_active(filters, first)).alias("active"), "n"))
    return reduce(DataFrame.union, out)


SQL = {
    "locations_again": "SELECT DISTINCT 'N' || n_nationkey AS country, n_name AS country_name, left(c_mktsegment, 3) AS code, c_mktsegment AS name FROM customer JOIN nation ON c_nationkey = n_nationkey",
    "cache_merged": """WITH c AS (SELECT 'city' || c_custkey % 500 AS key, CASE WHEN c_custkey % 2 = 0 THEN 'BR' END AS hint_country, c_custkey AS k FROM customer),
        n AS (SELECT key, hint_country, max(k % 7 + 100) AS found FROM c WHERE k % 1000 < 150 OR k % 1000 >= 900 GROUP BY 1, 2), o AS (SELECT key, hint_country, max(k % 7) AS found FROM c WHERE k % 500 < 400 GROUP BY 1, 2)
        SELECT * FROM n UNION ALL SELECT o.* FROM o WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.key = o.key AND n.hint_country IS NOT DISTINCT FROM o.hint_country)""",
    "feeds_read": """SELECT 'fresh' AS kind, n_name AS name, left(n_name, 2) AS country, '' AS more FROM nation WHERE n_nationkey % 5 <> 0
        UNION ALL SELECT 'cached', r_name, 'XX', '' FROM region
        UNION ALL SELECT 'label', 'x' || o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'BR' WHEN 1 THEN 'US' ELSE '' END, CASE WHEN o_orderkey % 2 = 0 THEN 'praia/' ELSE 'praia bra/' END || strftime(CAST(o_orderdate AS DATE), '%Y-%m-%d') || CASE o_orderkey % 3 WHEN 0 THEN '/gold' ELSE '/elite' END FROM orders WHERE o_orderkey % 3 < 2""",
    "labels_in_order": """SELECT label, count(*) AS n, list_position(['Ábaco', 'Abril', 'água', 'banco', 'Eco', 'élan', 'Zé', 'zebra'], label)::BIGINT AS place
        FROM (SELECT ['Zé', 'água', 'Abril', 'élan', 'Eco', 'zebra', 'Ábaco', 'banco'][p_partkey % 8 + 1] AS label FROM part) GROUP BY label""",
    "default_filters": f"""WITH {EV}, a AS (SELECT * FROM (VALUES ('BR', false), ('US', false), ('FR', false), ('US', true)) t(asked, touched)), h AS (SELECT DISTINCT country FROM ev),
        b AS (SELECT *, NOT touched AND asked IN (SELECT country FROM h) AS active FROM a)
        SELECT asked, touched, active, (SELECT count(*) FROM ev WHERE NOT active OR country = asked) AS n FROM b""",
    "snapshot_decoded": f"""WITH {EV}, p AS (SELECT k, two, k // 400 AS g, (k // 400) % {CUT} = 7 AS lost, CASE WHEN k % 10 = 0 THEN 2 ELSE 1 END AS copies FROM ev)
        SELECT 'good' AS kind, 'e' || k AS id, CAST(CASE WHEN two THEN 2 ELSE 1 END AS BIGINT) AS n FROM p WHERE NOT lost AND k % 7 <> 0 AND k % 11 <> 0
        UNION ALL SELECT 'bad', CASE WHEN k % 7 = 0 THEN 'json' ELSE 'no_id' END, CAST(sum(copies) AS BIGINT) FROM p WHERE NOT lost AND (k % 7 = 0 OR k % 11 = 0) GROUP BY 2
        UNION ALL SELECT 'bad', 'payload', count(DISTINCT g) FROM p WHERE lost HAVING count(*) > 0""",
    "archive_months": f"""WITH {EV}, p AS (SELECT id, k, CAST(k % 10 AS INTEGER) AS misses, coalesce(strftime(event_date, '%Y-%m'), 'undated') AS event_month, k % 3 = 0 AND coalesce(event_date BETWEEN DATE '1996-03-01' AND DATE '1996-05-31', true) AS again FROM ev),
        t AS (SELECT DISTINCT event_month FROM p WHERE again)
        SELECT id, misses + CASE WHEN again THEN 100 ELSE 0 END AS miss_count, event_month, event_month NOT IN (SELECT event_month FROM t) AS untouched FROM p WHERE k % 2 = 0 OR again""",
    "landed_sources": f"""WITH {EV}, p AS (SELECT source, k % 97 <> 0 AS good, event_date IS NULL OR event_date >= DATE '{AS_OF}' AS ahead FROM ev)
        SELECT source, count(*) FILTER (good) AS n, count(*) FILTER (NOT good) AS n_bad, count(*) FILTER (good AND ahead) AS ahead, count(*) FILTER (NOT good) AS ahead_bad FROM p GROUP BY source
        UNION ALL SELECT 'broken', 0, 1, 0, 1""",
}
QUERIES = {name: globals()[name] for name in SQL}
