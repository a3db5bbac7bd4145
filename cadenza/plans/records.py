"""Queries over event records made from the orders table: rules, publishing, merging, reconciliation, enrichment, display."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.functions.distance import km_key
from cadenza.functions.text import title_key
from cadenza.operators import display, enrich, gazetteer, health, listings, publish, quality, reconcile, resolve, rules, search
from cadenza.plans.events import day, table
from cadenza.schema import DISTANCE, LISTING, SIGNUP_WINDOW

AS_OF = "1996-06-01"
WORDS = ("alpha", "brava", "costa", "delta", "estrela", "flores")
PARTS = ("norte", "sul", "leste", "oeste", "centro")
SUBS = ("SP", "RJ", "MG", "RS", "XX")
KMS = (5.0, 10.0, 21.097, 42.195, 7.5)
KINDS = ("signup", "organizer", "calendar")


def pick(values: tuple, k: Column) -> Column:
    return F.get(F.array(*map(F.lit, values)), k.cast("int"))


def made_events(spark: SparkSession, sf: str) -> DataFrame:
    """An event record for each order; EV is the same in SQL."""
    k, c, d = F.col("o_orderkey"), F.col("o_custkey"), F.to_date("o_orderdate")
    text = lambda *x: F.concat(*(F.lit(v) if isinstance(v, str) else v.cast("string") for v in x))
    word, part, sub = pick(WORDS, k % 6), pick(PARTS, c % 5), pick(SUBS, k % 5)
    none = lambda kind: F.lit(None).cast(kind)
    title = F.when(k % 11 == 0, text("Pedal ", word)).when(k % 13 == 0, text("Kids Run ", word)).when(k % 17 == 0, "Tio").when(k % 19 == 0, "Home").otherwise(text("Corrida ", word, " ", part, " 2024"))
    one = lambda km, label, date: F.struct(km.cast("double").alias("km"), label.cast("string").alias("label"), date.cast("date").alias("date"), none("string").alias("start_time"))
    lengths = F.when(k % 37 == 0, F.array().cast(f"array<{DISTANCE}>")).when(k % 4 == 0, F.array(one(F.lit(None), F.lit("10 mi"), F.lit(None)), one(pick(KMS, k % 5), F.lit(None), d))).otherwise(F.array(one(pick(KMS, k % 5), F.lit(None), d)))
    source = text("s", c % 4)
    listing = lambda name, page, urls, kind: F.struct(name.alias("name"), page.alias("page_url"), urls.cast("array<string>").alias("signup_urls"), kind.alias("kind"))
    first = listing(source, text("https://", source, ".com/", k), F.when(k % 2 == 0, F.array(text("https://t.com/", k % 500))).otherwise(F.array()), pick(KINDS, k % 3))
    second = listing(F.lit("agg"), text("https://agg.com/", k), F.array(), F.lit("calendar"))
    fields = {
        "ordinal": k, "id": text("e", k), "title": title, "event_date": F.when(k % 23 != 0, d), "start_time": F.when(k % 5 != 0, text(F.lpad((k % 24).cast("string"), 2, "0"), ":30")),
        "location_text": F.when(k % 29 == 0, "").otherwise(text(part, ", ", sub)), "city": F.when(k % 7 == 0, "").otherwise(part), "subdivision": sub, "country": F.when(k % 31 == 0, "??").when(k % 3 == 0, "US").otherwise("BR"),
        "distances": lengths, "image_url": F.when(k % 2 == 0, text("https://img.", source, ".com/a.jpg")), "signup_open": F.when(k % 3 == 0, True).when(k % 3 == 1, False),
        "signup_window": F.when(k % 4 == 0, F.struct(F.date_sub(d, 30).alias("opens"), F.date_sub(d, 1).alias("closes"))).cast(SIGNUP_WINDOW),
        "listings": F.when(k % 6 == 0, F.array(first, second)).otherwise(F.array(first)).cast(f"array<{LISTING}>"),
        "miss_count": (k % 10).cast("int"), "first_seen_at": d.cast("timestamp"), "updated_at": d.cast("timestamp"), "label_tier": F.when(k % 41 == 0, "gold"), "is_major": k % 43 == 0, "is_cancelled": k % 47 == 0,
    }
    return table(spark, sf, "orders").select(*(v.alias(n) for n, v in fields.items()), c.alias("c"))


def _list(values: tuple) -> str:
    return "[" + ", ".join(f"'{v}'" if isinstance(v, str) else str(v) for v in values) + "]"


EV = f"""ev AS (SELECT *, 'e' || k AS id,
  CASE WHEN k % 11 = 0 THEN 'Pedal ' || w WHEN k % 13 = 0 THEN 'Kids Run ' || w WHEN k % 17 = 0 THEN 'Tio' WHEN k % 19 = 0 THEN 'Home' ELSE 'Corrida ' || w || ' ' || part || ' 2024' END AS title,
  CASE WHEN k % 23 <> 0 THEN d END AS event_date, CASE WHEN k % 5 <> 0 THEN lpad(CAST(k % 24 AS VARCHAR), 2, '0') || ':30' END AS start_time,
  CASE WHEN k % 29 = 0 THEN '' ELSE part || ', ' || subdivision END AS location_text, CASE WHEN k % 7 = 0 THEN '' ELSE part END AS city,
  CASE WHEN k % 31 = 0 THEN '??' WHEN k % 3 = 0 THEN 'US' ELSE 'BR' END AS country, k % 37 <> 0 AS has_km, k % 37 <> 0 AND k % 4 = 0 AS has_mi,
  's' || c % 4 AS source, CASE WHEN k % 2 = 0 THEN 'https://img.s' || c % 4 || '.com/a.jpg' END AS image_url, CASE k % 3 WHEN 0 THEN true WHEN 1 THEN false END AS signup_open,
  'https://s' || c % 4 || '.com/' || k AS page_url, CASE WHEN k % 2 = 0 THEN 'https://t.com/' || k % 500 END AS signup_url, k % 6 = 0 AS two,
  CASE WHEN k % 41 = 0 THEN 'gold' END AS label_tier, k % 43 = 0 AS is_major, k % 47 = 0 AS is_cancelled
  FROM (SELECT o_orderkey AS k, o_custkey AS c, CAST(o_orderdate AS DATE) AS d, {_list(WORDS)}[o_orderkey % 6 + 1] AS w, {_list(PARTS)}[o_custkey % 5 + 1] AS part, {_list(SUBS)}[o_orderkey % 5 + 1] AS subdivision,
    CAST({_list(KMS)}[o_orderkey % 5 + 1] AS DOUBLE) AS km, {_list(KINDS)}[o_orderkey % 3 + 1] AS kind FROM orders))"""


def event_rules(spark: SparkSession, sf: str) -> DataFrame:
    """The rules that made records break."""
    return rules.rejected_events(made_events(spark, sf)).select("id", "rule")


def record_rules(spark: SparkSession, sf: str) -> DataFrame:
    """R15."""
    return rules.record_problems(made_events(spark, sf))


def adult_events(spark: SparkSession, sf: str) -> DataFrame:
    """Three months of required start times."""
    return rules.for_adults(made_events(spark, sf), day(AS_OF), 3).select("id")


#: What a status field says; the first eight mean cancelled.
STATUSES = ("Evento CANCELADO", "cancelled by organizer", "Canceled", "Abgesagt!", "ANNULLATO", "course annulée", "Geannuleerd", "ODWOŁANY", "scheduled", "granulado", "cancel policy")


def cancelled_events(spark: SparkSession, sf: str) -> DataFrame:
    """All markers, one signal of two."""
    e = made_events(spark, sf)
    status = F.when(F.col("ordinal") % 5 != 0, pick(STATUSES, F.col("ordinal") % 11))
    return e.filter(rules.is_cancelled(status, F.when(F.col("ordinal") % 53 == 0, "https://schema.org/EventCancelled"))).select("id")


def sport_filter(spark: SparkSession, sf: str) -> DataFrame:
    """Running events, tagged with another area but rescued by their title, that are somewhere."""
    e = made_events(spark, sf)
    area = F.when(F.col("ordinal") % 4 == 0, "Running").when(F.col("ordinal") % 4 == 1, "Swimming")
    sport = rules.is_sport(F.col("title"), r"(?i)pedal|bike", area, "run|corrida", r"(?i)\bcorrida\b")
    place = F.when(F.col("ordinal") % 9 == 0, " Virtual ").otherwise(F.col("location_text"))
    state = F.when(F.col("ordinal") % 10 == 0, "AE").otherwise(F.col("subdivision"))
    return e.filter(sport & ~rules.is_virtual(F.col("title"), place, F.col("country"), state)).select("id")


def horizon_filter(spark: SparkSession, sf: str) -> DataFrame:
    """By id, whether a date is in the coming year, and whether a source should give the row."""
    e = made_events(spark, sf)
    return e.select("id", F.coalesce(rules.in_horizon(F.col("event_date"), day(AS_OF)), F.lit(False)).alias("near"), rules.upcoming_or_undated(F.col("event_date"), day(AS_OF)).alias("given"))


#: Images, and whether each is safe on a page of s1.com, and where no page is known.
IMAGES = (
    ("https://img.s1.com/a.jpg", True, True), ("https://cdn.other.net/a.png", False, True), ("ftp://s1.com/a.jpg", False, False), ("https://adserver.s1.com/x.gif", False, False),
    ("https://d1.cloudfront.net/a.jpg", True, True), ("https://www.best-CASINO.com/a.jpg", False, False), ("https://poker.s1.com/a.jpg", False, False), ("https://a.b.wixstatic.com/z.png", True, True),
    ("https://x.cdn.jsdelivr.net/a.jpg", True, True), ("https://jsdelivr.net/a.jpg", False, True), ("http://s1.com/pill/a.jpg", True, True), ("https://", False, False), ("https://evil-cloudfront.net/a.jpg", False, True),
)


def safe_images(spark: SparkSession, sf: str) -> DataFrame:
    """The default words and networks."""
    url = pick(tuple(u for u, _, _ in IMAGES), F.col("ordinal") % len(IMAGES))
    return made_events(spark, sf).select("id", rules.safe_image(url, F.lit("https://www.s1.com/race")).alias("image"), rules.safe_image(url).alias("anywhere"))


def signup_fallback(spark: SparkSession, sf: str) -> DataFrame:
    """The link that a record shows first, after its page has taken the place of missing signup links."""
    e = made_events(spark, sf).withColumn("before", search.best_link(F.col("listings"))).withColumn("listings", rules.with_signup_links(F.col("listings")))
    return e.filter(rules.has_link(F.col("listings"))).select("id", "before", search.best_link(F.col("listings")).alias("after"))


def first_editions(spark: SparkSession, sf: str) -> DataFrame:
    """P13."""
    e = made_events(spark, sf).filter("event_date IS NOT NULL")
    return listings.earliest_edition(e, "c", "event_date").select("c", "year", F.date_format("event_date", "yyyy-MM-dd").alias("first"))


def label_filter(spark: SparkSession, sf: str) -> DataFrame:
    """Labelled, upcoming records of a country, all filters together."""
    e = made_events(spark, sf)
    wanted = search.any_listed(search.label_tokens(F.col("label_tier"), F.col("is_major")), ["gold", "major"])
    return e.filter(wanted & search.in_period(F.col("event_date"), "all", day(AS_OF)) & search.in_location(F.col("country"), F.col("subdivision"), "BR:") & search.matches_search("corrida", F.col("title"))).select("id")


def archive_upsert(spark: SparkSession, sf: str) -> DataFrame:
    """K2."""
    e = made_events(spark, sf).filter("event_date IS NOT NULL").select("ordinal", "id", "event_date", "miss_count")
    new = e.filter("ordinal % 3 = 0").withColumn("miss_count", F.col("miss_count") + 100)
    return publish.upsert_archive(e.filter("ordinal % 2 = 0"), new).select("id", "miss_count", "event_month")


def slim_records(spark: SparkSession, sf: str) -> DataFrame:
    """K3."""
    return publish.slim(made_events(spark, sf))


def json_ld_records(spark: SparkSession, sf: str) -> DataFrame:
    """K6: what the markup of an event with dates on two days says."""
    e = made_events(spark, sf)
    later = F.transform("distances", lambda d: d.withField("date", F.when(F.col("ordinal") % 2 == 0, F.date_add("event_date", 1)).otherwise(F.col("event_date"))))
    rows = publish.json_ld(e.withColumn("distances", later))
    of = lambda p: F.get_json_object("json_ld", p)
    return rows.select("id", of("$.name").alias("name"), of("$.startDate").alias("first"), of("$.endDate").alias("last"), of("$.eventStatus").alias("status"), of("$.url").alias("url"), of("$.organizer.name").alias("organizer"), of("$.location.address.addressRegion").alias("region"))


def sitemap_rows(spark: SparkSession, sf: str) -> DataFrame:
    """K7."""
    p = table(spark, sf, "nation").select(F.concat(F.lit("/"), F.lower("n_name")).alias("path"))
    return publish.sitemap("https://site.org", ["pt", "en", "es"], p).select("url", "lang", F.concat_ws(" ", "alternates").alias("alternates"))


def marked_block(spark: SparkSession, sf: str) -> DataFrame:
    """K8: a block between two markers is replaced, twice with the same result."""
    text = F.concat(F.lit("head <!--a-->old "), "id", F.lit("<!--b--> tail "), "id")
    e = made_events(spark, sf).select("id", F.when(F.col("ordinal") % 2 == 0, text).otherwise(F.col("id")).alias("page"))
    once = e.withColumn("page", publish.with_block(F.col("page"), "<!--a-->", "<!--b-->", F.lit("new $1")))
    return once.select("id", F.replace(publish.with_block(F.col("page"), "<!--a-->", "<!--b-->", F.lit("new $1")), F.lit("\n"), F.lit("~")).alias("page"))


def popular_links(spark: SparkSession, sf: str) -> DataFrame:
    """Links that one source uses three times or more, normalized."""
    e = made_events(spark, sf)
    slashed = F.transform("listings", lambda x: x.withField("signup_urls", F.transform(x["signup_urls"], lambda u: F.when(F.col("ordinal") % 4 == 0, F.concat(F.upper(u), F.lit("//"))).otherwise(u))))
    return resolve.generic_links(resolve.signup_links(e.withColumn("listings", slashed)))


def _hashed(e: DataFrame, groups: int) -> DataFrame:
    """Titles of two hashes, so that titles are either the same or nothing alike."""
    g = F.col("ordinal") % groups
    return e.withColumn("title", F.concat(F.lit("Corrida "), F.md5(g.cast("string")), F.lit(" "), F.md5((g + 1_000_000).cast("string"))))


def confirmed_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs of a customer's records within 31 days that are one event."""
    e = _hashed(made_events(spark, sf), 3).withColumn("subdivision", F.col("c").cast("string"))
    none = spark.createDataFrame([], "link string")
    rows = resolve.prepared(e, generic=none)
    return resolve.confirmed(resolve.within_days(rows, 31, "sub"), rows)


def merged_survivors(spark: SparkSession, sf: str) -> DataFrame:
    """Clusters of a customer's records folded into one."""
    e = made_events(spark, sf)
    s = resolve.survivors(e.drop("c"), e.select("ordinal", F.col("c").alias("cluster")))
    keys = F.array_sort(F.transform("distances", km_key))
    names = F.array_sort(F.transform("listings", lambda x: F.concat(x["name"], F.lit(":"), F.size(x["signup_urls"]).cast("string"))))
    return s.select("cluster", "id", "image_url", F.coalesce(F.col("signup_open").cast("string"), F.lit("unknown")).alias("signup_open"), "is_cancelled", F.array_join(keys, ",").alias("kms"), F.array_join(names, ",").alias("sources"), F.col("n_members").alias("n"))


def merge_by_links(spark: SparkSession, sf: str) -> DataFrame:
    """A whole round of merging; records without date and distances in common only meet by their links."""
    e = made_events(spark, sf).drop("c")
    apart = e.withColumn("event_date", F.lit(None).cast("date")).withColumn("title", F.concat(F.lit("only"), F.col("id")))
    own = F.transform("listings", lambda x: x.withField("name", F.concat(F.lit("n"), F.col("id"))))  # no source uses a link twice
    return resolve.merge_round(apart.withColumn("listings", own)).select(F.size("listings").cast("long").alias("n"), "ordinal").groupBy("n").agg(F.count(F.lit(1)).alias("events"))


def best_copies(spark: SparkSession, sf: str) -> DataFrame:
    """A8."""
    e = made_events(spark, sf).withColumn("id", F.col("c").cast("string"))
    return quality.best_copy_of_id(e, F.col("ordinal")).select("id", "ordinal")


def link_liveness(spark: SparkSession, sf: str) -> DataFrame:
    """R6, R7."""
    e = made_events(spark, sf)
    return reconcile.alive(_link_status(e), e).select("id", F.coalesce(F.col("alive").cast("string"), F.lit("unknown")).alias("alive"))


def _link_status(e: DataFrame) -> DataFrame:
    """Statuses of the first pages of two thirds of the records."""
    k = F.col("ordinal")
    return e.filter("ordinal % 3 <> 2").select(F.get("listings", 0)["page_url"].alias("url"), F.when(k % 4 == 0, 200).when(k % 4 == 1, 404).when(k % 4 == 2, 403).alias("status"))


def reconciled(spark: SparkSession, sf: str) -> DataFrame:
    """Stored records against a batch: same and changed ones, new ones, a twin under another id, and those not seen."""
    e = made_events(spark, sf).withColumn("subdivision", F.col("c").cast("string")).drop("c")
    k = F.col("ordinal")
    plain = F.array(F.struct(F.lit(10.0).alias("km"), F.lit(None).cast("string").alias("label"), F.lit(None).cast("date").alias("date"), F.lit(None).cast("string").alias("start_time")))
    own = F.array(F.struct(F.lit("a").alias("name"), F.concat(F.lit("https://a.com/"), "id").alias("page_url"), F.array().cast("array<string>").alias("signup_urls"), F.lit("calendar").alias("kind")))
    e = _hashed(e, 1 << 40).withColumns({"distances": plain.cast(f"array<{DISTANCE}>"), "listings": own, "location_text": F.lit("somewhere")})
    new = e.filter("ordinal % 5 < 2").withColumn("is_cancelled", F.lit(False)).withColumn("start_time", F.when(k % 3 == 0, "23:59").otherwise(F.col("start_time")))
    stored = e.filter("ordinal % 5 <> 1")
    # Records of the batch that are stored under another id as well, with another source.
    twins = e.filter("ordinal % 5 = 0 AND ordinal % 8 = 0").withColumn("id", F.concat(F.lit("twin"), "id")).withColumn("ordinal", k + (1 << 40))
    twins = twins.withColumn("listings", F.transform("listings", lambda x: x.withField("name", F.lit("b"))))
    status = e.select(F.get("listings", 0)["page_url"].alias("url"), F.when(k % 3 == 0, 200).otherwise(404).alias("status")).filter(k % 7 != 0)
    out = reconcile.reconcile(stored.union(twins), new, status, day(AS_OF))
    return out.select("id", "outcome", F.col("miss_count").cast("long").alias("misses"), F.size("listings").cast("long").alias("sources"), "is_cancelled", "start_time")


#: Letters of a title of 25 that are changed, and days that a date is moved by: similarities of 1, 0.96, 0.88, 0.8 and 0.68.
CHANGED, MOVED = (0, 1, 3, 5, 8), (0, 10, 20)


def near_titles(spark: SparkSession, sf: str) -> DataFrame:
    """Stored records that incoming ones match, and those that are twins, with titles between the limits of the rules."""
    e = made_events(spark, sf).withColumn("subdivision", F.col("c").cast("string")).drop("c")
    k = F.col("ordinal")
    own = F.array(F.struct(F.lit("a").alias("name"), F.concat(F.lit("https://a.com/"), "id").alias("page_url"), F.array().cast("array<string>").alias("signup_urls"), F.lit("calendar").alias("kind")))
    word = lambda x: F.substring(F.md5(x.cast("string")), 1, 12)
    stored = e.withColumn("title", F.concat(F.lit("Corrida "), word(k), F.lit(" "), word(k + 1_000_000))).withColumn("listings", own.cast(f"array<{LISTING}>"))
    n = pick(CHANGED, k % 5)
    title = F.concat(F.expr("left(title, length(title) - n)"), F.repeat(F.lit("z"), F.col("n")))
    new = stored.withColumn("n", n).withColumn("title", title).drop("n").withColumn("id", F.concat(F.lit("n"), "id"))
    new = new.withColumn("event_date", F.when(k % 7 != 0, F.date_add("event_date", pick(MOVED, k % 3))))
    none = spark.createDataFrame([], "link string")
    met = reconcile.matches(new, stored, none).select(F.lit("match").alias("kind"), F.col("n").alias("one"), F.col("s").alias("other"))
    return met.union(reconcile.absorbed(new, stored, none).select(F.lit("twin"), "twin", "into")).toDF("kind", "one", "other")


def patched_blanks(spark: SparkSession, sf: str) -> DataFrame:
    """R17."""
    e = made_events(spark, sf).select("id", "ordinal", "start_time", "city")
    facts = e.filter("ordinal % 2 = 0").select("id", F.lit("09:00").alias("start_time"), F.lit("Cidade").alias("city"))
    return reconcile.blank_filled(e, facts, "id", ["start_time", "city"]).select("id", "start_time", "city")


def _locations(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("BR", "SP", "São Paulo"), ("BR", "RJ", "Rio de Janeiro"), ("BR", "MG", "Minas Gerais"), ("US", "XX", "Xanadu"), ("US", "RS", "Rushmore")], "country string, code string, name string")


LOCATIONS = "loc(country, code, name) AS (VALUES ('BR', 'SP', 'sao paulo'), ('BR', 'RJ', 'rio de janeiro'), ('BR', 'MG', 'minas gerais'), ('US', 'XX', 'xanadu'), ('US', 'RS', 'rushmore'))"


def known_locations(spark: SparkSession, sf: str) -> DataFrame:
    """Records of known and of unknown places."""
    good, bad = quality.split_by_location(made_events(spark, sf), _locations(spark))
    return good.select("id", F.lit(True).alias("known")).union(bad.select("id", F.lit(False)))


def missing_places(spark: SparkSession, sf: str) -> DataFrame:
    """Subdivisions that a country does not have are looked up anew; records without a place go."""
    cache = spark.createDataFrame([("norte", "BR", "BR", "RJ"), ("sul", None, "US", "RS"), ("leste", None, "BR", "MG")], "key string, hint_country string, country string, subdivision string")
    return enrich.repaired_locations(made_events(spark, sf), _locations(spark), cache).select("id", "country", "subdivision")


def subdivision_names(spark: SparkSession, sf: str) -> DataFrame:
    """Codes and names of subdivisions, exact or folded, or one letter off."""
    e = made_events(spark, sf)
    asked = e.withColumn("subdivision", pick(("SP", "SAO PAULO", "são paulo", "Rio de Janeiru", "nowhere at all"), F.col("ordinal") % 5)).withColumn("country", F.lit("BR"))
    return enrich.resolve_subdivision(asked, _locations(spark)).select("id", "code")


def labelled_events(spark: SparkSession, sf: str) -> DataFrame:
    """The highest tier of feed rows of the same title, within two days and in the same country."""
    e = made_events(spark, sf).withColumn("title", F.md5((F.col("ordinal") % 50).cast("string"))).withColumn("city", F.lit(""))
    n = F.col("n_nationkey")
    feed = table(spark, sf, "nation").select(F.md5((n % 50).cast("string")).alias("name_norm"), F.lit("").alias("city_norm"), F.when(n % 2 == 0, "").otherwise("BR").alias("country"), F.explode(F.sequence(day("1995-01-01"), day("1997-12-31"), F.expr("INTERVAL 20 DAY"))).alias("date"), n)
    feed = feed.withColumn("date", F.date_add("date", n.cast("int"))).withColumn("tier", pick(enrich.TIERS, (n + F.dayofmonth("date")) % 4)).drop("n_nationkey")
    return enrich.annotate_labels(e, feed).filter("label_tier IS NOT NULL").select("id", "label_tier")


def major_events(spark: SparkSession, sf: str) -> DataFrame:
    """Marathons whose title and city have all words of a major of their country."""
    e = made_events(spark, sf).withColumn("city", F.concat_ws(" ", "city", F.lit("alpha costa")))
    majors = spark.createDataFrame([("US", "Alpha"), ("BR", "Costa Sul"), ("BR", "Delta")], "country string, name string")
    return enrich.annotate_majors(e, majors).filter("is_major").select("id")


#: Names of places, and words with what they say, as tables.
PLACES = (("brava", "BV", "state"), ("alpha", "AL", "city"), ("delta city", "DC", "city"), ("delta", "DE", "city"))
KEYWORDS = (("alpha", "A"), ("praca", "P"), ("delta", "D"))


def place_codes(spark: SparkSession, sf: str) -> DataFrame:
    """Codes from a field, the parts of a text or a city in it; keywords; hosts; contradictions. The names are few and stand among as many others as there are parts."""
    from cadenza.functions.structured import name_by_host

    e = made_events(spark, sf)
    k = F.col("ordinal")
    others = table(spark, sf, "part").select(F.concat(F.lit("zz "), F.col("p_partkey").cast("string")).alias("name"))
    names = spark.createDataFrame(PLACES, "name string, code string, kind string").unionByName(others.select("name", F.lit("ZZ").alias("code"), F.lit("city").alias("kind")))
    words = spark.createDataFrame([(w, v, i) for i, (w, v) in enumerate(KEYWORDS)], "word string, value string, rank int")
    words = words.unionByName(others.select(F.col("name").alias("word"), F.lit("Z").alias("value"), F.lit(99).alias("rank")))
    text = pick(("Praça, Alpha Velha, Brava", "Costa, Alpha", "perto de Delta City", "nada"), k % 4)
    codes = gazetteer.named_places(e, "id", text, F.when(k % 7 == 0, "Brava"), names)
    rows = gazetteer.first_keywords(e.select("id", "ordinal", "listings"), text, words).join(codes, "id", "left")
    return rows.select("id", "code", F.col("value").alias("word"), name_by_host(F.get("listings", 0)["page_url"], {"s1.": "one", "s2.": "two"}, "other").alias("host"), listings.repaired_country(F.when(k % 2 == 0, "US").otherwise("CA"), pick(("ON", "NY", "XYZ"), k % 3)).alias("country"))


def listing_times(spark: SparkSession, sf: str) -> DataFrame:
    """Times by composite key, the first entry within a tolerance, schedules, legs."""
    e = made_events(spark, sf).withColumn("stage", F.col("ordinal") % 3)
    times = spark.createDataFrame([("norte", 0, "06:00"), ("sul", 1, "07:00"), ("leste", 2, "08:00")], "city string, stage long, start_time string")
    entry = lambda km, d, t: F.struct(km.cast("double").alias("km"), F.date_add(day("2024-01-01"), d.cast("int")).alias("date"), t.cast("string").alias("start_time"))
    k = F.col("ordinal")
    plan = F.array(entry(F.lit(10), k % 3, F.lit("08:00")), entry(F.lit(5), k % 2, F.lit("07:00")), entry(F.lit(10), k % 2, F.lit("09:00")), entry(F.lit(10.4), F.lit(0), F.lit("05:00")))
    rows = listings.with_times(e, times, ["city", "stage"])
    told = F.transform(listings.schedule(plan), lambda x: F.concat_ws("/", x["km"].cast("string"), F.date_format(x["date"], "d"), x["start_time"]))
    return rows.select("id", "start_time", listings.nearest_within(F.lit(10.2), plan)["start_time"].alias("near"), F.array_join(told, " ").alias("plan"), F.round(listings.leg_sums(plan), 3).alias("total"))


def grouped_index(spark: SparkSession, sf: str) -> DataFrame:
    """Line items as search-index documents of their order."""
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", (F.col("l_quantity") * 1.0).alias("km"), F.date_format("l_shipdate", "HH:mm").alias("time"))
    li = li.withColumn("place", F.struct("l_linenumber", "l_partkey")).drop("l_linenumber")
    g = listings.grouped_documents(li, "l_orderkey", "place", "km", "time")
    return g.select("l_orderkey", "l_partkey", F.size("kms").cast("long").alias("n"), F.element_at("kms", 1).alias("least"), "start_time")


def place_names(spark: SparkSession, sf: str) -> DataFrame:
    """Display names with their fallbacks."""
    names = spark.createDataFrame([("country", "BR", "en", "Brazil"), ("country", "BR", "pt", "Brasil"), ("country", "US", "pt", "EUA"), ("subdivision", "SP", "en", "Sao Paulo")], "kind string, code string, language string, name string")
    rows = listings.display_place(made_events(spark, sf), names)
    return rows.select("id", "country_name", "subdivision_name", display.place_text(F.col("city"), F.when(F.col("subdivision") == "SP", F.col("subdivision_name")), F.col("country_name"), F.col("location_text")).alias("place"))


def event_cards(spark: SparkSession, sf: str) -> DataFrame:
    """What a card shows."""
    e = made_events(spark, sf)
    details = F.transform(display.detail_rows(F.col("distances")), lambda r: F.concat_ws("@", r["label"], F.date_format(r["date"], "yyyyMMdd")))
    return e.select("id", F.array_join(display.distance_labels(F.col("distances")), ",").alias("labels"), F.array_join(details, ",").alias("details"), display.relative_day(F.col("event_date"), day(AS_OF)).alias("when"), display.shown_time(F.col("distances"), F.col("start_time")).alias("time"), display.has_several_sources(F.col("listings")).alias("several"))


def sorted_sources(spark: SparkSession, sf: str) -> DataFrame:
    """T4: listings by kind, then name."""
    e = made_events(spark, sf)
    return e.select("id", F.array_join(F.transform(search.sorted_listings(F.reverse("listings")), lambda x: x["name"]), ",").alias("names"))


def recent_and_next(spark: SparkSession, sf: str) -> DataFrame:
    """The past 15 days and what is to come, and the places in them."""
    past, ahead = display.split_recent_past(made_events(spark, sf), day(AS_OF))
    return past.select(F.lit("past").alias("part"), "id").union(ahead.select(F.lit("next"), "id"))


def validation_counts(spark: SparkSession, sf: str) -> DataFrame:
    """A14."""
    return rules.validation_stats(made_events(spark, sf), day(AS_OF))


def run_checks(spark: SparkSession, sf: str) -> DataFrame:
    """S19."""
    e = made_events(spark, sf).withColumn("source", F.concat(F.lit("s"), F.col("c") % 4))
    k = F.col("ordinal")
    e = e.withColumn("id", F.when(k % 50 == 0, F.concat(F.lit("x_1996-06-01_"), "id")).when(k % 3 == 0, F.concat(F.lit("d"), F.col("c").cast("string"))).otherwise(F.col("id"))).withColumn("title", F.when(k % 60 == 0, "ab").otherwise(F.col("title")))
    return rules.batch_problems(e, day(AS_OF))


def frequent_values(spark: SparkSession, sf: str) -> DataFrame:
    """A18."""
    return health.top_values(made_events(spark, sf), F.col("title"), 7)


def same_shard(spark: SparkSession, sf: str) -> DataFrame:
    """The first shard against a filter of the whole, and against a shorter one."""
    e = made_events(spark, sf).select("id", "event_date")
    shard = publish.boot_window(e, day(AS_OF))
    return search.same_rows(shard, e.filter(F.col("event_date").between(F.date_sub(day(AS_OF), 15), F.date_add(day(AS_OF), 20))))


def source_states(spark: SparkSession, sf: str) -> DataFrame:
    """A status line for each source, and its turn in the next run."""
    runs = table(spark, sf, "events").select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("source"), F.col("ts").alias("t"), (F.col("event_type") != "error").alias("ok"), F.col("event_id").alias("n"))
    status = health.latest_status(runs)
    lines = health.status_table(status)
    turns = health.failed_first(runs.select("source").distinct().withColumn("rank", F.substring("source", 2, 9).cast("long")), status)
    first = turns.limit(5).select("source", F.lit(True).alias("soon"))
    return lines.join(first, "source", "left").select("source", "line", F.coalesce("soon", F.lit(False)).alias("soon"))


def test_runs(spark: SparkSession, sf: str) -> DataFrame:
    """Days as runs, events as results."""
    outcome = F.when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "signup", "skipped").otherwise("passed")
    return health.run_summary(table(spark, sf, "events").select(F.col("user_id").alias("run"), outcome.alias("outcome")))


def pages_reached(spark: SparkSession, sf: str) -> DataFrame:
    """Line items as result pages of five rows, up to the first short page or one without new parts."""
    li = table(spark, sf, "lineitem").select((F.col("l_orderkey") % 500).alias("list"), F.floor(F.col("l_orderkey") / 500 / 5).alias("page"), (F.col("l_partkey") % 40).alias("part"))
    return listings.pages_in_reach(li, "list", "page", "part", 5).groupBy("list").agg(F.count(F.lit(1)).alias("n"), F.max("page").alias("last"))


def _ev(sql: str, *more: str) -> str:
    return f"WITH {', '.join([EV, *more])} {sql}"


SQL = {
    "event_rules": _ev("""SELECT id, 'no_location' AS rule FROM ev WHERE location_text = '' UNION ALL SELECT id, 'short_title' FROM ev WHERE len(title) < 4 UNION ALL SELECT id, 'navigation_title' FROM ev WHERE title = 'Home'
        UNION ALL SELECT id, 'other_sport' FROM ev WHERE title LIKE 'Pedal%' UNION ALL SELECT id, 'kids_only' FROM ev WHERE title LIKE 'Kids Run%' AND NOT has_km UNION ALL SELECT id, 'no_date' FROM ev WHERE event_date IS NULL
        UNION ALL SELECT id, 'no_distance' FROM ev WHERE NOT has_km"""),
    "record_rules": _ev("SELECT id, 'no_date' AS problem FROM ev WHERE event_date IS NULL UNION ALL SELECT id, 'no_distance' FROM ev WHERE NOT has_km UNION ALL SELECT id, 'no_country' FROM ev WHERE country = '??'"),
    "adult_events": _ev(f"SELECT id FROM ev WHERE NOT (title LIKE 'Kids Run%' AND NOT has_km) AND NOT (start_time IS NULL AND coalesce(event_date BETWEEN DATE '{AS_OF}' AND DATE '{AS_OF}' + INTERVAL 3 MONTH, false))"),
    "cancelled_events": _ev("SELECT id FROM ev WHERE (k % 5 <> 0 AND k % 11 < 8) OR k % 53 = 0"),
    "sport_filter": _ev("SELECT id FROM ev WHERE title NOT LIKE 'Pedal%' AND (k % 4 <> 1 OR title LIKE 'Corrida%') AND k % 9 <> 0 AND NOT (country = 'US' AND k % 10 = 0)"),
    "horizon_filter": _ev(f"SELECT id, coalesce(event_date BETWEEN DATE '{AS_OF}' AND DATE '{AS_OF}' + 365, false) AS near, event_date IS NULL OR event_date >= DATE '{AS_OF}' AS given FROM ev"),
    "safe_images": _ev(f"SELECT id, CASE WHEN {_list(tuple(a for _, a, _ in IMAGES))}[k % {len(IMAGES)} + 1] THEN u END AS image, CASE WHEN {_list(tuple(b for _, _, b in IMAGES))}[k % {len(IMAGES)} + 1] THEN u END AS anywhere FROM (SELECT *, {_list(tuple(u for u, _, _ in IMAGES))}[k % {len(IMAGES)} + 1] AS u FROM ev)"),
    "signup_fallback": _ev("SELECT id, coalesce(signup_url, page_url) AS before, coalesce(signup_url, page_url) AS after FROM ev"),
    "first_editions": _ev("SELECT c, CAST(year(event_date) AS INTEGER) AS year, strftime(min(event_date), '%Y-%m-%d') AS first FROM ev WHERE event_date IS NOT NULL GROUP BY 1, 2"),
    "label_filter": _ev(f"SELECT id FROM ev WHERE (label_tier = 'gold' OR is_major) AND (event_date IS NULL OR event_date >= DATE '{AS_OF}') AND country = 'BR' AND title LIKE 'Corrida%'"),
    "archive_upsert": _ev("SELECT id, CAST(k % 10 + CASE WHEN k % 3 = 0 THEN 100 ELSE 0 END AS INTEGER) AS miss_count, strftime(event_date, '%Y-%m') AS event_month FROM ev WHERE event_date IS NOT NULL AND (k % 2 = 0 OR k % 3 = 0)"),
    "slim_records": _ev("""SELECT id, '{"id":"' || id || '","title":"' || title || '"' || CASE WHEN event_date IS NULL THEN '' ELSE ',"event_date":"' || strftime(event_date, '%Y-%m-%d') || '"' END
        || CASE WHEN start_time IS NULL THEN '' ELSE ',"start_time":"' || start_time || '"' END || CASE WHEN location_text = '' THEN '' ELSE ',"location_text":"' || location_text || '"' END
        || CASE WHEN city = '' THEN '' ELSE ',"city":"' || city || '"' END || ',"subdivision":"' || subdivision || '","country":"' || country || '"' || CASE WHEN image_url IS NULL THEN '' ELSE ',"image_url":"' || image_url || '"' END
        || CASE WHEN label_tier IS NULL THEN '' ELSE ',"label_tier":"gold"' END || ',"distances":[' || CASE WHEN has_km THEN '{"km":' || km || ',"date":"' || strftime(d, '%Y-%m-%d') || '"}' ELSE '' END || CASE WHEN has_mi THEN ',{"label":"10 mi"}' ELSE '' END || ']'
        || CASE WHEN signup_open IS NULL THEN '' ELSE ',"signup_open":' || signup_open END || ',"listings":[{"name":"' || source || '","page_url":"' || page_url || '","signup_urls":[' || CASE WHEN signup_url IS NULL THEN '' ELSE '"' || signup_url || '"' END || '],"kind":"' || kind || '"}'
        || CASE WHEN two THEN ',{"name":"agg","page_url":"https://agg.com/' || k || '","signup_urls":[],"kind":"calendar"}' ELSE '' END || ']' || CASE WHEN is_major THEN ',"is_major":true' ELSE '' END || CASE WHEN is_cancelled THEN ',"is_cancelled":true' ELSE '' END
        || ',"first_seen":"' || strftime(d, '%Y-%m-%d') || '"}' AS json FROM ev"""),
    "json_ld_records": _ev("""SELECT id, title AS name, strftime(event_date, '%Y-%m-%d') AS first, CASE WHEN has_km AND k % 2 = 0 AND event_date IS NOT NULL THEN strftime(event_date + 1, '%Y-%m-%d') END AS last,
        'https://schema.org/' || CASE WHEN is_cancelled THEN 'EventCancelled' ELSE 'EventScheduled' END AS status, coalesce(signup_url, page_url) AS url, CASE WHEN kind = 'organizer' THEN source END AS organizer, subdivision AS region FROM ev"""),
    "sitemap_rows": """SELECT 'https://site.org' || p || '/' || lower(n_name) AS url, lang, 'https://site.org/' || lower(n_name) || ' https://site.org/en/' || lower(n_name) || ' https://site.org/es/' || lower(n_name) AS alternates
        FROM nation, (VALUES ('pt', ''), ('en', '/en'), ('es', '/es')) l(lang, p)""",
    "marked_block": _ev("SELECT id, CASE WHEN k % 2 = 0 THEN 'head <!--a-->~new $1~<!--b--> tail ' || id ELSE id END AS page FROM ev"),
    "popular_links": _ev("SELECT DISTINCT signup_url AS link FROM (SELECT source, signup_url FROM ev WHERE signup_url IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= 3)"),
    "confirmed_pairs": _ev(f"""SELECT a.k AS a, b.k AS b FROM ev a JOIN ev b ON a.c = b.c AND (b.event_date, b.k) > (a.event_date, a.k) AND b.event_date - a.event_date <= 31
        WHERE (a.signup_url = b.signup_url) IS TRUE OR (a.k % 3 = b.k % 3 AND b.event_date - a.event_date <= 30 AND (a.city = '' OR b.city = '' OR a.city = b.city)
        AND (NOT a.has_km OR NOT b.has_km OR round_even(a.km, 0) = round_even(b.km, 0) OR (a.has_mi AND b.has_mi)))"""),
    "merged_survivors": _ev("""SELECT c AS cluster, arg_min(id, o) AS id, arg_min(image_url, o) FILTER (image_url IS NOT NULL) AS image_url, coalesce(CAST(arg_min(signup_open, o) FILTER (signup_open IS NOT NULL) AS VARCHAR), 'unknown') AS signup_open, bool_or(is_cancelled) AS is_cancelled,
        array_to_string(list_sort(list_distinct(flatten(list(CASE WHEN NOT has_km THEN [] WHEN has_mi THEN [CAST(CAST(round_even(km, 0) AS BIGINT) AS VARCHAR), '10 mi'] ELSE [CAST(CAST(round_even(km, 0) AS BIGINT) AS VARCHAR)] END)))), ',') AS kms,
        array_to_string(list_sort(CASE WHEN bool_or(two) THEN [any_value(source) || ':' || count(DISTINCT signup_url), 'agg:0'] ELSE [any_value(source) || ':' || count(DISTINCT signup_url)] END), ',') AS sources, count(*) AS n
        FROM (SELECT *, (-(2 + CASE WHEN event_date IS NULL THEN 0 ELSE 2 END + CASE WHEN start_time IS NULL THEN 0 ELSE 1 END + CASE WHEN location_text = '' THEN 0 ELSE 1 END + CASE WHEN image_url IS NULL THEN 0 ELSE 2 END
        + CASE WHEN has_km THEN 1 ELSE 0 END + CASE WHEN has_mi THEN 1 ELSE 0 END + CASE WHEN signup_open IS NULL THEN 0 ELSE 1 END + CASE WHEN k % 4 = 0 THEN 2 ELSE 0 END + CASE WHEN signup_url IS NULL THEN 0 ELSE 2 END), k) AS o FROM ev) GROUP BY c"""),
    "merge_by_links": _ev("SELECT n, count(*) AS events FROM (SELECT count(*) AS n FROM ev GROUP BY coalesce(signup_url, id)) GROUP BY n"),
    "best_copies": _ev("SELECT CAST(c AS VARCHAR) AS id, arg_min(k, (NOT two, CASE WHEN NOT has_km THEN 2 WHEN has_mi THEN 0 ELSE 1 END, image_url IS NULL, start_time IS NULL, k)) AS ordinal FROM ev GROUP BY c"),
    "link_liveness": _ev("SELECT id, CASE WHEN k % 3 = 2 THEN 'unknown' WHEN k % 4 IN (0, 2) THEN 'true' ELSE 'false' END AS alive FROM ev"),
    "near_titles": f"""WITH {EV}, m AS (SELECT k, [0, 1, 3, 5, 8][k % 5 + 1] AS n, event_date AS d0, CASE WHEN k % 7 <> 0 THEN event_date + [0, 10, 20][k % 3 + 1] END AS d1 FROM ev)
        SELECT 'match' AS kind, k AS one, k AS other FROM m WHERE n <= CASE WHEN d0 IS NULL OR d1 IS NULL OR d1 - d0 = 10 THEN 3 WHEN d0 = d1 THEN 5 ELSE 1 END
        UNION ALL SELECT 'twin', k, k FROM m WHERE (d0 = d1 AND n <= 5) OR (d0 IS NULL AND d1 IS NULL AND n <= 3)""",
    "reconciled": _ev(f"""SELECT id, outcome, misses, sources, is_cancelled, start_time FROM (
        SELECT id, CASE WHEN k % 5 = 1 THEN 'inserted' WHEN k % 3 = 0 THEN 'updated' ELSE 'kept' END AS outcome, CASE WHEN k % 5 = 1 THEN k % 10 ELSE 0 END AS misses,
          CASE WHEN k % 5 = 0 AND k % 8 = 0  AND NOT (event_date < DATE '{AS_OF}') IS TRUE AND event_date IS NOT NULL THEN CAST(2 AS BIGINT) ELSE 1 END AS sources,
          CASE WHEN k % 5 = 1 THEN false ELSE is_cancelled END AS is_cancelled, CASE WHEN k % 3 = 0 THEN '23:59' ELSE start_time END AS start_time FROM ev WHERE k % 5 < 2
        UNION ALL SELECT id, 'past', k % 10, 1, is_cancelled, start_time FROM ev WHERE k % 5 > 1 AND event_date < DATE '{AS_OF}'
        UNION ALL SELECT 'twin' || id, 'past', k % 10, 1, is_cancelled, start_time FROM ev WHERE k % 5 = 0 AND k % 8 = 0 AND event_date < DATE '{AS_OF}'
        UNION ALL SELECT id, CASE WHEN k % 7 = 0 THEN 'deferred' WHEN k % 3 = 0 THEN 'alive' ELSE 'missed' END, CASE WHEN k % 7 = 0 THEN k % 10 WHEN k % 3 = 0 THEN 0 ELSE k % 10 + 1 END, 1, is_cancelled, start_time
          FROM ev WHERE k % 5 > 1 AND event_date >= DATE '{AS_OF}' AND (k % 7 = 0 OR k % 3 = 0 OR k % 10 + 1 < 10))"""),
    "patched_blanks": _ev("SELECT id, coalesce(start_time, CASE WHEN k % 2 = 0 THEN '09:00' END) AS start_time, CASE WHEN city = '' THEN CASE WHEN k % 2 = 0 THEN 'Cidade' END ELSE city END AS city FROM ev"),
    "known_locations": _ev("SELECT id, EXISTS (SELECT 1 FROM loc WHERE loc.country = ev.country AND loc.code = ev.subdivision) AS known FROM ev", LOCATIONS),
    "missing_places": _ev("""SELECT id, CASE WHEN hit AND sub = '' AND fs IS NOT NULL THEN fc WHEN hit AND country = '??' THEN fc ELSE country END AS country, CASE WHEN sub = '' AND hit THEN fs ELSE sub END AS subdivision FROM (
        SELECT *, place IN ('norte', 'leste') AND asked = 'BR' OR place = 'sul' AND asked = 'US' AS hit, CASE place WHEN 'norte' THEN 'BR' WHEN 'sul' THEN 'US' WHEN 'leste' THEN 'BR' END AS fc, CASE place WHEN 'norte' THEN 'RJ' WHEN 'sul' THEN 'RS' WHEN 'leste' THEN 'MG' END AS fs FROM (
        SELECT id, country, CASE WHEN country IN ('BR', 'US') AND NOT EXISTS (SELECT 1 FROM loc WHERE loc.country = ev.country AND loc.code = ev.subdivision) THEN '' ELSE subdivision END AS sub, part AS place, CASE WHEN country = '??' THEN 'BR' ELSE country END AS asked FROM ev WHERE location_text <> ''))""", LOCATIONS),
    "subdivision_names": _ev("SELECT id, CASE k % 5 WHEN 0 THEN 'SP' WHEN 1 THEN 'SP' WHEN 2 THEN 'SP' WHEN 3 THEN 'RJ' END AS code FROM ev"),
    "labelled_events": _ev("""SELECT id, arg_max(['label', 'elite', 'gold', 'platinum'][t + 1], t) AS label_tier FROM ev JOIN (SELECT n_nationkey AS n, day + n_nationkey AS fd, (n_nationkey + day(day + n_nationkey)) % 4 AS t
        FROM nation, (SELECT CAST(unnest(generate_series(DATE '1995-01-01', DATE '1997-12-31', INTERVAL 20 DAY)) AS DATE) AS day)) f ON k % 50 = n AND abs(event_date - fd) <= 2 AND (n % 2 = 0 OR country = 'BR') GROUP BY 1"""),
    "major_events": _ev("SELECT id FROM ev WHERE has_km AND km = 42.195 AND ((country = 'US' AND title LIKE '% alpha%') OR (country = 'BR' AND title LIKE '% costa sul%' AND city = 'sul'))"),
    "place_codes": _ev("""SELECT id, CASE WHEN k % 7 = 0 THEN 'BV' ELSE ['BV', 'AL', 'DC', NULL][k % 4 + 1] END AS code, ['A', 'A', 'D', NULL][k % 4 + 1] AS word, CASE c % 4 WHEN 1 THEN 'one' WHEN 2 THEN 'two' ELSE 'other' END AS host,
        CASE WHEN k % 2 = 0 AND k % 3 = 0 THEN 'CA' WHEN k % 2 = 1 AND k % 3 = 1 THEN 'US' WHEN k % 2 = 0 THEN 'US' ELSE 'CA' END AS country FROM ev"""),
    "listing_times": _ev("""SELECT id, coalesce(start_time, CASE WHEN city = 'norte' AND k % 3 = 0 THEN '06:00' WHEN city = 'sul' AND k % 3 = 1 THEN '07:00' WHEN city = 'leste' AND k % 3 = 2 THEN '08:00' END) AS start_time, '08:00' AS near,
        '5.0/' || (1 + k % 2) || '/07:00 10.0/' || (1 + least(k % 2, k % 3)) || '/' || CASE WHEN k % 3 <= k % 2 THEN '08:00' ELSE '09:00' END || ' 10.4/1/05:00' AS plan, CAST(35.4 AS DOUBLE) AS total FROM ev"""),
    "grouped_index": "SELECT l_orderkey, arg_min(l_partkey, (l_linenumber, l_partkey)) AS l_partkey, count(DISTINCT l_quantity) AS n, CAST(min(l_quantity) AS DOUBLE) AS least, min(strftime(l_shipdate, '%H:%M')) AS start_time FROM lineitem GROUP BY 1",
    "place_names": _ev("""SELECT id, CASE country WHEN 'BR' THEN 'Brazil' WHEN 'US' THEN 'EUA' ELSE country END AS country_name, CASE subdivision WHEN 'SP' THEN 'Sao Paulo' ELSE subdivision END AS subdivision_name,
        CASE WHEN subdivision = 'SP' THEN 'Sao Paulo, ' || cn WHEN city <> '' THEN city || ', ' || cn ELSE location_text END AS place FROM (SELECT *, CASE country WHEN 'BR' THEN 'Brazil' WHEN 'US' THEN 'EUA' ELSE country END AS cn FROM ev)"""),
    "event_cards": _ev(f"""SELECT id, CASE WHEN has_km THEN label ELSE '' END || CASE WHEN has_mi THEN ',10 mi' ELSE '' END AS labels, CASE WHEN has_km THEN label ELSE '' END || CASE WHEN has_mi THEN ',10 mi' ELSE '' END AS details,
        CASE WHEN n = 0 THEN 'today' WHEN n = 1 THEN 'tomorrow' WHEN n = -1 THEN 'yesterday' WHEN n > 1 THEN 'in ' || n || ' days' WHEN n < -1 THEN -n || ' days ago' END AS "when", start_time AS time, two AS several
        FROM (SELECT *, ['5K', '10K', '21K', '42K', '7.5K'][k % 5 + 1] AS label, event_date - DATE '{AS_OF}' AS n FROM ev)"""),
    "sorted_sources": _ev("SELECT id, CASE WHEN NOT two THEN source WHEN kind = 'calendar' THEN 'agg,' || source ELSE source || ',agg' END AS names FROM ev"),
    "recent_and_next": _ev(f"SELECT 'past' AS part, id FROM ev WHERE event_date BETWEEN DATE '{AS_OF}' - 15 AND DATE '{AS_OF}' - 1 UNION ALL SELECT 'next', id FROM ev WHERE event_date IS NULL OR event_date >= DATE '{AS_OF}'"),
    "validation_counts": _ev(f"SELECT country, count(*) AS total, count(event_date) AS dated, count(*) - count(event_date) AS undated, count(*) FILTER (event_date >= DATE '{AS_OF}') AS future, count(*) FILTER (event_date < DATE '{AS_OF}') AS past FROM ev GROUP BY 1"),
    "run_checks": _ev(f"""SELECT source, problem, count(*) AS n FROM (SELECT source, 'title' AS problem FROM ev WHERE k % 60 = 0 UNION ALL SELECT source, 'run_date_in_id' FROM ev WHERE k % 50 = 0 AND (event_date = DATE '{AS_OF}') IS NOT TRUE
        UNION ALL SELECT source, 'no_date' FROM ev WHERE event_date IS NULL UNION ALL SELECT source, 'stale_date' FROM ev WHERE event_date < DATE '{AS_OF}' - 30 UNION ALL SELECT source, 'no_distance' FROM ev WHERE NOT has_km
        UNION ALL SELECT source, 'repeated_id' FROM (SELECT source, c FROM ev WHERE k % 50 <> 0 AND k % 3 = 0 GROUP BY 1, 2 HAVING count(*) > 1)) GROUP BY 1, 2"""),
    "frequent_values": _ev("SELECT title AS value, count(*) AS n FROM ev GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 7"),
    "same_shard": _ev(f"SELECT count(*) FILTER (event_date BETWEEN DATE '{AS_OF}' + 21 AND DATE '{AS_OF}' + 30) AS only_first, CAST(0 AS BIGINT) AS only_second FROM ev"),
    "source_states": """WITH r AS (SELECT user_id, ts, bool_and(event_type <> 'error') AS ok, arg_max(event_id, (event_type = 'error', event_id)) AS n FROM events GROUP BY 1, 2),
        g AS (SELECT user_id, max(ts) FILTER (ok) AS good, arg_max(n, ts) FILTER (ok) AS n_good, arg_max(ok, ts) AS ok FROM r GROUP BY 1),
        s AS (SELECT g.*, (SELECT count(*) FROM r WHERE r.user_id = g.user_id AND NOT r.ok AND (good IS NULL OR r.ts > good)) AS f FROM g)
        SELECT 'u' || user_id AS source, '| u' || user_id || ' | ' || CASE WHEN ok THEN 'ok, ' || n_good || ' events' ELSE 'failed ' || f || 'x, last success ' || coalesce(strftime(good, '%Y-%m-%d'), 'never') END || ' |' AS line,
        row_number() OVER (ORDER BY ok, user_id) <= 5 AS soon FROM s""",
    "test_runs": """SELECT user_id AS run, count(*) FILTER (event_type NOT IN ('error', 'signup')) AS passed, count(*) FILTER (event_type = 'error') AS failed, count(*) FILTER (event_type = 'signup') AS skipped, count(*) AS total,
        count(*) FILTER (event_type = 'error') = 0 AS clean FROM events GROUP BY 1""",
    "pages_reached": """WITH l AS (SELECT l_orderkey % 500 AS list, CAST(floor(l_orderkey / 500 / 5) AS BIGINT) AS page, l_partkey % 40 AS part FROM lineitem), f AS (SELECT list, part, min(page) AS first FROM l GROUP BY 1, 2),
        p AS (SELECT l.list, page, count(*) AS n, count(*) FILTER (page = first) AS fresh FROM l JOIN f ON l.list = f.list AND l.part = f.part GROUP BY 1, 2), e AS (SELECT list, min(page) FILTER (n < 5 OR fresh = 0) AS stop FROM p GROUP BY 1)
        SELECT l.list, count(*) AS n, max(page) AS last FROM l JOIN e ON l.list = e.list WHERE stop IS NULL OR page <= stop GROUP BY 1""",
}
QUERIES = {name: globals()[name] for name in SQL}
