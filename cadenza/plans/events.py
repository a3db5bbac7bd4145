"""Queries over the events and orders tables: periods, facets, publishing, reconciliation, health."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cadenza.functions.distance import km_key
from cadenza.functions.text import bounded_batches
from cadenza.operators import health, publish, quality, reconcile, search

AS_OF = "2024-01-15"
ORDERS_AS_OF = "1997-06-01"


#: Tables whose rows are whole texts or pages.
LONG_ROWS = ("pages", "documents")


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    if name in LONG_ROWS:
        bounded_batches(spark)
    return spark.read.parquet(f"{sf}/{name}.parquet")


def day(text: str) -> Column:
    return F.lit(text).cast("date")


def _dated(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").withColumn("d", F.to_date("ts"))


def months_with_new(spark: SparkSession, sf: str) -> DataFrame:
    """A10, W8."""
    return search.months(_dated(spark, sf), F.col("d"), day(AS_OF), F.col("d"))


def first_future_month(spark: SparkSession, sf: str) -> DataFrame:
    """W2."""
    months = search.months(table(spark, sf, "orders"), F.to_date("o_orderdate"), day(ORDERS_AS_OF), F.to_date("o_orderdate"))
    return search.first_future_month(months, day(ORDERS_AS_OF)).select("month", "n_events", "expanded")


def period_presets(spark: SparkSession, sf: str) -> DataFrame:
    """How many events each preset shows, by type; purchases count as undated."""
    rows = _dated(spark, sf).withColumn("d", F.when(F.col("event_type") != "purchase", F.col("d")))
    counts = [F.count_if(search.in_period(F.col("d"), p, day(AS_OF))).alias(f"n_{p}") for p in search.PERIODS]
    custom = F.count_if(search.in_period(F.col("d"), "custom", day(AS_OF), day("2024-01-10"), day("2024-01-20"))).alias("n_custom")
    return rows.groupBy("event_type").agg(*counts, custom)


def location_filter(spark: SparkSession, sf: str) -> DataFrame:
    """Customers of a region, and of one nation in it, by name."""
    n = table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    rows = table(spark, sf, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    rows = rows.filter(search.in_location(F.col("r_name"), F.col("n_name"), "EUROPE:"))
    return rows.groupBy("r_name", "n_name").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("c_acctbal"), 2).alias("balance"))


def any_member_filter(spark: SparkSession, sf: str) -> DataFrame:
    """Orders one of whose line items came back and was shipped late in the period."""
    flags = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_set("l_returnflag")).alias("flags"))
    rows = flags.filter(search.any_listed(F.col("flags"), ["R", "A"]))
    return rows.select("l_orderkey", F.concat_ws(",", "flags").alias("flags"))


def distance_pills(spark: SparkSession, sf: str) -> DataFrame:
    """P18 over part sizes as lengths."""
    one = F.array(F.struct(F.col("p_size").cast("double").alias("km"), F.lit(None).cast("string").alias("label")))
    p = table(spark, sf, "part").withColumn("distances", one)
    return p.filter(search.has_distance(F.col("distances"), ["5", "21", "outros"])).groupBy("p_size").agg(F.count(F.lit(1)).alias("n"))


def facet_leave_one_out(spark: SparkSession, sf: str) -> DataFrame:
    """Event types and users' groups, each counted with the other filters only."""
    rows = _dated(spark, sf).withColumn("g", F.col("user_id") % 5)
    filters = {"type": F.col("event_type").isin("click", "view"), "group": F.col("g") < 3, "period": search.in_period(F.col("d"), "30", day(AS_OF))}
    types = search.facet(rows, "type", filters, F.col("event_type")).select(F.lit("type").alias("facet"), "value", "n")
    groups = search.facet(rows, "group", filters, F.col("g").cast("string"), "type").select(F.lit("group").alias("facet"), "value", "n")
    return types.union(groups)


def slim_projection(spark: SparkSession, sf: str) -> DataFrame:
    """K3: orders as compact JSON without null fields."""
    o = table(spark, sf, "orders")
    fields = F.struct(F.col("o_orderkey").alias("id"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("date"), F.when(F.col("o_orderstatus") != "O", F.col("o_orderstatus")).alias("status"))
    return o.select("o_orderkey", F.to_json(fields).alias("json"))


def boot_window(spark: SparkSession, sf: str) -> DataFrame:
    """K4."""
    o = table(spark, sf, "orders").withColumn("event_date", F.to_date("o_orderdate"))
    return publish.boot_window(o, day(ORDERS_AS_OF)).select("o_orderkey", F.date_format("event_date", "yyyy-MM-dd").alias("event_date"))


def archive_split(spark: SparkSession, sf: str) -> DataFrame:
    """K1: every order is active or archived in its month."""
    o = table(spark, sf, "orders").withColumn("event_date", F.to_date("o_orderdate"))
    active, old = publish.split_active(o, day(ORDERS_AS_OF))
    rows = active.select(F.lit("active").alias("part")).union(old.select(F.date_format("event_date", "yyyy-MM").alias("part")))
    return rows.groupBy("part").agg(F.count(F.lit(1)).alias("n"))


def topk_padded(spark: SparkSession, sf: str) -> DataFrame:
    """120 customers, those of wanted nations first."""
    c = table(spark, sf, "customer")
    wanted = F.col("c_nationkey").isin(1, 3, 7).cast("int")
    return search.padded_top(c.withColumn("w", wanted), F.col("w"), F.col("c_acctbal"), F.col("c_custkey")).select("c_custkey", "c_nationkey", "c_acctbal")


def stratified_sample(spark: SparkSession, sf: str) -> DataFrame:
    """40 documents, three quarters English."""
    d = table(spark, sf, "documents").select("doc_id", F.when(F.col("lang") == "en", "en").otherwise("other").alias("stratum"))
    return search.stratified_sample(d, F.col("stratum"), {"en": 0.75, "other": 0.25}, F.col("doc_id"), 40, "s").select("doc_id", "stratum", "rank")


def first_wins_dedup(spark: SparkSession, sf: str) -> DataFrame:
    """P12."""
    e = table(spark, sf, "events")
    return quality.first_of(e, ["user_id", "event_type"], F.col("ts"), F.col("event_id")).select("user_id", "event_type", "event_id")


def survivor_fold(spark: SparkSession, sf: str) -> DataFrame:
    """A4: per user the first purchase's value, whether any error came, and all types seen in order of first event."""
    e = table(spark, sf, "events")
    order = F.struct("ts", "event_id")
    value = F.min_by("value", F.when(F.col("event_type") == "purchase", order))
    return e.groupBy("user_id").agg(F.min_by("event_id", order).alias("head"), F.round(value, 6).alias("first_purchase"), F.bool_or(F.col("event_type") == "error").alias("any_error"), F.concat_ws(",", F.array_sort(F.collect_set("event_type"))).alias("types"))


def distance_union(spark: SparkSession, sf: str) -> DataFrame:
    """A4: quantities of an order as lengths in km, one for each whole km (half to even)."""
    li = table(spark, sf, "lineitem").select("l_orderkey", F.struct((F.col("l_quantity") / 2).alias("km"), F.lit(None).cast("string").alias("label")).alias("d"))
    return li.withColumn("k", km_key(F.col("d")).cast("long")).groupBy("l_orderkey").agg(F.countDistinct("k").alias("n_keys"), F.sum("k").alias("sum_keys"))


def _weeks(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    e = _dated(spark, sf)
    first = e.filter(F.col("d") < day("2024-01-08")).groupBy(F.col("user_id").alias("id")).agg(F.max("event_id").alias("last_event"), F.count(F.lit(1)).alias("n"))
    second = e.filter(F.col("d").between(day("2024-01-08"), day("2024-01-09"))).groupBy(F.col("user_id").alias("id")).agg(F.max("event_id").alias("last_event"), F.count(F.lit(1)).alias("n"))
    return first, second


def reconcile_status(spark: SparkSession, sf: str) -> DataFrame:
    """Users of week one against the two days after: updated, inserted or missed."""
    a, b = _weeks(spark, sf)
    rows = a.alias("a").join(b.alias("b"), "id", "full")
    outcome = F.when(F.col("b.n").isNull(), "missed").when(F.col("a.n").isNull(), "inserted").when(F.col("a.n") == F.col("b.n"), "kept").otherwise("updated")
    return rows.select("id", outcome.alias("outcome"), F.coalesce("b.last_event", "a.last_event").alias("last_event"), F.when(F.col("b.n").isNull(), 1).otherwise(0).alias("miss_count"))


def selective_patch(spark: SparkSession, sf: str) -> DataFrame:
    """R5."""
    return reconcile.selective_patch(*_weeks(spark, sf))


def sticky_flag(spark: SparkSession, sf: str) -> DataFrame:
    """W7."""
    return table(spark, sf, "events").groupBy("user_id").agg(F.bool_or(F.col("event_type") == "error").alias("is_flagged"), F.count(F.lit(1)).alias("n"))


def _runs(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select(F.col("user_id").alias("source"), F.struct("ts", "event_id").alias("t"), (F.col("event_type") != "error").alias("ok"), F.col("event_id").alias("n"))


def failure_streak(spark: SparkSession, sf: str) -> DataFrame:
    """A user's errors since the last good event."""
    status = health.latest_status(_runs(spark, sf))
    bad = health.unhealthy(status).select("source", F.lit(True).alias("unhealthy"))
    return status.join(bad, "source", "left").select("source", F.col("last_success.event_id").alias("last_good"), "consecutive_failures", F.coalesce("unhealthy", F.lit(False)).alias("unhealthy"))


def last_40_runs(spark: SparkSession, sf: str) -> DataFrame:
    """W4."""
    return health.last_runs(_runs(spark, sf), 40).select("source", F.col("t.event_id").alias("event_id"), "rank")


def retention_clean(spark: SparkSession, sf: str) -> DataFrame:
    """The last 10 events of a user, and purchases before them until there are five."""
    e = table(spark, sf, "events").select("user_id", "event_id", F.struct("ts", "event_id").alias("t"), (F.col("event_type") == "purchase").alias("clean"))
    return health.retained(e, "user_id", "t", "clean", 10, 5).select("user_id", "event_id", "rank")


def json_props(spark: SparkSession, sf: str) -> DataFrame:
    """a number in landed JSON, by type."""
    e = table(spark, sf, "events").select("event_type", F.from_json("props", "k long").alias("p"))
    return e.groupBy("event_type").agg(F.sum("p.k").alias("sum_k"), F.count("p.k").alias("n"))


def jsonld_out(spark: SparkSession, sf: str) -> DataFrame:
    """K6: orders as schema.org events."""
    o = table(spark, sf, "orders")
    node = F.struct(F.lit("SportsEvent").alias("@type"), F.concat(F.lit("Order "), "o_orderkey").alias("name"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("startDate"))
    return o.select("o_orderkey", F.to_json(node).alias("json_ld"))


def daily_windows(spark: SparkSession, sf: str) -> DataFrame:
    """Counts and running counts a day and type (the batch form of the windowed stream)."""
    e = _dated(spark, sf).groupBy("event_type", F.date_format("d", "yyyy-MM-dd").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    running = Window.partitionBy("event_type").orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    return e.withColumn("running", F.sum("n").over(running))


SQL = {
    "months_with_new": f"SELECT strftime(ts, '%Y-%m') AS month, count(*) AS n_events, bool_or(CAST(ts AS DATE) >= DATE '{AS_OF}' - 15) AS has_new FROM events GROUP BY 1",
    "first_future_month": f"""SELECT month, n AS n_events, coalesce(month = min(CASE WHEN month >= '{ORDERS_AS_OF[:7]}' THEN month END) OVER (), false) AS expanded
        FROM (SELECT strftime(o_orderdate, '%Y-%m') AS month, count(*) AS n FROM orders GROUP BY 1)""",
    "period_presets": """SELECT event_type, count(*) FILTER (d IS NULL OR d = DATE '2024-01-15') AS n_today, count(*) FILTER (d IS NULL OR d BETWEEN DATE '2024-01-15' AND DATE '2024-02-14') AS "n_30",
        count(*) FILTER (d IS NULL OR d BETWEEN DATE '2024-01-15' AND DATE '2024-04-14') AS "n_90", count(*) FILTER (d IS NULL OR d BETWEEN DATE '2024-01-15' AND DATE '2024-07-13') AS "n_180",
        count(*) FILTER (d IS NULL OR d >= DATE '2024-01-15') AS n_all, count(*) FILTER (d IS NULL OR d BETWEEN DATE '2023-12-31' AND DATE '2024-01-14') AS n_past15,
        count(*) FILTER (d BETWEEN DATE '2024-01-10' AND DATE '2024-01-20') AS n_custom FROM (SELECT event_type, CASE WHEN event_type <> 'purchase' THEN CAST(ts AS DATE) END AS d FROM events) GROUP BY 1""",
    "location_filter": "SELECT r_name, n_name, count(*) AS n, round(sum(c_acctbal), 2) AS balance FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'EUROPE' GROUP BY 1, 2",
    "any_member_filter": "SELECT l_orderkey, string_agg(l_returnflag, ',' ORDER BY l_returnflag) AS flags FROM (SELECT DISTINCT l_orderkey, l_returnflag FROM lineitem) GROUP BY 1 HAVING bool_or(l_returnflag IN ('R', 'A'))",
    "distance_pills": "SELECT p_size, count(*) AS n FROM part WHERE abs(p_size - 5) <= 0.5 OR abs(p_size - 21.097) <= 0.5 OR p_size NOT IN (5, 10, 21, 42) GROUP BY 1",
    "facet_leave_one_out": """SELECT 'type' AS facet, event_type AS value, count(*) AS n FROM events WHERE user_id % 5 < 3 AND CAST(ts AS DATE) BETWEEN DATE '2024-01-15' AND DATE '2024-02-14' GROUP BY 2
        UNION ALL SELECT 'group', CAST(user_id % 5 AS VARCHAR), count(*) FROM events WHERE CAST(ts AS DATE) BETWEEN DATE '2024-01-15' AND DATE '2024-02-14' GROUP BY 2""",
    "slim_projection": """SELECT o_orderkey, '{"id":' || o_orderkey || ',"date":"' || strftime(o_orderdate, '%Y-%m-%d') || '"' || CASE WHEN o_orderstatus <> 'O' THEN ',"status":"' || o_orderstatus || '"' ELSE '' END || '}' AS json FROM orders""",
    "boot_window": f"SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS event_date FROM orders WHERE CAST(o_orderdate AS DATE) BETWEEN DATE '{ORDERS_AS_OF}' - 15 AND DATE '{ORDERS_AS_OF}' + 30",
    "archive_split": f"SELECT CASE WHEN CAST(o_orderdate AS DATE) >= DATE '{ORDERS_AS_OF}' - 15 THEN 'active' ELSE strftime(o_orderdate, '%Y-%m') END AS part, count(*) AS n FROM orders GROUP BY 1",
    "topk_padded": "SELECT c_custkey, c_nationkey, c_acctbal FROM customer ORDER BY c_nationkey IN (1, 3, 7) DESC, c_acctbal, c_custkey LIMIT 120",
    "stratified_sample": """SELECT doc_id, stratum, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY md5('s' || doc_id)) AS rank
        FROM (SELECT doc_id, CASE WHEN lang = 'en' THEN 'en' ELSE 'other' END AS stratum FROM documents)) WHERE rank <= CASE stratum WHEN 'en' THEN 30 ELSE 10 END""",
    "first_wins_dedup": "SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS r FROM events) WHERE r = 1",
    "survivor_fold": """SELECT user_id, arg_min(event_id, (ts, event_id)) AS head, round(arg_min(value, (ts, event_id)) FILTER (event_type = 'purchase'), 6) AS first_purchase, bool_or(event_type = 'error') AS any_error,
        string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS types FROM events GROUP BY 1""",
    "distance_union": "SELECT l_orderkey, count(DISTINCT k) AS n_keys, CAST(sum(k) AS BIGINT) AS sum_keys FROM (SELECT l_orderkey, CAST(round_even(l_quantity / 2, 0) AS BIGINT) AS k FROM lineitem) GROUP BY 1",
    "reconcile_status": """WITH a AS (SELECT user_id AS id, max(event_id) AS last_event, count(*) AS n FROM events WHERE ts < TIMESTAMP '2024-01-08' GROUP BY 1),
        b AS (SELECT user_id AS id, max(event_id) AS last_event, count(*) AS n FROM events WHERE ts >= TIMESTAMP '2024-01-08' AND ts < TIMESTAMP '2024-01-10' GROUP BY 1)
        SELECT coalesce(a.id, b.id) AS id, CASE WHEN b.n IS NULL THEN 'missed' WHEN a.n IS NULL THEN 'inserted' WHEN a.n = b.n THEN 'kept' ELSE 'updated' END AS outcome,
        coalesce(b.last_event, a.last_event) AS last_event, CASE WHEN b.n IS NULL THEN 1 ELSE 0 END AS miss_count FROM a FULL JOIN b ON a.id = b.id""",
    "selective_patch": """WITH a AS (SELECT user_id AS id, max(event_id) AS last_event, count(*) AS n FROM events WHERE ts < TIMESTAMP '2024-01-08' GROUP BY 1),
        b AS (SELECT user_id AS id, max(event_id) AS last_event, count(*) AS n FROM events WHERE ts >= TIMESTAMP '2024-01-08' AND ts < TIMESTAMP '2024-01-10' GROUP BY 1)
        SELECT * FROM b UNION ALL SELECT * FROM a WHERE id NOT IN (SELECT id FROM b)""",
    "sticky_flag": "SELECT user_id, bool_or(event_type = 'error') AS is_flagged, count(*) AS n FROM events GROUP BY 1",
    "failure_streak": """WITH g AS (SELECT user_id, max((ts, event_id)) FILTER (event_type <> 'error') AS good FROM events GROUP BY 1)
        SELECT e.user_id AS source, any_value(good[2]) AS last_good, count(*) FILTER (good IS NULL OR (ts, event_id) > good) AS consecutive_failures,
        any_value(good) IS NULL OR count(*) FILTER (good IS NULL OR (ts, event_id) > good) >= 3 AS unhealthy FROM events e JOIN g ON e.user_id = g.user_id GROUP BY 1""",
    "last_40_runs": "SELECT source, event_id, CAST(rank AS INTEGER) AS rank FROM (SELECT user_id AS source, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rank FROM events) WHERE rank <= 40",
    "retention_clean": """SELECT user_id, event_id, CAST(rank AS INTEGER) AS rank FROM (SELECT user_id, event_id, event_type = 'purchase' AS clean, row_number() OVER w AS rank,
        count(*) FILTER (event_type = 'purchase') OVER w AS n_clean FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts DESC, event_id DESC ROWS UNBOUNDED PRECEDING)) WHERE rank <= 10 OR (clean AND n_clean <= 5)""",
    "json_props": "SELECT event_type, CAST(sum(CAST(json_extract(props, '$.k') AS BIGINT)) AS BIGINT) AS sum_k, count(json_extract(props, '$.k')) AS n FROM events GROUP BY 1",
    "jsonld_out": """SELECT o_orderkey, '{"@type":"SportsEvent","name":"Order ' || o_orderkey || '","startDate":"' || strftime(o_orderdate, '%Y-%m-%d') || '"}' AS json_ld FROM orders""",
    "daily_windows": """SELECT event_type, day, n, CAST(sum(n) OVER (PARTITION BY event_type ORDER BY day) AS BIGINT) AS running FROM (SELECT event_type, strftime(ts, '%Y-%m-%d') AS day, count(*) AS n FROM events GROUP BY 1, 2)""",
}
QUERIES = {name: globals()[name] for name in SQL}
