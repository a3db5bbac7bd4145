"""Queries over documents, pages, parts and orders: blocking, decisions, clusters, lookups, checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.functions import structured, text
from cadenza.functions.distance import extract_distances
from cadenza.operators import enrich, quality, resolve, search
from cadenza.operators.components import connected_components
from cadenza.plans.events import day, table

#: Bands of quantities (fixed values).
BANDS = [(1, 10, "few"), (11, 25, "some"), (26, 40, "many"), (41, 50, "most")]
#: Words whose parts are looked for in part names (fixed values).
WORD_SETS = [("small", "a"), ("red widget", "b"), ("gear hot", "c")]


def search_all_tokens(spark: SparkSession, sf: str) -> DataFrame:
    """Documents that hold all words of a search, accents ignored."""
    d = table(spark, sf, "documents")
    return d.filter(search.matches_search("de QUE la", F.col("text"))).select("doc_id", "lang")


def keep_best(spark: SparkSession, sf: str) -> DataFrame:
    """Of documents with the same normalized text the longest, ties to the first."""
    d = table(spark, sf, "documents").select("doc_id", "n_chars", F.md5(F.lower(F.trim("text"))).alias("h"))
    return quality.first_of(d, ["h"], F.col("n_chars").desc(), F.col("doc_id")).select("doc_id", "h")


def overused_keys(spark: SparkSession, sf: str) -> DataFrame:
    """Hosts of pages used three times or more."""
    p = table(spark, sf, "pages").select(text.host(F.col("url")).alias("host"))
    return p.groupBy("host").agg(F.count(F.lit(1)).alias("n")).filter("n >= 3")


def _exact(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select(F.col("doc_id").alias("ordinal"), F.array(F.md5("text")).alias("links"))


def equi_block_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Copies of a text, each with the first of them."""
    return resolve.sharing_link(_exact(spark, sf))


def components_size(spark: SparkSession, sf: str) -> DataFrame:
    """A2: clusters of exact copies with their sizes."""
    return connected_components(resolve.sharing_link(_exact(spark, sf))).groupBy("component").agg(F.count(F.lit(1)).alias("n"))


def band_pairs_31d(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs of a customer's orders at most 31 days apart."""
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("ordinal"), F.to_date("o_orderdate").alias("day"), "o_custkey")
    return resolve.within_days(o, 31, "o_custkey")


def same_day_cross_group(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs of one customer's orders of a day that differ in status."""
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("ordinal"), F.to_date("o_orderdate").alias("day"), F.col("o_orderstatus").alias("sub"), F.lit("BR").alias("country"), F.concat_ws(" ", F.md5((F.col("o_custkey") % 50).cast("string")), F.md5((F.col("o_custkey") % 50 + 1000).cast("string"))).alias("key"))
    return resolve.same_day_elsewhere(o)


def _edit_ratio(a: Column, b: Column) -> Column:
    return 1 - F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b), F.lit(1))


def dup_decision(spark: SparkSession, sf: str) -> DataFrame:
    """R1 with an edit-distance similarity: parts of a brand as records of one day."""
    p = table(spark, sf, "part")
    rows = p.select(
        F.col("p_partkey").alias("ordinal"), F.date_add(day("2024-01-01"), (F.col("p_size") % 40).cast("int")).alias("day"), F.substring("p_brand", -2, 2).alias("sub"), F.lit("BR").alias("country"),
        F.lower(F.element_at(F.split("p_type", " "), 1)).alias("town"), F.lower("p_name").alias("key"), F.array((F.col("p_size") % 5).cast("string")).alias("kms"), F.array().cast("array<string>").alias("links"),
    )
    return resolve.all_within_days(rows, 31, similarity=_edit_ratio)


def semi_valid_location(spark: SparkSession, sf: str) -> DataFrame:
    """Suppliers of nations in three regions."""
    n = table(spark, sf, "nation").filter("n_regionkey < 3")
    return table(spark, sf, "supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey"), "left_semi").select("s_suppkey", "s_nationkey")


def anti_invalid_location(spark: SparkSession, sf: str) -> DataFrame:
    """The suppliers left over, counted by nation."""
    n = table(spark, sf, "nation").filter("n_regionkey < 3")
    return table(spark, sf, "supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey"), "left_anti").groupBy("s_nationkey").agg(F.count(F.lit(1)).alias("n"))


def two_level_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """Customers by segment and nation, else by segment if the segment's nation agrees."""
    n = table(spark, sf, "nation")
    own = n.filter("n_nationkey % 2 = 0").select(F.lit("building").alias("key"), F.col("n_name").alias("hint_country"), F.col("n_name").alias("country"), F.concat(F.lit("own "), "n_name").alias("subdivision"))
    base = n.filter("n_nationkey = 1").select(F.lit("building").alias("key"), F.lit(None).cast("string").alias("hint_country"), F.col("n_name").alias("country"), F.lit("base").alias("subdivision"))
    c = table(spark, sf, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "c_mktsegment", "n_name")
    return enrich.lookup_two_levels(c, own.union(base), F.col("c_mktsegment"), F.col("n_name")).select("c_custkey", "found_country", "found_subdivision")


def range_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """Line items by band of quantity."""
    bands = spark.createDataFrame(BANDS, "first int, last int, label string")
    return enrich.lookup_range(table(spark, sf, "lineitem").select("l_quantity"), F.col("l_quantity"), bands).groupBy("label").agg(F.count(F.lit(1)).alias("n"))


def label_argmax(spark: SparkSession, sf: str) -> DataFrame:
    """Each order's highest tier among feed days at most two days away."""
    feed = spark.createDataFrame([("1997-01-10", 1, "label"), ("1997-01-12", 3, "gold"), ("1997-03-01", 2, "elite"), ("1997-03-02", 4, "platinum")], "d string, rank int, tier string")
    feed = feed.select(F.explode(F.sequence(F.date_sub(F.to_date("d"), 2), F.date_add(F.to_date("d"), 2))).alias("near"), "rank", "tier")
    o = table(spark, sf, "orders").withColumn("day", F.to_date("o_orderdate"))
    return o.join(feed, F.col("day") == F.col("near")).groupBy("o_orderkey").agg(F.max_by("tier", "rank").alias("tier"))


def token_subset(spark: SparkSession, sf: str) -> DataFrame:
    """Parts whose name holds all words of a set."""
    sets = spark.createDataFrame(WORD_SETS, "words string, label string").select("label", F.split("words", " ").alias("s"))
    words = sets.select("label", F.size("s").alias("n"), F.explode("s").alias("w"))
    p = table(spark, sf, "part").select("p_partkey", F.explode(F.array_distinct(F.split(F.lower("p_name"), " "))).alias("w"))
    found = p.join(F.broadcast(words), "w").groupBy("p_partkey", "label", "n").agg(F.count(F.lit(1)).alias("m"))  # a few word sets
    return found.filter("m = n").select("p_partkey", "label")


def strip_shared(spark: SparkSession, sf: str) -> DataFrame:
    """documents' sources as listings: those shared by ten or more go, but a document's last stays."""
    d = table(spark, sf, "documents")
    one = lambda n, p: F.struct(n.alias("name"), p.alias("page_url"), F.array(p).alias("signup_urls"), F.lit("calendar").alias("kind"))
    own = F.concat(F.lit("own"), F.col("doc_id") % 400)
    e = d.select(F.col("doc_id").cast("string").alias("id"), F.array(one(F.col("source"), F.col("lang")), one(own, own)).alias("listings"))
    return quality.strip_shared_listings(e, 10).select("id", F.concat_ws(",", F.transform("listings", lambda x: x["name"])).alias("kept"))


def drop_nonunique(spark: SparkSession, sf: str) -> DataFrame:
    """Of three or more documents with the same text only the longest stays."""
    d = table(spark, sf, "documents")
    none = F.array().cast("array<string>")
    e = d.select(F.col("doc_id").alias("id"), none.alias("listings"), F.array_repeat(F.lit("x"), (F.col("doc_id") % 3).cast("int")).alias("distances"), F.lit(None).cast("string").alias("image_url"), F.md5("text").alias("link"))
    return quality.drop_shared_links(e, F.col("link"), F.col("id"), 3).select("id")


def rule_violations(spark: SparkSession, sf: str) -> DataFrame:
    """Rules that pages break, counted."""
    p = table(spark, sf, "pages").withColumn("title", structured.html_title(F.col("html")))
    rules = F.array_compact(F.array(F.when(text.has_entities(F.col("title")), "entities_in_title"), F.when(F.length("title") < 12, "short_title"), F.when(~F.col("url").rlike("^https?://"), "link_not_http"), F.when(F.size(structured.html_links(F.col("html"))) == 0, "no_links")))
    return p.select(F.explode(rules).alias("rule")).groupBy("rule").agg(F.count(F.lit(1)).alias("n"))


def truth_check(spark: SparkSession, sf: str) -> DataFrame:
    """documents' labels against a rule on their text."""
    d = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id")
    loud = F.length(F.regexp_replace("text", "[^!*&%$#|]", "")) * 20 > F.length("text")
    verdict = F.when(loud & (F.col("quality") == 1), "error").when(~loud & (F.col("quality") == 0), "warning").otherwise("ok")
    return d.groupBy(verdict.alias("verdict")).agg(F.count(F.lit(1)).alias("n"))


def html_title(spark: SparkSession, sf: str) -> DataFrame:
    """F65."""
    return table(spark, sf, "pages").select("page_id", structured.html_title(F.col("html")).alias("title"))


def html_links(spark: SparkSession, sf: str) -> DataFrame:
    """links of each page, counted, with the first."""
    p = table(spark, sf, "pages").select("page_id", structured.html_links(F.col("html")).alias("links"))
    return p.select("page_id", F.size("links").cast("long").alias("n"), F.coalesce(F.get("links", 0), F.lit("")).alias("first"))


def page_text(spark: SparkSession, sf: str) -> DataFrame:
    """what pages show, as a length and a hash."""
    p = table(spark, sf, "pages").select("page_id", structured.visible_text(F.col("html")).alias("t"))
    return p.select("page_id", F.length("t").alias("n"), F.md5("t").alias("h"))


def title_similarity(spark: SparkSession, sf: str) -> DataFrame:
    """difflib similarity of parts with nearby keys."""
    p = table(spark, sf, "part").select("p_partkey", F.lower("p_name").alias("k"))
    other = p.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("k").alias("k2"))
    return p.join(other, "p_partkey").select("p_partkey", F.round(text.title_similarity(F.col("k"), F.col("k2")), 9).alias("sim"))


def distance_extract(spark: SparkSession, sf: str) -> DataFrame:
    """F40 over sentences made from parts."""
    p = table(spark, sf, "part")
    t = F.concat(F.lit("Percursos de "), "p_size", F.lit(", 10 e "), F.col("p_size") % 7 + 12, F.lit(" km, R$ "), F.round("p_retailprice", 2))
    return p.select("p_partkey", F.concat_ws(" ", F.transform(extract_distances(t, F.lit("")), lambda x: x.cast("string"))).alias("km"))


FOLDED = "strip_accents(lower(text))"
SQL = {
    "search_all_tokens": f"SELECT doc_id, lang FROM documents WHERE contains({FOLDED}, 'de') AND contains({FOLDED}, 'que') AND contains({FOLDED}, 'la')",
    "keep_best": "SELECT doc_id, h FROM (SELECT doc_id, md5(lower(trim(text))) AS h, row_number() OVER (PARTITION BY md5(lower(trim(text))) ORDER BY n_chars DESC, doc_id) AS r FROM documents) WHERE r = 1",
    "overused_keys": r"SELECT regexp_replace(lower(regexp_extract(url, '^[A-Za-z]+://([^/:?#]+)', 1)), '^www[.]', '') AS host, count(*) AS n FROM pages GROUP BY 1 HAVING count(*) >= 3",
    "equi_block_pairs": "SELECT a, b FROM (SELECT doc_id AS b, min(doc_id) OVER (PARTITION BY md5(text)) AS a FROM documents) WHERE a <> b",
    "components_size": "SELECT min(doc_id) AS component, count(*) AS n FROM documents GROUP BY md5(text) HAVING count(*) > 1",
    "band_pairs_31d": """SELECT a.o_orderkey AS a, b.o_orderkey AS b FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey
        AND (CAST(b.o_orderdate AS DATE), b.o_orderkey) > (CAST(a.o_orderdate AS DATE), a.o_orderkey) AND CAST(b.o_orderdate AS DATE) - CAST(a.o_orderdate AS DATE) <= 31""",
    "same_day_cross_group": """SELECT a.o_orderkey AS a, b.o_orderkey AS b FROM orders a JOIN orders b ON CAST(a.o_orderdate AS DATE) = CAST(b.o_orderdate AS DATE) AND a.o_custkey % 50 = b.o_custkey % 50
        AND a.o_orderstatus <> b.o_orderstatus AND a.o_orderkey < b.o_orderkey""",
    "dup_decision": """WITH p AS (SELECT p_partkey AS o, DATE '2024-01-01' + CAST(p_size % 40 AS INTEGER) AS d, right(p_brand, 2) AS sub, lower(split_part(p_type, ' ', 1)) AS town, lower(p_name) AS k, p_size % 5 AS km FROM part),
        q AS (SELECT a.o AS a, b.o AS b, b.d - a.d AS gap, a.town = b.town AS same_town, 1 - levenshtein(a.k, b.k) / CAST(greatest(len(a.k), len(b.k), 1) AS DOUBLE) AS sim, a.k AS ka, b.k AS kb,
        CASE WHEN len(string_split(a.k, ' ')) <= len(string_split(b.k, ' ')) THEN string_split(a.k, ' ') ELSE string_split(b.k, ' ') END AS s,
        CASE WHEN len(string_split(a.k, ' ')) <= len(string_split(b.k, ' ')) THEN string_split(b.k, ' ') ELSE string_split(a.k, ' ') END AS l
        FROM p a JOIN p b ON a.sub = b.sub AND (b.d, b.o) > (a.d, a.o) AND b.d - a.d <= 31 AND a.km = b.km)
        SELECT a, b FROM q WHERE same_town AND ((sim >= 0.95 AND gap <= 30) OR (sim >= 0.85 AND gap <= 14) OR (gap = 0 AND (sim >= 0.75 OR (len(s) >= 2 AND list_has_all(l, s)) OR (ka = kb AND ka <> ''))))""",
    "semi_valid_location": "SELECT s_suppkey, s_nationkey FROM supplier WHERE s_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey < 3)",
    "anti_invalid_location": "SELECT s_nationkey, count(*) AS n FROM supplier WHERE s_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey < 3) GROUP BY 1",
    "two_level_lookup": """SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' AND (n_nationkey % 2 = 0 OR n_nationkey = 1) THEN n_name END AS found_country,
        CASE WHEN c_mktsegment = 'BUILDING' AND n_nationkey % 2 = 0 THEN 'own ' || n_name WHEN c_mktsegment = 'BUILDING' AND n_nationkey = 1 THEN 'base' END AS found_subdivision FROM customer JOIN nation ON c_nationkey = n_nationkey""",
    "range_lookup": "SELECT CASE WHEN l_quantity BETWEEN 1 AND 10 THEN 'few' WHEN l_quantity BETWEEN 11 AND 25 THEN 'some' WHEN l_quantity BETWEEN 26 AND 40 THEN 'many' WHEN l_quantity BETWEEN 41 AND 50 THEN 'most' END AS label, count(*) AS n FROM lineitem GROUP BY 1",
    "label_argmax": """SELECT o_orderkey, arg_max(tier, rank) AS tier FROM orders JOIN (VALUES (DATE '1997-01-10', 1, 'label'), (DATE '1997-01-12', 3, 'gold'), (DATE '1997-03-01', 2, 'elite'), (DATE '1997-03-02', 4, 'platinum')) f(d, rank, tier)
        ON abs(CAST(o_orderdate AS DATE) - d) <= 2 GROUP BY 1""",
    "token_subset": "SELECT p_partkey, label FROM part JOIN (VALUES ('small', 'a'), ('red widget', 'b'), ('gear hot', 'c')) s(words, label) ON list_has_all(string_split(lower(p_name), ' '), string_split(words, ' '))",
    "strip_shared": """WITH l AS (SELECT doc_id, 1 AS i, source AS n, lang AS p FROM documents UNION ALL SELECT doc_id, 2, 'own' || doc_id % 400, 'own' || doc_id % 400 FROM documents),
        u AS (SELECT n, p, count(DISTINCT doc_id) >= 10 AS shared FROM l GROUP BY 1, 2), m AS (SELECT l.*, shared, count(*) FILTER (NOT shared) OVER (PARTITION BY doc_id) AS free FROM l JOIN u USING (n, p))
        SELECT CAST(doc_id AS VARCHAR) AS id, string_agg(n, ',' ORDER BY i) AS kept FROM m WHERE NOT shared OR (free = 0 AND i = 2) GROUP BY 1""",
    "drop_nonunique": "SELECT doc_id AS id FROM (SELECT doc_id, count(*) OVER (PARTITION BY md5(text)) AS n, row_number() OVER (PARTITION BY md5(text) ORDER BY doc_id % 3 DESC, doc_id) AS r FROM documents) WHERE n < 3 OR r = 1",
    "rule_violations": r"""WITH t AS (SELECT url, trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)) AS title, html FROM pages)
        SELECT rule, count(*) AS n FROM (SELECT 'entities_in_title' AS rule FROM t WHERE regexp_matches(title, '&(amp|lt|gt|quot|nbsp|#[0-9]+);') UNION ALL SELECT 'short_title' FROM t WHERE len(title) < 12
        UNION ALL SELECT 'link_not_http' FROM t WHERE NOT regexp_matches(url, '^https?://') UNION ALL SELECT 'no_links' FROM t WHERE NOT regexp_matches(html, '(?i)<a\s[^>]*?href\s*=\s*["''][^"'']*["'']')) GROUP BY 1""",
    "truth_check": """SELECT verdict, count(*) AS n FROM (SELECT CASE WHEN loud AND quality = 1 THEN 'error' WHEN NOT loud AND quality = 0 THEN 'warning' ELSE 'ok' END AS verdict
        FROM (SELECT quality, len(regexp_replace(text, '[^!*&%$#|]', '', 'g')) * 20 > len(text) AS loud FROM documents JOIN labels USING (doc_id))) GROUP BY 1""",
    "html_title": "SELECT page_id, trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)) AS title FROM pages",
    "html_links": r"""SELECT page_id, CAST(len(l) AS BIGINT) AS n, coalesce(l[1], '') AS first FROM (SELECT page_id, regexp_extract_all(html, '(?i)<a\s[^>]*?href\s*=\s*["'']([^"'']*)["'']', 1) AS l FROM pages)""",
}
NAMES = [*SQL, "page_text", "title_similarity", "distance_extract"]
QUERIES = {name: globals()[name] for name in NAMES}
