"""Queries of the text, date, distance and payload functions, and of the readers, over texts made from the tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.functions import dates, distance, structured, text
from cadenza.operators import truth
from cadenza.operators.components import shared_path
from cadenza.plans.events import day, table
from cadenza.plans.records import EV, made_events, pick
from cadenza.schema import RACE_EVENT
from cadenza.sources import parsers, readers
from cadenza.sources.registry import Registry

AS_OF = "1996-06-01"


def _orders(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), F.to_date("o_orderdate").alias("d"))


def _joined(*x) -> Column:
    return F.concat(*(F.lit(v) if isinstance(v, str) else v.cast("string") for v in x))


def text_forms(spark: SparkSession, sf: str) -> DataFrame:
    """Documents folded, as slugs, as title keys, cleaned; by hash."""
    t = F.col("text")
    return table(spark, sf, "documents").select("doc_id", F.md5(text.fold(t)).alias("folded"), F.md5(text.slug(t)).alias("slug"), F.md5(text.clean_text(F.concat(t, F.lit("\x01\x02 \x7f x")))).alias("clean"), F.coalesce(text.has_entities(F.concat(t, F.when(F.col("doc_id") % 3 == 0, " &amp;").otherwise(""))), F.lit(False)).alias("dirty"))


def title_keys(spark: SparkSession, sf: str) -> DataFrame:
    """F2, F8: title keys of made records, and whether one's words are in the next one's."""
    e = made_events(spark, sf).select("id", "title", F.concat_ws(" ", "title", F.when(F.col("ordinal") % 2 == 0, "da Praia")).alias("longer"))
    return e.select("id", text.title_key("title").alias("key"), text.tokens_contained(text.title_tokens("title"), text.title_tokens("longer")).alias("inside"))


def display_titles(spark: SparkSession, sf: str) -> DataFrame:
    """display forms of titles with entities, editions, states and lengths; titles of activities."""
    k = F.col("ordinal")
    raw = _joined(pick(("iv", "XXVII", "3ª", "sp"), k % 4).cast("string"), " corrida &amp;amp; festa ", pick(("SP", "df", "10k"), k % 3), " ", F.lower("title"))
    activity = _joined("Ana on Feed:  ", F.col("title"), " \U0001f3c3 | Feed")
    return made_events(spark, sf).select("id", text.normal_title(raw).alias("title"), text.activity_title(activity, r"\w+ on Feed:\s*", r"\s*\|\s*Feed").alias("activity"))


def city_forms(spark: SparkSession, sf: str) -> DataFrame:
    """Parts of places."""
    e = made_events(spark, sf)
    k, part, sub = F.col("ordinal"), pick(("santo andre", "sao jose dos campos", "rio"), F.col("ordinal") % 3), F.col("subdivision")
    place = F.when(k % 4 == 0, _joined(part, "-", sub)).when(k % 4 == 1, _joined("Praça, ", part, " - ", sub)).when(k % 4 == 2, _joined(part, ", ", sub)).otherwise("A definir")
    both, split = text.city_and_subdivision(place), text.split_place(_joined(part, " · ", sub, " | Brasil"))
    from cadenza.operators.enrich import rebuilt_location

    return e.select("id", both["city"].alias("city"), both["subdivision"].alias("sub"), text.last_part(place).alias("last"), text.display_city(part, {"rio": "Rio de Janeiro"}).alias("shown"), text.plausible_city(F.when(k % 5 == 0, "Parque da Cidade").when(k % 5 == 1, "km 10").otherwise(part)).alias("plausible"), F.concat_ws("/", split["city"], split["second"], split["country"]).alias("split"), rebuilt_location(F.col("city"), sub, F.col("country"), place).alias("location"))


def link_forms(spark: SparkSession, sf: str) -> DataFrame:
    """Keys, hosts and parameters of links; JSONP bodies."""
    k = F.col("k")
    url = _joined("https://user@WWW.S", k % 7, ".com.br/Event/", k, "//")
    query = _joined("https://x.org/a?id=", k, "&uf=S%C3%A3o+", k % 3, "#t")
    return _orders(spark, sf).select("k", text.link_key(url, {r"/Event/(\d+[05])/": "ticket:"}).alias("key"), text.host(url).alias("host"), text.registered_domain(url).alias("domain"), structured.query_parameter(query, "uf").alias("uf"), structured.unwrap_jsonp(_joined("cb.fn({\"k\": ", k, "}) ;\n")).alias("body"))


def parsed_dates(spark: SparkSession, sf: str) -> DataFrame:
    """dates written in several ways read back."""
    k, d = F.col("k"), F.col("d")
    month = pick(("janeiro", "fevereiro", "março", "abril", "maio", "junho", "julho", "agosto", "setembro", "outubro", "novembro", "dezembro"), F.month(d) - 1)
    ways = [F.date_format(d, "yyyy-MM-dd'T'HH:mm"), F.date_format(d, "dd/MM/yyyy"), F.concat(F.dayofmonth(d).cast("string"), F.lit(" de "), month, F.lit(" de "), F.year(d).cast("string")), F.date_format(d, "MMMM d, yyyy"), F.lit("31/02/2024")]
    raw = F.get(F.array(*ways), (k % 5).cast("int"))
    page = F.concat(F.lit("Em "), F.date_format(F.date_add(d, 9), "d/M/yyyy"), F.lit(" ou "), ways[2], F.lit(", "), F.date_format(d, "yyyy-MM-dd"))
    found = dates.date_candidates(page, 1990, 2005)
    show = lambda x: F.date_format(x, "yyyy-MM-dd")
    first = dates.first_found(F.concat(F.lit("largada 7h15, sunday 6h"), (k % 10).cast("string")), r"domingo (\d+h\d)", r"sunday (\d+h\d)", r"(\d+h\d+)")
    return _orders(spark, sf).select("k", show(dates.parse_date(raw)).alias("date"), F.array_join(F.transform(found, show), ",").alias("found"), show(dates.next_date(found, F.date_add(d, 1))).alias("next"), show(dates.earliest_of(F.concat(F.date_format(F.date_add(d, 3), "d/M/yyyy"), F.lit(" a "), F.date_format(d, "dd/MM/yyyy")))).alias("earliest"), structured.full_year(F.date_format(d, "yy")).alias("year"), first.alias("first"))


def parsed_times(spark: SparkSession, sf: str) -> DataFrame:
    """Clock times read back, the implausible ones left out."""
    k = F.col("k")
    h, m = (k % 24).cast("int"), F.lpad((k % 60).cast("string"), 2, "0")
    raw = F.when(k % 3 == 0, _joined(h, "h", m)).when(k % 3 == 1, _joined(h, ":", m)).otherwise(_joined(h, "h"))
    twelve = _joined((h + 11) % 12 + 1, ":", m, F.when(h < 12, " AM").otherwise(" p.m."))
    nested = _joined('{"a": [{"end": "2024-01-01T03:00"}, {"startDate": "2024-01-01T', F.lpad(h.cast("string"), 2, "0"), ":", m, ':00"}]}')
    return _orders(spark, sf).select("k", dates.parse_time(raw).alias("time"), dates.parse_time_12h(twelve).alias("twelve"), dates.plausible_time(dates.parse_time(raw), 5, 22).alias("plausible"), structured.start_time_in(nested).alias("start"), F.trim(structured.without_times(_joined("às ", h, "h", m, " 10 km, água a cada ", k % 9, " km"))).alias("rest"))


def date_rules(spark: SparkSession, sf: str) -> DataFrame:
    """years inferred from month and day, tolerances, dates in full."""
    d = F.col("d")
    inferred = dates.infer_year(F.date_format(d, "MM"), F.date_format(d, "dd"), day(AS_OF))
    near = dates.dates_compatible(d, F.when(F.col("k") % 4 != 0, day(AS_OF)), 14)
    return _orders(spark, sf).select("k", F.date_format(inferred, "yyyy-MM-dd").alias("inferred"), near.alias("near"), dates.long_date(d, "pt").alias("pt"), dates.long_date(d, "en").alias("en"), dates.long_date(d, "ja").alias("ja"), dates.long_date(d, "de").alias("de"))


def distance_forms(spark: SparkSession, sf: str) -> DataFrame:
    """Distances from words, units and titles; labels; money."""
    k = F.col("k")
    none = F.lit(None).cast("string")
    as_text = lambda s: F.concat_ws("|", s["km"].cast("string"), s["label"])
    kms = F.array((k % 9).cast("double"), (k % 9 + 0.3).cast("double"), F.lit(21.097))
    title = _joined(pick(("Half Marathon", "1/2 Marathon & 10k", "Marathon, Five Mile", "24 Hour Run 50 km", "12.5-mile and 10K"), k % 5))
    label = distance.km_label(F.struct(pick((5.0, 10.0, 21.097, 42.195), k % 4).alias("km"), none.alias("label")))
    return _orders(spark, sf).select(
        "k", distance.named_distance(pick(("Dez Milhas", "meia maratona", "7,5 k", "nada"), k % 4)).alias("named"), as_text(distance.from_units((k % 30).cast("double"), pick(("K", "M", "metros", "hours"), k % 4))).alias("units"),
        F.array_join(F.transform(distance.thin(kms), lambda x: x.cast("string")), ",").alias("thinned"), F.array_join(F.transform(structured.whole_or_canonical(kms), lambda x: x.cast("string")), ",").alias("whole"),
        F.array_join(distance.spelled_distances(title), ",").alias("spelled"), distance.expanded_units(_joined(k % 7 + 1, "/10/21km e ", k % 5, " e 8 km")).alias("expanded"), label.alias("label"),
        text.money(_joined("R$ ", k % 9 + 1, ".234,5", k % 10)).alias("money"), distance.plausible_km((k % 100).cast("double"), 80, 95, 87.7).alias("plausible"),
    )


def prose_distances(spark: SparkSession, sf: str) -> DataFrame:
    """Lengths enumerated in prose, prices and more than eight left out; start times below headings."""
    k = F.col("k")
    prose = _joined("Inscrição R$ 89,90. Percursos de ", k % 5 + 3, ", 12 e ", k % 9 + 30, " km")
    sections = _joined("Percurso ", k % 5 + 3, " km e 21 km:\nconcentração\n", F.lpad((k % 24).cast("string"), 2, "0"), "h", F.lpad((k % 60).cast("string"), 2, "0"), " largada\n10 km:\nsem hora")
    told = F.transform(distance.section_times(sections), lambda x: F.concat_ws("@", x["km"].cast("string"), x["start_time"]))
    return _orders(spark, sf).select("k", F.array_join(F.transform(distance.extract_distances(prose, F.lit("")), lambda x: x.cast("string")), ",").alias("kms"), F.array_join(told, ",").alias("times"))


def record_fullness(spark: SparkSession, sf: str) -> DataFrame:
    """F50."""
    from cadenza.operators.quality import completeness

    e = made_events(spark, sf)
    return e.select("id", completeness(e).cast("long").alias("score"))


def _pages(spark: SparkSession, sf: str) -> DataFrame:
    """Pages with two events in their JSON-LD, a meta tag, embedded data and a sitemap; made from orders."""
    e = made_events(spark, sf).filter("event_date IS NOT NULL")
    node = F.struct(F.array(F.lit("SportsEvent")).alias("@type"), F.col("title").alias("name"), F.date_format("event_date", "yyyy-MM-dd").alias("startDate"), F.struct(F.struct(F.col("subdivision").alias("addressRegion"), F.lit("x").alias("addressLocality")).alias("address")).alias("location"))
    graph = F.to_json(F.struct(F.array(node, F.struct(F.array(F.lit("Thing"), F.lit("Event")).alias("@type"), F.col("id").alias("name"), F.lit(None).cast("string").alias("startDate"), F.lit(None).cast("struct<address:struct<addressRegion:string,addressLocality:string>>").alias("location"))).alias("@graph")))
    head = _joined("<html><head><title>", F.col("title"), '</title><meta property="og:image" content="https://i/', F.col("id"), '.jpg"><script type="application/ld+json">', graph, "</script>")
    data = _joined('<script id="__NEXT_DATA__" type="application/json">{"props": {"n": ', F.col("ordinal"), "}}</script>")
    body = _joined("<body><p>Inscrições ", pick(("abertas", "encerradas", "em breve"), F.col("ordinal") % 3), "</p><script>var a = \"[{\\\"id\\\": ", F.col("ordinal"), "}]\";</script></body></html>")
    return e.select("id", "ordinal", "title", "subdivision", "event_date", F.concat(head, data, body).alias("html"))


def page_events(spark: SparkSession, sf: str) -> DataFrame:
    """events in the JSON-LD of pages, from a graph and whatever they are nested in."""
    rows = readers.json_ld_records(_pages(spark, sf), "made")
    return rows.select("id", "event.name", F.coalesce("event.start", F.lit("none")).alias("start"), F.coalesce("event.region", F.lit("none")).alias("region"))


def page_parts(spark: SparkSession, sf: str) -> DataFrame:
    """Meta tags, embedded data, arrays in scripts, text shown, open or closed."""
    h = F.col("html")
    shown = structured.visible_text(h)
    return _pages(spark, sf).select("id", structured.meta_property(h, "og:image").alias("image"), F.get_json_object(structured.embedded_json(h, "__NEXT_DATA__"), "$.props.n").alias("n"), structured.bracketed_array(h, F.lit("var a")).alias("list"), shown.alias("shown"), F.coalesce(structured.signup_state(shown, "encerradas", "abertas").cast("string"), F.lit("unknown")).alias("open"))


def page_truth(spark: SparkSession, sf: str) -> DataFrame:
    """Stored records against the facts of their pages."""
    pages = _pages(spark, sf)
    stored = pages.select("id", F.when(F.col("ordinal") % 4 == 0, "ZZ").otherwise(F.col("subdivision")).alias("subdivision"), F.when(F.col("ordinal") % 6 == 1, F.date_add("event_date", 1)).otherwise(F.col("event_date")).alias("event_date"))
    facts = truth.page_facts(pages.select("id", "html"), ["SP", "RJ", "MG", "RS"])
    return truth.check_truth(stored, facts).select("id", "verdict", F.array_join("regions", ",").alias("regions"))


def sitemap_entries(spark: SparkSession, sf: str) -> DataFrame:
    """Addresses in sitemaps, and the recent ones, newest first."""
    entry = lambda n: _joined("<url><loc> https://x/", F.col("k"), "/", F.lit(n), " </loc><lastmod>", F.date_format(F.date_add("d", n), "yyyy-MM-dd"), "T00:00</lastmod></url>")
    xml = F.concat(F.lit("<urlset>"), entry(0), entry(2), entry(1), F.lit("</urlset>"))
    return _orders(spark, sf).select("k", F.array_join(structured.sitemap_locations(xml), " ").alias("all"), F.array_join(structured.recent_locations(xml, F.date_add("d", 1)), " ").alias("recent"))


def decoded_bytes(spark: SparkSession, sf: str) -> DataFrame:
    """texts stored in two encodings read back."""
    t = _joined("São ", F.col("k"), " é")
    raw = F.when(F.col("k") % 2 == 0, F.encode(t, "UTF-8")).otherwise(F.encode(t, "ISO-8859-1"))
    return _orders(spark, sf).select("k", structured.decoded(raw).alias("t"))


def json_shapes(spark: SparkSession, sf: str) -> DataFrame:
    """Shapes of landed JSON, counted."""
    props = F.when(F.col("event_id") % 3 == 0, _joined('{"a": [', F.col("props"), '], "b": {"c": {"d": {"e": {}}}}}')).otherwise(F.col("props"))
    return table(spark, sf, "events").select(structured.json_shape(props).alias("shape")).groupBy("shape").agg(F.count(F.lit(1)).alias("n"))


def first_tables(spark: SparkSession, sf: str) -> DataFrame:
    """Rows of the first table that has a key, with details filled in."""
    e = table(spark, sf, "events").select("event_id", "user_id", "event_type", F.lit(None).cast("string").alias("note"))
    rows = readers.first_source_with_rows([e.filter("event_type = 'error'"), e.filter("event_type = 'purchase'"), e], "user_id")
    detail = e.select("event_id", F.concat(F.lit("n"), F.col("event_id") % 7).alias("note"))
    return readers.joined_details(rows, detail, "event_id", ["note"]).select("event_id", "note")


def source_union(spark: SparkSession, sf: str) -> DataFrame:
    """Rows of three registered sources, numbered by source and place; one of them cannot be opened."""
    r = Registry()
    parquet = lambda s, path: s.read.parquet(path)
    r.register_source("suppliers", f"{sf}/supplier.parquet", parquet, lambda d: d.select(F.col("s_suppkey").cast("string").alias("id"), F.col("s_suppkey").alias("source_seq")))
    r.register_source("lost", f"{sf}/no_such_table.parquet", parquet, lambda d: d)
    r.register_source("customers", f"{sf}/customer.parquet", parquet, lambda d: d.select(F.col("c_custkey").cast("string").alias("id"), F.col("c_custkey").alias("source_seq")))
    rows, failed = r.read(spark)
    return rows.select("id", "source", "ordinal", F.lit(",".join(failed)).alias("failed"))


def snapshot_again(spark: SparkSession, sf: str) -> DataFrame:
    """Records written as JSON and read again, with defaults for what they lack."""
    e = made_events(spark, sf).drop("c", "ordinal").withColumns({"country": F.when(F.col("country") != "??", F.col("country")), "is_major": F.when(F.col("is_major"), True)})
    path = shared_path(spark, "snapshot")
    readers.write_snapshot(e, path)
    back = readers.with_defaults(readers.read_json_records(spark, path, RACE_EVENT).drop("_corrupt_record"))
    return back.select("id", "title", "country", "is_major", F.size("distances").cast("long").alias("n_distances"), F.size("listings").cast("long").alias("n_listings"), F.get("listings", 0)["kind"].alias("kind"), F.date_format("event_date", "yyyy-MM-dd").alias("date"))


def feed_events(spark: SparkSession, sf: str) -> DataFrame:
    """A landed feed told by a specification."""
    k = F.col("k")
    item = F.struct(k.alias("code"), _joined("corrida alfa ", k % 9, "k").alias("nome"), F.date_format("d", "dd/MM/yyyy").alias("dia"), _joined(k % 24, "h30").alias("hora"), F.lit("Praça").alias("lugar"))
    feed = _orders(spark, sf).groupBy((k % 100).alias("g")).agg(F.collect_list(item).alias("lista")).select(F.concat(F.lit("cb("), F.to_json(F.struct("lista")), F.lit(");")).alias("value"))
    spec = parsers.Spec("made", {"id": "$.code", "title": "$.nome", "date": "$.dia", "time": "$.hora", "place": "$.lugar", "page": "$.code", "distances": "$.nome"}, rows="$.lista", constants={"country": "BR"}, base_url="https://made.org/")
    e = parsers.parse_json_feed(feed, spec)
    return e.select("id", "title", F.date_format("event_date", "yyyy-MM-dd").alias("date"), "start_time", "country", F.get("listings", 0)["page_url"].alias("page"), F.array_join(F.transform("distances", lambda x: x["km"].cast("string")), ",").alias("kms"))


FOLD = "replace(replace(replace(replace(strip_accents(lower({0})), 'ß', 'ss'), 'æ', 'ae'), 'œ', 'oe'), 'ø', 'o')"
O = "o AS (SELECT o_orderkey AS k, CAST(o_orderdate AS DATE) AS d FROM orders)"  # noqa: E741
PT = "['janeiro', 'fevereiro', 'março', 'abril', 'maio', 'junho', 'julho', 'agosto', 'setembro', 'outubro', 'novembro', 'dezembro'][month(d)]"
DE = "['Januar', 'Februar', 'März', 'April', 'Mai', 'Juni', 'Juli', 'August', 'September', 'Oktober', 'November', 'Dezember'][month(d)]"
HM = "lpad(CAST(k % 24 AS VARCHAR), 2, '0') || ':' || lpad(CAST(k % 60 AS VARCHAR), 2, '0')"
KEY = r"""list_filter(string_split(regexp_replace(lower({0}), '[^a-z0-9 ]', ' ', 'g'), ' '), lambda w: w <> '' AND NOT regexp_matches(w, '^20[0-9]{{2}}$') AND w NOT IN ('corrida', 'run', 'da'))"""
CAP = "array_to_string(list_transform(string_split(lower(title), ' '), lambda w: upper(w[1]) || w[2:]), ' ')"
SQL = {
    "text_forms": rf"""SELECT doc_id, md5({FOLD.format("text")}) AS folded, md5(trim(regexp_replace({FOLD.format("text")}, '[^a-z0-9]+', '-', 'g'), '-')) AS slug,
        md5(trim(regexp_replace(regexp_replace(text || ' x', '[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]', '', 'g'), '[ \t\n\x0B\f\r]+', ' ', 'g'))) AS clean,
        coalesce(doc_id % 3 = 0 OR regexp_matches(text, '&(amp|lt|gt|quot|nbsp|#[0-9]+);') OR regexp_matches(text, 'Ã[\x{{80}}-¿]'), false) AS dirty FROM documents""",
    "title_keys": f"WITH {EV} SELECT id, array_to_string({KEY.format('title')}, ' ') AS key, len({KEY.format('title')}) >= 2 AS inside FROM ev",
    "display_titles": f"""WITH {EV} SELECT id, ['IV', 'XXVII', '3ª', 'Sp'][k % 4 + 1] || ' Corrida & Festa ' || ['SP', 'Df', '10K'][k % 3 + 1] || ' ' || {CAP} AS title, title AS activity FROM ev""",
    "city_forms": f"""WITH {EV} SELECT id, CASE WHEN k % 4 < 3 THEN p ELSE '' END AS city, CASE WHEN k % 4 < 3 THEN subdivision ELSE '' END AS sub, CASE k % 4 WHEN 0 THEN p || '-' || subdivision WHEN 1 THEN p || ' - ' || subdivision WHEN 2 THEN subdivision ELSE 'A definir' END AS last,
        ['Santo Andre', 'Sao Jose dos Campos', 'Rio de Janeiro'][k % 3 + 1] AS shown, k % 5 > 1 AS plausible, p || '/' || subdivision || '/BR' AS split,
        CASE WHEN country = 'BR' AND city <> '' THEN city || ', ' || subdivision ELSE CASE k % 4 WHEN 0 THEN p || '-' || subdivision WHEN 1 THEN 'Praça, ' || p || ' - ' || subdivision WHEN 2 THEN p || ', ' || subdivision ELSE 'A definir' END END AS location
        FROM (SELECT *, ['santo andre', 'sao jose dos campos', 'rio'][k % 3 + 1] AS p FROM ev)""",
    "link_forms": f"""WITH {O} SELECT k, CASE WHEN k % 5 = 0 AND k >= 10 THEN 'ticket:' || k ELSE 'https://user@www.s' || k % 7 || '.com.br/event/' || k END AS key, 's' || k % 7 || '.com.br' AS host, 's' || k % 7 || '.com.br' AS domain,
        'São ' || k % 3 AS uf, '{{"k": ' || k || '}}' AS body FROM o""",
    "parsed_dates": f"""WITH {O} SELECT k, CASE WHEN k % 5 < 4 THEN strftime(d, '%Y-%m-%d') END AS date, strftime(d, '%Y-%m-%d') || ',' || strftime(d + 9, '%Y-%m-%d') AS found, strftime(d + 9, '%Y-%m-%d') AS next, strftime(d, '%Y-%m-%d') AS earliest,
        '20' || strftime(d, '%y') AS year, '6h' || k % 10 AS first FROM o""",
    "parsed_times": f"""WITH {O} SELECT k, t AS time, {HM} AS twelve, CASE WHEN k % 24 BETWEEN 5 AND 22 THEN t END AS plausible, CASE WHEN k % 24 >= 4 THEN {HM} END AS start, 'às   10 km, água' AS rest
        FROM (SELECT *, CASE WHEN k % 3 < 2 THEN {HM} ELSE lpad(CAST(k % 24 AS VARCHAR), 2, '0') || ':00' END AS t FROM o)""",
    "date_rules": f"""WITH {O} SELECT k, CASE WHEN NOT (month(d) = 2 AND day(d) = 29) THEN CAST(CASE WHEN strftime(d, '%m-%d') >= '06-01' THEN 1996 ELSE 1997 END AS VARCHAR) || strftime(d, '-%m-%d') END AS inferred,
        k % 4 = 0 OR abs(d - DATE '{AS_OF}') <= 14 AS near, day(d) || ' de ' || {PT} || ' de ' || year(d) AS pt, monthname(d) || ' ' || day(d) || ', ' || year(d) AS en, year(d) || '年' || month(d) || '月' || day(d) || '日' AS ja, day(d) || '. ' || {DE} || ' ' || year(d) AS de FROM o""",
    "distance_forms": f"""WITH {O} SELECT k, CAST([10.0, 21.097, 7.5, NULL][k % 4 + 1] AS DOUBLE) AS named, CASE k % 4 WHEN 0 THEN CAST(CAST(k % 30 AS DOUBLE) AS VARCHAR) WHEN 1 THEN k % 30 || ' mi' WHEN 2 THEN CAST(round_even((k % 30) / 1000.0::DOUBLE, 3) AS VARCHAR) ELSE k % 30 || 'h' END AS units,
        CAST(CAST(k % 9 AS DOUBLE) AS VARCHAR) || ',21.097' AS thinned, CAST(CAST(k % 9 AS DOUBLE) AS VARCHAR) || ',21.097' AS whole, ['21.097', '10,21.097', '42.195,5 mi', '50,24h', '10,12.5 mi'][k % 5 + 1] AS spelled,
        (k % 7 + 1) || 'km 10km 21km e ' || k % 5 || 'km 8km' AS expanded, ['5K', '10K', '21K', '42K'][k % 4 + 1] AS label, (k % 9 + 1) * 1000 + 234.5::DOUBLE + (k % 10) / 100.0::DOUBLE AS money, CASE WHEN k % 100 BETWEEN 80 AND 95 THEN CAST(k % 100 AS DOUBLE) ELSE 87.7::DOUBLE END AS plausible FROM o""",
    "prose_distances": f"""WITH {O} SELECT k, CAST(CAST(k % 5 + 3 AS DOUBLE) AS VARCHAR) || ',12.0,' || CAST(CAST(k % 9 + 30 AS DOUBLE) AS VARCHAR) AS kms, CASE WHEN k % 24 BETWEEN 4 AND 22 THEN CAST(CAST(k % 5 + 3 AS DOUBLE) AS VARCHAR) || '@' || {HM} || ',21.097@' || {HM} ELSE '' END AS times FROM o""",
    "record_fullness": f"""WITH {EV} SELECT id, CAST(2 + CASE WHEN event_date IS NULL THEN 0 ELSE 2 END + CASE WHEN start_time IS NULL THEN 0 ELSE 1 END + CASE WHEN location_text = '' THEN 0 ELSE 1 END + CASE WHEN image_url IS NULL THEN 0 ELSE 2 END + CASE WHEN has_km THEN 1 ELSE 0 END
        + CASE WHEN has_mi THEN 1 ELSE 0 END + CASE WHEN signup_open IS NULL THEN 0 ELSE 1 END + CASE WHEN k % 4 = 0 THEN 2 ELSE 0 END + CASE WHEN signup_url IS NULL THEN 0 ELSE 2 END AS BIGINT) AS score FROM ev""",
    "page_events": f"WITH {EV} SELECT id, title AS name, strftime(event_date, '%Y-%m-%d') AS start, subdivision AS region FROM ev WHERE event_date IS NOT NULL UNION ALL SELECT id, id, 'none', 'none' FROM ev WHERE event_date IS NOT NULL",
    "page_parts": f"""WITH {EV} SELECT id, 'https://i/' || id || '.jpg' AS image, CAST(k AS VARCHAR) AS n, '[{{"id": ' || k || '}}]' AS list, title || ' Inscrições ' || ['abertas', 'encerradas', 'em breve'][k % 3 + 1] AS shown, ['true', 'false', 'unknown'][k % 3 + 1] AS open FROM ev WHERE event_date IS NOT NULL""",
    "page_truth": f"""WITH {EV} SELECT id, CASE WHEN subdivision <> 'XX' AND k % 4 = 0 THEN 'error' WHEN k % 6 = 1 THEN 'warning' ELSE 'ok' END AS verdict, CASE WHEN subdivision = 'XX' THEN '' ELSE subdivision END AS regions FROM ev WHERE event_date IS NOT NULL""",
    "sitemap_entries": f"WITH {O} SELECT k, 'https://x/' || k || '/0 https://x/' || k || '/2 https://x/' || k || '/1' AS \"all\", 'https://x/' || k || '/2 https://x/' || k || '/1' AS recent FROM o",
    "decoded_bytes": f"WITH {O} SELECT k, 'São ' || k || ' é' AS t FROM o",
    "json_shapes": """SELECT CASE WHEN event_id % 3 = 0 THEN '{"a": [{"k": "int"}], "b": {"c": {"d": {"e": "dict"}}}}' ELSE '{"k": "int"}' END AS shape, count(*) AS n FROM events GROUP BY 1""",
    "first_tables": """WITH r AS (SELECT event_id, user_id, CASE event_type WHEN 'error' THEN 0 WHEN 'purchase' THEN 1 ELSE 2 END AS t FROM events UNION ALL SELECT event_id, user_id, 2 FROM events WHERE event_type IN ('error', 'purchase'))
        SELECT event_id, 'n' || event_id % 7 AS note FROM (SELECT *, min(t) OVER (PARTITION BY user_id) AS least FROM r) WHERE t = least""",
    "source_union": "SELECT CAST(s_suppkey AS VARCHAR) AS id, 'suppliers' AS source, row_number() OVER (ORDER BY s_suppkey) AS ordinal, 'lost' AS failed FROM supplier UNION ALL SELECT CAST(c_custkey AS VARCHAR), 'customers', (SELECT count(*) FROM supplier) + row_number() OVER (ORDER BY c_custkey), 'lost' FROM customer",
    "snapshot_again": f"""WITH {EV} SELECT id, title, CASE WHEN country = '??' THEN 'BR' ELSE country END AS country, is_major, CAST(CASE WHEN has_mi THEN 2 WHEN has_km THEN 1 ELSE 0 END AS BIGINT) AS n_distances, CAST(CASE WHEN two THEN 2 ELSE 1 END AS BIGINT) AS n_listings, kind, strftime(event_date, '%Y-%m-%d') AS date FROM ev""",
    "feed_events": f"""WITH {O} SELECT 'made_' || k AS id, 'Corrida Alfa ' || k % 9 || 'K' AS title, strftime(d, '%Y-%m-%d') AS date, lpad(CAST(k % 24 AS VARCHAR), 2, '0') || ':30' AS start_time, 'BR' AS country, 'https://made.org/' || k AS page, CASE WHEN k % 9 >= 3 THEN CAST(CAST(k % 9 AS DOUBLE) AS VARCHAR) ELSE '' END AS kms FROM o""",
}
QUERIES = {name: globals()[name] for name in SQL}
