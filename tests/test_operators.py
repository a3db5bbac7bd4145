import datetime as dt

from pyspark.sql import functions as F

from cadenza.operators import enrich, health, publish, quality, reconcile, resolve, rules, search, truth
from cadenza.operators.components import connected_components


def pairs(frame):
    return sorted(tuple(r) for r in frame.collect())


def same(events, a, b):
    return pairs(resolve.duplicate_pairs(events(a, b))) == [(1, 2)]


def test_duplicate_cases(events):
    p = {"city": "Brasília", "sub": "DF", "day": "2026-07-25", "km": [5, 10]}
    assert same(events, p | {"title": "Corrida POUPEX 2026"}, p | {"title": "Corrida Poupex 2026"})
    t = {"city": "Treviso", "sub": "SC", "day": "2026-06-21", "title": "Meia Maratona de Treviso"}
    assert same(events, t | {"km": [21.097]}, t | {"km": [5, 10, 21.097]})
    v = {"city": "Veneza", "sub": "VE", "country": "IT", "day": "2026-10-25", "km": [42.195]}
    assert same(events, v | {"title": "Maratona de Veneza"}, v | {"title": "Maratona De Veneza 2026"})
    c = {"day": "2026-06-13", "km": [5]}
    assert not same(events, c | {"title": "Corrida da Copa", "city": "Santo Ângelo", "sub": "RS"}, c | {"title": "Copa Run", "city": "Brasília", "sub": "DF"})
    assert not same(events, c | {"title": "Corrida Copa", "city": "São Paulo", "sub": "SP"}, c | {"title": "Copa Corrida", "city": "Campinas", "sub": "SP"})
    assert not same(events, p | {"title": "Corrida POUPEX"}, p | {"title": "Corrida POUPEX", "day": "2026-07-26"})
    assert not same(events, p | {"title": "Corrida POUPEX", "km": [5]}, p | {"title": "Corrida POUPEX", "km": [10]})


def test_links_and_similarity_bounds(events):
    assert same(events, {"title": "Alpha One", "link": "http://x/1"}, {"title": "Zeta Two", "link": "http://x/1/", "country": "US", "day": "2026-01-01"})
    t = {"title": "Noite Azul Grande Prova", "day": "2026-08-01"}
    assert same(events, t | {"sub": "GO"}, t | {"sub": "DF"})
    assert not same(events, t | {"sub": "NY", "country": "US"}, t | {"sub": "NJ", "country": "US"})
    assert same(events, t, t | {"day": "2026-08-31"})
    assert not same(events, t, t | {"day": "2026-09-01"})


def test_generic_link(events):
    used = [("cal", "http://c", ["http://c/list"], "calendar")]
    e = events(*({"title": f"Prova {w}", "day": f"2026-0{i}-01", "listings": used} for i, w in enumerate(("Um Dia", "Dois Mares", "Tres Rios"), 1)))
    assert pairs(resolve.duplicate_pairs(e)) == []


def test_merge_keeps_order_and_fills(events):
    p = {"title": "Corrida POUPEX", "city": "Brasília", "sub": "DF", "day": "2026-07-25"}
    e = events(p | {"km": [5, 10], "source": "a"}, p | {"km": [10, 21.1], "source": "b", "image": "http://i", "cancelled": True})
    rows = resolve.merge_round(e).collect()
    assert len(rows) == 1
    assert [d.km for d in rows[0].distances] == [10.0, 21.1, 5.0] and rows[0].image_url == "http://i" and rows[0].is_cancelled
    assert {x.name for x in rows[0].listings} == {"a", "b"}


def counted(spark, events):
    """The events with titles that count how often they are made."""
    made = spark.sparkContext.accumulator(0)

    def same_title(title):
        made.add(1)
        return title

    return events.withColumn("title", F.udf(same_title, "string").asNondeterministic()("title")), made


def test_merge_round_makes_its_input_once(spark, events):
    """Records are read for links, for what is compared and whole; clusters of any size and records in none come out as before."""
    links = [f"http://l/{i % 3}" if i % 4 else f"http://own/{i}" for i in range(24)]
    given = events(*({"title": f"Prova {'abcdefghijklmnopqrstuvwx'[i] * 5}", "link": link, "km": [i % 5, 7, 7], "image": f"http://i/{i}" if i % 2 else None, "cancelled": i == 5} for i, link in enumerate(links)))
    e, made = counted(spark, given)
    rows = {r.ordinal: r for r in resolve.merge_round(e).collect()}
    assert made.value == 24
    assert len(rows) == 9 and sum(len(r.listings) for r in rows.values()) == 24
    alone = rows[1]
    assert [d.km for d in alone.distances] == [0.0, 7.0] and not alone.is_cancelled and [x.name for x in alone.listings] == ["s1"]
    assert rows == {r.ordinal: r for r in resolve.merge_round(given, few=2).collect()}


def test_components_make_edges_once(spark):
    made = spark.sparkContext.accumulator(0)

    def same_node(x):
        made.add(1)
        return x

    edges = spark.createDataFrame([(i, i + 1) for i in range(9)], "a long, b long").withColumn("b", F.udf(same_node, "long").asNondeterministic()("b"))
    assert {r.component for r in connected_components(edges).collect()} == {0} and made.value == 9


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (5, 5), (7, None)], "a long, b long")
    got = dict(tuple(r) for r in connected_components(edges).collect())
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100}
    assert connected_components(edges.limit(0)).count() == 0


def test_within_days_matches_brute_force(spark):
    rows = [(i, dt.date(2024, 1, 1) + dt.timedelta(days=(i * 37) % 200), str(i % 3)) for i in range(120)]
    got = pairs(resolve.within_days(spark.createDataFrame(rows, "ordinal long, day date, sub string"), 31, "sub"))
    want = sorted((a[0], b[0]) for a in rows for b in rows if a[2] == b[2] and (b[1], b[0]) > (a[1], a[0]) and (b[1] - a[1]).days <= 31)
    assert got == want


def test_validity(events):
    e = events({"day": "2026-01-01"}, {"day": None}, {"title": "Home", "day": "2026-01-01"}, {"title": "Triathlon X", "day": "2026-01-01"}, {"title": "Corrida Kids Run", "km": ["0.5 mi"], "day": "2026-01-01"}, {"title": "Kids Run e 5K", "km": [5], "day": "2026-01-01"}, {"day": "2026-01-01", "place": None})
    assert [r.id for r in rules.valid_events(e).collect()] == ["e1", "e6"]
    assert {(r.id, r.rule) for r in rules.rejected_events(e).collect()} >= {("e2", "no_date"), ("e3", "navigation_title"), ("e4", "other_sport"), ("e5", "kids_only"), ("e7", "no_location")}


def test_reconcile(spark, events):
    stored = events({"title": "Prova Alfa Norte", "day": "2026-05-01"}, {"title": "Prova Beta Sul", "day": "2026-05-02", "misses": 9}, {"title": "Prova Gama Leste", "day": "2025-01-01"}, {"title": "Prova Delta Oeste", "day": "2026-05-04", "misses": 3}, {"title": "Prova Eta Centro", "day": "2026-05-05", "misses": 2})
    new = events({"id": "n1", "title": "Prova Alfa Norte", "day": "2026-05-01", "km": [10], "link": "http://other"}, {"id": "n2", "title": "Nova Corrida Litoral", "day": "2026-06-01", "link": "http://new"})
    status = spark.createDataFrame([("http://l/2", 404), ("http://l/4", 403)], "url string, status int")
    got = {r.id: (r.outcome, r.miss_count) for r in reconcile.reconcile(stored, new, status, F.lit("2026-01-01").cast("date")).collect()}
    assert got == {"n1": ("updated", 0), "n2": ("inserted", 0), "e3": ("past", 0), "e4": ("alive", 0), "e5": ("deferred", 2)}


def test_reconcile_makes_each_side_once(spark, events):
    stored, looked = counted(spark, events({"title": "Prova Alfa Norte", "day": "2026-05-01"}, {"title": "Prova Beta Sul", "day": "2026-05-02"}, {"title": "Prova Gama Leste"}))
    new, came = counted(spark, events({"id": "e1", "title": "Prova Alfa Norte", "day": "2026-05-01"}, {"id": "n2", "title": "Prova Betta Sul", "day": "2026-05-03", "link": "http://other"}))
    status = spark.createDataFrame([], "url string, status int")
    out = reconcile.reconcile(stored, new, status, F.lit("2026-01-01").cast("date"))
    assert {r.id: r.outcome for r in out.collect()} == {"e1": "kept", "n2": "updated"}
    assert (looked.value, came.value) == (3, 2)


def test_quality_gates(events):
    shared = ("cal", "http://c", [], "calendar")
    e = events(*({"listings": [shared, (f"own{i}", "http://o", [], "signup")]} for i in range(3)), {"listings": [shared]})
    got = {r.id: [x.name for x in r.listings] for r in quality.strip_shared_listings(e).collect()}
    assert got == {"e1": ["own0"], "e2": ["own1"], "e3": ["own2"], "e4": ["cal"]}
    e = events({"link": "x", "km": [5]}, {"link": "x", "km": [5, 10]}, {"link": "x"}, {"link": "y"})
    link = F.get(F.col("listings"), 0)["page_url"]
    assert sorted(r.id for r in quality.drop_shared_links(e, link, F.col("ordinal")).collect()) == ["e2", "e4"]
    e = events({"id": "a", "km": [5]}, {"id": "a", "km": [5, 10]}, {"id": "b"})
    assert sorted((r.id, len(r.distances)) for r in quality.best_copy_of_id(e, F.col("ordinal")).collect()) == [("a", 2), ("b", 1)]


def test_labels_and_majors(spark, events):
    e = events({"title": "BMW Berlin Marathon", "city": "Berlin", "country": "DE", "km": [42.195], "day": "2026-09-27"}, {"title": "Chicago Legends 5K", "city": "Chicago", "country": "US", "km": [5], "day": "2026-09-27"}, {"title": "Boston Qualifier", "city": "Olympia", "country": "US", "km": [42.195], "day": "2026-05-17"}, {"title": "30ª Maratona Internacional de São Paulo", "city": "São Paulo", "country": "BR", "km": [42.195], "day": "2026-04-12"})
    majors = spark.createDataFrame([("Berlin", "DE"), ("Chicago", "US"), ("Boston", "US")], "name string, country string")
    assert [r.id for r in enrich.annotate_majors(e, majors).filter("is_major").collect()] == ["e1"]
    feed = spark.createDataFrame([("internacional sao paulo", "sao paulo", "BR", dt.date(2026, 4, 13), "gold"), ("internacional sao paulo", "", "BR", dt.date(2026, 4, 11), "elite"), ("internacional sao paulo", "", "BR", dt.date(2026, 4, 20), "platinum")], "name_norm string, city_norm string, country string, date date, tier string")
    assert {r.id: r.label_tier for r in enrich.annotate_labels(e, feed).collect()} == {"e1": None, "e2": None, "e3": None, "e4": "gold"}


def test_subdivision_names(spark):
    dim = spark.createDataFrame([("BR", "GO", "Goiás"), ("BR", "SP", "São Paulo"), ("US", "NY", "New York")], "country string, code string, name string")
    rows = spark.createDataFrame([("BR", "goias"), ("BR", "SP"), ("BR", "Sao Paolo"), ("BR", "Nowhere"), ("US", None)], "country string, subdivision string")
    got = {(r.country, r.subdivision): r.code for r in enrich.resolve_subdivision(rows, dim).collect()}
    assert got == {("BR", "goias"): "GO", ("BR", "SP"): "SP", ("BR", "Sao Paolo"): "SP", ("BR", "Nowhere"): None, ("US", None): None}


def test_health(spark):
    runs = [("a", 1, True, 5), ("a", 2, False, 0), ("a", 3, False, 0), ("a", 4, False, 0), ("b", 1, False, 0), ("c", 1, True, 2), ("c", 1, False, 0)]
    status = health.latest_status(spark.createDataFrame(runs, "source string, t int, ok boolean, n int"))
    assert {r.source: (r.consecutive_failures, r.last_success_count) for r in status.collect()} == {"a": (3, 5), "b": (1, None), "c": (1, None)}
    assert sorted(r.source for r in health.unhealthy(status).collect()) == ["a", "b", "c"]


def test_truth(spark, events):
    html = lambda *c: " ".join(f"Pirenópolis - {x}" for x in c)
    pages = spark.createDataFrame([("e1", html("GO", "GO", "GO")), ("e2", html("DF", "DF", "DF")), ("e3", html("SP", "SP", "SP", "RJ"))], "id string, html string")
    e = events({"sub": "DF"}, {"sub": "DF"}, {"sub": "MG"})
    got = {r.id: r.verdict for r in truth.check_truth(e, truth.page_facts(pages, ["GO", "DF", "SP", "RJ", "MG"])).collect()}
    assert got == {"e1": "error", "e2": "ok", "e3": "ok"}


def test_publish(spark, events):
    e = events({"day": "2026-05-01", "km": ["24h", 10, 5]}, {"day": "2026-01-01"}, {"day": None})
    active, old = publish.split_active(e, F.lit("2026-04-01").cast("date"))
    assert (active.count(), old.count()) == (2, 1)
    line = publish.slim(e).filter("id = 'e1'").first().json
    assert '"distances":[{"km":5.0},{"km":10.0},{"label":"24h"}]' in line and "signup_urls" not in line and "image_url" not in line
    assert publish.replaced_block("a<b>x</b>c", "<b>", "</b>", "y") == "a<b>\ny\n</b>c"
    archive = publish.upsert_archive(e.filter("id = 'e2'"), e.filter("id = 'e2'").withColumn("title", F.lit("new")))
    assert [(r.title, r.event_month) for r in archive.collect()] == [("new", "2026-01")]
    assert '"@type":"SportsEvent"' in publish.json_ld(e).first().json_ld


def test_filters(spark, events):
    e = events({"km": [21.0], "day": None}, {"km": ["24h"], "day": "2026-01-01"})
    pick = lambda *p: [r.id for r in e.filter(search.has_distance(F.col("distances"), list(p))).collect()]
    assert pick("21") == ["e1"] and pick("outros") == ["e2"] and pick() == ["e1", "e2"]
    assert [r.id for r in e.filter(search.in_period(F.col("event_date"), "30", F.lit("2026-03-01").cast("date"))).collect()] == ["e1"]


def test_streaming_reconcile(spark, tmp_path):
    from cadenza.operators.reconcile import selective_patch
    from cadenza.streaming.incremental import reconcile_stream, stream_json

    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.json").write_text('{"id":"x","v":1}\n{"id":"y","v":1}\n')
    step = lambda stored, batch: batch if stored is None else selective_patch(stored, batch)
    for _ in range(2):
        q = reconcile_stream(stream_json(spark, str(tmp_path / "in"), "id string, v long"), str(tmp_path / "out"), step, str(tmp_path / "cp"))
        q.awaitTermination(60)
        (tmp_path / "in/b.json").write_text('{"id":"y","v":2}\n')
    assert pairs(spark.read.parquet(str(tmp_path / "out/v=1"))) == [("x", 1), ("y", 2)]


def test_snapshot_and_registry(spark, tmp_path):
    from cadenza.sources.readers import read_json_records, read_snapshot
    from cadenza.sources.registry import Registry

    (tmp_path / "s.json").write_text('{"events":[{"id":"a","title":"T","listings":[]},{"id":"a","title":"U","listings":[{"name":"n","kind":"odd"}]}]}')
    rows = read_snapshot(spark, str(tmp_path / "s.json")).collect()
    assert [(r.title, r.country, r.listings[0].kind) for r in rows] == [("U", "BR", "calendar")]
    (tmp_path / "p.json").write_text('{"n":1}\nnot json\n')
    registry = Registry()
    registry.register_source("one", str(tmp_path / "p.json"), lambda s, p: read_json_records(s, p, "n long"), lambda df: df.select("n", F.lit(0).alias("source_seq")))
    registry.register_source("gone", str(tmp_path / "none"), lambda s, p: s.read.parquet(p), lambda df: df)
    union, failed = registry.read(spark)
    assert union.count() == 2 and list(failed) == ["gone"]
