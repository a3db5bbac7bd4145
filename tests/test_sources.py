import datetime as dt

from pyspark.sql import functions as F

from cadenza.operators import listings
from cadenza.sources.parsers import Spec, parse_html_cards, parse_json_feed, parse_json_ld, parse_sitemap


def test_json_feed(spark):
    feed = """cb({"data":[{"id":7,"name":"corrida 5k e 10k","when":"10/08/2026","city":"Goiânia","uf":"GO","url":"/e/7","st":"Cancelada"},{"id":8}]});"""
    spec = Spec("src", {"id": "$.id", "title": "$.name", "date": "$.when", "city": "$.city", "subdivision": "$.uf", "page": "$.url", "status": "$.st"}, rows="$.data", constants={"country": "BR"}, base_url="https://s.example")
    rows = parse_json_feed(spark.createDataFrame([(feed,), ("broken",)], "value string"), spec).orderBy("source_seq").collect()
    r, none = (next(x for x in rows if x.id == i) for i in ("src_7", "src_8"))
    assert r.source_seq.payload == none.source_seq.payload and (r.source_seq.place, none.source_seq.place) == (0, 1)
    assert (r.id, r.title, r.event_date, r.location_text, r.country, r.is_cancelled) == ("src_7", "Corrida 5K E 10K", dt.date(2026, 8, 10), "Goiânia, GO", "BR", True)
    assert [d.km for d in r.distances] == [5.0, 10.0] and r.listings[0].page_url == "https://s.example/e/7"
    assert none.event_date is None


def test_html_cards_and_json_ld(spark):
    page = '<div class="card"><h2>IX Corrida da Paz</h2><b>3, 5 e 10 km</b><i>1 de maio de 2026</i></div><div class="card"><h2>Outra</h2></div>'
    spec = Spec("cards", {"title": "<h2>(.*?)</h2>", "distances": "<b>(.*?)</b>", "date": "<i>(.*?)</i>"}, rows='<div class="card">')
    rows = parse_html_cards(spark.createDataFrame([(page,)], "html string"), spec).orderBy("source_seq").collect()
    assert [(r.title, r.event_date, [d.km for d in r.distances]) for r in rows] == [("IX Corrida Da Paz", dt.date(2026, 5, 1), [3.0, 5.0, 10.0]), ("Outra", None, [])]
    ld = '<script type="application/ld+json">[{"@type":"Event","name":"N 10k","startDate":"2026-05-01T07:00","url":"http://u","location":{"address":{"addressLocality":"C","addressRegion":"GO"}}}]</script>'
    (r,) = parse_json_ld(spark.createDataFrame([(ld,)], "html string"), Spec("ld", {})).collect()
    assert (r.title, r.event_date, r.city, r.subdivision) == ("N 10K", dt.date(2026, 5, 1), "C", "GO")


def test_sitemap(spark):
    xml = "<loc>http://a/race/1</loc><loc> http://a/race/1 </loc><loc>http://a/blog</loc>"
    assert [r.url for r in parse_sitemap(spark.createDataFrame([(xml,)], "value string"), "/race/").collect()] == ["http://a/race/1"]


def test_listing_folds(spark):
    docs = spark.createDataFrame([(1, 0, "first", 10.0, "08:00"), (1, 1, "second", 5.0, "07:00"), (2, 0, "x", 5.0, None)], "k int, o int, title string, km double, t string")
    got = {r.k: (r.title, r.kms, r.start_time) for r in listings.grouped_documents(docs, "k", "o", "km", "t").collect()}
    assert got == {1: ("first", [5.0, 10.0], "07:00"), 2: ("x", [5.0], None)}
    rows = spark.createDataFrame([("US", "ON"), ("CA", "NY"), ("CA", "QC")], "c string, s string")
    assert [r[0] for r in rows.select(listings.repaired_country(F.col("c"), F.col("s"))).collect()] == ["CA", "US", "CA"]
    s = spark.createDataFrame([([(10.0, dt.date(2026, 5, 2), "06:00"), (10.0, dt.date(2026, 5, 1), "08:00"), (10.0, dt.date(2026, 5, 1), "07:00"), (5.0, dt.date(2026, 5, 3), "09:00")],)], "e array<struct<km:double,date:date,start_time:string>>")
    assert [(x.km, x.start_time) for x in s.select(listings.schedule(F.col("e"))).first()[0]] == [(5.0, "09:00"), (10.0, "07:00")]


def test_snapshot_loses_only_the_bad_record(spark, tmp_path):
    from cadenza.sources.readers import read_snapshot, snapshot_records

    (tmp_path / "a.json").write_text('{"events":[{"id":"a","title":"T","listings":[],"miss_count":1},\n{"id":"b","miss_count":"abc"},{"id":"c","event_date":"2026-05-01"},{"title":"none"},5,null,{"id":"d","event_date":"2026-13-77"}]}')
    (tmp_path / "b.json").write_text('{"events":[{"id":"z"}')
    (tmp_path / "c.json").write_text('{"other":1}')
    rows, bad = snapshot_records(spark, str(tmp_path))
    assert sorted(r.id for r in rows.collect()) == ["a", "c"]
    got = sorted((r.file.rsplit("/")[-1], -1 if r.place is None else r.place, r.reason) for r in bad.collect())
    assert got == [("a.json", 1, "json"), ("a.json", 3, "no_id"), ("a.json", 4, "json"), ("a.json", 5, "json"), ("a.json", 6, "json"), ("b.json", -1, "json")]
    assert {(r.id, r.country, r.miss_count, r.is_major) for r in read_snapshot(spark, str(tmp_path)).collect()} == {("a", "BR", 1, False), ("c", "BR", 0, False)}


def test_registry_keeps_sources_apart(spark, tmp_path):
    """A truncated file, and a parser that fails in a task, cost their own source alone."""
    from cadenza.sources.registry import Registry

    for name in ("good", "cut", "fails"):
        spark.range(5).withColumnRenamed("id", "n").coalesce(1).write.parquet(str(tmp_path / name))
    part = next((tmp_path / "cut").glob("part-*.parquet"))
    part.write_bytes(part.read_bytes()[:-40])
    registry = Registry()
    parse = lambda df: df.select("n", F.col("n").alias("source_seq"))
    read = lambda s, p: s.read.schema("n long").parquet(p)
    registry.register_source("cut", str(tmp_path / "cut"), read, parse)
    registry.register_source("good", str(tmp_path / "good"), read, parse)
    registry.register_source("fails", str(tmp_path / "fails"), read, lambda df: parse(df.withColumn("n", F.raise_error(F.lit("no such page")).cast("long"))))
    registry.register_source("gone", str(tmp_path / "none"), lambda s, p: s.read.parquet(p), parse)
    union, failed = registry.read(spark)
    assert sorted((r.source, r.n, r.ordinal) for r in union.collect()) == [("good", i, i + 1) for i in range(5)]
    assert sorted(failed) == ["cut", "fails", "gone"]
    assert registry.read(spark, ["cut"])[0] is None


def test_landed_folders(spark, tmp_path):
    """Errors are rows; filters on the day and the source reach the scan."""
    import gzip

    from cadenza.sources import landed

    for name in ("one", "two"):
        (tmp_path / name).mkdir()
    (tmp_path / "one/a.json").write_text('{"date":"2026-01-02","id":1}\n\nbroken\n{"id":2}\n[1]\n{"date":"soon"}\n{"date":"2026-03-01T10:00","id":"é"}')
    (tmp_path / "one/b.json.gz").write_bytes(gzip.compress(b'{"date":"2026-05-05"}\n' * 3000))
    (tmp_path / "two/cut.json.gz").write_bytes(gzip.compress(b'{"date":"2026-05-05"}\n' * 5000)[:60])
    (tmp_path / "two/_temporary").write_text("x")
    path = f"file://{tmp_path}"
    load = lambda: landed.read_landed(spark, path)
    assert load().filter("record IS NOT NULL").count() == 3003
    errors = {(r.source, r.file.rsplit("/")[-1]): r.n_errors for r in landed.read_errors(spark, path).collect()}
    assert errors == {("one", "a.json"): 3, ("two", "cut.json.gz"): 1}
    ahead = landed.upcoming(spark, path, "2026-02-01")
    assert ahead.filter("record IS NOT NULL").count() == 3002
    plan = ahead._jdf.queryExecution().toString().split("Physical Plan")[-1]
    assert plan.count("BatchScan") == 2 and " Filter " not in plan  # the scan has taken them over
    assert load().filter("day >= DATE'2026-02-01'").filter("length(record) > 25").count() == 1
    assert {r.source for r in load().filter("source = 'two'").select("source").collect()} == {"two"}
