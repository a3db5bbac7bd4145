import datetime as dt

from pyspark.sql import functions as F

from cadenza.functions import structured
from cadenza.operators import display


def test_cards(spark, events):
    e = events({"km": [42.195, 5, "24h", 5.0], "day": "2026-05-01"})
    r = e.select(display.distance_labels(F.col("distances")).alias("l"), F.size(display.detail_rows(F.col("distances"))).alias("n"), display.relative_day(F.col("event_date"), F.lit("2026-04-30").cast("date")).alias("d")).first()
    assert (r.l, r.n, r.d) == (["5K", "42K", "24h"], 3, "tomorrow")
    past, ahead = display.split_recent_past(events({"day": "2026-04-29"}, {"day": None}, {"day": "2026-06-01"}), F.lit("2026-04-30").cast("date"))
    assert ([x.id for x in past.collect()], sorted(x.id for x in ahead.collect())) == (["e1"], ["e2", "e3"])


def test_payload_helpers(spark):
    one = lambda c, value: spark.createDataFrame([(value,)], "v string").select(c).first()[0]
    v = F.col("v")
    assert one(structured.query_parameter(v, "d"), "http://a/x?b=1&d=S%C3%A3o#t") == "São"
    xml = "<url><loc>a</loc><lastmod>2026-01-02</lastmod></url><url><loc>b</loc><lastmod>2025-01-02T00:00</lastmod></url><url><loc>c</loc><lastmod>2026-03-02</lastmod></url>"
    assert one(structured.recent_locations(v, F.lit(dt.date(2026, 1, 1))), xml) == ["c", "a"]
    assert one(structured.name_by_host(v, {"x.com": "X", "y.com": "Y"}, "Z"), "https://www.Y.com/") == "Y"
    state = structured.signup_state(v, "(?i)encerrad", "(?i)abert")
    assert [one(state, t) for t in ("Inscrições abertas, lote encerrado", "abertas", "-")] == [False, True, None]
    assert one(structured.bracketed_array(v, F.lit("data")), 'x data\\":[{\\"a\\":[1]}] y') == '[{"a": [1]}]'
    assert spark.createDataFrame([("São".encode("latin-1"),), ("São".encode(),)], "b binary").select(structured.decoded(F.col("b")).alias("t")).collect() == [("São",), ("São",)]
