import datetime as dt

import pytest
from pyspark.sql import functions as F

from cadenza.functions import dates, distance, structured, text


def values(spark, schema, rows, *columns):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*columns).collect()]


def test_titles(spark):
    cases = {
        "iv corrida da paz": "IV Corrida Da Paz", "IX CONEZO - CONGRESSO": "IX Conezo - Congresso", "CORRIDA DO FOGO - ETAPA III": "Corrida Do Fogo - Etapa III",
        "XXVII SÃO SILVESTRE DE LONDRINA": "XXVII São Silvestre De Londrina", "VI. CORRIDA NOTURNA": "VI. Corrida Noturna", "CORRIDA MIX MATEUS": "Corrida Mix Mateus",
        "LIV RUN FESTIVAL": "Liv Run Festival", "corrida 5k e 10k": "Corrida 5K E 10K", "CORRIDA DF &amp;amp; GO": "Corrida DF & GO", None: "",
    }
    got = values(spark, "t string", [(t,) for t in cases], text.normal_title(F.col("t")))
    assert [g[0] for g in got] == list(cases.values())


def test_fold_and_keys(spark):
    rows = [("São Paulo Ação", "são"), ("STRAẞE Ørsted Łódź", "x")]
    got = values(spark, "t string, q string", rows, text.fold("t"), text.slug("t"), text.title_key("t"))
    assert got[0] == ("sao paulo acao", "sao-paulo-acao", "sao paulo acao")
    assert got[1][0] == "strasse orsted lodz"
    assert values(spark, "t string", [("Corrida POUPEX 2026",)], text.title_key("t")) == [("poupex",)]


def test_links(spark):
    pattern = {r"(?i)tickets\.example/e/[^/]*?-(\d+)/?$": "tickets.example/e/"}
    rows = [("https://Tickets.example/e/Some+Race-123/",), ("HTTP://A.b/C//",)]
    assert [g[0] for g in values(spark, "u string", rows, text.link_key(F.col("u"), pattern))] == ["tickets.example/e/123", "http://a.b/c"]
    hosts = values(spark, "u string", [("https://www.a.co.uk/x",), ("http://img.b.com",)], text.registered_domain(F.col("u")))
    assert [h[0] for h in hosts] == ["a.co.uk", "b.com"]


@pytest.mark.parametrize(
    ("line", "want"),
    [
        ("7 KM: R$ 129,90 | 15 KM: R$ 139,90 | 30 KM: R$ 159,90", [7, 15, 30]),
        ("Inscrição R$ 89,90. Percurso de 10 km", [10]),
        ("99,90 e 10 km", [10]),
        ("Percursos de 5km, 10km e meia maratona", [5, 10, 21.097]),
        ("3, 5 e 10 km", [3, 5, 10]),
        ("7,5 km e 15 km", [7.5, 15]),
        ("prova de 21,097 km", [21.097]),
        ("a maior maratona de rua", []),
        (None, []),
    ],
)
def test_distances_in_text(line, want):
    assert distance.distances_in(line) == want


def test_distance_units(spark):
    rows = [(5.0, "M"), (10.0, "K"), (24.0, "hour"), (5000.0, "meters")]
    got = values(spark, "v double, u string", rows, distance.from_units(F.col("v"), F.col("u")))
    assert [tuple(g[0]) for g in got] == [(None, "5 mi"), (10.0, None), (None, "24h"), (5.0, None)]
    assert values(spark, "a array<double>", [([5.0, 5.3, 10.0],)], distance.thin(F.col("a"))) == [([5.0, 10.0],)]
    keys = values(spark, "km double, label string", [(2.5, None), (3.5, None), (None, "24h")], distance.km_key(F.struct("km", "label")))
    assert [k[0] for k in keys] == ["2", "4", "24h"]


def test_dates(spark):
    cases = [("2025-08-10", dt.date(2025, 8, 10)), ("10/8/2025", dt.date(2025, 8, 10)), ("10 de agosto de 2025", dt.date(2025, 8, 10)), ("August 10, 2025", dt.date(2025, 8, 10)), ("2026-13-45", None), ("", None)]
    got = values(spark, "t string", [(c,) for c, _ in cases], dates.parse_date("t"))
    assert [g[0] for g in got] == [d for _, d in cases]
    times = [("7h30", "07:30"), ("07:30", "07:30"), ("7h", "07:00"), ("x", None)]
    assert [g[0] for g in values(spark, "t string", [(c,) for c, _ in times], dates.parse_time("t"))] == [t for _, t in times]
    assert [g[0] for g in values(spark, "t string", [("7:30 PM",), ("12 am",)], dates.parse_time_12h(F.col("t")))] == ["19:30", "00:00"]


def test_money_and_city(spark):
    assert values(spark, "t string", [("R$ 1.234,56",)], text.money(F.col("t"))) == [(1234.56,)]
    rows = [("Beira Rio, Pirenópolis-GO",), ("Praça Central, Formosa - GO",), ("A definir",), ("Esplanada dos Ministérios",)]
    got = [tuple(g[0]) for g in values(spark, "t string", rows, text.city_and_subdivision(F.col("t")))]
    assert got == [("Pirenópolis", "GO"), ("Formosa", "GO"), ("", ""), ("", "")]


def test_json_ld(spark):
    page = """<title> A &amp; B </title><script type="application/ld+json">{"@graph":[{"@type":["SportsEvent"],"name":"N","startDate":"2026-05-01",
      "location":{"name":"P","address":{"addressRegion":"GO"}}}]}</script><script type="application/ld+json">broken</script>"""
    frame = spark.createDataFrame([(page,), (None,)], "html string").select(structured.json_ld_events(structured.json_ld_blocks(F.col("html"))).alias("e"))
    first = frame.collect()[0].e
    assert [(e.name, e.start, e.region) for e in first] == [("N", "2026-05-01", "GO")]


def test_pages_go_to_python_in_small_batches(spark, tmp_path):
    """A batch holds few long pages, however many rows a partition has."""
    import pandas as pd
    from pyspark.sql import functions as F

    from cadenza.functions import text
    from cadenza.plans.events import table

    spark.range(300).select(F.col("id").alias("page_id"), F.repeat(F.lit("<p>some text</p>"), 6000).alias("html")).coalesce(1).write.parquet(str(tmp_path / "pages.parquet"))
    spark.conf.unset(text.BATCH_BYTES)

    @F.pandas_udf("long")
    def held(pages: pd.Series) -> pd.Series:
        return pd.Series([int(pages.str.len().sum())] * len(pages))

    p = table(spark, str(tmp_path), "pages")
    assert p.select(held("html").alias("n")).agg(F.max("n")).first()[0] < 10 << 20
