"""Gazetteers, nearest names, ranges: against plain versions, and by plan."""

import difflib
import random

from pyspark.sql import functions as F

from cadenza.operators import enrich, gazetteer


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_places_of_a_large_table(spark):
    """Ten thousand names: the plan is as long as with ten, and each tier is found."""
    names = [("São Paulo", "SP", "state"), ("Nuevo León", "NL", "state"), ("Monterrey", "MO", "city"), ("San Luis", "SL", "city"), ("San Luis Río Colorado", "SR", "city"), ("Leon", "LE", "city")]
    rng = random.Random(1)
    many = names + [(f"{rng.choice('bcdfg')}{i} vila", f"c{i}", rng.choice(["city", "state"])) for i in range(10_000)]
    rows = [(1, "Parque, Monterrey, Nuevo León", None), (2, "Monterrey, San Luis", ""), (3, "cerca de San Luis Río Colorado hoy", None), (4, "x", "sao paulo"), (5, "Monterrey", "nowhere"), (6, None, None), (7, "leones", None), (8, "", "Monterrey"), (9, "b" + str(0), None), (10, "ola! San-Luis", None)]
    df = spark.createDataFrame(rows, "id int, t string, f string")
    got, lengths = [], []
    for table in (names, many):
        out = gazetteer.named_places(df, "id", F.col("t"), F.col("f"), spark.createDataFrame(table, "name string, code string, kind string"))
        got.append(dict(map(tuple, out.collect())))
        lengths.append(len(plan(out)))
    assert got[0] == {1: "NL", 2: "MO", 3: "SR", 4: "SP", 8: "MO"} and {k: v for k, v in got[1].items() if k != 9} == got[0]
    assert max(lengths) < 1.1 * min(lengths)
    words = spark.createDataFrame([("sao", "one", 2), ("paulo", "two", 1), ("aulo", "three", 0), ("aulo", "four", 3), ("", "none", -1)], "word string, value string, rank int")
    texts = spark.createDataFrame([(1, "São João"), (2, "x Paulo y"), (3, "nada"), (4, None)], "id int, t string")
    assert dict(map(tuple, gazetteer.first_keywords(texts, F.col("t"), words).select("id", "value").collect())) == {1: "one", 2: "three", 3: None, 4: None}
    assert gazetteer.first_keywords(texts, F.col("t"), words.limit(0)).filter("value IS NULL").count() == 4


def test_nearest_names_equal_all_pairs(spark):
    """The most similar name as difflib finds it among all of a country, without a join by country alone."""
    rng = random.Random(3)
    base = ["".join(rng.choice("abcdeilmnorst ") for _ in range(rng.randint(1, 14))).strip() or "x" for _ in range(150)]
    names = [(rng.choice(["BR", "US"]), f"C{i}", n) for i, n in enumerate(sorted(set(base)))]

    def near(t):
        t = list(t)
        for _ in range(rng.choice([0, 1, 1, 2, 3])):
            i = rng.randrange(len(t) + 1)
            t[i : i + rng.choice([0, 1])] = rng.choice(["", "a", "e", "z"])
        return "".join(t)

    asked = sorted({(rng.choice(["BR", "US"]), near(n)) for _, _, n in names * 3})
    events = spark.createDataFrame(asked, "country string, subdivision string")
    out = enrich.resolve_subdivision(events, spark.createDataFrame(names, "country string, code string, name string"))
    got = {(r.country, r.subdivision): r.code for r in out.collect()}
    for c, s in asked:
        own = {n: code for country, code, n in names if country == c}
        if s in own:
            want = own[s]
        else:
            scored = [(difflib.SequenceMatcher(None, n, s).ratio(), n) for n in own] if s else []
            best = max(scored, default=(0, ""))
            want = own[best[1]] if best[0] >= 0.8 else None
        assert got[c, s] == want, (c, s)
    assert "CartesianProduct" not in plan(out) and "BroadcastNestedLoop" not in plan(out)


def test_ranges_without_a_single_task(spark):
    """First range by start that holds the value; the running maximum is no window over all rows."""
    rng = random.Random(4)
    ranges = [(a, a + rng.choice([-1, 0, 3, 40, 400]), f"r{i}") for i, a in enumerate(sorted(rng.sample(range(5000), 400)))]
    r = spark.createDataFrame(ranges, "first int, last int, label string").repartition(5)
    top = enrich.running_maximum(r, ["first", "last"], "last", "above")
    so_far, want = None, {}
    for a, b, label in sorted(ranges):
        want[label] = so_far
        so_far = b if so_far is None else max(so_far, b)
    assert {x.label: x.above for x in top.collect()} == want
    assert "SinglePartition" not in plan(top) and "hashpartitioning" in plan(top)
    values = spark.range(5600).select(F.col("id").cast("int").alias("v"))
    got = {x.v: x.label for x in enrich.lookup_range(values, F.col("v"), r).collect()}
    assert got == {v: next((label for a, b, label in ranges if a <= v <= b), None) for v in range(5600)}
    assert enrich.lookup_range(values, F.col("v"), r.limit(0)).filter("label IS NULL").count() == 5600


def test_keywords_of_any_number(spark):
    """More keywords than the automaton takes are joined with the texts' parts, to the same values; so are rows with the same text or id."""
    rng = random.Random(8)
    word = lambda n: "".join(rng.choice("abc ") for _ in range(rng.randint(1, n)))
    words = spark.createDataFrame([(word(6), f"v{i}", rng.randrange(40)) for i in range(120)] + [("é", "none", 1), ("x", None, 0), ("", "no", -1)], "word string, value string, rank int").dropDuplicates(["word", "rank"])
    words = words.localCheckpoint()
    texts = spark.createDataFrame([(i % 250, t) for i, t in enumerate([*(word(14) for _ in range(300)), "xx", "É", "a", "", None, "ddd"] * 2)], "id int, t string")
    one, two = (sorted(map(str, gazetteer.first_keywords(texts, F.col("t"), words, most).collect())) for most in (10**6, 3))
    assert one == two and len(one) == 612
    names = spark.createDataFrame([("a b", "AB", "city"), ("ab", "X", "state")], "name string, code string, kind string")
    codes = gazetteer.named_places(texts, "id", F.col("t"), F.lit(None).cast("string"), names)
    assert codes.count() == codes.select("id").distinct().count() > 5
