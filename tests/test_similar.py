"""Candidates by letter pairs lose no pair that the decision confirms; hot groups are dealt out."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from cadenza.operators import reconcile, resolve, similar
from cadenza.operators.components import connected_components, written


def titles(rng, n, roots=60):
    """Titles near one another: words of a root with letters put in, left out, changed and swapped."""
    letters = "abcdefilmnorstuvz0123 "
    word = lambda: "".join(rng.choice(letters[:-1]) for _ in range(rng.randint(1, 9)))
    base = [" ".join(word() for _ in range(rng.randint(1, 4))) for _ in range(roots)]
    out = []
    for _ in range(n):
        t = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 5])):
            i = rng.randrange(len(t) + 1)
            kind = rng.random()
            if kind < 0.4:
                t.insert(i, rng.choice(letters))
            elif kind < 0.7 and t:
                del t[min(i, len(t) - 1)]
            elif t:
                t[min(i, len(t) - 1)] = rng.choice(letters)
        out.append("".join(t))
    return out


def near_events(events, rng, n, first=0, subs=10):
    """Records in few subdivisions and days, some without a date, many of them nearly alike."""
    rows = []
    for i, t in enumerate(titles(random.Random(1), 4000)[first : first + n]):
        day = rng.choice([None, "2024-03-01", "2024-03-01", "2024-03-08", "2024-03-20", "2024-04-02", "2024-06-01"])
        rows.append({"id": f"x{first + i}", "title": t, "day": day, "sub": f"S{rng.randrange(subs)}", "km": rng.choice([[10], [10, 5], [21], [5]]), "link": f"http://l/{first + i}", "country": rng.choice(["BR", "BR", "US"])})
    return events(*rows)


def all_pairs(a, b, on):
    one, two = a.select(*on, F.col("ordinal").alias("a"), F.col("day").alias("da"), F.col("sub").alias("sa")), b.select(*on, F.col("ordinal").alias("b"), F.col("day").alias("db"), F.col("sub").alias("sb"))
    return one.join(two, on)


def written_once(spark, df, tmp_path, name):
    df.write.parquet(str(tmp_path / name))
    return spark.read.parquet(str(tmp_path / name))


@pytest.fixture(scope="module")
def no_link(spark):
    return spark.createDataFrame([], "link string")


def test_matches_equal_all_pairs(spark, events, no_link, tmp_path):
    rng = random.Random(7)
    new = written_once(spark, near_events(events, rng, 1000), tmp_path, "new")
    stored = written_once(spark, near_events(events, rng, 1000, 1000), tmp_path, "stored").withColumn("ordinal", F.col("ordinal") + 5000)
    a, b = (written_once(spark, resolve.prepared(x, generic=no_link), tmp_path, n) for x, n in ((new, "pa"), (stored, "pb")))
    pairs = all_pairs(a, b, ["sub"]).select("a", "b").union(all_pairs(a, b, ["country"]).filter("country = 'BR' AND da = db AND sa <> sb").select("a", "b"))
    sure = resolve.confirmed(pairs, a, others=b)
    want = sorted(map(tuple, sure.groupBy("a").agg(F.min("b").alias("b")).collect()))
    got = sorted(map(tuple, reconcile.matches(new, stored, no_link).select("n", "s").collect()))
    assert len(want) > 200 and got == want
    twins = all_pairs(a, b, ["sub"]).filter("da <=> db").select("a", "b")
    want = sorted(map(tuple, resolve.confirmed(twins, a, others=b).groupBy("a").agg(F.min("b").alias("b")).collect()))
    got = sorted(map(tuple, reconcile.absorbed(new, stored, no_link).collect()))
    assert len(want) > 50 and got == want


def test_merge_equals_all_pairs(spark, events, no_link, tmp_path):
    e = written_once(spark, near_events(events, random.Random(9), 1500), tmp_path, "e")
    rows = written_once(spark, resolve.prepared(e, generic=no_link), tmp_path, "rows")
    pairs = resolve.within_days(rows, 31, "sub").union(all_pairs(rows, rows, ["country"]).filter("country = 'BR' AND da = db AND sa <> sb AND a < b").select("a", "b"))
    components = lambda p: sorted(map(tuple, connected_components(p).collect()))
    want = components(resolve.confirmed(pairs, rows))
    assert len(want) > 300 and components(resolve.duplicate_pairs(e, generic=no_link)) == want


def test_words_that_begin_differently(events, no_link):
    """Titles without a word that begins alike are matched and absorbed."""
    pairs = [("Luz Sol", "Luzz Soll"), ("Rio Mar Ceu", "Rios Mars Ceus"), ("Ana Neri Boa", "Anna Nerri Boaa"), ("Zuz Sol Mar", "Azuz Asol Mar")]
    new = events(*({"id": f"n{i}", "title": a, "sub": f"U{i}", "day": None} for i, (a, _) in enumerate(pairs)))
    stored = events(*({"id": f"s{i}", "title": b, "sub": f"U{i}", "day": "2030-01-01", "link": f"http://o/{i}"} for i, (_, b) in enumerate(pairs)))
    assert sorted(map(tuple, reconcile.matches(new, stored, no_link).select("n", "s").collect())) == [(1, 1), (2, 2), (3, 3), (4, 4)]
    dated = new.withColumn("event_date", F.lit(dt.date(2030, 1, 1)))
    assert sorted(map(tuple, reconcile.absorbed(dated, stored, no_link).collect())) == [(1, 1), (2, 2), (3, 3), (4, 4)]


def test_match_with_a_row_that_another_has_by_id(events, no_link):
    """An incoming row like a stored one is no new event, though another incoming row has the stored id."""
    stored = events({"id": "s1", "title": "Volta da Pampulha Noturna", "sub": "MG", "day": "2030-01-01"})
    new = events({"id": "s1", "title": "Volta da Pampulha Noturna", "sub": "MG", "day": "2030-01-01"}, {"id": "n2", "title": "Volta da Pampulha Noturno", "sub": "MG", "day": "2030-01-01", "link": "http://z/9"})
    assert sorted(map(tuple, reconcile.matches(new, stored, no_link).select("n", "s").collect())) == [(1, 1), (2, 1)]


def test_within_days_deals_out_hot_groups(spark):
    """Nine tenths of the rows in one subdivision: the same pairs, and no cell with more than its share."""
    rng = random.Random(2)
    rows = [(i, dt.date(2024, 1, 1) + dt.timedelta(rng.randrange(200)), "hot" if i % 10 else f"s{i % 70}") for i in range(3000)]
    df = spark.createDataFrame(rows, "ordinal long, day date, sub string")
    plain, dealt = (resolve.within_days(df, 31, "sub", block=n) for n in (10**9, 100))
    assert plain.count() > 500_000 and plain.exceptAll(dealt).isEmpty() and dealt.exceptAll(plain).isEmpty()
    dated = df.withColumn("span", resolve.spans(F.col("day"), 31))
    left, right, on = resolve.dealt(dated.withColumn("span", F.explode(F.array(F.col("span"), F.col("span") + 1))), dated, ["sub", "span"], 100)
    cells = [n for side in (left, right) for (n,) in side.filter("sub = 'hot'").groupBy(*on).count().select("count").collect()]
    assert max(cells) < 3 * sorted(cells)[len(cells) // 2]


def test_bounds_hold_for_any_titles(spark):
    """What meets and the bound on the ratio, against the ratio itself."""
    import difflib

    rng = random.Random(5)
    some = [t.strip() for t in titles(rng, 400, roots=12) if " " in t.strip()] + ["a b", "a c", "b a", "zz a", "é ü", "é u"]
    df = spark.createDataFrame([(i, "g", t) for i, t in enumerate(some)], "ordinal long, g string, key string")
    for least in (0.95, 0.85, 0.75, 0.5 + 1 / 6 + 0.01):
        got = {tuple(r) for r in similar.similar_rows(df, df, ["g"], least).collect()}
        want = {(i, j) for i, a in enumerate(some) for j, b in enumerate(some) if difflib.SequenceMatcher(None, a, b).ratio() >= least}
        assert want <= got and len(want) > 400
    got = similar.representatives(df.withColumn("key", F.lit("same")).drop("g"))
    assert got[0].count() == 1 and got[1].count() == len(some) - 1


def test_large_clusters_are_united_by_element(spark, events):
    """The same merged events whether lists are united in a row or element by element."""
    rng = random.Random(3)
    rows = []
    for i in range(400):
        names = rng.sample(["a", "b", "c", "d"], rng.randint(0, 3))
        listings = [(n, f"http://{n}", rng.sample(["u1", "u2", "u3"], rng.randint(0, 3)), "signup") for n in names] + ([(names[0], "http://again", ["u9"], "signup")] if names and i % 5 == 0 else [])
        rows.append({"id": f"x{i}", "title": f"T {i}", "km": rng.sample([5, 10, 21, 42, "10 mi"], rng.randint(0, 4)), "listings": listings, "image": rng.choice([None, f"i{i}"]), "cancelled": i == 7})
    e = events(*rows)
    members = e.select("ordinal", F.when(F.col("ordinal") <= 250, 1).when(F.col("ordinal") <= 300, 2).otherwise(F.col("ordinal")).alias("cluster"))
    show = lambda few: sorted(str(r.asDict(recursive=True)) for r in resolve.survivors(e, members, few).collect())
    assert show(10**6) == show(0) == show(100)
    assert resolve.survivors(e, members, 100).filter("n_members = 250").count() == 1


def test_pieces_of_unlike_titles_do_not_meet(spark):
    """In a large group of titles with the same letters, nearly equal ones meet, and few others: candidates grow with the titles, not with their pairs."""
    import difflib
    import hashlib

    rng = random.Random(11)
    some = [f"{h[:12]} {h[12:24]}" for h in (hashlib.md5(str(i).encode()).hexdigest() for i in range(600))]
    near = [t[:k] + rng.choice(["", "z", t[k]]) + t[k + 1 :] for t in some[:150] for k in [rng.choice([*range(12), *range(13, 25)])]]  # two words stay
    a, b = (spark.createDataFrame([(i, "g", t) for i, t in enumerate(x)], "ordinal long, g string, key string") for x in (some, near))
    lengths = sorted({len(t) for t in near})
    one = a.select("ordinal", F.explode(similar.marks_looked_up(F.col("key"), 0.95, lengths)).alias("point"))
    two = b.select("ordinal", F.explode(similar.piece_marks(F.col("key"), 0.95)).alias("point"))
    assert one.join(two, "point").count() < 1500
    got = {tuple(r) for r in similar.similar_rows(a, b, ["g"], 0.95).collect()}
    assert {(i, j) for i, s in enumerate(some) for j, t in enumerate(near) if difflib.SequenceMatcher(None, s, t).ratio() >= 0.95} <= got and len(got) < 1.2 * len(near)


def test_small_and_large_groups_give_the_same(spark, monkeypatch):
    """Whether all rows of a group meet or titles meet by what they have in common, no pair that is alike enough is lost."""
    import difflib

    rng = random.Random(4)
    rows = [(i, f"g{rng.randrange(6)}", t.strip()) for i, t in enumerate(titles(rng, 300, roots=15))]
    df = spark.createDataFrame(rows, "ordinal long, g string, key string")
    for least in (0.95, 0.85):
        alike = {(i, j) for i, g, s in rows for j, h, t in rows if g == h and " " in s and " " in t and difflib.SequenceMatcher(None, s, t).ratio() >= least}
        for few in (0, 10**6):
            monkeypatch.setattr(similar.by_size, "__defaults__", (few,))
            assert alike <= {tuple(r) for r in similar.similar_rows(df, df, ["g"], least).collect()} and len(alike) > 200


@pytest.mark.parametrize("edits", [True, False])
def test_all_within_days_equals_the_decision_on_all_pairs(spark, edits):
    """Kinds with copies, titles of one word and of none, links, unknown days: the pairs that the decision confirms one by one."""
    rng = random.Random(13)
    words = ["large ring", "large rings", "hot bolt", "hot bolts", "ring", "rings", "", None, "old cold plate", "cold plate"]
    rows = [
        (i, rng.choice([None, *(dt.date(2024, 1, 1) + dt.timedelta(d) for d in (0, 0, 1, 9, 20, 31, 32, 60))]), rng.choice(["a", "b", None]), "BR", rng.choice(["", "x", "x"]), rng.choice(words), rng.choice([["10"], ["5"], [], None, ["5", "10"]]), rng.choice([[], [], [], ["l1"], ["l2", "l1"]]))
        for i in rng.sample(range(5000), 600)
    ]
    df = spark.createDataFrame(rows, "ordinal long, day date, sub string, country string, town string, key string, kms array<string>, links array<string>")
    ratio = {"similarity": lambda a, b: 1 - F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b), F.lit(1))} if edits else {}
    want = sorted(map(tuple, resolve.confirmed(resolve.within_days(df, 31, "sub"), df, **ratio).collect()))
    assert sorted(map(tuple, resolve.all_within_days(df, 31, **ratio).collect())) == want and len(want) > 2000


def test_survivors_take_each_row_once(events):
    """Rows of small clusters are gathered whole, with one order each, not with one for every column."""
    e = events({"title": "A b"}, {"title": "A b"}, {"title": "C d"})
    out = resolve.survivors(e, e.select("ordinal", (F.col("ordinal") % 2).alias("cluster")))
    assert "min_by" not in out._jdf.queryExecution().executedPlan().toString()
    assert sorted((r.cluster, r.ordinal, r.n_members) for r in out.collect()) == [(0, 2, 1), (1, 1, 2)]


def test_counts_of_letters_lose_no_pair(spark, monkeypatch):
    """Rows that meet without their titles: all pairs that are alike enough are among them, in small groups and in large ones, by days too."""
    import difflib

    rng = random.Random(6)
    some = [*(t.strip() for t in titles(rng, 300, roots=15)), "a b", "aaaaaaaaaaaaaaaaaaaaaaaaa b", "aaaaaaaaaaaaaaaaaaaaaaaa b", "é ü", "é u"]
    rows = [(i, f"g{rng.randrange(6)}", dt.date(2024, 1, 1) + dt.timedelta(rng.choice([0, 0, 20, 60])), t) for i, t in enumerate(some)]
    df = spark.createDataFrame(rows, "ordinal long, g string, day date, key string").withColumns(similar.counted())
    ratio = {(i, j): difflib.SequenceMatcher(None, s, t).ratio() for i, g, _, s in rows for j, h, _, t in rows if g == h and " " in s and " " in t}
    apart = lambda i, j: abs((rows[i][2] - rows[j][2]).days)
    for few in (0, 10**6):
        monkeypatch.setattr(similar.by_size, "__defaults__", (few,))
        for least in (0.95, 0.85):
            alike = {p for p, r in ratio.items() if r >= least}
            assert alike <= {tuple(r) for r in similar.near_rows(df, df, ["g"], least).collect()} and len(alike) > 200
        near = {p for p, r in ratio.items() if (r >= 0.85 and apart(*p) <= 31) or (r >= 0.75 and apart(*p) == 0)}
        got = {tuple(r) for r in similar.near_rows(df, df, ["g"], 0.85, 31, 0.75).collect()}
        assert near <= got and all(apart(*p) <= 31 for p in got)


def shuffle_files(spark):
    files = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().getAllFiles().toList()
    return {n for i in range(files.size()) if (n := files.apply(i).getName()).startswith("shuffle_")}


def test_what_was_shuffled_for_a_written_table_is_deleted(spark):
    before = shuffle_files(spark)
    table = written(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count(), "counts")
    assert not shuffle_files(spark) - before
    assert table.count() == 7 and spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"


def test_titles_are_not_shuffled_with_their_pieces(spark, events, no_link, tmp_path):
    """Rows of one day in a large group and of one subdivision meet without their titles, which are shuffled once, to find copies."""
    import hashlib

    name = lambda i: "".join(hashlib.sha512(f"{i}/{k}".encode()).hexdigest() for k in range(3))
    rows = [{"id": f"x{i}", "title": f"{name(i)[:150]} {name(i)[150:300]}", "day": "2024-03-01", "sub": f"S{i % 400}", "link": f"http://l/{i}"} for i in range(1200)]
    new, stored = written_once(spark, events(*rows[:400]), tmp_path, "long-new"), written_once(spark, events(*rows[400:]), tmp_path, "long-stored")
    store = spark.sparkContext._jsc.sc().statusStore()

    def written_by_stages():
        stages = store.stageList(None, False, False, spark._sc._gateway.new_array(spark._jvm.double, 0), spark._jvm.java.util.ArrayList())
        return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))

    before = written_by_stages()
    assert reconcile.matches(new, stored.withColumn("id", F.concat(F.lit("s"), "id")), no_link).count() == 0
    assert written_by_stages() - before < 1.6 * sum(len(r["title"]) for r in rows)
