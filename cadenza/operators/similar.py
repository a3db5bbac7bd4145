"""Rows with similar titles, found without comparing all pairs and without losing one.

A sequence ratio of `least` or more means that all but (1 - least) of both titles' letters stand in one alignment. A
letter that is missing breaks two letter pairs of a title at most, one that is put in breaks one, so titles of
length n that pass lose at most 4n(1 - least) / (2 - least) of their different letter pairs. Of two sets, if all but so
many of one are in the other, one of the first few of each in any common order is in both, so it is enough that titles
meet by the rarest of their letter pairs. Titles too short to be sure of a common pair meet one another by a mark of
their own. Where titles must be nearly equal (SURE_PIECES), pairs of letters would let most titles of a large group meet, so
there a title is cut into one piece more than letters may be left out or put in: one piece at least is untouched, and
the i-th has exactly i such letters before it if it is the first that can be, which leaves few places for it.
Different titles of a group are compared once, however many rows have them; what meets is then bounded by
lengths and by edits: letters that stand in no alignment are at least as many as edits are needed. Groups with few rows
on the right need none of this: all their rows meet.

Titles are most of what a row holds, so where few of those that meet are alike (pieces, rows of small groups) rows meet
without them: by marks, lengths and counts of letters, which bound the ratio too. Whoever decides looks the titles up.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadenza.functions.text import tokens_contained
from cadenza.operators.components import forgotten, written

#: Letters of a title key from the rare to the frequent; any order gives the same result.
RARE_FIRST = "qxkzwyjhfbvgpumcdltnrsioea9876543210 "

#: What titles without a sure letter pair meet by.
SHORT = "*"

#: Ratio from which on titles meet by pieces; below, pieces are as short as letter pairs.
SURE_PIECES = 0.9

#: Letters that are counted, and together: frequent ones, and digits, which few titles have.
COUNTED = ("a", "b", "c", "d", "e", "f", "o0", "i1", "n2", "r3", "s4", "t5", "l6", "m7", "u8", "9")

#: Rows of a group on the right up to which all rows of the group meet; a title has about as many meeting points.
FEW = 50


def letter_pairs(key: Column) -> Column:
    """Different letter pairs of a title key, the rarest first."""
    every = F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(key) - 1, F.lit(1))), lambda i: F.substring(key, i, F.lit(2))))
    place = lambda c: F.greatest(F.instr(F.lit(RARE_FIRST), c), F.lit(1))
    ranked = F.transform(every, lambda x: F.struct((place(F.substring(x, 1, 1)) * place(F.substring(x, 2, 1))).alias("weight"), x.alias("pair")))
    return F.array_sort(ranked)["pair"]


def meeting_points(key: Column, least: float) -> Column:
    """What a title meets others by that may be `least` alike."""
    broken = F.floor(F.length(key) * (4 * (1 - least) / (2 - least)) + 1e-6).cast("int")
    # The pairs are a lambda's argument, so they are made once a title.
    points = F.transform(F.array(letter_pairs(key)), lambda x: F.when(broken >= F.size(x), F.concat(x, F.array(F.lit(SHORT)))).otherwise(F.slice(x, F.lit(1), broken + 1)))
    return F.get(points, 0)


def _left_out(n: Column, other: Column, least: float) -> Column:
    """Letters that two titles of these lengths may have outside an alignment."""
    return F.floor((n + other) * (1 - least) + 1e-6).cast("int")


def _longest(n: Column, least: float) -> Column:
    return F.floor(n * ((2 - least) / least) + 1e-6).cast("int")


def _piece(key: Column, n: Column, i: Column, pieces: Column, shift: Column) -> Column:
    """A mark of length, number and letters of the i-th of the pieces of a title of n letters, looked up `shift` letters later in `key`; null where there are none."""
    start, end = (F.floor(x * n / pieces).cast("int") for x in (i, i + 1))
    return F.when((start + shift >= 0) & (end + shift <= F.length(key)), F.xxhash64(n, i, F.substring(key, start + shift + 1, end - start)))


def piece_marks(key: Column, least: float) -> Column:
    """Marks of the pieces of a title."""
    n = F.length(key)
    most = _left_out(n, _longest(n, least), least)
    return F.transform(F.sequence(F.lit(0), most), lambda i: _piece(key, n, i, most + 1, F.lit(0)))


def marks_looked_up(key: Column, least: float, lengths: list[int]) -> Column:
    """Marks of pieces that a title at least `least` alike, of one of the lengths, may have in common with this one."""
    own = F.length(key)

    def of(n: Column) -> Column:
        pieces = _left_out(n, _longest(n, least), least) + 1
        most = _left_out(own, n, least)
        places = lambda i: F.transform(F.sequence(-i, i, F.lit(2)), lambda by: F.when(F.abs(own - n - by) <= most - i, _piece(key, n, i, pieces, by)))
        return F.flatten(F.transform(F.sequence(F.lit(0), F.least(pieces - 1, most)), places))

    some = F.filter(F.array(*map(F.lit, lengths)), lambda n: (_longest(n, least) >= own) & (_longest(own, least) >= n))
    return F.array_distinct(F.array_compact(F.flatten(F.transform(some, of))))


def may_be_alike(a: Column, b: Column, least: float) -> Column:
    """Whether lengths and edits leave it open that two texts have a sequence ratio of `least` or more."""
    both = F.length(a) + F.length(b)
    edits = F.call_function("levenshtein", a, b, F.floor(both * (1 - least) + 1e-6).cast("int"))
    return (2 * F.least(F.length(a), F.length(b)) >= least * both - 1e-6) & (edits >= 0)


def letter_counts(key: Column) -> Column:
    """How often a title has the letters of each of the groups in COUNTED, in four bits each, 15 for more."""
    without = lambda letters: reduce(lambda c, x: F.replace(c, F.lit(x), F.lit("")), letters, key)
    of = lambda letters: F.least(F.octet_length(key) - F.octet_length(without(letters)), F.lit(15)).cast("long")
    return reduce(Column.bitwiseOR, (F.shiftleft(of(letters), 4 * i) for i, letters in enumerate(COUNTED)))


def counted() -> dict[str, Column]:
    """What titles are first compared by."""
    return {"n": F.length("key"), "letters": letter_counts(F.col("key"))}


def counts_allow(least: float) -> Column:
    """Whether lengths and letter counts (a_n, a_letters, b_n, b_letters) leave it open that two titles have a sequence ratio of `least` or more: letters that one has more often stand in no alignment."""
    both = F.col("a_n") + F.col("b_n")
    one = lambda c, i: F.shiftrightunsigned(F.col(c), 4 * i).bitwiseAND(F.lit(15))
    apart = reduce(Column.__add__, (F.abs(one("a_letters", i) - one("b_letters", i)) for i in range(16)))
    return (2 * F.least("a_n", "b_n") >= least * both - 1e-6) & (apart <= _left_out(F.col("a_n"), F.col("b_n"), least))


def _titles(rows: DataFrame, on: list[str], name: str) -> DataFrame:
    return rows.filter(F.col("key") != "").select(*on, F.col("key").alias(name)).distinct()


def similar_titles(left: DataFrame, right: DataFrame, on: list[str], least: float, words: int = 2) -> DataFrame:
    """(on, key_a, key_b): different titles of `words` words or more, a of the left and b of the right rows of a group, that may be `least` alike."""
    several = lambda rows: rows.filter(F.size(F.split("key", " ")) >= words)
    a, b = _titles(several(left), on, "key_a"), _titles(several(right), on, "key_b")
    if least >= SURE_PIECES:
        # At most as many numbers as the longest title has letters.
        lengths = sorted(n for (n,) in b.select(F.length("key_b")).distinct().collect())
        points = [marks_looked_up(F.col("key_a"), least, lengths) if lengths else F.array().cast("array<long>"), piece_marks(F.col("key_b"), least)]
    else:
        points = [meeting_points(F.col(c), least) for c in ("key_a", "key_b")]
    one, two = (x.select("*", F.explode(p).alias("point")) for x, p in zip((a, b), points, strict=True))
    met = one.join(two, [*on, "point"])
    # Compared before equal pairs are put together: most fail, and those are not shuffled.
    return met.filter(may_be_alike(F.col("key_a"), F.col("key_b"), least)).select(*on, "key_a", "key_b").distinct()


def contained_titles(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """(on, key_a, key_b): titles of which one has all words of the other, or that are equal. The one with fewer words meets others by its longest word."""
    a, b = _titles(left, on, "key_a"), _titles(right, on, "key_b")
    words = lambda c: F.array_distinct(F.split(c, " "))
    longest = lambda c: F.array_min(F.transform(words(c), lambda w: F.struct((-F.length(w)).alias("n"), w.alias("w"))))["w"].alias("point")
    every = lambda c: F.explode(words(c)).alias("point")
    one = a.select(*on, "key_a", longest("key_a")).join(b.select(*on, "key_b", every("key_b")), [*on, "point"])
    two = a.select(*on, "key_a", every("key_a")).join(b.select(*on, "key_b", longest("key_b")), [*on, "point"])
    both = one.unionByName(two).select(*on, "key_a", "key_b")
    return both.filter((F.col("key_a") == F.col("key_b")) | tokens_contained(F.split("key_a", " "), F.split("key_b", " "))).distinct()


def by_size(left: DataFrame, right: DataFrame, on: list[str], few: int = FEW) -> tuple[tuple[DataFrame, DataFrame], tuple[DataFrame, DataFrame] | None]:
    """Both sides of the groups of at most `few` rows on the right, and of the larger ones; none if there are none."""
    large = written(right.groupBy(*on).count().filter(F.col("count") > few).select(*on), "large")
    if large.isEmpty():
        forgotten(large)
        return (left, right), None
    return tuple(tuple(x.join(large, on, how) for x in (left, right)) for how in ("left_anti", "left_semi"))


def met_rows(left: DataFrame, right: DataFrame, on: list[str], *more: str) -> DataFrame:
    """All rows of a group with one another: (a, b, key_a, key_b), further columns as a_... and b_...."""
    one, two = (
        x.filter(F.col("key") != "").select(*on, F.col("key").alias(f"key_{s}"), F.col("ordinal").alias(s), *(F.col(c).alias(f"{s}_{c}") for c in more))
        for x, s in ((left, "a"), (right, "b"))
    )
    return one.join(two, on)


def _similar(least: float, words: int = 2) -> Column:
    several = [F.size(F.split(c, " ")) >= words for c in ("key_a", "key_b")]
    return reduce(Column.__and__, several) & may_be_alike(F.col("key_a"), F.col("key_b"), least)


def _contained() -> Column:
    return (F.col("key_a") == F.col("key_b")) | tokens_contained(F.split("key_a", " "), F.split("key_b", " "))


def rows_of(titles: DataFrame, left: DataFrame, right: DataFrame, on: list[str], *more: str) -> DataFrame:
    """(a, b): ordinals of the rows that have these titles; further columns as a_... and b_...."""
    one = left.select(*on, F.col("key").alias("key_a"), F.col("ordinal").alias("a"), *(F.col(c).alias(f"a_{c}") for c in more))
    two = right.select(*on, F.col("key").alias("key_b"), F.col("ordinal").alias("b"), *(F.col(c).alias(f"b_{c}") for c in more))
    return titles.join(one, [*on, "key_a"]).join(two, [*on, "key_b"]).select("a", "b", *(f"{s}_{c}" for c in more for s in "ab"))


def met_counts(left: DataFrame, right: DataFrame, on: list[str], *more: str) -> DataFrame:
    """All rows (with what is `counted`) of a group with one another, without their titles: (a, b), what `counts_allow` takes, further columns as a_... and b_...."""
    one, two = (x.filter(F.col("key") != "").select(*on, F.col("ordinal").alias(s), *(F.col(c).alias(f"{s}_{c}") for c in ("n", "letters", *more))) for x, s in ((left, "a"), (right, "b")))
    return one.join(two, on)


def rows_by_pieces(left: DataFrame, right: DataFrame, on: list[str], least: float, *more: str, words: int = 2) -> DataFrame:
    """(a, b): rows of a group whose titles have a piece in common and may be `least` alike (SURE_PIECES or more); further columns as a_... and b_....

    Marks meet with a number of the title, its length and its letter counts. Two titles with one number only give more rows.
    """
    several = lambda rows: rows.filter((F.size(F.split("key", " ")) >= words) & (F.col("key") != ""))
    one, two = (several(x).withColumn("title", F.hash(*on, "key")).withColumns({c: v for c, v in counted().items() if c not in x.columns}) for x in (left, right))
    # At most as many numbers as the longest title has letters. Of a list that must not be empty Spark would make the marks three times.
    lengths = sorted(n for (n,) in two.select("n").distinct().collect())
    names = ["title", "n", "letters"]
    points = [marks_looked_up(F.col("key"), least, lengths) if lengths else F.array().cast("array<long>"), piece_marks(F.col("key"), least)]
    marks = [x.select(*(F.col(c).alias(f"{s}_{c}") for c in names), *on, F.explode_outer(p).alias("point")).select(F.when(F.col("point").isNotNull(), F.xxhash64(*on, "point")).alias("mark"), *(f"{s}_{c}" for c in names)) for x, p, s in zip((one, two), points, "ab", strict=True)]
    met = written(marks[0].join(marks[1], "mark").filter(counts_allow(least)).drop("mark").distinct(), "met")
    rows = [x.select(*on, F.col("ordinal").alias(s), *(F.col(c).alias(f"{s}_{c}") for c in (*names, *more))) for x, s in ((one, "a"), (two, "b"))]
    out = met.join(rows[0], [f"a_{c}" for c in names]).join(rows[1], [*on, *(f"b_{c}" for c in names)])
    return out.select("a", "b", *(f"{s}_{c}" for c in more for s in "ab"))


def similar_rows(left: DataFrame, right: DataFrame, on: list[str], least: float, *more: str, words: int = 2) -> DataFrame:
    """(a, b): rows of one group whose titles may be `least` alike."""
    small, large = by_size(left, right, on)
    out = met_rows(*small, on, *more).filter(_similar(least, words)).select("a", "b", *(f"{s}_{c}" for c in more for s in "ab"))
    return out.union(_in_large(*large, on, least, *more, words=words)) if large else out


def _in_large(left: DataFrame, right: DataFrame, on: list[str], least: float, *more: str, words: int = 2) -> DataFrame:
    if least >= SURE_PIECES:
        return rows_by_pieces(left, right, on, least, *more, words=words)
    return rows_of(similar_titles(left, right, on, least, words), left, right, on, *more)


def near_rows(left: DataFrame, right: DataFrame, on: list[str], least: float, days: int | None = None, same_day: float = 1.0) -> DataFrame:
    """(a, b): rows (with what is `counted`) of one group whose titles may be `least` alike, for a decision that looks them up: in small groups lengths and letters are compared only.

    With `days` both have a `day`; they are at most so many days apart, and on one day all those of a small group and in a large one
    those whose titles may be `same_day` alike, or are contained in one another, or equal. A row on the left may be in several groups.
    """
    more = [] if days is None else ["day"]
    small, large = by_size(left, right, on)
    met = met_counts(*small, on, *more)
    near = F.lit(True) if days is None else F.abs(F.datediff("a_day", "b_day")) <= days
    met = met.filter(near & counts_allow(least) if days is None else (F.col("a_day") == F.col("b_day")) | (near & counts_allow(least)))
    if not large:
        return met.select("a", "b")
    out = met.select("a", "b").union(_in_large(*large, on, least, *more).filter(near).select("a", "b"))
    return out if days is None else out.union(same_day_rows(*large, [*on, "day"], same_day))


def same_day_rows(left: DataFrame, right: DataFrame, on: list[str], least: float, *more: str, words: int = 2) -> DataFrame:
    """(a, b): rows of one group whose titles may be `least` alike, or are contained in one another, or equal."""
    small, large = by_size(left, right, on)
    out = met_rows(*small, on, *more).filter(_similar(least, words) | _contained()).select("a", "b", *(f"{s}_{c}" for c in more for s in "ab"))
    if not large:
        return out
    titles = similar_titles(*large, on, least, words).unionByName(contained_titles(*large, on)).distinct()
    return out.union(rows_of(titles, *large, on, *more))


def representatives(rows: DataFrame, more: dict[str, Column] | None = None) -> tuple[DataFrame, DataFrame]:
    """Rows that differ in what is compared, the first of each kind, written with `more` columns; and (rep, ordinal) of the others, their copies."""
    names = [c for c in rows.columns if c != "ordinal"]
    sorted_lists = {c: F.array_sort(c) for c, kind in rows.dtypes if kind.startswith("array")}
    kinds = rows.withColumns(sorted_lists).select("ordinal", F.struct(*names).alias("kind"))
    first = kinds.groupBy("kind").agg(F.min("ordinal").alias("rep"), F.count(F.lit(1)).alias("copies")).select(F.col("rep").alias("ordinal"), "kind.*", "copies")
    first = written(first.withColumns(more or {}), "kinds")
    several = first.filter("copies > 1").select(F.struct(*names).alias("kind"), F.col("ordinal").alias("rep"))
    # Where all rows differ, nothing is shuffled to find copies.
    copies = rows.select(F.col("ordinal").alias("rep"), "ordinal").limit(0) if several.isEmpty() else kinds.join(several, "kind").filter("ordinal <> rep").select("rep", "ordinal")
    return first.drop("copies"), copies
