"""Places and keywords by name, from tables of names of any size: the plan stays the same whatever they hold."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadenza.functions.text import fold
from cadenza.operators.components import written
from cadenza.operators.enrich import small


def plain(c: Column) -> Column:
    """A name or text as it is compared: folded, without signs, single blanks."""
    return F.trim(F.regexp_replace(F.regexp_replace(fold(c), r"[^\w\s]", ""), r"\s+", " "))


def named_places(rows: DataFrame, key: str, text: Column, field: Column, names: DataFrame) -> DataFrame:
    """(key, code) of rows whose place is known.

    names is (name, code, kind), kind being `state` or `city`. If the row has a field for its place, that one alone counts, as
    a state before a city. Else a part of the text between commas that is a state, the last first; else one that is a
    city, the first first; else the longest city that the text has as whole words, ties by name. Everything is an
    equality of phrases: a text gives its runs of words, no longer than the longest name. Of a name given twice the least code counts.
    The same field or text is looked up once, however many rows have it.
    """
    table = names.select(plain(F.col("name")).alias("phrase"), F.col("code").alias("code"), F.col("kind").alias("kind")).filter("phrase <> ''").groupBy("phrase", "kind").agg(F.min("code").alias("code"))
    longest = table.agg(F.max(F.size(F.split("phrase", " ")))).first()[0] or 0
    every = rows.select(F.col(key).alias("__key"), F.coalesce(field, F.lit("")).alias("field"), F.coalesce(text, F.lit("")).alias("text"))
    asked_by = F.struct("field", F.when(F.col("field") == "", F.col("text")).alias("text"))
    base = every.select(asked_by.alias("key")).distinct().select("key", "key.field", F.coalesce("key.text", F.lit("")).alias("text"))
    own = base.filter("field <> ''").select("key", plain(F.col("field")).alias("phrase"), F.lit(0).alias("at"), F.lit(True).alias("own"), F.lit(False).alias("part"))
    other = base.filter("field = ''")
    parts = other.select("key", F.posexplode(F.split("text", ",")).alias("at", "phrase")).select("key", plain(F.col("phrase")).alias("phrase"), "at", F.lit(False).alias("own"), F.lit(True).alias("part"))
    words = F.split(plain(F.col("text")), " ")
    runs = F.flatten(F.transform(F.sequence(F.lit(1), F.size(words)), lambda i: F.transform(F.sequence(F.lit(1), F.least(F.lit(max(longest, 1)), F.size(words) - i + 1)), lambda n: F.concat_ws(" ", F.slice(words, i, n)))))
    inside = other.select("key", F.explode(F.array_distinct(runs)).alias("phrase")).select("key", "phrase", F.lit(0).alias("at"), F.lit(False).alias("own"), F.lit(False).alias("part"))
    asked = own.unionByName(parts).unionByName(inside).filter("phrase <> ''")
    hit = asked.join(small(table), "phrase")
    state = F.col("kind") == "state"
    tier = F.when(F.col("own"), F.when(state, 0).otherwise(1)).when(F.col("part"), F.when(state, 2).otherwise(3)).when(~state, 4)
    order = F.when(tier == 2, -F.col("at")).when(tier == 3, F.col("at")).otherwise(-F.length("phrase"))
    hit = hit.withColumns({"tier": tier, "order": order}).filter("tier IS NOT NULL")
    found = small(written(hit.groupBy("key").agg(F.min(F.struct("tier", "order", "phrase", "code")).alias("best")), "places"))
    return every.withColumn("key", asked_by).join(found, "key").groupBy(F.col("__key").alias(key)).agg(F.min("best")["code"].alias("code"))


def first_keywords(rows: DataFrame, text: Column, keywords: DataFrame, most: int = 200_000) -> DataFrame:
    """Rows with `value` of the first keyword, by `rank`, that the folded text has as a part; null if none.

    keywords is (word, value, rank), the words folded. They are counted; up to `most` become an automaton that is broadcast and reads
    each text once, whatever their number. More are joined with the parts of the texts (`keywords_by_join`).
    """
    import ahocorasick

    listed = keywords.filter("word <> ''").select("word", "value", "rank").limit(most + 1).collect()
    if len(listed) > most:
        return keywords_by_join(rows, text, keywords)
    automaton = ahocorasick.Automaton()
    for r in sorted(listed, key=lambda r: (r["rank"], r["word"]), reverse=True):  # of a word given twice the first counts
        automaton.add_word(r["word"], (r["rank"], r["word"], r["value"]))
    if listed:
        automaton.make_automaton()
    shared = rows.sparkSession.sparkContext.broadcast(automaton)
    names = rows.columns
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = shared.value
        for b in batches:
            texts = b.column(len(names)).to_pylist()
            values = [min((x for _, x in found.iter(t)), default=(0, "", None))[2] if t and len(found) else None for t in texts]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(names)], pa.array(values, pa.string())], [*names, "value"])

    return rows.withColumn("__text", fold(text)).mapInArrow(find, f"{fields}, value string")


#: Letters that a keyword begins with by which it is looked for.
BEGINNING = 3


def keywords_by_join(rows: DataFrame, text: Column, keywords: DataFrame) -> DataFrame:
    """`first_keywords` for keywords of any number, as equalities.

    Each different text gives its places; at those where a keyword's first letters stand, its parts of the lengths of such keywords
    are joined with the keywords. A text is looked up once, however many rows have it.
    """
    words = keywords.filter("word <> ''").groupBy("word").agg(F.min(F.struct("rank", "value")).alias("first"))
    begins = words.groupBy(F.substring("word", 1, BEGINNING).alias("begin")).agg(F.collect_set(F.length("word")).alias("lengths"))
    folded = rows.withColumn("__text", fold(text))
    texts = folded.select("__text").filter("__text <> ''").distinct().select("__text", F.explode(F.sequence(F.lit(1), F.length("__text"))).alias("at"))
    places = texts.select("__text", "at", F.explode(F.sequence(F.lit(1), F.least(F.lit(BEGINNING), F.length("__text") - F.col("at") + 1))).alias("n")).withColumn("begin", F.expr("substring(__text, at, n)"))
    # Shorter keywords are their own beginning; of a longer one the beginning has all its letters.
    long = F.filter("lengths", lambda n: F.when(F.col("n") == BEGINNING, n >= BEGINNING).otherwise(n == F.col("n")))
    parts = places.join(small(begins), "begin").select("__text", "at", F.explode(long).alias("n")).filter(F.col("at") + F.col("n") - 1 <= F.length("__text"))
    hits = parts.select("__text", F.expr("substring(__text, at, n)").alias("word")).distinct().join(words, "word")
    found = small(written(hits.groupBy("__text").agg(F.min(F.struct("first.rank", "word", "first.value"))["value"].alias("value")), "keywords"))
    return folded.join(found, "__text", "left").select(*rows.columns, "value")
