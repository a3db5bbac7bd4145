"""Readers of landed payloads; a row that cannot be read is kept apart, never fatal."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.functions.structured import json_ld_blocks, json_ld_events
from cadenza.operators.quality import first_of
from cadenza.schema import RACE_EVENT


def read_json_records(spark: SparkSession, path: str, schema: str, multi_line: bool = False) -> DataFrame:
    """JSON records with a fixed schema; what cannot be read is in _corrupt_record."""
    return spark.read.schema(f"{schema}, _corrupt_record string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record").option("multiLine", multi_line).json(path)


def with_defaults(events: DataFrame) -> DataFrame:
    """Fields that older records lack get their defaults; distances without a length or label are dropped."""
    out = events
    for field in ("is_cancelled", "is_major"):
        out = out.withColumn(field, F.coalesce(F.col(field), F.lit(False)))
    kind = lambda x: F.when(x["kind"].isin("signup", "organizer", "calendar"), x["kind"]).otherwise("calendar")
    return (
        out.withColumn("country", F.coalesce("country", F.lit("BR")))
        .withColumn("miss_count", F.coalesce("miss_count", F.lit(0)))
        .withColumn("distances", F.filter(F.coalesce("distances", F.array()), lambda d: d["km"].isNotNull() | d["label"].isNotNull()))
        .withColumn("listings", F.transform(F.coalesce("listings", F.array()), lambda x: x.withField("kind", kind(x))))
    )


#: Where a record that could not be read came from, what it says, and why: `json` (the payload or record is no such JSON) or `no_id`.
QUARANTINE = "file string, place long, record string, reason string"


def decoded(records: DataFrame, schema: str = RACE_EVENT, key: str = "id") -> tuple[DataFrame, DataFrame]:
    """(rows, quarantine) of (file, place, record), each record a JSON text read on its own.

    A record with a value of another kind than its field's, or without a key, goes to quarantine; the others of its
    file stay. Rows have the schema's columns, `file` and `place`; a text without a place is no record.
    """
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}
    parsed = records.withColumn("__e", F.from_json("record", f"{schema}, _corrupt_record string", options))
    bad = F.col("place").isNull() | F.col("__e").isNull() | F.col("__e._corrupt_record").isNotNull()
    reason = F.when(bad, "json").when(F.coalesce(F.col(f"__e.{key}"), F.lit("")) == "", "no_id")
    parsed = parsed.withColumn("reason", reason)
    quarantine = parsed.filter("reason IS NOT NULL").select("file", F.col("place").cast("long").alias("place"), "record", "reason")
    return parsed.filter("reason IS NULL").select("file", "place", "__e.*").drop("_corrupt_record"), quarantine


def snapshot_records(spark: SparkSession, path: str, field: str = "events", multi_line: bool = True) -> tuple[DataFrame, DataFrame]:
    """(rows, quarantine) of payloads {events: [...]}, one a file, or one a line.

    The list is split into the texts of its records before any of them is read, so a bad record costs itself alone. A payload
    that is no JSON is one row of the quarantine, without a place.
    """
    payloads = read_json_records(spark, path, f"{field} array<string>", multi_line).withColumn("file", F.input_file_name())
    if not multi_line:
        payloads = payloads.withColumn("file", F.concat_ws("#", "file", F.monotonically_increasing_id().cast("string")))
    records = payloads.select("file", "_corrupt_record", F.posexplode_outer(field).alias("place", "record")).filter("place IS NOT NULL OR _corrupt_record IS NOT NULL")
    return decoded(records.select("file", "place", F.when(F.col("place").isNull(), F.col("_corrupt_record")).otherwise(F.col("record")).alias("record")))


def read_snapshot(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Stored events of snapshot payloads, those that can be read; of an id given twice the row with more listings, then the later one."""
    rows = with_defaults(snapshot_records(spark, path, multi_line=multi_line)[0])
    return first_of(rows, ["id"], F.size("listings").desc(), F.col("file").desc(), F.col("place").desc()).drop("file", "place")


def write_snapshot(events: DataFrame, path: str) -> None:
    """One JSON record a line, in order of date."""
    events.sort(F.col("event_date").asc_nulls_last()).write.mode("overwrite").json(path)


def write_locations(locations: DataFrame, path: str) -> None:
    """(country, country_name, code, name) as one JSON object a country, in a folder of its own."""
    parts = F.array_sort(F.collect_list(F.struct("code", "name"))).alias("subdivisions")  # those of one country
    rows = locations.groupBy("country").agg(F.min("country_name").alias("country_name"), parts)
    rows.withColumnRenamed("country_name", "name").write.partitionBy("country").mode("overwrite").json(path)


def read_locations(spark: SparkSession, path: str) -> DataFrame:
    """(country, country_name, code, name) from one JSON object a country; the code is its folder's or its file's name."""
    raw = spark.read.schema("name string, subdivisions array<struct<code:string,name:string>>").option("multiLine", True).option("recursiveFileLookup", True).json(path)
    file = F.input_file_name()
    country = F.upper(F.coalesce(F.nullif(F.regexp_extract(file, r"/country=([^/]+)/", 1), F.lit("")), F.regexp_extract(file, r"([^/]+)\.json", 1)))
    return raw.select(country.alias("country"), F.col("name").alias("country_name"), F.explode("subdivisions").alias("s")).select("country", "country_name", "s.code", "s.name")


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Landed HTML files: (url_file, html)."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("url_file"), F.col("value").alias("html"))


def json_ld_records(pages: DataFrame, source: str) -> DataFrame:
    """one row for every event in the pages' JSON-LD."""
    return pages.select(F.lit(source).alias("source"), "*", F.explode(json_ld_events(json_ld_blocks(F.col("html")))).alias("event"))


def joined_details(listing: DataFrame, detail: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Detail rows fill what their listing rows leave blank."""
    other = detail.select(F.col(key).alias("__k"), *(F.col(c).alias(f"__{c}") for c in columns))
    rows = listing.join(other, F.col(key) == F.col("__k"), "left")
    return rows.withColumns({c: F.coalesce(F.col(c), F.col(f"__{c}")) for c in columns}).select(*listing.columns)


def first_source_with_rows(tables: list[DataFrame], key: str) -> DataFrame:
    """For each key the rows of the first table that has any."""
    ranked = [t.withColumn("__rank", F.lit(i)) for i, t in enumerate(tables)]
    rows = ranked[0]
    for t in ranked[1:]:
        rows = rows.unionByName(t, allowMissingColumns=True)
    least = rows.groupBy(key).agg(F.min("__rank").alias("__least"))
    return rows.join(least, key).filter("__rank = __least").drop("__rank", "__least")
