"""Sources by name: where their payloads land, how they are read, and how rows become events."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark import inheritable_thread_target
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cadenza.operators.components import forgotten, written

Reader = Callable[[SparkSession, str], DataFrame]
Parser = Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class Source:
    """A source's payloads lie under `path`; parse gives event columns and `source_seq`, the place in the source."""

    name: str
    path: str
    read: Reader
    parse: Parser
    rank: int
    enabled: bool = True


class Registry:
    """The sources that a run takes its rows from."""

    def __init__(self):
        self.sources: dict[str, Source] = {}

    def register_source(self, name: str, path: str, read: Reader, parse: Parser, enabled: bool = True) -> None:
        self.sources[name] = Source(name, path, read, parse, len(self.sources), enabled)

    def chosen(self, names: list[str] | None = None) -> list[Source]:
        return [s for s in self.sources.values() if s.name in names] if names is not None else [s for s in self.sources.values() if s.enabled]

    def read(self, spark: SparkSession, names: list[str] | None = None, at_once: int = 4) -> tuple[DataFrame | None, dict[str, str]]:
        """S3, O1: rows of all chosen sources with `source` and `ordinal`, and why sources failed that did.

        Each source's rows are written by a job of their own, `at_once` side by side, so one that fails on the way, in whatever
        task, is left out and named, and the others stay. ordinal is the rank of (source, file, payload, place), counted by `numbered`.
        """

        @inheritable_thread_target(spark)
        def run(s: Source) -> tuple[DataFrame | None, str]:
            try:
                rows = s.parse(s.read(spark, s.path))
                if rows.schema["source_seq"].dataType.typeName() != "struct":
                    rows = rows.withColumn("source_seq", F.struct(F.lit("").alias("file"), F.lit(0).alias("payload"), F.col("source_seq").alias("place")))
                order = F.struct(F.lit(s.rank).alias("rank"), F.col("source_seq").cast(PLACE).alias("place"))
                return written(rows.withColumn("source", F.lit(s.name)).withColumn("source_seq", order), f"source-{s.rank}"), ""
            except (PySparkException, Py4JJavaError) as e:
                return None, str(e).splitlines()[0]

        chosen = self.chosen(names)
        with ThreadPoolExecutor(at_once) as pool:
            done = list(pool.map(run, chosen))
        failed = {s.name: why for s, (rows, why) in zip(chosen, done, strict=True) if rows is None}
        tables = [rows for rows, _ in done if rows is not None]
        if not tables:
            return None, failed
        out = numbered(reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables))
        for table in tables:
            forgotten(table)
        return out, failed


#: A record's place in its source; a plain number is a place in one payload.
PLACE = "struct<file:string,payload:bigint,place:bigint>"


def numbered(rows: DataFrame) -> DataFrame:
    """`ordinal` for `source_seq`: ranks 1, 2, ... in that order, so the same rows get the same numbers under any partitioning.

    Rows are sorted by range; each range's rows are counted on the way, and a range begins where
    those before it end. Only the counts of the ranges meet. Rows equal in source_seq are ordered by their id.
    """
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = ["source_seq", *(["id"] if "id" in rows.columns else [])]
    ranged = written(rows.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).withColumn("__part", F.spark_partition_id()), "ordinals")
    sizes = ranged.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    before = sizes.withColumn("__before", F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("__n")
    own = F.row_number().over(Window.partitionBy("__part").orderBy(*keys))
    return ranged.withColumn("__own", own).join(F.broadcast(before), "__part").withColumn("ordinal", F.col("__own") + F.col("__before")).drop("__part", "__own", "__before", "source_seq")
