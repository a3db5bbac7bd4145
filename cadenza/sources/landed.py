"""Landed folders as a data source: one folder a source, one partition a file, errors as rows.

`read_landed` gives (source, file, place, day, record, error) for each line of each file. What cannot be opened or read is a row
with `error` and no record, so a broken file or source never stops the others. Filters on `source` and `day` are taken over:
folders of other sources are not opened, and lines of other days never leave the task.

Executors read the files themselves, so the folder is one that all of them reach.
"""

from __future__ import annotations

import datetime as dt
import json
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, IsNotNull, IsNull, LessThan, LessThanOrEqual

SCHEMA = pa.schema([("source", pa.string()), ("file", pa.string()), ("place", pa.int64()), ("day", pa.date32()), ("record", pa.string()), ("error", pa.string())])

#: Lines of a batch.
LINES = 2000

_COMPARE = {EqualTo: lambda x, y: x == y, GreaterThan: lambda x, y: x > y, GreaterThanOrEqual: lambda x, y: x >= y, LessThan: lambda x, y: x < y, LessThanOrEqual: lambda x, y: x <= y}


def holds(value, tests: list[tuple[str, object]]) -> bool:
    """Whether a value passes filters as SQL has them: a missing one only passes IS NULL."""
    for kind, other in tests:
        if kind in ("IsNull", "IsNotNull"):
            if (value is None) != (kind == "IsNull"):
                return False
        elif value is None or not next(f for t, f in _COMPARE.items() if t.__name__ == kind)(value, other):
            return False
    return True


class File(InputPartition):
    def __init__(self, source: str, path: str):
        self.source, self.path = source, path


class LandedReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.day_field = options["path"], options.get("day_field", "date")
        self.tests: dict[str, list[tuple[str, object]]] = {"source": [], "day": []}

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            column = f.attribute[0] if len(f.attribute) == 1 else ""
            if column in self.tests and isinstance(f, (IsNull, IsNotNull, *_COMPARE)):
                self.tests[column].append((type(f).__name__, getattr(f, "value", None)))
            else:
                yield f

    def partitions(self) -> list[File]:
        fs, top = pyarrow.fs.FileSystem.from_uri(self.path)
        names = [(x.path[len(top.rstrip("/")) + 1 :].split("/"), x.path) for x in fs.get_file_info(pyarrow.fs.FileSelector(top, recursive=True)) if x.is_file]
        files = [(folder.split("=")[-1], path) for (folder, *rest), path in names if rest and not rest[-1].startswith((".", "_"))]
        return [File(source, path) for source, path in sorted(files) if holds(source, self.tests["source"])]

    def read(self, partition: File) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        try:
            fs, _ = pyarrow.fs.FileSystem.from_uri(self.path)
            with fs.open_input_stream(partition.path) as raw:
                for place, line in enumerate(_lines(raw)):
                    day = record = error = None
                    try:
                        record = line.decode()
                        day = _day(json.loads(record).get(self.day_field))
                    except (ValueError, AttributeError) as e:
                        record, error = None, f"line: {type(e).__name__}"
                    if holds(day, self.tests["day"]):
                        rows.append((partition.source, partition.path, place, day, record, error))
                    if len(rows) >= LINES:
                        yield _batch(rows)
                        rows = []
        except (OSError, EOFError) as e:
            if holds(None, self.tests["day"]):
                rows.append((partition.source, partition.path, None, None, None, f"file: {type(e).__name__}"))
        if rows:
            yield _batch(rows)


def _lines(stream) -> Iterator[bytes]:
    """Lines of a stream that are not empty, read piece by piece."""
    rest = b""
    while piece := stream.read(1 << 20):
        *lines, rest = (rest + piece).split(b"\n")
        yield from (x for x in lines if x.strip())
    if rest.strip():
        yield rest


def _day(value) -> dt.date | None:
    return None if value is None else dt.date.fromisoformat(str(value)[:10])


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), SCHEMA, strict=True)], schema=SCHEMA)


class LandedSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "landed"

    def schema(self) -> str:
        return "source string, file string, place long, day date, record string, error string"

    def reader(self, schema) -> LandedReader:
        return LandedReader(self.options)


def register(spark: SparkSession) -> None:
    """Make the format known to a session, and let it have filters pushed down."""
    spark.dataSource.register(LandedSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def read_landed(spark: SparkSession, path: str, day_field: str = "date") -> DataFrame:
    """The lines of a folder. Spark keeps the filters of a loaded frame's last scan with the frame, so each scan loads its own."""
    register(spark)
    return spark.read.format(LandedSource.name()).option("path", path).option("day_field", day_field).load()


def upcoming(spark: SparkSession, path: str, as_of: str, day_field: str = "date") -> DataFrame:
    """Records of as_of or later, and those without a date, which a range alone would lose; each part is pushed down on its own."""
    later = read_landed(spark, path, day_field).filter(F.col("day") >= F.lit(as_of).cast("date"))
    return later.unionByName(read_landed(spark, path, day_field).filter(F.col("day").isNull()))


def read_errors(spark: SparkSession, path: str) -> DataFrame:
    """S3: (source, file, n_errors) of the files that could not be read in full."""
    return read_landed(spark, path).filter(F.col("day").isNull()).filter("error IS NOT NULL").groupBy("source", "file").agg(F.count(F.lit(1)).alias("n_errors"))
