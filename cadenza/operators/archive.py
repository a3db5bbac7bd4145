"""A stored table in months of which a batch rewrites only those that it touches.

    path/data/<version>/event_month=2026-05/part-*.parquet
    path/manifest/000000000007.json      one line a month: which version holds it, how many rows

A reader takes the newest manifest and the folders that it names. A writer reads the months of its batch, merges, writes them
under a version of its own, and then makes the next manifest appear in one step, so readers see all of a batch or
nothing of it, and a writer that dies leaves no trace in what is read. Of two writers at once one fails, since
a manifest is never written over. A batch that has been written already is left out.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from cadenza.operators.quality import first_of

#: Month of rows without a date.
UNDATED = "undated"


class Archive:
    """K2: rows by `key` in months of `date`; the later of two rows of a key and month stays."""

    def __init__(self, spark: SparkSession, path: str, key: str = "id", date: str = "event_date", kept: int = 2):
        self.spark, self.path, self.key, self.date, self.kept = spark, path.rstrip("/"), key, date, kept
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def months(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("event_month", F.coalesce(F.date_format(self.date, "yyyy-MM"), F.lit(UNDATED)))

    def versions(self) -> list[int]:
        """Numbers of the manifests, the oldest first."""
        folder = self._path(f"{self.path}/manifest")
        if not self._fs.exists(folder):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(folder)]
        return sorted(int(n[:12]) for n in names if n.endswith(".json") and n[:12].isdigit())

    def manifest(self, version: int | None = None) -> dict:
        """{batch, months: {month: {version, rows}}} of a version, the newest if none is given."""
        if version is None:
            version = max(self.versions(), default=None)
        if version is None:
            return {"batch": None, "months": {}}
        text = self.spark.read.text(f"{self.path}/manifest/{version:012d}.json", wholetext=True).first()[0]
        return json.loads(text)

    def read(self, months: list[str] | None = None, version: int | None = None) -> DataFrame | None:
        """Rows with event_month, of some months if given; null if there are none."""
        held = self.manifest(version)["months"]
        folders = [f"{self.path}/data/{x['version']}/event_month={m}" for m, x in sorted(held.items()) if months is None or m in months]
        return self.months(self.spark.read.parquet(*folders)) if folders else None

    def upsert(self, new: DataFrame, order: Column | None = None, batch: int | None = None) -> list[str]:
        """Merge rows in and give the months that were rewritten; of rows of a key in the batch the highest by `order` counts."""
        before = self.manifest()
        if batch is not None and before["batch"] is not None and batch <= before["batch"]:
            return []
        new = self.months(new).withColumn("__new", F.lit(1)).withColumn("__order", F.lit(0) if order is None else order)
        touched = sorted(r[0] for r in new.select("event_month").distinct().collect())  # a row for each month
        stored = self.read(touched)
        if stored is not None:
            new = new.unionByName(stored.withColumns({"__new": F.lit(0), "__order": F.lit(None).cast(new.schema["__order"].dataType)}), allowMissingColumns=True)
        rows = first_of(new, ["event_month", self.key], F.col("__new").desc(), F.col("__order").desc()).drop("__new", "__order")
        version = uuid.uuid4().hex
        out = f"{self.path}/data/{version}"
        # Months of very many rows are cut by ranges of days, and by key within a day.
        rows = rows.repartitionByRange("event_month", self.date, self.key).sortWithinPartitions("event_month", F.col(self.date).asc_nulls_first(), self.key)
        rows.write.partitionBy("event_month").parquet(out)
        counts = dict(map(tuple, self.spark.read.parquet(out).groupBy(F.col("event_month").cast("string")).count().collect())) if touched else {}
        months = before["months"] | {m: {"version": version, "rows": n} for m, n in counts.items()}
        self._publish({"batch": before["batch"] if batch is None else batch, "months": months})
        return touched

    def _publish(self, manifest: dict) -> None:
        """The next manifest, written beside and renamed; the rename fails where another writer was first."""
        number = max(self.versions(), default=-1) + 1
        own = self._path(f"{self.path}/manifest/.{uuid.uuid4().hex}")
        out = self._fs.create(own, False)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        if not self._fs.rename(own, self._path(f"{self.path}/manifest/{number:012d}.json")):
            raise RuntimeError(f"another writer has made version {number}")
        self.forget(self.versions()[: -self.kept])

    def forget(self, versions: list[int]) -> None:
        """Delete old manifests, and data that none of the others names."""
        if not versions:
            return
        old = {x["version"] for v in versions for x in self.manifest(v)["months"].values()}
        used = {x["version"] for v in self.versions() if v not in versions for x in self.manifest(v)["months"].values()}
        for v in versions:
            self._fs.delete(self._path(f"{self.path}/manifest/{v:012d}.json"), False)
        for version in old - used:
            self._fs.delete(self._path(f"{self.path}/data/{version}"), True)


def upsert_stream(batches: DataFrame, archive: Archive, checkpoint: str, order: Column | None = None) -> StreamingQuery:
    """Payloads that keep landing go into their months; a batch that runs again after a failure is written once."""
    return batches.writeStream.foreachBatch(lambda batch, number: archive.upsert(batch, order, number)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
