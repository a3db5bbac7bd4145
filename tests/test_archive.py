"""Months are rewritten only where a batch touches them; readers see whole batches."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from cadenza.operators.archive import Archive, upsert_stream


def rows(spark, *some):
    return spark.createDataFrame([(i, None if d is None else dt.date.fromisoformat(d), v) for i, d, v in some], "id string, event_date date, v int")


def test_only_touched_months_are_written(spark, tmp_path):
    archive = Archive(spark, f"file://{tmp_path}/a")
    assert archive.read() is None
    archive.upsert(rows(spark, ("a", "2026-01-05", 1), ("b", "2026-01-02", 1), ("c", "2026-02-01", 1), ("d", None, 1)))
    files = lambda: {p: p.stat().st_mtime_ns for p in tmp_path.glob("a/data/*/event_month=*/*.parquet")}
    first = files()
    assert archive.upsert(rows(spark, ("a", "2026-01-09", 2), ("a", "2026-01-08", 3), ("e", "2026-03-01", 1)), F.col("v")) == ["2026-01", "2026-03"]
    read = lambda **x: sorted((r.id, str(r.event_date), r.v, r.event_month) for r in archive.read(**x).collect())
    assert read() == [("a", "2026-01-08", 3, "2026-01"), ("b", "2026-01-02", 1, "2026-01"), ("c", "2026-02-01", 1, "2026-02"), ("d", "None", 1, "undated"), ("e", "2026-03-01", 1, "2026-03")]
    assert read(version=0) == [("a", "2026-01-05", 1, "2026-01"), ("b", "2026-01-02", 1, "2026-01"), ("c", "2026-02-01", 1, "2026-02"), ("d", "None", 1, "undated")]
    assert all(files()[p] == t for p, t in first.items())
    assert read(months=["2026-03"]) == [("e", "2026-03-01", 1, "2026-03")]
    assert {m: x["rows"] for m, x in archive.manifest()["months"].items()} == {"2026-01": 2, "2026-02": 1, "2026-03": 1, "undated": 1}
    for v in range(4):  # old versions go, with data that nothing names any more
        archive.upsert(rows(spark, ("a", "2026-01-08", v)))
    assert len(archive.versions()) == 2 and len(read()) == 5
    assert len({p.parent.parent for p in files()}) == 4  # January twice, February and March


def test_writers_and_batches(spark, tmp_path):
    archive = Archive(spark, f"file://{tmp_path}/a")
    archive.upsert(rows(spark, ("a", "2026-01-05", 1)), batch=3)
    assert archive.upsert(rows(spark, ("z", "2026-01-05", 1)), batch=3) == []
    other = Archive(spark, f"file://{tmp_path}/a")
    versions = other.versions()
    archive.upsert(rows(spark, ("b", "2026-01-06", 1)))
    other.versions = lambda: versions  # it has looked before the other wrote
    with pytest.raises(RuntimeError):
        other._publish({"batch": None, "months": {}})
    assert [r.id for r in archive.read().sort("id").collect()] == ["a", "b"]
    archive.upsert(rows(spark).limit(0))
    assert archive.read().count() == 2


def test_stream_into_months(spark, tmp_path):
    (tmp_path / "in").mkdir()
    archive = Archive(spark, f"file://{tmp_path}/a")
    for n, month in enumerate(("01", "02", "01")):
        (tmp_path / f"in/{n}.json").write_text(json.dumps({"id": "x", "event_date": f"2026-{month}-01", "v": n}) + "\n")
        stream = spark.readStream.schema("id string, event_date date, v int").json(str(tmp_path / "in"))
        upsert_stream(stream, archive, str(tmp_path / "cp")).awaitTermination(60)
    assert sorted((r.event_month, r.v) for r in archive.read().collect()) == [("2026-01", 2), ("2026-02", 1)]
    assert archive.manifest()["batch"] == 2
