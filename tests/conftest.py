import datetime as dt
import os
import sys

import pandas as pd
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", f"file://{tmp_path_factory.mktemp('shared')}")
        .config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse")))
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    return s


@pytest.fixture
def events(spark):
    """Builds an events table from a few fields of each record."""
    from cadenza.schema import RACE_EVENT

    def build(*records):
        rows = []
        for o, r in enumerate(records, 1):
            day = r.get("day")
            link = r.get("link", f"http://l/{o}")
            row = {
                "id": r.get("id", f"e{o}"), "title": r.get("title", "Some Race Here"), "event_date": dt.date.fromisoformat(day) if day else None, "start_time": r.get("time"),
                "location_text": r.get("place", "Somewhere"), "city": r.get("city", ""), "subdivision": r.get("sub", ""), "country": r.get("country", "BR"),
                "distances": [(float(k), None, None, None) if not isinstance(k, str) else (None, k, None, None) for k in r.get("km", [10])],
                "image_url": r.get("image"), "signup_open": r.get("open"), "signup_window": None,
                "listings": r.get("listings", [(r.get("source", f"s{o}"), link, [link], "signup")]), "miss_count": r.get("misses", 0), "first_seen_at": None, "updated_at": None,
                "label_tier": None, "is_major": False, "is_cancelled": r.get("cancelled", False), "ordinal": o,
            }
            rows.append(row)
        return spark.createDataFrame(rows, RACE_EVENT + ", ordinal long")

    return build


TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def same_as_sql():
    """Runs SQL in DuckDB over a folder of tables and compares rows, whatever their order."""
    import duckdb

    def check(frame, sql, sf_dir):
        con = duckdb.connect()
        for t in TABLES:
            if os.path.exists(f"{sf_dir}/{t}.parquet"):
                con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
        want = con.execute(sql).df()
        got = frame.toPandas()
        columns = sorted(want.columns)
        assert columns == sorted(got.columns)

        def rows(df):
            plain = lambda v: None if v is None or v is pd.NA or v != v else int(v) if isinstance(v, float) and v.is_integer() else round(float(v), 6) if isinstance(v, float) else v
            return sorted(str([plain(v.item() if hasattr(v, "item") else v) for v in r]) for r in df[columns].values.tolist())

        assert rows(got) == rows(want)

    return check
