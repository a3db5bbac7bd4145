"""Named queries over the driver tables, and the SQL that each is checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from cadenza.plans import entities, events, landing, records, wording

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {**events.QUERIES, **entities.QUERIES, **records.QUERIES, **wording.QUERIES, **landing.QUERIES}
ORACLE_SQL: dict[str, str] = {**events.SQL, **entities.SQL, **records.SQL, **wording.SQL, **landing.SQL}
