"""Running a query by name, with a record of how it went."""

from __future__ import annotations

import time
from collections.abc import Callable
from datetime import datetime, timezone
from typing import NamedTuple

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from lithic.plans import catalogue

USAGE = "ts string, tool string, success boolean, status string, error_code string, duration_ms long, metrics map<string, long>"


class Usage(NamedTuple):
    ts: str
    tool: str
    success: bool
    status: str
    error_code: str | None
    duration_ms: int
    metrics: dict[str, int]


def invoke(spark: SparkSession, name: str, sf_dir: str, write: Callable[[DataFrame], None], log: str | None = None) -> Usage:
    """Hands the named query's result to write, which runs it; rows are counted on the way, in the same job.

    An unknown name and a failing query give a record with the error's name. With log, the record is appended there.
    """
    began, ts, error, metrics = time.monotonic(), datetime.now(timezone.utc).isoformat(), None, {}
    try:
        seen = Observation()
        df = catalogue.queries()[name](spark, sf_dir)
        write(df.observe(seen, F.count(F.lit(1)).alias("rows")))
        metrics = {"rows": seen.get["rows"], "columns": len(df.columns)}
    except Exception as e:
        error = "UNKNOWN_TOOL" if isinstance(e, KeyError) and name not in catalogue.queries() else type(e).__name__
    record = Usage(ts, name, error is None, "error" if error else "ok", error, int(1000 * (time.monotonic() - began)), metrics)
    if log:
        spark.createDataFrame([record], USAGE).coalesce(1).write.mode("append").json(log)
    return record
