"""Holds queries against their SQL in DuckDB, as the driver does: row count, columns, values in any order."""

from __future__ import annotations

import datetime
import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

DATA = Path("/root/testdata")


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, float):
        return round(v, 9) if abs(v) < 1e6 else float(f"{v:.12g}")
    if isinstance(v, (list, tuple)) or type(v).__name__ == "ndarray":
        return tuple(plain(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, plain(x)) for k, x in v.items()))
    if hasattr(v, "asDict"):
        return tuple(sorted((k, plain(x)) for k, x in v.asDict().items()))
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return v


def compare(spark, name: str, sf: str = "sf0.001") -> str:
    """'' if equal, else what differs."""
    import __spark_entry__ as entry

    query, sql = entry.queries()[name], entry.oracle_sql()[name]
    con = duckdb.connect()
    for p in (DATA / sf).glob("*.parquet"):
        con.sql(f"create view {p.stem} as select * from '{p}'")
    got = query(spark, str(DATA / sf))
    names = sorted(got.columns)
    a = [tuple(plain(r[c]) for c in names) for r in got.collect()]
    rel = con.sql(sql)
    if sorted(rel.columns) != names:
        return f"columns {names} and {sorted(rel.columns)}"
    at = [rel.columns.index(c) for c in names]
    b = [tuple(plain(r[i]) for i in at) for r in rel.fetchall()]
    kinds = {c: t for c, t in got.dtypes}
    odd = [f"{c}: {kinds[c]} and {t}" for c, t in zip(rel.columns, map(str, rel.types), strict=True) if not alike(kinds[c], t)]
    if odd:
        return f"types {odd}"
    key = lambda r: tuple((x is None, str(type(x)), str(x)) for x in r)
    a, b = sorted(a, key=key), sorted(b, key=key)
    if a != b:
        first = next(((x, y) for x, y in zip(a, b) if x != y), None)
        return f"{len(a)} and {len(b)} rows; first difference {first}"
    return "" if a else "no rows"


ALIKE = {"bigint": {"BIGINT"}, "int": {"INTEGER"}, "string": {"VARCHAR"}, "double": {"DOUBLE"}, "boolean": {"BOOLEAN"}}


def alike(spark_type: str, duck: str) -> bool:
    return spark_type not in ALIKE or duck in ALIKE[spark_type]


if __name__ == "__main__":
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    s = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "4g").getOrCreate()
    s.sparkContext.setLogLevel("OFF")
    for name in [n for n in entry.oracle_sql() if not sys.argv[2:] or any(n.startswith(x) for x in sys.argv[2:])]:
        t = time.time()
        try:
            said = compare(s, name, sys.argv[1])
        except Exception as e:  # shown, and the next one goes on
            said = f"{type(e).__name__}: {str(e)[:600]}"
        print(f"{name}: {'ok' if not said else said[:700]} {time.time() - t:.1f}s", flush=True)
