"""Places of rows under their keys, where one key may hold a large share of all rows.

Cases: keys are never null (callers encode them); null order values come first, ties are numbered in an order that is
fixed once the table is written; an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lithic.llm.common import drop, save, spread

#: Rows of a range.
RANGE = 100_000


def ranked(df: DataFrame, key: str, order: list[str], per: int = RANGE) -> DataFrame:
    """df with ``idx``, a row's place from 0 among those of its key, and ``n``, how many the key has.

    The rows are dealt by ranges of (key, order), so that a large key is cut like any other run of rows; what is then
    summed per key is a row for each of its ranges. df is read twice, once for a sample of its ranges: give a written one.
    """
    spark = df.sparkSession
    by = [F.col(c).asc_nulls_first() for c in (key, *order)]
    dealt = df.repartitionByRange(spread(df.count(), per, spark), *by).sortWithinPartitions(*by)
    placed = save(dealt.select("*", F.spark_partition_id().alias("_range"), F.monotonically_increasing_id().alias("_at")))
    parts = placed.groupBy(key, "_range").agg(F.min("_at").alias("_first"), F.count("*").alias("_rows"))
    before = Window.partitionBy(key).orderBy("_range")
    starts = parts.select(key, "_range", (F.sum("_rows").over(before) - F.col("_rows") - F.col("_first")).alias("_shift"), F.sum("_rows").over(Window.partitionBy(key)).alias("n"))
    out = save(placed.join(starts, [key, "_range"]).select(*df.columns, (F.col("_at") + F.col("_shift")).alias("idx"), "n"))
    drop(placed)
    return out


def run_starts(columns: list[list]) -> list[int]:
    """Where the rows of sorted key columns begin a new run, and the end."""
    rows = list(zip(*columns, strict=True))
    return [0, *(i for i in range(1, len(rows)) if rows[i] != rows[i - 1]), len(rows)] if rows else [0]


def groups(batches, keys: int):
    """The rows of sorted batches as lists of columns, one for each run of equal leading ``keys`` columns; a run may go on
    over batches, and one run is held at a time."""
    held: list[list] | None = None
    for b in batches:
        now = [c.to_pylist() for c in b.columns]
        if held is not None:
            now = [x + y for x, y in zip(held, now, strict=True)]
        cuts = run_starts(now[:keys])
        if len(cuts) < 2:
            continue
        for s, e in zip(cuts[:-2], cuts[1:-1], strict=True):
            yield [c[s:e] for c in now]
        held = [c[cuts[-2] :] for c in now]
    if held and held[0]:
        yield held
