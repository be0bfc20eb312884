"""Confirmation tokens as a stream with timers: asked for, used once, refused, expired."""

from __future__ import annotations

import datetime as dt
import os

import pandas as pd

from lithic.streaming import feeds

START = dt.datetime(2024, 5, 1, 12)
KIND = "workspace string, ts timestamp, n_files long, token string"


def at(minutes):
    return START + dt.timedelta(minutes=minutes)


def test_tokens(spark, tmp_path):
    token = lambda w, m: feeds.token_of("secret", w, pd.Timestamp(at(m)))
    batches = [
        [("big", at(0), 5000, None), ("small", at(0), 10, None), ("forger", at(1), 9000, "made up"), (None, at(1), 5000, None)],
        [("big", at(5), 5000, token("big", 0)), ("big", at(6), 5000, token("big", 0)), ("slow", at(6), 3000, None), ("twice", at(6), 2001, None), ("twice", at(8), 2001, None)],
        [("slow", at(17), 3000, token("slow", 6)), ("twice", at(17), 2001, token("twice", 6))],
        [("later", at(60), 1, None)],
        [("later", at(61), 1, None)],
    ]
    folder = tmp_path / "in"
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, KIND).coalesce(1).write.mode("append").parquet(str(folder))
        for p in sorted(folder.glob("*.parquet"), key=os.path.getmtime)[i:]:
            os.utime(p, (1_700_000_000 + i, 1_700_000_000 + i))
    stream = spark.readStream.schema(KIND).option("maxFilesPerTrigger", 1).parquet(str(folder))
    query = feeds.confirmations(stream, "secret", late="0 seconds").writeStream.format("memory").queryName("tokens").outputMode("append").option("checkpointLocation", str(tmp_path / "at")).trigger(availableNow=True).start()
    assert query.awaitTermination(150)
    got = sorted((r.workspace or "", r.ts, r.outcome, r.token) for r in spark.table("tokens").collect() if r.workspace != "later")
    assert got == sorted([
        ("big", at(0), "asked", token("big", 0)), ("small", at(0), "run", None), ("forger", at(1), "refused", None), ("", at(1), "refused", None),
        ("big", at(5), "run", token("big", 0)), ("big", at(6), "refused", None),  # a token is good once
        ("slow", at(6), "asked", token("slow", 6)), ("twice", at(6), "asked", token("twice", 6)), ("twice", at(8), "asked", token("twice", 6)),
        ("slow", at(17), "refused", None), ("twice", at(17), "run", token("twice", 6)),  # the one is over, the other was made longer
        ("slow", at(16), "expired", token("slow", 6)),
    ], key=lambda r: r)
