"""Change feeds and logs as streams: debounce, hourly usage, keyed guards, incremental sync.

Each function takes a streaming (or batch) DataFrame and returns one, so sinks and triggers are the caller's. Event
times are cast to timestamps, which watermarks ask for.
"""

from __future__ import annotations

import hmac
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState

EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def read_events(spark: SparkSession, folder: str) -> DataFrame:
    """A file stream over a folder of event Parquet files."""
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(folder)


def debounced(changes: DataFrame, gap: str = "300 milliseconds", late: str = "10 seconds", key: str = "workspace") -> DataFrame:
    """changes (ts, key, path): one row for each burst, with the paths that changed in it."""
    return changes.withWatermark("ts", late).groupBy(key, F.session_window("ts", gap).alias("burst")).agg(F.array_sort(F.collect_set("path")).alias("paths"), F.count("*").alias("n")).select(key, F.col("burst.start").alias("start"), F.col("burst.end").alias("end"), "paths", "n")


def hourly_usage(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """Calls by tool and hour; an extension, as tumbling windows with a watermark."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", "1 hour").alias("hour"), F.col("event_type").alias("tool")).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("hour.start").alias("hour"), "tool", "n", "total")


GUARD_SCHEMA = "session long, event_id long, outcome string"


def collision_guard(events: DataFrame) -> DataFrame:
    """Keyed state: what a session last read against what was last written; a logical clock is the event's number."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        read, written = state.get if state.exists else (-1, -1)
        rows = []
        for b in batches:
            for e in b.sort_values("event_id").itertuples():
                if e.event_type == "view":
                    read = e.event_id
                elif e.event_type == "purchase":
                    written = e.event_id
                else:
                    rows.append((key[0], e.event_id, "never_read" if read < 0 else "modified" if written > read else "up_to_date"))
        state.update((read, written))
        yield pd.DataFrame(rows, columns=["session", "event_id", "outcome"])

    return events.withColumnRenamed("user_id", "session").groupBy("session").applyInPandasWithState(step, GUARD_SCHEMA, "read long, written long", "append", "NoTimeout")


def sync(write: Callable[[DataFrame], None], base: Callable[[], DataFrame], key: str = "path") -> Callable[[DataFrame, int], None]:
    """For foreachBatch: the next snapshot is the base without the changed paths, and the changed rows that still
    exist. A batch that is run again gives the same snapshot."""

    def batch(changes: DataFrame, _: int) -> None:
        last = changes.withColumn("_n", F.row_number().over(_latest(key))).where("_n = 1").drop("_n")
        kept = base().join(last.select(key), key, "left_anti")
        write(kept.unionByName(last.where("not deleted").select(*kept.columns)))

    return batch


def _latest(key: str):
    from pyspark.sql import Window

    return Window.partitionBy(key).orderBy(F.desc("ts"))


#: Files from which on a job is to be confirmed, and how long its token is good for.
THRESHOLD, GOOD_FOR = 2000, "10 minutes"
CONFIRMATION_SCHEMA = "workspace string, ts timestamp, outcome string, token string"


def token_of(secret: str, workspace: str, asked: pd.Timestamp) -> str:
    """A token that only who holds the secret can name; the same for a request that is run again."""
    return hmac.new(secret.encode(), f"{workspace}\0{asked.value}".encode(), "sha256").hexdigest()[:32]


def confirmations(requests: DataFrame, secret: str, threshold: int = THRESHOLD, good_for: str = GOOD_FOR, late: str = "1 minute") -> DataFrame:
    """requests (workspace, ts, n_files, token): a job of more than threshold files is run only with the token that an
    earlier request was given, once, while it is good. (workspace, ts, outcome, token): run, asked (with its token; while one
    is good, another request gets the same, and longer), refused, or, by a timer, expired.

    A workspace's state is its token and its time; a timer takes it away once the watermark has passed it, so that what is
    held is as many tokens as were asked for within that time. Requests without a workspace or a time are refused.
    """
    lasts = pd.Timedelta(good_for)

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        token, until, rows = None, None, []
        if state.exists:
            token, until = state.get[0], pd.Timestamp(state.get[1], unit="us")
        if state.hasTimedOut:
            rows.append((key[0], until, "expired", token))
            token = None
        asked = pd.concat(list(batches), ignore_index=True) if not state.hasTimedOut else pd.DataFrame(columns=["ts"])
        for r in asked.sort_values("ts", kind="stable").itertuples():
            good = token is not None and r.ts <= until
            if key[0] is None or pd.isna(r.ts):
                rows.append((key[0], None if pd.isna(r.ts) else r.ts, "refused", None))
            elif pd.isna(r.n_files) or r.n_files <= threshold:
                rows.append((key[0], r.ts, "run", None))
            elif r.token is None or pd.isna(r.token):
                token, until = token if good else token_of(secret, key[0], r.ts), r.ts + lasts
                rows.append((key[0], r.ts, "asked", token))
            elif good and hmac.compare_digest(r.token, token):
                rows.append((key[0], r.ts, "run", token))
                token = None
            else:
                rows.append((key[0], r.ts, "refused", None))
        now = pd.Timestamp(max(state.getCurrentWatermarkMs(), 0), unit="ms")
        if token is not None and until > now:
            state.update((token, until.value // 1000))
            state.setTimeoutTimestamp(max(until.value // 1_000_000, int(now.value // 1_000_000) + 1))
        elif state.exists:
            if token is not None and not state.hasTimedOut:
                rows.append((key[0], until, "expired", token))
            state.remove()
        elif token is not None:
            rows.append((key[0], until, "expired", token))
        yield pd.DataFrame(rows, columns=["workspace", "ts", "outcome", "token"])

    return requests.withWatermark("ts", late).groupBy("workspace").applyInPandasWithState(step, CONFIRMATION_SCHEMA, "token string, until long", "append", "EventTimeTimeout")
