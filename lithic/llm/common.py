"""Helpers that the training-data operators share."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
import weakref

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

_roots: dict[str, SparkSession] = {}
_saved: weakref.WeakKeyDictionary = weakref.WeakKeyDictionary()  # table -> its folder


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir. Only where that is unset and the session is local, as in tests, a
    temporary one: on a cluster other executors wouldn't see it."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = f"file://{os.path.join(tempfile.gettempdir(), f'lithic-{os.getuid()}')}"
    return found.rstrip("/")


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)
    except Exception:  # the session may have ended; files of a dead session are swept by the folder's owner
        pass


def save(df: DataFrame) -> DataFrame:
    """Writes df once to the shared folder and reads it back: lineage ends there, and any executor can read it."""
    spark = df.sparkSession
    base = shared_dir(spark)
    root = f"{base}/lithic-{spark.sparkContext.applicationId}"
    if root not in _roots:
        _roots[root] = spark
        atexit.register(_remove, spark, root)
    path = f"{root}/{uuid.uuid4().hex}"
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _saved[out] = path
    return out


def drop(*saved: DataFrame) -> None:
    """Removes tables that save() wrote and nothing will read again, and has Spark remove the shuffle files of plans that
    ended with them, which it does once the driver's collector has found their plans unused."""
    for df in saved:
        path = _saved.pop(df, None)
        if path:
            _remove(df.sparkSession, path)
    if saved:
        saved[0].sparkSession._jvm.System.gc()


def batch_conf(spark: SparkSession) -> None:
    """Bounds an Arrow batch by bytes as well as by rows, so that very long texts don't pile up in one batch. This is a
    setting of the session: plans read it when they run, which is after the operator has returned."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))


def annotate(df: DataFrame, text: str, fn, schema: T.StructType, keep: list[str] | None = None) -> DataFrame:
    """Runs fn over the texts of df, batch by batch, beside the rows they belong to.

    fn gets a list of the texts as UTF-8 bytes (None for null) and returns one list, or Arrow array, per field of schema.
    The result has two columns, ``row`` (df's own columns, or those named in keep) and ``m`` (schema), so that
    names of the two can't clash. No shuffle.
    """
    batch_conf(df.sparkSession)
    row = F.struct(*[F.col(f"`{c}`") for c in (keep if keep is not None else df.columns)]) if (keep is None or keep) else F.struct(F.lit(0).alias("_"))
    source = df.select(row.alias("row"), F.col(f"`{text}`").cast("binary").alias("text"))
    out = T.StructType([source.schema["row"], T.StructField("m", schema)])
    arrow = pa.struct([pa.field(f.name, to_arrow_type(f.dataType)) for f in schema.fields])
    names = [f.name for f in schema.fields]

    def run(batches):
        for b in batches:
            lists = fn(b.column(1).to_pylist())
            cols = [v.cast(arrow.field(i).type) if isinstance(v, pa.Array) else pa.array(v, type=arrow.field(i).type) for i, v in enumerate(lists)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.StructArray.from_arrays(cols, names)], ["row", "m"])

    return source.mapInArrow(run, out)


def spread(rows: float, per: int, spark: SparkSession) -> int:
    """A number of partitions for so many rows (or bytes), at ``per`` a partition."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(rows // per) + 1)
