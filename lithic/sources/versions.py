"""A store of file versions: staged, committed and undone as whole transactions, by many writers at once.

A transaction stages what it does to files as a table of its own: each path with its content before and after and their
hashes. Nothing else sees it until it is committed, by making the next entry of the log, which can be made only once: of
writers that commit upon one version one wins, and the others hear of it. What a file holds is what its last committed
transaction left, so data is only ever added: an undo is a transaction that puts back what stood before.

What a writer that died has left is told by three hashes, of what stood before, what was to stand and what stands: a path
is untouched, done or in conflict; a transaction with no conflict may be committed again.

Cases: a null content means that the file isn't there; a path that is named twice in one transaction is refused; a
transaction of no paths is one; a store without a log is at version 0 and empty.
"""

from __future__ import annotations

import json
import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "path string, before string, before_hash string, after string, after_hash string"


class Conflict(Exception):
    """Another writer was there first, or a file isn't what it was."""


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        path = spark._jvm.org.apache.hadoop.fs.Path
        self._path = path
        self._fs = path(self.root).getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
        self._fs.mkdirs(path(f"{self.root}/_log"))

    def _read(self, path: str) -> dict:
        stream = self._fs.open(self._path(path))
        try:
            return json.loads(bytes(stream.readAllBytes()))
        finally:
            stream.close()

    def log(self) -> list[dict]:
        """The committed transactions in order: version, txn, action, n_paths. A row for each."""
        names = [s.getPath().getName() for s in self._fs.listStatus(self._path(f"{self.root}/_log"))]
        return [self._read(f"{self.root}/_log/{n}") for n in sorted(n for n in names if n.endswith(".json") and n[0] != ".")]

    def version(self) -> int:
        return max((e["version"] for e in self.log()), default=0)

    def files(self, version: int | None = None) -> DataFrame:
        """(path, content, hash, version): every file that is there at a version, or now."""
        entries = [e for e in self.log() if version is None or e["version"] <= version]
        if not entries:
            return self.spark.createDataFrame([], "path string, content string, hash string, version long")
        at = self.spark.createDataFrame([(e["txn"], e["version"]) for e in entries], "txn string, version long")
        rows = self.spark.read.schema(f"{SCHEMA}, txn string").parquet(f"{self.root}/data").join(F.broadcast(at), "txn")  # a row for each commit
        last = rows.groupBy("path").agg(F.max(F.struct("version", "after", "after_hash")).alias("x"))
        return last.where("x.after_hash is not null").select("path", F.col("x.after").alias("content"), F.col("x.after_hash").alias("hash"), F.col("x.version").alias("version"))

    def stage(self, changes: DataFrame, expect: DataFrame | None = None) -> str:
        """changes (path, content; null: the file goes). Returns the transaction's name. expect (path, hash): what files
        must hold; a file that doesn't is a conflict."""
        if changes.groupBy("path").count().where("count > 1").limit(1).count():
            raise ValueError("a path is named twice")
        now = self.files().select("path", F.col("content").alias("before"), F.col("hash").alias("before_hash"))
        met = changes.select("path", F.col("content").alias("after")).join(now, "path", "left")
        if expect is not None and not met.join(expect, "path").where(~F.col("before_hash").eqNullSafe(F.col("hash"))).isEmpty():
            raise Conflict("a file isn't what was expected")
        txn = uuid.uuid4().hex
        met.select("path", "before", "before_hash", "after", F.sha2(F.col("after"), 256).alias("after_hash")).write.parquet(f"{self.root}/data/txn={txn}")
        return txn

    def staged(self, txn: str) -> DataFrame:
        return self.spark.read.schema(SCHEMA).parquet(f"{self.root}/data/txn={txn}")

    def commit(self, txn: str, expected: int, action: str = "apply") -> int:
        """Makes version expected + 1 of a staged transaction, unless another writer has."""
        entry = {"version": expected + 1, "txn": txn, "action": action, "n_paths": self.staged(txn).count()}
        if self.version() != expected or not self._create(f"{self.root}/_log/{expected + 1:020d}.json", json.dumps(entry)):
            raise Conflict(f"version {expected + 1} is another writer's")
        return expected + 1

    def _create(self, path: str, text: str) -> bool:
        """Makes a whole file under a name that nothing has; False if something has it."""
        part = f"{os.path.dirname(path)}/.{uuid.uuid4().hex}"
        stream = self._fs.create(self._path(part), False)
        stream.write(bytearray(text.encode()))
        stream.close()
        try:
            if self._fs.getScheme() == "file":  # a rename would replace; a link is made once
                local = lambda p: self._path(p).toUri().getPath()
                os.link(local(part), local(path))
                return True
            context = self.spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri())
            context.rename(self._path(part), self._path(path), self.spark.sparkContext._gateway.new_array(self.spark._jvm.org.apache.hadoop.fs.Options.Rename, 0))
            return True
        except FileExistsError:
            return False
        except Exception as e:
            if "AlreadyExists" in str(e):
                return False
            raise
        finally:
            if self._fs.exists(self._path(part)):
                self._fs.delete(self._path(part), False)

    def write(self, changes: DataFrame, expect: DataFrame | None = None) -> int:
        """Stages and commits upon the version of now."""
        at = self.version()
        return self.commit(self.stage(changes, expect), at)

    def undo(self, version: int | None = None) -> int:
        """A new version that puts back what stood before a version, the last if none is named. Files that were written
        since are a conflict."""
        entries = {e["version"]: e for e in self.log()}
        at = max(entries, default=0)
        version = at if version is None else version
        if version not in entries:
            raise LookupError(f"there is no version {version}")
        done = self.staged(entries[version]["txn"])
        back = self.stage(done.select("path", F.col("before").alias("content")), done.select("path", F.col("after_hash").alias("hash")))
        return self.commit(back, at, "undo")

    def pending(self) -> list[str]:
        """Transactions that were staged and not committed."""
        there = [s.getPath().getName() for s in self._fs.listStatus(self._path(f"{self.root}/data"))] if self._fs.exists(self._path(f"{self.root}/data")) else []
        return sorted({n.removeprefix("txn=") for n in there if n.startswith("txn=")} - {e["txn"] for e in self.log()})

    def whole(self, txn: str) -> bool:
        """Whether a transaction's table was written to its end."""
        return self._fs.exists(self._path(f"{self.root}/data/txn={txn}/_SUCCESS"))

    def judge(self, txn: str) -> DataFrame:
        """(path, state) of a transaction against what stands: untouched, done or conflict."""
        now = self.files().select("path", "hash")
        same = lambda c: F.col(c).eqNullSafe(F.col("hash"))
        state = F.when(same("after_hash"), "done").when(same("before_hash"), "untouched").otherwise("conflict")
        return self.staged(txn).join(now, "path", "left").select("path", state.alias("state"))

    def recover(self) -> dict[str, str]:
        """Ends what dead writers left: transaction -> committed, done, conflict or torn (its table isn't whole). Of those
        in conflict, and the torn, nothing was ever visible."""
        out = {}
        for txn in self.pending():
            if not self.whole(txn):
                out[txn] = "torn"
                continue
            states = {r.state for r in self.judge(txn).select("state").distinct().collect()}
            if "conflict" in states:
                out[txn] = "conflict"
            elif states <= {"done"}:
                out[txn] = "done"
            else:
                self.commit(txn, self.version(), "recover")
                out[txn] = "committed"
        return out
