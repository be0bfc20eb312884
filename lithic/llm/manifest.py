"""A Merkle manifest of a dataset, with an authentication path for every row.

A row is a leaf; the leaves of a source, by id, form a tree of runs of three; the sources' roots form another one above
them. Trees are built in aligned blocks of 3^height nodes, so that no source is ever one group: a block's nodes give its
root by a treehash stack, the blocks' roots are the nodes of the next round, and rounds end when each source has one.
Paths come back down the rounds. Within a block the schedule of Merkle traversal goes from leaf to leaf: for each level
it keeps the siblings of the current node and one treehash stack at work on those of the next run, which gets one leaf
a step and is done when they are needed; finished nodes are siblings of those that follow. So a block's paths take
memory that grows as the logarithm of its leaves. The path above a block is the same for all its leaves and is appended.

Texts are read once, to make leaves; what is shuffled are ids and digests.

Cases: a null value is written ``-``, an empty one has 0 bytes; null doc_ids come first, are leaves like any other and
aren't tampered with; a null source is a source of its own and comes first, before an empty one; rows with one doc_id
are ordered by their leaves, and repeated rows are leaves of their own, with the paths of their places. Very long texts
are hashed whole. An empty table gives an empty one. Further columns aren't part of a leaf, whatever they are called.
"""

from __future__ import annotations

from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lithic.llm.common import batch_conf, save, spread, table
from lithic.llm.order import RANGE, groups, ranked

ARITY, HEIGHT = 3, 8
#: The columns of a leaf, in order.
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(parts: list[str]) -> str:
    return sha256("".join(parts).encode()).hexdigest()


class Treehash:
    """Makes one node of a level out of its leaves, taken one at a time; holds fewer than ARITY nodes of each level."""

    def __init__(self, leaves: list[str], level: int, index: int):
        size = ARITY**level
        self.leaves, self.level = leaves, level
        self.at, self.end = index * size, min((index + 1) * size, len(leaves))
        self.open: list[list[str]] = [[] for _ in range(level + 1)]

    def step(self) -> str | None:
        """Takes a leaf. The node, once that was the last one."""
        self.open[0].append(self.leaves[self.at])
        self.at += 1
        last = self.at == self.end
        for low, high in zip(self.open, self.open[1:], strict=False):
            if len(low) == ARITY or last and low:
                high.append(digest(low))
                low.clear()
            elif not last:
                return None
        return self.open[-1][0] if last else None


def levels_of(n: int, height: int) -> int:
    """Levels between the nodes of a tree, or of a block in it, and the node above them: the least that holds n, or height."""
    level = 0
    while level < height and ARITY**level < n:
        level += 1
    return level


class Traversal:
    """The authentication paths of a block's leaves, in order."""

    def __init__(self, leaves: list[str], levels: int):
        self.leaves, self.levels = leaves, levels
        self.siblings = [self._run(level, 0, None) for level in range(levels)]  # node -> digest, without the current node
        self.work = [self._start(level, 1) for level in range(levels)]

    def _nodes(self, level: int, run: int) -> list[int]:
        """The nodes of a run but its first, as far as there are leaves."""
        return [i for i in range(run * ARITY + 1, (run + 1) * ARITY) if i * ARITY**level < len(self.leaves)]

    def _run(self, level: int, run: int, state) -> dict[int, str]:
        state = state or self._start(level, run)
        while state["todo"]:
            self._step(level, state)
        return state["done"]

    def _start(self, level: int, run: int) -> dict:
        return {"todo": self._nodes(level, run), "done": {}, "stack": None}

    def _step(self, level: int, state: dict) -> None:
        if state["todo"]:
            state["stack"] = state["stack"] or Treehash(self.leaves, level, state["todo"][0])
            if node := state["stack"].step():
                state["done"][state["todo"].pop(0)] = node
                state["stack"] = None

    def __iter__(self):
        """Per leaf, the texts before and after the current node at each level, from below."""
        n = len(self.leaves)
        for i in range(n):
            path, at = [], i
            for level in range(self.levels):
                run = sorted(self.siblings[level].items())
                path += ["".join(d for j, d in run if j < at), "".join(d for j, d in run if j > at)]
                at //= ARITY
            yield path
            if i + 1 < n:
                self._advance(i)

    def _advance(self, i: int) -> None:
        for level in range(self.levels):
            self._step(level, self.work[level])
        value, at = self.leaves[i], i
        for level in range(self.levels):
            here = self.siblings[level]
            if (at + 1) % ARITY:  # the run goes on: what was left is a sibling, what is entered isn't
                here[at] = value
                here.pop(at + 1)
                return
            run = at // ARITY
            value = digest([*(d for _, d in sorted(here.items())), value])
            self.siblings[level] = self._run(level, run + 1, self.work[level])
            self.work[level] = self._start(level, run + 2)
            at = run
            if (i + 1) % ARITY ** (level + 1):
                return


def fold(value: str, path: list[str]) -> str:
    for before, after in zip(path[::2], path[1::2], strict=True):
        value = sha256(f"{before}{value}{after}".encode()).hexdigest()
    return value


def _dealt(nodes: DataFrame, block: int, per: int) -> DataFrame:
    """nodes (key, idx, ...) with a whole block in one partition, in order; rows with idx below 0 name their block."""
    spark = nodes.sparkSession
    batch_conf(spark)
    found = nodes.withColumn("block", F.when(F.col("idx") < 0, -F.col("idx") - 1).otherwise(F.floor(F.col("idx") / block)))
    return found.repartition(spread(nodes.count(), per, spark), "key", "block").sortWithinPartitions("key", "block", "idx")


def _roots(nodes: DataFrame, height: int, per: int) -> DataFrame:
    """The blocks' roots as nodes of the next round: (key, idx, n, hash)."""
    block = ARITY**height

    def run(batches):
        for keys, blocks, n, hashes in groups(batches, 2):
            levels = levels_of(n[0], height)
            stack, node = Treehash(hashes, levels, 0), None
            while node is None:
                node = stack.step()
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in (([keys[0]], pa.string()), ([blocks[0]], pa.int64()), ([-(-n[0] // block)], pa.int64()), ([node], pa.string()))], ["key", "idx", "n", "hash"])

    return _dealt(nodes.select("key", "idx", "n", "hash"), block, per).select("key", "block", "n", "hash").mapInArrow(run, "key string, idx long, n long, hash string")


def _rounds(nodes: DataFrame, height: int, per: int) -> list[DataFrame]:
    """nodes, and the rounds above them until each key has one node."""
    out = [nodes]
    while out[-1].where("n > 1").limit(1).count():
        out.append(save(_roots(out[-1], height, per)))
    return out


def _with_above(nodes: DataFrame, above: DataFrame, block: int, per: int, extra: dict[str, str]) -> DataFrame:
    """The nodes of each block, dealt, behind a row that holds the path above it."""
    own = nodes.select("key", "idx", "n", "hash", *extra, F.lit(None).cast("array<string>").alias("path"))
    head = above.select("key", (-F.col("idx") - 1).alias("idx"), F.lit(None).cast("long").alias("n"), F.lit(None).cast("string").alias("hash"), *[F.lit(None).cast(t).alias(c) for c, t in extra.items()], "path")
    return _dealt(own.unionByName(head), block, per).select("key", "block", "idx", "n", "hash", *extra, "path")


def _down(rounds: list[DataFrame], above: DataFrame, height: int, per: int) -> DataFrame:
    """The paths of the nodes of rounds[0]: (key, idx, path), given those above the last round's."""

    def run(batches):
        for keys, _, idx, n, hashes, paths in groups(batches, 2):
            for i, path in zip(idx[1:], Traversal(hashes[1:], levels_of(n[1], height)), strict=True):
                yield pa.RecordBatch.from_arrays([pa.array([keys[0]]), pa.array([i], pa.int64()), pa.array([path + paths[0]], pa.list_(pa.string()))], ["key", "idx", "path"])

    for nodes in reversed(rounds[:-1]):
        above = save(_with_above(nodes, above, ARITY**height, per, {}).mapInArrow(run, "key string, idx long, path array<string>"))
    return above


def _leaf(values: dict[str, Column]) -> Column:
    parts = [F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-")) for v in values.values()]
    return F.sha2(F.concat(*parts), 256)


def leaves(docs: DataFrame) -> DataFrame:
    """(key, doc_id, hash, tampered): each row's leaf, and that of the row as it was tampered with. No shuffle."""
    values = {c: F.col(c).cast("string") for c in COLUMNS}
    whole = _leaf(values)
    cut = _leaf(values | {"text": F.replace(values["text"], F.lit("\n"), F.lit(""))})
    odd = (F.crc32(values["doc_id"].cast("binary")) % 2 == 0) & (F.instr(values["text"], "\n") > 0)
    key = F.coalesce(F.concat(F.lit("="), values["source"]), F.lit(""))  # as ordered as the source, null first
    return docs.select(key.alias("key"), "doc_id", whole.alias("hash"), F.when(odd, cut).otherwise(whole).alias("tampered"))


RESULT = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def manifest(docs: DataFrame, height: int = HEIGHT, per: int = RANGE) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified."""
    nodes = ranked(save(leaves(docs)), "key", ["doc_id", "hash"], per)
    rounds = _rounds(nodes.select("key", "idx", "n", "hash"), height, per)
    subroots = save(rounds[-1].select(F.lit("").alias("top"), "key", "hash"))
    sources = ranked(subroots, "top", ["key"], per)
    upper = _rounds(sources.select(F.col("top").alias("key"), "idx", "n", "hash"), height, per)
    head = upper[-1].first()
    if head is None:
        return docs.sparkSession.createDataFrame([], RESULT)
    root = head["hash"]
    top = upper[-1].select("key", "idx", F.array().cast("array<string>").alias("path"))
    of_sources = _down(upper, top, height, per).select("idx", "path").join(sources.select("idx", F.col("key").alias("source"), "hash"), "idx")
    # a source's path starts at its subroot, so that its leaves know it
    above = of_sources.select(F.col("source").alias("key"), F.lit(0).cast("long").alias("idx"), F.concat(F.array("hash"), "path").alias("path"))
    if len(rounds) > 2:
        below = save(above)
        shifted = below.select("key", "idx", F.slice("path", 2, F.size("path")).alias("path"))
        paths = _down(rounds[1:], shifted, height, per)
        above = paths.join(below.select("key", F.col("path")[0].alias("subroot")), "key").select("key", "idx", F.concat(F.array("subroot"), "path").alias("path"))
    elif len(rounds) == 1:  # every source is a single leaf
        pass
    above = save(above)

    def run(batches):
        for _, _, _, n, hashes, ids, tampered, paths in groups(batches, 2):
            subroot, *path = paths[0]
            out: list[tuple] = []
            for doc_id, leaf, other, below in zip(ids[1:], hashes[1:], tampered[1:], Traversal(hashes[1:], levels_of(n[1], height)), strict=True):
                whole = below + path
                folded = fold(other, whole)
                out.append((doc_id, leaf, subroot, root, digest(whole), folded, folded == root))
            kinds = [pa.int64(), *[pa.string()] * 5, pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], [c.split()[0] for c in RESULT.split(", ")])

    extra = {"doc_id": "long", "tampered": "string"}
    return _with_above(nodes, above, ARITY**height, per, extra).mapInArrow(run, RESULT)


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest(table(spark, sf_dir, "documents"))
