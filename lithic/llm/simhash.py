"""SimHash near-duplicate detection over a Gray-order hierarchical index.

A document's 64-bit fingerprint is the bitwise majority of the XXH64 of its word shingles. Fingerprints that differ
in at most ``bits`` bits are linked, and linked fingerprints form a component.

Links are found without comparing all pairs. Two fingerprints that differ in at most three bits agree on one of any
four disjoint blocks of bits, so each distinct fingerprint is dealt out under its four 16-bit blocks; a block value
that too many share is dealt out again by four blocks of the bits left, until groups are small or few bits are left
(a group then holds at most 2^left distinct fingerprints). Within a group, fingerprints are sorted by Gray rank, so
that neighbours share most bits; runs of them become nodes, each holding the bit pattern that all below it share and
its parent doesn't; runs of nodes become upper nodes. A search walks down from the root and adds up the differing bits
of each node's pattern; when they exceed the limit, the whole node is dropped. What a group yields is a spanning
forest of its links, not its pairs, and components come from these forests.

Cases: null and empty texts have the fingerprint zero, linked like any other; texts shorter than a shingle are one
shingle; equal fingerprints are one node; a null doc_id is never a component's name unless no other is there. Repeated
rows, also those of one id, are each returned, and meet as one node; a component takes its least id, so ties don't arise.
Very long texts are hashed whole, a part at a time; an empty table gives an empty one; other columns of the documents
keep their names inside ``row``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lithic.llm.common import annotate, batch_conf, save, spread, table
from lithic.llm.graph import components, forest

SHINGLE, BITS, SEED = 3, 3, 42
#: Rows of a group above which it is dealt out by further bits.
GROUP = 1000
FANOUT = 8
_CHUNK = 1 << 15

METRICS = T.StructType([T.StructField("fp", T.LongType()), T.StructField("n_words", T.LongType())])


def shingle_hashes(words: list[bytes], shingle: int, seed: int) -> np.ndarray:
    """The XXH64 of each word shingle; of all words if they are no more than a shingle."""
    n, digest = len(words), xxhash.xxh64_intdigest
    if n <= shingle:
        return np.array([digest(b" ".join(words), seed)] if n else [], "<u8")
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[: n - shingle + 1].tolist()
    return np.fromiter((digest(joined[s:e], seed) for s, e in zip(starts, ends[shingle - 1 :].tolist(), strict=True)), "<u8", n - shingle + 1)


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in over half the hashes."""
    counts = np.zeros(64, np.int64)
    for i in range(0, len(hashes), _CHUNK):
        counts += np.unpackbits(hashes[i : i + _CHUNK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits((2 * counts > len(hashes)).astype(np.uint8), bitorder="little").view("<u8")[0])


def fingerprint(text: bytes | None, shingle: int = SHINGLE, seed: int = SEED) -> tuple[int, int]:
    """(fingerprint, number of words)."""
    words = text.lower().split() if text else []
    n = len(words)
    if not n:
        return 0, 0
    if n <= shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), seed), n
    return majority(shingle_hashes(words, shingle, seed)), n


def fingerprints(docs: DataFrame, text: str = "text", shingle: int = SHINGLE, seed: int = SEED, keep: list[str] | None = None) -> DataFrame:
    """docs as column ``row``, and ``m``: fp (the fingerprint's 64 bits as a long), n_words."""

    def each(texts):
        got = [fingerprint(t, shingle, seed) for t in texts]
        return [fp - (1 << 64) if fp >> 63 else fp for fp, _ in got], [n for _, n in got]

    return annotate(docs, text, each, METRICS, keep)


def gray_rank(x: np.ndarray) -> np.ndarray:
    """The place of x in the Gray order."""
    for s in (1, 2, 4, 8, 16, 32):
        x = x ^ (x >> np.uint64(s))
    return x


class GrayIndex:
    """The hierarchical index of many groups at once: one root a group; levels run from roots to single codes."""

    def __init__(self, codes: np.ndarray, group: np.ndarray, fanout: int = FANOUT):
        """codes: distinct within a group; both sorted by group, then Gray rank."""
        one = np.uint64(0xFFFFFFFFFFFFFFFF)
        full, value = np.full(len(codes), one), codes.copy()  # the bits that all codes of a node share, and their values
        of, levels = group, []
        first = last = np.arange(len(codes))
        while True:
            levels.append({"mask": full, "value": value, "group": of, "last": last})
            starts = np.flatnonzero(np.concatenate(([True], of[1:] != of[:-1])))
            if len(starts) == len(of):
                break
            place = np.arange(len(of)) - np.repeat(starts, np.diff(np.append(starts, len(of))))
            cut = np.flatnonzero(place % fanout == 0)
            ones, zeros = np.bitwise_and.reduceat(value & full, cut), np.bitwise_and.reduceat(~value & full, cut)
            levels[-1]["cut"] = cut
            full, value, of, last = ones | zeros, ones, of[cut], np.maximum.reduceat(last, cut)
        for up, down in zip(levels[:0:-1], levels[-2::-1], strict=True):  # factor a parent's pattern out of its children
            counts = np.diff(np.append(down["cut"], len(down["mask"])))
            down["own"] = down["mask"] & ~np.repeat(up["mask"], counts)
        levels[-1]["own"] = levels[-1]["mask"]
        self.codes, self.levels, self.first = codes, levels, first

    def links(self, bits: int, chunk: int = 4096):
        """Pairs (i, j), i < j, of codes of one group that differ in at most ``bits`` bits, some at a time."""
        top = self.levels[-1]
        root_of = np.searchsorted(top["group"], self.levels[0]["group"])
        at, n = 0, len(self.codes)
        while at < n:
            q = np.arange(at, min(n, at + chunk))
            at += chunk
            node, acc = root_of[q], np.zeros(len(q), np.int64)
            for depth in range(len(self.levels) - 1, -1, -1):
                level = self.levels[depth]
                acc = acc + np.bitwise_count((self.codes[q] ^ level["value"][node]) & level["own"][node])
                keep = (acc <= bits) & (level["last"][node] > q)
                q, node, acc = q[keep], node[keep], acc[keep]
                if depth:
                    below = self.levels[depth - 1]
                    cut = below["cut"]
                    size = np.diff(np.append(cut, len(below["mask"])))[node]
                    q, acc, start = np.repeat(q, size), np.repeat(acc, size), np.repeat(cut[node], size)
                    node = start + np.arange(len(start)) - np.repeat(np.cumsum(size) - size, size)
            yield q, node


def _forests(bits: int, fanout: int):
    def links(codes, group):
        """Forest edges of the groups in one batch of rows sorted by group."""
        order = np.lexsort((gray_rank(codes), group))
        codes, group = codes[order], group[order]
        root = forest(len(codes), GrayIndex(codes, group, fanout).links(bits))
        linked = np.flatnonzero(root != np.arange(len(root)))
        return pa.RecordBatch.from_arrays([pa.array(codes[linked].view(np.int64)), pa.array(codes[root[linked]].view(np.int64))], ["a", "b"])

    def run(batches):
        """Rows come sorted by (mask, val); a group goes on over batches, so the last one waits for the next batch."""
        held = None
        for b in batches:
            now = np.stack([b.column(i).to_numpy(zero_copy_only=False) for i in range(3)])
            if held is not None:
                now = np.concatenate([held, now], axis=1)
            new = np.concatenate(([True], np.any(now[1:, 1:] != now[1:, :-1], axis=0))) if now.shape[1] else np.zeros(0, bool)
            if not len(new):
                continue
            last = np.flatnonzero(new)[-1]
            if last:
                yield links(now[0, :last].view(np.uint64), np.cumsum(new[:last]))
            held = now[:, last:].copy()
        if held is not None and held.shape[1] > 1:
            yield links(np.ascontiguousarray(held[0]).view(np.uint64), np.zeros(held.shape[1], np.int64))

    return run


def _blocks(mask: int) -> list[int]:
    """Four masks that each add a quarter of the bits outside mask to it."""
    left = [i for i in range(64) if not mask >> i & 1]
    cuts = [round(len(left) * k / 4) for k in range(5)]
    return [mask | sum(1 << i for i in left[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprint_links(codes: DataFrame, bits: int = BITS, group: int = GROUP, fanout: int = FANOUT, depth: int = 5) -> DataFrame:
    """codes: (fp long), distinct. Returns (a, b): a spanning forest of the links within each group."""
    if bits != 3:
        raise ValueError("four blocks are dealt out, which is right for 3 bits")
    spark, masks, small = codes.sparkSession, [0], []
    now = codes.select("fp", F.lit(0).cast("long").alias("mask"))
    for level in range(depth):
        table_ = {m: _blocks(m) for m in masks}
        masks = sorted({x for v in table_.values() for x in v})
        pick = F.create_map(*[F.lit(x) for m, v in table_.items() for x in (F.lit(_signed(m)), F.array(*[F.lit(_signed(y)) for y in v]))])
        now = now.select("fp", F.explode(F.element_at(pick, F.col("mask"))).alias("mask")).withColumn("val", F.col("fp").bitwiseAND(F.col("mask")))
        sizes = now.groupBy("mask", "val").agg(F.count("*").alias("n")).where("n > 1")
        now = save(now.join(sizes, ["mask", "val"]))  # a code alone in its group has no links there
        small.append(now.where(F.col("n") <= group if level < depth - 1 else F.lit(True)).select("fp", "mask", "val"))
        now = now.where(F.col("n") > group).select("fp", "mask")
        if now.limit(1).count() == 0:
            break
    rows = small[0]
    for more in small[1:]:
        rows = rows.union(more)
    batch_conf(spark)
    dealt = rows.repartition(spread(rows.count(), 200_000, spark), "mask", "val").sortWithinPartitions("mask", "val")
    return dealt.mapInArrow(_forests(bits, fanout), "a long, b long").distinct()


def near_duplicates(prints: DataFrame, id_col: str = "doc_id", bits: int = BITS, group: int = GROUP) -> DataFrame:
    """prints: (fp, id). Returns (fp, root, first_id): each distinct fingerprint's component and its least id."""
    firsts = save(prints.groupBy("fp").agg(F.min(id_col).alias("first_id")))
    roots = components(fingerprint_links(firsts.select("fp"), bits, group))
    named = firsts.join(roots.select(F.col("a").alias("fp"), F.col("b").alias("root")), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = named.groupBy("root").agg(F.min("first_id").alias("component_id"))
    return named.join(least, "root").select("fp", "root", "component_id")


def op9_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = fingerprints(table(spark, sf_dir, "documents").select("doc_id", "text"), keep=["doc_id"])
    prints = save(docs.select("row.doc_id", "m.fp"))
    found = near_duplicates(prints)
    return prints.join(found, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")

