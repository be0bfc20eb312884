"""Near copies: SimHash over the Gray-order index, completed to all texts that are alike.

Two texts are linked if the sets of their five-word shingles have a Jaccard similarity of 4/5 or more; linked texts form
a component, of which one document stays.

Fingerprints of the five-word shingles are linked by lithic.llm.simhash first; the links of its forest are confirmed on
the texts' sets, and what they join needn't meet again. That joins large groups of close copies at once. But texts of a
similarity of 0.8 may differ in ten bits of 64, far beyond what an index of fingerprints can look up, so the other links
are found by prefixes, and no pair is lost: in any order of all shingles, two sets that are so alike share one of the
first n - ceil(4n/5) + 1 of each, so only these prefixes meet. The order puts shingles that are common in a sample of the
texts last, which costs no result and keeps common lines out of prefixes. Where a prefix's shingle is shared, how much
can still be shared behind it bounds the similarity. Sketches (a quarter of a set, as 16-bit numbers) then count shingles
that one text has and the other can't have; pairs with too many are dropped, and the others are confirmed on their whole
sets.

Large groups are not paired off. A few rows of each group meet the others, what they confirm is joined, and what then
belongs together needn't meet again; rows of the smaller components of a group go first, and of these the ones with the
fewest rarer shingles: a text that others are copies of has none of its own. A group ends when one component is left, so
a group of n near copies of a text costs n confirmations. Rows that have met all others are done.

Copies of one text that are no copies of each other meet in the same large groups, and are unlike by little. Rows of large
groups so have parities beside them: of the shingles with each of 512 remainders, whether there are evenly or oddly many.
Where the parities of two sets differ there is a shingle that only one of them has, so the sets differ by as many at
least; pairs that differ by too many are not made.

Cases: null and empty texts have no shingles and are alike; texts of at most five words are one shingle; equal sets are
one node; words are lower case. Repeated rows and rows that share an id are one node if their texts are equal, and else
decided by their texts. Very long texts are taken whole. An empty table stays empty; columns keep their names, whatever
they are.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lithic.llm.common import annotate, batch_conf, drop, save
from lithic.llm.graph import components
from lithic.llm.simhash import SEED, _signed, fingerprint_links, majority, shingle_hashes

SHINGLE = 5
#: One text in so many is counted for the order of shingles, and so many shingles at most are put last.
SAMPLE, COMMON = 32, 100_000
#: Parities of a set, in numbers of 64 bits; rows of a shingle from which on they stand beside them.
PARITIES, CROWD = 8, 32

METRICS = T.StructType([T.StructField("node", T.LongType()), T.StructField("n", T.LongType()), T.StructField("prefix", T.ArrayType(T.LongType())), T.StructField("sketch", T.ArrayType(T.ShortType())), T.StructField("fp", T.LongType()), T.StructField("bits", T.ArrayType(T.LongType()))])
SHINGLES = T.StructType([T.StructField("shingles", T.ArrayType(T.LongType()))])


def shingle_set(text: bytes | None, shingle: int = SHINGLE) -> np.ndarray:
    """The distinct hashes of a text's shingles, sorted."""
    return np.unique(shingle_hashes(text.lower().split() if text else [], shingle, SEED)).view(np.int64)


def _sets(docs: DataFrame, text: str, keep: list[str]) -> DataFrame:
    return annotate(docs, text, lambda texts: [[shingle_set(t) for t in texts]], SHINGLES, keep)


def parities(h: np.ndarray) -> np.ndarray:
    """Of the hashes with each remainder, whether there are oddly many: PARITIES numbers of 64 bits."""
    many = np.bincount((h >> 8) & (64 * PARITIES - 1), minlength=64 * PARITIES)
    return np.packbits((many & 1).astype(np.uint8)).view(np.int64)


def _common(docs: DataFrame, text: str) -> np.ndarray:
    """Shingles that are common in a sample of the texts, the most common one at the end."""
    some = _sets(docs.where(F.pmod(F.xxhash64(F.col(f"`{text}`")), F.lit(SAMPLE)) == 0), text, [])
    counted = some.select(F.explode("m.shingles").alias("h")).groupBy("h").agg(F.count("*").alias("c")).where("c > 3")
    return np.array([r.h for r in counted.orderBy(F.desc("c"), "h").limit(COMMON).collect()][::-1], np.int64)


def described(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs as column ``row``, and ``m``: a node for equal sets, the number of shingles, their prefix, sketch and parities."""
    common = _common(docs, text)
    order = np.argsort(common)
    known = common[order]

    def one(t):
        every = shingle_hashes(t.lower().split() if t else [], SHINGLE, SEED)
        h = np.unique(every).view(np.int64)
        n, digest, fp = len(h), xxhash.xxh64_intdigest(h.tobytes()) if len(h) else 0, majority(every)
        sketch = np.unique(h[h & 3 == 0].view(np.uint64) >> np.uint64(48)).astype(np.uint16).view(np.int16)
        bits = parities(h)
        if len(known) and n:
            at = np.minimum(np.searchsorted(known, h), len(known) - 1)
            last = known[at] == h
            if last.any():
                h = np.concatenate((h[~last], h[last][np.argsort(order[at[last]])]))
        return _signed(digest), n, h[: n - (4 * n + 4) // 5 + 1], sketch, _signed(fp), bits

    return annotate(docs, text, lambda texts: [list(c) for c in zip(*map(one, texts), strict=True)] or [[]] * 6, METRICS)


def _rows(batches):
    """A row for each shingle of a prefix; equal sets have them once in a partition."""
    seen: set[int] = set()
    for b in batches:
        cols: list[list[np.ndarray]] = [[] for _ in range(4)]
        for node, n, s in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
            if node in seen or not n:
                continue
            seen.add(node)
            h = s.values.to_numpy(zero_copy_only=False)
            for c, x in zip(cols, (h, np.full(len(h), node), np.full(len(h), n), np.arange(len(h))), strict=True):
                c.append(x)
        if cols[0]:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), pa.int64()) for c in cols], ["h", "node", "n", "pos"])


def _beside(pairs: DataFrame, of: DataFrame, name: str) -> DataFrame:
    """pairs with the column of both nodes, as name_a and name_b."""
    for side in "ab":
        pairs = pairs.join(of.select(F.col("node").alias(side), F.col(name).alias(f"{name}_{side}")), side)
    return pairs


def _confirmed(pairs: DataFrame, sketches: DataFrame, found: DataFrame, text: str) -> DataFrame:
    """The pairs (a, b) of nodes whose sets are alike. pairs: (a, b, na, nb)."""
    missed = lambda x, y: 9 * F.size(F.array_except(f"sketch_{x}", f"sketch_{y}")) <= 5 * F.col(f"n{x}") - 4 * F.col(f"n{y}")
    left = save(_beside(pairs, sketches, "sketch").where(missed("a", "b") & missed("b", "a")).select("a", "b"))
    # written first: few nodes are then sent to the texts, many are shuffled with them
    nodes = save(left.select(F.col("a").alias("node")).union(left.select(F.col("b").alias("node"))).distinct())
    texts = found.select(F.col("m.node").alias("node"), F.col(f"row.`{text}`").alias("text")).join(nodes, "node", "left_semi").groupBy("node").agg(F.first("text").alias("text"))
    sets = save(_sets(texts, "text", ["node"]).select("row.node", "m.shingles"))
    alike_ = 9 * F.size(F.array_intersect("shingles_a", "shingles_b")) >= 4 * (F.size("shingles_a") + F.size("shingles_b"))
    found_ = save(_beside(left, sets, "shingles").where(alike_).select("a", "b"))
    drop(left, nodes, sets)
    return found_


def _by_fingerprint(nodes: DataFrame) -> DataFrame:
    """nodes: (node, n, fp). Pairs (a, b, na, nb): each node and the least one with its fingerprint, and the least ones of
    fingerprints that the Gray-order index links."""
    firsts = save(nodes.groupBy("fp").agg(F.min(F.struct("node", "n")).alias("s")).select("fp", F.col("s.node").alias("node"), F.col("s.n").alias("n")))
    side = lambda k: firsts.select(F.col("fp").alias(k), F.struct("node", "n").alias(f"s{k}"))
    linked = fingerprint_links(firsts.select("fp")).join(side("a"), "a").join(side("b"), "b").select("sa", "sb")
    same = nodes.select("fp", F.struct("node", "n").alias("sa")).join(firsts.select("fp", F.struct("node", "n").alias("sb")), "fp").where("sa.node <> sb.node").select("sa", "sb")
    low, high = F.least("sa", "sb"), F.greatest("sa", "sb")
    return save(linked.union(same).select(low["node"].alias("a"), high["node"].alias("b"), low["n"].alias("na"), high["n"].alias("nb")))


def alike(found: DataFrame, text: str = "text") -> DataFrame | None:
    """found: as described() gives it. Returns (a, b): each linked node a with the least node b of its component; None if
    none is."""
    batch_conf(found.sparkSession)
    rows = found.select("m.node", "m.n", "m.prefix").mapInArrow(_rows, "h long, node long, n long, pos long")
    rows = rows.repartition("h").dropDuplicates(["h", "node"])
    rows = save(rows.withColumn("g", F.count("*").over(Window.partitionBy("h"))).where("g > 1").withColumn("crowd", F.col("g") >= CROWD).drop("g").withColumn("root", F.col("node")))
    # nodes without a row there are like no other
    nodes = save(found.select("m.node", "m.n", "m.fp", "m.sketch", "m.bits").join(rows.select("node").distinct(), "node", "left_semi").groupBy("node").agg(F.first("n").alias("n"), F.first("fp").alias("fp"), F.first("sketch").alias("sketch"), F.first("bits").alias("bits")))
    links, roots, heads = None, None, 1

    def met(pairs: DataFrame, rows: DataFrame, before: DataFrame) -> DataFrame:
        """The rows that are still to meet others, once the pairs are confirmed and joined; before: what rows come from."""
        nonlocal links, roots
        new = _confirmed(pairs, nodes.select("node", "sketch"), found, text)
        if new.limit(1).count():
            links = new if links is None else roots.union(new)
            roots = components(links)
            rows = rows.join(roots.select(F.col("a").alias("node"), F.col("b").alias("to")), "node", "left").withColumn("root", F.coalesce("to", "node")).drop("to")
        group = Window.partitionBy("h")
        left = save(rows.withColumn("lo", F.min("root").over(group)).withColumn("hi", F.max("root").over(group)).where("lo <> hi").drop("lo", "hi"))
        drop(before, pairs)
        return left

    if rows.limit(1).count():
        rows = met(_by_fingerprint(nodes.select("node", "n", "fp")), rows, rows)
    bits = [f"b{i}" for i in range(PARITIES)]
    few = rows.where("NOT crowd").select("*", *[F.lit(None).cast("long").alias(b) for b in bits])
    many = rows.where("crowd").join(nodes.select("node", *[F.col("bits")[i].alias(b) for i, b in enumerate(bits)]), "node")
    rows, before = save(few.unionByName(many).drop("crowd")), rows
    drop(before)
    apart = sum((F.bit_count(F.col(f"x.{b}").bitwiseXOR(F.col(f"y.{b}"))) for b in bits), F.lit(0))
    while rows.limit(1).count():
        rows = rows.repartition("h").withColumn("share", F.count("*").over(Window.partitionBy("h", "root")))
        rows, before = save(rows.withColumn("k", F.row_number().over(Window.partitionBy("h").orderBy("share", "pos", "root", "node"))).drop("share")), rows
        drop(before)
        x, y = rows.where(F.col("k") <= heads).alias("x"), rows.alias("y")
        room = F.least(F.col("x.n") - F.col("x.pos"), F.col("y.n") - F.col("y.pos"))
        near = (F.col("x.h") == F.col("y.h")) & (F.col("x.k") < F.col("y.k")) & (F.col("x.root") != F.col("y.root")) & (9 * room >= 4 * (F.col("x.n") + F.col("y.n")))
        near &= F.col("x.b0").isNull() | (9 * apart <= F.col("x.n") + F.col("y.n"))
        low = F.col("x.node") < F.col("y.node")
        side = lambda c, a, b: F.when(low, F.col(f"{a}.{c}")).otherwise(F.col(f"{b}.{c}"))
        pairs = save(x.join(y, near).select(side("node", "x", "y").alias("a"), side("node", "y", "x").alias("b"), side("n", "x", "y").alias("na"), side("n", "y", "x").alias("nb")).distinct())
        rows = met(pairs, rows.where(F.col("k") > heads).drop("k"), rows)
        heads *= 8
    return roots


def first_of_alike(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """docs without the near copies: of each component, the row with the least id (ties: any one of them, chosen by the
    text) stays. Components without any id keep a row each."""
    found = save(described(docs, text))
    roots = alike(found, text)
    id_ = F.col(f"row.`{id_col}`")
    # a row of each node, which is picked in each task before the texts are shuffled
    one = Window.partitionBy("m.node").orderBy(id_.asc_nulls_last(), F.xxhash64(F.col(f"row.`{text}`")))
    firsts = found.select("row", "m.node", F.row_number().over(one).alias("_n")).where("_n = 1")
    if roots is not None:
        named = found.groupBy(F.col("m.node").alias("node")).agg(F.min(id_).alias("id"))
        named = named.join(roots.select(F.col("a").alias("node"), F.col("b").alias("root")), "node", "left").withColumn("root", F.coalesce("root", "node"))
        # of the nodes with a component's least id, the least one; no id comes last
        named = named.groupBy("root").agg(F.min(F.struct(F.col("id").isNull(), "id", "node")).alias("s"))
        firsts = firsts.join(save(named.select("s.node")), "node", "left_semi")
    return firsts.select("row.*")
