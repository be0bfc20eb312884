"""The prefix trie of conversations, from a Cartesian tree over the LCP array of sorted conversations.

Conversations are rebuilt upon the turns they share, and distinct sequences of turns are sorted, so that the members of
any node are neighbours. LCP[g] is how many turns sequence g shares with the one before. The sequences stand in blocks
of ranges; for each g the nearest smaller values on either side bound the interval of its node: a stack finds those that
lie in the block, and the blocks' minima tell which other block holds the rest. Nodes with one start and one LCP are
merged; the depths between a node and the one above it are expanded; sums over a subtree are differences of prefix sums
at the ends of its interval.

No conversation is ever gathered. Places and prefixes of turns are found over ranges and buckets, so that one may hold a
large share of all turns. A prefix is known by the exclusive-or of 128 bits of hash of each of its turns and its place.
A sequence is sorted by its prefixes at the depths at which others part from it, which are few: to part at depth d,
another sequence must have d - 1 turns, so k such depths take k * (k - 1) / 2 turns of others.

Cases: rows without a conv_id take no part; null and empty roles and texts are the same; turns with one number, and
repeated rows, all count, in an order fixed by hashes of role and text; conversations may end up without turns, and are
members of the root alone; equal conversations are members of the same nodes, in whatever number. Texts of any length
are read once. A negative conv_id c has its base at c - c % 100 with the sign of c, as SQL has it. An empty table gives
an empty one; further columns, whatever they are called, aren't read.
"""

from __future__ import annotations

from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lithic.llm.common import batch_conf, save, spread, table
from lithic.llm.order import RANGE, groups, ranked

SHARE, MODULUS, BUCKET = 100, 6, 4096
RESULT = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"


def _held(conv: str | Column) -> Column:
    """How many turns a conversation takes from its base."""
    return F.crc32(F.col(conv).cast("string").cast("binary")) % MODULUS


def _base(conv: str) -> Column:
    return F.col(conv) - F.col(conv) % SHARE


def turns_of(conversations: DataFrame, per: int) -> DataFrame:
    """(conv_id, idx, n, a, b, chars): each turn's place, and its contents as 120 bits of hash and a length."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    digest = F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256)
    half = lambda at: F.conv(F.substring("digest", at, 15), 16, 10).cast("long")
    rows = conversations.where("conv_id IS NOT NULL").select("conv_id", "turn", digest.alias("digest"), F.length(text).cast("long").alias("chars"))
    return ranked(save(rows.select("conv_id", "turn", half(1).alias("a"), half(16).alias("b"), "chars")), "conv_id", ["turn", "a", "b"], per)


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The turns of rebuilt conversations, (conv_id, d, a, b, chars) with d from 1, and (conv_id, n): their lengths."""
    own = turns.where("idx = 0").select("conv_id", "n").withColumn("held", _held("conv_id")).withColumn("base", _base("conv_id"))
    heads = turns.where((F.col("conv_id") == _base("conv_id")) & (F.col("idx") < MODULUS - 1)).select(F.col("conv_id").alias("base"), "idx", "a", "b", "chars")
    lengths = heads.groupBy("base").agg(F.count("*").alias("there"))
    convs = own.join(lengths, "base", "left").withColumn("taken", F.least("held", F.coalesce("there", F.lit(0))))
    convs = save(convs.select("conv_id", "base", "held", "taken", (F.col("taken") + F.greatest(F.col("n") - F.col("held"), F.lit(0))).alias("n")))
    front = convs.join(heads, "base").where("idx < held").select("conv_id", (F.col("idx") + 1).alias("d"), "a", "b", "chars")
    rest = turns.withColumn("held", _held("conv_id")).where("idx >= held").join(convs.select("conv_id", "taken"), "conv_id")
    rest = rest.select("conv_id", (F.col("idx") - F.col("held") + F.col("taken") + 1).alias("d"), "a", "b", "chars")
    return front.union(rest), convs.select("conv_id", "n")


def prefixes(turns: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """(conv_id, d, p, q, pp, qq, chars, total): 128 bits that stand for the first d turns (p, q) and the first d - 1 (pp,
    qq), and the code points of the d-th and of the first d. Summed in buckets of depths, then over buckets."""
    rows = turns.select("conv_id", "d", F.floor((F.col("d") - 1) / bucket).alias("bucket"), F.xxhash64("d", "a", "b").alias("x"), F.xxhash64("b", "a", "d").alias("y"), "chars")
    sums = [F.bit_xor("x"), F.bit_xor("y"), F.sum("chars")]
    before = Window.partitionBy("conv_id").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    parts = rows.groupBy("conv_id", "bucket").agg(*[s.alias(c) for s, c in zip(sums, ("x", "y", "chars"), strict=True)])
    carried = parts.select("conv_id", "bucket", *[F.coalesce(s.over(before), F.lit(0)).alias(c) for s, c in zip(sums, ("cx", "cy", "cc"), strict=True)])
    within = Window.partitionBy("conv_id", "bucket").orderBy("d")
    run = rows.join(carried, ["conv_id", "bucket"]).select("conv_id", "d", "x", "y", "chars", *[s.over(within).alias(c) for s, c in zip(sums, ("rx", "ry", "rc"), strict=True)], "cx", "cy", "cc")
    run = run.withColumn("p", F.col("rx").bitwiseXOR(F.col("cx"))).withColumn("q", F.col("ry").bitwiseXOR(F.col("cy")))
    return run.select("conv_id", "d", "p", "q", F.col("p").bitwiseXOR(F.col("x")).alias("pp"), F.col("q").bitwiseXOR(F.col("y")).alias("qq"), "chars", (F.col("rc") + F.col("cc")).alias("total"))


def partings(paths: DataFrame, sequences: int) -> DataFrame:
    """(d, p, q) of the prefixes that fewer sequences have than the prefix before."""
    classes = save(paths.groupBy("d", "p", "q").agg(F.count("*").alias("m"), F.min("pp").alias("pp"), F.min("qq").alias("qq")))
    above = classes.select((F.col("d") + 1).alias("d"), F.col("p").alias("pp"), F.col("q").alias("qq"), F.col("m").alias("of"))
    found = classes.where("d > 1").join(above, ["d", "pp", "qq"]).where("m < of").select("d", "p", "q")
    return found.union(classes.where((F.col("d") == 1) & (F.col("m") < sequences)).select("d", "p", "q"))


def shared(before: list[tuple], after: list[tuple]) -> int:
    """The LCP of neighbours: one less than the depth of the first parting at which they differ."""
    t = 0
    while t < min(len(before), len(after)) and before[t] == after[t]:
        t += 1
    return min(k[t][0] for k in (before, after) if t < len(k)) - 1


def _key(value) -> list[tuple]:
    return [(x["d"], x["p"], x["q"]) for x in value]


def sorted_blocks(sequences: DataFrame, per: int) -> DataFrame:
    """sequences (conv_id, n, copies, total, key) in blocks of ranges of the key: block, pos, lcp with the row before in
    the block (null for the first), and the key of a block's first and last rows alone."""
    batch_conf(sequences.sparkSession)
    dealt = sequences.repartitionByRange(spread(sequences.count(), per, sequences.sparkSession), "key").sortWithinPartitions("key")
    kind = sequences.schema["key"].dataType.simpleString()

    def run(batches):
        block, pos, last, held = TaskContext.get().partitionId(), 0, None, None
        for b in batches:
            conv, n, copies, total, keys = (c.to_pylist() for c in b.columns)
            rows = []
            for row in zip(conv, n, copies, total, map(_key, keys), strict=True):
                if held is not None:
                    rows.append(held)
                held = [block, pos, *row[:4], None if last is None else shared(last, row[4]), row[4] if last is None else None]
                pos, last = pos + 1, row[4]
            if rows:
                yield _rows(rows, out)
        if held is not None:
            held[-1] = last
            yield _rows([held], out)

    out = pa.schema([*((c, pa.int64()) for c in ("block", "pos", "conv_id", "n", "copies", "total", "lcp")), ("key", pa.list_(pa.struct([(c, pa.int64()) for c in "dpq"])))])
    return save(dealt.select("conv_id", "n", "copies", "total", "key").mapInArrow(run, f"block long, pos long, conv_id long, n long, copies long, total long, lcp long, key {kind}"))


def _rows(rows: list, schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True))
    columns = [[None if k is None else [dict(zip("dpq", x, strict=True)) for x in k] for k in c] if pa.types.is_list(f.type) else c for c, f in zip(columns, schema, strict=True)]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def firsts(placed: DataFrame) -> dict[int, int]:
    """The LCP of each block's first row with the last of the block before it; -1 for the very first."""

    def run(batches):
        last, at = None, None
        for b in batches:
            for block, key in zip(b.column(0).to_pylist(), map(_key, b.column(1).to_pylist()), strict=True):
                if block != at:
                    yield pa.RecordBatch.from_arrays([pa.array([block]), pa.array([-1 if last is None else shared(last, key)])], ["block", "lcp"])
                last, at = key, block

    ends = placed.where("key IS NOT NULL").select("block", "key", "pos").repartition(1).sortWithinPartitions("block", "pos")
    return dict(map(tuple, ends.select("block", "key").mapInArrow(run, "block long, lcp long").collect()))  # a row for each block


def sweep(lcp: list[int], conv: list[int], at: int) -> tuple[list[int], list[tuple]]:
    """A block's part of the Cartesian tree. lcp: of its sequences, the first one's place being ``at``.

    Returns each index's nearest smaller value to the left, and the block's nodes, equal LCPs merged: (lcp, left, right,
    how many, least conv of the interval); a side that isn't in the block is -1.
    """
    left, nodes, stack = [], [], []  # of the stack: lcp, left, how many, last index, least conv
    for i, v in enumerate(lcp):
        low = conv[i - 1] if i else None
        while stack and stack[-1][0] > v:
            top = stack.pop()
            nodes.append((top[0], top[1], at + i - 1, top[2], top[4]))
            low = min(low, top[4])
            if stack:
                stack[-1][4] = min(stack[-1][4], top[4])
        if stack and stack[-1][0] == v:
            stack[-1][2] += 1
            stack[-1][3] = i
            stack[-1][4] = min(stack[-1][4], conv[i])
        else:
            bound = at + stack[-1][3] if stack else -1
            stack.append([v, bound, 1, i, conv[i] if low is None else min(low, conv[i])])
        left.append(stack[-1][1])
    low = None
    while stack:
        top = stack.pop()
        low = top[4] if low is None else min(low, top[4])
        nodes.append((top[0], top[1], -1, top[2], low))
    return left, nodes


INDEX = "block long, g long, conv_id long, n long, lcp long, next long, copies long, total long, x long, a long, w long, leaves long, own long, suffix long, prefix long, lft long"
NODE = "block long, v long, l long, r long, many long, low long, lblock long, rblock long"


def _swept(blocks: DataFrame, first: dict[int, int], sizes: dict[int, int], least: dict[int, int]) -> DataFrame:
    """Runs the sweep over each block: the rows of INDEX as ``i`` and of NODE as ``m``, one of them null. The x, a, w and
    leaves of a row are sums over the rows before it in the block."""
    order = np.array(sorted(sizes))
    offset = dict(zip(order.tolist(), (np.cumsum([sizes[b] for b in order]) - [sizes[b] for b in order]).tolist(), strict=True))
    minima = np.array([least[b] for b in order])
    following = {b: first[c] for b, c in zip(order[:-1].tolist(), order[1:].tolist(), strict=True)}
    kinds = [pa.struct([(f.split()[0], pa.int64()) for f in kind.split(", ")]) for kind in (INDEX, NODE)]

    def run(batches):
        for block, _, conv, n, lcp, copies, total, below in groups(batches, 1):
            b, k = block[0], int(np.searchsorted(order, block[0]))
            at, size = offset[b], len(conv)
            nxt = [*lcp[1:], following.get(b, -1)]
            left, nodes = sweep(lcp, conv, at)
            to_left = {v: int(order[np.flatnonzero(minima[:k] < v)[-1]]) for v, l, *_ in nodes if l < 0 and v >= 0}
            to_right = {v: int(order[k + 1 :][found[0]]) if len(found := np.flatnonzero(minima[k + 1 :] < v)) else -1 for v, _, r, *_ in nodes if r < 0}
            n_, c, t = (np.array(x, np.int64) for x in (n, copies, total))
            sums = [np.cumsum(x) - x for x in (c, c * t, t - np.array(below, np.int64), (n_ > np.array(nxt)).astype(np.int64))]
            conv_ = np.array(conv, np.int64)
            columns = [np.full(size, b), at + np.arange(size), conv_, n_, lcp, nxt, c, t, *sums, t - np.array(below, np.int64), np.minimum.accumulate(conv_[::-1])[::-1], np.minimum.accumulate(conv_), left]
            yield _tagged(columns, kinds, 0)
            found = [(b, v, l, r, many, low, to_left[v] if l < 0 else -1, to_right[v] if r < 0 else -1) for v, l, r, many, low in nodes if v >= 0]
            if found:
                yield _tagged(list(zip(*found, strict=True)), kinds, 1)

    def _tagged(columns, kinds, which):
        filled = pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in columns], [f.name for f in kinds[which]])
        arrays = [filled if i == which else pa.nulls(len(filled), kinds[i]) for i in (0, 1)]
        return pa.RecordBatch.from_arrays(arrays, ["i", "m"])

    dealt = blocks.repartition(max(1, len(sizes)), "block").sortWithinPartitions("block", "pos").select("block", "pos", "conv_id", "n", "lcp", "copies", "total", "below")
    return dealt.mapInArrow(run, f"i struct<{INDEX.replace(' long', ':long')}>, m struct<{NODE.replace(' long', ':long')}>")


def _small(spark: SparkSession, values: dict[int, tuple], schema: str) -> DataFrame:
    """A broadcast table of a row for each block."""
    return F.broadcast(spark.createDataFrame([(k, *v) for k, v in values.items()], schema))


def _across(nodes: DataFrame, index: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The ends of intervals that leave their block: (block, v, l) and (block, v, r). A block's candidates are the last,
    or first, of each value, and only those below the value asked for matter."""
    last = index.groupBy(F.col("block").alias("lblock"), F.col("lcp").alias("u")).agg(F.max("g").alias("g"))
    begins = index.groupBy(F.col("block").alias("rblock"), F.col("lcp").alias("u")).agg(F.min("g").alias("g"))
    ask_left = nodes.where("l < 0").select("block", "v", "lblock").distinct()
    ask_right = nodes.where("r < 0 AND rblock >= 0").select("block", "v", "rblock").distinct()
    lefts = ask_left.join(last, "lblock").where("u < v").groupBy("block", "v").agg(F.max("g").alias("l_"))
    rights = ask_right.join(begins, "rblock").where("u < v").groupBy("block", "v").agg((F.min("g") - 1).alias("r_"))
    return lefts, rights


def _spanning(nodes: DataFrame, least: dict[int, int]) -> DataFrame:
    """The least conv of intervals over several blocks, from both ends and the blocks between."""
    order = np.array(sorted(least))
    values = np.array([least[b] for b in order])

    def run(batches):
        for b in batches:
            l, v, first, last, low = (b.column(i).to_pylist() for i in range(5))
            at = [np.searchsorted(order, x) for x in (first, last)]
            got = [min(x, int(values[s + 1 : e].min())) if s + 1 < e else x for x, s, e in zip(low, *at, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (l, v, got)], ["l", "v", "low_"])

    return nodes.mapInArrow(run, "l long, v long, low_ long")


def ends_of(members: DataFrame, per: int) -> DataFrame:
    """members (rep, conv_id): (rep, ends), the digest of each rep's ids in ascending order.

    Ids are packed into long texts over ranges first, so that what a large group sends to the one task that digests it
    (a digest is a sequential thing) is a few texts, taken one by one.
    """
    spark = members.sparkSession
    dealt = members.repartitionByRange(spread(members.count(), per, spark), "rep", "conv_id").sortWithinPartitions("rep", "conv_id")

    def pack(batches):
        for b in batches:
            reps, ids = (c.to_numpy() for c in b.columns)
            cuts = np.concatenate(([0], np.flatnonzero(reps[1:] != reps[:-1]) + 1, [len(reps)])).tolist() if len(reps) else []
            out = [(int(reps[s]), int(ids[s]), ",".join(map(str, ids[s:e].tolist()))) for s, e in zip(cuts, cuts[1:], strict=False)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.string()), strict=True)], ["rep", "first", "part"])

    def digests(batches):
        at, state = None, None
        for b in batches:
            done = []
            for rep, part in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if rep != at:
                    if state:
                        done.append((at, state.hexdigest()))
                    at, state = rep, sha256(part.encode())
                else:
                    state.update(f",{part}".encode())
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in done], pa.int64()), pa.array([x for _, x in done], pa.string())], ["rep", "ends"])
        if state:
            yield pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), pa.array([state.hexdigest()])], ["rep", "ends"])

    packed = dealt.mapInArrow(pack, "rep long, first long, part string")
    return packed.repartition("rep").sortWithinPartitions("rep", "first").select("rep", "part").mapInArrow(digests, "rep long, ends string")


def prefix_trie(conversations: DataFrame, per: int = RANGE, bucket: int = BUCKET) -> DataFrame:
    """The nodes of the trie: see RESULT."""
    spark = conversations.sparkSession
    batch_conf(spark)
    rows, lengths = rebuilt(turns_of(conversations, per))
    every = save(prefixes(rows, bucket))
    closing = every.select("conv_id", F.col("d").alias("n"), "p", "q", "total")
    ends = save(lengths.join(closing, ["conv_id", "n"], "left").na.fill(0, ["p", "q", "total"]))
    sequences = save(ends.groupBy("n", "p", "q").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("copies"), F.min("total").alias("total")))
    count = sequences.count()
    if not count:
        return spark.createDataFrame([], RESULT)

    paths = save(every.join(sequences.select("conv_id"), "conv_id", "left_semi"))
    keys = paths.join(partings(paths, count), ["d", "p", "q"]).groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("d", "p", "q"))).alias("key"))
    placed = sorted_blocks(sequences.join(keys, "conv_id", "left").withColumn("key", F.coalesce("key", F.array().cast("array<struct<d:long,p:long,q:long>>"))), per)
    first = firsts(placed)
    filled = placed.join(_small(spark, {k: (v,) for k, v in first.items()}, "block long, first long"), "block").withColumn("lcp", F.coalesce("lcp", "first"))
    depths = paths.select("conv_id", F.col("d").alias("lcp"), F.col("total").alias("below"))
    blocks = save(filled.select("block", "pos", "conv_id", "n", "copies", "total", "lcp").join(depths, ["conv_id", "lcp"], "left").na.fill(0, ["below"]))
    of = {r[0]: tuple(r[1:]) for r in blocks.groupBy("block").agg(F.count("*"), F.min("lcp"), F.min("conv_id")).collect()}  # a row for each block
    swept = save(_swept(blocks, first, {b: x[0] for b, x in of.items()}, {b: x[1] for b, x in of.items()}))

    index, found = swept.where("i IS NOT NULL").select("i.*"), swept.where("m IS NOT NULL").select("m.*")
    lefts, rights = _across(found, index)
    totals = index.groupBy("block").agg(F.sum("copies"), F.sum(F.col("copies") * F.col("total")), F.sum("own"), F.sum((F.col("n") > F.col("next")).cast("long"))).orderBy("block").collect()  # a row for each block
    carried = np.cumsum([[0] * 4, *(r[1:] for r in totals)], axis=0).tolist()
    carried = _small(spark, {r[0]: tuple(c) for r, c in zip(totals, carried, strict=False)}, "block long, cx long, ca long, cw long, cleaves long")
    index = save(index.join(carried, "block").join(lefts.withColumnRenamed("v", "lcp"), ["block", "lcp"], "left").select(
        "block", "g", "conv_id", "n", "lcp", "next", "copies", "total", "suffix", "prefix", F.when(F.col("lft") >= 0, F.col("lft")).otherwise(F.col("l_")).alias("lft"),
        *[(F.col(c) + F.col(f"c{c}")).alias(c) for c in ("x", "a", "w", "leaves")], "own"))
    nodes = found.join(lefts, ["block", "v"], "left").join(rights, ["block", "v"], "left").select(
        "v", F.when(F.col("l") >= 0, F.col("l")).otherwise(F.col("l_")).alias("l"), F.when(F.col("r") >= 0, F.col("r")).otherwise(F.coalesce("r_", F.lit(count - 1))).alias("r"), "many", "low")
    nodes = nodes.groupBy("l", "v").agg(F.max("r").alias("r"), F.sum("many").alias("many"), F.min("low").alias("low"))

    at_left = index.select(F.col("g").alias("l"), F.col("block").alias("bl"), F.col("conv_id").alias("rep"), F.col("n").alias("n_l"), F.col("lcp").alias("lcp_l"), F.col("total").alias("total_l"), "suffix", *[F.col(c).alias(f"{c}_l") for c in ("x", "a", "w", "leaves", "own")])
    at_right = index.select(F.col("g").alias("r"), F.col("block").alias("br"), F.col("next").alias("lcp_r"), "prefix", (F.col("x") + F.col("copies")).alias("x_r"), (F.col("a") + F.col("copies") * F.col("total")).alias("a_r"), (F.col("w") + F.col("own")).alias("w_r"), (F.col("leaves") + (F.col("n") > F.col("next")).cast("long")).alias("leaves_r"))
    inner = save(nodes.join(at_left, "l").join(at_right, "r").withColumn("low", F.when(F.col("bl") == F.col("br"), F.col("low")).otherwise(F.least("suffix", "prefix"))))
    wide = _spanning(inner.where("bl <> br").select("l", "v", "bl", "br", "low"), {b: x[2] for b, x in of.items()})
    inner = inner.join(wide, ["l", "v"], "left").withColumn("conv", F.coalesce("low_", "low")).withColumn("n_children", F.col("many") + (F.col("n_l") > F.col("v")).cast("long"))
    outer = at_left.withColumn("r", F.col("l")).join(at_right, "r").withColumn("v", F.col("n_l")).withColumn("conv", F.col("rep")).withColumn("n_children", F.lit(0).cast("long"))
    columns = ["l", "r", "v", "conv", "n_children", "rep", "n_l", "lcp_l", "lcp_r", "total_l", "x_l", "x_r", "a_l", "a_r", "w_l", "own_l", "w_r", "leaves_l", "leaves_r"]
    chains = inner.select(*columns).union(outer.select(*columns)).withColumn("above", F.greatest("lcp_l", "lcp_r")).where("v > above")
    chains = chains.withColumn("g", F.when(F.col("lcp_l") >= F.col("lcp_r"), F.col("l")).otherwise(F.col("r") + 1))
    parents = index.select("g", F.col("lft").alias("pl"), F.col("lcp").alias("pv")).join(inner.select(F.col("l").alias("pl"), F.col("v").alias("pv"), F.col("conv").alias("parent")), ["pl", "pv"]).select("g", "parent")
    chains = chains.join(parents, "g", "left").withColumn("n_convs", F.col("x_r") - F.col("x_l"))

    # the depths of a chain, a bucket at a time
    steps = chains.withColumn("from", F.explode(F.sequence(F.col("above") + 1, F.col("v"), F.lit(bucket).cast("long"))))
    steps = steps.withColumn("d", F.explode(F.sequence(F.col("from"), F.least(F.col("from") + bucket - 1, F.col("v")))))
    at = paths.select(F.col("conv_id").alias("rep"), "d", (F.col("total") - F.col("chars")).alias("to"))
    many = ends.join(sequences.where("copies > 1").select("n", "p", "q", F.col("conv_id").alias("rep")), ["n", "p", "q"]).select("rep", "conv_id")
    one = sequences.where("copies = 1").select(F.col("conv_id").alias("rep"), F.sha2(F.col("conv_id").cast("string"), 256).alias("ends"))
    digests = one.union(ends_of(save(many), per)).join(sequences.select(F.col("conv_id").alias("rep"), F.col("n").alias("d")), "rep")
    full = steps.join(at, ["rep", "d"], "left").join(digests, ["rep", "d"], "left")
    to = F.coalesce("to", F.lit(0))
    texts = (F.col("a_r") - F.col("a_l")) - F.col("n_convs") * to  # of every member, from this depth on
    once = (F.col("w_r") - F.col("w_l") - F.col("own_l")) + (F.col("total_l") - to)  # of every node
    return full.select(
        F.col("conv").alias("conv_id"), F.col("d").alias("depth"), F.when(F.col("d") > F.col("above") + 1, F.col("conv")).otherwise(F.col("parent")).alias("parent_conv_id"), "n_convs",
        F.when(F.col("d") < F.col("v"), F.lit(1)).otherwise(F.col("n_children")).cast("long").alias("n_children"), (F.col("leaves_r") - F.col("leaves_l")).alias("n_leaves"),
        (texts - once).alias("saved_tokens"), F.coalesce("ends", F.lit(sha256(b"").hexdigest())).alias("ends_sha256"),
    )


def op11_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(table(spark, sf_dir, "conversations"))
