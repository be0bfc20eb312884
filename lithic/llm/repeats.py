"""Finding windows of a fixed number of symbols that occur more than once in a corpus.

Shared by the removal of repeated byte strings and of repeated word passages. A window's *anchor* is its least k-gram
by hash (leftmost on ties); equal windows have equal anchors at equal offsets. Consecutive windows with one anchor
form a *block*. So a corpus of n symbols is described by some n / (window / 2) blocks, and only these are shuffled:

1. anchors that occur once in the corpus end there;
2. one copy of each distinct block that is left is taken back to its text, which gives the block's *passage*;
3. where all occurrences of an anchor are in equal blocks, all their windows are repeated; where blocks differ, a
   *confirm* step of the operator finds which of their windows occur in others.

The result is, by bucket of documents, the passages that its documents hold by hash, with the runs of their windows that
are repeated; the operator then finds the passages themselves in the bucket's texts. Texts are dealt to buckets by id and
text, so that a bucket's texts have a bounded size; a bucket that holds more, as many equal rows or one long text, is
salted, and what is known of it goes to each of its salts. Keys that hold very many rows are salted in joins.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lithic.llm.common import batch_conf, drop, save, spread

BUCKET_BYTES = 2 << 20
_B = np.uint64(0x9E3779B97F4A7C15)
_B_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_PLACE = np.uint64(24)
_AT = np.uint64((1 << 24) - 1)
_MOST = 1 << 22  # symbols of a long text that are looked at together
_TOGETHER = 1 << 17  # of short texts
#: Rows of one key in a join beyond which it is salted; more where all keys have so many, so that at most MOST_HOT are.
HOT, MOST_HOT = 1000, 100_000


class Scheme(NamedTuple):
    window: int
    gram: int
    symbols: Callable[[bytes], np.ndarray]  # a text's symbols as 64-bit hashes


class Blocks(NamedTuple):
    doc: np.ndarray  # number of the text
    first: np.ndarray  # first window of each block
    count: np.ndarray  # windows in it
    place: np.ndarray  # offset of the anchor from the first window
    anchor: np.ndarray
    block: np.ndarray


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


_powers: dict[str, np.ndarray] = {}


def _power(base: np.uint64, n: int) -> np.ndarray:
    name = str(base)
    if name not in _powers or len(_powers[name]) < n:
        steps = np.full(max(n, 1 << 16), base, np.uint64)
        steps[0] = 1
        _powers[name] = np.multiply.accumulate(steps)
    return _powers[name][:n]


def gram_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """A hash of each k consecutive symbols, built by doubling."""
    out, size, width, base = None, 0, 1, _B
    part = h
    while True:
        if k & width:
            if out is None:
                out, size = part, width
            else:
                # the part of this width follows what is there
                n = len(h) - size - width + 1
                out = out[:n] * np.uint64(pow(int(_B), width, 1 << 64)) + part[size : size + n]
                size += width
        if size == k:
            return mix(out[: len(h) - k + 1])
        part = part[:-width] * base + part[width:]
        width *= 2
        base = np.uint64(pow(int(_B), width, 1 << 64))


class Spans:
    """Hashes of spans of symbols, from one running sum."""

    def __init__(self, h: np.ndarray):
        self.sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(h * _power(_B, len(h)), dtype=np.uint64)))
        self.back = _power(_B_INV, len(h) + 1)

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.back[start])


def least_in(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` consecutive values, by doubling."""
    n, size = len(x) - width + 1, 1
    while size * 2 <= width:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    return np.minimum(x[:n], x[width - size : width - size + n])


def _blocks(h: np.ndarray, ends: np.ndarray, scheme: Scheme) -> Blocks:
    """The blocks of texts laid end to end; ends: where each one ends. No window crosses an end."""
    w, k = scheme.window, scheme.gram
    none = np.zeros(0, np.int64)
    if len(h) < w:
        return Blocks(none, none, none, none, none.view(np.uint64), none.view(np.uint64))
    grams = gram_hashes(h, k)
    ordered = (grams >> _PLACE << _PLACE) | np.arange(len(grams), dtype=np.uint64)
    at = (least_in(ordered, w - k + 1) & _AT).astype(np.int64)
    doc = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))
    whole = doc[: len(at)] == doc[w - 1 :]
    change = np.ones(len(at), bool)
    change[1:] = (at[1:] != at[:-1]) | (whole[1:] != whole[:-1])
    first = np.flatnonzero(change)
    count = np.diff(np.append(first, len(at)))
    inside = whole[first]
    first, count = first[inside], count[inside]
    place = at[first] - first
    block = mix(Spans(h)(first, first + count + w - 1) ^ mix((count * 4096 + place).astype(np.uint64)))
    doc = doc[first]
    return Blocks(doc, first - np.concatenate(([0], ends[:-1]))[doc], count, place, grams[at[first]], block)


def _joined(parts: list[Blocks]) -> Blocks:
    return Blocks(*(np.concatenate(c) for c in zip(*parts, strict=True)))


def blocks_of(texts: list[np.ndarray | None], scheme: Scheme) -> Blocks:
    """The blocks of texts, given as symbols, by text and place. Short texts are looked at together; a text beyond
    2^22 symbols in overlapping parts. A block that a part's end cuts in two is still right, as blocks that differ are
    compared by their windows."""
    w, out, held, size = scheme.window, [], [], 0

    def flush() -> None:
        nonlocal held, size
        if held:
            got = _blocks(np.concatenate([texts[i] for i in held]), np.cumsum([len(texts[i]) for i in held]), scheme)
            out.append(got._replace(doc=np.array(held)[got.doc]))
        held, size = [], 0

    for i, h in enumerate(texts):
        if h is None or len(h) < w:
            continue
        if len(h) > _MOST:
            for s in range(0, len(h) - w + 1, _MOST):
                part = h[s : s + _MOST + w - 1]
                got = _blocks(part, np.array([len(part)]), scheme)
                out.append(got._replace(doc=got.doc + i, first=got.first + s))
            continue
        held.append(i)
        size += len(h)
        if size > _TOGETHER:
            flush()
    flush()
    return _joined(out) if out else _blocks(np.zeros(0, np.uint64), np.zeros(0, np.int64), scheme)


class Dealt(NamedTuple):
    """Documents as row (struct of the other columns), t (the text's bytes), bucket and salt; and the salts of buckets
    that have several."""

    docs: DataFrame
    hot: DataFrame | None  # bucket, salts


def dealt(docs: DataFrame, text: str, ids: list[str], bucket_bytes: int = BUCKET_BYTES) -> Dealt:
    rest = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text] or [F.lit(0).alias("_")]).alias("row")
    size = F.octet_length(F.col(f"`{text}`")) + 64
    n = spread(docs.agg(F.sum(size)).first()[0] or 0, bucket_bytes, docs.sparkSession)
    bucket = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in [*ids, text]]), F.lit(n)).cast("int").alias("bucket")
    sizes = docs.select(bucket, F.coalesce(size, F.lit(64)).alias("size")).groupBy("bucket").agg(F.sum("size").alias("size"))
    hot = save(sizes.where(F.col("size") > 4 * bucket_bytes).select("bucket", F.ceil(F.col("size") / (2 * bucket_bytes)).cast("int").alias("salts")))
    found = docs.select(rest, F.col(f"`{text}`").cast("binary").alias("t"), bucket)
    many = hot.count()
    if not many:
        return Dealt(found.withColumn("salt", F.lit(0)), None)
    # a row's salt may differ each time it is read: each salt of a bucket is told all that is known of the bucket
    salted = found.join(F.broadcast(hot) if many <= MOST_HOT else hot, "bucket", "left")
    return Dealt(salted.withColumn("salt", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.coalesce("salts", F.lit(1))).cast("int")).drop("salts"), hot)


def uneven_join(many: DataFrame, one: DataFrame, keys: list[str], by: list[str]) -> DataFrame:
    """many joined to one on keys. one is written, has a row a key, and says in places how many rows of many a key has;
    rows of a hot key are dealt out by the columns in by."""
    limit = max(HOT, (one.agg(F.sum("places")).first()[0] or 0) // MOST_HOT)
    hot = one.where(F.col("places") > limit).select(*keys, F.ceil(F.col("places") / limit).cast("int").alias("_salts"))
    one = one.drop("places")
    if not hot.limit(1).count():
        return many.join(one, keys)
    hot = F.broadcast(hot)  # at most MOST_HOT keys
    dealt_ = many.join(hot, keys, "left").withColumn("_salt", F.pmod(F.xxhash64(*by), F.coalesce("_salts", F.lit(1)))).drop("_salts")
    copies = one.join(hot, keys, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), (F.coalesce("_salts", F.lit(1)) - 1).cast("long")))).drop("_salts")
    return dealt_.join(copies, [*keys, "_salt"]).drop("_salt")


def key_of(anchor: np.ndarray, block: np.ndarray) -> np.ndarray:
    """One number for both, for sorting; matches are held against both."""
    return mix(anchor ^ mix(block))


def block_rows(docs: Dealt, scheme: Scheme) -> DataFrame:
    """(bucket, anchor, block, n): distinct within a batch of texts, n times each."""
    batch_conf(docs.docs.sparkSession)

    def run(batches):
        for b in batches:
            got = blocks_of([scheme.symbols(t) if t else None for t in b.column(1).to_pylist()], scheme)
            if not len(got.doc):
                continue
            bucket = b.column(0).to_numpy(zero_copy_only=False)[got.doc]
            _, at, n = np.unique(key_of(got.anchor, got.block) ^ mix(bucket.astype(np.uint64)), return_index=True, return_counts=True)
            cols = [bucket[at].astype(np.int32), got.anchor[at].view(np.int64), got.block[at].view(np.int64), n.astype(np.int32)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["bucket", "anchor", "block", "n"])

    return docs.docs.select("bucket", "t").mapInArrow(run, "bucket int, anchor long, block long, n int")


def with_texts(docs: Dealt, refs: DataFrame, by: str, fn, schema: str, row: bool = False) -> DataFrame:
    """fn(texts, refs) -> arrow table, for each bucket of documents with its rows of refs."""
    left = docs.docs.select("bucket", "salt", "t", *(["row"] if row else []))
    refs = refs.withColumn("bucket", F.col(by))
    if docs.hot is None:
        refs = refs.withColumn("salt", F.lit(0))
    else:
        refs = refs.join(docs.hot, "bucket", "left").withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1))).drop("salts")
    return left.groupBy("bucket", "salt").cogroup(refs.groupBy("bucket", "salt")).applyInArrow(fn, schema)


def by_doc(doc: np.ndarray):
    """(document, places of its rows), for each document in doc."""
    if not len(doc):
        return
    order = np.argsort(doc, kind="stable")
    cuts = np.flatnonzero(np.diff(doc[order], prepend=-1))
    for a, b in zip(cuts, np.append(cuts[1:], len(doc)), strict=True):
        yield int(doc[order[a]]), order[a:b]


class Refs:
    """The rows of a bucket, by the anchor and block that they speak of."""

    def __init__(self, table: pa.Table):
        anchor, block = (table.column(c).to_numpy().view(np.uint64) for c in ("anchor", "block"))
        self.order = np.argsort(key_of(anchor, block))
        self.anchor, self.block = anchor[self.order], block[self.order]
        self.keys, self.table = key_of(self.anchor, self.block), table

    def column(self, name: str) -> pa.ChunkedArray:
        return self.table.column(name).take(pa.array(self.order))

    def find(self, blocks: Blocks) -> tuple[np.ndarray, np.ndarray]:
        """Which of the blocks are spoken of, and by which row."""
        if not len(self.keys) or not len(blocks.doc):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(self.keys, key_of(blocks.anchor, blocks.block)), len(self.keys) - 1)
        hit = np.flatnonzero((self.anchor[at] == blocks.anchor) & (self.block[at] == blocks.block))
        return hit, at[hit]

    def find_once(self, blocks: Blocks) -> tuple[np.ndarray, np.ndarray]:
        """The same, only the first block for each row."""
        hit, at = self.find(blocks)
        at, first = np.unique(at, return_index=True)
        return hit[first], at


def _passages(scheme: Scheme, cut):
    def take(texts: pa.Table, refs: pa.Table) -> pa.Table:
        """The passages of the distinct blocks that this bucket stands for; of those that differ from others with their
        anchor, what the operator's confirm step asks for."""
        known = Refs(refs)
        raw = texts.column("t").to_pylist() if len(known.keys) else []
        h = [scheme.symbols(t) if t else None for t in raw]
        blocks = blocks_of(h, scheme)
        hit, at = known.find_once(blocks)
        rows: list[tuple] = []
        differ, keep = known.column("differ").to_numpy(zero_copy_only=False), known.order[at]
        for doc, part in by_doc(blocks.doc[hit]):
            own = hit[part]
            rows += zip(part.tolist(), *cut(raw[doc], h[doc], blocks.first[own], blocks.count[own], differ[at[part]]), blocks.place[own].tolist(), strict=True)
        cols = list(zip(*rows, strict=True)) or [(), (), (), ()]
        table = refs.select(["anchor", "block", "n", "places", "differ"]).take(pa.array(keep[list(cols[0])] if rows else [], pa.int64()))
        for name, values, kind in zip(("text", "windows", "place"), cols[1:], (pa.binary(), pa.list_(pa.int64()), pa.int32()), strict=True):
            table = table.append_column(name, pa.array(values, kind))
        return table

    return take


PASSAGE = "anchor long, block long, n long, places long, differ boolean, text binary, windows array<long>, place int"


def repeated_blocks(docs: Dealt, scheme: Scheme, cut, confirm) -> DataFrame:
    """(bucket, anchor, block, text, runs): passages with repeated windows, for each bucket that holds one; runs is null
    where all windows are repeated, else a flat list start, end, ...

    cut(text, symbols, first, count, differ) gives the passages of some blocks of a text and, of those that differ, hashes
    of their windows if the operator needs any. confirm(passages) returns (anchor, block, runs) for those passages that
    differ from others with their anchor and have repeated windows; passages has the columns of PASSAGE.
    """
    # written once, as both the count of anchors and what is left of them read it
    rows = save(block_rows(docs, scheme))
    # a hot anchor is summed in each task before it is shuffled
    again = save(rows.groupBy("anchor").agg(F.sum("n").alias("n"), F.count("*").alias("places"), F.min("block").alias("low"), F.max("block").alias("high")).where("n > 1").select("anchor", "places", (F.col("low") != F.col("high")).alias("differ")))
    found = save(uneven_join(rows, again, ["anchor"], ["bucket", "block"]).groupBy("bucket", "anchor", "block", "differ").agg(F.sum("n").alias("n")))
    drop(rows, again)
    distinct = found.groupBy("anchor", "block", "differ").agg(F.sum("n").alias("n"), F.count("*").alias("places"), F.min("bucket").alias("rep"))
    got = with_texts(docs, distinct, "rep", _passages(scheme, cut), PASSAGE)
    if docs.hot is not None:  # each salt of a bucket may have given its own
        got = got.dropDuplicates(["anchor", "block"])
    got = save(got)
    drop(distinct)
    runs = confirm(got.where("differ"))
    columns = ["anchor", "block", "places", "text"]
    whole = got.where("not differ").select(*columns, F.lit(None).cast("array<int>").alias("runs"))
    some = got.where("differ").select(*columns).join(runs, ["anchor", "block"])
    passages = save(whole.unionByName(some))
    drop(got)
    return uneven_join(found.select("bucket", "anchor", "block"), passages, ["anchor", "block"], ["bucket"])


def window_runs(windows: DataFrame) -> DataFrame:
    """windows: (anchor, block, off, w, n), one row for each window of each distinct block; n: times the block occurs.

    (anchor, block, runs) for the blocks with windows that occur more than once."""
    twice = windows.groupBy("anchor", "w").agg(F.sum("n").alias("n")).where("n > 1").select("anchor", "w")
    offs = windows.join(twice, ["anchor", "w"]).groupBy("anchor", "block").agg(F.array_sort(F.collect_set("off")).alias("offs"))
    return offs.select("anchor", "block", F.flatten(F.transform("offs", lambda o: F.array(o, o + 1))).alias("runs"))


def span_of(first: int, count: int, runs: list[int] | None, window: int) -> list[tuple[int, int]]:
    """Spans of symbols that a block's repeated windows cover: those in runs, or all."""
    if runs is None:
        return [(first, first + count + window - 1)]
    out: list[tuple[int, int]] = []
    for s, e in zip(runs[::2], runs[1::2], strict=True):
        if out and out[-1][1] == first + s + window - 1:  # goes on from the run before
            out[-1] = (out[-1][0], first + e + window - 1)
        else:
            out.append((first + s, first + e + window - 1))
    return out
