"""Benchmark decontamination by a prefix-filtered set join.

Every item is cut into windows of consecutive words. A document holds a window only if it holds the window's
necessary prefix; since a window must be contained whole, the prefix is its one rarest word, by document frequency
over the whole corpus. Documents are probed with these words, candidates pass the length and position bounds, and
the window is then compared word for word with the document's words at that place. Windows that items share are one,
with a list of owners.

The index of a benchmark is broadcast in shards of bounded size; documents are read twice, for frequencies and for
windows, however many shards there are, and each task holds one shard at a time.

Cases: null and empty texts have no words and hold nothing; items without words and items whose id is null take no
part; repeated items count once, texts that share an id are one item, repeated documents each on their own; an item
shorter than a window is one window. Words that are equally rare are ordered by their bytes, which changes no result.
Very long documents are read whole, their candidates a part at a time. Without documents or items there is nothing to
find: an empty table gives an empty one, an empty benchmark documents without hits. Columns keep their names inside
``row``.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable
from itertools import repeat
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from lithic.llm.common import batch_conf, save, table

WINDOW = 10
#: Bytes of benchmark text whose index is broadcast at once; a larger benchmark is taken in shards of that size.
SHARD_BYTES = 16 << 20
#: Candidates of one document that are verified together.
_PROBES = 1 << 20
#: Bytes of documents that are held while the shards pass by.
SWEEP_BYTES = 8 << 20

_KEEP = bytes(c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))

METRICS = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("spans", T.ArrayType(T.ArrayType(T.IntegerType()))),
        T.StructField("items", T.ArrayType(T.StringType())),
    ]
)


def words_of(text: bytes | None) -> list[bytes]:
    """Lower-cased words; what is neither a digit, a letter a-z nor outside ASCII separates them."""
    return text.translate(_KEEP).split() if text else []


def _swept(batches, column: int, shards: list, each):
    """(batch, [each(words of the batch's texts, shard's value) for each shard]). Of many shards one is held at a time."""

    def done(held):
        words = [[words_of(t) for t in b.column(column).to_pylist()] for b in held]
        out = [[] for _ in held]
        for shard in shards:
            value = shard.value
            for got, w in zip(out, words, strict=True):
                got.append(each(w, value))
            if len(shards) > 1 and getattr(shard, "_path", None):
                del shard._value  # it is read again from its file
        return zip(held, out, strict=True)

    held, size = [], 0
    for b in batches:
        held.append(b)
        size += b.nbytes
        if len(shards) == 1 or size > SWEEP_BYTES:
            yield from done(held)
            held, size = [], 0
    yield from done(held)


def document_frequency(docs: DataFrame, text: str, vocabularies: list) -> DataFrame:
    """(w, n): in how many documents each word of the vocabularies occurs. vocabularies: broadcast, one for each shard."""
    batch_conf(docs.sparkSession)

    def count(batches):
        seen = Counter()
        for _, got in _swept(batches, 0, vocabularies, lambda words, vocabulary: Counter(x for w in words for x in vocabulary.intersection(w))):
            for c in got:
                seen.update(c)  # words of several shards are counted for each, which only shifts their order
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], ["w", "n"])

    rows = docs.select(F.col(f"`{text}`").cast("binary").alias("t")).mapInArrow(count, "w binary, n long")
    return rows.groupBy("w").agg(F.sum("n").alias("n"))


class Index(NamedTuple):
    """The windows of one benchmark shard under their rarest words. Words are numbered from 1; 0 is any other word."""

    numbers: dict[bytes, int]
    words: np.ndarray  # of the items, end to end
    first: np.ndarray  # by word: where its windows begin below; those of the next word follow
    at: np.ndarray  # where a window begins in words
    size: np.ndarray  # its words
    offset: np.ndarray  # of the rarest word in it
    owned: np.ndarray  # by window: where its owners begin below; those of the next window follow
    owner: np.ndarray  # numbers of items
    items: list[str]  # sorted


def _alike(words: np.ndarray, at: np.ndarray, size: np.ndarray, window: int) -> np.ndarray:
    """A number for each window, the same for equal ones: those of a hash, where all of its windows are equal."""
    h = size.astype(np.uint64)
    for j in range(window):
        w = np.where(j < size, words[at + np.minimum(j, size - 1)], 0).astype(np.uint64)
        h = (h ^ w) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    _, first, number = np.unique(h, return_index=True, return_inverse=True)
    other = np.zeros(len(at), bool)
    for j in range(window):
        step, there = np.minimum(j, size - 1), first[number]
        other |= (size != size[there]) | (words[at + step] != words[at[there] + np.minimum(step, size[there] - 1)])
    number[other] = len(first) + np.arange(other.sum())  # equal hashes of unequal windows: each stays alone
    return number


def prefix_index(items: list[tuple[str, bytes]], frequency: dict[bytes, int], window: int) -> Index:
    numbers: dict[bytes, int] = {}
    split = [(item, words) for item, text in items if (words := words_of(text))]
    names = sorted({item for item, _ in split})
    name_of = {item: i for i, item in enumerate(names)}
    texts = [np.fromiter((numbers.setdefault(w, len(numbers) + 1) for w in words), np.int32, len(words)) for _, words in split]
    words, length = np.concatenate([*texts, np.zeros(0, np.int32)]), np.array([len(t) for t in texts], np.int64)
    size = np.minimum(length, window)
    count = length - size + 1
    owner = np.repeat(np.array([name_of[item] for item, _ in split], np.int64), count)
    at = np.repeat(np.cumsum(length) - length - (np.cumsum(count) - count), count) + np.arange(len(owner))
    size = np.repeat(size, count)
    if len(at):
        number = _alike(words, at, size, window)
        order = np.lexsort((owner, number))
        new = np.concatenate(([True], np.diff(number[order]) != 0))
        distinct = np.concatenate(([True], (np.diff(number[order]) != 0) | (np.diff(owner[order]) != 0)))
        starts, owner = np.flatnonzero(new), owner[order][distinct]
        owned = np.append(np.cumsum(distinct)[starts] - 1, distinct.sum())
        at, size = at[order][starts], size[order][starts]
    else:
        owned = np.zeros(1, np.int64)
    seen, rank = np.zeros(len(numbers) + 1, bool), np.zeros(len(numbers) + 1, np.int64)
    for r, w in enumerate(sorted(numbers, key=lambda w: (frequency.get(w, 0), w))):
        rank[numbers[w]], seen[numbers[w]] = r, frequency.get(w, 0) > 0
    offset, least = np.zeros(len(at), np.int64), rank[words[at]]
    for j in range(1, window):
        there = rank[words[at + np.minimum(j, size - 1)]]
        offset[there < least] = j
        least = np.minimum(least, there)
    rare = words[at + offset]
    order = np.argsort(rare, kind="stable")
    order = order[seen[rare[order]]]  # a word that no document has needs no probe
    first = np.searchsorted(rare[order], np.arange(len(numbers) + 2))
    owners = np.diff(owned)[order]
    take = np.repeat(owned[:-1][order] - (np.cumsum(owners) - owners), owners) + np.arange(owners.sum())
    return Index(numbers, words, first.astype(np.int32), at[order].astype(np.int32), size[order].astype(np.int16), offset[order].astype(np.int16), np.concatenate(([0], np.cumsum(owners))).astype(np.int64), owner[take].astype(np.int32), names)


def hits(words: list[bytes], index: Index) -> tuple[list[tuple[int, int]], list[str]]:
    """Merged spans of words inside occurring windows, and the items these windows belong to."""
    n = len(words)
    ids = np.fromiter(map(index.numbers.get, words, repeat(0)), np.int32, n)
    each = index.first[ids + 1] - index.first[ids]
    probes = np.flatnonzero(each)
    spans: set[tuple[int, int]] = set()
    found: list[np.ndarray] = []
    for part in np.split(probes, np.flatnonzero(np.diff(np.cumsum(each[probes], dtype=np.int64) // _PROBES)) + 1):
        k = each[part]
        e = np.repeat(index.first[ids[part]] - (np.cumsum(k) - k), k) + np.arange(k.sum())
        start, size = np.repeat(part, k) - index.offset[e], index.size[e].astype(np.int64)
        fits = (start >= 0) & (start + size <= n)
        e, start, size = e[fits], start[fits], size[fits]
        for j in range(int(size.max(initial=0))):  # word for word; few candidates outlive the first
            step = np.minimum(j, size - 1)
            same = ids[start + step] == index.words[index.at[e] + step]
            e, start, size = e[same], start[same], size[same]
        spans.update(zip(start.tolist(), (start + size).tolist(), strict=True))
        found.append(np.unique(e))
    if not spans:
        return [], []
    windows = np.unique(np.concatenate(found))
    owners = np.unique(np.concatenate([index.owner[index.owned[w] : index.owned[w + 1]] for w in windows.tolist()]))
    return merged(spans), [index.items[i] for i in owners.tolist()]


def merged(spans: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", window: int = WINDOW, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """docs as column ``row``, and ``m``: n_words, spans of hit words, ids of the items found."""
    context = docs.sparkSession.sparkContext
    bench = save(benchmark.select(F.col(f"`{item}`").cast("string").alias("item"), F.col(f"`{item_text}`").cast("binary").alias("text")).where("item is not null and text is not null").distinct())
    shards = int((bench.agg(F.sum(F.length("text") + 16)).first()[0] or 0) // shard_bytes) + 1

    def part(k: int) -> list[tuple[str, bytes]]:
        rows = bench.where(F.pmod(F.xxhash64("item", "text"), F.lit(shards)) == k) if shards > 1 else bench
        return [(r.item, bytes(r.text)) for r in rows.collect()]

    vocabularies = [context.broadcast(frozenset(w for _, t in part(k) for w in words_of(t))) for k in range(shards)]
    frequency = document_frequency(docs, text, vocabularies)
    if shards > 1:
        frequency = save(frequency)
    indexes = []
    for k in range(shards):
        own = frequency if shards == 1 else frequency.join(F.broadcast(docs.sparkSession.createDataFrame([(w,) for w in vocabularies[k].value], "w binary")), "w", "left_semi")
        indexes.append(context.broadcast(prefix_index(part(k), {bytes(r.w): r.n for r in own.collect()}, window)))  # bounded by the shard's vocabulary

    def each(words, index):
        return [(len(w), *hits(w, index)) for w in words]

    batch_conf(docs.sparkSession)
    source = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(f"`{text}`").cast("binary").alias("text"))
    kinds = [to_arrow_type(f.dataType) for f in METRICS.fields]

    def run(batches):
        for b, got in _swept(batches, 1, indexes, each):
            rows = [(found[0][0], merged(s for f in found for s in f[1]), found[0][2] if len(found) == 1 else sorted(set().union(*(f[2] for f in found)))) for found in zip(*got, strict=True)]
            cols = [pa.array(c, t) for c, t in zip(list(zip(*rows, strict=True)) or [(), (), ()], kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.StructArray.from_arrays(cols, METRICS.names)], ["row", "m"])

    return source.mapInArrow(run, T.StructType([source.schema["row"], T.StructField("m", METRICS)]))


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    none = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("end"))
    n_hit = F.aggregate(F.array_sort("m.spans"), none, lambda a, s: F.struct((a.n + F.greatest(F.lit(0), s[1] - F.greatest(a.end, s[0]))).alias("n"), F.greatest(a.end, s[1]).alias("end"))).n
    return found.select(
        "row.doc_id",
        "m.n_words",
        n_hit.alias("n_hit"),
        F.size("m.items").cast("long").alias("n_items"),
        F.sha2(F.array_join("m.items", ","), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
        F.col("m.items").alias("items"),
    )
