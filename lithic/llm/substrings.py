"""Removal of repeated byte strings, confirmed by blockwise suffix sorting with a difference cover.

A string of 200 bytes that starts anywhere else too, in the same document or another (never across two), is repeated;
bytes that repeated strings cover are removed. Strings are judged on the input. Candidate blocks and their bytes come
from lithic.llm.repeats. Where blocks with one anchor differ, the distinct blocks of many anchors are laid end to end in
a text of bounded size, and the suffixes at their strings' starts are sorted blockwise: suffixes are split by their
first bytes into buckets, one bucket is sorted at a time to the cover's period, and suffixes that still tie are
ordered by the precomputed ranks of a difference-cover sample. Neighbours that agree over 200 bytes are repeats.

Equal strings have equal anchors, so they meet in one such text. An anchor with more distinct blocks than a text may hold
is split by further bytes: strings whose anchor stands at like offsets have more bytes in common around it than the
anchor itself, and go by a hash of these, first in pieces of 16 offsets, then one by one, until parts are small; each
part is sorted. At last the bytes of a passage are compared to those of every document that is said to hold it.

Cases: a null text is empty; texts shorter than a string keep all; repeated rows count as further occurrences, in
whatever number; a null doc_id is carried through. Very long texts are read whole. Which copy of a passage is taken makes
no difference. An empty table gives an empty one; other columns keep their names inside ``row``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lithic.llm.common import save, spread, table
from lithic.llm.repeats import Refs, Scheme, blocks_of, by_doc, dealt, mix, repeated_blocks, span_of, with_texts

WINDOW, GRAM = 200, 32
#: Distinct blocks of one anchor that are sorted in one text; more are split by further bytes.
CROWD = 2000
WIDTHS = (16, 1)
TEXT_BYTES = 1 << 20
PERIOD = 32
BUCKET = 1 << 16

_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def symbols(text: bytes) -> np.ndarray:
    return _BYTE[np.frombuffer(text, np.uint8)]


def scheme_of(window: int) -> Scheme:
    return Scheme(window, max(1, min(GRAM, window // 2)), symbols)


def difference_cover(period: int) -> list[int]:
    """Residues whose differences give all residues, chosen greedily."""
    cover, have = [0], {0}
    while len(have) < period:
        best = max(range(period), key=lambda c: len({d % period for x in cover for d in (c - x, x - c)} - have))
        cover.append(best)
        have |= {d % period for x in cover for d in (best - x, x - best)}
    return sorted(cover)


def shifts(cover: list[int], period: int) -> np.ndarray:
    """shifts[i, j]: the least d with i + d and j + d both in the cover, modulo the period."""
    inside = set(cover)
    return np.array([[next(d for d in range(period) if (i + d) % period in inside and (j + d) % period in inside) for j in range(period)] for i in range(period)])


_COVER = difference_cover(PERIOD)
_SHIFTS = shifts(_COVER, PERIOD)


def _first_words(text: np.ndarray, at: np.ndarray, k: int) -> list[np.ndarray]:
    """The first 8k bytes of each suffix, as k numbers that compare as the bytes do."""
    near = np.lib.stride_tricks.sliding_window_view(text, 8)
    return [np.ascontiguousarray(near[at + 8 * i]).view(">u8").ravel().astype(np.uint64) for i in range(k)]


def _dense(columns: list[np.ndarray]) -> np.ndarray:
    """Ranks of rows, compared by the columns from the first to the last; equal rows rank equal."""
    order = np.lexsort(columns[::-1])
    new = np.zeros(len(order), bool)
    for c in columns:
        s = c[order]
        new[1:] |= s[1:] != s[:-1]
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(new)
    return out


def sample_ranks(text: np.ndarray, n: int, depth: int) -> np.ndarray:
    """Ranks of the suffixes at cover positions by their first ``depth`` bytes at least, by prefix doubling: the
    suffix a period further on is in the sample too. Elsewhere -1; text is padded beyond n."""
    at = np.flatnonzero(np.isin(np.arange(n) % PERIOD, _COVER))
    rank = np.full(n + 2 * depth + 4 * PERIOD, -1, np.int64)
    rank[at] = _dense(_first_words(text, at, PERIOD // 8))
    size = PERIOD
    while size < depth + PERIOD and rank[at].max(initial=0) < len(at) - 1:
        rank[at] = _dense([rank[at], rank[np.minimum(at + size, len(rank) - 1)]])
        size *= 2
    return rank


def order_ties(pos: np.ndarray, group: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """The order of the suffixes by group, and in each group by the sample: all groups at once, by three-way
    quicksort."""
    order = np.argsort(group, kind="stable")
    group = group[order]
    active = np.arange(len(pos))
    while len(active):
        g, p = group[active], pos[order[active]]
        starts = np.flatnonzero(np.concatenate(([True], g[1:] != g[:-1])))
        size = np.diff(np.append(starts, len(g)))
        pivot = np.repeat(p[starts + size // 2], size)
        shift = _SHIFTS[p % PERIOD, pivot % PERIOD]
        side = np.sign(rank[p + shift] - rank[pivot + shift])
        o = np.lexsort((side, np.repeat(np.arange(len(starts)), size)))
        order[active] = order[active][o]
        side, g = side[o], g[o]
        new = np.concatenate(([True], (g[1:] != g[:-1]) | (side[1:] != side[:-1])))
        part = np.cumsum(new) - 1
        group[active] = part
        many = np.bincount(part)[part] > 1
        active = active[many & (side != 0)]
    return order


def repeated_starts(text: bytes, starts: np.ndarray, weight: np.ndarray, window: int) -> np.ndarray:
    """Of the suffixes at starts, which have their first ``window`` bytes in common with others; each counts weight
    times. Buckets of suffixes are sorted one after another."""
    n = len(text)
    words = -(-window // 8)
    padded = np.zeros(n + 2 * window + 8 * PERIOD, np.uint8)
    padded[:n] = np.frombuffer(text, np.uint8)
    rank = sample_ranks(padded, n, window)
    head = _first_words(padded, starts, 1)[0]
    out = np.zeros(len(starts), bool)
    cuts = np.unique(np.sort(head)[:: max(1, BUCKET)])  # splitters: the first bytes of every so many suffixes
    bucket = np.searchsorted(cuts, head, side="right")
    by = np.argsort(bucket, kind="stable")
    edges = np.flatnonzero(np.concatenate(([True], np.diff(bucket[by]) != 0, [True]))) if len(by) else []
    for a, b in zip(edges, edges[1:], strict=False):
        own = by[a:b]
        own = own[order_ties(starts[own], _dense(_first_words(padded, starts[own], PERIOD // 8)), rank)]
        pos = starts[own]
        same = np.ones(max(0, len(pos) - 1), bool)
        for i in range(words):
            live = np.flatnonzero(same)
            if not len(live):
                break
            at = min(8 * i, window - 8) if window >= 8 else 0
            w = _first_words(padded, pos[np.append(live, live + 1)] + at, 1)[0]
            if window < 8:
                w = w >> np.uint64(8 * (8 - window))
            same[live] = w[: len(live)] == w[len(live) :]
        run = np.concatenate(([0], np.cumsum(~same)))
        out[own] = np.bincount(run, weights=weight[own])[run] > 1
    return out


def _cut(scheme: Scheme):
    def cut(text: bytes, h: np.ndarray, first: np.ndarray, count: np.ndarray, differ: np.ndarray):
        return [text[a : a + n + scheme.window - 1] for a, n in zip(first.tolist(), count.tolist(), strict=True)], [None] * len(first)

    return cut


UNIT = "anchor long, block long, off int, key long, id long, n long, place int, text binary"


def split_unit(text: bytes, place: int, window: int, width: int) -> list[tuple[int, int, int, int]]:
    """(first string, end, key, id) of the parts of a block. A part's strings have their anchor at offsets of one class,
    each of so many offsets; the key is a hash of the bytes that all strings of that class have in common."""
    offset = place - np.arange(len(text) - window + 1)
    cuts = np.flatnonzero(np.diff(offset // width, prepend=offset[0] // width + 1))
    out = []
    for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(offset)], strict=True):
        c = int(offset[a]) // width
        at = place - c * width
        digests = xxhash.xxh3_64_intdigest(text[at : at + window - width + 1], c), xxhash.xxh3_64_intdigest(text[a : b + window - 1], b - a)
        out.append((a, b, *(d - (1 << 64) if d >> 63 else d for d in digests)))
    return out


def _split(window: int, width: int):
    def run(batches):
        for b in batches:
            rows = []
            for r in b.to_pylist():
                rows += [(r["anchor"], r["block"], r["off"] + s, key, id_, r["n"], r["place"] - s, r["text"][s : e + window - 1]) for s, e, key, id_ in split_unit(r["text"], r["place"], window, width)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), b.schema.types, strict=True)], b.schema.names)

    return run


def _confirm(scheme: Scheme, crowd: int, text_bytes: int):
    window = scheme.window

    def sort(group: pa.Table) -> pa.Table:
        parts = group.column("text").to_pylist()
        count = np.array([len(p) - window + 1 for p in parts])
        base = np.cumsum([0, *map(len, parts[:-1])])
        off = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        twice = repeated_starts(b"".join(parts), np.repeat(base, count) + off, np.repeat(group.column("n").to_numpy(), count), window)
        edge = np.cumsum(count)
        runs = []
        for e, c in zip(edge.tolist(), count.tolist(), strict=True):
            hit = np.concatenate(([0], twice[e - c : e].astype(np.int8), [0]))
            runs.append(np.flatnonzero(np.diff(hit)).astype(np.int32))
        keep = pa.array([i for i, r in enumerate(runs) if len(r)], pa.int64())
        return pa.table({"key": group.column("key").take(keep), "id": group.column("id").take(keep), "runs": pa.array([r.tolist() for r in runs if len(r)], pa.list_(pa.int32()))})

    def sorted_(units: DataFrame) -> DataFrame:
        """(key, id, runs) of distinct units: (key, id, n, text)."""
        size = units.agg(F.sum(F.length("text"))).first()[0] or 0
        texts = spread(size, text_bytes, units.sparkSession)
        return units.withColumn("k", F.pmod(F.xxhash64("key"), F.lit(texts))).groupBy("k").applyInArrow(sort, "key long, id long, runs array<int>")

    def confirm(passages: DataFrame) -> DataFrame:
        units = passages.select("anchor", "block", F.lit(0).alias("off"), F.col("anchor").alias("key"), F.col("block").alias("id"), "n", "place", "text")
        names, done, split = [c.split()[0] for c in UNIT.split(", ")], None, False
        for width in WIDTHS:
            crowds = save((units.select("key", "id").distinct() if split else units).groupBy("key").agg(F.count("*").alias("c")).where(F.col("c") > crowd).select("key"))
            if not crowds.limit(1).count():
                break
            small = units.join(crowds, "key", "left_anti").select(*names)
            done = small if done is None else done.union(small)
            # a crowd's parts that occur once in all have no repeated string
            parts = save(units.join(crowds, "key", "left_semi").select(*names).mapInArrow(_split(window, width), UNIT))
            again = parts.groupBy("key").agg(F.sum("n").alias("all")).where("all > 1").select("key")
            units, split = save(parts.join(again, "key", "left_semi").select(*names)), True
        if done is None:
            return sorted_(units.select("key", "id", "n", "text")).select(F.col("key").alias("anchor"), F.col("id").alias("block"), "runs")
        every = save(done.union(units))
        found = sorted_(every.groupBy("key", "id").agg(F.sum("n").alias("n"), F.first("text").alias("text")))
        back = every.select("anchor", "block", "off", "key", "id").join(found, ["key", "id"]).select("anchor", "block", "off", F.transform("runs", lambda r: r + F.col("off")).alias("runs"))
        return back.groupBy("anchor", "block").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("off", "runs"))), lambda x: x["runs"])).alias("runs"))

    return confirm


def remove_substrings(docs: DataFrame, text: str = "text", ids: tuple[str, ...] = ("doc_id",), window: int = WINDOW, crowd: int = CROWD, text_bytes: int = TEXT_BYTES) -> DataFrame:
    """docs' other columns as ``row``, and ``m``: n_bytes, spans (removed, as a flat list start, end, ...), kept."""
    scheme = scheme_of(window)
    docs_ = dealt(docs, text, list(ids))
    refs = repeated_blocks(docs_, scheme, _cut(scheme), _confirm(scheme, crowd, text_bytes))

    def apply(texts: pa.Table, refs: pa.Table) -> pa.Table:
        known = Refs(refs)
        runs, passages = known.column("runs").to_pylist(), known.column("text").to_pylist()
        kept = [t or b"" for t in texts.column("t").to_pylist()]
        n, spans = [len(t) for t in kept], [[] for _ in kept]
        blocks = blocks_of([symbols(t) if len(t) >= window else None for t in kept], scheme) if len(known.keys) else None
        hit, at = known.find(blocks) if blocks else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        for doc, part in by_doc(blocks.doc[hit] if blocks else hit):
            own, t = hit[part], kept[doc]
            cut: list[int] = []
            for first, count, k in zip(blocks.first[own].tolist(), blocks.count[own].tolist(), at[part].tolist(), strict=True):
                if not t.startswith(passages[k], first):
                    continue
                for s, e in span_of(first, count, runs[k], window):
                    if cut and s <= cut[-1]:
                        cut[-1] = max(cut[-1], e)
                    else:
                        cut += [s, e]
            edges = [0, *cut, n[doc]]
            spans[doc], kept[doc] = cut, b"".join(t[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
        return pa.table({"row": texts.column("row"), "n_bytes": pa.array(n, pa.int64()), "spans": pa.array(spans, pa.list_(pa.int32())), "kept": pa.array(kept, pa.binary())})

    kind = docs_.docs.schema["row"].dataType.simpleString()
    got = with_texts(docs_, refs, "bucket", apply, f"row {kind}, n_bytes long, spans array<int>, kept binary", row=True)
    return got.select("row", F.struct("n_bytes", "spans", "kept").alias("m"))


def op3_substring_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = remove_substrings(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("row.doc_id", "m.n_bytes", (F.col("m.n_bytes") - F.length("m.kept")).alias("n_removed"), (F.size("m.spans") / 2).cast("long").alias("n_spans"), F.sha2("m.kept", 256).alias("kept_sha256"))
