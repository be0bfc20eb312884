"""Removal of repeated passages of words, located by Aho-Corasick automata.

A window of 35 consecutive words that starts anywhere else too, in the same document or another, is repeated; words
that repeated windows cover are removed. Windows are judged on the input. Recurring passages are confirmed across the
corpus first, and one copy of each is taken from a text that holds it (lithic.llm.repeats). Each bucket of documents is
sent the passages that its blocks point to; they are compiled into automata over word numbers, shards of bounded size,
and all documents of the bucket are streamed through each, which locates every occurrence word for word.

Cases: null and empty texts have no words; texts shorter than a window keep all; repeated rows count as further
occurrences, in whatever number; a null doc_id is carried through. Very long texts are read whole. Which copy of a
passage is taken makes no difference. An empty table gives an empty one; other columns keep their names inside ``row``.
"""

from __future__ import annotations

from itertools import compress

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lithic.llm.common import table
from lithic.llm.repeats import Scheme, Spans, dealt, repeated_blocks, span_of, window_runs, with_texts

WINDOW, GRAM = 35, 12
#: Words of passages in one automaton.
SHARD = 400_000
#: Words whose hashes a worker remembers.
REMEMBER = 500_000


class _Hashes(dict):
    """Hashes of the words met so far."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > REMEMBER:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


_hashes = _Hashes()


def hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))


def symbols(text: bytes) -> np.ndarray:
    return hashes(text.split())


def scheme_of(window: int) -> Scheme:
    return Scheme(window, max(1, min(GRAM, window // 2)), symbols)


def _cut(scheme: Scheme):
    def cut(text: bytes, h: np.ndarray, first: np.ndarray, count: np.ndarray, differ: np.ndarray):
        words, spans = text.split(), Spans(h) if differ.any() else None
        passages = [b" ".join(words[a : a + n + scheme.window - 1]) for a, n in zip(first.tolist(), count.tolist(), strict=True)]
        windows = [spans(np.arange(a, a + n), np.arange(a, a + n) + scheme.window).view(np.int64) if d else None for a, n, d in zip(first.tolist(), count.tolist(), differ.tolist(), strict=True)]
        return passages, windows

    return cut


def _confirm(passages: DataFrame) -> DataFrame:
    """Counts the windows of passages that differ."""
    return window_runs(passages.select("anchor", "block", "n", F.posexplode("windows").alias("off", "w")))


def _automata(passages: list[tuple[bytes, list[int] | None]], window: int, shard: int):
    """(numbers of words, automaton), each of about so many words of the passages' repeated parts."""
    numbers: dict[bytes, int] = {}
    automaton, size = None, 0
    for text, runs in passages:
        words = text.split()
        for s, e in span_of(0, len(words) - window + 1, runs, window):
            automaton = automaton or ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
            automaton.add_word(tuple([numbers.setdefault(w, len(numbers) + 1) for w in words[s:e]]), e - s)
            size += e - s
        if size > shard:
            automaton.make_automaton()
            yield numbers, automaton
            numbers, automaton, size = {}, None, 0
    if automaton:
        automaton.make_automaton()
        yield numbers, automaton


def locate(texts: list[bytes | None], passages: list[tuple[bytes, list[int] | None]], window: int, shard: int = SHARD) -> list[tuple[list[bytes], np.ndarray | None]]:
    """Of each text: its words, and which of them occurrences of the passages' repeated parts cover (None: none)."""
    words = [t.split() if t else [] for t in texts]
    cover: list[np.ndarray | None] = [None] * len(words)
    for numbers, automaton in _automata(passages, window, shard):
        get = numbers.get
        for i, ws in enumerate(words):
            if len(ws) >= window and (found := list(automaton.iter(tuple([get(w, 0) for w in ws])))):
                ends, sizes = np.array(found).T
                if cover[i] is None:
                    cover[i] = np.zeros(len(ws) + 1, np.int64)
                np.add.at(cover[i], ends + 1 - sizes, 1)
                np.add.at(cover[i], ends + 1, -1)
    return [(ws, None if c is None else np.cumsum(c[:-1]) > 0) for ws, c in zip(words, cover, strict=True)]


def remove_passages(docs: DataFrame, text: str = "text", ids: tuple[str, ...] = ("doc_id",), window: int = WINDOW) -> DataFrame:
    """docs' other columns as ``row``, and ``m``: n_words, n_removed, kept (the kept words joined by one space, or the
    text as it was where nothing is removed)."""
    scheme = scheme_of(window)
    docs_ = dealt(docs, text, list(ids))
    refs = repeated_blocks(docs_, scheme, _cut(scheme), _confirm)

    def apply(texts: pa.Table, refs: pa.Table) -> pa.Table:
        raw = texts.column("t").to_pylist()
        n, removed, kept = [], [], []
        for t, (words, cover) in zip(raw, locate(raw, list(zip(refs.column("text").to_pylist(), refs.column("runs").to_pylist(), strict=True)), window), strict=True):
            n.append(len(words))
            removed.append(0 if cover is None else int(cover.sum()))
            kept.append(t if cover is None else b" ".join(compress(words, (~cover).tolist())))
        return pa.table({"row": texts.column("row"), "n_words": pa.array(n, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "kept": pa.array(kept, pa.binary())})

    kind = docs_.docs.schema["row"].dataType.simpleString()
    got = with_texts(docs_, refs, "bucket", apply, f"row {kind}, n_words long, n_removed long, kept binary", row=True)
    return got.select("row", F.struct("n_words", "n_removed", F.col("kept").cast("string").alias("kept")).alias("m"))


def op8_passage_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = remove_passages(table(spark, sf_dir, "documents").select("doc_id", "text"))
    kept = F.array_join(F.filter(F.split("m.kept", r"[ \t-\r]+"), lambda w: w != ""), " ")
    return found.select("row.doc_id", "m.n_words", "m.n_removed", F.sha2(F.coalesce(kept, F.lit("")), 256).alias("kept_sha256"))
