"""SentencePiece encoding and decoding by a shared-prefix Viterbi pass.

A text is cut into marked words (a run of space marks and what follows up to the next mark); no piece of the
vocabulary has a mark after another character, so no piece spans two words. The distinct words of a batch are sorted,
which lays them out as a trie in depth-first order: what one word shares with the next from its start is a common path,
and the forward states along it are kept. A state is the last piece of its prefix's encoding; pieces lead back from the
word's end to its start, so a word costs memory in proportion to its length.

For a unigram vocabulary the forward states carry the best sum of scores, as Viterbi has it. The vocabulary at hand is
of the BPE kind: its scores are merge ranks, and the path with the best sum isn't what the model encodes. What does
hold for BPE is that a sequence of pieces is the encoding of its text exactly if each two neighbours are the encoding of
theirs, and that every prefix has one encoding. So there the forward recursion keeps, of all pieces that end at a place,
the one that may follow the state at its start. Whether two pieces may be neighbours is found by merging them once, and
remembered.

Cases: null has no ids (null), an empty text an empty list; characters outside the vocabulary become byte pieces, or
the unknown piece where the vocabulary has none (a run of them is one); decoding gives the text back, except that the
mark itself (U+2581) comes back as a space, as the model defines, and unknown pieces as the model's sign for them.
Repeated rows are each encoded; equal texts have equal ids. Very long texts, and very long words in them, take memory in
proportion to their length. An empty table gives an empty one; df's columns keep their names inside ``row``, whatever
they are. Ties of a unigram vocabulary go to the longer last piece.
"""

from __future__ import annotations

import re
from itertools import chain

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lithic.llm.common import annotate, table

MARK = "▁"
_WORDS = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
#: Words, and characters of words, whose encodings are remembered; and pairs of pieces.
REMEMBER, CHARACTERS, PAIRS = 600_000, 12_000_000, 1_500_000
METRICS = T.StructType([T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("round_trip", T.BooleanType())])


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def _fields(message: bytes):
    """(number, value) of a serialised message's fields; value: an integer, or bytes."""
    at = 0

    def integer() -> int:
        nonlocal at
        out = shift = 0
        while True:
            b = message[at]
            at += 1
            out |= (b & 127) << shift
            shift += 7
            if b < 128:
                return out

    while at < len(message):
        number, kind = divmod(integer(), 8)
        if kind == 0:
            yield number, integer()
        else:
            size = {1: 8, 5: 4}.get(kind) or integer()
            yield number, message[at : at + size]
            at += size


def is_unigram(model: bytes) -> bool:
    """A model's trainer settings are its field 2, of which field 3 is the kind: 1 (also if unset) is
    unigram, 2 is BPE."""
    kind = next((k for n, spec in _fields(model) if n == 2 for m, k in _fields(spec) if m == 3), 1)
    if kind not in (1, 2):
        raise ValueError("the vocabulary is neither of the unigram nor of the BPE kind")
    return kind == 1


class Pieces:
    """A vocabulary, and the encodings of words met so far."""

    def __init__(self, model: bytes, remember: int = REMEMBER):
        m = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.unigram = is_unigram(model)
        every = range(m.get_piece_size())
        plain = [i for i in every if not (m.is_control(i) or m.is_unknown(i) or m.is_byte(i) or m.is_unused(i))]
        self.id = {m.id_to_piece(i): i for i in plain}
        if any(MARK in p.lstrip(MARK) for p in self.id):
            raise ValueError("a piece spans words")
        self.score = {p: m.get_score(i) for p, i in self.id.items()}
        self.byte = {int(m.id_to_piece(i)[3:5], 16): i for i in every if m.is_byte(i)}
        self.unknown = np.int32(m.unk_id()).tobytes()
        self.missing = min(self.score.values(), default=0.0) - 10  # a fixed value: the score of a character without a piece
        back = {i: p.replace(MARK, " ").encode() for p, i in self.id.items()} | {i: bytes([b]) for b, i in self.byte.items()} | {m.unk_id(): " ⁇ ".encode()}
        self.text = [back.get(i, b"") for i in every]  # what each id stands for; control pieces for nothing
        self.remember = remember
        self.words: dict[str, bytes] = {}  # word -> its ids, 4 bytes each
        self.characters = 0
        self.ids = {p: np.int32(i).tobytes() for p, i in self.id.items()}  # of unknown characters, their byte pieces
        self.follow: dict[str, dict[str, bool]] = {p: {} for p in self.id}  # piece -> piece before it -> may they be neighbours
        self.pairs = 0
        self.ends: dict[str, set[int]] = {}  # last three characters -> lengths of the pieces that end so
        for p in self.id:
            if len(p) > 2:
                self.ends.setdefault(p[-3:], set()).add(len(p))
        self.lengths: dict[str, tuple[int, ...]] = {}

    def merge(self, text: str) -> list[str]:
        """The encoding by merging, best score first and leftmost on ties; for short texts."""
        parts = list(text)
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = self.score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def may_follow(self, a: str, b: str) -> bool:
        self.pairs += 1
        if self.pairs > PAIRS:
            self.pairs = 0
            self.follow = {p: {} for p in self.id}
        return self.merge(a + b) == ([a, b] if a else [b])

    def lengths_of(self, last: str) -> tuple[int, ...]:
        """Lengths, longest first, of the pieces that end in these (up to three) characters; 1 for any character."""
        found = {1} | {n for n in (2, 3) if last[-n:] in self.id and n <= len(last)} | self.ends.get(last, set())
        self.lengths[last] = out = tuple(sorted(found, reverse=True))
        return out

    def spelled(self, character: str) -> bytes:
        """The ids of a character without a piece."""
        if not self.byte:
            return self.unknown
        return np.array([self.byte[b] for b in character.encode()], np.int32).tobytes()

    def _merged(self, word: str, shared: int, last: list[str], scores: list[float]) -> None:
        """Forward states of a BPE vocabulary, from what is shared to the word's end."""
        lengths, follow = self.lengths, self.follow
        for end in range(shared + 1, len(word) + 1):
            tail = word[end - 3 if end > 3 else 0 : end]
            for size in lengths.get(tail) or self.lengths_of(tail):
                start = end - size
                if start < 0:
                    continue
                piece = word[start:end]
                known = follow.get(piece)
                if known is None:
                    if size > 1:
                        continue
                    known = follow[piece] = {}
                    if piece not in self.ids:
                        self.ids[piece] = self.spelled(piece)
                before = last[start]
                fits = known.get(before)
                if fits is None:
                    fits = known[before] = self.may_follow(before, piece)
                    follow = self.follow
                if fits:
                    last.append(piece)
                    break
            else:
                raise AssertionError(f"no piece ends at {end} of {word[:50]!r}")

    def _best(self, word: str, shared: int, last: list[str], scores: list[float]) -> None:
        """Forward states of a unigram vocabulary: the best sum of scores that reaches each place."""
        lengths, score = self.lengths, self.score
        for end in range(shared + 1, len(word) + 1):
            tail, best, chosen = word[end - 3 if end > 3 else 0 : end], None, ""
            for size in lengths.get(tail) or self.lengths_of(tail):
                start = end - size
                if start < 0:
                    continue
                piece = word[start:end]
                s = score.get(piece)
                if s is None:
                    if size > 1:
                        continue
                    s = self.missing
                    if piece not in self.ids:
                        self.ids[piece] = self.spelled(piece)
                s += scores[start]
                if best is None or s > best:
                    best, chosen = s, piece
            last.append(chosen)
            scores.append(best)

    def learn(self, words: set[str]) -> None:
        """Encodes words in sorted order and remembers them. last[i]: the last piece of the encoding of the word's first
        i characters (scores[i]: its sum); what a word shares with the one before it is kept."""
        last, scores, before, forward = [""], [0.0], "", self._best if self.unigram else self._merged
        for word in sorted(words):
            shared, most = 0, min(len(word), len(before))
            while shared < most and word[shared] == before[shared]:
                shared += 1
            del last[shared + 1 :], scores[shared + 1 :]
            forward(word, shared, last, scores)
            path, at = [], len(word)
            while at:
                path.append(self.ids[last[at]])
                at -= len(last[at])
            self.words[word] = b"".join(path[::-1])
            self.characters += len(word)
            before = word

    def marked(self, text: str) -> list[str]:
        return _WORDS.findall(MARK + text.replace(" ", MARK)) if text else []

    def encode_arrays(self, texts: list[str | None]) -> list[np.ndarray | None]:
        cut = [None if t is None else self.marked(t) for t in texts]
        new = set(chain.from_iterable(w for w in cut if w)).difference(self.words)
        if len(self.words) + len(new) > self.remember or self.characters + sum(map(len, new)) > CHARACTERS:  # all are learnt again, so that what the batch needs is there
            self.words.clear()
            self.characters = 0
            new = set(chain.from_iterable(w for w in cut if w))
        self.learn(new)
        out = [None if w is None else np.frombuffer(b"".join(map(self.words.__getitem__, w)), np.int32) for w in cut]
        if not self.byte:  # a run of unknown characters is one unknown piece
            unknown = np.frombuffer(self.unknown, np.int32)[0]
            out = [a if a is None or not len(a) else a[np.concatenate(([True], (a[1:] != unknown) | (a[:-1] != unknown)))] for a in out]
        return out

    def encode(self, texts: list[str | None]) -> list[list[int] | None]:
        return [None if a is None else a.tolist() for a in self.encode_arrays(texts)]

    def decode(self, ids: list[int] | np.ndarray) -> str:
        text = b"".join(map(self.text.__getitem__, ids.tolist() if isinstance(ids, np.ndarray) else ids)).decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text


_loaded: dict[int, Pieces] = {}


def encode_decode(docs: DataFrame, text: str = "text", model: str | None = None, keep: list[str] | None = None) -> DataFrame:
    """docs as column ``row``, and ``m``: ids, and whether decoding them gives the text back. No shuffle; the model
    (a file of fixed size) is broadcast."""
    with open(model or default_model(), "rb") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(texts):
        key = hash(shared.value)
        if key not in _loaded:
            _loaded.clear()
            _loaded[key] = Pieces(shared.value)
        pieces = _loaded[key]
        whole = [None if t is None else t.decode("utf-8", "replace") for t in texts]
        ids = pieces.encode_arrays(whole)
        back = [None if t is None else pieces.decode(i) == t.replace(MARK, " ") for t, i in zip(whole, ids, strict=True)]
        ends = np.cumsum([0, *(0 if i is None else len(i) for i in ids)])
        flat = np.concatenate([np.zeros(0, np.int32), *(i for i in ids if i is not None)])
        lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int32()), mask=pa.array([i is None for i in ids], pa.bool_()))
        return lists, back

    return annotate(docs, text, run, METRICS, keep)


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = encode_decode(table(spark, sf_dir, "documents").select("doc_id", "text"), keep=["doc_id"])
    return found.select("row.doc_id", F.size("m.ids").cast("long").alias("n_tokens"), F.col("m.ids").alias("ids"), "m.round_trip")
