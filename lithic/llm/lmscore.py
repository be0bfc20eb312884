"""Scores of texts by a language model of the corpus, and by its word counts.

Words are counted over all training texts; every text gets the probability that those counts give it, and the one that
a causal self-attention model over subword ids gives it (lithic.llm.attention).

Texts are read once and become numbers of words in blocks of some megabytes, each with its own dictionary. The blocks'
dictionaries, not the texts' words, are what meets by word: a window over a word sums its counts, each distinct word is
cut into subword ids once, and a block's rows return to it. Then a block's texts are looked up by array steps and become
the model's ids, once: learning and scoring read these and know no words. A frequent word is one row in each block, so no
word is a hot key.

The model's ids are the 256 byte pieces and the most frequent pieces of the training texts; other pieces are spelled in
bytes, so any text has a probability. Counts of all training texts choose the ids and start the output's biases; the
other weights are learnt from all training texts too. Each round takes its share of them, so that every text is learnt from
once; where a share would have fewer than ``tokens`` ids, every round takes all. Each task takes a pass over its part of the
round; the tasks' weights are averaged by place, and the next round starts from there. A text is scored in windows that overlap: each id once, by the window
that shows it the most text before it.

Cases: null and empty texts, and texts of white space, have only the end; repeated rows are scored alike and each counts
in training; a null doc_id counts as the text "null" for the fold; a text of any length is scored whole, in memory in
proportion to it; without training texts all counts are zero and the model is as it starts. An empty table gives an
empty one; other columns keep their names inside ``row``.
"""

from __future__ import annotations

import base64
import math
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import tiktoken
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lithic.llm import attention
from lithic.llm.common import batch_conf, drop, save, spread, table
from lithic.llm.quality import fold

#: Ids of the model, classes of ids; ids a window moves on by.
IDS, CLASSES, STEP = 1024, 32, 28
#: Ids of a round at least, where there are as many; ids of a task at least, tasks at most; rates of the rounds.
TOKENS, PART, TASKS, RATES = 1_500_000, 500_000, 256, (0.01, 0.006, 0.003)
#: Bytes of texts in a block, words scored together, windows in one step of the model; characters of a word cut at once.
BLOCK, TOGETHER, STEPS, LONG = 24 << 20, 60_000, 64, 200
#: Words whose ids a task remembers between texts.
KNOWN = 200_000
_DOC = 1 << 40


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def ranks_of(file: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, file.splitlines())}


_encodings: dict[int, tiktoken.Encoding] = {}


def _encoding(file: bytes) -> tiktoken.Encoding:
    key = xxhash.xxh64_intdigest(file)
    if key not in _encodings:
        import public_tokenizers

        _encodings[key] = tiktoken.Encoding("lm", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks_of(file), special_tokens={})
    return _encodings[key]


def pieces_of(word: bytes, encoding: tiktoken.Encoding) -> list[int]:
    """The vocabulary's ids of a word and the space before it."""
    text = " " + word.decode("utf-8", "replace")
    if len(text) <= LONG:
        return encoding.encode_ordinary(text)
    return [i for at in range(0, len(text), LONG) for i in encoding.encode_ordinary(text[at : at + LONG])]


class Spelling(NamedTuple):
    """What the model's ids are: of each of the vocabulary's, the model's ids (flat[first : first + count])."""

    flat: np.ndarray
    first: np.ndarray
    count: np.ndarray
    shares: np.ndarray

    @classmethod
    def of(cls, counts: dict[int, int], texts: int, ranks: dict[bytes, int], size: int = IDS) -> Spelling:
        pieces = {i: p for p, i in ranks.items()}
        byte = [ranks[bytes([b])] for b in range(256)]
        first = set(byte)
        kept = first | set(sorted((i for i in pieces if i not in first), key=lambda i: (-counts.get(i, 0), i))[: size - 1 - 256])
        spelled = {i: [i] if i in kept else [byte[b] for b in pieces[i]] for i in pieces}
        used = dict.fromkeys(kept, 0)
        for i, n in counts.items():
            for j in spelled[i]:
                used[j] += n
        place = {i: k for k, i in enumerate(sorted(kept, key=lambda i: (-used[i], i)))}
        many = np.array([len(spelled.get(i, ())) for i in range(max(pieces) + 1)])
        flat = np.array([place[j] for i in range(max(pieces) + 1) for j in spelled.get(i, ())], np.int16)
        shares = np.array([used[i] + 0.5 for i in place] + [texts + 0.5])
        return cls(flat, np.cumsum(many) - many, many, shares / shares.sum())

    def words(self, raw: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """flat, first, count of words, whose ids of the vocabulary stand in raw one after the other."""
        flat = ragged(self.flat, self.first[raw], self.count[raw])
        word = np.repeat(np.arange(len(lengths)), lengths)
        count = np.bincount(word, weights=self.count[raw], minlength=len(lengths)).astype(np.int64)
        return flat, np.cumsum(count) - count, count


def ragged(flat: np.ndarray, first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The parts flat[first : first + count], one after the other."""
    ends = np.cumsum(count)
    return flat[np.repeat(first - (ends - count), count) + np.arange(ends[-1] if len(ends) else 0)]


class _Numbers(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def blocks_of(docs: DataFrame, text: str, ids: list[str], block: int) -> DataFrame:
    """The texts as numbers of words, and the blocks' dictionaries: (block, at, word, n, row, held_out, words). Rows of a
    dictionary have at = the word's number, and n: how often it is in training texts; texts have at from 2^40."""
    batch_conf(docs.sparkSession)
    row = F.struct(*[F.col(f"`{c}`") for c in ids])
    source = docs.select(row.alias("row"), (fold(ids[0]) == 1).alias("held_out"), F.col(f"`{text}`").cast("binary").alias("text"))
    kind = pa.schema([("block", pa.int64()), ("at", pa.int64()), ("word", pa.binary()), ("n", pa.int64())])

    def run(batches):
        base, k, at = TaskContext.get().partitionId() << 32, 0, 0
        numbers, training, size = _Numbers(), [], 0

        def dictionary(rows: pa.DataType):
            n = np.bincount(np.concatenate(training), minlength=len(numbers)) if training else np.zeros(len(numbers), np.int64)
            columns = [pa.array(np.full(len(numbers), base + k)), pa.array(np.arange(len(numbers))), pa.array(list(numbers), pa.binary()), pa.array(n.astype(np.int64))]
            return pa.RecordBatch.from_arrays([*columns, pa.nulls(len(numbers), rows), pa.nulls(len(numbers), pa.bool_()), pa.nulls(len(numbers), pa.binary())], names)

        names = [*kind.names, "row", "held_out", "words"]
        for b in batches:
            rows = b.column(0).type
            held, words, places, owner = b.column(1).to_pylist(), [], [], []
            for out, t in zip(held, b.column(2).to_pylist(), strict=True):
                found = t.lower().split() if t else []
                got = np.fromiter(map(numbers.__getitem__, found), np.int32, len(found))
                if not out:
                    training.append(got)
                words.append(got.tobytes())
                places.append(_DOC + at)
                owner.append(base + k)
                at, size = at + 1, size + len(t or b"")
                if size > block:
                    yield dictionary(rows)
                    numbers, training, size, k = _Numbers(), [], 0, k + 1
            n = len(words)
            yield pa.RecordBatch.from_arrays([pa.array(owner, pa.int64()), pa.array(places, pa.int64()), pa.nulls(n, pa.binary()), pa.nulls(n, pa.int64()), b.column(0), b.column(1), pa.array(words, pa.binary())], names)
        if numbers:
            yield dictionary(rows)

    return source.mapInArrow(run, f"block long, at long, word binary, n long, row {source.schema['row'].dataType.simpleString()}, held_out boolean, words binary")


def _joined(column: pa.Array, kind) -> tuple[np.ndarray, np.ndarray]:
    """The arrays in a binary column, one after the other, and their lengths."""
    return np.frombuffer(b"".join(column.to_pylist()), kind), pc.binary_length(column).to_numpy(zero_copy_only=False).astype(np.int64) // np.dtype(kind).itemsize


def counted(blocks: DataFrame, file: bytes) -> DataFrame:
    """(block, at, c, once, ids): a dictionary's words with their counts over all training texts and their ids of the
    vocabulary; once is true in one of a word's blocks."""
    every = Window.partitionBy("word")
    rows = blocks.where("word IS NOT NULL").select("block", "at", "word", F.sum("n").over(every).alias("c"), (F.col("block") == F.min("block").over(every)).alias("once"))

    def run(batches):
        encoding, last, held = _encoding(file), None, b""
        for b in batches:
            ids = []
            for w in b.column(2).to_pylist():
                if w != last:
                    last, held = w, np.array(pieces_of(w, encoding), np.int32).tobytes()
                ids.append(held)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(3), b.column(4), pa.array(ids, pa.binary())], ["block", "at", "c", "once", "ids"])

    return rows.mapInArrow(run, "block long, at long, c long, once boolean, ids binary")


def _id_counts(words: DataFrame) -> dict[int, int]:
    """How often the training texts hold each of the vocabulary's ids: as many rows as the vocabulary has, at most."""

    def run(batches):
        for b in batches:
            raw, lengths = _joined(b.column(1), np.int32)
            n = np.bincount(raw, weights=np.repeat(b.column(0).to_numpy(), lengths)).astype(np.int64) if len(raw) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(n)), pa.array(n[n > 0])], ["id", "n"])

    return dict(map(tuple, words.where("once AND c > 0").select("c", "ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n")).collect()))


def _framed(model_ids: int, ids: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The texts' ids with start and end around each, and where each text begins."""
    first = np.cumsum(lengths + 2) - (lengths + 2)
    full = np.empty(int((lengths + 2).sum()), np.int16)
    full[first], full[first + lengths + 1] = model_ids, model_ids - 1
    inside = np.ones(len(full), bool)
    inside[first] = inside[first + lengths + 1] = False
    full[inside] = ids
    return full, first


def _numbered(windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The text of each window and its number there, for so many windows of each text."""
    owner = np.repeat(np.arange(len(windows)), windows)
    return owner, np.arange(len(owner)) - np.repeat(np.cumsum(windows) - windows, windows)


def _cut(spelt: DataFrame, size: int, context: int) -> DataFrame:
    """(key, window) of texts as ids of a model of so many: context + 1 ids, -1 after the end."""

    def run(batches):
        made = 0
        for b in batches:
            ids, lengths = _joined(b.column(0), np.int16)
            full, first = _framed(size, ids, lengths)
            owner, number = _numbered(-(-(lengths + 1) // context))
            ends = (first + lengths + 1)[owner][:, None]
            at = (first[owner] + number * context)[:, None] + np.arange(context + 1)
            windows = np.where(at <= ends, full[np.minimum(at, ends)], np.int16(-1))
            out = [w.tobytes() for w in windows]
            keys = [xxhash.xxh64_intdigest(w, made + i) >> 1 for i, w in enumerate(out)]  # equal windows in different places
            made += len(out)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(out, pa.binary())], ["key", "window"])

    return spelt.select("ids").mapInArrow(run, "key long, window binary")


def _windows(docs: DataFrame, text: str, ids: list[str], share: int, shares: int, file: bytes, spelling: Spelling, context: int) -> DataFrame:
    """_cut of one of so many shares of the training texts, from their words and without blocks: for texts that aren't in
    blocks, and tests hold the windows of those that are against it."""
    chosen = docs.where(fold(ids[0]) != 1).where(F.pmod(F.xxhash64(F.lit(13), *ids, text), F.lit(shares)) == share)
    most = KNOWN

    def run(batches):
        encoding, known = _encoding(file), {}
        for b in batches:
            out = []
            for t in b.column(0).to_pylist():
                words = t.lower().split() if t else []
                if len(known) > most:  # between texts: a text's own words stay until it is cut
                    known.clear()
                for w in words:
                    if w not in known:
                        raw = np.array(pieces_of(w, encoding))
                        known[w] = ragged(spelling.flat, spelling.first[raw], spelling.count[raw]).tobytes()
                out.append(b"".join([known[w] for w in words]))
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["ids"])

    return _cut(chosen.select(F.col(f"`{text}`").cast("binary")).mapInArrow(run, "ids binary"), len(spelling.shares), context)


def learn(windows: DataFrame, weights: attention.Weights, rates: tuple[float, ...] = RATES, batch: int = 32) -> attention.Weights:
    """Rounds over windows: every partition takes a pass from the same weights, and these are averaged by place."""
    for rate in rates:

        def run(batches, w=weights, rate=rate):
            steps, n = attention.Adam(w, rate), 0
            for b in batches:
                found, _ = _joined(b.column(0), np.int16)
                found = found.reshape(b.num_rows, -1).astype(np.int64)
                attention.fit_steps(steps, found, batch)
                n += b.num_rows
            if n:
                flat = steps.all.astype(np.float64)
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat))), pa.array(flat * n), pa.array(np.full(len(flat), n))], ["i", "v", "n"])

        mean = windows.select("window").mapInArrow(run, "i long, v double, n long").groupBy("i").agg((F.sum("v") / F.sum("n")).alias("v"))
        got = mean.toPandas().sort_values("i")["v"].to_numpy()  # as many as the model has weights
        if len(got):
            weights = attention.unflat(got, weights)
    return weights


class Model(NamedTuple):
    weights: attention.Weights
    spelling: Spelling
    n: int
    distinct: int
    texts: int

    def cost(self, c: np.ndarray | int) -> np.ndarray:
        return np.log10((np.asarray(c) + 0.5) / (self.n + 0.5 * (self.distinct + 1)))


def untrained(blocks: DataFrame, words: DataFrame, file: bytes) -> tuple[Model, int]:
    """The model as it starts, after the counts of all training texts, and how many ids these have."""
    total = words.where("once AND c > 0").agg(F.sum("c"), F.count("*")).first()
    texts = blocks.where("words IS NOT NULL AND NOT held_out").count()
    counts = _id_counts(words)
    spelling = Spelling.of(counts, texts, ranks_of(file))
    weights = attention.initial(spelling.shares, CLASSES)
    return Model(weights, spelling, (total[0] or 0) + texts, total[1] + (texts > 0), texts), sum(counts.values()) + texts


def train(spelt: DataFrame, model: Model, every: int, tokens: int = TOKENS, rates: tuple[float, ...] = RATES) -> Model:
    weights = model.weights
    shares = len(rates) if every >= tokens * len(rates) else 1
    tasks = int(min(TASKS, max(1, every // shares // PART)))
    training = spelt.where("NOT held_out").withColumn("share", F.pmod(F.xxhash64(F.lit(13), "row.*", "ids"), F.lit(shares)))
    for k, rate in enumerate(rates):
        windows = _cut(training.where(F.col("share") == k % shares), len(model.spelling.shares), attention.CONTEXT)
        dealt = windows.withColumn("part", F.col("key") % tasks).repartition(tasks, "part")  # no more tasks than parts, however many partitions
        weights = learn(dealt.sortWithinPartitions("part", "key", "window"), weights, (rate,))
    return model._replace(weights=weights)


def log10_of(model: Model, ids: np.ndarray, lengths: np.ndarray, step: int = STEP, steps: int = STEPS) -> np.ndarray:
    """The model's log10 probability of each text; ids: the texts' ids one after the other, without start and end."""
    context, n = attention.CONTEXT, len(lengths)
    full, first = _framed(len(model.spelling.shares), ids, lengths)
    many = lengths + 1  # predictions of a text
    owner, number = _numbered(1 + np.maximum(0, -(-(many - context) // step)))
    out, places, weights = np.zeros(n), np.arange(context), attention.prepared(model.weights)
    for a in range(0, len(owner), steps):
        who, k = owner[a : a + steps], number[a : a + steps]
        at = (k * step)[:, None] + places
        ends = many[who][:, None]
        keep = np.flatnonzero((at < ends) & (places >= np.where(k == 0, 0, context - step)[:, None]))
        x = first[who][:, None] + np.minimum(at, ends - 1)
        got = attention.logs(weights, full[x], full[x.ravel()[keep] + 1].astype(np.int64), keep)
        out += np.bincount(who[keep // context], weights=got, minlength=n)
    return out / math.log(10)


def spelled(blocks: DataFrame, words: DataFrame, model: Model) -> DataFrame:
    """row, held_out, n_tokens, n_known, base_score of every text, and its ids of the model, without start and end."""
    spark = blocks.sparkSession
    row = blocks.schema["row"].dataType.simpleString()
    texts = blocks.where("words IS NOT NULL").select("block", "at", F.lit(None).cast("long").alias("c"), F.lit(None).cast("binary").alias("ids"), "row", "held_out", "words")
    both = words.select("block", "at", "c", "ids", F.lit(None).cast(row).alias("row"), F.lit(None).cast("boolean").alias("held_out"), F.lit(None).cast("binary").alias("words")).union(texts)
    many = blocks.select("block").distinct().count()
    end_cost, end_known = float(model.cost(model.texts)), int(model.texts > 0)

    def lookup(parts):
        c = np.concatenate([x[0] for x in parts]) if parts else np.zeros(0, np.int64)
        raw = np.concatenate([x[1] for x in parts]) if parts else np.zeros(0, np.int32)
        lengths = np.concatenate([x[2] for x in parts]) if parts else np.zeros(0, np.int64)
        return (model.cost(c), c > 0, *model.spelling.words(raw, lengths))

    def spell(held, found):
        cost, known, flat, first, count = found
        rows, out, words = (pa.concat_arrays([h[i] for h in held]) for i in range(3))
        w, lengths = _joined(words, np.int32)
        doc, n = np.repeat(np.arange(len(lengths)), lengths), len(lengths)
        sums = lambda x: np.bincount(doc, weights=x, minlength=n)
        ids = ragged(flat, first[w], count[w]).astype(np.int16).tobytes()
        ends = [0, *(2 * np.cumsum(sums(count[w]).astype(np.int64))).tolist()]
        spelt = pa.array([ids[s:e] for s, e in zip(ends, ends[1:], strict=False)], pa.binary())
        columns = [pa.array(lengths + 1), pa.array(sums(known[w]).astype(np.int64) + end_known), pa.array(sums(cost[w]) + end_cost), spelt]
        return pa.RecordBatch.from_arrays([rows, out, *columns], ["row", "held_out", "n_tokens", "n_known", "base_score", "ids"])

    def run(batches):
        block, parts, found, held, size = None, [], None, [], 0
        for b in batches:
            of = b.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero((of[1:] != of[:-1]) | ((b.column(1).to_numpy()[1:] >= _DOC) != (b.column(1).to_numpy()[:-1] >= _DOC))) + 1).tolist(), len(of)]
            for s, e in zip(cuts, cuts[1:], strict=False):
                if s == e:
                    continue
                part = b.slice(s, e - s)
                if of[s] != block:
                    if held:
                        yield spell(held, found)
                    block, parts, found, held, size = of[s], [], None, [], 0
                if part.column(1)[0].as_py() < _DOC:
                    parts.append((part.column(2).to_numpy(), *_joined(part.column(3), np.int32)))
                    continue
                found = found or lookup(parts)
                sizes = pc.binary_length(part.column(6)).to_numpy(zero_copy_only=False)
                at = 0
                while at < part.num_rows:  # some texts at a time
                    to = at + 1
                    size += int(sizes[at])
                    while to < part.num_rows and size < 4 * TOGETHER:
                        size += int(sizes[to])
                        to += 1
                    held.append([part.column(i).slice(at, to - at) for i in (4, 5, 6)])
                    at = to
                    if size >= 4 * TOGETHER:
                        yield spell(held, found)
                        held, size = [], 0
        if held:
            yield spell(held, found)

    batch_conf(spark)
    dealt = both.repartition(spread(many, 1, spark), "block").sortWithinPartitions("block", "at")
    return dealt.mapInArrow(run, f"row {row}, held_out boolean, n_tokens long, n_known long, base_score double, ids binary")


def scored(spelt: DataFrame, model: Model) -> DataFrame:
    """row, held_out, n_tokens, n_known, base_score, score of every text."""
    row = spelt.schema["row"].dataType.simpleString()

    def run(batches):
        for b in batches:
            got = log10_of(model, *_joined(b.column(5), np.int16))
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(got)], ["row", "held_out", "n_tokens", "n_known", "base_score", "score"])

    batch_conf(spelt.sparkSession)
    return spelt.mapInArrow(run, f"row {row}, held_out boolean, n_tokens long, n_known long, base_score double, score double")


def language_scores(docs: DataFrame, text: str = "text", ids: list[str] | None = None, tokenizer: str | None = None, tokens: int = TOKENS, rates: tuple[float, ...] = RATES, block: int = BLOCK) -> tuple[DataFrame, Model]:
    """(row, held_out, n_tokens, n_known, base_score, score) of each text, and the model. ids: the columns to keep, the
    first of which decides the fold."""
    ids = ids or ["doc_id"]
    with open(tokenizer or default_tokenizer(), "rb") as f:
        file = f.read()
    blocks = save(blocks_of(docs, text, ids, block))
    words = save(counted(blocks, file))
    model, every = untrained(blocks, words, file)
    spelt = save(spelled(blocks, words, model))
    drop(blocks, words)
    model = train(spelt, model, every, tokens, rates)
    return scored(spelt, model), model


def op13_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, model = language_scores(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("row.doc_id", "held_out", "n_tokens", "n_known", F.lit(model.n).cast("long").alias("train_tokens"), "base_score", "score")
