"""Quality classifier: a sparse ensemble of rules.

Statistics of a text (shares of kinds of characters, repetition of words and lines, lengths) are computed in one pass.
Boosted trees of little depth are grown on labelled rows; every path from a root to a node becomes a conjunctive rule
of thresholds; a logistic regression with an L1 penalty keeps few of the rules and weighs them. The rules kept are
compiled into one Spark column over the statistics.

Labels are read from a sample of at most ``sample`` labelled rows (by hashed id, so any growth of the table keeps the
sample's size); everything else covers all rows. Labels, language, source and id are no inputs of the score.

Cases: null and empty texts have all statistics zero and are scored like any other; without labels of both kinds the
score is the labels' mean, or 0.5; of equal labels of one id one counts, and of rows that share a labelled id one (the
least by its statistics), so that what is gathered stays within the sample; a null doc_id counts as the text "null"
for the fold. Repeated rows have equal scores; texts of any length are measured whole; an empty table gives an empty
one; columns keep their names inside ``row``; a score at the threshold counts as reaching it.
"""

from __future__ import annotations

import math
from typing import NamedTuple

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lithic.llm.common import annotate, table

SAMPLE, TREES, DEPTH, PENALTY, THRESHOLD, FOLDS = 20_000, 24, 3, 2e-3, 0.3, 5

STATISTICS = (
    "log_words", "word_length", "distinct_words", "top_word", "repeated_next", "upper", "digits", "marks", "odd_marks", "words_with_marks", "ends_with_marks",
    "shout_words", "lone_marks", "log_lines", "line_words", "distinct_lines", "lines_end", "stops", "spaces", "non_ascii",
)
METRICS = T.StructType([T.StructField(s, T.DoubleType()) for s in STATISTICS])

_UPPER = bytes(range(65, 91))
_DIGIT = b"0123456789"
_ODD = b"#$%&*+/<=>@\\^_`{|}~![]"
_PLAIN = b".,;:'\"()-?"
_LETTERS_OUT = bytes(c for c in range(256) if 48 <= c <= 57 or 65 <= c <= 90 or 97 <= c <= 122 or c >= 128)


def statistics(text: bytes | None) -> tuple[float, ...]:
    if not text:
        return (0.0,) * len(STATISTICS)
    n = len(text)
    words = text.split()
    k = max(1, len(words))
    lines = [x for x in text.split(b"\n") if x.strip()]
    many = max(1, len(lines))
    counts: dict[bytes, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    upper, digits = n - len(text.translate(None, _UPPER)), n - len(text.translate(None, _DIGIT))
    odd, plain = n - len(text.translate(None, _ODD)), n - len(text.translate(None, _PLAIN))
    # words by what they are without letters and digits: few different ones, so they are counted over distinct words
    with_marks = ends = shouts = lone = 0
    for w, c in counts.items():
        rest = w.translate(None, _LETTERS_OUT)
        if rest:
            if len(rest) == len(w):
                lone += c
            elif rest.strip(_PLAIN):
                with_marks += c
            if w[-1:] in b"#$%&*!|" and len(w) > 1:
                ends += c
        if len(w) > 1 and w.isupper():
            shouts += c
    return (
        math.log1p(len(words)),
        sum(map(len, words)) / k,
        len(counts) / k,
        max(counts.values(), default=0) / k,
        sum(map(bytes.__eq__, words[1:], words)) / k,
        upper / n,
        digits / n,
        plain / n,
        odd / n,
        with_marks / k,
        ends / k,
        shouts / k,
        lone / k,
        math.log1p(len(lines)),
        len(words) / many,
        len(set(lines)) / many,
        sum(x.rstrip().endswith((b".", b"!", b"?")) for x in lines) / many,
        text.count(b". ") / k,
        (n - len(text.translate(None, b" \t\r\n"))) / n,
        sum(map(len, text.split())) and (n - len(text.translate(None, bytes(range(128, 256))))) / n,
    )


def with_statistics(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """docs as column ``row``, and ``m``: the statistics. No shuffle."""
    return annotate(docs, text, lambda texts: list(zip(*map(statistics, texts), strict=True)) or [[] for _ in STATISTICS], METRICS, keep)


class Condition(NamedTuple):
    statistic: int
    above: bool
    threshold: float


class Model(NamedTuple):
    base: float
    rules: list[tuple[float, tuple[Condition, ...]]]  # weight, conditions

    def score(self) -> Column:
        """The score as one column over ``m``."""
        total = F.lit(self.base)
        for weight, rule in self.rules:
            hit = F.lit(True)
            for c in rule:
                stat = F.col(f"m.{STATISTICS[c.statistic]}")
                hit = hit & ((stat > c.threshold) if c.above else (stat <= c.threshold))
            total = total + F.when(hit, F.lit(weight)).otherwise(0.0)
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def grow(x: np.ndarray, gradient: np.ndarray, hessian: np.ndarray, rows: np.ndarray, depth: int, cuts: list[np.ndarray], path: tuple[Condition, ...], out: list) -> list[tuple[np.ndarray, float]]:
    """Grows a tree by second-order gain; adds the paths to its nodes to out; returns its leaves' rows and values."""
    g, h = gradient[rows].sum(), hessian[rows].sum()
    leaf = [(rows, -g / (h + 1.0))]
    if depth == 0 or len(rows) < 40:
        return leaf
    best, choice = 1e-6, None
    for s in range(x.shape[1]):
        if not len(cuts[s]):
            continue
        at = np.searchsorted(cuts[s], x[rows, s], side="left")  # 0: at most the first cut
        gs, hs = (np.cumsum(np.bincount(at, weights=v[rows], minlength=len(cuts[s]) + 1))[:-1] for v in (gradient, hessian))
        gain = gs**2 / (hs + 1) + (g - gs) ** 2 / (h - hs + 1) - g**2 / (h + 1)
        n = np.cumsum(np.bincount(at, minlength=len(cuts[s]) + 1))[:-1]
        gain[(n < 15) | (len(rows) - n < 15)] = 0
        if gain.max() > best:
            best, choice = gain.max(), (s, cuts[s][gain.argmax()])
    if choice is None:
        return leaf
    s, t = choice
    low = x[rows, s] <= t
    leaves = []
    for above, part in ((False, rows[low]), (True, rows[~low])):
        deeper = (*path, Condition(s, above, float(t)))
        out.append(deeper)
        leaves += grow(x, gradient, hessian, part, depth - 1, cuts, deeper, out)
    return leaves


def paths_of(x: np.ndarray, y: np.ndarray, trees: int, depth: int) -> list[tuple[Condition, ...]]:
    cuts = [np.unique(np.quantile(x[:, s], np.linspace(0.02, 0.98, 49))) for s in range(x.shape[1])]
    cuts = [c[(c >= x[:, s].min()) & (c < x[:, s].max())] for s, c in enumerate(cuts)]
    margin, out = np.full(len(y), math.log(y.mean() / (1 - y.mean()))), []
    rng = np.random.default_rng(7)
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        rows = np.flatnonzero(rng.random(len(y)) < 0.6)
        for part, value in grow(x, p - y, p * (1 - p), rows, depth, cuts, (), out):
            del part, value
        for part, value in grow(x, p - y, p * (1 - p), np.arange(len(y)), depth, cuts, (), []):
            margin[part] += 0.3 * value
    return list(dict.fromkeys(tuple(sorted(set(r))) for r in out))


def hits_of(x: np.ndarray, rules: list[tuple[Condition, ...]]) -> np.ndarray:
    out = np.ones((len(x), len(rules)), np.float32)
    for j, rule in enumerate(rules):
        for c in rule:
            out[:, j] *= (x[:, c.statistic] > c.threshold) if c.above else (x[:, c.statistic] <= c.threshold)
    return out


def lasso(z: np.ndarray, y: np.ndarray, penalty: float, steps: int = 300) -> tuple[float, np.ndarray]:
    """Logistic regression with an L1 penalty on all but the base, by accelerated proximal gradient steps."""
    n, k = z.shape
    one = np.hstack([np.ones((n, 1), np.float32), z])
    v = np.random.default_rng(0).random(k + 1)
    for _ in range(20):  # the largest curvature
        v = one.T @ (one @ v)
        v /= np.linalg.norm(v)
    rate = 4 * n / float(v @ (one.T @ (one @ v)))
    w = u = np.zeros(k + 1)
    w[0] = u[0] = math.log(y.mean() / (1 - y.mean()))
    t = 1.0
    for _ in range(steps):
        step = u - rate * (one.T @ (1 / (1 + np.exp(-(one @ u))) - y)) / n
        new = np.concatenate((step[:1], np.sign(step[1:]) * np.maximum(np.abs(step[1:]) - rate * penalty, 0)))
        later = (1 + math.sqrt(1 + 4 * t * t)) / 2
        u, w, t = new + (t - 1) / later * (new - w), new, later
    return float(w[0]), w[1:]


def fit(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, penalty: float = PENALTY) -> Model:
    if not len(y) or y.min() == y.max():
        mean = min(max(float(y.mean()) if len(y) else 0.5, 0.001), 0.999)
        return Model(math.log(mean / (1 - mean)), [])
    rules = paths_of(x, y, trees, depth)
    z = hits_of(x, rules)
    scale = np.maximum(z.std(axis=0), 1e-3)
    base, w = lasso(z / scale, y, penalty)
    w = w / scale
    return Model(base, [(float(a), r) for a, r in zip(w, rules, strict=True) if abs(a) > 1e-9])


def fold(id_col: str = "doc_id") -> Column:
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("null")).cast("binary")), F.lit(FOLDS))


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE) -> Model:
    """A model of the labelled rows whose fold isn't 0."""
    known = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & (fold() != 0)).select("doc_id", F.col(label).cast("int").alias("_label")).distinct()
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id", "_label").limit(sample)
    rows = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id")  # at most ``sample`` rows of two numbers
    one = with_statistics(rows, keep=["doc_id", "_label"]).groupBy("row.doc_id", "row._label").agg(F.min("m").alias("m"))
    got = one.select("_label", "m.*").toPandas()  # a row for each label at most
    got = got.sort_values(list(got.columns))  # the fit doesn't hang on the order of partitions
    return fit(got[list(STATISTICS)].to_numpy(float), got["_label"].to_numpy(float))


def score_quality(docs: DataFrame, model: Model, keep: list[str] | None = None) -> DataFrame:
    """docs as column ``row``, and ``score``."""
    return with_statistics(docs, keep=keep).select("row", model.score().alias("score"))


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = score_quality(docs, train(docs, table(spark, sf_dir, "labels")), keep=["doc_id"])
    return found.select("row.doc_id", (fold("row.doc_id") == 0).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
