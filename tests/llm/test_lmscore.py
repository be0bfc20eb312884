"""Language-model scores against plain loops, gradients against differences, and held-out texts against word counts."""

from __future__ import annotations

import math
import re
import subprocess
import sys
import zlib
from collections import Counter

import numpy as np
import pytest
import tiktoken

from lithic.llm import attention, lmscore

KIND = "doc_id long, text string, n_tokens string, row long"


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t)


def words_of(t):
    return re.findall(r"[^\x20\x09-\x0D]+", lower(t or ""))


def out_of_fold(i):
    return zlib.crc32(("null" if i is None else str(i)).encode()) % 5 == 1


def rows_of():
    rng = np.random.default_rng(4)
    syllables = ["ba", "né", "tor", "um", "li", "世界", "Qu"]
    word = lambda: "".join(rng.choice(syllables, rng.integers(1, 4)))
    rows = [(i, " ".join(word() for _ in range(int(rng.integers(1, 90)))) + "\n end\x0bof\ttext", "", 1) for i in range(60)]
    rows += [(100, None, "", 1), (101, "", None, 1), (102, " \n\t", "", 1), (None, "no id", "", 1), (3, rows[3][1], "", 1), (3, "other text", "", 1), (103, "x" * 3000 + " y\xa0z", "", 1), (104, " ".join(word() for _ in range(4000)), "", 1)]
    return rows


@pytest.fixture(scope="module")
def file():
    with open(lmscore.default_tokenizer(), "rb") as f:
        return f.read()


def test_gradient():
    rng = np.random.default_rng(0)
    w = {k: x.astype(np.float64) for k, x in attention.initial(np.full(12, 1 / 12), 3, context=5, width=4, heads=2, hidden=6).items()}
    x, y, keep = rng.integers(0, 12, (3, 5)), rng.integers(0, 12, 15), np.array([0, 1, 3, 4, 7, 9, 14])
    g, loss = attention.gradient(w, x, y[keep], keep)
    assert loss == pytest.approx(-attention.logs({k: t.astype(np.float32) for k, t in w.items()}, x, y[keep], keep).mean(), rel=1e-5)
    for k in w:
        for _ in range(3):
            i = tuple(rng.integers(0, s) for s in w[k].shape)
            old, ends = w[k][i], []
            for e in (1e-4, -1e-4):
                w[k][i] = old + e
                ends.append(attention.gradient(w, x, y[keep], keep)[1])
            w[k][i] = old
            assert g[k][i] == pytest.approx((ends[0] - ends[1]) / 2e-4, rel=2e-3, abs=1e-6)


def test_probabilities_sum_to_one_and_see_nothing_ahead():
    rng = np.random.default_rng(1)
    w = attention.initial(rng.random(12) + 0.1, 3, context=6, width=8, heads=2, hidden=8)
    x = rng.integers(0, 12, (1, 6))
    at = np.array([3])
    assert sum(np.exp(attention.logs(w, x, np.array([y]), at))[0] for y in range(12)) == pytest.approx(1, abs=1e-4)
    other = x.copy()
    other[0, 4:] = (other[0, 4:] + 1) % 12
    assert attention.logs(w, x, np.array([5]), at) == attention.logs(w, other, np.array([5]), at)


def test_every_id_is_scored_once_with_most_context(file):
    spelling = lmscore.Spelling.of({}, 1, lmscore.ranks_of(file))
    model = lmscore.Model(attention.initial(spelling.shares, lmscore.CLASSES), spelling, 1, 1, 1)
    rng = np.random.default_rng(2)
    lengths = np.array([0, 1, 31, 32, 33, 55, 56, 57, 200])
    ids = rng.integers(0, lmscore.IDS - 1, lengths.sum()).astype(np.int16)
    got = lmscore.log10_of(model, ids, lengths, steps=3)
    for k, n in enumerate(lengths):
        start = lengths[:k].sum()
        full = [lmscore.IDS, *ids[start : start + n], lmscore.IDS - 1]
        total = 0.0
        for j in range(n + 1):
            window = 0 if j < attention.CONTEXT else 1 + (j - attention.CONTEXT) // lmscore.STEP
            a = window * lmscore.STEP
            x = np.array([full[a : j + 1]])
            total += attention.logs(model.weights, x, np.array([full[j + 1]]), np.array([j - a]))[0]
        assert got[k] == pytest.approx(total / math.log(10), rel=1e-4)


@pytest.mark.parametrize("block", [600, 1 << 24])
def test_scores(spark, file, block):
    rows = rows_of()
    docs = spark.createDataFrame(rows, KIND).repartition(3)
    found, model = lmscore.language_scores(docs, tokens=2000, rates=(0.01,), block=block)
    c, texts = Counter(), 0
    for i, t, *_ in rows:
        if not out_of_fold(i):
            c.update(words_of(t))
            texts += 1
    n, v = sum(c.values()) + texts, len(c) + 1
    assert (model.n, model.distinct, model.texts) == (n, v, texts)
    import public_tokenizers

    encoding = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=lmscore.ranks_of(file), special_tokens={})
    want = []
    for i, t, *_ in rows:
        ws = words_of(t)
        base = sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws) + math.log10((texts + 0.5) / (n + 0.5 * (v + 1)))
        raw = [j for w in ws for a in range(0, len(w) + 1, lmscore.LONG) for j in encoding.encode_ordinary((" " + w)[a : a + lmscore.LONG])]
        raw = np.array(raw, np.int64)
        ids = lmscore.ragged(model.spelling.flat, model.spelling.first[raw], model.spelling.count[raw]) if len(raw) else np.zeros(0, np.int16)
        want.append((i, out_of_fold(i), len(ws) + 1, sum(w in c for w in ws) + 1, base, lmscore.log10_of(model, ids, np.array([len(ids)]))[0]))
    key = lambda r: (r[0] is None, r[0] or 0, r[2], r[4])
    got = [(r.row.doc_id, *tuple(r)[1:]) for r in found.collect()]
    for a, b in zip(sorted(got, key=key), sorted(want, key=key), strict=True):
        assert a[:4] == b[:4]
        assert a[4:] == pytest.approx(b[4:], rel=1e-4)


def test_empty_and_untrained(spark):
    docs = spark.createDataFrame([], KIND)
    assert lmscore.language_scores(docs)[0].collect() == []
    alone = next(i for i in range(100) if out_of_fold(i))
    found, model = lmscore.language_scores(spark.createDataFrame([(alone, "a b", "", 1)], KIND))
    (row,) = found.collect()
    assert (model.n, row.n_tokens, row.n_known, row.base_score) == (0, 3, 0, 0.0) and row.score < 0


def test_query_on_held_out_texts(spark):
    import __spark_entry__ as entry

    found = entry.queries()["op13_language_model"](spark, "/root/testdata/sf0.01").toPandas()
    assert len(found) == spark.read.parquet("/root/testdata/sf0.01/documents.parquet").count()
    held = found[found.held_out]
    print(held[["base_score", "score"]].sum())
    assert held.score.sum() > held.base_score.sum()
    assert np.corrcoef(held.score / held.n_tokens, held.base_score / held.n_tokens)[0, 1] > 0.3


def test_every_training_text_is_learnt_from(spark, monkeypatch):
    """Each once where there are enough for all rounds, else each in every round; held-out texts never."""
    docs = spark.createDataFrame([(i, f"word{i} and others {i % 7}") for i in range(200)], "doc_id long, text string")
    training = docs.where(lmscore.fold("doc_id") != 1).count()
    for tokens, times in ((1, 1), (10**9, 3)):
        seen = []
        monkeypatch.setattr(lmscore, "learn", lambda windows, weights, rates, seen=seen: (seen.append(windows.count()), weights)[1])
        lmscore.language_scores(docs, tokens=tokens)
        assert len(seen) == 3 and sum(seen) == times * training  # a short text is one window


def test_a_text_of_more_new_words_than_a_task_remembers(spark, file, monkeypatch):
    """Windows are the same, however few words are remembered: those of a text that was begun are not forgotten."""
    texts = ["a b c", "a " + " ".join(f"new{i}" for i in range(50)) + " a b c", None, "a new1"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    spelling = lmscore.Spelling.of({}, 1, lmscore.ranks_of(file))
    found = []
    for known in (200_000, 3):
        monkeypatch.setattr(lmscore, "KNOWN", known)
        monkeypatch.setattr(lmscore, "fold", lambda c: lmscore.F.lit(0))
        found.append([tuple(r) for r in lmscore._windows(docs, "text", ["doc_id"], 0, 1, file, spelling, attention.CONTEXT).collect()])
    assert found[0] == found[1] and len(found[0]) > 4


def test_texts_are_cut_into_words_once(spark, file, monkeypatch):
    """Learning reads the ids that were spelled for scoring, and its windows are those of the texts themselves."""
    docs = spark.createDataFrame(rows_of(), KIND).repartition(3)
    seen, plain = [], lmscore._windows
    monkeypatch.setattr(lmscore, "_windows", None)
    monkeypatch.setattr(lmscore, "learn", lambda windows, weights, rates: (seen.append(sorted(bytes(r.window) for r in windows.collect())), weights)[1])
    _, model = lmscore.language_scores(docs, block=600)
    want = plain(docs, "text", ["doc_id"], 0, 1, file, model.spelling, attention.CONTEXT).collect()
    assert len(seen) == 3 and all(s == sorted(bytes(r.window) for r in want) for s in seen)


def test_prepared_weights_give_the_same(file):
    rng = np.random.default_rng(3)
    w = attention.initial(rng.random(12) + 0.1, 3, context=6, width=8, heads=2, hidden=8)
    x, keep = rng.integers(0, 13, (7, 6)), np.arange(2, 42, 3)
    y = rng.integers(0, 12, len(keep))
    assert attention.logs(attention.prepared(w, 6), x, y, keep) == pytest.approx(attention.logs(w, x, y, keep), rel=1e-4)


def test_steps_do_not_page_their_memory_in_again():
    """In a process of its own, since what other code freed counts. Before, a step had over 500 page faults."""
    code = """
import resource
import numpy as np
from lithic.llm import attention
steps = attention.Adam(attention.initial(np.full(1024, 1 / 1024), 32), 0.01)
windows = np.random.default_rng(0).integers(0, 1024, (320, 33))
attention.fit_steps(steps, windows)
before = resource.getrusage(resource.RUSAGE_SELF).ru_minflt
attention.fit_steps(steps, windows)
print((resource.getrusage(resource.RUSAGE_SELF).ru_minflt - before) // 10)
"""
    found = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True, cwd=lmscore.__file__.rsplit("/", 3)[0])
    assert int(found.stdout) < 100
