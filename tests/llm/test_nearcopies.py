"""Near copies by the likeness of their texts, against all pairs."""

from __future__ import annotations

import numpy as np

import corpus_pipeline as pipeline
from lithic.llm import nearcopies, simhash


def _shingles(text: str) -> set[str]:
    w = text.lower().split()
    return {" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def _kept(rows: list[tuple[int, str]]) -> set[int]:
    """The least id of each component of texts with a similarity of 0.8 or more."""
    sets, root = [_shingles(t or "") for _, t in rows], list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                a, b = root[i], root[j]
                root = [b if x == a else x for x in root]
    return {min(rows[i][0] for i in range(len(rows)) if root[i] == r) for r in set(root)}


def _rows() -> list[tuple[int, str]]:
    rng = np.random.default_rng(5)
    words = [f"{a}{b}" for a in "stone river light under bridge slow people town".split() for b in range(40)]
    some = lambda n: list(rng.choice(words, n))
    line, texts = some(20), []
    for n in (60, 90, 200, 400):
        for changed in (1, 2, 3, 4, 5, 6, 8):
            one = some(n)
            for _ in range(3):
                two = list(one)
                for at in rng.choice(n, max(1, changed * n // 200), replace=False):
                    two[at] = "other"
                texts.append(" ".join(two))
            texts += [" ".join(one), " ".join(one).upper()]
    crowd = some(120)
    for k in range(60):  # one large group of near copies, and texts with a common line
        two = list(crowd)
        two[2 * k] = f"x{k}"
        texts += [" ".join(two), " ".join(line + some(15 + k % 3)), " ".join(line + [f"y{k % 7}"])]
    texts += ["", "  ", "one two", "One two", "one two three", *[" ".join(some(70)) for _ in range(40)]]
    order = rng.permutation(len(texts))
    return [(int(i), t) for i, t in zip(order, texts, strict=True)] + [(len(texts), None)]


def test_near_copies_are_found(spark):
    rows = _rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = _kept(rows)
    got = [r.doc_id for r in pipeline.simhash_near_dedup(spark, docs, "").collect()]
    assert sorted(got) == sorted(want)
    assert len(want) < len(rows) - 100


def test_near_copies_with_many_fingerprint_bits(spark):
    """Pairs of a similarity of 0.8 to 0.95 that differ in more than three bits of their fingerprints."""
    rng = np.random.default_rng(7)
    words, rows = [f"w{i}" for i in range(300)], []
    while len(rows) < 40:
        one = list(rng.choice(words, 150))
        two = list(one)
        two[int(rng.integers(20, 60))], two[int(rng.integers(80, 120))] = "other", "another"
        a, b = " ".join(one), " ".join(two)
        x, y = _shingles(a), _shingles(b)
        if 0.8 <= len(x & y) / len(x | y) <= 0.95 and (simhash.fingerprint(a.encode())[0] ^ simhash.fingerprint(b.encode())[0]).bit_count() > 3:
            rows += [(len(rows), a), (len(rows) + 1, b)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = nearcopies.first_of_alike(docs)
    assert kept.columns == ["doc_id", "text"]
    assert sorted(r.doc_id for r in kept.collect()) == list(range(0, 40, 2))


def test_no_links(spark):
    docs = spark.createDataFrame([(1, "a b c d e f"), (2, "g h i j k l"), (None, None), (None, None)], "doc_id long, text string")
    assert sorted(str(r.doc_id) for r in nearcopies.first_of_alike(docs).collect()) == ["1", "2", "None"]


def test_parities_differ_in_no_more_than_the_sets():
    rng = np.random.default_rng(3)
    for n, new in ((0, 1), (5, 2), (150, 30), (150, 400), (5000, 900)):
        a = np.unique(rng.integers(-(1 << 62), 1 << 62, n))
        b = np.unique(np.concatenate((a[new // 2 :], rng.integers(-(1 << 62), 1 << 62, new))))
        differ = sum((int(x) ^ int(y)).bit_count() for x, y in zip(nearcopies.parities(a).view(np.uint64), nearcopies.parities(b).view(np.uint64), strict=True))
        assert 0 < differ <= len(np.setxor1d(a, b))
        assert nearcopies.parities(a).tolist() == nearcopies.parities(a[::-1]).tolist()


def test_copies_of_a_text_that_are_no_copies_of_each_other(spark, monkeypatch):
    """Each is like the text they come from, and some are like each other: the same are kept, of a tenth of the pairs."""
    rng = np.random.default_rng(11)
    one, texts = [f"w{i}" for i in range(150)], []
    for k in range(160):
        two = list(one)
        for place in rng.choice(np.arange(5, 145, 6), 4 if k % 8 else 2, replace=False):
            two[place] = f"new{k}at{place}"
        texts.append(" ".join(two))
    rows, made, kept = list(enumerate(texts)), {}, {}
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    confirmed = nearcopies._confirmed
    for crowd in (nearcopies.CROWD, 10**9):  # 10**9: no group has parities
        count = []
        monkeypatch.setattr(nearcopies, "CROWD", crowd)
        monkeypatch.setattr(nearcopies, "_confirmed", lambda pairs, *a, count=count: (count.append(pairs.count()), confirmed(pairs, *a))[1])
        kept[crowd] = sorted(r.doc_id for r in nearcopies.first_of_alike(docs).collect())
        made[crowd] = sum(count)
    print(made, len(kept[10**9]))
    (few, got), (many, plain) = [(made[c], kept[c]) for c in sorted(made)]
    assert got == plain == sorted(_kept(rows))
    assert 10 * few <= many
