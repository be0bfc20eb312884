"""The pipeline's stages, each against a plain version on its own input."""

from __future__ import annotations

import re
from collections import Counter

import numpy as np

import corpus_pipeline as pipeline


def test_stages(spark, tmp_path):
    rng = np.random.default_rng(11)
    words = [f"{a}{b}" for a in "stone river light under bridge slow people town".split() for b in "abcdefghijklmnopqrst"]
    some = lambda n: " ".join(rng.choice(words, n)) + "."
    bad = lambda: " ".join(w.upper() + "!!" for w in rng.choice(words, 60))
    passage, exam = some(60), some(14)
    rows = [(i, bad() if i % 4 == 0 else some(90), "en", "s", 0) for i in range(400)]
    rows += [(400, rows[1][1], "en", "s", 0), (401, rows[1][1], "de", "t", 0), (402, f"{some(40)} {passage} {some(40)}", "en", "s", 0), (403, f"{some(50)} {passage} {some(20)}", "en", "s", 0), (404, f"{some(30)} {exam} {some(30)}", "en", "s", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i % 4 != 0)) for i in range(400)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, exam)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns, ids, seen = docs.columns, {}, {}
    for name, stage in pipeline.STAGES:
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        seen[name] = docs
        ids[name] = sorted(r.doc_id for r in docs.select("doc_id").collect())
        if name != "sentencepiece":
            assert docs.columns == columns
    clean = {i for i in range(400) if i % 4}
    assert set(ids["quality_classifier"]) == clean | {400, 401, 402, 403, 404}
    assert set(ids["simhash_near_dedup"]) == clean | {402, 403, 404}
    before = {r.doc_id: r.text for r in seen["simhash_near_dedup"].collect()}
    windows = Counter(tuple(w[k : k + 35]) for w in (t.split() for t in before.values()) for k in range(len(w) - 34))
    for r in seen["substring_dedup"].collect():
        w = before[r.doc_id].split()
        hit = {k + j for k in range(len(w) - 34) if windows[tuple(w[k : k + 35])] > 1 for j in range(35)}
        assert r.text == (" ".join(x for k, x in enumerate(w) if k not in hit) if hit else before[r.doc_id])
        assert bool(hit) == (r.doc_id in (402, 403))
    assert set(ids["benchmark_decontamination"]) == clean | {402, 403}
    assert ids["sentencepiece"] == ids["benchmark_decontamination"]
    assert all(r.round_trip for r in seen["sentencepiece"].collect())
    assert re.fullmatch("[a-z_]+", pipeline.STAGES[0][0]) and len(pipeline.STAGES) == 5


def test_stages_on_odd_tables(spark, tmp_path):
    """Nulls in any column, empty and very long texts, ties, repeated rows, clashing names, empty tables."""
    rng = np.random.default_rng(13)
    words = [f"{a}{b}" for a in "stone river light under".split() for b in range(60)]
    some = lambda n: " ".join(rng.choice(words, n)) + "."
    long = " ".join(some(90) for _ in range(300))
    rows = [(i, some(90) if i % 3 else " ".join(w.upper() + "!!" for w in rng.choice(words, 60)), "en", "s", 5) for i in range(200)]
    rows += [(None, None, None, None, None), (None, None, None, None, None), (300, "", None, "s", 0), (301, None, "en", None, None), (302, long, "en", "s", None), (303, "x" * 50_000, "en", "s", 1), (5, rows[5][1], "en", "s", 5), (5, rows[7][1], "en", "s", 5), (None, rows[8][1], None, None, None)]
    names = ["doc_id", "text", "lang", "source", "n_chars"]
    clash = ["m", "row", "t", "bucket", "salt", "score", "node", "kept", "spans", "id"]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in clash)
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(200)] + [(None, 1), (5, None)], "doc_id long, quality int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, some(14)), (None, rows[1][1]), (3, None), (4, "")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for part, kept in (("all", rows), ("none", [])):
        docs = spark.createDataFrame([(*r, *["c"] * len(clash)) for r in kept], schema)
        docs.write.parquet(f"{tmp_path}/{part}")
        docs = spark.read.parquet(f"{tmp_path}/{part}")
        counts = []
        for name, stage in pipeline.STAGES:
            out = stage(spark, docs, str(tmp_path))
            out.write.parquet(f"{tmp_path}/{part}_{name}")
            got = spark.read.parquet(f"{tmp_path}/{part}_{name}")
            if name != "sentencepiece":
                assert got.columns == names + clash and all(set(r) <= {"c"} for r in got.select(*[f"`{c}`" for c in clash]).distinct().collect())
                docs = got
            counts.append(got.count())
        assert counts == sorted(counts, reverse=True) and (counts[-1] > 100 if kept else counts == [0] * 5)
    texts = [r.text for r in spark.read.parquet(f"{tmp_path}/all_simhash_near_dedup").collect()]
    assert sum(not t for t in texts) <= 1 and len(texts) == len(set(texts))  # one of the empty, one of each repeated text
    assert long in texts or long not in [r.text for r in spark.read.parquet(f"{tmp_path}/all_quality_classifier").collect()]
