"""The training-data operators against plain versions, on small tables with nulls, empties, ties and repeats."""

from __future__ import annotations

import hashlib
import html
import re
import struct
import time
import tracemalloc
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
import xxhash

from lithic.llm import common, decontaminate, graph, licences, maintext, nearcopies, passages, quality, repeats, sentencepieces, simhash, substrings, topk, urlrank

DOCS = "doc_id long, text string, n_words string, anchor string"


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t)


@pytest.fixture(scope="module")
def texts():
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(400)]
    some = lambda n: " ".join(rng.choice(words, n))
    passage, long = some(60), some(3000)
    rows = [some(int(n)) for n in rng.integers(1, 120, 30)]
    rows += [f"{some(20)} {passage} {some(30)}", f"{passage} {some(5)}", passage, passage]
    rows += [long, long + " tail", long.replace("w7 ", "w8 "), "", "the " * 90, "x" * 450, "é" * 300 + "ß", f"{some(9)}\n{passage}\t{some(3)}"]
    return [(i, t, "clash", None) for i, t in enumerate(rows)] + [(90, None, None, "a"), (None, "no id here", None, None), (3, rows[3], "clash", None), (3, rows[3], "clash", None)]


@pytest.fixture(scope="module")
def docs(spark, texts):
    return spark.createDataFrame(texts, DOCS).repartition(3).cache()


@pytest.fixture(scope="module")
def query_dir(docs, tmp_path_factory):
    """A folder with documents as the queries read them."""
    at = tmp_path_factory.mktemp("tables")
    docs.write.parquet(f"{at}/documents.parquet")
    return str(at)


def empty(spark):
    return spark.createDataFrame([], DOCS)


def test_decontamination(spark, docs, texts, query_dir):
    shared = " ".join(texts[30][1].split()[20:34])
    items = [(1, shared), (2, "tiny one"), (3, None), (4, ""), (None, shared), (1, shared), (5, texts[40][1] or ""), (6, "the THE the"), (7, texts[0][1])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    word = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t or ""))
    windows = {}
    for i, t in items:
        w = word(t)
        for k in range(max(1, len(w) - 9) if w else 0):
            if i is not None:
                windows.setdefault(tuple(w[k : k + 10]), set()).add(str(i))
    expected = Counter()
    for i, t, *_ in texts:
        w, hit, found = word(t), set(), set()
        for n in {len(k) for k in windows}:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in windows:
                    hit |= set(range(k, k + n))
                    found |= windows[tuple(w[k : k + n])]
        expected[(i, len(w), len(hit), tuple(sorted(found)))] += 1
    for shard in (1 << 20, 400):  # one index, and several
        got = Counter()
        for r in decontaminate.decontaminate(docs, bench, shard_bytes=shard).collect():
            hit = {k for s, e in r.m.spans for k in range(s, e)}
            got[(r.row.doc_id, r.m.n_words, len(hit), tuple(r.m["items"]))] += 1
        assert got == expected
    want = Counter({(i, n, h, len(found), hashlib.sha256(",".join(found).encode()).hexdigest(), h > 0): c for (i, n, h, found), c in expected.items()})
    bench.write.mode("overwrite").parquet(f"{query_dir}/benchmark.parquet")
    got = decontaminate.op1_decontamination(spark, query_dir)
    assert got.columns[:6] == ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    assert Counter(tuple(r)[:6] for r in got.collect()) == want
    assert decontaminate.decontaminate(empty(spark), bench).count() == 0
    assert all(not r.m["items"] for r in decontaminate.decontaminate(docs, bench.limit(0)).collect())


def test_window_index(monkeypatch):
    """Any words, windows and rarities, few candidates at a time or all at once, against every place of every window."""
    rng = np.random.default_rng(12)
    for trial in range(300):
        words, window = [b"a", b"b", b"c", b"dd"][: int(rng.integers(1, 5))], int(rng.integers(1, 7))
        some = lambda most, of: [of[int(k)] for k in rng.integers(0, len(of), int(rng.integers(0, most)))]
        items = [(str(i), b" ".join(some(10, words))) for i in range(int(rng.integers(0, 6)))]
        doc = some(40, [*words, b"zz"])
        monkeypatch.setattr(decontaminate, "_PROBES", (1, 3, 1 << 20)[trial % 3])
        spans, found = decontaminate.hits(doc, decontaminate.prefix_index(items, {w: int(rng.integers(1, 6)) for w in set(doc)}, window))
        hit, holds = set(), set()
        for i, t in items:
            w = t.split()
            for k in range(max(1, len(w) - window + 1) if w else 0):
                part = w[k : k + window]
                at = [p for p in range(len(doc) - len(part) + 1) if doc[p : p + len(part)] == part]
                hit |= {p + j for p in at for j in range(len(part))}
                holds |= {i} if at else set()
        assert found == sorted(holds) and hit == {k for a, b in spans for k in range(a, b)}


def test_shared_windows_are_one():
    """Many items with one prompt cost a document no more than one item, but for their names."""
    rng = np.random.default_rng(2)
    prompt = [f"p{i}".encode() for i in range(20)]
    items = [(str(i), b" ".join([*prompt, f"own{i}".encode()])) for i in range(20_000)]
    doc = [f"d{i}".encode() for i in rng.integers(0, 50, 300)] + prompt + [b"x"] * 280
    index = decontaminate.prefix_index(items, dict.fromkeys([*doc, *prompt], 1), 10)
    assert len(index.at) <= 11 + 1
    began = time.process_time()
    for _ in range(20):
        spans, found = decontaminate.hits(doc, index)
    assert spans == [(300, 320)] and found == sorted(i for i, _ in items) and time.process_time() - began < 1.0


def plain_passages(texts, window):
    words = [(t or "").encode().split() for _, t, *_ in texts]
    seen = Counter(tuple(w[k : k + window]) for w in words for k in range(len(w) - window + 1))
    out = Counter()
    for (i, *_), w in zip(texts, words, strict=True):
        hit = {k + j for k in range(len(w) - window + 1) if seen[tuple(w[k : k + window])] > 1 for j in range(window)}
        out[(i, len(w), len(hit), b" ".join(x for k, x in enumerate(w) if k not in hit))] += 1
    return out


@pytest.mark.parametrize("window", [35, 8])
def test_passages(spark, docs, texts, window):
    got = Counter()
    for r in passages.remove_passages(docs, window=window).collect():
        assert r.row.n_words in ("clash", None)
        got[(r.row.doc_id, r.m.n_words, r.m.n_removed, b" ".join((r.m.kept or "").encode().split()))] += 1
    assert got == plain_passages(texts, window)


def test_automata_locate_passages_word_for_word():
    """In shards of any size; texts that hold a passage in other spacing, overlapping, or but for a word."""
    p = b"a b c d e f"
    texts = [b"x a  b c\td e f y", b"a b c d e", None, b"", b"a b c d e f a b c d e f", b"c d e f g", b"b c d a b c d e f"]
    for shard in (1, 6, 1000):
        got = passages.locate(texts, [(p, None), (b"c d e f g h", [0, 1]), (b"z z b c d e", [2, 3])], 4, shard)
        assert [None if c is None else "".join("-+"[int(x)] for x in c) for _, c in got] == ["-++++++-", "+++++"[:0] + "-++++", None, None, "++++++++++++", "++++-", "---++++++"]


def test_hot_buckets_and_keys(spark, monkeypatch):
    """Rows and keys so many that they are salted: results don't change."""
    monkeypatch.setattr(repeats, "HOT", 3)
    rng = np.random.default_rng(17)
    some = lambda n: " ".join(rng.choice([f"w{i}" for i in range(300)], n))
    p, same = some(50), some(400)
    rows = [(i, f"{some(10)} {p} {some(10)}") for i in range(40)] + [(None, same)] * 30 + [(7, some(3000))]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    monkeypatch.setattr(passages, "dealt", lambda d, t, i: repeats.dealt(d, t, i, 1000))
    monkeypatch.setattr(substrings, "dealt", lambda d, t, i: repeats.dealt(d, t, i, 1000))
    got = Counter((r.row.doc_id, r.m.n_words, r.m.n_removed, b" ".join((r.m.kept or "").encode().split())) for r in passages.remove_passages(df).collect())
    assert got == plain_passages(rows, 35)
    assert Counter((r.row.doc_id, r.m.n_bytes, len(r.m.spans) // 2, bytes(r.m.kept)) for r in substrings.remove_substrings(df).collect()) == plain_substrings(rows)


def test_passage_query(spark, query_dir, texts):
    want = Counter({(i, n, k, hashlib.sha256(kept).hexdigest()): c for (i, n, k, kept), c in plain_passages(texts, 35).items()})
    got = passages.op8_passage_dedup(spark, query_dir)
    assert got.columns == ["doc_id", "n_words", "n_removed", "kept_sha256"] and Counter(map(tuple, got.collect())) == want


def test_passages_empty(spark):
    assert passages.remove_passages(empty(spark)).count() == 0


def plain_substrings(texts):
    raw = [(t or "").encode() for _, t, *_ in texts]
    seen = Counter(t[k : k + 200] for t in raw for k in range(len(t) - 199))
    out = Counter()
    for (i, *_), t in zip(texts, raw, strict=True):
        m = np.zeros(len(t) + 1, int)
        for k in range(len(t) - 199):
            if seen[t[k : k + 200]] > 1:
                m[k] += 1
                m[k + 200] -= 1
        cut = np.cumsum(m)[:-1] > 0
        out[(i, len(t), int((np.diff(np.concatenate(([0], cut.astype(int), [0]))) == 1).sum()), np.frombuffer(t, np.uint8)[~cut].tobytes())] += 1
    return out


@pytest.mark.parametrize("crowd", [2000, 1])
def test_substrings(spark, docs, texts, crowd):
    got = Counter((r.row.doc_id, r.m.n_bytes, len(r.m.spans) // 2, bytes(r.m.kept)) for r in substrings.remove_substrings(docs, crowd=crowd).collect())
    assert got == plain_substrings(texts)


def test_crowded_anchors(spark):
    """A line that many texts share, each with other neighbours, some with the same: more blocks than a text may hold."""
    rng = np.random.default_rng(19)
    line = "".join(rng.choice(list("abcdefgh "), 150))
    some = lambda n: "".join(rng.choice(list("stuvwxyz "), n))
    side = [some(120) for _ in range(4)]
    rows = [(i, (some(100) if i % 3 else side[i % 4]) + line + (some(100) if i % 2 else side[i % 4])) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for crowd in (5, 1):
        got = substrings.remove_substrings(df, crowd=crowd).collect()
        assert Counter((r.row.doc_id, r.m.n_bytes, len(r.m.spans) // 2, bytes(r.m.kept)) for r in got) == plain_substrings(rows)


def test_substrings_empty_and_clashing(spark):
    df = spark.createDataFrame([(1, "x" * 300, 5, "a", 1, "b"), (None, None, None, None, None, None)], "doc_id long, text string, bucket int, t string, salt int, `row` string")
    got = {r.row.doc_id: (r.row.bucket, r.row.t, r.row.salt, r.row.row, r.m.n_bytes) for r in substrings.remove_substrings(df).collect()}
    assert got == {1: (5, "a", 1, "b", 300), None: (None, None, None, None, 0)}
    assert {r.row.row for r in passages.remove_passages(df).collect()} == {"b", None}
    assert substrings.remove_substrings(df.limit(0)).count() == 0


def test_substring_query(spark, query_dir, texts):
    want = Counter({(i, n, n - len(kept), k, hashlib.sha256(kept).hexdigest()): c for (i, n, k, kept), c in plain_substrings(texts).items()})
    got = substrings.op3_substring_suffix_dedup(spark, query_dir)
    assert got.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"] and Counter(map(tuple, got.collect())) == want


def test_suffix_sorting():
    rng = np.random.default_rng(0)
    for _ in range(60):
        w, n, a = int(rng.choice([5, 8, 12, 40, 200])), int(rng.integers(200, 1200)), int(rng.choice([1, 2, 20]))
        t = bytes(rng.integers(97, 97 + a, n).astype(np.uint8))
        t += t[n // 3 : n // 2]
        at = np.arange(len(t) - w + 1)
        weight = rng.integers(1, 3, len(at))
        seen = Counter()
        for s, k in zip(at, weight, strict=True):
            seen[t[s : s + w]] += int(k)
        assert (substrings.repeated_starts(t, at, weight, w) == [seen[t[s : s + w]] > 1 for s in at]).all()
    cover = substrings.difference_cover(32)
    assert {(a - b) % 32 for a in cover for b in cover} == set(range(32))


def test_blocks_of_long_texts(monkeypatch):
    """Parts of long texts and texts together give every window once."""
    rng = np.random.default_rng(1)
    texts = [rng.integers(0, 9, n).astype(np.uint64) for n in (50, 0, 7, 900, 20)]
    scheme = repeats.Scheme(10, 4, None)
    for most, together in ((1 << 22, 1 << 17), (64, 30)):
        monkeypatch.setattr(repeats, "_MOST", most)
        monkeypatch.setattr(repeats, "_TOGETHER", together)
        b = repeats.blocks_of(texts, scheme)
        got = sorted((int(d), int(f) + k) for d, f, n in zip(b.doc, b.first, b.count, strict=True) for k in range(n))
        assert got == [(d, k) for d, t in enumerate(texts) for k in range(max(0, len(t) - 9))]


def plain_fingerprint(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", lower(t or ""))
    shingles = [" ".join(w[k : k + 3]) for k in range(max(1, len(w) - 2))] if w else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints(texts):
    for _, t, *_ in texts:
        assert simhash.fingerprint(None if t is None else t.encode())[0] == plain_fingerprint(t)


def test_simhash_links(spark):
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 63, 12, dtype=np.uint64)
    codes = set(base.tolist()) | {0, (1 << 64) - 1}
    for b in base[:6]:  # dense groups, and chains
        for _ in range(60):
            x = int(b)
            for k in rng.choice(64, int(rng.integers(1, 7)), replace=False):
                x ^= 1 << int(k)
            codes.add(x)
    codes = sorted(codes)
    rows = [(simhash._signed(c), i) for i, c in enumerate(codes)] + [(simhash._signed(codes[0]), 900), (simhash._signed(codes[5]), None)]
    array = np.array(codes, np.uint64)
    root = simhash.forest(len(codes), [(np.full(len(j), i), j) for i in range(len(codes)) if len(j := np.flatnonzero(np.bitwise_count(array ^ array[i]) <= 3))])
    for group in (1000, 10):  # as dealt out once, and again by further bits
        found = {r.fp: r.component_id for r in simhash.near_duplicates(spark.createDataFrame(rows, "fp long, doc_id long"), group=group).collect()}
        assert found == {simhash._signed(c): int(root[i]) for i, c in enumerate(codes)}
    assert simhash.near_duplicates(spark.createDataFrame([], "fp long, doc_id long")).count() == 0


def test_simhash_query(spark, texts, tmp_path):
    """Fingerprints and components of a whole table, one text of it beyond a part's shingles, and names that clash."""
    rng = np.random.default_rng(21)
    long = [f"w{i}" for i in rng.integers(0, 5000, simhash._CHUNK + 500)]
    rows = [(i, t, "fp", "m") for i, t, *_ in texts] + [(700, " ".join(long), "fp", "m"), (701, " ".join(long[:-1]), "fp", "m")]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp string, m string")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    prints = [plain_fingerprint(t) for _, t, *_ in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if (prints[a] ^ prints[b]).bit_count() <= 3:
                root[find(a)] = find(b)
    least = {}
    for k, (i, *_) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(i, least.get(find(k), i))
    want = Counter((i, f"{prints[k]:016x}", least.get(find(k))) for k, (i, *_) in enumerate(rows))
    got = simhash.op9_simhash_near_dedup(spark, str(tmp_path))
    assert got.columns == ["doc_id", "fingerprint", "component_id"] and Counter(map(tuple, got.collect())) == want
    assert {r.row.fp for r in simhash.fingerprints(df).collect()} == {"fp"} and simhash.fingerprints(df.limit(0)).count() == 0


def test_first_of_alike(spark):
    t = " ".join(f"a{i}" for i in range(300))
    rows = [(1, t), (2, t), (3, t.upper()), (4, "something else"), (5, None), (6, ""), (4, "something else")]
    kept = nearcopies.first_of_alike(spark.createDataFrame(rows, "doc_id long, text string"))
    assert kept.columns == ["doc_id", "text"]
    assert sorted(r.doc_id for r in kept.collect()) == [1, 4, 5]
    # groups without ids, and one id on different texts: each group keeps a row
    other = " ".join(f"b{i}" for i in range(300))
    rows = [(None, t), (None, other), (None, other), (7, "one two three"), (7, "four five six seven"), (7, "one two three")]
    kept = nearcopies.first_of_alike(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(r.text for r in kept) == sorted({t, other, "one two three", "four five six seven"})


def test_components(spark):
    rng = np.random.default_rng(2)
    edges = [(i, i + 1) for i in range(0, 60)] + [(100 + int(a), 100 + int(b)) for a, b in rng.integers(0, 80, (60, 2))] + [(500, k) for k in range(501, 560)]
    root = list(range(600))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    for few in (0, 1000):  # in rounds, and in one task
        got = {r.a: r.b for r in graph.components(spark.createDataFrame(edges, "a long, b long"), few=few).collect()}
        assert got == {x: find(x) for x in {y for e in edges for y in e} if find(x) != x}
        assert graph.components(spark.createDataFrame([], "a long, b long"), few=few).count() == 0


def _tops(rows, k=5, every=50):
    """Each query row's best other rows, with whole numbers."""
    x = [(n, i, [c.numerator * 256 // c.denominator for c in (Fraction(float(np.float32(c))) for c in v)]) for n, (i, v) in enumerate(rows) if i is not None and v is not None and all(c is not None and np.isfinite(c) for c in v)]
    out = Counter()
    for n, q, v in x:
        if q % every == 0:
            best = sorted((-sum(a * b for a, b in zip(v, w, strict=False)), i) for m, i, w in x if m != n)[:k]
            out.update((q, r + 1, i, max(-(1 << 63) + 1, min((1 << 63) - 1, -s))) for r, (s, i) in enumerate(best))
    return out


def test_top_k(spark, tmp_path):
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(0, 0.2, 8).tolist()) for i in range(300)] + [(300, None), (301, [None] * 8), (302, [float("nan")] * 8), (303, [float("inf")] * 8), (304, [0.1] * 3), (7, [0.5] * 8), (306, rng.normal(0, 1, 8).tolist()), (None, [0.1] * 8)]
    rows += [(400 + i, rows[50][1]) for i in range(7)]  # ties
    rows += [(50, rows[50][1]), (50, rows[50][1]), (50, rows[7][1]), (100, rows[100][1])]  # rows that share a query's id
    schema = "vec_id long, embedding array<float>"
    for extra in ([], [(350, [1e5] + [0.0] * 7), (450, [3e38] * 8), (451, [-3e38] * 8), (452, [1e9] * 8)]):
        df = spark.createDataFrame(rows + extra, schema).repartition(3)
        for per_round in (4096, 3):
            got = topk.top_k(df, df.where("vec_id % 50 = 0"), 5, per_round=per_round)
            assert Counter(tuple(r) for r in got.collect()) == _tops(rows + extra)
    df.selectExpr("vec_id", "embedding", "'x' as rank", "1 as score").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = topk.op6_exact_topk(spark, str(tmp_path))
    assert got.columns == ["query_id", "rank", "vec_id", "score"] and Counter(tuple(r) for r in got.collect()) == _tops(rows + extra)
    assert topk.top_k(df.limit(0), df.limit(0), 5).count() == 0


def test_pieces_are_the_models():
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=sentencepieces.default_model())
    with open(sentencepieces.default_model(), "rb") as f:
        pieces = sentencepieces.Pieces(f.read(), remember=500)
    rng = np.random.default_rng(6)
    chars, vocabulary = list("aeinotrsh .,1A\né▁😀"), list(pieces.id)
    texts = ["", " ", "  ", "a" * 3000, "\t\n x ", "𓀀é▁ ▁▁x", "ababab" * 50, "http://a.b/c?d=e&f", "\x00a", "    if x == 1:\n        return y"]
    texts += ["".join(rng.choice(chars, int(n))) for n in rng.integers(0, 60, 600)] + ["".join(rng.choice(vocabulary, int(n))) for n in rng.integers(0, 8, 600)]
    ids = pieces.encode([*texts, None])
    assert ids == [*model.encode(texts), None]
    assert [pieces.decode(i) for i in ids[:-1]] == [t.replace("▁", " ") for t in texts]


def test_long_words_take_memory_by_their_length():
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=sentencepieces.default_model())
    with open(sentencepieces.default_model(), "rb") as f:
        pieces = sentencepieces.Pieces(f.read())
    rng = np.random.default_rng(3)
    for word in ("".join(map(chr, rng.integers(0x4E00, 0x5E00, 200_000))), "".join(rng.choice(list("abcdefgh0123+/"), 200_000))):
        tracemalloc.start()
        (ids,) = pieces.encode([word])
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert ids == model.encode(word) and pieces.decode(ids) == word
        assert peak < 200 << 20


def unigram_model(pieces, byte_fallback=False):
    """A serialised unigram vocabulary of these (piece, score); nothing is trained."""

    def number(n):
        return bytes([n]) if n < 128 else bytes([n & 127 | 128]) + number(n >> 7)

    def message(field, body):
        return number(field * 8 + 2) + number(len(body)) + body

    special = [("<unk>", 0.0, 2)] + [(f"<0x{b:02X}>", -20.0, 6) for b in range(256) if byte_fallback]
    out = b"".join(message(1, message(1, p.encode()) + b"\x15" + struct.pack("<f", s) + b"\x18" + number(k)) for p, s, k in [*special, *((p, s, 1) for p, s in pieces)])
    kind = b"\x18\x01" + (number(35 * 8) + b"\x01" if byte_fallback else b"")
    return out + message(2, kind) + message(3, message(1, b"identity") + b"\x18\x01\x20\x00\x28\x01")


@pytest.mark.parametrize("byte_fallback", [False, True])
def test_unigram_pieces_are_the_models(byte_fallback):
    import sentencepiece

    rng = np.random.default_rng(9)
    vocabulary = {"".join(rng.choice(list("abcd"), int(n))) for n in rng.integers(1, 6, 60)} | {"▁", "▁a", "▁ab", "▁▁", "a", "b", "c"}
    model = unigram_model([(p, -float(rng.integers(1, 4000)) / 256) for p in sorted(vocabulary)], byte_fallback)
    library, own = sentencepiece.SentencePieceProcessor(model_proto=model), sentencepieces.Pieces(model)
    assert own.unigram
    texts = ["", " ", "xyz", "aéb 😀", *("".join(rng.choice(list("abcd  d\té"), int(n))) for n in rng.integers(0, 40, 800))]
    assert own.encode(texts) == library.encode(texts)
    if byte_fallback:
        assert [own.decode(i) for i in own.encode(texts)] == texts


def test_sentencepiece_rows(spark, docs, texts):
    got = sentencepieces.encode_decode(docs).collect()
    assert len(got) == len(texts)
    assert all((r.m.ids is None) == (r.row.text is None) for r in got) and all(r.m.round_trip is not False for r in got)
    assert sentencepieces.encode_decode(empty(spark)).collect() == []


def test_sentencepiece_query(spark, query_dir, texts):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=sentencepieces.default_model())
    expected = Counter((i, None if t is None else tuple(model.encode(t)), None if t is None else True) for i, t, *_ in texts)
    got = sentencepieces.op4_sentencepiece(spark, query_dir).collect()
    assert Counter((r.doc_id, None if r.ids is None else tuple(r.ids), r.round_trip) for r in got) == expected
    assert all(r.n_tokens == (None if r.ids is None else len(r.ids)) for r in got)


def test_quality(spark):
    rng = np.random.default_rng(8)
    words = [f"word{i}" for i in range(300)]
    good = lambda: " ".join(rng.choice(words, 80)) + "."
    bad = lambda k: [" ".join(w.upper() + "!!" for w in rng.choice(words, 60)), " | ".join(rng.choice(words, 60)), "same " * 80, " ".join(w + "%%%" for w in rng.choice(words, 60))][k % 4]
    rows = [(i, bad(i) if i % 3 == 0 else good()) for i in range(900)] + [(2000, None), (2001, ""), (None, good())]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 != 0)) for i in range(900)] + [(5, None), (None, 1)], "doc_id long, quality int")
    model = quality.train(d, labels)
    assert 0 < len(model.rules) < 200
    got = quality.score_quality(d, model).select("row.doc_id", "score", (quality.fold("row.doc_id") == 0).alias("held")).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.held and r.doc_id is not None and r.doc_id < 900]
    assert np.mean([(r.score >= 0.3) == (r.doc_id % 3 != 0) for r in held]) > 0.97
    assert quality.train(d, labels.limit(0)).rules == []
    # a labelled id that many rows share counts once, so it doesn't move the model
    assert quality.train(d.union(d.where("doc_id = 7").crossJoin(spark.range(500)).select("doc_id", "text")), labels.union(labels)) == model


def test_quality_query(spark, tmp_path):
    rng = np.random.default_rng(18)
    words = [f"word{i}" for i in range(300)]
    rows = [(i, " ".join(rng.choice(words, 80)) + "." if i % 3 else "same " * 80, "x", 1.0) for i in range(300)] + [(500, None, "x", 1.0), (501, "", "x", 1.0), (502, "many words " * 100_000, "x", 1.0), (3, "same " * 80, "x", 1.0), (None, "a b", "x", 1.0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, m string, score double")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(300)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = quality.op2_quality_classifier(spark, str(tmp_path))
    assert got.columns[:4] == ["doc_id", "held_out", "score", "predicted"]
    found = got.collect()
    assert len(found) == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in found)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in found if r.doc_id is not None)
    held = [r for r in found if r.held_out and r.doc_id is not None and r.doc_id < 300]
    assert np.mean([r.predicted == int(r.doc_id % 3 > 0) for r in held]) > 0.95
    assert len({r.score for r in found if r.doc_id == 3}) == 1  # repeated rows
    model = quality.train(df, spark.read.parquet(f"{tmp_path}/labels.parquet"))
    assert {(r.row.m, r.row.score) for r in quality.score_quality(df, model).collect()} == {("x", 1.0)}
    assert quality.score_quality(df.limit(0), model).count() == 0
    assert quality.train(df.limit(0), spark.read.parquet(f"{tmp_path}/labels.parquet")).rules == []


LICENCE_DOCS = [
    (1, "Text.\nReleased under the MIT License.\nMore."),
    (2, "A. B. Licensed under CC BY-NC 4.0.\nAll rights reserved."),
    (3, None),
    (4, ""),
    (5, "This work is licensed under the GNU General Public License,\nversion 3."),
    (6, licences.SENTENCES["bsd.grant"] + "\n" + licences.SENTENCES["bsd.source"] + " " + licences.SENTENCES["bsd.binary"] + "\n" + licences.SENTENCES["bsd.names"]),
    (7, "the permit of licences is no licence sentence"),
    (8, licences.SENTENCES["bsd.binary"] + " " + licences.SENTENCES["bsd.grant"]),
    (9, "spdx-license-identifier: Apache-2.0"),
]


def test_licences(spark):
    got = {r.row.doc_id: (r.m.ids, r.m.licences) for r in licences.scan(spark.createDataFrame(LICENCE_DOCS, "doc_id long, text string")).collect()}
    assert got[1] == (["mit.name"], ["MIT"])
    assert got[2] == (["cc-by-nc-4.0.name", "reserved"], ["CC-BY-NC-4.0", "All-rights-reserved"])
    assert got[3] == got[4] == got[7] == ([], [])
    assert got[5][1] == ["GPL-3.0"]
    assert got[6][1][0] == "BSD-3-Clause"
    assert got[8] == (["bsd.binary", "bsd.grant"], [])  # out of order
    assert got[9][1] == ["Apache-2.0"]


def test_labelled_pages_are_extracted():
    weights = maintext.default_weights()
    for shape in maintext.SHAPES:
        pages = maintext.labelled_pages(shape)
        assert sum(maintext.extract(p, weights) == t for p, t in pages) >= len(pages) - 2, shape.name
    # fresh pages of each shape, which the weights weren't learnt from
    fresh = [maintext.labelled_pages(maintext.Shape(f"{s.name} again", s.around, s.title), 8) for s in maintext.SHAPES]
    assert np.mean([maintext.extract(p, weights) == t for x in fresh for p, t in x]) > 0.9
    assert maintext.extract(None, weights) == maintext.extract("", weights) == maintext.extract("<nav><a href=/>x</a></nav>", weights) == ""
    page = "<body><div class='ad'>buy now</div><article><h1>A &amp; B</h1><p>one\n two<br>three &amp four<script>x<1</script></p><div class=comments><p>me too</p></div><p>last <b>w</b>ord</article><footer>&copy; x</footer>"
    assert maintext.extract(page, weights) == "A & B\none two three & four\nlast word"
    assert maintext.extract("plain words " + html.escape("<b>"), weights) == "plain words <b>"
    stray = "<nav><a href=/x>menu</a></nav><article><p title=it's>it stays here</p><p data-id='comment-1' class=lead>and this</p></article><footer>end</footer>"
    assert maintext.extract(stray, weights) == "it stays here\nand this"
    own = "<div class='site-header'>shop</div><article><div class='entry-header'><h1>Title of it</h1></div><p>words of the text go on</p></article>"
    assert maintext.extract(own, weights) == "Title of it\nwords of the text go on"


WRAPPERS = ['<div class="page has-sidebar">', '<div class="overflow-hidden">', '<div style="overflow:hidden">', '<div class="col-9 with-sidebar">', '<div class="share-wrapper">', '<div id=content class="search-result">', "<form action=/ method=post>"]


@pytest.mark.parametrize("wrapper", WRAPPERS)
@pytest.mark.parametrize("inner", ["<article>{}</article>", "{}", "<div>{}</div>"])
def test_no_sign_around_an_article_loses_it(wrapper, inner):
    weights = maintext.default_weights()
    lines = ["The title here", "one two three four five six seven. " * 6, "Short one.", "more words of the text go on here and there. " * 8]
    for title in ("h1", "h2"):
        body = f"<{title}>{lines[0]}</{title}>" + "".join(f"<p>{x}</p>" for x in lines[1:])
        page = f"<html><head><title>x</title></head><body><nav><a href=/>home</a><a href=/b>b</a></nav>{wrapper}{inner.format(body)}</{wrapper[1:].split()[0]}><div hidden>not seen</div><div class=hidden-ad><p class=ad>buy</p></div><footer>&copy; x y z</footer></body></html>"
        assert maintext.extract(page, weights) == "\n".join(x.strip() for x in lines)


def test_main_text_rows(spark, tmp_path):
    page = "<nav><a href=/>menu</a></nav><article><h1>Title</h1><p>{}</p></article><footer>the end of it</footer>"
    long = "some words go on " * 40_000
    rows = [(1, "u", page.format("the text of a page"), "t", 1), (1, "u", page.format("the text of a page"), "t", 1), (2, None, None, None, None), (3, "v", "", "t", 2), (None, "w", page.format(long), None, 3), (5, "x", "<p>unclosed <b>words of it", "t", 4)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string, m int")
    want = Counter({(1, "t", "Title\nthe text of a page"): 2, (2, None, ""): 1, (3, "t", ""): 1, (None, None, f"Title\n{long.strip()}"): 1, (5, "t", "unclosed words of it"): 1})
    assert Counter((r.row.page_id, r.row.text, r.m.text) for r in maintext.main_text(df).collect()) == want
    assert maintext.main_text(df.limit(0)).collect() == []
    df.write.parquet(f"{tmp_path}/pages.parquet")
    got = maintext.op5_html_extraction(spark, str(tmp_path))
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    assert Counter((r.page_id, r.text) for r in got.collect()) == Counter({(i, t): n for (i, _, t), n in want.items()}) and all(r.n_chars == len(r.text) for r in got.collect())


def test_region():
    rng = np.random.default_rng(0)
    for _ in range(200):
        s = rng.normal(0, 1, int(rng.integers(1, 15))).tolist()
        a, b = maintext.region(s)
        assert sum(s[a:b]) == pytest.approx(max(0, *(sum(s[i:j]) for i in range(len(s)) for j in range(i, len(s) + 1))))


def test_url_filter(spark):
    rules = urlrank.RULES
    link = lambda *hosts: "".join(f'<a href="https://{h}/x">l</a>' for h in hosts)
    rows = [
        (1, "http://a.example.com/en/1?q#f", link("b.example.org")),
        (2, "https://A.Example.com/en/7x", None),
        (3, "http://b.example.org/fr/1", link("spam.example.org", "x.net")),
        (4, "http://spam.example.org/es/1", link("b.example.org")),
        (5, "http://x.net/de/8", ""),
        (6, "http://example.net/de/8", link("x.net", "x.net", "example.net")),
        (7, None, link("spam.example.org")),
        (8, "no scheme", None),
        (9, "ftp://notcom/en/", None),
        (10, "http://sub.com/en", None),
        (11, "http://friend.info/", link("spam.example.org")),
        (11, "http://friend.info/", link("spam.example.org")),
    ]
    got = [(r.row.page_id, r.m.host, r.m.path, r.m.rule, r.m.verdict) for r in urlrank.judge(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()]
    by = {i: (h, p, r, v) for i, h, p, r, v in got}
    assert len(got) == len(rows)
    assert by[1] == ("a.example.com", "/en/1", "com/en/", "block")
    assert by[2] == ("a.example.com", "/en/7x", "example.com/en/7", "allow")
    assert by[4] == ("spam.example.org", "/es/1", "org/es/", "block")
    assert by[5][2:] == ("net/de/", "allow") and by[6][2:] == ("example.net/de/8", "block")
    assert by[7] == by[8] == ("", "", None, "allow")
    assert by[9][2] is None and by[10][2] is None
    assert by[11] == ("friend.info", "/", None, "block")  # who links to a blocked host alone
    # the ranks against a dense iteration
    hosts = spark.createDataFrame([("a", 1.0, 0.0), ("b", 0.0, 0.0), ("c", 0.0, 1.0), ("d", 0.0, 0.0)], "host string, good double, bad double")
    edges = spark.createDataFrame([("a", "b", 2), ("a", "d", 1), ("b", "c", 1), ("d", "b", 1)], "src string, dst string, n long")
    names = "abcd"
    m = np.zeros((4, 4))
    for s, d, n in [("a", "b", 2), ("a", "d", 1), ("b", "c", 1), ("d", "b", 1)]:
        m[names.index(s), names.index(d)] = n
    want = {}
    for label, w, seed in (("trust", m, np.array([1.0, 0, 0, 0])), ("distrust", m.T, np.array([0, 0, 1.0, 0]))):
        p = np.divide(w, w.sum(axis=1, keepdims=True), out=np.zeros_like(w), where=w.sum(axis=1, keepdims=True) > 0)
        r = seed
        for _ in range(urlrank.ROUNDS):
            r = urlrank.DAMPING * r @ p
            r = r + (1 - r.sum()) * seed
        want[label] = r
    for r in urlrank.propagate(hosts, edges).collect():
        assert r.trust == pytest.approx(want["trust"][names.index(r.host)]) and r.distrust == pytest.approx(want["distrust"][names.index(r.host)])
    assert len(rules) == 5


def _judged(url):
    """Host, path and the rule of a url, by hand."""
    if url is None or "://" not in url:
        return "", "", None
    rest = url.split("://", 1)[1]
    host = re.split("[/?#]", rest, maxsplit=1)[0]
    path = re.split("[?#]", rest[len(host) :], maxsplit=1)[0]
    host = lower(host)
    fits = [r for r in urlrank.RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return host, path, max(fits, key=lambda r: len(r.name)) if fits else None


def test_url_query(spark, tmp_path):
    rng = np.random.default_rng(23)
    parts = [["http://", "https://", "ftp://", "", "x"], ["a.example.com", "EXAMPLE.com", "example.net", "b.net", "c.org", "com", "notcom", "d.info", ""], ["", "/", "/en/", "/en/7", "/de/8x", "/de/", "/es/1", "/EN/"], ["", "?q=/en/", "#/de/", "?a#b"]]
    urls = ["".join(rng.choice(p) for p in parts) for _ in range(300)] + [None, "", "://", "http://h.org/a://b.net/de/"]
    long = "<p>words</p>" * 50_000 + '<a href="//a.example.com/x">l</a>'
    rows = [(i, u, [None, "", "<a href=/rel>x</a>", '<a href="http://b.net/y">y</a>'][i % 4], "h", "v") for i, u in enumerate(urls)] + [(900, "http://d.info/", long, "h", "v"), (None, None, None, None, None), (3, urls[3], None, "h", "v")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, host string, verdict string")
    df.write.parquet(f"{tmp_path}/pages.parquet")
    got = urlrank.op10_url_filter(spark, str(tmp_path))
    assert got.columns == ["page_id", "host", "path", "rule", "verdict"]
    found = got.collect()
    want = Counter((i, h, p, r.name if r else None) for i, u, *_ in rows for h, p, r in [_judged(u)])
    assert Counter((r.page_id, r.host, r.path, r.rule) for r in found) == want
    verdict = {r.name: r.verdict for r in urlrank.RULES}
    assert all(r.verdict == verdict[r.rule] if r.rule else r.verdict in ("allow", "block") for r in found)
    assert all(r.verdict == "allow" for r in found if r.host == "" and r.rule is None)
    own = {(r.row.host, r.row.verdict) for r in urlrank.judge(df).collect()}
    assert own == {("h", "v"), (None, None)} and urlrank.judge(df.limit(0)).count() == 0
    # as many allowed as blocked pages: the host is no seed, and its other pages are allowed
    tied = spark.createDataFrame([(1, "http://t.net/de/", None), (2, "http://t.net/en/", None), (3, "http://t.com/en/", None), (4, "http://s.example.net/de/8", None), (5, "http://s.example.net/de/1", None), (6, "http://s.example.net/x", None)], "page_id long, url string, html string")
    assert {r.row.page_id: r.m.verdict for r in urlrank.judge(tied).collect()}[6] == "allow"


def test_intermediates_go_to_a_shared_folder(spark, monkeypatch):
    class Context:
        master, getConf = "spark://elsewhere:7077", staticmethod(dict)

    class Session:
        conf, sparkContext = {}, Context

    with pytest.raises(RuntimeError):
        common.shared_dir(Session)
    assert common.shared_dir(spark)


def test_digest_columns(spark):
    """The thin queries on the smallest tables: names, and that every row is there."""
    from lithic.llm.queries import QUERIES

    d = "/root/testdata/sf0.001"
    n = spark.read.parquet(f"{d}/documents.parquet").count()
    got = QUERIES["op8_passage_dedup"](spark, d)
    assert got.columns == ["doc_id", "n_words", "n_removed", "kept_sha256"] and got.count() == n
    assert hashlib.sha256(b"").hexdigest() == "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"
