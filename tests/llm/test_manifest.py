"""The Merkle manifest against a plain tree, built level by level."""

from __future__ import annotations

import hashlib
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lithic.llm import manifest

KIND = "doc_id long, source string, lang string, n_chars long, text string, leaf string, idx long, key string"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([h(*out[-1][i : i + 3]) for i in range(0, len(out[-1]), 3)])
    return out


def path(tree, i):
    out = []
    for nodes in tree[:-1]:
        run = i - i % 3
        out.append((nodes[run:i], nodes[i + 1 : run + 3]))
        i //= 3
    return out


def leaf(row):
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row[:5]))


def plain(rows):
    order = lambda s: (s is not None, (s or "").encode())
    sources = sorted({r[1] for r in rows}, key=order)
    of = {s: sorted((r for r in rows if r[1] == s), key=lambda r: (r[0] is not None, r[0] or 0, leaf(r))) for s in sources}
    trees = {s: levels([leaf(r) for r in of[s]]) for s in sources}
    top = levels([trees[s][-1][0] for s in sources])
    root, out = top[-1][0], []
    for k, s in enumerate(sources):
        for i, r in enumerate(of[s]):
            way = path(trees[s], i) + path(top, k)
            bad = list(r)
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 and r[4] is not None:
                bad[4] = r[4].replace("\n", "")
            value = leaf(bad)
            for before, after in way:
                value = h(*before, value, *after)
            out.append((r[0], leaf(r), trees[s][-1][0], root, h(*(x for b, a in way for x in b + a)), value, value == root))
    return out


@settings(max_examples=60, deadline=None)
@given(n=st.integers(1, 90), height=st.integers(0, 4))
def test_paths_of_a_block(n, height):
    leaves = [h(str(i)) for i in range(n)]
    tree = levels(leaves)
    depth = manifest.levels_of(n, height)
    for start in range(0, n, 3**height) if height and n > 3**height else [0] if n <= 3**height else []:
        part = leaves[start : start + 3**height]
        for i, found in enumerate(manifest.Traversal(part, depth)):
            whole = path(tree, start + i)[:depth]
            assert found == [x for b, a in whole for x in ("".join(b), "".join(a))]
            assert manifest.fold(leaves[start + i], found) == tree[depth][(start + i) // 3**depth]


def test_a_traversal_holds_few_nodes():
    leaves = [h(str(i)) for i in range(3**7)]
    walk = manifest.Traversal(leaves, 7)
    for _ in walk:
        held = sum(map(len, walk.siblings)) + sum(len(w["done"]) + sum(map(len, w["stack"].open if w["stack"] else [])) for w in walk.work)
        assert held <= 2 * 7 * 7
        assert all(len(w["todo"]) < 3 for w in walk.work)


def rows_of(n):
    rows = [(i, "hot" if i % 3 else f"s{i % 7}", ["en", None][i % 2], i % 5, f"line {i}\nnext\n" * (i % 4)) for i in range(n)]
    rows += [(None, None, None, None, None), (None, "", "", 0, ""), (5, "hot", "en", 1, "é\n世"), (5, "hot", "en", 1, "é\n世"), (5, "hot", "en", 1, "other"), (-7, None, "", None, "x\n" * 50000), (10**12, "lone", "en", 3, "a\nb")]
    return [(*r, "clash", 1, "k") for r in rows]


@pytest.mark.parametrize(("height", "per"), [(1, 20), (2, 100000), (8, 30)])
def test_manifest(spark, height, per):
    rows = rows_of(70)
    docs = spark.createDataFrame(rows, KIND).repartition(3)
    found = manifest.manifest(docs, height, per)
    assert sorted(map(tuple, found.collect()), key=str) == sorted(plain(rows), key=str)


def test_one_source_one_row_and_none(spark):
    for rows in ([(1, "a", "en", 1, "t\n")], [(i, None, "en", 1, "t\n") for i in range(4)], [(1, s, "en", 1, "t") for s in "abcd"]):
        docs = spark.createDataFrame([(*r, "", 0, "") for r in rows], KIND)
        assert sorted(map(tuple, manifest.manifest(docs).collect()), key=str) == sorted(plain(rows), key=str)
    assert manifest.manifest(spark.createDataFrame([], KIND)).collect() == []


def test_query_against_sql(spark):
    from tests.oracle import compare

    assert compare(spark, "op12_merkle_manifest", "sf0.001") == ""
