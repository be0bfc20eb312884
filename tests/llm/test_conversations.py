"""The prefix trie against a plain one."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lithic.llm import conversations

KIND = "conv_id long, turn long, role string, text string, depth string, n long"


def plain(rows):
    own = defaultdict(list)
    for c, turn, role, text, *_ in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(v)] for c, v in own.items()}
    built = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (c % 100 if c >= 0 else -(-c % 100))
        built[c] = tuple(own.get(base, [])[:h] + v[h:])
    members = defaultdict(list)
    for c, s in built.items():
        for d in range(len(s) + 1):
            members[s[:d]].append(c)
    kids = defaultdict(list)
    for k in members:
        if k:
            kids[k[:-1]].append(k)
    leaves, saved = {}, {}
    for k in sorted(members, key=len, reverse=True):
        leaves[k] = sum(leaves[x] for x in kids[k]) if kids[k] else 1
        saved[k] = sum(saved[x] for x in kids[k]) + ((len(members[k]) - 1) * len(k[-1][1]) if k else 0)
    out = []
    for k, m in members.items():
        ends = ",".join(str(c) for c in sorted(m) if len(built[c]) == len(k))
        out.append((min(m), len(k), min(members[k[:-1]]) if k else None, len(m), len(kids[k]), leaves[k], saved[k], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def rows_of(seed, n):
    rng = random.Random(seed)
    rows = []
    for c in range(n):
        if c % 100 == 0 and rng.random() < 0.3:
            continue
        for t in range(rng.choice([1, 2, 3, 5, 8])):
            rows.append((c, t, rng.choice(["user", "assistant", None, ""]), rng.choice(["a", "bé", "世界", None, "", "long " * 50])))
    for c in range(1000, 1000 + n):  # copies, prefixes of each other
        rows += [(c, t, "user", f"t{t}") for t in range(c % 7 + 3)]
    rows += [(c, t, "user", f"shared {t}") for c in (2000, 2001, 2002) for t in range(40)] + [(2002, 40, "user", "more")]
    rows += [(None, 1, "user", "x"), (3000, None, None, None), (3000, 5, "a", "b"), (3000, 7, "a", "b"), (-205, 1, "r", "t"), (-200, 1, "r", "u"), (-250, 0, "r", "t")]
    rng.shuffle(rows)
    return [(*r, "clash", 9) for r in rows]


@pytest.mark.parametrize(("seed", "per", "bucket"), [(1, 17, 3), (2, 5, 4096), (3, 100_000, 10)])
def test_trie(spark, seed, per, bucket):
    rows = rows_of(seed, 120)
    found = conversations.prefix_trie(spark.createDataFrame(rows, KIND).repartition(3), per, bucket)
    assert sorted(map(tuple, found.collect()), key=str) == plain(rows)


def test_few_conversations(spark):
    for rows in ([(7, 0, "u", "t")], [(c, 0, "u", "t") for c in range(40)], [(c, t, "u", f"{t}") for c in (100, 200, 300) for t in range(9)]):
        rows = [(*r, "", 0) for r in rows]
        found = conversations.prefix_trie(spark.createDataFrame(rows, KIND))
        assert sorted(map(tuple, found.collect()), key=str) == plain(rows)
    assert conversations.prefix_trie(spark.createDataFrame([], KIND)).collect() == []


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 4), st.integers(0, 9)), min_size=1, max_size=40), st.integers(0, 5))
def test_sweep(rows, at):
    lcp, conv = [v for v, _ in rows], [c for _, c in rows]
    left, nodes = conversations.sweep(lcp, conv, at)
    for i, v in enumerate(lcp):
        assert left[i] == max((at + j for j in range(i) if lcp[j] < v), default=-1)
    want = {}
    for i, v in enumerate(lcp):
        l = max((j for j in range(i) if lcp[j] < v), default=-1)
        r = min((j for j in range(i + 1, len(lcp)) if lcp[j] < v), default=len(lcp))
        want[l, v, r] = want.get((l, v, r), 0) + 1
    got = {(l - at if l >= 0 else -1, v, r - at + 1 if r >= 0 else len(lcp)): (many, low) for v, l, r, many, low in nodes}
    assert {k: m for k, (m, _) in got.items()} == want
    assert all(low == min(conv[l:r]) for (l, _, r), (_, low) in got.items() if l >= 0)


def test_query_against_sql(spark):
    from tests.oracle import compare

    assert compare(spark, "op11_conversation_trie", "sf0.001") == ""
    assert compare(spark, "op11_conversation_trie", "sf0.01") == ""
