"""The sweep over nested ranges against plain loops, with siblings, equal ranges, ties and ranges that overlap."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from lithic.operators import nesting
from lithic.plans import catalogue
from lithic.sources import trees
from lithic.sources.relations import Relations

KIND = "id long, file_id long, name string, type string, start_line long, end_line long"


def plain(symbols, lines):
    """As the rules say: (parent, container, root) of symbols, owners of lines."""
    out, owners = {}, {}
    for file in {s[1] for s in symbols}:
        own = sorted((s for s in symbols if s[1] == file), key=lambda s: (s[4], s[5], s[0]))
        stack, parents = [], {}
        for s in own:
            while stack and stack[-1][5] < s[4]:
                stack.pop()
            if stack and stack[-1][4] != s[4]:
                parents[s[0]] = stack[-1][0]
            stack.append(s)
        name = {s[0]: s[2] for s in own}
        for s in own:
            around = [p for p in own if p[4] < s[4] and s[5] <= p[5]]
            container = min(around, key=lambda p: (p[5] - p[4], p[0]), default=(None,))[0]
            root = not any(p[0] != s[0] and p[4] <= s[4] and s[5] <= p[5] for p in own)
            chain, at = [], s[0]
            while at is not None:
                chain.insert(0, name[at])
                at = parents.get(at)
            out[s[0]] = (parents.get(s[0]), ".".join(chain), len(chain) - 1, container, root)
    for n, file, line in lines:
        held = [s for s in symbols if s[1] == file and s[3] in nesting.OWNERS and s[4] <= line <= s[5]]
        if held:
            owners[n] = min(held, key=lambda s: (s[5] - s[4], s[0]))[0]
    return out, owners


def test_any_ranges(spark):
    rng = random.Random(6)
    symbols = []
    for file in range(12):
        for k in range(rng.randint(0, 14)):
            start = rng.randint(1, 12)
            symbols.append((file * 100 + k, file, rng.choice("abc"), rng.choice(["function", "class", "method", "variable"]), start, start + rng.choice([0, 0, 1, 3, 9, 20])))
    lines = [(str(n), rng.randrange(13), rng.randint(1, 20)) for n in range(150)]
    found = nesting.nested(spark.createDataFrame(symbols, KIND), spark.createDataFrame(lines, "id string, file_id long, line long")).collect()
    want, owners = plain(symbols, lines)
    assert {r.id: (r.parent_id, r.qualified, r.depth, r.container_id, r.root) for r in found if r.ref is None} == want
    assert {r.ref: r.parent_id for r in found if r.ref is not None} == owners


def test_siblings_after_a_function(spark, tmp_path):
    (tmp_path / "a.py").write_text("class A:\n    def f(self):\n        x = 1\n        return x\n    y = 2\n\ndef g():\n    return A()\n\nz = 3\n")
    (tmp_path / "one.js").write_text("function a() { return 1 }; function b() { return a() }\n")
    tree = trees.index(spark, str(tmp_path))
    got = {(r.path, r.name): r.parent_line for r in catalogue.queries()["win03_parent_assignment"](spark, tree).collect()}
    assert got[("a.py", "x")] == 2 and got[("a.py", "y")] == 1 and got[("a.py", "g")] is None and got[("a.py", "z")] is None
    names = {(r.path, r.qualified, r.depth) for r in catalogue.queries()["grf08_qualified_name"](spark, tree).collect()}
    assert {("a.py", "A.f.x", 2), ("a.py", "A.y", 1), ("a.py", "g", 0), ("a.py", "z", 0)} <= names
    roots = {(r.name, r.root) for r in catalogue.queries()["jn11_containment"](spark, tree).collect()}
    assert {("A", True), ("f", False), ("z", True)} <= roots


def test_many_lines_and_nothing(spark):
    deep = [(k, 1, f"n{k}", "function", k + 1, 4000 - k) for k in range(300)]
    got = {r.id: r.depth for r in nesting.nested(spark.createDataFrame(deep, KIND)).collect()}
    assert got == {k: k for k in range(300)}
    assert nesting.nested(spark.createDataFrame([], KIND)).collect() == []
    wide = spark.createDataFrame([(1, 1, None, "function", 5, None)], KIND)
    assert [(r.qualified, r.root) for r in nesting.nested(wide.withColumn("end_line", F.col("end_line"))).collect()] == [("", True)]


def test_all_that_is_held(spark):
    """References of every kind, and what stands in a class but in none of its functions; paths may be null."""
    symbols = [(1, 1, "A", "class", 1, 5), (2, 1, "f", "function", 3, 4), (3, 2, "v", "variable", 1, 9)]
    refs = [("a", 1, "x/a", 2, "call", "g"), ("b", 1, "x/a", 3, "use", "h"), ("c", 1, "x/a", 4, "call", "g"), ("d", 1, "x/a", 7, "call", "g"), ("e", 2, "x/b", 1, "call", "g"), ("f", 1, None, 5, "import", "k")]
    files = spark.createDataFrame([(1, "en"), (2, "de")], "file_id long, lang string")
    source = Relations({"symbols": spark.createDataFrame(symbols, KIND), "refs": spark.createDataFrame(refs, "id string, file_id long, path string, line long, kind string, target_name string"), "files": files})
    got = {tuple(r) for r in catalogue.queries()["jn10_enclosing_symbol"](spark, source).collect()}
    assert got == {("x/a", "A", 1, 1, 2), ("x/a", "f", 2, 2, 3), (None, "A", 1, 1, 5)}
    calls = {tuple(r) for r in catalogue.queries()["jn03_caller_symbols"](spark, source).collect()}
    assert calls == {("a", 2, "g", "en", "A"), ("c", 4, "g", "en", "f")}
