"""Lookups by trigrams against scans, and modules in paths against a loop."""

from __future__ import annotations

import random
import re

from lithic.operators import postings
from lithic.plans import catalogue
from lithic.sources import trees


def test_names(spark):
    rng = random.Random(2)
    names = sorted({"".join(rng.choices("abAB_é", k=rng.randint(1, 9))) for _ in range(400)}) + ["", None, "aaaa", "aaaa"]
    index = postings.postings(spark.createDataFrame([(n,) for n in names], "name string"), block=7).cache()
    assert max(len(r.names) for r in index.collect()) < 40 and index.where("gram = 'aaa'").count() >= 1
    for text in ("a", "ab", "abA", "BAB_", "é_a", "zzz", "aaaa", "_"):
        assert sorted(r.name for r in postings.names_with(index, text).collect()) == sorted({n for n in names if n and text.lower() in n.lower()})


def test_a_snapshot_answers_as_the_tables(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    snap = trees.snapshot_of_tables(spark, sf, str(tmp_path), ("files", "lines", "symbols", "refs"))
    assert "postings" in snap.tables
    for name in ("flt03_references", "flt06_symbol_search"):
        assert catalogue.queries()[name](spark, snap).collect() == catalogue.queries()[name](spark, sf).collect()


def test_many_names_are_joined(spark, monkeypatch):
    monkeypatch.setattr(postings, "LISTED", 2)
    names = [(f"x{i}foo",) for i in range(20)] + [("bar",), ("other",)]
    df = spark.createDataFrame(names, "name string")
    from lithic.sources.relations import Relations

    source = Relations({"symbols": df, "postings": postings.postings(df)})
    got = {r.name for r in postings.narrowed(source, "symbols", "name", ["foo"], ["bar"])["symbols"].collect()}
    assert got == {n for n, in names} - {"other"}


def plain(modules, paths):
    out = set()
    for m in {m for m in modules if m}:
        text = re.sub(r"^[.][.]?/", "", m).lower()
        for slashed, t in ((False, text), (True, text.replace(".", "/"))):
            held = sorted((i, p) for i, p in paths if p and t and t in p.lower())
            if held or slashed or "." not in text:
                out.add((m, held[0][1] if held else None, len(held), slashed and bool(held)))
                break
    return out


def test_modules(spark):
    rng = random.Random(8)
    part = lambda: "".join(rng.choices("abcD", k=rng.randint(1, 4)))
    paths = [(i, "/".join(part() for _ in range(rng.randint(1, 3))) + ".py") for i in range(80)] + [(900, ""), (901, None), (902, "zz/a.b/c.py")]
    modules = [".".join(part() for _ in range(rng.randint(1, 2))) for _ in range(60)] + ["./abc", "../a", "a", "py", "", None, "nowhere.at.all", "A.B/C", "./"]
    got = postings.modules_in_paths(spark.createDataFrame([(m,) for m in modules], "module string"), spark.createDataFrame(paths, "id long, path string")).collect()
    assert {tuple(r) for r in got} == plain(modules, paths) and len(got) == len({m for m in modules if m})


def test_imports_of_a_tree(spark, tmp_path):
    for path, text in {"a.py": "import pkg.tool\nimport os\n", "pkg/tool.py": "x = 1\n", "b.js": "import './lib/x'\nimport 'node:fs'\n", "lib/x.js": "let y = 1\n"}.items():
        (tmp_path / path).parent.mkdir(exist_ok=True)
        (tmp_path / path).write_text(text)
    got = {(r.module, r.path, r.n, r.slashed) for r in catalogue.queries()["jn13_like_join"](spark, trees.index(spark, str(tmp_path))).collect()}
    assert got == {("pkg.tool", "pkg/tool.py", 1, True), ("os", None, 0, False), ("./lib/x", "lib/x.js", 1, False)}
