"""References that their own file doesn't bind: module segments, aliases, ties; on a tree, with rows written by hand."""

from __future__ import annotations

import random

import pytest

from lithic.operators import resolution
from lithic.plans import catalogue
from lithic.plans.dialect import SPARK
from lithic.sources import trees
from lithic.sources.relations import Relations, run

TREE = {
    "aaa/first.rs": "pub fn token() -> u32 { 1 }\npub fn only() -> u32 { 2 }\n",
    "core/hash.rs": "pub fn token() -> u32 { 3 }\n",
    "core/Hash/mod.rs": "pub fn deep() -> u32 { 9 }\n",
    "core/myfold.rs": "pub fn token() -> u32 { 4 }\n",
    "src/use.rs": "fn a() -> u32 {\n    crate::hash::token()\n}\nfn b() -> u32 {\n    crate::nowhere::token()\n}\nfn c() -> u32 {\n    hash::fold::token()\n}\nfn d() -> u32 {\n    self::only()\n}\nfn e() -> u32 {\n    hash::deep()\n}\n",
    "lib.js": "function one() {\n  return 1\n}\nfunction other() {\n  return 2\n}\nfunction third() {\n  return 3\n}\nmodule.exports = { one, other }\n",
    "app.js": "const { one: two, other } = require('./lib')\nfunction go() {\n  return two() + other()\n}\n",
    "zed.js": "function two() {\n  return 5\n}\nfunction here() {\n  return two()\n}\n",
    "twice.js": "const { one: x } = require('./lib')\nconst { missing: y, third: x } = require('./lib')\nfunction f() {\n  return x() + y()\n}\n",
}


@pytest.fixture(scope="module")
def tree(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("resolution")
    for path, text in TREE.items():
        (at / path).parent.mkdir(parents=True, exist_ok=True)
        (at / path).write_text(text)
    return trees.index(spark, str(at))


def test_calls_are_bound_by_their_module(tree):
    at = {r.id: (r.path, r.name) for r in tree["symbols"].collect()}
    bound = {(r.path, r.line, r.name): at.get(r.target_symbol_id) for r in tree["refs"].where("kind = 'call'").collect()}
    assert bound[("src/use.rs", 2, "crate::hash::token")] == ("core/hash.rs", "token")  # the last segment decides
    assert bound[("src/use.rs", 5, "crate::nowhere::token")] == ("aaa/first.rs", "token")  # none answers: the first
    assert bound[("src/use.rs", 8, "hash::fold::token")] == ("core/myfold.rs", "token")  # the end of a name before .rs
    assert bound[("src/use.rs", 11, "self::only")] == ("aaa/first.rs", "only")
    assert bound[("src/use.rs", 14, "hash::deep")] == ("core/Hash/mod.rs", "deep")  # a folder, whatever its case


def test_aliases_are_rebound(spark, tree):
    at = {r.id: (r.path, r.name) for r in tree["symbols"].collect()}
    bound = {(r.path, r.line, r.name): at.get(r.target_symbol_id) for r in tree["refs"].where("kind = 'call'").collect()}
    assert bound[("app.js", 3, "two")] == ("lib.js", "one") and bound[("app.js", 3, "other")] == ("lib.js", "other")
    assert bound[("zed.js", 5, "two")] == ("zed.js", "two")
    assert bound[("twice.js", 4, "x")] == ("lib.js", "third")  # the last import of a name wins
    assert bound[("twice.js", 4, "y")] == ("twice.js", "y")  # what isn't there leaves the binding of the file
    got = {(r.target_name, r.original) for r in catalogue.queries()["jn09_alias_rebind"](spark, tree).collect()}
    assert got == {("two", "one"), ("other", "other"), ("x", "third")}


def test_impact_passes_an_alias(spark, tree):
    from lithic.operators import graphs

    assert {(r.path, r.depth) for r in graphs.impact_of(spark, tree, "lib.js", "one").collect()} == {("app.js", 1)}


def test_candidates(spark, tree):
    at = {r.id: r.path for r in tree["symbols"].collect()}
    got = {r.expr: (at[r.candidate], r.decided_by) for r in catalogue.queries()["grf11_pick_candidate"](spark, tree).collect() if r.target_name == "token"}
    assert got == {"crate::hash::token": ("core/hash.rs", "hash"), "crate::nowhere::token": ("aaa/first.rs", None), "hash::fold::token": ("core/myfold.rs", "fold")}


def answers(path: str, seg: str) -> bool:
    p = path.lower()
    return any(x in p for x in (f"/{seg}.", f"/{seg}/", f"{seg}.rs", f"{seg}.py", f"{seg}.go"))


def test_picks_against_a_loop(spark):
    """Any references and candidates, a hot name and a hot segment among them."""
    rng = random.Random(3)
    words = ["ab", "b", "cab", "core", "x1"]
    paths = sorted({"/".join(rng.choices(words, k=rng.randint(0, 3)) + [rng.choice(words) + rng.choice([".rs", ".py", ".go", ".js", ".test.js", ""])]) for _ in range(60)})
    files = [(i, p) for i, p in enumerate(paths, 1)]
    symbols = [(i * 1_000_000 + k, i, rng.choice(["f", "f", "f", "g", "h"])) for i, _ in files for k in range(rng.randint(0, 3))]
    refs = []
    for n in range(400):
        name = rng.choice(["f", "f", "g", "h", "none"])
        segs = rng.choices([*words, "crate", "self", "CORE"], k=rng.randint(0, 3))
        refs.append((str(n), rng.choice(files)[0], name, rng.choice(["call", "use", "import", "odd"]), rng.choice(["", "::".join([*segs, name]), "obj." + name])))
    given = Relations({
        "files": spark.createDataFrame(files, "file_id long, path string"),
        "symbols": spark.createDataFrame(symbols, "id long, file_id long, name string"),
        "refs": spark.createDataFrame(refs, "id string, file_id long, target_name string, kind string, expr string"),
    })
    got = {r.id: r.target_symbol_id for r in run(spark, given, resolution.elsewhere(SPARK), ("refs", "symbols", "files")).collect()}
    path_of, want = dict(files), {}
    for n, file, name, kind, expr in refs:
        same = [s for s in symbols if s[2] == name]
        others = [s for s in same if s[1] != file]
        if kind == "odd" or "." in expr or not others or kind in resolution.OWN and len(others) < len(same):
            continue
        asked = [s.lower() for s in expr.split("::")[:-1] if s.lower() not in resolution.NO_MODULE]
        hit = next((s for seg in reversed(asked) for s in sorted(others) if answers(path_of[s[1]], seg)), None)
        want[n] = (hit or min(others))[0]
    assert got == want


def test_references_are_shuffled_once(spark):
    """Candidates go to the references, not the references to each kind of candidate in turn."""
    found = catalogue.queries()["jn08_cross_file_pick"](spark, "/root/testdata/sf0.001")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(file_id") <= 3 and "hashpartitioning(id#" not in plan and "Window [row_number" not in plan


def relations_of(spark, files, symbols, refs):
    return Relations({
        "files": spark.createDataFrame(files, "file_id long, path string"),
        "symbols": spark.createDataFrame(symbols, "id long, file_id long, name string"),
        "refs": spark.createDataFrame(refs, "id string, file_id long, target_name string, kind string, expr string"),
    })


def shuffled(spark, since: int = -1) -> tuple[int, int]:
    """Rows that stages after the given one have written for shuffles, and the last stage."""
    sc, gateway = spark.sparkContext._jsc.sc(), spark.sparkContext._gateway
    sc.listenerBus().waitUntilEmpty(30_000)
    found = sc.statusStore().stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), gateway.jvm.java.util.ArrayList())
    stages = [found.apply(i) for i in range(found.size())]
    return sum(s.shuffleWriteRecords() for s in stages if s.stageId() > since), max(s.stageId() for s in stages)


def test_references_to_no_symbol_are_not_shuffled(spark):
    """However many names there are: they're not broadcast here."""
    files = [(i, f"a/m{i}/f{i}.rs") for i in range(5)]
    symbols = [(i * 100 + k, i, f"f{(i + k) % 8}") for i in range(5) for k in range(4)]
    refs = [(str(n), n % 5, f"f{n % 9}" if n % 400 == 0 else f"word{n}", "call", f"m{n % 7}::f") for n in range(20_000)]
    given = relations_of(spark, files, symbols, refs)
    most = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        want = sorted(run(spark, given, resolution.elsewhere(SPARK), ("refs", "symbols", "files")).collect())
        _, last = shuffled(spark)
        got = sorted(catalogue.queries()["jn08_cross_file_pick"](spark, given).collect())
        n, _ = shuffled(spark, last)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", most)
    assert got == want and len(got) > 10
    assert n < 5_000


@pytest.mark.parametrize("few, hot, parts, common, words", [(1000, 1000, 64, 10_000, 1 << 20), (0, 4, 3, 2, 64), (2, 1, 1, 0, 1), (1000, 1000, 64, 5, 1)])
def test_the_query_picks_as_its_text(spark, monkeypatch, few, hot, parts, common, words):
    """Whether segments go as literals or all along, whatever is hot or common; with places that aren't known."""
    for k, v in {"FEW": few, "HOT": hot, "PARTS": parts, "COMMON": common, "WORDS": words}.items():
        monkeypatch.setattr(resolution, k, v)
    rng = random.Random(few)
    words = ["ab", "b", "cab", "core", "x1"]
    files = [(i, "/".join(rng.choices(words, k=rng.randint(0, 3)) + [rng.choice(words) + rng.choice([".rs", ".py", ".js", ""])])) for i in range(40)]
    symbols = [(i * 1_000_000 + k, i if i % 9 else None, rng.choice(["f", "f", "f", "g", "h", f"own{i}"])) for i, _ in files for k in range(rng.randint(0, 4))]
    refs = []
    for n in range(600):
        name = rng.choice(["f", "f", "f", "g", "h", f"own{n % 40}", "none", f"no{n}", ""])
        segs = rng.choices([*words, "crate", "self", "CORE", "odd"], k=rng.randint(0, 4))
        refs.append((str(n), rng.choice([*range(40), None]), name, rng.choice(["call", "use", "import", "extends", "odd"]), rng.choice(["", "::".join([*segs, name]), "::".join([*segs, name]), "obj." + name])))
    given = relations_of(spark, files, symbols, refs)
    plain = lambda rows: sorted(tuple(r) for r in rows)
    want = plain(run(spark, given, resolution.elsewhere(SPARK), ("refs", "symbols", "files")).collect())
    assert plain(catalogue.queries()["jn08_cross_file_pick"](spark, given).collect()) == want and {r[3] for r in want} == {True, False}


def test_no_symbols_no_picks(spark):
    given = relations_of(spark, [(1, "a/b.rs")], [], [("1", 1, "f", "call", "b::f")])
    assert catalogue.queries()["jn08_cross_file_pick"](spark, given).collect() == []
