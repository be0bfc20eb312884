"""The catalogue on a source tree: a small project of our own, with what each query must say of it written by hand."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from lithic.operators import graphs
from lithic.operators.rules import GUARD_SCHEMA, guard
from lithic.plans import catalogue
from lithic.sources import sample, trees
from lithic.sources.relations import Relations

TREE = {
    "a.js": "import { helper } from './b'\nexport function alpha() {\n  return helper()\n}\nfunction lonely() {\n  return 1\n}\n",
    "b.js": "import { alpha } from './a'\nexport function helper() {\n  return 2\n}\nexport function middle() {\n  return helper()\n}\nexport function outer() {\n  return middle()\n}\n",
    "c.js": "export const unrelated = 1\n",
    "src/same.js": "import './other'\n",
    "src/other.js": "import '../lib/same'\n",
    "lib/same.js": "export default 1\n",
    "tests/test_a.js": "import { alpha } from '../a'\nfunction check() {\n  return alpha()\n}\n",
    "pkg/__init__.py": "",
    "pkg/tool.py": "class Tool:\n    def use(self):\n        return outer()\n\ndef outer():\n    def inner():\n        return use_it()\n    return inner()\n\ndef use_it():\n    return 1\n",
    "node_modules/x.js": "function hidden() {}\n",
    ".git/y.js": "function hidden() {}\n",
    "a(b+c/odd.js": "function odd() {}\n",
}


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    at = tmp_path_factory.mktemp("c++ (tree)")
    for path, text in TREE.items():
        (at / path).parent.mkdir(parents=True, exist_ok=True)
        (at / path).write_text(text)
    return str(at)


@pytest.fixture(scope="module")
def tree(spark, root):
    return trees.index(spark, root)


@pytest.fixture(scope="module")
def ids(tree):
    return {(r.path, r.name): r.id for r in tree["symbols"].collect()}


def rows(spark, name, source):
    return catalogue.queries()[name](spark, source).collect()


def test_walk(spark, root, tree):
    assert sorted(r.path for r in tree["files"].collect()) == sorted(p for p in TREE if not p.startswith(("node_modules", ".git")))
    assert [r.file_id for r in tree["files"].orderBy("path").collect()] == list(range(1, len(TREE) - 1))
    walked = rows(spark, "src01_collect_files", tree)
    assert {r.path for r in walked} == {p for p in TREE if not p.startswith(("node_modules", ".git"))} and not any(r.truncated for r in walked)
    some = trees.read_tree(spark, root, most=2).collect()
    assert [r.path for r in some] == ["a(b+c/odd.js", "a.js"] and all(r.truncated for r in some)


def test_lookups(spark, tree, ids):
    found = catalogue.queries()["flt06_symbol_search"](spark, tree).collect()
    assert found == []  # nothing is called ...tion...
    refs = tree["refs"].where("target_name = 'helper' and kind = 'call'").select("path", "line").collect()
    assert sorted(map(tuple, refs)) == [("a.js", 3), ("b.js", 6)]
    around = {(r.path, r.source_name): r.n for r in rows(spark, "jn10_enclosing_symbol", tree)}
    assert around[("a.js", "alpha")] >= 1 and around[("b.js", "middle")] == 1
    assert {(r.path, r.name) for r in tree["symbols"].join(tree["refs"].where("target_name = 'use_it'").select(F.col("source_symbol_id").alias("id")), "id").collect()} == {("pkg/tool.py", "inner")}
    # the reference's name is bound in its own file first, else to the first elsewhere
    bound = {(r.path, r.target_name): r.target_symbol_id for r in tree["refs"].where("kind = 'call'").collect()}
    assert bound[("a.js", "helper")] == ids[("b.js", "helper")] and bound[("pkg/tool.py", "outer")] == ids[("pkg/tool.py", "outer")]
    picked = {(r.id, r.target_name) for r in rows(spark, "jn08_cross_file_pick", tree)}
    assert any(n == "helper" for _, n in picked)
    assert {r.name for r in rows(spark, "jn16_unused_symbols", tree)} >= {"lonely", "odd"}


def test_dead_code(spark, tree):
    dead = {(r.path, r.name) for r in rows(spark, "agg02_dead_code", tree)}
    assert {("a.js", "lonely"), ("a(b+c/odd.js", "odd")} <= dead and ("b.js", "helper") not in dead


def test_call_graph(spark, tree, ids):
    helper = ids[("b.js", "helper")]
    direct = {r.src for r in tree["calls"].where(F.col("dst") == helper).collect()}
    assert direct == {ids[("a.js", "alpha")], ids[("b.js", "middle")]}
    got = {(r.caller, r.via, r.depth) for r in graphs.indirect_callers(spark, tree, helper, 3, own_file=True).collect()}
    assert got == {(ids[("tests/test_a.js", "check")], ids[("a.js", "alpha")], 2), (ids[("b.js", "outer")], ids[("b.js", "middle")], 2)}
    # without the definition's own file, middle isn't followed
    assert {r.caller for r in graphs.indirect_callers(spark, tree, helper, 3).collect()} == {ids[("tests/test_a.js", "check")]}
    impact = {(r.path, r.depth, r.bucket) for r in graphs.impact_of(spark, tree, "b.js", "helper").collect()}
    assert impact == {("a.js", 1, "direct"), ("b.js", 1, "direct"), ("tests/test_a.js", 2, "test")}
    assert graphs.impact_of(spark, tree, "c.js", "helper").where("elsewhere").count() == 3
    with pytest.raises(LookupError):
        graphs.impact_of(spark, tree, "c.js", "nothing")


def test_module_graph(spark, tree):
    path = {r.file_id: r.path for r in tree["files"].collect()}
    edges = {(path[r.src], path[r.dst]) for r in tree["imports"].collect()}
    assert edges == {("a.js", "b.js"), ("b.js", "a.js"), ("src/same.js", "src/other.js"), ("src/other.js", "lib/same.js"), ("tests/test_a.js", "a.js")}
    cycles = rows(spark, "grf04_cycles", tree)
    assert [(r.length, [path[x] for x in r.cycle]) for r in cycles] == [(2, ["a.js", "b.js"])]
    assert [sorted(path[int(x)] for x in r.cycle) for r in rows(spark, "grf04_dfs_cycles", tree)] == [["a.js", "b.js"]]
    assert {path[r.node] for r in rows(spark, "grf05_in_cycle", tree) if r.in_cycle} == {"a.js", "b.js"}
    assert {path[r.module]: r.shortest for r in rows(spark, "grf10_import_fixer_cycle", tree) if r.shortest} == {"a.js": 2, "b.js": 2}
    start = spark.createDataFrame([(i,) for i, p in path.items() if p == "tests/test_a.js"], "root long")
    got = {(path[r.src], path[r.dst], r.depth) for r in graphs.dependencies(tree["imports"], start, 10).collect()}
    assert got == {("tests/test_a.js", "a.js", 1), ("a.js", "b.js", 2), ("b.js", "a.js", 3)}
    assert graphs.dependencies(tree["imports"], start, 0).count() == 1  # held between 1 and 10


def test_outline(spark, tree):
    got = {(r.name, r.parent_line, r.depth) for r in rows(spark, "grf09_outline", tree) if r.line and r.name in ("Tool", "use", "outer", "inner") and r.signature.startswith(("class", "def"))}
    assert got == {("Tool", None, 0), ("use", 1, 1), ("outer", None, 0), ("inner", 5, 1)}


def test_snapshot_answers_as_the_tree(spark, tree, tmp_path):
    trees.write_snapshot(tree.tables, str(tmp_path))
    snap = trees.open_snapshot(spark, str(tmp_path), tuple(tree.tables))
    for name in ("agg02_dead_code", "grf04_cycles", "jn10_enclosing_symbol", "rul08_unused_imports"):
        assert sorted(map(str, rows(spark, name, snap))) == sorted(map(str, rows(spark, name, tree)))


def test_containment(spark, tree, ids):
    got = {(r.name, r.parent_name) for r in rows(spark, "jn11_containment", tree) if r.id in {ids[("pkg/tool.py", n)] for n in ("Tool", "use", "outer", "inner")}}
    assert got == {("Tool", None), ("use", "Tool"), ("outer", None), ("inner", "outer")}


def test_upsert(spark):
    base = spark.createDataFrame([("a", 1), ("b", 1), ("c", 1)], "path string, n int")
    changed, gone = spark.createDataFrame([("b", 2), ("d", 2)], "path string, n int"), spark.createDataFrame([("c",)], "path string")
    assert sorted(map(tuple, trees.upsert(base, changed, gone).collect())) == [("a", 1), ("b", 2), ("d", 2)]


def test_strong_parts(spark):
    """Any graph's edges on cycles, against a closure."""
    import random

    rng = random.Random(4)
    for few in (0, 0, 100, 100):
        edges = {(rng.randrange(14), rng.randrange(14)) for _ in range(18)}
        reach = set(edges)
        while more := {(a, d) for a, b in reach for c, d in reach if b == c} - reach:
            reach |= more
        want = {(a, b) for a, b in edges if (b, a) in reach or a == b}
        got = graphs.strong_parts(spark.createDataFrame(sorted(edges), "src int, dst int"), few).collect()
        assert {(r.src, r.dst) for r in got} == want
        for r in got:
            assert (r.part, r.src) in reach and (r.src, r.part) in reach or r.part == r.src


@pytest.fixture(scope="module")
def project(spark):
    """The sample project as relations: what the queries say of it doesn't depend on the tables."""
    lines = spark.createDataFrame(sample.ROWS, "path string, line long, text string")
    return Relations({"code": lines, "texts": spark.createDataFrame(sorted(sample.FILES.items()), "path string, content string")})


def test_manifests_and_locks(spark, project):
    got = {(r.path, r.package): (r.required, r.locked) for r in rows(spark, "src13_lock_files", project)}
    assert got == {
        ("shop/package.json", "left-pad"): ("^1.3.0", "1.3.1"),
        ("shop/package.json", "lodash"): ("4.x", None),
        ("shop/package.json", "jest"): ("^29.0.0", "29.7.0"),
        ("shop/pyproject.toml", "requests"): (">=2.1", "2.31.0"),
        ("shop/pyproject.toml", "click"): ("", None),
        ("shop/pyproject.toml", "httpx"): ("^0.27", "0.27.2"),
        ("shop/requirements.txt", "flask"): ("==2.0", None),
        ("shop/requirements.txt", "numpy"): (">=1.2,<2", None),
        ("shop/requirements.txt", "pyyaml"): ("", None),
        ("shop/go.mod", "example.org/x"): ("v1.2.3", "v1.2.3"),
        ("shop/go.mod", "example.org/y"): ("v0.4.0", "v0.4.0"),
        ("shop/Cargo.toml", "serde"): ("1.0", "1.0.203"),
        ("shop/Cargo.toml", "tokio"): ("1.38", "1.38.0"),
        ("shop/Cargo.toml", "rand"): ("0.8", None),
    }
    assert {(r.kind, r.name) for r in rows(spark, "src14_env_and_services", project)} == {("env", "API_URL"), ("env", "DB_PASSWORD"), ("service", "web"), ("service", "billing")}
    states = {r.module: r.state for r in rows(spark, "rul17_dependency_gatekeeper", project)}
    assert states == {"./store": "local", "./app": "local", "fs": "stdlib", "path": "stdlib", "os": "stdlib", "sys": "stdlib", "unittest.mock": "stdlib", "shop.store": "local", "numpy": "unlocked", "yaml": "unlocked"}


def test_security_review(spark, project):
    got = {(r.path, r.rule, r.line) for r in rows(spark, "rul01_security_review", project)}
    assert got == {
        ("shop/.env", "dotenv-secret", 1),
        ("shop/.env", "dotenv-secret", 3),
        ("shop/app.js", "debug-log", 12),
        ("shop/app.js", "eval", 6),
        ("shop/app.js", "eval", 23),
        ("shop/app.js", "exec-cmd", 7),
        ("shop/app.js", "exec-cmd-tpl-member", 9),
        ("shop/app.js", "innerHTML", 11),
        ("shop/app.js", "insecure-compare", 13),
        ("shop/app.js", "process-exit", 13),
        ("shop/main.py", "password-hardcode", 27),
        ("shop/store.js", "api-key-hardcode", 15),
        ("shop/store.js", "sql-concat", 13),
        ("shop/store.js", "sql-concat", 14),
    }
    states = {(r.state, r.rule): r.n for r in rows(spark, "rul02_suppression", project)}
    assert states[("marker", "eval")] == 1 and states[("reported", "eval")] == 1 and states[("config", "sql-concat")] == 2


#: A line that each rule must find, and one that it must not.
HITS = {
    "eval": ("eval (x)", "retrieval(x)"),
    "Function-ctor": ("new Function(a)", "newFunction(a)"),
    "exec-cmd": ("execSync('a' + b)", "re.exec(a + b)"),
    "exec-cmd-member": ("cp.spawn('a' + b)", "other.spawn('a' + b)"),
    "exec-cmd-tpl": ("exec(`ls ${x}`)", "re.exec(`${x}`)"),
    "exec-cmd-tpl-member": ("shell.exec(`ls ${x}`)", "shell.exec(`ls`)"),
    "exec-cmd-subst": ("exec('echo $(id)')", "exec('echo')"),
    "exec-cmd-subst-member": ("proc.execSync('echo $(id)')", "proc.execSync('echo')"),
    "exec-file-shell-concat": ("execFile('a' + b, { shell: true })", "execFile('a', [b], { shell: true })"),
    "cmd-name-concat": ("spawn('a' + b)", "spawn('a', [b + c])"),
    "cmd-name-tpl": ("spawn(`${a}`)", "spawn('a', [`${b}`])"),
    "spawn-shell": ("spawn('a', [], { shell: true })", "spawn('a', [], {})"),
    "sql-concat": ("q = 'select * from t where a=' + x", "please select one"),
    "sql-fstring": ("q = f'SELECT * FROM {t}'", "q = f'SELECTED {t}'"),
    "innerHTML": ("el.innerHTML = y", "el.textContent = y"),
    "dangerouslySet": ("<a dangerouslySetInnerHTML={x}>", "<a set={x}>"),
    "fs-unlink-sync": ("fs.rmSync(x)", "fs.rm(x)"),
    "process-exit": ("process.exit(1)", "process.exitCode = 1"),
    "crypto-md5": ("crypto.createHash('MD5')", "crypto.createHash('sha256')"),
    "jwt-hardcoded": ("jwt.sign(x, 'abcdefgh1')", "jwt.sign(x, key)"),
    "password-hardcode": ("password = 'hunter22'", "password = ask()"),
    "api-key-hardcode": ("API_KEY: 'abcdefgh12'", "api_key: env.KEY"),
    "allow-all-cors": ("origin: '*'", "origin: 'x.org'"),
    "no-rate-limit": ("app.post('/x', async (q) => 1)", "app.post('/x', limit, h)"),
    "debug-log": ("console.log('the token', x)", "console.log('hello')"),
    "insecure-compare": ("if (token === given) {", "if (token === null) {"),
    "no-input-validation": ("f(req.body.name)", "f(name)"),
}


def test_each_security_rule(spark):
    files = [(f"{rule}.{k}.js", line) for rule, pair in HITS.items() for k, line in zip(("hit", "miss"), pair, strict=True)]
    files += [("tests/a.js", "password = 'hunter22'; eval(x)"), ("s.js", "a()\n\nexec(\n 'a' +\n b)"), ("p.js", "db.prepare('select a from t where b=' + c)"), (".env.local", "A=1234\nKEY=12345678"), ("notes.txt", "KEY=12345678")]
    files += [("m.js", "eval(x) // lint-ignore\neval(y) // lint-ignore[exec-cmd]\neval(z) // lint-ignore[eval, exec-cmd]")]
    source = Relations({"texts": spark.createDataFrame(files, "path string, content string")})
    found = {(r.path, r.rule): r.line for r in rows(spark, "rul01_security_review", source)}
    for rule in HITS:
        assert (f"{rule}.hit.js", rule) in found and (f"{rule}.miss.js", rule) not in found, rule
    assert found[("s.js", "exec-cmd")] == 3 and (".env.local", "dotenv-secret") in found and ("notes.txt", "dotenv-secret") not in found
    states = {(r.state, r.rule): r.n for r in rows(spark, "rul02_suppression", source)}
    assert states[("test_path", "password-hardcode")] == 1 and states[("prepared", "sql-concat")] == 1
    assert states[("marker", "eval")] == 2


def test_guards(spark, project):
    own = spark.createDataFrame([("mine", "call_banned", "missing", ""), ("no-eval", "call_banned", "nothing", "")], GUARD_SCHEMA)
    got = {(r.rule, r.path, r.line, r.name) for r in guard(spark, project, own).collect()}
    assert got == {("mine", "shop/main.py", 26, "missing"), ("no-bare-except", "shop/main.py", 17, "except")}


def test_imports(spark, project):
    assert {(r.path, r.local) for r in rows(spark, "rul08_unused_imports", project)} == {("shop/app.js", "open"), ("shop/main.py", "system"), ("shop/main.py", "keep"), ("shop/main.py", "yaml"), ("shop/store.js", "run")}
    kinds = {(r.path, r.kind, r.name) for r in rows(spark, "rul09_import_analysis", project)}
    assert {("shop/main.py", "undefined", "missing"), ("shop/main.py", "remove_statement", "yaml"), ("shop/main.py", "remove_name", "keep"), ("shop/app.js", "relative", "./store")} <= kinds
    assert not any(n in ("load", "Runner", "main", "print", "open") for _, k, n in kinds if k == "undefined")
    assert {(r.path, r.module) for r in rows(spark, "ext17_dynamic_imports", project)} == {("shop/app.js", "./lazy")}
    assert {(r.module, r.original, r.local) for r in rows(spark, "ext18_alias_map", project)} == {("./store", "open", "open"), ("./store", "read", "load")}
    assert {(r.path, r.module, r.target) for r in rows(spark, "pth03_relative_imports", project)} == {("shop/app.js", "./store", "shop/store.js"), ("shop/store.js", "./app", "shop/app.js")}


def test_logs_and_patches(spark, project):
    assert {(r.path, r.passed, r.failed, r.skipped) for r in rows(spark, "agg20_test_summary", project)} == {("shop/logs/pytest.log", 1, 1, 1), ("shop/logs/go.log", 1, 1, 1), ("shop/logs/jest.log", 7, 2, 1)}
    assert {(r.lang, r.file, r.at_line) for r in rows(spark, "str26_stack_frames", project)} >= {("js", "shop/app.js", 12), ("py", "shop/main.py", 14)}
    assert {(r.tool, r.severity, r.code) for r in rows(spark, "str27_diagnostics", project)} == {("tsc", "error", "TS2304"), ("tsc", "warning", "TS6133"), ("eslint", "error", "no-undef"), ("eslint", "warning", "semi")}
    assert [(r.block, r.old_lines, r.new_lines, r.unclosed) for r in sorted(rows(spark, "str19_patch_blocks", project), key=lambda r: r.block)] == [(1, 1, 1, False), (2, 1, 0, True)]
    assert {(r.file, r.added, r.removed) for r in rows(spark, "str19_diff_lines", project)} == {("shop/app.js", 2, 1), ("shop/new.py", 1, 0)}
    assert {(r.name, r.value, r.dynamic) for r in rows(spark, "str23_constants", project)} == {("LIMIT", "10", False), ("LIMIT", "3", False)}


def test_bracket_balance(spark):
    cases = {"f(a[b]{c})": True, "f(a]": False, "(()": False, ")(": False, "": True, "(" * 400 + ")" * 400: True, "x " * 3000 + ")": False, "([)]": False}
    source = Relations({"texts": spark.createDataFrame([(str(i), t) for i, t in enumerate(cases)], "path string, content string")})
    assert [r.balanced for r in sorted(rows(spark, "rul18_bracket_balance", source), key=lambda r: int(r.path))] == list(cases.values())


def simple_cycles(edges, longest):
    """Every elementary cycle from its least node on, by a plain search."""
    out, todo = set(), [[s] for s in {a for a, _ in edges}]
    while todo:
        path = todo.pop()
        for a, b in edges:
            if a == path[-1]:
                if b == path[0]:
                    out.add(tuple(path))
                elif b > path[0] and b not in path and len(path) < longest:
                    todo.append([*path, b])
    return out


def test_elementary_cycles(spark):
    import random

    rng = random.Random(9)
    for longest, few in ((1, 100), (3, 0), (6, 100), (9, 100)):
        edges = {(rng.randrange(9), rng.randrange(9)) for _ in range(20)}
        found = graphs.elementary_cycles(spark.createDataFrame(sorted(edges), "src long, dst long"), longest).collect()
        assert len(found) == len({tuple(r.cycle) for r in found}) and all(r.length == len(r.cycle) for r in found)
        assert {tuple(r.cycle) for r in found} == simple_cycles(edges, longest)
    ring = [(i, (i + 1) % 30) for i in range(30)]  # longer than any bound in the query
    assert [r.length for r in graphs.elementary_cycles(spark.createDataFrame(ring, "src long, dst long"), 30).collect()] == [30]
    assert graphs.elementary_cycles(spark.createDataFrame([], "src long, dst long"), 5).collect() == []


def test_cycles_of_large_graphs_take_few_rounds(spark, monkeypatch):
    """Above FEW edges no labels are sent around: half a cycle from each end finds where cycles begin."""
    import random

    monkeypatch.setattr(graphs, "FEW", 0)
    monkeypatch.setattr(graphs, "_labels", None)
    rng = random.Random(3)
    for longest in (2, 5, 8):
        edges = {(rng.randrange(10), rng.randrange(10)) for _ in range(22)}
        found = graphs.elementary_cycles(spark.createDataFrame(sorted(edges), "src long, dst long"), longest).collect()
        assert sorted(tuple(r.cycle) for r in found) == sorted(simple_cycles(edges, longest))


def test_reached_from_a_start(spark):
    """A node that is only called, and not from what it reaches, doesn't reach itself; a ring's node does."""
    reach = lambda edges: sorted(r.node for r in rows(spark, "set10_visited_union", Relations({"calls": spark.createDataFrame(edges, "src long, dst long")})))
    assert reach([(5, 1)]) == []
    assert reach([(5, 1), (1, 2), (2, 3)]) == [2, 3]
    assert reach([(1, 2), (2, 3), (3, 1), (3, 4), (7, 4)]) == [1, 2, 3, 4]


def test_searched_cycles_by_size(spark):
    edges = [(1, 2), (2, 1), (10, 11), (11, 12), (12, 10), (12, 13), (13, 10)]
    got = {(tuple(r.cycle), r.how) for r in graphs.search_cycles(spark.createDataFrame(edges, "src long, dst long"), most=4).collect()}
    assert got == {(("1", "2"), "searched"), (("10", "11", "12"), "enumerated"), (("10", "11", "12", "13"), "enumerated")}


def test_many_findings_in_one_file(spark):
    """A file of sixteen thousand findings, each met with its own line."""
    lines = ["eval(x)" if k % 3 else "eval(y) // lint-ignore" for k in range(16_000)]
    source = Relations({"texts": spark.createDataFrame([("big.js", "\n".join(lines))], "path string, content string")})
    states = {(r.state, r.rule): r.n for r in rows(spark, "rul02_suppression", source)}
    assert states == {("marker", "eval"): 5334, ("reported", "eval"): 10666}
    assert {(r.path, r.score) for r in rows(spark, "agg12_security_score", source)} == {("big.js", 0)}
    assert sorted(r.line for r in rows(spark, "rul01_security_review", source)) == list(range(1, 16_001))


def test_each_rule_is_tried_on_texts_that_hold_its_word():
    from lithic.operators.rules import HOLDS, SECURITY

    assert set(HOLDS) == {r[0] for r in SECURITY}
    for rule, (hit, _) in HITS.items():
        assert any(w in hit.lower() for w in HOLDS[rule]), rule
