"""Extraction, editing, trees and streams on small cases of our own."""

from __future__ import annotations

import datetime
import json
import random

import pytest
from pyspark.sql import functions as F

from lithic.functions import extract as X
from lithic.operators import editing, graphs, search
from lithic.operators.binding import first_elsewhere
from lithic.operators.extraction import SAMPLES
from lithic.operators.windows import common_ends, pack
from lithic.plans import catalogue
from lithic.plans.dialect import SPARK
from lithic.plans.invoke import USAGE, invoke
from lithic.plans.routes import serve
from lithic.sources import trees
from lithic.sources.relations import relation
from lithic.streaming import feeds

FILES = dict(SAMPLES)


def kinds(path):
    return {(s.kind, s.name) for s in X.extract(path, FILES[path]).symbols}


def calls(path, kind="call"):
    return {r.name for r in X.extract(path, FILES[path]).refs if r.kind == kind}


def test_javascript():
    assert {("function", "load"), ("class", "Box"), ("method", "open"), ("variable", "total")} <= kinds("src/a.js")
    assert calls("src/a.js") == {"require", "parse", "second"}
    assert calls("src/a.js", "import") == {"fs", "./util"}
    assert "total" in calls("src/a.js", "assign")


def test_typescript():
    assert {("interface", "Shape"), ("type", "Id"), ("class", "Circle"), ("method", "area"), ("class", "Color")} <= kinds("src/b.ts")


def test_python():
    assert {("class", "Runner"), ("method", "run"), ("function", "main"), ("variable", "LIMIT")} <= kinds("src/c.py")
    assert {"d", "os.path.join", "Runner", "r.run"} == calls("src/c.py")
    assert {"os", "a.b", "c"} == calls("src/c.py", "import")
    assert X.extract("src/bad.py", FILES["src/bad.py"]).has_errors


def test_other_languages():
    assert {("type", "Thing"), ("method", "Go"), ("function", "helper"), ("variable", "x")} <= kinds("src/d.go")
    assert {("class", "Pool"), ("interface", "Run"), ("method", "start"), ("function", "main"), ("variable", "k")} <= kinds("src/e.rs")
    assert {("class", "node"), ("variable", "MAX"), ("function", "sum"), ("variable", "total")} <= kinds("src/f.c")
    assert {("class", "Car"), ("function", "drive")} <= kinds("src/g.cpp")
    assert {("class", "H"), ("method", "run"), ("interface", "K")} <= kinds("src/H.java")
    assert {("function", "greet"), ("variable", "NAME")} <= kinds("src/i.sh")
    assert calls("src/i.sh") >= {"say", "greet"} and calls("src/i.sh", "import") == {"./lib.sh"}
    assert X.extract("a.xyz", "def f(): pass") == X.Extract([], [], False) == X.extract("a.py", None)


def test_strip_keeps_lines():
    for path, source in FILES.items():
        assert X.strip(source, X.language_of(path)).count("\n") == source.count("\n")
    assert "x" not in X.strip("a = 'x' // x", "javascript") and "b" in X.strip("`x ${b} x`", "javascript")


def test_metrics_and_tree():
    m = X.metrics("a.py", "def f(x):\n    # note\n    if x:\n        for y in x:\n            pass\n")
    assert (m.cyclomatic, m.function_count, m.loc) == (3, 1, 5) and m.comment_ratio == 0.17
    nodes = X.outline_nodes("src/c.py", FILES["src/c.py"])
    assert nodes[0].parent_id is None and any(n.name == "run" and nodes[n.parent_id].name == "Runner" for n in nodes)
    assert X.classify("just words here") == (False, 0.0, "text", 1) and X.classify("def f(x):\n  return g(x)")[2] == "code"


def test_batch_edit():
    text = "a b\nc  \nd b\n"
    assert editing.batch_edit(text, [("a b", "x", False), ("d", "y", False)])[0] == "x\nc  \ny b\n"
    assert editing.batch_edit(text, [("b", "x", False)])[1] == ["ambiguous"]
    assert editing.batch_edit(text, [("b", "x", True)])[0] == "a x\nc  \nd x\n"
    assert editing.batch_edit(text, [("a b\nc", "x", False), ("c", "y", False)])[:2] == (text, ["conflict", "conflict"])
    assert editing.batch_edit(text, [("a b\nc", "x", False), ("c", "y", False)], partial=True)[1] == ["applied", "conflict"]
    assert editing.batch_edit(text, [("c\nd b", "z", False)])[0] == "a b\nz\n"
    assert editing.batch_edit(text, [("", "z", False)])[1] == ["invalid"]
    assert editing.matches("aaa", "aa") == [0, 1]


def test_search_replace():
    patch = "<<<<<<< SEARCH\na   b\n=======\nq\n>>>>>>> REPLACE"
    assert editing.search_replace("x\na b\n", patch) == ("x\nq\n", ["fuzzy"])
    assert editing.search_replace("a   b", patch)[1] == ["exact"] and editing.search_replace("z", patch) == ("z\nq\n", ["appended"])
    assert editing.rename_in("x = 'x' + xx + x // x", "a.js", "x", "y") == [(1, "x = 'x' + xx + x // x", "y = 'x' + xx + y // x")]


def test_cycles_and_pages():
    assert sorted(map(sorted, graphs.back_edge_cycles([("a", "b"), ("b", "a"), ("b", "c"), ("d", "d")]))) == [["a", "b"], ["d"]]
    assert pack([10, 10, 25, 5], 20, 40) == [1, 1, 2, 3] and pack([1, 1, 1], 99, 2) == [1, 1, 2]


def test_ignore_patterns(spark):
    paths = spark.createDataFrame([("a/x/b.js",), ("x/b.js",), ("b.min.js",), ("pre1.js",), ("dir/f",), ("root/f",), ("a/root/f",)], "path string")
    hit = lambda rule: {r.path for r in paths.where(F.col("path").rlike(search.ignore_pattern(rule))).collect()}
    assert hit("**/x/**") == {"a/x/b.js", "x/b.js"} and hit("*.min.js") == {"b.min.js"} and hit("pre*") == {"pre1.js"}
    assert hit("dir/") == {"dir/f"} and hit("/root") == {"root/f"} and hit("root") == {"root/f", "a/root/f"}


def test_bfs(spark):
    edges = spark.createDataFrame([(2, 1), (3, 2), (4, 3), (1, 3), (9, 8)], "src long, dst long")
    got = {r.node: r.depth for r in graphs.bfs(edges, spark.createDataFrame([(1,)], "node long"), 2).collect()}
    assert got == {1: 0, 2: 1, 3: 2}


def test_tree_index(spark, tmp_path):
    for path, content in SAMPLES:
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text(content)
    (tmp_path / "node_modules").mkdir()
    (tmp_path / "node_modules/x.js").write_text("function no() {}")
    got = trees.relations_of(trees.read_tree(spark, str(tmp_path)))
    assert got["files"].count() == len(SAMPLES)
    assert {r.name for r in got["symbols"].where("path = 'src/a.js'").collect()} >= {"load", "Box", "open"}
    bound = {r.target_name: r for r in got["refs"].where("path = 'src/c.py' and kind = 'call'").collect()}
    assert bound["Runner"].target_symbol_id is not None and bound["run"].source_symbol_id is not None
    trees.write_snapshot(got, f"{tmp_path}/snap")
    assert spark.read.parquet(f"{tmp_path}/snap/symbols").count() == got["symbols"].count()
    opened = trees.open_snapshot(spark, f"{tmp_path}/snap")
    assert opened["refs"].count() == got["refs"].count()
    assert catalogue.queries()["agg01_index_stats"](spark, opened).first().n_symbols == got["symbols"].count()
    with pytest.raises(trees.StaleSnapshot):
        trees.open_snapshot(spark, f"{tmp_path}/snap", newest=datetime.datetime(2999, 1, 1))


def test_logs(spark, tmp_path):
    (tmp_path / "u.jsonl").write_text("\n".join([json.dumps({"tool": "a", "error_code": None}), "not json", json.dumps({"tool": "b", "error_code": "POLLUTED_x"})]))
    assert [r.tool for r in trees.read_log(spark, f"{tmp_path}/u.jsonl", "tool string, error_code string", "POLLUTED").where("tool is not null").collect()] == ["a"]


def test_log_migration(spark, tmp_path):
    schema = "tool string, error_code string"
    for name, rows in (("a", [{"tool": "x"}, {"tool": "y", "error_code": "POLLUTED"}]), ("b", [{"tool": "z"}])):
        (tmp_path / f"{name}.jsonl").write_text("\n".join([*map(json.dumps, rows), "{broken"]))
    trees.append_log(spark.createDataFrame([("old", None)], schema), f"{tmp_path}/new")
    assert trees.migrate_logs(spark, [f"{tmp_path}/a.jsonl", f"{tmp_path}/b.jsonl"], f"{tmp_path}/new", schema, "POLLUTED") == 2
    assert sorted(r.tool for r in spark.read.schema(schema).json(f"{tmp_path}/new").collect()) == ["old", "x", "z"]


def test_streams(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    events.repartition(2).write.parquet(f"{tmp_path}/events")
    stream = feeds.read_events(spark, f"{tmp_path}/events")

    def run(df, name, mode):
        q = df.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", f"{tmp_path}/cp_{name}").trigger(availableNow=True).start()
        q.awaitTermination(120)
        return spark.table(name)

    hours = run(feeds.hourly_usage(stream, "3650 days"), "hours", "complete")
    batch = events.groupBy(F.date_trunc("hour", "ts"), "event_type").count()
    assert hours.count() == batch.count() and hours.agg(F.sum("n")).first()[0] == events.count()
    guard = run(feeds.collision_guard(stream), "guard", "append")
    assert guard.count() == events.where("event_type not in ('view', 'purchase')").count()
    changes = events.select("ts", F.lit("w").alias("workspace"), F.col("event_type").alias("path"))
    assert feeds.debounced(changes, "1 hour").agg(F.sum("n")).first()[0] == events.count()


def test_sync(spark):
    base = spark.createDataFrame([("a", 1), ("b", 1), ("c", 1)], "path string, v int")
    changes = spark.createDataFrame([("a", 2, 1, False), ("a", 3, 2, False), ("b", 0, 1, True), ("d", 1, 1, False)], "path string, v int, ts long, deleted boolean")
    out = []
    feeds.sync(lambda df: out.append(sorted(map(tuple, df.collect()))), lambda: base)(changes, 0)
    assert out == [[("a", 3), ("c", 1), ("d", 1)]]


def test_invoke(spark, tmp_path):
    out, log, data = f"{tmp_path}/out", f"{tmp_path}/log", "/root/testdata/sf0.001"
    ok = invoke(spark, "agg19_language_buckets", data, lambda df: df.write.parquet(out), log)
    assert ok.success and ok.metrics["rows"] == spark.read.parquet(out).count() > 0
    again = invoke(spark, "agg19_language_buckets", data, lambda df: df.write.parquet(out), log)  # the folder is there
    unknown = invoke(spark, "no_such", data, lambda df: None, log)
    assert (again.status, unknown.error_code) == ("error", "UNKNOWN_TOOL")
    rows = trees.read_log(spark, log, USAGE).collect()
    assert sorted((r.tool, r.success) for r in rows) == [("agg19_language_buckets", False), ("agg19_language_buckets", True), ("no_such", False)]


def test_common_ends(spark):
    rng = random.Random(5)
    pairs = [("\n".join(rng.choices("ab", k=rng.randint(1, 5))), "\n".join(rng.choices("ab", k=rng.randint(1, 5)))) for _ in range(60)]

    def plain(old, new):
        old, new, prefix, suffix = old.split("\n"), new.split("\n"), 0, 0
        while prefix < min(len(old), len(new)) and old[prefix] == new[prefix]:
            prefix += 1
        while suffix < min(len(old), len(new)) - prefix and old[-1 - suffix] == new[-1 - suffix]:
            suffix += 1
        return len(old), len(new), prefix, suffix

    try:
        for name, k in (("before", 0), ("after", 1)):
            spark.createDataFrame([(i, p[k]) for i, p in enumerate(pairs)], "file_id long, content string").createOrReplaceTempView(name)
        got = {r.file_id: (r.n_old, r.n_new, r.prefix, r.suffix) for r in spark.sql(f"select * from {common_ends(SPARK)}").collect()}
    finally:
        spark.catalog.dropTempView("before"), spark.catalog.dropTempView("after")
    assert got == {i: plain(*p) for i, p in enumerate(pairs)}


def test_first_elsewhere(spark):
    rng = random.Random(6)
    rows = [(i, rng.choice("abc"), rng.randint(1, 4)) for i in range(30)] + [(99, "lone", 1)]
    spark.createDataFrame(rows, "id long, name string, file_id long").createOrReplaceTempView("candidates_")
    got = {r.name: r for r in spark.sql(f"select * from {first_elsewhere('candidates_', 'name', 'file_id')}").collect()}
    for name in ("a", "b", "c", "lone"):
        for home in range(1, 6):
            want = min((i for i, n, f in rows if n == name and f != home), default=None)
            assert (got[name].next_id if got[name].home == home else got[name].first_id) == want
        assert got[name].n_all == sum(n == name for _, n, _ in rows)


def test_long_blocks(spark):
    rows = catalogue.queries()["win07_long_blocks"](spark, "/root/testdata/sf0.001").where("path = 'code'").collect()
    assert sorted((r.name, r.start_line, r.n) for r in rows) == [("longest", 1, 60), ("over", 114, 51)]


def test_routes(spark):
    data = "/root/testdata/sf0.001"
    edges = relation(spark, data, "calls").collect()
    assert serve(spark, data, f"/callers/{edges[0].dst}").count() == sum(e.dst == edges[0].dst for e in edges)
    assert serve(spark, data, "/stats").count() == 1 and 0 < serve(spark, data, "/search?q=THE").count() <= 30
    for url in ("/nothing", "/callers", "/stats/x", "/"):
        with pytest.raises(LookupError):
            serve(spark, data, url)
    assert serve(spark, data, "/symbols/' or 1=1 --").count() == 0


SOURCE = "import { helper as h } from './b'\nfunction one() {\n  return 1\n}\nfunction two() {\n  return 1\n}\n"


def test_write_symbol():
    write = lambda *a: editing.write_symbol(SOURCE, "a.js", *a)[:2]
    assert write("one", "patch", "return 1", "return 2") == ("written", "write")
    assert editing.write_symbol(SOURCE, "a.js", "two", "patch", "return 1", "return 2")[2] == SOURCE[: SOURCE.rindex("1")] + "2\n}\n"  # the other's stays
    assert write("one", "patch", "return 3", "return 1") == ("already_applied", "apply")
    assert write("one", "patch", "return 3", "return 4") == ("no_match", "apply")
    assert write("one", "patch", "n", "m") == ("ambiguous_match", "apply")
    assert write("none", "patch", "a", "b") == ("symbol_not_found", "resolve")
    assert write("one", "replace", "", "function one() {") == ("invalid_result", "validate")
    assert write("one", "patch", "return 1", "return 2", "0" * 64) == ("stale", "freshness")
    assert write("one", "patch", "return 1", "return 2", editing.sha(SOURCE)) == ("written", "write")
    assert write("one", "swap", "", "") == ("invalid_mode", "apply")
    assert editing.write_symbol(SOURCE, "a.js", "one", "insert_after", "", "let z = 1")[2].split("\n")[4] == "let z = 1"
    assert editing.write_symbol(SOURCE, "a.js", "one", "body", "", "  return 9\n}")[2].split("\n")[1:4] == ["function one() {", "  return 9", "}"]
    assert editing.write_symbol("class A {\n  f() {\n  }\n}\nclass B {\n  f() {\n  }\n}\n", "a.js", "f", "patch", "f", "g")[0] == "ambiguous_symbol"


def test_write_batches(spark):
    ok, bad = (1, "one", "insert_after", "", "let z = 1", None), (3, "three", "patch", "a", "b", None)
    later = (2, "two", "patch", "return 1", "return 2", None)  # its lines have moved by then
    done, content = editing.write_symbols(SOURCE, "a.js", [later, ok])
    assert [o for _, o, _ in done] == ["written", "written"] and content.count("return 2") == 1 and "let z = 1" in content
    done, content = editing.write_symbols(SOURCE, "a.js", [ok, later, bad])
    assert [o for _, o, _ in done] == ["rolled_back", "rolled_back", "symbol_not_found"] and content == SOURCE
    done, content = editing.write_symbols(SOURCE, "a.js", [ok, later, bad], strict=False)
    assert [o for _, o, _ in done] == ["written", "written", "symbol_not_found"] and content != SOURCE
    files = spark.createDataFrame([("a.js", SOURCE), ("b.js", None)], "path string, content string")
    asked = spark.createDataFrame([("a.js", *ok), ("a.js", *later), ("b.js", *ok), ("gone.js", *ok)], editing.REQUEST)
    got = {(r.path, r.seq): (r.outcome, r.step) for r in editing.write_plan(files, asked).collect()}
    assert got == {("a.js", 1): ("written", "write"), ("a.js", 2): ("written", "write"), ("b.js", 1): ("symbol_not_found", "resolve"), ("gone.js", 1): ("file_not_found", "resolve")}


def test_rename_and_aliases():
    text = "import { helper as h } from './b'\nlet x = helper(`${helper} helper`) // helper\n"
    assert editing.rename_in(text, "a.js", "helper", "aid") == [(1, "import { helper as h } from './b'", "import { aid as h } from './b'")]
    text = "import { helper } from './b'\nlet x = helper(`${helper} helper`) // helper\n"
    assert [after for _, _, after in editing.rename_in(text, "a.js", "helper", "aid")] == ["import { aid } from './b'", "let x = aid(`${aid} helper`) // helper"]


def test_diff_facts_of_versions(spark):
    """Names that went, by how many other files say them; equal ends of versions; ids that stand twice, as the SQL has it."""
    from pyspark.sql import functions as F

    from lithic.plans import catalogue
    from lithic.sources.relations import Relations

    kind = "file_id long, path string, content string"
    before = spark.createDataFrame([(1, "a", "one x\ntwo\nthree"), (2, "b", "one\nfour"), (3, "c", None), (4, "d", "same")], kind)
    after = spark.createDataFrame([(1, "a", "one x\nnew\nthree\nthree"), (3, "c", "five"), (4, "d", "same")], kind)
    refs = spark.createDataFrame([(1, "two"), (2, "two"), (2, "two"), (5, "two"), (5, "four"), (6, "one")], "file_id long, target_name string")
    source = Relations({"before": before.withColumn("state", F.lit("fresh")), "after": after, "refs": refs})
    found = catalogue.queries()["mut10_diff_facts"](spark, source)
    assert {r.path: tuple(r)[1:] for r in found.collect()} == {"a": ("changed", 2, 1, 1, 1, 2), "b": ("removed", 0, 0, 2, 0, 2), "c": ("same", 0, 0, 0, 1, 0), "d": ("same", 0, 0, 0, 0, 0)}
    assert "target_name" not in found._jdf.queryExecution().executedPlan().toString()  # no file meets all that say its names
