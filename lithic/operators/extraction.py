"""Extraction over files: table-valued functions by mapInPandas, and as SQL table functions.

Any DataFrame of (path, content) will do. The queries run over a source tree's files; over the tables, which hold no code,
over the small project beside them and a sample in each language.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lithic.functions import extract as X
from lithic.plans.catalogue import query
from lithic.sources.relations import Relations, Source, relation

SAMPLES = [
    ("src/a.js", "import fs from 'fs'\nconst { one, two: second } = require('./util')\nexport function load(x) {\n  return parse(x) + one\n}\nclass Box extends Base {\n  open(k) {\n    second(k)\n  }\n}\nlet total = 0\ntotal = total + 1\n"),
    ("src/b.ts", "interface Shape { area(): number }\ntype Id = string\nexport abstract class Circle implements Shape {\n  area(): number {\n    return Math.max(1, 2)\n  }\n}\nenum Color { Red }\n"),
    ("src/c.py", "import os\nfrom a.b import c as d\nLIMIT = 3\n\nclass Runner:\n    def run(self, x):\n        if x and LIMIT:\n            return d(x)\n        return os.path.join('a', x)\n\ndef main():\n    r = Runner()\n    r.run(LIMIT)\n"),
    ("src/d.go", "package main\nimport \"fmt\"\ntype Thing struct {\n  n int\n}\nfunc (t *Thing) Go() error {\n  x := helper(t.n)\n  fmt.Sprint(x)\n  return nil\n}\nfunc helper(n int) int {\n  return n\n}\n"),
    ("src/e.rs", "use std::fs;\npub struct Pool { n: u32 }\npub trait Run { fn go(&self); }\nimpl Pool {\n    pub fn start(&self) {\n        let k = spawn(self.n);\n        fs::read(k);\n    }\n}\nfn main() {\n    start_all();\n}\n"),
    ("src/f.c", "#include <stdio.h>\n#define MAX 3\ntypedef struct node node_t;\nstruct node {\n  int v;\n};\nint total = 0;\nint sum(int a) {\n  return add(a, MAX);\n}\n"),
    ("src/g.cpp", "#include \"x.h\"\nclass Car {\n  int speed;\n};\nint drive(int a) {\n  return go(a);\n}\n"),
    ("src/H.java", "import java.util.List;\npublic class H {\n  private int n = 0;\n  public int run(int x) {\n    return Helper.twice(x) + new Box(x).get();\n  }\n}\ninterface K { }\n"),
    ("src/i.sh", "source ./lib.sh\nNAME=x\ngreet() {\n  say \"$NAME\"\n  echo done\n}\ngreet\n"),
    ("src/bad.py", "def broken(:\n  pass\n"),
    ("src/empty.js", ""),
]


def samples(spark: SparkSession, pattern: str = ".*") -> DataFrame:
    return spark.createDataFrame(SAMPLES, "path string, content string").where(F.col("path").rlike(pattern))


CODE = "[.](" + "|".join(X.LANGUAGES) + ")$"


def sources_of(spark: SparkSession, source: Source, pattern: str = CODE) -> DataFrame:
    """(path, content) of a source's code."""
    texts = relation(spark, source, "texts").select("path", "content").where(F.col("path").rlike(CODE) & F.col("path").rlike(pattern))
    return texts if isinstance(source, Relations) else texts.unionByName(samples(spark, pattern))


def table_function(files: DataFrame, rows: Callable[[str, str], list[tuple]], schema: str) -> DataFrame:
    """rows(path, content) for each file, with its path; a file's rows come from one task, no shuffle."""
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([(p, *r) for p, c in zip(b.path, b.content, strict=True) for r in rows(p, c or "")], columns=names)

    return files.select("path", "content").mapInPandas(run, schema)


def symbols(files: DataFrame) -> DataFrame:
    return table_function(files, lambda p, c: [tuple(s) for s in X.extract(p, c).symbols], "path string, name string, kind string, start_line int, end_line int")


def references(files: DataFrame) -> DataFrame:
    return table_function(files, lambda p, c: [tuple(r) for r in X.extract(p, c).refs], "path string, kind string, name string, line int, module string")


def tagged(files: DataFrame) -> DataFrame:
    """Symbols and references as one table."""
    s = symbols(files).select("path", F.lit("symbol").alias("row_kind"), "name", "kind", F.col("start_line").alias("line"), "end_line")
    r = references(files).select("path", F.lit("ref").alias("row_kind"), "name", "kind", "line", F.lit(None).cast("int").alias("end_line"))
    return s.unionByName(r)


for _id, _pattern in (("ext01_javascript", "[.](js|ts)$"), ("ext05_python", "[.]py$"), ("ext07_go", "[.]go$"), ("ext08_rust", "[.]rs$"), ("ext09_c", "[.]c$"), ("ext10_cpp", "[.]cpp$"), ("ext11_java", "[.]java$"), ("ext12_bash", "[.]sh$")):
    query(_id)(lambda spark, source, p=_pattern: tagged(sources_of(spark, source, p)))


@query("ext02_js_variable_refs")
def _(spark, sf_dir):
    return references(sources_of(spark, sf_dir, "[.](js|ts)$")).where("kind in ('use', 'assign')")


@query("ext03_call_names")
def _(spark, sf_dir):
    """Extracted names, and whether known characters only make them up, at most 200: the extractor keeps no others."""
    names = references(sources_of(spark, sf_dir)).where("kind = 'call'")
    return names.select("path", "name", (F.col("name").rlike(r"^[\w$.?\[\]:]+$") & (F.length("name") <= 200)).alias("kept"))


@query("ext04_binding_names")
def _(spark, sf_dir):
    return table_function(sources_of(spark, sf_dir, "[.]js$"), lambda p, c: [(n,) for m in X.re.finditer(r"(?:const|let|var)\s*([{\[][^=]*[}\]])\s*=", c) for n in X.binding_names(m[1])], "path string, name string")


@query("ext06_python_constants")
def _(spark, sf_dir):
    """Of a tree's Python files; over the tables also of a settings file that each part is written as."""
    files = sources_of(spark, sf_dir, "[.]py$")
    if not isinstance(sf_dir, Relations):
        files = files.unionByName(settings(relation(spark, sf_dir, "functions")))
    return table_function(files, lambda p, c: X.constants(c), "path string, name string, line int")


def settings(functions: DataFrame) -> DataFrame:
    """(path, content): Python files that assign a constant of each row's name, one of its kind, and a variable."""
    constant = lambda c: F.upper(F.regexp_replace(c, "[^A-Za-z0-9]+", "_"))
    lines = F.concat_ws("\n", F.lit("import os"), F.concat(constant("name"), F.lit(" = "), F.col("start_line")), F.concat(F.lit("size = "), F.col("start_line")), F.concat(constant("kind"), F.lit(": int = 1")))
    return functions.select(F.concat(F.lit("settings/"), F.col("dir"), F.lit("/"), F.col("id"), F.lit(".py")).alias("path"), lines.alias("content"))


@query("ext13_has_errors")
def _(spark, sf_dir):
    return table_function(sources_of(spark, sf_dir), lambda p, c: [(X.extract(p, c).has_errors, len(c) > 1 << 20)], "path string, has_errors boolean, truncated boolean")


@query("ext14_metrics")
def _(spark, sf_dir):
    return table_function(sources_of(spark, sf_dir), lambda p, c: [tuple(X.metrics(p, c))], "path string, cyclomatic int, cognitive int, max_nesting int, function_count int, class_count int, loc int, comment_ratio double")


@query("ext15_outline_nodes")
def _(spark, sf_dir):
    return table_function(sources_of(spark, sf_dir), lambda p, c: [tuple(n) for n in X.outline_nodes(p, c)], "path string, node_id int, parent_id int, depth int, node_type string, name string, start_line int, end_line int")


@query("ext16_message_classes")
def _(spark, sf_dir):
    messages = relation(spark, sf_dir, "messages").select("path", "content")
    return table_function(messages.unionByName(sources_of(spark, sf_dir)), lambda p, c: [X.classify(c)], "path string, has_code boolean, code_ratio double, primary_type string, node_count int")


@query("src08_batch_extract")
def _(spark, sf_dir):
    """A partition is a batch."""
    files = relation(spark, sf_dir, "files").select("path", "content").unionByName(sources_of(spark, sf_dir))
    return symbols(files).groupBy("path").agg(F.count("*").alias("n"))


class ExtractFunction:
    """SQL table function: FROM files, LATERAL extract(path, content)."""

    def eval(self, path: str, content: str):
        got = X.extract(path, content or "")
        for s in got.symbols:
            yield "symbol", s.name, s.kind, s.start_line, s.end_line
        for r in got.refs:
            yield "ref", r.name, r.kind, r.line, None


class MetricsFunction:
    def eval(self, path: str, content: str):
        yield tuple(X.metrics(path, content or ""))


def register_functions(spark: SparkSession) -> None:
    spark.udtf.register("extract_all", F.udtf(ExtractFunction, returnType="row_kind string, name string, kind string, line int, end_line int"))
    spark.udtf.register("compute_metrics", F.udtf(MetricsFunction, returnType="cyclomatic int, cognitive int, max_nesting int, function_count int, class_count int, loc int, comment_ratio double"))


@query("exte_sql_table_function")
def _(spark, sf_dir):
    register_functions(spark)
    sources_of(spark, sf_dir).createOrReplaceTempView("sample_files")
    return spark.sql("select f.path, e.row_kind, e.name, e.kind, e.line from sample_files f, lateral extract_all(f.path, f.content) e")
