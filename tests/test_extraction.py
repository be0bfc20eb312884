"""Extraction: sources of our own in nine languages, with the rows that they must give, checked by hand."""

from __future__ import annotations

import pytest

from lithic.functions import extract as X

SOURCES = {
    'm.js': "import x, { y as z } from './m'\nexport async function load(\n  a,\n  b = {}\n) {\n  const t = `n ${call(a)} // no`\n  return x.run(t) // gone()\n}\nclass A extends B {\n  constructor() { super() }\n  static async get(\n    k\n  ) {\n    return this.find(k)\n  }\n}\nlet { p, q: r } = load(1)\nr = r + p\n",
    'm.ts': 'export interface Shape<T> {\n  area(): number\n}\ntype Id = string | number\nexport enum Color { Red, Green }\nabstract class Base {\n  private size(a: number): number {\n    return area(a)\n  }\n}\nexport const limit: number = 3\n',
    'm.py': 'import os, sys as s\nfrom . import near\nLIMIT: int = 3\n@wrap(1)\ndef outer(\n    a,\n    b=None,\n):\n    def inner():\n        return helper(a)\n    x, (y, *z) = inner()\n    return [f(i) for i in y]\nclass K(Base):\n    n = 1\n    async def go(self):\n        self.m.run()\n',
    'm.go': 'package p\nimport (\n\t"fmt"\n\tx "a/b"\n)\ntype T struct {\n\tn int\n}\ntype I interface { Do() }\nvar total = 1\nfunc (t *T) Do(\n\ta int,\n) error {\n\tv, err := call(a)\n\tfmt.Println(v)\n\treturn err\n}\nfunc Plain() {}\n',
    'm.rs': "use std::{fs, io};\nuse a::b as c;\npub enum E { A }\npub(crate) struct S<'a> { n: &'a str }\ntrait T { fn t(&self); }\nimpl<'a> S<'a> {\n    pub fn new(n: &'a str) -> Self {\n        let k = make(n).unwrap();\n        S { n }\n    }\n}\nfn free() { c::run('x'); vec![1].iter().map(|x| x); }\n",
    'm.c': '#include <stdio.h>\n#include "own.h"\n#define MAX 3\ntypedef unsigned int uint_t;\nunion U { int a; };\nenum K { A };\nstatic int total = 0;\nint\nsum(int a,\n    int b)\n{\n  printf("x");\n  return add(a, b);\n}\n',
    'm.cpp': '#include "own.h"\nclass Car : public Base {\n public:\n  int speed;\n  int drive(int a) {\n    return std::max(go(a), 1);\n  }\n};\nint main() { Car c; c.drive(1); return 0; }\n',
    'M.java': 'package p;\nimport java.util.List;\nimport static a.B.c;\n@interface Mark {}\npublic record P(int a) {}\nenum E { A }\npublic class M extends N {\n  private final List<String> names = null;\n  public M(int a) { this.n = a; }\n  protected static <T> int run(\n      int x) throws E {\n    return Helper.twice(x) + new Box(x).open() + names.size();\n  }\n  interface In { }\n}\n',
    'm.sh': '#!/bin/bash\n. ./env.sh\nsource lib.sh\nexport NAME=x\nfunction first {\n  second "$NAME" # third\n}\nsecond() {\n  echo hi | sort\n  deploy_all --now\n}\nfirst && second\n',
}

#: (name, kind, first line, last line) of symbols; (kind, name, line) of references.
EXPECTED = {
    'm.js': (
        [
            ('load', 'function', 2, 8),
            ('A', 'class', 9, 16),
            ('constructor', 'method', 10, 10),
            ('get', 'method', 11, 15),
            ('p', 'variable', 17, 17),
            ('r', 'variable', 17, 17),
        ],
        [
            ('import', './m', 1),
            ('call', 'call', 6),
            ('call', 'x.run', 7),
            ('call', 'this.find', 14),
            ('call', 'load', 17),
            ('assign', 'r', 18),
            ('use', 'p', 18),
            ('use', 'r', 18),
        ],
    ),
    'm.ts': (
        [
            ('Shape', 'interface', 1, 3),
            ('Id', 'type', 4, 4),
            ('Color', 'class', 5, 5),
            ('Base', 'class', 6, 10),
            ('size', 'method', 7, 9),
            ('limit', 'variable', 11, 11),
        ],
        [
            ('call', 'area', 8),
        ],
    ),
    'm.py': (
        [
            ('LIMIT', 'variable', 3, 3),
            ('outer', 'function', 5, 12),
            ('inner', 'function', 9, 10),
            ('x', 'variable', 11, 11),
            ('y', 'variable', 11, 11),
            ('z', 'variable', 11, 11),
            ('K', 'class', 13, 16),
            ('n', 'variable', 14, 14),
            ('go', 'method', 15, 16),
        ],
        [
            ('import', 'os', 1),
            ('import', 'sys', 1),
            ('import', '.', 2),
            ('import', 'near', 2),
            ('call', 'wrap', 4),
            ('call', 'helper', 10),
            ('call', 'inner', 11),
            ('call', 'f', 12),
            ('call', 'self.m.run', 16),
        ],
    ),
    'm.go': (
        [
            ('T', 'type', 6, 8),
            ('I', 'type', 9, 9),
            ('total', 'variable', 10, 10),
            ('Do', 'method', 11, 17),
            ('v', 'variable', 14, 14),
            ('err', 'variable', 14, 14),
            ('Plain', 'function', 18, 18),
        ],
        [
            ('import', 'fmt', 3),
            ('import', 'a/b', 4),
            ('call', 'call', 14),
            ('call', 'fmt.Println', 15),
        ],
    ),
    'm.rs': (
        [
            ('E', 'class', 3, 3),
            ('S', 'class', 4, 4),
            ('T', 'interface', 5, 5),
            ('new', 'method', 7, 10),
            ('k', 'variable', 8, 8),
            ('free', 'function', 12, 12),
        ],
        [
            ('import', 'std::fs', 1),
            ('import', 'std::io', 1),
            ('import', 'a::b', 2),
            ('call', 'make', 8),
            ('call', 'c::run', 12),
        ],
    ),
    'm.c': (
        [
            ('MAX', 'variable', 3, 3),
            ('uint_t', 'type', 4, 4),
            ('U', 'type', 5, 5),
            ('K', 'class', 6, 6),
            ('total', 'variable', 7, 7),
            ('sum', 'function', 9, 14),
        ],
        [
            ('import', 'stdio.h', 1),
            ('import', 'own.h', 2),
            ('call', 'add', 13),
        ],
    ),
    'm.cpp': (
        [
            ('Car', 'class', 2, 8),
            ('drive', 'method', 5, 7),
            ('main', 'function', 9, 9),
        ],
        [
            ('import', 'own.h', 1),
            ('call', 'go', 6),
            ('call', 'c.drive', 9),
        ],
    ),
    'M.java': (
        [
            ('Mark', 'type', 4, 4),
            ('P', 'class', 5, 5),
            ('E', 'class', 6, 6),
            ('M', 'class', 7, 15),
            ('names', 'variable', 8, 8),
            ('M', 'method', 9, 9),
            ('run', 'method', 10, 13),
            ('In', 'interface', 14, 14),
        ],
        [
            ('import', 'java.util.List', 2),
            ('import', 'a.B.c', 3),
            ('call', 'Box', 12),
            ('call', 'Helper.twice', 12),
            ('call', 'open', 12),
        ],
    ),
    'm.sh': (
        [
            ('NAME', 'variable', 4, 4),
            ('first', 'function', 5, 7),
            ('second', 'function', 8, 11),
        ],
        [
            ('import', './env.sh', 2),
            ('import', 'lib.sh', 3),
            ('call', 'second', 6),
            ('call', 'deploy_all', 10),
            ('call', 'first', 12),
            ('call', 'second', 12),
        ],
    ),
}


@pytest.mark.parametrize("path", sorted(SOURCES))
def test_rows(path):
    got = X.extract(path, SOURCES[path])
    assert [tuple(s) for s in got.symbols] == EXPECTED[path][0]
    assert [(r.kind, r.name, r.line) for r in got.refs] == EXPECTED[path][1]
    assert not got.has_errors


@pytest.mark.parametrize("path", sorted(SOURCES))
def test_comments_and_strings_hold_nothing(path):
    """What stands in a comment or a literal is no symbol and no reference, and lines stay where they are."""
    mark = "#" if path.endswith((".py", ".sh")) else "//"
    more = SOURCES[path] + f"{mark} function hidden() {{ call_me() }}\n" + ("" if path.endswith((".sh", ".rs", ".c", ".cpp")) else f"{mark} import nothing\n")
    assert X.extract(path, more)[:2] == X.extract(path, SOURCES[path])[:2]
    text = X.strip(more, X.language_of(path))
    assert len(text) == len(more) and [len(x) for x in text.split("\n")] == [len(x) for x in more.split("\n")]


def test_noise_is_dropped():
    for path, text in {"a.rs": "fn f() { x.unwrap().clone(); own(x); }", "a.c": "int f() { printf(\"x\"); own(1); }", "a.cpp": "int f() { std::move(x); own(1); }", "A.java": "class A {\n  void f() {\n    System.out.println(own(1));\n    list.add(2);\n  }\n}", "a.sh": "grep x | sort\nown y\n"}.items():
        assert [r.name for r in X.extract(path, text).refs] == ["own"], path


def test_broken_and_odd_sources():
    assert X.extract("a.js", "function f( {").has_errors and X.extract("a.py", "def broken(:\n  pass\n").has_errors
    assert X.extract("a.js", "")[:2] == X.extract("a.js", None)[:2] == X.extract("a.txt", "function f() {}")[:2] == ([], [])
    assert X.extract("a.js", "x" * (1 << 20) + "y")[:2] == ([], [])
    assert X.rust_uses("a::{self, b::{c, d as e}, f::*}") == ["a", "a::b::c", "a::b::d"]
    assert X.binding_names("{ a, b: c, d = 1, ...rest }") == ["a", "c", "d", "rest"] and X.binding_names("[x, [y], , z]") == ["x", "y", "z"]
    assert X.strip("a = `x ${b + `c`} d` // e", "javascript").split("//")[0].count("${b + ") == 1


def test_constants_of_a_table(spark):
    from pyspark.sql import functions as F

    from lithic.operators import extraction
    from lithic.plans import catalogue

    parts = spark.createDataFrame([(1, "hot blue-steel", "B#1", "SMALL TIN", 7), (2, "x", "B#2", "y", 9)], "id long, name string, dir string, kind string, start_line int")
    files = extraction.settings(parts)
    got = {tuple(r) for r in extraction.table_function(files, lambda p, c: X.constants(c), "path string, name string, line int").collect()}
    assert got == {("settings/B#1/1.py", "HOT_BLUE_STEEL", 2), ("settings/B#1/1.py", "SMALL_TIN", 4), ("settings/B#2/2.py", "X", 2), ("settings/B#2/2.py", "Y", 4)}
    found = catalogue.queries()["ext06_python_constants"](spark, "/root/testdata/sf0.001")
    n = spark.read.parquet("/root/testdata/sf0.001/part.parquet").count()
    assert found.where(F.col("path").startswith("settings/")).count() == 2 * n
