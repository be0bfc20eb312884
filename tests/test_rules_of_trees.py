"""Rules that go by folders, imports and times, on trees with rows written by hand."""

from __future__ import annotations

import os
import time

from lithic.plans import catalogue
from lithic.sources import trees


def written(at, files):
    for path, text in files.items():
        (at / path).parent.mkdir(parents=True, exist_ok=True)
        (at / path).write_text(text)


def rows(spark, name, tree):
    return catalogue.queries()[name](spark, tree).collect()


def test_exceptions_in_reach(spark, tmp_path):
    written(tmp_path, {
        "app/errors.py": "class AppError(Exception):\n    pass\n\nclass DeepError(AppError):\n    pass\n\nclass Deeper(DeepError):\n    pass\n",
        "app/web/view.py": "def f():\n    raise AppError('x')\n",
        "app/web/inner/own.py": "class InnerError(ValueError):\n    pass\n",
        "other/lone.py": "def g():\n    raise ValueError('y')\n",
        "other/plain.py": "class Thing(Base):\n    pass\n",
        "lib/a.js": "function h() {\n  throw new Error('z')\n}\n",
        "lib2/b.js": "export class JsError extends Error {\n}\nclass More extends JsError {\n}\n",
    })
    got = {r.path: (r.names, r.n_exceptions, r.fell_back) for r in rows(spark, "jn24_scoped_hierarchy", trees.index(spark, str(tmp_path)))}
    assert got == {
        "app/web/view.py": ("AppError DeepError Deeper InnerError", 4, False),  # above, below, and two levels down the classes
        "other/lone.py": ("AppError DeepError Deeper InnerError", 4, True),  # none in reach: those of everywhere
        "lib/a.js": ("JsError More", 2, True),  # of its own language
    }


def test_guessed_callees(spark, tmp_path):
    written(tmp_path, {"a.js": "import { known } from './b'\nfunction f() {\n  return known() + guessed() + own() + nowhere()\n}\nfunction own() {}\n", "b.js": "function known() {}\nfunction guessed() {}\nfunction own() {}\n"})
    tree = trees.index(spark, str(tmp_path))
    at = {r.id: r.path for r in tree["symbols"].collect()}
    got = {r.target_name: (at[r.target], r.ambiguous) for r in rows(spark, "grf06_callees_ambiguity", tree) if r.path == "a.js"}
    assert got["guessed"] == ("b.js", True) and got["own"] == ("a.js", False) and "nowhere" not in got


def test_open_work_by_time(spark, tmp_path):
    written(tmp_path, {"new.js": "// TODO(ann): now\n", "old.js": "// FIXME later\nlet x = 1 // HACK\n"})
    long_ago = time.time() - 40 * 86400
    os.utime(tmp_path / "old.js", (long_ago, long_ago))
    got = {(r.path, r.line, r.kind, r.author, r.priority) for r in rows(spark, "rul07_active_todos", trees.index(spark, str(tmp_path)))}
    assert got == {("new.js", 1, "TODO", "ann", "medium"), ("old.js", 1, "FIXME", "", "low"), ("old.js", 2, "HACK", "", "low")}


def test_names_as_they_are(spark, tmp_path):
    written(tmp_path, {"m/a.py": "def get_one(): pass\ndef get_two(): pass\ndef getThree(): pass\ndef get_four(): pass\n"})
    got = {(r.dir, r.dominant, r.n, r.total, r.consistent) for r in rows(spark, "rul10_naming_consistency", trees.index(spark, str(tmp_path)))}
    assert got == {("m", "snake", 3, 4, True)}
