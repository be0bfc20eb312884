"""Keeping an index up: after any edits it is what binding everything would give, and little is bound anew."""

from __future__ import annotations

import os
import random

import pytest

from lithic.sources import trees


def body(rng, names):
    """A file that defines some names, calls others, and may rename what it brings from another."""
    own, lines = rng.sample(names, 2), []
    if rng.random() < 0.4:
        lines.append(f"const {{ {rng.choice(names)}: local{rng.randrange(3)} }} = require('./f{rng.randrange(6)}')")
    for n in own:
        lines += [f"function {n}() {{", f"  return {rng.choice(names)}() + local{rng.randrange(3)}() + {rng.choice(names)}()", "}"]
    return "\n".join(lines) + "\n"


def shown(refs):
    return sorted((r.path, r.line, r.kind, r.name, r.target_symbol_id) for r in refs.collect())


def test_edits(spark, tmp_path):
    rng, names = random.Random(5), [f"n{i}" for i in range(9)]
    folder = tmp_path / "src"
    folder.mkdir()
    for i in range(6):
        (folder / f"f{i}.js").write_text(body(rng, names))
    (tmp_path / "odd [x]{y}.js").write_text("function n1() {}\n")
    now = trees.index(spark, str(tmp_path))
    for step in range(3):
        if step < 2:
            (folder / f"f{rng.randrange(6)}.js").write_text(body(rng, names) + "// longer " * (step + 1))
            (folder / f"new{step}.js").write_text(body(rng, names))
        if step == 1:
            os.remove(folder / "f0.js") if (folder / "f0.js").exists() else None
            (tmp_path / "odd [x]{y}.js").write_text("function n2() { return n1() }\n")
        before = now
        now, bound = trees.refresh(spark, str(tmp_path), before)
        whole = trees.bind(now["refs"].drop("target_symbol_id"), now["symbols"], now["files"], now["aliases"])
        assert shown(now["refs"]) == shown(whole)
        scratch = trees.index(spark, str(tmp_path))
        keys = lambda t: sorted((r.path, r.name, r.start_line, r.end_line) for r in t["symbols"].collect())
        assert keys(now) == keys(scratch) and now["refs"].count() == scratch["refs"].count()
        assert {r.path: r.content_hash for r in now["files"].collect()} == {r.path: r.content_hash for r in scratch["files"].collect()}
        ids = {r.path: r.file_id for r in before["files"].collect()}
        assert all(ids.get(r.path, r.file_id) == r.file_id for r in now["files"].collect())
        if step == 2:
            assert bound.count() == 0 and shown(before["refs"]) == shown(now["refs"])  # nothing changed


def test_work_follows_the_change(spark, tmp_path):
    for i in range(40):
        (tmp_path / f"m{i}.js").write_text(f"function f{i}() {{\n  return f{(i + 1) % 40}()\n}}\n")
    now = trees.index(spark, str(tmp_path))
    (tmp_path / "m7.js").write_text("function f7() {\n  return f8() + g7()\n}\nfunction g7() { return 1 }\n")
    after, bound = trees.refresh(spark, str(tmp_path), now)
    assert {r.path for r in bound.collect()} == {"m7.js", "m6.js"}  # the file, and who speaks of its names
    assert {(r.path, r.change) for r in trees.changes(spark, str(tmp_path), now["files"]).collect()} == {("m7.js", "changed")}
    assert trees.changes(spark, str(tmp_path), after["files"]).isEmpty()


@pytest.mark.parametrize("gone", [True, False])
def test_names_that_come_and_go(spark, tmp_path, gone):
    (tmp_path / "a.js").write_text("function user() {\n  return thing()\n}\n")
    (tmp_path / "b.js").write_text("function thing() {}\n")
    (tmp_path / "c.js").write_text("function thing() {}\n" if gone else "let other = 1\n")
    now = trees.index(spark, str(tmp_path))
    at = lambda t: {r.id: r.path for r in t["symbols"].collect()}[t["refs"].where("target_name = 'thing' and kind = 'call'").first().target_symbol_id]
    assert at(now) == "b.js"
    if gone:
        os.remove(tmp_path / "b.js")
        assert at(trees.refresh(spark, str(tmp_path), now)[0]) == "c.js"
    else:
        (tmp_path / "a.js").write_text("function user() {\n  return thing()\n}\nfunction thing() {}\n")
        assert at(trees.refresh(spark, str(tmp_path), now)[0]) == "a.js"
