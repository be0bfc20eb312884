"""The version store: whole transactions, one winner of many writers, undo, and what dead writers leave."""

from __future__ import annotations

import threading

import pytest

from lithic.sources.versions import Conflict, Store

KIND = "path string, content string"


def held(store, version=None):
    return {r.path: r.content for r in store.files(version).collect()}


def test_versions_and_undo(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    change = lambda *rows: spark.createDataFrame(list(rows), KIND)
    assert store.version() == 0 and held(store) == {} and store.recover() == {}
    assert store.write(change(("a", "1"), ("b", ""))) == 1
    assert store.write(change(("a", "2"), ("b", None), ("c", "3"))) == 2
    assert held(store) == {"a": "2", "c": "3"} and held(store, 1) == {"a": "1", "b": ""} and held(store, 0) == {}
    assert store.undo() == 3 and held(store) == {"a": "1", "b": ""}
    assert store.undo() == 4 and held(store) == {"a": "2", "c": "3"}  # an undo can be undone
    with pytest.raises(Conflict):
        store.undo(1)  # its files were written since
    with pytest.raises(LookupError):
        store.undo(99)
    with pytest.raises(ValueError, match="twice"):
        store.stage(change(("a", "x"), ("a", "y")))
    with pytest.raises(Conflict):
        store.write(change(("a", "x")), spark.createDataFrame([("a", "not its hash")], "path string, hash string"))
    assert held(store) == {"a": "2", "c": "3"} and [e["action"] for e in store.log()] == ["apply", "apply", "undo", "undo"]


def test_one_winner(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    store.write(spark.createDataFrame([("a", "0")], KIND))
    txns = [store.stage(spark.createDataFrame([("a", str(i))], KIND)) for i in range(4)]
    won, lost, gate = [], [], threading.Barrier(16)

    def race(i):
        gate.wait()
        try:
            won.append((i, Store(spark, str(tmp_path)).commit(txns[i % 4], 1)))
        except Conflict:
            lost.append(i)

    threads = [threading.Thread(target=race, args=(i,)) for i in range(16)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert len(won) == 1 and len(lost) == 15 and store.version() == 2
    assert held(store) == {"a": str(won[0][0] % 4)}
    assert not [p for p in (tmp_path / "_log").iterdir() if p.suffix != ".json" and not p.name.endswith(".crc")]


def test_dead_writers(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    store.write(spark.createDataFrame([("a", "1"), ("b", "1")], KIND))
    dead = store.stage(spark.createDataFrame([("a", "2"), ("n", "new")], KIND))  # killed before its commit
    assert held(store) == {"a": "1", "b": "1"} and store.pending() == [dead]
    assert store.recover() == {dead: "committed"} and held(store) == {"a": "2", "b": "1", "n": "new"}
    late = store.stage(spark.createDataFrame([("b", "late"), ("a", "3")], KIND))
    same = store.stage(spark.createDataFrame([("b", "early")], KIND))
    store.commit(same, store.version())
    again = store.stage(spark.createDataFrame([("b", "early")], KIND))
    torn = tmp_path / "data" / "txn=torn"
    torn.mkdir()
    assert {r.path: r.state for r in store.judge(late).collect()} == {"b": "conflict", "a": "untouched"}
    assert store.recover() == {late: "conflict", again: "done", "torn": "torn"}
    assert held(store) == {"a": "2", "b": "early", "n": "new"}
