"""What stands in what: parents, containers, roots, qualified names and the owners of lines, from one sweep of a file.

Symbols and references of a file pass in the order of their lines; what has begun and not yet ended is a list as long as
the nesting is deep, and every answer is read off that list. So a range costs one row, however many lines it has, and a
file is never gathered: rows stream by.

Rules: a parent is what began last, on an earlier line, and hasn't ended before the line; of symbols that begin on one line
only the one that ends first has one. A container is the smallest range that begins earlier and reaches as far, the first
symbol on ties; a root is a symbol that no other covers, equal ranges covering each other. An owner is the smallest function
or method around a line, the first on ties. Null names count as empty; a symbol without an end ends where it begins.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lithic.operators.binding import enclosing
from lithic.plans.catalogue import query
from lithic.plans.dialect import DUCK
from lithic.sources.relations import relation, with_ctes

OWNERS = ("function", "method")
#: What a reference may stand in.
HOLDERS = (*OWNERS, "class")
RESULT = "file_id long, id long, ref string, parent_id long, parent string, parent_line long, qualified string, depth long, container_id long, container string, root boolean, line long"
_FIELDS = [(c.split()[0], {"long": pa.int64(), "string": pa.string(), "boolean": pa.bool_()}[c.split()[1]]) for c in RESULT.split(", ")]


class Open:
    """A symbol that has begun."""

    __slots__ = ("depth", "end", "id", "name", "owner", "qualified", "start")

    def __init__(self, start: int, end: int, id_: int, name: str, owner: bool):
        self.start, self.end, self.id, self.name, self.owner = start, end, id_, name, owner


class Sweep:
    """One file after another: symbols that begin on a line are taken together, then the references on it."""

    def __init__(self):
        self.file, self.open, self.line, self.now = None, [], None, []

    def begin(self, file: int, line: int) -> list[tuple]:
        """Moves on to a line. Returns the answers for the symbols of the line before."""
        if file == self.file and line == self.line:
            return []
        out = self.settle()
        self.open = [s for s in self.open if s.end >= line] if file == self.file else []
        self.file, self.line = file, line
        return out

    def settle(self) -> list[tuple]:
        now, self.now, out = self.now, [], []
        furthest = max((s.end for s in now), default=0)
        alone = sum(s.end == furthest for s in now) == 1
        for k, s in enumerate(now):
            parent = self.open[-1] if self.open and not k else None
            around = [p for p in self.open if p.end >= s.end]
            container = min(around, key=lambda p: (p.end - p.start, p.id), default=None)
            s.qualified, s.depth = (f"{parent.qualified}.{s.name}", parent.depth + 1) if parent else (s.name, 0)
            root = not around and s.end == furthest and alone
            out.append((self.file, s.id, None, parent and parent.id, parent and parent.name, parent and parent.start, s.qualified, s.depth, container and container.id, container and container.name, root, s.start))
        self.open += now
        return out

    def owner(self) -> Open | None:
        return min((s for s in self.open if s.owner), key=lambda s: (s.end - s.start, s.id), default=None)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows, strict=True), _FIELDS, strict=True)], [n for n, _ in _FIELDS])


def _run(batches):
    sweep = Sweep()
    for b in batches:
        out = []
        for file, line, ref, end, id_, name, owner in zip(*(c.to_pylist() for c in b.columns), strict=True):
            out += sweep.begin(file, line)
            if ref is None:
                sweep.now.append(Open(line, max(end or line, line), id_, name or "", owner))
            else:
                out += sweep.settle()
                if s := sweep.owner():
                    out.append((file, None, ref, s.id, s.name, s.start, None, None, None, None, None, line))
        if out:
            yield _batch(out)
    if out := sweep.settle():
        yield _batch(out)


def nested(symbols: DataFrame, refs: DataFrame | None = None, owners: tuple[str, ...] = OWNERS) -> DataFrame:
    """RESULT: a row for each of symbols (id, file_id, name, type, start_line, end_line), and one for each of refs (id,
    file_id, line) that has an owner, which is its parent."""
    owner = F.col("type").isin(*owners)
    rows = symbols.select("file_id", F.col("start_line").cast("long").alias("line"), F.lit(None).cast("string").alias("ref"), F.col("end_line").cast("long").alias("end_line"), "id", "name", owner.alias("owner"))
    if refs is not None:
        rows = rows.union(refs.select("file_id", F.col("line").cast("long"), F.col("id").cast("string"), *[F.lit(None).cast(t) for t in ("long", "long", "string", "boolean")]))
    dealt = rows.repartition("file_id").sortWithinPartitions("file_id", "line", F.col("ref").isNotNull(), "end_line", "id")
    return dealt.mapInArrow(_run, RESULT)


#: The symbol before another, in the order of the sweep, that reaches its line; of a file's symbols each against each.
_TOP = "select s.id, s.file_id, s.path, s.name, s.start_line, max(case when p.id is not null then (p.start_line, p.end_line, p.id) end) as top from symbols s left join symbols p on p.file_id = s.file_id and (p.start_line, p.end_line, p.id) < (s.start_line, s.end_line, s.id) and p.end_line >= s.start_line group by all"
_PARENT = f"select t.id, t.path, t.name, t.start_line, p.id as parent_id, p.start_line as parent_line from ({_TOP}) t left join symbols p on p.file_id = t.file_id and (p.start_line, p.end_line, p.id) = t.top and p.start_line <> t.start_line"


def _symbols(spark, source) -> DataFrame:
    return relation(spark, source, "symbols")


@query("win03_parent_assignment", with_ctes(f"select path, name, start_line, parent_line from ({_PARENT}) p", DUCK, ("symbols",)))
def _(spark, source):
    symbols = _symbols(spark, source)
    return symbols.select("id", "path", "name", "start_line").join(nested(symbols).select("id", "parent_line"), "id").drop("id")


@query("grf08_qualified_name", with_ctes(f"with recursive parent as ({_PARENT}), q as (select id, path, name as qualified, 0::bigint as depth from parent where parent_id is null union all select p.id, p.path, concat(q.qualified, '.', p.name), q.depth + 1 from q join parent p on p.parent_id = q.id) select path, id, qualified, depth from q", DUCK, ("symbols",)))
def _(spark, source):
    symbols = _symbols(spark, source)
    return nested(symbols).select("id", "qualified", "depth").join(symbols.select("id", "path"), "id").select("path", "id", "qualified", "depth")


@query(
    "jn11_containment",
    with_ctes(
        """with inside as (select c.id, p.id as parent_id, p.name as parent_name, row_number() over (partition by c.id order by p.end_line - p.start_line, p.id) as rn from symbols c join symbols p on p.file_id = c.file_id and p.start_line < c.start_line and c.end_line <= p.end_line),
        covered as (select distinct c.id from symbols c join symbols p on p.file_id = c.file_id and p.id <> c.id and p.start_line <= c.start_line and c.end_line <= p.end_line)
        select s.id, s.name, i.parent_id, i.parent_name, v.id is null as root from symbols s left join inside i on i.id = s.id and i.rn = 1 left join covered v on v.id = s.id""",
        DUCK,
        ("symbols",),
    ),
)
def _(spark, source):
    symbols = _symbols(spark, source)
    found = nested(symbols).select("id", F.col("container_id").alias("parent_id"), F.col("container").alias("parent_name"), "root")
    return symbols.select("id", "name").join(found, "id")


def owned(refs: DataFrame, symbols: DataFrame, key: str) -> DataFrame:
    """(key, line, source_symbol_id, source_name): each reference that a function, method or class holds, by a column that it
    is to be known by."""
    found = nested(symbols, refs.where("file_id is not null").select(F.col(key).alias("id"), "file_id", "line"), HOLDERS).where("ref is not null")
    return found.select(F.col("ref").alias(key), "line", F.col("parent_id").alias("source_symbol_id"), F.col("parent").alias("source_name"))


_HELD = f"({enclosing(DUCK, ', '.join(repr(x) for x in HOLDERS))}) e"


@query("jn10_enclosing_symbol", with_ctes(f"select path, source_name, source_symbol_id, count(*) as n, min(line) as first_line from {_HELD} group by path, source_name, source_symbol_id", DUCK, ("refs", "symbols")))
def _(spark, source):
    """Of references of every kind. A line's references have one owner, so they go through the sweep as one row."""
    lines = relation(spark, source, "refs").groupBy("file_id", "path", "line").agg(F.count("*").alias("n")).withColumn("key", F.to_json(F.struct("path", "n")))
    held = owned(lines, _symbols(spark, source), "key").withColumn("key", F.from_json("key", "path string, n long"))
    return held.groupBy("key.path", "source_name", "source_symbol_id").agg(F.sum("key.n").alias("n"), F.min("line").alias("first_line"))


@query("jn03_caller_symbols", with_ctes(f"select e.id, e.line, e.target_name, f.lang, e.source_name from {_HELD} join files f on f.file_id = e.file_id where e.kind = 'call'", DUCK, ("refs", "symbols", "files")))
def _(spark, source):
    calls = relation(spark, source, "refs").where("kind = 'call'")
    held = owned(calls, _symbols(spark, source), "id").drop("line")
    files = relation(spark, source, "files").select("file_id", "lang")
    return calls.select("id", "file_id", "line", "target_name").join(held, "id").join(files, "file_id").select("id", "line", "target_name", "lang", "source_name")
