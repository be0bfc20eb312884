"""Source trees, logs and manifests as DataFrames; snapshots written, opened and kept up.

``read_tree`` reads a folder of sources, ``relations_of`` makes of it the relations that queries run on (those of
``relations.py``), ``write_snapshot`` and ``open_snapshot`` keep them as Parquet, so that a query reads an index.
"""

from __future__ import annotations

import posixpath
import re
from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lithic.functions import extract as X
from lithic.operators.search import EXTENSIONS, IGNORED, TEST_PATH, ignore_pattern
from lithic.plans.dialect import SPARK
from lithic.sources.relations import Relations, relation, run

MOST_BYTES, DEEPEST = 1 << 20, 8
#: Files that projects are described by, beside their sources.
DESCRIBED = ("package.json", "package-lock.json", "pyproject.toml", "poetry.lock", "requirements*.txt", "go.mod", "go.sum", "Cargo.toml", "Cargo.lock", "*.yml", "*.yaml", "*.log", "*.diff", "*.patch", ".env", ".env.*", ".rules")


def _walk(spark: SparkSession, root: str, deepest: int) -> tuple[str, list[str], list[tuple[str, int]]]:
    """(root as the file system writes it, its folders that aren't ignored, hidden or too deep, empty files in these)."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    at = path(root)
    fs = at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    start = fs.makeQualified(at).toString()
    folders, empty, todo = [], [], [(start, 1)]
    while todo:
        folder, depth = todo.pop()
        folders.append(folder)
        for s in fs.listStatus(path(folder)):
            name = s.getPath().getName()
            if s.isDirectory():
                if depth < deepest and name not in IGNORED and not name.startswith("."):
                    todo.append((s.getPath().toString(), depth + 1))
            elif s.getLen() == 0:
                empty.append((s.getPath().toString(), s.getModificationTime()))
    return start, folders, empty


def read_tree(spark: SparkSession, root: str, extensions: tuple[str, ...] = tuple(EXTENSIONS), ignore: tuple[str, ...] = (), names: tuple[str, ...] = DESCRIBED, most: int | None = None) -> DataFrame:
    """(path, size, mtime, content, content_hash, truncated): files of known kinds or names below root, less ignored, hidden
    and deep ones; paths are relative to root. Folders are listed first, so that nothing in ignored ones is read. With most,
    the first so many by path, and truncated says whether there were more."""
    start, folders, empty = _walk(spark, root, DEEPEST)
    kinds = "{" + ",".join([*(f"*.{e}" for e in extensions), *names]) + "}"
    raw = spark.read.format("binaryFile").option("pathGlobFilter", kinds).load(folders).where(F.col("length") <= MOST_BYTES).select("path", "length", "modificationTime", "content")
    wanted = re.compile("|".join(["[^/]*[.](?:" + "|".join(map(re.escape, extensions)) + ")", *(re.escape(n).replace(r"\*", "[^/]*") for n in names)]))
    rows = [(p, 0, t / 1000.0, bytearray()) for p, t in empty if wanted.fullmatch(posixpath.basename(p))]
    if rows:
        raw = raw.union(spark.createDataFrame(rows, "path string, length long, at double, content binary").select("path", "length", F.timestamp_seconds("at"), "content"))
    path = F.substr(F.col("path"), F.lit(len(start.rstrip("/")) + 2))
    files = raw.select(path.alias("path"), F.col("length").alias("size"), F.col("modificationTime").alias("mtime"), F.col("content").cast("string").alias("content"), F.sha2("content", 256).alias("content_hash"))
    for rule in ignore:
        files = files.where(~F.col("path").rlike(ignore_pattern(rule)))
    if most is None:
        return files.withColumn("truncated", F.lit(False))
    return files.orderBy("path").limit(most).withColumn("truncated", F.lit(files.select("path").limit(most + 1).count() > most))


def read_files(spark: SparkSession, root: str, paths: list[str]) -> DataFrame:
    """The files at some paths below root, as read_tree has them."""
    at = spark._jvm.org.apache.hadoop.fs.Path(root)
    start = at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).makeQualified(at).toString().rstrip("/")
    schema = "path string, size long, mtime timestamp, content string, content_hash string"
    if not paths:
        return spark.createDataFrame([], schema)
    glob = [f"{start}/" + re.sub(r"([\\\[\]{}*?])", r"\\\1", p) for p in paths]
    raw = spark.read.format("binaryFile").load(glob)
    path = F.substr(F.col("path"), F.lit(len(start) + 2))
    return raw.select(path.alias("path"), F.col("length").alias("size"), F.col("modificationTime").alias("mtime"), F.col("content").cast("string").alias("content"), F.sha2("content", 256).alias("content_hash"))


ROW = "file_id long, path string, row string, name string, kind string, line int, end_line int, module string, target string, source int, signature string"


def target_of(path: str, module: str) -> str:
    """What a module's name stands for, as a path without its ending: relative names against the importer's folder, dotted
    ones with slashes."""
    folder = posixpath.dirname(path)
    if module.startswith("./") or module.startswith("../") or module in (".", ".."):
        module = posixpath.normpath(posixpath.join(folder, module))
    elif X.language_of(path) == "python":
        dots = len(module) - len(module.lstrip("."))
        tail = module.lstrip(".").replace(".", "/")
        for _ in range(max(0, dots - 1)):
            folder = posixpath.dirname(folder)
        module = posixpath.normpath(posixpath.join(folder, tail)) if dots else tail
    elif X.language_of(path) == "java":
        module = module.replace(".", "/")
    return bare(module)


_ENDING, _WHOLE = r"\.(?:[mc]?[jt]sx?|py|go|rs|h|hpp|c|cc|cpp|java|sh|bash)$", r"/(?:index|__init__)$"


def bare(path: str) -> str:
    """A path without its ending; an index or package file stands for its folder."""
    return re.sub(_WHOLE, "", re.sub(_ENDING, "", path))


def _rows(file_id: int, path: str, content: str) -> list[tuple]:
    """A file's symbols and references; source: the number of the innermost function that a reference stands in."""
    got, lines = X.extract(path, content), content.split("\n")
    symbols = sorted(got.symbols, key=lambda s: (s.start_line, -s.end_line, s.name))
    out = [(file_id, path, "symbol", s.name, s.kind, s.start_line, s.end_line, "", "", n, lines[s.start_line - 1].strip()[:200]) for n, s in enumerate(symbols, 1)]
    functions = [(s.start_line, s.end_line, n) for n, s in enumerate(symbols, 1) if s.kind in ("function", "method")]
    starts, best = [f[0] for f in functions], {}
    for r in got.refs:
        if r.line not in best:
            around = [(e - a, n) for a, e, n in functions[: bisect_right(starts, r.line)] if e >= r.line]
            best[r.line] = min(around)[1] if around else 0
        out.append((file_id, path, "ref", r.name, r.kind, r.line, r.line, r.module, target_of(path, r.module) if r.kind == "import" and r.module else "", best[r.line], ""))
    return out


def numbered(files: DataFrame) -> DataFrame:
    """files with file_id: their place by path. Each part of the paths is numbered by itself; parts' sizes add up."""
    from lithic.operators.graphs import cut

    ordered = cut(files.select("path").repartitionByRange("path").select("path", F.spark_partition_id().alias("part")))
    own = ordered.withColumn("n", F.row_number().over(Window.partitionBy("part").orderBy("path")))
    sizes, before = {r.part: r["count"] for r in ordered.groupBy("part").count().collect()}, {}
    for k in sorted(sizes):
        before[k] = sum(sizes[j] for j in sizes if j < k)
    first = F.create_map(*[F.lit(int(x)) for pair in before.items() for x in pair]) if before else F.create_map(F.lit(0), F.lit(0))
    return files.join(own.select("path", (F.col("n") + F.element_at(first, F.col("part"))).cast("long").alias("file_id")), "path")


def extracted(files: DataFrame) -> DataFrame:
    """files (file_id, path, content) as the rows of ROW, a symbol or a reference each."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([r for i, p, c in zip(b.file_id, b.path, b.content, strict=True) for r in _rows(i, p, c or "")], columns=[c.split()[0] for c in ROW.split(", ")])

    return files.select("file_id", "path", "content").mapInPandas(each, ROW)


def symbols_and_refs(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    symbols = rows.where("row = 'symbol'").select((F.col("file_id") * 1_000_000 + F.col("source")).alias("id"), "file_id", "path", "name", F.col("kind").alias("type"), "signature", F.col("line").cast("long").alias("start_line"), F.col("end_line").cast("long").alias("end_line"))
    name = F.when(F.col("kind") == "call", F.element_at(F.split("name", r"\.|::"), -1)).otherwise(F.col("name"))
    refs = rows.where("row = 'ref'").select("file_id", "path", F.col("line").cast("long").alias("line"), "kind", "name", name.alias("target_name"), "module", "target", F.when(F.col("source") > 0, F.col("file_id") * 1_000_000 + F.col("source")).alias("source_symbol_id"))
    refs = refs.withColumn("place", F.row_number().over(Window.partitionBy("file_id", "line").orderBy("kind", "name", "module")).cast("long")).withColumn("id", F.concat_ws(":", "file_id", "line", "place"))
    return symbols, refs.withColumn("expr", F.when(F.col("kind") == "call", F.col("name")).otherwise(F.lit("")))


def relations_of(files: DataFrame) -> dict[str, DataFrame]:
    """files: as read_tree gives them. The relations that queries on code run on; each is derived from one extraction, which
    is cut off from the files."""
    from lithic.operators.graphs import cut

    files = cut(numbered(files))
    symbols, refs = symbols_and_refs(cut(extracted(files)))
    aliases = aliases_of(files)
    return derived(files, symbols, cut(bind(refs, symbols, files, aliases)), aliases)


def derived(files: DataFrame, symbols: DataFrame, bound: DataFrame, aliases: DataFrame) -> dict[str, DataFrame]:
    """All relations, of the files, their symbols, bound references and aliases."""
    from lithic.operators.postings import postings

    family = F.when(F.col("path").rlike(r"[.][mc]?[jt]sx?$"), "js").otherwise(F.regexp_extract("path", r"[.]([A-Za-z]+)$", 1))
    functions = symbols.where("type in ('function', 'method')").select("id", "name", "path", F.regexp_extract("path", "^([^/]*)/", 1).alias("dir"), family.alias("family"), F.col("path").rlike(TEST_PATH).alias("is_test"), F.col("type").alias("kind"), "start_line")
    calls = bound.where("kind = 'call' and source_symbol_id is not null and target_symbol_id is not null and source_symbol_id <> target_symbol_id").select(F.col("source_symbol_id").alias("src"), F.col("target_symbol_id").alias("dst")).distinct()
    parts = F.split(F.regexp_replace(F.regexp_replace("path", _ENDING, ""), _WHOLE, ""), "/")
    tails = files.select(F.col("file_id").alias("dst"), F.posexplode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, 1000), "/"))).alias("cut", "target"))
    asked = bound.where("kind = 'import' and target <> ''").select(F.col("file_id").alias("src"), "path", "target", F.col("module").rlike(r"^[.]").alias("near")).distinct()
    # a relative name is a whole path; others are the end of one, and the shortest path wins
    met = asked.join(tails, "target").where("(not near or cut = 0) and src <> dst")
    first = Window.partitionBy("src", "target").orderBy("cut", "dst")
    imports = met.withColumn("_n", F.row_number().over(first)).where("_n = 1").select("src", "dst").distinct()
    lines = files.select("file_id", "path", F.posexplode(F.split("content", "\n", -1)).alias("at", "text")).select("file_id", "path", (F.col("at") + 1).cast("long").alias("line"), "text")
    lang = F.regexp_extract("path", r"[.]([A-Za-z]+)$", 1)
    return {
        "files": files.select("file_id", "path", F.regexp_extract("path", "^([^/]*)/", 1).alias("dir"), lang.alias("lang"), "size", "content", "mtime", "content_hash"),
        "lines": lines,
        "symbols": symbols,
        "refs": bound,
        "calls": calls,
        "functions": functions,
        "imports": imports,
        "requires": imports,
        "touched": files.select("path", F.datediff(F.current_date(), "mtime").cast("long").alias("age"), F.lit(False).alias("edited")),
        "modules": files.select(F.col("file_id").alias("id"), "path"),
        "code": lines.select("path", "line", "text"),
        "texts": files.select("path", "content"),
        "aliases": aliases,
        "postings": postings(symbols.select("name").union(bound.select("target_name"))),
    }


def aliases_of(files: DataFrame) -> DataFrame:
    """(file_id, local, original, place): the names that a file's imports give to what they bring."""
    from lithic.operators.resolution import alias_map

    found = run(files.sparkSession, Relations({"texts": files.select("path", "content")}), alias_map(SPARK), ("texts",))
    return found.join(files.select("path", "file_id"), "path").select("file_id", "local", "original", "place")


def bind(refs: DataFrame, symbols: DataFrame, files: DataFrame, aliases: DataFrame) -> DataFrame:
    """refs with target_symbol_id: what an alias stands for, else the last symbol of that name in the file, else the candidate
    of another file that the call's module speaks of, or the first."""
    from lithic.operators.resolution import OWN, elsewhere, rebound

    spark = refs.sparkSession
    given = Relations({"refs": refs, "symbols": symbols, "files": files.select("file_id", "path"), "aliases": aliases})
    other = run(spark, given, elsewhere(SPARK), ("refs", "symbols", "files")).select("id", F.col("target_symbol_id").alias("other_id"))
    alias = run(spark, given, rebound(SPARK), ("refs", "symbols", "aliases")).select("id", F.col("target_symbol_id").alias("alias_id"))
    own = symbols.groupBy("file_id", F.col("name").alias("target_name")).agg(F.max("id").alias("own_id"))
    own_id = F.when(F.col("kind").isin(*OWN), F.col("own_id"))
    return refs.join(own, ["file_id", "target_name"], "left").join(other, "id", "left").join(alias, "id", "left").withColumn("target_symbol_id", F.coalesce("alias_id", own_id, "other_id")).drop("own_id", "other_id", "alias_id")


BOUND = ("file_id", "path", "line", "kind", "name", "target_name", "module", "target", "source_symbol_id", "place", "id", "expr", "target_symbol_id")
#: Changed files that are read by name; beyond it the tree is read whole.
NAMED = 10_000


def changes(spark: SparkSession, root: str, files: DataFrame, **how) -> DataFrame:
    """(path, change) of a tree against indexed files (path, size, mtime): new, changed or gone, by size and time of change;
    contents aren't read."""
    now = read_tree(spark, root, **how).select("path", F.col("size").alias("size_now"), F.col("mtime").alias("mtime_now"))
    met = now.join(files.select("path", "size", "mtime"), "path", "full_outer")
    change = F.when(F.col("size").isNull(), "new").when(F.col("size_now").isNull(), "gone").when((F.col("size") != F.col("size_now")) | (F.col("mtime") != F.col("mtime_now")), "changed")
    return met.select("path", change.alias("change")).where("change is not null")


def refresh(spark: SparkSession, root: str, old: Relations, **how) -> tuple[Relations, DataFrame]:
    """The relations of a tree as it is now, from those of before, and the references that were bound anew.

    Only files that are new or changed are read and extracted; a file keeps its number, new ones follow the last. A
    reference is bound anew if its file changed, or if its name, or what its alias stands for, is the name of a symbol that
    some file gained or lost: no other binding can change. The result is what binding everything would give.
    """
    from lithic.operators.graphs import cut

    changed = cut(changes(spark, root, old["files"], **how))
    todo = [r.path for r in changed.where("change <> 'gone'").select("path").limit(NAMED + 1).collect()]  # at most NAMED + 1
    if len(todo) <= NAMED:
        text = read_files(spark, root, todo)
    else:
        text = read_tree(spark, root, **how).join(changed.where("change <> 'gone'").select("path"), "path", "left_semi")
    last = old["files"].agg(F.coalesce(F.max("file_id"), F.lit(0))).first()[0]
    known = text.join(old["files"].select("path", "file_id"), "path", "left")
    fresh = numbered(known.where("file_id is null").drop("file_id")).withColumn("file_id", F.col("file_id") + F.lit(last))
    columns = ["file_id", "path", "size", "mtime", "content", "content_hash"]
    added = cut(known.where("file_id is not null").select(*columns).union(fresh.select(*columns)))
    symbols_, refs_ = symbols_and_refs(cut(extracted(added)))
    aliases_ = aliases_of(added)

    stale = old["files"].join(changed.select("path"), "path", "left_semi").select("file_id")
    kept = {n: old[n].join(stale, "file_id", "left_anti") for n in ("files", "symbols", "refs", "aliases")}
    files = kept["files"].select(*columns).union(added)
    symbols, aliases = cut(kept["symbols"].unionByName(symbols_)), kept["aliases"].unionByName(aliases_)
    moved = cut(old["symbols"].join(stale, "file_id", "left_semi").select("name").union(symbols_.select("name")).distinct())
    meant = aliases.join(moved.withColumnRenamed("name", "original"), "original", "left_semi").select("file_id", F.col("local").alias("target_name")).distinct()
    by_name = kept["refs"].join(moved.withColumnRenamed("name", "target_name"), "target_name", "left_semi")
    by_alias = kept["refs"].where("kind = 'call'").join(meant, ["file_id", "target_name"], "left_semi")
    plain = [c for c in BOUND if c != "target_symbol_id"]
    again = cut(by_name.select(*plain).union(by_alias.select(*plain)).distinct().union(refs_.select(*plain)))
    # what the references to bind may mean: symbols of their names, and of what their files' aliases stand for
    own = aliases.join(again.select("file_id", F.col("target_name").alias("local")).distinct(), ["file_id", "local"], "left_semi")
    names = again.select(F.col("target_name").alias("name")).union(own.select("original")).distinct()
    bound = cut(bind(again, symbols.join(names, "name", "left_semi"), files, own).select(*BOUND))
    refs = cut(kept["refs"].join(bound.select("id"), "id", "left_anti").select(*BOUND).union(bound))
    return Relations(derived(cut(files), symbols, refs, cut(aliases))), bound


def index(spark: SparkSession, root: str, **how) -> Relations:
    """A folder of sources as relations that any query of the catalogue on code runs on."""
    return Relations(relations_of(read_tree(spark, root, **how)))


def read_log(spark: SparkSession, path: str, schema: str, pollution: str | None = None) -> DataFrame:
    """JSON lines; bad ones are dropped, and those whose error_code holds the pollution marker."""
    rows = spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)
    return rows.where(F.coalesce(~F.col("error_code").contains(pollution), F.lit(True))) if pollution else rows


def append_log(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def migrate_logs(spark: SparkSession, old: list[str], new: str, schema: str, pollution: str) -> int:
    """Appends what is valid in the old logs to the new one, which stays as it was otherwise; returns how many rows."""
    from lithic.operators.graphs import cut

    rows = read_log(spark, old[0], schema, pollution)
    for path in old[1:]:
        rows = rows.unionByName(read_log(spark, path, schema, pollution))
    rows = cut(rows)
    append_log(rows, new)
    return rows.count()


#: What lookups filter a relation by; its files are laid out by it.
LAYOUT = {"postings": "gram", "symbols": "name", "refs": "target_name", "calls": "dst", "lines": "path", "code": "path"}


def write_snapshot(tables: dict[str, DataFrame], root: str) -> None:
    """One Parquet folder for each relation; those that lookups filter are laid out by what they filter by."""
    for name, df in tables.items():
        by = LAYOUT.get(name)
        (df.repartitionByRange(by).sortWithinPartitions(by) if by in df.columns else df).write.mode("overwrite").parquet(f"{root}/{name}")


class StaleSnapshot(Exception):
    """A snapshot is older than what it is asked about."""


def open_snapshot(spark: SparkSession, root: str, names: tuple[str, ...] = ("files", "symbols", "refs"), newest: object = None) -> Relations:
    """The relations of a written snapshot. With newest, a time, a snapshot whose files are all older is refused."""
    tables = {n: spark.read.parquet(f"{root}/{n}") for n in names}
    if newest is not None and tables["files"].where(F.col("mtime") >= F.lit(newest)).isEmpty():
        raise StaleSnapshot(f"{root} holds nothing as new as {newest}")
    return Relations(tables)


def snapshot_of_tables(spark: SparkSession, sf_dir: str, root: str, names: tuple[str, ...]) -> Relations:
    """Relations projected from tables, written once and read back: queries then read an index as well."""
    from lithic.operators.postings import postings

    write_snapshot({n: relation(spark, sf_dir, n) for n in names}, root)
    there = open_snapshot(spark, root, names)
    if not {"symbols", "refs"} <= set(names):
        return there
    write_snapshot({"postings": postings(there["symbols"].select("name").union(there["refs"].select("target_name")))}, root)
    return open_snapshot(spark, root, (*names, "postings"))


def upsert(base: DataFrame, changed: DataFrame, gone: DataFrame, key: str = "path") -> DataFrame:
    """The next snapshot: what neither changed nor went, and what changed."""
    kept = base.join(changed.select(key), key, "left_anti").join(gone.select(key), key, "left_anti")
    return kept.unionByName(changed, allowMissingColumns=True)
