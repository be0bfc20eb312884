"""The relational model (files, lines, symbols, refs, ...) over any tables: projections of the tables at hand.

Operators take these relations and don't know what made them: over tables they are projected from documents, pages,
events and the star schema; ``lithic.sources.trees`` makes the same relations from a source tree, and a query runs on
either. Each is a text for both engines; in Spark it is inlined in the plan, so Catalyst prunes columns and pushes filters
through to the scan.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession

from lithic.plans.dialect import SPARK, Spark
from lithic.sources import sample

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

RELATIONS: dict[str, tuple[tuple[str, ...], Callable[[Spark], str]]] = {
    "files": (("documents",), lambda d: "select doc_id as file_id, concat(source, '/', lang, '/', cast(doc_id as varchar(20)), '.txt') as path, source as dir, lang, n_chars as size, text as content from documents"),
    "lines": (("files",), lambda d: f"select file_id, path, line, text from {d.each('files', d.split('content', chr(92) + 'n'), 'line text', 'file_id, path')}"),
    # a symbol is a line's leading word; it reaches to the line before the next symbol, and the first one over the file
    "symbols": (
        ("lines",),
        lambda d: f"""select id, file_id, path, name, type, signature, start_line, end_line from (
            select file_id * 1000000 + line as id, file_id, path, {d.extract('text', '^([A-Za-z]+)')} as name,
              case when line = 1 then 'class' when {d.rlike('text', '^[A-Z]')} then 'function' else 'variable' end as type,
              {d.trim('substr(text, 1, 60)')} as signature, line as start_line,
              case when line = 1 then last_line else coalesce(lead(line) over (partition by file_id order by line) - 1, last_line) end as end_line
            from (select l.*, max(line) over (partition by file_id) as last_line from lines l) m where {d.rlike('text', '^[A-Za-z]')}) s""",
    ),
    # each word is a reference; its kind goes by its length, so that all kinds occur; the word before it qualifies it
    "refs": (
        ("lines",),
        lambda d: f"""select concat(cast(file_id as varchar(20)), ':', cast(line as varchar(20)), ':', cast(place as varchar(20))) as id, file_id, path, line, place, target_name,
              case when length(target_name) % 7 = 0 then 'import' when length(target_name) % 5 = 0 then 'call' when length(target_name) % 3 = 0 then 'assign' else 'use' end as kind,
              case when place > 1 then concat({d.item('words_', 'place - 1')}, '::', target_name) else target_name end as expr
            from {d.each(f"(select file_id, path, line, {d.extract_all('text', '([A-Za-z]+)')} as words_ from lines) w_", 'words_', 'place target_name', 'file_id, path, line, words_')}""",
    ),
    # the names that a file's imports give to what they bring: the word before an import
    "aliases": (("refs",), lambda d: f"select file_id, {d.extract('expr', '^([^:]+)::')} as local, target_name as original, line * 1000 + place as place from refs where kind = 'import' and instr(expr, '::') > 0"),
    # lines of code: a small project of our own beside the documents, which hold none
    "code": (("lines",), lambda d: f"select path, line, text from lines union all select path, line, text from {d.table('path, line, text', sample.ROWS)} s_"),
    "texts": (("files",), lambda d: f"select path, content from files union all select path, content from {d.table('path, content', sorted(sample.FILES.items()))} s_"),
    # the call graph: parts that follow each other in an order
    "calls": (
        ("lineitem",),
        lambda d: """select distinct src, dst from (select l_partkey as src, lead(l_partkey) over (partition by l_orderkey order by l_shipdate, l_partkey, l_suppkey, l_quantity, l_extendedprice) as dst from lineitem) e
            where dst is not null and src <> dst""",
    ),
    "functions": (("part",), lambda d: "select p_partkey as id, p_name as name, concat(p_brand, '/', cast(p_partkey % 40 as varchar(20)), case when p_partkey % 11 = 0 then '.test.js' when p_partkey % 3 = 0 then '.py' else '.js' end) as path, p_brand as dir, case when p_partkey % 3 = 0 and p_partkey % 11 <> 0 then 'py' else 'js' end as family, p_partkey % 11 = 0 as is_test, p_type as kind, p_size as start_line from part"),
    # the module graph: a country's customers depend on the suppliers of others
    "imports": (
        ("lineitem", "orders", "customer", "supplier"),
        lambda d: """select distinct c_nationkey as src, s_nationkey as dst from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey join supplier on l_suppkey = s_suppkey where c_nationkey <> s_nationkey""",
    ),
    # modules that require one or two others: of a part, those after it in its first and its last order
    "requires": (
        ("lineitem",),
        lambda d: """select distinct src, case e when 1 then after_first else after_last end as dst from (
            select src, max(case when up = 1 then dst end) as after_first, max(case when down = 1 then dst end) as after_last from (
              select src, dst, row_number() over (partition by src order by o, n) as up, row_number() over (partition by src order by o desc, n desc) as down from (
                select l_partkey as src, lead(l_partkey) over (partition by l_orderkey order by l_linenumber, l_partkey) as dst, l_orderkey as o, l_linenumber as n from lineitem) a where dst is not null and dst <> src) b group by src) c cross join (select 1 as e union all select 2) two""",
    ),
    "modules": (("nation",), lambda d: "select n_nationkey as id, n_name as path from nation"),
    "links": (("pages",), lambda d: f"select page_id as file_id, path, module, line from {d.each('pages_', d.extract_all('html', 'href=' + chr(34) + '([^' + chr(34) + ']+)' + chr(34)), 'line module', 'page_id, path')}"),
    "pages_": (("pages",), lambda d: f"select page_id, html, {d.extract('url', '^[a-z]+://[^/?#]*([^?#]*)')} as path, {d.extract('url', '^[a-z]+://([^/?#]*)')} as host from pages"),
    "messages": (("conversations",), lambda d: "select concat(cast(conv_id as varchar(20)), '/', cast(turn as varchar(20))) as path, text as content from conversations"),
    "usage": (("events",), lambda d: f"select event_id, ts, event_type as tool, case when event_type = 'error' then 'error' when event_id % 97 = 0 then 'crash' else 'ok' end as status, value as duration_ms, user_id as session, props, cast({d.json('props', 'k')} as bigint) as metric from events"),
    # a journal of transactions: what a session did, in its order
    "journal": (("usage",), lambda d: f"select event_id as seq, session as txn, {d.seconds('ts')} as at_s, case tool when 'view' then 'begin' when 'click' then 'edit' when 'purchase' then 'commit' when 'error' then 'rollback' when 'signup' then 'undo' else 'edit' end as action, concat('f', cast(event_id % 7 as varchar(20))) as path from usage"),
    # edits that were asked for: a file's first words, some that may overlap them, and what is in few files
    "edits": (
        ("files",),
        lambda d: " union all ".join(f"select file_id, path, {k} as seq, {old} as old, {new} as new from files where content is not null" for k, old, new in ((1, "substr(content, 1, 12)", "'first'"), (2, "substr(content, 9, 8)", "concat(substr(content, 9, 8), '!')"), (3, "'Licensed under'", "'Under'"), (4, "'no such text'", "substr(content, 1, 5)"))),
    ),
    # two snapshots of the files: some changed, some gone, some new
    "before": (("files",), lambda d: "select file_id, path, content, cast(file_id * 1000 as double) as mtime, 'fresh' as state from files where file_id % 13 <> 0"),
    "after": (("files",), lambda d: "select file_id, path, case when file_id % 7 = 0 then concat(content, ' edited') else content end as content, case when file_id % 7 = 0 then file_id * 1000 + 60000.4 else file_id * 1000 + 0.3 end as mtime from files where file_id % 11 <> 0"),
    # how long ago a file was touched, in days before the newest, and whether it is being edited
    "touched": (("before", "after"), lambda d: "select a.path, cast(floor((m.newest - a.mtime) / 86400000.0) as bigint) as age, coalesce(b.content <> a.content, false) as edited from after a cross join (select max(mtime) as newest from after) m left join before b on b.path = a.path"),
}


class Relations:
    """Relations that are at hand as DataFrames, as of a source tree; queries run on them as on tables."""

    def __init__(self, tables: Mapping[str, DataFrame]):
        self.tables, self.key = dict(tables), uuid.uuid4().hex[:12]
        for name, df in self.tables.items():
            df.createOrReplaceTempView(self.view(name))

    def view(self, name: str) -> str:
        return f"lithic_{self.key}_{name}"

    def __getitem__(self, name: str) -> DataFrame:
        return self.tables[name]


#: A folder of tables, or relations.
Source = str | Relations


def _order(needs: tuple[str, ...], given: frozenset[str] = frozenset()) -> list[str]:
    """The relations that are to be made, those that others are made of first."""
    out: list[str] = []

    def add(n: str) -> None:
        if n in RELATIONS and n not in out and n not in given:
            for below in (*RELATIONS[n][0], *(("pages_",) if n == "links" else ())):
                add(below)
            out.append(n)

    for n in needs:
        add(n)
    return out


def with_ctes(body: str, d: Spark, needs: tuple[str, ...], first: tuple[str, ...] = (), given: frozenset[str] = frozenset()) -> str:
    """body with its relations in front of it; first: further ones, ahead of these."""
    body = body.strip()
    ctes = ", ".join([*first, *(f"{n} as ({RELATIONS[n][1](d)})" for n in _order(needs, given))])
    if not ctes:
        return body
    for start in ("with recursive ", "with "):
        if body.startswith(start):
            return f"{start}{ctes}, {body[len(start):]}"
    return f"with {ctes} {body}"


def _views(spark: SparkSession, source: Source, text: str) -> tuple[str, ...]:
    """The given relations or tables that text speaks of, by names that no view of the session has."""
    words = set(re.findall(r"[A-Za-z_]+", text))
    if isinstance(source, Relations):
        return tuple(f"{n} as (select * from {source.view(n)})" for n in source.tables if n in words)
    key, out = hashlib.sha256(source.encode()).hexdigest()[:12], []
    for t in TABLES:
        if t in words:
            spark.read.parquet(f"{source}/{t}.parquet").createOrReplaceTempView(f"lithic_{key}_{t}")
            out.append(f"{t} as (select * from lithic_{key}_{t})")
    return tuple(out)


def run(spark: SparkSession, source: Source, body: str, needs: tuple[str, ...]) -> DataFrame:
    given = frozenset(source.tables) if isinstance(source, Relations) else frozenset()
    plain = with_ctes(body, SPARK, needs, (), given)
    return spark.sql(with_ctes(body, SPARK, needs, _views(spark, source, plain), given))


def relation(spark: SparkSession, source: Source, name: str) -> DataFrame:
    return run(spark, source, f"select * from {name}", (name,))
