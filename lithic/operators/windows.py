"""Windows: first of a group, stable ids, contexts, running states, page packing, prefixes and suffixes."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from lithic.plans.catalogue import both, query
from lithic.sources.relations import relation


@both("win01_first_of_group", "symbols")
def _(d):
    return "select name, path, start_line from (select name, path, start_line, row_number() over (partition by name order by end_line - start_line, id) as rn from symbols) x where rn = 1"


@both("win02_stable_id", "symbols")
def _(d):
    return f"""select path, start_line, case when n = 1 then stable when n_sig = 1 then concat(stable, '#sig-', substr(sig, 1, 8)) else concat(stable, '#', cast(rn as varchar(20))) end as stable_id from (
        select path, start_line, stable, sig, count(*) over (partition by stable) as n, count(*) over (partition by stable, sig) as n_sig, row_number() over (partition by stable order by start_line) as rn from (
        select path, start_line, concat('text:', {d.replace('path', '[#:]', '_')}, '::', name, '#', type) as stable, {d.sha('signature')} as sig from symbols) s) x"""


@both("win04_context", "lines")
def _(d):
    # one line about a hit, and how many there are within five
    return """select path, line, concat(case when before is null then '' else concat(before, '|') end, text, case when after is null then '' else concat('|', after) end) as context, n_within_5 from (
        select path, line, text, lag(text) over (partition by path order by line) as before, lead(text) over (partition by path order by line) as after, count(*) over (partition by path order by line rows between 5 preceding and 5 following) as n_within_5 from lines) x where instr(text, 'from') > 0"""


def pack(sizes: list[int], budget: int, most: int) -> list[int]:
    """Greedy pages: an entry that would exceed the budget or the number of entries opens the next page."""
    out, page, used, n = [], 1, 0, 0
    for s in sizes:
        if n and (used + s > budget or n >= most):
            page, used, n = page + 1, 0, 0
        used, n = used + s, n + 1
        out.append(page)
    return out


@query("win05_page_packing")
def _(spark, sf_dir):
    """Order-dependent, so one directory's entries are packed together; directories are independent."""
    files = relation(spark, sf_dir, "files").groupBy("dir", "lang").agg(F.sum(F.ceil(F.length("content") / 4)).cast("long").alias("tokens"))

    def pages(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("lang")
        return pdf.assign(page=pack(pdf.tokens.tolist(), 30_000, 40))

    return files.groupBy("dir").applyInPandas(pages, "dir string, lang string, tokens long, page long")


@both("win06_state_parity", "code")
def _(d):
    # which lines begin inside a triple quote, a template or a block comment: delimiters before them, modulo two or open minus closed
    before = lambda x: f"coalesce(sum({x}) over (partition by path order by line rows between unbounded preceding and 1 preceding), 0)"
    triple, tick = d.count("text", chr(34) * 3), d.count("text", "`")
    opened, closed = d.count("text", "/[*]"), d.count("text", "[*]/")
    return f"""select path, line, case when {d.rlike('path', '[.]py$')} then t % 2 = 1 when {d.rlike('path', '[.]([mc]?[jt]sx?|go|rs|c|cpp|java)$')} then o > c or k % 2 = 1 else false end as inside from (select path, line, {before(triple)} as t, {before(tick)} as k, {before(opened)} as o, {before(closed)} as c from code) x"""


def _block(name: str, n: int) -> list[str]:
    return [f"function {name}(a) {{", *["  a = '}' + a"] * (n - 2), "}"]


#: A file of code: blocks of 60, 1, 50 and 51 lines, with lines of no block between them.
CODE = [*_block("longest", 60), "x = 1", "function one() { return 1 }", *_block("fits", 50), "", *_block("over", 51)]


@both("win07_long_blocks", "lines")
def _(d):
    # depth runs over braces outside strings; a block lasts from the line that opens it to the one that closes it
    bare = d.replace("text", "'[^']*'", "") if d.name == "duck" else "regexp_replace(text, \"'[^']*'\", '')"
    change = f"length(replace({bare}, '}}', '')) - length(replace({bare}, '{{', ''))"
    source = f"(select 'code' as path, cast(i as bigint) as line, x as text from {d.table('i, x', list(enumerate(CODE, 1)))} v union all select path, line, text from lines)"
    return f"""with r as (select path, line, text, sum({change}) over (partition by path order by line rows between unbounded preceding and current row) as depth from {source} s),
        e as (select path, line, text, depth, coalesce(lag(depth) over (partition by path order by line), 0) as before from r),
        g as (select path, line, text, sum(case when before <= 0 and depth > 0 then 1 else 0 end) over (partition by path order by line rows between unbounded preceding and current row) as block from e where depth > 0 or before > 0)
        select path, {d.extract('min(case when rn = 1 then text end)', 'function +([A-Za-z_]+)')} as name, min(line) as start_line, count(*) as n from (select path, block, line, text, row_number() over (partition by path, block order by line) as rn from g) x group by path, block having count(*) > 50"""


@both("win08_range_conflicts", "symbols")
def _(d):
    return "select path, start_line, name, coalesce(lag(end_line) over (partition by path order by start_line, id) >= start_line, false) as conflict from symbols"


@both("win09_line_delta", "edits", "files")
def _(d):
    # where a file's later edits stand once the earlier ones are made
    from lithic.operators.binding import edit_ranges

    return f"select path, seq, start, start + coalesce(grown, 0) as moved_to from (select path, seq, start, cast(sum(grows) over (partition by file_id order by start, seq rows between unbounded preceding and 1 preceding) as bigint) as grown from {edit_ranges(d)} e) x"


def common_ends(d) -> str:
    """file_id, n_old, n_new, prefix, suffix: equal lines at both ends of a file's two versions; no line counts twice."""
    lines_ = lambda t: d.each(f"(select file_id, content as c_ from {t}) q", d.split("c_", "\\n"), "i t", "file_id")
    placed = lambda t: f"(select file_id, i, t, count(*) over (partition by file_id) as n from {lines_(t)} p_)"

    def pairs(place: str) -> str:
        """Lines of both versions side by side at a place, which counts from 0: the first place that differs."""
        old, new = place.replace("x.", "b."), place.replace("x.", "a.")
        return f"(select b.file_id, min(case when b.t <> a.t then {old} end) as n_same, max(b.n) as n_old, max(a.n) as n_new from {placed('before')} b join {placed('after')} a on a.file_id = b.file_id and {new} = {old} group by b.file_id)"

    return f"""(select file_id, n_old, n_new, prefix, least(ending, least(n_old, n_new) - prefix) as suffix from (
        select f.file_id, f.n_old, f.n_new, coalesce(f.n_same, least(f.n_old, f.n_new)) as prefix, coalesce(l.n_same, least(f.n_old, f.n_new)) as ending from {pairs('x.i - 1')} f join {pairs('x.n - x.i')} l on l.file_id = f.file_id) e_)"""


@both("win10_common_prefix", "before", "after")
def _(d):
    return f"select file_id, prefix, suffix, n_new - prefix - suffix as added, n_old - prefix - suffix as removed from {common_ends(d)} x"
