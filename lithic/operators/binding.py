"""Joins: what a reference belongs to and what it means; drift, diffs and set differences."""

from __future__ import annotations

from pyspark.sql import functions as F

from lithic.plans.catalogue import both, query
from lithic.plans.dialect import DUCK
from lithic.sources.relations import relation, with_ctes

def enclosing(d, types: str = "'function', 'class'") -> str:
    """SQL for who encloses a reference: the smallest range of its file that holds its line; ties go to the first symbol.
    Ranges are spread over their lines, of which each keeps one symbol. (lithic.operators.nesting does it by a sweep.)"""
    lines = d.each(f"(select * from symbols where type in ({types})) s_", d.span("start_line", "end_line"), "k_ line", "file_id, id, name, start_line, end_line")
    return f"""select r.id, r.file_id, r.path, r.line, r.target_name, r.kind, c.id as source_symbol_id, c.name as source_name from refs r join (
        select file_id, line, id, name from (select file_id, line, id, name, row_number() over (partition by file_id, line order by end_line - start_line, id) as rn from {lines} l_) x where rn = 1) c on c.file_id = r.file_id and c.line = r.line"""


# the last symbol of a name in a file wins
SAME_FILE = "select r.id, r.file_id, r.target_name, r.kind, s.id as target_symbol_id from refs r left join (select file_id, name, max(id) as id from symbols group by file_id, name) s on s.file_id = r.file_id and s.name = r.target_name and r.kind in ('call', 'use', 'assign')"


@both("jn01_symbol_files", "symbols", "files")
def _(d):
    return "select s.name, s.start_line, f.path, f.lang from symbols s join files f on f.file_id = s.file_id where s.type = 'class'"


@both("jn02_callers", "calls", "functions")
def _(d):
    return "select c.src, c.dst, a.path as source_path, b.path as target_path from calls c join functions a on a.id = c.src left join functions b on b.id = c.dst and b.is_test = false"


@both("jn04_callees", "refs", "symbols")
def _(d):
    # by file, not by the symbol's own lines: a file's references fan out over its symbols of that name
    return "select s.name, r.target_name, count(*) as n from symbols s join refs r on r.file_id = s.file_id where s.name in ('Of', 'La', 'Th') and r.kind = 'call' group by s.name, r.target_name"


@both("jn05_or_match", "calls", "functions")
def _(d):
    # name or id: two equi-joins and a distinct, never one disjunction
    return """select distinct src, dst from (
        select c.src, c.dst from calls c join functions f on f.id = c.dst join (select name from functions where id = 7) n on n.name = f.name
        union all select c.src, c.dst from calls c where c.dst = 7) x"""


@both("jn06_file_impact_semi", "refs", "symbols")
def _(d):
    return "select r.path, r.line, r.place, r.target_name from refs r where r.target_name in (select name from symbols where file_id = 4)"


@both("jn07_same_file_bind", "refs", "symbols")
def _(d):
    return f"select file_id, count(*) as n_refs, count(target_symbol_id) as n_bound, max(target_symbol_id) as last_bound from ({SAME_FILE}) b group by file_id"


def first_elsewhere(source: str, keys: str, place: str, n: str = "count(*)") -> str:
    """For each value of keys: its least id, that id's place, and its least id at another place, so that whoever asks
    finds the first candidate away from home by one equi-join, however many candidates a key has."""
    return f"""(select {keys}, max(case when rn = 1 then id end) as first_id, max(case when rn = 1 then {place} end) as home, max(case when rn = 2 then id end) as next_id, max(n_all) as n_all from (
        select {keys}, {place}, id, row_number() over (partition by {keys} order by id) as rn, sum(n) over (partition by {keys}) as n_all from (select {keys}, {place}, min(id) as id, {n} as n from {source} group by {keys}, {place}) p_) q_ where rn <= 2 group by {keys})"""


@both("jn12_import_flag", "refs", "symbols")
def _(d):
    return "select r.id, r.target_name, i.file_id is not null as imported from refs r left join (select distinct file_id, lower(target_name) as name from refs where kind = 'import') i on i.file_id = r.file_id and i.name = lower(r.target_name) where r.kind <> 'import'"


@both("jn14_module_edges", "functions")
def _(d):
    # an import meets files by base name, an equi-join on a derived key; the first file that isn't the importer itself wins
    files = f"(select id, path, lower(name) as base from functions where {d.rlike('path', '[.](js|py)$')}) f_"
    return f"""select i.path as src, i.base, f.id as dst_id, g.path as dst from (select i_.path, i_.base, case when t.home = i_.path then t.next_id else t.first_id end as dst_id from (select path, lower(name) as base from functions) i_
        join {first_elsewhere(files, 'base', 'path')} t on t.base = i_.base) i join functions f on f.id = i.dst_id join functions g on g.id = f.id"""


@both("jn15_dangling_anti", "refs", "symbols", "after")
def _(d):
    # calls that were bound to a symbol of a file that has gone since: their target is taken away
    return """select b.id, case when s.id is null then null else b.target end as target_symbol_id, s.id is null as dangling from (select r.id, t.id as target from refs r join (select name, min(id) as id from symbols group by name) t on t.name = r.target_name where r.kind = 'call') b
        left join (select s.id from symbols s join after a on a.file_id = s.file_id) s on s.id = b.target"""


@both("jn16_unused_symbols", "symbols", "refs")
def _(d):
    return "select s.path, s.name, s.start_line from symbols s where not exists (select 1 from refs r where r.target_name = s.name and r.file_id <> s.file_id)"


@both("jn17_drift_anti", "refs", "symbols")
def _(d):
    return "select distinct r.target_name from refs r left join (select distinct name from symbols) s on s.name = r.target_name where s.name is null and r.kind = 'import'"




@both("jn19_full_outer_diff", "symbols")
def _(d):
    return """select coalesce(b.name, a.name) as name, coalesce(b.file_id, a.file_id) as file_id, case when b.name is null then 'added' when a.name is null then 'removed' when a.signature <> b.signature then 'signature_changed' else 'same' end as change
        from (select file_id, name, max(signature) as signature from symbols where file_id % 13 <> 0 group by file_id, name) b
        full outer join (select file_id, name, max(case when file_id % 7 = 0 then concat(signature, '!') else signature end) as signature from symbols where file_id % 11 <> 0 group by file_id, name) a on a.file_id = b.file_id and a.name = b.name"""


@both("jn20_caller_sync", "refs", "symbols", "before", "after")
def _(d):
    # who calls a symbol of a changed file and hasn't changed with it; a call means the first symbol of its name
    return """with changed as (select a.file_id from after a join before b on b.file_id = a.file_id where a.content <> b.content)
        select r.path as caller, s.path as changed, s.name, count(*) as n from refs r join (select name, min(id) as id from symbols group by name) t on t.name = r.target_name join symbols s on s.id = t.id
        join changed c on c.file_id = s.file_id left join changed o on o.file_id = r.file_id where r.kind = 'call' and o.file_id is null group by r.path, s.path, s.name"""


def edit_ranges(d) -> str:
    """(file_id, path, seq, start, stop, grows): where an edit's old text stands first, and by how much the file grows."""
    return "(select e.file_id, e.path, e.seq, cast(instr(f.content, e.old) as bigint) as start, cast(instr(f.content, e.old) + length(e.old) as bigint) as stop, cast(length(e.new) - length(e.old) as bigint) as grows from edits e join files f on f.file_id = e.file_id where e.old <> '' and instr(f.content, e.old) > 0)"


@both("jn21_overlap_pairs", "edits", "files")
def _(d):
    # of a file's edits by place, each against the one before
    return f"select path, seq, start, prev_stop, prev_stop > start as overlaps from (select path, seq, start, lag(stop) over (partition by file_id order by start, seq) as prev_stop from {edit_ranges(d)} e) x where prev_stop is not null"


@both("jn23_test_importers", "calls", "functions")
def _(d):
    return "select b.path as target, a.path as test_path, min(c.src) as first_test from calls c join functions a on a.id = c.src and a.is_test join functions b on b.id = c.dst group by b.path, a.path"


@both("jn24_scoped_hierarchy", "code")
def _(d):
    # the exceptions that a file may throw: of its language, in its folder, below it or in a folder above; if there are none,
    # those of everywhere. Folders meet by their ancestors, which are equi-keys. What extends an exception is one, at any depth
    family = f"case when {d.rlike('path', '[.]py$')} then 'py' when {d.rlike('path', '[.][mc]?[jt]sx?$')} then 'js' end"
    placed = f"(select path, text, {family} as family, {d.extract('path', '^(.*)/[^/]*$')} as dir from code) p_"
    ups = lambda t: d.each(t, d.unite(d.list("''"), d.map(d.span("1", d.size(d.split("dir", "/"))), "i", d.join(d.slice(d.split("dir", "/"), "1", "cast(i as int)"), "/"))), "k_ up")
    head = "^\\s*(?:export\\s+)?(?:default\\s+)?class\\s+([A-Za-z_$][A-Za-z0-9_$]*)\\s*(?:[(]|extends\\s+)\\s*"
    classes = f"select distinct path, dir, family, {d.extract('text', head + '[A-Za-z_$]')} as name, {d.extract('text', head.replace('([A-Za-z_$][A-Za-z0-9_$]*)', '[A-Za-z_$][A-Za-z0-9_$]*') + '(?:[A-Za-z0-9_$]+[.])*([A-Za-z_$][A-Za-z0-9_$]*)')} as base from {placed} where family is not null"
    throws = d.rlike("text", "^\\s*(?:raise|throw)\\s+(?:new\\s+)?[A-Za-z_$]")
    return f"""with recursive classes as ({classes}),
        thrown as (select path, dir, family, name, 1 as depth from classes where name <> '' and {d.rlike('base', '(Error|Exception)$')} union all select c.path, c.dir, c.family, c.name, t.depth + 1 from thrown t join classes c on c.base = t.name and c.family = t.family where t.depth < 10),
        known as (select path, dir, family, name, min(depth) as depth from thrown group by path, dir, family, name),
        asks as (select distinct path, dir, family from {placed} where family is not null and {throws}),
        near as (select a.path, k.name, k.path as at from {ups('asks')} a join known k on k.dir = a.up and k.family = a.family union select a.path, k.name, k.path as at from asks a join {ups('known')} k on k.up = a.dir and k.family = a.family),
        counts as (select path, count(*) as n, {d.sorted_set('name')} as names from near group by path),
        everywhere as (select family, count(*) as n, {d.sorted_set('name')} as names from known group by family)
        select a.path, coalesce(c.n, e.n, 0) as n_exceptions, {d.join(d.slice('coalesce(c.names, e.names)', '1', '10'), ' ')} as names, c.n is null as fell_back from asks a left join counts c on c.path = a.path left join everywhere e on e.family = a.family"""


@both("set02_first_wins", "calls", "functions")
def _(d):
    return "select path, name, src from (select f.path, f.name, c.src, row_number() over (partition by f.path, f.name order by c.src, c.dst) as rn from calls c join functions f on f.id = c.dst) x where rn = 1"


@both("set04_added_removed", "symbols")
def _(d):
    after = "(select distinct name, type from symbols where file_id % 11 <> 0)"
    before = "(select distinct name, type from symbols where file_id % 13 <> 0)"
    return f"select 'added' as change, a.name, a.type from {after} a left join {before} b on a.name = b.name and a.type = b.type where b.name is null union all select 'removed', b.name, b.type from {before} b left join {after} a on a.name = b.name and a.type = b.type where a.name is null"


@both("set05_undefined_names", "refs", "symbols")
def _(d):
    known = ", ".join(f"'{x}'" for x in ("the", "of", "and", "in", "to", "is"))
    return f"select distinct target_name from refs where target_name not in ({known}) and not {d.rlike('target_name', '^[A-Z]+$')} and target_name not in (select name from symbols) and kind = 'call'"


@both("set06_unused_imports", "refs")
def _(d):
    return "select distinct i.file_id, i.target_name from refs i left join (select distinct file_id, lower(target_name) as name from refs where kind <> 'import') u on u.file_id = i.file_id and u.name = lower(i.target_name) where i.kind = 'import' and u.name is null"


@both("set07_merge_text_refs", "refs", "lines")
def _(d):
    return f"select path, line, 'index' as source from (select distinct path, line from refs where target_name = 'from') i union all select t.path, t.line, 'text' from (select path, line from lines where instr(lower(text), 'from') > 0) t left join (select distinct path, line from refs where target_name = 'from') i on i.path = t.path and i.line = t.line where i.path is null"


@both("set09_drift_dedupe", "refs")
def _(d):
    return "select kind, target_name, path, line from (select kind, target_name, path, line, row_number() over (partition by kind, target_name order by path, line, place) as rn from refs) x where rn = 1"


@both("set11_intersect", "symbols", "refs")
def _(d):
    return "select name from symbols where type = 'function' intersect select target_name from refs where kind = 'call'"


@both("jn22_orphans", "texts")
def _(d):
    # files that nobody imports, by any of three rules: the resolved path, the dotted or slashed module, the base name
    from lithic.operators.projects import imported

    bare = lambda x: d.replace(x, "[.][A-Za-z]+$", "")
    said = f"select distinct path as importer, {d.replace(d.replace('module', '^(?:[.][.]?/)+', ''), '[.][mc]?[jt]sx?$', '')} as module from {imported(d)} i"
    files = f"select path, {bare('path')} as whole, {d.extract('path', '([^/]+)[.][A-Za-z]+$')} as base from texts where {d.rlike('path', '[.](py|[mc]?[jt]sx?)$')}"
    dotted = d.replace("module", "[.]", "/")
    tails = d.each(f"({files}) f_", d.map(d.span("1", d.size(d.split("whole", "/"))), "i", d.join(d.slice(d.split("whole", "/"), "cast(i as int)", d.size(d.split("whole", "/")).replace("bigint", "int")), "/")), "k_ tail", "path, base")
    rules = [f"select t.path from {tails} t join ({said}) s on s.module = t.tail where s.importer <> t.path", f"select t.path from {tails} t join (select importer, {dotted} as module from ({said}) q) s on s.module = t.tail where s.importer <> t.path", f"select f.path from ({files}) f join (select importer, {d.extract('module', '([^./]+)$')} as module from ({said}) q) s on s.module = f.base where s.importer <> f.path"]
    return f"select f.path from ({files}) f left join (select path from ({' union '.join(rules)}) r) n on n.path = f.path where n.path is null"


@both("set01_bag_union", "calls", "functions")
def _(d):
    # of one symbol; a caller may stand in several of the bags
    return "select 'direct' as how, src, dst from calls where dst = 7 union all select 'indirect', c.src, c.dst from calls c join (select distinct src from calls where dst = 7) o on o.src = c.dst union all select 'test', c.src, c.dst from calls c join functions f on f.id = c.src where c.dst = 7 and f.is_test"


@query("set10_visited_union", with_ctes("with recursive r as (select dst as node from calls where src = 1 union select c.dst from r join calls c on c.src = r.node) select node from r", DUCK, ("calls",)))
def _(spark, source):
    """All that one node's calls reach, however far."""
    from lithic.operators.graphs import reached

    return reached(relation(spark, source, "calls"), spark.createDataFrame([(1,)], "node long"))


@both("set08_rule_override", "code")
def _(d):
    # rules of the project take the place of built-in ones of the same id; the project's are lines of its rules file
    built = d.table("id", [("no-bare-except",), ("no-debugger",), ("no-eval",)])
    own = f"(select distinct {d.extract('text', '^rule ([a-z-]+)$')} as id from code where {d.rlike('path', '(^|/)[.]rules$')})"
    return f"select id, 'builtin' as origin from {built} b where id not in (select id from {own} o) union all select id, 'project' from {own} p where id <> ''"
