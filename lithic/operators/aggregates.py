"""Aggregations: statistics, dead code, scores, votes, usage."""

from __future__ import annotations

from lithic.plans.catalogue import both


def js_round(x: str, digits: int = 2) -> str:
    """Half up, whatever the sign, as both engines agree on."""
    k = 10**digits
    return f"(cast(floor(({x}) * {k} + 0.5) as double) / {k})"


@both("agg01_index_stats", "files", "symbols", "refs")
def _(d):
    return "select (select count(*) from files) as n_files, (select count(*) from symbols) as n_symbols, (select count(*) from refs) as n_refs"


@both("agg02_dead_code", "symbols", "refs", "lines")
def _(d):
    # counted by name over the refs, once a name; imports of the own file don't count; then textual exemptions
    return f"""with n as (select target_name, count(*) as n_all from refs group by target_name), own as (select target_name, file_id, count(*) as n_own from refs where kind = 'import' group by target_name, file_id),
        c as (select s.path, s.name, s.start_line, s.file_id, coalesce(n.n_all, 0) as n_refs, coalesce(n.n_all, 0) - coalesce(o.n_own, 0) as n_live from symbols s left join n on n.target_name = s.name left join own o on o.target_name = s.name and o.file_id = s.file_id where s.type = 'function'),
        spoken as (select distinct file_id, {d.extract('text', ': ([A-Za-z]+)')} as name from lines)
        select path, name, start_line, n_refs from c where n_live <= 1 and not exists (select 1 from spoken t where t.file_id = c.file_id and t.name = c.name) order by n_refs, path, start_line, name limit 50"""


@both("agg03_outline_counts", "refs")
def _(d):
    return "select target_name, count(*) as n_refs, cast(count_if(path like '%/de/%') as bigint) as n_test_refs from refs group by target_name having count(*) > 5"


@both("agg04_risk", "calls", "functions")
def _(d):
    return """select dst as id, n_direct, n_test, n_cross, case when n_direct + n_test >= 3 then 'high' when n_direct + n_test >= 1 then 'medium' else 'low' end as risk_delete, case when n_direct + n_test >= 4 then 'high' when n_direct + n_test >= 1 then 'medium' else 'low' end as risk_rename,
        case when n_direct + n_test >= 6 then 'high' when n_direct + n_test >= 2 then 'medium' else 'low' end as risk_modify from (
        select c.dst, cast(count_if(a.family = b.family and not a.is_test) as bigint) as n_direct, cast(count_if(a.family = b.family and a.is_test) as bigint) as n_test, cast(count_if(a.family <> b.family) as bigint) as n_cross from calls c join functions a on a.id = c.src join functions b on b.id = c.dst group by c.dst) x"""


@both("agg05_usage_rollup", "usage")
def _(d):
    return f"""select coalesce(tool, '(all)') as tool, count(*) as calls, cast(count_if(status = 'ok') as bigint) as ok, cast(count_if(status = 'error') as bigint) as errors, cast(count_if(status = 'crash') as bigint) as crashes,
        {js_round("avg(duration_ms)")} as avg_ms, {js_round("100.0 * count_if(status = 'ok') / count(*)")} as success_rate, min(event_id) as first_id, max(event_id) as last_id, cast(sum(metric) as bigint) as metric from usage group by rollup(tool)"""


@both("agg06_feedback", "usage")
def _(d):
    return f"select tool, count(*) as n, max(event_id) as latest, {d.join(d.sorted_set('status'), ',')} as statuses from usage where status <> 'ok' group by tool"


@both("agg07_edit_stats", "usage")
def _(d):
    return "select count(*) as batches, cast(sum(metric) as bigint) as edits, cast(sum(case when metric > 50 then metric * 4 else 0 end) as bigint) as tokens_saved, cast(max(metric) as bigint) as largest from usage where tool = 'click'"


def style(d, x: str = "name") -> str:
    return f"case when {d.rlike(x, '^[A-Z][A-Z0-9_]*$')} then 'constant' when {d.rlike(x, '^[a-z][a-z0-9]*(_[a-z0-9]+)*$')} then 'snake' when {d.rlike(x, '^[a-z][A-Za-z0-9]*$')} then 'camel' when {d.rlike(x, '^[A-Z][A-Za-z0-9]*$')} then 'Pascal' end"


@both("agg08_naming_share", "symbols")
def _(d):
    return f"""select type, style, n, share, rn = 1 and share >= 0.7 as dominant from (select type, style, n, {js_round('cast(n as double) / sum(n) over (partition by type)')} as share, row_number() over (partition by type order by n desc, style) as rn
        from (select type, {style(d)} as style, count(*) as n from symbols group by 1, 2) x where style is not null) y"""


@both("agg09_verb_histogram", "symbols")
def _(d):
    return f"select verb, n, members from (select verb, count(*) as n, {d.join(d.slice(d.sorted('name'), '1', '5'), ',')} as members from (select distinct lower({d.extract('name', '^([A-Za-z][a-z]{1,2})')}) as verb, name from symbols) x group by verb) y where n >= 3"


# Verbs that mean the same.
SYNONYMS = ["get fetch retrieve load read query", "create make build new add insert", "delete remove destroy drop clear purge", "update modify change set edit patch", "check validate verify ensure assert"]


@both("agg10_synonyms", "symbols", "code")
def _(d):
    # a verb's best synonym is the one that most names begin with; it is better if three do, and twice as many as with the verb
    pairs = [(a, b) for group in SYNONYMS for a in group.split() for b in group.split() if a != b]
    names = f"select distinct name from (select name from symbols union all select {d.extract('text', '(?:def|function|func|fn) +([A-Za-z_][A-Za-z0-9_]*)')} from code) n where name <> ''"
    return f"""with v as (select {d.extract('lower(name)', '^([a-z]+)')} as verb, count(*) as n from (select {d.replace('name', '([a-z])([A-Z])', '$1_$2')} as name from ({names}) m) s group by 1)
        select verb, synonym, own, n as other, n >= 3 and n >= 2 * own as better from (select a.verb, a.synonym, coalesce(o.n, 0) as own, coalesce(b.n, 0) as n, row_number() over (partition by a.verb order by coalesce(b.n, 0) desc, a.synonym) as rn from {d.table('verb, synonym', pairs)} a left join v o on o.verb = a.verb left join v b on b.verb = a.synonym) x where rn = 1"""


@both("agg12_grouping_sets", "symbols")
def _(d):
    return "select coalesce(path, '*') as path, coalesce(type, '*') as type, count(*) as n from symbols group by grouping sets ((path), (type), ())"


@both("agg14_duplicate_lines", "lines")
def _(d):
    t = d.trim("text")
    return f"select k as key_text, count(*) as n, count(distinct path) as n_files, min(line) as first_line from (select path, line, substr({t}, 1, 60) as k from lines where length({t}) > 20) x where length(k) >= 30 group by k having count(*) >= 3"


@both("agg16_top_directories", "files")
def _(d):
    return f"select dir, n, {js_round('100.0 * n / total', 1)} as pct from (select dir, n, sum(n) over () as total, row_number() over (order by n desc, dir) as rn from (select dir, count(*) as n from files group by dir) x) y where rn <= 15"


@both("agg19_language_buckets", "files", "symbols")
def _(d):
    return """select f.lang, case when n < 5 then '0-4' when n < 10 then '5-9' when n < 20 then '10-19' when n < 50 then '20-49' else '50+' end as bucket, count(*) as n_files from files f left join (select file_id, count(*) as n from symbols group by file_id) s on s.file_id = f.file_id group by 1, 2"""


@both("agg21_token_estimate", "files")
def _(d):
    return "select path, cast(ceil(length(content) / 4.0) as bigint) as map_tokens, cast(ceil(size / 3.0) as bigint) as outline_tokens from files"


@both("agg22_coverage", "calls", "functions")
def _(d):
    return "select b.dir, count(distinct b.path) as n_files, count(distinct case when a.is_test then b.path end) as n_tested from calls c join functions a on a.id = c.src join functions b on b.id = c.dst group by b.dir"


@both("agg23_inventory", "files")
def _(d):
    return "select dir, count(*) as n, cast(sum(size) as bigint) as bytes, max(size) as largest, min(file_id) as oldest from files group by dir"


@both("agg17_dead_summary", "symbols", "refs")
def _(d):
    return """select type, count(*) as n, cast(sum(case type when 'variable' then 50 when 'function' then 200 when 'method' then 200 else 500 end) as bigint) as est_tokens from symbols s left join (select target_name, count(distinct file_id) as n_files, min(file_id) as file_id from refs where kind <> 'import' group by target_name) r on r.target_name = s.name
        where r.target_name is null or r.n_files = 1 and r.file_id = s.file_id group by type"""
