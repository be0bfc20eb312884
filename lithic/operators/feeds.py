"""Logs and change feeds in batch: debounce, usage windows, keyed guards; and sources made of lines and pages."""

from __future__ import annotations

from lithic.plans.catalogue import both


@both("src10_usage_scan", "usage")
def _(d):
    return "select event_id, tool, status, duration_ms from usage where coalesce(status, '') <> 'polluted' and metric is not null"


@both("src11_feedback_scan", "usage")
def _(d):
    return "select event_id, tool, session from usage where status = 'error'"


@both("src15_nearest_rules", "files")
def _(d):
    configs = [("", "root"), ("src1", "one"), ("src1/en", "one-en"), ("src2/de", "two-de")]
    return f"select path, cfg from (select f.path, c.cfg, row_number() over (partition by f.path order by length(c.root) desc) as rn from files f join {d.table('root, cfg', configs)} c on c.root = '' or substr(f.path, 1, length(c.root) + 1) = concat(c.root, '/')) x where rn = 1"


@both("src19_frozen_snapshot", "before", "symbols")
def _(d):
    return "select b.path, b.state, count(s.id) as n_symbols from before b left join symbols s on s.file_id = b.file_id where b.state = 'fresh' group by b.path, b.state"


@both("src20_log_migration", "usage")
def _(d):
    return "select event_id, tool from usage where event_id % 2 = 0 and status <> 'crash' union all select event_id, tool from usage where event_id % 2 = 1 and tool is not null"


@both("ext19_kind_normaliser", "symbols")
def _(d):
    kinds = [("fn",), ("const",), ("enum",), ("impl",), ("struct",), ("trait",), ("class",)]
    to = "case k when 'fn' then 'function' when 'const' then 'variable' when 'enum' then 'class' when 'impl' then 'class' when 'struct' then 'class' when 'trait' then 'interface' else k end"
    return f"select k, {to} as kind from (select k from {d.table('k', kinds)} v union all select distinct type from symbols) t"


CODE = [(1, "export async function load(a) {"), (2, "class Foo extends Bar {"), (3, "def run(self):"), (4, "func (s *T) Go() error {"), (5, "pub fn make() -> X {"), (6, "const LIMIT = 3"), (7, "interface Shape {"), (8, "plain words here")]
FALLBACK = [("function", "(?:^|[^A-Za-z])function +([A-Za-z_]+)"), ("class", "^ *(?:export )?class +([A-Za-z_]+)"), ("function", "^ *(?:async )?def +([A-Za-z_]+)"), ("function", "^func +(?:[(][^)]*[)] *)?([A-Za-z_]+)"), ("function", "^ *(?:pub )?fn +([A-Za-z_]+)"), ("variable", "^(?:const|let|var) +([A-Za-z_]+)"), ("interface", "^ *interface +([A-Za-z_]+)")]


@both("ext20_regex_symbols", "lines")
def _(d):
    kind = "case " + " ".join(f"when {d.rlike('x', p)} then '{k}'" for k, p in FALLBACK) + " end"
    name = "case " + " ".join(f"when {d.rlike('x', p)} then {d.extract('x', p)}" for _, p in FALLBACK) + " end"
    return f"select i, kind, name from (select i, {kind} as kind, {name} as name from (select i, x from {d.table('i, x', CODE)} v union all select file_id * 1000 + line, text from lines) u) t where kind is not null"


@both("ext22_test_names", "lines")
def _(d):
    code = [(1, "def test_login():"), (2, "it('works', () => {"), (3, "func TestParse(t *testing.T) {"), (4, "describe(\"x\", f)"), (5, "def helper():")]
    name = f"coalesce(nullif({d.extract('x', 'def (test_[a-z_]+)')}, ''), nullif({d.extract('x', '(?:it|test|describe)[(].([a-z ]+)')}, ''), nullif({d.extract('x', 'func (Test[A-Za-z]+)')}, ''))"
    return f"select i, name from (select i, {name} as name from (select i, x from {d.table('i, x', code)} v union all select file_id * 1000 + line, text from lines) u) t where name is not null"


@both("ext23_density", "symbols", "refs")
def _(d):
    return "select s.file_id, least(cast(1.0 as double), cast((s.n + coalesce(r.n, 0)) / 50.0 as double)) as density from (select file_id, count(*) as n from symbols group by file_id) s left join (select file_id, count(*) as n from refs group by file_id) r on r.file_id = s.file_id"


@both("stm01_debounce_batch", "usage")
def _(d):
    # bursts: an event within the gap of the one before goes on with its burst
    return f"""with e as (select event_id, session, {d.seconds('ts')} as t from usage), g as (select event_id, session, t, case when t - lag(t) over (partition by session order by t, event_id) <= 86400 then 0 else 1 end as starts from e),
        b as (select event_id, session, sum(starts) over (partition by session order by t, event_id rows between unbounded preceding and current row) as burst from g) select session, cast(burst as bigint) as burst, count(*) as n, min(event_id) as first_id from b group by session, burst"""


@both("stm10_usage_hourly", "usage")
def _(d):
    return f"select {d.hour('ts')} as hour, tool, count(*) as n, cast(sum(metric) as bigint) as metric from usage group by 1, 2"


@both("stm11_collision_guard", "usage")
def _(d):
    # what a session last read against what was last written: a logical clock is the event's number
    return """select event_id, session, case when read_id is null then 'never_read' when written_id > read_id then 'modified' else 'up_to_date' end as outcome from (
        select event_id, session, tool, max(case when tool = 'view' then event_id end) over (partition by session order by event_id rows between unbounded preceding and 1 preceding) as read_id,
        coalesce(max(case when tool = 'purchase' then event_id end) over (partition by session order by event_id rows between unbounded preceding and 1 preceding), 0) as written_id from usage) x where tool not in ('view', 'purchase')"""


@both("asof_extension", "usage")
def _(d):
    # an extension: the last view before each error of a session, by one window instead of a join
    return "select event_id, last_view from (select event_id, tool, max(case when tool = 'view' then event_id end) over (partition by session order by ts, event_id rows between unbounded preceding and 1 preceding) as last_view from usage) x where tool = 'error'"
