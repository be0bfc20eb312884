"""Text-rule engines: each rule is one expression over lines or files, and findings are rows.

Patterns keep to what both engines read alike: what a rule looks behind for is a group of its own. The engines read the
relations ``code`` and ``texts``: the documents and a small project over tables, a tree's files over a source tree.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lithic.operators.aggregates import js_round, style
from lithic.operators.projects import ENV_FILE, bodies, compose_services, pad, undefined
from lithic.plans.catalogue import both, query
from lithic.sources.relations import Source, relation

# Rule id, severity, category, what must stand before, pattern over a whole text.
_ALONE, _ANY = "(^|[^A-Za-z0-9_.])", "()"
_EXEC, _SHELL = "(?:exec|execSync|execFileSync)[\\s]*[(]", "\\b(?:child_process|childProcess|cp|proc|shell)\\s*[.]\\s*"
SECURITY = [
    ("eval", "high", "code-injection", _ANY, "\\beval\\s*[(]"),
    ("Function-ctor", "high", "code-injection", _ANY, "\\bnew\\s+Function\\s*[(]"),
    ("exec-cmd", "high", "command-injection", _ALONE, _EXEC + "[^)]*[+]"),
    ("exec-cmd-member", "high", "command-injection", _ANY, _SHELL + "(?:exec|execSync|execFile|execFileSync|spawn|spawnSync)\\s*[(][^)]*[+]"),
    ("exec-cmd-tpl", "high", "command-injection", _ALONE, _EXEC + "[^)]*[$][{]"),
    ("exec-cmd-tpl-member", "high", "command-injection", _ANY, _SHELL + _EXEC + "[^)]*[$][{]"),
    ("exec-cmd-subst", "high", "command-injection", _ALONE, _EXEC + "[^)]*[$][(]"),
    ("exec-cmd-subst-member", "high", "command-injection", _ANY, _SHELL + _EXEC + "[^)]*[$][(]"),
    ("exec-file-shell-concat", "high", "command-injection", _ANY, "\\bexecFile(?:Sync)?\\s*[(][^)]*[+][^)]*shell:\\s*true"),
    ("cmd-name-concat", "high", "command-injection", _ALONE, "(?:spawn|spawnSync|execFile)\\s*[(]\\s*[^,]*[+]"),
    ("cmd-name-tpl", "high", "command-injection", _ALONE, "(?:spawn|spawnSync|execFile)\\s*[(]\\s*[^,]*[$][{]"),
    ("spawn-shell", "high", "command-injection", _ANY, "spawn\\s*[(][^,]+,\\s*[^,]+,\\s*[{][^}]*shell:\\s*true"),
    ("sql-concat", "high", "sql-injection", _ANY, "(?i:select|insert|update|delete)\\s+.+?['\"]\\s*[+]\\s*\\w+"),
    ("sql-fstring", "high", "sql-injection", _ANY, "f['\"][^'\"{}]*\\b(?:SELECT|INSERT|UPDATE|DELETE|REPLACE)\\b[^'\"{}]*[{][^}]*[}]"),
    ("innerHTML", "medium", "xss", _ANY, "[.]innerHTML\\s*="),
    ("dangerouslySet", "medium", "xss", _ANY, "dangerouslySetInnerHTML"),
    ("fs-unlink-sync", "medium", "file-access", _ANY, "fs[.](?:unlinkSync|rmSync|rmdirSync)\\s*[(]"),
    ("process-exit", "medium", "stability", _ANY, "\\bprocess[.]exit\\s*[(]"),
    ("crypto-md5", "low", "crypto", _ANY, "crypto[.]createHash\\s*[(]\\s*['\"](?i:md5)['\"]\\s*[)]"),
    ("jwt-hardcoded", "high", "secrets", _ANY, "jwt[.]sign\\s*[(][^,]+,\\s*['\"][a-zA-Z0-9_-]{8,}['\"]"),
    ("password-hardcode", "high", "secrets", _ANY, "(?i:password)\\s*[=:]\\s*['\"][^'\"]{4,}['\"]"),
    ("api-key-hardcode", "high", "secrets", _ANY, "(?i:api[_-]?key|secret|token)\\s*[=:]\\s*['\"][a-zA-Z0-9_-]{8,}['\"]"),
    ("allow-all-cors", "medium", "cors", _ANY, "(?:[aA]ccess-[cC]ontrol-[aA]llow-[oO]rigin|[oO]rigin)\\s*[=:]\\s*['\"][*]['\"]"),
    ("no-rate-limit", "low", "dos", _ANY, "app[.](?:get|post|put|delete|patch)\\s*[(]['\"][^'\"]+['\"]\\s*,\\s*(?:async\\s*)?[(]"),
    ("debug-log", "low", "info-leak", _ANY, "console[.](?:log|dir|table)\\s*[(][^)]*(?:password|secret|token|key|Password|Secret|Token|Key|PASSWORD|SECRET|TOKEN|KEY)"),
    ("insecure-compare", "medium", "timing", _ANY, "\\b(?:stored|expected|correct|known|saved|cached|hash|token|secret|password|passwd|api[_-]?key|session)[\\w.]*\\s*===?\\s*[A-Za-z_$][\\w$]*(?:\\s*[.]\\s*[A-Za-z_$][\\w$]*)*\\s*[;)}]"),
    ("no-input-validation", "medium", "input-validation", _ANY, "\\bbody[.][a-zA-Z]+\\b(?:\\s*[)]|[.]\\s*map|\\s*[.]\\s*forEach)"),
    ("dotenv-secret", "high", "secrets", "(^|\\n)", "[A-Za-z_][A-Za-z0-9_]*=(?:['\"][^'\"]{8,}['\"]|[^'\"\\s]{8,})[ \\t]*(?:\\n|$)"),
]
# What a comparison may be with, and rules that tests are exempt from.
_LITERALS = "(===?\\s*)(?:null|undefined|true|false|NaN)\\b"
_TEST_EXEMPT = ("password-hardcode", "api-key-hardcode", "jwt-hardcoded", "dotenv-secret", "process-exit")
_TEST_PATH = "(^|/)(tests|fixtures|examples|__tests__|testdata|spec)/|(^|/)[tT][eE][sS][tT][-_]?[^/]*$|(^|/)[sS][pP][eE][cC][-_]?[^/]*$|[.](test|spec)[.-][^/]*$|_test[.][^/]*$"
MARKER = "lint-ignore"


#: What a text must hold, in lower case, for a rule to find anything in it: one of these.
_SQL = ("select", "insert", "update", "delete")
HOLDS = {
    "eval": ("eval",), "Function-ctor": ("function",), "exec-cmd": ("exec",), "exec-cmd-member": ("exec", "spawn"), "exec-cmd-tpl": ("exec",), "exec-cmd-tpl-member": ("exec",),
    "exec-cmd-subst": ("exec",), "exec-cmd-subst-member": ("exec",), "exec-file-shell-concat": ("execfile",), "cmd-name-concat": ("spawn", "execfile"), "cmd-name-tpl": ("spawn", "execfile"),
    "spawn-shell": ("spawn",), "sql-concat": _SQL, "sql-fstring": (*_SQL, "replace"), "innerHTML": ("innerhtml",), "dangerouslySet": ("dangerouslysetinnerhtml",),
    "fs-unlink-sync": ("unlinksync", "rmsync", "rmdirsync"), "process-exit": ("process.exit",), "crypto-md5": ("createhash",), "jwt-hardcoded": ("jwt.sign",), "password-hardcode": ("password",),
    "api-key-hardcode": ("key", "secret", "token"), "allow-all-cors": ("origin",), "no-rate-limit": ("app.",), "debug-log": ("console.",), "insecure-compare": ("==",), "no-input-validation": ("body.",),
    "dotenv-secret": ("=",),
}


def _holds(words) -> str:
    return "(" + " or ".join(f"instr(low, '{w}') > 0" for w in sorted(set(words))) + ")"


def findings(d, rules=SECURITY) -> str:
    """(path, rule, severity, category, line, prepared): every place in every text; prepared: a statement that is prepared.

    Rules are tried only on texts that hold one of their words. A rule's places are marked in the text, which is cut at the
    marks at once: of each piece go on how many lines it ends and what stands at its ends, never the text. The line is the
    number of line ends before.
    """
    spot = lambda i: d.replace("content", _LITERALS, "$1") if i == "insecure-compare" else "content"
    only = lambda i: f" and {d.rlike('path', '(^|/)[.]env([.][^/]*)?$')}" if i == "dotenv-secret" else ""
    marked = d.keep(d.list(*[f"case when {_holds(HOLDS[i])} and {d.rlike(spot(i), w + '(?:' + p + ')')}{only(i)} then concat('{i}', chr(2), {d.replace(spot(i), w + '(' + p + ')', '$1' + chr(1) + '$2')}) end" for i, _, _, w, p in rules]), "x", "x is not null")
    facts = lambda k: "case rule " + " ".join(f"when '{r[0]}' then '{r[k]}'" for r in rules) + " end"
    texts = f"(select path, content, low from (select path, content, lower(content) as low from texts where content is not null) l_ where {_holds(w for r in rules for w in HOLDS[r[0]])}) t_"
    each = d.each(texts, marked, "n_ mark", "path")
    parts = d.each(f"(select path, {d.nth('mark', chr(2), 1)} as rule, {d.nth('mark', chr(2), 2)} as body from {each} m_) b_", d.split("body", chr(1)), "place found", "path, rule")
    call = "[.]prepare\\s*[(]"
    inner = d.extract("found", "^((?s:.*?))[\"']\\s*[+]")
    pieces = f"""select path, rule, place, {d.count('found', chr(10))} as ends, substr(found, greatest(length(found) - 39, 1), 40) as tail, case when rule = 'sql-concat' then {d.rlike(inner, call)} else false end as inside,
        case when rule = 'sql-concat' then substr({inner}, 1, 200) else '' end as head from {parts} p_"""
    return f"""(select path, rule, {facts(1)} as severity, {facts(2)} as category, line, rule = 'sql-concat' and (inside or {d.rlike('concat(before, head)', call)}) as prepared from (
        select path, rule, place, inside, head, lag(tail) over (partition by path, rule order by place) as before, cast(1 + coalesce(sum(ends) over (partition by path, rule order by place rows between unbounded preceding and 1 preceding), 0) as bigint) as line from ({pieces}) q_) r_ where place > 1)"""


def findings_on_lines(d) -> str:
    """findings() with source: the line that each stands on, met by its number in the texts that may have any."""
    texts = f"(select path, content from (select path, content, lower(content) as low from texts where content is not null) l_ where {_holds(w for r in SECURITY for w in HOLDS[r[0]])}) u_"
    return f"(select f.*, s.source from {findings(d)} f join {d.each(texts, d.split('content', chr(92) + 'n'), 'line source', 'path')} s on s.path = f.path and s.line = f.line)"


@both("rul01_security_review", "texts")
def _(d):
    return f"select path, rule, severity, category, cast(line as bigint) as line from {findings(d)} f"


def suppressed(d, config: list[tuple[str, str]]) -> str:
    """Why a finding isn't reported, or 'reported': an inline marker for all or for named rules, a line of config (glob,
    rule; either may be '*'), tests, prepared statements."""
    marked = f"instr(source, '{MARKER}') > 0 and (not {d.rlike('source', MARKER + '\\[')} or instr(concat(',', {d.replace(d.extract('source', MARKER + '\\[([^\\]]*)\\]'), ' ', '')}, ','), concat(',', rule, ',')) > 0)"
    ignored = " or ".join(f"({d.rlike('path', glob_pattern(g))} and '{r}' in ('*', rule))" for g, r in config) or "false"
    exempt = ", ".join(f"'{r}'" for r in _TEST_EXEMPT)
    return f"case when {marked} then 'marker' when {ignored} then 'config' when rule in ({exempt}) and {d.rlike('path', _TEST_PATH)} then 'test_path' when prepared then 'prepared' else 'reported' end"


def glob_pattern(glob: str) -> str:
    """A glob as a pattern over relative paths; one with more than three ** matches nothing."""
    if glob.count("**") > 3:
        return "^[^/]$a"
    out, i = "", 0
    while i < len(glob):
        if glob.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif glob.startswith("**", i):
            out, i = out + ".*", i + 2
        elif glob[i] == "*":
            out, i = out + "[^/]*", i + 1
        else:
            out, i = out + (glob[i] if glob[i].isalnum() or glob[i] in "/_-" else f"[{glob[i]}]" if glob[i] != "^" else chr(92) + "^"), i + 1
    return f"^(?:{out})$"


CONFIG_IGNORE = [("shop/lib/**", "*"), ("**/store.js", "sql-concat"), ("a/**/b/**/c/**/d/**/e", "*")]


@both("rul02_suppression", "texts")
def _(d):
    return f"select {suppressed(d, CONFIG_IGNORE)} as state, rule, count(*) as n from {findings_on_lines(d)} f group by 1, 2"


# Where a definition begins, by the end of the path.
_DEFINES = "^\\s*(?:export\\s+)?(?:default\\s+)?(?:pub\\s+)?(?:async\\s+)?(?:def|function|fn|func)\\s+(?:[(][^)]*[)]\\s*)?([A-Za-z_$][A-Za-z0-9_$]*)"


def review(d) -> str:
    """A row for each file: functions, those that are long or oddly named, whether most of them lack a comment, decorator or
    docstring beside them, markers, and long lines that occur again."""
    rows = f"select path, line, text, {d.extract('text', _DEFINES)} as name, lag(text) over (partition by path order by line) as above, lead(text) over (partition by path order by line) as below from code"
    functions = f"select path, line, name, {d.rlike('coalesce(above, ' + chr(39) * 2 + ')', '^' + chr(92) + 's*(#|//|/?[*]|@)')} or {d.rlike('coalesce(below, ' + chr(39) * 2 + ')', '^' + chr(92) + 's*(' + chr(34) * 3 + '|' + chr(39) * 3 + ')')} as documented, coalesce(lead(line) over (partition by path order by line), last_line + 1) - line as reach from (select r.*, max(line) over (partition by path) as last_line from ({rows}) r) x where name <> ''"
    return f"""select a.path, a.todo, a.repeated, coalesce(f.n, 0) as functions, coalesce(f.long, 0) as long_functions, coalesce(f.odd, 0) as odd_names, coalesce(f.documented * 2 < f.n, false) as poorly_documented from
        (select path, cast(count_if({d.rlike('text', '(^|[^A-Za-z])(TODO|FIXME|XXX|HACK)([^A-Za-z]|$)')}) as bigint) as todo, cast(sum(case when n > 1 and length({d.trim('text')}) > 20 then 1 else 0 end) as bigint) as repeated from (select path, text, count(*) over (partition by path, text) as n from code) c group by path) a
        left join (select path, count(*) as n, cast(count_if(documented) as bigint) as documented, cast(count_if(reach > 50) as bigint) as long, cast(count_if(case when {d.rlike('path', '[.](py|rs)$')} then not {d.rlike('name', '^_*[a-z0-9_]+$')} else not {d.rlike('name', '^_*[a-zA-Z][A-Za-z0-9]*$')} end) as bigint) as odd from ({functions}) g group by path) f on f.path = a.path"""


@both("rul03_code_review", "code")
def _(d):
    return review(d)


# The rules that always hold, unless the project has one of that id: (id, kind, names, wrapper or decorator).
GUARDS = [("no-bare-except", "except_bare", "", ""), ("no-debugger", "call_banned", "debugger,pdb.set_trace,breakpoint", ""), ("no-eval", "call_banned", "eval,exec", "")]
GUARD_SCHEMA = "id string, kind string, names string, wanted string"
OWN_GUARDS = [("no-eval", "call_banned", "eval,exec,execSync", ""), ("wrap-load", "call_required_wrapper", "load,open", "run"), ("cache-runs", "decorator_required", "run,test_", "cached"), ("odd", "unheard_of", "", "")]


def guard(spark: SparkSession, source: Source, own: DataFrame | None = None) -> DataFrame:
    """(rule, path, line, name): what a project's code does against the rules. own: a table of rules as GUARD_SCHEMA has
    it, of the kinds call_banned, call_required_wrapper, decorator_required and except_bare; others find nothing.

    Rules are a small table and are broadcast; a call's function is the nearest definition above it in its file.
    """
    rules = spark.createDataFrame(GUARDS, GUARD_SCHEMA)
    if own is not None:
        rules = rules.join(own.select("id"), "id", "left_anti").unionByName(own.select("id", "kind", "names", "wanted"))
    rules = F.broadcast(rules.select("id", "kind", F.split("names", ",").alias("names"), "wanted"))
    code = relation(spark, source, "code")
    here = Window.partitionBy("path").orderBy("line")
    name = F.regexp_extract("text", _DEFINES, 1)
    comment = F.col("text").rlike(r"^\s*(#|//|[*])")
    quotes = F.sum(F.regexp_count("text", F.lit('\"\"\"'))).over(here.rowsBetween(Window.unboundedPreceding, -1))
    rows = code.select("path", "line", "text", name.alias("defines"), F.last(F.when(name != "", name), ignorenulls=True).over(here).alias("inside"), F.concat_ws("\n", *[F.lag("text", k).over(here) for k in range(10, 0, -1)]).alias("above"), comment.alias("comment"), (F.coalesce(quotes, F.lit(0)) % 2).alias("quoted"))
    calls = rows.where(~F.col("comment")).select("path", "line", "inside", "defines", F.explode(F.array_distinct(F.concat(F.regexp_extract_all("text", F.lit(r"([A-Za-z_$][\w$.]*)\s*\("), F.lit(1)), F.when(F.col("text").rlike(r"^\s*debugger\s*;?\s*$"), F.array(F.lit("debugger"))).otherwise(F.array().cast("array<string>"))))).alias("name"))
    calls = calls.where(F.col("name") != F.col("defines"))
    meant = F.exists("names", lambda n: (n == F.col("name")) | n.endswith(F.concat(F.lit("."), F.col("name"))))
    banned = calls.join(rules.where("kind = 'call_banned'"), meant).select(F.col("id").alias("rule"), "path", "line", "name")
    wrapped = calls.join(rules.where("kind = 'call_required_wrapper'"), F.array_contains("names", F.col("name")) & ((F.col("wanted") == "") | ~F.coalesce(F.col("inside").endswith(F.col("wanted")), F.lit(False)))).select(F.col("id").alias("rule"), "path", "line", "name")
    bare = rows.where((F.col("quoted") == 0) & ~F.col("comment") & F.col("text").rlike(r"^\s*except\s*:")).join(rules.where("kind = 'except_bare'"), F.lit(True)).select(F.col("id").alias("rule"), "path", "line", F.lit("except").alias("name"))
    lacking = rows.where("defines <> ''").join(rules.where("kind = 'decorator_required'"), F.exists("names", lambda n: F.col("defines").startswith(n)) & ~F.contains(F.col("above"), F.concat(F.lit("@"), F.col("wanted"))))
    return banned.union(wrapped).union(bare).union(lacking.select(F.col("id").alias("rule"), "path", "line", F.col("defines").alias("name")))


@query("rul04_guard_patterns")
def _(spark, source):
    return guard(spark, source, spark.createDataFrame(OWN_GUARDS, GUARD_SCHEMA))


# Exceptions that the languages bring along.
RAISED = "ValueError TypeError KeyError IndexError AttributeError RuntimeError NotImplementedError StopIteration OSError IOError ImportError LookupError ArithmeticError ZeroDivisionError AssertionError Exception BaseException FileNotFoundError PermissionError TimeoutError Error RangeError SyntaxError ReferenceError EvalError URIError AggregateError".split()


@both("rul05_exception_guard", "code")
def _(d):
    kind = f"case when {d.rlike('path', '[.]py$')} then 'py' when {d.rlike('path', '[.][mc]?[jt]sx?$')} then 'js' when {d.rlike('path', '[.]rs$')} then 'rs' end"
    name = f"case lang when 'py' then {d.extract('text', '^[^#]*' + chr(92) + 'braise +([A-Za-z_][A-Za-z0-9_]*)')} when 'js' then {d.extract('text', 'throw +new +([A-Za-z_$][A-Za-z0-9_$]*)')} else {d.extract('text', '(panic!|unreachable!|todo!|unimplemented!|[.]unwrap[(]|[.]expect[(])')} end"
    # in Rust nothing counts from where tests begin
    rows = f"select path, line, text, lang, max(case when lang = 'rs' and {d.rlike('text', 'cfg[(]test[)]|[#]\\[test\\]')} then 1 else 0 end) over (partition by path order by line) as tests from (select path, line, text, {kind} as lang from code) l where lang is not null"
    own = f"select distinct {d.extract('text', '^' + chr(92) + 's*class +([A-Za-z_$][A-Za-z0-9_$]*)')} as name from code where {d.rlike('text', '(Exception|Error)' + chr(92) + 'b')}"
    builtin = ", ".join(f"'{x}'" for x in RAISED)
    return f"""select r.path, r.line, r.lang, r.name, case when r.lang = 'rs' then 'panics' when r.name in ({builtin}) then 'builtin' when o.name is not null then 'own' else 'unknown' end as state
        from (select path, line, lang, {name} as name from ({rows}) x where tests = 0) r left join (select name from ({own}) p where name <> '') o on o.name = r.name where r.name <> ''"""


# Variables that runners set, and words of SQL that are no tables.
CI_VARS = "CI CONTINUOUS_INTEGRATION HOME PATH LANG SHELL USER TERM TZ PWD TMPDIR NODE_ENV DEBUG GITHUB_ACTIONS GITHUB_TOKEN GITHUB_ACTOR GITHUB_SHA GITHUB_REF GITHUB_REPOSITORY GITHUB_RUN_ID GITHUB_RUN_NUMBER GITHUB_EVENT_NAME GITHUB_WORKSPACE GITHUB_HEAD_REF GITHUB_BASE_REF GITHUB_JOB GITHUB_STEP_SUMMARY GITHUB_OUTPUT GITHUB_ENV GITHUB_PATH GITHUB_WORKFLOW GITHUB_ACTION GITHUB_ACTOR_ID GITHUB_REPOSITORY_ID GITHUB_RETENTION_DAYS RUNNER_OS RUNNER_ARCH RUNNER_TEMP RUNNER_TOOL_CACHE RUNNER_WORKSPACE RUNNER_NAME RUNNER_ENVIRONMENT TRAVIS TRAVIS_BUILD_ID CIRCLE_CI GITLAB_CI APPVEYOR AZURE_PIPELINES JENKINS_URL".split()
SQL_WORDS = "SELECT INSERT UPDATE DELETE FROM INTO TABLE WHERE SET VALUES AND OR JOIN LEFT RIGHT INNER OUTER ON AS GROUP ORDER BY HAVING LIMIT OFFSET UNION ALL DISTINCT CASE WHEN THEN ELSE END NULL".split()
_SOURCE = "[.]([mc]?[jt]sx?|py|go|rs|java|c|cpp|cc|cxx|hpp|hh|hxx|sh|bash)$"


@both("rul06_config_drift", "code")
def _(d):
    rows = f"(select path, line, text from code where {d.rlike('path', _SOURCE)} and not {d.rlike('path', '(^|/)(tests?|fixtures|__tests__|node_modules|dist|build)/')} and not {d.rlike('text', '^' + chr(92) + 's*(#|//|[*])')}) c_"
    env = d.extract_all("text", "(?:environ\\[[\"']|getenv[(][\"']|process[.]env[.]|process[.]env\\[[\"'])([A-Za-z0-9_]+)")
    said = f"case when {d.rlike('text', '(execute|executemany|executescript|query|prepare|run)' + chr(92) + 's*[(]')} then text else {d.replace('text', chr(34) + '[^' + chr(34) + ']*' + chr(34) + '|' + chr(39) + '[^' + chr(39) + ']*' + chr(39), chr(34) * 2)} end"
    sql = d.extract_all(said, "\\b(?:FROM|INTO|UPDATE|JOIN|from|into|update|join)\\s+[`\"]?([A-Za-z0-9_]+)")
    service = d.keep(d.list(f"case when {d.rlike('lower(text)', 'redis[._](client|redis|from_url|connect)')} then 'redis' end", f"case when {d.rlike('lower(text)', 'mongo(ose|db|client)')} then 'mongodb' end", f"nullif({d.extract('text', 'https?://([a-z][a-z0-9-]*):[0-9]+')}, '')"), "x", "x is not null")
    ci, words = ", ".join(f"'{x}'" for x in CI_VARS), ", ".join(f"'{x}'" for x in SQL_WORDS)
    each = " union all ".join(f"select '{k}' as kind, path, line, name from {d.each(rows, x, 'n_ name', 'path, line')} {k}_" for k, x in (("env", env), ("table", sql), ("service", service)))
    declared = f"select 'env' as kind, {d.extract('text', '^' + chr(92) + 's*(?:export +)?([A-Za-z_][A-Za-z0-9_]*)=')} as name from code where {d.rlike('path', ENV_FILE)} union select 'service', name from ({compose_services(d)}) s_ union select 'table', {d.extract('lower(text)', 'create table (?:if not exists )?([a-z0-9_]+)')} from code"
    return f"""select r.kind, r.name, x.name is not null as declared, count(*) as n, min(concat(r.path, ':', cast(r.line as varchar(20)))) as first_place from ({each}) r left join ({declared}) x on x.kind = r.kind and x.name = r.name
        where not (r.kind = 'env' and r.name in ({ci})) and not (r.kind = 'table' and (upper(r.name) in ({words}) or r.name = '')) group by r.kind, r.name, x.name"""


def todos(d) -> str:
    """(path, line, kind, author, priority, reason): markers of open work. What stands in a file that is being edited comes
    first, then what was touched within a week."""
    kind = d.extract("text", "(?:^|[^A-Za-z])(TODO|FIXME|XXX|HACK)(?:[^A-Za-z]|$)")
    age = "concat('modified ', cast(coalesce(age, 0) as varchar(20)), ' days ago')"
    state = "select path, age, edited from touched"
    return f"""select c.path, c.line, c.kind, c.author, case when edited then 'high' when coalesce(age, 0) < 7 then 'medium' else 'low' end as priority, case when edited then 'file being edited' when coalesce(age, 0) < 7 then {age} else concat({age}, ', unchanged') end as reason
        from (select path, line, {kind} as kind, {d.extract('text', '(?:TODO|FIXME|XXX|HACK)[(]([a-z]+)[)]')} as author from code) c left join ({state}) s on s.path = c.path where c.kind <> ''"""


@both("rul07_active_todos", "code", "touched")
def _(d):
    return todos(d)


@both("rul10_naming_consistency", "symbols")
def _(d):
    return f"""with s as (select dir, style, count(*) as n from (select {d.extract('path', '^([^/]*)')} as dir, {style(d)} as style from symbols) y where style is not null group by dir, style),
        t as (select dir, style, n, sum(n) over (partition by dir) as total, row_number() over (partition by dir order by n desc, style) as rn from s) select dir, style as dominant, n, cast(total as bigint) as total, n >= 0.7 * total as consistent from t where rn = 1"""


# Names whose presence makes a change to a file reach far.
DANGEROUS = ("eval", "Function", "exec", "execSync", "execFile", "execFileSync", "spawn", "spawnSync", "child_process", "__import__", "os.system", "subprocess", "sys.exit", "unsafe", "ptr::read", "transmute")


QUALITY = [
    (1, "function a() {\n  return eval(b.c.d.e)\n}"),
    (2, "class Tidy {}\nconst MAX = 1\nfunction fine() {}"),
    (3, "process.exec(x)\nsubprocess.spawn()\nunsafe { transmute(y) }"),
    (4, ""),
    (5, "class lower {}\nfunction Not_this() {}\nlet y = 1"),
]


def quality(d, source: str) -> str:
    """source: (i, x). Each dimension from 0 to 1, 1 being best; what a parser would count is estimated from the text."""
    real = lambda x: f"cast({x} as double)"
    n = " + ".join(f"case when instr(x, '{w}') > 0 then 1 else 0 end" for w in DANGEROUS)
    violations = f"{d.count('x', '(^|[^A-Za-z0-9_])(process|global|root|eval|Function)([^A-Za-z0-9_]|$)')} + {d.count('x', '([A-Za-z0-9_$]+[.]){3,}[A-Za-z0-9_$]+')}"
    named = d.count("x", "(function|const|let|var|class)[ ]+[A-Za-z_]")
    fits = f"{d.count('x', 'function[ ]+[a-z][A-Za-z0-9]*[^A-Za-z0-9_]')} + {d.count('x', '(const|let|var)[ ]+([a-z][A-Za-z0-9]*|[A-Z][A-Z0-9_]*)[^A-Za-z0-9_]')} + {d.count('x', 'class[ ]+[A-Z][A-Za-z0-9]*[^A-Za-z0-9_]')}"
    facts = f"select i, {d.count('x', chr(92) + 'n')} + 1 as loc, 1 + {d.count('x', '(^|[^A-Za-z])(if|for|while|case|catch)([^A-Za-z]|$)')} as cyc, {d.count('x', '[{]')} as nesting, {violations} as violations, {n} as dangerous, length(x) as size, {named} as named, {fits} as fits from {source} t"
    dims = f"""select i, dangerous, violations, {js_round(f"1 - least({real(1)}, ({real('cyc')} / 20 + {real('cyc - 1')} / 30) / 2)")} as tech_debt, {js_round(f"1 - least({real(1)}, {real('violations')} / 5)")} as arch, {js_round(f"1 - least({real(1)}, {real('dangerous')} * {real(0.3)} + least({real(1)}, {real('size')} / 50000) * {real(0.7)})")} as blast,
        {js_round(f"1 - least({real(1)}, {real('nesting')} / sqrt({real('loc')}) / 3)")} as engineering, {js_round(f"case when named > 0 then {real('fits')} / named else {real(0.5)} end")} as paradigm from ({facts}) f"""
    total = " + ".join(f"{c} * {real(w)}" for c, w in (("tech_debt", 0.25), ("arch", 0.2), ("blast", 0.2), ("engineering", 0.2), ("paradigm", 0.15)))
    return f"select x.*, {js_round(total)} as overall from ({dims}) x"


@both("rul11_quality_dimensions", "files")
def _(d):
    return quality(d, f"(select i, x from {d.table('i, x', QUALITY)} v union all select file_id + 100, content from files where content is not null)")


@both("rul12_export_exemptions", "symbols", "lines")
def _(d):
    # names that the text of their own file speaks of as ': name', '.name' or '= name'
    spoken = d.extract_all("text", "(?:: |[.] ?|[^=<>!]= )([A-Za-z]+)")
    return f"select s.path, s.name, count(*) as n from symbols s join {d.each('lines', spoken, 'k name', 'file_id')} t on t.file_id = s.file_id and t.name = s.name group by s.path, s.name"


@both("rul13_text_fallback", "symbols", "conversations")
def _(d):
    # a candidate that any text names is alive; guards are reported apart
    return f"""select s.name, {d.rlike('s.name', '^(Is|Has|Th|Er)')} as guard, w.w is not null as named from (select distinct name from symbols) s left join (select distinct w from {d.each('conversations', d.extract_all('text', '([A-Za-z]+)'), 'k w', 'conv_id')} x) w on w.w = s.name"""


@both("rul14_indent_conformity", "code")
def _(d):
    # what most of a file's indented lines are indented by, tabs or a number of spaces, and how many lines don't conform
    spaces = f"length({d.extract('text', '^( *)[^ ' + chr(92) + 't]')})"
    kind = f"case when {d.rlike('text', '^' + chr(92) + 't')} then 'tab' when {spaces} > 0 and {spaces} % 4 = 0 then 'four' when {spaces} > 0 and {spaces} % 2 = 0 then 'two' when {spaces} > 0 then 'odd' end"
    counted = f"select path, cast(sum(case when kind = 'tab' then 1 else 0 end) as bigint) as tabs, cast(sum(case when kind = 'four' then 1 else 0 end) as bigint) as fours, cast(sum(case when kind = 'two' then 1 else 0 end) as bigint) as twos, cast(sum(case when kind = 'odd' then 1 else 0 end) as bigint) as odd from (select path, {kind} as kind from code) c group by path"
    return f"select path, case when tabs > twos + fours then 'tab' when twos > 0 and twos * 2 >= fours then 'two' when fours > 0 then 'four' else 'none' end as style, case when tabs > twos + fours then twos + fours + odd else tabs + odd + case when twos > 0 and twos * 2 >= fours then 0 else twos end end as nonconforming from ({counted}) x"


@both("rul14_dry_run", "texts")
def _(d):
    # a file as an edit would leave it: its brackets outside comments and strings, and names that are called but not bound
    opens, closes, last = "([{", ")]}", "right(s, 1)"
    step = f"case when instr('{opens}', c) > 0 then concat(s, c) when s <> '' and instr('{opens}', {last}) > 0 and instr('{opens}', {last}) = instr('{closes}', c) then left(s, length(s) - 1) else concat(s, '!') end"
    brackets = d.extract_all("body", "([\\[\\](){}])")
    lacking = f"select path, count(*) as n from ({undefined(d)}) u group by path"
    return f"select b.path, {d.fold(brackets, chr(39) * 2, 's c', step)} = '' as balanced, coalesce(l.n, 0) as undefined from {bodies(d)} b left join ({lacking}) l on l.path = b.path"


@both("rul15_mock_mismatch", "code")
def _(d):
    # a mock's return value or arguments against the one definition of that name
    defs = f"select name, cast(max(n_params) as bigint) as n_params, max(returns) as returns from (select {d.extract('text', 'def ([A-Za-z_]+)[(]')} as name, {d.size(d.keep(d.split(d.extract('text', 'def [A-Za-z_]+[(]([^)]*)[)]'), ','), 'p', d.trim('p') + " not in ('', 'self', 'cls')"))} as n_params, {d.extract('text', '-> *([A-Za-z_]+)')} as returns from code where {d.rlike('text', '^' + chr(92) + 's*def ')}) x where name <> '' group by name having count(*) = 1"
    value = d.extract("text", "[.]([A-Za-z_]+)[.]return_value *=")
    kind = f"case when {d.rlike('text', '= *[furb]?[' + chr(34) + chr(39) + ']')} then 'str' when {d.rlike('text', '= *-?[0-9]+ *$')} then 'int' when {d.rlike('text', '= *-?[0-9]+[.][0-9]*')} then 'float' when {d.rlike('text', '= *(True|False)')} then 'bool' when {d.rlike('text', '= *\\[')} then 'list' when {d.rlike('text', '= *[{]')} then 'dict' when {d.rlike('text', '= *None')} then 'None' end"
    called = d.extract("text", "[.]([A-Za-z_]+)[.]assert_called(?:_once)?_with[(]")
    n_args = d.size(d.keep(d.split(d.extract("text", "assert_called(?:_once)?_with[(](.*)[)]"), ","), "p", d.trim("p") + " <> ''"))
    return f"""select m.path, m.line, m.name, m.returned is not null and t.returns <> '' and m.returned <> t.returns as return_mismatch, coalesce(t.n_params - m.n_args, 0) as missing_args from (
        select path, line, {value} as name, {kind} as returned, cast(null as bigint) as n_args from code where {d.rlike('text', '[.]return_value *=')} union all select path, line, {called}, null, {n_args} from code where {d.rlike('text', 'assert_called(_once)?_with')}) m join ({defs}) t on t.name = m.name"""


@both("rul16_style_sniffer", "code")
def _(d):
    # votes by language: indents of two, four or a tab; quotes; statements that end with a semicolon; trailing commas
    lang = d.extract("path", "[.]([A-Za-z]+)$")
    spaces = f"length({d.extract('text', '^( *)[^ ]')})"
    votes = [("indent", f"case when {d.rlike('text', '^' + chr(9))} then 'tab' when {spaces} > 0 and {spaces} % 4 = 0 then 'four' when {spaces} > 0 and {spaces} % 2 = 0 then 'two' end"), ("quote", f"case when instr(text, chr(34)) > 0 and instr(text, chr(39)) = 0 then 'double' when instr(text, chr(39)) > 0 and instr(text, chr(34)) = 0 then 'single' end"), ("semicolon", f"case when {d.rlike('text', ';' + chr(92) + 's*$')} then 'yes' when {d.rlike('text', '[)' + chr(92) + ']A-Za-z0-9_]' + chr(92) + 's*$')} then 'no' end"), ("trailing_comma", f"case when {d.rlike('text', ',' + chr(92) + 's*$')} then 'yes' end")]
    each = " union all ".join(f"select {lang} as lang, '{k}' as habit, {v} as choice from code" for k, v in votes)
    return f"""select lang, habit, choice, n, total from (select lang, habit, choice, n, cast(sum(n) over (partition by lang, habit) as bigint) as total, row_number() over (partition by lang, habit order by n desc, choice) as rn from (
        select lang, habit, choice, count(*) as n from ({each}) e where choice is not null group by lang, habit, choice) x) y where rn = 1"""


@both("rul18_bracket_balance", "texts")
def _(d):
    # one pass with what is open: a closing bracket that meets another one leaves a mark that nothing takes away
    opens, closes, last = "([{", ")]}", "right(s, 1)"
    step = f"case when instr('{opens}', c) > 0 then concat(s, c) when s <> '' and instr('{opens}', {last}) > 0 and instr('{opens}', {last}) = instr('{closes}', c) then left(s, length(s) - 1) else concat(s, '!') end"
    brackets = d.replace("content", "[^\\[\\](){}]", "")
    each = d.extract_all("b", "([\\[\\](){}])")
    return f"select path, {d.fold(each, chr(39) * 2, 's c', step)} = '' as balanced from (select path, {brackets} as b from texts where content is not null) t"


@both("agg11_style_vote", "code")
def _(d):
    # naming by language: the mode, the first of the alphabet where two have as many
    return f"""select lang, choice, n from (select lang, choice, n, row_number() over (partition by lang order by n desc, choice) as rn from (select {d.extract('path', '[.]([A-Za-z]+)$')} as lang, {style(d)} as choice, count(*) as n from (select path, {d.extract('text', '^' + chr(92) + 's*(?:const |let |var |def |function |class |func )+([A-Za-z_][A-Za-z0-9_]*)')} as name from code) c where name <> '' group by 1, 2) x where choice is not null) y where rn = 1"""


@both("agg12_findings", "texts")
def _(d):
    # how often a rule finds something, and the first five places
    return f"select rule, severity, count(*) as n, count(distinct path) as n_files, {d.join(d.slice(d.sorted(f'concat(path, {chr(39)}:{chr(39)}, {pad('line')})'), '1', '5'), ' ')} as locations from {findings_on_lines(d)} f where {suppressed(d, CONFIG_IGNORE)} = 'reported' group by rule, severity"


@both("agg12_security_score", "texts")
def _(d):
    count = lambda s: f"cast(sum(case when severity = '{s}' then 1 else 0 end) as bigint)"
    return f"select path, h, m, l, greatest(0, 100 - 30 * h - 10 * m - 3 * l) as score from (select t.path, {count('high')} as h, {count('medium')} as m, {count('low')} as l from (select path from texts) t left join (select path, severity from {findings_on_lines(d)} f where {suppressed(d, CONFIG_IGNORE)} = 'reported') s on s.path = t.path group by t.path) x"


@both("agg13_review_score", "code")
def _(d):
    return f"select path, w, i, greatest(0, 100 - 15 * w - 3 * i) as score from (select path, long_functions + odd_names + case when poorly_documented then 1 else 0 end as w, todo + repeated as i from ({review(d)}) r) x"


@both("agg15_quality_score", "texts")
def _(d):
    return f"select i as path, cast(floor(100 * overall + 0.5) as double) as score from ({quality(d, '(select path as i, content as x from texts where content is not null)')}) q"


@both("agg18_todo_summary", "code", "touched")
def _(d):
    return f"select priority, count(*) as n from ({todos(d)}) t group by priority"
