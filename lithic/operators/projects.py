"""What projects declare and what their tools print: manifests, locks, environments, imports, logs, patches.

All of it is read from the relations ``code`` (lines) and ``texts`` (whole files) by the path's ending, so any tree's files
will do; over the tables it is the small project beside the documents.
"""

from __future__ import annotations

import builtins
import keyword
import sys

from lithic.plans.catalogue import both

_S = "\\s"


def quoted(words) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in sorted(words))


def names_file(d, *names: str) -> str:
    return d.rlike("path", "(^|/)(" + "|".join(n.replace(".", "[.]") for n in names) + ")$")


def pad(x: str) -> str:
    return f"lpad(cast({x} as varchar(20)), 10, '0')"


def in_blocks(d, header: str, where: str) -> str:
    """Lines with the name of the block that they stand in: that of the last line before them with a header."""
    head = d.extract("text", header)
    return f"(select path, line, text, substr(mark, 11) as block from (select path, line, text, max(case when {head} <> '' then concat({pad('line')}, {head}) end) over (partition by path order by line) as mark from code where {where}) b_)"


def manifests(d) -> str:
    """(path, package, required) of the five kinds of manifest; required is '' where any version will do."""
    js = in_blocks(d, '^ *"([A-Za-z]+)": *[{]', names_file(d, "package.json"))
    py = in_blocks(d, "^\\[([^\\]]+)\\]", names_file(d, "pyproject.toml"))
    rs = in_blocks(d, "^\\[([^\\]]+)\\]", names_file(d, "Cargo.toml"))
    word, mark = "([A-Za-z0-9_.@/-]+)", '"'
    table = f"select path, {d.extract('text', '^' + word + ' *=')} as package, coalesce(nullif({d.extract('text', 'version *= *' + mark + '([^' + mark + ']*)')}, ''), {d.extract('text', '= *' + mark + '([^' + mark + ']*)')}) as required"
    return f"""select path, package, required from (
        select path, {d.extract('text', '^ *"([^"]+)": *"')} as package, {d.extract('text', ': *"([^"]*)"')} as required from {js} j where block in ('dependencies', 'devDependencies', 'peerDependencies', 'optionalDependencies')
        union all select path, {d.extract('text', '^ *"([A-Za-z0-9_.-]+)')}, {d.trim(d.extract('text', '^ *"[A-Za-z0-9_.-]+(?:\\[[^\\]]*\\])?([^"]*)"'))} from {py} p where block = 'project' and {d.rlike('text', '^ +"')}
        union all {table} from {py} q where block in ('tool.poetry.dependencies', 'tool.poetry.dev-dependencies', 'tool.poetry.group.dev.dependencies') and {d.extract('text', '^' + word + ' *=')} <> 'python'
        union all select path, {d.extract('text', '^([A-Za-z0-9][A-Za-z0-9_.-]*)')}, {d.trim(d.extract('text', '^[A-Za-z0-9_.-]+(?:\\[[^\\]]*\\])?' + _S + '*([=<>~!][^#;]*)'))} from code where {d.rlike('path', '(^|/)requirements[^/]*[.]txt$')}
        union all select path, {d.extract('text', '^(?:require)?' + _S + '+([^' + _S + '()]+) +v[0-9]')}, {d.extract('text', ' +(v[0-9][^' + _S + ']*)')} from code where {names_file(d, 'go.mod')}
        union all {table} from {rs} r where block in ('dependencies', 'dev-dependencies', 'build-dependencies')) m where package <> ''"""


@both("src12_manifests", "code")
def _(d):
    return manifests(d)


def locks(d) -> str:
    """(path, package, locked) of the four kinds of lock file."""
    npm = in_blocks(d, '^ *"node_modules/([^"]+)": *[{]', names_file(d, "package-lock.json"))
    toml = in_blocks(d, '^name = "([^"]+)"', names_file(d, "poetry.lock", "Cargo.lock"))
    return f"""select path, package, locked from (select path, block as package, {d.extract('text', '^ *"version": *"([^"]+)"')} as locked from {npm} n union all select path, block, {d.extract('text', '^version = "([^"]+)"')} from {toml} t
        union all select path, {d.extract('text', '^([^ ]+) v[^ /]+ h1:')}, {d.extract('text', '^[^ ]+ (v[^ /]+) h1:')} from code where {names_file(d, 'go.sum')}) l where package <> '' and locked <> ''"""


@both("src13_lock_files", "code")
def _(d):
    return f"select m.path, m.package, m.required, k.locked from ({manifests(d)}) m left join (select package, max(locked) as locked from ({locks(d)}) l group by package) k on k.package = m.package"


ENV_FILE = "(^|/)[.]env([.](local|development|production|example))?$"


def compose_services(d) -> str:
    """(path, line, name): the names under services: of compose files; a line without indentation ends or begins a block."""
    rows = f"select path, line, text, {d.extract('text', '^([A-Za-z_-]+):')} as top, {d.extract('text', '^( *)[^ #]')} as indent from code where {d.rlike('path', '(^|/)(docker-)?compose[^/]*[.]ya?ml$')}"
    return f"""select path, line, {d.extract('text', '^  ([A-Za-z0-9_-]+):')} as name from (select path, line, text, max(case when top <> '' then concat({pad('line')}, top) end) over (partition by path order by line) as block from ({rows}) r) b
        where block is not null and substr(block, 11) = 'services' and {d.rlike('text', '^  [A-Za-z0-9_-]+:' + chr(92) + 's*$')}"""


@both("src14_env_and_services", "code")
def _(d):
    return f"select 'env' as kind, path, line, name from (select path, line, {d.extract('text', '^' + _S + '*(?:export +)?([A-Za-z_][A-Za-z0-9_]*)=')} as name from code where {d.rlike('path', ENV_FILE)}) e where name <> '' union all select 'service', path, line, name from ({compose_services(d)}) s"


# Imports of Python and JavaScript, statement by statement.
_PY = "(?:^|\\n)[ \\t]*(from[ ]+[A-Za-z0-9_.]+[ ]+import[ ]+(?:[(][^)]*[)]|[^\\n#(]+)|import[ ]+[A-Za-z_][^\\n#;]*)"
_JS = "(?:^|\\n)[ \\t]*(import[^'\"`;()]*[ }]from[ ]*['\"][^'\"]+['\"]|(?:const|let|var)[ ]+(?:[{][^}]*[}]|[A-Za-z0-9_$]+)[ ]*=[ ]*require[(][ ]*['\"][^'\"]+['\"])"
_IS_PY, _IS_JS = "[.]py$", "[.][mc]?[jt]sx?$"


def statements(d) -> str:
    """(path, lang, place, statement)"""
    rows = f"(select path, content, case when {d.rlike('path', _IS_PY)} then 'py' when {d.rlike('path', _IS_JS)} then 'js' end as lang from texts) t_"
    return d.each(rows, f"case when lang = 'py' then {d.extract_all('content', _PY)} when lang = 'js' then {d.extract_all('content', _JS)} end", "place statement", "path, lang", "statement is not null")


def imported(d) -> str:
    """(path, lang, place, statement, module, original, local): a row for each name that a statement binds."""
    module = f"case when lang = 'js' then {d.extract('statement', '[' + chr(39) + chr(34) + ']([^' + chr(39) + chr(34) + ']+)[' + chr(39) + chr(34) + ']$')} when {d.rlike('statement', '^from ')} then {d.extract('statement', '^from +([^ ]+)')} end"
    clause = f"case when lang = 'js' and {d.rlike('statement', '^import')} then {d.extract('statement', '^import((?s:.*))from')} when lang = 'js' then {d.extract('statement', '^(?:const|let|var) +((?s:[^=]*))=')} when {d.rlike('statement', '^from ')} then {d.extract('statement', ' import +((?s:.*))$')} else {d.extract('statement', '^import +((?s:.*))$')} end"
    parts = d.each(f"(select path, lang, place, statement, {module} as module, {clause} as clause from {statements(d)} s_) c_", d.split(d.replace("clause", "[(){}" + _S + "]+", " "), ","), "k_ part", "path, lang, place, statement, module", "trim(part) <> ''")
    original, local = d.extract("trim(part)", "^(?:[*] as )?([A-Za-z0-9_.$*]+)"), d.extract("trim(part)", "([A-Za-z0-9_.$*]+)$")
    return f"(select path, lang, place, statement, coalesce(module, {original}) as module, {original} as original, case when lang = 'py' and module is null and not {d.rlike('part', ' as ')} then {d.extract('trim(part)', '^([A-Za-z0-9_]+)')} else {local} end as local from {parts} p_)"


def stripped(d, x: str = "content", lang: str = "lang") -> str:
    """A text without its comments and string literals; what stands in templates stays."""
    py = d.replace(x, '\"\"\"(?s:.*?)\"\"\"|\'\'\'(?s:.*?)\'\'\'|\"(?:[^\"\\\\\\n]|\\\\.)*\"|\'(?:[^\'\\\\\\n]|\\\\.)*\'|#[^\\n]*', " ")
    js = d.replace(x, '\"(?:[^\"\\\\\\n]|\\\\.)*\"|\'(?:[^\'\\\\\\n]|\\\\.)*\'|//[^\\n]*|/[*](?s:.*?)[*]/', " ")
    return f"case when {lang} = 'py' then {py} else {js} end"


def in_fstrings(d, x: str = "content") -> str:
    """The names that the expressions of f-strings begin with."""
    return d.extract_all(d.join(d.extract_all(x, "\\b[fF][rR]?(\"[^\"\\n]*\"|'[^'\\n]*')"), " "), "[{]([A-Za-z_][A-Za-z0-9_]*)")


def bodies(d) -> str:
    """(path, lang, body, formatted): files without import statements, comments and strings, and the names in f-strings."""
    lang = f"case when {d.rlike('path', _IS_PY)} then 'py' when {d.rlike('path', _IS_JS)} then 'js' end"
    rest = f"case when lang = 'py' then {d.replace('content', _PY, ' ')} else {d.replace('content', _JS, ' ')} end"
    return f"(select path, lang, {stripped(d, 'rest')} as body, case when lang = 'py' then {in_fstrings(d, 'rest')} end as formatted from (select path, lang, {rest} as rest from (select path, content, {lang} as lang from texts) l_ where lang is not null) r_)"


def used_names(d) -> str:
    """(path, name): every name that a file's own code speaks of."""
    return f"(select distinct path, name from {d.each(bodies(d) + ' b_', d.extract_all('body', '([A-Za-z_$][A-Za-z0-9_$]*)'), 'k_ name', 'path')} w_ union select distinct path, name from {d.each(bodies(d) + ' b_', 'formatted', 'k_ name', 'path')} f_)"


@both("rul08_unused_imports", "texts")
def _(d):
    # React is spoken of by every JSX element; what a package's __init__ imports is its interface
    return f"""select distinct i.path, i.module, i.local from {imported(d)} i left join {used_names(d)} u on u.path = i.path and u.name = i.local where u.name is null and i.local <> '*'
        and not (i.local = 'React' and {d.rlike('i.path', '[.][jt]sx$')}) and not {d.rlike('i.path', '(^|/)__init__[.]py$')}"""


def definitions(d) -> str:
    """(path, name): functions, classes, methods, variables, parameters and loop variables of a file."""
    plain = d.extract_all("body", "\\b(?:def|class|function|const|let|var|for|as|lambda)[ ]+([A-Za-z_$][A-Za-z0-9_$]*)")
    assigned = d.extract_all("body", "(?:^|\\n)[ \\t]*([A-Za-z_$][A-Za-z0-9_$]*)[ ]*(?::[^=\\n]+)?=[^=]")
    methods = d.extract_all("body", "(?:^|\\n)[ \\t]*(?:async[ ]+|static[ ]+)*([A-Za-z_$][A-Za-z0-9_$]*)[ ]*[(][^()\\n]*[)][ ]*[{]")
    params = d.extract_all(d.join(d.extract_all("body", "(?:def|function)[ ]*[A-Za-z0-9_$]*[ ]*[(]([^)]*)[)]"), ","), "([A-Za-z_$][A-Za-z0-9_$]*)")
    braced = d.extract_all(d.join(d.extract_all("body", "(?:const|let|var)[ ]+[{]([^}]*)[}]"), ","), "([A-Za-z_$][A-Za-z0-9_$]*)")
    return " union ".join(f"select path, name from {d.each(bodies(d) + ' b_', x, 'k_ name', 'path')} d{i}_" for i, x in enumerate((plain, assigned, methods, params, braced)))


# Names that JavaScript and its hosts bring along.
JS_GLOBALS = "Array Boolean Date Error Function JSON Map Math Number Object Promise Proxy Reflect RegExp Set String Symbol TypeError WeakMap WeakSet BigInt Buffer URL URLSearchParams console process require module exports global globalThis window document fetch setTimeout setInterval clearTimeout clearInterval parseInt parseFloat isNaN isFinite encodeURIComponent decodeURIComponent eval super this describe it test expect beforeEach afterEach if for while switch catch return function typeof await new import".split()


def undefined(d) -> str:
    """(path, name): names that a file calls but neither binds nor defines, and that aren't brought along."""
    calls = f"select distinct path, lang, name from {d.each(bodies(d) + ' b_', d.extract_all('body', '(?:^|[^A-Za-z0-9_$.])([A-Za-z_$][A-Za-z0-9_$]*)' + _S + '*[(]'), 'k_ name', 'path, lang')} c_"
    known = quoted({*dir(builtins), *keyword.kwlist, *keyword.softkwlist})
    return f"select c.path, c.name from ({calls}) c left join (select path, local as name from {imported(d)} i union {definitions(d)}) k on k.path = c.path and k.name = c.name where k.name is null and not (c.lang = 'py' and c.name in ({known})) and not (c.lang = 'js' and c.name in ({quoted(JS_GLOBALS)}))"


@both("rul09_import_analysis", "texts")
def _(d):
    # names that are called but neither bound, defined nor brought along; imports that nothing uses, with what is to go; relative and broken-up ones
    unused = f"select i.path, i.place, i.statement, i.local, u.name is null as unused from {imported(d)} i left join {used_names(d)} u on u.path = i.path and u.name = i.local"
    return f"""select path, 'undefined' as kind, name from ({undefined(d)}) c
        union all select path, case when all_unused then 'remove_statement' else 'remove_name' end, local from (select path, local, unused, min(case when unused then 1 else 0 end) over (partition by path, place) = 1 as all_unused from ({unused}) u) x where unused
        union all select distinct path, 'relative', module from {imported(d)} i where {d.rlike('module', '^[.]')} union all select distinct path, 'multi_line', module from {imported(d)} i where instr(statement, chr(10)) > 0"""


# Packages whose name isn't that of what is imported, and packages that are known by their own name.
PACKAGES = {"cv2": "opencv-python", "yaml": "pyyaml", "PIL": "pillow", "sklearn": "scikit-learn", "bs4": "beautifulsoup4", "dotenv": "python-dotenv", "jwt": "pyjwt", "attr": "attrs", "dateutil": "python-dateutil", "gi": "pygobject", "serial": "pyserial", "usb": "pyusb", "wx": "wxpython", "Crypto": "pycryptodome", "nacl": "pynacl", "zmq": "pyzmq", "fitz": "pymupdf", "skvideo": "scikit-video", "skimage": "scikit-image", "u2flib_server": "python-u2flib-server", "magic": "python-magic", "ldap": "python-ldap", "memcache": "python-memcached", "git": "gitpython", "jenkins": "python-jenkins", "ks": "keystone", "k8s": "kubernetes", "google": "google-api-python-client", "firebase_admin": "firebase-admin", "rest_framework": "djangorestframework", "corsheaders": "django-cors-headers", "debug_toolbar": "django-debug-toolbar", "extensions": "django-extensions", "filter": "django-filter", "storages": "django-storages", "angular": "@angular/core", "babel": "@babel/core", "prisma": "@prisma/client", "drizzle": "drizzle-orm", "socket": "socket.io", "gin": "github.com/gin-gonic/gin", "echo": "github.com/labstack/echo", "fiber": "github.com/gofiber/fiber", "chi": "github.com/go-chi/chi", "gorilla": "github.com/gorilla/mux", "cobra": "github.com/spf13/cobra", "viper": "github.com/spf13/viper", "zap": "go.uber.org/zap", "logrus": "github.com/sirupsen/logrus"}
SAME_NAME = "soundfile celery kombu flask jinja2 werkzeug click itsdangerous markdown markupsafe numpy pandas scipy matplotlib seaborn torch tensorflow transformers datasets fastapi pydantic starlette uvicorn gunicorn requests httpx aiohttp sqlalchemy alembic redis pymongo pytest mock mypy black ruff lodash axios react react-dom tree-sitter better-sqlite3 vue svelte next nuxt express koa webpack vite rollup esbuild eslint prettier jest mocha chai vitest typescript tsx moment dayjs date-fns rxjs immer zod yup ws".split()
# Modules that Node brings along.
NODE_MODULES = "assert buffer child_process cluster console crypto dgram dns events fs http http2 https module net os path perf_hooks process querystring readline stream string_decoder timers tls tty url util v8 vm worker_threads zlib".split()


def gatekeeper(d) -> str:
    """(path, module, package, required, locked, state): what a file imports against standard modules, the project's own
    files, its manifests and its locks."""
    root = f"case when lang = 'js' then {d.extract('module', '^((?:@[^/]+/)?[^/]+)')} else {d.extract('module', '^([^.]+)')} end"
    asked = f"select distinct path, lang, module, {root} as root from {imported(d)} i"
    own = f"select distinct name from (select {d.extract('path', '([^/]+)[.][^./]+$')} as name from texts union all select name from {d.each('(select distinct path from texts) p_', d.split('path', '/'), 'k_ name', 'path')} s_ where not {d.rlike('name', '[.]')}) o where name <> ''"
    standard = f"(a.lang = 'py' and a.root in ({quoted(x for x in sys.stdlib_module_names if x[0] != '_')}) or a.lang = 'js' and ({d.rlike('a.module', '^node:')} or a.root in ({quoted(NODE_MODULES)})))"
    package = d.table("root, package", sorted({**PACKAGES, **{x: x for x in SAME_NAME}}.items()))
    return f"""select a.path, a.module, coalesce(p.package, a.root) as package, m.required, k.locked, case when a.root = '' or {d.rlike('a.module', '^[.]')} then 'local' when {standard} then 'stdlib' when m.package is not null and k.locked is null then 'unlocked' when m.package is not null then 'ok' when o.name is not null then 'local' when p.package is not null then 'missing' else 'unknown' end as state
        from ({asked}) a left join {package} p on p.root = a.root left join (select lower(package) as package, max(required) as required from ({manifests(d)}) x group by lower(package)) m on m.package = lower(coalesce(p.package, a.root)) left join (select lower(package) as package, max(locked) as locked from ({locks(d)}) y group by lower(package)) k on k.package = m.package left join ({own}) o on o.name = a.root"""


@both("rul17_dependency_gatekeeper", "code", "texts")
def _(d):
    return f"select path, module, package, state from ({gatekeeper(d)}) g"


@both("jn18_dependency_chain", "code", "texts")
def _(d):
    return f"select package, state, max(required) as required, max(locked) as locked, count(*) as n_files from ({gatekeeper(d)}) g where state not in ('local', 'stdlib') group by package, state"


@both("ext17_dynamic_imports", "code")
def _(d):
    # import('x') outside strings and comments, where no import statement of the file names the module; once a module
    call = "(?:^|[^A-Za-z0-9_$.'\"])import[(][ ]*['\"]([^'\"]+)['\"]"
    rows = d.each(f"(select path, line, text from code where {d.rlike('path', _IS_JS)} and not {d.rlike('text', '^' + _S + '*(//|[*]|/[*])')}) c_", d.extract_all("text", call), "k_ module", "path, line")
    static = f"select distinct path, {d.extract('text', '^' + _S + '*import' + chr(92) + 'b[^(]*[' + chr(39) + chr(34) + ']([^' + chr(39) + chr(34) + ']+)')} as module from code where {d.rlike('path', _IS_JS)}"
    return f"select r.path, r.module, min(r.line) as line from {rows} r left join ({static}) s on s.path = r.path and s.module = r.module where s.module is null group by r.path, r.module"


@both("ext18_alias_map", "texts")
def _(d):
    return f"select path, module, original, local from {imported(d)} i where lang = 'js' and {d.rlike('statement', 'require[(]')}"


@both("ext21_doc_lines", "code")
def _(d):
    # of each definition: the first line of a docstring within four lines below, and the decorators right above, of ten lines
    defines = d.extract("text", "^\\s*(?:async +)?(?:def|class) +([A-Za-z_][A-Za-z0-9_]*)")
    below = [f"lead(text, {k}) over (partition by path order by line)" for k in range(1, 5)]
    above = [f"lag(text, {k}) over (partition by path order by line)" for k in range(1, 11)]
    doc = "case " + " ".join(f"when {d.rlike(f'b{k}', '^' + _S + '*[rRuU]?(' + chr(34) * 3 + '|' + chr(39) * 3 + ')')} then {d.trim(d.replace(f'b{k}', chr(34) * 3 + '|' + chr(39) * 3, ''))}" for k in range(1, 5)) + " end"
    decorator = "case " + " ".join(f"when a{k} is null or not {d.rlike(f'a{k}', '^' + _S + '*@')} then {k - 1}" for k in range(1, 11)) + " else 10 end"
    cols = ", ".join([f"{x} as b{k}" for k, x in enumerate(below, 1)] + [f"{x} as a{k}" for k, x in enumerate(above, 1)])
    return f"select path, line, name, {doc} as doc, cast({decorator} as bigint) as n_decorators, case when {decorator} > 0 then {d.extract('a1', '@([A-Za-z_][A-Za-z0-9_.]*)')} end as decorator from (select path, line, {defines} as name, {cols} from code where {d.rlike('path', _IS_PY)}) x where name <> ''"


# What tools print.
_ANSI = "\\x1b\\[[0-9;]*[A-Za-z]"


def log_lines(d) -> str:
    return f"(select path, line, {d.replace('text', _ANSI, '')} as text from code where {d.rlike('path', '[.]log$')})"


@both("str25_test_outcomes", "code")
def _(d):
    status = f"lower(coalesce(nullif({d.extract('text', '^[^ ]+::[^ ]+ (PASSED|FAILED|SKIPPED|ERROR|XFAIL|XPASS)')}, ''), nullif({d.extract('text', '^' + _S + '*--- (PASS|FAIL|SKIP):')}, '')))"
    name = f"coalesce(nullif({d.extract('text', '^([^ ]+::[^ ]+) [A-Z]')}, ''), nullif({d.extract('text', '^' + _S + '*--- [A-Z]+: ([^ ]+)')}, ''))"
    return f"select path, line, name, case when status in ('passed', 'pass', 'xpass') then 'passed' when status in ('failed', 'fail', 'error') then 'failed' else 'skipped' end as status from (select path, line, {name} as name, {status} as status from {log_lines(d)} l) x where status is not null"


@both("agg20_test_summary", "code")
def _(d):
    # a summary line where the tool prints one, else a count of outcomes
    number = lambda w: f"coalesce(try_cast(nullif({d.extract('text', '([0-9]+) ' + w)}, '') as bigint), 0)"
    mark = lambda *w: " + ".join(f"case when {d.rlike('text', x)} then 1 else 0 end" for x in w)
    one = f"select path, {d.rlike('text', '^(Tests:|=+ .*[0-9]+ (passed|failed|skipped))')} as total, {number('passed')} as p, {number('failed')} as f, {number('skipped')} as s, {mark('^[^ ]+::[^ ]+ PASSED', '^ *--- PASS:')} as p1, {mark('^[^ ]+::[^ ]+ (FAILED|ERROR)', '^ *--- FAIL:')} as f1, {mark('^[^ ]+::[^ ]+ SKIPPED', '^ *--- SKIP:')} as s1 from {log_lines(d)} l"
    pick = lambda c: f"cast(case when max(case when total then 1 else 0 end) = 1 then sum(case when total then {c} else 0 end) else sum({c}1) end as bigint)"
    return f"select path, {pick('p')} as passed, {pick('f')} as failed, {pick('s')} as skipped from ({one}) x group by path having sum(p1 + f1 + s1) > 0 or max(case when total then 1 else 0 end) = 1"


# Kinds of error, the first that a text holds.
ERRORS = [("SyntaxError", "(?i)SyntaxError"), ("TypeError", "(?i)TypeError"), ("ReferenceError", "(?i)ReferenceError"), ("AssertionError", "(?i)AssertionError|assertion failed"), ("TimeoutError", "(?i)TimeoutError"), ("PermissionError", "(?i)EACCES|EPERM"), ("NotFoundError", "(?i)ENOENT"), ("PortInUseError", "(?i)EADDRINUSE"), ("ConnectionRefused", "(?i)ECONNREFUSED"), ("SegFault", "(?i)Segmentation fault|SIGSEGV"), ("Panic", "(?i)panic"), ("NpmError", "(?i)npm ERR|packages failed"), ("LintError", "(?is)Lint.*error|error.*Lint"), ("TestFailure", "(?i)Test failed|FAILED|tests failed")]
# Frames of stack traces: language, pattern, groups of function, file and line (0: none).
FRAMES = [("js", "^\\s+at\\s+(.+?)\\s*[(](.+?):([0-9]+):[0-9]+[)]$", 1, 2, 3), ("py", '^\\s*File\\s+"(.+?)",\\s+line\\s+([0-9]+)(?:,\\s+in\\s+(.+))?$', 3, 1, 2), ("go", "^\\s+(.+?)[(](.+?):([0-9]+)[)]", 1, 2, 3), ("rs", "^\\s+at\\s+(.+?):([0-9]+):([0-9]+)", 0, 1, 2)]


@both("str26_stack_frames", "code", "texts")
def _(d):
    # frames are rows; what kind of error a whole log speaks of stands beside them
    pick = lambda g: "case lang " + " ".join(f"when '{x[0]}' then {d.extract('text', x[1], x[g]) if x[g] else chr(39) * 2}" for x in FRAMES) + " end"
    lang = "case " + " ".join(f"when {d.rlike('text', x[1])} then '{x[0]}' end" if x is FRAMES[-1] else f"when {d.rlike('text', x[1])} then '{x[0]}'" for x in FRAMES)
    kind = "case " + " ".join(f"when {d.rlike('content', p)} then '{n}'" for n, p in ERRORS) + " else 'RuntimeError' end"
    return f"""select f.path, f.line, f.lang, f.func, f.file, cast(f.at_line as bigint) as at_line, e.error from (select path, line, lang, {pick(2)} as func, {pick(3)} as file, {pick(4)} as at_line from (select path, line, text, {lang} as lang from {log_lines(d)} l) x where lang is not null) f
        join (select path, {kind} as error from texts where {d.rlike('path', '[.]log$')}) e on e.path = f.path"""


@both("str27_diagnostics", "code")
def _(d):
    tsc = "^(.+?)[(]([0-9]+),([0-9]+)[)]: (error|warning) (TS[0-9]+): (.*)$"
    lint = "^(.+?):([0-9]+):([0-9]+): (.*) \\[(Error|Warning)/([^\\]]+)\\]$"
    part = lambda a, b: f"case when tool = 'tsc' then {d.extract('text', tsc, a)} else {d.extract('text', lint, b)} end"
    return f"select tool, {part(1, 1)} as file, cast({part(2, 2)} as bigint) as at_line, cast({part(3, 3)} as bigint) as col, lower({part(4, 5)}) as severity, {part(5, 6)} as code, {part(6, 4)} as message from (select text, case when {d.rlike('text', tsc)} then 'tsc' when {d.rlike('text', lint)} then 'eslint' end as tool from {log_lines(d)} l) x where tool is not null"


# Patches.
@both("str19_patch_blocks", "code")
def _(d):
    # blocks by lines: what begins one, divides it and ends it; one that doesn't end is unclosed
    mark = f"case when {d.rlike('text', '^<{5,} SEARCH')} then 's' when {d.rlike('text', '^={5,}$')} then 'd' when {d.rlike('text', '^>{5,} REPLACE')} then 'e' end"
    rows = f"select path, line, text, m, sum(case when m = 's' then 1 else 0 end) over (partition by path order by line) as block, sum(case when m in ('s', 'd', 'e') then 1 else 0 end) over (partition by path order by line) as part from (select path, line, text, {mark} as m from code where {d.rlike('path', '[.]patch$')}) p"
    return f"""select path, cast(block as bigint) as block, min(line) as line, cast(count_if(side = 's' and m is null) as bigint) as old_lines, cast(count_if(side = 'd' and m is null) as bigint) as new_lines, count_if(m = 'e') = 0 as unclosed from (
        select path, line, m, block, max(m) over (partition by path, part) as side from ({rows}) r where block > 0) x group by path, block"""


@both("str19_diff_lines", "code")
def _(d):
    # added and removed lines by file: the file is that of the last +++ line
    file = d.extract("text", "^[+]{3} (?:b/)?([^\\t]+)")
    rows = f"(select path, text, substr(mark, 11) as file from (select path, line, text, max(case when {file} <> '' then concat({pad('line')}, {file}) end) over (partition by path order by line) as mark from code where {d.rlike('path', '[.](diff|patch)$')}) m where mark is not null)"
    return f"select path, file, cast(count_if({d.rlike('text', '^[+]')} and not {d.rlike('text', '^[+]{3} ')}) as bigint) as added, cast(count_if({d.rlike('text', '^-')} and not {d.rlike('text', '^--- ')}) as bigint) as removed from {rows} r group by path, file"


@both("str23_constants", "code")
def _(d):
    # what a constant is set to; a value that calls something is dynamic; JSON where it is a literal of it
    name = d.extract("text", "^(?:export +)?(?:const |let |var )?([A-Z][A-Z0-9_]*)\\s*(?::[^=]+)?=[^=]")
    value = d.trim(d.replace(d.extract("text", "^[^=]*=\\s*([^=].*)$"), "\\s*(;|#.*|//.*)$", ""))
    literal = d.rlike("value", '^(-?[0-9]+([.][0-9]+)?|true|false|null|"[^"]*")$')
    return f"select path, line, name, value, {d.rlike('value', '[A-Za-z_$)][(]|^new |^await ')} as dynamic, {literal} as json_literal from (select path, line, {name} as name, {value} as value from code where {d.rlike('path', '[.](py|[mc]?[jt]sx?)$')}) x where name <> ''"


@both("str05_stripped", "texts")
def _(d):
    lang = f"case when {d.rlike('path', _IS_PY)} then 'py' when {d.rlike('path', '[.]([mc]?[jt]sx?|go|rs|c|h|cpp|java)$')} then 'js' end"
    return f"select path, lang, {stripped(d)} as code from (select path, content, {lang} as lang from texts) t where lang is not null"


@both("str03_string_ranges", "texts")
def _(d):
    # literals by place: the text is cut at them, and lengths add up
    literal = "(\"(?:[^\"\\\\\\n]|\\\\.)*\"|'(?:[^'\\\\\\n]|\\\\.)*')"
    marked = d.replace("content", literal, "$1".join((chr(1), chr(1))))
    parts = d.each(f"(select path, {marked} as body from texts where {d.rlike('path', '[.](py|[mc]?[jt]sx?|go|c|cpp|java)$')}) b_", d.split("body", chr(1)), "place part", "path")
    return f"select path, cast(a as bigint) as a, cast(a + n as bigint) as b from (select path, place, length(part) as n, coalesce(sum(length(part)) over (partition by path order by place rows between unbounded preceding and 1 preceding), 0) as a from {parts} p) x where place % 2 = 0"


@both("str06_fstring_names", "texts")
def _(d):
    return f"select distinct path, name from {d.each('(select path, content from texts where ' + d.rlike('path', _IS_PY) + ') t_', in_fstrings(d), 'k_ name', 'path')} f"


@both("pth03_relative_imports", "texts")
def _(d):
    # './' and '../' against the importer's folder, with the endings that may be left out; the first file there wins
    up = "case when p in ('', '.') then s when p = '..' then " + "s[1:len(s) - 1]" + " else list_append(s, p) end"
    folder = f"select distinct path, module, {d.replace('path', '[^/]*$', '')} as dir from {imported(d)} i where {d.rlike('module', '^[.][.]?/')}"
    if d.name == "spark":
        up = "case when p in ('', '.') then s when p = '..' then slice(s, 1, greatest(size(s) - 1, 0)) else array_append(s, p) end"
    start = "cast(array() as array<string>)" if d.name == "spark" else "[]::varchar[]"
    if d.name == "duck":  # its fold takes elements of the list's own type
        joined = d.replace(d.replace(d.replace("concat(dir, module)", "(^|/)[.]/", "$1"), "[^/]+/[.][.]/", ""), "[^/]+/[.][.]/", "")
    else:
        joined = d.join(d.fold(d.split("concat(dir, module)", "/"), start, "s p", up), "/")
    ends = d.table("ending, rank", [("", 0), (".js", 1), (".ts", 2), (".jsx", 3), (".tsx", 4), (".mjs", 5), ("/index.js", 6), ("/index.ts", 7)])
    return f"select path, module, target from (select r.path, r.module, t.path as target, row_number() over (partition by r.path, r.module order by e.rank) as rn from (select path, module, {joined} as base from ({folder}) f) r cross join {ends} e left join (select distinct path from texts) t on t.path = concat(r.base, e.ending) where t.path is not null) x where rn = 1"

