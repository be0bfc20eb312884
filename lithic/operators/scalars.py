"""Scalar functions over text, paths, hashes, dates, lists, maps and JSON."""

from __future__ import annotations

from lithic.operators.aggregates import js_round, style
from lithic.plans.catalogue import both

NAMES = [(1, "getUserName"), (2, "get_user_name"), (3, "MAX_SIZE"), (4, "UserModel"), (5, "x"), (6, "HTMLParser"), (7, "fetchAll2"), (8, "_private"), (9, "kebab-case"), (10, "")]


@both("str01_like_escape", "files")
def _(d):
    return f"select x, {d.replace('x', '([%_])', '~$1')} as escaped from {d.table('x', [('100%',), ('a_b',), ('plain',)])} v union all select path, {d.replace('path', '([%_])', '~$1')} from files"


@both("str02_literal_search", "files")
def _(d):
    # a literal needs no pattern, so nothing is to be escaped
    return "select path, cast(instr(content, '. The ') as bigint) as at, instr(content, '!!') > 0 as shouts from files"


@both("str04_strip_strings", "lines")
def _(d):
    code = [(1, 'a = "b c" + d'), (2, "f('x', \"y\")"), (3, "no strings")]
    strip = lambda x: d.replace(d.replace(x, '"[^"]*"', '""'), "'[^']*'", "")
    rows = " union all ".join(f"select {i} as i, {d.lit(c) if chr(39) not in c or d.name == 'duck' else chr(34) + c.replace(chr(34), chr(92) + chr(34)) + chr(34)} as x" for i, c in code)
    return f"select i, {strip('x')} as stripped from ({rows}) v union all select file_id * 1000 + line, {strip('text')} from lines"


@both("str07_case_class", "symbols")
def _(d):
    return f"select i, x, {style(d, 'x')} as style from {d.table('i, x', NAMES)} v union all select id, name, {style(d)} from symbols"


@both("str08_leading_verb", "symbols")
def _(d):
    verb = lambda x: f"case when instr({x}, '_') > 1 then {d.item(d.split(x, '_'), '1')} else {d.extract(x, '^([a-z]+)')} end"
    return f"select i, x, {verb('x')} as verb from {d.table('i, x', NAMES)} v union all select id, name, {verb('name')} from symbols"


@both("str09_case_convert", "symbols")
def _(d):
    snake = f"lower({d.replace(d.replace('x', '([a-z0-9])([A-Z])', '$1_$2'), '([A-Z])([A-Z][a-z])', '$1_$2')})"
    camel = d.join(d.map(d.split("x", "_"), "w", "concat(upper(substr(w, 1, 1)), substr(w, 2))"), "")
    return f"select i, x, {snake} as snake, {camel} as pascal from (select i, x from {d.table('i, x', NAMES)} v union all select id, name from symbols) t"


@both("str10_file_convention", "files")
def _(d):
    base = "x"
    files = [(1, "my-file.js"), (2, "myFile.js"), (3, "MyFile.js"), (4, "my_file.py"), (5, "x.py"), (6, "A.b.c")]
    stem = d.extract(base, "^([^.]*)")
    return f"select i, x, case when {d.rlike(stem, '^[a-z0-9]+(-[a-z0-9]+)+$')} then 'kebab' when {d.rlike(stem, '^[a-z0-9]+(_[a-z0-9]+)+$')} then 'snake' when {d.rlike(stem, '^[A-Z]')} then 'Pascal' when {d.rlike(stem, '^[a-z][A-Za-z0-9]*$')} then 'camel' else 'other' end as style from (select i, x from {d.table('i, x', files)} v union all select file_id + 100, {d.extract('path', '([^/]*)$')} from files) t"


@both("str11_normalise_space", "lines")
def _(d):
    return f"select path, line, {d.trim(d.replace('text', '[ ]+', ' '))} as normal, lower({d.replace('text', '[^A-Za-z0-9]+', '')}) as fuzzy from lines"


QUERIES = [(1, "who calls the parser"), (2, "unused functions in src"), (3, "how complex is main"), (4, "what imports util"), (5, "find user login"), (6, "callees of render"), (7, "dead code"), (8, "impact of rename"), (9, "")]
# Intents in the order in which they are tried, over lower-cased text.
INTENTS = [
    ("findFunction", "function +[a-z0-9_]+|method +[a-z0-9_]+|where is [a-z0-9_]+ (function|method|defined)|find +(the +)?[a-z0-9_]+ +(function|method)"),
    ("findClass", "class +[a-z0-9_]+|where is [a-z0-9_]+ class|find +(the +)?[a-z0-9_]+ +class"),
    ("findVariable", "variable +[a-z0-9_]+|where is [a-z0-9_]+ (variable|const)"),
    ("whereUsed", "(where|how|what) +(is +)?[a-z0-9_]+ +(used|called|referenced)|who calls [a-z0-9_]+|impact.*[a-z0-9_]+"),
    ("deadCode", "dead *code|unused +(function|code)|never +called|what.*not.*used"),
    ("dependencyTree", "dependency +(tree|graph|chain)|depend.*module|import.*graph"),
    ("complexity", "complex|hard to understand|too many lines"),
    ("search", "search +(for +)?[a-z0-9_]+|find +(the +)?[a-z0-9_]+|locate +[a-z0-9_]+"),
]


@both("str12_tokenise", "conversations")
def _(d):
    # Latin words and runs of Han characters are kept
    tokens = d.keep(d.split(d.replace("x", "[^A-Za-z0-9_\u4e00-\u9fff]+", " "), " "), "w", "w <> ''")
    return f"select i, {d.size(tokens)} as n_tokens, {d.join(d.slice(tokens, '1', '5'), '|')} as first5 from (select i, x from {d.table('i, x', QUERIES)} v union all select conv_id * 1000 + turn, text from conversations) t"


def intent(d, x: str) -> str:
    return "case " + " ".join(f"when {d.rlike(f'lower({x})', p)} then '{n}'" for n, p in INTENTS) + " else 'search' end"


@both("str13_intent", "conversations")
def _(d):
    return f"select i, {intent(d, 'x')} as intent from (select i, x from {d.table('i, x', QUERIES)} v union all select conv_id * 1000 + turn, text from conversations) t"


SCORE = "case when lower(name) = tok then 0.9 else 0.7 * length(tok) / greatest(length(tok), length(name)) end"


@both("str14_match_score", "symbols")
def _(d):
    return f"select tok, name, cast({SCORE} as double) as score from (select distinct name from symbols) s cross join {d.table('tok', [('the',), ('tion',), ('re',)])} q where instr(lower(name), tok) > 0"


@both("top04_search_fusion", "symbols", "files")
def _(d):
    # one search: intent, then symbols, then files; an earlier source wins a key; the best by score
    return f"""with hits as (select 0 as source, 'intent:dead' as k, cast(0.9 as double) as score union all
        select 1, concat('symbol:', name, ':', path), cast({SCORE} as double) from symbols s cross join {d.table('tok', [('the',), ('tion',)])} q where instr(lower(name), tok) > 0
        union all select 2, concat('file:', path), cast(case when length(tok) > 3 then 0.5 else 0.3 end as double) from symbols s cross join {d.table('tok', [('the',), ('tion',)])} q where instr(lower(name), tok) > 0)
        select k, source, score from (select k, source, score, row_number() over (partition by k order by source, score desc) as rn from hits) x where rn = 1 order by score desc, source, k limit 20"""


@both("set03_fusion_dedupe", "symbols")
def _(d):
    return "select k, min(source) as source, count(*) as n from (select concat(name, '|', path) as k, 1 as source from symbols union all select concat(name, '|', path), 2 from symbols where type = 'class' union all select path, 3 from symbols) x group by k"


def words(d, x: str) -> str:
    return d.distinct(d.keep(d.split(f"lower({x})", " "), "w", "w <> ''"))


def jaccard(d, a: str, b: str) -> str:
    return f"(cast({d.size(d.intersect(a, b))} as double) / nullif({d.size(d.unite(a, b))}, 0))"


@both("str15_jaccard", "lines")
def _(d):
    return f"select path, line, {jaccard(d, words(d, 'text'), words(d, 'before'))} as similarity from (select path, line, text, lag(text) over (partition by path order by line) as before from lines) x where before is not null"


@both("str16_closest_window", "lines")
def _(d):
    # two lines are asked for: if they are there but for white space, that is said; else the likest two lines, if like enough
    plain = lambda x: d.trim(d.replace(x, "[ \\t\\n]+", " "))
    score = jaccard(d, words(d, plain("pair")), words(d, plain("asked")))
    return f"""with p as (select file_id, line, text || chr(10) || lead(text) over (partition by file_id order by line) as pair from lines),
        q as (select file_id, case when file_id % 2 = 0 then replace(pair, ' ', '  ') else concat('some other words ', pair) end as asked from p where line = 2 and pair is not null),
        s as (select p.file_id, line, {score} as similarity, instr({plain('pair')}, {plain('asked')}) > 0 as same from p join q on q.file_id = p.file_id where pair is not null)
        select file_id, line, case when same then 'whitespace_normalized' else 'closest' end as found_via, case when same then cast(1.0 as double) else {js_round('similarity')} end as similarity
        from (select s.*, row_number() over (partition by file_id order by same desc, similarity desc, line) as rn from s) x where rn = 1 and (same or similarity >= 0.3)"""


@both("str17_edit_distance", "symbols")
def _(d):
    # names that are one edit apart meet in the name itself or in what is left when a letter of one or both is taken out
    left = d.distinct(d.unite(d.list("name"), d.map(d.span("1", "length(name)"), "i", "concat(substr(name, 1, cast(i as int) - 1), substr(name, cast(i as int) + 1))")))
    parts = d.each("(select distinct name from symbols where name <> '') n_", left, "k_ part", "name")
    return f"select distinct a.name, b.name as suggestion, cast(levenshtein(a.name, b.name) as bigint) as distance from {parts} a join {parts} b on b.part = a.part and a.name <> b.name where levenshtein(a.name, b.name) <= 1"


@both("str18_occurrences", "files")
def _(d):
    # apart, and overlapping: at every place where it starts
    # a run of n letters holds n - 1 pairs of them
    runs = lambda x: f"cast(length({x}) - length({d.replace(x, 'e{2,}', '')}) as bigint) - {d.count(x, 'e{2,}')}"
    return f"select path, cast((length(content) - length(replace(content, 'ee', ''))) / 2 as bigint) as apart, {runs('content')} as overlapping from (select path, content from files union all select x, x from {d.table('x', [('eee',), ('eeeee e ee',), ('',)])} v) t"


SIGNATURES = [(1, "function f(a, b = 2, ...rest)"), (2, "def g(self, x: int = 1, *args)"), (3, "func h()"), (4, "fn k(a: u8, b: &str) -> bool"), (5, "no parens")]


@both("str21_parameters", "symbols")
def _(d):
    parts = d.keep(d.map(d.split(d.extract("x", "[(]([^)]*)[)]"), ","), "p", d.trim(d.replace("p", "[:=].*$", ""))), "p", "p <> '' and p <> 'self'")
    return f"select i, x, {d.join(parts, '|')} as params, {d.size(parts)} as n from (select i, x from {d.table('i, x', SIGNATURES)} v union all select id, signature from symbols) t"


LITERALS = [(1, "limit = the"), (2, "# the end"), (3, "  // the"), (4, "print(the)"), (5, "def the(the, the, the):"), (6, "assert the"), (7, "f(the)")]


def literal_score(d, x: str, literal: str = "the") -> str:
    """What each sign of a line takes from the confidence that the literal in it is meant."""
    signs = [(f"instr({x}, '=') > 0", 0.2), (d.rlike(x, "^[ \\t]*#"), 0.5), (d.rlike(x, "^[ \\t]*//"), 0.5), (d.rlike(x, "print|log|console[.]"), 0.2), (d.rlike(x, "def |function "), 0.3), (f"instr({x}, 'assert') > 0", 0.1), (f"length({x}) - length(replace({x}, '{literal}', '')) > {2 * len(literal)}", 0.2)]
    return "greatest(cast(0 as double), cast(1 as double)" + "".join(f" - cast(case when {c} then {w} else 0.0 end as double)" for c, w in signs) + ")"


@both("str22_literal_confidence", "lines")
def _(d):
    return f"select i, {js_round('score')} as confidence, case when score >= 0.8 then 'high' else 'medium' end as level from (select i, {literal_score(d, 'x')} as score from (select i, x from {d.table('i, x', LITERALS)} v union all select file_id * 1000 + line, text from lines) t where instr(x, 'the') > 0) y where score >= 0.5"


@both("str24_word_boundary", "lines")
def _(d):
    return f"select path, line, {d.count('text', '(^|[^A-Za-z0-9_])the([^A-Za-z0-9_]|$)')} as n from lines where {d.rlike('text', '(^|[^A-Za-z0-9_])the([^A-Za-z0-9_]|$)')}"


ERRORS = [(1, "TypeError: x is not a function"), (2, "ModuleNotFoundError: No module named a"), (3, "panic: runtime error: index out of range"), (4, "SyntaxError: Unexpected token"), (5, "ECONNREFUSED 127.0.0.1"), (6, "File a.py, line 3, in f"), (7, "    at g (src/x.js:10:5)"), (8, "AssertionError"), (9, "fine")]


@both("str28_message_category", "conversations")
def _(d):
    kinds = [("missing", "not found|missing|no such"), ("invalid", "invalid|illegal|bad"), ("denied", "denied|forbidden|unauthor"), ("timeout", "timed? ?out|deadline")]
    cases = " ".join(f"when {d.rlike('lower(x)', p)} then '{k}'" for k, p in kinds)
    samples = [(1, "File not found"), (2, "Invalid value"), (3, "Permission denied"), (4, "Request timed out"), (5, "ok")]
    return f"select i, case {cases} else 'general' end as category from (select i, x from {d.table('i, x', samples)} v union all select conv_id * 1000 + turn, text from conversations) t"


@both("pth01_path_parts", "files")
def _(d):
    return f"select path, {d.extract('path', '([^/]*)$')} as base, {d.extract('path', '^(.*)/[^/]*$')} as parent, {d.extract('path', '[.]([^./]*)$')} as ext, {d.replace('path', '/+', '/')} as normal from files"


@both("pth02_language", "functions")
def _(d):
    ext = d.extract("path", "[.]([a-z]+)$")
    return f"select id, case {ext} when 'py' then 'python' when 'js' then 'javascript' when 'ts' then 'typescript' else 'other' end as language, case when {ext} in ('js', 'ts', 'jsx', 'tsx') then 'js' else {ext} end as family from functions"


@both("pth04_test_candidates", "functions")
def _(d):
    stem, parent = d.extract("path", "([^/.]*)[.][^/]*$"), d.extract("path", "^(.*)/[^/]*$")
    forms = d.list(f"concat({parent}, '/', {stem}, '.test.js')", f"concat({parent}, '/__tests__/', {stem}, '.js')", f"concat('tests/test_', {stem}, '.py')", f"concat({parent}, '/', {stem}, '_test.go')")
    return f"select id, i, candidate from {d.each('(select id, path from functions) q', forms, 'i candidate', 'id')}"


@both("hsh01_hashes", "symbols")
def _(d):
    return f"select path, start_line, {d.sha('signature')} as signature_hash, {d.sha('name')} as name_hash from symbols"


@both("hsh02_workspace_key", "files")
def _(d):
    return "select path, substr(md5(path), 1, 12) as workspace from files"


@both("hsh03_stable_id", "symbols")
def _(d):
    return f"select path, start_line, concat('text:', {d.replace('path', '[#:]', '_')}, '::', {d.replace('name', '[#:]', '_')}, '#', type) as stable from symbols"


@both("mth01_complexity", "symbols")
def _(d):
    return "select path, name, start_line, loc, cyclomatic, cognitive, least(10, cast(floor((cyclomatic + cognitive) / 2.0 + 0.5) as bigint)) as score from (select path, name, start_line, end_line - start_line + 1 as loc, least(10, cast(ceil((end_line - start_line + 1) / 10.0) as bigint)) as cyclomatic, least(10, cast(ceil((end_line - start_line + 1) / 15.0) as bigint)) as cognitive from symbols) x"


@both("mth02_index_estimate", "files")
def _(d):
    text = lambda x: f"cast(cast({x} as bigint) as varchar(20))"
    minutes = "ceil(seconds / 60.0)"
    label = f"case when seconds < 60 then concat('~', {text('greatest(1, seconds)')}, 's') when {minutes} < 60 then concat('~', {text(minutes)}, ' min') else concat('~', {text(f'floor({minutes} / 60.0)')}, 'h', case when {minutes} % 60 <> 0 then concat(' ', {text(f'{minutes} % 60')}, 'm') else '' end) end"
    sizes = [("one", 1), ("small", 737), ("large", 20_000), ("huge", 500_000), ("full", 359_900)]
    return f"select k, n, seconds, {label} as label from (select k, n, cast(ceil(1 + n / 100.0) as bigint) as seconds from (select k, cast(n as bigint) as n from {d.table('k, n', sizes)} v union all select lang, count(*) from files group by lang) t) x"


@both("mth03_task_weight", "usage")
def _(d):
    # a heavy task takes half of the slots, three at least, and never more than there are
    return "select slots, least(slots, greatest(3, cast(floor(slots / 2.0) as bigint))) as heavy, n from (select session % 12 + 1 as slots, count(*) as n from usage group by 1) x"


@both("dat01_age_buckets", "usage")
def _(d):
    now = "timestamp '2024-12-31 00:00:00'"
    return f"select case when {d.days(now, 'ts')} <= 7 then 'week' when {d.days(now, 'ts')} <= 30 then 'month' when {d.days(now, 'ts')} <= 365 then 'year' else 'older' end as age, count(*) as n from usage group by 1"


@both("dat02_age_label", "usage")
def _(d):
    # how long before the newest event
    minutes = f"floor((newest - {d.seconds('ts')}) / 60.0)"
    text = lambda x: f"cast(cast({x} as bigint) as varchar(20))"
    return f"select event_id, case when minutes < 60 then concat({text('minutes')}, ' min') when minutes < 1440 then concat({text('floor(minutes / 60.0)')}, ' h') else concat({text('floor(minutes / 1440.0)')}, ' d') end as label from (select event_id, {minutes} as minutes from usage cross join (select max({d.seconds('ts')}) as newest from usage) m) x"


@both("arr01_list_ops", "lines")
def _(d):
    w = d.keep(d.split("text", " "), "w", "w <> ''")
    return f"select path, line, {d.join(d.slice(w, '1', '3'), '|')} as first3, {d.size(d.distinct(w))} as n_distinct, {d.has(w, d.lit('the'))} as has_the from lines"


@both("map01_metric_sums", "usage")
def _(d):
    # every key of the metrics, whatever they are called
    keys = d.extract_all("props", '"([A-Za-z0-9_]+)" *: *-?[0-9]')
    values = d.extract_all("props", '"[A-Za-z0-9_]+" *: *(-?[0-9]+)')
    rows = d.each(f"(select tool, {keys} as ks, {values} as vs from usage) u_", "ks", "place metric", "tool, vs")
    return f"select metric, tool, cast(sum(cast({d.item('vs', 'place')} as bigint)) as bigint) as total, count(*) as n from {rows} r group by metric, tool"


@both("jsn01_props", "usage")
def _(d):
    return f"select event_id, cast({d.json('props', 'k')} as bigint) as k, {d.json('props', 'missing')} is null as lacks from usage"


@both("pth05_glob_to_regex", "texts")
def _(d):
    from lithic.operators.rules import glob_pattern

    globs = ["**/*.js", "shop/*", "src1/**", "**/en/**", "*.txt", "shop/lib/**/app.js", "a/**/b/**/c/**/d/**/e"]
    return "select path, " + ", ".join(f"{d.rlike('path', glob_pattern(g))} as g{i}" for i, g in enumerate(globs)) + " from texts"
