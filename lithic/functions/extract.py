"""Symbols and references of source files: one file in, rows out; Spark spreads the files.

Python is read by the standard parser. Other languages are read by a scanner that first blanks out strings and comments
(line numbers stay), then finds definitions by a table of patterns and their ends by matching braces. The contract is
this module's own: symbols are function, class, method, variable, interface or type; references are call, import, use
or assign.
"""

from __future__ import annotations

import ast
import math
import re
from typing import NamedTuple


class Symbol(NamedTuple):
    name: str
    kind: str
    start_line: int
    end_line: int


class Ref(NamedTuple):
    kind: str
    name: str
    line: int
    module: str


class Extract(NamedTuple):
    symbols: list[Symbol]
    refs: list[Ref]
    has_errors: bool


LANGUAGES = {"py": "python", "js": "javascript", "mjs": "javascript", "cjs": "javascript", "jsx": "javascript", "ts": "typescript", "tsx": "typescript", "go": "go", "rs": "rust", "c": "c", "h": "c", "cpp": "cpp", "cc": "cpp", "hpp": "cpp", "java": "java", "sh": "bash", "bash": "bash"}

_NAME = r"([A-Za-z_$][\w$]*)"
#: A pair of parentheses with what stands between, three deep.
_PARENS = r"\((?:[^()]|\((?:[^()]|\([^()]*\))*\))*\)"
#: (kind, pattern, whether a body in braces follows); a function inside a class or impl is a method.
DEFINITIONS = {
    "javascript": [
        ("function", rf"^\s*(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s*\*?\s*{_NAME}", True),
        ("class", rf"^\s*(?:export\s+)?(?:default\s+)?(?:abstract\s+)?class\s+{_NAME}", True),
        ("interface", rf"^\s*(?:export\s+)?interface\s+{_NAME}", True),
        ("type", rf"^\s*(?:export\s+)?type\s+{_NAME}\s*(?:<[^>]*>)?\s*=", False),
        ("class", rf"^\s*(?:export\s+)?(?:const\s+)?enum\s+{_NAME}", True),
        ("variable", rf"^(?:export\s+)?(?:const|let|var)\s+{_NAME}", False),
        ("method", rf"^\s+(?:static\s+|async\s+|get\s+|set\s+|public\s+|private\s+|protected\s+|readonly\s+)*\*?{_NAME}\s*{_PARENS}\s*(?::\s*[^{{;]+)?{{", True),
    ],
    "go": [
        ("method", rf"^func\s+\([^)]*\)\s*{_NAME}", True),
        ("function", rf"^func\s+{_NAME}", True),
        ("type", rf"^type\s+{_NAME}", True),
        ("variable", rf"^\s*var\s+{_NAME}", False),
        ("variable", rf"(?:^\s*|(?<=,)\s*){_NAME}\s*(?=(?:,\s*\w+\s*)*:=)", False),
    ],
    "rust": [
        ("function", rf"^\s*(?:pub(?:\([^)]*\))?\s+)?(?:async\s+|const\s+|unsafe\s+)*fn\s+{_NAME}", True),
        ("class", rf"^\s*(?:pub(?:\([^)]*\))?\s+)?(?:struct|enum)\s+{_NAME}", True),
        ("interface", rf"^\s*(?:pub(?:\([^)]*\))?\s+)?trait\s+{_NAME}", True),
        ("variable", rf"^\s*let\s+(?:mut\s+)?{_NAME}", False),
    ],
    "c": [
        ("type", rf"^\s*typedef\b.*?{_NAME}\s*;", False),
        ("class", rf"^\s*(?:struct|enum)\s+{_NAME}\s*{{", True),
        ("type", rf"^\s*union\s+{_NAME}\s*{{", True),
        ("variable", rf"^\s*#\s*define\s+{_NAME}", False),
        ("function", rf"^(?:[A-Za-z_][\w\s*]*?[\s*]){_NAME}\s*{_PARENS}\s*{{", True),
        ("variable", rf"^(?:static\s+|const\s+|unsigned\s+)*(?:int|char|long|float|double|size_t|bool)\s+\**{_NAME}\s*(?:=|;|\[)", False),
    ],
    "java": [
        ("class", rf"^\s*(?:public\s+|private\s+|protected\s+|static\s+|final\s+|abstract\s+)*(?:class|record|enum)\s+{_NAME}", True),
        ("interface", rf"^\s*(?:public\s+|private\s+)*interface\s+{_NAME}", True),
        ("type", rf"^\s*(?:public\s+)?@interface\s+{_NAME}", True),
        ("method", rf"^\s+(?:public\s+|private\s+|protected\s+|static\s+|final\s+|synchronized\s+)*(?:[\w<>\[\], ]+\s+)?{_NAME}\s*{_PARENS}\s*(?:throws\s+[\w., ]+)?{{", True),
        ("variable", rf"^\s+(?:public\s+|private\s+|protected\s+|static\s+|final\s+)*(?:int|long|double|boolean|String|var|List<\w+>)\s+{_NAME}\s*[=;]", False),
    ],
    "bash": [
        ("function", rf"^\s*function\s+{_NAME}", True),
        ("function", rf"^\s*{_NAME}\s*\(\)\s*{{", True),
        ("variable", rf"^\s*(?:export\s+|local\s+|readonly\s+)?{_NAME}=", False),
    ],
}
DEFINITIONS["typescript"] = DEFINITIONS["javascript"]
DEFINITIONS["cpp"] = [
    ("class", rf"^\s*class\s+{_NAME}", True),
    ("method", rf"^[A-Za-z_][\w:<>*&\s]*?\b\w+::{_NAME}\s*{_PARENS}[\w\s]*{{", True),
    ("member", rf"^[ \t]+(?:[A-Za-z_][\w:<>,*& \t]*[ \t*&])?{_NAME}\s*{_PARENS}[\w \t]*{{", True),
    *DEFINITIONS["c"],
]

IMPORTS = {
    "javascript": [r"\bimport\s+(?:[^'\"`;]*?\sfrom\s+)?['\"]([^'\"]+)['\"]", r"\brequire\(\s*['\"]([^'\"]+)['\"]", r"\bimport\(\s*['\"]([^'\"]+)['\"]"],
    "go": [r"^\s*import\s+(?:\w+\s+)?\"([^\"]+)\"", r"^\s+(?:\w+\s+)?\"([^\"]+)\"\s*$"],
    "rust": [r"^\s*(?:pub(?:\([^)]*\))?\s+)?use\s+([^;]+);"],
    "c": [r"^\s*#\s*include\s*[<\"]([^>\"]+)[>\"]"],
    "java": [r"^\s*import\s+(?:static\s+)?([\w.]+)"],
    "bash": [r"^\s*(?:source|\.)\s+([^\s;]+)"],
}
IMPORTS["typescript"], IMPORTS["cpp"] = IMPORTS["javascript"], IMPORTS["c"]

# Words before a parenthesis that call nothing, and that name nothing.
_SHARED = "if for while switch catch return sizeof do else case throw try"
KEYWORDS = {
    "javascript": "function class new typeof await async super this of in with yield delete void import export let const var",
    "go": "func go defer select import type var const struct interface map chan range package fallthrough make len cap append panic recover close delete copy",
    "rust": "fn match loop unsafe pub impl where use mod in as move ref mut self Self super crate await struct enum trait let static const dyn",
    "c": "struct enum union typedef static const defined",
    "java": "new super this synchronized class interface enum record throws instanceof",
    "bash": "",
}
KEYWORDS = {k: frozenset(f"{_SHARED} {v}".split()) for k, v in KEYWORDS.items()}
KEYWORDS["typescript"], KEYWORDS["cpp"] = KEYWORDS["javascript"], KEYWORDS["c"] | frozenset("class new delete template namespace using operator public private protected virtual noexcept decltype".split())
# Calls that say nothing about a program's own structure.
NOISE = {
    "rust": "Ok Err Some None map map_err map_or map_or_else and_then or or_else or_default unwrap unwrap_or unwrap_or_else unwrap_or_default unwrap_unchecked expect ok_or ok_or_else filter filter_map flat_map flatten fold fold_first collect copied cloned enumerate zip chain rev take take_while skip skip_while position rposition find find_map any all count sum product min max min_by max_by min_by_key max_by_key sort sort_by sort_by_key sort_unstable sort_unstable_by sort_by_cached_key dedup dedup_by partition inspect for_each nth nth_back next next_back peekable fuse by_ref step_by cycle intersperse reduce scan take_last is_sorted is_sorted_by into as_str as_bytes as_mut as_ref as_deref as_deref_mut as_slice as_mut_slice to_string to_owned to_vec to_ascii_lowercase to_ascii_uppercase to_lowercase to_uppercase try_into try_from into_iter iter iter_mut chars bytes lines from_utf8 from_utf8_lossy from_str as_os_str as_path to_path_buf to_str len is_empty capacity push push_str pop insert insert_str remove swap_remove contains get get_mut get_key_value first last clear retain retain_mut drain extend extend_from_slice with_capacity entry or_insert or_insert_with or_insert_with_key split split_whitespace split_terminator split_ascii_whitespace rsplit splitn rsplitn match_indices matches trim trim_start trim_end trim_matches trim_start_matches trim_end_matches replace replacen starts_with ends_with parse is_ascii reserve reserve_exact shrink_to_fit shrink_to truncate resize resize_with fill fill_with copy_from_slice clone_from_slice windows chunks chunks_exact chunks_mut rchunks rchunks_exact split_first split_last split_at split_at_mut join concat repeat escape_default escape_unicode strip_prefix strip_suffix get_or_insert get_or_insert_with clone drop forget swap transmute size_of align_of type_name hash eq ne cmp partial_cmp is_some is_none is_ok is_err write write_all read read_to_string read_exact flush lock stdin stdout stderr create_dir_all remove_file",
    "c": "printf fprintf sprintf snprintf vprintf vfprintf vsprintf vsnprintf puts putchar fputs fputc getchar getc fgetc gets fgets scanf fscanf sscanf perror fwrite fread fopen fclose fflush feof ferror fseek ftell rewind remove rename tmpfile setbuf setvbuf malloc calloc realloc free memcpy memmove memset memcmp memchr strlen strcpy strncpy strcat strncat strcmp strncmp strchr strrchr strstr strtok strdup atoi atol atoll atof strtol strtoul strtod exit abort assert rand srand time clock abs labs llabs pow sqrt floor ceil fabs fmod log log10 exp sin cos tan isdigit isalpha isalnum isspace tolower toupper sizeof",
    "java": "System.out.println System.out.print System.out.printf System.err.println System.err.print System.err.printf printStackTrace toString hashCode equals notify notifyAll wait getClass clone finalize Integer.parseInt Long.parseLong Double.parseDouble Float.parseFloat Boolean.parseBoolean String.valueOf String.format String.join Math.max Math.min Math.abs Math.pow Math.sqrt Math.floor Math.ceil Math.round Math.random Arrays.asList Arrays.sort Arrays.copyOf Collections.sort Collections.emptyList Optional.of Optional.ofNullable Objects.requireNonNull Objects.equals Objects.hash List.of Set.of Map.of ArrayList HashMap HashSet add get set remove size isEmpty contains stream forEach map filter collect orElse orElseGet orElseThrow length charAt substring split trim toUpperCase toLowerCase startsWith endsWith containsKey containsValue put keySet entrySet values append getMessage getCause",
    "bash": "echo printf cd pwd ls dir mkdir rmdir rm cp mv touch cat more less head tail grep egrep fgrep sed awk cut sort uniq wc tr diff patch tar gzip gunzip bzip2 xz unzip zip make cmake gcc g++ clang cc python python3 node npm npx yarn pnpm go rustc cargo java javac ssh scp curl wget exit return export read test true false exec shift set unset declare local readonly trap source . eval let case in esac done fi then else elif for while until if do function break continue sudo apt apt-get yum dnf pip pip3 git find xargs chmod chown chgrp ln stat du df free top ps kill sleep date basename dirname realpath readlink which whereis env nohup bg fg jobs ulimit umask hash command type killall pkill pgrep id whoami hostname uname uptime wait",
}
NOISE = {k: frozenset(v.split()) for k, v in NOISE.items()}
NOISE["cpp"] = NOISE["c"] | frozenset("std::cout std::cerr std::clog std::endl std::flush std::cin std::getline std::make_shared std::make_unique std::move std::swap std::sort std::vector std::map std::set std::string std::to_string new delete std::min std::max std::abs std::begin std::end std::find std::copy".split())


def _literals(lang: str) -> re.Pattern:
    """Comments and string literals of a language; what a template literal computes is no part of it."""
    comment = {"python": r"#[^\n]*", "bash": r"(?:(?<=[ \t\n;])|(?<![\s\S]))#[^\n]*"}.get(lang, r"//[^\n]*|/\*.*?(?:\*/|\Z)")
    triple = '"""(?:\\\\.|.)*?(?:"""|\\Z)|\'\'\'(?:\\\\.|.)*?(?:\'\'\'|\\Z)|' if lang == "python" else ""
    single = r"'(?:\\[^\n]|[^\\'\n])'" if lang == "rust" else r"'(?:\\[\s\S]|[^'\\\n])*'?"
    return re.compile(triple + comment + r'|"(?:\\[\s\S]|[^"\\\n])*"?|' + single + r"|`(?:\\[\s\S]|\$\{(?:[^{}]|\{[^{}]*\})*\}|[^`\\])*`?", re.S)


_LITERALS = {lang: _literals(lang) for lang in {*LANGUAGES.values(), "other"}}
_COMPUTED = re.compile(r"\$\{(?:[^{}]|\{[^{}]*\})*\}")
_SHOWN = re.compile(r"[^\n]")


def _blank(m: re.Match) -> str:
    text = m[0]
    if text[0] not in "\"'`":
        return _SHOWN.sub(" ", text)
    n = 3 if text[:3] in ('"' * 3, "'" * 3) else 1
    end = len(text) - n if len(text) >= 2 * n and text.endswith(text[:n]) else len(text)
    inner, at, out = text[n:end], 0, [text[:n]]
    for c in _COMPUTED.finditer(inner) if text[0] == "`" else ():
        out += (_SHOWN.sub(" ", inner[at : c.start()]), c[0])
        at = c.end()
    return "".join([*out, _SHOWN.sub(" ", inner[at:]), text[end:]])


def strip(source: str, lang: str) -> str:
    """Source with strings and comments blanked, line by line as long as before; expressions in templates stay."""
    return _LITERALS.get(lang, _LITERALS["other"]).sub(_blank, source)


def _ends(text: str) -> dict[int, int]:
    """Offset of each opening brace -> offset of its closing one; what never closes ends with the text."""
    out, stack = {}, []
    for m in re.finditer(r"[{}]", text):
        if m[0] == "{":
            stack.append(m.start())
        elif stack:
            out[stack.pop()] = m.start()
    return out | {i: len(text) - 1 for i in stack}


def _after_parens(text: str, at: int) -> int:
    """The end of the parentheses that open next, or at itself if something else comes first."""
    while at < len(text) and text[at] not in "({;\n=":
        at += 1
    if at >= len(text) or text[at] != "(":
        return at
    depth = 0
    for m in re.finditer(r"[()]", text[at:]):
        depth += 1 if m[0] == "(" else -1
        if not depth:
            return at + m.end()
    return at


def rust_uses(clause: str) -> list[str]:
    """The paths that a use clause names; aliases are left out, as are globs."""
    clause, out, depth, part = clause.strip(), [], 0, ""
    at = clause.find("{")
    if at < 0:
        path = re.sub(r"\s+as\s+\w+$", "", clause).strip()
        return [] if not path or path.endswith("*") else [path]
    for c in clause[at + 1 : clause.rfind("}")] + ",":
        depth += {"{": 1, "}": -1}.get(c, 0)
        if c == "," and not depth:
            out += [clause[:at].strip() + x if x != "self" else clause[:at].strip().removesuffix("::") for x in rust_uses(part)]
            part = ""
        else:
            part += c
    return out


def clean_call(name: str) -> str | None:
    """A callee's name as it is kept: known characters only, at most 200 of them."""
    return name if len(name) <= 200 and re.fullmatch(r"[\w$.?\[\]:]+", name) else None


def scan(source: str, lang: str) -> Extract:
    text = strip(source, lang)
    line_of, starts = {}, [0]
    for m in re.finditer("\n", text):
        starts.append(m.end())
    ends = _ends(text)

    def line(at: int) -> int:
        lo, hi = 0, len(starts)
        while lo + 1 < hi:
            mid = (lo + hi) // 2
            lo, hi = (mid, hi) if starts[mid] <= at else (lo, mid)
        return lo + 1

    found: dict[int, tuple[int, Symbol]] = {}
    for kind, pattern, body in DEFINITIONS[lang]:
        for m in re.finditer(pattern, text, re.M):
            name, first = m[1], line(m.start(1))
            if name in KEYWORDS[lang] or m.start(1) in found:
                continue
            last = first
            if body:
                at = _after_parens(text, m.end(1)) if kind in ("function", "method", "member") else m.end(1)
                brace, stop = text.find("{", at), text.find(";", at)
                if brace >= 0 and not (0 <= stop < brace):
                    last = line(ends[brace])
            found[m.start(1)] = (m.start(1), Symbol(name, kind, first, last))
    if lang in ("javascript", "typescript"):
        for m in re.finditer(r"^(?:export\s+)?(?:const|let|var)\s+([{\[][^=;]*[}\]])\s*=", text, re.M):
            for name in binding_names(m[1]):
                at = m.start(1) + re.search(rf"(?<![\w$]){re.escape(name)}(?![\w$]|\s*:)", m[1]).start()
                found[at] = (at, Symbol(name, "variable", line(at), line(at)))
    owners = [s for _, s in found.values() if s.kind in ("class", "interface")]
    impls = [(line(m.start()), line(ends.get(text.find("{", m.start()), m.end()))) for m in re.finditer(r"^\s*impl\b[^{;]*{", text, re.M)] if lang == "rust" else []
    spans = [(s.start_line, s.end_line) for s in owners] + impls
    inside = lambda s: any(a < s.start_line and s.end_line <= b for a, b in spans)
    symbols = []
    for _, s in sorted(found.values()):
        if s.kind == "function" and inside(s):
            s = s._replace(kind="method")
        elif s.kind == "member":
            if not inside(s):
                continue
            s = s._replace(kind="method")
        elif s.kind == "method" and lang in ("javascript", "typescript") and not inside(s):
            continue
        elif s.kind == "variable" and lang == "cpp" and inside(s):
            continue
        symbols.append(s)
    refs: list[Ref] = []
    for pattern in IMPORTS[lang]:
        for m in re.finditer(pattern, source, re.M):
            if text[m.start() : m.end()].strip():  # not in a comment
                for path in rust_uses(m[1]) if lang == "rust" else [m[1]]:
                    refs.append(Ref("import", path, line(m.start(1)), path))
    places, bodies = set(found), [(s.start_line, s.end_line) for s in symbols if s.kind in ("function", "method")]
    if lang == "bash":
        for m in re.finditer(r"(?:^|[;&|]\s*|\$\()\s*([A-Za-z_][\w-]*)(?=\s|$|\))(?!\s*\(\))", text, re.M):
            if m[1] not in NOISE["bash"] and m.start(1) not in places:
                refs.append(Ref("call", m[1], line(m.start(1)), ""))
    else:
        for m in re.finditer(r"(?<![\w$.:])((?:new\s+)?[A-Za-z_$][\w$]*(?:(?:\.|::|\?\.)[A-Za-z_$][\w$]*)*)\s*!?\(", text):
            name = re.sub(r"^new\s+", "", m[1])
            last = re.split(r"\.|::", name)[-1]
            if last in KEYWORDS[lang] or last in NOISE.get(lang, ()) or name in NOISE.get(lang, ()) or any(m.start(1) <= p < m.end(1) for p in places) or re.search(r"\b(?:function|fn|func|class)\s*\*?\s*$", text[: m.start(1)][-20:]):
                continue
            if clean_call(name) and (lang != "go" or any(a <= line(m.start(1)) <= b for a, b in bodies)):
                refs.append(Ref("call", name, line(m.start(1)), ""))
        for m in re.finditer(r"\)\s*\??\.\s*([A-Za-z_$][\w$]*)\s*\(", text) if lang in ("java", "rust", "cpp", "go") else ():  # calls on what a call gave
            if m[1] not in NOISE.get(lang, ()):
                refs.append(Ref("call", m[1], line(m.start(1)), ""))
        top = {s.name for s in symbols if s.kind == "variable"} if lang in ("javascript", "typescript") else set()
        for m in re.finditer(r"(?<![\w$.])([A-Za-z_$][\w$]*)\b(?!\s*[(:])", text):
            if m[1] in top and m.start(1) not in places:
                assigned = re.match(r"\s*(?:[-+*/|&]?=)(?!=)", text[m.end() :])
                refs.append(Ref("assign" if assigned else "use", m[1], line(m.start(1)), ""))
    line_of.clear()
    balanced = all(text.count(a) == text.count(b) for a, b in ("{}", "()", "[]"))
    return Extract(symbols, sorted(set(refs), key=lambda r: (r.line, r.kind, r.name)), not balanced)


def _callee(node: ast.expr) -> str | None:
    try:
        return clean_call(ast.unparse(node))
    except RecursionError:
        return None


def python(source: str) -> Extract:
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError, RecursionError):
        got = [Symbol(m[2], "class" if m[1] == "class" else "function", source[: m.start()].count("\n") + 1, source[: m.start()].count("\n") + 1) for m in re.finditer(r"^\s*(def|class)\s+(\w+)", source, re.M)]
        return Extract(got, [], True)
    symbols, refs, top = [], [], set()

    def targets(t: ast.expr):
        if isinstance(t, (ast.Tuple, ast.List)):
            for x in t.elts:
                yield from targets(x)
        elif isinstance(t, ast.Starred):
            yield from targets(t.value)
        else:
            while isinstance(t, (ast.Attribute, ast.Subscript)):
                t = t.value
            if isinstance(t, ast.Name):
                yield t.id

    stack: list[tuple[ast.AST, bool, int]] = [(tree, False, 0)]
    while stack:
        node, in_class, depth = stack.pop()
        for child in ast.iter_child_nodes(node):
            if isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef)):
                symbols.append(Symbol(child.name, "method" if in_class else "function", child.lineno, child.end_lineno or child.lineno))
            elif isinstance(child, ast.ClassDef):
                symbols.append(Symbol(child.name, "class", child.lineno, child.end_lineno or child.lineno))
            elif isinstance(child, (ast.Assign, ast.AnnAssign, ast.AugAssign)):
                for t in child.targets if isinstance(child, ast.Assign) else [child.target]:
                    for name in targets(t):
                        symbols.append(Symbol(name, "variable", child.lineno, child.end_lineno or child.lineno))
                        if depth == 0:
                            top.add(name)
            elif isinstance(child, ast.Call) and (name := _callee(child.func)):
                refs.append(Ref("call", name, child.lineno, ""))
            elif isinstance(child, ast.Import):
                refs += [Ref("import", a.name, child.lineno, a.name) for a in child.names]
            elif isinstance(child, ast.ImportFrom):
                module = "." * child.level + (child.module or "")
                refs.append(Ref("import", module, child.lineno, module))
                refs += [Ref("import", a.name, child.lineno, module) for a in child.names]
            elif isinstance(child, ast.Name) and isinstance(child.ctx, ast.Load):
                refs.append(Ref("use", child.id, child.lineno, ""))
            stack.append((child, isinstance(child, ast.ClassDef), depth + isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef))))
    refs = [r for r in refs if r.kind != "use" or r.name in top]
    return Extract(sorted(symbols, key=lambda s: (s.start_line, s.name)), sorted(set(refs), key=lambda r: (r.line, r.kind, r.name)), False)


def language_of(path: str) -> str:
    return LANGUAGES.get(path.rsplit(".", 1)[-1].lower(), "other")


def extract(path: str, source: str | None) -> Extract:
    """Null and empty sources and unknown languages give no rows; files beyond 1 MB aren't read."""
    lang = language_of(path)
    if not source or lang == "other" or len(source) > 1 << 20:
        return Extract([], [], False)
    return python(source) if lang == "python" else scan(source, lang)


def constants(source: str) -> list[tuple[str, int]]:
    """Upper-case names assigned at the top of a Python file."""
    return [(m[1], source[: m.start()].count("\n") + 1) for m in re.finditer(r"^([A-Z][A-Z0-9_]*)\s*(?::[^=\n]+)?=(?!=)", source, re.M)]


def binding_names(pattern: str) -> list[str]:
    """Identifiers that a destructuring pattern binds."""
    inner = re.sub(r"=[^,}\]]+", "", pattern)
    inner = re.sub(r"[\w$]+\s*:\s*", "", inner)
    return re.findall(r"[A-Za-z_$][\w$]*", inner)


class Metrics(NamedTuple):
    cyclomatic: int
    cognitive: int
    max_nesting: int
    function_count: int
    class_count: int
    loc: int
    comment_ratio: float


def metrics(path: str, source: str) -> Metrics:
    lang = language_of(path)
    text = strip(source, lang)
    branch = re.compile(r"\b(?:if|elif|for|while|case|catch|except|match)\b|&&|\|\||\?(?![.:?])")
    depth = cyclomatic = cognitive = nesting = 0
    for raw in text.split("\n"):
        if lang == "python" and raw.strip():
            depth = (len(raw) - len(raw.lstrip())) // 4
        hits = len(branch.findall(raw))
        cyclomatic += hits
        cognitive += hits * (1 + max(0, depth - 1)) if hits else 0
        if lang != "python":
            depth = max(0, depth + raw.count("{") - raw.count("}"))
        nesting = max(nesting, depth)
    got = extract(path, source)
    lines = source.split("\n")
    comments = sum(bool(s.strip()) and not t.strip() for s, t in zip(lines, text.split("\n"), strict=True))
    kinds = [s.kind for s in got.symbols]
    return Metrics(1 + cyclomatic, cognitive, nesting, kinds.count("function") + kinds.count("method"), kinds.count("class"), sum(bool(x.strip()) for x in lines), math.floor(100 * comments / max(1, len(lines)) + 0.5) / 100)


class Node(NamedTuple):
    node_id: int
    parent_id: int | None
    depth: int
    node_type: str
    name: str | None
    start_line: int
    end_line: int


def outline_nodes(path: str, source: str, max_depth: int = 10) -> list[Node]:
    """The containment tree of a file's symbols as flat rows, cut at max_depth."""
    out, stack = [Node(0, None, 0, "file", path, 1, source.count("\n") + 1)], [0]
    for s in sorted(extract(path, source).symbols, key=lambda s: (s.start_line, -s.end_line, s.name)):
        while len(stack) > 1 and not (out[stack[-1]].start_line <= s.start_line and s.end_line <= out[stack[-1]].end_line):
            stack.pop()
        parent = out[stack[-1]]
        if parent.depth + 1 > max_depth:
            continue
        out.append(Node(len(out), parent.node_id, parent.depth + 1, s.kind, s.name[:100], s.start_line, s.end_line))
        if s.kind != "variable":
            stack.append(len(out) - 1)
    return out


def classify(message: str) -> tuple[bool, float, str, int]:
    """(has_code, code_ratio, primary_type, node_count) of a message: code lines against all, at most 1."""
    lines = [x for x in message.split("\n") if x.strip()]
    code = [x for x in lines if re.search(r"[;{}]\s*$|^\s*(?:def|class|function|import|from|const|let|var|return|if|for|while)\b.*[:;({]|=>|\w\(.*\)\s*[;:{]?\s*$", x)]
    ratio = min(1.0, len(code) / (0.3 * len(lines))) if lines else 0.0
    kind = "text" if not code else "code" if len(code) * 2 > len(lines) else "mixed"
    return bool(code), math.floor(ratio * 100 + 0.5) / 100, kind, len(lines)
