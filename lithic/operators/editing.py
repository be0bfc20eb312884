"""Edits as pure functions of texts, spread over files; and operators that need a state machine."""

from __future__ import annotations

import difflib
import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lithic.functions import extract as X
from lithic.plans.catalogue import query
from lithic.sources.relations import relation


def matches(text: str, old: str) -> list[int]:
    """Every place where old starts, overlapping ones too."""
    out, at = [], text.find(old) if old else -1
    while at >= 0:
        out.append(at)
        at = text.find(old, at + 1)
    return out


def lenient(text: str, old: str) -> list[tuple[int, int]]:
    """Spans that match old exactly, or else line by line without white space at line ends."""
    exact = matches(text, old)
    if exact or not old.strip():
        return [(a, a + len(old)) for a in exact]
    lines, wanted, out, at = text.split("\n"), [x.rstrip() for x in old.rstrip("\n").split("\n")], [], 0
    for i, line in enumerate(lines):
        if [x.rstrip() for x in lines[i : i + len(wanted)]] == wanted:
            out.append((at, at + len("\n".join(lines[i : i + len(wanted)]))))
        at += len(line) + 1
    return out


def batch_edit(text: str, edits: list[tuple[str, str, bool]], partial: bool = False) -> tuple[str, list[str], str]:
    """(new text, a status for each edit, unified diff). All edits match the original; edits are (old, new, all).

    A status other than matched leaves the text alone, unless partial; overlapping spans are conflicts.
    """
    if any(not old for old, _, _ in edits):
        return text, ["invalid"] * len(edits), ""
    status, spans = [], []
    for k, (old, new, every) in enumerate(edits):
        found = lenient(text, old)
        status.append("not_found" if not found else "ambiguous" if len(found) > 1 and not every else "matched")
        if status[-1] == "matched":
            spans += [(a, b, k, new) for a, b in found]
    spans.sort()
    for (a, b, k, _), (c, _, m, _) in zip(spans, spans[1:], strict=False):
        if c < b:
            status[m] = "conflict"
            if not partial:
                status[k] = "conflict"
    if not partial and any(s != "matched" for s in status):
        return text, status, ""
    out = text
    for a, b, k, new in reversed(spans):
        if status[k] == "matched":
            out = out[:a] + new + out[b:]
    diff = "\n".join(difflib.unified_diff(text.split("\n"), out.split("\n"), "before", "after", lineterm=""))
    return out, ["applied" if s == "matched" else s for s in status], diff


def suggestions(text: str, old: str, least: float = 0.5) -> list[tuple[int, float]]:
    """Lines that are like the first line of old, best first."""
    first = old.split("\n")[0]
    got = []
    for i, x in enumerate(text.split("\n"), 1):
        m = difflib.SequenceMatcher(None, first, x)
        if m.real_quick_ratio() > least and m.quick_ratio() > least:  # bounds from above, which spare long lines
            got.append((i, m.ratio()))
    return sorted(((i, round(r, 4)) for i, r in got if r > least), key=lambda x: (-x[1], x[0]))[:3]


BLOCK = re.compile(r"<{5,} SEARCH\n(.*?)\n?={5,}\n(.*?)\n?>{5,} REPLACE", re.S)


def search_replace(text: str, patch: str) -> tuple[str, list[str]]:
    """Applies SEARCH/REPLACE blocks: exactly, else with white space folded, else at the end."""
    how = []
    for old, new in BLOCK.findall(patch):
        if old and old in text:
            text = text.replace(old, new, 1)
            how.append("exact")
            continue
        fold = lambda s: " ".join(s.split())
        lines, n = text.split("\n"), old.count("\n") + 1
        at = next((i for i in range(len(lines)) if old.strip() and fold("\n".join(lines[i : i + n])) == fold(old)), None)
        if at is not None:
            text = "\n".join([*lines[:at], *new.split("\n"), *lines[at + n :]])
            how.append("fuzzy")
        else:
            text = text.rstrip("\n") + "\n" + new + "\n"
            how.append("appended")
    return text, how


def rename_in(source: str, path: str, old: str, new: str) -> list[tuple[int, str, str]]:
    """(line, before, after) where a name stands outside strings and comments. A file that imports the name under another
    one speaks of something else by it: there only the import changes."""
    shown = X.strip(source, X.language_of(path)).split("\n")
    aliased = re.compile(rf"(?<![\w$]){re.escape(old)}\s*(?:\bas\b|:)\s*[A-Za-z_$][\w$]*")
    is_import = re.compile(r"^\s*(?:import\b|from\b|(?:const|let|var)\s*\{)")
    restricted = any(is_import.match(x) and aliased.search(x) for x in shown)
    out = []
    for i, (raw, bare) in enumerate(zip(source.split("\n"), shown, strict=True), 1):
        at = [m.start() for m in re.finditer(rf"(?<![A-Za-z0-9_$]){re.escape(old)}(?![A-Za-z0-9_$])", bare)]
        if at and not (restricted and not (is_import.match(bare) and aliased.search(bare))):
            after = raw
            for a in reversed(at):
                after = after[:a] + new + after[a + len(old) :]
            out.append((i, raw, after))
    return out


REQUEST = "path string, seq int, symbol string, mode string, old string, new string, base_hash string"


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def located(content: str, path: str, name: str) -> tuple[str, int, int]:
    """(what came of it, first and last line) of a symbol: of several, the one of the weightiest kind."""
    kinds = {"class": 0, "function": 1, "method": 2, "interface": 3, "type": 4, "variable": 5}
    found = sorted((kinds.get(s.kind, 9), s.start_line, s.end_line) for s in X.extract(path, content).symbols if s.name == name)
    if not found:
        return "symbol_not_found", 0, 0
    if len(found) > 1 and found[0][0] == found[1][0]:
        return "ambiguous_symbol", 0, 0
    return "located", found[0][1], found[0][2]


def edited(body: str, mode: str, old: str, new: str) -> tuple[str, str]:
    """(outcome, new body) of one request on a symbol's lines: patch one place, replace all or all but the first line, or
    insert after. What is there already is done."""
    if mode == "patch":
        n = len(matches(body, old))
        if n == 1:
            return "written", body.replace(old, new, 1)
        return "ambiguous_match" if n else "already_applied" if new and new in body else "no_match", body
    first = body.split("\n", 1)[0]
    made = {"replace": new, "body": f"{first}\n{new}", "insert_after": f"{body}\n{new}"}.get(mode)
    if made is None:
        return "invalid_mode", body
    return ("already_applied" if made == body else "written"), made


def write_symbol(content: str, path: str, symbol: str, mode: str, old: str, new: str, base_hash: str | None = None) -> tuple[str, str, str]:
    """(outcome, the step that decided it, content). The steps: freshness, resolve, apply, validate, write; a file that was
    sound must stay so."""
    if base_hash and base_hash != sha(content):
        return "stale", "freshness", content
    how, first, last = located(content, path, symbol)
    if how != "located":
        return how, "resolve", content
    lines = content.split("\n")
    outcome, body = edited("\n".join(lines[first - 1 : last]), mode, old or "", new or "")
    if outcome != "written":
        return outcome, "apply", content
    made = "\n".join([*lines[: first - 1], body, *lines[last:]])
    if X.extract(path, made).has_errors and not X.extract(path, content).has_errors:
        return "invalid_result", "validate", content
    return "written", "write", made


def write_symbols(content: str, path: str, requests: list[tuple], strict: bool = True) -> tuple[list[tuple[int, str, str]], str]:
    """Requests (seq, symbol, mode, old, new, base_hash) one after another; symbols are found anew each time, so that places
    follow what was written before. All hold on to the content they began with: strict undoes all if one fails."""
    done, now = [], content
    for seq, symbol, mode, old, new, base in sorted(requests, key=lambda r: r[0]):
        if base and base != sha(content):
            outcome, step = "stale", "freshness"
        else:
            outcome, step, now = write_symbol(now, path, symbol, mode, old, new)
        done.append((seq, outcome, step))
    if strict and any(o not in ("written", "already_applied") for _, o, _ in done):
        return [(i, "rolled_back" if o == "written" else o, s) for i, o, s in done], content
    return done, now


def write_plan(files: DataFrame, requests: DataFrame, strict: bool = True) -> DataFrame:
    """files (path, content), requests as REQUEST. (path, seq, outcome, step, hash): a journal of what each request came to,
    with the hash of the file's content after all of them. A file's requests meet it by one equi-join."""
    names = [c.split()[0] for c in REQUEST.split(", ")][1:]
    asked = requests.groupBy("path").agg(F.collect_list(F.struct(*names)).alias("asked"))

    def apply(f):
        done, content = write_symbols(f.content or "", f.path, [tuple(r[n] for n in names) for r in f.asked], strict)
        return [(f.path, *d, sha(content)) for d in done]

    found = over_rows(files.join(asked, "path").select("path", "content", "asked"), apply, "path string, seq int, outcome string, step string, hash string")
    missing = asked.join(files.select("path"), "path", "left_anti").select("path", F.explode("asked").alias("a")).select("path", "a.seq", F.lit("file_not_found").alias("outcome"), F.lit("resolve").alias("step"), F.lit(None).cast("string").alias("hash"))
    return found.unionByName(missing)


def over_rows(df: DataFrame, fn, schema: str) -> DataFrame:
    """fn(row as a namedtuple) -> rows, batch by batch."""
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([r for row in b.itertuples(index=False) for r in fn(row)], columns=names)

    return df.mapInPandas(run, schema)


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that have content."""
    return relation(spark, sf_dir, "files").where("content is not null").select("path", "content")


@query("mut02_write_symbol")
def _(spark, source):
    """Requests on every symbol of a source's code: each function is patched where it returns."""
    from lithic.operators.extraction import sources_of, symbols

    files = sources_of(spark, source)
    named = symbols(files).where("kind in ('function', 'method')").select("path", F.col("start_line").alias("seq"), F.col("name").alias("symbol"))
    requests = named.select("path", "seq", "symbol", F.lit("patch").alias("mode"), F.lit("return").alias("old"), F.lit("return  ").alias("new"), F.lit(None).cast("string").alias("base_hash"))
    return write_plan(files, requests, strict=False)


@query("mut07_batch_edit")
def _(spark, sf_dir):
    def apply(f):
        lines = f.content.split("\n")
        body, status, diff = batch_edit(f.content, [(lines[0], "first", False), (lines[-1], "last", False), ("no such text", "x", False)], partial=True)
        yield f.path, "|".join(status), diff.count("\n"), len(body)

    return over_rows(_files(spark, sf_dir), apply, "path string, statuses string, diff_lines int, size int")


@query("str17_similar_lines")
def _(spark, sf_dir):
    return over_rows(_files(spark, sf_dir), lambda f: [(f.path, i, r) for i, r in suggestions(f.content, f.content[:80] + "x")], "path string, line int, ratio double")


@query("str20_search_replace")
def _(spark, sf_dir):
    patch = "<<<<<<< SEARCH\nThe and attion\n=======\nthe new words\n>>>>>>> REPLACE"

    def apply(f):
        text, how = search_replace(f.content, patch)
        yield f.path, ",".join(how), len(text)

    return over_rows(_files(spark, sf_dir), apply, "path string, how string, size int")


@query("str29_rename_outside_strings")
def _(spark, sf_dir):
    from lithic.operators.extraction import sources_of

    return over_rows(sources_of(spark, sf_dir), lambda f: [(f.path, *r) for r in rename_in(f.content, f.path, "x", "renamed")], "path string, line int, old string, new string")


@query("rul14_dry_run_brackets")
def _(spark, sf_dir):
    from lithic.operators.extraction import sources_of

    def balance(f):
        stack = []
        for i, c in enumerate(X.strip(f.content, X.language_of(f.path))):
            if c in "([{":
                stack.append(c)
            elif c in ")]}" and (not stack or "([{".index(stack.pop()) != ")]}".index(c)):
                return [(f.path, False, i)]
        return [(f.path, not stack, -1)]

    return over_rows(sources_of(spark, sf_dir), balance, "path string, balanced boolean, at int")


@query("top08_map_pages")
def _(spark, sf_dir):
    """A repository map: an entry for each directory, packed into pages, with what each page holds."""
    from lithic.operators.windows import pack

    rows = relation(spark, sf_dir, "symbols").where("type <> 'variable'").groupBy(F.substring_index("path", "/", 1).alias("top"), F.substring_index("path", "/", 2).alias("entry")).agg(F.sum(F.ceil((F.length("name") + 10) / 4)).cast("long").alias("tokens"), F.count("*").alias("n_symbols"))

    def pages(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("entry")
        return pdf.assign(page=pack(pdf.tokens.tolist(), 2000, 40))

    # pages are filled in order, within a folder at the top; its entries are folders, not files
    return rows.groupBy("top").applyInPandas(lambda pdf: pages(pdf[["top", "entry", "tokens", "n_symbols"]]), "top string, entry string, tokens long, n_symbols long, page long")
