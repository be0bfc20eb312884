"""One text of a query for two engines: what their SQL spells differently is asked of a dialect."""

from __future__ import annotations


def _q(s: str) -> str:
    return s.replace("'", "''")


class Spark:
    """Spark SQL; patterns are raw strings, so backslashes stay."""

    name = "spark"

    def lit(self, s: str) -> str:
        if "${" in s:  # else taken for a variable
            return " || ".join(self.lit(x) for x in s.replace("${", "$\0{").split("\0"))
        return "r'" + s + "'" if "'" not in s else "'" + s.replace(chr(92), chr(92) * 2).replace("'", chr(92) + "'") + "'"

    def rlike(self, x: str, pattern: str) -> str:
        return f"({x} rlike {self.lit(pattern)})"

    def extract(self, x: str, pattern: str, group: int = 1) -> str:
        return f"regexp_extract({x}, {self.lit(pattern)}, {group})"

    def extract_all(self, x: str, pattern: str, group: int = 1) -> str:
        return f"regexp_extract_all({x}, {self.lit(pattern)}, {group})"

    def replace(self, x: str, pattern: str, to: str) -> str:
        return f"regexp_replace({x}, {self.lit(pattern)}, {self.lit(to)})"

    def split(self, x: str, sep: str) -> str:
        return f"split({x}, {self.lit('[' + sep + ']')}, -1)"

    def size(self, x: str) -> str:
        return f"cast(size({x}) as bigint)"

    def item(self, x: str, i: str) -> str:
        """The i-th element, from 1; null beyond the end."""
        return f"try_element_at({x}, cast({i} as int))"

    def has(self, x: str, v: str) -> str:
        return f"array_contains({x}, {v})"

    def join(self, x: str, sep: str) -> str:
        return f"array_join({x}, '{sep}')"

    def sorted(self, x: str) -> str:
        return f"array_sort(collect_list({x}))"

    def sorted_set(self, x: str) -> str:
        return f"array_sort(collect_set({x}))"

    def each(self, table: str, x: str, cols: str, keep: str = "*", where: str = "true") -> str:
        """Rows of table with each element of the list x, as cols = 'place element', place from 1."""
        p, e = cols.split()
        return f"(select {keep}, cast({p}_ + 1 as bigint) as {p}, {e} from {table} lateral view posexplode({x}) t_ as {p}_, {e} where {where})"

    def span(self, a: str, b: str) -> str:
        return f"sequence({a}, {b})"

    def sha(self, x: str) -> str:
        return f"sha2({x}, 256)"

    def json(self, x: str, key: str) -> str:
        return f"get_json_object({x}, '$.{key}')"

    def trim(self, x: str) -> str:
        return self.replace(x, r"^[ \t\n\r\f]+|[ \t\n\r\f]+$", "")

    def map(self, x: str, v: str, body: str) -> str:
        return f"transform({x}, {v} -> {body})"

    def keep(self, x: str, v: str, body: str) -> str:
        return f"filter({x}, {v} -> {body})"

    def list(self, *xs: str) -> str:
        return f"array({', '.join(xs)})"

    def slice(self, x: str, a: str, n: str) -> str:
        return f"slice({x}, {a}, {n})"

    def intersect(self, a: str, b: str) -> str:
        return f"array_intersect({a}, {b})"

    def unite(self, a: str, b: str) -> str:
        return f"array_union({a}, {b})"

    def distinct(self, x: str) -> str:
        return f"array_distinct({x})"

    def seconds(self, ts: str) -> str:
        return f"unix_micros(cast({ts} as timestamp)) / 1000000.0D"

    def hour(self, ts: str) -> str:
        return f"cast(date_trunc('hour', {ts}) as string)"

    def days(self, a: str, b: str) -> str:
        return f"cast(datediff({a}, {b}) as bigint)"

    def table(self, cols: str, rows: list[tuple]) -> str:
        show = lambda v: "null" if v is None else str(v).lower() if isinstance(v, bool) else str(v) if isinstance(v, (int, float)) else self.lit(v) if "\n" not in v else " || ".join("'" + x.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n") + "'" for x in v.replace("${", "$\0{").split("\0"))
        return f"(select * from values {', '.join('(' + ', '.join(map(show, r)) + ')' for r in rows)} as v_({cols}))"

    def count(self, x: str, pattern: str) -> str:
        return f"cast(regexp_count({x}, {self.lit(pattern)}) as bigint)"

    def fold(self, x: str, start: str, names: str, body: str) -> str:
        """body of (what is there, element) over the list x, from start on; names = 'so_far element'."""
        a, b = names.split()
        return f"aggregate({x}, {start}, ({a}, {b}) -> {body})"

    def nth(self, x: str, sep: str, i: int) -> str:
        """The i-th part, from 1, of x as cut at a character; '' beyond the end."""
        return f"split_part({x}, '{sep}', {i})"


class Duck(Spark):
    name = "duck"

    def lit(self, s: str) -> str:
        return "'" + _q(s) + "'"

    def rlike(self, x: str, pattern: str) -> str:
        return f"regexp_matches({x}, {self.lit(pattern)})"

    def extract_all(self, x: str, pattern: str, group: int = 1) -> str:
        return f"list_transform(regexp_extract_all({x}, {self.lit(pattern)}, {group}), lambda g_: coalesce(g_, ''))"

    def replace(self, x: str, pattern: str, to: str) -> str:
        return f"regexp_replace({x}, {self.lit(pattern)}, {self.lit(to.replace('$', chr(92)))}, 'g')"

    def split(self, x: str, sep: str) -> str:
        sep = {"\\n": "chr(10)", "\\\\": "chr(92)"}.get(sep) or self.lit(sep)
        return f"string_split({x}, {sep})"

    def size(self, x: str) -> str:
        return f"len({x})::bigint"

    def item(self, x: str, i: str) -> str:
        return f"({x})[{i}]"

    def has(self, x: str, v: str) -> str:
        return f"list_contains({x}, {v})"

    def join(self, x: str, sep: str) -> str:
        return f"array_to_string({x}, '{sep}')"

    def sorted(self, x: str) -> str:
        return f"list_sort(list({x}))"

    def sorted_set(self, x: str) -> str:
        return f"list_sort(list(distinct {x}))"

    def each(self, table: str, x: str, cols: str, keep: str = "*", where: str = "true") -> str:
        p, e = cols.split()
        return f"(select * from (select {keep}, generate_subscripts({x}, 1)::bigint as {p}, unnest({x}) as {e} from {table}) u_ where {where})"

    def span(self, a: str, b: str) -> str:
        return f"range({a}, {b} + 1)"

    def sha(self, x: str) -> str:
        return f"sha256({x})"

    def json(self, x: str, key: str) -> str:
        return f"json_extract_string({x}, '$.{key}')"

    def map(self, x: str, v: str, body: str) -> str:
        return f"list_transform({x}, lambda {v}: {body})"

    def keep(self, x: str, v: str, body: str) -> str:
        return f"list_filter({x}, lambda {v}: {body})"

    def list(self, *xs: str) -> str:
        return f"[{', '.join(xs)}]"

    def slice(self, x: str, a: str, n: str) -> str:
        return f"({x})[{a}:({a}) + ({n}) - 1]"

    def intersect(self, a: str, b: str) -> str:
        return f"list_intersect({a}, {b})"

    def unite(self, a: str, b: str) -> str:
        return f"list_distinct(list_concat({a}, {b}))"

    def distinct(self, x: str) -> str:
        return f"list_distinct({x})"

    def seconds(self, ts: str) -> str:
        return f"epoch_us({ts}::timestamp) / 1000000.0::double"

    def hour(self, ts: str) -> str:
        return f"strftime(date_trunc('hour', {ts}), '%Y-%m-%d %H:%M:%S')"

    def days(self, a: str, b: str) -> str:
        return f"date_diff('day', {b}::date, {a}::date)::bigint"

    def table(self, cols: str, rows: list[tuple]) -> str:
        show = lambda v: "null" if v is None else str(v).lower() if isinstance(v, bool) else str(v) if isinstance(v, (int, float)) else "'" + _q(v) + "'"
        return f"(select * from (values {', '.join('(' + ', '.join(map(show, r)) + ')' for r in rows)}) as v_({cols}))"

    def count(self, x: str, pattern: str) -> str:
        return f"len(regexp_extract_all({x}, {self.lit(pattern)}))::bigint"

    def fold(self, x: str, start: str, names: str, body: str) -> str:
        a, b = names.split()
        return f"list_reduce({x}, lambda {a}, {b}: {body}, {start})"


SPARK, DUCK = Spark(), Duck()
