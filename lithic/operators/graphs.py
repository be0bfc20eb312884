"""Graph operators: breadth-first callers, closures, cycles, containment, impact and risk.

Queries of a small fixed depth are one plan. ``bfs``, ``dependencies`` and ``indirect_callers`` are the forms for any
depth: a frontier joined to the edges, nodes seen before taken out, each level checkpointed, an end at the first empty
one. Cycles of any length are found within strongly connected parts.
"""

from __future__ import annotations

import tempfile
import uuid

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lithic.plans.catalogue import both, query
from lithic.plans.dialect import DUCK
from lithic.sources.relations import Source, relation, run, with_ctes

DEEPEST = 10
#: Edges that one task may search.
FEW = 200_000


def cut(df: DataFrame) -> DataFrame:
    """df without its lineage: checkpointed in the folder that the session's executors share. Only a local session may be
    without one, and gets a temporary folder; elsewhere other executors wouldn't see it."""
    _folder(df.sparkSession)
    return df.checkpoint()


def _folder(spark: SparkSession) -> str:
    if not spark.conf.get("spark.checkpoint.dir", None) and spark.sparkContext.getCheckpointDir() is None:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="lithic-"))
    return spark.sparkContext.getCheckpointDir()


def stored(df: DataFrame) -> DataFrame:
    """df written once beside the checkpoints, as Parquet: smaller on disk than they are, and its size is known to joins."""
    path = f"{_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def reached(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """edges (src, dst), starts (node). (node): all that one step or more lead to; a start only if some step leads back to it."""
    edges, level, seen = stored(edges.select("src", "dst")), starts.select("node").distinct(), None
    while True:
        step = edges.join(level, F.col("src") == F.col("node"), "left_semi").select(F.col("dst").alias("node")).distinct()
        level = stored(step if seen is None else step.join(seen, "node", "left_anti"))
        seen = level if seen is None else seen.union(level)
        if level.isEmpty():
            return seen


def bfs(edges: DataFrame, starts: DataFrame, depth: int) -> DataFrame:
    """edges (src, dst), starts (node). (node, depth): each node that dst -> src steps reach, at its least depth."""
    level = starts.select("node").distinct().withColumn("depth", F.lit(0))
    seen = level
    for k in range(1, depth + 1):
        step = edges.join(level.select(F.col("node").alias("dst")), "dst").select(F.col("src").alias("node")).distinct()
        level = cut(step.join(seen.select("node"), "node", "left_anti").withColumn("depth", F.lit(k)))
        if level.isEmpty():
            break
        seen = seen.unionByName(level)
    return seen


def dependencies(imports: DataFrame, roots: DataFrame, depth: int = 3) -> DataFrame:
    """imports (src, dst), roots (root). (root, src, dst, depth): every edge that a root's modules have, at its least depth,
    which is held between 1 and 10."""
    level = roots.select("root", F.col("root").alias("dst")).distinct()
    seen, out = level, None
    for k in range(1, min(DEEPEST, max(1, depth)) + 1):
        step = cut(level.withColumnRenamed("dst", "src").join(imports, "src").select("root", "src", "dst", F.lit(k).alias("depth")))
        if step.isEmpty():
            break
        out = step if out is None else out.union(step)
        level = cut(step.select("root", "dst").distinct().join(seen, ["root", "dst"], "left_anti"))
        seen = seen.union(level)
    return out if out is not None else level.withColumnRenamed("dst", "src").join(imports, "src").select("root", "src", "dst", F.lit(1).alias("depth"))


# Level 1 by name, without the definition's own file; later levels by resolved id. Every edge of a level is a row.
def indirect(symbol: int, depth: int = 3, own_file: bool = False) -> str:
    """The levels as CTEs; edges_k (caller, via) from the second on. For small depths: a level repeats those before it."""
    elsewhere = "" if own_file else f"where g.path <> (select path from functions where id = {symbol})"
    out = [f"level1 as (select distinct c.src as caller from calls c join functions f on f.id = c.dst join (select name from functions where id = {symbol}) n on n.name = f.name join functions g on g.id = c.src {elsewhere})"]
    for k in range(2, depth + 1):
        out.append(f"edges{k} as (select distinct c.src as caller, c.dst as via from calls c join level{k - 1} on c.dst = caller)")
        seen = " union ".join(f"select caller from level{j}" for j in range(1, k))
        out.append(f"level{k} as (select distinct l.caller from edges{k} l left join ({seen}) o on o.caller = l.caller where o.caller is null)")
    return ", ".join(out[: 2 * depth - 2])


def indirect_callers(spark: SparkSession, source: Source, symbol: int, depth: int = 3, own_file: bool = False) -> DataFrame:
    """(caller, via, depth) from the second level on, for any depth up to 10."""
    calls, functions = relation(spark, source, "calls").select("src", "dst"), relation(spark, source, "functions").select("id", "name", "path")
    target = functions.where(F.col("id") == symbol).select("name", F.col("path").alias("home"))
    named = calls.join(functions.join(F.broadcast(target), "name").select(F.col("id").alias("dst"), "home"), "dst").join(functions.select(F.col("id").alias("src"), "path"), "src")
    level = cut(named.where(F.lit(own_file) | (F.col("path") != F.col("home"))).select(F.col("src").alias("caller")).distinct())
    seen, out = level, spark.createDataFrame([], level.withColumn("via", F.col("caller")).withColumn("depth", F.lit(0)).schema)
    for k in range(2, min(DEEPEST, depth) + 1):
        edges = cut(calls.join(level.select(F.col("caller").alias("dst")), "dst").select(F.col("src").alias("caller"), F.col("dst").alias("via")).distinct().withColumn("depth", F.lit(k)))
        if edges.isEmpty():
            break
        out = out.union(edges)
        level = cut(edges.select("caller").distinct().join(seen, "caller", "left_anti"))
        seen = seen.union(level)
    return out


@both("grf01_indirect_callers", "calls", "functions")
def _(d):
    return f"with {indirect(7)} select caller, via, 2 as depth from edges2 union all select caller, via, 3 from edges3"


@query(
    "grf02_dependencies",
    with_ctes(
        """with recursive r as (select src as root, src, dst, 1 as depth from imports where src in (1, 4, 7) union all select r.root, i.src, i.dst, r.depth + 1 from (select distinct root, dst, depth from r) r join imports i on i.src = r.dst where r.depth < 3),
        first as (select root, dst, min(depth) as depth from r group by root, dst), seen as (select root, root as node, 1 as at from r union select root, dst, depth + 1 from first where dst <> root)
        select s.root, i.src, i.dst, s.at as depth from seen s join imports i on i.src = s.node where s.at <= 3""",
        DUCK,
        ("imports",),
    ),
)
def _(spark, source):
    """Of three modules, to the third level."""
    imports = relation(spark, source, "imports")
    return dependencies(imports, imports.where("src in (1, 4, 7)").select(F.col("src").alias("root")), 3)


@both("grf03_module_graph", "imports", "modules")
def _(d):
    return "select n.path as name, 'node' as kind, cast(null as varchar(20)) as target from modules n union all select a.path, 'edge', b.path from imports i join modules a on a.id = i.src join modules b on b.id = i.dst"


#: Modules of a cycle at most, in the query; edges of a part that one task may search.
LONGEST, SEARCHED = 8, 50_000


def elementary_cycles(edges: DataFrame, longest: int) -> DataFrame:
    """edges (src, dst). (length, cycle): each elementary cycle of at most so many nodes once, from its least node on.

    Which nodes begin a cycle is found first: those from which as many steps forward as half a cycle has, and as many back,
    over nodes above them, meet. Only their cycles are walked, over the edges between the nodes that their halves reached.
    There paths grow by an edge a round; how far back a node is from a start is found before, by as many rounds from all
    starts at once, so a path that can't close in time, or at all, isn't grown. Rows are as many as the halves reach and as
    there are paths that lead into cycles; a small graph is cut to its strongly connected parts by one task before.
    """
    inner = cut(edges.select("src", "dst").distinct())
    out = inner.where("src = dst").select(F.lit(1).cast("long").alias("length"), F.array("src").alias("cycle"))
    if longest < 2:
        return out
    steps = strong_parts(inner).select("src", "dst") if inner.count() <= FEW else inner
    steps = _around(steps.where("src <> dst"), longest)
    # (start, node, back): edges of the shortest way from node to start
    level = cut(steps.where("dst = start").select("start", F.col("src").alias("node")))
    back = level.withColumn("back", F.lit(1))
    for k in range(2, longest):
        met = level.join(steps.select("start", F.col("dst").alias("node"), "src"), ["start", "node"]).where("src > start").select("start", F.col("src").alias("node")).distinct()
        level = cut(met.join(back.select("start", "node"), ["start", "node"], "left_anti"))
        if level.isEmpty():
            break
        back = back.unionByName(level.withColumn("back", F.lit(k)))
    near = cut(back).select("start", F.col("node").alias("dst"), "back")
    paths = steps.where("src = start").select("start", "dst", F.array("src").alias("path"))
    for k in range(1, longest):
        # k edges lead to dst; back + k of a cycle
        paths = cut(paths.join(near, ["start", "dst"]).where(F.col("back") + k <= longest).select("start", F.col("dst").alias("src"), F.concat("path", F.array("dst")).alias("path")))
        if paths.isEmpty():
            break
        onward = paths.join(steps, ["start", "src"])
        out = out.union(onward.where("dst = start").select(F.lit(k + 1).cast("long").alias("length"), F.col("path").alias("cycle")))
        paths = onward.where((F.col("dst") > F.col("start")) & ~F.array_contains("path", F.col("dst"))).select("start", "dst", "path")
    return out


def _around(steps: DataFrame, longest: int) -> DataFrame:
    """steps (src, dst), without loops. (start, src, dst): for each node that is the least of a cycle of at most so many, the
    steps between it and the nodes above it that half such a cycle reaches, forward or back; all its cycles' steps are there."""

    def half(at: str, to: str, most: int) -> DataFrame:
        onward = steps.select(F.col(at).alias("node"), F.col(to).alias("next"))
        level = cut(onward.where("next > node").select(F.col("node").alias("start"), F.col("next").alias("node")))
        seen = level
        for _ in range(1, most):
            level = cut(level.join(onward, "node").where("next > start").select("start", F.col("next").alias("node")).distinct())
            seen = seen.union(level)
        return cut(seen.distinct())

    forward, back = half("src", "dst", longest - longest // 2), half("dst", "src", longest // 2)
    starts = cut(forward.join(back, ["start", "node"], "left_semi").select("start").distinct())
    nodes = cut(forward.union(back).join(starts, "start", "left_semi").union(starts.select("start", "start")).distinct())
    return cut(nodes.withColumnRenamed("node", "src").join(steps, "src").join(nodes.withColumnRenamed("node", "dst"), ["start", "dst"]).select("start", "src", "dst"))


@query(
    "grf04_cycles",
    with_ctes(
        f"""with recursive walk as (select src as start, dst, [src] as path from requires where dst >= src
            union all select w.start, r.dst, list_append(w.path, r.src) from walk w join requires r on r.src = w.dst where w.dst > w.start and r.dst >= w.start and not list_contains(w.path, r.src) and len(w.path) < {LONGEST})
        select len(path)::bigint as length, path as cycle from walk where dst = start""",
        DUCK,
        ("requires",),
    ),
)
def _(spark, source):
    """Elementary cycles of at most LONGEST modules, each from its least member on."""
    return elementary_cycles(relation(spark, source, "requires").select("src", "dst"), LONGEST)


def parts_of(edges: list[tuple]) -> dict:
    """node -> the least node of its strongly connected part, by one depth-first search."""
    graph: dict = {}
    for a, b in edges:
        graph.setdefault(a, []).append(b)
        graph.setdefault(b, [])
    number, low, on, open_, out = {}, {}, set(), [], {}
    for start in graph:
        if start in number:
            continue
        todo = [(start, iter(graph[start]))]
        number[start] = low[start] = len(number)
        open_.append(start)
        on.add(start)
        while todo:
            node, rest = todo[-1]
            for nxt in rest:
                if nxt not in number:
                    number[nxt] = low[nxt] = len(number)
                    open_.append(nxt)
                    on.add(nxt)
                    todo.append((nxt, iter(graph[nxt])))
                    break
                if nxt in on:
                    low[node] = min(low[node], number[nxt])
            else:
                todo.pop()
                if todo:
                    low[todo[-1][0]] = min(low[todo[-1][0]], low[node])
                if low[node] == number[node]:
                    part = []
                    while not part or part[-1] != node:
                        part.append(open_.pop())
                        on.discard(part[-1])
                    out.update(dict.fromkeys(part, min(part)))
    return out


def strong_parts(edges: DataFrame, few: int = FEW) -> DataFrame:
    """edges (src, dst). (part, src, dst): the edges that lie on cycles, by strongly connected part, which is named by its
    least node. Up to ``few`` edges, some megabytes, go through one task, which spares a small graph the rounds. Nodes without a way in or out go first; then edges go whose ends differ in the least node that reaches them
    or in the least that they reach. Once none goes, both are one node, which reaches its part and is reached by it."""
    now = cut(edges.select("src", "dst").distinct())
    before = now.count()
    kinds = {f.name: f.dataType.simpleString() for f in now.schema}
    if before <= few:

        def search(batches):
            rows = [r for b in batches for r in zip(b.src.tolist(), b.dst.tolist(), strict=True)]
            of = parts_of(rows)
            found = [(of[a], a, b) for a, b in rows if of[a] == of[b]]
            yield pd.DataFrame(found, columns=["part", "src", "dst"]) if found else pd.DataFrame({"part": [], "src": [], "dst": []})

        return cut(now.coalesce(1).mapInPandas(search, f"part {kinds['src']}, src {kinds['src']}, dst {kinds['dst']}"))
    while True:
        trimmed = now.join(now.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").join(now.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi")
        trimmed = cut(trimmed.select("src", "dst"))
        nodes = cut(trimmed.select(F.col("src").alias("node")).union(trimmed.select(F.col("dst").alias("node"))).distinct())
        marks = cut(_labels(trimmed, nodes, "src", "dst").join(_labels(trimmed, nodes, "dst", "src").withColumnRenamed("label", "back"), "node"))
        side = lambda at, name: marks.select(F.col("node").alias(at), F.struct("label", "back").alias(name))
        now = cut(trimmed.join(side("src", "a"), "src").join(side("dst", "b"), "dst").where("a = b").select(F.col("a.label").alias("part"), "src", "dst"))
        after = now.count()
        if after == before:
            return now
        before, now = after, now.select("src", "dst")


def _labels(edges: DataFrame, nodes: DataFrame, at: str, to: str) -> DataFrame:
    """(node, label): the least node that reaches each along the edges from at to to, itself included. A round takes the
    labels of neighbours, then each label's own label, which reaches it: so rounds grow as the logarithm of a way's length."""
    labels = nodes.withColumn("label", F.col("node"))
    while True:
        sent = edges.join(labels, F.col(at) == F.col("node")).groupBy(F.col(to).alias("node")).agg(F.min("label").alias("new"))
        stepped = cut(labels.join(sent, "node", "left").select("node", F.least("label", F.coalesce("new", "label")).alias("label"), F.coalesce(F.col("new") < F.col("label"), F.lit(False)).alias("changed")))
        far = stepped.select(F.col("node").alias("label"), F.col("label").alias("further"))
        after = cut(stepped.join(far, "label").select("node", F.least("label", "further").alias("label"), (F.col("changed") | (F.col("further") < F.col("label"))).alias("changed")))
        labels = after.select("node", "label")
        if after.where("changed").isEmpty():
            return labels


@query(
    "grf05_in_cycle",
    with_ctes("with recursive r as (select src, dst from imports union select r.src, i.dst from r join imports i on i.src = r.dst) select id as node, exists (select 1 from r where r.src = id and r.dst = id) as in_cycle from modules", DUCK, ("imports", "modules")),
)
def _(spark, source):
    """Whether a module reaches itself, over however many others."""
    inside = strong_parts(relation(spark, source, "imports")).select(F.col("src").alias("id")).distinct()
    modules = relation(spark, source, "modules").select("id")
    return modules.join(inside.withColumn("in_cycle", F.lit(True)), "id", "left").select(F.col("id").alias("node"), F.coalesce("in_cycle", F.lit(False)).alias("in_cycle"))


def back_edge_cycles(edges: list[tuple]) -> list[list]:
    """Cycles that a depth-first search from the least node finds, each member set once."""
    out: dict[frozenset, list] = {}
    graph: dict = {}
    for a, b in sorted(edges):
        graph.setdefault(a, []).append(b)
    done: set = set()
    for start in sorted(graph):
        if start in done:
            continue
        path, on, stack = [start], {start: 0}, [(start, iter(graph[start]))]
        while stack:
            node, rest = stack[-1]
            for nxt in rest:
                if nxt in on:
                    found = path[on[nxt] :]
                    out.setdefault(frozenset(found), found)
                elif nxt not in done:
                    stack.append((nxt, iter(graph.get(nxt, []))))
                    on[nxt] = len(path)
                    path.append(nxt)
                    break
            else:
                stack.pop()
                done.add(node)
                path.pop()
                del on[node]
    return list(out.values())


def search_cycles(edges: DataFrame, most: int = SEARCHED, longest: int = LONGEST) -> DataFrame:
    """(cycle, length, how): the cycles that a depth-first search meets, in each strongly connected part by itself, since no
    cycle leaves one. Such a search goes from step to step, so a part of more than ``most`` edges isn't searched by a task:
    its elementary cycles of at most ``longest`` nodes are enumerated, which is what ``how`` says."""
    parts = cut(strong_parts(edges))
    sizes = parts.groupBy("part").agg(F.count("*").alias("n"))
    small, large = (parts.join(sizes.where(F.col("n") <= most if keep else F.col("n") > most), "part").select("part", "src", "dst") for keep in (True, False))

    def search(pdf: pd.DataFrame) -> pd.DataFrame:
        found = back_edge_cycles(list(zip(pdf.src, pdf.dst, strict=True)))
        return pd.DataFrame({"cycle": pd.Series([[str(x) for x in c] for c in found], dtype=object), "length": pd.Series([len(c) for c in found], dtype="int32"), "how": "searched"})

    searched = small.groupBy("part").applyInPandas(search, "cycle array<string>, length int, how string")
    if sizes.where(F.col("n") > most).isEmpty():
        return searched
    rest = elementary_cycles(large.select("src", "dst"), longest)
    return searched.union(rest.select(F.col("cycle").cast("array<string>").alias("cycle"), F.col("length").cast("int").alias("length"), F.lit("enumerated").alias("how")))


@query("grf04_dfs_cycles")
def _(spark, source):
    """The order-dependent form."""
    return search_cycles(relation(spark, source, "imports"))


@both("grf06_callees_ambiguity", "refs", "symbols")
def _(d):
    # a bare call that its own file doesn't define and no import names means the first symbol elsewhere: a guess
    return """select c.path, c.target_name, coalesce(o.id, t.id) as target, count(*) as n, o.id is null and i.file_id is null as ambiguous from (select * from refs where kind = 'call') c
        left join (select file_id, name, max(id) as id from symbols group by file_id, name) o on o.file_id = c.file_id and o.name = c.target_name join (select name, min(id) as id from symbols group by name) t on t.name = c.target_name
        left join (select distinct file_id, target_name from refs where kind = 'import') i on i.file_id = c.file_id and i.target_name = c.target_name group by c.path, c.target_name, coalesce(o.id, t.id), o.id is null and i.file_id is null"""


def impact(symbol: int) -> str:
    """Direct callers by name, without those whom the id alone means, then indirect ones, each in its bucket."""
    return f"""with {indirect(symbol)},
  target as (select * from functions where id = {symbol}),
  direct as (select distinct c.src as caller, c.dst from calls c join functions f on f.id = c.dst join target t on t.name = f.name),
  rows as (select caller, dst as via, 1 as depth from direct union all select caller, via, 2 from edges2 l where not exists (select 1 from direct x where x.caller = l.caller) union all select caller, via, 3 from edges3 l where not exists (select 1 from direct x where x.caller = l.caller))
  select r.caller, r.via, r.depth, g.path, case when g.family <> t.family then 'cross_language' when g.is_test then 'test' when r.depth = 1 then 'direct' else 'indirect' end as bucket
  from rows r join functions g on g.id = r.caller cross join target t"""


def impact_of(spark: SparkSession, source: Source, path: str, name: str) -> DataFrame:
    """The impact of a change to a symbol of a file; where the file has none of that name, of the first elsewhere, which
    ``elsewhere`` says."""
    functions = relation(spark, source, "functions")
    found = functions.where(F.col("name") == name).select("id", (F.col("path") != path).alias("elsewhere")).orderBy("elsewhere", "id").first()
    if found is None:
        raise LookupError(f"not_found: {name} in {path}")
    return run(spark, source, impact(found.id), ("calls", "functions")).withColumn("elsewhere", F.lit(found.elsewhere))


@both("grf07_impact", "calls", "functions")
def _(d):
    return impact(7)


@both("grf09_outline", "symbols", "refs")
def _(d):
    # at most fifty items of a file; a parent is the nearest symbol before it that reaches beyond it
    return """with uses as (select target_name, count(*) as n from refs group by target_name),
        items as (select s.*, row_number() over (partition by s.file_id order by s.start_line, s.end_line desc, s.id) as rn from symbols s),
        kept as (select * from items where rn <= 50),
        parent as (select c.id, max(p.start_line) as parent_line, count(p.id) as depth from kept c left join kept p on p.file_id = c.file_id and p.rn < c.rn and p.type <> 'variable' and c.end_line <= p.end_line and p.id <> c.id group by c.id)
        select s.file_id, s.name, s.type, s.start_line as line, s.signature, p.parent_line, p.depth, substr(s.name, 1, 1) = '_' as private, coalesce(u.n, 0) as n_refs from kept s join parent p on p.id = s.id left join uses u on u.target_name = s.name where p.depth <= 2"""


@query(
    "grf10_import_fixer_cycle",
    with_ctes("with recursive r as (select src, dst, 1 as depth from imports union select r.src, i.dst, r.depth + 1 from r join imports i on i.src = r.dst where r.depth < 10 and r.dst <> r.src) select id as module, (select min(depth) from r where r.src = id and r.dst = id) as shortest from modules", DUCK, ("imports", "modules")),
)
def _(spark, source):
    """How many steps a module's shortest cycle has, of at most ten; null if it has none."""
    imports = relation(spark, source, "imports")
    parts = strong_parts(imports).select("src", "dst")
    around = dependencies(parts, parts.select(F.col("src").alias("root")), DEEPEST).where("dst = root").groupBy("root").agg(F.min("depth").alias("shortest"))
    return relation(spark, source, "modules").select(F.col("id").alias("root")).join(around, "root", "left").select(F.col("root").alias("module"), "shortest")


@query("grf12_bfs_large")
def _(spark, source):
    calls = relation(spark, source, "calls")
    return bfs(calls, calls.where("dst % 50 = 0").select(F.col("dst").alias("node")), 3)


@both("grf13_call_chain", "calls", "functions")
def _(d):
    # callers and callees are two sets beside a symbol; their pairs would grow with the square of its degree
    return f"""select f.id as symbol, {d.item('u.ids', '1')} as first_caller, {d.size('u.ids')} as n_callers, {d.item('o.ids', '1')} as first_callee, {d.size('o.ids')} as n_callees from functions f
        join (select dst, {d.sorted_set('src')} as ids from calls group by dst) u on u.dst = f.id join (select src, {d.sorted_set('dst')} as ids from calls group by src) o on o.src = f.id"""


@both("grf14_inspect", "calls", "functions")
def _(d):
    return """select f.id, f.name, f.path, coalesce(i.n, 0) as n_callers, coalesce(o.n, 0) as n_callees, s.n as n_same_name from functions f left join (select dst, count(*) as n from calls group by dst) i on i.dst = f.id
        left join (select src, count(*) as n from calls group by src) o on o.src = f.id join (select name, count(*) as n from functions group by name) s on s.name = f.name"""
