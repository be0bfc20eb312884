"""What a reference means outside its file: candidates of its name, by the module that the call speaks of; and aliases.

``a::hash::f()`` asks for a symbol f; of several, one whose path holds the segment hash is meant, the last segment of the
call counting most; else the first. An inverted index holds for every segment the files whose paths answer to it, so a
reference meets its candidates by equi-joins on (name, segment), of which each keeps two candidates at most: the first, and
the first of another file. So neither a name that thousands of files define nor a segment that every path holds makes pairs.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lithic.operators.binding import first_elsewhere
from lithic.operators.graphs import stored
from lithic.plans.catalogue import both, query
from lithic.plans.dialect import DUCK, SPARK
from lithic.sources.relations import Relations, Source, relation, run, with_ctes

#: Segments of a call that name no module, kinds that a name elsewhere may be meant by, kinds of the own file.
NO_MODULE = ("crate", "self", "super")
ELSEWHERE, OWN = ("call", "import", "extends", "implements", "use", "assign"), ("call", "use", "assign")


def quoted(words) -> str:
    return ", ".join(f"'{w}'" for w in words)


def segments(d, source: str, keep: str) -> str:
    """(keep, place, seg): the module segments of a source's call expressions, by their place."""
    rows = d.each(source, d.extract_all("lower(expr)", "([^:]+)::"), "place seg", keep)
    return f"select * from {rows} g_ where trim(seg) not in ({quoted(NO_MODULE)})"


def postings(d, asked: str) -> str:
    """(seg, file_id): the files whose paths answer to the segments in asked: a folder below the first, a name up to its
    first dot below it, the end of a name before .rs, .py or .go."""
    path = "(select file_id, lower(path) as p from files) f_"
    folders = d.each(path, d.slice(d.split("p", "/"), "2", f"greatest(cast({d.size(d.split('p', '/'))} as int) - 2, 0)"), "k_ seg", "file_id")
    heads = d.each(path, d.extract_all("p", "/([^/.]+)[.]"), "k_ seg", "file_id")
    stems = f"(select * from {d.each(path, d.extract_all('p', '([^/]*)[.](?:rs|py|go)'), 'k_ stem', 'file_id')} q_ where stem <> '') s_"
    tails = d.each(stems, d.map(d.span("1", "length(stem)"), "i", "substr(stem, cast(i as int))"), "j_ seg", "file_id")
    every = " union all ".join(f"select seg, file_id from {t} u{k}_" for k, t in enumerate((folders, heads, tails)))
    return f"select distinct e.seg, e.file_id from ({every}) e join (select distinct seg from {asked}) a on a.seg = e.seg"


def hints(d) -> str:
    """CTEs: postings and the first two candidates of each (name, seg) in ``asked`` (target_name, seg, ...)."""
    found = "select s.name, p.seg, s.file_id, s.id from symbols s join answering p on p.file_id = s.file_id join (select distinct target_name, seg from asked) a on a.target_name = s.name and a.seg = p.seg"
    return f"answering as ({postings(d, 'asked')}), found as ({found}), hinted as {first_elsewhere('found', 'name, seg', 'file_id')}"


def elsewhere(d) -> str:
    """(id, target_name, target_symbol_id, hinted, n_candidates) of the references that their own file doesn't bind."""
    unbound = f"""select r.id, r.file_id, r.target_name, r.expr, coalesce(o.n, 0) as n_own from refs r left join (select name, file_id, count(*) as n from symbols group by name, file_id) o on o.name = r.target_name and o.file_id = r.file_id
        where r.kind in ({quoted(ELSEWHERE)}) and r.target_name <> '' and instr(r.expr, '.') = 0 and not (r.kind in ({quoted(OWN)}) and o.n is not null)"""
    pick = lambda t, r: f"case when {t}.home = {r}.file_id then {t}.next_id else {t}.first_id end"
    return f"""with unbound as ({unbound}), asked as ({segments(d, "(select * from unbound where instr(expr, '::') > 0) b_", 'id, file_id, target_name')}), {hints(d)},
        picked as (select id, target from (select a.id, {pick('h', 'a')} as target, row_number() over (partition by a.id order by a.place desc) as rn from asked a join hinted h on h.name = a.target_name and h.seg = a.seg where h.home <> a.file_id or h.next_id is not null) x where rn = 1)
        select u.id, u.target_name, coalesce(p.target, {pick('a', 'u')}) as target_symbol_id, p.target is not null as hinted, cast(a.n_all - u.n_own as bigint) as n_candidates from unbound u join {first_elsewhere('symbols', 'name', 'file_id')} a on a.name = u.target_name
        left join picked p on p.id = u.id where a.home <> u.file_id or a.next_id is not null"""


def rebound(d) -> str:
    """(id, target_name, original, target_symbol_id): calls by an alias that an import of their file gives; of several the
    last whose original is there wins."""
    known = f"select a.file_id, a.local, a.original, a.place, case when t.home = a.file_id then t.next_id else t.first_id end as target from aliases a join {first_elsewhere('symbols', 'name', 'file_id')} t on t.name = a.original where t.home <> a.file_id or t.next_id is not null"
    last = f"select file_id, local, original, target from (select k.*, row_number() over (partition by file_id, local order by place desc, original) as rn from ({known}) k) w where rn = 1"
    return f"select r.id, r.target_name, l.original, l.target as target_symbol_id from refs r join ({last}) l on l.file_id = r.file_id and l.local = r.target_name where r.kind = 'call'"


def alias_map(d) -> str:
    """(path, local, original, place) of what a require call's pattern binds; of the relation texts."""
    from lithic.operators.projects import imported

    return f"select path, local, original, place from {imported(d)} i where lang = 'js' and {d.rlike('statement', '^(?:const|let|var) +[{].*require[(]')} and original <> '' and local <> ''"


@query("jn08_cross_file_pick", with_ctes(elsewhere(DUCK), DUCK, ("refs", "symbols", "files")))
def _(spark, source):
    return picked_elsewhere(spark, source)


#: References to a name that has more than one in HOT of all of them are dealt out to PARTS tasks, by their files.
HOT, PARTS = 1000, 64
#: So many segments that answer to some path go into a plan as literals.
FEW = 1000
#: So many names are spoken of most, of those whose candidates have so many hints at most; every task holds them.
COMMON, HINTS = 10_000, 16
#: A table of bits for values by their 64-bit hash h has a word of 64 bits for about four values, and this many words at most.
WORDS = 1 << 20
BITS = " | ".join(f"shiftleft(1L, cast(shiftrightunsigned(h, {k}) & 63 as int))" for k in (58, 52, 46))


def sieve(known: DataFrame, *keys: str) -> Callable[..., DataFrame]:
    """A join (rows, how, other condition) with rows that by their keys are known, and a few others: every task holds a table
    of bits, of 8 MB at most, in which each that is known has set three."""
    known = known.select(F.xxhash64(*keys).alias("h")).distinct()
    n = min(WORDS, 1 << (known.count() // 4).bit_length())
    words = known.groupBy(F.expr(f"h & {n - 1}").alias("k")).agg(F.expr(f"bit_or({BITS})").alias("bits"))
    every = known.sparkSession.range(n).join(words, F.col("id") == F.col("k"), "left").select("id", F.coalesce("bits", F.lit(0)).alias("bits"))
    table = stored(every.agg(F.array_sort(F.collect_list(F.struct("id", "bits"))).alias("w")).select(F.col("w.bits").alias("words")))
    held = F.expr(f"get(words, cast(h & {n - 1} as int)) & ({BITS}) = ({BITS})")
    return lambda rows, how="left_semi", other=F.lit(False): rows.withColumn("h", F.xxhash64(*keys)).join(F.broadcast(table), held | other, how).drop("h")


def picked_elsewhere(spark: SparkSession, source: Source) -> DataFrame:
    """What elsewhere() says. Candidates are written first, a row for each name with what its segments hint at. References to
    what no symbol is called go before any shuffle. Those to the names that are spoken of most meet their candidates where they
    are, unless their file may have a symbol of that name. The others are shuffled once, by their name, and meet their file's
    symbols of that name and its candidates there, however many names there are; a hot name's go to several tasks."""
    refs = relation(spark, source, "refs").select("id", "file_id", "target_name", "kind", "expr")
    refs = refs.where(F.col("kind").isin(*ELSEWHERE) & (F.col("target_name") != "") & (F.instr("expr", ".") == 0))
    symbols = stored(relation(spark, source, "symbols").select("id", "file_id", "name"))
    segs = F.regexp_extract_all(F.lower("expr"), F.lit("([^:]+)::"))
    segs = F.when(F.instr("expr", "::") > 0, F.filter(segs, lambda s: ~F.trim(s).isin(*NO_MODULE)))
    symbols_of = symbols.withColumnRenamed("name", "target_name")
    refs = sieve(symbols_of, "target_name")(refs).select("id", "file_id", "target_name", F.col("kind").isin(*OWN).alias("own"), segs.alias("segs"))
    # what is spoken of, in one pass: names (0) with the number of their references, and segments (1)
    said = F.concat(F.array(F.struct(F.lit(0).alias("seg"), F.col("target_name").alias("word"))), F.transform(F.coalesce("segs", F.array().cast("array<string>")), lambda s: F.struct(F.lit(1).alias("seg"), s.alias("word"))))
    said = stored(refs.select(F.inline(said)).groupBy("seg", "word").count())
    asked, called = said.where("seg = 1").select(F.col("word").alias("seg")), said.where("seg = 0")
    paths = Relations({"files": relation(spark, source, "files").select("file_id", "path"), "asked": asked})
    answering = stored(run(spark, paths, postings(SPARK, "asked"), ("files", "asked")))
    few = [r.seg for r in answering.select("seg").distinct().limit(FEW + 1).collect()]
    if len(few) <= FEW:  # other segments, as most words of a text are, need not go along
        refs = refs.withColumn("segs", F.filter("segs", lambda s: s.isin(few)))
    candidates = Relations({"symbols": symbols, "answering": answering})
    found = "select s.name, p.seg, s.file_id, s.id from symbols s join answering p on p.file_id = s.file_id"
    hinted = run(spark, candidates, f"with found as ({found}) select name, map_from_entries(collect_list(struct(seg, struct(first_id, home, next_id)))) as hints from {first_elsewhere('found', 'name, seg', 'file_id')} h group by name", ("symbols", "answering"))
    first = run(spark, candidates, f"select * from {first_elsewhere('symbols', 'name', 'file_id')} f", ("symbols",))
    names = stored(first.join(hinted, "name", "left").withColumnRenamed("name", "target_name"))
    away = lambda home, next_id: (home != F.col("file_id")) | next_id.isNotNull()
    pick = lambda home, first_id, next_id: F.when(away(home, next_id), F.when(home == F.col("file_id"), next_id).otherwise(first_id))
    # of the segments that name a candidate in another file, the last
    hints = F.filter(F.transform("segs", lambda s: F.try_element_at("hints", s)), lambda h: away(h["home"], h["next_id"]))
    hint = F.col("hint")

    def picked(met: DataFrame) -> DataFrame:
        met = met.withColumn("hint", F.try_element_at(hints, F.lit(-1)))
        met = met.select("id", "target_name", pick(hint["home"], hint["first_id"], hint["next_id"]).alias("hinted"), pick(F.col("home"), F.col("first_id"), F.col("next_id")).alias("target"), (F.col("n_all") - F.col("n_own")).cast("long").alias("n_candidates"))
        return met.where(F.col("target").isNotNull()).select("id", "target_name", F.coalesce("hinted", "target").alias("target_symbol_id"), F.col("hinted").isNotNull().alias("hinted"), "n_candidates")

    most = called.orderBy(F.desc("count"), "word").limit(COMMON).select(F.col("word").alias("target_name"))
    common = stored(names.where(F.coalesce(F.size("hints"), F.lit(0)) <= HINTS).join(F.broadcast(most), "target_name", "left_semi"))
    own = stored(symbols_of.where("file_id is not null").groupBy("file_id", "target_name").agg(F.count("*").alias("is_symbol")))
    owned = sieve(own.join(F.broadcast(common.select("target_name")), "target_name", "left_semi"), "file_id", "target_name")
    at_once = owned(refs, "left_anti").join(F.broadcast(common), "target_name").withColumn("n_own", F.lit(0))
    rest = owned(refs.join(F.broadcast(common.select("target_name", F.lit(True).alias("common"))), "target_name", "left"), "left_semi", F.col("common").isNull()).drop("common")
    # a hot name's references, its symbols by file and copies of its candidates are dealt out alike
    total = called.agg(F.coalesce(F.sum("count"), F.lit(0))).first()[0]
    hot = F.broadcast(stored(called.where(F.col("count") * HOT > total).select(F.col("word").alias("target_name"), F.lit(True).alias("hot"))))
    part = F.when(F.col("hot"), F.pmod(F.xxhash64("file_id"), F.lit(PARTS))).otherwise(0)
    both_ = rest.withColumn("is_symbol", F.lit(0)).unionByName(own, allowMissingColumns=True).join(hot, "target_name", "left").withColumn("part", part).drop("hot").repartition("target_name", "part")
    counted = both_.withColumn("n_own", F.sum("is_symbol").over(Window.partitionBy("target_name", "part", "file_id"))).where("own is not null and not (own and n_own > 0)")
    dealt = names.join(hot, "target_name", "left").withColumn("part", F.expr(f"explode(if(hot, sequence(0L, {PARTS - 1}L), array(0L)))")).drop("hot")
    return picked(at_once).union(picked(counted.join(dealt, ["target_name", "part"])))


@both("jn09_alias_rebind", "refs", "symbols", "aliases")
def _(d):
    return rebound(d)


@both("grf11_pick_candidate", "refs", "symbols", "files")
def _(d):
    # of each call expression: the candidate, and the segment that decided; without one, the first of that name
    calls = "(select distinct target_name, expr from refs where kind = 'call') c_"
    return f"""with asked as ({segments(d, calls, 'target_name, expr')}), {hints(d)},
        best as (select target_name, expr, first_id, seg from (select a.target_name, a.expr, h.first_id, a.seg, row_number() over (partition by a.target_name, a.expr order by a.place desc) as rn from asked a join hinted h on h.name = a.target_name and h.seg = a.seg) x where rn = 1),
        first as (select name, min(id) as id, count(*) as n from symbols group by name)
        select c.target_name, c.expr, coalesce(b.first_id, f.id) as candidate, b.seg as decided_by, f.n as n_candidates from {calls} join first f on f.name = c_.target_name left join best b on b.target_name = c_.target_name and b.expr = c_.expr""".replace("select c.target_name, c.expr", "select c_.target_name, c_.expr")
