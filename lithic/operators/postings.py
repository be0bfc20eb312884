"""Trigram postings: substring lookups over an index, and the join of modules to the paths that hold them.

A text that holds another holds each of its trigrams, so the rarest one's postings are all that has to be looked at. A
posting list is kept in blocks of names, so that a gram that most names hold is many rows; how many names hold a gram
stands beside it. Letters' case doesn't count. Texts below three characters have no trigram: they are found by a scan of the
distinct names, or, in the join, by counts of the short grams that are asked for, which make no pairs. Null and empty names
are in no list; an empty text is held by every name and isn't looked up.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lithic.operators.search import refs_page
from lithic.plans.catalogue import query
from lithic.plans.dialect import DUCK, SPARK
from lithic.sources.relations import Relations, Source, relation, run, with_ctes

GRAM, BLOCK = 3, 1000
#: Names that a filter may list; beyond it names are joined.
LISTED = 500


def grams(x: Column, n: int = GRAM) -> Column:
    """The distinct parts of n characters of a text in lower case; of a shorter one, itself."""
    low = F.lower(x)
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(low) - (n - 1), F.lit(1))), lambda i: F.substr(low, i, F.lit(n))))


def postings(names: DataFrame, block: int = BLOCK) -> DataFrame:
    """names (name). (gram, block, n_names, names): each gram's distinct names, in blocks of about so many."""
    each = names.where("name <> ''").select("name").distinct().select("name", F.explode(grams(F.col("name"))).alias("gram"))
    sizes = each.groupBy("gram").agg(F.count("*").alias("n_names"))
    dealt = each.join(sizes, "gram").withColumn("block", F.pmod(F.xxhash64("name"), F.ceil(F.col("n_names") / block)))
    return dealt.groupBy("gram", "block").agg(F.min("n_names").alias("n_names"), F.sort_array(F.collect_list("name")).alias("names"))


def names_with(index: DataFrame, text: str) -> DataFrame:
    """(name): the names that hold the text, from the postings of its rarest gram."""
    text = text.lower()
    if not text:
        raise ValueError("an empty text is held by every name")
    if len(text) < GRAM:
        return index.select(F.explode("names").alias("name")).distinct().where(F.instr(F.lower("name"), text) > 0)
    asked = sorted({text[i : i + GRAM] for i in range(len(text) - GRAM + 1)})
    known = {r.gram: r.n for r in index.where(F.col("gram").isin(asked)).groupBy("gram").agg(F.min("n_names").alias("n")).collect()}  # a row for each gram of the text
    rarest = min(asked, key=lambda g: known.get(g, 0))
    return index.where(F.col("gram") == rarest).select(F.explode("names").alias("name")).where(F.instr(F.lower("name"), text) > 0)


def narrowed(source: Relations, table: str, column: str, texts: list[str], exact: list[str] = ()) -> Relations:
    """source with only those rows of a table whose column holds one of the texts or is one of exact; if these are few, as a
    filter that reaches the scan."""
    names = None
    for text in texts:
        found = names_with(source["postings"], text)
        names = found if names is None else names.union(found)
    few = [r.name for r in names.limit(LISTED + 1).collect()]  # at most LISTED + 1
    rows = source[table]
    if len(few) <= LISTED:
        rows = rows.where(F.col(column).isin(sorted({*few, *exact})))
    else:
        listed = names.union(rows.sparkSession.createDataFrame([(x,) for x in exact], "name string")).distinct()
        rows = rows.join(listed.withColumnRenamed("name", column), column, "left_semi")
    return Relations({**source.tables, table: rows})


def looked_up(name: str, table: str, column: str, texts: list[str], exact: list[str] = ()):
    """Registers a query from one body, as catalogue.both does; where the source has postings, its rows are found by them."""

    def add(body):
        @query(name, with_ctes(body(DUCK), DUCK, (table,)))
        def _(spark: SparkSession, source: Source):
            indexed = isinstance(source, Relations) and "postings" in source.tables
            return run(spark, narrowed(source, table, column, texts, exact) if indexed else source, body(SPARK), (table,))

        return body

    return add


@looked_up("flt03_references", "refs", "target_name", ["tionhe"], exact=["the"])
def _(d):
    # an exact name or a substring of it, whatever the case
    return refs_page(d, "target_name = 'the' or instr(lower(target_name), 'tionhe') > 0", 500)


@looked_up("flt06_symbol_search", "symbols", "name", ["TIon"])
def _(d):
    return "select name, type, path, start_line from symbols where instr(lower(name), lower('TIon')) > 0 order by name, path, start_line limit 30"


def modules_in_paths(modules: DataFrame, paths: DataFrame) -> DataFrame:
    """modules (module), paths (id, path). (module, path, n, slashed): of each distinct module the first path, by id, that
    holds it, and how many do, whatever the case; of a dotted one that none holds, with slashes for dots.

    Each module meets paths by its rarest trigram over all paths. Modules below three characters ask for few different
    grams, so these are counted over the paths instead.
    """
    clean = F.regexp_replace("module", r"^[.][.]?/", "")
    asked = modules.where("module <> ''").select("module").distinct().select("module", F.lower(clean).alias("text"))
    texts = asked.union(asked.where(F.instr("text", ".") > 0).select("module", F.translate("text", ".", "/"))).select("text").where("text <> ''").distinct()
    sources = paths.where("path <> ''").select("id", "path")
    each = sources.select("id", "path", F.explode(grams(F.col("path"))).alias("gram"))
    sizes = each.groupBy("gram").agg(F.count("*").alias("n"))
    wanted = texts.where(F.length("text") >= GRAM).select("text", F.explode(grams(F.col("text"))).alias("gram")).join(sizes, "gram", "left")
    rarest = wanted.groupBy("text").agg(F.min(F.struct(F.coalesce("n", F.lit(0)), "gram")).alias("r")).select("text", "r.gram")
    met = rarest.join(each, "gram").where(F.instr(F.lower("path"), F.col("text")) > 0).select("text", "id", "path")
    short = F.array_union(grams(F.col("path"), 1), grams(F.col("path"), 2))
    brief = sources.select("id", "path", F.explode(short).alias("text")).join(texts.where(F.length("text") < GRAM), "text").select("text", "id", "path")
    found = met.union(brief).groupBy("text").agg(F.min(F.struct("id", "path")).alias("first"), F.count("*").alias("n"))
    plain = asked.join(found, "text", "left").select("module", "first", "n", F.translate("text", ".", "/").alias("other"), F.col("text").contains(".").alias("dotted"))
    second = found.select(F.col("text").alias("other"), F.col("first").alias("first_"), F.col("n").alias("n_"))
    both = plain.join(second, "other", "left").withColumn("slashed", F.col("first").isNull() & F.col("dotted") & F.col("first_").isNotNull())
    return both.select("module", F.when(F.col("slashed"), F.col("first_.path")).otherwise(F.col("first.path")).alias("path"), F.coalesce(F.when(F.col("slashed"), F.col("n_")).otherwise(F.col("n")), F.lit(0)).alias("n"), "slashed")


_HELD = "select m.module, {way} as slashed, min(struct_pack(i := p.id, path := p.path)).path as path, count(*) as n from asked m join paths p on m.{text} <> '' and instr(lower(p.path), m.{text}) > 0 group by m.module"
_CLEAN = "lower(regexp_replace(module, '^[.][.]?/', ''))"


@query(
    "jn13_like_join",
    with_ctes(
        f"""with asked as (select distinct module, {_CLEAN} as a, case when instr({_CLEAN}, '.') > 0 then replace({_CLEAN}, '.', '/') else '' end as b from links where module <> ''), paths as (select page_id as id, path from pages_ where path <> ''),
        plain as ({_HELD.format(way='false', text='a')}), slashed as ({_HELD.format(way='true', text='b')})
        select q.module, coalesce(x.path, y.path) as path, coalesce(x.n, y.n, 0) as n, x.path is null and y.path is not null as slashed from asked q left join plain x on x.module = q.module left join slashed y on y.module = q.module""",
        DUCK,
        ("links", "pages_"),
    ),
)
def _(spark, source):
    """Modules that files import, met with the paths of files; over the tables, what pages link to and their paths."""
    if isinstance(source, Relations) and "refs" in source.tables:
        modules = source["refs"].where("kind = 'import'").select(F.col("target_name").alias("module")).where("module not like 'node:%'")
        return modules_in_paths(modules, source["files"].select(F.col("file_id").alias("id"), "path"))
    return modules_in_paths(relation(spark, source, "links").select("module"), relation(spark, source, "pages_").select(F.col("page_id").alias("id"), "path"))
