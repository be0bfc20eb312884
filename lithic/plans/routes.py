"""The catalogue by path, as a local query endpoint would serve it: /symbols/<file>, /callers/<id>, /search?q=<text>."""

from __future__ import annotations

from typing import NamedTuple
from urllib.parse import parse_qs, unquote, urlsplit

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lithic.plans import catalogue
from lithic.sources.relations import RELATIONS, relation


class Route(NamedTuple):
    source: str  # a relation or a named query
    column: str | None = None  # what the path's argument selects by; None: there is no argument


ROUTES = {
    "classify": Route("ext16_message_classes"),
    "extract-symbols": Route("ext20_regex_symbols"),
    "symbols": Route("symbols", "path"),
    "references": Route("refs", "target_name"),
    "stats": Route("agg01_index_stats"),
    "density": Route("ext23_density"),
    "callers": Route("calls", "dst"),
    "callees": Route("calls", "src"),
    "impact": Route("grf07_impact", "path"),
    "deps": Route("grf02_dependencies", "root"),
    "deadcode": Route("agg02_dead_code"),
    "complexity": Route("mth01_complexity", "path"),
    "search": Route("symbols"),
}


def serve(spark: SparkSession, sf_dir: str, url: str) -> DataFrame:
    """The rows a path stands for; LookupError for a path that is none, or lacks its argument.

    The argument is compared, never made part of SQL text, and the comparison reaches the scan like any filter.
    """
    asked = urlsplit(url)
    name, _, argument = asked.path.strip("/").partition("/")
    route = ROUTES.get(name)
    if route is None or (route.column is not None) != bool(argument):
        raise LookupError(f"not_found: {asked.path}")
    found = relation(spark, sf_dir, route.source) if route.source in RELATIONS else catalogue.queries()[route.source](spark, sf_dir)
    if route.column:
        found = found.where(F.col(route.column).cast("string") == F.lit(unquote(argument)))
    if name == "search":
        words = parse_qs(asked.query).get("q", [""])[0].lower()
        found = found.where(F.instr(F.lower("name"), words) > 0).orderBy("name", "path", "start_line").limit(30)
    return found
