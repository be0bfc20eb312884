"""URL filtering by rules and by link-graph propagation, in DataFrame functions only.

Rules of a host and a path decide the pages they fit, the longest first. For the rest, trust and distrust are spread
over the graph of hosts that pages link to: trust from hosts whose pages rules allow, along links (a personalised
PageRank); distrust from hosts whose pages rules block, against links, since who links to a bad host is suspect. A
host is blocked if its distrust exceeds its trust by ``threshold`` times the mean share of a host.

Pages are read twice: for the graph and for the result. The graph is aggregated to one row a host and one an edge
before anything is joined, so a host that holds a third of all pages is one row too; its pages are joined to the
verdicts by an outer join whose hot side Spark can split.

Cases: null urls and such without :// have an empty host and path, fit no rule and are allowed, as is a host that no
seed reaches; relative links and links to the own host are no edges; null html has no links; repeated pages each count.
A host with as many allowed as blocked pages is no seed; rules of equal length go by their names. Pages of any length are
searched whole; an empty table gives an empty one; columns keep their names inside ``row``.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lithic.llm.common import save, table

DAMPING, ROUNDS, THRESHOLD = 0.85, 12, 0.5


class Rule(NamedTuple):
    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path


RULES = [Rule("com", "/en/", "block"), Rule("example.com", "/en/7", "allow"), Rule("net", "/de/", "allow"), Rule("example.net", "/de/8", "block"), Rule("org", "/es/", "block")]

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_LINK = r"""(?i)\bhref\s*=\s*["']?(?:[a-z][a-z0-9+.-]*:)?//([^/?#"'\s>]+)"""


def host_of(url: Column) -> Column:
    return F.when(url.contains("://"), F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), _UPPER, _LOWER)).otherwise("")


def path_of(url: Column) -> Column:
    return F.when(url.contains("://"), F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)).otherwise("")


def fitting(rules: list[Rule], host: Column, path: Column) -> Column:
    """The longest rule that fits, as struct<rule, verdict>, or null."""
    out = None
    for r in sorted(rules, key=lambda r: (-len(r.name), r.name)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        this = F.struct(F.lit(r.name).alias("rule"), F.lit(r.verdict).alias("verdict"))
        out = F.when(fits, this) if out is None else out.when(fits, this)
    return out if out is not None else F.lit(None).cast("struct<rule:string,verdict:string>")


def edges_of(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(src, dst, n): links between different hosts, a page's links to one host counted once."""
    links = F.array_distinct(F.regexp_extract_all(F.coalesce(F.col(f"`{html}`"), F.lit("")), F.lit(_LINK), F.lit(1)))
    out = pages.select(host_of(F.col(f"`{url}`")).alias("src"), F.explode(links).alias("dst"))
    out = out.select("src", F.translate("dst", _UPPER, _LOWER).alias("dst")).where("src <> '' and src <> dst")
    return out.groupBy("src", "dst").agg(F.count("*").alias("n"))


def propagate(hosts: DataFrame, edges: DataFrame, damping: float = DAMPING, rounds: int = ROUNDS) -> DataFrame:
    """hosts: (host, good, bad), the seeds' weights. Returns (host, trust, distrust), each summing to 1 if it has a
    seed; what a host without links would pass on goes back to the seeds. Each round is written once, which ends its
    lineage, and read back for the mass that is left (two numbers) and for the next round."""
    both = edges.select(F.col("src").alias("a"), F.col("dst").alias("b"), "n", F.lit(True).alias("fwd")).union(edges.select(F.col("dst").alias("a"), F.col("src").alias("b"), "n", F.lit(False).alias("fwd")))
    outs = both.groupBy("a", "fwd").agg(F.sum("n").alias("all"))
    flow = save(both.join(outs, ["a", "fwd"]).select("a", "b", "fwd", (F.col("n") / F.col("all")).alias("w")))
    total = hosts.agg(F.sum("good").alias("g"), F.sum("bad").alias("d")).first()
    share = lambda c, t: F.col(c) / t if t else F.lit(0.0)
    ranks = save(hosts.select("host", share("good", total.g).alias("t0"), share("bad", total.d).alias("d0")).withColumns({"trust": F.col("t0"), "distrust": F.col("d0")}))
    if flow.limit(1).count() == 0:  # nothing to spread along
        return ranks.select("host", "trust", "distrust")
    for _ in range(rounds):
        sent = flow.join(ranks, flow.a == ranks.host).groupBy("b").agg(F.sum(F.when(F.col("fwd"), F.col("trust") * F.col("w")).otherwise(0.0)).alias("t"), F.sum(F.when(~F.col("fwd"), F.col("distrust") * F.col("w")).otherwise(0.0)).alias("d"))
        got = save(ranks.join(sent, ranks.host == sent.b, "left").select("host", "t0", "d0", (damping * F.coalesce("t", F.lit(0.0))).alias("t"), (damping * F.coalesce("d", F.lit(0.0))).alias("d")))
        left = got.agg((1 - F.sum("t")).alias("t"), (1 - F.sum("d")).alias("d")).first()
        ranks = got.select("host", "t0", "d0", (F.col("t") + F.lit(left.t) * F.col("t0")).alias("trust"), (F.col("d") + F.lit(left.d) * F.col("d0")).alias("distrust"))
    return ranks.select("host", "trust", "distrust")


def judge(pages: DataFrame, rules: list[Rule] = RULES, url: str = "url", html: str = "html", threshold: float = THRESHOLD) -> DataFrame:
    """pages as ``row``, and ``m``: host, path, rule, verdict."""
    host, path = host_of(F.col(f"`{url}`")), path_of(F.col(f"`{url}`"))
    own = pages.select(host.alias("host"), fitting(rules, host, path).alias("fit")).where("host <> ''")
    own = own.groupBy("host").agg((F.count_if(F.col("fit.verdict") == "allow") / F.count("*")).alias("good"), (F.count_if(F.col("fit.verdict") == "block") / F.count("*")).alias("bad"))
    edges = save(edges_of(pages, url, html))
    linked = edges.select(F.col("src").alias("host")).union(edges.select(F.col("dst").alias("host"))).distinct()
    # a host is the kind of seed that more of its pages are
    seeds = own.select("host", F.when(F.col("good") > F.col("bad"), F.col("good")).otherwise(0.0).alias("good"), F.when(F.col("bad") > F.col("good"), F.col("bad")).otherwise(0.0).alias("bad"))
    hosts = save(linked.join(seeds, "host", "full").select("host", F.coalesce("good", F.lit(0.0)).alias("good"), F.coalesce("bad", F.lit(0.0)).alias("bad")))
    n = max(1, hosts.count())
    blocked = propagate(hosts, edges).where(F.col("distrust") - F.col("trust") > threshold / n).select(F.col("host").alias("_h"), F.lit(True).alias("_bad"))
    rows = pages.select(F.struct(*[F.col(f"`{c}`") for c in pages.columns if c != html]).alias("row"), host.alias("_host"), path.alias("_path"), fitting(rules, host, path).alias("_fit"))
    out = rows.join(save(blocked), rows["_host"] == F.col("_h"), "left")
    verdict = F.coalesce("_fit.verdict", F.when(F.col("_bad"), "block").otherwise("allow"))
    return out.select("row", F.struct(F.col("_host").alias("host"), F.col("_path").alias("path"), F.col("_fit.rule").alias("rule"), verdict.alias("verdict")).alias("m"))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages").select("page_id", "url", "html")).select("row.page_id", "m.*")
