"""Exact top-k search by inner product with a pivot table.

Vectors are scaled to integers, so scores are exact. Some dozens of vectors serve as pivots, and the distance of every
vector to each of them is computed once. For a query q and a candidate x, |d(q, p) - d(x, p)| bounds their distance
from below for every pivot p; the largest of these bounds gives an upper bound of the score,
(|q|^2 + |x|^2 - bound^2) / 2. Candidates are evaluated in the order of their bounds, in blocks, until no bound can
reach the k-th best score; nothing that could belong to the result is left out.

Queries go out in rounds of bounded size, each as one broadcast that every part of the candidates is searched for;
every part returns the k best it has for each query, and those are merged. With several rounds each is written before the
next begins, so that the driver holds one at a time.

Cases: vectors that are null or hold null or non-finite components take no part, nor do rows without an id; vectors of
unequal length are compared as if the shorter one ended in zeros; every row is a query or a candidate of its own: a
query's own row is left out, other rows that share its id or its vector are not, and repeated query rows have a list
each; ties go to the smaller id; an empty table gives no rows; other columns are not looked at. Vectors whose scores could
leave what a double holds exactly are scored with whole numbers of any size, without bounds; a score beyond a long is
ranked as a double and shown as the nearest long.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lithic.llm.common import batch_conf, save, table

PIVOTS, BLOCK, QUERIES, SEEDS = 32, 512, 4096, 1024
_LONG = (1 << 63) - 1


def scaled(vectors: list, width: int) -> np.ndarray:
    out = np.zeros((len(vectors), width))
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    with np.errstate(over="ignore"):
        return np.floor(256 * out)


def large(x: np.ndarray) -> np.ndarray:
    """Which rows are so large that a sum of products of two that aren't could leave what a double holds exactly."""
    return ~(np.abs(x).max(axis=1, initial=0) <= 2.0**26 / max(1, x.shape[1]) ** 0.5)


def whole(vectors: list, width: int) -> np.ndarray:
    """The scaled vectors as whole numbers of any size."""
    return np.array([[n * 256 // d for n, d in (float(c).as_integer_ratio() for c in v)] + [0] * (width - len(v)) for v in vectors], object).reshape(len(vectors), width)


def distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    square = (x**2).sum(axis=1)[:, None] + (pivots**2).sum(axis=1)[None] - 2 * x @ pivots.T
    return np.sqrt(np.maximum(square, 0))


class Search:
    """The k best candidates so far of each query of a round, over the batches of one part of the candidates."""

    def __init__(self, vectors: list, ids: np.ndarray, pivots: np.ndarray, k: int, floor: np.ndarray, width: int, block: int = BLOCK):
        """floor: scores that k candidates of the whole table are known to reach, or -inf; lower ones are dropped."""
        self.vectors, self.ids, self.pivots, self.k, self.block, self.width = vectors, ids, pivots, k, block, width
        self.q = scaled(vectors, width)
        self.large = large(self.q)
        self.q[self.large] = 0
        self.square, self.table, self.limit = (self.q**2).sum(axis=1), distances(self.q, pivots), floor.copy()
        self.best: list[list[tuple[int, int]]] = [[] for _ in ids]
        self.at = {i: np.flatnonzero(ids == i) for i in set(ids.tolist())}
        self.evaluated = 0
        self.own: set[tuple[int, int]] = set()  # (query, row of the batch) that are one row of the table

    def _keep(self, i: int, scores: list[int], ids: list[int]) -> None:
        self.best[i] = sorted([*self.best[i], *zip(scores, ids, strict=True)], key=lambda b: (-b[0], b[1]))[: self.k]
        if len(self.best[i]) == self.k:
            self.limit[i] = max(self.limit[i], float(self.best[i][-1][0]))

    def add(self, vectors: list, x_ids: np.ndarray) -> None:
        x = scaled(vectors, self.width)
        odd = large(x)
        for i, j in [(i, j) for j, n in enumerate(x_ids.tolist()) for i in self.at.get(n, ())]:
            # a query's own row, and rows equal to it: the caller knows how many there are
            if _trimmed(vectors[j]) == _trimmed(self.vectors[i]):
                self.own.add((i, j))
        self._exactly(vectors, x_ids, odd)
        plain = np.flatnonzero(~odd)
        if len(plain):
            self._bounded(x[plain], x_ids[plain], plain)
        self.own.clear()

    def _exactly(self, vectors: list, x_ids: np.ndarray, odd: np.ndarray) -> None:
        for queries, rows in ((np.flatnonzero(self.large), np.arange(len(odd))), (np.flatnonzero(~self.large), np.flatnonzero(odd))):
            if len(queries) and len(rows):
                scores = whole([self.vectors[i] for i in queries], self.width) @ whole([vectors[j] for j in rows], self.width).T
                for i, s in zip(queries.tolist(), scores, strict=True):
                    keep = [n for n, j in enumerate(rows.tolist()) if (i, j) not in self.own]
                    self._keep(i, [int(s[n]) for n in keep], x_ids[rows[keep]].tolist() if keep else [])

    def _bounded(self, x: np.ndarray, x_ids: np.ndarray, place: np.ndarray) -> None:
        table_, x_square = distances(x, self.pivots), (x**2).sum(axis=1)
        far = np.zeros((len(self.q), len(x)), np.float32)
        for p in range(self.pivots.shape[0]):  # the greatest lower bound of the distance that any pivot gives
            np.maximum(far, np.abs(self.table[:, p, None] - table_[None, :, p]), out=far, casting="same_kind")
        both = self.square[:, None] + x_square[None]
        # distances and their differences are rounded, so bounds give way by more than that; scores themselves are exact
        slack = 1e-6 * (both + (self.pivots**2).sum(axis=1).max(initial=0)) + 1
        bound = (both - far.astype(np.float64) ** 2) / 2 + slack
        bound[self.large] = -np.inf
        column = {int(j): n for n, j in enumerate(place)}
        for i, j in self.own:
            if j in column:
                bound[i, column[j]] = -np.inf
        for i in np.flatnonzero(bound.max(axis=1, initial=-np.inf) >= self.limit):
            own = np.flatnonzero((bound[i] >= self.limit[i]) & (bound[i] > -np.inf))
            order = own[np.argsort(-bound[i, own], kind="stable")]
            for a in range(0, len(order), self.block):
                part = order[a : a + self.block]
                if bound[i, part[0]] < self.limit[i]:  # no later one can reach the k-th best; an equal one could, by its id
                    break
                self.evaluated += len(part)
                s = x[part] @ self.q[i]
                keep = np.flatnonzero(s >= self.limit[i])
                if len(keep) > self.k:
                    keep = keep[np.lexsort((x_ids[part[keep]], -s[keep]))[: self.k]]
                self._keep(i, s[keep].astype(np.int64).tolist(), x_ids[part[keep]].tolist())

    def rows(self) -> pa.RecordBatch:
        """(query, vec_id, score, high): high orders scores beyond a long."""
        flat = [(i, n, max(-_LONG, min(_LONG, s)), float(s)) for i, best in enumerate(self.best) for s, n in best]
        cols = list(zip(*flat, strict=True)) or [(), (), (), ()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.float64()), strict=True)], ["query", "vec_id", "score", "high"])


def _trimmed(v: list) -> list:
    n = len(v)
    while n and v[n - 1] == 0:
        n -= 1
    return v[:n]


def top_k(vectors: DataFrame, queries: DataFrame, k: int, id_col: str = "vec_id", vector: str = "embedding", pivots: int = PIVOTS, per_round: int = QUERIES) -> DataFrame:
    """(query_id, rank, vec_id, score): for each query, a row of vectors, the k other rows with the highest scores."""
    spark = vectors.sparkSession
    batch_conf(spark)

    def valid(df: DataFrame) -> DataFrame:
        v = F.transform(F.col(f"`{vector}`"), lambda x: x.cast("double"))
        ok = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
        return df.select(F.col(f"`{id_col}`").cast("long").alias("id"), v.alias("v")).where(F.col("id").isNotNull() & F.col("v").isNotNull() & ok)

    cands = valid(vectors)
    # equal query rows are searched for once
    asks = save(valid(queries).groupBy("id", "v").agg(F.count("*").alias("times")))
    n_asks, width = asks.count(), max(cands.agg(F.max(F.size("v"))).first()[0] or 0, asks.agg(F.max(F.size("v"))).first()[0] or 0)
    # pivots: of those rows whose hashed ids come first, some of usual length; any rows are right, such ones prune well
    first = cands.orderBy(F.xxhash64("id"), "id").limit(SEEDS).collect()
    seeds, seed_ids = scaled([r.v for r in first], width), np.array([r.id for r in first], np.int64)
    seeds, seed_ids = seeds[~large(seeds)], seed_ids[~large(seeds)]
    length = (seeds**2).sum(axis=1)
    chosen = seeds[length <= 16 * np.median(length)][:pivots] if len(seeds) else seeds
    rounds, parts = -(-n_asks // per_round), []
    for r in range(rounds):
        some = asks.where(F.pmod(F.xxhash64("id", "v"), F.lit(rounds)) == r) if rounds > 1 else asks
        got = some.collect()  # about per_round vectors
        if not got:
            continue
        q, q_ids = scaled([x.v for x in got], width), np.array([x.id for x in got], np.int64)
        odd = large(q)
        # k rows of the table score what the k-th of some of them does, rows with the query's id aside
        reach = np.where(odd[:, None], 0, q) @ seeds.T
        reach[q_ids[:, None] == seed_ids[None]] = -np.inf
        floor = np.sort(reach, axis=1)[:, -k] if len(seeds) >= k else np.full(len(q), -np.inf)
        floor[odd] = -np.inf
        shared = spark.sparkContext.broadcast(([x.v for x in got], q_ids, chosen, floor))

        def find(batches, shared=shared):
            vectors_, ids, chosen_, floor_ = shared.value
            found = Search(vectors_, ids, chosen_, k, floor_, width)
            for b in batches:
                if b.num_rows:
                    found.add(b.column(1).to_pylist(), b.column(0).to_numpy(zero_copy_only=False))
            yield found.rows()

        found = cands.mapInArrow(find, "query long, vec_id long, score long, high double")
        # of rows equal to the query's one is its own; the others are candidates like any
        again = [(i, x.id, max(-_LONG, min(_LONG, s)), float(s)) for i, x in enumerate(got) if x.times > 1 for s in [int((whole([x.v], width) ** 2).sum())] for _ in range(min(k, x.times - 1))]
        if again:
            found = found.union(spark.createDataFrame(again, found.schema))
        asked = spark.createDataFrame([(i, x.id, x.times) for i, x in enumerate(got)], "query long, query_id long, times long")
        best = Window.partitionBy("query").orderBy(F.desc("high"), F.desc("score"), "vec_id")
        top = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).join(F.broadcast(asked), "query")
        top = top.select("query_id", "rank", "vec_id", "score", F.explode(F.sequence(F.lit(1).cast("long"), "times")).alias("_")).drop("_")
        if rounds > 1:
            top = save(top)
            shared.unpersist()
        parts.append(top)
    out = spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    for p in parts:
        out = out.union(p)
    return out


def op6_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return top_k(vectors, vectors.where("vec_id % 50 = 0"), 5)


ORACLE = """
with v as (
  select row_number() over () as row, vec_id, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as e from embeddings
  where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), s as (
  select q.row, q.vec_id as query_id, c.vec_id as vec_id,
         list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2]))::bigint as score
  from v q join v c on q.row <> c.row where q.vec_id % 50 = 0
)
select query_id, rank::int as rank, vec_id, score from (
  select *, row_number() over (partition by row order by score desc, vec_id) as rank from s) where rank <= 5
"""
