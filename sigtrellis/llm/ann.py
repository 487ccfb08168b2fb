"""Nearest neighbours by learned partitions.

On a bounded sample a graph of nearest neighbours is cut into balanced parts. A
small network learns which parts hold a vector's neighbours; it places every vector
of the table in its most probable part and sends every query to several. How many
is measured: the fewest that find ``TARGET`` of the true neighbours of sample rows.
The candidates of a part are dealt to blocks of bounded size by a hash of their id,
and queries to bounded blocks too, so that neither a large part nor many copies of
one vector meet in one task. Each block ranks its candidates by the exact cosine in
double precision; the best of all blocks are ranked once more.

Vectors that are null, zero, of another length than most of the sample, or that
hold null or non-finite components take no part, nor do rows without vec_id. Rows
that repeat a vec_id count once, with the nearest of their vectors. Ties go to the smaller vec_id. An
empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Vectors that the partitions are learned from, at most.
SAMPLE = 8192
NEIGHBOURS = 10
MOST_PARTS = 64
#: Share of the true neighbours that routing has to find within the sample.
TARGET = 0.97
#: Candidates and queries that meet in one task, about.
BLOCK, QUERY_BLOCK = 16_384, 4_096
_RESULT = "query_id long, vec_id long, score double"


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def graph(x: np.ndarray, k: int) -> np.ndarray:
    """The k nearest rows of each row of unit vectors."""
    out = np.empty((len(x), k), dtype=np.int64)
    for a in range(0, len(x), 1024):
        s = x[a : a + 1024] @ x.T
        s[np.arange(len(s)), np.arange(a, a + len(s))] = -np.inf
        out[a : a + 1024] = np.argpartition(-s, k - 1, axis=1)[:, :k]
    return out


def partition(x: np.ndarray, near: np.ndarray, parts: int, sweeps: int = 12, slack: float = 1.05) -> np.ndarray:
    """Parts of nearly equal size that cut few edges: halves along main directions, then moves with a gain."""
    part = np.zeros(len(x), dtype=np.int64)
    todo = [(np.arange(len(x)), 0, parts)]
    while todo:
        rows, first, count = todo.pop()
        if count == 1:
            part[rows] = first
            continue
        y = x[rows] - x[rows].mean(0)
        v = np.linspace(1.0, 2.0, x.shape[1])
        for _ in range(30):
            v = y.T @ (y @ v)
            v /= np.linalg.norm(v) or 1.0
        left = count // 2
        order = np.argsort(y @ v, kind="stable")
        cut = len(rows) * left // count
        todo += [(rows[order[:cut]], first, left), (rows[order[cut:]], first + left, count - left)]
    most = int(np.ceil(len(x) / parts * slack))
    least = int(len(x) / parts / slack)
    size = np.bincount(part, minlength=parts)
    a, b = np.repeat(np.arange(len(x)), near.shape[1]), near.ravel()
    for _ in range(sweeps):
        votes = np.zeros((len(x), parts))
        np.add.at(votes, (a, part[b]), 1.0)
        np.add.at(votes, (b, part[a]), 1.0)
        best = votes.argmax(1)
        gain = votes[np.arange(len(x)), best] - votes[np.arange(len(x)), part]
        moved = 0
        for i in np.argsort(-gain, kind="stable"):
            if gain[i] <= 0:
                break
            if size[best[i]] < most and size[part[i]] > least:
                size[part[i]] -= 1
                size[best[i]] += 1
                part[i] = best[i]
                moved += 1
        if not moved:
            break
    return part


@dataclass
class Router:
    """One hidden layer; scores of parts for unit vectors."""

    a: np.ndarray
    c: np.ndarray
    b: np.ndarray
    d: np.ndarray
    probes: int = 1

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return np.maximum(x @ self.a + self.c, 0.0) @ self.b + self.d


def train(x: np.ndarray, goal: np.ndarray, hidden: int = 128, epochs: int = 40, rate: float = 4e-3) -> Router:
    """Cross-entropy against the shares of neighbours in each part, by Adam."""
    rng = np.random.default_rng(7)
    dims, parts = x.shape[1], goal.shape[1]
    w = [rng.normal(0, (2 / dims) ** 0.5, (dims, hidden)), np.zeros(hidden), rng.normal(0, (1 / hidden) ** 0.5, (hidden, parts)), np.zeros(parts)]
    m, v = [np.zeros_like(p) for p in w], [np.zeros_like(p) for p in w]
    t = 0
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for s in range(0, len(x), 256):
            rows = order[s : s + 256]
            z = x[rows] @ w[0] + w[1]
            h = np.maximum(z, 0)
            o = h @ w[2] + w[3]
            p = np.exp(o - o.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            e = (p - goal[rows]) / len(rows)
            back = (e @ w[2].T) * (z > 0)
            t += 1
            for i, g in enumerate((x[rows].T @ back, back.sum(0), h.T @ e, e.sum(0))):
                m[i] = 0.9 * m[i] + 0.1 * g
                v[i] = 0.999 * v[i] + 0.001 * g * g
                w[i] -= rate * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)
    return Router(w[0], w[1], w[2], w[3])


def fit(x: np.ndarray, parts: int, found: int = 5, target: float = TARGET) -> Router:
    """Partitions of the sample and the router to them, with the number of probes it needs."""
    if parts < 2 or len(x) < 4 * parts:
        return Router(np.zeros((x.shape[1], 1)), np.zeros(1), np.zeros((1, 1)), np.zeros(1))
    near = graph(x, min(NEIGHBOURS, len(x) - 1))
    part = partition(x, near, parts)
    goal = np.zeros((len(x), parts))
    np.add.at(goal, (np.repeat(np.arange(len(x)), near.shape[1]), part[near.ravel()]), 1.0)
    goal[np.arange(len(x)), part] += 1.0
    goal /= goal.sum(1, keepdims=True)
    # the number of probes comes from rows that a first network hasn't learned from
    test = np.arange(len(x)) % 4 == 0
    trial = train(x[~test], goal[~test])
    placed = trial(x).argmax(1)
    rank = np.argsort(np.argsort(-trial(x[test]), axis=1, kind="stable"), axis=1, kind="stable")
    true = graph(x, min(found, len(x) - 1))[test]
    depth = np.sort(np.take_along_axis(rank, placed[true], axis=1).ravel())
    router = train(x, goal)
    router.probes = int(depth[min(len(depth) - 1, int(np.ceil(target * len(depth))) - 1)]) + 1
    return router


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_list()).astype(np.float64)


def _place(router: Router):
    @F.pandas_udf("int")
    def place(v: pd.Series) -> pd.Series:
        return pd.Series(router(unit(_matrix(v))).argmax(1) if len(v) else [], dtype="int32")

    return place


def _route(router: Router):
    @F.pandas_udf("array<int>")
    def route(v: pd.Series) -> pd.Series:
        order = np.argsort(-router(unit(_matrix(v))), axis=1, kind="stable")[:, : router.probes].astype(np.int32) if len(v) else []
        return pd.Series(list(order), dtype=object)

    return route


def best_of(queries: np.ndarray, ids: np.ndarray, vectors: np.ndarray, own: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each query its k best candidates: ids, each once with its nearest row, and exact cosines, ties to the smaller id."""
    order = np.argsort(ids, kind="stable")
    ids = ids[order]
    q, c = unit(queries), unit(vectors[order])
    first = np.flatnonzero(np.concatenate(([True], ids[1:] != ids[:-1])))
    for a in range(0, len(q), 256):
        rough = q[a : a + 256] @ c.T
        rough[ids[None, :] == own[a : a + 256, None]] = -np.inf
        best = np.maximum.reduceat(rough, first, axis=1)
        last = np.partition(best, max(0, best.shape[1] - k), axis=1)[:, max(0, best.shape[1] - k)]
        for i, (row, low) in enumerate(zip(rough, last)):
            # a product of matrices rounds differently at different places: what is near the last place is computed alike
            at = np.flatnonzero((row >= low - 1e-9) & (row > -np.inf))
            exact = (c[at] * q[a + i]).sum(axis=1)
            order = np.lexsort((ids[at], -exact))
            order = order[np.sort(np.unique(ids[at][order], return_index=True)[1])][:k]
            yield a + i, ids[at][order], exact[order]


def search(table: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", sample: int = SAMPLE) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k nearest rows found for every query, by cosine."""
    clean = lambda d: d.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v")).where(
        F.col("id").isNotNull() & F.forall("v", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf"))) & F.exists("v", lambda e: e != 0)
    )
    rows, asked = clean(table), clean(queries)
    drawn = rows.orderBy(F.xxhash64("id"), "id").limit(sample).toPandas()
    if not len(drawn):
        return table.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dims = int(drawn.v.str.len().mode().iloc[0])
    rows, asked = rows.where(F.size("v") == dims), asked.where(F.size("v") == dims).dropDuplicates(["id"])
    n = rows.count()
    x = unit(_matrix(drawn.v[drawn.v.str.len() == dims]))
    router = fit(x, min(MOST_PARTS, max(1, n // 100)), k)
    return _joined(rows, asked, router, k)


def _joined(rows: DataFrame, asked: DataFrame, router: Router, k: int) -> DataFrame:
    placed = rows.withColumn("part", _place(router)("v"))
    sizes = {r.part: r.n for r in placed.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row for each part
    share = max(1, asked.count() * router.probes // max(1, len(router.d)))
    cuts, turns = {p: -(-n // BLOCK) for p, n in sizes.items()}, -(-share // QUERY_BLOCK)
    cut = F.create_map(*[F.lit(x) for p, n in cuts.items() for x in (p, n)])
    candidates = placed.withColumn("block", F.pmod(F.xxhash64("id"), F.try_element_at(cut, F.col("part"))).cast("int")).withColumn("turn", F.explode(F.sequence(F.lit(0), F.lit(turns - 1))))
    sent = asked.withColumn("turn", F.pmod(F.xxhash64("id"), F.lit(turns)).cast("int")).withColumn("part", F.explode(_route(router)("v")))
    sent = sent.withColumn("cuts", F.try_element_at(cut, F.col("part"))).where(F.col("cuts").isNotNull()).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)))

    def meet(q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(c):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        own = q["id"].to_numpy()
        found = [(np.full(len(i), own[r]), i, s) for r, i, s in best_of(_matrix(q["v"]), c["id"].to_numpy(), _matrix(c["v"]), own, 2 * k)]
        return pd.DataFrame({"query_id": np.concatenate([f[0] for f in found]), "vec_id": np.concatenate([f[1] for f in found]), "score": np.concatenate([f[2] for f in found])})

    keys = ["part", "block", "turn"]
    met = sent.select(*keys, "id", "v").groupBy(*keys).cogroup(candidates.select(*keys, "id", "v").groupBy(*keys)).applyInPandas(meet, _RESULT)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return met.groupBy("query_id", "vec_id").agg(F.max("score").alias("score")).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
