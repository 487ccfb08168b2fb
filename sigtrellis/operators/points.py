"""Point-set learning. Points are rows ``id``, ``x`` (array of double) and, where labelled, ``label``.

Sums over points are Spark aggregates; what comes to the driver is a matrix of
dimensions or clusters, never points.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def distance2(a: Column, b: Column) -> Column:
    """Squared Euclidean distance of two arrays."""
    return F.aggregate(F.zip_with(a, b, lambda p, q: (p - q) * (p - q)), F.lit(0.0), lambda s, v: s + v)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)


def moments(points: DataFrame) -> tuple[int, np.ndarray, np.ndarray]:
    """Number, mean and covariance (over n), from one partial Gram matrix per batch."""

    def gram(batches):
        for batch in batches:
            if len(batch):
                x = np.stack(batch["x"].to_list())
                yield pd.DataFrame([{"n": len(x), "s": x.sum(0), "g": (x.T @ x).ravel()}])

    parts = points.select("x").where(F.col("x").isNotNull()).mapInPandas(gram, "n long, s array<double>, g array<double>")
    summed = parts.agg(F.sum("n").alias("n")).first()[0] or 0
    if not summed:
        return 0, np.zeros(0), np.zeros((0, 0))
    long = lambda c: parts.select(F.posexplode(c).alias("i", "v")).groupBy("i").agg(F.sum("v").alias("v")).orderBy("i").toPandas()["v"].to_numpy()
    mean = long("s") / summed
    return summed, mean, long("g").reshape(len(mean), -1) / summed - np.outer(mean, mean)


def _signed(vectors: np.ndarray) -> np.ndarray:
    """Columns with their entry of largest magnitude positive."""
    at = np.abs(vectors).argmax(0)
    return vectors * np.where(vectors[at, np.arange(vectors.shape[1])] < 0, -1.0, 1.0)


def pca(points: DataFrame, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Mean, components (rows) and their shares of the variance."""
    _, mean, cov = moments(points)
    values, vectors = np.linalg.eigh(cov)
    values, vectors = np.clip(values[::-1], 0, None), _signed(vectors[:, ::-1])
    return mean, vectors[:, :k].T, values[:k] / (values.sum() or 1.0)


def project(points: DataFrame, mean: np.ndarray, components: np.ndarray, out: str = "y") -> DataFrame:
    """points with the coordinates along each component; a row at a time, in the JVM."""
    centred = F.zip_with("x", F.array(*[F.lit(float(m)) for m in mean]), lambda a, b: a - b)
    rows = F.array(*[F.array(*[F.lit(float(c)) for c in r]) for r in components])
    return points.withColumn(out, F.transform(F.array(centred), lambda c: F.transform(rows, lambda r: dot(c, r)))[0])


def zca(covariance: np.ndarray, epsilon: float = 1e-6) -> np.ndarray:
    """U (L + epsilon)^-1/2 U'."""
    values, vectors = np.linalg.eigh(covariance)
    return (vectors / np.sqrt(np.clip(values, 0, None) + max(epsilon, 1e-12))) @ vectors.T


def local_zca(covariance: np.ndarray, neighbours: Sequence[Sequence[int]], epsilon: float = 1e-6) -> np.ndarray:
    """Whitening in which a channel uses its neighbours (itself among them) only."""
    out = np.zeros_like(covariance)
    for i, near in enumerate(neighbours):
        near = list(near)
        out[i, near] = zca(covariance[np.ix_(near, near)], epsilon)[near.index(i)]
    return out


def _assign(points: DataFrame, centres: np.ndarray) -> DataFrame:
    """points with label and d2 to the nearest centre, ties to the lower."""

    def nearest(batches):
        for batch in batches:
            m = np.stack(batch["x"].to_list()) if len(batch) else np.zeros((0, centres.shape[1]))
            d = np.stack([((m - c) ** 2).sum(1) for c in centres], axis=1)
            at = d.argmin(1)
            yield batch.assign(label=at.astype("int32"), d2=d[np.arange(len(d)), at])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in points.schema)
    return points.mapInPandas(nearest, f"{kinds}, label int, d2 double")


def cluster_sums(points: DataFrame) -> DataFrame:
    """label, n, place, sum: what a Lloyd step needs; combined before the shuffle."""
    return points.select("label", F.posexplode("x").alias("place", "v")).groupBy("label", "place").agg(F.count("v").alias("n"), F.sum("v").alias("sum"))


def kmeans(points: DataFrame, centres: np.ndarray, rounds: int = 300, tolerance: float = 1e-4) -> tuple[DataFrame, np.ndarray]:
    """Lloyd's algorithm from given centres; an empty cluster moves to the point farthest from its centre. Labelled points and the centres."""
    plain = points.select("id", "x")
    n, _, cov = moments(plain)
    limit = tolerance * (np.trace(cov) / max(1, cov.shape[0]) if n else 0.0)
    centres = np.array(centres, float)
    for _ in range(rounds):
        labelled = _assign(plain, centres)
        sums = cluster_sums(labelled).toPandas()
        new = centres.copy()
        wide = sums.pivot(index="label", columns="place", values="sum")
        counts = sums.groupby("label")["n"].first()
        new[wide.index.to_numpy()] = wide.to_numpy() / counts.loc[wide.index].to_numpy()[:, None]
        lost = [i for i in range(len(centres)) if i not in counts.index]
        if lost:
            for i, r in zip(lost, labelled.orderBy(F.desc("d2"), "id").limit(len(lost)).collect()):
                new[i] = r.x
        moved = ((new - centres) ** 2).sum()
        centres = new
        if moved <= limit:
            break
    return _assign(plain, centres), centres


def seeds(points: DataFrame, k: int, sample: int = 4096) -> np.ndarray:
    """k-means++ centres from a bounded sample, the rows of least hash."""
    x = np.stack(points.orderBy(F.xxhash64("id"), "id").limit(sample).toPandas()["x"].to_list())
    rng = np.random.default_rng(3)
    out = [x[rng.integers(len(x))]]
    d = ((x - out[0]) ** 2).sum(1)
    while len(out) < k:
        out.append(x[rng.choice(len(x), p=d / d.sum())] if d.sum() else x[len(out) % len(x)])
        d = np.minimum(d, ((x - out[-1]) ** 2).sum(1))
    return np.stack(out)


def gmm(points: DataFrame, means: np.ndarray, rounds: int = 50, floor: float = 1e-6, tolerance: float = 1e-6) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Expectation maximisation of a mixture with diagonal covariances: weights, means, variances, BIC. Sums come per batch."""
    k, d = means.shape
    n, _, cov = moments(points)
    w, m, v = np.full(k, 1 / k), np.array(means, float), np.tile(np.maximum(np.diag(cov), floor), (k, 1))
    last = -np.inf
    for _ in range(rounds):
        now = (w.copy(), m.copy(), v.copy())

        def expect(batches, now=now):
            w, m, v = now
            for batch in batches:
                if len(batch):
                    x = np.stack(batch["x"].to_list())
                    logs = np.log(w) - 0.5 * (np.log(2 * np.pi * v).sum(1) + (((x[:, None, :] - m) ** 2) / v).sum(2))
                    top = logs.max(1, keepdims=True)
                    like = top[:, 0] + np.log(np.exp(logs - top).sum(1))
                    r = np.exp(logs - like[:, None])
                    yield pd.DataFrame([{"s": np.concatenate([[like.sum()], r.sum(0), (r.T @ x).ravel(), (r.T @ (x * x)).ravel()])}])

        sums = points.select("x").mapInPandas(expect, "s array<double>").select(F.posexplode("s").alias("i", "v")).groupBy("i").agg(F.sum("v").alias("v")).orderBy("i").toPandas()["v"].to_numpy()
        like, r = sums[0], np.maximum(sums[1 : 1 + k], 1e-12)
        w, m = r / r.sum(), sums[1 + k : 1 + k + k * d].reshape(k, d) / r[:, None]
        v = np.maximum(sums[1 + k + k * d :].reshape(k, d) / r[:, None] - m * m, floor)
        if like - last < tolerance * abs(like):
            break
        last = like
    return w, m, v, float(-2 * like + (2 * k * d + k - 1) * np.log(n))


def nearest(queries: DataFrame, points: DataFrame, k: int, blocks: int = 1) -> DataFrame:
    """query, id, d2, rank: exact nearest points other than the query itself, ties to the lower id.

    Points are dealt to blocks; each block ranks its own for all queries, and the best of all blocks are ranked again.
    """
    q = queries.select(F.col("id").alias("query"), F.col("x").alias("_q"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("_b"))
    p = points.select("id", "x", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("_b"))

    def rank(qs: pd.DataFrame, ps: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(qs) and len(ps):
            x, ids = np.stack(ps["x"].to_list()), ps["id"].to_numpy()
            for i, v in zip(qs["query"], qs["_q"]):
                d = ((x - np.asarray(v)) ** 2).sum(1)
                order = np.lexsort((ids, d))
                order = order[ids[order] != i][:k]
                out += [(i, ids[j], d[j]) for j in order]
        return pd.DataFrame(out, columns=["query", "id", "d2"])

    met = q.groupBy("_b").cogroup(p.groupBy("_b")).applyInPandas(rank, "query long, id long, d2 double")
    w = Window.partitionBy("query").orderBy("d2", "id")
    return met.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def centroids(points: DataFrame) -> DataFrame:
    """label, n, c: mean of each label's points."""
    long = points.select("label", F.posexplode("x").alias("i", "v")).groupBy("label", "i").agg(F.avg("v").alias("v"), F.count("v").alias("n"))
    return long.groupBy("label").agg(F.first("n").alias("n"), F.array_sort(F.collect_list(F.struct("i", "v"))).alias("a")).select("label", "n", F.transform("a", lambda e: e["v"]).alias("c"))


def centroid_similarity(points: DataFrame) -> DataFrame:
    """a, b, cosine of the mean vectors of every two labels."""
    c = centroids(points).select("label", "c")
    # labels against labels: a table of clusters, not of points
    pairs = c.select(F.col("label").alias("a"), F.col("c").alias("x")).join(c.select(F.col("label").alias("b"), F.col("c").alias("y")), F.col("a") < F.col("b"))
    return pairs.select("a", "b", (dot(F.col("x"), F.col("y")) / F.sqrt(dot(F.col("x"), F.col("x")) * dot(F.col("y"), F.col("y")))).alias("cosine"))


def merge_suggestions(similarity: DataFrame, least: float) -> DataFrame:
    return similarity.where(F.col("cosine") >= least)


def d_prime(points: DataFrame, target: int) -> DataFrame:
    """One row: separation of a label from all others along the axis of pooled diagonal variances."""
    long = points.select((F.col("label") == target).alias("mine"), F.posexplode("x").alias("i", "v"))
    stats = long.groupBy("i").agg(
        *[f(F.when(F.col("mine") == own, F.col("v"))).alias(n) for n, f, own in (("m1", F.avg, True), ("v1", F.var_pop, True), ("m0", F.avg, False), ("v0", F.var_pop, False))]
    )
    w = (F.col("m1") - F.col("m0")) / ((F.col("v1") + F.col("v0")) / 2 + 1e-12)
    axis = stats.agg(F.array_sort(F.collect_list(F.struct("i", w.alias("w")))).alias("a")).select(F.transform("a", lambda e: e["w"]).alias("axis"))
    # the axis is one row of as many numbers as dimensions
    y = points.crossJoin(F.broadcast(axis)).select((F.col("label") == target).alias("mine"), dot(F.col("x"), F.col("axis")).alias("y"))
    g = y.agg(*[f(F.when(F.col("mine") == own, F.col("y"))).alias(n) for n, f, own in (("m1", F.avg, True), ("v1", F.var_pop, True), ("m0", F.avg, False), ("v0", F.var_pop, False))])
    return g.select(((F.col("m1") - F.col("m0")) / F.sqrt((F.col("v1") + F.col("v0")) / 2)).alias("d_prime"))


def isolation_distance(points: DataFrame, target: int) -> DataFrame:
    """One row: diagonal Mahalanobis distance of the n-th nearest outsider, n the target's size (or the outsiders', if fewer)."""
    long = points.where(F.col("label") == target).select(F.posexplode("x").alias("i", "v")).groupBy("i").agg(F.avg("v").alias("m"), F.var_samp("v").alias("s"), F.count("v").alias("n"))
    model = long.agg(F.array_sort(F.collect_list(F.struct("i", "m", "s"))).alias("a"), F.max("n").alias("n"))
    d2 = F.aggregate(F.zip_with("x", "a", lambda v, e: (v - e["m"]) * (v - e["m"]) / F.greatest(e["s"], F.lit(1e-12))), F.lit(0.0), lambda s, v: s + v)
    out = points.where(F.col("label") != target).crossJoin(F.broadcast(model)).select(d2.alias("d2"), "n")
    count = out.count()
    ranked = out.orderBy("d2").limit(max(1, min(count, points.where(F.col("label") == target).count())))
    return ranked.agg(F.max("d2").alias("isolation_distance"))


def silhouette(points: DataFrame) -> DataFrame:
    """id, label, s: simplified silhouette by distances to centroids; one pass, in the number of labels per point."""
    c = centroids(points).select(F.col("label").alias("other"), "c")
    # labels' centroids: clusters, not points
    d = points.join(c, how="cross").select("id", "label", "other", F.sqrt(distance2(F.col("x"), F.col("c"))).alias("d"))
    ab = d.groupBy("id", "label").agg(F.min(F.when(F.col("other") == F.col("label"), F.col("d"))).alias("a"), F.min(F.when(F.col("other") != F.col("label"), F.col("d"))).alias("b"))
    return ab.select("id", "label", ((F.col("b") - F.col("a")) / F.greatest("a", "b")).alias("s"))


def density_peaks(points: DataFrame, dc: float, k: int) -> DataFrame:
    """id, rho, delta, centre of points: density, distance to the nearest denser point, and whether it is among the top k by their product.

    All distances are needed; meant for summaries of up to some ten thousand points.
    """
    a, b = points.select("id", "x"), points.select(F.col("id").alias("j"), F.col("x").alias("y"))
    d = a.join(b, F.col("id") != F.col("j")).select("id", "j", distance2(F.col("x"), F.col("y")).alias("d2"))
    rho = d.groupBy("id").agg(F.sum(F.exp(-F.col("d2") / (dc * dc))).alias("rho"))
    rated = d.join(rho, "id").join(rho.select(F.col("id").alias("j"), F.col("rho").alias("rho_j")), "j")
    denser = (F.col("rho_j") > F.col("rho")) | ((F.col("rho_j") == F.col("rho")) & (F.col("j") < F.col("id")))
    delta = rated.groupBy("id", "rho").agg(F.sqrt(F.min(F.when(denser, F.col("d2")))).alias("delta"))
    top = delta.agg((1.1 * F.greatest(F.max("delta"), F.lit(1e-4))).alias("top"))
    full = delta.crossJoin(F.broadcast(top)).select("id", "rho", F.coalesce("delta", "top").alias("delta"))
    w = Window.orderBy((F.col("rho") * F.col("delta")).desc(), "id")
    return full.withColumn("centre", F.row_number().over(w) <= k)


def centre_of_mass(amplitudes: DataFrame, sites: DataFrame, power: float = 1.0) -> DataFrame:
    """unit, x, y, z: site positions weighted by amplitude^power. amplitudes: unit, ch, amp; sites: ch, x, y, z."""
    w = F.pow(F.abs("amp"), F.lit(power))
    joined = amplitudes.join(sites, "ch").withColumn("w", w)
    mean = lambda c: F.when(F.sum("w") > 0, F.sum(F.col("w") * F.col(c)) / F.sum("w")).otherwise(F.min_by(c, "ch")).alias(c)
    return joined.groupBy("unit").agg(mean("x"), mean("y"), mean("z"))


def haar(x: Column, levels: int, size: int) -> Column:
    """Haar coefficients of arrays of a size, coarsest first."""
    details: list[Column] = []

    def halves(values: Column, sign: int) -> Column:
        return F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: (F.get(values, 2 * i) + F.get(values, 2 * i + 1) * sign) * 0.5**0.5)

    for _ in range(levels):
        size //= 2
        if size < 1:
            break
        details.insert(0, halves(x, -1))
        x = halves(x, 1)
    return F.concat(x, *details) if details else x


def select_by_iqr(points: DataFrame, d: int) -> DataFrame:
    """place, iqr of the d coordinates of largest interquartile range."""
    spread = points.select(F.posexplode("x").alias("place", "v")).groupBy("place").agg((F.percentile("v", 0.75) - F.percentile("v", 0.25)).alias("iqr"))
    return spread.orderBy(F.desc("iqr"), "place").limit(d)


def subsample(rows: DataFrame, n: int, seed: int = 0, per: str | None = None, key: str = "id") -> DataFrame:
    """n rows, of each group if ``per`` is given, by least seeded hash; the same rows for the same seed."""
    h = F.xxhash64(F.lit(seed), F.col(key))
    if per is None:
        return rows.orderBy(h, key).limit(n)
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(per).orderBy(h, key))).where(F.col("_r") <= n).drop("_r")


def drift(spikes: DataFrame, depth_bin: float, depth_bins: int, time_bins: int, samples: int) -> DataFrame:
    """time_bin, drift of spikes (s, depth, amp): lag of each depth histogram against the first one, with a parabola through the best lag.

    The histogram is a Spark aggregate of time by depth cells; only its cells come to the driver.
    """
    t = F.least(F.floor(F.col("s") * time_bins / samples), F.lit(time_bins - 1)).cast("int")
    z = F.greatest(F.least(F.floor(F.col("depth") / depth_bin), F.lit(depth_bins - 1)), F.lit(0)).cast("int")
    cells = spikes.groupBy(t.alias("t"), z.alias("z")).agg(F.sum(F.log1p(F.abs("amp"))).alias("w")).toPandas()
    h = np.zeros((time_bins, depth_bins))
    h[cells["t"], cells["z"]] = cells["w"]
    h[:, 1:-1] = 0.25 * h[:, :-2] + 0.5 * h[:, 1:-1] + 0.25 * h[:, 2:]
    full = np.flatnonzero(h.sum(1) > 0)
    out, last = [], 0.0
    lags = np.arange(-depth_bins + 1, depth_bins)
    for i in range(time_bins):
        if len(full) and h[i].sum() > 0:
            c = np.correlate(h[i], h[full[0]], "full")
            j = int(c.argmax())
            bend = c[j - 1] - 2 * c[j] + c[j + 1] if 0 < j < len(c) - 1 else 0.0
            last = float((lags[j] + (0.5 * (c[j - 1] - c[j + 1]) / bend if bend else 0.0)) * depth_bin)
        out.append((i, last))
    return spikes.sparkSession.createDataFrame(out, "time_bin int, drift double")
