"""Sequential metrics against plain loops, and learning on points with a known answer."""

import tracemalloc

import numpy as np

from sigtrellis.functions import trains
from sigtrellis.operators import clusters, points
from sigtrellis.plans import curation


def two_pointer(a, b, tolerance):
    i = j = n = 0
    while i < len(a) and j < len(b):
        if abs(a[i] - b[j]) <= tolerance:
            n, i, j = n + 1, i + 1, j + 1
        elif a[i] < b[j]:
            i += 1
        else:
            j += 1
    return n


def test_train_matching_equals_two_pointers(spark):
    rng = np.random.default_rng(4)
    a, b = (sorted(set(rng.integers(0, 400, 90).tolist())) for _ in range(2))
    rows = lambda x: spark.createDataFrame([(1, s) for s in x], "unit long, s long")
    got = trains.match_trains(rows(a), rows(b), 3).first()
    assert got.matches == two_pointer(a, b, 3)


def test_duplicates_after_a_kept_spike_go(spark):
    x = [0, 2, 4, 6, 20, 21]
    got = trains.duplicate_spikes(spark.createDataFrame([(1, s) for s in x], "unit long, s long"), 3).orderBy("s").collect()
    assert [r.s for r in got] == [0, 4, 20]


def test_greedy_units_are_one_to_one(spark):
    scores = spark.createDataFrame([(1, 1, 0.9), (1, 2, 0.8), (2, 1, 0.7), (2, 2, 0.1)], "unit_a int, unit_b int, agreement double")
    assert {(r.unit_a, r.unit_b) for r in trains.greedy_units(scores).collect()} == {(1, 1), (2, 2)}


def test_greedy_units_plan_does_not_grow_with_the_rounds(spark):
    # a chain of falling agreement, of which each round takes one pair
    chain = [(i, j, 1 - 0.05 * (i + j)) for i in range(5) for j in (i - 1, i) if j >= 0]
    got = trains.greedy_units(spark.createDataFrame(chain, "unit_a int, unit_b int, agreement double"))
    assert {(r.unit_a, r.unit_b) for r in got.collect()} == {(i, i) for i in range(5)}
    assert len(got._jdf.queryExecution().analyzed().toString().splitlines()) < 10


def cloud(spark):
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(0, 1, (60, 3)), rng.normal(8, 1, (40, 3))])
    return x, spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, x array<double>")


def test_pca_and_moments(spark):
    x, df = cloud(spark)
    n, mean, cov = points.moments(df)
    assert n == 100 and np.allclose(mean, x.mean(0)) and np.allclose(cov, np.cov(x.T, bias=True))
    mean, components, share = points.pca(df, 2)
    y = np.array([r.y for r in points.project(df, mean, components).orderBy("id").collect()])
    assert np.allclose(y, (x - mean) @ components.T) and share[0] > 0.8


def test_kmeans_and_gmm_find_both_clouds(spark):
    x, df = cloud(spark)
    labels, _ = points.kmeans(df, points.seeds(df, 2))
    found = np.array([r.label for r in labels.orderBy("id").collect()])
    assert len(set(found[:60])) == len(set(found[60:])) == 1 and found[0] != found[99]
    w, m, _, _ = points.gmm(df, points.seeds(df, 2), rounds=15)
    assert np.allclose(sorted(w), [0.4, 0.6], atol=1e-3) and abs(np.sort(m[:, 0]) - [0, 8]).max() < 0.6


def test_zca_makes_the_identity(spark):
    x, df = cloud(spark)
    _, _, cov = points.moments(df)
    m = points.zca(cov, 1e-12)
    assert np.allclose(m @ cov @ m.T, np.eye(3), atol=1e-6)


def test_nearest_of_all_groups_with_ties(spark):
    x = np.random.default_rng(5).integers(0, 4, (150, 2)).astype(float)
    rows, n = clusters.numbered(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, x array<double>"))
    for group in (7, 64, 1000):
        got = {r["_at"]: list(r["near"]) for r in clusters.neighbours(rows, n, 5, group).collect()}
        d = ((x[:, None] - x) ** 2).sum(2)
        assert got == {i: [j for j in np.lexsort((np.arange(n), d[i])) if j != i][:5] for i in range(n)}


def test_communities_come_from_all_points(spark):
    """Threes of near points, more than any sample held: with some left out, threes would fall to others."""
    df = spark.range(20_400).selectExpr("id", "array(10.0D * (id div 3) + id % 3, 0.0D) as x")
    got = clusters.label_propagation(df, 2).groupBy("label").agg({"id": "max", "label": "count"}).toDF("label", "last", "n").collect()
    assert len(got) == 6_800 and {r.n for r in got} == {3} and all(r.last == 3 * r.label + 2 for r in got)


def test_ica_fits_on_all_points(spark):
    x = np.random.default_rng(6).laplace(size=(20_500, 2)) @ np.array([[2.0, 1.0], [0.5, 1.0]])
    values, vectors = np.linalg.eigh(np.cov(x.T, bias=True))
    white = (vectors[:, ::-1] / np.sqrt(values[::-1])).T
    z, w = (x - x.mean(0)) @ white.T, np.array([1.1, 0.1])
    for _ in range(100):
        u = z @ w
        new = (z * np.tanh(u)[:, None]).mean(0) - (1 - np.tanh(u) ** 2).mean() * w
        new /= np.linalg.norm(new)
        w, last = new, w
        if abs(abs(w @ last) - 1) < 1e-6:
            break
    got = clusters.fast_ica(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, x array<double>"), 2)
    assert np.allclose(got[0], w @ white, atol=1e-8)


def test_driver_gets_links_not_distances(spark):
    df = spark.range(4_000).selectExpr("id", "array(sin(id), cos(3 * id), sin(7 * id)) as x")
    tracemalloc.start()
    clusters.label_propagation(df, 5).collect()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 40e6


def test_points_without_coordinates_have_no_label_or_their_own(spark):
    rows = [(0, [0.0]), (1, [1.0]), (2, None), (3, [float("nan")]), (4, [50.0]), (5, [51.0])]
    got = {r.id: r.label for r in clusters.label_propagation(spark.createDataFrame(rows, "id long, x array<double>"), 1).collect()}
    assert got == {0: 0, 1: 0, 2: None, 3: 1, 4: 2, 5: 2}
    alone = spark.createDataFrame([(1, [float("nan")]), (2, [float("nan")])], "id long, x array<double>")
    assert sorted(r.label for r in clusters.label_propagation(alone).collect()) == [0, 1]
    assert [r.label for r in clusters.label_propagation(alone.limit(1)).collect()] == [0]
    assert clusters.label_propagation(alone.limit(0)).collect() == []


def test_curation_replays_and_undoes(spark):
    spikes = spark.createDataFrame([(u, s) for u in (1, 2, 3) for s in range(u)], "unit long, s long")
    units = spark.createDataFrame([(1, "unsorted"), (2, "unsorted"), (3, "unsorted")], "unit long, label string")
    log = curation.Log().push("label", unit=1, name="SU").push("merge", units=[2, 3])
    u, s = curation.replay(units, spikes, curation.Log.loads(log.dumps()))
    assert {(r.unit, r.label) for r in u.collect()} == {(1, "good"), (4, "unsorted")}
    assert s.where("unit = 4").count() == 5
    log.undo()
    u, _ = curation.replay(units, spikes, log)
    assert u.count() == 3
    log.redo()
    log.push("unmerge", unit=4)
    u, s = curation.replay(units, spikes, log)
    assert u.count() == 3 and s.where("unit = 2").count() == 2
