import numpy as np
import pytest
from pyspark.sql import functions as F

from skeinflow.domain import cluster, curves, eye, spikes, trajectory, tuning
from skeinflow.functions import noise
from skeinflow.operators import signal


def test_dbscan_matrix():
    d = np.full((9, 9), 2.0)
    for lo in (0, 3, 6):
        d[lo : lo + 3, lo : lo + 3] = 0.1
    np.fill_diagonal(d, 0)
    assert cluster.dbscan_labels(d) == [1, 1, 1, 2, 2, 2, 3, 3, 3]
    assert cluster.dbscan_labels(np.array([[0.0, 9], [9, 0]])) == [0, 0]


def test_dbscan_grid_matches(spark):
    rng = np.random.default_rng(2)
    xy = np.vstack([rng.normal(c, 0.15, (40, 2)) for c in ((0, 0), (2, 2), (0, 3))] + [rng.uniform(-2, 5, (30, 2))])
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(xy)], "k long, x double, y double")
    got = {r.k: r.cluster for r in cluster.dbscan(df, "k", "x", "y", 0.3, 4).collect()}
    d = np.hypot(xy[:, None, 0] - xy[None, :, 0], xy[:, None, 1] - xy[None, :, 1])
    want = cluster.dbscan_labels(d, 0.3, 4)
    core = (d <= 0.3).sum(axis=1) >= 4
    assert {i for i, w in enumerate(want) if w == 0} == {i for i, c in got.items() if c == 0}
    pairs = {(want[i], got[i]) for i in range(len(xy)) if core[i]}
    assert len(pairs) == len({p[0] for p in pairs}) == len({p[1] for p in pairs})


def test_dtw():
    a = np.array([[x, 2] for x in range(5)], dtype=float)
    b = np.array([[x, 0] for x in range(5)], dtype=float)
    assert cluster.dtw_distance(a, b) == 10 and cluster.dtw_distance(a, a) == 0
    rng = np.random.default_rng(0)
    p, q = rng.normal(size=(6, 2)), rng.normal(size=(4, 2))

    def slow(i, j):
        c = np.hypot(*(p[i] - q[j]))
        if i == j == 0:
            return c
        return c + min(slow(a, b) for a, b in ((i - 1, j), (i, j - 1), (i - 1, j - 1)) if a >= 0 and b >= 0)

    assert cluster.dtw_distance(p, q) == pytest.approx(slow(5, 3))


def test_eye():
    t = np.arange(400) * 0.004
    h = np.where(t < 0.6, 0, np.minimum((t - 0.6) * 250, 8.0))
    v = np.zeros(400)
    s = eye.saccades(h, v, t, np.zeros(400, bool))
    assert len(s) == 1 and s[0]["amp"] == pytest.approx(8, abs=0.2) and abs(s[0]["start"] - 150) <= 2
    state, _, _, fix = eye.classify(h, v, t, np.zeros(400, bool))
    assert len(fix) == 2 and state[155] == eye.SAC
    drift = np.concatenate([np.zeros(100), np.arange(200) * 0.004 * 10, np.full(100, 8.0)])
    p = eye.pursuit(drift, v, t, np.zeros(400, int))
    assert len(p) == 1 and p[0]["vel"] == pytest.approx(10, rel=0.1) and abs(p[0]["dir"]) < 1
    blink = np.zeros(50, bool)
    blink[10:15] = True
    pupil = np.concatenate([np.full(10, 5.0), np.zeros(5), np.linspace(0, 30, 10), np.full(25, 30.0)])
    out = eye.extend_blink(blink, pupil)
    assert out[15:24].all() and not out[26:].any()
    g = np.array([[x, y] for x in (-1, 0, 1) for y in (-1, 0, 1)], dtype=float)
    cx, cy = eye.fit_biquadratic(g[:, 0], g[:, 1], 2 * g[:, 0] + 1, g[:, 1] ** 2)
    assert cx == pytest.approx([1, 2] + [0] * 7, abs=1e-9) and cy[4] == pytest.approx(1)


def test_densities():
    s = signal.density(np.array([50.0]), 0, 100, 5.0)
    assert len(s) == 101 and s.argmax() == 50 and s.sum() + s[50] == pytest.approx(1)
    assert signal.density(np.array([]), 0, 10, 2.0).tolist() == [0] * 11
    a = signal.adaptive(np.array([20.0, 21, 22, 80]), 0, 100, 5.0)
    assert a[21] > a[80] > 0
    f, p = signal.spectrum(np.sin(2 * np.pi * 8 * np.arange(128) / 128), 128.0)
    assert f[p.argmax()] == pytest.approx(8, abs=1)
    x = np.random.default_rng(1).normal(size=256)
    _, c, _ = signal.coherence(x, 2 * x, 256.0)
    assert c[1:-1] == pytest.approx(1)


def test_curves(spark):
    sq = np.array([[0, 0], [4, 0], [4, 4], [0, 4]], dtype=float)
    other = sq + [2, 1]
    area = lambda rings: sum(abs(curves._area(r)) for r in rings)
    assert area(curves.combine(sq, other, "intersection")) == pytest.approx(6)
    assert area(curves.combine(sq, other, "union")) == pytest.approx(26)
    assert area(curves.combine(sq, other, "difference")) == pytest.approx(10)
    assert area(curves.combine(sq, other, "xor")) == pytest.approx(20)
    assert abs(curves._area(curves.offset(sq, 1.0))) == pytest.approx(36)
    line = curves.cubic_points(np.array([[0, 0], [1, 1], [2, 2.0]]), 4)
    assert line[:, 0] == pytest.approx(line[:, 1]) and len(line) == 9
    assert curves.bezier_points(np.array([[0, 0], [1, 2], [2, 0.0]]), 3)[1] == pytest.approx([1, 1])
    p = curves.pick_points(30, (0, 10, 0, 10), 0.8, seed=4)
    d = np.hypot(p[:, None, 0] - p[None, :, 0], p[:, None, 1] - p[None, :, 1])
    assert len(p) == 30 and d[np.triu_indices(30, 1)].min() >= 0.8
    df = spark.createDataFrame([([(0.0, 0.0), (4.0, 0.0), (4.0, 4.0)], 3.0, 2.0), ([(0.0, 0.0), (2.0, 2.0), (2.0, 0.0), (0.0, 2.0)], 0.0, 1.0)], "p array<struct<x: double, y: double>>, x double, y double")
    got = df.select(curves.closest_segment(F.col("p"), F.col("x"), F.col("y")).alias("s"), curves.self_intersects(F.col("p")).alias("i")).collect()
    assert [r.i for r in got] == [False, True] and got[0].s == 2 or got[0].s == 1


def test_trajectories(spark):
    df = spark.createDataFrame([([(0.0, 0.0), (1.0, 0.0), (2.0, 0.0), (2.0, 1.0)],)], "p array<struct<x: double, y: double>>")
    assert df.select(trajectory.turns("p").alias("t")).first().t == [(2.0, 0.0)]
    pts = spark.createDataFrame([(2.0, 3.0), (7.0, 7.0)], "x double, y double")
    g = trajectory.kde(pts, (0, 10, 0, 10), 10, 10, 1.0)
    assert g.count() == 100 and g.agg(F.sum("density")).first()[0] == pytest.approx(1, abs=0.05)
    assert trajectory.spatial_correlation(g, g).first()[0] == pytest.approx(1)
    assert trajectory.compare(g, g).agg(F.max(F.abs("difference"))).first()[0] == 0
    path = trajectory.resample(np.array([[0, 0], [3, 0], [3, 4.0]]), 1.0)
    assert path[3] == pytest.approx([3, 0]) and path[-1] == pytest.approx([3, 4])
    o = spark.createDataFrame([(5.0, 5.0, 4.0, 2.0, 0.0)], "x double, y double, w double, h double, rotation double")
    top = trajectory.object_density(o, (0, 10, 0, 10), 10, 10).orderBy(F.desc("density")).first()
    assert top.gx in (4, 5) and top.gy in (4, 5)


def test_tuning(spark):
    df = spark.createDataFrame([("a", 1.0, 0), ("a", 2.0, 1), ("a", 2.0, 0), ("a", 3.0, 1)], "k string, s double, y int")
    assert tuning.roc_area(df, ["k"], "s", "y").first().area == pytest.approx(0.875)
    r = spark.createDataFrame([("a", t, v) for t, v in enumerate((10.0, 0.0, 0.0, 0.0))], "k string, tag int, r double")
    s = tuning.selectivity(r, ["k"]).first()
    assert (s.best_worst, s.depth, s.sparseness, s.breadth) == (1.0, 1.0, 0.25, 1.0) and s.ranked_area == pytest.approx(0.875)
    assert tuning.wilcoxon_p(np.arange(20.0), np.arange(20.0) + 30) < 0.001


def test_spikes(spark):
    tr = spark.createDataFrame([(0, 0, 1), (1, 0, 2), (2, 1, 3)], "trial int, obs int, x int")
    sp = spark.createDataFrame([(0, 1.5, 3, 0.1), (0, 0.5, 2, 0.2)], "obs int, time double, unit int, depth double")
    got = spikes.add_spikes(tr, sp, "obs", "trial").orderBy("trial").collect()
    assert [(r.spike_times, r.spike_src_trial) for r in got] == [([0.5, 1.5], 0), ([], 0), ([], 2)]
    x = spark.createDataFrame([("g", 0, [1.0, 5.0], [2.0, 6.0]), ("g", 1, [3.0], [4.0])], "g string, k int, a array<double>, b array<double>")
    c = {r.lag: r.raw for r in spikes.cross_correlogram(x, ["g"], "k", "a", "b", 10, 2).collect()}
    assert max(c, key=c.get) == 1


def test_noise():
    p = np.random.default_rng(0).uniform(-20, 20, (500, 2))
    v = noise.simplex(p, 7)
    assert np.abs(v).max() <= 1 and v.std() > 0.1
    assert np.abs(noise.simplex(p + 1e-5, 7) - v).max() < 1e-2
    assert (noise.simplex(p, 8) != v).any()
    for d in (3, 4):
        assert noise.simplex(np.random.default_rng(1).uniform(-5, 5, (50, d)), 1).std() > 0.05
