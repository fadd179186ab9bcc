"""Registered queries without SQL against plain Python on whole small tables, with ids beyond those that were once cut off."""

import datetime

import numpy as np
import pandas as pd
import pytest

import __spark_entry__ as entry
from skeinflow.operators import signal


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("small")
    rng = np.random.default_rng(4)
    embeddings = pd.DataFrame({"vec_id": range(35, 59), "embedding": [rng.normal(size=64).tolist() for _ in range(24)]})
    n = 400
    events = pd.DataFrame({"event_id": range(n), "user_id": rng.choice([3, 60, 99, 140, 2000], n), "value": rng.uniform(0, 100, n)})
    events["ts"] = [datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=int(s)) for s in rng.integers(0, 5000, n)]
    events["event_type"] = "click"
    part = pd.DataFrame({"p_partkey": range(350, 450), "p_size": rng.integers(1, 50, 100), "p_retailprice": rng.uniform(900, 2000, 100)})
    for name, table in (("embeddings", embeddings), ("events", events), ("part", part)):
        spark.createDataFrame(table).write.parquet(f"{d}/{name}.parquet")
    return str(d), embeddings, events, part


def slow_dtw(a, b):
    best = np.full((len(a) + 1, len(b) + 1), np.inf)
    best[0, 0] = 0
    for i in range(len(a)):
        for j in range(len(b)):
            best[i + 1, j + 1] = np.hypot(*(a[i] - b[j])) + min(best[i, j + 1], best[i + 1, j], best[i, j])
    return best[-1, -1]


def test_dtw_matrix(spark, small):
    d, embeddings, _, _ = small
    path = {k: np.array(v).reshape(32, 2) for k, v in zip(embeddings.vec_id, embeddings.embedding, strict=True)}
    got = [((r.a, r.b), r.distance) for r in entry.queries()["dtw_matrix"](spark, d).collect()]
    want = {(a, b): slow_dtw(path[a], path[b]) for a in path for b in path if a < b}
    assert len(got) == len(want) and dict(got) == pytest.approx(want, abs=1e-4)


def test_matrix_inverse(spark, small):
    d, embeddings, _, _ = small
    got = {r.vec_id: (r.trace, r.det) for r in entry.queries()["matrix_inverse"](spark, d).collect()}
    assert set(got) == set(embeddings.vec_id)
    for k, v in zip(embeddings.vec_id, embeddings.embedding, strict=True):
        assert got[k] == pytest.approx((8.0, np.linalg.det(np.array(v).reshape(8, 8))), rel=1e-4, abs=1e-6)


def test_kde_peaks(spark, small):
    d, _, events, _ = small
    centre = np.arange(25) * 4 + 2.0
    gx, gy = np.meshgrid(centre, centre, indexing="ij")
    far = (gx[..., None] - events.value.to_numpy()) ** 2 + (gy[..., None] - events.user_id.to_numpy()) ** 2
    density = np.exp(-far / 32).sum(axis=2) / (len(events) * 2 * np.pi * 16)
    want = {}
    for x in range(1, 24):
        for y in range(1, 24):
            around = density[x - 1 : x + 2, y - 1 : y + 2].ravel()
            if np.delete(around, 4).max() <= density[x, y]:
                want[x, y] = density[x, y]
    got = {(r.gx, r.gy): r.density for r in entry.queries()["kde_peaks"](spark, d).collect()}
    high = {k: v for k, v in want.items() if v > 1e-7}
    assert high and {k: v for k, v in got.items() if v > 1e-7} == pytest.approx(high, abs=2e-8)


def test_lowess(spark, small):
    d, _, _, part = small
    got = sorted((r.k, r.x, r.y, r.fit) for r in entry.queries()["lowess"](spark, d).collect())
    want = []
    for k, g in part.groupby(part.p_size % 3):
        g = g.sort_values(["p_size", "p_retailprice"])
        want += zip([k] * len(g), g.p_size, g.p_retailprice, signal.lowess(g.p_size.to_numpy(float), g.p_retailprice.to_numpy()), strict=True)
    np.testing.assert_allclose(got, sorted(want), atol=1e-3)
