"""Nulls, long keys, long chains and large records: cases that once gave wrong rows, quadratic time or no end."""

import struct
import time

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from skeinflow import stages
from skeinflow.domain import cluster, eye
from skeinflow.functions import scalar
from skeinflow.operators import asof, grouping, ordered
from skeinflow.sources import datalog


def test_null_values_keep_their_rows(spark):
    df = spark.createDataFrame([(1, "b", "x"), (2, None, "x"), (3, "a", None), (4, "b", None), (5, None, None)], "id long, v string, g string")
    assert {r.id: r.code for r in grouping.recode(df, "v").collect()} == {1: 1, 2: -1, 3: 0, 4: 1, 5: -1}
    assert {r.id: r.midrank for r in grouping.midrank(df, "v").collect()} == {1: 1.5, 2: None, 3: 0.0, 4: 1.5, 5: None}
    assert {r.id: r.midrank for r in grouping.midrank(df, "v", "g").collect()} == {1: 0.0, 2: None, 3: 0.0, 4: 1.0, 5: None}
    h = grouping.histogram(df.withColumn("x", F.col("id").cast("double")), "x", 0.0, 6.0, 2, "g")
    assert sorted(((r.g, r.bin, r["count"]) for r in h.collect()), key=str) == sorted([("x", 0, 2), ("x", 1, 0), (None, 0, 0), (None, 1, 3)], key=str)
    assert grouping.recode(df.where("false"), "v").count() == 0


@pytest.mark.parametrize("direction", asof.DIRECTIONS)
def test_asof_on_one_long_key(spark, direction):
    n = 100_000
    base = spark.range(n).select(F.lit(1).alias("k"), F.floor(F.col("id") / 2).alias("t"), "id")
    began = time.perf_counter()
    got = asof.asof(base.where("id % 2 = 0"), base.where("id % 10 = 1"), ["k"], "t", "id", direction, ["id"])
    rows = {r.t: r.e_id for r in got.select("t", "e_id").collect()}
    assert time.perf_counter() - began < 30 and len(rows) == n // 2
    want = {"before": 41, "at_or_before": 51, "at": 51, "at_or_after": 51, "after": 61}[direction]
    assert rows[25] == want and rows[26] == {"before": 51, "at_or_before": 51, "at": None, "at_or_after": 61, "after": 61}[direction]


def test_fill_grid_on_one_long_key(spark):
    n = 100_000
    df = spark.range(n).select(F.lit(1).alias("k"), (F.col("id") + 10).cast("double").alias("t"), F.col("id").alias("v"))
    got = [(r.t, r.v) for r in ordered.fill_grid(df, ["k"], "t", "v", 0.0, float(n), 1.0).orderBy("t").collect()]
    assert got == [(float(t), max(t - 10, 0)) for t in range(n + 1)]


def test_numbers_from_text(spark):
    text = ["12abc", " -3.9x", "abc", None, "1e3", "NaN", "9" * 30, "-" + "9" * 30, "7"]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(text)], "i int, s string")
    assert [r.x for r in df.select("i", scalar.to_int("s").alias("x")).orderBy("i").collect()] == [12, -3, 0, 0, 1, 0, 2**63 - 1, -(2**63), 7]
    assert [r.x for r in df.where("i < 5").select("i", scalar.to_float("s").alias("x")).orderBy("i").collect()] == [12.0, -3.9, 0.0, 0.0, 1000.0]
    doubles = spark.createDataFrame([(0, 2.9), (1, -2.9), (2, float("nan")), (3, 1e30), (4, None)], "i int, x double")
    assert [r.x for r in doubles.select("i", scalar.to_int("x").alias("x")).orderBy("i").collect()] == [2, -2, 0, 2**63 - 1, 0]
    assert spark.createDataFrame([(2**62 + 1,)], "x long").select(scalar.to_int("x").alias("x")).first().x == 2**62 + 1


def test_dbscan_of_a_long_chain(spark):
    points = spark.range(3000).select("id", (F.col("id") * 0.9).alias("x"), F.lit(0.0).alias("y"))
    points = points.union(spark.createDataFrame([(9000, float("nan"), 0.0), (9001, None, 1.0), (9002, 1e6, 1e6)], "id long, x double, y double"))
    got = {r.id: r.cluster for r in cluster.dbscan(points, "id", "x", "y", 1.0, 2).collect()}
    assert {got.pop(k) for k in (9000, 9001, 9002)} == {0} and set(got.values()) == {1}


def test_stream_past_a_large_datapoint(tmp_path):
    path = tmp_path / "big.dslog"
    head = (b"dslog\x00\x00\x01" + struct.pack("<Q", 5)).ljust(datalog.HEADER, b"\0")
    point = lambda name, data: struct.pack("<H", len(name)) + name + struct.pack("<QIII", 9, 0, 1, len(data)) + data
    path.write_bytes(b"dslog" + b"\x01".ljust(3, b"\0") + head[8:] + point(b"a", b"x" * 1000) + point(b"b", b"y"))
    stream = datalog.LogStream(str(path), 64)
    at, seen = stream.initialOffset(), []
    for _ in range(4):
        rows, after = stream.read(at)
        seen += [r[2] for r in rows]
        if after == at:
            break
        at = after
    assert seen == ["a", "b"]


def trace(*moves, n=600, dt=0.004):
    """Positions that move by ``size`` degrees within ``span`` samples from each ``at`` on."""
    h = np.zeros(n)
    for at, span, size in moves:
        h += np.clip((np.arange(n) - at) / span, 0, 1) * size
    return h, np.zeros(n), np.arange(n) * dt


def test_saccades_of_made_traces():
    none = np.zeros(600, bool)
    two = eye.saccades(*trace((100, 8, 6.0), (300, 8, -4.0)), none)
    assert [(round(s["amp"], 6), round(abs(s["dir"]), 6)) for s in two] == [(6.0, 0.0), (4.0, 180.0)]
    assert abs(two[0]["start"] - 100) <= 1 and abs(two[0]["stop"] - 108) <= 1 and not two[0]["has_pso"]
    # an overshoot that comes back is oscillation, and the raw landing is where the eye was when it turned
    over = eye.saccades(*trace((100, 8, 8.0), (109, 4, -1.0)), none)
    assert len(over) == 1 and over[0]["has_pso"] and over[0]["amp"] == pytest.approx(7.0) and over[0]["raw_h"] > 7.2 and over[0]["pso_stop"] > over[0]["stop"]
    # two with little between them are one; so slow a drift, so small a step, and what a blink cuts are none
    assert len(eye.saccades(*trace((100, 8, 5.0), (112, 8, 5.0)), none)) == 1
    assert eye.saccades(*trace((100, 400, 8.0)), none) == [] and eye.saccades(*trace((100, 2, 0.1)), none) == []
    assert eye.saccades(*trace((100, 8, 6.0)), ~none) == []
    # fast for too long
    assert eye.saccades(*trace((100, 200, 100.0)), none) == []
    rng = np.random.default_rng(0)
    for n in (0, 1, 2, 3, 20, 500):
        eye.saccades(rng.uniform(0, 100, n), rng.uniform(0, 100, n), np.arange(n) * 0.004, rng.random(n) < 0.1)


def test_distances_of_paths_hold_no_tables_of_steps():
    x = np.random.default_rng(3).normal(size=(50, 8, 2))
    d = cluster.dtw_distances(x[0], x)
    assert d.base is None and d == pytest.approx([cluster.dtw_distance(x[0], y) for y in x])
    assert cluster.dtw_distances(x[0], x[:, :0]).tolist() == [np.inf] * 50 and cluster.dtw_distance(x[0, :0], x[0, :0]) == 0


def test_all_pairs_of_paths_of_several_lengths(spark, monkeypatch):
    monkeypatch.setattr(cluster, "_PAIRS", 10)
    rng = np.random.default_rng(7)
    path = {k: rng.normal(size=(int(rng.integers(1, 5)), 2)) for k in range(40)}
    df = spark.createDataFrame([(k, v.tolist()) for k, v in path.items()], "k long, path array<array<double>>")
    got = [((r.a, r.b), r.distance) for r in cluster.dtw_matrix(df, "k", "path", blocks=3).collect()]
    want = {(a, b): cluster.dtw_distance(path[a], path[b]) for a in path for b in path if a < b}
    assert len(got) == len(want) and dict(got) == pytest.approx(want)


def test_every_pair_of_blocks_of_paths_is_a_task_of_its_own(spark):
    """Small blocks aren't put together in a few tasks, which would leave most cores without any."""
    path = np.random.default_rng(11).normal(size=(60, 3, 2))
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(path)], "k long, path array<array<double>>")
    got = cluster.dtw_matrix(df, "k", "path", blocks=4).withColumn("task", F.spark_partition_id()).toPandas()
    assert len(got) == 60 * 59 // 2 and got.task.nunique() == 10 and not got.duplicated(["a", "b"]).any()


@pytest.mark.parametrize("p", [1.0, 2.0, 3.0])
def test_pairs_of_odd_paths(spark, p, monkeypatch):
    """Repeated keys and paths, keys of text, paths that are empty or null, rows without a key; small stacks."""
    monkeypatch.setattr(cluster, "_STACK", 20)
    rng = np.random.default_rng(5)
    rows = [(f"k{n % 23:02}", rng.normal(size=(n % 4, 3)).tolist()) for n in range(26)]
    rows += [("x", rows[1][1]), ("y", None), ("z", []), (None, rows[1][1])]

    def slow(u, v):
        best = np.full((len(u) + 1, len(v) + 1), np.inf)
        best[0, 0] = 0
        for i in range(len(u)):
            for j in range(len(v)):
                best[i + 1, j + 1] = (np.abs(np.subtract(u[i], v[j])) ** p).sum() ** (1 / p) + min(best[i, j + 1], best[i + 1, j], best[i, j])
        return round(float(best[-1, -1]), 9)

    known = [r for r in rows if r[0]]
    want = [(a, b, None if u is None or v is None else slow(u, v)) for a, u in known for b, v in known if a < b]
    for blocks in (1, 3):
        got = cluster.dtw_matrix(spark.createDataFrame(rows, "k string, path array<array<double>>"), "k", "path", p, blocks).collect()
        assert sorted(map(str, want)) == sorted(str((r.a, r.b, None if r.distance is None else round(r.distance, 9))) for r in got)


def test_quotients_next_to_a_half_round_as_in_sql(spark, tmp_path):
    """Quotients of 5 digits that end in 5, as doubles next to a half or on it, with nothing forgiven."""
    rows = [(i // 3, i % 3, i, p, q) for i, (p, q) in enumerate([(41555.31, 24.0), (32680.19, 40.0), (73519.18, 16.0), (104564.54, 16.0), (69237.87, 40.0), (8.0, 0.5), (-41555.31, 24.0)])]
    path = f"{tmp_path}/lineitem.parquet"
    spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_partkey long, l_extendedprice double, l_quantity double").write.parquet(path)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{path}/*.parquet'")
    want = con.execute(entry.oracle_sql()["list_div_rows"]).fetchall()
    got = [tuple(r) for r in entry.queries()["list_div_rows"](spark, str(tmp_path)).select("k", "i", "x").collect()]
    assert sorted(got) == sorted(want)


def test_driver_collects_garbage_after_a_stage_when_it_is_full(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(stages, "tidy", lambda s, f=stages.tidy: seen.append(f(s)))
    for share in (0.0, 1.0):
        monkeypatch.setattr(stages, "FULL", share)
        df = stages.settled(spark.range(3))
        assert df.count() == 3
        stages.drop_settled(df)
    assert seen == [True, False]
