import pytest
from pyspark.sql import functions as F

from skeinflow.operators import asof, frame, grouping, ordered, parallel, sessions, stats
from skeinflow.operators.frame import RID
from skeinflow.streaming import feeds


def rows(df, *cols):
    return [tuple(r) for r in df.orderBy(RID).select(*cols).collect()]


def blocks(spark):
    a = frame.from_lists(spark, id=[1, 2, 3], rt=[0.1, 0.2, 0.3])
    return a, frame.from_lists(spark, id=[4, 5], rt=[0.4, 0.5])


def test_concat(spark):
    a, b = blocks(spark)
    c = frame.concat(a, b)
    assert [r[0] for r in rows(c, "id")] == [1, 2, 3, 4, 5] and rows(c, "rt")[3][0] == 0.4
    assert frame.shape(a) == (3, 2)
    with pytest.raises(ValueError):
        frame.concat(a, b.withColumn("extra", F.lit(1)))
    with pytest.raises(ValueError):
        frame.concat(a, b.withColumn("id", F.col("id").cast("double")))


def test_append(spark):
    a, b = blocks(spark)
    out = frame.append(a, b.drop("rt"))
    assert rows(out, "id", "rt")[3:] == [(4, 0.0), (5, 0.0)]
    with pytest.raises(ValueError):
        frame.append(a.drop("rt"), b)


def test_align_sort_choose(spark):
    g = frame.align(frame.from_lists(spark, a=[3, 1, 2]), frame.from_lists(spark, b=["x"]))
    assert rows(g, "a", "b") == [(3, "x"), (1, ""), (2, "")]
    assert rows(frame.sort(g, "a"), "a") == [(1,), (2,), (3,)]
    assert rows(frame.choose(g, frame.from_lists(spark, idx=[2, 0, 2])), "a") == [(2,), (3,), (2,)]
    assert rows(frame.select(g, F.col("a") > 1), "a") == [(3,), (2,)]


def test_rid_is_dense(spark):
    df = spark.range(1000).repartition(7).select((F.col("id") * 7 % 1000).alias("k"))
    got = frame.with_rid(df, "k").orderBy(RID).collect()
    assert [r[RID] for r in got] == list(range(1000)) and [r["k"] for r in got] == list(range(1000))


def test_grid(spark):
    df = spark.createDataFrame([("a", 1, 2.0), ("b", 2, 4.0)], "x string, y int, v double")
    out = grouping.dense_agg(df, ["x", "y"], {"m": stats.mean("v"), "n": F.count("*")}, {"m": 0.0}).orderBy("y", "x").collect()
    assert [(r.x, r.y, r.m, r.n) for r in out] == [("a", 1, 2.0, 1), ("b", 1, 0.0, 0), ("a", 2, 0.0, 0), ("b", 2, 4.0, 1)]
    with pytest.raises(ValueError):
        grouping.grid(df, "x", "y", most=3)


def test_stats_edges(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),)], "x double")
    assert df.agg(stats.mean("x").alias("m")).first()["m"] == 0.5
    none = df.where("false")
    got = none.agg(stats.mean("x").alias("m"), stats.variance("x").alias("v"), stats.median("x").alias("d"), stats.any_true("x").alias("a"), stats.all_true("x").alias("b")).first()
    assert tuple(got) == (0.0, 0.0, 0.0, 0, 1)


def test_asof_ties(spark):
    e = spark.createDataFrame([("u", 1, 10), ("u", 1, 11), ("u", 3, 12)], "k string, t int, id int")
    q = spark.createDataFrame([("u", 1), ("u", 2), ("u", 4), ("z", 1)], "k string, t int")

    def ask(direction):
        return {(r.k, r.t): r.e_id for r in asof.asof(q, e, ["k"], "t", "id", direction, ["id"]).collect()}

    assert ask("before") == {("u", 1): None, ("u", 2): 11, ("u", 4): 12, ("z", 1): None}
    assert ask("at_or_before")[("u", 1)] == 11 and ask("at")[("u", 1)] == 10
    assert ask("at_or_after")[("u", 1)] == 10 and ask("after")[("u", 1)] == 12 and ask("after")[("u", 4)] is None


def test_sessions_broken(spark):
    e = [("a", i, k) for i, k in enumerate(["x", "B", "m", "E", "y", "B", "E", "B"])] + [("b", i, k) for i, k in enumerate(["B", "m", "B", "E"])]
    df = spark.createDataFrame(e, "k string, n int, what string")
    s = sessions.sessionise(df, ["k"], ["n"], F.col("what") == "B", F.col("what") == "E", "n")
    assert sorted((r.k, r.n, r.obs) for r in s.collect()) == [("a", 1, 0), ("a", 2, 0), ("a", 3, 0), ("a", 5, 1), ("a", 6, 1)]
    o = sessions.observations(s, ["k"], ["n"], ["what"]).orderBy("obs").collect()
    assert o[0]["what"] == ["B", "m", "E"]


def test_fill_and_conv(spark):
    df = spark.createDataFrame([("a", 2.0, 7), ("a", 5.0, 8), ("a", 9.0, 9)], "k string, t double, v int")
    got = ordered.fill_grid(df, ["k"], "t", "v", 0, 10, 5).orderBy("t").collect()
    assert [r.v for r in got] == [7, 8, 9]
    with pytest.raises(ValueError):
        ordered.conv("v", [1, 1], ordered.series(["k"], ["t"]))
    a = spark.createDataFrame([("k", i, float(i)) for i in range(4)], "k string, i int, v double")
    x = {r.lag: r.dot for r in ordered.crosscorr(a, a, ["k"], "i", "v", [-1, 0, 1]).collect()}
    assert x == {-1: 8.0, 0: 14.0, 1: 8.0}


def test_map_units_errors(spark):
    def work(i, state, seed):
        if i == 3:
            raise ValueError("three")
        return state + i

    got = {r.unit: (r.result, r.error) for r in parallel.map_units(spark, 5, work, setup=lambda: 10).collect()}
    assert got[4] == ("14", None) and got[3][0] is None and "three" in got[3][1]


def test_streams(spark, tmp_path):
    src = str(tmp_path / "in")
    spark.createDataFrame([("u", 1.0, "B"), ("u", 2.0, "m"), ("u", 4.0, "E"), ("u", 5.0, "B")], "k string, t double, what string").coalesce(1).write.parquet(src)
    feed = spark.readStream.schema("k string, t double, what string").parquet(src)
    q = feeds.observations(feed, "k", "t", "what", "B", "E").writeStream.format("memory").queryName("obs").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert [tuple(r) for r in spark.table("obs").collect()] == [("u", 0, 1.0, 3.0, 3)]
    m = feeds.Matches()
    m.add("w*", 2)
    assert m.all() == {"w*": 2}
    named = spark.createDataFrame([("wa", i, i) for i in range(5)] + [("x", 9, 9)], "varname string, n int, v int").coalesce(1)
    named.write.parquet(str(tmp_path / "names"))
    feed = spark.readStream.schema("varname string, n int, v int").parquet(str(tmp_path / "names"))
    q = feeds.decimate(m.apply(feed), "varname", "n", "v").writeStream.format("memory").queryName("dec").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert sorted(r.n for r in spark.table("dec").collect()) == [0, 2, 4]
    rec = feeds.Recorder(feed, str(tmp_path / "out"), str(tmp_path / "cp"), m)
    rec.start(once=True).awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 5
    bus = feeds.Bus(spark, str(tmp_path / "bus"))
    bus.set("a", "1")
    bus.set("a", "2")
    assert bus.get("a") == "2" and bus.get("b") is None and bus.mirror(str(tmp_path / "bus2")).get("a") == "2"
