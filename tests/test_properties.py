"""List functions and table operators against plain Python on random input."""

import random

import pytest
from pyspark.sql import functions as F

from skeinflow.functions import lists
from skeinflow.operators import asof, grouping, ordered, stats

RNG = random.Random(12)
ROWS = [(i, [RNG.randint(-5, 5) for _ in range(RNG.randint(0, 9))], RNG.randint(-4, 4)) for i in range(120)]


@pytest.fixture(scope="module")
def df(spark):
    return spark.createDataFrame(ROWS, "i int, a array<int>, k int").repartition(3)


def check(df, column, want):
    got = {r.i: r.x for r in df.select("i", column.alias("x")).collect()}
    for i, a, k in ROWS:
        assert got[i] == want(a, k), (a, k, got[i])


def rotated(a, k):
    k = k % len(a) if a else 0
    return a[-k:] + a[:-k] if k else a


def shifted(a, k):
    return [a[i - k] if 0 <= i - k < len(a) else 0 for i in range(len(a))]


@pytest.mark.parametrize(
    ("name", "column", "want"),
    [
        ("cycle", lambda: lists.cycle("a", "k"), rotated),
        ("shift", lambda: lists.shift("a", "k", F.lit(0)), shifted),
        ("unique", lambda: lists.unique("a"), lambda a, k: sorted(set(a))),
        ("adjacent", lambda: lists.unique_adjacent("a"), lambda a, k: [x for j, x in enumerate(a) if j == 0 or a[j - 1] != x]),
        ("rank", lambda: lists.rank_within("a"), lambda a, k: [a[:j].count(x) for j, x in enumerate(a)]),
        ("recode", lambda: lists.recode("a"), lambda a, k: [sorted(set(a)).index(x) for x in a]),
        ("sort_indices", lambda: lists.sort_indices("a"), lambda a, k: sorted(range(len(a)), key=lambda j: (a[j], j))),
        ("find_indices", lambda: lists.find_indices("a", F.array(F.lit(1), F.lit(2), F.lit(1))), lambda a, k: [{1: 2, 2: 1}.get(x, -1) for x in a]),
        ("diff", lambda: lists.diff("a", 2), lambda a, k: [a[j + 2] - a[j] for j in range(max(0, len(a) - 2))]),
        ("indices", lambda: lists.indices("a"), lambda a, k: [j for j, x in enumerate(a) if x]),
        ("idiff", lambda: lists.idiff_self("a"), lambda a, k: [x - y for i, x in enumerate(a) for j, y in enumerate(a) if i != j]),
        ("median", lambda: lists.median("a"), lambda a, k: 0.0 if not a else (sorted(a)[len(a) // 2] + sorted(a)[(len(a) - 1) // 2]) / 2),
        ("hist", lambda: lists.hist("a", F.lit(-5), F.lit(5), 5), lambda a, k: [sum(-5 + 2 * b <= x < -3 + 2 * b for x in a) for b in range(5)]),
        ("cumsum", lambda: lists.cumsum("a"), lambda a, k: [float(sum(a[: j + 1])) for j in range(len(a))]),
        ("reverse", lambda: lists.reverse("a"), lambda a, k: a[::-1]),
        ("oneof", lambda: lists.oneof("a", F.array(F.lit(0), F.lit(3))), lambda a, k: [int(x in (0, 3)) for x in a]),
    ],
)
def test_list_function(df, name, column, want):
    check(df, column(), want)


def test_asof_random(spark):
    events = [(RNG.randint(0, 3), RNG.randint(0, 30), i, RNG.randint(0, 2)) for i in range(150)]
    asked = [(RNG.randint(0, 4), RNG.randint(-2, 32), i) for i in range(150)]
    e = spark.createDataFrame(events, "k int, t int, id int, d int")
    q = spark.createDataFrame(asked, "k int, t int, n int")
    ok = {"before": lambda x, t: x < t, "at_or_before": lambda x, t: x <= t, "at": lambda x, t: x == t, "at_or_after": lambda x, t: x >= t, "after": lambda x, t: x > t}
    for direction, fits in ok.items():
        for having, keep in ((None, lambda d: True), (F.col("d") == 1, lambda d: d == 1), (F.col("d") != 1, lambda d: d != 1)):
            got = {r.n: r.e_id for r in asof.asof(q, e, ["k"], "t", "id", direction, ["id"], having).collect()}
            for k, t, n in asked:
                found = sorted((x, i) for kk, x, i, d in events if kk == k and fits(x, t) and keep(d))
                want = None if not found else found[-1][1] if "before" in direction else found[0][1]
                assert got[n] == want


def test_ranks_random(spark, monkeypatch):
    rows = [(i, RNG.choice("ab"), RNG.randint(0, 9)) for i in range(200)]
    df = spark.createDataFrame(rows, "i int, g string, v int")
    values = [v for _, _, v in rows]
    for small in (500_000, 0):  # by one task, and by ranges
        monkeypatch.setattr(grouping, "SMALL", small)
        got = {r.i: (r.midrank, r.code) for r in grouping.recode(grouping.midrank(df, "v"), "v").collect()}
        for i, _, v in rows:
            assert got[i] == (sum(x < v for x in values) + (values.count(v) - 1) / 2, sorted(set(values)).index(v))
    p = {r.g: r.pct for r in stats.percentile_nearest(df, ["g"], "v", 30).collect()}
    for g in "ab":
        s = sorted(v for _, h, v in rows if h == g)
        assert p[g] == s[min(len(s) - 1, int(len(s) * 0.3 + 0.5))]


def test_fill_random(spark):
    rows = [(g, float(t), RNG.randint(0, 99)) for g in "ab" for t in RNG.sample(range(-10, 60), 9)]
    got = {(r.g, r.t): r.v for r in ordered.fill_grid(spark.createDataFrame(rows, "g string, t double, v int"), ["g"], "t", "v", 0, 50, 7).collect()}
    for g in "ab":
        mine = sorted((t, v) for h, t, v in rows if h == g)
        for t in range(0, 51, 7):
            before = [v for x, v in mine if x <= t]
            assert got[g, float(t)] == (before[-1] if before else mine[0][1])
