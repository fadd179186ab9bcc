"""Golden values of the list functions."""

import math

import pytest
from pyspark.sql import functions as F

from skeinflow.functions import lists, scalar
from skeinflow.operators import matrix


@pytest.fixture(scope="module")
def one(spark):
    df = spark.createDataFrame(
        [(list(range(10)), [[1, 2, 3], [10, 20], [5]], [[[1, 2], [3]], [[4, 5, 6]]], [3.0, 1.0, 2.0, 2.0], [], [1.0, float("nan"), 3.0])],
        "xs array<int>, rows array<array<int>>, deep array<array<array<int>>>, fs array<double>, none array<int>, nan array<double>",
    )
    return lambda c: df.select(c.alias("x")).first()["x"]


def ints(*xs):
    return F.array(*(F.lit(x) for x in xs))


def test_comprehension_verbs(one):
    assert one(lists.each(lambda x: x * x + 1, "xs")) == [1, 2, 5, 10, 17, 26, 37, 50, 65, 82]
    assert one(lists.filtered(lambda x: (x > 5) & (x % 3 == 0), "xs")) == [6, 9]
    assert one(lists.reduced(lambda a, x: a + x, "xs", F.lit(0))) == 45
    assert one(lists.reduced(lambda a, x: F.greatest(a, x), "xs", F.lit(0))) == 9
    assert one(lists.each(lists.int_total, "rows")) == [6, 30, 5]
    assert one(lists.filtered(lambda s: F.size(s) >= 2, "rows")) == [[1, 2, 3], [10, 20]]


def test_constructors(one):
    assert one(lists.fromto(F.lit(0), F.lit(5))) == [0, 1, 2, 3, 4]
    assert one(lists.fromto(F.lit(3), F.lit(3))) == []
    assert one(lists.series(F.lit(1), F.lit(5), F.lit(2))) == [1, 3, 5]
    assert one(lists.series(F.lit(0.0), F.lit(0.3), F.lit(0.1))) == pytest.approx([0, 0.1, 0.2, 0.3])
    with pytest.raises(Exception, match="wrong sign"):
        one(lists.series(F.lit(1), F.lit(5), F.lit(-1)))
    assert one(lists.bins(F.lit(0), F.lit(10), F.lit(5))) == [1, 3, 5, 7, 9]
    assert one(lists.zeros(F.lit(3))) == [0, 0, 0]
    assert one(lists.upto(F.lit(0))) == []
    g = one(lists.gaussian2d(3, 3, 1.0))
    assert g[4] == 1 and g[0] == pytest.approx(math.exp(-2))


def test_random(one):
    assert sorted(one(lists.randfill(F.lit(8), 3))) == list(range(8))
    assert len(set(one(lists.randchoose(F.lit(9), F.lit(4), 1)))) == 4
    u = one(lists.urand(F.lit(2000), 5))
    assert 0 <= min(u) and max(u) < 1 and abs(sum(u) / 2000 - 0.5) < 0.03
    z = one(lists.zrand(F.lit(2000), 5))
    assert abs(sum(z) / 2000) < 0.1
    assert set(one(lists.irand(F.lit(500), F.lit(4), 2))) == {0, 1, 2, 3}
    assert one(lists.pickone("xs", 1)) in range(10)


def test_structure(one):
    assert one(lists.interleave(ints(1, 2), ints(10, 20), ints(100, 200))) == [1, 10, 100, 2, 20, 200]
    assert one(lists.collapse("deep")) == [[1, 2], [3], [4, 5, 6]]
    assert one(lists.unpack("deep", 3)) == [[1, 2, 3], [4, 5, 6]]
    assert one(lists.deep_unpack("deep", 3)) == [[1, 2, 3], [4, 5, 6]]
    assert one(lists.transpose("rows", F.lit(0))) == [[1, 10, 5], [2, 20, 0], [3, 0, 0]]
    assert one(lists.reshape(ints(1, 2, 3, 4, 5, 6), F.lit(2), F.lit(3))) == [[1, 2, 3], [4, 5, 6]]
    assert one(lists.restructure(ints(1, 2, 3, 4, 5, 6), "rows")) == [[1, 2, 3], [4, 5], [6]]
    assert one(lists.cycle(ints(1, 2, 3, 4), F.lit(1))) == [4, 1, 2, 3]
    assert one(lists.cycle(ints(1, 2, 3, 4), F.lit(-1))) == [2, 3, 4, 1]
    assert one(lists.shift(ints(1, 2, 3), F.lit(1), F.lit(0))) == [0, 1, 2]
    assert one(lists.shift(ints(1, 2, 3), F.lit(-5), F.lit(0))) == [0, 0, 0]
    assert one(lists.reverse_all("rows", 2)) == [[5], [20, 10], [3, 2, 1]]
    assert one(lists.repeat(ints(1, 2), F.lit(2))) == [1, 1, 2, 2]
    assert one(lists.repeat_by(ints(1, 2), ints(3, 1))) == [1, 1, 1, 2]
    assert one(lists.replicate(ints(1, 2), F.lit(2))) == [1, 2, 1, 2]
    assert one(lists.splice_before(ints(0), "rows")) == [[0, 1, 2, 3], [0, 10, 20], [0, 5]]
    assert one(lists.combine_inner("rows", "rows"))[2] == [5, 5]
    assert one(lists.pack(ints(1, 2))) == [[1], [2]]
    assert one(lists.put(ints(1, 2, 3), F.lit(1), F.lit(9))) == [1, 9, 3]
    assert one(lists.increment(ints(1, 2))) == [1, 2, 3]
    assert one(lists.increment("none")) == [0]
    assert one(lists.first_pos("rows", 2)) == [[0], [0], [0]]
    assert one(lists.last_pos("rows", 2)) == [[2], [1], [0]]
    assert one(lists.zipped(ints(1, 2), ints(3, 4))) == [[1, 3], [2, 4]]


def test_replace_and_select(one):
    assert one(lists.select_mask("xs", ints(1, 0))) == [0, 2, 4, 6, 8]
    assert one(lists.select_indices("xs", ints(3, 3, 0))) == [3, 3, 0]
    with pytest.raises(Exception, match="negative"):
        one(lists.select_indices("xs", ints(-1)))
    assert one(lists.replace(ints(1, 2, 3), ints(0, 1, 0), F.lit(9))) == [1, 9, 3]
    assert one(lists.replace_each(ints(1, 2, 3), ints(1, 0, 1), ints(7, 8))) == [7, 2, 8]
    assert one(lists.replace_by_index(ints(1, 2, 3), ints(0, 2, 0), ints(7, 8, 9))) == [9, 2, 8]
    assert one(lists.where(ints(1, 0), ints(1, 2), ints(3, 4))) == [1, 4]
    assert one(lists.remap(ints(0, 1, 2, 3, 0, 1), [0, 1, 2, 3], ["zero", "one", "two", "three"])) == ["zero", "one", "two", "three", "zero", "one"]
    assert one(lists.find("xs", F.lit(4))) == 4 and one(lists.find("xs", F.lit(40))) == -1
    assert one(lists.find_all(ints(1, 2, 1, 2, 1), ints(1, 2))) == [0, 2]
    assert one(lists.find_indices(ints(5, 7), ints(5, 6, 5))) == [2, -1]
    assert one(lists.oneof(ints(1, 5), ints(5, 6))) == [0, 1]
    assert one(lists.count_occurrences(ints(1, 1, 2), ints(1, 2, 3))) == [2, 1, 0]
    assert one(lists.hist("xs", F.lit(0), F.lit(10), 5)) == [2, 2, 2, 2, 2]
    assert one(lists.cut(F.lit(5), ints(0, 5, 10))) == 0 and one(lists.cut(F.lit(11), ints(0, 5, 10))) == -1 and one(lists.cut(F.lit(0), ints(0, 5, 10))) == -1
    assert one(lists.indices(ints(0, 3, 0, 1))) == [1, 3]
    assert one(lists.fill_sparse(ints(7, 8, 9), ints(2, 5, 9), F.lit(0), F.lit(10), F.lit(5))) == [7, 8, 9]


def test_reductions(one):
    assert one(lists.lengths("rows")) == [3, 2, 1]
    assert one(lists.mean("none")) == 0 and one(lists.mean("nan")) == pytest.approx(4 / 3)
    assert one(lists.variance(ints(1))) == 0 and one(lists.variance(ints(1, 2, 3))) == 1
    assert one(lists.median(ints(4, 1, 3, 2))) == 2.5 and one(lists.median("none")) == 0
    assert one(lists.percentile("xs", 50)) == 5 and one(lists.percentile("xs", 100)) == 9 and one(lists.percentile("xs", 0)) == 0
    assert one(lists.min_index("fs")) == 1 and one(lists.max_index("fs")) == 0
    assert one(lists.column_sums(F.array(ints(1, 2), ints(3, 4)))) == [4, 6]
    assert one(lists.any_of("none")) == 0 and one(lists.all_of("none")) == 1
    assert one(lists.prod(ints(2, 3, 4))) == 24
    assert one(lists.leaf_means("rows", 2)) == [[2.0], [15.0], [5.0]]


def test_order(one):
    assert one(lists.sort_indices("fs")) == [1, 2, 3, 0]
    assert one(lists.multisort(ints(1, 0, 1), ints(2, 5, 1))) == [1, 2, 0]
    assert one(lists.unique("fs")) == [1, 2, 3]
    assert one(lists.unique_adjacent(ints(1, 1, 2, 1))) == [1, 2, 1]
    assert one(lists.rank_within(ints(5, 5, 6, 5))) == [0, 1, 0, 2]
    assert one(lists.recode(ints(30, 10, 30))) == [1, 0, 1]
    assert one(lists.recode_from(ints(30, 11), ints(10, 30))) == [1, -1]
    assert one(lists.recode_with_ties(ints(10, 20, 10))) == [0.5, 2.0, 0.5]


def test_ordered(one):
    assert one(lists.cumsum("xs"))[-1] == 45 and one(lists.cumprod(ints(1, 2, 3))) == [1, 2, 6]
    assert one(lists.diff(ints(1, 4, 9, 16), 2)) == [8, 12]
    assert one(lists.idiff(ints(1, 2), ints(1, 3))) == [0, -2, 1, -1]
    assert one(lists.idiff_self(ints(1, 3))) == [-2, 2]
    assert one(lists.gradient(ints(1, 4, 9))) == [3, 4, 5]
    assert one(lists.gradient(ints(0, 1, 3, 0), True)) == [1, 1, 0, -3]
    assert one(lists.zero_crossings(ints(-1, 1, 0, -1, -2))) == [0, 1, 0, -1, 0]
    assert one(lists.conv(ints(1, 2, 3), ints(1, 0, 2))) == [4.0, 7.0, 2.0]
    with pytest.raises(Exception, match="odd"):
        one(lists.conv(ints(1, 2), ints(1, 1)))


def test_pairwise(one):
    add = lambda a, b: a + b
    assert one(lists.pairwise(add, ints(1, 2), ints(10))) == [11, 12]
    assert one(lists.pairwise(add, ints(1, 2), ints(10, 20))) == [11, 22]
    assert one(lists.pairwise(add, ints(1, 2), "none")) == []
    with pytest.raises(Exception, match="length"):
        one(lists.pairwise(add, ints(1, 2), ints(1, 2, 3)))


def test_scalars(one):
    assert one(scalar.div(F.lit(3.0), F.lit(0))) == 0 and one(scalar.int_div(F.lit(-7), F.lit(2))) == -3 and one(scalar.int_div(F.lit(7), F.lit(0))) == 0
    assert one(scalar.rounded(F.lit(-2.5))) == -3 and one(scalar.to_int(F.lit("12.9x"))) == 12 and one(scalar.to_int(F.lit(-3.7))) == -3
    assert one(scalar.to_char(F.lit(200))) == -56 and one(scalar.to_uchar(F.lit(-56))) == 200
    assert one(scalar.log(F.lit(0))) == float("-inf") and math.isnan(one(scalar.log(F.lit(-1))))
    assert one(scalar.distance(F.lit(4), F.lit(0), F.lit(4), F.lit(7))) == 7
    assert one(scalar.lgamma(F.lit(5.0))) == pytest.approx(math.log(24))
    assert one(scalar.dprime(F.lit(0.8), F.lit(0.2))) == pytest.approx(1.683, abs=1e-3)
    assert one(scalar.file_base(F.lit("/a/b.c/d.txt"))) == "d" and one(scalar.file_ext(F.lit("/a/b.c/d.txt"))) == ".txt" and one(scalar.file_dir(F.lit("x"))) == "."


def test_matrix(one):
    m = F.array(*(F.array(*(F.lit(float(v)) for v in r)) for r in ((4, 3), (6, 3))))
    assert one(matrix.matmul(m, matrix.identity(2))) == [[4, 3], [6, 3]]
    assert one(matrix.det(m)) == pytest.approx(-6)
    inv = one(matrix.inverse(m))
    assert inv[0] == pytest.approx([-0.5, 0.5])
    lu = one(matrix.ludcmp(m))
    assert lu["sign"] == -1 and lu["order"] == [1, 0]
    assert one(matrix.dims(m)) == [2, 2] and one(matrix.diag(m)) == [4, 3]
