"""Functions on list (array) columns, all higher-order expressions of the JVM.

``depth`` arguments say how deep a list is nested where the expression depends on it.  Indices are 0-based; what isn't found
is -1; gaps are filled with the default of the element type, given as ``fill``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

Fn = Callable[[Column], Column]


def _c(x: Column | str | float) -> Column:
    return x if isinstance(x, Column) else F.col(x) if isinstance(x, str) else F.lit(x)


# --- lifting


def each(f: Fn, a, depth: int = 1) -> Column:
    """``f`` of every element, ``depth`` levels down."""
    return _at(_c(a), depth, f)


def _at(a: Column, depth: int, f: Fn) -> Column:
    return f(a) if depth == 0 else F.transform(a, lambda x: _at(x, depth - 1, f))


def pairwise(f: Callable[[Column, Column], Column], a, b, depth: int = 1) -> Column:
    """``f`` of corresponding elements; a list of one element goes with all of the other, an empty one gives an empty one."""
    a, b = _c(a), _c(b)
    if depth == 0:
        return f(a, b)

    def inner(x: Column, y: Column) -> Column:
        return pairwise(f, x, y, depth - 1)

    one_a = F.transform(b, lambda y: inner(F.get(a, F.lit(0)), y))
    one_b = F.transform(a, lambda x: inner(x, F.get(b, F.lit(0))))
    same = F.transform(a, lambda x, i: inner(x, F.get(b, i)))
    wrong = F.raise_error(F.lit("lists differ in length"))
    empty = F.slice(same, 1, 0)
    return (
        F.when((F.size(a) == 0) | (F.size(b) == 0), empty).when(F.size(a) == F.size(b), same)
        .when(F.size(a) == 1, one_a).when(F.size(b) == 1, one_b).otherwise(wrong)
    )


# --- constructors


def repeat_value(value, n) -> Column:
    return F.array_repeat(_c(value), _c(n).cast("int"))


def zeros(n) -> Column:
    return repeat_value(F.lit(0), n)


def ones(n) -> Column:
    return repeat_value(F.lit(1), n)


def _count_up(n: Column) -> Column:
    """0 .. n-1, empty for n < 1."""
    return F.when(n < 1, F.array().cast("array<int>")).otherwise(F.sequence(F.lit(0), n.cast("int") - 1))


def upto(n) -> Column:
    return _count_up(_c(n))


def series(start, stop, step=1) -> Column:
    """start, start + step, ... to stop, inclusive; a float stop has a slack of 1e-6; a step of the wrong sign is an error."""
    start, stop, step = _c(start), _c(stop), _c(step)
    wrong = (step == 0) | ((stop > start) & (step < 0)) | ((stop < start) & (step > 0))
    n = F.floor((stop - start + 1e-6 * F.signum(step)) / step).cast("int")
    made = F.transform(F.sequence(F.lit(0), F.when(wrong, F.lit(0)).otherwise(n)), lambda i: start + i * step)
    return F.when(wrong, F.raise_error(F.lit("step has the wrong sign"))).otherwise(made)


def fromto(start, stop, step=1) -> Column:
    """Like series without stop itself; start = stop gives an empty list."""
    start, stop, step = _c(start), _c(stop), _c(step)
    n = F.ceil((stop - start) / step - 1e-9).cast("int")
    return F.transform(_count_up(n), lambda i: start + i * step)


def bins(lo, hi, n) -> Column:
    """Centres of n equal bins."""
    lo, hi, n = _c(lo), _c(hi), _c(n)
    return F.transform(_count_up(n), lambda i: lo + (i + 0.5) * (hi - lo) / n)


def gaussian2d(width: int, height: int, sd: float) -> Column:
    """exp(-(x*x + y*y) / sd**2) by rows, flat; centred as the sizes' integer halves are."""
    def offset(n: int) -> float:
        return -(n // 2) + (0.0 if n % 2 else 0.5)

    rows = F.sequence(F.lit(0), F.lit(height - 1))
    columns = F.sequence(F.lit(0), F.lit(width - 1))
    return F.flatten(F.transform(rows, lambda i: F.transform(columns, lambda j: F.exp(-(F.pow(i + offset(width), F.lit(2)) + F.pow(j + offset(height), F.lit(2))) / F.lit(sd * sd)))))


# --- random; all take a seed, and agree in distribution with one another, not in values


def urand(n, seed: int) -> Column:
    return F.transform(_count_up(_c(n)), lambda i: (F.pmod(F.xxhash64(F.lit(seed), i), F.lit(1 << 53)) / float(1 << 53)))


def zrand(n, seed: int) -> Column:
    """Standard normal by the polar formula."""
    def u(i: Column, k: int) -> Column:
        return (F.pmod(F.xxhash64(F.lit(seed), F.lit(k), i), F.lit(1 << 53)) + 1) / float((1 << 53) + 1)

    return F.transform(_count_up(_c(n)), lambda i: F.sqrt(-2 * F.log(u(i, 1))) * F.cos(u(i, 2) * 6.283185307179586))


def irand(n, most, seed: int) -> Column:
    return F.transform(_count_up(_c(n)), lambda i: F.pmod(F.xxhash64(F.lit(seed), i), _c(most)).cast("int"))


def shuffle(a, seed: int) -> Column:
    return F.shuffle(_c(a), F.lit(seed))


def randfill(n, seed: int) -> Column:
    return F.shuffle(_count_up(_c(n)), F.lit(seed))


def randchoose(m, n, seed: int) -> Column:
    """n distinct indices below m."""
    return F.slice(randfill(m, seed), F.lit(1), _c(n))


def randchoose_of(a, n, seed: int) -> Column:
    return F.slice(shuffle(a, seed), F.lit(1), _c(n))


def pickone(a, seed: int) -> Column:
    return F.get(shuffle(a, seed), F.lit(0))


# --- elements and structure


def append(a, v) -> Column:
    return F.array_append(_c(a), _c(v))


def prepend(a, v) -> Column:
    return F.array_prepend(_c(a), _c(v))


def insert(a, v, at: int = 0) -> Column:
    return F.array_insert(_c(a), F.lit(at + 1), _c(v))


def get(a, i) -> Column:
    return F.get(_c(a), _c(i))


def put(a, i, v) -> Column:
    i, v = _c(i), _c(v)
    return F.transform(_c(a), lambda x, j: F.when(j == i, v).otherwise(x))


def first(a) -> Column:
    return F.get(_c(a), F.lit(0))


def last(a) -> Column:
    a = _c(a)
    return F.get(a, F.size(a) - 1)


def increment(a) -> Column:
    """Append the last element plus one, 0 to an empty list."""
    a = _c(a)
    return F.array_append(a, F.coalesce(last(a) + 1, F.lit(0)))


def index(a, depth: int = 1) -> Column:
    """0-based position of each element."""
    return _at(_c(a), depth - 1, lambda s: F.transform(s, lambda x, i: i))


def first_pos(a, depth: int = 1) -> Column:
    return _at(_c(a), depth - 1, lambda s: F.slice(F.transform(s, lambda x, i: i), 1, 1))


def last_pos(a, depth: int = 1) -> Column:
    return _at(_c(a), depth - 1, lambda s: F.filter(F.array(F.size(s) - 1), lambda i: i >= 0))


def indices(mask, depth: int = 1) -> Column:
    """Positions of the non-zero elements."""
    return _at(_c(mask), depth - 1, lambda s: F.filter(F.transform(s, lambda x, i: F.when(x != 0, i)), lambda i: i.isNotNull()))


def combine(*xs) -> Column:
    return F.concat(*map(_c, xs))


def combine_inner(a, b) -> Column:
    """Corresponding inner lists one after the other."""
    b = _c(b)
    return F.transform(_c(a), lambda x, i: F.concat(x, F.get(b, i)))


def interleave(*xs) -> Column:
    """a0 b0 a1 b1 ...; lists of one element go with all."""
    xs = list(map(_c, xs))
    n = F.greatest(*(F.size(x) for x in xs)) if len(xs) > 1 else F.size(xs[0])
    return F.flatten(F.transform(_count_up(n), lambda i: F.array(*(F.get(x, F.when(F.size(x) == 1, F.lit(0)).otherwise(i)) for x in xs))))


def zipped(*xs) -> Column:
    """Tuples of corresponding elements."""
    xs = list(map(_c, xs))
    return F.transform(xs[0], lambda x, i: F.array(x, *(F.get(y, i) for y in xs[1:])))


def splice_before(a, lists) -> Column:
    a = _c(a)
    return F.transform(_c(lists), lambda s: F.concat(a, s))


def splice_after(a, lists) -> Column:
    a = _c(a)
    return F.transform(_c(lists), lambda s: F.concat(s, a))


def pack(a) -> Column:
    return F.transform(_c(a), lambda x: F.array(x))


def deep_pack(a, depth: int) -> Column:
    return _at(_c(a), depth, lambda x: F.array(x))


def unpack(a, depth: int = 2) -> Column:
    """One level less: flat if that leaves one level, else inner lists are joined within each element."""
    return F.flatten(_c(a)) if depth <= 2 else F.transform(_c(a), lambda s: F.flatten(s))


def deep_unpack(a, depth: int) -> Column:
    """Without the innermost level."""
    if depth < 2:
        raise ValueError("a list of lists is needed")
    return _at(_c(a), depth - 2, lambda s: F.flatten(s))


def leaf_lists(a, depth: int) -> Column:
    """All innermost lists in one list."""
    a = _c(a)
    for _ in range(depth - 2):
        a = F.flatten(a)
    return a


def collapse(a) -> Column:
    """The sublists joined: exactly one level less."""
    return F.flatten(_c(a))


def reshape(a, rows, columns) -> Column:
    a, columns = _c(a), _c(columns)
    return F.transform(_count_up(_c(rows)), lambda i: F.slice(a, i * columns + 1, columns))


def restructure(flat, template) -> Column:
    """The flat list cut into the lengths of the template's sublists."""
    flat = _c(flat)
    sizes = F.transform(_c(template), lambda s: F.size(s))
    cut = F.aggregate(sizes, F.array(F.lit(0)), lambda acc, n: F.array_append(acc, F.element_at(acc, -1) + n))
    return F.transform(sizes, lambda n, i: F.slice(flat, F.get(cut, i) + 1, n))


def transpose(a, fill) -> Column:
    """Ragged transpose; gaps hold ``fill``."""
    a = _c(a)
    width = F.coalesce(F.array_max(F.transform(a, lambda s: F.size(s))), F.lit(0))
    return F.transform(_count_up(width), lambda j: F.transform(a, lambda s: F.coalesce(F.get(s, j), _c(fill))))


def transpose_at(a, level: int, fill) -> Column:
    return _at(_c(a), level, lambda s: transpose(s, fill))


def repeat(a, n) -> Column:
    """Each element n times."""
    n = _c(n)
    return F.flatten(F.transform(_c(a), lambda x: F.array_repeat(x, n)))


def repeat_by(a, counts) -> Column:
    """Each element as often as the corresponding count says."""
    counts = _c(counts)
    return F.flatten(F.transform(_c(a), lambda x, i: F.array_repeat(x, F.get(counts, i).cast("int"))))


def repeat_elements(a, n, depth: int) -> Column:
    return _at(_c(a), depth - 1, lambda s: repeat(s, n))


def replicate(a, n) -> Column:
    return F.flatten(F.array_repeat(_c(a), _c(n).cast("int")))


def reverse(a) -> Column:
    return F.reverse(_c(a))


def reverse_leaves(a, depth: int) -> Column:
    return _at(_c(a), depth - 1, lambda s: F.reverse(s))


def reverse_all(a, depth: int) -> Column:
    a = _c(a)
    for level in range(depth):
        a = _at(a, level, lambda s: F.reverse(s))
    return a


def cycle(a, k) -> Column:
    """Rotated right by k (left if negative)."""
    a, k = _c(a), _c(k)
    n = F.size(a)
    return F.transform(a, lambda x, i: F.get(a, F.pmod(i - k, n).cast("int")))


def shift(a, k, fill) -> Column:
    """Moved right by k (left if negative), the same length, gaps filled."""
    a, k = _c(a), _c(k)
    return F.transform(a, lambda x, i: F.when((i - k >= 0) & (i - k < F.size(a)), F.get(a, (i - k).cast("int"))).otherwise(_c(fill)))


def subshift(a, k, fill, depth: int) -> Column:
    return _at(_c(a), depth - 1, lambda s: shift(s, k, fill))


def permute(a, order) -> Column:
    a = _c(a)
    return F.transform(_c(order), lambda i: F.get(a, i.cast("int")))


choose = permute


def fill_sparse(values, times, start, stop, step) -> Column:
    """The value in force at each point of a regular grid: the last one at or before it, the first one before all."""
    values, times = _c(values), _c(times)

    def at(t: Column) -> Column:
        before = F.size(F.filter(times, lambda x: x <= t))
        return F.get(values, F.greatest(before - 1, F.lit(0)))

    n = F.floor((_c(stop) - _c(start)) / _c(step)).cast("int") + 1
    return F.transform(_count_up(n), lambda i: at(_c(start) + i * _c(step)))


def replace(a, mask, r) -> Column:
    mask = _c(mask)
    return F.transform(_c(a), lambda x, i: F.when(F.get(mask, i) != 0, _c(r)).otherwise(x))


def replace_each(a, mask, values) -> Column:
    """Masked elements replaced by successive values."""
    mask, values = _c(mask), _c(values)
    nth = F.transform(mask, lambda m, i: F.size(F.filter(F.slice(mask, F.lit(1), i), lambda y: y != 0)))
    return F.transform(_c(a), lambda x, i: F.when(F.get(mask, i) != 0, F.get(values, F.get(nth, i))).otherwise(x))


def replace_by_index(a, at, values) -> Column:
    """Scatter: the last value for a repeated index stays."""
    at, values = _c(at), _c(values)
    back_at, back = F.reverse(at), F.reverse(values)
    return F.transform(_c(a), lambda x, i: F.when(F.array_contains(at, i), F.get(back, (F.array_position(back_at, i) - 1).cast("int"))).otherwise(x))


def where(mask, yes, no) -> Column:
    yes, no = _c(yes), _c(no)
    return F.transform(_c(mask), lambda m, i: F.when(m != 0, F.get(yes, i)).otherwise(F.get(no, i)))


def remap(a, old: list, new: list) -> Column:
    """Values looked up in a literal dictionary, others kept; the type becomes that of the new values."""
    pairs = [F.lit(v) for p in zip(old, new, strict=True) for v in p]
    table = F.create_map(*pairs)
    kind = "string" if any(isinstance(v, str) for v in new) else "double" if any(isinstance(v, float) for v in new) else "long"
    return F.transform(_c(a), lambda x: F.coalesce(F.try_element_at(table, x).cast(kind), x.cast(kind)))


# --- selection and search


def select_mask(a, mask) -> Column:
    """Elements whose mask is non-zero; a shorter mask repeats."""
    mask = _c(mask)
    return F.filter(_c(a), lambda x, i: F.get(mask, (i % F.size(mask)).cast("int")) != 0)


def select_indices(a, at) -> Column:
    at = _c(at)
    wrong = F.exists(at, lambda i: i < 0)
    return F.when(wrong, F.raise_error(F.lit("negative index"))).otherwise(permute(a, at))


def find(a, v) -> Column:
    return (F.array_position(_c(a), _c(v)) - 1).cast("int")


def find_all(a, pattern) -> Column:
    """Every position at which the pattern starts."""
    a, pattern = _c(a), _c(pattern)
    k = F.size(pattern)
    return F.filter(_count_up(F.size(a) - k + 1), lambda i: F.slice(a, i + 1, k) == pattern)


def find_indices(keys, table) -> Column:
    """Last position in ``table`` of each key, -1 if absent."""
    table = _c(table)
    n, back = F.size(table), F.reverse(table)

    def one(k: Column) -> Column:
        at = F.array_position(back, k).cast("int")
        return F.when(at > 0, n - at).otherwise(-1)

    return F.transform(_c(keys), one)


def oneof(a, values) -> Column:
    values = _c(values)
    return F.transform(_c(a), lambda x: F.coalesce(F.array_contains(values, x), F.lit(False)).cast("int"))


def count_occurrences(a, values) -> Column:
    a = _c(a)
    return F.transform(_c(values), lambda v: F.size(F.filter(a, lambda x: x == v)))


def count_in(a, lo, hi) -> Column:
    """Elements in [lo, hi)."""
    return F.size(F.filter(_c(a), lambda x: (x >= _c(lo)) & (x < _c(hi))))


def counts_in(a, lo, hi, depth: int = 2) -> Column:
    return _at(_c(a), depth - 1, lambda s: count_in(s, lo, hi))


def hist(a, lo, hi, n: int) -> Column:
    """Counts of n equal bins [from, to); what lies outside is dropped."""
    a = _c(a)
    width = (_c(hi) - _c(lo)) / n
    of = F.transform(F.filter(a, lambda x: (x >= _c(lo)) & (x < _c(hi))), lambda x: F.floor((x - _c(lo)) / width).cast("int"))
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.size(F.filter(of, lambda b: b == i)))


def cut(x, breaks) -> Column:
    """i for breaks[i] < x <= breaks[i + 1], else -1."""
    breaks = _c(breaks)
    n = F.size(F.filter(breaks, lambda b: b < x))
    return F.when((n == 0) | (n == F.size(breaks)), F.lit(-1)).otherwise(n - 1)


# --- reductions


def length(a) -> Column:
    return F.size(_c(a))


def lengths(a) -> Column:
    return F.transform(_c(a), lambda s: F.size(s))


def leaf_lengths(a, depth: int) -> Column:
    return _at(_c(a), depth - 1, lambda s: F.size(s))


def total(a) -> Column:
    return F.aggregate(_c(a), F.lit(0.0), lambda acc, x: acc + x)


def int_total(a) -> Column:
    return F.aggregate(_c(a), F.lit(0).cast("long"), lambda acc, x: acc + x.cast("long"))


def sums(a, depth: int = 2) -> Column:
    """Sum of each innermost list, structure kept."""
    return _at(_c(a), depth - 1, total)


def prod(a) -> Column:
    return F.aggregate(_c(a), F.lit(1.0), lambda acc, x: acc * x)


def mean(a) -> Column:
    """0 of an empty list; NaN counts as an element and adds nothing."""
    a = _c(a)
    s = F.aggregate(a, F.lit(0.0), lambda acc, x: acc + F.nanvl(x.cast("double"), F.lit(0.0)))
    return F.when(F.size(a) == 0, F.lit(0.0)).otherwise(s / F.greatest(F.size(a), F.lit(1)))


def means(a, depth: int = 2) -> Column:
    return _at(_c(a), depth - 1, mean)


def leaf_means(a, depth: int = 2) -> Column:
    """Each innermost list becomes a list of its mean."""
    return _at(_c(a), depth - 1, lambda s: F.array(mean(s)))


def variance(a) -> Column:
    """Sample variance in two passes, 0 for fewer than two elements."""
    a = _c(a)
    m = mean(a)
    s = F.aggregate(F.transform(a, lambda x: F.pow(x - m, F.lit(2.0))), F.lit(0.0), lambda acc, x: acc + x)
    return F.when(F.size(a) < 2, F.lit(0.0)).otherwise(s / F.greatest(F.size(a) - 1, F.lit(1)))


def std(a) -> Column:
    return F.sqrt(variance(a))


def sem(a) -> Column:
    a = _c(a)
    return F.when(F.size(a) == 0, F.lit(0.0)).otherwise(std(a) / F.sqrt(F.greatest(F.size(a), F.lit(1))))


def ci95(a) -> Column:
    return 1.96 * sem(a)


def median(a) -> Column:
    a = F.array_sort(_c(a))
    n = F.size(a)
    hi = F.get(a, F.floor(n / 2).cast("int"))
    lo = F.get(a, F.greatest(F.floor((n - 1) / 2), F.lit(0)).cast("int"))
    return F.when(n == 0, F.lit(0.0)).otherwise((lo + hi) / 2.0)


def percentile(a, p: float) -> Column:
    """Nearest element, no interpolation."""
    a = F.array_sort(_c(a))
    at = F.least(F.size(a) - 1, F.floor(F.size(a) * F.lit(p) / 100 + 0.5).cast("int"))
    return F.get(a, F.lit(0) if p <= 0 else F.size(a) - 1 if p >= 100 else at)


def minimum(a) -> Column:
    return F.array_min(_c(a))


def maximum(a) -> Column:
    return F.array_max(_c(a))


def min_index(a) -> Column:
    """First position of the minimum."""
    a = _c(a)
    return (F.array_position(a, F.array_min(a)) - 1).cast("int")


def max_index(a) -> Column:
    a = _c(a)
    return (F.array_position(a, F.array_max(a)) - 1).cast("int")


def leaves(f: Fn, a, depth: int) -> Column:
    """A reduction at the innermost lists."""
    return _at(_c(a), depth - 1, f)


def longest(a) -> Column:
    return F.coalesce(F.array_max(lengths(a)), F.lit(0))


def shortest(a) -> Column:
    return F.coalesce(F.array_min(lengths(a)), F.lit(0))


def column_sums(a) -> Column:
    """Across sublists of equal length."""
    return F.transform(transpose(a, 0), total)


def column_means(a) -> Column:
    return F.transform(transpose(a, 0), mean)


def columns(f: Fn, a) -> Column:
    """Any reduction across sublists (std, sem, ci95 ...)."""
    return F.transform(transpose(a, 0), f)


def any_of(a) -> Column:
    return F.coalesce(F.exists(_c(a), lambda x: x != 0), F.lit(False)).cast("int")


def all_of(a) -> Column:
    return F.coalesce(F.forall(_c(a), lambda x: x != 0), F.lit(True)).cast("int")


def anys(a) -> Column:
    return F.transform(_c(a), any_of)


def alls(a) -> Column:
    return F.transform(_c(a), all_of)


# --- order


def sort(a, depth: int = 1) -> Column:
    return _at(_c(a), depth - 1, lambda s: F.array_sort(s))


def sort_indices(a, depth: int = 1) -> Column:
    """The order that sorts, ties in place order."""
    def one(s: Column) -> Column:
        return F.transform(F.array_sort(F.transform(s, lambda x, i: F.struct(x.alias("x"), i.alias("i")))), lambda p: p["i"])

    return _at(_c(a), depth - 1, one)


def multisort(*keys) -> Column:
    """The order that sorts by several lists, the first most significant."""
    keys = list(map(_c, keys))
    rows = F.transform(keys[0], lambda x, i: F.struct(*(F.get(k, i).alias(f"k{n}") for n, k in enumerate(keys)), i.alias("i")))
    return F.transform(F.array_sort(rows), lambda p: p["i"])


def unique(a, depth: int = 1) -> Column:
    return _at(_c(a), depth - 1, lambda s: F.array_sort(F.array_distinct(s)))


def unique_adjacent(a) -> Column:
    """Runs of equal elements collapsed."""
    a = _c(a)
    return F.filter(a, lambda x, i: (i == 0) | ~x.eqNullSafe(F.get(a, i - 1)))


def rank_within(a) -> Column:
    """How often each element has occurred before."""
    a = _c(a)
    return F.transform(a, lambda x, i: F.size(F.filter(F.slice(a, F.lit(1), i), lambda y: y == x)))


def recode(a) -> Column:
    """Position of each element among the sorted distinct ones."""
    u = unique(a)
    return F.transform(_c(a), lambda x: (F.array_position(u, x) - 1).cast("int"))


def recode_from(a, reference) -> Column:
    u = unique(reference)
    return F.transform(_c(a), lambda x: (F.array_position(u, x) - 1).cast("int"))


def recode_with_ties(a) -> Column:
    """0-based mid-ranks."""
    a = _c(a)
    return F.transform(a, lambda x: F.size(F.filter(a, lambda y: y < x)) + (F.size(F.filter(a, lambda y: y == x)) - 1) / 2.0)


# --- ordered


def cumsum(a) -> Column:
    start = F.array().cast("array<double>")
    return F.aggregate(_c(a), start, lambda acc, x: F.concat(acc, F.array(F.coalesce(F.get(acc, F.size(acc) - 1), F.lit(0.0)) + x)))


def cumprod(a) -> Column:
    start = F.array().cast("array<double>")
    return F.aggregate(_c(a), start, lambda acc, x: F.concat(acc, F.array(F.coalesce(F.get(acc, F.size(acc) - 1), F.lit(1.0)) * x)))


def diff(a, lag: int = 1) -> Column:
    a = _c(a)
    return F.transform(_count_up(F.size(a) - lag), lambda i: F.get(a, i + lag) - F.get(a, i))


def idiff(a, b) -> Column:
    """All differences x - y."""
    b = _c(b)
    return F.flatten(F.transform(_c(a), lambda x: F.transform(b, lambda y: x - y)))


def idiff_self(a) -> Column:
    """All differences between elements at different places."""
    a = _c(a)
    return F.flatten(F.transform(a, lambda x, i: F.transform(F.filter(a, lambda y, j: j != i), lambda y: x - y)))


def gradient(a, whole: bool = False) -> Column:
    """Central differences, one-sided at the ends; halves of ints truncate."""
    a = _c(a)
    n = F.size(a)

    def half(d: Column) -> Column:
        return F.call_function("div", d.cast("long"), F.lit(2).cast("long")) if whole else d / 2.0

    kind = "long" if whole else "double"
    zero = F.lit(0).cast(kind)

    def one(x: Column, i: Column) -> Column:
        here = F.when(n == 1, zero).when(i == 0, (F.get(a, F.lit(1)) - x).cast(kind)).when(i == n - 1, (x - F.get(a, i - 1)).cast(kind))
        return here.otherwise(half(F.get(a, i + 1) - F.get(a, i - 1)))

    return F.transform(a, one)


def zero_crossings(a) -> Column:
    """1 where the sign turns from - to +, -1 from + to -, counted where the turn starts; a zero between counts; 0 in front."""
    a = _c(a)

    def mark(i: Column) -> Column:
        x, after, before = F.get(a, i), F.get(a, i + 1), F.get(a, F.when(i > 0, i - 1))
        from_here = F.when(x == 0, before).otherwise(x)
        return F.when((from_here < 0) & (after > 0), 1).when((from_here > 0) & (after < 0), -1).otherwise(0)

    return F.concat(F.array(F.lit(0)), F.transform(_count_up(F.size(a) - 1), mark))


def conv(a, kernel) -> Column:
    """Zero-padded correlation with a kernel of odd length, not flipped."""
    a, kernel = _c(a), _c(kernel)
    half = F.floor(F.size(kernel) / 2).cast("int")

    def one(i: Column) -> Column:
        taps = F.transform(kernel, lambda k, j: k * F.coalesce(F.get(a, F.when(i + j - half >= 0, i + j - half)), F.lit(0)))
        return F.aggregate(taps, F.lit(0.0), lambda acc, t: acc + t)

    return F.when(F.size(kernel) % 2 == 0, F.raise_error(F.lit("kernel length must be odd"))).otherwise(F.transform(_count_up(F.size(a)), one))


# --- comprehension verbs

mapped = each


def filtered(pred: Fn, a) -> Column:
    return F.filter(_c(a), pred)


def reduced(merge: Callable[[Column, Column], Column], a, start) -> Column:
    return F.aggregate(_c(a), _c(start), merge)


def comprehension(a, pred: Fn | None = None, f: Fn | None = None) -> Column:
    out = F.filter(_c(a), pred) if pred else _c(a)
    return F.transform(out, f) if f else out


# --- polygons and curves as arrays of structs x, y


def shoelace(p) -> Column:
    """Signed area of a polygon of structs x, y."""
    p = _c(p)
    n = F.size(p)
    parts = F.transform(p, lambda q, i: q["x"] * F.get(p, (i + 1) % n)["y"] - F.get(p, (i + 1) % n)["x"] * q["y"])
    return total(parts) / 2


def centroid(p) -> Column:
    """Area centroid of a polygon."""
    p = _c(p)
    n = F.size(p)

    def part(axis: str) -> Column:
        return total(F.transform(p, lambda q, i: (q[axis] + F.get(p, (i + 1) % n)[axis]) * (q["x"] * F.get(p, (i + 1) % n)["y"] - F.get(p, (i + 1) % n)["x"] * q["y"])))

    area = shoelace(p)
    return F.struct((part("x") / (6 * area)).alias("x"), (part("y") / (6 * area)).alias("y"))


def closed(p) -> Column:
    """The polygon with its first point repeated at the end, if it isn't there."""
    p = _c(p)
    return F.when(F.get(p, F.lit(0)) == F.get(p, F.size(p) - 1), p).otherwise(F.array_append(p, F.get(p, F.lit(0))))
