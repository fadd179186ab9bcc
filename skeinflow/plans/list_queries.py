"""Queries over lists (the lines of each order), one for each kind of list operator, with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from skeinflow.functions import lists, scalar
from skeinflow.plans.catalog import query
from skeinflow.plans.queries import _L, _orders_lists

#: k, and p and q: prices and quantities of the lines of an order, in line order.  n: positions from 1.
_N = "range(1, len(q) + 1)"


def _round(x: Column) -> Column:
    """To 4 digits as SQL does it: the double is scaled, then rounded to a whole number, halves away from zero.  (F.round rounds the
    shortest decimal that reads back as the double instead, so quotients next to a half can differ.)"""
    x = x.cast("double")
    near = F.round(x * 1e4) / 1e4
    return F.when(F.isnan(near) | (F.abs(near) == float("inf")), x).otherwise(near)


def _listed(name: str, sql: str, build: Callable[[], Column]) -> None:
    """(k, i, x): the elements of a list of numbers."""

    def run(spark, d):
        rows = _orders_lists(spark, d).select("k", F.posexplode(build()).alias("i", "x"))
        return rows.select("k", "i", _round(F.col("x")).alias("x"))

    query(name, _L + f"SELECT k, i, round(x::DOUBLE, 4) AS x FROM (SELECT k, unnest(range(len(e)))::INTEGER AS i, unnest(e) AS x FROM (SELECT k, {sql} AS e FROM o))")(run)


def _nested(name: str, sql: str, build: Callable[[], Column]) -> None:
    """(k, i, j, x): the elements of a list of lists."""

    def run(spark, d):
        rows = _orders_lists(spark, d).select("k", F.posexplode(build()).alias("i", "s")).select("k", "i", F.posexplode("s").alias("j", "x"))
        return rows.select("k", "i", "j", _round(F.col("x")).alias("x"))

    outer = f"SELECT k, unnest(range(len(e)))::INTEGER AS i, unnest(e) AS s FROM (SELECT k, {sql} AS e FROM o)"
    query(name, _L + f"SELECT k, i, j, round(x::DOUBLE, 4) AS x FROM (SELECT k, i, unnest(range(len(s)))::INTEGER AS j, unnest(s) AS x FROM ({outer}))")(run)


def _valued(name: str, sql: str, build: Callable[[], Column]) -> None:
    """(k, x): a number of each list."""

    def run(spark, d):
        return _orders_lists(spark, d).select("k", _round(build()).alias("x"))

    query(name, _L + f"SELECT k, round(({sql})::DOUBLE, 4) AS x FROM o")(run)


def _large(a: str = "q", bound: float = 25.0) -> Column:
    """1 where an element exceeds the bound."""
    return lists.each(lambda x: scalar.gt(x, bound), a)


def _both() -> Column:
    return F.array("p", "q")


# --- constructors

_listed("list_zeros", "list_transform(q, lambda x: 0)", lambda: lists.zeros(F.size("q")))
_listed("list_ones", "list_transform(q, lambda x: 1)", lambda: lists.ones(F.size("q")))
_listed("list_upto", "range(len(q))", lambda: lists.upto(F.size("q")))
_listed("list_series", "range(0, len(q) + 1, 2)", lambda: lists.series(F.lit(0), F.size("q"), F.lit(2)))
_listed("list_fromto", "range(1, len(q) + 1)", lambda: lists.fromto(F.lit(1), F.size("q") + 1, F.lit(1)))
_listed("list_bins", "list_transform(range(len(q)), lambda i: (i + 0.5) * 10.0 / len(q))", lambda: lists.bins(F.lit(0.0), F.lit(10.0), F.size("q")))
_listed("list_index", "range(len(q))", lambda: lists.index("q"))
_listed("list_first_pos", "[0]", lambda: lists.first_pos("q"))
_listed("list_last_pos", "[len(q) - 1]", lambda: lists.last_pos("q"))
_listed("list_gaussian2d", "flatten(list_transform(range(3), lambda i: list_transform(range(3), lambda j: exp(-(pow(i - 1, 2) + pow(j - 1, 2)) / 4.0))))", lambda: lists.gaussian2d(3, 3, 2.0))

# --- structure

_listed("list_append", "list_append(q, 1.5)", lambda: lists.append("q", F.lit(1.5)))
_listed("list_prepend", "list_prepend(1.5, q)", lambda: lists.prepend("q", F.lit(1.5)))
_listed("list_insert", "list_concat(list_append(q[1:1], 1.5), q[2:])", lambda: lists.insert("q", F.lit(1.5), 1))
_listed("list_put", "list_prepend(0.5, q[2:])", lambda: lists.put("q", F.lit(0), F.lit(0.5)))
_valued("list_get", "q[1]", lambda: lists.get("q", F.lit(0)))
_valued("list_last", "q[-1]", lambda: lists.last("q"))
_listed("list_increment", "list_append(q, q[-1] + 1)", lambda: lists.increment("q"))
_nested("list_zip", f"list_transform({_N}, lambda i: [p[i], q[i]])", lambda: lists.zipped("p", "q"))
_nested("list_combine_inner", f"list_transform({_N}, lambda i: [p[i], q[i]])", lambda: lists.combine_inner(lists.pack("p"), lists.pack("q")))
_nested("list_splice_before", "list_transform(q, lambda x: [9.0, x])", lambda: lists.splice_before(F.array(F.lit(9.0)), lists.pack("q")))
_nested("list_splice_after", "list_transform(q, lambda x: [x, 9.0])", lambda: lists.splice_after(F.array(F.lit(9.0)), lists.pack("q")))
_nested("list_pack", "list_transform(q, lambda x: [x])", lambda: lists.pack("q"))
_nested("list_deep_pack", "list_concat(list_transform(p, lambda x: [x]), list_transform(q, lambda x: [x]))", lambda: lists.collapse(lists.deep_pack(_both(), 2)))
_listed("list_unpack", f"flatten(list_transform({_N}, lambda i: [p[i], q[i]]))", lambda: lists.unpack(lists.zipped("p", "q")))
_nested("list_deep_unpack", "[p, q]", lambda: lists.deep_unpack(lists.deep_pack(_both(), 2), 3))
_listed("list_collapse", "list_concat(p, q)", lambda: lists.collapse(_both()))
_nested("list_leaf_lists", "[p, q, p, q]", lambda: lists.leaf_lists(F.array(_both(), _both()), 3))
_nested("list_reshape", "list_transform(range((len(q) + 1) // 2), lambda i: q[i * 2 + 1:i * 2 + 2])", lambda: lists.reshape("q", F.floor((F.size("q") + 1) / 2), F.lit(2)))
_nested(
    "list_restructure", "list_transform(range((len(q) + 1) // 2), lambda i: q[i * 2 + 1:i * 2 + 2])",
    lambda: lists.restructure(F.col("q"), lists.reshape("p", F.floor((F.size("p") + 1) / 2), F.lit(2))),
)
_nested("list_transposed", f"list_transform({_N}, lambda i: [p[i], q[i]])", lambda: lists.transpose(_both(), F.lit(0.0)))
_nested("list_ragged_transpose", f"list_transform({_N}, lambda i: [p[i], CASE WHEN i = 1 THEN q[1] ELSE -1 END])", lambda: lists.transpose(F.array(F.col("p"), F.slice("q", 1, 1)), F.lit(-1.0)))
_nested("list_transpose_at", f"list_transform({_N}, lambda i: [p[i], q[i]])", lambda: lists.first(lists.transpose_at(F.array(_both()), 1, F.lit(0.0))))
_nested("list_repeat_elements", "[flatten(list_transform(p, lambda x: [x, x])), flatten(list_transform(q, lambda x: [x, x]))]", lambda: lists.repeat_elements(_both(), F.lit(2), 2))
_listed("list_replicate", "list_concat(list_concat(q, q), q)", lambda: lists.replicate("q", F.lit(3)))
_listed(
    "list_repeat_by", f"flatten(list_transform({_N}, lambda i: list_transform(range(i % 3), lambda j: q[i])))",
    lambda: lists.repeat_by("q", F.transform("q", lambda x, i: (i + 1) % 3)),
)
_nested("list_reverse_leaves", "[list_reverse(p), list_reverse(q)]", lambda: lists.reverse_leaves(_both(), 2))
_nested("list_reverse_all", "[list_reverse(q), list_reverse(p)]", lambda: lists.reverse_all(_both(), 2))
_nested("list_subshift", "[list_prepend(0.0, p[1:len(p) - 1]), list_prepend(0.0, q[1:len(q) - 1])]", lambda: lists.subshift(_both(), F.lit(1), F.lit(0.0), 2))
_listed("list_permute", "list_reverse(q)", lambda: lists.permute("q", F.reverse(lists.index("q"))))
_listed("list_fill", "list_transform(range(2 * len(q) - 1), lambda i: q[i // 2 + 1])", lambda: lists.fill_sparse("q", lists.index("q"), F.lit(0), F.size("q") - 1, F.lit(0.5)))
_listed("list_replace", "list_transform(q, lambda x: CASE WHEN x > 25 THEN -1 ELSE x END)", lambda: lists.replace("q", _large(), F.lit(-1.0)))
_listed(
    "list_replace_each", f"list_transform({_N}, lambda i: CASE WHEN q[i] > 25 THEN p[len(list_filter(q[1:i], lambda y: y > 25))] ELSE q[i] END)",
    lambda: lists.replace_each("q", _large(), "p"),
)
_listed("list_replace_by_index", "list_prepend(8.0, q[2:])", lambda: lists.replace_by_index("q", F.array(F.lit(0), F.lit(0)), F.array(F.lit(7.0), F.lit(8.0))))
_listed("list_where", f"list_transform({_N}, lambda i: CASE WHEN q[i] > 25 THEN p[i] ELSE q[i] END)", lambda: lists.where(_large(), "p", "q"))
_listed("list_times_one", "list_transform(q, lambda x: x * 2)", lambda: lists.pairwise(lambda a, b: a * b, "q", F.array(F.lit(2.0))))
_listed("list_div_rows", f"list_transform({_N}, lambda i: p[i] / q[i])", lambda: lists.pairwise(scalar.div, "p", "q"))

# --- selection and search

_listed("list_select_recycled", "list_transform(list_filter(range(len(q)), lambda i: i % 2 = 0), lambda i: q[i + 1])", lambda: lists.select_mask("q", F.array(F.lit(1), F.lit(0))))
_listed("list_select_indices", "[q[len(q)], q[1]]", lambda: lists.select_indices("q", F.array(F.size("q") - 1, F.lit(0))))
_valued("list_find", "list_position(q, q[-1]) - 1", lambda: lists.find("q", lists.last("q")))
_listed("list_find_all", f"list_transform(list_filter({_N}, lambda i: q[i] = q[1]), lambda i: i - 1)", lambda: lists.find_all("q", F.slice("q", 1, 1)))
_listed("list_find_indices", "list_transform(q, lambda x: list_max(list_filter(range(len(q)), lambda i: q[i + 1] = x)))", lambda: lists.find_indices("q", "q"))
_listed("list_oneof", "list_transform(q, lambda x: CASE WHEN x IN (1, 2, 30) THEN 1 ELSE 0 END)", lambda: lists.oneof("q", F.array(F.lit(1.0), F.lit(2.0), F.lit(30.0))))
_listed("list_count_occurrences", "list_transform(q, lambda x: len(list_filter(q, lambda y: y = x)))", lambda: lists.count_occurrences("q", "q"))
_valued("list_count_in", "len(list_filter(q, lambda x: x >= 10 AND x < 30))", lambda: lists.count_in("q", F.lit(10.0), F.lit(30.0)))
_listed(
    "list_counts_in", "[len(list_filter(p, lambda x: x >= 10 AND x < 30)), len(list_filter(q, lambda x: x >= 10 AND x < 30))]",
    lambda: lists.counts_in(_both(), F.lit(10.0), F.lit(30.0), 2),
)
_listed(
    "list_cut", "list_transform(q, lambda x: CASE WHEN x > 0 AND x <= 10 THEN 0 WHEN x > 10 AND x <= 30 THEN 1 ELSE -1 END)",
    lambda: lists.each(lambda x: lists.cut(x, F.array(F.lit(0.0), F.lit(10.0), F.lit(30.0))), "q"),
)

# --- reductions

_listed("list_lengths", "[len(p), len(q), 1]", lambda: lists.lengths(F.array(F.col("p"), F.col("q"), F.slice("q", 1, 1))))
_listed("list_sums", "[list_sum(p), list_sum(q)]", lambda: lists.sums(_both()))
_listed("list_means", "[list_avg(p), list_avg(q)]", lambda: lists.means(_both()))
_nested("list_leaf_means", "[[list_avg(p)], [list_avg(q)]]", lambda: lists.leaf_means(_both()))
_listed("list_prods", "[list_product(q), 1]", lambda: lists.leaves(lists.prod, F.array(F.col("q"), F.slice("q", 1, 0)), 2))
_listed("list_vars", "[coalesce(list_var_samp(q), 0), 0]", lambda: lists.leaves(lists.variance, F.array(F.col("q"), F.slice("q", 1, 1)), 2))
_listed("list_stds", "[coalesce(list_stddev_samp(q), 0), 0]", lambda: lists.leaves(lists.std, F.array(F.col("q"), F.slice("q", 1, 1)), 2))
_valued("list_sem", "coalesce(list_stddev_samp(q) / sqrt(len(q)), 0)", lambda: lists.sem("q"))
_valued("list_ci95", "1.96 * coalesce(list_stddev_samp(q) / sqrt(len(q)), 0)", lambda: lists.ci95("q"))
_listed("list_medians", "[list_median(p), list_median(q)]", lambda: lists.leaves(lists.median, _both(), 2))
_valued("list_percentile", "list_sort(q)[least(len(q) - 1, floor(len(q) * 0.7 + 0.5))::BIGINT + 1]", lambda: lists.percentile("q", 70))
_listed("list_mins", "[list_min(p), list_min(q)]", lambda: lists.leaves(lists.minimum, _both(), 2))
_listed("list_maxs", "[list_max(p), list_max(q)]", lambda: lists.leaves(lists.maximum, _both(), 2))
_listed("list_min_indices", "[list_position(p, list_min(p)) - 1, list_position(q, list_min(q)) - 1]", lambda: lists.leaves(lists.min_index, _both(), 2))
_listed("list_max_indices", "[list_position(p, list_max(p)) - 1, list_position(q, list_max(q)) - 1]", lambda: lists.leaves(lists.max_index, _both(), 2))
_valued("list_longest", "len(q)", lambda: lists.longest(F.array(F.slice("q", 1, 1), F.col("p"))))
_valued("list_shortest", "1", lambda: lists.shortest(F.array(F.slice("q", 1, 1), F.col("p"))))
_listed("list_column_sums", f"list_transform({_N}, lambda i: p[i] + q[i])", lambda: lists.column_sums(_both()))
_listed("list_column_means", f"list_transform({_N}, lambda i: (p[i] + q[i]) / 2)", lambda: lists.column_means(_both()))
_listed("list_column_stds", f"list_transform({_N}, lambda i: abs(p[i] - q[i]) / sqrt(2))", lambda: lists.columns(lists.std, _both()))
_listed("list_column_sems", f"list_transform({_N}, lambda i: abs(p[i] - q[i]) / 2)", lambda: lists.columns(lists.sem, _both()))
_listed("list_column_ci95s", f"list_transform({_N}, lambda i: 1.96 * abs(p[i] - q[i]) / 2)", lambda: lists.columns(lists.ci95, _both()))
_listed("list_anys", "[CASE WHEN list_max(q) > 25 THEN 1 ELSE 0 END, 0]", lambda: lists.anys(F.array(_large(), _large("q", 1e9))))
_listed("list_alls", "[CASE WHEN list_min(q) > 25 THEN 1 ELSE 0 END, 1]", lambda: lists.alls(F.array(_large(), _large("q", -1.0))))

# --- order

_nested("list_bsort", "[list_sort(p), list_sort(q)]", lambda: lists.sort(_both(), 2))
_listed("list_bsort_indices", "list_transform(list_sort(list_transform(range(len(q)), lambda i: {'x': q[i + 1], 'i': i})), lambda s: s.i)", lambda: lists.last(lists.sort_indices(_both(), 2)))
_listed(
    "list_multisort", "list_transform(list_sort(list_transform(range(len(q)), lambda i: {'a': q[i + 1], 'b': p[i + 1], 'i': i})), lambda s: s.i)",
    lambda: lists.multisort("q", "p"),
)
_listed("list_unique_adjacent", f"list_transform(list_filter({_N}, lambda i: i = 1 OR q[i] <> q[i - 1]), lambda i: q[i])", lambda: lists.unique_adjacent("q"))
_listed("list_rank", f"list_transform({_N}, lambda i: len(list_filter(q[1:i - 1], lambda y: y = q[i])))", lambda: lists.rank_within("q"))
_listed("list_recode", "list_transform(q, lambda x: list_position(list_sort(list_distinct(q)), x) - 1)", lambda: lists.recode("q"))
_listed("list_recode_from", "list_transform(q, lambda x: coalesce(list_position([1.0, 2.0, 30.0], x), 0) - 1)", lambda: lists.recode_from("q", F.array(F.lit(30.0), F.lit(2.0), F.lit(1.0), F.lit(2.0))))
_listed("list_recode_ties", "list_transform(q, lambda x: len(list_filter(q, lambda y: y < x)) + (len(list_filter(q, lambda y: y = x)) - 1) / 2.0)", lambda: lists.recode_with_ties("q"))
_listed("list_cumprod", f"list_transform({_N}, lambda i: list_product(q[1:i]))", lambda: lists.cumprod("q"))
_listed("list_idiff", "flatten(list_transform(p, lambda x: list_transform(q, lambda y: x - y)))", lambda: lists.idiff("p", "q"))
_listed("list_idiff_self", f"flatten(list_transform({_N}, lambda i: list_transform(list_filter({_N}, lambda j: j <> i), lambda j: q[i] - q[j])))", lambda: lists.idiff_self("q"))
_listed(
    "list_gradient", f"list_transform({_N}, lambda i: CASE WHEN len(q) = 1 THEN 0 WHEN i = 1 THEN q[2] - q[1] WHEN i = len(q) THEN q[i] - q[i - 1] ELSE (q[i + 1] - q[i - 1]) / 2 END)",
    lambda: lists.gradient("q"),
)
_FROM = "CASE WHEN q[i] = 25 THEN q[i - 1] ELSE q[i] END"
_listed(
    "list_zero_crossings", f"list_prepend(0, list_transform(range(1, len(q)), lambda i: CASE WHEN {_FROM} < 25 AND q[i + 1] > 25 THEN 1 WHEN {_FROM} > 25 AND q[i + 1] < 25 THEN -1 ELSE 0 END))",
    lambda: lists.zero_crossings(lists.each(lambda x: x - 25, "q")),
)

# --- comprehension verbs

_listed("list_mapped", "list_transform(q, lambda x: sqrt(x) + 1)", lambda: lists.mapped(lambda x: F.sqrt(x) + 1, "q"))
_listed("list_filtered", "list_filter(q, lambda x: x > 10)", lambda: lists.filtered(lambda x: x > 10, "q"))
_valued("list_reduced", "list_reduce(list_prepend(0.0, q), lambda a, x: a * 0.5 + x)", lambda: lists.reduced(lambda a, x: a * 0.5 + x, "q", F.lit(0.0)))
