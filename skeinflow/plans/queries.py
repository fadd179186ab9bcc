"""Queries over the test tables, one or more for each kind of operator, with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skeinflow.domain import cluster, curves, eye, spikes, trajectory, tuning
from skeinflow.functions import jsonfns, lists, noise, scalar
from skeinflow.operators import asof, frame, grouping, matrix, membership, ordered, parallel, sessions, signal, stats
from skeinflow.plans.catalog import query
from skeinflow.streaming import feeds


def t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def r4(c, name: str):
    return F.round(c, 4).alias(name)


# --- scan, mask, dense groups


@query(
    "dense_group_mean",
    """WITH l AS (SELECT * FROM lineitem WHERE l_quantity > 25),
    g AS (SELECT a.l_returnflag, b.l_linestatus FROM (SELECT DISTINCT l_returnflag FROM l) a CROSS JOIN (SELECT DISTINCT l_linestatus FROM l) b)
    SELECT g.l_returnflag, g.l_linestatus, round(coalesce(avg(l_extendedprice), 0), 4) AS mean_price, count(l_orderkey)::BIGINT AS n
    FROM g LEFT JOIN l USING (l_returnflag, l_linestatus) GROUP BY ALL""",
)
def dense_group_mean(spark, d):
    rows = t(spark, d, "lineitem").where(F.col("l_quantity") > 25)
    return grouping.dense_agg(rows, ["l_returnflag", "l_linestatus"], {"mean_price": F.round(stats.mean("l_extendedprice"), 4), "n": F.count("*")}, {"mean_price": 0.0})


@query(
    "dense_group_given",
    """WITH g AS (SELECT s AS o_orderstatus, p AS o_orderpriority FROM (VALUES ('F'), ('Z')) a(s) CROSS JOIN (VALUES ('1-URGENT'), ('none')) b(p))
    SELECT g.o_orderstatus, g.o_orderpriority, count(o_orderkey)::BIGINT AS n, round(coalesce(sum(o_totalprice), 0), 2) AS total
    FROM g LEFT JOIN orders o ON g.o_orderstatus = o.o_orderstatus AND g.o_orderpriority = o.o_orderpriority GROUP BY ALL""",
)
def dense_group_given(spark, d):
    values = {"o_orderstatus": ["F", "Z"], "o_orderpriority": ["1-URGENT", "none"]}
    return grouping.dense_agg(t(spark, d, "orders"), list(values), {"n": F.count("*"), "total": F.round(F.sum("o_totalprice"), 2)}, {"total": 0.0}, values)


@query(
    "sorted_lists",
    """SELECT o_orderstatus, o_orderpriority, count(*)::BIGINT AS n, sum(o_orderkey)::BIGINT AS key_sum, min(o_orderkey) AS first_key
    FROM orders GROUP BY ALL""",
)
def sorted_lists(spark, d):
    cells = grouping.sorted_by(t(spark, d, "orders"), ["o_orderstatus", "o_orderpriority"], "o_orderkey", order="o_orderkey").where(F.size("o_orderkey") > 0)
    return cells.select("o_orderstatus", "o_orderpriority", F.size("o_orderkey").cast("long").alias("n"), lists.int_total("o_orderkey").alias("key_sum"), lists.first("o_orderkey").alias("first_key"))


@query("group_split", "SELECT o_custkey, (row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1)::INTEGER AS i, o_totalprice FROM orders")
def group_split(spark, d):
    lists_of = grouping.split(t(spark, d, "orders"), "o_custkey", "o_totalprice", "o_orderkey")
    return lists_of.select("o_custkey", F.posexplode("o_totalprice").alias("i", "o_totalprice"))


# --- elementwise


@query(
    "arith",
    """SELECT l_orderkey, l_linenumber, round(l_extendedprice + l_tax + l_quantity, 4) AS a, round(l_extendedprice - l_tax, 4) AS s, round(l_extendedprice * (1 - l_discount), 4) AS m,
    least(l_quantity, 10) AS lo, greatest(l_quantity, 10) AS hi, round(pow(l_quantity, 2), 4) AS p, round(atan2(l_quantity, l_discount + 1), 4) AS at, round(l_extendedprice % 7, 4) AS fm FROM lineitem""",
)
def arith(spark, d):
    return t(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", r4(scalar.add("l_extendedprice", "l_tax", "l_quantity"), "a"), r4(scalar.sub("l_extendedprice", "l_tax"), "s"),
        r4(scalar.mult("l_extendedprice", 1 - F.col("l_discount")), "m"), scalar.least("l_quantity", F.lit(10.0)).alias("lo"), scalar.greatest("l_quantity", F.lit(10.0)).alias("hi"),
        r4(scalar.power("l_quantity", 2), "p"), r4(scalar.atan2("l_quantity", F.col("l_discount") + 1), "at"), r4(scalar.fmod("l_extendedprice", F.lit(7.0)), "fm"),
    )


@query(
    "div_guarded",
    "SELECT l_orderkey, l_linenumber, round(CASE WHEN l_discount = 0 THEN 0 ELSE l_tax / l_discount END, 4) AS q FROM lineitem",
)
def div_guarded(spark, d):
    return t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", r4(scalar.div("l_tax", "l_discount"), "q"))


@query(
    "int_div_trunc",
    "SELECT o_orderkey, CASE WHEN o_custkey % 5 = 0 THEN 0 ELSE (o_orderkey - 5000) // (o_custkey % 5) END::BIGINT AS q, ((o_orderkey - 5000) % 7)::BIGINT AS m FROM orders",
)
def int_div_trunc(spark, d):
    return t(spark, d, "orders").select("o_orderkey", scalar.int_div(F.col("o_orderkey") - 5000, F.col("o_custkey") % 5).alias("q"), scalar.mod(F.col("o_orderkey") - 5000, F.lit(7)).alias("m"))


@query(
    "math_unary",
    """SELECT c_custkey, round(abs(c_acctbal), 4) AS ab, ceil(c_acctbal)::BIGINT AS ce, floor(c_acctbal)::BIGINT AS fl, round(cos(c_acctbal), 4) AS co, round(sin(c_acctbal), 4) AS si,
    round(tanh(c_acctbal / 1000), 4) AS th, round(exp(c_acctbal / 1000), 4) AS ex, round(sqrt(abs(c_acctbal)), 4) AS sq, round(ln(abs(c_acctbal) + 1), 4) AS lo,
    round(log10(abs(c_acctbal) + 1), 4) AS lg, sign(c_acctbal)::INTEGER AS sg, (sign(c_acctbal) * floor(abs(c_acctbal) + 0.5))::BIGINT AS ro, round(-c_acctbal, 4) AS ne, round(atan(c_acctbal), 4) AS an FROM customer""",
)
def math_unary(spark, d):
    x, u = F.col("c_acctbal"), scalar.UNARY
    return t(spark, d, "customer").select(
        "c_custkey", r4(u["abs"](x), "ab"), u["ceil"](x).cast("long").alias("ce"), u["floor"](x).cast("long").alias("fl"), r4(u["cos"](x), "co"), r4(u["sin"](x), "si"), r4(u["tanh"](x / 1000), "th"),
        r4(u["exp"](x / 1000), "ex"), r4(u["sqrt"](F.abs(x)), "sq"), r4(u["log"](F.abs(x) + 1), "lo"), r4(u["log10"](F.abs(x) + 1), "lg"), u["sign"](x).alias("sg"), u["round"](x).cast("long").alias("ro"),
        r4(u["negate"](x), "ne"), r4(u["atan"](x), "an"),
    )


@query(
    "comparisons",
    """SELECT l_orderkey, l_linenumber, (l_quantity > 25)::INTEGER AS g, (l_quantity >= 25)::INTEGER AS ge, (l_quantity < 25)::INTEGER AS l, (l_quantity <= 25)::INTEGER AS le, (l_quantity = 25)::INTEGER AS e,
    (l_returnflag >= 'N')::INTEGER AS sg, (l_quantity > 10 AND l_discount <> 0)::INTEGER AS an, (l_quantity > 40 OR l_discount <> 0)::INTEGER AS o, (l_discount = 0)::INTEGER AS n FROM lineitem""",
)
def comparisons(spark, d):
    q = F.col("l_quantity")
    return t(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", scalar.gt(q, 25).alias("g"), scalar.gte(q, 25).alias("ge"), scalar.lt(q, 25).alias("l"), scalar.lte(q, 25).alias("le"), scalar.eq(q, 25).alias("e"),
        scalar.gte("l_returnflag", F.lit("N")).alias("sg"), scalar.both(scalar.gt(q, 10), "l_discount").alias("an"), scalar.either(scalar.gt(q, 40), "l_discount").alias("o"), scalar.negation("l_discount").alias("n"),
    )


@query(
    "between_closeto_oneof_where",
    """SELECT l_orderkey, l_linenumber, (l_quantity > 10 AND l_quantity < 20)::INTEGER AS b, (l_quantity BETWEEN 10 AND 20)::INTEGER AS be, (l_quantity >= 10 AND l_quantity < 20)::INTEGER AS bl,
    (l_quantity > 10 AND l_quantity <= 20)::INTEGER AS bh, (abs(l_discount - 0.05) < 0.0001)::INTEGER AS c, (l_returnflag IN ('A', 'R'))::INTEGER AS o, CASE WHEN l_quantity > 25 THEN l_tax ELSE l_discount END AS w FROM lineitem""",
)
def between_closeto_oneof_where(spark, d):
    q = F.col("l_quantity")
    return t(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", scalar.between(q, 10, 20).alias("b"), scalar.between(q, 10, 20, True, True).alias("be"), scalar.between(q, 10, 20, low=True).alias("bl"), scalar.between(q, 10, 20, high=True).alias("bh"),
        scalar.closeto("l_discount", 0.05).alias("c"), scalar.oneof("l_returnflag", ["A", "R"]).alias("o"), scalar.where(scalar.gt(q, 25), "l_tax", "l_discount").alias("w"),
    )


@query(
    "conversions",
    """SELECT o_orderkey, trunc(o_totalprice)::BIGINT AS i, CASE WHEN o_orderkey & 255 > 127 THEN (o_orderkey & 255) - 256 ELSE o_orderkey & 255 END::SMALLINT AS c, (o_orderkey & 255)::SMALLINT AS u,
    o_orderkey || o_orderstatus AS p, split_part(o_orderpriority, '-', 1)::DOUBLE AS f FROM orders WHERE o_orderpriority LIKE '%-%'""",
)
def conversions(spark, d):
    o = t(spark, d, "orders").where(F.col("o_orderpriority").like("%-%"))
    return o.select(
        "o_orderkey", scalar.to_int("o_totalprice").alias("i"), scalar.to_char("o_orderkey").alias("c"), scalar.to_uchar("o_orderkey").alias("u"), scalar.paste("o_orderkey", "o_orderstatus").alias("p"),
        scalar.to_float(F.split_part("o_orderpriority", F.lit("-"), F.lit(1))).alias("f"),
    )


@query(
    "strings_match",
    "SELECT p_partkey, contains(p_name, 'a')::INTEGER AS m, regexp_matches(p_type, '^[A-Z].*[A-Z]$')::INTEGER AS r FROM part",
)
def strings_match(spark, d):
    return t(spark, d, "part").select("p_partkey", scalar.stringmatch("p_name", "a").alias("m"), scalar.regmatch("p_type", "^[A-Z].*[A-Z]$").alias("r"))


@query(
    "file_parts",
    "SELECT page_id, regexp_extract(url, '([^/]*)$', 1) AS tail, regexp_extract(url, '^(.*)/[^/]*$', 1) AS dir FROM pages",
)
def file_parts(spark, d):
    return t(spark, d, "pages").select("page_id", scalar.file_tail("url").alias("tail"), scalar.file_dir("url").alias("dir"))


@query(
    "fit_functions",
    """SELECT p_partkey, round(2 * exp(-pow((p_size - 25) / 10.0, 2)), 4) AS g, round(0.95 - 0.45 * exp(-pow(p_size / 20.0, 2)), 4) AS w,
    round(exp(3 * ln(0.2) + 2 * ln(p_size) - 0.2 * p_size - lgamma(3.0)), 4) AS ga, round(lgamma(p_size + 0.5), 4) AS lg FROM part WHERE p_size > 0""",
)
def fit_functions(spark, d):
    p = t(spark, d, "part").where("p_size > 0")
    return p.select("p_partkey", r4(scalar.gaussian("p_size", 2.0, 25, 10.0), "g"), r4(scalar.weibull("p_size", 0.95, 20.0, 2.0), "w"), r4(scalar.gamma_density("p_size", 0.2, 3.0), "ga"), r4(scalar.lgamma(F.col("p_size") + 0.5), "lg"))


@query("dprime")
def dprime(spark, d):
    e = t(spark, d, "events").groupBy("event_type").agg(F.avg((F.col("value") > 50).cast("double")).alias("h"), F.avg((F.col("value") > 80).cast("double")).alias("f"))
    return e.select("event_type", r4(scalar.dprime("h", "f"), "d"))


# --- selection and search


@query("mask_recycled", "SELECT n_nationkey FROM nation WHERE n_nationkey % 3 = 0")
def mask_recycled(spark, d):
    n = t(spark, d, "nation").withColumn(frame.RID, F.col("n_nationkey").cast("long"))
    return frame.select_recycled(n, [1, 0, 0]).select("n_nationkey")


@query(
    "choose_rows",
    "SELECT i.o::BIGINT AS pos, n_name FROM (VALUES (0, 3), (1, 1), (2, 3), (3, 24)) i(o, k) JOIN nation ON n_nationkey = i.k",
)
def choose_rows(spark, d):
    n = t(spark, d, "nation").withColumn(frame.RID, F.col("n_nationkey").cast("long"))
    idx = frame.from_lists(spark, idx=[3, 1, 3, 24])
    return frame.choose(n, idx).select(F.col(frame.RID).alias("pos"), "n_name")


@query("ordinals", "SELECT c_custkey, row_number() OVER (ORDER BY c_acctbal DESC, c_custkey) - 1 AS pos FROM customer")
def ordinals(spark, d):
    return frame.with_rid(t(spark, d, "customer"), F.col("c_acctbal").desc(), F.col("c_custkey")).select("c_custkey", F.col(frame.RID).alias("pos"))


@query("multisort_topk", "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders ORDER BY o_orderstatus, o_totalprice DESC, o_orderkey LIMIT 25")
def multisort_topk(spark, d):
    return frame.topk(t(spark, d, "orders"), 25, "o_orderstatus", F.col("o_totalprice").desc(), "o_orderkey").select("o_orderkey", "o_orderstatus", "o_totalprice")


@query(
    "find_indices",
    "SELECT o_orderkey, coalesce(p, -1)::BIGINT AS pos FROM orders LEFT JOIN (SELECT c_custkey, max(c_custkey * 2) AS p FROM customer WHERE c_custkey % 3 = 0 GROUP BY 1) ON o_custkey = c_custkey",
)
def find_indices(spark, d):
    c = t(spark, d, "customer").where("c_custkey % 3 = 0").withColumn(frame.RID, F.col("c_custkey") * 2)
    return membership.find_indices(t(spark, d, "orders"), "o_custkey", c, "c_custkey").select("o_orderkey", "pos")


@query(
    "remap",
    "SELECT c_custkey, coalesce(n_name, c_nationkey::VARCHAR) AS nation FROM customer LEFT JOIN (SELECT * FROM nation WHERE n_nationkey < 20) ON c_nationkey = n_nationkey",
)
def remap(spark, d):
    n = t(spark, d, "nation").where("n_nationkey < 20")
    return membership.remap(t(spark, d, "customer"), "c_nationkey", n, "n_nationkey", "n_name", "nation").select("c_custkey", "nation")


@query("membership", "SELECT c_custkey, (c_custkey IN (SELECT o_custkey FROM orders))::INTEGER AS member FROM customer")
def membership_query(spark, d):
    return membership.oneof(t(spark, d, "customer"), "c_custkey", t(spark, d, "orders"), "o_custkey").select("c_custkey", "member")


@query("semi_join", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)")
def semi_join(spark, d):
    return membership.semi(t(spark, d, "customer"), "c_custkey", t(spark, d, "orders"), "o_custkey").select("c_custkey")


@query("anti_join", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 250000)")
def anti_join(spark, d):
    return membership.anti(t(spark, d, "customer"), "c_custkey", t(spark, d, "orders").where("o_totalprice > 250000"), "o_custkey").select("c_custkey")


@query("count_occurrences", "SELECT n_nationkey, count(c_custkey)::BIGINT AS n FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY 1")
def count_occurrences(spark, d):
    return membership.count_occurrences(t(spark, d, "customer").select(F.col("c_nationkey").alias("k")), "k", t(spark, d, "nation"), "n_nationkey").select("n_nationkey", "n")


@query(
    "histogram",
    """SELECT b::INTEGER AS bin, count(p_partkey)::BIGINT AS count FROM range(10) r(b) LEFT JOIN part ON p_retailprice >= 900 AND p_retailprice < 1900 AND floor((p_retailprice - 900) / 100.0) = b GROUP BY 1""",
)
def histogram(spark, d):
    return grouping.histogram(t(spark, d, "part"), "p_retailprice", 900.0, 1900.0, 10)


@query(
    "cut_codes",
    "SELECT p_partkey, CASE WHEN p_size > 0 AND p_size <= 10 THEN 0 WHEN p_size > 10 AND p_size <= 20 THEN 1 WHEN p_size > 20 AND p_size <= 40 THEN 2 ELSE -1 END::INTEGER AS code FROM part",
)
def cut_codes(spark, d):
    return t(spark, d, "part").select("p_partkey", grouping.cut(F.col("p_size"), [0, 10, 20, 40]).alias("code"))


# --- aggregates


@query(
    "moments",
    """SELECT l_returnflag, count(*)::BIGINT AS n, round(sum(l_quantity), 4) AS total, round(avg(l_extendedprice), 4) AS mean, round(var_samp(l_quantity), 4) AS var, round(stddev_samp(l_quantity), 4) AS std,
    round(stddev_samp(l_quantity) / sqrt(count(*)), 4) AS sem, round(1.96 * stddev_samp(l_quantity) / sqrt(count(*)), 4) AS ci, min(l_quantity) AS lo, max(l_quantity) AS hi, round(median(l_extendedprice), 4) AS med FROM lineitem GROUP BY 1""",
)
def moments(spark, d):
    q = "l_quantity"
    return t(spark, d, "lineitem").groupBy("l_returnflag").agg(
        F.count("*").alias("n"), r4(stats.total(q), "total"), r4(stats.mean("l_extendedprice"), "mean"), r4(stats.variance(q), "var"), r4(stats.std(q), "std"), r4(stats.sem(q), "sem"), r4(stats.ci95(q), "ci"),
        F.min(q).alias("lo"), F.max(q).alias("hi"), r4(stats.median("l_extendedprice"), "med"),
    )


@query(
    "percentile_nearest",
    """SELECT l_returnflag, list_sort(list(l_extendedprice))[least(count(*) - 1, floor(count(*) * 0.9 + 0.5))::BIGINT + 1] AS pct FROM lineitem GROUP BY 1""",
)
def percentile_nearest(spark, d):
    return stats.percentile_nearest(t(spark, d, "lineitem"), ["l_returnflag"], "l_extendedprice", 90)


@query(
    "arg_min_max",
    """SELECT o_orderstatus, arg_min(o_orderkey, (o_totalprice, o_orderkey)) AS lo, arg_max(o_orderkey, (o_totalprice, -o_orderkey)) AS hi FROM orders GROUP BY 1""",
)
def arg_min_max(spark, d):
    return t(spark, d, "orders").groupBy("o_orderstatus").agg(stats.arg_min("o_totalprice", "o_orderkey").alias("lo"), stats.arg_max("o_totalprice", "o_orderkey").alias("hi"))


@query("any_all", "SELECT l_returnflag, max((l_discount <> 0)::INTEGER) AS a, min((l_discount <> 0)::INTEGER) AS b FROM lineitem GROUP BY 1")
def any_all(spark, d):
    return t(spark, d, "lineitem").groupBy("l_returnflag").agg(stats.any_true("l_discount").alias("a"), stats.all_true("l_discount").alias("b"))


@query(
    "correlation_fit",
    """SELECT l_returnflag, round(corr(l_quantity, l_extendedprice), 4) AS r, round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 4) AS intercept,
    round(regr_r2(l_extendedprice, l_quantity), 4) AS r2, round(covar_samp(l_quantity, l_extendedprice), 4) AS cov FROM lineitem GROUP BY 1""",
)
def correlation_fit(spark, d):
    slope, intercept, r2 = stats.lsfit("l_quantity", "l_extendedprice")
    g = t(spark, d, "lineitem").groupBy("l_returnflag").agg(stats.pearson("l_quantity", "l_extendedprice").alias("r"), slope, intercept, r2, F.covar_samp("l_quantity", "l_extendedprice").alias("cov"))
    return g.select("l_returnflag", *(r4(F.col(c), c) for c in ("r", "slope", "intercept", "r2", "cov")))


@query(
    "spearman",
    """WITH r AS (SELECT l_returnflag, rank() OVER (PARTITION BY l_returnflag ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_returnflag, l_quantity) - 1) / 2.0 AS a,
    rank() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_returnflag, l_extendedprice) - 1) / 2.0 AS b FROM lineitem)
    SELECT l_returnflag, round(corr(a, b), 4) AS spearman FROM r GROUP BY 1""",
)
def spearman(spark, d):
    return stats.spearman(t(spark, d, "lineitem"), "l_quantity", "l_extendedprice", "l_returnflag").select("l_returnflag", r4(F.col("spearman"), "spearman"))


@query("unique_values", "SELECT DISTINCT c_mktsegment FROM customer")
def unique_values(spark, d):
    return frame.distinct(t(spark, d, "customer"), "c_mktsegment")


@query("unique_cross", "SELECT * FROM (SELECT DISTINCT o_orderstatus FROM orders) CROSS JOIN (SELECT DISTINCT o_orderpriority FROM orders)")
def unique_cross(spark, d):
    return grouping.unique_cross(t(spark, d, "orders"), "o_orderstatus", "o_orderpriority")


_NULLS = "(SELECT c_custkey, nullif(c_mktsegment, 'BUILDING') AS s, CASE WHEN c_nationkey % 4 <> 0 THEN c_nationkey END AS n, c_acctbal FROM customer)"


def _customers(spark, d):
    """Customers with nulls in s and n."""
    n = F.when(F.col("c_nationkey") % 4 != 0, F.col("c_nationkey"))
    return t(spark, d, "customer").select("c_custkey", F.nullif("c_mktsegment", F.lit("BUILDING")).alias("s"), n.alias("n"), "c_acctbal")


@query("recode", f"SELECT c_custkey, CASE WHEN s IS NULL THEN -1 ELSE dense_rank() OVER (ORDER BY s NULLS LAST) - 1 END::INTEGER AS code FROM {_NULLS}")
def recode(spark, d):
    return grouping.recode(_customers(spark, d), "s").select("c_custkey", "code")


@query("midrank", f"SELECT c_custkey, CASE WHEN n IS NOT NULL THEN rank() OVER (ORDER BY n NULLS LAST) - 1 + (count(*) OVER (PARTITION BY n) - 1) / 2.0 ELSE -1 END AS midrank FROM {_NULLS}")
def midrank(spark, d):
    return grouping.midrank(_customers(spark, d), "n").select("c_custkey", F.coalesce("midrank", F.lit(-1.0)).alias("midrank"))


@query("occurrence_index", "SELECT c_custkey, (row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1)::INTEGER AS nth FROM customer")
def occurrence_index(spark, d):
    return grouping.occurrence_index(t(spark, d, "customer"), "c_nationkey", "c_custkey").select("c_custkey", "nth")


@query("box_stats", "SELECT c_mktsegment, min(c_acctbal) AS low, round(quantile_cont(c_acctbal, 0.25), 4) AS q1, round(median(c_acctbal), 4) AS middle, round(quantile_cont(c_acctbal, 0.75), 4) AS q3, max(c_acctbal) AS high FROM customer GROUP BY 1")
def box_stats(spark, d):
    b = t(spark, d, "customer").groupBy("c_mktsegment").agg(*stats.box("c_acctbal"))
    return b.select("c_mktsegment", "low", r4(F.col("q1"), "q1"), r4(F.col("middle"), "middle"), r4(F.col("q3"), "q3"), "high")


@query("cumulative_share", "SELECT DISTINCT p_size, round(cume_dist() OVER (ORDER BY p_size), 4) AS share FROM part")
def cumulative_share(spark, d):
    return stats.cumulative(t(spark, d, "part"), "p_size").select("p_size", r4(F.col("share"), "share"))


# --- set operations


@query("append_rows", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT o_orderkey, 0.0 FROM orders WHERE o_orderstatus = 'O'")
def append_rows(spark, d):
    o = t(spark, d, "orders")
    return frame.append(o.where("o_orderstatus = 'F'").select("o_orderkey", "o_totalprice"), o.where("o_orderstatus = 'O'").select("o_orderkey"))


@query("concat_distinct", "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
def concat_distinct(spark, d):
    return frame.concat(t(spark, d, "customer").select(F.col("c_nationkey").alias("k")), t(spark, d, "supplier").select(F.col("s_nationkey").alias("k"))).distinct()


@query("intersect_rows", "SELECT c_nationkey AS k FROM customer WHERE c_acctbal > 5000 INTERSECT SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000")
def intersect_rows(spark, d):
    return t(spark, d, "customer").where("c_acctbal > 5000").select(F.col("c_nationkey").alias("k")).intersect(t(spark, d, "supplier").where("s_acctbal > 5000").select("s_nationkey"))


@query("except_rows", "SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_totalprice > 250000")
def except_rows(spark, d):
    return t(spark, d, "customer").select(F.col("c_custkey").alias("k")).subtract(t(spark, d, "orders").where("o_totalprice > 250000").select("o_custkey"))


# --- ordered rows


def _events(spark, d):
    return t(spark, d, "events").select("event_id", "ts", "user_id", "event_type", "value")


_W = "(PARTITION BY user_id ORDER BY ts, event_id)"


def _series():
    return ordered.series(["user_id"], ["ts", "event_id"])


@query(
    "ordered_ops",
    f"""SELECT event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 3) AS c, round(value - lag(value) OVER {_W}, 4) AS d, coalesce(lag(value, 2) OVER {_W}, 0) AS s,
    round(CASE WHEN lag(value) OVER {_W} IS NULL AND lead(value) OVER {_W} IS NULL THEN 0 WHEN lag(value) OVER {_W} IS NULL THEN lead(value) OVER {_W} - value
    WHEN lead(value) OVER {_W} IS NULL THEN value - lag(value) OVER {_W} ELSE (lead(value) OVER {_W} - lag(value) OVER {_W}) / 2 END, 4) AS g FROM events""",
)
def ordered_ops(spark, d):
    v = "value"
    return _events(spark, d).select("event_id", F.round(ordered.cumsum(v, _series()), 3).alias("c"), r4(ordered.diff(v, _series()), "d"), ordered.shift(v, _series(), 2, 0.0).alias("s"), r4(ordered.gradient(v, _series()), "g"))


@query(
    "zero_crossings",
    f"""WITH e AS (SELECT event_id, user_id, ts, value - 50 AS x FROM events), w AS (SELECT event_id, x, lag(x) OVER {_W} AS b, lag(x, 2) OVER {_W} AS a FROM e)
    SELECT event_id, CASE WHEN CASE WHEN b = 0 THEN a ELSE b END < 0 AND x > 0 THEN 1 WHEN CASE WHEN b = 0 THEN a ELSE b END > 0 AND x < 0 THEN -1 ELSE 0 END::INTEGER AS z FROM w""",
)
def zero_crossings(spark, d):
    return _events(spark, d).select("event_id", ordered.zero_crossings(F.col("value") - 50, _series()).alias("z"))


@query("unique_adjacent", f"SELECT event_id FROM (SELECT event_id, event_type IS DISTINCT FROM lag(event_type) OVER {_W} AS k FROM events) WHERE k")
def unique_adjacent(spark, d):
    return ordered.unique_adjacent(_events(spark, d), "event_type", _series()).select("event_id")


@query(
    "conv_rows",
    f"SELECT event_id, round(0.25 * coalesce(lag(value) OVER {_W}, 0) + 0.5 * value + 0.25 * coalesce(lead(value) OVER {_W}, 0), 4) AS y FROM events",
)
def conv_rows(spark, d):
    return _events(spark, d).select("event_id", r4(ordered.conv("value", [0.25, 0.5, 0.25], _series()), "y"))


@query(
    "fill_grid",
    """WITH s AS (SELECT user_id, epoch(ts) - epoch(TIMESTAMP '2024-01-01') AS x, value, event_id FROM events), u AS (SELECT user_id, x, arg_max(value, event_id) AS value FROM s GROUP BY ALL),
    g AS (SELECT user_id, i * 86400.0 AS x FROM (SELECT DISTINCT user_id FROM s), range(31) r(i)), lo AS (SELECT user_id, arg_min(value, x) AS first_value FROM u GROUP BY 1)
    SELECT g.user_id, g.x::BIGINT AS at, coalesce(b.value, first_value) AS value FROM g ASOF LEFT JOIN u b ON g.user_id = b.user_id AND g.x >= b.x JOIN lo ON lo.user_id = g.user_id""",
)
def fill_grid(spark, d):
    e = _events(spark, d).withColumn("x", F.unix_micros(F.col("ts").cast("timestamp")) / 1e6 - F.unix_micros(F.lit("2024-01-01").cast("timestamp")) / 1e6)
    last = e.groupBy("user_id", "x").agg(F.max_by("value", "event_id").alias("value"))
    return ordered.fill_grid(last, ["user_id"], "x", "value", 0.0, 30 * 86400.0, 86400.0).select("user_id", F.col("x").cast("long").alias("at"), "value")


# --- as-of lookups


def _asof_sql(op: str, order: str, having: str = "TRUE") -> str:
    end = "" if order else " DESC"
    return f"""SELECT c.event_id, coalesce((SELECT e.event_id FROM events e WHERE e.user_id = c.user_id AND e.event_type = 'purchase' AND {having} AND e.ts {op} c.ts ORDER BY e.ts{end}, e.event_id{end} LIMIT 1), -1) AS e_event_id
    FROM events c WHERE c.event_type = 'click'"""


def _asof(spark, d, direction, having=None):
    e = _events(spark, d)
    clicks = e.where("event_type = 'click'").select("event_id", "user_id", "ts")
    found = asof.asof(clicks, e.where("event_type = 'purchase'"), ["user_id"], "ts", "event_id", direction, ["event_id"], having)
    return found.select("event_id", F.coalesce("e_event_id", F.lit(-1)).alias("e_event_id"))


for _name, _op, _up in (("before", "<", ""), ("at_or_before", "<=", ""), ("at", "=", "x"), ("at_or_after", ">=", "x"), ("after", ">", "x")):
    query(f"asof_{_name}", _asof_sql(_op, _up))(lambda spark, d, k=_name: _asof(spark, d, k))
    query(f"asof_{_name}_with", _asof_sql(_op, _up, "e.value > 50"))(lambda spark, d, k=_name: _asof(spark, d, k, F.col("value") > 50))
    query(f"asof_{_name}_with_not", _asof_sql(_op, _up, "NOT e.value > 50"))(lambda spark, d, k=_name: _asof(spark, d, k, ~(F.col("value") > 50)))


@query("first_with_data", "SELECT user_id, min(ts) AS ts FROM events WHERE value > 90 GROUP BY 1")
def first_with_data(spark, d):
    return asof.first_with_data(_events(spark, d), ["user_id"], "ts", "event_id", F.col("value") > 90)


# --- sessions


@query(
    "sessionise_obs",
    f"""WITH e AS (SELECT *, sum((event_type = 'signup')::INTEGER) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS n FROM events),
    f AS (SELECT *, coalesce(sum((event_type IN ('purchase', 'error', 'view'))::INTEGER) OVER (PARTITION BY user_id, n ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ended,
      max((event_type IN ('purchase', 'error', 'view'))::INTEGER) OVER (PARTITION BY user_id, n) AS whole FROM e),
    g AS (SELECT *, max(CASE WHEN n > 0 AND whole = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS broken FROM f)
    SELECT event_id, (n - 1)::BIGINT AS obs FROM g WHERE n > 0 AND ended = 0 AND whole = 1 AND broken = 0""",
)
def sessionise_obs(spark, d):
    e = _events(spark, d).withColumn("micros", F.unix_micros(F.col("ts").cast("timestamp")))
    s = sessions.sessionise(e, ["user_id"], ["ts", "event_id"], F.col("event_type") == "signup", F.col("event_type").isin("purchase", "error", "view"), "micros")
    return s.select("event_id", "obs")


@query(
    "gap_sessions",
    f"""WITH e AS (SELECT user_id, event_id, ts, CASE WHEN epoch(ts) - epoch(lag(ts) OVER {_W}) <= 86400 THEN 0 ELSE 1 END AS n FROM events)
    SELECT event_id, (sum(n) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) - 1)::BIGINT AS session FROM e""",
)
def gap_sessions(spark, d):
    return sessions.gap_sessions(_events(spark, d), ["user_id"], "ts", "event_id", 86400).select("event_id", "session")


@query("feed_decimated", f"SELECT event_id FROM (SELECT event_id, event_type, row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1 AS n FROM events WHERE event_type LIKE 'c%') WHERE n % 3 = 0")
def feed_decimated(spark, d):
    m = feeds.Matches()
    m.add("c*", 3)
    return feeds.decimate_batch(m.apply(_events(spark, d), "event_type"), "event_type", "event_id").select("event_id")


# --- lists


def _orders_lists(spark, d):
    """Orders with their lines' prices and quantities as lists in line order."""
    li = t(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_extendedprice", "l_quantity"))).alias("l"))
    return li.select(F.col("l_orderkey").alias("k"), F.transform("l", lambda x: x["l_extendedprice"]).alias("p"), F.transform("l", lambda x: x["l_quantity"]).alias("q"), F.size("l").alias("n"))


_L = "WITH o AS (SELECT l_orderkey AS k, list(l_extendedprice ORDER BY l_linenumber, l_partkey, l_extendedprice, l_quantity) AS p, list(l_quantity ORDER BY l_linenumber, l_partkey, l_extendedprice, l_quantity) AS q FROM lineitem GROUP BY 1) "


@query(
    "list_reductions",
    _L + """SELECT k, len(p)::INTEGER AS n, round(list_sum(p), 4) AS s, round(list_avg(p), 6) AS m, list_min(p) AS lo, list_max(p) AS hi, round(list_product(q), 2) AS pr,
    round(coalesce(list_var_samp(q), 0), 4) AS v, round(coalesce(list_stddev_samp(q), 0), 4) AS sd, round(list_median(p), 4) AS md, (list_position(p, list_min(p)) - 1)::INTEGER AS mi, (list_position(p, list_max(p)) - 1)::INTEGER AS ma FROM o""",
)
def list_reductions(spark, d):
    return _orders_lists(spark, d).select(
        "k", lists.length("p").alias("n"), r4(lists.total("p"), "s"), F.round(lists.mean("p"), 6).alias("m"), lists.minimum("p").alias("lo"), lists.maximum("p").alias("hi"), F.round(lists.prod("q"), 2).alias("pr"),
        r4(lists.variance("q"), "v"), r4(lists.std("q"), "sd"), r4(lists.median("p"), "md"), lists.min_index("p").alias("mi"), lists.max_index("p").alias("ma"),
    )


_UN = "SELECT k, unnest({0}) AS x, unnest(range(len({0})))::INTEGER AS i FROM o"


def _rows(df, c):
    return df.select("k", F.posexplode(c).alias("i", "x")).select("k", "x", "i")


@query("list_reverse", _L + _UN.format("list_reverse(q)"))
def list_reverse(spark, d):
    return _rows(_orders_lists(spark, d), lists.reverse("q"))


@query("list_cycle", _L + _UN.format("list_transform(range(len(q)), lambda i: q[((i - 1 + len(q)) % len(q)) + 1])"))
def list_cycle(spark, d):
    return _rows(_orders_lists(spark, d), lists.cycle("q", 1))


@query("list_shift", _L + _UN.format("list_transform(range(len(q)), lambda i: coalesce(CASE WHEN i >= 1 THEN q[i] END, 0))"))
def list_shift(spark, d):
    return _rows(_orders_lists(spark, d), lists.shift("q", 1, F.lit(0.0)))


@query("list_sort", _L + _UN.format("list_sort(p)"))
def list_sort(spark, d):
    return _rows(_orders_lists(spark, d), lists.sort("p"))


@query("list_unique", _L + _UN.format("list_sort(list_distinct(q))"))
def list_unique(spark, d):
    return _rows(_orders_lists(spark, d), lists.unique("q"))


@query("list_cumsum", _L + "SELECT k, round(x, 4) AS x, i FROM (" + _UN.format("list_transform(range(1, len(q) + 1), lambda i: list_sum(q[1:i]))") + ")")
def list_cumsum(spark, d):
    return _rows(_orders_lists(spark, d), lists.cumsum("q")).withColumn("x", F.round("x", 4))


@query("list_diff", _L + "SELECT k, round(x, 4) AS x, i FROM (" + _UN.format("list_transform(range(1, len(p)), lambda i: p[i + 1] - p[i])") + ")")
def list_diff(spark, d):
    return _rows(_orders_lists(spark, d), lists.diff("p")).withColumn("x", F.round("x", 4))


@query("list_select", _L + _UN.format("list_filter(p, lambda x: x > 20000)"))
def list_select(spark, d):
    o = _orders_lists(spark, d).withColumn("m", lists.each(lambda x: scalar.gt(x, 20000), "p"))
    return _rows(o, lists.select_mask("p", "m"))


@query("list_interleave", _L + _UN.format("flatten(list_transform(range(1, len(p) + 1), lambda i: [p[i], q[i]]))"))
def list_interleave(spark, d):
    return _rows(_orders_lists(spark, d), lists.interleave("p", "q"))


@query("list_repeat", _L + _UN.format("flatten(list_transform(q, lambda x: [x, x, x]))"))
def list_repeat(spark, d):
    return _rows(_orders_lists(spark, d), lists.repeat("q", F.lit(3)))


@query("list_combine", _L + _UN.format("list_concat(p, q)"))
def list_combine(spark, d):
    return _rows(_orders_lists(spark, d), lists.combine("p", "q"))


@query("list_indices", _L + _UN.format("list_transform(list_filter(range(1, len(q) + 1), lambda i: q[i] > 25), lambda i: (i - 1)::INTEGER)"))
def list_indices(spark, d):
    o = _orders_lists(spark, d)
    return _rows(o, lists.indices(lists.each(lambda x: scalar.gt(x, 25), "q")))


@query("list_pairwise", _L + "SELECT k, round(x, 4) AS x, i FROM (" + _UN.format("list_transform(range(1, len(p) + 1), lambda i: p[i] * q[i])") + ")")
def list_pairwise(spark, d):
    return _rows(_orders_lists(spark, d), lists.pairwise(lambda a, b: a * b, "p", "q")).withColumn("x", F.round("x", 4))


@query("list_comprehension", _L + "SELECT k, round(x, 4) AS x, i FROM (" + _UN.format("list_transform(list_filter(q, lambda x: x > 10), lambda x: x * x + 1)") + ")")
def list_comprehension(spark, d):
    return _rows(_orders_lists(spark, d), lists.comprehension("q", lambda x: x > 10, lambda x: x * x + 1)).withColumn("x", F.round("x", 4))


@query("list_hist", _L + _UN.format("list_transform(range(5), lambda b: len(list_filter(q, lambda x: x >= b * 10 AND x < b * 10 + 10))::INTEGER)"))
def list_hist(spark, d):
    return _rows(_orders_lists(spark, d), lists.hist("q", 0, 50, 5))


@query("list_pack_collapse", _L + "SELECT k, len(q)::INTEGER AS n, round(list_sum(q), 4) AS s FROM o")
def list_pack_collapse(spark, d):
    o = _orders_lists(spark, d).withColumn("c", lists.collapse(lists.pack("q")))
    return o.select("k", lists.length("c").alias("n"), r4(lists.total("c"), "s"))


@query("list_transpose", _L + "SELECT k, len(p)::INTEGER AS n, round(p[1] + q[1], 4) AS first FROM o")
def list_transpose(spark, d):
    o = _orders_lists(spark, d).withColumn("x", lists.transpose(F.array("p", "q"), F.lit(0.0)))
    return o.select("k", F.size("x").alias("n"), r4(lists.total(F.get("x", F.lit(0))), "first"))


@query("column_means", "SELECT i::INTEGER AS pos, round(avg(v), 4) AS mean, round(stddev_samp(v), 4) AS std FROM (SELECT unnest(embedding)::DOUBLE AS v, unnest(range(64)) AS i FROM embeddings) GROUP BY 1")
def column_means(spark, d):
    e = t(spark, d, "embeddings").select(F.transform("embedding", lambda x: x.cast("double")).alias("e"))
    return stats.column_stats(e, "e", {"mean": F.round(F.avg("v"), 4), "std": F.round(F.stddev_samp("v"), 4)})


# --- cross products


@query("cross", "SELECT r_name, n_name FROM region CROSS JOIN nation")
def cross(spark, d):
    return grouping.cross(t(spark, d, "region").select("r_name"), t(spark, d, "nation").select("n_name"))


@query("all_differences", "SELECT a.s_nationkey, round(a.s_acctbal - b.s_acctbal, 4) AS d FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey <> b.s_suppkey")
def all_differences(spark, d):
    by_nation = grouping.split(t(spark, d, "supplier"), "s_nationkey", "s_acctbal", "s_suppkey")
    return by_nation.select("s_nationkey", F.explode(lists.idiff_self("s_acctbal")).alias("d")).select("s_nationkey", r4(F.col("d"), "d"))


# --- matrices


def _cells(spark, d):
    e = t(spark, d, "embeddings").select(F.col("vec_id").alias("i"), F.transform("embedding", lambda x: x.cast("double")).alias("row"))
    return e.select("i", F.posexplode("row").alias("j", "v"))


_M = "WITH m AS (SELECT vec_id AS i, unnest(range(len(embedding))) AS j, unnest(embedding)::DOUBLE AS v FROM embeddings) "


@query("matmul", _M + "SELECT a.j::INTEGER AS i, b.j::INTEGER AS j, round(sum(a.v * b.v), 4) AS v FROM m a JOIN m b ON a.i = b.i GROUP BY ALL")
def matmul(spark, d):
    m = _cells(spark, d)
    left = m.select(F.col("j").alias("i"), F.col("i").alias("j"), "v")
    return matrix.cells_matmul(left, m).select("i", "j", r4(F.col("v"), "v"))


@query("matrix_margins", _M + "SELECT i, round(sum(v), 4) AS s, round(avg(v), 4) AS m FROM m GROUP BY 1")
def matrix_margins(spark, d):
    m = _cells(spark, d)
    return matrix.cells_sums(m, "i").join(matrix.cells_means(m, "i").withColumnRenamed("v", "m"), "i").select("i", r4(F.col("v"), "s"), r4(F.col("m"), "m"))


@query("matrix_centered", _M + "SELECT i, j::INTEGER AS j, round(v - avg(v) OVER (PARTITION BY j), 4) AS v FROM m")
def matrix_centered(spark, d):
    return matrix.cells_center(_cells(spark, d), "j").select("i", "j", r4(F.col("v"), "v"))


@query(
    "covariance",
    """SELECT a.n AS i, b.n AS j, round(CASE WHEN a.n = 'l_quantity' AND b.n = 'l_quantity' THEN (SELECT var_samp(l_quantity) FROM lineitem) WHEN a.n = 'l_discount' AND b.n = 'l_discount' THEN (SELECT var_samp(l_discount) FROM lineitem)
    ELSE (SELECT covar_samp(l_quantity, l_discount) FROM lineitem) END, 4) AS v FROM (VALUES ('l_quantity'), ('l_discount')) a(n) CROSS JOIN (VALUES ('l_quantity'), ('l_discount')) b(n)""",
)
def covariance(spark, d):
    return matrix.covariance(t(spark, d, "lineitem"), ["l_quantity", "l_discount"]).select("i", "j", r4(F.col("v"), "v"))


@query("matrix_inverse")
def matrix_inverse(spark, d):
    e = t(spark, d, "embeddings").select("vec_id", lists.reshape(F.transform("embedding", lambda x: x.cast("double")), F.lit(8), F.lit(8)).alias("m"))
    e = e.select("vec_id", "m", matrix.inverse("m").alias("inv"), matrix.det("m").alias("det"))
    return e.select("vec_id", r4(lists.total(matrix.diag(matrix.matmul("m", "inv"))), "trace"), F.round("det", 8).alias("det"))


# --- JSON


@query("json_get", "SELECT event_id, coalesce(json_extract_string(props, '$.k'), '') AS k, (json_valid(props))::BOOLEAN AS ok FROM events")
def json_get(spark, d):
    e = t(spark, d, "events")
    return e.select("event_id", jsonfns.get("props", "k").alias("k"), jsonfns.valid("props").alias("ok"))


@query("json_rows", "SELECT '{\"n_nationkey\":' || n_nationkey || ',\"n_name\":\"' || n_name || '\"}' AS json FROM nation")
def json_rows(spark, d):
    return jsonfns.rows_json(t(spark, d, "nation").select("n_nationkey", "n_name"))


@query("json_columns", """SELECT '{"r_name":[' || string_agg('"' || r_name || '"', ',' ORDER BY r_regionkey) || '],"r_regionkey":[' || string_agg(r_regionkey::VARCHAR, ',' ORDER BY r_regionkey) || ']}' AS json FROM region""")
def json_columns(spark, d):
    return jsonfns.columns_json(t(spark, d, "region").select(F.col("r_regionkey").alias("o"), "r_name", "r_regionkey"), "o")


# --- discrimination and tuning


@query(
    "roc_area",
    """WITH r AS (SELECT event_type = 'purchase' AS pos, rank() OVER (ORDER BY value) + (count(*) OVER (PARTITION BY value) - 1) / 2.0 AS rank FROM events),
    n AS (SELECT count(*) FILTER (pos) AS a, count(*) FILTER (NOT pos) AS b, sum(rank) FILTER (pos) AS s FROM r)
    SELECT 1 AS k, round((s - a * (a + 1) / 2.0) / (a::DOUBLE * b), 4) AS area FROM n""",
)
def roc_area(spark, d):
    e = _events(spark, d).withColumn("k", F.lit(1)).withColumn("pos", (F.col("event_type") == "purchase").cast("int"))
    return tuning.roc_area(e, ["k"], "value", "pos").select("k", r4(F.col("area"), "area"))


@query(
    "selectivity",
    """WITH r AS (SELECT user_id % 5 AS k, event_type, avg(value) AS r FROM events GROUP BY ALL)
    SELECT k, round((max(r) - min(r)) / (max(r) + min(r)), 4) AS best_worst, round((count(*) - sum(r) / max(r)) / (count(*) - 1), 4) AS depth, round(pow(avg(r), 2) / avg(r * r), 4) AS sparseness FROM r GROUP BY 1""",
)
def selectivity(spark, d):
    r = _events(spark, d).groupBy((F.col("user_id") % 5).alias("k"), "event_type").agg(F.avg("value").alias("r"))
    return tuning.selectivity(r, ["k"]).select("k", *(r4(F.col(c), c) for c in ("best_worst", "depth", "sparseness")))


@query("broadness")
def broadness(spark, d):
    e = _events(spark, d).select((F.col("user_id") % 5).alias("k"), "event_type", F.col("value").alias("rate"), (F.col("value") * 0.9).alias("base"))
    return tuning.broadness(e, ["k"], "event_type", "base").select("k", r4(F.col("broadness"), "broadness"))


# --- signals, clusters, eyes, trajectories (numpy within Arrow batches)


def _trains(spark, d):
    e = _events(spark, d).withColumn("t", F.pmod(F.unix_micros(F.col("ts").cast("timestamp")) / 1000, F.lit(1000)).cast("double"))
    return e.groupBy((F.col("user_id") % 50).alias("k")).agg(F.array_sort(F.collect_list("t")).alias("times"))


@query(
    "spike_density",
    """WITH t AS (SELECT user_id % 50 AS k, trunc((epoch_us(ts) / 1000.0) % 1000)::BIGINT AS t0, count(*) AS c FROM events GROUP BY ALL),
    kern AS (SELECT j, exp(-j * j / 100.0) / (2 * (SELECT sum(exp(-x * x / 100.0)) FROM range(31) r(x))) AS w FROM range(-30, 31) r(j)),
    v AS (SELECT k, t0 + j AS i, sum(c * w) AS v FROM t, kern GROUP BY ALL)
    SELECT g.k, g.i::INTEGER AS i, round(coalesce(v, 0), 4) AS v FROM (SELECT DISTINCT k, i FROM t, range(1000) r(i)) g LEFT JOIN v ON v.k = g.k AND v.i = g.i""",
)
def spike_density(spark, d):
    x = _trains(spark, d).select("k", F.posexplode(signal.sdf(F.col("times"), 0, 999, 10.0)).alias("i", "v"))
    return x.select("k", "i", r4(F.col("v"), "v"))


@query("adaptive_density")
def adaptive_density(spark, d):
    x = _trains(spark, d).withColumn("s", signal.parzen(F.col("times"), 0, 999, 20.0))
    return x.select("k", F.size("s").alias("n"), r4(lists.total("s"), "total"))


@query(
    "power_spectrum",
    """WITH e AS (SELECT vec_id, unnest(range(64)) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings),
    f AS (SELECT vec_id, fr, j, sum(x * sqrt(2 / 65.0) * sin(pi() * (j + 1) * (i + 1) / 65) * cos(2 * pi() * fr * i / 64)) AS re,
    sum(x * sqrt(2 / 65.0) * sin(pi() * (j + 1) * (i + 1) / 65) * sin(2 * pi() * fr * i / 64)) AS im FROM e, range(33) a(fr), range(3) b(j) GROUP BY ALL)
    SELECT vec_id, round(fr::DOUBLE, 4) AS freq, round(sum(re * re + im * im) / 3, 4) AS power FROM f GROUP BY vec_id, fr""",
)
def power_spectrum(spark, d):
    e = t(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("x"))
    return signal.spectra(e, "vec_id", "x", 64.0).select("vec_id", r4(F.col("freq"), "freq"), r4(F.col("power"), "power"))


@query("cross_correlogram")
def cross_correlogram(spark, d):
    x = _trains(spark, d).select((F.col("k") % 5).alias("g"), "k", "times")
    x = x.withColumn("b", F.transform("times", lambda v: v + 2))
    return spikes.cross_correlogram(x, ["g"], "k", "times", "b", 1000, 5).select("g", "lag", *(r4(F.col(c), c) for c in ("raw", "shuffled", "corrected")))


@query(
    "dbscan_grid",
    """WITH RECURSIVE p AS (SELECT vec_id AS k, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y FROM embeddings),
    near AS (SELECT a.k AS a, b.k AS b FROM p a JOIN p b ON pow(a.x - b.x, 2) + pow(a.y - b.y, 2) <= 0.02::DOUBLE * 0.02::DOUBLE),
    core AS (SELECT a FROM near GROUP BY a HAVING count(*) >= 3), links AS (SELECT a, b FROM near WHERE a IN (FROM core) AND b IN (FROM core)),
    reach(a, b) AS (SELECT a, a FROM core UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a), roots AS (SELECT a, min(b) AS root FROM reach GROUP BY a),
    ids AS (SELECT root, row_number() OVER (ORDER BY root) AS c FROM (SELECT DISTINCT root FROM roots)), border AS (SELECT near.a, min(root) AS root FROM near JOIN roots ON near.b = roots.a GROUP BY near.a)
    SELECT k AS vec_id, coalesce(c, 0)::INTEGER AS cluster FROM p LEFT JOIN roots ON roots.a = k LEFT JOIN border ON border.a = k LEFT JOIN ids ON ids.root = coalesce(roots.root, border.root)""",
)
def dbscan_grid(spark, d):
    p = t(spark, d, "embeddings").select("vec_id", F.get("embedding", F.lit(0)).alias("x"), F.get("embedding", F.lit(1)).alias("y"))
    return cluster.dbscan(p, "vec_id", "x", "y", 0.02, 3)


@query("dtw_matrix")
def dtw_matrix(spark, d):
    p = t(spark, d, "embeddings").select("vec_id", lists.reshape(F.transform("embedding", lambda x: x.cast("double")), F.lit(32), F.lit(2)).alias("path"))
    # Blocks of 250 to 4,000 rows: a task holds the rows of two, and every row is sent once a block.
    n = p.count()
    return cluster.dtw_matrix(p, "vec_id", "path", blocks=max(1, min(16, -(-n // 250)), -(-n // 4000))).select("a", "b", r4(F.col("distance"), "distance"))


@query(
    "eye_events",
    """WITH steps AS (SELECT vec_id, list_transform(range(1, len(embedding)), lambda i: abs(embedding[i + 1]::DOUBLE - embedding[i]::DOUBLE) * 40) AS step FROM embeddings),
    big AS (SELECT vec_id, list_filter(step, lambda x: x >= 0.24) AS s FROM steps)
    SELECT vec_id, len(s)::INTEGER AS n, round(list_sum(s), 4) AS travelled, len(s)::INTEGER + 1 AS n_fix FROM big""",
)
def eye_events(spark, d):
    # Each component is a place (degrees) that the gaze holds for 0.1 s: every step of 0.24 degrees or more is a saccade.
    held = F.flatten(F.transform("embedding", lambda x: F.array_repeat(x.cast("double") * 40, 25)))
    x = t(spark, d, "embeddings").select("vec_id", held.alias("h"))
    x = x.select("vec_id", "h", F.transform("h", lambda y: F.lit(0.0)).alias("v"), F.transform("h", lambda y, i: i * 0.004).alias("s"), F.transform("h", lambda y: F.lit(0)).alias("blink"))
    e = eye.extract_events(x, "h", "v", "s", "blink")
    travelled = F.aggregate(F.transform("saccades", lambda y: y["amp"]), F.lit(0.0), lambda acc, y: acc + y)
    return e.select("vec_id", F.size("saccades").alias("n"), r4(travelled, "travelled"), F.size("fixations").alias("n_fix"))


_GRID = (0.0, 100.0, 0.0, 100.0)


def _points(spark, d):
    return _events(spark, d).select(F.col("value").alias("x"), F.col("user_id").cast("double").alias("y"))


@query(
    "kde_grid",
    f"""WITH p AS (SELECT value AS x, user_id::DOUBLE AS y FROM events)
    SELECT gx::INTEGER AS gx, gy::INTEGER AS gy, round(avg(exp(-(pow(gx * 10 + 5 - x, 2) + pow(gy * 10 + 5 - y, 2)) / 50.0)) / (2 * pi() * 25), 8) AS density FROM range(10) a(gx), range(10) b(gy), p GROUP BY ALL""",
)
def kde_grid(spark, d):
    return trajectory.kde(_points(spark, d), _GRID, 10, 10, 5.0).select("gx", "gy", F.round("density", 8).alias("density"))


@query(
    "kde_peaks",
    """WITH p AS (SELECT value AS x, user_id::DOUBLE AS y FROM events), g AS (SELECT gx, gy, avg(exp(-(pow(gx * 4 + 2 - x, 2) + pow(gy * 4 + 2 - y, 2)) / 32.0)) / (2 * pi() * 16) AS v FROM range(25) a(gx), range(25) b(gy), p GROUP BY ALL)
    SELECT c.gx::INTEGER AS gx, c.gy::INTEGER AS gy, round(any_value(c.v), 8) AS density FROM g c JOIN g o ON abs(c.gx - o.gx) <= 1 AND abs(c.gy - o.gy) <= 1 AND (c.gx <> o.gx OR c.gy <> o.gy)
    WHERE c.gx BETWEEN 1 AND 23 AND c.gy BETWEEN 1 AND 23 GROUP BY ALL HAVING max(o.v) <= any_value(c.v)""",
)
def kde_peaks(spark, d):
    return trajectory.peaks(trajectory.kde(_points(spark, d), _GRID, 25, 25, 4.0), 25, 25, 0.0).select("gx", "gy", F.round("density", 8).alias("density"))


@query(
    "trajectory_turns",
    f"""WITH e AS (SELECT user_id, value - lag(value) OVER {_W} AS u, lead(value) OVER {_W} - value AS w FROM events)
    SELECT user_id, count(*) FILTER (acos(greatest(-1, least(1, (100 + u * w) / (sqrt(100 + u * u) * sqrt(100 + w * w))))) > 0.5)::INTEGER AS n FROM e GROUP BY 1""",
)
def trajectory_turns(spark, d):
    e = _events(spark, d).groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("ts", "event_id", "value"))).alias("l"))
    p = e.select("user_id", F.transform("l", lambda x, i: F.struct((i * 10.0).alias("x"), x["value"].alias("y"))).alias("p"))
    return p.select("user_id", F.size(trajectory.turns("p")).alias("n"))


@query("motion_sample", f"SELECT s_suppkey, round(least(i * 0.25, 2.0), 4) AS t, round(s_acctbal / 1000 * least(i * 0.25, 2.0), 8) AS x, round(10 + 3 * least(i * 0.25, 2.0) - 0.5 * 9.8 * pow(least(i * 0.25, 2.0), 2), 8) AS y FROM supplier, range(9) r(i)")
def motion_sample(spark, d):
    s = t(spark, d, "supplier")
    rows = trajectory.sample(s.select("s_suppkey", "s_acctbal"), "s_suppkey", lambda x: trajectory.ballistic(x, 0.0, 10.0, 0.0, 3.0, 9.8), F.lit(2.0), 0.25)
    speed = s.select("s_suppkey", (F.col("s_acctbal") / 1000).alias("vx"))
    return rows.join(speed, "s_suppkey").select("s_suppkey", r4(F.col("t"), "t"), F.round(F.col("vx") * F.col("t"), 8).alias("x"), F.round("y", 8).alias("y"))


@query("hex_distance", "SELECT a.n_nationkey AS a, b.n_nationkey AS b, ((abs(a.n_nationkey - b.n_nationkey) + abs(a.n_nationkey + a.n_regionkey - b.n_nationkey - b.n_regionkey) + abs(a.n_regionkey - b.n_regionkey)) / 2)::INTEGER AS steps FROM nation a CROSS JOIN nation b")
def hex_distance(spark, d):
    n = t(spark, d, "nation").select(F.col("n_nationkey").alias("k"), scalar.cube_of_hex("n_nationkey", "n_regionkey").alias("c"))
    return n.toDF("a", "x").crossJoin(n.toDF("b", "y")).select("a", "b", scalar.cube_distance(F.col("x"), F.col("y")).alias("steps"))


@query("polygon_measures", "SELECT s_suppkey, round((s_nationkey + 1) * 2.0, 4) AS area, round((s_nationkey + 1) / 2.0, 4) AS cx, 1.0 AS cy FROM supplier")
def polygon_measures(spark, d):
    w = (F.col("s_nationkey") + 1).cast("double")
    corner = lambda x, y: F.struct(x.alias("x"), F.lit(y).alias("y"))
    p = F.array(corner(F.lit(0.0), 0.0), corner(w, 0.0), corner(w, 2.0), corner(F.lit(0.0), 2.0))
    s = t(spark, d, "supplier").select("s_suppkey", p.alias("p"))
    return s.select("s_suppkey", r4(lists.shoelace("p"), "area"), r4(lists.centroid("p")["x"], "cx"), r4(lists.centroid("p")["y"], "cy"))


@query(
    "polygon_intersection",
    "SELECT s_suppkey, 1 AS rings, round((4 - (s_nationkey % 3 + 1)) * 3.0, 4) AS area FROM supplier",
)
def polygon_intersection(spark, d):
    def square(x, y):
        return F.array(*(F.struct((x + a).cast("double").alias("x"), (y + b).cast("double").alias("y")) for a, b in ((0, 0), (4, 0), (4, 4), (0, 4))))

    s = t(spark, d, "supplier").select("s_suppkey", square(F.lit(0), F.lit(0)).alias("a"), square(F.col("s_nationkey") % 3 + 1, F.lit(1)).alias("b"))
    out = s.select("s_suppkey", curves.polygons(F.col("a"), F.col("b"), "intersection").alias("r"))
    return out.select("s_suppkey", F.size("r").alias("rings"), r4(F.abs(lists.shoelace(F.get("r", F.lit(0)))), "area"))


@query("coherent_noise")
def coherent_noise(spark, d):
    return t(spark, d, "supplier").select("s_suppkey", r4(noise.noise(F.col("s_acctbal") / 1000, F.col("s_nationkey") / 3.7, seed=3), "v"))


@query("map_units", "SELECT i AS unit, (i * i)::VARCHAR AS result FROM range(20) r(i)")
def map_units(spark, d):
    return parallel.map_units(spark, 20, lambda i, state, seed: i * i).select("unit", "result")


@query(
    "speed_rows",
    f"""WITH e AS (SELECT event_id, user_id, ts, value, epoch_us(ts) / 1e6 AS s FROM events),
    w AS (SELECT event_id, coalesce(lead(value) OVER {_W}, value) - coalesce(lag(value) OVER {_W}, value) AS dv, coalesce(lead(s) OVER {_W}, s) - coalesce(lag(s) OVER {_W}, s) AS dt FROM e)
    SELECT event_id, CASE WHEN dt > 0 THEN round(sqrt(dv * dv + pow(dv * 0.5, 2)) / dt, 6) ELSE 0 END AS speed FROM w""",
)
def speed_rows(spark, d):
    e = _events(spark, d).withColumn("s", F.unix_micros(F.col("ts").cast("timestamp")) / 1e6)
    return e.select("event_id", F.round(ordered.speed("value", F.col("value") * 0.5, "s", _series()), 6).alias("speed"))


@query("windowed_counts", "SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, event_type, count(*)::BIGINT AS n FROM events GROUP BY ALL")
def windowed_counts(spark, d):
    e = _events(spark, d).withColumn("ts", F.col("ts").cast("timestamp"))
    w = feeds.windowed(e, "ts", "1 day", "1 day", None, ["event_type"], {"n": F.count("*")})
    return w.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n")



@query("lowess")
def lowess(spark, d):
    p = t(spark, d, "part").select((F.col("p_size") % 3).alias("k"), F.col("p_size").cast("double").alias("x"), F.col("p_retailprice").alias("y"))
    return signal.lowess_rows(p, ["k"], "x", "y").select("k", "x", "y", r4(F.col("fit"), "fit"))


@query("midrank_by_group", f"SELECT c_custkey, CASE WHEN n IS NOT NULL THEN rank() OVER (PARTITION BY s ORDER BY n NULLS LAST) - 1 + (count(*) OVER (PARTITION BY s, n) - 1) / 2.0 ELSE -1 END AS midrank FROM {_NULLS}")
def midrank_by_group(spark, d):
    return grouping.midrank(_customers(spark, d), "n", "s").select("c_custkey", F.coalesce("midrank", F.lit(-1.0)).alias("midrank"))


@query(
    "recode_from",
    "SELECT c_custkey, coalesce(r.code, -1)::INTEGER AS code FROM customer LEFT JOIN (SELECT k, row_number() OVER (ORDER BY k) - 1 AS code FROM (SELECT DISTINCT s_nationkey AS k FROM supplier)) r ON r.k = c_nationkey",
)
def recode_from(spark, d):
    return grouping.recode_from(t(spark, d, "customer"), "c_nationkey", t(spark, d, "supplier"), "s_nationkey").select("c_custkey", "code")


@query("histogram_by_group", f"SELECT coalesce(m, '-') AS s, b::INTEGER AS bin, count(c_custkey)::BIGINT AS count FROM (SELECT DISTINCT s AS m FROM {_NULLS}) CROSS JOIN range(5) r(b) LEFT JOIN {_NULLS} c ON c.s IS NOT DISTINCT FROM m AND c_acctbal >= 0 AND c_acctbal < 10000 AND floor(c_acctbal / 2000.0) = b GROUP BY ALL")
def histogram_by_group(spark, d):
    return grouping.histogram(_customers(spark, d), "c_acctbal", 0.0, 10000.0, 5, "s").withColumn("s", F.coalesce("s", F.lit("-")))


@query(
    "response_rate",
    _L + """SELECT k % 7 AS g, round(avg(r), 4) AS rate, round(coalesce(stddev_samp(r) / sqrt(count(r)), 0), 4) AS sem
    FROM (SELECT k, len(list_filter(q, lambda x: x >= 10 AND x < 30)) * 50.0 AS r FROM o) GROUP BY 1""",
)
def response_rate(spark, d):
    trials = _orders_lists(spark, d).withColumn("g", F.col("k") % 7)
    return spikes.response(trials, "q", ["g"], 10, 30).select("g", r4(F.col("rate"), "rate"), r4(F.col("sem"), "sem"))


@query("table_summary", "SELECT 'n_nationkey' AS name, count(n_nationkey)::BIGINT AS n FROM nation UNION ALL SELECT 'n_name', count(n_name)::BIGINT FROM nation UNION ALL SELECT 'n_regionkey', count(n_regionkey)::BIGINT FROM nation")
def table_summary(spark, d):
    return frame.summary(t(spark, d, "nation")).select("name", "n")


@query("running_product", "SELECT event_id, round(exp(sum(ln(1 + value / 1000)) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)), 3) AS p FROM events")
def running_product(spark, d):
    return _events(spark, d).select("event_id", F.round(ordered.cumprod(1 + F.col("value") / 1000, _series()), 3).alias("p"))


@query("list_sort_indices", _L + _UN.format("list_transform(list_sort(list_transform(range(1, len(p) + 1), lambda i: {'x': p[i], 'i': i - 1})), lambda s: s.i::INTEGER)"))
def list_sort_indices(spark, d):
    return _rows(_orders_lists(spark, d), lists.sort_indices("p"))


@query("list_conv", _L + "SELECT k, round(x, 4) AS x, i FROM (" + _UN.format("list_transform(range(1, len(q) + 1), lambda i: 0.25 * coalesce(CASE WHEN i > 1 THEN q[i - 1] END, 0) + 0.5 * q[i] + 0.25 * coalesce(q[i + 1], 0))") + ")")
def list_conv(spark, d):
    return _rows(_orders_lists(spark, d), lists.conv("q", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.25)))).withColumn("x", F.round("x", 4))


@query("list_remap", "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'final' WHEN 'O' THEN 'open' ELSE o_orderstatus END AS s FROM orders")
def list_remap(spark, d):
    o = t(spark, d, "orders")
    return o.select("o_orderkey", F.get(lists.remap(F.array("o_orderstatus"), ["F", "O"], ["final", "open"]), F.lit(0)).alias("s"))
