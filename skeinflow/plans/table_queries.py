"""Queries for the operators on tables, matrices, formats, feeds and domains, with the SQL that gives the same rows."""

from __future__ import annotations

import json
import uuid

import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from skeinflow.domain import curves, spikes, trajectory, tuning
from skeinflow.functions import jsonfns, lists, scalar
from skeinflow.operators import asof, frame, matrix, ordered, parallel, sessions, signal, stats
from skeinflow.plans.catalog import query
from skeinflow.plans.queries import _L, _events, _orders_lists, _series, r4, t
from skeinflow.sources import arrowio, container, media, msgpack, text, trials
from skeinflow.stages import shared_dir
from skeinflow.streaming import feeds


def _nations(spark, d):
    return t(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias(frame.RID), "n_name", "n_regionkey")


def _regions(spark, d):
    return t(spark, d, "region").select(F.col("r_regionkey").cast("long").alias(frame.RID), "r_name")


# --- groups


@query("group_add_column", "SELECT n_nationkey, 0 AS extra, '' AS note FROM nation")
def group_add_column(spark, d):
    n = t(spark, d, "nation").select("n_nationkey")
    return frame.add_column(frame.add_column(n, "extra", "int"), "note", "string")


@query("group_set_column", "SELECT n_nationkey, n_regionkey * 10 AS n_regionkey FROM nation")
def group_set_column(spark, d):
    return frame.set_column(t(spark, d, "nation").select("n_nationkey", "n_regionkey"), "n_regionkey", F.col("n_regionkey") * 10)


@query("group_remove_column", "SELECT n_nationkey, n_name FROM nation")
def group_remove_column(spark, d):
    return frame.remove_column(t(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey"), "n_regionkey")


@query("group_columns", "SELECT 'n_name' AS name, 25 AS rows UNION ALL SELECT 'n_regionkey', 25")
def group_columns(spark, d):
    n = _nations(spark, d)
    rows, _ = frame.shape(n)
    return spark.createDataFrame([(c, rows) for c in frame.columns(n)], "name string, rows int")


@query("group_align", "SELECT n_nationkey AS pos, n_name, n_regionkey, coalesce(r_name, '') AS r_name FROM nation LEFT JOIN region ON r_regionkey = n_nationkey")
def group_align(spark, d):
    return frame.align(_nations(spark, d), _regions(spark, d)).withColumnRenamed(frame.RID, "pos")


@query("group_attach", "SELECT n_nationkey AS pos, n_name, n_regionkey, coalesce(r_name, '') AS region FROM nation LEFT JOIN region ON r_regionkey = n_nationkey")
def group_attach(spark, d):
    return frame.attach(_nations(spark, d), _regions(spark, d), "r_name", "region").withColumnRenamed(frame.RID, "pos")


@query("group_select", "SELECT c_custkey, c_acctbal FROM customer WHERE c_nationkey % 3 <> 0")
def group_select(spark, d):
    return frame.select(t(spark, d, "customer"), F.col("c_nationkey") % 3).select("c_custkey", "c_acctbal")


@query("group_sort", "SELECT row_number() OVER (ORDER BY n_regionkey, n_nationkey) - 1 AS pos, n_name, n_regionkey FROM nation")
def group_sort(spark, d):
    return frame.sort(_nations(spark, d), "n_regionkey").withColumnRenamed(frame.RID, "pos").select("pos", "n_name", "n_regionkey")


@query("group_permute", "SELECT 24 - n_nationkey AS pos, n_name, n_regionkey FROM nation")
def group_permute(spark, d):
    order = _nations(spark, d).select(frame.RID, (24 - F.col(frame.RID)).alias("idx"))
    return frame.permute(_nations(spark, d), order).withColumnRenamed(frame.RID, "pos").select("pos", "n_name", "n_regionkey")


@query("group_append_ordered", "SELECT n_nationkey AS pos, n_name, n_regionkey FROM nation UNION ALL SELECT 25 + r_regionkey, r_name, 0 FROM region")
def group_append_ordered(spark, d):
    return frame.append(_nations(spark, d), _regions(spark, d).withColumnRenamed("r_name", "n_name")).select(F.col(frame.RID).alias("pos"), "n_name", "n_regionkey")


@query("group_concat_ordered", "SELECT i * 25 + n_nationkey AS pos, n_name, n_regionkey FROM nation, range(3) r(i)")
def group_concat_ordered(spark, d):
    n = _nations(spark, d)
    return frame.concat(n, n, n).select(F.col(frame.RID).alias("pos"), "n_name", "n_regionkey")


@query("group_catalog", "SELECT r_regionkey AS pos, r_name FROM region")
def group_catalog(spark, d):
    c = frame.Catalog(spark)
    c.put("skein_regions", _regions(spark, d))
    c.copy("skein_regions", "skein_other")
    c.rename("skein_other", "skein_third")
    got = c.get("skein_third").withColumnRenamed(frame.RID, "pos")
    c.delete("skein_third")
    if c.exists("skein_other") or c.exists("skein_third"):
        raise RuntimeError("a renamed group is still there under its old name")
    c.delete("skein_regions")
    return got


@query("group_from_lists", _L + "SELECT k, unnest(range(len(p)))::BIGINT AS pos, unnest(p) AS list0, unnest(q) AS list1 FROM o")
def group_from_lists(spark, d):
    o = _orders_lists(spark, d).select("k", F.array("p", "q").alias("both"))
    wide = o.select("k", *(lists.get("both", F.lit(i)).alias(f"list{i}") for i in range(2)))
    return wide.select("k", F.posexplode(F.arrays_zip("list0", "list1")).alias("pos", "c")).select("k", F.col("pos").cast("long").alias("pos"), "c.*")


@query("group_lists_to_columns", "WITH m AS (SELECT embedding AS e FROM embeddings WHERE vec_id = 0) SELECT unnest(range(32))::BIGINT AS pos, unnest(e[1:32])::DOUBLE AS list0, unnest(e[33:64])::DOUBLE AS list1 FROM m")
def group_lists_to_columns(spark, d):
    one = t(spark, d, "embeddings").where("vec_id = 0").select(lists.reshape(F.transform("embedding", lambda x: x.cast("double")), F.lit(2), F.lit(32)).alias("m"))
    return frame.lists_to_columns(one, "m", 2).withColumnRenamed(frame.RID, "pos")


@query("matrix_dump", "SELECT vec_id AS pos, i::INTEGER AS i, j::INTEGER AS j, embedding[i * 8 + j + 1]::DOUBLE AS v FROM embeddings, range(8) a(i), range(8) b(j)")
def matrix_dump(spark, d):
    return frame.matrix_rows(_square(spark, d).withColumnRenamed("vec_id", frame.RID), "m").withColumnRenamed(frame.RID, "pos")


@query("formatted_columns", "SELECT printf('%05d', s_suppkey) AS s_suppkey, printf('%.2f', s_acctbal) AS s_acctbal, s_name FROM supplier")
def formatted_columns(spark, d):
    s = t(spark, d, "supplier").select(F.col("s_suppkey").cast("int").alias("s_suppkey"), "s_acctbal", "s_name")
    return frame.formatted(s, {"int": "%05d", "s_acctbal": "%.2f"})


# --- formats, written and read again


def _written(spark, name: str) -> str:
    """A new folder for a format's files, among the stage tables."""
    return f"{shared_dir(spark)}/skeinflow-{name}-{uuid.uuid4().hex}"


@query("format_container", "SELECT n_nationkey AS pos, n_name, n_regionkey::INTEGER AS n_regionkey FROM nation")
def format_container(spark, d):
    group = container.decode(container.encode(container.to_group(_nations(spark, d), "nations")))
    schema = container.group_schema(group)
    return spark.createDataFrame(container.group_rows(group, schema), schema).withColumnRenamed(frame.RID, "pos")


@query("format_container_base64", "SELECT r_regionkey AS pos, r_name FROM region")
def format_container_base64(spark, d):
    group = container.from_base64(container.to_base64(container.to_group(_regions(spark, d), "regions")))
    schema = container.group_schema(group)
    return spark.createDataFrame(container.group_rows(group, schema), schema).withColumnRenamed(frame.RID, "pos")


@query("format_list_base64", "SELECT unnest(range(25))::INTEGER AS i, unnest(list(n_name ORDER BY n_nationkey)) AS x FROM nation")
def format_list_base64(spark, d):
    column = container.to_group(_nations(spark, d), "nations").columns["n_name"]
    back = container.list_from_base64(container.list_to_base64(column))
    return spark.createDataFrame(list(enumerate(back.values)), "i int, x string")


@query("format_csv", "SELECT o_orderkey, o_totalprice, o_orderpriority FROM orders WHERE o_orderstatus = 'F'")
def format_csv(spark, d):
    path = _written(spark, "csv")
    text.write_csv(t(spark, d, "orders"), path, rows=F.col("o_orderstatus") == "F", names=["o_orderkey", "o_totalprice", "o_orderpriority"])
    return spark.read.option("header", True).schema("o_orderkey long, o_totalprice double, o_orderpriority string").csv(path)


@query("format_ascii", "SELECT l_orderkey::INTEGER AS k, l_quantity AS q, l_returnflag AS f FROM lineitem")
def format_ascii(spark, d):
    path = _written(spark, "ascii")
    frame.dump(t(spark, d, "lineitem"), path, header=False, names=["l_returnflag", "l_quantity", "l_orderkey"])
    return text.read_ascii(spark, path, "k:int:2", "q:float:1", "f:string:0")


@query("format_tsv", "SELECT c_custkey, c_mktsegment FROM customer")
def format_tsv(spark, d):
    path = _written(spark, "tsv")
    text.write_tsv(t(spark, d, "customer").select("c_custkey", "c_mktsegment"), path)
    return spark.read.option("header", True).option("sep", "\t").schema("c_custkey long, c_mktsegment string").csv(path)


@query("format_lines", "SELECT trunc(c_acctbal)::BIGINT::VARCHAR AS value FROM customer")
def format_lines(spark, d):
    path = _written(spark, "lines")
    text.write_values(t(spark, d, "customer").withColumn("c_acctbal", scalar.to_int("c_acctbal")), "c_acctbal", path)
    return text.read_lines(spark, path)


@query("format_arrow", "SELECT s_suppkey, s_name, s_acctbal FROM supplier")
def format_arrow(spark, d):
    return arrowio.from_arrow(spark, arrowio.to_arrow(t(spark, d, "supplier").select("s_suppkey", "s_name", "s_acctbal")))


@query("format_msgpack", "SELECT n_name, n_regionkey FROM nation")
def format_msgpack(spark, d):
    columns = msgpack.unpack(msgpack.table(_nations(spark, d), frame.RID))
    return spark.createDataFrame(list(zip(columns["n_name"], columns["n_regionkey"], strict=True)), "n_name string, n_regionkey long")


@query("format_hybrid_json", "SELECT n_name, n_regionkey FROM nation")
def format_hybrid_json(spark, d):
    held = json.loads(jsonfns.hybrid_json(_nations(spark, d), frame.RID, "nations").first()["json"])
    return spark.createDataFrame([(r["n_name"], r["n_regionkey"]) for r in held["rows"]], "n_name string, n_regionkey long")


@query("format_list_container", _L + "SELECT k, unnest(range(len(q)))::INTEGER AS i, unnest(q) AS x FROM o")
def format_list_container(spark, d):
    coded = container.encode_rows(_orders_lists(spark, d).select("k", "q"), "k", "q")

    @F.pandas_udf("array<double>")
    def values(payload: pd.Series) -> pd.Series:
        return payload.map(lambda b: [float(v) for v in container.decode(bytes(b)).columns["list"].values])

    return coded.select("k", F.posexplode(values("payload")).alias("i", "x"))


@query("format_wav", "SELECT i::INTEGER AS i, (i * i % 30000)::INTEGER AS x FROM range(2000) r(i)")
def format_wav(spark, d):
    data = media.wav_bytes([i * i % 30000 for i in range(2000)], 8000)
    return spark.createDataFrame([(data,)], "content binary").select(media.wav_samples("content").alias("w")).select(F.posexplode("w.samples").alias("i", "x"))


@query("format_trials", _L + "SELECT k::INTEGER AS obs, unnest(range(len(e)))::INTEGER AS i, unnest(e) AS x FROM (SELECT k, list_transform(list_filter(q, lambda x: x > 10 AND x <= 30), lambda x: x - 10) AS e FROM o)")
def format_trials(spark, d):
    path = _written(spark, "trials")
    found = F.array(F.struct(F.lit(1).alias("channel"), F.col("q").alias("times")), F.struct(F.lit(2).alias("channel"), F.col("p").alias("times")))
    _orders_lists(spark, d).select(F.col("k").cast("int").alias("obs"), found.alias("spikes")).write.parquet(path)
    held = trials.Trials(spark)
    handle = held.open(path)
    rows = held.spikes(handle, 1, F.lit(10), F.lit(30), F.lit(10))
    held.close(handle)
    return rows.select("obs", F.posexplode("times").alias("i", "x"))


@query("format_trial_events", "SELECT user_id::INTEGER AS obs, (row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1)::INTEGER AS n, length(event_type)::INTEGER AS tag, event_id::INTEGER AS t FROM events")
def format_trial_events(spark, d):
    path = _written(spark, "trials")
    entry = F.struct(F.col("event_id").cast("int").alias("t"), F.length("event_type").alias("tag"))
    made = _events(spark, d).groupBy(F.col("user_id").cast("int").alias("obs")).agg(F.array_sort(F.collect_list(entry)).alias("l"))
    empty = F.array().cast("array<int>")
    made.select("obs", F.transform("l", lambda e: F.struct(e["tag"].alias("tag"), e["t"].alias("t"), empty.alias("params"))).alias("events")).write.parquet(path)
    held = trials.Trials(spark)
    return held.events(held.open(path)).select("obs", "n", "tag", "t")


@query("json_parsed", "SELECT event_id, (json_extract_string(props, '$.k'))::BIGINT AS k, 'object' AS whole, 'number' AS part FROM events")
def json_parsed(spark, d):
    e = t(spark, d, "events")
    return e.select("event_id", jsonfns.from_json("props", "k long")["k"].alias("k"), jsonfns.kind("props").alias("whole"), jsonfns.kind("props", "k").alias("part"))


@query("json_values", _L + "SELECT k, '[' || array_to_string(list_transform(q, lambda x: x::INTEGER::VARCHAR), ',') || ']' AS a, '{\"n\":' || len(q) || '}' AS b FROM o")
def json_values(spark, d):
    whole = F.transform("q", lambda x: x.cast("int"))
    return _orders_lists(spark, d).select("k", jsonfns.value_json(whole).alias("a"), jsonfns.to_json(F.struct(F.size("q").alias("n"))).alias("b"))


# --- matrices


def _square(spark, d):
    return t(spark, d, "embeddings").select("vec_id", lists.reshape(F.transform("embedding", lambda x: x.cast("double")), F.lit(8), F.lit(8)).alias("m"))


_ROW = "list_transform(range(8), lambda i: {0}(list_transform(range(8), lambda j: e[i * 8 + j + 1])))"
_COLUMN = "list_transform(range(8), lambda j: {0}(list_transform(range(8), lambda i: e[i * 8 + j + 1])))"
_E = "WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings) "


@query(
    "matrix_row_margins",
    _E + f"SELECT vec_id, i::INTEGER AS i, round(rs[i + 1], 4) AS rs, round(cs[i + 1], 4) AS cs, round(rm[i + 1], 4) AS rm, round(cm[i + 1], 4) AS cm, e[i * 9 + 1] AS diag "
    f"FROM (SELECT vec_id, e, {_ROW.format('list_sum')} AS rs, {_COLUMN.format('list_sum')} AS cs, {_ROW.format('list_avg')} AS rm, {_COLUMN.format('list_avg')} AS cm FROM e), range(8) r(i)",
)
def matrix_row_margins(spark, d):
    made = [matrix.row_sums("m"), matrix.col_sums("m"), matrix.row_means("m"), matrix.col_means("m"), matrix.diag("m")]
    names = ["rs", "cs", "rm", "cm", "diag"]
    m = _square(spark, d).select("vec_id", F.arrays_zip(*(c.alias(n) for c, n in zip(made, names, strict=True))).alias("z"))
    m = m.select("vec_id", F.posexplode("z").alias("i", "z"))
    return m.select("vec_id", "i", *(r4(F.col(f"z.{n}"), n) for n in names[:4]), F.col("z.diag").alias("diag"))


@query(
    "matrix_algebra",
    _E + "SELECT vec_id, i::INTEGER AS i, j::INTEGER AS j, round(2 * e[i * 8 + j + 1], 4) AS a, 0.0 AS s, e[j * 8 + i + 1] AS tr, round(e[i * 8 + j + 1], 4) AS same FROM e, range(8) a(i), range(8) b(j)",
)
def matrix_algebra(spark, d):
    m = _square(spark, d)
    made = {
        "a": matrix.elementwise(lambda x, y: x + y, "m", F.col("m")), "s": matrix.elementwise(lambda x, y: x - y, "m", F.col("m")), "tr": matrix.transpose("m"),
        "same": matrix.matmul(F.col("m"), matrix.identity(8)),
    }
    at = F.sequence(F.lit(0), F.lit(7))
    m = m.select("vec_id", *(v.alias(k) for k, v in made.items())).withColumn("i", F.explode(at)).withColumn("j", F.explode(at))
    cell = {k: F.get(F.get(k, F.col("i")), F.col("j")) for k in made}
    return m.select("vec_id", "i", "j", r4(cell["a"], "a"), r4(cell["s"], "s"), cell["tr"].alias("tr"), r4(cell["same"], "same"))


@query(
    "matrix_centres",
    _E + f"SELECT vec_id, i::INTEGER AS i, j::INTEGER AS j, round(e[i * 8 + j + 1] - rm[i + 1], 4) AS r, round(e[i * 8 + j + 1] - cm[j + 1], 4) AS c "
    f"FROM (SELECT vec_id, e, {_ROW.format('list_avg')} AS rm, {_COLUMN.format('list_avg')} AS cm FROM e), range(8) a(i), range(8) b(j)",
)
def matrix_centres(spark, d):
    m = _square(spark, d).select("vec_id", matrix.center_rows("m", matrix.row_means("m")).alias("r"), matrix.center_cols("m", matrix.col_means("m")).alias("c"))
    m = m.select("vec_id", F.posexplode(F.arrays_zip("r", "c")).alias("i", "z")).select("vec_id", "i", F.posexplode(F.arrays_zip("z.r", "z.c")).alias("j", "z"))
    return m.select("vec_id", "i", "j", r4(F.col("z")["r"], "r"), r4(F.col("z")["c"], "c"))


@query("matrix_fft", _E + "SELECT vec_id, i::INTEGER AS i, j::INTEGER AS j, round(e[i * 8 + j + 1], 4) AS v FROM e, range(8) a(i), range(8) b(j)")
def matrix_fft(spark, d):
    f = _square(spark, d).select("vec_id", signal.fft2("m").alias("f"))
    back = f.select("vec_id", signal.ifft2(F.col("f.re"), F.col("f.im")).alias("m"))
    return back.select("vec_id", F.posexplode("m").alias("i", "r")).select("vec_id", "i", F.posexplode("r").alias("j", "v")).select("vec_id", "i", "j", r4(F.col("v"), "v"))


# --- ordered rows, events and feeds


@query("event_data", "SELECT event_id, ts, value FROM events WHERE event_type = 'click'")
def event_data(spark, d):
    return asof.event_data(_events(spark, d), F.col("event_type") == "click", "event_id", "ts", "value")


@query("event_tags", "SELECT (SELECT coalesce(min(r_regionkey), -1) FROM region WHERE lower(r_name) = 'asia')::INTEGER AS id UNION ALL SELECT -1")
def event_tags(spark, d):
    names = t(spark, d, "region").select(F.col("r_regionkey").cast("int").alias("id"), F.col("r_name").alias("name"))
    return asof.tag_id(names, "Asia").union(asof.tag_id(names, "no such name"))


@query("event_window", _L + "SELECT k, unnest(range(len(e)))::INTEGER AS i, unnest(e) AS x FROM (SELECT k, list_transform(list_filter(q, lambda x: x > 10 AND x <= 30), lambda x: x - 10) AS e FROM o)")
def event_window(spark, d):
    return _orders_lists(spark, d).select("k", F.posexplode(asof.in_window(F.col("q"), F.lit(10), F.lit(30), F.lit(10))).alias("i", "x"))


@query("event_baseline", _E + "SELECT vec_id, i::INTEGER AS i, round(e[i + 11] - list_avg(e[1:5]), 4) AS x FROM e, range(10) r(i)")
def event_baseline(spark, d):
    e = t(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("e"))
    moved = asof.baseline_subtracted(F.col("e"), F.lit(10), F.lit(20), F.lit(0), F.lit(5))
    return e.select("vec_id", F.posexplode(moved).alias("i", "x")).select("vec_id", "i", r4(F.col("x"), "x"))


@query(
    "cross_correlation",
    f"""WITH e AS (SELECT user_id % 5 AS g, value, row_number() OVER (PARTITION BY user_id % 5 ORDER BY ts, event_id) - 1 AS i FROM events)
    SELECT a.g, lag::INTEGER AS lag, round(sum(a.value * b.value), 2) AS dot FROM e a, range(-2, 3) r(lag), e b WHERE a.g = b.g AND a.i + lag = b.i GROUP BY ALL""",
)
def cross_correlation(spark, d):
    w = Window.partitionBy("g").orderBy("ts", "event_id")
    e = _events(spark, d).withColumn("g", F.col("user_id") % 5).withColumn("i", F.row_number().over(w) - 1).select("g", "i", "value")
    return ordered.crosscorr(e, e, ["g"], "i", "value", [-2, -1, 0, 1, 2]).select("g", "lag", F.round("dot", 2).alias("dot"))


@query("forward_filled", f"SELECT event_id, coalesce(last_value(CASE WHEN value > 50 THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), -1) AS v FROM events")
def forward_filled(spark, d):
    filled = ordered.forward_fill(F.when(F.col("value") > 50, F.col("value")), _series())
    return _events(spark, d).select("event_id", F.coalesce(filled, F.lit(-1.0)).alias("v"))


@query("feed_parsed", "SELECT event_id, 3 AS type, (event_id % 7)::INTEGER AS subtype, event_id * 10 AS time, event_type AS param, 2 AS n FROM events")
def feed_parsed(spark, d):
    line = F.concat_ws(" ", F.lit("3"), F.col("event_id") % 7, F.col("event_id") * 10, "event_type", "value")
    e = _events(spark, d).select("event_id", feeds.parse_event(line).alias("p"))
    return e.select("event_id", "p.type", "p.subtype", "p.time", F.get("p.params", F.lit(0)).alias("param"), F.size("p.params").alias("n"))


@query("feed_matched", "SELECT event_id, CASE WHEN event_type = 'click' THEN 2 ELSE 5 END AS every FROM events WHERE event_type LIKE '%i%'")
def feed_matched(spark, d):
    m = feeds.Matches()
    m.add("*i*", 5)
    m.add("clic?", 2)
    m.add("err*")
    m.remove("err*")
    if m.all() != {"*i*": 5, "clic?": 2}:
        raise RuntimeError("the subscriptions are not those that were added")
    return m.apply(_events(spark, d), "event_type").select("event_id", "every")


@query(
    "observations_nested",
    f"""WITH e AS (SELECT user_id, event_id, ts, value, sum((event_type = 'signup')::INTEGER) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS n, event_type FROM events),
    f AS (SELECT *, coalesce(sum((event_type IN ('purchase', 'error', 'view'))::INTEGER) OVER (PARTITION BY user_id, n ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ended,
      max((event_type IN ('purchase', 'error', 'view'))::INTEGER) OVER (PARTITION BY user_id, n) AS whole FROM e),
    g AS (SELECT *, max(CASE WHEN n > 0 AND whole = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS broken FROM f),
    h AS (SELECT * FROM g WHERE n > 0 AND ended = 0 AND whole = 1 AND broken = 0)
    SELECT user_id, (n - 1)::BIGINT AS obs, count(*)::INTEGER AS n, arg_max(value, (ts, event_id)) AS last_value FROM h GROUP BY user_id, h.n""",
)
def observations_nested(spark, d):
    e = _events(spark, d).withColumn("micros", F.unix_micros(F.col("ts").cast("timestamp")))
    s = sessions.sessionise(e, ["user_id"], ["ts", "event_id"], F.col("event_type") == "signup", F.col("event_type").isin("purchase", "error", "view"), "micros")
    packed = sessions.observations(s, ["user_id"], ["ts", "event_id"], ["value"])
    return packed.select("user_id", "obs", F.size("value").alias("n"), lists.last("value").alias("last_value"))


# --- parallel work


@query("unit_rows", "SELECT u AS unit, j, u * 10 + j AS v FROM range(6) a(u), range(u + 1) b(j) WHERE u <> 3")
def unit_rows(spark, d):
    def work(unit, state, seed):
        if unit == 3:
            raise ValueError("this unit fails")
        return pd.DataFrame({"j": range(unit + 1), "v": [unit * state + j for j in range(unit + 1)]})

    rows, errors = parallel.map_groups(spark, 6, work, "j long, v long", setup=lambda: 10)
    return rows.select("unit", "j", "v")


@query("unit_errors", "SELECT 3::BIGINT AS unit, TRUE AS told")
def unit_errors(spark, d):
    def work(unit, state, seed):
        if unit == 3:
            raise ValueError("this unit fails")
        return pd.DataFrame({"j": [unit]})

    _, errors = parallel.map_groups(spark, 6, work, "j long")
    return errors.select("unit", F.col("error").contains("this unit fails").alias("told"))


@query("reduced_groups", "SELECT l_returnflag, max(l_quantity) - min(l_quantity) AS value FROM lineitem GROUP BY 1")
def reduced_groups(spark, d):
    def spread(x: pd.Series) -> float:
        return float(x.max() - x.min())

    return parallel.reduce_groups(t(spark, d, "lineitem"), ["l_returnflag"], "l_quantity", spread)


# --- domains


@query("spikes_aligned", _L + "SELECT k, unnest(range(len(e)))::INTEGER AS i, unnest(e) AS x FROM (SELECT k, list_filter(list_transform(q, lambda x: x - q[1]), lambda x: x BETWEEN -10 AND 10) AS e FROM o)")
def spikes_aligned(spark, d):
    o = _orders_lists(spark, d).withColumn("at", lists.first("q"))
    return spikes.align(o, "q", "at", -10.0, 10.0).select("k", F.posexplode("aligned").alias("i", "x"))


@query("spikes_onset", _L + "SELECT k % 7 AS g, round(avg(list_min(q)), 4) AS onset FROM o GROUP BY 1")
def spikes_onset(spark, d):
    return spikes.onset(_orders_lists(spark, d).withColumn("g", F.col("k") % 7), "q", ["g"]).select("g", r4(F.col("onset"), "onset"))


@query(
    "spikes_smooth",
    _E + "SELECT vec_id, i::INTEGER AS i, round((coalesce(CASE WHEN i > 1 THEN e[i - 1] END, 0) + coalesce(CASE WHEN i > 0 THEN e[i] END, 0) + e[i + 1] + coalesce(e[i + 2], 0) + coalesce(e[i + 3], 0)) / 5, 4) AS x FROM e, range(64) r(i)",
)
def spikes_smooth(spark, d):
    e = t(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("e"))
    return e.select("vec_id", F.posexplode(spikes.smooth5(F.col("e"))).alias("i", "x")).select("vec_id", "i", r4(F.col("x"), "x"))


@query(
    "spikes_joined",
    """WITH s AS (SELECT l_orderkey AS o, count(*) AS n, min(l_quantity) AS first FROM lineitem GROUP BY 1)
    SELECT o_orderkey, o_orderkey AS src, s.n::INTEGER AS n, s.first FROM orders JOIN s ON o = o_orderkey""",
)
def spikes_joined(spark, d):
    trials_ = t(spark, d, "orders").select(F.col("o_orderkey"), F.col("o_orderkey").alias("obs"))
    found = t(spark, d, "lineitem").select(F.col("l_orderkey").alias("obs"), F.col("l_quantity").alias("time"), F.col("l_linenumber").alias("unit"), F.col("l_discount").alias("depth"))
    joined = spikes.add_spikes(trials_, found, "obs", "o_orderkey").where(F.size("spike_times") > 0)
    return joined.select("o_orderkey", F.col("spike_src_trial").alias("src"), F.size("spike_times").alias("n"), lists.first("spike_times").alias("first"))


@query("unit_depths", "SELECT s_suppkey AS unit, s_nationkey AS channel, coalesce(n_regionkey * 20.0, -1) AS depth FROM supplier LEFT JOIN nation ON n_nationkey = s_nationkey AND n_nationkey < 20")
def unit_depths(spark, d):
    units = t(spark, d, "supplier").select(F.col("s_suppkey").alias("unit"), F.col("s_nationkey").alias("channel"))
    sites = t(spark, d, "nation").where("n_nationkey < 20").select(F.concat(F.lit("ch"), "n_nationkey").alias("site"), (F.col("n_regionkey") * 20.0).alias("depth"))
    return spikes.unit_depths(units, sites).select("unit", "channel", F.coalesce("depth", F.lit(-1.0)).alias("depth"))


@query("roc_points", "WITH v AS (SELECT DISTINCT l_quantity AS threshold FROM lineitem) SELECT threshold, round(avg((l_quantity > threshold)::INTEGER) FILTER (l_returnflag <> 'R'), 4) AS fa, round(avg((l_quantity > threshold)::INTEGER) FILTER (l_returnflag = 'R'), 4) AS hr FROM lineitem, v GROUP BY 1")
def roc_points(spark, d):
    li = t(spark, d, "lineitem").select(F.lit(1).alias("k"), "l_quantity", (F.col("l_returnflag") == "R").cast("int").alias("pos"))
    return tuning.roc(li, ["k"], "l_quantity", "pos").where("threshold IS NOT NULL").select("threshold", r4(F.col("fa"), "fa"), r4(F.col("hr"), "hr"))


def _boxes(spark, d, how):
    def square(x, y):
        return F.array(*(F.struct((x + a).cast("double").alias("x"), (y + b).cast("double").alias("y")) for a, b in ((0, 0), (4, 0), (4, 4), (0, 4))))

    s = t(spark, d, "supplier").select("s_suppkey", square(F.lit(0), F.lit(0)).alias("a"), square(F.col("s_nationkey") % 3 + 1, F.lit(1)).alias("b"))
    rings = s.select("s_suppkey", curves.polygons(F.col("a"), F.col("b"), how).alias("r"))
    area = F.aggregate(F.transform("r", lists.shoelace), F.lit(0.0), lambda acc, x: acc + F.abs(x))
    return rings.select("s_suppkey", r4(area, "area"))


for _how, _area in (("union", "32 - (3 - s_nationkey % 3) * 3.0"), ("difference", "16 - (3 - s_nationkey % 3) * 3.0"), ("xor", "32 - 2 * (3 - s_nationkey % 3) * 3.0")):
    query(f"polygon_{_how}", f"SELECT s_suppkey, round({_area}, 4) AS area FROM supplier")(lambda spark, d, how=_how: _boxes(spark, d, how))


@query("curve_closest", "SELECT s_suppkey, CASE WHEN s_nationkey % 4 = 0 THEN 0 WHEN s_nationkey % 4 = 1 THEN 1 WHEN s_nationkey % 4 = 2 THEN 2 ELSE 3 END AS segment FROM supplier")
def curve_closest(spark, d):
    box = F.array(*(F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in ((0, 0), (10, 0), (10, 10), (0, 10), (0, 0))))
    side = F.col("s_nationkey") % 4
    x = F.when(side == 1, 9.0).when(side == 3, 1.0).otherwise(5.0)
    y = F.when(side == 0, 1.0).when(side == 2, 9.0).otherwise(5.0)
    return t(spark, d, "supplier").select("s_suppkey", curves.closest_segment(box, x, y).cast("int").alias("segment"))


@query("curve_crossing", "SELECT s_suppkey, s_nationkey % 2 = 1 AS crosses FROM supplier")
def curve_crossing(spark, d):
    odd = F.col("s_nationkey") % 2 == 1
    corner = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    swapped = F.when(odd, 0.0).otherwise(4.0)
    p = F.array(corner(F.lit(0), F.lit(0)), corner(F.lit(4), F.lit(0)), corner(swapped, F.lit(4)), corner(4.0 - swapped, F.lit(4)))
    return t(spark, d, "supplier").select("s_suppkey", curves.self_intersects(p).alias("crosses"))


@query("curve_bezier", "SELECT s_suppkey, i::INTEGER AS i, round(s_nationkey * i / 4.0, 4) AS x, round(8 * (i / 4.0) * (1 - i / 4.0), 4) AS y FROM supplier, range(5) r(i)")
def curve_bezier(spark, d):
    corner = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    n = F.col("s_nationkey")
    p = F.array(corner(F.lit(0), F.lit(0)), corner(n / 2, F.lit(4)), corner(n, F.lit(0)))
    c = t(spark, d, "supplier").select("s_suppkey", F.posexplode(curves.bezier(p, 5)).alias("i", "q"))
    return c.select("s_suppkey", "i", r4(F.col("q.x"), "x"), r4(F.col("q.y"), "y"))


@query("point_distances", "SELECT c_custkey, round(sqrt(pow(c_nationkey - 3, 2) + pow(c_acctbal - 10, 2)), 4) AS d, CASE WHEN c_acctbal = 0 THEN 0 ELSE round(1 / c_acctbal, 8) END AS r, (c_nationkey <> 3)::INTEGER AS ne FROM customer")
def point_distances(spark, d):
    return t(spark, d, "customer").select(
        "c_custkey", r4(scalar.distance("c_nationkey", "c_acctbal", F.lit(3), F.lit(10)), "d"), F.round(scalar.recip("c_acctbal"), 8).alias("r"), scalar.noteq("c_nationkey", F.lit(3)).alias("ne"),
    )


@query(
    "math_more",
    """SELECT c_custkey, round(acos(c_acctbal / 20000), 4) AS ac, round(asin(c_acctbal / 20000), 4) AS asn, round(tan(c_acctbal / 20000), 4) AS ta, round(cosh(c_acctbal / 20000), 4) AS ch,
    round(sinh(c_acctbal / 20000), 4) AS sh, regexp_extract('a/b.c/x' || c_custkey || '.tar.gz', '([^./]*)\\.[^/]*$', 1) AS stem FROM customer""",
)
def math_more(spark, d):
    x, u = F.col("c_acctbal") / 20000, scalar.UNARY
    name = scalar.file_tail(F.concat(F.lit("a/b.c/x"), "c_custkey", F.lit(".tar.gz")))
    stem = F.regexp_extract(name, r"^([^.]*)", 1)
    return t(spark, d, "customer").select("c_custkey", r4(u["acos"](x), "ac"), r4(u["asin"](x), "asn"), r4(u["tan"](x), "ta"), r4(u["cosh"](x), "ch"), r4(u["sinh"](x), "sh"), stem.alias("stem"))


@query(
    "kde_compared",
    """WITH p AS (SELECT value AS x, user_id::DOUBLE AS y, event_type FROM events WHERE event_type IN ('click', 'view')), g AS (SELECT event_type, gx, gy, avg(exp(-(pow(gx * 20 + 10 - x, 2) + pow(gy * 20 + 10 - y, 2)) / 800.0)) / (2 * pi() * 400) AS v
    FROM range(5) a(gx), range(5) b(gy), p GROUP BY ALL)
    SELECT a.gx::INTEGER AS gx, a.gy::INTEGER AS gy, round(a.v - b.v, 8) AS difference FROM g a JOIN g b ON a.gx = b.gx AND a.gy = b.gy AND a.event_type = 'click' AND b.event_type = 'view'""",
)
def kde_compared(spark, d):
    def part(kind):
        points = _events(spark, d).where(F.col("event_type") == kind).select(F.col("value").alias("x"), F.col("user_id").cast("double").alias("y"))
        return trajectory.kde(points, (0.0, 100.0, 0.0, 100.0), 5, 5, 20.0)

    return trajectory.compare(part("click"), part("view")).select("gx", "gy", F.round("difference", 8).alias("difference"))


@query("summed_total", "SELECT l_returnflag, round(sum(l_quantity), 4) AS total, round(exp(sum(ln(1 + l_tax / 100))), 4) AS product FROM lineitem GROUP BY 1")
def summed_total(spark, d):
    return t(spark, d, "lineitem").groupBy("l_returnflag").agg(r4(stats.total("l_quantity"), "total"), r4(stats.product(1 + F.col("l_tax") / 100), "product"))
