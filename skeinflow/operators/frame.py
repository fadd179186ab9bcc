"""Tables ("groups") of ordered rows: building, aligning, appending, selecting and dumping.

A group is a DataFrame with an ordinal column RID, dense from 0, that carries the row order; physical order means nothing.
Columns of different lengths are aligned by ordinal, short ones filled with the default of their type.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skeinflow.stages import settled
from skeinflow.types import default

RID = "_rid"


def running_total(df: DataFrame, order: list[str | Column], weight: Column, out: str) -> DataFrame:
    """``df`` with the sum of ``weight`` over the rows up to each one in ``order``, without one task that sorts them all.

    Rows are range-partitioned; each partition sums its own and starts from the sum of those before it, one row a partition.
    The partitioning samples its bounds, so it is written down before it is used twice.
    """
    parts = df.withColumn("_w", weight).repartitionByRange(*order).withColumn("_p", F.spark_partition_id())
    parts = settled(parts, "ranges")
    w = Window.partitionBy("_p").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    sums = parts.groupBy("_p").agg(F.sum("_w").alias("_s"))
    before = F.sum("_s").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1))
    starts = sums.select("_p", F.coalesce(before, F.lit(0)).alias("_start"))
    return parts.withColumn("_local", F.sum("_w").over(w)).join(F.broadcast(starts), "_p").withColumn(out, F.col("_local") + F.col("_start")).drop("_p", "_w", "_s", "_local", "_start")


def with_rid(df: DataFrame, *order: str | Column) -> DataFrame:
    """Number rows by ``order`` (needed, and total for reruns to agree), dense from 0."""
    return running_total(df, list(order), F.lit(1).cast("long"), RID).withColumn(RID, F.col(RID) - 1)


def from_lists(spark: SparkSession, name: str | None = None, **columns: list) -> DataFrame:
    """A small group from Python lists of any lengths, registered under ``name`` if given."""
    n = max((len(c) for c in columns.values()), default=0)
    kinds = {k: spark.createDataFrame([(c,)], [k]).schema[0].dataType.elementType for k, c in columns.items()}
    rows = [tuple([i, *(c[i] if i < len(c) else default(kinds[k]) for k, c in columns.items())]) for i in range(n)]
    schema = T.StructType([T.StructField(RID, T.LongType()), *(T.StructField(k, t) for k, t in kinds.items())])
    df = spark.createDataFrame(rows, schema)
    if name:
        df.createOrReplaceTempView(name)
    return df


class Catalog:
    """Named groups, as temporary views."""

    def __init__(self, spark: SparkSession):
        self.spark = spark

    def put(self, name: str, df: DataFrame) -> DataFrame:
        df.createOrReplaceTempView(name)
        return df

    def get(self, name: str) -> DataFrame:
        return self.spark.table(name)

    def exists(self, name: str) -> bool:
        return self.spark.catalog.tableExists(name)

    def names(self) -> list[str]:
        return sorted(t.name for t in self.spark.catalog.listTables() if t.isTemporary)

    def rename(self, old: str, new: str) -> None:
        self.put(new, self.get(old))
        self.delete(old)

    def copy(self, old: str, new: str) -> DataFrame:
        return self.put(new, self.get(old))

    def delete(self, name: str) -> None:
        self.spark.catalog.dropTempView(name)

    def clear(self) -> None:
        for n in self.names():
            self.delete(n)


def columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c != RID]


def add_column(df: DataFrame, name: str, kind: str) -> DataFrame:
    """A new column holding the default of its type."""
    t = T._parse_datatype_string(kind)
    value = F.array().cast(kind) if isinstance(t, T.ArrayType) else F.lit(default(t)).cast(kind)
    return df.withColumn(name, value)


def set_column(df: DataFrame, name: str, value: Column) -> DataFrame:
    return df.withColumn(name, value)


def remove_column(df: DataFrame, *names: str) -> DataFrame:
    return df.drop(*names)


def shape(df: DataFrame) -> tuple[int, int]:
    return df.count(), len(columns(df))


def summary(df: DataFrame) -> DataFrame:
    """Name, type and filled rows of each column."""
    counts = df.agg(*(F.count(F.col(f"`{c}`")).alias(c) for c in columns(df)))
    pairs = F.array(*(F.struct(F.lit(c).alias("name"), F.lit(df.schema[c].dataType.simpleString()).alias("type"), F.col(f"`{c}`").alias("n")) for c in columns(df)))
    return counts.select(F.explode(pairs).alias("c")).select("c.*")


def align(*groups: DataFrame) -> DataFrame:
    """Side by side by ordinal; the short ones are filled with defaults."""
    out = groups[0]
    for g in groups[1:]:
        out = out.join(g, RID, "full")
    fills = {f.name: default(f.dataType) for f in out.schema if f.name != RID}
    made = []
    for f in out.schema:
        if f.name == RID:
            made.append(F.col(RID))
            continue
        fill = F.array().cast(f.dataType) if isinstance(f.dataType, T.ArrayType) else F.lit(fills[f.name]).cast(f.dataType)
        made.append(F.coalesce(F.col(f"`{f.name}`"), fill).alias(f.name))
    return out.select(*made)


def attach(df: DataFrame, other: DataFrame, column: str, name: str | None = None) -> DataFrame:
    """Another group's column, by ordinal."""
    return align(df, other.select(RID, F.col(f"`{column}`").alias(name or column)))


def _schema(df: DataFrame) -> dict[str, T.DataType]:
    return {f.name: f.dataType for f in df.schema if f.name != RID}


def _stacked(parts: list[DataFrame]) -> DataFrame:
    """Parts one after the other, rows renumbered if they have ordinals."""
    if all(RID in p.columns for p in parts):
        tagged = [p.withColumn("_part", F.lit(i)) for i, p in enumerate(parts)]
        df = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)
        return with_rid(df.withColumnRenamed(RID, "_old"), "_part", "_old").drop("_part", "_old")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def append(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of b after those of a; every column of b must be in a with the same type, others get defaults."""
    sa, sb = _schema(a), _schema(b)
    for k, t in sb.items():
        if sa.get(k) != t:
            raise ValueError(f"column {k!r} of type {t.simpleString()} does not fit")
    out = _stacked([a, b])
    missing = [k for k in sa if k not in sb]
    for k in missing:
        t = sa[k]
        fill = F.array().cast(t) if isinstance(t, T.ArrayType) else F.lit(default(t)).cast(t)
        out = out.withColumn(k, F.coalesce(F.col(f"`{k}`"), fill))
    return out


def concat(*groups: DataFrame) -> DataFrame:
    """Any number of groups of exactly the same schema, one after the other."""
    first = _schema(groups[0])
    for g in groups[1:]:
        if _schema(g) != first:
            raise ValueError(f"schemas differ: {first} and {_schema(g)}")
    return _stacked(list(groups))


def select(df: DataFrame, mask: Column) -> DataFrame:
    """Rows whose mask (boolean, or a number) is true."""
    return df.filter(mask if _is_boolean(df, mask) else mask != 0)


def _is_boolean(df: DataFrame, mask: Column) -> bool:
    return isinstance(df.select(mask.alias("m")).schema["m"].dataType, T.BooleanType)


def select_recycled(df: DataFrame, mask: list[int]) -> DataFrame:
    """Rows by a short literal mask that repeats."""
    return df.filter(F.get(F.array(*(F.lit(m) for m in mask)), (F.col(RID) % len(mask)).cast("int")) != 0)


def choose(df: DataFrame, index: DataFrame, column: str = "idx") -> DataFrame:
    """Rows gathered by 0-based index, in the order (ordinal) of ``index``, repeats included."""
    at = index.select(F.col(RID).alias("_pos"), F.col(column).cast("long").alias(RID))
    return at.join(df, RID).drop(RID).withColumnRenamed("_pos", RID)


permute = choose


def sort(df: DataFrame, *keys: str) -> DataFrame:
    """Rows renumbered in ascending order of the keys, ties by the old ordinal."""
    return with_rid(df.withColumnRenamed(RID, "_old"), *keys, "_old").drop("_old")


def topk(df: DataFrame, n: int, *keys: Column | str) -> DataFrame:
    return df.orderBy(*keys).limit(n)


def lists_to_columns(df: DataFrame, column: str, n: int) -> DataFrame:
    """Sublists of a list of lists as columns list0, list1 ..., one row per position."""
    wide = df.select(*(F.get(F.col(column), F.lit(i)).alias(f"list{i}") for i in range(n)))
    return wide.select(F.posexplode(F.arrays_zip(*wide.columns))).select(F.col("pos").cast("long").alias(RID), "col.*")


def distinct(df: DataFrame, *names: str) -> DataFrame:
    return df.select(*names).distinct() if names else df.drop(RID).distinct()


def dump(df: DataFrame, path: str, sep: str = "\t", header: bool = True, rows: Column | None = None, names: list[str] | None = None) -> None:
    """Rows in order as text, under a mask and for chosen columns if given; lists as JSON."""
    out = df.filter(rows) if rows is not None else df
    kept = names or columns(df)
    made = [F.to_json(F.col(f"`{c}`")).alias(c) if isinstance(df.schema[c].dataType, T.ArrayType) else F.col(f"`{c}`") for c in kept]
    out = out.orderBy(RID) if RID in out.columns else out
    out.select(*made).write.mode("overwrite").option("header", header).option("sep", sep).csv(path)


def matrix_rows(df: DataFrame, column: str) -> DataFrame:
    """A list of lists as (i, j, v) rows."""
    rows = df.select(RID, F.posexplode(column).alias("i", "row")) if RID in df.columns else df.select(F.posexplode(column).alias("i", "row"))
    return rows.select(*([RID] if RID in df.columns else []), "i", F.posexplode("row").alias("j", "v"))


def formatted(df: DataFrame, formats: dict[str, str]) -> DataFrame:
    """Columns printed by a format per type name (as ``int`` or ``double``) or column name."""
    made = []
    for f in df.schema:
        form = formats.get(f.name) or formats.get(f.dataType.simpleString())
        made.append(F.format_string(form, F.col(f"`{f.name}`")).alias(f.name) if form else F.col(f"`{f.name}`"))
    return df.select(*made)
