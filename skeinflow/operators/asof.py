"""As-of lookups of events: one builder for all variants.

Lookups and events of a key go into one sorted stream and the nearest event is filled along it, so a lookup costs a sort and
never the square of a key's events.  ``before`` and ``after`` are strict; the ``or_at`` forms include equal times.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DIRECTIONS = ("before", "at_or_before", "at", "at_or_after", "after")


def asof(
    lookups: DataFrame, events: DataFrame, keys: list[str], time: str, order: str, direction: str, carry: list[str],
    having: Column | None = None, event_time: str | None = None, prefix: str = "e_",
) -> DataFrame:
    """Each lookup row with the ``carry`` columns of its event, null where there is none.

    ``order`` breaks ties between events of equal time, the first one being nearest ahead and the last one behind;
    ``having`` restricts the events (with data d: ``F.col('d') == x``; without: ``!=``).
    """
    if direction not in DIRECTIONS:
        raise ValueError(f"direction is one of {DIRECTIONS}")
    events = events.where(having) if having is not None else events
    event_time = event_time or time
    names = [f"{prefix}{c}" for c in carry]
    found = events.select(*keys, F.col(event_time).alias("_t"), F.col(order).alias("_o"), F.struct(*(F.col(c).alias(n) for c, n in zip(carry, names, strict=True))).alias("_e"))
    if direction == "at":
        first = found.groupBy(*keys, "_t").agg(F.min_by("_e", "_o").alias("_e"))
        return lookups.join(first.withColumnRenamed("_t", time), [*keys, time], "left").select(*lookups.columns, *(F.col("_e")[n].alias(n) for n in names))
    back = direction in ("before", "at_or_before")
    # Where equal times count, the event must come first in the direction of the fill.
    event_first = direction in ("at_or_before", "after")
    row = F.struct(*(F.col(c) for c in lookups.columns))
    left = lookups.select(*keys, F.col(time).alias("_t"), F.lit(1 if event_first else -1).alias("_side"), F.lit(None).cast(found.schema["_o"].dataType).alias("_o"), row.alias("_row"), F.lit(None).cast(found.schema["_e"].dataType).alias("_e"))
    right = found.select(*keys, "_t", F.lit(0).alias("_side"), "_o", F.lit(None).cast(left.schema["_row"].dataType).alias("_row"), "_e")
    # Looking ahead is looking back along the reversed stream: a frame that runs on from the current row to the end would be
    # read anew for each row, the square of a key's rows.
    order_by = [F.col(c).asc() if back else F.col(c).desc() for c in ("_t", "_side", "_o")]
    w = Window.partitionBy(*keys).orderBy(*order_by).rowsBetween(Window.unboundedPreceding, 0)
    out = left.union(right).withColumn("_near", F.last("_e", ignorenulls=True).over(w)).where("_row IS NOT NULL")
    return out.select("_row.*", *(F.col("_near")[n].alias(n) for n in names))


def event_data(events: DataFrame, tag: Column, *columns: str) -> DataFrame:
    """Parameters or times of all events of a tag."""
    return events.where(tag).select(*columns)


def first_with_data(events: DataFrame, keys: list[str], time: str, order: str, having: Column) -> DataFrame:
    """Time of the first event with given data, per key."""
    return events.where(having).groupBy(*keys).agg(F.min(F.struct(F.col(time).alias("t"), F.col(order).alias("o")))["t"].alias(time))


def tag_id(names: DataFrame, name: str) -> DataFrame:
    """Ids of a tag by name, whatever its case; -1 if unknown."""
    hit = names.where(F.lower("name") == name.lower()).agg(F.min("id").alias("id"))
    return hit.select(F.coalesce("id", F.lit(-1)).alias("id"))


def in_window(times: Column, start: Column, stop: Column, offset: Column) -> Column:
    """Times in (start, stop], less the offset, of a list column."""
    return F.transform(F.filter(times, lambda t: (t > start) & (t <= stop)), lambda t: t - offset)


def baseline_subtracted(samples: Column, start: Column, stop: Column, base_start: Column, base_stop: Column) -> Column:
    """Samples [start, stop) of a list less the mean of [base_start, base_stop)."""
    base = F.slice(samples, base_start + 1, base_stop - base_start)
    n = F.greatest(F.size(base), F.lit(1))
    mean = F.aggregate(base, F.lit(0.0), lambda acc, x: acc + x) / n
    return F.transform(F.slice(samples, start + 1, stop - start), lambda x: x - mean)
