"""Mixing sources to target weights with Sainte-Lague apportionment, in DataFrame operations only.

Sizes are words.  Targets share 150 % of all words by weight; a target stops at twice its source's size and the excess is
shared again, which is the water level of a sorted prefix sum.  The mix is cut into blocks of equal length.  Blocks go to
sources, and each source's to its shards, by highest quotients weight / (2 k - 1): only quotients near the border are
listed, in a range that provably holds it, so the work is in the number of sources and shards and not of blocks.

A shard lays its documents end to end in a seeded order.  Its quota is a number of whole passes and a seeded run of
consecutive blocks; a document gives its words in these.  Shards are by hash, so that a large source has many small ones; a
source of few words has fewer, so that each holds several blocks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skeinflow.llm.common import stage

WEIGHTS = (5, 2, 1)
SHARE_PERCENT, MOST_TIMES = 150, 2
#: Rows of all sources for which there is one more shard of each source, and the most shards of a source.
SHARD_ROWS, MOST_SHARDS = 256, 4096
#: Blocks that the smallest source, and a shard of mean size, hold at least if a block of one word allows it.
BLOCKS = 64
#: Blocks that a shard of mean size of any source holds at least, if its source holds as many: else it has fewer shards.
SHARD_BLOCKS = 16
SEED = "mix-1"
WORD = r"[^\x20\x09-\x0D]+"


def targets(sources: DataFrame) -> DataFrame:
    """(source, source_size) -> also idx by code point (null last), weight and target."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    out = sources.withColumn("idx", F.row_number().over(by_name))
    weight = F.element_at(F.array(*(F.lit(w) for w in WEIGHTS)), (F.col("idx") - 1) % len(WEIGHTS) + 1)
    out = out.withColumn("weight", weight).withColumn("cap", MOST_TIMES * F.col("source_size"))
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), "idx")
    everything = Window.partitionBy()
    out = out.withColumn("spent", F.coalesce(F.sum("cap").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    out = out.withColumn("heft", F.sum("weight").over(by_ratio.rowsBetween(0, Window.unboundedFollowing)))
    total = F.sum("source_size").over(everything) * (SHARE_PERCENT / 100)
    out = out.withColumn("level", (total - F.col("spent")) / F.col("heft"))
    fits = F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct(F.col("cap") / F.col("weight"), "idx", "level"))
    out = out.withColumn("level", F.min(fits).over(everything)["level"])
    target = F.least(F.col("cap").cast("double"), F.col("weight") * F.col("level"))
    return out.withColumn("target", F.coalesce(target, F.col("cap").cast("double"))).select("source", "source_size", "idx", "weight", "target")


def apportion(shares: DataFrame, group: list[str], ident: str, share: str, seats: str) -> DataFrame:
    """``shares`` with ``quota``: the ``seats`` of each group dealt by highest quotients share / (2 k - 1).

    ``seats`` is the same all over a group.  Ties go to the lower ``ident``; a share of 0 gets none.
    """
    within = Window.partitionBy(*group)
    df = shares.withColumn("_n", F.sum(F.when(F.col(share) > 0, 1).otherwise(0)).over(within))
    df = df.withColumn("_q", F.when(F.col(share) > 0, F.col(seats) * (F.col(share) / F.sum(share).over(within))).otherwise(0.0))
    # A divisor exists for which rounding gives all seats; it is off by at most n / 2 seats in all.
    slack = 1 + F.ceil(F.coalesce(F.col("_q") / F.when(F.col(seats) > 0, F.col(seats)), F.lit(0.0)) * F.col("_n") / 2 + 0.5)
    df = df.withColumn("_slack", slack.cast("long"))
    df = df.withColumn("_base", F.greatest(F.lit(0), F.floor("_q") - F.col("_slack")).cast("long"))
    df = df.withColumn("_left", F.col(seats) - F.sum("_base").over(within))
    some = F.when(F.col(share) > 0, F.sequence(F.lit(1).cast("long"), 2 * F.col("_slack") + 2)).otherwise(F.array(F.lit(None).cast("long")))
    listed = df.withColumn("_k", F.explode(some))
    quotient = F.col(share) / (2 * (F.col("_base") + F.col("_k")) - 1)
    order = Window.partitionBy(*group).orderBy(quotient.desc_nulls_last(), ident, "_k")
    won = F.when(F.col("_k").isNotNull() & (F.row_number().over(order) <= F.col("_left")), 1).otherwise(0)
    keys = [*group, ident]
    listed = listed.withColumn("_won", won).groupBy(*keys).agg(F.first("_base").alias("_base"), F.sum("_won").alias("_won"))
    quota = listed.select(*keys, (F.col("_base") + F.col("_won")).alias("quota"))
    return shares.join(quota, keys)


def _hash_part(c: Column, at: int) -> Column:
    """An integer of 7 hexadecimal digits of a digest."""
    return F.conv(F.substring(c, at, 7), 16, 10).cast("long")


def _parts(docs: DataFrame) -> DataFrame:
    """docs with a row number of its own parts: idx of the source, shard, place, quota and the run taken."""
    sized = docs.withColumn("size", F.coalesce(F.regexp_count("text", F.lit(WORD)).cast("long"), F.lit(0).cast("long")))
    sized = sized.withColumn("key", F.md5(F.concat(F.lit(SEED), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))))
    sized = sized.withColumn("tie", F.xxhash64("text")).drop("text")
    sized = stage(sized, "sized")
    shards = min(max(-(-sized.count() // SHARD_ROWS), 1), MOST_SHARDS)
    goals = stage(targets(sized.groupBy("source").agg(F.sum("size").alias("source_size"))), "goals")

    least = F.min(F.when(F.col("source_size") > 0, F.col("source_size"))) / BLOCKS
    mean = F.sum("source_size") / (F.count("*") * shards * BLOCKS)
    block = F.greatest(F.lit(1), F.floor(F.least(least, mean))).cast("long")
    scale = goals.agg(F.coalesce(block, F.lit(1).cast("long")).alias("block"), F.sum("target").alias("all_targets"))
    # The cap of a shard cuts off parts of a block: little where it holds several, nearly all where it is less than one.
    mine = F.least(F.lit(shards), F.greatest(F.lit(1), F.floor(F.col("source_size") / (SHARD_BLOCKS * F.col("block")))))
    goals_named = goals.crossJoin(scale).select(F.col("source").alias("goal"), "idx", "source_size", "target", mine.cast("long").alias("shards"))
    sized = sized.join(goals_named, F.col("source").eqNullSafe(F.col("goal"))).drop("goal")
    sized = sized.withColumn("shard", _hash_part(F.col("key"), 1) % F.col("shards")).drop("shards")

    seats = goals.crossJoin(scale).withColumn("blocks", F.floor(F.col("all_targets") / F.col("block")).cast("long"))
    seats = apportion(seats, [], "idx", "target", "blocks").select("idx", "block", F.col("quota").alias("seats"))
    pieces = sized.groupBy("idx", "shard").agg(F.sum("size").alias("shard_size")).join(seats, "idx")
    quotas = apportion(pieces, ["idx"], "shard", "shard_size", "seats").select("idx", "shard", "shard_size", "block", "quota")
    quotas = stage(quotas, "quotas")

    placed = sized.join(quotas, ["idx", "shard"])
    line = Window.partitionBy("idx", "shard").orderBy("key", "doc_id", "size", "tie").rowsBetween(Window.unboundedPreceding, -1)
    placed = placed.withColumn("start", F.coalesce(F.sum("size").over(line), F.lit(0).cast("long")))
    words = F.least(F.col("quota") * F.col("block"), MOST_TIMES * F.col("shard_size"))
    placed = placed.withColumn("passes", F.when(F.col("shard_size") > 0, F.floor(words / F.col("shard_size"))).otherwise(0).cast("long"))
    placed = placed.withColumn("rest", (words - F.col("passes") * F.col("shard_size")).cast("long"))
    seed = F.md5(F.concat_ws("/", F.lit(SEED), F.col("idx").cast("string"), F.col("shard").cast("string")))
    first = _hash_part(seed, 1) % F.greatest(F.ceil(F.col("shard_size") / F.col("block")).cast("long"), F.lit(1).cast("long")) * F.col("block")
    placed = placed.withColumn("first", first)

    def lap(turn: Column) -> tuple[Column, Column]:
        lo = F.greatest(F.col("start"), F.col("first") - turn)
        hi = F.least(F.col("start") + F.col("size"), F.col("first") + F.col("rest") - turn)
        lo = F.least(F.greatest(lo - F.col("start"), F.lit(0)), F.col("size"))
        return lo, F.greatest(F.least(hi - F.col("start"), F.col("size")), lo)

    (lo1, hi1), (lo2, hi2) = lap(F.lit(0)), lap(F.col("shard_size"))
    placed = placed.withColumns({"lo1": lo1, "hi1": hi1, "lo2": lo2, "hi2": hi2})
    taken = F.col("passes") * F.col("size") + F.col("hi1") - F.col("lo1") + F.col("hi2") - F.col("lo2")
    return placed.withColumn("taken", taken.cast("long"))


def mix(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target (of its source) and taken: the words that the mix takes, repeats counted.

    Null texts have size 0 and a null source is a source, after all others.  No document gives more than twice its size.
    The order is by a digest of seed and doc_id, so reruns agree; repeated rows are told apart by size and text hash, and
    where these agree too, share between them.  An empty table gives no rows; other columns are not looked at.
    """
    rows = docs.select("doc_id", F.col("source").cast("string").alias("source"), F.col("text").cast("string").alias("text"))
    return _parts(rows).select("doc_id", "size", "source_size", "target", "taken")


def mix_documents(docs: DataFrame) -> DataFrame:
    """The mix itself, with the columns of ``docs``: a document taken whole comes once for each pass, text unchanged; one
    taken in part comes with these words, joined by one space (and n_chars, where there is such a column, of them).

    Null texts and texts without words are never taken.  Ids may be of any type, null or repeated: rows that agree in id, text and
    source are interchangeable and each has its own part in the plan.  Very long texts are cut whole.  An empty table gives no
    rows; extra columns of any names come through unchanged.
    """
    held = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), "doc_id", F.col("source").cast("string").alias("source"), F.col("text").cast("string").alias("text"))
    plan = _parts(held.select("doc_id", "source", "text")).where("taken > 0")
    plan = plan.select("doc_id", "source", "tie", "passes", "size", "lo1", "hi1", "lo2", "hi2").toDF("_id", "_source", "_tie", "passes", "size", "lo1", "hi1", "lo2", "hi2")
    # Rows that agree in id, source and text are interchangeable: number them on both sides.
    same = Window.partitionBy("_id", "_source", "_tie").orderBy("passes", "lo1", "hi1", "lo2", "hi2")
    plan = plan.withColumn("_nth", F.row_number().over(same))
    here = held.withColumn("_tie2", F.xxhash64("text"))
    here = here.withColumn("_nth2", F.row_number().over(Window.partitionBy("doc_id", "source", "_tie2").orderBy("source")))
    got = here.join(plan, here["doc_id"].eqNullSafe(plan["_id"]) & here["source"].eqNullSafe(plan["_source"]) & (here["_tie2"] == plan["_tie"]) & (here["_nth2"] == plan["_nth"]))
    whole = F.transform(F.sequence(F.lit(1), F.col("passes").cast("int")), lambda _: F.struct(F.lit(0).cast("long").alias("lo"), F.col("size").alias("hi")))
    whole = F.when(F.col("passes") > 0, whole).otherwise(F.array().cast("array<struct<lo:bigint,hi:bigint>>"))
    parts = F.array(F.struct(F.col("lo1").alias("lo"), F.col("hi1").alias("hi")), F.struct(F.col("lo2").alias("lo"), F.col("hi2").alias("hi")))
    parts = F.filter(F.concat(whole, parts), lambda p: p["hi"] > p["lo"])
    got = got.withColumn("part", F.explode(parts))
    some = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(WORD), F.lit(0)), (F.col("part.lo") + 1).cast("int"), (F.col("part.hi") - F.col("part.lo")).cast("int")), " ")
    got = got.withColumn("_text", F.when(F.col("part.hi") - F.col("part.lo") == F.col("size"), F.col("text")).otherwise(some))
    made = {"text": F.col("_text").cast(docs.schema["text"].dataType)}
    if "n_chars" in docs.columns:
        made["n_chars"] = F.char_length("_text").cast(docs.schema["n_chars"].dataType)
    return got.select(*(made.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns))


#: DuckDB SQL for the same rows.
ORACLE = r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
    md5('mix-1' || coalesce(doc_id::VARCHAR, '')) AS k,
    (SELECT least(greatest((count(*) + 255) // 256, 1), 4096) FROM documents) AS shards
  FROM documents),
totals AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
ranked AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS idx FROM totals),
weighted AS (SELECT *, CASE (idx - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight, 2 * source_size AS cap FROM ranked),
levels AS (
  SELECT *, ((sum(source_size) OVER ())::DOUBLE * 1.5 - coalesce(sum(cap) OVER (ORDER BY cap / weight, idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
    / (sum(weight) OVER (ORDER BY cap / weight, idx ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS level FROM weighted),
water AS (SELECT arg_min(level, cap / weight) AS level FROM levels WHERE level * weight <= cap),
goals AS (SELECT source, source_size, idx, least(cap::DOUBLE, weight * water.level) AS target FROM levels, water),
scale AS (
  SELECT greatest(1, floor(least(min(CASE WHEN source_size > 0 THEN source_size END) / 64.0, sum(source_size)::DOUBLE / (count(*) * any_value(shards) * 64))))::BIGINT AS block,
    sum(target) AS all_targets, count(*) AS n FROM goals, (SELECT any_value(shards) AS shards FROM sized)),
seat_list AS (SELECT idx, k, row_number() OVER (ORDER BY target / (2 * k - 1) DESC, idx, k) AS place, floor(all_targets / block)::BIGINT AS blocks
  FROM goals, scale, LATERAL (SELECT unnest(generate_series(1, (target / block)::BIGINT + n + 3)) AS k)),
seats AS (SELECT idx, count(*) FILTER (place <= blocks) AS seats FROM seat_list GROUP BY idx),
pieces AS (SELECT g.idx, ('0x' || substr(k, 1, 7))::BIGINT % shards AS shard, sum(size)::BIGINT AS shard_size
  FROM sized s JOIN goals g ON s.source IS NOT DISTINCT FROM g.source GROUP BY ALL),
spread AS (SELECT p.*, seats, block, count(*) OVER (PARTITION BY idx) AS n, sum(shard_size) OVER (PARTITION BY idx) AS whole FROM pieces p JOIN seats USING (idx), scale),
quota_list AS (SELECT idx, shard, row_number() OVER (PARTITION BY idx ORDER BY shard_size::DOUBLE / (2 * k - 1) DESC, shard, k) AS place, seats
  FROM spread, LATERAL (SELECT unnest(generate_series(1, (seats * shard_size / whole)::BIGINT + n + 3)) AS k)),
quotas AS (SELECT idx, shard, count(*) FILTER (place <= seats) AS quota FROM quota_list GROUP BY ALL),
placed AS (
  SELECT s.doc_id, s.size, g.source_size, g.target, p.shard_size, p.block,
    coalesce(sum(s.size) OVER (PARTITION BY g.idx, p.shard ORDER BY s.k, s.doc_id, s.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start,
    least(q.quota * p.block, 2 * p.shard_size)::BIGINT AS words,
    ('0x' || substr(md5('mix-1/' || g.idx || '/' || p.shard), 1, 7))::BIGINT % greatest(ceil(p.shard_size::DOUBLE / p.block)::BIGINT, 1) * p.block AS first
  FROM sized s JOIN goals g ON s.source IS NOT DISTINCT FROM g.source
  JOIN spread p ON p.idx = g.idx AND p.shard = ('0x' || substr(s.k, 1, 7))::BIGINT % s.shards
  JOIN quotas q ON q.idx = p.idx AND q.shard = p.shard),
runs AS (SELECT *, words // shard_size AS passes, words % shard_size AS rest FROM placed)
SELECT doc_id, size::BIGINT AS size, source_size, target,
  (passes * size + greatest(least(start + size, first + rest) - greatest(start, first), 0)
    + greatest(least(start + size, first + rest - shard_size) - greatest(start, first - shard_size), 0))::BIGINT AS taken
FROM runs
"""
