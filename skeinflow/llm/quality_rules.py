"""Quality rules: counts that reject plainly bad texts, then language-specific bands of n-gram perplexity.

The language model is over characters, in n-grams of up to ORDER: code points by their low 16 bits, white space as one, two
values of their own for the start of a text and for none.  An n-gram is thus a 64-bit code whose context and shorter forms are
shifts and masks of it.  Tasks count n-grams of every document in numpy, a hash aggregate sums; continuation counts, discounts,
context totals and the mass that a context leaves to the shorter n-gram (modified Kneser-Ney) are DataFrame aggregates in whole
numbers, so reruns agree to the bit.  Every n-gram of every language is kept.  As all texts that are scored have been counted, joins
give the bits of each of the longest n-grams, in a written table.  The MOST most frequent ones of a language go to arrays sorted by
the hash of the n-gram, which scoring searches for the distinct n-grams of each slice of text; what is not there is listed
beside the text and joined with the table, so the arrays save work and decide nothing.  The arrays of the most frequent languages
are broadcast, and are of bounded size (LANGUAGES times MOST entries of 12 bytes at most).  Those of all further languages,
however many, are written; their documents are dealt by language, in parts of some thousands, and each part meets its language's
arrays in a sorted stream.  Bits are added up in whole numbers of 1 / UNIT.

Perplexity is taken twice, as bits per symbol and bits per word: marks strung behind each word are easy to foresee one by one, so
they hardly show in the first, but a word with them takes more bits than one without; and the other way round for words run
together.  A language has a band of each: the median and BAND times the median absolute deviation either side, from a histogram
over all documents that pass the counts, in thousandths of a bit.  That width is for texts of TYPICAL words; as the mean of
a longer text varies less, the bands narrow with the square root of the length, within NARROW and WIDE times.  A text is kept if it
is inside both bands.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skeinflow.llm import kernels as K
from skeinflow.llm.common import drop_stage, stage, stage_alone

ORDER = 4
#: Symbols that stand for the start of a text and, as a leading part of a code, for no symbol.
START, NONE = 1, 0
#: Of the longest n-grams of a language, how many are in its arrays at most (the more frequent ones; the others are joined).
MOST = 1 << 18
#: Parts of a bit in which bits are added up.
UNIT = 1 << 20
#: Languages (null being one) whose models are broadcast, the most frequent ones, and rows of the others in a part.
LANGUAGES = 16
PART_ROWS = 4096
#: Distinct n-grams that a task holds before it passes them on.
HELD = 1 << 21
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
#: Half-width of a band in median absolute deviations, and its least half-width in thousandths of a bit, per symbol and per word.
BAND, LEAST = 7.0, (60, 300)
TYPICAL, NARROW, WIDE = 200, 0.35, 2.0

_MARKS = np.zeros(256, dtype=bool)
_MARKS[list(b"#*$%&|<>")] = True
_NEWLINE = np.zeros(256, dtype=bool)
_NEWLINE[10] = True
_16 = np.uint64(16)


def symbols(t: K.Texts) -> tuple[np.ndarray, np.ndarray]:
    """Symbol of every code point, and the index of each row's first."""
    at = np.flatnonzero((t.data & 0xC0) != 0x80)
    lead = t.data[at]
    s = lead.astype(np.uint32)
    s[K.SEPARATOR[lead]] = 32
    for low, size, mask in ((0xC0, 2, 0x1F), (0xE0, 3, 0x0F), (0xF0, 4, 0x07)):
        some = np.flatnonzero((lead >= low) & (lead < low + (0x20 >> (size - 2))))
        if len(some):
            value = lead[some].astype(np.uint32) & mask
            for k in range(1, size):
                value = (value << 6) | (t.data[np.minimum(at[some] + k, len(t.data) - 1)] & 0x3F)
            s[some] = value
    s = (s & 0xFFFF).astype(np.uint64)
    s[s <= START] = 2
    return s, np.searchsorted(at, t.offsets)


def ngrams(s: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Code of the n-gram that ends at each symbol, starts of the text before each row."""
    place = np.arange(len(s)) - np.repeat(first[:-1], np.diff(first))
    code = s.copy()
    for back in range(1, ORDER):
        earlier = np.full(len(s), START, dtype=np.uint64)
        earlier[back:] = s[:-back]
        earlier[place < back] = START
        code |= earlier << (_16 * np.uint64(back))
    return code


def shorter(code: np.ndarray, order: int) -> np.ndarray:
    """The last ``order`` symbols."""
    return code & np.uint64((1 << (16 * order)) - 1)


def ngram_key(code: np.ndarray) -> np.ndarray:
    return K.mix(code)


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    code, where = np.unique(np.concatenate([c for c, _ in parts]), return_inverse=True)
    return code, np.bincount(where, np.concatenate([n for _, n in parts]), len(code)).astype(np.int64)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """N-grams of each group; a task passes on what it holds whenever that is much."""
    held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
    size = 0

    def out() -> Iterator[pa.RecordBatch]:
        for g, parts in held.items():
            code, n = _merged(parts)
            for lo in range(0, len(code), 1 << 16):
                some = slice(lo, lo + (1 << 16))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(code[some]), g)), pa.array(K.signed(code[some])), pa.array(n[some])], ["grp", "code", "n"])

    for batch in batches:
        group = batch.column("grp").to_numpy()
        for t in K.texts(batch.column("text")):
            s, first = symbols(t)
            code = ngrams(s, first)
            of = np.repeat(group[t.lo : t.hi], np.diff(first))
            for g in np.unique(of).tolist():
                parts = held.setdefault(g, [])
                parts.append(np.unique(code[of == g], return_counts=True))
                if sum(len(c) for c, _ in parts) > 4 * len(parts[0][0]) + (1 << 16):
                    held[g] = [_merged(parts)]
            size = sum(len(c) for parts in held.values() for c, _ in parts)
            if size > HELD:
                yield from out()
                held = {}
    yield from out()


def _discount(k: int) -> Column:
    """Discount of a count of k (3: or more), from the numbers of n-grams seen once to four times."""
    n1, n2, n3, n4 = (F.col(f"n{i}") for i in (1, 2, 3, 4))
    y = n1 / (n1 + 2 * n2)
    value, plain, most = {1: (1 - 2 * y * n2 / n1, 0.5, 0.99), 2: (2 - 3 * y * n3 / n2, 0.75, 1.99), 3: (3 - 4 * y * n4 / n3, 0.9, 2.99)}[k]
    return F.when((n1 > 0) & (n2 > 0) & (n3 > 0) & (n4 > 0), F.least(F.greatest(value, F.lit(0.01)), F.lit(most))).otherwise(F.lit(plain))


def _least_counts(counts: DataFrame, by: list[str], most: int) -> DataFrame:
    """``by`` and cut: the least n with which at most ``most`` rows have that or more (no row where even the greatest has more)."""
    ranks = counts.groupBy(*by, "n").agg(F.count("*").alias("c"))
    down = Window.partitionBy(*by).orderBy(F.desc("n")).rowsBetween(Window.unboundedPreceding, 0)
    return ranks.withColumn("upto", F.sum("c").over(down)).where(F.col("upto") <= most).groupBy(*by).agg(F.min("n").alias("cut"))


def kneser_ney(counts: DataFrame, most: int | None = None) -> DataFrame:
    """Counts (grp, code, n) of the longest n-grams -> (grp, kind, code, value, ord): kind 0 has the discounted share of an n-gram in
    its context, kind 1 the mass that a context leaves to the shorter n-gram (1 where it isn't listed).  With ``most``, only so many
    n-grams of an order are listed (symbols all), and what the others had goes to the mass left; the query lists all."""
    longer = counts.select("grp", F.lit(ORDER).alias("ord"), "code", "n")
    grams = longer
    for order in range(ORDER - 1, 0, -1):
        mask = F.lit((1 << (16 * order)) - 1)
        longer = longer.groupBy("grp", F.col("code").bitwiseAND(mask).alias("code")).agg(F.count("*").alias("n")).select("grp", F.lit(order).alias("ord"), "code", "n")
        grams = grams.union(longer)
    grams = stage(grams.withColumn("ctx", F.shiftrightunsigned("code", 16)), "grams")
    seen = [F.sum((F.col("n") == k).cast("long")).alias(f"n{k}") for k in (1, 2, 3, 4)]
    rates = grams.groupBy("grp", "ord").agg(*seen).select("grp", "ord", *(_discount(k).alias(f"d{k}") for k in (1, 2, 3)))
    if most is None:
        rates = rates.withColumn("cut", F.lit(0))
    else:
        rates = rates.join(_least_counts(grams, ["grp", "ord"], most), ["grp", "ord"], "left").withColumn("cut", F.when(F.col("ord") == 1, 0).otherwise(F.col("cut")))
    rates = stage(rates, "rates")

    # Whole numbers until the last step, so that the order of summing does not matter.
    named = grams.join(rates, ["grp", "ord"]).withColumn("kept", F.coalesce(F.col("n") >= F.col("cut"), F.lit(False)))
    by_size = [F.sum(F.when(F.col("kept") & (F.least("n", F.lit(3)) == k), 1).otherwise(0)).alias(f"k{k}") for k in (1, 2, 3)]
    contexts = named.groupBy("grp", "ord", "ctx").agg(F.sum("n").alias("total"), F.sum(F.when(F.col("kept"), F.col("n")).otherwise(0)).alias("here"), *by_size)
    contexts = stage(contexts, "contexts")
    d = F.when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3"))
    shares = named.where("kept").join(contexts.select("grp", "ord", "ctx", "total"), ["grp", "ord", "ctx"])
    shares = shares.select("grp", F.lit(0).alias("kind"), "code", ((F.col("n") - d) / F.col("total")).cast("float").alias("value"), "ord")
    off = F.col("k1") * F.col("d1") + F.col("k2") * F.col("d2") + F.col("k3") * F.col("d3")
    left = contexts.where("here > 0").join(rates, ["grp", "ord"])
    left = left.select("grp", F.lit(1).alias("kind"), F.col("ctx").alias("code"), (1 - (F.col("here") - off) / F.col("total")).cast("float").alias("value"), "ord")
    return shares.union(left)


def ngram_bits(counts: DataFrame) -> DataFrame:
    """(grp, code, n, value): bits of the last symbol of every one of the longest n-grams after the others."""
    entries = stage(kneser_ney(counts), "entries")
    found = None
    for order in range(1, ORDER + 1):
        grams = entries.where((F.col("kind") == 0) & (F.col("ord") == order)).select("grp", "code", F.col("value").alias("share"), F.shiftrightunsigned("code", 16).alias("ctx"))
        left = entries.where((F.col("kind") == 1) & (F.col("ord") == order)).select("grp", F.col("code").alias("ctx"), F.col("value").alias("left"))
        grams = grams.join(left, ["grp", "ctx"])
        if found is None:
            grams = grams.withColumn("below", F.lit(1 / (1 << 16)))
        else:
            grams = grams.withColumn("less", F.col("code").bitwiseAND(F.lit((1 << (16 * (order - 1))) - 1)))
            grams = grams.join(found.select("grp", F.col("code").alias("less"), F.col("p").alias("below")), ["grp", "less"])
        found = grams.select("grp", "code", (F.col("left").cast("double") * F.col("below") + F.col("share").cast("double")).alias("p"))
    value = (-F.log2(F.greatest("p", F.lit(2.0**-40)))).cast("float")
    return found.join(counts, ["grp", "code"]).select("grp", "code", "n", value.alias("value"))


_ARRAYS = ("share_key", "share", "left_key", "left")
_KINDS = ("u8", "f4", "u8", "f4")


def _packed(t: pa.Table) -> pa.Table:
    """The sorted arrays of one language."""
    kind, code, value = (t.column(c).to_numpy() for c in ("kind", "code", "value"))
    out: dict[str, list] = {"grp": t.column("grp")[:1]}
    for k, names in ((0, _ARRAYS[:2]), (1, _ARRAYS[2:])):
        key = ngram_key(code[kind == k].view(np.uint64))
        order = np.argsort(key)
        out |= {names[0]: [key[order].tobytes()], names[1]: [value[kind == k][order].tobytes()]}
    return pa.table(out)


def _arrays(packed: tuple[bytes, ...]) -> tuple[np.ndarray, ...]:
    return tuple(np.frombuffer(a, dtype=d) for a, d in zip(packed, _KINDS, strict=True))


def _look(key: np.ndarray, value: np.ndarray, code: np.ndarray, missing: float) -> np.ndarray:
    """Values of codes by binary search."""
    if not len(key):
        return np.full(len(code), missing)
    at = np.minimum(np.searchsorted(key, k := ngram_key(code)), len(key) - 1)
    return np.where(key[at] == k, value[at].astype(np.float64), missing)


def bits(arrays: tuple[np.ndarray, ...], code: np.ndarray) -> np.ndarray:
    """Bits of the last symbol of each n-gram after the others, by looking up n-grams of all orders and their contexts."""
    share_key, share, left_key, left = arrays
    p = np.full(len(code), 1 / (1 << 16))
    for order in range(1, ORDER + 1):
        here = shorter(code, order)
        p = _look(left_key, left, here >> _16, 1.0) * p + _look(share_key, share, here, 0.0)
    return -np.log2(np.maximum(p, 2.0**-40))


@dataclass
class Model:
    """Groups (hashes of languages) whose arrays are broadcast, those arrays, a table of the other groups' ones, and the bits of all
    n-grams where some are in no arrays."""

    common: list[int]
    arrays: object
    others: DataFrame | None = None
    table: DataFrame | None = None


def _grouped(docs: DataFrame) -> DataFrame:
    """Text and grp, a hash of the language (of its own for null), whatever the types of text and lang."""
    return docs.withColumns({"text": F.col("text").cast("string"), "grp": F.xxhash64(F.col("lang").cast("string"), F.col("lang").isNull())})


def fit(docs: DataFrame) -> Model:
    """Count n-grams over all ``docs`` and estimate the models."""
    spark = docs.sparkSession
    docs = _grouped(docs.select("text", "lang")).select("grp", "text")
    sizes = docs.groupBy("grp").count()
    ranked = [r["grp"] for r in sizes.orderBy(F.desc("count"), "grp").limit(LANGUAGES + 1).collect()]
    common = ranked[:LANGUAGES]
    counts = docs.mapInArrow(_count, "grp long, code long, n long").groupBy("grp", "code").agg(F.sum("n").alias("n"))
    table = stage_alone(lambda: ngram_bits(stage(counts, "counts")), "bits")
    beyond = not table.groupBy("grp").count().where(F.col("count") > MOST).isEmpty()
    entries = table.withColumn("kind", F.lit(0))
    if beyond:
        entries = stage(entries.join(_least_counts(table, ["grp"], MOST), "grp").where("n >= cut").drop("cut"), "entries")
    schema = "grp long, " + ", ".join(f"`{a}` binary" for a in _ARRAYS)
    is_common = F.col("grp").isin(common)
    packed = entries.where(is_common).groupBy("grp").applyInArrow(_packed, schema).collect()
    arrays = {r["grp"]: tuple(bytes(r[a]) for a in _ARRAYS) for r in packed}
    others = None
    if len(ranked) > LANGUAGES:
        rest = entries.where(~is_common).groupBy("grp").applyInArrow(_packed, schema)
        parts = sizes.where(~is_common).select("grp", F.ceil(F.col("count") / PART_ROWS).cast("int").alias("parts"))
        others = stage(parts.join(rest, "grp", "left"), "models")
    drop_stage(entries)
    return Model(common, spark.sparkContext.broadcast(arrays), others, table if beyond else None)


def _seeded(h: np.ndarray, rows: np.ndarray) -> np.ndarray:
    return K.mix(h ^ (rows.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))


def text_counts(t: K.Texts) -> list[np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of each row."""
    w = K.words(t)
    letters = ~K.SEPARATOR[t.data] & ((t.data & 0xC0) != 0x80)
    n_words = np.diff(w.first)
    lines = K.spans(t, _NEWLINE)
    filled = np.concatenate([[0], np.cumsum(~K.SEPARATOR[t.data])])
    with_word = filled[lines.end] > filled[lines.start]
    of = lines.rows()[with_word]
    keys = _seeded(K.span_hashes(t.data, lines.start[with_word], lines.end[with_word]), of)
    distinct = of[np.unique(keys, return_index=True)[1]]
    rows = len(n_words)
    dup = np.bincount(of, minlength=rows) - np.bincount(distinct, minlength=rows)
    start, of = K.window_starts(w.first, 3)
    if len(start):
        g = _seeded(K.window_hashes(K.span_hashes(t.data, w.start, w.end), 3)[start], of)
        order = np.argsort(g)
        same = g[order[1:]] == g[order[:-1]]
        again = np.zeros(len(g), dtype=bool)
        again[order[1:]] = same
        again[order[:-1]] |= same
        hit = start[again]
        size = len(w.start) + 1
        covered = np.cumsum(np.bincount(hit, minlength=size) - np.bincount(hit + 3, minlength=size)[:size])[:-1] > 0
        repeat = K.per_row(covered.astype(np.int64), w.first)
    else:
        repeat = np.zeros(rows, dtype=np.int64)
    sums = [K.per_row(x.astype(np.int64), t.offsets) for x in (letters, _MARKS[t.data])]
    return [n_words.astype(np.int64), *sums, dup.astype(np.int64), repeat]


_STATS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
_MILLI = ["symbol_milli", "word_milli"]
#: Of a text: symbols, parts of a bit of those n-grams that the arrays have, and the others.
_SUMS = {"symbols": "long", "units": "long", "rest": "array<long>"}


def _measured(batch: pa.RecordBatch, keep: list[str], arrays_of: Callable[[int], tuple[np.ndarray, ...] | None]) -> pa.RecordBatch:
    """``keep`` columns, counts, group and sums of a batch; ``arrays_of`` gives the arrays of a group."""
    stats: list[list[np.ndarray]] = []
    units, size, rest, rests = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)], [np.zeros(1, dtype=np.int64)]
    group = batch.column("grp").to_numpy()
    for t in K.texts(batch.column("text")):
        stats.append(text_counts(t))
        s, first = symbols(t)
        code = ngrams(s, first)
        mine = np.zeros(len(code), dtype=np.int64)
        of = np.repeat(group[t.lo : t.hi], np.diff(first))
        for g in np.unique(of).tolist():
            arrays = arrays_of(g)
            at = of == g
            distinct, where = np.unique(code[at], return_inverse=True)
            value = np.full(len(distinct), -1.0) if arrays is None else _look(*arrays[:2], distinct, -1.0)
            mine[at] = np.where(value < 0, -1, np.rint(value * UNIT)).astype(np.int64)[where]
        out = mine < 0
        mine[out] = 0
        units.append(K.per_row(mine, first))
        size.append(np.diff(first))
        rest.append(K.signed(code[out]))
        rests.append(K.per_row(out.astype(np.int64), first))
    columns = [pa.array(np.concatenate(x)) for x in zip(*stats, strict=True)] if stats else [pa.array([], pa.int64())] * 5
    lists = pa.ListArray.from_arrays(pa.array(np.cumsum(np.concatenate(rests)).astype(np.int32)), pa.array(np.concatenate(rest)))
    sums = [pa.array(np.concatenate(size)), pa.array(np.concatenate(units).astype(np.int64)), lists]
    return pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *columns, batch.column("grp"), *sums], [*keep, *_STATS, "grp", *_SUMS])


def _score(model: Model, keep: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = {g: _arrays(a) for g, a in model.arrays.value.items()}
        for batch in batches:
            yield _measured(batch, keep, found.get)

    return run


def _score_others(keep: list[str]):
    """Rows of one (group, part) come together, the model's first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrays = None
        for batch in batches:
            heads = np.flatnonzero(~batch.column("is_doc").to_numpy(zero_copy_only=False))
            for lo, hi in zip([0, *heads.tolist()], [*heads.tolist(), batch.num_rows], strict=True):
                if lo in heads and hi > lo:
                    packed = [batch.column(a)[lo] for a in _ARRAYS]
                    arrays = _arrays(tuple(a.as_buffer() for a in packed)) if packed[0].is_valid else None
                    lo += 1
                if hi > lo:
                    yield _measured(batch.slice(lo, hi - lo), keep, lambda g: arrays)  # noqa: B023

    return run


def _scores_others(rows: DataFrame, model: Model, kept: list[str], schema: str) -> DataFrame:
    sizes = model.others.select("grp", "parts")
    rows = rows.join(sizes, "grp").withColumn("part", F.pmod(F.xxhash64("text", *kept), F.col("parts")).cast("int"))
    none = [F.lit(None).cast("binary").alias(a) for a in _ARRAYS]
    rows = rows.select("grp", "part", F.lit(True).alias("is_doc"), *none, "text", *kept)
    heads = model.others.select("grp", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(False).alias("is_doc"), *_ARRAYS)
    heads = heads.select("*", *(F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in ("text", *kept)))
    dealt = heads.union(rows).repartition("grp", "part").sortWithinPartitions("grp", "part", "is_doc")
    return dealt.mapInArrow(_score_others(kept), schema)


def scores(docs: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """A written table of the ``keep`` columns of ``docs``, as k0, k1, ..., with the counts, base_failed, grp and thousandths of a bit
    per symbol and per word."""
    kept = [f"k{i}" for i in range(len(keep))]
    rows = _grouped(docs.select(*(F.col(f"`{c}`").alias(k) for c, k in zip(keep, kept, strict=True)), "text", "lang")).drop("lang")
    kinds = [rows.schema[k].dataType.simpleString() for k in kept]
    schema = ", ".join([*(f"{k} {t}" for k, t in zip(kept, kinds, strict=True)), *(f"{c} long" for c in _STATS), "grp long", *(f"{c} {t}" for c, t in _SUMS.items())])
    is_common = F.col("grp").isin(model.common)
    found = (rows if model.others is None else rows.where(is_common)).mapInArrow(_score(replace(model, others=None, table=None), kept), schema)
    if model.others is not None:
        found = found.union(_scores_others(rows.where(~is_common), model, kept, schema))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    found = found.withColumn("base_failed", failed)
    if model.table is None:
        found = stage(found.drop("rest"), "quality")
    else:
        found = stage(found.withColumn("key", F.monotonically_increasing_id()), "quality")
        asked = found.where(F.size("rest") > 0).select("key", "grp", F.explode("rest").alias("code"))
        table = model.table.select("grp", "code", F.rint(F.col("value").cast("double") * UNIT).cast("long").alias("more"))
        more = stage(asked.join(table, ["grp", "code"]).groupBy("key").agg(F.sum("more").alias("more")), "rest")
        found = found.drop("rest").join(more, "key", "left").withColumn("units", F.col("units") + F.coalesce("more", F.lit(0))).drop("key", "more")
    milli = [F.rint(1000 * F.col("units") / UNIT / F.greatest(n, F.lit(1))).cast("long").alias(c) for n, c in zip(("symbols", "n_words"), _MILLI, strict=True)]
    return found.select("*", *milli).drop("symbols", "units")


def _band(value: np.ndarray, weight: np.ndarray, least: float) -> tuple[int, float]:
    order = np.argsort(value)
    value, weight = value[order], weight[order]
    middle = value[np.searchsorted(np.cumsum(weight), weight.sum() / 2)]
    off = np.abs(value - middle)
    order = np.argsort(off, kind="stable")
    mad = off[order][np.searchsorted(np.cumsum(weight[order]), weight.sum() / 2)]
    return int(middle), float(max(BAND * mad, least))


def _bands(t: pa.Table) -> pa.Table:
    """Middle and half-width of the two bands of one language, from its histograms."""
    kind, value, weight = (t.column(c).to_numpy() for c in ("kind", "milli", "n"))
    out = {"grp": t.column("grp")[:1]}
    for k, name in enumerate(_MILLI):
        middle, half = _band(value[kind == k], weight[kind == k], LEAST[k])
        out |= {f"{name}_middle": [middle], f"{name}_half": [half]}
    return pa.table(out)


def verdict(scored: DataFrame) -> DataFrame:
    """``scored`` (of ``scores``) with ``kept``: inside both bands of its language, from all texts that pass the counts."""
    values = F.array(*(F.struct(F.lit(k).alias("kind"), F.col(c).alias("milli")) for k, c in enumerate(_MILLI)))
    hist = scored.where("NOT base_failed").select("grp", F.explode(values).alias("v")).groupBy("grp", "v.kind", "v.milli").agg(F.count("*").alias("n"))
    schema = "grp long, " + ", ".join(f"{c}_middle long, {c}_half double" for c in _MILLI)
    limits = stage(hist.groupBy("grp").applyInArrow(_bands, schema), "bands")
    scale = F.least(F.lit(WIDE), F.greatest(F.lit(NARROW), F.sqrt(TYPICAL / F.greatest("n_words", F.lit(1)))))
    inside = ~F.col("base_failed")
    for c in _MILLI:
        inside = inside & F.coalesce(F.abs(F.col(c) - F.col(f"{c}_middle")) <= F.col(f"{c}_half") * scale, F.lit(False))
    return scored.join(limits, "grp", "left").withColumn("kept", inside)


def quality(docs: DataFrame) -> DataFrame:
    """doc_id, the counts, base_failed, bits (per symbol), word_bits (per word) and kept, for every row of ``docs``.

    A null or empty text has no words: base_failed.  Every language has a model and a band of its own; a null lang has one too.
    Repeated rows are judged alike, whatever their ids, which may be of any type, null or repeated; very long texts are worked on
    whole, in memory of some 60 times the longest; a text at the border of a band is kept; an empty table gives no rows; other
    columns, whatever their names, are not looked at.
    """
    found = verdict(scores(docs, fit(docs), ["doc_id"]))
    return found.select(F.col("k0").alias("doc_id"), *_STATS, "base_failed", (F.col("symbol_milli") / 1000).alias("bits"), (F.col("word_milli") / 1000).alias("word_bits"), "kept")


def quality_filter(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the rules keep, all columns unchanged, whatever their names; all else is as in ``quality``.

    Texts are scored once: their rows are written with the scores, as the bands need all of these first.
    """
    kept = verdict(scores(docs, fit(docs), docs.columns)).where("kept")
    return kept.select(*(F.col(f"k{i}").alias(c) for i, c in enumerate(docs.columns)))


#: DuckDB SQL for the counts of op9's rows; the verdict of the bands has none.
COUNTS = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
c AS (SELECT doc_id, text, w, list_transform(generate_series(1, len(w) - 2), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) AS g,
  list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines FROM d),
e AS (SELECT row_number() OVER () AS r, * FROM c),
grams AS (SELECT r, unnest(g) AS x, unnest(generate_series(1, len(g))) AS i FROM e WHERE len(w) > 2),
again AS (SELECT r, i FROM grams QUALIFY count(*) OVER (PARTITION BY r, x) > 1),
covered AS (SELECT r, count(DISTINCT i + j) AS n FROM again, range(3) t(j) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
  (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
  coalesce(n, 0)::BIGINT AS n_repeat_words, len(w) < 50 OR 100 * coalesce(n, 0) > 50 * len(w) AS base_failed
FROM e LEFT JOIN covered USING (r)
"""
