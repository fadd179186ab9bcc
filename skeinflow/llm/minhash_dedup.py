"""MinHash near-duplicate detection: one-permutation hashing with optimal densification, banded buckets, star edges.

A document is the set of its distinct five-word shingles (A-Z lower-cased).  One pass hashes each set once, splits the hash
range into bins and keeps the least hash of each; an empty bin takes the value of the first filled bin in a fixed random
order of its own, so that equal sets fill alike.  Bins go in bands; documents that agree in a band share a bucket, and each
bucket links its members to its smallest member only, so candidates grow with the rows and not with their square.

Links are confirmed on full sets.  A star may miss a pair of members that resemble each other but not the centre.  Where the
members of a centre are left in several components, the smallest one outside the centre's component becomes their next centre,
for ROUNDS rounds, each with as many candidates as members at most.  Members still apart after that are compared on full sets, in
blocks, which give one link for each two components that they join.  Jaccard distance is a metric, so only members of alike
distance to the centre need comparing.

Equal sets are first folded to one class, so a group of copies costs one document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skeinflow.llm import kernels as K
from skeinflow.llm.common import drop_stage, stage
from skeinflow.llm.components import components

SHINGLE_WORDS = 5
BANDS, ROWS = 25, 5
BINS = 128
PERCENT = 85
#: Members of a centre that one task compares at once, members checked against one copy of a centre, and rounds of further centres.
BLOCK, STAR, ROUNDS = 256, 64, 1

_EDGES = np.arange(BINS, dtype=np.uint64) << np.uint64(57)
#: _RANK[i, j]: place of bin j in the order in which the empty bin i looks for a filled one.
_RANK = np.argsort(np.random.default_rng(20).random((BINS, BINS)), axis=1).astype(np.int16)
_MULT = np.random.default_rng(21).integers(1, 2**63, size=(BANDS, ROWS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BAND = K.mix(np.arange(1, BANDS + 1, dtype=np.uint64))


def shingle_sets(column: pa.Array, lower: bool = True) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    for t in K.texts(column):
        t = t._replace(data=K.LOWER[t.data]) if lower else t
        w = K.words(t)
        h = K.span_hashes(t.data, w.start, w.end)
        g = K.window_hashes(h, SHINGLE_WORDS)
        for lo, hi in zip(w.first[:-1].tolist(), w.first[1:].tolist(), strict=True):
            n = hi - lo
            if n >= SHINGLE_WORDS:
                yield np.unique(g[lo : hi - SHINGLE_WORDS + 1])
            else:
                yield K.window_hashes(h[lo:hi], n) + np.uint64(n) if n else g[:0]


def band_keys(shingles: np.ndarray) -> np.ndarray:
    """Keys of the bands of a non-empty set."""
    at = np.searchsorted(shingles, _EDGES)
    until = np.append(at[1:], len(shingles))
    filled = at < until
    value = shingles[np.minimum(at, len(shingles) - 1)]
    if not filled.all():
        have = np.flatnonzero(filled)
        empty = np.flatnonzero(~filled)
        value[empty] = value[have[np.argmin(_RANK[np.ix_(empty, have)], axis=1)]]
    return K.mix((value[: BANDS * ROWS].reshape(BANDS, ROWS) * _MULT).sum(axis=1, dtype=np.uint64) ^ _BAND)


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n, d1, d2, keys = [], [], [], []
        for s in shingle_sets(batch.column("text")):
            n.append(len(s))
            d1.append(K.mix(s).sum(dtype=np.uint64))
            d2.append(K.mix(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64))
            if len(s):
                keys.append(band_keys(s))
        has = np.array(n, dtype=np.int64) > 0
        ends = np.concatenate([[0], np.cumsum(has * BANDS)]).astype(np.int32)
        flat = K.signed(np.concatenate(keys)) if keys else np.zeros(0, dtype=np.int64)
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"),
                pa.array(n, pa.int64()),
                pa.array(K.signed(np.array(d1, dtype=np.uint64))),
                pa.array(K.signed(np.array(d2, dtype=np.uint64))),
                pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)),
            ],
            ["doc_id", "n_shingles", "d1", "d2", "bands"],
        )


def _alike(inter: int, x: int, y: int, percent: int) -> bool:
    return 100 * inter >= percent * (x + y - inter)


def _star(percent: int):
    """Rows of one (center, part) come together, the centre's first; gives each member's link or its distance cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, centres = None, []
        for batch in batches:
            out = [[], [], [], []]
            rows = zip(*(batch.column(c).to_pylist() for c in ("center", "part", "member")), strict=True)
            for (center, part, member), s in zip(rows, shingle_sets(batch.column("text")), strict=True):
                if key != (center, part):
                    key, centres = (center, part), []
                if member == center:
                    centres.append(s)
                    continue
                best, cell = False, 0
                for c in centres:
                    inter = len(np.intersect1d(c, s, assume_unique=True))
                    best |= _alike(inter, len(c), len(s), percent)
                    union = len(c) + len(s) - inter
                    cell = max(cell, (100 * (union - inter)) // ((100 - percent) * union + 1))
                for column, v in zip(out, (center, member, best, 0 if best else max(1, cell)), strict=True):
                    column.append(v)
            yield pa.RecordBatch.from_arrays(
                [pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.bool_()), pa.array(out[3], pa.int32())],
                ["a", "b", "linked", "cell"],
            )

    return run


def _block_links(ids: list, comps: list, sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Links between members of different components within one block, one for each two components."""
    sizes = np.array([len(s) for s in sets])
    flat = np.concatenate(sets)
    value, column = np.unique(flat, return_inverse=True)
    counts = np.bincount(column)
    shared = np.cumsum(counts > 1) - 1
    keep = counts[column] > 1
    if not keep.any():
        return []
    row = np.repeat(np.arange(len(sets)), sizes)[keep]
    col = shared[column[keep]]
    inter = np.zeros((len(sets), len(sets)), dtype=np.int64)
    for lo in range(0, int(col.max()) + 1, 8192):
        part = (col >= lo) & (col < lo + 8192)
        if part.any():
            m = np.zeros((len(sets), 8192), dtype=np.float32)
            m[row[part], col[part] - lo] = 1
            inter += (m @ m.T).astype(np.int64)
    union = sizes[:, None] + sizes[None, :] - inter
    comp = np.array(comps)
    hit = (100 * inter >= percent * union) & (comp[:, None] != comp[None, :])
    i, j = np.nonzero(np.triu(hit, 1))
    low, high = np.minimum(comp[i], comp[j]), np.maximum(comp[i], comp[j])
    _, first = np.unique(np.stack([low, high]), axis=1, return_index=True)
    return [(ids[i[k]], ids[j[k]]) for k in first.tolist()]


def _blocks(percent: int):
    """Rows of one key come together; gives links between components within each key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids, comps, sets = None, [], [], []
        for batch in batches:
            links = []
            rows = zip(*(batch.column(c).to_pylist() for c in ("key", "member", "comp")), strict=True)
            for (k, member, comp), s in zip(rows, shingle_sets(batch.column("text")), strict=True):
                if k != key:
                    links += _block_links(ids, comps, sets, percent) if len(ids) > 1 else []
                    key, ids, comps, sets = k, [], [], []
                ids.append(member)
                comps.append(comp)
                sets.append(s)
            yield _pairs(links)
        yield _pairs(_block_links(ids, comps, sets, percent) if len(ids) > 1 else [])

    return run


def _pairs(links: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x[i] for x in links], pa.int64()) for i in (0, 1)], ["a", "b"])


def _spread(c: str, parts: Column) -> Column:
    return F.pmod(F.xxhash64(F.col(c), F.lit(7)), parts)


def _checked(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """Distinct (center, member) checked on full sets: a, b, linked, cell (distance in widths of a link's greatest).

    A class comes with several texts if its id has some: a pair is linked if any of them are, as the id is one.
    """
    # Aggregates are written before they are joined back, so that Spark can split the partitions of a hot key.
    parts = stage(pairs.groupBy("center").agg(F.ceil(F.count("*") / STAR).cast("int").alias("parts")), "parts")
    dealt = pairs.join(parts, "center").select("center", _spread("member", F.col("parts")).cast("int").alias("part"), "member")
    centers = parts.select("center", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("center").alias("member"))
    rows = dealt.union(centers).join(texts, "member")
    rows = rows.select("center", "part", "member", (F.col("member") != F.col("center")).alias("rest"), "text")
    rows = rows.repartition("center", "part").sortWithinPartitions("center", "part", "rest", "member")
    checked = stage(rows.mapInArrow(_star(percent), "a long, b long, linked boolean, cell int"), "checked")
    drop_stage(parts)
    return checked


def _merged(roots: DataFrame | None, links: DataFrame) -> DataFrame:
    """(node, component) of all that is linked: ``roots`` so far, and more ``links`` (a, b) between nodes."""
    if roots is None:
        return stage(components(links), "components")
    name = lambda c: roots.select(F.col("node").alias(c), F.col("component").alias(f"r{c}"))
    between = links.join(name("a"), "a", "left").join(name("b"), "b", "left")
    more = stage(components(between.select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b"))), "more")
    moved = roots.join(more.select(F.col("node").alias("component"), F.col("component").alias("low")), "component", "left")
    moved = moved.select("node", F.coalesce("low", "component").alias("component"))
    both = stage(moved.union(more.join(roots.select("node"), "node", "left_anti").select("node", "component")), "components")
    drop_stage(roots, more)
    return both


def _apart(checked: DataFrame, roots: DataFrame) -> DataFrame:
    """a, b, cell, comp and parts of the members (b) of centres (a) whose members are in several components; written."""
    named = checked.groupBy("a", "b").agg(F.max("cell").alias("cell")).join(roots.select(F.col("node").alias("b"), F.col("component").alias("comp")), "b", "left")
    named = stage(named.select("a", "b", "cell", F.coalesce("comp", "b").alias("comp")), "named")
    groups = named.groupBy("a").agg(F.count("*").alias("n"), F.min("comp").alias("lo"), F.max("comp").alias("hi"))
    groups = stage(groups.where("lo <> hi").select("a", F.ceil(F.col("n") / BLOCK).cast("int").alias("parts")), "groups")
    out = stage(named.join(groups, "a"), "apart")
    drop_stage(named, groups)
    return out


def near_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest linked id, itself included), kept (doc_id = component_id).

    Null or empty texts have no shingles and link with nothing; a null doc_id links with nothing either, gets a null
    component and is kept.  Ids may be of any type that has an order; rows that repeat an id share its component.  Similarities
    tied with the bound link; texts of fewer than five words are one shingle; very long texts are worked on whole, in memory
    of some 60 times the longest.  An empty table gives no rows; other columns, whatever their names, are not looked at.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    docs = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    sets = stage(docs.mapInArrow(_signatures, f"doc_id {kind}, n_shingles long, d1 long, d2 long, bands array<long>"), "sets")
    usable = sets.where("doc_id IS NOT NULL AND n_shingles > 0")
    classes = usable.groupBy("d1", "d2").agg(F.min("doc_id").alias("least"), F.first("bands").alias("bands"))
    # Numbers of the classes, fixed by being written.
    classes = stage(classes.withColumn("cls", F.monotonically_increasing_id()), "classes")

    banded = classes.select("cls", "least", F.explode("bands").alias("bucket"))
    # The centre is the class with the smallest id: an original mostly comes before what was made from it.
    hubs = banded.groupBy("bucket").agg(F.min(F.struct("least", "cls"))["cls"].alias("center"), F.min("cls").alias("low"), F.max("cls").alias("high"))
    hubs = stage(hubs.where("low < high").select("bucket", "center"), "hubs")
    stars = stage(banded.join(hubs, "bucket").where("cls <> center").select("center", F.col("cls").alias("member")).distinct(), "stars")
    # The texts of all that is ever compared, as later rounds are among the members of these stars; shuffled by id here only.
    wanted = stars.select(F.col("member").alias("cls")).union(stars.select("center")).distinct()
    texts = docs.join(classes.select("cls", F.col("least").alias("doc_id")).join(wanted, "cls"), "doc_id")
    texts = stage(texts.select(F.col("cls").alias("member"), "text"), "texts")
    checked = _checked(stars, texts, percent)

    # An id that has several classes joins them.
    ids = usable.join(classes.select("d1", "d2", "cls"), ["d1", "d2"]).select("doc_id", "cls")
    several = ids.groupBy("doc_id").agg(F.min("cls").alias("a"), F.max("cls").alias("b")).where("a <> b").select("doc_id", "a")
    twice = ids.join(several, "doc_id").select("a", F.col("cls").alias("b"))
    roots = _merged(None, checked.where("linked").select("a", "b").union(twice))

    for _ in range(ROUNDS):
        apart = _apart(checked, roots)
        if apart.isEmpty():
            break
        own = apart.join(roots.select(F.col("node").alias("a"), F.col("component").alias("hub")), "a", "left").withColumn("hub", F.coalesce("hub", "a"))
        next_hub = own.where("comp <> hub").groupBy("a").agg(F.min(F.struct("b", "comp")).alias("next"))
        next_hub = stage(next_hub.select("a", F.col("next.b").alias("center"), F.col("next.comp").alias("center_comp")), "next")
        more = apart.join(next_hub, "a").where("comp <> center_comp").select("center", F.col("b").alias("member")).distinct()
        more = stage(more, "stars")
        found = _checked(more, texts, percent)
        roots = _merged(roots, found.where("linked").select("a", "b"))
        drop_stage(apart, next_hub, more, found)
    else:
        apart = _apart(checked, roots)
        if not apart.isEmpty():
            found = stage(_block_wise(apart, texts, percent), "rest")
            roots = _merged(roots, found)
            drop_stage(apart, found)

    known = classes.select("d1", "d2", "cls", "least").join(roots.withColumnRenamed("node", "cls"), "cls", "left")
    known = stage(known.select("d1", "d2", "least", F.coalesce("component", "cls").alias("root")), "known")
    lowest = known.groupBy("root").agg(F.min("least").alias("component"))
    drop_stage(hubs, stars, texts, checked, roots, classes)
    out = sets.select("doc_id", "n_shingles", "d1", "d2").join(known.join(lowest, "root").select("d1", "d2", "component"), ["d1", "d2"], "left")
    component = F.when(F.col("n_shingles") > 0, F.coalesce("component", "doc_id")).otherwise(F.col("doc_id"))
    out = out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), component).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def _block_wise(apart: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between components among the members of each centre."""
    apart = apart.withColumn("part", _spread("b", F.col("parts")).cast("int"))
    # Cells are as wide as the greatest distance of a link: only equal or adjacent ones can hold one.
    other = F.sequence(F.lit(0), F.col("parts") - 1)
    mine = F.struct(F.col("cell").alias("cell"), F.col("part").alias("part"))

    def keys(step: int) -> Column:
        def one(j: Column) -> Column:
            theirs = F.struct((F.col("cell") + step).alias("cell"), j.alias("part"))
            return F.struct(F.least(mine, theirs).alias("x"), F.greatest(mine, theirs).alias("y"))

        return F.transform(other, one)

    small = F.array(F.struct(F.struct(F.lit(-1).alias("cell"), F.lit(0).alias("part")).alias("x"), F.struct(F.lit(-1).alias("cell"), F.lit(0).alias("part")).alias("y")))
    split = F.flatten(F.array(keys(-1), keys(0), keys(1)))
    split = F.filter(split, lambda k: (k["x"]["cell"] >= 0) & (k["y"]["cell"] > 0))
    keyed = apart.select("a", "b", "comp", F.explode(F.when(F.col("parts") == 1, small).otherwise(split)).alias("k"))
    keyed = keyed.select(F.concat_ws(",", "a", "k.x.cell", "k.x.part", "k.y.cell", "k.y.part").alias("key"), F.col("b").alias("member"), "comp")
    rows = keyed.join(texts, "member").select("key", "member", "comp", "text")
    rows = rows.repartition("key").sortWithinPartitions("key", "member")
    return rows.mapInArrow(_blocks(percent), "a long, b long")


#: DuckDB SQL for op10's rows, by brute force over pairs that share a shingle.
ORACLE = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
  ELSE list_distinct(list_transform(generate_series(1, len(w) - 4), lambda i: array_to_string(w[i:i + 4], ' '))) END AS g FROM d),
sets AS (SELECT min(doc_id) AS rep, hash(list_sort(g)) AS h, any_value(g) AS g, len(any_value(g)) AS n FROM s WHERE len(g) > 0 GROUP BY list_sort(g)),
x AS (SELECT rep, n, unnest(g) AS shingle FROM sets),
pairs AS (SELECT a.rep AS a, b.rep AS b, a.n + b.n - count(*) AS u, count(*) AS i FROM x a JOIN x b ON a.shingle = b.shingle AND a.rep < b.rep
  AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n) GROUP BY a.rep, b.rep, a.n, b.n),
links AS (SELECT a, b FROM pairs WHERE 100 * i >= 85 * u),
both_ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach(a, b) AS (SELECT rep, rep FROM sets UNION SELECT r.a, l.b FROM reach r JOIN both_ways l ON r.b = l.a),
least AS (SELECT a AS rep, min(b) AS component_id FROM reach GROUP BY a),
named AS (SELECT list_sort(g) AS g, component_id FROM sets JOIN least USING (rep))
SELECT s.doc_id, len(s.g)::BIGINT AS n_shingles, coalesce(component_id, s.doc_id) AS component_id, coalesce(component_id, s.doc_id) = s.doc_id AS kept
FROM s LEFT JOIN named ON named.g = list_sort(s.g)
"""
