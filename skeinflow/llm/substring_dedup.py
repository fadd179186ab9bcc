"""Substring dedup over a log-structured fingerprint index.

A window is WINDOW consecutive words.  Its fingerprint is the least hash of the ANCHOR-word runs in it, so equal windows have
equal fingerprints, and neighbouring windows mostly share one: a text has one for about nine windows.  The index keeps the
fingerprints of all windows of its history in immutable sorted runs, one per batch, listed in a manifest.  Each new batch is
merge-joined with the runs to find the fingerprints that have been seen; the windows that have these, in the batch and in the
history, are verified over their whole word sequences by two independent 64-bit hashes and counted; a window is a repeat if its
sequence starts at two places.  Then the batch is a run too, and FANOUT runs of one tier are merged into one of the next.

Equal texts are one class (two 64-bit hashes of the text) and go through all this once; each window of a class with copies
is a repeat at once.  Texts are shuffled only for classes with candidates, picked by a semi-join with a broadcast of hash
remainders (at most 2**20, so of bounded size; a corpus that fills them loses the saving and nothing else: every text is then
shuffled once).

``repeats`` without an index takes the documents in BATCHES into an index of its own, which it drops.  With one, the documents
are the next batch of a history that can be opened again, by another session too: the index keeps the texts of its classes
beside the fingerprints, as windows are verified against them.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skeinflow.llm import kernels as K
from skeinflow.llm.common import drop_stage, shared_dir, stage

WINDOW, ANCHOR = 35, 18
#: Batches that documents without an index are taken in, and runs of a tier that are merged into one of the next.
BATCHES, FANOUT = 3, 2
REMAINDERS = 1 << 20
_OTHER = np.uint64(0xC2B2AE3D27D4EB4F)
_CLASS = "t1 bigint, t2 bigint, anchors array<bigint>, text string"


class FingerprintIndex:
    """Runs (fp, n), sorted and in buckets by fp, and the classes of text that they come from, in a shared folder.

    Opening a folder that has a manifest goes on with what that lists.  A manifest is written after the runs that it names and
    before those it no longer names are deleted, so a failure in between leaves the index as it was.
    """

    def __init__(self, spark: SparkSession, folder: str | None = None, fanout: int = FANOUT):
        self.spark, self.fanout = spark, fanout
        self.folder = (folder or f"{shared_dir(spark)}/skeinflow-index-{uuid.uuid4().hex}").rstrip("/")
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.version = 0
        #: (name, tier) of each run, and names of the tables of classes.
        self.runs: list[tuple[str, int]] = []
        self.classes: list[str] = []
        self._open()

    def _path(self, name: str):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}" if name else self.folder)
        return path, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _open(self) -> None:
        path, fs = self._path("manifests")
        found = [f.getPath().getName() for f in fs.listStatus(path)] if fs.exists(path) else []
        whole = sorted(f for f in found if f.endswith(".json"))
        if whole:
            path, fs = self._path(f"manifests/{whole[-1]}")
            stream = fs.open(path)
            try:
                state = json.loads(str(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")))
            finally:
                stream.close()
            self.version, self.buckets, self.classes = state["version"], state["buckets"], state["classes"]
            self.runs = [(name, tier) for name, tier in state["runs"]]

    def _commit(self) -> None:
        """List the runs and classes as they are now; a manifest appears whole, by its renaming."""
        self.version += 1
        state = {"version": self.version, "buckets": self.buckets, "runs": self.runs, "classes": self.classes}
        (path, fs), (final, _) = self._path(f"manifests/{self.version:08d}.part"), self._path(f"manifests/{self.version:08d}.json")
        out = fs.create(path, False)
        try:
            out.write(bytearray(json.dumps(state).encode()))
        finally:
            out.close()
        if not fs.rename(path, final):
            raise RuntimeError(f"another writer has made version {self.version} of {self.folder}")

    def _table(self, name: str) -> str:
        return f"skein_{hashlib.md5(self.folder.encode()).hexdigest()[:16]}_{name}"

    def run(self, name: str) -> DataFrame:
        """A run as a table whose buckets and order Spark knows."""
        table = self._table(name)
        if not self.spark.catalog.tableExists(table):
            self.spark.sql(f"CREATE TABLE {table} (fp BIGINT, n BIGINT) USING parquet CLUSTERED BY (fp) SORTED BY (fp) INTO {self.buckets} BUCKETS LOCATION '{self.folder}/{name}'")
        return self.spark.table(table)

    def _write(self, rows: DataFrame) -> str:
        name = f"run_{uuid.uuid4().hex}"
        rows = rows.groupBy("fp").agg(F.sum("n").cast("bigint").alias("n"))
        rows.write.bucketBy(self.buckets, "fp").sortBy("fp").option("path", f"{self.folder}/{name}").option("compression", "zstd").saveAsTable(self._table(name))
        return name

    def add(self, fingerprints: DataFrame, classes: DataFrame | None = None) -> DataFrame:
        """Add a batch (fp, n); gives, written, the fp that history and batch together have more than once (some repeated).

        ``classes`` (t1, t2, anchors, text) of the batch are kept for batches to come.
        """
        new = self._write(fingerprints)
        fresh = self.run(new)
        seen = fresh.where("n > 1").select("fp")
        for name, _ in self.runs:
            seen = seen.union(fresh.join(self.run(name).select("fp").hint("merge"), "fp").select("fp"))
        seen = stage(seen, "seen")
        self.runs.append((new, 0))
        if classes is not None:
            name = f"classes_{uuid.uuid4().hex}"
            classes.write.option("compression", "zstd").parquet(f"{self.folder}/{name}")
            self.classes.append(name)
        self._commit()
        self.compact()
        return seen

    def history(self) -> DataFrame | None:
        """The classes of all batches added so far."""
        paths = [f"{self.folder}/{name}" for name in self.classes]
        return self.spark.read.schema(_CLASS).parquet(*paths) if paths else None

    def compact(self) -> None:
        """Merge the runs of a tier into one of the next while any tier has ``fanout`` of them."""
        tier = 0
        while tier <= max((t for _, t in self.runs), default=-1):
            full = [name for name, t in self.runs if t == tier]
            if len(full) >= self.fanout:
                # Read as plain files: an aggregate over a union of bucketed tables goes without a shuffle, while the scans
                # below it may be planned without their buckets, and then one fp comes out more than once.
                merged = self._write(self.spark.read.schema("fp bigint, n bigint").parquet(*(f"{self.folder}/{name}" for name in full)))
                self.runs = [r for r in self.runs if r[1] != tier] + [(merged, tier + 1)]
                self._commit()
                for name in full:
                    self._drop(name)
            tier += 1

    def _drop(self, name: str) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self._table(name)}")
        path, fs = self._path(name)
        fs.delete(path, True)

    def drop(self) -> None:
        """Delete the index, runs that no manifest came to list included."""
        for name, _ in self.runs:
            self._drop(name)
        path, fs = self._path("")
        fs.delete(path, True)
        self.runs, self.classes = [], []


def _sliding(a: np.ndarray, width: int, of) -> np.ndarray:
    """``of`` (minimum or maximum) of every ``width`` neighbours."""
    n, have = len(a) - width + 1, 1
    while 2 * have <= width:
        a = of(a[:-have], a[have:])
        have *= 2
    return of(a[:n], a[width - have : width - have + n])


def window_anchors(t: K.Texts) -> tuple[K.Words, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """words, word hashes, run hashes, window starts and the anchor hash of each window."""
    w = K.words(t)
    h = K.span_hashes(t.data, w.start, w.end, seed=9)
    runs = K.window_hashes(h, ANCHOR)
    start, _ = K.window_starts(w.first, WINDOW)
    least = _sliding(runs, WINDOW - ANCHOR + 1, np.minimum)[start] if len(start) else runs[:0]
    return w, h, runs, start, least


def _anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    span = WINDOW - ANCHOR + 1
    for batch in batches:
        at, once, twice, n1, n2 = [], [], [], [], []
        for t in K.texts(batch.column("text")):
            w, _, runs, start, least = window_anchors(t)
            if not len(start):
                continue
            # A run is an anchor if it is the least of some window that holds it.
            best = np.zeros(len(runs) + span - 1, dtype=np.uint64)
            best[start + span - 1] = least
            picked = np.flatnonzero(_sliding(best, span, np.maximum) == runs)
            row = np.searchsorted(w.first, picked, side="right") - 1
            fp = runs[picked]
            order = np.lexsort((fp, row))
            row, fp = row[order], fp[order]
            head = np.ones(len(fp), dtype=bool)
            head[1:] = (fp[1:] != fp[:-1]) | (row[1:] != row[:-1])
            where = np.flatnonzero(head)
            many = np.diff(np.append(where, len(fp))) > 1
            rows = np.unique(row)
            at.append(t.lo + rows)
            once.append(fp[where])
            twice.append(fp[where][many])
            n1.append(np.bincount(row[where], minlength=t.hi - t.lo)[rows])
            n2.append(np.bincount(row[where][many], minlength=t.hi - t.lo)[rows])
        if at:
            take = pa.array(np.concatenate(at))
            lists = [pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.concatenate(n))]).astype(np.int32)), pa.array(K.signed(np.concatenate(v)))) for n, v in ((n1, once), (n2, twice))]
            yield pa.RecordBatch.from_arrays([batch.column("t1").take(take), batch.column("t2").take(take), batch.column("rid").take(take), *lists], ["t1", "t2", "rid", "anchors", "twice"])


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Place and two hashes of each window with a repeated anchor."""
    for whole in batches:
        for at in range(0, whole.num_rows, 512):
            batch = whole.slice(at, 512)
            fps = batch.column("fps")
            rows, places, h1, h2 = [], [], [], []
            for t in K.texts(batch.column("text")):
                w, h, _, start, least = window_anchors(t)
                bounds = np.searchsorted(start, w.first)
                one, two = K.window_hashes(h, WINDOW), K.window_hashes(K.mix(h ^ _OTHER), WINDOW, _OTHER)
                for i in range(t.hi - t.lo):
                    lo, hi = bounds[i], bounds[i + 1]
                    if hi > lo:
                        known = fps[t.lo + i].values.to_numpy().view(np.uint64)
                        s = start[lo:hi][np.isin(least[lo:hi], known)]
                        rows.append(np.full(len(s), t.lo + i))
                        places.append(s - w.first[i])
                        h1.append(one[s])
                        h2.append(two[s])
            if rows:
                take = pa.array(np.concatenate(rows))
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c).take(take) for c in ("mine", "t1", "t2")), pa.array(np.concatenate(places).astype(np.int32)), *(pa.array(K.signed(np.concatenate(x))) for x in (h1, h2))],
                    ["mine", "t1", "t2", "place", "h1", "h2"],
                )


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.withColumns({"t1": F.xxhash64("text"), "t2": F.xxhash64(F.lit(1), "text")})


def _pick(docs: DataFrame, classes: DataFrame, how: str) -> DataFrame:
    """Rows of ``docs`` whose class may be (or, by left_anti, can't be) among ``classes``."""
    some = F.broadcast(classes.select(F.pmod("t1", F.lit(REMAINDERS)).alias("_r")).distinct())
    return docs.join(some, F.pmod(docs["t1"], F.lit(REMAINDERS)) == some["_r"], how)


def _named(classes: DataFrame, seen: DataFrame, keep: list[str]) -> DataFrame:
    """Classes that have fingerprints in ``seen``, with these as ``fps``."""
    rows = classes.select("t1", "t2", *keep, F.explode("anchors").alias("fp")).join(seen, "fp")
    return rows.groupBy("t1", "t2", *keep).agg(F.collect_list("fp").alias("fps"))


def repeats(docs: DataFrame, index: FingerprintIndex | None = None) -> DataFrame:
    """(t1, t2, everything, places): what to remove from the classes of text that have repeats.

    ``everything`` says that the class has copies, so all its windows are repeats; else ``places`` has where they start.  With
    an ``index``, what its history holds counts as elsewhere, and the documents join it.
    """
    rid = F.coalesce(F.xxhash64(F.col("doc_id").cast("string")), F.lit(0).cast("long"))
    texts = _keyed(docs.select(rid.alias("rid"), F.col("text").cast("string").alias("text"))).where("text IS NOT NULL")
    found = texts.mapInArrow(_anchors, "t1 long, t2 long, rid long, anchors array<long>, twice array<long>")
    classes = found.groupBy("t1", "t2").agg(F.count("*").alias("n"), F.min("rid").alias("rid"), F.first("anchors").alias("anchors"), F.first("twice").alias("twice"))
    classes = stage(classes, "classes")

    def fingerprints(part: DataFrame) -> DataFrame:
        return part.select(F.explode("anchors").alias("fp"), F.lit(1).alias("n")).union(part.select(F.explode("twice").alias("fp"), F.lit(1).alias("n")))

    used = [classes]
    if index is None:
        own = FingerprintIndex(docs.sparkSession)
        try:
            hits = [own.add(fingerprints(classes.where(F.pmod("t1", F.lit(BATCHES)) == b))) for b in range(BATCHES)]
        finally:
            own.drop()
        seen = hits[0]
        for h in hits[1:]:
            seen = seen.union(h)
        seen, past = seen.distinct(), None
        used += hits
    else:
        past = index.history()
        here = _pick(texts, classes, "left_semi").join(classes.select("t1", "t2", "rid", "anchors"), ["t1", "t2", "rid"])
        used.append(index.add(fingerprints(classes), here.select("t1", "t2", "anchors", "text")))
        seen = used[-1].distinct()

    wanted = stage(_named(classes, seen, ["rid"]), "wanted")
    rows = _pick(texts, wanted, "left_semi").join(wanted, ["t1", "t2", "rid"]).select(F.lit(True).alias("mine"), "t1", "t2", "fps", "text")
    if past is not None:
        old = _named(past.select("t1", "t2", "anchors"), seen, [])
        rows = rows.union(_pick(past, old, "left_semi").join(old, ["t1", "t2"]).select(F.lit(False), "t1", "t2", "fps", "text"))
    windows = stage(rows.mapInArrow(_windows, "mine boolean, t1 long, t2 long, place int, h1 long, h2 long"), "windows")
    # Written, so that the join below is one of two plain shuffles and Spark can split the partitions of a hot window.
    twice = stage(windows.groupBy("h1", "h2").agg(F.count("*").alias("c")).where("c > 1").select("h1", "h2"), "twice")
    places = windows.where("mine").join(twice, ["h1", "h2"]).groupBy("t1", "t2").agg(F.collect_set("place").alias("places"))
    copies = classes.where("n > 1").select("t1", "t2", F.lit(True).alias("everything"))
    out = stage(copies.join(places, ["t1", "t2"], "full"), "repeats")
    drop_stage(*used, wanted, windows, twice)
    return out


def _finish(keep: list[str], with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, max(1, whole.num_rows), 512):
                batch = whole.slice(at, 512)
                n, gone, digest, kept = [], [], [], []
                everything, places = batch.column("everything").to_pylist(), batch.column("places")
                for i, text in enumerate(batch.column("text")):
                    words = (text.as_py() or "").encode("utf-8", "surrogatepass").split()
                    removed = 0
                    if everything[i] and len(words) >= WINDOW:
                        removed, words = len(words), []
                        n.append(removed)
                    else:
                        n.append(len(words))
                        if places[i].is_valid and len(places[i]):
                            s = places[i].values.to_numpy()
                            size = len(words) + 1
                            left = np.cumsum(np.bincount(s, minlength=size) - np.bincount(s + WINDOW, minlength=size))[:-1] == 0
                            removed = int(len(words) - left.sum())
                            words = [words[j] for j in np.flatnonzero(left).tolist()]
                    joined = b" ".join(words)
                    gone.append(removed)
                    digest.append(hashlib.sha256(joined).hexdigest())
                    kept.append(joined.decode("utf-8", "surrogatepass") if with_text and removed else None)
                made = [pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(digest, pa.string())]
                names = ["n_words", "n_removed", "kept_sha256"]
                if with_text:
                    made.append(pa.array(kept, pa.string()))
                    names.append("kept_text")
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *made], [*keep, *names])

    return run


def _removed(docs: DataFrame, keep: list[str], with_text: bool, index: FingerprintIndex | None) -> DataFrame:
    found = repeats(docs.select("doc_id", "text"), index)
    rows = _keyed(docs.withColumn("text", F.col("text").cast("string")))
    none = _pick(rows, found, "left_anti").withColumns({"everything": F.lit(None).cast("boolean"), "places": F.lit(None).cast("array<int>")})
    some = _pick(rows, found, "left_semi").join(found, ["t1", "t2"], "left")
    columns = [*dict.fromkeys([*keep, "text"]), "everything", "places"]
    both = none.select(*columns).union(some.select(*columns))
    schema = ", ".join([*(f"`{c}` {both.schema[c].dataType.simpleString()}" for c in keep), "n_words long, n_removed long, kept_sha256 string", *["kept_text string"] * with_text])
    return both.mapInArrow(_finish(keep, with_text), schema)


def remove_repeats(docs: DataFrame, index: FingerprintIndex | None = None) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 (of the kept words joined by one space) of every row of ``docs``.

    A null text has no words.  Each copy of a repeated sequence goes, the first one too, those within one document as well.
    Rows that repeat a text lose all its windows, whatever their ids; null ids, text ids and repeated ids are as good as
    others; texts of fewer than WINDOW words lose nothing; very long texts are worked on whole, in memory of some 60 times the
    longest one; an empty table gives no rows; other columns, whatever their names, are not looked at.  With an ``index``, what
    was added to it before counts as elsewhere too, and stays as it was.
    """
    return _removed(docs.select("doc_id", "text"), ["doc_id"], False, index)


def strip_repeats(docs: DataFrame, index: FingerprintIndex | None = None) -> DataFrame:
    """The columns of ``docs`` with repeats taken out of the texts: those that lose words become the kept words joined by
    one space (n_chars, where there is such a column, of them); rows with no words left go, and so do those without any.

    Nulls, ids, very long texts, repeated rows and an empty table are as in ``remove_repeats``; extra columns of any names come
    through unchanged."""
    held = [f"c{i}" for i in range(len(docs.columns))]
    rows = docs.select(*(F.col(f"`{c}`").alias(h) for c, h in zip(docs.columns, held, strict=True)), "doc_id", "text")
    out = _removed(rows, held, True, index).where("n_removed < n_words")
    made = {"text": F.coalesce("kept_text", held[docs.columns.index("text")]).cast(docs.schema["text"].dataType)}
    if "n_chars" in docs.columns:
        n_chars = docs.schema["n_chars"].dataType
        made["n_chars"] = F.when(F.col("n_removed") > 0, F.char_length("kept_text").cast(n_chars)).otherwise(F.col(held[docs.columns.index("n_chars")]))
    return out.select(*(made.get(c, F.col(h)).alias(c) for c, h in zip(docs.columns, held, strict=True)))


#: DuckDB SQL for op5's rows.
ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
starts AS (SELECT r, w, unnest(generate_series(1, len(w) - 34)) AS i FROM d WHERE len(w) >= 35),
windows AS (SELECT r, i, array_to_string(w[i:i + 34], ' ') AS s FROM starts),
again AS (SELECT s FROM windows GROUP BY s HAVING count(*) > 1),
hit AS (SELECT DISTINCT r, i + j AS p FROM (SELECT r, i FROM windows JOIN again USING (s)), range(35) t(j)),
gone AS (SELECT r, list(p) AS ps FROM hit GROUP BY r),
kept AS (SELECT doc_id, w, CASE WHEN ps IS NULL THEN w ELSE list_filter(w, lambda x, i: NOT list_contains(ps, i)) END AS k FROM d LEFT JOIN gone USING (r))
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - len(k))::BIGINT AS n_removed, sha256(array_to_string(k, ' ')) AS kept_sha256 FROM kept
"""
