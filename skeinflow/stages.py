"""Written stages: cut a lineage, or fix what a sampled partitioning decided, in the folder that all executors share."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; only where that is unset (one machine) a temporary one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        context = spark.sparkContext
        found = context.getCheckpointDir()
        if not found:
            if not context.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            context.setCheckpointDir(tempfile.mkdtemp(prefix="skeinflow-"))
            found = context.getCheckpointDir()
    return found.rstrip("/")


def settled(df: DataFrame, name: str = "stage") -> DataFrame:
    """``df`` as a written table; a lost executor costs a read, and every use sees the same rows."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/skeinflow-{name}-{uuid.uuid4().hex}"
    made.append(path)
    df.write.option("compression", "zstd").parquet(path)
    tidy(spark)
    return spark.read.schema(df.schema).parquet(path)


#: Share of the driver's heap from which garbage is collected after a stage.
FULL = 0.5


def tidy(spark: SparkSession) -> bool:
    """Collect the driver's garbage once FULL of the heap is used.  Plans, broadcasts and shuffle files of stages that are over stay
    until then, so a long chain of stages would otherwise grow to the whole heap and fill disks."""
    runtime = spark.sparkContext._jvm.java.lang.Runtime.getRuntime()
    full = runtime.totalMemory() - runtime.freeMemory() > FULL * runtime.maxMemory()
    if full:
        gc.collect()
        spark.sparkContext._jvm.System.gc()
    return full


#: Folders of written tables that this process has made and not dropped, in order.
made: list[str] = []


def drop(spark: SparkSession, *paths: str) -> None:
    """Delete folders of written tables that nothing reads any more."""
    path_of = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    for path in paths:
        p = path_of(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        if path in made:
            made.remove(path)


def drop_settled(*tables: DataFrame) -> None:
    """Delete tables made by ``settled`` that nothing reads any more."""
    for df in tables:
        for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            # inputFiles() may name the scheme where the path that was written did not.
            known = [m for m in made if path.endswith(m.split(":", 1)[-1])]
            drop(df.sparkSession, *(known or ([path] if "/skeinflow-" in path else [])))
