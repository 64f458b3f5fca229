"""Where tables come from and where intermediate tables go.

Intermediate results that more than one job reads are written as Parquet into
the folder the cluster names in ``spark.checkpoint.dir``.  Those files survive
a lost executor and cut the lineage, and each plan is computed once.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read one input table; Parquet schemas are stored, never inferred."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared scratch folder; a local one only where none is set."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir is not set: executors need a folder that all of them share")
        found = "file://" + tempfile.mkdtemp(prefix="corrello-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


#: Rows that a task is meant to hold at once.  Adaptive execution joins partitions by their
#: compressed size, and 64 MB of keys can be six million rows of a hash table.
TASK_ROWS = 500_000


def parts_for(df: DataFrame) -> int:
    """In how many partitions ``df`` is dealt so that the rows of a task stay bounded."""
    return max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // TASK_ROWS))


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def keep(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` into the shared folder and return the table read back.

    What was shuffled for it goes with the write, as nothing reads it any more; otherwise
    it would stay until the driver happens to collect its garbage."""
    spark = df.sparkSession
    path, before = fresh_path(spark, name), spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def forget(df: DataFrame) -> None:
    """Delete the files of a table that ``keep`` wrote, once nothing reads it any more."""
    spark = df.sparkSession
    root = shared_dir(spark).split(":", 1)[-1].replace("//", "/")
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    for parent in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if root.rstrip("/") in parent.replace("//", "/"):
            path = hadoop(parent)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def _path(spark: SparkSession, path: str):
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop, hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path of any store that Spark reads is there."""
    hadoop, store = _path(spark, path)
    return store.exists(hadoop)


def children(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder, sorted; none if it is not there."""
    hadoop, store = _path(spark, path)
    return sorted(s.getPath().getName() for s in store.listStatus(hadoop)) if store.exists(hadoop) else []


def touch(spark: SparkSession, path: str) -> None:
    hadoop, store = _path(spark, path)
    store.create(hadoop, True).close()


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of a table, if it is there."""
    hadoop, store = _path(spark, path)
    store.delete(hadoop, True)
