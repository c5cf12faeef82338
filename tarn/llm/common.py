"""Small helpers that the operators share: shared scratch tables, global ranks, Arrow batch sizes."""

from __future__ import annotations

import functools
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Whether the shuffle files of a query are deleted as soon as it has ended.
CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_POS_BITS = 33  # monotonically_increasing_id() keeps the row's place in the low 33 bits


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


@functools.cache
def _local_root() -> str:
    return tempfile.mkdtemp(prefix="tarn-")


def scratch_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``; a temporary one only where that is unset and
    all tasks run on this machine."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = _local_root()
    return root.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path; all of an application's are in one folder."""
    return f"{scratch_root(spark)}/tarn-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, made longer where a column is called so."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to a Parquet table in the shared folder and read it back, which cuts its lineage.

    Lost executors then cost only the tasks that ran on them, never the steps before. The shuffle files of
    the write go with it, as nothing reads them again; else they stay on disk until the driver collects garbage.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    before = spark.conf.get(CLEAN_UP, "false")
    spark.conf.set(CLEAN_UP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEAN_UP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def drop(*staged: DataFrame) -> None:
    """Delete tables written by ``stage`` that nothing lazy refers to any more."""
    for df in staged:
        path = getattr(df, "_scratch", None)
        if path:
            jvm = df.sparkSession.sparkContext._jvm
            hadoop = df.sparkSession.sparkContext._jsc.hadoopConfiguration()
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(hadoop).delete(p, True)


def keyed(docs: DataFrame, key: str = "_row") -> DataFrame:
    """The rows, staged, with a number of each row's own."""
    return stage(docs.withColumn(key, F.monotonically_increasing_id()), "rows")


def arrow_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Bound what one Arrow batch holds, as texts can be long."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def global_rank(df: DataFrame, order: list[Column], name: str, parts: int | None = None) -> DataFrame:
    """Add ``name``: the row's place from 0 in the order given, without gathering the rows anywhere.

    The rows are range-sorted and written once; a row's rank is its place in its partition plus the
    sizes of the partitions before. Only one count per partition reaches the driver. Equal rows get
    distinct ranks.
    """
    spark = df.sparkSession
    parts = parts or shuffle_partitions(spark)
    placed = stage(
        df.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()),
        "rank",
    )
    counts = placed.groupBy(F.shiftright("_at", _POS_BITS).alias("p")).count().collect()
    starts, total = [], 0
    for p, n in sorted(tuple(r) for r in counts):
        starts.append((p, total))
        total += n
    table = spark.createDataFrame(starts or [(0, 0)], "_p long, _start long")
    ranked = placed.withColumn("_p", F.shiftright("_at", _POS_BITS)).join(F.broadcast(table), "_p", "left")
    out = ranked.withColumn(name, F.col("_start") + F.col("_at").bitwiseAND(F.lit((1 << _POS_BITS) - 1))).drop("_p", "_start", "_at")
    out._scratch, out._total = placed._scratch, total
    return out
