"""Session-level helpers: table loading, the shared checkpoint folder and materialisation."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One driver table, by the path Spark's own readers understand; Python gets its rows in bounded batches."""
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder named in spark.checkpoint.dir; where it is unset, a temporary one in local mode only."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = f"file://{tempfile.mkdtemp(prefix='millrace-')}"
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write df as Parquet in the shared checkpoint folder and read it back.

    This cuts the lineage: a lost executor costs the tasks it ran, not what
    was written. The folder belongs to the application; `release` empties it.
    """
    spark = df.sparkSession
    path = f"{checkpoint_root(spark)}/millrace/{spark.sparkContext.applicationId}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Delete every table this application materialised."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{checkpoint_root(spark)}/millrace/{spark.sparkContext.applicationId}")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def bound_batches(spark: SparkSession, size: str = "2m") -> None:
    """Bound Arrow batches by bytes, whatever the length of texts.

    Plans are made lazily and read the setting when they run, so it stays set;
    it bounds memory and changes no result. A smaller bound already set is kept.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    jvm = spark._jvm.org.apache.spark.network.util.JavaUtils
    if jvm.byteStringAsBytes(spark.conf.get(key)) > jvm.byteStringAsBytes(size):
        spark.conf.set(key, size)


def fresh(stem: str, *frames: DataFrame) -> str:
    """A column name that none of the frames has, in any case."""
    taken = {c.lower() for f in frames for c in f.columns}
    name = f"_{stem}"
    while name in taken:
        name += "_"
    return name
