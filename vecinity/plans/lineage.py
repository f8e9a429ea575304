"""Where long plans are cut: tables in the folder that the cluster shares."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

_MARKED: set[str] = set()


def qualified(spark: SparkSession, path: str) -> str:
    """The full address of a path: without a scheme it lies in Hadoop's default file system."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    address = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(hadoop).toString()
    return "file://" + address[5:] if address.startswith("file:/") and not address.startswith("file://") else address


def _delete(spark: SparkSession, path: str) -> None:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder of this application below spark.checkpoint.dir, deleted when the driver ends.

    Where that setting is missing (tests, one machine) it lies below the warehouse; on a cluster that must be a shared store then."""
    context = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"
        if qualified(spark, root).startswith("file:") and not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    home = f"{qualified(spark, root).rstrip('/')}/vecinity-{context.applicationId}"
    if home not in _MARKED:
        hadoop = context._jvm.org.apache.hadoop.fs.Path(home)
        system = hadoop.getFileSystem(context._jsc.hadoopConfiguration())
        system.mkdirs(hadoop)
        system.deleteOnExit(hadoop)
        _MARKED.add(home)
    return f"{home}/{name}-{uuid.uuid4().hex}"


def saved(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read again: lineage ends here, and lost executors cost nothing before it."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes what `saved` wrote, once nothing reads it any more."""
    for table in tables:
        if path := getattr(table, "scratch_path", None):
            _delete(table.sparkSession, path)


def partitions(spark: SparkSession) -> int:
    """How many partitions the shuffles of this session use."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
