"""Written intermediate tables, and dense row numbers without a single-partition window."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where it is unset, a temporary folder in local mode and the warehouse otherwise."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder
    if spark.sparkContext.master.startswith("local[") or spark.sparkContext.master == "local":
        folder = "file://" + tempfile.mkdtemp(prefix="koinea-")
        spark.sparkContext.setCheckpointDir(folder)
        return folder
    return spark.conf.get("spark.sql.warehouse.dir") + "/_koinea"


def written(df: DataFrame) -> DataFrame:
    """The rows of df, written once as Parquet to the shared folder and read again.

    This cuts the lineage with files that outlive any executor. They go when the application ends.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/koinea-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)
    return spark.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, *order: str, name: str) -> DataFrame:
    """df with dense numbers from 0 in the order of the given columns, nulls first.

    Rows are range-partitioned and sorted within partitions; only one row count for each partition
    reaches the driver. The numbered table is written, since range bounds are drawn by sampling.
    """
    place = f"_{name}_place"
    parts = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    placed = written(
        df.repartitionByRange(parts, *[F.col(c).asc_nulls_first() for c in order])
        .sortWithinPartitions(*[F.col(c).asc_nulls_first() for c in order])
        .withColumn(place, F.monotonically_increasing_id())
    )
    part, within = F.shiftrightunsigned(F.col(place), 33), F.col(place).bitwiseAND(F.lit((1 << 33) - 1))
    counts = sorted((r[0], r[1]) for r in placed.groupBy(part.cast("int").alias("p")).count().collect())
    total, pairs = 0, []
    for p, n in counts:
        pairs += [F.lit(p), F.lit(total).cast("long")]
        total += n
    base = F.element_at(F.create_map(*pairs), part.cast("int")) if pairs else F.lit(0).cast("long")
    return placed.withColumn(name, base + within).drop(place)
