"""Session settings, and tables in shared storage."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Unreachable, at the edges of the API; inside, a missing row.
INF = 60_000
UNKNOWN, FREE, OBSTACLE = 0, 1, 2
#: How tables with matrices are written. A reader takes 4096 rows of a row group at once, and a writer holds one in memory and by
#: default looks at its size first after 100 rows; with megabytes in a row both need to be bounded by bytes, from the first row on.
NARROW_GROUPS = {"parquet.block.size": str(2 << 20), "parquet.block.size.row.check.min": "1", "parquet.page.size.row.check.min": "1"}


def session(app: str = "cellweave", **conf: str) -> SparkSession:
    """A session with adaptive execution, UTC timestamps and Arrow batches that suit wide binary rows."""
    builder = SparkSession.builder.appName(app)
    base = {"spark.sql.adaptive.enabled": "true", "spark.sql.session.timeZone": "UTC", "spark.sql.execution.arrow.pyspark.enabled": "true"}
    for k, v in {**base, **{k.replace("__", "."): v for k, v in conf.items()}}.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession, label: str) -> str:
    """A new folder in the shared storage named by spark.checkpoint.dir.

    Where that is unset, a temporary folder serves a local master; executors on other machines could not see it, so a
    cluster without the setting is an error.
    """
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="cellweave-")
        spark.sparkContext.setCheckpointDir(root)
    return f"{root.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write to shared storage and read back, which cuts the lineage. The files go when the session's JVM ends."""
    spark = df.sparkSession
    path = shared_dir(spark, label)
    df.write.options(**NARROW_GROUPS).parquet(path)
    there = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(there)
    return spark.read.schema(df.schema).parquet(path)
