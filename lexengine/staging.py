"""Tables between steps, and joins that can be split. Tables are written to the folder that driver and executors share, so that lost executors cost nothing before them."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows that Python workers get at once while a table is staged, so that they don't hold a whole partition's texts.
BATCH_ROWS = 256
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def staged(df: DataFrame) -> DataFrame:
    """df as a Parquet table in the folder that spark.checkpoint.dir names; it goes when the session's JVM ends.

    Only a local session may do without that setting: it gets a temporary folder.
    """
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="lexengine-"))
        folder = spark.sparkContext.getCheckpointDir()
    path = f"{folder}/table-{uuid.uuid4().hex}"
    before = spark.conf.get(_BATCH)
    spark.conf.set(_BATCH, str(BATCH_ROWS))
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_BATCH, before)
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return spark.read.schema(df.schema).parquet(path)


def skew_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """left and right joined on keys, dealt out once more by a key made of the others, so that Spark can split a frequent one's rows."""
    part = F.pmod(F.xxhash64(*keys), F.lit(2)).alias("part__")
    return left.select("*", part).join(right.select("*", part), [*keys, "part__"], how).drop("part__")
