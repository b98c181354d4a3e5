"""Shared pieces of the llm operators: inputs, keys of rows, lineage cuts and joins."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexengine.shipping import shipped

#: White space of all operators: space, tab, line feed, vertical tab, form feed, carriage return.
SPACE = r"[\x20\x09-\x0D]+"
SPACE_CHARS = " \t\n\x0b\x0c\r"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    shipped(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as spark.checkpoint.dir names it.

    Only a local session may have none: a temporary folder is set as its checkpoint folder.
    """
    if said := spark.conf.get("spark.checkpoint.dir", None):
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(said)
        return said
    if found := spark.sparkContext.getCheckpointDir():
        return found
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
    spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="lexengine-"))
    return spark.sparkContext.getCheckpointDir()


def staged(df: DataFrame) -> DataFrame:
    """df as a Parquet table in the shared folder: lineage is cut and lost executors cost nothing before it.

    The table goes when the session's JVM ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/stage-{uuid.uuid4().hex}"
    with short_plans(spark), small_batches(spark):
        df.write.parquet(path)
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_at = path
    return out


def unstaged(df: DataFrame) -> None:
    """Deletes a staged table that nothing reads any more."""
    spark = df.sparkSession
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(df.staged_at)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def released(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of plans that nothing refers to any more; it does so as the driver collects garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """docs as id, key and text: the key is the id where it is a unique integer, else a number given to each row of a copy."""
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    if docs.schema[id_col].dataType.simpleString() in ("bigint", "int"):
        if own.groupBy("id").count().filter("count > 1 OR id IS NULL").isEmpty():
            return own.withColumn("key", F.col("id").cast("long"))
    return staged(own.withColumn("key", F.monotonically_increasing_id()))


def numbered(docs: DataFrame, id_col: str) -> tuple[DataFrame, str]:
    """docs and the name of a column that tells its rows apart: the id where it is a unique integer, else key__, a number in a staged copy."""
    if docs.schema[id_col].dataType.simpleString() in ("bigint", "int"):
        if docs.groupBy(id_col).count().filter((F.col("count") > 1) | F.col(id_col).isNull()).isEmpty():
            return docs, id_col
    return staged(docs.withColumn("key__", F.monotonically_increasing_id())), "key__"


@contextlib.contextmanager
def _within(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """A setting of the session that holds inside, and is put back."""
    before = spark.conf.get(key)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def short_plans(spark: SparkSession, most: int = 4096):
    """Within, descriptions of plans are cut: the driver keeps one for each query, and large literals stand in it again and again."""
    return _within(spark, "spark.sql.maxPlanStringLength", str(most))


def small_batches(spark: SparkSession, rows: int = 256):
    """Within, Python workers get so many rows at once, so that neither they nor the JVM hold a whole partition's texts."""
    return _within(spark, "spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def trimmed() -> None:
    """Gives this process's free memory back to the system: allocators keep it, and Python workers stay beside later steps."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):  # other C libraries have no such call
        ctypes.CDLL(None).malloc_trim(0)


def tidy(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A function of batches whose worker is trimmed after each task."""

    def inside(batches):
        yield from run(batches)
        trimmed()

    return inside


def free_name(name: str, columns: Iterable[str]) -> str:
    """name, with as many underscores as it takes to clash with no column."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def held_out(doc_id: Column) -> Column:
    """Rows that no model learns from: crc32 of the id's decimal text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def most_frequent(counts: DataFrame, most: int, key_col: str, count_col: str = "n") -> DataFrame:
    """The rows of the largest counts, about ``most`` and no more: a choice of what to cache, not of what to count.

    How many counts lie in each eighth of a doubling says which of these classes fit whole, so no task gathers candidates. Of
    the first class that does not fit a part is taken, by the hashes of its keys: nine tenths of the room that is left.
    """
    part = F.floor(F.log2(F.col(count_col).cast("double")) * 8 + 1e-9)
    sizes = {r.part: r["count"] for r in counts.groupBy(part.alias("part")).count().collect() if r.part is not None}
    least, total = max(sizes, default=0) + 1, 0
    for k in sorted(sizes, reverse=True):
        if total + sizes[k] > most:
            share = int((most - total) * 0.9 / sizes[k] * (1 << 30))
            some = (part == k) & (F.pmod(F.xxhash64(key_col), F.lit(1 << 30)) < share)
            return counts.filter((part >= least) | some)
        least, total = k, total + sizes[k]
    return counts.filter(part >= least)


def skew_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """left and right joined on keys, so that Spark can split the rows of a frequent key.

    It can't where a side is grouped by the same keys and is not dealt out again for the join; one more key, made of
    the others, makes it deal both out.
    """
    part = F.pmod(F.xxhash64(*keys), F.lit(2)).alias("part__")
    return left.select("*", part).join(right.select("*", part), [*keys, "part__"], how).drop("part__")
