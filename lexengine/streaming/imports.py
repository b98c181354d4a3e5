"""Banks imported as they arrive: a stream over a folder of extracted banks, written to a table batch by batch."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lexengine.sources import archive


def import_terms(spark: SparkSession, folder: str, to: str, state: str, dictionary: str, version: int = 3, files_at_once: int = 16) -> StreamingQuery:
    """Reads all term banks of folder that no earlier run has read, appends their rows to the table at to, and ends.

    The state folder remembers what was read; a batch that is run again is written under its own number, in place of
    what it had left.
    """
    files = (
        spark.readStream.format("text").option("wholetext", True).option("maxFilesPerTrigger", files_at_once)
        .option("pathGlobFilter", "term_bank_*.json").load(folder)
    )
    rows = files.select(F.lit(dictionary).alias("dictionary"), F.lit(version).alias("version"), F.col("_metadata.file_name").alias("at"), F.posexplode(F.try_variant_get(F.parse_json("value"), "$", "array<variant>")).alias("no", "row"))
    found = archive.terms(rows.withColumn("at", F.concat("at", F.lit(" row "), "no")))

    def write(batch, number):
        batch.write.mode("overwrite").parquet(f"{to}/batch={number}")

    return found.writeStream.foreachBatch(write).option("checkpointLocation", state).trigger(availableNow=True).start()
