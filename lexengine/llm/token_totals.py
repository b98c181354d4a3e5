"""Token counts as rollups that are kept by deltas.

A batch is a table of signed changes, +1 for a document that comes and -1 for one that goes; a revised document is
both. Its sums by source, language and tokenizer version are written first and count once a file of the batch's name is
created, so a batch that is sent again changes nothing, and one that broke off leaves nothing that counts. Totals are
kept by compaction: a snapshot holds the sum of all batches before it, and only later ones are added to it.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from urllib.parse import quote

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexengine.llm import bpe
from lexengine.llm.common import free_name

KEYS = ["source", "lang", "tokenizer_version"]
#: Tokenizers by version: words, and words with marks apart.
TOKENIZERS: dict[str, Callable[[Column], Column]] = {
    "words-1": lambda t: F.regexp_count(t, F.lit(r"[^\x20\x09-\x0D]+")),
    "marks-1": lambda t: F.regexp_count(t, F.lit(r"[\p{L}\p{N}]+|[^\p{L}\p{N}\x20\x09-\x0D]")),
}


def counted(docs: DataFrame, text_col="text", tokenizers=TOKENIZERS, sign: int = 1) -> DataFrame:
    """docs with tokenizer_version, tokens and sign: a row for each version. Null texts have no tokens."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    each = F.array(*(F.struct(F.lit(v).alias("v"), f(text).cast("long").alias("n")) for v, f in tokenizers.items()))
    out = docs.select(*docs.columns, F.explode(each).alias("each__"))
    return out.select(*docs.columns, F.col("each__.v").alias("tokenizer_version"), F.col("each__.n").alias("tokens"), F.lit(sign).alias("sign"))


def counted_pieces(docs: DataFrame, ranks: dict[bytes, int], pattern: str, version: str, text_col="text", sign: int = 1) -> DataFrame:
    """docs with tokenizer_version, tokens and sign by a byte-level BPE vocabulary. Null texts have no tokens."""
    ids = free_name("ids__", docs.columns)
    out = bpe.encode(docs, ranks, pattern, text_col, ids)
    return out.select(*docs.columns, F.lit(version).alias("tokenizer_version"), F.size(ids).cast("long").alias("tokens"), F.lit(sign).alias("sign"))


class TokenTotals:
    """Totals in a folder that all machines share.

    deltas holds sums of batches, each row with the name of its draft; commits a file for each batch, which names the draft that
    counts; snapshots sums of many batches and the drafts that they stand for. A file of a name is created once: of two
    writers of one batch the second is refused. That holds where the file system creates files without overwriting, as
    HDFS does; on an object store it takes one with conditional writes.
    """

    SHAPE = "source string, lang string, tokenizer_version string, n_docs long, n_tokens long, draft string"

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self._jvm = spark.sparkContext._jvm
        self._fs = self._path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(name)

    def _named(self, batch: str) -> str:
        """The file of a batch, whatever characters its name has."""
        if not batch:
            raise ValueError("a batch needs a name")
        return f"{self.folder}/commits/b-{quote(batch, safe='')}"

    def _created(self, file: str, text: str) -> bool:
        """Creates a file with a text, unless it is there."""
        try:
            out = self._fs.create(self._path(file), False)
        except Py4JJavaError as error:
            if "FileAlreadyExists" in str(error.java_exception) or self._fs.exists(self._path(file)):
                return False
            raise
        out.write(bytearray(text.encode()))
        out.close()
        return True

    def _written(self, sums: DataFrame, draft: str) -> None:
        sums.withColumn("draft", F.lit(draft)).write.parquet(f"{self.folder}/deltas/{draft}")

    def committed(self, batch: str) -> bool:
        return self._fs.exists(self._path(self._named(batch)))

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Adds changes (KEYS, tokens, sign) unless the batch is known; whether it did. Null sources and languages are keys too.

        Repeated rows count as often as they stand; an empty batch is a batch. What a refused writer wrote is deleted.
        """
        if self.committed(batch):
            return False
        sums = changes.groupBy(*KEYS).agg(F.sum(F.col("sign")).cast("long").alias("n_docs"), F.sum(F.col("sign") * F.col("tokens")).cast("long").alias("n_tokens"))
        draft = uuid.uuid4().hex
        self._written(sums.filter("n_docs != 0 OR n_tokens != 0"), draft)
        if self._created(self._named(batch), draft):
            return True
        self._fs.delete(self._path(f"{self.folder}/deltas/{draft}"), True)
        return False

    def _counted(self) -> DataFrame | None:
        """The rows that count: of the last snapshot, and of drafts committed since."""
        if not self._fs.exists(self._path(f"{self.folder}/commits")):
            return None
        drafts = self.spark.read.text(f"{self.folder}/commits").select(F.col("value").alias("draft")).distinct()
        rows = self.spark.read.schema(self.SHAPE).parquet(f"{self.folder}/deltas/*")
        if last := self._last_snapshot():
            covered = self.spark.read.parquet(f"{self.folder}/covered/{last}")
            drafts = drafts.join(covered, "draft", "left_anti").unionByName(self.spark.createDataFrame([(last,)], "draft string"))
        return rows.join(drafts, "draft", "left_semi")

    def _last_snapshot(self) -> str | None:
        at = self._path(f"{self.folder}/snapshots")
        names = sorted(x.getPath().getName() for x in self._fs.listStatus(at)) if self._fs.exists(at) else []
        return names[-1].split("-")[1] if names else None

    def totals(self) -> DataFrame:
        """KEYS, n_docs, n_tokens; keys that all documents have left are gone."""
        parts = self._counted()
        if parts is None:
            return self.spark.createDataFrame([], self.SHAPE).drop("draft")
        out = parts.groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
        return out.filter("n_docs != 0 OR n_tokens != 0")

    def compact(self) -> None:
        """Sums all batches committed so far into one, by one process at a time; batches that are committed meanwhile stay as they are."""
        if self._counted() is None:
            return
        before, draft = self._last_snapshot(), uuid.uuid4().hex
        # the commits that this one stands for are fixed first
        covered = self.spark.read.text(f"{self.folder}/commits").select(F.col("value").alias("draft")).distinct()
        covered.coalesce(1).write.parquet(f"{self.folder}/covered/{draft}")
        covered = self.spark.read.parquet(f"{self.folder}/covered/{draft}")
        own = covered
        if before:
            own = covered.join(self.spark.read.parquet(f"{self.folder}/covered/{before}"), "draft", "left_anti").unionByName(self.spark.createDataFrame([(before,)], "draft string"))
        rows = self.spark.read.schema(self.SHAPE).parquet(f"{self.folder}/deltas/*").join(own, "draft", "left_semi")
        sums = rows.groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
        self._written(sums.filter("n_docs != 0 OR n_tokens != 0"), draft)
        count = len(self._fs.listStatus(self._path(f"{self.folder}/snapshots"))) if before else 0
        self._created(f"{self.folder}/snapshots/{count:09d}-{draft}", draft)

    def drop(self) -> None:
        """Deletes the folder."""
        self._fs.delete(self._path(self.folder), True)


def rollup(totals: DataFrame) -> DataFrame:
    """Totals with subtotals: level 0 by all keys, 1 by source and version, 2 by version."""
    each = totals.withColumn("level", F.lit(0))
    by_source = totals.groupBy("source", "tokenizer_version").agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
    of_all = totals.groupBy("tokenizer_version").agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
    none = F.lit(None).cast("string")
    out = each.unionByName(by_source.withColumn("lang", none).withColumn("level", F.lit(1)))
    return out.unionByName(of_all.withColumn("source", none).withColumn("lang", none).withColumn("level", F.lit(2)))
