"""A training-data pipeline over documents, by the operators of lexengine.llm."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexengine.llm import bpe
from lexengine.llm.common import documents, free_name, released, staged
from lexengine.llm.exact_dedup import without_copies
from lexengine.llm.language_id import in_known_language
from lexengine.llm.mixing import mixed_documents
from lexengine.llm.near_dedup import without_near_copies
from lexengine.llm.queries import vocabulary


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told."""
    released(spark)
    return in_known_language(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text."""
    released(spark)
    return without_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    released(spark)
    return without_near_copies(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of sources: of each document a row for every pass that takes words of it, with the words taken."""
    released(spark)
    return mixed_documents(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their ids, and whether these decode to the text. Columns that docs have keep their names; a new one gets an underscore then."""
    released(spark)
    ranks, pattern = vocabulary()
    ids, n_tokens, round_trip = (free_name(c, docs.columns) for c in ("ids", "n_tokens", "round_trip"))
    # staged, so that Python workers get few rows at once whatever the session's batches are
    out = staged(bpe.encode(docs, ranks, pattern, ids_col=ids))
    return out.withColumn(n_tokens, F.size(ids).cast("long")).withColumn(
        round_trip, F.sha2(bpe.decoded(F.col(ids), ranks), 256) == F.sha2(F.coalesce("text", F.lit("")), 256)
    )


STAGES = [
    ("language ID", language),
    ("exact dedup", exact),
    ("MinHash near-dedup", near),
    ("mixing sources", mix),
    ("byte-level BPE", tokens),
]

#: Language ID, the mix and the tokens can't be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for _, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir))
    return docs
