"""Exact dedup with a heavy-hitter split, in DataFrame operations only.

Misra-Gries counters (``freqItems``) name every digest that may hold ``support`` of the rows. Their exact counts
verify them; the verified winners, at most 1 / support of them, are broadcast, so that a huge group of copies never
meets in a task. All other digests hold few rows each and take an ordinary shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexengine.llm.common import SPACE, numbered, staged

#: Share of the rows from which a digest counts as a heavy hitter; 1 / SUPPORT bounds the broadcast.
SUPPORT = 1 / 1024


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " ")


def _decided(own: DataFrame, support: float) -> DataFrame:
    """own (id, no, digest) with keep_id, group_size and kept; no tells rows apart that share an id and a text."""
    rows = own.count()
    # Misra-Gries compares keys as objects, so it needs strings: arrays of bytes are equal only to themselves
    suspects = own.select(F.hex("digest").alias("hex")).freqItems(["hex"], max(support, 1e-4))
    suspects = suspects.select(F.explode("hex_freqItems").alias("hex")).select(F.unhex("hex").alias("digest"))
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "no"))
    winners = (
        own.join(F.broadcast(suspects), "digest", "left_semi")
        .groupBy("digest")
        .agg(F.count("*").alias("group_size"), first.alias("first"))
        .filter(F.col("group_size") >= max(2, rows * support))
        .select("digest", "group_size", F.col("first.id").alias("keep_id"), F.col("first.no").alias("keep_no"))
    )
    winners = staged(winners.coalesce(1))  # at most 1 / support rows
    heavy = own.join(F.broadcast(winners), "digest").select("id", "no", "keep_id", "group_size", (F.col("no") == F.col("keep_no")).alias("kept"), "digest")
    group = Window.partitionBy("digest")
    light = own.join(F.broadcast(winners.select("digest")), "digest", "left_anti").select(
        "id", "no",
        F.min("id").over(group).alias("keep_id"),
        F.count("*").over(group).alias("group_size"),
        (F.row_number().over(group.orderBy(F.col("id").asc_nulls_last(), "no")) == 1).alias("kept"),
        "digest",
    )
    return heavy.unionByName(light)


def _digest(text_col: str) -> Column:
    return F.unhex(F.sha2(normalised(F.col(text_col)), 256)).alias("digest")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", support: float = SUPPORT) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256.

    Null texts count as empty; empty texts are copies of each other. The smallest id of a group stays, nulls last; of
    rows that repeat even the id one stays. An empty table gives an empty result, and other columns are not read.
    """
    own = staged(docs.select(F.col(id_col).alias("id"), F.monotonically_increasing_id().alias("no"), _digest(text_col)))
    return _decided(own, support).select(F.col("id").alias(id_col), "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def without_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", support: float = SUPPORT) -> DataFrame:
    """docs without the rows that exact_dedup drops, in docs' columns. Of rows that repeat an id and its text one stays."""
    docs, key = numbered(docs, id_col)
    own = staged(docs.select(F.col(id_col).alias("id"), F.col(key).cast("long").alias("no"), _digest(text_col)))
    kept = staged(_decided(own, support).filter("kept").select(F.col("no").alias("no__")))
    out = docs.join(kept, docs[key].cast("long") == kept["no__"], "left_semi")
    return out.drop("key__")
