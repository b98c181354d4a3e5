"""Mixing sources to target weights, by blocks of words.

The words of each source, its documents in order of id, are packed into blocks of ``block_words``. The mix is a row of
slots, ``shard_slots`` to a shard. For each shard the number of slots of every source is drawn: the whole part of its
expectation, and multinomially the rest. A source's slots are numbered through all shards, and number j takes block
perm(j mod blocks), perm being a keyed Feistel permutation of each pass. Slots and blocks are joined by index.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexengine.llm.common import staged, tidy

WEIGHTS = (5, 2, 1)
MOST_PASSES = 3
BLOCK_WORDS, SHARD_SLOTS, SEED = 128, 1024, 20240


def n_words(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def targets(sizes: list[int], weights=WEIGHTS, most: int = MOST_PASSES) -> list[float]:
    """Words wanted of each source: the total by repeating weights, none above most times its size."""
    total, out = float(sum(sizes)), [0.0] * len(sizes)
    share = [weights[i % len(weights)] for i in range(len(sizes))]
    full: set[int] = set()
    while len(full) < len(sizes):
        rest = total - sum(most * sizes[i] for i in full)
        by = sum(share[i] for i in range(len(sizes)) if i not in full)
        for i in range(len(sizes)):
            out[i] = float(most * sizes[i]) if i in full else rest * share[i] / by
        over = {i for i in range(len(sizes)) if i not in full and out[i] > most * sizes[i]}
        if not over:
            break
        full |= over
    else:
        out = [float(most * s) for s in sizes]
    return out


def running_total(df: DataFrame, key: str, part: str, order: list[str], value: str) -> DataFrame:
    """Adds ``before``: the sum of value over the rows of key that come earlier, by part and then by order.

    Sums within a part and sums of whole parts: no task holds a whole key.
    """
    within = Window.partitionBy(key, part).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    parts = df.groupBy(key, part).agg(F.sum(value).alias("part_sum__"))
    earlier = Window.partitionBy(key).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(key, part, F.coalesce(F.sum("part_sum__").over(earlier), F.lit(0)).alias("part_before__"))
    return (
        df.withColumn("here__", F.coalesce(F.sum(value).over(within), F.lit(0)))
        .join(parts.hint("merge"), [key, part])
        .withColumn("before", (F.col("here__") + F.col("part_before__")).cast("long"))
        .drop("here__", "part_before__")
    )


def permuted(index: np.ndarray, n: int, key: int) -> np.ndarray:
    """A pseudorandom permutation of range(n) at index: four Feistel rounds, walked until inside of the range."""
    half = np.uint64(max(1, (int(n - 1).bit_length() + 1) // 2))
    mask = np.uint64((1 << int(half)) - 1)
    out, todo = index.astype(np.uint64), np.arange(len(index))
    while len(todo):
        x = out[todo]
        left, right = x >> half, x & mask
        for r in range(4):
            z = right + np.uint64((key * 4 + r + 1) * 0x9E3779B97F4A7C15 % 2**64)
            z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            left, right = right, left ^ ((z ^ (z >> np.uint64(31))) & mask)
        out[todo] = x = (left << half) | right
        todo = todo[x >= np.uint64(n)]
    return out.astype(np.int64)


class Mix:
    """A planned mix of docs: rows (each document with its source's figures), pieces, slots and takes."""

    def __init__(self, docs: DataFrame, row_cols: list[str], text_col: str, source_col: str, block_words=BLOCK_WORDS, shard_slots=SHARD_SLOTS, seed=SEED):
        self.block_words, self.shard_slots, self.seed = block_words, shard_slots, seed
        spark = docs.sparkSession
        rows = staged(docs.select(*row_cols, F.col(source_col).alias("source__"), n_words(F.col(text_col)).alias("size")))
        found = rows.groupBy("source__").agg(F.sum("size").alias("s"), F.count("*").alias("n")).orderBy(F.col("source__").asc_nulls_last()).collect()
        self.sizes, n = [int(r.s) for r in found], sum(r.n for r in found)
        self.targets = targets(self.sizes)
        #: blocks of each source, and slots wanted of each
        self.blocks = [-(-s // block_words) for s in self.sizes]
        self.quota = [t * b / s if s else 0.0 for t, b, s in zip(self.targets, self.blocks, self.sizes)]
        known = spark.createDataFrame(
            [(r.source__, i, s, t) for i, (r, s, t) in enumerate(zip(found, self.sizes, self.targets))],
            "source__ string, source_no int, source_size long, target double",
        )
        rows = rows.join(F.broadcast(known), rows["source__"].eqNullSafe(known["source__"])).drop(known["source__"])
        # as many parts of a source as a part has rows: both stay small beside the whole
        part = F.pmod(F.xxhash64(*row_cols), F.lit(max(1, math.isqrt(n))))
        self.rows = staged(running_total(rows.withColumn("part__", part), "source_no", "part__", [*row_cols, "size"], "size").drop("part__"))

    def pieces(self) -> DataFrame:
        """Each document's part of each block: source_no, block, before (of the document), first (word), words."""
        first, end, b = F.col("before"), F.col("before") + F.col("size"), F.lit(self.block_words).cast("long")
        spans = F.sequence(F.floor(first / b), F.floor((end - 1) / b))
        return (
            self.rows.filter("size > 0")
            .select("source_no", "before", "size", F.explode(spans).alias("block"))
            .select(
                "source_no", "block", "before",
                (F.greatest(F.col("block") * b, first) - first).alias("first"),
                (F.least((F.col("block") + 1) * b, end) - F.greatest(F.col("block") * b, first)).alias("words"),
            )
        )

    def slots(self) -> DataFrame:
        """The mix: shard, source_no, block. Slots beyond a source's last pass stay empty."""
        spark = self.rows.sparkSession
        quota, size, seed = np.array(self.quota), self.shard_slots, self.seed
        total = round(float(quota.sum()))
        shards = -(-total // size)
        share = quota / max(quota.sum(), 1e-300)

        def draw(batches):
            for batch in batches:
                for shard in batch["shard"]:
                    want = min(size, total - shard * size) * share
                    whole = np.floor(want + 1e-9).astype(np.int64)
                    rest = np.maximum(want - whole, 0)
                    left = round(float(want.sum())) - int(whole.sum())
                    if left > 0:
                        whole = whole + np.random.default_rng([seed, int(shard)]).multinomial(left, rest / rest.sum())
                    some = np.flatnonzero(whole)
                    yield pd.DataFrame({"shard": int(shard), "source_no": some.astype(np.int32), "n": whole[some]})

        counts = spark.range(0, max(shards, 0), numPartitions=max(1, min(shards // 64, 512))).toDF("shard").mapInPandas(draw, "shard long, source_no int, n long")
        counts = counts.withColumn("part__", F.floor(F.col("shard") / F.lit(max(1, math.isqrt(shards)))))
        counts = running_total(counts, "source_no", "part__", ["shard"], "n")
        blocks, most = np.array(self.blocks, dtype=np.int64), MOST_PASSES

        def place(batches):
            for batch in batches:
                for s, rows in batch.groupby("source_no"):
                    begin, end = rows["before"].to_numpy(), np.minimum(rows["before"] + rows["n"], most * blocks[s]).to_numpy()
                    n = np.maximum(end - begin, 0)
                    # slots of many shards at once, some 2^18 at a time
                    cuts = np.searchsorted(np.cumsum(n), np.arange(0, n.sum(), 1 << 18))
                    for a, b in zip(cuts, [*cuts[1:], len(n)]):
                        own = n[a:b]
                        j = np.arange(own.sum()) + np.repeat(begin[a:b] - np.cumsum(own) + own, own)
                        at = np.empty(len(j), dtype=np.int64)
                        for turn in np.unique(j // blocks[s]):
                            of = j // blocks[s] == turn
                            at[of] = permuted(j[of] % blocks[s], int(blocks[s]), seed * 64 + int(s) * most + int(turn))
                        yield pd.DataFrame({"shard": np.repeat(rows["shard"].to_numpy()[a:b], own), "source_no": np.int32(s), "block": at})

        # few bytes become many slots: as many parts as slots ask for, which Spark doesn't merge
        parts = max(1, min(-(-total // (1 << 16)), 20_000))
        own = counts.select("shard", "source_no", "before", "n").repartition(parts, "shard")
        return own.mapInPandas(place, "shard long, source_no int, block long")

    def mixed(self) -> DataFrame:
        """The mix with its contents: shard, source_no, block, before, first, words."""
        # slots look small to Spark, which doesn't know what a Python function makes of few rows: they must not be broadcast
        return self.slots().hint("merge").join(self.pieces(), ["source_no", "block"])


def mix_sources(docs: DataFrame, id_col="doc_id", text_col="text", source_col="source", **params) -> DataFrame:
    """One row per input row: id, size, source_size, target, taken, source_no.

    Null texts have no words and are not taken; null is a source of its own, the last. Repeated rows are documents of
    their own. An empty table gives an empty result. Other columns are not read. Reruns agree: all draws are keyed.
    """
    mix = Mix(docs, [id_col], text_col, source_col, **params)
    taken = mix.mixed().groupBy("source_no", "before").agg(F.sum("words").alias("taken"))
    with_words = mix.rows.filter("size > 0").join(taken.hint("merge"), ["source_no", "before"], "left")
    out = with_words.unionByName(mix.rows.filter("size = 0").withColumn("taken", F.lit(0).cast("long")))
    return out.select(id_col, "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), "source_no")


def mixed_documents(docs: DataFrame, id_col="doc_id", text_col="text", source_col="source", count_col: str | None = "n_chars", **params) -> DataFrame:
    """The mix as rows in docs' columns: of every document a row for each pass that takes words of it.

    A pass that takes all words keeps the text as it is; otherwise the text is the taken stretches, a line each.
    count_col, if docs have it, is set to the new text's length. Rows that repeat an id are documents of their own.
    """
    cols = docs.columns
    if docs.groupBy(id_col).count().filter(f"count > 1 OR `{id_col}` IS NULL").isEmpty():
        own = docs.withColumn("uid__", F.col(id_col).cast("long"))
    else:
        own = staged(docs.withColumn("uid__", F.monotonically_increasing_id()))
    mix = Mix(own, ["uid__"], text_col, source_col, **params)
    times = mix.mixed().groupBy("source_no", "before", "first", "words").count()
    # stretches of one document: as many as it has blocks
    plan = times.groupBy("source_no", "before").agg(F.array_sort(F.collect_list(F.struct("first", "words", "count"))).alias("plan__"))
    plan = plan.hint("merge").join(mix.rows.select("source_no", "before", "size", "uid__").filter("size > 0"), ["source_no", "before"]).select("uid__", "size", "plan__")
    joined = own.join(plan.hint("merge"), "uid__").select("uid__", F.col(text_col).alias("t__"), "size", "plan__")

    @tidy
    def cut(batches):
        import re

        word = re.compile(r"[^\x20\x09-\x0D]+")
        for batch in batches:
            ids, texts = [], []
            for uid, text, size, plan in zip(batch["uid__"], batch["t__"], batch["size"], batch["plan__"]):
                at = None
                for turn in range(max(p["count"] for p in plan)):
                    runs: list[list[int]] = []
                    for p in plan:
                        if p["count"] > turn:
                            if runs and runs[-1][1] == p["first"]:
                                runs[-1][1] += p["words"]
                            else:
                                runs.append([p["first"], p["first"] + p["words"]])
                    ids.append(uid)
                    if runs == [[0, size]]:
                        texts.append(text)
                    else:
                        at = at or [m.span() for m in word.finditer(text)]
                        texts.append("\n".join(text[at[a][0] : at[b - 1][1]] for a, b in runs))
            yield pd.DataFrame({"uid__": ids, "new__": texts})

    new = joined.mapInPandas(cut, "uid__ long, new__ string")
    out = new.hint("merge").join(own.drop(text_col), "uid__").withColumnRenamed("new__", text_col)
    if count_col in cols:
        out = out.withColumn(count_col, F.length(text_col).cast(docs.schema[count_col].dataType))
    return out.select(*cols)
