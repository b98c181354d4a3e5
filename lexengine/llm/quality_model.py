"""Quality classifier: naive Bayes support vectors.

Texts become indicators of hashed n-grams of bytes and words. Each indicator is scaled by the log-count ratio of its
n-gram between the classes, vectors have length 1, and a linear hinge loss is minimised by dual coordinate descent.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexengine.llm import vectors as V
from lexengine.llm.common import held_out

BITS = 18
#: Labelled rows of each class that a model is fitted on, at most: those with the smallest hashes of their ids.
SAMPLE = 3000
EPOCHS, COST, SMOOTH, SHARP = 20, 1.0, 1.0, 4.0


def features(column: pa.Array):
    """The sorted indicators of each text: bytes 1 to 4 at a time, words, pairs of words and runs of one word."""
    mark = np.zeros(1 << BITS, dtype=bool)
    shift = np.uint64(64 - BITS)
    for _, data, off in V.chunks(column):
        start, end, row = V.words(data, off)
        pre = V.prefix(data)
        word = V.spans(pre, start, end)
        word_at = np.searchsorted(row, np.arange(len(off)), side="left")
        grams, code = [], np.zeros(len(data), dtype=np.uint64)
        wide = data.astype(np.uint64)
        for n in range(1, 5):
            size = max(0, len(data) - n + 1)
            code = code[:size] * np.uint64(256) + wide[n - 1 : n - 1 + size]
            grams.append(V.mixed(code + np.uint64(n << 40)) >> shift)
        for i in range(len(off) - 1):
            a, b = off[i], off[i + 1]
            for n, g in enumerate(grams, 1):
                mark[g[a : max(a, b - n + 1)].astype(np.int64)] = True
            own = word[word_at[i] : word_at[i + 1]]
            mark[(V.mixed(own + np.uint64(1)) >> shift).astype(np.int64)] = True
            mark[(V.mixed(own[:-1] * np.uint64(31) + own[1:]) >> shift).astype(np.int64)] = True
            same, k = own[:-1] == own[1:], 2
            while k <= 6 and same.any():
                mark[int(V.mixed(np.array([k << 50], dtype=np.uint64))[0] >> shift)] = True
                same, k = same[:-1] & (own[k:] == own[: len(own) - k]) if len(own) > k else same[:0], k + 1
            found = np.flatnonzero(mark).astype(np.int32)
            mark[found] = False
            yield found


def fit(rows: list[np.ndarray], labels: np.ndarray) -> np.ndarray:
    """Weights of the indicators, the bias last. With one class or none only the bias, so that its share is the score."""
    width = 1 << BITS
    weights = np.zeros(width + 1)
    ones = int(labels.sum())
    if not 0 < ones < len(labels):
        weights[-1] = 0.0 if not len(labels) else 8.0 if ones else -8.0
        return weights
    counts = np.full((2, width), SMOOTH)
    for x, y in zip(rows, labels):
        counts[int(y), x] += 1
    ratio = np.log(counts[1] / counts[1].sum()) - np.log(counts[0] / counts[0].sum())
    length = np.array([np.sqrt((ratio[x] ** 2).sum()) or 1.0 for x in rows])
    sign = np.where(labels == 1, 1.0, -1.0)
    cost = np.where(labels == 1, COST * len(labels) / (2 * ones), COST * len(labels) / (2 * (len(labels) - ones)))
    w, bias, alpha = np.zeros(width), 0.0, np.zeros(len(rows))
    order = np.random.default_rng(7)
    for _ in range(EPOCHS):
        for i in order.permutation(len(rows)):
            x = rows[i]
            values = ratio[x] / length[i]
            slope = sign[i] * (w[x] @ values + bias) - 1
            new = min(max(alpha[i] - slope / 2.0, 0.0), cost[i])  # a vector's square is 1, and the bias's 1
            if step := (new - alpha[i]) * sign[i]:
                w[x] += step * values
                bias += step
                alpha[i] = new
    weights[:-1], weights[-1] = w * ratio, bias
    return np.concatenate([weights, ratio**2])


def train(docs: DataFrame, labels: DataFrame, id_col="doc_id", text_col="text", label_col="quality", sample=SAMPLE) -> np.ndarray:
    """Fits on the labelled rows that are not held out, at most sample of each class. Of conflicting labels the lower holds."""
    spark = docs.sparkSession
    known = labels.filter(F.col(label_col).isin(0, 1) & ~held_out(F.col(id_col)) & F.col(id_col).isNotNull())
    known = known.groupBy(F.col(id_col).alias("id")).agg(F.min(label_col).cast("int").alias("label"))
    order = [F.xxhash64("id"), F.col("id")]
    one, zero = (known.filter(F.col("label") == y).orderBy(*order).limit(sample) for y in (1, 0))
    own = docs.select(F.col(id_col).alias("own"), F.col(text_col).alias("t"))
    chosen = own.join(F.broadcast(one.unionByName(zero)), F.col("own") == F.col("id")).select("id", "label", "t")

    def encode(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b["id"], b["label"], pa.array([x.tobytes() for x in features(b["t"])], pa.binary())], ["id", "label", "x"])

    def solve(batches):
        rows = sorted(((i, y, x) for b in batches for i, y, x in zip(b["id"], b["label"], b["x"])), key=lambda r: (r[0], r[1], r[2]))
        rows_x = [np.frombuffer(x, dtype=np.int32) for _, _, x in rows]
        yield pd.DataFrame({"w": [fit(rows_x, np.array([y for _, y, _ in rows])).astype(np.float32).tobytes()]})

    kind = docs.schema[id_col].dataType.simpleString()
    coded = chosen.mapInArrow(encode, f"id {kind}, label int, x binary")
    # at most twice sample rows, so one task holds them
    found = coded.repartition(1).mapInPandas(solve, "w binary").collect()
    return np.frombuffer(found[0].w, dtype=np.float32) if found else np.zeros((1 << BITS) + 1, dtype=np.float32)


def score(docs: DataFrame, weights: np.ndarray, id_col="doc_id", text_col="text") -> DataFrame:
    """id and score of every row. Null and empty texts have no indicators: their score is the bias's."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)
    width = 1 << BITS

    def run(batches):
        w = shared.value[:width].astype(np.float64)
        bias, square = float(shared.value[width]), shared.value[width + 1 :].astype(np.float64)
        for b in batches:
            out = []
            for x in features(b["t"]):
                length = np.sqrt(square[x].sum()) if len(square) else 0.0
                out.append(1 / (1 + np.exp(-SHARP * np.clip((w[x].sum() / length if length else 0.0) + bias, -50, 50))))
            yield pa.RecordBatch.from_arrays([b["id"], pa.array(out, pa.float64())], ["id", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")).mapInArrow(run, f"id {kind}, score double")
    return out.withColumnRenamed("id", id_col)


def classify(docs: DataFrame, labels: DataFrame, id_col="doc_id", text_col="text", label_col="quality", sample=SAMPLE) -> DataFrame:
    """id, held_out, score, predicted: one row per input row. Labels of unknown ids, null labels and others than 0 and 1 don't count."""
    weights = train(docs, labels, id_col, text_col, label_col, sample)
    out = score(docs, weights, id_col, text_col)
    return out.select(id_col, held_out(F.col(id_col)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
