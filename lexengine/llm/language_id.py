"""Language ID by words first: log frequencies of known words, and for unseen words those of character n-grams,
the longest order of which the model knows any.

The model is two tables that keep every counted word and n-gram. Frequent words are broadcast with their rows, as a cache;
the other words of the texts are made distinct and joined with the tables.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexengine.llm.common import held_out, keyed, most_frequent, skew_join, staged, tidy

#: Words whose rows are broadcast; the others get the same rows by joins, so that this changes no result.
CACHED, ORDERS = 1 << 17, (5, 4, 3, 2, 1)
UNKNOWN = "und"
_WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str) -> list[str]:
    """Runs of letters, in lower case."""
    found = _WORD.findall(text.lower())
    if "".join(found).isalpha():
        return found
    return [w for w in found if w.isalpha()] + [v for w in found if not w.isalpha() for v in "".join(c if c.isalpha() else " " for c in w).split()]


def grams_of(word: str, n: int) -> list[str]:
    padded = f"^{word}$" if n > 1 else word
    return [padded[i : i + n] for i in range(len(padded) - n + 1)]


@dataclass
class Model:
    """Log frequencies by language: tables of entry and v0, v1, ... in the order of langs; words have their count n too."""

    langs: list[str]
    words: DataFrame | None = None
    grams: DataFrame | None = None

    @property
    def columns(self) -> list[str]:
        return [f"v{k}" for k in range(len(self.langs))]


def _logs(counts: DataFrame, langs: list[str], order: Column) -> DataFrame:
    """Smoothed log frequencies of all entries, each within its order, which is at least 1."""
    sums = (F.sum(f"v{k}").alias(f"v{k}") for k in range(len(langs)))
    sizes = {r.order: r for r in counts.groupBy(order.alias("order")).agg(F.count("*").alias("entries"), *sums).collect()}

    def total(k):
        by = [float(np.log(sizes[n][f"v{k}"] + 0.5 * sizes[n].entries + 1)) if n in sizes else 0.0 for n in range(1, max(ORDERS) + 1)]
        return F.array(*map(F.lit, by))[order - 1]

    return counts.select("entry", "n", *((F.log(F.col(f"v{k}") + 0.5) - total(k)).alias(f"v{k}") for k in range(len(langs))))


def _grams(words: DataFrame, *cols: Column | str) -> DataFrame:
    """words' cols with every n-gram of word, a row for each place: order, entry."""
    padded = F.when(F.col("order") > 1, F.concat(F.lit("^"), "word", F.lit("$"))).otherwise(F.col("word"))
    each = words.select(*cols, "word", F.explode(F.array(*map(F.lit, ORDERS))).alias("order")).withColumn("p__", padded)
    each = each.filter(F.length("p__") >= F.col("order")).withColumn("i__", F.explode(F.sequence(F.lit(1), F.length("p__") - F.col("order") + 1)))
    return each.select(*cols, "order", F.substring(F.col("p__"), F.col("i__"), F.col("order")).alias("entry"))


def train(docs: DataFrame, text_col="text", lang_col="lang") -> Model:
    """A model of the rows that have a language: all of their words, and all n-grams of these.

    Rows without a text or a language teach nothing; rows that repeat count as often as they stand.
    """
    known = docs.filter(F.col(lang_col).isNotNull()).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    langs = sorted(r.lang for r in known.select("lang").distinct().collect())
    words = known.select("lang", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+"), F.lit(0))).alias("entry"))
    each = (F.count(F.when(F.col("lang") == x, 1)).alias(f"v{k}") for k, x in enumerate(langs))
    counts = staged(words.groupBy("entry").agg(F.count("*").alias("n"), *each))
    seen = counts.agg(F.count("*").alias("entries"), *(F.sum(f"v{k}").alias(f"v{k}") for k in range(len(langs)))).first()
    used = [k for k in range(len(langs)) if seen[f"v{k}"]]
    if not used:
        return Model([])
    langs, counts = [langs[k] for k in used], counts.select("entry", "n", *(F.col(f"v{k}").alias(f"v{i}") for i, k in enumerate(used)))
    # an n-gram counts once for each place in each distinct word of a language
    columns = [f"v{k}" for k in range(len(langs))]
    flags = counts.select(F.col("entry").alias("word"), *((F.col(v) > 0).cast("long").alias(v) for v in columns))
    grams = staged(_grams(flags, *columns).groupBy("entry").agg(F.count("*").alias("n"), *(F.sum(v).alias(v) for v in columns)))
    # n-grams are compared within their order only; each order has its own totals
    return Model(langs, _logs(counts, langs, F.lit(1)), _logs(grams, langs, F.length("entry")).drop("n"))


def _backed_off(unseen: DataFrame, model: Model) -> DataFrame:
    """Rows of unseen words: the mean of their n-grams, of the longest order of which any is known; none if there is none."""
    done, todo = None, unseen
    # nearly all have a known n-gram of the longest order; the rest is tried with all others at once
    for orders in (ORDERS[:1], ORDERS[1:]):
        each = _grams(todo, "word").filter(F.col("order").isin(*orders))
        means = skew_join(each, model.grams, ["entry"]).groupBy("word", "order").agg(*(F.avg(v).alias(v) for v in model.columns))
        best = means.groupBy("word").agg(F.max(F.struct("order", *model.columns)).alias("best")) if len(orders) > 1 else means.select("word", F.struct(*model.columns).alias("best"))
        found = staged(best.select("word", *(F.col(f"best.{v}").alias(v) for v in model.columns)))
        done = found if done is None else done.unionByName(found)
        todo = unseen.join(found, "word", "left_anti")
    return done


class _Known(dict):
    """Places of cached words; a word that isn't cached is noted, and has the place of a row of zeros."""

    def __init__(self, entries: list[str]):
        super().__init__(zip(entries, range(len(entries))))
        self.zeros, self.rest = len(entries), []

    def __missing__(self, word: str) -> int:
        self.rest.append(word)
        return self.zeros


def _predicted(own: DataFrame, model: Model) -> DataFrame:
    """key, id, lang_pred, score of every row of own (id, key, text)."""
    spark, size = own.sparkSession, len(model.langs)
    if not model.langs:
        return own.select("key", "id", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    table = most_frequent(model.words, CACHED, "entry").drop("n").toArrow().combine_chunks()
    cached = spark.sparkContext.broadcast((table["entry"].combine_chunks(), np.column_stack([table[v].to_numpy() for v in model.columns])))

    @tidy
    def run(batches):
        entries, rows = cached.value
        at, rows = _Known(entries.to_pylist()), np.vstack([rows, np.zeros((1, size))])
        for batch in batches:
            some, sums, rest = [], np.zeros((batch.num_rows, size)), []
            for k, text in enumerate(batch["text"].to_pylist()):
                if words := words_of(text) if text else []:
                    sums[k] = rows.take([*map(at.__getitem__, words)], axis=0).sum(axis=0)
                some.append(bool(words))
                rest.append(at.rest)
                at.rest = []
            own = [pa.array(sums[:, k]) for k in range(size)]
            yield pa.RecordBatch.from_arrays([batch["key"], batch["id"], pa.array(some, pa.bool_()), pa.array(rest, pa.list_(pa.string())), *own], ["key", "id", "some", "rest", *(f"s{k}" for k in range(size))])

    kind = own.schema["id"].dataType.simpleString()
    shape = f"key long, id {kind}, some boolean, rest array<string>, " + ", ".join(f"s{k} double" for k in range(size))
    texts = staged(own.select("key", "id", "text").mapInArrow(run, shape))
    rest = texts.select("key", F.explode("rest").alias("word"))
    rows = staged(rest.select("word").distinct().join(model.words.select(F.col("entry").alias("word"), *model.columns), "word", "left"))
    seen = F.col("v0").isNotNull()
    rows = rows.filter(seen).unionByName(_backed_off(rows.filter(~seen).select("word"), model))
    added = skew_join(rest, rows, ["word"]).groupBy("key").agg(*(F.sum(v).alias(v) for v in model.columns))
    total = F.array(*(F.col(f"s{k}") + F.coalesce(f"v{k}", F.lit(0.0)) for k in range(size)))
    out = texts.drop("rest").join(added, "key", "left").select("key", "id", "some", total.alias("total")).withColumn("most", F.array_max("total"))
    best = F.array(*map(F.lit, model.langs))[F.array_position("total", F.col("most")).cast("int") - 1]
    score = 1 / F.aggregate("total", F.lit(0.0), lambda a, x: a + F.exp(x - F.col("most")))
    return out.select("key", "id", F.when(F.col("some"), best).otherwise(UNKNOWN).alias("lang_pred"), F.when(F.col("some"), score).otherwise(0.0).alias("score"))


def predict(docs: DataFrame, model: Model, id_col="doc_id", text_col="text") -> DataFrame:
    """id, lang_pred, score of every row: und and 0 where the text is null or has no letter, or nothing was learned.

    Of languages that score alike the first by code point wins. Repeated rows get equal answers, whole texts are read, other
    columns are not, and an empty table gives an empty result.
    """
    return _predicted(keyed(docs, id_col, text_col), model).select(F.col("id").alias(id_col), "lang_pred", "score")


def identify(docs: DataFrame, id_col="doc_id", text_col="text", lang_col="lang") -> DataFrame:
    """Learns from rows that are not held out and predicts all: id, held_out, lang_pred, score."""
    model = train(docs.filter(~held_out(F.col(id_col))), text_col, lang_col)
    return predict(docs, model, id_col, text_col).select(id_col, held_out(F.col(id_col)).alias("held_out"), "lang_pred", "score")


def in_known_language(docs: DataFrame, id_col="doc_id", text_col="text", lang_col="lang", least: float = 0.5) -> DataFrame:
    """docs without the rows whose language can't be told: null, empty or without letters, or a best language below least.

    Rows that repeat an id are told apart; every column stays as it is, and an empty table gives an empty one.
    """
    model = train(docs.filter(~held_out(F.col(id_col))), text_col, lang_col)
    own = keyed(docs, id_col, text_col)
    if hasattr(own, "staged_at"):  # ids repeat: rows are told apart by a number
        docs = staged(docs.withColumn("key__", F.monotonically_increasing_id()))
        own = docs.select(F.col(id_col).alias("id"), F.col("key__").alias("key"), F.col(text_col).alias("text"))
    else:
        docs = docs.withColumn("key__", F.col(id_col).cast("long"))
    # staged, so that few such rows are broadcast and texts are not shuffled
    out = staged(_predicted(own, model).filter((F.col("lang_pred") == UNKNOWN) | (F.col("score") < least)).select(F.col("key").alias("key__")))
    return docs.join(out, "key__", "left_anti").drop("key__")
