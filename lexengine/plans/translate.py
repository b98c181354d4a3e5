"""The full lookup: texts to ranked entries, as one plan over a batch of queries.

substrings -> variants -> deinflection -> variants -> join with the keys -> parts of speech -> longest match of each row
-> grouping by mode -> ranking.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexengine.functions import text as T
from lexengine.functions.inflections import LANGUAGES
from lexengine.functions.processors import AFTER, BEFORE, variants
from lexengine.operators.deinflect import closure
from lexengine.operators.lookup import term_keys

MODES = ("simple", "split", "group", "term", "merge")


def expanded(queries: DataFrame, resolution: str = "letter") -> DataFrame:
    """query_id, original: each query's text and its beginnings."""
    cut = T.word_substrings if resolution == "word" else T.letter_substrings
    return queries.select("query_id", F.explode(cut(F.col("text"))).alias("original"))


def candidates(originals: DataFrame, language: str, deinflect: bool = True) -> DataFrame:
    """original, transformed, text, conditions, chain of all that each distinct original may stand for."""
    rules = LANGUAGES.get(language) if deinflect else None
    before, after = BEFORE.get(language, []), AFTER.get(language, [])

    def run(batches):
        for b in batches:
            rows = []
            for original in b["original"]:
                for t in variants(original, before) if deinflect else [original]:
                    for text, conditions, trace in closure(rules, t) if rules else [(t, 0, ())]:
                        for v in variants(text, after) if deinflect else [text]:
                            rows.append((original, t, v, conditions, "<".join(trace)))
            if rows:
                yield pd.DataFrame(rows, columns=["original", "transformed", "text", "conditions", "chain"])

    return originals.select("original").distinct().mapInPandas(run, "original string, transformed string, text string, conditions int, chain string")


def flags_of(rules: Column, language: str) -> Column:
    """The flags of a list of parts of speech."""
    flags = LANGUAGES[language].flags if language in LANGUAGES else {}
    if not flags:
        return F.lit(0)
    known = F.create_map(*(x for k, v in flags.items() for x in (F.lit(k), F.lit(v))))
    return F.aggregate(rules, F.lit(0), lambda a, r: a.bitwiseOR(F.coalesce(known[r], F.lit(0))))


def matched(queries: DataFrame, terms: DataFrame, language: str, resolution: str = "letter", deinflect: bool = True) -> DataFrame:
    """Rows that queries reach, each once, by its longest match: query_id, id, source_length, exact, chains."""
    originals = expanded(queries, resolution)
    found = candidates(originals, language, deinflect)
    keys = term_keys(terms).join(terms.select("id", flags_of(F.col("rules"), language).alias("pos")), "id")
    hits = found.join(keys, found["text"] == keys["key"]).filter((F.col("conditions") == 0) | (F.col("conditions").bitwiseAND(F.col("pos")) != 0))
    rows = originals.join(hits, "original")
    size = F.length("transformed")
    best = rows.groupBy("query_id", "id").agg(F.max(size).alias("n"))
    rows = rows.join(best, ["query_id", "id"]).filter(size == F.col("n"))
    return rows.groupBy("query_id", "id").agg(
        F.max(T.utf16_length(F.col("original"))).alias("source_length"),
        F.max(F.col("src") == 0).alias("exact"),
        F.array_sort(F.collect_set("chain")).alias("chains"),
        F.min(F.when(F.col("chain") == "", 0).otherwise(F.size(F.split("chain", "<")))).alias("chain_length"),
    )


def entries(hits: DataFrame, terms: DataFrame, mode: str, main: str | None = None) -> DataFrame:
    """Matched rows as entries of a mode: each row its own, or grouped by headword, by term, or by sequence."""
    rows = hits.join(terms, "id")
    chains = F.to_json("chains")
    by = {
        "simple": ["id"], "split": ["id"], "group": ["expression", "reading", chains.alias("chains_key")],
        "term": ["expression", chains.alias("chains_key")],
        # rows of the main dictionary with a sequence go together, all others by headword
        "merge": [F.when((F.col("dictionary") == main) & (F.col("sequence") >= 0), F.to_json(F.struct("dictionary", "sequence"))).otherwise(F.to_json(F.struct("expression", "reading", "chains"))).alias("merge_key")],
    }[mode]
    return rows.groupBy("query_id", *by).agg(
        F.min_by("expression", F.struct("dict_idx", -F.col("score"), "id")).alias("term"),
        F.min_by("reading", F.struct("dict_idx", -F.col("score"), "id")).alias("first_reading"),
        F.array_sort(F.collect_set("expression")).alias("expressions"),
        F.max("source_length").alias("source_length"),
        F.min("chain_length").alias("chain_length"),
        F.count_if("exact").alias("exact_count"),
        F.min("dict_idx").alias("dict_idx"),
        F.max("score").alias("score"),
        F.count("*").alias("definitions"),
        F.min("id").alias("first_id"),
    )


def find_terms(queries: DataFrame, terms: DataFrame, language: str, mode: str = "group", resolution: str = "letter", deinflect: bool = True, main: str | None = None, frequency: DataFrame | None = None, most: int | None = None) -> DataFrame:
    """Ranked entries of each query (query_id, text).

    terms: id, dictionary, dict_idx, expression, reading, rules, score, sequence; frequency: expression, frequency_order.
    """
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode}")
    found = entries(matched(queries, terms, language, resolution, deinflect), terms, mode, main)
    if frequency is not None:
        found = found.join(frequency.select(F.col("expression").alias("term"), "frequency_order"), "term", "left")
    else:
        found = found.withColumn("frequency_order", F.lit(0).cast("long"))
    order = Window.partitionBy("query_id").orderBy(
        F.desc("source_length"), "chain_length", F.desc("exact_count"), F.col("frequency_order").asc_nulls_last(), "dict_idx",
        F.desc("score"), F.desc(F.length("term")), F.collate("term", "UNICODE"), F.desc("definitions"), "first_id",
    )
    out = found.withColumn("rank", F.row_number().over(order))
    out = out.filter(F.col("rank") <= most) if most else out
    return out.select("query_id", "rank", "term", F.col("first_reading").alias("reading"), "expressions", "source_length", "chain_length", "exact_count", "dict_idx", "score", "definitions")
