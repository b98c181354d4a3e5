"""Entries of lookups: grouping, merging, exclusion, tags, frequencies and ranking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Where an ascending order has no frequency.
NO_FREQUENCY = 9007199254740991


def _listed(c: str) -> Column:
    return F.array_join(F.array_sort(F.collect_set(c)), ",")


def grouped(terms: DataFrame, keys: list[str]) -> DataFrame:
    """Terms grouped by headword or by term: best score, first dictionary, definitions and tags."""
    return terms.groupBy(*keys).agg(
        F.max("score").alias("score"),
        F.min("dict_idx").cast("long").alias("dict_idx"),
        F.count("*").alias("definitions"),
        _listed("tag").alias("tags"),
    )


def merged_by_sequence(terms: DataFrame, related: DataFrame) -> DataFrame:
    """Sequences of the main dictionary with all rows that share them, and the unsequenced rows of their headwords."""
    own = terms.select("dictionary", "sequence", "id", "expression", "reading", "score")
    heads = own.select("dictionary", "sequence", "expression", "reading").distinct()
    more = related.join(heads.select("sequence", F.col("dictionary").alias("main"), "expression", "reading"), ["expression", "reading"])
    more = more.select(F.col("main").alias("dictionary"), "sequence", "id", "expression", "reading", "score")
    rows = own.withColumn("is_primary", F.lit(True)).unionByName(more.withColumn("is_primary", F.lit(False)))
    return rows.groupBy("dictionary", "sequence").agg(
        F.count("*").alias("n"),
        F.count_if("is_primary").alias("n_primary"),
        F.max("score").alias("score"),
        _listed("expression").alias("expressions"),
    )


def longest(deinflected: DataFrame) -> DataFrame:
    """Of the sources (source) that reach a term (term), the longest; those of its length are kept together."""
    n = deinflected.groupBy("term").agg(F.max(F.length("source")).alias("source_length"))
    rows = deinflected.join(n, "term").filter(F.length("source") == F.col("source_length"))
    return rows.groupBy("term", "source_length").agg(_listed("source").alias("sources"))


def without_dictionaries(terms: DataFrame, excluded: list[str]) -> DataFrame:
    """Entries by expression without the definitions of excluded dictionaries; entries left empty are gone."""
    return terms.filter(~F.col("dictionary").isin(excluded)).groupBy("expression").agg(F.count("*").alias("definitions"), F.min("dict_idx").cast("long").alias("dict_idx"))


def secondary(terms: DataFrame, main: str, other: str) -> tuple[DataFrame, DataFrame]:
    """Rows of another dictionary that belong to headwords of the main one, and those that belong to none."""
    heads = terms.filter(F.col("dictionary") == main).select("expression", "reading", "sequence").distinct()
    rows = terms.filter(F.col("dictionary") == other).select("id", "expression", "reading")
    return rows.join(heads, ["expression", "reading"]), rows.join(heads, ["expression", "reading"], "left_anti")


def similar_tags(tags: DataFrame) -> DataFrame:
    """Tags of one name and category in one: least order, best score, all dictionaries."""
    return tags.groupBy("name", "category").agg(F.min("ord").alias("ord"), F.max("score").alias("score"), _listed("dictionary").alias("dictionaries"))


def redundant_tags(terms: DataFrame) -> DataFrame:
    """Whether a definition's tags repeat those of the one before it, in its entry and dictionary."""
    order = Window.partitionBy("expression", "dictionary").orderBy("id")
    return terms.select("id", "expression", "dictionary", F.coalesce(F.lag("tag").over(order) == F.col("tag"), F.lit(False)).alias("redundant"))


def sort_frequency(terms: DataFrame, meta: DataFrame, dictionary: str, ascending: bool = True) -> DataFrame:
    """Each expression's frequency in one dictionary, as a key to sort by."""
    best = F.min("frequency") if ascending else -F.max("frequency")
    known = meta.filter(F.col("dictionary") == dictionary).groupBy("expression").agg(best.alias("f"))
    default = NO_FREQUENCY if ascending else 0
    return terms.select("expression").distinct().join(known, "expression", "left").select("expression", F.coalesce("f", F.lit(default)).cast("long").alias("frequency_order"))


def harmonic(meta: DataFrame, key: str = "expression") -> DataFrame:
    """floor of the harmonic and of the arithmetic mean of positive frequencies."""
    some = meta.filter("frequency > 0")
    return some.groupBy(key).agg(
        F.floor(F.count("*") / F.sum(F.lit(1.0) / F.col("frequency")) + F.lit(1e-9)).cast("long").alias("harmonic"),
        F.floor(F.sum("frequency") / F.count("*")).cast("long").alias("average"),
    )


def displayed_frequencies(meta: DataFrame) -> DataFrame:
    """Frequencies by dictionary and term, with a dictionary Average of harmonic means."""
    each = meta.select("dictionary", "expression", F.col("frequency").cast("long").alias("frequency")).distinct()
    mean = harmonic(meta).select(F.lit("Average").alias("dictionary"), "expression", F.col("harmonic").alias("frequency"))
    return each.unionByName(mean)


def popularity(tags: DataFrame) -> DataFrame:
    """popular, rare or normal, by the sum of the scores of a term's tags."""
    s = F.sum("score")
    return tags.groupBy("expression").agg(F.when(s > 0, "popular").when(s < 0, "rare").otherwise("normal").alias("popularity"))


def ranked(hits: DataFrame) -> DataFrame:
    """rank of each hit in its query: matches of terms first, then frequency, dictionary, score, longer and smaller terms."""
    order = Window.partitionBy("pos").orderBy(
        (F.col("match_source") == "term").desc(), "frequency_order", "dict_idx", F.desc("score"), F.desc(F.length("expression")), "expression", "id"
    )
    return hits.withColumn("rank", F.row_number().over(order))


def number_of(text: Column) -> Column:
    """The first number that a text holds, 0 where it has none."""
    found = F.regexp_extract(text, r"[+-]?(?:\d+(?:\.\d*)?|\.\d+)(?:[eE][+-]?\d+)?", 0)
    return F.coalesce(found.try_cast("double"), F.lit(0.0))


def newer(current: Column, latest: Column) -> Column:
    """Whether latest is newer than current: dotted numbers of one length by number, all else as text."""
    dotted = r"\A\d+(\.\d+)*\z"
    a, b = (F.transform(F.split(c, r"\."), lambda x: x.cast("int")) for c in (current, latest))
    numbers = current.rlike(dotted) & latest.rlike(dotted) & (F.size(a) == F.size(b))
    return F.when(numbers, a < b).otherwise(current < latest)


def entry_sequences(terms: DataFrame, main: str) -> DataFrame:
    """The sequence that all rows of an expression in the main dictionary share, -1 where they differ or there are none."""
    own = F.when(F.col("dictionary") == main, F.col("sequence"))
    return terms.groupBy("expression").agg(F.coalesce(F.when(F.min(own) == F.max(own), F.min(own)), F.lit(-1)).cast("long").alias("sequence"))


def readings(terms: DataFrame) -> DataFrame:
    """Each expression's readings and dictionaries, each once."""
    return terms.groupBy("expression").agg(_listed("reading").alias("readings"), _listed("dictionary").alias("dictionaries"))


def first_of(rows: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """The value of the first row of each key."""
    return rows.groupBy(key).agg(F.min_by(value, order).alias(value))


def disambiguations(terms: DataFrame, shown: DataFrame, key: str = "reading") -> DataFrame:
    """Expressions of each key that are not shown for it: what a reader could mistake it for."""
    rows = terms.select(key, "expression").distinct().join(shown, [key, "expression"], "left_anti")
    return rows.groupBy(key).agg(F.count("*").alias("n"), _listed("expression").alias("others"))


def frequency_runs(meta: DataFrame) -> DataFrame:
    """The first frequency of each run of one dictionary, in the order of an entry's metadata (expression, idx); only positive ones."""
    order = Window.partitionBy("expression").orderBy("idx")
    changed = F.coalesce(F.lag("dictionary").over(order) != F.col("dictionary"), F.lit(True))
    return meta.withColumn("changed", changed).filter("changed AND frequency > 0").select("expression", "idx", "dictionary", "frequency")


def durations(rows: DataFrame, by: str, value: str) -> DataFrame:
    """Mean and 95th percentile of a value."""
    return rows.groupBy(by).agg(F.avg(value).alias("mean"), F.percentile(value, 0.95).alias("p95"), F.count("*").alias("n"))
