"""Index lookups: a batch of query rows joined with the keys of a terms table.

Queries have pos (their place in the batch) and term. Keys have a row for each of a term's keys: key, src (0 for the
expression, 1 for the reading), id, dictionary, dict_idx. Every lookup is an equi-join; where several queries reach one
id, the first one by (place, source) or (source, place) keeps it, found by an aggregation that combines before it
shuffles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexengine.staging import staged

#: Longest common prefix that prefix lookups use as a key of the join; longer ones are compared afterwards.
PREFIX = 4
#: Hits and keys that form_of joins as one block, and about how many rows a task makes of such blocks.
BLOCK, TASK_PAIRS = (512, 1024), 4_000_000


def enabled(terms: DataFrame, dictionaries: DataFrame) -> DataFrame:
    """terms of the enabled dictionaries (dictionary, dict_idx)."""
    return terms.join(dictionaries, "dictionary")


def term_keys(terms: DataFrame) -> DataFrame:
    keys = F.array(F.struct(F.lit(0).alias("src"), F.col("expression").alias("key")), F.struct(F.lit(1).alias("src"), F.col("reading").alias("key")))
    return terms.select("id", "dictionary", "dict_idx", F.explode(keys).alias("k")).select("k.key", "k.src", "id", "dictionary", "dict_idx")


def _source() -> Column:
    return F.when(F.col("src") == 0, "term").otherwise("reading").alias("match_source")


def batch(queries: DataFrame, most: int = 100_000) -> DataFrame:
    """queries, to be broadcast if there are at most so many, so that the index streams by; larger batches are shuffled with it."""
    return F.broadcast(queries) if queries.limit(most + 1).count() <= most else queries


def _firsts(queries: DataFrame) -> DataFrame:
    return batch(queries.groupBy("term").agg(F.min("pos").alias("first_pos")))


def find_exact(queries: DataFrame, keys: DataFrame) -> DataFrame:
    """Each id once, for the first query and source that reaches it, repeated for every place of that query."""
    hits = _firsts(queries).join(keys, F.col("term") == F.col("key"))
    won = hits.groupBy("id", "dictionary").agg(F.min(F.struct("first_pos", "src", "term")).alias("w")).select("id", "dictionary", "w.src", "w.term")
    return batch(queries).join(won, "term").select("pos", "term", "id", "dictionary", _source(), F.lit("exact").alias("match_type"))


def _by_prefix(queries: DataFrame, keys: DataFrame, value: Column, wanted: Column) -> DataFrame:
    q = queries.filter("term != ''").groupBy("term").agg(F.min("pos").alias("first_pos")).withColumn("want", wanted)
    q = q.withColumn("n", F.least(F.length("want"), F.lit(PREFIX))).withColumn("head", F.substring(F.col("want"), F.lit(1), F.col("n")))
    q = batch(q)
    k = keys.withColumn("value", value)
    k = k.select("*", F.explode(F.sequence(F.lit(1), F.lit(PREFIX))).alias("n")).filter(F.length("value") >= F.col("n"))
    hits = q.join(k.withColumn("head", F.substring(F.col("value"), F.lit(1), F.col("n"))), ["n", "head"]).filter(F.col("value").startswith(F.col("want")))
    won = hits.groupBy("id", "dictionary").agg(F.min(F.struct("src", "first_pos", "term", "value")).alias("w"))
    return won.select(F.col("w.first_pos").alias("pos"), "w.term", "id", "dictionary", "w.src", "w.value")


def find_prefix(queries: DataFrame, keys: DataFrame) -> DataFrame:
    """Keys that start with a query; expressions of all queries go before readings, repeated queries count once."""
    out = _by_prefix(queries, keys, F.col("key"), F.col("term"))
    return out.select("pos", "term", "id", "dictionary", _source(), F.when(F.col("value") == F.col("term"), "exact").otherwise("prefix").alias("match_type"))


def find_suffix(queries: DataFrame, keys: DataFrame) -> DataFrame:
    """Keys that end with a query. Exact is said only of a key whose reverse equals the query."""
    out = _by_prefix(queries, keys, F.reverse("key"), F.reverse("term"))
    return out.select("pos", "term", "id", "dictionary", _source(), F.when(F.col("value") == F.col("term"), "exact").otherwise("suffix").alias("match_type"))


def find_pairs(pairs: DataFrame, terms: DataFrame) -> DataFrame:
    """Terms with both expression and reading of a query (pos, term, reading)."""
    on = (pairs["term"] == terms["expression"]) & (pairs["reading"] == terms["reading"])
    return batch(pairs).join(terms, on).select("pos", "term", pairs["reading"], "id", "dictionary")


def find_sequences(queries: DataFrame, terms: DataFrame) -> DataFrame:
    """Terms of a sequence (pos, query, dictionary) that is not negative."""
    wanted = queries.filter("query >= 0")
    on = (wanted["query"] == terms["sequence"]) & (wanted["dictionary"] == terms["dictionary"])
    return wanted.join(terms, on).select("pos", "query", wanted["dictionary"], "id", "expression", F.lit("sequence").alias("match_source"))


def find_meta(queries: DataFrame, meta: DataFrame) -> DataFrame:
    """Metadata of the queries' expressions, for every place of each; index numbers them within a place."""
    order = Window.partitionBy("pos").orderBy("dictionary")
    hits = queries.join(meta, queries["term"] == meta["expression"])
    return hits.select("pos", "term", "dictionary", "frequency", (F.row_number().over(order) - 1).alias("index"))


def find_tags(requests: DataFrame, tags: DataFrame) -> DataFrame:
    """Requests (name, dictionary, and others) with their tag, by the name before its colon; a missing one is a default."""
    own = requests.withColumn("base", F.substring_index("name", ":", 1))
    known = tags.groupBy("dictionary", F.col("name").alias("base")).agg(F.min(F.struct("id", "category", "ord", "score")).alias("t"))
    out = own.join(known, ["dictionary", "base"], "left")
    category = F.coalesce(F.when(F.col("t.category") == "", "default").otherwise(F.col("t.category")), F.lit("default"))
    return out.select(*requests.columns, category.alias("category"), F.coalesce("t.ord", F.lit(0)).alias("ord"), F.coalesce("t.score", F.lit(0.0)).alias("score"))


def find_characters(queries: DataFrame, characters: DataFrame, meta: DataFrame) -> DataFrame:
    """Characters with their statistics by category, and frequencies where there are any."""
    hits = queries.join(characters, queries["term"] == characters["character"])
    return hits.join(meta, "character", "left").select("pos", "character", "category", "stat", "frequency")


def orphans(contents: DataFrame, users: DataFrame, key: str) -> DataFrame:
    """Contents that nothing refers to."""
    return contents.join(users, key, "left_anti")


def wildcards(queries: DataFrame, text: str = "text") -> DataFrame:
    """term and match of queries as users write them: stars before or behind a term ask for suffixes or prefixes."""
    q = F.col(text)
    kind = F.when(q.rlike(r"\A[*＊]"), "suffix").when(q.rlike(r"[*＊]\z"), "prefix").otherwise("exact")
    return queries.withColumn("match", kind).withColumn("term", F.regexp_replace(q, r"\A[*＊]+|[*＊]+\z", ""))


def form_of(hits: DataFrame, redirects: DataFrame, keys: DataFrame) -> DataFrame:
    """The second pass: terms that hits (id) redirect to (id, form_of), looked up once more in the same dictionary.

    Each hit has a row for each term of its form, so that rows can grow with the square of the tables. They are made once,
    block by block, and not shuffled after it: both sides are distinct before, and where an id has several dictionaries a
    pair counts in the first that both share.
    """
    several = lambda c: F.when(F.size(c) > 1, F.col(c))
    again = hits.join(redirects, "id").filter("form_of IS NOT NULL").groupBy("pos", F.col("id").alias("source_id"), "form_of").agg(F.collect_set("dictionary").alias("all"))
    again = staged(again.select("pos", "source_id", "form_of", F.explode("all").alias("own"), several("all").alias("owns")))
    forms = again.groupBy("form_of", "own").agg(F.count("*").alias("n_hits"))
    found = keys.join(batch(forms), (F.col("key") == F.col("form_of")) & (F.col("dictionary") == F.col("own"))).groupBy("form_of", "id").agg(F.collect_set("dictionary").alias("all"))
    found = staged(found.select("form_of", "id", F.explode("all").alias("own"), several("all").alias("shared")))
    sizes = forms.join(found.groupBy("form_of", "own").agg(F.count("*").alias("n_found")), ["form_of", "own"])
    pairs = sizes.agg(F.sum(F.col("n_hits") * F.col("n_found"))).first()[0] or 0
    tasks = max(int(hits.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(-(-pairs // TASK_PAIRS), 20_000))
    blocks = batch(sizes.select("form_of", "own", F.ceil(F.col("n_hits") / BLOCK[0]).alias("h"), F.ceil(F.col("n_found") / BLOCK[1]).alias("f")))
    on = ["form_of", "own", "hit_block", "found_block"]
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    one = lambda n, *c: F.pmod(F.xxhash64(*c), F.col(n))
    left = again.join(blocks, ["form_of", "own"]).select(*again.columns, one("h", "pos", "source_id").alias("hit_block"), every("f").alias("found_block"))
    right = found.join(blocks, ["form_of", "own"]).select(*found.columns, every("h").alias("hit_block"), one("f", "id").alias("found_block"))
    both = left.repartition(tasks, *on).join(right.repartition(tasks, *on), on).filter(F.col("id") != F.col("source_id"))
    first = F.col("owns").isNull() | F.col("shared").isNull() | (F.array_min(F.array_intersect("owns", "shared")) == F.col("own"))
    return both.filter(first).select("pos", "source_id", "form_of", "id")
