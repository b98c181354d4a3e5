"""What a result shows: chains, headwords, definitions, tags, metadata and their orders.

Rows of an entry are (entry, id, dictionary, dict_idx, expression, reading, score, ...). All operators are aggregations by
entry and key, or windows within an entry, so that the rows of an entry meet once and nothing else is gathered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def merged_chains(chains: DataFrame, key: str = "entry") -> DataFrame:
    """Inflection chains (key, source, rules) united by their rules in whatever order; found by two sources it is 'both'.

    The rules keep the order of the chain that came first (idx).
    """
    own = chains.groupBy(key, F.array_sort("rules").alias("signature")).agg(
        F.min_by("rules", "idx").alias("rules"),
        F.when(F.count_distinct("source") > 1, "both").otherwise(F.min("source")).alias("source"),
        F.min("idx").alias("idx"),
    )
    return own.drop("signature")


def merged_processes(chains: DataFrame, key: str = "entry") -> DataFrame:
    """Text-processor chains (key, processors, idx), each set of processors once, as it came first."""
    return chains.groupBy(key, F.array_sort("processors").alias("s")).agg(F.min_by("processors", "idx").alias("processors"), F.min("idx").alias("idx")).drop("s")


def headwords(rows: DataFrame) -> DataFrame:
    """entry, headword, expression, reading, is_primary, dict_idx, n_sources, tags of each entry's headwords.

    headword numbers them: primary ones first, then by dictionary, then as they came (id).
    """
    own = rows.groupBy("entry", "expression", "reading").agg(
        F.bool_or("is_primary").alias("is_primary"), F.min("dict_idx").alias("dict_idx"), F.min("id").alias("first_id"),
        F.count_distinct("id").alias("n_sources"), F.array_join(F.array_sort(F.collect_set("tag")), ",").alias("tags"),
    )
    order = Window.partitionBy("entry").orderBy(F.desc("is_primary"), "dict_idx", "first_id")
    return own.select("entry", (F.row_number().over(order) - 1).alias("headword"), "expression", "reading", "is_primary", "dict_idx", "n_sources", "tags")


def definitions(rows: DataFrame, heads: DataFrame, merge: bool = False) -> DataFrame:
    """Definitions of entries with the numbers of their headwords. With merge, those of one dictionary and content are one."""
    own = rows.join(heads.select("entry", "expression", "reading", "headword"), ["entry", "expression", "reading"])
    by = ["entry", "dictionary", "dict_idx", "content"] if merge else ["entry", "dictionary", "dict_idx", "content", "id"]
    return own.groupBy(*by).agg(
        F.array_sort(F.collect_set("headword")).alias("headwords"),
        F.max("score").alias("score"),
        F.bool_or("is_primary").alias("primary"),
        F.min("id").alias("first_id"),
        F.count("*").alias("n"),
    )


def definition_order(defs: DataFrame, frequency: str = "frequency_order") -> DataFrame:
    """defs with rank: frequency, dictionary, best score, more headwords, their numbers, and how they came."""
    order = Window.partitionBy("entry").orderBy(frequency, "dict_idx", F.desc("score"), F.desc(F.size("headwords")), "headwords", "first_id")
    return defs.withColumn("rank", F.row_number().over(order))


def tag_groups(rows: DataFrame, target: list[str]) -> DataFrame:
    """Names of tags by target and dictionary, each once."""
    return rows.groupBy(*target, "dictionary").agg(F.array_sort(F.collect_set("tag")).alias("tags"))


def tag_order(tags: DataFrame, by: list[str]) -> DataFrame:
    """tags (name, ord) with their place: by order, then by name as a dictionary sorts it."""
    return tags.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy("ord", F.collate("name", "UNICODE"), "name")))


def grouped_tags(rows: DataFrame, heads: DataFrame) -> DataFrame:
    """Tags of an entry, each once, with the numbers of the headwords that have it."""
    own = rows.join(heads.select("entry", "expression", "reading", "headword"), ["entry", "expression", "reading"])
    return own.groupBy("entry", "tag").agg(F.array_sort(F.collect_set("headword")).alias("headwords"))


def meta_for_headwords(heads: DataFrame, meta: DataFrame, needs_reading: bool = False) -> DataFrame:
    """Metadata (expression, reading or null, dict_idx, idx, ...) of headwords, numbered within their entry.

    A row without a reading is for all of an expression's readings, unless it needs one, as pronunciations do.
    """
    m = meta.withColumnRenamed("reading", "meta_reading").withColumnRenamed("dict_idx", "meta_dict_idx")
    fits = F.col("meta_reading") == F.col("reading") if needs_reading else F.col("meta_reading").isNull() | (F.col("meta_reading") == F.col("reading"))
    own = heads.select("entry", "headword", "expression", "reading").join(m, "expression").filter(fits)
    order = Window.partitionBy("entry").orderBy("headword", "meta_dict_idx", "idx")
    return own.withColumn("index", F.row_number().over(order) - 1).withColumn("has_reading", F.col("meta_reading").isNotNull())


def wanted_frequencies(asked: DataFrame, meta: DataFrame) -> DataFrame:
    """Frequencies of asked (pos, term, reading or null): null stands for every reading, and the data's own is given."""
    m = meta.select("expression", F.col("reading").alias("data_reading"), "dictionary", "frequency")
    fits = asked["reading"].isNull() | m["data_reading"].isNull() | (asked["reading"] == m["data_reading"])
    out = asked.join(m, asked["term"] == m["expression"]).filter(fits)
    return out.select("pos", "term", F.coalesce(asked["reading"], "data_reading").alias("reading"), m["data_reading"].isNotNull().alias("has_reading"), "dictionary", "frequency")


def grouped_frequencies(rows: DataFrame, by: list[str]) -> DataFrame:
    """Values by dictionary and what they are of, each once."""
    return rows.groupBy("dictionary", *by).agg(F.array_sort(F.collect_set("frequency")).alias("frequencies"))


def grouped_pronunciations(rows: DataFrame, shape: list[str]) -> DataFrame:
    """Pronunciations of entries by dictionary; those equal in shape are one, with its terms and readings.

    exclusive_terms and exclusive_readings are given where a pronunciation is not that of all of its entry's.
    """
    whole = rows.groupBy("entry").agg(F.array_sort(F.collect_set("expression")).alias("all_terms"), F.array_sort(F.collect_set("reading")).alias("all_readings"))
    own = rows.groupBy("entry", "dictionary", *shape).agg(F.array_sort(F.collect_set("expression")).alias("terms"), F.array_sort(F.collect_set("reading")).alias("readings"))
    none = F.array().cast("array<string>")
    return own.join(whole, "entry").select(
        "entry", "dictionary", *shape, "terms", "readings",
        F.when(F.size("terms") < F.size("all_terms"), F.array_intersect("terms", "all_terms")).otherwise(none).alias("exclusive_terms"),
        F.when(F.size("readings") < F.size("all_readings"), F.array_intersect("readings", "all_readings")).otherwise(none).alias("exclusive_readings"),
    )


def pitch_categories(rows: DataFrame, key: str) -> DataFrame:
    """The pitch categories that a key's pronunciations (position, morae, inflects) have."""
    kind = (
        F.when(F.col("position") == 0, "heiban")
        .when(F.col("inflects") & (F.col("position") > 0), "kifuku")
        .when(F.col("position") == 1, "atamadaka")
        .when(F.col("position") > 1, F.when(F.col("position") >= F.col("morae"), "odaka").otherwise("nakadaka"))
    )
    return rows.groupBy(key).agg(F.array_sort(F.collect_set(kind)).alias("categories"))


def selected_frequency(rows: DataFrame, dictionary: str, ascending: bool = True) -> DataFrame:
    """The least or the greatest number that a term's displayed frequencies in one dictionary hold."""
    numbers = F.transform(F.regexp_extract_all("display", F.lit(r"\d+"), F.lit(0)), lambda x: x.cast("long"))
    own = rows.filter(F.col("dictionary") == dictionary).select("expression", F.explode(numbers).alias("n"))
    return own.groupBy("expression").agg((F.min("n") if ascending else F.max("n")).alias("frequency"))


def grouped_stats(rows: DataFrame, key: str) -> DataFrame:
    """Statistics (key, category, name, ord, content, value) by category, in the order of their tags and contents."""
    order = Window.partitionBy(key, "category").orderBy("ord", F.collate("content", "UNICODE"), "name")
    return rows.withColumn("place", F.row_number().over(order))


def without_form_of(defs: DataFrame) -> DataFrame:
    """Entries without definitions that only point to another form; entries and deinflections left empty are gone."""
    return defs.filter(~F.col("form_of")).groupBy("deinflection", "entry").agg(F.count("*").alias("definitions"))


def excluded(defs: DataFrame, dictionaries: list[str]) -> DataFrame:
    """Definitions without those of excluded dictionaries; headwords that stay are numbered anew (new_headword)."""
    own = defs.filter(~F.col("dictionary").isin(dictionaries))
    kept = own.select("entry", "headword").distinct()
    kept = kept.withColumn("new_headword", F.row_number().over(Window.partitionBy("entry").orderBy("headword")) - 1)
    return own.join(kept, ["entry", "headword"])


def redirected(rows: DataFrame, mark: str = "@@@LINK=") -> DataFrame:
    """Keywords whose text is a link become further expressions of its target (keyword, text); dangling ones are gone."""
    links = rows.filter(F.col("text").startswith(mark)).select(F.col("keyword").alias("alias"), F.trim(F.substring("text", len(mark) + 1, 1 << 20)).alias("target"))
    own = rows.filter(~F.col("text").startswith(mark)).select("keyword", "text", "seq")
    more = links.join(own.withColumnRenamed("keyword", "target"), "target").filter("alias <> target")
    return own.select(F.col("keyword").alias("expression"), "seq", F.lit(False).alias("alias")).unionByName(more.select(F.col("alias").alias("expression"), "seq", F.lit(True).alias("alias")))


def duplicate_notes(notes: DataFrame, existing: DataFrame, scope: str = "collection", all_models: bool = False) -> DataFrame:
    """note_id and the ids of existing notes that have its first field, in its scope: collection, deck, or deck-root with its children.

    Notes that ask the same are looked up once.
    """
    root = lambda c: F.substring_index(c, "::", 1)
    keys = {"first_field": F.col("first_field")}
    if not all_models:
        keys["model"] = F.col("model")
    if scope != "collection":
        keys["deck"] = root(F.col("deck")) if scope == "deck-root" else F.col("deck")
    own = notes.select("note_id", *(c.alias(k) for k, c in keys.items()))
    found = existing.select(F.col("note_id").alias("other"), *(c.alias(k) for k, c in keys.items()))
    found = found.join(own.select(*keys).distinct(), list(keys)).groupBy(*keys).agg(F.array_sort(F.collect_set("other")).alias("found"))
    none = F.array().cast(found.schema["found"].dataType)
    out = own.join(found, list(keys), "left").select("note_id", F.coalesce("found", none).alias("found"))
    return out.select("note_id", F.filter("found", lambda x: x != F.col("note_id")).alias("duplicates"))


def next_update(last: Column, interval: Column) -> Column:
    """When a dictionary is updated next, in milliseconds; never by hand."""
    hour = 3_600_000
    return F.when(interval == "hourly", last + hour).when(interval == "daily", last + 24 * hour).when(interval == "weekly", last + 7 * 24 * hour)


def valid_url(url: Column) -> Column:
    """Whether a URL can be opened: http or https with a host."""
    return F.coalesce(url.rlike(r"\A(?i:https?)://[^/?#\s]+"), F.lit(False))


def cjk_prefix(text: Column) -> Column:
    """What stands before the first character that is no Japanese, Chinese or Korean one and no digit."""
    return F.regexp_extract(text, rf"\A[0-9{CJK}]*", 0)


#: Blocks of Japanese, Chinese and Korean characters.
CJK = (
    r"\x{1100}-\x{11FF}\x{2E80}-\x{2FDF}\x{3000}-\x{312F}\x{3130}-\x{318F}\x{31A0}-\x{31FF}\x{3200}-\x{32FF}\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}"
    r"\x{A960}-\x{A97F}\x{AC00}-\x{D7FF}\x{F900}-\x{FAFF}\x{FF01}-\x{FFEF}\x{20000}-\x{323AF}"
)
