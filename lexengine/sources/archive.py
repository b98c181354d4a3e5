"""Dictionary archives: zip files with an index and numbered banks of JSON arrays, as typed tables.

A bank's rows are positional arrays of mixed types, so they are read as variants and projected by place. Rows that break
the format stop the import with their file and number.
"""

from __future__ import annotations

import io
import zipfile
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexengine.shipping import shipped

VERSIONS = (1, 3)
BANKS = {
    "term": r"\Aterm_bank_\d+\.json\z", "term_meta": r"\Aterm_meta_bank_\d+\.json\z", "kanji": r"\Akanji_bank_\d+\.json\z",
    "kanji_meta": r"\Akanji_meta_bank_\d+\.json\z", "tag": r"\Atag_bank_\d+\.json\z",
}


@dataclass
class Tables:
    dictionaries: DataFrame
    terms: DataFrame
    term_meta: DataFrame
    kanji: DataFrame
    kanji_meta: DataFrame
    tags: DataFrame
    media: DataFrame


def files(spark: SparkSession, path: str) -> DataFrame:
    """archive, name, content of all files of the archives at path."""
    shipped(spark)

    def unpack(batches):
        for b in batches:
            for archive, content in zip(b["path"], b["content"]):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    for name in z.namelist():
                        if not name.endswith("/"):
                            yield pd.DataFrame({"archive": [archive], "name": [name], "content": [z.read(name)]})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(unpack, "archive string, name string, content binary")


def _checked(ok: Column, value: Column, where: Column, what: str) -> Column:
    return F.when(ok, value).otherwise(F.raise_error(F.concat(where, F.lit(f": {what}"))))


def _get(place: int, kind: str = "string") -> Column:
    return F.try_variant_get(F.col("row"), f"$[{place}]", kind)


def _kind(place: int) -> Column:
    return F.schema_of_variant(F.variant_get(F.col("row"), f"$[{place}]", "variant"))


def indexes(all_: DataFrame) -> DataFrame:
    """title, revision, version, sequenced, summary and legacy tags of each archive."""
    j = F.col("content").cast("string")
    v = F.coalesce(F.get_json_object(j, "$.format"), F.get_json_object(j, "$.version")).try_cast("int")
    title, revision = F.get_json_object(j, "$.title"), F.get_json_object(j, "$.revision")
    at = F.concat("archive", F.lit("/index.json"))
    rows = all_.filter("name = 'index.json'")
    return rows.select(
        "archive",
        _checked(title.isNotNull() & (title != ""), title, at, "no title").alias("title"),
        _checked(revision.isNotNull(), revision, at, "no revision").alias("revision"),
        _checked(v.isin(*VERSIONS), v, at, "unknown format").alias("version"),
        F.coalesce(F.get_json_object(j, "$.sequenced").cast("boolean"), F.lit(False)).alias("sequenced"),
        j.alias("summary"),
    )


def bank(all_: DataFrame, index: DataFrame, kind: str) -> DataFrame:
    """dictionary, version, where and row (a variant) of all banks of a kind."""
    own = all_.filter(F.col("name").rlike(BANKS[kind])).join(index.select("archive", F.col("title").alias("dictionary"), "version"), "archive")
    text = F.col("content").cast("string")
    value = F.try_parse_json(text)
    at = F.concat("archive", F.lit("/"), "name")
    listed = _checked(value.isNotNull() & F.schema_of_variant(value).startswith("ARRAY"), F.try_variant_get(value, "$", "array<variant>"), at, "not a list")
    rows = own.select("dictionary", "version", at.alias("at"), F.posexplode(listed).alias("no", "row"))
    return rows.select("dictionary", "version", F.concat("at", F.lit(" row "), "no").alias("at"), _checked(F.schema_of_variant("row").startswith("ARRAY"), F.col("row"), F.col("at"), "not a row").alias("row"))


def _text(place: int) -> Column:
    return _checked(_kind(place) == "STRING", _get(place), F.col("at"), f"no text at {place}")


def _words(place: int) -> Column:
    """A list that stands in a text, apart by single spaces."""
    t = F.coalesce(_get(place), F.lit(""))
    return F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, " "))


def _rest(place: int) -> Column:
    all_ = F.try_variant_get("row", "$", "array<variant>")
    return F.slice(all_, F.lit(place + 1), F.greatest(F.size(all_) - place, F.lit(0)))


def terms(rows: DataFrame) -> DataFrame:
    """Rows of both formats; the first one has its glossary behind the score, the third as a list. Glossaries are JSON."""
    old = F.col("version") == 1
    listed = _checked(old | _kind(5).startswith("ARRAY"), F.try_variant_get("row", "$[5]", "array<variant>"), F.col("at"), "no glossary")
    glossary = F.when(old, _rest(5)).otherwise(listed)
    return rows.select(
        "dictionary",
        _text(0).alias("expression"),
        F.coalesce(F.nullif(_get(1), F.lit("")), _get(0)).alias("reading"),
        _words(2).alias("definition_tags"),
        _words(3).alias("rules"),
        F.coalesce(_get(4, "double"), F.lit(0.0)).alias("score"),
        F.transform(glossary, lambda g: F.to_json(g)).alias("glossary"),
        F.when(old, -1).otherwise(F.coalesce(_get(6, "long"), F.lit(-1))).cast("long").alias("sequence"),
        F.when(old, F.array().cast("array<string>")).otherwise(_words(7)).alias("term_tags"),
    )


def term_meta(rows: DataFrame, name: str = "expression") -> DataFrame:
    mode = _checked(_get(1).isin("freq", "pitch", "ipa") if name == "expression" else _get(1) == "freq", _get(1), F.col("at"), "unknown mode")
    return rows.select("dictionary", _text(0).alias(name), mode.alias("mode"), F.to_json(F.variant_get("row", "$[2]", "variant")).alias("data"))


def kanji(rows: DataFrame) -> DataFrame:
    old = F.col("version") == 1
    meanings = F.when(old, F.transform(_rest(4), lambda g: g.cast("string"))).otherwise(F.try_variant_get("row", "$[4]", "array<string>"))
    stats = F.when(~old, F.from_json(F.to_json(F.try_variant_get("row", "$[5]", "variant")), "map<string,string>"))
    return rows.select("dictionary", _text(0).alias("character"), _words(1).alias("onyomi"), _words(2).alias("kunyomi"), _words(3).alias("tags"), meanings.alias("meanings"), stats.alias("stats"))


def tags(rows: DataFrame, index: DataFrame) -> DataFrame:
    """Tags of banks, and those that old indexes hold themselves."""
    own = rows.select(
        "dictionary", _text(0).alias("name"), F.coalesce(_get(1), F.lit("")).alias("category"),
        F.coalesce(_get(2, "int"), F.lit(0)).alias("ord"), F.coalesce(_get(3), F.lit("")).alias("notes"), F.coalesce(_get(4, "double"), F.lit(0.0)).alias("score"),
    )
    old = F.from_json(F.get_json_object("summary", "$.tagMeta"), "map<string, struct<category: string, order: int, notes: string, score: double>>")
    legacy = index.select(F.col("title").alias("dictionary"), F.explode(old).alias("name", "t"))
    legacy = legacy.select("dictionary", "name", F.coalesce("t.category", F.lit("")).alias("category"), F.coalesce("t.order", F.lit(0)).alias("ord"), F.coalesce("t.notes", F.lit("")).alias("notes"), F.coalesce("t.score", F.lit(0.0)).alias("score"))
    return own.unionByName(legacy)


def media_paths(glossary: Column) -> Column:
    """Paths of images in a glossary item's JSON."""
    return F.regexp_extract_all(glossary, F.lit(r'"path"\s*:\s*"((?:\\.|[^"\\])*)"'), F.lit(1))


def load(spark: SparkSession, path: str) -> Tables:
    all_ = files(spark, path)
    index = indexes(all_)
    rows = {kind: bank(all_, index, kind) for kind in BANKS}
    found = terms(rows["term"])
    wanted = found.select("dictionary", F.explode("glossary").alias("g")).select("dictionary", F.explode(media_paths(F.col("g"))).alias("path")).distinct()
    media = all_.join(index.select("archive", F.col("title").alias("dictionary")), "archive").select("dictionary", F.col("name").alias("path"), "content")
    return Tables(
        index.drop("archive"), found, term_meta(rows["term_meta"]), kanji(rows["kanji"]),
        term_meta(rows["kanji_meta"], "character"), tags(rows["tag"], index), media.join(wanted, ["dictionary", "path"]),
    )


#: The first number of a text.
_NUMBER = r"[+-]?(?:\d+(?:\.\d*)?|\.\d+)(?:[eE][+-]?\d+)?"


def frequencies(meta: DataFrame, name: str = "expression") -> DataFrame:
    """reading (null for all), frequency and display_value of metadata of mode freq, whichever of its forms it has."""
    value = F.parse_json("data")
    inner = F.try_variant_get(value, "$.frequency", "variant")
    own = meta.filter("mode = 'freq'").withColumn("reading", F.try_variant_get(value, "$.reading", "string")).withColumn("f", F.coalesce(inner, value))
    number = F.coalesce(F.try_variant_get("f", "$.value", "double"), F.when(F.schema_of_variant("f") != "STRING", F.try_variant_get("f", "$", "double")))
    text = F.when(F.schema_of_variant("f") == "STRING", F.try_variant_get("f", "$", "string"))
    parsed = F.coalesce(F.regexp_extract(text, _NUMBER, 0).try_cast("double"), F.lit(0.0))
    return own.select("dictionary", name, "reading", F.coalesce(number, parsed).alias("frequency"), F.coalesce(F.try_variant_get("f", "$.displayValue", "string"), text).alias("display_value"))


def pitches(meta: DataFrame) -> DataFrame:
    """reading, position, nasal, devoice, tags of metadata of mode pitch; single places count as lists of one."""
    shape = "struct<reading: string, pitches: array<struct<position: string, nasal: string, devoice: string, tags: array<string>>>>"
    rows = meta.filter("mode = 'pitch'").select("dictionary", "expression", F.from_json("data", shape).alias("d")).select("dictionary", "expression", "d.reading", F.explode("d.pitches").alias("p"))

    def listed(c: str) -> Column:
        one = F.when(F.col(c).isNull(), F.array().cast("array<int>")).when(F.col(c).startswith("["), F.from_json(c, "array<int>"))
        return one.otherwise(F.array(F.col(c).try_cast("int")))

    return rows.select("dictionary", "expression", "reading", "p.position", listed("p.nasal").alias("nasal"), listed("p.devoice").alias("devoice"), F.coalesce("p.tags", F.array().cast("array<string>")).alias("tags"))
