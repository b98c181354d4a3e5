"""The test tables as a dictionary database: terms, metadata, tags, characters and words of texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexengine.shipping import shipped


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    shipped(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, dictionary, expression, reading, tag, score, sequence, dict_idx: the enabled dictionaries in order of name."""
    part = table(spark, sf_dir, "part")
    own = part.select(
        F.col("p_partkey").alias("id"), F.col("p_type").alias("dictionary"), F.col("p_name").alias("expression"),
        F.split_part("p_name", F.lit(" "), F.lit(2)).alias("reading"), F.col("p_brand").alias("tag"),
        F.col("p_size").cast("double").alias("score"), (F.col("p_partkey") % 50).alias("sequence"),
    )
    return own.join(F.broadcast(dictionaries(part)), "dictionary")


def dictionaries(part: DataFrame) -> DataFrame:
    """The few dictionaries, numbered; a table of settings."""
    return part.select(F.col("p_type").alias("dictionary")).distinct().withColumn("dict_idx", F.row_number().over(Window.orderBy("dictionary")) - 1)


def frequencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """dictionary, expression, frequency: how many lines of a part's name have each flag."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_partkey", "l_returnflag").agg(F.count("*").alias("n"))
    names = table(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("expression"))
    rows = lines.join(names, lines["l_partkey"] == names["p_partkey"])
    return rows.groupBy(F.col("l_returnflag").alias("dictionary"), "expression").agg(F.sum("n").alias("frequency"))


def tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """dictionary, name, id, category, ord, score: brands up to number 20 have a tag."""
    own = terms(spark, sf_dir).select("dictionary", F.col("tag").alias("name")).distinct()
    number = F.split_part("name", F.lit("#"), F.lit(2)).cast("int")
    return own.select("dictionary", "name", number.alias("id"), F.lit("brand").alias("category"), number.alias("ord"), (F.lit(10.0) - number).alias("score")).filter("ord <= 20")


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """language, source: the distinct words of the texts, in lower case."""
    docs = table(spark, sf_dir, "documents")
    found = docs.select(F.col("lang").alias("language"), F.explode(F.regexp_extract_all("text", F.lit(r"\p{L}+"), F.lit(0))).alias("w"))
    return found.select("language", F.lower("w").alias("source")).distinct()
