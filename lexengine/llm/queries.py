"""The queries of the llm operators over the test tables, and their SQL where SQL can express them."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from lexengine.llm import bpe, language_id, mixing, near_dedup, pii, quality_model, quality_rules, repeats, token_totals
from lexengine.llm.common import documents, shared_dir, staged
from lexengine.llm.exact_dedup import exact_dedup


def op1_exact_dedup(spark, sf_dir):
    return exact_dedup(documents(spark, sf_dir))


def op2_mix_sources(spark, sf_dir):
    return mixing.mix_sources(documents(spark, sf_dir))


def op3_quality_classifier(spark, sf_dir):
    return quality_model.classify(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op4_minhash_near_dedup(spark, sf_dir):
    return near_dedup.near_duplicates(documents(spark, sf_dir), size=4)


def vocabulary(name: str = "byte_bpe_multi_50k.tiktoken"):
    """A public tokenizer's ranks and its pattern."""
    import public_tokenizers

    return bpe.read_ranks(public_tokenizers.path(name)), public_tokenizers.PATTERN


def op5_byte_bpe(spark, sf_dir):
    return bpe.round_trip(documents(spark, sf_dir), *vocabulary())


def op6_token_totals(spark, sf_dir):
    """All documents come; those marked toxic go; those of low quality are revised, without symbols. The first batch is sent twice."""
    docs = documents(spark, sf_dir).select("doc_id", "source", "lang", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))
    both = F.array(F.struct(F.lit(False).alias("revised"), F.col("text")), F.struct(F.lit(True).alias("revised"), F.regexp_replace("text", "[#*$%&|<>]", "").alias("text")))
    each = docs.select("doc_id", "source", "lang", F.explode(both).alias("b")).select("doc_id", "source", "lang", "b.revised", "b.text")
    rows = staged(token_totals.counted(each).drop("text"))
    came = rows.filter("NOT revised")
    marked = rows.join(labels, "doc_id")
    totals = token_totals.TokenTotals(spark, f"{shared_dir(spark)}/totals-{uuid.uuid4().hex}")
    totals.commit("come", came)
    totals.commit("toxic go", marked.filter("toxic = 1 AND NOT revised").withColumn("sign", F.lit(-1)))
    low = marked.filter("quality = 0 AND toxic = 0")
    totals.commit("low quality revised", low.withColumn("sign", F.when(F.col("revised"), 1).otherwise(-1)))
    totals.compact()
    totals.commit("come", came)
    out = staged(token_totals.rollup(totals.totals()))
    totals.drop()
    return out


def op7_remove_repeats(spark, sf_dir):
    return repeats.remove_repeats(documents(spark, sf_dir))


def op8_language_id(spark, sf_dir):
    return language_id.identify(documents(spark, sf_dir))


def op9_quality_rules(spark, sf_dir):
    return quality_rules.quality_rules(documents(spark, sf_dir))


def op10_pii_surrogates(spark, sf_dir):
    return pii.replace_pii(documents(spark, sf_dir))


OP6_SQL = r"""
WITH l AS (SELECT doc_id, min(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY doc_id),
d AS (SELECT source, lang, CASE WHEN quality = 0 THEN regexp_replace(coalesce(text, ''), '[#*$%&|<>]', '', 'g') ELSE coalesce(text, '') END AS t
      FROM documents LEFT JOIN l ON documents.doc_id = l.doc_id WHERE coalesce(toxic, 0) = 0),
c AS (SELECT source, lang, 'words-1' AS tokenizer_version, len(regexp_extract_all(t, '[^\x20\x09-\x0D]+')) AS n FROM d
      UNION ALL
      SELECT source, lang, 'marks-1', len(regexp_extract_all(t, '[\p{L}\p{N}]+|[^\p{L}\p{N}\x20\x09-\x0D]')) FROM d),
t AS (SELECT source, lang, tokenizer_version, count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS n_tokens FROM c GROUP BY ALL)
SELECT *, 0 AS level FROM t
UNION ALL SELECT source, NULL, tokenizer_version, CAST(sum(n_docs) AS BIGINT), CAST(sum(n_tokens) AS BIGINT), 1 FROM t GROUP BY source, tokenizer_version
UNION ALL SELECT NULL, NULL, tokenizer_version, CAST(sum(n_docs) AS BIGINT), CAST(sum(n_tokens) AS BIGINT), 2 FROM t GROUP BY tokenizer_version"""

OP1_SQL = r"""
WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       row_number() OVER (PARTITION BY text_sha256 ORDER BY doc_id NULLS LAST) = 1 AS kept, text_sha256
FROM d WINDOW g AS (PARTITION BY text_sha256)"""

QUERIES = {
    f.__name__: f
    for f in (
        op1_exact_dedup, op2_mix_sources, op3_quality_classifier, op4_minhash_near_dedup, op5_byte_bpe,
        op6_token_totals, op7_remove_repeats, op8_language_id, op9_quality_rules, op10_pii_surrogates,
    )
}
SQL = {"op1_exact_dedup": OP1_SQL, "op6_token_totals": OP6_SQL, "op9_quality_rules": quality_rules.oracle()}
