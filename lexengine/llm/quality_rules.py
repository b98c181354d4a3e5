"""Quality rules: a threshold table compiled into one Spark projection, without user functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexengine.llm.common import SPACE, SPACE_CHARS

SYMBOLS = "#*$%&|<>"
#: Frequent function words by language.
STOP_WORDS = {
    "de": ["der", "die", "das", "und", "in", "den", "von", "zu", "mit", "sich", "auf", "für", "ist", "im", "dem", "nicht", "ein", "eine", "als", "auch", "es", "an", "werden", "aus", "er", "hat", "dass", "sie", "nach", "bei"],
    "en": ["the", "of", "and", "to", "in", "a", "is", "that", "for", "it", "as", "was", "with", "be", "by", "on", "not", "he", "his", "but", "at", "are", "this", "have", "from", "or", "an", "they", "which", "you"],
    "es": ["de", "la", "que", "el", "en", "y", "a", "los", "se", "del", "las", "un", "por", "con", "no", "una", "su", "para", "es", "al", "lo", "como", "más", "o", "pero", "sus", "le", "ha", "me", "si"],
    "fr": ["de", "la", "le", "et", "les", "des", "en", "un", "du", "une", "que", "est", "pour", "qui", "dans", "a", "par", "plus", "pas", "au", "sur", "ne", "se", "ce", "il", "sont", "avec", "ou", "son", "aux"],
}

#: (rule, counted, per, least and most in hundredths of per or None, from so many words). A text outside fails.
THRESHOLDS = (
    ("word length", "word_chars", "n_words", 150, 2000, 20),
    ("symbols", "n_symbols", "n_words", None, 25, 20),
    ("stop words", "n_stop", "n_words", 2, None, 50),
    ("repeated lines", "n_dup_lines", "n_lines", None, 50, 20),
)


def compiled(thresholds=THRESHOLDS) -> Column:
    """True where every rule holds."""
    verdict = F.lit(True)
    for _, counted, per, least, most, floor in thresholds:
        value, base = F.col(counted) * 100, F.col(per)
        inside = F.lit(True)
        if least is not None:
            inside &= value >= base * least
        if most is not None:
            inside &= value <= base * most
        verdict &= inside | (F.col("n_words") < floor)
    return verdict


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 8) -> DataFrame:
    """The counts that rules draw on, one row per text. Null texts count as empty ones, which have no words.

    Windows of words are compared by 64-bit hashes. Texts without two equal windows stop there; in the others the
    positions of equal windows are found by sorting, so long texts take n log n.
    """
    out = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    trimmed = F.btrim("t", F.lit(SPACE_CHARS))
    out = out.select(
        "id",
        F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE)).alias("words"),
        F.length(F.translate("t", SPACE_CHARS, "")).alias("word_chars"),
        (F.length("t") - F.length(F.translate("t", SYMBOLS, ""))).alias("n_symbols"),
        F.filter(F.split("t", "\n"), lambda x: F.translate(x, SPACE_CHARS, "") != "").alias("lines"),
    )
    stop = sorted({w for words in STOP_WORDS.values() for w in words})
    out = out.select(
        "id", "word_chars", "n_symbols",
        F.size("words").alias("n_words"),
        F.size(F.filter("words", lambda w: F.lower(w).isin(stop))).alias("n_stop"),
        F.size("lines").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).alias("n_dup_lines"),
        F.when(F.size("words") >= window, F.transform(F.sequence(F.lit(1), F.size("words") - (window - 1)), lambda i: F.xxhash64(F.slice("words", i, window)))).alias("hashes"),
    )
    counts = ["id", "n_words", "word_chars", "n_symbols", "n_stop", "n_lines", "n_dup_lines"]
    repeats = F.size(F.array_distinct("hashes")) < F.size("hashes")
    out = out.select(
        *counts, F.when(repeats, F.sort_array(F.transform("hashes", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).alias("ranked")
    )
    twice = F.filter(
        "ranked",
        lambda e, k: F.coalesce(e.h == F.get("ranked", k - 1).h, F.lit(False)) | F.coalesce(e.h == F.get("ranked", k + 1).h, F.lit(False)),
    )
    out = out.select(*counts, F.sort_array(F.transform(twice, lambda e: e.i)).alias("at"))
    covered = F.transform("at", lambda p, k: F.coalesce(F.least(F.get("at", k + 1) - p, F.lit(window)), F.lit(window)))
    return out.select(
        *(F.col(c) if c == "id" else F.col(c).cast("long").alias(c) for c in counts),
        F.coalesce(F.aggregate(covered, F.lit(0).cast("long"), lambda a, x: a + x), F.lit(0)).cast("long").alias("n_repeat_words"),
    )


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", thresholds=THRESHOLDS) -> DataFrame:
    """id, the counts, base_failed and kept: one row per input row, in any order; other columns are not read.

    Null and empty texts have no words and fail the base rule; repeated rows are judged alike.
    """
    out = measured(docs, id_col, text_col)
    failed = (F.col("n_words") < 20) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 30)
    return out.select(
        F.col("id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "n_stop", "n_lines", failed.alias("base_failed"), (~failed & compiled(thresholds)).alias("kept"),
    )


def oracle(thresholds=THRESHOLDS) -> str:
    """The same in DuckDB's SQL."""
    rules = []
    for _, counted, per, least, most, floor in thresholds:
        inside = [f"{counted} * 100 >= {per} * {least}"] * (least is not None) + [f"{counted} * 100 <= {per} * {most}"] * (most is not None)
        rules.append(f"(({' AND '.join(inside)}) OR n_words < {floor})")
    stop = ", ".join("'" + w + "'" for w in sorted({w for words in STOP_WORDS.values() for w in words}))
    return rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS words,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
one AS (SELECT doc_id, words, unnest(range(1, len(words) - 6)) AS i FROM w WHERE len(words) >= 8),
win AS (SELECT doc_id, i, array_to_string(words[i:i + 7], ' ') AS s FROM one),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, s) AS c FROM win) WHERE c > 1),
cover AS (SELECT doc_id, least(8, coalesce(lead(i) OVER (PARTITION BY doc_id ORDER BY i) - i, 8)) AS c FROM twice),
rep AS (SELECT doc_id, CAST(sum(c) AS BIGINT) AS n FROM cover GROUP BY doc_id),
m AS (SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words,
             CAST(length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
             CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
             CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
             coalesce(rep.n, 0) AS n_repeat_words,
             CAST(len(list_filter(words, lambda x: lower(x) IN ({stop}))) AS BIGINT) AS n_stop,
             CAST(len(lines) AS BIGINT) AS n_lines
      FROM w LEFT JOIN rep ON w.doc_id = rep.doc_id),
b AS (SELECT *, n_words < 20 OR n_repeat_words * 100 > n_words * 30 AS base_failed FROM m)
SELECT *, NOT base_failed AND {' AND '.join(rules)} AS kept FROM b"""
