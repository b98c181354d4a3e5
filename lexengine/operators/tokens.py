"""Operators that read texts from left to right: tokens, sentences, furigana; and containment of texts."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexengine.functions import japanese as J
from lexengine.functions.text import sentence_at
from lexengine.operators.lookup import batch
from lexengine.staging import skew_join, staged

_LETTERS = re.compile(r"[^\W\d_]+")
#: Characters of texts that a Python worker turns into rows at once.
AT_ONCE = 1 << 19
#: Bits that tell most parts of runs which are no words, before they are shuffled; 64 of them are a row.
BITS = 1 << 24
#: How many runs of letters are broadcast with their sums at most, and the longest of them with its language.
CACHED, LONGEST_CACHED = 1 << 17, 48
#: Terms with readings and places of their downstep.
READINGS = [("打ち込む", "うちこむ", 3), ("食べ物", "たべもの", 2), ("中腰", "ちゅうごし", 0), ("日本語", "にほんご", 0), ("お手前", "おてまえ", 2), ("テスト", "テスト", 1)]


def _entry(lang: Column, word: Column) -> Column:
    """A word and its language as one key, which is not null."""
    return F.concat(F.coalesce(F.concat(F.lit("+"), lang), F.lit("-")), F.lit("\n"), word)


def vocabulary(docs: DataFrame, least: int = 3) -> DataFrame:
    """entry (language and word), size: the words by language (lang) that at least so many texts hold."""
    words = docs.select("lang", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+"), F.lit(0)))).alias("word"))
    count = words.groupBy(_entry(F.col("lang"), F.col("word")).alias("entry"), F.length("word").alias("size")).agg(F.count("*").alias("n"))
    return count.filter(F.col("n") >= least).select("entry", "size")


def segments(text: str, words: set[str], longest: int) -> list[tuple[int, int, bool]]:
    """(start, end, known) of a text's segments: at each place the longest known word, what lies between as one.

    A known word of one character counts only if it is Japanese.
    """
    low = text.lower()
    low = low if len(low) == len(text) else text
    out, i, open_ = [], 0, -1
    while i < len(text):
        for n in range(min(longest, len(text) - i), 0, -1):
            if low[i : i + n] in words and (n > 1 or J.is_japanese(text[i])):
                if open_ >= 0:
                    out.append((open_, i, False))
                    open_ = -1
                out.append((i, i + n, True))
                i += n
                break
        else:
            open_ = i if open_ < 0 else open_
            i += 1
    if open_ >= 0:
        out.append((open_, len(text), False))
    return out


def _frames(rows: Iterator[tuple[int, tuple]], columns: list[str]) -> Iterator[pd.DataFrame]:
    """DataFrames of rows, each given with its characters: about AT_ONCE characters together, however many rows a batch has."""
    some, size = [], 0
    for n, row in rows:
        some.append(row)
        size += n + 64
        if size >= AT_ONCE:
            yield pd.DataFrame(some, columns=columns)
            some, size = [], 0
    if some:
        yield pd.DataFrame(some, columns=columns)


def _runs(batches):
    """mapInPandas body: gaps and runs of letters of each text, runs with how often they stand, and stand behind and before a gap."""

    def rows():
        for b in batches:
            for key, i, lang, text in zip(b["key"], b["doc_id"], b["lang"], b["text"]):
                text = text or ""
                low = text.lower()
                low = low if len(low) == len(text) else text
                found: dict[str, list[int]] = {}
                gaps = end = 0
                for m in _LETTERS.finditer(low):
                    gaps += m.start() > end
                    end = m.end()
                    n = found.setdefault(m[0], [0, 0, 0])
                    n[0] += 1
                    n[1] += m.start() > 0
                    n[2] += end < len(low)
                yield len(text), (key, i, lang, gaps + (end < len(low)), list(found), *([n[k] for n in found.values()] for k in range(3)))

    yield from _frames(rows(), ["key", "doc_id", "lang", "gaps", "run", "n", "behind", "before"])


def _summed(batches):
    """mapInPandas body: of each run its known segments and their characters, all segments, and whether it starts and ends with an unknown one."""

    def rows():
        for b in batches:
            for entry, words in zip(b["entry"], b["words"]):
                run, words = entry.rsplit("\n", 1)[1], set(words)
                own = segments(run, words, max(map(len, words), default=0))
                yield len(entry), (entry, sum(k for *_, k in own), sum(e - s for s, e, k in own if k), len(own), int(not own[0][2]), int(not own[-1][2]))

    yield from _frames(rows(), ["entry", "known", "chars", "segments", "starts", "ends"])


def _run(entry: str) -> Column:
    """What stands behind the language of an entry; words and runs are letters only."""
    return F.substring_index(entry, "\n", -1)


def _frequent(counts: DataFrame, most: int) -> Column:
    """A condition on n, how often a row counts, that at most so many rows of counts fulfil."""
    part = F.floor(F.log2(F.col("n").cast("double")) * 8 + 1e-9)
    least, total = None, 0
    for k, n in sorted(((r.part, r["count"]) for r in counts.groupBy(part.alias("part")).count().collect()), reverse=True):
        total += n
        if total > most:
            break
        least = k
    return F.lit(False) if least is None else part >= least


def _likely(parts: DataFrame, known: DataFrame) -> DataFrame:
    """parts without most of those that are not known: entries whose bit no known entry has, of a fixed number of bits that are broadcast."""
    at = F.pmod(F.xxhash64("entry"), F.lit(BITS))
    bits = known.select(at.alias("at")).groupBy(F.shiftright("at", 6).alias("block")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(at % 64 AS INT))")).alias("bits"))
    rows = parts.withColumn("at", at).withColumn("block", F.shiftright("at", 6)).join(F.broadcast(bits), "block")
    return rows.filter(F.getbit("bits", (F.col("at") % 64).cast("int")) == 1).select(*parts.columns)


def tokenized(docs: DataFrame, known: DataFrame) -> DataFrame:
    """doc_id, n_segments, n_known, known_chars of each text (doc_id, lang, text), by the words of vocabulary().

    Words are letters only, so that each run of letters has its segments whatever stands around it: distinct runs are
    joined with the words, those that are no word by their parts. Between runs, unknown segments are one with the gap.
    """
    known = staged(known)
    longest = known.agg(F.max("size")).first()[0] or 0
    shape = "key long, doc_id long, lang string, gaps long, run array<string>, n array<long>, behind array<long>, before array<long>"
    own = staged(docs.select("doc_id", "lang", "text").withColumn("key", F.monotonically_increasing_id()).mapInPandas(_runs, shape))
    distinct = own.select("lang", F.explode("run").alias("run")).groupBy(_entry(F.col("lang"), F.col("run")).alias("entry")).agg(F.count("*").alias("n"))
    distinct = distinct.join(known.select("entry", F.lit(True).alias("known")), "entry", "left")
    distinct = staged(distinct.withColumn("id", F.monotonically_increasing_id()))
    whole = distinct.filter("known").select("entry", F.array(_run("entry")).alias("words"))
    rest = distinct.filter("known IS NULL").select("id", "entry", _run("entry").alias("run"))
    at = rest.select("id", "entry", "run", F.explode(F.sequence(F.lit(1), F.length("run"))).alias("i"))
    size = F.least(F.length("run") - F.col("i") + 1, F.lit(longest))
    parts = at.filter(size > 0).select("id", "entry", "run", "i", F.explode(F.sequence(F.lit(1), size)).alias("size"))
    prefix = F.expr("left(entry, length(entry) - length(run))")
    word = F.substring("run", F.col("i"), F.col("size"))
    # a part of one character counts only if it is Japanese, and no such one stands before U+3000
    parts = parts.filter((F.col("size") > 1) | (word >= "\u3000")).select("id", F.concat(prefix, word).alias("entry"))
    parts = skew_join(_likely(parts, known), known.select("entry"), ["entry"]).groupBy("id").agg(F.collect_set(_run("entry")).alias("words"))
    rest = rest.join(parts, "id", "left").select("entry", F.coalesce("words", F.array().cast("array<string>")).alias("words"))
    sums = staged(whole.unionByName(rest).mapInPandas(_summed, "entry string, known long, chars long, segments long, starts long, ends long"))
    each = own.select("key", "lang", F.explode(F.arrays_zip("run", "n", "behind", "before")).alias("r"))
    each = each.select("key", _entry(F.col("lang"), F.col("r.run")).alias("entry"), "r.n", "r.behind", "r.before")
    n = F.col("n")
    counted = lambda rows: rows.select(
        "key", (n * F.col("segments") - F.col("behind") * F.col("starts") - F.col("before") * F.col("ends")).alias("s"), (n * F.col("known")).alias("k"), (n * F.col("chars")).alias("c")
    ).groupBy("key").agg(*(F.sum(c).alias(c) for c in "skc"))
    # sums of the most frequent runs, which most places have, are broadcast; the others' places are shuffled
    often = sums.join(distinct.filter(_frequent(distinct.filter(F.length("entry") <= LONGEST_CACHED), CACHED) & (F.length("entry") <= LONGEST_CACHED)).select("entry"), "entry", "left_semi")
    often = staged(often)
    near = each.join(F.broadcast(often), "entry")
    of = counted(near).unionByName(counted(skew_join(each.join(F.broadcast(often.select("entry")), "entry", "left_anti"), sums, ["entry"])))
    of = of.groupBy("key").agg(*(F.sum(c).alias(c) for c in "skc"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    return own.select("key", "doc_id", "gaps").join(of, "key", "left").select("doc_id", (F.col("gaps") + zero("s")).alias("n_segments"), zero("k").alias("n_known"), zero("c").alias("known_chars"))


def middle_sentences(docs: DataFrame) -> DataFrame:
    """doc_id, sentence, offset: around the middle of each text."""

    def run(batches):
        for b in batches:
            found = [sentence_at(t or "", len(t or "") // 2) for t in b["text"]]
            yield pd.DataFrame({"doc_id": b["doc_id"], "sentence": [s for s, _ in found], "offset": [o for _, o in found]})

    return docs.select("doc_id", "text").mapInPandas(run, "doc_id long, sentence string, offset int")


def furigana_table(terms: DataFrame) -> DataFrame:
    """pos, term, part, text, reading, morae and pitch category of each part of each term."""

    def run(batches):
        for b in batches:
            rows = [
                (p, t, k, text, reading, len(J.morae(r)), J.pitch_category(r, pitch))
                for p, t, r, pitch in zip(b["pos"], b["term"], b["reading"], b["pitch"])
                for k, (text, reading) in enumerate(J.furigana(t, r))
            ]
            yield pd.DataFrame(rows, columns=["pos", "term", "part", "text", "reading", "morae", "category"])

    return terms.mapInPandas(run, "pos int, term string, part int, text string, reading string, morae int, category string")


def contained(notes: DataFrame, texts: DataFrame) -> DataFrame:
    """item_id, known: whether a note's text stands in any of texts.

    Words of a note but for the first and the last have edges that a text can't change. Notes and texts meet by the longest
    of these, and are compared there word by word; notes of one or two words, and empty ones, have none.
    """
    split = lambda c: F.split(F.btrim(c), r"\s+")
    own = notes.select(F.col("text").alias("note")).filter("note IS NOT NULL").distinct().withColumn("w", split(F.col("note"))).withColumn("m", F.size("w"))
    inner = F.slice("w", F.lit(2), F.greatest(F.col("m") - 2, F.lit(0)))
    long = own.filter("m > 2").withColumn("at", -F.array_max(F.transform(inner, lambda x, i: F.struct(F.length(x).alias("size"), (-i).alias("i")))).getField("i") + 1)
    long = long.select("note", "m", "at", F.get("w", "at").alias("word"), F.get("w", F.lit(0)).alias("first"), F.get("w", F.col("m") - 1).alias("last"), F.array_join(inner, " ").alias("inner"))
    each = texts.select("text", split(F.col("text")).alias("w")).select("text", "w", F.posexplode("w").alias("pos", "word"))
    start = F.col("pos") - F.col("at")
    meets = (start >= 0) & (start + F.col("m") <= F.size("w"))
    # get() is null outside of a text, slice() would fail before its start
    same = F.get("w", start).endswith(F.col("first")) & F.get("w", start + F.col("m") - 1).startswith(F.col("last"))
    same &= F.array_join(F.slice("w", F.greatest(start + 2, F.lit(1)), F.col("m") - 2), " ") == F.col("inner")
    hits = each.join(batch(long), "word").filter(meets & same & F.col("text").contains(F.col("note"))).select("note")
    # notes without such a word are a query set that is looked for in every text, block by block if it is not small
    met = own.filter("m <= 2").select("note").join(texts.select("text"), F.contains("text", "note")).select("note")
    found = hits.unionByName(met).distinct().withColumn("known", F.lit(True))
    return notes.join(found, F.col("text") == F.col("note"), "left").select("item_id", F.coalesce("known", F.lit(False)).alias("known")).distinct()
