"""Byte-level BPE: words encoded by a fold of ranked merges in Spark's higher-order functions.

Bytes are handled as strings of the ISO-8859-1 characters with their values, and the ranks are a literal: an array of
small maps, chosen by a checksum of the piece, since Spark looks a map's keys up one after another. Words that texts
hold most often, WORDS of them at most, are encoded once by that fold; their ids are broadcast to the encoder of texts.
The other words are merged in the encoder, by the same rule: figures are in the README.
Decoding looks every id's bytes up in a literal array and concatenates them.
"""

from __future__ import annotations

import base64
import heapq
import json
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexengine.llm.common import most_frequent, released, short_plans, staged, trimmed

#: Most frequent words whose ids are broadcast, and the bytes that one may have; the product bounds the broadcast.
WORDS, WORD_BYTES = 1 << 18, 48
_BUCKETS = 8192
_FLUSH = 50_000
#: White space as the tokenizer's library has it; Python's own class has four more characters.
_SPACE = r"\t\n\x0b\x0c\r \x85\xa0  -     　"


def read_ranks(path: str) -> dict[bytes, int]:
    """The ranks of a vocabulary file, read on the driver."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}


@lru_cache(maxsize=8)
def matcher(pattern: str):
    import regex

    return regex.compile(pattern.replace(r"[^\s", f"[^{_SPACE}").replace(r"\s", f"[{_SPACE}]").replace(r"\S", f"[^{_SPACE}]"))


def rank_table(ranks: dict[bytes, int]) -> Column:
    """The ranks as a literal."""
    buckets: list[dict[str, int]] = [{} for _ in range(_BUCKETS)]
    for piece, rank in ranks.items():
        text = piece.decode("latin-1")
        buckets[zlib.crc32(text.encode()) % _BUCKETS][text] = rank
    return F.from_json(F.lit(json.dumps(buckets, ensure_ascii=False)), "array<map<string,int>>")


def rank_in(table: Column, piece: Column) -> Column:
    """The piece's rank, null where there is none."""
    return F.try_element_at(F.get(table, (F.crc32(piece.cast("binary")) % _BUCKETS).cast("int")), piece)


def _let(value: Column, body) -> Column:
    """body(value) with value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def encoded(word: Column, ranks: dict[bytes, int]) -> Column:
    """The ids of a word: its own if it is in the vocabulary; else merges of the least rank, the first one of equals, until none is left."""
    text = F.decode(word.cast("binary"), "ISO-8859-1")
    # the literal stands in the expression once, and is known to the rest of it by a variable
    return _let(rank_table(ranks), lambda table: _folded(text, lambda piece: rank_in(table, piece)))


def _folded(text: Column, rank) -> Column:
    """The ids of a text of ISO-8859-1 characters; rank gives a column of pieces their ranks."""

    def merged(pieces: Column, found: Column) -> Column:
        def at(k: Column) -> Column:
            both = F.concat(F.get(pieces, k - 1), F.get(pieces, k))
            return F.concat(F.slice(pieces, F.lit(1), k - 1), F.array(both), F.slice(pieces, k + 2, F.size(pieces)))

        least = F.array_min(found)
        return F.when(least.isNull(), F.struct(pieces.alias("p"), F.lit(False).alias("more"))).otherwise(
            F.struct(_let(F.array_position(found, least).cast("int"), at).alias("p"), F.lit(True).alias("more"))
        )

    def step(state: Column, _: Column) -> Column:
        pieces = state["p"]
        pairs = F.transform(F.slice(pieces, F.lit(2), F.size(pieces)), lambda b, i: rank(F.concat(F.get(pieces, i), b)))
        return F.when(state["more"] & (F.size(pieces) > 1), _let(pairs, lambda found: merged(pieces, found))).otherwise(state)

    def fold(t: Column) -> Column:
        start = F.struct(F.split(t, "").alias("p"), F.lit(True).alias("more"))
        done = F.aggregate(F.sequence(F.lit(1), F.length(t)), start, step)["p"]
        return F.transform(done, rank)

    return _let(text, lambda t: F.when(t == "", F.array().cast("array<int>")).otherwise(_let(rank(t), lambda r: F.when(r.isNotNull(), F.array(r)).otherwise(fold(t)))))


def decoded(ids: Column, ranks: dict[bytes, int]) -> Column:
    """The bytes of ids, concatenated."""
    pieces = [""] * (max(ranks.values(), default=-1) + 1)
    for piece, rank in ranks.items():
        pieces[rank] = piece.decode("latin-1")
    literal = F.from_json(F.lit(json.dumps(pieces, ensure_ascii=False)), "array<string>")
    return F.encode(F.array_join(F.transform(ids, lambda i: F.get(literal, i)), ""), "ISO-8859-1")


def merge(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of a word, as ``encoded`` has them; n log n for long ones."""
    if (own := ranks.get(word)) is not None:
        return [own]
    if len(word) <= 64:
        # a merged piece's rank is its id, so ids are kept in place of pieces
        get, none, edge = ranks.get, 1 << 60, list(range(len(word) + 1))
        ids = [ranks[word[i : i + 1]] for i in range(len(word))]
        found = [get(word[i : i + 2], none) for i in range(len(word) - 1)]
        while found and (best := min(found)) < none:
            i = found.index(best)
            ids[i] = best
            del edge[i + 1], found[i], ids[i + 1]
            if i < len(found):
                found[i] = get(word[edge[i] : edge[i + 2]], none)
            if i:
                found[i - 1] = get(word[edge[i - 1] : edge[i + 1]], none)
        return ids
    end = list(range(1, len(word) + 1))  # of the piece at each place; 0 once it is merged away
    before = list(range(-1, len(word) - 1))
    heap = [(r, i, i + 2) for i in range(len(word) - 1) if (r := ranks.get(word[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, stop = heapq.heappop(heap)
        if not end[i] or end[i] >= len(word):
            continue
        j = end[i]
        if end[j] != stop:
            continue
        end[i], end[j] = stop, 0
        if stop < len(word):
            before[stop] = i
            if (r := ranks.get(word[i : end[stop]])) is not None:
                heapq.heappush(heap, (r, i, end[stop]))
        if before[i] >= 0 and (r := ranks.get(word[before[i] : stop])) is not None:
            heapq.heappush(heap, (r, before[i], stop))
    return [ranks[word[i:e]] for i, e in enumerate(end) if e]


def word_counts(docs: DataFrame, pattern: str, text_col: str = "text") -> DataFrame:
    """word, n: the pattern's matches over all texts. They are counted before they are dealt out."""
    words = F.explode(F.regexp_extract_all(F.col(text_col), F.lit("(?U)" + pattern), F.lit(0)))
    return docs.select(words.alias("word")).groupBy("word").agg(F.count("*").alias("n"))


def frequent_words(docs: DataFrame, ranks: dict[bytes, int], pattern: str, text_col="text", words=WORDS) -> bytes:
    """The most frequent words with their ids, as an Arrow stream: Python objects for each would burden the driver."""
    counts = staged(word_counts(docs, pattern, text_col).filter(F.octet_length("word") <= WORD_BYTES))
    top = most_frequent(counts, words, "word")
    with short_plans(docs.sparkSession):
        table = top.select("word").repartition(48, "word").select("word", encoded(F.col("word"), ranks).alias("ids")).toArrow()
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, table.schema) as stream:
        stream.write_table(table)
    released(docs.sparkSession)
    del table
    return out.getvalue().to_pybytes()


def _tables(shared: Broadcast) -> tuple[dict[str, bytes], dict[str, bytes], dict[bytes, int]]:
    """Ids of the frequent words, ids of the words merged so far, and the ranks: made once by a worker, not by each of its tasks.

    They lie with the worker's copy of the broadcast, which it lets go of at its next task that has no use for it.
    """
    if not hasattr(shared, "tables"):
        stream, ranks = shared.value
        known: dict[str, bytes] = {}
        with pa.ipc.open_stream(stream) as chunks:
            for chunk in chunks:
                packed, ends = chunk["ids"].flatten().to_numpy().astype(np.int32).tobytes(), np.cumsum(chunk["ids"].value_lengths().to_numpy()) * 4
                known.update((w, packed[a:b]) for w, a, b in zip(chunk["word"].to_pylist(), [0, *ends.tolist()], ends.tolist()))
        shared.tables = known, {}, ranks
    return shared.tables


def encode(docs: DataFrame, ranks: dict[bytes, int], pattern: str, text_col="text", ids_col="ids", words=WORDS) -> DataFrame:
    """docs with ids_col, array<int>: the ids of each text, those of its matches one after another.

    Null and empty texts have no ids. Every byte has a rank in the vocabulary, so texts of any length decode to
    themselves. Repeated rows and ties change nothing, an empty table gives an empty one, and a column of docs that has the
    name of ids_col is replaced.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((frequent_words(docs, ranks, pattern, text_col, words), ranks))

    @F.arrow_udf("array<int>")
    def ids_of(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known, rare, ranks = _tables(shared)
        find = matcher(pattern).findall
        for column in columns:
            out, ends = bytearray(), [0]
            for start in range(0, len(column), 128):  # few of the texts at once are Python strings
                for text in column.slice(start, 128).to_pylist():
                    words = find(text) if text else []
                    parts = list(map(known.get, words))
                    k = 0
                    for _ in range(parts.count(None)):
                        k = parts.index(None, k)
                        if (part := rare.get(words[k])) is None:
                            if len(rare) > _FLUSH:
                                rare.clear()
                            part = rare[words[k]] = array("i", merge(words[k].encode(), ranks)).tobytes()
                        parts[k] = part
                    out += b"".join(parts)
                    ends.append(len(out) // 4)
            yield pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(out, dtype=np.int32)))
        trimmed()

    return docs.withColumn(ids_col, ids_of(F.coalesce(F.col(text_col), F.lit(""))))


def round_trip(docs: DataFrame, ranks: dict[bytes, int], pattern: str, id_col="doc_id", text_col="text") -> DataFrame:
    """id, n_tokens, ids_sha256, decoded_sha256 of every row."""
    out = encode(docs.select(F.col(id_col), F.col(text_col).alias("text__")), ranks, pattern, "text__", "ids__")
    return out.select(
        id_col,
        F.size("ids__").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids__").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2(decoded(F.col("ids__"), ranks), 256).alias("decoded_sha256"),
    )
