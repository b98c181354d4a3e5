"""Suffix-array dedup by bucket-pointer refinement, for repeated strings of a fixed length.

Every position starts in the bucket of its q-gram; an identifier for twice the length is made of the identifiers of
the position and of the position half the length later, and so on, each length reusing the one before (25, 50, 100,
200 bytes). Identifiers are fingerprints, so that refining needs no exchange; only buckets that still hold several
positions are dealt out and sorted.

Suffixes are sampled: of the 200-byte window at each position, the least 50-byte identifier inside is its anchor.
Equal windows have equal anchors, so windows whose anchor's bucket holds one position are single. Consecutive windows
with one anchor make a run, which is dealt out as one row. Runs equal from end to end repeat as a whole; where an
anchor's bucket holds unequal runs, one run of each kind is opened, and its windows are compared one by one.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexengine.llm import vectors as V
from lexengine.llm.common import keyed, released, skew_join, staged, unstaged

LENGTH, GRAM = 200, 25
_ANCHOR = 2 * GRAM
_PLACE = 24  # bits of a position within a segment
SEGMENT = 1 << 20
#: Windows of a run that are compared together, by their distance from the anchor, before single ones are.
BLOCK = 16


def identifiers(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Identifiers of the 50 and of the 200 bytes at each position."""
    pre = V.prefix(data)
    at = np.arange(max(0, len(data) - GRAM + 1))
    ids, size, anchors = V.spans(pre, at, at + GRAM), GRAM, None
    while size < LENGTH:
        n = max(0, len(ids) - size)
        ids = V.mixed(ids[:n] * np.uint64(0xD6E8FEB86659FD93) + ids[size : size + n])
        size *= 2
        anchors = ids if size == _ANCHOR else anchors
    return anchors, ids


def least(ids: np.ndarray, width: int) -> np.ndarray:
    """Places of the least number in each window of width; of equal ones the first."""
    n = len(ids) - width + 1
    if n <= 0:
        return np.zeros(0, dtype=np.int64)
    place = np.uint64((1 << _PLACE) - 1)
    key = np.full(-(-len(ids) // width) * width, ~np.uint64(0), dtype=np.uint64)
    key[: len(ids)] = (ids & ~place) | np.arange(len(ids), dtype=np.uint64)
    rows = key.reshape(-1, width)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    back = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return (np.minimum(back[:n], ahead[width - 1 : width - 1 + n]) & place).astype(np.int64)


def segments(data: np.ndarray, off: np.ndarray):
    """(row of each byte's text by offsets, first byte, bytes): a long text comes in pieces that share LENGTH - 1 bytes."""
    if len(off) == 2 and len(data) > 2 * SEGMENT:
        for a in range(0, len(data) - LENGTH + 1, SEGMENT):
            part = data[a : a + SEGMENT + LENGTH - 1]
            yield np.array([0, len(part)]), a, part
    else:
        yield off, 0, data


def runs(data: np.ndarray, off: np.ndarray):
    """Row, first window, last window (places in data), anchor and whole identifier of each run."""
    anchors, whole = identifiers(data)
    where = least(anchors, LENGTH - _ANCHOR + 1)
    valid = np.zeros(len(where) + 2, dtype=bool)
    for a, b in zip(off[:-1], off[1:]):
        if b - a >= LENGTH:
            valid[a + 1 : b - LENGTH + 2] = True
    if not valid.any():
        return None
    turn = np.ones(len(where) + 1, dtype=bool)
    turn[1:-1] = where[1:] != where[:-1]
    inner = off[1:-1]
    turn[inner[inner < len(turn)]] = True
    first = np.flatnonzero(valid[1:-1] & (turn[:-1] | ~valid[:-2]))
    last = np.flatnonzero(valid[1:-1] & (turn[1:] | ~valid[2:]))
    row = np.searchsorted(off, first, side="right") - 1
    total = V.mixed(whole[first] * np.uint64(0xA0761D6478BD642F) + whole[last] + (last - first).astype(np.uint64))
    return row, first, last, anchors[where[first]], total


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64) if x.dtype == np.uint64 else x.astype(np.int64))


def _batch(**columns: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([_signed(c) for c in columns.values()], list(columns))


def _runs(batches):
    """anchor, total, key and at of each run; at: 256 times the first window, and how many windows follow it."""
    for b in batches:
        keys = b["key"].to_numpy()
        for top, data, off in V.chunks(b["text"]):
            for own, start, part in segments(data, off):
                if (found := runs(part, own)) is not None:
                    row, first, last, anchor, total = found
                    yield _batch(anchor=anchor, total=total, key=keys[row + top], at=(first - own[row] + start) * 256 + last - first)


def _contexts(batches):
    """The bytes of the runs asked for."""
    for b in batches:
        keys, ats, weights, bytes_ = [], [], [], []
        for key, text, asked in zip(b["key"], b["text"], b["asked"]):
            data, key = text.as_py().encode(), key.as_py()
            for x in asked.as_py():
                keys.append(key)
                ats.append(x["at"])
                weights.append(x["w"])
                bytes_.append(data[x["at"] // 256 : x["at"] // 256 + x["at"] % 256 + LENGTH])
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(ats, pa.int64()), pa.array(weights, pa.int64()), pa.array(bytes_, pa.binary())], ["key", "at", "w", "bytes"])


def _placed(column):
    """Of a column of runs' bytes, by chunk: prefix hashes, each window's place, run and distance from the anchor."""
    for top, data, off in V.chunks(column):
        anchors, _ = identifiers(data)
        where = least(anchors, LENGTH - _ANCHOR + 1)
        n = np.diff(off) - LENGTH + 1
        run = np.repeat(np.arange(len(n)), n)
        at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + off[run]
        yield top, V.prefix(data), run, at, where[off[:-1]][run] - at, at - off[run]


def _core(pre, at, ahead):
    """What all windows of a block have in common."""
    start = at + ahead % BLOCK
    return V.spans(pre, start, start + LENGTH - BLOCK + 1) + (ahead // BLOCK).astype(np.uint64)


def _blocks(batches):
    for b in batches:
        key, at0, w = (b[c].to_numpy() for c in ("key", "at", "w"))
        for top, pre, run, at, ahead, i in _placed(b["bytes"]):
            block = ahead // BLOCK
            first = np.flatnonzero(np.r_[True, (run[1:] != run[:-1]) | (block[1:] != block[:-1])])
            last = np.r_[first[1:], len(run)] - 1
            full = V.spans(pre, at[first], at[last] + LENGTH) + ahead[first].astype(np.uint64)
            row = run[first] + top
            yield _batch(core=_core(pre, at[first], ahead[first]), full=full, key=key[row], at=at0[row], i=i[first], n=last - first + 1, w=w[row])


def _windows(batches):
    """The windows of the blocks asked for, one by one."""
    for b in batches:
        key, at0, asked = b["key"].to_numpy(), b["at"].to_numpy(), b["asked"]
        for top, pre, run, at, ahead, i in _placed(b["bytes"]):
            weight = np.zeros(len(at), dtype=np.int64)
            begin = np.searchsorted(run, np.arange(run[-1] + 2))
            for r in range(run[-1] + 1):
                for x in asked[r + top].as_py():
                    weight[begin[r] + x["i"] : begin[r] + x["i"] + x["n"]] = x["w"]
            on = np.flatnonzero(weight)
            row = run[on] + top
            yield _batch(core=_core(pre, at[on], ahead[on]), id=V.spans(pre, at[on], at[on] + LENGTH), key=key[row], pos=at0[row] // 256 + i[on], w=weight[on])


def _sampled(own: DataFrame) -> DataFrame:
    """The runs whose anchor's bucket holds several."""
    all_ = staged(own.select("key", "text").mapInArrow(_runs, "anchor long, total long, key long, at long"))
    several = all_.groupBy("anchor").agg(F.count("*").alias("n")).filter("n > 1").select("anchor")
    out = staged(skew_join(all_, several, ["anchor"], "left_semi"))
    unstaged(all_)
    return out


def _kinds(found: DataFrame) -> DataFrame:
    """The unequal runs of each bucket: how many there are of each, one of them, and how many kinds the bucket holds."""
    kinds = found.groupBy("anchor", "total").agg(F.count("*").alias("n"), F.min(F.struct("key", "at")).alias("one"))
    kinds = staged(kinds)
    per = kinds.groupBy("anchor").agg(F.count("*").alias("kinds"))
    return staged(skew_join(kinds, per, ["anchor"]))


def _opened(own: DataFrame, kinds: DataFrame) -> DataFrame:
    """The bytes of a run of each kind, of buckets that hold several kinds. w: 2 if there are more of the kind."""
    asked = kinds.filter("kinds > 1").select("one.key", F.struct("one.at", F.least("n", F.lit(2)).cast("long").alias("w")).alias("x"))
    asked = asked.groupBy("key").agg(F.collect_list("x").alias("asked"))
    return staged(own.join(asked, "key").select("key", "text", "asked").mapInArrow(_contexts, "key long, at long, w long, bytes binary"))


def _refined(opened: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Spans (key, first, last) of windows that repeat, of the opened runs; by blocks, and by single windows."""
    blocks = staged(opened.mapInArrow(_blocks, "core long, full long, key long, at long, i long, n long, w long"))
    kinds = staged(blocks.groupBy("core", "full").agg(F.sum("w").alias("t"), F.min(F.struct("key", "at", "i", "n")).alias("one")))
    start = F.floor(F.col("at") / 256)
    whole = blocks.filter("w = 1").join(kinds.filter("t > 1").select("core", "full"), ["core", "full"], "left_semi")
    whole = whole.select("key", (start + F.col("i")).alias("first"), (start + F.col("i") + F.col("n") - 1).alias("last"))
    several = kinds.groupBy("core").agg(F.count("*").alias("k")).filter("k > 1").select("core")
    asked = skew_join(kinds, several, ["core"], "left_semi").select("one.key", "one.at", F.struct("one.i", "one.n", F.least("t", F.lit(2)).cast("long").alias("w")).alias("x"))
    asked = asked.groupBy("key", "at").agg(F.collect_list("x").alias("asked"))
    windows = opened.join(asked, ["key", "at"]).select("key", "at", "bytes", "asked").mapInArrow(_windows, "core long, id long, key long, pos long, w long")
    windows = staged(windows)
    twice = windows.groupBy("core", "id").agg(F.sum("w").alias("t")).filter("t > 1").select("core", "id")
    single = skew_join(windows.filter("w = 1"), twice, ["core", "id"], "left_semi").select("key", F.col("pos").alias("first"), F.col("pos").alias("last"))
    return staged(whole), staged(single)


def _cut(batches):
    for b in batches:
        out = []
        for text, spans in zip(b["text"], b["spans"]):
            data = (text.as_py() or "").encode()
            if not spans.is_valid:
                out.append((len(data), 0, 0, hashlib.sha256(data).hexdigest()))
                continue
            first, last = (spans.values.field(c).to_numpy() for c in ("first", "last"))
            edge = np.zeros(len(data) + 1, dtype=np.int32)
            np.add.at(edge, first, 1)
            np.add.at(edge, last + LENGTH, -1)
            gone = np.cumsum(edge[:-1]) > 0
            kept = np.frombuffer(data, dtype=np.uint8)[~gone].tobytes()
            out.append((len(data), int(gone.sum()), int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum()), hashlib.sha256(kept).hexdigest()))
        cols = list(zip(*out)) or [[], [], [], []]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string()]
        yield pa.RecordBatch.from_arrays([b["id"], *(pa.array(c, k) for c, k in zip(cols, kinds))], ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def repeated_spans(own: DataFrame) -> DataFrame:
    """key and spans (first, last) of the windows of own's texts that start anywhere else too."""
    spark = own.sparkSession
    found = _sampled(own)
    released(spark)
    kinds = _kinds(found)
    equal = staged(
        found.join(kinds.filter("n > 1").select("anchor", "total"), ["anchor", "total"], "left_semi").select(
            "key", F.floor(F.col("at") / 256).alias("first"), (F.floor(F.col("at") / 256) + F.col("at") % 256).alias("last")
        )
    )
    opened = _opened(own, kinds)
    del kinds
    unstaged(found)
    released(spark)
    blocks, single = _refined(opened)
    released(spark)
    return equal.unionByName(blocks).unionByName(single).groupBy("key").agg(F.collect_list(F.struct("first", "last")).alias("spans"))


def remove_repeats(docs: DataFrame, id_col="doc_id", text_col="text") -> DataFrame:
    """One row per input row: id, n_bytes, n_removed, n_spans, kept_sha256.

    Null texts count as empty; texts under LENGTH bytes have nothing to remove. Of texts that occur twice, as of rows
    that repeat, all of both goes. Other columns are not read, and an empty table gives an empty result.
    """
    own = keyed(docs, id_col, text_col)
    spans = repeated_spans(own)
    kind = docs.schema[id_col].dataType.simpleString()
    out = own.join(spans, "key", "left").select("id", "text", "spans")
    return out.mapInArrow(_cut, f"id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string").withColumnRenamed("id", id_col)
