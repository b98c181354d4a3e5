"""Texts of an Arrow column as one byte array, and hashes of its words and windows, for whole chunks at a time."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

SPACES = np.zeros(256, dtype=bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_powers = {"up": np.ones(1, dtype=np.uint64), "down": np.ones(1, dtype=np.uint64)}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The base's powers 0 to n - 1, and their inverses modulo 2**64."""
    if len(_powers["up"]) < n:
        for k, b in (("up", _BASE), ("down", _BACK)):
            all_ = np.full(max(n, 1 << 20), b, dtype=np.uint64)
            all_[0] = 1
            _powers[k] = np.multiply.accumulate(all_)
    return _powers["up"][:n], _powers["down"][:n]


def mixed(x: np.ndarray) -> np.ndarray:
    """splitmix64's finisher, a bijection of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def chunks(column: pa.Array, most: int = 1 << 20):
    """(first row, bytes, offsets) of runs of rows with about most bytes, of strings or binaries; a null is empty."""
    column = column.cast(pa.large_binary()).fill_null(b"")
    _, off, data = column.buffers()
    off = np.frombuffer(off, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    row = 0
    while row < len(column):
        end = max(row + 1, int(np.searchsorted(off, off[row] + most, side="right")) - 1)
        yield row, data[off[row] : off[end]], off[row : end + 1] - off[row]
        row = end


def words(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, and the row of each."""
    word = ~SPACES[data]
    first = word.copy()
    first[1:] &= ~word[:-1]
    last = word.copy()
    last[:-1] &= ~word[1:]
    inner = off[1:-1]
    inner = inner[(inner > 0) & (inner < len(data))]
    first[inner] = word[inner]
    last[inner - 1] = word[inner - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(off, starts, side="right") - 1


def prefix(data: np.ndarray, salt: int = 1) -> np.ndarray:
    """Polynomial prefix hashes: length + 1 numbers."""
    up, _ = powers(len(data) + 1)
    out = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((data + np.uint64(salt)) * up[:-1], out=out[1:])
    return out


def spans(pre: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of the bytes of each span, whose place doesn't matter."""
    _, down = powers(len(pre))
    return mixed((pre[ends] - pre[starts]) * down[starts] + (ends - starts).astype(np.uint64))
