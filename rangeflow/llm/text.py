"""Text helpers shared by the operators of this subpackage."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words are runs of anything but these six ASCII white-space characters.
SPACES = r"[\x20\x09-\x0D]+"
CHUNK_BYTES = 600_000
_BASE = np.uint64(0x9E3779B97F4A7C15)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_powers: dict[str, np.ndarray] = {}


def words_col(text: Column) -> Column:
    """Array of the words of a text; empty for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACES), lambda w: w != "")


def as_bytes(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """UTF-8 bytes of a string column, null as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective scrambling of unsigned 64-bit values."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2 ** 64, from 0 to n at least."""
    if len(_powers.get("up", ())) <= n:
        size = max(n, 2 * CHUNK_BYTES) + 1
        for name, x in (("up", int(_BASE)), ("down", pow(int(_BASE), -1, 2**64))):
            _powers[name] = np.cumprod(np.concatenate([[np.uint64(1)], np.full(size, np.uint64(x))]), dtype=np.uint64)
    return _powers["up"], _powers["down"]


_LETTERS = mix(np.arange(1, 257, dtype=np.uint64))


def word_ids(texts: list[bytes], lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of all texts, one text after the other, and how many each has.

    Hashes are polynomials of a word's bytes, from prefix sums over many texts at a time.
    """
    hashes, counts = [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
    k = 0
    while k < len(texts):
        some, size = [], 0
        while k < len(texts) and (not some or size + len(texts[k]) < CHUNK_BYTES):
            some.append(texts[k])
            size += len(texts[k]) + 1
            k += 1
        raw = b"\n".join(some) + b"\n"
        data = np.frombuffer(raw.lower() if lower else raw, np.uint8)
        gap = _SPACE[data]
        begin = ~gap
        begin[1:] &= gap[:-1]
        end = gap.copy()
        end[1:] &= ~gap[:-1]
        end[0] = False
        s, e = np.flatnonzero(begin), np.flatnonzero(end)
        up, down = _power_tables(len(data))
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_LETTERS[data] * up[: len(data)], dtype=np.uint64)])
        hashes.append(mix((sums[e] - sums[s]) * down[s] ^ (e - s).astype(np.uint64)))
        counts.append(np.diff(np.searchsorted(s, np.cumsum([len(x) + 1 for x in some])), prepend=0))
    return np.concatenate(hashes), np.concatenate(counts)
