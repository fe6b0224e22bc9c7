"""Words and hashes of many texts at once, with numpy on the UTF-8 bytes of an Arrow column."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text handled at once; a longer text is handled alone.
STEP = 1 << 19
U = np.uint64
_BASE, _BASE_INVERSE = U(0x9E3779B97F4A7C15), U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


#: A random number for each byte; A-Z count as a-z.
BYTE = mix(np.arange(1, 257, dtype=U) * U(0x9E3779B97F4A7C15))
BYTE[65:91] = BYTE[97:123]


def _power(n: int, which: str) -> np.ndarray:
    if which not in _powers or len(_powers[which]) < n:
        base = np.full(max(n, STEP + 1), _BASE if which == "up" else _BASE_INVERSE, U)
        base[0] = 1
        _powers[which] = np.cumprod(base, dtype=U)
    return _powers[which]


def small(batches: Iterator[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """The same rows in smaller batches, so that what is made of one batch stays small."""
    for b in batches:
        for k in range(0, b.num_rows, rows):
            yield b.slice(k, rows)


def blocks(column: pa.Array | pa.ChunkedArray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets of each row and the end) for runs of rows of about STEP bytes; null is empty."""
    first = 0
    for part in column.chunks if isinstance(column, pa.ChunkedArray) else [column]:
        part = part.cast(pa.large_string()).fill_null("")
        n = len(part)
        if not n:
            continue
        _, offsets, data = part.buffers()
        offs = np.frombuffer(offsets, np.int64)[part.offset : part.offset + n + 1]
        raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
        i = 0
        while i < n:
            j = max(i + 1, int(np.searchsorted(offs, offs[i] + STEP, "right")) - 1)
            yield first + i, raw[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
            i = j
        first += n


def word_bounds(raw: np.ndarray, offs: np.ndarray, space: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of each run of bytes that are not space; no word goes over the end of a row."""
    gap = space[raw]
    before, after = np.ones(len(raw), bool), np.ones(len(raw), bool)
    before[1:], after[:-1] = gap[:-1], gap[1:]
    inner = offs[(offs > 0) & (offs < len(raw))]
    before[inner], after[inner - 1] = True, True
    starts, ends = np.flatnonzero(~gap & before), np.flatnonzero(~gap & after) + 1
    return starts, ends, np.searchsorted(offs, starts, "right") - 1


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, table: np.ndarray = BYTE) -> np.ndarray:
    """A 64-bit hash of each word, from one running sum over all bytes."""
    total = np.zeros(len(raw) + 1, U)
    np.cumsum(table[raw] * _power(len(raw) + 1, "up")[: len(raw)], out=total[1:])
    return mix((total[ends] - total[starts]) * _power(len(raw) + 1, "down")[starts] + (ends - starts).astype(U))


def window_hashes(words: np.ndarray, rows: np.ndarray, n: int, n_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all windows of n words, in order, and how many each row has; a shorter row is one window, a row without words none."""
    counts = np.bincount(rows, minlength=n_rows)
    factor = mix(np.arange(11, 11 + n, dtype=U))
    size = max(0, len(words) - n + 1)
    full = np.zeros(size, U)
    for k in range(n):
        full += words[k : k + size] * factor[k]
    inside = rows[: size] == rows[n - 1 :] if size else np.zeros(0, bool)
    out_counts = np.where(counts >= n, counts - n + 1, (counts > 0).astype(counts.dtype))
    short = np.flatnonzero((counts > 0) & (counts < n))
    full = mix(full[inside])
    if not len(short):
        return full, out_counts
    firsts, at = np.cumsum(counts) - counts, np.cumsum(out_counts) - out_counts
    out, own = np.empty(int(out_counts.sum()), U), np.zeros(int(out_counts.sum()), bool)
    own[at[short]] = True
    out[~own] = full
    for r in short:
        w = words[firsts[r] : firsts[r] + counts[r]]
        out[at[r]] = mix(np.array([np.sum(w * factor[: len(w)], dtype=U) + U(1000003 * len(w))], U))[0]
    return out, out_counts
