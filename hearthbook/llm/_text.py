"""Vectorised text kernels: numpy over the UTF-8 bytes of an Arrow column.

A word is a maximal run of bytes outside 0x20 and 0x09-0x0D, which in UTF-8 is
the same as a maximal run of such characters.  Hashes are 64-bit polynomial
hashes over bytes with an odd base, finished by a mixing step.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BASE, OTHER = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1B54A32D192ED03)
_STEPS = {"up": BASE, "down": np.uint64(pow(int(BASE), -1, 1 << 64)), "up2": OTHER, "down2": np.uint64(pow(int(OTHER), -1, 1 << 64))}
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes of text that one numpy pass handles; a longer single text is one pass of its own.
PASS_BYTES = 2 << 20
_powers: dict[str, np.ndarray] = {}


def powers(size: int, kind: str) -> np.ndarray:
    """base**i (kind "up") or base**-i (kind "down") for i below size; "up2" and "down2" have another base."""
    have = _powers.get(kind)
    if have is None or len(have) < size:
        steps = np.full(max(size, PASS_BYTES + 64), _STEPS[kind], dtype=np.uint64)
        steps[0] = 1
        have = np.cumprod(steps, dtype=np.uint64)
        if size <= 16 << 20:  # keep the usual size only, so that one huge text leaves nothing behind
            _powers[kind] = have
    return have


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    held = np.frombuffer(data, dtype=np.uint8)[at[0] : at[-1]] if data is not None and at[-1] > at[0] else np.zeros(0, np.uint8)
    return held, at - at[0]


def passes(batch: pa.RecordBatch, column: str, most: int = PASS_BYTES, rows: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with at most so many bytes of text and rows, one row at least."""
    _, at = utf8(batch.column(column))
    row = 0
    while row < batch.num_rows:
        stop = min(row + rows, max(row + 1, int(np.searchsorted(at, at[row] + most, "right")) - 1))
        yield batch.slice(row, stop - row)
        row = stop


def spans(data: np.ndarray, at: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, text index) of the maximal runs where inside holds, cut at text boundaries."""
    before = np.empty(len(data), dtype=bool)
    after = np.empty(len(data), dtype=bool)
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, none
    before[0], before[1:] = False, inside[:-1]
    after[-1], after[:-1] = False, inside[1:]
    full = at[1:] > at[:-1]
    before[at[:-1][full]] = False
    after[at[1:][full] - 1] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(at, starts, "right") - 1


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: str = "") -> np.ndarray:
    """64-bit hash of each byte span; base "2" gives an independent one."""
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(len(data), "up" + base)[: len(data)], dtype=np.uint64, out=sums[1:])
    return mix((sums[ends] - sums[starts]) * powers(len(data), "down" + base)[starts] + (ends - starts).astype(np.uint64))


def words(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text index) of every word."""
    starts, ends, of = spans(data, at, ~SPACE[data])
    return span_hashes(data, starts, ends), of


def shingles(data: np.ndarray, at: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text index) of every run of width words; a shorter text gives all its words as one run."""
    hashed, of = words(data, at)
    counts = np.bincount(of, minlength=len(at) - 1)
    salts = mix(np.arange(1, width + 1, dtype=np.uint64) * BASE) | np.uint64(1)
    runs = len(hashed) - width + 1
    if runs > 0:
        whole = of[:runs] == of[width - 1 :]
        total = np.zeros(runs, dtype=np.uint64)
        for k in range(width):
            total += hashed[k : k + runs] * salts[k]
        long, long_of = mix(total[whole]), of[:runs][whole]
    else:
        long, long_of = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    short = np.flatnonzero((counts > 0) & (counts < width))
    if not len(short):
        return long, long_of
    first = np.searchsorted(of, short)
    total = np.full(len(short), 7, dtype=np.uint64) * counts[short].astype(np.uint64)
    for k in range(width - 1):
        has = counts[short] > k
        total[has] += hashed[first[has] + k] * salts[k]
    order = np.argsort(np.concatenate([long_of, short]), kind="stable")
    return np.concatenate([long, mix(total)])[order], np.concatenate([long_of, short])[order]


def distinct_by_text(hashed: np.ndarray, of: np.ndarray, texts: int) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct hashes of each text, offsets); of ascends."""
    cuts = np.searchsorted(of, np.arange(texts + 1))
    parts = [np.unique(hashed[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    return (np.concatenate(parts) if parts else np.zeros(0, np.uint64)), np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)
