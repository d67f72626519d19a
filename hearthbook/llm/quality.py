"""Quality rules by compression bands.

A text is compressed by zstandard as a whole and in fixed chunks.  The ratio of
compressed to plain bytes falls with length, so the limits are bands of length: a
text under its band's lower limit repeats itself, one over the upper limit is noise.
A long text may be sound as a whole and hold long repetitive or incompressible
parts, so it also goes where too many of its chunks are outside the chunks' limits.
"""

from __future__ import annotations

from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import BooleanType, DoubleType, LongType, StringType, StructField, StructType

from hearthbook.llm import _text

SYMBOLS = np.zeros(256, dtype=bool)
SYMBOLS[list(b"#*$%&|<>")] = True
WINDOW = 8
CHUNK, LEVEL = 4096, 3
#: (from so many bytes, least ratio, greatest ratio) of whole texts.
BANDS = ((0, 0.0, 9.0), (200, 0.30, 0.92), (400, 0.28, 0.80), (1000, 0.25, 0.72), (4000, 0.22, 0.70), (16000, 0.18, 0.68), (64000, 0.12, 0.68))
#: The same for a chunk of 4096 bytes, and the share of a text's chunks that may be outside.
CHUNK_BAND, CHUNK_SHARE = (0.18, 0.72), 0.5
OUT = (("n_words", LongType()), ("word_chars", LongType()), ("n_symbols", LongType()), ("n_dup_lines", LongType()), ("n_repeat_words", LongType()), ("n_bytes", LongType()), ("ratio", DoubleType()), ("bad_chunks", LongType()), ("base_failed", BooleanType()), ("verdict", StringType()), ("kept", BooleanType()))


def _hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: str = "") -> np.ndarray:
    """Span hashes, over pieces of the bytes, so that memory stays a small multiple of a piece."""
    out, k = np.zeros(len(starts), dtype=np.uint64), 0
    while k < len(starts):
        stop = max(k + 1, int(np.searchsorted(ends, starts[k] + _text.PASS_BYTES, "right")))
        a = starts[k]
        out[k:stop] = _text.span_hashes(data[a : ends[stop - 1]], starts[k:stop] - a, ends[k:stop] - a, base)
        k = stop
    return out


def _again(hashed: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(occurs earlier in its text, occurs twice or more in its text) of every hash."""
    tagged = _text.mix(hashed ^ _text.mix(of.astype(np.uint64) + np.uint64(1)))
    order = np.argsort(tagged, kind="stable")
    same = np.zeros(len(order) + 1, dtype=bool)
    same[1:-1] = tagged[order][1:] == tagged[order][:-1]
    earlier, twice = np.zeros(len(order), dtype=bool), np.zeros(len(order), dtype=bool)
    earlier[order], twice[order] = same[:-1], same[:-1] | same[1:]
    return earlier, twice


def counts(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words) of every text, as rows."""
    texts = len(at) - 1
    visible = ~_text.SPACE[data]
    per = lambda mask: np.diff(np.concatenate([[0], np.cumsum(mask)])[at])
    starts, ends, of = _text.spans(data, at, visible)
    hashed = _hashes(data, starts, ends)
    # windows of words, and the words inside those that occur again
    runs = np.arange(max(0, len(hashed) - WINDOW + 1))
    runs = runs[of[runs] == of[runs + WINDOW - 1]]
    salts = _text.mix(np.arange(1, WINDOW + 1, dtype=np.uint64) * _text.BASE) | np.uint64(1)
    total = np.zeros(len(runs), dtype=np.uint64)
    for k in range(WINDOW):
        total += hashed[runs + k] * salts[k]
    again = runs[_again(_text.mix(total), of[runs])[1]]
    edges = np.zeros(len(hashed) + 1, dtype=np.int64)
    np.add.at(edges, again, 1)
    np.add.at(edges, again + WINDOW, -1)
    repeated = np.bincount(of[np.cumsum(edges[:-1]) > 0], minlength=texts)
    # lines that hold a word
    a, b, line_of = _text.spans(data, at, data != 10)
    filled = np.searchsorted(starts, b) > np.searchsorted(starts, a)
    a, b, line_of = a[filled], b[filled], line_of[filled]
    lines = np.bincount(line_of[_again(_hashes(data, a, b), line_of)[0]], minlength=texts)
    return np.stack([np.bincount(of, minlength=texts), per(visible & ((data & 0xC0) != 0x80)), per(SYMBOLS[data]), lines, repeated], axis=1).astype(np.int64)


class Bands:
    """Ratios of texts and their verdicts by length."""

    def __init__(self, bands=BANDS, chunk_band=CHUNK_BAND, share: float = CHUNK_SHARE, chunk: int = CHUNK, level: int = LEVEL):
        import zstandard

        self.pack = zstandard.ZstdCompressor(level=level, write_content_size=False)
        self.stream = lambda: zstandard.ZstdCompressor(level=level).compressobj()
        self.bands, self.chunk_band, self.share, self.chunk = bands, chunk_band, share, chunk
        self.floors = [b[0] for b in bands]

    def _size(self, text: memoryview) -> int:
        if len(text) <= _text.PASS_BYTES:
            return len(self.pack.compress(text))
        stream, size = self.stream(), 0
        for k in range(0, len(text), _text.PASS_BYTES):
            size += len(stream.compress(text[k : k + _text.PASS_BYTES]))
        return size + len(stream.flush())

    def judge(self, text: memoryview) -> tuple[float, int, str | None]:
        """(ratio, chunks outside their limits, why it goes or None); an empty text has ratio 0."""
        size = len(text)
        if not size:
            return 0.0, 0, None
        ratio = self._size(text) / size
        low, high = self.bands[bisect_right(self.floors, size) - 1][1:]
        whole = size // self.chunk  # a rest shorter than a chunk is judged with the whole text only
        sizes = [len(self.pack.compress(text[k * self.chunk : (k + 1) * self.chunk])) / self.chunk for k in range(whole)] if whole > 1 else []
        thin, thick = sum(r < self.chunk_band[0] for r in sizes), sum(r > self.chunk_band[1] for r in sizes)
        if ratio < low:
            return ratio, thin + thick, "repetitive"
        if ratio > high:
            return ratio, thin + thick, "incompressible"
        if thin + thick > self.share * whole:
            return ratio, thin + thick, "repetitive parts" if thin >= thick else "incompressible parts"
        return ratio, thin + thick, None


def rules(docs: DataFrame, least_words: int = 20, most_repeated: int = 30, **limits) -> DataFrame:
    """docs (..., text, ...) plus the counts, ratio, bad_chunks, base_failed, verdict and kept; a row per row.

    base_failed: fewer than least_words words, or more than most_repeated percent of
    the words inside windows of 8 words that the text holds twice.  verdict names why
    the bands reject a text (null if they do not); kept is neither.  limits are those
    of ``Bands``.  Null and empty texts have no words, ratio 0 and fail the base rule.
    Rows that repeat get equal results; a text of any length is read whole, in one
    task.  Columns with the names of results are replaced, others kept whatever they
    are called.  Words, windows and lines are compared by 64-bit hashes.
    """
    results = [n for n, _ in OUT]
    own = docs.drop(*results)
    names = ["text" if c == "text" else f"c{k}" for k, c in enumerate(own.columns)]

    def run(batches):
        bands = Bands(**limits)
        for whole in batches:
            for batch in _text.passes(whole, "text"):
                data, at = _text.utf8(batch.column("text"))
                found = counts(data, at)
                raw = memoryview(np.ascontiguousarray(data))
                judged = [bands.judge(raw[a:b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                failed = (found[:, 0] < least_words) | (100 * found[:, 4] > most_repeated * found[:, 0])
                verdicts = pa.array([j[2] for j in judged], pa.string())
                kept = ~failed & np.array([j[2] is None for j in judged], dtype=bool)
                yield pa.RecordBatch.from_arrays([
                    *batch.columns, *(pa.array(found[:, k]) for k in range(5)), pa.array(np.diff(at)), pa.array([j[0] for j in judged], pa.float64()), pa.array([j[1] for j in judged], pa.int64()), pa.array(failed), verdicts, pa.array(kept),
                ], [*names, *results])

    fields = [StructField(n, f.dataType) for n, f in zip(names, own.schema.fields, strict=True)] + [StructField(n, t) for n, t in OUT]
    return own.toDF(*names).mapInArrow(run, StructType(fields)).toDF(*own.columns, *results)
