"""Substring dedup over runs of consecutive sentences.

A sentence ends after . ! or ? before white space, or at a line feed.  From
every sentence the shortest run of at least ``sentences`` sentences and
``words`` words is hashed, once forwards from it and once backwards; so every
sentence of a repeated passage that long is covered by a run that lies inside
the passage.  A single sentence of ``alone`` words or more is a run too.  Where
``passage`` words in a row hold no such run strictly inside, their window of
``alone`` words with the least hash is one: so any passage of that length holds a
whole run, wherever it is cut (line feeds in the same places).  Runs are compared
as sequences of lower-cased words (96 bits of two hashes).  The first occurrence
of a run, by doc_id and position, stays; sentences that any later occurrence
covers are removed, of windows only the words.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from hearthbook.llm import _text
from hearthbook.llm._store import Scratch

_END = np.zeros(256, dtype=bool)
_END[list(b".!?")] = True
_SALT = np.uint64(0x7F4A7C159E3779B1)
_WINDOW = np.uint64(0x94D049BB133111EB)
#: Starts and stops from here on count words, not sentences.
WORDS = 1 << 30


def sentence_ends(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Byte positions after the sentences of all texts; a text's end is one."""
    last = np.zeros(len(data), dtype=bool)
    last[at[1:][at[1:] > at[:-1]] - 1] = True
    followed = np.ones(len(data), dtype=bool)
    followed[:-1] = _text.SPACE[data[1:]]
    return np.flatnonzero((_END[data] & followed) | (data == 10) | last) + 1


def _run_hash(hashed: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(hashed) + 1, dtype=np.uint64)
    np.cumsum(hashed * _text.powers(len(hashed), "up")[: len(hashed)], dtype=np.uint64, out=sums[1:])
    down = _text.powers(len(hashed) + 1, "down")
    return _text.mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def windows(hashed: np.ndarray, of: np.ndarray, a: np.ndarray, b: np.ndarray, alone: int, passage: int) -> np.ndarray:
    """First words of the chosen windows; of is each word's text, a and b are the bounds of the runs of sentences in words."""
    choices = passage - alone + 1
    p = np.arange(max(0, len(hashed) - passage + 1))
    if not len(p):
        return p
    least = np.full(len(hashed) + 1, 2 * len(hashed) + passage)
    np.minimum.at(least, a, b)
    least = np.minimum.accumulate(least[::-1])[::-1]  # of runs that start here or later, the first stop
    p = p[(of[p] == of[p + passage - 1]) & (least[p + 1] >= p + passage)]
    first = np.arange(len(hashed) - alone + 1)
    print_ = _run_hash(hashed, first, first + alone)
    chosen = np.zeros(len(first), dtype=bool)
    for k in range(0, len(p), 1 << 16):
        near = p[k : k + (1 << 16), None] + np.arange(choices)
        value = print_[near]
        # equal windows: one place in so many, else a repeated word would give a window each
        tied = np.where(value == value.min(axis=1)[:, None], near % choices, choices)
        chosen[near[np.arange(len(near)), tied.argmin(axis=1)]] = True
    return np.flatnonzero(chosen)


def runs(data: np.ndarray, at: np.ndarray, sentences: int, words: int, alone: int, passage: int):
    """(text index, first sentence, stop, hash, hash) of every run; sentences count from 0 in each text, words of windows from WORDS."""
    none = np.zeros(0, np.int64)
    if not len(data):
        return none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    lower = _text.LOWER[data]
    begin, stop, of = _text.spans(lower, at, ~_text.SPACE[lower])
    hashed = _text.span_hashes(lower, begin, stop)
    ends = sentence_ends(data, at)
    text = np.searchsorted(at, ends - 1, "right") - 1
    base = np.searchsorted(text, np.arange(len(at) - 1))  # each text's first sentence
    limit = np.searchsorted(text, np.arange(len(at) - 1), "right")
    # words before each sentence; a sentence's words are between its bound and the next
    bound = np.concatenate([[0], np.searchsorted(begin, ends)])
    k = np.arange(len(ends))
    full = bound[1:] > bound[:-1]
    filled = np.concatenate([[0], np.cumsum(full)])  # sentences with words, before each
    nth = np.append(np.flatnonzero(full), len(ends))
    # forwards: enough words, and enough sentences that have words
    by_words = np.searchsorted(bound, bound[k] + words)
    by_sentences = nth[np.minimum(filled[k] + sentences - 1, len(nth) - 1)] + 1
    forward = np.maximum(by_words, by_sentences)
    ok = full & (forward <= limit[text])
    # backwards
    from_words = np.searchsorted(bound, bound[k + 1] - words, "right") - 1
    behind = filled[k + 1] - sentences
    from_sentences = np.where(behind >= 0, nth[np.maximum(behind, 0)], -1)
    back = np.minimum(np.where(bound[k + 1] >= words, from_words, -1), from_sentences)
    fits = full & (back >= base[text]) & (back >= 0)
    single = full & (bound[1:] - bound[:-1] >= alone)
    first = np.concatenate([k[ok], back[fits], k[single]])
    end = np.concatenate([forward[ok], k[fits] + 1, k[single] + 1])
    both = np.unique(first * (len(ends) + 1) + end)
    first, end = both // (len(ends) + 1), both % (len(ends) + 1)
    a, b = bound[first], bound[end]
    salted = _text.mix(hashed ^ _SALT)
    w = windows(hashed, of, a, b, alone, passage)
    place = w - np.searchsorted(of, of[w]) + WORDS
    return (
        np.concatenate([text[first], of[w]]), np.concatenate([first - base[text[first]], place]), np.concatenate([end - base[text[first]], place + alone]),
        np.concatenate([_run_hash(hashed, a, b), _run_hash(hashed, w, w + alone) ^ _WINDOW]), np.concatenate([_run_hash(salted, a, b), _run_hash(salted, w, w + alone)]),
    )


def _spans(sentences: int, words: int, alone: int, passage: int):
    def run(batches):
        for whole in batches:
            for batch in _text.passes(whole, "text"):
                of, first, stop, h1, h2 = runs(*_text.utf8(batch.column("text")), sentences, words, alone, passage)
                of = pa.array(of)
                yield pa.RecordBatch.from_arrays([
                    batch.column("doc_id").take(of), batch.column("print").take(of), pa.array(first.astype(np.int32)), pa.array(stop.astype(np.int32)), pa.array(h1.view(np.int64)), pa.array((h2 >> np.uint64(32)).astype(np.uint32).view(np.int32)),
                ], ["doc_id", "print", "start", "stop", "h1", "h2"])
    return run


def _removed(names: list[str]):
    def run(batches):
        for whole in batches:
            for batch in _text.passes(whole, "text"):
                data, at = _text.utf8(batch.column("text"))
                ends = sentence_ends(data, at)
                text = np.searchsorted(at, ends - 1, "right") - 1
                counts = np.bincount(text, minlength=batch.num_rows)
                gone = np.zeros(batch.num_rows, dtype=np.int64)
                kept = batch.column("text").to_pylist() if batch.column("covered").null_count < batch.num_rows else None
                for k, covered in enumerate(batch.column("covered").to_pylist()) if kept else ():
                    if covered:
                        mine = ends[np.searchsorted(text, k) : np.searchsorted(text, k, "right")] - at[k]
                        own = data[at[k] : at[k + 1]]
                        edges = np.concatenate([[0], mine])
                        begins = np.append(_text.spans(own, np.array([0, len(own)]), ~_text.SPACE[own])[0], len(own)) if any(c["start"] >= WORDS for c in covered) else None
                        cuts = np.array([begins[[c["start"] - WORDS, c["stop"] - WORDS]] if c["start"] >= WORDS else edges[[c["start"], c["stop"]]] for c in covered])
                        drop = np.zeros(len(own) + 1, dtype=np.int64)
                        np.add.at(drop, cuts[:, 0], 1)
                        np.add.at(drop, cuts[:, 1], -1)
                        stays = np.cumsum(drop[:-1]) == 0
                        kept[k] = own[stays].tobytes().decode()
                        gone[k] = int((~np.logical_and.reduceat(stays, edges[:-1])).sum())
                column = batch.column("text") if kept is None else pa.array(kept, pa.string())
                yield pa.RecordBatch.from_arrays([*(column if c == "text" else batch.column(c) for c in names), pa.array(counts), pa.array(gone)], [*names, "n_sentences", "n_removed"])
    return run


def remove_repeats(docs: DataFrame, sentences: int = 2, words: int = 24, alone: int = 40, passage: int = 51) -> DataFrame:
    """docs (doc_id, text, ...) with repeated passages cut from text, plus n_sentences and n_removed (sentences cut whole or in part).

    Every row comes back once, in no order.  Null and empty texts have no
    sentence and stay as they are.  Rows alike in doc_id and text are one
    document: they keep and lose the same sentences.  A null doc_id sorts first.
    Texts of any length are handled whole.  Columns named n_sentences and
    n_removed are replaced; others are kept, whatever their names.
    """
    scratch = Scratch(docs.sparkSession, "spans")
    kept = docs.drop("n_sentences", "n_removed")
    kind = kept.schema["doc_id"].dataType.simpleString()
    # inside, columns stand under their places, so that no name clashes
    names = [{"doc_id": "doc_id", "text": "text"}.get(c, f"c{k}") for k, c in enumerate(kept.columns)]
    marked = kept.toDF(*names).withColumn("print", F.xxhash64("text"))
    runs_of = _spans(sentences, words, alone, passage)
    spans = scratch.keep("runs", marked.select("doc_id", "print", "text").mapInArrow(runs_of, f"doc_id {kind}, print long, start int, stop int, h1 long, h2 int"))
    place = F.struct("doc_id", "print", "start")
    first = spans.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.count("*").alias("times")).where("times > 1").select("h1", "h2", "first")
    # written, so that both sides of the next join are plain shuffles and adaptive execution can split a passage that many texts hold
    first = scratch.keep("first", first)
    later = spans.join(first, ["h1", "h2"]).where(~place.eqNullSafe(F.col("first")))
    covered = later.select("doc_id", "print", "start", "stop").distinct().groupBy("doc_id", "print").agg(F.collect_list(F.struct("start", "stop")).alias("covered"))
    covered = scratch.keep("covered", covered.select(F.col("doc_id").alias("in_doc"), F.col("print").alias("in_print"), "covered"))
    scratch.only("covered")
    # covered grows with the documents, so it is never broadcast
    joined = marked.join(covered.hint("merge"), (F.col("print") == F.col("in_print")) & F.col("doc_id").eqNullSafe(F.col("in_doc")), "left").select(*names, "covered")
    fields = [StructField(n, f.dataType) for n, f in zip(names, kept.schema.fields, strict=True)]
    cut = joined.mapInArrow(_removed(names), StructType(fields).add("n_sentences", LongType()).add("n_removed", LongType()))
    return cut.toDF(*kept.columns, "n_sentences", "n_removed")
