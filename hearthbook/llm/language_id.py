"""Language identification with error-correcting output codes.

Each language has a codeword; a binary classifier per bit predicts it from
hashed byte n-grams (two to four bytes of the lower-cased text, weighted by the
square root of their share).  Decoding adds up, per language, the logistic loss
of every bit's margin against the codeword, weighted by the bit's accuracy on
its training sample, and takes the least.  A text whose two best languages lie
closer than ``gap`` is flagged as ambiguous.

Up to six languages get the exhaustive code of 2**(k-1) - 1 bits; more get 15
bits per doubling, drawn with a fixed seed for the largest distance found.  The
training sample is bounded by ``per_language`` rows of each and ``sampled`` rows
in all; every whole text is scored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StringType, StructType

from hearthbook.llm import _text

BITS, SIZES, STEPS = 13, (2, 3, 4), 150


def codewords(count: int) -> np.ndarray:
    """(count, bits) of -1 and 1; columns are distinct splits of the languages, rows are distinct."""
    if count <= 1:
        return np.ones((count, 1))
    if count <= 6:
        splits = np.arange(1, 1 << (count - 1))
        return np.array([[1.0 if k < count - 1 and s >> k & 1 else -1.0 for s in splits] for k in range(count)])
    draw, best, far = np.random.default_rng(7), None, 0
    bits = 15 * int(np.ceil(np.log2(count)))
    turn = 0
    while best is None or turn < 50:
        turn += 1
        splits: dict[bytes, np.ndarray] = {}
        while len(splits) < bits:  # there are 2**(count - 1) - 1 splits, more than the bits
            split = draw.choice([-1.0, 1.0], size=count) if count > 8 else 1.0 - 2.0 * (draw.integers(1, 1 << (count - 1)) >> np.arange(count) & 1)
            split *= split[-1]
            if (split < 0).any():
                splits[split.tobytes()] = split
        code = np.stack(list(splits.values()), axis=1)
        apart = int((bits - (code @ code.T - 2 * bits * np.eye(count)).max()) // 2)  # of the two nearest words
        if apart > far:
            best, far = code, apart
    return best


def grams(data: np.ndarray, at: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Per size, (bucket, text index) of every byte n-gram that lies inside one text; white space reads as one blank."""
    low = _text.LOWER[data]
    low = np.where(_text.SPACE[low], np.uint8(32), low).astype(np.uint32)
    of = np.repeat(np.arange(len(at) - 1), np.diff(at))
    buckets, texts = [], []
    for size in SIZES:
        n = len(low) - size + 1
        if n <= 0:
            continue
        code = np.zeros(n, dtype=np.uint32)
        for k in range(size):
            code = code * np.uint32(256) + low[k : k + n]
        inside = of[:n] == of[size - 1 :]
        hashed = ((code ^ np.uint32(size * 0x1F123BB5)) * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS)
        buckets.append(hashed[inside])
        texts.append(of[:n][inside])
    return buckets, texts


def shares(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """(texts, buckets): square roots of the n-grams' shares, of length one."""
    texts = len(at) - 1
    out = np.zeros((texts, 1 << BITS), dtype=np.float32)
    for bucket, of in zip(*grams(data, at), strict=True):
        cuts = np.searchsorted(of, np.arange(texts + 1))
        for k in np.flatnonzero(np.diff(cuts)):
            out[k] += np.bincount(bucket[cuts[k] : cuts[k + 1]], minlength=1 << BITS)
    np.sqrt(out, out=out)
    return out / np.maximum(np.sqrt((out**2).sum(axis=1, keepdims=True)), 1e-9)


def _sampled(batches):
    for whole in batches:
        for batch in _text.passes(whole, "text", rows=512):
            rows = shares(*_text.utf8(batch.column("text"))).astype(np.float16)
            used = [np.flatnonzero(r).astype(np.uint16) for r in rows]
            yield pa.RecordBatch.from_arrays([
                batch.column("lang"), pa.array([u.tobytes() for u in used], pa.binary()), pa.array([r[u].tobytes() for r, u in zip(rows, used, strict=True)], pa.binary()),
            ], ["lang", "buckets", "shares"])


def fit(x: np.ndarray, y: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(weights, biases, bit weights): one logistic classifier per bit, by full-batch Adam."""
    goal = code[y]
    # every language weighs the same, whatever its share of the sample
    each = (1 / np.bincount(y, minlength=len(code)).clip(1))[y][:, None] / len(code)
    w, b = np.zeros((x.shape[1], code.shape[1]), np.float32), np.zeros(code.shape[1])
    moments = [np.zeros_like(w), np.zeros_like(w), np.zeros_like(b), np.zeros_like(b)]
    for step in range(1, STEPS + 1):
        pull = -goal / (1 + np.exp(np.clip(goal * (x @ w + b), -30, 30))) * each
        for k, gradient in ((0, x.T @ pull.astype(np.float32) + 1e-6 * w), (2, pull.sum(axis=0))):
            moments[k] = 0.9 * moments[k] + 0.1 * gradient
            moments[k + 1] = 0.999 * moments[k + 1] + 0.001 * gradient**2
            move = 0.3 * (moments[k] / (1 - 0.9**step)) / (np.sqrt(moments[k + 1] / (1 - 0.999**step)) + 1e-8)
            if k == 0:
                w = (w - move).astype(np.float32)
            else:
                b = b - move
    right = (((x @ w + b) * goal > 0) * each).sum(axis=0)
    return w, b, np.maximum(2 * right - 1, 0.01)


def train(docs: DataFrame, per_language: int = 300, sampled: int = 6000, most: int = 1000) -> dict:
    """Fits on docs (doc_id, text, lang); rows without a language or text are left out.

    Rows are drawn by a hash of doc_id and text, about ``per_language`` of each
    language, fewer where those were more than ``sampled`` in all.  More than
    ``most`` languages are an error: then the column holds something else.
    """
    known = docs.where("lang is not null and text is not null")
    counts = known.groupBy("lang").agg(F.count("*").alias("n"))
    languages = counts.limit(most + 1).count()
    if languages > most:
        raise ValueError(f"more than {most} languages")
    if not languages:
        return {"names": []}
    each = min(per_language, sampled // languages)
    # a row a language, of which there are few, as was just counted
    rates = F.broadcast(counts.select("lang", (F.lit(1_000_000) * F.least(F.lit(1.0), F.lit(each) / F.col("n"))).alias("rate")))
    drawn = known.join(rates, "lang").where(F.pmod(F.xxhash64("doc_id", "text", F.lit(3)), F.lit(1_000_000)) < F.col("rate"))
    rows = drawn.select("lang", "text").mapInArrow(_sampled, "lang string, buckets binary, shares binary").collect()
    names = sorted({r["lang"] for r in rows})
    if not rows:
        return {"names": []}
    x = np.zeros((len(rows), 1 << BITS), np.float32)
    for k, r in enumerate(rows):
        x[k, np.frombuffer(r["buckets"], np.uint16)] = np.frombuffer(r["shares"], np.float16)
    code, place = codewords(len(names)), {name: k for k, name in enumerate(names)}
    w, b, trust = fit(x, np.array([place[r["lang"]] for r in rows]), code)
    return {"names": names, "code": code, "w": w, "b": b, "trust": trust}


def predict(docs: DataFrame, model: dict, gap: float = 0.1) -> DataFrame:
    """docs plus lang_pred, score (0 to 1: the decoded language's share) and ambiguous.

    A text that is null or has no letter, and any text if nothing was learned, is
    ``und`` with score 0.  Columns of these three names are replaced, others are kept.
    Every row comes back once, repeated ones with equal results; a text of any length is
    read whole; of equally near codewords the first language counts, and is flagged.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept = docs.drop("lang_pred", "score", "ambiguous")
    # inside, columns stand under their places, so that no name clashes
    names = ["text" if c == "text" else f"c{k}" for k, c in enumerate(kept.columns)]
    lettered = kept.toDF(*names).withColumn("has_letter", F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))

    def run(batches):
        m = shared.value
        for whole in batches:
            for batch in _text.passes(whole, "text", rows=512):
                rows = batch.num_rows
                letter = np.array(batch.column("has_letter").to_pylist(), dtype=bool)
                if m["names"]:
                    x = shares(*_text.utf8(batch.column("text")))
                    margin = x @ m["w"] + m["b"]
                    loss = np.stack([(np.log1p(np.exp(-np.clip(margin * word, -30, 30))) * m["trust"]).sum(axis=1) for word in m["code"]], axis=1)
                    odds = np.exp(loss.min(axis=1, keepdims=True) - loss)
                    odds /= odds.sum(axis=1, keepdims=True)
                    best, ranked = odds.argmax(axis=1), np.sort(odds, axis=1)
                    near = ranked[:, -1] - ranked[:, -2] < gap if odds.shape[1] > 1 else np.zeros(rows, bool)
                    called = [m["names"][k] if ok else "und" for k, ok in zip(best, letter, strict=True)]
                    sure = np.where(letter, odds.max(axis=1), 0.0).astype(np.float64)
                else:
                    called, sure, near = ["und"] * rows, np.zeros(rows), np.ones(rows, bool)
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(called, pa.string()), pa.array(sure), pa.array(near | ~letter)], [*names, "lang_pred", "score", "ambiguous"])

    schema = StructType([*lettered.drop("has_letter").schema.fields]).add("lang_pred", StringType()).add("score", DoubleType()).add("ambiguous", BooleanType())
    return lettered.mapInArrow(run, schema).toDF(*kept.columns, "lang_pred", "score", "ambiguous")
