"""Toxicity by non-negative positive-unlabelled learning.

Training sees confirmed toxic texts (P) and texts drawn from the whole corpus
without looking at their labels (U).  With the class prior pi, the risk

    pi * R_P(+1) + max(0, R_U(-1) - pi * R_P(-1))

is minimised over a linear model with the sigmoid loss; where the second term
turns negative the step is taken against it (Kiryo et al., 2017).  Features are
hashed lower-cased words (runs of ASCII letters and non-ASCII bytes) and their
first four to eight bytes, each counted once per text; those are kept whose
rates in P and U make a text toxic with probability one half or more.

The two samples are bounded by ``positives`` and ``unlabelled`` rows (by a hash
of doc_id, so reruns agree).  The class prior is the share of toxic labels among
all labels given for training, so labelled harmless texts count there and nowhere
else; every whole text is scored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructType

from hearthbook.llm import _text
from hearthbook.llm._store import Scratch

BITS, FEATURES, STEPS, RATE, DECAY = 20, 2048, 300, 0.05, 1e-4
LEAST, EVIDENCE, STARTS = 3, 0.5, (4, 5, 6, 7, 8)
_LETTER = np.zeros(256, dtype=bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True


def features(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(feature, text index) of every word and word start; features repeat as the words do."""
    lower = _text.LOWER[data]
    starts, ends, of = _text.spans(lower, at, _LETTER[lower])
    every = [_text.span_hashes(lower, starts, ends)]
    for size in STARTS:
        every.append(_text.span_hashes(lower, starts, np.minimum(ends, starts + size)) * np.uint64(2 * size + 1))
    hashed = np.concatenate([_text.mix(h) >> np.uint64(64 - BITS) for h in every]).astype(np.int64)
    return hashed, np.concatenate([of] * len(every))


def _sampled(batches):
    for whole in batches:
        for batch in _text.passes(whole, "text"):
            hashed, of = features(*_text.utf8(batch.column("text")))
            order = np.argsort(of, kind="stable")
            cuts = np.searchsorted(of[order], np.arange(batch.num_rows + 1))
            yield pa.RecordBatch.from_arrays([
                batch.column("positive"), pa.array([np.unique(hashed[order[a:b]]).astype(np.int32).tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary()),
            ], ["positive", "features"])


def _counted(batches):
    """Texts of either sample that have a feature, summed over a batch."""
    for batch in batches:
        positive = np.array(batch.column("positive").to_pylist(), dtype=bool)
        sets = [np.frombuffer(f.as_buffer(), np.int32) for f in batch.column("features")]
        none = np.zeros(0, np.int32)
        (fp, cp), (fu, cu) = (np.unique(np.concatenate([none, *(s for s, p in zip(sets, positive, strict=True) if p is side)]), return_counts=True) for side in (np.True_, np.False_))
        yield pa.RecordBatch.from_arrays([
            pa.array(np.concatenate([fp, fu])), pa.array(np.concatenate([cp, np.zeros_like(cu)])), pa.array(np.concatenate([np.zeros_like(cp), cu])),
        ], ["feature", "p", "u"])


def _chosen(chosen: np.ndarray):
    """Each text's places among the chosen features."""
    def run(batches):
        for batch in batches:
            sets = (np.frombuffer(f.as_buffer(), np.int32) for f in batch.column("features"))
            yield pa.RecordBatch.from_arrays([batch.column("positive"), pa.array([np.flatnonzero(np.isin(chosen, s)).astype(np.int16).tobytes() for s in sets], pa.binary())], ["positive", "slots"])
    return run


def step(xp: np.ndarray, xu: np.ndarray, w: np.ndarray, b: float, prior: float) -> tuple[float, np.ndarray, bool]:
    """(risk, gradient by weights and bias, whether it descends) for tables of texts by features.

    Where the estimate of the negative texts' risk is below 0, the gradient is
    that of its size, which the step takes back up.
    """
    sp, su = (1 / (1 + np.exp(-np.clip(x @ w + b, -30, 30))) for x in (xp, xu))
    # sigmoid loss: l(+1) = 1 - s, l(-1) = s, both with slope s * (1 - s)
    dp, du = sp * (1 - sp) / len(sp), su * (1 - su) / len(su)
    negative = float(su.mean() - prior * sp.mean())
    to_p, to_u = (-2 * prior * dp, du) if negative >= 0 else (prior * dp, -du)
    gradient = np.append(to_p.astype(w.dtype) @ xp + to_u.astype(w.dtype) @ xu + DECAY * w, to_p.sum() + to_u.sum())
    return float(prior * (1 - sp).mean() + max(0.0, negative)), gradient, negative >= 0


def fit(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, size: int) -> tuple[np.ndarray, float]:
    """(weights of size features, bias) from the features that the texts of both samples have."""
    bias = float(np.log(max(prior, 1e-3) / (1 - min(prior, 0.999))))
    w, b = np.zeros(size, dtype=np.float32), bias
    if not positive or not unlabelled or not size:
        return w, b

    def table(sets: list[np.ndarray]) -> np.ndarray:
        out = np.zeros((len(sets), size), dtype=np.float32)
        for k, s in enumerate(sets):
            out[k, s] = 1
        return out

    xp, xu = table(positive), table(unlabelled)
    first, second = np.zeros(size + 1), np.zeros(size + 1)
    for turn in range(1, STEPS + 1):
        _, gradient, _ = step(xp, xu, w, b, prior)
        first, second = 0.9 * first + 0.1 * gradient, 0.999 * second + 0.001 * gradient**2
        move = RATE * (first / (1 - 0.9**turn)) / (np.sqrt(second / (1 - 0.999**turn)) + 1e-8)
        w, b = w - move[:-1].astype(np.float32), b - move[-1]
    return w, float(b)


def train(docs: DataFrame, labels: DataFrame, positives: int = 2000, unlabelled: int = 6000) -> tuple[np.ndarray, np.ndarray, float]:
    """(features, weights, bias) from docs (doc_id, text) and labels (doc_id, toxic); rows with null ids are left out.

    The samples' feature sets stay in a written table; the driver gets the chosen
    features (``FEATURES`` at most) and which of them each sampled text has.
    """
    marked = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    many = marked.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.when(F.col("toxic") == 1, 1).otherwise(0)), F.lit(0)).alias("p")).first()
    prior, total = many["p"] / max(1, many["n"]), docs.where("doc_id is not null").count()
    place = "pmod(xxhash64(doc_id, {}), 1000000) < {}"
    share = lambda most, of: int(1_000_000 * min(1.0, most / max(1, of)))
    ids = marked.where("toxic = 1").where(place.format(1, share(positives, many["p"]))).select("doc_id")
    # a binomial draw around ``positives`` rows, so its ids are small enough for every executor
    sample = docs.where("doc_id is not null").select("doc_id", "text")
    p = sample.join(F.broadcast(ids), "doc_id").select(F.lit(True).alias("positive"), "text")
    u = sample.where(place.format(2, share(unlabelled, total))).select(F.lit(False).alias("positive"), "text")
    held = Scratch(docs.sparkSession, "toxicity").keep("sample", p.unionAll(u).mapInArrow(_sampled, "positive boolean, features binary"))
    sizes = {r["positive"]: r["count"] for r in held.groupBy("positive").count().collect()}
    if len(sizes) < 2:
        return np.zeros(0, np.int32), *fit([], [], prior, 0)
    counts = held.mapInArrow(_counted, "feature int, p long, u long").groupBy("feature").agg(F.sum("p").alias("p"), F.sum("u").alias("u"))
    # by Bayes' rule pi * p / u is the chance that a text with the feature is toxic; one more text in U keeps rare ones honest
    chance = F.lit(prior * sizes[False] / sizes[True]) * F.col("p") / (F.col("u") + 1)
    best = counts.where(F.col("p") >= LEAST).where(chance >= EVIDENCE).orderBy(chance.desc(), "feature").limit(FEATURES)
    chosen = np.array(sorted(r["feature"] for r in best.select("feature").collect()), dtype=np.int32)
    rows = held.mapInArrow(_chosen(chosen), "positive boolean, slots binary").collect()
    sets = {k: [np.frombuffer(r["slots"], np.int16) for r in rows if r["positive"] is k] for k in (True, False)}
    return chosen, *fit(sets[True], sets[False], prior, len(chosen))


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, float]) -> DataFrame:
    """docs plus score (0 to 1, higher is likelier toxic).

    Null, empty and letterless texts get the model's base score.  Rows that
    repeat are scored alike; a column named score is replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    before = docs.drop("score")
    # inside, columns stand under their places, so that no name clashes
    names = ["text" if c == "text" else f"c{k}" for k, c in enumerate(before.columns)]
    kept = before.toDF(*names)

    def run(batches):
        chosen, learned, bias = shared.value
        weights, used = np.zeros(1 << BITS, dtype=np.float32), np.zeros(1 << BITS, dtype=bool)
        weights[chosen], used[chosen] = learned, True
        for whole in batches:
            for batch in _text.passes(whole, "text"):
                hashed, of = features(*_text.utf8(batch.column("text")))
                live = used[hashed]
                once = np.unique(of[live] * (1 << BITS) + hashed[live])
                total = bias + np.bincount(once >> BITS, weights=weights[once & ((1 << BITS) - 1)], minlength=batch.num_rows)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(1 / (1 + np.exp(-np.clip(total, -30, 30))))], [*names, "score"])

    return kept.mapInArrow(run, StructType([*kept.schema.fields]).add("score", DoubleType())).toDF(*before.columns, "score")
