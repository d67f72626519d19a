"""Nearest neighbours by a permutation index.

A vector is represented by the order of its ``LENGTH`` nearest pivots of a
sample.  Each block of vectors is an inverted file: per pivot the vectors that
list it, with its place.  With places r, and the length where a pivot is missing,
the footrule distance of two lists is a constant less twice the sum of length -
max(r, r') over their shared pivots, so a query reads only the postings of its
own pivots.  The nearest by footrule are reranked by inner product in double
precision.

Vectors are dealt to blocks by their first pivot; one that many vectors share
gets several blocks.  A query goes only to the blocks of its first ``probe``
pivots (and on until they hold enough vectors), and streams past a block's
vectors, which are the only rows that a task holds.  How many pivots are probed
and how near by footrule a vector is reranked is measured, not assumed: for
``TRIALS`` of the queries all vectors are compared by brute force, and both are
set so that ``aim`` of their true neighbours are found.
So clustered vectors are searched in a few blocks, and vectors without structure
in as many as it takes.
"""

from __future__ import annotations

from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from hearthbook.llm._store import Scratch
from hearthbook.llm._text import mix

BLOCK, LEAST, LENGTH, TRIALS = 4096, 256, 64, 64
FEWEST_PIVOTS, MOST_PIVOTS = 256, 4096


def usable(vectors: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    """(row, id, vector) of the rows that take part; null, zero and non-finite vectors do not.

    row tells rows apart whose ids repeat or are null; the table is written, so it stays
    the same.  Single-precision vectors stay so where they are stored and shuffled, at
    half the bytes; all products are taken in double precision.
    """
    single = isinstance(vectors.schema[vector_column].dataType.elementType, FloatType)
    parts = vectors.select(F.col(id_column).alias("id"), F.col(vector_column).cast("array<float>" if single else "array<double>").alias("vector")).where("vector is not null")
    fine = parts.where("forall(vector, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(vector, x -> x <> 0)")
    return Scratch(vectors.sparkSession, "vectors").keep("usable", fine.select(F.monotonically_increasing_id().alias("row"), "id", "vector"))


def nearest_pivots(vectors: np.ndarray, pivots: np.ndarray, length: int) -> np.ndarray:
    """(vectors, length): each row's pivots by falling inner product, whatever the vectors' size."""
    even = vectors / np.abs(vectors).max(axis=1, keepdims=True) if len(vectors) else vectors
    return np.argsort(-(even @ pivots.T), axis=1, kind="stable")[:, :length]


class InvertedFile:
    """Per pivot one row: how early each vector lists it, the length less its place, and 0 where it does not."""

    def __init__(self, lists: np.ndarray, pivots: int):
        self.count, self.length = lists.shape
        self.early = np.zeros((pivots, self.count), dtype=np.uint8)
        self.early[lists, np.arange(self.count)[:, None]] = self.length - np.arange(self.length)

    def shared(self, own: np.ndarray) -> np.ndarray:
        """What each vector's footrule distance from a query's list falls short of the largest, halved."""
        mine = (self.length - np.arange(len(own))).astype(np.uint8)[:, None]
        return np.minimum(self.early[own], mine).sum(axis=0, dtype=np.uint16).astype(np.int64)


def best_of(vectors: np.ndarray, shared: np.ndarray, query: np.ndarray, besides: int, k: int, enough: int) -> tuple[np.ndarray, np.ndarray]:
    """(vector numbers, scores) of the k best of those that share ``enough`` with the query, or of the LEAST nearest by footrule, without one.

    Vectors stand in the order that ties go.
    """
    found = np.flatnonzero(shared >= enough)
    if len(found) < min(LEAST, len(shared)):
        # a reversed number makes ties go to the front, so that repeated vectors cannot push each other out of order
        order = shared * len(shared) + np.arange(len(shared) - 1, -1, -1)
        found = np.sort(np.argpartition(-order, min(LEAST, len(shared)) - 1)[:LEAST])
    found = found[found != besides]
    scores = (vectors[found] * query).sum(axis=1)
    best = np.lexsort((found, -np.nan_to_num(scores, nan=-np.inf, posinf=np.inf, neginf=-np.inf)))[:k]
    return found[best], scores[best]


def _arrays(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _tried(queries: np.ndarray, query_rows: np.ndarray, pivots: np.ndarray, length: int, k: int):
    """Per batch and trial query the k nearest by brute force: the turn of their first pivot for the query, and what they share."""
    own = nearest_pivots(queries, pivots, len(pivots))
    turn = np.argsort(own, axis=1)

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            vectors, rows = _arrays(batch.column("vector")), batch.column("row").to_numpy()
            lists, found = nearest_pivots(vectors, pivots, length), []
            file = InvertedFile(lists, len(pivots))
            for q, query in enumerate(queries):
                shared = file.shared(own[q, :length])
                best, scores = best_of(vectors, shared, query, int(np.append(np.flatnonzero(rows == query_rows[q]), -1)[0]), k, 0)
                found.append((np.full(len(best), q), turn[q, lists[best, 0]], shared[best], np.nan_to_num(scores, nan=-np.inf)))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*found, strict=True)], ["q", "turn", "shared", "score"])

    return run


def calibrate(vectors: DataFrame, queries: DataFrame, pivots: np.ndarray, length: int, k: int, aim: float) -> tuple[int, int]:
    """(pivots to probe, share of the lists that is enough) by which ``aim`` of the true neighbours of up to TRIALS queries is found."""
    drawn = queries.orderBy(F.xxhash64("id", "row"), "row").limit(TRIALS).collect()
    if not drawn:
        return len(pivots), 0
    asked, rows = np.array([r["vector"] for r in drawn]), np.array([r["row"] for r in drawn])
    seen = vectors.select("row", "vector").mapInArrow(_tried(asked, rows, pivots, length, k), "q long, turn long, shared long, score double")
    place = F.row_number().over(W.partitionBy("q").orderBy(F.desc("score"), F.desc("shared")))
    near = seen.withColumn("k", place).where(F.col("k") <= k).select("turn", "shared").collect()  # TRIALS * k at most
    if not near:
        return len(pivots), 0
    lost = (1 - aim) / 2  # either step may lose half of what may be lost
    return int(np.quantile([r["turn"] for r in near], 1 - lost, method="higher")) + 1, int(np.quantile([r["shared"] for r in near], lost, method="lower"))


def _searched(pivots: np.ndarray, length: int, k: int, enough: int):
    """Rows of a block stand together, its vectors in the order that ties go, then its queries."""

    def run(batches):
        block, parts, ready = None, [], None
        for batch in batches:
            places, asks = batch.column("block").to_numpy(), batch.column("asks").to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero((places[1:] != places[:-1]) | (asks[1:] != asks[:-1])) + 1
            for a, b in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
                if a == b:
                    continue
                piece = batch.slice(a, b - a)
                if places[a] != block:
                    block, parts, ready = places[a], [], None
                if not asks[a]:
                    parts.append(piece)
                    continue
                if not parts:
                    continue  # queries of a block without vectors
                if ready is None:
                    vectors = np.concatenate([_arrays(p.column("vector")) for p in parts])
                    rows = np.concatenate([p.column("row").to_numpy() for p in parts])
                    ids = pa.concat_arrays([p.column("id") for p in parts])
                    at = {r: n for n, r in enumerate(rows.tolist())}
                    ready = vectors, rows, ids, at, InvertedFile(nearest_pivots(vectors, pivots, length), len(pivots))
                vectors, rows, ids, at, file = ready
                queries, query_rows = _arrays(piece.column("vector")), piece.column("row").to_numpy()
                for start in range(0, len(queries), 1024):
                    some = slice(start, start + 1024)
                    own = nearest_pivots(queries[some], pivots, length)
                    found = [best_of(vectors, file.shared(o), q, at.get(r, -1), k, enough) for q, o, r in zip(queries[some], own, query_rows[some].tolist(), strict=True)]
                    best, each = np.concatenate([f for f, _ in found]), np.array([len(f) for f, _ in found])
                    of = pa.array(np.repeat(np.arange(len(found)), each) + start)
                    yield pa.RecordBatch.from_arrays(
                        [piece.column("row").take(of), piece.column("id").take(of), pa.array(rows[best]), ids.take(pa.array(best)), pa.array(np.concatenate([s for _, s in found]))],
                        ["query_row", "query_id", "vec_row", "vec_id", "score"],
                    )

    return run


def _cells(pivots: np.ndarray):
    def run(batches):
        for batch in batches:
            if batch.num_rows:
                cells, n = np.unique(nearest_pivots(_arrays(batch.column("vector")), pivots, 1), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(cells.astype(np.int32)), pa.array(n)], ["cell", "n"])

    return run


def layout(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(first block, number of blocks) of each cell, and all blocks: small cells share one, large ones are dealt over several."""
    first, parts, blocks, room = np.zeros(len(counts), np.int64), np.ones(len(counts), np.int64), 0, 0
    for cell, n in enumerate(counts.tolist()):
        if blocks and n <= room:
            first[cell], room = blocks - 1, room - n
        else:
            first[cell], parts[cell] = blocks, max(1, ceil(n / BLOCK))
            blocks, room = blocks + int(parts[cell]), BLOCK - n if n < BLOCK else 0
    return first, parts, max(1, blocks)


def _homes(pivots: np.ndarray, first: np.ndarray, parts: np.ndarray):
    """Vectors with a block of their first pivot."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                cell = nearest_pivots(_arrays(batch.column("vector")), pivots, 1)[:, 0]
                block = first[cell] + (mix(batch.column("row").to_numpy().astype(np.uint64)) % parts[cell].astype(np.uint64)).astype(np.int64)
                yield _placed(block, False, batch)

    return run


def _visits(pivots: np.ndarray, first: np.ndarray, parts: np.ndarray, counts: np.ndarray, probe: int, most: int):
    """Queries with every block of their first ``probe`` pivots, and of more until those have ``most`` vectors."""

    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                piece = batch.slice(start, 256)
                near = nearest_pivots(_arrays(piece.column("vector")), pivots, len(pivots))
                short = (np.cumsum(counts[near], axis=1) < most).sum(axis=1) + 1
                of, turn = np.nonzero(np.arange(len(pivots)) < np.maximum(probe, short)[:, None])
                cell = near[of, turn]
                each = parts[cell]
                block = np.repeat(first[cell] - (np.cumsum(each) - each), each) + np.arange(each.sum())
                of, block = np.unique(np.stack([np.repeat(of, each), block]), axis=1)
                yield _placed(block, True, piece.take(pa.array(of)))

    return run


def _placed(block: np.ndarray, asks: bool, rows: pa.RecordBatch) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(block.astype(np.int32)), pa.array(np.full(len(block), asks)), *(rows.column(c) for c in ("id", "row", "vector"))], ["block", "asks", "id", "row", "vector"])


def search(vectors: DataFrame, queries: DataFrame, k: int = 20, aim: float = 0.96) -> DataFrame:
    """vectors and queries (row, id, vector), as ``usable`` gives them -> query_id, rank, vec_id, score.

    Each query row gets its k nearest found by inner product, nearest first, ties to
    the smaller id (null ids last); its own row is never an answer, other rows
    with its id may be.  Vectors of another length than the most common one have no
    inner product with the others and take no part.  A product that overflows to no
    number ranks last.  Empty tables give no rows.
    """
    spark = vectors.sparkSession
    kind = vectors.schema["id"].dataType.simpleString()
    sizes = vectors.groupBy(F.size("vector").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if sizes is None:
        return spark.createDataFrame([], f"query_id {kind}, rank int, vec_id {kind}, score double")
    vectors, queries = (x.where(F.size("vector") == sizes["d"]) for x in (vectors, queries))
    most = min(MOST_PIVOTS, max(FEWEST_PIVOTS, sizes["count"] // BLOCK))
    # a bounded sample: four draws a pivot, so that repeated vectors leave enough different ones
    drawn = vectors.orderBy(F.xxhash64("vector", "id"), "row").limit(4 * most).collect()
    pivots = np.array(list(dict.fromkeys(tuple(r["vector"]) for r in drawn))[:most])
    pivots /= np.abs(pivots).max(axis=1, keepdims=True)
    length = min(LENGTH, len(pivots))
    probe, enough = calibrate(vectors, queries, pivots, length, k, aim)

    cells = vectors.mapInArrow(_cells(pivots), "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect()  # one row a pivot
    counts = np.zeros(len(pivots), np.int64)
    counts[[r["cell"] for r in cells]] = [r["n"] for r in cells]
    first, parts, blocks = layout(counts)
    shape = f"block int, asks boolean, id {kind}, row long, vector {vectors.schema['vector'].dataType.simpleString()}"
    held = vectors.mapInArrow(_homes(pivots, first, parts), shape)
    asked = queries.mapInArrow(_visits(pivots, first, parts, counts, probe, 2 * k + 1), shape)
    dealt = held.unionAll(asked).repartition(blocks, "block").sortWithinPartitions("block", "asks", F.asc_nulls_last("id"), "row")
    found = dealt.mapInArrow(_searched(pivots, length, k, enough), f"query_row long, query_id {kind}, vec_row long, vec_id {kind}, score double")
    best = W.partitionBy("query_row").orderBy(F.nanvl("score", F.lit(float("-inf"))).desc(), F.asc_nulls_last("vec_id"), "vec_row")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
