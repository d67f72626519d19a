"""MinHash near-duplicate classes with sequential Bayesian verification.

1. Every text becomes the set of its distinct word shingles (64-bit hashes) and
   a signature of 128 minima.  Texts with equal sets are one class; one row per
   class goes on, so thousands of exact copies cost no pair.
2. Classes that agree on a band of the signature meet in a bucket.  First each
   class is compared with its bucket's pivot only (a star: no all-pairs), links
   are confirmed and components formed.  Then only classes of one bucket that
   still lie in different components are compared: those outside the bucket's
   largest component against the others.  Every candidate pair is therefore
   either verified or already inside one component.
3. A pair's signatures are compared in batches of 16.  With a uniform prior the
   similarity's posterior after m matches of n is Beta(m+1, n-m+1); the pair is
   dropped once P(similarity >= threshold) falls below ``miss``.
4. Survivors are verified exactly on the full shingle sets.

Bands are chosen by the threshold: as many rows each as let a pair that just
reaches it share no band with probability ``UNSEEN`` at most (at 0.85 21 bands of
6 rows, at 0.8 25 of 5, both 5e-5).  The posterior drops a pair at the threshold
with nearly twice ``miss`` per batch (at 0.85 and a miss of 1e-5 with 1.9e-5 in the
first and 1.8e-5 in the last), over all eight batches with up to 1e-4.
"""

from __future__ import annotations

from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearthbook.llm import _text
from hearthbook.llm._graph import components
from hearthbook.llm._store import Scratch

PERMUTATIONS, BATCH, UNSEEN = 128, 16, 5e-5
_A = (_text.mix(np.arange(1, PERMUTATIONS + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)) | np.uint64(1)).astype(np.uint32)[:, None]
_B = _text.mix(np.arange(1, PERMUTATIONS + 1, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F)).astype(np.uint32)[:, None]


def signature(hashes: np.ndarray) -> np.ndarray:
    """128 minima over the set, taken in blocks that stay in cache."""
    low = (hashes >> np.uint64(32)).astype(np.uint32) ^ hashes.astype(np.uint32)
    out = np.full(PERMUTATIONS, 0xFFFFFFFF, dtype=np.uint32)
    for k in range(0, len(low), 1024):
        np.minimum(out, (low[k : k + 1024] * _A + _B).min(axis=1), out=out)
    return out


def set_key(hashes: np.ndarray) -> bytes:
    """128 bits that equal sets share: two sums over independently mixed members, and the size."""
    salt = np.uint64(0x2545F4914F6CDD1D)
    return np.array([_text.mix(hashes ^ salt).sum(dtype=np.uint64), _text.mix(hashes * salt).sum(dtype=np.uint64) + np.uint64(len(hashes))], dtype=">u8").tobytes()


def least_matches(threshold: float, miss: float) -> np.ndarray:
    """Fewest matches of n = 16, 32, ... 128 that keep P(similarity >= threshold) at miss or more."""
    out = []
    for n in range(BATCH, PERMUTATIONS + 1, BATCH):
        tail, m = 0.0, -1
        while tail < miss:  # P(similarity >= t | m of n) = P(Binomial(n + 1, t) <= m)
            m += 1
            tail += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        out.append(m)
    return np.array(out)


def banding(threshold: float) -> tuple[int, int]:
    """(bands, rows): the most rows a band by which a pair at the threshold is missed with probability UNSEEN at most."""
    for rows in range(PERMUTATIONS, 1, -1):
        if (1 - threshold**rows) ** (PERMUTATIONS // rows) <= UNSEEN:
            return PERMUTATIONS // rows, rows
    return PERMUTATIONS, 1


def _sets(batch: pa.RecordBatch, width: int, lower: bool):
    data, at = _text.utf8(batch.column("text"))
    hashed, of = _text.shingles(_text.LOWER[data] if lower else data, at, width)
    return _text.distinct_by_text(hashed, of, batch.num_rows)


def _signed(width: int, lower: bool):
    def run(batches):
        for whole in batches:
            for batch in _text.passes(whole, "text"):
                sets, at = _sets(batch, width, lower)
                parts = [sets[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([
                    batch.column("doc_id"),
                    batch.column("print"),
                    pa.array(np.diff(at)),
                    pa.array([set_key(p) if len(p) else None for p in parts], pa.binary()),
                    pa.array([signature(p).tobytes() if len(p) else None for p in parts], pa.binary()),
                ], ["doc_id", "print", "n_shingles", "key", "sig"])
    return run


def _sets_of(width: int, lower: bool):
    """(key, text) -> (key, members); a row whose text has another key is left out."""
    def run(batches):
        for whole in batches:
            for batch in _text.passes(whole, "text"):
                sets, at = _sets(batch, width, lower)
                keys = batch.column("key").to_pylist()
                parts = [sets[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]
                held = [(k, p.tobytes()) for k, p in zip(keys, parts, strict=True) if len(p) and set_key(p) == k]
                yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in held], pa.binary()), pa.array([m for _, m in held], pa.binary())], ["key", "members"])
    return run


def _likely(threshold: float, miss: float):
    """Pairs whose posterior stays up through all batches of the signature."""
    def run(batches):
        least = least_matches(threshold, miss)
        for batch in batches:
            if not batch.num_rows:
                continue
            sig = [np.frombuffer(b"".join(batch.column(c).to_pylist()), dtype=np.uint32).reshape(-1, PERMUTATIONS) for c in ("sig_a", "sig_b")]
            alive = np.arange(batch.num_rows)
            matches = np.zeros(batch.num_rows, dtype=np.int64)
            for k, most in enumerate(least):
                at = slice(k * BATCH, (k + 1) * BATCH)
                matches[alive] += (sig[0][alive, at] == sig[1][alive, at]).sum(axis=1)
                alive = alive[matches[alive] >= most]
            yield batch.select(["a", "b"]).take(pa.array(alive))
    return run


def _linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """The exact test on two sorted sets."""
    if len(x) > len(y):
        x, y = y, x
    at = np.searchsorted(y, x)
    both = int((y[np.minimum(at, len(y) - 1)] == x).sum())
    return 100 * both >= percent * (len(x) + len(y) - both)


def _equal_enough(percent: int):
    def run(batches):
        for batch in batches:
            sets = ([np.frombuffer(m.as_buffer(), np.uint64) for m in batch.column(c)] for c in ("set_a", "set_b"))
            kept = [k for k, (x, y) in enumerate(zip(*sets, strict=True)) if _linked(x, y, percent)]
            yield batch.select(["a", "b"]).take(pa.array(kept, pa.int64()))
    return run


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, lower: bool = True, miss: float = 1e-5) -> DataFrame:
    """docs (doc_id, text, ...) -> doc_id, n_shingles, component_id, kept; one row per input row.

    Two texts are linked if 100 * |A & B| >= percent * |A | B| for their sets of
    ``width``-word shingles; component_id is the smallest doc_id of the connected
    component, kept marks the rows that carry it.  Null and wordless texts have an
    empty set, link with nothing and are kept.  Texts shorter than ``width`` words
    are one shingle.  Repeated doc_ids are separate rows (equal texts link, all rows
    with the smallest id are kept); a null doc_id never names a component unless all
    its members are null.  Other columns of docs are ignored.
    """
    scratch = Scratch(docs.sparkSession, "near")
    kind = docs.schema["doc_id"].dataType.simpleString()
    signed = docs.select("doc_id", _print(), "text").mapInArrow(_signed(width, lower), f"doc_id {kind}, print long, n_shingles long, key binary, sig binary")
    signed = scratch.keep("signed", signed)
    each = signed.where("key is not null").groupBy("key").agg(F.min("doc_id").alias("doc_id"), F.min(F.struct("doc_id", "print")).alias("place"), F.first("n_shingles").alias("n"), F.first("sig").alias("sig"))
    classes = scratch.keep("classes", each)
    roots = components(_links(docs, classes, scratch, width, percent, lower, miss), scratch, "all")
    plain = signed.select("doc_id", "n_shingles", "key")
    named = classes.select("key", "doc_id").join(roots, F.col("key") == F.col("node"), "left").select("key", "doc_id", F.coalesce("root", "key").alias("root"))
    names = named.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    lowest = named.join(names, "root").select("key", "component_id")
    found = plain.join(lowest, "key", "left").select(
        "doc_id", "n_shingles", F.when(F.col("key").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
    ).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
    found = scratch.keep("found", found)
    scratch.only("found")
    return found


def one_of_each(docs: DataFrame, width: int = 5, percent: int = 80, lower: bool = True) -> DataFrame:
    """The docs (doc_id, text, ...) that stay: one row of each component, that with the smallest doc_id.

    Of rows that share the smallest doc_id one stays; a null doc_id stays only where
    all of its component are null.  Null and wordless texts all stay.
    """
    # documents are told apart by 128 bits of their id and text; a component's smallest name starts with its smallest doc_id
    marks = [F.xxhash64(F.col("doc_id").isNull(), "doc_id", "text").alias("a"), F.xxhash64("text", "doc_id", F.lit(7)).alias("b")]
    worded = F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    rows = docs.where(worded).select(F.struct(*docs.columns).alias("doc"), *marks)
    name = F.struct(F.col("doc.doc_id").isNull().alias("unnamed"), F.col("doc.doc_id").alias("doc_id"), "a", "b")
    stay = near_duplicates(rows.select(name.alias("doc_id"), F.col("doc.text").alias("text")), width, percent, lower).where("kept").select("doc_id.a", "doc_id.b").distinct()
    # rows alike in id and text are combined before the shuffle and after it
    one = rows.join(stay.hint("merge"), ["a", "b"], "left_semi").groupBy("a", "b").agg(F.first("doc").alias("doc")).select("doc.*")
    return one.unionByName(docs.where(~worded))


def _print():
    """Tells texts under one doc_id apart."""
    return F.xxhash64("text").alias("print")


def _links(docs, classes, scratch, width, percent, lower, miss) -> DataFrame:
    """(a, b) whose components are those of all links: known components as links to their roots, and the last links found."""
    bands, rows = banding(percent / 100)
    bucketed = classes.select("key", F.posexplode(F.expr(f"transform(sequence(0, {bands - 1}), i -> xxhash64(i, substring(sig, i * {4 * rows} + 1, {4 * rows})))")).alias("band", "bucket"))
    # written, so that both sides of the next join are plain shuffles and adaptive execution can split a crowded bucket
    buckets = scratch.keep("buckets", bucketed.groupBy("bucket").agg(F.count("*").alias("size"), F.min("key").alias("pivot")).where("size > 1"))
    member = scratch.keep("member", bucketed.join(buckets, "bucket").select("bucket", "band", "size", "pivot", "key"))
    # full sets of the classes that share a bucket with another
    needed = scratch.keep("needed", classes.join(member.select("key").distinct(), "key", "left_semi").select("key", F.col("place.doc_id").alias("of_doc"), F.col("place.print").alias("of_print")))
    text = docs.select("doc_id", _print(), "text").where("text is not null")
    same = (F.col("print") == F.col("of_print")) & F.col("doc_id").eqNullSafe(F.col("of_doc"))
    # both sides grow with the documents, so neither is broadcast
    sets = scratch.keep("sets", text.join(needed.hint("merge"), same).select("key", "text").mapInArrow(_sets_of(width, lower), "key binary, members binary").dropDuplicates(["key"]))

    def likely(pairs: DataFrame, name: str) -> DataFrame:
        """pairs (a, b) distinct -> those that pass the posterior test."""
        left = classes.select(F.col("key").alias("a"), F.col("n").alias("n_a"), F.col("sig").alias("sig_a"))
        right = classes.select(F.col("key").alias("b"), F.col("n").alias("n_b"), F.col("sig").alias("sig_b"))
        sized = pairs.join(right, "b").join(left, "a").where(f"100 * least(n_a, n_b) >= {percent} * greatest(n_a, n_b)")
        return scratch.keep(f"{name}-likely", sized.select("a", "b", "sig_a", "sig_b").mapInArrow(_likely(percent / 100, miss), "a binary, b binary"))

    def verified(pairs: DataFrame, name: str) -> DataFrame:
        """Those of likely pairs that pass the exact test on full sets."""
        full = pairs.join(sets.toDF("b", "set_b"), "b").join(sets.toDF("a", "set_a"), "a")
        return scratch.keep(name, full.select("a", "b", "set_a", "set_b").mapInArrow(_equal_enough(percent), "a binary, b binary"))

    star = member.where("key <> pivot").select(F.col("pivot").alias("a"), F.col("key").alias("b")).distinct()
    first = verified(likely(star, "star"), "star")
    roots = components(first, scratch, "star-cc")
    # what a bucket of three or more still holds apart
    apart = member.where("size > 2").join(roots, F.col("key") == F.col("node"), "left").select("bucket", "band", "key", F.coalesce("root", "key").alias("root"))
    # aggregates by bucket are written, like the buckets above, before they are joined
    several = scratch.keep("several", apart.groupBy("bucket").agg(F.min("root").alias("r0"), F.max("root").alias("r1")).where("r0 <> r1").select("bucket"))
    mixed = scratch.keep("mixed", apart.join(several, "bucket", "left_semi"))
    sized = _private(sets, mixed.select("key").distinct(), scratch)
    # a second star around each bucket's most central class: the one with the smallest share of members of its own
    central = mixed.join(sized.select("key", (F.col("private") / F.col("n")).alias("share")), "key")
    middle = scratch.keep("middle", central.groupBy("bucket").agg(F.min(F.struct("share", "key", "root")).alias("m")).select("bucket", F.col("m.key").alias("a"), F.col("m.root").alias("root_a")))
    inner = mixed.join(middle, "bucket").where("root <> root_a").select("a", F.col("key").alias("b")).distinct()
    rooted = lambda known: known.select(F.col("node").alias("a"), F.col("root").alias("b"))
    roots = components(rooted(roots).unionAll(verified(likely(inner, "inner"), "inner")), scratch, "inner-cc")
    regrouped = mixed.select("bucket", "band", "key").join(roots, F.col("key") == F.col("node"), "left").select("bucket", "band", "key", F.coalesce("root", "key").alias("root"))
    return rooted(roots).unionAll(scratch.keep("rest", _across(regrouped, classes, sets, sized, scratch, percent, rows, miss)))


def _members(batches):
    for batch in batches:
        for k in range(batch.num_rows):
            one = np.frombuffer(batch.column("members")[k].as_buffer(), np.int64)
            yield pa.RecordBatch.from_pydict({"member": one, "key": pa.repeat(batch.column("key")[k], len(one))})


def _private(sets: DataFrame, keys: DataFrame, scratch: Scratch) -> DataFrame:
    """(key, n, private): sizes, and how many members no other set of ``keys`` has."""
    held = sets.join(keys, "key", "left_semi")
    each = held.mapInArrow(_members, "member long, key binary")
    single = each.groupBy("member").agg(F.count("*").alias("df"), F.min("key").alias("key")).where("df = 1")
    private = single.groupBy("key").agg(F.count("*").alias("private"))
    return scratch.keep("private", held.select("key", (F.octet_length("members") / 8).cast("long").alias("n")).join(private, "key", "left").na.fill(0, ["private"]))


#: Most classes, about, on either side of a block, and bytes of their sets: those of a bucket, and the outsiders they are compared with.
BLOCK, BLOCK_BYTES = 512, 32 << 20


def _across(mixed: DataFrame, classes: DataFrame, sets: DataFrame, sized: DataFrame, scratch: Scratch, percent: int, rows: int, miss: float) -> DataFrame:
    """Links (a < b) between different components of one bucket.

    A class whose private members alone exceed what the threshold lets it miss has
    no partner and leaves at once.  The classes outside a bucket's largest component
    are compared with the whole bucket, block by block inside a task: by signature
    and posterior, then on the full sets; only links leave it.  A pair is compared
    in the first band that it shares.
    """
    alive = scratch.keep("apart", mixed.join(sized.where(f"100 * (n - private) >= {percent} * n"), "key"))
    tally = alive.groupBy("bucket", "root").agg(F.count("*").alias("c"), F.sum(8 * F.col("n")).alias("bytes"))
    main = tally.groupBy("bucket").agg(F.max(F.struct("c", "root", "bytes")).alias("top"), F.sum("c").alias("size"), F.sum("bytes").alias("bytes"), F.count("*").alias("roots")).where("roots > 1")
    blocks_of = lambda n, size: F.greatest(F.ceil(n / BLOCK), F.ceil(size / BLOCK_BYTES)).cast("int")
    outsiders = blocks_of(F.col("size") - F.col("top.c"), F.col("bytes") - F.col("top.bytes"))
    main = scratch.keep("main", main.select("bucket", F.col("top.root").alias("main"), blocks_of(F.col("size"), F.col("bytes")).alias("rows"), outsiders.alias("columns")))
    full = alive.join(main, "bucket").join(classes.select("key", "sig").join(sets, "key"), "key")
    full = full.withColumn("outside", F.col("root") != F.col("main"))
    columns = ["bucket", "block", "asks", "band", "key", "root", "n", "private", "outside", "sig", "members"]
    # a grid of blocks: each of a bucket's row blocks meets each column block of its outsiders
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    dealt = lambda n: F.pmod(F.xxhash64("key"), F.col(n)).cast("int")
    asked = full.withColumn("column", every("columns")).withColumn("block", dealt("rows") * F.col("columns") + F.col("column")).withColumn("asks", F.lit(False)).select(*columns)
    asking = full.where("outside").withColumn("row", every("rows")).withColumn("block", F.col("row") * F.col("columns") + dealt("columns")).withColumn("asks", F.lit(True)).select(*columns)
    blocks = asked.unionAll(asking).repartition("bucket", "block").sortWithinPartitions("bucket", "block", "asks")
    return blocks.mapInArrow(_compared(percent, rows, miss), "a binary, b binary")


def _compared(percent: int, rows: int, miss: float):
    least = least_matches(percent / 100, miss)

    def block(table: pa.Table) -> tuple[list[bytes], list[bytes]]:
        column = {c: table.column(c).to_numpy() for c in ("asks", "n", "private", "outside")}
        key, root = (np.array(table.column(c).to_pylist(), dtype=object) for c in ("key", "root"))
        sig = np.frombuffer(b"".join(table.column("sig").to_pylist()), dtype=np.uint32).reshape(-1, PERMUTATIONS)
        band = table.column("band")[0].as_py()
        bands = sig[:, : (PERMUTATIONS // rows) * rows].reshape(len(sig), -1, rows)
        members = [np.frombuffer(m.as_buffer(), np.uint64) for c in table.column("members").chunks for m in c]
        ys = np.flatnonzero(~column["asks"])
        a, b = [], []
        for x in np.flatnonzero(column["asks"]):
            y = ys[root[ys] != root[x]]
            y = y[~column["outside"][y] | (key[y] < key[x])]
            n, most = column["n"][y] + column["n"][x], np.minimum(column["n"][y] - column["private"][y], column["n"][x] - column["private"][x])
            y = y[(100 * most >= percent * (n - most)) & (100 * np.minimum(column["n"][y], column["n"][x]) >= percent * np.maximum(column["n"][y], column["n"][x]))]
            if band:
                y = y[~(bands[y, :band] == bands[x, :band]).all(axis=2).any(axis=1)]
            matches = np.zeros(len(y), dtype=np.int64)
            for k, enough in enumerate(least):
                matches += (sig[y, k * BATCH : (k + 1) * BATCH] == sig[x, k * BATCH : (k + 1) * BATCH]).sum(axis=1)
                y, matches = y[matches >= enough], matches[matches >= enough]
            y = [k for k in y if _linked(members[x], members[k], percent)]
            a += [min(key[x], key[k]) for k in y]
            b += [max(key[x], key[k]) for k in y]
        return a, b

    def run(batches):
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            place = np.stack([batch.column("bucket").to_numpy(), batch.column("block").to_numpy().astype(np.int64)])
            if held and (place[:, 0] != last).any():
                yield out(*block(pa.Table.from_batches(held)))
                held = []
            cuts = np.flatnonzero((place[:, 1:] != place[:, :-1]).any(axis=0)) + 1
            edges = [0, *cuts.tolist(), batch.num_rows]
            a, b = [], []
            for start, stop in zip(edges[:-2], edges[1:-1], strict=True):
                more = block(pa.Table.from_batches([*held, batch.slice(start, stop - start)]))
                held = []
                a, b = a + more[0], b + more[1]
            held.append(batch.slice(edges[-2]))
            last = place[:, -1]
            yield out(a, b)
        if held:
            yield out(*block(pa.Table.from_batches(held)))

    def out(a, b):
        return pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], ["a", "b"])

    return run
