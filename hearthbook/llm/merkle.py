"""Merkle trees over a table: a tree per group, and one over the groups' roots.

A level is one slot pivot: nodes are grouped by their parent, conditional
aggregates spread the children into ``fanout`` columns, and the columns joined
hash it.  The columns before and after a child's own are its siblings.  A level
with one node left is the root; a run of fewer children, even one, is hashed too.

Nodes are numbered by a range sort, so no task orders a group.  A block is
``fanout ** LEVELS`` consecutive nodes of a group: its levels run one after another
inside one partitioning by (group, block), then a round of the same kind goes over
the blocks.  Paths of siblings grow inside blocks and get the rest of their way
from their block, so only short rows are shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from hearthbook.llm._store import Scratch

#: Levels inside a block: 256 nodes at two children a node.
LEVELS = 8
_PATH = "array<struct<before:string,after:string>>"


def digest(*parts: Column) -> Column:
    """Lowercase hex SHA-256 of the parts, one after another."""
    return F.sha2(F.concat(*parts), 256)


def field(column: Column) -> Column:
    """`-` for null, else the value's count of UTF-8 bytes, a colon and the value."""
    text = column.cast("string")
    return F.when(text.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(path, leaf, lambda held, step: digest(step["before"], held, step["after"]))


def proof(path: Column) -> Column:
    """SHA-256 over all siblings of a path."""
    return F.sha2(F.array_join(F.transform(path, lambda step: F.concat(step["before"], step["after"])), ""), 256)


def numbered(frame: DataFrame, order: list[str], scratch: Scratch, name: str) -> DataFrame:
    """frame (key, ...) plus place, counted from 0 in each key by order, and total, the key's rows.

    The sorted ranges are written, so a lost executor numbers no row anew.
    """
    ranged = frame.repartitionByRange("key", *order).sortWithinPartitions("key", *order)
    ranged = scratch.keep(name, ranged.withColumn("range", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id()))
    parts = ranged.groupBy("key", "range").agg(F.min("at").alias("first"), F.count("*").alias("size"))
    mine = W.partitionBy("key")  # of ranges, not rows
    before = F.coalesce(F.sum("size").over(mine.orderBy("range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select("key", "range", (before - F.col("first")).alias("shift"), F.sum("size").over(mine).alias("total"))
    return ranged.join(parts, ["key", "range"]).select(*frame.columns, (F.col("at") + F.col("shift")).alias("place"), "total")


def _climb(nodes: DataFrame, fanout: int, payload: Column | None = None) -> DataFrame:
    """nodes (key, place, total, hash) -> their blocks (key, place, total, hash), each a node of the next round.

    With a payload also members: array of (payload, path), a path being the siblings up to the block.
    """
    rows = nodes.withColumn("block", F.expr(f"place div {fanout**LEVELS}"))
    if payload is not None:
        rows = rows.withColumn("members", F.array(F.struct(payload.alias("payload"), F.array().cast(_PATH).alias("path"))))
    rows = rows.repartition("key", "block")
    for _ in range(LEVELS):
        own = lambda s, c: F.first(F.when(F.col("place") % fanout == s, F.col(c)), ignorenulls=True)  # noqa: B023, E731
        columns = [own(s, "hash").alias(f"hash{s}") for s in range(fanout)]
        columns += [own(s, "members").alias(f"members{s}") for s in range(fanout)] if payload is not None else []
        parents = rows.groupBy("key", "block", "total", F.expr(f"place div {fanout}").alias("place")).agg(*columns).withColumnRenamed("total", "below")
        slots = [F.coalesce(f"hash{s}", F.lit("")) for s in range(fanout)]
        many = F.col("below") > 1
        out = ["key", "block", "place", F.expr(f"(below + {fanout - 1}) div {fanout}").alias("total"), F.when(many, digest(*slots)).otherwise(F.col("hash0")).alias("hash")]
        if payload is not None:
            lists = []
            for s in range(fanout):
                step = F.struct(F.concat(F.lit(""), *slots[:s]).alias("before"), F.concat(F.lit(""), *slots[s + 1 :]).alias("after"))
                lists.append(F.coalesce(F.transform(f"members{s}", lambda m: F.struct(m["payload"].alias("payload"), F.when(many, F.array_append(m["path"], step)).otherwise(m["path"]).alias("path"))), F.array()))  # noqa: B023
            out.append(F.concat(*lists).alias("members"))
        rows = parents.select(*out)
    return rows.drop("block")


def _rounds(nodes: DataFrame, fanout: int, scratch: Scratch, name: str) -> list[DataFrame]:
    """Tables of (key, place, total, hash, ...): the nodes, their blocks, the blocks of those, down to one node a key."""
    rounds, most = [nodes], nodes.agg(F.max("total")).first()[0] or 0
    while most > 1:
        rounds.append(scratch.keep(f"{name}-{len(rounds)}", _climb(rounds[-1].select("key", "place", "total", "hash"), fanout)))
        most = -(-most // fanout**LEVELS)
    return rounds


def _paths(rounds: list[DataFrame], tails: DataFrame, payload: Column, fanout: int, scratch: Scratch, name: str) -> DataFrame:
    """(payload, path, further columns of tails) for every node of the first round; tails (key, tail, ...) are each key's way from its root on."""
    more = [c for c in tails.columns if c not in ("key", "tail")]
    above = rounds[-1].drop("place").join(tails, "key").select("key", F.lit(0).cast("long").alias("place"), F.col("tail").alias("path"), *more, *([payload.alias("payload")] if len(rounds) == 1 else []))
    if len(rounds) == 1:
        return above.select("payload", "path", *more)
    for turn in range(len(rounds) - 2, -1, -1):
        blocks = _climb(rounds[turn], fanout, payload if turn == 0 else F.col("place")).select("key", "place", "members")
        joined = blocks.join(above, ["key", "place"]).select("key", F.explode("members").alias("m"), "path", *more)
        way = F.concat(F.col("m.path"), F.col("path")).alias("path")
        if turn == 0:
            return joined.select("m.payload", way, *more)
        above = scratch.keep(f"{name}-paths-{turn}", joined.select("key", F.col("m.payload").alias("place"), way, *more))
    raise AssertionError("unreachable")


def manifest(rows: DataFrame, group: str, order: list[str], leaf: str = "leaf", fanout: int = 2) -> DataFrame:
    """rows plus path (siblings before and after, level by level to the root), subroot and root.

    ``leaf`` is a column of hex digests.  A null group is one of its own, before
    all others; groups follow by UTF-8 bytes.  Leaves ascend by the order columns,
    nulls first, then by their digest; rows alike in all of them stand in any order,
    so the roots do not depend on it.  A text's length matters nowhere after its
    digest, a group's size only to the number of rounds, and an empty table gives no
    rows.  Columns named path, subroot and root are replaced, others are kept
    whatever their names.
    """
    scratch = Scratch(rows.sparkSession, "merkle")
    kept = [c for c in rows.columns if c not in ("path", "subroot", "root")]
    named = [f"c{k}" for k in range(len(kept))]
    at = dict(zip(kept, named, strict=True))
    inner = rows.select(*kept).toDF(*named)
    # written before it is sorted, as a range sort reads its input twice
    leaves = scratch.keep("leaves", inner.select(F.coalesce(F.concat(F.lit("1"), F.col(at[group]).cast("string")), F.lit("0")).alias("key"), F.col(at[leaf]).alias("hash"), F.struct(*named).alias("row"), F.monotonically_increasing_id().alias("again")))
    orders = [f"o{k}" for k in range(len(order))]
    placed = numbered(leaves.select("*", *(F.col(f"row.{at[c]}").alias(o) for c, o in zip(order, orders, strict=True))), [*orders, "hash", "again"], scratch, "sorted").drop(*orders, "again")
    placed = scratch.keep("placed", placed)
    scratch.drop("leaves")
    scratch.drop("sorted")
    rounds = _rounds(placed, fanout, scratch, "tree")
    tops = rounds[-1].select(F.lit("").alias("key"), F.col("key").alias("of"), "hash")
    tops = scratch.keep("tops", numbered(tops, ["of"], scratch, "subroots"))
    upper = _rounds(tops, fanout, scratch, "top")
    ends = upper[-1].select("key", F.array().cast(_PATH).alias("tail"), F.col("hash").alias("root"))
    tails = _paths(upper, ends, F.struct("of", "hash"), fanout, scratch, "top").select(F.col("payload.of").alias("key"), F.col("path").alias("tail"), F.col("payload.hash").alias("subroot"), "root")
    found = _paths(rounds, scratch.keep("tails", tails), F.col("row"), fanout, scratch, "tree")
    return found.select("payload.*", "path", "subroot", "root").toDF(*kept, "path", "subroot", "root")


def documents_manifest(docs: DataFrame, fanout: int = 2) -> DataFrame:
    """docs (doc_id, source, lang, n_chars, text, ...) -> doc_id, leaf, tampered, path, subroot, root; a row per row.

    A leaf is the digest of the five columns in that order.  tampered is the leaf of
    the same row with 1 added to n_chars where 7 divides the CRC-32 of the doc_id,
    else null; a null n_chars stays, a null doc_id is never tampered with.  Repeated
    rows are leaves of their own.
    """
    hashed = lambda n: digest(*(field(c) for c in (F.col("doc_id"), F.col("source"), F.col("lang"), n, F.col("text"))))
    hit = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0, F.lit(False))
    leaves = docs.select("doc_id", "lang", hashed(F.col("n_chars")).alias("leaf"), F.when(hit, hashed(F.col("n_chars").cast("decimal(20,0)") + 1)).alias("tampered"))
    return manifest(leaves, "lang", ["doc_id"], fanout=fanout).drop("lang")
