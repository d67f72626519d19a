"""Emptying the trash over related tables.

A schema is stated as keys between tables.  Records of deleted documents first
pass to a surviving document; then keys are followed from table to table until
nothing is added.  Every step is a join on a key, and what a round finds is
written, so the depth of the data costs rounds, not the driver's memory.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearthbook.operators.written import kept


@dataclass(frozen=True)
class Key:
    """table.column names target.to; with a kind, only in rows whose record_type is it.

    What goes with a target: the row ("row"), unless ``spared`` rows are kept, or only
    the reference ("reference"), with ``then`` as further columns' values.
    """

    table: str
    column: str
    target: str
    to: str = "id"
    kind: str | None = None
    goes: str = "row"
    spared: bool = False
    then: tuple[tuple[str, str], ...] = ()

    def rows(self, tables: dict[str, DataFrame]) -> DataFrame:
        """(id, ref): the rows of the table that this key is set in."""
        found = tables[self.table]
        found = found.where(F.col("record_type") == self.kind) if self.kind else found
        return found.where(F.col(self.column).isNotNull()).select("id", F.col(self.column).alias("ref"))


@dataclass(frozen=True)
class Owned:
    """Records of a table belong to the document in column; kind is their name in evidence; contents are known by the record's own hash or by its evidence's."""

    table: str
    column: str
    kind: str
    by_evidence: bool = False


def _least(rows: DataFrame, key: str) -> DataFrame:
    return rows.groupBy(F.col(key).alias("named")).agg(F.min("document_id").alias("heir"))


def _pass_on(rows: DataFrame, column: str, deleted: DataFrame, heirs: DataFrame, key: str) -> DataFrame:
    """rows with column replaced by the least heir (named, heir) where it names a deleted document."""
    asked = rows.join(deleted.select(F.col("id").alias(column), F.lit(True).alias("orphan")), column, "left")
    joined = asked.join(heirs, (F.col(key) == F.col("named")) & F.col("orphan"), "left")
    return joined.withColumn(column, F.coalesce("heir", column)).select(rows.columns)


def inherit(tables: dict[str, DataFrame], deleted: DataFrame, owned: tuple[Owned, ...], hashed: tuple[str, ...] = ("evidence",), versions: str = "versions", evidence: str = "evidence") -> dict[str, DataFrame]:
    """tables after records of deleted documents (id) passed to the smallest surviving document that their evidence or contents name.

    versions has (document_id, hash), evidence (record_type, record_id, document_id,
    hash); tables in hashed pass on by their own hash alone.  Records that nothing
    names keep their document.
    """
    gone = deleted.select(F.col("id").alias("document_id"))
    alive = lambda rows: rows.join(gone, "document_id", "left_anti")
    same = _least(alive(tables[versions].where("hash is not null")), "hash")  # the least living document of each content
    proofs = tables[evidence].select("record_type", "record_id", "document_id", "hash")
    vouching = alive(proofs).select("record_type", "record_id", "document_id")
    alike = proofs.join(same, proofs["hash"] == same["named"]).select("record_type", "record_id", F.col("heir").alias("document_id"))
    out = dict(tables)
    for o in owned:
        of = lambda rows: rows.where(F.col("record_type") == o.kind).select("record_id", "document_id")  # noqa: B023, E731
        record = tables[o.table]
        own = of(alike) if o.by_evidence else record.join(same, record["hash"] == same["named"]).select(F.col("id").alias("record_id"), F.col("heir").alias("document_id"))
        heirs = _least(of(vouching).unionByName(own), "record_id")
        out[o.table] = _pass_on(record, o.column, deleted, heirs, "id")
    for name in hashed:
        out[name] = _pass_on(tables[name], "document_id", deleted, same, "hash")
    return out


def closure(tables: dict[str, DataFrame], start: dict[str, DataFrame], keys: tuple[Key, ...], spared: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Ids (id) that go per table, from start (table -> ids) along the keys whose rows go, until nothing is added.

    Rows of spared (table -> ids) stay for keys that spare.  Keys may form cycles.
    """
    doomed = {t: kept(ids.select("id").where("id is not null").distinct()) for t, ids in start.items()}
    fresh = dict(doomed)
    follow = [k for k in keys if k.goes == "row"]
    while fresh:
        found: dict[str, list[DataFrame]] = {}
        for k in follow:
            if k.target not in fresh:
                continue
            targets = fresh[k.target].select(F.col("id").alias("ref")) if k.to == "id" else tables[k.target].join(fresh[k.target], "id", "left_semi").select(F.col(k.to).alias("ref"))
            hit = k.rows(tables).join(targets.distinct(), "ref", "left_semi").select("id")
            if k.spared and k.table in spared:
                hit = hit.join(spared[k.table], "id", "left_anti")
            found.setdefault(k.table, []).append(hit)
        fresh = {}
        for table, hits in found.items():
            new = reduce(DataFrame.unionAll, hits).distinct()
            new = kept(new.join(doomed[table], "id", "left_anti") if table in doomed else new)
            if not new.isEmpty():
                fresh[table] = new
                doomed[table] = kept(doomed[table].unionAll(new)) if table in doomed else new
    return doomed


def remove(tables: dict[str, DataFrame], doomed: dict[str, DataFrame], keys: tuple[Key, ...]) -> dict[str, DataFrame]:
    """What stays of every table; references to rows that go are emptied."""
    out = {t: rows.join(doomed[t], "id", "left_anti") if t in doomed else rows for t, rows in tables.items()}
    for k in keys:
        if k.target not in doomed or (k.goes == "row" and not k.spared):
            continue
        targets = doomed[k.target] if k.to == "id" else tables[k.target].join(doomed[k.target], "id", "left_semi").select(F.col(k.to).alias("id"))
        rows = out[k.table]
        marked = rows.join(targets.distinct().select(F.col("id").alias(k.column), F.lit(True).alias("dangling")), k.column, "left")
        values = {k.column: F.lit(None), **{c: F.lit(v) for c, v in k.then}}
        out[k.table] = marked.select(*(F.when(F.col("dangling").isNull(), F.col(c)).otherwise(values[c].cast(rows.schema[c].dataType)).alias(c) if c in values else F.col(c) for c in rows.columns))
    return out


# The ledger's own schema.
OWNED = (Owned("statements", "document_id", "statement"), Owned("transactions", "source_document_id", "transaction", by_evidence=True), Owned("receipts", "document_id", "receipt"), Owned("bills", "document_id", "bill"))
_RECORDS = {"statements": "statement", "transactions": "transaction", "receipts": "receipt", "bills": "bill"}
KEYS = (
    Key("versions", "document_id", "documents"), Key("evidence", "document_id", "documents"), Key("statements", "document_id", "documents"), Key("receipts", "document_id", "documents"), Key("bills", "document_id", "documents"),
    Key("transactions", "source_document_id", "documents"), Key("transactions", "statement_id", "statements", spared=True),
    Key("bills", "payment_id", "transactions", goes="reference", then=(("payment_status", "unknown"),)),
    Key("links", "receipt_id", "receipts"), Key("links", "transaction_id", "transactions"),
    *(Key(dependent, "record_id", table, kind=kind) for table, kind in _RECORDS.items() for dependent in ("evidence", "issues", "corrections", "reviews")),
)


def empty_trash(tables: dict[str, DataFrame], deleted: DataFrame) -> dict[str, DataFrame]:
    """The ledger's tables after the documents (id) of the trash are gone with all that hangs on them.

    tables: documents (id), versions (id, document_id, hash), evidence, statements,
    transactions, receipts, bills, links, and any of issues, corrections, reviews (id,
    record_type, record_id).  A transaction that another living document vouches for
    outlives its statement; a bill outlives its payment, whose state is then unknown.
    Also gives ``contents``: the hashes that no living document has.
    """
    keys = tuple(k for k in KEYS if k.table in tables and k.target in tables)
    deleted = kept(deleted.select("id").distinct())
    passed = {t: kept(rows) if t in {"evidence", *(o.table for o in OWNED)} else rows for t, rows in inherit(tables, deleted, tuple(o for o in OWNED if o.table in tables)).items()}
    gone = deleted.select(F.col("id").alias("document_id"))
    vouched = passed["evidence"].where("record_type = 'transaction'").join(gone, "document_id", "left_anti").select(F.col("record_id").alias("id"))
    sourced = passed["transactions"].where("source_document_id is not null").join(gone.withColumnRenamed("document_id", "source_document_id"), "source_document_id", "left_anti").select("id")
    doomed = closure(passed, {"documents": deleted}, keys, {"transactions": kept(vouched.unionAll(sourced).distinct())})
    held = tables["versions"].where("hash is not null")
    contents = held.join(gone, "document_id", "left_semi").select("hash").distinct().join(held.join(gone, "document_id", "left_anti"), "hash", "left_anti")
    return {**remove(passed, doomed, keys), "contents": contents}
