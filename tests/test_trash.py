"""Emptying the trash over related tables."""

from hearthbook.operators import trash as T

DDL = {
    "documents": "id long", "versions": "id long, document_id long, hash string", "evidence": "id long, record_type string, record_id long, document_id long, hash string",
    "statements": "id long, document_id long, hash string", "transactions": "id long, source_document_id long, statement_id long", "receipts": "id long, document_id long, hash string",
    "bills": "id long, document_id long, hash string, payment_id long, payment_status string", "links": "id long, receipt_id long, transaction_id long", "issues": "id long, record_type string, record_id long",
}


def emptied(spark, gone, **rows):
    tables = {t: spark.createDataFrame(rows.get(t, []), ddl) for t, ddl in DDL.items()}
    left = T.empty_trash(tables, spark.createDataFrame([(g,) for g in gone], "id long"))
    return {t: sorted(tuple(r) for r in frame.collect()) for t, frame in left.items()}


def test_what_hangs_on_a_document_goes(spark):
    left = emptied(
        spark, [1], documents=[(1,), (2,)], versions=[(10, 1, "x"), (11, 2, "y")], statements=[(20, 1, "x"), (21, 2, "y")],
        transactions=[(30, None, 20), (31, None, 21), (32, 2, 20), (33, 1, None)], receipts=[(40, 1, "x")], links=[(50, 40, 31), (51, 41, 30)],
        bills=[(60, 2, "y", 30, "paid"), (61, 1, "x", None, "unknown"), (62, 2, "y", 31, "paid")],
        issues=[(70, "transaction", 30), (71, "receipt", 30), (72, "bill", 61), (73, "statement", 21)],
    )
    assert left["documents"] == [(2,)] and left["versions"] == [(11, 2, "y")] and left["statements"] == [(21, 2, "y")] and left["receipts"] == []
    # 30 goes with its statement, 33 with its document; 32 has another source and only loses its statement
    assert left["transactions"] == [(31, None, 21), (32, 2, None)] and left["links"] == []
    assert left["bills"] == [(60, 2, "y", None, "unknown"), (62, 2, "y", 31, "paid")]
    assert left["issues"] == [(71, "receipt", 30), (73, "statement", 21)] and left["contents"] == [("x",)]


def test_records_pass_to_the_least_living_document(spark):
    left = emptied(
        spark, [1, 4], documents=[(k,) for k in (1, 2, 3, 4, 5)], versions=[(10, 1, "x"), (11, 3, "x"), (12, 2, "z"), (13, 4, "x")],
        receipts=[(40, 1, "x"), (41, 1, None)], statements=[(20, 4, "q")], bills=[(60, 4, None, None, "unknown")],
        evidence=[(80, "bill", 60, 5, "q"), (81, "bill", 60, 1, "x"), (82, "transaction", 30, 4, "z"), (83, "transaction", 31, 4, "nothing")],
        transactions=[(30, 4, None), (31, 4, None), (32, None, 20)],
    )
    assert left["receipts"] == [(40, 3, "x")]  # by contents
    assert left["bills"] == [(60, 5, None, None, "unknown")]  # by evidence
    assert left["transactions"] == [(30, 2, None)]  # by the contents of its evidence
    assert left["evidence"] == [(80, "bill", 60, 5, "q"), (81, "bill", 60, 3, "x"), (82, "transaction", 30, 2, "z")]
    assert left["statements"] == [] and left["contents"] == []


def test_evidence_of_a_living_document_spares_a_transaction(spark):
    left = emptied(spark, [1], documents=[(1,), (2,)], statements=[(20, 1, None)], transactions=[(30, None, 20), (31, None, 20)], evidence=[(80, "transaction", 30, 2, None)])
    assert left["transactions"] == [(30, None, None)] and left["evidence"] == [(80, "transaction", 30, 2, None)]


def test_cycles_end_and_nothing_deleted_changes_nothing(spark):
    rows = {"a": spark.createDataFrame([(1, 2), (2, 3), (3, 1), (4, None)], "id long, up long")}
    found = T.closure(rows, {"a": spark.createDataFrame([(2,)], "id long")}, (T.Key("a", "up", "a"),), {})
    assert sorted(r.id for r in found["a"].collect()) == [1, 2, 3]
    left = emptied(spark, [], documents=[(1,)], receipts=[(40, 1, "x")])
    assert left["documents"] == [(1,)] and left["receipts"] == [(40, 1, "x")]
