"""Golden results of the reconciliation's pass, products, corrections, publications, warranties and file intake."""

import datetime
import os

import pytest
from pyspark.sql import functions as F

from hearthbook.functions import checks as C
from hearthbook.operators import corrections, items, merge, products, reconcile, upkeep
from hearthbook.sources import tabular
from hearthbook.streaming import intake

D = datetime.date.fromisoformat


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def test_one_whole_pass(spark):
    """Two accounts: transfers retype rows before refunds look at them, and one receipt has two equal charges."""
    said = [
        (1, "2026-09-01", "PAYROLL ACME", 300000, "deposit"), (1, "2026-09-20", "ONLINE PAYMENT TO CREDIT CARD 7314", -50000, "payment"), (1, "2026-09-25", "ACH DEBIT FIDELITY", -25000, "purchase"),
        *((1, day, "NETFLIX.COM 866-579", -1549, "purchase") for day in ("2026-06-05", "2026-07-05", "2026-08-05", "2026-09-05")),
        (2, "2026-09-15", "COSTCO WHSE #1234 SEATTLE WA", -16382, "purchase"), (2, "2026-09-21", "PAYMENT - THANK YOU", 50000, "payment"), (2, "2026-09-26", "ONLINE CREDIT", 25000, "refund"),
        (2, "2026-09-02", "AMAZON MKTPLACE", -5999, "purchase"), (2, "2026-09-10", "AMAZON MKTPLACE", 5999, "refund"), (2, "2026-09-18", "CAFE ONE", -1200, "purchase"), (2, "2026-09-18", "BOOKSHOP TWO", -1200, "purchase"), (2, "2026-09-19", "TARGET STORE", 2599, "refund"),
    ]
    rows = spark.createDataFrame([(k, a, D(d), t, n, "USD", kind, "proposed", "import") for k, (a, d, t, n, kind) in enumerate(said, 1)], "posting_id long, account_id long, posted_date date, description_raw string, amount_minor long, currency string, transaction_type string, review_status string, origin string")
    accounts = spark.createDataFrame([(1, "checking"), (2, "credit_card")], "account_id long, account_type string")
    receipts = spark.createDataFrame([(1, "Costco Wholesale", D("2026-09-15"), "USD", 16382, "proposed"), (2, "Corner Market", D("2026-09-18"), "USD", 1200, "proposed"), (3, "Target", D("2026-09-19"), "USD", -2599, "proposed")], "receipt_id long, merchant string, purchase_date date, currency string, total_minor long, review_status string")
    book = spark.createDataFrame([(1, "WHOLESALE", "groceries", None), (2, "NETFLIX", "fun", None)], "rule_id long, pattern string, category string, account_id long")
    got = reconcile.run(receipts, rows, accounts, book)
    assert {r["pass"]: r.n for r in got["counts"].collect()} == {"receipt_links": 2, "transfers": 2, "refunds": 1, "recurring": 1, "open_issues": 1}
    assert {(r.receipt_id, r.posting_id, r.score, r.method) for r in got["receipt_links"].collect()} == {(1, 8, 100, "amount+same_day+merchant"), (3, 15, 100, "amount+same_day+merchant")}
    assert {(r.out_id, r.in_id) for r in got["transfers"].collect()} == {(2, 9), (3, 10)}
    types = {r.posting_id: (r.transaction_type, r.merchant) for r in got["rows"].collect()}
    assert types[3][0] == types[10][0] == "payment" and types[8] == ("purchase", "Costco Wholesale")
    assert [(r.issue_type, r.record_id, r.candidates) for r in got["issues"].collect()] == [("ambiguous_receipt_match", 2, [13, 14])]
    assert [(r.credit_id, r.purchase_id) for r in got["refunds"].collect()] == [(12, 11)]
    due = got["recurring"].first()
    assert (due.merchant_key, due.frequency, due.expected_minor, due.next_due_date) == ("NETFLIX COM", "monthly", 1549, D("2026-10-05"))
    assert {r.posting_id: r.category for r in got["categories"].collect()} == {8: "groceries", **dict.fromkeys((4, 5, 6, 7), "fun")}
    # what is linked or rejected is not offered again
    held = spark.createDataFrame([(1, 8, "rejected"), (3, 15, "proposed")], "receipt_id long, posting_id long, review_status string")
    moved = spark.createDataFrame([(2, 9, "proposed"), (3, 10, "rejected")], "out_id long, in_id long, review_status string")
    answered = spark.createDataFrame([("ambiguous_receipt_match", 2)], "issue_type string, record_id long")
    again = {r["pass"]: r.n for r in reconcile.run(receipts, rows, accounts, book, held, moved, answered=answered)["counts"].collect()}
    assert again["receipt_links"] == 0 and again["transfers"] == 0 and again["open_issues"] == 0


def test_closure_has_no_depth_limit(spark):
    """A chain, a shared child, a cycle and null ends."""
    edges = [(k, k + 1) for k in range(120)] + [(0, 50), (200, 201), (201, 200), (None, 5), (5, None)]
    found = merge.closure(spark.createDataFrame([(0,), (0,), (200,)], "id long"), spark.createDataFrame(edges, "parent long, child long"))
    assert sorted(r.id for r in found.collect()) == [*range(121), 200, 201]


LINES = "line_id long, receipt_id long, position int, merchant string, description string, product_code string, purchase_date date"
RESOLVED = "resolution_id long, line_id long, name string, brand string, size_text string, category string, consumable boolean, barcode string, method string, review_status string"


def test_products_from_proposal_to_lot(spark):
    lines = spark.createDataFrame([(1, 10, 1, "MART", "gv mlk 1gal", "77", D("2026-09-01")), (2, 10, 2, "MART", "shovel", None, D("2026-09-01")), (3, 11, 1, "SHOP", "mystery", "77", None)], LINES)
    aliases = spark.createDataFrame([(1, "MART", "GV MLK 1GAL", "77", "milk"), (2, "MART", "SHOVEL", None, "spade"), (3, "MART", "SHOVEL", None, "shovel")], "alias_id long, merchant string, text string, code string, product string")
    known = {r.line_id: (r["product"], r.method) for r in products.known(lines, aliases).collect()}
    assert known == {1: ("milk", "alias"), 2: ("shovel", "alias"), 3: ("milk", "history")}
    resolutions = spark.createDataFrame([(1, 1, "Milk", "GV", "1 gal", "dairy & eggs", True, None, "alias", "proposed"), (2, 2, "Shovel", None, None, "home maintenance", False, None, "alias", "proposed"), (3, 3, "Milk", None, None, "dairy & eggs", True, None, "history", "rejected")], RESOLVED)
    offered = spark.createDataFrame([(1, "Milk", 1), (3, " milk ", 2), (3, "Cream", 3), (3, "Soap", 4), (9, "X", 5)], "line_id long, name string, seq int")
    assert {(r.line_id, r.seq): r.outcome for r in products.propose(lines, resolutions, offered).collect()} == {(1, 1): "settled", (3, 2): "rejected_before", (3, 3): "proposed", (3, 4): "repeated", (9, 5): "unknown_line"}
    said = spark.createDataFrame([(1, 1, "verified", "Whole Milk", "GV", "1 gal", "dairy & eggs"), (1, 2, "rejected", None, None, None, None), (2, 1, "verified", None, None, None, None), (3, 1, "verified", None, None, None, None)], "resolution_id long, seq int, status string, name string, brand string, size_text string, category string")
    done = products.review(resolutions, said)
    assert {r.resolution_id: (r.review_status, r.name, r.method, r.approved) for r in done.collect()} == {1: ("verified", "Whole Milk", "user", True), 2: ("verified", "Shovel", "alias", True), 3: ("rejected", "Milk", "history", False)}
    assert {(r.merchant, r.text, r.code) for r in products.new_aliases(done, lines).collect()} == {("MART", "GV MLK 1GAL", "77"), ("MART", "SHOVEL", None)}
    milk = next(r["product"] for r in done.collect() if r.resolution_id == 1)
    old = spark.createDataFrame([
        (1, 1, milk, D("2026-06-01"), D("2026-06-11"), "finished", None), (2, 1, milk, D("2026-07-01"), D("2026-07-09"), "finished", None), (3, 1, milk, D("2026-08-01"), None, "in_stock", D("2026-12-01")), (10, 2, "other", D("2026-09-01"), None, "in_stock", None),
    ], "receipt_id long, position int, product string, bought_on date, closed_on date, status string, next_check_on date")
    lots = {(r.receipt_id, r.position): r for r in products.add_lots(old, done, lines, "2026-09-02").collect()}
    assert lots[10, 1].bought_on == D("2026-09-01") and lots[10, 1].next_check_on == D("2026-09-10") and lots[10, 1].status == "in_stock"  # the median of 10 and 8 days
    assert lots[3, 1].next_check_on == D("2026-09-02") and lots[1, 1].next_check_on is None and len(lots) == 5
    assert lots[10, 2]["product"] != "other" and lots[10, 2].bought_on == D("2026-09-01")


def test_corrections(spark):
    records = spark.createDataFrame([(1, ["Purchase date is missing.", "Merchant was inferred."], "needs_review", False), (2, ["Purchase date is missing."], "needs_review", False), (3, ["Merchant was inferred."], "needs_review", True)], "receipt_id long, issues array<string>, review_status string, by_user boolean")
    changes = spark.createDataFrame([(1, 1, "merchant", "Mart #12, Inc."), (1, 2, "purchase_date", "2026-02-30"), (2, 1, "purchase_date", "2026-02-28"), (2, 2, "price", "3"), (3, 1, "merchant", "Shop"), (3, 2, "location", "x" * 61)], "receipt_id long, seq int, field string, text string")
    got = {r.receipt_id: r for r in corrections.correct(records, changes, "receipt", "receipt_id").collect()}
    assert (got[1].review_status, got[1].issues, got[1].corrected) == ("needs_review", ["Purchase date is missing."], {"merchant": "MART"})
    assert (got[2].review_status, got[2].issues, got[2].corrected) == ("verified", [], {"purchase_date": "2026-02-28"})
    assert (got[3].review_status, got[3].issues) == ("needs_review", [])
    assert value(spark, corrections.correction_value(F.lit("name"), F.lit("#12 !"))).error == "name without letters"


def test_publishing_a_statement_drops_stale_rows(spark):
    rows = spark.createDataFrame([(1, 7, 70, "extraction", "proposed", None, "a"), (2, 7, 70, "extraction", "verified", "user", "b"), (3, 7, 70, "extraction", "verified", "automatic", "c"), (4, 7, 70, "import", "proposed", None, "d"), (5, 7, 70, "extraction", "proposed", None, "e")], "transaction_id long, account_id long, statement_id long, origin string, review_status string, review_source string, fingerprint string")
    evidence = spark.createDataFrame([(1, "extraction:1"), (5, "extraction:1"), (5, "import:9")], "transaction_id long, source_key string")
    statements = spark.createDataFrame([(70, 7, "USD", False), (71, 7, "EUR", False), (72, 7, "USD", True)], "statement_id long, account_id long, currency string, by_user boolean")
    accounts = spark.createDataFrame([(7, "USD")], "account_id long, currency string")
    new = spark.createDataFrame([(70, 7, "a"), (70, 7, "b"), (71, 7, "x"), (72, 7, "y")], "statement_id long, account_id long, fingerprint string")
    stays, entered = corrections.publish_statement(rows, evidence, statements, accounts, new)
    assert {r.transaction_id for r in stays.collect()} == {2, 4, 5}
    assert {(r.statement_id, r.fingerprint): r.outcome for r in entered.collect()} == {(70, "a"): "inserted", (70, "b"): "duplicate", (71, "x"): "refused", (72, "y"): "kept_reviewed"}


def test_warranties(spark):
    lots = spark.createDataFrame([(1, False, D("2026-01-31")), (2, True, D("2026-01-01")), (3, False, None)], "lot_id long, consumable boolean, bought_on date")
    shape = "lot_id long, kind string, months int, lifetime boolean, source string, review_status string, seq int"
    old = spark.createDataFrame([(1, "store", 12, False, "user", "verified", 0)], shape)
    new = spark.createDataFrame([(1, "manufacturer", 1, False, "lookup", "proposed", 1), (1, "store", 24, False, "lookup", "proposed", 2), (1, "extended", None, True, "user", "verified", 3), (2, "store", 12, False, "user", "verified", 4), (3, "store", 12, False, "user", "verified", 5), (1, "manufacturer", 0, False, "user", "verified", 6), (1, "extended", 5, True, "user", "verified", 7)], shape)
    got = {r.kind: (r.months, r.expires_on, r.source) for r in upkeep.add_warranties(old, new, lots).collect()}
    assert got == {"manufacturer": (1, D("2026-02-28"), "lookup"), "store": (12, D("2027-01-31"), "user"), "extended": (None, None, "user")}
    later = spark.createDataFrame([(1, "store", 36, False, "user", "verified", 1)], shape)
    assert upkeep.add_warranties(old, later, lots).first().months == 36


@pytest.mark.parametrize(("quote", "months"), [("three yrs", [36]), ("18 mos parts", [18]), ("365 days, 730 days", [12]), ("a twenty-five year roof", [300]), ("ninety-day labor", [3]), ("45 days", [])])
def test_warranty_lengths(spark, quote, months):
    assert value(spark, C.warranty_months(F.lit(quote))) == months


def test_returns_and_policies(spark):
    lots = spark.createDataFrame([(1, "BIG MART NORTH", D("2026-01-01"), "pet", "in_stock", None, None), (2, "MART", D("2026-01-01"), "pet", "in_stock", 0, None), (3, "SHOP", D("2026-01-01"), "pet", "in_stock", 90, None), (4, "CLUB", D("2020-01-01"), "pet", "in_stock", None, None), (5, "CLUB", D("2020-01-01"), "pet", "in_stock", None, D("2021-01-01")), (6, "MART", D("2026-01-01"), "bakery", "in_stock", None, None), (7, "NONE", D("2026-01-01"), "pet", "in_stock", None, None)], "lot_id long, merchant string, bought_on date, category string, status string, return_days_printed int, opened_on date")
    policies = spark.createDataFrame([(1, "MART", 15), (2, "BIG MART", 30), (3, "CLUB", None)], "policy_id long, pattern string, days int")
    got = {r.lot_id: (r.return_by, r.returnable) for r in items.returnable(lots, policies, "2026-01-20").collect()}
    assert got == {1: (D("2026-01-31"), True), 2: (D("2026-01-01"), False), 3: (D("2026-04-01"), True), 4: (None, True), 5: (None, False), 7: (None, False)}
    assert [r.lot_id for r in items.returns_closing(lots, policies, "2026-01-20").collect()] == [1]
    entries = spark.createDataFrame([(1, "MART", 20, False), (2, "MART", 900, False), (3, "BIG MART", None, True), (4, "NEW", None, False)], "seq int, pattern string, days int, deleted boolean")
    assert {r.pattern: r.days for r in items.set_policies(policies, entries).collect()} == {"MART": 20, "CLUB": None, "NEW": None}


def test_broken_and_oversized_files_become_questions(spark, tmp_path):
    wide = "Date,Payee,Amount\n" + ",".join("x" * 61)
    files = {
        "cell.csv": "Date,Payee,Amount\n1/13/2026,x,1\n1/14/2026," + "y" * 200_000 + ",2", "wide.csv": wide, "twice.csv": "Date,Payee,Amount\n3/8/2026,x,1\n4/9/2026,y,2", "debit.csv": "Date;Details;Money out;Money in\n13/08/2026;Rent;45,10;\n14/08/2026;Pay;;5.00",
        "noname.csv": "date,amount\n2026-01-01,5", "zip.xlsx": "no zip at all", "fine.csv": "Trans. Date,Transaction Description,Debits,Currency Code\n2026/1/5,x,5.00,usd\n2026/1/6,y,6.00,eur\n2026/1/7,,6.00,",
    }
    frame = spark.createDataFrame([(k, v.encode()) for k, v in files.items()], "path string, content binary")
    got = {r.path: r for r in tabular.preview(frame, "USD").collect()}
    assert {k: r.outcome for k, r in got.items()} == {**dict.fromkeys(files, "question"), "debit.csv": "preview", "fine.csv": "preview"}
    assert "date order" in got["twice.csv"].question and "description" in got["noname.csv"].question and "field" in got["cell.csv"].question
    assert (got["debit.csv"].parsed, got["debit.csv"].rejected, got["debit.csv"].inflow) == (1, 1, 500) and (got["fine.csv"].parsed, got["fine.csv"].rejected, got["fine.csv"].outflow) == (1, 2, 500)
    chosen = tabular.Mapping(order="DMY", outflow_positive=True)
    rows = tabular.imported(tabular.read_files(frame.where("path = 'twice.csv'"), chosen), "USD", chosen).orderBy("row").collect()
    assert [(r.posted_date, r.amount_minor) for r in rows] == [(D("2026-08-03"), -100), (D("2026-09-04"), -200)]
    with pytest.raises(ValueError):
        tabular.Mapping(amount="a", debit="b")
    with pytest.raises(Exception, match="stored bytes changed"):
        tabular.verified(frame.withColumn("hash", F.lit("0"))).collect()


def test_the_inbox_waits_until_files_rest(spark, tmp_path):
    names = {"a.pdf": b"x", "b.CSV": b"y", "c.part": b"z", "~$d.xlsx": b"z", "e.txt": b"q"}
    for name, content in names.items():
        (tmp_path / name).write_bytes(content)
    keep = lambda frame: spark.createDataFrame(frame.collect(), frame.schema)
    status = lambda frame: {os.path.basename(r.path): r.status for r in frame.collect()}
    first = keep(intake.settled(spark, str(tmp_path), None))
    assert status(first) == {"a.pdf": "pending", "b.CSV": "pending", "c.part": "ignored", "~$d.xlsx": "ignored", "e.txt": "unsupported"}
    (tmp_path / "b.CSV").write_bytes(b"yy")
    second = keep(intake.settled(spark, str(tmp_path), first))
    assert status(second)["a.pdf"] == "ready" and status(second)["b.CSV"] == "pending"
    assert status(intake.settled(spark, str(tmp_path), second))["b.CSV"] == "ready"


def test_the_inbox_stream_captures_each_content_once(spark, tmp_path):
    folder = tmp_path / "inbox"
    folder.mkdir()
    for name, content in (("a.pdf", b"1"), ("b.pdf", b"1"), ("c.pdf", b"2")):
        (folder / name).write_bytes(content)
    files = intake.first_of_content(intake.inbox(spark, str(folder)).select("path", "hash"))
    query = files.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert spark.read.parquet(f"{tmp_path}/out").count() == 2
