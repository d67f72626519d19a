"""Golden results of the ledger operators on small inline tables."""

import datetime
import io
import zipfile
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from hearthbook.functions import checks as C
from hearthbook.functions import predicates as P
from hearthbook.functions import text as T
from hearthbook.functions.money import decimal_text, display_text, to_minor
from hearthbook.functions.ratio import percent, round_half_even
from hearthbook.functions.sizes import parse_size
from hearthbook.operators import forecast, items, merge, reconcile, rules, spending
from hearthbook.sources import tabular
from hearthbook.streaming import intake, lots

D = datetime.date.fromisoformat


def value(spark, column, **inputs):
    frame = spark.range(1)
    for name, x in inputs.items():
        frame = frame.withColumn(name, F.lit(x))
    return frame.select(column.alias("v")).first().v


@pytest.mark.parametrize("text, currency, minor", [
    ("45.10", "USD", 4510), ("-1,234.50", "USD", -123450), ("(45.10)", "USD", -4510), ("45.10-", "USD", -4510), ("$19.99", "USD", 1999), ("-$5.00", "USD", -500), ("$-5.00", "USD", -500),
    ("25.00 USD", "USD", 2500), ("1200 JPY", "JPY", 1200), ("12.345 KWD", "KWD", 12345), ("+7", "EUR", 700), (".50", "USD", 50), ("€1,000", "EUR", 100000), ("5.100", "USD", 510),
])
def test_amounts(spark, text, currency, minor):
    assert value(spark, to_minor(F.col("t"), F.col("c")), t=text, c=currency) == (minor, None)


@pytest.mark.parametrize("text, currency", [("1.234,56", "USD"), ("25.001", "USD"), ("1.5", "JPY"), ("€5", "USD"), ("5 EUR", "USD"), ("", "USD"), ("abc", "USD"), ("1,23", "USD"), ("(5", "USD"), ("5", "XXX"), ("1e3", "USD"), ("--5-5", "USD")])
def test_bad_amounts(spark, text, currency):
    got = value(spark, to_minor(F.col("t"), F.col("c")), t=text, c=currency)
    assert got.minor is None and got.error


def test_money_views(spark):
    for minor, currency, plain, shown in ((-123450, "USD", "-1234.50", "-1,234.50 USD"), (5, "USD", "0.05", "0.05 USD"), (1200, "JPY", "1200", "1,200 JPY"), (12345, "KWD", "12.345", "12.345 KWD"), (0, "EUR", "0.00", "0.00 EUR")):
        assert value(spark, decimal_text(F.col("m"), F.col("c")), m=minor, c=currency) == plain
        assert value(spark, display_text(F.col("m"), F.col("c")), m=minor, c=currency) == shown


def test_half_even(spark):
    rows = [(n, d) for n in range(-25, 26) for d in (1, 2, 4, 8, 10)]
    got = spark.createDataFrame(rows, "n long, d long").select("n", "d", round_half_even(F.col("n"), F.col("d")).alias("r")).collect()
    assert all(r.r == int((Decimal(r.n) / r.d).quantize(Decimal(1), "ROUND_HALF_EVEN")) for r in got)
    assert value(spark, percent(F.col("a"), F.col("b")), a=10668, b=12318) == "86.6" and value(spark, percent(F.col("a"), F.col("b")), a=1, b=0) is None


def test_names(spark):
    for raw, want in (("Costco Whse #1234, Inc.", "COSTCO WHSE"), ("Ｃａｆé & Co", "CAFÉ &"), (None, "")):
        assert value(spark, T.normalize_name(F.col("t").cast("string")), t=raw) == want


@pytest.mark.parametrize("line, amount, account, kind", [
    ("CHASE CREDIT CRD AUTOPAY", -5000, "checking", "payment"), ("PAYMENT THANK YOU", 5000, "credit_card", "payment"), ("ONLINE TRANSFER TO SAV", -100, "checking", "transfer"), ("COFFEE", -450, "checking", "purchase"),
    ("STORE REFUND", 500, "checking", "refund"), ("PAYROLL", 200000, "checking", "deposit"), ("MONTHLY FEE", -1200, "checking", "fee"), ("ATM 22", -100, "checking", "withdrawal"), ("INTEREST PAID", 3, "savings", "interest"),
])
def test_classification(spark, line, amount, account, kind):
    assert value(spark, T.classify(F.col("d"), F.col("a"), F.col("t")), d=line, a=amount, t=account) == kind


def test_checks(spark):
    assert value(spark, C.valid_gtin(F.col("c")), c="4006381333931") and not value(spark, C.valid_gtin(F.col("c")), c="4006381333932") and not value(spark, C.valid_gtin(F.col("c")), c="12")
    assert value(spark, C.warranty_months(F.col("q")), q="A two-year limited warranty, 90 days labor, 730 days parts") == [24, 3]
    assert value(spark, C.printed_return_days(F.array(F.lit("x"), F.col("l"))), l="Returns accepted within 45 days") == 45
    assert value(spark, C.figures(F.col("t")), t="1,200.50 and 3, then 3") == ["1200.50", "3"]
    assert value(spark, C.quote_repaired(F.col("q"), F.col("l")), q='"milk 2.00"', l="MILK milk 2.00 x") == "milk 2.00"


def test_sizes(spark):
    for text, dimension, base in (("1 gal", "volume", 3785411784 * 10**7), ("19 OZ", "mass", 19 * 28349523125 * 10**4), ("12 x 12 fl oz", "volume", 144 * 295735295625 * 1000), ("6 pack", "count", 6 * 10**13), ("500ml", "volume", 500 * 10**13)):
        got = value(spark, parse_size(F.col("t")), t=text)
        assert got.dimension == dimension and int(got.base) == base
    assert value(spark, parse_size(F.col("t")), t="assorted") is None


COLUMNS = "transaction_id string, account_id long, posted_date date, description_raw string, merchant string, currency string, transaction_type string, amount_minor long, category string, origin string, review_status string"


def ledger(spark, *rows):
    out = [(str(k), account, D(day), text, text, "USD", kind, amount, category, origin, status) for k, (account, day, text, kind, amount, category, origin, status) in enumerate(rows)]
    return spark.createDataFrame(out, COLUMNS)


def test_spending_counts_only_countable_rows(spark):
    rows = ledger(
        spark, (1, "2026-08-02", "MART", "purchase", -10000, "groceries", "import", "proposed"), (1, "2026-08-03", "FEE", "fee", -5345, None, "import", "proposed"),
        (1, "2026-08-04", "MART", "refund", 1111, None, "import", "proposed"), (1, "2026-08-05", "X", "purchase", -4444, None, "extraction", "proposed"),
        (1, "2026-08-06", "Y", "purchase", -99, None, "import", "rejected"), (1, "2026-08-07", "CARD", "payment", -700, None, "import", "proposed"),
    )
    assert spending.totals(rows).first().asDict() == {"currency": "USD", "spending": 15345, "refunds": 1111, "transactions": 3, "net": 14234}
    assert spending.pending_totals(rows).first().pending == 4444 and spending.excluded(rows).first().excluded == 1
    assert rows.where(P.countable()).count() == 4
    verified = rows.withColumn("review_status", F.when(F.col("origin") == "extraction", "verified").otherwise(F.col("review_status")))
    assert spending.totals(verified).first().net == 18678


def test_anomalies(spark):
    month = lambda m, name, amount: (1, f"2026-0{m}-10", name, "purchase", -amount, name.lower(), "import", "proposed")
    rows = ledger(spark, *(month(m, "HARDWARE", 3000) for m in (3, 4, 5)), month(6, "HARDWARE", 12000), month(6, "GYM", 5000), month(6, "COFFEE", 900))
    got = {(r.kind, r.name): r for r in spending.anomalies(rows, "2026-06-01", "2026-06-30").collect()}
    assert got[("category", "hardware")].percent_above_usual == "300.0" and got[("category", "gym")].new and ("category", "coffee") not in got


def test_greedy_receipts_links_and_open_questions(spark):
    receipts = spark.createDataFrame([(1, "MART", D("2026-08-01"), "USD", 4510, "proposed"), (2, "MART", D("2026-08-01"), "USD", 4510, "proposed"), (3, "CAFE", D("2026-08-02"), "USD", 500, "proposed"), (4, "X", D("2026-08-01"), "USD", 900, "rejected")], "receipt_id long, merchant string, purchase_date date, currency string, total_minor long, review_status string")
    postings = spark.createDataFrame([(10, D("2026-08-01"), "MART 12", "USD", -4510, "proposed"), (11, D("2026-08-04"), "OTHER", "USD", -4510, "proposed"), (12, D("2026-08-03"), "SHOP", "USD", -500, "proposed"), (13, D("2026-08-04"), "SHOP", "USD", -500, "proposed"), (14, D("2026-08-01"), "X", "USD", -900, "proposed")], "posting_id long, posted_date date, description_raw string, currency string, amount_minor long, review_status string")
    got = {(r.receipt_id, r.posting_id): (r.score, r.method, r.status) for r in reconcile.link_receipts(receipts, postings).collect()}
    assert got == {(1, 10): (100, "amount+same_day+merchant", "link"), (2, 11): (60, "amount", "link"), (3, 12): (70, "amount+date", "open"), (3, 13): (70, "amount+date", "open")}
    known = spark.createDataFrame([(3, 12, "rejected"), (1, 10, "verified")], "receipt_id long, posting_id long, review_status string")
    assert {(r.receipt_id, r.posting_id, r.status) for r in reconcile.link_receipts(receipts, postings, known).collect()} == {(3, 13, "link"), (2, 11, "link")}
    assert reconcile.link_receipts(receipts.limit(0), postings).count() == 0


def test_recurring_monthly(spark):
    rows = ledger(spark, *((1, day, "NETFLIX.COM 99", "purchase", -1549, None, "import", "proposed") for day in ("2026-07-05", "2026-08-05", "2026-09-05")))
    got = reconcile.recurring(rows).first()
    assert (got.frequency, got.expected_minor, got.next_due_date, got.payments) == ("monthly", 1549, D("2026-10-05"), 3)


def test_import_is_idempotent_and_order_free(spark):
    rows = [(1, k, 7, D("2026-08-01"), -450, "USD") for k in range(2)] + [(1, 2, 7, D("2026-08-02"), 200000, "USD")]
    schema = "source int, source_row int, account_id long, posted_date date, amount_minor long, currency string"
    first = merge.fingerprints(spark.createDataFrame(rows, schema))
    again = merge.fingerprints(spark.createDataFrame([(2, 9 - r[1], *r[2:]) for r in rows], schema))
    assert {r.outcome for r in merge.insert_ignore(first, again, ["account_id", "fingerprint"]).collect()} == {"duplicate"}
    assert first.select("fingerprint").distinct().count() == 3


def test_rules_prefer_more_words_then_newer(spark):
    rows = ledger(spark, (1, "2026-08-01", "COSTCO GAS #12", "purchase", -1, None, "import", "proposed"), (2, "2026-08-01", "COSTCO WHSE", "purchase", -1, None, "import", "proposed"), (1, "2026-08-01", "OTHER", "purchase", -1, None, "import", "proposed"))
    book = spark.createDataFrame([(1, "COSTCO", "groceries", None), (2, "COSTCO GAS", "fuel", None), (3, "COSTCO", "bulk", 2)], "rule_id long, pattern string, category string, account_id long")
    assert {r.transaction_id: r.category for r in rules.apply_rules(rows, book).collect()} == {"0": "fuel", "1": "bulk"}


def test_consumption_and_price_rises(spark):
    schema = "lot_id string, product_id long, name string, brand string, size_text string, category string, merchant string, currency string, cost_minor long, units string, bought_on date, closed_on date, status string"
    made = spark.createDataFrame([
        ("1", 1, "Milk", None, "1 gal", "dairy & eggs", "A", "USD", 350, "1", D("2026-08-01"), D("2026-08-08"), "finished"), ("2", 1, "Milk", None, "1 gal", "dairy & eggs", "A", "USD", 350, None, D("2026-08-08"), D("2026-08-21"), "finished"),
        ("3", 2, "Cereal", "Oaty", "12 oz", "pantry", "A", "USD", 399, "1", D("2026-07-01"), None, "in_stock"), ("4", 2, "Cereal", "Oaty", "10.8 oz", "pantry", "B", "USD", 399, "1", D("2026-08-01"), None, "in_stock"),
        ("5", 3, "Lettuce", None, "assorted", "produce", "B", "USD", 299, "x", D("2026-08-01"), D("2026-08-05"), "thrown_out"),
    ], schema)
    rate = items.consumption_cost(made).first()
    assert (rate.per_day, rate.per_30_days, rate.approximate) == (35, 1050, True)
    assert items.forecast_consumables(made, 31).first().projected == 1085 and items.waste(made, "2026-08-01", "2026-08-31").first().wasted == 299
    rise = items.price_changes(made).first()
    assert (rise["product"], rise.first_minor, rise.last_minor, rise.percent_change, rise.size_changed) == ("CEREAL", 117, 130, "11.1", True)
    assert {r.product_id: r.days for r in items.usual_days(made).collect()} == {1: 10, 2: 28, 3: 7}


def test_csv_and_xlsx_imports(spark):
    text = "My bank\nExported\n\nPosted Date,Description,Amount,Balance\n08/13/2026,COFFEE,-4.50,1\n08/13/2026,COFFEE,-4.50,1\n08/14/2026,PAY,\"2,000.00\",1\n,,,\n08/15/2026,RENT,(500.00),1\n08/16/2026,FEE,$-5.00,1\n08/17/2026,BAD,12.345,1\n"
    book = io.BytesIO()
    with zipfile.ZipFile(book, "w") as z:
        z.writestr("xl/sharedStrings.xml", '<sst xmlns="m"><si><t>Date</t></si><si><t>Details</t></si><si><t>Amount</t></si></sst>')
        z.writestr("xl/styles.xml", '<styleSheet xmlns="m"><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/></cellXfs></styleSheet>')
        z.writestr("xl/workbook.xml", '<workbook xmlns="m"/>')
        z.writestr("xl/worksheets/sheet1.xml", '<worksheet xmlns="m"><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="B1" t="s"><v>1</v></c><c r="C1" t="s"><v>2</v></c></row>'
                   '<row><c r="A2" s="1"><v>46247</v></c><c r="B2" t="inlineStr"><is><t>Tea</t></is></c><c r="C2"><v>-45.099999999999994</v></c></row></sheetData></worksheet>')
    bad = b'<!DOCTYPE x><worksheet/>'
    evil = io.BytesIO()
    with zipfile.ZipFile(evil, "w") as z:
        z.writestr("xl/worksheets/sheet1.xml", bad)
    files = spark.createDataFrame([("a.csv", text.encode()), ("b.xlsx", book.getvalue()), ("c.xlsx", evil.getvalue()), ("d.csv", "Datum;x\n1;2".encode("cp1252"))], "path string, content binary")
    rows = tabular.read_files(files)
    assert rows.where("path = 'a.csv'").agg(tabular.date_order(F.col("date"))).first()[0] == "MDY"
    parsed = tabular.typed(rows.where("row > 0"), "USD")
    assert [r.amount_minor for r in parsed.where("path = 'a.csv' and reject_reason is null").orderBy("row").collect()] == [-450, -450, 200000, -50000, -500]
    counted = {r.path: (r.parsed, r.rejected, r.blank) for r in tabular.counts(parsed).collect()}
    assert counted == {"a.csv": (5, 1, 1), "b.xlsx": (1, 0, 0)}
    tea = parsed.where("path = 'b.xlsx'").first()
    assert (tea.posted_date, tea.amount_minor) == (D("2026-08-13"), -4510)
    assert {r.path for r in rows.where("row = 0").collect()} == {"c.xlsx", "d.csv"}


def test_lot_states_back_off_and_undo_once(spark):
    day = D("2026-01-01")
    commands = [(1, k, day, "still_have") for k in range(7)] + [(2, 0, day, "finished"), (2, 1, day, "undo"), (2, 2, day, "undo")]
    got = {r.lot_id: r for r in lots.fold(spark.createDataFrame(commands, "lot_id long, seq long, day date, event string")).collect()}
    assert got[1].next_check_on == day + datetime.timedelta(days=182) and got[1].interval == 182
    assert got[2].status == "in_stock" and got[2].closed_on is None
    state, before, waits = lots.State(), None, []
    for _ in range(7):
        state, before = lots.step(state, before, lots.Command("still_have", day))
        waits.append((state.next_check_on - day).days)
    assert waits == [7, 14, 28, 56, 112, 182, 182]


def test_lot_rules():
    day, late = D("2026-01-10"), D("2026-01-20")
    new = lots.State()
    refused = [
        lots.Command("finished", late, today=day), lots.Command("finished", day, bought_on=late), lots.Command("reopened", day), lots.Command("opened", day, openable=False), lots.Command("eaten", day),
    ]
    assert all(lots.step(new, None, c) == (new, None) for c in refused)
    done, before = lots.step(new, None, lots.Command("thrown_out", day, today=late, precision=3))
    assert done == lots.State("thrown_out", day, 3) and before == new
    assert lots.step(done, before, lots.Command("still_have", late)) == (done, before)
    again, _ = lots.step(done, before, lots.Command("reopened", day, today=late))
    assert again == lots.State("in_stock", None, 0, late + datetime.timedelta(days=7)) and lots.step(done, before, lots.Command("reopened", day, consumable=False))[0].next_check_on is None
    opened, was = lots.step(new, None, lots.Command("opened", day))
    assert opened.opened_on == day and lots.step(opened, was, lots.Command("opened", late)) == (opened, was) and lots.step(opened, was, lots.Command("undo", late)) == (new, None)


def test_lot_stream_equals_batch(spark, tmp_path):
    day = D("2026-01-01")
    rows = [(k % 5, k, day + datetime.timedelta(days=k), ("still_have", "opened", "finished", "undo", "reopened")[k % 4 + k % 2]) for k in range(40)]
    schema = "lot_id long, seq long, day date, event string"
    for part in (0, 1):
        spark.createDataFrame(rows[part * 20 : part * 20 + 20], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    seen = []
    query = lots.stream(stream).writeStream.outputMode("update").foreachBatch(lambda b, k: seen.extend((k, *r) for r in b.collect())).option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    query.awaitTermination(120)
    last = {r[1]: r[2:] for r in sorted(seen)}
    order = spark.read.parquet(f"{tmp_path}/in")
    assert last == {r[0]: tuple(r)[1:] for r in lots.fold(order).collect()}


def test_replayed_import_stream_adds_nothing(spark, tmp_path):
    rows = merge.fingerprints(spark.createDataFrame([(1, k, 7, D("2026-08-01"), -450, "USD") for k in range(3)], "source int, source_row int, account_id long, posted_date date, amount_minor long, currency string"))
    sink = intake.import_batch(spark, f"{tmp_path}/target")
    for k in range(3):
        sink(rows, k)
    assert spark.read.parquet(f"{tmp_path}/target").count() == 3


def test_projection_goldens():
    scenario = {"cash": 100000, "monthly_income": 300000, "income_growth_bp": 0, "inflation_bp": 0, "months": 12, "spending": [{"category": "groceries", "amount": 200000}],
                "assets": [{"kind": "vehicle", "value_minor": 2_000_000, "annual_rate_bp": -1500, "monthly_payment_minor": None}, {"kind": "loan", "value_minor": 1_000_000, "annual_rate_bp": 600, "monthly_payment_minor": 50_000}]}
    months = list(forecast.project_one(scenario))
    assert months[0][:6] == (1, 300000, 200000, 50000, 0, 150000) and months[0][7] == 955000 and months[-1][6] == 1_700_000
    priced = list(forecast.project_one({**scenario, "assets": None, "inflation_bp": 200, "months": 24}))
    assert priced[11][2] == 204000 and priced[23][2] == 208080 and priced[23][1] == 300000


def test_loans_in_sql_match_the_projection(spark):
    loans = spark.createDataFrame([(1, 1_000_000, 600, 50_000)], "loan_id long, balance long, rate_bp long, payment long")
    balances = [r.balance for r in forecast.loan_schedule(loans, 12).orderBy("month").collect()]
    scenario = {"cash": 0, "monthly_income": 0, "income_growth_bp": 0, "inflation_bp": 0, "months": 12, "assets": [{"kind": "loan", "value_minor": 1_000_000, "annual_rate_bp": 600, "monthly_payment_minor": 50_000}]}
    assert balances == [m[7] for m in forecast.project_one(scenario)]


def test_closure(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (4, 5), (3, 1)], "parent long, child long")
    assert sorted(r.id for r in merge.closure(spark.createDataFrame([(1,)], "id long"), edges).collect()) == [1, 2, 3]
