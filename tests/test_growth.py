"""Work that grows with the rows, not with the pairs of equal ones, nor in one task."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from hearthbook.operators import extraction, products, upkeep
from hearthbook.operators import reconcile as R
from hearthbook.sources import tabular

DAY = dt.date(1998, 5, 4)


def _most_joined(frame):
    """The most rows that any join of a frame puts out, once it has run."""
    frame.collect()
    most, todo = 0, [frame._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        if node.nodeName().startswith("AdaptiveSparkPlan"):
            todo.append(node.executedPlan())
        elif "QueryStage" in node.nodeName():
            todo.append(node.plan())
        else:
            rows = node.metrics().get("numOutputRows") if "Join" in node.nodeName() else None
            most = max(most, rows.get().value() if rows is not None and rows.isDefined() else 0)
            todo += [node.children().apply(i) for i in range(node.children().size())]
    return most


def _bills(spark, count):
    rows = [(k, "NORTH POWER" if k % 2 else None, DAY, DAY + dt.timedelta(30), "USD", 5000, "unknown", "proposed") for k in range(count)]
    return spark.createDataFrame([*rows, (count, "NORTH POWER", DAY, DAY + dt.timedelta(30), "USD", 70, "unknown", "proposed")], "bill_id long, provider string, issue_date date, due_date date, currency string, amount_due_minor long, payment_status string, review_status string")


def _postings(spark, count):
    rows = [(k, DAY + dt.timedelta(k % 3), "USD", f"NORTH POWER #{k}", -5000, "proposed") for k in range(count)]
    return spark.createDataFrame([*rows, (count, DAY, "USD", "POWER NORTH #9", -70, "proposed")], "posting_id long, posted_date date, currency string, description_raw string, amount_minor long, review_status string")


def test_equal_bills_and_postings_meet_once(spark):
    found = R.bill_payments(_bills(spark, 200), _postings(spark, 200))
    assert [tuple(r) for r in found.collect()] == [(200, 200)]
    assert _most_joined(found) < 200


def test_equal_bills_share_their_only_payment(spark):
    found = R.bill_payments(_bills(spark, 3), _postings(spark, 1))
    assert sorted(map(tuple, found.collect())) == [(0, 0), (1, 0), (2, 0), (3, 1)]


def test_upcoming_equal_bills_meet_once(spark):
    found = R.upcoming_bills(_bills(spark, 200), _postings(spark, 200), "1998-05-20", 30)
    assert {r.bill_id: r.payment_id for r in found.collect()} == {k: 200 if k == 200 else None for k in range(201)}
    assert _most_joined(found) <= 201


def _receipts(spark, count):
    rows = [(k, "NORTH SHOP" if k % 2 else None, DAY, "USD", 5000, "proposed") for k in range(count)]
    return spark.createDataFrame(rows, "receipt_id long, merchant string, purchase_date date, currency string, total_minor long, review_status string")


def test_candidates_are_counted_without_pairs(spark):
    receipts, postings = _receipts(spark, 200), _postings(spark, 200)
    counted = R.receipt_counts(receipts, postings)
    pairs = R.receipt_candidates(receipts, postings).groupBy("receipt_id").agg(F.count("*").alias("candidates"), F.max("score").alias("best"))
    assert sorted(map(tuple, counted.collect())) == sorted(map(tuple, pairs.collect())) and counted.count() == 200
    assert _most_joined(counted) <= 200


def test_names_are_read_before_rows_pair(spark):
    plan = R.receipt_candidates(_receipts(spark, 2), _postings(spark, 2))._jdf.queryExecution().optimizedPlan().toString()
    above = plan[:plan.index("Join ")]
    assert "regexp_replace" not in above and "arrays_overlap" in above


def _largest_task(frame):
    """Rows of the fullest partition."""
    return max(r["count"] for r in frame.groupBy(F.spark_partition_id()).count().collect())


def _resolved(spark, chosen):
    issues = spark.range(2000).select(F.lit("ambiguous_receipt_match").alias("issue_type"), F.col("id").alias("record_id"), F.array(F.col("id"), F.col("id") + 5000).alias("candidates"), F.lit("open").alias("status"))
    choices = issues.select("issue_type", "record_id", F.lit(1).alias("seq"), F.when(F.col("record_id") % 4 == 2, F.col("record_id")).otherwise(F.lit(chosen).cast("long")).alias("chosen"))
    rows = spark.range(2000).select(F.col("id").alias("posting_id"), F.when(F.col("id") == 2, "rejected").otherwise("proposed").alias("review_status"))
    taken = spark.createDataFrame([(6, 7)], "posting_id long, receipt_id long")
    limit, aqe = (spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        done = R.resolve_issues(issues, choices, rows, taken)
        return {r.record_id: r.outcome for r in done.collect()}, _largest_task(done)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
        spark.conf.set("spark.sql.adaptive.enabled", aqe)


def test_issues_left_unmatched_do_not_meet_in_one_task(spark):
    outcomes, largest = _resolved(spark, None)
    assert outcomes[0] == "left_unmatched" and outcomes[2] == outcomes[6] == "refused" and outcomes[10] == "linked"
    assert largest < 1000


def test_choices_that_were_not_offered_do_not_meet_in_one_task(spark):
    outcomes, largest = _resolved(spark, -1)
    assert outcomes[0] == "refused" and outcomes[2] == "refused" and outcomes[10] == "linked"
    assert largest < 1000


def test_lines_without_a_code_do_not_meet_in_one_task(spark):
    lines = spark.range(2000).selectExpr("cast(id as string) as line_id", "'M' as merchant", "concat('THING ', id) as description", "case when id % 4 = 0 then concat('c', id) end as product_code")
    aliases = spark.sql("select 1L as alias_id, 'M' as merchant, 'THING 6' as text, 'c8' as code, 70L as product union all select 2L, 'N', 'X', 'line 5', 71L")
    limit, aqe = (spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        found = products.known(lines, aliases)
        assert sorted(map(tuple, found.collect())) == [("6", 70, "alias"), ("8", 70, "alias")]
        sent = found._jdf.queryExecution().optimizedPlan().toString()
        assert sent.count("line ") >= 2  # a key of its own for a missing code and a missing text
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
        spark.conf.set("spark.sql.adaptive.enabled", aqe)


def test_a_lots_warranties_travel_once(spark):
    shape = "lot_id long, kind string, months int, lifetime boolean, source string, review_status string, seq int"
    old = spark.createDataFrame([(1, "manufacturer", 6, False, "lookup", "proposed", 0), (2, "manufacturer", 6, False, "user", "verified", 0), (3, "store", 6, False, "lookup", "proposed", 0)], shape)
    new = spark.createDataFrame([(1, "manufacturer", 12, False, "user", "verified", 1), (1, "manufacturer", 9, False, "lookup", "proposed", 2), (2, "manufacturer", 24, False, "lookup", "proposed", 1), (3, "store", 24, False, "user", "verified", 1), (4, "gift", 24, False, "user", "verified", 1)], shape)
    lots = spark.createDataFrame([(k, k == 3, DAY) for k in range(1, 5)], "lot_id long, consumable boolean, bought_on date")
    stands = upkeep.add_warranties(old, new, lots)
    assert sorted((r.lot_id, r.kind, r.months) for r in stands.collect()) == [(1, "manufacturer", 12), (2, "manufacturer", 6), (3, "store", 6)]
    plan = stands._jdf.queryExecution().executedPlan().toString().partition("== Initial Plan ==")[0]
    assert "Window" not in plan and plan.count("Exchange hashpartitioning") <= 2


def _plain_transfers(out, into, rejected):
    """The rule in words: outflows choose in id order; the only inflow of another account within five days is linked, several stay open if the outflow says so."""
    taken, found = set(), set()
    for k, account, day, amount, kind in sorted(out):
        free = [(i, 70 + 10 * (d == day) + 20 * (kind == "transfer" and said == "transfer")) for i, other, d, a, said, card in into
                if i not in taken and a == -amount and other != account and abs((d - day).days) <= 5 and ("transfer" in (kind, said) or card) and (k, i) not in rejected]
        if len(free) == 1:
            taken.add(free[0][0])
        if len(free) == 1 or kind == "transfer":
            found |= {(k, i, score, "link" if len(free) == 1 else "open") for i, score in free}
    return found


@pytest.mark.parametrize("seed,days", [(1, 9), (2, 60), (3, 400)])
def test_transfers_choose_in_turn(spark, seed, days):
    draw = random.Random(seed)
    day = lambda: DAY + dt.timedelta(draw.randrange(days))
    cards = {k: "credit_card" if k == 3 else "checking" for k in range(6)}
    out = [(k, draw.randrange(6), day(), -draw.choice([500, 700]), draw.choice(["transfer", "purchase"])) for k in range(60)]
    into = [(1000 + k, a := draw.randrange(6), day(), draw.choice([500, 700]), draw.choice(["transfer", "deposit", "deposit"]), a == 3) for k in range(70)]
    rejected = {(draw.randrange(60), 1000 + draw.randrange(70)) for _ in range(600)}
    rows = spark.createDataFrame([(*r[:4], r[4], "USD", "proposed") for r in [*out, *into]], "posting_id long, account_id long, posted_date date, amount_minor long, transaction_type string, currency string, review_status string")
    accounts = spark.createDataFrame(list(cards.items()), "account_id long, account_type string")
    links = spark.createDataFrame([(*p, "rejected") for p in rejected], "out_id long, in_id long, review_status string")
    for known, no in ((None, set()), (links, rejected)):
        assert {tuple(r) for r in R.link_transfers(rows, accounts, known).collect()} == _plain_transfers(out, into, no)


def _plain_receipts(receipts, postings, rejected):
    taken, found = set(), set()
    for k, name, day, amount in sorted(receipts):
        free = []
        for p, said, d, a in postings:
            lag = (d - day).days
            if p not in taken and a == -amount and 0 <= lag <= 5 and (k, p) not in rejected:
                same, near, named = lag == 0, 0 < lag <= 2, bool(set(name.split()) & set(said.split()))
                free.append((-(60 + 20 * same + 10 * near + 20 * named), p, "amount" + "+same_day" * same + "+date" * near + "+merchant" * named))
        free.sort()
        link = len(free) == 1 or (len(free) > 1 and -free[0][0] >= 80 and free[1][0] - free[0][0] >= 20)
        if link:
            taken.add(free[0][1])
        found |= {(k, p, -score, method, "link" if link else "open") for score, p, method in (free[:1] if link else free)}
    return found


@pytest.mark.parametrize("seed,days", [(1, 9), (2, 60), (3, 400)])
def test_receipts_choose_in_turn(spark, seed, days):
    draw = random.Random(seed)
    day, name = lambda: DAY + dt.timedelta(draw.randrange(days)), lambda: draw.choice(["RED SHOP", "BLUE SHOP", "GREEN CAFE", "PLAIN"])
    receipts = [(k, name(), day(), draw.choice([500, 700])) for k in range(60)]
    postings = [(1000 + k, name(), day(), -draw.choice([500, 700])) for k in range(70)]
    rejected = {(draw.randrange(60), 1000 + draw.randrange(70)) for _ in range(600)}
    r = spark.createDataFrame([(*x, "USD", "proposed") for x in receipts], "receipt_id long, merchant string, purchase_date date, total_minor long, currency string, review_status string")
    p = spark.createDataFrame([(*x, "USD", "proposed") for x in postings], "posting_id long, description_raw string, posted_date date, amount_minor long, currency string, review_status string")
    links = spark.createDataFrame([(*x, "rejected") for x in rejected], "receipt_id long, posting_id long, review_status string")
    for known, no in ((None, set()), (links, rejected)):
        assert {tuple(x) for x in R.link_receipts(r, p, known).collect()} == _plain_receipts(receipts, postings, no)


def test_receipts_are_linked_without_pairs(spark):
    linked = R.link_receipts(_receipts(spark, 200), _postings(spark, 200))
    assert linked.where("status = 'link'").count() == 0 and linked.count() == 200 * 200
    unmatched = R.unmatched_receipts(_receipts(spark, 200), linked)
    assert [tuple(r) for r in unmatched.collect()] == [("USD", 200, 1000000, 0)] and _most_joined(unmatched) <= 200
    plan = linked._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "MapInArrow" not in plan and "MapInPandas" not in plan  # pairs are joined and given out


def test_only_the_bytes_of_lines_are_sent(spark):
    texts = {1: ["a" * 9] * 7, 2: ["é" * 20, "b" * 100, "c"], None: ["d"], 3: ["e" * 5] * 3}
    lines = spark.createDataFrame([(k, n, t) for k, each in texts.items() for n, t in enumerate(each)], "doc_id long, line int, text string").repartition(3)
    found = extraction.chunks(lines, 3, 50)
    assert {tuple(r) for r in found.collect()} == {(1, 0, 0, 2), (1, 1, 3, 5), (1, 2, 6, 6), (2, 0, 0, 0), (2, 1, 1, 1), (2, 2, 2, 2), (None, 0, 0, 0), (3, 0, 0, 2)}
    sent = found._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in sent and "FlatMapGroups" not in sent


def test_no_file_is_parsed_twice(spark):
    files = spark.createDataFrame([("a.csv", b"Date,Payee,Amount\n1/13/2026,x,-5.00\n1/2/2026,y,7.00"), ("b.csv", b"Date,Payee,Amount\n1/2/2026,x,-5.00"), ("c.csv", b"nothing"), ("d.csv", b"Date,Payee,Amount\n2026-01-02,x,-5.00")], "path string, content binary")
    shown = tabular.preview(files, "USD")
    assert {(r.path, r.outcome, r.question, r.parsed, r.inflow, r.outflow) for r in shown.collect()} == {
        ("a.csv", "preview", None, 2, 700, 500), ("b.csv", "question", "choose the date order", 0, 0, 0), ("c.csv", "question", "no header with a date and an amount", 0, 0, 0), ("d.csv", "preview", None, 1, 0, 500)}
    for frame in (shown, tabular.imported(tabular.read_files(files), "USD")):
        assert frame._jdf.queryExecution().optimizedPlan().toString().count("MapInPandas") == 1
