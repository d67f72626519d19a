"""Registered queries against their SQL, on tables large enough that rows meet, and the typed tools."""

import glob
import os

import duckdb
import pytest

from hearthbook.plans import registry, tools
from hearthbook.plans.fixtures import VIEWS, Ledger

FOLDER = "/root/testdata/sf0.01"
registry.load()
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="the driver's tables are not here")


@pytest.fixture(scope="module")
def database():
    connection = duckdb.connect()
    for path in glob.glob(f"{FOLDER}/*.parquet"):
        connection.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return connection


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_matches_its_sql(spark, database, name):
    frame = registry.QUERIES[name](spark, FOLDER)
    columns = sorted(frame.columns)
    result = database.execute(registry.ORACLES[name])
    named = [d[0] for d in result.description]
    assert sorted(named) == columns
    want = sorted(tuple(str(r[named.index(c)]) for c in columns) for r in result.fetchall())
    assert want, "a query that finds nothing proves nothing"
    assert sorted(tuple(str(r[c]) for c in columns) for r in frame.collect()) == want


@pytest.mark.parametrize("name", sorted(registry.QUERIES.keys() - registry.ORACLES.keys()))
def test_query_without_sql_gives_rows(spark, name):
    assert registry.QUERIES[name](spark, FOLDER).columns


def test_ledger_queries_stay_where_the_corpus_part_lacks_a_library(monkeypatch):
    import sys

    import __spark_entry__

    for name in [m for m in sys.modules if m.startswith(("hearthbook.llm", "corpus_pipeline"))]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "public_tokenizers", None)
    assert set(__spark_entry__.queries()) == set(registry.QUERIES) and set(__spark_entry__.oracle_sql()) == set(registry.ORACLES)


def test_every_view_has_rows(spark):
    ledger = Ledger(spark, FOLDER)
    assert all(getattr(ledger, v).limit(1).count() == 1 for v in VIEWS)


def test_links_meet_the_sure_rule(spark):
    ledger = Ledger(spark, FOLDER)
    links = registry.QUERIES["jn_receipt_match"](spark, FOLDER).where("status = 'link'")
    assert links.groupBy("posting_id").count().where("count > 1").count() == 0 and links.groupBy("receipt_id").count().where("count > 1").count() == 0
    assert links.join(ledger.receipts.where("review_status = 'rejected'"), "receipt_id").count() == 0


def test_drill_down_equals_rollup(spark):
    ledger = Ledger(spark, FOLDER)
    period = {"start": "1998-01-01", "end": "1998-12-31"}
    totals = {r.currency: r.spending for r in tools.call(ledger, "get_spending", **period).collect()}
    parts: dict = {}
    for r in tools.call(ledger, "get_spending_by_category", **period).collect():
        parts[r.currency] = parts.get(r.currency, 0) + r.spending
    assert totals == parts
    page = tools.call(ledger, "get_transactions", currency="USD", statuses=("counted",), metric="spending", order="largest", limit=5, **period)
    sizes = [abs(r.amount_minor) for r in page.collect()]
    assert sizes == sorted(sizes, reverse=True) and len(sizes) == 5


@pytest.mark.parametrize("name, arguments", [
    ("nothing", {}), ("get_spending", {"start": "1998-02-01", "end": "1998-01-01"}), ("get_spending", {"start": "1998-2-1", "end": "1998-03-01"}), ("get_spending", {"start": "1998-01-01", "end": "1998-01-02", "x": 1}),
    ("spending_series", {"first_month": "1990-01", "last_month": "1998-01"}), ("get_transactions", {"limit": 5000}), ("get_transactions", {"currency": "XYZ"}), ("detect_spending_anomalies", {"start": "1990-01-01", "end": "1998-01-01"}),
])
def test_bad_questions_are_refused(name, arguments):
    with pytest.raises(ValueError):
        tools.call(None, name, **arguments)
