"""Forecasts over all rows of a table, however many."""

import os
import random

import pytest

from hearthbook.operators import forecast
from hearthbook.plans import registry, states
from hearthbook.plans.fixtures import Ledger

FOLDER = "/root/testdata/sf0.001"
registry.load()


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="the driver's tables are not here")
@pytest.mark.parametrize("name", ["forecast_project", "agg_years"])
def test_every_customer_is_projected(spark, name):
    customers = {r.c_custkey for r in spark.read.parquet(f"{FOLDER}/customer.parquet").select("c_custkey").collect()}
    rows = registry.QUERIES[name](spark, FOLDER).groupBy("scenario_id").count().collect()
    assert {r.scenario_id for r in rows} == customers and {r["count"] for r in rows} == {36 if name == "forecast_project" else 3}


def test_loan_schedules_pass_a_million_rows_and_a_hundred_months(spark):
    loans = spark.range(45000).selectExpr("id as loan_id", "1000000L + id as balance", "300L as rate_bp", "1000L as payment")
    assert forecast.loan_schedule(loans, 24).count() == 45000 * 24
    rows = forecast.loan_schedule(loans.limit(1), 150).orderBy("month").collect()
    assert [r.month for r in rows] == list(range(1, 151)) and rows[0].interest == 250000 // 100 and rows[0].balance == 1000000 + 2500 - 1000
    assert forecast.loan_schedule(loans.limit(1), 0).count() == 0


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="the driver's tables are not here")
@pytest.mark.parametrize("name", ["udtf_project", "agg_years"])
def test_a_small_file_of_scenarios_is_many_tasks(spark, name):
    """A file of one row group was one task, and thousands of projections with it."""
    rows = registry.QUERIES[name](spark, FOLDER) if name == "udtf_project" else forecast.project(states._scenarios(Ledger(spark, FOLDER)))
    tasks = rows.selectExpr("scenario_id", "spark_partition_id() as task").distinct().collect()
    each = [sum(r.task == t for r in tasks) for t in {r.task for r in tasks}]
    assert len(each) >= 4 and max(each) < len(tasks) / 2


def test_long_scenarios_leave_a_task_in_small_batches(spark):
    """A batch held the rows of all its scenarios, up to 1200 for each."""
    rows = spark.range(300).selectExpr("id as scenario_id", "0L as cash", "100L + id as monthly_income", "250L as income_growth_bp", "200L as inflation_bp", "400 as months").coalesce(1)
    sizes = forecast.project(rows).coalesce(1).mapInArrow(lambda batches: (b.slice(0, 1).select(["month"]).set_column(0, "month", [b.num_rows]) for b in batches), "month long")
    assert max(r.month for r in sizes.collect()) <= forecast.ROWS_AT_ONCE + 400
    assert forecast.project(rows).count() == 300 * 400


def _drawn(draw):
    """A scenario with every kind of part, amounts that fall on halves, and now and then figures that no double holds."""
    amount = lambda: draw.choice([0, 1, 5, 50, -3, draw.randrange(10**6), draw.randrange(10**9), 10**12 + 1, 2**50 + 1])
    rate = lambda: draw.choice([0, 0, 250, 300, 1200, 5000, -300, -10000, -12000, draw.randrange(900)])
    some = lambda make: draw.choice([None, [make() for _ in range(draw.randrange(4))]])
    return {
        "cash": amount(), "monthly_income": amount(), "income_growth_bp": rate(), "inflation_bp": draw.choice([0, 200, 1200, -300]), "months": 30,
        "spending": some(lambda: {"category": draw.choice("ab"), "amount": amount()}), "spending_changes": some(lambda: {"category": draw.choice("abc"), "percent_bp": draw.choice([5000, -2500, 1])}),
        "income_steps": some(lambda: {"month": draw.randrange(-1, 40), "amount": amount()}), "one_offs": some(lambda: {"month": draw.randrange(-1, 40), "amount": amount()}),
        "assets": some(lambda: {"kind": draw.choice(["loan", "house"]), "value_minor": amount(), "annual_rate_bp": rate(), "monthly_payment_minor": draw.choice([None, 0, 10, 5000, amount()])}),
    }


def test_scenarios_projected_together_equal_those_projected_alone():
    draw = random.Random(5)
    scenarios = [_drawn(draw) for _ in range(600)]
    together = forecast.project_many(scenarios, 30)
    for i, s in enumerate(scenarios):
        assert list(zip(range(1, 31), *(c[i].tolist() for c in together))) == list(forecast.project_one(s)), s
    with pytest.raises(ArithmeticError):  # a price of nothing
        forecast.project_many([scenarios[0] | {"inflation_bp": -10000}], 30)


def test_few_scenarios_are_projected_alone(monkeypatch):
    """Each was, at 34 digits, which was nearly all the time of a task."""
    alone, one = [], forecast.project_one
    monkeypatch.setattr(forecast, "project_one", lambda s: alone.append(s) or one(s))
    house = lambda k: [{"kind": "house", "value_minor": 7919 * k, "annual_rate_bp": 300}, {"kind": "loan", "value_minor": 7919 * k, "annual_rate_bp": 300 + k % 500, "monthly_payment_minor": 396 * k}]
    forecast.project_many([{"cash": 100000, "monthly_income": 500000, "spending": [{"category": "a", "amount": 300000}], "income_growth_bp": 250, "inflation_bp": 200, "months": 36, "assets": house(k)} for k in range(500)], 36)
    assert len(alone) < 25


def test_scenarios_of_unequal_months_and_without_id(spark):
    rows = spark.range(200).selectExpr("if(id = 7, null, id) as scenario_id", "0L as cash", "100L + id as monthly_income", "250L as income_growth_bp", "200L as inflation_bp", "cast(id % 5 as int) as months")
    got = {r.id: r["count"] for r in forecast.project(rows).selectExpr("coalesce(scenario_id, 7) as id").groupBy("id").count().collect()}
    assert got == {k: k % 5 for k in range(200) if k % 5}


def test_assets_near_a_half_leave_no_scenario_alone(monkeypatch):
    """Each was projected by itself, at 34 digits; 50 at 3 % is 51.5 after a year."""
    house = lambda k: [{"kind": "house", "value_minor": 50 * (2 * k + 1), "annual_rate_bp": rate} for rate in (300, 50, -300)]
    scenarios = [{"cash": k, "monthly_income": 10, "income_growth_bp": 0, "inflation_bp": 200, "months": 36, "assets": house(k)} for k in range(60)]
    one = forecast.project_one
    expected = [list(one(s)) for s in scenarios]
    monkeypatch.setattr(forecast, "project_one", lambda s: pytest.fail("projected alone"))
    together = forecast.project_many(scenarios, 36)
    assert [list(zip(range(1, 37), *(c[i].tolist() for c in together))) for i in range(60)] == expected


def test_scenarios_are_read_by_column_as_they_are():
    """to_pylist made an object of every value first; lists, structs and values may be null, and a batch a slice."""
    import pyarrow as pa

    draw = random.Random(7)
    some = lambda make: draw.choice([None, make(), make()])
    asset = lambda: {"kind": some(lambda: "loan"), "value_minor": some(lambda: draw.randrange(2**62)), "rates": some(lambda: [1, None]), "share": some(lambda: 0.5)}
    rows = [{"scenario_id": some(lambda: k), "months": k, "assets": some(lambda: [some(asset) for _ in range(draw.randrange(4))]), "note": some(lambda: {"text": "ü"})} for k in range(500)]
    kind = pa.struct([("kind", pa.string()), ("value_minor", pa.int64()), ("rates", pa.list_(pa.int64())), ("share", pa.float64())])
    note = pa.struct([("text", pa.large_string())])
    for list_of in (pa.list_, pa.large_list):
        schema = pa.schema([("scenario_id", pa.int64()), ("months", pa.int32()), ("assets", list_of(kind)), ("note", note)])
        batch = pa.RecordBatch.from_pylist(rows, schema=schema)
        for part in (batch, batch.slice(3, 101), batch.slice(500)):
            assert forecast._listed(part.to_struct_array()) == part.to_pylist()
