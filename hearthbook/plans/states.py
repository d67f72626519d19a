"""Registered queries of forecasts, state machines, closures and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from hearthbook.operators import forecast as O
from hearthbook.operators import merge as M
from hearthbook.operators.written import folder
from hearthbook.plans.registry import half_even_sql, query
from hearthbook.plans.spending import COUNTED, SPENT, get_account_balance
from hearthbook.streaming import intake, lots


@query("forecast_baseline", f"""
select coalesce(c.currency, f.currency) as currency, coalesce(cash, 0) as cash, {half_even_sql("coalesce(i, 0)", "12")} as monthly_income, {half_even_sql("coalesce(s, 0)", "12")} as monthly_spending from (
  select a.currency, cast(sum(case when account_type = 'credit_card' then -closing_balance_minor else closing_balance_minor end) as bigint) as cash
  from (select *, row_number() over (partition by account_id order by period_end desc, statement_id desc) as k from statements where review_status <> 'rejected') b join accounts a on a.account_id = b.account_id
  where k = 1 and account_type in ('checking', 'savings', 'credit_card') group by 1) c
full outer join (select currency, cast(sum(case when transaction_type in ('deposit', 'interest', 'other') and amount_minor > 0 then amount_minor end) as bigint) as i, cast(sum(case when {SPENT} or transaction_type = 'refund' then -amount_minor end) as bigint) as s
  from transactions where {COUNTED} and posted_date between date '1998-01-01' and date '1998-12-31' group by 1) f on f.currency = c.currency""", "statements", "accounts", "transactions")
def forecast_baseline(ledger):
    return O.baseline(ledger.transactions, get_account_balance(ledger), ledger.accounts, "1998-01-01", "1998-12-31", 12)


LOANS = "select c_custkey as loan_id, cast(round(abs(c_acctbal) * 100) as bigint) as balance, cast(300 + c_custkey % 500 as bigint) as rate_bp, cast(round(abs(c_acctbal) * 100) as bigint) // 20 + 1 as payment from customer"
DUE = half_even_sql("balance * rate_bp", "120000")


@query("forecast_loans", f"""
with recursive plan as (
  select loan_id, 0 as month, cast(0 as bigint) as interest, balance, rate_bp, payment from ({LOANS}) l
  union all select loan_id, month + 1, cast({DUE} as bigint), cast(balance + {DUE} - least(payment, balance + {DUE}) as bigint), rate_bp, payment from plan where month < 24 and balance > 0)
select loan_id, month, interest, balance from plan where month > 0""")
def forecast_loans(ledger):
    loans = ledger.sql(LOANS.replace("// 20", "div 20"))
    return O.loan_schedule(loans, 24)


def _scenarios(ledger):
    house = F.struct(F.lit("house").alias("kind"), F.col("balance").alias("value_minor"), F.lit(300).cast("long").alias("annual_rate_bp"), F.lit(None).cast("long").alias("monthly_payment_minor"))
    loan = F.struct(F.lit("loan").alias("kind"), F.col("balance").alias("value_minor"), F.col("rate_bp").alias("annual_rate_bp"), F.col("payment").alias("monthly_payment_minor"))
    loans = ledger.sql(LOANS.replace("// 20", "div 20"))
    return loans.select(F.col("loan_id").alias("scenario_id"), F.lit(100000).cast("long").alias("cash"), F.lit(500000).cast("long").alias("monthly_income"), F.array(F.struct(F.lit("groceries").alias("category"), F.lit(300000).cast("long").alias("amount"))).alias("spending"), F.lit(250).cast("long").alias("income_growth_bp"), F.lit(200).cast("long").alias("inflation_bp"), F.lit(36).alias("months"), F.array(house, loan).alias("assets"))


@query("forecast_project")
def forecast_project(ledger):
    return O.project(_scenarios(ledger))


@query("udtf_project")
def udtf_project(ledger):
    """The same through the table function, called laterally from SQL."""
    O.register_table_functions(ledger.spark)
    return ledger.spark.sql("select scenario_id, p.* from (select scenario_id, struct(*) as scenario from {scenarios}) s, lateral project(scenario) p", scenarios=O.spread(_scenarios(ledger)))


@query("agg_years")
def agg_years(ledger):
    return O.yearly(O.project(_scenarios(ledger)))


_STATE = "{{'status': {0}, 'closed_on': {1}, 'next_check_on': {2}, 'gap': {3}, 'opened_on': {4}}}"
_SAME = {"status": "s.status", "closed_on": "s.closed_on", "next_check_on": "s.next_check_on", "gap": "s.gap", "opened_on": "s.opened_on"}


def _changed(**values: str) -> str:
    return _STATE.format(*(_SAME | values).values())


_GAP = "cast(case when s.gap is null then 7 else least(182, 2 * s.gap) end as int)"
_MOVES = "event = 'still_have' or event in ('finished', 'thrown_out') or event = 'reopened' or (event = 'opened' and s.opened_on is null)"


_LOTS = f"""
with recursive listed as (select user_id as lot_id, row_number() over (partition by user_id order by event_id) as k, count(*) over (partition by user_id) as n, cast(ts as date) as day, ['still_have', 'still_have', 'opened', 'finished', 'undo', 'thrown_out', 'reopened'][event_id % 7 + 1] as event from events),
walk as (
  select lot_id, cast(0 as bigint) as k, n, {_STATE.format("'in_stock'", "cast(null as date)", "cast(null as date)", "cast(null as int)", "cast(null as date)")} as s, cast(null as struct(status varchar, closed_on date, next_check_on date, gap int, opened_on date)) as b from listed where k = 1
  union all
  select w.lot_id, w.k + 1, w.n,
    case when event = 'undo' then coalesce(b, s) when (s.status = 'in_stock') = (event = 'reopened') then s
      when event = 'still_have' then {_changed(next_check_on=f"day + {_GAP}", gap=_GAP)} when event in ('finished', 'thrown_out') then {_changed(status="event", closed_on="day", next_check_on="cast(null as date)")}
      when event = 'opened' and s.opened_on is null then {_changed(opened_on="day")} when event = 'reopened' then {_changed(status="'in_stock'", closed_on="cast(null as date)", gap="cast(null as int)", next_check_on="day + 7")} else s end,
    case when event = 'undo' then null when (s.status = 'in_stock') = (event = 'reopened') then b when {_MOVES} then s else b end
  from walk w join listed l on l.lot_id = w.lot_id and l.k = w.k + 1)
select lot_id, s.status as status, s.closed_on as closed_on, 0 as closed_precision, s.next_check_on as next_check_on, s.gap as interval, s.opened_on as opened_on from walk where k = n"""


def _lot_commands(events):
    kinds = F.array(*map(F.lit, ("still_have", "still_have", "opened", "finished", "undo", "thrown_out", "reopened")))
    return events.select(F.col("user_id").alias("lot_id"), F.col("event_id").alias("seq"), F.col("ts").cast("date").alias("day"), F.element_at(kinds, (F.col("event_id") % 7 + 1).cast("int")).alias("event"))


@query("op_lot_event", _LOTS)
def op_lot_event(ledger):
    return lots.fold(_lot_commands(ledger.table("events")))


def _streamed(ledger, parts, transform, sink, mode="append"):
    """Streams rows that arrive part by part through transform into sink (a batch, its number); each part is run to its end, from the checkpoint of the one before."""
    place, checkpoint = folder(ledger.spark, "arrivals"), folder(ledger.spark, "checkpoint")
    for part in parts:
        part.write.mode("append").parquet(place)
        writer = transform(ledger.spark.readStream.schema(part.schema).parquet(place)).writeStream.outputMode(mode).foreachBatch(sink)
        writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


@query("st_lot_state", _LOTS)
def st_lot_state(ledger):
    """The same by the stream with typed state, which is stopped half way and goes on from its checkpoint."""
    place, events = folder(ledger.spark, "lots"), ledger.table("events")
    half = events.agg(F.expr("max(event_id) div 2").alias("half"))
    parts = [events.join(F.broadcast(half), on).drop("half") for on in (F.col("event_id") <= F.col("half"), F.col("event_id") > F.col("half"))]
    _streamed(ledger, parts, lambda rows: lots.stream(_lot_commands(rows)), lambda batch, k: batch.withColumn("batch", F.lit(k)).write.mode("append").parquet(place), "update")
    last = ledger.spark.read.parquet(place).groupBy("lot_id").agg(F.max_by(F.struct(*lots.FIELDS), "batch").alias("s"))
    return last.select("lot_id", "s.*")


@query("st_idempotent", "select user_id as account_id, count(distinct event_type) as entries from events group by 1")
def st_idempotent(ledger):
    """The table arrives twice; what the import has is not added again."""
    target, events = folder(ledger.spark, "imports"), ledger.table("events")
    _streamed(ledger, [events, events], lambda rows: rows.select(F.col("user_id").alias("account_id"), F.sha2("event_type", 256).alias("fingerprint"), "event_type"), intake.import_batch(ledger.spark, target))
    return ledger.spark.read.parquet(target).groupBy("account_id").agg(F.count("*").alias("entries"))


CLOSURE = "select o_orderkey as child, o_orderkey // 2 as parent from orders where o_orderkey > 1"


@query("jn_closure", f"with recursive edges as ({CLOSURE}), reach as (select o_orderkey as id from orders where o_orderkey in (3, 10, 25) union select e.child from reach r join edges e on e.parent = r.id) select id from reach")
def jn_closure(ledger):
    roots = ledger.table("orders").where("o_orderkey in (3, 10, 25)").select(F.col("o_orderkey").alias("id"))
    return M.closure(roots, ledger.sql(CLOSURE.replace("//", "div")))


@query("st_late", "select user_id as file, arg_max(event_type, (ts, event_id)) as hash, count(*) as versions from events group by 1")
def st_late(ledger):
    rows = ledger.table("events").select(F.col("user_id").alias("file"), F.col("event_type").alias("hash"), F.struct("ts", "event_id").alias("captured"))
    return intake.current_version(rows)


@query("st_missing", "select distinct user_id as file from events where user_id not in (select user_id from events where event_id % 50 = 0)")
def st_missing(ledger):
    rows = ledger.table("events")
    known = rows.select(F.col("user_id").alias("file")).distinct()
    return intake.missing(known, rows.where("event_id % 50 = 0").select(F.col("user_id").alias("file")).distinct(), complete=True)


@query("st_dedup", "select event_type, user_id from events group by 1, 2")
def st_dedup(ledger):
    rows = ledger.table("events").select("event_type", "user_id", F.sha2(F.concat_ws("|", "event_type", "user_id"), 256).alias("hash"))
    return intake.first_of_content(rows).select("event_type", "user_id")


@query("st_series", "select cast(ts as date) as day, event_type, count(*) as n from events group by 1, 2")
def st_series(ledger):
    return intake.daily(ledger.table("events").withColumn("ts", F.col("ts").cast("timestamp")))
