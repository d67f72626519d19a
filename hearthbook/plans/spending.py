"""Registered queries over transactions, accounts, statements and budgets."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from hearthbook.functions import predicates as P
from hearthbook.functions.money import decimal_text, display_text
from hearthbook.operators import spending as S
from hearthbook.plans.registry import half_even_sql, percent_sql, query

FIRST, LAST = "1998-01-01", "1998-12-31"
COUNTED = "review_status <> 'rejected' and (origin <> 'extraction' or review_status = 'verified')"
WAITING = "origin = 'extraction' and review_status in ('proposed', 'needs_review')"
SPENT = "transaction_type in ('purchase', 'fee', 'interest', 'withdrawal')"
YEAR = f"posted_date between date '{FIRST}' and date '{LAST}'"
TOTALS = f"""cast(coalesce(sum(case when {SPENT} then -amount_minor end), 0) as bigint) as spending,
    cast(coalesce(sum(case when transaction_type = 'refund' then amount_minor end), 0) as bigint) as refunds, count(*) as transactions"""
NET = f"select *, spending - refunds as net from (select currency, {TOTALS} from transactions where {COUNTED} and ({SPENT} or transaction_type = 'refund') and {{period}} group by currency) s"
CATEGORY = f"select currency, coalesce(category, 'uncategorized') as category, cast(sum(-amount_minor) as bigint) as spending, count(*) as transactions from transactions where {COUNTED} and {SPENT} and {{period}} group by 1, 2"
KEY = "case when trim(regexp_replace(merchant, '\\s+', ' ', 'g')) = '' then 'UNKNOWN' else array_to_string(string_split(trim(regexp_replace(merchant, '\\s+', ' ', 'g')), ' ')[1:3], ' ') end"


def _year(ledger):
    return ledger.transactions.where(P.in_period(FIRST, LAST))


@query("spending_series", f"""
select m.month, c.currency, coalesce(spending, 0) as spending, coalesce(refunds, 0) as refunds, coalesce(transactions, 0) as transactions, coalesce(spending - refunds, 0) as net
from (select strftime(unnest(generate_series(date '1997-01-01', date '1999-12-01', interval 1 month)), '%Y-%m') as month) m
cross join (select distinct currency from transactions) c
left join (select substr(cast(posted_date as varchar), 1, 7) as month, currency, {TOTALS} from transactions where {COUNTED} and ({SPENT} or transaction_type = 'refund') and posted_date between date '1997-01-01' and date '1999-12-31' group by 1, 2) t
on t.month = m.month and t.currency = c.currency""", "transactions")
def spending_series(ledger):
    rows = ledger.transactions
    return S.series(rows, rows.select("currency").distinct(), "1997-01", "1999-12")


@query("get_spending", NET.format(period=YEAR), "transactions")
def get_spending(ledger):
    return S.totals(_year(ledger))


@query("agg_totals", f"select month, currency, spending, refunds, transactions, spending - refunds as net from (select substr(cast(posted_date as varchar), 1, 7) as month, currency, {TOTALS} from transactions where {COUNTED} and ({SPENT} or transaction_type = 'refund') group by 1, 2) s", "transactions")
def agg_totals(ledger):
    return S.totals(ledger.transactions.withColumn("month", S.month_of(F.col("posted_date"))), "month")


@query("agg_pending", f"select substr(cast(posted_date as varchar), 1, 7) as month, currency, cast(sum(-amount_minor) as bigint) as pending, count(*) as transactions from transactions where {WAITING} and {SPENT} group by 1, 2", "transactions")
def agg_pending(ledger):
    return S.pending_totals(ledger.transactions.withColumn("month", S.month_of(F.col("posted_date"))), "month")


@query("agg_coverage", f"select a.account_id, min(t.posted_date) as first_date, max(t.posted_date) as last_date, count(t.transaction_id) as transactions from accounts a left join transactions t on t.account_id = a.account_id and {COUNTED} group by a.account_id", "accounts", "transactions")
def agg_coverage(ledger):
    return S.coverage(ledger.accounts, ledger.transactions)


@query("agg_excluded", f"select count(*) as excluded from transactions where {COUNTED} and transaction_type in ('transfer', 'payment') and {YEAR}", "transactions")
def agg_excluded(ledger):
    return S.excluded(_year(ledger))


@query("net_by_currency", f"select currency, net from ({NET.format(period=YEAR)}) s", "transactions")
def net_by_currency(ledger):
    return S.totals(_year(ledger)).select("currency", "net")


@query("get_spending_by_category", CATEGORY.format(period=YEAR), "transactions")
def get_spending_by_category(ledger):
    return S.by_category(_year(ledger))


@query("agg_category", CATEGORY.format(period="true"), "transactions")
def agg_category(ledger):
    return S.by_category(ledger.transactions)


@query("agg_top_merchants", f"select * from (select {KEY} as merchant_key, currency, cast(sum(-amount_minor) as bigint) as spending, count(*) as transactions from transactions where {COUNTED} and {SPENT} group by 1, 2) s order by spending desc, merchant_key, currency limit 20", "transactions")
def agg_top_merchants(ledger):
    return S.top_merchants(ledger.transactions)


def _compared(keys: str, value: str, body: str) -> str:
    first, second = body.format(period="posted_date between date '1997-01-01' and date '1997-12-31'"), body.format(period=YEAR)
    on = " and ".join(f"a.{k} = b.{k}" for k in keys.split(", "))
    named = ", ".join(f"coalesce(a.{k}, b.{k}) as {k}" for k in keys.split(", "))
    both = f"select {named}, coalesce(a.{value}, 0) as \"first\", coalesce(b.{value}, 0) as \"second\" from ({first}) a full outer join ({second}) b on {on}"
    flip = "(case when \"first\" < 0 then -1 else 1 end)"
    return f"select {keys}, \"first\", \"second\", \"second\" - \"first\" as change, {percent_sql(f'(\"second\" - \"first\") * {flip}', f'\"first\" * {flip}')} as percent_change from ({both}) s"


@query("compare_periods", _compared("currency", "net", NET), "transactions")
def compare_periods(ledger):
    before = ledger.transactions.where(P.in_period("1997-01-01", "1997-12-31"))
    return S.compare(S.totals(before), S.totals(_year(ledger)), ["currency"], "net")


@query("compare_categories", _compared("currency, category", "spending", CATEGORY), "transactions")
def compare_categories(ledger):
    before = ledger.transactions.where(P.in_period("1997-01-01", "1997-12-31"))
    return S.compare(S.by_category(before), S.by_category(_year(ledger)), ["currency", "category"], "spending")


@query("calculate_cashflow", f"""
select coalesce(i.currency, o.currency) as currency, coalesce(inflow, 0) as inflow, coalesce(net, 0) as outflow, coalesce(inflow, 0) - coalesce(net, 0) as net
from (select currency, cast(sum(amount_minor) as bigint) as inflow from transactions where {COUNTED} and amount_minor > 0 and transaction_type in ('deposit', 'interest', 'other') and {YEAR} group by 1) i
full outer join ({NET.format(period=YEAR)}) o on o.currency = i.currency""", "transactions")
def calculate_cashflow(ledger):
    return S.cashflow(_year(ledger))


MONTH = "posted_date between date '1998-03-01' and date '1998-03-31'"


@query("get_budgets", f"""
select b.category, b.currency, b.amount_minor as budget, coalesce(spending, 0) as spent, b.amount_minor - coalesce(spending, 0) as remaining, coalesce(transactions, 0) as transactions,
  {percent_sql("coalesce(spending, 0)", "b.amount_minor")} as percent_used,
  case when coalesce(spending, 0) > b.amount_minor then 'over' when coalesce(spending, 0) * 31 > b.amount_minor * 20 then 'ahead_of_pace' else 'on_track' end as status
from budgets b left join ({CATEGORY.format(period=MONTH)}) s on s.category = b.category and s.currency = b.currency""", "budgets", "transactions")
def get_budgets(ledger):
    return S.budgets(ledger.budgets, ledger.transactions.where(P.in_period("1998-03-01", "1998-03-31")), 31, 20)


@query("agg_unbudgeted", f"""
select currency, cast(sum(spending) as bigint) as spent, cast(sum(transactions) as bigint) as transactions from ({CATEGORY.format(period=MONTH)}) s
where not exists (select 1 from budgets b where b.category = s.category and b.currency = s.currency) group by 1""", "budgets", "transactions")
def agg_unbudgeted(ledger):
    return S.unbudgeted(ledger.budgets, ledger.transactions.where(P.in_period("1998-03-01", "1998-03-31")))


@query("get_categories", """
select category, cast(sum(n) as bigint) as transactions from (select category, count(*) as n from transactions where category is not null group by 1 union all select category, 0 from budgets) s group by 1""", "transactions", "budgets")
def get_categories(ledger):
    return S.categories_in_use(ledger.transactions, ledger.budgets)


@query("agg_dashboard_groups", f"""
select category, spending, transactions, {percent_sql("spending", "whole")} as share from (
  select category, cast(sum(spending) as bigint) as spending, cast(sum(transactions) as bigint) as transactions, cast(sum(sum(spending)) over () as bigint) as whole from (
    select case when category = 'uncategorized' or row_number() over (partition by category <> 'uncategorized' order by spending desc, category) <= 5 then category else 'Other' end as category, spending, transactions
    from ({CATEGORY.format(period=YEAR)}) c where currency = 'USD') r group by 1) s""", "transactions")
def agg_dashboard_groups(ledger):
    return S.dashboard_groups(_year(ledger), "USD")


ANOMALY = f"""
select kind, currency, name, cast(sum(case when age = 0 then amount end) as bigint) as spent, cast(coalesce(sum(case when age > 0 then amount end), 0) as bigint) as before from (
  select k.kind, currency, case when k.kind = 'category' then coalesce(category, 'uncategorized') else {KEY} end as name, -amount_minor as amount, date_diff('day', posted_date, date '1998-03-31') // 31 as age
  from transactions cross join (select 'category' as kind union all select 'merchant') k where {COUNTED} and {SPENT} and posted_date between date '1998-03-01' - 93 and date '1998-03-31') e group by 1, 2, 3"""


@query("detect_spending_anomalies", f"""
select kind, name, currency, spent, {half_even_sql("before", "3")} as usual, {percent_sql("3 * spent - before", "before")} as percent_above_usual, before = 0 as "new"
from ({ANOMALY}) s where spent is not null and 3 * spent - before >= 60 * (case currency when 'JPY' then 1 else 100 end) and (before = 0 or 2 * spent > before)
order by 3 * spent - before desc, kind, currency, name limit 20""", "transactions")
def detect_spending_anomalies(ledger):
    return S.anomalies(ledger.transactions, "1998-03-01", "1998-03-31")


@query("agg_distinct_months", f"select currency, count(distinct substr(cast(posted_date as varchar), 1, 7)) as months from transactions where {COUNTED} group by 1", "transactions")
def agg_distinct_months(ledger):
    return ledger.transactions.where(P.countable()).groupBy("currency").agg(F.countDistinct(S.month_of(F.col("posted_date"))).alias("months"))


# rows of transactions -------------------------------------------------------

@query("get_transactions", f"""
select transaction_id, posted_date, description_raw, amount_minor, ({COUNTED}) as counted from transactions
where (({COUNTED}) or ({WAITING})) and {YEAR} and coalesce(category, 'uncategorized') in ('uncategorized', 'promo') and currency = 'USD'
order by posted_date desc, transaction_id desc limit 200 offset 40""", "transactions")
def get_transactions(ledger):
    kept = _year(ledger).where(P.with_status("counted", "pending")).where(S.category().isin("uncategorized", "promo") & (F.col("currency") == "USD"))
    page = kept.orderBy(F.desc("posted_date"), F.desc("transaction_id")).offset(40).limit(200)
    return page.select("transaction_id", "posted_date", "description_raw", "amount_minor", P.countable().alias("counted"))


for _name in ("spending", "inflow", "cashflow", "categories"):
    _inflow = "(amount_minor > 0 and transaction_type in ('deposit', 'interest', 'other'))"
    _where = {"spending": f"({SPENT} or transaction_type = 'refund')", "inflow": _inflow, "cashflow": f"({SPENT} or transaction_type = 'refund' or {_inflow})", "categories": SPENT}[_name]

    @query(f"flt_metric_{_name}", f"select transaction_type, currency, count(*) as transactions, cast(sum(amount_minor) as bigint) as total from transactions where {COUNTED} and {_where} group by 1, 2", "transactions")
    def _metric(ledger, name=_name):
        return ledger.transactions.where(P.countable() & P.metric(name)).groupBy("transaction_type", "currency").agg(F.count("*").alias("transactions"), F.sum("amount_minor").cast("bigint").alias("total"))


@query("flt_countable", f"select transaction_id from transactions where {COUNTED}", "transactions")
def flt_countable(ledger):
    return ledger.transactions.where(P.countable()).select("transaction_id")


@query("flt_pending", f"select transaction_id from transactions where {WAITING}", "transactions")
def flt_pending(ledger):
    return ledger.transactions.where(P.pending()).select("transaction_id")


@query("flt_status_union", f"select review_status, origin, count(*) as n from transactions where ({WAITING}) or review_status = 'rejected' group by 1, 2", "transactions")
def flt_status_union(ledger):
    return ledger.transactions.where(P.with_status("pending", "rejected")).groupBy("review_status", "origin").agg(F.count("*").alias("n"))


@query("flt_types", "select transaction_type, count(*) as n from transactions where transaction_type in ('fee', 'refund') group by 1", "transactions")
def flt_types(ledger):
    return ledger.transactions.where(F.col("transaction_type").isin("fee", "refund")).groupBy("transaction_type").agg(F.count("*").alias("n"))


@query("flt_words", "select transaction_id from transactions where list_contains(string_split(merchant, ' '), split_part((select min(merchant) from transactions), ' ', 1))", "transactions")
def flt_words(ledger):
    rows = ledger.transactions
    first = rows.agg(F.min("merchant").alias("m")).first()["m"] or ""
    return rows.where(P.has_words(F.col("merchant"), first.split(" ")[0])).select("transaction_id")


@query("srt_transactions", "select transaction_id, amount_minor from transactions order by abs(amount_minor) desc, transaction_id limit 100", "transactions")
def srt_transactions(ledger):
    return ledger.transactions.orderBy(F.abs("amount_minor").desc(), "transaction_id").limit(100).select("transaction_id", "amount_minor")


@query("lim_page", "select transaction_id, (select count(*) from transactions) as total from transactions order by posted_date, transaction_id limit 50 offset 100", "transactions")
def lim_page(ledger):
    rows = ledger.transactions
    page = rows.orderBy("posted_date", "transaction_id").offset(100).limit(50).select("transaction_id")
    return page.join(F.broadcast(rows.agg(F.count("*").alias("total"))))


@query("prj_money", """
select transaction_id, case when currency = 'JPY' then cast(amount_minor as varchar) else (case when amount_minor < 0 then '-' else '' end) || cast(abs(amount_minor) // 100 as varchar) || '.' || lpad(cast(abs(amount_minor) % 100 as varchar), 2, '0') end as decimal_text,
  case when currency = 'JPY' then format('{:,}', amount_minor) else (case when amount_minor < 0 then '-' else '' end) || format('{:,}', abs(amount_minor) // 100) || '.' || lpad(cast(abs(amount_minor) % 100 as varchar), 2, '0') end || ' ' || currency as display_text
from transactions""", "transactions")
def prj_money(ledger):
    minor, currency = F.col("amount_minor"), F.col("currency")
    return ledger.transactions.select("transaction_id", decimal_text(minor, currency).alias("decimal_text"), display_text(minor, currency).alias("display_text"))


@query("prj_counted_flag", f"select transaction_id, ({COUNTED}) as counted from transactions", "transactions")
def prj_counted_flag(ledger):
    return ledger.transactions.select("transaction_id", P.countable().alias("counted"))


# accounts and balances ------------------------------------------------------

@query("get_account_balance", """
select account_id, statement_id, period_end, closing_balance_minor from (
  select *, row_number() over (partition by account_id order by period_end desc, statement_id desc) as k from statements where review_status <> 'rejected') s where k = 1""", "statements")
def get_account_balance(ledger):
    kept = ledger.statements.where("review_status <> 'rejected'")
    return kept.groupBy("account_id").agg(F.max_by(F.struct("statement_id", "period_end", "closing_balance_minor"), F.struct("period_end", "statement_id")).alias("s")).select("account_id", "s.*")


@query("get_accounts", f"""
select a.account_id, a.display_name, a.account_type, a.currency, s.closing_balance_minor, coalesce(t.n, 0) as transactions from accounts a
left join (select *, row_number() over (partition by account_id order by period_end desc, statement_id desc) as k from statements where review_status <> 'rejected') s on s.account_id = a.account_id and s.k = 1
left join (select account_id, count(*) as n from transactions where {COUNTED} group by 1) t on t.account_id = a.account_id""", "accounts", "statements", "transactions")
def get_accounts(ledger):
    counts = S.coverage(ledger.accounts, ledger.transactions).select("account_id", "transactions")
    balances = get_account_balance(ledger).select("account_id", "closing_balance_minor")
    base = ledger.accounts.select("account_id", "display_name", "account_type", "currency")
    return base.join(balances, "account_id", "left").join(counts, "account_id").select("account_id", "display_name", "account_type", "currency", "closing_balance_minor", "transactions")


@query("jn_latest_asof", """
select account_id, statement_id from (select *, row_number() over (partition by account_id order by period_end desc, statement_id desc) as k from statements where review_status <> 'rejected' and period_end <= date '2000-03-01') s where k = 1""", "statements")
def jn_latest_asof(ledger):
    kept = ledger.statements.where("review_status <> 'rejected' and period_end <= date '2000-03-01'")
    place = F.row_number().over(W.partitionBy("account_id").orderBy(F.desc("period_end"), F.desc("statement_id")))
    return kept.withColumn("k", place).where("k = 1").select("account_id", "statement_id")
