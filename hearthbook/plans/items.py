"""Registered queries over purchased items."""

from __future__ import annotations

from pyspark.sql import functions as F

from hearthbook.operators import items as I
from hearthbook.plans.registry import half_even_sql, percent_sql, query

#: The sizes of the lots view, whose texts have four shapes.
AMOUNT = "cast(round(cast(regexp_extract(size_text, '(\\d+(?:\\.\\d+)?)\\s*(?:fl oz|oz|ct|kg)$', 1) as decimal(18, 3)) * 1000) as hugeint)"
PRICED = f"""select *, (cast(cost_minor as hugeint) * standard * 10000000000000000 * 1000000) // (milli * base) as price from (
  select *, case when units is null then 1000 else cast(units as hugeint) * 1000 end as milli, case dimension when 'count' then 1 else 100 end as standard,
    case when size_text like '6 x %' then 6 * {AMOUNT} * 295735295625 when size_text like '%oz' then {AMOUNT} * 283495231250 when size_text like '%ct' then {AMOUNT} * 10000000000 else {AMOUNT} * 10000000000000 end as base from (
    select *, case when size_text like '%fl oz' then 'volume' when size_text like '%oz' or size_text like '%kg' then 'mass' when size_text like '%ct' then 'count' end as dimension from lots) d
  where dimension is not null) s"""
LABEL = "case dimension when 'count' then 'per item' when 'volume' then 'per 100 ml' else 'per 100 g' end"
SHOWN = lambda c: f"cast({half_even_sql(c, '1000000')} as bigint)"
NAME = "concat_ws(' ', nullif(brand, ''), name, size_text)"
RATES = "select product_id, currency, cast(sum(cost_minor) as bigint) as cost, cast(sum(greatest(1, closed_on - bought_on)) as bigint) as days, count(*) as lots from lots where status = 'finished' and closed_on is not null group by 1, 2"


@query("get_item_spending", "select currency, cast(sum(cost_minor) as bigint) as spent, count(*) as purchases from lots where bought_on between date '1998-01-01' and date '1998-12-31' group by 1", "lots")
def get_item_spending(ledger):
    return I.item_spending(I.matching(ledger.lots).where("bought_on between date '1998-01-01' and date '1998-12-31'"))


@query("lim_topk", f"select currency, {NAME} as product, cast(sum(cost_minor) as bigint) as spent, count(*) as purchases from lots group by 1, 2 order by spent desc, currency, product limit 15", "lots")
def lim_topk(ledger):
    return I.top_products(I.matching(ledger.lots))


@query("flt_like_words", "select count(*) as lots from lots where (contains(upper(name), 'RED') or contains(upper(coalesce(brand, '')), 'RED') or contains(upper(category), 'RED')) and (contains(upper(name), 'BRAND') or contains(upper(coalesce(brand, '')), 'BRAND') or contains(upper(category), 'BRAND'))", "lots")
def flt_like_words(ledger):
    return I.matching(ledger.lots, "red-brand #").agg(F.count("*").alias("lots"))


@query("item_price_history", f"""
select h.lot_id, h.bought_on, h.merchant, h.cost_minor, {SHOWN("p.price")} as unit_minor, case when p.price is not null then {LABEL.replace("dimension", "p.dimension")} end as per
from (select * from lots order by bought_on desc, lot_id desc limit 100) h left join ({PRICED}) p on p.lot_id = h.lot_id""", "lots")
def item_price_history(ledger):
    return I.price_history(I.matching(ledger.lots))


@query("get_price_changes", f"""
select product, brand, currency, {LABEL} as per, {SHOWN("a.price")} as first_minor, {SHOWN("b.price")} as last_minor, {percent_sql("b.price - a.price", "a.price")} as percent_change, upper(replace(a.size_text, '.', ' ')) <> upper(replace(b.size_text, '.', ' ')) as size_changed from (
  select upper(name) as product, brand, currency, dimension, count(*) as n, arg_min({{'price': price, 'size_text': size_text}}, (bought_on, lot_id)) as a, arg_max({{'price': price, 'size_text': size_text}}, (bought_on, lot_id)) as b from ({PRICED}) x group by 1, 2, 3, 4) g
where n >= 2 and b.price > a.price order by {half_even_sql("(b.price - a.price) * 1000", "a.price")} desc, product, brand nulls first, currency, dimension limit 20""", "lots")
def get_price_changes(ledger):
    return I.price_changes(I.matching(ledger.lots))


@query("compare_merchant_prices", f"""
select merchant, currency, {LABEL} as per, {SHOWN("l.price")} as unit_minor, l.bought_on as bought_on, l.cost_minor as cost_minor from (
  select merchant, currency, dimension, arg_max({{'price': price, 'bought_on': bought_on, 'cost_minor': cost_minor}}, (bought_on, lot_id)) as l from ({PRICED}) x group by 1, 2, 3) g""", "lots")
def compare_merchant_prices(ledger):
    return I.merchant_prices(I.matching(ledger.lots))


@query("agg_rates", RATES, "lots")
def agg_rates(ledger):
    return I.rates(I.matching(ledger.lots))


@query("get_consumption_cost", f"select product_id, currency, {half_even_sql('cost', 'days')} as per_day, {half_even_sql('30 * cost', 'days')} as per_30_days, lots, lots < 3 as approximate from ({RATES}) r", "lots")
def get_consumption_cost(ledger):
    return I.consumption_cost(I.matching(ledger.lots))


@query("get_waste", "select currency, cast(sum(cost_minor) as bigint) as wasted, count(*) as items from lots where status = 'thrown_out' and closed_on between date '1998-01-01' and date '1998-12-31' group by 1", "lots")
def get_waste(ledger):
    return I.waste(I.matching(ledger.lots), "1998-01-01", "1998-12-31")


@query("forecast_consumables_spend", f"select product_id, currency, {half_even_sql('31 * cost', 'days')} as projected, lots from ({RATES}) r where lots >= 2", "lots")
def forecast_consumables_spend(ledger):
    return I.forecast_consumables(I.matching(ledger.lots), 31)


@query("agg_median_days", """
select product_id, category, case when finished >= 2 then greatest(1, cast(round_even(m, 0) as int)) else 28 end as days from (
  select product_id, category, median(case when status = 'finished' then closed_on - bought_on end) as m, count(case when status = 'finished' then closed_on end) as finished from lots group by 1, 2) s""", "lots")
def agg_median_days(ledger):
    return I.usual_days(ledger.lots)


@query("get_inventory", """
select lot_id, product_id, bought_on, status from lots where status = 'in_stock' and (contains(upper(name), 'RED') or contains(upper(coalesce(brand, '')), 'RED') or contains(upper(category), 'RED'))
  and (contains(upper(name), '1') or contains(upper(coalesce(brand, '')), '1') or contains(upper(category), '1')) order by name, bought_on, lot_id limit 200""", "lots")
def get_inventory(ledger):
    from hearthbook.plans import tools

    return tools.call(ledger, "get_inventory", query="Red/#1").select("lot_id", "product_id", "bought_on", "status")


POLICIES = "select min(n_nationkey) as policy_id, upper(n_name) as pattern, cast(case when min(n_nationkey) % 4 = 0 then null else 30 + min(n_nationkey) end as int) as days from nation where n_nationkey % 3 <> 0 group by upper(n_name)"
RETURNS = f"""select lot_id, l.merchant, bought_on, case when p.days is not null then bought_on + p.days end as return_by, coalesce(p.policy_id is not null and (p.days is null or bought_on + p.days >= date '2000-06-30'), false) as returnable
from lots l left join ({POLICIES}) p on p.pattern = l.merchant where status = 'in_stock'"""


def _policies(ledger):
    return ledger.sql(POLICIES)


@query("jn_policy", RETURNS, "lots")
def jn_policy(ledger):
    return I.returnable(ledger.lots, _policies(ledger), "2000-06-30")


@query("returns_closing", f"select lot_id, return_by from ({RETURNS}) r where return_by between date '2000-06-30' and date '2000-07-14'", "lots")
def returns_closing(ledger):
    return I.returns_closing(ledger.lots, _policies(ledger), "2000-06-30")


@query("checkin", """
select lot_id, product_id, next_check_on, waiting from (
  select *, count(*) over () as waiting from (select lot_id, product_id, bought_on + 28 as next_check_on from lots where status = 'in_stock' and bought_on + 28 <= date '2000-06-30') d) s
order by next_check_on, lot_id limit 15""", "lots")
def checkin(ledger):
    due = ledger.lots.where("status = 'in_stock'").withColumn("next_check_on", F.date_add("bought_on", 28)).where("next_check_on <= date '2000-06-30'")
    first = due.orderBy("next_check_on", "lot_id").limit(15).select("lot_id", "product_id", "next_check_on")
    return first.join(F.broadcast(due.agg(F.count("*").alias("waiting"))))
