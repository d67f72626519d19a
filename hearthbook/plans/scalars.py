"""Registered queries of the scalar functions, over the driver's columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from hearthbook.functions import checks as C
from hearthbook.functions import dates as D
from hearthbook.functions import text as T
from hearthbook.functions.money import currency_code, decimal_text, to_minor
from hearthbook.functions.ratio import percent, round_half_even
from hearthbook.functions.sizes import parse_size, product_name, quantity
from hearthbook.plans.registry import half_even_sql, percent_sql, query

SQUEEZED = "trim(regexp_replace({c}, '\\s+', ' ', 'g'))"
NORMAL = SQUEEZED.format(c="regexp_replace(regexp_replace(upper({c}), '#\\s*\\d+|\\b\\d+\\b|[^\\w\\s&]', ' ', 'g'), '\\b(INC|LLC|LTD|CO|CORP|CORPORATION|COMPANY)\\b', ' ', 'g')")


@query("fn_normalize_name", f"select c_custkey, {NORMAL.replace('{c}', 'c_name')} as name from customer")
def fn_normalize_name(ledger):
    return ledger.table("customer").select("c_custkey", T.normalize_name(F.col("c_name"), ascii_only=True).alias("name"))


@query("fn_name_tokens", "select merchant_id, array_to_string(list_sort(list_distinct(list_filter(string_split(canonical_name, ' '), lambda t: length(t) > 2))), ' ') as tokens from merchants", "merchants")
def fn_name_tokens(ledger):
    return ledger.merchants.select("merchant_id", F.concat_ws(" ", F.sort_array(T.name_tokens(F.col("canonical_name"), True))).alias("tokens"))


@query("fn_category_name", f"select p_partkey, lower({SQUEEZED.format(c='p_type')}) as category from part")
def fn_category_name(ledger):
    return ledger.table("part").select("p_partkey", T.category_name(F.col("p_type")).alias("category"))


@query("fn_classify", """
select event_id, case when event_type = 'click' and event_id % 3 = 0 then 'transfer' when amount > 0 then case when account_type = 'credit_card' then 'refund' else 'deposit' end when amount < 0 then 'purchase' else 'other' end as transaction_type from (
  select event_id, event_type, cast(floor(value) as int) - 20 as amount, case when user_id % 2 = 0 then 'credit_card' else 'checking' end as account_type from events) e""")
def fn_classify(ledger):
    rows = ledger.table("events").withColumn("amount", F.floor("value").cast("int") - 20).withColumn("account_type", F.when(F.col("user_id") % 2 == 0, "credit_card").otherwise("checking"))
    line = F.concat(F.col("event_type"), F.when((F.col("event_type") == "click") & (F.col("event_id") % 3 == 0), " xfer to 17").otherwise(" shop"))
    return rows.select("event_id", T.classify(line, F.col("amount"), F.col("account_type"), ascii_only=True).alias("transaction_type"))


@query("fn_to_minor", "select l_orderkey, l_linenumber, l_partkey, l_suppkey, -cast(round(l_extendedprice * 100) as bigint) as minor from lineitem")
def fn_to_minor(ledger):
    rows = ledger.table("lineitem").withColumn("minor", F.round(F.col("l_extendedprice") * 100).cast("bigint"))
    printed = F.concat(F.lit("("), F.regexp_replace(decimal_text(F.col("minor"), F.lit("USD")), r"(?<=\d)(?=(\d{3})+\.)", ","), F.lit(" usd)"))
    return rows.withColumn("printed", printed).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", to_minor(F.col("printed"), F.lit("USD"))["minor"].alias("minor"))


@query("fn_currency_code", "select distinct currency from accounts", "accounts")
def fn_currency_code(ledger):
    return ledger.accounts.select(currency_code(F.concat(F.lit(" "), F.lower("currency"))).alias("currency")).distinct()


@query("fn_percent", f"select o_orderkey, {percent_sql('o_custkey', 'o_orderkey % 97')} as percent_text from orders")
def fn_percent(ledger):
    return ledger.table("orders").select("o_orderkey", percent(F.col("o_custkey"), F.col("o_orderkey") % 97).alias("percent_text"))


@query("fn_round_half_even", f"select o_orderkey, {half_even_sql('o_orderkey - 5000', '8')} as rounded from orders")
def fn_round_half_even(ledger):
    return ledger.table("orders").select("o_orderkey", round_half_even(F.col("o_orderkey") - 5000, F.lit(8)).alias("rounded"))


@query("fn_month_index", "select o_orderkey, cast(year(o_orderdate) * 12 + month(o_orderdate) - 1 as int) as month_index, strftime(o_orderdate, '%Y-%m') as month, last_day(cast(o_orderdate as date)) as month_end from orders")
def fn_month_index(ledger):
    rows = ledger.table("orders").withColumn("d", F.col("o_orderdate").cast("date")).withColumn("month_index", D.month_index(F.col("d")))
    return rows.select("o_orderkey", "month_index", D.month_label(F.col("month_index")).alias("month"), F.last_day("d").alias("month_end"))


@query("fn_add_months", "select o_orderkey, cast(cast(o_orderdate as date) + interval 1 month as date) as next_month, cast(cast(o_orderdate as date) + interval 12 month as date) as next_year, abs(cast(o_orderdate as date) - date '1998-01-01') as gap from orders")
def fn_add_months(ledger):
    d = F.col("o_orderdate").cast("date")
    return ledger.table("orders").select("o_orderkey", F.add_months(d, 1).alias("next_month"), F.add_months(d, 12).alias("next_year"), F.abs(F.datediff(d, F.lit("1998-01-01").cast("date"))).cast("bigint").alias("gap"))


@query("fn_checkin_day", "select o_orderkey, cast(o_orderdate as date) - cast(((isodow(o_orderdate) - 1 - 2) % 7 + 7) % 7 as int) as day from orders")
def fn_checkin_day(ledger):
    return ledger.table("orders").select("o_orderkey", D.checkin_day(F.col("o_orderdate").cast("date"), 2).alias("day"))


@query("fn_effective_day", """
select o_orderkey, case o_orderkey % 4 when 0 then d when 1 then d - 1 when 2 then d - 3 else d - cast(((isodow(d) - 1 - o_orderkey % 7) % 7 + 7) % 7 as int) end as day from (select o_orderkey, cast(o_orderdate as date) as d from orders) o""")
def fn_effective_day(ledger):
    kind = F.element_at(F.array(*map(F.lit, ("today", "yesterday", "this_week", "weekday"))), (F.col("o_orderkey") % 4 + 1).cast("int"))
    return ledger.table("orders").select("o_orderkey", D.effective_day(kind, F.col("o_orderdate").cast("date"), F.col("o_orderkey") % 7, F.lit(None).cast("date")).alias("day"))


@query("src_parse_date", "select o_orderkey, cast(o_orderdate as date) as iso, cast(o_orderdate as date) as mdy, case when day(o_orderdate) <= 12 then make_date(year(o_orderdate), day(o_orderdate), month(o_orderdate)) end as dmy from orders")
def src_parse_date(ledger):
    d = F.col("o_orderdate").cast("date")
    slashed = F.date_format(d, "M/d/yyyy")
    return ledger.table("orders").select("o_orderkey", D.parse_date(F.date_format(d, "yyyy-M-d"), "MDY").alias("iso"), D.parse_date(slashed, "MDY").alias("mdy"), D.parse_date(slashed, "DMY").alias("dmy"))


@query("src_date_order", "select o_custkey, case when max(month(o_orderdate)) > 12 and max(day(o_orderdate)) <= 12 then 'DMY' when max(day(o_orderdate)) > 12 and max(month(o_orderdate)) <= 12 then 'MDY' else 'ask' end as date_order from orders group by 1")
def src_date_order(ledger):
    from hearthbook.sources.tabular import date_order

    rows = ledger.table("orders").select("o_custkey", F.date_format("o_orderdate", "M/d/yyyy").alias("value"))
    return rows.groupBy("o_custkey").agg(date_order(F.col("value")).alias("date_order"))


@query("fn_gtin", """
select p_partkey, (select sum(cast(substr(code, 13 - i, 1) as int) * case when i % 2 = 1 then 3 else 1 end) from range(0, 13) r(i)) % 10 = 0 as valid from (select p_partkey, lpad(cast(p_partkey * 7919 as varchar), 13, '4') as code from part) p""")
def fn_gtin(ledger):
    return ledger.table("part").select("p_partkey", C.valid_gtin(F.lpad((F.col("p_partkey") * 7919).cast("string"), 13, "4")).alias("valid"))


@query("fn_figures", "select conv_id, turn, array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all(text, '\\d{1,3}(?:,\\d{3})+(?:\\.\\d+)?|\\d+(?:\\.\\d+)?|\\.\\d+'), lambda n: replace(n, ',', '')))), ' ') as figures from questions", "questions")
def fn_figures(ledger):
    return ledger.questions.select("conv_id", "turn", F.concat_ws(" ", F.sort_array(C.figures(F.col("text")))).alias("figures"))


@query("fn_route", "select conv_id, turn, case when regexp_matches(text, '(?i)\\b(items?|products?|inventory|stock|pantry|warrant\\w*|returns?|expir\\w*|price per|unit price|run out|consum\\w*)\\b') then 'items' else 'finance' end as route from questions", "questions")
def fn_route(ledger):
    return ledger.questions.select("conv_id", "turn", C.route(F.col("text")).alias("route"))


@query("fn_printed_returns", "select p_partkey, case when p_size % 3 = 0 then p_size when p_size % 3 = 1 then 0 end as days from part")
def fn_printed_returns(ledger):
    line = F.when(F.col("p_size") % 3 == 0, F.concat(F.lit("Returns accepted within "), F.col("p_size"), F.lit(" days"))).when(F.col("p_size") % 3 == 1, "ALL SALES FINAL").otherwise("Thank you")
    return ledger.table("part").select("p_partkey", C.printed_return_days(F.array(F.lit("Total 4.00"), line)).alias("days"))


@query("fn_warranty_months", "select p_partkey, case p_size % 3 when 0 then cast(p_size * 12 as varchar) when 1 then cast(p_size as varchar) else '24' end as months from part where p_size > 0")
def fn_warranty_months(ledger):
    quote = F.when(F.col("p_size") % 3 == 0, F.concat(F.lit("a "), F.col("p_size"), F.lit("-year limited warranty"))).when(F.col("p_size") % 3 == 1, F.concat(F.lit("within "), F.col("p_size"), F.lit(" months"))).otherwise("for Two years or 730 days")
    return ledger.table("part").where("p_size > 0").select("p_partkey", F.concat_ws(" ", C.warranty_months(quote)).alias("months"))


@query("fn_expiry", "select o_orderkey, cast(cast(o_orderdate as date) + to_months(cast(o_orderkey % 30 as int)) as date) as expires_on from orders")
def fn_expiry(ledger):
    return ledger.table("orders").select("o_orderkey", F.add_months(F.col("o_orderdate").cast("date"), (F.col("o_orderkey") % 30).cast("int")).alias("expires_on"))


@query("fn_parse_size", "select p_partkey, case when p_size % 2 = 0 then 'mass' else 'volume' end as dimension, cast(p_size as hugeint) * 1000 * case when p_size % 2 = 0 then 283495231250 else 6 * 295735295625 end = base as matches from (select *, cast(p_size as hugeint) * 1000 * case when p_size % 2 = 0 then 283495231250 else 6 * 295735295625 end as base from part) p")
def fn_parse_size(ledger):
    text = F.when(F.col("p_size") % 2 == 0, F.concat("p_size", F.lit(" OZ"))).otherwise(F.concat(F.lit("6 x "), F.col("p_size"), F.lit(" fl. oz")))
    rows = ledger.table("part").withColumn("s", parse_size(text))
    right = F.col("p_size").cast("decimal(38,0)") * 1000 * F.when(F.col("p_size") % 2 == 0, F.lit(283495231250)).otherwise(F.lit(6 * 295735295625))
    return rows.select("p_partkey", F.col("s.dimension").alias("dimension"), (F.col("s.base") == right).alias("matches"))


@query("fn_quantity", "select lot_id, cast(coalesce(cast(units as bigint), 1) * 1000 as bigint) as milli, units is null as assumed from lots", "lots")
def fn_quantity(ledger):
    q = quantity(F.col("units"))
    return ledger.lots.select("lot_id", q["milli"].cast("bigint").alias("milli"), q["assumed"].alias("assumed"))


@query("fn_product_name", "select distinct product_id, concat_ws(' ', nullif(brand, ''), name, size_text) as product from lots", "lots")
def fn_product_name(ledger):
    return ledger.lots.select("product_id", product_name(F.col("brand"), F.col("name"), F.col("size_text")).alias("product")).distinct()


@query("fn_extension", "select doc_id, lower(regexp_extract(relative_path, '(\\.[^./]+)$', 1)) as extension from files", "files")
def fn_extension(ledger):
    return ledger.files.select("doc_id", C.extension(F.col("relative_path")).alias("extension"))


@query("fn_normalize_text", "select p_partkey, trim(regexp_replace(upper(p_brand || '-' || p_name), '[^A-Z0-9&]+', ' ', 'g')) as name from part")
def fn_normalize_text(ledger):
    from hearthbook.operators.items import normalize_text

    return ledger.table("part").select("p_partkey", normalize_text(F.concat_ws("-", "p_brand", "p_name")).alias("name"))
