"""Registered queries of warranties, assets, runs, filing and small set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from hearthbook.functions.sizes import parse_size, quantity, unit_price_micro
from hearthbook.operators import items as I
from hearthbook.operators import upkeep as U
from hearthbook.plans import tools
from hearthbook.plans.items import PRICED
from hearthbook.plans.registry import query
from hearthbook.plans.tables import RUNS, _runs

COVERED = "select lot_id as warranty_id, bought_on, case when product_id % 5 = 0 then null else cast(product_id % 36 as int) end as months, status from lots"


def _warranties(ledger):
    months = F.when(F.col("product_id") % 5 != 0, (F.col("product_id") % 36).cast("int"))
    return ledger.lots.select(F.col("lot_id").alias("warranty_id"), "bought_on", months.alias("months"), "status")


@query("warranties_list", f"select warranty_id, cast(bought_on + to_months(months) as date) as expires_on from ({COVERED}) w order by expires_on nulls last, warranty_id", "lots")
def warranties_list(ledger):
    return U.warranties(_warranties(ledger)).select("warranty_id", "expires_on")


@query("warranties_expiring", f"select warranty_id, cast(bought_on + to_months(months) as date) as expires_on from ({COVERED}) w where status = 'in_stock' and cast(bought_on + to_months(months) as date) between date '2000-06-30' and date '2000-08-29'", "lots")
def warranties_expiring(ledger):
    return U.expiring(_warranties(ledger), "2000-06-30").select("warranty_id", "expires_on")


@query("srt_nulls_last", f"select warranty_id from ({COVERED}) w order by months nulls last, warranty_id", "lots")
def srt_nulls_last(ledger):
    return _warranties(ledger).orderBy(F.asc_nulls_last("months"), "warranty_id").select("warranty_id")


@query("assets_list", "select account_id, account_type from accounts where account_id % 6 > 0 order by account_type = 'loan', display_name, account_id", "accounts")
def assets_list(ledger):
    rows = ledger.accounts.select(F.col("account_id").alias("asset_id"), F.col("account_type").alias("kind"), F.col("display_name").alias("name"), F.when(F.col("account_id") % 6 == 0, "gone").alias("archived_at"))
    return U.assets(rows).select(F.col("asset_id").alias("account_id"), F.col("kind").alias("account_type"))


@query("fn_warranty_suggested", "select lot_id, not consumable and cost_minor >= 100 * (case currency when 'JPY' then 1 else 100 end) as suggested from lots", "lots")
def fn_warranty_suggested(ledger):
    places = F.when(F.col("currency") == "JPY", 0).otherwise(2)
    return ledger.lots.select("lot_id", U.warranty_suggested(F.col("consumable"), F.col("cost_minor"), places).alias("suggested"))


KINDS = ("receipt", "bank_statement", "credit_card_statement", "bill", "income", "investment_statement", "loan_document", "insurance_document", "housing_document", "tax_document", "letter")
NAMED = ("Receipts", "Bank_Statements", "Credit_Card_Statements", "Bills", "Income", "Investments", "Loans", "Insurance", "Housing", "Taxes")


@query("fn_filing", f"""
select bill_id, case when folder is null or merchant is null or day is null then 'Unfiled/Document__' || tail
  else folder || strftime(day, '/%Y/%m/%Y-%m-%d__') || trim(regexp_replace(merchant, '[^A-Z]+', '_', 'g'), '_') || '__' || folder || '__' || tail end as path from (
  select bill_id, list_extract({list(NAMED)}, cast(bill_id % 11 as int) + 1) as folder, case when bill_id % 5 > 0 then trim(provider) end as merchant,
    case when bill_id % 7 > 0 then due_date end as day, substr(sha256(cast(bill_id as varchar)), 1, 16) || '__d' || cast(bill_id as varchar) || '.pdf' as tail from bills) b""", "bills")
def fn_filing(ledger):
    kind = F.element_at(F.array(*map(F.lit, KINDS)), (F.col("bill_id") % 11 + 1).cast("int"))
    merchant, day = F.when(F.col("bill_id") % 5 > 0, F.concat("provider", F.lit(" #7"))), F.when(F.col("bill_id") % 7 > 0, F.col("due_date"))
    digest = F.sha2(F.col("bill_id").cast("string"), 256)
    return ledger.bills.select("bill_id", U.filing_path(kind, day, merchant, F.col("bill_id"), digest, F.lit(".PDF")).alias("path"))


#: A word of each class after one that names none, a class that comes later, other tags, and none.
TAGS = [("en:dairies en:milk-drinks", "dairy & eggs"), ("en:fruits", "produce"), ("en:seafood", "meat & seafood"), ("en:breads en:frozen", "bakery"), ("en:frozen-desserts", "frozen"), ("en:cookies en:tea", "snacks"), ("en:juices", "beverages"), ("en:tools", "pantry"), ("", "other")]


@query("fn_barcode_category", "select p_partkey, case p_size % 9 " + " ".join(f"when {k} then '{category}'" for k, (_, category) in enumerate(TAGS)) + " end as category from part")
def fn_barcode_category(ledger):
    tags = F.element_at(F.array(*(F.lit(t) for t, _ in TAGS)), (F.col("p_size") % 9 + 1).cast("int"))
    return ledger.table("part").select("p_partkey", U.word_category(tags).alias("category"))


@query("run_reuse", f"select kind, id, status from (select *, row_number() over (partition by kind order by status = 'succeeded', created_at desc, id desc) as k from ({RUNS}) r where status in ('queued', 'running', 'succeeded') and kind in ('click', 'view')) s where k = 1")
def run_reuse(ledger):
    runs = None
    for kind in ("click", "view"):
        part = _runs(ledger, kind).withColumn("kind", F.lit(kind))
        runs = part if runs is None else runs.unionByName(part)
    return U.reuse(runs, ["kind"]).select("kind", "id", "status")


@query("telemetry_derive", "select event_id, case event_id % 3 when 0 then 'server' when 1 then 'usage' else 'estimate' end as source, cast(case event_id % 3 when 0 then user_id when 1 then user_id + 1 else (user_id * 4) // 4 end as bigint) as tokens from events")
def telemetry_derive(ledger):
    server, usage = F.when(F.col("event_id") % 3 == 0, F.col("user_id")), F.when(F.col("event_id") % 3 == 1, F.col("user_id") + 1)
    got = U.tokens_per_second(server.cast("double"), usage.cast("double"), F.col("user_id") * 4, F.lit(1.0))
    return ledger.table("events").select("event_id", got["source"].alias("source"), got["rate"].cast("bigint").alias("tokens"))


@query("reading_status", "select doc_id, case when doc_id % 3 = 0 or n_chars = 0 then 'partial' else 'succeeded' end as status from documents")
def reading_status(ledger):
    issues = F.when(F.col("doc_id") % 3 == 0, F.array(F.lit("low_contrast"), F.lit("truncated"))).otherwise(F.array(F.lit("low_contrast")))
    return ledger.table("documents").select("doc_id", U.reading_status(issues, F.when(F.col("n_chars") > 0, F.lit("x"))).alias("status"))


@query("batch_select", "select count(*) as total, cast(sum(case when trashed = 0 and quality is not null then 1 else 0 end) as bigint) as readable, cast(sum(case when trashed = 0 and quality is not null then 0 else 1 end) as bigint) as skipped from files", "files")
def batch_select(ledger):
    files = ledger.files
    readable = F.coalesce((F.col("trashed") == 0) & F.col("quality").isNotNull(), F.lit(False)).cast("int")
    return files.agg(F.count("*").alias("total"), F.sum(readable).alias("readable"), F.sum(1 - readable).alias("skipped"))


@query("agg_blob_bytes", "select source, cast(sum(n_chars) as bigint) as stored from documents group by 1")
def agg_blob_bytes(ledger):
    return ledger.table("documents").groupBy("source").agg(F.sum("n_chars").cast("bigint").alias("stored"))


@query("agg_having_bool", "select receipt_id, cast(sum(case when review_status = 'proposed' then 1 else 0 end) as bigint) as unresolved from receipt_links group by 1 having sum(case when review_status = 'proposed' then 1 else 0 end) > 0", "receipt_links")
def agg_having_bool(ledger):
    return ledger.receipt_links.groupBy("receipt_id").agg(F.sum((F.col("review_status") == "proposed").cast("int")).alias("unresolved")).where("unresolved > 0")


@query("lim_tail", "select posting_id, posted_date from (select posting_id, posted_date from postings order by posted_date desc, posting_id desc limit 100) t", "postings")
def lim_tail(ledger):
    last = ledger.postings.orderBy(F.desc("posted_date"), F.desc("posting_id")).limit(100)
    return last.orderBy("posted_date", "posting_id").select("posting_id", "posted_date")


@query("win_first_last", "select product_id, arg_min(cost_minor, (bought_on, lot_id)) as first_cost, arg_max(cost_minor, (bought_on, lot_id)) as last_cost from lots group by 1", "lots")
def win_first_last(ledger):
    when = F.struct("bought_on", "lot_id")
    return ledger.lots.groupBy("product_id").agg(F.min_by("cost_minor", when).alias("first_cost"), F.max_by("cost_minor", when).alias("last_cost"))


@query("win_topk", "select category, product_id, spent from (select category, product_id, cast(sum(cost_minor) as bigint) as spent, row_number() over (partition by category order by sum(cost_minor) desc, product_id) as k from lots group by 1, 2) s where k <= 5", "lots")
def win_topk(ledger):
    from pyspark.sql import Window as W

    sums = ledger.lots.groupBy("category", "product_id").agg(F.sum("cost_minor").cast("bigint").alias("spent"))
    place = F.row_number().over(W.partitionBy("category").orderBy(F.desc("spent"), "product_id"))
    return sums.withColumn("k", place).where("k <= 5").drop("k")


@query("fn_unit_price", f"select lot_id, cast(price // 1000000 as bigint) as whole from ({PRICED}) p", "lots")
def fn_unit_price(ledger):
    sized = ledger.lots.withColumn("s", parse_size(F.col("size_text"))).where("s is not null")
    price = unit_price_micro(F.col("cost_minor"), F.col("s"), quantity(F.col("units"))["milli"])
    return sized.select("lot_id", ((price - F.pmod(price, F.lit(1000000).cast("decimal(38,0)"))) / 1000000).cast("bigint").alias("whole"))


@query("set_intersect", "select p_partkey, len(list_intersect(string_split(p_name, ' '), string_split(lower(p_type || ' red blue'), ' '))) as shared from part")
def set_intersect(ledger):
    return ledger.table("part").select("p_partkey", F.size(F.array_intersect(F.split("p_name", " "), F.split(F.lower(F.concat_ws(" ", "p_type", F.lit("red blue"))), " "))).cast("bigint").alias("shared"))


@query("set_except", "select o_orderkey, case when o_orderkey % 2 = 0 then '17' else '' end as unsupported from orders where o_orderkey <> 17")
def set_except(ledger):
    from hearthbook.functions.checks import unsupported

    answer = F.concat(F.lit("Paid "), F.col("o_orderkey"), F.when(F.col("o_orderkey") % 2 == 0, " and 17.").otherwise(" in all."))
    proof = F.concat(F.lit("order "), F.col("o_orderkey"), F.lit(" closed"))
    return ledger.table("orders").where("o_orderkey <> 17").select("o_orderkey", F.concat_ws(" ", unsupported(answer, proof)).alias("unsupported"))


@query("find_receipt", """
select r.receipt_id, purchase_date, total_minor, l.posting_id from receipts r left join (select receipt_id, arg_min(posting_id, link_id) as posting_id from receipt_links where review_status <> 'rejected' group by 1) l on l.receipt_id = r.receipt_id
where review_status <> 'rejected' and purchase_date >= date '1998-01-01' and list_contains(string_split(merchant, ' '), 'NATION_7') order by purchase_date desc, r.receipt_id limit 100""", "receipts", "receipt_links")
def find_receipt(ledger):
    return tools.call(ledger, "find_receipt", start="1998-01-01", merchant="Nation_7 Inc.").select("receipt_id", "purchase_date", "total_minor", "posting_id")


@query("get_statement", "select statement_id, account_id, period_end, closing_balance_minor from statements where statement_id = 70", "statements")
def get_statement(ledger):
    return tools.call(ledger, "get_statement", record_id=70).select("statement_id", "account_id", "period_end", "closing_balance_minor")


@query("find_purchase", "select transaction_id, amount_minor from transactions where posted_date >= date '1998-06-01' and transaction_type = 'purchase' and review_status <> 'rejected' and (origin <> 'extraction' or review_status = 'verified') order by abs(amount_minor) desc, transaction_id limit 50", "transactions")
def find_purchase(ledger):
    return tools.call(ledger, "find_purchase", start="1998-06-01", types=("purchase",), statuses=("counted",), order="largest", limit=50).select("transaction_id", "amount_minor")


@query("match_receipt_to_transaction", """
select l.posting_id, 'link' as kind, score from receipt_links l where receipt_id = 12 union all
select p.posting_id, 'candidate', 60 + case p.posted_date - r.purchase_date when 0 then 20 when 1 then 10 when 2 then 10 else 0 end + case when contains(p.description_raw, r.merchant) then 20 else 0 end
from receipts r join postings p on p.currency = r.currency and p.amount_minor = -r.total_minor and p.posted_date between r.purchase_date and r.purchase_date + 5
where r.receipt_id = 12 and r.review_status <> 'rejected' and p.review_status <> 'rejected'""", "receipts", "postings", "receipt_links")
def match_receipt_to_transaction(ledger):
    return tools.call(ledger, "match_receipt_to_transaction", record_id=12).select("posting_id", "kind", "score")


@query("get_unmatched_receipts", """
select receipt_id, merchant, purchase_date, total_minor, currency, case when n > 1 then 'several_possible_charges' else 'no_matching_charge' end as reason from (
  select r.receipt_id, r.merchant, r.purchase_date, r.total_minor, r.currency, count(p.posting_id) as n from receipts r
  left join postings p on p.currency = r.currency and p.amount_minor = -r.total_minor and p.posted_date between r.purchase_date and r.purchase_date + 5 and p.review_status <> 'rejected'
  where r.review_status <> 'rejected' and r.purchase_date between date '1998-01-01' and date '1998-12-31' and not exists (select 1 from receipt_links l where l.receipt_id = r.receipt_id and l.review_status <> 'rejected')
  group by all) x""", "receipts", "postings", "receipt_links")
def get_unmatched_receipts(ledger):
    return tools.call(ledger, "get_unmatched_receipts", start="1998-01-01", end="1998-12-31")


@query("inventory", "select lot_id, name, bought_on from lots where status = 'in_stock' and (contains(upper(name), 'RED') or contains(upper(coalesce(brand, '')), 'RED') or contains(upper(category), 'RED')) order by name, bought_on, lot_id", "lots")
def inventory(ledger):
    return I.inventory(ledger.lots, "red").select("lot_id", "name", "bought_on")
