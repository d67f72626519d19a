"""Registered queries of state changes, imports and remaining joins."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from hearthbook.functions import checks as C
from hearthbook.functions import predicates as P
from hearthbook.functions.money import decimal_text
from hearthbook.operators import commands as O
from hearthbook.operators import merge as M
from hearthbook.operators import reconcile as R
from hearthbook.operators import spending as S
from hearthbook.plans.reconciliation import PAIRS
from hearthbook.plans.registry import query
from hearthbook.plans.spending import COUNTED, NET
from hearthbook.sources import html, tabular


@query("jn_inner_account", "select account_type, a.currency, count(*) as n, cast(sum(amount_minor) as bigint) as total from transactions t join accounts a on a.account_id = t.account_id group by 1, 2", "transactions", "accounts")
def jn_inner_account(ledger):
    joined = ledger.transactions.select("account_id", "amount_minor").join(ledger.accounts, "account_id")
    return joined.groupBy("account_type", "currency").agg(F.count("*").alias("n"), F.sum("amount_minor").cast("bigint").alias("total"))


@query("jn_left_merchant", "select transaction_id, m.merchant_id from transactions t left join merchants m on m.canonical_name = t.merchant and m.merchant_id % 2 = 0", "transactions", "merchants")
def jn_left_merchant(ledger):
    even = ledger.merchants.where("merchant_id % 2 = 0").select("merchant_id", F.col("canonical_name").alias("merchant"))
    return ledger.transactions.join(even, "merchant", "left").select("transaction_id", "merchant_id")


@query("jn_left_filtered", f"select a.account_id, count(t.transaction_id) as n from accounts a left join transactions t on t.account_id = a.account_id and {COUNTED} and posted_date >= date '2001-01-01' group by 1", "accounts", "transactions")
def jn_left_filtered(ledger):
    rows = ledger.transactions.where(P.countable() & (F.col("posted_date") >= F.lit("2001-01-01").cast("date")))
    return S.coverage(ledger.accounts, rows).select("account_id", F.col("transactions").alias("n"))


@query("jn_full_outer", "select coalesce(a.currency, b.currency) as currency, coalesce(x, 0) as receipts, coalesce(y, 0) as statements from (select currency, count(*) as x from receipts where receipt_id % 2 = 0 group by 1) a full outer join (select currency, count(*) as y from statements where currency <> 'EUR' group by 1) b on b.currency = a.currency", "receipts", "statements")
def jn_full_outer(ledger):
    a = ledger.receipts.where("receipt_id % 2 = 0").groupBy("currency").agg(F.count("*").alias("receipts"))
    b = ledger.statements.where("currency <> 'EUR'").groupBy("currency").agg(F.count("*").alias("statements"))
    return a.join(b, "currency", "full_outer").na.fill(0)


@query("win_latest", "select account_id, posting_id from (select *, row_number() over (partition by account_id order by posted_date desc, posting_id desc) as k from postings) s where k = 1", "postings")
def win_latest(ledger):
    return ledger.postings.groupBy("account_id").agg(F.max_by("posting_id", F.struct("posted_date", "posting_id")).alias("posting_id"))


@query("srt_bool", "select bill_id from bills order by payment_status = 'paid' desc, due_date, bill_id limit 100", "bills")
def srt_bool(ledger):
    return ledger.bills.orderBy((F.col("payment_status") == "paid").desc(), "due_date", "bill_id").limit(100).select("bill_id")


@query("set_union_links", "select 'receipt' as kind, cast(link_id as varchar) as id from receipt_links where review_status = 'proposed' union all select 'transfer', cast(posting_id as varchar) from postings where transaction_type = 'transfer' and review_status = 'proposed'", "receipt_links", "postings")
def set_union_links(ledger):
    a = ledger.receipt_links.where("review_status = 'proposed'").select(F.lit("receipt").alias("kind"), F.col("link_id").cast("string").alias("id"))
    b = ledger.postings.where("transaction_type = 'transfer' and review_status = 'proposed'").select(F.lit("transfer").alias("kind"), F.col("posting_id").cast("string").alias("id"))
    return a.unionByName(b)


@query("prj_record", "select r.receipt_id, r.merchant, coalesce(array_to_string(list(l.link_id order by l.link_id) filter (where l.link_id is not null), ' '), '') as links from receipts r left join receipt_links l on l.receipt_id = r.receipt_id group by 1, 2", "receipts", "receipt_links")
def prj_record(ledger):
    links = ledger.receipt_links.groupBy("receipt_id").agg(F.array_sort(F.collect_list("link_id")).cast("array<string>").alias("links"))
    return ledger.receipts.join(links, "receipt_id", "left").select("receipt_id", "merchant", F.coalesce(F.concat_ws(" ", "links"), F.lit("")).alias("links"))


@query("prj_first_nonnull", "select p.posting_id, coalesce(r.merchant, b.provider, p.description_raw) as name, coalesce(b.amount_due_minor, r.total_minor) as amount_minor from postings p left join receipts r on r.receipt_id = p.posting_id left join bills b on b.bill_id = p.posting_id", "postings", "receipts", "bills")
def prj_first_nonnull(ledger):
    r = ledger.receipts.select(F.col("receipt_id").alias("posting_id"), "merchant", "total_minor")
    b = ledger.bills.select(F.col("bill_id").alias("posting_id"), "provider", "amount_due_minor")
    joined = ledger.postings.join(r, "posting_id", "left").join(b, "posting_id", "left")
    return joined.select("posting_id", F.coalesce("merchant", "provider", "description_raw").alias("name"), F.coalesce("amount_due_minor", "total_minor").alias("amount_minor"))


@query("dashboard", f"""
select a.currency, a.net, b.net as before, a.net - b.net as change from ({NET.format(period="posted_date between date '1998-03-01' and date '1998-03-31'")}) a
join ({NET.format(period="posted_date between date '1998-02-01' and date '1998-02-28'")}) b on b.currency = a.currency""", "transactions")
def dashboard(ledger):
    now, before = (S.totals(ledger.transactions.where(P.in_period(*p))).select("currency", "net") for p in (("1998-03-01", "1998-03-31"), ("1998-02-01", "1998-02-28")))
    return now.join(before.withColumnRenamed("net", "before"), "currency").withColumn("change", F.col("net") - F.col("before"))


# imports ------------------------------------------------------------------------

def _printed(ledger):
    """Rows as a spreadsheet prints them, one in five with something wrong."""
    rows = ledger.table("orders").select(F.concat(F.lit("f"), (F.col("o_custkey") % 3).cast("string")).alias("path"), F.col("o_orderkey").cast("int").alias("row"), F.date_format("o_orderdate", "M/d/yyyy").alias("date"), F.round(F.col("o_totalprice") * 100).cast("bigint").alias("minor"))
    text = decimal_text(F.col("minor"), F.lit("USD"))
    bad = F.col("row") % 5
    none = F.lit(None).cast("string")
    return rows.select(
        "path", "row", F.when(bad == 1, F.lit("13/45/1999")).otherwise(F.col("date")).alias("date"), F.lit("SHOP").alias("description"), none.alias("amount"),
        F.when(bad == 2, F.concat(text, F.lit("1"))).otherwise(text).alias("debit"), F.when(bad == 3, F.lit("1.00")).alias("credit"), F.when(bad == 4, F.lit("EUR")).alias("currency"),
    )


PARSED = "select 'f' || cast(o_custkey % 3 as varchar) as path, o_orderkey as row, case o_orderkey % 5 when 1 then 'date' when 2 then 'precision' when 3 then 'debit and credit' when 4 then 'currency' end as reject_reason, -cast(round(o_totalprice * 100) as bigint) as minor from orders"


@query("src_import", f"select path, row, reject_reason, case when reject_reason is null then minor end as amount_minor from ({PARSED}) p")
def src_import(ledger):
    return tabular.typed(_printed(ledger), "USD").select("path", F.col("row").cast("bigint").alias("row"), "reject_reason", "amount_minor")


@query("import_log", f"select path, cast(sum(case when reject_reason is null then 1 else 0 end) as bigint) as parsed, cast(sum(case when reject_reason is null then 0 else 1 end) as bigint) as rejected, cast(0 as bigint) as blank from ({PARSED}) p group by 1")
def import_log(ledger):
    return tabular.counts(tabular.typed(_printed(ledger), "USD"))


@query("src_preview", "select posting_id, amount_minor, (select cast(sum(amount_minor) as bigint) from postings where amount_minor > 0) as inflow, (select cast(sum(-amount_minor) as bigint) from postings where amount_minor < 0) as outflow from postings order by posting_id limit 50", "postings")
def src_preview(ledger):
    rows = ledger.postings
    sums = rows.agg(F.sum(F.when(F.col("amount_minor") > 0, F.col("amount_minor"))).cast("bigint").alias("inflow"), F.sum(F.when(F.col("amount_minor") < 0, -F.col("amount_minor"))).cast("bigint").alias("outflow"))
    return rows.orderBy("posting_id").limit(50).select("posting_id", "amount_minor").join(F.broadcast(sums))


@query("src_find_in_page")
def src_find_in_page(ledger):
    return html.passages(html.page_text(ledger.table("pages")), ["the", "of"]).select("page_id", F.size("passages").alias("passages"))


@query("fn_printed_decimal", "select o_orderkey, case when o_orderkey % 2 = 0 then cast(o_custkey as varchar) end as figure from orders")
def fn_printed_decimal(ledger):
    text = F.concat(F.lit("Total $"), F.col("o_custkey"), F.when(F.col("o_orderkey") % 2 == 0, "").otherwise(" or 5.00"))
    return ledger.table("orders").select("o_orderkey", C.printed_decimal(text).alias("figure"))


@query("fn_quote_repair", "select p_partkey, case when p_size % 2 = 0 then p_name else '\"' || p_name || '!\"' end as quote from part")
def fn_quote_repair(ledger):
    quote = F.when(F.col("p_size") % 2 == 0, F.concat(F.lit('"'), F.col("p_name"), F.lit('"'))).otherwise(F.concat(F.lit('"'), F.col("p_name"), F.lit('!"')))
    return ledger.table("part").select("p_partkey", C.quote_repaired(quote, F.concat(F.lit("Item "), F.col("p_name"))).alias("quote"))


# commands -----------------------------------------------------------------------

@query("op_set_category", """
select t.transaction_id, case when c.hand is not null then c.hand when t.account_id % 4 = 0 then 'ruled' when c.transaction_id is not null then null else t.category end as category,
  case when c.hand is not null then 'user' when t.account_id % 4 = 0 then 'rule' when c.transaction_id is not null then 'none' else 'import' end as source
from transactions t left join (select transaction_id, case when account_id % 3 = 0 then 'mine' end as hand from transactions where account_id % 5 = 0) c on c.transaction_id = t.transaction_id""", "transactions")
def op_set_category(ledger):
    rows = ledger.transactions
    said = rows.where("account_id % 5 = 0").select("transaction_id", F.when(F.col("account_id") % 3 == 0, "mine").alias("category"), F.lit(1).alias("seq"))
    return O.set_category(rows, said, rows.where("account_id % 4 = 0").select("transaction_id", F.lit("ruled").alias("category")))


@query("op_rules_crud", "select count(*) as changed from transactions where account_id % 4 = 0 and category is distinct from 'ruled'", "transactions")
def op_rules_crud(ledger):
    rows = ledger.transactions
    after = O.set_category(rows, rows.limit(0).select("transaction_id", "category", F.lit(1).alias("seq")), rows.where("account_id % 4 = 0").select("transaction_id", F.lit("ruled").alias("category")))
    return O.changed(rows, after, "transaction_id", "category")


@query("op_bill_payment", """
select bill_id, case when bill_id % 3 = 0 then 'unpaid' when bill_id % 3 = 1 then 'paid' else payment_status end as payment_status, case when bill_id % 3 = 1 then bill_id end as payment_id from bills""", "bills")
def op_bill_payment(ledger):
    bills = ledger.bills
    said = bills.select("bill_id", F.lit(1).alias("seq"), F.when(F.col("bill_id") % 3 == 0, "unpaid").otherwise("paid").alias("status"), F.when(F.col("bill_id") % 3 > 0, F.col("bill_id")).alias("payment_id"), (-F.col("amount_due_minor") - F.when(F.col("bill_id") % 3 == 2, 1).otherwise(0)).alias("paid_minor"))
    return O.bill_payment(bills, said)


@query("op_account", "select w.institution, w.account_type, w.currency, case when h.has is null then 'created' when h.has = w.currency then 'found' else 'conflict' end as outcome from (select distinct institution, account_type, currency from accounts) w left join (select institution, account_type, min(currency) as has from accounts where account_id % 10 < 5 group by 1, 2) h on h.institution = w.institution and h.account_type = w.account_type", "accounts")
def op_account(ledger):
    return O.find_or_create(ledger.accounts.where("account_id % 10 < 5"), ledger.accounts.select("institution", "account_type", "currency"))


@query("op_review_link", "select link_id, case when link_id % 4 = 0 then 'rejected' else review_status end as review_status, link_id % 4 = 0 and review_status <> 'rejected' as restores from receipt_links", "receipt_links")
def op_review_link(ledger):
    links = ledger.receipt_links
    return O.review_links(links, links.where("link_id % 4 = 0").select("link_id", F.lit("rejected").alias("status"), F.lit(1).alias("seq")))


HELD = "exists (select 1 from receipt_links l where l.posting_id = s.first_one and l.receipt_id <> s.receipt_id and l.review_status <> 'rejected')"


@query("op_resolve_issue", f"""
select receipt_id, case receipt_id % 4 when 0 then 'open' when 1 then 'left_unmatched' when 2 then case when {HELD} then 'refused' else 'linked' end else 'refused' end as outcome, case when receipt_id % 4 = 2 and not {HELD} then first_one end as posting_id
from (select receipt_id, min(posting_id) as first_one from ({PAIRS}) p group by 1) s""", "receipts", "postings", "receipt_links")
def op_resolve_issue(ledger):
    found = R.receipt_candidates(ledger.receipts, ledger.postings)
    issues = found.groupBy(F.lit("ambiguous_receipt_match").alias("issue_type"), F.col("receipt_id").alias("record_id")).agg(F.array_sort(F.collect_list("posting_id")).alias("candidates")).withColumn("status", F.lit("open"))
    chosen = F.when(F.col("record_id") % 4 == 2, F.col("candidates")[0]).when(F.col("record_id") % 4 == 3, F.lit(-1))
    choices = issues.where("record_id % 4 > 0").select("issue_type", "record_id", F.lit(1).alias("seq"), chosen.alias("chosen"))
    done = R.resolve_issues(issues, choices, ledger.postings, ledger.receipt_links.where("review_status <> 'rejected'").select("posting_id", "receipt_id"))
    return done.select(F.col("record_id").alias("receipt_id"), "outcome", F.col("chosen").alias("posting_id"))


@query("op_answer", "select lot_id, case when product_id % 2 = 0 then 'finished' else 'still_have' end as event, greatest(bought_on, case when product_id % 2 = 0 then date '1998-06-30' - 3 else date '1998-06-30' end) as day from lots where status = 'in_stock'", "lots")
def op_answer(ledger):
    kind = F.when(F.col("product_id") % 2 == 0, "finished_this_week").otherwise("still_have")
    held = ledger.lots.where("status = 'in_stock'").select("lot_id", O.answer(kind, F.lit("1998-06-30").cast("date"), F.col("bought_on")).alias("a"))
    return held.select("lot_id", "a.event", "a.day")


@query("op_checkin_stage", "select lot_id, s.seq, case when status <> 'in_stock' then 'already closed' when product_id % 7 = 0 then 'unknown answer' when s.seq = 2 then 'repeated' else 'ok' end as reason from lots cross join (select 1 as seq union all select 2) s where product_id % 5 = 0", "lots")
def op_checkin_stage(ledger):
    asked = ledger.lots.where("product_id % 5 = 0").select("lot_id", F.explode(F.array(F.lit(1), F.lit(2))).alias("seq"), F.when(F.col("product_id") % 7 == 0, "eaten").otherwise("finished_today").alias("kind"))
    return O.stage_answers(asked, ledger.lots)


@query("op_add_lot", "select lot_id, case when bought_on < newest then least(bought_on + 28, date '2000-06-30') else bought_on + 28 end as next_check_on from (select *, max(bought_on) over (partition by product_id) as newest from lots) l where status = 'in_stock'", "lots")
def op_add_lot(ledger):
    return O.next_checks(ledger.lots, "2000-06-30")


@query("win_latest_correction", "select account_id, source_row from (select *, row_number() over (partition by account_id, source_row % 3 order by source_row desc) as k from entries) s where k = 1", "entries")
def win_latest_correction(ledger):
    place = F.row_number().over(W.partitionBy("account_id", F.col("source_row") % 3).orderBy(F.desc("source_row")))
    return ledger.entries.withColumn("k", place).where("k = 1").select("account_id", "source_row")
