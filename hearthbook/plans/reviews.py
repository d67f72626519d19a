"""Registered queries of reviews, publications, links and extraction checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from hearthbook.functions import predicates as P
from hearthbook.operators import extraction as X
from hearthbook.operators import review as R
from hearthbook.operators import rules as RU
from hearthbook.operators import search as SE
from hearthbook.operators import spending as S
from hearthbook.operators.written import folder
from hearthbook.plans.registry import query
from hearthbook.plans.spending import COUNTED

LIVE = "review_status <> 'rejected'"


@query("flt_period", "select transaction_id from transactions where posted_date between date '1998-02-01' and date '1998-06-30'", "transactions")
def flt_period(ledger):
    return ledger.transactions.where(P.in_period("1998-02-01", "1998-06-30")).select("transaction_id")


@query("flt_optional", "select transaction_id from transactions where posted_date >= date '2001-06-01'", "transactions")
def flt_optional(ledger):
    return ledger.transactions.where(F.col("posted_date") >= F.lit("2001-06-01").cast("date")).select("transaction_id")


@query("flt_category", "select coalesce(category, 'uncategorized') as category, count(*) as n from transactions where coalesce(category, 'uncategorized') <> 'promo' and currency = 'EUR' group by 1", "transactions")
def flt_category(ledger):
    rows = ledger.transactions.withColumn("category", S.category()).where("category <> 'promo' and currency = 'EUR'")
    return rows.groupBy("category").agg(F.count("*").alias("n"))


@query("flt_has_receipt", f"select posting_id from postings p where exists (select 1 from receipt_links l where l.posting_id = p.posting_id and {LIVE.replace('review', 'l.review')})", "postings", "receipt_links")
def flt_has_receipt(ledger):
    return ledger.postings.join(ledger.receipt_links.where(LIVE), "posting_id", "left_semi").select("posting_id")


@query("jn_anti", f"select posting_id from postings p where not exists (select 1 from receipt_links l where l.posting_id = p.posting_id and {LIVE.replace('review', 'l.review')})", "postings", "receipt_links")
def jn_anti(ledger):
    return ledger.postings.join(ledger.receipt_links.where(LIVE), "posting_id", "left_anti").select("posting_id")


@query("flt_unlinked_receipt", f"select receipt_id from receipts r where {LIVE} and not exists (select 1 from receipt_links l where l.receipt_id = r.receipt_id and l.{LIVE})", "receipts", "receipt_links")
def flt_unlinked_receipt(ledger):
    return ledger.receipts.where(LIVE).join(ledger.receipt_links.where(LIVE), "receipt_id", "left_anti").select("receipt_id")


@query("jn_min_link", f"select p.posting_id, l.receipt_id from postings p left join (select *, row_number() over (partition by posting_id order by link_id) as k from receipt_links where {LIVE}) l on l.posting_id = p.posting_id and l.k = 1", "postings", "receipt_links")
def jn_min_link(ledger):
    return R.earliest_link(ledger.postings.select("posting_id"), ledger.receipt_links)


@query("prj_recon_status", f"""
select r.receipt_id, case when v = 1 then 'matched' when v = 0 then 'proposed' when r.receipt_id % 2 = 0 then 'ambiguous' else 'unmatched' end as status
from receipts r left join (select receipt_id, max(case when review_status = 'verified' then 1 else 0 end) as v from receipt_links where {LIVE} group by 1) l on l.receipt_id = r.receipt_id""", "receipts", "receipt_links")
def prj_recon_status(ledger):
    return R.reconciliation_status(ledger.receipts, ledger.receipt_links, ledger.receipts.where("receipt_id % 2 = 0"))


@query("prj_links", "select l.link_id, r.merchant, p.description_raw, array_to_string(string_split(match_method, '+'), ' ') as signals from receipt_links l join receipts r on r.receipt_id = l.receipt_id join postings p on p.posting_id = l.posting_id", "receipt_links", "receipts", "postings")
def prj_links(ledger):
    joined = ledger.receipt_links.join(ledger.receipts.select("receipt_id", "merchant"), "receipt_id").join(ledger.postings.select("posting_id", "description_raw"), "posting_id")
    return joined.select("link_id", "merchant", "description_raw", F.concat_ws(" ", F.split("match_method", r"\+")).alias("signals"))


@query("snk_link_conflict", "select receipt_id, posting_id, link_id from (select *, row_number() over (partition by receipt_id order by review_status = 'verified' desc, link_id) as k from receipt_links) s where k = 1", "receipt_links")
def snk_link_conflict(ledger):
    links = ledger.receipt_links.withColumn("by_user", F.col("review_status") == "verified").withColumn("seq", F.col("link_id"))
    return R.merge_links(links, ["receipt_id"]).select("receipt_id", "posting_id", "link_id")


@query("op_review", """
select r.receipt_id, coalesce(c.status, r.review_status) as review_status, c.status is not null as by_user from receipts r left join (
  select *, row_number() over (partition by receipt_id order by link_id desc) as k from (select receipt_id, link_id, review_status as status from receipt_links where score >= 80) x) c on c.receipt_id = r.receipt_id and c.k = 1""", "receipts", "receipt_links")
def op_review(ledger):
    commands = ledger.receipt_links.where("score >= 80").select("receipt_id", "link_id", F.col("review_status").alias("status"))
    return R.apply_status(ledger.receipts.select("receipt_id", "review_status"), commands, "receipt_id", "link_id")


@query("op_statement_review", f"""
select transaction_id, case when origin = 'extraction' and t.review_status in ('proposed', 'needs_review') and s.review_status in ('verified', 'rejected') then s.review_status else t.review_status end as review_status
from transactions t left join (select account_id * 10 as statement_id, review_status from statements where statement_id % 10 = 0) s on s.statement_id = t.account_id * 10""", "transactions", "statements")
def op_statement_review(ledger):
    rows = ledger.transactions.withColumn("statement_id", F.col("account_id") * 10)
    return R.spread_to_rows(rows, ledger.statements.where("statement_id % 10 = 0")).select("transaction_id", "review_status")


@query("snk_publish_guard", """
select coalesce(o.bill_id, n.bill_id) as bill_id, case when o.bill_id is null then n.amount when n.bill_id is null or o.payment_status = 'paid' then o.amount_due_minor else n.amount end as amount_minor,
  case when o.bill_id is null then 'created' when n.bill_id is null then 'untouched' when o.payment_status = 'paid' then 'kept_reviewed' else 'replaced' end as outcome
from (select * from bills where bill_id % 5 <> 0) o full outer join (select bill_id, amount_due_minor + 100 as amount from bills where bill_id % 7 <> 0) n on n.bill_id = o.bill_id""", "bills")
def snk_publish_guard(ledger):
    old = ledger.bills.where("bill_id % 5 <> 0").select("bill_id", F.col("amount_due_minor").alias("amount_minor"), (F.col("payment_status") == "paid").alias("by_user"))
    new = ledger.bills.where("bill_id % 7 <> 0").select("bill_id", (F.col("amount_due_minor") + 100).alias("amount_minor"))
    return R.publish(old, new, "bill_id")


@query("snk_publish_asset", """
select coalesce(o.account_id, n.account_id) as account_id, case when n.account_id is null or n.period_end < o.period_end or (n.period_end = o.period_end and o.review_status = 'verified') then o.closing_balance_minor else n.closing_balance_minor end as value_minor,
  case when n.account_id is null or n.period_end < o.period_end or (n.period_end = o.period_end and o.review_status = 'verified') then o.period_end else n.period_end end as as_of,
  case when o.account_id is null then 'created' when n.account_id is null then 'untouched' when n.period_end < o.period_end then 'kept_newer' when n.period_end = o.period_end and o.review_status = 'verified' then 'kept_reviewed' else 'proposed' end as outcome
from (select * from statements where statement_id % 10 = account_id % 4) o full outer join (select * from statements where statement_id % 10 = 1 and account_id % 9 <> 0) n on n.account_id = o.account_id""", "statements")
def snk_publish_asset(ledger):
    shape = ["account_id", F.col("closing_balance_minor").alias("value_minor"), F.col("period_end").alias("as_of")]
    old = ledger.statements.where("statement_id % 10 = account_id % 4").select(*shape, (F.col("review_status") == "verified").alias("by_user"))
    return R.publish_assets(old, ledger.statements.where("statement_id % 10 = 1 and account_id % 9 <> 0").select(*shape))


@query("publish_decision", """
select bill_id, case when bill_id % 17 = 0 or bill_id % 19 = 0 then 'blocked' when amount_due_minor = 0 or due_date < issue_date + 30 or payment_status = 'unknown' then 'needs_review' else 'verified' end as decision,
  concat_ws(',', case when amount_due_minor = 0 then 'no amount' end, case when payment_status = 'unknown' then 'payment unknown' end) as why from bills""", "bills")
def publish_decision(ledger):
    why = R.reasons(**{"no amount": F.col("amount_due_minor") == 0, "payment unknown": F.col("payment_status") == "unknown"})
    return ledger.bills.select("bill_id", R.publish_decision(F.when(F.col("bill_id") % 17 != 0, "USD"), F.when(F.col("bill_id") % 19 != 0, "bank"), why).alias("decision"), F.concat_ws(",", why).alias("why"))


@query("review_queue", """
select 'receipt' as kind, cast(receipt_id as varchar) as id, review_status as status from receipts where review_status in ('proposed', 'needs_review') union all select 'bill', cast(bill_id as varchar), review_status from bills where review_status in ('proposed', 'needs_review')
union all select 'link', cast(link_id as varchar), review_status from receipt_links where review_status in ('proposed', 'needs_review')""", "receipts", "bills", "receipt_links")
def review_queue(ledger):
    return R.queue(ledger.receipts, ledger.bills, ledger.receipt_links)


@query("jn_similar", f"""
with tokens as (select p_partkey as id, 'M' || cast(p_size % 3 as varchar) as merchant, unnest(list_distinct(list_filter(string_split(trim(regexp_replace(upper(p_name || ' ' || p_type || ' item ' || p_brand), '[^A-Z&]+', ' ', 'g')), ' '), lambda t: length(t) > 2))) as word from part)
select line_id, known_id, shared, k from (
  select a.id as line_id, b.id as known_id, count(*) as shared, row_number() over (partition by a.id order by count(*) desc, max(case when a.merchant = b.merchant then 1 else 0 end) desc, b.id) as k
  from tokens a join tokens b on a.word = b.word where a.id % 20 = 0 and b.id % 20 <> 0 group by 1, 2) s where k <= 5""")
def jn_similar(ledger):
    """Every description holds the word ITEM."""
    named = ledger.table("part").select("p_partkey", F.concat(F.lit("M"), F.col("p_size") % 3).alias("merchant"), F.concat_ws(" ", "p_name", "p_type", F.lit("item"), "p_brand").alias("description"))
    return RU.similar(named.where("p_partkey % 20 = 0").withColumnRenamed("p_partkey", "line_id"), named.where("p_partkey % 20 <> 0").withColumnRenamed("p_partkey", "known_id"))


@query("jn_alias", """
select lot_id, coalesce(a.product, b.product) as product, case when a.product is not null then 'code_at_merchant' when b.product is not null then 'text' end as method from lots l
left join (select merchant, product_id % 50 as code, max(product_id) as product from lots where product_id % 3 = 0 group by 1, 2) a on a.merchant = l.merchant and a.code = l.product_id % 50
left join (select name, max(product_id) as product from lots where product_id % 7 = 0 group by 1) b on b.name = l.name""", "lots")
def jn_alias(ledger):
    rows = ledger.lots.withColumn("code", F.col("product_id") % 50)
    by_code = rows.where("product_id % 3 = 0").groupBy("merchant", "code").agg(F.max("product_id").alias("a"))
    by_text = rows.where("product_id % 7 = 0").groupBy("name").agg(F.max("product_id").alias("b"))
    joined = rows.join(by_code, ["merchant", "code"], "left").join(by_text, "name", "left")
    return joined.select("lot_id", F.coalesce("a", "b").alias("product"), F.when(F.col("a").isNotNull(), "code_at_merchant").when(F.col("b").isNotNull(), "text").alias("method"))


@query("search", f"""
select 'transaction' as kind, count(*) as found from transactions where {COUNTED} and contains(lower(description_raw), 'red') union all select 'receipt', count(*) from receipts where contains(lower(merchant), 'red')
union all select 'bill', count(*) from bills where contains(lower(provider), 'red') union all select 'document', count(*) from files where contains(lower(relative_path), 'red')""", "transactions", "receipts", "bills", "files")
def search(ledger):
    """Totals by kind over postings that are written, then asked: each kind is one insert."""
    target = folder(ledger.spark)
    sides = (("transaction", ledger.transactions.where(P.countable()), "transaction_id", "description_raw"), ("receipt", ledger.receipts, "receipt_id", "merchant"), ("bill", ledger.bills, "bill_id", "provider"), ("document", ledger.files, "doc_id", "relative_path"))
    for kind, frame, key, text in sides:
        SE.insert(target, kind, frame, key, text)
    found = SE.find(ledger.spark, target, "red").groupBy("kind").agg(F.count("*").alias("found"))
    kinds = ledger.spark.range(1).select(F.explode(F.array(*(F.lit(side[0]) for side in sides))).alias("kind"))
    return kinds.join(found, "kind", "left").select("kind", F.coalesce("found", F.lit(0)).alias("found"))


# extraction checks over the lines of documents --------------------------------

LINES = "select doc_id, cast(pos - 1 as int) as line, text from (select doc_id, unnest(string_split(text, chr(10))) as text, generate_subscripts(string_split(text, chr(10)), 1) as pos from documents) x where trim(text) <> ''"
CITED = f"select doc_id, line, case when line % 3 = 2 then 'no such quote' else substr(text, 3, 12) end as quote from ({LINES}) l where line % 5 < 3"


def _cited(ledger):
    lines = X.lines_of(ledger.table("documents"))
    quotes = F.when(F.col("line") % 3 == 2, "no such quote").otherwise(F.substring("text", 3, 12))
    return lines, lines.where("line % 5 < 3").select("doc_id", "line", quotes.alias("quote"))


@query("fn_quote_exact", f"select c.doc_id, c.line, c.quote <> '' and contains(l.text, c.quote) as exact from ({CITED}) c join ({LINES}) l on l.doc_id = c.doc_id and l.line = c.line")
def fn_quote_exact(ledger):
    lines, cited = _cited(ledger)
    return X.exact_citations(cited, lines).select("doc_id", "line", "exact")


@query("fn_line_coverage", f"""
select doc_id, count(*) as lines, cast(sum(case when line % 5 < 3 then 1 else 0 end) as bigint) as once, cast(sum(case when line % 5 >= 3 then 1 else 0 end) as bigint) as missing, cast(0 as bigint) as twice from ({LINES}) l group by 1""")
def fn_line_coverage(ledger):
    return X.coverage(*_cited(ledger))


@query("chunk_lines")
def chunk_lines(ledger):
    return X.chunks(X.lines_of(ledger.table("documents")))


@query("fn_extract_normalize", """
select o_orderkey, concat_ws(',', case when sub + coalesce(tax, 0) <> total then 'total' end, case when sub % 3 = 0 then 'items' end) as failed from (
  select o_orderkey, cast(round(o_totalprice * 100) as bigint) as sub, case when o_orderkey % 2 = 0 then 100 end as tax, cast(round(o_totalprice * 100) as bigint) + o_orderkey % 4 * 50 as total from orders) o""")
def fn_extract_normalize(ledger):
    sub = F.round(F.col("o_totalprice") * 100).cast("bigint")
    made = ledger.table("orders").select("o_orderkey", sub.alias("sub"), F.when(F.col("o_orderkey") % 2 == 0, 100).alias("tax"), (sub + F.col("o_orderkey") % 4 * 50).alias("total"))
    listed = F.array(F.col("sub") - 5, F.when(F.col("sub") % 3 == 0, 4).otherwise(5).cast("bigint"))
    return made.select("o_orderkey", F.concat_ws(",", X.receipt_adds_up(F.col("sub"), F.col("tax"), F.lit(None).cast("bigint"), F.col("total"), listed)).alias("failed"))
