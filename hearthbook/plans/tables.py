"""Registered queries of the library view, rules, history and pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from hearthbook.functions.text import normalize_name
from hearthbook.operators import library as L
from hearthbook.operators import rules as R
from hearthbook.plans.registry import query

RULES = "select min(p_partkey) as rule_id, split_part(p_name, ' ', 1) as pattern, min(lower(p_type)) as category, cast(null as bigint) as account_id from part group by split_part(p_name, ' ', 1) union all select 1000000 + min(p_partkey), p_name, min(lower(p_type)), cast(null as bigint) from part where p_size % 3 = 0 group by p_name"


@query("jn_rule", f"""
select transaction_id, rule_id, category from (
  select t.transaction_id, r.rule_id, r.category, row_number() over (partition by t.transaction_id order by len(string_split(r.pattern, ' ')) desc, r.rule_id desc) as k
  from transactions t join (select rule_id, upper(pattern) as pattern, category from ({RULES}) p) r on len(list_filter(string_split(r.pattern, ' '), lambda w: not list_contains(string_split(t.merchant, ' '), w))) = 0) s where k = 1""", "transactions")
def jn_rule(ledger):
    rules = ledger.sql(RULES).withColumn("pattern", normalize_name(F.col("pattern"), ascii_only=True))
    return R.apply_rules(ledger.transactions, rules)


FILES = """select doc_id, source as folder, trashed, case when doc_id % 19 = 0 then 'failed' when n_chars < 500 then 'needs_text' when quality = 0 then 'needs_review' when quality is null then 'ready_for_ledger' else 'none' end as work, relative_path, lang from files"""


def _documents(ledger):
    files = ledger.files
    status = F.when(F.col("doc_id") % 19 == 0, "failed")
    text = F.when(F.col("n_chars") >= 500, "read")
    book = F.when(F.col("quality") == 0, "needs_review").when(F.col("quality") == 1, "verified")
    return files.select("doc_id", F.col("source").alias("folder"), "trashed", L.work(status, text, book).alias("work"), "relative_path", "lang")


@query("prj_library", FILES, "files")
def prj_library(ledger):
    return _documents(ledger)


@query("agg_folders", f"""
select folder, cast(sum(case when trashed = 0 then 1 else 0 end) as bigint) as documents, cast(sum(case when trashed = 1 then 1 else 0 end) as bigint) as in_trash,
  cast(sum(case when trashed = 0 and work = 'failed' then 1 else 0 end) as bigint) as failed, cast(sum(case when trashed = 0 and work = 'needs_text' then 1 else 0 end) as bigint) as needs_text,
  cast(sum(case when trashed = 0 and work = 'needs_review' then 1 else 0 end) as bigint) as needs_review, cast(sum(case when trashed = 0 and work = 'ready_for_ledger' then 1 else 0 end) as bigint) as ready_for_ledger
from ({FILES}) f group by 1""", "files")
def agg_folders(ledger):
    return L.folder_counts(_documents(ledger))


@query("flt_work", f"select work, count(*) as n from ({FILES}) f where trashed = 0 group by 1", "files")
def flt_work(ledger):
    return _documents(ledger).where("trashed = 0").groupBy("work").agg(F.count("*").alias("n"))


@query("flt_trash_folder", f"select doc_id from ({FILES}) f where trashed = 1 and folder = 'src1'", "files")
def flt_trash_folder(ledger):
    return _documents(ledger).where("trashed = 1 and folder = 'src1'").select("doc_id")


@query("flt_like_escape", f"select doc_id from ({FILES}) f where contains(lower(relative_path), '/1') or contains(lower(lang), '/1')", "files")
def flt_like_escape(ledger):
    return _documents(ledger).where(L.contains_text("/1", F.col("relative_path"), F.col("lang"))).select("doc_id")


@query("prj_title", """
select doc_id, concat_ws(' - ', merchant, location, case when not coalesce(contains(lower(merchant), lower(description)), false) and not coalesce(contains(lower(location), lower(description)), false) then description end) as title from (
  select doc_id, case when doc_id % 5 > 0 then source end as merchant, case when doc_id % 3 > 0 then lang end as location, case when doc_id % 2 = 0 then lang else 'bill' end as description from files) f""", "files")
def prj_title(ledger):
    merchant, location = F.when(F.col("doc_id") % 5 > 0, F.col("source")), F.when(F.col("doc_id") % 3 > 0, F.col("lang"))
    return ledger.files.select("doc_id", L.title(merchant, location, F.when(F.col("doc_id") % 2 == 0, F.col("lang")).otherwise("bill")).alias("title"))


@query("srt_documents", f"select doc_id, relative_path from ({FILES}) f order by relative_path, doc_id limit 100", "files")
def srt_documents(ledger):
    return _documents(ledger).orderBy("relative_path", "doc_id").limit(100).select("doc_id", "relative_path")


RUNS = "select event_id as id, event_type as kind, case event_id % 4 when 0 then 'queued' when 1 then 'running' when 2 then 'succeeded' else 'failed' end as status, ts as created_at from events"


def _runs(ledger, kind):
    status = F.element_at(F.array(*map(F.lit, ("queued", "running", "succeeded", "failed"))), (F.col("event_id") % 4 + 1).cast("int"))
    return ledger.table("events").where(F.col("event_type") == kind).select(F.col("event_id").alias("id"), status.alias("status"), F.col("ts").alias("created_at"))


@query("set_union_all", f"select kind, id, status from ({RUNS}) r where kind in ('click', 'purchase', 'view') order by created_at desc, kind, id desc limit 200")
def set_union_all(ledger):
    return L.job_history(**{k: _runs(ledger, k) for k in ("click", "purchase", "view")}).limit(200).select("kind", "id", "status")


@query("run_recover", f"select id, case when status in ('queued', 'running') then 'interrupted' else status end as status from ({RUNS}) r where kind = 'click'")
def run_recover(ledger):
    return L.recovered(_runs(ledger, "click")).select("id", "status")


@query("agg_status_counts", f"select status, count(*) as runs from ({RUNS}) r where kind = 'click' group by 1")
def agg_status_counts(ledger):
    return _runs(ledger, "click").groupBy("status").agg(F.count("*").alias("runs"))


@query("distinct", f"select distinct kind, status from ({RUNS}) r where kind in ('click', 'view')")
def distinct(ledger):
    return L.job_history(click=_runs(ledger, "click"), view=_runs(ledger, "view")).select("kind", "status").distinct()


@query("prj_latest", "select user_id, event_id, event_type from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) as k from events) e where k = 1")
def prj_latest(ledger):
    return L.newest(ledger.table("events"), ["user_id"], ["ts", "event_id"], "event_id", "event_type")


@query("src_json_field", "select event_id, json_extract_string(props, '$.k') as k from events")
def src_json_field(ledger):
    return ledger.table("events").select("event_id", F.get_json_object("props", "$.k").alias("k"))


@query("set_union", "select distinct currency from (select currency from receipts union select currency from bills union select currency from accounts) c", "receipts", "bills", "accounts")
def set_union(ledger):
    return ledger.receipts.select("currency").union(ledger.bills.select("currency")).union(ledger.accounts.select("currency")).distinct()


@query("prj_summary", """
select 'transaction' as record_type, transaction_id as id, posted_date as date, merchant as name, amount_minor, currency, review_status from transactions
union all select 'receipt', cast(receipt_id as varchar), purchase_date, merchant, total_minor, currency, review_status from receipts
union all select 'bill', cast(bill_id as varchar), due_date, provider, amount_due_minor, currency, review_status from bills
union all select 'statement', cast(statement_id as varchar), period_end, cast(account_id as varchar), closing_balance_minor, currency, review_status from statements""", "transactions", "receipts", "bills", "statements")
def prj_summary(ledger):
    shapes = (("transaction", "transactions", "transaction_id", "posted_date", "merchant", "amount_minor"), ("receipt", "receipts", "receipt_id", "purchase_date", "merchant", "total_minor"),
              ("bill", "bills", "bill_id", "due_date", "provider", "amount_due_minor"), ("statement", "statements", "statement_id", "period_end", "account_id", "closing_balance_minor"))
    out = None
    for kind, view, key, date, name, amount in shapes:
        part = getattr(ledger, view).select(F.lit(kind).alias("record_type"), F.col(key).cast("string").alias("id"), F.col(date).alias("date"), F.col(name).cast("string").alias("name"), F.col(amount).alias("amount_minor"), "currency", "review_status")
        out = part if out is None else out.unionByName(part)
    return out


@query("line_neighbours", "select event_id, array_to_string(list(event_id) over (partition by user_id order by event_id rows between 2 preceding and 2 following exclude current row), ' ') as neighbours from events")
def line_neighbours(ledger):
    from pyspark.sql import Window as W

    near = W.partitionBy("user_id").orderBy("event_id").rowsBetween(-2, 2)
    around = F.filter(F.collect_list("event_id").over(near), lambda x: x != F.col("event_id"))
    return ledger.table("events").select("event_id", F.concat_ws(" ", around.cast("array<string>")).alias("neighbours"))


@query("src_html_text")
def src_html_text(ledger):
    from hearthbook.sources.html import page_text

    return page_text(ledger.table("pages"))
