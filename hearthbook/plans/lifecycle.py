"""Registered queries of products, corrections, publications, warranties, assets and the reconciliation's decisions."""

from __future__ import annotations

from pyspark.sql import functions as F

from hearthbook.functions.money import decimal_text
from hearthbook.operators import commands as O
from hearthbook.operators import corrections as K
from hearthbook.operators import products as I
from hearthbook.operators import reconcile as R
from hearthbook.operators import review as V
from hearthbook.operators import upkeep as U
from hearthbook.operators.written import kept
from hearthbook.plans.reconciliation import COARSE_SQL, PAIRS, RECURRING, win_recurring
from hearthbook.plans.registry import query
from hearthbook.plans.tables import RULES

# receipt lines and products -----------------------------------------------------


def _resolutions(ledger):
    return ledger.lines.where("resolution <> 'none'").select(
        F.col("line_id").alias("resolution_id"), "line_id", "name", "brand", "size_text", "category", "consumable", F.col("product_code").alias("barcode"), F.lit("alias").alias("method"), F.col("resolution").alias("review_status"),
    )


@query("receipts_to_identify", "select receipt_id, count(*) as lines, cast(sum(case when resolution in ('proposed', 'verified') then 0 else 1 end) as bigint) as unresolved from lines where receipt_id in (select receipt_id from receipts where review_status <> 'rejected') group by 1 having sum(case when resolution in ('proposed', 'verified') then 0 else 1 end) > 0", "lines", "receipts")
def receipts_to_identify(ledger):
    return I.to_identify(ledger.receipts, ledger.lines, _resolutions(ledger))


@query("lines", "select line_id, case when resolution in ('proposed', 'verified') then resolution end as resolution_status from lines", "lines")
def lines(ledger):
    return I.line_status(ledger.lines, _resolutions(ledger)).select("line_id", "resolution_status")


@query("unresolved", "select line_id from lines where resolution not in ('proposed', 'verified')", "lines")
def unresolved(ledger):
    return I.line_status(ledger.lines, _resolutions(ledger)).where("resolution_status is null").select("line_id")


#: The aliases of some merchants' codes and of other merchants' texts, so that every source decides some lines.
CODED, TEXTED = "alias_id % 3 = 0", "alias_id % 4 = 1"


@query("resolve_cascade", f"""
select line_id, coalesce(c.product, t.product, e.product, b.product) as product, case when coalesce(c.product, t.product) is not null then 'alias' when e.product is not null then 'history' else 'barcode' end as method from lines l
left join (select merchant, code, arg_max(product, alias_id) as product from aliases where {CODED} group by 1, 2) c on c.merchant = l.merchant and c.code = l.product_code
left join (select merchant, text, arg_max(product, alias_id) as product from aliases where {TEXTED} group by 1, 2) t on t.merchant = l.merchant and t.text = upper(l.description)
left join (select code, arg_max(product, alias_id) as product from aliases where {CODED} group by 1) e on e.code = l.product_code
left join (select barcode, min(product) as product from aliases group by 1) b on b.barcode = l.product_code
where coalesce(c.product, t.product, e.product, b.product) is not null""", "lines", "aliases")
def resolve_cascade(ledger):
    codes = ledger.aliases.where(CODED).select("alias_id", "merchant", F.lit(None).cast("string").alias("text"), "code", "product")
    texts = ledger.aliases.where(TEXTED).select("alias_id", "merchant", "text", F.lit(None).cast("string").alias("code"), "product")
    scanned = ledger.aliases.select(F.col("barcode").alias("code"), "product")
    return I.known(ledger.lines, codes.unionByName(texts), scanned)


@query("op_propose", """
select line_id, seq, case when resolution in ('proposed', 'verified') then 'settled' when resolution = 'rejected' and seq = 1 then 'rejected_before' when resolution = 'none' and seq = 2 then 'repeated' else 'proposed' end as outcome
from lines cross join (select 1 as seq union all select 2) s""", "lines")
def op_propose(ledger):
    """Lines, resolutions and proposals are all derived from one view, which is read and dealt out once: each of its rows gives those of one line, where ``outcomes`` needs them."""
    part = lambda kind, seq=F.lit(None).cast("int"), name=F.lit(None).cast("string"): F.struct(kind.alias("part"), seq.alias("seq"), name.alias("name"))
    one, two = F.upper("name"), F.concat("name", F.lit(" deluxe"))
    each = F.array(part(F.lit(I.LINE)), part(I.resolution_part(F.col("resolution")), name=F.col("name")), part(F.lit(I.OFFERED), F.lit(1), one), part(F.lit(I.OFFERED), F.lit(2), two))
    dealt = ledger.lines.where("line_id is not null").select("line_id", "resolution", "name").repartition("line_id")
    rows = dealt.select("line_id", F.inline(each)).where("part is not null")
    return I.outcomes(rows).select("line_id", "seq", "outcome")


TURN = "cast(('0x' || substr(sha256(line_id), 1, 6)) as bigint) % 3"


@query("op_review_item", f"""
select line_id, case when resolution <> 'proposed' then resolution when {TURN} = 0 then 'rejected' else 'verified' end as review_status, case when resolution = 'proposed' and {TURN} = 2 then name || ' edited' else name end as name,
  case when resolution = 'proposed' and {TURN} = 2 then 'user' else 'alias' end as method from lines where resolution <> 'none'""", "lines")
def op_review_item(ledger):
    turn = F.conv(F.substring(F.sha2("line_id", 256), 1, 6), 16, 10).cast("bigint") % 3
    said = ledger.lines.select(
        F.col("line_id").alias("resolution_id"), F.lit(1).alias("seq"), F.when(turn == 0, "rejected").otherwise("verified").alias("status"), F.when(turn == 2, F.concat(F.col("name"), F.lit(" edited"))).alias("name"), "brand", "size_text", "category",
    )
    return I.review(_resolutions(ledger), said).select("line_id", "review_status", "name", "method")


@query("op_product", "select upper(name) as name, brand, size_text, arg_max(category, line_id) as category, arg_max(product_code, line_id) filter (where product_code is not null) as barcode from lines where resolution = 'verified' group by 1, 2, 3", "lines")
def op_product(ledger):
    rows = _resolutions(ledger).withColumn("product", I.product_key(F.col("name"), F.col("brand"), F.col("size_text")))
    return I.products(rows).select(F.get_json_object("product", "$.n").alias("name"), F.get_json_object("product", "$.b").alias("brand"), F.get_json_object("product", "$.s").alias("size_text"), "category", "barcode")


@query("item_reads", "select user_id as lot_id, string_agg(cast(event_id as varchar) || event_type, ' ' order by event_id) as history from events group by 1")
def item_reads(ledger):
    from hearthbook.operators.library import history

    rows = history(ledger.table("events").withColumnRenamed("user_id", "lot_id"), "lot_id", "event_id", "event_type")
    return rows.select("lot_id", F.concat_ws(" ", F.transform("changes", lambda c: F.concat(c["event_id"].cast("string"), c["event_type"]))).alias("history"))


# corrections and publications -----------------------------------------------------

ENTERED = """select p_partkey, case p_size % 3 when 0 then 'date' when 1 then 'text' else 'name' end as kind,
  case p_partkey % 5 when 0 then '2001-02-29' when 1 then ' 2001-02-28 ' when 2 then p_name || '  x' when 3 then repeat(p_name || ' ', 12) else '--' end as text from part"""


@query("fn_correction_value", f"""
select p_partkey, case when bad is null then case when kind = 'name' then regexp_replace(trim(regexp_replace(regexp_replace(upper(said), '\\b\\d+\\b|[^\\w\\s&]', ' ', 'g'), '\\s+', ' ', 'g')), '^$', '') else said end end as value, bad as error from (
  select *, case when kind = 'date' and (not regexp_full_match(said, '\\d{{4}}-\\d{{2}}-\\d{{2}}') or try_cast(said as date) is null) then 'date' when kind = 'text' and length(said) > 60 then 'too long' when kind = 'name' and length(said) > 120 then 'name'
    when kind = 'name' and trim(regexp_replace(upper(said), '\\b\\d+\\b|[^\\w\\s&]', ' ', 'g')) = '' then 'name without letters' end as bad from (select *, trim(regexp_replace(text, '\\s+', ' ', 'g')) as said from ({ENTERED}) e) f) g""")
def fn_correction_value(ledger):
    rows = ledger.sql(ENTERED).withColumn("v", K.correction_value(F.col("kind"), F.col("text"), ascii_only=True))
    return rows.select("p_partkey", "v.value", "v.error")


@query("op_correct", """
select receipt_id, case when receipt_id % 4 = 0 and receipt_id % 3 <> 1 then 'verified' else 'needs_review' end as review_status, case when receipt_id % 4 = 0 then case when receipt_id % 3 = 1 then 'Location is unclear.' else '' end when receipt_id % 3 = 1 then 'Purchase date is missing.,Location is unclear.' else 'Purchase date is missing.' end as issues,
  case when receipt_id % 4 = 0 then cast(purchase_date as varchar) end as corrected from receipts""", "receipts")
def op_correct(ledger):
    issues = F.when(F.col("receipt_id") % 3 == 1, F.array(F.lit("Purchase date is missing."), F.lit("Location is unclear."))).otherwise(F.array(F.lit("Purchase date is missing.")))
    records = ledger.receipts.select("receipt_id", "purchase_date", issues.alias("issues"), F.lit("needs_review").alias("review_status"), F.lit(False).alias("by_user"))
    said = ledger.receipts.where("receipt_id % 4 < 2")
    day, bad = F.col("purchase_date").cast("string"), F.lit("yesterday")
    changes = said.select("receipt_id", F.explode(F.array(
        F.struct(F.lit(1).alias("seq"), F.lit("purchase_date").alias("field"), F.lit("1990-01-01").alias("text")),
        F.struct(F.lit(2).alias("seq"), F.lit("purchase_date").alias("field"), day.alias("text")),
        F.struct(F.lit(3).alias("seq"), F.lit("total").alias("field"), day.alias("text")),
    )).alias("c")).select("receipt_id", "c.seq", "c.field", F.when(F.col("receipt_id") % 4 == 1, bad).otherwise(F.col("c.text")).alias("text"))
    return K.correct(records, changes, "receipt", "receipt_id", ascii_only=True).select("receipt_id", "review_status", F.concat_ws(",", "issues").alias("issues"), F.try_element_at("corrected", F.lit("purchase_date")).alias("corrected"))


@query("snk_publish_receipt", """
select r.receipt_id, case when receipt_id % 7 = 0 then 'untouched' when review_status = 'rejected' then 'kept_reviewed' else 'published' end as outcome, case when receipt_id % 7 = 0 or review_status = 'rejected' then total_minor else total_minor + 100 end as total_minor,
  case when receipt_id % 7 = 0 or review_status = 'rejected' then coalesce(n, 0) else 1 end as items
from receipts r left join (select l_orderkey, count(*) as n from lineitem group by 1) l on l.l_orderkey = r.receipt_id""", "receipts")
def snk_publish_receipt(ledger):
    old = ledger.receipts.select("receipt_id", "total_minor", (F.col("review_status") == "rejected").alias("by_user"))
    new = ledger.receipts.where("receipt_id % 7 <> 0").select("receipt_id", (F.col("total_minor") + 100).alias("total_minor"))
    had = ledger.table("lineitem").select(F.col("l_orderkey").alias("receipt_id"), F.col("l_linenumber").alias("position"))
    records, items = K.publish_receipt(old, new, had, new.select("receipt_id", F.lit(1).alias("position")))
    counts = items.groupBy("receipt_id").agg(F.count("*").alias("items"))
    return records.join(counts, "receipt_id", "left").select("receipt_id", "outcome", "total_minor", F.coalesce("items", F.lit(0)).alias("items"))


STALE = "origin = 'extraction' and review_status in ('proposed', 'needs_review') and account_id % 3 <> 0 and account_id % 5 <> 0"


@query("snk_publish_statement", f"""
select 'stays' as kind, cast(account_id as varchar) as id, count(*) as rows from transactions where not ({STALE}) group by 2
union all select case when account_id % 3 = 0 then 'kept_reviewed' else 'inserted' end, cast(account_id as varchar), 1 from accounts where account_id % 2 = 0 or account_id % 3 = 0
union all select 'duplicate', cast(account_id as varchar), 1 from accounts where account_id % 2 <> 0 and account_id % 3 <> 0 and account_id in (select account_id from transactions where not ({STALE}))
union all select 'inserted', cast(account_id as varchar), 1 from accounts where account_id % 2 <> 0 and account_id % 3 <> 0 and account_id not in (select account_id from transactions where not ({STALE}))""", "transactions", "accounts")
def snk_publish_statement(ledger):
    statement = F.col("account_id") * 10
    rows = ledger.transactions.select("transaction_id", "account_id", statement.alias("statement_id"), "origin", "review_status", F.lit(None).cast("string").alias("review_source"), F.lit("same").alias("fingerprint"))
    evidence = rows.select("transaction_id", F.when(F.col("account_id") % 5 == 0, "import:1").otherwise("extraction:2").alias("source_key"))
    statements = ledger.accounts.select(statement.alias("statement_id"), "account_id", "currency", (F.col("account_id") % 3 == 0).alias("by_user"))
    new = ledger.accounts.select(statement.alias("statement_id"), "account_id", F.when(F.col("account_id") % 2 == 0, "new").otherwise("same").alias("fingerprint"))
    stays, entered = K.publish_statement(rows, evidence, statements, ledger.accounts, new)
    kept = stays.groupBy("account_id").agg(F.count("*").alias("rows")).select(F.lit("stays").alias("kind"), F.col("account_id").cast("string").alias("id"), "rows")
    return kept.unionByName(entered.select(F.col("outcome").alias("kind"), F.col("account_id").cast("string").alias("id"), F.lit(1).cast("bigint").alias("rows")))


def _published(view, key, amount, guard):
    return f"""
select coalesce(o.{key}, n.{key}) as {key}, case when o.{key} is null then n.amount when n.{key} is null or {guard} then o.{amount} else n.amount end as amount_minor,
  case when o.{key} is null then 'created' when n.{key} is null then 'untouched' when {guard} then 'kept_reviewed' else 'replaced' end as outcome
from (select * from {view} where {key} % 6 <> 0) o full outer join (select {key}, {amount} + 7 as amount from {view} where {key} % 4 <> 0) n on n.{key} = o.{key}"""


def _publish(rows, key, amount, guard):
    old = rows.where(f"{key} % 6 <> 0").select(key, F.col(amount).alias("amount_minor"), guard.alias("by_user"))
    return V.publish(old, rows.where(f"{key} % 4 <> 0").select(key, (F.col(amount) + 7).alias("amount_minor")), key)


@query("snk_publish_bill", _published("bills", "bill_id", "amount_due_minor", "o.review_status = 'rejected'"), "bills")
def snk_publish_bill(ledger):
    return _publish(ledger.bills, "bill_id", "amount_due_minor", F.col("review_status") == "rejected")


INCOME = "(select posting_id as income_id, amount_minor, review_status from postings where amount_minor > 0)"


@query("snk_publish_income", _published(INCOME, "income_id", "amount_minor", "o.review_status = 'rejected'"), "postings")
def snk_publish_income(ledger):
    rows = ledger.postings.where("amount_minor > 0").withColumnRenamed("posting_id", "income_id")
    return _publish(rows, "income_id", "amount_minor", F.col("review_status") == "rejected")


@query("evidence", "select r.receipt_id, coalesce(array_to_string(list_sort(list(distinct l.match_method || ':' || cast(l.posting_id as varchar)) filter (where l.link_id is not null)), ','), '') as sources, count(distinct l.posting_id) as supported_by from receipts r left join receipt_links l on l.receipt_id = r.receipt_id group by 1", "receipts", "receipt_links")
def evidence(ledger):
    sources = ledger.receipt_links.select("receipt_id", F.concat("match_method", F.lit(":"), F.col("posting_id").cast("string")).alias("source_key"))
    return K.evidence_of(ledger.receipts, sources, "receipt_id").select("receipt_id", F.concat_ws(",", "sources").alias("sources"), F.col("supported_by").cast("bigint").alias("supported_by"))


@query("delete_budget", "select category, amount_minor from budgets where category <> (select min(category) from budgets)", "budgets")
def delete_budget(ledger):
    gone = ledger.budgets.agg(F.min("category").alias("category"))
    return ledger.budgets.join(gone, "category", "left_anti").select("category", "amount_minor")


@query("create_account", "select institution, account_type, currency, min(account_id) as account_id from accounts group by 1, 2, 3", "accounts")
def create_account(ledger):
    return O.created(ledger.accounts.limit(0), ledger.accounts)


@query("ledger_lists", "select account_id, string_agg(cast(statement_id as varchar) || ':' || review_status, ' ' order by statement_id) as history from statements group by 1", "statements")
def ledger_lists(ledger):
    from hearthbook.operators.library import history

    rows = history(ledger.statements, "account_id", "statement_id", "review_status")
    return rows.select("account_id", F.concat_ws(" ", F.transform("changes", lambda c: F.concat(c["statement_id"].cast("string"), F.lit(":"), c["review_status"]))).alias("history"))


# warranties, assets and check-ins ---------------------------------------------------


def _lots(ledger):
    return ledger.lots.select("lot_id", "bought_on", F.col("consumable"), (F.col("product_id") % 36).cast("int").alias("m"), "product_id")


@query("warranty_writes", """
select lot_id, kind, source, case when lifetime then null else cast(bought_on + to_months(months) as date) end as expires_on from (
  select lot_id, bought_on, 'manufacturer' as kind, 'user' as source, case when product_id % 36 = 0 then 600 else cast(product_id % 36 as int) end as months, false as lifetime from lots where not consumable and product_id % 2 = 0
  union all select lot_id, bought_on, 'manufacturer', 'lookup', 12, false from lots where not consumable and product_id % 2 = 1
  union all select lot_id, bought_on, 'store', 'lookup', null, true from lots where not consumable and product_id % 5 = 0) w""", "lots")
def warranty_writes(ledger):
    shape = lambda kind, months, lifetime, source, status, seq: F.struct(F.lit(kind).alias("kind"), months.cast("int").alias("months"), F.lit(lifetime).alias("lifetime"), F.lit(source).alias("source"), F.lit(status).alias("review_status"), F.lit(seq).alias("seq"))
    lots = kept(_lots(ledger))  # read three times below
    none = F.lit(None).cast("int")
    old = lots.where("not consumable").select("lot_id", shape("manufacturer", F.lit(6), False, "lookup", "proposed", 0).alias("w")).select("lot_id", "w.*")
    even = F.col("product_id") % 2 == 0
    entered = F.array(
        shape("manufacturer", F.lit(700), False, "user", "verified", 1), F.when(even, shape("manufacturer", F.when(F.col("m") == 0, 600).otherwise(F.col("m")), False, "user", "verified", 2)), shape("manufacturer", F.lit(12), False, "lookup", "proposed", 3),
        shape("gift", F.lit(12), False, "user", "verified", 4), F.when(F.col("product_id") % 5 == 0, shape("store", none, True, "lookup", "proposed", 5)),
    )
    new = lots.select("lot_id", F.explode(F.array_compact(entered)).alias("w")).select("lot_id", "w.*")
    return U.add_warranties(old, new, lots).select("lot_id", "kind", "source", "expires_on")


@query("op_warranty_propose", "select p_partkey, case p_size % 4 when 0 then null when 1 then 'not on the page' when 2 then 'not about a warranty' else 'another length' end as refused from part")
def op_warranty_propose(ledger):
    from hearthbook.functions.checks import warranty_refused

    quote = F.when(F.col("p_size") % 4 == 2, "comes with two-year care").otherwise("a two-year  limited WARRANTY")
    page = F.when(F.col("p_size") % 4 == 1, F.col("p_name")).otherwise(F.concat(F.col("p_name"), F.lit(" comes with two-year care and a two-year limited warranty.")))
    months = F.when(F.col("p_size") % 4 == 3, 12).otherwise(24)
    return ledger.table("part").select("p_partkey", warranty_refused(quote, page, months, F.lit(False)).alias("refused"))


@query("asset_writes", """
select account_id as asset_id, case when account_id % 3 = 1 then 'vehicle' else 'investment' end as kind, case when account_id % 3 = 1 then 500 else account_id end as value_minor, cast(case when account_id % 3 = 1 then case when account_id % 2 = 0 then -1500 else 612 end else 0 end as bigint) as annual_rate_bp,
  case when account_id % 7 = 0 then 'manual' else 'statement' end as source, case when account_id % 7 = 0 or account_id % 5 = 0 then 'verified' else 'proposed' end as review_status, account_id % 11 = 0 as archived
from accounts where account_id % 7 > 0 or account_id % 3 = 1""", "accounts")
def asset_writes(ledger):
    key, none = F.col("account_id"), F.lit(None)
    assets = ledger.accounts.where("account_id % 7 > 0").select(key.alias("asset_id"), F.lit("investment").alias("kind"), key.alias("value_minor"), F.lit(0).cast("bigint").alias("annual_rate_bp"), F.lit("statement").alias("source"), F.lit("proposed").alias("review_status"), F.lit(False).alias("archived"))
    make = lambda seq, action, kind=none, value=none, rate=none, status=none: F.struct(F.lit(seq).alias("seq"), F.lit(action).alias("action"), kind.cast("string").alias("kind"), value.cast("bigint").alias("value_minor"), rate.cast("string").alias("rate_percent"), none.cast("bigint").alias("payment_minor"), status.cast("string").alias("status"))
    rate = F.when(key % 2 == 1, "6.12")
    said = F.array(
        F.when(key % 3 == 1, F.when(key % 7 == 0, make(1, "add", F.lit("vehicle"), F.lit(500), rate)).otherwise(make(1, "update", F.lit("vehicle"), F.lit(500), rate))),
        make(2, "update", F.lit("castle"), F.lit(1)), make(3, "update", F.lit("bond"), F.lit(-1)), make(4, "update", F.lit("bond"), F.lit(1), F.lit("6.125")),
        F.when(key % 5 == 0, make(5, "review", status=F.lit("verified"))), F.when(key % 11 == 0, make(6, "archive")),
    )
    commands = ledger.accounts.select(key.alias("asset_id"), F.explode(F.array_compact(said)).alias("c")).select("asset_id", "c.*")
    return U.write_assets(assets, commands)


@query("view", "select account_id as asset_id, case when currency = 'JPY' then cast(account_id as varchar) else cast(account_id // 100 as varchar) || '.' || lpad(cast(account_id % 100 as varchar), 2, '0') end as value, case account_id % 3 when 0 then '6.12' when 1 then '-15' else '0.5' end as annual_rate_percent from accounts", "accounts")
def view(ledger):
    rate = F.element_at(F.array(F.lit(612), F.lit(-1500), F.lit(50)), (F.col("account_id") % 3 + 1).cast("int"))
    return U.asset_view(ledger.accounts.select(F.col("account_id").alias("asset_id"), F.col("account_id").alias("value_minor"), "currency", rate.alias("annual_rate_bp")))


@query("checkin_apply", "select lot_id, case when product_id % 4 = 0 then 'finished' else 'in_stock' end as status from lots where status = 'in_stock' and product_id % 2 = 0 and product_id % 3 > 0", "lots")
def checkin_apply(ledger):
    stock = ledger.lots.where("status = 'in_stock'")
    asked = stock.where("product_id % 2 = 0").select("lot_id", F.lit(1).alias("seq"), F.when(F.col("product_id") % 4 == 0, "finished_today").otherwise("still_have").alias("kind"))
    return O.apply_answers(asked, stock, stock.where("product_id % 3 = 0").select("lot_id"), "2000-06-30").select("lot_id", "status")


# the reconciliation's decisions -----------------------------------------------------


@query("op_reconcile_run")
def op_reconcile_run(ledger):
    """Every link that one whole pass makes, each step over what the ones before it left, and the questions it leaves open."""
    rules = ledger.sql(RULES)
    rows = ledger.postings.withColumn("origin", F.lit("import"))
    done = R.run(ledger.receipts, rows, ledger.accounts, rules, ledger.receipt_links)
    linked = lambda name, left, right: done[name].select(F.lit(name).alias("pass"), F.col(left).alias("left_id"), F.col(right).alias("right_id"), "score")
    links = linked("receipt_links", "receipt_id", "posting_id").unionByName(linked("transfers", "out_id", "in_id")).unionByName(linked("refunds", "credit_id", "purchase_id"))
    asked = done["issues"].select(F.col("issue_type").alias("pass"), F.col("record_id").alias("left_id"), F.explode("candidates").alias("right_id"), F.lit(None).cast("int").alias("score"))
    return links.unionByName(asked)


@query("op_link_choice", f"""
select receipt_id as record_id, posting_id, score, method || '+user_choice' as method, 'verified' as review_status from (
  select *, row_number() over (partition by receipt_id order by posting_id) as k from ({PAIRS}) p) s where k = 1 and receipt_id % 4 = 2
  and posting_id not in (select posting_id from receipt_links l where l.receipt_id <> s.receipt_id and l.review_status <> 'rejected')""", "receipts", "postings", "receipt_links")
def op_link_choice(ledger):
    found = R.receipt_candidates(ledger.receipts, ledger.postings)
    issues = found.groupBy(F.lit("ambiguous_receipt_match").alias("issue_type"), F.col("receipt_id").alias("record_id")).agg(F.array_sort(F.collect_list("posting_id")).alias("candidates")).withColumn("status", F.lit("open"))
    chosen = F.when(F.col("record_id") % 4 == 2, F.col("candidates")[0]).when(F.col("record_id") % 4 == 3, F.lit(-1))
    choices = issues.where("record_id % 4 > 0").select("issue_type", "record_id", F.lit(1).alias("seq"), chosen.alias("chosen"))
    taken = ledger.receipt_links.where("review_status <> 'rejected'").select("posting_id", "receipt_id")
    return R.choice_links(R.resolve_issues(issues, choices, ledger.postings, taken), found)


@query("recon_resolve", f"""
select receipt_id, case receipt_id % 4 when 0 then 'open' when 1 then 'left_unmatched' when 2 then case when exists (select 1 from receipt_links l where l.posting_id = s.last_one and l.receipt_id <> s.receipt_id and l.review_status <> 'rejected') then 'refused' else 'linked' end else 'refused' end as outcome
from (select receipt_id, max(posting_id) as last_one from ({PAIRS}) p group by 1) s""", "receipts", "postings", "receipt_links")
def recon_resolve(ledger):
    """Choices of a receipt's last candidate; issues that are closed already refuse any."""
    found = R.receipt_candidates(ledger.receipts, ledger.postings)
    issues = found.groupBy(F.lit("ambiguous_receipt_match").alias("issue_type"), F.col("receipt_id").alias("record_id")).agg(F.array_sort(F.collect_list("posting_id")).alias("candidates")).withColumn("status", F.when(F.col("record_id") % 4 == 3, "resolved").otherwise("open"))
    choices = issues.where("record_id % 4 > 0").select("issue_type", "record_id", F.lit(1).alias("seq"), F.when(F.col("record_id") % 4 > 1, F.element_at("candidates", -1)).alias("chosen"))
    return R.resolve_issues(issues, choices, ledger.postings, ledger.receipt_links.where("review_status <> 'rejected'").select("posting_id", "receipt_id")).select(F.col("record_id").alias("receipt_id"), "outcome")


@query("recon_txn", "select p.posting_id, a.account_type from postings p join accounts a on a.account_id = p.account_id", "postings", "accounts")
def recon_txn(ledger):
    return ledger.postings.select("posting_id", "account_id").join(ledger.accounts.select("account_id", "account_type"), "account_id").select("posting_id", "account_type")


@query("recon_history", "select event_id, event_type from events order by event_id desc limit 20")
def recon_history(ledger):
    from hearthbook.operators.library import event_page

    return event_page(ledger.table("events").select("event_id", "event_type"), None, 20)


OBLIGATIONS = RECURRING.replace("{source}", COARSE_SQL)


@query("win_reprice_dup", f"select account_id, merchant_key, currency, frequency, expected_minor, next_due_date from ({OBLIGATIONS}) o", "transactions")
def win_reprice_dup(ledger):
    return win_recurring(ledger).select("account_id", "merchant_key", "currency", "frequency", "expected_minor", "next_due_date")


@query("op_review_obligation", f"""
select account_id, merchant_key, currency, frequency, case when account_id % 5 in (1, 2, 3) then 500 else 1000 end as expected_minor, case account_id % 5 when 1 then 'verified' when 2 then 'rejected' when 3 then 'ended' else 'proposed' end as status from ({OBLIGATIONS}) o""", "transactions")
def op_review_obligation(ledger):
    found = win_recurring(ledger)
    old = found.select("account_id", "merchant_key", "currency", "frequency", F.lit(500).cast("bigint").alias("expected_minor"), "next_due_date", F.lit("proposed").alias("status"))
    word = F.element_at(F.array(*map(F.lit, ("perhaps", "verified", "rejected", "ended", "proposed"))), (F.col("account_id") % 5 + 1).cast("int"))
    decided = R.review_obligations(old, found.select("account_id", "merchant_key", "currency", "frequency", F.lit(1).alias("seq"), word.alias("decision")))
    return R.merge_obligations(decided, found).select("account_id", "merchant_key", "currency", "frequency", "expected_minor", "status")


@query("flt_accounts_words", "select account_id from accounts where contains(lower(display_name || ' ' || institution), 'nation_1') and contains(lower(display_name || ' ' || institution), '7')", "accounts")
def flt_accounts_words(ledger):
    text = F.lower(F.concat_ws(" ", "display_name", "institution"))
    return ledger.accounts.where(F.forall(F.array(F.lit("nation_1"), F.lit("7")), lambda w: F.contains(text, w))).select("account_id")


@query("srt_python", "select currency, category, spending from (select currency, coalesce(category, 'uncategorized') as category, cast(sum(-amount_minor) as bigint) as spending from transactions where amount_minor < 0 group by 1, 2) s order by currency, spending desc, category", "transactions")
def srt_python(ledger):
    sums = ledger.transactions.where("amount_minor < 0").groupBy("currency", F.coalesce("category", F.lit("uncategorized")).alias("category")).agg(F.sum(-F.col("amount_minor")).cast("bigint").alias("spending"))
    return sums.orderBy("currency", F.desc("spending"), "category")


@query("udf_scalar", "select p_partkey, trim(regexp_replace(regexp_replace(upper(p_name || ' #12, inc.'), '#\\s*\\d+|\\b\\d+\\b|[^\\w\\s&]', ' ', 'g'), '\\bINC\\b|\\s+', ' ', 'g')) as merchant_key from part")
def udf_scalar(ledger):
    from hearthbook.plans.tools import register_functions

    register_functions(ledger.spark)
    return ledger.table("part").selectExpr("p_partkey", "normalized_name(concat(p_name, ' #12, inc.')) as merchant_key")


@query("fn_month_end", "select o_orderkey, last_day(o_orderdate) as month_end, cast(o_orderdate + to_months(cast(o_orderkey % 14 as int)) as date) as later, cast(o_orderdate as date) + 5 as shifted from orders")
def fn_month_end(ledger):
    from hearthbook.functions.dates import add_months, month_end

    day = F.col("o_orderdate").cast("date")
    return ledger.table("orders").select("o_orderkey", month_end(day).alias("month_end"), add_months(day, (F.col("o_orderkey") % 14).cast("int")).alias("later"), F.date_add(day, 5).alias("shifted"))


@query("prj_amount_text", "select bill_id, case when currency = 'JPY' then cast(amount_due_minor as varchar) else cast(amount_due_minor // 100 as varchar) || '.' || lpad(cast(amount_due_minor % 100 as varchar), 2, '0') end as amount_due from bills", "bills")
def prj_amount_text(ledger):
    return ledger.bills.select("bill_id", decimal_text(F.col("amount_due_minor"), F.col("currency")).alias("amount_due"))

