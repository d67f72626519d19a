"""Ledger views over the driver's tables.

The only module that knows those tables.  Each view is one SQL text that Spark
and the checking engine both accept; ``Ledger`` gives it as a DataFrame,
``with_views`` as common table expressions.
"""

from __future__ import annotations

import re
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages", "labels", "conversations")
_CURRENCY = "case c_nationkey % 3 when 0 then 'USD' when 1 then 'EUR' else 'JPY' end"
_BUCKET = "(cast(round(o_totalprice * 100) as bigint) - cast(round(o_totalprice * 100) as bigint) % 100000)"

#: An eight-digit code of a part, and its check digit.
_BASE = "substr(cast(10000000 + p_partkey % 9999999 as string), 2)"
_CHECK = "cast((10 - (" + " + ".join(f"{3 if k % 2 else 1} * cast(substr({_BASE}, {k}, 1) as int)" for k in range(1, 8)) + ") % 10) % 10 as string)"

VIEWS: dict[str, tuple[tuple[str, ...], str]] = {
    "accounts": ((), f"""
        select c_custkey as account_id, n_name as institution,
               case c_mktsegment when 'AUTOMOBILE' then 'checking' when 'BUILDING' then 'savings' when 'MACHINERY' then 'credit_card' when 'HOUSEHOLD' then 'loan' else 'other' end as account_type,
               {_CURRENCY} as currency, n_name || ' ' || cast(c_custkey % 10000 as string) as display_name
        from customer join nation on n_nationkey = c_nationkey"""),
    "merchants": ((), "select min(p_partkey) as merchant_id, upper(p_name) as canonical_name from part group by upper(p_name)"),
    "transactions": ((), f"""
        select concat_ws('-', cast(l_orderkey as string), cast(l_linenumber as string), cast(l_partkey as string), cast(l_suppkey as string),
                         cast(cast(round(l_extendedprice * 100) as bigint) as string), cast(cast(l_shipdate as date) as string)) as transaction_id,
               o_custkey as account_id, cast(l_shipdate as date) as posted_date,
               upper(p_name) || ' #' || cast(l_suppkey as string) as description_raw, upper(p_name) as merchant,
               {_CURRENCY} as currency,
               case when l_returnflag = 'R' then 'refund'
                    when l_returnflag = 'A' and l_linestatus = 'O' then case when l_linenumber % 2 = 0 then 'payment' else 'transfer' end
                    when l_linenumber = 7 then 'deposit' when l_linenumber = 6 then 'fee' when l_linenumber = 5 then 'interest'
                    when l_linenumber = 4 then 'withdrawal' else 'purchase' end as transaction_type,
               (case when l_returnflag = 'R' then 1 when l_returnflag = 'A' and l_linestatus = 'O' then case when l_linenumber % 3 = 0 then 1 else -1 end
                     when l_linenumber = 7 then 1 else -1 end) * cast(round(l_extendedprice * 100) as bigint) as amount_minor,
               case when p_size % 5 = 0 then null else lower(p_type) end as category,
               case when l_linestatus = 'O' and l_linenumber % 2 = 0 then 'extraction' else 'import' end as origin,
               case l_suppkey % 4 when 0 then 'proposed' when 1 then 'needs_review' when 2 then 'verified' else 'rejected' end as review_status
        from lineitem join orders on o_orderkey = l_orderkey join customer on c_custkey = o_custkey join part on p_partkey = l_partkey"""),
    "receipts": ((), f"""
        select o_orderkey as receipt_id, upper(n_name) as merchant, cast(o_orderdate as date) as purchase_date, {_CURRENCY} as currency,
               {_BUCKET} as total_minor, case when o_orderkey % 5 = 0 then 'rejected' else 'proposed' end as review_status
        from orders join customer on c_custkey = o_custkey join nation on n_nationkey = c_nationkey"""),
    "postings": ((), f"""
        select o_orderkey as posting_id, o_custkey as account_id, cast(o_orderdate as date) + cast(o_orderkey % 7 as int) as posted_date, {_CURRENCY} as currency,
               upper(n_name) || ' STORE #' || cast(o_orderkey as string) as description_raw,
               case when o_orderkey % 9 = 4 then 1 else -1 end * {_BUCKET} as amount_minor,
               case o_orderkey % 10 when 1 then 'transfer' when 2 then 'payment' else 'purchase' end as transaction_type,
               case when o_orderkey % 8 = 0 then 'rejected' else 'proposed' end as review_status
        from orders join customer on c_custkey = o_custkey join nation on n_nationkey = c_nationkey"""),
    "receipt_links": ((), """
        select o_orderkey * 2 + k as link_id, o_orderkey as receipt_id, o_orderkey + k as posting_id, 60 + cast(o_orderkey % 5 as int) * 10 as score, 'amount+merchant' as match_method,
               case when o_orderkey % 4 = 1 then 'rejected' when (o_orderkey + k) % 7 = 0 then 'rejected' when (o_orderkey + k) % 7 = 1 then 'verified' else 'proposed' end as review_status
        from orders cross join (select 0 as k union all select 1) steps"""),
    "bills": ((), f"""
        select o_orderkey as bill_id, upper(n_name) as provider, cast(o_orderdate as date) as issue_date, cast(o_orderdate as date) + 30 as due_date, {_CURRENCY} as currency,
               {_BUCKET} as amount_due_minor, case o_orderkey % 4 when 1 then 'paid' when 2 then 'unpaid' else 'unknown' end as payment_status,
               case when o_orderkey % 13 = 0 then 'rejected' else 'proposed' end as review_status
        from orders join customer on c_custkey = o_custkey join nation on n_nationkey = c_nationkey"""),
    "statements": ((), f"""
        select c_custkey * 10 + k as statement_id, c_custkey as account_id, date '2000-01-31' + cast(30 * (k - k % 2) as int) as period_end, {_CURRENCY} as currency,
               cast(round(c_acctbal * 100) as bigint) + 1000 * k as closing_balance_minor, case when (c_custkey + k) % 6 = 0 then 'rejected' else 'verified' end as review_status
        from customer cross join (select 0 as k union all select 1 union all select 2 union all select 3) steps"""),
    "budgets": ((), """
        select lower(p_type) as category, 'USD' as currency, cast(sum(cast(round(p_retailprice * 100) as bigint)) as bigint) as amount_minor from part where p_size % 3 <> 0 and p_type <> (select min(p_type) from part) group by lower(p_type)"""),
    "lots": ((), f"""
        select concat_ws('-', cast(l_orderkey as string), cast(l_linenumber as string), cast(l_partkey as string), cast(l_suppkey as string), cast(cast(round(l_extendedprice * 100) as bigint) as string), cast(cast(l_shipdate as date) as string)) as lot_id,
               l_partkey as product_id, p_name as name, case when p_partkey % 10 = 0 then null else p_brand end as brand,
               case p_size % 5 when 0 then 'assorted' when 1 then cast(p_size as string) || ' oz' when 2 then '6 x ' || cast(p_size as string) || ' fl oz' when 3 then cast(p_size as string) || ' ct' else cast(p_size as string) || '.5 kg' end as size_text,
               lower(p_type) as category, upper(n_name) as merchant, {_CURRENCY} as currency, cast(round(l_extendedprice * 100) as bigint) as cost_minor,
               p_size % 3 <> 0 as consumable, case when l_linenumber = 3 then null else cast(cast(l_quantity as int) as string) end as units, cast(l_shipdate as date) as bought_on,
               case when l_linestatus = 'F' then cast(l_shipdate as date) + cast(l_quantity as int) end as closed_on,
               case when l_linestatus <> 'F' then 'in_stock' when l_returnflag = 'R' then 'thrown_out' else 'finished' end as status
        from lineitem join part on p_partkey = l_partkey join supplier on s_suppkey = l_suppkey join nation on n_nationkey = s_nationkey
             join orders on o_orderkey = l_orderkey join customer on c_custkey = o_custkey"""),
    "lines": ((), f"""
        select concat_ws('-', cast(l_orderkey as string), cast(l_linenumber as string), cast(l_partkey as string), cast(l_suppkey as string), cast(cast(round(l_extendedprice * 100) as bigint) as string), cast(cast(l_shipdate as date) as string)) as line_id,
               l_orderkey as receipt_id, l_linenumber as position, upper(n_name) as merchant, p_name || ' ' || p_type as description,
               case p_partkey % 3 when 0 then cast(p_partkey % 500 as string) when 1 then {_BASE} || {_CHECK} end as product_code,
               p_name as name, p_brand as brand, cast(p_size as string) || ' oz' as size_text, lower(p_type) as category, p_size % 3 <> 0 as consumable, cast(round(l_extendedprice * 100) as bigint) as cost_minor,
               case l_suppkey % 4 when 0 then 'proposed' when 1 then 'verified' when 2 then 'rejected' else 'none' end as resolution
        from lineitem join part on p_partkey = l_partkey join supplier on s_suppkey = l_suppkey join nation on n_nationkey = s_nationkey"""),
    "aliases": ((), f"""
        select p_partkey as alias_id, upper(n_name) as merchant, upper(p_name || ' ' || p_type) as text, cast(p_partkey % 500 as string) as code, p_partkey as product, {_BASE} || {_CHECK} as barcode
        from part join nation on n_nationkey = p_partkey % 25"""),
    "entries": ((), """
        select event_id as source_row, user_id as account_id, cast(ts as date) as posted_date, event_type || ' ' || cast(user_id as string) as description_raw,
               cast(floor(value) as int) * case when event_type = 'purchase' then -1 else 1 end as amount_minor, 'USD' as currency, cast(event_id % 2 as int) as source
        from events"""),
    "files": ((), """
        select d.doc_id, d.source, source || '/' || cast(d.doc_id as string) || case d.doc_id % 4 when 0 then '.PDF' when 1 then '.jpg' when 2 then '.csv' else '' end as relative_path, d.lang, d.n_chars,
               l.quality, l.toxic, case when d.doc_id % 17 = 0 then 1 else 0 end as trashed
        from documents d left join labels l on l.doc_id = d.doc_id"""),
    "questions": ((), "select conv_id, turn, text from conversations where role = 'user'"),
}


def with_views(body: str, *names: str) -> str:
    """body after the common table expressions of the named views."""
    return "with " + ",\n".join(f"{n} as ({VIEWS[n][1]})" for n in names) + "\n" + body if names else body


class Ledger:
    """The tables of one folder, and every view of them as a DataFrame attribute."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def _tables(self) -> dict[str, DataFrame]:
        return {}

    def __getattr__(self, name: str) -> DataFrame:
        if name not in VIEWS:
            raise AttributeError(name)
        return self.sql(VIEWS[name][1])

    def related(self, name: str, body: str) -> DataFrame:
        """A further view over the views that body reads."""
        used = [v for v in VIEWS if re.search(rf"\b(from|join) {v}\b", body)]
        return self.sql(with_views(body, *used))

    def sql(self, text: str) -> DataFrame:
        """Spark SQL over the folder's tables, which are named in it without registering anything for good."""
        used = {}
        for table in TABLES:
            marked = _marked(text, table)
            if marked != text:
                text = marked
                used[table] = self.table(table)
        return self.spark.sql(text, **used)


def _marked(text: str, table: str) -> str:
    return re.sub(rf"(?<=\bfrom )\b{table}\b|(?<=\bjoin )\b{table}\b", "{" + table + "}", text)
