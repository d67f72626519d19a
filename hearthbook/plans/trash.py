"""Registered query of emptying the trash over eight related views."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearthbook.operators import trash as T
from hearthbook.plans.registry import query

#: Views of one small archive: documents share contents, statements hold transactions, bills name payments.
RELATED = {
    "documents": "select doc_id as id, trashed from files",
    "versions": "select doc_id * 2 + k as id, doc_id as document_id, 'c' || cast((doc_id * (k + 1)) % 150 as string) as hash from files cross join (select 0 as k union all select 1) steps",
    "statements": "select statement_id as id, statement_id % 200 as document_id, 'c' || cast(statement_id % 170 as string) as hash from statements",
    "transactions": "select posting_id as id, case posting_id % 3 when 0 then null else posting_id % 200 end as source_document_id, account_id * 10 + posting_id % 4 as statement_id from postings",
    "receipts": "select receipt_id as id, receipt_id % 190 as document_id, 'c' || cast(receipt_id % 160 as string) as hash from receipts",
    "bills": "select bill_id as id, bill_id % 180 as document_id, cast(null as string) as hash, case when bill_id % 2 = 0 then bill_id end as payment_id, payment_status from bills",
    "evidence": "select posting_id * 2 as id, 'transaction' as record_type, posting_id as record_id, posting_id * 7 % 200 as document_id, 'c' || cast(posting_id % 155 as string) as hash from postings where posting_id % 5 = 0 union all select bill_id * 2 + 1, 'bill', bill_id, bill_id * 3 % 200, 'c' || cast(bill_id % 165 as string) from bills where bill_id % 4 = 1",
    "links": "select link_id as id, receipt_id, posting_id as transaction_id from receipt_links",
    "issues": "select posting_id * 3 as id, 'transaction' as record_type, posting_id as record_id from postings where posting_id % 6 = 1 union all select receipt_id * 3 + 1, 'receipt', receipt_id from receipts where receipt_id % 6 = 2 union all select statement_id * 3 + 2, 'statement', statement_id from statements where statement_id % 6 = 3",
}
_FIELDS = {"documents": (), "versions": ("document_id",), "statements": ("document_id",), "transactions": ("source_document_id", "statement_id"), "receipts": ("document_id",), "bills": ("document_id", "payment_id", "payment_status"), "evidence": ("document_id",), "links": (), "issues": ()}


def _heir(column: str, *ways: str) -> str:
    """column, or where it names a document of the trash, the least living one of ways, if any."""
    found = " union all ".join(ways)
    return f"case when {column} in (select id from gone) then coalesce((select min(d) from ({found}) w), {column}) else {column} end"


def _shown(table: str) -> str:
    fields = [f"cast({f} as varchar)" for f in _FIELDS[table]] + ["cast(null as varchar)"] * (3 - len(_FIELDS[table]))
    return f"select '{table}' as kind, id, " + ", ".join(f"{f} as {n}" for f, n in zip(fields, ("a", "b", "c"), strict=True))


_VOUCHERS = "select e.document_id as d from r_evidence e where e.record_type = '{kind}' and e.record_id = t.id and e.document_id not in (select id from gone)"
_ALIKE = "select s.heir as d from same s where s.hash = t.hash"
SQL = f"""
select * from (with {", ".join(f"r_{t} as ({body})" for t, body in RELATED.items())},
gone as (select id from r_documents where trashed = 1),
same as (select hash, min(document_id) as heir from r_versions where document_id not in (select id from gone) group by 1),
p_statements as (select id, {_heir("t.document_id", _VOUCHERS.format(kind="statement"), _ALIKE)} as document_id from r_statements t),
p_receipts as (select id, {_heir("t.document_id", _VOUCHERS.format(kind="receipt"), _ALIKE)} as document_id from r_receipts t),
p_bills as (select id, {_heir("t.document_id", _VOUCHERS.format(kind="bill"), _ALIKE)} as document_id, payment_id, payment_status from r_bills t),
p_transactions as (select id, {_heir("t.source_document_id", _VOUCHERS.format(kind="transaction"), "select s.heir as d from same s join r_evidence e on e.hash = s.hash where e.record_type = 'transaction' and e.record_id = t.id")} as source_document_id, statement_id from r_transactions t),
p_evidence as (select id, record_type, record_id, {_heir("t.document_id", _ALIKE)} as document_id from r_evidence t),
g_statements as (select id from p_statements where document_id in (select id from gone)),
g_transactions as (
  select id from p_transactions where source_document_id in (select id from gone)
  union select id from p_transactions t where statement_id in (select id from g_statements) and source_document_id is null
    and not exists (select 1 from p_evidence e where e.record_type = 'transaction' and e.record_id = t.id and e.document_id not in (select id from gone))),
g_receipts as (select id from p_receipts where document_id in (select id from gone)),
g_bills as (select id from p_bills where document_id in (select id from gone)),
g_records as (select 'statement' as record_type, id as record_id from g_statements union all select 'transaction', id from g_transactions union all select 'receipt', id from g_receipts union all select 'bill', id from g_bills)
{_shown("documents")} from r_documents where id not in (select id from gone)
union all {_shown("versions")} from r_versions where document_id not in (select id from gone)
union all {_shown("statements")} from p_statements where id not in (select id from g_statements)
union all select 'transactions', id, cast(source_document_id as varchar), case when statement_id in (select id from g_statements) then null else cast(statement_id as varchar) end, null from p_transactions where id not in (select id from g_transactions)
union all {_shown("receipts")} from p_receipts where id not in (select id from g_receipts)
union all select 'bills', id, cast(document_id as varchar), case when payment_id in (select id from g_transactions) then null else cast(payment_id as varchar) end, case when payment_id in (select id from g_transactions) then 'unknown' else payment_status end from p_bills where id not in (select id from g_bills)
union all {_shown("evidence")} from p_evidence t where document_id not in (select id from gone) and not exists (select 1 from g_records g where g.record_type = t.record_type and g.record_id = t.record_id)
union all {_shown("links")} from r_links where receipt_id not in (select id from g_receipts) and transaction_id not in (select id from g_transactions)
union all {_shown("issues")} from r_issues t where not exists (select 1 from g_records g where g.record_type = t.record_type and g.record_id = t.record_id)) x"""


@query("snk_cascade_delete", SQL, "files", "statements", "receipts", "postings", "bills", "receipt_links")
def snk_cascade_delete(ledger):
    """Every row that is left of nine related tables, with its document and references."""
    tables = {name: ledger.related(name, body) for name, body in RELATED.items()}
    left = T.empty_trash(tables, tables["documents"].where("trashed = 1"))

    def shown(name: str) -> DataFrame:
        fields = [F.col(f).cast("string") for f in _FIELDS[name]] + [F.lit(None).cast("string")] * (3 - len(_FIELDS[name]))
        return left[name].select(F.lit(name).alias("kind"), "id", *(f.alias(n) for f, n in zip(fields, ("a", "b", "c"), strict=True)))

    return reduce(DataFrame.unionAll, map(shown, _FIELDS))
