"""Registered queries of imported files, extraction checks and the library's reads and writes."""

from __future__ import annotations

import datetime as dt
import io
import zipfile

import pandas as pd
from pyspark.sql import functions as F

from hearthbook.functions import checks as C
from hearthbook.operators import extraction as X
from hearthbook.operators import library as L
from hearthbook.plans import tools
from hearthbook.plans.registry import query
from hearthbook.plans.tables import RUNS, _runs
from hearthbook.sources import tabular

# imports: one file a customer, of all of its orders ----------------------------------

MINOR = "cast(round(o_totalprice * 100) as bigint)"


def _listed(ledger):
    """(path, lines): each customer's orders as printed cells, in order of their keys."""
    text = F.concat(F.expr("minor div 100"), F.lit("."), F.lpad(F.expr("minor % 100").cast("string"), 2, "0"))
    rows = ledger.sql(f"select o_custkey, o_orderkey, o_orderdate, {MINOR} as minor from orders")
    cells = F.struct("o_orderkey", F.date_format("o_orderdate", "M/d/yyyy").alias("date"), F.concat(F.lit("Shop "), F.col("o_orderkey")).alias("said"), F.concat(F.lit("-"), text).alias("amount"))
    return rows.groupBy("o_custkey").agg(F.array_sort(F.collect_list(cells)).alias("cells"))


def _csv(ledger):
    """A bank's title line, an empty line, the header and the rows; one file in three names debits, one in eleven has no header."""
    head = F.when(F.col("o_custkey") % 11 == 5, "When,What,How much").when(F.col("o_custkey") % 3 == 0, "Trans. date,Transaction description,Debits").otherwise("Posted Date,Payee,Amount (USD)")
    rows = F.transform("cells", lambda c: F.concat(c["date"], F.lit(',"'), c["said"], F.lit('",'), c["amount"]))
    text = F.concat_ws("\n", F.lit("My bank"), F.lit(""), head, F.array_join(rows, "\n"), F.lit(",,"))
    return _listed(ledger).select(F.concat(F.lit("c"), F.col("o_custkey"), F.lit(".csv")).alias("path"), F.encode(text, "UTF-8").alias("content"))


FILES = f"""select 'c' || cast(o_custkey as varchar) || '.csv' as path, o_custkey % 11 = 5 as headless, max(day(o_orderdate)) > 12 as sure, count(*) as n, cast(sum({MINOR}) as bigint) as total from orders group by o_custkey"""


@query("src_csv", f"select path, case when headless then 0 else n end as rows, case when headless then 'no header with a date and an amount' end as problem from ({FILES}) f")
def src_csv(ledger):
    rows = tabular.read_files(_csv(ledger))
    return rows.groupBy("path").agg(F.sum((F.col("date") != "").cast("int")).alias("n"), F.max("problem").alias("problem")).select("path", F.coalesce("n", F.lit(0)).alias("rows"), "problem")


@query("src_header", "select 'c' || cast(o_custkey as varchar) || '.csv' as path, min(case when o_custkey % 11 = 5 then 0 else 4 end) as first_row from orders group by 1")
def src_header(ledger):
    return tabular.read_files(_csv(ledger)).groupBy("path").agg(F.min("row").alias("first_row"))


@query("src_detect", "select path, case when headless then null when o % 3 = 0 then 'debit' else 'amount' end as scheme from (select *, cast(regexp_extract(path, '\\d+') as bigint) as o from (" + FILES + ")) f")
def src_detect(ledger):
    rows = tabular.read_files(_csv(ledger)).groupBy("path").agg(F.max("amount").alias("a"), F.max("debit").alias("d"))
    return rows.select("path", F.when(F.col("d").isNotNull(), "debit").when(F.col("a").isNotNull(), "amount").alias("scheme"))


@query("src_mapping", f"select path, case when headless or debit then 0 else n end as rows, case when headless or debit then 0 else total end as total, case when headless then 'no header with a date and an amount' when debit then 'column not in file: Posted Date' end as problem from (select *, cast(regexp_extract(path, '\\d+') as bigint) % 3 = 0 as debit from ({FILES})) f")
def src_mapping(ledger):
    """A third of the files has other columns than the ones chosen, which is their problem."""
    chosen = tabular.Mapping(date="Posted Date", description="Payee", amount="Amount (USD)", order="MDY", outflow_positive=True)
    printed = tabular.read_files(_csv(ledger), chosen)
    sums = tabular.imported(printed, "USD", chosen).groupBy("path").agg(F.count("amount_minor").alias("rows"), F.coalesce(F.sum("amount_minor"), F.lit(0)).cast("bigint").alias("total"))
    return sums.join(printed.groupBy("path").agg(F.max("problem").alias("problem")), "path")


@query("preview_import", f"""
select path, case when headless or not sure then 'question' else 'preview' end as outcome, case when headless then 'no header with a date and an amount' when not sure then 'choose the date order' end as question,
  case when headless or not sure then 0 else n end as parsed, case when headless or not sure then 0 else 1 end as blank, cast(0 as bigint) as inflow, case when headless or not sure then 0 else total end as outflow from ({FILES}) f""")
def preview_import(ledger):
    return tabular.preview(_csv(ledger), "USD").drop("rejected")


@query("src_blob_verified", "select 'c' || cast(o_custkey as varchar) || '.csv' as path from orders group by 1")
def src_blob_verified(ledger):
    return tabular.verified(_csv(ledger).withColumn("hash", F.sha2("content", 256))).select("path")


def _workbook(cells) -> bytes:
    """A workbook whose second part by name is its first sheet: serial dates, shared and inline strings, cached values."""
    space = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    rows = ['<row><c r="A1" t="s"><v>0</v></c><c r="B1" t="s"><v>1</v></c><c r="D1" t="s"><v>2</v></c></row>']
    for k, c in enumerate(cells, 2):
        month, day, year = map(int, c["date"].split("/"))
        serial = (dt.date(year, month, day) - dt.date(1899, 12, 30)).days
        rows.append(f'<row><c r="A{k}" s="1"><v>{serial}</v></c><c r="B{k}" t="inlineStr"><is><t>{c["said"]}</t></is></c><c r="D{k}"><f>1+1</f><v>{c["amount"]}</v></c></row>')
    parts = {
        "xl/workbook.xml": f'<workbook {space}><sheets><sheet name="x" sheetId="1" r:id="r2"/><sheet name="y" sheetId="2" r:id="r1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Target="worksheets/a.xml"/><Relationship Id="r2" Target="worksheets/b.xml"/></Relationships>',
        "xl/styles.xml": f'<styleSheet {space}><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/></cellXfs></styleSheet>',
        "xl/sharedStrings.xml": f"<sst {space}><si><t>Booking Date</t></si><si><t>Narrative</t></si><si><t>Amount</t></si></sst>",
        "xl/worksheets/a.xml": f"<worksheet {space}><sheetData/></worksheet>", "xl/worksheets/b.xml": f"<worksheet {space}><sheetData>{''.join(rows)}</sheetData></worksheet>",
    }
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w", zipfile.ZIP_DEFLATED) as archive:
        for name, text in parts.items():
            archive.writestr(name, text)
    return held.getvalue()


@query("src_xlsx", f"select 'c' || cast(o_custkey as varchar) || '.xlsx' as path, count(*) as rows, cast(-sum({MINOR}) as bigint) as total, min(cast(o_orderdate as date)) as first_day from orders group by 1")
def src_xlsx(ledger):
    def run(batches):
        for batch in batches:
            yield pd.DataFrame({"path": [f"c{k}.xlsx" for k in batch["o_custkey"]], "content": [_workbook(c) for c in batch["cells"]]})

    files = _listed(ledger).mapInPandas(run, "path string, content binary")
    rows = tabular.imported(tabular.read_files(files), "USD")
    return rows.groupBy("path").agg(F.count("amount_minor").alias("rows"), F.sum("amount_minor").cast("bigint").alias("total"), F.min("posted_date").alias("first_day"))


# extraction checks -----------------------------------------------------------------


@query("fn_decimals_in", "select o_orderkey, cast(o_custkey as varchar) || case when o_orderkey <> o_custkey then ' ' || cast(o_orderkey as varchar) else '' end as figures from orders")
def fn_decimals_in(ledger):
    found = C.decimals_in(F.concat(F.lit("Order "), F.col("o_custkey"), F.lit(" of $"), F.col("o_orderkey"), F.lit(".00, again "), F.col("o_custkey")))
    bare = F.transform(found, lambda d: d.cast("bigint").cast("string"))
    return ledger.table("orders").select("o_orderkey", F.concat_ws(" ", F.array_distinct(bare)).alias("figures"))


LINE = "case l_linenumber % 3 when 0 then 'T = GA TAX 3.75 on $' || cast(l_orderkey as {s}) || ' $0.34' when 1 then 'Subtotal' else cast(l_partkey as {s}) || '.50 due' end"


@query("fn_line_amount", "select l_orderkey, l_linenumber, max(case l_linenumber % 3 when 0 then 34 when 1 then null else l_partkey * 100 + 50 end) as cents from lineitem group by 1, 2")
def fn_line_amount(ledger):
    rows = ledger.sql(f"select l_orderkey, l_linenumber, {LINE.format(s='string')} as quote from lineitem")
    return rows.groupBy("l_orderkey", "l_linenumber").agg(F.max((C.line_amount(F.col("quote")) * 100).cast("bigint")).alias("cents"))


@query("fn_amount_supported", "select p_partkey, p_size % 4 < 2 or (p_size % 4 = 3 and p_partkey + 5 in (3, 4)) as supported from part")
def fn_amount_supported(ledger):
    parts = F.array(F.concat(F.lit("rate 3% $"), F.col("p_partkey"), F.lit(".25")), F.concat(F.lit("rate 4% $"), F.col("p_partkey"), F.lit(".50")))
    sums = F.concat(2 * F.col("p_partkey"), F.lit(".75"))
    value = F.element_at(F.array(F.concat(F.lit("$"), F.col("p_partkey"), F.lit(".5")), sums, F.concat(sums, F.lit(" or 1")), F.concat(F.col("p_partkey") + 5, F.lit(".00"))), (F.col("p_size") % 4 + 1).cast("int"))
    return ledger.table("part").select("p_partkey", C.amount_supported(value, parts).alias("supported"))


@query("fn_name_supported", "select p_partkey, p_size % 3 = 0 or (p_size % 3 = 2 and length(split_part(p_name, ' ', 1)) >= 4) as supported from part")
def fn_name_supported(ledger):
    first = F.split("p_name", " ")[0]
    quote = F.when(F.col("p_size") % 3 == 0, F.concat(F.lit("Thank you, "), first, F.lit("!"))).when(F.col("p_size") % 3 == 1, "Thank you!").otherwise(F.concat(F.lit("www.in"), first, F.lit(".com")))
    return ledger.table("part").select("p_partkey", C.name_supported(first, F.array(F.lit("HELLO"), quote), ascii_only=True).alias("supported"))


@query("fn_title_repeat", "select p_partkey, p_size % 4 <> 2 as repeats from part")
def fn_title_repeat(ledger):
    text = F.element_at(F.array(F.concat(F.lit("the "), F.col("p_name")), F.concat(F.col("p_name"), F.lit(" run")), F.lit("Home goods"), F.concat(F.lit("more of "), F.col("p_name"))), (F.col("p_size") % 4 + 1).cast("int"))
    return ledger.table("part").select("p_partkey", X.repeats_title(text, F.concat(F.lit("The "), F.col("p_name")), ascii_only=True).alias("repeats"))


@query("fn_clean_description", "select p_partkey, case p_size % 5 when 0 then 'Garden tools' when 1 then 'Paint & brushes' end as description from part")
def fn_clean_description(ledger):
    text = F.element_at(F.array(F.lit(" garden  tools. "), F.lit("paint & brushes"), F.lit("2 shirts"), F.lit("a purchase"), F.concat(F.col("p_name"), F.lit(" order"))), (F.col("p_size") % 5 + 1).cast("int"))
    return ledger.table("part").select("p_partkey", X.clean_description(text, F.col("p_name"), ascii_only=True).alias("description"))


@query("fn_currency_for", """
select c_custkey, case c_custkey % 7 when 0 then 'EUR' when 1 then null when 2 then 'GBP' when 3 then 'CAD' when 4 then 'USD' end as currency, case c_custkey % 7 when 0 then 'printed' when 2 then 'account' when 3 then 'home' when 4 then 'assumed' end as source from customer""")
def fn_currency_for(ledger):
    k = F.col("c_custkey") % 7
    printed = F.when(k == 0, "eur").when(k == 1, "dollars")
    account, home = F.when(k == 2, "GBP"), F.when(k.isin(3, 5), "CAD")
    lines = F.when(k == 3, F.array(F.lit("Total $5"), F.lit("BAL 5"))).when(k == 4, F.array(F.lit("$ 5.00"))).when(k == 5, F.array(F.lit("$5 USD"), F.lit("€ 3"))).otherwise(F.array(F.lit("5 €")))
    return ledger.table("customer").withColumn("f", X.currency_for(printed, account, home, lines, k.isin(4, 5, 6))).select("c_custkey", "f.currency", "f.source")


@query("fn_locator", "select l_orderkey as doc_id, string_agg(distinct 'l' || cast(l_linenumber as varchar), ',' order by 'l' || cast(l_linenumber as varchar)) as line_ids, least(40, count(*)) as quotes from lineitem group by 1")
def fn_locator(ledger):
    cited = ledger.table("lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("seq"), F.concat(F.lit("l"), F.col("l_linenumber")).alias("line"), F.col("l_shipdate").cast("string").alias("quote"))
    return X.locator(cited).select("doc_id", F.array_join(F.array_sort("line_ids"), ",").alias("line_ids"), F.size("quotes").cast("bigint").alias("quotes"))


@query("filing_identity", "select o_orderkey, case when o_orderkey % 3 = 0 then 'A' when o_orderkey % 3 = 1 then 'B' else 'C' end as merchant, case o_orderkey % 4 when 0 then cast(o_orderdate as date) when 1 then date '2001-02-03' end as date from orders")
def filing_identity(ledger):
    k, d = F.col("o_orderkey"), F.col("o_orderkey") % 4
    found = X.filing_identity(F.lit("receipt"), F.when(k % 3 == 0, "A"), F.when(k % 3 == 1, "B"), F.lit("C"), F.when(d == 0, F.col("o_orderdate").cast("date").cast("string")).when(d == 1, "3 Feb"), F.when(d == 1, "2001-02-03").when(d == 2, "2001-2-3"))
    return ledger.table("orders").withColumn("f", found).select("o_orderkey", "f.merchant", "f.date")


@query("merge_chunk_results", """
select l_orderkey as doc_id, case when count(distinct l_returnflag) > 1 then 'mixed' else min(l_returnflag) end as document_type, case when max(l_linenumber) = 7 then 'partial' when sum(case when l_linenumber % 2 = 0 then 1 else 0 end) > 0 then 'itemized' else 'not_present' end as itemization,
  string_agg(cast(l_linenumber as varchar), ' ' order by l_linenumber) as facts from lineitem group by 1""")
def merge_chunk_results(ledger):
    number = F.col("l_linenumber")
    parts = ledger.table("lineitem").select(
        F.col("l_orderkey").alias("doc_id"), number.alias("chunk"), F.col("l_returnflag").alias("document_type"), F.when(number == 7, "partial").otherwise("itemized").alias("itemization"),
        F.array(number.cast("string")).alias("facts"), F.when(number % 2 == 0, F.array(F.lit("x"))).otherwise(F.array().cast("array<string>")).alias("items"),
    )
    return X.merge_chunks(parts).select("doc_id", "document_type", "itemization", F.concat_ws(" ", "facts").alias("facts"))


@query("pdf_merge", "select conv_id as doc_id, turn as page, count(*) as lines from (select conv_id, turn, unnest(string_split(text, chr(10))) as t from conversations) x where trim(t) <> '' group by 1, 2")
def pdf_merge(ledger):
    pages = ledger.table("conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("page"), "text")
    return X.page_lines(pages).groupBy("doc_id", "page").agg(F.countDistinct("line_id").alias("lines"))


@query("advisory_threshold", """
select o_orderkey as doc_id, case when o_orderkey % 5 = 0 or o_orderkey % 4 < 3 then 'needs_attention' else 'no_issues_found' end as verdict, o_orderkey % 5 > 0 as classification_supported, cast(case when o_orderkey % 5 = 0 then 1 else 0 end + case when o_orderkey % 4 < 3 then 1 else 0 end as bigint) as findings from orders""")
def advisory_threshold(ledger):
    k = F.col("o_orderkey")
    fact = F.when(k % 4 == 0, F.lit(None).cast("double")).when(k % 4 == 3, 0.8).otherwise(0.79)
    scores = ledger.table("orders").select(k.alias("doc_id"), F.explode(F.array(F.struct(F.lit("classification").alias("kind"), F.when(k % 5 == 0, 0.17).otherwise(0.94).alias("score")), F.struct(F.lit("fact").alias("kind"), fact.alias("score")))).alias("c"))
    return X.advisory(scores.select("doc_id", "c.kind", "c.score"))


@query("assistant_checked", "select o_orderkey, case when o_orderkey % 2 = 0 then 'r1' else '' end as citations, case when o_orderkey % 3 = 0 then '77.50' else '' end as unsupported from orders")
def assistant_checked(ledger):
    k = F.col("o_orderkey")
    answer = F.concat(F.lit("Order "), k, F.when(k % 3 == 0, " cost 77.50").otherwise(" is there"))
    got = X.checked_answer(answer, F.concat(F.lit("order "), k), F.when(k % 2 == 0, F.array(F.lit("r1"), F.lit("r9"), F.lit("r1"))).otherwise(F.array(F.lit("r9"))), F.array(F.lit("r1"), F.lit("r2")))
    return ledger.table("orders").select("o_orderkey", F.concat_ws(",", got["citations"]).alias("citations"), F.concat_ws(",", got["unsupported"]).alias("unsupported"))


@query("fn_privacy_query", "select p_partkey, case p_size % 6 when 0 then null when 1 then 'price or date' when 2 then 'price or date' when 3 then 'long number' when 4 then 'place' end as refused from part")
def fn_privacy_query(ledger):
    asked = F.element_at(F.array(F.concat(F.lit("1000ML "), F.col("p_name"), F.lit(" 12345")), F.lit("milk 4.99"), F.lit("milk 3/4/2020"), F.lit("milk 54321 12345"), F.lit("milk at st. John's"), F.lit("St John milk")), (F.col("p_size") % 6 + 1).cast("int"))
    return ledger.table("part").select("p_partkey", C.query_refused(asked, F.lit("12345"), F.lit("St John's")).alias("refused"))


#: Questions about a part; the words that make them questions about items are in the routing SQL below.
QUESTIONS = (
    "What is the cheapest {0}?", "Do I have {0}?", "Which brand of {0} is cheaper?", "Which warranty of {0} expires?", "What did I spend on {0}?", "How long does {0} last?", "How long until {0}", "Did I waste {0}?",
    "What did I throw away with {0}?", "Which {0} bills are due?", "When will {0} run out?", "Is {0} overpriced?", "{0} PER OZ", "Show my items", "stockings of {0}", "What was consumed of {0}?",
)
_ASKED = "replace([" + ", ".join(f"'{q}'" for q in QUESTIONS) + f"][p_partkey % {len(QUESTIONS)} + 1], '{{0}}', p_name)"
_ITEMS = "\\b(item|items|product|products|inventory|in stock|stock|running out|runing out|run out|ran out|used up|waste|wasted|wasting|(threw|thrown|throw) (out|away)|price|prices|pricier|cheap|cheaper|cheapest|expensive|shrinkflation|per (ounce|oz|pound|lb|gallon|item|unit)|brand|consum\\w*|how long\\b[^?]*\\blasts?|do i have)\\b"


@query("tool_routing", f"select p_partkey, case when regexp_matches(lower({_ASKED}), '{_ITEMS}') then 'items' else 'finance' end as assistant, cast(case when regexp_matches(lower({_ASKED}), '{_ITEMS}') then 12 else 22 end as int) as tools from part")
def tool_routing(ledger):
    asked = F.replace(F.element_at(F.array(*map(F.lit, QUESTIONS)), (F.col("p_partkey") % len(QUESTIONS) + 1).cast("int")), F.lit("{0}"), F.col("p_name"))
    to = C.route(asked)
    return ledger.table("part").select("p_partkey", to.alias("assistant"), F.when(to == "items", len(tools.ITEM_TOOLS)).otherwise(len(tools.FINANCE_TOOLS)).alias("tools"))


# the library ------------------------------------------------------------------------


@query("jn_self_version", "select user_id as doc_id, event_id as captured, length(event_type) as bytes from events")
def jn_self_version(ledger):
    seen = ledger.table("events").select(F.col("user_id").alias("doc_id"), F.col("event_type").alias("hash"), F.col("event_id").alias("captured"))
    return L.document_versions(seen, seen.select("hash").distinct().withColumn("bytes", F.length("hash"))).select("doc_id", "captured", "bytes")


@query("jn_alias_folder", "select doc_id, case when source in ('src1', 'src2') then upper(source) else 'Unfiled' end as folder from documents")
def jn_alias_folder(ledger):
    docs = ledger.table("documents")
    known = docs.where("source in ('src1', 'src2')").select(F.col("source").alias("old"), F.upper("source").alias("new")).distinct()
    return L.with_folder(docs.select("doc_id", F.col("source").alias("folder")), known).select("doc_id", "folder")


@query("library_reads", "select event_id, event_type from events where event_id < 5000 order by event_id desc limit 100")
def library_reads(ledger):
    return L.event_page(ledger.table("events").select("event_id", "event_type"), 5000)


@query("library_writes", """
select doc_id, case when trashed = 1 then case when doc_id % 3 = 0 then 'b' else source end when doc_id % 3 = 0 then 'b' when doc_id % 3 = 1 then 'a' else source end as folder,
  case when doc_id % 3 = 0 then false when doc_id % 3 = 1 then true else trashed = 1 end as trashed from files""", "files")
def library_writes(ledger):
    docs = ledger.files.select("doc_id", F.col("source").alias("folder"), "trashed")
    say = lambda seq, action, folder=None: F.struct(F.lit(seq).cast("bigint").alias("seq"), F.lit(action).alias("action"), F.lit(folder).cast("string").alias("folder"))
    said = F.when(F.col("doc_id") % 3 == 0, F.array(say(3, "move", "b"), say(2, "restore"), say(1, "trash"))).when(F.col("doc_id") % 3 == 1, F.array(say(1, "move", "a"), say(2, "trash"), say(3, "move", "c"), say(4, "burn")))
    return L.filed(docs, docs.select("doc_id", F.explode(said).alias("c")).select("doc_id", "c.*"))


@query("facets", f"select 'status' as facet, status as value, count(*) as runs from ({RUNS}) r where kind = 'click' group by 2 union all select 'day', cast(cast(created_at as date) as varchar), count(*) from ({RUNS}) r where kind = 'click' group by 2")
def facets(ledger):
    return L.facets(_runs(ledger, "click").withColumn("day", F.col("created_at").cast("date")), "status", "day")


@query("model_runs", f"select id, status from ({RUNS}) r where kind = 'view' and status <> 'queued' order by id desc limit 50")
def model_runs(ledger):
    return L.job_history(view=_runs(ledger, "view")).where("status <> 'queued'").orderBy(F.desc("id")).limit(50).select("id", "status")


@query("organization_latest", f"select kind, arg_max(id, (created_at, id)) as id from ({RUNS}) r where status = 'succeeded' and kind in ('click', 'view', 'purchase') group by 1")
def organization_latest(ledger):
    done = L.job_history(**{k: _runs(ledger, k) for k in ("click", "view", "purchase")}).where("status = 'succeeded'")
    return L.newest(done, ["kind"], ["created_at", "id"], "id")
