"""Dialects, dates, amounts and workbooks of imports; page text; routing words."""

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from hearthbook.functions.checks import route, warranty_months
from hearthbook.sources import html, tabular
from hearthbook.sources.workbook import WorkbookSource

DIALECTS = {
    "commas": 'Date,Payee,Amount\n2026-01-02,"Cafe, Bar",-4.50\n2026-01-03,Shop,-1.00\n',
    "semicolons": 'Date;Payee;Amount\n2026-01-02;"Cafe, Bar, Grill, Inn";-4.50\n2026-01-03;"a, b, c, d";-1.00\n',
    "semicolons with decimal commas elsewhere": 'Date;Payee;Amount;Balance\n2026-01-02;Cafe;-4.50;"1,234.00"\n2026-01-03;Shop;-1.00;"1,233.00"\n',
    "tabs": "Date\tPayee\tAmount\n2026-01-02\tCafe, Bar; Inn\t-4.50\n2026-01-03\tShop\t-1.00\n",
    "tabs with commas in every text": "Date\tPayee\tAmount\n2026-01-02\tA, B\t-4.50\n2026-01-03\tC, D\t-1.00\n",
    "preamble with commas": 'My bank, branch 3, city\n\nDate;Payee;Amount\n2026-01-02;Cafe;-4.50\n2026-01-03;Shop;-1.00\n',
    "quoted delimiters": '"Date","Payee","Amount"\n"2026-01-02","A;B;C;D;E","-4.50"\n"2026-01-03","F;G;H;I;J","-1.00"\n',
    "quoted line ends": 'Date,Payee,Amount\n2026-01-02,"Cafe\nBar",-4.50\n2026-01-03,Shop,-1.00\n',
    "carriage returns": "Date;Payee;Amount\r\n2026-01-02;Cafe;-4.50\r\n2026-01-03;Shop;-1.00\r\n",
    "with a mark": "﻿Date,Payee,Amount\n2026-01-02,Cafe,-4.50\n2026-01-03,Shop,-1.00\n",
}


@pytest.mark.parametrize("name", DIALECTS)
def test_dialects(name):
    rows = tabular.read_csv(DIALECTS[name].encode())
    at = tabular.header_row(rows)
    assert rows[at][:3] == ["Date", "Payee", "Amount"]
    assert [(r[0], r[2]) for r in rows[at + 1 :] if any(r)] == [("2026-01-02", "-4.50"), ("2026-01-03", "-1.00")]


def test_a_long_file_is_judged_by_whole_rows():
    text = "Date;Payee;Amount\n" + '2026-01-02;"a, b, c";-4.50\n' * 2000
    assert tabular.delimiter(text) == ";" and tabular.delimiter("") == ","


def test_the_date_column_goes_by_the_order_of_names():
    assert tabular.detect(["Transaction Date", "Post Date", "Description", "Amount"])["date"] == 1
    assert tabular.detect(["trans date", "Booking Date", "Date ", "Payee", "Debit", "Credit"]) == {"date": 2, "description": 3, "debit": 4, "credit": 5}


@pytest.mark.parametrize("currency, text, minor", [
    ("USD", "1.23456789", None), ("USD", "1.5E1", 1500), ("USD", "-45.099999999999994", -4510), ("USD", "12.345", None), ("USD", "1e-9", 0), ("USD", "-12.3000000000001", -1230), ("USD", "2.675", None),
    ("BHD", "1.2340000001", 1234), ("BHD", "1.2345", None), ("BHD", "1.5E0", 1500), ("JPY", "1200.0000000001", 1200), ("JPY", "1200.4", None), ("JPY", "1.2E3", 1200), ("XXX", "1.0000000001", None), ("USD", "1E400", None), ("USD", "E5", None),
])
def test_spreadsheet_noise(spark, currency, text, minor):
    row = spark.createDataFrame([(text,)], "t string").select(tabular.amount_or_noise(F.col("t"), currency).alias("m")).first()["m"]
    assert row["minor"] == minor and (row["error"] is None) == (minor is not None)


def book(sheets):
    space = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    parts = {
        "xl/workbook.xml": f"<workbook {space}><sheets>" + "".join(f'<sheet name="{n}" sheetId="{k}" r:id="r{k}"/>' for k, n in enumerate(sheets)) + "</sheets></workbook>",
        "xl/_rels/workbook.xml.rels": '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">' + "".join(f'<Relationship Id="r{k}" Target="worksheets/s{k}.xml"/>' for k in range(len(sheets))) + "</Relationships>",
        **{f"xl/worksheets/s{k}.xml": f"<worksheet {space}><sheetData>{body}</sheetData></worksheet>" for k, body in enumerate(sheets.values())},
    }
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w", zipfile.ZIP_DEFLATED) as archive:
        for name, text in parts.items():
            archive.writestr(name, text)
    return held.getvalue()


def cells(*texts):
    return "<row>" + "".join(f'<c t="inlineStr"><is><t>{t}</t></is></c>' for t in texts) + "</row>"


JANUARY = cells("Date", "Payee", "Amount") + '<row><c r="A2" t="inlineStr"><is><t>2026-01-02</t></is></c><c r="B2" t="inlineStr"><is><t>Cafe</t></is></c><c r="C2"><f>1+1</f><v>-4.5</v></c></row><row><c r="A3" t="inlineStr"><is><t>2026-01-03</t></is></c><c r="C3"><f>SUM(C1)</f></c><c r="D3" t="e"><v>#REF!</v></c></row>'
BOOK = {"January": JANUARY, "February": cells("Date", "Payee", "Amount") + cells("2026-02-02", "Shop", "-1.00"), "Empty": ""}


def test_sheets_by_name_and_formulas_without_values(spark):
    content = book(BOOK)
    assert tabular.sheet_names(content) == list(BOOK)
    rows, notes = tabular.read_xlsx(content)
    assert rows[1] == ["2026-01-02", "Cafe", "-4.5"] and rows[2] == ["2026-01-03", "", "", ""]
    assert notes == ["C3: a formula without a saved value", "D3: the error #REF!", "2 formulas were read by their saved values"]
    assert tabular.read_xlsx(content, "February")[0][1] == ["2026-02-02", "Shop", "-1.00"]
    with pytest.raises(ValueError, match="no such sheet"):
        tabular.read_xlsx(content, "March")
    files = spark.createDataFrame([("a.xlsx", content), ("b.csv", "Débit".encode("cp1252")), ("c.xlsx", b"no")], "path string, content binary")
    chosen = tabular.imported(tabular.read_files(files.where("path = 'a.xlsx'"), tabular.Mapping(sheet="February")), "USD", tabular.Mapping(sheet="February"))
    assert [(r.amount_minor, r.reject_reason) for r in chosen.collect()] == [(-100, None)]
    said = {}
    for r in tabular.notes(files).collect():
        said.setdefault(r.path, []).append(r.note)
    assert said["a.xlsx"] == notes and said["b.csv"] == ["read as Windows-1252"] and len(said["c.xlsx"]) == 1


def test_workbooks_as_a_data_source(spark, tmp_path):
    spark.dataSource.register(WorkbookSource)
    (tmp_path / "deep").mkdir()
    (tmp_path / "a.xlsx").write_bytes(book(BOOK))
    (tmp_path / "deep" / "b.XLSX").write_bytes(book({"February": cells("x", "y")}))
    (tmp_path / "broken.xlsx").write_bytes(b"no")
    (tmp_path / "c.csv").write_text("Date,Amount")
    frame = spark.read.format("workbook").load(str(tmp_path))
    name = F.substring_index("path", "/", -1)
    got = {(r.n, r.sheet, r.row): (r.cells, r.note) for r in frame.where("row > 0").select(name.alias("n"), "sheet", "row", "cells", "note").collect()}
    assert set(got) == {("a.xlsx", "January", 1), ("a.xlsx", "January", 2), ("a.xlsx", "January", 3), ("a.xlsx", "February", 1), ("a.xlsx", "February", 2), ("b.XLSX", "February", 1)}
    assert got["a.xlsx", "February", 2][0] == ["2026-02-02", "Shop", "-1.00"]
    problems = frame.where("row = 0").select(name.alias("n"), "sheet", "note").collect()
    assert sum(r.n == "a.xlsx" and r.sheet == "January" for r in problems) == 3 and [r.sheet for r in problems if r.n == "broken.xlsx"] == [None]
    two = spark.read.format("workbook").option("sheets", '["February", "Empty"]').load(str(tmp_path)).where("row > 0")
    assert sorted((r.n, r.sheet, r.row) for r in two.select(name.alias("n"), "sheet", "row").collect()) == [("a.xlsx", "February", 1), ("a.xlsx", "February", 2), ("b.XLSX", "February", 1)]
    assert spark.read.format("workbook").option("sheet", "January").load(str(tmp_path / "a.xlsx")).where("row > 0").count() == 3


PAGES = {
    "<head><title>x</title><body><p>hello": ("x", "hello"),
    "<html><head><title> A &amp;  B\n</title><style>p{}</style></head><body>one<br>two &lt;b&gt; <b>th</b>ree</body></html>": ("A & B", "one\ntwo <b> three"),
    "<p>a<script>if (a < b) {}</script>b<!-- <p>no -->c</p><noscript>no</noscript><svg><text>no</text></svg>": ("", "abc"),
    "<a title='it > that' href=\"x>y\">link</a> 3 < 4 &nbsp; &#233;&eacute;": ("", "link 3 < 4 éé"),
    "<div>a</div>\r\n\t<ul><li>b<li>c</ul>": ("", "a\nb\nc"),
    "text <script>never closed": ("", "text"),
    "<a title='never closed>x</a>y": ("", "xy"),
    None: ("", ""), "": ("", ""),
}


def test_page_text(spark):
    frame = spark.createDataFrame(list(enumerate(PAGES)), "page_id long, html string")
    got = {r.page_id: (r.title, r.text) for r in html.page_text(frame).collect()}
    assert got == dict(enumerate(PAGES.values()))
    assert {r.text for r in html.page_text(frame, 3).where("page_id = 1").collect()} == {"one"}
    long = spark.createDataFrame([(1, "<p>" + "word " * 400_000 + "<script>" + "x" * 400_000 + "</script><b a='1' b=2>end</b>")], "page_id long, html string")
    assert html.page_text(long).first().text.endswith("word end")


@pytest.mark.parametrize("question, assistant", [
    ("Is milk cheaper at Costco or Walmart?", "items"), ("What did I throw away last month?", "items"), ("How much did I spend on groceries in August?", "finance"), ("Which bills are due next week?", "finance"),
    ("What is the cheapest milk?", "items"), ("Do I have eggs?", "items"), ("Which brand is cheaper?", "items"), ("Which warranty expires?", "finance"), ("How long does soap last?", "items"), ("How long ago? It lasts", "finance"), (None, "finance"), ("", "finance"),
])
def test_routing(spark, question, assistant):
    assert spark.createDataFrame([(question,)], "q string").select(route(F.col("q"))).first()[0] == assistant


@pytest.mark.parametrize("quote, months", [
    ("a two-year limited warranty", [24]), ("Twenty-Five years", [300]), ("well-two years", [24]), ("90 days, 365 days or 45 days", [3, 12]), ("one hundred years", []), ("12 mos and 18-month", [12, 18]), ("limited year", []), ("fiveyears", [60]), (None, []), ("1234 days", []),
])
def test_warranty_lengths(spark, quote, months):
    assert spark.createDataFrame([(quote,)], "q string").select(warranty_months(F.col("q"))).first()[0] == months
