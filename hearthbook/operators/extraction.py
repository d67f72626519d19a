"""Checks of extracted records against the lines they cite."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearthbook.functions.checks import unsupported
from hearthbook.functions.dates import iso_date
from hearthbook.functions.money import SYMBOLS, currency_code, decimals
from hearthbook.functions.text import normalize_name

CHUNK_LINES, CHUNK_BYTES = 80, 24 * 1024


def lines_of(documents: DataFrame) -> DataFrame:
    """(doc_id, line, text): numbered lines that are not blank."""
    split = documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "text"))
    return split.where("trim(text) <> ''")


def exact_citations(citations: DataFrame, lines: DataFrame) -> DataFrame:
    """citations (doc_id, line, quote) plus exact: whether the line prints the quote."""
    joined = citations.join(lines, ["doc_id", "line"], "left")
    return joined.withColumn("exact", F.coalesce(F.contains("text", F.col("quote")) & (F.col("quote") != ""), F.lit(False))).drop("text")


def coverage(lines: DataFrame, citations: DataFrame) -> DataFrame:
    """Per document: lines, lines cited exactly once, lines nobody cites and lines cited more than once."""
    times = citations.groupBy("doc_id", "line").agg(F.count("*").alias("times"))
    joined = lines.join(times, ["doc_id", "line"], "left").na.fill(0, ["times"])
    return joined.groupBy("doc_id").agg(F.count("*").alias("lines"), *(F.sum(cond.cast("int")).alias(name) for name, cond in (("once", F.col("times") == 1), ("missing", F.col("times") == 0), ("twice", F.col("times") > 1))))


def chunks(lines: DataFrame, most_lines: int = CHUNK_LINES, most_bytes: int = CHUNK_BYTES) -> DataFrame:
    """(doc_id, chunk, first_line, last_line): lines packed in order, each chunk within both limits unless one line alone exceeds them."""

    import pyarrow as pa

    schema = pa.schema([("doc_id", pa.int64()), ("chunk", pa.int32()), ("first_line", pa.int32()), ("last_line", pa.int32())])

    def run(batches):
        current, chunk, first, last, held, size = None, 0, None, None, 0, 0
        for batch in batches:
            out = []
            for doc, line, cost in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "line", "cost"))):
                if held and (doc != current or held == most_lines or size + cost > most_bytes):
                    out.append((current, chunk, first, last))
                    chunk, held, size = chunk + 1, 0, 0
                if doc != current:
                    current, chunk = doc, 0
                if not held:
                    first = line
                last, held, size = line, held + 1, size + cost
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([c], f.type) for c, f in zip((current, chunk, first, last), schema)], schema=schema)

    # only a line's bytes are sent, not its text; documents stream through one after another
    costs = lines.select("doc_id", "line", (F.octet_length("text") + 1).alias("cost"))
    return costs.repartition("doc_id").sortWithinPartitions("doc_id", "line").mapInArrow(run, "doc_id long, chunk int, first_line int, last_line int")


# Words that say nothing of their own in a title, those that only say that something was bought, and the form of a label.
FILLER, BOUGHT, DESCRIPTION_LIMIT = ("THE", "AND", "OF"), ("ORDER", "RUN", "TRIP", "SHOPPING"), 32
_PLAIN = r"\p{L}+(?:['’-]\p{L}+)*"
LABEL = rf"^{_PLAIN}(?:(?:\s*[&,/]?\s+|\s*[&,/]\s*){_PLAIN}){{0,2}}$"


def _title_words(text: Column, ascii_only: bool) -> Column:
    return F.array_distinct(F.filter(F.split(normalize_name(text, ascii_only), " "), lambda w: (w != "") & ~w.isin(*FILLER)))


def repeats_title(text: Column, part: Column, ascii_only: bool = False) -> Column:
    """Whether a description only says again what another part of the title says: all its words are that part's, or it holds the whole part."""
    words, names = _title_words(text, ascii_only), _title_words(part, ascii_only)
    within = lambda a, b: F.size(F.array_except(a, b)) == 0
    return (F.size(words) > 0) & (F.size(names) > 0) & (within(words, F.concat(names, F.array(*map(F.lit, BOUGHT)))) | within(names, words))


def clean_description(text: Column, *parts: Column, ascii_only: bool = False) -> Column:
    """A label of one to three plain words that repeats no part of the title, its first letter upper case; else null."""
    said = F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s+", " "), r"^[ .]+|[ .]+$", "")
    plain = said.rlike(LABEL) & (F.length(said) <= DESCRIPTION_LIMIT) & ~said.rlike(r"(?i)\b(receipt|purchase)\b")
    for part in parts:
        plain = plain & ~F.coalesce(repeats_title(said, part, ascii_only), F.lit(False))
    return F.when(plain, F.concat(F.upper(F.substring(said, 1, 1)), F.substring(said, 2, DESCRIPTION_LIMIT)))


def currency_for(printed: Column, account: Column, home: Column, lines: Column, is_receipt: Column) -> Column:
    """Struct (currency, source) by the first that decides: the printed code, the account's, the home currency where every symbol can mean it and no other code appears, USD for such a receipt."""
    codes = F.filter(F.array_distinct(F.flatten(F.transform(lines, lambda t: F.regexp_extract_all(t, F.lit(r"\b([A-Z]{3})\b"), F.lit(1))))), lambda c: decimals(c).isNotNull())
    text = F.concat_ws(" ", lines)
    seen = [(F.contains(text, F.lit(mark)), codes_of) for mark, codes_of in SYMBOLS.items()]
    can_be = lambda currency: F.forall(F.array(*(~there | F.array_contains(F.array(*map(F.lit, of)), currency) for there, of in seen)), lambda ok: F.coalesce(ok, F.lit(False)))
    only = lambda currency: F.size(F.array_except(codes, F.array(currency))) == 0
    any_symbol = F.exists(F.array(*(there for there, _ in seen)), lambda s: s)
    at_home = home.isNotNull() & any_symbol & can_be(home) & only(home)
    assumed = is_receipt & printed.isNull() & can_be(F.lit("USD")) & only(F.lit("USD"))
    code = currency_code(printed)
    source = F.when(printed.isNotNull(), F.when(code.isNotNull(), "printed")).when(account.isNotNull(), "account").when(at_home, "home").when(assumed, "assumed")
    return F.struct(F.when(source == "printed", code).when(source == "account", account).when(source == "home", home).when(source == "assumed", "USD").alias("currency"), source.alias("source"))


def locator(citations: DataFrame, most: int = 40) -> DataFrame:
    """(doc_id, line_ids, quotes): each document's distinct cited lines in order of citing, and its first quotes."""
    each = citations.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("seq", "line", "quote"))).alias("c"))
    return each.select("doc_id", F.array_distinct(F.transform("c", lambda c: c["line"])).alias("line_ids"), F.slice(F.transform("c", lambda c: c["quote"]), 1, most).alias("quotes"))


def filing_identity(kind: Column, normalized_merchant: Column, cited_merchant: Column, issuer: Column, normalized_date: Column, cited_date: Column) -> Column:
    """Struct (kind, merchant, date) a document is filed by: normalised values before cited ones, dates only where they are whole."""
    return F.struct(kind.alias("kind"), F.coalesce(normalized_merchant, cited_merchant, issuer).alias("merchant"), F.coalesce(iso_date(normalized_date), iso_date(cited_date)).alias("date"))


def merge_chunks(chunks_: DataFrame) -> DataFrame:
    """chunks (doc_id, chunk, document_type, itemization, facts, items) -> one row a document.

    Lists follow the chunks' order; several types are mixed; one partial chunk makes
    the whole partial, else it is itemized where it has items.
    """
    lists = lambda c: F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("chunk", c))), lambda x: x[c])).alias(c)
    merged = chunks_.groupBy("doc_id").agg(F.collect_set("document_type").alias("types"), F.max((F.col("itemization") == "partial").cast("int")).alias("partial"), lists("facts"), lists("items"))
    status = F.when(F.col("partial") == 1, "partial").when(F.size("items") > 0, "itemized").otherwise("not_present")
    return merged.select("doc_id", F.when(F.size("types") > 1, "mixed").otherwise(F.col("types")[0]).alias("document_type"), status.alias("itemization"), "facts", "items")


def page_lines(pages: DataFrame) -> DataFrame:
    """pages (doc_id, page, text) -> (line_id, doc_id, page, text): lines that are not blank, numbered through each page, ids like p2l7."""
    each = pages.select("doc_id", "page", F.posexplode(F.filter(F.split("text", "\n"), lambda t: F.trim(t) != "")).alias("k", "text"))
    return each.select(F.format_string("p%dl%d", F.col("page").cast("int"), F.col("k") + 1).alias("line_id"), "doc_id", "page", F.trim("text").alias("text"))


SUPPORT_THRESHOLD = 0.8


def advisory(scores: DataFrame, threshold: float = SUPPORT_THRESHOLD) -> DataFrame:
    """scores (doc_id, kind, score or null) -> verdict, classification_supported and how many claims found no support; a null score could not be told."""
    weak = F.col("score").isNull() | (F.col("score") < threshold)
    named = F.max(F.when(F.col("kind") == "classification", F.coalesce("score", F.lit(0.0))))
    sums = scores.groupBy("doc_id").agg(F.sum(weak.cast("int")).alias("findings"), F.coalesce(named >= threshold, F.lit(False)).alias("classification_supported"))
    return sums.select("doc_id", F.when(F.col("findings") > 0, "needs_attention").otherwise("no_issues_found").alias("verdict"), "classification_supported", "findings")


def checked_answer(answer: Column, evidence: Column, cited: Column, known: Column) -> Column:
    """Struct (citations, unsupported): the cited ids that are known, in order, and the answer's figures that no evidence prints."""
    return F.struct(F.array_distinct(F.filter(cited, lambda c: F.array_contains(known, c))).alias("citations"), unsupported(answer, evidence).alias("unsupported"))


def receipt_adds_up(subtotal: Column, tax: Column, tip: Column, total: Column, items: Column) -> Column:
    """Names of the sums that fail, of those whose parts are known."""
    known = lambda c: F.coalesce(c, F.lit(0))
    return F.array_compact(F.array(
        F.when(subtotal + known(tax) + known(tip) != total, F.lit("total")),
        F.when((F.size(items) > 0) & (F.aggregate(items, F.lit(0).cast("bigint"), lambda a, x: a + x) != subtotal), F.lit("items")),
    ))


def statement_adds_up(opening: Column, net: Column, closing: Column) -> Column:
    return F.when(opening + net != closing, F.lit("closing balance"))
