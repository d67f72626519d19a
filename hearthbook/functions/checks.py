"""Checks of codes, quotes and figures in text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from hearthbook.functions.money import NUMBER
from hearthbook.functions.text import normalize_name

# Phrases of printed return policies, and the number words of warranty lengths.
NO_RETURNS = r"(?i)\b(?:no returns?|all sales? (?:are )?final|non-?returnable)\b"
RETURN_WITHIN = r"(?i)\breturns?\b[^.\n]{0,60}?\b(?:within|up to|for|in)\s+(\d{1,3})\s+days?\b"
DAYS_RETURN = r"(?i)\b(\d{1,3})[- ]days?\s+(?:return|refund|money[- ]back)"
NUMBER_WORDS = {
    "one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9, "ten": 10,
    "eleven": 11, "twelve": 12, "fifteen": 15, "eighteen": 18, "twenty": 20, "twenty-five": 25, "thirty": 30, "ninety": 90,
}
LONGEST_RETURN = 730
# What a web query must not hold, and what a page must speak of to state a warranty.
PRICE, DATE, LONG_NUMBER = r"\d+[.,]\d{2}\b|[$€£¥₹]", r"\b\d{1,4}[-/.]\d{1,2}[-/.]\d{1,4}\b", r"(?<![A-Za-z0-9])\d{4,}(?![A-Za-z0-9])"
ABOUT_WARRANTY = r"(?i)warrant|guarantee"
# The words of questions about things, prices, stock and waste.
ITEM_WORDS = (
    "items?", "products?", "inventory", "in stock", "stock", "run(?:ning)? out", "ran out", "used up", "wast(?:e|ed|ing)", "thr(?:ew|own|ow) (?:out|away)",
    "price", "prices", "pricier", "cheap(?:er|est)?", "expensive", "shrinkflation", "per (?:ounce|oz|pound|lb|gallon|item|unit)", "brand", r"consum\w*", r"how long\b[^?]*\blasts?", "do i have",
)


def valid_gtin(code: Column) -> Column:
    """UPC, EAN and GTIN codes of 8, 12, 13 or 14 digits whose check digit is right."""
    digits = F.transform(F.reverse(F.split(code, "")), lambda c, i: c.cast("int") * F.when(i % 2 == 1, 3).otherwise(1))
    total = F.aggregate(digits, F.lit(0), lambda a, x: a + x)
    return F.coalesce(F.when(code.rlike(r"^(\d{8}|\d{12,14})$"), total % 10 == 0), F.lit(False))


def printed_return_days(lines: Column) -> Column:
    """Days of the first line that prints a return policy; 0 for none, null if no line does."""
    within = lambda line: F.coalesce(F.nullif(F.regexp_extract(line, RETURN_WITHIN, 1), F.lit("")), F.nullif(F.regexp_extract(line, DAYS_RETURN, 1), F.lit(""))).cast("int")
    each = F.transform(lines, lambda line: F.when(line.rlike(NO_RETURNS), 0).otherwise(within(line)))
    return F.try_element_at(F.filter(each, lambda d: d.isNotNull() & (d <= LONGEST_RETURN)), F.lit(1))


def figures(text: Column) -> Column:
    """Distinct numbers printed in a text, without commas, in order."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("(" + NUMBER + ")"), F.lit(1))
    return F.array_distinct(F.transform(found, lambda n: F.replace(n, F.lit(","), F.lit(""))))


def printed_decimal(text: Column) -> Column:
    """The single number of a text, else null."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("(" + NUMBER + ")"), F.lit(1))
    return F.when(F.size(found) == 1, F.replace(found[0], F.lit(","), F.lit("")))


def unsupported(answer: Column, evidence: Column) -> Column:
    """Figures of an answer that no evidence text prints."""
    return F.array_except(figures(answer), figures(evidence))


def quote_exact(quote: Column, line: Column) -> Column:
    return F.coalesce((quote != "") & F.contains(line, quote), F.lit(False))


def quote_repaired(quote: Column, line: Column) -> Column:
    """The quote without one layer of quotation marks, if only that makes it exact."""
    bare = F.regexp_replace(quote, "^[\"'“‘](.*)[\"'”’]$", "$1")
    return F.when(~quote_exact(quote, line) & quote_exact(bare, line), bare).otherwise(quote)


def warranty_months(quote: Column) -> Column:
    """Distinct lengths in months that a quote states: years, months, and days that are one year or thirties."""
    low = F.lower(F.coalesce(quote, F.lit("")))
    # any word may stand before a unit; only those that the table of number words has count, "well-two" as two
    pattern = r"\b(\d{1,3}|[a-z]+(?:-[a-z]+)?)[\s-]{0,3}(year|yr|month|mo|day)s?\b"
    amounts = F.regexp_extract_all(low, F.lit(pattern), F.lit(1))
    units = F.regexp_extract_all(low, F.lit(pattern), F.lit(2))
    table = F.create_map(*(F.lit(x) for pair in NUMBER_WORDS.items() for x in pair))
    number = lambda a: F.coalesce(F.try_element_at(table, a), F.try_element_at(table, F.substring_index(a, "-", -1)), a.try_cast("int"))
    length = lambda a, u: F.when(u.startswith("y"), number(a) * 12).when(u.startswith("m"), number(a)).when(number(a) == 365, 12).when(number(a) % 30 == 0, (number(a) / 30).cast("int"))
    return F.array_distinct(F.filter(F.zip_with(amounts, units, length), lambda m: m.isNotNull() & (m > 0)))


def decimals_in(text: Column) -> Column:
    """Distinct printed numbers as decimals."""
    return F.transform(figures(text), lambda n: n.cast("decimal(38,10)"))


def line_amount(quote: Column) -> Column:
    """The number that a printed line ends with, as a decimal."""
    found = F.regexp_extract_all(F.coalesce(quote, F.lit("")), F.lit("(" + NUMBER + ")"), F.lit(1))
    return F.replace(F.try_element_at(found, F.lit(-1)), F.lit(","), F.lit("")).try_cast("decimal(38,10)")


def amount_supported(value: Column, quotes: Column) -> Column:
    """Whether some quote prints the single number of value, or the quotes' last numbers add up to it."""
    printed = printed_decimal(value).try_cast("decimal(38,10)")
    shown = F.exists(quotes, lambda q: F.array_contains(decimals_in(q), printed))
    ends = F.transform(quotes, line_amount)
    total = F.aggregate(ends, F.lit(0).cast("decimal(38,10)"), lambda a, x: (a + x).cast("decimal(38,10)"))
    return F.coalesce(printed.isNotNull() & (shown | ((F.size(quotes) > 1) & ~F.exists(ends, lambda x: x.isNull()) & (total == printed))), F.lit(False))


def name_supported(name: Column, quotes: Column, ascii_only: bool = False) -> Column:
    """Whether a word of the name stands in the quotes, or, with four letters or more, inside a longer word."""
    quoted = normalize_name(F.concat_ws(" ", quotes), ascii_only)
    joined = F.replace(quoted, F.lit(" "), F.lit(""))
    words = F.filter(F.split(normalize_name(name, ascii_only), " "), lambda w: w != "")
    return F.exists(words, lambda w: F.array_contains(F.split(quoted, " "), w) | ((F.length(w) >= 4) & F.contains(joined, w)))


def query_refused(query: Column, code: Column, place: Column) -> Column:
    """Why a web query may not be sent: it holds a price or date, a long number but the printed code, or the place; else null."""
    numbers = F.regexp_extract_all(query, F.lit("(" + LONG_NUMBER + ")"), F.lit(1))
    strange = F.exists(numbers, lambda n: ~n.eqNullSafe(code))
    squeeze = lambda c: F.trim(F.regexp_replace(F.upper(F.coalesce(c, F.lit(""))), r"(?U)[^\p{Alnum}&]+", " "))
    return F.when(query.rlike(PRICE) | query.rlike(DATE), "price or date").when(strange, "long number").when((squeeze(place) != "") & F.contains(squeeze(query), squeeze(place)), "place")


def warranty_refused(quote: Column, page: Column, months: Column, lifetime: Column) -> Column:
    """Why a proposed warranty is not what the page says: not quoted, not about one, or another length; else null."""
    bare = lambda c: F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"(?U)\s+", "")
    said = warranty_months(quote)
    return (
        F.when(~F.contains(bare(page), bare(quote)), "not on the page").when(~F.coalesce(quote.rlike(ABOUT_WARRANTY), F.lit(False)), "not about a warranty")
        .when(lifetime & ~is_lifetime(quote), "no lifetime stated").when(~lifetime & ~F.coalesce(F.array_contains(said, months), F.lit(False)), "another length")
    )


def is_lifetime(quote: Column) -> Column:
    return F.coalesce(quote.rlike(r"(?i)\blifetime\b"), F.lit(False))


def route(question: Column) -> Column:
    """The assistant for a question: items where a word of theirs stands in it, else finance."""
    about = question.rlike(rf"(?i)\b(?:{'|'.join(ITEM_WORDS)})\b")
    return F.when(F.coalesce(about, F.lit(False)), "items").otherwise("finance")


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))
