"""Money as exact integer minor units with an explicit currency."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Decimals of each currency's minor unit, the currencies that a symbol may stand for, and how a number is printed.
DECIMALS = {
    "USD": 2, "EUR": 2, "GBP": 2, "CAD": 2, "AUD": 2, "NZD": 2, "CHF": 2, "SEK": 2, "NOK": 2, "DKK": 2, "MXN": 2, "PHP": 2, "INR": 2, "CNY": 2,
    "HKD": 2, "SGD": 2, "ZAR": 2, "BRL": 2, "PLN": 2, "CZK": 2, "JPY": 0, "KRW": 0, "BHD": 3, "KWD": 3, "JOD": 3, "OMR": 3, "TND": 3,
}
SYMBOLS = {"$": ("USD", "CAD", "AUD", "NZD", "MXN", "HKD", "SGD"), "€": ("EUR",), "£": ("GBP",), "¥": ("JPY", "CNY"), "₹": ("INR",), "₱": ("PHP",), "₩": ("KRW",)}
NUMBER = r"\d{1,3}(?:,\d{3})+(?:\.\d+)?|\d+(?:\.\d+)?|\.\d+"


def decimals(currency: Column) -> Column:
    """Decimals of a currency, null if it is not supported."""
    table = F.create_map(*(F.lit(x) for pair in DECIMALS.items() for x in pair))
    return F.try_element_at(table, currency)


def currency_code(value: Column) -> Column:
    code = F.upper(F.trim(value))
    return F.when(decimals(code).isNotNull(), code)


def decimal_text(minor: Column, currency: Column) -> Column:
    """-4510 USD as "-45.10", -1200 JPY as "-1200"."""
    places = decimals(currency)
    digits = F.lpad(F.abs(minor).cast("string"), F.greatest(F.length(F.abs(minor).cast("string")), places + 1), F.lit("0"))
    cut = F.length(digits) - places
    sign = F.when(minor < 0, F.lit("-")).otherwise(F.lit(""))
    return F.concat(sign, digits.substr(F.lit(1), cut), F.when(places > 0, F.concat(F.lit("."), digits.substr(cut + 1, places))).otherwise(F.lit("")))


def display_text(minor: Column, currency: Column) -> Column:
    """With thousands commas and the currency: "-1,234.50 USD"."""
    text = decimal_text(minor, currency)
    grouped = F.regexp_replace(F.substring_index(text, ".", 1), r"(?<=\d)(?=(\d{3})+$)", ",")
    rest = F.when(F.contains(text, F.lit(".")), F.concat(F.lit("."), F.substring_index(text, ".", -1))).otherwise(F.lit(""))
    return F.concat(grouped, rest, F.lit(" "), currency)


def to_minor(text: Column, currency: Column) -> Column:
    """Struct (minor, error) of an amount as people and banks print it: grouped or not, with a symbol or code of the currency, negative by a sign on either side or by brackets."""
    # one pattern, so that each part is one extraction from the text and nothing is computed twice
    marks = "".join(SYMBOLS)
    pattern = rf"^(\(?)\s*([+-]?)\s*([{marks}]?)\s*([+-]?)\s*({NUMBER})\s*((?:[A-Za-z]{{3}})?)\s*(-?)\s*(\)?)$"
    part = lambda k: F.regexp_extract(F.trim(text), pattern, k)
    places = decimals(currency)
    opened, closed, symbol, code = part(1), part(8), part(3), F.upper(part(6))
    allowed = F.create_map(*(F.lit(x) for mark, codes in SYMBOLS.items() for x in (mark, ",".join(codes))))
    wrong_symbol = (symbol != "") & ~F.contains(F.try_element_at(allowed, symbol), currency)
    number = F.replace(part(5), F.lit(","), F.lit(""))
    whole = F.substring_index(number, ".", 1)
    fine = F.rtrim(F.regexp_extract(part(5), r"\.(\d+)$", 1), F.lit("0"))
    minor = F.concat(F.when(whole == "", "0").otherwise(whole), F.rpad(fine, places, "0")).try_cast("bigint")
    negatives = F.length(opened) + (part(2) == "-").cast("int") + (part(4) == "-").cast("int") + F.length(part(7))
    error = (
        F.when(places.isNull(), "currency").when(text.isNull(), "missing").when((number == "") | (F.length(opened) != F.length(closed)), "not a number")
        .when((code != "") & (code != currency), "other currency").when(wrong_symbol, "other symbol").when(F.length(fine) > places, "precision").when(minor.isNull(), "too large")
    )
    return F.struct(F.when(error.isNull(), F.when(negatives % 2 == 1, -minor).otherwise(minor)).alias("minor"), error.alias("error"))
