"""Names, tokens and the classification of statement lines."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# What is dropped from a name, and the words that tell transaction types apart.
STORE_NOISE = r"#\s*\d+|\b\d+\b|[^\w\s&]"
LEGAL_WORDS = r"\b(INC|LLC|LTD|CO|CORP|CORPORATION|COMPANY)\b"
TRANSFER_WORDS = r"\b(TRANSFER|XFER|TRNSFR)\b"
PAYMENT_WORDS = r"\b(PAYMENT|AUTOPAY|AUTO PAY|AUTOMATIC PAYMENT|PMT|THANK YOU)\b"
REFUND_WORDS = r"\b(REFUND|RETURN|REVERSAL|CREDIT ADJ)\b"
CASH_WORDS = r"\b(ATM|CASH WITHDRAWAL|WITHDRAWAL)\b"


def _nfkc(text: pd.Series) -> pd.Series:
    return text.map(lambda t: unicodedata.normalize("NFKC", t), na_action="ignore")


def _compatible(text: Column) -> Column:
    return F.pandas_udf(_nfkc, "string")(text)


def normalized(names: pd.Series) -> pd.Series:
    """normalize_name over a batch of texts, for engines that take functions instead of expressions."""
    import re

    def one(text: str | None) -> str:
        text = re.sub(STORE_NOISE, " ", unicodedata.normalize("NFKC", text or "").upper())
        return " ".join(re.sub(LEGAL_WORDS, " ", text).split())

    return names.map(one)


def squeezed(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def normalize_name(name: Column, ascii_only: bool = False) -> Column:
    """Stable key of a merchant: upper case, without store numbers, punctuation (but &) and legal words.

    Compatibility forms need Python, so a column known to be ASCII can skip that.
    """
    text = F.coalesce(name, F.lit(""))
    if not ascii_only:
        text = F.when(text.rlike(r"[^\x00-\x7F]"), _compatible(text)).otherwise(text)
    text = F.regexp_replace(F.upper(text), "(?U)" + STORE_NOISE, " ")
    return squeezed(F.regexp_replace(text, "(?U)" + LEGAL_WORDS, " "))


def name_tokens(name: Column, ascii_only: bool = False) -> Column:
    """Distinct words of more than two letters."""
    return F.array_distinct(F.filter(F.split(normalize_name(name, ascii_only), " "), lambda t: F.length(t) > 2))


def first_words(normalized: Column, count: int = 3) -> Column:
    return F.concat_ws(" ", F.slice(F.split(normalized, " "), 1, count))


def category_name(value: Column) -> Column:
    """Lower case with single blanks; null unless 1 to 60 characters and not the word for none."""
    name = F.lower(squeezed(F.coalesce(value, F.lit(""))))
    return F.when((F.length(name).between(1, 60)) & (name != "uncategorized"), name)


def classify(description: Column, amount: Column, account_type: Column, ascii_only: bool = False) -> Column:
    """Transaction type by the first rule that holds: words, then sign and account."""
    text = F.concat(normalize_name(description, ascii_only), F.lit(" "), F.upper(F.coalesce(description, F.lit(""))))
    has = lambda words: text.rlike(words)
    card = account_type == "credit_card"
    return (
        F.when(has(TRANSFER_WORDS), "transfer")
        .when(has(PAYMENT_WORDS) & ((card & (amount > 0)) | has("CARD|CRD")), "payment")
        .when(has(r"\bINTEREST\b"), "interest")
        .when(has(r"\bFEE\b") & (amount < 0), "fee")
        .when(amount > 0, F.when(has(REFUND_WORDS) | card, "refund").otherwise("deposit"))
        .when(has(CASH_WORDS), "withdrawal")
        .when(amount < 0, "purchase")
        .otherwise("other")
    )
