"""Named row predicates of the ledger."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

SPENDING_TYPES = ("purchase", "fee", "interest", "withdrawal")
MOVING_TYPES = ("transfer", "payment")
INFLOW_TYPES = ("deposit", "interest", "other")


def countable() -> Column:
    """Rows that enter totals: imports unless rejected, extracted rows once verified."""
    return (F.col("review_status") != "rejected") & ((F.col("origin") != "extraction") | (F.col("review_status") == "verified"))


def pending() -> Column:
    """Extracted rows that still wait for review."""
    return (F.col("origin") == "extraction") & F.col("review_status").isin("proposed", "needs_review")


def rejected() -> Column:
    return F.col("review_status") == "rejected"


def with_status(*names: str) -> Column:
    """Any of the statuses counted, pending, rejected."""
    every = {"counted": countable, "pending": pending, "rejected": rejected}
    return reduce(or_, (every[n]() for n in names))


def in_period(start: str, end: str, column: str = "posted_date") -> Column:
    """Both ends included."""
    return F.col(column).between(F.lit(start).cast("date"), F.lit(end).cast("date"))


def spending() -> Column:
    return F.col("transaction_type").isin(*SPENDING_TYPES)


def refund() -> Column:
    return F.col("transaction_type") == "refund"


def metric(name: str) -> Column:
    """What a figure is made of: spending, inflow, cashflow or categories."""
    inflow = F.col("transaction_type").isin(*INFLOW_TYPES) & (F.col("amount_minor") > 0)
    return {"spending": spending() | refund(), "inflow": inflow, "cashflow": spending() | refund() | inflow, "categories": spending()}[name]


def has_words(text: Column, *words: str) -> Column:
    """Every word stands as a whole word in a normalised text."""
    return F.size(F.array_except(F.array(*map(F.lit, words)), F.split(text, " "))) == 0
