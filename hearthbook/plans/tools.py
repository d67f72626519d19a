"""Typed questions over a ledger: name, validated input, DataFrame.

``call`` looks a tool up, checks its arguments and builds one plan; nothing runs
until the caller asks for rows.
"""

from __future__ import annotations

import calendar
import datetime
import re
from collections.abc import Callable
from dataclasses import dataclass, fields
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearthbook.functions import predicates as P
from hearthbook.functions.money import DECIMALS
from hearthbook.operators import items as I
from hearthbook.operators import reconcile as R
from hearthbook.operators import review as V
from hearthbook.operators import spending as S
from hearthbook.operators.library import newest

MOST_MONTHS, MOST_DAYS, PAGE, MOST_PAGE = 36, 731, 200, 1000


def _day(text: str) -> datetime.date:
    if not re.fullmatch(r"\d{4}-\d{2}-\d{2}", text):
        raise ValueError(f"not a date: {text}")
    return datetime.date.fromisoformat(text)


@dataclass(frozen=True)
class Period:
    start: str
    end: str
    account_id: int | None = None

    def __post_init__(self):
        if _day(self.start) > _day(self.end):
            raise ValueError("the period ends before it starts")

    def of(self, rows: DataFrame) -> DataFrame:
        kept = rows.where(P.in_period(self.start, self.end))
        return kept if self.account_id is None else kept.where(F.col("account_id") == self.account_id)


@dataclass(frozen=True)
class Series:
    first_month: str
    last_month: str

    def __post_init__(self):
        first, last = (_day(m + "-01") for m in (self.first_month, self.last_month))
        months = (last.year - first.year) * 12 + last.month - first.month + 1
        if not 1 <= months <= MOST_MONTHS:
            raise ValueError(f"ask for 1 to {MOST_MONTHS} months")


@dataclass(frozen=True)
class Anomalies:
    start: str
    end: str

    def __post_init__(self):
        if not 0 <= (_day(self.end) - _day(self.start)).days < MOST_DAYS:
            raise ValueError(f"ask for 1 to {MOST_DAYS} days")


@dataclass(frozen=True)
class Transactions:
    start: str | None = None
    end: str | None = None
    account_id: int | None = None
    currency: str | None = None
    categories: tuple[str, ...] = ()
    types: tuple[str, ...] = ()
    statuses: tuple[str, ...] = ("counted", "pending", "rejected")
    metric: str | None = None
    order: str = "newest"
    limit: int = PAGE
    offset: int = 0

    def __post_init__(self):
        if self.currency is not None and self.currency not in DECIMALS:
            raise ValueError(f"unknown currency: {self.currency}")
        if not 1 <= self.limit <= MOST_PAGE or self.offset < 0:
            raise ValueError(f"ask for 1 to {MOST_PAGE} rows")
        for bound in (self.start, self.end):
            if bound is not None:
                _day(bound)


@dataclass(frozen=True)
class Words:
    query: str = ""


#: Sort column of each order, and whether it rises.
ORDERS = {"newest": ("posted_date", False), "oldest": ("posted_date", True), "largest": ("size", False), "smallest": ("size", True), "description": ("description_raw", True)}


def transactions(tables: Any, ask: Transactions) -> DataFrame:
    rows = tables.transactions.where(P.with_status(*ask.statuses))
    if ask.start:
        rows = rows.where(F.col("posted_date") >= F.lit(ask.start).cast("date"))
    if ask.end:
        rows = rows.where(F.col("posted_date") <= F.lit(ask.end).cast("date"))
    if ask.account_id is not None:
        rows = rows.where(F.col("account_id") == ask.account_id)
    if ask.currency:
        rows = rows.where(F.col("currency") == ask.currency)
    if ask.categories:
        rows = rows.where(S.category().isin(*ask.categories))
    if ask.types:
        rows = rows.where(F.col("transaction_type").isin(*ask.types))
    if ask.metric:
        rows = rows.where(P.metric(ask.metric))
    column, rising = ORDERS[ask.order]
    sized = rows.withColumn("size", F.abs("amount_minor")).withColumn("counted", P.countable())
    key = F.col(column).asc() if rising else F.col(column).desc()
    return sized.orderBy(key, "transaction_id").offset(ask.offset).limit(ask.limit).drop("size")


@dataclass(frozen=True)
class Nothing:
    pass


@dataclass(frozen=True)
class Compare:
    first_start: str
    first_end: str
    second_start: str
    second_end: str

    def __post_init__(self):
        if _day(self.first_start) > _day(self.first_end) or _day(self.second_start) > _day(self.second_end):
            raise ValueError("a period ends before it starts")


@dataclass(frozen=True)
class AsOf:
    as_of: str
    days: int = 30

    def __post_init__(self):
        _day(self.as_of)
        if not 1 <= self.days <= 366:
            raise ValueError("ask for 1 to 366 days")


@dataclass(frozen=True)
class ReceiptSearch:
    start: str | None = None
    end: str | None = None
    merchant: str | None = None
    amount_minor: int | None = None
    currency: str | None = None

    def __post_init__(self):
        for bound in (self.start, self.end):
            if bound is not None:
                _day(bound)
        if self.amount_minor is not None and not self.currency:
            raise ValueError("an amount needs its currency")
        if self.currency is not None and self.currency not in DECIMALS:
            raise ValueError(f"unknown currency: {self.currency}")


@dataclass(frozen=True)
class Record:
    record_id: int


@dataclass(frozen=True)
class Account:
    account_id: int | None = None


@dataclass(frozen=True)
class Stock:
    query: str = ""
    include_closed: bool = False


@dataclass(frozen=True)
class Month:
    month: str
    elapsed: int

    def __post_init__(self):
        if not 0 <= self.elapsed <= self.days:
            raise ValueError("more days have passed than the month has")

    @property
    def days(self) -> int:
        first = _day(self.month + "-01")
        return calendar.monthrange(first.year, first.month)[1]

    def of(self, rows: DataFrame) -> DataFrame:
        return rows.where(P.in_period(f"{self.month}-01", f"{self.month}-{self.days}"))


@dataclass(frozen=True)
class Days:
    days: int = 30
    query: str = ""

    def __post_init__(self):
        if not 1 <= self.days <= 366:
            raise ValueError("ask for 1 to 366 days")


def balances(tables: Any) -> DataFrame:
    """The newest statement of each account that is not rejected."""
    live = tables.statements.where("review_status <> 'rejected'")
    return newest(live, ["account_id"], ["period_end", "statement_id"], "statement_id", "period_end", "closing_balance_minor")


def account_list(tables: Any) -> DataFrame:
    """Accounts with their newest balance and number of counted rows."""
    rows = S.coverage(tables.accounts, tables.transactions).select("account_id", "transactions")
    return tables.accounts.join(balances(tables).select("account_id", "closing_balance_minor"), "account_id", "left").join(rows, "account_id")


def compared(tables: Any, ask: Compare, figure: Callable[[DataFrame], DataFrame], keys: list[str], value: str) -> DataFrame:
    sides = [figure(tables.transactions.where(P.in_period(*p))) for p in ((ask.first_start, ask.first_end), (ask.second_start, ask.second_end))]
    return S.compare(*sides, keys, value)


def receipts(tables: Any, ask: ReceiptSearch, most: int = 100) -> DataFrame:
    """Receipts, newest first, of a period, an amount, and a merchant that shares a word."""
    kept = tables.receipts.where("review_status <> 'rejected'")
    if ask.start:
        kept = kept.where(F.col("purchase_date") >= F.lit(ask.start).cast("date"))
    if ask.end:
        kept = kept.where(F.col("purchase_date") <= F.lit(ask.end).cast("date"))
    if ask.amount_minor is not None:
        kept = kept.where((F.col("total_minor") == abs(ask.amount_minor)) & (F.col("currency") == ask.currency))
    if ask.merchant:
        kept = kept.where(R.overlap(F.col("merchant"), F.lit(ask.merchant)))
    links = tables.receipt_links.where("review_status <> 'rejected'").groupBy("receipt_id").agg(F.min_by("posting_id", "link_id").alias("posting_id"))
    return kept.join(links, "receipt_id", "left").orderBy(F.desc("purchase_date"), "receipt_id").limit(most)


def unmatched(tables: Any, ask: Period) -> DataFrame:
    """Receipts of the period without a charge, and those without a date: why, and how many candidates there are."""
    loose = tables.receipts.where("review_status <> 'rejected'").join(tables.receipt_links.where("review_status <> 'rejected'"), "receipt_id", "left_anti")
    asked = loose.where(F.col("purchase_date").isNull() | P.in_period(ask.start, ask.end, "purchase_date"))
    several = R.receipt_candidates(asked, tables.postings).groupBy("receipt_id").agg(F.count("*").alias("candidates"))
    reason = F.when(F.col("purchase_date").isNull(), "undated").when(F.coalesce("candidates", F.lit(0)) > 1, "several_possible_charges").otherwise("no_matching_charge")
    return asked.join(several, "receipt_id", "left").select("receipt_id", "merchant", "purchase_date", "total_minor", "currency", reason.alias("reason"))


def receipt_matches(tables: Any, ask: Record) -> DataFrame:
    """The links and candidates of one receipt: (posting_id, kind, score, method, review_status)."""
    mine = F.col("receipt_id") == ask.record_id
    links = tables.receipt_links.where(mine).select("posting_id", F.lit("link").alias("kind"), "score", F.col("match_method").alias("method"), "review_status")
    found = R.receipt_candidates(tables.receipts.where(mine), tables.postings).select("posting_id", F.lit("candidate").alias("kind"), "score", "method", F.lit(None).cast("string").alias("review_status"))
    return links.unionByName(found)


def refunds(tables: Any) -> DataFrame:
    """Credits that count, each with the purchase that it returns where that is settled."""
    credits = tables.transactions.where(P.countable() & P.refund()).select(F.col("transaction_id").alias("credit_id"), "posted_date", "amount_minor", "currency")
    links = R.link_refunds(tables.transactions).where("status = 'link'").select("credit_id", "purchase_id", "score")
    return credits.join(links, "credit_id", "left")


TOOLS: dict[str, tuple[type, Callable[[Any, Any], DataFrame]]] = {
    "get_accounts": (Nothing, lambda t, _: account_list(t)),
    "get_account_balance": (Account, lambda t, a: balances(t) if a.account_id is None else balances(t).where(F.col("account_id") == a.account_id)),
    "get_transactions": (Transactions, transactions),
    "get_spending": (Period, lambda t, p: S.totals(p.of(t.transactions))),
    "spending_series": (Series, lambda t, s: S.series(t.transactions, t.transactions.select("currency").distinct(), s.first_month, s.last_month)),
    "get_spending_by_category": (Period, lambda t, p: S.by_category(p.of(t.transactions))),
    "compare_periods": (Compare, lambda t, c: compared(t, c, lambda rows: S.totals(rows).select("currency", "net"), ["currency"], "net")),
    "compare_categories": (Compare, lambda t, c: compared(t, c, S.by_category, ["currency", "category"], "spending")),
    "calculate_cashflow": (Period, lambda t, p: S.cashflow(p.of(t.transactions))),
    "get_recurring_obligations": (Nothing, lambda t, _: R.recurring(t.transactions)),
    "get_upcoming_bills": (AsOf, lambda t, a: R.upcoming_bills(t.bills, t.postings, a.as_of, a.days)),
    "find_receipt": (ReceiptSearch, receipts),
    "get_unmatched_receipts": (Period, unmatched),
    "find_purchase": (Transactions, transactions),
    "get_statement": (Record, lambda t, r: t.statements.where(F.col("statement_id") == r.record_id)),
    "match_receipt_to_transaction": (Record, receipt_matches),
    "get_refunds": (Nothing, lambda t, _: refunds(t)),
    "review_queue": (Nothing, lambda t, _: V.queue(t.receipts, t.bills, t.receipt_links)),
    "get_inventory": (Stock, lambda t, s: I.inventory(t.lots, s.query, s.include_closed).limit(PAGE)),
    "get_budgets": (Month, lambda t, m: S.budgets(t.budgets, m.of(t.transactions), m.days, m.elapsed)),
    "get_categories": (Nothing, lambda t, _: S.categories_in_use(t.transactions, t.budgets.select("category"))),
    "get_item_spending": (Words, lambda t, w: I.item_spending(I.matching(t.lots, w.query))),
    "item_price_history": (Words, lambda t, w: I.price_history(I.matching(t.lots, w.query))),
    "get_price_changes": (Words, lambda t, w: I.price_changes(I.matching(t.lots, w.query))),
    "compare_merchant_prices": (Words, lambda t, w: I.merchant_prices(I.matching(t.lots, w.query))),
    "get_consumption_cost": (Words, lambda t, w: I.consumption_cost(I.matching(t.lots, w.query))),
    "get_waste": (Period, lambda t, p: I.waste(I.matching(t.lots), p.start, p.end)),
    "forecast_consumables_spend": (Days, lambda t, d: I.forecast_consumables(I.matching(t.lots, d.query), d.days)),
    "detect_spending_anomalies": (Anomalies, lambda t, a: S.anomalies(t.transactions, a.start, a.end)),
}
#: What each assistant may ask: about items their own tools and the basics of spending, about anything else the finance tools.
ITEM_ONLY = ("get_item_spending", "item_price_history", "get_price_changes", "compare_merchant_prices", "get_consumption_cost", "get_waste", "forecast_consumables_spend")
ITEM_TOOLS = frozenset({*ITEM_ONLY, "get_inventory", "get_spending", "get_spending_by_category", "get_transactions", "find_receipt"})
FINANCE_TOOLS = frozenset(TOOLS) - frozenset(ITEM_ONLY)


def register_functions(spark: Any) -> None:
    """Makes normalized_name(text) known to SQL, so that queries may filter and order by the key that the ledger writes."""
    from pyspark.sql.types import StringType

    from hearthbook.functions.text import normalized

    spark.udf.register("normalized_name", F.pandas_udf(normalized, StringType()))


def call(tables: Any, name: str, **arguments: Any) -> DataFrame:
    """The answer of a tool over tables, any object with the views as attributes; unknown names and arguments are errors."""
    if name not in TOOLS:
        raise ValueError(f"unknown tool: {name}")
    shape, function = TOOLS[name]
    if extra := arguments.keys() - {f.name for f in fields(shape)}:
        raise ValueError(f"unknown arguments of {name}: {', '.join(sorted(extra))}")
    return function(tables, shape(**arguments))
