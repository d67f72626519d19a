"""Spending, cash flow, budgets and comparisons over transactions.

Every function takes and returns DataFrames; sums are per currency and never
mixed.  A month is the text yyyy-MM.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from hearthbook.functions import predicates as P
from hearthbook.functions.money import DECIMALS
from hearthbook.functions.ratio import percent, round_half_even
from hearthbook.functions.text import first_words, normalize_name


def month_of(date: Column) -> Column:
    return F.date_format(date, "yyyy-MM")


def category() -> Column:
    return F.coalesce("category", F.lit("uncategorized"))


def _sum_if(condition: Column, value: Column) -> Column:
    return F.coalesce(F.sum(F.when(condition, value)), F.lit(0)).cast("bigint")


def totals(rows: DataFrame, *keys: str) -> DataFrame:
    """Per keys and currency: spending, refunds, net and the number of counted rows."""
    counted = rows.where(P.countable() & P.metric("spending"))
    sums = counted.groupBy(*keys, "currency").agg(
        _sum_if(P.spending(), -F.col("amount_minor")).alias("spending"), _sum_if(P.refund(), F.col("amount_minor")).alias("refunds"), F.count("*").alias("transactions"),
    )
    return sums.withColumn("net", F.col("spending") - F.col("refunds"))


def pending_totals(rows: DataFrame, *keys: str) -> DataFrame:
    """Outflow of extracted rows that wait for review."""
    waiting = rows.where(P.pending() & P.spending())
    return waiting.groupBy(*keys, "currency").agg(F.sum(-F.col("amount_minor")).cast("bigint").alias("pending"), F.count("*").alias("transactions"))


def excluded(rows: DataFrame) -> DataFrame:
    """How many counted rows only move money between own accounts."""
    return rows.where(P.countable() & F.col("transaction_type").isin(*P.MOVING_TYPES)).agg(F.count("*").alias("excluded"))


def coverage(accounts: DataFrame, rows: DataFrame) -> DataFrame:
    """First and last counted date and the count, for every account."""
    seen = rows.where(P.countable()).groupBy("account_id").agg(F.min("posted_date").alias("first_date"), F.max("posted_date").alias("last_date"), F.count("*").alias("transactions"))
    return accounts.select("account_id").join(seen, "account_id", "left").na.fill(0, ["transactions"])


def month_spine(spark: SparkSession, first: str, last: str) -> DataFrame:
    """All months from first to last, yyyy-MM."""
    return spark.sql("select date_format(d, 'yyyy-MM') as month from (select explode(sequence(cast(:a as date), cast(:b as date), interval 1 month)) as d)", {"a": first + "-01", "b": last + "-01"})


def series(rows: DataFrame, currencies: DataFrame, first: str, last: str) -> DataFrame:
    """Monthly totals for each currency, empty months included."""
    spine = month_spine(rows.sparkSession, first, last)
    counted = rows.where(F.col("posted_date").between(F.lit(first + "-01").cast("date"), F.last_day(F.lit(last + "-01").cast("date")))).withColumn("month", month_of(F.col("posted_date")))
    grid = currencies.join(spine)  # as many rows as currencies times months
    return grid.join(totals(counted, "month"), ["month", "currency"], "left").na.fill(0)


def by_category(rows: DataFrame) -> DataFrame:
    """Gross spending per currency and category."""
    counted = rows.where(P.countable() & P.spending()).withColumn("category", category())
    return counted.groupBy("currency", "category").agg(F.sum(-F.col("amount_minor")).cast("bigint").alias("spending"), F.count("*").alias("transactions"))


def merchant_key(name: Column) -> Column:
    key = first_words(normalize_name(name, ascii_only=True))
    return F.when(key == "", "UNKNOWN").otherwise(key)


def top_merchants(rows: DataFrame, count: int = 20) -> DataFrame:
    counted = rows.where(P.countable() & P.spending()).withColumn("merchant_key", merchant_key(F.coalesce("merchant", "description_raw")))
    sums = counted.groupBy("merchant_key", "currency").agg(F.sum(-F.col("amount_minor")).cast("bigint").alias("spending"), F.count("*").alias("transactions"))
    return sums.orderBy(F.desc("spending"), "merchant_key", "currency").limit(count)


def compare(first: DataFrame, second: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Full outer comparison of one figure: first, second, change, percent_change (null from nothing)."""
    a, b = first.select(*keys, F.col(value).alias("first")), second.select(*keys, F.col(value).alias("second"))
    both = a.join(b, keys, "full_outer").na.fill(0, ["first", "second"]).withColumn("change", F.col("second") - F.col("first"))
    return both.withColumn("percent_change", percent(F.col("change"), F.col("first")))


def cashflow(rows: DataFrame) -> DataFrame:
    """Per currency: inflow, outflow (spending less refunds) and net."""
    inflow = rows.where(P.countable() & P.metric("inflow")).groupBy("currency").agg(F.sum("amount_minor").cast("bigint").alias("inflow"))
    outflow = totals(rows).select("currency", F.col("net").alias("outflow"))
    return inflow.join(outflow, "currency", "full_outer").na.fill(0, ["inflow", "outflow"]).withColumn("net", F.col("inflow") - F.col("outflow"))


def budgets(plan: DataFrame, rows: DataFrame, days: int, elapsed: int) -> DataFrame:
    """plan (category, currency, amount_minor) against a month's rows, with the pace after elapsed of days days."""
    spent = by_category(rows)
    joined = plan.join(spent, ["category", "currency"], "left").na.fill(0, ["spending", "transactions"])
    budget, used = F.col("amount_minor"), F.col("spending")
    running = F.when(used * days > budget * elapsed, "ahead_of_pace").otherwise("on_track")
    status = F.when(used > budget, "over").when(F.lit(elapsed) == 0, "not_started").when(F.lit(elapsed) == days, "within").otherwise(running)
    return joined.select("category", "currency", budget.alias("budget"), used.alias("spent"), (budget - used).alias("remaining"), "transactions", percent(used, budget).alias("percent_used"), status.alias("status"))


def unbudgeted(plan: DataFrame, rows: DataFrame) -> DataFrame:
    left = by_category(rows).join(plan, ["category", "currency"], "left_anti")
    return left.groupBy("currency").agg(F.sum("spending").cast("bigint").alias("spent"), F.sum("transactions").alias("transactions"))


def categories_in_use(rows: DataFrame, *others: DataFrame) -> DataFrame:
    """Categories of transactions, budgets and rules with their number of transactions."""
    used = rows.where("category is not null").groupBy("category").agg(F.count("*").alias("n"))
    for other in others:
        used = used.unionByName(other.select("category", F.lit(0).cast("bigint").alias("n")))
    return used.groupBy("category").agg(F.sum("n").alias("transactions"))


def dashboard_groups(rows: DataFrame, currency: str, named: int = 5) -> DataFrame:
    """The largest named categories, Other for the rest, and uncategorized, each with its share of all."""
    sums = by_category(rows).where(F.col("currency") == currency)
    place = F.row_number().over(W.partitionBy("plain").orderBy(F.desc("spending"), "category"))
    ranked = sums.withColumn("plain", F.col("category") != "uncategorized").withColumn("place", place)
    label = F.when(~F.col("plain") | (F.col("place") <= named), F.col("category")).otherwise("Other")
    grouped = ranked.groupBy(label.alias("category")).agg(F.sum("spending").cast("bigint").alias("spending"), F.sum("transactions").alias("transactions"))
    whole = sums.agg(F.sum("spending").cast("bigint").alias("whole"))  # one row
    return grouped.join(F.broadcast(whole)).withColumn("share", F.coalesce(percent(F.col("spending"), F.col("whole")), F.lit("0.0"))).drop("whole")


def anomalies(rows: DataFrame, start: str, end: str, minimum: int = 20, count: int = 20) -> DataFrame:
    """Categories and merchants far above their mean of the three preceding periods of equal length."""
    first, last = F.lit(start).cast("date"), F.lit(end).cast("date")
    length = F.datediff(last, first) + 1
    age = F.floor(F.datediff(last, F.col("posted_date")) / length)
    recent = rows.where(P.countable() & P.spending()).where(F.col("posted_date").between(F.date_sub(first, 3 * length), last)).withColumn("age", age)
    kinds = F.array(
        F.struct(F.lit("category").alias("kind"), category().alias("name")),
        F.struct(F.lit("merchant").alias("kind"), merchant_key(F.coalesce("merchant", "description_raw")).alias("name")),
    )
    each = recent.select("currency", "age", (-F.col("amount_minor")).alias("amount"), F.explode(kinds).alias("k")).select("currency", "age", "amount", "k.*")
    sums = each.groupBy("kind", "currency", "name").agg(
        F.sum(F.when(F.col("age") == 0, F.col("amount"))).cast("bigint").alias("spent"), _sum_if(F.col("age") > 0, F.col("amount")).alias("before"),
    ).where("spent is not null")
    least = minimum * F.pow(F.lit(10), F.element_at(F.create_map(*(F.lit(x) for p in DECIMALS.items() for x in p)), F.col("currency"))).cast("bigint")
    rise = 3 * F.col("spent") - F.col("before")
    flagged = sums.where((rise >= 3 * least) & ((F.col("before") == 0) | (2 * F.col("spent") > F.col("before"))))
    ranked = flagged.orderBy(rise.desc(), "kind", "currency", "name").limit(count)
    return ranked.select("kind", "name", "currency", "spent", round_half_even(F.col("before"), F.lit(3)).alias("usual"), percent(rise, F.col("before")).alias("percent_above_usual"), (F.col("before") == 0).alias("new"))
