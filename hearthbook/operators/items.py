"""Purchases of products: spending, prices, consumption, waste, stock and returns.

Lots are rows (lot_id, product_id, name, brand, size_text, category, merchant,
currency, cost_minor, units, bought_on, closed_on, status).
"""

from __future__ import annotations

import re
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearthbook.functions.ratio import percent, round_half_even
from hearthbook.functions.sizes import label, parse_size, product_name, quantity, unit_price_micro

FOOD = ("produce", "dairy & eggs", "meat & seafood", "bakery", "pantry", "frozen", "snacks", "beverages")
FRESH_DAYS, OTHER_DAYS, CLOSING_DAYS = 7, 28, 14
FRESH = ("produce", "dairy & eggs", "meat & seafood", "bakery")
MICRO = 1_000_000
# Fixed value: the words of a question that count.
MOST_WORDS = 8


def normalize_text(text: Column) -> Column:
    """Upper case, runs of anything but letters, digits and & as one blank."""
    return F.trim(F.regexp_replace(F.upper(F.coalesce(text, F.lit(""))), r"(?U)[^\p{Alnum}&]+", " "))


def asked_words(query: str | None) -> list[str]:
    """The words of a question as ``normalize_text`` gives them, eight at most."""
    return re.sub(r"[^\w&]+|_", " ", (query or "").upper()).split()[:MOST_WORDS]


def _with_words(lots: DataFrame, query: str | None) -> DataFrame:
    """Lots whose name, brand or category contains every word of the query."""
    texts = (normalize_text(F.col("name")), F.upper(F.coalesce("brand", F.lit(""))), F.upper("category"))
    for word in asked_words(query):
        lots = lots.where(reduce(or_, (F.contains(t, F.lit(word)) for t in texts)))
    return lots


def matching(lots: DataFrame, query: str = "") -> DataFrame:
    """Priced lots whose name, brand or category contains every word of the query (eight at most)."""
    return _with_words(lots.where("cost_minor is not null and currency is not null"), query)


def sized(lots: DataFrame) -> DataFrame:
    """Lots plus size, null where the text is unreadable; each distinct text is read once."""
    texts = lots.select("size_text").distinct().withColumn("size", parse_size(F.col("size_text")))
    return lots.join(texts, "size_text", "left")


def priced(lots: DataFrame) -> DataFrame:
    """Lots with a readable size plus dimension, assumed and price (millionths of a minor unit)."""
    rows = sized(lots).where("size is not null").withColumn("q", quantity(F.col("units")))
    return rows.select(*lots.columns, F.col("size.dimension").alias("dimension"), F.col("q.assumed").alias("assumed"), unit_price_micro(F.col("cost_minor"), F.col("size"), F.col("q.milli")).alias("price"))


def shown(price: Column) -> Column:
    """Minor units of a price, rounded half to even."""
    return round_half_even(price, F.lit(MICRO))


def item_spending(lots: DataFrame) -> DataFrame:
    return lots.groupBy("currency").agg(F.sum("cost_minor").cast("bigint").alias("spent"), F.count("*").alias("purchases"))


def top_products(lots: DataFrame, count: int = 15) -> DataFrame:
    named = lots.withColumn("product", product_name(F.col("brand"), F.col("name"), F.col("size_text")))
    return named.groupBy("currency", "product").agg(F.sum("cost_minor").cast("bigint").alias("spent"), F.count("*").alias("purchases")).orderBy(F.desc("spent"), "currency", "product").limit(count)


def price_history(lots: DataFrame, count: int = 100) -> DataFrame:
    """The last purchases with their price per standard unit, null where the size is unreadable."""
    last = lots.orderBy(F.desc("bought_on"), F.desc("lot_id")).limit(count)
    sized = last.withColumn("size", parse_size(F.col("size_text"))).withColumn("q", quantity(F.col("units")))
    return sized.select("lot_id", "bought_on", "merchant", "cost_minor", shown(unit_price_micro(F.col("cost_minor"), F.col("size"), F.col("q.milli"))).alias("unit_minor"), label(F.col("size.dimension")).alias("per"))


def price_changes(lots: DataFrame, count: int = 20) -> DataFrame:
    """Largest rises between a product's first and last purchase, across its package sizes."""
    when = F.struct("bought_on", "lot_id")
    row = F.struct("price", "size_text", "bought_on")
    # by the name as it is written first, so that each distinct name is normalised once
    written = priced(lots).groupBy("name", "brand", "currency", "dimension").agg(F.count("*").alias("n"), F.min_by(row, when).alias("a"), F.min(when).alias("a_when"), F.max_by(row, when).alias("b"), F.max(when).alias("b_when"))
    group = written.groupBy(normalize_text(F.col("name")).alias("product"), "brand", "currency", "dimension")
    ends = group.agg(F.sum("n").alias("n"), F.min_by("a", "a_when").alias("a"), F.max_by("b", "b_when").alias("b")).where("n >= 2 and b.price > a.price")
    rise = F.col("b.price") - F.col("a.price")
    tenths = round_half_even(rise * 1000, F.col("a.price"))
    ranked = ends.orderBy(tenths.desc(), "product", "brand", "currency", "dimension").limit(count)
    return ranked.select(
        "product", "brand", "currency", label(F.col("dimension")).alias("per"), shown(F.col("a.price")).alias("first_minor"), shown(F.col("b.price")).alias("last_minor"),
        percent(rise, F.col("a.price")).alias("percent_change"), (normalize_text(F.col("a.size_text")) != normalize_text(F.col("b.size_text"))).alias("size_changed"),
    )


def merchant_prices(lots: DataFrame) -> DataFrame:
    """Each merchant's latest price per standard unit."""
    rows = priced(lots).withColumn("merchant", F.coalesce("merchant", F.lit("Unknown merchant")))
    last = rows.groupBy("merchant", "currency", "dimension").agg(F.max_by(F.struct("price", "bought_on", "cost_minor"), F.struct("bought_on", "lot_id")).alias("l"))
    return last.select("merchant", "currency", label(F.col("dimension")).alias("per"), shown(F.col("l.price")).alias("unit_minor"), F.col("l.bought_on").alias("bought_on"), F.col("l.cost_minor").alias("cost_minor"))


def rates(lots: DataFrame) -> DataFrame:
    """Per product and currency: cost, days (one a lot at least) and number of finished lots."""
    done = lots.where("status = 'finished' and bought_on is not null and closed_on is not null")
    days = F.greatest(F.lit(1), F.datediff("closed_on", "bought_on"))
    return done.groupBy("product_id", "currency").agg(F.sum("cost_minor").cast("bigint").alias("cost"), F.sum(days).cast("bigint").alias("days"), F.count("*").alias("lots"))


def consumption_cost(lots: DataFrame) -> DataFrame:
    return rates(lots).select("product_id", "currency", round_half_even(F.col("cost"), F.col("days")).alias("per_day"), round_half_even(30 * F.col("cost"), F.col("days")).alias("per_30_days"), "lots", (F.col("lots") < 3).alias("approximate"))


def waste(lots: DataFrame, start: str, end: str) -> DataFrame:
    gone = lots.where("status = 'thrown_out'").where(F.col("closed_on").between(F.lit(start).cast("date"), F.lit(end).cast("date")))
    return gone.groupBy("currency").agg(F.sum("cost_minor").cast("bigint").alias("wasted"), F.count("*").alias("items"))


def forecast_consumables(lots: DataFrame, days: int) -> DataFrame:
    """Projected cost of a month of so many days, of products with two finished lots or more."""
    return rates(lots).where("lots >= 2").select("product_id", "currency", round_half_even(days * F.col("cost"), F.col("days")).alias("projected"), "lots")


def usual_days(lots: DataFrame) -> DataFrame:
    """Days to the next question about a product: the median life of two finished lots or more, else the category's default."""
    life = F.when((F.col("status") == "finished") & F.col("closed_on").isNotNull(), F.datediff("closed_on", "bought_on"))
    per = lots.groupBy("product_id", "category").agg(F.median(life).alias("m"), F.count(life).alias("finished"))
    default = F.when(F.col("category").isin(*FRESH), FRESH_DAYS).otherwise(OTHER_DAYS)
    return per.select("product_id", "category", F.when(F.col("finished") >= 2, F.greatest(F.lit(1), F.bround("m").cast("int"))).otherwise(default).alias("days"))


def policy_of(lots: DataFrame, policies: DataFrame) -> DataFrame:
    """(merchant, policy_id, days) of each merchant's policy: the longest pattern whose words all stand in its name.

    They meet on the pattern's first word, so no merchant is compared with every policy.
    """
    said = lots.select("merchant").distinct().withColumn("words", F.split("merchant", " "))
    asked = policies.withColumn("needs", F.split("pattern", " ")).withColumn("word", F.col("needs")[0])
    fits = said.withColumn("word", F.explode(F.array_distinct("words"))).join(asked, "word").where("size(array_except(needs, words)) = 0")
    best = fits.groupBy("merchant").agg(F.max_by(F.struct("policy_id", "days"), F.struct(F.length("pattern"), -F.col("policy_id"))).alias("best"))
    return best.select("merchant", "best.policy_id", "best.days")


def returnable(lots: DataFrame, policies: DataFrame, today: str) -> DataFrame:
    """Lots in stock that are not food, with their return window: printed on the receipt, else the merchant's policy.

    policies (policy_id, pattern, days); days null is no fixed limit.  Lots may carry
    return_days_printed and opened_on; an opened lot is not returnable.
    """
    own = lambda c, kind: F.col(c) if c in lots.columns else F.lit(None).cast(kind)
    held = lots.withColumns({"printed": own("return_days_printed", "int"), "opened": own("opened_on", "date")}).where("status = 'in_stock' and bought_on is not null").where(~F.col("category").isin(*FOOD))
    joined = held.join(policy_of(lots, policies), "merchant", "left")
    days = F.coalesce("printed", "days")
    until = F.expr("date_add(bought_on, coalesce(printed, days))")
    unlimited = F.col("printed").isNull() & F.col("policy_id").isNotNull() & F.col("days").isNull()
    open_ = unlimited | F.coalesce((days > 0) & (until >= F.lit(today).cast("date")), F.lit(False))
    return joined.select("lot_id", "merchant", "bought_on", until.alias("return_by"), (open_ & F.col("opened").isNull()).alias("returnable"))


def set_policies(policies: DataFrame, entries: DataFrame) -> DataFrame:
    """policies (pattern, days) after entries (seq, pattern, days, deleted): the last one of each pattern counts, of 0 to 730 days or none."""
    fine = entries.where("pattern <> '' and (days is null or days between 0 and 730)")
    last = fine.groupBy("pattern").agg(F.max_by(F.struct(F.col("days").alias("now"), "deleted"), "seq").alias("said"))
    joined = policies.withColumn("here", F.lit(True)).join(last, "pattern", "full_outer").where("said is null or not said.deleted")
    return joined.select("pattern", F.when(F.col("said").isNull(), F.col("days")).otherwise(F.col("said.now")).alias("days"))


def inventory(lots: DataFrame, query: str = "", include_closed: bool = False) -> DataFrame:
    """Lots in stock, or all, whose name, brand or category has every word of the query (eight at most), by name, purchase and id."""
    kept = lots if include_closed else lots.where("status = 'in_stock'")
    return _with_words(kept, query).orderBy("name", "bought_on", "lot_id")


def returns_closing(lots: DataFrame, policies: DataFrame, today: str, within: int = CLOSING_DAYS) -> DataFrame:
    day = F.lit(today).cast("date")
    return returnable(lots, policies, today).where(F.col("returnable") & F.col("return_by").between(day, F.date_add(day, within))).select("lot_id", "return_by")
