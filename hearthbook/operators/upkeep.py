"""Warranties, assets, runs and filing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from hearthbook.functions.money import decimal_text
from hearthbook.operators.review import latest

EXPIRING_DAYS, WARRANTY_MAJOR, MOST_WARRANTY = 60, 100, 600
# The folder of each document type, and the words of barcode tags that name a category, the first class that has one.
FOLDERS = {
    "receipt": "Receipts", "bank_statement": "Bank_Statements", "credit_card_statement": "Credit_Card_Statements", "bill": "Bills", "income": "Income",
    "investment_statement": "Investments", "loan_document": "Loans", "insurance_document": "Insurance", "housing_document": "Housing", "tax_document": "Taxes",
}
CATEGORY_WORDS = {
    "dairy & eggs": ("dairy", "milk", "egg", "cheese", "yogurt"), "produce": ("fruit", "vegetable", "produce"), "meat & seafood": ("meat", "fish", "seafood", "poultry"),
    "bakery": ("bread", "bakery"), "frozen": ("frozen",), "snacks": ("snack", "chip", "biscuit", "cookie", "candy", "chocolate"),
    "beverages": ("beverage", "drink", "juice", "water", "coffee", "tea"),
}
WARRANTY_KINDS = ("manufacturer", "store", "extended")


def warranties(rows: DataFrame) -> DataFrame:
    """rows (warranty_id, bought_on, months or null for lifetime) plus expires_on, lifetime ones last."""
    return rows.withColumn("expires_on", F.expr("add_months(bought_on, months)")).orderBy(F.asc_nulls_last("expires_on"), "warranty_id")


def expiring(rows: DataFrame, today: str, within: int = EXPIRING_DAYS) -> DataFrame:
    day = F.lit(today).cast("date")
    return warranties(rows).where(F.col("expires_on").between(day, F.date_add(day, within)) & (F.col("status") == "in_stock"))


def warranty_suggested(consumable: Column, cost_minor: Column, places: Column) -> Column:
    """Of a product that lasts, at 100 major units or more."""
    return F.coalesce(~consumable & (cost_minor >= WARRANTY_MAJOR * F.pow(F.lit(10), places).cast("bigint")), F.lit(False))


def warranty_error(kind: Column, months: Column, lifetime: Column, consumable: Column, bought_on: Column) -> Column:
    """Why a warranty cannot be kept, else null."""
    return (
        F.when(F.coalesce(consumable, F.lit(False)), "consumable").when(bought_on.isNull(), "no purchase date").when(~F.coalesce(kind.isin(*WARRANTY_KINDS), F.lit(False)), "kind")
        .when(lifetime & months.isNotNull(), "months and lifetime").when(~lifetime & ~F.coalesce(months.between(1, MOST_WARRANTY), F.lit(False)), "months")
    )


def add_warranties(old: DataFrame, new: DataFrame, lots: DataFrame) -> DataFrame:
    """old and new (lot_id, kind, months, lifetime, source, review_status, seq) -> the warranties that stand, with expires_on.

    Per lot and kind the last valid user's entry replaces what there is; a looked-up
    proposal replaces anything but a verified one.  Entries that break a rule are left out.
    """
    error = lambda consumable, bought_on: warranty_error(F.col("kind"), F.col("months"), F.col("lifetime"), consumable, bought_on)
    # what the entry alone shows to be wrong is not shuffled; a lot's entries travel once, as one row
    fine = new.where(error(F.lit(False), F.current_date()).isNull())
    both = old.withColumn("age", F.lit(0)).unionByName(fine.withColumn("age", F.lit(1)))
    # a verified entry holds against proposals, also later ones
    rest = [c for c in old.columns if c not in ("lot_id", "kind", "seq")]
    entry = F.struct("kind", F.struct((F.col("review_status") == "verified").alias("sure"), "age", "seq", *rest).alias("w"))
    each = both.groupBy("lot_id").agg(F.collect_list(entry).alias("entries")).join(lots.select("lot_id", "consumable", "bought_on"), "lot_id")
    stands = ~F.coalesce("consumable", F.lit(False)) & F.col("bought_on").isNotNull()
    last = each.select("lot_id", "bought_on", stands.alias("stands"), F.inline("entries")).where("stands or w.age = 0").groupBy("lot_id", "bought_on", "kind").agg(F.max("w").alias("w"))
    columns = [F.col(c) if c in ("lot_id", "kind") else F.col(f"w.{c}") for c in old.columns]
    return last.select(*columns, "bought_on").withColumn("expires_on", F.expr("case when not lifetime then add_months(bought_on, months) end")).drop("bought_on")


def review_warranties(rows: DataFrame, decisions: DataFrame) -> DataFrame:
    """rows with the last decision on each looked-up warranty; a user's own counts already and takes none."""
    last = latest(decisions, "warranty_id", "seq").select("warranty_id", F.col("status").alias("decided"))
    joined = rows.join(last, "warranty_id", "left")
    return joined.withColumn("review_status", F.when((F.col("source") == "lookup") & F.col("decided").isin("verified", "rejected"), F.col("decided")).otherwise(F.col("review_status"))).drop("decided")


# Kinds of assets, and the yearly rate of a vehicle, in hundredths of a percent, where none is given (of others 0).
ASSET_KINDS, VEHICLE_RATE = ("investment", "retirement", "bond", "real_estate", "vehicle", "other_asset", "loan"), -1500


def asset_error(kind: Column, value_minor: Column, rate_percent: Column, payment_minor: Column) -> Column:
    """Why an asset cannot be kept, else null; the rate is text with at most two decimals between -100 and 100."""
    rate = rate_percent.try_cast("decimal(20,6)")
    return (
        F.when(~F.coalesce(kind.isin(*ASSET_KINDS), F.lit(False)), "kind").when(~F.coalesce(value_minor >= 0, F.lit(False)), "value")
        .when(payment_minor.isNotNull() & (kind != "loan"), "payment of no loan").when(payment_minor < 0, "payment")
        .when(rate_percent.isNotNull() & ~F.coalesce((F.abs(rate) <= 100) & (rate * 100 == F.floor(rate * 100)), F.lit(False)), "rate")
    )


def write_assets(assets_: DataFrame, commands: DataFrame) -> DataFrame:
    """assets (asset_id, kind, value_minor, annual_rate_bp, source, review_status, archived) after commands, in order of seq.

    commands (seq, asset_id, action, kind, value_minor, rate_percent, payment_minor,
    status): add and update write valid values, archive hides, review decides on a
    value read from a statement.  The last of each action counts.
    """
    error = asset_error(F.col("kind"), F.col("value_minor"), F.col("rate_percent"), F.col("payment_minor"))
    writes = latest(commands.where("action in ('add', 'update')").where(error.isNull()), "asset_id", "seq")
    rate = F.coalesce((F.col("rate_percent").try_cast("decimal(20,6)") * 100).cast("bigint"), F.when(F.col("kind") == "vehicle", VEHICLE_RATE).otherwise(0).cast("bigint"))
    w = writes.select("asset_id", F.col("action"), F.col("kind").alias("new_kind"), F.col("value_minor").alias("new_value"), rate.alias("new_rate"))
    gone = commands.where("action = 'archive'").select("asset_id").distinct().withColumn("gone", F.lit(True))
    said = latest(commands.where("action = 'review' and status in ('verified', 'rejected', 'proposed')"), "asset_id", "seq").select("asset_id", F.col("status").alias("decided"))
    old = assets_.withColumn("here", F.lit(True))
    joined = old.join(w, "asset_id", "full_outer").where("here or action = 'add'").join(gone, "asset_id", "left").join(said, "asset_id", "left")
    added = F.col("here").isNull()
    return joined.select(
        "asset_id", F.coalesce("new_kind", "kind").alias("kind"), F.coalesce("new_value", "value_minor").alias("value_minor"), F.coalesce("new_rate", "annual_rate_bp").alias("annual_rate_bp"),
        F.when(added, "manual").otherwise(F.col("source")).alias("source"),
        F.when(added, "verified").when((F.col("source") == "statement") & F.col("decided").isNotNull(), F.col("decided")).otherwise(F.col("review_status")).alias("review_status"),
        (F.coalesce("archived", F.lit(False)) | F.coalesce("gone", F.lit(False))).alias("archived"),
    )


def asset_view(rows: DataFrame) -> DataFrame:
    """Assets as shown: value as money text, and the rate as a percentage without trailing zeros."""
    rate = F.regexp_replace(F.regexp_replace((F.col("annual_rate_bp").cast("decimal(20,2)") / 100).cast("decimal(20,2)").cast("string"), r"(\.\d*?)0+$", "$1"), r"\.$", "")
    return rows.select("asset_id", decimal_text(F.col("value_minor"), F.col("currency")).alias("value"), rate.alias("annual_rate_percent"))


def assets(rows: DataFrame) -> DataFrame:
    """Assets that are not archived, loans last, by name."""
    return rows.where("archived_at is null").orderBy(F.col("kind") == "loan", "name", "asset_id")


def filing_path(kind: Column, date: Column, merchant: Column, document_id: Column, digest: Column, extension: Column) -> Column:
    """Where a classified document is filed: Folder/yyyy/mm/date__label__Folder__digest__dN.ext.

    A known type, a merchant and a date are needed; anything else goes to Unfiled
    without a label.  Labels hold letters only, so no account number can stand in one.
    """
    table = F.create_map(*(F.lit(x) for pair in FOLDERS.items() for x in pair))
    folder = F.when(merchant.isNotNull() & (merchant != "") & date.isNotNull(), F.try_element_at(table, kind))
    words = F.regexp_replace(F.trim(F.regexp_replace(merchant, r"(?U)[^\p{L} _-]+", " ")), r"(?U)\s+", "_")
    label = F.nullif(F.substring(F.regexp_replace(words, "^[_-]+|[_-]+$", ""), 1, 36), F.lit(""))
    end = F.concat(F.substring(digest, 1, 16), F.lit("__d"), document_id.cast("string"), F.lower(extension))
    filed = F.concat(folder, F.date_format(date, "/yyyy/MM/"), F.concat_ws("__", F.date_format(date, "yyyy-MM-dd"), label, folder, end))
    return F.coalesce(filed, F.concat(F.lit("Unfiled/Document__"), end))


def word_category(tags: Column) -> Column:
    """The category that a barcode's tags name; pantry for other tags, other without any."""
    classes = (F.when(F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(tags, w)), name) for name, words in CATEGORY_WORDS.items())
    return F.coalesce(*classes, F.when(F.coalesce(tags, F.lit("")) != "", "pantry").otherwise("other"))


def reuse(runs: DataFrame, keys: list[str]) -> DataFrame:
    """Per key the run to reuse: the newest under way, else the newest that succeeded."""
    usable = runs.where("status in ('queued', 'running', 'succeeded')")
    place = F.row_number().over(W.partitionBy(*keys).orderBy(F.col("status") == "succeeded", F.desc("created_at"), F.desc("id")))
    return usable.withColumn("k", place).where("k = 1").drop("k")


def tokens_per_second(server: Column, usage: Column, size: Column, seconds: Column) -> Column:
    """Struct (rate, source): from the server's figures, else the usage, else a quarter of the bytes."""
    found = F.when(server.isNotNull(), F.struct(server.alias("n"), F.lit("server").alias("source"))).when(usage.isNotNull(), F.struct(usage.alias("n"), F.lit("usage").alias("source"))).otherwise(F.struct((size / 4).alias("n"), F.lit("estimate").alias("source")))
    return F.struct(F.when(seconds > 0, found["n"] / seconds).alias("rate"), found["source"].alias("source"))


def reading_status(issues: Column, text: Column) -> Column:
    """partial where a page was cut or unreadable, or nothing was read; else succeeded."""
    return F.when(F.arrays_overlap(issues, F.array(F.lit("truncated"), F.lit("unreadable_page"))) | (F.trim(F.coalesce(text, F.lit(""))) == ""), "partial").otherwise("succeeded")
