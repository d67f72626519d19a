"""From printed receipt lines to products and lots: known matches, proposals, their review, and what still waits.

Lines are rows (line_id, receipt_id, position, merchant, description, product_code,
quantity, cost_minor, currency, purchase_date); resolutions are rows
(resolution_id, line_id, name, brand, size_text, category, consumable, barcode,
method, review_status); aliases are rows (alias_id, merchant, text, code, product).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from hearthbook.functions.checks import valid_gtin
from hearthbook.operators.items import FRESH, FRESH_DAYS, OTHER_DAYS, normalize_text
from hearthbook.operators.review import latest
from hearthbook.operators.upkeep import word_category

OPEN = "review_status in ('proposed', 'verified')"
#: What a row is to ``outcomes``, in the order in which a line's rows are read; a bit each.
LINE, SETTLED, REFUSED, OFFERED = 1, 2, 4, 8


def product_key(name: Column, brand: Column, size_text: Column) -> Column:
    """What makes two resolutions one product: the normalised name, and brand and size as printed or missing."""
    return F.to_json(F.struct(normalize_text(name).alias("n"), brand.alias("b"), size_text.alias("s")))


def line_status(lines: DataFrame, resolutions: DataFrame) -> DataFrame:
    """lines plus resolution_status: verified before proposed, of its resolutions that are not rejected; null without one."""
    alive = resolutions.where("review_status <> 'rejected'")
    best = alive.groupBy("line_id").agg(F.max_by("review_status", F.struct((F.col("review_status") == "verified").alias("sure"), "resolution_id")).alias("resolution_status"))
    return lines.join(best, "line_id", "left")


def to_identify(receipts: DataFrame, lines: DataFrame, resolutions: DataFrame) -> DataFrame:
    """(receipt_id, lines, unresolved) of receipts with lines that have neither an open proposal nor a product."""
    done = resolutions.where(OPEN).select("line_id").distinct().withColumn("done", F.lit(1))
    tally = lines.join(done, "line_id", "left").groupBy("receipt_id").agg(F.count("*").alias("lines"), F.sum(F.when(F.col("done").isNull(), 1).otherwise(0)).alias("unresolved"))
    return receipts.where("review_status <> 'rejected'").select("receipt_id").join(tally.where("unresolved > 0"), "receipt_id")


def known(lines: DataFrame, aliases: DataFrame, barcodes: DataFrame | None = None) -> DataFrame:
    """(line_id, product, method) by the first source that knows the line: alias, history, barcode.

    An alias is a code, or else a text, at the line's own merchant; history is the
    code at any other; barcodes (code, product, tags) count for codes whose check
    digit is right.  Newer aliases win.  Lines that nobody knows are left out.
    """
    # a line without a code, or without a text, gets a key of its own that no alias has: equal nulls would all meet in one task
    own = lambda value: F.when(value.isNotNull(), F.concat(F.lit("="), value)).otherwise(F.concat(F.lit("line "), F.col("line_id").cast("string")))
    keyed = aliases.withColumns({k: F.concat(F.lit("="), k) for k in ("code", "text")})
    last = lambda keys: keyed.where(" and ".join(f"{k} is not null" for k in keys)).groupBy(*keys).agg(F.max_by("product", "alias_id").alias("_".join(keys)))
    said = lines.select("line_id", "merchant", own(F.col("product_code")).alias("code"), own(F.nullif(normalize_text(F.col("description")), F.lit(""))).alias("text"))
    joined = said.join(last(["merchant", "code"]), ["merchant", "code"], "left").join(last(["merchant", "text"]), ["merchant", "text"], "left").join(last(["code"]).toDF("code", "elsewhere"), "code", "left")
    alias = F.coalesce("merchant_code", "merchant_text")
    product, method = F.coalesce(alias, "elsewhere"), F.when(alias.isNotNull(), "alias").when(F.col("elsewhere").isNotNull(), "history")
    if barcodes is not None:
        # a code's check digit is read once a code, not once a line
        listed = barcodes.where(valid_gtin(F.col("code"))).groupBy(F.concat(F.lit("="), "code").alias("code")).agg(F.min("product").alias("scanned"))
        joined = joined.join(listed, "code", "left")
        fits = F.col("scanned").isNotNull()
        product, method = F.coalesce(product, F.when(fits, F.col("scanned"))), F.coalesce(method, F.when(fits, "barcode"))
    return joined.select("line_id", product.alias("product"), method.alias("method")).where("product is not null")


def barcode_products(found: DataFrame) -> DataFrame:
    """found (code, name, brand, size_text, tags) as proposals' fields, with the category that the tags name."""
    return found.select("code", "name", "brand", "size_text", word_category(F.col("tags")).alias("category"), F.lit(True).alias("consumable"), F.col("code").alias("barcode"))


def propose(lines: DataFrame, resolutions: DataFrame, proposals: DataFrame) -> DataFrame:
    """proposals (line_id, name, seq, ...) plus outcome: proposed, unknown_line, settled, rejected_before, or repeated after another of the batch."""
    said = resolutions.select("line_id", resolution_part(F.col("review_status")).alias("part"), "name").where("part is not null")
    rows = lines.select("line_id", F.lit(LINE).alias("part")).unionByName(said, allowMissingColumns=True).where("line_id is not null")
    return outcomes(proposals.withColumn("part", F.lit(OFFERED)).unionByName(rows, allowMissingColumns=True)).select(*proposals.columns, "outcome")


def resolution_part(status: Column) -> Column:
    """What a resolution is to ``outcomes``; null for one that decides nothing."""
    return F.when(status.isin("proposed", "verified"), SETTLED).when(status == "rejected", REFUSED)


def outcomes(rows: DataFrame) -> DataFrame:
    """The OFFERED rows plus outcome, of lines, resolutions and proposals as rows (line_id, part, name, seq, ...) of one table.

    They are dealt out once, by line, and sorted once: of a line's rows those without a key come first, then
    by key the refused before the offered.  Rows of a line that stand together add little to a shuffle.
    """
    keyed = rows.withColumn("key", F.when(F.col("part").isin(REFUSED, OFFERED), normalize_text(F.col("name"))))
    line, key = (w.rowsBetween(W.unboundedPreceding, W.currentRow) for w in (W.partitionBy("line_id").orderBy("key", "part"), W.partitionBy("line_id", "key").orderBy("part")))
    known = keyed.withColumn("of_line", F.bit_or("part").over(line)).withColumn("of_key", F.bit_or("part").over(key))
    has = lambda met, kind: F.col(met).bitwiseAND(kind) > 0
    why = F.when(~has("of_line", LINE), "unknown_line").when(has("of_line", SETTLED), "settled").when(has("of_key", REFUSED), "rejected_before")
    told = known.where(F.col("part") == OFFERED).withColumn("why", why)
    # of those that nothing speaks against one row of the least seq is proposed; null is the least
    left = F.when(F.col("why").isNull(), F.struct("seq"))
    told = told.withColumn("least", F.coalesce(left == F.min(left).over(W.partitionBy("line_id")), F.lit(False)).cast("int"))
    first = (F.col("least") == 1) & (F.sum("least").over(line) == 1)
    return told.withColumn("outcome", F.coalesce("why", F.when(first, "proposed").otherwise("repeated"))).drop("part", "key", "of_line", "of_key", "why", "least")


def review(resolutions: DataFrame, decisions: DataFrame) -> DataFrame:
    """resolutions with the first decision (resolution_id, seq, status, and name, brand, size_text, category or null for the user's edits) on each that is proposed.

    A verified one gets its product; edits make it the user's.
    """
    place = F.row_number().over(W.partitionBy("resolution_id").orderBy("seq"))
    first = decisions.where("status in ('verified', 'rejected')").withColumn("k", place).where("k = 1")
    edits = ["name", "brand", "size_text", "category"]
    said = first.select("resolution_id", F.col("status").alias("decided"), *(F.col(c).alias(f"to_{c}") for c in edits))
    joined = resolutions.join(said, "resolution_id", "left")
    open_ = F.col("review_status") == "proposed"
    yes = open_ & (F.col("decided") == "verified")
    edited = yes & F.col("to_name").isNotNull()
    changed = {c: F.when(edited, F.col(f"to_{c}")).otherwise(F.col(c)) for c in edits}
    out = joined.withColumns({**changed, "method": F.when(edited, "user").otherwise(F.col("method")), "review_status": F.when(open_ & F.col("decided").isNotNull(), F.col("decided")).otherwise(F.col("review_status")), "approved": F.coalesce(yes, F.lit(False))})
    return out.withColumn("product", F.when(F.col("review_status") == "verified", product_key(F.col("name"), F.col("brand"), F.col("size_text")))).select(*resolutions.columns, "product", "approved")


def products(verified: DataFrame) -> DataFrame:
    """One row a product of the verified resolutions: the last approval's name and category, the last known barcode."""
    rows = verified.where("review_status = 'verified'")
    last = lambda c, when=None: F.max_by(c, F.when(when, F.col("resolution_id")) if when is not None else "resolution_id").alias(c)
    return rows.groupBy("product").agg(last("name"), last("category"), last("consumable"), last("barcode", F.col("barcode").isNotNull()))


def new_aliases(approved: DataFrame, lines: DataFrame) -> DataFrame:
    """(merchant, text, code, product): the latest approval for a printed text of a merchant wins."""
    said = lines.where("merchant is not null").select("line_id", "merchant", normalize_text(F.col("description")).alias("text"), F.col("product_code").alias("code"))
    joined = approved.where("approved").join(said, "line_id")
    return joined.groupBy("merchant", "text").agg(F.max_by(F.struct("code", "product"), "resolution_id").alias("last")).select("merchant", "text", "last.code", "last.product")


def first_checks(lots: DataFrame) -> DataFrame:
    """(product, usual): the median life of a product's finished lots, where there are two."""
    life = F.when((F.col("status") == "finished") & F.col("closed_on").isNotNull(), F.datediff("closed_on", "bought_on"))
    return lots.groupBy("product").agg(F.median(life).alias("m"), F.count(life).alias("n")).where("n >= 2").select("product", F.greatest(F.lit(1), F.bround("m").cast("int")).alias("usual"))


def add_lots(lots: DataFrame, approved: DataFrame, lines: DataFrame, today: str) -> DataFrame:
    """lots (receipt_id, position, product, bought_on, closed_on, status, next_check_on) after the approvals.

    A line that has a lot changes its product; another gets a lot in stock.  A new
    lot of something that runs out is asked about after its product's usual life,
    and brings the question about older lots of the product forward to today.
    """
    day = F.lit(today).cast("date")
    said = lines.select("line_id", "receipt_id", "position", F.coalesce("purchase_date", day).alias("came"))
    made = latest(approved.where("approved"), "line_id", "resolution_id").select("line_id", F.col("product").alias("made"), "category", "consumable").join(said, "line_id").drop("line_id")
    joined = lots.withColumn("here", F.lit(True)).join(made, ["receipt_id", "position"], "full_outer")
    fresh = F.col("here").isNull()
    kept = joined.withColumn("product", F.coalesce("made", "product")).join(first_checks(lots), "product", "left")
    span = F.coalesce("usual", F.when(F.col("category").isin(*FRESH), FRESH_DAYS).otherwise(OTHER_DAYS))
    asked = F.when(F.col("consumable"), F.greatest(F.date_add("came", span), day))
    kept = kept.select(
        "receipt_id", "position", "product", F.when(fresh, F.col("came")).otherwise(F.col("bought_on")).alias("bought_on"), "closed_on", F.coalesce("status", F.lit("in_stock")).alias("status"),
        F.when(fresh, asked).otherwise(F.col("next_check_on")).alias("next_check_on"), (fresh & F.coalesce("consumable", F.lit(False))).alias("again"),
    )
    # the newest of a product's new lots, and how many there are on its day: it does not bring itself forward
    newest = kept.where("again").groupBy("product").agg(F.max("bought_on").alias("since"))
    pulled = kept.join(newest, "product", "left")
    older = (F.col("status") == "in_stock") & (F.col("bought_on") <= F.col("since")) & ~(F.col("again") & (F.col("bought_on") == F.col("since")))
    return pulled.select(*lots.columns[:-1], F.when(F.coalesce(older, F.lit(False)), F.least(F.coalesce("next_check_on", day), day)).otherwise(F.col("next_check_on")).alias("next_check_on"))
