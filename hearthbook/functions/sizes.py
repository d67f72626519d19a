"""Package sizes, quantities and exact prices per standard unit."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Each unit's dimension and its grams, millilitres or pieces times 10**10.
UNITS = {
    "floz": ("volume", 295735295625), "oz": ("mass", 283495231250), "lb": ("mass", 4535923700000), "lbs": ("mass", 4535923700000), "g": ("mass", 10000000000), "kg": ("mass", 10000000000000),
    "ml": ("volume", 10000000000), "l": ("volume", 10000000000000), "ltr": ("volume", 10000000000000), "qt": ("volume", 9463529460000), "pt": ("volume", 4731764730000), "gal": ("volume", 37854117840000),
    "gallon": ("volume", 37854117840000), "ct": ("count", 10000000000), "count": ("count", 10000000000), "pk": ("count", 10000000000), "pack": ("count", 10000000000),
}
STANDARD = {"mass": (100, "per 100 g"), "volume": (100, "per 100 ml"), "count": (1, "per item")}
_UNIT = r"(fl\.?\s*oz|floz|oz|lbs?|kg|g|ml|ltr|l|qt|pt|gallon|gal|count|ct|pk|pack)\b"
_SEVERAL = r"(\d+)\s*(?:x|pk|pack|ct|count)\s*(?:x\s*)?(\d+(?:\.\d+)?)\s*" + _UNIT
_ONE = r"(\d+(?:\.\d+)?)\s*" + _UNIT
WIDE = "decimal(38,0)"


def _thousandths(text: Column) -> Column:
    return (text.try_cast("decimal(18,3)") * 1000).cast(WIDE)


def parse_size(text: Column) -> Column:
    """Struct (dimension, base): base is the content in grams, millilitres or pieces times 10**13; null if unreadable."""
    low = F.lower(F.coalesce(text, F.lit("")))
    several = low.rlike(_SEVERAL)
    part = lambda k: F.when(several, F.regexp_extract(low, _SEVERAL, k)).otherwise(F.regexp_extract(low, _ONE, k - 1) if k > 1 else F.lit("1"))
    unit = F.regexp_replace(part(3), r"[\s.]", "")
    table = lambda k: F.create_map(*(F.lit(x) for u, v in UNITS.items() for x in (u, v[k])))
    dimension, factor = F.try_element_at(table(0), unit), F.try_element_at(table(1), unit)
    base = part(1).try_cast("bigint").cast(WIDE) * _thousandths(part(2)) * factor
    return F.when(dimension.isNotNull() & (base > 0), F.struct(dimension.alias("dimension"), base.cast(WIDE).alias("base")))


def quantity(units: Column) -> Column:
    """Struct (milli, assumed): thousandths of the printed quantity; 1 is assumed where it is missing or unreadable."""
    printed = _thousandths(F.trim(units))
    good = F.coalesce(printed > 0, F.lit(False))
    return F.struct(F.when(good, printed).otherwise(F.lit(1000).cast(WIDE)).alias("milli"), (~good).alias("assumed"))


def standard(dimension: Column) -> Column:
    return F.when(dimension == "count", 1).otherwise(100)


def label(dimension: Column) -> Column:
    return F.coalesce(*(F.when(dimension == d, text) for d, (_, text) in STANDARD.items()))


def unit_price_micro(cost: Column, size: Column, milli: Column) -> Column:
    """Millionths of a minor unit per standard unit, rounded down: what prices are compared by."""
    top = cost.cast(WIDE) * standard(size["dimension"]) * F.lit(10**16).cast(WIDE) * 1_000_000
    below = milli * size["base"]
    return ((top - F.pmod(top, below)) / below).cast(WIDE)


def product_name(brand: Column, name: Column, size: Column) -> Column:
    return F.concat_ws(" ", *(F.nullif(c, F.lit("")) for c in (brand, name, size)))
