"""Number expressions: locale-aware parsing, clamping, exact sums, half-even rounding."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from merchlens.functions.text import strip

_FLOAT = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


def to_double(c: Column) -> Column:
    return strip(c.cast("string")).try_cast("double")


def strict_double(c: Column) -> Column:
    """Double for plain decimal notation only (no suffix letters such as ``1d``)."""
    return F.when(c.rlike(_FLOAT), c.try_cast("double"))


def clamp(c: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.when(c < low, F.lit(low)).when(c > high, F.lit(high)).otherwise(c)


def half_even(c: Column, digits: int = 0) -> Column:
    return F.bround(c, digits)


def as_int(c: Column) -> Column:
    return F.bround(c, 0).try_cast("long")


_DECIMAL_LIMIT = 1e16


def exact_sum(c: Column) -> Column:
    """Order-independent decimal sum, to twelve decimals, of the amounts below 1e16."""
    return F.sum(F.when(F.abs(c) < _DECIMAL_LIMIT, c).cast("decimal(28,12)"))


def outlier_sum(c: Column) -> Column:
    """Sum as doubles of the amounts :func:`exact_sum` leaves out; NULL without any."""
    return F.sum(F.when(F.abs(c) >= _DECIMAL_LIMIT, c).cast("double"))


def with_outliers(exact: Column, outliers: Column) -> Column:
    """Both parts of a sum as one double; NULL when there was nothing to add."""
    part = exact.cast("double")
    return F.when(outliers.isNull(), part).otherwise(F.coalesce(part, F.lit(0.0)) + outliers)


def money_sum(c: Column) -> Column:
    """Sum that does not depend on the order: added as decimals, handed back as double."""
    return with_outliers(exact_sum(c), outlier_sum(c))


def ratio(top: Column, bottom: Column, default: float = 0.0) -> Column:
    return F.coalesce(F.try_divide(top, bottom), F.lit(default))


def _scaled(text: Column) -> tuple[Column, Column]:
    """Text without its k/m suffix, and the multiplier that suffix stands for."""
    suffix = F.lower(F.right(text, F.lit(1)))
    factor = F.when(suffix == "m", 1_000_000.0).when(suffix == "k", 1_000.0).otherwise(1.0)
    return F.regexp_replace(text, "[kKmM]$", ""), factor


def parse_eu(c: Column) -> Column:
    """``1.234,5k`` style: dots group thousands, the comma is the decimal mark."""
    text, factor = _scaled(strip(c))
    plain = F.replace(F.regexp_replace(text, r"[€$%.]", ""), F.lit(","), F.lit("."))
    return strict_double(strip(plain)) * factor


def parse_us(c: Column) -> Column:
    """``$1,234.5k`` style: commas group thousands, the dot is the decimal mark."""
    text, factor = _scaled(strip(c))
    return strict_double(F.regexp_replace(text, r"[\s$,€£%]", "")) * factor


def parse_amount(c: Column) -> Column:
    """Currency and percent marks and commas dropped, no suffixes."""
    return strict_double(strip(F.regexp_replace(c, r"[%$,]", "")))


def parse_metric(c: Column) -> Column:
    """Lenient metric cell: comma decimals, stray marks dropped, a percent divides by 100."""
    plain = F.regexp_replace(F.replace(c, F.lit(","), F.lit(".")), r"[^0-9.+\-]", "")
    number = strict_double(plain)
    return F.when(c.contains("%"), number / 100.0).otherwise(number)


def repair_dots(c: Column) -> Column:
    """Digits and dots only; with several dots, all but the last are group marks."""
    digits = F.regexp_replace(F.replace(c, F.lit(","), F.lit(".")), r"[^0-9.]", "")
    return strict_double(F.regexp_replace(digits, r"\.(?=.*\.)", ""))


def digits_only(c: Column) -> Column:
    return F.regexp_replace(c, r"[^0-9]", "").try_cast("long")


def parse_number(c: Column, locale: str) -> Column:
    """Parse by locale name: ``eu`` or ``us``."""
    parsers = {"eu": parse_eu, "us": parse_us}
    return parsers[locale](c)


def score_fraction(c: Column) -> Column:
    """Score text to 0–1: a leading number (above 1 read as percent), else a level word."""
    text = F.lower(strip(c))
    first = F.element_at(F.split(strip(F.replace(text, F.lit("%"), F.lit(" "))), r"\s+"), 1)
    number = strict_double(first)
    number = F.when(number > 1, number / 100.0).otherwise(number)
    return (
        F.when(number.between(0, 1), number)
        .when(text.startswith("low"), 0.2)
        .when(text.startswith("med"), 0.5)
        .when(text.startswith("high"), 0.8)
    )
