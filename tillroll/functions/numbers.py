"""Number expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Nearly every number is plain; the other forms are looked at only after that fails.
PLAIN_DECIMAL = r"^[+-]?[0-9]+(?:\.[0-9]*)?$"
PLAIN_WHOLE = r"^[+-]?[0-9]+$"
# Decimal text: digits may be grouped with single underscores, blanks may surround it.
_DIGITS = r"[0-9](?:_?[0-9])*"
_DECIMAL_TEXT = (
    rf"^\s*[+-]?(?:{_DIGITS}(?:\.(?:{_DIGITS})?)?|\.{_DIGITS})(?:[eE][+-]?{_DIGITS})?\s*$"
)
_SPECIAL_TEXT = r"^\s*[+-]?(?i:nan|inf|infinity)\s*$"

# Amounts below LARGEST keep ten places, and ten billion of them add up without loss.
MONEY, LARGEST = "decimal(38,10)", 1e18


def _bare(text: Column) -> Column:
    return F.regexp_replace(text, r"[\s_]", "")


def is_plain_decimal(text: Column) -> Column:
    return text.rlike(PLAIN_DECIMAL)


def text_to_double(text: Column) -> Column:
    """The double a decimal text stands for, NULL where it is not one.

    Stricter than a cast (``1.5d`` is no number) and wider (``1_000`` and ``inf`` are).
    """
    special = F.lower(F.regexp_replace(_bare(text), r"^\+", ""))
    return (
        F.when(is_plain_decimal(text), text.try_cast("double"))
        .when(text.rlike(_DECIMAL_TEXT), _bare(text).try_cast("double"))
        .when(
            text.rlike(_SPECIAL_TEXT),
            F.when(special.endswith("nan"), F.lit(float("nan")))
            .when(special.startswith("-"), F.lit(float("-inf")))
            .otherwise(F.lit(float("inf"))),
        )
    )


def text_to_int(text: Column) -> Column:
    """The integer a text stands for, NULL where it is none or does not fit."""
    return F.when(F.trim(text).rlike(PLAIN_WHOLE), F.trim(text).try_cast("int"))


def double_to_int(number: Column) -> Column:
    """Nearest integer, halves away from zero; NULL where it does not fit."""
    return F.round(number).try_cast("int")


def nan_to_null(number: Column) -> Column:
    return F.when(~F.isnan(number), number)


def money_parts(amount: Column) -> Column:
    """Sums of amounts to be added up further: ``exact`` decimals, and the ``odd`` rest.

    Adding doubles gives a result that depends on the order of addition, so on the
    partitioning; decimals add up the same way everywhere. Only amounts that are infinite,
    NaN or too large for a decimal are added as doubles.
    """
    number = amount.cast("double")
    odd = F.isnan(number) | (F.abs(number) >= F.lit(LARGEST))
    return F.struct(
        F.sum(F.when(~odd, amount).cast(MONEY)).alias("exact"), F.sum(F.when(odd, number)).alias("odd")
    )


def _whole(exact: Column, odd: Column) -> Column:
    plain = F.round(exact, 2).cast("double")
    return F.when(odd.isNotNull(), odd + F.coalesce(exact.cast("double"), F.lit(0.0))).otherwise(plain)


def money_total(parts: Column) -> Column:
    """Sum of ``money_parts``, rounded to cents at the end only; NULL where all are."""
    return _whole(F.sum(parts["exact"]), F.sum(parts["odd"]))


def money_sum(amount: Column) -> Column:
    """Sum of amounts, rounded to cents at the end only."""
    parts = money_parts(amount)
    return _whole(parts["exact"], parts["odd"])


def money_avg(amount: Column) -> Column:
    """Average over the non-null amounts, all of which are in the sum; NULL where there are none."""
    return F.try_divide(money_sum(amount), F.count(amount).cast("double"))


def percent(part: Column, whole: Column) -> Column:
    """Share in percent with one decimal, NULL for an empty whole."""
    return F.round(F.try_divide(part * F.lit(100.0), whole.cast("double")), 1)
