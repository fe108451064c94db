"""Scalar vocabulary: cleaning, lenient conversion, exact rounding, week arithmetic, keys."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

from studyflow.tables import CERTIFICATION_ID

# Accepted timestamp text: a full date, optionally followed by a time.
TIMESTAMP_TEXT = r"\A\d{4}-\d{2}-\d{2}([ T]\d{2}:\d{2}(:\d{2}(\.\d{1,6})?)?)?\z"


def is_blank(c: Column) -> Column:
    return c.isNull() | (c == "")


def trimmed(name: str) -> Column:
    return F.trim(F.col(name)).alias(name)


def try_decimal(c: Column, precision: int, scale: int) -> Column:
    """Number in text, rounded half-up to the target scale; null when it does not parse or fit."""
    return c.try_cast(f"decimal({precision},{scale})")


def try_timestamp(c: Column) -> Column:
    return F.when(c.rlike(TIMESTAMP_TEXT), c.try_cast("timestamp_ntz"))


def whole_div(a: Column, b: Column) -> Column:
    """Integer division of bigints, truncating."""
    return F.call_function("div", a, b)


def half_up(a: Column, b: Column) -> Column:
    """a / b rounded half-up to a whole number, for a >= 0 and b > 0, without leaving bigint."""
    return whole_div(a * 2 + b, b * 2)


def hundredths(c: Column) -> Column:
    """A two-decimal number as a count of hundredths."""
    return (c * 100).cast("bigint")


def from_hundredths(c: Column, precision: int) -> Column:
    return (c.cast("decimal(18,0)") * F.lit(Decimal("0.01"))).cast(f"decimal({precision},2)")


def from_tenths(c: Column, precision: int) -> Column:
    return (c.cast("decimal(18,0)") * F.lit(Decimal("0.1"))).cast(f"decimal({precision},1)")


def weeks_between(start: Column, end: Column) -> Column:
    """Number of Mondays crossed between two dates (not whole seven-day spans)."""
    return whole_div(
        F.datediff(F.trunc(end, "week"), F.trunc(start, "week")).cast("bigint"),
        F.lit(7).cast("bigint"),
    )


def _digest20(c: Column) -> Column:
    return F.left(F.sha2(c, 256), F.lit(20))


def learner_key(employee_id: Column) -> Column:
    return F.concat(F.lit("LRN_"), _digest20(F.upper(F.trim(employee_id))))


def enrollment_key(employee_id: Column) -> Column:
    subject = F.concat(F.upper(F.trim(employee_id)), F.lit("_" + CERTIFICATION_ID))
    return F.concat(F.lit("ENR_"), _digest20(subject))
