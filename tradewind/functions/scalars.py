"""Column expressions shared by the operators. All of them stay inside code generation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY_US = 86_400_000_000


def moment(text: str) -> Column:
    """A zone-free timestamp literal."""
    return F.lit(text).cast("timestamp_ntz")


def epoch_us(c: Column) -> Column:
    """Microseconds since 1970 of a zone-free timestamp, independent of the session zone."""
    return F.timestamp_diff("MICROSECOND", moment("1970-01-01"), c)


def in_window(ts: Column, start: str, end: str) -> Column:
    """Half-open window ``[start, end)``."""
    return (ts >= moment(start)) & (ts < moment(end))


def normalize_category(c: Column, column: str) -> Column:
    """Trim; blanks and bare 'None' become '<column>_None'. Other texts ending in None are kept."""
    missing = f"{column}_None"
    text = F.trim(F.coalesce(c, F.lit("")))
    return F.when(text.isin("", "None", missing), F.lit(missing)).otherwise(text)


def coerce_number(c: Column) -> Column:
    return c.try_cast("double")


def parse_utc(c: Column) -> Column:
    """Parse 'YYYY-MM-DD HH:MM:SS[.fff] UTC'; anything unreadable becomes null."""
    return F.regexp_replace(c, r"\s*UTC$", "").try_cast("timestamp_ntz")


def repair_zone(c: Column) -> tuple[Column, Column]:
    """Drop a 'Z' that follows an explicit offset; returns (text, repaired flag)."""
    broken = c.endswith("+00:00Z")
    return F.when(broken, F.regexp_replace(c, r"\+00:00Z$", "+00:00")).otherwise(c), broken


def log_relative(price: Column, baseline: Column) -> Column:
    return F.log(price / baseline)


def robust_asinh(y: Column, center: Column, scale: Column) -> Column:
    return F.asinh((y - center) / scale)


def robust_sinh(z: Column, center: Column, scale: Column) -> Column:
    return center + scale * F.sinh(z)


def blend(a: Column, b: Column, weight) -> Column:
    weight = weight if isinstance(weight, Column) else F.lit(float(weight))
    return (F.lit(1.0) - weight) * a + weight * b


def block_index(us: Column, anchor_us, days: int = 14) -> Column:
    """Index of the ``days``-long calendar block counted from the anchor."""
    anchor = anchor_us if isinstance(anchor_us, Column) else F.lit(int(anchor_us))
    return F.floor((us - anchor) / F.lit(days * DAY_US)).cast("bigint")


def period_label(ts: Column, test_start: str, test_end: str) -> Column:
    return (
        F.when(ts < moment(test_start), "development")
        .when(ts < moment(test_end), "temporal_test")
        .otherwise("outside")
    )


def names_where(conditions: dict[str, Column]) -> Column:
    """Array of the names whose condition holds; explode it to count many masks in one pass."""
    return those_where([(c, F.lit(n)) for n, c in conditions.items()], "string")


def those_where(values: list[tuple[Column, Column]], kind: str) -> Column:
    """Array of the values whose condition holds. Compiled as a whole, unlike a compaction, which calls a function an element."""
    none = F.array().cast(f"array<{kind}>")
    return F.flatten(F.array(*[F.when(c, F.array(v)).otherwise(none) for c, v in values]))


def tidy(c: Column, digits: int = 6) -> Column:
    """Rounded double without negative zero, for results compared across engines."""
    return F.round(c, digits) + F.lit(0.0)


def steady(c: Column, digits: int = 6) -> Column:
    """Round a short decimal (a price, a median of prices) with its exact halves moved off the edge."""
    return F.round(c + F.lit(1e-9), digits)


def digest(*columns: str) -> Column:
    """256-bit digest of several columns; equal rows have equal digests, nulls included."""
    # Never null, so joins on it add no null filter over all columns for the optimizer to rewrite.
    return F.coalesce(F.sha2(F.to_json(F.struct(*columns)), 256), F.lit(""))


def hash_number(c: Column) -> Column:
    """First 32 bits of md5 as a number: the same value in every SQL engine."""
    return F.conv(F.substring(F.md5(c.cast("string")), 1, 8), 16, 10).cast("bigint")


def any_of(conditions) -> Column:
    return reduce(lambda a, b: a | b, conditions)
