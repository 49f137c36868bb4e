"""Column building blocks.

Amounts are money with two decimals.  They are summed as whole cents in
BIGINT: exact, so a total does not depend on the order in which partitions
are combined (a DOUBLE sum does), and about ten times faster than a DECIMAL
sum, whose DECIMAL(28,2) buffer Spark cannot keep in a primitive long.  A
total is converted to DOUBLE once, at the end (cents / 100, correctly
rounded).  Calendar buckets go through DATE, which has no time zone.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

GRAINS = ("day", "week", "month")

# The value bands, as (order, label, lower bound inclusive,
# upper bound exclusive).  Rows with a null, NaN or infinite value go to order
# 0, "unknown".
VALUE_BANDS = (
    (1, "under_10", None, 10.0),
    (2, "10_to_50", 10.0, 50.0),
    (3, "50_to_100", 50.0, 100.0),
    (4, "100_to_250", 100.0, 250.0),
    (5, "250_and_over", 250.0, None),
)


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def cents(c: str | Column = "value", scale: int = 100) -> Column:
    """The value in whole cents (BIGINT), rounded half away from zero.

    For values with at most two decimals this equals casting to
    DECIMAL(18,2).  ``scale`` = 100 for cents; other powers of ten give other
    fixed-point units.  NaN and infinite values are null: they count as rows
    but add nothing to a sum and are no quantile.
    """
    x = _col(c) * F.lit(float(scale))
    rounded = F.when(x >= 0, F.floor(x + F.lit(0.5))).otherwise(F.ceil(x - F.lit(0.5)))
    return F.when(F.abs(x) < F.lit(float("inf")), rounded)  # NaN sorts above infinity


def finite(c: str | Column = "value") -> Column:
    """The value, or null for NaN and infinite ones: the rule for amounts that
    ``cents`` follows too, for maxima and bands."""
    return F.when(F.abs(_col(c)) < F.lit(float("inf")), _col(c))


def from_cents(total: str | Column, scale: int = 100) -> Column:
    """A cents total as DOUBLE (nearest double to total / scale)."""
    return _col(total).cast("double") / F.lit(float(scale))


def exact_sum(c: str | Column = "value") -> Column:
    """Order-independent sum of an amount column, returned as DOUBLE."""
    return from_cents(F.sum(cents(c)))


def event_day(ts: str | Column = "ts") -> Column:
    return F.to_date(_col(ts))


def period_start(ts: str | Column = "ts", grain: str = "day") -> Column:
    """First day of the day / ISO week (Monday) / month holding ``ts``."""
    day = event_day(ts)
    if grain == "day":
        return day
    if grain == "week":
        return F.trunc(day, "week")
    if grain == "month":
        return F.trunc(day, "month")
    raise ValueError(f"grain must be one of {GRAINS}, got {grain!r}")


def iso_weekday(ts: str | Column = "ts") -> Column:
    """1 = Monday ... 7 = Sunday."""
    return (F.weekday(_col(ts)) + 1).cast("int")


# A JSON object of plain strings (no escapes), numbers and literals.
_STRING = r'"[^"\\\x00-\x1f]*"'
_NUMBER = r"-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?"
_MEMBER = rf"[ \t\r\n]*{_STRING}[ \t\r\n]*:[ \t\r\n]*(?:{_STRING}|{_NUMBER}|true|false|null)[ \t\r\n]*"
FLAT_OBJECT = rf"^[ \t\r\n]*\{{{_MEMBER}(?:,{_MEMBER})*\}}[ \t\r\n]*\z"


def json_int(c: str | Column, key: str) -> Column:
    """Integer under a top-level JSON key; null if the whole text is not one
    JSON value, the key is missing, or its value is not an integer token
    (``2.5``, ``1e3``; ``"7"`` quoted as text is accepted as 7; overflow gives
    null).  The key is taken literally, dots included."""
    if "'" in key:
        raise ValueError("keys with a quote are not supported")
    text = _col(c)
    raw = F.get_json_object(text, f"$['{key}']")
    # Most texts are flat objects, which one look settles.  The parser stops
    # after the first value, so only one whole value parses both as an array's
    # element and as an object's member.
    element = F.try_parse_json(F.concat(F.lit("["), text, F.lit("]")))
    member = F.try_parse_json(F.concat(F.lit('{"x":'), text, F.lit("}")))
    whole = F.when(text.rlike(FLAT_OBJECT), F.lit(True)).otherwise(element.isNotNull() & member.isNotNull())
    return F.when(raw.rlike(r"^-?[0-9]+$"), F.when(whole, raw.try_cast("int")))


def _band_expr(c: Column, pick: int) -> Column:
    expr = None
    for band in VALUE_BANDS:
        lower, upper = band[2], band[3]
        cond = c.isNotNull()
        if lower is not None:
            cond = cond & (c >= F.lit(lower))
        if upper is not None:
            cond = cond & (c < F.lit(upper))
        expr = F.when(cond, F.lit(band[pick])) if expr is None else expr.when(cond, F.lit(band[pick]))
    return expr.otherwise(F.lit(0 if pick == 0 else "unknown"))


def value_band(c: str | Column = "value") -> Column:
    return _band_expr(finite(c), 1)


def value_band_order(c: str | Column = "value") -> Column:
    return _band_expr(finite(c), 0).cast("int")
