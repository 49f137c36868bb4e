"""Column expressions shared by the operators (all built-in, JVM-side)."""

from flowtally.functions.columns import (
    GRAINS,
    VALUE_BANDS,
    cents,
    event_day,
    exact_sum,
    finite,
    from_cents,
    iso_weekday,
    json_int,
    period_start,
    value_band,
    value_band_order,
)

__all__ = [
    "GRAINS",
    "VALUE_BANDS",
    "cents",
    "event_day",
    "exact_sum",
    "finite",
    "from_cents",
    "iso_weekday",
    "json_int",
    "period_start",
    "value_band",
    "value_band_order",
]
