"""Column expressions (JVM-side, codegen'd). Each returns a ``Column``."""
from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import (LEGACY_TIME_FORMAT, MAX_T_SIGNAL, MIN_T_SIGNAL, SENTINEL_VALUE,
                      STOP_THRESHOLD)

__all__ = [
    "col_of", "strip_blanks", "map_values", "parse_ts", "null_sentinel_col", "nan_to_null",
    "threshold_flag_col", "hour_of", "weekday_of", "month_of", "day_of", "hour_sin", "hour_cos",
    "guarded_ratio", "do_saturation", "clamp_signal", "was_clamped", "start_floor",
    "clip_nonneg", "encode_category", "ramp_value", "stop_flag",
]


def col_of(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip_blanks(c) -> Column:
    """Remove every blank from a name (``'반응조 A'`` -> ``'반응조A'``)."""
    return F.replace(col_of(c), F.lit(" "), F.lit(""))


def map_values(c, mapping: dict) -> Column:
    """Literal dictionary lookup; unmapped values become null."""
    if not mapping:
        return F.lit(None)
    pairs = []
    for k, v in mapping.items():
        pairs += [F.lit(k), F.lit(v)]
    return F.try_element_at(F.create_map(*pairs), col_of(c))


def parse_ts(c, formats: tuple[str, ...] = (LEGACY_TIME_FORMAT,)) -> Column:
    """P5: try the legacy pattern(s) first, then the generic ISO parser; bad -> null."""
    s = F.trim(col_of(c).cast("string"))
    tries = [F.try_to_timestamp(s, F.lit(f)) for f in formats]
    tries.append(F.try_to_timestamp(s))
    return F.coalesce(*tries).cast("timestamp_ntz")


def nan_to_null(c) -> Column:
    c = col_of(c)
    return F.when(~F.isnan(c), c)


def null_sentinel_col(c, sentinel=SENTINEL_VALUE) -> Column:
    """The sentinel value becomes null."""
    return F.nullif(col_of(c), F.lit(sentinel).cast("double"))


def threshold_flag_col(c, threshold: float) -> Column:
    """1 when value > threshold, else 0 (missing and NaN count as off)."""
    v = nan_to_null(col_of(c))
    return F.coalesce(v > F.lit(threshold), F.lit(False)).cast("int")


def hour_of(c) -> Column:
    return F.hour(col_of(c))


def weekday_of(c) -> Column:
    """Monday = 0 ... Sunday = 6."""
    return F.weekday(col_of(c))


def month_of(c) -> Column:
    return F.month(col_of(c))


def day_of(c) -> Column:
    return F.dayofmonth(col_of(c))


def hour_sin(hour) -> Column:
    return F.sin(F.lit(2 * math.pi) * col_of(hour) / F.lit(24.0))


def hour_cos(hour) -> Column:
    return F.cos(F.lit(2 * math.pi) * col_of(hour) / F.lit(24.0))


def guarded_ratio(num, den, eps: float = 1e-6) -> Column:
    """num / (den + eps); a zero denominator gives null instead of an error."""
    return F.try_divide(col_of(num), col_of(den) + F.lit(eps))


def do_saturation(temp) -> Column:
    """dissolved-oxygen saturation 468 / (31.6 + temp)."""
    return F.try_divide(F.lit(468.0), F.lit(31.6) + col_of(temp))


def clamp_signal(raw, lo: int = MIN_T_SIGNAL, hi: int = MAX_T_SIGNAL) -> Column:
    """clip to [lo, hi], then truncate to int."""
    return F.least(F.greatest(col_of(raw).cast("double"), F.lit(float(lo))), F.lit(float(hi))).cast("int")


def was_clamped(raw, lo: int = MIN_T_SIGNAL, hi: int = MAX_T_SIGNAL) -> Column:
    """flag is set only when the raw value lies outside [lo, hi]."""
    r = col_of(raw).cast("double")
    return ~((r >= F.lit(float(lo))) & (r <= F.lit(float(hi))))


def start_floor(pred, floor: int = MIN_T_SIGNAL) -> Column:
    """int(max(floor, p)); no prediction (null, NaN) stays null, infinities saturate."""
    p = nan_to_null(col_of(pred).cast("double"))
    top = F.lit(float(2 ** 31 - 1))
    return F.when(p.isNotNull(), F.least(F.greatest(F.lit(float(floor)), p), top)).cast("int")


def clip_nonneg(pred) -> Column:
    """max(0, p); no prediction (null, NaN) stays null."""
    p = nan_to_null(col_of(pred).cast("double"))
    return F.when(p.isNotNull(), F.greatest(F.lit(0.0), p))


def encode_category(c, order: list[str]) -> Column:
    """Fixed label order (sorted labels -> 0, 1, ...); unknown -> null."""
    return map_values(c, {v: i for i, v in enumerate(order)}).cast("int")


def ramp_value(ts, v0: float, v1: float, span_days: int) -> Column:
    """Linear ramp over the month: v0 + (v1 - v0) * (day - 1) / span_days."""
    t = (F.dayofmonth(col_of(ts)) - F.lit(1)).cast("double") / F.lit(float(span_days))
    return F.lit(v0) + F.lit(v1 - v0) * t


def stop_flag(signal, threshold: int = STOP_THRESHOLD) -> Column:
    """C4: continue while signal > threshold."""
    return col_of(signal) > F.lit(threshold)
