"""Row quality as flags; values are never changed and rows never dropped."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def target_quality(t: Column, h: Column, t_band: tuple[int, int] = (0, 60), h_band: tuple[int, int] = (0, 100)) -> Column:
    """missing, extreme_glitch, zero_sentinel (both 0), zero_value or ok; the first that applies."""
    extreme = (t < t_band[0]) | (t > t_band[1]) | (h < h_band[0]) | (h > h_band[1])
    return (F.when(t.isNull() | h.isNull(), "missing").when(extreme, "extreme_glitch").when((t == 0) & (h == 0), "zero_sentinel")
            .when((t == 0) | (h == 0), "zero_value").otherwise("ok"))


def pressure_quality(p: list[Column], schema_ok: Column, top: int = 4_095) -> Column:
    """invalid_schema, missing_channel, invalid_encoding, upper_bound or ok; the first that applies."""
    a = F.array(*p)
    return (F.when(~schema_ok, "invalid_schema").when(F.exists(a, lambda x: x.isNull()), "missing_channel")
            .when(F.exists(a, lambda x: (x < 0) | (x > top)), "invalid_encoding").when(F.array_contains(a, F.lit(top).cast("long")), "upper_bound").otherwise("ok"))


def at_bound(p: list[Column], top: int = 4_095) -> Column:
    return F.size(F.filter(F.array(*p), lambda x: x == top))


def channel_state(x: Column, low: int, high: int) -> Column:
    v = x.cast("double")
    return F.when(v.isNull(), "missing").when(F.isnan(v), "non_finite").when(v == 0, "zero").when(v < low, "extreme_low").when(v > high, "extreme_high").otherwise("valid")


def row_pattern(t: Column, h: Column) -> Column:
    """Pattern of two channel states."""
    extreme = t.startswith("extreme") | h.startswith("extreme")
    return F.when((t == "zero") & (h == "zero"), "joint_zero").when(extreme, "extreme").when((t == "zero") | (h == "zero"), "single_zero").otherwise("plain")


def plausible(t: Column, h: Column) -> Column:
    return (t > 0) & (t < 60) & (h > 0) & (h <= 100)


def total(p: list[Column]) -> Column:
    out = p[0]
    for x in p[1:]:
        out = out + x
    return out


def active(p: list[Column]) -> Column:
    return F.size(F.filter(F.array(*p), lambda x: x > 0))


def dominant(frame: Column) -> Column:
    """Position from 0 of the greatest channel, the first of equals; -1 where nothing is loaded."""
    return F.when(F.array_max(frame) > 0, F.array_position(frame, F.array_max(frame)) - 1).otherwise(-1).cast("int")
