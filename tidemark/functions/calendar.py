"""Calendar, season and trading-session features of a timestamp column."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def _cycle(x: Column, period: float) -> tuple[Column, Column]:
    angle = x * (2 * math.pi) / period
    return F.sin(angle), F.cos(angle)


def _int(cond: Column) -> Column:
    return cond.cast("int")


def time_basic(ts: Column) -> dict[str, Column]:
    day = ts.cast("date")
    month, quarter = F.month(ts), F.quarter(ts)
    hour_sin, hour_cos = _cycle(F.hour(ts), 24)
    day_sin, day_cos = _cycle(F.weekday(day), 7)
    month_sin, month_cos = _cycle(month, 12)
    first, last = F.dayofmonth(day) == 1, day == F.last_day(day)
    return {
        "hour": F.hour(ts), "day_of_week": F.weekday(day), "day_of_month": F.dayofmonth(day),
        "month": month, "quarter": quarter, "year": F.year(ts),
        "hour_sin": hour_sin, "hour_cos": hour_cos, "day_sin": day_sin, "day_cos": day_cos,
        "month_sin": month_sin, "month_cos": month_cos,
        "is_weekend": _int(F.weekday(day) >= 5),
        "is_month_start": _int(first), "is_month_end": _int(last),
        "is_quarter_start": _int(first & (month % 3 == 1)),
        "is_quarter_end": _int(last & (month % 3 == 0)),
        "is_year_start": _int(first & (month == 1)),
        "is_year_end": _int(last & (month == 12)),
    }


def time_season(ts: Column) -> dict[str, Column]:
    day = ts.cast("date")
    month, doy, week = F.month(day), F.dayofyear(day), F.weekofyear(day)
    doy_sin, doy_cos = _cycle(doy, 365)
    week_sin, week_cos = _cycle(week, 52)
    return {
        "day_of_year": doy, "week_of_year": week,
        # winter is December to February: 12, 1, 2 -> 1; 3..5 -> 2; 6..8 -> 3; 9..11 -> 4
        "season": (F.floor((month % 12) / 3) + 1).cast("int"),
        "day_of_year_sin": doy_sin, "day_of_year_cos": doy_cos,
        "week_of_year_sin": week_sin, "week_of_year_cos": week_cos,
    }


def time_session(ts: Column) -> dict[str, Column]:
    h, m = F.hour(ts), F.minute(ts)
    return {
        "is_premarket": _int(h.between(4, 8)),
        "is_regular_hours": _int(h.between(9, 15)),
        "is_afterhours": _int(h.between(16, 19)),
        "is_overnight": _int((h >= 20) | (h < 4)),
        "minutes_to_open": F.when(h < 9, (9 - h) * 60 - m).when(h >= 16, (33 - h) * 60 - m).otherwise(0),
        "minutes_to_close": F.when(h < 16, (16 - h) * 60 - m).otherwise(0),
    }
