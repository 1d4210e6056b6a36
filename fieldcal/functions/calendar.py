"""Timestamps and calendar categories. All times are zone-less (timestamp_ntz)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldcal.schema import CALENDAR_COLUMNS, MONTHS, WEEKDAYS


def cut_fraction(text: Column) -> Column:
    """Keep what stands before the first dot: fractions of a second are cut, not rounded."""
    return F.substring_index(text, ".", 1)


def parse_time(text: Column) -> Column:
    """``yyyy-MM-dd HH:mm:ss[.f]`` to a zone-less timestamp; malformed text becomes NULL."""
    return cut_fraction(text).try_cast("timestamp_ntz")


def parse_time_day_first(text: Column) -> Column:
    """``dd/MM/yyyy HH:mm:ss`` to a zone-less timestamp; malformed text becomes NULL."""
    iso = F.regexp_replace(text, r"^(\d{2})/(\d{2})/(\d{4}) (\d{2}:\d{2}:\d{2})$", "$3-$2-$1 $4")
    return iso.try_cast("timestamp_ntz")


def station_time_to_utc(ts: Column, offset_hours: int = 1) -> Column:
    """Fixed-offset local time (no daylight saving) to UTC."""
    return ts - F.make_dt_interval(F.lit(0), F.lit(offset_hours))


def floor_hour(ts: Column) -> Column:
    """Start of the hour, independent of the session time zone."""
    return ts - F.make_dt_interval(F.lit(0), F.lit(0), F.minute(ts), F.date_part(F.lit("SECOND"), ts))


def time_text(ts: Column) -> Column:
    """Text without a fraction; the cast does not go through the session time zone."""
    return cut_fraction(ts.cast("string"))


def week_of_month(ts: Column) -> Column:
    """Days 1-7, 8-14, 15-21 and the rest."""
    return F.least(F.lit(4), F.ceil(F.dayofmonth(ts) / 7).cast("int"))


def season(ts: Column) -> Column:
    m = F.month(ts)
    return (
        F.when(m.isin(12, 1, 2), "winter")
        .when(m.isin(3, 4, 5), "spring")
        .when(m.isin(6, 7, 8), "summer")
        .when(m.isNotNull(), "autumn")
    )


def time_of_day(ts: Column) -> Column:
    h = F.hour(ts)
    return (
        F.when(h < 6, "night").when(h < 12, "morning").when(h < 18, "afternoon").when(h.isNotNull(), "evening")
    )


def weekend(ts: Column) -> Column:
    d = F.weekday(ts)
    return F.when(d >= 5, "weekend").when(d.isNotNull(), "weekday")


def _name(names: list[str], one_based: Column) -> Column:
    return F.element_at(F.array(*[F.lit(n) for n in names]), one_based)


def calendar_block(df: DataFrame, ts: str = "timestamp") -> DataFrame:
    """Put the eight calendar attributes first; the timestamp stays a timestamp (text only at a sink)."""
    t = F.col(ts)
    block = {
        "month": _name(MONTHS, F.month(t)),
        "hour": F.hour(t),
        "day_of_week": _name(WEEKDAYS, F.weekday(t) + 1),
        "day_of_month": F.dayofmonth(t),
        "week_of_month": F.concat(F.lit("week"), week_of_month(t).cast("string")),
        "season": season(t),
        "weekend": weekend(t),
        "time_of_day": time_of_day(t),
    }
    rest = [c for c in df.columns if c not in block]
    return df.select(*[block[c].alias(c) for c in CALENDAR_COLUMNS], *rest)
