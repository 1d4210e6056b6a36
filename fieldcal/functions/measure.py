"""Measurement values: number parsing, dew point, device kinds, targets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from fieldcal.schema import STATIC_DEVICE

# Magnus coefficients.
MAGNUS_A = 17.625
MAGNUS_B = 243.04

CLIP_LIMIT = 1e15


def decimal_comma(text: Column) -> Column:
    return F.replace(text, F.lit(","), F.lit(".")).try_cast("double")


def dew_point(temp_c: Column, rh_percent: Column) -> Column:
    """Dew point in degrees Celsius; NULL when the humidity is zero or negative."""
    gamma = F.try_divide(temp_c * MAGNUS_A, temp_c + MAGNUS_B) + F.ln(rh_percent / 100.0)
    return F.try_divide(gamma * MAGNUS_B, F.lit(MAGNUS_A) - gamma)


def device_type(device: Column) -> Column:
    return F.when(device == STATIC_DEVICE, "static").otherwise("dynamic")


def target_label(parameter: str) -> str:
    """Name of the target column for a parameter text."""
    text = parameter.upper()
    if "PM10" in text:
        return "PM10_ARPA"
    if "PM25" in text or "PM2.5" in text:
        return "PM25_ARPA"
    raise ValueError(f"the parameter {parameter} is neither PM10 nor PM25/PM2.5")


def target_label_column(parameter: Column) -> Column:
    """The same label per row; NULL for any other parameter."""
    text = F.upper(parameter)
    return F.when(F.contains(text, F.lit("PM10")), "PM10_ARPA").when(
        F.contains(text, F.lit("PM25")) | F.contains(text, F.lit("PM2.5")), "PM25_ARPA"
    )


def clip(value: Column, limit: float = CLIP_LIMIT) -> Column:
    return F.greatest(F.least(value, F.lit(limit)), F.lit(-limit))


def replace_zero(value: Column, by: float = 1e-8) -> Column:
    return F.when(value == 0, F.lit(by)).otherwise(value)


def round_decimals(value: Column, digits: int = 6) -> Column:
    """``F.round`` of a double, the same to the last bit, without decimal text for nearly every value.

    Below 1e12 scaled units, all errors before the cut together are less than a thousandth of a unit. Values nearer to a half than
    a hundredth, larger ones, NaN and NULL go to ``F.round``. An exact whole number by a power of ten is the nearest double.
    """
    unit = F.lit(10.0**digits)
    scaled = value * unit
    clear = (F.abs(scaled) < 1e12) & (F.abs(scaled - F.floor(scaled) - 0.5) > 0.01)
    return F.when(clear, F.floor(scaled + 0.5).cast("double") / unit).otherwise(F.round(value, digits))
