"""Column functions: bins, colour, geometry, text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def disparity_bin(d: Column, near: float, step: float, far_step: float) -> Column:
    """Linear bins up to `near`, wider ones beyond."""
    return F.when(d < near, F.floor(d / step)).otherwise(int(near // step) + F.floor((d - near) / far_step))


def scaled_difference(a: Column, b: Column, norm: float) -> Column:
    """Absolute difference, scaled down where the mean exceeds the norm."""
    mean = (a + b) / 2
    return F.abs(a - b) * F.when(mean > norm, F.lit(norm) / mean).otherwise(1.0)


def gamma(v: Column, power: float, toe: float) -> Column:
    """Power law; below the toe a line through 0 that meets it."""
    return F.when(v < toe, v * toe ** (power - 1)).otherwise(F.pow(v, F.lit(power)))


def rgb(y: Column, pb: Column, pr: Column, kr: float = 0.299, kb: float = 0.114) -> tuple[Column, Column, Column]:
    """Red, green, blue of luma and colour differences."""
    r, b = y + 2 * (1 - kr) * pr, y + 2 * (1 - kb) * pb
    return r, (y - kr * r - kb * b) / (1 - kr - kb), b


def world(px: Column, py: Column, disparity: Column, focal_mm: float, base_m: float, pixel_um: float, cx: float, cy: float) -> tuple[Column, Column, Column]:
    """Metres right, up and ahead of a pixel of given disparity under the pinhole model; null where the
    disparity isn't positive."""
    z = F.when(disparity > 0, focal_mm * base_m * 1000 / (disparity * pixel_um))
    scale = z * pixel_um / (1000 * focal_mm)
    return (px - cx) * scale, -(py - cy) * scale, -z


def channel_of(name: Column) -> Column:
    """The number after the last '-' or '_' before a file name's suffix; null without one."""
    return F.try_to_number(F.nullif(F.regexp_extract(name, r"[-_]([0-9]{1,3})\.[^.]*$", 1), F.lit("")), F.lit("999")).cast("int")


def numbers(text: Column) -> Column:
    """Numbers of a list that commas part if there are any, else blanks."""
    return F.transform(F.split(F.trim(text), F.when(F.contains(text, F.lit(",")), F.lit(r"\s*,\s*")).otherwise(F.lit(r"\s+"))), lambda x: F.try_to_number(x, F.lit("S999999.999999")).cast("double"))
