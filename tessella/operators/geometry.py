"""Pixels, disparities and places in the world for a camera with radial distortion, as column expressions.

Places are in metres, x to the right, y up, z towards the camera (so in front of it z is negative). Pixels count to
the right and down. Radii are relative to the distortion radius. The inverse of the distortion is a table that the
driver makes once by Newton steps; its size follows from the camera, not from any data.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Slope of distorted over true radius below which a lens can't be inverted, and how near a root must be.
LEAST_SLOPE, NEAR = 0.1, 1e-12


@dataclass(frozen=True)
class Camera:
    """focal, radius of the distortion and base (the distance of a sensor to the centre) in mm, pixel in micrometres; coefficients are those of
    the second power of the radius and up, in the polynomial of distorted radius over true radius from the first power on."""

    focal: float = 4.5
    pixel: float = 2.2
    base: float = 150.0
    width: int = 2592
    height: int = 1936
    radius: float = 2.8512
    coefficients: tuple[float, ...] = (0.0, -0.02, 0.03)
    most: float = 1.1
    step: float = 0.0002
    ports: tuple[tuple[float, float], ...] = field(default=((-0.5, -0.5), (0.5, -0.5), (-0.5, 0.5), (0.5, 0.5)))

    @property
    def scale(self) -> float:
        """Relative radius of a pixel's distance."""
        return 0.001 * self.pixel / self.radius


def ratio(camera: Camera, r):
    """Distorted over true radius at the true radius r, a number or a column; 1 at radius 1."""
    out = 0.0
    for c in reversed(camera.coefficients):
        out = (out + c) * r
    return out + (1.0 - sum(camera.coefficients))


def slope(camera: Camera, r: float) -> float:
    """How fast the distorted radius grows with the true one."""
    return sum((k + 2) * c * r ** (k + 1) for k, c in enumerate(camera.coefficients)) + 1.0 - sum(camera.coefficients)


def reverse_table(camera: Camera) -> list[float]:
    """True over distorted radius at the distorted radii 0, step, 2 step, ...; NaN from where the lens can't be inverted."""
    out = [1.0 / ratio(camera, 0.0)]
    true, rise = 0.0, slope(camera, 0.0)
    for k in range(1, math.ceil(camera.most / camera.step) + 1):
        seen = camera.step * k
        true += camera.step / rise
        for _ in range(100):
            rise = slope(camera, true)
            away = true * ratio(camera, true) - seen
            if rise < LEAST_SLOPE or abs(away) < NEAR:
                break
            true -= away / rise
        if rise < LEAST_SLOPE:
            return out + [math.nan] * (math.ceil(camera.most / camera.step) + 1 - k)
        out.append(true / seen)
    return out


def looked_up(r: Column, table: list[float], step: float) -> Column:
    """Linear interpolation in the table at r; NaN below 0, past the end or where r is NaN, null where it is null."""
    values = F.split(F.lit(",".join(map(repr, table))), ",").cast("array<double>")  # folded to a constant
    at = F.floor(r / step)
    low = F.get(values, at.cast("int"))
    inside = (r >= 0) & (at < len(table) - 1) & ~F.isnan(r)
    return F.when(r.isNull(), F.lit(None)).when(inside, low + (F.get(values, at.cast("int") + 1) - low) * (r / step - at)).otherwise(F.lit(math.nan))


def _centred(camera: Camera, px: Column, py: Column, distorted: bool) -> tuple[Column, Column]:
    """Pixels from the middle as an ideal lens shows them."""
    x, y = px - 0.5 * camera.width, py - 0.5 * camera.height
    if not distorted:
        return x, y
    k = looked_up(F.sqrt(x * x + y * y) * camera.scale, reverse_table(camera), camera.step)
    return x * k, y * k


def world(camera: Camera, px: Column, py: Column, disparity: Column, distorted: bool = True) -> tuple[Column, Column, Column]:
    """(x, y, z) of what a pixel shows at a disparity in pixels; null at disparity 0."""
    x, y = _centred(camera, px, py, distorted)
    unit = F.when(disparity != 0, 0.001 * camera.base / disparity)
    return unit * x, -unit * y, -unit * camera.focal / (0.001 * camera.pixel)


def image(camera: Camera, x: Column, y: Column, z: Column, distorted: bool = True) -> tuple[Column, Column, Column]:
    """(disparity, px, py) of a place; null where z is 0."""
    disparity = F.when(z != 0, -0.001 * camera.base * camera.focal / (z * 0.001 * camera.pixel))
    across, down = x * disparity / (0.001 * camera.base), -y * disparity / (0.001 * camera.base)
    k = ratio(camera, F.sqrt(across * across + down * down) * camera.scale) if distorted else F.lit(1.0)
    return disparity, across * k + 0.5 * camera.width, down * k + 0.5 * camera.height


def plane_disparity(camera: Camera, normal: tuple[Column, Column, Column], px: Column, py: Column, distorted: bool = True) -> Column:
    """Disparity at which a pixel's ray meets the plane through the end of `normal` and square to it; null where
    normal has no length."""
    x, y = _centred(camera, px, py, distorted)
    unit = 0.001 * camera.base
    along = unit * x * normal[0] - unit * y * normal[1] - unit * camera.focal / (0.001 * camera.pixel) * normal[2]
    size = normal[0] * normal[0] + normal[1] * normal[1] + normal[2] * normal[2]
    return F.when(size > 0, along / size)


def port_pixels(camera: Camera, px: Column, py: Column, disparity: Column) -> list[tuple[Column, Column]]:
    """Where each sensor of an ideally built camera sees what the middle sees at a pixel and a disparity: the same pixel at
    disparity 0. Both middles are taken at half the width, as in macro mode, where images are square."""
    x, y = px - 0.5 * camera.width, py - 0.5 * camera.width
    k = looked_up(F.sqrt(x * x + y * y) * camera.scale, reverse_table(camera), camera.step)
    out = []
    for right, down in camera.ports:
        across, below = x * k - disparity * right, y * k - disparity * down
        bend = ratio(camera, F.sqrt(across * across + below * below) * camera.scale)
        out.append((across * bend + 0.5 * camera.width, below * bend + 0.5 * camera.width))
    return out


def rotated(place: tuple[Column, Column, Column], azimuth: float, tilt: float, roll: float, zoom: float = 0.0) -> tuple[Column, Column, Column]:
    """A direction after a sensor's turns in radians (roll about the axis first, then tilt up, then azimuth to the right) and zoom."""
    x, y, z = place
    grow = 1.0 + zoom
    cr, sr, ct, st, ca, sa = math.cos(roll), math.sin(roll), math.cos(tilt), math.sin(tilt), math.cos(azimuth), math.sin(azimuth)
    x, y = grow * (cr * x + sr * y), grow * (-sr * x + cr * y)
    y, z = ct * y + st * z, -st * y + ct * z
    return ca * x - sa * z, y, sa * x + ca * z
