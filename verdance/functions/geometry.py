"""Boxes, angles and paths as column expressions."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Box:
    """A box by its four columns; it exists if its width and height are over 0."""

    x: Column
    y: Column
    w: Column
    h: Column

    @classmethod
    def of(cls, prefix: str = "", alias: str = "") -> Box:
        name = lambda c: F.col(f"{alias}.{prefix}bbox_{c}" if alias else f"{prefix}bbox_{c}").cast("double")
        return cls(name("x"), name("y"), name("w"), name("h"))

    @property
    def exists(self) -> Column:
        return F.coalesce((self.w > 0) & (self.h > 0), F.lit(False))

    @property
    def centre(self) -> tuple[Column, Column]:
        return F.when(self.exists, self.x + self.w / 2), F.when(self.exists, self.y + self.h / 2)

    def meets(self, other: Box, margin: float = 0.0) -> Column:
        """Whether the boxes overlap or come within ``margin``."""
        return (
            (self.x < other.x + other.w + margin)
            & (other.x < self.x + self.w + margin)
            & (self.y < other.y + other.h + margin)
            & (other.y < self.y + self.h + margin)
        )

    def overlap(self, other: Box) -> Column:
        """Area in common over the area of both."""
        w = F.greatest(F.lit(0.0), F.least(self.x + self.w, other.x + other.w) - F.greatest(self.x, other.x))
        h = F.greatest(F.lit(0.0), F.least(self.y + self.h, other.y + other.h) - F.greatest(self.y, other.y))
        both = self.w * self.h + other.w * other.h - w * h
        return F.when(both > 0, w * h / both).otherwise(F.lit(0.0))

    def distance(self, other: Box) -> Column:
        (ax, ay), (bx, by) = self.centre, other.centre
        return F.hypot(ax - bx, ay - by)

    def union(self, other: Box) -> tuple[Column, Column, Column, Column]:
        """The box around those of the two that exist, on whole pixels; zeros if neither does."""
        low = lambda a, b: F.least(F.when(self.exists, a), F.when(other.exists, b))
        high = lambda a, b: F.greatest(F.when(self.exists, a), F.when(other.exists, b))
        x0, y0 = low(self.x, other.x), low(self.y, other.y)
        x1, y1 = high(self.x + self.w, other.x + other.w), high(self.y + self.h, other.y + other.h)
        whole = lambda c: F.coalesce(c.cast("int"), F.lit(0))
        return whole(F.floor(x0)), whole(F.floor(y0)), whole(F.ceil(x1 - x0)), whole(F.ceil(y1 - y0))

    def expanded(self, by: float, width: Column, height: Column) -> tuple[Column, Column, Column, Column]:
        """Grown by ``by`` on each side and clipped to the picture."""
        x0, y0 = F.greatest(F.lit(0.0), self.x - by), F.greatest(F.lit(0.0), self.y - by)
        return x0, y0, F.least(width, self.x + self.w + by) - x0, F.least(height, self.y + self.h + by) - y0


def heading(dx: Column, dy: Column) -> Column:
    """Degrees from straight down, from -180 to 180."""
    return F.degrees(F.atan2(dx, dy))


def angle_between(a: Column, b: Column) -> Column:
    """Least difference of two headings in degrees, 0 to 180."""
    d = F.abs(a - b) % 360.0
    return F.when(d > 180, 360.0 - d).otherwise(d)


def path_length(points: Column) -> Column:
    """Length of the way along ``array<array<double>>``; 0 for fewer than two points."""
    step = lambda a, b: F.hypot(F.element_at(b, 1) - F.element_at(a, 1), F.element_at(b, 2) - F.element_at(a, 2))
    n = F.size(points)
    steps = F.zip_with(F.slice(points, 1, F.greatest(n - 1, F.lit(0))), F.slice(points, 2, F.greatest(n - 1, F.lit(0))), step)
    return F.when(n >= 2, F.aggregate(steps, F.lit(0.0), lambda s, x: s + x)).otherwise(F.lit(0.0))


def evenly(low: Column, high: Column, n: int) -> Column:
    """``n`` numbers from ``low`` to ``high`` at equal steps."""
    if n < 2:
        return F.array(low)
    return F.array(*(low + (high - low) * (i / (n - 1)) for i in range(n)))


def edge_weight(dx: int, dy: int) -> float:
    return math.sqrt(2.0) if dx and dy else 1.0
