"""Oriented-box, polyline and swept-shape tests as plain arithmetic on columns (no geometry library, no UDF).

A box is a set of six columns: centre, cosine and sine of the heading, half length and half width. Cosines are taken
once per pose, before any join, so pair tests are multiplications and comparisons inside one codegen stage.
"""

from __future__ import annotations

from dataclasses import dataclass
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feaslens.functions.columns import cos, sin

EPS = 1e-9


@dataclass(frozen=True)
class Box:
    x: Column
    y: Column
    c: Column
    s: Column
    hl: Column
    hw: Column


BOX_FIELDS = ("bx", "by", "bc", "bs", "bl", "bw")


def with_box(df: DataFrame, prefix: str = "", x="x", y="y", heading="heading", length="length", width="width", grow: float = 0.0) -> DataFrame:
    """Adds the six box columns; ``grow`` is added on every side."""
    h = F.col(heading)
    values = (F.col(x), F.col(y), cos(h), sin(h), F.col(length) * 0.5 + grow, F.col(width) * 0.5 + grow)
    return df.withColumns({f"{prefix}{f}": v for f, v in zip(BOX_FIELDS, values)})


def box(prefix: str = "", alias: str | None = None) -> Box:
    name = lambda f: F.col(f"{alias}.{prefix}{f}" if alias else f"{prefix}{f}")
    return Box(*[name(f) for f in BOX_FIELDS])


def obb_overlap(a: Box, b: Box, slack: float = EPS) -> Column:
    """Separating-axis test over the four box axes; touching counts."""
    dx, dy = b.x - a.x, b.y - a.y
    cosd, sind = F.abs(a.c * b.c + a.s * b.s), F.abs(a.c * b.s - a.s * b.c)
    return (
        (F.abs(dx * a.c + dy * a.s) <= a.hl + b.hl * cosd + b.hw * sind + slack)
        & (F.abs(dy * a.c - dx * a.s) <= a.hw + b.hl * sind + b.hw * cosd + slack)
        & (F.abs(dx * b.c + dy * b.s) <= b.hl + a.hl * cosd + a.hw * sind + slack)
        & (F.abs(dy * b.c - dx * b.s) <= b.hw + a.hl * sind + a.hw * cosd + slack)
    )


def _corners(b: Box) -> list[tuple[Column, Column]]:
    return [(b.x + i * b.hl * b.c - j * b.hw * b.s, b.y + i * b.hl * b.s + j * b.hw * b.c)
            for i, j in ((1.0, 1.0), (1.0, -1.0), (-1.0, -1.0), (-1.0, 1.0))]


def _point_box_d2(px: Column, py: Column, b: Box) -> Column:
    dx, dy = px - b.x, py - b.y
    u = F.greatest(F.abs(dx * b.c + dy * b.s) - b.hl, F.lit(0.0))
    v = F.greatest(F.abs(dy * b.c - dx * b.s) - b.hw, F.lit(0.0))
    return u * u + v * v


def obb_distance(a: Box, b: Box) -> Column:
    """Gap between two boxes, 0 when they meet. Of two disjoint boxes a corner is always one end of the shortest gap."""
    parts = [_point_box_d2(x, y, a) for x, y in _corners(b)] + [_point_box_d2(x, y, b) for x, y in _corners(a)]
    return F.when(obb_overlap(a, b, 0.0), F.lit(0.0)).otherwise(F.sqrt(F.least(*parts)))


def radius(b: Box) -> Column:
    return F.sqrt(b.hl * b.hl + b.hw * b.hw)


def lane_segments(lanes: DataFrame, keys=("sample_id",), lane="lane_ix", seq="seq") -> DataFrame:
    """Consecutive vertex pairs of every polyline; ``inner`` marks segments whose end joins another segment.

    A polyline is short (vertices of one lane), so a window per lane is bounded.
    """
    from pyspark.sql import Window
    w = Window.partitionBy(*keys, lane).orderBy(seq)
    pairs = lanes.select(*keys, lane, seq, F.col("x").alias("x1"), F.col("y").alias("y1"), F.lead("x").over(w).alias("x2"),
                         F.lead("y").over(w).alias("y2"), F.lead(seq, 2).over(w).isNotNull().alias("inner"))
    return pairs.filter("x2 is not null")


def near_segment(px: Column, py: Column, buffer: Column | float, x1="x1", y1="y1", x2="x2", y2="y2", inner="inner") -> Column:
    """Within the segment's rectangle (flat ends), or within the round join at its inner end vertex."""
    x1, y1, x2, y2 = F.col(x1), F.col(y1), F.col(x2), F.col(y2)
    ex, ey = x2 - x1, y2 - y1
    len2 = ex * ex + ey * ey
    along = (px - x1) * ex + (py - y1) * ey
    across = (px - x1) * ey - (py - y1) * ex
    b2 = buffer * buffer
    flat = (len2 > 0) & (along >= 0) & (along <= len2) & (across * across <= b2 * len2)
    joint = F.col(inner) & ((px - x2) * (px - x2) + (py - y2) * (py - y2) <= b2)
    return flat | joint


def swept_contains(qx: Column, qy: Column, mx: Column, my: Column, hl: Column, hw: Column) -> Column:
    """Is the point (in the box frame at the start) inside the box swept along (mx, my)?

    The box covers the point during an interval of the sweep per axis; the point is inside when the intervals and [0, 1] meet.
    """
    def span(q: Column, m: Column, h: Column) -> tuple[Column, Column]:
        still = F.abs(m) < 1e-12
        safe = F.when(still, F.lit(1.0)).otherwise(m)
        a, b = (q - h) / safe, (q + h) / safe
        lo, hi = F.least(a, b), F.greatest(a, b)
        inside = F.abs(q) <= h
        return (F.when(still, F.when(inside, F.lit(-1.0)).otherwise(F.lit(2.0))).otherwise(lo),
                F.when(still, F.when(inside, F.lit(2.0)).otherwise(F.lit(-1.0))).otherwise(hi))
    lo_x, hi_x = span(qx, mx, hl)
    lo_y, hi_y = span(qy, my, hw)
    return F.greatest(lo_x, lo_y, F.lit(0.0)) <= F.least(hi_x, hi_y, F.lit(1.0))


@dataclass(frozen=True)
class Grid:
    """Cell raster by cell centres; the cell id is row-major."""

    x_min: float = -20.0
    x_max: float = 60.0
    y_min: float = -30.0
    y_max: float = 30.0
    resolution: float = 0.5

    @property
    def nx(self) -> int:
        return int(round((self.x_max - self.x_min) / self.resolution))

    @property
    def ny(self) -> int:
        return int(round((self.y_max - self.y_min) / self.resolution))

    def center_x(self, ix: Column) -> Column:
        return self._center(self.x_min, ix)

    def center_y(self, iy: Column) -> Column:
        return self._center(self.y_min, iy)

    def _center(self, low: float, i: Column) -> Column:
        """The double nearest to the centre that the written decimals give, as SQL has it; sums of doubles may be off by the last bit, which decides on edges."""
        step = Decimal(str(self.resolution))
        first = Decimal(str(low)) + step / 2
        digits = max(0, -first.as_tuple().exponent, -step.as_tuple().exponent)
        if digits > 9:
            return F.lit(low) + (i + 0.5) * self.resolution
        return (F.lit(int(first.scaleb(digits))) + i.cast("bigint") * int(step.scaleb(digits))).cast("double") / float(10**digits)

    @property
    def cell_area(self) -> float:
        return self.resolution * self.resolution


def cells_for_bbox(df: DataFrame, grid: Grid, x0: Column, x1: Column, y0: Column, y1: Column) -> DataFrame:
    """One row per cell whose centre lies in the box [x0, x1] × [y0, y1]: columns ``cell_id``, ``cx``, ``cy``."""
    res = grid.resolution
    first = lambda v, low: F.greatest(F.ceil((v - low) / res - 0.5 - EPS), F.lit(0)).cast("int")
    last = lambda v, low, n: F.least(F.floor((v - low) / res - 0.5 + EPS), F.lit(n - 1)).cast("int")
    ranged = df.withColumns({"_ix0": first(x0, grid.x_min), "_ix1": last(x1, grid.x_min, grid.nx),
                             "_iy0": first(y0, grid.y_min), "_iy1": last(y1, grid.y_min, grid.ny)})
    ranged = ranged.filter((F.col("_ix0") <= F.col("_ix1")) & (F.col("_iy0") <= F.col("_iy1")))
    rows = ranged.withColumn("_ix", F.explode(F.sequence("_ix0", "_ix1"))).withColumn("_iy", F.explode(F.sequence("_iy0", "_iy1")))
    return rows.withColumns({"cell_id": (F.col("_iy") * grid.nx + F.col("_ix")).cast("bigint"), "cx": grid.center_x(F.col("_ix")),
                             "cy": grid.center_y(F.col("_iy"))}).drop("_ix0", "_ix1", "_iy0", "_iy1", "_ix", "_iy")


def rasterize_boxes(df: DataFrame, grid: Grid, prefix: str = "") -> DataFrame:
    """Cells whose centre lies in the (rotated) box of each row."""
    b = box(prefix)
    ex, ey = F.abs(b.c) * b.hl + F.abs(b.s) * b.hw, F.abs(b.s) * b.hl + F.abs(b.c) * b.hw
    cells = cells_for_bbox(df, grid, b.x - ex, b.x + ex, b.y - ey, b.y + ey)
    dx, dy = F.col("cx") - b.x, F.col("cy") - b.y
    return cells.filter((F.abs(b.c * dx + b.s * dy) <= b.hl) & (F.abs(b.c * dy - b.s * dx) <= b.hw))
