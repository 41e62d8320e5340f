"""Selections of cells: boxes, points, blocks, parts of blocks, everything; their intersections and conversions.

A selection is a Column predicate over a grid's ``block``, ``off`` and coordinates, or, for point lists, a DataFrame to
join with. Hits are re-based on a selection by its relative coordinates.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.types import InvalidQuery, OutOfBounds


def coordinates(ndim: int) -> list[str]:
    return [f"c{k}" for k in range(ndim)]


@dataclass(frozen=True)
class Whole:
    """Every cell."""

    def predicate(self, ndim: int) -> Column:
        return F.lit(True)


@dataclass(frozen=True)
class Auto(Whole):
    """What a staging method would choose: here every block."""

    hints: str = ""


@dataclass(frozen=True)
class Box:
    """``start`` and ``count`` in each dimension."""

    start: tuple[int, ...]
    count: tuple[int, ...]

    def __post_init__(self):
        object.__setattr__(self, "start", tuple(self.start))
        object.__setattr__(self, "count", tuple(self.count))
        if len(self.start) != len(self.count) or any(n < 0 for n in self.count):
            raise InvalidQuery("a box needs a start and a count in each dimension")

    @property
    def size(self) -> int:
        return math.prod(self.count)

    def within(self, dims: Sequence[int]) -> None:
        if len(dims) != len(self.start) or any(s < 0 or s + n > d for s, n, d in zip(self.start, self.count, dims)):
            raise OutOfBounds(f"{self} leaves the array of dimensions {tuple(dims)}")

    def predicate(self, ndim: int) -> Column:
        if ndim != len(self.start):
            raise OutOfBounds(f"{self} has not {ndim} dimensions")
        out = F.lit(True)
        for c, s, n in zip(coordinates(ndim), self.start, self.count):
            out &= (F.col(c) >= s) & (F.col(c) < s + n)
        return out

    def relative(self) -> list[Column]:
        return [(F.col(c) - s).alias(f"r{k}") for k, (c, s) in enumerate(zip(coordinates(len(self.start)), self.start))]

    def offset(self, names: Sequence[str | Column] | None = None) -> Column:
        """Row-major offset of a cell inside the box."""
        names = names or coordinates(len(self.start))
        return linear([F.col(c) - s if isinstance(c, str) else c - s for c, s in zip(names, self.start)], self.count)

    def overlap(self, starts: Sequence[Column], counts: Sequence[Column]) -> Column:
        """Whether blocks of these starts and counts share a cell with the box."""
        out = F.lit(self.size > 0)
        for s, n, bs, bn in zip(self.start, self.count, starts, counts):
            out &= (F.greatest(bs, F.lit(s)) < F.least(bs + bn, F.lit(s + n)))
        return out


@dataclass(frozen=True)
class Block:
    """A write block by its number in the step (or over all steps, if ``absolute``)."""

    index: int
    absolute: bool = False

    def predicate(self, ndim: int) -> Column:
        return F.col("abs_block" if self.absolute else "block") == self.index


@dataclass(frozen=True)
class SubBlock:
    """``count`` elements of a block from row-major element ``start``."""

    index: int
    start: int
    count: int
    absolute: bool = False

    def predicate(self, ndim: int) -> Column:
        return (F.col("abs_block" if self.absolute else "block") == self.index) & (F.col("off") >= self.start) & (F.col("off") < self.start + self.count)


@dataclass(frozen=True)
class Points:
    """Points of ``ndim`` coordinates each, in order, duplicates kept; relative to ``container`` if there is one. With one
    dimension and a container of more, points are row-major offsets in it."""

    ndim: int
    points: tuple[tuple[int, ...], ...]
    container: Box | Block | None = None

    def __post_init__(self):
        rows = tuple((p,) if isinstance(p, int) else tuple(p) for p in self.points)
        if any(len(p) != self.ndim for p in rows):
            raise InvalidQuery("every point needs all coordinates")
        object.__setattr__(self, "points", rows)

    @property
    def size(self) -> int:
        return len(self.points)

    def frame(self, spark: SparkSession, ndim: int) -> DataFrame:
        """(pid, coordinates); offsets in a block stay one column ``off``."""
        names = ["off"] if isinstance(self.container, Block) and self.ndim == 1 else coordinates(self.ndim)
        df = spark.createDataFrame([(i, *p) for i, p in enumerate(self.points)], "pid long, " + ", ".join(f"{c} long" for c in names))
        if isinstance(self.container, Box):
            if self.ndim == 1 and ndim > 1:
                return to_nd(df.withColumnRenamed("c0", "off"), self.container, relative=False)
            df = df.withColumns({c: F.col(c) + s for c, s in zip(names, self.container.start)})
        return df

    def span(self) -> Box | None:
        """The smallest box around the points, to prune blocks before the join."""
        if not self.points or self.container is not None:
            return None
        low = [min(p[k] for p in self.points) for k in range(self.ndim)]
        return Box(low, [max(p[k] for p in self.points) - a + 1 for k, a in enumerate(low)])


Selection = Whole | Box | Points | Block | SubBlock


def linear(parts: Sequence[Column], count: Sequence[int]) -> Column:
    """Row-major offset from relative coordinates."""
    out = F.lit(0).cast("long")
    for p, n in zip(parts, count):
        out = out * n + p
    return out


def to_nd(points: DataFrame, container: Box, relative: bool = True) -> DataFrame:
    """Offsets ``off`` in a container to coordinates c0.. in it, or in the array if not ``relative``."""
    left, out = F.col("off"), {}
    for k in range(len(container.count) - 1, -1, -1):
        n = container.count[k]
        part = F.pmod(left, F.lit(n)) if k else left
        out[f"c{k}"] = part if relative else part + container.start[k]
        left = F.floor(left / n)
    return points.withColumns({c: out[c].cast("long") for c in sorted(out)}).drop("off")


def intersect_segments(a: int, n: int, b: int, m: int) -> tuple[int, int] | None:
    """Shared part of [a, a+n) and [b, b+m)."""
    low, high = max(a, b), min(a + n, b + m)
    return (low, high - low) if low < high else None


def intersect(a: Selection, b: Selection) -> Selection | None:
    """What two selections share; None if nothing. Boxes and points meet in either order; blocks meet blocks of the same
    numbering (``reading.shared`` also reconciles a number in the step with one over all steps)."""
    if isinstance(a, Whole):
        return b
    if isinstance(b, Whole):
        return a
    if isinstance(a, Box) and isinstance(b, Box):
        parts = [intersect_segments(*x) for x in zip(a.start, a.count, b.start, b.count)]
        return Box([p[0] for p in parts], [p[1] for p in parts]) if all(parts) else None
    if isinstance(a, Points) and isinstance(b, Box):
        inside = tuple(p for p in a.points if all(s <= c < s + n for c, s, n in zip(p, b.start, b.count)))
        return Points(a.ndim, inside) if inside else None
    if isinstance(a, Box) and isinstance(b, Points):
        return intersect(b, a)
    if isinstance(a, Points) and isinstance(b, Points):
        # Duplicates multiply, as an inner join's would.
        number: dict[tuple[int, ...], int] = {}
        for p in b.points:
            number[p] = number.get(p, 0) + 1
        both = tuple(p for p in a.points for _ in range(number.get(p, 0)))
        return Points(a.ndim, both) if both else None
    if isinstance(a, (Block, SubBlock)) and isinstance(b, (Block, SubBlock)):
        if a.absolute != b.absolute:
            raise InvalidQuery("a block's number in its step and one over all steps need the table of blocks")
        if a.index != b.index:
            return None
        if isinstance(a, SubBlock) and isinstance(b, SubBlock):
            part = intersect_segments(a.start, a.count, b.start, b.count)
            return SubBlock(a.index, *part, a.absolute) if part else None
        return a if isinstance(a, SubBlock) else b
    raise InvalidQuery("a box or points and a block have no common coordinates")
