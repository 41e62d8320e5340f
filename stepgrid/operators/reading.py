"""Reads: the cells of a variable under a selection, over some of its steps, lazily.

A read is a filter on the grid's scan; only point lists join, and those after a filter on the box that spans them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.types import InvalidQuery, OutOfBounds
from dataclasses import replace

from ..sources.dataset import Grid, Variable, check_steps
from .selection import Block, Box, Points, Selection, SubBlock, Whole, intersect, linear, to_nd

#: Points of a list that is broadcast; longer lists shuffle.
FEW_POINTS = 100_000


def chunk(v: Variable, selection: Selection, size: int, number: int, first: int = 0, count: int | None = None) -> DataFrame:
    """The ``number``-th batch (from 0) of ``size`` cells of a read, in order of step, block and place."""
    from .query import numbered

    rows = numbered(read(v, selection, first, count), ["step", "block"], ["off"])
    return rows.filter(F.col("place").between(size * number, size * (number + 1) - 1))


def of_steps(v: Variable, first: int = 0, count: int | None = None) -> DataFrame:
    """Cells of ``count`` of the variable's steps from ``first`` (all that follow, if None)."""
    count = v.grid.nsteps - first if count is None else count
    check_steps(v, first, count)
    return v.cells.filter(F.col("step").between(first, first + count - 1))


def read(v: Variable, selection: Selection | None = None, first: int = 0, count: int | None = None) -> DataFrame:
    """step, block, off, coordinates and value of the selected cells; point reads have their ``pid`` too."""
    return choose(v.grid, of_steps(v, first, count), selection or Whole())


def choose(grid: Grid, cells: DataFrame, selection: Selection) -> DataFrame:
    """The selected rows of a grid's cells. A box in a local array reads the first block of each step."""
    if isinstance(selection, Points):
        return _points(grid, cells, selection)
    if isinstance(selection, Box):
        if grid.is_global:
            selection.within(grid.dims)
        else:
            cells = cells.filter(F.col("block") == 0)
    if isinstance(selection, (Block, SubBlock)) and selection.absolute:
        return with_absolute(grid, cells).filter(selection.predicate(grid.ndim)).drop("abs_block")
    return cells.filter(selection.predicate(grid.ndim))


def with_absolute(grid: Grid, cells: DataFrame) -> DataFrame:
    """Cells with the number of their block over all steps, from the table of blocks (counted first if there is none)."""
    return cells.join(grid.numbers().select("step", "block", "abs_block"), ["step", "block"])


def shared(grid: Grid, a: Selection, b: Selection) -> Selection | None:
    """What two selections share, as ``intersect`` says; a block by its number in the step shares with one by its number
    over all steps the latter, if that is its number in its step. One row of the table of blocks comes to the driver."""
    kinds = (Block, SubBlock)
    if not (isinstance(a, kinds) and isinstance(b, kinds)) or a.absolute == b.absolute:
        return intersect(a, b)
    fixed, own = (a, b) if a.absolute else (b, a)
    row = grid.numbers().filter(F.col("abs_block") == fixed.index).first()
    if row is None or row["block"] != own.index:
        return None
    return intersect(fixed, replace(own, index=fixed.index, absolute=True))


def _points(grid: Grid, cells: DataFrame, points: Points) -> DataFrame:
    spark = cells.sparkSession
    wanted = points.frame(spark, grid.ndim)
    held = points.container
    if isinstance(held, Block):
        cells = choose(grid, cells, held)
        if points.ndim == 1 and grid.ndim > 1:
            return cells.join(_sized(wanted, points.size), "off")
        if "off" in wanted.columns:
            wanted = wanted.withColumnRenamed("off", "c0")
        starts = grid.cells.filter(F.col("block") == held.index).groupBy("step").agg(*(F.min(c).alias(f"_{c}") for c in grid.names))
        # Every step of the block has its own start: as many rows as points and steps have together.
        steps_ = starts.agg(F.collect_list(F.struct("step", *(f"_{c}" for c in grid.names))).alias("_starts"))
        shifted = wanted.join(F.broadcast(steps_), F.lit(True)).withColumn("_s", F.explode("_starts"))
        shifted = shifted.select("pid", "_s.step", *((F.col(c) + F.col(f"_s._{c}")).alias(c) for c in grid.names))
        return cells.join(_sized(shifted, points.size * grid.nsteps), ["step", *grid.names])
    if isinstance(held, Box):
        held.within(grid.dims)
    elif span := points.span():
        if points.ndim != grid.ndim:
            raise InvalidQuery("offsets need a container")
        span.within(grid.dims)
        cells = cells.filter(span.predicate(grid.ndim))
    return cells.join(_sized(wanted, points.size), grid.names)


def _sized(frame: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(frame) if rows <= FEW_POINTS else frame


def box_cells(spark, box: Box) -> DataFrame:
    """Every coordinate of a box, row by row of ``at`` (its row-major offset)."""
    grid = spark.range(box.size).select(F.col("id").alias("at"), F.col("id").alias("off"))
    return to_nd(grid, box, relative=False)


def fill(hits: DataFrame, box: Box, default, value: str = "value") -> DataFrame:
    """A dense box: the value where there is a hit, else ``default``; the coordinates and ``at``."""
    names = [f"c{k}" for k in range(len(box.start))]
    kind = dict(hits.dtypes)[value]
    dense = box_cells(hits.sparkSession, box).join(hits.filter(box.predicate(len(names))).select(*names, value), names, "left")
    return dense.select("at", *names, F.coalesce(value, F.lit(default).cast(kind)).alias(value))


def overlaps(grid: Grid, box: Box, first: int = 0, count: int | None = None) -> DataFrame:
    """Blocks of some steps that share cells with a box, and the shared part: step, block, abs_block, s0.., n0.."""
    count = grid.nsteps - first if count is None else count
    if len(box.start) != grid.ndim:
        raise OutOfBounds(f"{box} has not {grid.ndim} dimensions")
    axes = range(grid.ndim)
    found = grid.layout().filter(F.col("step").between(first, first + count - 1) & box.overlap([F.col(f"s{k}") for k in axes], [F.col(f"n{k}") for k in axes]))
    out = [F.col("step"), F.col("block"), F.col("abs_block")]
    for k, (s, n) in enumerate(zip(box.start, box.count)):
        low = F.greatest(F.col(f"s{k}"), F.lit(s))
        out += [low.alias(f"s{k}"), (F.least(F.col(f"s{k}") + F.col(f"n{k}"), F.lit(s + n)) - low).alias(f"n{k}")]
    return found.select(out)


def as_text(cells: DataFrame, ndim: int) -> DataFrame:
    """8-bit cells as text: step, the coordinates but the last, and the characters along the last axis, up to the first
    zero. A row of text is one group, as long as the last axis is."""
    keys = ["step", *(f"c{k}" for k in range(ndim - 1))]
    row = F.array_sort(F.collect_list(F.struct(f"c{ndim - 1}", (F.col("value").cast("int").bitwiseAND(F.lit(255))).alias("code"))))
    codes = F.transform("_row", lambda x: F.call_function("char", x["code"]))
    ends = F.array_position(F.transform("_row", lambda x: x["code"]), 0)
    return cells.groupBy(*keys).agg(row.alias("_row")).select(*keys, F.array_join(F.when(ends > 0, F.slice(codes, F.lit(1), (ends - 1).cast("int"))).otherwise(codes), "").alias("text"))


def position(selection: Selection, grid: Grid) -> list:
    """What aligns the cells of equally shaped selections: relative coordinates, place in a list, or place in a block."""
    if isinstance(selection, Box):
        return selection.relative()
    if isinstance(selection, Points):
        return [F.col("pid").alias("r0")]
    if isinstance(selection, Block):
        return [F.col("off").alias("r0")]
    if isinstance(selection, SubBlock):
        return [(F.col("off") - selection.start).alias("r0")]
    return [F.col(c).alias(f"r{k}") for k, c in enumerate(grid.names)]


def size_of(selection: Selection, grid: Grid) -> int | None:
    """Elements of a selection, where its description alone tells."""
    if isinstance(selection, (Box, Points)):
        return selection.size
    if isinstance(selection, SubBlock):
        return selection.count
    return linear_size(grid) if isinstance(selection, Whole) else None


def linear_size(grid: Grid) -> int:
    out = 1
    for d in grid.dims:
        out *= d
    return out


def span_offsets(grid: Grid, cells: DataFrame) -> DataFrame:
    """Cells with ``at``, their row-major offset in the whole array."""
    return cells.withColumn("at", linear([F.col(c) for c in grid.names], grid.dims))
