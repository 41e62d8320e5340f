"""Value queries: AND/OR trees of predicates on variables, evaluated to points or to candidate blocks.

Leaves combine by position inside their selections. Where leaves share a grid and a selection, their whole subtree is
one filter on one scan; elsewhere only hits meet, in a semi-join (AND) or a distinct union (OR) on step and position.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.types import InvalidQuery, literal, operator_of, test
from ..sources.dataset import Grid, Variable, zone_aggregates
from .reading import choose, position, size_of
from .selection import Block, Box, Points, Selection, SubBlock, Whole


class Query:
    def __and__(self, other: Query) -> Node:
        return Node(self, "and", other)

    def __or__(self, other: Query) -> Node:
        return Node(self, "or", other)


@dataclass(frozen=True)
class Leaf(Query):
    """``variable op value`` over a selection; the value is text, read by the variable's type."""

    variable: Variable
    op: str
    value: str
    selection: Selection = Whole()

    def __post_init__(self):
        object.__setattr__(self, "op", operator_of(self.op))
        if self.value is None:
            raise InvalidQuery("a predicate needs a value")
        literal(self.value, self.variable.type)

    def __str__(self) -> str:
        return f"({self.variable.name} {self.op} {self.value})"

    def leaves(self) -> list[Leaf]:
        return [self]

    @property
    def condition(self) -> Column:
        return test(F.col(self.variable.column), self.op, literal(self.value, self.variable.type), self.variable.type)


@dataclass(frozen=True)
class Node(Query):
    left: Query
    op: str
    right: Query

    def __post_init__(self):
        sizes = {n for leaf in self.leaves() if (n := size_of(leaf.selection, leaf.variable.grid)) is not None}
        kinds = {Box if isinstance(leaf.selection, Whole) else type(leaf.selection) for leaf in self.leaves()}
        if len(sizes) > 1 or len(kinds) > 1:
            raise InvalidQuery("combined selections need one kind and one number of elements")

    def __str__(self) -> str:
        return f"({self.left} {self.op} {self.right})"

    def leaves(self) -> list[Leaf]:
        return self.left.leaves() + self.right.leaves()


def _one_source(q: Query) -> tuple[Grid, Selection] | None:
    """The grid and selection that all leaves share."""
    first, *rest = q.leaves()
    same = all(leaf.variable.grid is first.variable.grid and leaf.selection == first.selection for leaf in rest)
    return (first.variable.grid, first.selection) if same else None


def _condition(q: Query) -> Column:
    if isinstance(q, Leaf):
        return q.condition
    left, right = _condition(q.left), _condition(q.right)
    return left & right if q.op == "and" else left | right


def _positions(q: Query, first: int, count: int) -> DataFrame:
    """step, r0.. of the hits."""
    if source := _one_source(q):
        grid, selection = source
        cells = choose(grid, grid.cells.filter(F.col("step").between(first, first + count - 1)), selection)
        return cells.filter(_condition(q)).select("step", *position(selection, grid))
    left, right = _positions(q.left, first, count), _positions(q.right, first, count)
    if left.columns != right.columns:
        raise InvalidQuery("combined selections need the same number of dimensions")
    return left.join(right, left.columns, "left_semi") if q.op == "and" else left.unionByName(right).distinct()


def evaluate(q: Query, out: Box | None = None, first: int = 0, count: int = 1) -> DataFrame:
    """Hits as points: step and coordinates c0.. in the output box (if None, in the first leaf's selection)."""
    grid, selection = q.leaves()[0].variable.grid, q.leaves()[0].selection
    hits = _positions(q, first, count)
    base = out or (selection if isinstance(selection, Box) else None)
    names = [c for c in hits.columns if c != "step"]
    if out is not None and isinstance(selection, (Box, Whole)):
        shape = selection.count if isinstance(selection, Box) else grid.dims
        if tuple(out.count) != tuple(shape):
            raise InvalidQuery("the output box needs the shape of the selections")
    if base is None or len(names) != len(base.start):
        return hits.select("step", *(F.col(c).alias(f"c{k}") for k, c in enumerate(names)))
    return hits.select("step", *((F.col(c) + s).alias(f"c{k}") for k, (c, s) in enumerate(zip(names, base.start))))


def where(q: Query, *variables: Variable, out: Box | None = None, first: int = 0, count: int = 1) -> DataFrame:
    """step, coordinates and the values of ``variables`` at the hits. Variables on the query's own grid and box cost no
    join: they are columns of the filtered scan."""
    source = _one_source(q)
    if source and all(v.grid is source[0] for v in variables) and out in (None, source[1]):
        grid, selection = source
        cells = choose(grid, grid.cells.filter(F.col("step").between(first, first + count - 1)), selection)
        return cells.filter(_condition(q)).select("step", *grid.names, *(F.col(v.column).alias(v.name) for v in variables))
    hits = evaluate(q, out, first, count)
    for v in variables:
        keys = ["step", *v.grid.names]
        hits = hits.join(v.grid.cells.select(*keys, F.col(v.column).alias(v.name)), keys)
    return hits


# ---------------------------------------------------------------------------------------------------------------- blocks
def _keeps(leaf: Leaf) -> Column:
    """Whether a block's smallest and largest value (NaN left out) allow a hit, and its place the selection."""
    low, high = F.col(f"_min_{leaf.variable.column}"), F.col(f"_max_{leaf.variable.column}")
    if leaf.variable.type.kind == "real":
        low, high = low.cast("double"), high.cast("double")
    c = literal(leaf.value, leaf.variable.type)
    rule = {"<": low < c, "<=": low <= c, ">": high > c, ">=": high >= c, "=": (low <= c) & (high >= c), "!=": ~((low == c) & (high == c) & (F.col(f"_nan_{leaf.variable.column}") == 0))}[leaf.op]
    rule = F.coalesce(rule, F.lit(leaf.op == "!="))
    s, axes = leaf.selection, range(leaf.variable.grid.ndim)
    if isinstance(s, Box):
        return rule & s.overlap([F.col(f"s{k}") for k in axes], [F.col(f"n{k}") for k in axes])
    if isinstance(s, (Block, SubBlock)):
        return rule & (F.col("abs_block" if getattr(s, "absolute", False) else "block") == s.index)
    if not isinstance(s, Whole):
        raise InvalidQuery("blocks are chosen for boxes, blocks and whole variables")
    return rule


def zone_map(grid: Grid, variables: list[Variable]) -> DataFrame:
    """The layout of a grid with each variable's smallest and largest value and number of NaNs in every block: from the
    stored table of blocks, else from the cells."""
    types = {v.column: v.type for v in variables}
    for t in types.values():
        if t.kind not in ("int", "uint", "real"):
            raise InvalidQuery(f"{t.name} variables have no smallest value")
    stored = grid.zones(types)
    return stored.filter("size > 0") if stored is not None else grid.layout(*zone_aggregates(types))


def blocks(q: Query, first: int = 0, count: int | None = None) -> DataFrame:
    """Candidate blocks, a superset of those with hits: step, block, abs_block and size."""
    leaves, out = q.leaves(), None
    flags = {id(leaf): f"_leaf{i}" for i, leaf in enumerate(leaves)}
    for grid in {id(leaf.variable.grid): leaf.variable.grid for leaf in leaves}.values():
        own = [leaf for leaf in leaves if leaf.variable.grid is grid]
        zones = zone_map(grid, [leaf.variable for leaf in own])
        last = grid.nsteps if count is None else first + count
        zones = zones.filter(F.col("step").between(first, last - 1))
        zones = zones.select("step", "block", "abs_block", "size", *(_keeps(leaf).alias(flags[id(leaf)]) for leaf in own))
        out = zones if out is None else out.join(zones.drop("abs_block", "size"), ["step", "block"])

    def tree(node: Query) -> Column:
        if isinstance(node, Leaf):
            return F.col(flags[id(node)])
        return tree(node.left) & tree(node.right) if node.op == "and" else tree(node.left) | tree(node.right)

    return out.filter(tree(q)).select("step", "block", "abs_block", "size")


def estimate(q: Query, first: int = 0, count: int | None = None) -> DataFrame:
    """One row: candidate blocks and the cells in them, an upper bound on hits."""
    return blocks(q, first, count).agg(F.count(F.lit(1)).alias("blocks"), F.coalesce(F.sum("size"), F.lit(0)).alias("cells"))


def numbered(rows: DataFrame, groups: list[str], order: list[str]) -> DataFrame:
    """Rows with ``place``, their number from 0 in the order of the groups and then ``order``. Only one row a group is
    sorted as a whole; rows are numbered inside their groups."""
    sums = rows.groupBy(*groups).agg(F.count(F.lit(1)).alias("_n"))
    before = sums.withColumn("_before", F.sum("_n").over(Window.orderBy(*groups)) - F.col("_n")).drop("_n")
    inside = F.row_number().over(Window.partitionBy(*groups).orderBy(*order)) - 1
    return rows.withColumn("_at", inside).join(before, groups).withColumn("place", (F.col("_before") + F.col("_at")).cast("long")).drop("_at", "_before")


#: Cells along the first coordinates that are numbered together, about, where hits have no block.
STRIPE = 65_536


def _numbered_hits(q: Query, first: int, count: int) -> DataFrame:
    """Hits with their ``place``: by step, block and place in the block on one grid and selection, else by step and
    coordinates."""
    if source := _one_source(q):
        grid, selection = source
        cells = choose(grid, grid.cells.filter(F.col("step").between(first, first + count - 1)), selection)
        return numbered(cells.filter(_condition(q)).select("step", "block", "off", *grid.names), ["step", "block"], ["off"])
    hits = evaluate(q, None, first, count)
    names = [c for c in hits.columns if c != "step"]
    selection, grid = q.leaves()[0].selection, q.leaves()[0].variable.grid
    shape = selection.count if isinstance(selection, Box) else grid.dims if isinstance(selection, Whole) else (1,)
    rows = max(1, STRIPE // max(1, math.prod(shape[1:])))
    striped = hits.withColumn("_stripe", F.floor(F.col(names[0]) / rows))
    return numbered(striped, ["step", "_stripe"], names).drop("_stripe")


def _piece(rows: DataFrame, size: int, number: int) -> DataFrame:
    return rows.filter(F.col("place").between(size * number, size * (number + 1) - 1))


def batch(q: Query, size: int, number: int, first: int = 0, count: int = 1) -> DataFrame:
    """The ``number``-th batch (from 0) of ``size`` hits of any query, each with its ``place``."""
    return _piece(_numbered_hits(q, first, count), size, number)


def block_batch(q: Query, size: int, number: int, first: int = 0, count: int | None = None) -> DataFrame:
    """The ``number``-th batch of ``size`` candidate blocks, in order of step and block."""
    return _piece(numbered(blocks(q, first, count), ["step"], ["block"]), size, number)


def status(rows: DataFrame, size: int, number: int) -> DataFrame:
    """One row: how many results there are, how many of them batch ``number`` holds, how many follow, and whether it is the
    last. ``rows`` are hits or candidate blocks."""
    done = size * number
    total = F.count(F.lit(1))
    held = F.greatest(F.least(total - done, F.lit(size)), F.lit(0))
    left = F.greatest(total - done - size, F.lit(0))
    return rows.agg(total.alias("results"), held.cast("long").alias("held"), left.cast("long").alias("follow"), (left == 0).alias("last"))


def matching(q: Query, cells: DataFrame) -> DataFrame:
    """Of ``cells`` of the query's grid, from anywhere (a stream too), those that satisfy a query on one selection."""
    source = _one_source(q)
    if not source or isinstance(source[1], Points):
        raise InvalidQuery("cells by themselves are tested against one grid and one box, block or whole")
    return choose(source[0], cells, source[1]).filter(_condition(q))


def cells_of_blocks(found: DataFrame, v: Variable, box: Box | None = None) -> DataFrame:
    """The cells of candidate blocks (step, block), all or those in a box."""
    cells = v.cells if box is None else v.cells.filter(box.predicate(v.grid.ndim))
    return cells.join(found.select("step", "block"), ["step", "block"], "left_semi")
