"""Datasets: variables over grids of cells, with steps, write blocks and attributes, as DataFrames.

A grid is one DataFrame of cells: ``step``, ``block`` (number in the step), ``off`` (row-major place in the block), the
coordinates ``c0..`` and one column for each variable on it. Variables on one grid share a scan. On disk a dataset is a
folder of Parquet tables partitioned by step, and beside each grid a table of its blocks: start, count and statistics of
every block that was declared or has cells. Layouts, absolute block numbers, candidate blocks and statistics of a stored
dataset come from that table; the cells are not read for them.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.types import InvalidName, InvalidQuery, InvalidStep, ValueType, of_spark, value_type
from ..operators.selection import coordinates
from ..operators.stats import BLOCK_STATS, finite


@dataclass(frozen=True)
class Grid:
    """``dims`` of the shared index space; ``nsteps`` steps; local grids have coordinates of their block only.
    ``declared`` has a row for each block, with and without cells: step, block, s0.., n0.., size, and statistics of
    variables if it was stored."""

    cells: DataFrame
    dims: tuple[int, ...]
    nsteps: int = 1
    is_global: bool = True
    declared: DataFrame | None = None

    @property
    def ndim(self) -> int:
        return len(self.dims)

    @property
    def names(self) -> list[str]:
        return coordinates(self.ndim)

    def layout(self, *more: Column) -> DataFrame:
        """Start and count of every block: step, block, abs_block, s0.., n0.., size, and ``more`` aggregates of its
        cells. The absolute number counts the blocks of earlier steps. Without ``more``, declared blocks are not looked
        up in the cells."""
        if self.declared is not None and not more:
            return absolute(self.declared.select("step", "block", *(f"{x}{k}" for k in range(self.ndim) for x in "sn"), "size"))
        aggs = [x for k, c in enumerate(self.names) for x in (F.min(c).alias(f"s{k}"), (F.max(c) - F.min(c) + 1).alias(f"n{k}"))]
        blocks = self.cells.groupBy("step", "block").agg(*aggs, F.count(F.lit(1)).alias("size"), *more)
        return absolute(blocks)

    def numbers(self) -> DataFrame:
        """step, block and abs_block of every block."""
        return absolute((self.cells if self.declared is None else self.declared).select("step", "block").distinct())

    def zones(self, columns: Iterable[str]) -> DataFrame | None:
        """The declared blocks with their stored statistics of these columns; None where there are none."""
        if self.declared is None or any(f"_min_{c}" not in self.declared.columns for c in columns):
            return None
        return absolute(self.declared)


def declare(spark: SparkSession, blocks: Iterable[tuple[int, int, Sequence[int], Sequence[int]]], ndim: int) -> DataFrame:
    """A table of blocks from (step, block, start, count); a count of 0 in any dimension is a block without cells."""
    rows = []
    for step, block, start, count in blocks:
        size = 1
        for n in count:
            size *= n
        rows.append((step, block, *(x for p in zip(start, count) for x in p), size))
    return spark.createDataFrame(rows, "step int, block int, " + "".join(f"s{k} long, n{k} long, " for k in range(ndim)) + "size long")


def zone_aggregates(columns: Mapping[str, ValueType]) -> list[Column]:
    """Smallest and largest value (NaN left out) and number of NaNs of each column, and count, extremes and sums of its
    finite values."""
    out = []
    for name, t in columns.items():
        c = F.col(name)
        nan = F.isnan(c) if t.kind == "real" else F.lit(False)
        kept, real = F.when(finite(c), c), F.when(finite(c), c.cast("double"))
        out += [F.min(F.when(~nan, c)).alias(f"_min_{name}"), F.max(F.when(~nan, c)).alias(f"_max_{name}"), F.count_if(nan).alias(f"_nan_{name}")]
        out += [f(x).alias(f"_{n}_{name}") for n, f, x in zip(BLOCK_STATS, (F.count, F.min, F.max, F.sum, F.sum), (kept, kept, kept, real, real * real))]
    return out


def absolute(blocks: DataFrame) -> DataFrame:
    """Blocks with ``abs_block``: the number of blocks of earlier steps plus the number in the step. A step has one more
    block than its largest number says, so blocks without a row in between are counted."""
    per = blocks.groupBy("step").agg((F.max("block") + 1).alias("_n"))
    before = per.select("step", (F.sum("_n").over(Window.orderBy("step")) - F.col("_n")).alias("_before"))
    return blocks.join(before, "step").withColumn("abs_block", (F.col("_before") + F.col("block")).cast("int")).drop("_before")


@dataclass(frozen=True)
class Variable:
    name: str
    grid: Grid
    column: str
    type: ValueType
    group: str = ""
    transform: str = "none"
    attributes: tuple[str, ...] = ()

    @property
    def cells(self) -> DataFrame:
        """step, block, off, coordinates and ``value``."""
        g = self.grid
        return g.cells.select("step", "block", "off", *g.names, F.col(self.column).alias("value"))

    def describe(self) -> dict:
        g = self.grid
        return {"name": self.name, "type": self.type.name, "ndim": g.ndim, "dims": list(g.dims), "nsteps": g.nsteps, "global": g.is_global, "group": self.group, "transform": self.transform}


@dataclass(frozen=True)
class Attribute:
    name: str
    type: str
    values: tuple

    @property
    def nelems(self) -> int:
        return len(self.values)


@dataclass
class Dataset:
    spark: SparkSession
    variables: dict[str, Variable] = field(default_factory=dict)
    attributes: dict[str, Attribute] = field(default_factory=dict)

    # ---- definition
    def define(self, name: str, cells: DataFrame, dims: Sequence[int], column: str = "value", kind: str | None = None, nsteps: int = 1, is_global: bool = True, group: str = "", transform: str = "none", grid: Grid | None = None) -> Variable:
        """Add a variable over its own cells or an existing grid."""
        grid = grid or Grid(cells, tuple(dims), nsteps, is_global)
        t = value_type(kind) if kind else of_spark(dict(grid.cells.dtypes)[column])
        self.variables[name] = Variable(name, grid, column, t, group, transform)
        return self.variables[name]

    def attribute(self, name: str, values, kind: str | None = None) -> Attribute:
        """Add an attribute; a Variable as value binds it to that variable's name."""
        if isinstance(values, Variable):
            values, kind = values.name, "string"
        many = tuple(values) if isinstance(values, (list, tuple)) else (values,)
        guess = {int: "long", float: "double", str: "string"}.get(type(many[0]) if many else str, "string")
        if kind is None and isinstance(values, (list, tuple)) and guess == "string":
            guess = "string array"
        self.attributes[name] = Attribute(name, kind or guess, many)
        return self.attributes[name]

    def drop(self, name: str) -> None:
        self.variables.pop(name, None)
        self.attributes.pop(name, None)

    # ---- inquiry
    def variable(self, name: str) -> Variable:
        """By exact name, else with or without a leading ``/``."""
        for n in (name, f"/{name}", name.removeprefix("/")):
            if n in self.variables:
                return self.variables[n]
        raise InvalidName(f"no variable {name!r}")

    def __getitem__(self, name: str) -> Variable | Attribute | Dataset:
        """A variable, an attribute, or what lies under a prefix."""
        for known in (self.variables, self.attributes):
            for n in (name, f"/{name}", name.removeprefix("/")):
                if n in known:
                    return known[n]
        lead = name.strip("/") + "/"
        inside = {k: v for k, v in self.variables.items() if k.strip("/").startswith(lead)}
        if not inside:
            raise InvalidName(f"nothing is called {name!r}")
        return replace(self, variables=inside)

    def groups(self) -> list[str]:
        return sorted({v.group for v in self.variables.values()})

    def view(self, group: str | None) -> Dataset:
        """Only one group's names; None shows all."""
        if group is not None and group not in self.groups():
            raise InvalidName(f"no group {group!r}")
        return self if group is None else replace(self, variables={k: v for k, v in self.variables.items() if v.group == group})

    def attributes_of(self, name: str) -> list[Attribute]:
        """Attributes one level below a variable's name."""
        lead = f"{self.variable(name).name}/"
        return [a for n, a in self.attributes.items() if n.startswith(lead) and "/" not in n[len(lead) :]]

    def catalog(self) -> DataFrame:
        """One row for each variable."""
        rows = [(v.group, i, v.name, v.type.name, v.grid.ndim, list(v.grid.dims), v.grid.is_global, v.grid.nsteps, v.transform) for i, v in enumerate(self.variables.values())]
        return self.spark.createDataFrame(rows, "group string, varid int, name string, type string, ndim int, dims array<bigint>, is_global boolean, nsteps int, transform string")

    def attribute_table(self) -> DataFrame:
        rows = [(a.name, a.type, a.nelems, [str(v) for v in a.values]) for a in self.attributes.values()]
        return self.spark.createDataFrame(rows, "name string, type string, nelems int, values array<string>")

    def listing(self, mask: str | None = None, regex: bool = False) -> DataFrame:
        """Type, name and dimensions of the variables that a mask selects (of all without one), steps first."""
        from ..functions.masks import matches

        shape = F.when(F.size("dims") == 0, F.when(F.col("nsteps") > 1, F.concat(F.col("nsteps").cast("string"), F.lit("*scalar"))).otherwise("scalar"))
        dims = F.concat(F.when(F.col("nsteps") > 1, F.concat(F.col("nsteps").cast("string"), F.lit("*"))).otherwise(""), F.lit("{"), F.array_join(F.col("dims").cast("array<string>"), ", "), F.lit("}"))
        chosen = F.lit(True) if mask is None else matches(F.col("name"), mask, regex)
        return self.catalog().filter(chosen).select("type", "name", F.coalesce(shape, dims).alias("shape"))

    # ---- storage
    def save(self, path: str, mode: str = "overwrite", step_offset: int = 0) -> None:
        """Write every grid (cells by step, sorted by block and place), its table of blocks, and the metadata.

        ``append`` adds this dataset's steps behind those that are stored (or at ``step_offset``, which may not be
        before them); ``update`` writes the last stored step anew, from a dataset of one step. Both need variables of the
        stored names, types and dimensions, and leave the stored steps before as they are."""
        if mode in ("append", "update"):
            stored = Dataset.open(self.spark, path)
            first = self._continues(stored, mode, step_offset)
            step_offset, mode = first, "append" if mode == "append" else "update"
        grids: dict[int, list[Variable]] = {}
        for v in self.variables.values():
            grids.setdefault(id(v.grid), []).append(v)
        known = []
        for k, vs in enumerate(grids.values()):
            g = vs[0].grid
            cells = g.cells.select((F.col("step") + step_offset).cast("int").alias("step"), "block", "off", *g.names, *dict.fromkeys(v.column for v in vs))
            writer = lambda df: (df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic") if mode == "update" else df.write.mode(mode)).partitionBy("step")
            writer(cells.repartition("step", "block").sortWithinPartitions("step", "block", "off")).parquet(f"{path}/grid={k}")
            writer(_block_table(g, vs).withColumn("step", (F.col("step") + step_offset).cast("int")).coalesce(8)).parquet(f"{path}/blocks={k}")
            known += [v.describe() | {"grid": k, "column": v.column, "nsteps": g.nsteps + step_offset} for v in vs]
        meta = [json.dumps({"variables": known, "attributes": [(a.name, a.type, list(a.values)) for a in self.attributes.values()]})]
        self.spark.createDataFrame([(m,) for m in meta], "meta string").coalesce(1).write.mode("overwrite").text(f"{path}/meta")

    def _continues(self, stored: Dataset, mode: str, step_offset: int) -> int:
        """The first step to write, if this dataset may follow the stored one."""
        if set(self.variables) != set(stored.variables):
            raise InvalidName(f"stored are {sorted(stored.variables)}, given are {sorted(self.variables)}")
        for n, v in self.variables.items():
            old = stored.variables[n]
            if v.type.name != old.type.name or v.grid.dims != old.grid.dims or v.grid.is_global != old.grid.is_global:
                raise InvalidQuery(f"{n} is stored as {old.type.name} {old.grid.dims}, not {v.type.name} {v.grid.dims}")
        last = max((v.grid.nsteps for v in stored.variables.values()), default=0)
        if mode == "update":
            if any(v.grid.nsteps != 1 for v in self.variables.values()):
                raise InvalidStep("an update is one step")
            return last - 1
        if step_offset and step_offset < last:
            raise InvalidStep(f"{last} steps are stored, so a new one can't be step {step_offset}")
        return step_offset or last

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> Dataset:
        """A stored dataset, all steps visible. Metadata is one small file."""
        meta = json.loads(spark.read.text(f"{path}/meta").first()[0])
        out, grids = cls(spark), {}
        for v in meta["variables"]:
            k = v["grid"]
            if k not in grids:
                grids[k] = Grid(spark.read.parquet(f"{path}/grid={k}"), tuple(v["dims"]), v["nsteps"], v["global"], spark.read.parquet(f"{path}/blocks={k}"))
            out.variables[v["name"]] = Variable(v["name"], grids[k], v["column"], value_type(v["type"]), v["group"], v["transform"])
        for name, kind, values in meta["attributes"]:
            out.attributes[name] = Attribute(name, kind, tuple(values))
        return out


def _block_table(grid: Grid, variables: Sequence[Variable]) -> DataFrame:
    """What ``save`` stores of each block: one row, with statistics of the numeric columns."""
    numeric = {v.column: v.type for v in variables if v.type.kind in ("int", "uint", "real")}
    found = grid.layout(*zone_aggregates(numeric)).drop("abs_block")
    if grid.declared is None:
        return found
    place = ["step", "block", *(f"{x}{k}" for k in range(grid.ndim) for x in "sn")]
    counted = found.drop(*place[2:])
    return grid.declared.select(place).join(counted, ["step", "block"], "left").withColumn("size", F.coalesce("size", F.lit(0).cast("long")))


def from_rows(rows: DataFrame, coords: Sequence[Column], dims: Sequence[int], values: Mapping[str, Column], step: Column | None = None, block: Column | None = None, off: Column | None = None, nsteps: int = 1, is_global: bool = True) -> Grid:
    """A grid over the rows of a table: expressions for coordinates, values, step and block."""
    lit = F.lit(0)
    cs = [c.cast("long").alias(f"c{k}") for k, c in enumerate(coords)]
    place = off if off is not None else lit
    cells = rows.select((step if step is not None else lit).cast("int").alias("step"), (block if block is not None else lit).cast("int").alias("block"), place.cast("long").alias("off"), *cs, *(v.alias(k) for k, v in values.items()))
    return Grid(cells, tuple(dims), nsteps, is_global)


def joined(local: Grid, axis: int = 0) -> Grid:
    """A joined array: the blocks of each step concatenated along an axis in block order."""
    n = local.cells.groupBy("step", "block").agg((F.max(f"c{axis}") + 1).alias("_n"))
    order = Window.partitionBy("step").orderBy("block")
    shift = n.select("step", "block", (F.sum("_n").over(order) - F.col("_n")).alias("_shift"))
    cells = local.cells.join(shift, ["step", "block"]).withColumn(f"c{axis}", F.col(f"c{axis}") + F.col("_shift")).drop("_shift")
    return replace(local, cells=cells, is_global=True)


def check_steps(v: Variable, first: int, count: int) -> None:
    if first < 0 or count < 1 or first + count > v.grid.nsteps:
        raise InvalidStep(f"{v.name} has steps 0 to {v.grid.nsteps - 1}")


def own_steps(cells: DataFrame, keys: Iterable[str] = ()) -> DataFrame:
    """Steps renumbered as a variable's own: its k-th written step is k."""
    keys = list(keys)
    seen = cells.select(*keys, "step").distinct()
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy("step")) - 1 if keys else F.row_number().over(Window.orderBy("step")) - 1
    return cells.join(seen.withColumn("_own", rank.cast("int")), [*keys, "step"]).withColumn("step", F.col("_own")).drop("_own")
