"""Steps of stored datasets: newest, missing ones, splitting and appending; comparison and re-blocking of cells."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.types import InvalidStep


def span(cells: DataFrame) -> DataFrame:
    """first, last and number of the steps."""
    return cells.select("step").distinct().agg(F.min("step").alias("first"), F.max("step").alias("last"), F.count(F.lit(1)).alias("nsteps"))


def newest(cells: DataFrame) -> DataFrame:
    """The cells of the last step."""
    return cells.join(F.broadcast(cells.agg(F.max("step").alias("step"))), "step", "left_semi")


def gaps(cells: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Steps that follow a gap: step, the step before and how many are missing. Sorted are the steps, not the cells."""
    steps = cells.select(*by, "step").distinct()
    order = Window.partitionBy(*by).orderBy("step") if by else Window.orderBy("step")
    seen = steps.withColumn("before", F.lag("step").over(order))
    return seen.filter(F.col("step") - F.col("before") > 1).withColumn("missing", (F.col("step") - F.col("before") - 1).cast("int"))


def resolve(first: int, last: int, nsteps: int) -> tuple[int, int]:
    """A range of steps whose negative ends count from the end."""
    a, b = (s + nsteps if s < 0 else s for s in (first, last))
    if not 0 <= a <= b < nsteps:
        raise InvalidStep(f"steps {first} to {last} of {nsteps}")
    return a, b


def split(cells: DataFrame, first: int, last: int, nsteps: int) -> DataFrame:
    """The cells of steps first to last, renumbered from 0."""
    a, b = resolve(first, last, nsteps)
    return cells.filter(F.col("step").between(a, b)).withColumn("step", (F.col("step") - a).cast("int"))


def append(cells: DataFrame, more: DataFrame, nsteps: int) -> DataFrame:
    """The steps of ``more`` behind the ``nsteps`` of ``cells``."""
    return cells.unionByName(more.withColumn("step", (F.col("step") + nsteps).cast("int")))


def compare(left: DataFrame, right: DataFrame, keys: Sequence[str], fuzz: float = 0.0, value: str = "value") -> DataFrame:
    """Cells that differ: keys, left, right and ``kind`` (missing left, missing right, value). NaN equals NaN; numbers
    differ by more than ``fuzz``."""
    a = left.select(*keys, F.col(value).alias("left"), F.lit(True).alias("_in_left"))
    b = right.select(*keys, F.col(value).alias("right"), F.lit(True).alias("_in_right"))
    kind = dict(a.dtypes)["left"]
    x, y = F.col("left"), F.col("right")
    differ = ~x.eqNullSafe(y)
    if kind in ("float", "double"):
        near = F.coalesce(F.abs(x.cast("double") - y.cast("double")) <= fuzz, F.lit(False))
        differ &= ~near
    both = a.join(b, list(keys), "full_outer")
    found = F.when(F.col("_in_left").isNull(), "missing left").when(F.col("_in_right").isNull(), "missing right").when(differ, "value")
    return both.withColumn("kind", found).filter("kind is not null").select(*keys, "left", "right", "kind")


def compare_catalogs(left: DataFrame, right: DataFrame) -> DataFrame:
    """Variables that one side lacks or that differ in type or dimensions: name, kind."""
    a = left.select("name", F.col("type").alias("_t"), F.col("ndim").alias("_n"))
    b = right.select("name", F.col("type").alias("_u"), F.col("ndim").alias("_m"))
    kind = F.when(F.col("_t").isNull(), "missing left").when(F.col("_u").isNull(), "missing right").when(F.col("_t") != F.col("_u"), "type").when(F.col("_n") != F.col("_m"), "ndim")
    return a.join(b, "name", "full_outer").select("name", kind.alias("kind")).filter("kind is not null")


def reblock(cells: DataFrame, by: Column | int) -> DataFrame:
    """Blocks merged: ``by`` neighbours into one, or the block that a Column gives. Places are numbered anew inside each
    block in order of the old block and place, from counts of the old blocks alone."""
    new = F.floor(F.col("block") / by).cast("int") if isinstance(by, int) else by.cast("int")
    rows = cells.withColumn("_new", new)
    sums = rows.groupBy("step", "_new", "block").agg((F.max("off") + 1).alias("_n"))
    before = sums.withColumn("_before", F.sum("_n").over(Window.partitionBy("step", "_new").orderBy("block")) - F.col("_n")).drop("_n")
    out = rows.join(before, ["step", "_new", "block"])
    return out.withColumns({"off": F.col("off") + F.col("_before"), "block": F.col("_new")}).drop("_new", "_before").select(cells.columns)


def quantise(value: Column, error: float) -> Column:
    """Values rounded so that none moves by more than ``error`` (what a lossy codec with that bound may store)."""
    if error <= 0:
        raise ValueError("the error must be above 0")
    step = 2 * error
    return F.round(value / step) * step
