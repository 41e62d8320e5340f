"""Statistics of variables: blocks, steps and the whole, folded from block rows; histograms; series over steps.

Block rows are small (one a block), so everything above them is folded without another look at the cells.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.types import InvalidQuery

#: Names of the sums of a block's finite values, as stored.
BLOCK_STATS = ("cnt", "vmin", "vmax", "vsum", "vsumsq")
NUMERIC = ("tinyint", "smallint", "int", "bigint", "float", "double", "boolean")


def finite(value: Column) -> Column:
    """Neither null, NaN nor infinite."""
    v = value.cast("double")
    return v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))


def block_stats(cells: DataFrame, by: Sequence[str] = ("step", "block"), value: str = "value", full: bool = True) -> DataFrame:
    """cnt, vmin, vmax, vsum, vsumsq and finite of each block. ``full`` leaves out NaN and infinities; else only NaN are
    left out and there are no sums. Squares are taken as doubles. Values that are no numbers have no statistics."""
    kind = dict(cells.dtypes)[value]
    if kind not in NUMERIC and not kind.startswith("decimal"):
        raise InvalidQuery(f"{kind} values have no statistics")
    c, d = F.col(value), F.col(value).cast("double")
    used = finite(c) if full else c.isNotNull() & ~F.isnan(d)
    kept, real = F.when(used, c), F.when(used, d)
    sums = [F.sum(real).alias("vsum"), F.sum(real * real).alias("vsumsq")] if full else [F.lit(None).cast("double").alias(n) for n in ("vsum", "vsumsq")]
    out = cells.groupBy(*by).agg(F.count(kept).alias("cnt"), F.min(kept).alias("vmin"), F.max(kept).alias("vmax"), *sums)
    return out.withColumn("finite", F.col("cnt") > 0)


def stored_stats(v) -> DataFrame:
    """What ``block_stats`` gives of a variable of a stored dataset, from its table of blocks alone."""
    zones = v.grid.zones([v.column])
    if zones is None:
        raise InvalidQuery(f"no statistics of {v.name} are stored")
    out = zones.select("step", "block", *(F.col(f"_{n}_{v.column}").alias(n) for n in BLOCK_STATS))
    return out.withColumns({"cnt": F.coalesce("cnt", F.lit(0).cast("long")), "finite": F.coalesce(F.col("cnt") > 0, F.lit(False))})


def fold(stats: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """min, max, avg and (population) std_dev of block rows by step, block or all together. Blocks without finite values
    add nothing; a step or block of only such has avg and std_dev 0, the whole has null; without sums both are null."""
    usable = F.col("finite")
    some = lambda c: F.when(usable, F.col(c))
    out = stats.groupBy(*by).agg(F.min(some("vmin")).alias("min"), F.max(some("vmax")).alias("max"), F.sum(some("cnt")).alias("_n"), F.sum(some("vsum")).alias("_s"), F.sum(some("vsumsq")).alias("_q"))
    avg = F.col("_s") / F.col("_n")
    std = F.sqrt(F.greatest(F.col("_q") / F.col("_n") - avg * avg, F.lit(0.0)))
    if by:
        none = F.col("_n").isNull() | (F.col("_n") == 0)
        avg, std = F.when(none, 0.0).otherwise(avg), F.when(none, 0.0).otherwise(std)
    return out.select(*by, "min", "max", avg.alias("avg"), std.alias("std_dev"), F.coalesce("_n", F.lit(0)).alias("cnt"))


def levels(stats: DataFrame) -> DataFrame:
    """All three levels at once: ``level`` is block, step or all; step and block are null above their level."""
    own = [F.sum("cnt").alias("cnt"), F.min("vmin").alias("min"), F.max("vmax").alias("max"), F.sum("vsum").alias("_s"), F.sum("vsumsq").alias("_q")]
    sets = stats.filter("finite").groupingSets([["step", "block"], ["step"], []], "step", "block").agg(F.grouping_id().alias("_g"), *own)
    avg = F.col("_s") / F.col("cnt")
    std = F.sqrt(F.greatest(F.col("_q") / F.col("cnt") - avg * avg, F.lit(0.0)))
    level = F.when(F.col("_g") == 0, "block").when(F.col("_g") == 1, "step").otherwise("all")
    return sets.select(level.alias("level"), "step", "block", "cnt", "min", "max", avg.alias("avg"), std.alias("std_dev"))


def complex_parts(value: str = "value") -> dict[str, Column]:
    """Magnitude, real and imaginary part of a complex value; null where either part isn't finite."""
    re, im = F.col(f"{value}.re").cast("double"), F.col(f"{value}.im").cast("double")
    ok = finite(re) & finite(im)
    return {"magnitude": F.when(ok, F.sqrt(re * re + im * im)), "real": F.when(ok, re), "imaginary": F.when(ok, im)}


def complex_stats(cells: DataFrame, by: Sequence[str] = (), value: str = "value") -> DataFrame:
    """The three series of a complex variable, a row each: part, min, max, avg, std_dev, cnt."""
    parts = F.explode(F.array(*(F.struct(F.lit(k).alias("part"), v.alias("value")) for k, v in complex_parts(value).items())))
    rows = cells.select(*by, parts.alias("_p")).select(*by, "_p.part", "_p.value")
    return fold(block_stats(rows, [*by, "part"]), [*by, "part"])


# ------------------------------------------------------------------------------------------------------------ histograms
def breaks_of(breaks: Sequence[float] | None = None, low: float | None = None, high: float | None = None, count: int | None = None) -> list[float]:
    """Breaks by list (strictly increasing; it wins when both are given) or by range and number."""
    if breaks is not None:
        if not breaks or any(a >= b for a, b in zip(breaks, breaks[1:])):
            raise InvalidQuery("breaks must increase strictly")
        return [float(b) for b in breaks]
    if low is None or high is None or not count or low >= high:
        raise InvalidQuery("a range needs a smallest below a largest value and a number of bins")
    return [low + i * (high - low) / count for i in range(count + 1)]


def bin_of(value: Column, breaks: Sequence[float]) -> Column:
    """Number of breaks that are not above the value: bin 0 lies below all of them."""
    v = value.cast("double")
    return F.size(F.filter(F.array(*map(F.lit, breaks)), lambda b: b <= v))


def histogram(cells: DataFrame, breaks: Sequence[float], by: Sequence[str] = (), value: str = "value") -> DataFrame:
    """bin, lo, hi and freq of every bin, empty ones too; the outer bins are open. NaN and nulls are not counted."""
    spark = cells.sparkSession
    edges = [None, *breaks, None]
    bins = spark.createDataFrame([(i, edges[i], edges[i + 1]) for i in range(len(breaks) + 1)], "bin int, lo double, hi double")
    v = F.col(value).cast("double")
    counted = cells.filter(v.isNotNull() & ~F.isnan(v)).groupBy(*by, bin_of(v, breaks).alias("bin")).agg(F.count(F.lit(1)).alias("freq"))
    if by:
        bins = cells.select(*by).distinct().crossJoin(F.broadcast(bins))
    return bins.join(counted, [*by, "bin"], "left").select(*by, "bin", "lo", "hi", F.coalesce("freq", F.lit(0)).alias("freq"))


# ------------------------------------------------------------------------------------------------------ series over steps
# Characteristics of a step by long and short name.
CHARACTERISTICS = {"average": "avg", "avg": "avg", "standard deviation": "std_dev", "std_dev": "std_dev", "minimum": "min", "min": "min", "maximum": "max", "max": "max"}


def pairs(x: DataFrame, y: DataFrame | None, characteristic: str, first: int, last: int, lag: int = 0) -> DataFrame:
    """step, x and y over steps first to last, from per-step rows of ``fold``: y is the second variable's value or,
    without one, the first's ``lag`` steps later."""
    if characteristic not in CHARACTERISTICS:
        raise InvalidQuery(f"unknown characteristic {characteristic!r}")
    c = CHARACTERISTICS[characteristic]
    if last < first or lag < 0:
        raise InvalidQuery("a range of steps and a lag of 0 or more are needed")
    one = x.select("step", F.col(c).cast("double").alias("x"))
    if y is not None:
        both = one.join(y.select("step", F.col(c).cast("double").alias("y")), "step")
    else:
        # One row a step: the table of step statistics is small.
        both = one.withColumn("y", F.lead("x", lag).over(Window.orderBy("step")) if lag else F.col("x"))
    return both.filter(F.col("step").between(first, last) & F.col("y").isNotNull())


def covariance(x: DataFrame, y: DataFrame | None, characteristic: str, first: int, last: int, lag: int = 0) -> DataFrame:
    return pairs(x, y, characteristic, first, last, lag).agg(F.covar_pop("x", "y").alias("cov"), F.count(F.lit(1)).alias("n"))


def correlation(x: DataFrame, y: DataFrame | None, characteristic: str, first: int, last: int, lag: int = 0) -> DataFrame:
    return pairs(x, y, characteristic, first, last, lag).agg(F.corr("x", "y").alias("cor"), F.count(F.lit(1)).alias("n"))
