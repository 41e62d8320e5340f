"""The data tables as arrays: which columns are coordinates, steps, blocks and values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.dataset import Dataset, Grid, from_rows

#: First day of the events; cells of a block of each array.
FIRST_DAY = "2024-01-01"
ORDERS, PARTS, VECTORS, DIM = 1000, 100, 50, 64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _extent(rows: DataFrame, key: str | Column) -> int:
    """One more than the largest key."""
    return (rows.agg(F.max(key)).first()[0] or -1) + 1


def _dense(rows: DataFrame, key: str, size: int, values: dict[str, Column]) -> Grid:
    """A one-dimensional array over a dense key, in blocks of ``size`` cells."""
    k = F.col(key)
    return from_rows(rows, [k], [_extent(rows, key)], values, block=F.floor(k / size), off=k % size)


def orders(spark: SparkSession, sf_dir: str) -> Dataset:
    """``price`` and ``customer`` over the order keys."""
    grid = _dense(table(spark, sf_dir, "orders"), "o_orderkey", ORDERS, {"price": F.col("o_totalprice"), "customer": F.col("o_custkey")})
    ds = Dataset(spark)
    for name in ("price", "customer"):
        ds.define(name, grid.cells, grid.dims, name, grid=grid, group="orders")
    return ds


def parts(spark: SparkSession, sf_dir: str) -> Dataset:
    """``price`` and ``size`` over the part keys."""
    grid = _dense(table(spark, sf_dir, "part"), "p_partkey", PARTS, {"price": F.col("p_retailprice"), "size": F.col("p_size")})
    ds = Dataset(spark)
    for name in ("price", "size"):
        ds.define(name, grid.cells, grid.dims, name, grid=grid, group="parts")
    return ds


def events(spark: SparkSession, sf_dir: str) -> Dataset:
    """``value`` over the event ids, a step a day, a block for every six hours."""
    rows = table(spark, sf_dir, "events")
    day = F.datediff(F.to_date("ts"), F.lit(FIRST_DAY).cast("date"))
    extent = rows.agg(F.max("event_id"), F.max(day)).first()
    grid = from_rows(rows, [F.col("event_id")], [(extent[0] or 0) + 1], {"value": F.col("value")}, step=day, block=F.floor(F.hour("ts") / 6), off=F.col("event_id"), nsteps=(extent[1] or 0) + 1)
    ds = Dataset(spark)
    ds.define("value", grid.cells, grid.dims, grid=grid, group="events")
    return ds


def vectors(spark: SparkSession, sf_dir: str) -> Dataset:
    """``embedding``: vector by component, in blocks of ``VECTORS`` rows."""
    rows = table(spark, sf_dir, "embeddings")
    long = rows.select("vec_id", F.posexplode("embedding").alias("k", "x"))
    i, k = F.col("vec_id"), F.col("k")
    grid = from_rows(long, [i, k], [_extent(rows, "vec_id"), DIM], {"embedding": F.col("x").cast("double")}, block=F.floor(i / VECTORS), off=(i % VECTORS) * DIM + k)
    ds = Dataset(spark)
    ds.define("embedding", grid.cells, grid.dims, "embedding", grid=grid, group="vectors")
    return ds


#: The same cells in DuckDB.
SQL = f"""
  orders_cells AS (SELECT 0 AS step, CAST(o_orderkey // {ORDERS} AS INTEGER) AS block, o_orderkey % {ORDERS} AS off, o_orderkey AS c0, o_totalprice AS price, o_custkey AS customer FROM orders),
  parts_cells AS (SELECT 0 AS step, CAST(p_partkey // {PARTS} AS INTEGER) AS block, p_partkey % {PARTS} AS off, p_partkey AS c0, p_retailprice AS price, p_size AS size FROM part),
  events_cells AS (SELECT CAST(date_diff('day', DATE '{FIRST_DAY}', CAST(ts AS DATE)) AS INTEGER) AS step, CAST(hour(ts) // 6 AS INTEGER) AS block, event_id AS off, event_id AS c0, value FROM events),
  vectors_cells AS (SELECT 0 AS step, CAST(c0 // {VECTORS} AS INTEGER) AS block, (c0 % {VECTORS}) * {DIM} + c1 AS off, c0, c1, embedding
    FROM (SELECT vec_id AS c0, CAST(unnest(range(0, {DIM})) AS BIGINT) AS c1, CAST(unnest(embedding) AS DOUBLE) AS embedding FROM embeddings))
"""
