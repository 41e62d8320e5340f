"""Registered queries: each applies one operation of the library to the data tables, with the SQL of the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.masks import matches
from ..operators import query as q
from ..operators import reading, slicing, stats, steps
from ..operators.selection import Auto, Block, Box, Points, SubBlock, Whole, intersect, to_nd
from ..sources.dataset import Grid, absolute, joined, own_steps
from . import arrays, inquiry

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def register(name: str, sql: str | None, run: Callable[[SparkSession, str], DataFrame]) -> None:
    """Add a query; its SQL may use the cell tables of ``arrays.SQL``."""
    QUERIES[name] = run
    if sql:
        ORACLE_SQL[name] = f"WITH {arrays.SQL.strip()} {sql}" if not sql.lstrip().startswith(",") else f"WITH {arrays.SQL.strip()}{sql}"


def rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in names})


# ----------------------------------------------------------------------------------------------------------------- reads
CELL2 = "step, block, off, c0, c1, embedding AS value"
E = lambda spark, d: arrays.vectors(spark, d)["embedding"]
EV = lambda spark, d: arrays.events(spark, d)["value"]

register("box_read_2d", f"SELECT {CELL2} FROM vectors_cells WHERE c0 BETWEEN 10 AND 59 AND c1 BETWEEN 4 AND 19", lambda s, d: reading.read(E(s, d), Box((10, 4), (50, 16))))
register("box_read_steps", "SELECT * FROM events_cells WHERE step BETWEEN 3 AND 7 AND c0 BETWEEN 1000 AND 2499", lambda s, d: reading.read(EV(s, d), Box((1000,), (1500,)), 3, 5))
register("whole_read", "SELECT * FROM events_cells", lambda s, d: reading.read(EV(s, d)))
register("block_read", f"SELECT {CELL2} FROM vectors_cells WHERE block = 3", lambda s, d: reading.read(E(s, d), Block(3)))
register("subblock_read", f"SELECT {CELL2} FROM vectors_cells WHERE block = 3 AND off BETWEEN 10 AND 29", lambda s, d: reading.read(E(s, d), SubBlock(3, 10, 20)))

POINTS = ((3, 5), (49, 63), (7, 0), (3, 5), (120, 17))
_VALUES = ", ".join(f"({i}, {a}, {b})" for i, (a, b) in enumerate(POINTS))
register(
    "points_read_nd", f"SELECT CAST(pid AS BIGINT) AS pid, c0, c1, embedding AS value FROM (VALUES {_VALUES}) p(pid, i, j) JOIN vectors_cells ON c0 = i AND c1 = j",
    lambda s, d: reading.read(E(s, d), Points(2, POINTS)).select("pid", "c0", "c1", "value"),
)
OFFSETS, HELD = (0, 65, 17, 799, 65), Box((20, 8), (50, 16))
register(
    "points_read_1d", f"SELECT CAST(pid AS BIGINT) AS pid, c0, c1, embedding AS value FROM (VALUES {', '.join(f'({i}, {o})' for i, o in enumerate(OFFSETS))}) p(pid, o) JOIN vectors_cells ON c0 = 20 + o // 16 AND c1 = 8 + o % 16",
    lambda s, d: reading.read(E(s, d), Points(1, OFFSETS, HELD)).select("pid", "c0", "c1", "value"),
)
register(
    "points_1d_to_nd", f"SELECT c0 AS c0, c1 AS c1, 20 + c0 AS g0, 8 + c1 AS g1 FROM (SELECT o // 16 AS c0, o % 16 AS c1 FROM (SELECT CAST(unnest(range(0, {HELD.size})) AS BIGINT) AS o))",
    lambda s, d: to_nd(s.range(HELD.size).withColumnRenamed("id", "off"), HELD).withColumns({f"g{k}": F.col(f"c{k}") + HELD.start[k] for k in range(2)}),
)
register(
    "points_in_box", f"SELECT CAST(row_number() OVER (ORDER BY pid) - 1 AS BIGINT) AS pid, c0, c1, embedding AS value FROM (VALUES {_VALUES}) p(pid, i, j) JOIN vectors_cells ON c0 = i AND c1 = j WHERE i < 50 AND j < 32",
    lambda s, d: reading.read(E(s, d), intersect(Points(2, POINTS), Box((0, 0), (50, 32)))).select("pid", "c0", "c1", "value"),
)
register(
    "box_intersect_boxes", f"SELECT {CELL2} FROM vectors_cells WHERE c0 BETWEEN 30 AND 39 AND c1 BETWEEN 8 AND 11",
    lambda s, d: reading.read(E(s, d), intersect(Box((10, 8), (30, 30)), Box((30, 0), (50, 12)))),
)
register(
    "box_intersect_blocks",
    """, b AS (SELECT step, block, min(c0) AS s0, max(c0) + 1 AS e0, min(c1) AS s1, max(c1) + 1 AS e1 FROM vectors_cells GROUP BY ALL)
    SELECT step, block, block AS abs_block, greatest(s0, 70) AS s0, least(e0, 170) - greatest(s0, 70) AS n0, greatest(s1, 8) AS s1, least(e1, 24) - greatest(s1, 8) AS n1
    FROM b WHERE greatest(s0, 70) < least(e0, 170) AND greatest(s1, 8) < least(e1, 24)""",
    lambda s, d: reading.overlaps(E(s, d).grid, Box((70, 8), (100, 16))),
)

# ------------------------------------------------------------------------------------------------------------ predicates
OPS = {"lt": "<", "le": "<=", "gt": ">", "ge": ">=", "eq": "=", "ne": "!="}
for _name, _op in OPS.items():
    register(
        f"pred_{_name}", f"SELECT step, c0 FROM parts_cells WHERE price {_op} 950.0",
        lambda s, d, op=_op: q.evaluate(q.Leaf(arrays.parts(s, d)["price"], op, "950.0")),
    )


def _orders(spark: SparkSession, sf_dir: str):
    ds = arrays.orders(spark, sf_dir)
    return ds["price"], ds["customer"]


def query_and(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, c = _orders(spark, sf_dir)
    return q.evaluate(q.Leaf(p, ">", "300000") & q.Leaf(c, "<=", "100"))


def query_or(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, c = _orders(spark, sf_dir)
    return q.evaluate(q.Leaf(p, ">", "490000") | q.Leaf(c, "=", "7"))


def query_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, c = _orders(spark, sf_dir)
    return q.where((q.Leaf(p, ">=", "100000") & q.Leaf(p, "<", "120000")) | (q.Leaf(c, "!=", "5") & q.Leaf(p, "<", "2000")), p, c)


def query_two_vars_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: two variables tested in a box, both read at the hits, in one filtered scan."""
    p, c = _orders(spark, sf_dir)
    box = Box((100,), (1200,))
    return q.where((q.Leaf(p, ">", "80000", box) & q.Leaf(p, "<", "190000", box)) & q.Leaf(c, "<=", "100", box), p, c)


def query_table_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns as places: rows whose components 1 and 2 have opposite signs, and their component 3."""
    e = E(spark, sf_dir)
    n = e.grid.dims[0]
    column = lambda k: Box((0, k), (n, 1))
    return q.where(q.Leaf(e, ">", "0", column(1)) & q.Leaf(e, "<=", "0", column(2)), e, out=column(3))


def query_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole rows of the hits, by a semi-join on the row."""
    e = E(spark, sf_dir)
    hits = q.evaluate(q.Leaf(e, ">", "0.25", Box((0, 0), (e.grid.dims[0], 1))))
    return e.cells.join(hits.select("step", "c0"), ["step", "c0"], "left_semi").select("step", "c0", "c1", "value")


def query_output_rebase(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = E(spark, sf_dir)
    return q.evaluate(q.Leaf(e, ">", "0.2", Box((10, 0), (40, 16))), Box((60, 32), (40, 16)))


def query_point_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = E(spark, sf_dir)
    return q.evaluate(q.Leaf(e, "<", "0", Points(2, POINTS))).select("step", F.col("c0").alias("pid"))


def query_fill_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, box = E(spark, sf_dir), Box((0, 0), (20, 64))
    hits = q.where(q.Leaf(e, ">", "0.1", box), e)
    return reading.fill(hits.withColumnRenamed("embedding", "value"), box, -1.0)


def query_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, _ = _orders(spark, sf_dir)
    return q.batch(q.Leaf(p, ">", "250000"), 100, 1).select("step", "block", "c0", "place")


_REGISTERED = {
    query_and: "SELECT step, c0 FROM orders_cells WHERE price > 300000 AND customer <= 100",
    query_or: "SELECT step, c0 FROM orders_cells WHERE price > 490000 OR customer = 7",
    query_nested: "SELECT step, c0, price, customer FROM orders_cells WHERE (price >= 100000 AND price < 120000) OR (customer <> 5 AND price < 2000)",
    query_two_vars_box: "SELECT step, c0, price, customer FROM orders_cells WHERE c0 BETWEEN 100 AND 1299 AND price > 80000 AND price < 190000 AND customer <= 100",
    query_table_columns: "SELECT a.step, a.c0, CAST(3 AS BIGINT) AS c1, x.embedding FROM vectors_cells a JOIN vectors_cells b USING (c0) JOIN vectors_cells x USING (c0) WHERE a.c1 = 1 AND b.c1 = 2 AND x.c1 = 3 AND a.embedding > 0 AND b.embedding <= 0",
    query_rows: "SELECT step, c0, c1, embedding AS value FROM vectors_cells WHERE c0 IN (SELECT c0 FROM vectors_cells WHERE c1 = 0 AND embedding > 0.25)",
    query_output_rebase: "SELECT step, c0 + 50 AS c0, c1 + 32 AS c1 FROM vectors_cells WHERE c0 BETWEEN 10 AND 49 AND c1 < 16 AND embedding > 0.2",
    query_point_list: f"SELECT step, CAST(pid AS BIGINT) AS pid FROM (VALUES {_VALUES}) p(pid, i, j) JOIN vectors_cells ON c0 = i AND c1 = j WHERE embedding < 0",
    query_fill_box: f"SELECT c0 * 64 + c1 AS at, c0, c1, CASE WHEN embedding > 0.1 THEN embedding ELSE -1.0 END AS value FROM vectors_cells WHERE c0 < 20",
    query_batches: "SELECT * FROM (SELECT step, block, c0, row_number() OVER (ORDER BY step, block, off) - 1 AS place FROM orders_cells WHERE price > 250000) WHERE place BETWEEN 100 AND 199",
}

# ------------------------------------------------------------------------------------------------------- candidate blocks
ZONES = ", z AS (SELECT step, block, block AS abs_block, count(*) AS size, min(price) AS lo, max(price) AS hi, min(customer) AS clo, max(customer) AS chi, min(c0) AS s, max(c0) AS e FROM orders_cells GROUP BY step, block) SELECT step, block, abs_block, size FROM z WHERE "
RULES = {"lt": "lo < 1500", "le": "lo <= 1500", "gt": "hi > 499500", "ge": "hi >= 499500", "eq": "lo <= 1100 AND hi >= 1100", "ne": "NOT (lo = 1100 AND hi = 1100)"}
CONSTANTS = {"lt": "1500", "le": "1500", "gt": "499500", "ge": "499500", "eq": "1100", "ne": "1100"}
for _name, _op in OPS.items():
    register(f"minmax_{_name}", ZONES + RULES[_name], lambda s, d, op=_op, c=CONSTANTS[_name]: q.blocks(q.Leaf(_orders(s, d)[0], op, c)))


def _minmax_and(spark: SparkSession, sf_dir: str) -> q.Query:
    p, c = _orders(spark, sf_dir)
    return q.Leaf(p, "<", "1500") & q.Leaf(c, "<=", "2")


def minmax_and(spark: SparkSession, sf_dir: str) -> DataFrame:
    return q.blocks(_minmax_and(spark, sf_dir))


def minmax_or_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, c = _orders(spark, sf_dir)
    box = Box((1500,), (4000,))
    return q.blocks(q.Leaf(p, "<", "1200", box) | q.Leaf(c, "<=", "0", box))


def minmax_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return q.estimate(_minmax_and(spark, sf_dir))


_REGISTERED |= {
    minmax_and: ZONES + "lo < 1500 AND clo <= 2",
    minmax_or_box: ZONES + "(lo < 1200 OR clo <= 0) AND s < 5500 AND e >= 1500",
    minmax_estimate: ZONES.replace("SELECT step, block, abs_block, size FROM z", "SELECT count(*) AS blocks, CAST(coalesce(sum(size), 0) AS BIGINT) AS cells FROM z") + "lo < 1500 AND clo <= 2",
}

# ------------------------------------------------------------------------------------------------------------ statistics
STAT = "min(value) AS min, max(value) AS max, round(avg(value), 6) AS avg, round(stddev_pop(value), 6) AS std_dev, count(value) AS cnt"


def block_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.block_stats(EV(spark, sf_dir).cells)


def stats_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(stats.fold(block_rows(spark, sf_dir), ["step", "block"]), "avg", "std_dev")


def stats_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(stats.fold(block_rows(spark, sf_dir), ["step"]), "avg", "std_dev")


def stats_global(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(stats.fold(block_rows(spark, sf_dir)), "avg", "std_dev")


def stats_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(stats.levels(block_rows(spark, sf_dir)), "avg", "std_dev")


def stats_minmax_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.fold(stats.block_stats(EV(spark, sf_dir).cells, full=False), ["step"]).select("step", "min", "max", "cnt")


def complex_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = arrays.table(spark, sf_dir, "embeddings").select(F.struct(F.col("embedding")[0].alias("re"), F.col("embedding")[1].alias("im")).alias("value"))
    return rounded(stats.complex_stats(e), "min", "max", "avg", "std_dev")


def histogram_breaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.histogram(EV(spark, sf_dir).cells, stats.breaks_of([0, 100, 200, 300]))


def histogram_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.histogram(EV(spark, sf_dir).cells, stats.breaks_of(low=0, high=500, count=10), ["step"])


def _bins(breaks: list[float]) -> str:
    rows = ", ".join(f"({i}, {a}, {b})" for i, (a, b) in enumerate(zip(["NULL", *breaks], [*breaks, "NULL"])))
    return f"bins AS (SELECT i AS bin, CAST(a AS DOUBLE) AS lo, CAST(b AS DOUBLE) AS hi FROM (VALUES {rows}) t(i, a, b))"


def _steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.fold(block_rows(spark, sf_dir), ["step"])


def _customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A second series: user ids of the events, by day."""
    ev = arrays.table(spark, sf_dir, "events")
    day = F.datediff(F.to_date("ts"), F.lit(arrays.FIRST_DAY).cast("date"))
    return stats.fold(stats.block_stats(ev.select(day.alias("step"), F.col("user_id").alias("value")), ["step"]), ["step"])


def covariance_lag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(stats.covariance(_steps(spark, sf_dir), None, "average", 0, 28, 1), "cov")


def correlation_lag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(stats.correlation(_steps(spark, sf_dir), None, "avg", 0, 28, 1), "cor")


def covariance_two(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(stats.covariance(_steps(spark, sf_dir), _customers(spark, sf_dir), "std_dev", 0, 29), "cov")


def correlation_two(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(stats.correlation(_steps(spark, sf_dir), _customers(spark, sf_dir), "max", 0, 29), "cor")


_LAG = ", s AS (SELECT step, avg(value) AS x FROM events_cells GROUP BY step), p AS (SELECT step, x, lead(x) OVER (ORDER BY step) AS y FROM s) "
_TWO = ", s AS (SELECT CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS INTEGER) AS step, {x} AS x, {y} AS y FROM events GROUP BY ALL) "
_REGISTERED |= {
    stats_block: f"SELECT step, block, {STAT} FROM events_cells GROUP BY step, block",
    stats_step: f"SELECT step, {STAT} FROM events_cells GROUP BY step",
    stats_global: f"SELECT {STAT} FROM events_cells",
    stats_levels: f"SELECT CASE GROUPING(step, block) WHEN 0 THEN 'block' WHEN 1 THEN 'step' ELSE 'all' END AS level, step, block, {STAT} FROM events_cells GROUP BY GROUPING SETS ((step, block), (step), ())",
    stats_minmax_only: "SELECT step, min(value) AS min, max(value) AS max, count(value) AS cnt FROM events_cells GROUP BY step",
    complex_stats: """, v AS (SELECT CAST(embedding[1] AS DOUBLE) AS re, CAST(embedding[2] AS DOUBLE) AS im FROM embeddings),
      p AS (SELECT 'magnitude' AS part, sqrt(re * re + im * im) AS value FROM v UNION ALL SELECT 'real', re FROM v UNION ALL SELECT 'imaginary', im FROM v)
      SELECT part, round(min(value), 6) AS min, round(max(value), 6) AS max, round(avg(value), 6) AS avg, round(stddev_pop(value), 6) AS std_dev, count(value) AS cnt FROM p GROUP BY part""",
    histogram_breaks: f", {_bins([0.0, 100.0, 200.0, 300.0])} SELECT bin, lo, hi, count(value) AS freq FROM bins LEFT JOIN events_cells ON (lo IS NULL OR value >= lo) AND (hi IS NULL OR value < hi) GROUP BY bin, lo, hi",
    histogram_range: f", {_bins([50.0 * i for i in range(11)])}, g AS (SELECT * FROM (SELECT DISTINCT step FROM events_cells), bins) SELECT g.step, bin, lo, hi, count(value) AS freq FROM g LEFT JOIN events_cells e ON e.step = g.step AND (lo IS NULL OR value >= lo) AND (hi IS NULL OR value < hi) GROUP BY g.step, bin, lo, hi",
    covariance_lag: _LAG + "SELECT round(covar_pop(x, y), 6) AS cov, count(*) AS n FROM p WHERE step BETWEEN 0 AND 28 AND y IS NOT NULL",
    correlation_lag: _LAG + "SELECT round(corr(x, y), 6) AS cor, count(*) AS n FROM p WHERE step BETWEEN 0 AND 28 AND y IS NOT NULL",
    covariance_two: _TWO.format(x="stddev_pop(value)", y="stddev_pop(CAST(user_id AS DOUBLE))") + "SELECT round(covar_pop(x, y), 6) AS cov, count(*) AS n FROM s WHERE step BETWEEN 0 AND 29",
    correlation_two: _TWO.format(x="max(value)", y="max(user_id)") + "SELECT round(corr(x, y), 6) AS cor, count(*) AS n FROM s WHERE step BETWEEN 0 AND 29",
}


# ------------------------------------------------------------------------------------------------- slices, blocks, listing
def _slice(spark: SparkSession, sf_dir: str, key) -> DataFrame:
    e = E(spark, sf_dir)
    found = slicing.select(e.cells, key, e.grid.dims)
    return found.select("step", "c0", "c1", *[c for c in ("o0", "o1") if c in found.columns], "value")


def slice_negative(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _slice(spark, sf_dir, (slice(-5, None), Ellipsis))


def slice_stride(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _slice(spark, sf_dir, (slice(3, None, 7), slice(0, 64, 4)))


def slice_fancy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _slice(spark, sf_dir, ([7, 1, 2, 7], 0))


def listing_dump(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = E(spark, sf_dir)
    box = slicing.listing_box("-4 10", "-1,-40", e.grid.dims)
    return reading.read(e, box).select("c0", "c1", "value")


def decomposition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E(spark, sf_dir).grid.layout()


def absolute_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return absolute(EV(spark, sf_dir).cells.select("step", "block").distinct())


def _local(spark: SparkSession, sf_dir: str) -> Grid:
    """Parts as a local array: a block a brand, places in key order."""
    rows = arrays.table(spark, sf_dir, "part")
    number = F.regexp_replace("p_brand", r"\D", "").cast("int")
    place = F.row_number().over(Window.partitionBy("p_brand").orderBy("p_partkey")) - 1
    cells = rows.select(F.lit(0).alias("step"), number.alias("block"), place.cast("long").alias("off"), place.cast("long").alias("c0"), F.col("p_retailprice").alias("value"))
    return Grid(cells, (0,), 1, False)


def joined_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joined(_local(spark, sf_dir)).cells


def local_box_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A box in a local array reads block 0 of each step: here the first six hours of a day, by place in the block."""
    ev = EV(spark, sf_dir)
    place = (F.row_number().over(Window.partitionBy("step", "block").orderBy("off")) - 1).cast("long")
    cells = ev.cells.withColumns({"c0": place, "off": place})
    return reading.choose(Grid(cells, (0,), ev.grid.nsteps, False), cells, Box((2,), (10,)))


def latest_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    return steps.newest(EV(spark, sf_dir).cells)


def step_span(spark: SparkSession, sf_dir: str) -> DataFrame:
    return steps.span(EV(spark, sf_dir).cells)


def step_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days that follow days without an event of value over 150, by event type."""
    ev = arrays.table(spark, sf_dir, "events").filter("value > 150")
    day = F.datediff(F.to_date("ts"), F.lit(arrays.FIRST_DAY).cast("date"))
    return steps.gaps(ev.select("event_type", day.alias("step")), ["event_type"])


def step_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = EV(spark, sf_dir)
    return steps.split(ev.cells, -5, -2, ev.grid.nsteps)


def step_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = EV(spark, sf_dir)
    both = steps.append(ev.cells, ev.cells.filter("step < 3"), ev.grid.nsteps)
    return rounded(stats.fold(stats.block_stats(both), ["step"]), "avg", "std_dev")


def own_step_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A variable that is not written every step counts its own: events of value over 150."""
    ev = arrays.table(spark, sf_dir, "events").filter("value > 150")
    day = F.datediff(F.to_date("ts"), F.lit(arrays.FIRST_DAY).cast("date"))
    return own_steps(ev.select("event_type", day.alias("step"), F.col("event_id").alias("c0")), ["event_type"])


def compare_fuzz(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, _ = _orders(spark, sf_dir)
    a = p.cells.filter("c0 % 11 != 0")
    b = p.cells.filter("c0 % 13 != 0").withColumn("value", F.when(F.col("c0") % 7 == 0, F.col("value") + F.col("c0") % 3).otherwise(F.col("value")))
    return steps.compare(a, b, ["step", "c0"], 0.5).drop("left", "right")


def reblock(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, _ = _orders(spark, sf_dir)
    return rounded(stats.fold(stats.block_stats(steps.reblock(p.cells, 2)), ["step", "block"]), "avg", "std_dev")


def quantised(spark: SparkSession, sf_dir: str) -> DataFrame:
    return EV(spark, sf_dir).cells.select("step", "c0", steps.quantise(F.col("value"), 0.25).alias("value"))


def _names(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(n,) for n in NAMES], "name string")


# A listing's names, as a file with folders of variables would have them.
NAMES = ("orders/price", "orders/customer", "/parts/price", "parts/size", "events/value", "vectors/embedding", "price", "orders/price/unit")
_NAME_ROWS = ", ".join(f"('{n}')" for n in NAMES)


def mask_glob(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _names(spark).filter(matches(F.col("name"), "*/pri?e"))


def mask_regex(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _names(spark).filter(matches(F.col("name"), ".*price.*", regex=True))


def catalog_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listing with statistics: type, name, shape, min, max, avg and std_dev of the arrays of a dataset."""
    ds = arrays.orders(spark, sf_dir)
    out = None
    for v in ds.variables.values():
        row = stats.fold(stats.block_stats(v.cells)).select(F.lit(v.name).alias("name"), F.col("min").cast("double").alias("min"), F.col("max").cast("double").alias("max"), "avg", "std_dev")
        out = row if out is None else out.unionByName(row)
    return rounded(ds.listing().join(out, "name"), "avg", "std_dev")


_REGISTERED |= {
    slice_negative: "SELECT step, c0, c1, c0 - ((SELECT max(c0) FROM vectors_cells) - 4) AS o0, c1 AS o1, embedding AS value FROM vectors_cells WHERE c0 > (SELECT max(c0) FROM vectors_cells) - 5",
    slice_stride: "SELECT step, c0, c1, (c0 - 3) // 7 AS o0, c1 // 4 AS o1, embedding AS value FROM vectors_cells WHERE c0 >= 3 AND (c0 - 3) % 7 = 0 AND c1 % 4 = 0",
    slice_fancy: "SELECT step, c0, c1, CAST(o AS BIGINT) AS o0, embedding AS value FROM (VALUES (0, 7), (1, 1), (2, 2), (3, 7)) p(o, i) JOIN vectors_cells ON c0 = i WHERE c1 = 0",
    listing_dump: "SELECT c0, c1, embedding AS value FROM vectors_cells WHERE c0 > (SELECT max(c0) FROM vectors_cells) - 4 AND c1 BETWEEN 10 AND 24",
    decomposition: "SELECT step, block, min(c0) AS s0, max(c0) - min(c0) + 1 AS n0, min(c1) AS s1, max(c1) - min(c1) + 1 AS n1, count(*) AS size, block AS abs_block FROM vectors_cells GROUP BY step, block",
    absolute_blocks: ", b AS (SELECT DISTINCT step, block FROM events_cells), n AS (SELECT step, count(*) AS n FROM b GROUP BY step), r AS (SELECT step, sum(n) OVER (ORDER BY step) - n AS before FROM n) SELECT b.step, b.block, CAST(before + block AS INTEGER) AS abs_block FROM b JOIN r USING (step)",
    joined_array: ", p AS (SELECT CAST(regexp_replace(p_brand, '\\D', '', 'g') AS INTEGER) AS block, p_partkey, p_retailprice FROM part) SELECT 0 AS step, block, row_number() OVER (PARTITION BY block ORDER BY p_partkey) - 1 AS off, row_number() OVER (ORDER BY block, p_partkey) - 1 AS c0, p_retailprice AS value FROM p",
    local_box_read: ", r AS (SELECT step, block, row_number() OVER (PARTITION BY step, block ORDER BY off) - 1 AS off, value FROM events_cells) SELECT step, block, off, off AS c0, value FROM r WHERE block = 0 AND off BETWEEN 2 AND 11",
    latest_step: "SELECT * FROM events_cells WHERE step = (SELECT max(step) FROM events_cells)",
    step_span: "SELECT min(step) AS first, max(step) AS last, count(DISTINCT step) AS nsteps FROM events_cells",
    step_gaps: ", s AS (SELECT DISTINCT event_type, CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS INTEGER) AS step FROM events WHERE value > 150), g AS (SELECT *, lag(step) OVER (PARTITION BY event_type ORDER BY step) AS before FROM s) SELECT event_type, step, before, step - before - 1 AS missing FROM g WHERE step - before > 1",
    step_split: ", n AS (SELECT max(step) + 1 AS n FROM events_cells) SELECT CAST(step - (n - 5) AS INTEGER) AS step, block, off, c0, value FROM events_cells, n WHERE step BETWEEN n - 5 AND n - 2",
    step_append: f", n AS (SELECT max(step) + 1 AS n FROM events_cells), b AS (SELECT step, value FROM events_cells UNION ALL SELECT step + n, value FROM events_cells, n WHERE step < 3) SELECT CAST(step AS INTEGER) AS step, {STAT} FROM b GROUP BY step",
    own_step_numbers: ", s AS (SELECT event_type, CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS INTEGER) AS day, event_id FROM events WHERE value > 150) SELECT event_type, CAST(dense_rank() OVER (PARTITION BY event_type ORDER BY day) - 1 AS INTEGER) AS step, event_id AS c0 FROM s",
    compare_fuzz: """, a AS (SELECT step, c0, price AS l FROM orders_cells WHERE c0 % 11 != 0), b AS (SELECT step, c0, price + CASE WHEN c0 % 7 = 0 THEN c0 % 3 ELSE 0 END AS r FROM orders_cells WHERE c0 % 13 != 0)
      SELECT step, c0, CASE WHEN l IS NULL THEN 'missing left' WHEN r IS NULL THEN 'missing right' ELSE 'value' END AS kind FROM a FULL JOIN b USING (step, c0) WHERE l IS NULL OR r IS NULL OR abs(l - r) > 0.5""",
    reblock: f"SELECT step, CAST(block // 2 AS INTEGER) AS block, {STAT.replace('value', 'price')} FROM orders_cells GROUP BY ALL",
    quantised: "SELECT step, c0, round(value / 0.5) * 0.5 AS value FROM events_cells",
    mask_glob: f"SELECT name FROM (VALUES {_NAME_ROWS}) n(name) WHERE regexp_full_match(name, '/?[^/]*/pri[^/]e')",
    mask_regex: f"SELECT name FROM (VALUES {_NAME_ROWS}) n(name) WHERE name LIKE '%price%'",
    catalog_listing: f"""SELECT 'double' AS type, 'price' AS name, '{{' || (SELECT max(c0) + 1 FROM orders_cells) || '}}' AS shape, min(price) AS min, max(price) AS max, round(avg(price), 6) AS avg, round(stddev_pop(price), 6) AS std_dev FROM orders_cells
      UNION ALL SELECT 'long', 'customer', '{{' || (SELECT max(c0) + 1 FROM orders_cells) || '}}', CAST(min(customer) AS DOUBLE), CAST(max(customer) AS DOUBLE), round(avg(customer), 6), round(stddev_pop(customer), 6) FROM orders_cells""",
}


# ------------------------------------------------------------------------------------------------------ stored and streamed
def stored_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events written as a dataset and read again: two steps, from the folders of those steps alone."""
    from ..sources.dataset import Dataset
    from .scratch import folder

    ds = arrays.events(spark, sf_dir)
    ds.save(path := folder(spark))
    back = Dataset.open(spark, path)["value"]
    return reading.read(back, Whole(), 4, 2)


def stream_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics of every step as a stream delivers them."""
    from ..streaming import steps as streaming
    from .scratch import folder

    source = folder(spark)
    EV(spark, sf_dir).cells.repartition(4, "step").write.parquet(source)
    kept, log = folder(spark), folder(spark)
    schema = "step int, block int, off long, c0 long, value double"
    streaming.store(streaming.source(spark, source, schema, files=1), kept, log)
    return rounded(stats.fold(stats.block_stats(spark.read.schema(schema).parquet(kept)), ["step"]), "avg", "std_dev")


def _stored(spark: SparkSession, ds, name: str):
    """A variable of a dataset as it comes back from its folder."""
    from ..sources.dataset import Dataset
    from .scratch import folder

    ds.save(path := folder(spark))
    return Dataset.open(spark, path)[name]


def minmax_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidate blocks from the stored table of blocks; the cells aren't read."""
    from ..sources.dataset import Dataset
    from .scratch import folder

    arrays.orders(spark, sf_dir).save(path := folder(spark))
    back = Dataset.open(spark, path)
    return q.blocks(q.Leaf(back["price"], "<", "1500") & q.Leaf(back["customer"], "<=", "2"))


def stats_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics of steps from the stored table of blocks; the cells aren't read."""
    v = _stored(spark, arrays.events(spark, sf_dir), "value")
    return rounded(stats.fold(stats.stored_stats(v), ["step"]), "avg", "std_dev")


def _gapped(spark: SparkSession, sf_dir: str):
    """Events in four declared blocks a day, of which every third has no cells, as they come back from a folder."""
    from ..sources.dataset import Dataset, declare

    ev = EV(spark, sf_dir)
    blocks = declare(spark, [(s, b, (0,), (0 if (s + b) % 3 == 0 else ev.grid.dims[0],)) for s in range(ev.grid.nsteps) for b in range(4)], 1)
    ds = Dataset(spark)
    ds.define("value", None, (), grid=Grid(ev.grid.cells.filter("(step + block) % 3 != 0"), ev.grid.dims, ev.grid.nsteps, True, blocks))
    return _stored(spark, ds, "value")


def empty_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _gapped(spark, sf_dir).grid.layout()


def absolute_blocks_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reading.read(_gapped(spark, sf_dir), Block(10, absolute=True))


def block_intersect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A block by its number over all steps meets part of one by its number in the step."""
    v = _gapped(spark, sf_dir)
    assert reading.shared(v.grid, Block(10, absolute=True), Block(3)) is None
    return reading.read(v, reading.shared(v.grid, Block(10, absolute=True), SubBlock(2, 200, 4000)))


def stored_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three days stored, two appended and the last one then written anew: statistics of the steps."""
    from ..sources.dataset import Dataset
    from .scratch import folder

    ev, path = EV(spark, sf_dir), folder(spark)

    def days(first: int, count: int, value=F.col("value")) -> Dataset:
        ds = Dataset(spark)
        cells = steps.split(ev.cells, first, first + count - 1, ev.grid.nsteps)
        ds.define("value", cells.withColumn("value", value), ev.grid.dims, nsteps=count)
        return ds

    days(0, 3).save(path)
    days(3, 2).save(path, mode="append")
    days(4, 1, F.col("value") + 1000).save(path, mode="update")
    return rounded(stats.fold(stats.stored_stats(Dataset.open(spark, path)["value"]), ["step"]), "avg", "std_dev")


def batch_joined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A batch of the hits of a query over two boxes."""
    e = E(spark, sf_dir)
    column = lambda k: Box((0, k), (e.grid.dims[0], 1))
    return q.batch(q.Leaf(e, ">", "0", column(1)) & q.Leaf(e, "<=", "0", column(2)), 25, 2)


def batch_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, _ = _orders(spark, sf_dir)
    return q.status(q.evaluate(q.Leaf(p, ">", "250000")), 100, 1)


def minmax_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, _ = _orders(spark, sf_dir)
    return q.block_batch(q.Leaf(p, "<", "1500"), 3, 1)


def minmax_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cells of candidate blocks inside a box."""
    p, c = _orders(spark, sf_dir)
    box = Box((1500,), (4000,))
    return q.cells_of_blocks(q.blocks(q.Leaf(p, "<", "1200", box) | q.Leaf(c, "<=", "0", box)), p, box)


def read_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reading.chunk(EV(spark, sf_dir), Box((1000,), (1500,)), 40, 2, 3, 5)


def points_meet_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = E(spark, sf_dir)
    return reading.read(e, intersect(Points(2, POINTS), Points(2, ((7, 0), (3, 5), (8, 8))))).select("pid", "c0", "c1", "value")


def points_in_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points relative to the start of a block."""
    return reading.read(E(spark, sf_dir), Points(2, ((0, 0), (3, 7), (49, 63), (3, 7)), Block(2))).select("pid", "c0", "c1", "value")


def auto_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reading.read(EV(spark, sf_dir), Auto(), 2, 1)


def slice_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Steps are the first axis of a subscript."""
    ev = EV(spark, sf_dir)
    return slicing.select(ev.cells, (slice(2, 20, 5), slice(100, 2000, 3)), ev.grid.dims, ev.grid.nsteps).drop("off", "block")


def dump_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return slicing.dump(EV(spark, sf_dir), "-3 500", "2,1000").select("step", "c0", "value")


def bytes_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of nations as 8-bit arrays that end with a zero, and as text again."""
    rows = arrays.table(spark, sf_dir, "nation")
    codes = F.transform(F.split("n_name", ""), F.ascii)
    long = rows.select(F.col("n_nationkey").cast("long").alias("c0"), F.posexplode(F.concat(codes, F.array(F.lit(0), F.lit(65)))).alias("c1", "value"))
    cells = long.select(F.lit(0).alias("step"), "c0", F.col("c1").cast("long").alias("c1"), F.col("value").cast("tinyint").alias("value"))
    return reading.as_text(cells, 2)


def catalog_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return steps.compare_catalogs(arrays.orders(spark, sf_dir).catalog(), arrays.parts(spark, sf_dir).catalog())


def stream_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A query tree on the steps that a stream delivers: its hits, stored step by step."""
    from ..streaming import steps as streaming
    from .scratch import folder

    ev, source, kept, log = EV(spark, sf_dir), folder(spark), folder(spark), folder(spark)
    ev.cells.repartition(4, "step").write.parquet(source)
    schema, box = "step int, block int, off long, c0 long, value double", Box((200,), (3000,))
    tree = (q.Leaf(ev, ">", "150", box) & q.Leaf(ev, "<=", "170", box)) | q.Leaf(ev, "<", "1", box)
    streaming.store(q.matching(tree, streaming.source(spark, source, schema, files=1)), kept, log)
    return spark.read.schema(schema).parquet(kept)


_ZONES = ZONES.split("SELECT step, block, abs_block")[0]
_DECLARED = ", s AS (SELECT CAST(unnest(range(0, (SELECT max(step) + 1 FROM events_cells))) AS INTEGER) AS step), d AS (SELECT step, CAST(b AS INTEGER) AS block FROM s, (VALUES (0), (1), (2), (3)) t(b)) "
_REGISTERED |= {
    stored_round_trip: "SELECT * FROM events_cells WHERE step BETWEEN 4 AND 5",
    stream_steps: f"SELECT step, {STAT} FROM events_cells GROUP BY step",
    minmax_stored: ZONES + "lo < 1500 AND clo <= 2",
    stats_stored: f"SELECT step, {STAT} FROM events_cells GROUP BY step",
    empty_blocks: _DECLARED + "SELECT d.step, d.block, CAST(4 * d.step + d.block AS INTEGER) AS abs_block, 0 AS s0, CASE WHEN (d.step + d.block) % 3 = 0 THEN 0 ELSE (SELECT max(c0) + 1 FROM events_cells) END AS n0, count(e.c0) AS size FROM d LEFT JOIN events_cells e ON e.step = d.step AND e.block = d.block AND (d.step + d.block) % 3 != 0 GROUP BY d.step, d.block",
    absolute_blocks_gap: "SELECT * FROM events_cells WHERE step = 2 AND block = 2",
    block_intersect: "SELECT * FROM events_cells WHERE step = 2 AND block = 2 AND off BETWEEN 200 AND 4199",
    stored_append: f", b AS (SELECT step, value + CASE WHEN step = 4 THEN 1000 ELSE 0 END AS value FROM events_cells WHERE step < 5) SELECT step, {STAT} FROM b GROUP BY step",
    batch_joined: "SELECT * FROM (SELECT a.step, a.c0, CAST(1 AS BIGINT) AS c1, row_number() OVER (ORDER BY a.c0) - 1 AS place FROM vectors_cells a JOIN vectors_cells b USING (c0) WHERE a.c1 = 1 AND b.c1 = 2 AND a.embedding > 0 AND b.embedding <= 0) WHERE place BETWEEN 50 AND 74",
    batch_status: "SELECT count(*) AS results, greatest(least(count(*) - 100, 100), 0) AS held, greatest(count(*) - 200, 0) AS follow, count(*) <= 200 AS last FROM orders_cells WHERE price > 250000",
    minmax_batch: _ZONES + "SELECT * FROM (SELECT step, block, abs_block, size, row_number() OVER (ORDER BY step, block) - 1 AS place FROM z WHERE lo < 1500) WHERE place BETWEEN 3 AND 5",
    minmax_cells: _ZONES + "SELECT o.step, o.block, o.off, o.c0, o.price AS value FROM orders_cells o JOIN z USING (step, block) WHERE (lo < 1200 OR clo <= 0) AND s < 5500 AND e >= 1500 AND c0 BETWEEN 1500 AND 5499",
    read_batches: "SELECT * FROM (SELECT *, row_number() OVER (ORDER BY step, block, off) - 1 AS place FROM events_cells WHERE step BETWEEN 3 AND 7 AND c0 BETWEEN 1000 AND 2499) WHERE place BETWEEN 80 AND 119",
    points_meet_points: "SELECT CAST(pid AS BIGINT) AS pid, c0, c1, embedding AS value FROM (VALUES (0, 3, 5), (1, 7, 0), (2, 3, 5)) p(pid, i, j) JOIN vectors_cells ON c0 = i AND c1 = j",
    points_in_block: "SELECT CAST(pid AS BIGINT) AS pid, c0, c1, embedding AS value FROM (VALUES (0, 100, 0), (1, 103, 7), (2, 149, 63), (3, 103, 7)) p(pid, i, j) JOIN vectors_cells ON c0 = i AND c1 = j",
    auto_read: "SELECT * FROM events_cells WHERE step = 2",
    slice_steps: "SELECT step, c0, value, CAST((step - 2) // 5 AS BIGINT) AS o0, (c0 - 100) // 3 AS o1 FROM events_cells WHERE step BETWEEN 2 AND 19 AND (step - 2) % 5 = 0 AND c0 BETWEEN 100 AND 1999 AND (c0 - 100) % 3 = 0",
    dump_steps: ", n AS (SELECT max(step) AS n FROM events_cells) SELECT step, c0, value FROM events_cells, n WHERE step BETWEEN n - 2 AND n - 1 AND c0 BETWEEN 500 AND 1499",
    bytes_text: "SELECT 0 AS step, CAST(n_nationkey AS BIGINT) AS c0, n_name AS text FROM nation",
    catalog_differences: "SELECT * FROM (VALUES ('customer', 'missing right'), ('size', 'missing left')) t(name, kind)",
    stream_query: "SELECT * FROM events_cells WHERE c0 BETWEEN 200 AND 3199 AND ((value > 150 AND value <= 170) OR value < 1)",
}
_REGISTERED |= inquiry.REGISTERED
for _f, _sql in _REGISTERED.items():
    register(_f.__name__, _sql, _f)

#: Timed by the benchmark.
HEADLINE = (
    "box_read_2d", "box_read_steps", "points_read_nd", "block_read", "query_and", "query_nested", "query_two_vars_box", "query_table_columns", "query_fill_box", "query_batches",
    "minmax_lt", "minmax_and", "stats_block", "stats_levels", "histogram_range", "correlation_lag", "slice_stride", "joined_array", "step_split", "compare_fuzz", "reblock", "stored_round_trip",
    "minmax_stored", "stats_stored", "absolute_blocks_gap", "batch_joined", "minmax_batch", "slice_steps", "stream_query",
)
