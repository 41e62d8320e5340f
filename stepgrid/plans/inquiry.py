"""Registered queries on what datasets say of themselves: names, types, attributes, meshes, selections, steps, errors."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.types import TYPES, ArrayError, EndOfStream, StepNotReady, literal, operator_of, type_size, value_type
from ..operators import query as q
from ..operators import reading, slicing, stats
from ..operators.selection import Block, Box, Points, SubBlock, Whole, intersect
from ..sources import mesh
from ..sources.dataset import Dataset, check_steps
from ..streaming import steps as streaming
from . import arrays
from .scratch import folder


def described(spark: SparkSession, sf_dir: str) -> Dataset:
    """Orders and parts in one dataset, with attributes, as it comes back from its folder."""
    ds = arrays.orders(spark, sf_dir)
    ds.variables |= {f"parts/{n}": replace(v, name=f"parts/{n}") for n, v in arrays.parts(spark, sf_dir).variables.items()}
    ds.attribute("price/unit", "EUR")
    ds.attribute("price/limits", [1, 2])
    ds.attribute("price/limits/note", "soft")
    ds.attribute("title", ["a", "b"])
    ds.attribute("ref", ds["price"])
    ds.save(path := folder(spark))
    return Dataset.open(spark, path)


def attribute_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return described(spark, sf_dir).attribute_table().withColumn("values", F.array_join("values", ";"))


def variable_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = described(spark, sf_dir).attributes_of("/price")
    return spark.createDataFrame([(a.name, a.nelems) for a in found], "name string, nelems int")


def group_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return described(spark, sf_dir).view("parts").catalog().select("group", "name", "ndim", "nsteps", "transform")


def group_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(g,) for g in described(spark, sf_dir).groups()], "name string")


def found_under_a_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A variable with or without a leading slash, an attribute, and what lies under a prefix."""
    ds = described(spark, sf_dir)
    inside = sorted(ds["parts"].variables)
    return spark.createDataFrame([("variable", ds["/price"].name), ("attribute", ds["price/unit"].values[0]), *(("inside", n) for n in inside)], "kind string, name string")


def definitions_dropped(spark: SparkSession, sf_dir: str) -> DataFrame:
    ds = described(spark, sf_dir)
    ds.drop("customer")
    ds.drop("parts/size")
    return ds.listing().select("name", "shape")


def type_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(n, t.name, type_size(t, "abc")) for t in TYPES for n in (t.name, *t.aliases)], "alias string, name string, size int")


def parsed_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Constants of predicates, read from text by the type of their variable."""
    of = lambda text, kind: literal(text, value_type(kind))
    return spark.range(1).select(of(" 5.7", "integer").alias("cut"), of("-12abc", "long").alias("signed"), of("1e3", "double").alias("real"), of("18446744073709551615", "unsigned long").alias("large"))


def operator_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(t, operator_of(t)) for t in ("LT", "lteq", "GT", "GE", "EQ", "==", "NE", "<=")], "text string, sign string")


def condition_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    ds = arrays.orders(spark, sf_dir)
    p, c = ds["price"], ds["customer"]
    return spark.createDataFrame([(str((q.Leaf(p, "<", "7.5") & q.Leaf(p, "GT", "1")) | q.Leaf(c, "=", "3")),)], "condition string")


def error_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is refused, and with which code."""
    ds = arrays.orders(spark, sf_dir)
    p, e = ds["price"], arrays.vectors(spark, sf_dir)["embedding"]
    cases = {
        "boxes of other shapes": lambda: q.Leaf(p, "<", "1", Box((0,), (5,))) & q.Leaf(p, ">", "1", Box((0,), (6,))), "a box and points": lambda: q.Leaf(p, "<", "1", Box((0,), (1,))) & q.Leaf(p, "<", "1", Points(1, (0,))),
        "an operator": lambda: operator_of("~"), "a constant": lambda: q.Leaf(p, "<", "abc"), "a name": lambda: ds.variable("nothing"), "a type": lambda: value_type("quad"), "a step": lambda: check_steps(p, 0, 2),
        "a box outside": lambda: reading.read(e, Box((0, 60), (1, 9))), "a box and a block": lambda: intersect(Box((0,), (1,)), Block(0)), "blocks of two numberings": lambda: intersect(Block(0), Block(0, absolute=True)),
        "statistics of text": lambda: stats.block_stats(spark.createDataFrame([(0, 0, "x")], "step int, block int, value string")), "a mesh without dimensions": lambda: mesh.Mesh("m", "uniform"),
    }
    rows = []
    for name, run in cases.items():
        try:
            run()
            rows.append((name, 0))
        except ArrayError as error:
            rows.append((name, error.code))
    return spark.createDataFrame(rows, "refused string, code int")


def slice_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = []
    for key in ((20,), (slice(5, 2),), (slice(0, 4, 0),), ([1, 99],), ([0, 1], [0, 1]), (0, 0, 0), (slice(-3, None), 1)):
        try:
            rows.append((str(key), "x".join(str(a.size) for a in slicing.axes(key, (10, 4)))))
        except (ValueError, TypeError) as error:
            rows.append((str(key), type(error).__name__))
    return spark.createDataFrame(rows, "key string, result string")


def selection_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    grid = arrays.vectors(spark, sf_dir)["embedding"].grid
    some = {"box": Box((10, 4), (50, 16)), "points": Points(2, ((0, 1), (0, 1), (5, 5))), "part of a block": SubBlock(3, 10, 20), "whole": Whole(), "block": Block(3)}
    return spark.createDataFrame([(n, reading.size_of(s, grid)) for n, s in some.items()], "selection string, size long")


def dimension_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = []
    for start, count in (("-4 10", "-1,-40"), ("0", "5"), ("2x3", "1;1"), ("", "")):
        box = slicing.listing_box(start, count, (100, 64))
        rows.append((start, count, ",".join(map(str, box.start)), ",".join(map(str, box.count))))
    return spark.createDataFrame(rows, "start string, count string, starts string, counts string")


def stats_not_finite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks with NaN and infinities, and blocks of nothing else."""
    cells = arrays.events(spark, sf_dir)["value"].cells
    odd = F.when((F.col("c0") % 5 == 0) | (F.col("block") == 3), float("nan")).when(F.col("c0") % 7 == 0, float("inf")).otherwise(F.col("value"))
    out = stats.fold(stats.block_stats(cells.withColumn("value", odd)), ["step", "block"])
    return out.withColumns({c: F.round(c, 6) for c in ("avg", "std_dev")})


def _written(spark: SparkSession, sf_dir: str) -> tuple[str, str]:
    path = folder(spark)
    arrays.events(spark, sf_dir)["value"].cells.repartition(4, "step").write.parquet(path)
    return path, "step int, block int, off long, c0 long, value double"


def cursor_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forward one step at a time, then to the newest, then the end; a writer that goes on isn't ready instead."""
    path, _ = _written(spark, sf_dir)
    cursor, waiting, rows = streaming.Cursor(spark, path), streaming.Cursor(spark, path, ended=lambda: False), []
    for visit, last in enumerate((False, False, False, True)):
        step = cursor.advance(last)
        rows.append((visit, step, cursor.cells().count(), 0))
    waiting.advance(last=True)
    for c in (cursor, waiting):
        try:
            c.advance()
        except (EndOfStream, StepNotReady) as error:
            rows.append((len(rows), -1, 0, error.code))
    return spark.createDataFrame(rows, "visit int, step int, cells long, code int")


def _followed(spark: SparkSession, sf_dir: str, mode: str) -> DataFrame:
    path, schema = _written(spark, sf_dir)
    kept = folder(spark)
    streaming.follow(streaming.source(spark, path, schema), lambda df, s: df.withColumn("told", F.lit(s)).write.mode("append").parquet(kept), folder(spark), mode)
    return spark.read.parquet(kept)


def follow_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _followed(spark, sf_dir, "latest")


def follow_available(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _followed(spark, sf_dir, "available").groupBy("step", "told").agg(F.count("c0").alias("n"))


def follow_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _followed(spark, sf_dir, "all").groupBy("step", "told").agg(F.count("c0").alias("n"))


def _meshed(spark: SparkSession, sf_dir: str) -> tuple[Dataset, Dataset]:
    """A dataset that names a mesh's kind and dimensions, and another that says the rest."""
    ds, other = arrays.orders(spark, sf_dir), Dataset(spark)
    ds.attribute("/mesh_schema/m/type", "uniform", "string")
    for key, values in (("dimensions", (4, 3)), ("origins", (0.5, 1.0))):
        ds.attribute(f"/mesh_schema/m/{key}-num", len(values), "integer")
        for i, v in enumerate(values):
            ds.attribute(f"/mesh_schema/m/{key}{i}", v)
    mesh.define(other, mesh.Mesh("m", "uniform", {"dimensions": [4, 3], "spacings": [0.25, 2.0]}))
    mesh.put_on(ds, "price", "m", "cell")
    return ds, other


def mesh_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    ds, other = _meshed(spark, sf_dir)
    found = mesh.read(ds, "m", other)
    rows = [(found.name, found.kind, k, ",".join(map(str, v))) for k, v in found.properties.items()]
    return spark.createDataFrame([*rows, (mesh.mesh_of(ds, "price")[0], "", "centering of price", mesh.mesh_of(ds, "price")[1])], "mesh string, kind string, property string, value string")


def mesh_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coordinates of a uniform mesh's points."""
    ds, other = _meshed(spark, sf_dir)
    return mesh.points(spark, mesh.read(ds, "m", other))


def _rows(names: str, *rows: str) -> str:
    return f"SELECT * FROM (VALUES {', '.join(rows)}) t({names})"


_ALIASES = [
    ("byte", 1, ("byte", "char", "integer*1")), ("short", 2, ("short", "integer*2")), ("integer", 4, ("integer", "int", "integer*4")), ("long", 8, ("long", "long long", "integer*8")),
    ("unsigned byte", 1, ("unsigned byte", "unsigned char", "unsigned integer*1")), ("unsigned short", 2, ("unsigned short", "unsigned integer*2")), ("unsigned integer", 4, ("unsigned integer", "unsigned int", "unsigned integer*4")),
    ("unsigned long", 8, ("unsigned long", "unsigned integer*8")), ("real", 4, ("real", "real*4", "float")), ("double", 8, ("double", "real*8", "long float")), ("long double", 16, ("long double", "real*16")), ("string", 4, ("string",)),
    ("complex", 8, ("complex", "complex*8")), ("double complex", 16, ("double complex", "complex*16")), ("string array", 0, ("string array",)),
]
_ODD = ", o AS (SELECT step, block, CASE WHEN c0 % 5 = 0 OR block = 3 THEN NULL WHEN c0 % 7 = 0 THEN NULL ELSE value END AS v FROM events_cells) "

REGISTERED = {
    attribute_listing: _rows('name, "type", nelems, "values"', "('price/unit', 'string', 1, 'EUR')", "('price/limits', 'long', 2, '1;2')", "('price/limits/note', 'string', 1, 'soft')", "('title', 'string array', 2, 'a;b')", "('ref', 'string', 1, 'price')"),
    variable_attributes: _rows("name, nelems", "('price/unit', 1)", "('price/limits', 2)"),
    group_view: _rows('"group", name, ndim, nsteps, transform', "('parts', 'parts/price', 1, 1, 'none')", "('parts', 'parts/size', 1, 1, 'none')"),
    group_names: _rows("name", "('orders')", "('parts')"),
    found_under_a_name: _rows("kind, name", "('variable', 'price')", "('attribute', 'EUR')", "('inside', 'parts/price')", "('inside', 'parts/size')"),
    definitions_dropped: "SELECT 'price' AS name, '{' || (SELECT max(c0) + 1 FROM orders_cells) || '}' AS shape UNION ALL SELECT 'parts/price', '{' || (SELECT max(c0) + 1 FROM parts_cells) || '}'",
    type_table: _rows("alias, name, size", *(f"('{a}', '{n}', {s})" for n, s, names in _ALIASES for a in names)),
    parsed_values: "SELECT CAST(5 AS BIGINT) AS cut, CAST(-12 AS BIGINT) AS signed, CAST(1000 AS DOUBLE) AS real, CAST(18446744073709551615 AS DECIMAL(20, 0)) AS large",
    operator_names: _rows("text, sign", "('LT', '<')", "('lteq', '<=')", "('GT', '>')", "('GE', '>=')", "('EQ', '=')", "('==', '=')", "('NE', '!=')", "('<=', '<=')"),
    condition_text: "SELECT '(((price < 7.5) and (price > 1)) or (customer = 3))' AS condition",
    error_codes: _rows(
        "refused, code", "('boxes of other shapes', -7)", "('a box and points', -7)", "('an operator', -7)", "('a constant', -7)", "('a name', -5)", "('a type', -5)", "('a step', -13)", "('a box outside', -15)",
        "('a box and a block', -7)", "('blocks of two numberings', -7)", "('statistics of text', -7)", "('a mesh without dimensions', -5)",
    ),
    slice_errors: _rows(
        "key, result", "('(20,)', 'ValueError')", "('(slice(5, 2, None),)', 'ValueError')", "('(slice(0, 4, 0),)', 'ValueError')", "('([1, 99],)', 'ValueError')", "('([0, 1], [0, 1])', 'TypeError')", "('(0, 0, 0)', 'ValueError')",
        "('(slice(-3, None, None), 1)', '3x1')",
    ),
    selection_sizes: "SELECT * FROM (VALUES ('box', CAST(800 AS BIGINT)), ('points', 3), ('part of a block', 20), ('block', NULL)) t(selection, size) UNION ALL SELECT 'whole', (max(c0) + 1) * 64 FROM vectors_cells",
    dimension_text: _rows('start, "count", starts, counts', "('-4 10', '-1,-40', '96,10', '4,15')", "('0', '5', '0,0', '5,64')", "('2x3', '1;1', '2,3', '1,1')", "('', '', '0,0', '100,64')"),
    stats_not_finite: _ODD + "SELECT step, block, min(v) AS min, max(v) AS max, coalesce(round(avg(v), 6), 0) AS avg, coalesce(round(stddev_pop(v), 6), 0) AS std_dev, count(v) AS cnt FROM o GROUP BY step, block",
    cursor_steps: ", n AS (SELECT step, count(*) AS n, row_number() OVER (ORDER BY step) - 1 AS k, max(step) OVER () AS most FROM events_cells GROUP BY step) SELECT CAST(CASE WHEN step = most THEN 3 ELSE k END AS INTEGER) AS visit, step, n AS cells, 0 AS code FROM n WHERE k < 3 OR step = most UNION ALL SELECT 4, -1, 0, -21 UNION ALL SELECT 5, -1, 0, -22",
    follow_latest: "SELECT *, step AS told FROM events_cells WHERE step = (SELECT max(step) FROM events_cells)",
    follow_available: "SELECT step, -1 AS told, count(c0) AS n FROM events_cells GROUP BY step",
    follow_all: "SELECT step, step AS told, count(c0) AS n FROM events_cells GROUP BY step",
    mesh_listing: _rows("mesh, kind, property, value", "('m', 'uniform', 'dimensions', '4,3')", "('m', 'uniform', 'origins', '0.5,1.0')", "('m', 'uniform', 'spacings', '0.25,2.0')", "('m', '', 'centering of price', 'cell')"),
    mesh_points: "SELECT i * 3 + j AS at, CAST(0.5 + i * 0.25 AS DOUBLE) AS x0, CAST(1 + j * 2 AS DOUBLE) AS x1 FROM (SELECT CAST(unnest(range(0, 4)) AS BIGINT) AS i), (SELECT CAST(unnest(range(0, 3)) AS BIGINT) AS j)",
}
