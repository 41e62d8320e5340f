"""Small arrays with results known by hand: queries by position, blocks, points, joined arrays, slices, statistics."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from stepgrid.functions.masks import glob_to_regex
from stepgrid.functions.types import EndOfStream, InvalidName, InvalidQuery, InvalidStep, OutOfBounds, StepNotReady, operator_of, type_size, value_type
from stepgrid.operators import query as q
from stepgrid.operators import reading, slicing, stats, steps
from stepgrid.operators.selection import Block, Box, Points, SubBlock, intersect
from stepgrid.sources import mesh
from stepgrid.sources.dataset import Dataset, Grid, joined
from stepgrid.streaming import steps as streaming

# A table of atoms, seven columns as the second dimension.
ATOMS = [
    (0, 0, 97, 15, 8, 0, 7), (1, 0, 96, 16, 5, -1, 7), (2, 1, 32, 1, 7, 1, 7), (3, 2, 200, 8, 6, 0, 7), (4, 0, 94, 14, 1, 3, 5),
    (5, 0, 96, 13, 2, 4, 5), (6, 2, 201, 2, 3, 3, 5), (7, 1, 37, 9, 4, 2, 5), (8, 0, 98, 15, 5, 1, 5), (9, 0, 99, 14, 6, 2, 5),
]


@pytest.fixture(scope="module")
def atoms(spark):
    rows = [(0, 0, 7 * i + j, i, j, float(v)) for i, row in enumerate(ATOMS) for j, v in enumerate(row)]
    cells = spark.createDataFrame(rows, "step int, block int, off long, c0 long, c1 long, value double")
    return Dataset(spark).define("A", cells, (10, 7))


@pytest.fixture(scope="module")
def vars3(spark):
    base = [40, 60, 80, 80, 90, 30]
    rows = []
    for r in range(1, 6):
        for c in range(1, 7):
            rows.append((0, 0, 6 * (r - 1) + c - 1, r - 1, c - 1, r + c / 10, base[c - 1] + r + c / 10, [41, 45, 49, 54, 55][r - 1] + c / 10))
    cells = spark.createDataFrame(rows, "step int, block int, off long, c0 long, c1 long, T double, P double, V double")
    ds, grid = Dataset(spark), Grid(cells, (5, 6))
    for n in "TPV":
        ds.define(n, cells, (5, 6), n, grid=grid)
    return ds


def rows(df, *names):
    return sorted(tuple(r) for r in df.select(*names).collect())


def test_two_variables_in_a_box(vars3):
    box = Box((0, 0), (5, 6))
    p, v, t = vars3["P"], vars3["V"], vars3["T"]
    tree = (q.Leaf(p, ">", "80.0", box) & q.Leaf(p, "<", "90.0", box)) & q.Leaf(v, "<=", "50.0", box)
    assert str(tree) == "(((P > 80.0) and (P < 90.0)) and (V <= 50.0))"
    got = [(i, j, round(a, 1), round(b, 1), round(c, 1)) for i, j, a, b, c in rows(q.where(tree, p, v, t), "c0", "c1", "P", "V", "T")]
    assert got == [(0, 2, 81.3, 41.3, 1.3), (0, 3, 81.4, 41.4, 1.4), (1, 2, 82.3, 45.3, 2.3), (1, 3, 82.4, 45.4, 2.4), (2, 2, 83.3, 49.3, 3.3), (2, 3, 83.4, 49.4, 3.4)]
    one = stats.fold(stats.block_stats(p.cells)).first()
    assert (round(one["min"], 1), round(one["max"], 1), round(one["avg"], 4), round(one["std_dev"], 4)) == (31.6, 95.5, 66.6833, 22.1717)


def test_columns_align_by_position(atoms):
    leaf = lambda c, op, v: q.Leaf(atoms, op, v, Box((0, c), (10, 1)))
    got = q.where(leaf(1, "=", "0") & leaf(2, "<=", "96"), atoms, out=Box((0, 3), (10, 1)))
    assert rows(got, "c0", "c1", "A") == [(1, 3, 16.0), (4, 3, 14.0), (5, 3, 13.0)]
    either = q.evaluate(leaf(1, "=", "2") | leaf(2, "<", "33"), Box((0, 0), (10, 1)))
    assert rows(either, "c0", "c1") == [(2, 0), (3, 0), (6, 0)]


def test_table_statistics(atoms):
    one = stats.fold(stats.block_stats(atoms.cells)).first()
    assert (one["min"], one["max"], round(one["avg"], 4), round(one["std_dev"], 4)) == (-1.0, 201.0, 18.9714, 40.7168)


def test_combinations_need_equal_shapes(atoms):
    with pytest.raises(InvalidQuery):
        q.Leaf(atoms, "=", "0", Box((0, 1), (10, 1))) & q.Leaf(atoms, "=", "0", Box((0, 1), (9, 1)))
    with pytest.raises(InvalidQuery):
        q.Leaf(atoms, "=", "0", Box((0, 1), (10, 1))) & q.Leaf(atoms, "=", "0", Block(0))
    with pytest.raises(InvalidQuery):
        q.Leaf(atoms, "~", "0")
    with pytest.raises(OutOfBounds):
        reading.read(atoms, Box((5, 0), (6, 7)))
    with pytest.raises(InvalidStep):
        reading.read(atoms, None, 0, 2)


@pytest.fixture(scope="module")
def blocks(spark):
    """Two steps of two by two blocks of 5 x 5; value = step + 1 + row + column."""
    cells = [(s, 2 * (i // 5) + j // 5, (i % 5) * 5 + j % 5, i, j, float(s + 1 + i + j)) for s in range(2) for i in range(10) for j in range(10)]
    df = spark.createDataFrame(cells, "step int, block int, off long, c0 long, c1 long, value double")
    return Dataset(spark).define("data", df, (10, 10), nsteps=2)


def test_candidate_blocks(blocks):
    tree = q.Leaf(blocks, ">=", "11.0") & q.Leaf(blocks, "<=", "21.0")
    assert rows(q.blocks(tree), "step", "block", "abs_block") == [(0, 1, 1), (0, 2, 2), (0, 3, 3), (1, 1, 5), (1, 2, 6), (1, 3, 7)]
    inside = Box((0, 0), (5, 10))
    tree = q.Leaf(blocks, ">=", "11.0", inside) | q.Leaf(blocks, "<", "0", inside)
    assert rows(q.blocks(tree, 0, 1), "block") == [(1,)]
    hits = {r.block for r in reading.read(blocks, None, 0, 1).filter("value = 11").collect()}
    assert hits <= {r.block for r in q.blocks(q.Leaf(blocks, "=", "11"), 0, 1).collect()}
    assert q.estimate(tree, 0, 1).first().cells == 25


def test_points_keep_order_and_duplicates(blocks):
    got = reading.read(blocks, Points(2, ((9, 9), (0, 3), (9, 9))), 1, 1)
    assert rows(got, "pid", "value") == [(0, 20.0), (1, 5.0), (2, 20.0)]
    assert rows(reading.read(blocks, Points(1, (0, 7), Box((2, 2), (3, 3))), 0, 1), "pid", "c0", "c1") == [(0, 2, 2), (1, 4, 3)]
    assert rows(reading.read(blocks, Points(1, (24,), Block(3)), 0, 1), "pid", "c0", "c1") == [(0, 9, 9)]
    assert rows(reading.read(blocks, Points(2, ((1, 1),), Block(3)), 0, 2), "step", "c0", "c1") == [(0, 6, 6), (1, 6, 6)]
    assert rows(reading.read(blocks, Block(6, absolute=True)), "step", "block")[0] == (1, 2)
    assert len(rows(reading.read(blocks, SubBlock(1, 20, 5), 0, 1), "off")) == 5


def test_intersections():
    assert intersect(Box((0, 0), (5, 5)), Box((3, 4), (5, 5))) == Box((3, 4), (2, 1))
    assert intersect(Box((0,), (5,)), Box((5,), (5,))) is None
    for pair in ((Box((0,), (2,)), Points(1, (0, 5, 1))), (Points(1, (0, 5, 1)), Box((0,), (2,)))):
        assert intersect(*pair).points == ((0,), (1,))
    assert intersect(SubBlock(1, 0, 10), SubBlock(1, 8, 10)) == SubBlock(1, 8, 2)
    assert intersect(Block(1), Block(2)) is None
    with pytest.raises(InvalidQuery):
        intersect(Box((0,), (2,)), Block(1))


def test_nan_and_infinity(spark):
    values = [1.0, math.nan, math.inf, 3.0, None]
    df = spark.createDataFrame([(0, 0, i, i, v) for i, v in enumerate(values)], "step int, block int, off long, c0 long, value double")
    full, minmax = stats.block_stats(df).first(), stats.block_stats(df, full=False).first()
    assert (full.cnt, full.vmin, full.vmax, full.vsum, full.vsumsq) == (2, 1.0, 3.0, 4.0, 10.0)
    assert (minmax.cnt, minmax.vmax, minmax.vsum) == (3, math.inf, None)
    v = Dataset(spark).define("x", df, (5,))
    assert rows(q.evaluate(q.Leaf(v, ">", "2")), "c0") == [(2,), (3,)]
    assert rows(q.evaluate(q.Leaf(v, "!=", "1")), "c0") == [(1,), (2,), (3,)]
    none = stats.fold(stats.block_stats(df.filter("c0 = 1")), ["step"]).first()
    assert (none["avg"], none["std_dev"]) == (0.0, 0.0)
    assert stats.fold(stats.block_stats(df.filter("c0 = 1"))).first()["avg"] is None


def test_whole_number_predicates_read_text_up_to_the_point(spark):
    df = spark.createDataFrame([(0, 0, i, i, i) for i in range(8)], "step int, block int, off long, c0 long, value int")
    v = Dataset(spark).define("n", df, (8,))
    assert rows(q.evaluate(q.Leaf(v, ">", "5.7")), "c0") == [(6,), (7,)]


def test_histogram_bins(spark):
    df = spark.createDataFrame([(float(v),) for v in (-1, 0, 5, 10, 15, 20)], "value double")
    assert [r.freq for r in stats.histogram(df, stats.breaks_of([0, 10, 20])).orderBy("bin").collect()] == [1, 2, 2, 1]
    assert stats.breaks_of(low=0, high=10, count=4) == [0, 2.5, 5, 7.5, 10]
    for bad in ({"breaks": [1, 1]}, {"low": 3, "high": 2, "count": 1}, {"low": 0, "high": 2, "count": 0}):
        with pytest.raises(InvalidQuery):
            stats.breaks_of(**bad)


def test_joined_array(spark):
    cells = [(0, b, i, i, 10 * b + i) for b, n in enumerate((3, 5, 7)) for i in range(n)]
    grid = Grid(spark.createDataFrame(cells, "step int, block int, off long, c0 long, value int"), (0,), 1, False)
    assert rows(joined(grid).cells, "c0", "value") == [(i, v) for i, v in enumerate([0, 1, 2, *range(10, 15), *range(20, 27)])]


def test_slices():
    assert [(a.start, a.stop, a.drop) for a in slicing.axes((Ellipsis, -1), (4, 5, 6))] == [(0, 4, False), (0, 5, False), (5, 6, True)]
    assert slicing.axes([True, False, True], (3,))[0].picked == (0, 2)
    assert slicing.listing_box("-3", "-2", (10,)) == Box((7,), (2,))
    for key, error in ((slice(0, 3, -1), ValueError), (slice(5, 2), ValueError), (10, ValueError), (([0], [1]), TypeError)):
        with pytest.raises(error):
            slicing.axes(key, (10, 10) if isinstance(key, tuple) else (10,))


def test_types_and_masks():
    assert value_type("unsigned long").spark == "decimal(20,0)" and value_type("real*8").name == "double"
    assert type_size(value_type("string"), "abc") == 4 and operator_of("GTEQ") == ">="
    with pytest.raises(InvalidName):
        value_type("quaternion")
    assert glob_to_regex("a*/[!b]?") == "a[^/]*/[^b][^/]"


def test_save_open_append(spark, blocks, tmp_path):
    ds = Dataset(spark)
    ds.define("data", blocks.cells, (10, 10), nsteps=2, group="g")
    ds.attribute("data/unit", "K")
    ds.save(str(tmp_path / "ds"))
    back = Dataset.open(spark, str(tmp_path / "ds"))
    assert rows(back["data"].cells, "step", "c0", "c1", "value") == rows(blocks.cells, "step", "c0", "c1", "value")
    assert [a.values for a in back.attributes_of("/data")] == [("K",)] and back.groups() == ["g"]
    ds.save(str(tmp_path / "ds"), mode="append", step_offset=2)
    assert steps.span(Dataset.open(spark, str(tmp_path / "ds"))["data"].cells).first().nsteps == 4
    with pytest.raises(InvalidName):
        back.variable("nothing")


def test_compare_and_reblock(spark, blocks):
    changed = blocks.cells.withColumn("value", F.when((F.col("c0") == 3) & (F.col("c1") == 4), F.col("value") + 1).otherwise(F.col("value")))
    assert steps.compare(blocks.cells, changed, ["step", "c0", "c1"], 1.0).count() == 0
    assert rows(steps.compare(blocks.cells, changed, ["step", "c0", "c1"], 0.5), "step", "kind") == [(0, "value"), (1, "value")]
    merged = steps.reblock(blocks.cells, 2)
    assert rows(merged.groupBy("step", "block").agg(F.count("off").alias("n"), F.max("off").alias("m")), "step", "block", "n", "m") == [(0, 0, 50, 49), (0, 1, 50, 49), (1, 0, 50, 49), (1, 1, 50, 49)]


def test_stream_follows_steps(spark, tmp_path):
    source, schema = str(tmp_path / "in"), "step int, c0 long, value double"
    for s in range(3):
        spark.createDataFrame([(s, i, float(s * 10 + i)) for i in range(4)], schema).coalesce(1).write.mode("append").parquet(source)
    seen = []
    streaming.follow(streaming.source(spark, source, schema, files=1), lambda df, s: seen.append((s, df.count())), str(tmp_path / "log"))
    assert sorted(seen) == [(0, 4), (1, 4), (2, 4)]
    cursor = streaming.Cursor(spark, source, ended=lambda: True)
    assert [cursor.advance(), cursor.advance(last=True)] == [0, 2] and cursor.cells().count() == 4
    with pytest.raises(EndOfStream):
        cursor.advance()
    waiting = streaming.Cursor(spark, source, ended=lambda: False)
    waiting.advance(last=True)
    with pytest.raises(StepNotReady):
        waiting.advance()


def test_meshes(spark):
    ds = Dataset(spark)
    ds.define("T", spark.createDataFrame([(0, 0, 0, 0, 1.0)], "step int, block int, off long, c0 long, value double"), (1,))
    mesh.define(ds, mesh.Mesh("m", "uniform", {"dimensions": [10, 20]}))
    mesh.put_on(ds, "T", "m")
    assert mesh.names(ds) == ["m"] and mesh.read(ds, "m").properties == {"dimensions": [10, 20]} and mesh.mesh_of(ds, "T") == ("m", "point")
    with pytest.raises(InvalidName):
        mesh.Mesh("bad", "uniform")
    ds.attribute("/mesh_schema/part/type", "rectilinear")
    other = Dataset(spark)
    mesh.define(other, mesh.Mesh("part", "rectilinear", {"dimensions": [3, 4], "coordinates": ["x", "y"]}))
    assert mesh.read(ds, "part", other) == mesh.read(other, "part")
    bad = (("structured", {"dimensions": [2]}), ("rectilinear", {"dimensions": [2, 3, 4], "coordinates": ["x", "y"]}), ("unstructured", {"points": ["p"]}), ("uniform", {"dimensions": [1] * 10}))
    for kind, properties in (*bad, ("uniform", {"dimensions": [11], "origins": [0.0], "spacings": [0.3], "maximums": [1.0]})):
        with pytest.raises(InvalidName):
            mesh.Mesh("bad", kind, properties)
    assert mesh.Mesh("good", "uniform", {"dimensions": [11], "spacings": [0.5], "maximums": [5.0]}).kind == "uniform"


def test_stored_blocks(spark, blocks, tmp_path):
    """Blocks and their statistics come from the stored table, in which updates and appended steps take part."""
    path = str(tmp_path / "ds")
    ds = Dataset(spark)
    ds.define("data", blocks.cells, (10, 10), nsteps=2)
    ds.save(path)
    one = Dataset(spark)
    one.define("data", blocks.cells.filter("step = 1").withColumns({"step": F.lit(0), "value": F.col("value") * 10}), (10, 10))
    one.save(path, mode="update")
    one.save(path, mode="append")
    back = Dataset.open(spark, path)["data"]
    assert back.grid.nsteps == 3
    found = q.blocks(q.Leaf(back, ">", "150"))
    assert rows(found, "step", "block", "abs_block") == [(1, 3, 7), (2, 3, 11)] and "grid=" not in found._jdf.queryExecution().executedPlan().toString()
    want = stats.fold(stats.block_stats(back.cells), ["step"])
    assert rows(stats.fold(stats.stored_stats(back), ["step"]), *want.columns) == rows(want, *want.columns)
    with pytest.raises(InvalidQuery):
        stats.stored_stats(blocks)
    with pytest.raises(InvalidStep):
        ds.save(path, mode="append", step_offset=1)
    with pytest.raises(InvalidStep):
        ds.save(path, mode="update")
    wrong = Dataset(spark)
    wrong.define("data", blocks.cells, (10, 11), nsteps=2)
    with pytest.raises(InvalidQuery):
        wrong.save(path, mode="append")
    wrong.define("more", blocks.cells, (10, 10), nsteps=2)
    with pytest.raises(InvalidName):
        wrong.save(path, mode="append")


def test_blocks_meet_blocks(blocks):
    assert reading.shared(blocks.grid, Block(2), Block(6, absolute=True)) == Block(6, absolute=True)
    assert reading.shared(blocks.grid, SubBlock(6, 3, 9, True), SubBlock(2, 5, 20)) == SubBlock(6, 5, 7, True)
    assert reading.shared(blocks.grid, Block(1), Block(6, absolute=True)) is None and reading.shared(blocks.grid, Block(1), Block(9, absolute=True)) is None
    assert reading.shared(blocks.grid, Block(1), SubBlock(1, 0, 2)) == SubBlock(1, 0, 2)
    assert rows(reading.read(blocks, SubBlock(6, 3, 2, True)), "step", "block", "off") == [(1, 2, 3), (1, 2, 4)]
    with pytest.raises(InvalidQuery):
        intersect(Block(1), Block(1, absolute=True))


def test_batches_cover_all_results(blocks):
    tree = q.Leaf(blocks, ">=", "11.0", Box((0, 0), (5, 10))) & q.Leaf(blocks, "<=", "30.0", Box((5, 0), (5, 10)))
    whole = rows(q.evaluate(tree, first=0, count=2), "step", "c0", "c1")
    got = [r for k in range(len(whole) // 4 + 1) for r in rows(q.batch(tree, 4, k, 0, 2), "step", "c0", "c1")]
    assert sorted(got) == whole and len(whole) > 8
    row = q.status(q.evaluate(tree, first=0, count=2), 4, len(whole) // 4).first()
    assert (row.results, row.follow, row.last) == (len(whole), 0, True)
    assert rows(q.block_batch(q.Leaf(blocks, ">", "0"), 3, 2), "step", "block", "place") == [(1, 2, 6), (1, 3, 7)]
    with pytest.raises(InvalidQuery):
        q.matching(tree, blocks.cells)


def test_texts_have_no_statistics(spark):
    df = spark.createDataFrame([(0, 0, 0, 0, "7")], "step int, block int, off long, c0 long, value string")
    with pytest.raises(InvalidQuery):
        stats.block_stats(df)
