"""What the operators of the pipeline leave with the Python workers of an executor."""

from __future__ import annotations

import subprocess
import sys
from pathlib import Path

import pyarrow as pa
import pyarrow.compute
from pyspark.sql import functions as F

from stepgrid.llm import langid, mixing
from stepgrid.llm.common import Sieve


def test_a_sieve_of_arrays_runs_once(spark):
    """A filter on what passes is no second Python node, which has a worker of its own in each task."""
    nodes = spark.range(1000).select("id", F.array(F.xxhash64("id"), F.xxhash64(F.col("id") + 5)).alias("paths"))
    keys = spark.range(10).select(F.xxhash64("id").alias("path"))
    out = nodes.withColumn("paths", Sieve(keys, "path").passing(F.col("paths"))).filter(F.size("paths") > 0)
    assert out._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
    assert set(range(10)) <= {r.id for r in out.collect()}


def test_mixing_starts_no_workers_of_another_kind(spark, odd):
    """Rows from the driver come as Arrow tables, not through pickling workers beside the Arrow ones."""
    mixed = mixing.mix(odd)
    for df in (mixed.docs, mixed.slots):
        assert "PythonRDD" not in df._jdf.queryExecution().toRdd().toDebugString()


def test_drawn_blocks():
    drawn = mixing.draw([5000, 0, 20_000], 1)
    assert isinstance(drawn, pa.Table) and drawn.column_names == list(mixing.COUNTS)
    assert [int(drawn.filter(pa.compute.equal(drawn["src"], s))["n"].to_numpy().sum()) for s in range(3)] == [5000, 0, 20_000]
    empty = mixing.draw([0, 0], 1)
    assert empty.num_rows == 0 and set(empty.schema.types) == {pa.int64()}


def test_workers_of_the_pipeline_load_no_pandas(spark, odd, monkeypatch):
    code = "import sys; from stepgrid.llm import bpe, langid, mixing, ngram_join, secrets; sys.exit('pandas' in sys.modules)"
    assert subprocess.run([sys.executable, "-c", code], cwd=Path(__file__).parents[2]).returncode == 0
    monkeypatch.setattr("pyspark.sql.GroupedData.applyInPandas", None)
    assert langid.train(odd).langs


def test_an_encoding_task_gives_its_memory_back(tmp_path):
    """Resident memory after many pieces is near that before them."""
    code = f"""
import os, sys
sys.path.insert(0, {str(Path(__file__).parents[2])!r})
from pathlib import Path
from stepgrid.llm import bpe, common
held = lambda: int(Path("/proc/self/statm").read_text().split()[1]) * os.sysconf("SC_PAGE_SIZE") / 1e6
first = held()
kept = {{str(i): b"%d" % i * 200 for i in range(100_000)}}
full, last = held(), [kept.pop(str(i)) for i in range(99_990, 100_000)]
kept.clear()
bpe.forget()
sys.exit(not held() - first < 0.3 * (full - first))
"""
    assert subprocess.run([sys.executable, "-c", code], cwd=tmp_path).returncode == 0
