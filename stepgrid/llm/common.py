"""Shared helpers of the text operators: table access, bounded batches and span hashing."""

from __future__ import annotations

import contextlib
import ctypes
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Most UTF-8 bytes of text that one vectorised step holds at once (a longer single text is a step of its own).
STEP_BYTES = 1 << 18
#: Texts of an Arrow batch, and rows of one that are Python objects at a time.
BATCH = SLICE = 1024
#: Rows of a partition, about, where a table turns out to be small.
ROWS = 50_000
#: A key of more than 1 / HEAVY of all rows, and of more than FEW, is heavy; at any size there are fewer than HEAVY of those.
HEAVY, FEW = 10_000, 1000
#: 64-bit words of a sieve at most (32 MiB), and bits that a key gets below that.
SIEVE_WORDS, SIEVE_BITS = 1 << 22, 12


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table ``name`` of the data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: Column) -> Column:
    """True where crc32 of the id as text leaves remainder 0 modulo 5 (a null id counts as the empty text)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def materialise(df: DataFrame, rows: int | None = None, each: int = ROWS) -> DataFrame:
    """Cut the lineage through the shared checkpoint folder; set one only where the session has none (tests). A table
    known to have at most so many rows is read back ``sized``."""
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(folder or os.path.join(os.environ.get("TMPDIR", "/tmp"), "checkpoints"))
    done = df.checkpoint(eager=True)
    return done if rows is None else sized(done, rows, each)


def keyed(id_col: str, text_col: str) -> list[Column]:
    """Two hashes that rows of equal id and text share."""
    both = [F.col(id_col).cast("string"), F.col(text_col).cast("string")]
    return [F.xxhash64(*both).alias("key"), F.xxhash64(F.lit(7), *both).alias("key2")]


def sized(df: DataFrame, rows: int, each: int = ROWS) -> DataFrame:
    """A stored table known to have at most so many rows, in no more partitions than these need. Many small stages
    otherwise write as many files as there are shuffle partitions, each of next to nothing."""
    return df.coalesce(max(1, -(-rows // each)))


def attach(rows: DataFrame, values: DataFrame, key: str, total: int) -> DataFrame:
    """``rows`` joined with ``values``, a materialised table of one row a key, whose ``size`` is the key's rows out of
    ``total``. Heavy keys, fewer than ``HEAVY``, are joined by broadcast where their rows lie; a shuffle joins the others,
    none of which fills a task."""
    limit = max(total // HEAVY, FEW)
    heavy = values.filter(F.col("size") > limit)
    if heavy.isEmpty():
        return rows.join(values.hint("merge"), key)
    light = rows.join(F.broadcast(heavy.select(key)), key, "left_anti").join(values.filter(F.col("size") <= limit).hint("merge"), key)
    return light.unionByName(rows.join(F.broadcast(heavy), key))


class Sieve:
    """A test that passes every key of ``keys`` and few others: a Bloom filter of four bits a key in one 64-bit word. A
    key is a long whose bits are well mixed, as those of a hash. The filter's size is bounded, so beyond some 20 million
    keys it passes more and more values; what it passes must be joined exactly."""

    def __init__(self, keys: DataFrame, key: str):
        self.number, self.words = keys.count(), 64
        while self.words < SIEVE_WORDS and self.words * 64 < SIEVE_BITS * self.number:
            self.words *= 2
        k = F.col(key)
        bits = [F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(k, s).bitwiseAND(F.lit(63)).cast("int")) for s in (40, 46, 52, 58)]
        mask = bits[0].bitwiseOR(bits[1]).bitwiseOR(bits[2]).bitwiseOR(bits[3])
        held = keys.select(k.bitwiseAND(F.lit(self.words - 1)).alias("word"), mask.alias("mask")).groupBy("word").agg(F.bit_or("mask").alias("mask")).toArrow()
        table_ = np.zeros(self.words, np.uint64)
        table_[held["word"].to_numpy()] = held["mask"].to_numpy().view(np.uint64)
        self.sent = keys.sparkSession.sparkContext.broadcast(table_)

    def test(self, keys: np.ndarray) -> np.ndarray:
        k, one, six = keys.view(np.uint64), np.uint64(1), np.uint64(63)
        mask = one << (k >> np.uint64(40) & six) | one << (k >> np.uint64(46) & six) | one << (k >> np.uint64(52) & six) | one << (k >> np.uint64(58))
        return self.sent.value[(k & np.uint64(self.words - 1)).astype(np.int64)] & mask == mask

    def passes(self, key: Column) -> Column:
        """Whether a key passes."""

        @F.arrow_udf("boolean")
        def passed(keys: pa.Array) -> pa.Array:
            return pa.array(self.test(keys.to_numpy(zero_copy_only=False)))

        return passed(key)

    def passing(self, keys: Column) -> Column:
        """The keys of an array that pass. Not deterministic for Spark, which else runs it once more in each filter on its
        result, in Python workers of its own."""

        @F.arrow_udf("array<long>")
        def kept(lists: pa.Array) -> pa.Array:
            values = lists.flatten().to_numpy(zero_copy_only=False)
            good = self.test(values)
            upto = np.concatenate(([0], np.cumsum(good)))
            offsets = np.asarray(lists.offsets)
            return pa.ListArray.from_arrays(pa.array(upto[offsets - offsets[0]], pa.int32()), pa.array(values[good]))

        return kept.asNondeterministic()(keys)


def in_batches(texts: DataFrame) -> DataFrame:
    """``texts``, whose session sends them to Python workers in batches of at most ``BATCH`` rows: the usual 10,000 texts
    of some KB fill a worker and as much memory beside the executor's heap."""
    conf, key = texts.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(key)) <= BATCH:
        conf.set(key, str(BATCH))
    return texts


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches cut so that few rows become Python objects at once."""
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE):
            yield batch.slice(at, SLICE)


def steps(texts: list[str | None], limit: int = STEP_BYTES, rows: int | None = None) -> Iterator[tuple[int, list[bytes]]]:
    """Cut a batch into runs of at most ``limit`` bytes (and ``rows`` texts): (index of the first, the texts as UTF-8;
    null is empty)."""
    first, run, held = 0, [], 0
    for i, t in enumerate(texts):
        b = t.encode("utf-8", "surrogatepass") if t else b""
        if run and (held + len(b) > limit or len(run) == rows):
            yield first, run
            first, run, held = i, [], 0
        run.append(b)
        held += len(b)
    if run:
        yield first, run


def give_back() -> None:
    """Return the memory that a task has freed to the system: its worker lives on and would keep it."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries have no such call
        ctypes.CDLL(None).malloc_trim(0)


def mix64(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit values so that every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_RADIX = 0x9E3779B97F4A7C15 | 1
_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
_BYTES = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS[0]) < n:
        size = max(n, 2 * STEP_BYTES)
        for k, base in enumerate((_RADIX, pow(_RADIX, -1, 1 << 64))):
            steps_ = np.full(size, base, np.uint64)
            steps_[0] = 1
            _POWERS[k] = np.cumprod(steps_, dtype=np.uint64)
    return _POWERS[0][:n], _POWERS[1][:n]


class Spans:
    """Hashes of any byte span of a buffer in constant time each, from one prefix sum modulo 2**64."""

    def __init__(self, data: np.ndarray):
        up, self._down = _powers(len(data) + 1)
        self._sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_BYTES[data] * up[: len(data)], out=self._sums[1:])

    def hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix64((self._sums[end] - self._sums[start]) * self._down[start] + (end - start).astype(np.uint64))


def words_of(data: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of bytes that ``is_word`` (a table of 256 booleans) accepts."""
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = is_word[data]
    edge = np.diff(inside)
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def sum_vectors(parts: DataFrame) -> DataFrame:
    """Add up (key string, vec binary of float64) rows by key; each task has pre-summed its rows to one per key."""
    def run(batches):
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for k, v in zip(batch.column(0).to_pylist(), batch.column(1)):
                v = np.frombuffer(v.as_buffer(), np.float64)
                sums[k] = sums[k] + v if k in sums else v.copy()
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums)), pa.array([v.tobytes() for v in sums.values()], pa.binary())], names=["key", "vec"])

    return parts.repartition("key").mapInArrow(run, "key string, vec binary")
