"""Operator 4, mixing sources to target weights.

The words of each source form one sequence, its documents in order of a hash bucket and then of id, cut into blocks of ``BLOCK`` words. Source weights give
targets in words, and these the number of blocks that each source gives to the mix. Every output shard draws its source
counts from a multinomial over what the sources still owe, a source's slots run through a pseudorandom permutation of
its block indexes (a new one for each pass), and the blocks are joined by index.

Defined results: a null text has size 0; a null source is a source of its own, last in order; documents of size 0 are
never taken; a null or repeated id orders after its size and rows of equal id and size may swap, which changes no
column of the result; the same input and seed give the same mix; an empty table gives no rows; a very long text is many
blocks of its source; other columns, of whatever name, stay as they are. One row a source comes to the driver: more than
``SOURCES`` sources are an error.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import keyed, materialise, mix64

WORD = r"[^\x20\x09-\x0D]+"
#: Words of a block; blocks of an output shard at least; output shards at most (shards grow beyond that).
BLOCK, SHARD, SHARDS = 64, 8192, 10_000
#: Documents of a bucket of the two-level running sum, about; most sources.
BUCKET, SOURCES = 4000, 100_000
#: Columns of what each output shard takes of each source.
COUNTS = ("shard", "src", "first", "n")


def size(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: list[int], weights: list[float], share: float = 1.5, most: float = 2.0) -> list[float]:
    """Words wanted of each source: ``share`` of all words by weight, none above ``most`` times its size, the excess
    shared again by weight until none is above."""
    out, total = [0.0] * len(sizes), share * sum(sizes)
    open_ = [i for i, n in enumerate(sizes) if n]
    while open_ and total > 0:
        weight = sum(weights[i] for i in open_)
        over = [i for i in open_ if total * weights[i] / weight > most * sizes[i]]
        if not over:
            for i in open_:
                out[i] = total * weights[i] / weight
            break
        for i in over:
            out[i] = most * sizes[i]
        total -= sum(out[i] for i in over)
        open_ = [i for i in open_ if i not in set(over)]
    return out


def draw(slots: list[int], seed: int) -> pa.Table:
    """shard, src, first, n: how many blocks each output shard takes of each source, and the first of its slots."""
    left, rng, shard, rows = np.array(slots, np.int64), np.random.default_rng(seed), 0, []
    each = max(SHARD, -(-int(left.sum()) // SHARDS))
    given = np.zeros(len(left), np.int64)
    while total := int(left.sum()):
        n = np.minimum(rng.multinomial(min(each, total), left / total), left)
        for s in np.flatnonzero(n).tolist():
            rows.append((shard, s, int(given[s]), int(n[s])))
        given += n
        left -= n
        shard += 1
    return pa.table(dict(zip(COUNTS, np.array(rows, np.int64).reshape(-1, len(COUNTS)).T)))


def permute(index: np.ndarray, n: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Image of each index below n under the pseudorandom permutation of [0, n) that the key names: a Feistel network
    over an even number of bits, walked until it falls below n."""
    half = ((np.ceil(np.log2(np.maximum(n, 2))) + 1).astype(np.uint64) >> np.uint64(1)).clip(1)
    mask = (np.uint64(1) << half) - np.uint64(1)
    out, todo = index.astype(np.uint64), np.arange(len(index))
    while len(todo):
        h, m, k = half[todo], mask[todo], key[todo].astype(np.uint64)
        left, right = out[todo] >> h, out[todo] & m
        for r in range(4):
            left, right = right, left ^ (mix64(mix64(k + np.uint64(r + 1)) + right) & m)
        out[todo] = left << h | right
        todo = todo[out[todo] >= n[todo]]
    return out.astype(np.int64)


@dataclass
class Mix:
    """``docs``: key, key2, doc_id, size, source_size, target, src, start; ``slots``: shard, slot, src, pass, block."""

    docs: DataFrame
    slots: DataFrame

    def pieces(self) -> DataFrame:
        """The spans of words that the mix takes: key, key2, start, pass, from, to (in words of the document)."""
        block = lambda at: F.floor(at / F.lit(BLOCK)).cast("long")
        cut = self.docs.filter("size > 0").select("key", "key2", "start", "size", "src", F.explode(F.sequence(block(F.col("start")), block(F.col("start") + F.col("size") - 1))).alias("block"))
        # The slots grow with the input and their plan has no size to choose by: they are never broadcast.
        took = cut.join(self.slots.select("src", "block", "pass").hint("merge"), ["src", "block"])
        low = F.greatest(F.col("block") * BLOCK - F.col("start"), F.lit(0))
        return took.select("key", "key2", "start", "pass", low.alias("from"), F.least((F.col("block") + 1) * BLOCK - F.col("start"), F.col("size")).alias("to"))


def mix(docs: DataFrame, seed: int = 1, weights: tuple[float, ...] = (5, 2, 1), id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> Mix:
    """Choose the blocks of the mix. ``weights`` repeat over the sources in order of code points, null last."""
    spark = docs.sparkSession
    text = F.col(text_col).cast("string")
    sized = materialise(docs.select(*keyed(id_col, text_col), F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), size(text).alias("size")))
    # One row a source comes to the driver.
    found = sized.groupBy("source").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("docs")).limit(SOURCES + 1).collect()
    if len(found) > SOURCES:
        raise ValueError(f"more than {SOURCES} sources")
    found.sort(key=lambda r: (r.source is None, r.source or ""))
    sizes = [r["size"] for r in found]
    wanted = targets(sizes, [weights[i % len(weights)] for i in range(len(found))])
    blocks = [-(-n // BLOCK) for n in sizes]
    slots = [min(round(t / n * b), 2 * b) if n else 0 for t, n, b in zip(wanted, sizes, blocks)]
    # Arrow tables: lists of rows would start Python workers of a second kind, which stay beside the others.
    known = pa.table(
        {
            "source": pa.array([r.source for r in found], pa.string()),
            "src": pa.array(range(len(found)), pa.int32()),
            "source_size": pa.array(sizes, pa.int64()),
            "target": pa.array(wanted, pa.float64()),
            "blocks": pa.array(blocks, pa.int64()),
            "buckets": pa.array([-(-r.docs // BUCKET) for r in found], pa.int64()),
        }
    )
    known = spark.createDataFrame(known)

    # Running sums in two levels, so that a large source is many windows.
    rows = sized.join(known.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source"))).drop("_source", "source").withColumn("bucket", F.pmod(F.xxhash64("key", "key2"), F.col("buckets")))
    sums = rows.groupBy("src", "bucket").agg(F.sum("size").alias("n"))
    before = sums.select("src", "bucket", (F.sum("n").over(Window.partitionBy("src").orderBy("bucket")) - F.col("n")).alias("before"))
    inside = F.sum("size").over(Window.partitionBy("src", "bucket").orderBy(F.col("doc_id").asc_nulls_last(), "size", "key", "key2").rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")
    placed = rows.withColumn("_inside", inside).join(before, ["src", "bucket"]).withColumn("start", F.col("before") + F.col("_inside"))
    placed = placed.select("key", "key2", "doc_id", "size", "source_size", "target", "src", "start")

    drawn = draw(slots, seed)
    counts = spark.createDataFrame(drawn)
    number = np.array(blocks, np.int64)

    def chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                for at in range(0, row["n"], 1 << 16):
                    slot = row["first"] + np.arange(at, min(row["n"], at + (1 << 16)))
                    n = number[row["src"]]
                    turn = slot // n
                    block = permute(slot % n, np.full(len(slot), n), turn * 1_000_003 + row["src"] * 8191 + seed)
                    fill = lambda v: np.full(len(slot), v)  # noqa: B023, E731
                    yield pa.RecordBatch.from_arrays([pa.array(fill(row["shard"])), pa.array(slot), pa.array(fill(row["src"]), pa.int32()), pa.array(turn, pa.int32()), pa.array(block)], names=["shard", "slot", "src", "pass", "block"])

    spread = counts.repartition(max(1, min(len(drawn) // 32, 4096)), "shard", "src")
    return Mix(placed, spread.mapInArrow(chosen, "shard long, slot long, src int, pass int, block long"))


def taken(mixed: Mix) -> DataFrame:
    """doc_id, size, source_size, target and taken (words that the mix takes, repeats counted) of every document."""
    words = mixed.pieces().groupBy("key", "key2", "start").agg(F.sum(F.col("to") - F.col("from")).alias("taken"))
    return mixed.docs.join(words, ["key", "key2", "start"], "left").select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def mixed_documents(docs: DataFrame, mixed: Mix, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` as the mix takes them: one row for each pass over a document, its text cut to the words taken (a text
    taken whole stays as it is). Equal rows count once."""
    pieces = mixed.pieces().groupBy("key", "key2", "start", "pass").agg(F.array_sort(F.collect_list(F.struct("from", "to"))).alias("_cut"))
    one = pieces.groupBy("key", "key2", "pass").agg(F.min_by("_cut", "start").alias("cut"))
    text = F.col(text_col).cast("string")
    joined = docs.select(F.struct("*").alias("row"), text.alias("text"), *keyed(id_col, text_col)).join(one, ["key", "key2"])
    total = F.aggregate("cut", F.lit(0).cast("long"), lambda a, x: a + x["to"] - x["from"])
    words = F.when(total < size(F.col("text")), F.regexp_extract_all("text", F.lit(WORD), F.lit(0)))
    part = F.array_join(F.transform("cut", lambda x: F.array_join(F.slice("words", (x["from"] + 1).cast("int"), (x["to"] - x["from"]).cast("int")), " ")), "\n")
    new = F.when(F.col("words").isNull(), F.col("text")).otherwise(part)
    return joined.withColumn("words", words).select(F.col("row").withField(text_col, new).alias("row")).select("row.*")
