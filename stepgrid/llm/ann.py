"""Operator 1, approximate nearest neighbours by multiprobe p-stable hashing.

A table hashes a unit vector by ``m`` Gaussian projections, each cut into cells of one width at a random offset. A
query visits, in every table, its own bucket and then perturbed ones in the order of their estimated success (the sets
of single steps of least expected squared distance to the cells' borders). Buckets lie in partitions; a query goes once
to each partition that holds buckets it visits, merges there the candidates of all tables, and keeps the nearest by
exact cosine. Large buckets are split over partitions, and their queries go to every part.

``m`` grows with the logarithm of the number of vectors, so that a table has about as many cells as vectors; how many
buckets are visited follows from a bounded sample of queries, whose true neighbours are found by brute force: the least
number that finds ``RECALL`` of them. Queries that find fewer than k visit ``PROBES`` buckets a table in a second round;
those still short are compared with all rows, block by block. ``examined`` says how many rows a query was compared with (a row that it meets in two partitions counts
twice): a share of all that falls as the table grows, slowly where neighbours are hardly nearer than other rows are.

Defined results: vectors that are null, zero, of another length than the commonest (of equally common ones that of the
smallest id), or that hold null or non-finite
components take no part; a vector's own id is no candidate; ties go to the smaller id; equal ids count as one vector;
fewer candidates give fewer rows; an empty table gives no rows.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, mix64

NEAREST = 5
#: Tables, and the width of a cell (a unit vector's projection has deviation 1).
TABLES, WIDTH = 6, 3.0
#: Vectors a cell, about; most projections of a table; most buckets visited in it; recall that the sample must reach.
OCCUPANCY, MOST, PROBES, RECALL = 1, 24, 2048, 0.95
#: Sample queries; bytes of a partition's vectors, about; rows of a bucket before it is split, at least; split buckets at
#: most.
SAMPLE, PART, SPLIT, SPLITS = 128, 1 << 25, 8192, 100_000
#: Queries, about, that one pass of the exact search compares with all rows.
BLOCK = 2048


def template(m: int, count: int) -> np.ndarray:
    """The ``count`` sets of steps of least expected score, as booleans over the 2m single steps in order of distance;
    the first set is empty."""
    j = np.arange(1, 2 * m + 1)
    back = 2 * m + 1 - j
    z = np.where(j <= m, j * (j + 1) / (4 * (m + 1) * (m + 2)), 1 - back / (m + 1) + back * (back + 1) / (4 * (m + 1) * (m + 2)))
    out, heap = [()], [(z[0], (0,))]
    while heap and len(out) < count:
        score, chosen = heapq.heappop(heap)
        if not any(2 * m - 1 - k in chosen for k in chosen):
            out.append(chosen)
        last = chosen[-1]
        if last + 1 < 2 * m:
            heapq.heappush(heap, (score - z[last] + z[last + 1], (*chosen[:-1], last + 1)))
            heapq.heappush(heap, (score + z[last + 1], (*chosen, last + 1)))
    sets = np.zeros((len(out), 2 * m), bool)
    for i, chosen in enumerate(out):
        sets[i, list(chosen)] = True
    return sets


@dataclass
class Hashes:
    """``TABLES`` hash functions of ``m`` projections for vectors of ``dim`` components."""

    dim: int
    m: int
    seed: int = 1

    def __post_init__(self):
        rng = np.random.default_rng(self.seed)
        self.projections = rng.normal(size=(self.dim, TABLES * self.m))
        self.offsets = rng.uniform(0, WIDTH, TABLES * self.m)

    def cells(self, unit: np.ndarray) -> np.ndarray:
        return (unit @ self.projections + self.offsets).reshape(len(unit), TABLES, self.m) / WIDTH

    def keys(self, cell: np.ndarray) -> np.ndarray:
        """64-bit names of buckets: cells of shape (..., table, m)."""
        h = np.broadcast_to(np.arange(1, TABLES + 1, dtype=np.uint64), cell.shape[:-1]).copy()
        for k in range(self.m):
            h = mix64(h + cell[..., k].astype(np.int64).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        return h

    def own(self, unit: np.ndarray) -> np.ndarray:
        return self.keys(np.floor(self.cells(unit)))

    def probes(self, unit: np.ndarray, sets: np.ndarray) -> np.ndarray:
        """Names of the buckets that each vector visits, in order: (vectors, tables, probes)."""
        f = self.cells(unit)
        low = np.floor(f)
        away = np.concatenate([f - low, 1 - (f - low)], -1)
        order = np.argsort(away, -1, kind="stable")
        rank = np.argsort(order, -1, kind="stable")
        stepped = sets[:, rank].transpose(1, 2, 0, 3)  # vectors, tables, probes, 2m
        cell = low[:, :, None, :] - stepped[..., : self.m] + stepped[..., self.m :]
        return self.keys(cell.swapaxes(1, 2)).swapaxes(1, 2)


def unit(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.sqrt((vectors * vectors).sum(1))[:, None]


def cosines(vectors: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Cosine of a vector with each row; equal rows get equal values wherever they stand."""
    return (vectors * query).sum(1) / (np.sqrt((vectors * vectors).sum(1)) * np.sqrt((query * query).sum()))


def nearest(ids: np.ndarray, vectors: np.ndarray, own: int, query: np.ndarray, k: int, repeated: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Ids and scores of the k nearest; with ``repeated``, ids may occur in several rows and count once."""
    score = cosines(vectors, query)
    score[ids == own] = -np.inf
    if repeated:
        order = np.lexsort((ids, -score))
        some = order[np.sort(np.unique(ids[order], return_index=True)[1])]
    elif len(score) > 4 * k:
        some = np.flatnonzero(score >= np.partition(score, len(score) - k)[len(score) - k])
    else:
        some = np.arange(len(score))
    some = some[np.lexsort((ids[some], -score[some]))][:k]
    some = some[np.isfinite(score[some])]
    return ids[some], score[some]


def usable(v: Column) -> Column:
    return v.isNotNull() & (F.size(v) > 0) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0)


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return np.asarray(column.flatten(), np.float64).reshape(-1, dim)


HITS = ["query_id", "vec_id", "score", "examined"]
HIT = "query_id long, vec_id long, score double, examined long"


def _hits(rows: list[tuple[int, np.ndarray, np.ndarray, int]]) -> pa.RecordBatch:
    """Hits of queries; the first of each carries how many rows the query was compared with."""
    q = np.concatenate([np.full(len(i), q) for q, i, _, _ in rows]) if rows else np.zeros(0)
    i, s = (np.concatenate(x) if rows else np.zeros(0) for x in (([r[1] for r in rows]), ([r[2] for r in rows])))
    n = np.concatenate([np.where(np.arange(len(r[1])) == 0, r[3], 0) for r in rows]) if rows else np.zeros(0)
    return pa.RecordBatch.from_arrays([pa.array(q.astype(np.int64)), pa.array(i.astype(np.int64)), pa.array(s.astype(np.float64)), pa.array(n.astype(np.int64))], names=["query_id", "vec_id", "score", "examined"])


def near(ids: np.ndarray, vectors: np.ndarray, units: np.ndarray, some: np.ndarray, own: int, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """``nearest`` among the rows ``some``: single-precision cosines (of ``units``) first leave out what can't be among
    the k nearest."""
    rough = units[some] @ (query / np.sqrt((query * query).sum())).astype(np.float32)
    if len(some) > 4 * k + 4:
        # The query itself may stand first; single precision is off by less than 1e-5 for these dot products.
        rough[ids[some] == own] = -2
        some = some[rough >= np.partition(rough, len(rough) - k)[len(rough) - k] - 1e-4]
    return nearest(ids[some], vectors[some].astype(np.float64), own, query, k)


def _grouped(keys: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The different (row, key) pairs by row and partition: (row, partition, where each group's keys start, the keys)."""
    row, key = keys
    part = key % np.uint64(parts)
    order = np.lexsort((key, part, row))
    row, part, key = row[order], part[order], key[order]
    if len(row):
        new = np.concatenate(([True], (row[1:] != row[:-1]) | (key[1:] != key[:-1])))
        row, part, key = row[new], part[new], key[new]
    first = np.flatnonzero(np.concatenate((np.ones(min(1, len(row)), bool), (row[1:] != row[:-1]) | (part[1:] != part[:-1]))))
    return row[first], part[first].astype(np.int64), np.append(first, len(row)), key


class _Part:
    """The vectors of a partition by bucket, filled batch by batch."""

    def __init__(self):
        self.blocks: list[tuple] = []
        self.ids = None

    def add(self, ids: np.ndarray, vectors: np.ndarray, counts: np.ndarray, keys: np.ndarray) -> None:
        self.blocks.append((ids, vectors, counts, keys))

    def close(self) -> None:
        ids, vectors, counts, keys = map(np.concatenate, zip(*self.blocks))
        order = np.argsort(keys, kind="stable")
        self.row = np.repeat(np.arange(len(ids)), counts)[order]
        self.key, self.start = np.unique(keys[order], return_index=True)
        self.start = np.append(self.start, len(order))
        self.ids, self.vectors, self.units = ids, vectors, unit(vectors.astype(np.float64)).astype(np.float32)
        self.blocks = []

    def members(self, keys: np.ndarray) -> np.ndarray:
        """Rows of the buckets, each once."""
        at = np.searchsorted(self.key, keys)
        at = at[(at < len(self.key)) & (self.key[np.minimum(at, len(self.key) - 1)] == keys)]
        lo, n = self.start[at], self.start[at + 1] - self.start[at]
        seen = np.zeros(len(self.ids), bool)
        seen[self.row[np.arange(n.sum()) + np.repeat(lo - (np.cumsum(n) - n), n)]] = True
        return np.flatnonzero(seen)


def best(hits: DataFrame, k: int) -> DataFrame:
    """The k nearest of each query with their rank, and how many rows the query was compared with in all."""
    once = hits.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"), F.sum("examined").alias("examined"))
    each = Window.partitionBy("query_id")
    ranked = once.withColumns({"rank": F.row_number().over(each.orderBy(F.col("score").desc(), "vec_id")), "examined": F.sum("examined").over(each)})
    return ranked.filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score", "examined")


def brute_force(vectors: DataFrame, queries: list[tuple[int, list[float]]], k: int) -> DataFrame:
    """The true neighbours of a few queries among (vec_id, v) rows."""
    dim = len(queries[0][1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, m = np.asarray(batch.column(0)), _matrix(batch.column(1), dim)
            repeated = len(np.unique(ids)) < len(ids)
            for at in range(0, len(queries), 256):
                yield _hits([(q, *nearest(ids, m, q, np.array(v), k, repeated), len(ids)) for q, v in queries[at : at + 256]])

    return best(vectors.mapInArrow(run, HIT), k)


def search(vectors: DataFrame, is_query: Column, id_col: str = "vec_id", vector_col: str = "embedding", k: int = NEAREST) -> DataFrame:
    """query_id, rank, vec_id, score, examined: the k nearest found of every row for which ``is_query`` (over the id as ``vec_id``)
    holds, among all other rows."""
    spark = vectors.sparkSession
    held = np.float32 if dict(vectors.dtypes)[vector_col] == "array<float>" else np.float64
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v")).filter(F.col("vec_id").isNotNull() & usable(F.col("v")))
    lengths = rows.groupBy(F.size("v").alias("dim")).agg(F.count(F.lit(1)).alias("n"), F.min("vec_id").alias("id"))
    first = lengths.orderBy(F.col("n").desc(), "id", "dim").first()
    if first is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double, examined long")
    dim, n = first["dim"], first["n"]
    rows = rows.filter(F.size("v") == dim)

    # How many projections and probes: the sample's neighbours must be in the buckets that it visits.
    sample = [(r.vec_id, r.v) for r in rows.filter(is_query).orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).collect()]
    if not sample:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double, examined long")
    true = brute_force(rows, sample, k)
    pairs = [(r.query_id, r.v) for r in true.select("query_id", "vec_id").join(rows, "vec_id").select("query_id", "v").collect()]
    place = {q: i for i, (q, _) in enumerate(sample)}
    q = unit(np.array([v for _, v in sample]))
    most = max(2, round(math.log2(max(2.0, n / OCCUPANCY))))
    for m in range(min(most, MOST), 0, -1):
        hashes, sets = Hashes(dim, m), template(m, PROBES)
        if not pairs:
            break
        visited = np.concatenate([hashes.probes(q[i : i + 4], sets) for i in range(0, len(q), 4)])
        goal = hashes.own(unit(np.array([v for _, v in pairs])))
        found = (visited[place[i]] == g[:, None] for (i, _), g in zip(pairs, goal))
        rank = np.array([np.where(f.any(1), f.argmax(1), len(sets)).min() for f in found])
        enough = int(np.sort(rank)[min(len(rank) - 1, math.ceil(RECALL * len(rank)) - 1)]) + 1
        if enough <= len(sets):
            sets = sets[:enough]
            break
    all_sets = template(m, PROBES)

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = hashes.own(unit(_matrix(batch.column(0), dim))).ravel().astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(own)], names=["key"])

    split = max(SPLIT, n * TABLES // SPLITS)
    large = rows.select("v").mapInArrow(keys, "key long").groupBy("key").count().filter(F.col("count") > split).collect()
    hot = np.array(sorted((r["key"] & (1 << 64) - 1, -(-r["count"] // split)) for r in large), np.uint64).reshape(-1, 2)
    parts = max(1, n * TABLES * dim * 8 // PART)

    def salts(key: np.ndarray) -> np.ndarray:
        """Into how many each bucket is split."""
        if not len(hot):
            return np.ones(len(key), np.int64)
        at = np.minimum(np.searchsorted(hot[:, 0], key), len(hot) - 1)
        return np.where(hot[at, 0] == key, hot[at, 1], 1).astype(np.int64)

    def salted(key: np.ndarray, salt: np.ndarray) -> np.ndarray:
        return np.where(salt > 0, mix64(key + salt.astype(np.uint64)), key)

    names = ["part", "kind", "id", "v", "keys"]

    def placing(sets: np.ndarray):
        def sent(kind: int, ids: np.ndarray, m: np.ndarray, row: np.ndarray, key: np.ndarray) -> pa.RecordBatch:
            row, part, start, key = _grouped((row, key), parts)
            v = pa.array([x.tobytes() for x in m.astype(held)], pa.binary()).take(pa.array(row))
            lists = pa.ListArray.from_arrays(pa.array(start, pa.int32()), pa.array(key.astype(np.int64)))
            return pa.RecordBatch.from_arrays([pa.array(part), pa.array(np.full(len(row), kind), pa.int32()), pa.array(ids[row]), v, lists], names=names)

        def place_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, batch.num_rows, 256):
                    piece = batch.slice(at, 256)
                    ids, m = np.asarray(piece.column(0)), _matrix(piece.column(1), dim)
                    u = unit(m)
                    row, key = np.repeat(np.arange(len(ids)), TABLES), hashes.own(u).ravel()
                    salt = (mix64(ids.astype(np.uint64))[row] % salts(key).astype(np.uint64)).astype(np.int64)
                    yield sent(0, ids, m, row, salted(key, salt))
                    asked = np.flatnonzero(np.asarray(piece.column(2)))
                    for i in range(0, len(asked), 4):
                        some = asked[i : i + 4]
                        key = hashes.probes(u[some], sets).ravel()
                        times = salts(key)
                        row = np.repeat(np.repeat(some, TABLES * len(sets)), times)
                        salt = np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times)
                        yield sent(1, ids, m, row, salted(np.repeat(key, times), salt))

        return place_all

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, index, out = None, _Part(), []
        for batch in batches:
            part, kind, ids = (np.asarray(batch.column(i)) for i in range(3))
            v = np.frombuffer(b"".join(batch.column(3).to_pylist()), held).reshape(-1, dim)
            start = np.asarray(batch.column(4).offsets)
            keys_ = np.asarray(batch.column(4).values).view(np.uint64)
            change = np.flatnonzero((part[1:] != part[:-1]) | (kind[1:] != kind[:-1])) + 1
            for a, b in zip([0, *change.tolist()], [*change.tolist(), len(part)]):
                if part[a] != now:
                    now, index = part[a], _Part()
                if kind[a] == 0:
                    index.add(ids[a:b], v[a:b], np.diff(start[a : b + 1]), keys_[start[a] : start[b]])
                    continue
                if index.ids is None and index.blocks:
                    index.close()
                if index.ids is None:
                    continue
                for i in range(a, b):
                    some = index.members(keys_[start[i] : start[i + 1]])
                    if len(some):
                        out.append((ids[i], *near(index.ids, index.vectors, index.units, some, ids[i], v[i].astype(np.float64), k), len(some)))
                    if len(out) >= 512:
                        yield _hits(out)
                        out = []
        if out:
            yield _hits(out)

    def found(asked: DataFrame, sets: np.ndarray) -> DataFrame:
        placed = asked.mapInArrow(placing(sets), "part long, kind int, id long, v binary, keys array<long>")
        return placed.repartition("part").sortWithinPartitions("part", "kind").mapInArrow(look, HIT)

    def short(hits: DataFrame) -> DataFrame:
        """Ids of the queries with fewer than k hits."""
        counts = hits.groupBy("query_id").count().filter(F.col("count") >= k).select(F.col("query_id").alias("vec_id"))
        return rows.filter(is_query).select("vec_id").distinct().join(counts, "vec_id", "left_anti")

    hits = materialise(best(found(rows.select("vec_id", "v", is_query.alias("asked")), sets), k))
    few = materialise(short(hits))
    if few.isEmpty():
        return hits
    if len(sets) < len(all_sets):
        again = rows.join(few.withColumn("asked", F.lit(True)), "vec_id", "left").select("vec_id", "v", F.coalesce("asked", F.lit(False)).alias("asked"))
        hits = materialise(best(hits.select(HITS).unionByName(found(again, all_sets)), k))
        few = materialise(short(hits))
    blocks = -(-few.count() // BLOCK)
    whole = rows.join(few, "vec_id", "left_semi").withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(max(1, blocks))))
    for i in range(blocks):
        queries = [(r.vec_id, r.v) for r in whole.filter(F.col("block") == i).collect()]
        if queries:
            exact = materialise(brute_force(rows, queries, k))
            hits = hits.select(HITS).unionByName(exact.select(HITS))
    return best(hits, k) if blocks else hits
