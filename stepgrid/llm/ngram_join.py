"""Operator 8, n-gram Jaccard self-join by chosen paths.

Documents are sets of five-word shingles. In each of ``RUNS`` independent runs a set extends its path by every shingle
whose hash under that path falls below 1 / (threshold * size of the set), one on average and a little more; two sets of
Jaccard similarity s share an extension with probability 1 - exp(-s / threshold) or more. Sets of one path are a
bucket. Small buckets are compared pair by pair, after a 64-function min-hash sketch; large ones are split again by
longer paths, until they are small, most of their members resemble one of them, or the path is at its longest: then all
members are linked to that one. Every candidate component is compared by brute force on the whole sets, block against
block, so links and their numbers are exact within what the runs have found.

Recall: a pair at the threshold shares one extension a level on average at least, so a path of length ``DEEPEST`` with
probability ``survival()`` a run; there are as many runs as keep the chance of missing it in all of them under ``MISS``.

Shuffles, and no broadcast of what grows with the input: only paths that occur twice leave their node, and only texts that are compared leave their file (each behind
a ``Sieve``). Paths, hubs of components and classes that hold many rows are joined by ``attach``, not in one task.

Defined results: words are runs of anything but ASCII white space, as they are; a text of fewer than five words is one
shingle; a null text is the empty text; texts without words link to nothing, but equal ones share a class as all equal
texts do; a class takes its smallest id (null only if all are); ties and repeated rows change nothing; each row of the
input gives one row.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ROWS, Sieve, Spans, attach, in_batches, materialise, mix64, sized, slices, steps, words_of

SHINGLE, THRESHOLD = 5, 0.8
#: Members of a bucket that is compared pair by pair; path length after which what is left of a bucket counts as one
#: candidate group; chance that a pair at the threshold is missed, at most.
SMALL, DEEPEST, MISS = 32, 4, 0.001


def survival(depth: int = DEEPEST) -> float:
    """Chance that a pair with one shared extension a level, on average, shares a path of this length."""
    q = 1.0
    for _ in range(depth):
        q = 1 - math.exp(-q)
    return q


#: Independent runs.
RUNS = math.ceil(math.log(MISS) / math.log(1 - survival()))
#: Min-hash functions of a sketch, two bits each, and equal ones that a pair at the threshold falls below once in 10^4.
FUNCTIONS, AGREE = 64, 43
#: Share of a large bucket (of a path longer than one) that resembles its first member before the bucket counts as one
#: candidate group.
DENSE = 0.5
#: Documents of a block of the exact comparison; shingles hashed at once under their paths (one more set, at most).
BLOCK, HASHED = 512, 1 << 18

_SPACE = np.ones(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = False
_MULTIPLY = (mix64(np.arange(1, FUNCTIONS + 1, dtype=np.uint64)) | np.uint64(1)).astype(np.uint32)
_ADD = mix64(np.arange(1001, FUNCTIONS + 1001, dtype=np.uint64)).astype(np.uint32)
ROOTS = mix64(np.arange(77, 77 + RUNS, dtype=np.uint64))
_LOW = np.uint64((1 << 48) - 1)


def shingle_sets(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(48-bit hashes of the distinct shingles of each text, sorted, one text after the other; where each starts, and the
    end). At most 65,000 texts."""
    raw = b"\n".join(texts)
    ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)
    data = np.frombuffer(raw, np.uint8)
    start, end = words_of(data, _SPACE)
    row = np.searchsorted(ends, start, "right")
    word = Spans(data).hash(start, end)
    number = np.bincount(row, minlength=len(texts))
    first = np.cumsum(number) - number
    last_start = np.maximum(number - SHINGLE + 1, np.minimum(number, 1))
    at = np.arange(len(word)) - first[row]
    used = at < last_start[row]
    base = np.flatnonzero(used)
    h = np.zeros(len(base), np.uint64)
    for k in range(SHINGLE):
        there = np.minimum(base + k, len(word) - 1)
        within = row[there] == row[base]
        within &= base + k < len(word)
        h = mix64(h + np.where(within, word[there], np.uint64(k + 1)) * np.uint64(0x9E3779B97F4A7C15))
    key = np.sort(row[base].astype(np.uint64) << np.uint64(48) | h & _LOW)
    if len(key):
        key = key[np.concatenate(([True], key[1:] != key[:-1]))]
    starts = np.searchsorted(key, np.arange(len(texts) + 1, dtype=np.uint64) << np.uint64(48))
    return key & _LOW, starts


def sketches(sets: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Two 64-bit words of two-bit min-hashes for each (non-empty) set."""
    low = mix64(sets).astype(np.uint32)
    out = np.zeros((2, len(starts) - 1), np.uint64)
    for i in range(FUNCTIONS):
        least = np.minimum.reduceat(low * _MULTIPLY[i] + _ADD[i], starts[:-1])
        out[i // 32] |= (mix64(least.astype(np.uint64) + np.uint64(i)) & np.uint64(3)) << np.uint64(2 * (i % 32))
    return out.astype(np.int64)


def extend(sets: np.ndarray, starts: np.ndarray, row: np.ndarray, path: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Longer paths of (row, path) nodes: (index of the node, the new path)."""
    size = (starts[1:] - starts[:-1])[row]
    nodes, paths = [], []
    cuts = np.unique(np.searchsorted(np.cumsum(size), np.arange(0, size.sum() + HASHED, HASHED), "right"))
    for a, b in zip(cuts[:-1], cuts[1:]):
        n = size[a:b]
        node = np.repeat(np.arange(a, a + len(n)), n)
        at = np.arange(len(node)) - np.repeat(np.cumsum(n) - n, n) + starts[row[node]]
        z = mix64(sets[at] * np.uint64(0x9E3779B97F4A7C15) ^ path[node])
        chosen = z < (np.minimum(1.0, 1 / (THRESHOLD * np.maximum(n, 1))) * (2.0**64 - 2048)).astype(np.uint64)[node - a]
        nodes.append(node[chosen])
        paths.append(mix64(z[chosen] + np.uint64(1)))
    return np.concatenate(nodes) if nodes else np.zeros(0, int), np.concatenate(paths) if paths else np.zeros(0, np.uint64)


def _runs(texts: list[str | None]) -> Iterator[tuple[int, list[bytes]]]:
    for at, part in steps(texts):
        for k in range(0, len(part), 50_000):
            yield at + k, part[k : k + 50_000]


NODES = "v binary, n long, s1 long, s2 long, paths array<long>"


def _nodes(v: pa.Array, texts: list[str | None], roots: list[list[int]] | None) -> Iterator[pa.RecordBatch]:
    """Nodes of the texts that have words: extensions of the roots of each (the runs' own if None)."""
    for at, part in _runs(texts):
        sets, starts = shingle_sets(part)
        some = np.flatnonzero(starts[1:] > starts[:-1])
        if not len(some):
            continue
        starts = np.concatenate((starts[some], starts[-1:]))
        s1, s2 = sketches(sets, starts)
        if roots is None:
            row, path = np.repeat(np.arange(len(some)), RUNS), np.tile(ROOTS, len(some))
        else:
            own = [roots[at + i] for i in some.tolist()]
            row = np.repeat(np.arange(len(some)), [len(p) for p in own])
            path = np.array([p for ps in own for p in ps], np.int64).astype(np.uint64)
        node, new = extend(sets, starts, row, path)
        order = np.argsort(row[node], kind="stable")
        new = new[order].astype(np.int64)
        cut = np.searchsorted(row[node][order], np.arange(len(some) + 1))
        lists = pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(new))
        yield pa.RecordBatch.from_arrays([v.take(pa.array(at + some)), pa.array(np.diff(starts)), pa.array(s1), pa.array(s2), lists], names=["v", "n", "s1", "s2", "paths"])


def alike(a: str, b: str) -> Column:
    """Whether sketches and sizes allow the threshold."""
    c = lambda t, k: F.col(f"{t}.{k}")

    def differ(k: str) -> Column:
        x = c(a, k).bitwiseXOR(c(b, k))
        return F.bit_count(x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseAND(F.lit(0x5555555555555555)))

    size = F.least(c(a, "n"), c(b, "n")) >= THRESHOLD * F.greatest(c(a, "n"), c(b, "n"))
    return size & (differ("s1") + differ("s2") <= FUNCTIONS - AGREE)


def identity(text: Column) -> Column:
    """What equal texts, and only they, share."""
    return F.unhex(F.md5(F.coalesce(text, F.lit("")).cast("binary")))


def components(edges: DataFrame) -> DataFrame:
    """(v, label) of every end of an (a, b) edge: the least end of its connected component, by alternating large-star
    and small-star rounds."""

    def star(by: DataFrame) -> DataFrame:
        return by.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"), F.count(F.lit(1)).alias("size"))

    mark = lambda df: tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())
    now = materialise(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a != b").distinct())
    seen = mark(now)
    while seen[0]:
        now = sized(now, seen[0])
        both = now.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e")).select("e.a", "e.b")
        # A hub's many neighbours are larger than it: this join may be skewed, the next one has few rows a key.
        large = attach(both, materialise(star(both), 2 * seen[0]), "a", 2 * seen[0]).filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a != b")
        large = materialise(large, 2 * seen[0])
        small = large.join(star(large).hint("merge"), "a")
        small = small.select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e")).select("e.a", "e.b").filter("a != b").distinct()
        now = materialise(small, 2 * seen[0])
        if (got := mark(now)) == seen:
            break
        seen = got
    members, roots = now.groupBy("a").agg(F.min("b").alias("label")).withColumnRenamed("a", "v"), now.select(F.col("b").alias("v"), F.col("b").alias("label")).distinct()
    return members.unionByName(roots)


def candidates(nodes: DataFrame, texts_of) -> DataFrame:
    """(a, b) edges that connect all pairs which share a bucket and whose sketches agree. ``texts_of(v)`` gives the texts
    of a table of v."""
    edges: list[DataFrame] = []
    level, texts = 1, None
    while True:
        number, total = nodes.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("paths")), F.lit(0))).first()
        nodes = sized(nodes, number, ROWS // 8)
        counts = nodes.select(F.explode("paths").alias("path")).groupBy("path").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
        counts = materialise(counts, total)
        each = materialise(nodes.withColumn("paths", Sieve(counts, "path").passing(F.col("paths"))).filter(F.size("paths") > 0))
        shared = materialise(attach(each.select("v", "n", "s1", "s2", F.explode("paths").alias("path")), counts, "path", total), total)
        # A small bucket is one short list; its pairs are made and compared in place.
        members = shared.filter(F.col("size") <= SMALL).groupBy("path").agg(F.array_sort(F.collect_list(F.struct("v", "n", "s1", "s2"))).alias("all"))
        ahead = members.select("all", F.posexplode("all").alias("at", "x"))
        pairs = ahead.select("x", F.explode(F.slice("all", F.col("at") + 2, SMALL)).alias("y"))
        edges.append(pairs.filter(alike("x", "y")).select(F.col("x.v").alias("a"), F.col("y.v").alias("b")))
        hot = shared.filter(F.col("size") > SMALL).select("path", "size", F.struct("v", "n", "s1", "s2").alias("x"))
        if hot.isEmpty():
            break
        pivots = materialise(hot.groupBy("path").agg(F.min("x").alias("pivot"), F.first("size").alias("size")), total)
        hot = attach(hot.drop("size"), pivots, "path", total).select("path", "size", "x.v", F.col("pivot.v").alias("pivot"), alike("x", "pivot").alias("near"))
        hot = materialise(hot, total)
        edges.append(hot.filter("near").select(F.col("v").alias("a"), F.col("pivot").alias("b")))
        # A bucket without a better split is one candidate group, which the exact comparison takes apart block by block.
        whole = F.lit(True) if level >= DEEPEST else (F.col("like") >= DENSE * F.col("size")) & F.lit(level > 1)
        mixed = hot.groupBy("path").agg(F.count_if("near").alias("like"), F.first("size").alias("size")).filter(F.col("like") < F.col("size"))
        mixed = materialise(mixed.select("path", "size", whole.alias("whole")), total)
        rest = materialise(attach(hot.drop("size"), mixed, "path", total), total)
        edges.append(rest.filter("whole and not near").select(F.col("v").alias("a"), F.col("pivot").alias("b")))
        left = rest.filter("not whole")
        if left.isEmpty():
            break
        again = left.groupBy("v").agg(F.collect_list("path").alias("roots"))
        if texts is None:
            texts = texts_of(again.select("v"))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches):
                yield from _nodes(batch.column(0), batch.column(1).to_pylist(), batch.column(2).to_pylist())

        nodes = materialise(texts.join(again.hint("merge"), "v").select("v", "text", "roots").mapInArrow(run, NODES).withColumn("paths", F.array_distinct("paths")))
        level += 1
    out = edges[0]
    for e in edges[1:]:
        out = out.unionByName(e)
    return out


def overlaps(sets: list[np.ndarray], left: int) -> np.ndarray:
    """Shared shingles of each of the first ``left`` sets with every set."""
    size = np.fromiter(map(len, sets), np.int64, len(sets))
    token, at = np.unique(np.concatenate(sets), return_inverse=True)
    row = np.repeat(np.arange(len(sets)), size)
    number = np.bincount(at, minlength=len(token))
    kept = number > 1
    place = np.cumsum(kept) - 1
    some = kept[at]
    row, column = row[some], place[at[some]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    out = np.zeros((left, len(sets)), np.float32)
    width = 4096
    for a in range(0, int(kept.sum()), width):
        lo, hi = np.searchsorted(column, (a, a + width))
        part = np.zeros((len(sets), min(width, int(column[hi - 1]) - a + 1)), np.float32)
        part[row[lo:hi], column[lo:hi] - a] = 1
        out += part[:left] @ part.T
    return out


def _linked(v: list[bytes], side: np.ndarray, texts: list[str | None]) -> list[tuple[bytes, int, bytes]]:
    """(v, links, root) of the members of a pair of blocks (side 0 and 1), or of one block (all on side 0)."""
    order = np.argsort(side, kind="stable")
    v, left = [v[i] for i in order], int((side == 0).sum())
    sets = []
    for _, part in _runs([texts[i] for i in order]):
        flat, starts = shingle_sets(part)
        sets += [flat[a:b] for a, b in zip(starts[:-1], starts[1:])]
    size = np.fromiter(map(len, sets), np.float64, len(sets))
    shared = overlaps(sets, left).astype(np.float64)
    # THRESHOLD as the ratio 4 / 5, in whole numbers.
    linked = 5 * shared >= 4 * (size[:left, None] + size - shared)
    if left < len(v):
        linked[:, :left] = False
    else:
        np.fill_diagonal(linked, False)
    links = np.zeros(len(v), np.int64)
    links[:left] += linked.sum(1)
    if left < len(v):
        links[left:] += linked[:, left:].sum(0)
    # Each member takes the least root among its links until none changes (v is sorted on each side, not over both).
    rank = np.argsort(np.argsort(np.array(v, object), kind="stable"), kind="stable")
    root = rank.copy()
    while True:
        new = np.minimum(root[:left], np.where(linked, root, len(v)).min(1))
        other = np.minimum(root, np.where(linked, new[:, None], len(v)).min(0))
        other[:left] = np.minimum(other[:left], new)
        if (other == root).all():
            break
        root = other
    by_rank = np.argsort(rank)
    return [(v[i], int(links[i]), v[by_rank[root[i]]]) for i in range(len(v)) if links[i]]


def verify(labels: DataFrame, texts: DataFrame) -> DataFrame:
    """(v, links, root) rows: exact links of members of each candidate component, block against block, and where they
    hang together."""
    sizes = labels.groupBy("label").agg(F.count(F.lit(1)).alias("size")).withColumn("blocks", F.ceil(F.col("size") / BLOCK).cast("int"))
    placed = attach(labels, materialise(sizes), "label", labels.count()).withColumn("block", F.pmod(F.xxhash64("v"), F.col("blocks")).cast("int")).join(texts.hint("merge"), "v")
    paired = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = paired.select("label", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "v", (F.col("block") > F.col("other")).cast("int").alias("side"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(out: list) -> pa.RecordBatch:
            v, n, r = zip(*out)
            return pa.RecordBatch.from_arrays([pa.array(v, pa.binary()), pa.array(n, pa.int64()), pa.array(r, pa.binary())], names=["v", "links", "root"])

        key, held, out = None, [], []
        for batch in batches:
            for label, i, j, v, side, text in zip(*(c.to_pylist() for c in batch.columns)):
                if (label, i, j) != key:
                    if len(held) > 1:
                        out += _linked(*_columns(held))
                    key, held = (label, i, j), []
                held.append((v, side, text))
                if len(out) > 4096:
                    yield done(out)
                    out = []
        if len(held) > 1:
            out += _linked(*_columns(held))
        if out:
            yield done(out)

    return rows.repartition("label", "i", "j").sortWithinPartitions("label", "i", "j", "v").mapInArrow(run, "v binary, links long, root binary")


def _columns(held: list[tuple[bytes, int, str]]) -> tuple[list[bytes], np.ndarray, list[str]]:
    v, side, text = zip(*held)
    return list(v), np.array(side), list(text)


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(v, rep, copies, class_v, class_id, links) of every different text."""
    named = in_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), identity(F.col(text_col).cast("string")).alias("v"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            yield from _nodes(batch.column(0), batch.column(1).to_pylist(), None)

    nodes = named.select("v", "text").mapInArrow(run, NODES)
    nodes = materialise(nodes.groupBy("v").agg(*(F.first(c).alias(c) for c in ("n", "s1", "s2", "paths"))))

    def texts_of(wanted: DataFrame) -> DataFrame:
        wanted = materialise(wanted.distinct())
        some = Sieve(wanted.select(F.xxhash64("v").alias("key")), "key")
        found = named.filter(some.passes(F.xxhash64("v"))).groupBy("v").agg(F.first("text").alias("text"))
        return materialise(found.join(sized(wanted, some.number).hint("merge"), "v", "left_semi"), some.number, ROWS // 16)

    labels = materialise(components(candidates(nodes, texts_of)))
    labels = sized(labels, labels.count())
    links = materialise(verify(labels, texts_of(labels.select("v"))))
    number = links.groupBy("v").agg(F.sum("links").alias("links"))
    joined = components(links.select(F.col("v").alias("a"), F.col("root").alias("b")))
    ids = named.groupBy("v").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies"))
    known = materialise(ids.join(joined.hint("merge"), "v", "left").join(number.hint("merge"), "v", "left").select("v", "rep", "copies", F.coalesce("label", "v").alias("label"), F.coalesce("links", F.lit(0)).alias("links")))
    number = known.count()
    known = sized(known, number)
    best = known.groupBy("label").agg(F.min(F.struct(F.col("rep").isNull().alias("none"), "rep", "v")).alias("best"), F.count(F.lit(1)).alias("size"))
    return attach(known, materialise(best, number), "label", number).select("v", "rep", "copies", F.col("best.v").alias("class_v"), F.col("best.rep").alias("class_id"), "links")


def join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, class_id, n_links (different texts linked to this one's) and n_copies (rows of this text) of every row."""
    found = materialise(classes(docs, id_col, text_col).withColumn("size", F.col("copies")))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), identity(F.col(text_col).cast("string")).alias("v"))
    return attach(rows, found, "v", rows.count()).select("doc_id", "class_id", F.col("links").alias("n_links"), F.col("copies").alias("n_copies"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of ``docs`` for each class, that of the class id. Rows whose class is but themselves stay where they are;
    the others are reduced to one a text before they are shuffled."""
    found = materialise(classes(docs, id_col, text_col).filter("copies > 1 or links > 0").select("v", "class_v"))
    several = Sieve(found.select(F.xxhash64("v").alias("key")), "key")
    rows = docs.select(F.struct("*").alias("row"), identity(F.col(text_col).cast("string")).alias("v"), F.col(id_col).cast("long").alias("own"))
    rows = rows.withColumn("several", several.passes(F.xxhash64("v")))
    first = rows.filter("several").groupBy("v").agg(F.min_by("row", F.struct(F.col("own").isNull(), "own")).alias("row"))
    gone = found.filter("v != class_v").select("v")
    return rows.filter("not several").select("row.*").unionByName(first.join(gone.hint("merge"), "v", "left_anti").select("row.*"))


#: The query's rows in DuckDB, by comparing all pairs that share a shingle.
SQL = rf"""
WITH RECURSIVE texts AS (
  SELECT row_number() OVER (ORDER BY text) AS v, text, min(doc_id) AS rep, count(*) AS copies FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents) GROUP BY text
), worded AS (
  SELECT v, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM texts
), shingles AS (
  SELECT DISTINCT v, array_to_string(w[i:i + {SHINGLE - 1}], ' ') AS s FROM (SELECT v, w, unnest(range(1, greatest(1, len(w) - {SHINGLE - 1}) + 1)) AS i FROM worded WHERE len(w) > 0)
), sizes AS (
  SELECT v, count(*) AS n FROM shingles GROUP BY v
), pairs AS (
  SELECT a.v AS a, b.v AS b, count(*) AS c FROM shingles a JOIN shingles b ON a.s = b.s AND a.v < b.v GROUP BY a.v, b.v
), links AS (
  SELECT a, b FROM pairs JOIN sizes x ON x.v = a JOIN sizes y ON y.v = b WHERE 5 * c >= 4 * (x.n + y.n - c)
), two_way AS (
  SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reach(a, b) AS (
  SELECT v, v FROM texts UNION SELECT r.a, l.b FROM reach r JOIN two_way l ON l.a = r.b
), classes AS (
  SELECT a AS v, min(rep) AS class_id FROM reach JOIN texts ON texts.v = reach.b GROUP BY a
), degree AS (
  SELECT a AS v, count(*) AS n_links FROM two_way GROUP BY a
)
SELECT d.doc_id, c.class_id, coalesce(g.n_links, 0) AS n_links, t.copies AS n_copies
FROM documents d JOIN texts t ON t.text = coalesce(d.text, '') JOIN classes c ON c.v = t.v LEFT JOIN degree g ON g.v = t.v
"""
