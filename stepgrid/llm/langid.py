"""Operator 9, language identification by nearest centroid.

Texts become TF-IDF vectors of hashed byte trigrams, of length one. Each language has several centroids: k-means starts
on a bounded sample, then one pass over all training rows assigns every row to its language's nearest centroid and
averages. A text takes the language of the centroid of largest cosine; one farther than nearly all training rows of
that language is rejected.

Defined results: a null text, or one without a letter, gets ``und``, score 0, and is rejected; ties go to the language
first by code point; with no training rows every text gets ``und``; a null id counts as the empty text for the fold;
rows with a null language are not learned from; repeated rows give repeated equal rows; whole texts are counted, whatever
their length; an empty table gives no rows. The model grows with the number of languages, which is taken to be small.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, in_batches, mix64, slices, steps, sum_vectors

BINS = 4096
#: Texts whose vectors are held at once.
ROWS = 256
#: Centroids of a language, and training rows of a language that k-means starts from (a bound, about).
CENTROIDS, SAMPLE = 4, 400
#: Share of a language's training rows that may lie beyond its rejection distance, before REJECT_MARGIN.
REJECT_SHARE, REJECT_MARGIN = 0.001, 0.5
UNKNOWN = "und"

_LETTER = re.compile(r"[^\W\d_]")
_FOLD = np.full(256, 32, np.uint8)
_FOLD[128:] = np.arange(128, 256)
_FOLD[ord("a") : ord("z") + 1] = np.arange(ord("a"), ord("z") + 1)
_HASH = [(mix64(np.arange(256 * k + 1, 256 * k + 257, dtype=np.uint64)) % np.uint64(BINS)).astype(np.int64) for k in range(3)]
_BLANK = int(_HASH[0][32] ^ _HASH[1][32] ^ _HASH[2][32])


def term_counts(texts: list[bytes]) -> np.ndarray:
    """Counts of the hashed trigrams of each lower-case text; everything but letters is a blank, and blanks count not."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 3
    data = _FOLD[np.frombuffer(b"   ".join([b"", *texts, b""])[1:], np.uint8)]
    code = _HASH[0][data[:-2]] ^ _HASH[1][data[1:-1]] ^ _HASH[2][data[2:]]
    row = np.repeat(np.arange(len(texts)), sizes)[: len(code)]
    code = code[: len(row)]
    counts = np.bincount(row * BINS + code, minlength=len(texts) * BINS).reshape(len(texts), BINS)
    counts[:, _BLANK] = 0
    return counts


def vectors(texts: list[bytes], idf: np.ndarray) -> np.ndarray:
    v = np.log1p(term_counts(texts).astype(np.float32)) * idf
    norm = np.sqrt(np.einsum("ij,ij->i", v, v))
    v /= np.where(norm > 0, norm, 1)[:, None]
    return v


def _lower(texts: list[str | None]) -> list[str]:
    return [t.lower() if t else "" for t in texts]


@dataclass
class Model:
    langs: list[str]
    idf: np.ndarray
    centroids: np.ndarray
    owner: np.ndarray
    least: np.ndarray  # cosine below which a language rejects


def _unit(m: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(m, axis=-1, keepdims=True)
    return m / np.where(norm > 0, norm, 1)


def _kmeans(v: np.ndarray, k: int) -> np.ndarray:
    """Spherical k-means, seeded by the farthest rows in turn."""
    start = [0]
    near = v @ v[0]
    while len(start) < min(k, len(v)):
        start.append(int(np.argmin(near)))
        near = np.maximum(near, v @ v[start[-1]])
    c = v[start]
    for _ in range(8):
        own = np.argmax(v @ c.T, 1)
        c = _unit(np.stack([v[own == j].sum(0) if (own == j).any() else c[j] for j in range(len(c))]))
    return c


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Learn from the rows with a language that are not held out. The model's size depends on the number of languages."""
    rows = in_batches(docs).filter(~held_out(F.col(id_col)) & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, by = np.zeros(BINS), {}
        for batch in slices(batches):
            for lang in batch.column(1).to_pylist():
                by[lang] = by.get(lang, 0) + 1
            for _, run in steps(_lower(batch.column(0).to_pylist()), rows=ROWS):
                df += (term_counts(run) > 0).sum(0)
        keys = ["", *(f"={k}" for k in by)]
        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array([df.tobytes(), *(np.float64(n).tobytes() for n in by.values())], pa.binary())], names=["key", "vec"])

    got = {r.key: np.frombuffer(r.vec) for r in sum_vectors(rows.select("text", "lang").mapInArrow(frequencies, "key string, vec binary")).collect()}
    numbers = {k[1:]: int(v[0]) for k, v in got.items() if k}
    langs, total = sorted(numbers), sum(numbers.values())
    if not total:
        return Model([], np.zeros(BINS, np.float32), np.zeros((0, BINS), np.float32), np.zeros(0, int), np.zeros(0))
    idf = np.log((total + 1) / (got[""] + 0.5)).clip(0).astype(np.float32)

    share = F.create_map(*(F.lit(x) for k in langs for x in (k, min(1.0, SAMPLE / numbers[k]))))
    sample = rows.filter(F.pmod(F.xxhash64("id", "text"), F.lit(1 << 20)) < share[F.col("lang")] * (1 << 20)).groupBy("lang")

    # In Arrow: pandas, once loaded, stays in a worker.
    def centres(sampled: pa.Table) -> pa.Table:
        c = _kmeans(np.concatenate([vectors(run, idf) for _, run in steps(_lower(sorted(sampled["text"].to_pylist())), rows=ROWS)]), CENTROIDS)
        return pa.table({"lang": [sampled["lang"][0].as_py()] * len(c), "k": pa.array(range(len(c)), pa.int32()), "vec": pa.array([x.astype(np.float32).tobytes() for x in c], pa.binary())})

    first = sorted((r.lang, r.k, r.vec) for r in sample.applyInArrow(centres, "lang string, k int, vec binary").collect())
    start = {k: np.stack([np.frombuffer(v, np.float32) for l, _, v in first if l == k]) for k in {l for l, _, _ in first}}

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in slices(batches):
            own = np.array(batch.column(1).to_pylist(), object)
            for at, run in steps(_lower(batch.column(0).to_pylist()), rows=ROWS):
                v = vectors(run, idf)
                for lang in set(own[at : at + len(run)]) & set(start):
                    part = v[own[at : at + len(run)] == lang]
                    cosine = part @ start[lang].T
                    nearest = cosine.argmax(1)
                    histogram = np.bincount((cosine.max(1).clip(0, 1) * (BINS - 1)).astype(int), minlength=BINS)
                    for key, vec in [(f"{lang}\t-1", histogram), *((f"{lang}\t{k}", part[nearest == k].sum(0)) for k in set(nearest.tolist()))]:
                        sums[key] = sums[key] + vec if key in sums else vec.astype(np.float64)
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums)), pa.array([v.tobytes() for v in sums.values()], pa.binary())], names=["key", "vec"])

    done = sorted((r.key.rpartition("\t")[0], int(r.key.rpartition("\t")[2]), r.vec) for r in sum_vectors(rows.select("text", "lang").mapInArrow(assign, "key string, vec binary")).collect())
    langs = sorted({l for l, _, _ in done})
    least = []
    for lang in langs:
        histogram = np.frombuffer(next(v for l, k, v in done if l == lang and k < 0))
        least.append(REJECT_MARGIN * np.searchsorted(np.cumsum(histogram), REJECT_SHARE * histogram.sum()) / (BINS - 1))
    kept = [(langs.index(l), np.frombuffer(v)) for l, k, v in done if k >= 0]
    return Model(langs, idf, _unit(np.stack([v for _, v in kept])).astype(np.float32), np.array([i for i, _ in kept]), np.array(least))


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score (the cosine) and rejected of every row."""
    names = ["doc_id", "lang_pred", "score", "rejected"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            lang, score, rejected = [], [], []
            texts = batch.column(1).to_pylist()
            for at, part in steps(_lower(texts), rows=ROWS):
                if model.langs:
                    cosine = vectors(part, model.idf) @ model.centroids.T
                    by = np.stack([cosine[:, model.owner == i].max(1) for i in range(len(model.langs))], 1).astype(np.float64).clip(0, 1)
                    best = by.argmax(1)
                    top = by[np.arange(len(best)), best]
                    bad = top < model.least[best]
                for i in range(len(part)):
                    t = texts[at + i]
                    known = bool(model.langs and t and _LETTER.search(t))
                    lang.append(model.langs[best[i]] if known else UNKNOWN)
                    score.append(float(top[i]) if known else 0.0)
                    rejected.append(bool(bad[i]) if known else True)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())], names=names)

    return in_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, lang_pred string, score double, rejected boolean")


def keep_known(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, whose text the model doesn't reject."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts, keep = batch.column(at).to_pylist(), []
            for first, part in steps(_lower(texts), rows=ROWS):
                if not model.langs:
                    keep += [False] * len(part)
                    continue
                cosine = vectors(part, model.idf) @ model.centroids.T
                best = cosine.argmax(1)
                good = cosine[np.arange(len(best)), best] >= model.least[model.owner[best]]
                keep += [bool(good[i] and texts[first + i] and _LETTER.search(texts[first + i])) for i in range(len(part))]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return in_batches(docs).mapInArrow(run, docs.schema)
