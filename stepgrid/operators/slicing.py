"""Array slices to selections: subscripts as in NumPy, and start/count texts as in array listings."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .reading import read
from .selection import Box, coordinates


@dataclass(frozen=True)
class Axis:
    """Indexes of one axis: start, stop, step, or a list; ``drop`` for a single integer."""

    start: int
    stop: int
    step: int = 1
    picked: tuple[int, ...] | None = None
    drop: bool = False

    @property
    def size(self) -> int:
        return len(self.picked) if self.picked is not None else max(0, -(-(self.stop - self.start) // self.step))


def axes(key, dims: Sequence[int]) -> list[Axis]:
    """Axes of a subscript; one list or boolean mask at most."""
    key = key if isinstance(key, tuple) else (key,)
    if any(k is Ellipsis for k in key):
        at = next(i for i, k in enumerate(key) if k is Ellipsis)
        key = key[:at] + (slice(None),) * (len(dims) - len(key) + 1) + key[at + 1 :]
    key = key + (slice(None),) * (len(dims) - len(key))
    if len(key) > len(dims):
        raise ValueError("too many indexes")
    out, lists = [], 0
    for k, n in zip(key, dims):
        if isinstance(k, slice):
            step = 1 if k.step is None else k.step
            if step < 1:
                raise ValueError("step must be 1 or more")
            start = 0 if k.start is None else k.start + n if k.start < 0 else k.start
            stop = n if k.stop is None else k.stop + n if k.stop < 0 else min(k.stop, n)
            if not 0 <= start <= n:
                raise ValueError(f"index {k.start} out of range")
            if stop < start:
                raise ValueError("stop is before start")
            out.append(Axis(start, stop, step))
        elif isinstance(k, (list, tuple)):
            lists += 1
            if lists > 1:
                raise TypeError("only one list of indexes is possible")
            if k and all(isinstance(i, bool) for i in k):
                if len(k) != n:
                    raise ValueError("a mask needs the length of its axis")
                k = [i for i, on in enumerate(k) if on]
            k = [i + n if i < 0 else i for i in k]
            if any(not 0 <= i < n for i in k):
                raise ValueError("index out of range")
            out.append(Axis(min(k, default=0), max(k, default=-1) + 1, 1, tuple(k)))
        else:
            i = k + n if k < 0 else k
            if not 0 <= i < n:
                raise ValueError(f"index {k} out of range")
            out.append(Axis(i, i + 1, drop=True))
    return out


def select(cells: DataFrame, key, dims: Sequence[int], nsteps: int = 1) -> DataFrame:
    """Cells of a subscript with their place in the result (o0.. over the axes that stay): strides are honoured, lists
    keep order and duplicates. Of a variable of several steps, steps are the first axis."""
    names = ["step"] * (nsteps > 1) + coordinates(len(dims))
    found = axes(key, [nsteps] * (nsteps > 1) + list(dims))
    out, kept = cells, 0
    for name, a in zip(names, found):
        out = out.filter((F.col(name) >= a.start) & (F.col(name) < max(a.start, a.stop)))
    for name, a in zip(names, found):
        c = F.col(name)
        if a.picked is not None:
            at = cells.sparkSession.createDataFrame(list(enumerate(a.picked)), "_o long, _c long") if a.picked else cells.sparkSession.createDataFrame([], "_o long, _c long")
            # The list comes from the subscript, so its size is the caller's.
            out = out.join(F.broadcast(at) if len(a.picked) <= 100_000 else at, c == F.col("_c")).drop("_c").withColumnRenamed("_o", f"o{kept}")
        else:
            if a.step > 1:
                out = out.filter(F.pmod(c - a.start, F.lit(a.step)) == 0)
            if a.drop:
                continue
            out = out.withColumn(f"o{kept}", F.floor((c - a.start) / a.step).cast("long"))
        kept += 1
    return out


def numbers(text: str) -> list[int]:
    """Numbers of a dimension text, separated by blanks, commas, semicolons or x."""
    return [int(x) for x in re.split(r"[\s,;x]+", text.strip()) if x]


def listing_box(start: str | Sequence[int], count: str | Sequence[int], dims: Sequence[int]) -> Box:
    """The box of a listing: a negative start counts from the end, a count of -k ends k - 1 before the end."""
    start = numbers(start) if isinstance(start, str) else list(start)
    count = numbers(count) if isinstance(count, str) else list(count)
    start += [0] * (len(dims) - len(start))
    count += [-1] * (len(dims) - len(count))
    start = [s + d if s < 0 else s for s, d in zip(start, dims)]
    count = [d + n + 1 - s if n < 0 else n for n, d, s in zip(count, dims, start)]
    box = Box(start, count)
    box.within(dims)
    return box


def dump(v, start: str | Sequence[int], count: str | Sequence[int]) -> DataFrame:
    """The cells of a listing; of a variable of several steps, steps are the first dimension of both texts."""
    if v.grid.nsteps <= 1:
        return read(v, listing_box(start, count, v.grid.dims))
    box = listing_box(start, count, (v.grid.nsteps, *v.grid.dims))
    return read(v, Box(box.start[1:], box.count[1:]), box.start[0], box.count[0])
