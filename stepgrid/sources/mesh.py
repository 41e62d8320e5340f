"""Meshes and links, kept as attributes under ``/mesh_schema/<mesh>/`` and ``/link_schema/<link>/``."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.types import InvalidName
from ..operators.selection import Box
from .dataset import Attribute, Dataset

# Where meshes and links are described, and the kinds of meshes.
SCHEMA, LINK = "/mesh_schema", "/link_schema"
KINDS = ("uniform", "structured", "rectilinear", "unstructured")
NEEDS = {"uniform": ["dimensions"], "structured": ["dimensions", "points"], "rectilinear": ["dimensions", "coordinates"], "unstructured": ["points", "cells"]}


@dataclass(frozen=True)
class Mesh:
    name: str
    kind: str
    properties: dict = field(default_factory=dict)

    def __post_init__(self):
        if self.kind not in KINDS:
            raise InvalidName(f"unknown kind of mesh {self.kind!r}")
        if missing := [k for k in NEEDS[self.kind] if not self.properties.get(k)]:
            raise InvalidName(f"a {self.kind} mesh needs {' and '.join(missing)}")
        dims = self.properties.get("dimensions", [])
        if len(dims) >= 10:
            raise InvalidName("a mesh has fewer than 10 dimensions")
        if self.kind == "rectilinear" and len(self.properties["coordinates"]) not in (1, len(dims)):
            raise InvalidName("a rectilinear mesh has one variable of coordinates for each dimension, or one for all")
        if self.kind == "uniform":
            self._spacings(dims)

    def _spacings(self, dims: list) -> None:
        """Spacing and maximum, where both are given, have to agree."""
        spacing, most = self.properties.get("spacings", []), self.properties.get("maximums", [])
        origin = self.properties.get("origins", []) or [0] * len(dims)
        for n, o, s, m in zip(dims, origin, spacing, most):
            if all(isinstance(x, (int, float)) for x in (n, o, s, m)) and n > 1 and s != (m - o) / (n - 1):
                raise InvalidName(f"spacing {s} doesn't lead from {o} to {m} in {n} points")


def define(ds: Dataset, mesh: Mesh) -> None:
    """Write a mesh as attributes."""
    ds.attribute(f"{SCHEMA}/{mesh.name}/type", mesh.kind, "string")
    for key, value in mesh.properties.items():
        many = list(value) if isinstance(value, (list, tuple)) else [value]
        ds.attribute(f"{SCHEMA}/{mesh.name}/{key}-num", len(many), "integer")
        for i, v in enumerate(many):
            ds.attribute(f"{SCHEMA}/{mesh.name}/{key}{i}", v)


def names(ds: Dataset) -> list[str]:
    lead = f"{SCHEMA}/"
    return sorted(n[len(lead) :].removesuffix("/type") for n in ds.attributes if n.startswith(lead) and n.endswith("/type"))


def _value(ds: Dataset, a: Attribute):
    """A number, or that of the scalar variable that the attribute names (its own text if none is called so)."""
    v = a.values[0]
    if isinstance(v, str) and v in ds.variables and ds.variables[v].grid.ndim == 0:
        return ds.variables[v].cells.select("value").first()[0]
    return v


def read(ds: Dataset, name: str, other: Dataset | None = None) -> Mesh:
    """A mesh; what ``ds`` doesn't say of it is taken from ``other``, where there is one."""
    lead = f"{SCHEMA}/{name}/"
    sources = [d for d in (ds, other) if d is not None]
    kind = next((d.attributes[f"{lead}type"].values[0] for d in sources if f"{lead}type" in d.attributes), None)
    if kind is None:
        raise InvalidName(f"no mesh {name!r}")
    properties: dict = {}
    for d in sources:
        for n, a in d.attributes.items():
            key = n[len(lead) : -len("-num")]
            if n.startswith(lead) and n.endswith("-num") and key not in properties:
                properties[key] = [_value(d, d.attributes[f"{lead}{key}{i}"]) for i in range(int(a.values[0]))]
    return Mesh(name, kind, properties)


def points(spark: SparkSession, mesh: Mesh) -> DataFrame:
    """The points of a uniform mesh: ``at`` (row-major) and x0..; a spacing that isn't given leads to the maximum, or is 1."""
    from ..operators.reading import box_cells

    if mesh.kind != "uniform":
        raise InvalidName("only a uniform mesh gives its points by rule")
    dims, get = mesh.properties["dimensions"], mesh.properties.get
    cells, out = box_cells(spark, Box([0] * len(dims), dims)), [F.col("at")]
    for k, n in enumerate(dims):
        origin = get("origins", [0] * len(dims))[k]
        most = get("maximums", [None] * len(dims))[k]
        step = get("spacings", [None if most is None else (most - origin) / max(1, n - 1)] * len(dims))[k]
        out.append((F.lit(float(origin)) + F.col(f"c{k}") * F.lit(1.0 if step is None else float(step))).alias(f"x{k}"))
    return cells.select(out)


def put_on(ds: Dataset, variable: str, mesh: str, centering: str = "point") -> None:
    """Say which mesh a variable lies on, and whether on its points or cells."""
    name = ds.variable(variable).name
    ds.attribute(f"{name}/mesh_schema", mesh, "string")
    ds.attribute(f"{name}/mesh_schema/centering", centering, "string")


def mesh_of(ds: Dataset, variable: str) -> tuple[str, str]:
    name = ds.variable(variable).name
    try:
        return ds.attributes[f"{name}/mesh_schema"].values[0], ds.attributes[f"{name}/mesh_schema/centering"].values[0]
    except KeyError:
        raise InvalidName(f"{variable} lies on no mesh") from None


@dataclass(frozen=True)
class Link:
    """References to variables or images in other datasets."""

    name: str
    targets: tuple[tuple[str, str, str], ...]  # kind ("var" or "image"), object, dataset


def link(ds: Dataset, value: Link) -> None:
    ds.attribute(f"{LINK}/{value.name}/ref-num", len(value.targets), "integer")
    for i, (kind, thing, where) in enumerate(value.targets):
        for key, v in (("type", kind), ("objref", thing), ("extref", where)):
            ds.attribute(f"{LINK}/{value.name}/{key}{i}", v, "string")


def read_link(ds: Dataset, name: str) -> Link:
    lead = f"{LINK}/{name}/"
    if f"{lead}ref-num" not in ds.attributes:
        raise InvalidName(f"no link {name!r}")
    n = int(ds.attributes[f"{lead}ref-num"].values[0])
    return Link(name, tuple(tuple(ds.attributes[f"{lead}{key}{i}"].values[0] for key in ("type", "objref", "extref")) for i in range(n)))
