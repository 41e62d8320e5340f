"""Value types of array variables: names and aliases, Spark types, sizes, literals and predicate operators."""

from __future__ import annotations

import operator
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


class ArrayError(Exception):
    """Errors carry the numeric code that array I/O users know."""

    code = -1


class InvalidQuery(ArrayError):
    code = -7


class InvalidName(ArrayError):
    code = -5


class InvalidStep(ArrayError):
    code = -13


class OutOfBounds(ArrayError):
    code = -15


class EndOfStream(ArrayError):
    code = -21


class StepNotReady(ArrayError):
    code = -22


class StepDisappeared(ArrayError):
    code = -23


@dataclass(frozen=True)
class ValueType:
    """``kind``: int, uint, real, complex or string."""

    name: str
    spark: str
    size: int
    kind: str
    aliases: tuple[str, ...] = ()


# The type names, their aliases and sizes.
TYPES = (
    ValueType("byte", "tinyint", 1, "int", ("char", "integer*1")),
    ValueType("short", "smallint", 2, "int", ("integer*2",)),
    ValueType("integer", "int", 4, "int", ("int", "integer*4")),
    ValueType("long", "bigint", 8, "int", ("long long", "integer*8")),
    ValueType("unsigned byte", "smallint", 1, "uint", ("unsigned char", "unsigned integer*1")),
    ValueType("unsigned short", "int", 2, "uint", ("unsigned integer*2",)),
    ValueType("unsigned integer", "bigint", 4, "uint", ("unsigned int", "unsigned integer*4")),
    ValueType("unsigned long", "decimal(20,0)", 8, "uint", ("unsigned integer*8",)),
    ValueType("real", "float", 4, "real", ("real*4", "float")),
    ValueType("double", "double", 8, "real", ("real*8", "long float")),
    ValueType("long double", "double", 16, "real", ("real*16",)),
    ValueType("string", "string", 0, "string"),
    ValueType("complex", "struct<re:float,im:float>", 8, "complex", ("complex*8",)),
    ValueType("double complex", "struct<re:double,im:double>", 16, "complex", ("complex*16",)),
    ValueType("string array", "array<string>", 0, "string"),
)
_BY_NAME = {n: t for t in TYPES for n in (t.name, *t.aliases)}


def value_type(name: str) -> ValueType:
    """The type of this name or alias."""
    try:
        return _BY_NAME[name.strip().lower()]
    except KeyError:
        raise InvalidName(f"unknown type {name!r}") from None


def of_spark(kind: str) -> ValueType:
    """The signed type that a Spark column type stores."""
    for t in TYPES:
        if t.spark == kind and t.kind != "uint":
            return t
    if kind.startswith("decimal"):
        return value_type("unsigned long")
    raise InvalidName(f"no array type stores {kind}")


def type_size(t: ValueType, value: str | None = None) -> int:
    """Bytes of a value; a string has one more than its characters."""
    return len(value.encode()) + 1 if t.name == "string" and value is not None else t.size


def literal(text: str, t: ValueType) -> Column:
    """Predicate constants are text: whole numbers are read up to the first other character, reals as doubles."""
    text = str(text).strip()
    if t.kind in ("int", "uint"):
        digits = text[:1] if text[:1] in "+-" else ""
        for c in text[len(digits) :]:
            if c not in "0123456789":
                break
            digits += c
        if not digits.strip("+-"):
            raise InvalidQuery(f"{text!r} is not a number")
        if t.name == "unsigned long":
            return F.lit(digits).cast("decimal(20,0)")
        if not -(1 << 63) <= int(digits) < 1 << 63:
            raise InvalidQuery(f"{text!r} is beyond 64 bits")
        return F.lit(int(digits)).cast("bigint")
    if t.kind == "real":
        try:
            return F.lit(float(text))
        except ValueError:
            raise InvalidQuery(f"{text!r} is not a number") from None
    raise InvalidQuery(f"{t.name} variables take no predicates")


def comparable(value: Column, t: ValueType) -> Column:
    """Values as predicates compare them: reals as doubles, the others exactly."""
    return value.cast("double") if t.kind == "real" else value


OPERATORS: dict[str, Callable[[Column, Column], Column]] = {"<": operator.lt, "<=": operator.le, ">": operator.gt, ">=": operator.ge, "=": operator.eq, "==": operator.eq, "!=": operator.ne}
_NAMES = {"LT": "<", "LE": "<=", "LTEQ": "<=", "GT": ">", "GE": ">=", "GTEQ": ">=", "EQ": "=", "NE": "!="}


def operator_of(text: str) -> str:
    """The operator sign of a sign or name; unknown text is an error."""
    op = _NAMES.get(text.strip().upper(), text.strip())
    if op not in OPERATORS:
        raise InvalidQuery(f"unknown operator {text!r}")
    return "=" if op == "==" else op


def test(value: Column, op: str, constant: Column, t: ValueType) -> Column:
    """A predicate on cells. NaN satisfies only ``!=``, as in C (Spark would order it above everything)."""
    v = comparable(value, t)
    plain = OPERATORS[op](v, constant)
    if t.kind != "real":
        return plain
    return F.isnan(v) | plain if op == "!=" else ~F.isnan(v) & plain
