"""Physical units as plan-time values.

A unit is a scale to SI base units and a vector of dimensions; a unit-carrying column is an
ordinary column whose metadata holds the unit's name. Conversions are literal multiplications,
which constant-fold; a dimension mismatch raises while the plan is built.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from fractions import Fraction

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEY = "unit"


class DimensionError(ValueError):
    """Units of different dimensions were combined."""


@dataclass(frozen=True)
class Unit:
    scale: float
    dims: tuple[tuple[str, Fraction], ...] = ()
    offset: float = 0.0

    def __mul__(self, other: Unit) -> Unit:
        d = dict(self.dims)
        for k, v in other.dims:
            d[k] = d.get(k, Fraction(0)) + v
        return Unit(self.scale * other.scale, tuple(sorted((k, v) for k, v in d.items() if v)))

    def __pow__(self, power) -> Unit:
        power = Fraction(power)
        return Unit(self.scale ** float(power), tuple((k, v * power) for k, v in self.dims))

    @property
    def dimensionless(self) -> bool:
        return not self.dims


def _u(scale: float, **dims: int) -> Unit:
    return Unit(scale, tuple(sorted((k, Fraction(v)) for k, v in dims.items())))


_BASE = {
    "": _u(1.0),
    "1": _u(1.0),
    "dimensionless": _u(1.0),
    "pixel": _u(1.0, pixel=1),
    "px": _u(1.0, pixel=1),
    "count": _u(1.0),
    "radian": _u(1.0),
    "degree": _u(0.017453292519943295),
    "meter": _u(1.0, length=1),
    "metre": _u(1.0, length=1),
    "m": _u(1.0, length=1),
    "inch": _u(0.0254, length=1),
    "second": _u(1.0, time=1),
    "sec": _u(1.0, time=1),
    "s": _u(1.0, time=1),
    "minute": _u(60.0, time=1),
    "min": _u(60.0, time=1),
    "hour": _u(3600.0, time=1),
    "hr": _u(3600.0, time=1),
    "h": _u(3600.0, time=1),
    "day": _u(86400.0, time=1),
    "d": _u(86400.0, time=1),
    "week": _u(604800.0, time=1),
    "month": _u(2629746.0, time=1),
    "hertz": _u(1.0, time=-1),
    "gram": _u(0.001, mass=1),
    "g": _u(0.001, mass=1),
    "kelvin": _u(1.0, temperature=1),
    "degC": Unit(1.0, (("temperature", Fraction(1)),), 273.15),
    "liter": _u(0.001, length=3),
}
_PREFIX = {
    "nano": 1e-9, "micro": 1e-6, "milli": 1e-3, "centi": 1e-2, "kilo": 1e3,
    "n": 1e-9, "u": 1e-6, "µ": 1e-6, "μ": 1e-6, "m": 1e-3, "c": 1e-2, "k": 1e3,
}
_LONG = {"meter", "metre", "second", "gram", "liter", "hertz", "kelvin", "pixel"}
_SHORT = {"m", "s", "g"}


def _atom(name: str) -> Unit:
    if name == "micron":
        return _u(1e-6, length=1)
    for candidate in (name, name[:-1] if name.endswith("s") and len(name) > 2 else name):
        if candidate in _BASE:
            return _BASE[candidate]
        for prefix, factor in _PREFIX.items():
            rest = candidate[len(prefix) :]
            if candidate.startswith(prefix) and rest in (_LONG if len(prefix) > 1 else _SHORT):
                return Unit(factor * _BASE[rest].scale, _BASE[rest].dims)
    raise ValueError(f"unknown unit {name!r}")


def parse(text: str | Unit) -> Unit:
    """A unit from text such as 'micrometer ** 2', 'µm^2', '1/hour' or 'px*px'."""
    if isinstance(text, Unit):
        return text
    s = text.strip().replace("²", "**2").replace("³", "**3").replace("^", "**").replace(" per ", "/")
    if s in _BASE:
        return _BASE[s]
    out, sign = _u(1.0), 1
    for token in re.findall(r"\*\*|[*/]|[^\s*/]+", s):
        if token in ("*", "/"):
            sign = -1 if token == "/" else 1
        elif token == "**":
            sign = 0  # the next token is a power of the last factor
        elif sign == 0:
            power = Fraction(token.strip("()"))
            out = before * last ** (direction * power)  # noqa: F821
            sign = 1
        else:
            last, direction, before = _atom(token), sign, out
            out = out * last**sign
            sign = 1
    return out


def to_quantity(value) -> tuple[float, str]:
    """(magnitude, unit) of text such as '15 minute', of a pair, or of a bare number."""
    if isinstance(value, tuple):
        return float(value[0]), value[1]
    if isinstance(value, (int, float)) and not isinstance(value, bool):
        return float(value), ""
    m = re.fullmatch(r"\s*([-+]?[0-9.]+(?:[eE][-+]?[0-9]+)?)\s*(.*?)\s*", str(value))
    if not m:
        raise ValueError(f"not a quantity: {value!r}")
    parse(m[2])
    return float(m[1]), m[2]


def affine(source: str | Unit, target: str | Unit) -> tuple[float, float]:
    """(scale, offset) with target value = source value * scale + offset."""
    a, b = parse(source), parse(target)
    if a.dims != b.dims:
        raise DimensionError(f"cannot convert {source!r} to {target!r}")
    return a.scale / b.scale, (a.offset - b.offset) / b.scale


def convert(col: Column, source: str | Unit, target: str | Unit) -> Column:
    scale, offset = affine(source, target)
    col = col if scale == 1.0 else col * F.lit(scale)
    return col if offset == 0.0 else col + F.lit(offset)


def magnitude(bound, unit: str) -> float | None:
    """A filter bound in a column's unit; bare numbers are taken to be in that unit."""
    if bound is None:
        return None
    value, own = to_quantity(bound)
    if own == "" and not isinstance(bound, str):
        return value
    scale, offset = affine(own, unit)
    return value * scale + offset


def unit_of(df: DataFrame, column: str) -> str:
    """The unit recorded for a column, '' if none."""
    if column not in df.columns:
        raise KeyError(f"no column {column!r}; run the extractor that gives it first")
    return df.schema[column].metadata.get(KEY, "")


def attach_units(df: DataFrame, units: dict[str, str], include_dimensionless: bool = False) -> DataFrame:
    """Record units in column metadata; dimensionless columns stay plain unless asked for."""
    for name, unit in units.items():
        if include_dimensionless or not parse(unit).dimensionless:
            df = df.withMetadata(name, {**df.schema[name].metadata, KEY: unit})
    return df


def strip_units(df: DataFrame) -> DataFrame:
    for f in df.schema.fields:
        if KEY in f.metadata:
            df = df.withMetadata(f.name, {k: v for k, v in f.metadata.items() if k != KEY})
    return df


def units(df: DataFrame) -> dict[str, str]:
    return {f.name: f.metadata[KEY] for f in df.schema.fields if KEY in f.metadata}


def converted(df: DataFrame, column: str, target: str) -> DataFrame:
    """`df` with a unit-carrying column in another unit."""
    out = df.withColumn(column, convert(F.col(column), unit_of(df, column), target))
    return attach_units(out, {column: target}, include_dimensionless=True)


def pixel_unit(pixel_size: float | tuple[float, float] | None, dim: int) -> float:
    """Factor from pixel^dim to physical: scalar^dim; anisotropic areas a*b, lengths sqrt(a*b)."""
    if pixel_size is None:
        return 1.0
    if isinstance(pixel_size, (int, float)):
        return float(pixel_size) ** dim
    a, b = (float(x) for x in pixel_size)
    return (a * b) ** (dim / 2)
