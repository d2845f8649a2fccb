"""Mixed-radix numbers: a total and the parts it has under given bases."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import MissingArgumentError


def from_parts(parts: Sequence[Column], bases: Sequence[int]) -> Column:
    """Parts from the highest, which has no base of its own, to the lowest; carries happen by themselves."""
    if len(parts) != len(bases) + 1:
        raise MissingArgumentError("every part but the first needs a base")
    total = parts[0].cast("long")
    for part, base in zip(parts[1:], bases):
        total = total * base + part
    return total


def to_parts(total: Column, bases: Sequence[int], names: Sequence[str]) -> Column:
    """A struct of the parts; all but the first lie between 0 and their base, also for negative totals."""
    parts, rest = [], total.cast("long")
    for base in reversed(bases):
        parts.append(F.pmod(rest, F.lit(base)).cast("long"))
        rest = F.floor((rest - parts[-1]) / base)
    parts.append(rest.cast("long"))
    return F.struct(*[p.alias(n) for p, n in zip(reversed(parts), names)])


def display(parts: Column, names: Sequence[str], widths: Sequence[int], sep: str = ":") -> Column:
    return F.concat_ws(sep, *[F.lpad(parts[n].cast("string"), w, "0") for n, w in zip(names, widths)])


def add(a: Column, b: Column, bases: Sequence[int], names: Sequence[str]) -> Column:
    """Sum of two structs of parts, carries included; likewise ``subtract`` and ``multiply``."""
    return to_parts(_total(a, bases, names) + _total(b, bases, names), bases, names)


def subtract(a: Column, b: Column, bases: Sequence[int], names: Sequence[str]) -> Column:
    return to_parts(_total(a, bases, names) - _total(b, bases, names), bases, names)


def multiply(a: Column, factor: Column | int, bases: Sequence[int], names: Sequence[str]) -> Column:
    return to_parts(_total(a, bases, names) * factor, bases, names)


def _total(x: Column, bases: Sequence[int], names: Sequence[str]) -> Column:
    return from_parts([x[n] for n in names], bases)
