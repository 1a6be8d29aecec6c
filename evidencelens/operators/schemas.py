"""Declared record schemas compiled to one row-local expression of path-coded errors.

A schema is a tree of ``Text``, ``Number``, ``Flag``, ``Items``, ``Record`` and ``Free``. :func:`problems` turns it into a Column: an array of
``path:keyword`` codes, with array positions in the path (``hypotheses.0.probability:maximum``), for arrays in arrays, too. :func:`ddl` gives
the type to read such records with. A typed row does not tell a missing field from a null one, so both are ``required`` errors
where the field is; fields that a schema does not know never reach the row.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Text:
    min_length: int = 0
    enum: tuple[str, ...] = ()
    const: str | None = None
    #: A further check: value Column to condition of an error, and its keyword.
    bad: Callable[[Column], Column] | None = None
    keyword: str = "format"


@dataclass(frozen=True)
class Number:
    low: float | None = None
    high: float | None = None
    integer: bool = False


@dataclass(frozen=True)
class Flag:
    const: bool | None = None


@dataclass(frozen=True)
class Free:
    """Any object, read as a map of texts."""


@dataclass(frozen=True)
class Items:
    of: object
    min_items: int = 0
    unique: bool = False


@dataclass(frozen=True)
class When:
    """Where ``field`` has the value ``const``, fields that must be there and fields that must not."""

    field: str
    const: str
    require: tuple[str, ...] = ()
    forbid: tuple[str, ...] = ()


@dataclass(frozen=True)
class Record:
    fields: dict = field(default_factory=dict)
    required: tuple[str, ...] = ()
    rules: tuple[When, ...] = ()


def ddl(spec: object) -> str:
    if isinstance(spec, Record):
        return "struct<" + ", ".join(f"{n}: {ddl(s)}" for n, s in spec.fields.items()) + ">"
    if isinstance(spec, Items):
        return f"array<{ddl(spec.of)}>"
    if isinstance(spec, Number):
        return "bigint" if spec.integer else "double"
    return "boolean" if isinstance(spec, Flag) else "map<string, string>" if isinstance(spec, Free) else "string"


def columns(spec: Record) -> str:
    """The fields of ``spec`` as a table's DDL."""
    return ", ".join(f"{n} {ddl(s)}" for n, s in spec.fields.items())


def _checks(spec: object, v: Column, path: str, sure: bool = False) -> tuple[list[tuple[Column, str]], list[tuple[Column, Callable[[], Column]]]]:
    """((condition, code) pairs, (condition, maker of an array of codes) pairs) of a value; ``path`` leads to it.

    A condition that is NULL does not hold. Arrays of codes are made only where their condition holds. ``sure``: the value is not NULL.
    """
    if isinstance(spec, Text):
        out = [(F.length(v) < spec.min_length, f"{path}:minLength")] if spec.min_length else []
        out += [(reduce(and_, [v != e for e in spec.enum]), f"{path}:enum")] if spec.enum else []
        out += [(v != spec.const, f"{path}:const")] if spec.const is not None else []
        return out + ([(v.isNotNull() & spec.bad(v), f"{path}:{spec.keyword}")] if spec.bad else []), []
    if isinstance(spec, Number):
        real = ~F.isnan(v.cast("double"))  # NaN is in no order; whether it may occur is a rule of its own
        out = [((v < spec.low) & real, f"{path}:minimum")] if spec.low is not None else []
        return out + ([((v > spec.high) & real, f"{path}:maximum")] if spec.high is not None else []), []
    if isinstance(spec, Flag):
        return ([(v != spec.const, f"{path}:const")] if spec.const is not None else []), []
    if isinstance(spec, Items):
        out = [(F.size(v) < spec.min_items, f"{path}:minItems")] if spec.min_items else []
        out += [(F.size(F.array_distinct(v)) < F.size(v), f"{path}:uniqueItems")] if spec.unique else []
        lead = F.lit(path + ".")

        def item(x: Column, i: Column) -> Column:
            found = F.when(x.isNull(), F.array(F.lit(":type"))).otherwise(problems(spec.of, x, sure=True))
            return F.transform(found, lambda e: F.concat(lead, i.cast("string"), F.when(e.startswith(":"), e).otherwise(F.concat(F.lit("."), e))))

        return out, [(F.exists(v, lambda x: x.isNull() | broken(spec.of, x, sure=True)), lambda: F.flatten(F.transform(v, item)))]
    if isinstance(spec, Record):
        singles, arrays = [], []
        lead = f"{path}." if path else ""
        for name, part in spec.fields.items():
            own = v[name]
            if name in spec.required:
                singles.append((own.isNull() if sure else v.isNotNull() & own.isNull(), f"{lead}{name}:required"))
            s, a = _checks(part, own, lead + name)
            singles, arrays = singles + s, arrays + a
        for rule in spec.rules:
            here = v[rule.field] == rule.const
            singles += [(here & v[n].isNull(), f"{lead}{n}:required") for n in rule.require]
            singles += [(here & v[n].isNotNull(), f"{lead}{n}:not") for n in rule.forbid]
        return singles, arrays
    return [], []


def broken(spec: object, value: Column, sure: bool = False) -> Column:
    """Whether ``value`` breaks any rule; NULL or false if none. No codes are made, so a sound value costs its conditions only."""
    singles, arrays = _checks(spec, value, "", sure)
    return reduce(or_, [c for c, _ in [*singles, *arrays]], F.lit(False))


def problems(spec: object, value: Column, sure: bool = False) -> Column:
    """Codes of all rules that ``value`` breaks, not NULL."""
    singles, arrays = _checks(spec, value, "", sure)
    none = F.array().cast("array<string>")
    codes = F.array_compact(F.array(*[F.when(c, F.lit(code)) for c, code in singles])) if singles else none
    found = F.when(reduce(or_, [c for c, _ in singles]), codes).otherwise(none) if singles else none
    return F.concat(found, *[F.when(c, make()).otherwise(none) for c, make in arrays]) if arrays else found


def table_problems(spec: Record) -> Column:
    """:func:`problems` of a table whose columns are the fields of ``spec``."""
    return problems(spec, F.struct(*[F.col(n) for n in spec.fields]))


def with_problems(df: DataFrame, spec: Record, name: str) -> DataFrame:
    """``df`` with the sorted distinct codes of :func:`table_problems`; they are found in a projection of their own, and few rows have any to sort."""
    found = F.col("__found")
    several = F.when(F.size(found) > 1, F.array_sort(F.array_distinct(found))).otherwise(found)
    return df.withColumn("__found", table_problems(spec)).withColumn(name, several).drop("__found")
