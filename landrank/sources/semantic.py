"""A small semantic layer: named dimensions and measures over tables, compiled to filter, groupBy, agg, sort and limit."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_CLAUSE = re.compile(r"\s*(\w+)\s*(>=|<=|!=|=|>|<)\s*(.*?)\s*$", re.S)
MOST_ROWS, DEFAULT_ROWS = 5000, 100


@dataclass(frozen=True)
class Model:
    """dimensions: name -> column; measures: name -> (function, column or '*')."""

    name: str
    dimensions: Mapping[str, str]
    measures: Mapping[str, tuple[str, str]]

    def measure(self, name: str) -> Column:
        kind, column = self.measures[name]
        build = {"count": F.count, "sum": F.sum, "mean": F.avg, "max": F.max, "min": F.min}[kind]
        return build(F.lit(1) if column == "*" else F.col(column)).alias(name)


def parse_filter(text: str, names: Mapping[str, str] | None = None) -> Column:
    """`field op value`; the value is an integer, else a number, else text, with quotes taken off.

    names: the fields that may be asked about and their columns; None takes any column.
    """
    m = _CLAUSE.match(text)
    if not m:
        raise ValueError(f"not a filter: {text!r}")
    name, op, raw = m.groups()
    if names is not None and name not in names:
        raise ValueError(f"unknown field {name} in {text!r}; known: {', '.join(names)}")
    value: object = raw.strip("'\"")
    for kind in (int, float):
        try:
            value = kind(raw)
            break
        except ValueError:
            continue
    c, v = F.col(names[name] if names is not None else name), F.lit(value)
    return {">=": c >= v, "<=": c <= v, "!=": c != v, "=": c == v, ">": c > v, "<": c < v}[op]


def load(spec: Mapping) -> Model:
    """A model from its declaration: {"model", "dimensions": {name: {"expr"}}, "measures": {name: {"expr"}}}, where a measure
    is count(*), or sum, mean, max or min of a column; anything else is an error."""
    if extra := set(spec) - {"model", "table", "description", "dimensions", "measures"}:
        raise ValueError(f"unknown keys: {', '.join(sorted(extra))}")
    measures = {}
    for name, m in spec["measures"].items():
        found = re.fullmatch(r"(count|sum|mean|max|min)\((\*|\w+)\)", m["expr"])
        if not found or (found[2] == "*" and found[1] != "count"):
            raise ValueError(f"measure {name}: can't read {m['expr']!r}")
        measures[name] = (found[1], found[2])
    return Model(spec["model"], {k: v["expr"] for k, v in spec["dimensions"].items()}, measures)


def ask(model: Model, table: DataFrame, dimensions: Sequence[str] = (), measures: Sequence[str] = (), filters: Sequence[str] = (), order_by: str | None = None, descending: bool = False, limit: int | None = DEFAULT_ROWS) -> DataFrame:
    """Rows of a semantic query; without measures the model's first one, without dimensions one row.

    Filters name dimensions; rows come in ascending order of `order_by` unless told otherwise, equal ones and those of no order by the
    dimensions, and at most `limit` of them: which rows a limit leaves out is never left to chance.
    """
    for kind, asked, known in (("dimension", dimensions, model.dimensions), ("measure", measures, model.measures)):
        if unknown := [x for x in asked if x not in known]:
            raise ValueError(f"unknown {kind} {', '.join(unknown)} of {model.name}; known: {', '.join(known)}")
    if limit is not None and not 1 <= limit <= MOST_ROWS:
        raise ValueError(f"limit is from 1 to {MOST_ROWS}")
    for text in filters:
        table = table.filter(parse_filter(text, model.dimensions))
    keys = [F.col(model.dimensions[d]).alias(d) for d in dimensions]
    out = table.groupBy(*keys).agg(*[model.measure(m) for m in measures or [next(iter(model.measures))]])
    if order_by:
        out = out.orderBy(F.desc(order_by) if descending else F.asc(order_by), *dimensions)
    elif limit is not None and dimensions:
        out = out.orderBy(*dimensions)
    return out if limit is None else out.limit(limit)
