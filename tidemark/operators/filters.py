"""Screens by lists of filters: specifications become one condition that Spark can push to the scan."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: How far a value may lie from the one it is to equal.
NEAR = 0.001
OPERATIONS = ("gt", "lt", "gte", "lte", "eq", "between", "in")


@dataclass(frozen=True)
class Filter:
    """A field, an operation and its value: a pair for between (ends included), a sequence for in."""

    field: str
    operation: str
    value: Any


def _one(f: Filter, kind: str) -> Column:
    c, v = F.col(f"`{f.field}`"), f.value
    if f.operation == "eq":
        if kind in ("string", "boolean", "date", "timestamp", "timestamp_ntz"):
            return c == F.lit(v)
        return c.between(v - NEAR, v + NEAR)  # bounds, not a difference, so that a scan can prune by them
    if f.operation == "between":
        low, high = v
        return c.between(low, high)
    if f.operation == "in":
        return c.isin(list(v))
    return {"gt": c > v, "lt": c < v, "gte": c >= v, "lte": c <= v}[f.operation]


def condition(filters: Sequence[Filter], frame: DataFrame) -> Column:
    """E6 all filters as one condition over a frame. A field that the frame lacks, or an operation that is not known, passes
    every row; a null value fails. No filter passes every row."""
    kinds = {f.name: f.dataType.simpleString() for f in frame.schema.fields}
    known = [_one(f, kinds[f.field]) for f in filters if f.field in kinds and f.operation in OPERATIONS]
    return reduce(lambda a, b: a & b, known, F.lit(True))


@dataclass(frozen=True)
class Screen:
    """Filters, the field to sort by, its direction, what a null counts as, and the number of rows of the report."""

    filters: tuple[Filter, ...]
    sort: str
    descending: bool = True
    null: float = -999.0
    limit: int = 50

    def __call__(self, frame: DataFrame, key: str = "symbol") -> DataFrame:
        """E7, E8 the rows that pass, in order, ties by key; a field of sort that the frame lacks sorts by key alone."""
        rows = frame.where(condition(self.filters, frame))
        by = [F.round(F.coalesce(F.col(self.sort), F.lit(self.null)), 6)] if self.sort in frame.columns else []
        return rows.orderBy(*[b.desc() if self.descending else b.asc() for b in by], key).limit(self.limit)


PRESETS = {
    "oversold": Screen((Filter("rsi", "lt", 30.0),), "rsi", False, 50.0),
    "overbought": Screen((Filter("rsi", "gt", 70.0),), "rsi", True, 50.0),
    "active": Screen((Filter("activity", "gte", 1.2), Filter("to20", "between", (-20.0, 20.0))), "activity"),
    "steady": Screen((Filter("to20", "between", (-5.0, 5.0)), Filter("to50", "between", (-10.0, 10.0)), Filter("rsi", "gte", 40.0), Filter("rsi", "lte", 60.0)), "m5"),
    "momentum": Screen((Filter("m5", "gt", 5.0), Filter("to20", "gt", 0.0), Filter("sector", "in", ("none",))), "m5"),
}


def presets(frame: DataFrame) -> DataFrame:
    """(preset, symbol and metrics): the report of every preset; a bounded number of rows each."""
    found = [screen(frame).withColumn("preset", F.lit(name)) for name, screen in PRESETS.items()]
    return reduce(DataFrame.unionByName, found)
