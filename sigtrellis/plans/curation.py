"""Curation of sorted units: an ordered log of operations replayed on spikes and units.

Operations are few and made by hand; the log folds into one small map from units to
what becomes of them, and spikes are touched by a single join.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Names that people give the labels.
ALIASES = {"good": "good", "single": "good", "su": "good", "mua": "mua", "multi": "mua", "mu": "mua", "noise": "noise", "artifact": "noise"}


def label(name: str | None) -> str:
    return ALIASES.get((name or "").strip().lower(), "unsorted")


@dataclass
class Log:
    """label(unit, name), merge(units), unmerge(unit), split(unit, spikes); undo and redo."""

    done: list[dict] = field(default_factory=list)
    undone: list[dict] = field(default_factory=list)

    def push(self, op: str, **what) -> Log:
        self.done.append({"op": op, **what})
        self.undone.clear()
        return self

    def undo(self) -> None:
        if self.done:
            self.undone.append(self.done.pop())

    def redo(self) -> None:
        if self.undone:
            self.done.append(self.undone.pop())

    def dumps(self) -> str:
        return json.dumps(self.done)

    @staticmethod
    def loads(text: str) -> Log:
        return Log(json.loads(text))


def replay(units: DataFrame, spikes: DataFrame, log: Log) -> tuple[DataFrame, DataFrame]:
    """units (unit, label) and spikes (unit, s) after the log; spikes keep the unit they came from as ``origin``.

    A merge goes to a new unit, labelled unsorted; unmerge gives the members back. A
    split moves the listed samples of a unit to a new one.
    """
    spark = units.sparkSession
    names = {r.unit: r.label for r in units.select("unit", "label").collect()}  # a row for each unit
    into, moved, fresh = {}, [], max(names, default=-1) + 1
    members: dict[int, list[int]] = {}
    for op in log.done:
        if op["op"] == "label":
            names[op["unit"]] = label(op["name"])
        elif op["op"] == "merge":
            for u in op["units"]:
                into[u] = fresh
                names.pop(u, None)
            members[fresh], names[fresh] = list(op["units"]), "unsorted"
            fresh += 1
        elif op["op"] == "unmerge":
            for u in members.pop(op["unit"], []):
                into.pop(u, None)
                names[u] = "unsorted"
            names.pop(op["unit"], None)
        elif op["op"] == "split":
            moved += [(op["unit"], s, fresh) for s in op["samples"]]
            names[fresh] = "unsorted"
            fresh += 1
        else:
            raise ValueError(f"no operation called {op['op']}")

    def last(u: int) -> int:
        while u in into:
            u = into[u]
        return u

    out = spikes.withColumn("origin", F.col("unit"))
    if moved:
        out = out.join(spark.createDataFrame(moved, "unit long, s long, _to long"), ["unit", "s"], "left").withColumn("unit", F.coalesce("_to", "unit")).drop("_to")
    if into:
        table = spark.createDataFrame([(u, last(u)) for u in into], "unit long, _to long")
        out = out.join(table, "unit", "left").withColumn("unit", F.coalesce("_to", "unit")).drop("_to")
    return spark.createDataFrame(sorted(names.items()), "unit long, label string"), out


def in_polygon(rows: DataFrame, x: str, y: str, corners: Sequence[tuple[float, float]]) -> DataFrame:
    """Rows inside a polygon, by crossings of a ray."""
    inside = F.lit(0)
    for (x1, y1), (x2, y2) in zip(corners, [*corners[1:], corners[0]]):
        if y1 == y2:
            continue
        crosses = ((F.col(y) < y1) != (F.col(y) < y2)) & (F.col(x) < (F.col(y) - y1) * (x2 - x1) / (y2 - y1) + x1)
        inside = inside + crosses.cast("int")
    return rows.where(inside % 2 == 1)
