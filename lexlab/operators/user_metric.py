"""A caller's own metric over confusion cells.

A metric is four functions over cells ``(label, pred, n)``: ``zero``, ``update``,
``merge`` and ``finish``.  Cells are counted first (one shuffle of at most a row
per cell and task); each task folds the cells that it has into one state per
group, states of a group are merged in a second, tiny shuffle.  States travel as
JSON, so any state of numbers, strings, lists and dicts with string keys will do.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from typing import Any, Protocol

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexlab.operators.metrics import confusion_cells


class CellMetric(Protocol):
    """Order of cells and of merges must not matter.  Label and prediction may be None."""

    def zero(self) -> Any: ...

    def update(self, state: Any, label: int | None, pred: int | None, n: int) -> Any: ...

    def merge(self, a: Any, b: Any) -> Any: ...

    def finish(self, state: Any) -> float | None: ...


class Marginals:
    """State of the metrics below: ``{class: [hits, labels, predictions]}``, and rows."""

    def zero(self):
        return {"n": 0, "c": {}}

    def update(self, state, label, pred, n):
        state["n"] += n
        for name, k in ((label, 1), (pred, 2)):
            if name is not None:
                got = state["c"].setdefault(str(name), [0, 0, 0])
                got[k] += n
                got[0] += n if k == 1 and label == pred else 0
        return state

    def merge(self, a, b):
        for name, got in b["c"].items():
            a["c"][name] = [x + y for x, y in zip(a["c"].get(name, [0, 0, 0]), got)]
        a["n"] += b["n"]
        return a


class MacroF1(Marginals):
    """The macro-F1 of :mod:`lexlab.operators.metrics`."""

    def finish(self, state):
        f1 = [2 * hits / (labels + preds) for hits, labels, preds in state["c"].values()]
        return sum(f1) / len(f1) if f1 else None


class Matthews(Marginals):
    """Matthews correlation of several classes; 0 where it is not defined."""

    def finish(self, state):
        n, rows = state["n"], state["c"].values()
        hits = sum(r[0] for r in rows)
        both = sum(r[1] * r[2] for r in rows)
        labels, preds = sum(r[1] ** 2 for r in rows), sum(r[2] ** 2 for r in rows)
        down = ((n * n - labels) * (n * n - preds)) ** 0.5
        return (hits * n - both) / down if down else 0.0


def evaluate(preds: DataFrame, metric: CellMetric, group_cols: Sequence[str] = (), name: str = "value",
             label_col: str = "label", pred_col: str = "pred") -> DataFrame:
    """``(groups..., name)``: the metric of every group that has rows."""
    groups = list(group_cols)
    cells = confusion_cells(preds, groups, label_col, pred_col)
    k = len(groups)
    states = T.StructType([cells.schema[c] for c in groups] + [T.StructField("state", T.StringType())])

    def fold(frames):
        held: dict[tuple, Any] = {}
        for batch in frames:
            for *key, label, pred, n in zip(*(c.to_pylist() for c in batch.columns)):
                key = tuple(key)
                held[key] = metric.update(held[key] if key in held else metric.zero(), label, pred, n)
        yield from _rows(held, json.dumps, states)

    def close(frames):
        held: dict[tuple, Any] = {}
        for batch in frames:
            for *key, parts in zip(*(c.to_pylist() for c in batch.columns)):
                state = metric.zero()
                for s in parts:
                    state = metric.merge(state, json.loads(s))
                held[tuple(key)] = metric.finish(state)
                yield from _rows({tuple(key): held.pop(tuple(key))}, float_or_none, done)

    done = T.StructType([cells.schema[c] for c in groups] + [T.StructField(name, T.DoubleType())])
    partial = cells.select(*groups, "label", "pred", "n").mapInArrow(fold, states)
    merged = partial.groupBy(*groups).agg(F.collect_list("state").alias("state"))  # a state per task that has the group
    return merged.filter(F.size("state") > 0).mapInArrow(close, done)


def float_or_none(v) -> float | None:
    return None if v is None else float(v)


def _rows(held: dict[tuple, Any], out, schema: T.StructType):
    from pyspark.sql.pandas.types import to_arrow_schema
    if held:
        columns = list(zip(*((*key, out(v)) for key, v in held.items())))
        arrow = to_arrow_schema(schema)
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow)], schema=arrow)
