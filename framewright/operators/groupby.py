"""Grouped aggregation: partial and final hash aggregates under one ordering rule."""

from __future__ import annotations

from typing import TYPE_CHECKING

from pyspark.sql import functions as F

from ..functions.cells import finite, is_numeric, text_of
from ..plans.ordering import IDX, ORD, linguistic
from .aggregates import Agg, aggregate, grouped

if TYPE_CHECKING:
    from .frame import Frame


class GroupBy:
    def __init__(self, frame: Frame, by: str | list[str], dropna: bool = True, sort: bool = True, as_index: bool = False):
        self.keys = [by] if isinstance(by, str) else list(by)
        if not self.keys:
            raise ValueError("groupby needs at least one key")
        frame._need(self.keys)
        if as_index and len(self.keys) > 1:
            raise ValueError("as_index supports a single key")
        self.frame, self.dropna, self.sort, self.as_index = frame, dropna, sort, as_index

    def _run(self, outputs: dict, python: tuple[str, ...] = ()) -> Frame:
        """Keys, then outputs; an output that is named like a key stands in its place, and the order stays the key's."""
        f = self.frame
        sdf = f.sdf if self.sort else f._ordered().sdf
        if self.dropna:
            for k in self.keys:
                sdf = sdf.where(F.col(f"`{k}`").isNotNull())
        first = [] if self.sort else [F.min(ORD).alias(ORD)]
        hidden = {k: f"__k{i}" if k in outputs else k for i, k in enumerate(self.keys)}
        keys = {hidden[k]: F.col(f"`{k}`") for k in self.keys}
        native, own = ([c.alias(n) for n, c in outputs.items() if (n in python) is own] for own in (False, True))
        out = grouped(sdf, keys, [*native, *first], own) if outputs or first else sdf.select(*[c.alias(n) for n, c in keys.items()]).distinct()
        order = [linguistic(F.col(f"`{hidden[k]}`"), f.dtype(k)) for k in self.keys] if self.sort else [F.col(ORD)]
        names = [*self.keys, *[n for n in outputs if n not in self.keys]]
        if not self.as_index:
            return f._new(out, names, order=order)
        k = self.keys[0]
        label = F.col(f"`{hidden[k]}`") if is_numeric(f.dtype(k)) else text_of(F.col(f"`{hidden[k]}`"), f.dtype(k))
        return f._new(out.withColumn(IDX, label), names if k in outputs else names[1:], index=True, order=order)

    def agg(self, spec: dict[str, Agg]) -> Frame:
        """One aggregate a column: a name, or a Python function of the group's values, or of its values and its rows."""
        self.frame._need(spec)
        cells = self.frame._all()
        outputs = {c: aggregate(how, F.col(f"`{c}`"), self.frame.dtype(c), cells) for c, how in spec.items()}
        return self._run(outputs, tuple(c for c, how in spec.items() if callable(how)))

    def _rest(self, cols: list[str] | None) -> list[str]:
        return list(cols) if cols is not None else [c for c in self.frame.columns if c not in self.keys]

    def _numeric(self, cols: list[str] | None) -> list[str]:
        if cols is not None:
            return list(cols)
        candidates = [c for c in self._rest(None) if is_numeric(self.frame.dtype(c))]
        if not candidates:
            return []
        row = self.frame.sdf.agg(*[F.count(finite(F.col(f"`{c}`"), self.frame.dtype(c))).alias(c) for c in candidates]).first()
        return [c for c in candidates if row[c]]

    def count(self, cols: list[str] | None = None) -> Frame:
        return self.agg({c: "count" for c in self._rest(cols)})

    def sum(self, cols: list[str] | None = None) -> Frame:
        return self.agg({c: "sum" for c in self._numeric(cols)})

    def mean(self, cols: list[str] | None = None) -> Frame:
        return self.agg({c: "mean" for c in self._numeric(cols)})

    def size(self) -> Frame:
        return self._run({"size": F.count(F.lit(1))})
