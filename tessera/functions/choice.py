"""Conditions, casts and categories."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera import types as t
from tessera.expr import Expr, mapped, wrap


def ifelse(*args) -> Expr:
    """``ifelse(cond1, value1, ..., default)``: the value of the first condition that holds; an NA condition on the way gives NA."""
    if len(args) < 3 or len(args) % 2 == 0:
        raise TypeError("ifelse takes pairs of a condition and a value, then a default")

    def make(p):
        conditions, values = p[0:-1:2], [*p[1:-1:2], p[-1]]
        if any(c.type not in (t.BOOL, t.VOID) for c in conditions):
            raise TypeError("conditions are truth values")
        k = t.common(*(v.type for v in values))
        out = values[-1].column.cast(k.simpleString())
        for c, v in zip(conditions[::-1], values[-2::-1], strict=True):
            out = F.when(c.column, v.column.cast(k.simpleString())).when(c.column.isNotNull(), out)
        return out, k

    return mapped(list(args), make, "ifelse")


def as_type(e, to) -> Expr:
    return wrap(e).as_type(to)


def categories(frame, name: str | None = None):
    """A frame of the sorted distinct values of a column."""
    from tessera.frame import Frame, Order

    name = name or frame.names[0]
    values = frame.df.select(F.col(f"`{name}`").alias(name)).where(F.col(f"`{name}`").isNotNull()).distinct()
    return Frame(values, order=[Order(F.col(f"`{name}`"))])
