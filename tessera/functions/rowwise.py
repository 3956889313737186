"""Functions across the columns of a row."""

from __future__ import annotations

from functools import reduce as fold

from pyspark.sql import functions as F

from tessera import types as t
from tessera.expr import Expr, Part, wrap


def _row(args, text, make, kinds=None) -> Expr:
    def resolve(c):
        parts = [p for a in args for p in wrap(a).resolve(c)]
        if kinds == "bool":
            if any(p.type not in (t.BOOL, t.VOID) for p in parts):
                raise TypeError(f"{text} takes truth values")
        elif kinds == "number" and any(not t.is_number(p.type) for p in parts):
            raise TypeError(f"{text} takes numbers")
        k = t.common(*(p.type for p in parts)) if kinds != "any" and parts else t.VOID
        if kinds == "number":
            k = t.common(k, t.INT32)
        xs = [p.column if kinds == "any" else p.column.cast(k.simpleString()) if k != t.VOID else p.column for p in parts]
        column, kind = make(xs, k)
        return [Part(None, column, kind, max((p.mode for p in parts), default=0))]

    return Expr(resolve, f"{text}(...)")


def rowall(*args) -> Expr:
    return _row(args, "rowall", lambda xs, k: (fold(lambda a, b: a & b, [F.coalesce(x, F.lit(False)) for x in xs], F.lit(True)), t.BOOL), "bool")


def rowany(*args) -> Expr:
    return _row(args, "rowany", lambda xs, k: (fold(lambda a, b: a | b, [F.coalesce(x, F.lit(False)) for x in xs], F.lit(False)), t.BOOL), "bool")


def _valid(xs):
    return fold(lambda a, b: a + b, [x.isNotNull().cast("int") for x in xs], F.lit(0))


def rowcount(*args) -> Expr:
    return _row(args, "rowcount", lambda xs, k: (_valid(xs), t.INT32), "any")


def rowfirst(*args) -> Expr:
    return _row(args, "rowfirst", lambda xs, k: (F.coalesce(*xs), k))


def rowlast(*args) -> Expr:
    return _row(args, "rowlast", lambda xs, k: (F.coalesce(*xs[::-1]), k))


def rowmin(*args) -> Expr:
    return _row(args, "rowmin", lambda xs, k: (F.least(*xs) if len(xs) > 1 else xs[0], k), "number")


def rowmax(*args) -> Expr:
    return _row(args, "rowmax", lambda xs, k: (F.greatest(*xs) if len(xs) > 1 else xs[0], k), "number")


def _place(xs, extreme):
    row = F.array(*xs)
    return F.when(_valid(xs) > 0, F.array_position(row, extreme(row)) - 1), t.INT64


def rowargmin(*args) -> Expr:
    return _row(args, "rowargmin", lambda xs, k: _place(xs, F.array_min), "number")


def rowargmax(*args) -> Expr:
    return _row(args, "rowargmax", lambda xs, k: _place(xs, F.array_max), "number")


def _total(xs):
    return fold(lambda a, b: a + b, [F.coalesce(x, F.lit(0)) for x in xs])


def _rowsum(xs, k):
    if t.is_float(k):
        return t.drop_nan(_total([x.cast("double") for x in xs]), t.FLOAT64).cast(k.simpleString()), k
    return _total([x.cast("decimal(38,0)") for x in xs]).try_cast(k.simpleString()), k


def rowsum(*args) -> Expr:
    return _row(args, "rowsum", _rowsum, "number")


def _rowmean(xs):
    n = _valid(xs)
    return _total([x.cast("double") for x in xs]) / F.when(n > 0, n)


def _real(k):
    return t.FLOAT32 if k == t.FLOAT32 else t.FLOAT64


def rowmean(*args) -> Expr:
    return _row(args, "rowmean", lambda xs, k: (t.drop_nan(_rowmean(xs), t.FLOAT64).cast(_real(k).simpleString()), _real(k)), "number")


def rowsd(*args) -> Expr:
    def make(xs, k):
        n, mean = _valid(xs), _rowmean(xs)
        squares = _total([(x.cast("double") - mean) * (x.cast("double") - mean) for x in xs])
        return t.drop_nan(F.sqrt(squares / F.when(n > 1, n - 1)), t.FLOAT64).cast(_real(k).simpleString()), _real(k)

    return _row(args, "rowsd", make, "number")
