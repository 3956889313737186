"""Functions over the rows of a group in their order: lags, running totals, fills, bins."""

from __future__ import annotations

import builtins

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera import types as t
from tessera.expr import ALL, Expr, Part, wrap

#: Fixed value: the gap of 32-bit floats at 1, by which bins are closed at one end.
EPSILON = 2.0**-23


def _over(e, text, make) -> Expr:
    return Expr(lambda c: [Part(p.name, *make(p.column, p.type, c), ALL) for p in wrap(e).resolve(c)], f"{text}(...)")


def shift(e, n: int = 1) -> Expr:
    """The value ``n`` rows before (after, if negative)."""
    from tessera.frame import Frame

    if isinstance(e, Frame):
        from tessera.expr import f

        return e[:, shift(f[:], n)]
    return _over(e, "shift", lambda x, k, c: (c.shifted(x, n), k))


def _running(name, function, kind, merge, empty=None):
    def made(e, reverse: bool = False) -> Expr:
        def make(x, k, c):
            to = kind(k)
            y = c.running(function, function, merge, x.cast("double" if t.is_float(to) else "bigint") if empty is not None else x, reverse)
            return (F.coalesce(y, F.lit(empty)) if empty is not None else y).cast(to.simpleString()), to

        return _over(e, name, make)

    made.__name__ = name
    return made


def _sums(k):
    from tessera.functions.reducers import _sum_type

    return _sum_type(k)


def _ordered(k):
    if not (t.is_number(k) or t.is_temporal(k)):
        raise TypeError("running extremes take numbers, dates and times")
    return k


cumsum = _running("cumsum", F.sum, _sums, lambda a, b: a + b, 0)
cumprod = _running("cumprod", F.product, _sums, lambda a, b: a * b, 1)
cummin, cummax = _running("cummin", F.min, _ordered, F.least), _running("cummax", F.max, _ordered, F.greatest)


def cumcount(reverse: bool = False) -> Expr:
    """The number of rows of the group before this one (after it, if reversed)."""

    def resolve(c):
        w = c.window()
        if not c.keys:
            if not reverse:
                return [Part(None, F.col("__pos"), t.INT64)]
            saved, c.spread = c.spread, True
            rows = c.reduce(F.count(F.lit(1)))[0]
            c.spread = saved
            return [Part(None, rows - F.col("__pos") - 1, t.INT64)]
        n = F.row_number().over(w).cast("bigint")
        # a frame from each row to the last would be counted anew for each row
        return [Part(None, F.count(F.lit(1)).over(Window.partitionBy(*c.keys)) - n if reverse else n - 1, t.INT64)]

    return Expr(resolve, "cumcount()")


def ngroup(reverse: bool = False) -> Expr:
    """The number of the row's group in the order of the keys."""

    def resolve(c):
        if not c.keys:
            return [Part(None, F.lit(0).cast("bigint"), t.INT64)]
        c.number_groups = True
        return [Part(None, F.col("__ngroups") - F.col("__ngroup") - 1 if reverse else F.col("__ngroup"), t.INT64)]

    return Expr(resolve, "ngroup()")


def fillna(e, value=None, reverse: bool = False) -> Expr:
    """NA replaced by ``value``, or by the last value before it (after it, if reversed)."""
    if value is not None:
        if reverse:
            raise ValueError("value and reverse exclude each other")
        from tessera.expr import mapped

        def make(p):
            k = t.common(p[0].type, p[1].type)
            return F.coalesce(p[0].column.cast(k.simpleString()), p[1].column.cast(k.simpleString())), k

        return mapped([e, value], make, "fillna")

    def make(x, k, c):
        end, by_place = (F.first, F.min_by) if reverse else (F.last, F.max_by)
        last = lambda y: F.last(y, ignorenulls=True)
        return c.running(last, lambda y: end(y, ignorenulls=True), lambda y, carry: y, x, reverse, lambda y: by_place(y, F.when(y.isNotNull(), F.col("__pos")))), k

    return _over(e, "fillna", make)


def cut(e, nbins=10, bins=None, right_closed: bool = True) -> Expr:
    """The number of the equal-width bin, or of the one between given edges, that holds a value."""

    def resolve(c):
        if c.keys:
            raise NotImplementedError("cut takes the whole frame, not groups")
        parts = wrap(e).resolve(c)
        counts = nbins if isinstance(nbins, (list, tuple)) else [nbins] * len(parts)
        if len(counts) != len(parts):
            raise ValueError(f"{len(counts)} numbers of bins for {len(parts)} columns")
        out = []
        for i, (p, n) in enumerate(zip(parts, counts, strict=True)):
            if not t.is_number(p.type):
                raise TypeError("cut takes numbers")
            x = p.column.cast("double")
            if bins is not None:
                edges = list(bins[i] if isinstance(bins[0], (list, tuple)) else bins)
                if len(edges) < 2 or any(a >= b for a, b in zip(edges, edges[1:], strict=False)):
                    raise ValueError("edges must grow")
                y = F.lit(None).cast("int")
                for j in range(len(edges) - 2, -1, -1):
                    a, b = edges[j], edges[j + 1]
                    y = F.when((x > a) & (x <= b) if right_closed else (x >= a) & (x < b), j).otherwise(y)
            else:
                if n < 1:
                    raise ValueError("nbins is 1 at least")
                saved, c.spread = c.spread, True
                low, high = c.reduce(F.min(x))[0], c.reduce(F.max(x))[0]
                c.spread = saved
                a = (1 - EPSILON) * n / F.when(high != low, high - low)
                # from the closed end, so that a value on an edge falls to its side
                y = ((x - low) * a).cast("int") if not right_closed else (n - 1) + ((x - high) * a).cast("int")
                finite = (F.abs(low) != float("inf")) & (F.abs(high) != float("inf")) & x.isNotNull()
                y = F.when(finite, F.when(low == high, (n - right_closed) // 2).otherwise(y))
            out.append(Part(p.name, y.cast("int"), t.INT32))
        return out

    return Expr(resolve, "cut(...)")


def qcut(e, nquantiles=10) -> Expr:
    """The number of the quantile of distinct values that holds a value."""

    def resolve(c):
        parts = wrap(e).resolve(c)
        counts = nquantiles if isinstance(nquantiles, (list, tuple)) else [nquantiles] * len(parts)
        if len(counts) != len(parts):
            raise ValueError(f"{len(counts)} numbers of quantiles for {len(parts)} columns")
        out = []
        for p, q in zip(parts, counts, strict=True):
            if q < 1:
                raise ValueError("nquantiles is 1 at least")
            x = p.column
            if c.keys:
                w = Window.partitionBy(*c.keys, x.isNull())
                rank = F.dense_rank().over(w.orderBy(x)) - 1
                top = F.dense_rank().over(w.orderBy(x.desc())) + rank  # distinct values
            else:
                rank, top = c.rank(x)
            a = q * (1 - EPSILON) / F.when(top > 1, top - 1)
            y = F.when(x.isNotNull(), F.when(top <= 1, (q - 1) // 2).otherwise((a * rank).cast("int")))
            out.append(Part(p.name, y.cast("int"), t.INT32))
        return out

    return Expr(resolve, "qcut(...)")


def codes(e) -> Expr:
    """The number of a value among the sorted distinct ones."""

    return _over(e, "codes", lambda x, k, c: (c.rank(x)[0].cast("int"), t.INT32))
