"""Reducers: one value for a group, or spread over its rows beside full columns."""

from __future__ import annotations

import builtins
import statistics

from pyspark.sql import functions as F

from tessera import types as t
from tessera.expr import ALL, ONE, Expr, Part, wrap


def _sum_type(k):
    if not t.is_number(k):
        raise TypeError(f"no numbers: {k.simpleString()}")
    return k if t.is_float(k) else t.INT64


def _real(k):
    if not t.is_number(k):
        raise TypeError(f"no numbers: {k.simpleString()}")
    return t.FLOAT32 if k == t.FLOAT32 else t.FLOAT64


def reducer(e, text: str, make, single=None) -> Expr:
    """``make(x, kind, reduce, context)`` for each column; ``single`` is the value for groups of one row (reduced columns)."""

    def resolve(c):
        out = []
        for p in wrap(e).resolve(c):
            if p.mode == ONE and single and not p.key:
                column, kind = single(p.column, p.type)
                out.append(Part(p.name, column, kind, ONE))
                continue
            mode = [ONE]

            def reduce(column, mode=mode):
                column, mode[0] = c.reduce(column)
                return column

            column, kind = make(p.column, p.type, reduce, c)
            out.append(Part(p.name, column, kind, mode[0]))
        return out

    return Expr(resolve, f"{text}(...)")


def _python(e) -> bool:
    """Whether Python's own function is meant: on values, not on columns."""
    return not isinstance(e, (Expr, dict)) and not (isinstance(e, (list, tuple)) and any(isinstance(x, Expr) for x in e))


def sum(e, **more):
    if _python(e):
        return builtins.sum(e, **more)

    def make(x, k, reduce, c):
        to = _sum_type(k)
        # whole numbers beyond 64 bits are NA
        total = reduce(F.sum(x.cast("double" if t.is_float(to) else "decimal(38,0)")) if k == t.INT64 else F.sum(x.cast("double" if t.is_float(to) else "bigint")))
        return F.coalesce(total, F.lit(0)).try_cast(to.simpleString()), to

    return reducer(e, "sum", make, lambda x, k: (F.coalesce(x, F.lit(0)).cast(_sum_type(k).simpleString()), _sum_type(k)))


def prod(e):
    def make(x, k, reduce, c):
        to = _sum_type(k)
        return F.coalesce(reduce(F.product(x.cast("double"))), F.lit(1.0)).try_cast(to.simpleString()), to

    return reducer(e, "prod", make, lambda x, k: (F.coalesce(x, F.lit(1)).cast(_sum_type(k).simpleString()), _sum_type(k)))


def mean(e):
    def make(x, k, reduce, c):
        if k == t.DATE:
            return F.date_from_unix_date(reduce(F.avg(F.unix_date(x))).cast("int")), k
        if k == t.TIME:
            return F.timestamp_micros(reduce(F.avg(F.unix_micros(x.cast("timestamp_ltz")))).cast("bigint")).cast("timestamp_ntz"), k
        return reduce(F.avg(x.cast("double"))).cast(_real(k).simpleString()), _real(k)

    return reducer(e, "mean", make, lambda x, k: (x, k) if t.is_temporal(k) else (x.cast(_real(k).simpleString()), _real(k)))


def _extreme(name, function, python):
    def made(e, *args, **more):
        if args or _python(e):
            return python(e, *args, **more)

        def make(x, k, reduce, c):
            if not (t.is_number(k) or t.is_temporal(k)):
                raise TypeError(f"{name} takes numbers, dates and times")
            return reduce(function(x)), k

        return reducer(e, name, make, lambda x, k: (x, k))

    made.__name__ = name
    return made


min, max = _extreme("min", F.min, builtins.min), _extreme("max", F.max, builtins.max)


def count(e=None) -> Expr:
    if e is None:
        def rows(c):
            column, mode = c.reduce(F.count(F.lit(1)))
            return [Part("count", column, t.INT64, mode)]

        return Expr(rows, "count()")
    return reducer(e, "count", lambda x, k, reduce, c: (reduce(F.count(x)), t.INT64), lambda x, k: (x.isNotNull().cast("bigint"), t.INT64))


def countna(e=None) -> Expr:
    if e is None:
        def rows(c):
            column, mode = c.reduce(F.count(F.lit(None)))
            return [Part("countna", column, t.INT64, mode)]

        return Expr(rows, "countna()")
    return reducer(e, "countna", lambda x, k, reduce, c: (reduce(F.count_if(x.isNull())), t.INT64), lambda x, k: (x.isNull().cast("bigint"), t.INT64))


def nunique(e) -> Expr:
    def make(x, k, reduce, c):
        if c.spread:  # windows take no distinct counts
            return F.size(reduce(F.collect_set(x))).cast("bigint"), t.INT64
        return reduce(F.count_distinct(x)), t.INT64

    return reducer(e, "nunique", make, lambda x, k: (x.isNotNull().cast("bigint"), t.INT64))


def _end(name, function):
    def made(e):
        if _python(e):
            return e[0 if name == "first" else -1]

        def make(x, k, reduce, c):
            c.ordered = True
            order = F.struct(*c.order_values) if c.order else F.col("__rid")
            return reduce(function(F.struct(x.alias("x")), order))["x"], k

        return reducer(e, name, make, lambda x, k: (x, k))

    made.__name__ = name
    return made


first, last = _end("first", F.min_by), _end("last", F.max_by)


def median(e):
    if _python(e):
        return statistics.median(e)
    return reducer(e, "median", lambda x, k, reduce, c: (reduce(F.median(x.cast("double"))).cast(_real(k).simpleString()), _real(k)), lambda x, k: (x.cast(_real(k).simpleString()), _real(k)))


def sd(e) -> Expr:
    return reducer(e, "sd", lambda x, k, reduce, c: (reduce(F.stddev_samp(x.cast("double"))).cast(_real(k).simpleString()), _real(k)), lambda x, k: (F.lit(None).cast("double"), t.FLOAT64))


def _two(name, make) -> object:
    def made(x, y) -> Expr:
        def resolve(c):
            left, right = wrap(x).resolve(c), wrap(y).resolve(c)
            out = []
            for k in range(builtins.max(len(left), len(right))):
                p, q = (s[k if len(s) > 1 else 0] for s in (left, right))
                _real(p.type), _real(q.type)
                modes = []

                def reduce(column, modes=modes):
                    column, mode = c.reduce(column)
                    modes.append(mode)
                    return column

                both = p.column.isNotNull() & q.column.isNotNull()
                a, b = (F.when(both, z.column.cast("double")) for z in (p, q))
                out.append(Part(None, make(a, b, reduce), t.FLOAT64, builtins.max(modes)))
            return out

        return Expr(resolve, f"{name}(...)")

    made.__name__ = name
    return made


cov = _two("cov", lambda a, b, reduce: reduce(F.covar_samp(a, b)))


def _corr(a, b, reduce):
    scale = reduce(F.stddev_samp(a)) * reduce(F.stddev_samp(b))
    return reduce(F.covar_samp(a, b)) / F.when(scale != 0, scale)


corr = _two("corr", _corr)
