"""Strings and regular expressions."""

from __future__ import annotations

import builtins

from pyspark.sql import functions as F

from tessera import types as t
from tessera.expr import Expr, mapped, unary


def _text(k):
    if k not in (t.STR, t.VOID):
        raise TypeError(f"no strings: {k.simpleString()}")


def len(e) -> Expr:
    def make(x, k):
        _text(k)
        return F.char_length(x).cast("bigint"), t.INT64

    return unary(e, "len", make)


def slice_string(e, start=None, stop=None, step=None) -> Expr:
    """``x[start:stop:step]`` of every string; the bounds may be columns."""

    def make(p):
        x, a, b, s = p
        _text(x.type)
        n, x = F.char_length(x.column), x.column
        step_ = F.coalesce(s.column.cast("int"), F.lit(1))
        up = step_ > 0
        bound = lambda v, low, high: F.least(F.greatest(F.when(v < 0, v + n).otherwise(v), low), high)
        begin = F.when(a.column.isNull(), F.when(up, 0).otherwise(n - 1)).otherwise(F.when(up, bound(a.column.cast("int"), F.lit(0), n)).otherwise(bound(a.column.cast("int"), F.lit(-1), n - 1)))
        end = F.when(b.column.isNull(), F.when(up, n).otherwise(-1)).otherwise(F.when(up, bound(b.column.cast("int"), F.lit(0), n)).otherwise(bound(b.column.cast("int"), F.lit(-1), n - 1)))
        if step is None or step == 1 and not isinstance(step, Expr):
            y = F.substring(x, begin + 1, F.greatest(end - begin, F.lit(0)))
        else:
            some = F.when(up, begin < end).otherwise(begin > end) & (step_ != 0)
            places = F.sequence(begin, F.when(up, end - 1).otherwise(end + 1), F.when(step_ != 0, step_))
            y = F.when(some, F.array_join(F.transform(places, lambda i: F.substring(x, i + 1, F.lit(1))), "")).otherwise(F.when(x.isNotNull() & (step_ != 0), ""))
        return y, t.STR

    return mapped([e, start, stop, step], make, "slice")


slice = slice_string


def match(e, pattern: str, icase: bool = False) -> Expr:
    """Whether the whole string matches."""

    def make(x, k):
        _text(k)
        return x.rlike(("(?i)" if icase else "") + f"\\A(?:{pattern})\\z"), t.BOOL

    return unary(e, "match", make)


def split_into_nhot(frame, sep: str = ",", sort: bool = False, most: int = 10_000):
    """A frame of truth values, one column for each token of the strings: sorted, or in the order in which they first appear.

    More than ``most`` different tokens are an error: each is the name of a column, which the driver holds.
    """
    from tessera.frame import Frame, Order

    (name, kind), *more = [(x.name, x.dataType) for x in frame.df.schema if not x.name.startswith("__")]
    if more:
        raise ValueError("split_into_nhot takes one column")
    _text(kind)
    x = F.regexp_replace(F.trim(F.col(f"`{name}`")), r"^[\[({]|[\])}]$", "")
    tokens = F.filter(F.transform(F.split(x, f"[{sep}]"), lambda s: F.regexp_replace(F.trim(s), "^['\"]|['\"]$", "")), lambda s: s != "")
    df = frame.df if frame.order else frame.df.withColumn("__rid", F.monotonically_increasing_id())
    order = frame.order or [Order(F.col("__rid"))]
    df = df.select("*", tokens.alias("__tokens"))
    found = df.select(F.posexplode("__tokens").alias("at", "token"), F.struct(*(o.column for o in order)).alias("row"))
    firsts = found.groupBy("token").agg(F.min(F.struct("row", "at")).alias("first")).orderBy(*(["token"] if sort else ["first"])).select("token").limit(most + 1)
    names = [r["token"] for r in firsts.collect()]
    if builtins.len(names) > most:
        raise ValueError(f"more than {most} different tokens")
    hidden = [c for c in df.columns if c.startswith("__") and c != "__tokens"]
    return Frame(df.select(*hidden, *(o.column.alias(f"__n{k}") for k, o in enumerate(order)), *(F.array_contains("__tokens", n).alias(n) for n in names)), order=[Order(F.col(f"__n{k}"), o.down, o.last) for k, o in enumerate(order)])
