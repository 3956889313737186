"""Statistics of all columns of a frame, as a frame of one row."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera import types as t


def _moments(x):
    n = F.count(x).cast("double")
    return n, F.skewness(x), F.kurtosis(x)


def _skew(x):
    """Bias-corrected; 0 for constants and for two values or fewer."""
    n, g1, _ = _moments(x)
    return F.when(n > 2, F.coalesce(g1 * F.sqrt(n * (n - 1)) / F.when(n > 2, n - 2), F.lit(0.0))).when(n > 0, 0.0)


def _kurt(x):
    n, _, g2 = _moments(x)
    return F.when(n > 3, F.coalesce(((n + 1) * g2 + 6) * (n - 1) / F.when(n > 3, (n - 2) * (n - 3)), F.lit(0.0))).when(n > 0, 0.0)


def statistics(frame, name: str):
    """``name`` is countna, sum, min, max, mean, sd, nunique, skew, kurt, mode or nmodal; NA for columns without it."""
    from tessera.frame import Frame

    df, out = frame.df, []
    if name in ("mode", "nmodal"):  # one aggregation by value for each column, joined as rows of one
        one = df.sparkSession.range(1).select()
        for n, _, k in frame.fields:
            x = F.col(f"`{n}`")
            counts = df.where(x.isNotNull()).groupBy(x.alias("v")).agg(F.count("*").alias("c"))
            best = counts.agg(F.max_by("v", F.struct("c")).alias("x"), F.max("c").alias("c"))
            if name == "mode":
                top = counts.join(F.broadcast(best.select("c")), "c").agg(F.min("v").alias(n))  # ties: the smallest
            else:
                top = best.select(F.coalesce("c", F.lit(0)).alias(n))
            one = one.crossJoin(F.broadcast(top))  # one row each
        return Frame(one)
    for n, _, k in frame.fields:
        x, number = F.col(f"`{n}`"), t.is_number(k) and k != t.VOID
        d = x.cast("double") if number else None
        to = k if t.is_float(k) else t.INT64
        made = {
            "countna": lambda x=x: F.count_if(x.isNull()),
            "nunique": lambda x=x: F.count_distinct(x),
            "sum": lambda d=d, x=x, to=to: F.coalesce(F.sum(d if t.is_float(to) else x.cast("bigint")), F.lit(0)).cast(to.simpleString()) if d is not None else F.lit(None).cast("bigint"),
            "min": lambda x=x, k=k: F.min(x) if t.is_number(k) or t.is_temporal(k) else F.lit(None),
            "max": lambda x=x, k=k: F.max(x) if t.is_number(k) or t.is_temporal(k) else F.lit(None),
            "mean": lambda d=d: F.avg(d) if d is not None else F.lit(None).cast("double"),
            "sd": lambda d=d: F.when(F.count(d) == 1, 0.0).otherwise(F.stddev_samp(d)) if d is not None else F.lit(None).cast("double"),
            "skew": lambda d=d: _skew(d) if d is not None else F.lit(None).cast("double"),
            "kurt": lambda d=d: _kurt(d) if d is not None else F.lit(None).cast("double"),
        }[name]()
        out.append(made.alias(n))
    return Frame(df.agg(*out))
