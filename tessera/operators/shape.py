"""Sets of values, and frames bound together or repeated."""

from __future__ import annotations

from functools import reduce
from itertools import accumulate

from pyspark.sql import functions as F

from tessera import types as t
from tessera.plans.rows import placed_rows, with_positions


def _values(frames) -> tuple[list, str]:
    """Each frame's values as a DataFrame of ``v``, in their common type."""
    flat = [x for y in frames for x in (y if isinstance(y, (list, tuple)) else [y])]
    for x in flat:
        if x.ncols > 1:
            raise ValueError("set functions take frames of one column")
    flat = [x for x in flat if x.ncols]
    kind = t.common(*(x.types[0] for x in flat))
    return [x.df.select(F.col(f"`{x.names[0]}`").cast(kind.simpleString()).alias("v")) for x in flat], flat[0].names[0] if flat else "C0"


def _frame(df, name):
    from tessera.frame import Frame, Order

    return Frame(df.select(F.col("v").alias(name)), order=[Order(F.col(f"`{name}`"))])


def unique(frame):
    """The distinct values of all columns, sorted."""
    from tessera.frame import Frame

    columns = [Frame(frame.df.select(F.col(f"`{n}`"))) for n in frame.names]
    parts, name = _values(columns)
    return _frame(reduce(lambda a, b: a.unionAll(b), parts).distinct(), name)


def union(*frames):
    parts, name = _values(frames)
    return _frame(reduce(lambda a, b: a.unionAll(b), parts).distinct(), name)


def intersect(*frames):
    parts, name = _values(frames)
    return _frame(reduce(lambda a, b: a.intersect(b), parts).distinct(), name)


def setdiff(frame, *frames):
    parts, name = _values([frame, *frames])
    return _frame(reduce(lambda a, b: a.subtract(b), parts[1:], parts[0].distinct()), name)


def symdiff(*frames):
    """Values in an odd number of the frames."""
    parts, name = _values(frames)
    every = reduce(lambda a, b: a.unionAll(b), [p.distinct() for p in parts])
    return _frame(every.groupBy("v").agg(F.count("*").alias("n")).where("n % 2 = 1"), name)


def rbind(*frames, force: bool = False, bynames: bool = True):
    """Rows of all frames, in their order; columns meet by name or by place."""
    from tessera.frame import Frame, Order

    frames = [x for y in frames for x in (y if isinstance(y, (list, tuple)) else [y]) if x is not None]
    names = list(frames[0].names)
    if bynames:
        for x in frames[1:]:
            if set(x.names) != set(frames[0].names) and not force:
                raise ValueError("frames have different columns; force=True fills them with NA")
            names += [n for n in x.names if n not in names]
        columns = [{n: k for n, _, k in x.fields} for x in frames]
        of = [{n: n for n in x.names} for x in frames]
    else:
        width = max(x.ncols for x in frames)
        if any(x.ncols != width for x in frames) and not force:
            raise ValueError("frames have different numbers of columns; force=True fills them with NA")
        names = max((x.names for x in frames), key=len)
        columns = [dict(zip(names, x.types, strict=False)) for x in frames]
        of = [dict(zip(names, x.names, strict=False)) for x in frames]
    kinds = {}
    for n in names:
        try:
            kinds[n] = t.common(*(c[n] for c in columns if n in c))
        except TypeError:
            if not force:
                raise
            kinds[n] = t.STR
    parts = []
    for at, (x, c, o) in enumerate(zip(frames, columns, of, strict=True)):
        placed = with_positions(x.df, [y.sorted() for y in x.order]) if x.order else x.df.withColumn("__pos", F.monotonically_increasing_id())
        parts.append(placed.select(*((t.cast(F.col(f"`{o[n]}`"), c[n], kinds[n]) if n in c else F.lit(None).cast(kinds[n].simpleString())).alias(n) for n in names), F.lit(at).alias("__part"), F.col("__pos").alias("__in")))
    return Frame(reduce(lambda a, b: a.unionAll(b), parts), order=[Order(F.col("__part")), Order(F.col("__in"))])


def cbind(*frames, force: bool = False):
    """Columns of all frames side by side; frames of one row are repeated, others have equally many (or NA, with ``force``)."""
    from tessera.frame import Frame, Order, unique_names

    placed = [placed_rows(x.df, [y.sorted() for y in x.order or ()]) for x in frames]
    counts = [n for _, n in placed]
    most = max(counts)
    if not force and any(n not in (1, most) for n in counts):
        raise ValueError(f"frames have different numbers of rows: {sorted(set(counts))}")
    names = unique_names([n for x in frames for n in x.names])
    starts = list(accumulate((x.ncols for x in frames), initial=0))
    out = None
    for k in sorted(range(len(frames)), key=lambda k: counts[k] == 1 and most > 1):
        columns = [F.col(f"`{c}`").alias(f"__b{starts[k] + m}") for m, c in enumerate(frames[k].names)]
        rows = placed[k][0]
        if counts[k] == 1 and most > 1:
            out = out.crossJoin(F.broadcast(rows.select(*columns)))  # one row
        else:
            part = rows.select("__pos", *columns)
            out = part if out is None else out.join(part, "__pos", "full" if force else "inner")
    return Frame(out.select(*(F.col(f"__b{k}").alias(n) for k, n in enumerate(names)), "__pos"), order=[Order(F.col("__pos"))])


def repeat(frame, n: int):
    """The frame's rows ``n`` times over."""
    from tessera.frame import Frame, Order

    df = frame.df.withColumn("__again", F.explode(F.sequence(F.lit(1), F.lit(n)))) if n > 0 else frame.df.where("false").withColumn("__again", F.lit(0))
    return Frame(df, order=[Order(F.col("__again")), *(frame.order or ())])
