"""Row positions without a global window, and what runs over a whole frame's rows in blocks of positions."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.plans.tables import cut, small_table

#: Rows of a block; what blocks hand on to each other is one row for each.
BLOCK = 1_000_000


def placed_rows(df: DataFrame, order: list[Column] | None, name: str = "__pos") -> tuple[DataFrame, int]:
    """``df`` with the dense position of each row, from 0, in ``order`` (as read, without one), and the number of rows.

    The rows are sorted, numbered inside their partitions and written once: counts and positions
    then come from the same partitions, whatever the planner would make of a second run. The driver
    adds up one count for each partition.
    """
    spark = df.sparkSession
    fields = [x for x in df.schema if x.name != name]  # positions of before go
    typed = [k for k, x in enumerate(fields) if x.dataType != T.NullType()]
    col = lambda n: F.col(f"`{n}`")
    table = cut((df.orderBy(*order) if order else df).select(*(col(fields[k].name).alias(f"c{k}") for k in typed), F.monotonically_increasing_id().alias("m")), "rows")
    part = F.shiftright("m", 33)
    counts = table.groupBy(part.alias("part")).agg(F.count("*").alias("n")).orderBy("part").collect()
    starts = list(accumulate((r["n"] for r in counts), initial=0))
    bases = small_table(spark, [(r["part"], b) for r, b in zip(counts, starts, strict=False)], "part bigint, base bigint")
    rows = table.withColumn("part", part).join(F.broadcast(bases), "part")  # one row a partition
    place = (F.col("base") + F.col("m").bitwiseAND(F.lit((1 << 33) - 1))).alias(name)
    return rows.select(*((F.col(f"c{k}") if k in set(typed) else F.lit(None)).alias(x.name) for k, x in enumerate(fields)), place), starts[-1]


def with_positions(df: DataFrame, order: list[Column] | None, name: str = "__pos") -> DataFrame:
    return placed_rows(df, order, name)[0]


def in_blocks(df: DataFrame) -> DataFrame:
    """Placed rows with the number of their block."""
    return df.withColumn("__block", F.floor(F.col("__pos") / BLOCK))


def carried(df: DataFrame, carries: list[tuple[Column, object, bool]]) -> DataFrame:
    """Rows with ``__carry0, ...``: what all blocks before theirs (after theirs, if reversed) hand on.

    Each entry is an aggregate of a block, the function that joins those of several, and the direction.
    """
    blocks = df.groupBy("__block").agg(*(a.alias(f"__a{k}") for k, (a, _, _) in enumerate(carries)))
    order = Window.orderBy("__block")  # one row for each block
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(1, Window.unboundedFollowing)
    table = blocks.select("__block", *(join(F.col(f"__a{k}")).over(after if back else before).alias(f"__carry{k}") for k, (_, join, back) in enumerate(carries)))
    return df.join(table, "__block")


def edged(df: DataFrame, edges: list[tuple[Column, int]]) -> DataFrame:
    """Rows with ``__edge0, ...``: the value of a column ``n`` rows before, where that row is in another block."""
    at = F.col("__pos") % BLOCK
    for k, (x, n) in enumerate(edges):
        near = df.where(at >= BLOCK - n if n > 0 else at < -n)
        df = df.join(near.select((F.col("__pos") + n).alias("__pos"), x.alias(f"__edge{k}")), "__pos", "left")
    return df


def ranked(df: DataFrame, columns: list[Column]) -> DataFrame:
    """Rows with ``__rank0, ...`` and ``__ranks0, ...``: the place of a value among the sorted distinct ones (no NA), and their number."""
    for k, x in enumerate(columns):
        values = df.select(x.alias("__v")).where("__v is not null").distinct()
        table, n = placed_rows(values, [F.col("__v").asc()], f"__rank{k}")
        df = df.join(table, x == F.col("__v"), "left").drop("__v").withColumn(f"__ranks{k}", F.lit(n))
    return df


def slice_mask(pos: Column, n: Column, part: slice) -> tuple[Column, bool]:
    """Whether a position is in a Python slice of ``n`` rows, and whether the slice runs backwards."""
    step = 1 if part.step is None else part.step
    if step == 0:
        raise ValueError("a slice has no step 0 here")
    low = lambda v: F.lit(v) if v >= 0 else F.greatest(n + v, F.lit(0))
    if step > 0:
        begin = low(part.start or 0)
        mask = pos >= begin
        if part.stop is not None:
            mask &= pos < low(part.stop)
        return (mask & ((pos - begin) % step == 0) if step > 1 else mask), False
    begin = n - 1 if part.start is None else F.least(F.lit(part.start) if part.start >= 0 else n + part.start, n - 1)
    mask = pos <= begin
    if part.stop is not None:
        mask &= pos > (F.lit(part.stop) if part.stop >= 0 else n + part.stop)
    return (mask & ((begin - pos) % -step == 0) if step < -1 else mask), True


def in_groups(df: DataFrame, keys: list[Column], order: list[Column], part) -> tuple[DataFrame, bool]:
    """The rows of each group at an index, or in a slice, of its order."""
    w = Window.partitionBy(*keys)
    if isinstance(part, int):
        if part >= 0:
            return df.withColumn("__n", F.row_number().over(w.orderBy(*order))).where(F.col("__n") == part + 1).drop("__n"), False
        part = slice(part, part + 1 or None)
    if part.step in (None, 1) and (part.start or 0) == 0 and part.stop is not None and part.stop >= 0:
        return df.withColumn("__n", F.row_number().over(w.orderBy(*order))).where(F.col("__n") <= part.stop).drop("__n"), False
    placed = df.withColumn("__n", F.row_number().over(w.orderBy(*order)) - 1).withColumn("__size", F.count("*").over(w))
    mask, backwards = slice_mask(F.col("__n"), F.col("__size"), part)
    return placed.where(mask).drop("__n", "__size"), backwards
