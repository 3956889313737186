"""Frames: Spark DataFrames behind one query form, ``DT[i, j, by(...), join(...), sort(...)]``.

Clauses are taken in the order join, by and sort, i, j. The plan is declared and left to Spark:
a grouped query of reducers is an aggregation, one that also has full columns is a window, and
reducers of the whole frame beside full columns are one broadcast row. Assignments rebind the
frame's DataFrame. Rows are ordered only where something asks for their order.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera import types as t
from tessera.expr import ALL, ONE, SCALAR, Context, Expr, Negated, Part, by, f, g, join, select, sort, update, wrap
from tessera.plans.rows import carried, edged, in_blocks, in_groups, placed_rows, ranked, slice_mask, with_positions


def unique_names(names: list[str | None], prefix: str = "C") -> list[str]:
    """Blank names are numbered ``C0, C1, ...``, repeated ones get ``.0, .1, ...``."""
    out: list[str] = []
    taken, k = {n for n in names if n}, 0
    for n in names:
        if not n:
            while f"{prefix}{k}" in taken:
                k += 1
            n = f"{prefix}{k}"
            taken.add(n)
        base, at = n, 0
        while n in out:
            n = f"{base}.{at}"
            at += 1
        out.append(n)
    return out


def _col(name: str) -> Column:
    return F.col(f"`{name}`")


class Order(NamedTuple):
    """A column that rows are ordered by."""

    column: Column
    down: bool = False
    last: bool = False  # NA

    def reversed(self) -> Order:
        return Order(self.column, not self.down, not self.last)

    def sorted(self) -> Column:
        c = self.column
        if self.down:
            return c.desc_nulls_last() if self.last else c.desc_nulls_first()
        return c.asc_nulls_last() if self.last else c.asc_nulls_first()


def _is_table(x) -> bool:
    """Whether ``x`` is columns of values from numpy or pandas, or a range."""
    return isinstance(x, range) or type(x).__module__.partition(".")[0] in ("numpy", "pandas") and getattr(x, "ndim", 0) > 0


def _sorted(order: list[Order] | None) -> list[Column]:
    return [o.sorted() for o in order or ()]


class Frame:
    """An ordered list of named columns. ``source``: a Spark DataFrame, or data for one."""

    def __init__(self, source=None, names=None, order: list[Order] | None = None, key: tuple[str, ...] = (), nan_is_na: bool = False, **columns):
        if source is None:
            source = columns
        if isinstance(source, Frame):
            source, order, key = source.df, source.order, source.key_names
        if not isinstance(source, DataFrame):
            from tessera.sources.python import to_spark

            source, nan_is_na = to_spark(SparkSession.active(), source), True
            order = [Order(F.col("__rid"))] if "__rid" in source.columns else None
        if names:
            visible = [c for c in source.columns if not c.startswith("__")]
            renamed = dict(zip(visible, names, strict=True)) if not isinstance(names, dict) else names
            source = source.select(*(_col(c).alias(renamed.get(c, c)) for c in source.columns))
        if nan_is_na and any(t.is_float(x.dataType) for x in source.schema):
            source = source.select(*(t.drop_nan(_col(x.name), x.dataType).alias(x.name) for x in source.schema))
        self.df, self.order, self.key_names = source, order, tuple(key)

    # ---- what it is ----

    @property
    def fields(self) -> list[tuple[str, str, T.DataType]]:
        return [(x.name, x.name, x.dataType) for x in self.df.schema if not x.name.startswith("__")]

    @property
    def names(self) -> list[str]:
        return [n for n, _, _ in self.fields]

    @names.setter
    def names(self, names):
        if isinstance(names, dict):
            names = [names.get(n, n) for n in self.names]
        self.__init__(self._renamed(unique_names(list(names))))

    def _renamed(self, names: list[str]) -> Frame:
        to = dict(zip(self.names, names, strict=True))
        return Frame(self.df.select(*(_col(c).alias(to.get(c, c)) for c in self.df.columns)), order=self.order, key=tuple(to[k] for k in self.key_names))

    @property
    def types(self) -> list[T.DataType]:
        return [k for _, _, k in self.fields]

    @property
    def stypes(self) -> tuple[T.DataType, ...]:
        return tuple(self.types)

    @property
    def ltypes(self) -> tuple:
        return tuple(map(t.ltype.of, self.types))

    @property
    def ncols(self) -> int:
        return len(self.fields)

    @property
    def nrows(self) -> int:
        return self.df.count()

    @nrows.setter
    def nrows(self, n: int):
        """The first ``n`` rows; beyond the last one, rows of NA."""
        if not isinstance(n, int) or isinstance(n, bool):
            raise TypeError("a number of rows is a whole number")
        if n < 0:
            raise ValueError("a number of rows is not negative")
        if self.key_names:
            raise ValueError("a keyed frame's rows are not added or cut")
        placed, _ = placed_rows(self.df, _sorted(self.order))
        rows = self.df.sparkSession.range(n).withColumnRenamed("id", "__pos")
        self.df = rows.join(placed, "__pos", "left").select(*map(_col, self.names), F.col("__pos").alias("__rid"))
        self.order = [Order(F.col("__rid"))]

    @property
    def shape(self) -> tuple[int, int]:
        return self.nrows, self.ncols

    ndims = 2

    def __len__(self):
        return self.ncols

    def __iter__(self):
        return (self[:, n] for n in self.names)

    def __reversed__(self):
        return (self[:, n] for n in self.names[::-1])

    def __repr__(self):
        return f"Frame[{', '.join(f'{n}: {k.simpleString()}' for n, _, k in self.fields)}]"

    def colindex(self, name) -> int:
        return self.names.index(select(self.fields, name)[0][0])

    def keys(self) -> tuple[str, ...]:
        return tuple(self.names)

    def copy(self, deep: bool = False) -> Frame:
        return Frame(self)

    __copy__ = copy

    def export_names(self):
        return tuple(f[n] for n in self.names)

    def materialize(self, to_memory: bool = False) -> Frame:
        return Frame(self.df.cache(), order=self.order, key=self.key_names)

    # ---- keys ----

    @property
    def key(self) -> tuple[str, ...]:
        return self.key_names

    @key.setter
    def key(self, names):
        """Columns that identify rows: they move to the front, and rows are in their order."""
        if names is None:
            self.key_names = ()
            return
        names = [n for n, _, _ in select(self.fields, [names] if isinstance(names, (str, int)) else list(names))]
        if self.df.groupBy(*map(_col, names)).count().where("count > 1").limit(1).count():
            raise ValueError(f"the values of {', '.join(names)} are not unique")
        self.df = self.df.select(*map(_col, names), *(_col(c) for c in self.df.columns if c not in names))
        self.order, self.key_names = [Order(_col(n)) for n in names], tuple(names)

    # ---- queries ----

    def __getitem__(self, item):
        if not isinstance(item, tuple):
            item = (slice(None), item) if not isinstance(item, Frame) else (item, slice(None))
        if len(item) == 2 and isinstance(item[0], int) and not isinstance(item[0], bool) and isinstance(item[1], (int, str)):
            rows = self[item[0], :]._positioned_rows(item[1])
            return rows
        if len(item) > 1 and (isinstance(item[1], Frame) or _is_table(item[1]) and not isinstance(item[1], range)):
            return self._beside(Frame(item[1]), item)
        return _Query(self, item).result()

    def _beside(self, other: Frame, item: tuple) -> Frame:
        """The columns of a frame of as many rows, or of one, chosen and grouped by this one's rows."""
        from tessera.operators.shape import cbind

        out = cbind(self, other)[(item[0], slice(self.ncols, None), *item[2:])]
        return out._renamed(out.names[: -other.ncols] + other.names)

    def _positioned_rows(self, column):
        name = select(self.fields, column)[0][1]
        rows = self.df.select(_col(name)).take(1)
        return rows[0][0] if rows else None

    def __setitem__(self, item, value):
        _Query(self, item if isinstance(item, tuple) else (slice(None), item)).assign(value)

    def __delitem__(self, item):
        _Query(self, item if isinstance(item, tuple) else (slice(None), item)).delete()

    def sort(self, *cols, **more) -> Frame:
        return self[:, :, sort(*cols, **more)]

    def head(self, n: int = 10) -> Frame:
        return self[:n, :]

    def tail(self, n: int = 10) -> Frame:
        return self[-n:, :] if n else self[:0, :]

    def replace(self, to_replace, replace_with=None) -> None:
        """Values for values, in the columns of their type."""
        if self.key_names:
            raise ValueError("a keyed frame's values are not replaced")
        pairs = list(to_replace.items()) if isinstance(to_replace, dict) else list(zip(to_replace, replace_with if isinstance(replace_with, (list, tuple)) else [replace_with] * len(to_replace), strict=True)) if isinstance(to_replace, (list, tuple)) else [(to_replace, replace_with)]
        out = []
        for c in self.df.schema:
            x = y = _col(c.name)
            k = c.dataType
            for old, new in pairs[::-1]:
                a, b = wrap(old).resolve(None)[0], wrap(new).resolve(None)[0]
                fits = old is None or (k == a.type or t.is_int(k) and t.is_int(a.type) or t.is_float(k) and t.is_float(a.type))
                if fits and not c.name.startswith("__") and (b.type == t.VOID or b.type == k or t.is_number(b.type) and t.is_number(k) and (old is not None or k != t.BOOL)):
                    to = k if b.type == t.VOID else t.common(k, b.type) if t.is_float(b.type) and not t.is_float(k) else k
                    y = F.when(x.eqNullSafe(a.column.cast(k.simpleString())), b.column.cast(to.simpleString())).otherwise(y.cast(to.simpleString()))
            out.append(y.alias(c.name))
        self.df = self.df.select(*out)

    # ---- binding and repeating: see tessera.operators.shape ----

    def rbind(self, *frames, force: bool = False, bynames: bool = True) -> None:
        from tessera.operators.shape import rbind

        if self.key_names:
            raise ValueError("rows are not added to a keyed frame")
        self.df, self.order = rbind(self, *frames, force=force, bynames=bynames).df, None

    def cbind(self, *frames, force: bool = False) -> None:
        from tessera.operators.shape import cbind

        out = cbind(self, *frames, force=force)
        self.df, self.order = out.df, out.order

    # ---- statistics of every column ----

    def _stats(self, name: str, one: bool = False):
        from tessera.operators.stats import statistics

        out = statistics(self, name)
        if not one:
            return out
        if self.ncols != 1:
            raise ValueError(f"{name}1 takes a frame of one column")
        return out.df.first()[0]

    # ---- results ----

    def sorted_df(self) -> DataFrame:
        """Visible columns, in the frame's order if it has one."""
        df = self.df.orderBy(*_sorted(self.order)) if self.order else self.df
        return df.select(*map(_col, self.names))

    def to_spark(self) -> DataFrame:
        """Visible columns, in no order."""
        return self.df.select(*map(_col, self.names))

    def to_tuples(self) -> list[tuple]:
        return [tuple(r) for r in self.sorted_df().collect()]

    def to_list(self) -> list[list]:
        return [list(x) for x in zip(*self.to_tuples(), strict=True)] or [[] for _ in self.names]

    def to_dict(self) -> dict[str, list]:
        return dict(zip(self.names, self.to_list(), strict=True))

    def to_pandas(self):
        return self.sorted_df().toPandas()

    def to_arrow(self):
        return self.sorted_df().toArrow()

    def to_numpy(self, type=None, column=None):
        """All columns, or one, as an array; columns with NA as a masked one."""
        import numpy as np

        frame = self if column is None else self[:, column]
        if type is not None:
            frame = frame[:, f[:].as_type(type)]
        data = frame.to_pandas()
        values, gone = data.to_numpy(), data.isna().to_numpy()
        if gone.any():
            kinds = {k for k in frame.types}
            if all(t.is_int(k) or k == t.BOOL for k in kinds):
                values = data.fillna(0).to_numpy(np.dtype(bool if kinds == {t.BOOL} else np.int64))
            values = np.ma.array(values, mask=gone)
        return values[:, 0] if column is not None else values

    def to_csv(self, path: str = "", **options):
        from tessera.sources.files import to_csv

        return to_csv(self, path, **options)

    def to_jay(self, path: str) -> None:
        from tessera.sources.files import save

        save(self, path)

    def view(self, n: int = 20) -> None:
        self.sorted_df().show(n)


def _stat(name, one):
    def made(self):
        return self._stats(name, one)

    made.__name__ = name + "1" * one
    return made


for _name in ("countna", "sum", "min", "max", "mode", "mean", "sd", "nunique", "nmodal", "skew", "kurt"):
    setattr(Frame, _name, _stat(_name, False))
    setattr(Frame, f"{_name}1", _stat(_name, True))


class _Query:
    """One subscript of a frame."""

    def __init__(self, frame: Frame, item: tuple):
        self.frame, self.df = frame, frame.df
        self.i, self.j = item[0], item[1] if len(item) > 1 else slice(None)
        if type(self.i).__module__.partition(".")[0] in ("numpy", "pandas"):
            self.i = self.i.values.ravel().tolist() if hasattr(self.i, "values") else self.i.ravel().tolist()
        self.by = self.sort = None
        self.joins: list[join] = []
        for x in item[2:]:
            if isinstance(x, (str, Expr)):
                x = by(x)
            if isinstance(x, by):
                self.by = x
            elif isinstance(x, sort):
                self.sort = x
            elif isinstance(x, join):
                self.joins.append(x)
            elif x is not None:
                raise TypeError(f"no clause: {x!r}")
        self.fields, self.joined = frame.fields, []
        self.order = list(frame.order or [])
        self.order_values: list[Column] = []
        for j in self.joins:
            self._join(j)
        self._group_and_sort()

    # ---- join, by and sort ----

    def _join(self, clause: join) -> None:
        other = clause.frame
        if not other.key_names:
            raise ValueError("the joined frame has no key")
        mine = {n: (c, k) for n, c, k in self.fields}
        at = len(self.joined)
        right = other.df.select(*(_col(c).alias(f"__g{at}_{c}") for c in other.names))
        on = []
        for name in other.key_names:
            if name not in mine:
                raise ValueError(f"the frame has no key column {name!r}")
            column, kind = mine[name]
            key = next(k for n, _, k in other.fields if n == name)
            if not (t.is_number(kind) and t.is_number(key)) and not (t.is_temporal(kind) and t.is_temporal(key)) and kind != key:
                raise TypeError(f"{kind.simpleString()} and {key.simpleString()} are not joined")
            both = t.common(kind, key).simpleString() if kind != key else None
            left, other_key = _col(column), _col(f"__g{at}_{name}")
            on.append((left.cast(both) if both else left).eqNullSafe(other_key.cast(both) if both else other_key))
        condition = on[0]
        for x in on[1:]:
            condition &= x
        self.df = self.df.join(right, condition, clause.how)
        self.joined += [(n, f"__g{at}_{n}", k) for n, _, k in other.fields if n not in other.key_names and clause.how not in ("semi", "anti", "left_semi", "left_anti")]

    def _context(self, spread: bool = False) -> Context:
        c = Context(self.fields, self.joined, [k for _, k, _ in self.keys] if hasattr(self, "keys") else [], _sorted(self.order), spread)
        c.order_values = self.order_values
        c._key_columns = getattr(self, "key_columns", frozenset())
        return c

    def _expressions(self, cols) -> list[tuple[Part, bool]]:
        out = []
        for x in cols:
            down = isinstance(x, Negated)
            e = x.inner if down else x if isinstance(x, Expr) else f[x]
            out += [(p, down) for p in e.resolve(self._context())]
        return out

    def _group_and_sort(self) -> None:
        self.keys: list[tuple[str | None, Column, bool]] = []
        self.key_columns = frozenset()
        if self.by:
            found = self._expressions(self.by.cols)
            self.key_columns = frozenset(p.name for p, _ in found if p.name)
            for k, (p, down) in enumerate(found):
                self.keys.append((p.name, p.column, down))
        if self.sort:
            order = []
            for (p, down), back in zip(self._expressions(self.sort.cols), self.sort.reverse if len(self.sort.reverse) > 1 else self.sort.reverse * 1000, strict=False):
                down = down != back
                if self.sort.na_position == "remove":
                    self.df = self.df.where(p.column.isNotNull())
                last = self.sort.na_position == "last"
                order.append(Order(p.column, down, last))
                self.order_values.append(-p.column.cast("double") if down and t.is_number(p.type) else p.column)
            self.order = order + self.order

    # ---- rows ----

    def _need_order(self) -> list[Column]:
        if not self.order:
            if "__rid" not in self.df.columns:
                self.df = self.df.withColumn("__rid", F.monotonically_increasing_id())
            self.order = [Order(F.col("__rid"))]
        return self.order

    def _place(self) -> None:
        """For what depends on the order of rows: a whole frame's rows get positions and blocks."""
        self._need_order()
        if not self.keys:
            self.df = in_blocks(with_positions(self.df, _sorted(self.order)))
            self.order = [Order(F.col("__pos"))]

    def _attached(self, context: Context) -> DataFrame:
        """The rows with all that the context's expressions need from beyond them."""
        df = self.df
        if context.turned:
            df = df.withColumn("__turn", F.row_number().over(context.window()))
        if context.shared:
            df = df.crossJoin(F.broadcast(df.agg(*(c.alias(f"__shared{n}") for n, c in enumerate(context.shared)))))  # one row
        if context.edges:
            df = edged(df, context.edges)
        if context.carries:
            df = carried(df, context.carries)
        if context.ranks:
            df = ranked(df, context.ranks)
        if getattr(context, "number_groups", False):
            df = self._numbered(df, self.keys)
        return df

    def _mask(self) -> Column | None:
        """The condition on rows, if i is one."""
        if isinstance(self.i, Expr):
            parts = self.i.resolve(self._context())
            if len(parts) != 1 or parts[0].type not in (t.BOOL, t.VOID):
                raise TypeError("a filter is one column of truth values")
            return parts[0].column
        return None

    def _everything(self) -> bool:
        return self.i is None or self.i is Ellipsis or self.i == slice(None) if not isinstance(self.i, (Expr, Frame, list)) else False

    def _rows(self) -> None:
        i = self.i
        if isinstance(i, (str, float, dict, type)) or isinstance(i, bool):
            raise TypeError(f"no selector of rows: {i!r}")
        if self._everything():
            return
        mask = self._mask()
        if mask is not None:
            self.df = self.df.where(mask)
            return
        if isinstance(i, range):
            i = slice(i.start, i.stop if i.stop >= 0 else None, i.step)
        if self.keys:
            if not isinstance(i, (int, slice)):
                raise TypeError("rows of groups are chosen by an index, a slice or a filter")
            order = self._need_order()
            self.df, backwards = in_groups(self.df, [k for _, k, _ in self.keys], _sorted(order), i)
            if backwards:
                self.order = [o.reversed() for o in order]
            return
        if isinstance(i, slice) and i.step in (None, 1) and not i.start and i.stop is not None and i.stop >= 0:
            self.df = (self.df.orderBy(*_sorted(self.order)) if self.order else self.df).limit(i.stop)
            return
        if isinstance(i, (int, slice)) and (near := self._near(i)):
            self.df, self.order = near
            return
        placed, n = placed_rows(self.df, _sorted(self.order))
        if isinstance(i, int):
            if not -n <= i < n:
                raise ValueError(f"row {i} of {n}")
            self.df, self.order = placed.where(F.col("__pos") == i % n), []
        elif isinstance(i, slice):
            mask, backwards = slice_mask(F.col("__pos"), F.lit(n), i)
            self.df = placed.where(mask)
            self.order = [Order(F.col("__pos"), backwards)]
        elif isinstance(i, Frame) and i.types == [t.BOOL]:
            other, m = placed_rows(i.df.select(_col(i.names[0]).alias("__keep")), _sorted(i.order))
            if m != n:
                raise ValueError(f"{m} truth values for {n} rows")
            self.df = placed.join(other, "__pos").where("__keep").drop("__keep")
            self.order = [Order(F.col("__pos"))]
        else:
            if isinstance(i, Frame):
                wanted = with_positions(i.df.select(_col(i.names[0]).cast("bigint").alias("__row")), _sorted(i.order), "__at")
                wanted = wanted.withColumn("__row", F.when(F.col("__row") < 0, F.col("__row") + n).otherwise(F.col("__row")))
            else:
                wanted = self.df.sparkSession.createDataFrame(list(enumerate(self._listed(n))), "__at bigint, __row bigint")
            self.df = wanted.join(placed, F.col("__row") == F.col("__pos"))
            self.order = [Order(F.col("__at"))]

    def _near(self, i: int | slice, most: int = 100_000) -> tuple[DataFrame, list[Order]] | None:
        """Rows close to the beginning, or to the end of an ordered frame: only those are sorted out and placed."""
        if isinstance(i, int):
            low, high, back = i, i + 1, False
            if i < 0:
                low, high, back = -i - 1, -i, True
        elif i.step in (None, 1) and (i.start or 0) >= 0 and i.stop is not None and i.stop >= 0:
            low, high, back = i.start or 0, i.stop, False
        elif i.step in (None, 1) and i.stop is None and i.start is not None and i.start < 0:
            low, high, back = 0, -i.start, True
        else:
            return None
        if high > most or back and not self.order:
            return None
        order = [o.reversed() for o in self.order] if back else self.order
        some, n = placed_rows((self.df.orderBy(*_sorted(order)) if order else self.df).limit(high), _sorted(order))
        if isinstance(i, int) and n < high:
            raise ValueError(f"row {i} of {n}")
        return some.where(F.col("__pos") >= low), [Order(F.col("__pos"), back)]

    def _listed(self, n: int) -> list[int]:
        """A list of row numbers, slices, ranges or truth values as row numbers from 0."""
        i = self.i.tolist() if hasattr(self.i, "tolist") else list(self.i)
        if i and all(isinstance(x, bool) for x in i):
            if len(i) != n:
                raise ValueError(f"{len(i)} truth values for {n} rows")
            return [k for k, x in enumerate(i) if x]
        flat = [y for x in i for y in (range(*x.indices(n)) if isinstance(x, slice) else x if isinstance(x, range) else [x])]
        for x in flat:
            if isinstance(x, bool) or not isinstance(x, int):
                raise TypeError(f"no row number: {x!r}")
            if not -n <= x < n:
                raise ValueError(f"row {x} of {n}")
        return [x % n for x in flat]

    # ---- columns ----

    def _expression(self) -> Expr:
        j = self.j
        if j is None or j is Ellipsis or isinstance(j, slice) and j == slice(None):
            keys = {n for n, _, _ in self.keys}
            return Expr(lambda c: [Part(n, _col(column), k) for n, column, k in [*c.fields, *c.joined] if n not in keys])
        if isinstance(j, Expr):
            return j
        if isinstance(j, dict) or isinstance(j, (list, tuple)) and any(isinstance(x, (Expr, dict)) for x in j):
            return wrap(j)
        if isinstance(j, (str, int, slice, range, list, tuple)) or t.is_type(j):
            return f[j]
        return wrap(j)

    def _select(self):
        """Parts of j, with reducers spread if there are full columns too."""
        e = self._expression()
        context = self._context()
        parts = e.resolve(context)
        full = any(p.mode == ALL for p in parts)
        if full and (self.keys or context.reduced):
            context = self._context(spread=True)
            parts = e.resolve(context)
        return parts, context

    def result(self) -> Frame:
        if isinstance(self.j, update):
            return self._assign_columns(self.j.columns)
        self._rows()
        parts, context = self._select()
        if context.ordered:
            self._place()
            parts, context = self._select()
        reduced = any(p.mode == ONE for p in parts) and not context.spread
        keys = [(n, k, d) for n, k, d in self.keys]
        shown = keys if self.by and self.by.add_columns else []
        names = unique_names([n for n, _, _ in shown] + [p.name for p in parts])
        columns = [p.column for p in parts]
        if reduced and keys and all(p.mode != ALL for p in parts) or self.keys and not any(p.mode == ALL for p in parts):
            grouped = self.df.groupBy(*(k.alias(f"__k{n}") for n, (_, k, _) in enumerate(keys)))
            out = grouped.agg(*(c.alias(f"__c{n}") for n, c in enumerate(columns))) if columns else grouped.agg(F.lit(0).alias("__x"))
            kept = [F.col(f"__k{n}") for n in range(len(shown))] + [F.col(f"__c{n}") for n in range(len(columns))]
            hidden = [] if shown else [F.col(f"__k{n}").alias(f"__o{n}") for n in range(len(keys))]
            out = out.select(*(c.alias(n) for c, n in zip(kept, names, strict=True)), *hidden)
            over = [_col(n) for n in names[: len(keys)]] if shown else [F.col(f"__o{n}") for n in range(len(keys))]
            return Frame(out, order=[Order(c, d) for c, (_, _, d) in zip(over, keys, strict=True)])
        if reduced:
            return Frame(self.df.agg(*(c.alias(n) for c, n in zip(columns, names, strict=True))))
        if parts and all(p.mode == SCALAR for p in parts) and self._everything() and not self.keys:
            return Frame(self.df.sparkSession.range(1).select(*(c.alias(n) for c, n in zip(columns, names, strict=True))))
        df = self._attached(context)
        hidden = [k.alias(f"__o{n}") for n, (_, k, _) in enumerate(keys)]
        order = [Order(F.col(f"__o{n}"), d) for n, (_, _, d) in enumerate(keys)]
        for n, o in enumerate(self.order, len(hidden)):
            hidden.append(o.column.alias(f"__o{n}"))
            order.append(Order(F.col(f"__o{n}"), o.down, o.last))
        out = df.select(*(c.alias(n) for c, n in zip([k for _, k, _ in shown] + columns, names, strict=True)), *hidden)
        return Frame(out, order=order or None)

    def _numbered(self, df: DataFrame, keys) -> DataFrame:
        """The number of each group: the distinct keys are numbered apart and joined back."""
        groups = df.groupBy(*(k.alias(f"__k{n}") for n, (_, k, _) in enumerate(keys))).agg(F.lit(0).alias("__z")).drop("__z")
        order = _sorted([Order(F.col(f"__k{n}"), d) for n, (_, _, d) in enumerate(keys)])
        numbered = with_positions(groups, order, "__ngroup")
        numbered = numbered.crossJoin(F.broadcast(groups.agg(F.count("*").alias("__ngroups"))))
        condition = F.lit(True)
        for n, (_, k, _) in enumerate(keys):
            condition &= k.eqNullSafe(F.col(f"__k{n}"))
        return df.join(numbered, condition)

    # ---- assignment and deletion ----

    def _assign_columns(self, values: dict) -> Frame:
        self.j = list(values)
        self.assign(dict(values), named=True)
        return self.frame

    def _targets(self) -> list[str]:
        j = self.j
        if isinstance(j, str):
            return [j]
        if isinstance(j, (list, tuple)) and all(isinstance(x, str) for x in j):
            return list(j)
        return [p.name for p in self._expression().resolve(self._context())]

    def assign(self, value, named: bool = False) -> None:
        targets = self._targets()
        if set(targets) & set(self.frame.key_names):
            raise ValueError("key columns are not assigned")
        mask = self._row_mask()
        kinds = {n: k for n, _, k in self.frame.fields}
        if t.is_type(value):
            if mask is not None:
                raise ValueError("a type is assigned to whole columns")
            to = t.as_type(value)
            parts, context = [Part(n, t.cast(_col(n), kinds[n], to), to) for n in targets], self._context()
        elif not named and (isinstance(value, Frame) or _is_table(value)):
            if mask is not None:
                raise ValueError("a frame is assigned to whole columns")
            parts, context = self._laid(Frame(value)), self._context()
        else:
            e = wrap(value) if not named else wrap([v for v in value.values()])
            context = self._context(spread=True)
            parts = e.resolve(context)
            if context.ordered:
                self._place()
                context = self._context(spread=True)
                parts = e.resolve(context)
        if len(parts) == 1:
            parts = parts * len(targets)
        if len(parts) != len(targets):
            raise ValueError(f"{len(parts)} columns for {len(targets)}")
        df = self._attached(context)
        new = {}
        for n, p in zip(targets, parts, strict=True):
            if mask is None:
                new[n] = p.column
            else:
                old = kinds.get(n, t.VOID)
                if t.VOID not in (old, p.type) and not (t.is_number(old) and t.is_number(p.type)) and old != p.type:
                    raise TypeError(f"{p.type.simpleString()} is not assigned to a column of {old.simpleString()}")
                to = t.common(old, p.type) if not (t.is_int(old) and t.is_int(p.type) and p.mode == SCALAR) else old
                new[n] = F.when(mask, p.column.cast(to.simpleString())).otherwise(_col(n).cast(to.simpleString()) if n in kinds else F.lit(None))
        kept = [c for c in df.columns if not c.startswith("__") or c == "__rid" or c in self.frame.df.columns]
        self.frame.df = df.select(*((new[c].alias(c) if c in new else _col(c)) for c in kept), *(c.alias(n) for n, c in new.items() if n not in kept))

    def _laid(self, other: Frame) -> list[Part]:
        """The columns of a frame of as many rows, laid beside this one's."""
        self.df, n = placed_rows(self.df, _sorted(self.frame.order))
        rows, m = placed_rows(other.df, _sorted(other.order))
        if m != n:
            raise ValueError(f"{m} rows are assigned to {n}")
        columns = [(f"__r{k}", kind) for k, kind in enumerate(other.types)]
        self.df = self.df.join(rows.select("__pos", *(_col(c).alias(f"__r{k}") for k, c in enumerate(other.names))), "__pos")
        if not self.frame.order:  # the order that rows were read in
            self.df = self.df.withColumn("__rid", F.col("__pos"))
            self.frame.order = [Order(F.col("__rid"))]
        return [Part(None, _col(c), kind) for c, kind in columns]

    def _row_mask(self) -> Column | None:
        if self._everything():
            return None
        mask = self._mask()
        if mask is not None:
            return F.coalesce(mask, F.lit(False))
        self.df, n = placed_rows(self.df, _sorted(self.frame.order))
        if isinstance(self.i, int):
            if not -n <= self.i < n:
                raise ValueError(f"row {self.i} of {n}")
            return F.col("__pos") == self.i % n
        if isinstance(self.i, slice):
            return slice_mask(F.col("__pos"), F.lit(n), self.i)[0]
        wanted = self.df.sparkSession.createDataFrame([(x,) for x in sorted(set(self._listed(n)))], "__row bigint").withColumn("__chosen", F.lit(True))
        self.df = self.df.join(wanted, F.col("__row") == F.col("__pos"), "left").drop("__row")
        return F.coalesce("__chosen", F.lit(False))

    def delete(self) -> None:
        whole = isinstance(self.j, slice) and self.j == slice(None) or self.j is None or self.j is Ellipsis
        mask = self._row_mask()
        if mask is None:
            gone = set(self.frame.names if whole else self._targets())
            if gone & set(self.frame.key_names):
                raise ValueError("key columns are not deleted")
            self.frame.df = self.frame.df.drop(*(f"{n}" for n in gone))
        elif whole:
            kept = self.df.where(~mask)
            self.frame.df = kept.select(*map(_col, self.frame.df.columns))
        else:
            gone = set(self._targets())
            self.frame.df = self.df.select(*(F.when(~mask, _col(c)).alias(c) if c in gone else _col(c) for c in self.frame.df.columns))


__all__ = ["Frame", "Order", "by", "f", "g", "join", "sort", "update"]
