"""Column expressions: unevaluated until a query gives them a frame, its groups and its order.

An expression resolves to parts, each a name, a Spark column, a type and a mode: ``scalar`` (a
constant), ``one`` (a value for each group) or ``all`` (a value for each row). A query that holds
both of the latter resolves again with reducers spread over the rows of their groups.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera import types as t

SCALAR, ONE, ALL = 0, 1, 2


@dataclass
class Part:
    name: str | None
    column: Column
    type: T.DataType
    mode: int = ALL
    key: bool = False


class Context:
    """What expressions are resolved against."""

    def __init__(self, fields, joined=(), keys=(), order=(), spread=False):
        self.fields, self.joined = list(fields), list(joined)  # of (name, column name, type)
        self.keys, self.order, self.spread = list(keys), list(order), spread
        self.shared: list[Column] = []  # reducers over the whole frame, needed by its rows
        self.ordered = self.reduced = self.turned = False
        # what the rows of a whole frame need from beyond their block: see tessera.plans.rows
        self.carries: list[tuple] = []
        self.edges: list[tuple[Column, int]] = []
        self.ranks: list[Column] = []

    def reduce(self, column: Column) -> tuple[Column, int]:
        """A reducer's value: for the group, or for each of its rows."""
        self.reduced = True
        if not self.spread:
            return column, ONE
        if self.keys:
            return column.over(Window.partitionBy(*self.keys)), ALL
        self.shared.append(column)
        return F.col(f"__shared{len(self.shared) - 1}"), ALL

    def window(self):
        """The rows of a group, or of a block of the whole frame, in their order."""
        self.ordered = True
        if not self.keys:
            return Window.partitionBy("__block").orderBy("__pos")
        return Window.partitionBy(*self.keys).orderBy(*(self.order or [F.col("__rid")]))

    def backwards(self):
        """The same rows from the last one on: frames that end at a row grow with it, those that begin there would be read anew for each."""
        self.ordered = True
        if not self.keys:
            return Window.partitionBy("__block").orderBy(F.col("__pos").desc())
        self.turned = True  # ties stay as they are in window()
        return Window.partitionBy(*self.keys).orderBy(F.col("__turn").desc())

    def running(self, function, join, merge, x: Column, reverse: bool = False, whole=None) -> Column:
        """``function`` of all rows up to each one (from each one on). For a whole frame: of its block's, merged with what the others hand on.

        Reversed, ``function`` meets the rows from the last one on.
        ``join`` joins the results of several blocks, each ``whole(x)`` (``function(x)`` if not given).
        """
        w = self.backwards() if reverse else self.window()
        y = function(x).over(w.rowsBetween(Window.unboundedPreceding, 0))
        if self.keys:
            return y
        self.carries.append(((whole or function)(x), join, reverse))
        carry = F.col(f"__carry{len(self.carries) - 1}")
        return F.when(y.isNull(), carry).when(carry.isNull(), y).otherwise(merge(y, carry))

    def shifted(self, x: Column, n: int) -> Column:
        """The value ``n`` rows before."""
        w = self.window()
        y = F.lag(x, n).over(w) if n >= 0 else F.lead(x, -n).over(w)
        if self.keys or n == 0:
            return y
        from tessera.plans.rows import BLOCK

        at = F.col("__pos") % BLOCK
        self.edges.append((x, n))
        return F.when(at >= n if n > 0 else at < BLOCK + n, y).otherwise(F.col(f"__edge{len(self.edges) - 1}"))

    def rank(self, x: Column) -> tuple[Column, Column]:
        """The place of a value among the sorted distinct ones of the whole frame, and their number."""
        self.ranks.append(x)
        return F.col(f"__rank{len(self.ranks) - 1}"), F.col(f"__ranks{len(self.ranks) - 1}")


class Expr:
    """A column expression; ``resolve(context)`` gives its parts."""

    def __init__(self, resolve: Callable[[Context], list[Part]], text: str = "expr"):
        self.resolve, self.text = resolve, text

    def __repr__(self):
        return f"Expr<{self.text}>"

    def __bool__(self):
        raise TypeError("an expression has no truth value: use & | ~ instead of and, or, not")

    __hash__ = object.__hash__

    def __add__(self, o): return binary("+", self, o)
    def __radd__(self, o): return binary("+", o, self)
    def __sub__(self, o): return binary("-", self, o)
    def __rsub__(self, o): return binary("-", o, self)
    def __mul__(self, o): return binary("*", self, o)
    def __rmul__(self, o): return binary("*", o, self)
    def __truediv__(self, o): return binary("/", self, o)
    def __rtruediv__(self, o): return binary("/", o, self)
    def __floordiv__(self, o): return binary("//", self, o)
    def __rfloordiv__(self, o): return binary("//", o, self)
    def __mod__(self, o): return binary("%", self, o)
    def __rmod__(self, o): return binary("%", o, self)
    def __pow__(self, o): return binary("**", self, o)
    def __rpow__(self, o): return binary("**", o, self)
    def __eq__(self, o): return binary("==", self, o)
    def __ne__(self, o): return binary("!=", self, o)
    def __lt__(self, o): return binary("<", self, o)
    def __le__(self, o): return binary("<=", self, o)
    def __gt__(self, o): return binary(">", self, o)
    def __ge__(self, o): return binary(">=", self, o)
    def __and__(self, o): return binary("&", self, o)
    def __rand__(self, o): return binary("&", o, self)
    def __or__(self, o): return binary("|", self, o)
    def __ror__(self, o): return binary("|", o, self)
    def __xor__(self, o): return binary("^", self, o)
    def __lshift__(self, o): return binary("<<", self, o)
    def __rshift__(self, o): return binary(">>", self, o)
    def __neg__(self): return Negated(self)
    def __pos__(self): return unary(self, "+", lambda x, k: (x, k))
    def __invert__(self): return unary(self, "~", lambda x, k: (~x if k == t.BOOL else F.bitwise_not(x), k))

    def __getitem__(self, item):
        from tessera.functions.strings import slice_string

        if not isinstance(item, slice):
            raise TypeError("only slices of strings can be taken of an expression")
        return slice_string(self, item.start, item.stop, item.step)

    def alias(self, *names: str) -> Expr:
        """The same columns under other names."""

        def resolve(c):
            parts = self.resolve(c)
            if len(parts) != len(names):
                raise ValueError(f"{len(names)} names for {len(parts)} columns")
            return [replace(p, name=n) for p, n in zip(parts, names, strict=True)]

        return Expr(resolve, f"{self.text}.alias{names}")

    def extend(self, other) -> Expr:
        """These columns, then the other's."""
        return Expr(lambda c: [*self.resolve(c), *wrap(other).resolve(c)], f"{self.text}.extend(...)")

    def remove(self, other) -> Expr:
        """These columns but for the other's."""

        def resolve(c):
            gone = {p.name for p in wrap(other).resolve(c)}
            return [p for p in self.resolve(c) if p.name not in gone]

        return Expr(resolve, f"{self.text}.remove(...)")

    def as_type(self, to) -> Expr:
        to = t.as_type(to)
        return unary(self, "as_type", lambda x, k: (t.cast(x, k, to), to))

    def __getattr__(self, name):
        """Functions of columns are methods too: ``f.A.sum()``."""
        import tessera.functions as functions

        if name.startswith("_") or name not in functions.METHODS:
            raise AttributeError(name)
        return lambda *args, **more: functions.METHODS[name](self, *args, **more)


class Negated(Expr):
    """Minus an expression; as a key or in a sort it asks for descending order."""

    def __init__(self, inner: Expr):
        self.inner = inner

        def resolve(c):
            return unary(inner, "-", lambda x, k: (-x.cast(_wide(k).simpleString()), _wide(k))).resolve(c)

        super().__init__(resolve, f"-{inner.text}")


def _wide(k: T.DataType) -> T.DataType:
    if not t.is_number(k):
        raise TypeError(f"no number: {k.simpleString()}")
    return t.common(k, t.INT32)


def wrap(x) -> Expr:
    """An expression of any value that stands for columns or a constant."""
    import datetime

    if isinstance(x, Expr):
        return x
    if isinstance(x, dict):
        def named(c):
            out = []
            for name, value in x.items():
                parts = wrap(value).resolve(c)
                out += [replace(p, name=name if len(parts) == 1 else f"{name}.{p.name}") for p in parts]
            return out

        return Expr(named, "dict")
    if isinstance(x, (list, tuple)):
        return Expr(lambda c: [p for y in x for p in wrap(y).resolve(c)], "list")
    kind = t.VOID if x is None else t.BOOL if isinstance(x, bool) else t.INT32 if isinstance(x, int) and abs(x) < 1 << 31 else t.INT64 if isinstance(x, int) else t.FLOAT64 if isinstance(x, float) else t.STR if isinstance(x, str) else t.TIME if isinstance(x, datetime.datetime) else t.DATE if isinstance(x, datetime.date) else None
    if kind is None:
        raise TypeError(f"no expression: {x!r}")
    value = F.lit(None) if isinstance(x, float) and x != x else F.lit(x) if kind != t.TIME else F.lit(str(x)).cast("timestamp_ntz")
    return Expr(lambda c: [Part(None, value, kind, SCALAR)], repr(x))


class Namespace:
    """Columns of the frame (``f``) or of the joined frame (``g``): ``f.A``, ``f["A"]``, ``f[0]``, ``f[:]``, ``f["A":"C"]``, ``f[int]``, ``f[["A", "B"]]``."""

    def __init__(self, name: str):
        self._name = name

    def __getattr__(self, name):
        if name.startswith("__"):
            raise AttributeError(name)
        return self[name]

    def __getitem__(self, item) -> Expr:
        def resolve(c):
            fields = c.joined if self._name == "g" else c.fields
            if self._name == "g" and not fields:
                raise ValueError("no frame is joined")
            return [Part(n, F.col(f"`{column}`"), k, ONE if column in c.key_columns and not c.spread else ALL, column in c.key_columns) for n, column, k in select(fields, item) if not (isinstance(item, slice) and item == slice(None) and column in c.key_columns)]

        return Expr(resolve, f"{self._name}[{item!r}]")


Context.key_columns = property(lambda self: getattr(self, "_key_columns", frozenset()))


def select(fields: list, item) -> list:
    """Fields by name, place, slice (of names: both ends included, either way round), type, list or mask."""
    names = [x[0] for x in fields]

    def at(x):
        if isinstance(x, str):
            if x not in names:
                import difflib

                near = difflib.get_close_matches(x, names, 2)
                raise KeyError(f"no column {x!r}" + (f"; there is {', '.join(map(repr, near))}" if near else ""))
            return names.index(x)
        if not -len(names) <= x < len(names):
            raise ValueError(f"no column {x} of {len(names)}")
        return x % len(names)

    if isinstance(item, bool):
        raise TypeError("a column is not chosen by a truth value")
    if isinstance(item, (str, int)):
        return [fields[at(item)]]
    if item is None or item is Ellipsis:
        return list(fields)
    if isinstance(item, slice):
        if isinstance(item.start, str) or isinstance(item.stop, str):
            a, b = at(item.start) if item.start is not None else 0, at(item.stop) if item.stop is not None else len(names) - 1
            return fields[a : b + 1] if a <= b else fields[b : a + 1][::-1]
        return fields[item]
    if isinstance(item, range):
        return [fields[at(k)] for k in item]
    if t.is_type(item):
        want = item.holds if isinstance(item, t.ltype) else {int: t.is_int, float: t.is_float}.get(item, lambda k: k == t.as_type(item))
        return [x for x in fields if want(x[2])]
    if isinstance(item, (list, tuple)):
        if item and all(isinstance(x, bool) for x in item):
            if len(item) != len(fields):
                raise ValueError(f"a mask of {len(item)} for {len(fields)} columns")
            return [x for x, m in zip(fields, item, strict=True) if m]
        if len({T.DataType if t.is_type(x) else type(x) for x in item}) > 1:
            raise TypeError("a list of columns mixes kinds of selectors")
        return [y for x in item for y in select(fields, x)]
    raise TypeError(f"no selector of columns: {item!r}")


f, g = Namespace("f"), Namespace("g")


def mapped(exprs: list, make: Callable[[list[Part]], tuple[Column, T.DataType]], text: str) -> Expr:
    """A function of columns, applied column by column; single columns go with many."""

    def resolve(c):
        sides = [wrap(e).resolve(c) for e in exprs]
        width = max(map(len, sides), default=0)
        if any(len(s) not in (1, width) for s in sides):
            raise ValueError(f"{text}: numbers of columns differ: {', '.join(str(len(s)) for s in sides)}")
        out = []
        for k in range(width):
            parts = [s[k if len(s) > 1 else 0] for s in sides]
            column, kind = make(parts)
            named = [p.name for p in parts if p.name]
            out.append(Part(named[0] if named and (len(exprs) == 1 or width > 1) else None, column, kind, max(p.mode for p in parts)))
        return out

    return Expr(resolve, text)


def unary(e, text: str, make: Callable[[Column, T.DataType], tuple[Column, T.DataType]]) -> Expr:
    return mapped([e], lambda p: make(p[0].column, p[0].type), text)


def binary(op: str, left, right) -> Expr:
    from tessera.functions.arithmetic import OPERATORS

    return mapped([left, right], lambda p: OPERATORS[op](p[0].column, p[0].type, p[1].column, p[1].type), op)


class Clause:
    """by, join, sort and update inside a query."""


class by(Clause):
    """Groups by columns or expressions; ``-f.A`` orders them descending."""

    def __init__(self, *cols, add_columns: bool = True):
        self.cols = [x for c in cols for x in (c if isinstance(c, (list, tuple)) else [c])]
        self.add_columns = add_columns


class join(Clause):
    """The left join with a keyed frame on its key columns; ``how`` may name another kind."""

    def __init__(self, frame, how: str = "left"):
        self.frame, self.how = frame, how


class sort(Clause):
    """Order by columns; NA first, last or removed."""

    def __init__(self, *cols, reverse=False, na_position: str = "first"):
        if na_position not in ("first", "last", "remove"):
            raise ValueError("na_position is first, last or remove")
        self.cols = [x for c in cols for x in (c if isinstance(c, (list, tuple)) else [c])]
        self.reverse = list(reverse) if isinstance(reverse, (list, tuple)) else [reverse] * len(self.cols)
        if len(self.reverse) != len(self.cols):
            raise ValueError(f"{len(self.reverse)} values of reverse for {len(self.cols)} columns")
        self.na_position = na_position


class update(Clause):
    """Columns to assign in place."""

    def __init__(self, **columns):
        self.columns = columns
