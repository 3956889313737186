"""Types, their promotion, and casts that give NA where a value does not fit."""

from __future__ import annotations

import builtins
import enum

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

VOID, BOOL, INT8, INT16, INT32, INT64 = T.NullType(), T.BooleanType(), T.ByteType(), T.ShortType(), T.IntegerType(), T.LongType()
FLOAT32, FLOAT64, STR, DATE, TIME = T.FloatType(), T.DoubleType(), T.StringType(), T.DateType(), T.TimestampNTZType()
#: Numbers from the narrowest to the widest.
NUMERIC = [BOOL, INT8, INT16, INT32, INT64, FLOAT32, FLOAT64]
#: Names by which a type may be asked for.
ALIASES = {
    None: VOID, "void": VOID, bool: BOOL, "bool": BOOL, "bool8": BOOL, "int8": INT8, "int16": INT16, "int32": INT32, int: INT64, "int": INT64, "int64": INT64,
    "float32": FLOAT32, float: FLOAT64, "float": FLOAT64, "float64": FLOAT64, "double": FLOAT64, str: STR, "str": STR, "str32": STR, "str64": STR, "date32": DATE, "time64": TIME,
}


class Type:
    """Spark's types by the names of frame types."""

    void, bool8, int8, int16, int32, int64 = VOID, BOOL, INT8, INT16, INT32, INT64
    float32, float64, str32, str64, date32, time64 = FLOAT32, FLOAT64, STR, STR, DATE, TIME

    @staticmethod
    def arr32(of) -> T.DataType:
        return T.ArrayType(as_type(of))

    arr64 = arr32


stype = Type


class ltype(enum.Enum):
    """Kinds of types: each selects all columns of its kind, and casts to the widest of them."""

    void, bool, int, real, str, time = "void", "bool", "int", "real", "str", "time"

    def holds(self, k: T.DataType) -> builtins.bool:
        return {"void": k == VOID, "bool": k == BOOL, "int": is_int(k), "real": is_float(k), "str": k == STR, "time": is_temporal(k)}[self.value]

    @classmethod
    def of(cls, k: T.DataType) -> ltype | None:
        return next((x for x in cls if x.holds(k)), None)


_WIDEST = {"void": VOID, "bool": BOOL, "int": INT64, "real": FLOAT64, "str": STR, "time": TIME}


def as_type(x) -> T.DataType:
    """A Spark type from a Python type, a name, a kind or a Spark type."""
    if isinstance(x, T.DataType):
        return x
    if isinstance(x, ltype):
        return _WIDEST[x.value]
    if isinstance(x, str) and x.startswith(("arr32(", "arr64(")):
        return T.ArrayType(as_type(x[6:-1]))
    try:
        return ALIASES[x]
    except (KeyError, TypeError):
        raise TypeError(f"{x!r} is no type") from None


def is_type(x) -> bool:
    return isinstance(x, (T.DataType, ltype)) or isinstance(x, type) and x in ALIASES


def is_int(t: T.DataType) -> bool:
    return t in (INT8, INT16, INT32, INT64)


def is_float(t: T.DataType) -> bool:
    return t in (FLOAT32, FLOAT64)


def is_number(t: T.DataType) -> bool:
    return t in NUMERIC or t == VOID


def is_temporal(t: T.DataType) -> bool:
    return t in (DATE, TIME) or isinstance(t, T.TimestampType)


def common(*types: T.DataType) -> T.DataType:
    """The narrowest type for values of all; TypeError if there is none."""
    out = VOID
    for t in types:
        if t == out or t == VOID:
            continue
        if out == VOID:
            out = t
        elif out in NUMERIC and t in NUMERIC:
            out = max(out, t, key=NUMERIC.index)
        elif is_temporal(out) and is_temporal(t):
            out = TIME
        elif isinstance(out, T.ArrayType) and isinstance(t, T.ArrayType):
            out = T.ArrayType(common(out.elementType, t.elementType))
        else:
            raise TypeError(f"{out.simpleString()} and {t.simpleString()} have no common type")
    return out


def drop_nan(x: Column, t: T.DataType) -> Column:
    """NaN is NA."""
    return F.when(~F.isnan(x), x) if is_float(t) else x


def cast(x: Column, source: T.DataType, to: T.DataType) -> Column:
    """A value in another type, NA where it has none there."""
    if source == to:
        return x
    if to == BOOL:
        if source == STR:
            return F.when(x == "True", True).when(x == "False", False)
        return x != 0 if is_number(source) and source != VOID else x.try_cast("boolean")
    if to == STR and source == BOOL:
        return F.initcap(x.cast("string"))
    if is_temporal(source) and is_number(to):
        return (F.unix_date(x) if source == DATE else F.unix_micros(x.cast("timestamp_ltz")) * 1000).try_cast(to.simpleString())
    if to == DATE and is_int(source):
        return F.date_from_unix_date(x.cast("int"))
    if to == TIME and is_int(source):
        return F.expr("timestamp_ntz'1970-01-01'") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), x.cast("decimal(20,0)") / 1000000000)
    if is_float(source) and is_int(to):
        return x.try_cast(to.simpleString())
    return x.try_cast(to.simpleString())
