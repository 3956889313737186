"""Binary operators with the engine's rules for NA, promotion and zero divisors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera import types as t


def _numbers(x, kx, y, ky, least=t.INT32):
    if not (t.is_number(kx) and t.is_number(ky)):
        raise TypeError(f"no numbers: {kx.simpleString()} and {ky.simpleString()}")
    k = t.common(kx, ky, least)
    return x.cast(k.simpleString()), y.cast(k.simpleString()), k


def _wrapping(make):
    """Whole numbers are computed wider; a result that does not fit is NA."""

    def op(x, kx, y, ky):
        if kx == t.STR and ky == t.STR and make == "+":
            return F.concat(x, y), t.STR
        x, y, k = _numbers(x, kx, y, ky)
        if t.is_float(k):
            z = {"+": x + y, "-": x - y, "*": x * y}[make]
            return t.drop_nan(z, k), k
        if k == t.INT64:
            return {"+": F.try_add, "-": F.try_subtract, "*": F.try_multiply}[make](x, y), k
        x, y = x.cast("bigint"), y.cast("bigint")
        return {"+": x + y, "-": x - y, "*": x * y}[make].try_cast("int"), k

    return op


def _divide(x, kx, y, ky):
    x, y, k = _numbers(x, kx, y, ky)
    k = t.FLOAT32 if k == t.FLOAT32 else t.FLOAT64
    x, y = x.cast("double"), y.cast("double")
    quotient = F.when(y != 0, x / F.when(y != 0, y)).when(x > 0, float("inf")).when(x < 0, float("-inf"))
    return t.drop_nan(quotient, t.FLOAT64).cast(k.simpleString()), k


def _whole(x, kx, y, ky):
    x, y, k = _numbers(x, kx, y, ky)
    if t.is_float(k):
        raise TypeError("only whole numbers have // and %")
    return x, F.when(y != 0, y), k


def _floordiv(x, kx, y, ky):
    x, y, k = _whole(x, kx, y, ky)
    x, y = x.cast("bigint"), y.cast("bigint")
    quotient = F.call_function("div", x, y)
    return (quotient - F.when((x % y != 0) & ((x < 0) != (y < 0)), 1).otherwise(0)).cast(k.simpleString()), k


def _mod(x, kx, y, ky):
    x, y, k = _whole(x, kx, y, ky)
    rest = x % y
    return F.when((rest != 0) & ((rest < 0) != (y < 0)), rest + y).otherwise(rest).cast(k.simpleString()), k


def _power(x, kx, y, ky):
    x, y, k = _numbers(x, kx, y, ky)
    k = t.FLOAT32 if k == t.FLOAT32 else t.FLOAT64
    return t.drop_nan(F.pow(x.cast("double"), y.cast("double")), t.FLOAT64).cast(k.simpleString()), k


def _comparable(x, kx, y, ky):
    k = t.common(kx, ky)
    return (x.cast(k.simpleString()), y.cast(k.simpleString())) if k != kx or k != ky else (x, y)


def _compare(make, both_na: bool):
    def op(x, kx, y, ky) -> tuple[Column, T.DataType]:
        x, y = _comparable(x, kx, y, ky)
        return F.coalesce(make(x, y), x.isNull() & y.isNull() if both_na else F.lit(False)), t.BOOL

    return op


def _equal(x, kx, y, ky):
    x, y = _comparable(x, kx, y, ky)
    return x.eqNullSafe(y), t.BOOL


def _bits(name, logic, whole):
    def op(x, kx, y, ky):
        if {kx, ky} <= {t.BOOL, t.VOID}:
            return logic(x.cast("boolean"), y.cast("boolean")), t.BOOL
        k = t.common(kx, ky)
        if not t.is_int(k):
            raise TypeError(f"{name} takes truth values or whole numbers")
        return whole(x.cast(k.simpleString()), y.cast(k.simpleString())), k

    return op


def _shift(name):
    def op(x, kx, y, ky):
        k = t.common(kx, t.INT32)
        if not (t.is_int(k) and t.is_int(t.common(ky, t.INT32))):
            raise TypeError(f"{name} takes whole numbers")
        x, y = x.cast(k.simpleString()), y.cast("int")
        left, right = (F.call_function(n, x, F.abs(y)) for n in ("shiftleft", "shiftright"))
        return F.when(y >= 0, left if name == "<<" else right).otherwise(F.when(y < 0, right if name == "<<" else left)), k

    return op


OPERATORS = {
    "+": _wrapping("+"), "-": _wrapping("-"), "*": _wrapping("*"), "/": _divide, "//": _floordiv, "%": _mod, "**": _power,
    "==": _equal, "!=": lambda *a: (~_equal(*a)[0], t.BOOL),
    "<": _compare(lambda x, y: x < y, False), ">": _compare(lambda x, y: x > y, False),
    "<=": _compare(lambda x, y: x <= y, True), ">=": _compare(lambda x, y: x >= y, True),
    "&": _bits("&", lambda x, y: x & y, lambda x, y: x.bitwiseAND(y)), "|": _bits("|", lambda x, y: x | y, lambda x, y: x.bitwiseOR(y)), "^": _bits("^", lambda x, y: x != y, lambda x, y: x.bitwiseXOR(y)),
    "<<": _shift("<<"), ">>": _shift(">>"),
}
