"""Element-wise mathematics. Whole numbers become doubles, a result that is no number is NA."""

from __future__ import annotations

import math as _math

from pyspark.sql import functions as F

from tessera import types as t
from tessera.expr import Expr, mapped, unary

e, pi, tau, nan, inf = _math.e, _math.pi, _math.tau, _math.nan, _math.inf
golden = (1 + 5**0.5) / 2


def _real(k):
    if not t.is_number(k):
        raise TypeError(f"no numbers: {k.simpleString()}")
    return t.FLOAT32 if k == t.FLOAT32 else t.FLOAT64


def _function(name, make):
    def made(x) -> Expr:
        return unary(x, name, lambda c, k: (t.drop_nan(make(c.cast("double")), t.FLOAT64).cast(_real(k).simpleString()), _real(k)))

    made.__name__ = name
    return made


def _log(function, zero: float = 0.0):
    return lambda x: F.when(x == zero, float("-inf")).when(x > zero, function(x))


def _guarded(function):
    """Rounding that leaves infinities as they are and gives doubles."""
    return lambda x: F.when(F.abs(x) < 2.0**53, function(x).cast("double")).otherwise(x)


sin, cos, tan = (_function(n, getattr(F, n)) for n in ("sin", "cos", "tan"))
arcsin, arccos, arctan = _function("arcsin", F.asin), _function("arccos", F.acos), _function("arctan", F.atan)
deg2rad, rad2deg = _function("deg2rad", F.radians), _function("rad2deg", F.degrees)
sinh, cosh, tanh = (_function(n, getattr(F, n)) for n in ("sinh", "cosh", "tanh"))
arsinh, arcosh, artanh = _function("arsinh", F.asinh), _function("arcosh", F.acosh), _function("artanh", F.atanh)
cbrt, exp, expm1 = _function("cbrt", F.cbrt), _function("exp", F.exp), _function("expm1", F.expm1)
exp2 = _function("exp2", lambda x: F.pow(F.lit(2.0), x))
log, log10, log2 = _function("log", _log(F.ln)), _function("log10", _log(F.log10)), _function("log2", _log(F.log2))
log1p = _function("log1p", _log(F.log1p, -1.0))
sqrt, square = _function("sqrt", F.sqrt), _function("square", lambda x: x * x)
fabs = _function("fabs", F.abs)
sign = _function("sign", F.signum)
ceil, floor, rint = _function("ceil", _guarded(F.ceil)), _function("floor", _guarded(F.floor)), _function("rint", F.rint)
trunc = _function("trunc", _guarded(lambda x: F.when(x < 0, F.ceil(x)).otherwise(F.floor(x))))


def _special(name):
    """Functions that Spark lacks, over whole Arrow batches."""

    def value(function):
        def safe(x):
            try:
                return function(x)
            except ValueError:  # poles
                return _math.nan
            except OverflowError:
                return _math.inf

        return safe

    def run(batch):
        import numpy as np
        import pyarrow as pa

        function = np.frompyfunc(value(getattr(_math, name)), 1, 1)
        x = batch.to_numpy(zero_copy_only=False)
        y = np.full(len(x), np.nan)
        known = ~np.isnan(x)
        y[known] = function(x[known]).astype(float)
        return pa.array(y, pa.float64(), from_pandas=True)

    def made(x) -> Expr:
        import pyarrow as pa

        run.__annotations__ = {"batch": pa.Array, "return": pa.Array}
        udf = F.arrow_udf(run, "double")
        return unary(x, name, lambda c, k: (t.drop_nan(udf(c.cast("double")), t.FLOAT64).cast(_real(k).simpleString()), _real(k)))

    made.__name__ = name
    return made


erf, erfc, gamma, lgamma = (_special(n) for n in ("erf", "erfc", "gamma", "lgamma"))


def abs(x) -> Expr:
    def make(c, k):
        if not t.is_number(k):
            raise TypeError("abs takes numbers")
        to = t.INT32 if k == t.BOOL else k
        return F.abs(c.cast(to.simpleString())), to

    return unary(x, "abs", make)


def isna(x) -> Expr:
    return unary(x, "isna", lambda c, k: (c.isNull() | F.isnan(c) if t.is_float(k) else c.isNull(), t.BOOL))


def isinf(x) -> Expr:
    return unary(x, "isinf", lambda c, k: (F.coalesce(F.abs(c) == float("inf"), F.lit(False)) if t.is_float(k) else F.lit(False), t.BOOL))


def isfinite(x) -> Expr:
    return unary(x, "isfinite", lambda c, k: (F.coalesce((F.abs(c) < float("inf")) if t.is_float(k) else c.isNotNull(), F.lit(False)), t.BOOL))


def signbit(x) -> Expr:
    return unary(x, "signbit", lambda c, k: (F.when(c == 0, c.cast("double").cast("string").startswith("-")).otherwise(c < 0), t.BOOL))


def _pair(name, make):
    def made(x, y) -> Expr:
        def both(p):
            k = t.FLOAT32 if t.common(p[0].type, p[1].type) == t.FLOAT32 else t.FLOAT64
            _real(p[0].type), _real(p[1].type)
            return t.drop_nan(make(p[0].column.cast("double"), p[1].column.cast("double")), t.FLOAT64).cast(k.simpleString()), k

        return mapped([x, y], both, name)

    made.__name__ = name
    return made


def _negative(x):
    return (x < 0) | ((x == 0) & x.cast("string").startswith("-"))


def _logadd(base):
    def make(x, y):
        step = F.exp(-F.abs(x - y)) if base == _math.e else F.pow(F.lit(2.0), -F.abs(x - y))
        return F.when(x == y, x + _math.log(2) / _math.log(base)).otherwise(F.greatest(x, y) + F.log1p(step) / _math.log(base))

    return make


atan2, hypot, pow = _pair("atan2", F.atan2), _pair("hypot", F.hypot), _pair("pow", F.pow)
copysign = _pair("copysign", lambda x, y: F.when(_negative(y), -F.abs(x)).otherwise(F.abs(x)))
logaddexp, logaddexp2 = _pair("logaddexp", _logadd(_math.e)), _pair("logaddexp2", _logadd(2.0))
fmod = _pair("fmod", lambda x, y: x % F.when(y != 0, y))
ldexp = _pair("ldexp", lambda x, y: x * F.pow(F.lit(2.0), y))


def isclose(x, y, rtol: float = 1e-5, atol: float = 1e-8) -> Expr:
    def make(p):
        a, b = (q.column.cast("double") for q in p)
        near = (a == b) | (F.abs(a - b) <= atol + rtol * F.abs(b))
        return F.coalesce(near, a.isNull() & b.isNull()), t.BOOL

    return mapped([x, y], make, "isclose")


def round(x, ndigits: int | None = None) -> Expr:
    """Halves to the even digit; without ``ndigits`` to whole numbers."""

    def make(c, k):
        if not t.is_number(k):
            raise TypeError("round takes numbers")
        d = ndigits or 0
        if t.is_float(k):
            y = F.rint(c.cast("double") * 10.0**d) / 10.0**d if d >= 0 else F.rint(c.cast("double") / 10.0**-d) * 10.0**-d
            return (y.try_cast("bigint"), t.INT64) if ndigits is None else (y.cast(k.simpleString()), k)
        if d >= 0:
            return (c.cast("bigint"), t.INT64) if ndigits is None else (c, k)
        return (F.rint(c.cast("double") / 10.0**-d) * 10.0**-d).try_cast(k.simpleString()), k

    return unary(x, "round", make)
