"""Functions of columns."""

from tessera.functions import math, strings, times
from tessera.functions.choice import as_type, categories, ifelse
from tessera.functions.math import isna
from tessera.functions.reducers import corr, count, countna, cov, first, last, max, mean, median, min, nunique, prod, sd, sum
from tessera.functions.rowwise import rowall, rowany, rowargmax, rowargmin, rowcount, rowfirst, rowlast, rowmax, rowmean, rowmin, rowsd, rowsum
from tessera.functions.windows import codes, cumcount, cummax, cummin, cumprod, cumsum, cut, fillna, ngroup, qcut, shift

#: What can be called on an expression.
METHODS = {
    f.__name__: f
    for f in (as_type, codes, count, countna, cummax, cummin, cumprod, cumsum, fillna, first, last, max, mean, median, min, nunique, prod, rowall, rowany, rowargmax, rowargmin, rowcount, rowfirst, rowlast, rowmax, rowmean, rowmin, rowsd, rowsum, sd, shift, sum)
} | {"len": strings.len, "re_match": strings.match}
