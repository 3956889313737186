"""Tessera: a data-frame query engine that compiles to Spark plans."""

from tessera.expr import Expr as FExpr
from tessera.expr import Namespace, by, f, g, join, sort, update
from tessera.frame import Frame
from tessera.functions import *  # noqa: F403
from tessera.functions import math, strings, times
from tessera.functions.math import abs, exp, isclose, log, log10
from tessera.functions.strings import split_into_nhot
from tessera.operators.models import kfold, kfold_random
from tessera.operators.shape import cbind, intersect, rbind, repeat, setdiff, symdiff, union, unique
from tessera.sources.files import fread, iread
from tessera.types import Type, ltype, stype
