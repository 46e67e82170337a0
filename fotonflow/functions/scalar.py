"""Scalar helpers with IEEE and ONNX-like semantics under Spark's ANSI mode."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def lit(x: Column | float) -> Column:
    return x if isinstance(x, Column) else F.lit(float(x))


def safe_div(a: Column | float, b: Column | float) -> Column:
    """a / b as IEEE doubles: 0/0 is NaN, x/0 is an infinity with the sign of x; null stays null."""
    a, b = lit(a), lit(b)
    zero = F.when((a == 0) | F.isnan(a), float("nan")).otherwise(F.signum(a) * float("inf"))
    return F.when(b == 0, F.when(a.isNotNull(), zero)).otherwise(F.try_divide(a, b))


def clip(x: Column, low: Column | float, high: Column | float) -> Column:
    """x limited to [low, high]; NaN becomes ``high``."""
    return F.least(F.greatest(x, lit(low)), lit(high))


def quantise(x: Column) -> Column:
    """[0, 1] to 0..255, rounding half to even and saturating."""
    return F.least(F.greatest(F.bround(x * 255), F.lit(0)), F.lit(255)).cast("int")


def unsigned32(x: Column) -> Column:
    """The low 32 bits, without the overflow errors of an ANSI cast."""
    return x.bitwiseAND(F.lit(0xFFFFFFFF))


def byte_length(shape: Column, is_float: Column) -> Column:
    """Bytes of a tensor: the product of its shape times four for floats, one otherwise."""
    return F.aggregate(shape, F.lit(1).cast("long"), lambda s, x: s * x) * F.when(is_float, 4).otherwise(1)
