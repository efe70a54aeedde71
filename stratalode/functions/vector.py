"""Vector functions as Column expressions over array<float> or array<double>, accumulated in doubles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a.cast("array<double>"), b.cast("array<double>"), lambda x, y: x * y)
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: Column) -> Column:
    """Unit vector in float32; a zero vector is null, so that it can be counted and left out."""
    return F.transform(F.array(norm(a)), lambda n: F.when(n > 0, F.transform(a.cast("array<double>"), lambda x: (x / n).cast("float"))))[0]


def sigmoid(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def erf(x: Column) -> Column:
    """Abramowitz and Stegun 7.1.26; fixed coefficients."""
    t = F.lit(1.0) / (F.lit(1.0) + F.lit(0.3275911) * F.abs(x))
    poly = ((((F.lit(1.061405429) * t - 1.453152027) * t + 1.421413741) * t - 0.284496736) * t + 0.254829592) * t
    return F.signum(x) * (F.lit(1.0) - poly * F.exp(-x * x))


def gelu(x: Column) -> Column:
    return F.lit(0.5) * x * (F.lit(1.0) + erf(x / F.sqrt(F.lit(2.0))))


def layer_norm(v: Column, eps: float = 1e-5) -> Column:
    """A vector with mean 0 and variance 1."""
    n = F.size(v).cast("double")
    mean = F.aggregate(v, F.lit(0.0), lambda s, x: s + x) / n

    def scaled(m: Column) -> Column:
        var = F.aggregate(v, F.lit(0.0), lambda s, x: s + (x - m) * (x - m)) / n
        return F.transform(F.array(F.sqrt(var + eps)), lambda d: F.transform(v, lambda x: (x - m) / d))[0]

    return F.transform(F.array(mean), scaled)[0]
