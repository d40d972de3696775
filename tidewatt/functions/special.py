"""Special functions that Spark lacks, as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# The rational approximation 7.1.26 of Abramowitz and Stegun, absolute error below 1.5e-7.
_ERF_P = 0.3275911
_ERF_A = (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)


def erf(x: Column) -> Column:
    t = 1 / (1 + _ERF_P * F.abs(x))
    poly = F.lit(0.0)
    for a in reversed(_ERF_A):
        poly = (poly + a) * t
    return F.signum(x) * (1 - poly * F.exp(-x * x))


def normal_cdf(z: Column) -> Column:
    return (1 + erf(z / math.sqrt(2))) / 2


def normal_pdf(z: Column) -> Column:
    return F.exp(-z * z / 2) / math.sqrt(2 * math.pi)


def logistic(z: Column) -> Column:
    return 1 / (1 + F.exp(-z))


def logit(u: Column) -> Column:
    return F.log(u / (1 - u))
