"""Percentiles, intervals and tests as aggregate Columns or exact sums."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..operators.ordering import within
from ..sources.tables import checked, materialise

TOGETHER = 1_000_000  # distinct values of a group that one task ranks
Z95 = 1.959963984540054


def rank_percentiles(df: DataFrame, value: str, points: dict[str, float], by: list[str] | None = None, *, half_even: bool = False, together: int = TOGETHER) -> DataFrame:
    """Values at rank ceil((n-1)p) of each group's sorted values, or at the half-even rounded rank; 0-based ranks. Nulls come first.

    Values are counted first, so what is ranked is the distinct values of a group, not its rows. If a group has more than ``together`` of
    them, all are ranked by the running sums of a total order, whose ranges hold a bounded number of rows each; no task gets a group.
    """
    by = by or []
    counts = materialise(df.groupBy(*by, value).agg(F.count(F.lit(1)).alias("__n")), "counts")
    most = counts.groupBy(*by).agg(F.count(F.lit(1)).alias("d")).agg(F.max("d").alias("d")).first()["d"] or 0
    if most <= together:
        group = W.partitionBy(*by) if by else W.partitionBy(F.lit(0))
        ranked = counts.withColumn("__to", F.sum("__n").over(group.orderBy(value))).withColumn("__all", F.sum("__n").over(group))
    else:
        summed = within(counts, by, [value], F.col("__n"), into="__before", rows_per_range=together)
        totals = materialise(counts.groupBy(*(F.col(b).alias(f"__{b}") for b in by)).agg(F.sum("__n").alias("__all")), "totals")
        same = [F.col(b).eqNullSafe(F.col(f"__{b}")) for b in by] or F.lit(True)  # without groups it is one row
        ranked = summed.join(checked(totals), same).withColumn("__to", F.col("__before") + F.col("__n"))
    aggs = []
    for name, p in points.items():
        position = (F.col("__all") - 1) * F.lit(float(p))
        rank = F.bround(position, 0) if half_even else F.ceil(position)
        aggs.append(F.min(F.when(F.col("__to") > rank, F.col(value))).alias(name))
    return ranked.groupBy(*by).agg(*aggs) if by else ranked.agg(*aggs)


def wilson(successes: Column, total: Column, z: float = Z95) -> tuple[Column, Column]:
    """Bounds of the 95 % interval of a proportion; 0 and 0 without trials."""
    n, p = total.cast("double"), successes / total
    denominator = 1 + z * z / n
    center = (p + z * z / (2 * n)) / denominator
    margin = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / denominator
    low = F.when(total > 0, F.greatest(F.lit(0.0), center - margin)).otherwise(F.lit(0.0))
    return low, F.when(total > 0, F.least(F.lit(1.0), center + margin)).otherwise(F.lit(0.0))


def mcnemar(b: int, c: int) -> float:
    """Exact two-sided binomial test of b against c discordant pairs; 1 without any."""
    n = b + c
    return min(1.0, 2 * sum(math.exp(math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) - n * math.log(2)) for k in range(min(b, c) + 1))) if n else 1.0


def _stirling_error(n: Column) -> Column:
    """ln n! without its Stirling approximation: exact factorials below 16, the asymptotic series from there on."""
    small = F.log(F.factorial(F.least(n, F.lit(15.0)).cast("int")).cast("double")) - (n + 0.5) * F.log(n) + n - 0.5 * math.log(2 * math.pi)
    m = n * n
    series = (1 / 12 - (1 / 360 - (1 / 1260 - (1 / 1680 - F.lit(1 / 1188) / m) / m) / m) / m) / n
    return F.when(n == 0, F.lit(0.0)).when(n < 16, small).otherwise(series)


def _deviance(x: Column, mean: Column) -> Column:
    """x ln(x / mean) + mean - x, without cancellation where x is close to the mean: by the series of the logarithm there."""
    v = (x - mean) / (x + mean)
    near, square = (x - mean) * v, v * v
    terms = sum((2 * x * v * F.pow(square, F.lit(float(k))) / (2 * k + 1) for k in range(1, 13)), F.lit(0.0))
    return F.when(F.abs(v) < 0.1, near + terms).otherwise(F.when(x > 0, x * F.log(F.greatest(x, F.lit(1e-300)) / mean)).otherwise(F.lit(0.0)) + mean - x)


def mcnemar_exact(b: Column, c: Column) -> Column:
    """The same test for each row of a table, in the JVM, whatever the counts are.

    With m the smaller of them and n = b + c, the tail of the binomial distribution is its term at m, taken by Stirling errors and
    deviances (which lose no digits for large n), times 1 + m / (n - m + 1) * (1 + (m - 1) / (n - m + 2) * ...). The product of the first
    k factors is at most exp(-k * k / n), so what comes after 7 * sqrt(n) + 40 of them adds less than 1e-20 and is left out: a row's
    memory grows with the square root of n.
    """
    n, m = (b + c).cast("double"), F.least(b, c).cast("double")
    term = F.exp(_stirling_error(n) - _stirling_error(m) - _stirling_error(n - m) - _deviance(m, n / 2) - _deviance(n - m, n / 2)) * F.sqrt(n / (2 * math.pi * F.greatest(m, F.lit(1.0)) * (n - m)))
    term = F.when(m == 0, F.exp(-n * math.log(2))).otherwise(term)
    steps = F.least(m, F.ceil(7 * F.sqrt(n)) + 40).cast("long")
    factors = F.when(steps > 0, F.sequence(steps, F.lit(1).cast("long"), F.lit(-1).cast("long"))).otherwise(F.array().cast("array<bigint>"))
    nested = F.aggregate(factors, F.lit(1.0), lambda a, k: 1 + a * (m - k + 1) / (n - m + k))
    return F.when(n == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), 2 * term * nested))


def difference_quantiles(n: int, up: int, down: int, points: tuple[float, ...] = (0.025, 0.975)) -> list[int]:
    """Quantiles of the sum of ``n`` draws of +1, -1 and 0 with odds up, down and the rest: the least values whose distribution
    function reaches each point.

    The sum's characteristic function is the n-th power of a draw's, and a Fourier transform turns its values at equally spaced
    angles into probabilities. As many angles as cover 20 standard deviations on either side do: memory grows with the square root of n.
    """
    a, b = up / n, down / n
    mean, deviation = n * (a - b), math.sqrt(n * max(0.0, a + b - (a - b) ** 2))
    reach = min(n, math.ceil(20 * deviation) + 20)
    first, size = math.floor(mean) - reach, 1 << (2 * reach + 3).bit_length()
    angles = 2 * np.pi * np.fft.fftfreq(size)
    draw = (1 - a - b) + a * np.exp(1j * angles) + b * np.exp(-1j * angles)
    with np.errstate(divide="ignore"):
        power = np.exp(n * np.log(draw) - 1j * angles * first)
    chance = np.maximum(np.fft.fft(power).real / size, 0)[: 2 * reach + 3]
    upto = np.cumsum(chance)
    return [first + int(np.searchsorted(upto, p - 1e-12)) for p in points]


def holm(df: DataFrame, p: str, name: str, into: str = "p_holm") -> DataFrame:
    """Holm's step-down adjustment over all rows of a small table of tests; ties go by name."""
    order = W.orderBy(p, name)
    m = F.count(F.lit(1)).over(W.partitionBy(F.lit(0)))
    scaled = df.withColumn("__adj", F.least(F.lit(1.0), (m - F.row_number().over(order) + 1) * F.col(p)))
    return scaled.withColumn(into, F.max("__adj").over(order.rowsBetween(W.unboundedPreceding, 0))).drop("__adj")
