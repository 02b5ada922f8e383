"""Scalar maths: labels, transforms, kernels, weights and distance classes."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed value: stands in for results that are not finite.
NOT_FINITE = 1e50


def cast_objects(df: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """String columns become doubles, except the id columns in `keep`."""
    keep = keep or []
    return df.select(
        *[
            F.col(name).try_cast("double").alias(name) if kind == "string" and name not in keep else F.col(name)
            for name, kind in df.dtypes
        ]
    )


def binarize(c: Column, threshold: float) -> Column:
    """0/1 for a threshold above zero, else -1/1."""
    low = 0 if threshold > 0 else -1
    return F.when(c > threshold, F.lit(1)).when(c.isNotNull(), F.lit(low))


def _finite(c: Column) -> Column:
    bad = F.isnan(c) | (F.abs(c) == float("inf"))
    return F.when(bad, F.lit(NOT_FINITE)).otherwise(c)


@dataclass(frozen=True)
class LogShift:
    """Log transforms of a target. `low` is the fitted minimum, a literal or a column.

    kinds: `log` log(x - low + 1); `log1p` the same shift only for a negative minimum, values below it clipped;
    `signed` sign(x) * log(|x|), which does not say the sign of its argument: its inverse is exp(x);
    `signed1p` sign(x) * log1p(|x|), which can be inverted; `exp` / `plain` are exp and natural log. The
    inverse of `exp` is 0 for numbers that have no logarithm.
    """

    kind: str = "log"
    low: Column | float = 0.0

    @staticmethod
    def fit(df: DataFrame, col: str, kind: str = "log") -> LogShift:
        """The minimum stays a scalar subquery, so fitting starts no job of its own."""
        return LogShift(kind, df.agg(F.min(col)).scalar())

    def _low(self) -> Column:
        return self.low if isinstance(self.low, Column) else F.lit(float(self.low))

    def transform(self, c: Column) -> Column:
        if self.kind == "log":
            return _finite(F.ln(c - self._low() + 1))
        if self.kind == "log1p":
            low = F.least(self._low(), F.lit(0.0))
            return _finite(F.log1p(F.greatest(c, low) - low))
        if self.kind == "signed":
            # Zero has no logarithm; a missing value stays missing.
            return F.when(c == 0, F.lit(NOT_FINITE)).otherwise(_finite(F.signum(c) * F.ln(F.abs(c))))
        if self.kind == "signed1p":
            return _finite(F.signum(c) * F.log1p(F.abs(c)))
        if self.kind == "exp":
            return _finite(F.exp(c))
        return _finite(F.ln(c))

    def inverse(self, c: Column) -> Column:
        if self.kind == "log":
            return _finite(F.exp(c) + self._low() - 1)
        if self.kind == "log1p":
            return _finite(F.expm1(c) + F.least(self._low(), F.lit(0.0)))
        if self.kind == "signed1p":
            return _finite(F.signum(c) * F.expm1(F.abs(c)))
        if self.kind == "exp":
            return F.when(c <= 0, F.lit(0.0)).otherwise(_finite(F.ln(c)))
        return _finite(F.exp(c))


def huc_distance(a: Column, b: Column) -> Column:
    """0 for equal codes, else the number of two-digit levels on which they differ."""
    gap = F.abs(a.cast("double") - b.cast("double"))
    return F.when(gap > 0, F.floor(F.log10(gap) / 2) + 1).otherwise(F.lit(0).cast("bigint"))


def scale_distance(dist: Column, how: str, by: Column | float = 1.0) -> Column:
    """`divide` by a number, `ln1` = log(d + 1), `norm1` = share of the largest distance `by`."""
    if how == "ln1":
        return F.log1p(dist)
    if how in ("divide", "norm1"):
        return dist / (by if isinstance(by, Column) else F.lit(float(by)))
    raise ValueError(how)


def gkern(x: Column, h: Column | float) -> Column:
    width = h if isinstance(h, Column) else F.lit(float(h))
    return F.exp(-F.pow(x, 2) / (F.pow(width, 2) * 2))


def diff_score(y: Column, yhat: Column, legacy: bool = False) -> Column:
    """exp(-|yhat - y|), near 1 for a good prediction. `legacy` gives -exp(|yhat - y|)."""
    gap = F.abs(yhat - y)
    return -F.exp(gap) if legacy else F.exp(-gap)


def ci_band(mean: Column, se: Column) -> tuple[Column, Column]:
    return mean - 1.96 * se, mean + 1.96 * se
