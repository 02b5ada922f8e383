"""Feature preparation on long tables (keys, comid, var, x); a gap is NULL."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline
from pyspark.ml.feature import OneHotEncoder, StringIndexer
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import LinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from shoalmap.operators.blocks import paired_blocks
from shoalmap.session import cut

# Smallest coefficient that counts as selected, and the neighbours used.
SPARSE_MIN = 1e-4
NEIGHBOURS = 10


def feature_columns(df: DataFrame, location: list[str], dropped: list[str], target: str) -> list[str]:
    """All columns but location, dropped ones and the target, in order."""
    out = {*location, *dropped, target}
    return [c for c in df.columns if c not in out]


def impute_middle(features: DataFrame, keys: list[str], how: str = "mean") -> DataFrame:
    """Fill gaps with the mean, or the most frequent value (the smallest on ties), of the variable."""
    if how == "mean":
        middle = features.groupBy(*keys, "var").agg(F.avg("x").alias("_m"))
    else:
        counts = features.filter(F.col("x").isNotNull()).groupBy(*keys, "var", "x").agg(F.count(F.lit(1)).alias("_n"))
        best = F.min(F.struct((-F.col("_n")).alias("n"), "x")).getField("x")
        middle = counts.groupBy(*keys, "var").agg(best.alias("_m"))
    # Written, so that the planner knows how few they are: a join by variable has a task per variable.
    return features.join(cut(middle, "middle"), [*keys, "var"], "left").withColumn("x", F.coalesce("x", "_m")).drop("_m")


def as_vectors(features: DataFrame, keys: list[str], names: list[str]) -> DataFrame:
    """(keys, comid, xs) with a NULL element for every gap."""
    cells = [F.max(F.when(F.col("var") == n, F.col("x"))).alias(f"_x{i}") for i, n in enumerate(names)]
    return features.groupBy(*keys, "comid").agg(*cells).select(*keys, "comid", F.array(*[f"_x{i}" for i in range(len(names))]).alias("xs"))


def _nearest(names: list[str], k: int):
    """Per incomplete vector of one block and gap: its best donors of one donor block."""
    width = len(names)

    def part(q: pd.DataFrame, d: pd.DataFrame) -> pd.DataFrame:
        out = []
        if not d.empty:
            a, b = np.array(q["xs"].tolist(), dtype=float), np.array(d["xs"].tolist(), dtype=float)
            have_a, have_b = ~np.isnan(a), ~np.isnan(b)
            shared = have_a.astype(float) @ have_b.T.astype(float)
            total = np.zeros((len(a), len(b)))
            for f in range(width):
                gap = a[:, None, f] - b[None, :, f]
                total += np.where(have_a[:, None, f] & have_b[None, :, f], gap * gap, 0.0)
            with np.errstate(divide="ignore", invalid="ignore"):
                dist = np.round(np.sqrt(width / shared * total), 9)
            dist[shared == 0] = np.inf
            copies, ties = d["n"].to_numpy(), d["tie"].to_numpy()
            by_tie = np.argsort(ties, kind="stable")
            for f in range(width):
                donors = by_tie[have_b[by_tie, f]]
                if len(donors) == 0:
                    continue
                for row in np.flatnonzero(~have_a[:, f]):
                    # Stable over the tie order: equal distances keep the smaller donor vector first.
                    near = donors[np.argsort(dist[row, donors], kind="stable")[:k]]
                    near = near[np.isfinite(dist[row, near])]
                    out.extend((q["id"].iat[row], names[f], dist[row, j], ties[j], b[j, f], int(copies[j])) for j in near)
        return pd.DataFrame(out, columns=["id", "var", "dist", "tie", "x", "n"])

    return part


def impute_knn(features: DataFrame, keys: list[str], names: list[str], k: int = NEIGHBOURS) -> DataFrame:
    """Fill a gap with the mean of the k nearest rows that have the variable.

    Distance is sqrt(p / shared * sum of squared differences) over the variables both rows have.
    With fewer donors all count; without any the variable's mean is used. Equal rows are one donor
    with a count and equal incomplete rows are one query, so copies cost nothing. Each task returns
    at most k donors per gap. Ties go to the donor with the smaller vector.
    """
    rows = as_vectors(features, keys, names)
    text = F.to_json(F.struct("xs"))
    vectors = rows.withColumn("tie", text).groupBy(*keys, "xs", "tie").agg(F.count(F.lit(1)).alias("n"))
    gaps = vectors.filter(F.exists("xs", lambda x: x.isNull())).select(*keys, F.concat_ws("|", *keys, "tie").alias("id"), "xs")
    parts = paired_blocks(
        gaps, vectors, keys, ["id"], ["tie"], _nearest(names, k), "id string, var string, dist double, tie string, x double, n long"
    )
    # At most k rows per gap and donor block are ranked here.
    order = Window.partitionBy("id", "var").orderBy("dist", "tie")
    before = F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("n")
    used = parts.withColumn("_use", F.least(F.col("n"), F.lit(k) - before)).filter(F.col("_use") > 0)
    filled = used.groupBy("id", "var").agg((F.sum(F.col("x") * F.col("_use")) / F.sum("_use")).alias("_near"))
    means = features.groupBy(*keys, "var").agg(F.avg("x").alias("_mean"))
    ids = rows.select(*keys, "comid", F.concat_ws("|", *keys, text).alias("id"))
    wanted = features.filter(F.col("x").isNull() & F.col("var").isin(*names)).drop("x").join(ids, [*keys, "comid"])
    done = wanted.join(filled, ["id", "var"], "left").join(means, [*keys, "var"], "left")
    done = done.withColumn("x", F.coalesce("_near", "_mean")).select(*features.columns)
    kept = features.filter(~(F.col("x").isNull() & F.col("var").isin(*names)))
    return kept.unionByName(done)


def one_hot(df: DataFrame, cols: list[str]) -> DataFrame:
    """Each text column as a 0/1 vector column `<name>_hot`, one place per category."""
    index = StringIndexer(inputCols=cols, outputCols=[f"{c}_at" for c in cols], stringOrderType="alphabetAsc", handleInvalid="keep")
    hot = OneHotEncoder(inputCols=[f"{c}_at" for c in cols], outputCols=[f"{c}_hot" for c in cols], dropLast=True)
    return Pipeline(stages=[index, hot]).fit(df).transform(df).drop(*[f"{c}_at" for c in cols])


def standardize(features: DataFrame, keys: list[str], population: bool = False) -> DataFrame:
    """(x - mean) / std per variable; std of the sample, or of the population as a scaler has it.
    A variable that does not vary becomes 0."""
    std = F.stddev_pop("x") if population else F.stddev_samp("x")
    stats = features.groupBy(*keys, "var").agg(F.avg("x").alias("_m"), std.alias("_s"))
    z = F.coalesce(F.try_divide(F.col("x") - F.col("_m"), F.col("_s")), F.when(F.col("x").isNotNull(), 0.0))
    return features.join(stats, [*keys, "var"]).withColumn("x", z).drop("_m", "_s")


def build_x_train(truth: DataFrame, features: DataFrame) -> DataFrame:
    """Features of every species' catchments, standardised over the species' own sample."""
    x = truth.select("species", "huc12", "comid").join(features, "comid")
    return standardize(x, ["species"])


def drop_const(features: DataFrame) -> DataFrame:
    """Variables with at least two different values; gaps do not count."""
    varies = features.groupBy("var").agg(F.min("x").alias("lo"), F.max("x").alias("hi")).filter(F.col("lo") < F.col("hi"))
    return features.join(varies.select("var"), "var", "left_semi")


def select_sparse(df: DataFrame, names: list[str], y: str, max_k: int, reg: float = 0.001, copies: str | None = None) -> list[str]:
    """Features a sparse linear fit keeps: |coef| > 1e-4 on the standard scale, at most max_k.

    Equal rows can come as one with their number in the column `copies`.
    """
    df = df.withColumn("_n", F.lit(1.0) if copies is None else F.col(copies).cast("double"))
    data = df.dropna(subset=[*names, y]).select(array_to_vector(F.array(*[F.col(n).cast("double") for n in names])).alias("features"), F.col(y).cast("double").alias("label"), "_n")
    fit = LinearRegression(elasticNetParam=1.0, regParam=reg, standardization=True, weightCol="_n").fit(data)
    known = {n: F.when(F.col(n).isNotNull(), F.col("_n")) for n in names}
    means = df.agg(*[F.try_divide(F.sum(F.col(n) * k), F.sum(k)).alias(n) for n, k in known.items()]).first()
    squares = {n: F.sum(F.pow(F.col(n) - F.lit(means[n]).cast("double"), 2) * k) for n, k in known.items()}
    std = df.agg(*[F.sqrt(F.try_divide(squares[n], F.sum(k) - 1)).alias(n) for n, k in known.items()]).first()
    sizes = sorted(((abs(c) * (std[n] or 0.0), n) for c, n in zip(fit.coefficients, names)), reverse=True)
    chosen = {n for size, n in sizes[:max_k] if size > SPARSE_MIN}
    # With nothing selected the first feature stays, so that a model always has one.
    return [n for n in names if n in chosen] or names[:1]
