"""Bookkeeping of saved model runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shoalmap.operators.aggregates import list_blocks
from shoalmap.operators.numbering import running

# Score of a run without a number as loss, and the exponent of the size term.
NO_LOSS = 1e301
SIZE_POWER = 1.5


def run_score(loss: Column, naive: Column, n: Column, batches: Column) -> Column:
    """ln(loss / naive + 1) over (ln(n^2 * batches))^1.5: low loss on much data scores low."""
    size = F.pow(F.ln(F.pow(n.cast("double"), 2) * batches), SIZE_POWER)
    return F.coalesce(F.ln(loss / naive + 1) / size, F.lit(NO_LOSS))


def with_run_score(runs: DataFrame) -> DataFrame:
    return runs.withColumn("run_score", run_score(F.col("loss"), F.col("naiveloss"), F.col("batch_n"), F.col("batchcount")))


def under_threshold(runs: DataFrame, threshold: str | float | None) -> DataFrame:
    if threshold is None:
        return runs
    limit = F.col("naiveloss") if threshold == "naiveloss" else F.lit(float(threshold))
    return runs.filter(F.col("loss") < limit)


def condense_runs(runs: DataFrame, config: list[str], threshold: str | float | None = None, order: str = "run_seq") -> DataFrame:
    """One run per equal configuration, the one with the lowest run score; the later run wins ties."""
    scored = with_run_score(runs)
    rest = [c for c in scored.columns if c not in config]
    best = F.min(F.struct("run_score", (-F.col(order)).alias("_late"), *[F.col(c).alias(f"r_{c}") for c in rest])).alias("b")
    kept = scored.groupBy(*config).agg(best).select(*config, *[F.col(f"b.r_{c}").alias(c) for c in rest])
    return under_threshold(kept, threshold)


def best_runs(runs: DataFrame, share: float | int, threshold: str | float | None = None, order: str = "run_seq") -> DataFrame:
    """Best share (at least one) or best k runs per species by loss, after the loss filter."""
    kept = under_threshold(runs, threshold)
    sizes = kept.groupBy("species").agg(F.count(F.lit(1)).alias("_n"))
    ranked = running(kept, ["species"], ["loss", order], place=("row", None)).join(sizes, "species")
    quota = F.greatest(F.lit(1), F.floor(F.col("_n") * share)) if share < 1 else F.lit(int(share))
    return ranked.filter(F.col("place") <= quota).drop("_n")


def best_iteration(trace: DataFrame, keys: list[str], step: str, loss: str) -> DataFrame:
    """Per step: its loss, the lowest loss so far and the step that reached it."""
    pair = trace.withColumn("_pair", F.struct(F.col(loss).alias("loss"), F.col(step).alias("step")))
    run = running(pair, keys, [step], _best=("min", "_pair"))
    return run.select(*trace.columns, F.col("_best.loss").alias("best_loss"), F.col("_best.step").alias("best_step"))


def _seconds(after: Column, before: Column) -> Column:
    """Difference in seconds, part by part, so that no time zone comes into it."""
    parts = F.datediff(after, before) * 86400 + (F.hour(after) - F.hour(before)) * 3600 + (F.minute(after) - F.minute(before)) * 60
    second = lambda c: F.extract(F.lit("SECOND"), c).cast("double")
    return parts + (second(after) - second(before))


def save_gap(runs: DataFrame, keys: list[str], when: str = "when_saved", order: str = "run_seq") -> DataFrame:
    """Seconds since the save before, per key."""
    run = running(runs, keys, [when, order], _before=("prev", when))
    return run.select(*runs.columns, _seconds(F.col(when), F.col("_before")).alias("gap_seconds"))


def runs_by_species(runs: DataFrame, size: int = 100_000) -> DataFrame:
    return list_blocks(runs, ["species"], "run_seq", size)


def runs_by_spec(runs: DataFrame, spec: Column, size: int = 100_000) -> DataFrame:
    """Run lists per data specification, keyed by its content id."""
    return list_blocks(runs.withColumn("spec_id", spec), ["spec_id"], "run_seq", size)
