"""Quality by Bradley-Terry pairwise ranking.

A document is described by a few measures of its text. In the model a document is preferred to another
with a probability that is the logistic function of the difference of their scores, and scores are
linear in the measures. The weights minimise the logistic loss over pairs of a document labelled 1 and
one labelled 0. The threshold is a quantile of the scores of the labelled documents: the share of label
0 lies below it. Scores are mapped to 0..1 so that the threshold is 0.7.

All labelled documents are learned from, none is left out: they are dealt by a hash of doc_id into groups
of about `GROUP` (fewer groups where one label is rare, so that each has both), and every pair of a group
counts. Sums of loss, gradient and curvature are made in the tasks, a Newton step reads one row of sums
per task; quantiles are exact and of all scores.

Defined results: null and empty texts have all measures zero and get a score like any other text; equal
texts score alike. Without labels of both kinds every score is 0.7. Labels that are null are not learned
from; a doc_id with several label rows has their smallest quality.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DoubleType, StructField, StructType

from shoalmap.operators.numbering import quantiles
from shoalmap.session import cut

GROUP = 256
# Rarer label's documents expected in a group at least.
RARE = 8
CUT = 0.7
# Frequent words of four languages.
COMMON = frozenset(
    b"the of and to in a is that for it on was be with as by this are at from der die und das den von zu mit ist ein eine "
    b"le la les de des et un une du que est en el los las y se del por para con".split()
)
_UPPER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_LOWER = b"abcdefghijklmnopqrstuvwxyz"
_DIGIT = b"0123456789"
_MARKS = (b"!?", b".,;:", b"|", b"%&$*#@^~<>=+/\\_{}[]", b"\n", bytes(range(128, 256)))


def measures(text: str | None) -> list[float]:
    """Shares of kinds of bytes, words and lines, and their sizes on a log scale."""
    data = text.encode() if text else b""
    words = data.split()
    if not words:
        return [0.0] * N_MEASURES
    n = len(data)
    share = lambda kind: 1 - len(data.translate(None, kind)) / n
    low = [w.lower() for w in words]
    distinct = set(low)
    lines = [x for x in data.split(b"\n") if x]
    common = sum(map(COMMON.__contains__, low)) / len(words)
    sizes = list(map(len, words))
    pairs = len(set(zip(low, low[1:], strict=False))) / max(1, len(low) - 1) if len(low) > 1 else 1.0
    values = [
        np.log1p(len(words)), min(len(words), 20) / 20, np.log1p(n / len(words)), np.log1p(max(sizes)),
        len(distinct) / len(words), pairs, common, min(common, 0.1) * 10, 1 - len(set(lines)) / len(lines), np.log1p(n / len(lines)),
        share(_UPPER), share(_LOWER), share(_DIGIT), *map(share, _MARKS), float(sum(w[-1] in b".!?" for w in words) / len(words)),
    ]
    return [float(v) for v in values]


N_MEASURES = 13 + len(_MARKS) + 1


def table_of(texts: list[str | None]) -> np.ndarray:
    return np.array([measures(t) for t in texts], dtype=np.float64).reshape(len(texts), N_MEASURES)


@dataclass
class Ranking:
    middle: np.ndarray
    scale: np.ndarray
    weight: np.ndarray
    threshold: float
    steepness: float

    def raw(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.middle) / self.scale, -6, 6) @ self.weight

    def score(self, x: np.ndarray) -> np.ndarray:
        z = self.steepness * (self.raw(x) - self.threshold) + np.log(CUT / (1 - CUT))
        return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def newton(sums: Callable[[np.ndarray], np.ndarray], width: int, pairs: int, ridge: float = 1.0, tolerance: float = 1e-8) -> np.ndarray:
    """Weights that minimise a loss whose value, gradient and curvature at w are `sums(w)`, flattened."""

    def at(w):
        got = sums(w)
        return got[0] + 0.5 * ridge * w @ w, got[1 : 1 + width] + ridge * w, got[1 + width :].reshape(width, width) + ridge * np.eye(width)

    w = np.zeros(width)
    now, gradient, curve = at(w)
    while np.abs(gradient).max() > tolerance * pairs:
        step, size = np.linalg.solve(curve, gradient), 1.0
        while (tried := at(w - size * step))[0] > now and size > 1e-10:
            size /= 2
        if size <= 1e-10:
            return w
        w, (now, gradient, curve) = w - size * step, tried
    return w


def pair_sums(up: np.ndarray, down: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Logistic loss of all pairs of a preferred and another row, its gradient and curvature, flattened."""
    width, total = len(w), np.zeros(1 + len(w) + len(w) ** 2)
    # A rare label can have long groups: a few rows meet the others at a time.
    for k in range(0, len(down), 4096):
        some = down[k : k + 4096]
        margin = (up @ w)[:, None] - some @ w
        p = 1 / (1 + np.exp(np.clip(margin, -60, 60)))
        q = p * (1 - p)
        mixed = up.T @ q @ some
        curve = (up * q.sum(axis=1)[:, None]).T @ up + (some * q.sum(axis=0)[:, None]).T @ some - mixed - mixed.T
        total[0] += np.logaddexp(0, -margin).sum()
        total[1 : 1 + width] += some.T @ p.sum(axis=0) - up.T @ p.sum(axis=1)
        total[1 + width :] += curve.ravel()
    return total


def bradley_terry(difference: np.ndarray, ridge: float = 1.0, tolerance: float = 1e-8) -> np.ndarray:
    """Weights that minimise the logistic loss of preferred-minus-other differences, by Newton steps."""
    none = np.zeros((1, difference.shape[1]))
    return newton(lambda w: pair_sums(difference, none, w), difference.shape[1], len(difference), ridge, tolerance)


def task_sums(table: DataFrame, visit: Callable[[dict], np.ndarray]) -> np.ndarray | None:
    """The sum of `visit(row)` over a table; each task sends one row of sums."""

    def run(batches):
        total = None
        for batch in batches:
            for row in batch.to_pylist():
                got = visit(row)
                total = got if total is None else total + got
        if total is not None:
            yield pa.RecordBatch.from_pydict({"sums": pa.array([total.tolist()], pa.list_(pa.float64()))})

    parts = table.mapInArrow(run, "sums array<double>").toArrow()["sums"].to_pylist()
    # Sorted, as tasks end in any order.
    return np.sum(sorted(parts), axis=0) if parts else None


def held_out(doc_id: Column, folds: int = 4, fold: int = 2) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % folds == fold, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, train: Column | None = None, group: int = GROUP) -> Ranking | None:
    """Fit on the labelled documents for which `train` (a condition on doc_id) holds."""
    train = ~held_out(F.col("doc_id")) if train is None else train
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).filter("doc_id IS NOT NULL AND quality IS NOT NULL")
    marks = marks.filter(train).groupBy("doc_id").agg(F.min("quality").alias("quality"))

    def run(batches):
        for batch in batches:
            x = table_of(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "x": pa.array([r.tobytes() for r in x], pa.binary())})

    # Measured before they meet the labels: texts are not shuffled.
    seen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).filter(train)
    rows = seen.mapInArrow(run, "doc_id long, x binary").join(cut(marks, "marks"), "doc_id")
    rows = cut(rows.select("doc_id", (F.col("quality") > 0).alias("good"), "x"), "measured")
    whole = task_sums(rows, lambda r: np.concatenate([[1.0, float(r["good"])], np.frombuffer(r["x"])]))
    if whole is None or whole[1] in (0, whole[0]):
        return None
    n, good, middle = int(whole[0]), int(whole[1]), whole[2:] / whole[0]
    scale = np.sqrt(task_sums(rows, lambda r: (np.frombuffer(r["x"]) - middle) ** 2) / n)
    model = Ranking(middle, np.where(scale > 1e-9, scale, 1.0), np.zeros(N_MEASURES), 0.0, 1.0)
    groups = max(1, min(-(-n // group), min(good, n - good) // RARE))
    side = lambda up: F.array_sort(F.collect_list(F.when(F.col("good") == up, F.struct("doc_id", "x"))))["x"]
    dealt = rows.groupBy(F.pmod(F.xxhash64("doc_id"), F.lit(groups)).alias("group")).agg(side(True).alias("up"), side(False).alias("down"), F.sum(F.col("good").cast("long")).alias("n_up"), F.count(F.lit(1)).alias("n"))
    dealt = cut(dealt.filter((F.col("n_up") > 0) & (F.col("n_up") < F.col("n"))), "dealt")
    pairs = dealt.agg(F.sum(F.col("n_up") * (F.col("n") - F.col("n_up"))).alias("pairs")).first()["pairs"]
    shaped = lambda xs: np.clip((np.frombuffer(b"".join(xs)).reshape(len(xs), N_MEASURES) - model.middle) / model.scale, -6, 6)
    if not pairs:
        return None
    model.weight = newton(lambda w: task_sums(dealt, lambda r: pair_sums(shaped(r["up"]), shaped(r["down"]), w)), N_MEASURES, pairs)

    def raw(batches):
        for batch in batches:
            xs = batch.column("x").to_pylist()
            yield pa.RecordBatch.from_pydict({"raw": pa.array(model.raw(np.frombuffer(b"".join(xs)).reshape(len(xs), N_MEASURES)), pa.float64())})

    places = quantiles(cut(rows.mapInArrow(raw, "raw double"), "raw"), [], "raw", {"at": 1 - good / n, "high": 0.9, "low": 0.1}).first()
    model.threshold = places["at"]
    model.steepness = float(4 / max(places["high"] - places["low"], 1e-9))
    return model


def score(docs: DataFrame, model: Ranking | None) -> DataFrame:
    """doc_id, text and `rest` (the other columns), with score."""
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.struct(*[F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")], F.lit(True).alias("_held")).alias("rest"))
    if model is None:
        return plain.withColumn("score", F.lit(CUT))
    schema = StructType([*plain.schema.fields, StructField("score", DoubleType())])
    out = to_arrow_schema(schema)

    def run(batches):
        for batch in batches:
            values = pa.array(model.score(table_of(batch.column("text").to_pylist())))
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip([*batch.columns, values], out, strict=True)], schema=out)

    return plain.mapInArrow(run, schema)


def quality_digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The columns of the checked query."""
    out = score(docs, fit(docs, labels))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))
