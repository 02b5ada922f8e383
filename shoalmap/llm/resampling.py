"""Target-distribution importance resampling over hashed n-grams.

Texts are brought to single spaces: A-Z become lower case and every run of ASCII bytes other than
letters and digits one space. An overlapped regex scan with look-arounds at the word borders then emits
the span of each n-gram, and the CRC of its bytes names its bucket. Each document's buckets are found
once and written as bytes; counts per bucket are summed in the tasks and then over the tasks, so the
tables of counts have `BUCKETS` rows whatever the corpus. A document's weight is the mean gain of its
n-grams, its score the weight plus a Gumbel draw made from its id, and the highest scores are drawn.

Defined results: null texts have no feature, weight 0, and are never drawn unless fewer than `MIN_WORDS`
words are asked for. A null doc_id hashes as an empty one. Rows of equal doc_id are documents of their own;
equal scores go by doc_id (null last), then by features and weight. An empty target has T = 0 and an empty
corpus no rows.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shoalmap.llm.numbers import numbered
from shoalmap.session import cut

BUCKETS = 10_000
SIZES = (1, 1)
MIN_WORDS = 20
PERCENT = 10
SEED = 2024
# Buckets of n-grams kept per task.
CACHE = 200_000
_PLAIN = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def collapsed(text: str | None) -> bytes:
    """The UTF-8 text with A-Z in lower case and single spaces between its words."""
    return b" ".join(text.encode().translate(_PLAIN).split()) if text else b""


def scanner(size: int) -> regex.Pattern:
    """Runs of `size` words between borders; a scan with overlaps starts one at every word."""
    return regex.compile(rb"(?<![^ ])[^ ]++" + rb"(?: [^ ]++){%d}" % (size - 1))


class Buckets(dict):
    """Bucket by n-gram, computed when first asked for."""

    def __init__(self, count: int):
        super().__init__()
        self.count = count

    def __missing__(self, gram: bytes) -> int:
        if len(self) >= CACHE:
            self.clear()
        self[gram] = bucket = zlib.crc32(gram) % self.count
        return bucket


def _scan(id_column: str | None, sizes: tuple[int, int], buckets: int):
    def run(batches):
        patterns = [scanner(n) for n in range(sizes[0], sizes[1] + 1)]
        of = Buckets(buckets)
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                words, found = [], []
                for text in part.column("text").to_pylist():
                    data = collapsed(text)
                    words.append(data.count(b" ") + 1 if data else 0)
                    grams = [of[data[a:b]] for p in patterns for a, b in (m.span() for m in p.finditer(data, overlapped=True))]
                    found.append(np.array(grams, dtype="<u4").tobytes())
                ids = part.column(id_column) if id_column else pa.nulls(len(words), pa.int64())
                columns = [ids, pa.array(words, pa.int64()), pa.array([len(f) // 4 for f in found], pa.int64()), pa.array(found, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_words", "n_features", "buckets"])

    return run


_SCANNED = "doc_id long, n_words long, n_features long, buckets binary"


def features(texts: DataFrame, id_column: str | None = "doc_id", sizes: tuple[int, int] = SIZES, buckets: int = BUCKETS) -> DataFrame:
    """doc_id, n_words, n_features and the buckets (unsigned, little endian) of all n-grams of each text."""
    text = F.col("text").cast("string").alias("text")
    narrow = texts.select(*([F.col(id_column).cast("long").alias(id_column)] if id_column else []), text)
    return narrow.mapInArrow(_scan(id_column, sizes, buckets), _SCANNED)


def bucket_counts(scanned: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Occurrences per bucket; tasks send at most one row per bucket, the driver gets one in all."""

    def run(batches):
        total = np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            for value in batch.column("buckets"):
                total += np.bincount(np.frombuffer(value.as_buffer(), dtype="<u4"), minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at])], names=["bucket", "n"])

    out = np.zeros(buckets, dtype=np.int64)
    for r in scanned.select("buckets").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """1000 ln of the target's share over the source's, both with one added per bucket, rounded down."""
    buckets = len(source)
    s, t = source.astype(float), target.astype(float)
    return np.floor(1000 * np.log((t + 1) * (s.sum() + buckets) / ((s + 1) * (t.sum() + buckets)))).astype(np.int64)


def weights(scanned: DataFrame, gain: np.ndarray) -> DataFrame:
    """doc_id, n_words, n_features and weight, the mean gain rounded down."""

    def run(batches):
        for batch in batches:
            sums = [int(gain[np.frombuffer(v.as_buffer(), dtype="<u4")].sum()) for v in batch.column("buckets")]
            counts = batch.column("n_features").to_pylist()
            mean = pa.array([s // n if n else 0 for s, n in zip(sums, counts, strict=True)], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_words"), batch.column("n_features"), mean], names=["doc_id", "n_words", "n_features", "weight"])

    return scanned.mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")


def gumbel(doc_id: Column, seed: int = SEED) -> Column:
    """1000 times a standard Gumbel draw made from the seed and the id, rounded down."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def resample(docs: DataFrame, target: DataFrame, sizes: tuple[int, int] = SIZES, buckets: int = BUCKETS, min_words: int = MIN_WORDS, percent: int = PERCENT, seed: int = SEED) -> DataFrame:
    """doc_id, n_features, weight, score and rank (null where not drawn) of every document.

    `percent` of the documents with `min_words` words or more are drawn, highest scores first.
    """
    scanned = cut(features(docs, "doc_id", sizes, buckets), "features")
    gain = gains(bucket_counts(scanned, buckets), bucket_counts(features(target, None, sizes, buckets), buckets))
    scored = weights(scanned, gain).withColumn("score", F.col("weight") + gumbel(F.col("doc_id"), seed))
    scored = scored.withColumn("short", F.col("n_words") < min_words)
    order = ["short", F.desc("score"), F.asc_nulls_last("doc_id"), "n_features", "weight"]
    rows = numbered(scored, order)
    drawn = rows.filter(~F.col("short")).count() * percent // 100
    rank = F.when(F.col("row") < drawn, F.col("row") + 1)
    return rows.select("doc_id", "n_features", "weight", "score", rank.alias("rank"))


def drawn_documents(docs: DataFrame, target: DataFrame, **settings) -> DataFrame:
    """The documents drawn, in all columns of `docs`, with their rank; doc_id tells documents apart."""
    ranks = resample(docs, target, **settings).filter("rank IS NOT NULL").select(F.col("doc_id").alias("_drawn"), F.col("rank").alias("_rank"))
    own = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("rest")
    return docs.select(F.col("doc_id").cast("long").alias("_own"), own).join(ranks, F.col("_own").eqNullSafe(F.col("_drawn"))).select("rest", F.col("_rank").alias("rank"))
