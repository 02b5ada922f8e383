"""Language-model scoring with a log-bilinear model trained by noise-contrastive estimation.

Tokens are lower-cased words, then an end token per text. Each belongs to one of `CLASSES` classes: the
most frequent tokens have one each, the others share classes by a hash of their last two bytes. The
log-bilinear model predicts the class of a token from the classes of the two before it: the context
vectors, weighted per place, are summed and multiplied with the target vectors. A token's probability is
its class's, normalised over all classes, times its share of the class, (c + 1) / (N + V + 1) over the
class's training tokens; the 1 left over is for tokens that training has not seen.

Gathered from all training texts, with counts combined in each task before they are shuffled: the count
of every token, and the count of every three classes in a row. The model is trained on all of these
counts in numpy; noise-contrastive estimation takes the expectation over its noise, the classes' own
frequencies, so nothing is sampled. Classes bound the tables of the model whatever the corpus.

Scoring is one pass over the texts. Counts of the `KEPT` most frequent tokens are sent to the tasks; a
token beyond these becomes a row that is joined to its count and summed back to its text.

Defined results: a null or empty text is the end token alone; rows with equal doc_id, and equal rows, are
scored one by one; a null doc_id counts as training. Without training texts all tokens are unknown, and
classes are equally likely.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shoalmap.llm.words import blocks, mixed, signed
from shoalmap.session import cut

CLASSES = 128
OWN = 64
KEPT = 200_000
WIDTH = 24
NOISE = 10
END_HASH = np.uint64(0x5851F42D4C957F2D)
START = CLASSES
SIDE = CLASSES + 1


def held_out(doc_id: Column, folds: int = 7, fold: int = 2) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % folds == fold, F.lit(False))


def _tokens(texts: list[str | None]):
    """(texts of a block, hashes and last two bytes of its tokens, text number of each), end tokens included."""
    for block in blocks(texts, lower=True):
        n = len(block.words)
        at = np.arange(n)
        h = block.hashes(at, 1) if n else np.zeros(0, np.uint64)
        last = block.data[block.ends - 1].astype(np.uint64) if n else h
        prior = np.where(block.ends - block.starts > 1, block.data[np.maximum(block.ends - 2, 0)], 0).astype(np.uint64) if n else h
        stop = block.first + block.counts
        yield block.rows, np.insert(h, stop, END_HASH), np.insert(last << np.uint64(8) | prior, stop, 0), np.insert(block.text, stop, np.arange(len(block.rows)))


def _bucket(tail: np.ndarray) -> np.ndarray:
    """Class of a token without a class of its own."""
    return (OWN + mixed(tail) % np.uint64(CLASSES - OWN)).astype(np.int64)


def token_counts(docs: DataFrame) -> DataFrame:
    """h, bucket and n of the tokens of (text)."""

    def run(batches):
        for batch in batches:
            parts = [(h, _bucket(tail)) for _, h, tail, _ in _tokens(batch.column("text").to_pylist())]
            if not parts:
                continue
            h = np.concatenate([p[0] for p in parts])
            found, at, n = np.unique(h, return_index=True, return_counts=True)
            bucket = np.concatenate([p[1] for p in parts])[at]
            yield pa.RecordBatch.from_arrays([pa.array(signed(found)), pa.array(bucket.astype(np.int32)), pa.array(n)], names=["h", "bucket", "n"])

    return docs.select("text").mapInArrow(run, "h long, bucket int, n long").groupBy("h", "bucket").agg(F.sum("n").alias("c"))


@dataclass
class Vocabulary:
    own: np.ndarray  # sorted hashes of tokens with a class of their own
    own_class: np.ndarray

    def classes(self, h: np.ndarray, tail: np.ndarray) -> np.ndarray:
        out = _bucket(tail)
        if len(self.own):
            spot = np.minimum(np.searchsorted(self.own, h), len(self.own) - 1)
            hit = self.own[spot] == h
            out[hit] = self.own_class[spot[hit]]
        return out


def _threes(classes: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Number of (class before the last, last class, class) for each token."""
    one, two = np.full(len(classes), START), np.full(len(classes), START)
    one[1:] = np.where(text[1:] == text[:-1], classes[:-1], START)
    two[2:] = np.where(text[2:] == text[:-2], classes[:-2], START)
    return (two * SIDE + one) * CLASSES + classes


def class_counts(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """three and n: how often three classes follow each other in (text)."""

    def run(batches):
        total = np.zeros(SIDE * SIDE * CLASSES, dtype=np.int64)
        for batch in batches:
            for _, h, tail, text in _tokens(batch.column("text").to_pylist()):
                np.add(total, np.bincount(_threes(vocabulary.classes(h, tail), text), minlength=len(total)), out=total)
        at = np.flatnonzero(total)
        for k in range(0, len(at), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(at[k : k + 100_000].astype(np.int32)), pa.array(total[at[k : k + 100_000]])], names=["three", "n"])

    return docs.select("text").mapInArrow(run, "three int, n long").groupBy("three").agg(F.sum("n").alias("n"))


def train(counts: np.ndarray, width: int = WIDTH, noise: int = NOISE, steps: int = 200, rate: float = 0.05) -> np.ndarray:
    """Log10 probability of each class after each two classes, from counts (two, one, class)."""
    rng = np.random.default_rng(11)
    n = counts.reshape(SIDE * SIDE, CLASSES).astype(np.float32)
    total = n.sum(axis=1)
    seen = np.flatnonzero(total)
    if not len(seen):
        return np.full((SIDE * SIDE, CLASSES), -np.log10(CLASSES))
    share = (n.sum(axis=0) + 1) / (n.sum() + CLASSES)
    two, one = seen // SIDE, seen % SIDE
    n, total = n[seen], total[seen]
    grand = total.sum()
    n, total = n / grand, total / grand
    shape = {"r": (SIDE, width), "q": (CLASSES, width), "near": (width,), "far": (width,), "b": (CLASSES,)}
    p = {k: rng.normal(0, 0.1, s).astype(np.float32) for k, s in shape.items()}
    p["b"] = np.log(share).astype(np.float32)
    p["near"] += 1
    p["far"] += 0.5
    offset = np.log(noise * share).astype(np.float32)
    m, v = ({k: np.zeros_like(x) for k, x in p.items()} for _ in range(2))
    for step in range(1, steps + 1):
        a, b = p["r"][one], p["r"][two]
        context = a * p["near"] + b * p["far"]
        s = context @ p["q"].T + p["b"]
        true = 1 / (1 + np.exp(np.clip(offset - s, -30, 30)))
        # Data pull a score up by how far it is from certain, the expected noise pulls it down.
        push = n * (1 - true) - total[:, None] * (noise * share) * true
        g_context = push @ p["q"]
        g = {"q": push.T @ context, "b": push.sum(axis=0), "near": (g_context * a).sum(axis=0), "far": (g_context * b).sum(axis=0), "r": np.zeros_like(p["r"])}
        np.add.at(g["r"], one, g_context * p["near"])
        np.add.at(g["r"], two, g_context * p["far"])
        for k in p:
            m[k] = 0.9 * m[k] + 0.1 * g[k]
            v[k] = 0.99 * v[k] + 0.01 * g[k] ** 2
            p[k] += rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)
        if step > 0.7 * steps:
            rate *= 0.97
    every = np.arange(SIDE * SIDE)
    s = (p["r"][every % SIDE] * p["near"] + p["r"][every // SIDE] * p["far"]) @ p["q"].T + p["b"]
    s = s.astype(np.float64)
    s -= s.max(axis=1, keepdims=True)
    return (s - np.log(np.exp(s).sum(axis=1, keepdims=True))) / np.log(10)


@dataclass
class Model:
    vocabulary: Vocabulary
    log_class: np.ndarray  # float32, one value per three classes
    log_size: np.ndarray  # log10(N + V + 1) per class
    kept: np.ndarray  # sorted hashes of the most frequent tokens
    kept_count: np.ndarray
    n: int
    v: int
    counts: DataFrame


def fit(docs: DataFrame, classes_own: int = OWN, kept: int = KEPT) -> Model:
    """Learn from all texts of (text)."""
    counts = cut(token_counts(docs), "tokens")
    totals = counts.groupBy("bucket").agg(F.sum("c").alias("n"), F.count("*").alias("v")).collect()
    # The most frequent tokens, at most `kept`: those above the first step of the counts' own scale at
    # which they fit, so that no task has to sort them all.
    step = F.floor(F.log2("c") * 64).cast("int")
    fits, lowest = 0, None
    for r in sorted(counts.groupBy(step.alias("step")).count().collect(), key=lambda r: -r["step"]):
        fits += r["count"]
        if fits > kept:
            break
        lowest = r["step"]
    top = counts.filter(step >= lowest if lowest is not None else F.lit(False)).toArrow()
    h, c, bucket = (top[x].to_numpy() for x in ("h", "c", "bucket"))
    order = np.lexsort((h, -c))
    h, c, bucket = h[order].view(np.uint64), c[order], bucket[order]
    # The last of the classes of their own is for tokens not among the first.
    own = h[: classes_own - 1]
    size, kinds = np.zeros(CLASSES), np.zeros(CLASSES)
    for r in totals:
        size[r["bucket"]], kinds[r["bucket"]] = r["n"], r["v"]
    np.subtract.at(size, bucket[: len(own)], c[: len(own)])
    np.subtract.at(kinds, bucket[: len(own)], 1)
    size[: len(own)], kinds[: len(own)] = c[: len(own)], 1
    by_hash = np.argsort(own)
    vocabulary = Vocabulary(own[by_hash], by_hash.astype(np.int64))
    threes = class_counts(docs, vocabulary).toArrow()
    table = np.zeros(SIDE * SIDE * CLASSES)
    table[threes["three"].to_numpy()] = threes["n"].to_numpy()
    order = np.argsort(h)
    return Model(vocabulary, train(table).astype(np.float32).ravel(), np.log10(size + kinds + 1), h[order], c[order], int(sum(r["n"] for r in totals)), int(sum(r["v"] for r in totals)), counts)


_SUMS = "uid long, h long, doc_id long, n_tokens long, n_known long, counted double, model double"


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, n_tokens, n_known, base_score and score (log10) of every text."""
    kept = {k: getattr(model, k) for k in ("vocabulary", "log_class", "log_size", "kept", "kept_count")}
    sent = docs.sparkSession.sparkContext.broadcast(kept)

    def run(batches):
        from pyspark import TaskContext

        m = sent.value
        uid = TaskContext.get().partitionId() << 33
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            for rows, h, tail, text in _tokens(batch.column("text").to_pylist()):
                n = len(rows)
                classes = m["vocabulary"].classes(h, tail)
                fit_ = m["log_class"][_threes(classes, text)] - m["log_size"][classes]
                c = np.zeros(len(h), dtype=np.int64)
                if len(m["kept"]):
                    spot = np.minimum(np.searchsorted(m["kept"], h), len(m["kept"]) - 1)
                    hit = m["kept"][spot] == h
                    c[hit] = m["kept_count"][spot[hit]]
                sums = np.bincount(text, np.log10(c + 1), n), np.bincount(text, fit_, n), np.bincount(text, minlength=n), np.bincount(text, c > 0, n)
                own = uid + np.arange(n)
                # A row for the text, under a key of its own that no token has to meet, ...
                yield _rows(own, mixed(own.astype(np.uint64)), [ids[r] for r in rows], sums[2], sums[3], sums[0], sums[1])
                # ... and one for each of its tokens beyond the kept ones, with how often it has it.
                rest = np.flatnonzero(c == 0)
                if len(rest):
                    order = rest[np.lexsort((h[rest], text[rest]))]
                    new = np.concatenate([[True], (h[order[1:]] != h[order[:-1]]) | (text[order[1:]] != text[order[:-1]])])
                    first = np.flatnonzero(new)
                    times = np.diff(np.append(first, len(order)))
                    at = order[first]
                    none = np.zeros(len(at))
                    yield _rows(own[text[at]], h[at], [None] * len(at), np.zeros(len(at), np.int64), times, none, none)
                uid += n

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = texts.mapInArrow(run, _SUMS).withColumn("of_text", F.col("n_tokens") > 0)
    rows = rows.join(model.counts.select("h", "c"), "h", "left")
    c = F.coalesce("c", F.lit(0))
    counted = F.when(F.col("of_text"), F.col("counted")).otherwise(F.col("n_known") * F.log10(c + 1))
    known = F.when(F.col("of_text"), F.col("n_known")).otherwise(F.when(c > 0, F.col("n_known")).otherwise(0))
    out = rows.groupBy("uid").agg(F.max("doc_id").alias("doc_id"), F.sum("n_tokens").alias("n_tokens"), F.sum(known).alias("n_known"), F.sum(counted).alias("counted"), F.sum("model").alias("model"))
    base = F.col("counted") - F.col("n_tokens") * F.lit(float(np.log10(model.n + model.v + 1)))
    return out.select("doc_id", "n_tokens", "n_known", base.alias("base_score"), (F.col("counted") + F.col("model")).alias("score"))


def _rows(uid, h, doc_id, n_tokens, n_known, counted, model) -> pa.RecordBatch:
    columns = [pa.array(uid), pa.array(signed(np.ascontiguousarray(h))), pa.array(doc_id, pa.int64()), pa.array(n_tokens.astype(np.int64)), pa.array(n_known.astype(np.int64)), pa.array(counted), pa.array(model)]
    return pa.RecordBatch.from_arrays(columns, names=["uid", "h", "doc_id", "n_tokens", "n_known", "counted", "model"])


def score_digest(docs: DataFrame) -> DataFrame:
    """The columns of the checked query."""
    out = held_out(F.col("doc_id"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    model = fit(texts.filter(~out))
    got = score(texts, model)
    return got.select("doc_id", out.alias("held_out"), "n_tokens", "n_known", F.lit(model.n).cast("long").alias("train_tokens"), "base_score", "score")
