"""Toxicity: a support vector machine on a gap-weighted subsequence kernel with Nystroem landmarks.

Landmarks are the words whose document frequency leans most to the toxic labels. The kernel compares a
word and a landmark by their common subsequences of three letters, each weighted by `DECAY` per letter
it spans, so gaps and inserted letters lower the likeness but don't end it. A sentence is described by
its best match to each landmark, mapped by the inverse root of the landmarks' own kernel matrix
(Nystroem). The machine is trained on labelled sentences: a toxic document stands for its most toxic
sentence, found anew in each round; every sentence of a clean document is a negative. A document
scores as its most toxic sentence does, through a logistic curve fitted on the labelled documents.

Reading: A-Z is lower-cased; `. * _ - ' ~ ^ + # @ $` and the like are taken out of words, so
"i.d.i*o-t" is one word; other ASCII punctuation and white space end words; four and more single
letters in a row are also read as one word; words above 48 bytes are read in overlapping pieces.
A word has kernel zero with a landmark if it has under two thirds of its distinct letters, if under half
of the landmark's neighbouring letters follow each other in it within three places, or if the normalised
kernel is under `LEAST`.

Bounds: the model is fitted on at most `MAX_DOCS` labelled documents (those with the smallest hash of
doc_id) and, of each, at most `MAX_SENTENCES` sentences that match a landmark best; at most
`LANDMARKS` landmarks, no two of them much alike. Scoring covers whole texts of all documents.

Defined results: null and empty texts, and texts without a match, score as a sentence without any
match does. Without labels of both kinds every score is 0. Rows are scored one by one, so copies score
alike. Labels that are null are not learned from; a doc_id with several label rows counts as toxic if
one of them says so.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from shoalmap.llm.words import BLOCK_BYTES
from shoalmap.session import cut

MAX_DOCS = 20_000
MAX_SENTENCES = 4
LANDMARKS = 64
ORDER = 3
DECAY = 0.75
LEAST = 0.35
LEAN = 3.2
LONGEST = 48
KNOWN = 100_000
# Pairs of a word and a landmark whose kernel is found at once.
PAIRS = 1024
# Documents a task describes at a time.
DOCS = 256

_INSIDE = b".*_-'`~^+#@$%&\\\"=<>"
_TABLE = bytes(32 if c < 128 and not (chr(c).isalnum() or c == 1) else ord(chr(c).lower()) if c < 128 else c for c in range(256))
_DELETE = bytes(_INSIDE)
_LETTER = np.zeros(256, dtype=np.uint64)
for _c in range(33, 256):
    _LETTER[_c] = np.uint64(1) << np.uint64(_c - 97 if 97 <= _c <= 122 else 26 + _c % 38)


def read(text: str | None) -> list[bytes]:
    """Words of a text; b"\\x01" ends a sentence."""
    if not text:
        return []
    data = text.encode().replace(b"\x01", b" ")
    for end in (b". ", b"\n", b"! ", b"? "):
        data = data.replace(end, b" \x01 ")
    words = data.translate(_TABLE, _DELETE).split()
    if words and max(map(len, words)) > LONGEST:
        half = LONGEST // 2
        words = [p for w in words for p in ([w] if len(w) <= LONGEST else [w[k : k + LONGEST] for k in range(0, len(w) - half, half)])]
    out, run = words, []
    if b"\x01\x01\x01\x01" in bytes(map(len, words)):
        out = []
        for w in [*words, b""]:
            if len(w) == 1 and w != b"\x01":
                run.append(w)
                continue
            out += run
            if len(run) >= 4:
                out += [b"".join(run)[k : k + LONGEST] for k in range(0, len(run), LONGEST // 2)]
            run = []
            if w:
                out.append(w)
    return out


def subsequence_kernel(hit: np.ndarray, order: int = ORDER, decay: float = DECAY) -> np.ndarray:
    """Gap-weighted count of the common subsequences of `order` letters, for many pairs of words.

    `hit[r, j, i]` says whether letter j of one word of pair r is letter i of the other. The usual
    recurrence runs for all pairs at once.
    """
    n, m, width = hit.shape
    hit = hit.astype(np.float32) * np.float32(decay * decay)
    # prior[:, j, i]: weight of the shorter matches inside the first j and the first i letters.
    prior = np.ones((m + 1, width + 1, n), dtype=np.float32)
    hit = np.ascontiguousarray(hit.transpose(1, 2, 0))
    for _ in range(order - 1):
        now = np.zeros_like(prior)
        for j in range(1, m + 1):
            row = np.zeros(n, dtype=np.float32)
            for i in range(1, width + 1):
                row = np.float32(decay) * row + hit[j - 1, i - 1] * prior[j - 1, i - 1]
                now[j, i] = np.float32(decay) * now[j - 1, i] + row
        prior = now
    return (hit * prior[:m, :width]).sum(axis=(0, 1), dtype=np.float64)


def _matrix(words: list[bytes]) -> np.ndarray:
    width = max(map(len, words))
    return np.frombuffer(b"".join([w.ljust(width, b"\0") for w in words]), dtype=np.uint8).reshape(-1, width)


def hits(words: list[bytes], other: bytes) -> np.ndarray:
    return np.frombuffer(other, np.uint8)[None, :, None] == _matrix(words)[:, None, :]


def own_kernel(words: list[bytes]) -> np.ndarray:
    """Kernel of each word with itself."""
    out = []
    for k in range(0, len(words), 512):
        m = _matrix(words[k : k + 512])
        out.append(subsequence_kernel((m[:, :, None] == m[:, None, :]) & (m > 0)[:, None, :]))
    return np.maximum(np.concatenate(out), 1e-12)


def pairs_near(hit: np.ndarray, reach: int = 3) -> np.ndarray:
    """How many neighbouring letters of the landmark follow each other in a word, gaps allowed."""
    n, m, width = hit.shape
    wide = np.zeros((n, m, width + reach), dtype=bool)
    wide[:, :, :width] = hit
    after = wide[:, 1:, 1 : width + 1].copy()
    for gap in range(2, reach + 1):
        after |= wide[:, 1:, gap : gap + width]
    return (hit[:, :-1] & after).any(axis=2).sum(axis=1)


def spread_out(words: list[bytes], most: int, alike: float = 0.7) -> list[bytes]:
    """The first words that are not much alike, so that the forms of one stem don't take all places."""
    chosen: list[bytes] = []
    own: list[float] = []
    for word, itself in zip(words, own_kernel(words), strict=True):
        if chosen:
            value = subsequence_kernel(hits(chosen, word)) / np.sqrt(np.array(own) * itself)
            if value.max() > alike:
                continue
        chosen.append(word)
        own.append(itself)
        if len(chosen) == most:
            break
    return chosen


@dataclass
class Landmarks:
    words: list[bytes]

    def __post_init__(self):
        self.masks = [np.bitwise_or.reduce(_LETTER[np.frombuffer(w, np.uint8)]) for w in self.words]
        self.own = own_kernel(self.words)
        self.known: dict[bytes, tuple] = {}

    def matches(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(word number, landmark, normalised kernel) of all words that match a landmark."""
        none = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        if not words:
            return none
        if len(self.known) > KNOWN:
            self.known = {}
        known = self.known
        distinct = [w for w in dict.fromkeys(words) if w not in known]
        known.update(dict.fromkeys(distinct, ()))
        if distinct:
            self._learn(distinct)
        found = [(i, k, x) for i, w in enumerate(words) if (m := known[w]) for k, x in m]
        if not found:
            return none
        i, k, x = zip(*found, strict=True)
        return np.array(i), np.array(k), np.array(x)

    def _learn(self, distinct: list[bytes]) -> None:
        """Matches of words not met before; a word is met in many blocks."""
        data = np.frombuffer(b"".join(distinct), dtype=np.uint8)
        size = np.fromiter(map(len, distinct), dtype=np.int64, count=len(distinct))
        mask = np.bitwise_or.reduceat(_LETTER[data], np.cumsum(size) - size)
        pairs: dict[int, list] = {}
        for k, landmark in enumerate(self.masks):
            length = len(self.words[k])
            need = -(-2 * int(np.bitwise_count(landmark)) // 3)
            near = np.flatnonzero((np.bitwise_count(mask & landmark) >= need) & (size >= ORDER) & (size <= 3 * length))
            for lo in range(0, len(near), 4096):
                some = near[lo : lo + 4096]
                hit = hits([distinct[i] for i in some.tolist()], self.words[k])
                some = some[pairs_near(hit) >= length // 2]
                pairs.setdefault(length, []).append(np.stack([some, np.full(len(some), k)], axis=1))
        found = []
        for parts in pairs.values():
            # Landmarks of a length go together, with words of about a length.
            both = np.concatenate(parts)
            both = both[np.argsort(size[both[:, 0]], kind="stable")]
            for lo in range(0, len(both), PAIRS):
                i, k = both[lo : lo + PAIRS].T
                hit = _matrix([self.words[x] for x in k.tolist()])[:, :, None] == _matrix([distinct[x] for x in i.tolist()])[:, None, :]
                value = subsequence_kernel(hit)
                # The kernel of a word with itself is at least that of its contiguous triples, which
                # bounds the likeness from above; only words above the bound need the exact one.
                close = value >= LEAST * np.sqrt(self.own[k] * (size[i] - ORDER + 1) * DECAY ** (2 * ORDER))
                found.append((i[close], k[close], value[close]))
        if not found:
            return
        i, k, value = (np.concatenate(x) for x in zip(*found, strict=True))
        if not len(i):
            return
        needed, at = np.unique(i, return_inverse=True)
        by = np.argsort(size[needed], kind="stable")
        own = np.empty(len(needed))
        own[by] = own_kernel([distinct[x] for x in needed[by].tolist()])
        likeness = value / np.sqrt(self.own[k] * own[at])
        for x in np.lexsort((i, k)).tolist():
            if likeness[x] >= LEAST:
                word = distinct[i[x]]
                self.known[word] = (*self.known[word], (int(k[x]), float(likeness[x])))


def sentence_features(texts: list[str | None], landmarks: Landmarks):
    """Rows (text, sentence, x) for the sentences with a match; x: best match to each landmark."""
    rows, sentences, features = [], [], []
    held, owner, total = [], [], 0

    def flush():
        words = [w for t in held for w in t]
        if words:
            text = np.repeat(owner, [len(t) for t in held])
            ends = np.fromiter((w == b"\x01" for w in words), dtype=np.int64, count=len(words))
            sentence = np.cumsum(ends)
            i, k, x = landmarks.matches(words)
            if len(i):
                # A new text starts a new sentence as well.
                key, at = np.unique(text[i] * (len(words) + 1) + sentence[i], return_inverse=True)
                best = np.zeros((len(key), len(landmarks.words)))
                np.maximum.at(best, (at, k), x)
                rows.append(key // (len(words) + 1))
                sentences.append(key % (len(words) + 1))
                features.append(best)

    for row, t in enumerate(texts):
        held.append(read(t))
        owner.append(row)
        total += len(t or "")
        if total > BLOCK_BYTES:
            flush()
            held, owner, total = [], [], 0
    flush()
    if not rows:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, len(landmarks.words)))
    return np.concatenate(rows), np.concatenate(sentences), np.concatenate(features)


@dataclass
class Model:
    landmarks: Landmarks
    root: np.ndarray
    weight: np.ndarray
    bias: float
    slope: float
    middle: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        return x @ self.root @ self.weight + self.bias

    def score(self, margin: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * margin + self.middle, -60, 60)))


def train_svm(x: np.ndarray, y: np.ndarray, weight: np.ndarray, cost: float = 1.0, tolerance: float = 1e-6) -> tuple[np.ndarray, float]:
    """Linear machine with squared hinge loss, by Newton steps with halving, to the tolerance."""
    n, width = x.shape[0], x.shape[1] + 1
    ridge = np.full(width, 1.0)
    ridge[-1] = 1e-6
    w = np.zeros(width)

    def blocks_of():
        # A few thousand rows at a time, so no copy of all sentences is made.
        for k in range(0, n, 4096):
            rows = x[k : k + 4096].astype(np.float64)
            yield np.hstack([rows, np.ones((len(rows), 1))]), y[k : k + 4096], weight[k : k + 4096]

    def loss(w):
        return 0.5 * (ridge * w) @ w + cost * sum(float(u @ np.maximum(0, 1 - t * (z @ w)) ** 2) for z, t, u in blocks_of())

    while True:
        gradient, curve = ridge * w, np.diag(ridge)
        for z, t, u in blocks_of():
            slack = 1 - t * (z @ w)
            on = slack > 0
            gradient = gradient - 2 * cost * z[on].T @ (u * t * slack)[on]
            curve = curve + 2 * cost * (z[on] * u[on, None]).T @ z[on]
        if np.abs(gradient).max() < tolerance * max(1.0, cost * weight.sum()):
            return w[:-1], float(w[-1])
        step = np.linalg.solve(curve, gradient)
        size, now = 1.0, loss(w)
        while loss(w - size * step) > now and size > 1e-10:
            size /= 2
        if size <= 1e-10:
            return w[:-1], float(w[-1])
        w = w - size * step


def fit_curve(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Logistic curve over margins with smoothed targets, by Newton steps."""
    up, down = (y > 0).sum(), (y <= 0).sum()
    target = np.where(y > 0, (up + 1) / (up + 2), 1 / (down + 2))
    z = np.stack([margin, np.ones(len(margin))], axis=1)
    w = np.zeros(2)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -60, 60)))
        gradient = z.T @ (p - target) + 1e-3 * w
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + 1e-3 * np.eye(2), gradient)
        w = w - step / max(1.0, np.abs(step).max() / 5)
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0]), float(w[1])


def held_out(doc_id: Column, folds: int = 5, fold: int = 0) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % folds == fold, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, max_docs: int = MAX_DOCS, landmarks: int = LANDMARKS, train: Column | None = None) -> Model | None:
    """Fit on the labelled documents for which `train` (a condition on doc_id) holds."""
    train = ~held_out(F.col("doc_id")) if train is None else train
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).filter("doc_id IS NOT NULL AND toxic IS NOT NULL")
    marks = marks.filter(train).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    # The bound on labelled rows: the smallest hashes of doc_id, the same choice at every run.
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40))
    n = marks.count()
    if n > max_docs:
        # Few more than are wanted reach the last sort.
        marks = marks.filter(place <= int((1 << 40) * min(1.0, 1.1 * max_docs / n)))
    marks = marks.orderBy(place, "doc_id").limit(max_docs)
    held = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(marks), "doc_id")
    # Read three times; written once, since executors that hold it in memory can be lost.
    return _fit(cut(held, "labelled"), landmarks)


def _words(held: DataFrame) -> DataFrame:
    """Distinct words of each labelled document."""

    def split(batches):
        for batch in batches:
            out_w, out_t = [], []
            for text, toxic in zip(batch["text"].to_pylist(), batch["toxic"].to_pylist(), strict=True):
                own = {w for w in read(text) if ORDER <= len(w) <= LONGEST}
                out_w += [w.decode(errors="replace") for w in own]
                out_t += [toxic] * len(own)
            yield pa.RecordBatch.from_pydict({"word": pa.array(out_w, pa.string()), "toxic": pa.array(out_t, pa.int32())})

    return held.mapInArrow(split, "word string, toxic int")


def _fit(held: DataFrame, landmarks: int) -> Model | None:
    texts = held.select("text", "toxic").distinct()
    sizes = texts.agg(F.sum("toxic"), F.count("*")).first()
    bad, n = int(sizes[0] or 0), int(sizes[1])
    if not bad or bad == n:
        return None
    # Log odds with a prior of half a document, over their standard error.
    a, b = F.col("bad") + 0.5, F.col("good") + 0.5
    odds = F.log(a / (bad + 1 - a)) - F.log(b / (n - bad + 1 - b))
    counts = _words(texts).groupBy("word").agg(F.sum("toxic").alias("bad"), F.sum(1 - F.col("toxic")).alias("good"))
    lean = counts.filter(f"bad >= 2 AND bad < {bad + 0.5} AND good < {n - bad + 0.5}").withColumn("lean", odds / F.sqrt(1 / a + 1 / b)).filter(F.col("lean") > LEAN)
    leading = [r.word.encode() for r in lean.orderBy(F.desc("lean"), "word").limit(20 * landmarks).collect()]
    if not leading:
        return None
    marks = Landmarks(spread_out(leading, landmarks))

    def features(batches):
        for batch in (b.slice(k, DOCS) for b in batches for k in range(0, b.num_rows, DOCS)):
            row, _, x = sentence_features(batch["text"].to_pylist(), marks)
            ids = np.array(batch["doc_id"].to_pylist(), dtype=np.int64)
            toxic = np.array(batch["toxic"].to_pylist(), dtype=np.int64)
            order = np.lexsort((-x.sum(axis=1), row))
            fresh = np.concatenate([[True], row[order][1:] != row[order][:-1]]) if len(row) else np.zeros(0, bool)
            at = np.arange(len(order))
            keep = order[at - np.maximum.accumulate(np.where(fresh, at, 0)) < MAX_SENTENCES] if len(row) else order
            # A document without a match is one sentence without a match.
            bare = np.setdiff1d(np.arange(len(ids)), row)
            all_x = np.vstack([x[keep], np.zeros((len(bare), x.shape[1]))])
            at = np.concatenate([row[keep], bare]).astype(np.int64)
            yield pa.RecordBatch.from_pydict({"doc_id": pa.array(ids[at]), "toxic": pa.array(toxic[at].astype(np.int32)), "x": pa.array([r.tobytes() for r in all_x.astype("<f4")], pa.binary())})

    got = held.mapInArrow(features, "doc_id long, toxic int, x binary").toArrow()
    x = np.frombuffer(b"".join(got["x"].to_pylist()), dtype="<f4").reshape(got.num_rows, len(marks.words))
    doc = np.unique(got["doc_id"].to_numpy(), return_inverse=True)[1]
    toxic = got["toxic"].to_numpy() > 0
    values, vectors = np.linalg.eigh(landmark_matrix(marks))
    root = vectors @ np.diag(1 / np.sqrt(np.maximum(values, 1e-2))) @ vectors.T
    phi = x @ root.astype(np.float32)
    n_docs = doc.max() + 1
    label = np.zeros(n_docs, dtype=bool)
    label[doc] = toxic
    pick = x.sum(axis=1)
    for _ in range(4):
        # Of a toxic document only its most toxic sentence is a positive.
        order = np.lexsort((-pick, doc))
        top = np.zeros(len(doc), dtype=bool)
        top[order[np.concatenate([[True], doc[order][1:] != doc[order][:-1]])]] = True
        use = top | ~toxic
        y = np.where(toxic[use], 1.0, -1.0)
        share = np.where(y > 0, 0.5 / max((y > 0).sum(), 1), 0.5 / max((y < 0).sum(), 1)) * len(y)
        weight, bias = train_svm(phi[use], y, share)
        pick = phi @ weight + bias
    best = np.full(n_docs, -np.inf)
    np.maximum.at(best, doc, pick)
    slope, middle = fit_curve(best, np.where(label, 1, -1))
    return Model(marks, root, weight, bias, slope, middle)


def landmark_matrix(marks: Landmarks) -> np.ndarray:
    full = np.stack([subsequence_kernel(hits(marks.words, w)) for w in marks.words], axis=1)
    return full / np.sqrt(np.outer(marks.own, marks.own))


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, text and `rest` (the other columns), with score and sentence, the number of the most
    toxic sentence (null if none matches)."""
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.struct(*[F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")], F.lit(True).alias("_held")).alias("rest"))
    if model is None:
        return plain.withColumns({"score": F.lit(0.0), "sentence": F.lit(None).cast("int")})
    schema = StructType([*plain.schema.fields, StructField("score", DoubleType()), StructField("sentence", IntegerType())])
    out = to_arrow_schema(schema)
    bare = float(model.margin(np.zeros((1, len(model.landmarks.words))))[0])

    def run(batches):
        for whole in batches:
            for batch in (whole.slice(k, DOCS) for k in range(0, whole.num_rows, DOCS)):
                row, sentence, x = sentence_features(batch["text"].to_pylist(), model.landmarks)
                best, at = np.full(batch.num_rows, bare), np.full(batch.num_rows, -1)
                margin = model.margin(x)
                for k in np.argsort(margin, kind="stable").tolist():
                    if margin[k] >= best[row[k]]:
                        best[row[k]], at[row[k]] = margin[k], sentence[k]
                columns = [*batch.columns, pa.array(model.score(best)), pa.array(at.astype(np.int32), mask=at < 0)]
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, out, strict=True)], schema=out)

    return plain.mapInArrow(run, schema)


def drop_toxic(docs: DataFrame, labels: DataFrame, cut: float = 0.5) -> DataFrame:
    """The documents that score below the cut; the columns are those of `docs`."""
    out = score(docs, fit(docs, labels)).filter(F.col("score") < cut)
    names = {"doc_id": F.col("doc_id").cast(docs.schema["doc_id"].dataType), "text": F.col("text")}
    return out.select(*[names.get(c, F.col(f"rest.`{c}`")).alias(c) for c in docs.columns])


def toxicity_digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The columns of the checked query."""
    out = score(docs, fit(docs, labels))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "sentence")

