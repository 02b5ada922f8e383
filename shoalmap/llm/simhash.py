"""SimHash near-duplicates with a Gray-order hierarchical index.

Fingerprints that differ in at most 3 of 64 bits agree on at least one quarter, so each fingerprint is
dealt out four times, rotated, by one quarter. Inside a deal the fingerprints are sorted by Gray rank,
which puts similar bit patterns side by side, and a tree is built over the order: a node keeps the bits
its members share (mask and pattern). The search walks pairs of nodes from the roots; the bits in which
two shared patterns differ are a lower bound for all pairs below, so whole groups are dropped once the
bound passes 3. Pairs of groups that are already known to be one class are dropped as well; a task
sends a spanning forest of its links, never all pairs. Classes are then joined over all tasks.

A quarter that holds more than `LIMIT` fingerprints is cut into pieces, and tasks take pairs of pieces:
exact, with bounded memory.

Defined results: a null or empty text, or one of white space, has fingerprint zero and is linked like
any other. Equal fingerprints are one node however many documents have them. Rows that share a doc_id
are separate documents. A class without any doc_id has a null component_id.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from shoalmap.llm.components import components
from shoalmap.llm.words import words_of
from shoalmap.session import cut

SHINGLE = 3
RADIUS = 3
FANOUT = 8
LIMIT = 200_000
PAIRS = 1 << 20
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def fingerprint_of(text: str | None, shingle: int = SHINGLE, piece: int = 1 << 16) -> int:
    """64 majority bits over the XXH64 (seed 42) of the shingles, as a signed number."""
    words = words_of(text)
    if not words:
        return 0
    joined = b" ".join(words).lower()
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = [0, *(ends[:-1] + 1).tolist()]
    ends = ends.tolist()
    n = max(1, len(words) - shingle + 1)
    ends = ends[shingle - 1 :] if len(words) >= shingle else ends[-1:]
    ones = np.zeros(64, dtype=np.int64)
    digest = xxhash.xxh64_intdigest
    for k in range(0, n, piece):
        pairs = zip(starts[k : min(k + piece, n)], ends[k : k + piece], strict=True)
        h = np.array([digest(joined[s:e], 42) for s, e in pairs], dtype=np.uint64)
        for byte, column in enumerate(h.astype("<u8").view(np.uint8).reshape(-1, 8).T):
            ones[byte * 8 : byte * 8 + 8] += np.bincount(column, minlength=256) @ _BITS
    bits = np.packbits(2 * ones > n, bitorder="little")
    return int(bits.view("<i8")[0])


@F.pandas_udf(LongType())
def fingerprint(text: pd.Series) -> pd.Series:
    return text.map(fingerprint_of, na_action=None).astype("int64")


def gray_rank(code: np.ndarray) -> np.ndarray:
    """Place of a bit pattern in the reflected Gray order."""
    for shift in (1, 2, 4, 8, 16, 32):
        code = code ^ (code >> np.uint64(shift))
    return code


class Forest:
    """Classes of the members of one task."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        while True:
            while not np.array_equal(up := self.root[self.root], self.root):
                self.root = up
            ra, rb = self.root[a], self.root[b]
            if not (apart := ra != rb).any():
                return
            a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
            np.minimum.at(self.root, np.maximum(ra, rb), np.minimum(ra, rb))


class GrayIndex:
    """Tree over fingerprints in the order of (bucket, Gray rank); one root per bucket."""

    def __init__(self, codes: np.ndarray, bucket: np.ndarray):
        self.codes, self.bucket = codes, bucket
        full = np.full(len(codes), ~np.uint64(0))
        self.levels = [(codes, full, np.arange(len(codes)), np.ones(len(codes), dtype=np.int64))]
        while len(bucket) and (bucket[1:] == bucket[:-1]).any():
            pattern, mask, *_ = self.levels[-1]
            at = np.arange(len(bucket))
            new = np.concatenate([[True], bucket[1:] != bucket[:-1]])
            inside = at - np.maximum.accumulate(np.where(new, at, 0))
            first = np.flatnonzero(inside % FANOUT == 0)
            every = np.bitwise_and.reduceat(pattern | ~mask, first), np.bitwise_or.reduceat(pattern & mask, first)
            shared = np.bitwise_and.reduceat(mask, first) & ~(every[0] ^ every[1])
            self.levels.append((every[1] & shared, shared, first, np.diff(np.append(first, len(bucket)))))
            bucket = bucket[first]

    def uniform(self, root: np.ndarray) -> list[np.ndarray]:
        """Per level the class of a node, or -1 where its members are of several."""
        out = [root]
        for *_, first, _ in self.levels[1:]:
            low, high = np.minimum.reduceat(out[-1], first), np.maximum.reduceat(out[-1], first)
            out.append(np.where(low == high, low, -1))
        return out

    def link(self, radius: int = RADIUS, across: np.ndarray | None = None) -> np.ndarray:
        """Root of every member once all pairs within the radius are joined.

        `across`, a side per member, leaves out pairs of one side (they are another task's).
        """
        forest = Forest(len(self.codes))
        if not len(self.codes):
            return forest.root
        top = len(self.levels) - 1
        roots = np.arange(len(self.levels[top][0]))
        if across is None:
            near = np.bitwise_count(self.codes[1:] ^ self.codes[:-1]) <= radius
            near = np.flatnonzero(near & (self.bucket[1:] == self.bucket[:-1]))
            forest.join(near, near + 1)
        known = self.uniform(forest.root)
        stack = [(top, roots[k : k + PAIRS], roots[k : k + PAIRS]) for k in range(0, len(roots), PAIRS)]
        while stack:
            level, a, b = stack.pop()
            same = (known[level][a] == known[level][b]) & (known[level][a] >= 0)
            a, b = a[~same], b[~same]
            if level == 0:
                keep = a != b
                if across is not None:
                    keep &= across[a] != across[b]
                if keep.any():
                    forest.join(a[keep], b[keep])
                    known = self.uniform(forest.root)
                continue
            *_, first, count = self.levels[level]
            pattern, mask, *_ = self.levels[level - 1]
            step = PAIRS // FANOUT**2
            for k in range(0, len(a), step):
                x, y = a[k : k + step], b[k : k + step]
                size = count[x] * count[y]
                pair = np.repeat(np.arange(len(x)), size)
                inside = np.arange(len(pair)) - np.repeat(np.cumsum(size) - size, size)
                i = first[x][pair] + inside // count[y][pair]
                j = first[y][pair] + inside % count[y][pair]
                apart = np.bitwise_count((pattern[i] ^ pattern[j]) & mask[i] & mask[j])
                keep = (i <= j) & (apart <= radius)
                if keep.any():
                    stack.append((level - 1, i[keep], j[keep]))
        while not np.array_equal(up := forest.root[forest.root], forest.root):
            forest.root = up
        return forest.root


def _links(radius: int):
    def links(pdf: pd.DataFrame) -> pd.DataFrame:
        codes = pdf["code"].to_numpy().view(np.uint64)
        turn = pdf["turn"].to_numpy()
        bucket = (turn.astype(np.int64) << 16) | (codes >> np.uint64(48)).astype(np.int64)
        bucket = bucket * (1 << 40) + pdf["task"].to_numpy()
        order = np.lexsort((gray_rank(codes), bucket))
        codes, turn, bucket, side = codes[order], turn[order], bucket[order], pdf["side"].to_numpy()[order]
        out_a, out_b = [], []
        # Tasks on two pieces of a cut quarter link across only; both kinds go through one index each.
        for across in (False, True):
            own = (side >= 0) == across
            if own.any():
                root = GrayIndex(codes[own], bucket[own]).link(radius, side[own] if across else None)
                back = _turned(codes[own], turn[own])
                moved = root != np.arange(len(root))
                out_a.append(back[moved])
                out_b.append(back[root[moved]])
        if not out_a:
            return pd.DataFrame({"a": np.zeros(0, np.int64), "b": np.zeros(0, np.int64)})
        return pd.DataFrame({"a": np.concatenate(out_a).view(np.int64), "b": np.concatenate(out_b).view(np.int64)})

    return links


def _turned(codes: np.ndarray, turn: np.ndarray) -> np.ndarray:
    """Undo the rotation by `turn` quarters."""
    right = (turn.astype(np.uint64) * np.uint64(16)) % np.uint64(64)
    left = (np.uint64(64) - right) % np.uint64(64)
    return (codes >> right) | np.where(right == 0, np.uint64(0), codes << left)


def fingerprint_links(codes: DataFrame, radius: int = RADIUS, limit: int = LIMIT) -> DataFrame:
    """Edges (a, b) that join all distinct fingerprints (`fp`) within the radius into their classes."""
    turns = [F.struct(F.lit(k).alias("turn"), (F.expr(f"shiftleft(fp, {16 * k}) | shiftrightunsigned(fp, {64 - 16 * k})") if k else F.col("fp")).alias("code")) for k in range(4)]
    dealt = codes.select(F.explode(F.array(*turns)).alias("x")).select("x.*")
    dealt = dealt.withColumn("quarter", F.shiftrightunsigned("code", 48))
    sizes = dealt.groupBy("turn", "quarter").agg(F.count("*").alias("n"))
    hot = sizes.filter(F.col("n") > limit).withColumn("pieces", F.ceil(F.col("n") / limit).cast("int")).drop("n")
    dealt = dealt.join(hot, ["turn", "quarter"], "left")
    n = max(1, codes.count() * 4 // 50_000)
    part = F.pmod(F.xxhash64("turn", "quarter"), F.lit(n))
    whole = dealt.filter("pieces IS NULL").select("turn", "code", part.alias("part"), F.lit(0).cast("long").alias("task"), F.lit(-1).alias("side"))
    # Piece i meets itself (one task) and every other piece (a task per pair, links across only).
    cut_up = dealt.filter("pieces IS NOT NULL").withColumn("i", F.pmod(F.xxhash64("code"), F.col("pieces")).cast("int"))
    cut_up = cut_up.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)))
    low, high = F.least("i", "j"), F.greatest("i", "j")
    task = (low * F.col("pieces") + high + 1).cast("long")
    side = F.when(F.col("i") == F.col("j"), -1).otherwise((F.col("i") > F.col("j")).cast("int"))
    cut_up = cut_up.select("turn", "code", (F.pmod(F.xxhash64("turn", "quarter", low, high), F.lit(1 << 40)) + n).alias("part"), task.alias("task"), side.alias("side"))
    return whole.unionByName(cut_up).groupBy("part").applyInPandas(_links(radius), "a long, b long")


def near_classes(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """doc_id, key (hash of the text), fp and root, the smallest fingerprint of the class.

    Fingerprints are computed in one pass and written to the shared folder; only ids go further.
    """
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("text").cast("string")).alias("key"), fingerprint(F.col("text").cast("string")).alias("fp"))
    ids = cut(ids, "fingerprints")
    roots = components(fingerprint_links(ids.select("fp").distinct(), radius))
    return ids.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("doc_id", "key", "fp", F.coalesce("root", "fp").alias("root"))


def near_duplicates(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id, the smallest doc_id of the class."""
    rows = near_classes(docs, radius)
    least = rows.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    return rows.join(least, "root").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """One document of each class stays, the one with the smallest doc_id; null comes last.

    Equal rows are one document: one stays. The columns are those of `docs`.
    """
    rows = near_classes(docs, radius)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")).alias("x")
    stay = rows.groupBy("root").agg(first).select(F.struct(F.col("x.none"), F.coalesce("x.doc_id", F.lit(0)).alias("id"), F.col("x.key")).alias("_stays"))
    text = F.col("text").cast("string")
    own = F.struct(F.col("doc_id").isNull().alias("none"), F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("id"), F.xxhash64(text).alias("key"))
    held = docs.select(own.alias("_stays"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))
    kept = held.join(stay, "_stays").dropDuplicates(["_stays"])
    return kept.select("_row.*")
