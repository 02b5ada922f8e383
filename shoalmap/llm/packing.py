"""Token packing: documents into sequences of at most `SIZE` tokens, by bulk-synchronous best fit.

Tokens: the ids of the given tokenizer (added tokens are found in the texts), then id 0. A longer document is cut into pieces of `SIZE`, the
first of which may be shorter. Pieces above half a sequence open one each. The others meet the gaps in
rounds: pieces and gaps are range-sorted by size, larger first, and swept. A piece takes the smallest
gap met so far that no earlier piece took (its successor in size). A sweep runs inside each range; what
is left of a range are pieces without a gap, then gaps without a piece, and a small table with two
counts per range says which ranks of which ranges meet; small pieces meet a wide gap several at a time.
Ranks are then joined, so no gap is claimed beyond its size. Gaps are updated, and the next round begins. When pieces are larger than every
gap, the largest of them open as many sequences as their tokens need, counted exactly; so every round
opens a sequence or fills a gap, which is asserted.

A round places a piece in every gap that any piece fits, and no row is held by the driver. The rounds
are written to one folder of the shared folder.

Defined results: null and empty texts have the single token 0. Rows with equal doc_id, and equal rows,
are packed one by one. An empty table gives no rows. Very long texts become many pieces.
"""

from __future__ import annotations

import math
import re
import sys
import zlib
from array import array

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shoalmap.session import cut, scratch_path

SIZE = 2048
END = 0
CACHE = 150_000
# Rows of a round's table per task that writes it, and per range of a sweep.
TASK_ROWS, RANGE_ROWS = 50_000, 200_000
_LETTER = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff"
# Texts of these characters are cut by a simple pattern; others by the tokenizer's own, which is slower.
_PLAIN = re.compile(rf"[ -~\n{_LETTER}\u00a1\u00bf\u2013\u2014\u2018-\u201f\u2026]*")
_PARTS = re.compile(rf" ?[{_LETTER}]+(?:'[{_LETTER}]+)*|[^{_LETTER}]+?(?= ?[{_LETTER}]|$)")
# Where a cut before a letter would part a contraction, or white space of which the last is a line break.
_RISKY = re.compile(rf"(?:^|[^{_LETTER}])'[{_LETTER}]|[ \n]\n[{_LETTER}]")
_OWN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
# White space to some pattern engines and not to others: such texts go to the tokenizer whole.
_ODD = re.compile("[\x1c-\x1f\x85\u180e]")


_WORD = re.compile(rf" ?[{_LETTER}]+")
# Byte-level BPE writes a byte as a letter: printable ones as themselves, the others from U+0100 on.
_SHOWN = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTE_LETTERS = {b: b for b in _SHOWN} | {b: 256 + k for k, b in enumerate(b for b in range(256) if b not in _SHOWN)}


class Kept(dict):
    """Ids by part, found when first asked for."""

    def __init__(self, tokenizer, merges):
        super().__init__()
        self.tokenizer, self.merges = tokenizer, merges

    def __missing__(self, part: str) -> bytes:
        if _WORD.fullmatch(part):
            # One cut of the tokenizer's pattern: straight to the merges.
            ids = self.merges.encode_ordinary(part)
        else:
            ids = self.tokenizer.encode(part, add_special_tokens=False).ids
        out = array("I", ids)
        if sys.byteorder == "big":
            out.byteswap()
        self[part] = out.tobytes()
        return self[part]


class Encoder:
    """Ids of a byte-level BPE tokenizer, with the ids of parts of texts kept.

    The tokenizer cuts a text by a pattern first and merges inside the cuts, so parts between such cuts
    have the same ids wherever they stand. At most `CACHE` parts are kept. With `markers`, the content of
    an added token is that token, as the tokenizer has it by default; texts with one go to it whole.
    """

    def __init__(self, path: str, markers: bool = False):
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = not markers
        # The tokenizer's merges, by the order of its ids, in an engine that is quicker on single words.
        letters = {chr(letter): byte for byte, letter in _BYTE_LETTERS.items()}
        special = {t.content for t in self.tokenizer.get_added_tokens_decoder().values()}
        self.added = re.compile("|".join(map(re.escape, sorted(special)))) if markers and special else None
        ranks = {bytes(letters[c] for c in token): i for token, i in self.tokenizer.get_vocab().items() if token not in special}
        self.merges = tiktoken.Encoding("merges", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})
        self.kept = Kept(self.tokenizer, self.merges)

    def _parts(self, text: str) -> list[str]:
        if self.added and self.added.search(text):
            return [text]
        if _PLAIN.fullmatch(text) and not (("'" in text or "\n\n" in text or " \n" in text) and _RISKY.search(text)):
            return _PARTS.findall(text)
        return [text] if _ODD.search(text) else _OWN.findall(text)

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        if len(self.kept) > CACHE:
            self.kept = Kept(self.tokenizer, self.merges)
        ids, end = self.kept.__getitem__, END.to_bytes(4, "little")
        return [np.frombuffer(b"".join(map(ids, self._parts(t))) + end if t else end, dtype="<u4") for t in texts]


_ENCODERS: dict[str, Encoder] = {}


def pieces(docs: DataFrame, tokenizer: str, size: int = SIZE, ids: bool = False) -> DataFrame:
    """uid, doc_id, piece, start, length, ids_crc32 and, on demand, ids of all pieces."""
    schema = "doc_id long, piece int, start long, length int, ids_crc32 long" + (", ids array<long>" if ids else "")

    def run(batches):
        encoder = _ENCODERS.setdefault(tokenizer, None) or Encoder(tokenizer, markers=True)
        _ENCODERS[tokenizer] = encoder
        for batch in (b.slice(k, 256) for b in batches for k in range(0, b.num_rows, 256)):
            own, texts = batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()
            for k in range(0, len(texts), 256):
                rows = []
                for doc, got in zip(own[k : k + 256], encoder.encode(texts[k : k + 256]), strict=True):
                    first = len(got) % size or size
                    edges = [0, *range(first, len(got) + 1, size)]
                    for piece, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
                        row = [doc, piece, a, b - a, zlib.crc32(got[a:b].tobytes())]
                        rows.append([*row, got[a:b].tolist()] if ids else row)
                types = [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.int64())]
                columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=False)]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: len(columns)])

    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return plain.mapInArrow(run, schema).withColumn("uid", F.monotonically_increasing_id())


def sweep(sizes: np.ndarray, is_gap: np.ndarray, low: int) -> tuple[list[tuple[int, int, int]], list[int], list[tuple[int, int]]]:
    """One range, in falling order of size, gaps before pieces of their size.

    Returns (piece, gap, what the gap has left before the piece), the pieces without a gap, and the gaps
    left with their sizes, smallest last. A gap that stays at least `low`, the smallest size of the
    range, takes part again with what it has left.
    """
    match, bare = [], []
    # Gaps seen, by size; a bit per size in use finds the smallest that fits.
    held: dict[int, list[int]] = {}
    used = 0
    for i, (size, gap) in enumerate(zip(sizes.tolist(), is_gap.tolist(), strict=True)):
        if gap:
            held.setdefault(size, []).append(i)
            used |= 1 << size
            continue
        fits = used >> size
        if not fits:
            bare.append(i)
            continue
        left = size + (fits & -fits).bit_length() - 1
        name = held[left].pop()
        if not held[left]:
            used &= ~(1 << left)
        match.append((i, name, left))
        left -= size
        if left >= low:
            held.setdefault(left, []).append(name)
            used |= 1 << left
    return match, bare, [(n, size) for size in sorted(held, reverse=True) for n in held[size]]


def _swept(table: DataFrame, ranges: int) -> DataFrame:
    """One sweep over each range of (what, uid, bin, size): matches, then pieces and gaps left over.

    A table of at most a range's rows is one range, so the last rounds need no partitioning.
    part and rank place what is left; a gap that was used and stays out is a gap of the next round.
    """

    def run(batches):
        from pyspark import TaskContext

        parts = [b for b in batches if b.num_rows]
        if not parts:
            return
        what, uid, bins, size = (np.concatenate([np.asarray(b.column(c)) for b in parts]) for c in ("what", "uid", "bin", "size"))
        match, bare, rest = sweep(size, what == GAP, int(size.min()))
        rows = [(PLACED, uid[i], bins[g], left, int(size[i]), 0) for i, g, left in match]
        rows += [(TODO, uid[i], 0, 0, int(size[i]), r) for r, i in enumerate(bare)]
        rows += [(GAP, 0, bins[n], 0, left, r) for r, (n, left) in enumerate(reversed(rest))]
        stay = {n for n, _ in rest}
        last = {g: left - int(size[i]) for i, g, left in match if g not in stay}
        rows += [(NEXT, 0, bins[g], 0, left, 0) for g, left in last.items() if left]
        names = ("what", "uid", "bin", "left", "size", "rank")
        kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64())
        columns = [pa.array(np.array(c, dtype=np.int64)).cast(t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)]
        part = pa.array(np.full(len(rows), TaskContext.get().partitionId(), dtype=np.int32))
        yield pa.RecordBatch.from_arrays([*columns, part], names=[*names, "part"])

    order = [F.desc("size"), F.desc("what"), "uid", "bin"]
    ranged = table.coalesce(1) if ranges <= 1 else table.repartitionByRange(ranges, *order)
    return ranged.sortWithinPartitions(*order).mapInArrow(run, "what int, uid long, bin long, left int, size int, rank long, part int")


PLACED, TODO, GAP, NEXT = 0, 1, 2, 3
STATE = "what int, uid long, bin long, left int, size int"
_STATE = ("what", "uid", "bin", "left", "size")


def _meetings(counts: dict[int, dict[int, tuple[int, int]]]) -> list[tuple[int, int, int, int, int, int]]:
    """Which ranks meet over ranges: (what, part, first rank, how many, number of the first meeting,
    pieces per gap).

    Ranges come in order of size. The pieces left in one take the gaps left before it, nearest first. A
    gap takes as many as the smallest gap of its range can hold of the largest piece of theirs.
    `counts` has, per range, how many pieces and their largest size, how many gaps and their smallest.
    """
    waiting: list[list[int]] = []
    out, number = [], 0
    for part in sorted(counts):
        piece, (todo, largest) = 0, counts[part].get(TODO, (0, 1))
        while piece < todo and waiting:
            at, first, n, smallest = waiting[-1]
            per = max(1, smallest // largest)
            gaps = min(n, -(-(todo - piece) // per))
            take = min(gaps * per, todo - piece)
            out += [(TODO, part, piece, take, number, per), (GAP, at, first, gaps, number, 1)]
            piece, number = piece + take, number + gaps
            waiting[-1] = [at, first + gaps, n - gaps, smallest]
            if gaps == n:
                waiting.pop()
        if GAP in counts[part]:
            n, smallest = counts[part][GAP]
            waiting.append([part, 0, n, smallest])
    return out


def _round(state: DataFrame, ranges: int) -> DataFrame:
    """State after one sweep over all ranges."""
    spark = state.sparkSession
    swept = cut(_swept(state.filter(F.col("what") != PLACED).select("what", "uid", "bin", "size"), ranges), "sweep")
    counts: dict[int, dict[int, tuple[int, int]]] = {}
    sizes = swept.filter(F.col("what").isin(TODO, GAP)).groupBy("part", "what").agg(F.count("*").alias("n"), F.min("size").alias("low"), F.max("size").alias("high"))
    for r in sizes.collect():
        counts.setdefault(r["part"], {})[r["what"]] = (r["n"], r["high"] if r["what"] == TODO else r["low"])
    stretches: dict[tuple[int, int], list[tuple[int, ...]]] = {}
    for what, part, *stretch in _meetings(counts):
        stretches.setdefault((what, part), []).append(tuple(stretch))
    met = [(what, part, own) for (what, part), own in stretches.items()]
    met = spark.createDataFrame(met, "what int, part int, stretches array<struct<first: long, n: long, number: long, per: long>>")
    left = swept.filter(F.col("what").isin(TODO, GAP)).join(F.broadcast(met), ["what", "part"], "left")
    rank = F.col("rank")
    # Stretches of a range don't overlap: a row is in one of them or stays.
    own = F.get(F.filter("stretches", lambda x: (rank >= x["first"]) & (rank < x["first"] + x["n"])), F.lit(0))
    left = left.withColumn("own", own).withColumn("meeting", F.col("own.number") + F.floor((rank - F.col("own.first")) / F.col("own.per")))
    # At most a sequence's worth of pieces meet in one gap.
    order = Window.partitionBy("meeting").orderBy("is_gap", F.desc("size"), "uid").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.partitionBy("meeting")
    pairs = left.filter("meeting IS NOT NULL").withColumn("is_gap", F.col("what") == GAP)
    length = F.when(~F.col("is_gap"), F.col("size")).otherwise(0)
    pairs = pairs.select(
        "what",
        "uid",
        "size",
        "is_gap",
        F.max(F.when(F.col("is_gap"), F.col("bin"))).over(whole).alias("bin"),
        F.max(F.when(F.col("is_gap"), F.col("size"))).over(whole).alias("gap"),
        F.sum(length).over(order).cast("int").alias("used"),
    )
    placed = pairs.filter(~F.col("is_gap")).select(F.lit(PLACED).alias("what"), "uid", "bin", (F.col("gap") - F.col("used") + F.col("size")).alias("left"), "size")
    # The gap comes after its pieces, so what is used before it is all that is used.
    rest = pairs.filter("is_gap AND gap > used").select("what", "uid", "bin", F.lit(0).alias("left"), (F.col("gap") - F.col("used")).alias("size"))
    stay = left.filter("meeting IS NULL").select("what", "uid", "bin", F.lit(0).alias("left"), "size")
    done = swept.filter(F.col("what").isin(PLACED, NEXT)).select(F.when(F.col("what") == NEXT, GAP).otherwise(PLACED).alias("what"), "uid", "bin", "left", "size")
    return done.unionByName(placed).unionByName(rest).unionByName(stay)


def _opened(state: DataFrame, wide: DataFrame, size: int) -> DataFrame:
    """Open a sequence for each row of `wide` (pieces among those still to be placed)."""
    new = wide.select(F.lit(PLACED).alias("what"), "uid", F.col("uid").alias("bin"), F.lit(size).alias("left"), "size")
    gaps = wide.filter(F.col("size") < size).select(F.lit(GAP).alias("what"), F.lit(0).cast("long").alias("uid"), F.col("uid").alias("bin"), F.lit(0).alias("left"), (F.lit(size) - F.col("size")).alias("size"))
    return state.unionByName(new).unionByName(gaps)


def _chosen(state: DataFrame, wide: list[tuple[int, int]], size: int) -> Column:
    """Which of the pieces wider than every gap open a sequence: the largest, as many as their tokens need.

    `wide` has (size, rows) from the largest size down. Sizes are taken whole; of the last size exactly
    the rows missing are taken, by buckets of a hash: whole buckets, and of the last one the smallest uids.
    With sqrt(rows) buckets, neither the driver nor a task gets more than about sqrt(rows) of them.
    """
    open_ = -(-sum(s * n for s, n in wide) // size)
    chosen = F.lit(False)
    for s, n in wide:
        if n <= open_:
            # Sizes are taken from the largest down, so those taken whole are a range among the wide.
            chosen, open_ = F.col("size") >= s, open_ - n
            continue
        if open_:
            buckets = math.isqrt(n) + 1
            bucket = F.pmod(F.xxhash64("uid"), F.lit(buckets))
            last = state.filter((F.col("what") == TODO) & (F.col("size") == s)).withColumn("bucket", bucket)
            counts = sorted((r["bucket"], r["count"]) for r in last.groupBy("bucket").count().collect())
            for b, rows in counts:
                if rows > open_:
                    break
                open_ -= rows
            edge = F.col("uid") < 0
            if open_:
                uid = last.filter(F.col("bucket") == b).orderBy("uid").offset(open_ - 1).limit(1).first()["uid"]
                edge = (bucket == b) & (F.col("uid") <= uid)
            chosen = chosen | ((F.col("size") == s) & ((bucket < b) | edge))
        break
    return (F.col("what") == TODO) & chosen


def pack(table: DataFrame, size: int = SIZE, range_rows: int = RANGE_ROWS) -> DataFrame:
    """uid, sequence_id and offset for the pieces (uid, length) of a written table.

    The state of each round is a folder of one table, by `what`; all placed rows are read from there in
    one scan at the end, so plans do not grow with the rounds.
    """
    spark = table.sparkSession
    root = scratch_path(spark, "packing")
    todo = table.select(F.lit(TODO).alias("what"), "uid", F.lit(0).cast("long").alias("bin"), F.lit(0).alias("left"), F.col("length").cast("int").alias("size"))
    half = F.col("size") > size // 2
    state = _opened(todo.filter(~half), todo.filter(half), size)
    before, number, rows = None, 0, None
    while True:
        # A round of few rows is few files.
        state = state if rows is None else state.coalesce(rows // TASK_ROWS + 1)
        state.select(*_STATE).write.partitionBy("what").parquet(f"{root}/round={number}")
        state = spark.read.schema(STATE).parquet(f"{root}/round={number}").select(*_STATE).filter(F.col("what") != PLACED)
        # At most one row per size.
        sizes = {(r["what"], r["size"]): r["count"] for r in state.groupBy("what", "size").count().collect()}
        left, rows = sum(n for (what, _), n in sizes.items() if what == TODO), sum(sizes.values())
        if not left:
            break
        if before is not None and left >= before:
            raise RuntimeError(f"a round of packing placed none of {left} pieces")
        before, number = left, number + 1
        widest = max((s for what, s in sizes if what == GAP), default=0)
        wide = sorted(((s, n) for (what, s), n in sizes.items() if what == TODO and s > widest), reverse=True)
        opened = None
        if wide:
            chosen = _chosen(state, wide, size)
            state = _opened(state.filter(~chosen), state.filter(chosen), size)
            opened = state.filter(F.col("what") == PLACED)
        state = _round(state.filter(F.col("what") != PLACED), -(-rows // range_rows))
        state = state if opened is None else state.unionByName(opened)
    done = spark.read.schema(f"{STATE}, round int").parquet(root).filter(F.col("what") == PLACED)
    return done.select("uid", F.col("bin").alias("sequence_id"), (F.lit(size) - F.col("left")).cast("long").alias("offset"))


def packed(docs: DataFrame, tokenizer: str | None = None, size: int = SIZE) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id and offset of every piece."""
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("byte_bpe_50k.json")
    table = cut(pieces(docs, tokenizer, size), "pieces")
    where = pack(table, size)
    out = table.join(where, "uid")
    return out.select("doc_id", "piece", "start", F.col("length").cast("long").alias("length"), "ids_crc32", "sequence_id", "offset")
