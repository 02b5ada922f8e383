"""Rows of many groups in blocks, with their folds, and preparation fitted on the training rows of a fold.

A block holds at most about `BLOCK_ROWS` rows of one group as matrices, so a group of any size is many
blocks and no task holds a whole group. Folds are matrices too: a row's fold per repeat, and its inner
fold, dealt out inside its outer fold and class. A training set is (rep_idx, split_idx, inner_idx): all
rows of other folds, and, where inner_idx is not -1, of other inner folds.

Gaps of x are NaN in a block. What a training set says about gaps, means and deviations is a row of the
preparation table, from sums per fold: no value of a test row enters it.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from shoalmap.session import cut, task_floor, tasks_for

BLOCK_ROWS = 2000
# Blocks of a group that are kept in one task, and rows whose hashes are sorted at once.
SLOT = 16
PIECE_ROWS = 2_000_000
# Hashes of a group, rows times repeats, that are made and sorted in one task and not sent.
WHOLE_HASHES = 6_000_000
# Bytes of models that are sent to all tasks; more are dealt to the slots of their group.
SENT_BYTES = 96 << 20
# Folds and repeats of the outer cross-validation.
OUTER_SPLITS, OUTER_REPEATS = 5, 10
# Numbers of partial sums a task holds before it sends them on.
HELD = 4_000_000


def key_fields(df: DataFrame, keys: list[str]) -> list[T.StructField]:
    return [df.schema[k] for k in keys]


def fold_blocks(points: DataFrame, keys: list[str], ids: list[str], xs: str, y: str, k: int, reps: int, seed: int, inner: int = 1, block_rows: int = BLOCK_ROWS, folds: str | None = None, more: list[str] | None = None) -> DataFrame:
    """One row per block: keys, slot, block, n, ids (JSON per row), x (n * p doubles), y (n doubles, 0 or 1), folds
    and inners (n * reps bytes).

    Folds are dealt in the order of a seeded hash of `ids` and the repeat; their sizes differ by one at most, and so
    do the inner folds of each class inside a fold. A column `folds` of `points` can bring folds of the caller's own
    (an array with one per repeat); columns `more` come along in the JSON text.
    """
    named = F.to_json(F.struct(*ids, *(more or []))).alias("_id")
    rows = points.select(*keys, named, F.col(xs).alias("_x"), F.col(y).cast("double").alias("_y"), *([] if folds is None else [F.col(folds).alias("_s")]))
    blocks = pack_blocks(rows, keys, block_rows)
    if folds is not None:
        return blocks
    fields = T.StructType([points.schema[c] for c in ids])

    def order(seed: int) -> Column:
        row = lambda r: F.array(*[F.xxhash64(*[r[c] for c in ids], F.lit(rep), F.lit(seed)) for rep in range(reps)])
        return F.flatten(F.transform(F.transform("ids", lambda t: F.from_json(t, fields)), row))

    blocks = _deal(blocks, keys, order(seed), k, "folds", reps)
    return blocks if inner <= 1 else _deal(blocks, keys, order(seed + 1), inner, "inners", reps)


def group_sizes(blocks: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, total): rows per group, written so that the planner knows how few they are."""
    return cut(blocks.groupBy(*keys).agg(F.sum("n").alias("total")), "sizes")


def packed_tasks(sizes: DataFrame) -> int:
    """Tasks for tables of blocks, by the rows in them."""
    return tasks_for(sizes.sparkSession, sizes.agg(F.sum("total")).first()[0] or 0)


def _deal(blocks: DataFrame, keys: list[str], order: Column, count: int, name: str, reps: int) -> DataFrame:
    """Blocks with the column `name` filled: rows of a group are dealt to `count` folds per repeat in the order of
    a hash (`order`: repeats of all rows of a block); "inners" are dealt inside each outer fold and class.

    A group of at most `WHOLE_HASHES` is dealt in one task, to which only its blocks are sent; of larger ones hashes are.
    """
    sizes = group_sizes(blocks, keys)
    large = F.col("total") * reps > WHOLE_HASHES
    kinds = {r[0] for r in sizes.select(large).distinct().collect()}
    deal = {False: _deal_whole, True: _deal_pieces}
    parts = [deal[kind](blocks.join(sizes.filter(large == kind), keys), keys, order, count, name, packed_tasks(sizes)) for kind in sorted(kinds or {False})]
    return cut(reduce(DataFrame.unionByName, parts), "blocks")


def _dealt_schema(blocks: DataFrame, name: str) -> tuple[list[str], T.StructType]:
    """The columns of blocks that stay, and those of dealt blocks; dealt folds come with an empty column of inner ones."""
    stay = [c for c in blocks.columns if c not in (name, "total")]
    more = [name, *(["inners"] if "inners" not in (*stay, name) else [])]
    return stay, T.StructType([*[blocks.schema[c] for c in stay], *[T.StructField(c, T.BinaryType()) for c in more]])


def _deal_whole(blocks: DataFrame, keys: list[str], order: Column, count: int, name: str, n: int) -> DataFrame:
    """Groups that one task deals: their hashes are made where they are sorted."""
    stay, schema = _dealt_schema(blocks, name)
    out = to_arrow_schema(schema)

    def fill(group: pa.Table) -> pa.Table:
        group = group.sort_by("block")
        rows = group["n"].to_numpy()
        hashes = pa.concat_arrays([c.flatten() for c in group["order"].chunks]).to_numpy().reshape(rows.sum(), -1)
        codes = np.zeros(hashes.shape, dtype=int)
        if name == "inners":
            outer = np.frombuffer(b"".join(group["folds"].to_pylist()), dtype=np.uint8).reshape(hashes.shape)
            codes = outer.astype(int) * 2 + (np.frombuffer(b"".join(group["y"].to_pylist())) > 0)[:, None]
        folds = np.empty(hashes.shape, dtype=np.uint8)
        for rep in range(hashes.shape[1]):
            code = codes[:, rep]
            by = np.lexsort((hashes[:, rep], code))
            counts = np.bincount(code)
            places = np.arange(len(by)) - (np.cumsum(counts) - counts)[code[by]]
            # Classes go on where others end, so that inner folds are even in all.
            folds[by, rep] = (places + code[by] // 2 + code[by] % 2) % count
        parts = np.split(folds, np.cumsum(rows)[:-1])
        new = {name: pa.array([p.tobytes() for p in parts], pa.binary())}
        new = {"inners": pa.array([bytes(p.size) for p in parts], pa.binary())} | new
        return pa.Table.from_arrays([new[f.name] if f.name not in stay else group[f.name].cast(f.type) for f in out], schema=out)

    dealt = blocks.repartition(n, *keys).select(*stay, order.alias("order"))
    return dealt.groupBy(*keys).applyInArrow(fill, schema)


def _deal_pieces(blocks: DataFrame, keys: list[str], order: Column, count: int, name: str, n: int) -> DataFrame:
    """Groups of any size.

    Only hashes are sent, eight bytes a row and repeat in one array per block; a byte a row comes back. A group of more than
    `PIECE_ROWS` rows is cut by the high bits of the hash, and a count per piece gives every piece its start.
    """
    inside = name == "inners"
    bits = F.ceil(F.log2(F.greatest(F.col("total") / PIECE_ROWS, F.lit(1.0)))).cast("int")
    rows = blocks.withColumn("bits", bits)
    fields, at = key_fields(blocks, keys), ["slot", "block"]
    places = [T.StructField(c, T.IntegerType()) for c in ("rep", "piece", *at)]
    sent_schema = T.StructType([*fields, *places, T.StructField("hash", T.BinaryType()), T.StructField("code", T.BinaryType())])
    marked_schema = T.StructType([*fields, *places, T.StructField("marks", T.BinaryType()), T.StructField("counts", T.ArrayType(T.LongType()))])

    def codes(row) -> np.ndarray:
        """Rows of one code are dealt together: fold and class, or all."""
        if not inside:
            return np.zeros((row.n, 1), dtype=np.uint8)
        return np.frombuffer(row.folds, dtype=np.uint8).reshape(row.n, -1) * 2 + (np.frombuffer(row.y) > 0)[:, None]

    def send(tables: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for table in tables:
            for row in table.itertuples(index=False):
                hashes, code, out = np.asarray(row.order).reshape(row.n, -1), codes(row).astype(np.uint8), []
                for rep in range(hashes.shape[1]):
                    own, c = hashes[:, rep], code[:, rep] if inside else None
                    piece = own >> (64 - row.bits) if row.bits else np.zeros(row.n, dtype=int)
                    for value in np.unique(piece):
                        here = piece == value
                        out.append([*[getattr(row, x) for x in keys], rep, int(value), row.slot, row.block, own[here].tobytes(), c[here].tobytes() if inside else b""])
                yield pd.DataFrame(out, columns=sent_schema.names)

    def mark(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("block")
        parts = [np.frombuffer(h, dtype=np.int64) for h in group["hash"]]
        hashes = np.concatenate(parts)
        code = np.frombuffer(b"".join(group["code"]), dtype=np.uint8) if inside else np.zeros(len(hashes), dtype=np.uint8)
        by = np.lexsort((hashes, code)) if inside else np.argsort(hashes, kind="stable")
        counts = np.bincount(code, minlength=256 if inside else 1)
        marks = np.empty(len(hashes), dtype=np.uint8)
        marks[by] = (np.arange(len(hashes)) - (np.cumsum(counts) - counts)[code[by]]) % count
        ends = np.cumsum([len(h) for h in parts])
        out = group[[*keys, "rep", "piece", *at]].copy()
        out["marks"] = [m.tobytes() for m in np.split(marks, ends[:-1])]
        out["counts"] = [counts] + [None] * (len(out) - 1)
        return out

    columns = [*keys, *at, "n", "bits", *(("y", "folds") if inside else ())]
    sent = rows.select(*columns, order.alias("order")).mapInPandas(send, sent_schema)
    marked = cut(sent.groupBy(*keys, "rep", "piece").applyInPandas(mark, marked_schema), "marks")
    earlier = Window.partitionBy(*keys, "rep", "code").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    counts = marked.filter(F.col("counts").isNotNull()).select(*keys, "rep", "piece", F.posexplode("counts").alias("code", "_n"))
    # At most as many rows as there are pieces and codes.
    starts = counts.withColumn("_n", (F.coalesce(F.sum("_n").over(earlier), F.lit(0)) % count).cast("int"))
    starts = starts.groupBy(*keys, "rep", "piece").agg(F.array_sort(F.collect_list(F.struct("code", "_n"))).getField("_n").alias("starts"))
    deals = marked.drop("counts").join(cut(starts, "starts"), [*keys, "rep", "piece"])
    deals = deals.repartition(n, *keys, "slot").groupBy(*keys, *at).agg(F.collect_list(F.struct("rep", "piece", "marks", "starts")).alias("deals"))
    whole, schema = _dealt_schema(blocks, name)
    bare = len(schema) > len(whole) + 1

    def fill(tables: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for table in tables:
            out = []
            for row in table.itertuples(index=False):
                reps = max(d["rep"] for d in row.deals) + 1
                folds, code = np.zeros((row.n, reps), dtype=np.uint8), codes(row).astype(int)
                hashes = np.asarray(row.order).reshape(row.n, -1) if row.bits else None
                for d in row.deals:
                    rep = d["rep"]
                    here = hashes[:, rep] >> (64 - row.bits) == d["piece"] if row.bits else slice(None)
                    c = code[here, rep] if inside else code[here, 0]
                    # Classes go on where others end, so that inner folds are even in all.
                    folds[here, rep] = (np.frombuffer(d["marks"], dtype=np.uint8) + np.asarray(d["starts"])[c] + c // 2 + c % 2) % count
                zeros = [np.zeros_like(folds).tobytes()] if bare else []
                out.append([*[getattr(row, x) for x in whole], folds.tobytes(), *zeros])
            yield pd.DataFrame(out, columns=schema.names)

    dealt = rows.repartition(n, *keys, "slot").join(deals, [*keys, *at])
    again = F.when(F.col("bits") > 0, order).alias("order")
    return dealt.select(*whole, "bits", "deals", again).mapInPandas(fill, schema)


def pack_blocks(rows: DataFrame, keys: list[str], block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Blocks of rows (keys, _id, _x and, for a sample, _y and perhaps _s, the folds); the table is written."""
    sizes = cut(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("total")), "sizes")
    n = packed_tasks(sizes)
    rows = rows.join(sizes.select(*keys, F.ceil(F.col("total") / block_rows).cast("int").alias("_blocks")), keys)
    rows = rows.withColumn("block", F.pmod(F.xxhash64("_id"), F.col("_blocks")).cast("int")).withColumn("slot", F.floor(F.col("block") / SLOT).cast("int")).drop("_blocks")
    sample, own = "_y" in rows.columns, "_s" in rows.columns
    matrices = [*(["y"] if sample else []), *(["folds", "inners"] if own else [])]
    schema = T.StructType(
        [*key_fields(rows, keys), *[T.StructField(c, T.IntegerType()) for c in ("slot", "block", "n")]]
        + [T.StructField("ids", T.ArrayType(T.StringType())), *[T.StructField(c, T.BinaryType()) for c in ("x", *matrices)]]
    )

    def pack(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("_id")
        out = {c: [group[c].iat[0]] for c in [*keys, "slot", "block"]} | {"n": [len(group)], "ids": [group["_id"].tolist()]}
        out["x"] = [np.array(group["_x"].tolist(), dtype=float).tobytes()]
        if sample:
            out["y"] = [group["_y"].to_numpy(dtype=float).tobytes()]
        if own:
            folds = np.array(group["_s"].tolist(), dtype=np.uint8)
            out |= {"folds": [folds.tobytes()], "inners": [np.zeros_like(folds).tobytes()]}
        return pd.DataFrame(out)

    # Blocks of a slot are in one task, so that sums per group are sent by few tasks.
    return cut(rows.repartition(n, *keys, "slot").groupBy(*keys, "slot", "block").applyInPandas(pack, schema), "blocks")


class Block:
    """The matrices of one block row."""

    def __init__(self, row):
        self.n = row.n
        self.x = np.frombuffer(row.x).reshape(self.n, -1)
        if hasattr(row, "y"):
            self.y = np.frombuffer(row.y)
            self.folds = np.frombuffer(row.folds, dtype=np.uint8).reshape(self.n, -1)
            self.inners = np.frombuffer(row.inners, dtype=np.uint8).reshape(self.n, -1)

    def only(self, rows: np.ndarray) -> Block:
        """A block of some of the rows."""
        out = object.__new__(Block)
        out.n, out.x, out.y, out.folds, out.inners = int(rows.sum()), self.x[rows], self.y[rows], self.folds[rows], self.inners[rows]
        return out

    def trained(self, rep: int, split: int, inner: int) -> np.ndarray:
        """Which rows are in a training set."""
        own = self.folds[:, rep] != split
        return own if inner < 0 else own & (self.inners[:, rep] != inner)

    def tested(self, rep: int, split: int, inner: int) -> np.ndarray:
        own = self.folds[:, rep]
        return own == split if inner < 0 else (own != split) & (self.inners[:, rep] == inner)

    def design(self, fill: np.ndarray, mean: np.ndarray, std: np.ndarray, rows: np.ndarray | slice = slice(None)) -> np.ndarray:
        """(1, standardised x) with gaps filled."""
        x = self.x[rows]
        x = (np.where(np.isnan(x), fill, x) - mean) / std
        return np.column_stack([np.ones(len(x)), x])


def summed(partial: DataFrame, keys: list[str], value: str = "sums") -> DataFrame:
    """Sums of arrays per key, combined in the tasks first."""
    total = partial.withColumn(value, array_to_vector(value)).groupBy(*keys).agg(Summarizer.sum(F.col(value)).alias(value))
    return total.withColumn(value, vector_to_array(value))


def sums_by_key(keys: list[str], names: list[str], visit):
    """A function over tables of rows: `visit(row)` yields (name tuple, vector); vectors of equal keys and
    names are added up and sent on at the end, or whenever `HELD` numbers are held."""

    def run(tables: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple, np.ndarray] = {}
        size = 0
        for table in tables:
            for row in table.itertuples(index=False):
                lead = tuple(getattr(row, k) for k in keys)
                for name, vector in visit(row):
                    at = held.get(lead + name)
                    if at is None:
                        held[lead + name] = vector.astype(float)
                        size += len(vector)
                    else:
                        at += vector
                if size > HELD:
                    yield pd.DataFrame([(*k, v) for k, v in held.items()], columns=[*keys, *names, "sums"])
                    held, size = {}, 0
        if held:
            yield pd.DataFrame([(*k, v) for k, v in held.items()], columns=[*keys, *names, "sums"])

    return run


def sum_schema(df: DataFrame, keys: list[str], names: dict[str, T.DataType]) -> T.StructType:
    return T.StructType([*key_fields(df, keys), *[T.StructField(n, t) for n, t in names.items()], T.StructField("sums", T.ArrayType(T.DoubleType()))])


_FOLD = {"rep_idx": T.IntegerType(), "split_idx": T.IntegerType(), "inner_idx": T.IntegerType()}


def preparations(blocks: DataFrame, keys: list[str], k: int, reps: int, inner: int = 1) -> DataFrame:
    """One row per training set: keys, rep_idx, split_idx, inner_idx, n, ones, and per variable fill, mean
    and std (1 where a variable does not vary).

    Gaps are filled with the mean of the outer training set; mean and std are those of the filled
    training rows. With `inner` > 1 there is a row for each inner training set as well.
    """

    def visit(row):
        block = Block(row)
        have = ~np.isnan(block.x)
        x = np.where(have, block.x, 0.0)
        cells = np.column_stack([np.ones(block.n), block.y, have, x, x * x])
        for rep in range(block.folds.shape[1]):
            code = block.folds[:, rep].astype(int) * 256 + block.inners[:, rep]
            for c in np.unique(code):
                yield (rep, int(c) // 256, int(c) % 256), cells[code == c].sum(axis=0)

    partial = blocks.select(*keys, "n", "x", "y", "folds", "inners").mapInPandas(sums_by_key(keys, list(_FOLD), visit), sum_schema(blocks, keys, _FOLD))
    per_fold = summed(partial, [*keys, *_FOLD])
    arrays = [T.StructField(n, T.ArrayType(T.DoubleType())) for n in ("fill", "mean", "std")]
    counts = [T.StructField(n, T.DoubleType()) for n in ("n", "ones")]
    schema = T.StructType([*key_fields(blocks, keys), *[T.StructField(n, t) for n, t in _FOLD.items()], *counts, *arrays])

    def fit(group: pd.DataFrame) -> pd.DataFrame:
        sums = np.array(group["sums"].tolist())
        fold, within = group["split_idx"].to_numpy(), group["inner_idx"].to_numpy()
        p = (sums.shape[1] - 2) // 3
        lead = [group[c].iat[0] for c in [*keys, "rep_idx"]]
        rows = []
        for split in range(k):
            outer = sums[fold != split].sum(axis=0)
            if not outer[0]:
                continue
            have, total = outer[2 : 2 + p], outer[2 + p : 2 + 2 * p]
            fill = np.divide(total, have, out=np.zeros(p), where=have > 0)
            for i in range(-1, inner if inner > 1 else 0):
                s = sums[(fold != split) & (within != i)].sum(axis=0)
                if not s[0]:
                    continue
                gaps = s[0] - s[2 : 2 + p]
                mean = (s[2 + p : 2 + 2 * p] + gaps * fill) / s[0]
                var = (s[2 + 2 * p :] + gaps * fill**2) / s[0] - mean**2
                std = np.sqrt(np.clip(var, 0, None))
                # Rounding leaves a trace of a constant.
                std[std <= 1e-7 * np.maximum(1.0, np.abs(mean))] = 1.0
                rows.append((*lead, split, i, s[0], s[1], fill, mean, std))
        return pd.DataFrame(rows, columns=schema.names)

    # At most k * inner rows per group, whatever the data.
    return cut(per_fold.repartition(task_count(blocks) + 1, *keys, "rep_idx").groupBy(*keys, "rep_idx").applyInPandas(fit, schema), "preparations")


def thinned(blocks: DataFrame, keys: list[str], rows: int) -> DataFrame:
    """(keys, n, x, folds, inners) with about `rows` rows of a group, those with the smallest hashes of
    their ids; all rows of a smaller group."""
    sizes = group_sizes(blocks, keys)
    columns = ["n", "x", "folds", "inners"]
    schema = T.StructType([*key_fields(blocks, keys), *[blocks.schema[c] for c in columns]])

    def thin(tables: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for table in tables:
            out = []
            for row in table.itertuples(index=False):
                block = Block(row)
                share = rows / row.total
                at = np.ones(block.n, dtype=bool)
                if share < 1:
                    at = pd.util.hash_array(np.asarray(row.ids, dtype=object)) < np.uint64(share * (2**64 - 2**12))
                if at.any():
                    out.append([*[getattr(row, k) for k in keys], int(at.sum()), *[m[at].tobytes() for m in (block.x, block.folds, block.inners)]])
            yield pd.DataFrame(out, columns=schema.names)

    return blocks.join(sizes, keys).select(*keys, "n", "ids", "x", "y", "folds", "inners", "total").mapInPandas(thin, schema)


def fitted_rows(points: DataFrame, prepared: DataFrame, keys: list[str], names: list[str], xs: str) -> DataFrame:
    """Rows of any table once per training set of their group, with x filled and standardised as that
    training set says: (all columns, rep_idx, split_idx, inner_idx) and xs replaced."""
    on = prepared.select(*keys, *_FOLD, "fill", "mean", "std")
    z = F.transform(F.arrays_zip(F.col(xs).alias("x"), "fill", "mean", "std"), lambda c: (F.coalesce(c["x"], c["fill"]) - c["mean"]) / c["std"])
    return points.join(on, keys).withColumn(xs, z).drop("fill", "mean", "std")


def chunked(models: DataFrame, keys: list[str], columns: list[str], per_chunk: int = 64) -> DataFrame:
    """Models of a group in arrays of about `per_chunk`: (keys, chunk, models)."""
    chunk = F.floor(F.col("model") / per_chunk).cast("int")
    return models.groupBy(*keys, chunk.alias("chunk")).agg(F.collect_list(F.struct(*columns)).alias("models"))


def task_count(df: DataFrame) -> int:
    """Tasks for work that is heavy for its bytes, which would be merged into a few by their size."""
    return task_floor(df.sparkSession)


def met(blocks: DataFrame, models: DataFrame, keys: list[str], columns: list[str], per_chunk: int = 64) -> DataFrame:
    """Blocks with the models of their group in arrays.

    Models of up to `SENT_BYTES` are sent and blocks stay where they are. Of more models, `SLOT` blocks of a group
    meet a copy in one task, so a large group is many tasks.
    """
    arrays = chunked(models, keys, columns, per_chunk)
    wide = [F.size(c) * 8 for c in columns if isinstance(models.schema[c].dataType, T.ArrayType)]
    wide += [F.length(c) for c in columns if isinstance(models.schema[c].dataType, T.BinaryType)]
    held = models.agg(F.sum(sum(wide, F.lit(100)))).first()[0] or 0
    if held <= SENT_BYTES:
        return blocks.join(F.broadcast(arrays), keys)
    n = packed_tasks(group_sizes(blocks, keys))
    tops = cut(blocks.groupBy(*keys).agg(F.max("slot").alias("_top")), "tops")
    arrays = arrays.join(tops, keys).withColumn("slot", F.explode(F.sequence(F.lit(0), F.col("_top"))))
    return blocks.repartition(n, *keys, "slot").join(arrays.drop("_top").repartition(n, *keys, "slot"), [*keys, "slot"])


def fold_models(prepared: DataFrame, keys: list[str], grid: list[float]) -> DataFrame:
    """A model per training set and value of C, numbered inside its group."""
    every = prepared.withColumn("C", F.explode(F.array(*[F.lit(float(c)) for c in grid])))
    order = Window.partitionBy(*keys).orderBy(*_FOLD, "C")
    # As many rows per group as there are models.
    return every.withColumn("model", F.row_number().over(order) - 1)
