"""Benchmark decontamination by template canonicalisation.

Words are lower-cased and freed of ASCII punctuation. Numbers, names (capitalised words inside a
sentence) and units (after a number) become typed placeholders; placeholders of one type in a row are
one. Windows of five of these tokens, at least three of them words, are the templates. A document's
windows are kept if the benchmark has them and hash-joined to the benchmark's windows. An item is in a
document if at least 0.8 of its windows are, and the slots agree: one value of the item stands for one
value of the document. So exact and near copies are found, and questions with other numbers and names.
The test is made for each place (offset between document and item) and for all places together. In a
sentence with more than `CAPITALS` of its words capitalised, capitals make no names.

An edited copy is found too: at one place, at least `COVER` of the item's tokens lie under windows found
there, and the slots agree.

Windows of the plain case-folded words are matched as well, whatever their case: a passage of `PASSAGE`
words in a row, or of `PART` of the words of a shorter item, is found. An item under five words has one
window of all its words and is found whole.

The benchmark's windows go to the tasks in parts of at most `MAX_WINDOWS`; a larger benchmark takes
several passes over the documents. Documents are never joined with each other.

Defined results: null and empty texts hold no item; items with no template window (under five tokens,
or placeholders nearly throughout) are found by their plain words only; items without words never; copies of an item under several ids are all
reported; a null item_id is left out. Rows of equal doc_id are told apart by their texts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shoalmap.llm.words import Block, blocks, mixed, roll, signed
from shoalmap.session import cut

WINDOW = 5
SHARE = 0.8
MAX_WINDOWS = 1_000_000
# Documents a task reads at a time.
DOCS = 512
CAPITALS = 0.6
# A passage of an item: so many words in a row, or this share of a shorter item.
PASSAGE, PART = 13, 0.75
# An edited copy: this share of the item's tokens lies under windows found at one place.
COVER = 0.6
_PLAIN = 0x5EED0
NUMBER, NAME, UNIT = 1, 2, 3
# Words that are units after a number.
UNITS = (
    "mm cm m km inch inches foot feet ft yard yards mile miles mg g kg t lb lbs oz ton tons ml cl l liter liters litre litres "
    "gallon gallons s sec second seconds min minute minutes h hour hours day days week weeks month months year years "
    "percent degrees degree usd eur dollar dollars euro euros pound pounds cent cents mph kmh kph hz khz mhz w kw mw v kv a "
    "j kj mj cal kcal n pa kpa bar k c f"
).split()
_SPACE = 32
_KEEP = np.array([c >= 128 or chr(c).isalnum() or c == _SPACE for c in range(256)])
_LOWER = np.array([c + 32 if 65 <= c <= 90 else c for c in range(256)], dtype=np.uint8)
_DIGIT = np.array([48 <= c <= 57 for c in range(256)])
_CAPITAL = np.array([65 <= c <= 90 for c in range(256)])
_STOP = np.array([chr(c) in ".!?:" for c in range(256)])
_WEIGHTS = mixed(np.arange(11, 11 + WINDOW, dtype=np.uint64)) | np.uint64(1)


def _unit_hashes() -> np.ndarray:
    block = next(blocks([" ".join(UNITS)]))
    return np.sort(block.hashes(np.arange(len(UNITS)), 1))


class Templates:
    """Tokens and template windows of a block of texts."""

    def __init__(self, block: Block, units: np.ndarray):
        keep = _KEEP[block.data]
        data = _LOWER[block.data[keep]]
        ends = np.flatnonzero(data == _SPACE)
        starts = np.concatenate([np.zeros(1, np.int64), ends[:-1] + 1])
        full = np.flatnonzero(ends > starts)
        start, end, text = starts[full], ends[full], block.text[full]
        at = np.flatnonzero(keep)[start]
        first = block.data[at]
        after = block.data[np.minimum(at + 1, len(block.data) - 1)]
        capital = _CAPITAL[first] | ((first == 0xC3) & (after >= 0x80) & (after <= 0x9E))
        opens = np.concatenate([[True], (text[1:] != text[:-1]) | _STOP[block.data[block.ends[full[:-1]] - 1]]]) if len(full) else full > 0
        h = roll(0).ranges(roll(0).prefix(data), start, end)
        kind = np.zeros(len(full), dtype=np.uint64)
        # In a sentence mostly of capitalised words a capital does not tell a name.
        sentence = np.cumsum(opens) - 1
        shouted = np.bincount(sentence, capital) > CAPITALS * np.bincount(sentence) if len(full) else full > 0
        kind[capital & ~opens & ~shouted[sentence]] = NAME
        kind[_DIGIT[first]] = NUMBER
        spot = np.minimum(np.searchsorted(units, h), len(units) - 1)
        follows = np.concatenate([[False], (kind[:-1] == NUMBER) & (text[1:] == text[:-1])]) if len(full) else full > 0
        kind[follows & (units[spot] == h)] = UNIT
        again = np.concatenate([[False], (kind[1:] > 0) & (kind[1:] == kind[:-1]) & (text[1:] == text[:-1])]) if len(full) else full > 0
        self.head = np.flatnonzero(~again)
        self.tail = np.append(self.head[1:], len(full)) - 1
        self.data, self.start, self.end = data, start, end
        self.kind, self.text = kind[self.head], text[self.head]
        token = np.where(self.kind > 0, self.kind, h[self.head] | np.uint64(4))
        n = len(token) - WINDOW + 1
        if n <= 0:
            self.at, self.hash = np.zeros(0, np.int64), np.zeros(0, np.uint64)
        else:
            total = sum(token[k : k + n] * _WEIGHTS[k] for k in range(WINDOW))
            words = np.concatenate([[0], np.cumsum(self.kind == 0)])
            good = (self.text[WINDOW - 1 :] == self.text[:n]) & (words[WINDOW:] - words[:n] >= 3)
            self.at = np.flatnonzero(good)
            self.hash = mixed(total[self.at])
        sizes = np.bincount(self.text, minlength=len(block.rows)) if len(self.text) else np.zeros(len(block.rows), np.int64)
        self.sizes, self.first = sizes, np.cumsum(sizes) - sizes

    def place(self, at: np.ndarray) -> np.ndarray:
        return at - self.first[self.text[at]]

    def slots(self, at: int) -> list[str]:
        """Values behind the placeholders of a window, in order."""
        found = [i for i in range(at, at + WINDOW) if self.kind[i]]
        return [self.data[self.start[self.head[i]] : self.end[self.tail[i]]].tobytes().decode(errors="replace") for i in found]


def plain_windows(block: Block, short: list[int] | None = None) -> tuple[np.ndarray, ...]:
    """Hashes, texts, places and text lengths of the windows of plain words of a block of case-folded texts.

    A text under `WINDOW` words has one window of all its words. With `short`, windows of those sizes are
    made all over the texts as well.
    """
    keep = _KEEP[block.data]
    data = block.data[keep]
    ends = np.flatnonzero(data == _SPACE)
    starts = np.concatenate([np.zeros(1, np.int64), ends[:-1] + 1])
    full = np.flatnonzero(ends > starts)
    text = block.text[full]
    token = roll(0).ranges(roll(0).prefix(data), starts[full], ends[full])
    sizes = np.bincount(text, minlength=len(block.rows))
    first = np.cumsum(sizes) - sizes
    h, at = [], []
    for size in range(1, WINDOW + 1):
        n = len(token) - size + 1
        if n <= 0 or (size < WINDOW and short is not None and size not in short):
            continue
        good = text[size - 1 :] == text[:n]
        if size < WINDOW and short is None:
            good &= sizes[text[:n]] == size
        own = np.flatnonzero(good)
        h.append(mixed(sum(token[own + k] * _WEIGHTS[k] for k in range(size)) ^ np.uint64(_PLAIN + size)))
        at.append(own)
    h, at = (np.concatenate(x) if x else np.zeros(0, t) for x, t in ((h, np.uint64), (at, np.int64)))
    return h, text[at], at - first[text[at]], sizes[text[at]]


def _windows(wanted: np.ndarray | None, short: list[int] | None = None):
    """Rows of the template and plain windows of a table (id, key, text); only those in `wanted`, if given."""

    def run(batches):
        units = _unit_hashes()
        for batch in (b.slice(k, DOCS) for b in batches for k in range(0, b.num_rows, DOCS)):
            ids, keys = batch.column("id"), batch.column("key")
            rows, hashes, places, slots, plain, sizes = [], [], [], [], [], []
            texts = batch.column("text").to_pylist()
            for block in blocks(t and t.casefold() for t in texts):
                if not block.words:
                    continue
                h, text, place, size = plain_windows(block, short)
                if wanted is not None:
                    hit = wanted[np.minimum(np.searchsorted(wanted, h), len(wanted) - 1)] == h
                    h, text, place, size = h[hit], text[hit], place[hit], size[hit]
                rows += [block.rows[k] for k in text.tolist()]
                hashes.append(signed(h))
                places += place.tolist()
                slots += [[]] * len(h)
                plain += [True] * len(h)
                sizes += size.tolist()
            for block in blocks(texts):
                if not block.words:
                    continue
                t = Templates(block, units)
                at, h = t.at, t.hash
                if wanted is not None:
                    hit = wanted[np.minimum(np.searchsorted(wanted, h), len(wanted) - 1)] == h
                    at, h = at[hit], h[hit]
                rows += [block.rows[k] for k in t.text[at].tolist()]
                hashes.append(signed(h))
                places += t.place(at).tolist()
                slots += [t.slots(k) for k in at.tolist()]
                plain += [False] * len(at)
                sizes += t.sizes[t.text[at]].tolist()
            pick = pa.array(rows, pa.int64())
            h = np.concatenate(hashes) if hashes else np.zeros(0, np.int64)
            columns = [ids.take(pick), keys.take(pick), pa.array(h), pa.array(places, pa.int64()), pa.array(slots, pa.list_(pa.string())), pa.array(plain, pa.bool_()), pa.array(sizes, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "key", "h", "place", "slots", "plain", "size"])

    return run


_ROWS = "id long, key long, h long, place long, slots array<string>, plain boolean, size long"


def _keyed(df: DataFrame, id_column: str) -> DataFrame:
    text = F.col("text").cast("string")
    return df.select(F.col(id_column).cast("long").alias("id"), F.xxhash64(text).alias("key"), text.alias("text"))


def _longest_run(places: Column) -> Column:
    """How many numbers in a row a sorted array holds at most."""
    start = F.struct(F.lit(0).alias("best"), F.lit(0).alias("run"), F.lit(-2).cast("long").alias("last"))

    def step(a: Column, p: Column) -> Column:
        run = F.when(p == a["last"] + 1, a["run"] + 1).otherwise(1)
        return F.struct(F.greatest(a["best"], run).alias("best"), run.alias("run"), p.alias("last"))

    return F.aggregate(places, start, step, lambda a: a["best"])


def find_items(docs: DataFrame, benchmark: DataFrame, share: float = SHARE, most: int = MAX_WINDOWS) -> DataFrame:
    """id and key (hash of the text) of documents, item_id, found (share of the item's windows, of the
    tokens under them in an edited copy, or of the words in a passage) and same (all slots hold the item's own values)."""
    items = _keyed(benchmark, "item_id").filter("id IS NOT NULL").distinct().mapInArrow(_windows(None), _ROWS)
    # An item of several rows is one item per row; the text's hash tells them apart.
    items = items.select(F.col("id").alias("item_id"), F.col("key").alias("item_key"), "h", F.col("place").alias("item_place"), F.col("slots").alias("item_slots"), "plain", "size")
    items = cut(items, "items")
    sizes = items.groupBy("item_id", "item_key", "plain").agg(F.countDistinct("item_place").alias("n"), F.max("size").alias("size"))
    passes = max(1, -(-items.count() // most))
    found = None
    for k in range(passes):
        part = items.filter(F.pmod(F.xxhash64("item_id", "item_key"), F.lit(passes)) == k)
        # Bounded by `most`: this part of the benchmark, not the documents.
        wanted = np.sort(np.array([r.h for r in part.select("h").distinct().collect()], dtype=np.int64).view(np.uint64))
        if not len(wanted):
            continue
        short = [r["size"] for r in part.filter(F.col("plain") & (F.col("size") < WINDOW)).select("size").distinct().collect()]
        hits = _keyed(docs, "doc_id").mapInArrow(_windows(wanted, short), _ROWS).drop("plain", "size").join(F.broadcast(part), "h")
        found = hits if found is None else found.unionByName(hits)
    if found is None:
        return _keyed(docs, "doc_id").limit(0).selectExpr("id", "key", "id AS item_id", "CAST(1 AS DOUBLE) AS found", "true AS same")
    slots = F.arrays_zip(F.col("item_slots").alias("a"), F.col("slots").alias("b"))
    found = found.select("id", "key", "item_id", "item_key", "plain", "item_place", (F.col("place") - F.col("item_place")).alias("offset"), slots.alias("slots"))
    counted = found.groupBy("id", "key", "item_id", "item_key", "plain", "offset").agg(F.collect_set("item_place").alias("places"), F.array_distinct(F.flatten(F.collect_set("slots"))).alias("slots"))
    # Written once: it is read twice below, and making it streams all documents.
    counted = cut(counted, "hits")
    every = counted.filter(~F.col("plain")).groupBy("id", "key", "item_id", "item_key", "plain").agg(
        F.array_distinct(F.flatten(F.collect_list("places"))).alias("places"), F.array_distinct(F.flatten(F.collect_list("slots"))).alias("slots")
    )
    both = counted.withColumn("aligned", F.lit(True)).drop("offset").unionByName(every.withColumn("aligned", F.lit(False)))
    # A value of the item that stands for two values of the document contradicts itself.
    firm = F.size("slots") == F.size(F.array_distinct(F.transform("slots", lambda s: s["a"])))
    same = F.forall("slots", lambda s: s["a"] == s["b"])
    both = both.join(sizes, ["item_id", "item_key", "plain"]).withColumn("windows", F.size("places") / F.col("n"))
    covered = F.size(F.array_distinct(F.flatten(F.transform("places", lambda p: F.sequence(p, p + WINDOW - 1))))) / F.col("size")
    edited = F.col("aligned") & (covered >= COVER)
    passage = _longest_run(F.array_sort("places")) + F.least("size", F.lit(WINDOW)) - 1
    enough = F.least(F.lit(PASSAGE), F.greatest(F.floor(F.col("size") * PART), F.least("size", F.lit(WINDOW))))
    both = both.withColumn("found", F.when(F.col("plain"), passage / F.col("size")).otherwise(F.when(edited, F.greatest("windows", covered)).otherwise(F.col("windows"))))
    both = both.filter(F.when(F.col("plain"), passage >= enough).otherwise(((F.col("windows") >= share) | edited) & firm)).withColumn("same", same)
    return both.groupBy("id", "key", "item_id").agg(F.max("found").alias("found"), F.max("same").alias("same"))


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Per document: doc_id, contaminated, item_ids (in order), best (largest share of an item found)
    and reworded (items found only with other slot values)."""
    hits = find_items(docs, benchmark)
    hits = hits.groupBy("id", "key").agg(
        F.array_sort(F.collect_set("item_id")).alias("item_ids"),
        F.max("found").alias("best"),
        F.array_sort(F.collect_set(F.when(~F.col("same"), F.col("item_id")))).alias("reworded"),
    )
    ids = _keyed(docs, "doc_id").select(F.col("id").alias("doc_id"), F.col("key").alias("_k"))
    out = ids.join(hits, ids["doc_id"].eqNullSafe(hits["id"]) & (ids["_k"] == hits["key"]), "left")
    none = F.array().cast("array<bigint>")
    return out.select(
        "doc_id",
        F.col("item_ids").isNotNull().alias("contaminated"),
        F.coalesce("item_ids", none).alias("item_ids"),
        F.coalesce("best", F.lit(0.0)).alias("best"),
        F.coalesce("reworded", none).alias("reworded"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that hold no item; the columns are those of `docs`."""
    hits = find_items(docs, benchmark).select("id", "key").distinct()
    gone = hits.select(F.col("id").alias("_gone_id"), F.col("key").alias("_gone_key"))
    same = docs["doc_id"].cast("long").eqNullSafe(F.col("_gone_id")) & (F.xxhash64(docs["text"].cast("string")) == F.col("_gone_key"))
    return docs.join(gone, same, "left_anti")
