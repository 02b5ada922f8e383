"""Substring dedup by repeated-phrase automata.

1. Every window of 20 words contains an anchor: of its phrases of 8 words the one with the smallest
   hash. Equal windows have equal anchors, so windows that recur have anchors that recur. Shards send
   the distinct hashes of their anchors; those seen twice anywhere come back.
2. Each shard compiles an Aho-Corasick automaton of its recurring phrases and streams all its
   documents through it. Windows around the places found are the candidates; their 95-bit hashes,
   with the first place in the shard, are grouped over all shards. This confirms the passages and
   gives the first place of each window in the corpus.
3. Shards get back the windows that also start elsewhere or twice, and mark the words of every
   occurrence but the first.

Work and shuffles grow with the input; no group is larger than one row per shard and window, and no
automaton larger than its shard. There is no cap: phrases of any frequency are compiled.

Defined results: a null or empty text has no word and loses none; a text below 20 words loses none.
Rows with equal doc_id are ordered by text, equal rows by place, and count as separate documents;
a null doc_id comes after all others. Other columns pass through unchanged.
"""

from __future__ import annotations

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from shoalmap.llm.shards import shard_count, sharded
from shoalmap.llm.words import Block, blocks, signed

WINDOW = 20
PHRASE = 8
LAST = (1 << 63) - 1


def _anchors(block: Block, window: int, phrase: int) -> np.ndarray:
    """First words of the anchors of all windows."""
    at = block.whole(window)
    if not len(at):
        return at
    reach = window - phrase + 1
    start = np.arange(len(block.words) - phrase + 1)
    h = block.hashes(start, phrase)
    best = np.lib.stride_tricks.sliding_window_view(h, reach)[at].argmin(axis=1)
    return np.unique(at + best)


def _ordered(table: pa.Table) -> tuple[list[str | None], np.ndarray, np.ndarray, pa.Table]:
    """Texts in the order of doc_id, with id and number among equal ids."""
    table = table.sort_by([("doc_id", "ascending"), ("text", "ascending")])
    ids = np.array([LAST if x is None else x for x in table["doc_id"].to_pylist()], dtype=np.int64)
    at = np.arange(len(ids))
    fresh = np.concatenate([[True], ids[1:] != ids[:-1]]) if len(ids) else np.zeros(0, dtype=bool)
    return table["text"].to_pylist(), ids, at - np.maximum.accumulate(np.where(fresh, at, 0)), table


def _places(block: Block, ids: np.ndarray, again: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(doc_id, place) of words; rows of equal doc_id follow each other."""
    rows = np.asarray(block.rows)[block.text[at]]
    return ids[rows], (again[rows] << 40) + block.place(at)


def _send_anchors(window: int, phrase: int):
    def send(key, table):
        found = [block.hashes(a, phrase) for block in blocks(table["text"].to_pylist()) if len(a := _anchors(block, window, phrase))]
        h, n = np.unique(np.concatenate(found) if found else np.zeros(0, np.uint64), return_counts=True)
        shard = pa.array(np.full(len(h), key[0].as_py(), dtype=np.int32))
        return pa.table({"shard": shard, "h": signed(h), "twice": n > 1})

    return send


def _automaton(texts: list[str | None], wanted: np.ndarray, window: int, phrase: int):
    """Automaton of the shard's phrases whose hashes recur in the corpus."""
    machine = ahocorasick.Automaton(ahocorasick.STORE_LENGTH)
    done = np.zeros(len(wanted), dtype=bool)
    for block in blocks(texts):
        at = _anchors(block, window, phrase)
        if not len(at):
            continue
        h = block.hashes(at, phrase)
        spot = np.minimum(np.searchsorted(wanted, h), len(wanted) - 1)
        for i, s in zip(at[hit := wanted[spot] == h].tolist(), spot[hit].tolist(), strict=True):
            if not done[s]:
                done[s] = True
                # One character per byte, so that places found are places in the bytes.
                machine.add_word((b" " + b" ".join(block.words[i : i + phrase]) + b" ").decode("latin-1"))
    machine.make_automaton()
    return machine


def _candidates(block: Block, machine, window: int, phrase: int) -> np.ndarray:
    """First words of all windows that hold a place the automaton finds."""
    if not block.words:
        return np.zeros(0, dtype=np.int64)
    ends = np.fromiter((e for e, _ in machine.iter(" " + block.joined.decode("latin-1"))), dtype=np.int64)
    if not len(ends):
        return ends
    # A match ends with the space after its last word, which the space put in front moves by one.
    first = np.searchsorted(block.ends, ends - 1) - phrase + 1
    change = np.zeros(len(block.words) + 1, dtype=np.int64)
    np.add.at(change, np.maximum(first - (window - phrase), 0), 1)
    np.add.at(change, first + 1, -1)
    at = block.whole(window)
    return at[np.cumsum(change[:-1])[at] > 0]


def _send_windows(window: int, phrase: int):
    schema = pa.schema([(c, pa.int64()) for c in ("h1", "doc", "place", "tag")])

    def send(key, docs, recurring):
        if not recurring.num_rows or not docs.num_rows:
            return schema.empty_table()
        texts, ids, again, _ = _ordered(docs)
        machine = _automaton(texts, np.sort(recurring["h"].to_numpy().view(np.uint64)), window, phrase)
        if not len(machine):
            return schema.empty_table()
        parts = []
        for block in blocks(texts):
            at = _candidates(block, machine, window, phrase)
            if len(at):
                parts.append((block.hashes(at, window), (block.hashes(at, window, 1) >> np.uint64(33)).view(np.int64), *_places(block, ids, again, at)))
        if not parts:
            return schema.empty_table()
        h1, h2, doc, place = (np.concatenate(x) for x in zip(*parts, strict=True))
        # Blocks follow doc_id, so the first of equal hashes in this stable order is the first place.
        order = np.lexsort((np.arange(len(h1)), h2, h1))
        h1, h2, doc, place = h1[order], h2[order], doc[order], place[order]
        new = np.concatenate([[True], (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])])
        at = np.flatnonzero(new)
        n = np.diff(np.append(at, len(h1)))
        # Few wide columns: the shard, 31 more bits of hash and whether it is here twice share one.
        tag = (key[0].as_py() << 32) | (h2[at] << 1) | (n > 1)
        return pa.Table.from_arrays([pa.array(x) for x in (signed(h1[at]), doc[at], place[at], tag)], schema=schema)

    return send


def _mark(window: int, out: pa.Schema):
    def mark(key, docs, known):
        texts, ids, again, docs = _ordered(docs)
        h = known["h"].to_numpy()
        order = np.argsort(h, kind="stable")
        # Windows that start first in another shard have no first place here: all of them go.
        h, doc, place = h[order], *(known[c].combine_chunks().fill_null(-1).to_numpy()[order] for c in ("doc", "place"))
        kept, n_words, n_removed, spans = [None] * len(texts), [0] * len(texts), [0] * len(texts), [[]] * len(texts)
        for block in blocks(texts):
            gone = np.zeros(len(block.words), dtype=bool)
            at = block.whole(window)
            if len(at) and len(h):
                own = signed(block.hashes(at, window))
                spot = np.minimum(np.searchsorted(h, own), len(h) - 1)
                hit = h[spot] == own
                at, spot = at[hit], spot[hit]
                d, p = _places(block, ids, again, at)
                at = at[(doc[spot] != d) | (place[spot] != p)]
                change = np.zeros(len(block.words) + 1, dtype=np.int64)
                np.add.at(change, at, 1)
                np.add.at(change, at + window, -1)
                gone = np.cumsum(change[:-1]) > 0
            for row, first, n in zip(block.rows, block.first.tolist(), block.counts.tolist(), strict=True):
                own = gone[first : first + n]
                n_words[row], n_removed[row] = n, int(own.sum())
                words = block.words[first : first + n]
                if n_removed[row]:
                    edge = np.flatnonzero(np.diff(np.concatenate([[0], own.astype(np.int8), [0]])))
                    spans[row] = [{"start": s, "end": e} for s, e in edge.reshape(-1, 2).tolist()]
                    words = [words[i] for i in np.flatnonzero(~own).tolist()]
                kept[row] = b" ".join(words).decode()
        added = {"kept": pa.array(kept, pa.string()), "n_words": pa.array(n_words, pa.int64()), "n_removed": pa.array(n_removed, pa.int64()), "spans": pa.array(spans, out.field("spans").type)}
        columns = [added[f.name] if f.name in added else docs[f.name] for f in out]
        return pa.Table.from_arrays(columns, names=out.names)

    return mark


SPANS = ArrayType(StructType([StructField("start", LongType()), StructField("end", LongType())]))


def mark_repeats(docs: DataFrame, window: int = WINDOW, phrase: int = PHRASE) -> DataFrame:
    """doc_id, text and the other columns of `docs` (inside `rest`), and per document:

    kept (its remaining words, joined by one space), n_words, n_removed and spans (word ranges taken
    out, end exclusive). A word goes if a window of `window` words around it starts earlier as well.
    """
    base = sharded(docs, shard_count(docs))
    # A group below has one row per shard at most, so a window over it sees each exchange once and
    # joins nothing back.
    anchors = base.groupBy("shard").applyInArrow(_send_anchors(window, phrase), "shard int, h long, twice boolean")
    same = Window.partitionBy("h")
    anchors = anchors.withColumns({"n": F.count("*").over(same), "any": F.max("twice").over(same)})
    recurring = anchors.filter("n > 1 OR any").select("shard", "h")
    windows = (
        base.groupBy("shard")
        .cogroup(recurring.groupBy("shard"))
        .applyInArrow(_send_windows(window, phrase), "h1 long, doc long, place long, tag long")
        .repartition("h1")
    )
    parts = {"shard": F.shiftright("tag", 32).cast("int"), "h2": F.col("tag").bitwiseAND((1 << 32) - 2), "twice": F.col("tag").bitwiseAND(1) == 1}
    windows = windows.withColumns(parts).drop("tag")
    same = Window.partitionBy("h1", "h2")
    windows = windows.withColumns({"first": F.min(F.struct("doc", "place")).over(same), "n": F.count("*").over(same)})
    here = F.expr("doc = first.doc AND place = first.place")
    known = windows.filter(F.col("twice") | ((F.col("n") > 1) & ~here)).select(
        "shard", F.col("h1").alias("h"), F.when(here, F.col("doc")).alias("doc"), F.when(here, F.col("place")).alias("place")
    )
    kept = [StructField("kept", StringType()), StructField("n_words", LongType()), StructField("n_removed", LongType()), StructField("spans", SPANS)]
    schema = StructType([*base.drop("shard").schema.fields, *kept])
    return base.groupBy("shard").cogroup(known.groupBy("shard")).applyInArrow(_mark(window, to_arrow_schema(schema)), schema)


def remove_repeats(docs: DataFrame, window: int = WINDOW, phrase: int = PHRASE) -> DataFrame:
    """The documents without the words that repeat; untouched texts stay as they are.

    A document that loses all its words goes. The columns are those of `docs`; n_chars, if there,
    follows the text.
    """
    out = mark_repeats(docs, window, phrase).filter("n_removed = 0 OR n_removed < n_words")
    text = F.when(F.col("n_removed") > 0, F.col("kept")).otherwise(F.col("text"))
    return out.select(*[_column(c, text, docs) for c in docs.columns])


def _column(name: str, text, docs: DataFrame):
    if name == "doc_id":
        return F.col("doc_id").cast(docs.schema["doc_id"].dataType).alias("doc_id")
    if name == "text":
        return text.alias("text")
    if name == "n_chars":
        changed = F.when(F.col("n_removed") > 0, F.length("kept")).otherwise(F.col("rest.n_chars"))
        return changed.cast(docs.schema["n_chars"].dataType).alias("n_chars")
    return F.col(f"rest.`{name}`").alias(name)


def repeats_digest(docs: DataFrame) -> DataFrame:
    """The digest columns of the checked query."""
    return mark_repeats(docs).select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))
