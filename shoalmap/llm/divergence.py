"""Source divergence audit: how the sources of a language differ in their terms, in exact integers.

Terms are runs of letters (A-Z in lower case) and of characters above ASCII. A language keeps the terms
in at least `MIN_DOCS` of its documents; there are V of them. With n occurrences of a term in a group of
N, its share is p = 1 + floor(1e9 (n + 2) / (N + 2 V)), and two shares differ by
f = floor((p - q)^2 / (p + q)).

The terms of a group are never compared one by one. They are grouped into cells by their two counts, f
is evaluated once per cell and weighed by the cell's multiplicity. Cells of two sources come from the
terms both have; cells with a zero are what remains of each source's own counts, and the last cell is
what remains of V. For the ranking of terms, cells of equal f are merged; every value has a term at least,
so the ten largest values hold all ranks asked for, and only their terms are joined back and put in order.

Tasks count terms per source before they are shuffled. Defined results: null texts, languages and sources
are empty ones; doc_id is not used, so rows of equal doc_id are documents of their own. A group without
terms has the share of a zero count for every kept term. An empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shoalmap.session import cut

MIN_DOCS = 10
TOP = 10
# Terms a task holds before it sends them on.
HELD = 300_000
_PLAIN = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalpha() else 32 for c in range(256))
GROUP = ["lang", "source"]


def terms_of(text: str | None) -> list[bytes]:
    return text.encode().translate(_PLAIN).split() if text else []


def _counted(batches):
    held: dict[tuple[str, str], tuple[Counter, Counter]] = {}
    size = 0

    def rows():
        for (lang, source), (n, docs) in held.items():
            terms = list(n)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(terms), pa.string()), pa.array([source] * len(terms), pa.string()), pa.array([t.decode() for t in terms], pa.string()), pa.array(list(n.values()), pa.int64()), pa.array([docs[t] for t in terms], pa.int64())],
                names=[*GROUP, "term", "n", "docs"],
            )

    for batch in batches:
        for lang, source, text in zip(*(batch.column(c).to_pylist() for c in (*GROUP, "text")), strict=True):
            n, docs = held.setdefault((lang, source), (Counter(), Counter()))
            own = Counter(terms_of(text))
            size -= len(n)
            n.update(own)
            docs.update(own.keys())
            size += len(n)
            if size > HELD:
                yield from rows()
                held, size = {}, 0
    yield from rows()


def term_counts(docs: DataFrame, min_docs: int = MIN_DOCS) -> tuple[DataFrame, DataFrame]:
    """(terms, groups): lang, term and `sources` of kept terms, an array of (source, n) in order of source; lang,
    source and N of every group. All counts of a term meet in one shuffle, and later steps read them from its row.
    """
    plain = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in (*GROUP, "text")])
    found = plain.mapInArrow(_counted, "lang string, source string, term string, n long, docs long")
    counts = found.repartition("lang", "term").groupBy(*GROUP, "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    terms = counts.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sort_array(F.collect_list(F.struct("source", "n"))).alias("sources"))
    terms = cut(terms.filter(F.col("docs") >= min_docs).select("lang", "term", "sources"), "kept")
    sizes = terms.select("lang", F.inline("sources")).groupBy(*GROUP).agg(F.sum("n").alias("total"))
    groups = plain.select(*GROUP).distinct().join(sizes, GROUP, "left").select(*GROUP, F.coalesce("total", F.lit(0).cast("long")).alias("total"))
    return terms, groups


def share(n: Column, total: Column, kept: Column) -> Column:
    """1 + floor(1e9 (n + 2) / (total + 2 kept)), without rounding."""
    above = (n + 2).cast("decimal(20,0)") * F.lit(1_000_000_000).cast("decimal(10,0)")
    below = (total + 2 * kept).cast("decimal(20,0)")
    return (F.lit(1) + F.floor(_div(above, below))).cast("long")


def _div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def distance(p: Column, q: Column) -> Column:
    return _div((p - q) * (p - q), p + q)


def _whole() -> Column:
    """Occurrences of a term in its language."""
    return F.aggregate("sources", F.lit(0).cast("long"), lambda s, x: s + x["n"])


def _languages(terms: DataFrame, groups: DataFrame) -> DataFrame:
    """lang, kept (V) and lang_total (N) of every language."""
    kept = terms.groupBy("lang").agg(F.count(F.lit(1)).alias("kept"), F.sum(_whole()).alias("lang_total"))
    none = F.lit(0).cast("long")
    return groups.select("lang").distinct().join(kept, "lang", "left").select("lang", F.coalesce("kept", none).alias("kept"), F.coalesce("lang_total", none).alias("lang_total"))


def pair_values(terms: DataFrame, groups: DataFrame) -> DataFrame:
    """lang, source, item (another source) and value, f summed over all kept terms."""
    known = groups.join(_languages(terms, groups), "lang")
    a = known.select("lang", F.col("source").alias("a"), F.col("total").alias("a_total"), "kept")
    b = known.select("lang", F.col("source").alias("b"), F.col("total").alias("b_total"))
    # One row per pair of sources, as many as the result has.
    pairs = a.join(b, "lang").filter("a < b")
    own = terms.select("lang", F.inline("sources").alias("source", "c")).groupBy(*GROUP, "c").agg(F.count(F.lit(1)).alias("m"))
    # Each source of a term with those after it in the array.
    first = terms.select("lang", "sources", F.posexplode("sources").alias("i", "x"))
    after = F.inline(F.slice("sources", F.col("i") + 2, F.size("sources"))).alias("b", "cb")
    both = first.select("lang", F.col("x.source").alias("a"), F.col("x.n").alias("ca"), after)
    both = both.groupBy("lang", "a", "b", "ca", "cb").agg(F.count(F.lit(1)).alias("m"))
    zero = F.lit(0).cast("long")

    def cells(df: DataFrame, *parts: tuple[Column, Column, Column]) -> DataFrame:
        made = F.array(*[F.struct(x.alias("ca"), y.alias("cb"), m.alias("m")) for x, y, m in parts])
        return df.select("lang", "a", "b", F.inline(made))

    ca, cb, c, m = (F.col(x) for x in ("ca", "cb", "c", "m"))
    every = [
        cells(both, (ca, cb, m), (ca, zero, -m), (zero, cb, -m), (zero, zero, m)),
        cells(pairs.select("lang", "a", "b").join(own.withColumnRenamed("source", "a"), ["lang", "a"]), (c, zero, m), (zero, zero, -m)),
        cells(pairs.select("lang", "a", "b").join(own.withColumnRenamed("source", "b"), ["lang", "b"]), (zero, c, m), (zero, zero, -m)),
        cells(pairs, (zero, zero, F.col("kept"))),
    ]
    table = every[0].unionByName(every[1]).unionByName(every[2]).unionByName(every[3])
    table = table.groupBy("lang", "a", "b", "ca", "cb").agg(F.sum("m").alias("m")).filter("m <> 0").join(pairs, ["lang", "a", "b"])
    f = distance(share(ca, F.col("a_total"), F.col("kept")), share(cb, F.col("b_total"), F.col("kept")))
    summed = table.withColumn("f", f * m).groupBy("lang", "a", "b").agg(F.sum("f").alias("value"))
    summed = pairs.select("lang", "a", "b").join(summed, ["lang", "a", "b"], "left").withColumn("value", F.coalesce("value", zero))
    sides = F.inline(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item"))))
    return summed.select("lang", "value", sides).select(*GROUP, "item", "value")


def top_terms(terms: DataFrame, groups: DataFrame, top: int = TOP) -> DataFrame:
    """lang, source, item (a term), value and rank of the terms a source has above its language."""
    paired = terms.select("lang", "term", _whole().alias("lang_n"), F.inline("sources"))
    cell = [*GROUP, "n", "lang_n"]
    cells = paired.groupBy(*cell).agg(F.count(F.lit(1)).alias("m")).join(groups, GROUP).join(_languages(terms, groups), "lang")
    p, q = share(F.col("n"), F.col("total"), F.col("kept")), share(F.col("lang_n"), F.col("lang_total"), F.col("kept"))
    cells = cut(cells.withColumn("p", p).withColumn("q", q).filter("p > q").select(*cell, "m", distance(F.col("p"), F.col("q")).alias("value")), "cells")
    values = cells.groupBy(*GROUP, "value").agg(F.sum("m").alias("m"))
    falling = Window.partitionBy(*GROUP).orderBy(F.desc("value"))
    values = values.withColumn("at", F.row_number().over(falling)).filter(F.col("at") <= top)
    before = F.sum("m").over(falling.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("m")
    values = values.withColumn("before", before).filter(F.col("before") < top).select(*GROUP, "value", "before")
    # Written, so that the planner knows how few cells have the largest values, and terms stay where they are.
    largest = cut(cells.join(values, [*GROUP, "value"]).select(*cell, "value", "before"), "largest")
    # Terms of equal value: the first `top` in UTF-8 order are chosen in the tasks already.
    named = paired.join(largest, cell)
    inside = F.row_number().over(Window.partitionBy(*GROUP, "value").orderBy("term"))
    named = named.withColumn("inside", inside).filter(F.col("inside") <= top)
    rank = (F.col("before") + F.col("inside")).cast("int")
    return named.select(*GROUP, F.col("term").alias("item"), "value", rank.alias("rank")).filter(F.col("rank") <= top)


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP) -> DataFrame:
    """lang, source, part, item, value and rank: sources by distance, terms by excess."""
    terms, groups = term_counts(docs, min_docs)
    groups = cut(groups, "groups")
    order = Window.partitionBy(*GROUP).orderBy(F.desc("value"), "item")
    pairs = pair_values(terms, groups).withColumn("rank", F.row_number().over(order).cast("int"))
    ranked = top_terms(terms, groups, top)
    return pairs.withColumn("part", F.lit("pair")).unionByName(ranked.withColumn("part", F.lit("term"))).select(*GROUP, "part", "item", "value", "rank")
