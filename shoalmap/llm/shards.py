"""Shards: bounded groups of documents that several passes can name again.

A document belongs to shard hash(doc_id) mod n, with n from the size of all texts, so a shard holds a
few megabytes whatever the size of the corpus. Tasks pre-aggregate what they find per shard, and what
the corpus knows about it comes back by the shard number. Rows of equal doc_id share a shard.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SHARD_BYTES = 4 << 20


def shard_count(docs: DataFrame, text: str = "text", size: int = SHARD_BYTES) -> int:
    """Number of shards of about `size` bytes of text; one row comes back to the driver."""
    total = docs.agg(F.sum(F.octet_length(F.col(text).cast("string")))).first()[0]
    return max(1, -(-int(total or 0) // size))


def sharded(docs: DataFrame, shards: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Columns shard, doc_id, text and `rest`, a struct of all columns of `docs`.

    Whatever the extra columns are named, they can't clash: they are inside `rest` and come out again
    with `rest.*`.
    """
    return docs.select(
        F.pmod(F.xxhash64(F.col(doc_id)), F.lit(shards)).cast("int").alias("shard"),
        F.col(doc_id).cast("long").alias("doc_id"),
        F.col(text).cast("string").alias("text"),
        F.struct(*[F.col(f"`{c}`") for c in docs.columns if c not in (doc_id, text)], F.lit(True).alias("_held")).alias("rest"),
    )
