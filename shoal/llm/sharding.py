"""Contiguous shards of equal bytes, by global prefix sums of document sizes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoal.llm.prefix import ordered_pieces, running_totals

# Bytes that a document takes in a shard beside its text.
HEADER_BYTES = 8


def assign_shards(docs: DataFrame, shards: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Puts every document into one of ``shards`` contiguous ranges of the document order.

    Returns ``(doc_id, size, text_crc32, shard, slot)``: ``size`` is the UTF-8 length plus
    eight, ``slot`` counts from 0 inside the shard. Documents are in the order of their id
    (nulls first), then of checksum and size. The shard is where the middle of the document
    falls when all bytes are cut at ``shards`` equal targets, so a shard differs from its
    target by at most one document.

    A null text counts as empty. Rows with the same id, or wholly the same, each take a
    slot of their own. A document larger than a target may leave a neighbour shard empty.
    An empty table gives an empty result. Other columns are not read. Only ids, sizes and
    checksums are shuffled, never texts.
    """
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    narrow = docs.select(
        F.col(f"`{id_col}`").alias("doc_id"),
        (F.octet_length(text) + HEADER_BYTES).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        # Spreads rows that are equal in all that is returned; it changes no result.
        F.monotonically_increasing_id().alias("_tie"),
    )
    order = [F.col(c) for c in ("doc_id", "text_crc32", "size", "_tie")]
    rows, totals = running_totals(
        ordered_pieces(narrow, order), order, {"_bytes": F.col("size"), "_rows": F.lit(1)}
    )
    whole = totals.select(F.col("_bytes").alias("_all"))
    middle = 2 * F.col("_bytes") + F.col("size")
    # Decimals: twice the bytes of 100 TB times many shards is past a long.
    at = F.floor(middle.cast("decimal(20,0)") * shards / (2 * F.col("_all")).cast("decimal(20,0)")).cast("int")
    placed = rows.join(F.broadcast(whole)).withColumn("shard", at)
    firsts = placed.groupBy("shard").agg(F.min("_rows").alias("_first"))
    placed = placed.join(F.broadcast(firsts), "shard")  # one row per shard
    return placed.select("doc_id", "size", "text_crc32", "shard", (F.col("_rows") - F.col("_first")).alias("slot"))
