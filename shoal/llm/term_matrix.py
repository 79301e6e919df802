"""Sparse document-term matrix: a global dictionary of words and shards in compressed rows (CSR).

Tasks cut their documents into shards. A shard numbers its own words, so a word is named once per shard and not
once per occurrence. The words of all shards are dealt by hash into parts of a bounded size; a part numbers its
distinct words, the parts before it are its offset, and each shard's own numbers are replaced by these global
columns. No task ever holds the global dictionary. Arrays travel as bytes, so that Spark moves a few rows per shard.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, LongType, StructField, StructType

from shoal.llm.common import written

# A shard ends at the first document that brings it to this many entries or distinct words.
SHARD_ENTRIES = 500_000
SHARD_TERMS = 200_000
# Words (of shards) in one part of the dictionary, on average.
PART_TERMS = 1_000_000


def _local_shards(keyed: DataFrame, keep: list[str], fields: list[StructField], facts: Callable, entries: int, terms: int) -> DataFrame:
    """One row per shard, columns numbered by the shard; ``words`` holds its words between blanks."""
    row = StructType([*(keyed.schema[c] for c in keep), *fields])
    arrays = [StructField(n, BinaryType(), False) for n in ("indptr", "columns", "counts", "words")]
    schema = StructType([StructField("shard", LongType(), False), StructField("rows", ArrayType(row), False), *arrays, StructField("terms", IntegerType(), False)])
    kinds = {f.name: to_arrow_type(f.dataType) for f in schema}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_128_digest
        first = TaskContext.get().partitionId() << 32
        made = 0
        number: dict[bytes, int] = {}
        rows, sizes, columns, counts = [], [], [], []

        def shard() -> pa.RecordBatch:
            # Words in the order of their keys: each part of the dictionary is a slice of them.
            words = sorted(number, key=digest)
            place = np.empty(len(number), np.int32)
            place[[number[w] for w in words]] = np.arange(len(words), dtype=np.int32)
            values = {
                "shard": first + made,
                "rows": rows,
                "indptr": np.cumsum([0, *sizes], dtype=np.int64).tobytes(),
                "columns": place[np.concatenate(columns)].tobytes(),
                "counts": np.concatenate(counts).tobytes(),
                "words": b" ".join(words),
                "terms": len(number),
            }
            return pa.RecordBatch.from_arrays([pa.array([v], type=kinds[n]) for n, v in values.items()], names=list(values))

        held = 0
        for batch in batches:
            kept = batch.select(keep).to_pylist()
            for own, text in zip(kept, batch.column(len(keep)).to_pylist()):
                text = text or ""
                data = text.encode("utf-8", "surrogatepass")
                found = Counter(data.split())
                own.update(zip((f.name for f in fields), facts(text, data)))
                rows.append(own)
                columns.append(np.fromiter((number.setdefault(w, len(number)) for w in found), np.int32, len(found)))
                counts.append(np.fromiter(found.values(), np.int32, len(found)))
                sizes.append(len(found))
                held += len(found)
                if held >= entries or len(number) >= terms:
                    yield shard()
                    made, held, number = made + 1, 0, {}
                    rows, sizes, columns, counts = [], [], [], []
        if rows:
            yield shard()

    return keyed.mapInArrow(run, schema)


def _dealt(shards: DataFrame, parts: int) -> DataFrame:
    """``(shard, part, place, keys)``: the 16-byte keys of a shard's words in each part; ``place`` numbers the first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_128_digest
        # The least upper half of a key in each part.
        edges = np.array([(p << 64) // parts for p in range(parts)], np.uint64)
        for batch in batches:
            for shard, words in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                keys = b"".join(map(digest, words.split()))
                upper = np.frombuffer(keys, ">u8")[::2].astype(np.uint64)
                cuts = np.append(np.searchsorted(upper, edges), len(upper)).tolist()
                some = [p for p in range(parts) if cuts[p + 1] > cuts[p]]
                arrays = [[shard] * len(some), some, [cuts[p] for p in some], [keys[16 * cuts[p] : 16 * cuts[p + 1]] for p in some]]
                kinds = [pa.int64(), pa.int32(), pa.int32(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(a, k) for a, k in zip(arrays, kinds)], names=["shard", "part", "place", "keys"])

    return shards.select("shard", "words").mapInArrow(run, "shard long, part int, place int, keys binary")


def _numbered(dealt: DataFrame) -> DataFrame:
    """``(part, distinct, shard, place, ranks)``: the words of each part numbered from 0 in the order of their keys."""

    def number(part: pa.Table) -> pa.Table:
        keys = [np.frombuffer(k, ">u8").reshape(-1, 2) for k in part.column("keys").to_pylist()]
        flat = np.concatenate(keys).astype(np.uint64)
        order = np.lexsort((flat[:, 1], flat[:, 0]))
        fresh = np.ones(len(flat), np.int64)
        fresh[1:] = (flat[order[1:]] != flat[order[:-1]]).any(axis=1)
        ranks = np.empty(len(flat), np.int32)
        ranks[order] = np.cumsum(fresh) - 1
        own = np.split(ranks, np.cumsum([len(k) for k in keys])[:-1])
        arrays = [
            part.column("part"),
            pa.array(np.full(len(keys), int(fresh.sum()), np.int64)),
            part.column("shard"),
            part.column("place"),
            pa.array([r.tobytes() for r in own], pa.binary()),
        ]
        return pa.Table.from_arrays(arrays, names=["part", "distinct", "shard", "place", "ranks"])

    return dealt.groupBy("part").applyInArrow(number, "part int, distinct long, shard long, place int, ranks binary")


def _no_facts(text: str, data: bytes) -> tuple:
    return ()


def term_matrix(
    docs: DataFrame,
    keep: list[str],
    text_col: str = "text",
    fields: list[StructField] | None = None,
    facts: Callable[[str, bytes], tuple] = _no_facts,
    entries: int = SHARD_ENTRIES,
    terms: int = SHARD_TERMS,
    part_terms: int = PART_TERMS,
) -> tuple[DataFrame, DataFrame]:
    """The matrix of ``docs`` in CSR shards, and the words of the shards with their columns.

    Shards are ``(shard, rows, indptr, columns, counts)``: row ``i`` of a shard is the document ``rows[i]`` (its
    columns ``keep``, and ``fields`` as ``facts`` finds them in the text and its bytes), its entries are ``columns[indptr[i]:
    indptr[i + 1]]`` (global, distinct) with their ``counts``; ``csr`` reads the three arrays. The words are
    ``(shard, words, columns)``, in the same order. Words are runs of characters other than ASCII blanks, case-sensitive;
    128-bit keys tell them apart. Columns are gapless from 0.

    A null or empty text is an empty row. Repeated rows each have a row. An empty table has no shards. A very
    long text is one row of its shard. Other columns are not read.
    """
    keyed = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text_col}`").alias("_text"))
    shards = written(_local_shards(keyed, keep, fields or [], facts, entries, terms), "term-shards")
    total = shards.agg(F.coalesce(F.sum("terms"), F.lit(0)).alias("n")).first().n
    numbered = written(_numbered(_dealt(shards, max(1, -(-total // part_terms)))), "term-numbers")
    # One row per part.
    sizes = numbered.groupBy("part").agg(F.first("distinct").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    placed = numbered.join(F.broadcast(offsets), "part").select("shard", "before", "place", "ranks")

    def in_order(places: pa.Table) -> np.ndarray:
        rows = sorted(zip(*(places.column(n).to_pylist() for n in ("place", "before", "ranks"))))
        return np.concatenate([np.empty(0, np.int64), *(np.frombuffer(ranks, np.int32) + np.int64(first) for _, first, ranks in rows)])

    def renumber(shard: pa.Table, places: pa.Table) -> pa.Table:
        columns = in_order(places)[np.frombuffer(shard.column("columns")[0].as_py(), np.int32)]
        return shard.set_column(shard.column_names.index("columns"), "columns", pa.array([columns.tobytes()], pa.binary()))

    def with_columns(shard: pa.Table, places: pa.Table) -> pa.Table:
        return shard.append_column("columns", pa.array([in_order(places).tobytes()], pa.binary()))

    body = shards.select("shard", "rows", "indptr", "columns", "counts")
    words = shards.select("shard", "words")
    by_shard = placed.groupBy("shard")
    matrix = body.groupBy("shard").cogroup(by_shard).applyInArrow(renumber, body.schema)
    return matrix, words.groupBy("shard").cogroup(by_shard).applyInArrow(with_columns, "shard long, words binary, columns binary")


def csr(indptr: bytes, columns: bytes, counts: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The three arrays of a shard."""
    return np.frombuffer(indptr, np.int64), np.frombuffer(columns, np.int64), np.frombuffer(counts, np.int32)


def row_measures(matrix: DataFrame) -> DataFrame:
    """Columns of the documents, ``n_words`` (row sum) and ``n_distinct`` (entries of the row)."""
    row = matrix.schema["rows"].dataType.elementType
    schema = StructType([*row.fields, StructField("n_words", LongType(), False), StructField("n_distinct", LongType(), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                rows = batch.column("rows")[i].values
                indptr, _, counts = csr(*(batch.column(n)[i].as_py() for n in ("indptr", "columns", "counts")))
                upto = np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])
                arrays = [rows.field(k) for k in range(len(row))]
                arrays += [pa.array(upto[indptr[1:]] - upto[indptr[:-1]]), pa.array(np.diff(indptr))]
                yield pa.RecordBatch.from_arrays(arrays, names=schema.fieldNames())

    return matrix.select("rows", "indptr", "columns", "counts").mapInArrow(run, schema)
