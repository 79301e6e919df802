"""What several operators need: session settings, text keys, word hashes."""

from __future__ import annotations

import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructField, StructType

from shoal.session import discard, shared_dir, ship_package, written  # noqa: F401

# Rows of one Arrow batch: whole texts travel, so a batch is kept small.
BATCH_ROWS = 1000


def ready(spark: SparkSession) -> None:
    """Ship the package, name the shared folder and keep Arrow batches small."""
    ship_package(spark)
    shared_dir(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def release(spark: SparkSession) -> None:
    """Lets Spark delete shuffle files and checkpoints that nothing refers to any more.

    Its cleaner learns of them when the driver collects its garbage, which a driver with little to do puts off; a loop
    of many small rounds would keep the files of all of them until then.
    """
    gc.collect()
    spark._jvm.System.gc()


def text_key(text: Column) -> Column:
    """128 bits of a text as a struct of two longs; equal texts have equal keys."""
    return F.struct(F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(17), text).alias("k2"))


def with_wrapped_row(df: DataFrame) -> DataFrame:
    """``df`` as one struct column ``row``, so that added columns cannot clash with its own."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"))


class WordHashes(dict):
    """Word bytes -> 64-bit hash, remembered while the table stays small."""

    LIMIT = 1_000_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def ascii_words(text: str | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased, as UTF-8 bytes."""
    return [] if text is None else text.encode("utf-8", "surrogatepass").lower().split()


def hash_words(words: list[bytes], known: WordHashes) -> np.ndarray:
    return np.fromiter(map(known.__getitem__, words), dtype=np.uint64, count=len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit mixing step (shifts and odd multipliers)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def rolling(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of each window of ``k`` words; empty when there are fewer than ``k``."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    total = np.zeros(n, np.uint64)
    factor = 0x9E3779B97F4A7C15
    for i in range(k):
        total += hashes[i : i + n] * np.uint64(factor)
        factor = (factor * 0xD1342543DE82EF95 + 0x2545F4914F6CDD1D) & (2**64 - 1) | 1
    return mixed(total)


def shingle_set(words: list[bytes], known: WordHashes, k: int = 5) -> np.ndarray:
    """Sorted distinct ``k``-word shingles; fewer words are one shingle; none are none."""
    if not words:
        return np.empty(0, np.uint64)
    hashes = hash_words(words, known)
    if len(words) < k:
        return mixed(rolling(hashes, len(words)) + np.uint64(len(words)))
    return np.unique(rolling(hashes, k))


def signed(x: np.ndarray) -> np.ndarray:
    """Unsigned 64-bit values as the longs of Spark."""
    return x.astype(np.uint64, copy=False).view(np.int64)


def add_from_text(
    df: DataFrame, text_col: str, keep: list[str], fields: list[StructField], make: Callable[[], Callable]
) -> DataFrame:
    """Columns ``keep`` of ``df`` unchanged, and ``fields`` computed from its texts in Arrow batches.

    ``make()`` runs once per task and gives a function from a list of texts to one list
    per field. Texts are not passed on; the kept columns never leave Arrow.
    """
    taken = df.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text_col}`").alias("_text"))
    schema = StructType([*(taken.schema[c] for c in keep), *fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of_texts = make()
        for batch in batches:
            new = of_texts(batch.column(len(keep)).to_pylist())
            arrays = [batch.column(i) for i in range(len(keep))]
            arrays += [pa.array(v, type=to_arrow_type(f.dataType)) for v, f in zip(new, fields)]
            yield pa.RecordBatch.from_arrays(arrays, names=schema.fieldNames())

    return taken.mapInArrow(run, schema)
