"""Spectral embedding of large tables: entries and vectors stand as blocks in the shared folder.

Nodes are dealt to blocks by a hash. The entries between two blocks are packed once; a product is a task for each block of
its result, which reads those entries and the blocks of the vectors that they need. Nothing is shuffled between products:
a product writes its result once and reads the rest.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs as arrow_fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from shoal.session import checked_broadcast, drop_path, scratch_path, shuffle_tasks, written

# Entries between two blocks, on average at most: one task packs some of these lots.
PAIR_ENTRIES = 2_000_000
# Entries of one packed row.
CHUNK = 1 << 18


class Level(NamedTuple):
    """Columns ``lo`` to ``hi`` of the vectors that stand in a folder."""

    path: str
    lo: int
    hi: int


class Store(NamedTuple):
    """Packed entries. Shared ones are numbered without a group: ``blocks`` of them stand for those of every group."""

    path: str
    blocks: int | None = None


class Side(NamedTuple):
    """The names of the rows or columns of all matrices; ``scaled`` if they have factors."""

    path: str
    scaled: bool


def _open(path: str, k: int) -> Iterator[pq.ParquetFile]:
    files, root = arrow_fs.FileSystem.from_uri(re.sub("^file:/+", "/", path))
    for info in sorted(files.get_file_info(arrow_fs.FileSelector(f"{root}/k={k}", allow_not_found=True)), key=lambda i: i.path):
        if info.base_name.endswith(".parquet") and info.base_name[0] not in "._":
            with files.open_input_file(info.path) as source:
                yield pq.ParquetFile(source)


def _column(path: str, k: int, name: str):
    """The value of the only row of a block; None if the block is empty."""
    for file in _open(path, k):
        for value in file.read(columns=[name]).column(name):
            return value.as_py()
    return None


def _numbers(data: bytes | None, kind: type) -> np.ndarray:
    return np.frombuffer(data or b"", kind)


def _matrix(level: Level, k: int, n: int) -> np.ndarray:
    x = _numbers(_column(level.path, k, "x"), np.float64)
    return x.reshape(n, -1)[:, level.lo : level.hi] if n else np.zeros((0, level.hi - level.lo))


def _size(side: Side, k: int) -> int:
    return _column(side.path, k, "n") or 0


def _put(df: DataFrame, path: str, packed: bool = False) -> str:
    df.write.option("compression", "snappy" if packed else "none").partitionBy("k").parquet(path)
    return path


def _names(names: DataFrame, path: str, blocks: int, draws: list[Column]) -> tuple[str, dict[int, tuple[int, int]]]:
    """Writes the sorted ids, factors and first vectors of each block of ``names (k, id, factor)``; their sizes and checksums."""

    drawn = len(draws)

    def pack(group: pa.Table) -> pa.Table:
        ids, first = np.unique(group.column("id").to_numpy(), return_index=True)
        factor = group.column("factor").to_numpy()[first]
        x = np.stack([group.column(f"q{i}").to_numpy() for i in range(drawn)], 1)[first] if drawn else np.zeros(0)
        data = [ids.tobytes(), factor.tobytes(), x.tobytes()]
        values = [[group.column("k")[0].as_py()], [len(ids)], [zlib.crc32(data[0])], *[[d] for d in data]]
        return pa.Table.from_arrays([pa.array(v, t) for v, t in zip(values, (pa.int32(), pa.int32(), pa.int64(), *[pa.binary()] * 3))], names=["k", "n", "sum", "ids", "factor", "x"])

    dealt = names.repartition(blocks, "k").select("k", "id", "factor", *[d.alias(f"q{i}") for i, d in enumerate(draws)])
    packed = dealt.groupBy("k").applyInArrow(pack, "k int, n int, sum long, ids binary, factor binary, x binary")
    _put(packed, path)
    rows = names.sparkSession.read.parquet(path).select("k", "n", "sum").collect()
    return path, {r.k: (r.n, r["sum"]) for r in rows}


def _packed(entries: DataFrame, to: Side, source: Side, path: str, tasks: int) -> str:
    """Writes ``entries (k, j, to, from, weight)`` by blocks: rows, where each begins, columns and values."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        k, j, row, col, val = (np.concatenate([b.column(i).to_numpy(zero_copy_only=False) for b in held]) for i in range(5))
        held.clear()
        pair = k.astype(np.int64) << 32 | j
        order = np.argsort(pair, kind="stable")
        cuts = np.flatnonzero(np.diff(pair[order], prepend=-1, append=-1))
        for lo, hi in zip(cuts[:-1], cuts[1:]):
            own = order[lo:hi]
            at, by = int(k[own[0]]), int(j[own[0]])
            names, others = (_numbers(_column(s.path, b, "ids"), np.int64) for s, b in ((to, at), (source, by)))
            if not len(names) or not len(others):
                continue
            r, c = (np.minimum(np.searchsorted(n, x[own]), len(n) - 1) for n, x in ((names, row), (others, col)))
            known = (names[r] == row[own]) & (others[c] == col[own])
            r, c, v = r[known], c[known], val[own][known]
            order_in = np.argsort(r * len(others) + c, kind="stable")
            r, c, v = r[order_in], c[order_in], v[order_in]
            for a in range(0, len(r), CHUNK):
                part = r[a : a + CHUNK]
                starts = np.flatnonzero(np.diff(part, prepend=-1))
                data = part[starts].astype(np.int32), starts.astype(np.int32), c[a : a + CHUNK].astype(np.int32), v[a : a + CHUNK].astype(np.float64)
                arrays = [pa.array([at], pa.int32()), pa.array([by], pa.int32()), *[pa.array([d.tobytes()], pa.binary()) for d in data]]
                yield pa.RecordBatch.from_arrays(arrays, names=["k", "j", "row", "start", "col", "val"])

    dealt = entries.repartition(tasks, "k", "j")
    return _put(dealt.mapInArrow(run, "k int, j int, row binary, start binary, col binary, val binary"), path, packed=True)


def _times(stores: list[Store], k: int, n: int, level: Level, source: Side, per_group: int) -> np.ndarray:
    """Block ``k`` of a product: its packed entries times the blocks of the vectors."""
    total = np.zeros((level.hi - level.lo, n))
    for store in stores:
        base = 0 if store.blocks is None else k // per_group * per_group
        at, x = None, None
        for file in _open(store.path, k if store.blocks is None else k % per_group):
            for batch in file.iter_batches(batch_size=4):
                for row in batch.to_pylist():
                    if row["j"] + base != at:
                        at = row["j"] + base
                        x = _matrix(level, at, _size(source, at))
                        if source.scaled:
                            x = x * _numbers(_column(source.path, at, "factor"), np.float64)[:, None]
                        x = np.ascontiguousarray(x.T)
                    rows, starts, cols = (_numbers(row[c], np.int32).astype(np.intp) for c in ("row", "start", "col"))
                    vals = _numbers(row["val"], np.float64)
                    for out, column in zip(total, x):
                        out[rows] += np.add.reduceat(vals * column[cols], starts)
    return np.ascontiguousarray(total.T)


class Blocks:
    """Block numbers and folders of one embedding."""

    def __init__(self, spark: SparkSession, groups: int, per_group: int, tasks: int):
        self.spark, self.root = spark, scratch_path(spark, "blocks")
        self.per_group, self.count, self.tasks, self.made = per_group, groups * per_group, tasks, 0

    def path(self) -> str:
        self.made += 1
        return f"{self.root}/{self.made}"

    def number(self, name: str | Column) -> Column:
        return F.pmod(F.xxhash64(name), F.lit(self.per_group)).cast("int")

    def each(self, make, schema: str) -> DataFrame:
        """``make(k)`` gives the values of the row of block ``k``."""
        fields = [f.strip().split(" ")[0] for f in schema.split(",")]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for k in batch.column(0).to_pylist():
                    values = make(k)
                    if values is not None:
                        yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), *[pa.array([v], pa.binary()) for v in values]], names=fields)

        dealt = self.spark.range(0, self.count, 1, numPartitions=min(self.count, 4 * self.tasks))
        return dealt.mapInArrow(run, schema)

    def product(self, parts: list[tuple[list[Store], Level, Side]], to: Side) -> Level:
        """The sum of the products of packed entries and vectors."""
        per_group = self.per_group

        def make(k: int):
            n = _size(to, k)
            if not n:
                return None
            out = sum(_times(stores, k, n, level, source, per_group) for stores, level, source in parts)
            if to.scaled:
                out *= _numbers(_column(to.path, k, "factor"), np.float64)[:, None]
            return [out.tobytes()]

        level = parts[0][1]
        return Level(_put(self.each(make, "k int, x binary"), self.path()), 0, level.hi - level.lo)

    def inner(self, parts: list[tuple[Side, list[Level]]]) -> dict[int, np.ndarray]:
        """Per group the inner products of all columns, summed over its blocks and over the sides."""

        def make(k: int):
            grams = []
            for side, levels in parts:
                n = _size(side, k)
                if n:
                    x = np.hstack([_matrix(level, k, n) for level in levels])
                    grams.append(x.T @ x)
            return [np.sum(grams, axis=0).tobytes()] if grams else None

        out: dict[int, np.ndarray] = {}
        for r in self.each(make, "k int, m binary").collect():
            g = r.k // self.per_group
            m = np.frombuffer(r.m)
            out[g] = out.get(g, 0) + m
        return {g: m.reshape(int(round(len(m) ** 0.5)), -1) for g, m in out.items()}

    def combined(self, side: Side, levels: list[Level], mixes: dict[int, np.ndarray]) -> Level:
        shared, per_group = self.spark.sparkContext.broadcast(mixes), self.per_group

        def make(k: int):
            n = _size(side, k)
            if not n:
                return None
            x = np.hstack([_matrix(level, k, n) for level in levels])
            return [(x @ shared.value[k // per_group]).tobytes()]

        width = next(iter(mixes.values())).shape[1]
        return Level(_put(self.each(make, "k int, x binary"), self.path()), 0, width)

    def rows(self, side: Side, level: Level, kind: int) -> DataFrame:
        """``(g, kind, id, vec)``."""
        per_group = self.per_group

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for k in batch.column(0).to_pylist():
                    ids = _numbers(_column(side.path, k, "ids"), np.int64)
                    if not len(ids):
                        continue
                    x = np.ascontiguousarray(_matrix(level, k, len(ids)))
                    vec = pa.ListArray.from_arrays(pa.array(np.arange(len(ids) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))
                    same = [pa.array(np.full(len(ids), v, np.int32)) for v in (k // per_group, kind)]
                    yield pa.RecordBatch.from_arrays([*same, pa.array(ids), vec], names=["g", "kind", "id", "vec"])

        dealt = self.spark.range(0, self.count, 1, numPartitions=min(self.count, 4 * self.tasks))
        return dealt.mapInArrow(run, "g int, kind int, id long, vec array<double>")

    def drop(self, level: Level) -> None:
        drop_path(self.spark, level.path)


def block_embed(
    entries: DataFrame,
    rows: int,
    tasks: int,
    k: int,
    method: str,
    by: list[str],
    rounds: int,
    width: int,
    tol: float,
    shared: DataFrame | None = None,
    factors: tuple[DataFrame, DataFrame] | None = None,
    further: bool = False,
    symmetric: bool = False,
) -> DataFrame:
    """The iteration of ``spectral.subspace_embed`` on blocks, with the same arguments and results: ``(by.., node, vec)``."""
    from shoal.operators.spectral import DEPTH, orthonormal, ritz

    spark = entries.sparkSession
    entries = entries.dropna(subset=[*by, "src", "dst", "weight"])
    square = method == "evd" or symmetric
    end = "src" if square else "dst"
    # the groups: one row for each
    members = entries if factors is None else factors[1].dropna(subset=[*by, "node"])
    keys = [tuple(r[c] for c in by) for r in members.select(*by).distinct().collect()]
    node_kind = entries.schema["src" if method == "svd" else end].dataType
    if not keys:
        empty = entries.select(*by, F.col("src").alias("node"), F.array().cast("array<double>").alias("vec")).limit(0)
        return empty.select(*[c for c in by if c != "_g"], "node", "vec")
    most = max(r["count"] for r in entries.groupBy(*by).count().collect()) if rows else 1
    per_group = max(-(-tasks * most // max(rows, 1)), int(np.ceil((most / PAIR_ENTRIES) ** 0.5)), 1)
    if shared is not None:
        per_group = max(per_group, int(np.ceil((shared.count() / PAIR_ENTRIES) ** 0.5)))
    blocks = Blocks(spark, len(keys), per_group, tasks)
    fields = [StructField(c, entries.schema[c].dataType) for c in by]
    schema = StructType([*fields, StructField("g", IntegerType())])
    listed = spark.createDataFrame([(*key, g) for g, key in enumerate(keys)], schema)

    def numbered(df: DataFrame) -> DataFrame:
        return df.join(checked_broadcast(listed, len(keys)), by)

    def block(name: str) -> Column:
        return (F.col("g") * per_group + blocks.number(name)).cast("int")

    draws = [(F.xxhash64("id", F.lit(i)) / F.lit(2.0**63)) for i in range(width)]

    def side(names: DataFrame, first: bool) -> tuple[Side, dict[int, tuple[int, int]]]:
        path, sizes = _names(names.select(block("id").alias("k"), "id", "factor"), blocks.path(), blocks.count, draws if first else [])
        return Side(path, factors is not None), sizes

    try:
        one = F.lit(1.0).alias("factor")
        plain = lambda c: F.col(c).cast("long")
        own_row = plain("src.id") if shared is not None else plain("src")
        own = numbered(entries).select("g", own_row.alias("src"), plain("dst").alias("dst"), F.col("weight").cast("double").alias("weight"))
        if factors is None:
            column, sizes = side(own.select("g", F.col(end).alias("id")).distinct().withColumn("factor", one), True)
            row = column if square else side(own.select("g", F.col("src").alias("id")).distinct().withColumn("factor", one), False)[0]
        else:
            column, sizes = side(numbered(factors[1]).select("g", plain("node").alias("id"), "factor"), True)
            marked = numbered(factors[0])
            row = side(marked.where("node.kind = 1").select("g", plain("node.id").alias("id"), "factor"), False)[0]
            top, tops = side(marked.where("node.kind = 0").select("g", plain("node.id").alias("id"), "factor"), False)
            for found in (sizes, tops):
                if any(found.get(x) != found.get(x % per_group) for x in range(blocks.count)):
                    raise ValueError("shared entries need the same names in every group")
        lots = max(shuffle_tasks(rows, PAIR_ENTRIES), tasks)

        def store(df: DataFrame, to: str, source: str, to_side: Side, from_side: Side) -> Store:
            laid = df.select(block(to).alias("k"), block(source).alias("j"), F.col(to).alias("to"), F.col(source).alias("from"), "weight")
            return Store(_packed(laid, to_side, from_side, blocks.path(), lots))

        forward = [(row, [store(own, "src", "dst", row, column)])]
        back = [] if square else [[store(own, "dst", "src", column, row)]]
        if shared is not None:
            given = shared.dropna().select(F.lit(0).alias("g"), plain("src.id").alias("src"), plain("dst").alias("dst"), F.col("weight").cast("double").alias("weight"))
            forward.append((top, [store(given, "src", "dst", top, column)._replace(blocks=per_group)]))
            back.append([store(given, "dst", "src", column, top)._replace(blocks=per_group)])

        def image(level: Level) -> list[tuple[Side, Level]]:
            return [(to, blocks.product([(stores, level, column)], to)) for to, stores in forward]

        def operator(level: Level) -> Level:
            middle = image(level)
            if method == "evd":
                return middle[0][1]
            if square:
                out = blocks.product([(forward[0][1], middle[0][1], column)], column)
            else:
                out = blocks.product([(stores, level, side) for stores, (side, level) in zip(back, middle)], column)
            for _, used in middle:
                blocks.drop(used)
            return out

        levels = [Level(column.path, 0, width), operator(Level(column.path, 0, width))]
        last, basis = levels[1], None
        for _ in range(rounds):
            for _ in range(DEPTH - 1):
                last = operator(last)
                levels.append(last)
            steps = {g: ritz(gram, width, k) for g, gram in blocks.inner([(column, levels)]).items()}
            basis = blocks.combined(column, levels, {g: np.hstack([s.mix, s.ahead]) if further else s.mix for g, s in steps.items()})
            for level in levels:
                if level.path != column.path:
                    blocks.drop(level)
            if max(s.residual for s in steps.values()) <= tol:
                break
            levels, last = [basis], basis._replace(lo=width, hi=2 * width)
        else:
            raise RuntimeError(f"the embedding did not converge in {rounds} rounds")
        found = [(column, basis._replace(hi=k))]
        if method == "svd":
            # left vectors: the images of the right ones, of length 1 (zero where the value is)
            left = image(basis._replace(hi=width))
            mixes = {g: orthonormal(gram, k) for g, gram in blocks.inner([(to, [level]) for to, level in left]).items()}
            found = [(to, blocks.combined(to, [level], mixes)) for to, level in left]
        out = None
        for i, (to, level) in enumerate(found):
            part = blocks.rows(to, level, 1 - i)
            out = part if out is None else out.unionByName(part)
        name = F.struct("kind", "id") if shared is not None else F.col("id").cast(node_kind)
        out = out.join(checked_broadcast(listed, len(keys)), "g")
        return written(out.select(*[c for c in by if c != "_g"], name.alias("node"), "vec"), "embedding")
    finally:
        drop_path(spark, blocks.root)
