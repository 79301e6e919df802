"""Normalised matrices and spectral embeddings of edge tables.

Matrix entries are rows ``(src, dst, weight)``; ``by`` names columns that hold
several matrices in one table (one per partition).
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from shoal.functions import kernels
from shoal.functions.columns import euclidean, unit_vector
from shoal.operators.blocks import block_embed
from shoal.operators.split import in_degree, mean_degree, out_degree
from shoal.session import checked_broadcast, cut_lineage, discard, has_at_most, shuffle_tasks, written

# A matrix with at most this many entries is factored inside one task.
LOCAL_ENTRIES = 1_000_000
# A larger table is packed into blocks instead of being joined for each product.
BLOCK_ENTRIES = 1_000_000

# Blocks that span the space of a round of the distributed iteration.
DEPTH = 3
# Entries behind one task of a product: at most, and where there are fewer than one such share per core.
DEALT_ENTRIES, LEAST_ENTRIES = 24_000_000, 100_000
# Groups whose sums a task holds before it hands them on.
HELD_GROUPS = 2_000

# Factor of a row without any entry. It touches no entry, so it never shows in a result.
EMPTY_ROW_FACTOR = 10_000.0


def _scaled(edges: DataFrame, left: DataFrame, right: DataFrame, by: list[str]) -> DataFrame:
    """weight / sqrt(left[src] * right[dst])."""
    a = left.withColumnRenamed("node", "src").withColumnRenamed("scale", "_l")
    b = right.withColumnRenamed("node", "dst").withColumnRenamed("scale", "_r")
    value = F.col("weight") / F.sqrt(F.col("_l") * F.col("_r"))
    return edges.join(a, [*by, "src"]).join(b, [*by, "dst"]).select(*by, "src", "dst", value.alias("weight"))


def _degrees(edges: DataFrame, end: str, by: list[str], regularize: bool, rows: DataFrame | None) -> DataFrame:
    """``(by.., node, scale)`` with the mean degree added where asked.

    ``rows`` lists nodes that count in the mean though they may have no edge.
    """
    if not by and rows is None:
        degree = out_degree(edges) if end == "src" else in_degree(edges)
        if regularize:
            # one-row scalar subquery: no join, nothing collected
            return degree.select("node", (F.col("degree") + mean_degree(degree).scalar()).alias("scale"))
        return degree.select("node", F.col("degree").alias("scale"))
    degree = edges.groupBy(*by, F.col(end).alias("node")).agg(F.sum("weight").alias("scale"))
    if not regularize:
        return degree
    total = degree.agg(F.sum("scale")) if not by else degree.groupBy(*by).agg(F.sum("scale").alias("_t"))
    count = (degree if rows is None else rows)
    if not by:
        n = count.agg(F.count("*"))
        return degree.select("node", (F.col("scale") + total.scalar() / n.scalar()).alias("scale"))
    n = count.groupBy(*by).agg(F.count("*").alias("_n"))
    mean = total.join(n, by).select(*by, (F.col("_t") / F.col("_n")).alias("_mean"))
    return degree.join(mean, by).select(*by, "node", (F.col("scale") + F.col("_mean")).alias("scale"))


def laplacian_sym(edges: DataFrame, regularize: bool = False, by: list[str] | None = None) -> DataFrame:
    """``w_ij / sqrt(d_i d_j)`` of a square symmetric edge table; ``d + mean(d)`` if regularised.

    Nodes are those of the table: with a self-weight every node has a row.
    """
    by = by or []
    scale = _degrees(edges, "src", by, regularize, None)
    return _scaled(edges, scale, scale, by)


def laplacian_bip(
    edges: DataFrame,
    regularize: bool = False,
    by: list[str] | None = None,
    rows: DataFrame | None = None,
    columns: DataFrame | None = None,
) -> DataFrame:
    """``w_ij / sqrt(out_i in_j)`` of a rectangular table.

    ``rows`` / ``columns`` (``by.., node``) name all rows and columns, so that
    those without an entry count in the regularising means.
    """
    by = by or []
    left = _degrees(edges, "src", by, regularize, rows)
    right = _degrees(edges, "dst", by, regularize, columns)
    return _scaled(edges, left, right, by)


def row_factors(edges: DataFrame, rows: DataFrame) -> DataFrame:
    """``1 / sqrt(out_i)`` of every row, the fixed factor where a row has no entry."""
    degree = out_degree(edges)
    return rows.select("node").join(degree, "node", "left").select(
        "node",
        F.when(F.coalesce("degree", F.lit(0.0)) == 0, F.lit(EMPTY_ROW_FACTOR))
        .otherwise(1 / F.sqrt("degree"))
        .alias("factor"),
    )


def stack_pilot_worker(pilot_edges: DataFrame, worker_edges: DataFrame, partitions: DataFrame) -> DataFrame:
    """Pilot rows on top of the worker rows of every partition, same columns.

    ``partitions`` has one row per partition; the copies come from exploding the
    list of partition ids, so no join is involved.
    """
    ids = partitions.select("partition_id").distinct().agg(F.collect_set("partition_id").alias("ids"))
    copies = pilot_edges.select(F.explode(ids.scalar()).alias("partition_id"), "src", "dst", "weight")
    return copies.unionByName(worker_edges.select("partition_id", "src", "dst", "weight"))


def row_normalize(df: DataFrame, col: str = "vec") -> DataFrame:
    """Divide each row by its L2 norm, zero rows untouched."""
    return df.withColumn(col, unit_vector(col))


def centre_distances(rows: DataFrame, centres: DataFrame) -> DataFrame:
    """Euclidean distance of every row to every centre, long form.

    ``rows`` is ``(node, vec)``. The K centres ``(cluster, centre)`` reach the
    rows as one array value, so each row is read once and nothing is shuffled.
    """
    packed = centres.agg(F.array_sort(F.collect_list(F.struct("cluster", "centre"))).alias("c")).scalar()
    return rows.withColumn("_c", F.explode(packed)).select(
        *[c for c in rows.columns if c != "vec"],
        F.col("_c.cluster").alias("cluster"),
        euclidean("vec", "_c.centre").alias("distance"),
    )


# ---------------------------------------------------------------- embeddings


def spectral_embed(
    entries: DataFrame,
    k: int,
    method: str = "svd",
    by: list[str] | None = None,
    normalize: bool = False,
    local_entries: int = LOCAL_ENTRIES,
    size: int | None = None,
    clique: DataFrame | None = None,
    **iteration,
) -> DataFrame:
    """``(by.., node, vec)``: first k left singular vectors, or eigenvectors by signed value.

    A table of at most ``local_entries`` entries (``size`` if the caller knows
    their number, else they are counted) is factored in one task. Above
    that the work is a subspace iteration of joins and sums on the edge table.
    Rows without entries are not in the result; their vector is zero.
    ``clique`` is ``(node, weight)`` for a symmetric matrix that has the further
    rank-one part ``weight_i * weight_j``.
    """
    if method not in ("svd", "evd"):
        raise ValueError(f"method must be 'svd' or 'evd', got {method!r}")
    small = not by and (has_at_most(entries, local_entries) if size is None else size <= local_entries)
    if small:
        out = _embed_local(entries, k, method, clique)
    else:
        out = subspace_embed(entries, k, method, by, clique=clique, **iteration)
    return row_normalize(out) if normalize else out


def _embed_local(entries: DataFrame, k: int, method: str, clique: DataFrame | None) -> DataFrame:
    table = entries.select("src", "dst", "weight")
    if clique is not None:
        # a clique member is marked by a null column; its weight is the factor
        table = table.unionByName(
            clique.select(F.col("node").alias("src"), F.lit(None).cast("long").alias("dst"), "weight")
        )

    def factor(pdf: pd.DataFrame) -> pd.DataFrame:
        member = pdf["dst"].isna().to_numpy()
        src = pdf["src"].to_numpy()
        dst = pdf["dst"].to_numpy()[~member].astype("int64")
        val = pdf["weight"].to_numpy()
        square = method == "evd" or member.any()
        names = np.unique(np.concatenate([src, dst])) if square else np.unique(src)
        cols = names if square else np.unique(dst)
        r, c = np.searchsorted(names, src[~member]), np.searchsorted(cols, dst)
        extra = np.zeros(len(names))
        extra[np.searchsorted(names, src[member])] = val[member]
        if member.any():
            m = kernels.Sparse(r, c, val[~member], (len(names), len(names)))

            def once(x):
                return m.times(x) + extra[:, None] * (extra @ x)

            if method == "evd":
                _, vec = kernels.top_eigenvectors(once, len(names), k)
            else:
                _, vec = kernels.top_eigenvectors(lambda x: once(once(x)), len(names), k)
        elif method == "evd":
            vec, _ = kernels.top_algebraic(r, c, val, len(names), k)
        else:
            vec, _ = kernels.left_singular(r, c, val, (len(names), len(cols)), k)
        return pd.DataFrame({"node": names, "vec": list(vec)})

    # one group by intent: the caller has checked that it holds few entries
    return table.withColumn("_all", F.lit(0)).groupBy("_all").applyInPandas(factor, "node long, vec array<double>")


def subspace_embed(
    entries: DataFrame,
    k: int,
    method: str = "svd",
    by: list[str] | None = None,
    rounds: int = 100,
    oversample: int = 6,
    tol: float = kernels.TOLERANCE,
    clique: DataFrame | None = None,
    shared: DataFrame | None = None,
    factors: tuple[DataFrame, DataFrame] | None = None,
    further: bool = False,
    symmetric: bool = False,
) -> DataFrame:
    """Embedding by restarted block Krylov iteration with joins and sums; any size, any group skew.

    The operator is A itself ('evd') or A'A ('svd'). A round spans the space of a block of ``k + oversample``
    orthonormal vectors X and its next ``DEPTH - 1`` images, takes from it the vectors of the largest (signed) values and goes on with
    those; their first image is known by then, so a round costs ``DEPTH - 1`` products. With ``further`` the part of the new vectors that came from
    outside X, and its image, stay in the space of the next round: they cost no product, and the restart forgets less. The space holds both ends of the
    spectrum, so large negative values neither hide the wanted ones nor have to be damped. It ends when the residuals
    of all k vectors are at most ``tol`` of the largest value, and raises if they stay larger.

    ``shared`` are entries ``(src, dst, weight)`` that every group has besides its own; they are kept once, and only the vectors
    are a row per group. ``factors`` are tables ``(by.., node, factor)`` that scale the rows and the columns of each
    group's matrix and name its columns; where they are given, entries are unscaled ('svd' only). ``symmetric`` says that
    'svd' has a symmetric matrix, whose entries are then packed once.

    More than ``BLOCK_ENTRIES`` entries are packed and multiplied by blocks (``blocks.block_embed``), which takes the same steps without a shuffle.

    Vectors are columns of a ``(by.., node, ..)`` table; edges and vectors never pass through the driver. It sees one
    matrix of inner products (``(DEPTH + 3) * width`` columns) per group and round.
    """
    by = by or ["_g"]
    if by == ["_g"]:
        entries = entries.withColumn("_g", F.lit(0))
    if clique is not None and by != ["_g"]:
        raise ValueError("a clique part is supported for a single matrix")
    if (shared is None) != (factors is None) or (shared is not None and method != "svd"):
        raise ValueError("shared entries need factors, and 'svd'")
    width = k + oversample
    q = [f"q{i}" for i in range(width)]
    table = entries.select(*by, "src", "dst", "weight").persist()
    # entries are dealt once for each end that a product joins by, and stay there; only vectors and sums move
    rows = table.count()
    cores = entries.sparkSession.sparkContext.defaultParallelism
    tasks = max(shuffle_tasks(rows, DEALT_ENTRIES), min(shuffle_tasks(rows, LEAST_ENTRIES), cores))
    ids = {table.schema["src"].dataType.simpleString().removesuffix(">").split(":")[-1], table.schema["dst"].dataType.simpleString()}
    if clique is None and rows > BLOCK_ENTRIES and ids <= {"int", "bigint"}:
        out = block_embed(table, rows, tasks, k, method, by, rounds, width, tol, shared, factors, further, symmetric)
        table.unpersist()
        return out
    dealt = {
        end: table.repartition(tasks, *by, end).sortWithinPartitions(*by, end).persist()
        for end in (("dst",) if method == "evd" else ("dst", "src"))
    }
    for copy in dealt.values():
        copy.count()
    table.unpersist()
    extra = None if clique is None else clique.select(F.lit(0).alias("_g"), "node", F.col("weight").alias("_s"))

    def scaled(vectors: DataFrame, end: str) -> DataFrame:
        joined = vectors.join(factors[end == "dst"], [*by, "node"])
        return joined.select(*by, "node", *[(F.col(c) * F.col("factor")).alias(c) for c in q])

    def product(vectors: DataFrame, end: str, to: str) -> DataFrame:
        """Sum of weight * vector over the other end of every entry."""
        if extra is not None:
            vectors = cut_lineage(vectors)  # read twice below
        bound = block_rows * width if end == "dst" else None
        if shared is not None:
            vectors = scaled(vectors, end)
        renamed = vectors.withColumnRenamed("node", end)
        side = checked_broadcast(renamed, bound)
        if side is renamed:  # not broadcast: the vectors go to the entries
            side = side.repartition(tasks, *by, end)
        terms = dealt[end].join(side, [*by, end])
        if shared is not None:
            terms = terms.unionByName(shared.join(side, end).select(*terms.columns))
        out = terms.groupBy(*by, F.col(to).alias("node")).agg(*[F.sum(F.col("weight") * F.col(c)).alias(c) for c in q])
        if shared is not None:
            return scaled(out, to)
        if extra is None:
            return out
        total = vectors.join(extra, [*by, "node"]).agg(F.struct(*[F.sum(F.col("_s") * F.col(c)).alias(c) for c in q]))
        both = out.join(extra, [*by, "node"], "full_outer").withColumn("_t", total.scalar())
        return both.select(
            *by,
            "node",
            *[
                (F.coalesce(c, F.lit(0.0)) + F.coalesce("_s", F.lit(0.0)) * F.coalesce(f"_t.{c}", F.lit(0.0))).alias(c)
                for c in q
            ],
        )

    def operator(vectors: DataFrame) -> DataFrame:
        if method == "evd":
            return product(vectors, "dst", "src")
        return product(product(vectors, "dst", "src"), "src", "dst")

    end = "dst" if method == "svd" else "src"
    names = dealt["dst"].select(*by, F.col(end).alias("node")) if factors is None else factors[1].select(*by, "node")
    if extra is not None:
        names = names.unionByName(extra.select(*by, "node"))
    draw = [(F.xxhash64("node", F.lit(i)) / F.lit(2.0**63)).alias(c) for i, c in enumerate(q)]
    block = cut_lineage(names.distinct().select(*by, "node", *draw))
    block_rows = block.count()
    if not block_rows:
        return block.select(*[c for c in by if c != "_g"], "node", F.array().cast("array<double>").alias("vec"))
    basis = gathered([block, cut_lineage(operator(block))], q, by)
    for _ in range(rounds):
        levels = [basis]
        last = basis.select(*by, "node", *[F.col("vec")[width + i].alias(c) for i, c in enumerate(q)])
        for _ in range(DEPTH - 1):
            last = cut_lineage(operator(last))
            levels.append(last)
        space = written(gathered(levels, q, by), "space")
        # one small matrix per group
        steps = {key: ritz(gram, width, k) for key, gram in inner_products(space, by).items()}
        basis = cut_lineage(combined(space, {key: np.hstack([s.mix, s.ahead]) if further else s.mix for key, s in steps.items()}, by))
        discard(space)
        if max(s.residual for s in steps.values()) <= tol:
            break
    else:
        raise RuntimeError(f"the embedding did not converge in {rounds} rounds")
    top = F.slice("vec", 1, k)
    if method == "svd":
        # left vectors: the images of the right ones, of length 1 (zero where the value is)
        block = basis.select(*by, "node", *[F.col("vec")[i].alias(c) for i, c in enumerate(q)])
        left = cut_lineage(gathered([product(block, "dst", "src")], q, by))
        mixes = {key: orthonormal(gram, k) for key, gram in inner_products(left, by).items()}
        basis = combined(left, mixes, by)
    for copy in dealt.values():
        copy.unpersist()
    return basis.select(*[c for c in by if c != "_g"], "node", top.alias("vec"))


def gathered(levels: list[DataFrame], q: list[str], by: list[str]) -> DataFrame:
    """``(by.., node, vec)``: the vectors of all levels of a node in one array; a first ``vec`` is kept as it is."""
    out, parts = None, []
    for i, level in enumerate(levels):
        if "vec" in level.columns:
            parts.append(F.col("vec"))
        else:
            level = level.select(*by, "node", F.array(*q).alias(f"_v{i}"))
            parts.append(F.col(f"_v{i}"))
        out = level if out is None else out.join(level, [*by, "node"])
    return out.select(*by, "node", F.concat(*parts).alias("vec"))


def _rows_by_group(batch: pa.RecordBatch, by: list[str]) -> Iterator[tuple[tuple, np.ndarray, np.ndarray]]:
    """The group, the row numbers and the vectors of each group in a batch."""
    if not batch.num_rows:
        return
    vec = batch.column("vec")
    flat = vec.flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
    keys = list(zip(*(batch.column(c).to_pylist() for c in by)))
    number = {key: i for i, key in enumerate(dict.fromkeys(keys))}
    own = np.fromiter((number[key] for key in keys), np.int64, len(keys))
    order = np.argsort(own, kind="stable")
    cuts = np.searchsorted(own[order], np.arange(len(number) + 1))
    for key, i in number.items():
        rows = order[cuts[i] : cuts[i + 1]]
        yield key, rows, flat[rows]


def inner_products(vectors: DataFrame, by: list[str]) -> dict[tuple, np.ndarray]:
    """Per group the matrix of inner products of the columns of ``vec``: partial sums in the tasks, one sum per group."""
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in vectors.select(*by).schema)
    kinds = [to_arrow_type(vectors.schema[c].dataType) for c in by]

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple, np.ndarray] = {}

        def rows() -> pa.RecordBatch:
            arrays = [pa.array([key[i] for key in sums], kind) for i, kind in enumerate(kinds)]
            return pa.RecordBatch.from_arrays([*arrays, pa.array([m.ravel() for m in sums.values()], pa.list_(pa.float64()))], names=[*by, "m"])

        for batch in batches:
            for key, _, x in _rows_by_group(batch, by):
                sums[key] = sums.get(key, 0) + x.T @ x
            if len(sums) > HELD_GROUPS:
                yield rows()
                sums.clear()
        if sums:
            yield rows()

    def total(group: pa.Table) -> pa.Table:
        m = np.sum([np.array(x) for x in group.column("m").to_pylist()], axis=0)
        return pa.Table.from_arrays([*(group.column(c).slice(0, 1) for c in by), pa.array([m], pa.list_(pa.float64()))], names=[*by, "m"])

    schema = f"{fields}, m array<double>"
    out = vectors.mapInArrow(partial, schema).groupBy(*by).applyInArrow(total, schema)
    side = lambda m: int(round(len(m) ** 0.5))
    return {tuple(r[c] for c in by): np.array(r["m"]).reshape(side(r["m"]), -1) for r in out.toLocalIterator()}


class RitzStep(NamedTuple):
    mix: np.ndarray  # new vectors and their first images, as combinations of all columns
    residual: float
    ahead: np.ndarray  # the part of the new vectors from outside X, and its image


def ritz(gram: np.ndarray, width: int, k: int) -> RitzStep:
    """The ``width`` largest Ritz values of the space of X, OX, .. from the inner products of X, OX, .., O^DEPTH X.

    Of ``DEPTH + 3`` blocks the third and fourth are further vectors P and their images OP, after X and OX.
    """
    blocks = np.arange(gram.shape[0]).reshape(-1, width)
    powers = [0, 1, *range(len(blocks) - DEPTH + 1, len(blocks))]
    further = [2] if len(blocks) > DEPTH + 1 else []
    own = blocks[[*powers[:-1], *further]].ravel()
    images = blocks[[*powers[1:], *(i + 1 for i in further)]].ravel()
    inner, cross_inner, image_inner = (gram[np.ix_(a, b)] for a, b in ((own, own), (own, images), (images, images)))
    scale = 1 / np.sqrt(np.maximum(np.diag(inner), 1e-300))
    scale[np.diag(inner) <= 0] = 0
    lam, vec = np.linalg.eigh(inner * np.outer(scale, scale))
    alive = lam > 1e-13 * max(lam[-1], 1e-300)
    white = scale[:, None] * vec[:, alive] / np.sqrt(lam[alive])
    image = white.T @ cross_inner @ white
    theta, turn = np.linalg.eigh((image + image.T) / 2)
    order = np.argsort(-theta)[:width]
    theta, c = theta[order], white @ turn[:, order]
    top = max(np.abs(theta).max(initial=0.0), 1e-300)
    squares = np.einsum("ij,ik,kj->j", c, image_inner, c)
    cross = np.einsum("ij,ik,kj->j", c, cross_inner, c)
    lengths = np.einsum("ij,ik,kj->j", c, inner, c)
    left = (squares - 2 * theta * cross + theta**2 * lengths)[:k]
    outside = c.copy()
    outside[:width] = 0
    mix, ahead = (np.zeros((len(gram), 2 * width)) for _ in range(2))
    for out, part in ((mix, c), (ahead, outside)):
        out[own, : c.shape[1]] = part
        out[images, width : width + c.shape[1]] = part
    return RitzStep(mix, float(np.sqrt(np.maximum(left, 0)).max(initial=0.0) / top), ahead)


def orthonormal(gram: np.ndarray, k: int) -> np.ndarray:
    """Mix to ``k`` orthonormal vectors, longest first; zero where the columns have no more."""
    lam, vec = np.linalg.eigh(gram)
    lam, vec = lam[::-1][:k], vec[:, ::-1][:, :k]
    keep = lam > 1e-15 * max(lam[0], 1e-300)
    return vec * np.where(keep, 1 / np.sqrt(np.where(keep, lam, 1.0)), 0.0)


def combined(vectors: DataFrame, mixes: dict[tuple, np.ndarray], by: list[str]) -> DataFrame:
    """``vec`` times the small matrix of its group; at most the groups' matrices are broadcast."""
    shared = vectors.sparkSession.sparkContext.broadcast(mixes)

    def mix(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, rows, x in _rows_by_group(batch, by):
                y = x @ shared.value[key]
                kept = batch.take(pa.array(rows))
                starts = pa.array(np.arange(len(rows) + 1, dtype=np.int32) * y.shape[1])
                out = pa.ListArray.from_arrays(starts, pa.array(y.ravel()))
                yield pa.RecordBatch.from_arrays([*(kept.column(c) for c in [*by, "node"]), out], names=[*by, "node", "vec"])

    return vectors.select(*by, "node", "vec").mapInArrow(mix, vectors.select(*by, "node", "vec").schema)
