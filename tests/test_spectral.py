import numpy as np
import pytest
from conftest import rows_of
from pyspark.sql import functions as F

from shoal.functions import kernels
from shoal.operators import graph, spectral

EDGE = "src long, dst long, weight double"


def planted(n=50, k=3, seed=3, p=0.8, q=0.05):
    rng = np.random.default_rng(seed)
    block = np.arange(n) % k
    prob = np.where(block[:, None] == block[None], p, q)
    upper = np.triu(rng.random((n, n)) < prob, 1)
    return (upper | upper.T).astype(float) + 10 * np.eye(n)


def table(frame, a, names=None):
    r, c = np.nonzero(a)
    names = np.arange(a.shape[0]) * 3 + 5 if names is None else names
    return frame([(int(names[i]), int(names[j]), float(a[i, j])) for i, j in zip(r, c)], EDGE), names


def matrix(df, names, width=3):
    found = {r.node: r.vec for r in df.collect()}
    return np.array([found[int(n)] for n in names])[:, :width]


def same_space(a, b, tol=1e-6):
    return np.linalg.svd(np.linalg.qr(a)[0].T @ np.linalg.qr(b)[0])[1].min() > 1 - tol


def normalised(a, extra=0.0):
    d = a.sum(1)
    d = d + extra * d.mean()
    return a / np.sqrt(np.outer(d, d))


@pytest.mark.parametrize("regularize", [False, True])
def test_laplacian_sym(frame, regularize):
    a = planted()
    edges, names = table(frame, a)
    lap = normalised(a, float(regularize))
    at = {int(n): i for i, n in enumerate(names)}
    for r in spectral.laplacian_sym(edges, regularize).collect():
        assert r.weight == pytest.approx(lap[at[r.src], at[r.dst]])


def test_laplacian_bip_with_empty_row(frame):
    a = np.array([[1.0, 2.0], [0.0, 0.0], [3.0, 0.0]])
    edges, names = table(frame, a, np.array([0, 1, 2]))
    rows, cols = frame([(0,), (1,), (2,)], "node long"), frame([(0,), (1,)], "node long")
    out, into = a.sum(1), a.sum(0)
    got = {(r.src, r.dst): r.weight for r in spectral.laplacian_bip(edges, True, rows=rows, columns=cols).collect()}
    want = a / np.sqrt(np.outer(out + out.mean(), into + into.mean()))
    assert got == {(0, 0): pytest.approx(want[0, 0]), (0, 1): pytest.approx(want[0, 1]), (2, 0): pytest.approx(want[2, 0])}
    factors = {r.node: r.factor for r in spectral.row_factors(edges, rows).collect()}
    assert factors[1] == 10000.0 and factors[0] == pytest.approx(3**-0.5)


def test_grouped_laplacian_equals_single(frame):
    a = planted(20)
    edges, _ = table(frame, a)
    both = edges.withColumn("partition_id", F.lit(1)).unionByName(edges.withColumn("partition_id", F.lit(2)))
    rows = edges.select(F.explode(F.array(F.lit(1), F.lit(2))).alias("partition_id"), F.col("src").alias("node")).distinct()
    one = {(s, d): w for s, d, w in rows_of(spectral.laplacian_bip(edges, True))}
    for r in spectral.laplacian_bip(both, True, ["partition_id"], rows, rows).collect():
        assert r.weight == pytest.approx(one[r.src, r.dst])


@pytest.mark.parametrize("limit", [10**6, 0])
@pytest.mark.parametrize("method", ["svd", "evd"])
def test_embedding_matches_dense(frame, method, limit):
    lap = normalised(planted(), 1.0)
    edges, names = table(frame, lap)
    got = matrix(spectral.spectral_embed(edges, 3, method, local_entries=limit), names)
    if method == "svd":
        want = np.linalg.svd(lap)[0][:, :3]
    else:
        lam, vec = np.linalg.eigh(lap)
        want = vec[:, np.argsort(-lam)[:3]]
    assert np.allclose(got.T @ got, np.eye(3), atol=1e-5)
    assert np.allclose(np.abs((got * want).sum(0)), 1, atol=1e-5)


def test_rectangular_embedding_both_routes(frame):
    rng = np.random.default_rng(0)
    a = (rng.random((40, 12)) < 0.3) * rng.random((40, 12)) + 0.2 * np.outer(np.arange(40) % 2, np.arange(12) % 2)
    edges, names = table(frame, a, np.arange(40))
    want = np.linalg.svd(a)[0][:, :2]
    for limit in (10**6, 0):
        found = {r.node: r.vec for r in spectral.spectral_embed(edges, 2, local_entries=limit).collect()}
        got = np.array([found.get(i, [0.0, 0.0]) for i in range(40)])
        assert np.allclose(np.abs((got * want).sum(0)), 1, atol=1e-5)


def test_two_matrices_at_once(frame):
    one, two = normalised(planted(seed=1)), normalised(planted(seed=2))
    e1, names = table(frame, one)
    e2, _ = table(frame, two)
    both = e1.withColumn("partition_id", F.lit(1)).unionByName(e2.withColumn("partition_id", F.lit(2)))
    out = spectral.spectral_embed(both, 3, by=["partition_id"]).persist()
    for i, lap in ((1, one), (2, two)):
        got = matrix(out.where(F.col("partition_id") == i), names)
        assert same_space(got, np.linalg.svd(lap)[0][:, :3], 1e-3)


@pytest.mark.parametrize("limit", [10**6, 0])
def test_clique_part(frame, limit):
    lap = normalised(planted(30))
    s = np.where(np.arange(30) % 4 == 0, 0.3, 0.0)
    edges, names = table(frame, lap)
    clique = frame([(int(n), float(w)) for n, w in zip(names, s) if w], "node long, weight double")
    want = np.linalg.svd(lap + np.outer(s, s))[0][:, :3]
    got = matrix(spectral.spectral_embed(edges, 3, clique=clique, local_entries=limit), names)
    assert same_space(got, want, 1e-3)


def test_unit_rows_and_bad_method(frame):
    df = frame([(1, [3.0, 4.0]), (2, [0.0, 0.0])], "node long, vec array<double>")
    assert rows_of(spectral.row_normalize(df)) == [(1, [0.6, 0.8]), (2, [0.0, 0.0])]
    with pytest.raises(ValueError, match="method"):
        spectral.spectral_embed(df, 1, method="qr")


def test_krylov_kernel_on_a_large_side():
    a = planted(1500, p=0.1, q=0.01)
    lap = normalised(a, 1.0)
    r, c = np.nonzero(lap)
    u, sigma = kernels.left_singular(r, c, lap[r, c], lap.shape, 3)
    lam, vec = np.linalg.eigh(lap)
    order = np.argsort(-np.abs(lam))[:3]
    assert np.allclose(sigma, np.abs(lam[order]), atol=1e-6)
    assert same_space(u, vec[:, order])
    v, top = kernels.top_algebraic(r, c, lap[r, c], 1500, 3)
    assert np.allclose(top, np.sort(lam)[::-1][:3], atol=1e-5) and same_space(v, vec[:, np.argsort(-lam)[:3]], 1e-4)


def hub_graph(n=240, hubs=1):
    """Three blocks, and nodes that are linked to all others."""
    rng = np.random.default_rng(1)
    block = np.arange(n) % 3
    upper = np.triu(rng.random((n, n)) < np.where(block[:, None] == block[None], 0.2, 0.01), 1)
    a = (upper | upper.T).astype(float)
    a[:hubs] = a[:, :hubs] = 1.0
    a[np.arange(hubs), np.arange(hubs)] = 0.0
    return a


@pytest.mark.parametrize("hubs", [1, 2])
@pytest.mark.parametrize("method", ["svd", "evd"])
@pytest.mark.parametrize("limit", [10**7, 0])
def test_hub_graphs_have_one_answer_on_both_routes(frame, hubs, method, limit):
    a = hub_graph(hubs=hubs)
    edges, names = table(frame, a)
    true = np.linalg.eigh(a)[1][:, ::-1] if method == "evd" else np.linalg.svd(a)[0]
    got = matrix(spectral.spectral_embed(edges, 3, method=method, local_entries=limit), names)
    assert np.linalg.svd(np.linalg.qr(got)[0].T @ true[:, :3])[1].min() > 0.999


def edge_frame(frame, pairs):
    rows = [(i, j, w) for i, j, w in pairs] + [(j, i, w) for i, j, w in pairs]
    return frame(rows, "src long, dst long, weight double")


def test_values_of_both_signs_do_not_hide_the_largest(frame):
    """Disjoint weighted edges: every value comes with its negative."""
    edges = edge_frame(frame, [(2 * i, 2 * i + 1, 1.0 + i) for i in range(12)])
    got = {r.node: r.vec for r in spectral.spectral_embed(edges, 3, "evd", local_entries=0).collect()}
    for c, pair in enumerate((11, 10, 9)):
        v = np.array([got[n][c] for n in range(24)])
        assert abs(v[2 * pair]) == pytest.approx(0.5**0.5) and v[2 * pair] == pytest.approx(v[2 * pair + 1])
        assert np.abs(np.delete(v, [2 * pair, 2 * pair + 1])).max() < 1e-5


@pytest.mark.parametrize("method", ["svd", "evd"])
def test_bipartite_graph_with_close_values(frame, method):
    rng = np.random.default_rng(3)
    n = 120
    a = np.zeros((n, n))
    half = (rng.random((60, 60)) < 0.15) * (0.5 + rng.random((60, 60)))
    for b in range(3):
        part = slice(20 * b, 20 * b + 20)
        half[part, part] += 0.8
    a[:60, 60:], a[60:, :60] = half, half.T
    i, j = np.nonzero(a)
    edges = frame([(int(x), int(y), float(w)) for x, y, w in zip(i, j, a[i, j])], "src long, dst long, weight double")
    lam, vec = np.linalg.eigh(a)
    want = vec[:, ::-1][:, :3] if method == "evd" else vec[:, np.argsort(-np.abs(lam))[:4]]
    got = {r.node: r.vec for r in spectral.spectral_embed(edges, want.shape[1], method, local_entries=0).collect()}
    got = np.array([got[x] for x in range(n)])
    assert np.linalg.svd(got.T @ want)[1].min() > 0.999999
    assert np.allclose(got.T @ got, np.eye(want.shape[1]), atol=1e-8)


def test_ritz_step_keeps_and_images_the_best():
    rng = np.random.default_rng(1)
    a = planted(60)
    blocks = [np.linalg.qr(rng.standard_normal((60, 7)))[0]]
    for _ in range(spectral.DEPTH):
        blocks.append(a @ blocks[-1])
    s = np.hstack(blocks)
    step = spectral.ritz(s.T @ s, 7, 3)
    new = s @ step.mix
    assert np.allclose(new[:, :7].T @ new[:, :7], np.eye(7), atol=1e-6)
    assert np.allclose(a @ new[:, :7], new[:, 7:], atol=1e-5)
    value = np.einsum("ij,ij->j", new[:, :7], new[:, 7:])
    left = np.linalg.norm(new[:, 7:] - new[:, :7] * value, axis=0)[:3].max()
    assert step.residual == pytest.approx(left / np.abs(value).max(), rel=1e-3)


def test_further_vectors_shorten_the_iteration_where_values_lie_close():
    """Sixteen blocks with leading values 0.4 % apart: a restart that keeps X alone takes three times as many rounds."""
    rng = np.random.default_rng(5)
    a, size, width = np.zeros((192, 192)), 12, 9
    for b in range(16):
        part = slice(size * b, size * (b + 1))
        upper = np.triu(rng.random((size, size)) < 0.5, 1)
        own = (upper | upper.T) + np.eye(size)
        a[part, part] = own * (1 - 0.004 * b) / np.linalg.eigvalsh(own)[-1]

    def rounds(further):
        x = np.random.default_rng(1).uniform(-1, 1, (192, width))
        basis = np.hstack([x, a @ x])
        for i in range(100):
            levels = [basis, basis[:, width : 2 * width]]
            for _ in range(spectral.DEPTH - 1):
                levels.append(a @ levels[-1])
            space = np.hstack([basis, *levels[2:]])
            step = spectral.ritz(space.T @ space, width, 3)
            basis = space @ (np.hstack([step.mix, step.ahead]) if further else step.mix)
            if step.residual <= kernels.TOLERANCE:
                break
        x, image = basis[:, :3], basis[:, width : width + 3]
        assert np.allclose(a @ x, image, atol=1e-6)
        assert np.einsum("ij,ij->j", x, image) == pytest.approx([1, 0.996, 0.992], abs=1e-9)
        return i + 1

    assert rounds(True) < 25 < 40 < rounds(False)


def test_the_estimated_size_does_not_grow_with_the_rounds(frame, monkeypatch):
    """A round of joins on checkpoints multiplies the estimate by itself: the driver held its digits."""
    cut, digits = spectral.cut_lineage, []

    def measured(df):
        digits.append(len(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())))
        return cut(df)

    monkeypatch.setattr(spectral, "cut_lineage", measured)
    a = normalised(planted(60, seed=4, p=0.4, q=0.2))
    edges, _ = table(frame, a)
    with pytest.raises(RuntimeError, match="did not converge in 4 rounds"):
        spectral.subspace_embed(edges, 2, oversample=0, rounds=4, tol=0.0)
    assert len(digits) > 8 and max(digits) < 100


def test_unconverged_iteration_raises(frame):
    edges, _ = table(frame, hub_graph())
    with pytest.raises(RuntimeError):
        spectral.subspace_embed(edges, 3, "svd", rounds=1, tol=1e-9)
    with pytest.raises(RuntimeError):
        kernels.top_eigenvectors(lambda x: np.diag(np.arange(2000.0)) @ x, 2000, 3, depth=2, restarts=1)


@pytest.mark.parametrize("method", ["svd", "evd"])
def test_entries_are_dealt_once_and_stay(frame, monkeypatch, method):
    """Above every product that joins by sorting, the kept entries have no exchange of their own."""
    monkeypatch.setattr(spectral, "LEAST_ENTRIES", 20, raising=False)
    monkeypatch.setattr(spectral, "checked_broadcast", lambda df, bound=None: df)
    monkeypatch.setattr(spectral, "cut_lineage", lambda df, real=spectral.cut_lineage: plans.append(df._jdf.queryExecution().executedPlan().toString()) or real(df))
    plans = []
    edges, a = table(frame, hub_graph())
    spark = edges.sparkSession
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = spectral.subspace_embed(edges, 2, method).collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert len(out) == len(a)
    moved, joined = 0, 0
    for plan in (p for p in plans if "Join" in p):
        lines, inside = plan.splitlines(), None
        depth = lambda line: len(line) - len(line.lstrip(" :+-*"))
        for i, line in enumerate(lines):
            if inside is not None and depth(line) > inside:
                continue  # the plan that made the kept entries
            inside = depth(line) if "InMemoryRelation" in line else None
            if "InMemoryTableScan" in line and "weight" in line:
                joined += 1
                above = next(x for x in reversed(lines[:i]) if not any(word in x for word in ("Filter", "Project", "Sort [")))
                moved += "Exchange" in above
    assert joined and not moved


def test_product_holds_one_column_of_entries_at_a_time(monkeypatch):
    import tracemalloc

    rng = np.random.default_rng(2)
    rows, cols, vals = rng.integers(0, 50, 100_000), rng.integers(0, 40, 100_000), rng.random(100_000)
    x = rng.normal(size=(40, 16))
    dense = np.zeros((50, 40))
    np.add.at(dense, (rows, cols), vals)
    entries = kernels.Sparse(rows, cols, vals, (50, 40))
    tracemalloc.start()
    got = entries.times(x)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert np.allclose(got, dense @ x) and peak < 100_000 * 8 * 8
    monkeypatch.setattr(kernels, "CHUNK", 777)  # rows that are cut by a chunk
    assert np.allclose(entries.times(x), dense @ x)
    assert np.allclose(entries.t_times(got), dense.T @ (dense @ x))


def test_values_close_to_the_last_wanted_one_do_not_stop_the_local_iteration():
    # 4,000 values beside each other: too many columns to be factored whole
    values = np.r_[1.0, np.linspace(0.9, 0.0, 3_999)]
    found, vectors = kernels.top_eigenvectors(lambda x: values[:, None] * x, len(values), 3)
    assert np.allclose(found, values[:3], atol=1e-9)
    assert np.linalg.norm(values[:, None] * vectors - vectors * found, axis=0).max() <= kernels.TOLERANCE
    assert np.allclose(vectors.T @ vectors, np.eye(3), atol=1e-9)
    assert np.allclose(np.abs(vectors[:3]), np.eye(3), atol=1e-2)


@pytest.fixture
def in_blocks(monkeypatch):
    """Every table of the joins route goes by blocks, of several nodes each."""
    monkeypatch.setattr(spectral, "BLOCK_ENTRIES", 0)
    monkeypatch.setattr(spectral, "LEAST_ENTRIES", 500)
    monkeypatch.setattr(spectral, "checked_broadcast", None)  # a product by joins would need it


@pytest.mark.parametrize("method, symmetric", [("svd", False), ("svd", True), ("evd", False)])
def test_embedding_by_blocks_matches_dense(frame, in_blocks, monkeypatch, method, symmetric):
    from shoal.operators import blocks

    monkeypatch.setattr(blocks, "CHUNK", 37)
    monkeypatch.setattr(blocks, "PAIR_ENTRIES", 300)
    lap = normalised(planted(), 1.0)
    edges, names = table(frame, lap)
    more = frame([(None, 5, 1.0), (5, None, 1.0)], EDGE)
    got = matrix(spectral.spectral_embed(edges.unionByName(more), 3, method, local_entries=0, symmetric=symmetric), names)
    lam, vec = np.linalg.eigh(lap)
    want = np.linalg.svd(lap)[0][:, :3] if method == "svd" else vec[:, np.argsort(-lam)[:3]]
    assert np.allclose(got.T @ got, np.eye(3), atol=1e-5)
    assert np.allclose(np.abs((got * want).sum(0)), 1, atol=1e-5)


def test_groups_and_rectangles_by_blocks(frame, in_blocks):
    rng = np.random.default_rng(0)
    parts = []
    for g in (1, 2):
        a = (rng.random((40, 12)) < 0.3) * rng.random((40, 12)) + 0.2 * np.outer(np.arange(40) % 2, np.arange(12) % 2)
        parts.append((g, a))
    rows = [(g, int(i), int(j), float(a[i, j])) for g, a in parts for i, j in zip(*np.nonzero(a))]
    out = spectral.spectral_embed(frame(rows, "partition_id int, " + EDGE), 2, by=["partition_id"]).collect()
    for g, a in parts:
        found = {r.node: r.vec for r in out if r.partition_id == g}
        got = np.array([found.get(i, [0.0, 0.0]) for i in range(40)])
        assert np.allclose(np.abs((got * np.linalg.svd(a)[0][:, :2]).sum(0)), 1, atol=1e-5)


def test_a_product_by_blocks_shuffles_nothing(frame, in_blocks, monkeypatch):
    from shoal.operators import blocks

    plans, put = [], blocks._put
    monkeypatch.setattr(blocks, "_put", lambda df, path, packed=False: plans.append(df._jdf.queryExecution().executedPlan().toString()) or put(df, path, packed))
    edges, _ = table(frame, normalised(planted(), 1.0))
    spectral.spectral_embed(edges, 3, local_entries=0, symmetric=True).collect()
    moved = ["Exchange" in p for p in plans]
    assert len(moved) > 8 and sum(moved) == 2 and not any(moved[2:])  # names and entries; then products and restarts
