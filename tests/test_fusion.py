from collections import Counter

import numpy as np
import pytest
from conftest import SMALL, rows_of

from shoal.operators import fusion
from shoal.plans import end_to_end

LOCAL = "partition_id int, node long, cluster int"


@pytest.fixture
def local(frame):
    # sizes 3 = T - 1, 4 = T, and 11, which three groups do not divide
    rows = [(0, i, 0) for i in range(3)] + [(0, 10 + i, 1) for i in range(4)] + [(1, 20 + i, 0) for i in range(11)]
    return frame(rows, LOCAL)


def test_break_and_split_sizes(local):
    small = fusion.break_small(local, 4).collect()
    assert {(r.node, r.piece) for r in small} == {(0, 0), (1, 1), (2, 2)}
    for keep, want in ((True, {10: [1, 1, 1, 1], 20: [3, 3, 3, 2]}), (False, {10: [2, 1, 1], 20: [5, 3, 3]})):
        pieces = fusion.split_large(local, 4, 3, retain_left=keep).collect()
        assert len(pieces) == 15
        for start, sizes in want.items():
            mine = Counter(r.piece for r in pieces if start <= r.node < start + 11 and (r.node < 20) == (start == 10))
            assert sorted(mine.values(), reverse=True) == sizes


def test_supernodes_cover_every_node_once(local):
    supers = fusion.build_supernodes(local, 4, 3).collect()
    assert sorted(r.node for r in supers) == sorted([*range(3), *range(10, 14), *range(20, 31)])
    assert {r.super_id for r in supers} == set(range(9))
    assert rows_of(fusion.high_confidence(fusion.build_supernodes(local, 4, 3)))[0] >= (0,)


def test_members_in_any_block_size(local):
    whole = {(r.partition_id, r.cluster): r.members for r in fusion.local_cluster_members(local).collect()}
    assert whole[1, 0] == list(range(20, 31))
    parts = fusion.local_cluster_members(local, block=3).collect()
    own = sorted((r.part, r.members) for r in parts if (r.partition_id, r.cluster) == (1, 0))
    assert [len(m) for _, m in own] == [3, 3, 3, 2] and sum((m for _, m in own), []) == whole[1, 0]


@pytest.fixture
def small_graph(frame):
    rng = np.random.default_rng(5)
    a = np.triu(rng.random((12, 12)) < 0.5, 1)
    a = (a | a.T).astype(float)
    group = np.array([0, 0, 0, 0, 1, 1, 1, 2, 3, 4, 5, 6])
    edges = frame([(int(i), int(j), 1.0) for i, j in zip(*np.nonzero(a))], "src long, dst long, weight double")
    supers = frame([(int(g), i) for i, g in enumerate(group)], "super_id long, node long")
    return a, group, edges, supers


@pytest.mark.parametrize("diagonal", [0.0, 1.0])
def test_density_matches_brute_force(small_graph, diagonal):
    a, group, edges, supers = small_graph
    a = a + diagonal * np.eye(12)
    got = {(r.super_a, r.super_b): r.density for r in fusion.block_density(edges, supers, diagonal).collect()}
    for i in range(7):
        for j in range(7):
            block = a[np.ix_(group == i, group == j)]
            assert got.get((i, j), 0.0) == pytest.approx(block.mean())


@pytest.mark.parametrize("rule", ["observed", "always"])
def test_fused_degrees_match_brute_force(small_graph, rule):
    a, group, edges, supers = small_graph
    t = 0.55
    fused = np.zeros((7, 7))
    for i in range(7):
        for j in range(7):
            block = a[np.ix_(group == i, group == j)]
            if block.size == 1 and (group == i).sum() == 1:
                fused[i, j] = 1 if rule == "always" else block.max()
            else:
                fused[i, j] = block.mean() >= t
    edges = fusion.fused_graph(fusion.block_density(edges, supers), t, rule)
    clique = fusion.clique_members(supers) if rule == "always" else None
    got = {r.super_id: r.degree for r in fusion.fused_degrees(edges, supers, clique).collect()}
    assert got == {i: fused[i].sum() for i in range(7)}
    labels = fusion.fused_clustering(edges, supers, 2, clique)
    assert {r.super_id for r in labels.collect()} == set(range(7))


def test_bad_options(small_graph):
    _, _, edges, supers = small_graph
    density = fusion.block_density(edges, supers)
    with pytest.raises(ValueError, match="positive"):
        fusion.fused_graph(density, 0.0)
    with pytest.raises(ValueError, match="single_pairs"):
        fusion.fused_graph(density, 0.5, "never")


def test_both_single_rules_end_to_end(spark):
    from shoal.operators.evaluate import best_permutation_accuracy
    from shoal.registry import fixtures

    edges = end_to_end.symmetric_graph(fixtures.planted_edges(spark, SMALL))
    nodes = fixtures.nodes(spark, SMALL).select("node", "label")
    out = end_to_end.divide_conquer_clustering(edges, nodes, 3, partitions=2, single_pairs="always", groups=2)
    assert best_permutation_accuracy(out, 3).first()["accuracy"] >= 0.95
