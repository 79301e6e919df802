import numpy as np
import pytest
from conftest import rows_of

from shoal.operators import evaluate, split
from shoal.plans.end_to_end import dataset_job, large_network_job


def noisy(n=150, k=3, inside=0.4, across=0.04):
    """Pairs of a graph with planted groups ``i % k``."""
    rng = np.random.default_rng(3)
    return [(i, j) for i in range(n) for j in range(i + 1, n) if rng.random() < (inside if i % k == j % k else across)]


def test_large_network_without_labels(frame):
    pairs = noisy()
    raw = pairs + [(b, a) for a, b in pairs[::2]] + [(a, a) for a in range(9)]
    job = large_network_job(frame(raw, "src long, dst long"), 3, 60, 4)
    found = dict(rows_of(job.result))
    assert sorted(found) == list(range(150))
    truth = frame([(i, i % 3) for i in range(150)], "node long, label int")
    assert evaluate.best_permutation_accuracy(split.attach_labels(job.result, truth), 3).first()["accuracy"] >= 0.9
    row = job.density.first()
    within = sum(found[a] == found[b] for a, b in pairs)
    assert (row.within_edges, row.between_edges) == (2 * within, 2 * (len(pairs) - within))
    assert 0 < row.relative_density < 0.3


def test_dataset_with_names_and_repeats(frame):
    items = frame([(f"n{i:03}", "abc"[i % 3]) for i in range(150)], "id string, class string")
    links = frame([(f"n{a:03}", f"n{b:03}") for a, b in noisy()], "src string, dst string")
    rates = dict(rows_of(dataset_job(links, items, 3, [0.4], 2, random=True, rounding="floor")))
    assert list(rates) == [0.4] and rates[0.4] <= 0.15
    with pytest.raises(ValueError):
        dataset_job(frame([("n000", "lost")], "src string, dst string"), items, 3, [0.4])


def test_pilots_of_a_ratio_and_of_a_seed(frame):
    nodes = frame([(i,) for i in range(15)], "node long")
    assert [split.pilots_for_ratio(nodes, 0.1, rule) for rule in ("ceil", "floor")] == [2, 1]
    edges = frame([(i, (i + 1) % 15, 1.0) for i in range(15)], "src long, dst long, weight double")
    drawn = [rows_of(split.split_pilot_worker(edges, nodes, 5, 2, True, s).pilots.select("node")) for s in ("a", "a", "b")]
    assert drawn[0] == drawn[1] != drawn[2]
