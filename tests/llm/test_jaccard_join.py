import numpy as np
from llm_support import by_id, docs, llm  # noqa: F401

from shoal.llm import jaccard_join as j
from shoal.llm.components import connected_components
from shoal.llm.partenum import Sketches, differences, parity_sketch, signatures, sketch_bits


def shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w)} if 0 < len(w) < 5 else {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if w else set()


def brute(texts, ids):
    sets = [shingles(t) for t in texts]
    up = list(range(len(texts)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(texts)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                up[root(a)] = root(b)
    least = {}
    for k in range(len(texts)):
        least[root(k)] = min(least.get(root(k), ids[k]), ids[k])
    return {ids[k]: (len(sets[k]), least[root(k)] if sets[k] else ids[k]) for k in range(len(texts))}


def mutated(words, rng, n):
    out = list(words)
    for at in rng.choice(len(out), n, replace=False):
        out[at] = f"m{rng.integers(1e9)}"
    return out


def corpus(seed):
    rng = np.random.default_rng(seed)
    common = [f"c{i}" for i in range(40)]
    texts = [None, "", " \n", "Ab cd", "ab CD", "one two three four five", "A", "a"]
    for g in range(12):
        base = [f"w{rng.integers(400)}" for _ in range(int(rng.integers(5, 150)))]
        if g % 3 == 0:
            base = common + base
        for _ in range(8):
            texts.append(" ".join(mutated(base, rng, int(rng.integers(0, max(2, len(base) // 20))))))
    return texts + texts[8:20]


def test_components_match_brute_force(docs):
    texts = corpus(1)
    ids = list(range(100, 100 + len(texts)))
    assert by_id(j.jaccard_components(docs(texts, ids)), "n_shingles", "component_id") == brute(texts, ids)


def test_small_blocks_and_all_shingles_frequent_change_nothing(docs, monkeypatch):
    texts = corpus(2)
    ids = list(range(len(texts)))
    monkeypatch.setattr(j, "BLOCK", 3)
    monkeypatch.setattr(j, "MOST", 1)
    monkeypatch.setattr(j, "FREQUENT_LEAST", 1)
    assert by_id(j.jaccard_components(docs(texts, ids)), "n_shingles", "component_id") == brute(texts, ids)


def test_similar_sets_share_a_signature_and_pass_the_sketch():
    rng = np.random.default_rng(3)
    for n in [1, 3, 4, 5, 7, 8, 9, 15, 16, 31, 33, 63, 64, 65, 100, 128, 400, 1000]:
        for _ in range(12):
            a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
            d = differences(n, n * 5 // 4)
            drop = int(rng.integers(0, d + 1))
            b = np.unique(np.concatenate([a[drop:], rng.integers(0, 2**63, d - drop).astype(np.uint64)]))
            frequent = np.sort(rng.choice(a, len(a) // 2, replace=False))
            shared = len(np.intersect1d(a, b))
            if 5 * shared >= 4 * (len(a) + len(b) - shared):
                assert len(np.intersect1d(signatures(a, frequent), signatures(b, frequent)))
            zero = np.zeros(1, np.int64)
            one, other = (Sketches([parity_sketch(x)]) for x in (a, b))
            assert one.differing(zero, other, zero)[0] <= len(a) + len(b) - 2 * shared


def test_sketches_of_any_width_fold_and_tell_large_sets_apart():
    rng = np.random.default_rng(4)
    sets = [np.unique(rng.integers(0, 2**63, n).astype(np.uint64)) for n in (0, 1, 500, 1000, 1025, 1200, 5000, 6000, 20_000, 24_000)]
    sets += [s[: len(s) * 9 // 10] for s in sets]
    held = Sketches([parity_sketch(s) for s in sets])
    pairs = [(i, k) for i in range(len(sets)) for k in range(len(sets))]
    at, to = (np.array(x) for x in zip(*pairs))
    for (i, k), d in zip(pairs, held.differing(at, held, to).tolist()):
        a, b = sets[i], sets[k]
        apart = len(np.setxor1d(a, b))
        assert d <= apart
        narrow = min(sketch_bits(len(a)), sketch_bits(len(b)))
        bits = lambda s: np.bincount(((s >> np.uint64(30)) % np.uint64(narrow)).astype(np.int64), minlength=narrow) & 1  # noqa: E731, B023
        assert d == int((bits(a) ^ bits(b)).sum())
        if min(len(a), len(b)) >= 500 and 4 * len(a) <= 5 * len(b) and 4 * len(b) <= 5 * len(a) and apart == len(a) + len(b):
            assert not j._may_be_similar(len(a), len(b), d)


def test_one_of_each_keeps_columns_and_blank_texts(docs):
    texts = ["", None, " ", "a b c d e f", "a b c d e f", "A B c d e f", "z y x w v u"]
    table = docs(texts, [0, 1, 2, 9, 5, 5, 7])
    out = j.one_of_each(table)
    assert out.columns == table.columns
    assert sorted(r.doc_id for r in out.collect()) == [0, 1, 2, 5, 7]
    assert j.one_of_each(docs([])).collect() == []


def test_repeated_rows_null_ids_and_empty_table(docs):
    rows = j.jaccard_components(docs(["a b c d e f"] * 3 + ["q"], [4, 4, None, None])).collect()
    assert sorted((r.n_shingles, r.component_id) for r in rows if r.n_shingles == 2) == [(2, 4)] * 3
    assert [r.component_id for r in rows if r.n_shingles == 1] == [None]
    assert j.jaccard_components(docs([])).collect() == []


def test_long_chain_of_components(llm):
    links = llm.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (7, 7)], "a long, b long")
    got = {r.node: r.component for r in connected_components(links).collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 101: 100}
