from itertools import permutations

import numpy as np
import pytest
from llm_support import docs, llm  # noqa: F401

from shoal.llm.filter_audit import failures, filter_audit
from shoal.llm.term_matrix import csr, row_measures, term_matrix

LABELS = "doc_id long, quality int, toxic int"


def failed(texts, ids):
    out = []
    for t, i in zip(texts, ids):
        t = t or ""
        w = t.encode().split()
        a = len(w) < 200
        b = 100 * len(set(w)) < 50 * len(w)
        c = 100 * sum("A" <= x <= "Z" for x in t) > 2 * len(t)
        d = any(x in "#$%&*|" for x in t)
        e = i is not None and any(j is not None and j < i and (u or "") == t for u, j in zip(texts, ids))
        out.append(sum(f << k for k, f in enumerate((a, b, c, d, e))))
    return out


def corpus():
    rng = np.random.default_rng(3)
    texts = [None, "", "", " \t\n", "a b", "A" * 30]
    for k in range(40):
        n = int(rng.integers(150, 260))
        words = [f"{'W' if rng.random() < 0.1 else 'w'}{x}" for x in rng.integers(0, 60 + 400 * (k % 2), n)]
        texts.append(" ".join(words) + " #" * (k % 3 == 0))
    return texts + texts[10:20] + texts[10:14] + ["x " * 100_000]


def test_failures_match_brute_force(docs):
    texts = corpus()
    ids = [None if k == 12 else k // 2 if k > 50 else k for k in range(len(texts))]
    got = sorted((r.doc_id or -1, r.fails) for r in failures(docs(texts, ids)).collect())
    assert got == sorted((i or -1, f) for i, f in zip(ids, failed(texts, ids)))


def test_every_order_and_step(llm):
    texts = corpus()
    rng = np.random.default_rng(5)
    source = [[None, "", "s", "t"][k] for k in rng.integers(0, 4, len(texts))]
    table = llm.createDataFrame(
        [(k, t, s, 1, 2) for k, (t, s) in enumerate(zip(texts, source))],
        "doc_id long, text string, source string, fails int, n_words int",
    )
    labels = [(0, 1, None), (7, 1, 1), (7, 0, 0), (8, 0, 1), (None, 1, 1), (9, None, 1), (999, 1, 1)]
    got = filter_audit(table, llm.createDataFrame(labels, LABELS)).collect()
    good, toxic = {0, 7}, {7, 8, 9}
    fails = failed(texts, list(range(len(texts))))
    want = {}
    for part in {s or "" for s in source}:
        rows = [(k, f) for k, (f, s) in enumerate(zip(fails, source)) if (s or "") == part]
        gone_by = dict.fromkeys("ABCDE", 0)
        for order in map("".join, permutations("ABCDE")):
            left = rows
            for step, letter in enumerate(order, 1):
                bit = 1 << "ABCDE".index(letter)
                out = [r for r in left if r[1] & bit]
                redundant = sum(bool(f & bit) for _, f in rows) - len(out)
                left = [r for r in left if not r[1] & bit]
                gone_by[letter] += len(out)
                want[part, order, step] = [
                    len(left), len(out), redundant, sum(f == bit for _, f in rows),
                    sum(k in good for k, _ in out), sum(k in toxic for k, _ in out),
                ]
        for (p, order, step), v in want.items():
            if p == part:
                v.append(gone_by[order[step - 1]])
    names = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    assert len(got) == len(want)
    assert {(r.part, r.filter_order, r.step): [r[n] for n in names] for r in got} == want


@pytest.mark.parametrize("entries, terms, part", [(1, 1, 3), (40, 1000, 1000), (10_000, 25, 17)])
def test_matrix_in_small_shards(docs, entries, terms, part):
    texts = corpus()[:20]
    matrix, words = term_matrix(docs(texts), ["doc_id"], entries=entries, terms=terms, part_terms=part)
    word = {}
    for r in words.collect():
        for w, c in zip(bytes(r.words).split(), np.frombuffer(r.columns, np.int64).tolist()):
            assert word.setdefault(c, w) == w
    assert sorted(word) == list(range(len(word))) and len(set(word.values())) == len(word)
    seen = {}
    for s in matrix.collect():
        indptr, columns, counts = csr(s.indptr, s.columns, s.counts)
        for i, row in enumerate(s["rows"]):
            a, b = indptr[i], indptr[i + 1]
            seen[row.doc_id] = {word[c]: n for c, n in zip(columns[a:b].tolist(), counts[a:b].tolist())}
    want = {}
    for k, t in enumerate(texts):
        want[k] = {}
        for w in (t or "").encode().split():
            want[k][w] = want[k].get(w, 0) + 1
    assert seen == want
    rows = {r.doc_id: (r.n_words, r.n_distinct) for r in row_measures(matrix).collect()}
    assert rows == {k: (sum(v.values()), len(v)) for k, v in want.items()}


def test_empty_tables(docs, llm):
    none = llm.createDataFrame([], LABELS)
    assert filter_audit(docs([]), none).collect() == []
    got = filter_audit(docs([None, None]), none).collect()
    # Both fail A; the second also fails E, which goes first in half of the orders.
    assert len(got) == 600 and {r.shapley for r in got if r.filter_order[r.step - 1] == "A"} == {180}
