import re

import numpy as np
from llm_support import by_id, docs, llm  # noqa: F401

from shoal.llm import decontaminate as d


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def brute(text, items):
    w, hit, found = words(text), set(), set()
    for k, t in items:
        v = words(t)
        n = min(10, len(v))
        for i in range(len(v) - n + 1 if v else 0):
            for p in range(len(w) - n + 1):
                if w[p : p + n] == v[i : i + n]:
                    hit |= set(range(p, p + n))
                    found.add(k)
    return len(w), len(hit), sorted(found)


ITEMS = [("7", "One two three"), ("12", " ".join(f"i{k}" for k in range(25))), ("3", None), ("4", "..."), ("5", "a b a b a b a b a b a b"), ("6", "ONE, two; three")]


def cases():
    rng = np.random.default_rng(2)
    long = [f"i{k}" for k in range(25)]
    texts = [None, "", "one two", "x One-two...three y one two three", " ".join(long[3:12]), " ".join(long[3:13]), "q " + " ".join(long) + " r"]
    texts += ["a b " * 30, "é " + " ".join(long[5:16]).upper() + "é", " ".join(f"w{k}" for k in rng.integers(0, 50, 3000)) + " one two three"]
    return texts + [texts[5]] * 2


def bench(llm, items=ITEMS):
    return llm.createDataFrame(items, "item_id string, text string")


def test_hits_match_brute_force(llm, docs, monkeypatch):
    texts = cases()
    want = {i: brute(t, ITEMS) for i, t in enumerate(texts)}
    assert by_id(d.contamination(docs(texts), bench(llm), ["doc_id"]), "n_words", "n_hit", "item_ids") == want
    # Blocks of the benchmark and small shards give the same.
    blocks = d.read_blocks(bench(llm), 10)
    assert len(blocks) > 2
    monkeypatch.setattr(d, "BLOCK_WORDS", 10)
    monkeypatch.setattr(d, "SHARD_CHARS", 1)
    assert by_id(d.contamination(docs(texts), bench(llm), ["doc_id"]), "n_words", "n_hit", "item_ids") == want


def brute_longest(texts, items):
    """By document: ``(begin, words)`` of all places of the longest match of some test suffix."""
    best, places = {}, {}
    for item in set((k, tuple(words(t))) for k, t in items if words(t)):
        v = item[1]
        for q in range(len(v)):
            for d, t in enumerate(texts):
                w = words(t)
                for p in range(len(w)):
                    n = 0
                    while p + n < len(w) and q + n < len(v) and w[p + n] == v[q + n]:
                        n += 1
                    if n >= min(10, len(v)):
                        best[item, q] = max(n, best.get((item, q), 0))
                        places.setdefault((item, q, n), set()).add((d, p))
    out = {d: set() for d in range(len(texts))}
    for (item, q), n in best.items():
        for d, p in places[item, q, n]:
            out[d].add((p, n))
    return best, out


def test_longest_matches_over_all_shards_match_brute_force(llm, docs, monkeypatch):
    long = ITEMS[1][1].split()
    texts = [None, "", "one two three", "z z " + " ".join(long[4:19]) + " z", " ".join(long[4:16]), " ".join(long[6:20]) + " x " + " ".join(long[4:19])]
    texts += ["a b " * 8, "b a b a b a b a b a b", "q " + " ".join(long[2:14]).upper(), " ".join(long[4:19])] + ["one two three x one two three"] * 2
    items = [*ITEMS, ("12", " ".join(long[3:] + ["other"])), (None, " ".join(long[5:18]))]
    best, places = brute_longest(texts, items)
    assert len(best) > 20
    for size, block in ((d.SHARD_CHARS, d.BLOCK_WORDS), (1, 10), (100, 30)):
        monkeypatch.setattr(d, "SHARD_CHARS", size)
        monkeypatch.setattr(d.read_blocks, "__defaults__", (block,))
        found = d.contamination(docs(texts).repartition(3), bench(llm, items), ["doc_id"], matches=True)
        found = d.written(found, "found")
        suffixes, at = d.longest_matches(found)
        assert sorted((r.item_id or "", r.item_start, r.n_words) for r in suffixes.collect()) == sorted(
            (k[0] or "", q, n) for (k, q), n in best.items()
        )
        got = {i: set() for i in range(len(texts))}
        for r in at.collect():
            got[r.doc_id].add((r.doc_start, r.n_words))
        assert got == places
        said = by_id(d.with_longest(found), "longest_match", "n_longest")
        assert said == {i: (max((n for _, n in p), default=0), len(p)) for i, p in places.items()}


def test_removal_keeps_clean_rows_and_columns(llm, docs):
    texts = cases()
    table = docs(texts)
    out = d.decontaminated(table, bench(llm))
    assert out.columns == table.columns
    assert {r.doc_id for r in out.collect()} == {i for i, t in enumerate(texts) if not brute(t, ITEMS)[1]}


def test_items_without_an_id_hit_too(llm, docs):
    items = [(None, "one two three"), (None, "four five"), ("8", "four five")]
    texts = ["x One two three y", "four five, one two three", "four", None]
    table = docs(texts)
    got = by_id(d.contamination(table, bench(llm, items), ["doc_id"]), "n_hit", "item_ids")
    # As OP9_SQL counts them: all null ids are one item.
    assert got == {0: (3, [None]), 1: (5, ["8", None]), 2: (0, []), 3: (0, [])}
    assert {r.doc_id for r in d.decontaminated(table, bench(llm, items)).collect()} == {2, 3}


def test_empty_tables(llm, docs):
    assert d.contamination(docs([]), bench(llm), ["doc_id"]).collect() == []
    rows = d.contamination(docs(["a b", None]), bench(llm, []), ["doc_id"]).collect()
    assert [(r.n_words, r.n_hit, r.item_ids) for r in rows] == [(2, 0, []), (0, 0, [])]
    assert d.decontaminated(docs(["a b"]), bench(llm, [])).count() == 1
    for texts, items in (([], ITEMS), (["a b"], [])):
        found = d.contamination(docs(texts), bench(llm, items), ["doc_id"], matches=True)
        assert by_id(d.with_longest(found), "longest_match", "n_longest") == dict.fromkeys(range(len(texts)), (0, 0))
