import random
import re
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from llm_support import llm  # noqa: F401

import shoal.llm.divergence as divergence
from shoal.llm.divergence import source_divergence, vocabulary
from shoal.llm.transducer import Transducer

SCHEMA = "doc_id long, text string, lang string, source string, ordinal int, n int"


@settings(max_examples=60, deadline=None)
@given(st.sets(st.binary(max_size=6), max_size=60), st.lists(st.binary(max_size=7), max_size=20))
def test_ordinals_of_any_keys(keys, others):
    keys = sorted(keys)
    t = Transducer.from_bytes(Transducer.build(keys).to_bytes())
    words = keys + others
    assert t.keys == len(keys)
    assert t.ordinals(words).tolist() == [keys.index(w) if w in keys else -1 for w in words]
    for k in keys:
        begin = t.after(k[:2])
        assert t.ordinals([k[2:]], begin).tolist() == [keys.index(k)]


def test_equal_endings_are_one_branch():
    keys = sorted(a + b for a in (b"a", b"bb", b"c") for b in (b"ing", b"ly", b"tion"))
    t = Transducer.build(keys)
    trie = {k[:i] for k in keys for i in range(len(k) + 1)}
    classes = {frozenset(k[len(p) :] for k in keys if k.startswith(p)) for p in trie}
    assert len(t.final) == len(classes) < len(trie)
    with pytest.raises(ValueError):
        Transducer.build([b"b", b"a"])


def brute(rows, least):
    find = lambda t: re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    docs = [(l or "", s or "", Counter(find(t))) for t, l, s in rows]
    out = set()
    for lang in {d[0] for d in docs}:
        df = Counter(t for l, _, c in docs if l == lang for t in c)
        kept = [t for t, n in df.items() if n >= least]
        v = len(kept)
        of = {s: Counter() for l, s, _ in docs if l == lang}
        for l, s, c in docs:
            if l == lang:
                of[s].update(c)
        whole = sum(of.values(), Counter())

        def share(c):
            total = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 2) // (total + 2 * v) for t in kept}

        p, q = {s: share(c) for s, c in of.items()}, share(whole)
        diff = lambda a, b: (a - b) ** 2 // (a + b)
        for s in of:
            pair = [(-sum(diff(p[s][t], p[o][t]) for t in kept), o.encode(), o) for o in of if o != s]
            term = [(-diff(p[s][t], q[t]), t.encode(), t) for t in kept if of[s][t] > 0 and p[s][t] > q[t]]
            for part, items in (("pair", sorted(pair)), ("term", sorted(term)[:10])):
                out |= {(lang, s, part, item, -value, k) for k, (value, _, item) in enumerate(items, 1)}
    return out


def corpus(seed):
    rng = random.Random(seed)
    words = ["The", "the", "Éa", "éa", "a", "ab", "b", "ß", "x1y", "İ", "𝒳z", "z-z", "q"] + [f"w{c}" for c in "abcdefgh"]
    rows = [(None, "en", "s1"), ("", None, None), ("a b", None, "s2"), ("\x00the", "a\x00b", "s1"), ("the", "a", "s1")]
    for k in range(90):
        text = " ".join(rng.choices(words, k=rng.randrange(0, 25)))
        rows.append((text, rng.choice(["en", "en", "fr", "", None, "a"]), rng.choice(["s1", "s1", "s1", "é", "ẞ", "", None])))
    return rows + rows[-5:]


def collected(df):
    return {tuple(r) for r in df.select("lang", "source", "part", "item", "value", "rank").collect()}


@pytest.mark.parametrize("least, block_terms, held, cells", [(10, 1000, 400_000, 10**6), (3, 4, 7, 9), (1, 9, 1, 1)])
def test_matches_brute_force(llm, monkeypatch, least, block_terms, held, cells):
    monkeypatch.setattr(divergence, "HELD", held)
    monkeypatch.setattr(divergence, "PAIR_CELLS", cells)
    rows = corpus(least)
    if least == 1:
        rows = rows[:25]
    table = llm.createDataFrame([(k, *r, 1, 2) for k, r in enumerate(rows)], SCHEMA)
    df = source_divergence(table, least=least, block_terms=block_terms)
    assert df.count() == len(collected(df))
    assert collected(df) == brute(rows, least)


def test_blocks_cover_the_vocabulary(llm):
    texts = llm.createDataFrame([("en", "s", "c a b d e f g")], "lang string, source string, text string")
    terms, blocks = vocabulary(texts, 1, 3)
    got = sorted((r.ordinal, bytes(r.key)) for r in terms.collect())
    assert got == [(k, b"en\0" + bytes([97 + k])) for k in range(7)]
    parts = {r.first: Transducer.from_bytes(bytes(r.data)) for r in blocks.collect()}
    assert {f: t.keys for f, t in parts.items()} == {0: 3, 3: 3, 6: 1}
    for k in range(7):
        assert parts[k // 3 * 3].ordinals([b"en\0" + bytes([97 + k])]).tolist() == [k % 3]


def test_no_terms_and_empty_table(llm):
    table = llm.createDataFrame([(k, None, "en", s, 1, 2) for k, s in enumerate("abb")], SCHEMA)
    assert collected(source_divergence(table)) == {("en", "a", "pair", "b", 0, 1), ("en", "b", "pair", "a", 0, 1)}
    assert collected(source_divergence(table.limit(0))) == set()
