import numpy as np
import pytest
from llm_support import docs, llm  # noqa: F401

from shoal.llm.suffix_dedup import cut_words, repeated_passages, without_repeats


def brute(texts, least):
    ws = [(t or "").encode().split() for t in texts]
    count = {}
    for w in ws:
        for i in range(len(w) - least + 1):
            g = tuple(w[i : i + least])
            count[g] = count.get(g, 0) + 1
    out = set()
    for d, w in enumerate(ws):
        hit = [i for i in range(len(w) - least + 1) if count[tuple(w[i : i + least])] > 1]
        runs = []
        for i in hit:
            if runs and i <= runs[-1][1]:
                runs[-1][1] = i + least
            else:
                runs.append([i, i + least])
        out |= {(d, a, b) for a, b in runs}
    return out


def corpus():
    rng = np.random.default_rng(4)
    word = lambda n: [f"w{k}" for k in rng.integers(0, 300, n)]
    shared, other, long = word(50), word(49), word(140)
    texts = [None, "", "a " * 49, "a " * 80, "a " * 60]
    texts += [" ".join(word(int(rng.integers(0, 60))) + shared + word(20)) for _ in range(4)]
    texts += [" ".join(word(10) + other + word(20)) for _ in range(3)]
    texts += [" ".join(long), " ".join(long[30:]), " ".join(word(5) + long[:100] + word(5)), " ".join(word(200))]
    whole = " ".join(word(70))
    return texts + [whole, whole, whole + " more", " ".join(word(30)), " ".join(shared + shared)]


@pytest.mark.parametrize("least", [36, 50, 64])
def test_passages_match_brute_force(docs, least):
    texts = corpus()
    rows = repeated_passages(docs(texts), least).collect()
    assert {(r.doc_id, r.start, r.end) for r in rows} == brute(texts, least)
    assert all(r.n_words == r.end - r.start for r in rows)


def test_copies_keep_one(docs):
    rows = repeated_passages(docs(corpus())).where("whole_copy").collect()
    assert sorted((r.doc_id, r.is_first) for r in rows) == [(16, True), (17, False)]


def brute_cut(texts, least):
    """The texts after each word of a later place is gone; None for a row that goes."""
    ws = [(t or "").split() for t in texts]
    owner = [texts.index(t) if len(w) >= least else d for d, (t, w) in enumerate(zip(texts, ws))]
    lowest, out = {}, []
    for d, w in enumerate(ws):
        for i in range(len(w) - least + 1):
            lowest.setdefault(tuple(w[i : i + least]), (owner[d], i))
    for d, w in enumerate(ws):
        late = [i for i in range(len(w) - least + 1) if lowest[tuple(w[i : i + least])] != (owner[d], i)]
        gone = set(range(len(w))) if owner[d] != d else {j for i in late for j in range(i, i + least)}
        left = [x for j, x in enumerate(w) if j not in gone]
        out.append(None if w and not left else left)
    return out


@pytest.mark.parametrize("least", [36, 50])
def test_cut_matches_brute_force(docs, least):
    texts = corpus()
    table = docs(texts)
    left = without_repeats(table, least)
    assert left.columns == table.columns
    got = {r.doc_id: (r.text or "").split() for r in left.collect()}
    want = {d: w for d, w in enumerate(brute_cut(texts, least)) if w is not None}
    assert got == want
    cut = {}
    for r in repeated_passages(table, least).collect():
        assert r.is_first == (not r.cut) and all(r.start <= c.start < c.end <= r.end for c in r.cut)
        cut[r.doc_id] = cut.get(r.doc_id, 0) + sum(c.end - c.start for c in r.cut)
    for d, text in enumerate(texts):
        assert cut.get(d, 0) == len((text or "").split()) - len(want.get(d, []))


@pytest.mark.parametrize("order", [(0, 1, 1), (1, 0, 1), (1, 1, 0)])
def test_passage_of_a_copied_text_stays_once(docs, order):
    shared = [f"s{i}" for i in range(50)]
    texts = [" ".join(f"{k}{i}" for i in range(20)) + " " + " ".join(shared) + " end" for k in "ab"]
    left = [r.text.split() for r in without_repeats(docs([texts[k] for k in order])).collect()]
    assert sum(w == "s7" for t in left for w in t) == 1
    assert sorted(t[0] for t in left) == ["a0", "b0"]


def test_cut_words_and_rows_that_stay(docs):
    assert cut_words(" a  b\tc d ", [(1, 3)]) == " a  d "
    assert cut_words("a b c", [(0, 1), (2, 3)]) == "b "
    text = " ".join(f"w{i}" for i in range(60))
    left = without_repeats(docs([text] * 3 + [None, ""], [1, 1, 2, None, 3]))
    assert sorted((r.doc_id or 0, r.text or "") for r in left.collect()) == [(0, ""), (1, text), (1, text), (3, "")]
    assert without_repeats(docs([])).collect() == []


def test_repeated_rows_null_ids_and_empty_table(docs):
    text = " ".join(f"w{i}" for i in range(60))
    rows = repeated_passages(docs([text] * 3 + [None], [None, 1, 1, None])).collect()
    assert sorted((r.doc_id or 0, r.start, r.end) for r in rows) == [(0, 0, 60), (1, 0, 60), (1, 0, 60)]
    assert repeated_passages(docs([])).collect() == []
    with pytest.raises(ValueError):
        repeated_passages(docs([]), 20)
