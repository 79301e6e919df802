import zlib

import numpy as np
import pytest
from llm_support import by_id, docs, llm  # noqa: F401

from shoal.llm.quality_classifier import PIECE_BYTES, accepted, fit_quality, measures_of, quality_query, quality_scores
from shoal.llm.toxicity import (
    ToxicityModel,
    extreme_value_fit,
    fit_toxicity,
    maximal_segments,
    significance,
    toxicity_query,
    toxicity_scores,
)
from shoal.llm.training import labelled_sample

WORDS = [a + b + c for a in ("th", "er", "on", "an") for b in ("in", "ou", "ea", "st") for c in ("e", "ly", "ed", "ing")]


def text_of(i, bad):
    rng = np.random.default_rng(i)
    words = [WORDS[k] for k in rng.integers(0, len(WORDS), 120)]
    return " ".join(w + "$$$" if bad else w for w in words)


def labelled(llm, n=400):
    rows = [(i, text_of(i, i % 4 == 0), "x") for i in range(n)]
    labels = [(i, int(i % 4 != 0), int(i % 3 == 0)) for i in range(n)]
    return (
        llm.createDataFrame(rows, "doc_id long, text string, score string"),
        llm.createDataFrame(labels, "doc_id long, quality int, toxic int"),
    )


def test_quality_of_the_held_out_fold(llm):
    table, labels = labelled(llm)
    rows = [r for r in quality_query(table, labels).collect() if r.held_out]
    assert {r.doc_id for r in rows} == {i for i in range(400) if zlib.crc32(str(i).encode()) % 5 == 0}
    right = [r.predicted == int(r.doc_id % 4 != 0) for r in rows]
    assert sum(right) / len(right) > 0.95
    kept = accepted(table, fit_quality(table, labels))
    assert kept.columns == table.columns
    assert 0.9 < kept.where("doc_id % 4 <> 0").count() / 300 <= 1.0


def test_measures_match_plain_compression(llm):
    import zstandard

    model = fit_quality(*labelled(llm, 200))
    texts = [None, "", "x", "é " * 3000, text_of(1, True), text_of(2, False) * 9]
    got = measures_of(texts, model.compressors())
    for text, row in zip(texts, got):
        raw, sizes = (text or "").encode(), []
        for held in (model.good, model.bad, None):
            held = {"dict_data": zstandard.ZstdCompressionDict(held)} if held else {}
            c = zstandard.ZstdCompressor(level=3, write_content_size=False, write_checksum=False, **held)
            sizes.append(sum(len(c.compress(raw[i : i + PIECE_BYTES])) for i in range(0, len(raw), PIECE_BYTES)))
        want = [0, 0, 0]
        if raw:
            good, bad, plain = sizes
            want = [(bad - good) / min(bad, good), min(plain / len(raw), 2.0), np.log1p(len(raw))]
        assert row == pytest.approx(want, rel=0.02, abs=0.02 if raw else 0)
    # A larger difference never means a lower weight of the curve's argument.
    grown = model.features(np.array([[g, 0.5, 6.0] for g in (-3.0, -0.1, 0.0, 0.1, 3.0)]))[:, 0]
    assert (np.diff(grown) > 0).all() and abs(grown[-1]) < 20


def test_accepted_rows_are_those_whose_score_reaches_the_threshold(llm, docs):
    model = fit_quality(*labelled(llm, 200))
    texts = [None, "", "x", text_of(1, True), text_of(2, False), text_of(2, False), "y " * 50000]
    table = docs(texts, [0, 1, 2, 3, 4, 4, None])
    scores = quality_scores(table, model, ["doc_id"]).collect()
    for threshold in (0.0, 0.3, 0.7, 1.1):
        kept = accepted(table, model, threshold)
        assert kept.columns == table.columns
        want = sorted((r.doc_id or -1 for r in scores if r.score >= threshold))
        assert sorted(r.doc_id or -1 for r in kept.collect()) == want
    assert len({r.score for r in scores if r.doc_id in (0, 1)}) == 1
    assert accepted(table.limit(0), model).collect() == []


def test_sample_leaves_the_held_out_fold_and_bad_labels_out(llm):
    table, labels = labelled(llm, 100)
    twice = labels.unionByName(labels.selectExpr("doc_id", "1 - quality AS quality", "toxic").where("doc_id = 1"))
    ids = {r.doc_id for r in labelled_sample(table, twice, "quality", 1000).collect()}
    assert ids == {i for i in range(100) if i != 1 and zlib.crc32(str(i).encode()) % 5}
    assert labelled_sample(table, labels, "quality", 5).count() == 10


@pytest.mark.parametrize("query", [quality_query, toxicity_query])
def test_odd_rows_and_no_labels(llm, docs, query):
    table, labels = labelled(llm, 60)
    odd = docs([None, "", "x", "y " * 50000, "same", "same"], [0, 1, 2, None, 4, 4])
    for use in (labels, labels.limit(0)):
        rows = query(odd, use).collect()
        assert len(rows) == 6 and all(0 <= r.score <= 1 for r in rows)
    assert all(r.score == 0.5 for r in rows)
    assert query(odd.limit(0), labels).collect() == []


def toxic_text(i):
    rng = np.random.default_rng(i)
    words = [WORDS[k] for k in rng.integers(0, len(WORDS), 80)]
    if i % 3 == 0:
        words[20 : 20 + 1 + i % 4] = ["gromk", "gromkel", "vrish"][: 1 + i % 4]
    return " ".join(words)


def test_toxicity_of_the_held_out_fold_and_its_passages(llm):
    table = llm.createDataFrame([(i, toxic_text(i)) for i in range(400)], "doc_id long, text string")
    labels = llm.createDataFrame([(i, int(i % 3 == 0)) for i in range(400)], "doc_id long, toxic int")
    rows = [r for r in toxicity_query(table, labels).collect() if r.held_out]
    assert np.mean([r.predicted == int(r.doc_id % 3 == 0) for r in rows]) > 0.97
    found = toxicity_scores(table, fit_toxicity(table, labels), ["doc_id"]).where("doc_id = 3").first()
    assert [toxic_text(3)[p["start"] : p["end"]].split()[0] for p in found.passages][0] in ("gromk", "gromkel", "vrish")


def brute_segments(scores):
    """Recursively the best segment, then the same on both sides."""

    def best(lo, hi):
        top = None
        for a in range(lo, hi):
            for b in range(a + 1, hi + 1):
                s = sum(scores[a:b])
                if s > 1e-9 and (top is None or s > top[2] + 1e-9):
                    top = (a, b, s)
        if top is None:
            return []
        return best(lo, top[0]) + [top] + best(top[1], hi)

    return best(0, len(scores))


def test_maximal_segments_match_brute_force():
    rng = np.random.default_rng(5)
    for _ in range(60):
        scores = rng.normal(-0.3, 1.0, rng.integers(0, 14)).tolist()
        got, want = maximal_segments(scores), brute_segments(scores)
        assert [(a, b) for a, b, _ in got] == [(a, b) for a, b, _ in want]
        assert np.allclose([s for *_, s in got], [s for *_, s in want])


def test_words_lean_on_their_beginnings():
    model = ToxicityModel(odds={"gro-": 2.0}, known=frozenset({"grom-"}))
    assert model.score_of("grob") == 2.0 and model.score_of("gromx") < 0 and model.score_of("other") < 0


@pytest.mark.parametrize("location, scale", [(-0.5, 0.35), (-3.0, 0.9), (-12.0, 2.5)])
def test_extreme_value_fit_of_simulated_maxima(location, scale):
    rng = np.random.default_rng(6)
    n = rng.integers(20, 2000, 3000)
    best = location + scale * (np.log(n) + rng.gumbel(size=len(n)))
    best[best < 1.5] = 0.0
    best[:60] = 90.0  # wrong labels
    at, spread = extreme_value_fit(list(zip(best, n.tolist())))
    assert abs(spread / scale - 1) < 0.15
    # What the fit is for: the score of which one text of 500 tokens in a hundred has a better one.
    high = location + scale * (np.log(500) - np.log(-np.log(0.99)))
    sure = significance(high, 500, ToxicityModel(location=at, scale=spread))
    assert 1.6 < sure < 2.4
    assert extreme_value_fit([(2.0, 10)] * 9 + [(0.0, 0)] * 50) == (0.0, 1.0)


def test_significance_grows_with_the_score_and_falls_with_the_length():
    model = ToxicityModel(location=-0.5, scale=0.4)
    values = [significance(s, 100, model) for s in (-5, 1, 2, 4, 20, 400)]
    assert values[0] == 0 and values == sorted(values) and len(set(values)) == len(values)
    assert significance(4, 10, model) > significance(4, 100, model) > significance(4, 10**6, model)


def test_calibration_rises_with_significance_and_offsets_are_of_the_text(llm):
    table = llm.createDataFrame([(i, toxic_text(i)) for i in range(400)], "doc_id long, text string")
    labels = llm.createDataFrame([(i, int(i % 3 == 0)) for i in range(400)], "doc_id long, toxic int")
    model = fit_toxicity(table, labels)
    assert model.weights[0] > 0 and model.weights[1] >= 0
    text = "\u0130\u0130\u0130\u0130 the GROMK gromkel vrish the"
    row = toxicity_scores(llm.createDataFrame([(1, text)], "doc_id long, text string"), model, ["doc_id"]).first()
    assert [text[p["start"] : p["end"]] for p in row.passages] == ["GROMK gromkel vrish"]
