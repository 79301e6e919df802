"""Toxic passages as maximal-scoring segments of token log odds.

Every token has a score: the log odds of being toxic against the usual, smoothed by Dirichlet
priors along a chain of word beginnings (a rare word leans on its prefixes). Tokens that say nothing cost a little,
so the expected score is negative and the maximal-scoring segments of a text, found in
linear time, are its passages of note. The best segment scores of clean texts follow an extreme-value
law. Its fit turns the score of a segment into a significance; the significances of a text make its
probability, and decide which passages are reported.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StructField, StructType

from shoal.llm.common import add_from_text
from shoal.llm.logistic import fit_logistic, probabilities
from shoal.llm.training import held_out, labelled_sample

TOKEN = re.compile(r"[^\W\d_]+")
# Bounds of the fit: labelled documents of each class.
PER_CLASS = 4000
# Lengths of the word beginnings in the chain of priors; the whole word is the last link.
PREFIXES = (3, 4, 5, 6)
PRIOR = 4.0
# Least number of documents behind a link, and least log odds that counts as a sign.
LEAST_DOCS = 3
LEAST_ODDS = 1.5
# Cost of a token that says nothing.
COST = 0.4
# Share of the clean texts with a segment, from the top, of which the fit of the law only takes that they score higher.
TAIL = 0.1
# A passage is reported when a clean text has one as high with a chance of one in 10 ** SIGNIFICANT.
SIGNIFICANT = 2.0


def chain_of(word: str) -> list[str]:
    """The links of a word, shortest first; a beginning is marked by a hyphen."""
    return [word[:n] + "-" for n in PREFIXES if len(word) >= n] + [word]


@dataclass
class ToxicityModel:
    """``odds`` has the links with a sign of their own; ``known`` the other links seen often enough."""

    odds: dict[str, float] = field(default_factory=dict)
    known: frozenset[str] = frozenset()
    location: float = 0.0
    scale: float = 1.0
    weights: np.ndarray = field(default_factory=lambda: np.zeros(3))

    def score_of(self, word: str) -> float:
        """The most specific link that was seen decides."""
        for link in reversed(chain_of(word)):
            value = self.odds.get(link)
            if value is not None:
                return value
            if link in self.known:
                return -COST
        return -COST


class Scores(dict):
    """Word -> score, remembered while the table stays small."""

    LIMIT = 1_000_000

    def __init__(self, model: ToxicityModel):
        self.model = model

    def __missing__(self, word: str) -> float:
        if len(self) >= self.LIMIT:
            self.clear()
        value = self[word] = self.model.score_of(word)
        return value


def maximal_segments(scores: list[float]) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments ``(start, end, score)``, in order, in linear time.

    Keeps candidate segments with the running total at their left and right ends. A new
    positive score looks back for the last candidate that began lower; if that one ended lower than the
    new one, both and all between become one.
    """
    held: list[list] = []  # start, end, left total, right total
    total = 0.0
    for i, s in enumerate(scores):
        before, total = total, total + s
        if s <= 0:
            continue
        new = [i, i + 1, before, total]
        while True:
            j = len(held) - 1
            while j >= 0 and held[j][2] >= new[2]:
                j -= 1
            if j < 0 or held[j][3] >= new[3]:
                held.append(new)
                break
            new = [held[j][0], new[1], held[j][2], new[3]]
            del held[j:]
    return [(a, b, right - left) for a, b, left, right in held]


def _segments(text: str | None, scores: Scores) -> tuple[list[tuple[int, int, float]], int, list]:
    words = list(TOKEN.finditer(text)) if text else []
    values = [scores[m.group().lower()] for m in words]
    if not values or max(values) <= 0:
        return [], len(values), words
    return maximal_segments(values), len(values), words


def significance(score: float, n: int, model: ToxicityModel) -> float:
    """Minus log10 of the chance that the best segment of a clean text of ``n`` tokens scores as high.

    Under the extreme-value law that chance is ``1 - exp(-n exp(-(score - location) / scale))``.
    """
    log_expected = float(np.log(n)) - (score - model.location) / model.scale
    if log_expected < -30:
        return -log_expected / float(np.log(10))
    return max(0.0, -float(np.log10(-np.expm1(-np.exp(min(log_expected, 30.0))))))


def summary(each: list[float]) -> tuple[float, float]:
    """From the significances of all segments of a text: that of the best, and the sum of the others, as logarithms."""
    if not each:
        return 0.0, 0.0
    top = max(each)
    return float(np.log1p(top)), float(np.log1p(max(0.0, sum(each) - top)))


def fit_toxicity(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> ToxicityModel:
    """Learns from at most ``per_class`` labelled documents of each class outside the held-out fold.

    Folds 2 to 4 give the token odds: Spark counts in how many documents of each class a link
    occurs, and only links with a sign, or seen often enough to stop the chain, reach the driver.
    Fold 1 gives the extreme-value law (clean texts) and the calibration (all texts).
    """
    sample = labelled_sample(docs, labels, "toxic", per_class).persist()
    links = F.udf(lambda t: sorted({x for w in TOKEN.findall(t) for x in chain_of(w.lower())}), "array<string>")
    fit = sample.where("fold > 1")
    sizes = {r.label: r.n for r in fit.groupBy("label").agg(F.count("*").alias("n")).collect()}
    toxic, clean = sizes.get(1, 0), sizes.get(0, 0)
    model = ToxicityModel()
    if toxic and clean:
        counted = fit.select("label", F.explode(links("text")).alias("link")).groupBy("link")
        counted = counted.agg(F.sum("label").alias("t"), F.sum(1 - F.col("label")).alias("c"))
        rows = counted.where(F.col("t") + F.col("c") >= LEAST_DOCS).collect()
        model.odds, model.known = token_odds({r.link: (r.t, r.c) for r in rows}, toxic, clean)
    held = sample.where("fold = 1")
    best = _best_segments(held.where("label = 0"), model).collect()
    model.location, model.scale = extreme_value_fit([(r.best, r.n) for r in best])
    rows = _with_summary(held, model).orderBy("doc_id").collect()
    sample.unpersist()
    model.weights = fit_logistic(
        np.array([[r.top, r.rest] for r in rows]).reshape(-1, 2), np.array([r.label for r in rows], dtype=float)
    )
    return model


def token_odds(counts: dict[str, tuple[int, int]], toxic: int, clean: int) -> tuple[dict[str, float], frozenset[str]]:
    """Log odds of each link, its prior centred on the link before it in the chain."""
    base = toxic / (toxic + clean)
    share: dict[str, float] = {}
    odds: dict[str, float] = {}
    for link in sorted(counts, key=lambda x: (x[-1] != "-", len(x))):
        t, c = counts[link]
        shorter = [x for x in chain_of(link.rstrip("-")) if x != link and x in share and len(x) <= len(link)]
        prior = share[shorter[-1]] if shorter else base
        share[link] = p = (t + PRIOR * prior) / (t + c + PRIOR)
        score = float(np.log(p / (1 - p)) - np.log(base / (1 - base)))
        if score >= LEAST_ODDS:
            odds[link] = score
    return odds, frozenset(x for x in share if x not in odds)


def extreme_value_fit(best: list[tuple[float, int]], least: float = LEAST_ODDS, tail: float = TAIL) -> tuple[float, float]:
    """Location and scale, per place, of the law of best scores in clean texts, by censored likelihood.

    ``best`` has the best score (0 for none) and the number of places of each text. A text without a segment
    only says that its best is below ``least``, the lowest score of a sign. The highest ``tail`` of the others only
    say that they lie above the rest, so that a few texts with a wrong label do not stretch the law. For each
    scale the likelihood has one best location, found by halving; scales are tried on a grid of 4 %.
    Fewer than ten texts with a segment give location 0 and scale 1.
    """
    score = np.array([s for s, n in best if n > 0], float)
    log_n = np.log(np.array([n for _, n in best if n > 0], float))
    if (score > 0).sum() < 10:
        return 0.0, 1.0
    top = float(np.quantile(score[score > 0], 1 - tail))
    low, high = score <= 0, score > top
    seen = ~(low | high)
    at = np.where(low, least, np.minimum(score, top))

    def fit(scale: float) -> tuple[float, float]:
        u = log_n - at / scale
        a, b = -u.max() - 40.0, -u.min() + 40.0
        for _ in range(60):
            mid = (a + b) / 2
            e = np.exp(np.minimum(mid + u, 700.0))
            slope = seen.sum() - e[~high].sum() + (e[high] / np.expm1(np.maximum(e[high], 1e-12))).sum()
            a, b = (mid, b) if slope > 0 else (a, mid)
        e = np.exp(np.minimum(a + u, 700.0))
        value = (a + u[seen] - np.log(scale)).sum() - e[~high].sum()
        return value + np.log(np.maximum(-np.expm1(-e[high]), 1e-300)).sum(), a * scale

    scales = np.geomspace(0.1, 20, 136)
    fits = [fit(x) for x in scales]
    i = int(np.argmax([value for value, _ in fits]))
    return fits[i][1], float(scales[i])


def _best_segments(sample: DataFrame, model: ToxicityModel) -> DataFrame:
    def make():
        scores = Scores(model)

        def found(texts):
            all_of = [_segments(t, scores) for t in texts]
            return [[max((x[2] for x in s), default=0.0) for s, _, _ in all_of], [n for _, n, _ in all_of]]

        return found

    fields = [StructField("best", DoubleType(), False), StructField("n", IntegerType(), False)]
    return add_from_text(sample, "text", ["doc_id"], fields, make)


def _with_summary(sample: DataFrame, model: ToxicityModel) -> DataFrame:
    def make():
        scores = Scores(model)

        def found(texts):
            rows = []
            for t in texts:
                segments, n, _ = _segments(t, scores)
                rows.append(summary([significance(x, n, model) for *_, x in segments]))
            return list(zip(*rows)) or [[], []]

        return found

    fields = [StructField(c, DoubleType(), False) for c in ("top", "rest")]
    return add_from_text(sample, "text", ["doc_id", "label"], fields, make)


PASSAGES = ArrayType(
    StructType(
        [
            StructField("start", IntegerType()),
            StructField("end", IntegerType()),
            StructField("score", DoubleType()),
            StructField("significance", DoubleType()),
        ]
    )
)


def toxicity_scores(docs: DataFrame, model: ToxicityModel, keep: list[str], text_col: str = "text") -> DataFrame:
    """``keep``, ``score`` and ``passages`` for every row of ``docs``.

    ``score`` is the probability that a rater calls the text toxic; ``passages`` has
    every segment ``(start, end, score, significance)`` of a significance of ``SIGNIFICANT`` or more, in code
    points of the text as it is. Whole texts are scanned. A null or empty text has no passage and the score of a text without any. Repeated rows each
    get a row; other columns are not read. Without labelled rows every score is 0.5.
    """

    def make():
        scores = Scores(model)

        def found(texts):
            rows, passages = [], []
            for t in texts:
                segments, n, words = _segments(t, scores)
                each = [significance(x, n, model) for *_, x in segments]
                rows.append(summary(each))
                passages.append(
                    [
                        {"start": words[a].start(), "end": words[b - 1].end(), "score": x, "significance": sure}
                        for (a, b, x), sure in zip(segments, each)
                        if sure >= SIGNIFICANT
                    ]
                )
            return [probabilities(np.array(rows).reshape(-1, 2), model.weights), passages]

        return found

    return add_from_text(
        docs, text_col, keep, [StructField("score", DoubleType(), False), StructField("passages", PASSAGES, False)], make
    )


def toxicity_query(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """``(doc_id, held_out, score, predicted, n_passages)`` of every document."""
    scored = toxicity_scores(docs, fit_toxicity(docs, labels), ["doc_id"])
    return scored.select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
        F.size("passages").alias("n_passages"),
    )
