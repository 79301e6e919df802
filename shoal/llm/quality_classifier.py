"""Quality by compression: zstandard dictionaries of good and of bad text.

A text that is more like good text takes fewer bytes with the good dictionary than with the bad
one. The difference, divided by the smaller of both sizes, together with how far
the text compresses at all and how long it is, becomes a probability by a logistic fit on labelled texts
that neither dictionary has seen. Where the curve bends is learned from those texts too.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField

from shoal.llm.common import add_from_text
from shoal.llm.logistic import fit_logistic, probabilities
from shoal.llm.training import held_out, labelled_sample

# Bounds of the fit: labelled documents of each class, pieces of each class per dictionary, bytes of a piece.
PER_CLASS = 3000
DICT_PIECES = 3000
PIECE_BYTES = 2048
DICT_BYTES = 112_640
LEVEL = 3
# Where the curves of the difference and of the ratio bend: quantiles of the calibration texts.
GAP_KNOTS = (0.1, 0.3, 0.7, 0.9)
LOW_KNOTS = (0.02, 0.1)
HIGH_KNOTS = (0.9, 0.98)
THRESHOLD = 0.3


def pieces_of(text: str | None) -> list[bytes]:
    """The whole text in pieces of ``PIECE_BYTES``, so that a dictionary counts alike in texts of any length."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return [raw[i : i + PIECE_BYTES] for i in range(0, len(raw), PIECE_BYTES)]


@dataclass
class QualityModel:
    good: bytes
    bad: bytes
    gaps: np.ndarray
    lows: np.ndarray
    highs: np.ndarray
    weights: np.ndarray

    def compressors(self) -> list:
        """With the good dictionary, the bad one, and none."""
        made = []
        for d in (self.good, self.bad, b""):
            held = zstandard.ZstdCompressionDict(d) if d else None
            if held is not None:
                held.precompute_compress(level=LEVEL)
            made.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=held, write_content_size=False, write_checksum=False))
        return made

    def features(self, measures: np.ndarray) -> np.ndarray:
        """Straight pieces of the difference and the ratio between their knots, and the length; zeros for a text without bytes.

        Past its last knot a difference counts by its logarithm, so one passage that a dictionary holds cannot outweigh a text.
        """
        gap, ratio, length = measures.T
        scale = max(float(np.abs(self.gaps).max(initial=0)), 1e-3)
        bent = np.sign(gap) * np.log1p(np.abs(gap) / scale)
        knots = np.sign(self.gaps) * np.log1p(np.abs(self.gaps) / scale)
        columns = [bent, bent * length, length, np.minimum(ratio, 1.0)]
        columns += [np.maximum(0.0, bent - k) for k in knots]
        columns += [np.maximum(0.0, k - ratio) * 10 for k in self.lows] + [np.maximum(0.0, ratio - k) * 10 for k in self.highs]
        return np.stack(columns, 1) * (length > 0)[:, None]

    def scores(self, texts: list[str | None], compressors: list) -> np.ndarray:
        return probabilities(self.features(measures_of(texts, compressors)), self.weights)


def measures_of(texts: list[str | None], compressors: list) -> np.ndarray:
    """The normalised size difference, the plain ratio and the log of the bytes of each text; zeros for a text without bytes."""
    out = np.zeros((len(texts), 3))
    for row, text in enumerate(texts):
        pieces = pieces_of(text)
        if not pieces:
            continue
        good, bad, plain = (sum(len(c.compress(p)) for p in pieces) for c in compressors)
        size = sum(map(len, pieces))
        out[row] = ((bad - good) / min(bad, good), min(plain / size, 2.0), np.log1p(size))
    return out


def _dictionary(pieces: list[bytes]) -> bytes:
    """A trained dictionary, or the pieces themselves where there are too few to train on."""
    try:
        return zstandard.train_dictionary(DICT_BYTES, pieces).as_bytes() if pieces else b""
    except zstandard.ZstdError:
        return b"".join(pieces)[:DICT_BYTES]


def fit_quality(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> QualityModel:
    """Learns from at most ``per_class`` labelled documents of each class outside the held-out fold.

    Folds 2 to 4 give the dictionaries, of which at most ``DICT_PIECES`` pieces per class
    reach the driver; fold 1 gives one row of measures per document for the knots and the weights.
    """
    sample = labelled_sample(docs, labels, "quality", per_class).persist()
    made = F.udf(lambda t: pieces_of(t), "array<binary>")
    cut = sample.where("fold > 1").select("label", "doc_id", F.posexplode(made("text")).alias("at", "piece"))
    order = [F.xxhash64("doc_id", "at"), F.col("doc_id"), F.col("at")]
    few = [cut.where(F.col("label") == k).orderBy(*order).limit(DICT_PIECES) for k in (0, 1)]
    bad, good = ([bytes(r.piece) for r in x.select("piece").collect()] for x in few)
    none = np.zeros(0)
    model = QualityModel(_dictionary(good), _dictionary(bad), none, none, none, none)
    rows = _with_measures(sample.where("fold = 1"), model).orderBy("doc_id").collect()
    sample.unpersist()
    measures = np.array([r.measures for r in rows]).reshape(-1, 3)
    if len(rows):
        model.gaps = np.quantile(measures[:, 0], GAP_KNOTS)
        model.lows, model.highs = np.quantile(measures[:, 1], LOW_KNOTS), np.quantile(measures[:, 1], HIGH_KNOTS)
    # A normal prior of variance one on every weight: few texts cannot bend the curve much, many can.
    labels_of = np.array([r.label for r in rows], dtype=float)
    model.weights = fit_logistic(model.features(measures), labels_of, ridge=1.0 / max(len(rows), 1))
    return model


def _with_measures(sample: DataFrame, model: QualityModel) -> DataFrame:
    def make():
        compressors = model.compressors()
        return lambda texts: [measures_of(texts, compressors).tolist()]

    fields = [StructField("measures", ArrayType(DoubleType(), False), False)]
    return add_from_text(sample, "text", ["doc_id", "label"], fields, make)


def quality_scores(docs: DataFrame, model: QualityModel, keep: list[str], text_col: str = "text") -> DataFrame:
    """``keep`` and ``score`` for every row of ``docs``: the probability that a rater calls it good.

    Whole texts are compressed, in pieces. A null or empty text has features of zero and so
    the same score as any other. Repeated rows each get a row; other columns are not read. Without
    labelled rows every score is 0.5; with one class only, scores are that class's smoothed rate.
    """

    def make():
        compressors = model.compressors()

        return lambda texts: [model.scores(texts, compressors)]

    return add_from_text(docs, text_col, keep, [StructField("score", DoubleType(), False)], make)


def accepted(docs: DataFrame, model: QualityModel, threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, whose score reaches ``threshold``.

    Null and empty texts have a score like any other, so all of them stay or all go; whole texts are read; repeated rows
    stay or go together; an empty table gives an empty one.
    """

    @F.pandas_udf("boolean")
    def good(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        compressors = model.compressors()
        for texts in batches:
            yield pd.Series(model.scores(list(texts), compressors) >= threshold)

    return docs.where(good(F.col(f"`{text_col}`")))


def quality_query(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` of every document."""
    scored = quality_scores(docs, fit_quality(docs, labels), ["doc_id"])
    return scored.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted")
    )
