"""Repeated passages by a sparse suffix array of the corpus.

Suffixes are kept only at minimisers: positions that the content selects, so that any two equal
passages keep suffixes at the same places, at least one in every ``GAP`` words. The kept suffixes of all
texts are sorted by a hash of their first ``DEPTH`` words, and neighbours are compared: where they are equal the
passage occurs again. These matches are extended to the left and the right: of the spans of
``least`` words around a matched suffix, those that occur again are found by the same sort and comparison of
neighbours. A word is repeated if it lies in such a span; touching spans make one passage. Places have one order (least
id of the texts that are equal, then the position), and a span stays at its lowest place.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shoal.llm.common import WordHashes, hash_words, mixed, rolling, with_wrapped_row, written
from shoal.session import cut_lineage

# Words of a passage that is reported.
LEAST = 50
# Every run of GAP words holds a minimiser of K-word hashes.
GAP, K = 30, 6
REMEMBERED = 500_000
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_words(text: str | None) -> list[bytes]:
    """Words between ASCII blanks, as they are."""
    return [] if not text else text.encode("utf-8", "surrogatepass").split()


def minimisers(hashes: np.ndarray, gap: int = GAP, k: int = K) -> np.ndarray:
    """For each run of ``gap`` words the position of its smallest ``k``-word hash, the rightmost of equals."""
    grams = rolling(hashes, k)
    width = gap - k + 1
    if len(grams) < width:
        return np.empty(0, np.int64)
    views = np.lib.stride_tricks.sliding_window_view(grams, width)
    # The rightmost minimum: search the reversed runs.
    return np.arange(len(views)) + width - 1 - np.argmin(views[:, ::-1], axis=1)


def _suffixes(keyed: DataFrame, least: int) -> DataFrame:
    """``(h, k1, k2, pos)``: hash of the first ``least - GAP + 1`` words of every kept suffix that is as long."""
    depth = least - GAP + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, done = WordHashes(), set()
        for batch in batches:
            h, keys, others, places = [], [], [], []
            for key, more, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if (key, more) in done:
                    continue
                if len(done) >= REMEMBERED:
                    done.clear()
                done.add((key, more))
                words = plain_words(text)
                if len(words) < least:
                    continue
                hashes = hash_words(words, known)
                at = np.unique(minimisers(hashes))
                heads = rolling(hashes, depth)
                at = at[at < len(heads)]
                h.append(heads[at].view(np.int64))
                keys.append(np.full(len(at), key, np.int64))
                others.append(np.full(len(at), more, np.int64))
                places.append(at.astype(np.int32))
            if h:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(x)) for x in (h, keys, others, places)], names=["h", "k1", "k2", "pos"]
                )

    return keyed.select("k1", "k2", "text").mapInArrow(run, "h long, k1 long, k2 long, pos int")


def _matched(rows: DataFrame, name: str) -> DataFrame:
    """``rows`` of which ``h`` occurs at another place, with ``first``: it is the lowest place of its ``h``.

    A place is all columns but ``h``. The lowest and the highest place of each ``h`` are partial before the shuffle, and
    the join back can be split, so a very common ``h`` is not one task's.
    """
    rows = written(rows, name)
    place = F.struct(*[c for c in rows.columns if c != "h"])
    again = rows.groupBy("h").agg(F.min(place).alias("low"), F.max(place).alias("high")).where("low <> high")
    near = rows.join(again.select("h", "low"), "h")
    return near.select(*rows.columns, (place == F.col("low")).alias("first"))


def _spans(texts: DataFrame, least: int) -> DataFrame:
    """``(h, cid, pos)`` of the spans of ``least`` words around matched suffixes.

    The runs of ``GAP`` words that begin in the first ``K`` places of a span select suffixes whose heads lie
    inside the span. If the span occurs again, so do they; spans with an unmatched one are not listed.
    """
    inner = K

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for batch in batches:
            h, keys, places = [], [], []
            for key, text, matched in zip(*(batch.column(i).to_pylist() for i in range(3))):
                hashes = hash_words(plain_words(text), known)
                spans = rolling(hashes, least)
                if not len(spans):
                    continue
                found = np.zeros(len(hashes), bool)
                found[np.array(matched, np.int64)] = True
                # Bad runs before each run; all runs s to s + inner - 1 must be good.
                bad = np.concatenate([[0], np.cumsum(~found[minimisers(hashes)])])
                start = np.arange(len(spans))
                take = np.flatnonzero(bad[start + inner] == bad[start])
                h.append(mixed(spans[take] + np.uint64(least)).view(np.int64))
                keys.append(np.full(len(take), key, np.int64))
                places.append(take.astype(np.int32))
            if h:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(x)) for x in (h, keys, places)], names=["h", "cid", "pos"]
                )

    return texts.select("cid", "text", "matched").mapInArrow(run, "h long, cid long, pos int")


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    return docs.select(
        F.col(f"`{id_col}`").alias("doc_id"), F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(17), text).alias("k2"), text.alias("text")
    )


def _of_texts(keyed: DataFrame, least: int) -> DataFrame:
    """``(k1, k2, start, end, whole_copy, first_id, cut)`` of the passages of every distinct text.

    ``cut`` has the word ranges of the passage that lie in spans with a lower place. For a text with copies the one row is
    the whole text, and ``cut`` holds for the copy with ``first_id``.
    """
    if least < GAP + K:
        raise ValueError(f"least must be at least {GAP + K}")
    words = F.regexp_count(F.col("text"), F.lit(WORD.pattern))
    sized = keyed.select("doc_id", "k1", "k2", words.alias("n"))
    classes = sized.groupBy("k1", "k2").agg(
        F.count("*").alias("copies"), F.min("doc_id").alias("first_id"), F.first("n").alias("n")
    )
    # Sorted first, so that class ids have the order of places.
    classes = classes.where(F.col("n") >= least).orderBy("first_id", "k1", "k2")
    classes = cut_lineage(classes.withColumn("cid", F.monotonically_increasing_id()))
    matched = _matched(_suffixes(keyed, least), "suffixes").groupBy("k1", "k2").agg(F.collect_set("pos").alias("matched"))
    matched = written(matched.join(classes.select("k1", "k2", "cid"), ["k1", "k2"]), "matched")
    texts = keyed.select("k1", "k2", "text").dropDuplicates(["k1", "k2"]).join(matched, ["k1", "k2"])
    spans = _matched(_spans(texts, least), "spans").select("cid", "pos", (~F.col("first")).alias("late"))
    by_place = Window.partitionBy("cid").orderBy("pos")
    before = by_place.rowsBetween(Window.unboundedPreceding, -1)
    late_at = F.when(F.col("late"), F.col("pos"))
    runs = spans.select(
        "*",
        F.coalesce(F.col("pos") - F.lag("pos").over(by_place) > least, F.lit(True)).cast("int").alias("fresh"),
        F.coalesce(late_at - F.max(late_at).over(before) > least, F.lit(True)).cast("int").alias("late_fresh"),
    )
    runs = runs.withColumn("run", F.sum("fresh").over(by_place))
    runs = runs.withColumn("piece", F.when(F.col("late"), F.sum(F.when(F.col("late"), F.col("late_fresh"))).over(by_place)))
    pieces = runs.groupBy("cid", "run", "piece").agg(F.min("pos").alias("start"), (F.max("pos") + least).alias("end"))
    late = F.when(F.col("piece").isNotNull(), F.struct("start", "end"))
    passages = pieces.groupBy("cid", "run").agg(
        F.min("start").alias("start"), F.max("end").alias("end"), F.sort_array(F.collect_list(late)).alias("cut")
    )
    passages = written(passages, "runs")
    single = passages.join(classes.where("copies = 1").select("cid", "k1", "k2", "first_id"), "cid").select(
        "k1", "k2", "start", "end", F.lit(False).alias("whole_copy"), "first_id", "cut"
    )
    of_class = passages.groupBy("cid").agg(F.flatten(F.collect_list("cut")).alias("cut"))
    copied = classes.where("copies > 1").join(of_class, "cid", "left").select(
        "k1", "k2", F.lit(0).alias("start"), F.col("n").alias("end"), F.lit(True).alias("whole_copy"), "first_id",
        F.coalesce("cut", F.expr("array()").cast(passages.schema["cut"].dataType)).alias("cut"),
    )
    return written(single.unionByName(copied), "passages")


def _cut_of(row_id: Column) -> Column:
    """The ranges to cut from a row: all of a later copy, else those of its text."""
    whole = F.array(F.struct("start", "end"))
    return F.when(F.col("whole_copy") & ~row_id.eqNullSafe(F.col("first_id")), whole).otherwise(F.col("cut"))


def repeated_passages(docs: DataFrame, least: int = LEAST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, start, end, n_words, whole_copy, is_first, cut)`` of every repeated passage of every document.

    A word is repeated when it lies in a run of ``least`` words that occurs again: at another
    place of the same text or in another document, a copy included. ``start`` and ``end``
    (exclusive) count words from 0. ``whole_copy`` says that the document has copies, and
    then its one passage is the whole text. Places are ordered by the least id of the equal texts, then the position.
    ``cut`` has the word ranges that lie in a run with a lower place, or all of a copy that is not the first; cutting them
    all leaves one place of every repeated word. ``is_first`` says that there are none.
    ``least`` is at least 36. Words are runs of characters other than ASCII blanks and compare as they are.

    A null text, or one of fewer than ``least`` words, has no passage. Repeated rows are copies of
    each other, and all rows with the least id are the first copy. Other columns are not read; an empty table gives no
    rows. Copies of a text are handled once and joined back.
    """
    keyed = _keyed(docs, id_col, text_col)
    found = _of_texts(keyed, least)
    out = keyed.select("doc_id", "k1", "k2").join(found, ["k1", "k2"]).withColumn("cut", _cut_of(F.col("doc_id")))
    return out.select(
        "doc_id",
        F.col("start").cast("long").alias("start"),
        F.col("end").cast("long").alias("end"),
        (F.col("end") - F.col("start")).cast("long").alias("n_words"),
        "whole_copy",
        (F.size("cut") == 0).alias("is_first"),
        "cut",
    )


def cut_words(text: str, ranges: list[tuple[int, int]]) -> str:
    """``text`` without the words of ``ranges``, sorted; what lies between a cut word and the next one goes with it."""
    if not ranges:
        return text
    words = list(WORD.finditer(text))
    kept, at = [], 0
    for start, end in ranges:
        kept.append(text[at : words[start].start()])
        at = words[end].start() if end < len(words) else len(text)
    return "".join(kept) + text[at:]


def without_repeats(docs: DataFrame, least: int = LEAST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with every ``cut`` of ``repeated_passages`` taken out of its text; the columns stay.

    Rows of which nothing is left (later copies, texts made of repeats) go. Rows without a cut, null and empty texts
    included, stay as they are; an empty table stays empty. Repeated rows with the least id of their text all stay.
    """
    found = _of_texts(_keyed(docs, id_col, text_col), least)
    by_text = found.groupBy("k1", "k2").agg(
        F.min("start").alias("start"), F.max("end").alias("end"), F.first("whole_copy").alias("whole_copy"),
        F.first("first_id").alias("first_id"), F.sort_array(F.flatten(F.collect_list("cut"))).alias("cut"),
    )

    @F.pandas_udf("string")
    def shortened(texts: pd.Series, ranges: pd.Series) -> pd.Series:
        return pd.Series([cut_words(t, [(r["start"], r["end"]) for r in cut]) for t, cut in zip(texts, ranges)], dtype=object)

    rows = with_wrapped_row(docs)
    own, text = F.col("row").getField(id_col), F.coalesce(F.col("row").getField(text_col), F.lit(""))
    rows = rows.withColumn("k1", F.xxhash64(text)).withColumn("k2", F.xxhash64(F.lit(17), text))
    rows = rows.join(by_text, ["k1", "k2"], "left").withColumn("cut", _cut_of(own))
    same = rows.where(F.coalesce(F.size("cut"), F.lit(0)) <= 0).select("row")
    less = rows.where(F.size("cut") > 0).withColumn("short", shortened(text, F.col("cut")))
    less = less.where(F.length(F.trim("short")) > 0).select(F.col("row").withField(f"`{text_col}`", F.col("short")).alias("row"))
    return same.unionByName(less).select("row.*")
