"""Quality rules whose limits come from the corpus: quantile sketches per language and source.

Every document is measured once. Each measure goes into a mergeable sketch per ``(lang,
source)``: a histogram whose buckets keep six significant bits, so the counts of any
partitions, sources or days simply add up. The sketches give a median and an upper quartile, from which
each group gets its own limits; documents are then joined with the limits of their group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField

from shoal.llm.common import add_from_text
from shoal.session import cut_lineage

SYMBOLS = "#*$%&|<>"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
BLANKS = " \t\n\x0b\x0c\r"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper")
FEW_WORDS = 50
# A group of fewer documents takes the limits of its language, then those of all.
GROUP_ROWS = 200
# Each measure is a ratio in thousandths; the number is the least distance from the median that is
# held against a document.
MEASURES = {
    "symbols": ("n_symbols", "word_chars", 40),
    "upper": ("n_upper", "word_chars", 250),
    "repeats": ("n_repeat_words", "n_words", 450),
    "dup_lines": ("n_dup_lines", "n_lines", 600),
    "word_length": ("word_chars", "n_words", 6000),
}
# Interquartile half-widths above the upper quartile that are still usual.
SPREADS = 6


def text_counts(text: str | None) -> tuple[int, ...]:
    """The ``COUNTS`` of one whole text; a null text has none of anything."""
    if not text:
        return (0,) * len(COUNTS)
    words = text.encode("utf-8", "surrogatepass").split()  # bytes split at exactly these blanks
    lines = [line for line in text.split("\n") if line.strip(BLANKS)]
    windows = list(zip(words, words[1:], words[2:]))
    once: set = set(windows)
    repeated = 0
    if len(once) < len(windows):
        once, twice = set(), set()
        for w in windows:
            (twice if w in once else once).add(w)
        covered = 0
        for i, w in enumerate(windows):
            if w in twice:
                repeated += i + 3 - max(i, covered)
                covered = i + 3
    return (
        len(words),
        len(text) - sum(map(text.count, BLANKS)),
        sum(map(text.count, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated,
        len(lines),
        sum(map(text.count, UPPER)),
    )


def measured(docs: DataFrame, keep: list[str], text_col: str = "text") -> DataFrame:
    """``keep`` and the ``COUNTS`` of every row of ``docs``; whole texts are read once and not passed on."""
    fields = [StructField(c, LongType(), False) for c in COUNTS]
    return add_from_text(
        docs, text_col, keep, fields, lambda: lambda texts: list(zip(*map(text_counts, texts))) or [[] for _ in COUNTS]
    )


def ratio(measure: str) -> Column:
    part, whole, _ = MEASURES[measure]
    return F.when(F.col(whole) > 0, F.expr(f"1000 * {part} DIV {whole}")).otherwise(F.lit(0)).cast("long")


def bucket(value: Column) -> Column:
    """``value`` with all but its six highest bits cleared: the sketch's bucket, by its lower bound."""
    step = F.pow(F.lit(2.0), F.greatest(F.length(F.bin(value)) - 6, F.lit(0))).cast("long")
    return value - value % step


def sketch(counts: DataFrame) -> DataFrame:
    """``(lang, source, measure, bucket, n)``: sketches that merge by adding ``n``.

    A hot source is added up inside every task before anything is shuffled.
    """
    pairs = F.array(*[F.struct(F.lit(m).alias("measure"), bucket(ratio(m)).alias("bucket")) for m in MEASURES])
    rows = counts.where(F.col("n_words") > 0).select("lang", "source", F.explode(pairs).alias("x"))
    return rows.groupBy("lang", "source", "x.measure", "x.bucket").agg(F.count("*").alias("n"))


def merged(sketches: DataFrame, by: list[str]) -> DataFrame:
    """The sketches of coarser groups: ``by`` is a part of ``lang, source``."""
    return sketches.groupBy(*by, "measure", "bucket").agg(F.sum("n").alias("n"))


def limits(sketches: DataFrame, by: list[str]) -> DataFrame:
    """One row per group ``by`` with a map ``measure -> limit`` and the number of documents."""
    group = Window.partitionBy(*by, "measure")
    ranked = sketches.select(
        *by,
        "measure",
        "bucket",
        F.sum("n").over(group.orderBy("bucket")).alias("upto"),
        F.sum("n").over(group).alias("docs"),
    )
    at = lambda q: F.min(F.when(F.col("upto") * 4 >= F.col("docs") * q, F.col("bucket")))
    quartiles = ranked.groupBy(*by, "measure").agg(at(2).alias("q2"), at(3).alias("q3"), F.first("docs").alias("docs"))
    least = F.create_map(*[x for m, (_, _, s) in MEASURES.items() for x in (F.lit(m), F.lit(s))])
    limit = F.greatest(
        F.col("q3") + SPREADS * (F.col("q3") - F.col("q2")), F.col("q2") + F.element_at(least, F.col("measure"))
    )
    pairs = quartiles.select(*by, "docs", F.struct("measure", limit.alias("limit")).alias("pair"))
    return pairs.groupBy(*by).agg(
        F.map_from_entries(F.collect_list("pair")).alias("limits"), F.first("docs").alias("docs")
    )


def base_failed() -> Column:
    return (F.col("n_words") < FEW_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def judged(counts: DataFrame, sketches: DataFrame) -> DataFrame:
    """``counts`` with ``base_failed`` and ``kept``.

    A document is kept unless a base rule or a limit of its ``(lang, source)`` is against it.
    Groups that are too small take the limits of the merged sketch of their language, then of all.
    The limits are joined on the group without texts; a hot group is split by adaptive execution.
    """
    own = limits(sketches, ["lang", "source"]).where(F.col("docs") >= GROUP_ROWS)
    lang = limits(merged(sketches, ["lang"]), ["lang"]).where(F.col("docs") >= GROUP_ROWS)
    every = limits(merged(sketches, []), [])
    own = own.select(F.col("lang").alias("_l"), F.col("source").alias("_s"), F.col("limits").alias("_own"))
    lang = lang.select(F.col("lang").alias("_l2"), F.col("limits").alias("_lang"))
    rows = counts.join(own, F.col("lang").eqNullSafe(F.col("_l")) & F.col("source").eqNullSafe(F.col("_s")), "left")
    rows = rows.join(lang, F.col("lang").eqNullSafe(F.col("_l2")), "left")
    rows = rows.join(F.broadcast(every.select(F.col("limits").alias("_all"))), F.lit(True), "left")  # one row
    used = F.coalesce("_own", "_lang", "_all")
    high = F.lit(False)
    for m in MEASURES:
        high = high | F.coalesce(ratio(m) > F.element_at(used, F.lit(m)), F.lit(False))
    return rows.select(
        *[F.col(f"`{c}`") for c in counts.columns], base_failed().alias("base_failed"), (~base_failed() & ~high).alias("kept")
    )


def quality_verdicts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, lang, source, COUNTS..., base_failed, kept)`` for every row of ``docs``.

    A null or empty text has no words, fails and is not part of any sketch. Null languages
    and sources are groups of their own. Repeated rows each count and get a row. Other columns are
    not read. The counts (no texts) are written once, because the sketches and the
    filter both read them.
    """
    counts = cut_lineage(
        measured(docs, [id_col, "lang", "source"], text_col).withColumnRenamed(id_col, "doc_id")
    )
    return judged(counts, sketch(counts))
