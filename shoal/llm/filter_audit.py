"""How five filters act on each other, per source and for every order in which they can be applied.

The document-term matrix gives words and distinct words of each document; the other conditions are facts of its
text. A document's failures are a set of five bits, so all orders follow from the counts of the 32 sets per part.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField

from shoal.llm.common import text_key, written
from shoal.llm.term_matrix import row_measures, term_matrix

FILTERS = "ABCDE"
ORDERS = ["".join(p) for p in permutations(FILTERS)]


def _bits(letters: str) -> int:
    return sum(1 << FILTERS.index(f) for f in letters)


# Every step of every order: its own filter and those before it, as bits.
STEPS = [(o, k + 1, _bits(o[k]), _bits(o[:k])) for o in ORDERS for k in range(len(FILTERS))]


_UPPER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_MARKS = b"#$%&*|"


def _shape(text: str, data: bytes) -> tuple[bool, bool]:
    """Whether the text fails C and D."""
    upper = len(data) - len(data.translate(None, _UPPER))
    return 100 * upper > 2 * len(text), len(data.translate(None, _MARKS)) < len(data)


def failures(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """``(doc_id, part, fails)`` of every row of ``docs``; ``fails`` has a bit for each of the filters A to E.

    A: under 200 words. B: 100 * distinct words < 50 * words. C: 100 * ``[A-Z]`` characters > 2 * code points.
    D: holds any of ``#$%&*|``. E: identical to the text of any smaller id, table-wide. ``part`` is the
    source, an empty string for null.

    A null text is an empty one: it fails A, not B to D, and E if a smaller id is empty or null too. Rows with
    a null id never fail E, and rows that repeat an id are not smaller than each other. Copies meet as
    partial minima; the minimum of a text is joined back by 128 bits of it. Other columns are not read.
    """
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    keyed = docs.select(
        F.col(f"`{id_col}`").alias("doc_id"),
        F.coalesce(F.col(f"`{source_col}`").cast("string"), F.lit("")).alias("part"),
        text_key(text).alias("key"),
        text.alias("text"),
    )
    fields = [StructField("c", BooleanType(), False), StructField("d", BooleanType(), False)]
    matrix, _ = term_matrix(keyed, ["doc_id", "part", "key"], fields=fields, facts=_shape)
    rows = written(row_measures(matrix), "term-rows")
    rows = rows.select("doc_id", "part", "c", "d", "n_words", "n_distinct", "key.k1", "key.k2")
    # Only texts that several rows have can fail E. Written, so that the join can split the rows of a hot text.
    least = rows.groupBy("k1", "k2").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most"))
    least = written(least.where(F.col("least") < F.col("most")).select("k1", "k2", "least"), "copies")
    rows = rows.join(least, ["k1", "k2"], "left")
    conditions = [
        F.col("n_words") < 200,
        100 * F.col("n_distinct") < 50 * F.col("n_words"),
        F.col("c"),
        F.col("d"),
        F.coalesce(F.col("doc_id") > F.col("least"), F.lit(False)),
    ]
    fails = sum((c.cast("int") * (1 << k) for k, c in enumerate(conditions)), F.lit(0))
    return rows.select("doc_id", "part", fails.alias("fails"))


def filter_audit(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text"
) -> DataFrame:
    """One row per part, order of the filters and step, with the document counts of that step.

    ``kept`` after this step; ``removed`` here; ``redundant``: fails this filter but went before;
    ``unique_fails``: fails only this filter; ``good_lost`` and ``toxic_lost``: removed here with
    ``quality = 1`` or ``toxic = 1`` in ``labels``; ``shapley``: what this filter removes, summed over all 120 orders.

    An id that is labelled more than once counts as labelled 1 if any row says so; null labels and ids
    say nothing. An empty table has no parts. A part with a third of all rows is 32 partial sums in each task.
    """
    said = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("doc_id"))
    said = said.agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("bad"))
    rows = failures(docs, id_col, source_col, text_col).join(said, "doc_id", "left")
    sets = rows.groupBy("part", "fails").agg(
        F.count("*").alias("n"),
        F.sum(F.coalesce("good", F.lit(0))).alias("good"),
        F.sum(F.coalesce("bad", F.lit(0))).alias("bad"),
    )
    # At most 32 sets a part.
    parts = sets.groupBy("part").agg(F.collect_list(F.struct("fails", "n", "good", "bad")).alias("sets"))
    # One literal: 600 rows of them would slow every analysis of the plan down.
    every = F.split(F.lit(" ".join(f"{o}-{k}-{own}-{gone}" for o, k, own, gone in STEPS)), " ")
    steps = parts.select("part", "sets", F.explode(every).alias("s"))
    steps = steps.select("part", "sets", F.split("s", "-").alias("s"))
    numbers = [F.col("s")[i].cast("int").alias(n) for i, n in ((1, "step"), (2, "own"), (3, "gone"))]
    steps = steps.select("part", "sets", F.col("s")[0].alias("filter_order"), *numbers)
    own, gone = F.col("own"), F.col("gone")

    def count(holds, value: str = "n") -> Column:
        add = lambda total, s: total + F.when(holds(s["fails"]), s[value]).otherwise(F.lit(0))
        return F.aggregate("sets", F.lit(0).cast("long"), add)

    here = lambda x: (x.bitwiseAND(own) != 0) & (x.bitwiseAND(gone) == 0)
    counted = steps.select(
        "part",
        "filter_order",
        "step",
        "own",
        count(lambda x: x.bitwiseAND(own.bitwiseOR(gone)) == 0).alias("kept"),
        count(here).alias("removed"),
        count(lambda x: (x.bitwiseAND(own) != 0) & (x.bitwiseAND(gone) != 0)).alias("redundant"),
        count(lambda x: x == own).alias("unique_fails"),
        count(here, "good").alias("good_lost"),
        count(here, "bad").alias("toxic_lost"),
    )
    # 120 rows for each filter of a part.
    shapley = F.sum("removed").over(Window.partitionBy("part", "own"))
    return counted.withColumn("shapley", shapley).drop("own")
