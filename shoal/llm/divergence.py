"""Divergence of the sources of a language over a vocabulary held in minimal acyclic transducers.

The first pass counts documents per language and term. The kept terms, sorted, become transducers: tasks build
one block each, and the sum along a path plus the block's first ordinal is the term's place among all kept terms.
The second pass streams every text through the blocks and recounts. Ordinals stand for terms from there on, also
where ties are broken. Probabilities and differences are whole numbers, so every sum is exact.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shoal.llm.common import written
from shoal.llm.prefix import ordered_pieces, running_totals
from shoal.llm.transducer import Transducer

LEAST_DOCS = 10
TOP_TERMS = 10
SCALE = 1_000_000_000
# Terms of one transducer, at most some 60 MB; a larger vocabulary is several, and as many passes over the texts.
BLOCK_TERMS = 1_000_000
# Words that a task counts before it hands them on.
HELD = 400_000
# Cells of the sources x terms table in which pairs of sources are compared.
PAIR_CELLS = 4_000_000
PAIR_TERMS = 4096
# Every ASCII character that is no letter ends a word; letters A-Z are lower-cased.
_ENDS = bytes(c for c in range(128) if not chr(c).isalpha())
_TO_BLANK = bytes.maketrans(_ENDS + b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b" " * len(_ENDS) + b"abcdefghijklmnopqrstuvwxyz")


def terms_of(text: str | None) -> list[bytes]:
    """Matches of ``[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+`` with A-Z lower-cased, as UTF-8 bytes."""
    return [] if not text else text.encode("utf-8", "surrogatepass").translate(_TO_BLANK).split()


def _key(lang: str) -> bytes:
    """What stands before the terms of a language in the transducers.

    No term has a byte below a letter, so those of one language are neighbours, whatever its name holds.
    """
    return lang.encode("utf-8", "surrogatepass").replace(b"\0", b"\0\1") + b"\0"


def _document_counts(texts: DataFrame) -> DataFrame:
    """``(lang, key, docs)``: documents of the language that have the term, in partial sums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Counter] = defaultdict(Counter)

        def rows() -> Iterator[pa.RecordBatch]:
            for lang, found in held.items():
                key = _key(lang)
                arrays = [pa.array([lang] * len(found), pa.string()), pa.array([key + w for w in found], pa.binary()), pa.array(list(found.values()), pa.int64())]
                yield pa.RecordBatch.from_arrays(arrays, names=["lang", "key", "docs"])
            held.clear()

        size = 0
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                own = held[lang]
                size -= len(own)
                own.update(set(terms_of(text)))
                size += len(own)
                if size >= HELD:
                    yield from rows()
                    size = 0
        yield from rows()

    return texts.mapInArrow(run, "lang string, key binary, docs long")


def vocabulary(texts: DataFrame, least: int = LEAST_DOCS, block_terms: int = BLOCK_TERMS) -> tuple[DataFrame, DataFrame]:
    """Kept terms ``(lang, key, ordinal)`` and their transducers ``(block, first, data)``.

    Ordinals are gapless from 0 in the order of ``key``: language, zero byte, term.
    """
    kept = _document_counts(texts).groupBy("lang", "key").agg(F.sum("docs").alias("docs"))
    kept = written(kept.where(F.col("docs") >= least).select("lang", "key"), "kept-terms")
    pieces = max(1, -(-kept.count() // block_terms))
    ranged = ordered_pieces(kept, [F.col("key")], pieces)
    numbered, _ = running_totals(ranged, [F.col("key")], {"ordinal": F.lit(1)})
    terms = written(numbered.select("lang", "key", F.col("ordinal").cast("long").alias("ordinal")), "vocabulary")

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def block(first: int, keys: list[bytes]) -> pa.RecordBatch:
            arrays = [pa.array([first], pa.int64()), pa.array([Transducer.build(keys).to_bytes()], pa.binary())]
            return pa.RecordBatch.from_arrays(arrays, names=["first", "data"])

        first, keys = 0, []
        for batch in batches:
            for key, ordinal in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if not keys:
                    first = ordinal
                keys.append(key)
                if len(keys) == block_terms:
                    yield block(first, keys)
                    keys = []
        if keys:
            yield block(first, keys)

    # Ranges of ordinals are whole blocks, so each task builds its own.
    dealt = terms.select("key", "ordinal", F.floor(F.col("ordinal") / block_terms).alias("block"))
    dealt = dealt.repartition("block").sortWithinPartitions("ordinal").select("key", "ordinal")
    blocks = written(dealt.mapInArrow(build, "first long, data binary"), "transducers")
    return terms, blocks


def recount(texts: DataFrame, blocks: DataFrame) -> DataFrame:
    """``(lang, source, ordinal, n)``: occurrences of the kept terms, by streaming all texts through the blocks.

    One block at a time is broadcast (at most ``BLOCK_TERMS`` terms) and taken back after its pass.
    """
    spark = texts.sparkSession
    parts = []
    for row in blocks.orderBy("first").toLocalIterator():
        shared = spark.sparkContext.broadcast(bytes(row.data))
        counted = _counted(texts, shared, row.first).groupBy("lang", "source", "ordinal").agg(F.sum("n").alias("n"))
        parts.append(written(counted, "recount"))
        shared.unpersist()
    out = parts[0] if parts else spark.createDataFrame([], "lang string, source string, ordinal long, n long")
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _counted(texts: DataFrame, shared, first: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = Transducer.from_bytes(shared.value)
        held: dict[tuple, Counter] = defaultdict(Counter)

        def rows() -> Iterator[pa.RecordBatch]:
            words: dict[str, set] = defaultdict(set)
            for (lang, _), found in held.items():
                words[lang].update(found)
            place = {}
            for lang, those in words.items():
                begin = automaton.after(_key(lang))
                if begin is not None:
                    those = list(those)
                    place[lang] = {w: o for w, o in zip(those, automaton.ordinals(those, begin).tolist()) if o >= 0}
            for (lang, source), found in held.items():
                get = place.get(lang, {}).get
                pairs = [(o, n) for o, n in ((get(w), n) for w, n in found.items()) if o is not None]
                if pairs:
                    at, n = map(np.array, zip(*pairs))
                    names = [pa.array([x] * len(pairs), pa.string()) for x in (lang, source)]
                    yield pa.RecordBatch.from_arrays([*names, pa.array(at + first), pa.array(n)], names=["lang", "source", "ordinal", "n"])
            held.clear()

        size = 0
        for batch in batches:
            for lang, source, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
                own = held[lang, source]
                size -= len(own)
                own.update(terms_of(text))
                size += len(own)
                if size >= HELD:
                    yield from rows()
                    size = 0
        yield from rows()

    return texts.mapInArrow(run, "lang string, source string, ordinal long, n long")


def _share(n: Column, total: Column, v: Column) -> Column:
    """``1 + floor(SCALE * (n + 2) / (total + 2 * v))`` in whole numbers of up to 38 digits."""
    wide = lambda c: c.cast("decimal(28,0)")
    top = (wide(n) + 2) * F.lit(SCALE).cast("decimal(10,0)")
    return 1 + F.floor(F.call_function("div", top, wide(total) + 2 * wide(v))).cast("long")


def _pairs(shares: DataFrame, groups: DataFrame) -> DataFrame:
    """``(lang, a, b, value)`` with ``a < b``: the sum of the differences over all kept terms.

    The terms of a language are cut into blocks; a block is a table of sources x terms of at most ``PAIR_CELLS``
    cells, in which every pair of rows gives one partial sum.
    """
    last = F.greatest(F.floor((F.col("v") - 1) / F.col("width")), F.lit(0)).cast("int")
    marks = groups.select("lang", F.explode(F.sequence(F.lit(0), last)).alias("block"), "source", "p0")
    marks = marks.withColumn("place", F.lit(None).cast("long"))
    rows = shares.select("lang", F.floor(F.col("place") / F.col("width")).cast("int").alias("block"), "source", F.col("p").alias("p0"), "place")

    def compare(block: pa.Table) -> pa.Table:
        at = {n: block.column(n).to_pylist() for n in ("source", "p0", "place")}
        every = sorted((s.encode("utf-8", "surrogatepass"), s, p) for s, p, t in zip(*at.values()) if t is None)
        found = [(s, p, t) for s, p, t in zip(*at.values()) if t is not None]
        names = [s for _, s, _ in every]
        index = {s: i for i, s in enumerate(names)}
        where, column = np.unique(np.array([t for _, _, t in found], np.int64), return_inverse=True)
        table = np.repeat(np.array([p for _, _, p in every], np.int64)[:, None], len(where), axis=1)
        table[[index[s] for s, _, _ in found], column] = [p for _, p, _ in found]
        a, b, value = [], [], [np.empty(0, np.int64)]
        for i in range(len(names) - 1):
            rest = table[i + 1 :]
            value.append(((rest - table[i]) ** 2 // (rest + table[i])).sum(axis=1))
            a += [names[i]] * len(rest)
            b += names[i + 1 :]
        lang = block.column("lang")[0].as_py()
        arrays = [pa.array([lang] * len(a), pa.string()), pa.array(a, pa.string()), pa.array(b, pa.string()), pa.array(np.concatenate(value))]
        return pa.Table.from_arrays(arrays, names=["lang", "a", "b", "value"])

    blocks = marks.unionByName(rows).groupBy("lang", "block")
    return blocks.applyInArrow(compare, "lang string, a string, b string, value long").groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))


def source_divergence(
    docs: DataFrame,
    lang_col: str = "lang",
    source_col: str = "source",
    text_col: str = "text",
    least: int = LEAST_DOCS,
    block_terms: int = BLOCK_TERMS,
) -> DataFrame:
    """``(lang, source, part, item, value, rank)``: how the sources of a language differ.

    A language keeps the terms that at least ``least`` of its documents have (V of them). A group (language and
    source) with N occurrences of them gives a term with n occurrences ``p = 1 + floor(1e9 * (n + 2) / (N + 2 V))``,
    a language likewise; the difference of p and q is ``floor((p - q)^2 / (p + q))``. Part ``pair``: every other
    source of the language, with the sum over all kept terms (0 if there are none). Part ``term``: the first ten
    terms that the group has and that are likelier there than in the language. Ranks go by value, descending, then by
    item in UTF-8 order.

    A null text, language or source is an empty string; an empty text is a document without terms, and its group
    still occurs. Repeated rows are documents of their own. An empty table has no rows. Other columns are not
    read. A language or source with a third of all rows is counted in the tasks first; the whole texts are
    read twice or, with more than ``block_terms`` kept terms, once for each block of them more.
    """
    text = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))
    texts = docs.select(text(lang_col).alias("lang"), text(source_col).alias("source"), text(text_col).alias("text"))
    terms, blocks = vocabulary(texts, least, block_terms)
    counts = written(recount(texts, blocks), "counts")
    langs = terms.groupBy("lang").agg(F.count("*").alias("v"), F.min("ordinal").alias("first"))
    groups = texts.select("lang", "source").distinct()
    sources = groups.groupBy("lang").agg(F.count("*").alias("sources"))
    sums = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long"))
    groups = groups.join(sources, "lang").join(langs, "lang", "left").join(sums, ["lang", "source"], "left")
    groups = groups.select("lang", "source", "sources", zero("v").alias("v"), "first", zero("total").alias("total"))
    groups = groups.withColumn("lang_total", F.sum("total").over(Window.partitionBy("lang")))
    unseen = F.when(F.col("v") > 0, _share(F.lit(0), F.col("total"), F.col("v"))).otherwise(F.lit(0).cast("long"))
    width = F.least(F.greatest(F.floor(F.lit(PAIR_CELLS) / F.col("sources")), F.lit(1)), F.lit(PAIR_TERMS))
    # One row per group.
    groups = written(groups.withColumn("p0", unseen).withColumn("width", width), "groups")
    shares = counts.join(groups, ["lang", "source"]).select(
        "lang", "source", "ordinal", "n", "v", "lang_total", "width", _share(F.col("n"), F.col("total"), F.col("v")).alias("p"),
        (F.col("ordinal") - F.col("first")).alias("place"),
    )
    pairs = written(_pairs(shares, groups), "pairs")
    both = pairs.select("lang", F.col("a").alias("source"), F.col("b").alias("item"), "value").unionByName(
        pairs.select("lang", F.col("b").alias("source"), F.col("a").alias("item"), "value")
    )
    by_value = [F.col("value").desc(), F.col("item")]
    ranked = both.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(*by_value)))
    ranked = ranked.select("lang", "source", F.lit("pair").alias("part"), "item", "value", "rank")
    # At most one row per source of the language.
    of_term = Window.partitionBy("lang", "ordinal")
    likelier = shares.withColumn("q", _share(F.sum("n").over(of_term), F.col("lang_total"), F.col("v"))).where("p > q")
    p, q = F.col("p"), F.col("q")
    value = F.call_function("div", (p - q) * (p - q), p + q)
    best = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), F.col("ordinal"))
    top = likelier.select("lang", "source", "ordinal", value.alias("value")).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= TOP_TERMS)
    named = terms.select("ordinal", F.substring_index(F.decode("key", "UTF-8"), "\0", -1).alias("item"))
    top = top.join(named, "ordinal").select("lang", "source", F.lit("term").alias("part"), "item", "value", "rank")
    return ranked.unionByName(top)
