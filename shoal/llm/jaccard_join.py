"""Exact Jaccard join of documents on word n-grams, by PartEnum signatures.

Equal texts are one class. Classes meet at shared signatures, where each is paired with the
smallest class of its signature, its leader; pairs are verified on their whole texts. Most groups
are then one component. Where a signature still joins several components, their members are
paired across components (in blocks, so that no group is gathered) and verified too, the likeliest pairs
first, until all pairs between different components have been tested. So no link is lost; pairs inside a component need no test.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

from shoal.llm.common import WordHashes, ascii_words, discard, release, shingle_set, signed, written
from shoal.llm.components import connected_components
from shoal.llm.partenum import Sketches, parity_sketch, signatures
from shoal.session import checked_broadcast, cut_lineage

SHINGLE = 5
P, Q = 4, 5  # similarity of 0.8
# A shingle in more than this share of the documents comes last in the order of signatures.
FREQUENT_SHARE = 0.002
FREQUENT_LEAST = 8
# Classes remembered by a task, so that copies are not signed again.
REMEMBERED = 500_000
# Members of a block when a signature's group is paired across components.
BLOCK = 2048
# Pairs between the same two components that a signature lists at first.
MOST = 4
# Partners of one leader in a piece (on average), and pieces at most.
PARTNERS = 64
PIECES = 256


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    return docs.select(
        F.col(f"`{id_col}`").alias("doc_id"), F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(17), text).alias("k2"), text.alias("text")
    )


def _measure(keyed: DataFrame) -> DataFrame:
    """Rows ``(doc_id, k1, k2, n, sketch)`` of documents, and ``(shingle, seen)`` of shingles frequent in a batch."""
    own = keyed.schema
    extra = [StructField("n", LongType()), StructField("sketch", BinaryType())]
    extra += [StructField(c, LongType()) for c in ("shingle", "seen")]
    schema = StructType([own["doc_id"], own["k1"], own["k2"], *extra])
    schema["k1"].nullable = schema["k2"].nullable = schema["doc_id"].nullable = True

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for batch in batches:
            keys, seen, sets, sizes, sketches = batch.column(1).to_pylist(), set(), [], [], []
            for key, text in zip(keys, batch.column(3).to_pylist()):
                found = shingle_set(ascii_words(text), known, SHINGLE)
                sizes.append(len(found))
                sketches.append(parity_sketch(found))
                if key not in seen:
                    seen.add(key)
                    sets.append(found)
            none = pa.nulls(batch.num_rows, pa.int64())
            names = schema.fieldNames()
            own_columns = [batch.column(0), batch.column(1), batch.column(2)]
            measures = [pa.array(sizes, pa.int64()), pa.array(sketches, pa.binary())]
            yield pa.RecordBatch.from_arrays([*own_columns, *measures, none, none], names=names)
            values, counts = np.unique(np.concatenate(sets), return_counts=True) if sets else (np.empty(0, np.uint64),) * 2
            often = counts >= max(4, FREQUENT_SHARE * batch.num_rows)
            if often.any():
                n = int(often.sum())
                blank = [pa.nulls(n, batch.column(i).type) for i in range(3)]
                found = [pa.array(signed(values[often])), pa.array(counts[often].astype(np.int64))]
                blank += [pa.nulls(n, pa.int64()), pa.nulls(n, pa.binary())]
                yield pa.RecordBatch.from_arrays([*blank, *found], names=names)

    return keyed.mapInArrow(run, schema)


def _frequent(measured: DataFrame, n_docs: int) -> np.ndarray:
    """Frequent shingles, sorted. There are at most (mean set size / ``FREQUENT_SHARE``) of them."""
    least = max(FREQUENT_LEAST, FREQUENT_SHARE * n_docs)
    counts = measured.where("seen IS NOT NULL").groupBy("shingle").agg(F.sum("seen").alias("n"))
    rows = counts.where(F.col("n") >= least).select("shingle").collect()
    return np.sort(np.array([r.shingle for r in rows], np.int64).view(np.uint64))


def _signed_rows(keyed: DataFrame, frequent) -> DataFrame:
    """``(sig, k1)``: the signatures of every class; a class may come once from each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, done = WordHashes(), set()
        often = frequent.value
        for batch in batches:
            sigs, keys = [], []
            for key, more, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if (key, more) in done:
                    continue
                if len(done) >= REMEMBERED:
                    done.clear()
                done.add((key, more))
                made = signatures(shingle_set(ascii_words(text), known, SHINGLE), often, P, Q)
                sigs.append(made)
                keys.append(np.full(len(made), key, np.int64))
            if sigs:
                yield pa.RecordBatch.from_arrays([pa.array(signed(np.concatenate(sigs))), pa.array(np.concatenate(keys))], names=["sig", "k1"])

    return keyed.select("k1", "k2", "text").mapInArrow(run, "sig long, k1 long")


def _collisions(signed_rows: DataFrame) -> DataFrame:
    """``(sig, k1, leader)`` of all classes that share a signature with a smaller one, the leader."""
    rows = Window.partitionBy("sig").orderBy("k1")
    leader = F.first("k1").over(rows.rowsBetween(Window.unboundedPreceding, 0))
    seen = signed_rows.select("sig", "k1", leader.alias("leader"), F.lag("k1").over(rows).alias("last"))
    return seen.where((F.col("leader") < F.col("k1")) & (F.col("last") < F.col("k1"))).select("sig", "k1", "leader")


def _may_be_similar(na, nb, differing):
    """Whether sets of these sizes that differ in at least so many elements can have the similarity."""
    return (na * Q >= nb * P) & (nb * Q >= na * P) & (differing * (Q + P) <= (Q - P) * (na + nb))


def _candidates(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """``(a, b)`` of ``k1`` as pairs of class ids whose sizes and sketches allow the similarity."""
    narrow = classes.select("k1", "cid", "n", "sketch")
    both = pairs.join(narrow.toDF("a", "ca", "na", "sa"), "a").join(narrow.toDF("b", "cb", "nb", "sb"), "b")
    # Sizes alone rule most pairs out before their sketches travel to Python.
    fits = (F.col("na") * Q >= F.col("nb") * P) & (F.col("nb") * Q >= F.col("na") * P)
    both = both.where((F.col("ca") != F.col("cb")) & fits).select("ca", "na", "sa", "cb", "nb", "sb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ca, na, cb, nb = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1, 3, 4))
            every = np.arange(batch.num_rows)
            differing = Sketches(batch.column(2).to_pylist()).differing(every, Sketches(batch.column(5).to_pylist()), every)
            fits = _may_be_similar(na, nb, differing)
            low, high = np.minimum(ca, cb)[fits], np.maximum(ca, cb)[fits]
            yield pa.RecordBatch.from_arrays([pa.array(low), pa.array(high)], names=["a", "b"])

    return both.mapInArrow(run, "a long, b long").distinct()


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two non-empty shingle sets have a Jaccard similarity of 0.8 or more."""
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return len(a) > 0 and len(b) > 0 and Q * shared >= P * (len(a) + len(b) - shared)


def _texts_of(pairs: DataFrame, classes: DataFrame, keyed: DataFrame) -> DataFrame:
    """``(cid, text)`` of the classes in ``pairs``, each once.

    Their keys are counted and, while they are few, broadcast, so that only the texts that are needed leave their
    place; beyond that the texts are joined on the key. Copies meet in the partial aggregation.
    """
    ids = pairs.select(F.col("a").alias("cid")).unionByName(pairs.select(F.col("b").alias("cid"))).distinct()
    ids = cut_lineage(classes.select("k1", "k2", "cid").join(ids, "cid", "left_semi"))
    found = keyed.select("k1", "k2", "text").join(checked_broadcast(ids, ids.count()), ["k1", "k2"])
    return written(found.select("cid", "text").dropDuplicates(["cid"]), "texts")


def _verified(pairs: DataFrame, classes: DataFrame, keyed: DataFrame) -> DataFrame:
    """The pairs ``(a, b)`` of class ids that are similar, tested on their whole texts.

    The partners of a class are dealt into as many pieces as they need, each with a copy of the class's text, so a
    leader of very many classes is spread over tasks; a task holds one set and reads the others as a stream. The texts
    go once the links are written.
    """
    texts = _texts_of(pairs, classes, keyed)
    needed = pairs.groupBy("a").agg(F.least(F.lit(PIECES), F.expr(f"(count(*) - 1) div {PARTNERS} + 1")).alias("pieces"))
    dealt = pairs.join(needed, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("pieces")).alias("piece"))
    partners = dealt.join(texts, F.col("b") == F.col("cid")).select("a", "piece", F.col("b").alias("b"), "text")
    own = dealt.select("a", "piece").distinct().join(texts, F.col("a") == F.col("cid"))
    own = own.select("a", "piece", F.lit(None).cast("long").alias("b"), "text")
    both = own.unionByName(partners).repartition("a", "piece").sortWithinPartitions("a", "piece", F.col("b").asc_nulls_first())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, mine = WordHashes(), np.empty(0, np.uint64)
        for batch in batches:
            left, right = [], []
            for a, b, text in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3))):
                found = shingle_set(ascii_words(text), known, SHINGLE)
                if b is None:
                    mine = found
                elif similar(mine, found):
                    left.append(a)
                    right.append(b)
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], names=["a", "b"])

    links = cut_lineage(both.mapInArrow(run, "a long, b long"))
    discard(texts)
    release(links.sparkSession)
    return links


def _across(collisions: DataFrame, classes: DataFrame, components: DataFrame, most: int) -> DataFrame:
    """``(a, b, left_out)``: pairs of class ids in different components that share a signature and may be similar.

    One link joins two components, so of the pairs between the same two only the ``most`` likeliest are listed, by
    their sketches; ``left_out`` says that there are more. Leaders have been tested against all of their group. A group is cut into blocks, and each
    pair of blocks is one piece of work of bounded size.
    """
    own = classes.select("k1", "cid").join(components.select(F.col("node").alias("cid"), "component"), "cid", "left")
    own = own.select("k1", "cid", F.coalesce("component", "cid").alias("component"))
    rows = collisions.select("sig", "k1").join(own, "k1").select("sig", "cid", "component")
    group = Window.partitionBy("sig")
    mixed = rows.select(
        "*", F.min("component").over(group).alias("low"), F.max("component").over(group).alias("high")
    ).where(F.col("low") < F.col("high"))
    ranked = mixed.select(
        "sig",
        "cid",
        "component",
        F.floor((F.row_number().over(group.orderBy("cid")) - 1) / BLOCK).alias("block"),
        F.floor((F.count("*").over(group) - 1) / BLOCK).alias("last"),
    )
    ranked = ranked.join(classes.select("cid", "n", "sketch"), "cid")
    dealt = ranked.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("last"))))
    dealt = dealt.select(
        "sig",
        F.least("block", "other").alias("i"),
        F.greatest("block", "other").alias("j"),
        "block",
        "cid",
        "n",
        "component",
        "sketch",
    )
    dealt = dealt.repartition("sig", "i", "j").sortWithinPartitions("sig", "i", "j")

    def crossed(group: list[list]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        *columns, sketches = zip(*group)
        block, cid, n, component = (np.concatenate(x) for x in columns)
        bits = Sketches(list(chain(*sketches)))
        first, second = np.flatnonzero(block == block.min()), np.flatnonzero(block == block.max())
        left, right, far = [], [], []
        for x in first:
            near = second[(component[second] != component[x]) & (cid[second] > cid[x])]
            near = near[_may_be_similar(n[near], n[x], 0)]
            differing = bits.differing(near, bits, np.full(len(near), x))
            fits = _may_be_similar(n[near], n[x], differing)
            left.append(np.full(int(fits.sum()), x))
            right.append(near[fits])
            far.append(differing[fits])
        left, right, far = np.concatenate(left), np.concatenate(right), np.concatenate(far)
        low = np.minimum(component[left], component[right])
        high = np.maximum(component[left], component[right])
        order = np.lexsort((cid[right], cid[left], far, high, low))
        fresh = np.ones(len(order), bool)
        fresh[1:] = (low[order][1:] != low[order][:-1]) | (high[order][1:] != high[order][:-1])
        starts = np.flatnonzero(fresh)
        place = np.arange(len(order)) - starts[np.cumsum(fresh) - 1] if len(order) else order
        taken = order[place < most]
        left_out = np.full(len(taken), bool((place >= most).any()))
        return cid[left[taken]], cid[right[taken]], left_out


    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, at = [], None

        def out():
            a, b, left_out = crossed(held)
            columns = [pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(left_out, pa.bool_())]
            return pa.RecordBatch.from_arrays(columns, names=["a", "b", "left_out"])

        for batch in batches:
            columns = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(7)]
            sketches = batch.column(7).to_pylist()
            keys = np.stack(columns[:3], 1)
            cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
            for start, end in zip([0, *cuts.tolist()], [*cuts.tolist(), len(keys)]):
                if start == end:
                    continue
                key = tuple(keys[start])
                if key != at and held:
                    yield out()
                    held = []
                at = key
                held.append([*(c[start:end] for c in columns[3:]), sketches[start:end]])
        if held:
            yield out()

    found = dealt.mapInArrow(run, "a long, b long, left_out boolean")
    return found.groupBy("a", "b").agg(F.max("left_out").alias("left_out"))


def similar_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Documents ``(doc_id, k1, k2, n)`` and classes of equal texts ``(k1, k2, cid, n, first_id, component, component_id)``.

    ``component`` is the smallest class id reachable by links, ``component_id`` the smallest document id.
    """
    spark = docs.sparkSession
    keyed = _keyed(docs, id_col, text_col)
    measured = cut_lineage(_measure(keyed))
    sketched = measured.where("seen IS NULL")
    rows = sketched.select("doc_id", "k1", "k2", "n")
    frequent = spark.sparkContext.broadcast(_frequent(measured, rows.count()))
    classes = sketched.groupBy("k1", "k2").agg(
        F.min("doc_id").alias("first_id"), F.min("n").alias("n"), F.first("sketch").alias("sketch")
    )
    classes = cut_lineage(classes.withColumn("cid", F.monotonically_increasing_id()))

    collisions = written(_collisions(_signed_rows(keyed, frequent)), "collisions")
    release(spark)
    pairs = cut_lineage(_candidates(collisions.select(F.col("leader").alias("a"), F.col("k1").alias("b")).distinct(), classes))
    links = _verified(pairs, classes, keyed)
    components = cut_lineage(connected_components(links))
    most = MOST
    while True:
        across = cut_lineage(_across(collisions, classes, components, most))
        fresh = cut_lineage(across.select("a", "b").join(pairs, ["a", "b"], "left_anti"))
        release(spark)
        if fresh.take(1):
            links = links.unionByName(_verified(fresh, classes, keyed))
            pairs = pairs.unionByName(fresh)
            components = cut_lineage(connected_components(links))
        if not across.where("left_out").take(1):
            break  # every pair between different components has been tested
        most *= 16
    firsts = components.join(classes.select(F.col("cid").alias("node"), "first_id"), "node")
    least = firsts.groupBy("component").agg(F.min("first_id").alias("least_id"))
    linked = components.join(least, "component").select(F.col("node").alias("cid"), "component", "least_id")
    out = classes.join(linked, "cid", "left").select(
        "k1",
        "k2",
        "cid",
        "n",
        "first_id",
        F.coalesce("component", "cid").alias("component"),
        F.coalesce("least_id", "first_id").alias("component_id"),
    )
    return rows, out


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_shingles, component_id)`` for every row of ``docs``.

    Two texts are linked when their sets of five-word shingles have a Jaccard similarity of 0.8 or more;
    ``component_id`` is the smallest id reachable by links, its own included. A text of one to
    four words is one shingle; a null or blank text has none and is linked with nothing, not
    even with other blank texts. Repeated rows are copies of each other. Null ids count as no id:
    they are never a smallest id. Other columns are not read. Texts and signatures are compared by
    64-bit hashes of shingles, texts are told apart by 128 bits.
    """
    rows, classes = similar_classes(docs, id_col, text_col)
    found = rows.join(classes.select("k1", "k2", "component_id"), ["k1", "k2"], "left")
    own = F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    return found.select("doc_id", F.col("n").alias("n_shingles"), own.alias("component_id"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs``, with all columns, less all but one row of every component; blank texts all stay.

    The row with the smallest id stays, of repeated rows any one.
    """
    _, classes = similar_classes(docs, id_col, text_col)
    order = Window.partitionBy("component").orderBy(F.col("first_id").asc_nulls_last(), "cid")
    kept = classes.where("n > 0").withColumn("_at", F.row_number().over(order)).where("_at = 1")
    kept = cut_lineage(kept.select("k1", "k2", F.col("first_id").alias("keep_id")))
    text = F.coalesce(F.col(f"row.`{text_col}`"), F.lit(""))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    words = F.regexp_like(text, F.lit(r"[^\x20\x09-\x0D]"))
    keyed = rows.where(words).select("row", F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(17), text).alias("k2"))
    same = (
        (keyed["k1"] == kept["k1"]) & (keyed["k2"] == kept["k2"]) & keyed[f"row.{id_col}"].eqNullSafe(kept["keep_id"])
    )
    stay = keyed.join(kept, same, "left_semi").dropDuplicates(["k1", "k2"]).select("row")
    return stay.unionByName(rows.where(~words)).select("row.*")
