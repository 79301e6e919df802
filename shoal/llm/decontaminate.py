"""Benchmark decontamination with suffix arrays of the training shards.

Every task cuts its documents into shards and sorts the suffixes of each shard. Every suffix of the
test items is looked up by binary search: the range that shares its first words gives all
occurrences of a window, the neighbours of its place give its longest verbatim match in the shard. The
longest over all shards is a maximum per test suffix; its places are those of all shards that reach it. Words are
numbers in the vocabulary of the test items, a word that no item has ends every match, and a
training suffix is only kept where at least as many known words follow as the shortest window has.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import (
    ArrayType,
    IntegerType,
    LongType,
    StringType,
    StructField,
    StructType,
)

from shoal.llm.common import WordHashes, add_from_text, hash_words, mixed, signed, written

WINDOW = 10
# Words of one block of test items: what a task holds of the benchmark at a time.
BLOCK_WORDS = 1_000_000
# Characters of one training shard (at least one document).
SHARD_CHARS = 4_000_000
# Every ASCII character that is no digit or letter ends a word; letters A-Z are lower-cased.
_ENDS = bytes(c for c in range(128) if not chr(c).isalnum())
_TO_BLANK = bytes.maketrans(_ENDS + b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b" " * len(_ENDS) + b"abcdefghijklmnopqrstuvwxyz")


def item_words(text: str | None) -> list[bytes]:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the text with A-Z lower-cased."""
    return [] if not text else text.encode("utf-8", "surrogatepass").translate(_TO_BLANK).split()


FACTOR = 0x9E3779B97F4A7C15
_INVERSE = pow(FACTOR, -1, 2**64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


@dataclass
class TestItems:
    """One block of test items as numbers: words of item ``k`` are ``words[starts[k]:starts[k + 1] - 1]``, then 0."""

    ids: list[str | None]
    words: np.ndarray
    starts: np.ndarray
    vocabulary: dict[bytes, int]

    @property
    def floors(self) -> np.ndarray:
        """The length of each item's windows."""
        return np.minimum(WINDOW, np.diff(self.starts) - 1)

    @property
    def least(self) -> int:
        """The length of the shortest window."""
        return int(self.floors.min())

    @cached_property
    def _sums(self) -> tuple[np.ndarray, np.ndarray]:
        by_number = np.zeros(len(self.vocabulary) + 1, np.uint64)
        by_number[1:] = hash_words(list(self.vocabulary), WordHashes())
        weighted = by_number[self.words] * _powers(FACTOR, len(self.words))
        return np.concatenate([np.zeros(1, np.uint64), np.cumsum(weighted)]), _powers(_INVERSE, len(self.words))

    def span_keys(self, at: np.ndarray, length: np.ndarray) -> np.ndarray:
        """64 bits of the ``length`` words at each position: the same for equal words in any block."""
        sums, back = self._sums
        return signed(mixed((sums[at + length] - sums[at]) * back[at] + length.astype(np.uint64)))


def test_block(items: list[tuple[str | None, list[bytes]]]) -> TestItems:
    vocabulary: dict[bytes, int] = {}
    flat: list[int] = []
    starts = [0]
    for _, words in items:
        flat += [vocabulary.setdefault(w, len(vocabulary) + 1) for w in words]
        flat.append(0)
        starts.append(len(flat))
    return TestItems([i for i, _ in items], np.array(flat, np.int64), np.array(starts, np.int64), vocabulary)


def read_blocks(benchmark: DataFrame, block_words: int = BLOCK_WORDS) -> list:
    """The items in blocks of at most ``block_words`` words (an item at least), each broadcast by itself.

    The items come to the driver one partition at a time. Items without words are left out; repeated
    rows of an item are one item, different texts under one id are all searched. Items whose id is null
    are searched like the others.
    """
    sc = benchmark.sparkSession.sparkContext
    rows = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text")
    rows = rows.where(F.col("text").isNotNull()).distinct()
    blocks, held, size = [], [], 0
    for r in rows.orderBy("item_id", "text").toLocalIterator():
        words = item_words(r.text)
        if not words:
            continue
        if held and size + len(words) > block_words:
            blocks.append(sc.broadcast(test_block(held)))
            held, size = [], 0
        held.append((r.item_id, words))
        size += len(words)
    if held:
        blocks.append(sc.broadcast(test_block(held)))
    return blocks


class SuffixArray:
    """Sorted suffixes of a training shard beside all suffixes of the test items.

    ``ranks[j]`` numbers the first ``2**j`` words of every kept position (0 elsewhere), so
    two suffixes compare in a few steps however long their common part is.
    """

    def __init__(self, training: np.ndarray, test: TestItems):
        self.test, self.split = test, len(test.words)
        self.words = np.concatenate([test.words, training])
        # Known words that follow, this one included.
        stops = np.flatnonzero(self.words == 0)
        at = np.arange(len(self.words))
        run = stops[np.searchsorted(stops, at)] - at if len(stops) else np.zeros(0, np.int64)
        deep = int(np.diff(test.starts).max())
        self.kept = np.flatnonzero((run >= test.least) & (at >= self.split))
        self.run = run
        self.tests = np.flatnonzero(run[: self.split] > 0)
        # Positions that any comparison can reach: kept suffixes and all within their runs.
        reach = np.zeros(len(self.words) + 1, np.int64)
        np.add.at(reach, self.kept, 1)
        np.add.at(reach, self.kept + run[self.kept], -1)
        self.live = np.concatenate([self.tests, self.split + np.flatnonzero(np.cumsum(reach)[self.split : -1] > 0)])
        self.ranks = [self.words]
        width = 1
        while width < deep:
            last = self.ranks[-1]
            nxt = np.zeros_like(last)
            after = self.live + width
            tail = np.where(after < len(last), last[np.minimum(after, len(last) - 1)], 0)
            # The tail only counts where the first half is whole.
            tail = np.where(run[self.live] > width, tail, 0)
            key = last[self.live] * (int(last.max()) + 1 if len(last) else 1) + tail
            _, inverse = np.unique(key, return_inverse=True)
            nxt[self.live] = inverse + 1
            self.ranks.append(nxt)
            width *= 2

    def key(self, at: np.ndarray, length: int) -> np.ndarray:
        """A number that orders positions ``at`` by exactly their first ``length`` words."""
        out = np.zeros(len(at), np.int64)
        done = 0
        for j in range(length.bit_length() - 1, -1, -1):
            if length >> j & 1:
                place = np.minimum(at + done, len(self.words) - 1)
                raw = np.where(self.run[at] >= length, self.ranks[j][place], 0)
                _, out = np.unique(out * (int(raw.max(initial=0)) + 1) + raw, return_inverse=True)
                done += 1 << j
        return out

    def occurrences(self, tests: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where the first ``length`` words of the test suffixes occur: positions, the window at each, the window of each test.

        Windows are the distinct ones, by number; a training position holds one window at most, however many
        test suffixes begin with it. A test whose window does not occur has -1.
        """
        training = self.kept[self.run[self.kept] >= length]
        if not len(training) or not len(tests):
            return np.empty(0, np.int64), np.empty(0, np.int64), np.full(len(tests), -1)
        keys = self.key(np.concatenate([training, tests]), length)
        order = np.argsort(keys[: len(training)], kind="stable")
        array = keys[: len(training)][order]
        windows, of_test = np.unique(keys[len(training) :], return_inverse=True)
        low, high = np.searchsorted(array, windows, "left"), np.searchsorted(array, windows, "right")
        counts = high - low
        inside = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        at = training[order[np.repeat(low, counts) + inside]]
        return at, np.repeat(np.arange(len(windows)), counts), np.where(counts[of_test] > 0, of_test, -1)

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the common beginning of the suffixes at ``a`` and ``b``."""
        a, b, length = a.copy(), b.copy(), np.zeros(len(a), np.int64)
        for j in range(len(self.ranks) - 1, -1, -1):
            last = len(self.words) - 1
            ia, ib = np.minimum(a, last), np.minimum(b, last)
            whole = (self.run[ia] >= 1 << j) & (self.run[ib] >= 1 << j)
            same = whole & (self.ranks[j][ia] == self.ranks[j][ib]) & (self.words[ia] > 0)
            length += same << j
            a += same << j
            b += same << j
        return length

    def matches(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Longest verbatim matches in the shard as ``(tests, lengths)`` and their places ``(positions, lengths, tests)``.

        All places that tie are there: the range around the suffix's place in the array that shares as many words. Test
        suffixes with the same match share a range, which is listed once, for one of them. Matches shorter than a
        window of the item are left out.
        """
        none = np.empty(0, np.int64)
        if not len(self.kept) or not len(self.tests):
            return (none,) * 5
        top = self.ranks[-1]
        order = self.kept[np.argsort(top[self.kept], kind="stable")]
        place = np.searchsorted(top[order], top[self.tests])
        near = (np.maximum(place - 1, 0), np.minimum(place, len(order) - 1))
        lengths = np.maximum(*[self.common(order[n], self.tests) for n in near])
        item = np.searchsorted(self.test.starts, self.tests, "right") - 1
        some = np.flatnonzero(lengths >= self.test.floors[item])
        if not len(some):
            return (none,) * 5
        tests, lengths, place = self.tests[some], lengths[some], place[some]
        ranges = np.stack([self._edge(order, tests, lengths, place, -1), self._edge(order, tests, lengths, place, 1), lengths], 1)
        ranges, first = np.unique(ranges, axis=0, return_index=True)
        counts = ranges[:, 1] - ranges[:, 0]
        inside = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        at = order[np.repeat(ranges[:, 0], counts) + inside]
        return tests, lengths, at, np.repeat(ranges[:, 2], counts), np.repeat(tests[first], counts)

    def _edge(self, order: np.ndarray, tests: np.ndarray, lengths: np.ndarray, place: np.ndarray, way: int) -> np.ndarray:
        """How far the range that shares ``lengths`` words reaches from ``place``: its begin (-1) or its end (1)."""
        # The distance is between ``low`` (all shared) and ``high`` (not known).
        low, high = np.zeros(len(tests), np.int64), place.copy() if way < 0 else len(order) - place
        while (low < high).any():
            mid = (low + high + 1) // 2
            at = np.clip(place - mid if way < 0 else place + mid - 1, 0, len(order) - 1)
            shared = self.common(order[at], tests) >= lengths
            open_ = low < high
            low, high = np.where(open_ & shared, mid, low), np.where(open_ & ~shared, mid - 1, high)
        return place + way * low


def window_starts(test: TestItems) -> dict[int, np.ndarray]:
    """Test positions where a window starts, by its length: ten words, or a whole shorter item."""
    sizes = np.diff(test.starts) - 1
    out: dict[int, list[np.ndarray]] = {}
    for k, n in enumerate(sizes):
        length = int(min(n, WINDOW))
        out.setdefault(length, []).append(np.arange(test.starts[k], test.starts[k] + n - length + 1))
    return {length: np.concatenate(v) for length, v in out.items()}


@dataclass
class Found:
    """What a shard has of one block: hit words and items by document, and its longest matches."""

    hits: list[np.ndarray]
    items: list[set]
    # By document: (word, number of words, key of the words), all places of the shard's longest matches.
    places: list[list[tuple[int, int, int]]]
    # (id and key of the item, word of the item, number of words, key of the words) for every matched test suffix.
    best: list[tuple[str | None, int, int, int, int]]


def search_shard(docs: list[list[bytes]], test: TestItems, matches: bool) -> Found:
    """Hit words, items and, if asked for, the longest matches of each document of a shard."""
    get = test.vocabulary.get
    sizes = [len(d) for d in docs]
    offsets = np.concatenate([[0], np.cumsum([n + 1 for n in sizes])]).astype(np.int64)
    flat = np.zeros(offsets[-1], np.int64)
    for d, o in zip(docs, offsets):
        flat[o : o + len(d)] = [get(w, 0) for w in d]
    out = Found([np.zeros(n, bool) for n in sizes], [set() for _ in docs], [[] for _ in docs], [])
    # Most shards have no run of known words as long as a window.
    stops = np.flatnonzero(flat == 0)
    if not len(stops) or np.diff(np.concatenate([[-1], stops])).max() - 1 < test.least:
        return out
    array = SuffixArray(flat, test)
    change = np.zeros(len(flat) + 1, np.int64)
    for length, starts in window_starts(test).items():
        at, window, of_test = array.occurrences(starts, length)
        at = at - array.split
        np.add.at(change, at, 1)
        np.add.at(change, at + length, -1)
        having: dict[int, set] = {}
        item = np.searchsorted(test.starts, starts, "right") - 1
        for w, k in zip(of_test[of_test >= 0].tolist(), item[of_test >= 0].tolist()):
            having.setdefault(w, set()).add(k)
        pairs = np.unique(np.stack([np.searchsorted(offsets, at, "right") - 1, window], 1), axis=0)
        for d, w in pairs.tolist():
            out.items[d] |= having[w]
    covered = np.cumsum(change[:-1]) > 0
    for d, o in enumerate(offsets[:-1]):
        out.hits[d] = covered[o : o + sizes[d]]
    if matches:
        tests, lengths, at, of_length, like = array.matches()
        item = np.searchsorted(test.starts, tests, "right") - 1
        whole = test.span_keys(test.starts[item], test.starts[item + 1] - 1 - test.starts[item])
        columns = (whole, tests - test.starts[item], lengths, test.span_keys(tests, lengths))
        out.best = [(test.ids[k], *row) for k, *row in zip(item.tolist(), *[c.tolist() for c in columns])]
        at = at - array.split
        doc = np.searchsorted(offsets, at, "right") - 1
        columns = (at - offsets[doc], of_length, test.span_keys(like, of_length))
        for d, *row in zip(doc.tolist(), *[c.tolist() for c in columns]):
            out.places[d].append(tuple(row))
    return out


FIELDS = [
    StructField("n_words", LongType(), False),
    StructField("n_hit", LongType(), False),
    StructField("item_ids", ArrayType(StringType()), False),
]
WORDS = [StructField("n_words", IntegerType()), StructField("match_key", LongType())]
# The shard's longest matches: places in this document; and, at one document of the shard, the test suffixes.
MATCHES = [
    StructField("places", ArrayType(StructType([StructField("doc_start", IntegerType()), *WORDS])), False),
    StructField(
        "suffixes",
        ArrayType(
            StructType(
                [
                    StructField("item_id", StringType()),
                    StructField("item_key", LongType()),
                    StructField("item_start", IntegerType()),
                    *WORDS,
                ]
            )
        ),
        False,
    ),
]


def contamination(
    docs: DataFrame, benchmark: DataFrame, keep: list[str], text_col: str = "text", matches: bool = False
) -> DataFrame:
    """``keep``, ``n_words``, ``n_hit`` and ``item_ids`` of every row of ``docs``.

    A word is hit inside any occurrence of a window: ten consecutive words of an item, or all words of
    a shorter one. ``item_ids`` are the items with occurring windows, sorted; all items whose id is null
    count as one, a null at the end. With ``matches`` also ``places`` and ``suffixes``, the longest verbatim matches of
    each shard, which ``longest_matches`` merges.

    A null or empty text has no words and no hits; an empty benchmark hits nothing. Repeated
    rows each get a row. Other columns are not read and nothing is shuffled. Only the
    benchmark is broadcast, in blocks that tasks hold one at a time.
    """
    blocks = read_blocks(benchmark)
    fields = [*FIELDS, *MATCHES] if matches else FIELDS

    def make():
        def search(texts):
            out: list[list] = [[] for _ in fields]
            for docs_of in shards(texts):
                found = [(search_shard(docs_of, b.value, matches), b.value.ids) for b in blocks]
                for d, words in enumerate(docs_of):
                    hit = np.logical_or.reduce([f.hits[d] for f, _ in found]) if found else np.zeros(0, bool)
                    ids = sorted({of[k] for f, of in found for k in f.items[d]}, key=lambda i: (i is None, i or ""))
                    row = [len(words), int(hit.sum()), ids]
                    if matches:
                        names = ("doc_start", "n_words", "match_key")
                        row.append([dict(zip(names, m)) for f, _ in found for m in f.places[d]])
                        names = ("item_id", "item_key", "item_start", "n_words", "match_key")
                        row.append([dict(zip(names, m)) for f, _ in found if d == 0 for m in f.best])
                    for column, value in zip(out, row):
                        column.append(value)
            return out

        return search

    return add_from_text(docs, text_col, keep, fields, make)


def shards(texts: Iterable[str | None]) -> Iterator[list[list[bytes]]]:
    """The words of the texts in shards of some ``SHARD_CHARS`` characters, a text at least."""
    held, chars = [], 0
    for t in texts:
        held.append(item_words(t))
        chars += len(t or "")
        if chars >= SHARD_CHARS:
            yield held
            held, chars = [], 0
    if held:
        yield held


def longest_matches(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Over all shards: the longest verbatim match of each test suffix, and all its places.

    ``found`` is ``contamination(..., matches=True)``, written, as it is read twice. Returns ``(item_id, item_key, item_start,
    n_words, match_key)``, one row per test suffix with a match (``item_key`` tells texts under one id apart), and ``(the kept columns,
    doc_start, n_words, match_key)``, one row per place of such a match; ties have a row each. ``match_key`` says which
    words matched, so suffixes and places that share them are never paired. A match has a window's length at least.
    Every repeated document has its places; empty tables give none.
    """
    keep = [F.col(f"`{c}`") for c in found.columns if c not in {f.name for f in [*FIELDS, *MATCHES]}]
    suffixes = found.select(F.explode("suffixes").alias("s")).select("s.*")
    best = suffixes.groupBy("item_id", "item_key", "item_start").agg(F.max(F.struct("n_words", "match_key")).alias("m"))
    best = best.select("item_id", "item_key", "item_start", "m.n_words", "m.match_key")
    places = found.select(*keep, F.explode("places").alias("p")).select(*keep, "p.*")
    return best, places.join(best.select("match_key", "n_words").distinct(), ["match_key", "n_words"], "left_semi")


def with_longest(found: DataFrame) -> DataFrame:
    """``found`` with ``longest_match`` and ``n_longest`` in place of ``places`` and ``suffixes``.

    ``n_longest`` counts the places in the document where a longest match of some test suffix is, by begin and length;
    ``longest_match`` is the most words of one; both are 0 without any.
    """
    # Written with its numbers, so that both readers see the same.
    table = written(found.withColumn("_row", F.monotonically_increasing_id()), "contamination")
    _, places = longest_matches(table)
    by_row = places.groupBy("_row").agg(
        F.max("n_words").cast("long").alias("longest_match"), F.count_distinct("doc_start", "n_words").alias("n_longest")
    )
    out = table.drop("places", "suffixes").join(by_row, "_row", "left").drop("_row")
    zero = F.lit(0).cast("long")
    return out.withColumns({c: F.coalesce(c, zero) for c in ("longest_match", "n_longest")})


def decontaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with their columns, that share no window with the benchmark.

    A null or empty text is clean and stays; texts are read whole, repeated rows go or stay together; an empty
    benchmark removes nothing and an empty table gives an empty one.
    """
    blocks = read_blocks(benchmark)

    @F.pandas_udf("boolean")
    def clean(texts):
        import pandas as pd

        out: list[bool] = []
        for docs_of in shards(texts):
            hit = np.zeros(len(docs_of), bool)
            for b in blocks:
                hit |= np.array([bool(h.any()) for h in search_shard(docs_of, b.value, False).hits], bool)
            out += (~hit).tolist()
        return pd.Series(out, dtype=bool)

    return docs.where(clean(F.col(f"`{text_col}`")))
