"""Main text of HTML pages: markup first, then passages that a host repeats from page to page.

What a host repeats is found by a suffix array over the token streams (tags and words) of all its pages, whole pages with
their articles. It is sparse and spread over the cluster: suffixes are kept where a block begins, one head before a block ends, and at
minimisers, which the content selects, so that equal passages keep suffixes at the same places. Suffixes with equal heads meet; heads of two
distinct pages are repeated, and overlapping repeated heads make a run. Only heads move; a page is parsed again for its blocks.

An article element is main text whatever else repeats it: pages may share articles and passages. Where no
element says what the main text is, blocks that repeated runs cover are boilerplate and unique runs are kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoal.llm.common import WordHashes, hash_words, mixed, rolling, signed, written
from shoal.llm.html_blocks import ARTICLE, MAIN, OPEN, Page, parse
from shoal.llm.suffix_dedup import minimisers
from shoal.session import shuffle_tasks

# Tokens of a suffix that are compared.
HEAD = 8
# Every run of GAP tokens holds a minimiser of K-token hashes.
GAP, K = 8, 4
# Pages whose heads fill a task that compares them.
TASK_PAGES = 8_000
# Repeated heads that a task gathers by page before it writes them.
HELD_HEADS = 500_000


def _candidates(page: Page) -> list[int]:
    """Blocks that may be main text: those in articles if there are any, else those in main, else the open ones."""
    best = next((z for z in (ARTICLE, MAIN) if z in page.zones), OPEN)
    return [i for i, z in enumerate(page.zones) if z == best]


def _stream(page: Page, known: WordHashes) -> tuple[np.ndarray, np.ndarray]:
    """The tokens of the whole page, hashed, and where its blocks begin."""
    tokens = hash_words([t.encode("utf-8", "surrogatepass") for t in page.tokens], known)
    return tokens, np.array(page.starts, np.int64)


def _key(host: str, page: Page, tokens: np.ndarray, starts: np.ndarray) -> tuple[int, int]:
    """128 bits that are equal for copies of a page on a host only."""
    marks = np.array([x for i in _candidates(page) for x in (i, page.zones[i], page.linked[i])], np.int64)
    sizes = np.array([len(host), len(tokens), len(starts)], np.int64)
    parts = (sizes.tobytes(), host.encode("utf-8", "surrogatepass"), tokens.tobytes(), starts.tobytes(), marks.tobytes())
    digest = np.frombuffer(xxhash.xxh3_128_digest(b"".join(parts)), np.int64)
    return int(digest[0]), int(digest[1])


def suffix_places(tokens: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Kept suffixes of a stream that have a whole head: block begins, a head before block ends, minimisers."""
    ends = np.append(starts[1:], len(tokens))
    at = np.concatenate([starts, ends - HEAD, minimisers(tokens, GAP, K)])
    return np.unique(at[(at >= 0) & (at <= len(tokens) - HEAD)])


def covered_blocks(places: np.ndarray, starts: np.ndarray, size: int) -> np.ndarray:
    """Blocks of which repeated heads at ``places`` cover half of the tokens or more."""
    change = np.zeros(size + 1, np.int64)
    np.add.at(change, places, 1)
    np.add.at(change, places + HEAD, -1)
    upto = np.concatenate([[0], np.cumsum(np.cumsum(change[:-1]) > 0)])
    ends = np.append(starts[1:], size)
    return np.flatnonzero(2 * (upto[ends] - upto[starts]) >= ends - starts)


def _page_heads(host: str, tokens: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The kept heads of a page, hashed with its host, and their places."""
    at = suffix_places(tokens, starts) if len(starts) else np.empty(0, np.int64)
    own = np.uint64(xxhash.xxh3_64_intdigest(host.encode("utf-8", "surrogatepass")))
    return signed(mixed(rolling(tokens, HEAD)[at] ^ own)), at


def _heads(pages: DataFrame, tasks: int) -> DataFrame:
    """``(task, p1, p2, heads)``: the kept heads of every page once, by the task that compares them, with the key of the page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for batch in batches:
            heads, keys = [np.empty(0, np.int64)], []
            for host, html in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist()):
                page = parse(html)
                tokens, starts = _stream(page, known)
                heads.append(np.unique(_page_heads(host, tokens, starts)[0]))
                keys.append(_key(host, page, tokens, starts))
            page_of = np.repeat(np.arange(len(keys)), [len(h) for h in heads[1:]])
            h = np.concatenate(heads)
            task = (h.view(np.uint64) % np.uint64(tasks)).astype(np.int64)
            order = np.lexsort((task, page_of))
            page_of, task, h = page_of[order], task[order], h[order]
            starts = np.flatnonzero(np.diff(page_of * tasks + task, prepend=-1))
            lists = pa.ListArray.from_arrays(pa.array(np.append(starts, len(h)), pa.int32()), pa.array(h))
            p1, p2 = (np.array([k[i] for k in keys], np.int64)[page_of[starts]] for i in (0, 1))
            arrays = [pa.array(task[starts].astype(np.int32)), pa.array(p1), pa.array(p2), lists]
            yield pa.RecordBatch.from_arrays(arrays, names=["task", "p1", "p2", "heads"])

    return pages.select("host", "html").mapInArrow(run, "task int, p1 long, p2 long, heads array<long>")


def repeated_heads(heads: DataFrame) -> DataFrame:
    """``(p1, p2, heads)``: per page its heads that another page of the host has too; copies are one page.

    All rows ``(p1, p2, heads)`` of a head are in one task and stand side by side after a sort; the first page of a head is kept only.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None  # head and first page at the end of the batch before, and whether another page has it
        for batch in batches:
            if not batch.num_rows:
                continue
            p1, p2, h = (batch.column(n).to_numpy(zero_copy_only=False) for n in ("p1", "p2", "h"))
            if last is not None and last[0][2] == h[0]:
                p1, p2, h = (np.concatenate([[x], y]) for x, y in zip(last[0], (p1, p2, h)))
                known = last[1]
            else:
                known = False
            starts = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
            group = np.cumsum(np.r_[0, h[1:] != h[:-1]])
            other = (p1 != p1[starts][group]) | (p2 != p2[starts][group])
            many = np.bincount(group[other], minlength=len(starts)) > 0
            many[0] |= known
            # copies in a row of the same page say it once
            fresh = np.r_[True, (h[1:] != h[:-1]) | (p1[1:] != p1[:-1]) | (p2[1:] != p2[:-1])]
            fresh[0] &= not known
            keep = many[group] & fresh
            if keep.any():
                yield pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in (p1, p2, h)], names=["p1", "p2", "h"])
            last = (p1[starts[-1]], p2[starts[-1]], h[-1]), bool(many[-1])

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def rows() -> pa.RecordBatch:
            p1, p2, h = (np.concatenate([b.column(n).to_numpy(zero_copy_only=False) for b in held]) for n in ("p1", "p2", "h"))
            order = np.lexsort((p2, p1))
            p1, p2, h = p1[order], p2[order], h[order]
            starts = np.flatnonzero(np.r_[True, (p1[1:] != p1[:-1]) | (p2[1:] != p2[:-1])])
            lists = pa.ListArray.from_arrays(pa.array(np.append(starts, len(h)), pa.int32()), pa.array(h))
            return pa.RecordBatch.from_arrays([pa.array(p1[starts]), pa.array(p2[starts]), lists], names=["p1", "p2", "heads"])

        for batch in run(batches):
            held.append(batch)
            if sum(b.num_rows for b in held) >= HELD_HEADS:
                yield rows()
                held.clear()
        if held:
            yield rows()

    met = heads.select("p1", "p2", F.explode("heads").alias("h")).sortWithinPartitions("h", "p1", "p2")
    # Written, so that every head is compared whether or not a page without an article asks.
    found = written(met.mapInArrow(packed, "p1 long, p2 long, heads array<long>"), "repeated")
    return found.groupBy("p1", "p2").agg(F.flatten(F.collect_list("heads")).alias("heads"))


def _blocks(pages: DataFrame) -> DataFrame:
    """Per page its article text, or its candidate blocks, where blocks begin, its kept suffixes and its key."""
    fields = ", ".join(f"{n} {pages.schema[n].dataType.simpleString()}" for n in ("page_id", "url"))
    schema = f"{fields}, article string, candidates array<struct<block int, linked boolean, text string>>, "
    schema += "starts array<int>, size int, own array<long>, places array<int>, p1 long, p2 long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        kind = pa.list_(pa.struct([("block", pa.int32()), ("linked", pa.bool_()), ("text", pa.string())]))
        kinds = [pa.string(), kind, pa.list_(pa.int32()), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.int64(), pa.int64()]
        names = ["article", "candidates", "starts", "size", "own", "places", "p1", "p2"]
        for batch in batches:
            rows = []
            for host, html in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist()):
                page = parse(html)
                own = _candidates(page)
                if ARTICLE in page.zones or not own:
                    rows.append(("\n\n".join(page.texts[i] for i in own), None, None, None, None, None, None, None))
                    continue
                tokens, starts = _stream(page, known)
                blocks = [{"block": i, "linked": page.linked[i], "text": page.texts[i]} for i in own]
                rows.append((None, blocks, page.starts, len(tokens), *_page_heads(host, tokens, starts), *_key(host, page, tokens, starts)))
            arrays = [pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), *arrays], names=["page_id", "url", *names])

    return pages.select("page_id", "url", "host", "html").mapInArrow(run, schema)


def _uncovered(rows: DataFrame) -> DataFrame:
    """The texts of the candidate blocks that no repeated run covers; all of them if that leaves none. Blocks of links only go."""
    fields = ", ".join(f"{n} {rows.schema[n].dataType.simpleString()}" for n in ("page_id", "url"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            columns = (batch.column(n).to_pylist() for n in ("candidates", "starts", "size", "own", "places", "heads"))
            for blocks, starts, size, own, places, heads in zip(*columns):
                repeated = np.array(places, np.int64)[np.isin(np.array(own, np.int64), np.array(heads or [], np.int64))]
                gone = set(covered_blocks(repeated, np.array(starts, np.int64), size).tolist())
                told = [b for b in blocks if not b["linked"]]
                out.append("\n\n".join(b["text"] for b in [b for b in told if b["block"] not in gone] or told))
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(out, pa.string())], names=["page_id", "url", "text"])

    return rows.mapInArrow(run, f"{fields}, text string")


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``(page_id, url, text, n_chars)`` of every row of ``pages``: the main text, its blocks joined by an empty line.

    The main text is what article elements hold, without menus, footers, sidebars, adverts, forms, notices, comments,
    scripts and markup in them. A page without an article gives the blocks of its main element, or else those that no
    markup rules out, except blocks that are links only and blocks half covered by runs which the host repeats on
    distinct pages; if that leaves nothing, the repeated ones stay (a page that copies another one).

    A null or empty page, or one without main text, has an empty text. A page without a url has a host of its
    own kind (an empty name). Repeated rows and ids each get a row; copies of a page repeat nothing. An empty
    table gives no rows. Whole pages are read, however long; other columns are not.
    """
    taken = pages.select(F.col(f"`{id_col}`").alias("page_id"), F.col(f"`{url_col}`").cast("string").alias("url"), F.col(f"`{html_col}`").alias("html"))
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1))
    taken = taken.withColumn("host", host)
    tasks = shuffle_tasks(pages.count(), TASK_PAGES)
    repeated = repeated_heads(_heads(taken, tasks).repartitionById(tasks, F.col("task")))
    blocks = _blocks(taken)
    article = blocks.where(F.col("article").isNotNull()).select("page_id", "url", F.col("article").alias("text"))
    rows = blocks.where(F.col("article").isNull()).join(repeated, ["p1", "p2"], "left")
    out = article.unionByName(_uncovered(rows))
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
