"""SentencePiece encoding as a unigram model, and decoding.

The pieces of a model file are put into a double-array trie. A text becomes the sequence of pieces of
the highest total log score, found by Viterbi over the trie's matches; what no piece covers becomes
byte pieces. Blanks are the whitespace marker, and a marker is put before the text. No
piece has a marker after another character, so the best sequence of a text is that of
its marker-led chunks, one after the other, and a chunk met before is not searched again.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, IntegerType, LongType, StringType, StructField

from shoal.llm.common import add_from_text

MARK = "▁"
# A run of markers and what follows up to the next marker.
CHUNK = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")
# What a character without a piece costs below the lowest score, as the format has it.
UNKNOWN_PENALTY = 10.0


@dataclass
class PieceTable:
    """Ids, texts and log scores of the pieces; ``bytes_at[b]`` is the id of the piece of byte ``b`` or -1."""

    pieces: list[str]
    scores: list[float]
    normal: list[bool]
    bytes_at: list[int]
    unknown: int


def read_pieces(path: str, log_scores: bool = True) -> PieceTable:
    """The pieces of a SentencePiece model file.

    A model made by merges ranks its pieces instead of scoring them (the scores are 0, -1, -2, ...). With
    ``log_scores`` such ranks become log probabilities by Zipf's law, ``-log(rank + 3)`` less the log of their sum, so
    that adding them along a text makes sense; scores of a unigram model stay as they are.
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    n = model.get_piece_size()
    pieces = [model.id_to_piece(i) for i in range(n)]
    special = [model.is_control(i) or model.is_unknown(i) or model.is_unused(i) for i in range(n)]
    is_byte = [model.is_byte(i) for i in range(n)]
    bytes_at = [-1] * 256
    for i in range(n):
        if is_byte[i]:
            bytes_at[int(pieces[i][3:5], 16)] = i
    normal = [not s and not b for s, b in zip(special, is_byte)]
    scores = [model.get_score(i) for i in range(n)]
    own = [scores[i] for i in range(n) if normal[i]]
    if log_scores and own and all(float(s).is_integer() for s in own):
        weights = [1.0 / (3.0 - s) for s in own]
        total = float(np.log(sum(weights)))
        scores = [float(-np.log(3.0 - s)) - total if ok else s for s, ok in zip(scores, normal)]
    return PieceTable(pieces, scores, normal, bytes_at, model.unk_id())


class DoubleArray:
    """A double-array trie over the characters of the pieces.

    State ``s`` goes by character code ``c`` to ``base[s] + c`` if ``check`` there is ``s``; ``piece`` has the id of
    the piece that ends in a state or -1. Codes number the characters that pieces use, from 1.
    """

    def __init__(self, table: PieceTable):
        keys = sorted((p, i) for i, p in enumerate(table.pieces) if table.normal[i] and p)
        self.code = {c: k + 1 for k, c in enumerate(sorted({c for p, _ in keys for c in p}))}
        tree: dict = {}
        for p, i in keys:
            node = tree
            for c in p:
                node = node.setdefault(self.code[c], {})
            node[0] = i
        size = 4 * sum(len(p) for p, _ in keys) + len(self.code) + 1024
        self.base = np.zeros(size, np.int32)
        self.check = np.full(size, -1, np.int32)
        self.piece = np.full(size, -1, np.int32)
        used = np.zeros(size, bool)
        used[0] = True
        first_free = 1
        queue = [(0, tree)]
        while queue:
            state, node = queue.pop()
            self.piece[state] = node.get(0, -1)
            codes = np.array(sorted(c for c in node if c), np.int64)
            if not len(codes):
                continue
            while used[first_free]:
                first_free += 1
            at = max(first_free - int(codes[0]), 0)
            while True:
                if at + int(codes[-1]) >= size:
                    size = self._grow(at + int(codes[-1]) + 1)
                    used = np.concatenate([used, np.zeros(size - len(used), bool)])
                # Try many offsets at once: those whose slots are all free.
                span = np.arange(at, min(at + 256, size - int(codes[-1])))
                free = ~used[span[:, None] + codes[None, :]].any(axis=1)
                hit = np.flatnonzero(free)
                if len(hit):
                    at = int(span[hit[0]])
                    break
                at = int(span[-1]) + 1
            self.base[state] = at
            used[at + codes] = True
            self.check[at + codes] = state
            queue += [(at + int(c), node[int(c)]) for c in codes[::-1]]
        end = int(np.flatnonzero(used)[-1]) + len(self.code) + 2
        if end > len(self.base):
            self._grow(end)
        self.base, self.check, self.piece = (x[:end].copy() for x in (self.base, self.check, self.piece))

    def _grow(self, least: int) -> int:
        more = max(least - len(self.base), len(self.base))
        self.base = np.concatenate([self.base, np.zeros(more, np.int32)])
        self.check = np.concatenate([self.check, np.full(more, -1, np.int32)])
        self.piece = np.concatenate([self.piece, np.full(more, -1, np.int32)])
        return len(self.base)


class Chunk(NamedTuple):
    """One chunk's ids (32 bits each), score and the bytes that the ids decode to; for digests the ids in decimal and the number of byte pieces."""

    ids: bytes
    score: float
    raw: bytes
    said: str = ""
    n_bytes: int = 0


class UnigramModel:
    """Encoder and decoder over a piece table; one per task, with the chunks it has met.

    Chunks are remembered in two generations: when the younger is full it becomes the older, whose chunks
    come back when they are met again. So frequent ones stay and memory is bounded. ``digests`` keeps what only digests need.
    """

    LIMIT = 250_000
    # Texts whose chunks are held at once, and characters searched at once.
    TEXTS, CELLS = 250, 200_000

    def __init__(self, table: PieceTable, trie: DoubleArray, digests: bool = False, limit: int = LIMIT):
        self.table, self.trie, self.digests, self.limit = table, trie, digests, limit
        self.arrays = tuple(x.tolist() for x in (trie.base, trie.check, trie.piece))
        self.codes = np.zeros(0x110000, np.int32)
        self.codes[[ord(c) for c in trie.code]] = list(trie.code.values())
        self.scores = np.array(table.scores)
        self.decimal = [str(i) for i in range(len(table.pieces))]
        own = [s for s, ok in zip(table.scores, table.normal) if ok]
        self.unknown_score = (min(own) if own else 0.0) - UNKNOWN_PENALTY
        self.first_byte = table.bytes_at[0]
        self.bytes_of = [p.encode("utf-8") if ok else b"" for p, ok in zip(table.pieces, table.normal)]
        for b, i in enumerate(table.bytes_at):
            self.bytes_of[i] = bytes([b])
        self.met: dict[str, Chunk] = {}
        self.older: dict[str, Chunk] = {}

    def chunk(self, text: str) -> tuple[list[int], float]:
        """Ids and total score of one chunk; of equal totals the first found at each end wins."""
        (base, check, piece), scores = self.arrays, self.table.scores
        codes = [self.trie.code.get(c, 0) for c in text]
        n = len(codes)
        best = [0.0] + [-1e300] * n
        back: list[tuple[int, int]] = [(0, -1)] * (n + 1)
        for i in range(n):
            here, state, single = best[i], 0, False
            for j in range(i, n):
                c = codes[j]
                if not c:
                    break
                nxt = base[state] + c
                if check[nxt] != state:
                    break
                state = nxt
                k = piece[state]
                if k >= 0:
                    single |= j == i
                    total = here + scores[k]
                    if total > best[j + 1]:
                        best[j + 1], back[j + 1] = total, (i, k)
            if not single and here + self.unknown_score > best[i + 1]:
                best[i + 1], back[i + 1] = here + self.unknown_score, (i, -1)
        return self._ids(text, [b[0] for b in back], [b[1] for b in back]), best[n]

    def _ids(self, text: str, starts: list[int], pieces: list[int]) -> list[int]:
        """The pieces of the best path, read from its end; what no piece covers becomes bytes."""
        out: list[int] = []
        at = len(text)
        while at > 0:
            start, k = starts[at], pieces[at]
            if k >= 0:
                out.append(k)
            else:
                out += [self.table.bytes_at[b] for b in reversed(text[start:at].encode("utf-8", "surrogatepass"))]
            at = start
        return out[::-1]

    def search(self, texts: list[str]) -> list[tuple[list[int], float]]:
        """``chunk`` of many texts of one length at once: every step of the search is one array operation."""
        base, check, piece = self.trie.base, self.trie.check, self.trie.piece
        n, size = len(texts[0]), len(texts)
        joined = "".join(texts).encode("utf-32-le", "surrogatepass")
        codes = self.codes[np.frombuffer(joined, np.uint32)].reshape(size, n)
        best = np.full((size, n + 1), -1e300)
        best[:, 0] = 0.0
        starts, pieces = np.zeros((size, n + 1), np.int32), np.full((size, n + 1), -1, np.int32)

        def offer(rows: np.ndarray, end: int, total: np.ndarray, start: int, k) -> None:
            better = total > best[rows, end]
            rows = rows[better]
            best[rows, end], starts[rows, end] = total[better], start
            pieces[rows, end] = k[better] if isinstance(k, np.ndarray) else k

        for i in range(n):
            rows, state, alone = np.arange(size), np.zeros(size, np.int32), np.ones(size, bool)
            for j in range(i, n):
                c = codes[rows, j]
                nxt = base[state] + c
                on = (c > 0) & (check[nxt] == state)
                rows, state = rows[on], nxt[on]
                if not len(rows):
                    break
                k = piece[state]
                ends = k >= 0
                hit, k = rows[ends], k[ends]
                if j == i:
                    alone[hit] = False
                offer(hit, j + 1, best[hit, i] + self.scores[k], i, k)
            rows = np.flatnonzero(alone)
            offer(rows, i + 1, best[rows, i] + self.unknown_score, i, -1)
        ids = map(self._ids, texts, starts.tolist(), pieces.tolist())
        return list(zip(ids, best[:, n].tolist()))

    # Chunks of more characters are searched one by one.
    LONG = 64

    def learn(self, rests: set[str]) -> None:
        """Search all chunks of a batch that have not been met."""
        by_length: dict[int, list[str]] = {}
        for rest in rests:
            if rest in self.met:
                continue
            if rest in self.older or len(rest) > self.LONG:
                self._learn(rest)
            else:
                by_length.setdefault(len(rest), []).append(rest)
        for group in by_length.values():
            rows = self.CELLS // (len(group[0]) + 1)
            for at in range(0, len(group), rows):
                part = group[at : at + rows]
                for rest, (ids, score) in zip(part, self.search([MARK + r for r in part])):
                    self._keep(rest, self._chunk_of(ids, score))

    def _chunk_of(self, ids: list[int], score: float) -> Chunk:
        packed, raw, low = array("i", ids).tobytes(), self.raw(ids), self.first_byte
        if not self.digests:
            return Chunk(packed, score, raw)
        return Chunk(packed, score, raw, ",".join([self.decimal[i] for i in ids]), sum([low <= i < low + 256 for i in ids]))

    def _keep(self, rest: str, chunk: Chunk) -> Chunk:
        if len(self.met) >= self.limit:
            self.older, self.met = self.met, {}
        self.met[rest] = chunk
        return chunk

    def _learn(self, rest: str) -> Chunk:
        """The chunk of a marker and ``rest``, found among the older ones or searched."""
        chunk = self.older.pop(rest, None)
        return self._keep(rest, chunk if chunk is not None else self._chunk_of(*self.chunk(MARK + rest)))

    @staticmethod
    def rests(text: str | None) -> list[str]:
        """What follows the first marker in each chunk of a whole text; none for an empty text."""
        if not text:
            return []
        if "  " in text or text[0] == " " or MARK in text:
            return [part[1:] for part in CHUNK.findall(MARK + text.replace(" ", MARK))]
        return text.split(" ")  # every chunk is one marker and what follows

    def batch(self, texts: list[str | None]) -> Iterator[list[Chunk]]:
        """The chunks of each whole text of a batch, in order."""
        for at in range(0, len(texts), self.TEXTS):
            cut = [self.rests(t) for t in texts[at : at + self.TEXTS]]
            self.learn(set().union(*cut))
            for rests in cut:
                found = list(map(self.met.get, rests))
                if None in found:
                    found = [self.met.get(r) or self._learn(r) for r in rests]
                yield found

    @staticmethod
    def ids_of(found: list[Chunk]) -> np.ndarray:
        """The ids of chunks, one after the other."""
        return np.frombuffer(b"".join([c.ids for c in found]), np.int32)

    def encode(self, text: str) -> tuple[list[int], float]:
        """Ids and total log score of a whole text; an empty text has none."""
        (found,) = self.batch([text])
        return self.ids_of(found).tolist(), sum([c.score for c in found])

    def raw(self, ids: list[int]) -> bytes:
        """The bytes of the pieces, byte pieces as their byte and markers as they are."""
        return b"".join([self.bytes_of[i] for i in ids])

    @staticmethod
    def text_of(raw: bytes) -> str:
        """The text of the bytes: markers become blanks, and the first one is dropped."""
        text = raw.decode("utf-8", "replace").replace(MARK, " ")
        return text[1:] if text.startswith(" ") else text

    def decode(self, ids: list[int]) -> str:
        return self.text_of(self.raw(ids))


FIELDS = [
    StructField("ids", ArrayType(IntegerType(), False), False),
    StructField("log_score", DoubleType(), False),
    StructField("decoded", StringType(), False),
]


def _parts(path: str):
    table = read_pieces(path)
    if table.bytes_at != list(range(table.bytes_at[0], table.bytes_at[0] + 256)) or table.bytes_at[0] < 0:
        raise ValueError("the model has no byte pieces in a row")
    if any(MARK in p.lstrip(MARK) for p, ok in zip(table.pieces, table.normal) if ok):
        raise ValueError("the model has pieces that cross a whitespace marker")
    return table, DoubleArray(table)


# Chunks of a generation where whole ids and texts are made: the tasks of a pipeline share an executor with what its other stages left.
ENCODED_LIMIT = 100_000


def encoded(docs: DataFrame, model_path: str, keep: list[str], text_col: str = "text") -> DataFrame:
    """``keep``, ``ids``, ``log_score`` and ``decoded`` of every row of ``docs``.

    Whole texts are encoded. Null and empty texts have no ids, score 0 and decode to the empty text. Characters
    without a piece become their UTF-8 bytes. ``decoded`` is the text made from the ids again; it equals the
    text except where that holds a whitespace marker itself, which becomes a blank. Repeated rows each get a row; other columns
    are not read; nothing is shuffled. The driver reads the model file and broadcasts pieces and trie, whose
    size is that of the vocabulary.
    """
    parts = docs.sparkSession.sparkContext.broadcast(_parts(model_path))

    def make():
        model = UnigramModel(*parts.value, limit=ENCODED_LIMIT)

        def run(texts):
            ids, scores, decoded = [], [], []
            for found in model.batch(texts):
                ids.append(model.ids_of(found))
                scores.append(sum([c.score for c in found]))
                decoded.append(model.text_of(b"".join([c.raw for c in found])))
            return [ids, scores, decoded]

        return run

    return add_from_text(docs, text_col, keep, FIELDS, make)


DIGEST = [
    StructField("n_tokens", LongType(), False),
    StructField("n_bytes", LongType(), False),
    StructField("ids_sha256", StringType(), False),
    StructField("log_score", DoubleType(), False),
    StructField("text_sha256", StringType(), False),
    StructField("restored", BooleanType(), False),
]


def encoding_digest(docs: DataFrame, model_path: str, keep: list[str], text_col: str = "text") -> DataFrame:
    """``keep`` with counts and digests of ids and decoded text, computed where the text is encoded.

    ``n_bytes`` counts byte pieces, ``ids_sha256`` is of the ids in decimal, comma-joined, ``text_sha256``
    of the decoded text; ``restored`` says that it equals the text.
    """
    parts = docs.sparkSession.sparkContext.broadcast(_parts(model_path))

    def make():
        model = UnigramModel(*parts.value, digests=True)

        def run(texts):
            rows = []
            for t, found in zip(texts, model.batch(texts)):
                text = model.text_of(b"".join([c.raw for c in found]))
                rows.append(
                    (
                        len(model.ids_of(found)),
                        sum([c.n_bytes for c in found]),
                        hashlib.sha256(",".join([c.said for c in found]).encode()).hexdigest(),
                        sum([c.score for c in found]),
                        hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest(),
                        text == (t or ""),
                    )
                )
            return list(zip(*rows)) or [[] for _ in DIGEST]

        return run

    return add_from_text(docs, text_col, keep, DIGEST, make)
