"""Chat formatting in budgeted windows.

The turns of each conversation are numbered by global prefix sums of their tokens, so a conversation of
any length is worked on in parts. Every part is cut into windows of whole turns that fit a token
budget. Each window begins with the system turn and, from the second on, with a limited
history of turns repeated from before; the loss mask covers each assistant turn once, where it is new.

A window is text: turns marked by control strings, control strings inside a turn escaped
reversibly. ``read_back`` gives the turns and the masked text from the windows alone.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shoal.llm.prefix import PIECE, ordered_pieces

# A turn is "<|turn|>role<|says|>text<|end|>"; a repeated one begins with "<|again|>".
TURN, AGAIN, SAYS, END = "<|turn|>", "<|again|>", "<|says|>", "<|end|>"
# Strings that steer chat models; inside a text they are broken up by the escape character.
CONTROL = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", TURN, AGAIN, SAYS, END, "<|im_start|>", "<|im_end|>", "<|endoftext|>")
ESCAPE = "\\"
_TO_ESCAPE = re.compile("|".join(map(re.escape, sorted((*CONTROL, ESCAPE), key=len, reverse=True))))
_ESCAPED = re.compile(r"\\(.)", re.S)
_TURN = re.compile(f"({re.escape(TURN)}|{re.escape(AGAIN)})(.*?){re.escape(SAYS)}(.*?){re.escape(END)}", re.S)
ASSISTANT, SYSTEM = "assistant", "system"


def escaped(text: str) -> str:
    """``text`` without control strings: the escape character comes after the first character of each, and is doubled itself."""
    return _TO_ESCAPE.sub(lambda m: ESCAPE * 2 if m[0] == ESCAPE else f"{m[0][0]}{ESCAPE}:{m[0][1:]}", text)


def unescaped(text: str) -> str:
    return _ESCAPED.sub(lambda m: "" if m[1] == ":" else m[1], text)


@dataclass(frozen=True)
class Budget:
    """Tokens of a window, of the history repeated in it, and of a part in which windows are chosen together."""

    window: int = 1024
    history: int = 256
    part: int = 64 * 1024

    def __post_init__(self):
        if not 0 <= self.history <= self.part or self.window <= 0 or self.part < self.window:
            raise ValueError("need 0 <= history <= part and 0 < window <= part")


def turn_tokens(turns: DataFrame, model_path: str) -> DataFrame:
    """``turns`` with ``tokens``: pieces of the formatted turn by a SentencePiece model file."""
    spark = turns.sparkSession
    with open(model_path, "rb") as f:
        model = spark.sparkContext.broadcast(f.read())  # a vocabulary file

    @F.pandas_udf("long")
    def count(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        loaded = sentencepiece.SentencePieceProcessor(model_proto=model.value)
        for role, text in batches:
            said = [TURN + escaped(r) + SAYS + escaped(t) + END for r, t in zip(role, text)]
            yield pd.Series([len(x) for x in loaded.encode(said)], dtype="int64")

    return turns.withColumn("tokens", count("role", "text"))


def _placed(turns: DataFrame) -> DataFrame:
    """Turns with ``idx`` (place in the conversation) and ``start`` (tokens of the conversation before it).

    Range partitions by conversation and turn; each adds up its own conversations. Only a conversation that
    crosses a border gets an offset from the partitions before: at most two rows per border.
    """
    order = [F.col(c).asc_nulls_first() for c in ("conv_id", "turn", "role", "text")]
    pieces = ordered_pieces(turns, order)
    sums = pieces.groupBy(PIECE, "conv_id").agg(F.sum("tokens").alias("t"), F.count("*").alias("n"))
    edges = sums.select(
        "*",
        F.min(F.struct(F.col("conv_id").isNotNull(), "conv_id")).over(Window.partitionBy(PIECE)).alias("lo"),
        F.max(F.struct(F.col("conv_id").isNotNull(), "conv_id")).over(Window.partitionBy(PIECE)).alias("hi"),
    )
    own = F.struct(F.col("conv_id").isNotNull(), F.col("conv_id"))
    # A conversation goes on in another partition only from its last or into its first.
    edges = edges.where((F.col("lo") == own) | (F.col("hi") == own))
    before = Window.partitionBy("conv_id").orderBy(PIECE).rowsBetween(Window.unboundedPreceding, -1)
    offsets = edges.select(
        F.col(PIECE).alias("_p"),
        F.col("conv_id").alias("_c"),
        F.coalesce(F.sum("t").over(before), F.lit(0)).alias("_t"),
        F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_n"),
    ).where(F.col("_n") > 0)
    inside = Window.partitionBy(PIECE, "conv_id").orderBy(*order[1:]).rowsBetween(Window.unboundedPreceding, -1)
    rows = pieces.select(
        "*",
        F.coalesce(F.sum("tokens").over(inside), F.lit(0)).alias("_s"),
        F.count("*").over(inside).alias("_i"),
    )
    # At most one row per range partition.
    rows = rows.join(F.broadcast(offsets), (F.col(PIECE) == F.col("_p")) & F.col("conv_id").eqNullSafe(F.col("_c")), "left")
    at = lambda a, b: (F.col(a) + F.coalesce(F.col(b), F.lit(0))).cast("long")
    return rows.select("conv_id", "turn", "role", "text", "tokens", at("_i", "_n").alias("idx"), at("_s", "_t").alias("start"))


def _parts(placed: DataFrame, budget: Budget) -> DataFrame:
    """Turns dealt into parts; the system turn goes to every part, possible history to the next one.

    ``use`` is 0 for the system turn, 1 for history, 2 for the part's own turns.
    """
    part = F.floor(F.col("start") / budget.part)
    own = placed.withColumn("part", part)
    # A turn that reaches the next part's start within the history may be repeated there.
    history = own.where((F.col("part") + 1) * budget.part - F.col("start") <= budget.history)
    system = own.where(F.col("role") == SYSTEM).groupBy("conv_id").agg(
        F.min(F.struct("idx", "role", "text", "tokens", "start")).alias("s")
    )
    last = own.groupBy("conv_id").agg(F.max("part").alias("last"), F.count("*").alias("turns"))
    reach = system.join(last.withColumnRenamed("conv_id", "_c"), F.col("conv_id").eqNullSafe(F.col("_c")))
    first_part = F.floor(F.col("s.start") / budget.part)
    to_all = reach.select("conv_id", "s.*", F.explode(F.sequence(first_part, F.col("last"))).alias("part"))
    columns = ("conv_id", "part", "idx", "role", "text", "tokens", "start")
    return (
        own.select(*columns, F.lit(2).alias("use"))
        .unionByName(history.withColumn("part", F.col("part") + 1).select(*columns, F.lit(1).alias("use")))
        .unionByName(to_all.select(*columns, F.lit(0).alias("use")))
    )


@dataclass
class Turn:
    idx: int
    role: str
    text: str
    tokens: int
    start: int


def windows_of(system: Turn | None, history: list[Turn], own: list[Turn], budget: Budget) -> Iterator[tuple[list[Turn], list[Turn]]]:
    """``(repeated, new)`` turns of each window of a part, in order.

    A window takes new turns while they fit beside the system turn and its history; the history
    is as many of the turns just before as fit its own limit and leave room for the first new turn. A turn that is too
    long for any window has one of its own and is not cut.
    """
    seen = list(history)
    at = 0
    while at < len(own):
        first = own[at]
        held = [system] if system is not None and system.idx < first.idx else []
        room = budget.window - sum(t.tokens for t in held) - first.tokens
        again: list[Turn] = []
        for t in reversed(seen):
            reach = first.start - t.start
            if t is system or (system is not None and t.idx == system.idx) or reach > budget.history:
                break
            if t.tokens > room:
                break
            room -= t.tokens
            again.append(t)
        new = [first]
        at += 1
        while at < len(own) and own[at].tokens <= room:
            room -= own[at].tokens
            new.append(own[at])
            at += 1
        yield held + again[::-1], new
        seen = [t for t in seen + new if new[-1].start + new[-1].tokens - t.start <= budget.history]


def formatted(again: list[Turn], new: list[Turn]) -> tuple[str, list[tuple[int, int]]]:
    """The window's text and the spans of its loss mask, in code points."""
    out, spans, at = [], [], 0
    for mark, turns in ((AGAIN, again), (TURN, new)):
        for t in turns:
            head, body = mark + escaped(t.role) + SAYS, escaped(t.text)
            if mark == TURN and t.role == ASSISTANT:
                spans.append((at + len(head), at + len(head) + len(body)))
            out += [head, body, END]
            at += len(head) + len(body) + len(END)
    return "".join(out), spans


def format_conversations(turns: DataFrame, model_path: str, budget: Budget = Budget()) -> DataFrame:
    """``(conv_id, first_turn, window_tokens, n_repeated, text, loss_spans)``, one row per window.

    ``turns`` has ``conv_id, turn, role, text``; other columns are not read. Turns are ordered by ``turn``
    (nulls first), then role and text. Null texts and roles are empty; rows of a null ``conv_id`` are
    one conversation. Repeated rows are turns of their own. An empty table gives no windows.

    ``first_turn`` is the place of the first new turn in the conversation and orders the windows. ``loss_spans`` has
    ``(start, end)`` in code points of ``text``: the new assistant turns. Windows never
    cross a part (``budget.part`` tokens by the prefix sums), so a conversation that holds a third of all turns is
    spread over tasks.
    """
    rows = turns.select(
        "conv_id",
        "turn",
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    parts = _parts(_placed(turn_tokens(rows, model_path)), budget)
    ordered = parts.repartition("conv_id", "part").sortWithinPartitions("conv_id", "part", "use", "idx")
    kind = ordered.schema["conv_id"].dataType.simpleString()
    schema = f"conv_id {kind}, first_turn long, window_tokens long, n_repeated int, text string, loss_spans array<struct<start:int,end:int>>"
    names = ["conv_id", "first_turn", "window_tokens", "n_repeated", "text", "loss_spans"]
    spans_type = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, {0: [], 1: [], 2: []}

        def out() -> list[tuple]:
            made = []
            system = held[0][0] if held[0] else None
            for again, new in windows_of(system, held[1], held[2], budget):
                text, spans = formatted(again, new)
                tokens = sum(t.tokens for t in again + new)
                made.append((at[0], new[0].idx, tokens, len(again), text, [{"start": a, "end": b} for a, b in spans]))
            return made

        def batch_of(made: list[tuple], conv_type) -> pa.RecordBatch:
            types = [conv_type, pa.int64(), pa.int64(), pa.int32(), pa.string(), spans_type]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*made), types)], names=names)

        for batch in batches:
            made = []
            for conv, part, idx, role, text, tokens, start, use in zip(*(c.to_pylist() for c in batch.columns)):
                if (conv, part) != at:
                    if at is not None:
                        made += out()
                    at, held = (conv, part), {0: [], 1: [], 2: []}
                held[use].append(Turn(idx, role, text, tokens, start))
            if made:
                yield batch_of(made, batch.schema.field(0).type)
        if at is not None and held[2]:
            yield batch_of(out(), pa.array([at[0]]).type if at[0] is not None else pa.int64())

    return ordered.mapInArrow(run, schema)


def turns_of(text: str, spans: list[tuple[int, int]]) -> tuple[list[tuple[str, str]], list[str]]:
    """New turns ``(role, text)`` of a window, and the unescaped texts under its loss mask."""
    turns = [(unescaped(r), unescaped(t)) for mark, r, t in _TURN.findall(text) if mark == TURN]
    return turns, [unescaped(text[a:b]) for a, b in spans]


def read_back(windows: DataFrame) -> DataFrame:
    """``(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, n_windows)`` from the windows alone.

    The windows of a conversation pass one task in order, as a stream: a digest of a whole conversation cannot
    be made in parts. The task holds two digest states and one batch, however long the conversation is.
    """
    ordered = windows.select("conv_id", "first_turn", "text", "loss_spans")
    ordered = ordered.repartition("conv_id").sortWithinPartitions("conv_id", "first_turn")
    kind = windows.schema["conv_id"].dataType.simpleString()
    schema = f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_windows long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_windows"]
        state = None

        def row(s) -> tuple:
            return (s["conv"], s["turns"], s["said"].hexdigest(), s["chars"], s["loss"].hexdigest(), s["formatted"], s["windows"])

        def batch_of(rows, conv_type):
            types = [conv_type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

        conv_type = pa.int64()
        for batch in batches:
            rows, conv_type = [], batch.schema.field(0).type
            for conv, _, text, spans in zip(*(c.to_pylist() for c in batch.columns)):
                if state is None or state["conv"] != conv:
                    if state is not None:
                        rows.append(row(state))
                    state = {"conv": conv, "turns": 0, "chars": 0, "formatted": 0, "windows": 0}
                    state |= {"said": hashlib.sha256(), "loss": hashlib.sha256()}
                turns, loss = turns_of(text, [(s["start"], s["end"]) for s in spans])
                state["turns"] += len(turns)
                state["windows"] += 1
                state["formatted"] += len(text)
                for r, t in turns:
                    state["said"].update(f"{r}\n{t}\n".encode("utf-8", "surrogatepass"))
                for t in loss:
                    state["chars"] += len(t)
                    state["loss"].update(t.encode("utf-8", "surrogatepass"))
            if rows:
                yield batch_of(rows, conv_type)
        if state is not None:
            yield batch_of([row(state)], conv_type)

    return ordered.mapInArrow(run, schema)
