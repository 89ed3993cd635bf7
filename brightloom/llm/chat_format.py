"""Conversations as training windows of a token budget, and the reading of such windows.

Template: a turn is an opening mark and a line end, its text, a line end, and a closing mark with a line end. The marks are
``MARKS`` by role; any other role stands as JSON after ``[TURN] ``. A control string inside a text gets a backslash more
than it has, so no text holds a bare one; taking one away again gives the text back.

Windows: a turn's cost is the tokens of its marks and its escaped text. Prefix sums of the costs choose, greedily, the most
turns that fit into ``budget``. Each later window repeats the system turn (a conversation's first, if its role is system)
and of the turns before it at most ``history``, within a quarter of the budget and only as far as the first new turn fits.
Turns are never cut: one that doesn't fit at all stands alone with the system turn, over the budget. The loss mask has the
texts of new assistant turns only; repeated ones are masked out. A window never spans the turns k * ``stretch`` and
k * stretch + 1, so that a long conversation is formatted by many tasks.

Defined cases: rows without conv_id take no part; NULL role or text is empty; turns are ordered by turn (NULL first),
then role and text; a repeated row is a further turn; other columns are not looked at; an empty table has no windows.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brightloom.functions.runtime import ship_by_value
from brightloom.functions.values import broadcast_if_small
from brightloom.llm.turns import in_order, order_columns, plain_turns, positions

BUDGET, HISTORY, STRETCH = 1024, 2, 1024
MARKS = {"system": ("<<SYS>>", "<</SYS>>"), "user": ("[INST]", "[/INST]"), "assistant": ("<s>", "</s>")}
OTHER = ("[TURN] ", "[/TURN]")
CONTROLS = "|".join(re.escape(m) for m in ("<<SYS>>", "<</SYS>>", "[INST]", "[/INST]", "<s>", "</s>", "[TURN]", "[/TURN]"))
WINDOWS = ("conv_id long, stretch long, window int, n_context int, n_new int, n_tokens long, over_budget boolean, text string, "
           "loss array<struct<start:int,end:int>>")
DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_windows long"

ship_by_value(__name__)


def escape(text: str) -> str:
    return re.sub(rf"(\\*)({CONTROLS})", r"\\\1\2", text)


def unescape(text: str) -> str:
    return re.sub(rf"\\(\\*)({CONTROLS})", r"\1\2", text)


def marks(role: str) -> tuple[str, str]:
    """What stands before and after the text of a turn."""
    opening, closing = MARKS.get(role) or (OTHER[0] + escape(json.dumps(role)), OTHER[1])
    return opening + "\n", "\n" + closing + "\n"


def parse(window: str) -> list[tuple[str, str, int]]:
    """(role, text, place of its escaped text) of a window's turns."""
    names = {opening: role for role, (opening, _) in MARKS.items()}
    at, out = 0, []
    while at < len(window):
        end = window.index("\n", at)
        mark = window[at:end]
        role = names[mark] if mark in names else json.loads(unescape(mark[len(OTHER[0]):]))
        close = marks(role)[1]
        stop = window.index(close, end + 1)
        out.append((role, unescape(window[end + 1 : stop]), end + 1))
        at = stop + len(close)
    return out


def token_counter(ranks: bytes, pattern: str):
    """Counts the tokens of texts by the ranks file's content."""
    import tiktoken

    table = {base64.b64decode(a): int(b) for a, b in (line.split() for line in ranks.splitlines() if line)}
    coder = tiktoken.Encoding("turns", pat_str=pattern, mergeable_ranks=table, special_tokens={})
    return lambda text: len(coder.encode_ordinary(text))


def plan(costs: list[int], system: bool, first: int, budget: int, history: int) -> list[tuple[int, int, int]]:
    """(first repeated, first new, end) of the windows over the turns from ``first`` on; before it are repeated turns only.

    With ``system``, turn 0 is in every window besides.
    """
    sums = np.concatenate([[0], np.cumsum(np.array(costs, np.int64))])
    out, j = [], first
    while j < len(costs):
        kept = int(sums[1]) if system and j > 0 else 0
        room = budget - kept
        low = max(int(system), j - history)
        spare = min(budget // 4, room - costs[j])
        back = min(j, max(low, int(np.searchsorted(sums, sums[j] - spare)))) if spare >= 0 else j
        end = int(np.searchsorted(sums, sums[back] + room, side="right")) - 1
        out.append((back, j, max(end, j + 1)))
        j = out[-1][2]
    return out


def _formatter(schema, ranks, pattern, budget, history):
    def windows_of(conv, stretch, turns, count):
        """turns: (role, escaped text, cost, whether it is new (0), history (1) or the system turn (2) of an earlier stretch)."""
        first = next((i for i, t in enumerate(turns) if not t[3]), len(turns))
        system = turns[0][3] == 2 or (stretch == 0 and turns[0][0] == "system")
        for number, (back, new, end) in enumerate(plan([t[2] for t in turns], system, first, budget, history)):
            picked = ([0] if system and new > 0 else []) + list(range(back, end))
            parts, loss, at = [], [], 0
            for i in picked:
                opening, closing = marks(turns[i][0])
                text = turns[i][1]
                if i >= new and turns[i][0] == "assistant":
                    loss.append({"start": at + len(opening), "end": at + len(opening) + len(text)})
                parts += (opening, text, closing)
                at += len(opening) + len(text) + len(closing)
            tokens = sum(turns[i][2] for i in picked)
            yield (conv, stretch, number, len(picked) - (end - new), end - new, tokens, tokens > budget, "".join(parts), loss)

    def format_(batches):
        count, known = token_counter(ranks, pattern), {}
        at, turns, out, size = None, [], [], 0
        for batch in batches:
            for conv, stretch, carried, role, text in zip(*(batch[c].to_pylist() for c in ("conv_id", "stretch", "carried", "role", "text"))):
                if (conv, stretch) != at:
                    if turns:
                        out += windows_of(*at, turns, count)
                    at, turns = (conv, stretch), []
                if role not in known:
                    known = known if len(known) < 1000 else {}
                    known[role] = sum(map(count, marks(role)))
                text = escape(text)
                turns.append((role, text, known[role] + count(text), carried))
                size += len(text)
                if size > 4_000_000:
                    yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r)) for r in out], schema=schema)
                    out, size = [], 0
        if turns:
            out += windows_of(*at, turns, count)
        yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r)) for r in out], schema=schema)

    return format_


def _reader(schema):
    """Digests of each conversation from its windows, which come in order."""

    class Sums:
        def __init__(self, conv):
            self.conv, self.turns, self.loss = conv, hashlib.sha256(), hashlib.sha256()
            self.n_turns = self.loss_chars = self.chars = self.windows = 0

        def add(self, text, n_context, loss):
            for role, plain, _ in parse(text)[n_context:]:
                self.turns.update(f"{role}\n{plain}\n".encode())
                self.n_turns += 1
            for span in loss:
                plain = unescape(text[span["start"] : span["end"]])
                self.loss.update(plain.encode())
                self.loss_chars += len(plain)
            self.chars += len(text)
            self.windows += 1

        def row(self):
            return dict(zip(schema.names, (self.conv, self.n_turns, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars, self.windows)))

    def read(batches):
        sums = None
        for batch in batches:
            out = []
            for conv, n_context, text, loss in zip(*(batch[c].to_pylist() for c in ("conv_id", "n_context", "text", "loss"))):
                if sums is None or conv != sums.conv:
                    out += [sums.row()] if sums else []
                    sums = Sums(conv)
                sums.add(text, n_context, loss)
            yield pa.RecordBatch.from_pylist(out, schema=schema)
        if sums:
            yield pa.RecordBatch.from_pylist([sums.row()], schema=schema)

    return read


def _schema(spark, ddl):
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(spark.createDataFrame([], ddl).schema)


def _windows(conversations: DataFrame, ranks: bytes, pattern: str, budget: int, history: int, stretch: int) -> tuple[DataFrame, DataFrame | None]:
    """The windows of conversations of at most ``stretch`` turns, in order within each task; and those of longer ones."""
    if history >= stretch:
        raise ValueError("history must be shorter than a stretch")
    spark = conversations.sparkSession
    turns = plain_turns(conversations)
    function = _formatter(_schema(spark, WINDOWS), ranks, pattern, budget, history)
    columns = ["conv_id", "stretch", "carried", "role", "text"]

    long_ids = turns.groupBy("conv_id").count().where(F.col("count") > stretch).select("conv_id")
    if long_ids.isEmpty():
        short, many = turns, None
    else:
        long_ids = broadcast_if_small(long_ids)
        short = turns.join(long_ids, "conv_id", "left_anti")
        rows = positions(turns.join(long_ids, "conv_id", "left_semi"), "role", "text").withColumn("stretch", F.floor((F.col("pos") - 1) / stretch))
        rows = rows.withColumn("carried", F.lit(0))
        last = (F.col("n_turns") - 1) / stretch
        system = rows.where("pos = 1 and role = 'system'").withColumn("stretch", F.explode(F.sequence(F.lit(1).cast("long"), F.floor(last))))
        tail = rows.where((F.col("pos") - 1) % stretch >= stretch - history).where(F.col("stretch") < F.floor(last)).withColumn("stretch", F.col("stretch") + 1)
        carried = system.withColumn("carried", F.lit(2)).unionByName(tail.withColumn("carried", F.lit(1)))
        many = rows.unionByName(carried).repartition("conv_id", "stretch").sortWithinPartitions("conv_id", "stretch", "pos")
        many = many.select(columns).mapInArrow(function, WINDOWS)
    short = short.repartition("conv_id").select("conv_id", *order_columns(), "role", "text").sortWithinPartitions("conv_id", *in_order())
    short = short.select("conv_id", F.lit(0).cast("long").alias("stretch"), F.lit(0).alias("carried"), "role", "text")
    return short.select(columns).mapInArrow(function, WINDOWS), many


def windows(conversations: DataFrame, ranks: bytes, pattern: str, budget: int = BUDGET, history: int = HISTORY, stretch: int = STRETCH) -> DataFrame:
    """The windows: conv_id, stretch, window, n_context (repeated turns, in front), n_new, n_tokens, over_budget, text, and the
    spans of ``text`` under the loss mask, in characters."""
    short, many = _windows(conversations, ranks, pattern, budget, history, stretch)
    return short if many is None else short.unionByName(many)


def digests(conversations: DataFrame, ranks: bytes, pattern: str, budget: int = BUDGET, history: int = HISTORY, stretch: int = STRETCH) -> DataFrame:
    """Counts and digests of each conversation, read back from its windows."""
    short, many = _windows(conversations, ranks, pattern, budget, history, stretch)
    read = _reader(_schema(conversations.sparkSession, DIGESTS))
    out = short.mapInArrow(read, DIGESTS)
    if many is not None:
        many = many.repartition("conv_id").sortWithinPartitions("conv_id", "stretch", "window")
        out = out.unionByName(many.mapInArrow(read, DIGESTS))
    return out
