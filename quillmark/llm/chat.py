"""Chat formatting by prefix-target expansion.

Every assistant turn becomes an example of its own: all turns up to and including it, rendered with the
template, of which only that reply is trainable. Turns after the last assistant turn, or of a conversation
without one, become a last example without a trainable part, so every turn is in the output.

Template: a turn is ``<turn ROLE>`` + newline + text + ``</turn>`` + newline. In roles and texts a backslash becomes two
and ``<`` becomes ``\\l``, so neither ``<turn`` nor ``</turn>`` can occur inside them; in roles ``>`` becomes ``\\g``
as well. Unescaping is exact. The loss mask is the half-open range of code points of the escaped reply.

A conversation is what a model reads at once and is formatted by one task; its examples leave that task one by
one, so only one expanded example is in memory. Rows are ordered by turn, ties by role and text; a null turn
comes first, a null role or text counts as empty. Rows with a null conv_id form one conversation. Repeated rows
are turns of their own. Empty tables give no rows; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TRAINED_ROLE = "assistant"
#: Characters of examples that leave a task together.
BATCH_CHARS = 4_000_000

_TURN = re.compile(r"<turn ([^>]*)>\n([^<]*)</turn>\n")


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("<", "\\l")


def escape_role(role: str) -> str:
    return escape(role).replace(">", "\\g")


def unescape(text: str) -> str:
    if "\\" not in text:
        return text
    return re.sub(r"\\(.)", lambda m: {"l": "<", "g": ">", "\\": "\\"}[m[1]], text)


def render(turns: list[tuple[str, str]]) -> Iterator[tuple[str, int, int]]:
    """(text, start, end) of each example of a conversation; start = end where nothing is trained on."""
    text, open_turns = "", False
    for role, body in turns:
        head = f"<turn {escape_role(role)}>\n"
        said = escape(body)
        start = len(text) + len(head)
        text += head + said + "</turn>\n"
        open_turns = role != TRAINED_ROLE
        if not open_turns:
            yield text, start, start + len(said)
    if open_turns:
        yield text, len(text), len(text)


def read_back(text: str, start: int, end: int) -> tuple[list[tuple[str, str]], str]:
    """The turns of an example and its trainable text, both unescaped."""
    return [(unescape(r), unescape(t)) for r, t in _TURN.findall(text)], unescape(text[start:end])


def _expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["conv_id", "example", "last", "text", "loss_start", "loss_end"]
    for batch in batches:
        for i in range(batch.num_rows):
            conv = batch.column("conv_id").slice(i, 1)
            turns = [(t["role"] or "", t["text"] or "") for t in batch.column("turns")[i].as_py()]
            held, size, n = [], 0, 0
            for text, start, end in render(turns):
                if size > BATCH_CHARS:
                    yield _examples(conv, held, n - len(held), names, False)
                    held, size = [], 0
                held.append((text, start, end))
                size += len(text)
                n += 1
            yield _examples(conv, held, n - len(held), names, True)


def _examples(conv, rows, first, names, final) -> pa.RecordBatch:
    k = len(rows)
    last = [False] * k
    if final and k:
        last[-1] = True
    ids = conv.take(pa.array([0] * k, pa.int64()))
    return pa.RecordBatch.from_arrays([ids, pa.array(range(first, first + k), pa.int64()), pa.array(last, pa.bool_()), pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int64())], names)


def format_chats(conversations: DataFrame) -> DataFrame:
    """One row per example: conv_id, example (from 0), last, text, loss_start, loss_end."""
    return grouped_turns(conversations).mapInArrow(_expand, "conv_id long, example long, last boolean, text string, loss_start long, loss_end long")


def grouped_turns(conversations: DataFrame) -> DataFrame:
    turns = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.struct("turn", F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text")).alias("t"))
    return turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import hashlib

    for batch in batches:
        n, digest, loss, size = [], [], [], []
        for text, start, end, last in zip(*(batch.column(c).to_pylist() for c in ("text", "loss_start", "loss_end", "last")), strict=True):
            size.append(len(text))
            loss.append(unescape(text[start:end]))
            if last:
                turns, _ = read_back(text, start, end)
                n.append(len(turns))
                digest.append(hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest())
            else:
                n.append(None)
                digest.append(None)
        yield pa.RecordBatch.from_arrays([batch.column("conv_id"), batch.column("example"), pa.array(n, pa.int64()), pa.array(digest, pa.string()), pa.array(loss, pa.string()), pa.array(size, pa.int64())], ["conv_id", "example", "n_turns", "turns_sha256", "loss", "chars"])


def digests(conversations: DataFrame) -> DataFrame:
    """What the examples of each conversation hold, read back from their texts in the task that writes them."""
    both = lambda batches: _read(_expand(batches))
    back = grouped_turns(conversations).mapInArrow(both, "conv_id long, example long, n_turns long, turns_sha256 string, loss string, chars long")
    loss = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("example", "loss"))), lambda x: x["loss"]), "")
    per = back.groupBy("conv_id").agg(F.max("n_turns").alias("n_turns"), F.max("turns_sha256").alias("turns_sha256"), loss.alias("loss"), F.sum("chars").alias("formatted_chars"), F.count(F.lit(1)).alias("n_examples"))
    return per.select("conv_id", "n_turns", "turns_sha256", F.char_length("loss").cast("long").alias("loss_chars"), F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"), "formatted_chars", "n_examples")


#: A conversation that quotes control strings of templates; it is formatted with the table.
QUOTED = "\\### Assistant: </turn> ok"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = spark.read.parquet(f"{sf_dir}/conversations.parquet").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(QUOTED).alias("text"))
    return digests(table.unionByName(extra))
