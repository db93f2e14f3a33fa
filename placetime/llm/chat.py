"""Conversations as formatted text with a loss mask, and back."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator, Mapping, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placetime.llm.ordered import places
from placetime.llm.tables import Tables
from placetime.llm.templates import compile_template

#: Strings that mark turns. None but its first character may begin another one, so matches never overlap.
CONTROLS = ("<s>", "</s>", "[INST]", "[/INST]", "<|text|>")

TEMPLATE = """\
{{ "<s>" }}
{%- for turn in turns -%}
  {%- if turn.role == "assistant" -%}
    {%- generation -%}{{ turn.text | escape }}{%- endgeneration -%}{{ "</s>" }}
  {%- else -%}
    {{ "[INST]" }}{{ turn.role | escape }}{{ "<|text|>" ~ "" }}{{ turn.text | escape }}{{ "[/INST]" }}
  {%- endif -%}
{%- endfor -%}
"""

PIECES = "conv_id long, index long, piece string, spans array<struct<start: int, end: int>>"


class Escapes:
    """Control strings inside texts, made harmless by a backslash after their first character.

    A control string with n backslashes there becomes one with n + 1, and back, so any text comes back as it was and
    texts without control strings stay as they are.
    """

    def __init__(self, controls: Sequence[str] = CONTROLS):
        firsts = {control[:1] for control in controls}
        if "" in firsts or "\\" in "".join(controls) or any(set(control[1:]) & firsts for control in controls):
            raise ValueError("a control string holds a backslash, or a first character of one in its midst")
        ends = "|".join(re.escape(first) + r"\\{}" + f"(?:{'|'.join(re.escape(c[1:]) for c in controls if c[0] == first)})" for first in sorted(firsts))
        self._plain = re.compile(ends.format(*["*"] * len(firsts))) if controls else None
        self._escaped = re.compile(ends.format(*["+"] * len(firsts))) if controls else None

    def escape(self, text: str) -> str:
        return self._plain.sub(lambda m: m[0][0] + "\\" + m[0][1:], text) if self._plain else text

    def unescape(self, text: str) -> str:
        return self._escaped.sub(lambda m: m[0][0] + m[0][2:], text) if self._escaped else text


def render(
    conversations: DataFrame, template: str = TEMPLATE, controls: Sequence[str] = CONTROLS, variables: Mapping[str, str] | None = None
) -> DataFrame:
    """(conv_id, index, piece, spans): a row per turn; a conversation's text is its pieces in the order of `index`.

    `spans` are the parts of a piece that are generated (start and end in code points): the loss mask. The
    template (see `templates`) sees `turn.role` and `turn.text`, a null being "", and `escape` for
    `controls`. Turns go by `turn`, nulls first; rows with the same number by role and a hash of the text. Rows
    without a conv_id are one conversation. Repeated rows are turns each. Conversations of any
    length spread over tasks; a text of any length is one string. Other columns don't matter.
    An empty table has no pieces.
    """
    tables = Tables(conversations.sparkSession, "chat")
    compile_template(template, {"escape": str})  # a bad template fails here
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").alias("turn"),
        F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"),
    ).withColumn("text_hash", F.xxhash64("text"))
    order = [F.col("turn").asc_nulls_first(), F.col("role"), F.col("text_hash")]
    turns = places(rows, "conv_id", order, tables).select("conv_id", "index", "total", "role", "text")
    names = dict(variables or {})

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled = compile_template(template, {"escape": Escapes(controls).escape})
        for batch in batches:
            pieces, spans = [], []
            columns = [batch.column(name).to_pylist() for name in ("index", "total", "role", "text")]
            for index, total, role, text in zip(*columns):
                out = compiled.render({"role": role, "text": text}, index, total, names)
                pieces.append("".join(out.parts))
                spans.append([{"start": start, "end": end} for start, end in out.spans])
            marks = pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))
            yield pa.RecordBatch.from_arrays(
                [batch.column("conv_id"), batch.column("index"), pa.array(pieces, pa.string()), marks], ["conv_id", "index", "piece", "spans"]
            )

    return turns.mapInArrow(task, PIECES)


#: One turn of `TEMPLATE`: a prompt's role and text, or a reply.
TURN = re.compile(r"\[INST\](.*?)<\|text\|>(.*?)\[/INST\]|(.*?)</s>", re.S)


def parsed(formatted: str, escapes: Escapes) -> Iterable[tuple[str, str]]:
    """(role, text) of each turn that `TEMPLATE` wrote, read from the formatted text alone."""
    at = 0
    while at < len(formatted):
        if formatted.startswith("<s>", at):
            at += len("<s>")
        found = TURN.match(formatted, at)
        if found is None:
            raise ValueError("not a text of this template")
        role, text, reply = found.groups()
        yield ("assistant", escapes.unescape(reply)) if role is None else (escapes.unescape(role), escapes.unescape(text))
        at = found.end()


DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def read_back(pieces: DataFrame, controls: Sequence[str] = CONTROLS) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars) from pieces that `TEMPLATE` wrote.

    Turns are read from the formatted text, the loss from the spans, and unescaped. Digests are those of
    role, line end, text, line end of all turns, and of all text under the mask. A digest runs through a
    conversation in order, so each conversation's pieces pass one task, one by one: memory holds one piece.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        escapes = Escapes(controls)
        current: object = task  # no conversation yet; None is one
        n, turns, loss_chars, loss, chars = 0, hashlib.sha256(), 0, hashlib.sha256(), 0
        schema = pa.schema([
            ("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()),
            ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()),
        ])
        done: list[tuple] = []
        for batch in batches:
            for conv_id, piece, spans in zip(*(batch.column(name).to_pylist() for name in ("conv_id", "piece", "spans"))):
                if conv_id != current:
                    if current is not task:
                        done.append((current, n, turns.hexdigest(), loss_chars, loss.hexdigest(), chars))
                    current = conv_id
                    n, turns, loss_chars, loss, chars = 0, hashlib.sha256(), 0, hashlib.sha256(), 0
                for role, text in parsed(piece, escapes):
                    n += 1
                    turns.update(f"{role}\n{text}\n".encode())
                for span in spans:
                    text = escapes.unescape(piece[span["start"] : span["end"]])
                    loss_chars += len(text)
                    loss.update(text.encode())
                chars += len(piece)
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done), schema)], schema=schema)
                done = []
        if current is not task:
            done.append((current, n, turns.hexdigest(), loss_chars, loss.hexdigest(), chars))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done), schema)], schema=schema)

    ordered = pieces.repartition("conv_id").sortWithinPartitions("conv_id", "index")
    return ordered.mapInArrow(task, DIGESTS)
