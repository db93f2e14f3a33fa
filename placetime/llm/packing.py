"""Packing documents into training sequences: harmonic classes, filled by each worker on its own."""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placetime.llm.tokenizing import ByteBpe

SCHEMA = (
    "{key} {type}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, sequence_tokens long"
)
ROWS_OUT = 2000
BYTES_OUT = 4 << 20


#: Documents of up to 1 / (CLASSES + 1) of the capacity have no class of their own; they fill what classes leave.
CLASSES = 12
#: Bins of a task that may wait for documents that fit into what is left of them.
WAITING = 64


def class_of(length: int, capacity: int) -> int:
    """The class j of a length: j documents of it fill a bin, as it lies between 1 / (j + 1) and 1 / j of the capacity.
    0 for small documents."""
    j = capacity // length
    return j if j <= CLASSES else 0


class _Bins:
    """One worker's bins. An item is (document, start, ids, tokens of the document).

    A bin of class j takes j items of that class. What is left of it waits for items that fit whole: small ones, or
    failing that one item is cut to fill the rest to the last token. Memory holds at most
    `WAITING` bins, j - 1 items of each class and small items of one bin.
    """

    def __init__(self, capacity: int, first_id: int):
        self.capacity, self.next_id = capacity, first_id
        self.open: dict[int, list[tuple]] = {j: [] for j in range(1, CLASSES + 1)}
        self.waiting: list[tuple[int, int, list[tuple]]] = []  # (room, number, items), least room first
        self.small: list[tuple] = []
        self.small_tokens = self.number = 0

    def _sequence(self, items: list[tuple]) -> Iterator[tuple]:
        whole, offset = sum(len(item[2]) for item in items), 0
        for doc, start, ids, tokens in items:
            yield doc, start, len(ids), ids.tobytes(), tokens, self.next_id, offset, whole
            offset += len(ids)
        self.next_id += 1

    @staticmethod
    def _cut(item: tuple, at: int) -> tuple[tuple, tuple]:
        doc, start, ids, tokens = item
        return (doc, start, ids[:at], tokens), (doc, start + at, ids[at:], tokens)

    def add(self, doc, ids: np.ndarray) -> Iterator[tuple]:
        """Takes a document in; gives the pieces of sequences that got full. Only what exceeds the capacity is cut here."""
        rest = (doc, 0, ids, len(ids))
        while len(rest[2]) >= self.capacity:
            piece, rest = self._cut(rest, self.capacity)
            yield from self._sequence([piece])
        if len(rest[2]):
            yield from self._place(rest)

    def _place(self, item: tuple) -> Iterator[tuple]:
        n = len(item[2])
        j = class_of(n, self.capacity)
        if not j:
            yield from self._fill(item)
            return
        items = self.open[j]
        items.append(item)
        if len(items) == j:
            self.open[j] = []
            yield from self._leave(items, self.capacity - sum(len(i[2]) for i in items))
            while len(self.waiting) > WAITING:
                yield from self._force()

    def _leave(self, items: list[tuple], room: int) -> Iterator[tuple]:
        if room == 0:
            yield from self._sequence(items)
        else:
            self.number += 1
            bisect.insort(self.waiting, (room, self.number, items))

    def _fill(self, item: tuple) -> Iterator[tuple]:
        """A small item goes whole into the tightest waiting bin; without one, items that make up a bin wait together."""
        n = len(item[2])
        at = bisect.bisect_left(self.waiting, (n, 0, []))
        if at < len(self.waiting):
            room, _, items = self.waiting.pop(at)
            yield from self._leave([*items, item], room - n)
            return
        self.small.append(item)
        self.small_tokens += n
        if self.small_tokens >= self.capacity:
            last = self.small.pop()
            room = self.capacity - (self.small_tokens - n)
            piece, rest = self._cut(last, room)
            items, self.small, self.small_tokens = [*self.small, piece], [], 0
            yield from self._sequence(items)
            if len(rest[2]):
                yield from self._fill(rest)

    def _force(self) -> Iterator[tuple]:
        """Fills the tightest waiting bin by cutting an item: a small one, or else one of the smallest class at hand."""
        room, _, items = self.waiting.pop(0)
        while room:
            if self.small:
                item = self.small.pop()
                self.small_tokens -= len(item[2])
            else:
                j = max((j for j, held in self.open.items() if held), default=0)
                item = self.open[j].pop() if j else None
            if item is None:  # nothing at hand: the roomiest bin is taken apart
                _, _, (item, *others) = self.waiting.pop()
                for other in others:
                    yield from self._place(other)
            piece, rest = self._cut(item, min(room, len(item[2])))
            items, room = [*items, piece], room - len(piece[2])
            if len(rest[2]):
                yield from self._place(rest)
        yield from self._sequence(items)

    def rest(self) -> Iterator[tuple]:
        """What stays open in the end is put together, cut where a sequence is full; the last tokens become
        sequences whose lengths are powers of two, which need no padding."""
        items = [item for _, _, held in self.waiting for item in held]
        items += [item for held in self.open.values() for item in held] + self.small
        sequence: list[tuple] = []
        left = sum(len(item[2]) for item in items)
        size = room = self._length(left)
        for item in items:
            while len(item[2]):
                piece, item = self._cut(item, min(room, len(item[2])))
                sequence.append(piece)
                room -= len(piece[2])
                if room == 0:
                    yield from self._sequence(sequence)
                    sequence, left = [], left - size
                    size = room = self._length(left)

    def _length(self, left: int) -> int:
        return self.capacity if left >= self.capacity else 1 << max(left.bit_length() - 1, 0)


def pack(
    docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text",
    added_tokens: bool = False,
) -> DataFrame:
    """Packs documents into sequences of at most `capacity` tokens; one row per piece.

    A document is its ids (see `ByteBpe` for `added_tokens`) and then `end_id`. Lengths fall into classes by
    the reciprocal parts of the capacity (1, 1/2, 1/3, ...) that they come up to; a bin of the class 1/j takes j documents,
    whole, and what they leave of it is filled with small documents. A document is cut where it exceeds the
    capacity, and one now and then to fill a bin to the last token. Each task fills its own bins in the order of its
    rows and holds few of them, so there is no shuffle and nothing to agree on; a task run again
    gives sequences of the same kind under ids of its own. What is left open at a task's end is put together;
    its last tokens become sequences whose length is a power of two, which need no padding.

    Returns the id column, start (ids of the document before the piece), length, ids (unsigned
    little-endian 32-bit), doc_tokens, sequence_id, offset (in the sequence, without gaps) and
    sequence_tokens. Null or empty texts are one `end_id`. Repeated rows and repeated or null ids
    are documents of their own. Other columns don't matter. An empty table gives no rows.
    """
    key_type = dict(docs.dtypes)[id_col]
    schema = SCHEMA.format(key=id_col, type=key_type)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = ByteBpe(tokenizer, added_tokens)
        bins = _Bins(capacity, TaskContext.get().partitionId() << 40)
        out: list[tuple] = []
        kinds: pa.Schema | None = None
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal size
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds.types)], schema=kinds)
                out.clear()
                size = 0

        for batch in batches:
            if kinds is None:
                whole = pa.int64()
                kinds = pa.schema(
                    [(id_col, batch.schema.field(0).type), ("start", whole), ("length", whole), ("ids", pa.binary()),
                     ("doc_tokens", whole), ("sequence_id", whole), ("offset", whole), ("sequence_tokens", whole)]
                )
            for i in range(batch.num_rows):
                text = batch.column(1)[i].as_py() or ""
                ids = np.append(encoder.ids(text), np.array([end_id], "<u4"))
                for piece in bins.add(batch.column(0)[i].as_py(), ids):
                    out.append(piece)
                    size += len(piece[3])
                    if len(out) >= ROWS_OUT or size >= BYTES_OUT:
                        yield from flush()
        out.extend(bins.rest())
        yield from flush()

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, schema)
