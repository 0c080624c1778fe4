"""Packing documents into sequences of bounded length: minimum bin slack."""

from __future__ import annotations

from bisect import bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from curbside.llm.text import slices, word_encoder

SCHEMA = "doc_id bigint, start bigint, length bigint, ids binary, doc_tokens bigint, sequence_id bigint, offset bigint"


def fill_window(room: int, counts: dict[int, int], lengths: list[int]) -> dict[int, int]:
    """The multiset out of `counts` (length: how many are left) whose sum is nearest to `room` from below.

    Bit s of `reach` says that some multiset sums to s. Every step adds a power of two of one length, and
    the steps are walked back to find how often each length was taken. `lengths`: the keys in order.
    """
    mask, goal = (1 << (room + 1)) - 1, 1 << room
    reach, steps = 1, []
    for length in reversed(lengths[: bisect_right(lengths, room)]):
        left, take = min(counts[length], room // length), 1
        while left and not reach & goal:
            take = min(take, left)
            steps.append((reach, length, take))
            reach |= (reach << (length * take)) & mask
            left -= take
            take *= 2
        if reach & goal:
            break
    total, chosen = reach.bit_length() - 1, {}
    for before, length, take in reversed(steps):
        if not before >> total & 1:
            total -= length * take
            chosen[length] = chosen.get(length, 0) + take
    return chosen


class Packer:
    """Pieces (document, start, length) laid into windows of `capacity` tokens.

    Each window gets the longest piece that is left and the multiset that leaves least slack; the same
    multiset is used again while its lengths last. What slack remains is filled by cutting a piece. So
    only the last window may stay open: it is kept for the next call, or cut into powers of two at the end.
    """

    def __init__(self, capacity: int):
        self.capacity, self.pieces, self.lengths = capacity, {}, []

    def add(self, document: int, start: int, length: int) -> None:
        if length not in self.pieces:
            self.pieces[length] = []
            insort(self.lengths, length)
        self.pieces[length].append((document, start))

    def _take(self, length: int) -> tuple[int, int, int]:
        kept = self.pieces[length]
        document, start = kept.pop()
        if not kept:
            del self.pieces[length]
            del self.lengths[bisect_right(self.lengths, length) - 1]
        return document, start, length

    def windows(self, last: bool) -> Iterator[list[tuple[int, int, int]]]:
        while self.lengths:
            longest = self.lengths[-1]
            counts = {x: len(self.pieces[x]) for x in self.lengths}
            counts[longest] -= 1
            chosen = fill_window(self.capacity - longest, counts, self.lengths)
            chosen[longest] = chosen.get(longest, 0) + 1
            slack = self.capacity - sum(k * n for k, n in chosen.items())
            for _ in range(1 if slack else min(len(self.pieces[k]) // n for k, n in chosen.items())):
                window = [self._take(k) for k, n in chosen.items() for _ in range(n)]
                if slack and self.lengths:
                    document, start, length = self._take(self.lengths[-1])
                    window.append((document, start, slack))
                    self.add(document, start + slack, length - slack)
                elif slack and not last:
                    for piece in window:
                        self.add(*piece)
                    return
                if slack and sum(x[2] for x in window) < self.capacity:
                    yield from self.powers(window)
                else:
                    yield window

    @staticmethod
    def powers(window: list[tuple[int, int, int]]) -> Iterator[list[tuple[int, int, int]]]:
        """The pieces cut into sequences whose lengths are the powers of two in their sum."""
        left, queue = sum(x[2] for x in window), window[::-1]
        while left:
            room, out = 1 << (left.bit_length() - 1), []
            left -= room
            while room:
                document, start, length = queue.pop()
                used = min(room, length)
                out.append((document, start, used))
                room -= used
                if used < length:
                    queue.append((document, start + used, length - used))
            yield out


def pack_documents(
    docs: DataFrame, tokenizer: str, capacity: int = 4096, end_id: int = 2, buffer: int = 1 << 22
) -> DataFrame:
    """Sequences of at most `capacity` tokens out of `docs` (doc_id, text).

    A document's tokens are its ids by `tokenizer` (a file that every executor has), then `end_id`; null text
    is empty, so it gives `end_id` alone. Full windows of a document are sequences by themselves; what is
    left of each document is packed by minimum bin slack, within its task and `buffer` tokens at a time.
    No row moves between tasks. Every sequence is full, except that each task ends with up to
    log2(capacity) sequences whose lengths are powers of two, so nothing is ever padded.

    One row for each piece: `ids` holds its ids as little-endian unsigned 32-bit integers, `start` the
    document's tokens before it, `offset` its place in its sequence. Repeated rows are packed each.
    Other columns of `docs` are not read. An empty table gives no rows.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, packer = word_encoder(tokenizer), Packer(capacity)
        types = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
        held: list[tuple[object, np.ndarray]] = []  # documents with pieces not yet laid out
        waiting, sequence = 0, TaskContext.get().partitionId() << 33

        def batch_of(out: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*out), types)],
                names=["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"],
            )

        def rows(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held, sequence
            out = []
            for window in packer.windows(last):
                offset = 0
                for document, start, length in window:
                    doc_id, ids = held[document]
                    out.append((doc_id, start, length, ids[start : start + length].tobytes(), len(ids), sequence, offset))
                    offset += length
                sequence += 1
                if len(out) >= 1024:
                    yield batch_of(out)
                    out = []
            if out:
                yield batch_of(out)
            open_pieces = [(d, s, n) for n, kept in packer.pieces.items() for d, s in kept]
            renamed = {d: i for i, d in enumerate(dict.fromkeys(d for d, _, _ in open_pieces))}
            held = [held[d] for d in renamed]
            packer.pieces, packer.lengths = {}, []
            for d, s, n in open_pieces:
                packer.add(renamed[d], s, n)

        for batch in batches:
            for part in slices(batch):
                offsets, ids = encoder.encode(part.column("text"))
                for row, doc_id in enumerate(part.column("doc_id").to_pylist()):
                    own = np.append(ids[offsets[row] : offsets[row + 1]], np.uint32(end_id)).astype("<u4")
                    for start in range(0, len(own), capacity):
                        packer.add(len(held), start, min(capacity, len(own) - start))
                    held.append((doc_id, own))
                    waiting += len(own)
                    if waiting >= buffer:
                        yield from rows(False)
                        waiting = 0
        yield from rows(True)

    return docs.select(docs["doc_id"].cast("bigint").alias("doc_id"), "text").mapInArrow(pack, SCHEMA)
