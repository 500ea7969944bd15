"""Sum-of-squares online packing of tokenised documents into fixed windows.

Each task packs the documents of its own partition as they stream by, so nothing is shuffled and
memory is bounded by the open windows.  N[h] counts the open windows filled to level h; a piece of
s tokens goes to the level h (or a new window) that makes the sum of N[h]^2 smallest.  A document
longer than a window first fills whole windows.  The pieces of windows that are open when a task ends
go to the next round, where fewer tasks place them by the same rule, until one task is left or a round
completes next to no windows.  Only what is then open is laid end to end and cut into full windows,
and the rest into windows of falling powers of two, which need no padding.
"""

from __future__ import annotations

import base64
import functools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cubeflow.llm.common import cut, small_batches

CAPACITY = 2048
END_ID = 1
#: So many windows are open at most in a task, beyond it their pieces go to the next round; and so many to a task there.
MOST_OPEN = 4096
#: A sequence's number is the round's, the task's and its own in the task.
SEQUENCE_BITS, TASK_BITS = 33, 20
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, sequence_tokens long, padded_tokens long, ids array<int>"


@functools.cache
def encoder(ranks_path: str, pattern: str):
    """The byte-level BPE of a rank file; its strings for special tokens keep their ids, as in the tokenizers library."""
    import tiktoken

    with open(ranks_path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("bpe", pat_str=pattern, mergeable_ranks=ranks, special_tokens={"<|endoftext|>": len(ranks)})


class Packer:
    """Level array and open windows of one task; ``add`` and ``settle`` yield finished windows, lists of (doc, start, ids, doc_tokens)."""

    def __init__(self, capacity: int = CAPACITY) -> None:
        self.capacity, self.count = capacity, np.zeros(capacity + 1, dtype=np.int64)
        self.open: list[list[list]] = [[] for _ in range(capacity)]
        self.n_open = 0

    def level_for(self, size: int) -> int:
        """The level (0: a new window) whose choice leaves the smallest sum of squared counts; among equals the fullest."""
        n, top = self.count, self.capacity - size
        cost = 2 * (n[1 + size : self.capacity + 1] - n[1 : top + 1]) + 2
        if top:
            cost[-1] = 1 - 2 * n[top]  # the window is full and leaves the array
            cost[n[1 : top + 1] == 0] = np.iinfo(np.int64).max
        new = 2 * n[size] + 1 if top else 0
        if not top or not len(cost):
            return 0
        best = len(cost) - 1 - int(np.argmin(cost[::-1]))
        return best + 1 if cost[best] <= new else 0

    def add(self, doc, ids: np.ndarray) -> Iterator[list]:
        total, start = len(ids), 0
        while total - start >= self.capacity:
            yield [(doc, start, ids[start : start + self.capacity], total)]
            start += self.capacity
        if start < total:
            yield from self.place((doc, start, ids[start:], total))

    def place(self, piece: tuple) -> Iterator[list]:
        """A piece of fewer tokens than a window's."""
        size = len(piece[2])
        level = self.level_for(size)
        window = self.open[level].pop() if level else []
        self.n_open -= bool(level)
        self.count[level] -= bool(level)
        window.append(piece)
        if level + size == self.capacity:
            yield window
            return
        self.open[level + size].append(window)
        self.count[level + size] += 1
        self.n_open += 1

    def drain(self) -> list[list]:
        """The open windows, the fullest first; none are open then."""
        out = [window for level in reversed(self.open) for window in level]
        self.__init__(self.capacity)
        return out

    def settle(self) -> Iterator[list]:
        pieces = [p for window in self.drain() for p in window]
        left = sum(len(p[2]) for p in pieces)
        window, room = [], 0
        for doc, start, ids, total in pieces:
            done = 0
            while done < len(ids):
                if not room:
                    room = self.capacity if left >= self.capacity else 1 << (left.bit_length() - 1)
                part = ids[done : done + room]
                window.append((doc, start + done, part, total))
                done, room, left = done + len(part), room - len(part), left - len(part)
                if not room:
                    yield window
                    window = []


class Output:
    """Arrow batches of the pieces of finished and, marked ``left``, of open windows."""

    names = [f.split()[0] for f in SCHEMA.split(", ")] + ["left"]
    kinds = [pa.int64()] * 9 + [pa.list_(pa.int32()), pa.bool_()]

    def __init__(self, number: int, capacity: int, keep_ids: bool) -> None:
        self.first = (number << TASK_BITS | TaskContext.get().partitionId()) << SEQUENCE_BITS
        self.made, self.rows, self.capacity, self.keep_ids = 0, [], capacity, keep_ids

    def put(self, window: list, left: bool = False) -> None:
        total, offset = sum(len(p[2]) for p in window), 0
        padded = total if total & (total - 1) == 0 else self.capacity
        for doc, start, ids, tokens in window:
            self.rows.append((doc, start, len(ids), zlib.crc32(ids.tobytes()), tokens, self.first + self.made, offset, total, padded, ids if self.keep_ids or left else None, left))
            offset += len(ids)
        self.made += 1

    def flush(self, least: int = 1) -> Iterator[pa.RecordBatch]:
        if len(self.rows) >= least:
            yield pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(zip(*self.rows), self.kinds)], names=self.names)
            self.rows.clear()


def pack(docs: DataFrame, ranks_path: str | None = None, pattern: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID, keep_ids: bool = False) -> DataFrame:
    """One row per piece of a document: (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, sequence_tokens, padded_tokens, ids).

    The input needs doc_id and text; other columns are not read.  A document's ids are those of
    its text and then ``end_id``; a null text counts as empty, so it still is one token.  Rows with
    equal or null doc_id are packed each on its own.  An empty table gives no rows.  ``ids`` is
    null unless ``keep_ids``.
    """
    import public_tokenizers

    small_batches(docs.sparkSession)
    ranks_path = ranks_path or public_tokenizers.path("byte_bpe_50k.tiktoken")
    pattern = pattern or public_tokenizers.PATTERN
    schema, flush_rows = SCHEMA + ", left boolean", 8192

    def first_round(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, packer, out = encoder(ranks_path, pattern), Packer(capacity), Output(0, capacity, keep_ids)
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = bpe.encode(text.as_py() or "", allowed_special="all")
                ids.append(end_id)
                for window in packer.add(doc, np.array(ids, dtype="<u4")):
                    out.put(window)
                if packer.n_open >= MOST_OPEN:
                    for window in packer.drain():
                        out.put(window, left=True)
                yield from out.flush(flush_rows)
        for window in packer.drain():
            out.put(window, left=True)
        yield from out.flush()

    def next_round(number: int, last: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            packer, out = Packer(capacity), Output(number, capacity, keep_ids)
            for batch in batches:
                for doc, start, ids, tokens in zip(*[batch.column(n).to_pylist() for n in ("doc_id", "start", "ids", "doc_tokens")]):
                    for window in packer.place((doc, start, np.array(ids, dtype="<u4"), tokens)):
                        out.put(window)
                    if packer.n_open >= MOST_OPEN and not last:
                        for window in packer.drain():
                            out.put(window, left=True)
                yield from out.flush(flush_rows)
            for window in packer.settle() if last else packer.drain():
                out.put(window, left=not last)
            yield from out.flush()

        return run

    done, number = [], 0
    rows = cut(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(first_round, schema), "packed")
    windows, before = rows.where("left and offset = 0").count(), None
    while windows:
        done.append(rows.where("not left"))
        number += 1
        tasks = -(-windows // MOST_OPEN)
        last = tasks == 1 or before is not None and windows > 0.9 * before
        mixed = F.xxhash64("sequence_id", "offset")
        left = rows.where("left").withColumn("mixed", mixed).repartition(tasks, "mixed").sortWithinPartitions("mixed").drop("mixed")
        rows = cut(left.mapInArrow(next_round(number, last), schema), "packed")
        before, windows = windows, 0 if last else rows.where("left and offset = 0").count()
    for more in done:
        rows = rows.unionByName(more)
    return rows.drop("left")


def sequences(pieces: DataFrame, capacity: int = CAPACITY, pad_id: int = 0) -> DataFrame:
    """(sequence_id, ids, n_tokens): the padded windows, from pieces packed with ``keep_ids``."""
    ordered = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    rows = pieces.groupBy("sequence_id").agg(F.flatten(ordered["ids"]).alias("ids"), F.first("padded_tokens").alias("padded"))
    pad = F.array_repeat(F.lit(pad_id), (F.col("padded") - F.size("ids")).cast("int"))
    return rows.select("sequence_id", F.concat("ids", pad).alias("ids"), F.size("ids").cast("long").alias("n_tokens"))


def op2_packing(spark, sf_dir: str) -> DataFrame:
    """The pieces of all documents, with the fill and padded length of their sequences."""
    from cubeflow.llm.common import table

    return pack(table(spark, sf_dir, "documents")).drop("ids")
