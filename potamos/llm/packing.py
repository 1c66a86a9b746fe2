"""Best-fit packing of documents into fixed-length sequences.

Bounded-space online best-fit: a packer holds a fixed number of open bins, found through a bitset of the free
spaces that occur; when the limit is reached the fullest bin closes first. Packers run side by side, each on its
own share of the pieces. They take the pieces as they come, a block at a time, and place a block from long to short, so
that what arrives last fills the gaps and the bins that stay open are nearly full: a packer's memory is a block and its
open bins, however many pieces it gets. Without the limit as many sequences come out (README has figures), so it costs
nothing.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .tokens import encoder

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
SCHEMA = PIECES + ", sequence_id long, offset long"
#: Open bins of one packer, the pieces that it orders at a time, and those that it receives on average.
OPEN_BINS = 2048
BLOCK = 8192
PIECES_PER_PACKER = 65_536


class BestFit:
    """Online best-fit with at most ``open_bins`` open bins of size ``capacity``."""

    def __init__(self, capacity: int, open_bins: int = OPEN_BINS):
        self.capacity, self.open_bins = capacity, open_bins
        self.by_free: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.bits = 0  # bit f is set while a bin with f free places is open
        self.open = self.made = 0

    def place(self, length: int) -> tuple[int, int]:
        """Bin number and offset for an item."""
        fits = self.bits >> length
        if fits:  # the lowest bit is the bin that stays with least space
            free = length + (fits & -fits).bit_length() - 1
            bin_id = self._take(free)
        else:
            if self.open >= self.open_bins:
                self._take((self.bits & -self.bits).bit_length() - 1)  # the fullest closes
            bin_id, free = self.made, self.capacity
            self.made += 1
        left = free - length
        if left:
            self.by_free[left].append(bin_id)
            self.bits |= 1 << left
            self.open += 1
        return bin_id, self.capacity - free

    def _take(self, free: int) -> int:
        held = self.by_free[free]
        bin_id = held.pop()
        if not held:
            self.bits ^= 1 << free
        self.open -= 1
        return bin_id


def cut(docs: DataFrame, tokenizer: str, capacity: int, end_id: int, id_col: str, text_col: str) -> DataFrame:
    """Encoded pieces of every document, without the ids themselves."""
    width, end = 4 * capacity, end_id.to_bytes(4, "little")

    def pieces(batch: pa.RecordBatch) -> Iterable[pa.RecordBatch]:
        rows: list[list] = [[], [], [], [], []]
        for doc_id, ids in zip(batch.column(0).to_pylist(), encoder(tokenizer).encode(common.as_bytes(batch.column(1)))):
            ids += end
            for piece, at in enumerate(range(0, len(ids), width)):
                part = ids[at : at + width]
                for column, value in zip(rows, (doc_id, piece, at // 4, len(part) // 4, zlib.crc32(part))):
                    column.append(value)
        types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(r, t) for r, t in zip(rows, types)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return common.map_batches(common.pick(docs, doc_id=id_col, text=text_col), pieces, PIECES)


def pack(
    docs: DataFrame,
    tokenizer: str,
    capacity: int = 2048,
    end_id: int = 0,
    open_bins: int = OPEN_BINS,
    pieces_per_packer: int = PIECES_PER_PACKER,
    block: int = BLOCK,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Place every token of every document (then ``end_id``) in a sequence of at most ``capacity`` tokens.

    Only documents longer than a sequence are cut. The pieces (no ids) are written to the shared folder once, then
    dealt to packers by their place in those files, so neither a long document nor a hot key nor a third of all rows
    being the same makes a packer larger than the others, and a lost packer gets the same pieces again.
    Null text is an empty document of one token; a null id is carried along; each repeated row is packed as a
    document of its own; an empty table gives an empty result; other columns are ignored."""
    pieces = common.settle(cut(docs, tokenizer, capacity, end_id, id_col, text_col))
    packers = max(1, -(-pieces.count() // pieces_per_packer))
    dealt = pieces.withColumn("deal", F.xxhash64(F.monotonically_increasing_id())).repartition(packers, "deal")
    dealt = dealt.sortWithinPartitions("deal")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, first = BestFit(capacity, open_bins), TaskContext.get().partitionId() << 40
        for rows in in_blocks(batches, block):
            lengths = rows.column("length").to_numpy()
            order = np.argsort(-lengths, kind="stable")
            rows = rows.take(pa.array(order))
            placed = [packer.place(n) for n in lengths[order].tolist()]
            yield pa.RecordBatch.from_arrays(
                [*rows.columns[:5], pa.array([first + b for b, _ in placed], pa.int64()), pa.array([o for _, o in placed], pa.int64())],
                names=[*rows.schema.names[:5], "sequence_id", "offset"],
            )

    return dealt.mapInArrow(run, SCHEMA)


def in_blocks(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of ``size``, the last one shorter."""
    held: list[pa.RecordBatch] = []
    n = 0
    for batch in batches:
        while n + batch.num_rows >= size:
            held.append(batch.slice(0, size - n))
            batch = batch.slice(size - n)
            yield pa.concat_batches(held)
            held, n = [], 0
        if batch.num_rows:
            held.append(batch)
            n += batch.num_rows
    if held:
        yield pa.concat_batches(held)
