"""Benchmark decontamination by spaced-seed hashing.

Words are normalised (lower case, letters and digits only) and hashed. A mask names the positions of a short window
that count; the others may differ. Hashes of all benchmark windows under all masks form a table; windows of the
documents are looked up in it, and each hit is verified along its diagonal: equal words score 1, differing ones
cost ``PENALTY``, and the best-scoring stretch must reach ``MIN_SCORE``.

That score asks too much of short or evenly changed items. With ``one_in``, whole items are looked up too: an item of n
words is found wherever it is repeated with at most n // ``one_in`` words changed. It is cut into one block more than
words may change, so one block is left as it was; the blocks' first words are looked up and the hits counted out.

A text that repeats itself meets an item on many diagonals. Those hits are taken from the diagonal with most of them
down, and hits inside a stretch that is found already are passed over; stretches of one item that overlap in the document are
one row, so the rows are linear in the text.

The table is broadcast in blocks of at most ``BLOCK_WORDS`` benchmark words; a larger benchmark takes several passes, each
over what the pass before it has written.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Masks of nine words that ignore two each. One differing word leaves a hit on either side of it from six words on.
MASKS = ("111010111", "110111011", "101111101")
MIN_SCORE, PENALTY = 12, 3
#: Items of fewer words than a mask are looked up by runs of all their words, down to this number.
MIN_WORDS = 5
#: One word in so many of a whole item may differ; items of fewer words have to be the same.
ONE_IN = 5
#: Words of a block of an item that are looked up, at most.
BLOCK_SEED = 4
BLOCK_WORDS = 500_000
FILTER_BITS = 22
#: Positions of a document whose hits are held at a time.
SEGMENT = 4096
SCHEMA = "doc_id long, item_id long, doc_start long, item_start long, length long, matches long"
_DROP = re.compile(r"[\W_]+")
_ODD = [np.uint64(0x9E3779B97F4A7C15 + 2 * 0x1F83D9ABFB41BD6B * k & 0xFFFFFFFFFFFFFFFF) for k in range(64)]


def _normal(word: bytes) -> int:
    text = _DROP.sub("", word.decode("utf-8", "replace").lower())
    return xxhash.xxh64_intdigest(text.encode()) | 1 if text else 0


def word_hashes(data: bytes, memo: common.Memo) -> np.ndarray:
    """Hashes of the normalised words; words without a letter or digit are left out."""
    words = data.split()
    found = np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))
    return found[found != 0]


def windows(h: np.ndarray, mask: str) -> np.ndarray:
    n = len(h) - len(mask) + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    total = np.full(n, _ODD[len(mask)], np.uint64)
    for k, kept in enumerate(mask):
        if kept == "1":
            total += h[k : k + n] * _ODD[k]
    return (total ^ (total >> np.uint64(29))) * _ODD[1]


class SeedTable:
    """Benchmark windows by hash, and the items' words for verification."""

    def __init__(self, items: list[tuple[int, np.ndarray]], one_in: int = 0):
        self.ids = [i for i, _ in items]
        self.words = [w for _, w in items]
        #: masks, and for short items full masks of their length
        self.masks = list(MASKS) + ["1" * n for n in sorted({len(w) for w in self.words if MIN_WORDS <= len(w) < len(MASKS[0])})]
        hashes, owner, at = [], [], []
        self.one_in = one_in
        self._add_blocks()
        for k, w in enumerate(self.words):
            for mask in self.masks if len(w) >= len(MASKS[0]) else ["1" * len(w)] * (len(w) >= MIN_WORDS):
                if len(mask) < len(MASKS[0]) <= len(w):
                    continue
                x = windows(w, mask)
                hashes.append(x)
                owner.append(np.full(len(x), k))
                at.append(np.arange(len(x)))
        x = np.concatenate(hashes) if hashes else np.empty(0, np.uint64)
        order = np.argsort(x, kind="stable")
        self.hashes = x[order]
        self.owner = (np.concatenate(owner) if owner else np.empty(0, np.int64))[order].astype(np.int32)
        self.at = (np.concatenate(at) if at else np.empty(0, np.int64))[order].astype(np.int32)
        self.seen = np.zeros(1 << FILTER_BITS, bool)
        self.seen[(self.hashes >> np.uint64(64 - FILTER_BITS)).astype(np.int64)] = True

    def _add_blocks(self) -> None:
        rows: list[tuple[int, int, int]] = []
        lengths: set[int] = set()
        for k, w in enumerate(self.words):
            if self.one_in and len(w):
                parts = len(w) // self.one_in + 1
                n = min(BLOCK_SEED, len(w) // parts)
                lengths.add(n)
                for start in (j * len(w) // parts for j in range(parts)):
                    rows.append((int(windows(w[start : start + n], "1" * n)[0]), k, start))
        self.lengths = sorted(lengths)
        self.sizes = np.array([len(w) for w in self.words], np.int64)
        rows.sort()
        self.block_hashes = np.array([x for x, _, _ in rows], np.uint64)
        self.block_owner = np.array([k for _, k, _ in rows], np.int64)
        self.block_at = np.array([q for _, _, q in rows], np.int64)
        self.block_seen = np.zeros(1 << FILTER_BITS, bool)
        self.block_seen[(self.block_hashes >> np.uint64(64 - FILTER_BITS)).astype(np.int64)] = True

    def whole(self, h: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """``(item number, document position, equal words)`` of all items that are there whole, up to the words that may differ."""
        found: list[np.ndarray] = []
        for n in self.lengths:
            x = windows(h, "1" * n)
            where = np.flatnonzero(self.block_seen[(x >> np.uint64(64 - FILTER_BITS)).astype(np.int64)])
            if len(where):
                first = np.searchsorted(self.block_hashes, x[where], "left")
                count = np.searchsorted(self.block_hashes, x[where], "right") - first
                row = np.repeat(first - np.cumsum(count) + count, count) + np.arange(count.sum())
                item, shift = self.block_owner[row], np.repeat(where, count) - self.block_at[row]
                inside = (shift >= 0) & (shift + self.sizes[item] <= len(h))
                found.append(item[inside] * len(h) + shift[inside])
        for item, shift in zip(*(a.tolist() for a in np.divmod(np.unique(np.concatenate(found)), len(h)))) if found else ():
            w = self.words[item]
            equal = int(np.count_nonzero(h[shift : shift + len(w)] == w))
            if len(w) - equal <= len(w) // self.one_in:
                yield item, shift, equal

    def hit_groups(self, h: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Item numbers, document positions and item positions of the seed hits, ``SEGMENT`` positions at a time."""
        for mask in self.masks:
            x = windows(h, mask)
            every = np.flatnonzero(self.seen[(x >> np.uint64(64 - FILTER_BITS)).astype(np.int64)])
            for k in range(0, len(every), SEGMENT):
                where = every[k : k + SEGMENT]
                first = np.searchsorted(self.hashes, x[where], "left")
                count = np.searchsorted(self.hashes, x[where], "right") - first
                row = np.repeat(first - np.cumsum(count) + count, count) + np.arange(count.sum())
                if len(row):
                    yield self.owner[row].astype(np.int64), np.repeat(where, count), self.at[row].astype(np.int64)

    def hits(self, h: np.ndarray) -> set[tuple[int, int]]:
        """``(item number, document position minus item position)`` of all seed hits."""
        return {pair for item, p, q in self.hit_groups(h) for pair in zip(item.tolist(), (p - q).tolist())}

    def found(self, h: np.ndarray) -> Iterator[tuple[int, tuple[int, int, int, int]]]:
        """Item numbers and verified stretches: diagonals with most hits first, none whose hits lie inside one stretch
        of the item that was found before; then whole items."""
        covered: dict[int, list[tuple[int, int]]] = {}
        for item, p, q in self.hit_groups(h):
            order = np.lexsort((p, p - q, item))
            item, p, shift = item[order], p[order], (p - q)[order]
            start = np.flatnonzero(np.concatenate(([True], (item[1:] != item[:-1]) | (shift[1:] != shift[:-1]))))
            stop = np.concatenate((start[1:], [len(item)]))
            for k in np.lexsort((shift[start], start - stop, item[start])).tolist():
                i, low, high = int(item[start[k]]), int(p[start[k]]), int(p[stop[k] - 1])
                if any(a <= low and high < b for a, b in covered.get(i, ())):
                    continue
                if (best := self.verify(h, i, int(shift[start[k]]))) is not None:
                    a, b = best[0], best[0] + best[2]
                    apart = [x for x in covered.get(i, ()) if x[1] < a or x[0] > b]
                    joined = [x for x in covered.get(i, ()) if not (x[1] < a or x[0] > b)]
                    covered[i] = [*apart, (min([a, *(x[0] for x in joined)]), max([b, *(x[1] for x in joined)]))]
                    yield i, best
        for i, shift, equal in self.whole(h):
            yield i, (shift, 0, len(self.words[i]), equal)

    def verify(self, h: np.ndarray, item: int, shift: int) -> tuple[int, int, int, int] | None:
        """``(document start, item start, length, equal words)`` of the best stretch on a diagonal, if good enough."""
        w = self.words[item]
        low, high = max(0, -shift), min(len(w), len(h) - shift)
        equal = h[low + shift : high + shift] == w[low:high]
        score = np.concatenate(([0], np.cumsum(np.where(equal, 1, -PENALTY))))
        gain = score - np.minimum.accumulate(score)
        end = int(gain.argmax())
        if gain[end] < min(MIN_SCORE, len(w)):
            return None
        start = int(end - gain[end]) if equal[end - int(gain[end]) : end].all() else int(np.flatnonzero(score[:end] == score[end] - gain[end])[-1])
        return low + start + shift, low + start, end - start, int(equal[start:end].sum())


def _items(benchmark: DataFrame) -> DataFrame:
    return benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce("text", F.lit("")).alias("text"))


def list_tables(benchmark: DataFrame, block_words: int = BLOCK_WORDS) -> int:
    """How many tables of about ``block_words`` words each the benchmark takes."""
    total = _items(benchmark).agg(F.sum(F.length("text"))).first()[0] or 0
    return max(1, -(-total // (4 * block_words)))  # a word and its space take four characters or more on average


def seed_table(benchmark: DataFrame, block: int, blocks: int, one_in: int = 0) -> Broadcast:
    """The broadcast table of one block of the benchmark."""
    memo = common.Memo(_normal)
    rows = _items(benchmark).where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).dropDuplicates().orderBy("item_id", "text").collect()
    return benchmark.sparkSession.sparkContext.broadcast(SeedTable([(r.item_id, word_hashes(r.text.encode(), memo)) for r in rows], one_in))


def stretches(table: SeedTable, data: bytes, memo: common.Memo) -> Iterator[tuple[int, ...]]:
    """``(item_id, document start, item start, length, equal words)`` of every diagonal that holds a good stretch."""
    memo.trim()
    h = word_hashes(data, memo)
    done = set()
    for item, shift in sorted(table.hits(h)):
        if (found := table.verify(h, item, shift)) is not None:
            done.add((item, shift))
            yield (table.ids[item], *found)
    for item, shift, equal in table.whole(h):
        if (item, shift) not in done:
            yield table.ids[item], shift, 0, len(table.words[item]), equal


def merged(table: SeedTable, data: bytes, memo: common.Memo) -> Iterator[tuple[int, ...]]:
    """The same with one row for all stretches of an item that overlap in the document: the words from the first to the
    last, the item's part and equal words of the stretch with most of them."""
    memo.trim()
    found: dict[int, list[tuple[int, int, int, int]]] = {}
    for item, best in table.found(word_hashes(data, memo)):
        found.setdefault(item, []).append(best)
    for item, rows in sorted(found.items()):
        rows.sort()
        start, stop, best = rows[0][0], rows[0][0] + rows[0][2], rows[0]
        for row in rows[1:]:
            if row[0] < stop:
                stop, best = max(stop, row[0] + row[2]), max(best, row, key=lambda r: r[3])
            else:
                yield table.ids[item], start, best[1], stop - start, best[3]
                start, stop, best = row[0], row[0] + row[2], row
        yield table.ids[item], start, best[1], stop - start, best[3]


def overlaps(docs: DataFrame, benchmark: DataFrame, block_words: int = BLOCK_WORDS, id_col: str = "doc_id", text_col: str = "text", one_in: int = 0, merge: bool = False) -> DataFrame:
    """One row per document and benchmark stretch it repeats, up to substitutions; with ``one_in`` also per whole item
    it repeats with at most one word in so many changed, where that is no such stretch. With ``merge`` stretches of one
    item that overlap in the document are one row.

    Texts are scanned whole and never shuffled. Null and empty texts (documents or items) match nothing, as do items
    of fewer than ``MIN_WORDS`` words without ``one_in``; a null id is carried along; repeated documents each get rows; an empty
    benchmark or table gives an empty result; other columns are ignored."""
    chosen, parts = common.pick(docs, doc_id=id_col, text=text_col), []
    tables = list_tables(benchmark, block_words)
    for block in range(tables):
        shared, find = seed_table(benchmark, block, tables, one_in), merged if merge else stretches

        def run(batches: Iterator[pa.RecordBatch], shared=shared, find=find) -> Iterator[pa.RecordBatch]:
            memo = common.Memo(_normal)
            for batch in batches:
                rows = [(doc_id, *s) for doc_id, data in zip(batch.column(0).to_pylist(), common.as_bytes(batch.column(1))) for s in find(shared.value, data, memo)]
                columns = zip(*rows) if rows else [[]] * 6
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=[x.split()[0] for x in SCHEMA.split(", ")])

        part = chosen.mapInArrow(run, SCHEMA)
        if tables > 1:  # one table at a time is held
            part = common.settle(part)
            shared.unpersist()
        parts.append(part)
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    return found


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, block_words: int = BLOCK_WORDS, text_col: str = "text", one_in: int = 0) -> DataFrame:
    """The rows of ``docs`` without any overlap, all columns as they are whatever their names, without a shuffle. Null
    and empty texts stay; repeated rows stay or go together; an empty benchmark or table changes nothing. A benchmark
    of several blocks takes a pass for each, over the rows that the last one left."""
    tables = list_tables(benchmark, block_words)
    for block in range(tables):
        shared = seed_table(benchmark, block, tables, one_in)

        def clean(texts: list[bytes], shared=shared) -> list[bool]:
            memo = common.Memo(_normal)
            clear = []
            for data in texts:
                memo.trim()
                clear.append(next(shared.value.found(word_hashes(data, memo)), None) is None)
            return clear

        docs = common.keep_rows(docs, text_col, clean)
        if tables > 1:
            docs = common.settle(docs)
            shared.unpersist()
    return docs
