"""Line deduplication by pairwise alignment.

Documents that overlap are found through hashes of the shortest runs of lines that make a block: a long line alone, or
short ones together. Instead of pairing all holders of a run, which grows with the square of their number, every
holder is paired with the first one, so no run has to be left out for being frequent. A pair is aligned with patience
diff on line hashes, and common blocks go from the later document; what is left is aligned again, so that blocks in
another order go too, and blocks of lines too frequent to anchor an alignment are found by their runs. The first
holder of a block always keeps it.

Of the earlier document only windows around the shared runs travel, as wide as a block can be: the later document's
number of lines to either side. So a first holder of any length costs a pair no more than its later document does, and
a later document travels once however many partners it has.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common
from .common import KEY

#: A common block of fewer words stays.
MIN_BLOCK_WORDS = 10
#: Columns that ``dedup_lines`` adds.
ADDED = ("n_lines_before", "n_lines_removed")


def patience(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Aligned positions of two line sequences: common ends first, then lines that are unique on both sides in their
    longest increasing order, then what lies between them in the same way."""
    found, work = [], [(0, len(a), 0, len(b))]
    while work:
        a0, a1, b0, b1 = work.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            found.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            found.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        in_a, in_b = Counter(a[a0:a1]), Counter(b[b0:b1])
        place = {a[i]: i for i in range(a0, a1) if in_a[a[i]] == 1 and in_b[a[i]] == 1}
        anchors = [(place[b[j]], j) for j in range(b0, b1) if b[j] in place]
        if not anchors:
            continue
        tops: list[int] = []
        ends: list[int] = []
        before: list[int] = []
        for k, (i, _) in enumerate(anchors):
            at = bisect_left(tops, i)
            tops[at:at + 1], ends[at:at + 1] = [i], [k]
            before.append(ends[at - 1] if at else -1)
        k, chain = ends[-1], []
        while k >= 0:
            chain.append(anchors[k])
            k = before[k]
        chain.reverse()
        i0, j0 = a0, b0
        for i, j in [*chain, (a1, b1)]:
            work.append((i0, i, j0, j))
            i0, j0 = i + 1, j + 1
        found += chain
    return sorted(found)


def common_blocks(pairs: list[tuple[int, int]], words: list[int], least: int) -> list[int]:
    """Positions in the later document of all aligned runs that hold enough words."""
    out, run, total, last = [], [], 0, None
    for i, j in [*pairs, (-9, -9)]:
        if last != (i - 1, j - 1):
            if total >= least:
                out += run
            run, total = [], 0
        if j >= 0:
            run.append(j)
            total += words[j]
        last = (i, j)
    return out


def shortest(words: list[int | None], least: int) -> Iterator[tuple[int, int]]:
    """``(start, stop)`` of the shortest run of lines with enough words from each line that has a word; no run goes
    over a None."""
    stop = total = 0
    for start, n in enumerate(words):
        if n is None:
            stop, total = start + 1, 0
            continue
        while total < least and stop < len(words) and words[stop] is not None:
            total += words[stop]
            stop += 1
        if n and total >= least:
            yield start, stop
        total -= n


def repeated(a: list[int], b: list[int], words: list[int], least: int) -> list[int]:
    """Positions in the later document ``b`` of all blocks it shares with ``a``: aligned ones, then those that the
    alignment can't anchor because their lines occur more than once on a side."""
    left: list[int | None] = list(b)
    gone: set[int] = set()
    while new := common_blocks(patience(a, left), words, least):
        gone.update(new)
        for j in new:
            left[j] = None
    known = dict(zip(b, words))
    held: dict[tuple[int, ...], int] = {}
    for start, stop in shortest([known.get(x) for x in a], least):
        held.setdefault(tuple(a[start:stop]), start)
    for start, stop in shortest([None if x is None else n for x, n in zip(left, words)], least):
        i = held.get(tuple(b[start:stop]))
        if i is not None:
            gone.update(range(start, stop))
            i += stop - start
            while stop < len(b) and i < len(a) and left[stop] == a[i]:
                gone.add(stop)
                i, stop = i + 1, stop + 1
    return sorted(gone)


def runs(lines: list[bytes], words: list[int], least: int) -> dict[int, int]:
    """Hashes of the shortest runs of lines with enough words, and where each starts first."""
    found: dict[int, int] = {}
    for start, stop in shortest(words, least):
        found.setdefault(xxhash.xxh64_intdigest(b"\n".join(lines[start:stop])) - (1 << 63), start)
    return found


class Later:
    """A later document, asked about one window of an earlier one after the other."""

    def __init__(self, hashes: list[int], words: list[int], least: int):
        self.hashes, self.words, self.least = hashes, words, least
        self.at: dict[int, list[int]] = {}
        for k, (x, n) in enumerate(zip(hashes, words)):
            if n:
                self.at.setdefault(x, []).append(k)
        self.gone: set[int] = set()

    def meet(self, window: list[int], places: list[int]) -> None:
        """Mark the lines in common with a window in which shared runs start at ``places``. Only the parts of this
        document that lie on a diagonal of a shared run are looked at."""
        spans = sorted({(max(0, k - p), k - p + len(window)) for p in places for k in self.at.get(window[p], ())})
        lines: list[int | None] = []
        words: list[int] = []
        real: list[int] = []
        end = 0
        for start, stop in spans:
            if start > end and lines:  # parts that aren't neighbours must not make a block
                lines.append(None)
                words.append(0)
                real.append(-1)
            start, end = max(start, end) if lines else start, max(end, min(stop, len(self.hashes)))
            lines += self.hashes[start:end]
            words += self.words[start:end]
            real += range(start, end)
        self.gone.update(real[k] for k in repeated(window, lines, words, self.least) if real[k] >= 0)


def line_table(docs: DataFrame, min_block_words: int, id_col: str, text_col: str) -> DataFrame:
    """Per document the hashes and word counts of its lines, and the hashes and places of its runs; a repeated row (same
    id and text) is one document."""

    def run(batch: pa.RecordBatch):
        hashes, words, starts, places = [], [], [], []
        for data in common.as_bytes(batch.column(3)):
            lines = data.split(b"\n")
            hashes.append([xxhash.xxh64_intdigest(x) - (1 << 63) for x in lines])
            words.append([len(x.split()) for x in lines])
            held = runs(lines, words[-1], min_block_words)
            starts.append(list(held))
            places.append(list(held.values()))
        columns = [pa.array(hashes, pa.list_(pa.int64())), pa.array(words, pa.list_(pa.int32())), pa.array(starts, pa.list_(pa.int64())), pa.array(places, pa.list_(pa.int32()))]
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], *columns], names=[*KEY, "hashes", "words", "runs", "places"])

    chosen = docs.select(*common.row_key(id_col, text_col), F.col(text_col).alias("text"))
    rows = common.map_batches(chosen, run, "late boolean, id long, th long, hashes array<long>, words array<int>, runs array<long>, places array<int>")
    return rows.dropDuplicates(list(KEY))


def _windows() -> Column:
    """From the places of shared runs in the earlier document ``a`` to its windows ``(lo, lines)``; windows that meet
    are one."""
    n, none = F.col("n_lines"), F.expr("cast(array() as array<struct<lo:int,hi:int>>)")

    def widen(held: Column, place: Column) -> Column:
        last = F.try_element_at(held, F.lit(-1))
        longer = F.concat(F.slice(held, F.lit(1), F.size(held) - 1), F.array(F.struct(last["lo"].alias("lo"), (place + n).alias("hi"))))
        fresh = F.concat(held, F.array(F.struct(F.greatest(place - n, F.lit(0)).alias("lo"), (place + n).alias("hi"))))
        return F.when(F.coalesce(place - n <= last["hi"] + 1, F.lit(False)), longer).otherwise(fresh)

    spans = F.aggregate(F.array_sort("places"), none, widen)
    return F.transform(spans, lambda w: F.struct(w["lo"].alias("lo"), F.slice(F.col("a"), w["lo"] + 1, w["hi"] - w["lo"] + 1).alias("lines")))


def deletions(docs: DataFrame, min_block_words: int = MIN_BLOCK_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(late, id, th, gone)``: the line numbers that each document loses."""
    table = common.settle(line_table(docs, min_block_words, id_col, text_col)).withColumn("doc", F.struct(*KEY))
    held = table.select("doc", F.size("hashes").alias("n_lines"), F.explode(F.arrays_zip("runs", "places")).alias("r")).select("doc", "n_lines", F.col("r.runs").alias("h"), F.col("r.places").alias("place"))
    firsts = held.groupBy("h").agg(F.min(F.struct("doc", "place")).alias("top"), F.max("doc").alias("last"), F.count("*").alias("n")).where("top.doc < last")
    firsts = common.settle(firsts.select("h", F.col("top.doc").alias("first"), "top.place", "n"))
    met = common.spread_join(held.drop("place"), firsts.select("h", "first", "place"), firsts.select("h", "n"), "h").where("doc > first")
    pairs = common.settle(met.groupBy("doc", "first").agg(F.max("n_lines").alias("n_lines"), F.collect_set("place").alias("places")))
    earlier = table.select(F.col("doc").alias("first"), F.col("hashes").alias("a"))
    partners = pairs.groupBy("first").agg(F.count("*").alias("n"))
    cut = common.spread_join(pairs, earlier, partners, "first").select("doc", "first", "places", _windows().alias("windows"))
    # each later document, then its partners from first to last
    none = F.lit(None)
    own = table.select("doc", none.cast(cut.schema["first"].dataType).alias("first"), none.cast("array<int>").alias("places"), none.cast(cut.schema["windows"].dataType).alias("windows"), "hashes", "words")
    asked = cut.select("*", none.cast("array<long>").alias("hashes"), none.cast("array<int>").alias("words"))
    dealt = own.unionByName(asked).repartition("doc").sortWithinPartitions("doc", F.asc_nulls_first("first")).select("doc.*", "places", "windows", "hashes", "words")

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        source, later = None, None  # where the document at hand stands; read only when a partner comes

        def done(rows: list) -> None:
            if later is not None and later.gone:
                rows.append((*(source[0].column(k)[source[1]].as_py() for k in range(3)), sorted(later.gone)))

        def packed(rows: list) -> pa.RecordBatch:
            columns = zip(*rows) if rows else [[]] * 4
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.bool_(), pa.int64(), pa.int64(), pa.list_(pa.int32())))], names=[*KEY, "gone"])

        for batch in batches:
            rows: list[tuple] = []
            for row, is_own in enumerate(pa.compute.is_valid(batch.column(5)).to_pylist()):
                if is_own:
                    done(rows)
                    source, later = (batch, row), None
                    continue
                if later is None:
                    later = Later(*(source[0].column(k)[source[1]].as_py() for k in (5, 6)), min_block_words)
                places = sorted(batch.column(3)[row].as_py())
                for window in batch.column(4)[row].as_py():
                    low, lines = window["lo"], window["lines"]
                    later.meet(lines, [p - low for p in places if low <= p < low + len(lines)])
            yield packed(rows)
        rows = []
        done(rows)
        yield packed(rows)

    return dealt.mapInArrow(align, "late boolean, id long, th long, gone array<int>")


def dedup_lines(docs: DataFrame, min_block_words: int = MIN_BLOCK_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All rows and columns of ``docs`` with common blocks taken out of the later documents, plus ``n_lines_before``
    and ``n_lines_removed``.

    Earlier means a smaller doc_id (null ids come last, equal ids go by a hash of the text); rows equal in id and text
    are one document and keep or lose the same lines. Null text stays null and empty text empty; a text that loses
    all its lines becomes empty; an empty table gives an empty result; input columns of the two added names are
    replaced, all others stay as they are whatever their names."""
    gone = deletions(docs, min_block_words, id_col, text_col).select(F.struct(*KEY).alias("doc"), "gone")
    marked = docs.select(common.as_row(docs).alias("row"), F.struct(*common.row_key(id_col, text_col)).alias("doc")).join(gone, "doc", "left")
    old = F.col("row")[text_col]
    # lines are a column of their own, as a lambda would split the text anew for every line
    marked = marked.withColumn("lines", F.split(old, "\n", -1))
    lines = F.col("lines")
    stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("gone"))
    text = F.when(F.col("gone").isNull(), old).otherwise(F.array_join(F.transform(stay, lambda i: lines[i]), "\n"))
    kept = [(text if c == text_col else F.col("row")[c]).alias(c) for c in docs.columns if c.lower() not in ADDED]
    removed = F.coalesce(F.size("gone"), F.lit(0)).cast("long")
    return marked.select(*kept, F.size(lines).cast("long").alias(ADDED[0]), removed.alias(ADDED[1]))
