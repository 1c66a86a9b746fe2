"""SimHash fingerprints and near-duplicate groups by sharded BK-trees.

A shard holds the fingerprints that agree in some blocks of bits; where blocks are wide and how many must agree follows
from the number of fingerprints, so that a shard holds about ``SHARD_SIZE`` of them at every size. Any layout is exact:
with m blocks, two fingerprints that differ in at most r bits agree in m - r of them, and there is a key for each choice
of m - r blocks. A shard is a BK-tree (children keyed by their Hamming distance to the parent; a search follows only
edges within the radius), built and searched for all its fingerprints at once. Shards come to their tasks with the
shuffle, not by broadcast: all trees together grow with the corpus, and a broadcast would bring every fingerprint to the
driver. A shard above ``TREE_SIZE`` is split, and the tree of each part goes to the tasks of its own and all later parts. Of the links
found in a shard those that join nothing new are left out, so a group of thousands yields a chain of links and not all
its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import log2

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from potamos.operators.components import connected_components

from . import common
from .common import KEY

RADIUS = 3
WORDS = 3
SEED = 42
#: Fingerprints that a shard holds on average, and those that one tree holds at most.
SHARD_SIZE = 1024
TREE_SIZE = 8192
CHUNK = 1 << 15


class BkTree:
    """Metric tree over 64-bit fingerprints under Hamming distance. ``subtrees`` holds ``(point, distances, children)``, a
    point being named by its place in ``points``."""

    def __init__(self, points: np.ndarray):
        self.points = points
        self.subtrees: list[tuple[int, list[int], list[int]]] = []
        work = [(np.arange(len(points)), -1)] if len(points) else []
        while work:
            members, parent = work.pop()
            number, head, rest = len(self.subtrees), int(members[0]), members[1:]
            if parent >= 0:
                self.subtrees[parent][2].append(number)
            self.subtrees.append((head, [], []))
            if len(rest):
                d = np.bitwise_count(points[rest] ^ points[head])
                order = np.argsort(d, kind="stable")
                rest, d = rest[order], d[order]
                borders = np.flatnonzero(np.diff(d)) + 1
                parts = np.split(rest, borders)
                self.subtrees[number][1].extend(int(x) for x in d[np.concatenate(([0], borders))[::-1]])
                work += [(part, number) for part in parts]

    def near(self, asked: np.ndarray, radius: int) -> Iterator[tuple[int, np.ndarray]]:
        """``(number of a point, which of the asked lie within the radius)``. All searches go down the tree together: a
        node is met once, by those whose way leads over it."""
        stack = [(0, np.arange(len(asked)))] if self.subtrees and len(asked) else []
        while stack:
            node, who = stack.pop()
            head, distances, children = self.subtrees[node]
            d = np.bitwise_count(asked[who] ^ self.points[head]).astype(np.int16)
            hit = who[d <= radius]
            if len(hit):
                yield head, hit
            if children:
                low, high = int(d.min()) - radius, int(d.max()) + radius
                for k, child in zip(distances, children):
                    if low <= k <= high and len(go := who[np.abs(d - k) <= radius]):
                        stack.append((child, go))


class Forest:
    """Union-find over arbitrary keys."""

    def __init__(self):
        self.parent: dict[int, int] = {}

    def root(self, x: int) -> int:
        parent = self.parent
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        self.parent[max(a, b)] = min(a, b)
        return a != b


def fingerprint(data: bytes) -> int:
    """Majority bits of the hashes of all 3-word shingles, as an unsigned integer; zero without words."""
    words = data.lower().split()
    if not words:
        return 0
    digest, ones, n = xxhash.xxh64_intdigest, np.zeros(64, np.int64), max(1, len(words) - WORDS + 1)
    for at in range(0, n, CHUNK):
        part = words[at : at + CHUNK + WORDS - 1]
        shingles = map(b" ".join, zip(part, part[1:], part[2:])) if len(words) >= WORDS else [b" ".join(part)]
        hashes = np.array([digest(s, SEED) for s in shingles], "<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The row key, doc_id and ``fp`` of each row; fp holds the 64 bits as a signed long."""

    def run(batch: pa.RecordBatch):
        fps = np.array([fingerprint(t) for t in common.as_bytes(batch.column(4))], "<u8").view("<i8")
        yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(fps)], names=[*KEY, "doc_id", "fp"])

    chosen = docs.select(*common.row_key(id_col, text_col), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return common.map_batches(chosen, run, "late boolean, id long, th long, doc_id long, fp long")


def layout(n: int, radius: int = RADIUS, shard_size: int = SHARD_SIZE) -> list[list[tuple[int, int]]]:
    """The keys for ``n`` fingerprints: for each the ``(first bit, bits)`` of its blocks. The fewest blocks are taken whose
    keys are long enough to leave about ``shard_size`` fingerprints to a shard."""
    need = max(1, round(log2(max(2.0, n / shard_size))))
    for m in range(radius + 1, 33):
        width, chosen = 64 // m, m - radius
        if width * chosen >= need or m == 2 * radius + 2:
            bits = min(width, -(-need // chosen))
            return [[(block * width, bits) for block in key] for key in combinations(range(m), chosen)]
    raise ValueError("the radius is too large for blocks")


def links(distinct: DataFrame, radius: int = RADIUS, tree_size: int = TREE_SIZE, shard_size: int = SHARD_SIZE) -> DataFrame:
    """Links ``(src, dst)`` between distinct fingerprints, enough to connect whatever is within the radius."""
    keys = []
    for p, key in enumerate(layout(distinct.count(), radius, shard_size)):
        value, at = F.lit(0).cast("long"), 0
        for first, bits in key:
            value = value.bitwiseOR(F.shiftleft(F.shiftrightunsigned("fp", first).bitwiseAND((1 << bits) - 1), at))
            at += bits
        keys.append(F.struct(F.lit(p).alias("p"), value.alias("x")))
    rows = distinct.select("fp", F.explode(F.array(*keys)).alias("k")).select("fp", "k.p", "k.x")
    large = rows.groupBy("p", "x").agg(F.count("*").alias("n")).where(F.col("n") > tree_size)
    large = common.settle(large.select("p", "x", F.ceil(F.col("n") / tree_size).cast("int").alias("parts")))
    if not large.isEmpty():
        rows = rows.join(large, ["p", "x"], "left")
    else:
        rows = rows.withColumn("parts", F.lit(1))
    # part i meets part j >= i in the task (i, j); rows of the first part build the tree
    parts = F.coalesce("parts", F.lit(1))
    rows = rows.withColumn("part", F.pmod(F.xxhash64("fp"), parts).cast("int"))
    rows = rows.select("p", "x", "fp", "part", F.explode(F.sequence(F.lit(0), parts - 1)).alias("o"))
    rows = rows.select("p", "x", F.least("part", "o").alias("i"), F.greatest("part", "o").alias("j"), (F.col("part") > F.col("o")).alias("asks"), "fp")
    shard = ["p", "x", "i", "j"]
    dealt = rows.repartition(*shard).sortWithinPartitions(*shard, "asks", "fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, fps, asks = None, [], []
        for batch in batches:
            names = np.stack([batch.column(k).to_numpy().astype(np.int64) for k in range(4)], axis=1)
            late, fp = batch.column(4).to_numpy(zero_copy_only=False), batch.column(5).to_numpy().view(np.uint64)
            borders = np.flatnonzero((names[1:] != names[:-1]).any(axis=1)) + 1
            for start, stop in zip([0, *borders.tolist()], [*borders.tolist(), len(names)]):
                name = tuple(names[start].tolist())
                if name != here:
                    if here is not None:
                        yield from joined(np.concatenate(fps), np.concatenate(asks), radius)
                    here, fps, asks = name, [], []
                fps.append(fp[start:stop])
                asks.append(late[start:stop])
        if here is not None:
            yield from joined(np.concatenate(fps), np.concatenate(asks), radius)

    return dealt.mapInArrow(run, "src long, dst long")


def joined(fp: np.ndarray, asks: np.ndarray, radius: int) -> Iterator[pa.RecordBatch]:
    """Links inside a shard, or between its parts where some rows only ask; nothing that is joined already."""
    if len(fp) < 2:
        return
    first = int(np.count_nonzero(~asks))  # rows that build the tree come first
    label, src, dst = np.arange(len(fp)), [], []
    asked = fp[first:] if first < len(fp) else fp
    shift = first if first < len(fp) else 0
    for point, hit in BkTree(fp[:first]).near(asked, radius):
        names, who = np.unique(label[hit + shift], return_index=True)
        new = names != label[point]
        if new.any():
            src.append(np.full(int(new.sum()), fp[point]))
            dst.append(asked[hit[who[new]]])
            label[np.isin(label, names[new])] = label[point]
    if src:
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).view(np.int64)) for c in (src, dst)], names=["src", "dst"])


def near_duplicates(docs: DataFrame, radius: int = RADIUS, tree_size: int = TREE_SIZE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, fingerprint, component_id)`` per input row; component_id is the smallest doc_id reachable over
    fingerprints that differ in at most ``radius`` bits.

    Equal fingerprints are one node from the start, so exact copies cost nothing further. Null and empty texts have
    fingerprint zero and link like any other; a null id takes part but never names a component (a component of
    null ids only has a null name); repeated rows come back each; an empty table gives an empty result."""
    marked = common.settle(fingerprints(docs, id_col, text_col))
    return _grouped(marked, radius, tree_size).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _grouped(marked: DataFrame, radius: int, tree_size: int) -> DataFrame:
    """``marked`` with the component's smallest doc_id and its first row key."""
    nodes = common.settle(marked.groupBy("fp").agg(F.min("doc_id").alias("first"), F.min(F.struct(*KEY)).alias("head")))
    parts = connected_components(links(nodes.select("fp"), radius, tree_size)).withColumnRenamed("node", "fp")
    named = nodes.join(parts, "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    names = named.groupBy("component").agg(F.min("first").alias("component_id"), F.min("head").alias("head"))
    by_fp = named.select("fp", "component").join(names, "component").select("fp", "component_id", "head")
    return marked.join(by_fp, "fp", "left")


def one_per_group(docs: DataFrame, radius: int = RADIUS, tree_size: int = TREE_SIZE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that come first in their group (smallest doc_id, null ids last), all columns as they are
    whatever their names; of rows equal in id and text one stays. Null and empty texts are one group; an empty table
    gives an empty result."""
    grouped = _grouped(common.settle(fingerprints(docs, id_col, text_col)), radius, tree_size)
    heads = grouped.where(F.struct(*KEY) == F.col("head")).groupBy("head").agg(F.count("*").alias("copies"))
    # input columns travel inside a struct, so none can clash with those added here
    joined_rows = docs.select(common.as_row(docs).alias("row"), F.struct(*common.row_key(id_col, text_col)).alias("head")).join(heads, "head")
    # only where a kept row is repeated do texts take part in an aggregation
    single = joined_rows.where("copies = 1").select("row.*")
    return single.unionByName(joined_rows.where("copies > 1").dropDuplicates(["head"]).select("row.*"))
