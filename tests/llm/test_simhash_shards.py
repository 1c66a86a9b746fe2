"""Shards of near-duplicate search at every layout, and clashing column names."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from potamos.llm import simhash

from .test_operators import docs_of


def near_points(seed, n, centres=12):
    rng = random.Random(seed)
    points = [rng.getrandbits(64) for _ in range(centres)]
    for _ in range(n - centres):
        p = rng.choice(points)
        for _ in range(rng.randint(0, 4)):
            p ^= 1 << rng.randrange(64)
        points.append(p)
    return np.array(sorted(set(points)), np.uint64)


def test_tree_finds_all_within_the_radius():
    points = near_points(1, 400)
    rng = np.random.default_rng(2)
    asked = np.concatenate((points[::3], rng.integers(0, 1 << 63, 50, np.uint64)))
    for radius in (0, 1, 3, 9):
        found = {(point, q) for point, who in simhash.BkTree(points).near(asked, radius) for q in who.tolist()}
        assert found == {(i, q) for i, a in enumerate(points.tolist()) for q, b in enumerate(asked.tolist()) if (a ^ b).bit_count() <= radius}
    assert list(simhash.BkTree(points[:0]).near(asked, 3)) == [] == list(simhash.BkTree(points).near(asked[:0], 3))


def test_layouts_grow_with_the_table():
    keys = {n: simhash.layout(n) for n in (0, 1, 10_000, 10**6, 10**8, 10**11)}
    for n, layout in keys.items():
        bits = [[b for first, width in key for b in range(first, first + width)] for key in layout]
        assert all(len(set(b)) == len(b) and max(b) < 64 for b in bits)
        assert n < 10**6 or n / 2 ** len(bits[0]) <= 2 * simhash.SHARD_SIZE
        rng = random.Random(n)
        for _ in range(300):  # whichever three bits differ, one key is left alone
            gone = set(rng.sample(range(64), 3))
            assert any(not gone & set(b) for b in bits)
    assert [len(keys[n]) for n in (10_000, 10**8, 10**11)] == [4, 10, 20]


@pytest.mark.parametrize("shard_size, tree_size", [(1024, 8192), (1, 8192), (0.001, 8192), (0.0001, 50), (1024, 20)])
def test_links_at_every_layout(spark, shard_size, tree_size):
    points = near_points(3, 300)
    df = spark.createDataFrame([(int(p),) for p in points.view(np.int64)], "fp long")
    found, want = simhash.Forest(), simhash.Forest()
    rows = simhash.links(df, tree_size=tree_size, shard_size=shard_size).collect()
    for r in rows:
        a, b = r.src & (1 << 64) - 1, r.dst & (1 << 64) - 1
        assert (a ^ b).bit_count() <= 3
        found.join(a, b)
    values = points.tolist()
    for k, a in enumerate(values):
        for b in values[:k]:
            if (a ^ b).bit_count() <= 3:
                want.join(a, b)
    assert [found.root(p) for p in values] == [want.root(p) for p in values]


def test_clashing_names_and_repeated_rows(spark):
    docs = docs_of(spark, ["one two three four", "one two three four", None, "", "five six seven"])
    for c in ("late", "id", "row", "head", "copies", "fp", "__late", "__copies", "component"):
        docs = docs.withColumn(c, F.lit(c))
    left = simhash.one_per_group(docs.union(docs))
    assert left.columns == docs.columns and sorted(r.doc_id for r in left.collect()) == [0, 2, 4]
    assert {r.doc_id: r.component_id for r in simhash.near_duplicates(docs).collect()} == {0: 0, 1: 0, 2: 2, 3: 2, 4: 4}
    long = docs_of(spark, ["word " * 300_000, "word " * 300_001])
    assert simhash.one_per_group(long).count() == 1 and simhash.one_per_group(docs.limit(0)).count() == 0
