"""Merged stretches against all diagonals, texts that repeat themselves, odd rows and names."""

import random
import time

from pyspark.sql import functions as F

from potamos.llm import decontamination as D
from potamos.llm import common

from .test_operators import docs_of


def table_of(items, one_in=0):
    memo = common.Memo(D._normal)
    return D.SeedTable([(k, D.word_hashes(" ".join(x).encode(), memo)) for k, x in enumerate(items)], one_in), memo


def test_merged_rows_cover_the_diagonals():
    rng, total = random.Random(41), 0
    for _ in range(150):
        items = [[f"w{rng.randrange(rng.choice((2, 300)))}" for _ in range(rng.randint(5, 40))] for _ in range(4)]
        table, memo = table_of(items, one_in=D.ONE_IN)
        words = [f"w{rng.randrange(300)}" for _ in range(20)]
        for _ in range(rng.randint(0, 3)):
            at = rng.randint(0, len(words))
            words[at:at] = rng.choice(items)[rng.randint(0, 3) :]
        data = " ".join(words).encode()
        each, rows = list(D.stretches(table, data, memo)), list(D.merged(table, data, memo))
        assert {r[0] for r in rows} == {r[0] for r in each}
        for item in {r[0] for r in rows}:
            mine = sorted(r for r in rows if r[0] == item)
            assert all(a[1] + a[3] <= b[1] for a, b in zip(mine, mine[1:]))  # no two overlap
            whole = {k for r in each if r[0] == item for k in range(r[1], r[1] + r[3])}
            whole |= {k for i, shift, _ in table.whole(D.word_hashes(data, memo)) if i == item for k in range(shift, shift + len(items[i]))}
            assert {k for r in mine for k in range(r[1], r[1] + r[3])} <= whole
            # each diagonal's stretch meets a row
            assert all(any(r[1] < m[1] + m[3] and m[1] < r[1] + r[3] for m in mine) for r in each if r[0] == item)
        total += len(rows)
    assert total > 100


def test_repeated_text_gives_few_rows():
    items = [["a", "b"] * 50, ["c"] * 30]
    table, memo = table_of(items, one_in=D.ONE_IN)
    assert len(list(D.merged(table, b"a b " * 1000, memo))) == 1
    began = time.time()
    assert len(list(D.merged(table, b"a b " * 20_000 + b"c " * 20_000, memo))) == 2
    assert next(table.found(D.word_hashes(b"a b " * 20_000, memo)), None) is not None
    assert time.time() - began < 60


def test_rows_and_names(spark):
    item = " ".join(f"q{k}" for k in range(30))
    docs = docs_of(spark, [item, item, None, "", "x " * 200_000 + item, "clean text"], [1, 1, None, 2, 3, 4])
    for c in ("item_id", "matches", "length", "doc_start"):
        docs = docs.withColumn(c, F.lit(c))
    bench = spark.createDataFrame([(7, item, "u"), (7, item, "u"), (8, None, "u"), (9, "", "u")], "item_id long, text string, doc_id string")
    for blocks in (500_000, 10):
        rows = sorted(tuple(r) for r in D.overlaps(docs, bench, blocks, merge=True, one_in=D.ONE_IN).collect())
        assert rows == [(1, 7, 0, 0, 30, 30), (1, 7, 0, 0, 30, 30), (3, 7, 200_000, 0, 30, 30)]
        left = D.drop_contaminated(docs, bench, blocks, one_in=D.ONE_IN)
        assert left.columns == docs.columns and sorted(r.doc_id or 0 for r in left.collect()) == [0, 2, 4]
        assert D.overlaps(docs.limit(0), bench, blocks, merge=True).count() == D.drop_contaminated(docs.limit(0), bench, blocks).count() == 0
    assert D.drop_contaminated(docs, bench.limit(0)).count() == 6
