"""Packers and shards: placement against a plain packer, limits that bind, equal rows, clashing names."""

import random
import zlib
from array import array

import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from potamos.llm import packing, queries, records

from .test_operators import docs_of, random_texts

VOCABULARY = queries.vocabulary()


@pytest.fixture(scope="module")
def ids_of():
    library = Tokenizer.from_file(VOCABULARY)
    return lambda text: library.encode(text or "", add_special_tokens=False).ids


def plain_packer(lengths, capacity, open_bins):
    """Bounded-space best fit by looking at every open bin."""
    bins, out, made = {}, [], 0
    for n in lengths:
        fits = [(free, -b) for b, free in bins.items() if free >= n]
        if fits:
            free, b = min(fits)
            b = -b
        else:
            if len(bins) >= open_bins:
                del bins[-min((free, -b) for b, free in bins.items())[1]]
            b, free, made = made, capacity, made + 1
        out.append((b, capacity - free))
        bins[b] = free - n
        if not bins[b]:
            del bins[b]
    return out


@pytest.mark.parametrize("open_bins", [1, 3, 10, 1000])
def test_best_fit_against_plain(open_bins):
    rng = random.Random(open_bins)
    lengths = [rng.choice((1, 2, 3, rng.randint(1, 40))) for _ in range(3000)]
    packer = packing.BestFit(40, open_bins)
    got, want = [packer.place(n) for n in lengths], plain_packer(lengths, 40, open_bins)
    # bins with equal space are alike, so they may swap: the offsets and the number of bins can't differ
    assert [o for _, o in got] == [o for _, o in want] and packer.made == len({b for b, _ in want})
    assert packer.open <= open_bins


def whole(rows, capacity):
    bins = {}
    for r in sorted(rows, key=lambda r: r.offset):
        assert bins.setdefault(r.sequence_id, 0) == r.offset
        bins[r.sequence_id] += r.length
    assert max(bins.values()) <= capacity
    return bins


def test_several_packers_and_a_limit_that_binds(spark, ids_of):
    texts = random_texts(400, 5) + ["word " * 700, None, ""]
    docs = docs_of(spark, texts).withColumn("deal", F.lit("x")).withColumn("sequence_id", F.lit("y"))
    want = set()
    for k, t in enumerate(texts):
        ids = [*ids_of(t), 0]
        want |= {(k, p, at, len(ids[at : at + 256]), zlib.crc32(array("I", ids[at : at + 256]).tobytes())) for p, at in enumerate(range(0, len(ids), 256))}
    made = {}
    for open_bins in (4, 100_000):
        rows = packing.pack(docs, VOCABULARY, capacity=256, open_bins=open_bins, pieces_per_packer=120, block=32).collect()
        assert {(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows} == want and len(rows) == len(want)
        made[open_bins] = len(whole(rows, 256))
    least = sum(w[3] for w in want) / 256
    assert least <= made[100_000] <= made[4] <= 1.2 * least + 4


def test_equal_rows_are_dealt_out(spark):
    docs = spark.range(3000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("").alias("text"))
    rows = packing.pack(docs.repartition(3), VOCABULARY, pieces_per_packer=300).collect()
    assert len(rows) == 3000 and len({r.sequence_id >> 40 for r in rows}) > 5
    whole(rows, 2048)
    assert packing.pack(docs.limit(0), VOCABULARY).count() == 0


def test_shards_follow_bytes_and_split_equal_rows(spark, ids_of, tmp_path):
    texts = ["same text"] * 200 + ["other"] * 3 + [None, ""]
    docs = docs_of(spark, texts, [None] * 100 + [7] * 100 + [1, 2, 3, 4, 5]).withColumn("draw", F.lit("x")).repartition(5)
    shards = records.write(docs, VOCABULARY, str(tmp_path / "s"), shard_bytes=100)
    assert shards.count() >= 12 and max(r.n_records for r in shards.collect()) < 80
    rows = sorted(records.read_back(shards, str(tmp_path / "s")).collect(), key=lambda r: r.start)
    assert len(rows) == 205 and rows[0].start == 0 and all(a.start + a.n_tokens == b.start for a, b in zip(rows, rows[1:]))
    assert [r.doc_id for r in rows] == [None] * 100 + [1, 2, 3, 4, 5] + [7] * 100
    assert {(r.doc_id, r.ids_crc32) for r in rows if r.doc_id in (None, 7)} == {(i, zlib.crc32(array("I", [*ids_of("same text"), 1]).tobytes())) for i in (None, 7)}
