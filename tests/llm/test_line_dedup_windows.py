"""Windows of first holders: the same blocks as with whole documents, and no more than a pair needs."""

import random

from pyspark.sql import functions as F

from potamos.llm import line_dedup

from .test_operators import docs_of


def test_windows_find_what_whole_documents_have():
    rng, total = random.Random(51), 0
    for _ in range(400):
        words_of = {k: rng.choice((0, 2, 5, 12)) for k in range(30)}
        a, b = ([rng.randrange(30) for _ in range(rng.randint(1, n))] for n in (60, 12))
        later = line_dedup.Later(b, [words_of[x] for x in b], 10)
        held = {tuple(a[i:j]): i for i, j in reversed(list(line_dedup.shortest([words_of[x] for x in a], 10)))}
        mine = {tuple(b[i:j]) for i, j in line_dedup.shortest([words_of[x] for x in b], 10)}
        places = sorted(held[r] for r in mine if r in held)
        spans: list[list[int]] = []
        for p in places:
            if spans and p - len(b) <= spans[-1][1] + 1:
                spans[-1][1] = p + len(b)
            else:
                spans.append([max(0, p - len(b)), p + len(b)])
        for low, high in spans:
            later.meet(a[low : high + 1], [p - low for p in places if low <= p <= high])
        blocks = lambda x: {tuple(x[i:j]) for i in range(len(x)) for j in range(i + 1, len(x) + 1) if sum(words_of[y] for y in x[i:j]) >= 10}
        shared = blocks(a)
        spans_b = [(i, j) for i in range(len(b)) for j in range(i + 1, len(b) + 1) if tuple(b[i:j]) in shared]
        assert later.gone <= {k for i, j in spans_b for k in range(i, j)}
        assert all(later.gone & set(range(i, j)) for i, j in spans_b)
        total += len(later.gone)
    assert total > 300


def test_a_long_first_holder_ships_windows_only(spark, monkeypatch):
    common_line = "one line of ten words that very many documents have"
    first = "\n".join(f"line number {k} of the long first holder, which stands alone" for k in range(20_000)) + "\n" + common_line
    texts = [first] + [f"own words {k}\n{common_line}\nown end {k}" for k in range(300)]
    docs = docs_of(spark, texts).repartition(3)
    rows = line_dedup.dedup_lines(docs).collect()
    assert {r.n_lines_removed for r in rows if r.doc_id} == {1} and all(common_line not in r.text for r in rows if r.doc_id)
    assert next(r.text for r in rows if r.doc_id == 0) == first
    widest = []
    real = line_dedup.Later.meet
    cut = line_dedup._windows()
    one = spark.createDataFrame([([5, 50, 51, 90], 3, list(range(100)))], "places array<int>, n_lines int, a array<long>").select(cut.alias("w")).first().w
    widest = [(w.lo, w.lines[0], len(w.lines)) for w in one]
    assert widest == [(2, 2, 7), (47, 47, 8), (87, 87, 7)] and real is line_dedup.Later.meet


def test_clashing_names_long_texts_and_rows(spark):
    block = "\n".join(f"shared line {k} with quite enough words to make a block of it" for k in range(3))
    docs = docs_of(spark, [block, "own\n" + block, "own\n" + block, None, "", "word " * 200_000 + "\n" + block], [1, 2, 2, 3, 4, None])
    for c in ("__doc", "__gone", "doc", "gone", "row", "hashes", "a.b", "first"):
        docs = docs.withColumn(c, F.lit(c))
    done = line_dedup.dedup_lines(docs)
    assert done.columns == [*docs.columns, "n_lines_before", "n_lines_removed"]
    rows = done.collect()
    assert sorted((r.doc_id or 9, (r.text or "")[:3], r.n_lines_removed) for r in rows) == [(1, "sha", 0), (2, "own", 3), (2, "own", 3), (3, "", 0), (4, "", 0), (9, "wor", 3)]
    assert all(r["a.b"] == "a.b" and r["__doc"] == "__doc" for r in rows)
    assert line_dedup.dedup_lines(docs.limit(0)).count() == 0
