"""Verdicts, fitted weights and the whole pipeline against plain Python."""

import math
import random
import re
import zlib
from array import array

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from potamos.llm import classifier, decontamination, quality_rules, queries

from .test_operators import brute_fingerprint, brute_measure, docs_of

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def all_counts(text):
    words = WORD.findall(text)
    n_lines = sum(1 for x in text.split("\n") if WORD.search(x))
    shouts = sum(1 for w in words if re.search("[A-Z]", w) and not re.search("[a-z]", w))
    return dict(zip(quality_rules.COUNTS, (*brute_measure(text), n_lines, shouts, text.count("!"))))


def fails_base(c):
    return c["n_words"] < 50 or 100 * c["n_repeat_words"] > 50 * c["n_words"]


def plain_verdicts(rows, good, alpha, delta):
    """``rows`` is (id, stratum, text): certify by the binomial distribution function itself, then judge."""
    counts = [(i, s or "", all_counts(t or "")) for i, s, t in rows]
    share = alpha / len(quality_rules.RULES)
    held = {}
    for i, s, c in counts:
        if i in good and not fails_base(c):
            held.setdefault(s, []).append(c)
    least = int(math.log(1 / delta) / -math.log1p(-share))
    held = {s: cs for s, cs in held.items() if len(cs) >= least}
    price = delta / (len(quality_rules.RULES) * max(1, len(held)))
    cut = {}
    for s, cs in held.items():
        n = len(cs)
        for rule, (top, bottom, ladder) in quality_rules.RULES.items():
            for c in ladder:
                k = sum(x[top] / max(1, x[bottom]) > c for x in cs)
                if sum(math.comb(n, j) * share**j * (1 - share) ** (n - j) for j in range(k + 1)) > price:
                    break
                cut[s, rule] = c
    kept = {}
    for i, s, c in counts:
        over = any((s, r) in cut and c[top] / max(1, c[bottom]) > cut[s, r] for r, (top, bottom, _) in quality_rules.RULES.items())
        kept.setdefault(i, []).append((fails_base(c), not fails_base(c) and not over))
    return kept, cut


def test_verdicts_over_strata(spark):
    rng = random.Random(61)
    rows, good = [], set()
    for s, (n, dirt) in {"en": (1700, 0.004), "de": (1500, 0.0), "fr": (1800, 0.05), "xx": (60, 0.0), None: (40, 0.0)}.items():
        for _ in range(n):
            words = [f"w{rng.randrange(4000)}" for _ in range(55)]
            if rng.random() < dirt:
                words = [w + rng.choice(("***", "!!", "")) for w in words]
            rows.append((len(rows), s, "\n".join(" ".join(words[k : k + 11]) for k in range(0, 55, 11))))
            good.add(len(rows) - 1)
        for kind in ("#x ", "HEY ", "a! ", "same line\n", "p q r "):
            for k in range(8):
                text = " ".join(f"w{rng.randrange(4000)}" for _ in range(50)) + " " + kind * (k * 6)
                rows.append((len(rows), s, text))
    rows += [(len(rows), "en", None), (len(rows) + 1, "en", ""), (None, "en", rows[0][2]), (0, "en", rows[0][2])]
    labels = spark.createDataFrame([(i, 1) for i in good] + [(1, 0), (None, 1)] + [(i, None) for i in range(1700, 1703)], "doc_id long, quality int")
    want, cut = plain_verdicts(rows, good - {1}, quality_rules.ALPHA, quality_rules.DELTA)
    assert len({s for s, _ in cut}) == 3 and len(set(cut.values())) > 4
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string").withColumn("kept", F.lit("x")).withColumn("stratum", F.lit("y")).repartition(3)
    got = {}
    for r in quality_rules.judge(docs, labels).collect():
        got.setdefault(r.doc_id, []).append((r.base_failed, r.kept))
    assert got == want
    left = quality_rules.keep_good(docs, labels)
    assert left.columns == docs.columns
    assert sorted((r.doc_id if r.doc_id is not None else -1) for r in left.collect()) == sorted((i if i is not None else -1) for i, v in want.items() for _, kept in v if kept)
    for text in ("One TWO!\n\nÀ B1 !\n" * 3, "é\nE\n \n!", ""):
        assert dict(zip(quality_rules.COUNTS, quality_rules.measure(text.encode()))) == all_counts(text)


def plain_places(text):
    def shape(w):
        for pattern, mark in ((rb"[A-Z]+", b"A"), (rb"[a-z\x80-\xff]+", b"a"), (rb"[0-9]+", b"0")):
            w = re.sub(pattern, mark, w)
        return w

    top, mix = 1 << 64, 0x9E3779B97F4A7C15
    words = text.encode().split()
    out = []
    for sequence in ([xxhash.xxh64_intdigest(w) for w in words], [xxhash.xxh64_intdigest(shape(w), 7) for w in words]):
        out += [h >> 46 for h in sequence]
        out += [((a * mix % top) ^ (b >> 7)) * mix % top >> 46 for a, b in zip(sequence, sequence[1:])]
    return out


def test_fitted_weights_against_plain_ftrl(spark):
    rng = random.Random(62)
    texts = [" ".join(rng.choice(("river", "Stone", "x9", "$$$", "delta-" + "ab" * 40, "a" + "-b" * 30)) for _ in range(rng.randint(0, 12))) for _ in range(60)]
    docs = docs_of(spark, texts)
    labels = spark.createDataFrame([(k, int("$$$" not in t)) for k, t in enumerate(texts)], "doc_id long, quality int")
    order = [r.doc_id for r in labels.orderBy(F.xxhash64("doc_id"), "doc_id").collect() if zlib.crc32(str(r.doc_id).encode()) % 5]
    examples = []
    for i in order:
        places = plain_places(texts[i])
        x = {p: float(np.float32(places.count(p) / math.sqrt(max(1, len(places))))) for p in set(places)}
        examples.append((x | {classifier.SIZE: 1.0}, float("$$$" not in texts[i])))
    z, n = {}, {}

    def weight(p):
        value = z.get(p, 0.0)
        if abs(value) <= classifier.L1:
            return 0.0
        return -(value - math.copysign(classifier.L1, value)) / ((classifier.BETA + math.sqrt(n.get(p, 0.0))) / classifier.ALPHA + classifier.L2)

    draw = np.random.default_rng(1)
    for _ in range(classifier.EPOCHS):
        for k in draw.permutation(len(examples)):
            x, label = examples[k]
            w = {p: weight(p) for p in x}
            p_hat = 1 / (1 + math.exp(-sum(w[p] * v for p, v in x.items())))
            for p, v in x.items():
                g = (p_hat - label) * v
                sigma = (math.sqrt(n.get(p, 0.0) + g * g) - math.sqrt(n.get(p, 0.0))) / classifier.ALPHA
                z[p], n[p] = z.get(p, 0.0) + g - sigma * w[p], n.get(p, 0.0) + g * g
    fitted = classifier.fit(docs, labels)
    want = np.zeros(classifier.SIZE + 1)
    for p in z:
        want[p] = weight(p)
    assert np.allclose(fitted, want, atol=1e-5) and np.count_nonzero(want) > 50
    for r in classifier.score(docs, fitted).collect():
        places = plain_places(texts[r.doc_id])
        raw = want[classifier.SIZE] + sum(want[p] for p in places) / math.sqrt(max(1, len(places)))
        assert r.score == pytest.approx(1 / (1 + math.exp(-raw)), abs=1e-4)


def test_classifier_rows(spark):
    docs = docs_of(spark, ["a b", "a b", None, "", "word " * 200_000], [1, 1, None, 2, 3])
    for c in ("score", "predicted", "held_out", "label", "x"):
        docs = docs.withColumn(c, F.lit(c))
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, None), (None, 1), (3, 1), (77, 1)], "doc_id long, quality int")
    rows = classifier.score(docs, classifier.fit(docs, labels)).collect()
    assert len(rows) == 5 and all(0 <= r.score <= 1 for r in rows) and sum(r.doc_id is None for r in rows) == 1
    assert classifier.score(docs.limit(0), classifier.fit(docs.limit(0), labels)).count() == 0


def plain_contaminated(words, item):
    """Whole items with at most one word in five changed, and stretches that reach the score on a diagonal that a mask hits."""
    n = len(item)
    for s in range(len(words) - n + 1):
        if n and sum(a != b for a, b in zip(words[s:], item)) <= n // decontamination.ONE_IN:
            return True
    for shift in range(-n, len(words)):
        same = [words[j + shift] == item[j] for j in range(n) if 0 <= j + shift < len(words)]
        if any(all(same[k + d] for d, on in enumerate(m) if on == "1") for m in decontamination.MASKS for k in range(len(same) - len(m) + 1)):
            best = run = 0
            for x in same:
                run = max(0, run + (1 if x else -decontamination.PENALTY))
                best = max(best, run)
            if best >= decontamination.MIN_SCORE:
                return True
    return False


def test_pipeline_brute_force(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(63)
    line = lambda n=12: " ".join(f"v{rng.randrange(100_000)}" for _ in range(n))
    bench = [line(n).split() for n in (30, 14, 6, 60)]
    passages = [[line() for _ in range(k)] for k in (1, 2, 4)]
    texts = []
    for k in range(90):
        own = [line() for _ in range(rng.randint(5, 9))]
        if k % 3 == 0:
            at = rng.randint(0, len(own))
            own[at:at] = rng.choice(passages)
        if k % 7 == 3:
            item = list(rng.choice(bench))
            item[rng.randrange(len(item))] = "changed"
            own.insert(rng.randint(0, len(own)), "x " + " ".join(item))
        if k % 11 == 5:
            own = own[:3]
        if k % 13 == 6:
            own = ["one two three four five six seven eight nine ten eleven"] * 8
        texts.append("\n".join(own))
    texts += [texts[1].upper(), texts[2].upper(), texts[2], texts[8] + " end", None, "", "w " * 60, "\n".join(passages[2] + passages[1] + passages[0] * 2)]
    # each id once, not in order of rows
    ids = rng.sample(range(1000), len(texts))
    documents = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in zip(ids, texts)], "doc_id long, text string, lang string, source string, n_chars long")
    documents.repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, 0) for i in ids], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(k, " ".join(x)) for k, x in enumerate(bench)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))

    docs = {i: t or "" for i, t in zip(ids, texts)}
    docs = {i: t for i, t in docs.items() if not fails_base(all_counts(t))}
    assert len(docs) < len(texts) - 8
    held, slim = set(), {}
    for i in sorted(docs):  # every line here has ten words or more, or stands alone
        lines = docs[i].split("\n")
        kept = [x for x in lines if x not in held or len(x.split()) < 10]
        held |= {x for x in lines if len(x.split()) >= 10}
        if kept == lines or WORD.search("\n".join(kept)):
            slim[i] = "\n".join(kept)
    assert slim != docs and len(slim) < len(docs)
    prints = {i: brute_fingerprint(spark, t) for i, t in slim.items()}
    group = {i: i for i in slim}
    for _ in slim:
        new = {a: min(group[b] for b in slim if (prints[a] ^ prints[b]).bit_count() <= 3) for a in slim}
        if new == group:
            break
        group = new
    single = {i: slim[i] for i in slim if group[i] == i}
    assert len(single) < len(slim)
    clean = {i: t for i, t in single.items() if not any(plain_contaminated(re.findall(r"\w+", t.lower()), b) for b in bench)}
    assert len(clean) < len(single) - 5
    library, want = Tokenizer.from_file(queries.vocabulary()), set()
    for i, t in clean.items():
        x = [*library.encode(t, add_special_tokens=False).ids, 0]
        want |= {(i, p, len(x[at : at + 2048]), zlib.crc32(array("I", x[at : at + 2048]).tobytes())) for p, at in enumerate(range(0, len(x), 2048))}
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {(r.doc_id, r.piece, r.length, r.ids_crc32) for r in rows} == want and len(rows) == len(want)


def test_pipeline_of_nothing(spark, tmp_path):
    import corpus_pipeline

    for name, schema in (("documents", "doc_id long, text string, lang string, source string, n_chars long"), ("labels", "doc_id long, quality int, toxic int"), ("benchmark", "item_id long, text string")):
        spark.createDataFrame([], schema).write.parquet(str(tmp_path / f"{name}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
