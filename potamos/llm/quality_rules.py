"""Quality rules whose cutoffs are certified on labelled holdouts.

A rule rejects a document when a rate of it exceeds a cutoff. Per stratum (language by default) the strictest cutoff
is taken for which an exact binomial (Clopper-Pearson) bound shows that no more than a given share of documents
labelled good would be rejected. Cutoffs of a rule come from a ladder fixed beforehand and are tested from lenient
to strict, stopping at the first failure (fixed-sequence testing: no price for the ladder's length); the confidence
is divided by the number of rules times strata (Bonferroni), and the allowed share by the number of rules, so that
with probability 1 - delta all strata hold the promise at once. A stratum with too few labels gets no cutoff.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_shouts", "n_exclaims")
SCHEMA = "doc_id long, stratum string, " + ", ".join(f"{c} long" for c in COUNTS)
SYMBOLS = b"#*$%&|<>"
SPACES = b" \t\n\v\f\r"

#: rule -> (numerator, denominator, ladder of cutoffs from lenient to strict)
RULES: dict[str, tuple[str, str, tuple[float, ...]]] = {
    "symbols": ("n_symbols", "n_words", (2.0, 1.0, 0.7, 0.5, 0.3, 0.2, 0.1)),
    "dup_lines": ("n_dup_lines", "n_lines", (0.8, 0.65, 0.5, 0.4, 0.3)),
    "repeats": ("n_repeat_words", "n_words", (0.45, 0.4, 0.35, 0.3, 0.25, 0.2)),
    "shouts": ("n_shouts", "n_words", (0.8, 0.6, 0.4, 0.3, 0.2)),
    "exclaims": ("n_exclaims", "n_words", (1.0, 0.7, 0.5, 0.3, 0.2)),
}
#: Share of good documents that all rules together may reject in a stratum, and the chance of exceeding it anywhere.
ALPHA, DELTA = 0.02, 0.05


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a 3-word window which occurs twice or more in the text."""
    n = len(words)
    if n < 4:
        return 0
    number = {w: k for k, w in enumerate(dict.fromkeys(words))}
    ids, base = np.fromiter(map(number.__getitem__, words), np.int64, n), len(number)
    pairs = ids[:-2] * base + ids[1:-1]
    if base >= 1 << 20:
        pairs = np.unique(pairs, return_inverse=True)[1]
    keys = pairs * base + ids[2:]
    order = np.argsort(keys, kind="stable")
    same = keys[order[1:]] == keys[order[:-1]]
    window = np.zeros(n - 2, bool)
    window[order[1:][same]] = window[order[:-1][same]] = True
    cover = np.zeros(n, bool)
    for k in range(3):
        cover[k : n - 2 + k] |= window
    return int(cover.sum())


def measure(data: bytes) -> tuple[int, ...]:
    """The counts of one text, in the order of COUNTS."""
    words = data.split()
    seen: set[bytes] = set()
    n_lines = n_dup = 0
    for line in data.split(b"\n"):
        if line and not line.isspace():
            n_lines += 1
            if line in seen:
                n_dup += 1
            else:
                seen.add(line)
    chars = len(data.decode("utf-8", "replace")) - sum(map(data.count, SPACES))
    return len(words), chars, sum(map(data.count, SYMBOLS)), n_dup, repeated_words(words), n_lines, sum(map(bytes.isupper, words)), data.count(b"!")


def upper_bound(k: int, n: int, delta: float) -> float:
    """Clopper-Pearson: the largest p for which at most k of n has probability delta, by bisection."""
    if n == 0 or k >= n:
        return 1.0
    logs = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) for i in range(k + 1)]
    low, high = k / n, 1.0
    for _ in range(60):
        p = (low + high) / 2
        a, b = math.log(p), math.log1p(-p) if p < 1 else -math.inf
        tail = sum(math.exp(c + i * a + (n - i) * b) for i, c in enumerate(logs))
        low, high = (p, high) if tail > delta else (low, p)
    return high


def rate(rule: str) -> Column:
    top, bottom, _ = RULES[rule]
    return F.col(top) / F.greatest(F.col(bottom), F.lit(1))


def features(docs: DataFrame, stratum_col: str = "lang", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    def run(batch: pa.RecordBatch):
        counts = [measure(t) for t in common.as_bytes(batch.column(2))]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c, pa.int64()) for c in zip(*counts))], names=["doc_id", "stratum", *COUNTS])

    chosen = common.pick(docs, doc_id=id_col, stratum=stratum_col, text=text_col)
    return common.map_batches(chosen.withColumn("stratum", F.coalesce(F.col("stratum").cast("string"), F.lit(""))), run, SCHEMA)


def calibrate(measured: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> list[tuple]:
    """``(stratum, cutoff of each rule or None)``. One aggregation over all labelled rows; only strata with labels
    enough to certify anything come back, one row each. A document labelled more than once counts as good only if
    all its labels say so; base failures aren't counted, as they go anyway."""
    good = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("quality")).where("quality = 1").select("doc_id")
    held = measured.where(~base_failed()).join(good, "doc_id")
    counts = [F.sum((rate(r) > c).cast("long")).alias(f"{r}_{k}") for r, (_, _, ladder) in RULES.items() for k, c in enumerate(ladder)]
    share, least = alpha / len(RULES), math.log(1 / delta) / (-math.log1p(-alpha / len(RULES)))
    rows = held.groupBy("stratum").agg(F.count("*").alias("n"), *counts).where(F.col("n") >= int(least)).collect()
    found = []
    for row in rows:
        cutoffs: list[float | None] = []
        for rule, (_, _, ladder) in RULES.items():
            best = None
            for k, cutoff in enumerate(ladder):
                rejected = row[f"{rule}_{k}"]
                # the bound lies above the observed share, so it need only be solved below the allowed one
                if rejected > share * row["n"] or upper_bound(rejected, row["n"], delta / (len(RULES) * len(rows))) > share:
                    break
                best = cutoff
            cutoffs.append(best)
        found.append((row["stratum"], *cutoffs))
    return found


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def judge(docs: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA, stratum_col: str = "lang", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts, base verdict and final verdict of every document, one row per input row.

    The counts are written once to the shared folder; labels meet them by doc_id, so texts are never shuffled.
    Null text counts as empty (it fails the base rule), a null id is judged but never calibrates, a null stratum is
    a stratum of its own, repeated rows are judged each, empty tables (documents or labels) give an empty result or
    base rules only; other columns are ignored."""
    measured = common.settle(features(docs, stratum_col, id_col, text_col))
    cutoffs = calibrate(measured, labels, alpha, delta)
    schema = "stratum string, " + ", ".join(f"cut_{r} double" for r in RULES)
    table = docs.sparkSession.createDataFrame(cutoffs, schema)
    over = F.lit(False)
    for rule in RULES:
        over = over | F.coalesce(rate(rule) > F.col(f"cut_{rule}"), F.lit(False))
    judged = measured.join(F.broadcast(table) if len(cutoffs) <= 10_000 else table, "stratum", "left")
    return judged.select("doc_id", "stratum", *COUNTS, base_failed().alias("base_failed"), (~base_failed() & ~over).alias("kept"))


def keep_good(docs: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA, stratum_col: str = "lang", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that ``judge`` keeps, all columns as they are. Texts are measured a second time instead of
    joining verdicts to them, which would shuffle the texts and mix up repeated ids. Null and empty texts go, as they fail
    the base rule; a null id is judged like any other, a null stratum is one of its own, repeated rows stay or go
    together, an empty table of labels leaves the base rule; columns of any name are kept."""
    measured = common.settle(features(docs, stratum_col, id_col, text_col))
    found = {row[0]: row[1:] for row in calibrate(measured, labels, alpha, delta)}
    rules = [(COUNTS.index(top), COUNTS.index(bottom)) for top, bottom, _ in RULES.values()]
    repeats, at = COUNTS.index("n_repeat_words"), (docs.columns.index(text_col), docs.columns.index(stratum_col))

    def good(data: bytes, stratum: object) -> bool:
        counts = measure(data)
        if counts[0] < 50 or 100 * counts[repeats] > 50 * counts[0]:
            return False
        cutoffs = found.get("" if stratum is None else str(stratum), ())
        return not any(c is not None and counts[a] / max(counts[b], 1) > c for c, (a, b) in zip(cutoffs, rules))

    def run(batch: pa.RecordBatch):
        kept = list(map(good, common.as_bytes(batch.column(at[0])), batch.column(at[1]).to_pylist()))
        yield batch.filter(pa.array(kept, pa.bool_()))

    return common.map_batches(docs, run, docs.schema)
