"""Aggregates that go beyond one built-in function."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .lineage import settle


def half_medians(vertices: DataFrame, key: str = "id", pos: str = "pos", value: str = "value") -> DataFrame:
    """Medians of the first and last half of each ordered list and their difference; a half holds one value at least."""
    n = F.count("*").over(Window.partitionBy(key))
    half = F.greatest(F.lit(1), F.floor(F.col("__n") / 2))
    marked = vertices.withColumn("__n", n)
    agg = marked.groupBy(key).agg(
        F.percentile(F.when(F.col(pos) < half, F.col(value)), F.lit(0.5)).alias("first_half"),
        F.percentile(F.when(F.col(pos) >= F.col("__n") - half, F.col(value)), F.lit(0.5)).alias("last_half"),
    )
    return agg.withColumn("gradient", F.col("last_half") - F.col("first_half"))


def comparison_totals(df: DataFrame, by: str = "delta_name", max_dist: float = 80) -> DataFrame:
    """Length, area and shares of invalid, good and bad direction per class, with a TOTAL row; shares of good and bad
    are of what is valid."""
    ok = F.col("azimuth_diff").isNotNull() & (F.col("snap_dist") <= max_dist)
    good = F.col("azimuth_diff") < 90
    total = lambda c: F.sum(F.when(c, F.col("length_split")).otherwise(0))
    agg = df.rollup(by).agg(
        F.sum("length_split").alias("length"), F.sum(F.col("length_split") * F.col("avgwidth")).alias("area"),
        (100 * total(~ok) / F.sum("length_split")).alias("invalid_pct"), (100 * total(ok & good) / total(ok)).alias("good_pct"), (100 * total(ok & ~good) / total(ok)).alias("bad_pct"),
    )
    return agg.withColumn(by, F.coalesce(by, F.lit("TOTAL")))


def class_shares(df: DataFrame, group: str, verdict: str, verdicts: list[str]) -> DataFrame:
    """Share of each verdict in its class, one column per verdict."""
    counts = [F.count_if(F.col(verdict) == v) for v in verdicts]
    return df.groupBy(group).agg(*((c / F.count("*")).alias(v) for c, v in zip(counts, verdicts)))


def modal(df: DataFrame, by: list[str], value: str, name: str) -> DataFrame:
    """The most frequent value of each group, the smallest on ties; counted before the shuffle."""
    counts = df.groupBy(*by, value).agg(F.count("*").alias("__n"))
    return counts.groupBy(*by).agg(F.max_by(value, F.struct("__n", (-F.col(value)).alias("k"))).alias(name))


def describe(df: DataFrame, by: list[str], value: str) -> DataFrame:
    v = F.col(value)
    q = lambda p: F.percentile(v, F.lit(p))
    return df.groupBy(*by).agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"), F.min(v).alias("min"), q(0.25).alias("q1"), q(0.5).alias("q2"), q(0.75).alias("q3"), F.max(v).alias("max"), F.sum(v).alias("total"))


def describe_sets(boxes: DataFrame, by: str, value: str = "area") -> DataFrame:
    """Statistics of a value per set and, as ``TOTAL``, of all rows, with the share of the summed envelopes that it fills."""
    v, box = F.col(value), (F.col("maxx") - F.col("minx")) * (F.col("maxy") - F.col("miny"))
    found = boxes.rollup(by).agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"), F.min(v).alias("min"), F.percentile(v, F.lit(0.5)).alias("q2"), F.max(v).alias("max"), F.sum(v).alias("total"), (F.sum(v) / F.sum(box)).alias("compactness"), F.grouping(by).alias("whole"))
    return found.withColumn("set_name", F.when(F.col("whole") == 1, "TOTAL").otherwise(F.col(by).cast("string"))).drop(by, "whole")


def dissolve(boxes: DataFrame, by: list[str]) -> DataFrame:
    """Envelope and summed area of each group of boxes."""
    return boxes.groupBy(*by).agg(F.min("minx").alias("minx"), F.min("miny").alias("miny"), F.max("maxx").alias("maxx"), F.max("maxy").alias("maxy"), F.sum("area").alias("area"), F.count("*").alias("n"))


def weighted_means(df: DataFrame, by: list[str], value: str, angle: str, weight: str) -> DataFrame:
    """Weighted mean and weighted circular mean (radians)."""
    w, a = F.col(weight), F.col(angle)
    return df.groupBy(*by).agg((F.sum(w * F.col(value)) / F.sum(w)).alias("mean_width"), F.round(F.atan2(F.sum(w * F.sin(a)), F.sum(w * F.cos(a))), 6).alias("mean_angle"))


def cpu_hours(log: DataFrame, line: str, by: str, fmt: str) -> DataFrame:
    """CPU hours per group from log lines ``start|end|cpus=n``."""
    part = lambda k: F.to_timestamp(F.regexp_extract(line, r"^([^|]*)\|([^|]*)\|", k), fmt)
    cpus = F.regexp_extract(line, r"cpus=(\d+)", 1).cast("long")
    seconds = F.unix_seconds(part(2)) - F.unix_seconds(part(1))
    return log.groupBy(F.col(by).alias("kind")).agg((F.sum(seconds * cpus) / 3600).alias("cpu_hrs"), F.count("*").alias("n"))


def running_total(df: DataFrame, order: str, value: str, name: str) -> DataFrame:
    """``df`` with the sum of ``value`` up to each row in the order of a unique column, without a window over all rows:
    rows are ranged over partitions, summed inside, and each partition starts at the total of those before it."""
    ordered = settle(df.repartitionByRange(order).sortWithinPartitions(order).withColumn("__part", F.spark_partition_id()))
    totals = ordered.groupBy("__part").agg(F.sum(value).alias("__s"))
    before = totals.select("__part", (F.sum("__s").over(Window.orderBy("__part")) - F.col("__s")).alias("__before"))  # one row per partition
    inside = F.sum(value).over(Window.partitionBy("__part").orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return ordered.withColumn(name, inside).join(F.broadcast(before), "__part").withColumn(name, F.col(name) + F.col("__before")).select(*df.columns, name)


def rank_sum_top(df: DataFrame, columns: list[str], key: str, n: int) -> DataFrame:
    """The rows with the lowest sum of average ranks. Ranks come from counts per distinct value and their running sum."""
    out = df.select(key, *columns)
    for c in columns:
        counts = df.groupBy(c).agg(F.count("*").alias("__n"))
        ranks = running_total(counts, c, "__n", "__upto").select(F.col(c), (F.col("__upto") - F.col("__n") + 1 + (F.col("__n") - 1) / 2).alias(f"__r_{c}"))
        out = out.join(ranks, c)
    total = sum((F.col(f"__r_{c}") for c in columns[1:]), F.col(f"__r_{columns[0]}"))
    return out.select(key, total.alias("total")).orderBy("total", key).limit(n)


def equal_width_bins(df: DataFrame, value: str, n: int) -> DataFrame:
    """Counts in n equal-width bins between the extremes; the largest value belongs to the last bin."""
    ends = df.agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    at = F.least(F.lit(n - 1), F.floor((F.col(value) - F.col("lo")) / (F.col("hi") - F.col("lo")) * n)).cast("long")
    return df.crossJoin(F.broadcast(ends)).groupBy(at.alias("bin")).agg(F.count("*").alias("n"))  # the ends are one row


def weighted_sample(df: DataFrame, key: str, weight: str, n: int, seed: int = 0) -> DataFrame:
    """n rows without replacement with chances by weight: those with the smallest exponential keys. The draw is a hash
    of the key, so it doesn't depend on partitions."""
    u = (F.pmod(F.xxhash64(F.lit(seed), F.col(key)), F.lit(1 << 40)) + 0.5) / float(1 << 40)
    return df.where(F.col(weight) > 0).withColumn("__e", -F.log(u) / F.col(weight)).orderBy("__e", key).limit(n).drop("__e")
