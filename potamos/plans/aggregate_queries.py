"""Queries over aggregations, windows, sorting and sampling."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from potamos.operators import cells as C
from potamos.operators import network as N
from potamos.operators import stats as A
from potamos.functions import scalars as S
from potamos.plans.registry import query

# Student's distribution by its finite sum, with gamma functions for the products
P_VALUE = "1 - CASE WHEN nu % 2 = 1 THEN 2 / pi() * (asin(least(abs(r), 1)) + abs(r) * coalesce((SELECT sum(exp(lgamma(k + 1) + 0.5 * ln(pi()) - lgamma(k + 1.5) - ln(2)) * power(sqrt(1 - r * r), 2 * k + 1)) FROM range(0, 30) g(k) WHERE k <= (nu - 3) / 2), 0)) ELSE abs(r) * coalesce((SELECT sum(exp(lgamma(k + 0.5) - lgamma(k + 1) - 0.5 * ln(pi())) * power(sqrt(1 - r * r), 2 * k)) FROM range(0, 30) g(k) WHERE k <= (nu - 2) / 2), 0) END"


@query("o_a01_degrees", "SELECT node, count(*) AS n_lines, sum(i) AS n_in, sum(o) AS n_out FROM (SELECT start_node AS node, CAST(0 AS BIGINT) AS i, CAST(1 AS BIGINT) AS o FROM lines UNION ALL SELECT end_node, 1, 0 FROM lines) e GROUP BY node".replace("sum(i)", "CAST(sum(i) AS BIGINT)").replace("sum(o)", "CAST(sum(o) AS BIGINT)"), ("lines",))
def _(t):
    return N.degrees(t.lines)


@query("o_a02_arg_extremes", "SELECT end_node, arg_max(id, length * 100000000 - id) AS longest, arg_min(id, length * 100000000 + id) AS shortest FROM lines GROUP BY end_node", ("lines",))
def _(t):
    first = F.struct("length", (-F.col("id")).alias("k"))
    return t.lines.groupBy("end_node").agg(F.max_by("id", first).alias("longest"), F.min_by("id", F.struct("length", "id")).alias("shortest"))


@query("o_a03_any_all", "SELECT grwl_value, bool_or(is_outlet = 1) AS some_outlet, bool_and(darea > 60) AS all_large FROM nodes GROUP BY grwl_value", ("nodes",))
def _(t):
    return t.nodes.groupBy("grwl_value").agg(F.bool_or(F.col("is_outlet") == 1).alias("some_outlet"), F.bool_and(F.col("darea") > 60).alias("all_large"))


@query("o_a04_conditional_share", "SELECT id % 32 AS k, sum(CASE WHEN grwl_value = 126 THEN 1 ELSE 0 END) / count(*) AS share FROM nodes GROUP BY 1", ("nodes",))
def _(t):
    return t.nodes.groupBy((F.col("id") % 32).alias("k")).agg((F.count_if(F.col("grwl_value") == 126) / F.count("*")).alias("share"))


@query("o_a05_ratio_keep", "SELECT k, ratio FROM (SELECT id % 32 AS k, sum(CASE WHEN darea > 500 THEN 1 ELSE 0 END) / count(*) AS ratio FROM nodes WHERE is_outlet = 0 GROUP BY 1) r WHERE ratio >= 0.5", ("nodes",))
def _(t):
    inside = t.nodes.where("is_outlet = 0").groupBy((F.col("id") % 32).alias("k")).agg((F.count_if(F.col("darea") > 500) / F.count("*")).alias("ratio"))
    return inside.where("ratio >= 0.5")


@query("o_a06_zonal_stats", "SELECT zx, zy, count(elev) AS non_null_cells, count(*) - count(elev) AS null_cells, min(elev) AS min, max(elev) AS max, sum(elev) AS sum, avg(elev) AS mean, round(stddev_pop(elev), 6) AS stddev, quantile_cont(elev, 0.5) AS median, round(quantile_cont(elev, 0.9), 6) AS p90 FROM cells GROUP BY zx, zy", ("cells",))
def _(t):
    return C.zonal(t.cells, ["zx", "zy"], "elev").withColumns({"stddev": F.round("stddev", 6), "p90": F.round("p90", 6)})


@query("o_a07_zonal_spread", "SELECT x, y, sum(value) OVER w AS zone_sum, max(value) OVER w AS zone_max, count(*) OVER w AS zone_n FROM cells WINDOW w AS (PARTITION BY zx, zy)", ("cells",))
def _(t):
    return C.spread(t.cells, ["zx", "zy"], zone_sum=F.sum("value"), zone_max=F.max("value"), zone_n=F.count("*")).select("x", "y", "zone_sum", "zone_max", "zone_n")


@query("o_a08_half_medians", "WITH k AS (SELECT id, pos, value, count(*) OVER (PARTITION BY id) AS n FROM vertices) SELECT id, quantile_cont(CASE WHEN pos < greatest(1, n // 2) THEN value END, 0.5) AS first_half, quantile_cont(CASE WHEN pos >= n - greatest(1, n // 2) THEN value END, 0.5) AS last_half, quantile_cont(CASE WHEN pos >= n - greatest(1, n // 2) THEN value END, 0.5) - quantile_cont(CASE WHEN pos < greatest(1, n // 2) THEN value END, 0.5) AS gradient FROM k GROUP BY id", ("vertices",))
def _(t):
    return A.half_medians(t.vertices)


_OK = "azimuth_diff IS NOT NULL AND snap_dist <= 80"


@query(
    "o_a09_comparison_totals",
    f"SELECT coalesce(delta_name, 'TOTAL') AS delta_name, sum(length_split) AS length, sum(length_split * avgwidth) AS area, 100 * sum(CASE WHEN NOT ({_OK}) THEN length_split ELSE 0 END) / sum(length_split) AS invalid_pct, 100 * sum(CASE WHEN {_OK} AND azimuth_diff < 90 THEN length_split ELSE 0 END) / sum(CASE WHEN {_OK} THEN length_split ELSE 0 END) AS good_pct, 100 * sum(CASE WHEN {_OK} AND azimuth_diff >= 90 THEN length_split ELSE 0 END) / sum(CASE WHEN {_OK} THEN length_split ELSE 0 END) AS bad_pct FROM comparison GROUP BY ROLLUP (delta_name)",
    ("comparison",),
)
def _(t):
    return A.comparison_totals(t.comparison)


@query(
    "o_a10_validation_shares",
    "WITH g AS (SELECT c, sum(CASE WHEN d < 60 THEN 1 ELSE 0 END) AS right_n, sum(CASE WHEN d >= 60 AND d < 120 THEN 1 ELSE 0 END) AS unclear_n, sum(CASE WHEN d >= 120 THEN 1 ELSE 0 END) AS wrong_n, count(*) AS n FROM (SELECT delta_name AS c, azimuth_diff AS d FROM comparison) x GROUP BY c) SELECT c AS class, right_n / n AS \"right\", unclear_n / n AS unclear, wrong_n / n AS wrong FROM g",
    ("comparison",),
)
def _(t):
    d = F.col("azimuth_diff")
    verdict = F.when(d < 60, "right").when(d < 120, "unclear").otherwise("wrong")
    return A.class_shares(t.comparison.select(F.col("delta_name").alias("class"), verdict.alias("verdict")), "class", "verdict", ["right", "unclear", "wrong"])


@query("o_a11_direction_problems", "SELECT coalesce(domain, 'sum') AS domain, CAST(sum(n_cycles) AS BIGINT) AS n_cycles, CAST(sum(n_forced) AS BIGINT) AS n_forced, CAST(sum(n_lines) AS BIGINT) AS n_lines FROM (SELECT CAST(start_node % 4 AS VARCHAR) AS domain, count(DISTINCT CASE WHEN id % 9 > 0 THEN id % 9 END) AS n_cycles, sum(CASE WHEN id % 30 = 29 THEN 1 ELSE 0 END) AS n_forced, count(*) AS n_lines FROM lines GROUP BY 1) d GROUP BY ROLLUP (domain)", ("lines",))
def _(t):
    per = t.lines.groupBy((F.col("start_node") % 4).cast("string").alias("domain")).agg(F.countDistinct(F.when(F.col("id") % 9 > 0, F.col("id") % 9)).alias("n_cycles"), F.count_if(F.col("id") % 30 == 29).alias("n_forced"), F.count("*").alias("n_lines"))
    return per.rollup("domain").agg(*(F.sum(c).alias(c) for c in ("n_cycles", "n_forced", "n_lines"))).withColumn("domain", F.coalesce("domain", F.lit("sum")))


@query("o_a12_group_counts", "SELECT grwl_value, count(*) AS n, min(id) AS first FROM nodes GROUP BY grwl_value", ("nodes",))
def _(t):
    return t.nodes.groupBy("grwl_value").agg(F.count("*").alias("n"), F.min("id").alias("first"))


@query("o_a13_modal_id", "SELECT end_node, v AS modal FROM (SELECT end_node, v, row_number() OVER (PARTITION BY end_node ORDER BY count(*) DESC, v) AS r FROM (SELECT end_node, id % 3 AS v FROM lines) x GROUP BY end_node, v) m WHERE r = 1", ("lines",))
def _(t):
    return A.modal(t.lines.select("end_node", (F.col("id") % 3).alias("v")), ["end_node"], "v", "modal")


@query("o_a14_length_correlation", "WITH c AS (SELECT id, sum(length) OVER (PARTITION BY id ORDER BY seq) AS cum, y FROM reach_pieces), f AS (SELECT id, CASE WHEN stddev_pop(y) > 0 THEN corr(cum, y) END AS r, count(*) AS n, count(*) - 2 AS nu FROM c GROUP BY id) SELECT id, round(r, 6) AS r, n, round(" + P_VALUE + ", 6) AS p FROM f WHERE n > 2 AND r IS NOT NULL", ("reach_pieces",))
def _(t):
    run = Window.partitionBy("id").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    g = t.reach_pieces.withColumn("cum", F.sum("length").over(run)).groupBy("id").agg(S.pearson_r(F.col("cum"), F.col("y")).alias("r"), F.count("*").alias("n"))
    return g.where("n > 2 AND r IS NOT NULL").select("id", F.round("r", 6).alias("r"), "n", F.round(S.pearson_p(F.col("r"), F.col("n")), 6).alias("p"))


@query("o_a15_share_over", "SELECT id FROM vertices GROUP BY id HAVING sum(CASE WHEN value > 40 THEN 1 ELSE 0 END) / count(*) > 0.5", ("vertices",))
def _(t):
    return t.vertices.groupBy("id").agg(F.avg((F.col("value") > 40).cast("double")).alias("s")).where("s > 0.5").select("id")


@query("o_a16_drainage_share", "SELECT 100 * ((SELECT sum(darea) FROM nodes WHERE is_outlet = 1) + (SELECT sum(value) FROM cells WHERE water)) / (SELECT sum(value) FROM cells) AS share", ("nodes", "cells"))
def _(t):
    a = t.nodes.where("is_outlet = 1").agg(F.sum("darea").alias("a"))
    b = t.cells.agg(F.sum(F.when(F.col("water"), F.col("value"))).alias("b"), F.sum("value").alias("c"))
    return a.crossJoin(b).select((100 * (F.col("a") + F.col("b")) / F.col("c")).alias("share"))  # one row each


@query("o_a17_reach_widths", "SELECT l.id, coalesce(quantile_cont(v.value, 0.5), 0) AS median, count(v.value) AS n FROM lines l LEFT JOIN (SELECT id, value FROM vertices WHERE pos > 1 AND value > 20) v ON v.id = l.id GROUP BY l.id", ("lines", "vertices"))
def _(t):
    w = t.vertices.where("pos > 1 AND value > 20").groupBy("id").agg(F.percentile("value", F.lit(0.5)).alias("median"), F.count("value").alias("n"))
    return N.with_attributes(t.lines.select("id"), w, "id").fillna(0, ["median", "n"])


_DESCRIBED = "count(darea) AS n, avg(darea) AS mean, round(stddev_samp(darea), 6) AS std, min(darea) AS min, quantile_cont(darea, 0.25) AS q1, quantile_cont(darea, 0.5) AS q2, quantile_cont(darea, 0.75) AS q3, max(darea) AS max, sum(darea) AS total"


@query("o_a18_describe", f"SELECT grwl_value, {_DESCRIBED} FROM nodes GROUP BY grwl_value", ("nodes",))
def _(t):
    return A.describe(t.nodes, ["grwl_value"], "darea").withColumn("std", F.round("std", 6))


@query("o_a18_describe_sets", "SELECT coalesce(CAST(region AS VARCHAR), 'TOTAL') AS set_name, count(*) AS n, avg(area) AS mean, round(stddev_samp(area), 6) AS std, min(area) AS min, quantile_cont(area, 0.5) AS q2, max(area) AS max, sum(area) AS total, round(sum(area) / sum((maxx - minx) * (maxy - miny)), 6) AS compactness FROM domains GROUP BY GROUPING SETS ((region), ())", ("domains",))
def _(t):
    """Statistics of each set and of all, with the share of the envelopes that is filled."""
    return A.describe_sets(t.domains, "region").select("set_name", "n", "mean", F.round("std", 6).alias("std"), "min", "q2", "max", "total", F.round("compactness", 6).alias("compactness"))


@query("o_a19_overlap_and_width", "SELECT zx, count(elev) / count(*) AS grwl_overlap, round_even(quantile_cont(elev, 0.5), 0) AS grwl_value, coalesce(round(stddev_pop(elev), 6), 0) AS width_std FROM cells GROUP BY zx", ("cells",))
def _(t):
    z = C.zonal(t.cells, ["zx"], "elev")
    return z.select("zx", (F.col("non_null_cells") / (F.col("non_null_cells") + F.col("null_cells"))).alias("grwl_overlap"), F.bround("median", 0).alias("grwl_value"), F.coalesce(F.round("stddev", 6), F.lit(0.0)).alias("width_std"))


@query("o_a20_dissolve", "SELECT region, min(minx) AS minx, min(miny) AS miny, max(maxx) AS maxx, max(maxy) AS maxy, sum(area) AS area, count(*) AS n FROM domains GROUP BY region", ("domains",))
def _(t):
    return A.dissolve(t.domains, ["region"])


@query("o_a21_neighbour_counts", "SELECT n.id, count(DISTINCT l.id) AS n_segments FROM nodes n LEFT JOIN loose_lines l ON l.end_node = n.id GROUP BY n.id", ("nodes", "loose_lines"))
def _(t):
    c = t.loose_lines.groupBy(F.col("end_node").alias("id")).agg(F.count("*").alias("n_segments"))
    return N.with_attributes(t.nodes.select("id"), c, "id").fillna(0, ["n_segments"])


@query("o_a22_weighted_means", "SELECT end_node % 10 AS k, sum(length * width) / sum(length) AS mean_width, round(atan2(sum(length * sin(radians(start_node % 360))), sum(length * cos(radians(start_node % 360)))), 6) AS mean_angle FROM lines GROUP BY 1", ("lines",))
def _(t):
    rad = F.radians(F.col("start_node") % 360)
    return A.weighted_means(t.lines.withColumns({"k": F.col("end_node") % 10, "rad": rad}), ["k"], "width", "rad", "length")


@query("o_a23_cpu_hours", "SELECT kind, sum(seconds * cpus) / 3600 AS cpu_hrs, count(*) AS n FROM (SELECT event_type AS kind, date_diff('second', date_trunc('second', ts), date_trunc('second', ts) + to_seconds(CAST(floor(value) AS BIGINT) * 60)) AS seconds, user_id % 16 + 1 AS cpus FROM events) l GROUP BY kind")
def _(t):
    start = F.date_trunc("second", "ts")
    fmt = "yyyy-MM-dd HH:mm:ss"
    log = t.events.select(
        "event_type",
        F.concat_ws("|", F.date_format(start, fmt), F.date_format(F.timestamp_seconds(F.unix_seconds(start) + F.floor("value") * 60), fmt), F.concat(F.lit("cpus="), F.col("user_id") % 16 + 1)).alias("line"),
    )
    return A.cpu_hours(log, "line", "event_type", fmt)


@query("o_a24_tile_max", "SELECT x, y, max(value) AS value FROM (SELECT x, y, value FROM cells WHERE x < 60 UNION ALL SELECT x, y, value + 100 FROM cells WHERE x > 40) u GROUP BY x, y", ("cells",))
def _(t):
    a, b = t.cells.where("x < 60").select("x", "y", "value"), t.cells.where("x > 40").select("x", "y", (F.col("value") + 100).alias("value"))
    return a.unionByName(b).groupBy("x", "y").agg(F.max("value").alias("value"))


@query("o_a25_resample_max", "SELECT x // 5 AS x, y // 5 AS y, max(value) AS value FROM cells GROUP BY 1, 2 HAVING max(value) > 700", ("cells",))
def _(t):
    return C.resample(t.cells, 5, value=F.max("value")).where("value > 700")


@query("o_a26_global_compactness", "SELECT region, sum(area) / sum((maxx - minx) * (maxy - miny)) AS compactness FROM domains GROUP BY region", ("domains",))
def _(t):
    return t.domains.groupBy("region").agg((F.sum("area") / F.sum((F.col("maxx") - F.col("minx")) * (F.col("maxy") - F.col("miny")))).alias("compactness"))


@query("o_a27_component_sizes", "SELECT a.k, a.n AS n_self, b.n AS n_other, a.n >= b.n AS keep FROM (SELECT id % 20 AS k, count(*) AS n FROM stations GROUP BY 1) a JOIN (SELECT id % 20 AS k, count(*) AS n FROM nodes GROUP BY 1) b ON a.k = b.k", ("stations", "nodes"))
def _(t):
    a = t.stations.groupBy((F.col("id") % 20).alias("k")).agg(F.count("*").alias("n_self"))
    b = t.nodes.groupBy((F.col("id") % 20).alias("k")).agg(F.count("*").alias("n_other"))
    return a.join(b, "k").withColumn("keep", F.col("n_self") >= F.col("n_other"))


@query("o_a28_direction_stats", f"SELECT 100 * sum(CASE WHEN NOT ({_OK}) THEN 1 ELSE 0 END) / count(*) AS invalid_pct, 100 * sum(CASE WHEN {_OK} AND azimuth_diff < 90 THEN 1 ELSE 0 END) / sum(CASE WHEN {_OK} THEN 1 ELSE 0 END) AS right_pct FROM comparison", ("comparison",))
def _(t):
    ok = F.col("azimuth_diff").isNotNull() & (F.col("snap_dist") <= 80)
    return t.comparison.agg((100 * F.count_if(~ok) / F.count("*")).alias("invalid_pct"), (100 * F.count_if(ok & (F.col("azimuth_diff") < 90)) / F.count_if(ok)).alias("right_pct"))


@query("o_w01_running_sum", "SELECT v.id, v.pos, sum(v.value) OVER (PARTITION BY v.id ORDER BY v.pos) + l.width AS running FROM vertices v JOIN lines l ON l.id = v.id", ("vertices", "lines"))
def _(t):
    run = Window.partitionBy("id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    return t.vertices.join(t.lines.select("id", "width"), "id").select("id", "pos", (F.sum("value").over(run) + F.col("width")).alias("running"))


@query("o_w02_cumulative_length", "SELECT id, end_node, sum(length) OVER (PARTITION BY end_node ORDER BY id) AS cum FROM lines", ("lines",))
def _(t):
    run = Window.partitionBy("end_node").orderBy("id").rowsBetween(Window.unboundedPreceding, 0)
    return t.lines.select("id", "end_node", F.sum("length").over(run).alias("cum"))


@query("o_w03_trim_ends", "SELECT id, pos, x FROM (SELECT id, pos, x, row_number() OVER (PARTITION BY id ORDER BY pos) AS a, row_number() OVER (PARTITION BY id ORDER BY pos DESC) AS b FROM vertices) v WHERE a > 1 AND b > 1", ("vertices",))
def _(t):
    w = Window.partitionBy("id")
    return t.vertices.withColumns({"a": F.row_number().over(w.orderBy("pos")), "n": F.count("*").over(w)}).where("a > 1 AND a < n").select("id", "pos", "x")


@query("o_w04_vertex_gaps", "SELECT id, pos, gap FROM (SELECT id, pos, round(sqrt(power(x - lag(x) OVER w, 2) + power(y - lag(y) OVER w, 2)), 6) AS gap FROM vertices WINDOW w AS (PARTITION BY id ORDER BY pos)) g WHERE gap IS NOT NULL", ("vertices",))
def _(t):
    w = Window.partitionBy("id").orderBy("pos")
    return t.vertices.select("id", "pos", F.round(F.hypot(F.col("x") - F.lag("x").over(w), F.col("y") - F.lag("y").over(w)), 6).alias("gap")).where("gap IS NOT NULL")


@query("o_w05_keep_shortest", "SELECT id FROM (SELECT id, row_number() OVER (PARTITION BY least(start_node, end_node), greatest(start_node, end_node) ORDER BY length, id) AS r FROM messy_lines) d WHERE r > 1", ("messy_lines",))
def _(t):
    w = Window.partitionBy(F.least("start_node", "end_node"), F.greatest("start_node", "end_node")).orderBy("length", "id")
    return t.messy_lines.withColumn("r", F.row_number().over(w)).where("r > 1").select("id")


@query("o_w06_longest_per_node", "SELECT end_node, id FROM (SELECT end_node, id, row_number() OVER (PARTITION BY end_node ORDER BY length DESC, id) AS r, count(*) OVER (PARTITION BY end_node) AS n FROM lines) x WHERE r = 1 AND n > 1", ("lines",))
def _(t):
    g = t.lines.groupBy("end_node").agg(F.max_by("id", F.struct("length", (-F.col("id")).alias("k"))).alias("id"), F.count("*").alias("n"))
    return g.where("n > 1").select("end_node", "id")


@query("o_w07_first_of_cluster", "SELECT id FROM (SELECT id, id // 16 AS c, row_number() OVER (PARTITION BY id // 16 ORDER BY id) AS r FROM nodes WHERE grwl_value IS NOT NULL) x WHERE r = 1 AND c NOT IN (SELECT id // 16 FROM nodes WHERE id % 97 = 5)", ("nodes",))
def _(t):
    n = t.nodes.withColumn("c", F.floor(F.col("id") / 16))
    first = n.where("grwl_value IS NOT NULL").groupBy("c").agg(F.min("id").alias("id"))
    return first.join(n.where("id % 97 = 5").select("c"), "c", "left_anti").select("id")


@query("o_w08_width_share", "SELECT id, width / sum(width) OVER (PARTITION BY start_node) AS share, CASE WHEN row_number() OVER (PARTITION BY start_node ORDER BY width DESC, id) = 1 THEN 1 ELSE 0 END AS is_mainstem FROM lines", ("lines",))
def _(t):
    return N.width_shares(t.lines).select("id", "share", "is_mainstem")


@query("o_w09_share_of_parent", "SELECT class, zx, n / sum(n) OVER (PARTITION BY class) AS share FROM (SELECT class, zx, count(*) AS n FROM cells GROUP BY class, zx) g", ("cells",))
def _(t):
    g = t.cells.groupBy("class", "zx").agg(F.count("*").alias("n"))
    return g.select("class", "zx", (F.col("n") / F.sum("n").over(Window.partitionBy("class"))).alias("share"))


def _average_rank(column: str) -> str:
    return f"(rank() OVER (ORDER BY {column}) + (count(*) OVER (PARTITION BY {column}) - 1) / 2)"


@query("o_w10_rank_sum_top", f"SELECT id, total FROM (SELECT id, {_average_rank('area')} + {_average_rank('minx')} + {_average_rank('maxy')} AS total FROM domains) r ORDER BY total, id LIMIT 10", ("domains",))
def _(t):
    return A.rank_sum_top(t.domains, ["area", "minx", "maxy"], "id", 10)


@query("o_w11_equal_width_bins", "SELECT bin, count(*) AS n FROM (SELECT CAST(least(24, floor((value - lo) / (hi - lo) * 25)) AS BIGINT) AS bin FROM cells CROSS JOIN (SELECT min(value) AS lo, max(value) AS hi FROM cells) b) x GROUP BY bin", ("cells",))
def _(t):
    return A.equal_width_bins(t.cells, "value", 25)


@query("o_l02_two_lowest", "SELECT end_node, start_node FROM (SELECT end_node, start_node, row_number() OVER (PARTITION BY end_node ORDER BY n.darea, start_node) AS r FROM (SELECT DISTINCT end_node, start_node FROM lines) l JOIN nodes n ON n.id = l.start_node) x WHERE r <= 2", ("lines", "nodes"))
def _(t):
    at = t.lines.select("end_node", "start_node").distinct().join(t.nodes.select(F.col("id").alias("start_node"), "darea"), "start_node")
    return at.withColumn("r", F.row_number().over(Window.partitionBy("end_node").orderBy("darea", "start_node"))).where("r <= 2").select("end_node", "start_node")


@query("o_l03_groups_by_share", "SELECT k, share, row_number() OVER (ORDER BY share DESC, k) AS place FROM (SELECT id % 16 AS k, sum(darea) / count(*) AS share FROM nodes GROUP BY 1) g", ("nodes",))
def _(t):
    g = t.nodes.groupBy((F.col("id") % 16).alias("k")).agg((F.sum("darea") / F.count("*")).alias("share"))
    return g.withColumn("place", F.row_number().over(Window.orderBy(F.desc("share"), "k")).cast("long"))  # a row per group


@query("o_l04_greedy_pick", "SELECT id, area FROM domains ORDER BY area DESC, id LIMIT 1", ("domains",))
def _(t):
    return t.domains.select("id", "area").orderBy(F.desc("area"), "id").limit(1)


@query("o_l05_candidates", "SELECT id, area, minx FROM domains ORDER BY minx ASC, area DESC, id LIMIT 7", ("domains",))
def _(t):
    return t.domains.select("id", "area", "minx").orderBy("minx", F.desc("area"), "id").limit(7)


@query("o_l06_weighted_sample")
def _(t):
    picked = A.weighted_sample(t.nodes.select("id", "river_width"), "id", "river_width", 50, seed=7)
    return t.lines.join(picked.select(F.col("id").alias("start_node")), "start_node", "left_semi").select("id", "start_node")


@query("o_l07_sorted_distinct", "SELECT DISTINCT x // 10 AS tx, y // 10 AS ty FROM cells ORDER BY 1, 2", ("cells",))
def _(t):
    return t.cells.select(F.floor(F.col("x") / 10).alias("tx"), F.floor(F.col("y") / 10).alias("ty")).distinct().orderBy("tx", "ty")
