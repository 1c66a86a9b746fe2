"""Scans and sinks: attribute tables, vertex text, cell text, points, merged layers, id lists, partitioned export."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from potamos.operators.lineage import shared_dir


def scratch(spark: SparkSession) -> str:
    """A new folder on shared storage."""
    return f"{shared_dir(spark)}/out-{uuid.uuid4().hex}"


def attribute_table(df: DataFrame, key: str, columns: list[str] | None = None) -> DataFrame:
    """Column subset of a keyed table; fails while running if the key repeats or is null."""
    out = df.select(key, *[c for c in columns or df.columns if c != key])
    bad = out.groupBy(key).agg(F.count("*").alias("n")).where((F.col("n") > 1) | F.col(key).isNull()).limit(1)
    if not bad.isEmpty():
        raise ValueError(f"{key} is not a unique key")
    return out


def empty(spark: SparkSession, schema: str) -> DataFrame:
    return spark.createDataFrame([], schema)


def read_vertices(spark: SparkSession, path: str) -> DataFrame:
    """``(id, pos, x, y)`` from text of one feature per line: kind, id, then ``x y`` pairs; kinds other than L are skipped."""
    rows = spark.read.text(path).select(F.split(F.trim("value"), r"\s+").alias("t")).where(F.element_at("t", 1) == "L")
    numbers = F.slice("t", F.lit(3), F.greatest(F.size("t") - 2, F.lit(0)))
    rows = rows.select(F.element_at("t", 2).cast("long").alias("id"), F.posexplode(numbers).alias("k", "v"))
    return rows.groupBy("id", F.floor(F.col("k") / 2).cast("int").alias("pos")).agg(F.max(F.when(F.col("k") % 2 == 0, F.col("v").cast("double"))).alias("x"), F.max(F.when(F.col("k") % 2 == 1, F.col("v").cast("double"))).alias("y"))


def write_vertices(vertices: DataFrame, path: str) -> None:
    ordered = vertices.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("pos", "x", "y"))).alias("v"))
    text = F.concat_ws(" ", F.lit("L"), F.col("id"), F.array_join(F.transform("v", lambda v: F.concat_ws(" ", v.x, v.y)), " "))
    ordered.select(text.alias("value")).write.text(path)


def read_xyz(spark: SparkSession, path: str, bands: list[str]) -> DataFrame:
    """Cells from ``x,y,band...`` text with a declared schema; ``*`` or nothing is null."""
    schema = T.StructType([T.StructField(n, T.DoubleType()) for n in ("x", "y", *bands)])
    return spark.read.csv(path, schema=schema, nullValue="*")


def write_xyz(cells: DataFrame, path: str, band: str, collide: str = "min") -> None:
    """Cells as text; several values of one cell meet by ``collide``."""
    cells.groupBy("x", "y").agg(getattr(F, collide)(band).alias(band)).write.csv(path, nullValue="*")


def parse_point(text: Column) -> Column:
    """Struct of x and y from WKT: a point, or the centre of a multipoint; anything else fails."""
    numbers = F.transform(F.regexp_extract_all(text, F.lit(r"(-?\d+(?:\.\d+)?)"), 1), lambda v: v.cast("double"))
    mean = lambda odd: F.aggregate(F.filter(numbers, lambda _, i: i % 2 == odd), F.lit(0.0), lambda a, v: a + v) / (F.size(numbers) / 2)
    point = F.struct(mean(0).alias("x"), mean(1).alias("y"))
    return F.when(text.rlike(r"^\s*(MULTI)?POINT\s*Z?\s*\("), point).otherwise(F.raise_error(F.concat(F.lit("no point: "), text)).cast("struct<x:double,y:double>"))


def merge_layers(layers: dict[str, DataFrame], source: str, index: str | None = None) -> DataFrame:
    """Union by name of layers that may differ in columns, with the layer's name in ``source``. Where ``index`` is
    given, rows of layers that lack it or hold null in it are left out."""
    out = None
    for name, df in layers.items():
        if index is not None:
            if index not in df.columns:
                continue
            df = df.where(F.col(index).isNotNull())
        df = df.withColumn(source, F.lit(name))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out


def write_ids(ids: DataFrame, column: str, path: str) -> None:
    ids.select(F.col(column).cast("string").alias("value")).write.text(path)


def read_ids(spark: SparkSession, path: str, column: str) -> DataFrame:
    return spark.read.text(path).select(F.col("value").cast("long").alias(column))


def export(df: DataFrame, path: str, partition: str) -> None:
    """Parquet by partition value; rows of one value are gathered first so that each folder gets few files."""
    df.repartition(partition).write.partitionBy(partition).parquet(path)


def export_box(df: DataFrame, minx: float, miny: float, maxx: float, maxy: float) -> DataFrame:
    """Rows inside a box: a predicate that reaches the scan."""
    return df.where((F.col("x") >= minx) & (F.col("x") < maxx) & (F.col("y") >= miny) & (F.col("y") < maxy))


def cached(spark: SparkSession, path: str, build: Callable[[], DataFrame]) -> DataFrame:
    """The table at ``path`` if it is whole there, else what ``build`` makes, written there first."""
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def subset(layer: DataFrame, box: tuple[float, float, float, float], min_area: float) -> DataFrame:
    """Shapes that meet a box and are larger than ``min_area``, cut to it by their envelopes. Columns of an overlay lose
    their ``_left``, those of the other side (``_right``) go, and ``global_id`` is the ``reach_id``. Nothing left is an error."""
    west, south, east, north = (F.lit(float(v)) for v in box)
    found = layer.where((F.col("minx") < east) & (F.col("maxx") > west) & (F.col("miny") < north) & (F.col("maxy") > south) & (F.col("area") > min_area))
    if found.isEmpty():
        raise ValueError("nothing of the layer lies in the box")
    cut = found.withColumns({"minx": F.greatest("minx", west), "miny": F.greatest("miny", south), "maxx": F.least("maxx", east), "maxy": F.least("maxy", north)})
    named = {c: "reach_id" if c == "global_id" else c.removesuffix("_left") for c in cut.columns if not c.endswith("_right")}
    return cut.select(*(F.col(c).alias(n) for c, n in named.items()))


def read_domains(polygons: DataFrame, ids: DataFrame, size: float) -> DataFrame:
    """Polygons ``(cat, minx, miny, maxx, maxy, area)`` of one ``cat`` as one, named by ``ids`` ``(cat, new_id)``, with the
    ids of those whose envelopes overlap theirs as a comma list in order. Envelopes meet through buckets of ``size``."""
    from potamos.operators.spatial import overlapping_boxes

    whole = polygons.join(ids, "cat").groupBy("cat", F.col("new_id").alias("id")).agg(F.min("minx").alias("minx"), F.min("miny").alias("miny"), F.max("maxx").alias("maxx"), F.max("maxy").alias("maxy"), F.sum("area").alias("area"))
    pairs = overlapping_boxes(whole, whole, size).where("a_id <> b_id").groupBy(F.col("a_id").alias("id")).agg(F.concat_ws(",", F.sort_array(F.collect_list("b_id"))).alias("ids_in_envelope"))
    return whole.join(pairs, "id", "left").withColumn("ids_in_envelope", F.coalesce("ids_in_envelope", F.lit(""))).select("id", "cat", "minx", "miny", "maxx", "maxy", "area", "ids_in_envelope")


def excluding(layer: DataFrame, column: str, names: list[str]) -> DataFrame:
    """Rows whose ``column`` isn't in a list; null isn't either."""
    return layer.where(~F.coalesce(F.col(column).isin(names), F.lit(False)))


def aligned_boxes(boxes: DataFrame, grow: float, res: float) -> DataFrame:
    """``boxes`` with ``west, south, east, north``: grown by ``grow`` and then out to the grid of ``res``."""
    low = lambda c: F.floor((F.col(c) - grow) / res) * res
    high = lambda c: F.ceil((F.col(c) + grow) / res) * res
    return boxes.withColumns({"west": low("minx"), "south": low("miny"), "east": high("maxx"), "north": high("maxy")})
