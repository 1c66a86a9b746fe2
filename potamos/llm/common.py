"""Helpers shared by the training-data operators: column access, shared storage, word memos."""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from potamos.operators.lineage import settle, shared_dir

__all__ = ["KEY", "Memo", "as_bytes", "as_row", "as_text", "keep_rows", "map_batches", "open_fs", "pick", "row_key", "settle", "shared_dir", "spread_join", "table"]

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Units longer than this many bytes are computed but not remembered.
MEMO_UNIT_BYTES = 64
#: A memo that has grown beyond this many units is emptied between two batches.
MEMO_UNITS = 700_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(df: DataFrame, **columns: str) -> DataFrame:
    """Project ``alias=column`` pairs; whatever else the input carries is pruned before any Python runs,
    so extra columns can't clash with an operator's own names."""
    return df.select(*(df[name].alias(alias) for alias, name in columns.items()))


def as_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 of a string column; null reads as the empty text."""
    return [b"" if v is None else v for v in column.cast(pa.binary()).to_pylist()]


def as_text(column: pa.Array) -> list[str]:
    return ["" if v is None else v for v in column.to_pylist()]


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], Iterable[pa.RecordBatch]], schema) -> DataFrame:
    """``mapInArrow`` for functions that treat each batch on its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield from fn(batch)

    return df.mapInArrow(run, schema)


def open_fs(uri: str) -> tuple[pafs.FileSystem, str]:
    """A file system and path for a folder name as Spark writes it."""
    if re.match(r"file:/+", uri):
        return pafs.LocalFileSystem(), re.sub(r"^file:/+", "/", uri)
    return pafs.FileSystem.from_uri(uri) if "://" in uri else (pafs.LocalFileSystem(), uri)


class Memo(dict):
    """Word-level memo: ``memo[unit]`` computes a missing unit once. Bounded: long units aren't stored and
    ``trim`` empties a full memo, which changes speed only."""

    def __init__(self, compute: Callable[[bytes], object]):
        super().__init__()
        self.compute = compute

    def __missing__(self, unit: bytes):
        value = self.compute(unit)
        if len(unit) <= MEMO_UNIT_BYTES:
            self[unit] = value
        return value

    def trim(self) -> None:
        if len(self) > MEMO_UNITS:
            self.clear()


#: A key with more than this share of all rows is dealt out; so fewer than 1 / HEAVY keys are.
HEAVY = 0.001


def spread_join(many: DataFrame, one: DataFrame, counts: DataFrame, key: str) -> DataFrame:
    """Inner join of ``many`` with ``one`` (a row per key) in which no task meets more than about ``HEAVY`` of the rows
    of one key. ``counts`` holds ``(key, n)``, how many rows of ``many`` have each key."""
    total = counts.agg(F.sum("n")).first()[0] or 0
    heavy = counts.where(F.col("n") > HEAVY * total).select(key, F.ceil(F.col("n") / F.lit(HEAVY * total)).cast("int").alias("__parts"))
    parts = F.coalesce("__parts", F.lit(1))
    dealt = many.join(F.broadcast(heavy), key, "left").select(*many.columns, F.pmod(F.xxhash64(*many.columns), parts).cast("int").alias("__part"))
    copied = one.join(F.broadcast(heavy), key, "left").select(*one.columns, F.explode(F.sequence(F.lit(0), parts - 1)).alias("__part"))
    return dealt.join(copied, [key, "__part"]).drop("__part")


#: What tells documents apart: null ids last, then the id, then a hash of the text. Rows equal in all three are one document.
KEY = ("late", "id", "th")


def row_key(id_col: str, text_col: str) -> list[Column]:
    """The columns of KEY; structs of them compare in document order and join null-safely."""
    return [F.col(id_col).isNull().alias("late"), F.coalesce(F.col(id_col).cast("long"), F.lit(0)).alias("id"), F.xxhash64(text_col).alias("th")]


def as_row(df: DataFrame) -> Column:
    """All columns as one struct, so that none can clash with columns that an operator adds."""
    return F.struct(*(F.col(f"`{c}`") for c in df.columns))


def keep_rows(df: DataFrame, text_col: str, keep: Callable[[list[bytes]], list[bool]]) -> DataFrame:
    """Filter whole rows by a function of their texts, without a shuffle."""
    at = df.columns.index(text_col)

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        yield batch.filter(pa.array(keep(as_bytes(batch.column(at))), pa.bool_()))

    return map_batches(df, run, df.schema)
