"""Cutting lineage through storage that every machine of the cluster shares."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, named by ``spark.checkpoint.dir``. Where that is unset a local session
    uses a folder under its warehouse; on a cluster it is an error, as a folder of one machine would lose the tables."""
    conf = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if conf:
        return conf.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
    return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_shared"


def _remove(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def _kept_off_broadcast(df: DataFrame, path: str) -> DataFrame:
    """``df``, read from ``path``, of unknown size to the planner if its rows are above Spark's threshold for broadcasts. Spark
    goes by the size of the files, and tables of ids and coordinates compress to a hundredth of their rows: the driver
    would hold millions of them. What the rows come to is seen at run time, and the other side of a join may still be broadcast."""
    spark = df.sparkSession
    threshold = spark._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    length = at.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(at).getLength()
    if threshold <= 0 or length < threshold / 200 or df.count() * (df._jdf.schema().defaultSize() + 8) <= threshold:
        return df
    return DataFrame(spark._jsparkSession.internalCreateDataFrame(df._jdf.queryExecution().toRdd(), df._jdf.schema(), False), spark)


def settle(df: DataFrame, spent: DataFrame | None = None) -> DataFrame:
    """Write the rows to the shared folder and go on from there: what follows never computes them again, and a lost
    executor costs no more than the stage it was in. ``spent`` is a settled table that nothing reads any more once
    this one is written; its folder goes."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/settled-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    release(spent)
    found = _kept_off_broadcast(spark.read.schema(df.schema).parquet(path), path)
    found._settled = path
    return found


def release(*tables: DataFrame | None) -> None:
    """Remove the folders of settled tables that nothing reads any more; other tables are left alone."""
    for df in tables:
        path = getattr(df, "__dict__", {}).get("_settled")
        if path:
            _remove(df.sparkSession, path)


class Rounds:
    """Rows that a loop adds round by round. They go to one folder and are read at once, so the plan of what follows
    doesn't grow with the number of rounds."""

    def __init__(self, spark: SparkSession):
        self.spark, self.path = spark, f"{shared_dir(spark)}/rounds-{uuid.uuid4().hex}"
        self.schema: T.StructType | None = None
        self.n = 0

    def add(self, df: DataFrame) -> DataFrame:
        """Write one round and read it back."""
        self.schema = df.schema
        path = f"{self.path}/round={self.n}"
        df.write.option("compression", "zstd").parquet(path)
        self.n += 1
        return _kept_off_broadcast(self.spark.read.schema(df.schema).parquet(path), path)

    def all(self) -> DataFrame:
        """All rounds with their number as ``round``."""
        found = self.spark.read.schema(T.StructType([*self.schema.fields, T.StructField("round", T.IntegerType())])).parquet(self.path)
        return _kept_off_broadcast(found, self.path)
