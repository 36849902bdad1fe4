"""Session defaults and the scratch area that fixpoint jobs write to."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Sequence
from contextlib import contextmanager

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

# Values a session needs for the jobs in this package. AQE does the run-time
# sizing: it coalesces small shuffle partitions, splits skewed join partitions
# and turns a join into a broadcast only once it has measured the side.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # call sites of every column expression are not worth their cost here
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "supplygraph") -> SparkSession:
    """A session for tests and benchmarks on one machine."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    for key, value in DEFAULTS.items():
        builder = builder.config(key, value)
    spark = (
        builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", os.environ.get("SUPPLYGRAPH_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, taken from ``spark.checkpoint.dir``.

    Only a local session may fall back to a folder on this machine.
    """
    conf = spark.sparkContext.getConf()
    configured = spark.conf.get("spark.checkpoint.dir", None) or conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by the cluster")
    fallback = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    spark.conf.set("spark.checkpoint.dir", fallback)
    return fallback


@contextmanager
def setting(spark: SparkSession, conf: str, value: str):
    """A session setting for the length of a block."""
    before = spark.conf.get(conf)
    spark.conf.set(conf, value)
    try:
        yield
    finally:
        spark.conf.set(conf, before)


def shuffles_go(spark: SparkSession):
    """The shuffle files of a query are deleted when it has ended, since its result is a written table."""
    return setting(spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")


def keys_apart(spark: SparkSession):
    """Tables dealt out by one key are joined where they lie on this key and more columns."""
    return setting(spark, "spark.sql.requireAllClusterKeysForCoPartition", "false")


class Scratch:
    """Written tables that cut lineage.

    Each ``save`` is one Parquet write into the shared folder followed by a
    read: it survives the loss of executors, carries real file sizes (so join
    strategies are chosen on measured data) and keeps column pruning.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/supplygraph-{label}-{uuid.uuid4().hex[:12]}"
        self._serial = 0
        self.last = self.root

    def path(self, name: str) -> str:
        self._serial += 1
        self.last = f"{self.root}/{self._serial:04d}-{name}"
        return self.last

    def save(self, df: DataFrame, name: str) -> DataFrame:
        return self.save_counted(df, name)[0]

    def save_counted(self, df: DataFrame, name: str) -> tuple[DataFrame, int]:
        """The written table and its row count, taken from the same job."""
        path, seen = self.path(name), Observation()
        with shuffles_go(self.spark):
            df.observe(seen, F.count(F.lit(1)).alias("n")).write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path), seen.get["n"]

    def forget(self, path: str) -> None:
        """Deletes a written table that nothing reads any more."""
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(conf).delete(where, True)


#: Rows from which on the known rows of a loop are kept bucketed by their key.
BUCKETED_FROM = 5_000_000


class GrowingTable:
    """An append-only written table: the ``seen`` side of a fixpoint loop.

    Each round is a folder. With ``keys``, once there are more than
    ``BUCKETED_FROM`` rows, all of them are one table bucketed by the keys as
    well: a join on the keys then reads the known rows where they lie and
    shuffles the new ones alone. (Below, a shuffle costs less than the buckets.)
    """

    def __init__(self, scratch: Scratch, name: str, keys: Sequence[str] = ()):
        self.scratch, self.name, self.keys, self.paths, self.schema = scratch, name, list(keys), [], None
        self.rows, self.table = 0, None

    def append(self, df: DataFrame) -> tuple[DataFrame, int]:
        """The rows just added, read back, and how many they are."""
        added, n = self.scratch.save_counted(df, self.name)
        self.schema = self.schema or df.schema
        if n or not self.paths:
            self.paths.append(self.scratch.last)
            self.rows += n
            if self.table:
                self._bucket(added)
            elif self.keys and self.rows > BUCKETED_FROM:
                everything = self.read()
                self.table = f"{self.name}_{uuid.uuid4().hex}"
                self._bucket(everything)
        return added, n

    def _bucket(self, added: DataFrame) -> None:
        """One file a bucket and round."""
        spark = self.scratch.spark
        buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        dealt = added.repartition(buckets, *self.keys)
        with shuffles_go(spark):
            dealt.write.mode("append").format("parquet").bucketBy(buckets, *self.keys).option("path", f"{self.scratch.root}/{self.table}").saveAsTable(self.table)

    def read(self) -> DataFrame:
        if self.table:
            return self.scratch.spark.read.table(self.table)
        return self.scratch.spark.read.schema(self.schema).parquet(*self.paths)


#: Edges from which on a loop whose walks stay inside a key is dealt out by that key.
DEALT_FROM = 1_000_000


class DealtTable:
    """An append-only table bucketed by ``keys``: joins and groupings on these and more columns move nothing.

    The first rows are shuffled to their buckets; later ones come from the table
    and are written where they are.
    """

    def __init__(self, scratch: Scratch, name: str, keys: Sequence[str]):
        self.scratch, self.keys, self.table = scratch, list(keys), f"{name}_{uuid.uuid4().hex}"
        self.buckets = int(scratch.spark.conf.get("spark.sql.shuffle.partitions"))

    def forget(self) -> None:
        """Deletes the table, which nothing reads any more."""
        self.scratch.spark.sql(f"DROP TABLE {self.table}")
        self.scratch.forget(f"{self.scratch.root}/{self.table}")

    def append(self, df: DataFrame, shuffle: bool = False) -> int:
        """How many rows were added."""
        seen = Observation()
        rows = df.repartition(self.buckets, *self.keys) if shuffle else df
        out = rows.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("append").format("parquet")
        with shuffles_go(self.scratch.spark):
            out.bucketBy(self.buckets, *self.keys).option("path", f"{self.scratch.root}/{self.table}").saveAsTable(self.table)
        return seen.get["n"]

    def read(self) -> DataFrame:
        return self.scratch.spark.read.table(self.table)


class KeyedTable:
    """A table in the order of a key: one folder for each stretch of keys, and the bounds of the stretches.

    A lookup finds the stretches by their bounds and reads those folders alone,
    so it costs the same however large the table is. Rows of one key lie in one
    stretch; a null key is never found.
    """

    def __init__(self, scratch: Scratch, df: DataFrame, key: str, name: str, pieces: int | None = None):
        self.spark, self.key, self.path = scratch.spark, key, scratch.path(f"{name}-by-{key}")
        pieces = pieces or int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        dealt = df.repartitionByRange(pieces, key).withColumn("_piece", F.spark_partition_id()).sortWithinPartitions("_piece", key)
        with shuffles_go(self.spark):
            dealt.write.partitionBy("_piece").parquet(self.path)
        self.schema = df.schema
        bounds = self.spark.read.schema(dealt.schema).parquet(self.path).groupBy("_piece").agg(F.min(key).alias("low"), F.max(key).alias("high"))
        self.bounds = scratch.save(bounds.filter("low IS NOT NULL"), "bounds")

    def least(self):
        """The least key, None if there is none."""
        return self.bounds.agg(F.min("low")).first()[0]

    def lookup(self, *values) -> DataFrame:
        """The rows of these keys."""
        meets = F.lit(False)
        for v in values:
            meets = meets | ((F.col("low") <= F.lit(v)) & (F.col("high") >= F.lit(v)))
        paths = [f"{self.path}/_piece={r[0]}" for r in self.bounds.filter(meets).select("_piece").collect()]
        if not paths:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*paths).filter(F.col(self.key).isin(*values))
