"""What the corpus operators share: the shared folder, stored intermediate tables, distributed ranks."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

#: Rows of single-key tables that may be broadcast; counted before each use (16 bytes a row in the hash relation).
BROADCAST_ROWS = 1_000_000

_own_dirs: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``, or a temporary one where that is unset and the session
    is local.  On a cluster without that setting this raises: executors would write where nobody else can read."""
    there = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if there:
        return there.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_dirs:
        _own_dirs[app] = tempfile.mkdtemp(prefix="recfeat-")
    return _own_dirs[app]


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/recfeat/{name}-{uuid.uuid4().hex}"


def stash(df: DataFrame, name: str, codec: str = "snappy") -> DataFrame:
    """Write ``df`` to the shared folder and return a scan of it: lineage is cut, a lost executor costs a reread."""
    path = new_path(df.sparkSession, name)
    df.write.option("compression", codec).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def checked_broadcast(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if its counted rows are at most ``most``; else as it is, for a shuffled join."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def fresh_name(columns: list[str], stem: str) -> str:
    """A column name that none of ``columns`` has, in any case."""
    taken = {c.lower() for c in columns}
    return next(name for name in (f"{stem}_{i}" for i in range(len(taken) + 1)) if name not in taken)


def without(docs: DataFrame, id_col: str, ids: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns whatever their names, whose id isn't in the one-column ``ids``."""
    name = fresh_name(docs.columns, "gone")
    return docs.join(checked_broadcast(ids.toDF(name)), F.col(id_col).cast("long") == F.col(name), "left_anti")


def small_batches(spark: SparkSession, rows: int = 2000) -> None:
    """Keep Arrow batches of whole texts small: at most ``rows`` rows and 32 MB a batch."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(32 << 20))


def ranked(df: DataFrame, order: list[str], name: str, rank: str = "rank") -> DataFrame:
    """Add the 0-based position of each row in the global order of ``order``, without a one-task window.

    Rows are range-partitioned and sorted, so ties and hot values spread over tasks as long as the last
    columns of ``order`` tell rows apart; positions in a partition are counted there, and the start of each
    partition comes from the partitions' row counts (one row a partition).  The sorted rows are stored once,
    so that the ranges stay as they were whatever is recomputed later.
    """
    low = (1 << 33) - 1
    by = [F.col(c).asc_nulls_first() for c in order]
    kept = stash(df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_at", F.monotonically_increasing_id()), name)
    sizes = kept.groupBy(F.shiftright("_at", 33).alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    before = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    starts = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    return (
        kept.withColumn("_part", F.shiftright("_at", 33)).join(F.broadcast(starts), "_part")
        .withColumn(rank, F.col("_start") + F.col("_at").bitwiseAND(F.lit(low)))
        .drop("_part", "_start", "_at")
    )
