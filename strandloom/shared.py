"""The shared folder of a session, frames that are stored in it, and frames dealt into as many parts as the input asks for."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """Folder that all executors share: spark.checkpoint.dir; where it is unset, a local session gets one of its own.

    On a cluster a folder of the driver's machine would be of no use, so there an unset one is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = getattr(shared_dir, "own", None) or f"file://{tempfile.mkdtemp(prefix='strandloom-')}"
        shared_dir.own = root
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """df, computed once and kept in the shared folder: for frames that a plan reads more than once."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


#: Bytes of input files for one partition of what is dealt, so many of them as are worth it, and partitions of one exchange at most.
PART_BYTES, FEW_PARTS, MOST_PARTS = 4 << 20, 8, 1 << 16


def parts(df: DataFrame) -> int | None:
    """Partitions for df: the session's shuffle partitions, more where the files that df reads ask for it; none for small inputs.

    The sizes are those of the files, each as often as df reads it; no job runs.  Inputs of unknown size and streams count as small.
    """
    if df.isStreaming:
        return None
    leaves = df._jdf.queryExecution().analyzed().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    n = sum(s for s in sizes if s < 1 << 50) // PART_BYTES
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(MOST_PARTS, n)) if n >= FEW_PARTS else None


def dealt(df: DataFrame, *columns: str, of: DataFrame | None = None) -> DataFrame:
    """df dealt out by columns, so that a task's share does not grow with the input; small inputs are left to Spark's own coalescing.

    Where df is made of another frame's rows by steps that name its files again and again, that frame, `of`, tells how many parts it takes.
    """
    n = parts(df if of is None else of)
    return df.repartition(n, *columns) if n else df.repartition(*columns)


def ordered(df: DataFrame, *columns: str) -> DataFrame:
    """df sorted as a whole: ranges of the order in as many parts as dealt() makes, sorted each."""
    n = parts(df)
    return df.repartitionByRange(n, *columns).sortWithinPartitions(*columns) if n else df.orderBy(*columns)


def spread(df: DataFrame, *columns: str) -> DataFrame:
    """df dealt out by columns for work that takes long for its bytes: in no fewer parts than the session's, however few its files have."""
    return df.repartition(parts(df) or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *columns)
