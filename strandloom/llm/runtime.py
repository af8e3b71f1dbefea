"""Session helpers shared by the operators: shared scratch space, lineage cuts, sizes."""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import scratch, shared_dir, stored

__all__ = ["MOST_PARTITIONS", "cut", "fresh", "held_out", "id_filter", "passing_shuffles", "perhaps", "planned_bytes", "read", "scratch", "shared_dir", "spread"]


#: Partitions that one exchange is given at most.
MOST_PARTITIONS = 1 << 16
#: Bits of one bitmap of an id filter (4 KB, as Spark's bitmap functions have it), and bitmaps of a filter at most (32 MB, which is broadcast).
BITMAP_BITS, MOST_BITMAPS = 1 << 15, 1 << 13


@contextmanager
def passing_shuffles(spark: SparkSession):
    """Inside, a query's shuffle files go when it ends: for queries whose result is stored at once."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def cut(df: DataFrame) -> DataFrame:
    """Cuts lineage with a reliable checkpoint in the shared folder."""
    with passing_shuffles(df.sparkSession):
        return stored(df)


def fresh(name: str, taken: list[str]) -> str:
    """A column name that is not taken (names differ by more than case)."""
    low = {c.lower() for c in taken}
    while name.lower() in low:
        name += "_"
    return name


def planned_bytes(df: DataFrame) -> int:
    """The optimizer's size estimate of df in bytes; reads no data."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def spread(df: DataFrame, per_part: int = 8 << 20, most: int = MOST_PARTITIONS) -> int:
    """Number of partitions or buckets: the session's shuffle partitions, more where the input asks for it.

    Partitions end at `most`, as a driver keeps each of them; groups inside partitions may be as many as the data ask for.
    A petabyte and more is what the optimizer says of inputs that it knows nothing of: those are measured, by a job over their lengths.
    """
    size = planned_bytes(df)
    if size >= 1 << 50:
        lengths = [F.coalesce(F.octet_length(F.col(f"`{c}`").cast("string")), F.lit(0)) for c in df.columns]
        size = df.agg(*(F.sum(n.cast("long")).alias(f"n{i}") for i, n in enumerate(lengths))).first()
        size = sum(n or 0 for n in size)
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(most, size // per_part))


def id_filter(ids: DataFrame, column: str, bitmaps: int) -> DataFrame:
    """A filter of hashed ids: rows (bitmap, bits), MOST_BITMAPS of 4 KB at most.

    One bitmap for each partition of the texts keeps false passes rare; past MOST_BITMAPS
    partitions they grow with the ids, and what passes is still checked by a join.
    """
    place = F.pmod(F.xxhash64(column), F.lit(BITMAP_BITS * min(bitmaps, MOST_BITMAPS)))
    placed = ids.select(F.floor(place / BITMAP_BITS).alias("bitmap"), (place % BITMAP_BITS).alias("bit"))
    # The places are dealt before they are gathered: eight bytes an id move, not a bitmap a task.
    return placed.repartition("bitmap").groupBy("bitmap").agg(F.bitmap_construct_agg("bit").alias("bits"))


def perhaps(docs: DataFrame, column: str, known: DataFrame, bitmaps: int, name: str) -> DataFrame:
    """docs with a boolean `name`: false if the id is null or surely not among those of `known`.  No row is shuffled."""
    bitmap, bits = fresh("bitmap", [*docs.columns, name]), fresh("bits", [*docs.columns, name])
    place = F.pmod(F.xxhash64(F.col(column).cast("long")), F.lit(BITMAP_BITS * min(bitmaps, MOST_BITMAPS)))
    bit = (place % BITMAP_BITS).cast("int")
    byte = F.conv(F.hex(F.substring(F.col(bits), F.floor(bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    hit = F.coalesce(F.col(column).isNotNull() & (F.getbit(byte, bit % 8) == 1), F.lit(False))
    small = F.broadcast(known.withColumnsRenamed({"bitmap": bitmap, "bits": bits}))
    return docs.join(small, F.floor(place / BITMAP_BITS) == F.col(bitmap), "left").withColumn(name, hit).drop(bitmap, bits)


def held_out(doc_id: str) -> Column:
    """Rows that no model may learn from: crc32 of the id as text leaves remainder 0 modulo 5."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
