"""Sweeps over positions that do not put a whole sequence into one task.

A sweep needs, for each row, a summary of all rows before it.  Rows are binned
by position and dealt out by (key, bin); a window works inside each bin, and
what comes in from other bins is summed up over one row a bin.  Nothing is
stored and no job runs: both uses of the rows begin at the same exchange, of
which Spark makes one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..coords import BIN
from ..shared import dealt


def with_bin(df: DataFrame, position: str, width: int = BIN) -> DataFrame:
    return df.withColumn("_bin", F.floor(F.col(position) / width))


def binned(df: DataFrame, keys: list[str], position: str, width: int = BIN, *, of: DataFrame | None = None) -> DataFrame:
    """df with _bin, dealt out by keys and bin in as many parts as the input (`of`, if named) asks for; rows without a key or position are left out."""
    rows = with_bin(df, position, width)
    for c in (*keys, "_bin"):
        rows = rows.filter(F.col(c).isNotNull())
    return dealt(rows, *keys, "_bin", of=of)


def referred(df: DataFrame, aggregates: tuple[Column, ...]) -> list[str]:
    """The columns of df that the aggregates read, in df's order."""
    names = df.agg(*aggregates)._jdf.queryExecution().analyzed().references().toSeq()
    found = {names.apply(i).name() for i in range(names.size())}
    return [c for c in df.columns if c in found]


def digest(rows: DataFrame, like: list[str] | None = None) -> Column:
    """A number from all columns, or those named; maps are left out, as they have none."""
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    return F.xxhash64(*(c for c in like or rows.columns if "map<" not in kinds[c]))


def per_bin(rows: DataFrame, keys: list[str], *aggregates: Column, like: list[str] | None = None) -> DataFrame:
    """Aggregates of each bin of binned rows.

    A digest of the columns `like` (all, if not named) is asked for, too, so
    that this exchange has the same columns as the other use's and is the same.
    """
    return rows.groupBy(*keys, "_bin").agg(*aggregates, F.max(digest(rows, like)).alias("_all")).filter("_all is not null").drop("_all")


def from_bins(rows: DataFrame, keys: list[str], **summaries: tuple[Column, object]) -> DataFrame:
    """Binned rows with a column for each summary: (aggregate of a bin, function from its name to a window column over the bins).

    Windows over bins have one row a bin; see before(), last_before() and first_after().
    """
    bins = per_bin(rows, keys, *(a.alias(f"_{name}") for name, (a, _) in summaries.items()))
    order = Window.partitionBy(*keys).orderBy("_bin")
    return rows.join(bins.select(*keys, "_bin", *(over(f"_{name}", order).alias(name) for name, (_, over) in summaries.items())), [*keys, "_bin"])


def before(combine):
    """`combine` (an aggregate) over the summaries of all earlier bins."""
    return lambda name, order: combine(name).over(order.rowsBetween(Window.unboundedPreceding, -1))


def last_before(name: str, order) -> Column:
    """The summary of the nearest earlier bin that has any."""
    return F.last(name, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))


def first_after(name: str, order) -> Column:
    """The summary of the nearest later bin that has any: the last one before, as seen from the other end.

    A frame that ends at the last row would be worked anew for every row, so that time grew with the square of the bins.
    """
    return last_before(name, order.orderBy(F.desc("_bin")))


def merge_runs(df: DataFrame, keys: list[str], touching: bool = True, width: int = BIN, *, of: DataFrame | None = None) -> DataFrame:
    """df (start, end) with _bin and _island: overlapping rows of a key share it; touching decides whether book-ended ones do.

    An island is known by the place of its first row: twice its start, plus 1
    unless it is empty.  Inside a bin islands are found without the bins before
    it.  As they lie apart, an end that reaches in from there takes away those
    that begin before it and no others, so of a bin the furthest end and the
    last island are enough to know the last island before every bin.
    """
    columns = df.columns
    rows = binned(df, keys, "start", width, of=of)
    inner, order = Window.partitionBy(*keys, "_bin").orderBy("start", "end"), Window.partitionBy(*keys).orderBy("_bin")
    earlier = Window.unboundedPreceding
    apart = lambda reach, start: reach.isNull() | ((reach < start) if touching else (reach <= start))
    # With book-ended rows apart an empty row and another one may both begin an island at one place.
    first = F.col("start") * 2 + (F.col("end") > F.col("start")).cast("long")
    local = rows.withColumn("_reach", F.max("end").over(inner.rowsBetween(earlier, -1)))
    bins = per_bin(local, keys, F.max("end").alias("_end"), F.max(F.when(apart(F.col("_reach"), F.col("start")), first)).alias("_last"), like=[*columns, "_bin"])
    bins = bins.withColumn("_in", F.max("_end").over(order.rowsBetween(earlier, -1)))
    bins = bins.withColumn("_last", F.when(apart(F.col("_in"), F.shiftright("_last", 1)), F.col("_last")))
    bins = bins.select(*keys, "_bin", "_in", F.last("_last", ignorenulls=True).over(order.rowsBetween(earlier, -1)).alias("_from"))
    met = local.join(bins, [*keys, "_bin"]).withColumn("_new", F.when(apart(F.greatest("_reach", "_in"), F.col("start")), first))
    return met.withColumn("_island", F.coalesce(F.max("_new").over(inner.rangeBetween(earlier, 0)), F.col("_from"))).select(*columns, "_bin", "_island")
