"""Structured Streaming forms of the single-pass operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from ..functions import sequences as S
from ..operators import intervals
from ..shared import scratch


def renamed(lines: DataFrame, column: str = "seqname") -> DataFrame:
    """Stateless: chromosome names with 'chr'."""
    return lines.withColumn(column, S.to_ucsc(F.col(column)))


def filtered(rows: DataFrame, pattern: str, column: str = "seq", invert: bool = False) -> DataFrame:
    """Stateless: rows that match a pattern, or do not."""
    hit = F.col(column).rlike(pattern)
    return rows.filter(~hit if invert else hit)


def listed(rows: DataFrame, ids: DataFrame, column: str = "qname", keep: bool = True) -> DataFrame:
    """Stream-static semi join; rows of the stream that are (not) listed in a stored table."""
    known = ids.select(column).distinct().withColumn("_known", F.lit(True))
    joined = rows.join(known, column, "left")
    return joined.filter(F.col("_known").isNotNull() if keep else F.col("_known").isNull()).drop("_known")


def prefix_counts(rows: DataFrame, k: int, column: str = "seq") -> DataFrame:
    """Incremental counts per prefix; update or complete mode."""
    return rows.groupBy(F.substring(column, 1, k).alias("key")).agg(F.count("*").alias("n"))


def binned_counts(rows: DataFrame, width: int) -> DataFrame:
    """Incremental counts per sequence and bin; update or complete mode."""
    return rows.groupBy("seqname", F.floor(F.col("pos") / width).alias("bin")).agg(F.count("*").alias("n"))


def windowed_counts(events: DataFrame, time: str = "ts", key: str = "event_type", width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts per event-time window; rows later than `late` behind the newest are dropped, state with them."""
    return events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late).groupBy(F.window(time, width), key).agg(F.count("*").alias("n"))


def deduplicated(events: DataFrame, key: list[str], time: str = "ts", late: str = "2 hours") -> DataFrame:
    """The first of repeated rows within the watermark."""
    return events.withWatermark(time, late).dropDuplicatesWithinWatermark(key)


def depth_changes(blocks: DataFrame) -> DataFrame:
    """Incremental changes of depth: seqname, p, d over the blocks (seqname, start, end) so far; update or complete mode."""
    ends = F.array(F.struct(F.col("start").alias("p"), F.lit(1).alias("d")), F.struct(F.col("end").alias("p"), F.lit(-1).alias("d")))
    return blocks.select("seqname", F.explode(ends).alias("x")).groupBy("seqname", F.col("x.p").alias("p")).agg(F.sum("x.d").alias("d"))


def table_stream(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A stream of the rows of a stored table."""
    schema = spark.read.parquet(f"{folder}/{name}.parquet").schema
    return spark.readStream.schema(schema).parquet(f"{folder}/{name}.parque[t]")  # a pattern may name a file or a folder


def finished(counts: DataFrame) -> DataFrame:
    """What an aggregation over a stream says once all that is there has been read: each batch's table replaces the one before."""
    spark = counts.sparkSession
    out = scratch(spark, "stream")
    query = (
        counts.writeStream.outputMode("complete").trigger(availableNow=True).option("checkpointLocation", f"{out}/state")
        .foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(f"{out}/table")).start()
    )
    query.awaitTermination()
    return spark.read.schema(counts.schema).parquet(f"{out}/table")


class Coverage:
    """Depth of a stream of blocks (seqname, pos, start, end), written as runs once no later block can change them; for foreachBatch().

    Rows come by rising pos (where the read begins, at or before its blocks) in
    each sequence, but for `slack` bases of disorder between batches; inside a
    batch any order will do.  A batch joins its changes of depth with the open
    ones of the batch before, and a run ends for good where it ends before the
    largest pos less the slack.  What stays open is one row for each change of
    depth between there and the last end, whatever the depth.  Each batch writes
    one folder of its own, closed and open rows together, so a batch that is run
    again after a failure replaces itself.  A block that begins before runs
    already written cannot be counted in them: such rows are in late().  Rows
    without a sequence, pos, start or end, and empty blocks, are no blocks.
    """

    ROWS = "seqname string, p long, d long, depth long, end long, done long"

    def __init__(self, spark: SparkSession, folder: str, slack: int = 0):
        self.spark, self.folder, self.slack = spark, folder, slack
        spark.createDataFrame([], f"{self.ROWS}, open boolean").write.mode("ignore").partitionBy("open").parquet(self._batch(-1))

    def _batch(self, number: int) -> str:
        return f"{self.folder}/batches/number={number}"

    def _rows(self, path: str) -> DataFrame:
        return self.spark.read.schema(f"{self.ROWS}, open boolean, number long").parquet(path)

    def open_rows(self, number: int) -> DataFrame:
        """The state after a batch."""
        return self._rows(self._batch(number)).filter("open")

    def __call__(self, batch: DataFrame, number: int) -> None:
        known = self.open_rows(number - 1)
        done = known.groupBy("seqname").agg(F.max("done").alias("before"))
        full = batch.filter("seqname is not null and pos is not null and start < end").select("seqname", "pos", "start", "end")
        full = full.join(done, "seqname", "left").withColumn("late", F.coalesce(F.col("start") < F.col("before"), F.lit(False))).persist()
        try:
            full.filter("late").select("seqname", "pos", "start", "end").write.mode("overwrite").parquet(f"{self.folder}/late/number={number}")
            own = full.filter("not late")
            points = own.groupBy("seqname").agg((F.max("pos") - self.slack).alias("done")).unionByName(done.withColumnRenamed("before", "done")).groupBy("seqname").agg(F.max("done").alias("done"))
            # The first open row of a sequence carries the depth there; of a new sequence it is its first base.
            first = known.groupBy("seqname").agg(F.min_by(F.struct("p", F.col("depth").alias("d")), "p").alias("x")).select("seqname", "x.p", "x.d", F.lit(True).alias("head"))
            later = known.join(first.select("seqname", F.col("p").alias("_p")), "seqname").filter("p > _p").select("seqname", "p", "d", F.lit(False).alias("head"))
            fresh = own.filter("before is null").select("seqname").distinct().select("seqname", F.lit(0).cast("long").alias("p"), F.lit(0).cast("long").alias("d"), F.lit(True).alias("head"))
            changes = depth_changes(own).withColumn("head", F.lit(False))
            met = first.unionByName(later).unionByName(fresh).unionByName(changes).groupBy("seqname", "p").agg(F.sum("d").alias("d"), F.max("head").alias("head"))
            met = met.filter("head or d <> 0").select("seqname", "p", "d", F.col("d").alias("depth"))
            rows = intervals.running(met, ["seqname"], "depth").join(points, "seqname")
            rows = rows.withColumn("open", F.coalesce(F.col("end") >= F.col("done"), F.lit(True)))
            rows.select("seqname", "p", "d", "depth", "end", "done", "open").write.mode("overwrite").partitionBy("open").parquet(self._batch(number))
        finally:
            full.unpersist()

    def close(self, targets: DataFrame) -> None:
        """Writes the runs that are open at the end of the stream, the last of a sequence up to its length (targets: seqname, length)."""
        last = self._rows(f"{self.folder}/batches").agg(F.max("number").alias("n")).first().n
        rest = self.open_rows(-1 if last is None else last).join(targets.select("seqname", "length"), "seqname", "left")
        self._as_runs(rest.withColumn("end", F.coalesce("end", "length"))).write.mode("overwrite").parquet(f"{self.folder}/closed")

    @staticmethod
    def _as_runs(rows: DataFrame) -> DataFrame:
        return rows.filter("end > p").select("seqname", F.col("p").alias("start"), "end", "depth")

    def runs(self, closed: bool = True) -> DataFrame:
        """seqname, start, end, depth of the runs written so far; with those of close(), unless told otherwise."""
        written = self._as_runs(self._rows(f"{self.folder}/batches").filter("not open"))
        if not closed:
            return written
        return written.unionByName(self.spark.read.schema("seqname string, start long, end long, depth long").parquet(f"{self.folder}/closed"))

    def late(self) -> DataFrame:
        """Blocks that came too late to be counted."""
        return self.spark.read.schema("seqname string, pos long, start long, end long, number long").parquet(f"{self.folder}/late")


def finished_coverage(blocks: DataFrame, targets: DataFrame, slack: int = 0, folder: str | None = None) -> DataFrame:
    """Coverage runs of all that is there of a stream of blocks (see Coverage); a stream that has late blocks is an error."""
    spark = blocks.sparkSession
    folder = folder or scratch(spark, "coverage")
    sink = Coverage(spark, folder, slack)
    blocks.writeStream.trigger(availableNow=True).option("checkpointLocation", f"{folder}/state").foreachBatch(sink).start().awaitTermination()
    if not sink.late().isEmpty():
        raise ValueError(f"some blocks came more than {slack} bases late: they are under {folder}/late")
    sink.close(targets)
    return sink.runs()


class Progress(StreamingQueryListener):
    """Rows in, rows a second and watermark of each batch that a query finishes, handed to `tell`; spark.streams.addListener() takes it."""

    def __init__(self, tell=print):
        self.tell = tell

    def onQueryStarted(self, event) -> None:
        self.tell({"query": event.name or str(event.id), "state": "started"})

    def onQueryProgress(self, event) -> None:
        p = event.progress
        self.tell({"query": p.name or str(p.id), "state": "running", "batch": p.batchId, "rows": p.numInputRows, "rows_per_second": p.processedRowsPerSecond, "watermark": (p.eventTime or {}).get("watermark")})

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.tell({"query": str(event.id), "state": "failed" if event.exception else "ended"})
