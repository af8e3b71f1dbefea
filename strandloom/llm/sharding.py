"""Sharded document store with size-tiered compaction and versioned manifests.

Arrivals are appended as small immutable runs.  Each write goes to a batch
directory of its own with a random name, so nothing is ever added to files that
a reader may see.  Compaction sorts runs into size tiers, merges neighbouring
runs of a tier into files of the target size, and leaves the rest alone.  A
version's manifest is a table of its runs, the batches that hold them and the
arrivals in them, written aside and made current by renaming one marker file,
which either succeeds as a whole or fails because another writer was first.
Readers take the batches and runs that the newest marker lists: what an
interrupted or losing writer left behind is in batches that nobody lists, and an
arrival that is listed already is not appended again.  Everything runs as
DataFrame queries; the driver only moves the marker and removes directories.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .runtime import cut, fresh, passing_shuffles, scratch, spread

#: Production parameters: bytes of text in a merged file, runs of a tier that make a merge worthwhile, smallest tier.
TARGET_BYTES, FANOUT, BASE_BYTES = 128 << 20, 4, 1 << 20
#: Arrivals that a table is dealt to: so many for each target size of text.
ARRIVALS_PER_TARGET = 8
#: Arrival numbers whose runs are planned together, so that a plan's windows are bounded.
EPOCH = 1 << 16
RUN, BATCH = "shard_run", "shard_batch"
MANIFEST = "run string, batch string, level int, n_docs long, n_bytes long, first long, arrivals array<long>"


@dataclass
class Store:
    """A store below `root`, a path that all executors and the driver reach."""

    spark: SparkSession
    root: str
    text: str = "text"
    order: str = "doc_id"

    def _fs(self, path: str):
        jvm = self.spark._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()), at

    def version(self) -> int:
        """The newest committed version; 0 before the first."""
        fs, at = self._fs(f"{self.root}/commits")
        return max((int(f.getPath().getName()) for f in fs.listStatus(at) if f.getPath().getName().isdigit()), default=0) if fs.exists(at) else 0

    def manifest(self, version: int | None = None) -> DataFrame:
        """The runs of a version (the newest by default): run, batch, level, n_docs, n_bytes, first arrival and all arrivals."""
        at_version = self.version() if version is None else version
        if not at_version:
            return self.spark.createDataFrame([], MANIFEST)
        fs, at = self._fs(f"{self.root}/commits/{at_version:012d}")
        stream = fs.open(at)
        try:
            name = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return self.spark.read.schema(MANIFEST).parquet(f"{self.root}/manifests/{name}")

    def commit(self, runs: DataFrame, version: int) -> None:
        """Makes `runs` the manifest of `version`; fails if that version exists.

        The table and a marker that names it are written aside; renaming the marker is the commit.
        """
        name = uuid.uuid4().hex
        with passing_shuffles(self.spark):
            runs.coalesce(max(1, spread(runs) // 64)).write.parquet(f"{self.root}/manifests/{name}")
        jvm, (fs, aside), (_, at) = self.spark._jvm, self._fs(f"{self.root}/manifests/{name}.marker"), self._fs(f"{self.root}/commits/{version:012d}")
        stream = fs.create(aside, False)
        stream.write(name.encode())
        stream.close()
        fs.mkdirs(at.getParent())
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.makeQualified(at).toUri(), self.spark._jsc.hadoopConfiguration())
        # Without the option to overwrite, a rename onto another writer's marker throws.
        context.rename(fs.makeQualified(aside), fs.makeQualified(at), self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0))

    def _write(self, docs: DataFrame, partitions: int, slot: str | None = None) -> str:
        """Writes docs as runs of a fresh batch and returns its name; numbered runs do not share tasks."""
        batch = f"b{uuid.uuid4().hex}"  # a letter first, so that it is read as text
        # Merged runs are about the target size, so one task a run is bounded.
        dealt = docs.repartitionById(partitions, F.col(slot)).drop(slot) if slot else docs.repartition(partitions, RUN)
        with passing_shuffles(self.spark):
            dealt.sortWithinPartitions(RUN, self.order).write.option("compression", "zstd").partitionBy(RUN).parquet(f"{self.root}/data/{BATCH}={batch}")
        return batch

    def _stored(self, runs: DataFrame) -> DataFrame | None:
        """The rows of the listed runs (run, batch, ...) with the other columns of the list; None if no run is listed.

        Only batches that are listed are looked into.
        """
        batches = [r[0] for r in runs.select("batch").distinct().collect()]  # one for each write that still has a run
        if not batches:
            return None
        stored = self.spark.read.option("basePath", f"{self.root}/data").parquet(*(f"{self.root}/data/{BATCH}={b}" for b in sorted(batches)))
        return stored.join(runs, (F.col(RUN) == F.col("run")) & (F.col(BATCH) == F.col("batch"))).drop(BATCH, "batch", "run")

    def append(self, docs: DataFrame, arrival: Column) -> None:
        """Appends docs as level-0 runs, one for each value of the column expression `arrival` (long, not negative).

        Rows of arrivals that the store has (in whatever run) are left out, so
        an append that is tried again adds nothing.  A null arrival is number 0.
        """
        version, known = self.version(), self.manifest()
        had = known.select(F.explode("arrivals").alias("_arrival"))
        name = fresh("arrival_", docs.columns)
        new = docs.withColumn(name, F.coalesce(arrival, F.lit(0)).cast("long")).join(had, F.col(name) == F.col("_arrival"), "left_anti")
        batch = self._write(new.withColumn(RUN, F.format_string("L0-%019d", F.col(name))).drop(name), spread(docs))
        # Sizes come from what was stored, not from a second look at docs.
        runs = (
            self._sizes(batch).withColumn("first", F.substring("run", 4, 19).cast("long"))
            .select("run", F.lit(batch).alias("batch"), F.lit(0).alias("level"), "n_docs", "n_bytes", "first", F.array("first").alias("arrivals"))
        )
        self.commit(known.unionByName(runs), version + 1)

    def _sizes(self, batch: str) -> DataFrame:
        """run, n_docs and n_bytes of a batch's runs, from its files; none if nothing was written."""
        fs, at = self._fs(f"{self.root}/data/{BATCH}={batch}")
        entries, some = fs.listStatusIterator(at), False
        while not some and entries.hasNext():  # up to the first run
            some = entries.next().getPath().getName().startswith(RUN)
        if not some:
            return self.spark.createDataFrame([], "run string, n_docs long, n_bytes long")
        stored = self.spark.read.parquet(f"{self.root}/data/{BATCH}={batch}")
        return stored.groupBy(F.col(RUN).cast("string").alias("run")).agg(F.count("*").alias("n_docs"), F.sum(F.coalesce(F.octet_length(self.text), F.lit(0)).cast("long")).alias("n_bytes"))

    def plan(self, target: int, fanout: int, base: int) -> DataFrame:
        """The manifest with the run that each run goes to (itself where nothing is merged).

        Tier: whole powers of `fanout` in bytes / base.  Within a tier and an
        epoch of arrivals, in order of arrival, the sum of bytes before a run by
        the target size is its group; groups of `fanout` runs or more are merged.
        """
        tier = F.floor(F.log(F.greatest(F.col("n_bytes"), F.lit(base)) / base) / F.log(F.lit(float(fanout))) + 1e-9)
        runs = self.manifest().withColumns({"tier": F.when(F.col("n_bytes") * 2 >= target, -1).otherwise(tier), "epoch": F.floor(F.col("first") / EPOCH)})
        before = Window.partitionBy("tier", "epoch").orderBy("first", "run").rowsBetween(Window.unboundedPreceding, -1)
        runs = runs.withColumn("part", F.when(F.col("tier") >= 0, F.floor(F.coalesce(F.sum("n_bytes").over(before), F.lit(0)) / target)))
        group = Window.partitionBy("tier", "epoch", "part")
        merged = F.format_string("L%d-%019d", F.max("level").over(group) + 1, F.min("first").over(group))
        return runs.withColumn("goes_to", F.when((F.col("tier") >= 0) & (F.count("*").over(group) >= fanout), merged).otherwise(F.col("run")))

    def compact(self, target: int = TARGET_BYTES, fanout: int = FANOUT, base: int = BASE_BYTES) -> int:
        """Merges until no tier has enough neighbouring runs; returns the number of rounds."""
        rounds = 0
        while self.manifest().count() >= fanout:
            version, plan = self.version(), cut(self.plan(target, fanout, base))  # read four times, a row a run
            moves = plan.filter("run != goes_to").select("run", "batch", "goes_to")
            new = moves.select("goes_to").distinct().withColumn("_slot", F.row_number().over(Window.orderBy("goes_to")) - 1)  # one row a merged file
            n_new = new.count()
            if not n_new:
                break
            moved = self._stored(moves.join(new, "goes_to"))
            batch = self._write(moved.drop(RUN).withColumnRenamed("goes_to", RUN), n_new, "_slot")
            merged = F.col("run") != F.col("goes_to")
            runs = plan.groupBy(F.col("goes_to").alias("run")).agg(
                F.max(F.when(merged, F.lit(batch)).otherwise(F.col("batch"))).alias("batch"), F.max(F.when(merged, F.col("level") + 1).otherwise(F.col("level"))).alias("level"),
                F.sum("n_docs").alias("n_docs"), F.sum("n_bytes").alias("n_bytes"), F.min("first").alias("first"), F.flatten(F.collect_list("arrivals")).alias("arrivals"),
            )
            self.commit(runs, version + 1)
            self._forget(version)
            rounds += 1
        return rounds

    def _forget(self, version: int) -> None:
        """Removes what `version` lists and the newest version does not: whole batches where no run is left, else single runs."""
        fs, _ = self._fs(self.root)
        left, gone = self.manifest().select("run", "batch"), set()
        live = {r[0] for r in left.select("batch").distinct().collect()}  # one for each write that still has a run
        for run, batch in self.manifest(version).select("run", "batch").join(left, ["run", "batch"], "left_anti").toLocalIterator():
            if batch in live:
                fs.delete(self._fs(f"{self.root}/data/{BATCH}={batch}/{RUN}={run}")[1], True)
            elif batch not in gone:
                gone.add(batch)
                fs.delete(self._fs(f"{self.root}/data/{BATCH}={batch}")[1], True)

    def vacuum(self) -> int:
        """Removes batches that the newest version does not list (of interrupted writers); only while nobody writes."""
        fs, at = self._fs(f"{self.root}/data")
        listed = {f"{BATCH}={r[0]}" for r in self.manifest().select("batch").distinct().collect()}
        stray = [f.getPath() for f in fs.listStatus(at) if f.getPath().getName() not in listed] if fs.exists(at) else []
        for path in stray:
            fs.delete(path, True)
        return len(stray)

    def read(self) -> DataFrame:
        """The documents of the newest version, with the columns of its manifest (an error while the store is empty)."""
        stored = self._stored(self.manifest().drop("arrivals"))
        if stored is None:
            raise ValueError("the store has no runs")
        return stored


def arrival_of(docs: DataFrame, arrivals: int) -> Column:
    """Arrival number of a row, below `arrivals`: from the md5 of its id and text, so that neither crowded ids nor null ones share one."""
    digest = F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("/"), F.coalesce(F.col("text").cast("string"), F.lit(""))).cast("binary"))
    return F.pmod(F.conv(F.substring(digest, 1, 12), 16, 10).cast("long"), F.lit(arrivals))


def sharded(docs: DataFrame, root: str | None = None, target: int = TARGET_BYTES, fanout: int = FANOUT, base: int = BASE_BYTES) -> DataFrame:
    """Appends docs to a new store, compacts it and returns its documents with shard, level, shard_docs, shard_bytes.

    docs needs doc_id and text; all its columns are stored (one of the store's
    own names gets a trailing '_').  The table is dealt to ARRIVALS_PER_TARGET
    arrivals for each target size of its text, whatever its ids are.  Null and
    empty texts count no bytes; null ids and repeated rows are stored as often
    as they stand.  An empty table makes no store and gives an empty result.
    """
    taken = [RUN, "run", "goes_to", "level", "n_docs", "n_bytes", "first", "shard", "shard_docs", "shard_bytes", "_slot", "batch", BATCH, "_arrival"]
    names = []
    for c in docs.columns:
        names.append(fresh(c, taken + names))
    store = Store(docs.sparkSession, root or scratch(docs.sparkSession, "store"))
    own = docs.toDF(*names)
    rows, size = own.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0))).first()
    if not rows:
        return own.withColumns({"shard": F.lit("").cast("string"), "level": F.lit(0), "shard_docs": F.lit(0).cast("long"), "shard_bytes": F.lit(0).cast("long")}).limit(0)
    store.append(own, arrival_of(own, ARRIVALS_PER_TARGET * max(1, -(-size // target))))
    store.compact(target, fanout, base)
    return store.read().select(*names, F.col(RUN).cast("string").alias("shard"), "level", F.col("n_docs").alias("shard_docs"), F.col("n_bytes").alias("shard_bytes"))


def sql(table: str = "documents", columns: str = "doc_id", target: int = TARGET_BYTES, fanout: int = FANOUT, base: int = BASE_BYTES, rounds: int = 3) -> str:
    """DuckDB SQL for sharded(): `rounds` bounds the rounds of compaction."""
    steps = []
    for i in range(rounds):
        group = "tier, epoch, part"
        steps.append(f"""
p{i} AS MATERIALIZED (SELECT *, first // {EPOCH} AS epoch, CASE WHEN n_bytes * 2 >= {target} THEN -1 ELSE floor(ln(greatest(n_bytes, {base}) / {float(base)}) / ln({float(fanout)}) + 1e-9) END AS tier FROM m{i}),
q{i} AS MATERIALIZED (SELECT *, CASE WHEN tier >= 0 THEN floor(coalesce(sum(n_bytes) OVER (PARTITION BY tier, epoch ORDER BY first, run ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / {float(target)}) END AS part FROM p{i}),
g{i} AS MATERIALIZED (SELECT *, CASE WHEN tier >= 0 AND count(*) OVER (PARTITION BY {group}) >= {fanout}
  THEN 'L' || (max(level) OVER (PARTITION BY {group}) + 1) || '-' || lpad(min(first) OVER (PARTITION BY {group})::VARCHAR, 19, '0') ELSE run END AS goes_to FROM q{i}),
m{i + 1} AS MATERIALIZED (SELECT goes_to AS run, max(CASE WHEN run = goes_to THEN level ELSE level + 1 END) AS level, sum(n_docs) AS n_docs, sum(n_bytes) AS n_bytes, min(first) AS first FROM g{i} GROUP BY goes_to)""")
    hops = " ".join(f"JOIN g{i} ON g{i}.run = {'d.run' if not i else f'g{i - 1}.goes_to'}" for i in range(rounds))
    return f"""
WITH n AS (SELECT {ARRIVALS_PER_TARGET} * greatest(1, ceil(coalesce(sum(strlen(text)), 0) / {float(target)}))::BIGINT AS n FROM {table}),
d AS (SELECT *, 'L0-' || lpad(arrival::VARCHAR, 19, '0') AS run FROM (SELECT t.*, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || '/' || coalesce(text, '')), 1, 12))::BIGINT % n AS arrival FROM {table} t, n)),
m0 AS (SELECT run, 0 AS level, count(*) AS n_docs, sum(coalesce(strlen(text), 0)) AS n_bytes, min(arrival) AS first FROM d GROUP BY run),{",".join(steps)}
SELECT {columns}, f.run AS shard, f.level::INTEGER AS level, f.n_docs::BIGINT AS shard_docs, f.n_bytes::BIGINT AS shard_bytes
FROM d {hops} JOIN m{rounds} f ON f.run = g{rounds - 1}.goes_to
"""
