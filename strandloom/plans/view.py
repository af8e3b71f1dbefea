"""A genomic view of the warehouse tables: DataFrames for Spark and the same definitions as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import reads as R
from ..shared import dealt


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def iv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intervals: one for each line item."""
    start = F.col("l_orderkey") * 40
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_returnflag").alias("seqname"), F.when(F.col("l_linestatus") == "O", "+").otherwise("-").alias("strand"), start.alias("start"),
        (start + F.floor("l_quantity")).alias("end"), F.col("l_partkey").alias("part"), F.col("l_partkey").cast("string").alias("name"), F.col("l_discount").alias("score"),
        F.col("l_linenumber").cast("long").alias("line"), F.col("l_suppkey").alias("supp"),
    )


def exon(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exons: one for each order and line number, transcripts are orders and genes customers.

    Lines are dealt out by order before anything else: grouping, join and what is done per transcript then need no other exchange.
    """
    lines = dealt(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity"), "l_orderkey")
    own = lines.groupBy("l_orderkey", "l_linenumber").agg(F.floor(F.max("l_quantity")).alias("len"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    start = F.col("l_orderkey") * 1000 + F.col("l_linenumber") * 100
    return own.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("l_orderkey").alias("transcript_id"), F.col("o_custkey").alias("gene_id"), F.col("o_orderstatus").alias("seqname"),
        F.when(F.col("l_orderkey") % 2 == 0, "+").otherwise("-").alias("strand"), start.alias("start"), (start + F.col("len")).alias("end"),
    )


def reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alignments: one for each event, at its minute since 2024-01-01; every eleventh read is unmapped."""
    return reads_of(table(spark, sf_dir, "events"))


def reads_of(events: DataFrame) -> DataFrame:
    """reads() of a table or stream of events."""
    i = F.col("event_id")
    text = F.when(i % 5 == 0, "10M").when(i % 5 == 1, F.concat(F.lit("10M"), (20 + i % 60).cast("string"), F.lit("N15M"))).when(i % 5 == 2, "5M2I8M").when(i % 5 == 3, "5S20M").otherwise("12M3D9M")
    minute = F.floor((F.unix_micros(F.col("ts").cast("timestamp")) - F.lit(1704067200000000)) / 60000000)
    rows = events.select(
        F.col("event_id"), F.col("user_id").cast("string").alias("qname"), F.col("event_type").alias("seqname"), minute.cast("long").alias("pos"),
        (F.when(i % 4 == 0, 0).when(i % 4 == 1, 16).when(i % 4 == 2, 65).otherwise(145) + F.when(i % 11 == 0, 4).otherwise(0)).alias("flag"), text.alias("cigar_text"), F.floor("value").alias("val"),
    )
    return rows.withColumn("cigar", R.cigar(F.col("cigar_text")))


def seqs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sequences: the A, C, G and T of the documents."""
    return table(spark, sf_dir, "documents").select("doc_id", F.regexp_replace(F.upper("text"), "[^ACGT]+", "").alias("seq"))


def targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sequences of the reads and their lengths."""
    return reads(spark, sf_dir).groupBy("seqname").agg((F.max("pos") + 500).alias("length"))


IV = """iv AS (SELECT l_returnflag AS seqname, CASE WHEN l_linestatus = 'O' THEN '+' ELSE '-' END AS strand, l_orderkey * 40 AS start,
  l_orderkey * 40 + floor(l_quantity)::BIGINT AS "end", l_partkey AS part, l_partkey::VARCHAR AS name, l_discount AS score, l_linenumber::BIGINT AS line, l_suppkey AS supp FROM lineitem)"""
EXON = """exon AS (SELECT l_orderkey AS transcript_id, o_custkey AS gene_id, o_orderstatus AS seqname, CASE WHEN l_orderkey % 2 = 0 THEN '+' ELSE '-' END AS strand,
  l_orderkey * 1000 + l_linenumber * 100 AS start, l_orderkey * 1000 + l_linenumber * 100 + len AS "end"
  FROM (SELECT l_orderkey, l_linenumber, floor(max(l_quantity))::BIGINT AS len FROM lineitem GROUP BY ALL) JOIN orders ON l_orderkey = o_orderkey)"""
READS = """reads AS (SELECT event_id, user_id::VARCHAR AS qname, event_type AS seqname, floor((epoch_us(ts) - 1704067200000000) / 60000000.0)::BIGINT AS pos,
  CASE event_id % 4 WHEN 0 THEN 0 WHEN 1 THEN 16 WHEN 2 THEN 65 ELSE 145 END + CASE WHEN event_id % 11 = 0 THEN 4 ELSE 0 END AS flag, floor(value)::BIGINT AS val,
  CASE event_id % 5 WHEN 0 THEN '10M' WHEN 1 THEN '10M' || (20 + event_id % 60) || 'N15M' WHEN 2 THEN '5M2I8M' WHEN 3 THEN '5S20M' ELSE '12M3D9M' END AS cigar_text FROM events)"""
#: CIGAR elements with their reference offsets: event_id, i, op, len, s, e.
WALK = READS + """,
w0 AS (SELECT *, unnest(regexp_extract_all(cigar_text, '([0-9]+)[MIDNSHP=X]', 1))::BIGINT AS len, unnest(regexp_extract_all(cigar_text, '[0-9]+([MIDNSHP=X])', 1)) AS op,
  generate_subscripts(regexp_extract_all(cigar_text, '[0-9]+([MIDNSHP=X])', 1), 1) AS i FROM reads),
walk AS (SELECT *, pos + coalesce(sum(CASE WHEN op IN ('M', 'D', 'N', '=', 'X') THEN len ELSE 0 END) OVER (PARTITION BY event_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS s FROM w0)"""
SEQS = "seqs AS (SELECT doc_id, regexp_replace(upper(text), '[^ACGT]+', '', 'g') AS seq FROM documents)"
TARGETS = "targets AS (SELECT seqname, max(pos) + 500 AS length FROM reads GROUP BY seqname)"


def uniform_sql(seed: str, *keys: str) -> str:
    """The number that sampling.uniform draws."""
    return f"(('0x' || substr(md5({" || '/' || ".join(f'({k})::VARCHAR' for k in (seed, *keys))}), 1, 12))::BIGINT / 281474976710656.0::DOUBLE)"


def merged_sql(source: str, keys: str, name: str = "merged", aggregates: str = "", touching: bool = True) -> str:
    """A chain of CTEs that ends in `name`: the union of `source` per keys."""
    sign = "<" if touching else "<="
    order = f'PARTITION BY {keys} ORDER BY start, "end"'
    return f"""{name}_r AS MATERIALIZED (SELECT *, max("end") OVER ({order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM {source}),
{name}_a AS MATERIALIZED (SELECT *, CASE WHEN reach IS NULL OR reach {sign} start THEN 1 ELSE 0 END AS fresh FROM {name}_r),
{name}_b AS MATERIALIZED (SELECT *, sum(fresh) OVER ({order}, fresh DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS island FROM {name}_a),
{name} AS (SELECT {keys}, min(start) AS start, max("end") AS "end"{aggregates} FROM {name}_b GROUP BY {keys}, island)"""
