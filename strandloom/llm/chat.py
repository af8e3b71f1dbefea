"""Chat formatting with collapse of cumulative snapshots.

A logger that stores a conversation after every turn leaves many prefixes of
the final one.  Each turn gets a rolling hash of everything up to it; a
conversation whose last hash stands inside a longer one is a snapshot, an
anti-join removes it, and equal conversations keep the smallest id.  What is
left is rendered.  All of it is DataFrame expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def turns(conversations: DataFrame) -> DataFrame:
    """conv_id, place (1, 2, ...), role, text, and the rolling hashes h1 and h2 of the turns up to this one.

    Rows that repeat (conv_id, turn, role, text) are one turn; turns that share
    a number follow each other by role and text, null numbers come first.
    A rolling hash is the exclusive or of hashes that hold the turn's place, so
    one window adds it up; two seeds make 128 bits.
    """
    own = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text")).distinct()
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    placed = own.withColumn("place", F.row_number().over(order).cast("long"))
    up_to = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    content = (F.coalesce("role", F.lit("")), F.isnull("role"), F.coalesce("text", F.lit("")), F.isnull("text"))
    return placed.select(
        "conv_id", "place", "role", "text",
        *(F.bit_xor(F.xxhash64(F.lit(seed), "place", *content)).over(up_to).alias(f"h{seed}") for seed in (1, 2)),
    )


def maximal(conversations: DataFrame) -> DataFrame:
    """conv_id and n_turns of conversations that are no prefix of a longer one; of equal ones the smallest id.

    Rows with a null conv_id belong to no conversation and are left out.
    """
    rolled = turns(conversations.filter("conv_id is not null")).select("conv_id", "place", "h1", "h2")
    ends = rolled.groupBy("conv_id").agg(F.max_by(F.struct("place", "h1", "h2"), "place").alias("e")).select("conv_id", F.col("e.place").alias("place"), F.col("e.h1").alias("h1"), F.col("e.h2").alias("h2"))
    single = ends.groupBy("place", "h1", "h2").agg(F.min("conv_id").alias("conv_id"))
    # Prefixes that some conversation goes beyond: counted before the shuffle, one row for each distinct prefix.
    beyond = rolled.withColumn("last", F.max("place").over(Window.partitionBy("conv_id"))).filter("place < last").groupBy("place", "h1", "h2").agg(F.lit(1).alias("one")).drop("one")
    return single.join(beyond, ["place", "h1", "h2"], "left_anti").select("conv_id", F.col("place").alias("n_turns"))


def rendered_turn(role: Column, text: Column) -> Column:
    return F.concat(F.lit("<|"), F.coalesce(role, F.lit("")), F.lit("|>\n"), F.coalesce(text, F.lit("")), F.lit("\n<|end|>\n"))


def formatted(conversations: DataFrame) -> DataFrame:
    """conv_id, n_turns and rendered text of every maximal conversation.

    conversations needs conv_id, turn, role and text; other columns are
    ignored.  Null roles and texts render as empty; an empty table gives an
    empty result.  One conversation's text is one string, so a conversation
    has to fit a task, as its rendering does.
    """
    kept = maximal(conversations)
    rows = turns(conversations.filter("conv_id is not null")).select("conv_id", "place", "role", "text")
    lines = rows.join(kept, "conv_id").select("conv_id", "n_turns", F.struct("place", rendered_turn(F.col("role"), F.col("text")).alias("t")).alias("t"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list("t")), lambda t: t["t"]), "")
    return lines.groupBy("conv_id", "n_turns").agg(text.alias("rendered"))


SQL = r"""
WITH u AS (SELECT DISTINCT conv_id, turn, role, text FROM conversations WHERE conv_id IS NOT NULL),
t AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS place FROM u),
c AS (SELECT conv_id, count(*) AS n, list({'r': role, 't': text} ORDER BY place) AS l,
  string_agg('<|' || coalesce(role, '') || '|>' || chr(10) || coalesce(text, '') || chr(10) || '<|end|>' || chr(10), '' ORDER BY place) AS rendered FROM t GROUP BY conv_id),
p AS (SELECT DISTINCT l[1:k] AS l FROM (SELECT l, unnest(range(1, n)) AS k FROM c)),
s AS (SELECT l, min(conv_id) AS conv_id FROM c GROUP BY l)
SELECT c.conv_id, n AS n_turns, rendered FROM c JOIN s ON c.conv_id = s.conv_id WHERE c.l NOT IN (SELECT l FROM p)
"""
