"""Filter interaction audit: what each filter removes in every order, and its Shapley value.

Everything is DataFrame expressions.  A document's failing filters are one bit
mask, so a part of the corpus is known by how many documents it has of each
mask.  The removal game of a part gives every coalition of filters the number
of documents that at least one of them removes.  Its Hart-Mas-Colell potential
is built up coalition by coalition; a filter's Shapley value is the potential
of all filters less the potential without it, and what a filter removes at a
step of an order is the difference of two coalitions' values.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .linerules import words
from .runtime import cut


def text_failures(docs: DataFrame, *carry: Column) -> DataFrame:
    """The carried columns, `same` (a digest of the text, null being empty) and `mask`: bits of the filters A to D that the text fails.

    A: under 200 words; B: under half of the words distinct; C: over 2 % of the
    code points in A-Z; D: holds one of #$%&*|.  A text without words fails A only.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    points = F.length(text)
    one = docs.select(
        *carry, F.unhex(F.sha2(text.cast("binary"), 256)).alias("same"), words(text).alias("_w"),
        (100 * (points - F.length(F.regexp_replace(text, "[A-Z]+", ""))) > 2 * points).alias("_c"), F.rlike(text, F.lit("[#$%&*|]")).alias("_d"),
    )
    kept = [c for c in one.columns if c[0] != "_"]
    n = F.when(F.col("_w")[0] == "", 0).otherwise(F.size("_w"))
    two = one.select(*kept, "_c", "_d", n.alias("_n"), F.size(F.array_distinct("_w")).alias("_kinds"))
    bits = (F.col("_n") < 200, 100 * F.col("_kinds") < 50 * F.col("_n"), F.col("_c"), F.col("_d"))
    mask = sum((F.when(b, 1 << i).otherwise(0) for i, b in enumerate(bits)), F.lit(0))
    return two.select(*kept, mask.alias("mask"))


def with_copies(rows: DataFrame, bit: int) -> DataFrame:
    """(part, mask, n, good, toxic) from rows (doc_id, part, same, mask, good, toxic): documents whose text a smaller id has, too, get `bit`.

    Rows are counted before they meet: first those of an id, then those of a
    text and part, of which only the smallest id and its count are kept.  A row
    with a null id is no copy, and nothing is a copy of it.
    """
    kinds = ["same", "part", "mask", "good", "toxic"]
    known = F.col("doc_id").isNotNull()
    ids = rows.groupBy("doc_id", *kinds).agg(F.count("*").alias("n"))
    some = cut(ids.groupBy(*kinds, known.alias("known")).agg(F.sum("n").alias("n"), F.min("doc_id").alias("low"), F.min_by("n", "doc_id").alias("n_low")))  # read twice
    least = some.filter("known").groupBy("same").agg(F.min("low").alias("least"))
    met = some.join(least, "same", "left")
    first = F.when(~F.col("known"), F.col("n")).when(F.col("low") == F.col("least"), F.col("n_low")).otherwise(0)
    split = F.explode(F.array(F.struct(F.col("mask").alias("mask"), first.alias("n")), F.struct((F.col("mask") + bit).alias("mask"), (F.col("n") - first).alias("n"))))
    out = met.select("part", "good", "toxic", split.alias("x")).select("part", "x.mask", "x.n", "good", "toxic").filter("n > 0")
    flagged = lambda c: F.sum(F.when(F.col(c), F.col("n")).otherwise(0))
    return out.groupBy("part", "mask").agg(F.sum("n").alias("n"), flagged("good").alias("good"), flagged("toxic").alias("toxic"))


def coalition_values(value: str, size: int) -> Column:
    """The game's value of each coalition of `size` filters, by its mask: the sum of `value` over the counts whose mask meets it."""
    zero = F.lit(0).cast("long")
    meets = lambda s: F.aggregate("counts", zero, lambda a, c: a + F.when(c["mask"].bitwiseAND(s) != 0, c[value]).otherwise(zero))
    return F.transform(F.sequence(F.lit(0), F.lit((1 << size) - 1)), meets)


def potentials(values: str, size: int) -> Column:
    """The potential of each coalition, by its mask, times size!, which makes it a whole number.

    P(empty) = 0, and P(S) = (v(S) + the sum over i in S of P(S without i)) / |S|.
    """
    bits = F.array(*(F.lit(1 << i) for i in range(size)))

    def grown(p: Column, s: Column) -> Column:
        below = F.aggregate(F.filter(bits, lambda b: s.bitwiseAND(b) != 0), F.lit(0).cast("long"), lambda a, b: a + F.get(p, s - b))
        return F.concat(p, F.array(F.call_function("div", factorial(size) * F.get(values, s) + below, F.bit_count(s))))

    return F.aggregate(F.sequence(F.lit(1), F.lit((1 << size) - 1)), F.array(F.lit(0).cast("long")), grown)


def interactions(counts: DataFrame, letters: str) -> DataFrame:
    """One row for each part, order of the filters and step, from (part, mask, n, good, toxic).

    `letters` names the filters, the first one bit 1, the next bit 2 and so on;
    orders are all permutations, so keep them few.  A part is one row of
    2 ** len(letters) counts at most.  No counts give no rows.
    """
    size = len(letters)
    parts = counts.groupBy("part").agg(F.collect_list(F.struct(F.col("mask").cast("int").alias("mask"), "n", "good", "toxic")).alias("counts"), F.sum("n").alias("n"))
    games = parts.select("part", "n", *(coalition_values(c, size).alias(v) for c, v in (("n", "v"), ("good", "g"), ("toxic", "t"))))
    games = games.withColumn("p", potentials("v", size))
    orders = F.split(F.lit(" ".join(map("".join, permutations(letters)))), " ")
    steps = games.select("*", F.explode(orders).alias("filter_order")).select("*", F.explode(F.sequence(F.lit(1), F.lit(size))).alias("step"))
    bit = lambda letter: F.call_function("shiftleft", F.lit(1), F.instr(F.lit(letters), letter) - 1)
    earlier = F.filter(F.split("filter_order", ""), lambda c, i: (c != "") & (i < F.col("step") - 1))
    steps = steps.select("*", bit(F.substr("filter_order", F.col("step"), F.lit(1))).alias("own"), F.aggregate(earlier, F.lit(0), lambda a, c: a + bit(c)).alias("before"))
    at = lambda game, mask: F.get(game, mask)
    own, before, full = F.col("own"), F.col("before"), F.lit((1 << size) - 1)
    gained = lambda game: at(game, before + own) - at(game, before)
    return steps.select(
        "part", "filter_order", "step", (F.col("n") - at("v", before + own)).alias("kept"), gained("v").alias("removed"), (at("v", own) - gained("v")).alias("redundant"),
        (at("v", full) - at("v", full - own)).alias("unique_fails"), gained("g").alias("good_lost"), gained("t").alias("toxic_lost"), (at("p", full) - at("p", full - own)).alias("shapley"),
    )


def filter_audit(docs: DataFrame, labels: DataFrame, part: str = "source") -> DataFrame:
    """What filters A to E (see text_failures(); E: a smaller id has the same text) remove in all 120 orders.

    One row for each part (each value of the part's column, a null being ''),
    filter_order and step: documents kept after the step, removed at it,
    redundant (failing its filter, removed earlier), unique_fails (failing this
    filter only), good_lost and toxic_lost (removed at it and labelled so), and
    shapley (what the filter removes, over all orders).  Rows are what counts:
    repeated rows count each, and rows of one id and text are not copies of
    each other.  An id with several labels has each that any of them gives.
    Rows with a null id have no label and are no copies.  Null and empty texts
    are equal and fail A.  Columns other than doc_id, text and the part's are
    ignored; an empty table gives no rows.
    """
    named = (F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"))
    rows = text_failures(docs, *named)
    flagged = labels.filter("doc_id is not null and (quality = 1 or toxic = 1)").groupBy(F.col("doc_id").cast("long").alias("_id"))
    flags = flagged.agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"))
    flags = flags.select(F.struct(F.lit(True).alias("known"), F.col("_id").alias("at")).alias("_key"), "good", "toxic")
    # rows without an id meet no label; a number of their own keeps them from meeting in one task
    key = F.struct(F.col("doc_id").isNotNull().alias("known"), F.coalesce("doc_id", F.monotonically_increasing_id()).alias("at"))
    met = rows.withColumn("_key", key).join(flags, "_key", "left")
    rows = met.select("doc_id", "part", "same", "mask", *(F.coalesce(c, F.lit(False)).alias(c) for c in ("good", "toxic")))
    return interactions(with_copies(rows, 1 << 4), "ABCDE")


SQL = r"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, part, text, list_filter(string_split_regex(text, '[ \t\n\x0B\f\r]+'), lambda x: x <> '') AS ws FROM d),
low AS (SELECT text, min(doc_id) AS least FROM d GROUP BY text),
lab AS (SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY doc_id),
m AS (SELECT part, coalesce(quality, 0) AS quality, coalesce(toxic, 0) AS toxic, (CASE WHEN len(ws) < 200 THEN 1 ELSE 0 END)
  + (CASE WHEN 100 * len(list_distinct(ws)) < 50 * len(ws) THEN 2 ELSE 0 END)
  + (CASE WHEN 100 * (length(text) - length(regexp_replace(text, '[A-Z]+', '', 'g'))) > 2 * length(text) THEN 4 ELSE 0 END)
  + (CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 8 ELSE 0 END) + (CASE WHEN doc_id > least THEN 16 ELSE 0 END) AS mask
  FROM w JOIN low USING (text) LEFT JOIN lab USING (doc_id)),
c AS (SELECT part, mask, count(*) AS n, sum(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, sum(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM m GROUP BY part, mask),
l(x, b) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
o AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order, [a.b, b.b, c.b, d.b, e.b] AS bits FROM l a JOIN l b ON b.x <> a.x JOIN l c ON c.x NOT IN (a.x, b.x)
  JOIN l d ON d.x NOT IN (a.x, b.x, c.x) JOIN l e ON e.x NOT IN (a.x, b.x, c.x, d.x)),
s AS (SELECT filter_order, step, bits[step] AS own, coalesce(list_sum(bits[1:step - 1]), 0)::BIGINT AS before FROM (SELECT filter_order, bits, unnest(range(1, 6)) AS step FROM o)),
r AS (SELECT part, filter_order, step, own,
  sum(CASE WHEN mask & (own + before) = 0 THEN n ELSE 0 END)::BIGINT AS kept,
  sum(CASE WHEN mask & own <> 0 AND mask & before = 0 THEN n ELSE 0 END)::BIGINT AS removed,
  sum(CASE WHEN mask & own <> 0 AND mask & before <> 0 THEN n ELSE 0 END)::BIGINT AS redundant,
  sum(CASE WHEN mask = own THEN n ELSE 0 END)::BIGINT AS unique_fails,
  sum(CASE WHEN mask & own <> 0 AND mask & before = 0 THEN good ELSE 0 END)::BIGINT AS good_lost,
  sum(CASE WHEN mask & own <> 0 AND mask & before = 0 THEN toxic ELSE 0 END)::BIGINT AS toxic_lost
  FROM c, s GROUP BY part, filter_order, step, own)
SELECT part, filter_order, step::INTEGER AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, sum(removed) OVER (PARTITION BY part, own)::BIGINT AS shapley FROM r
"""
