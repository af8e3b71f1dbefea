"""Mixing sources to target weights by iterative proportional fitting.

Token counts are summed into cells (source, language, topic); the cells' weights
are raked in turn to each target marginal until they fit all three; documents
are then sampled with their cell's calibrated probability.  The fit is a windowed
sum over the cell table for each marginal and round, so every value keeps its
own target however many there are.  All steps are DataFrame expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .linerules import _size, words
from .runtime import cut

CELL = ("source", "lang", "topic")
#: Rows of the cell table in a task, and the most that are broadcast; neither changes what comes out.
CELLS_PER_TASK, BROADCAST_CELLS = 50_000, 200_000


def form_topic(text: Column) -> Column:
    """A topic by the text's form: 'listing' (many separator bars), 'numeric' (many digits), 'brief' or 'prose'."""
    n = F.length(text)
    bars, digits = (n - F.length(F.regexp_replace(text, p, "")) for p in (r"\|+", r"[0-9]+"))
    return F.when(bars * 50 > n, "listing").when(digits * 20 > n, "numeric").when(n < 600, "brief").otherwise("prose")


def sampling_number(doc_id: Column, seed: str) -> Column:
    """A number in [0, 1) from the md5 of the id: the same on every run and engine."""
    return F.conv(F.substring(F.md5(F.concat(doc_id.cast("string"), F.lit("/" + seed)).cast("binary")), 1, 12), 16, 10).cast("double") / F.lit(float(1 << 48))


def cells(docs: DataFrame, topic: Column) -> tuple[DataFrame, DataFrame]:
    """(docs' rows as the struct `row` with cell columns and tokens, cell table with the sum of tokens).

    Null marginal values count as ''.  As a struct, docs' columns clash with nothing.
    """
    own = docs.select(
        F.struct(*(F.col(c) for c in docs.columns)).alias("row"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("lang"),
        F.coalesce(topic.cast("string"), F.lit("brief")).alias("topic"), _size(words(F.col("text"))).alias("tokens"),
    )
    return own, own.groupBy(*CELL).agg(F.sum("tokens").cast("double").alias("n"))


def marginals(table: DataFrame, power: float, targets: dict[str, DataFrame] | None = None) -> dict[str, DataFrame]:
    """For each of source, lang and topic the target share of every value that has tokens: value, t.

    A column in `targets` (value, share) takes the shares from there, made to sum
    to 1 over the values that the table has; values that are not listed get none,
    and so no tokens.  Other columns take the token shares to `power`, normalised
    (1 keeps the input's mix, 0 makes values equal).
    """
    out = {}
    for c in CELL:
        mass = table.filter("n > 0").groupBy(F.col(c).alias("value")).agg(F.pow(F.sum("n"), F.lit(power)).alias("m"))
        if c in (targets or {}):
            stated = targets[c].select(F.coalesce(F.col("value").cast("string"), F.lit("")).alias("value"), F.col("share").cast("double").alias("m")).groupBy("value").agg(F.sum("m").alias("m"))
            mass = mass.select("value").join(stated, "value", "left").select("value", F.coalesce("m", F.lit(0.0)).alias("m"))
        whole = mass.agg(F.sum("m").alias("all"))
        out[c] = mass.join(F.broadcast(whole), F.lit(True)).select("value", F.try_divide(F.col("m"), F.col("all")).alias("t"))
    return out


def raked(table: DataFrame, power: float, rounds: int, targets: dict[str, DataFrame] | None = None) -> DataFrame:
    """One row for each cell with tokens: source, lang, topic, n, weight, and the targets t_source, t_lang, t_topic.

    Every round scales the cells to each marginal in turn; the lineage is cut
    every four rounds.  A value without any weight left stays at 0.
    """
    summed = cut(table.filter("n > 0"))
    tasks = 1 + summed.count() // CELLS_PER_TASK
    fitted = summed.withColumn("weight", F.col("n"))
    for c, t in marginals(summed.coalesce(tasks), power, targets).items():  # in one task the sums need no shuffle
        fitted = fitted.join(t.toDF(c, f"t_{c}"), c)
    for i in range(rounds):
        if i % 4 == 0:
            fitted = cut(fitted).coalesce(tasks)
        for c in CELL:
            fitted = fitted.withColumn("weight", F.coalesce(F.try_divide(F.col("weight") * F.col(f"t_{c}"), F.sum("weight").over(Window.partitionBy(c))), F.lit(0.0)))
    return fitted.select(*CELL, "n", "weight", *(f"t_{c}" for c in CELL))


def fit(docs: DataFrame, topic: Column | None = None, power: float = 0.7, rounds: int = 12, targets: dict[str, DataFrame] | None = None) -> DataFrame:
    """How well the marginals are met: marginal, value, target, fitted (share of the weight) and residual for every value."""
    _, table = cells(docs, form_topic(F.col("text")) if topic is None else topic)
    rate, out = cut(raked(cut(table), power, rounds, targets)), None
    whole = rate.agg(F.sum("weight").alias("all"))
    for c in CELL:
        per = rate.groupBy(F.lit(c).alias("marginal"), F.col(c).alias("value")).agg(F.max(f"t_{c}").alias("target"), F.sum("weight").alias("w"))
        out = per if out is None else out.union(per)
    return out.join(F.broadcast(whole), F.lit(True)).select("marginal", "value", "target", F.try_divide("w", "all").alias("fitted"), (F.try_divide("w", "all") - F.col("target")).alias("residual"))


def scale_for(rate: DataFrame, budget: float) -> DataFrame:
    """One row, scale: the factor at which min(1, r * scale) keeps a share `budget` of all tokens.

    With cells by falling rate, each is tried as the first that is not taken whole.
    """
    order = Window.orderBy(F.desc("r"), *CELL)
    everything = Window.partitionBy()
    tried = rate.select(
        "r",
        ((F.lit(budget) * F.sum("n").over(everything) - F.coalesce(F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
         / F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))).alias("s"),
    )
    return tried.agg(F.coalesce(F.max_by(F.when(F.col("s") * F.col("r") <= 1, F.col("s")), F.when(F.col("s") * F.col("r") <= 1, F.col("r"))), 1 / F.min("r")).alias("scale"))


def mixed(docs: DataFrame, topic: Column | None = None, power: float = 0.7, rounds: int = 12, seed: str = "mix", budget: float | None = None, targets: dict[str, DataFrame] | None = None) -> DataFrame:
    """row (all columns of docs), source, lang, topic, tokens, weight (of the cell), p and kept, for each row of docs.

    docs needs doc_id, text, source and lang; other columns may have any name.
    Target shares are stated in `targets` or follow from `power` (see
    marginals(); fit() tells how well they are met).  p is the cell's weight by its
    tokens, scaled so that the largest is 1: expected tokens then stand in the
    raked proportions and no document is drawn twice; with a budget (a share of
    all tokens) it is scaled to that many expected tokens, and cells that would
    exceed 1 are taken whole.  kept compares p with a
    number from the id's md5, so runs agree and repeated ids share their fate.
    Documents without words have no weight of their own: they are drawn with
    their cell's probability, or 0 where the whole cell has none.  Null ids are
    drawn as the id ''.  An empty table gives an empty result.  Every source,
    language and topic has a target of its own, however many there are.
    """
    own, table = cells(docs, form_topic(F.col("text")) if topic is None else topic)
    rate = cut(raked(table, power, rounds, targets).select(*CELL, "n", "weight").withColumn("r", F.col("weight") / F.col("n")))
    top = rate.agg(F.try_divide(F.lit(1.0), F.max("r")).alias("scale")) if budget is None else scale_for(rate.filter("r > 0"), budget)
    by_cell = rate.join(F.broadcast(top), F.lit(True)).select(*CELL, "weight", F.least(F.col("r") * F.coalesce("scale", F.lit(0.0)), F.lit(1.0)).alias("p"))
    found = own.join(F.broadcast(by_cell) if rate.count() <= BROADCAST_CELLS else by_cell, list(CELL), "left").withColumns({c: F.coalesce(c, F.lit(0.0)) for c in ("weight", "p")})
    return found.withColumn("kept", sampling_number(F.coalesce(F.col("row")["doc_id"].cast("string"), F.lit("")), seed) < F.col("p"))


def mixture(docs: DataFrame, **options) -> DataFrame:
    """doc_id, source, lang, topic, n_tokens, weight, probability (rounded to 9 places) and kept for each row of docs."""
    m = mixed(docs, **options)
    return m.select(F.col("row")["doc_id"].alias("doc_id"), *CELL, F.col("tokens").alias("n_tokens"), F.round("weight", 9).alias("weight"), F.round("p", 9).alias("probability"), "kept")


def sampled(docs: DataFrame, **options) -> DataFrame:
    """The drawn rows of docs, with docs' own columns."""
    return mixed(docs, **options).filter("kept").select(*(F.col("row")[c].alias(c) for c in docs.columns))


def sql(power: float = 0.7, rounds: int = 12, seed: str = "mix") -> str:
    """DuckDB SQL for mixture() over documents."""
    steps, last = [], "r0"
    for i in range(3 * rounds):
        c = CELL[i % 3]
        steps.append(f"r{i + 1} AS MATERIALIZED (SELECT source, lang, topic, n, w * t / sum(w) OVER (PARTITION BY {c}) AS w FROM {last} JOIN t_{c} USING ({c}))")
        last = f"r{i + 1}"
    targets = ", ".join(f"t_{c} AS MATERIALIZED (SELECT {c}, pow(sum(n), {power}) / sum(pow(sum(n), {power})) OVER () AS t FROM r0 GROUP BY {c})" for c in CELL)
    return rf"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS source, coalesce(lang, '') AS lang,
  coalesce(CASE WHEN (length(text) - length(regexp_replace(text, '\|+', '', 'g'))) * 50 > length(text) THEN 'listing'
    WHEN (length(text) - length(regexp_replace(text, '[0-9]+', '', 'g'))) * 20 > length(text) THEN 'numeric' WHEN length(text) < 600 THEN 'brief' ELSE 'prose' END, 'brief') AS topic,
  len(list_filter(string_split_regex(coalesce(text, ''), '[ \t\n\x0B\f\r]+'), lambda x: x <> ''))::BIGINT AS n_tokens FROM documents),
t AS MATERIALIZED (SELECT source, lang, topic, sum(n_tokens) AS n FROM d GROUP BY ALL),
r0 AS MATERIALIZED (SELECT source, lang, topic, n::DOUBLE AS n, n::DOUBLE AS w FROM t WHERE n > 0),
{targets}, {", ".join(steps)},
p AS (SELECT t.source, t.lang, t.topic, coalesce(w, 0) AS weight, coalesce((w / {last}.n) / (SELECT max(w / n) FROM {last}), 0) AS p FROM t LEFT JOIN {last} USING (source, lang, topic))
SELECT doc_id, source, lang, topic, n_tokens, round(weight, 9) AS weight, round(p, 9) AS probability,
  ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || '/{seed}'), 1, 12))::BIGINT::DOUBLE / 281474976710656.0 < p AS kept
FROM d JOIN p USING (source, lang, topic)
"""
