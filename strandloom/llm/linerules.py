"""Quality rules: per-document counts, and cross-document line frequency.

Everything is DataFrame expressions; no Python runs on executors.  A line is
normalised and hashed; for each host the distinct texts that hold it are
counted, lines above the limit are removed, and a document of which too little
is left is rejected.  Equal texts of a host count once, so a group of copies is
no boilerplate, and the counts are pre-aggregated before each shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .runtime import cut

BLANK = r"[ \t\n\x0B\f\r]+"
_TRIM = " \t\n\x0b\f\r"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    """Words between ASCII white space; [''] where there are none."""
    return F.split(F.btrim(F.coalesce(text, F.lit("")), F.lit(_TRIM)), BLANK)


def _size(found: Column) -> Column:
    return F.when(found[0] == "", 0).otherwise(F.size(found)).cast("long")


#: Texts of so many words or more are windowed twice, with two seeds.
LONG = 1 << 16


def windows(hashes: str, n: Column, *seed: int) -> Column:
    """3-word windows, sorted, from the words' hashes: each one long, hash bits (those of `high`) above and its place below."""
    return F.sort_array(F.transform(
        F.slice(hashes, 1, F.greatest(n - 2, F.lit(0)).cast("int")),
        lambda h, i: F.xxhash64(*map(F.lit, seed), h, F.get(hashes, i + 1), F.get(hashes, i + 2)).bitwiseAND(F.col("high")).bitwiseOR(i),
    ))


def repeat_places(column: str) -> Column:
    """Places, ascending, of the windows in a column of windows() that have a neighbour of the same hash bits."""
    same = lambda x, j: F.coalesce(F.get(column, j).bitwiseXOR(x).between(F.lit(0), F.col("low")), F.lit(False))
    places = F.transform(column, lambda x, i: F.when(same(x, i + 1) | ((i > 0) & same(x, F.greatest(i - 1, F.lit(0)))), x.bitwiseAND(F.col("low"))).otherwise(F.lit(-1).cast("long")))
    return F.sort_array(F.filter(places, lambda p: p >= 0))


def base_counts(docs: DataFrame) -> DataFrame:
    """doc_id, host, text hash, and the counts n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words.

    n_repeat_words compares windows by 64 - log2(n_words) hash bits, in texts
    under 65,536 words: less than 2e-5 false pairs are expected in the longest
    of them.  In longer texts a window has to be found again under two seeds,
    which leaves less than 1e-4 of them in a text of 6 million words.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda line: F.btrim(line, F.lit(_TRIM)) != "")
    step = docs.select(
        "doc_id", "host", F.xxhash64(text).alias("h"), words(F.col("text")).alias("w"),
        (F.length(text) - F.length(F.regexp_replace(text, r"[#*$%&|<>]+", ""))).cast("long").alias("n_symbols"),
        lines.alias("lines"),
    )
    step = step.select(
        "doc_id", "host", "h", "n_symbols", _size(F.col("w")).alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.transform("w", lambda w: F.xxhash64(w)).alias("hashes"),
    )
    counts = ["doc_id", "host", "h", "n_words", "word_chars", "n_symbols", "n_dup_lines"]
    n, none = F.col("n_words"), F.array().cast("array<bigint>")
    high = F.call_function("shiftleft", F.lit(-1).cast("long"), F.ceil(F.log2(n + F.lit(1))).cast("int"))
    step = step.select(*counts, "hashes", high.alias("high"), F.bitwise_not(high).alias("low"))
    step = step.select(*counts, "low", windows("hashes", n).alias("one"), F.when(n >= LONG, windows("hashes", n, 2)).otherwise(none).alias("two"))
    step = step.select(*counts, repeat_places("one").alias("p"), repeat_places("two").alias("q"))
    step = step.select(*counts, F.when(n >= LONG, F.sort_array(F.array_intersect("p", "q"))).otherwise(F.col("p")).alias("p"))
    covered = F.aggregate(F.transform("p", lambda p, i: F.least(F.lit(3).cast("long"), F.coalesce(F.get("p", i + 1), p + 3) - p)), F.lit(0).cast("long"), lambda a, x: a + x)
    return step.select(*counts, covered.alias("n_repeat_words"))


def plain_lines(text: Column) -> Column:
    """The lines of a text: A-Z lower-cased, blanks between words single, none at the ends; '' where there is no word."""
    single = F.regexp_replace(F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER), r"[ \t\x0B\f\r]+", " ")
    return F.split(F.btrim(single, F.lit(" ")), " ?\n ?")


def line_table(docs: DataFrame) -> DataFrame:
    """Distinct lines of each distinct text: host, h, line (hash), n_words under them in the text."""
    size = lambda line: (F.length(line) - F.length(F.replace(line, F.lit(" "), F.lit(""))) + 1).cast("long")
    hashed = F.transform(F.filter(plain_lines(F.col("text")), lambda x: x != ""), lambda x: F.struct(F.xxhash64(x).alias("line"), size(x).alias("n")))
    # a number for each row, given before lines are exploded: repeated rows and null ids do not add up
    rows = docs.select("host", F.xxhash64(F.coalesce("text", F.lit(""))).alias("h"), hashed.alias("ls"), F.monotonically_increasing_id().alias("row"))
    lines = rows.select("host", "h", "row", F.explode("ls").alias("l"))
    own = lines.groupBy("host", "h", "row", F.col("l.line").alias("line")).agg(F.sum("l.n").alias("n"))
    return cut(own.groupBy("host", "h", "line").agg(F.max("n").alias("n")))  # equal texts hold equal lines; read twice


def quality_rules(docs: DataFrame, host: str = "source", least: int = 5, share: float = 0.02, left: float = 0.2) -> DataFrame:
    """One row for each row of docs: the counts, n_removed_words, base_failed and kept.

    docs needs doc_id (any type), text and the host column; other columns are
    ignored.  A line is removed if more than `least` distinct texts of its host
    and more than `share` of them hold it; a document is rejected if its base
    rules fail (under 50 words, or more than half of them under repeated 3-word
    windows) or less than `left` of its words remain.  Null texts have no words
    and fail; null hosts are one host; null ids and repeated rows are kept as
    rows; an empty table gives an empty result.
    """
    own = docs.select("doc_id", F.col("text").cast("string").alias("text"), F.coalesce(F.col(host).cast("string"), F.lit("")).alias("host"))
    lines = line_table(own)
    texts = own.select("host", F.xxhash64(F.coalesce("text", F.lit(""))).alias("h")).distinct().groupBy("host").agg(F.count("*").alias("texts"))
    frequent = lines.groupBy("host", "line").agg(F.count("*").alias("k")).filter(F.col("k") > least).join(texts, "host").filter(F.col("k") > share * F.col("texts")).select("host", "line")
    removed = lines.join(frequent, ["host", "line"]).groupBy("host", "h").agg(F.sum("n").alias("n_removed_words"))
    counted = base_counts(own).join(removed, ["host", "h"], "left").withColumn("n_removed_words", F.coalesce("n_removed_words", F.lit(0).cast("long")))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    enough = F.col("n_words") - F.col("n_removed_words") >= left * F.col("n_words")
    return counted.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_removed_words", failed.alias("base_failed"), (~failed & enough).alias("kept"))


def without_frequent_lines(docs: DataFrame, host: str = "source", least: int = 5, share: float = 0.02) -> DataFrame:
    """doc_id and text of docs with the lines above the limit taken out; other lines stay as they are."""
    own = docs.select("doc_id", F.col("text").cast("string").alias("text"), F.coalesce(F.col(host).cast("string"), F.lit("")).alias("host"))
    lines = line_table(own)
    texts = own.select("host", F.xxhash64(F.coalesce("text", F.lit(""))).alias("h")).distinct().groupBy("host").agg(F.count("*").alias("texts"))
    frequent = lines.groupBy("host", "line").agg(F.count("*").alias("k")).filter(F.col("k") > least).join(texts, "host").filter(F.col("k") > share * F.col("texts")).select("host", "line")
    gone = lines.join(frequent, ["host", "line"]).groupBy("host", "h").agg(F.collect_set("line").alias("gone"))
    folded = lambda line: F.translate(F.array_join(words(line), " "), _UPPER, _LOWER)
    kept = F.array_join(F.filter(F.split("text", "\n"), lambda x: ~F.coalesce(F.array_contains("gone", F.xxhash64(folded(x))), F.lit(False))), "\n")
    return own.withColumn("h", F.xxhash64(F.coalesce("text", F.lit("")))).join(gone, ["host", "h"], "left").select("doc_id", F.when(F.col("gone").isNull(), F.col("text")).otherwise(kept).alias("text"))


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, coalesce(source, '') AS host FROM documents),
w AS (SELECT r, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM (SELECT r, list_filter(string_split_regex(text, '[ \t\n\x0B\f\r]+'), lambda x: x <> '') AS ws FROM d)),
t AS (SELECT r, i, w, lead(w) OVER (PARTITION BY r ORDER BY i) AS b, lead(w, 2) OVER (PARTITION BY r ORDER BY i) AS c FROM w),
rep AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, w, b, c) AS k FROM t WHERE c IS NOT NULL) WHERE k > 1),
cov AS (SELECT r, count(DISTINCT j) AS n_repeat_words FROM (SELECT r, unnest([i, i + 1, i + 2]) AS j FROM rep) GROUP BY r),
n AS (SELECT r, count(*) AS n_words, sum(length(w)) AS word_chars FROM w GROUP BY r),
raw AS (SELECT r, host, text, unnest(string_split(text, chr(10))) AS line FROM d),
ln AS (SELECT r, host, text, line, translate(trim(regexp_replace(line, '[ \t\n\x0B\f\r]+', ' ', 'g')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS f, len(list_filter(string_split_regex(line, '[ \t\n\x0B\f\r]+'), lambda x: x <> '')) AS k FROM raw),
dup AS (SELECT r, count(*) - count(DISTINCT line) AS n_dup_lines FROM ln WHERE k > 0 GROUP BY r),
texts AS (SELECT host, count(DISTINCT text) AS texts FROM d GROUP BY host),
freq AS (SELECT host, f FROM (SELECT host, f, count(DISTINCT text) AS k FROM ln WHERE k > 0 GROUP BY host, f) JOIN texts USING (host) WHERE k > 5 AND k > 0.02 * texts),
gone AS (SELECT r, sum(k) AS n_removed_words FROM ln JOIN freq USING (host, f) GROUP BY r),
a AS (SELECT doc_id, coalesce(n_words, 0)::BIGINT AS n_words, coalesce(word_chars, 0)::BIGINT AS word_chars,
  (length(text) - length(regexp_replace(text, '[#*$%&|<>]+', '', 'g')))::BIGINT AS n_symbols, coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines,
  coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, coalesce(n_removed_words, 0)::BIGINT AS n_removed_words
  FROM d LEFT JOIN n USING (r) LEFT JOIN cov USING (r) LEFT JOIN dup USING (r) LEFT JOIN gone USING (r))
SELECT *, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
  (NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND n_words - n_removed_words >= 0.2 * n_words) AS kept FROM a
"""
