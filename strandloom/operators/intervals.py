"""Interval algebra: merge, join, subtract, disjoin, gaps, coverage, nearest neighbours, bins."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..coords import BIN
from ..shared import dealt, parts
from .sweep import before, binned, first_after, from_bins, last_before, merge_runs, referred

#: Widths of bins, in bits, at which intervals are joined.
LEVELS = (*range(7, 32, 3), 62)


def merge(df: DataFrame, keys: list[str], *aggregates: Column, touching: bool = True, of: DataFrame | None = None) -> DataFrame:
    """Union of intervals per key: keys, start, end and the given aggregates of the merged rows.

    Islands are dealt out in as many parts as the input asks for (see dealt()
    for `of`).  Without aggregates a bin's rows of an island are one before that.
    """
    read, of = referred(df, aggregates) if aggregates else [], df if of is None else of
    ends = [F.min("start").alias("start"), F.max("end").alias("end")]
    runs = merge_runs(df.select(*keys, "start", "end", *(c for c in read if c not in (*keys, "start", "end"))), keys, touching, of=of)
    if not aggregates:
        runs = runs.groupBy(*keys, "_bin", "_island").agg(*ends)
    if parts(of):
        runs = dealt(runs.drop("_bin"), *keys, "_island", of=of)
    return runs.groupBy(*keys, "_island").agg(*ends, *aggregates).drop("_island")


def merge_named(df: DataFrame, keys: list[str]) -> DataFrame:
    """merge() with distinct names joined by ';' in order, the largest score and the number of rows."""
    names = F.array_join(F.array_sort(F.collect_set("name")), ";")
    return merge(df, keys, names.alias("name"), F.max("score").alias("score"), F.count("*").alias("n"))


def union_length(df: DataFrame, group: list[str], keys: list[str]) -> DataFrame:
    """Bases that a group's intervals cover, each once."""
    return merge(df, [*group, *keys]).groupBy(*group).agg(F.sum(F.col("end") - F.col("start")).alias("length"))


def level(start: Column, end: Column) -> Column:
    """Number of the least of LEVELS of which the width (2 ** bits) is not under the interval's length."""
    size, out = end - start, F.lit(len(LEVELS) - 1)
    for i in range(len(LEVELS) - 2, -1, -1):
        out = F.when(size <= 1 << LEVELS[i], i).otherwise(out)
    return out


def _dealt(df: DataFrame, other: DataFrame, home: int, visit: int, suffix: str) -> DataFrame:
    """df with _role, _level, _bin and _first of every bin in which its rows can meet rows of `other`.

    Rows of one level meet in role 0, a row that is at home meets shorter ones
    in role `home`, and goes to the homes of longer ones in role `visit`.
    """
    start, end = F.col(f"start{suffix}").cast("long"), F.col(f"end{suffix}").cast("long")
    bit = lambda i: F.call_function("shiftleft", F.lit(1), i)
    found = other.agg(F.bit_or(bit(level(F.col("start"), F.col("end"))))).scalar()  # one number: a bit for each level that is there
    rows = df.withColumns({"_own": level(start, end), "_there": F.coalesce(found, F.lit(0))})
    own, there = F.col("_own"), F.col("_there")
    place = lambda role, i: F.lit(role * 256) + i
    places = [F.when(there.bitwiseAND(bit(own)) != 0, place(0, own)), F.when(there.bitwiseAND(bit(own) - 1) != 0, place(home, own))]
    places += [F.when((own < i) & (there.bitwiseAND(1 << i) != 0), place(visit, F.lit(i))) for i in range(1, len(LEVELS))]
    rows = rows.withColumn("_at", F.explode(F.array(*places))).filter("_at is not null").drop("_own", "_there")
    width = F.element_at(F.array(*map(F.lit, LEVELS)), F.col("_at") % 256 + 1)
    rows = rows.withColumns({"_role": F.shiftright("_at", 8), "_level": width}).drop("_at")
    at = lambda p: F.call_function("shiftright", p, F.col("_level"))
    rows = rows.withColumns({"_first": at(start), "_last": F.greatest(at(start), at(end - 1))})
    return rows.withColumn("_bin", F.explode(F.sequence("_first", "_last"))).drop("_last")


def interval_join(a: DataFrame, b: DataFrame, keys: list[str], how: str = "inner", *, of: DataFrame | None = None) -> DataFrame:
    """Overlapping pairs: columns of a, and of b with suffix _b.

    Each interval has a level by its length, where it touches two bins at most;
    a pair meets at the level of the longer one.  So an interval of any length
    is a few rows - which levels the other side has is asked first - and as bins
    are at most eight times as long as what is at home there, what meets in a
    bin overlaps about as often as not: a task's pairs grow with its result.  A
    pair is kept in the first bin that both share, so nothing has to be made
    distinct.  Bins with many rows are split by Spark's skew join.  With `of`
    both sides are dealt out in as many parts as that frame asks for instead,
    for sides of which no bin has many rows.
    """
    if how != "inner":
        raise ValueError("only pairs that overlap are joined")
    for c in (*keys, "start", "end"):
        a, b = a.filter(F.col(c).isNotNull()), b.filter(F.col(c).isNotNull())
    left = _dealt(a, b, 1, 2, "")
    other = b.select([F.col(c).alias(f"{c}_b") for c in b.columns])
    right = _dealt(other, a, 2, 1, "_b").withColumnsRenamed({c: f"{c}_b" for c in ("_role", "_level", "_first", "_bin")})
    on = [F.col(k) == F.col(f"{k}_b") for k in (*keys, "_role", "_level", "_bin")] + [
        F.col("start") < F.col("end_b"), F.col("start_b") < F.col("end"), F.col("_bin") == F.greatest("_first", "_first_b"),
    ]
    if of is not None and parts(of):
        left = dealt(left, *keys, "_role", "_level", "_bin", of=of)
        right = dealt(right, *(f"{c}_b" for c in (*keys, "_role", "_level", "_bin")), of=of)
    drop = [c + x for c in ("_role", "_level", "_first", "_bin") for x in ("", "_b")]
    return left.join(right, on).drop(*drop)


def count_overlaps(regions: DataFrame, rows: DataFrame, keys: list[str], ident: list[str]) -> DataFrame:
    """Rows that overlap each region: ident columns and n, zero included; regions of the same ident are added up.

    No pairs are made.  Rows that begin before a region's end, less those that
    end at or before its start, overlap it: two numbers of one sweep over the
    places where rows begin and end, of which there is one event each.  Empty
    rows are counted apart, as an empty region has none of them.
    """
    full = (F.col("end") > F.col("start")).cast("long")
    sides = F.array(F.struct(F.col("start").alias("p"), full.alias("s"), (1 - full).alias("s0"), F.lit(0).cast("long").alias("e"), F.lit(0).cast("long").alias("e0")), F.struct(F.col("end").alias("p"), F.lit(0).cast("long").alias("s"), F.lit(0).cast("long").alias("s0"), full.alias("e"), (1 - full).alias("e0")))
    counts = ["s", "s0", "e", "e0"]
    events = rows.select(*keys, F.explode(sides).alias("x")).groupBy(*keys, F.col("x.p").alias("_p")).agg(*(F.sum(f"x.{c}").alias(f"_{c}") for c in counts))
    none, who = F.lit(0).cast("long"), F.struct(*ident)
    asks = F.explode(F.array(F.struct(F.col("end").alias("p"), F.lit(0).alias("k")), F.struct(F.col("start").alias("p"), F.lit(2).alias("k"))))
    void = reduce(or_, (F.col(c).isNull() for c in (*keys, "start", "end")))
    asked = regions.filter(~void).select(*keys, who.alias("_who"), (F.col("end") > F.col("start")).alias("_full"), asks.alias("x"))
    asked = asked.select(*keys, F.col("x.p").alias("_p"), F.col("x.k").alias("_kind"), "_who", "_full", *(none.alias(f"_{c}") for c in counts))
    both = asked.unionByName(events.select(*keys, "_p", F.lit(1).alias("_kind"), F.lit(None).alias("_who"), F.lit(None).alias("_full"), *(f"_{c}" for c in counts)))
    rows = from_bins(binned(both, keys, "_p"), keys, **{f"_in_{c}": (F.sum(f"_{c}"), before(F.sum)) for c in counts})
    here = Window.partitionBy(*keys, "_bin").orderBy("_p", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    total = {c: F.coalesce(F.col(f"_in_{c}"), none) + F.sum(f"_{c}").over(here) for c in counts}
    value = lambda c: total[c] + F.when(F.col("_full"), total[f"{c}0"]).otherwise(0)
    found = rows.withColumn("_n", F.when(F.col("_kind") == 0, value("s")).otherwise(-value("e"))).filter("_kind != 1").select("_who", "_n")
    nowhere = regions.filter(void).select(who.alias("_who"), none.alias("_n"))
    return found.unionByName(nowhere).groupBy(*(F.col("_who")[c].alias(c) for c in ident)).agg(F.sum("_n").alias("n"))


def subtract(a: DataFrame, b: DataFrame, keys: list[str], ident: str) -> DataFrame:
    """a without the bases of b: columns of a with new start and end, and piece (1, 2, ...) where a row was cut.

    ident is a column of a that tells its rows apart.  Untouched rows have piece 0.
    """
    merged = merge(b, keys)
    cuts = interval_join(a, merged, keys).groupBy(ident).agg(F.sort_array(F.collect_list(F.struct(F.col("start_b").alias("s"), F.col("end_b").alias("e")))).alias("_cuts"))
    rows = a.join(cuts, ident, "left")
    none = F.array().cast("array<struct<s:bigint,e:bigint>>")
    k = F.coalesce("_cuts", none)
    starts = F.concat(F.array("start"), F.transform(k, lambda x: x["e"]))
    ends = F.concat(F.transform(k, lambda x: x["s"]), F.array("end"))
    pieces = F.filter(F.zip_with(starts, ends, lambda s, e: F.struct(s.alias("s"), e.alias("e"))), lambda p: p["s"] < p["e"])
    out = rows.select("*", F.posexplode(pieces).alias("_i", "_p"))
    return out.withColumns({"start": F.col("_p.s"), "end": F.col("_p.e"), "piece": F.when(F.col("_cuts").isNull(), 0).otherwise(F.col("_i") + 1)}).drop("_i", "_p", "_cuts")


def running(events: DataFrame, keys: list[str], *sums: str, xors: tuple[str, ...] = (), last: Column | None = None, width: int = BIN) -> DataFrame:
    """Events (keys, p, values; one row a position) with each value's running sum, or exclusive or, up to and with p, and `end`.

    `end` is the next p of the key, or `last`.
    """
    return _running(binned(events, keys, "p", width), keys, *sums, xors=xors, last=last)


def _running(events: DataFrame, keys: list[str], *sums: str, xors: tuple[str, ...] = (), last: Column | None = None) -> DataFrame:
    """running() of binned events."""
    values = {v: F.sum for v in sums} | {v: F.bit_xor for v in xors}
    rows = from_bins(events, keys, _later=(F.min("p"), first_after), **{f"_in_{v}": (f(v), before(f)) for v, f in values.items()})
    inner = Window.partitionBy(*keys, "_bin").orderBy("p")
    here = inner.rowsBetween(Window.unboundedPreceding, 0)
    whole = {v: F.coalesce(F.col(f"_in_{v}"), F.lit(0)) + f(v).over(here) if v in sums else F.coalesce(F.col(f"_in_{v}"), F.lit(0)).bitwiseXOR(f(v).over(here)) for v, f in values.items()}
    end = F.coalesce(F.lead("p").over(inner), F.col("_later"), *([last] if last is not None else []))
    return rows.withColumns(whole | {"end": end}).drop("_bin", "_later", *(f"_in_{v}" for v in values))


def disjoin_unique(df: DataFrame, keys: list[str], owner: str) -> DataFrame:
    """Segments that exactly one owner covers: keys, owner (long), start, end; neighbouring segments of an owner join.

    An owner's own overlaps count once.  Events carry +1 / -1 and the owner;
    where the running count is 1, the running exclusive or is the owner.  Events
    of a place are summed where their bin lies, and all steps have df's parts.
    """
    own = merge(df, [*keys, owner])
    ends = F.explode(F.array(F.struct(F.col("start").alias("p"), F.lit(1).alias("d")), F.struct(F.col("end").alias("p"), F.lit(-1).alias("d"))))
    events = binned(own.select(*keys, F.col(owner).cast("long").alias("o"), ends.alias("x")).select(*keys, "o", "x.p", "x.d"), keys, "p", of=df)
    depth = _running(events.groupBy(*keys, "_bin", "p").agg(F.sum("d").alias("d"), F.bit_xor("o").alias("o")), keys, "d", xors=("o",))
    single = depth.filter("d = 1").select(*keys, F.col("o").alias(owner), F.col("p").alias("start"), "end")
    return merge(single, [*keys, owner], of=df)


def gaps(df: DataFrame, group: list[str], *carry: str) -> DataFrame:
    """Non-empty gaps between a group's intervals; `carry` columns come from the interval that begins last before the gap.

    Intervals may lie inside others: a gap begins where all intervals before it have ended.
    """
    w = Window.partitionBy(*group).orderBy("start", "end")
    rows = df.withColumns({"_next": F.lead("start").over(w), "_reach": F.max("end").over(w.rowsBetween(Window.unboundedPreceding, 0))})
    return rows.filter(F.col("_next") > F.col("_reach")).select(*group, *carry, F.col("_reach").alias("start"), F.col("_next").alias("end"))


def coverage(blocks: DataFrame, targets: DataFrame, keys: list[str] = ["seqname"]) -> DataFrame:  # noqa: B006
    """Depth along each sequence that has blocks, run-length encoded, zero runs included: keys, start, end, depth.

    targets has seqname and length, where the last run ends.  Places where as
    many blocks end as begin are no events, so every event is a run's start.
    """
    ends = F.array(F.struct(F.col("start").alias("p"), F.lit(1).alias("d")), F.struct(F.col("end").alias("p"), F.lit(-1).alias("d")), F.struct(F.lit(0).cast("long").alias("p"), F.lit(0).alias("d")))
    return depth_runs(blocks.select(*keys, F.explode(ends).alias("x")).groupBy(*keys, F.col("x.p").alias("p")).agg(F.sum("x.d").alias("d")), targets, keys)


def depth_runs(changes: DataFrame, targets: DataFrame, keys: list[str]) -> DataFrame:
    """Runs of equal depth from the changes d at places p (one row a place, place 0 among them): keys, start, end, depth."""
    lengths = targets.select("seqname", F.col("length").alias("_len"))
    depth = running(changes.filter("d != 0 or p = 0").join(lengths, "seqname", "left"), keys, "d", last=F.col("_len"))
    return depth.filter(F.col("end") > F.col("p")).select(*keys, F.col("p").alias("start"), "end", F.col("d").alias("depth"))


def run_lengths(points: DataFrame, keys: list[str], value: str, targets: DataFrame) -> DataFrame:
    """Runs of equal value from points (keys, p, value), each valid up to the next: keys, start, end, value."""
    inner = Window.partitionBy(*keys, "_bin").orderBy("p")
    rows = from_bins(binned(points, keys, "p"), keys, _in=(F.max_by(value, "p"), last_before))
    earlier = F.coalesce(F.lag(value).over(inner), F.col("_in"))
    changes = rows.withColumn("_changes", earlier.isNull() | (earlier != F.col(value))).filter("_changes").select(*keys, "p", value)
    lengths = targets.select("seqname", F.col("length").alias("_len"))
    ends = running(changes.join(lengths, "seqname", "left"), keys, last=F.col("_len"))
    return ends.filter(F.col("end") > F.col("p")).select(*keys, F.col("p").alias("start"), "end", value)


def neighbours(rows: DataFrame, keys: list[str], order: list[str], width: int = BIN, **taken: str) -> DataFrame:
    """rows with columns of the rows next to them in `order` (the first of them a position): name='lag:column' or 'lead:column'."""
    stand, inner = F.struct(*order), Window.partitionBy(*keys, "_bin").orderBy(*order)
    split = {name: spec.split(":") for name, spec in taken.items()}
    far = {f"_{name}": ((F.max_by if side == "lag" else F.min_by)(c, stand), last_before if side == "lag" else first_after) for name, (side, c) in split.items()}
    found = from_bins(binned(rows, keys, order[0], width), keys, **far)
    return found.withColumns({name: F.coalesce((F.lag if side == "lag" else F.lead)(c).over(inner), F.col(f"_{name}")) for name, (side, c) in split.items()}).drop("_bin", *far)


def bin_counts(rows: DataFrame, targets: DataFrame, width: int) -> DataFrame:
    """Rows per fixed-width bin of `pos`, empty bins included: seqname, bin, n; a sequence has length / width + 1 bins."""
    counts = rows.groupBy("seqname", F.floor(F.col("pos") / width).alias("bin")).agg(F.count("*").alias("n"))
    grid = targets.select("seqname", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("length") / width))).alias("bin"))
    return grid.join(counts, ["seqname", "bin"], "left").select("seqname", "bin", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def nearest(probes: DataFrame, rows: DataFrame, keys: list[str], probe: str, at: str, side: str, *values: str) -> DataFrame:
    """probes with the nearest row on one side and its values (suffix _near), distance _distance; nulls if there is none.

    side 'left': the row of greatest `at` <= probe; 'right': the least `at` >=
    probe.  Of rows at one place the least by values counts.  One union sorted
    by position inside bins, and the nearest of each earlier bin carried over.
    """
    left = side == "left"
    pick, place = F.struct(F.col(at).alias("at"), *(F.col(v) for v in values)), F.col("_p")
    marks = rows.select(*keys, F.col(at).alias("_p"), F.lit(0).alias("_kind"), pick.alias("_near"), F.lit(None).alias("_row"))
    asks = probes.select(*keys, F.col(probe).alias("_p"), F.lit(1).alias("_kind"), F.lit(None).alias("_near"), F.struct(*probes.columns).alias("_row"))
    own = F.min(F.when(F.col("_near").isNotNull(), F.struct((-place if left else place).alias("far"), "_near")))
    both = from_bins(binned(marks.unionByName(asks), keys, "_p"), keys, _in=(own, last_before if left else first_after))
    # at one place the probes come after the rows, and of these the least one last
    inner = Window.partitionBy(*keys, "_bin").orderBy(place if left else F.desc("_p"), "_kind", F.desc("_near")).rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("_n", F.coalesce(F.last("_near", ignorenulls=True).over(inner), F.col("_in._near"))).filter("_kind = 1")
    return found.select("_row.*", *(F.col(f"_n.{v}").alias(f"{v}_near") for v in values), F.abs(F.col("_n.at") - place).alias("_distance"))


def nearest_of_both(probes: DataFrame, rows: DataFrame, keys: list[str], ties: str = "left", *values: str) -> DataFrame:
    """probes with the nearer of the row that ends last at or before their start and the row that begins first at or after their end.

    Its values (suffix _near), its distance _distance and its _side; `ties` names the side that wins equal distances.
    """
    own = probes.columns
    one = nearest(probes, rows, keys, "start", "end", "left", *values)
    two = nearest(one.withColumnsRenamed({f"{v}_near": f"_l_{v}" for v in values} | {"_distance": "_l"}), rows, keys, "end", "start", "right", *values)
    closer = F.col("_l") < F.col("_distance") if ties == "right" else F.col("_l") <= F.col("_distance")
    left = F.col("_distance").isNull() | F.coalesce(closer, F.lit(False))
    side = F.when(F.coalesce("_l", "_distance").isNotNull(), F.when(left, "left").otherwise("right"))
    return two.select(*own, *(F.when(left, F.col(f"_l_{v}")).otherwise(F.col(f"{v}_near")).alias(f"{v}_near") for v in values), F.least("_l", "_distance").alias("_distance"), side.alias("_side"))


def merge_first(df: DataFrame, keys: list[str], order: list[str], *columns: str) -> DataFrame:
    """Union of intervals per key with the given columns of each union's first row (by start, then `order`), and `top`: of its largest score the text.

    Rows are seqname-wise unions as in merge(); df may have score and score_text.
    """
    first = F.min_by(F.struct(*columns), F.struct("start", *order))
    top = [F.max_by("score_text", F.struct("score", "score_text")).alias("top")] if "score_text" in df.columns else []
    out = merge(df, keys, first.alias("_f"), *top)
    return out.select("*", *(F.col("_f")[c].alias(c) for c in columns)).drop("_f")
