"""Exact ranks and quantiles within groups of any size: no task holds a whole group.

A group of more than ROWS values is cut at some of its values, and it is counted how many are less than each cut, equal to
it, and between two. A value equal to a cut has its rank from these counts; the others are ranked among those between the
same cuts, which are a piece. The cuts come from a random sample, on which nothing else depends: every 20th of its values,
of which one in ROWS is a cut, so that a piece has about ROWS values and a value more frequent than that is a cut itself.
The driver holds the sample, a number for each 5,000 values, and the counts.

The frame is read several times, so its rows must be the same each time. Values are doubles without NaN and -0.0.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Sequence
from functools import reduce
from itertools import accumulate
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.internal import InternalFunction
from pyspark.sql.window import Window as W

from kabunoki.session import width

ROWS, DENSITY = 100_000, 20
#: How many ways rows go that needn't meet.
APART = 64


class Cut(NamedTuple):
    """``counts`` has a number for each place: an even one is between two cuts, an odd one is a cut."""

    cuts: list[float]
    counts: list[int]
    nulls: int = 0
    clip: bool = False

    @property
    def before(self) -> list[int]:
        return [0, *accumulate(self.counts)][:-1]


def _meet(frame: DataFrame, by: Sequence[str], found: dict[tuple, tuple], more: str, how: str = "left") -> DataFrame:
    """``frame`` with what was found of its group; it is small."""
    schema = T.StructType([T.StructField(f"_by{k}", frame.schema[c].dataType) for k, c in enumerate(by)] + T._parse_datatype_string(more).fields)
    if not found and how == "left":
        return frame.withColumns({f.name: F.lit(None).cast(f.dataType) for f in schema.fields[len(by) :]})
    table = frame.sparkSession.createDataFrame([(*g, *x) for g, x in found.items()], schema)
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_by{k}")) for k, c in enumerate(by)])
    return frame.join(F.broadcast(table), same, how).drop(*[f"_by{k}" for k in range(len(by))])


def _place(value: str) -> Column:
    at = InternalFunction.array_binary_search(F.col("_cuts"), F.col(value))
    return F.coalesce(F.when(at >= 0, 2 * at + 1).otherwise(-2 * (at + 1)), F.lit(0))


def cut(frame: DataFrame, by: Sequence[str], value: str, over: int | None = None) -> dict[tuple, Cut]:
    """The groups of more than ``over`` rows, by default ROWS, by their keys."""
    over = ROWS if over is None else over
    some = frame.where(F.col(value).isNotNull())
    key = lambda r: tuple(r[c] for c in by)
    sizes = {key(r): r for r in frame.groupBy(*by).agg(F.count(F.lit(1)).alias("_size"), F.count(value).alias("_some")).where(F.col("_size") > over).collect()}
    if not sizes:
        return {}
    drawn = defaultdict(list)
    if max(r["_some"] for r in sizes.values()) > ROWS:
        for r in some.where(F.rand(7) < DENSITY / ROWS).select(*by, value).collect():
            drawn[key(r)].append(r[value])
    cuts = {g: sorted(set(sorted(drawn[g])[DENSITY - 1 :: DENSITY])) for g in sizes}
    placed = _meet(some, by, {g: (c,) for g, c in cuts.items()}, "_cuts array<double>", "inner").select(*by, _place(value).alias("_place"))
    counts = {g: [0] * (2 * len(c) + 1) for g, c in cuts.items()}
    for r in placed.groupBy(*by, "_place").agg(F.count(F.lit(1)).alias("_size")).collect():
        counts[key(r)][r["_place"]] = r["_size"]
    return {g: Cut(cuts[g], counts[g], r["_size"] - r["_some"]) for g, r in sizes.items()}


def _statistics(groups: dict[tuple, Cut], wanted: dict[tuple, set[int]], frame: DataFrame, by: Sequence[str], value: str) -> dict[tuple, dict[int, tuple[float, int, int]]]:
    """For each group and each place in its order, counted from 0: the value, how many are less, and how many are not more."""
    found: dict[tuple, dict] = {g: {} for g in groups}
    asked = {}
    for g, c in groups.items():
        inside = set()
        before = c.before
        for k in wanted[g]:
            p = max(i for i, n in enumerate(before) if n <= k and c.counts[i])
            if p % 2:
                found[g][k] = (c.cuts[p // 2], before[p], before[p] + c.counts[p])
            else:
                inside.add(p)
        if inside:
            asked[g] = (c.cuts, sorted(inside), before, sorted(wanted[g]))
    if asked:
        f = _meet(frame.where(F.col(value).isNotNull()), by, asked, "_cuts array<double>, _inside array<int>, _before array<long>, _wanted array<long>", "inner").withColumn("_place", _place(value)).where(F.array_contains("_inside", F.col("_place")))
        f = f.select(*by, value, "_place", F.get("_before", "_place").alias("_less"), "_wanted").repartition(width(frame.sparkSession), *by, "_place")
        w = W.partitionBy(*by, "_place").orderBy(value)
        f = f.withColumns({"_k": F.col("_less") + F.row_number().over(w) - 1, "_rank": F.rank().over(w), "_ties": F.count(value).over(w.rangeBetween(W.currentRow, W.currentRow))}).where(F.array_contains("_wanted", F.col("_k")))
        for r in f.collect():
            less = r["_less"] + r["_rank"] - 1
            found[tuple(r[c] for c in by)][r["_k"]] = (r[value], less, less + r["_ties"])
    return found


def _between(n: int, q: float) -> tuple[int, int, float]:
    """The places in order around the quantile q, and the share of the later one."""
    at = (n - 1) * q
    return int(at), int(-(-at // 1)), at


def _blend(at: float, low: int, high: int, a: float, b: float) -> float:
    return a if low == high or a == b else min(max((high - at) * a + (at - low) * b, a), b)


def quantiles(frame: DataFrame, by: Sequence[str], value: str, qs: Sequence[float], groups: dict[tuple, Cut] | None = None) -> dict[tuple, list[tuple[float, int, int]]]:
    """For each group and q: the linear quantile, how many values are less, and how many are not more. A group that has
    no value is not there."""
    groups = cut(frame, by, value, 0) if groups is None else groups
    groups = {g: c for g, c in groups.items() if sum(c.counts)}
    at = {g: [_between(sum(c.counts), q) for q in qs] for g, c in groups.items()}
    known = _statistics(groups, {g: {k for low, high, _ in x for k in (low, high)} for g, x in at.items()}, frame, by, value)
    out = {}
    for g, x in at.items():
        out[g] = []
        for low, high, t in x:
            (a, a_less, a_upto), (b, b_less, b_upto) = known[g][low], known[g][high]
            v = _blend(t, low, high, a, b)
            out[g].append((v, a_less if v == a else b_less if v == b else a_upto, b_upto if v == b else a_upto))
    return out


def clipped(groups: dict[tuple, Cut], frame: DataFrame, by: Sequence[str], value: str, low: float = 0.025, high: float = 0.975, least: int = 10) -> dict[tuple, Cut]:
    """The groups as they are when their values are clipped to two quantiles (see ``kit.winsorise``), which are the first
    cut and the last then. Nulls become the last one, as greatest and least pass over them."""
    ends = quantiles(frame, by, value, (low, high), groups) if groups else {}
    out = dict(groups)
    for g, x in ends.items():
        c, n = groups[g], sum(groups[g].counts)
        if n < least:
            continue
        (lo, _, upto), (hi, less, _) = x
        before = c.before
        kept = [(v, before[2 * k + 1], c.counts[2 * k + 1]) for k, v in enumerate(c.cuts) if lo < v < hi]
        marks = [(lo, 0, upto), *kept, (hi, less, n + c.nulls - less)] if lo < hi else [(lo, 0, n + c.nulls)]
        counts = [0]
        for (_, b, m), after in zip(marks, [*(y[1] for y in marks[1:]), n + c.nulls]):
            counts += [m, after - b - m]
        out[g] = Cut([v for v, *_ in marks], counts, 0, True)
    return out


def pieces(frame: DataFrame, by: Sequence[str], value: str, spread: Sequence[str], groups: dict[tuple, Cut]) -> DataFrame:
    """``frame`` in its pieces (see ``piece``): those of the groups that are cut, clipped where ``clipped`` says so; the
    others whole. In groups that are cut, rows that are a cut, or null, go apart by ``spread``."""
    found = {g: (c.cuts, c.before, c.counts, sum(c.counts), c.clip) for g, c in groups.items()}
    f = _meet(frame, by, found, "_cuts array<double>, _before array<long>, _counts array<long>, _all long, _clip boolean")
    first, last = F.get("_cuts", F.lit(0)), F.get("_cuts", F.size("_cuts") - 1)
    v = F.col(value)
    f = f.withColumn(value, F.when(F.col("_clip"), F.greatest(F.least(v, last), first)).otherwise(v)).withColumn("_cut", F.col("_all").isNotNull())
    f = f.withColumn("_place", F.when(F.col("_cut") & v.isNull(), -1).otherwise(_place(value)))
    inside = F.col("_place") >= 0
    ways = F.when(~inside, F.lit(APART)).when(F.col("_place") % 2 == 1, F.ceil(F.get("_counts", "_place") / ROWS)).otherwise(1)
    f = f.withColumns(
        {
            "_way": F.pmod(F.xxhash64(*spread), ways), "_less": F.coalesce(F.when(inside, F.get("_before", "_place")), F.lit(0).cast("long")),
            "_equal": F.when(inside & (F.col("_place") % 2 == 1), F.get("_counts", "_place")),
        }
    )
    return f.drop("_cuts", "_before", "_counts", "_clip").repartition(width(frame.sparkSession), *piece(by))


def piece(by: Sequence[str]) -> list[str]:
    """What tells pieces apart."""
    return [*by, "_place", "_way"]


def ranks(pieces: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """``_rank``, the least among ties from the smallest value, ``_ties``, and ``_n``, the values of the group; nulls have
    none."""
    w, v = W.partitionBy(*piece(by)), F.col(value)
    order = w.orderBy(v.asc_nulls_last())
    rank = F.when(F.col("_equal").isNotNull(), F.col("_less") + 1).otherwise(F.col("_less") + F.rank().over(order))
    ties = F.coalesce(F.col("_equal"), F.count(value).over(order.rangeBetween(W.currentRow, W.currentRow)))
    n = F.coalesce(F.col("_all"), F.count(value).over(w))
    out = pieces.withColumns({k: F.when(v.isNotNull(), c) for k, c in (("_rank", rank), ("_ties", ties), ("_n", n))})
    return out.drop("_place", "_way", "_less", "_equal", "_all", "_cut")


def places(frame: DataFrame, columns: Sequence[str], by: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """``keys``, and for each column its rank within ``by`` (of ``keys``), the greatest value first; null for null."""
    frame = frame.select(*keys, *columns)
    stack = F.array(*[F.struct(F.lit(k).alias("_column"), (0.0 - F.col(c).cast("double")).alias("_value")) for k, c in enumerate(columns)])
    long = frame.select(*keys, F.explode(stack).alias("_s")).select(*keys, "_s.*")
    group = [*by, "_column"]
    long = ranks(pieces(long, group, "_value", keys, cut(long, group, "_value")), group, "_value")
    return long.repartition(width(frame.sparkSession), *keys).groupBy(*keys).agg(*[F.max(F.when(F.col("_column") == k, F.col("_rank"))).alias(c) for k, c in enumerate(columns)])
