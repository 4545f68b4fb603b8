"""Column expressions shared by the operators. All stay in the JVM; none needs a Python function."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from kabunoki.session import finite

__all__ = ["finite"]


def settle(x: Column, digits: int = 6) -> Column:
    """Rounding that two engines agree on: floor with an offset that ties of decimal fractions never meet."""
    return F.floor(x * float(10**digits) + 0.3718281828) / float(10**digits)


def percentile_rank(value: Column, *by: str | Column, ascending: bool = True) -> Column:
    """Average-tie rank divided by the number of non-null values; null for null."""
    # Twice the mean of the ranks among ties, from one sort; all windows of a frame have one partitioning, so it is
    # shuffled once however many columns are ranked.
    w = W.partitionBy(*by)
    order = w.orderBy(value.asc_nulls_last())
    n = F.count(value).over(w)
    twice = 2 * F.rank().over(order) + F.count(value).over(order.rangeBetween(W.currentRow, W.currentRow)) - 1
    return F.when(value.isNotNull(), (twice if ascending else 2 * n + 2 - twice) / 2.0 / n)


def rank_desc(value: Column, *by: str | Column) -> Column:
    """Least rank among ties, the greatest value first; null for null."""
    return F.when(value.isNotNull(), F.rank().over(W.partitionBy(*by).orderBy(value.desc_nulls_last())).cast("long"))


def winsorise(value: Column, by: Sequence[str], low: float = 0.025, high: float = 0.975, least: int = 10) -> Column:
    """Clip to exact linear quantiles of the group, if it has at least ``least`` values."""
    w = W.partitionBy(*by)
    q = F.percentile(value, F.array(F.lit(low), F.lit(high))).over(w)
    return F.when(F.count(value).over(w) >= least, F.greatest(F.least(value, q[1]), q[0])).otherwise(value)


def row_mean(*values: Column) -> Column:
    """Mean of those that are not null; null if all are."""
    n = sum((v.isNotNull().cast("int") for v in values), F.lit(0))
    return F.try_divide(sum((F.coalesce(v, F.lit(0.0)) for v in values), F.lit(0.0)), F.when(n > 0, n))


def growth(now: Column, before: Column) -> Column:
    return F.when(F.abs(before) >= 1e-12, (now - before) / F.abs(before))


def canonical_code(code: Column) -> Column:
    """Codes in capitals without white space around and the suffix ".T"; of five characters that end in 0, without it."""
    c = F.regexp_replace(F.upper(F.regexp_replace(code, r"(?U)^\s+|\s+$", "")), r"\.T$", "")
    return F.when((F.length(c) == 5) & c.endswith("0"), F.left(c, F.lit(4))).otherwise(c)


def provider_symbol(code: Column, provider: str) -> Column:
    """The symbol under which a data provider lists a canonical code: ``listing`` has five characters, ``quotes`` a
    suffix."""
    c = F.regexp_replace(code, r"(?U)^\s+|\s+$", "")
    if provider == "quotes":
        return F.concat(c, F.lit(".T"))
    if provider == "listing":
        return F.when(F.length(c) >= 5, c).otherwise(F.concat(c, F.lit("0")))
    raise ValueError(f"no provider {provider}")


def collapse(text: Column) -> Column:
    """Runs of white space as one blank, none at the ends; ideographic spaces count."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def squeeze(text: Column) -> Column:
    """All white space removed, ideographic spaces too."""
    return F.regexp_replace(text, r"(?U)\s+", "")


def clock_seconds(t: Column) -> Column:
    """Seconds of HH:MM[:SS]; null counts as midnight, what can't be read as -1."""
    part = F.split(t, ":")
    n = lambda i: part[i].try_cast("int")
    seconds = n(0) * 3600 + n(1) * 60 + F.coalesce(F.when(F.size(part) > 2, n(2)), F.lit(0))
    ok = F.regexp_like(t, F.lit(r"^\d{1,2}:\d{2}(:\d{2})?$"))
    return F.when(t.isNull(), 0).otherwise(F.coalesce(F.when(ok, seconds), F.lit(-1))).cast("int")


def tokyo_to_utc(date: Column, time: str | Column) -> Column:
    t = F.lit(time) if isinstance(time, str) else time
    return F.to_utc_timestamp(F.concat_ws(" ", date.cast("string"), t).cast("timestamp"), "Asia/Tokyo")


def spearman(x: Column, y: Column) -> Column:
    """Aggregate: Pearson correlation of two columns of ranks, null where either doesn't vary. Rows where one is null
    must be left out before ranking."""
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))
