"""Two pools of evidence sampled in proportion, with a floor for the smaller one, and repeated by iteration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FLOOR, TARGET = 0.06, 50


def allocation(total1: Column, total2: Column, floor: float = FLOOR, target: int = TARGET) -> tuple[Column, Column]:
    """How many to draw from each pool: in proportion with half-even rounding, never more than a pool has, and at
    least floor * target from each where it has as many; where both floors do not fit, half each."""
    t1, t2 = total1.cast("long"), total2.cast("long")
    available = F.least(F.lit(target).cast("long"), t1 + t2)
    part = F.least(t1, F.bround(t1 / F.nullif(t1 + t2, F.lit(0)) * available).cast("long"))
    part = F.coalesce(F.when(available - part > t2, available - t2).otherwise(part), F.lit(0))
    least = F.bround(F.lit(floor * target)).cast("long")
    f1, f2 = F.least(t1, least), F.least(t2, least)
    half = F.least(t1, F.floor(available / 2))
    even = F.when(available - half > t2, available - t2).otherwise(half)
    n1 = F.when(f1 + f2 > available, even).when(part < f1, f1).when(available - part < f2, available - f2).otherwise(part)
    return n1.cast("long"), (available - n1).cast("long")


def check_seed(seed: object) -> int | None:
    """None means unseeded; anything but a whole number is refused, bools included."""
    if seed is not None and (isinstance(seed, bool) or not isinstance(seed, int)):
        raise ValueError(f"a sample seed is a whole number or null, not {seed!r}")
    return seed


def draw_key(seed: int, iteration: Column, pmid: Column) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), iteration.cast("string"), pmid.cast("string")))


def sample_pools(rows: DataFrame, keys: list[str], seed: int, iteration: Column, floor: float = FLOOR, target: int = TARGET) -> DataFrame:
    """Rows (keys, pool 1 or 2, pmid, and pos if there is one), without repeats, sampled by allocation(); draw is a row's
    place within its pool. No pool gives more than target, so each task keeps that many rows of a pool before any shuffle."""
    totals = rows.groupBy(*keys).agg(F.count_if(F.col("pool") == 1).alias("total1"), F.count_if(F.col("pool") == 2).alias("total2"))
    n1, n2 = allocation(F.col("total1"), F.col("total2"), floor, target)
    order = [draw_key(seed, iteration, F.col("pmid")), F.col("pmid"), *([F.col("pos")] if "pos" in rows.columns else [])]
    ranked = rows.withColumn("draw", F.row_number().over(Window.partitionBy(*keys, "pool").orderBy(*order))).where(F.col("draw") <= target)
    joined = ranked.join(totals.withColumns({"n1": n1, "n2": n2}), keys) if keys else ranked.crossJoin(totals.withColumns({"n1": n1, "n2": n2}))
    return joined.where(F.col("draw") <= F.when(F.col("pool") == 1, F.col("n1")).otherwise(F.col("n2")))


def iterations(rows: DataFrame, n: object) -> DataFrame:
    """rows for each iteration from 1 to n; nothing or 0 gives one pass without a number, true and what is no number give one."""
    if not n:
        return rows.withColumn("iteration", F.lit(None).cast("int"))
    count = n if isinstance(n, int) and not isinstance(n, bool) and n > 0 else 1
    return rows.withColumn("iteration", F.explode(F.sequence(F.lit(1), F.lit(count))))
