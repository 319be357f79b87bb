"""Orders, limits, deduplication and interleaving of evidence lists; combinations of terms."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce
from operator import and_

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf


def product_of_terms(a: DataFrame, b: DataFrame, c: DataFrame | None = None) -> DataFrame:
    """Every A with every B (and C): the job's grid of term lists, which is small by nature."""
    out = a.crossJoin(b)
    return out.crossJoin(c) if c is not None else out


def zip_terms(*lists: DataFrame) -> DataFrame:
    """Lists (pos, term column) joined by position; lists of different lengths raise an error."""
    counts = {x.count() for x in lists}
    if len(counts) > 1:
        raise ValueError(f"term lists differ in length: {sorted(counts)}")
    out = lists[0]
    for more in lists[1:]:
        out = out.join(more, "pos")
    return out


def resorted(rows: DataFrame, order: DataFrame, term: str, by: list[Column]) -> DataFrame:
    """rows with sort_pos, the place of their term in order(term, pos), unknown terms last, sorted by it and then `by`."""
    n = order.agg(F.count("*")).first()[0]
    return rows.join(order.select(F.col("term").alias(term), F.col("pos").alias("term_pos")), term, "left").withColumn("sort_pos", F.coalesce("term_pos", F.lit(n))).drop("term_pos").orderBy("sort_pos", *by)


def first_of(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key."""
    return rows.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_rank = 1").drop("_rank")


def dedup_pools(rows: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Rows (pool, pos, pmid) without repeated articles: the earlier pool wins; rows without an article all stay.

    Rows without an article never meet in one window: each has its own pool and position as a key.
    """
    own = F.when(F.coalesce("pmid", F.lit("")) == "", F.concat_ws(":", F.lit("row"), "pool", "pos")).otherwise(F.concat(F.lit("pmid:"), F.col("pmid").cast("string")))
    ranked = F.row_number().over(Window.partitionBy(*(keys or []), own).orderBy("pool", "pos"))
    return rows.withColumn("_rank", ranked).where("_rank = 1").drop("_rank")


def within_budget(rows: DataFrame, keys: list[str], tokens: Column, budget: int, lists: int = 1, pos: str = "pos") -> DataFrame:
    """The longest prefix of each key whose tokens sum to at most budget // lists. As sums only grow, that is a filter."""
    running = F.sum(tokens).over(Window.partitionBy(*keys).orderBy(pos).rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("running_tokens", running).where(F.col("running_tokens") <= budget // lists)


def numbered(rows: DataFrame, keys: list[str], coarse: list[Column], fine: list[Column], name: str) -> DataFrame:
    """rows with their number within each key, from 1 on, in order of coarse, then fine.

    coarse cuts a key's rows into ranges that a task can hold: windows number the rows of one range, and the rows of the
    ranges before it are added from a table with one row for each key and range, so no task has to hold a key.
    """
    parts = [f"_range{i}" for i in range(len(coarse))]
    bare = [c for c, _ in map(_direction, coarse)]
    ordered = [F.desc(p) if down else F.asc(p) for p, (_, down) in zip(parts, map(_direction, coarse), strict=True)]
    cut = rows.withColumns(dict(zip(parts, bare, strict=True))).withColumn("_within", F.row_number().over(Window.partitionBy(*keys, *parts).orderBy(*fine)))
    sizes = cut.groupBy(*keys, *parts).agg(F.count("*").alias("_size"))
    before = sizes.withColumn("_before", F.coalesce(F.sum("_size").over(Window.partitionBy(*keys).orderBy(*ordered).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_size")
    same = [cut[c].eqNullSafe(before[c]) for c in (*keys, *parts)]
    joined = cut.join(before, reduce(and_, same)).select(cut["*"], before["_before"])
    return joined.withColumn(name, F.col("_within") + F.col("_before")).drop("_within", "_before", *parts)


def _direction(c: Column | tuple[Column, bool]) -> tuple[Column, bool]:
    return c if isinstance(c, tuple) else (c, False)


#: Positions in one range of numbered().
RANGE = 1 << 16


def by_recency(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows with an article, ranked from the latest year on; unknown years are 0, ties keep their order."""
    year = F.coalesce("pub_year", F.lit(0))
    there = rows.where(F.coalesce(F.col("pmid").cast("string"), F.lit("")) != "")
    return numbered(there, keys, [(year, True), F.floor(F.col("pos") / RANGE)], [F.col("pos")], "recent_rank")


def interleave_ratio(cited: int, recent: int) -> float:
    if not recent:
        return math.inf if cited else 1.0
    return cited / recent


def _turns(cited: list, recent: list, ratio: float) -> Iterator[tuple[list, bool]]:
    """The articles of each turn, and whether it belongs to the merge proper: the longer side's share, then one of the other.

    With ratio 1 a turn is one of each. Otherwise, before the other side's j-th article (counted from 0) the leading side
    has given round(j * ratio) of its own; when the other side is used up, one at a time follows. What the other side has
    left when the leading one is used up does not belong to the merge proper.
    """
    if ratio == 1:
        for k in range(max(len(cited), len(recent))):
            yield cited[k : k + 1] + recent[k : k + 1], True
        return
    leading, other = (cited, recent) if ratio > 1 else (recent, cited)
    given = taken = 0
    while given < len(leading):
        share = round(taken * ratio) if ratio > 1 else round(taken / ratio) if ratio else len(leading)
        upto = max(given, min(share, len(leading)))
        turn = leading[given:upto]
        if taken < len(other):
            yield turn + [other[taken]], True
            given, taken = upto, taken + 1
        else:
            yield turn + leading[upto : upto + 1], True
            given = upto + 1
    for x in other[taken:]:
        yield [x], False


def interleaved(cited: list, recent: list, ratio: float = 1.0, n: int | None = None, compatible: bool = False) -> list:
    """Cited and recent articles in turn, ratio cited ones for each recent one, without repeats, n at most.

    compatible stops at the first turn that adds nothing, and leaves out what the less frequent side has left at the end;
    otherwise all articles find a place. An infinite ratio gives the cited order alone.
    """
    out: dict = {}
    for turn, proper in [([x], True) for x in cited] if math.isinf(ratio) else _turns(list(cited), list(recent), ratio):
        before = len(out)
        if n is not None and before >= n or compatible and not proper:
            break
        for x in turn:
            if x is not None and x != "" and (n is None or len(out) < n):
                out.setdefault(x)
        if compatible and len(out) == before and not math.isinf(ratio):
            break
    return list(out)


def interleave(cited: Column, recent: Column, ratio: float = 1.0, n: int | None = None, compatible: bool = False) -> Column:
    """interleaved() for array<bigint> columns."""

    @pandas_udf("array<bigint>")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([interleaved([] if x is None else list(x), [] if y is None else list(y), ratio, n, compatible) for x, y in zip(a, b, strict=True)])

    return run(cited, recent)


def interleave_top(cited: DataFrame, recent: DataFrame, keys: list[str], n: int) -> DataFrame:
    """The first n of interleaved() with ratio 1, by joins and windows over at most 2 n rows of each key: cited(keys, pmid,
    cited_rank) and recent(keys, pmid, recent_rank) hold the first n of each order. An article's slot is the earlier of its two turns."""
    both = cited.select(*keys, "pmid", "cited_rank").join(recent.select(*keys, "pmid", "recent_rank"), [*keys, "pmid"], "full")
    slot = F.least((F.col("cited_rank") - 1) * 2, (F.col("recent_rank") - 1) * 2 + 1)
    return both.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(slot, "pmid"))).where(F.col("place") <= n)


def latest(rows: DataFrame, keys: list[str], by: str) -> DataFrame:
    """The row of each key with the greatest `by`."""
    others = [c for c in rows.columns if c not in keys and c != by]
    return rows.groupBy(*keys).agg(F.max(F.struct(by, *others)).alias("_row")).select(*keys, "_row.*")


def kept_and_removed(rows: DataFrame, kept: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    return rows.join(kept.select(key), key, "left_semi"), rows.join(kept.select(key), key, "left_anti")


def union_all(*frames: DataFrame) -> DataFrame:
    out = frames[0]
    for more in frames[1:]:
        out = out.unionByName(more, allowMissingColumns=True)
    return out


def every_kth(rows: DataFrame, k: int, order: list[Column]) -> DataFrame:
    """Every k-th row of a small series, such as years or points of a plot, from the first on: one task sorts it."""
    return rows.withColumn("_n", F.row_number().over(Window.orderBy(*order)) - 1).where(F.col("_n") % k == 0).drop("_n")


def shuffle_key(seed: int, *ids: Column) -> Column:
    """A sort key that any engine can repeat: the MD5 of seed and ids."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[i.cast("string") for i in ids]))


def sample_n(rows: DataFrame, keys: list[str], n: int, seed: int, *ids: Column) -> DataFrame:
    """n rows of each key, or all where there are fewer, by least shuffle_key; each task keeps n rows of a key before any shuffle."""
    draw = F.row_number().over(Window.partitionBy(*keys).orderBy(shuffle_key(seed, *ids), *ids))
    return rows.withColumn("draw", draw).where(F.col("draw") <= n)
