"""Minimax contiguous sharding in DataFrame operations only.

Groups of equal texts are atoms, ordered by their smallest id. The capacity is the smallest one with which
a greedy walk over the ordered sizes fills at most the given number of shards. The walk only ever asks for
the last group end at or below a position, so the binary search runs on the driver over a few known group
ends, and each round of it fetches finer ends, a bounded number, only where an answer is still open.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections import Counter

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from attestor.llm.tables import settle

#: Slices into which one round divides each open range; a round brings at most one group end a slice.
SLICES = 1024
#: Groups with more than a 1/GROUPS of all rows, of which there are fewer than GROUPS, are broadcast instead of shuffled.
GROUPS = 1000


class Ends:
    """What is known of the group ends: largest[i] is the largest end up to known[i], and between[i] says
    whether unknown ends may lie between known[i] and known[i + 1]."""

    def __init__(self, total: int):
        self.known, self.largest, self.between = [0, total], [0, total], [True]

    def floor(self, x: int) -> tuple[int, int]:
        """Bounds of the largest group end that is at most x."""
        i = bisect_right(self.known, x) - 1
        open_here = i + 1 < len(self.known) and self.between[i] and x > self.known[i]
        return self.largest[i], x if open_here else self.largest[i]

    def learn(self, first: int, last: int, width: int, found: dict[int, tuple[int, int]]) -> None:
        """found: of slice k, (first + k * width, first + (k + 1) * width], the largest end and the number of ends.
        first is known; the slices fill (first, last]."""
        i, j = bisect_left(self.known, first), bisect_left(self.known, last)
        ends = {x for x, y in zip(self.known[i : j + 1], self.largest[i : j + 1], strict=True) if x == y} | {end for end, _ in found.values()}
        points = sorted({*self.known[i : j + 1], *ends, last})
        largest = [self.largest[i]]
        for x in points[1:]:
            largest.append(x if x in ends else largest[-1])
        for k in range(len(points)):
            if points[k] > last:
                largest[k] = self.largest[j]
        held = Counter((x - 1 - first) // width for x in ends if first < x <= last)
        beyond = self.between[j - 1]
        crowded = [(b in ends and found.get(k := (b - 1 - first) // width, (0, 0))[1] > held[k]) if b <= last else beyond for b in points[1:]]
        self.known[i : j + 1], self.largest[i : j + 1], self.between[i:j] = points, largest, crowded


def smallest_capacity(ends_between, total: int, largest: int, shards: int) -> list[int]:
    """The cuts, at most shards - 1 group ends, of the greedy walk with the smallest feasible capacity.

    ends_between(ranges, width): for each of the disjoint ranges (first, last], {slice: (largest end, number of ends)}.
    """
    ends = Ends(total)

    def walk(capacity: int, upper: bool) -> list[int]:
        at, cuts = 0, []
        for _ in range(shards):
            at = max(at, ends.floor(at + capacity)[upper])
            cuts.append(at)
        return cuts

    def least(low: int, high: int, upper: bool) -> int:
        while low < high:
            mid = (low + high) // 2
            low, high = (low, mid) if walk(mid, upper)[-1] >= total else (mid + 1, high)
        return low

    low, high = max(largest, -(-total // shards)), total
    finest = 2 * total
    while True:
        low, high = least(low, high, True), least(low, high, False)
        lower, upper = walk(low, False), walk(high, True)
        open_ranges: list[list[int]] = []
        for a, b in zip(lower, upper, strict=True):
            i, j = bisect_right(ends.known, a) - 1, bisect_right(ends.known, b) - 1
            for k in range(i, min(j, len(ends.between) - 1) + 1):
                if ends.between[k]:
                    first, last = ends.known[k], min(ends.known[k + 1], b)
                    if first < last:
                        if open_ranges and first <= open_ranges[-1][1]:
                            open_ranges[-1][1] = max(open_ranges[-1][1], last)
                        else:
                            open_ranges.append([first, last])
        if low == high and lower == upper or not open_ranges:
            return [x for x in lower[:-1] if x < total]
        width = finest = max(1, min(finest // 2, -(-max(b - a for a, b in open_ranges) // SLICES)))
        for (first, last), found in zip(open_ranges, ends_between(open_ranges, width), strict=True):
            ends.learn(first, last, width, found)


def minimax_shards(docs: DataFrame, shards: int = 8, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: doc_id, size, text_crc32, law ('bytes'), shard, slot, grown_shard (null).

    size is the text's UTF-8 bytes plus 1; a null text counts as empty, and all equal texts are one group,
    which no cut divides. Groups follow each other by smallest id (null ids first), and slot numbers a
    shard's rows from 0 in that order, then by id; rows that repeat an id and text get slots of their own.
    With fewer groups than shards the last shards stay empty, as all do for an empty table. Other columns
    of docs are not read.
    """
    text = F.encode(F.coalesce(F.col(text_col), F.lit("")), "UTF-8")
    rows = docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.md5(text).alias("digest"))
    rows = settle(rows, "shard-texts")
    firsts = settle(rows.groupBy("digest").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n")), "shard-groups", narrow=True)
    frequent = firsts.where(F.col("n") * GROUPS > rows.count()).select("digest", "first_id")  # fewer than GROUPS
    rare = rows.join(F.broadcast(frequent), "digest", "left_anti").join(firsts.select("digest", "first_id"), "digest")
    placed_by_first = rows.join(F.broadcast(frequent), "digest").select(rare.columns).unionByName(rare)
    ordered = placed_by_first.repartitionByRange("first_id", "digest", "doc_id").withColumn("part", F.spark_partition_id())
    ordered = settle(ordered, "shard-rows")  # later steps count on rows staying in their part

    by_part = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = ordered.groupBy("part").agg(F.sum("size").alias("bytes")).select("part", F.coalesce(F.sum("bytes").over(by_part), F.lit(0)).alias("before"))
    within = Window.partitionBy("part").orderBy("first_id", "digest", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    placed = settle(ordered.join(F.broadcast(parts), "part").withColumn("upto", F.col("before") + F.sum("size").over(within)).drop("before"), "shard-places", narrow=True)

    ends = settle(placed.groupBy("first_id", "digest").agg(F.max("upto").alias("upto"), F.sum("size").alias("bytes")), "shard-ends", narrow=True)
    total, largest = ends.agg(F.coalesce(F.sum("bytes"), F.lit(0)), F.coalesce(F.max("bytes"), F.lit(0))).first()

    def ends_between(ranges: list, width: int) -> list[dict]:
        found: list[dict] = [{} for _ in ranges]
        which = F.lit(None).cast("int")
        for k, (a, b) in enumerate(ranges):
            which = F.when((F.col("upto") > a) & (F.col("upto") <= b), F.lit(k)).otherwise(which)
        starts = F.array(*[F.lit(a).cast("long") for a, _ in ranges])
        hits = ends.select("upto", which.alias("range")).where(F.col("range").isNotNull())
        slices = hits.groupBy("range", F.floor((F.col("upto") - 1 - F.get(starts, F.col("range"))) / width).alias("slice")).agg(F.max("upto").alias("upto"), F.count("*").alias("n"))
        for r in slices.collect():  # at most SLICES rows for each of at most `shards` ranges
            found[r["range"]][r["slice"]] = (r["upto"], r["n"])
        return found

    cuts = smallest_capacity(ends_between, int(total), int(largest), shards) if total else []
    shard = sum((F.when(F.col("upto") > cut, 1).otherwise(0) for cut in cuts), F.lit(0)).cast("int")
    sharded = placed.withColumn("shard", shard)
    seen = sharded.groupBy("shard", "part").agg(F.count("*").alias("rows"))
    earlier = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = seen.select("shard", "part", F.coalesce(F.sum("rows").over(earlier), F.lit(0)).alias("before"))
    rank = F.row_number().over(Window.partitionBy("part", "shard").orderBy("first_id", "digest", "doc_id", "size"))
    return sharded.withColumn("rank", rank).join(F.broadcast(offsets), ["shard", "part"]).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("before") + F.col("rank") - 1).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def _oracle(shards: int = 8) -> str:
    """The same partition in SQL: the least capacity by dynamic programming over group ends, then the greedy cuts; CRC-32 by its table."""
    steps = "".join(f",\nd{k} AS (SELECT z.e, min(greatest(p.c, z.e - p.e)) AS c FROM z JOIN d{k - 1} p ON p.e <= z.e GROUP BY z.e)" for k in range(2, shards + 1))
    cuts = "".join(f",\nk{k} AS (SELECT max(z.e) AS e FROM z, cap, k{k - 1} b WHERE z.e <= b.e + cap.c)" for k in range(1, shards))
    shard = " + ".join(f"CASE WHEN o.e > (SELECT e FROM k{k}) THEN 1 ELSE 0 END" for k in range(1, shards))
    return f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
tab AS (SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda a, _: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END, i)) AS tb),
u AS (SELECT text, list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda x: ('0x' || x)::BIGINT) AS b FROM (SELECT DISTINCT text FROM t)),
crc AS (SELECT text, xor(list_reduce(b, lambda a, x: xor(a >> 8, tb[xor(a & 255, x) + 1]), 4294967295), 4294967295) AS text_crc32 FROM u, tab),
g AS (SELECT text, min(doc_id) AS first_id, CAST(sum(strlen(text) + 1) AS BIGINT) AS s FROM t GROUP BY text),
o AS (SELECT *, CAST(sum(s) OVER (ORDER BY first_id) AS BIGINT) AS e FROM g),
z AS (SELECT 0::BIGINT AS e UNION ALL SELECT e FROM o),
d1 AS (SELECT e, e AS c FROM z){steps},
cap AS (SELECT c FROM d{shards} ORDER BY e DESC LIMIT 1),
k0 AS (SELECT 0::BIGINT AS e){cuts},
r AS (SELECT t.doc_id, o.first_id, CAST(strlen(t.text) + 1 AS BIGINT) AS size, text_crc32, CAST({shard} AS INT) AS shard FROM t JOIN o USING (text) JOIN crc USING (text))
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY first_id, doc_id) - 1 AS slot, CAST(NULL AS INT) AS grown_shard FROM r"""


ORACLE = _oracle()
