"""Exact deduplication with a heavy-hitter split.

A Misra-Gries summary of each partition's digests, summed over partitions, names every digest that more
than 2/(k+1) of the rows share. Their counts are then taken exactly; these winners, at most k+1 of them,
are broadcast and decide their rows on the map side. All other digests are counted with partial aggregation
and joined to their rows by shuffle; no such group holds more than 2/(k+1) of the rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestor.llm.tables import content, keep_rows, settle

COUNTERS = 1023


def normalised(text: Column) -> Column:
    """Each run of ASCII white space as one space; null as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def summarise(counts: dict, more: dict, counters: int) -> dict:
    """Merges two Misra-Gries summaries: adds, then subtracts the (counters+1)-th largest count."""
    for key, n in more.items():
        counts[key] = counts.get(key, 0) + n
    if len(counts) > counters:
        least = sorted(counts.values(), reverse=True)[counters]
        counts = {key: n - least for key, n in counts.items() if n > least}
    return counts


def _summary_of_partition(counters: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict = {}
        for batch in batches:
            found = pc.value_counts(batch.column(0))
            counts = summarise(counts, dict(zip(found.field("values").to_pylist(), found.field("counts").to_pylist(), strict=True)), counters)
        yield pa.RecordBatch.from_pydict({"digest": list(counts), "n": list(counts.values())}, pa.schema([("digest", pa.string()), ("n", pa.int64())]))

    return run


def heavy_hitters(digests: DataFrame, counters: int = COUNTERS) -> DataFrame:
    """(digest, n) of at most counters+1 digests, with every digest that more than 2/(counters+1) of the rows of
    digests(digest) share. n is a lower bound that falls short by at most 1/(counters+1) of the rows."""
    rows = digests.count()
    parts = digests.select("digest").mapInArrow(_summary_of_partition(counters), "digest string, n long")
    return parts.groupBy("digest").agg(F.sum("n").alias("n")).where(F.col("n") > rows / (counters + 1))


def _decide(docs: DataFrame, id_col: str, text_col: str, counters: int) -> DataFrame:
    """(doc_id, content, keep_id, group_size, kept, digest) of each row; of equal texts one row is kept."""
    digests = settle(docs.select(F.col(id_col).alias("doc_id"), content(F.col(text_col)).alias("content"), F.sha2(normalised(F.col(text_col)), 256).alias("digest"), F.monotonically_increasing_id().alias("row")), "digests")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("without"), "doc_id", "row")).alias("first")
    likely = digests.sparkSession.createDataFrame([(r["digest"],) for r in heavy_hitters(digests, counters).collect()], "digest string")
    verified = digests.join(F.broadcast(likely), "digest").groupBy("digest").agg(first, F.count("*").alias("group_size"))
    winners = F.broadcast(digests.sparkSession.createDataFrame(verified.collect(), verified.schema))
    hot = digests.join(winners, "digest")
    rest = digests.join(winners, "digest", "left_anti")
    groups = rest.groupBy("digest").agg(first, F.count("*").alias("group_size"))
    both = hot.unionByName(rest.join(groups, "digest"))
    return both.select("doc_id", "content", F.col("first.doc_id").alias("keep_id"), "group_size", (F.col("row") == F.col("first.row")).alias("kept"), "digest")


def exact_dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", counters: int = COUNTERS) -> DataFrame:
    """One row for each row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after normalised(); null is an empty text, and a text of any length is read
    whole. Of equal texts the row with the smallest id stays. Null ids come last; where a group has only null
    ids, keep_id is null. Of rows that tie, as those that repeat an id and a text, one stays. Other columns of
    docs are not read, whatever their names. An empty table gives an empty result.
    """
    return _decide(docs, id_col, text_col, counters).select("doc_id", "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"))


def drop_copies(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", counters: int = COUNTERS) -> DataFrame:
    """The rows of docs that exact_dedup keeps, one for each text, all columns as they are."""
    return keep_rows(docs, _decide(docs, id_col, text_col, counters), id_col, text_col)


ORACLE = r"""
WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256)
"""
