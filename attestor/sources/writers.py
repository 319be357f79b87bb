"""Writers of tables and records. The engine's own tables are Parquet; the others are for exchange."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestor.functions.terms import result_name


def tsv(df: DataFrame, path: str, mode: str = "error", sep: str = "\t") -> None:
    """Lists become JSON text; there is no index column."""
    lists = {f.name: F.to_json(f.name) for f in df.schema.fields if f.dataType.typeName() in ("array", "map", "struct")}
    df.withColumns(lists).write.mode(mode).option("header", True).option("sep", sep).csv(path)


def records(df: DataFrame, path: str, by: list[str] | None = None, mode: str = "error") -> None:
    """JSON lines, in a folder for each value of `by`."""
    writer = df.write.mode(mode)
    (writer.partitionBy(*by) if by else writer).json(path)


def tables(df: DataFrame, path: str, by: list[str] | None = None, mode: str = "error") -> None:
    writer = df.write.mode(mode)
    (writer.partitionBy(*by) if by else writer).parquet(path)


def removed(rows: DataFrame, kept: DataFrame, key: str, terms: list[str], path: str, mode: str = "error") -> None:
    """The term columns of rows that were not kept."""
    tsv(rows.join(kept.select(key), key, "left_anti").select(*terms), path, mode)


def output_name(kind, a, b, c=None, longest: int = 80):
    """A_B, A_C_B or H1_vs_H2, with characters that file names do not keep as "_"."""
    from attestor.functions.terms import filename

    parts = {"pair": [filename(a, longest), F.lit("_"), filename(b, longest)], "comparison": [filename(a, longest), F.lit("_vs_"), filename(b, longest)]}
    if c is not None:
        parts["chain"] = [filename(a, longest), F.lit("_"), filename(c, longest), F.lit("_"), filename(b, longest)]
    return result_name(F.concat(*parts[kind]))


def history(spark: SparkSession, rounds: list[dict], path: str, schema: str, mode: str = "error") -> None:
    """Comparisons of a tournament or ranking, as its loop on the driver gives them, as JSON lines; readers.history reads them again."""
    names = [x.split()[0] for x in schema.split(", ")]
    spark.createDataFrame([tuple(r.get(n) for n in names) for r in rounds], schema).coalesce(1).write.mode(mode).json(path)


def ranking(rows: DataFrame, path: str, mode: str = "error") -> None:
    """A ranking (rank, term, ...) as a table and as lines "1. term" of text, both in order."""
    ordered = rows.orderBy("rank").coalesce(1)
    tsv(ordered, f"{path.rstrip('/')}/ranking.tsv", mode)
    ordered.select(F.format_string("%d. %s", F.col("rank").cast("int"), "term").alias("line")).write.mode(mode).text(f"{path.rstrip('/')}/ranking.txt")


def parameters(spark: SparkSession, values: dict, path: str, mode: str = "error") -> None:
    """A job's settings as a table (name, value)."""
    spark.createDataFrame([(k, str(v)) for k, v in values.items()], "name string, value string").coalesce(1).write.mode(mode).option("header", True).csv(path)
