"""Readers of term lists, tables and result folders. Paths go to Spark's readers, so any store that it reaches will do."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from attestor.functions.terms import canonical, display
from attestor.functions.text import censor_year_of, cluster_of, iteration_of, run_time_of

#: Columns of year series, in the order of their files.
PAIR_YEARS = "date int, a_term string, a_count bigint, b_term string, b_count bigint, ab_count bigint, ab_pmids string, ab_pred_score double, ab_pvalue double, ab_sort_ratio double, total_count bigint"
CHAIN_YEARS = "date int, a_term string, a_count bigint, b_term string, b_count bigint, ab_count bigint, ab_pmids string, ab_pred_score double, ab_pvalue double, ab_sort_ratio double, b_term2 string, bc_count bigint, bc_pmids string, bc_pred_score double, bc_pvalue double, bc_sort_ratio double, c_term string, c_count bigint, total_count bigint, fet_bc_cutoff double"
STATS = "year int, stat_type string, terms string, statistic string, p_value double, info string"


def tsv(spark: SparkSession, path, schema: str | T.StructType | None = None, sep: str = "\t") -> DataFrame:
    """A table with a header. Without a schema all columns are text: types are never guessed from data."""
    reader = spark.read.option("header", True).option("sep", sep)
    return reader.schema(schema).csv(path) if schema else reader.csv(path)


def tsv_or_none(spark: SparkSession, path: str, schema=None) -> DataFrame | None:
    """None for a file that is missing or has no rows, so that the caller can skip it."""
    from pyspark.errors import AnalysisException

    try:
        rows = tsv(spark, path, schema)
    except AnalysisException:
        return None
    return None if rows.isEmpty() else rows


def terms(spark: SparkSession, path: str) -> DataFrame:
    """(pos, raw, canonical, display) of the lines that are not blank. A term list is one file, read as one, so lines keep their order."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", r"\r?\n")).alias("line", "raw"))
    clean = lines.select("line", F.trim("raw").alias("raw")).where("raw <> ''")
    ordered = clean.groupBy().agg(F.array_sort(F.collect_list(F.struct("line", "raw"))).alias("all")).select(F.posexplode("all").alias("pos", "x"))
    return ordered.select("pos", "x.raw", canonical(F.col("x.raw")).alias("canonical"), display(F.col("x.raw")).alias("display"))


def competing_terms(spark: SparkSession, path: str) -> DataFrame:
    """terms() without repeats of a canonical form, the first one stays; fewer than two are an error."""
    from attestor.operators.selection import first_of

    found = first_of(terms(spark, path), ["canonical"], [F.col("pos")])
    if found.count() < 2:
        raise ValueError("at least two different terms are needed")
    return found


def results(spark: SparkSession, path, schema: str) -> DataFrame:
    """Records of JSON files, lists of them or single ones, with file and iteration; what cannot be parsed is left out."""
    raw = spark.read.option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").schema(f"{schema}, _corrupt string").json(path)
    return raw.withColumn("file", F.col("_metadata.file_path")).where("_corrupt IS NULL").drop("_corrupt").withColumn("iteration", iteration_of(F.col("file")))


def run_folders(spark: SparkSession, pattern: str, sep: str = "\t") -> DataFrame:
    """Rows of all result tables that match pattern, with cluster, run_time and censor_year from their folders' names."""
    rows = tsv(spark, pattern, sep=sep).withColumn("file", F.col("_metadata.file_path"))
    return rows.withColumns({"cluster": cluster_of(F.col("file")), "run_time": run_time_of(F.col("file")), "censor_year": censor_year_of(F.col("file"))})


def pmid_list(column: str):
    """A list that a table holds as text, such as "[12, 34]"."""
    return F.from_json(F.col(column), "array<bigint>")


def column_like(df: DataFrame, *names: str) -> str | None:
    """The column that is one of names, whatever the case and with "." for "_"."""
    plain = {c.lower().replace(".", "_"): c for c in df.columns}
    return next((plain[n.lower().replace(".", "_")] for n in names if n.lower().replace(".", "_") in plain), None)


def require(df: DataFrame, *columns: str, optional: dict[str, str] | None = None) -> DataFrame:
    """df, if it has these columns; optional ones that it lacks are added as nulls of the given types."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    return df.withColumns({c: F.lit(None).cast(kind) for c, kind in (optional or {}).items() if c not in df.columns})


def missing_articles(wanted: DataFrame, stored: DataFrame) -> DataFrame:
    """Identifiers, digits only and each once, that the store of articles lacks."""
    from attestor.functions.text import is_pmid

    return wanted.where(is_pmid(F.col("pmid").cast("string"))).select("pmid").distinct().join(stored.select("pmid"), "pmid", "left_anti")


def year_results(spark: SparkSession, folder: str, name: str = "results") -> DataFrame:
    """Rows of the result tables in folders cy<year>, all as text, with censor_year: of a folder's <name>.txt, else of its <name>.tsv."""
    every = tsv(spark, f"{folder.rstrip('/')}/cy*/{name}.t[xs][tv]").withColumn("file", F.col("_metadata.file_path"))
    rows = every.withColumns({"_folder": F.regexp_extract("file", r"^(.*)/[^/]*$", 1), "censor_year": censor_year_of(F.col("file")), "_text": F.col("file").endswith(".txt")})
    preferred = rows.where("_text").select("_folder").distinct()
    return rows.where("_text").unionByName(rows.where("NOT _text").join(preferred, "_folder", "left_anti").select(rows.columns)).drop("_folder", "_text")


def results_of_runs(spark: SparkSession, folder: str) -> DataFrame:
    """Rows of results.tsv of each subfolder but those that hold plots, all as text, with their file."""
    rows = tsv(spark, f"{folder.rstrip('/')}/*/results.tsv").withColumn("file", F.col("_metadata.file_path"))
    return rows.where(~F.col("file").rlike("/output_visualization_[^/]*/results\\.tsv$"))


def scores(rows: DataFrame, *columns: str) -> DataFrame:
    """rows of text with these columns as numbers; what is no number, such as N/A, is null."""
    return rows.withColumns({c: F.col(c).try_cast("double") for c in columns})


#: Comparisons of a tournament or ranking, as writers.history stores them.
HISTORY = "round int, term1 string, term2 string, winner string, mean_score double, bye string"
COMPARISONS = "pass int, kind string, position_i int, position_j int, term_i string, term_j string, outcome string, mean_score double, status string, swapped boolean, from_cache boolean"


def history(spark: SparkSession, path: str, schema: str = HISTORY) -> DataFrame:
    """What writers.history stored; with COMPARISONS its rows can go to competition.oriented as a cache of verdicts."""
    return spark.read.schema(schema).json(path)
