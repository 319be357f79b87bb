"""Article entries as text: identifiers, splitting and joining, years, counts, JSON inside Markdown."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the entry format.
END_OF_ENTRY = "===END OF ABSTRACT==="
NO_TITLE, NO_ABSTRACT = "No title available", "No abstract available"
PMID_PATTERN = r"PMID:\s*(\d+)"
MIN_WORDS = 98


def pmid(text: Column) -> Column:
    """The first identifier, or empty."""
    return F.coalesce(F.regexp_extract(text, PMID_PATTERN, 1), F.lit(""))


def pmids(text: Column) -> Column:
    """All identifiers in order, repeats included."""
    return F.coalesce(F.regexp_extract_all(text, F.lit(PMID_PATTERN), F.lit(1)), F.array().cast("array<string>"))


def entries(text: Column, keep_end: bool = False) -> Column:
    """The entries of a text, trimmed, without blank ones; keep_end puts the end mark back."""
    parts = F.filter(F.transform(F.split(text, END_OF_ENTRY), lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: x != "")
    return F.transform(parts, lambda x: F.concat(x, F.lit(END_OF_ENTRY))) if keep_end else parts


def join_entries(parts: Column) -> Column:
    return F.array_join(F.transform(parts, lambda x: F.concat(x, F.lit(END_OF_ENTRY + "\n\n"))), "")


def entry(pmid_: Column, title: Column, sections: Column) -> Column:
    """An article in the entry format; its sections are joined by spaces."""
    abstract = F.coalesce(F.nullif(F.array_join(sections, " "), F.lit("")), F.lit(NO_ABSTRACT))
    return F.concat(F.lit("PMID: "), pmid_.cast("string"), F.lit("\nTitle: "), F.coalesce(title, F.lit(NO_TITLE)), F.lit("\nAbstract: "), abstract, F.lit(f"\n\n{END_OF_ENTRY}\n\n"))


def json_in_markdown(text: Column) -> Column:
    """The first fenced JSON object, else the widest braces; null where there is none."""
    fenced = F.regexp_extract(text, r"(?s)```json\s*(\{.*?\})\s*```", 1)
    return F.coalesce(F.nullif(fenced, F.lit("")), F.nullif(F.regexp_extract(text, r"(?s)(\{.*\})", 1), F.lit("")))


def publication_year(article: Column, pubdate: Column, medline: Column, completed: Column) -> Column:
    """The first year that is known, as text; "0000" where none is."""
    year = F.nullif(F.regexp_extract(medline, r"(\d{4})", 1), F.lit(""))
    return F.coalesce(F.nullif(article, F.lit("")), F.nullif(pubdate, F.lit("")), year, F.nullif(completed, F.lit("")), F.lit("0000"))


def word_count(text: Column) -> Column:
    return F.size(F.filter(F.split(text, r"\s+"), lambda x: x != ""))


def is_pmid(text: Column) -> Column:
    return text.rlike(r"\A[0-9]+\z")


def pmid_urls(text: Column, base: str = "https://pubmed.ncbi.nlm.nih.gov/") -> Column:
    return F.transform(pmids(text.cast("string")), lambda x: F.concat(F.lit(base), x, F.lit("/")))


def fingerprint(ids: Column) -> Column:
    """Eight hexadecimal digits that depend on the ids and their order."""
    return F.substring(F.sha2(F.array_join(ids, ","), 256), 1, 8)


def ratio_text(ratio: Column, kept: Column, total: Column) -> Column:
    return F.format_string("%.2f (%d/%d)", ratio, kept, total)


def number(text: Column) -> Column:
    """Null for what is no number, such as "N/A"."""
    return text.try_cast("double")


def whole_number(text: Column, default: int = 0) -> Column:
    return F.coalesce(text.try_cast("int"), F.lit(default))


def neg_log10(p: Column, compatible: bool = False) -> Column:
    """-log10(p), 300 where p is 0; a null or NaN p stays null, or counts as 0 where `compatible`."""
    clean = F.nanvl(p, F.lit(None).cast("double"))
    value = F.when(clean == 0, F.lit(300.0)).otherwise(-F.log10(clean))
    return F.coalesce(value, F.lit(300.0)) if compatible else value


def gene_of(hypothesis: Column, any_case: bool = False) -> Column:
    return F.nullif(F.regexp_extract(hypothesis, ("(?i)" if any_case else "") + r"The gene (\S+)", 1), F.lit(""))


def cell_type_of(hypothesis: Column, any_case: bool = False) -> Column:
    return F.nullif(F.regexp_extract(hypothesis, ("(?i)" if any_case else "") + r"the cell type ([^.]+)", 1), F.lit(""))


def cluster_of(path: Column) -> Column:
    return F.regexp_extract(path, r"clust(\d+)", 1).try_cast("int")


def run_time_of(path: Column) -> Column:
    return F.nullif(F.regexp_extract(path, r"output_(\d{14})", 1), F.lit(""))


def censor_year_of(path: Column) -> Column:
    return F.regexp_extract(path, r"cy(\d+)", 1).try_cast("int")


def iteration_of(path: Column) -> Column:
    return F.regexp_extract(path, r"iteration_(\d+)", 1).try_cast("int")


def error_class(error: Column, status: Column) -> Column:
    """ok, timeout, kv_exhausted, http_5xx, http_N or other."""
    low = F.lower(error)
    return (
        F.when(error.isNull(), "ok")
        .when(low.contains("timeout") | low.contains("timed out"), "timeout")
        .when(low.contains("kv cache") | low.contains("exhausted"), "kv_exhausted")
        .when(status >= 500, "http_5xx")
        .when(status.isNotNull(), F.concat(F.lit("http_"), status.cast("string")))
        .otherwise("other")
    )
