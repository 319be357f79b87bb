import pytest
from pyspark.sql import functions as F

from attestor.functions import terms, text


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return row.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "raw, canonical, display",
    [
        ("lung cancer|lung tumor|pulmonary cancer", "lung cancer", "lung cancer"),
        ("|term1|term2", "term1", "term1"),
        ("term1||term2", "term1", "term1"),
        ("hormone&therapy|HT|hormone replacement therapy", "hormone&therapy", "hormone therapy"),
        (None, "", ""),
        ("", "", ""),
        ("   ", "", ""),
        ("  a \t b |c", "a b", "a b"),
    ],
)
def test_terms(spark, raw, canonical, display):
    assert one(spark, terms.canonical(F.col("t")), t=raw) == canonical
    assert one(spark, terms.display(F.col("t")), t=raw) == display


def test_term_forms(spark):
    assert one(spark, terms.filename(F.col("t")), t="a/b" * 40) == ("a/b" * 40)[:80].replace("/", "_")
    assert one(spark, terms.short_label(F.col("t"), "T1"), t="lung cancer|x") == "lung"
    assert one(spark, terms.short_label(F.col("t"), "T1"), t="|x") == "T1"
    assert one(spark, terms.alternatives(F.col("t")), t="A&b | c d") == [["a", "b"], ["c d"]]
    assert one(spark, terms.with_suffix(F.col("t"), ""), t="a") == "a"
    assert one(spark, terms.with_suffix(F.col("t"), " drug"), t="a") == "a drug"


def test_identifiers(spark):
    t = "PMID: 12 and PMID:7 and PMID: 12 pmid: 3"
    assert one(spark, text.pmid(F.col("t")), t=t) == "12" and one(spark, text.pmid(F.col("t")), t="none") == "" and one(spark, text.pmid(F.col("t")), t=None) == ""
    assert one(spark, text.pmids(F.col("t")), t=t) == ["12", "7", "12"] and one(spark, text.pmids(F.col("t")), t=None) == []


def test_entries_split_and_join(spark):
    e = text.END_OF_ENTRY
    t = f" one {e}\n\n {e} two\n{e}\n"
    assert one(spark, text.entries(F.col("t")), t=t) == ["one", "two"]
    assert one(spark, text.entries(F.col("t"), keep_end=True), t=t) == [f"one{e}", f"two{e}"]
    assert one(spark, text.join_entries(text.entries(F.col("t"))), t=t) == f"one{e}\n\ntwo{e}\n\n"


@pytest.mark.parametrize("parts, year", [(("2001", "1", "1999 Jan", "3"), "2001"), (("", None, "Spring 1998-1999", "2000"), "1998"), ((None, None, "no date", "2003"), "2003"), ((None, "", None, None), "0000")])
def test_publication_year(spark, parts, year):
    assert one(spark, text.publication_year(*map(F.col, "abcd")), **dict(zip("abcd", parts))) == year


def test_json_in_markdown(spark):
    assert one(spark, text.json_in_markdown(F.col("t")), t='x ```json\n{"a": {"b": 1}}\n``` {"c": 2}') == '{"a": {"b": 1}}'
    assert one(spark, text.json_in_markdown(F.col("t")), t='x {"c": {"d": 2}} y') == '{"c": {"d": 2}}'
    assert one(spark, text.json_in_markdown(F.col("t")), t="none") is None


def test_numbers(spark):
    assert one(spark, text.number(F.col("t")), t="N/A") is None and one(spark, text.whole_number(F.col("t")), t="x") == 0
    assert one(spark, text.neg_log10(F.lit(0.0)), t="") == 300 and one(spark, text.neg_log10(F.lit(float("nan"))), t="") is None
    assert one(spark, text.neg_log10(F.lit(float("nan")), compatible=True), t="") == 300
    assert one(spark, text.word_count(F.col("t")), t=" a  b\nc ") == 3
    assert one(spark, text.ratio_text(F.lit(0.5), F.lit(1), F.lit(2)), t="") == "0.50 (1/2)"


def test_names_in_sentences_and_paths(spark):
    s = "The gene ABC1 acts in the cell type T cells. More"
    assert one(spark, text.gene_of(F.col("t")), t=s) == "ABC1" and one(spark, text.cell_type_of(F.col("t")), t=s) == "T cells"
    assert one(spark, text.gene_of(F.col("t")), t=s.lower()) is None and one(spark, text.gene_of(F.col("t"), any_case=True), t=s.lower()) == "abc1"
    path = "x/clust12/output_20240102030405/cy2011/iteration_3/a.json"
    assert one(spark, F.concat_ws(",", text.cluster_of(F.col("t")), text.run_time_of(F.col("t")), text.censor_year_of(F.col("t")), text.iteration_of(F.col("t"))), t=path) == "12,20240102030405,2011,3"


@pytest.mark.parametrize("error, status, kind", [(None, None, "ok"), ("Read timed out", None, "timeout"), ("KV cache exhausted", 500, "kv_exhausted"), ("x", 503, "http_5xx"), ("x", 404, "http_404"), ("x", None, "other")])
def test_error_classes(spark, error, status, kind):
    row = spark.createDataFrame([(error, status)], "e string, s int")
    assert row.select(text.error_class(F.col("e"), F.col("s")).alias("x")).first()["x"] == kind


def test_fingerprint_depends_on_order(spark):
    a, b = (one(spark, text.fingerprint(F.array(*map(F.lit, x))), t="") for x in ("12", "21"))
    assert a != b and len(a) == 8
