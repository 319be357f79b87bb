"""Queries of term, text, co-occurrence and selection operators over whole tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from attestor.functions import terms, text
from attestor.operators import cooccurrence, relevance, sampling, selection
from attestor.plans import inputs
from attestor.plans.registry import query

DOC_TERMS = f"SELECT doc_id, {inputs.RAW_TERM} AS raw FROM documents"
CANONICAL = r"coalesce([y FOR y IN [trim(regexp_replace(x, '\s+', ' ', 'g')) FOR x IN string_split(raw, '|')] IF y <> ''][1], '')"
TEMPLATE = "{a_term} affects {b_term} in {c_term}."


def _terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inputs.table(spark, sf_dir, "documents").select("doc_id", F.expr(inputs.RAW_TERM).alias("raw"))


@query(f"SELECT doc_id, {CANONICAL} AS canonical FROM ({DOC_TERMS})")
def term_strip_pipe(spark, sf_dir):
    return _terms(spark, sf_dir).select("doc_id", terms.canonical(F.col("raw")).alias("canonical"))


@query(rf"SELECT doc_id, trim(regexp_replace(replace({CANONICAL}, '&', ' '), '\s+', ' ', 'g')) AS display FROM ({DOC_TERMS})")
def term_display(spark, sf_dir):
    return _terms(spark, sf_dir).select("doc_id", terms.display(F.col("raw")).alias("display"))


@query(f"SELECT doc_id, replace(substring({CANONICAL}, 1, 80), '/', '_') AS filename FROM ({DOC_TERMS})")
def term_filename(spark, sf_dir):
    return _terms(spark, sf_dir).select("doc_id", terms.filename(F.col("raw")).alias("filename"))


@query(f"SELECT doc_id, coalesce(nullif(split_part(split_part(raw, '|', 1), ' ', 1), ''), 'T1') AS label, replace(coalesce(raw, ''), '-', '_') AS model FROM ({DOC_TERMS})")
def term_short_label(spark, sf_dir):
    return _terms(spark, sf_dir).select("doc_id", terms.short_label(F.col("raw"), "T1").alias("label"), terms.model_name(F.coalesce("raw", F.lit(""))).alias("model"))


CITING = "CASE WHEN doc_id % 3 = 0 THEN 'no reference' ELSE concat('see PMID: ', doc_id, ', PMID:', doc_id + 7, ' and PMID ', doc_id, ' or PMID:  ', doc_id) END"


def _citing(spark, sf_dir):
    return inputs.table(spark, sf_dir, "documents").select("doc_id", F.expr(CITING).alias("t"))


@query(rf"SELECT doc_id, regexp_extract(t, 'PMID:\s*(\d+)', 1) AS pmid FROM (SELECT doc_id, {CITING} AS t FROM documents)")
def pmid_extract_first(spark, sf_dir):
    return _citing(spark, sf_dir).select("doc_id", text.pmid(F.col("t")).alias("pmid"))


@query(rf"SELECT doc_id, array_to_string(regexp_extract_all(t, 'PMID:\s*(\d+)', 1), ',') AS pmids, len(regexp_extract_all(t, 'PMID:\s*(\d+)', 1)) AS n FROM (SELECT doc_id, {CITING} AS t FROM documents)")
def pmid_extract_all(spark, sf_dir):
    found = text.pmids(F.col("t"))
    return _citing(spark, sf_dir).select("doc_id", F.array_join(found, ",").alias("pmids"), F.size(found).cast("long").alias("n"))


@query(rf"SELECT doc_id, array_to_string([concat('https://pubmed.ncbi.nlm.nih.gov/', x, '/') FOR x IN regexp_extract_all(t, 'PMID:\s*(\d+)', 1)], ' ') AS urls FROM (SELECT doc_id, {CITING} AS t FROM documents)")
def pmid_urls(spark, sf_dir):
    return _citing(spark, sf_dir).select("doc_id", F.array_join(text.pmid_urls(F.col("t")), " ").alias("urls"))


BODY = "concat('PMID: ', doc_id, ' ', coalesce(text, ''), '===END OF ABSTRACT===', chr(10), '  second ', source, ' ===END OF ABSTRACT===', chr(10), chr(10), ' ===END OF ABSTRACT===  ', CASE WHEN doc_id % 2 = 0 THEN 'rest' ELSE '' END)"


@query(rf"""SELECT doc_id, len(p) AS n, md5(array_to_string(p, '|')) AS digest, list_transform(p, lambda x: length(x)) AS lengths FROM (
  SELECT doc_id, [y FOR y IN [regexp_replace(x, '^\s+|\s+$', '', 'g') FOR x IN string_split({BODY}, '===END OF ABSTRACT===')] IF y <> ''] AS p FROM documents)""")
def abstract_split(spark, sf_dir):
    parts = text.entries(F.expr(BODY))
    return inputs.table(spark, sf_dir, "documents").select("doc_id", F.size(parts).cast("long").alias("n"), F.md5(F.array_join(parts, "|")).alias("digest"), F.transform(parts, lambda x: F.length(x).cast("long")).alias("lengths"))


@query("""SELECT conv_id, count(*) AS n, md5(string_agg(concat(text, '===END OF ABSTRACT===', chr(10), chr(10)), '' ORDER BY turn)) AS digest
FROM (SELECT conv_id, turn, min(text) AS text FROM conversations GROUP BY ALL) GROUP BY conv_id""")
def abstract_join(spark, sf_dir):
    rows = inputs.table(spark, sf_dir, "conversations").groupBy("conv_id", "turn").agg(F.min("text").alias("text"))
    lists = relevance.regroup(rows, ["conv_id"], "text", "turn")
    return lists.select("conv_id", F.size("text").cast("long").alias("n"), F.md5(text.join_entries(F.col("text"))).alias("digest"))


@query("""SELECT doc_id, concat('PMID: ', doc_id, chr(10), 'Title: ', coalesce(CASE WHEN doc_id % 4 > 0 THEN source END, 'No title available'), chr(10), 'Abstract: ',
  CASE WHEN doc_id % 5 = 0 THEN 'No abstract available' ELSE concat(lang, ' ', source) END, chr(10), chr(10), '===END OF ABSTRACT===', chr(10), chr(10)) AS entry FROM documents""")
def abstract_entry(spark, sf_dir):
    sections = F.when(F.col("doc_id") % 5 == 0, F.array().cast("array<string>")).otherwise(F.array("lang", "source"))
    return inputs.table(spark, sf_dir, "documents").select("doc_id", text.entry(F.col("doc_id"), F.when(F.col("doc_id") % 4 > 0, F.col("source")), sections).alias("entry"))


FENCED = "CASE doc_id % 3 WHEN 0 THEN concat('text ```json', chr(10), '{\"a\": ', doc_id, '}', chr(10), '``` {\"b\": 2}') WHEN 1 THEN concat('x {\"c\": {\"d\": ', doc_id, '}} y') ELSE 'none' END"


@query(rf"""SELECT doc_id, coalesce(nullif(regexp_extract(t, '(?s)```json\s*(\{{.*?\}})\s*```', 1), ''), nullif(regexp_extract(t, '(?s)(\{{.*\}})', 1), '')) AS found
FROM (SELECT doc_id, {FENCED} AS t FROM documents)""")
def json_from_markdown(spark, sf_dir):
    return inputs.table(spark, sf_dir, "documents").select("doc_id", text.json_in_markdown(F.expr(FENCED)).alias("found"))


@query(f"""SELECT doc_id, CASE doc_id % 4
  WHEN 0 THEN replace(replace(replace('{TEMPLATE}', '{{a_term}}', source), '{{b_term}}', lang), '{{c_term}}', 'x')
  WHEN 1 THEN concat(lang, ' changes x.') WHEN 2 THEN concat(source, ' changes x.') ELSE '' END AS hypothesis FROM documents""")
def hypothesis_render(spark, sf_dir):
    kinds = F.element_at(F.array(*[F.lit(k) for k in ("A_B_C", "B_C", "A_C", "none")]), (F.col("doc_id") % 4 + 1).cast("int"))
    templates = {"A_B_C": TEMPLATE, "B_C": "{b_term} changes {c_term}.", "A_C": "{a_term} changes {c_term}."}
    return inputs.table(spark, sf_dir, "documents").select("doc_id", relevance.hypothesis_for(kinds, templates, a_term=F.col("source"), b_term=F.col("lang"), c_term=F.lit("x")).alias("hypothesis"))


@query("""SELECT doc_id, length(p) AS n, md5(p) AS digest FROM (
  SELECT doc_id, concat('Abstract: ', substring(text, 1, 9000), chr(10), 'Hypothesis: ', source, ' matters.', chr(10), 'Answer 1 if the abstract helps to judge the hypothesis, else 0: ') AS p FROM documents)""")
def relevance_prompt(spark, sf_dir):
    prompt = relevance.relevance_prompt(F.col("text"), F.concat("source", F.lit(" matters.")))
    return inputs.table(spark, sf_dir, "documents").select("doc_id", F.length(prompt).cast("long").alias("n"), F.md5(prompt).alias("digest"))


YEAR_PARTS = """CASE WHEN doc_id % 7 = 0 THEN CAST(1990 + doc_id % 30 AS VARCHAR) END AS article, CASE WHEN doc_id % 5 = 0 THEN CAST(1980 + doc_id % 40 AS VARCHAR) WHEN doc_id % 5 = 1 THEN '' END AS pubdate,
  CASE WHEN doc_id % 3 = 0 THEN concat('Spring ', 1970 + doc_id % 50, '-', 1971 + doc_id % 50) WHEN doc_id % 3 = 1 THEN 'no date' END AS medline, CASE WHEN doc_id % 2 = 0 THEN CAST(2000 + doc_id % 20 AS VARCHAR) END AS completed"""


@query(rf"""SELECT doc_id, coalesce(nullif(article, ''), nullif(pubdate, ''), nullif(regexp_extract(medline, '(\d{{4}})', 1), ''), nullif(completed, ''), '0000') AS pub_year
FROM (SELECT doc_id, {YEAR_PARTS} FROM documents)""")
def year_cascade(spark, sf_dir):
    parts = spark.sql(f"SELECT doc_id, {YEAR_PARTS.replace('VARCHAR', 'STRING')} FROM {{d}}", d=inputs.table(spark, sf_dir, "documents"))
    return parts.select("doc_id", text.publication_year(*map(F.col, ("article", "pubdate", "medline", "completed"))).alias("pub_year"))


@query(r"SELECT doc_id, word_count FROM (SELECT doc_id, len([x FOR x IN regexp_split_to_array(text, '\s+') IF x <> '']) AS word_count FROM documents) WHERE word_count >= 98")
def word_count_filter(spark, sf_dir):
    counted = inputs.table(spark, sf_dir, "documents").select("doc_id", text.word_count(F.col("text")).cast("long").alias("word_count"))
    return counted.where(F.col("word_count") >= text.MIN_WORDS)


@query("SELECT doc_id FROM (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN CAST(doc_id AS VARCHAR) ELSE concat('x', doc_id) END AS p FROM documents) WHERE regexp_full_match(p, '[0-9]+')")
def pmid_validate(spark, sf_dir):
    p = F.when(F.col("doc_id") % 2 == 0, F.col("doc_id").cast("string")).otherwise(F.concat(F.lit("x"), F.col("doc_id").cast("string")))
    return inputs.table(spark, sf_dir, "documents").where(text.is_pmid(p)).select("doc_id")


SENTENCE = "concat('The gene G', doc_id % 9, ' acts in the cell type ', lang, ' cells. clust', doc_id % 4, '/output_20240101', lpad(CAST(doc_id % 1000000 AS {s}), 6, '0'), '/cy', 1990 + doc_id % 30)"


@query(rf"""SELECT doc_id, regexp_extract(t, 'The gene (\S+)', 1) AS gene, regexp_extract(t, 'the cell type ([^.]+)', 1) AS cell_type,
  CAST(regexp_extract(t, 'clust(\d+)', 1) AS INT) AS cluster, regexp_extract(t, 'output_(\d{{14}})', 1) AS run_time, CAST(regexp_extract(t, 'cy(\d+)', 1) AS INT) AS censor_year
FROM (SELECT doc_id, {SENTENCE.format(s='VARCHAR')} AS t FROM documents)""")
def name_patterns(spark, sf_dir):
    t = F.expr(SENTENCE.format(s="STRING"))
    return inputs.table(spark, sf_dir, "documents").select("doc_id", text.gene_of(t).alias("gene"), text.cell_type_of(t).alias("cell_type"), text.cluster_of(t).alias("cluster"), text.run_time_of(t).alias("run_time"), text.censor_year_of(t).alias("censor_year"))


@query(f"WITH {inputs.ART} SELECT pmid, pub_year FROM art WHERE pub_year BETWEEN 1990 AND 2005")
def censor_window(spark, sf_dir):
    return cooccurrence.censored(inputs.articles(spark, sf_dir), 1990, 2005).select("pmid", "pub_year")


@query(f"WITH {inputs.MENTION} SELECT token, count(*) AS n FROM mention WHERE token IN {tuple(inputs.A_TERMS + inputs.B_TERMS)} GROUP BY token")
def term_counts(spark, sf_dir):
    return cooccurrence.term_counts(cooccurrence.mentions(inputs.articles(spark, sf_dir)), inputs.A_TERMS + inputs.B_TERMS)


@query(f"""WITH {inputs.MENTION} SELECT 'that&with|whou' AS term, count(*) AS n FROM (
  SELECT pmid FROM mention WHERE token = 'whou' UNION SELECT a.pmid FROM mention a JOIN mention b USING (pmid) WHERE a.token = 'that' AND b.token = 'with')""")
def term_alternatives(spark, sf_dir):
    asked = spark.createDataFrame([("that&with|whou",)], "term string")
    return cooccurrence.term_mentions(cooccurrence.mentions(inputs.articles(spark, sf_dir)), asked).groupBy("term").agg(F.count("*").alias("n"))


@query(f"""WITH {inputs.MENTION} SELECT a.token AS a_term, b.token AS b_term, count(*) AS n, min(pmid) AS first, max(pmid) AS last, CAST(sum(pmid * 7919 % 1000003) AS BIGINT) AS checksum
FROM mention a JOIN mention b USING (pmid) WHERE a.token IN {tuple(inputs.A_TERMS)} AND b.token IN {tuple(inputs.B_TERMS)} GROUP BY ALL""")
def pair_intersection(spark, sf_dir):
    found = cooccurrence.pair_articles(inputs.articles(spark, sf_dir), inputs.A_TERMS, inputs.B_TERMS)
    return found.groupBy("a_term", "b_term").agg(F.count("*").alias("n"), F.min("pmid").alias("first"), F.max("pmid").alias("last"), F.sum(F.col("pmid") * 7919 % 1000003).alias("checksum"))


def _pairs(spark, sf_dir):
    return cooccurrence.pair_counts(inputs.articles(spark, sf_dir), inputs.A_TERMS, inputs.B_TERMS)


@query(f"WITH {inputs.PAIRS} SELECT a_term, b_term, a_count, b_count, ab_count, round(ab_count / nullif(b_count, 0), 9) AS sort_ratio FROM pairs")
def sort_ratio(spark, sf_dir):
    return _pairs(spark, sf_dir).withColumn("sort_ratio", F.round(cooccurrence.sort_ratio(F.col("ab_count"), F.col("b_count")), 9))


@query(f"WITH {inputs.PAIRS}, {inputs.FISHER} SELECT a_term, b_term, ab_count, round(log10(greatest(p, 1e-300)), 4) AS log_p FROM fet WHERE p < 0.9")
def fet_threshold(spark, sf_dir):
    total = inputs.table(spark, sf_dir, "documents").count()
    kept = cooccurrence.significant(cooccurrence.with_fisher(_pairs(spark, sf_dir), total), 0.9, inputs.B_TERMS)
    return kept.select("a_term", "b_term", "ab_count", F.round(F.log10(F.greatest("p_value", F.lit(1e-300))), 4).alias("log_p"))


BC = f"bc AS (SELECT b.token AS b_term, c.token AS c_term, count(*) AS bc_count FROM mention b JOIN mention c USING (pmid) WHERE b.token IN {tuple(inputs.B_TERMS)} AND c.token IN {tuple(inputs.C_TERMS)} GROUP BY ALL)"


def _chains(spark, sf_dir):
    rows = inputs.articles(spark, sf_dir)
    ab = cooccurrence.pair_counts(rows, inputs.A_TERMS, inputs.B_TERMS).where("ab_count > 0").select("a_term", "b_term", "ab_count")
    bc = cooccurrence.pair_counts(rows, inputs.B_TERMS, inputs.C_TERMS).where("ab_count > 0").select(F.col("a_term").alias("b_term"), F.col("b_term").alias("c_term"), F.col("ab_count").alias("bc_count"))
    return cooccurrence.chains(ab, bc)


@query(f"WITH {inputs.PAIRS}, {BC} SELECT a_term, b_term, c_term, ab_count, bc_count FROM ab JOIN bc USING (b_term)")
def chain_abc(spark, sf_dir):
    return _chains(spark, sf_dir).select("a_term", "b_term", "c_term", "ab_count", "bc_count")


@query(f"""WITH {inputs.PAIRS}, {BC} SELECT a_term, c_term, b_term, chain_value FROM (
  SELECT a_term, c_term, b_term, ab_count * bc_count AS chain_value, row_number() OVER (PARTITION BY a_term, c_term ORDER BY ab_count * bc_count DESC, b_term DESC) AS r FROM ab JOIN bc USING (b_term)) WHERE r = 1""")
def best_chain(spark, sf_dir):
    return cooccurrence.best_chain(_chains(spark, sf_dir), F.col("ab_count") * F.col("bc_count"), ["a_term", "c_term"]).select("a_term", "c_term", "b_term", "chain_value")


def _hits(spark, sf_dir):
    mention = cooccurrence.mentions(inputs.articles(spark, sf_dir)).where(F.col("token").isin(inputs.B_TERMS))
    return mention.select("token", "pmid", F.expr("CAST(1975 + pmid % 50 AS INT)").alias("pub_year"), ((F.col("pmid") * 7919) % 1009).alias("citations"))


HITS = f"hits AS (SELECT token, pmid, CAST(1975 + pmid % 50 AS INT) AS pub_year, (pmid * 7919) % 1009 AS citations FROM mention WHERE token IN {tuple(inputs.B_TERMS)})"
RANKED = f"{inputs.MENTION}, {HITS}, ranked AS (SELECT *, row_number() OVER (PARTITION BY token ORDER BY citations DESC, pmid) AS cited_rank, row_number() OVER (PARTITION BY token ORDER BY pub_year DESC, pmid) AS recent_rank FROM hits)"


@query(f"WITH {RANKED} SELECT token, pmid FROM ranked WHERE cited_rank <= 20 OR recent_rank <= 10")
def topn_cited_recent(spark, sf_dir):
    return cooccurrence.top_cited_and_recent(_hits(spark, sf_dir), 20, 10, ["token"]).select("token", "pmid")


@query(f"WITH {RANKED} SELECT token, pmid, row_number() OVER (PARTITION BY token ORDER BY least((cited_rank - 1) * 2, (recent_rank - 1) * 2 + 1), pmid) AS place FROM ranked QUALIFY place <= 25")
def interleave_complete(spark, sf_dir):
    hits = _hits(spark, sf_dir)
    cited, recent = (cooccurrence.top(hits, 25, by, ["token"], rank) for by, rank in (("citations", "cited_rank"), ("pub_year", "recent_rank")))
    return selection.interleave_top(cited, recent, ["token"], 25).select("token", "pmid", F.col("place").cast("long").alias("place"))


@query(f"WITH {RANKED} SELECT token, pmid, recent_rank FROM ranked")
def recency_order(spark, sf_dir):
    rows = _hits(spark, sf_dir).withColumn("pos", F.col("pmid"))
    return selection.by_recency(rows, ["token"]).select("token", "pmid", F.col("recent_rank").cast("long").alias("recent_rank"))


@query(f"""WITH {inputs.PAIRS} SELECT a_term, b_term, rank FROM (SELECT *, row_number() OVER (PARTITION BY a_term ORDER BY ab_count / nullif(b_count, 0) DESC NULLS LAST, b_term) AS rank FROM pairs) WHERE rank <= 3""")
def sort_topk(spark, sf_dir):
    ratio = F.desc_nulls_last(cooccurrence.sort_ratio(F.col("ab_count"), F.col("b_count")))
    ranked = _pairs(spark, sf_dir).withColumn("rank", F.row_number().over(Window.partitionBy("a_term").orderBy(ratio, "b_term")).cast("long"))
    return ranked.where("rank <= 3").select("a_term", "b_term", "rank")


@query(f"""WITH {inputs.PAIRS}, o AS (SELECT * FROM (VALUES ('que', 0), ('with', 1), ('und', 2)) t(b_term, p)) SELECT a_term, b_term, ab_count, CAST(coalesce(p, 3) AS BIGINT) AS sort_pos FROM pairs LEFT JOIN o USING (b_term)""")
def resort_input_order(spark, sf_dir):
    order = spark.createDataFrame([("que", 0), ("with", 1), ("und", 2)], "term string, pos long")
    return selection.resorted(_pairs(spark, sf_dir), order, "b_term", [F.desc("ab_count")]).select("a_term", "b_term", "ab_count", "sort_pos")


@query("SELECT r_name, n_name, s FROM (SELECT r_name FROM region), (SELECT n_name FROM nation), (SELECT DISTINCT c_mktsegment AS s FROM customer)")
def cartesian_terms(spark, sf_dir):
    a, b = (inputs.table(spark, sf_dir, t).select(c) for t, c in (("region", "r_name"), ("nation", "n_name")))
    return selection.product_of_terms(a, b, inputs.table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("s")).distinct())


@query("SELECT CAST(n_nationkey AS BIGINT) AS pos, n_name AS a_term, concat('B', n_regionkey) AS b_term FROM nation")
def positional_terms(spark, sf_dir):
    nation = inputs.table(spark, sf_dir, "nation").withColumn("pos", F.col("n_nationkey").cast("long"))
    return selection.zip_terms(nation.select("pos", F.col("n_name").alias("a_term")), nation.select("pos", F.concat(F.lit("B"), F.col("n_regionkey").cast("string")).alias("b_term")))


POSITIONS = f"""{inputs.MENTION}, positions AS (
  SELECT CASE token WHEN 'que' THEN 'ab' ELSE 'bc' END AS intersection, row_number() OVER (PARTITION BY token ORDER BY pmid) - 1 AS pos, pmid * 2 AS pmid FROM mention WHERE token IN ('que', 'with'))"""


def _positions(spark, sf_dir):
    mention = cooccurrence.mentions(inputs.articles(spark, sf_dir)).where(F.col("token").isin("que", "with"))
    rows = mention.select(F.when(F.col("token") == "que", "ab").otherwise("bc").alias("intersection"), (F.col("pmid") * 2).alias("pmid"))
    return relevance.position_in(rows, ["intersection"]).withColumn("hypothesis", F.when(F.col("intersection") == "ab", "h1").otherwise("h2"))


@query(f"""WITH {POSITIONS} SELECT intersection, pos, p.pmid, CASE intersection WHEN 'ab' THEN 'h1' ELSE 'h2' END AS hypothesis, md5(coalesce(text, '')) AS digest FROM positions p LEFT JOIN documents d ON d.doc_id = p.pmid""")
def pmid_position_join(spark, sf_dir):
    joined = relevance.with_articles(_positions(spark, sf_dir), inputs.articles(spark, sf_dir))
    return joined.select("intersection", F.col("pos").cast("long").alias("pos"), "pmid", "hypothesis", F.md5("text").alias("digest"))


MASKED = f"{POSITIONS}, masked AS (SELECT intersection, pos, p.pmid, CASE WHEN quality = 1 AND toxic = 0 THEN 1 ELSE 0 END AS mask FROM positions p LEFT JOIN labels l ON l.doc_id = p.pmid)"


def _masked(spark, sf_dir):
    labels = inputs.table(spark, sf_dir, "labels").select(F.col("doc_id").alias("pmid"), F.when((F.col("quality") == 1) & (F.col("toxic") == 0), F.lit(" 1 ")).otherwise(F.lit("no")).alias("answer"))
    return _positions(spark, sf_dir).join(labels, "pmid", "left").withColumn("mask", relevance.mask(F.col("answer")))


@query(f"WITH {MASKED} SELECT intersection, pos, pmid FROM masked WHERE mask = 1")
def mask_filter(spark, sf_dir):
    return relevance.kept(_masked(spark, sf_dir)).select("intersection", F.col("pos").cast("long").alias("pos"), "pmid")


@query(f"""WITH {MASKED} SELECT intersection, CAST(sum(mask) AS BIGINT) AS relevant, count(*) AS total, round(avg(mask), 9) AS ratio, concat(CAST(sum(mask) AS BIGINT), '/', count(*)) AS fraction, CAST(count(*) - sum(mask) AS BIGINT) AS filtered FROM masked GROUP BY intersection""")
def relevance_ratio(spark, sf_dir):
    return relevance.relevance_ratio(_masked(spark, sf_dir), ["intersection"]).withColumn("ratio", F.round("ratio", 9))


@query(f"WITH {MASKED} SELECT intersection, pos // 1000 AS part, count(*) AS n, md5(string_agg(CAST(pmid AS VARCHAR), ',' ORDER BY pos)) AS digest FROM masked WHERE mask = 1 GROUP BY ALL")
def explode_regroup(spark, sf_dir):
    parts = relevance.kept(_masked(spark, sf_dir)).withColumn("part", F.floor(F.col("pos") / 1000))
    lists = relevance.regroup(parts, ["intersection", "part"], "pmid")
    return lists.select("intersection", "part", F.size("pmid").cast("long").alias("n"), F.md5(F.array_join(F.col("pmid").cast("array<string>"), ",")).alias("digest"))


KEPT = "SELECT o_orderkey, o_custkey FROM orders WHERE o_totalprice > 100000"


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_totalprice > 100000")
def kept_semi(spark, sf_dir):
    orders = inputs.table(spark, sf_dir, "orders")
    return selection.kept_and_removed(orders, orders.where("o_totalprice > 100000"), "o_orderkey")[0].select("o_orderkey", "o_custkey")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE NOT o_totalprice > 100000")
def removed_anti(spark, sf_dir):
    orders = inputs.table(spark, sf_dir, "orders")
    return selection.kept_and_removed(orders, orders.where("o_totalprice > 100000"), "o_orderkey")[1].select("o_orderkey", "o_custkey")


@query("SELECT s_suppkey AS k, s_name AS name, NULL AS segment FROM supplier UNION ALL SELECT c_custkey, c_name, c_mktsegment FROM customer")
def concat_union(spark, sf_dir):
    s = inputs.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("name"))
    c = inputs.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))
    return selection.union_all(s, c)


POOLS = "CAST(user_id % 2 + 1 AS INT) AS pool, event_id AS pos, CASE WHEN event_id % 10 = 0 THEN '' ELSE CAST(user_id * 3 + event_id % 17 AS {s}) END AS pmid"


@query(f"SELECT pool, pos, pmid FROM (SELECT *, row_number() OVER (PARTITION BY CASE WHEN pmid = '' THEN concat('row:', pos) ELSE pmid END ORDER BY pool, pos) AS r FROM (SELECT {POOLS.format(s='VARCHAR')} FROM events)) WHERE r = 1")
def dedup_pools(spark, sf_dir):
    rows = spark.sql(f"SELECT {POOLS.format(s='STRING')} FROM {{e}}", e=inputs.table(spark, sf_dir, "events"))
    return selection.dedup_pools(rows).select("pool", "pos", "pmid")


@query("SELECT conv_id, turn, running_tokens FROM (SELECT conv_id, turn, CAST(sum(length(text) // 4) OVER (PARTITION BY conv_id ORDER BY turn) AS BIGINT) AS running_tokens FROM (SELECT conv_id, turn, min(text) AS text FROM conversations GROUP BY ALL)) WHERE running_tokens <= 300")
def token_budget(spark, sf_dir):
    rows = inputs.table(spark, sf_dir, "conversations").groupBy("conv_id", "turn").agg(F.min("text").alias("text"))
    return selection.within_budget(rows, ["conv_id"], F.floor(F.length("text") / 4), 900, 3, "turn").select("conv_id", "turn", "running_tokens")


@query("SELECT user_id, max(event_id) AS event_id FROM events GROUP BY user_id")
def latest_per_cluster(spark, sf_dir):
    return selection.latest(inputs.table(spark, sf_dir, "events").select("user_id", "event_id", "event_type"), ["user_id"], "event_id").select("user_id", "event_id")


ALLOCATED = """t AS (SELECT CAST(user_id % 97 * 3 AS BIGINT) AS t1, CAST(event_id % 89 AS BIGINT) AS t2 FROM events GROUP BY ALL),
s AS (SELECT *, least(50, t1 + t2) AS av FROM t),
p AS (SELECT *, CASE WHEN t1 + t2 = 0 THEN 0 ELSE least(t1, CAST(round_even(t1 / (t1 + t2) * av, 0) AS BIGINT)) END AS n0, least(t1, 3) AS f1, least(t2, 3) AS f2 FROM s),
q AS (SELECT *, CASE WHEN av - n0 > t2 THEN av - t2 ELSE n0 END AS n1 FROM p)"""


@query(f"""WITH {ALLOCATED} SELECT t1, t2, CAST(n AS BIGINT) AS n1, CAST(av - n AS BIGINT) AS n2 FROM (SELECT *, CASE
  WHEN f1 + f2 > av THEN CASE WHEN av - least(t1, av // 2) > t2 THEN av - t2 ELSE least(t1, av // 2) END WHEN n1 < f1 THEN f1 WHEN av - n1 < f2 THEN av - f2 ELSE n1 END AS n FROM q)""")
def dch_allocation(spark, sf_dir):
    t = inputs.table(spark, sf_dir, "events").select((F.col("user_id") % 97 * 3).alias("t1"), (F.col("event_id") % 89).alias("t2")).distinct()
    n1, n2 = sampling.allocation(F.col("t1"), F.col("t2"))
    return t.select("t1", "t2", n1.alias("n1"), n2.alias("n2"))


SAMPLE_POOLS = f"""{inputs.MENTION}, rows AS (SELECT CASE token WHEN 'with' THEN 1 ELSE 2 END AS pool, pmid FROM mention WHERE token IN ('with', 'que'))"""


@query(f"""WITH {SAMPLE_POOLS}, it AS (SELECT unnest(range(1, 4)) AS iteration), c AS (SELECT count(*) FILTER (WHERE pool = 1) AS t1, count(*) FILTER (WHERE pool = 2) AS t2 FROM rows),
n AS (SELECT greatest(least(CAST(round_even(t1 / (t1 + t2) * least(50, t1 + t2), 0) AS BIGINT), least(50, t1 + t2) - 3), 3) AS n1, least(50, t1 + t2) AS av FROM c)
SELECT CAST(iteration AS INT) AS iteration, CAST(pool AS INT) AS pool, pmid, draw FROM (
  SELECT iteration, pool, pmid, row_number() OVER (PARTITION BY iteration, pool ORDER BY md5(concat_ws(':', '7', CAST(iteration AS VARCHAR), CAST(pmid AS VARCHAR))), pmid) AS draw FROM rows, it), n
WHERE draw <= CASE pool WHEN 1 THEN n1 ELSE av - n1 END""")
def dch_sample(spark, sf_dir):
    mention = cooccurrence.mentions(inputs.articles(spark, sf_dir)).where(F.col("token").isin("with", "que"))
    rows = sampling.iterations(mention.select(F.when(F.col("token") == "with", 1).otherwise(2).alias("pool"), "pmid"), 3)
    return sampling.sample_pools(rows, ["iteration"], 7, F.col("iteration")).select("iteration", "pool", "pmid", F.col("draw").cast("long").alias("draw"))


@query("SELECT s_suppkey, CAST(i AS INT) AS iteration FROM supplier, (SELECT unnest(range(1, 6)) AS i)")
def iteration_cross(spark, sf_dir):
    return sampling.iterations(inputs.table(spark, sf_dir, "supplier").select("s_suppkey"), 5)


@query(f"WITH {inputs.MENTION} SELECT token, pmid // 5000 AS pool, substring(sha256(string_agg(CAST(pmid AS VARCHAR), ',' ORDER BY pmid)), 1, 8) AS fingerprint FROM mention WHERE token IN {tuple(inputs.B_TERMS)} GROUP BY ALL")
def pool_fingerprint(spark, sf_dir):
    mention = cooccurrence.mentions(inputs.articles(spark, sf_dir)).where(F.col("token").isin(inputs.B_TERMS))
    lists = relevance.regroup(mention.withColumns({"pos": F.col("pmid"), "pool": F.floor(F.col("pmid") / 5000)}), ["token", "pool"], "pmid")
    return lists.select("token", "pool", text.fingerprint(F.col("pmid").cast("array<string>")).alias("fingerprint"))


@query(f"WITH {inputs.MENTION} SELECT p.pub_year, {', '.join(f'''CAST(count(*) FILTER (WHERE token = '{t}') AS BIGINT) AS {t}''' for t in inputs.B_TERMS)} FROM (SELECT pmid, token, CAST(1975 + pmid % 50 AS INT) AS pub_year FROM mention WHERE token IN {tuple(inputs.B_TERMS)}) p GROUP BY p.pub_year")
def pivot_year_term(spark, sf_dir):
    from attestor.operators.reports import pivot_years

    rows = cooccurrence.mentions(inputs.articles(spark, sf_dir)).where(F.col("token").isin(inputs.B_TERMS))
    return pivot_years(rows.select(F.expr("CAST(1975 + pmid % 50 AS INT)").alias("pub_year"), "token", F.lit(1).cast("long").alias("n")), "pub_year", "token", "n", inputs.B_TERMS)
