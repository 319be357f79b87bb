"""From relevant articles to questions for a judge: evidence put in order, questions by kind of job, pools of text."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attestor.config import Job
from attestor.functions import text
from attestor.functions.terms import display
from attestor.operators import judging, relevance, sampling, selection

#: Fixed value: tokens of all evidence lists of a row together.
BUDGET = 110_000_000
#: The lists of evidence that each kind of question needs.
LISTS = {"A_B": ("ab",), "A_B_C": ("ab", "bc"), "A_C": ("ac",), "comparison": ("ab",)}
SCALE = {"A_B": "single", "A_C": "single", "A_B_C": "chain", "comparison": "comparison"}


def prepared(rows: DataFrame, keys: list[str], job: Job, *, lists: int = 1, budget: int = BUDGET, tokens: Column | None = None) -> DataFrame:
    """The evidence of rows (keys, intersection, pos, pmid, text, pub_year, mask): relevant articles only, cut to the budget,
    then cited and recent ones in turn, post_n at most, with their new pos. A post_n of 0 neither orders nor cuts.

    A list holds at most the articles that were selected for it, top_cited + top_recent, so its ids fit an array.
    """
    own = [*keys, "intersection"]
    cut = selection.within_budget(relevance.kept(rows), own, F.floor(F.length("text") / 4) if tokens is None else tokens, budget, lists)
    if not job.post_n:
        return cut.drop("running_tokens")
    year = F.coalesce("pub_year", F.lit(0))
    ordered = cut.groupBy(*own).agg(F.array_sort(F.collect_list(F.struct("pos", "pmid"))).alias("cited"), F.array_sort(F.collect_list(F.struct((-year).alias("late"), "pos", "pmid"))).alias("recent"))
    ids = lambda c: F.transform(c, lambda x: x["pmid"])
    merged = selection.interleave(ids("cited"), ids("recent"), selection.interleave_ratio(job.top_cited, job.top_recent), job.post_n)
    places = ordered.select(*own, F.posexplode(merged).alias("pos", "pmid"))
    once = selection.first_of(cut.drop("running_tokens"), [*own, "pmid"], [F.col("pos")])
    return once.drop("pos").join(places, [*own, "pmid"])


def questions(rows: DataFrame, job: Job) -> DataFrame:
    """(row_id, relation, label, hypothesis1, hypothesis2) for rows (row_id, a_term, b_term and, in chains, c_term).

    Pairs ask for A and B, chains for the path and for A and C, a comparison for both of its B terms at once, in a
    single question; rows that lack a term that they need ask nothing.
    """
    shown = {c: display(F.col(c)) for c in ("a_term", "b_term", "c_term") if c in rows.columns}
    there = lambda *terms: F.array_min(F.transform(F.array(*[shown[t] for t in terms]), lambda x: x != ""))
    none = F.lit(None).cast("string")

    def ask(relation: str, template: str, *terms: str) -> Column:
        return F.when(there(*terms), F.struct(F.lit(relation).alias("relation"), F.concat_ws(" - ", *[shown[t] for t in terms]).alias("label"), relevance.hypothesis(job.hypotheses[template], **{t: shown[t] for t in terms}).alias("hypothesis1"), none.alias("hypothesis2")))

    if job.comparison:
        first, second = (F.max(F.when(F.col("b_term") == b, relevance.hypothesis(job.hypotheses["ab"], **shown))) for b in job.b_terms)
        both = rows.groupBy("a_term").agg(F.min("row_id").alias("row_id"), first.alias("hypothesis1"), second.alias("hypothesis2")).where("hypothesis1 IS NOT NULL AND hypothesis2 IS NOT NULL")
        return both.select("row_id", F.lit("comparison").alias("relation"), F.concat_ws(" vs ", F.lit(job.b_terms[0]), F.lit(job.b_terms[1])).alias("label"), "hypothesis1", "hypothesis2")
    asked = [ask("A_B_C", "abc" if "abc" in job.hypotheses else "ab", "a_term", "b_term", "c_term"), ask("A_C", "ac", "a_term", "c_term")] if job.kind == "chains" else [ask("A_B", "ab", "a_term", "b_term")]
    return rows.select("row_id", F.inline(F.array_compact(F.array(*asked))))


def pools(asked: DataFrame, evidence: DataFrame) -> DataFrame:
    """asked with pool, ids, expected and status for evidence (row_id, intersection, pos, pmid, text).

    The articles of each list follow one another by pos, and a chain's two lists stand under headings. A question that
    lacks one of its lists has the status N/A, and no pool: it is never sent to a judge.
    """
    one = F.array_sort(F.collect_list(F.struct("pos", F.col("pmid").cast("string").alias("pmid"), F.coalesce("text", F.lit("")).alias("text"))))
    lists = evidence.groupBy("row_id", "intersection").agg(one.alias("all"))
    wide = lists.groupBy("row_id").agg(*[F.max(F.when(F.col("intersection") == name, F.col("all"))).alias(name) for name in ("ab", "bc", "ac")])
    joined = asked.join(wide, "row_id", "left")
    body = lambda c: text.join_entries(F.transform(c, lambda x: x["text"]))
    ids = lambda c: F.transform(c, lambda x: x["pmid"])
    pool, listed = F.lit(None).cast("string"), F.lit(None).cast("array<string>")
    for relation, names in LISTS.items():
        cols = [F.col(n) for n in names]
        whole = judging.chain_pool(body(cols[0]), body(cols[1])) if len(names) > 1 else body(cols[0])
        here = (F.col("relation") == relation) & ~F.greatest(F.lit(False), *[c.isNull() for c in cols])
        pool, listed = F.when(here, whole).otherwise(pool), F.when(here, F.concat(*[ids(c) for c in cols])).otherwise(listed)
    out = joined.select(*asked.columns, pool.alias("pool"), listed.alias("ids"))
    return out.withColumns({"expected": F.coalesce(F.size("ids"), F.lit(0)), "status": F.when(F.col("pool").isNull(), "N/A").otherwise("ask")})


def prompts(assembled: DataFrame) -> DataFrame:
    """The questions to send, with their prompt, which lists the ids that an answer may cite."""
    prompt = F.lit(None).cast("string")
    for relation, kind in SCALE.items():
        hypotheses = [F.col("hypothesis1"), F.col("hypothesis2")] if relation == "comparison" else [F.col("hypothesis1")]
        prompt = F.when(F.col("relation") == relation, F.concat(F.lit(judging.INSTRUCTIONS[kind] + "\n"), judging.judge_prompt(hypotheses, F.col("pool"), F.col("ids"), judging.SCALES[kind]))).otherwise(prompt)
    return assembled.where("status = 'ask'").withColumn("prompt", prompt)


def run_job(rows: DataFrame, evidence: DataFrame, job: Job, model, **options) -> DataFrame:
    """A verdict for each question of a job: payload, its problems and its score; N/A questions have neither.

    model is judging.judged's; the answers' rows are one for each question and iteration.
    """
    assembled = pools(questions(rows, job), evidence)
    answered = judging.judged(sampling.iterations(prompts(assembled), job.iterations if job.iterations > 1 else 0), model, **options)
    out = None
    for kind in dict.fromkeys(SCALE.values()):
        relations = [r for r, k in SCALE.items() if k == kind]
        part = answered.where(F.col("relation").isin(relations)).withColumn("_p", judging.payload(F.col("payload"), kind))
        wrong = F.when(F.col("payload").isNull(), F.array(F.lit("no answer"))).otherwise(judging.problems(F.col("_p"), kind, None if kind == "chain" else F.col("expected")))
        part = part.withColumns({"problems": wrong, "score": F.when(F.size(wrong) == 0, F.col("_p")["score"])}).drop("_p")
        out = part if out is None else out.unionByName(part)
    skipped = assembled.where("status = 'N/A'").withColumns({"prompt": F.lit(None).cast("string"), "iteration": F.lit(None).cast("int"), "payload": F.lit(None).cast("string"), "problems": F.array().cast("array<string>"), "score": F.lit(None).cast("double")})
    return out.unionByName(skipped)


def sampled_pools(rows: DataFrame, keys: list[str], seed: int, iterations: object, fixed: bool = False, floor: float = sampling.FLOOR, target: int = sampling.TARGET) -> DataFrame:
    """(keys, iteration, sampled, total, text): two pools (pool, pos, pmid, text) without repeats, sampled for each iteration.

    fixed draws once, as iteration 1 does, and gives every iteration that sample. The entries follow by pool and draw;
    a sample holds at most `target` of them, so its text is one value.
    """
    clean = selection.dedup_pools(rows, keys)
    totals = clean.groupBy(*keys).agg(F.count("*").alias("total"))
    repeated = clean.withColumn("iteration", F.lit(1)) if fixed else sampling.iterations(clean, iterations)
    drawn = sampling.sample_pools(repeated, [*keys, "iteration"], seed, F.coalesce("iteration", F.lit(0)), floor, target)
    entries = F.array_sort(F.collect_list(F.struct("pool", "draw", F.coalesce("text", F.lit("")).alias("text"))))
    out = drawn.groupBy(*keys, F.col("iteration")).agg(F.count("*").alias("sampled"), text.join_entries(F.transform(entries, lambda x: x["text"])).alias("text")).join(totals, keys)
    return sampling.iterations(out.drop("iteration"), iterations) if fixed else out


def pair_id(index: Column, one: Column, two: Column) -> Column:
    """The name of a comparison: its number and its terms."""
    return F.format_string("pair%02d_%s_vs_%s", index, one, two)


def nonempty(rows: DataFrame, job: Job) -> DataFrame:
    """Rows with evidence: of pairs those with articles of A and B, of chains those with A and B or B and C; a comparison keeps all."""
    some = lambda c: F.coalesce(F.size(c), F.lit(0)) > 0
    if job.comparison:
        return rows
    return rows.where(some("ab_pmids") | some("bc_pmids") if job.kind == "chains" else some("ab_pmids"))


def previous_year(rows: DataFrame, keys: list[str], year: str, values: list[str]) -> DataFrame:
    """rows with prior_<value>, those of the same key in the year that comes before among all years of the table; 0 where it has none.

    There are as many years as the table has, so the list of them is one small row.
    """
    years = rows.groupBy().agg(F.array_sort(F.collect_set(year)).alias("_years"))
    at = F.array_position("_years", F.col(year))
    dated = rows.crossJoin(F.broadcast(years)).withColumn("_before", F.when(at > 1, F.element_at("_years", F.greatest(at.cast("int") - 1, F.lit(1))))).drop("_years")
    earlier = rows.select(*keys, F.col(year).alias("_before"), *[F.col(v).alias(f"prior_{v}") for v in values])
    return dated.join(earlier, [*keys, "_before"], "left").drop("_before").na.fill(0, [f"prior_{v}" for v in values])


def distinct_rationales(payloads: DataFrame, keys: list[str], pos: str = "pos") -> DataFrame:
    """Of each key the distinct sentences of its verdicts, in order; the verdicts of a pair are as many as its iterations."""
    in_order = F.array_sort(F.collect_list(F.struct(pos, "score_rationale")))
    return payloads.groupBy(*keys).agg(F.array_distinct(F.flatten(F.transform(in_order, lambda x: x["score_rationale"]))).alias("rationales"))


def status_counts(rows: DataFrame, status: str = "status") -> DataFrame:
    return rows.groupBy(status).agg(F.count("*").alias("n"))


def listed_total(rows: DataFrame, *lists: str) -> DataFrame:
    """How many articles the lists of all rows name, repeats included, and how many different ones."""
    every = F.flatten(F.array(*[F.coalesce(F.col(c), F.array().cast("array<bigint>")) for c in lists]))
    return rows.select(F.explode(every).alias("pmid")).agg(F.count("*").alias("listed"), F.count_distinct("pmid").alias("distinct_listed"))


def estimator(job: Job) -> tuple[str, ...]:
    """The lists whose articles a job pays for."""
    return ("ab", "bc", "ac") if job.kind == "chains" else ("ab",)


def break_points(rows: DataFrame, order: list[str]) -> DataFrame:
    """(intersection, n, start): where each list begins when the lists of all rows follow one another in the given order."""
    place = F.array_position(F.array(*map(F.lit, order)), F.col("intersection"))
    sizes = rows.groupBy("intersection").agg(F.count("pmid").alias("n")).withColumn("_place", place)
    before = F.coalesce(F.sum("n").over(Window.orderBy("_place").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # as many rows as there are kinds of lists
    return sizes.select("intersection", "n", before.alias("start"))


def pair_job(job: Job, one: str, two: str) -> Job:
    """The comparison of two B terms that a competition sets up from its job; the first one's hypothesis is H1."""
    return replace(job, kind="pairs", comparison=True, position=False, b_terms=(one, two), c_terms=())
