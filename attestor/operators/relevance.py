"""Positions of articles in evidence lists, relevance masks, and what they sum up to."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor, wait

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestor.operators.selection import RANGE, numbered

#: Characters of an abstract that a relevance prompt holds; the hypothesis is never cut.
LONGEST_ABSTRACT = 9000


def hypothesis(template: str, **terms: Column) -> Column:
    """template with {a_term}, {b_term} and {c_term} replaced by the given columns."""
    out = F.lit(template)
    for name, value in terms.items():
        out = F.replace(out, F.lit("{" + name + "}"), value)
    return out


def hypothesis_for(kind: Column, templates: dict[str, str], **terms: Column) -> Column:
    """The rendered template of each row's kind; empty for kinds without one."""
    out = F.lit("")
    for name, template in templates.items():
        out = F.when(kind == name, hypothesis(template, **terms)).otherwise(out)
    return out


def relevance_prompt(abstract: Column, hypothesis_: Column) -> Column:
    return F.concat(F.lit("Abstract: "), F.substring(abstract, 1, LONGEST_ABSTRACT), F.lit("\nHypothesis: "), hypothesis_, F.lit("\nAnswer 1 if the abstract helps to judge the hypothesis, else 0: "))


def positions(pairs: DataFrame, lists: dict[str, str], hypotheses: dict[str, Column], keys: list[str]) -> DataFrame:
    """Rows (keys, intersection, pos, pmid, hypothesis) of every list column; an empty list keeps one row without pmid."""
    out = None
    for name, column in lists.items():
        part = pairs.select(*keys, F.lit(name).alias("intersection"), hypotheses[name].alias("hypothesis"), F.posexplode_outer(column).alias("pos", "pmid"))
        out = part if out is None else out.unionByName(part)
    return out


def with_articles(where: DataFrame, articles: DataFrame, text: str = "abstract") -> DataFrame:
    """Every position with its article's text; empty where there is no such article. Each article is used once, however often it was fetched."""
    once = articles.select("pmid", F.col(text).alias("text")).dropDuplicates(["pmid"])
    return where.join(once, "pmid", "left").withColumn("text", F.coalesce("text", F.lit("")))


#: Prompts of one call, calls at a time in a partition, seconds that the last ones may take.
PROMPTS, WORKERS, DRAIN = 64, 10, 1800.0


def classify(rows: DataFrame, model: Callable[[], Callable[[list[str]], list[str]]], prompt: str = "prompt", answer: str = "answer", size: int = PROMPTS, workers: int = 1, drain: float = DRAIN) -> DataFrame:
    """rows with the model's answer to each prompt. model() is made once a partition and gets `size` prompts a call.

    With workers, that many calls run at a time; those that are not done `drain` seconds after the last was handed in
    have failed. Prompts of a call that fails are asked one by one, and one that fails again has an empty answer. Wrong
    results hide behind empty answers, so a partition of which every prompt fails raises the last error.
    """
    schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in rows.schema.fields)}, `{answer}` string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ask, asked, lost, last = model(), 0, 0, None

        def call(prompts: list[str]) -> list[str | Exception]:
            try:
                found = list(ask(prompts))
                if len(found) != len(prompts):
                    raise ValueError(f"{len(found)} answers to {len(prompts)} prompts")
                return found
            except Exception as error:  # noqa: BLE001  whatever a provider raises
                return [x for p in prompts for x in call([p])] if len(prompts) > 1 else [error]

        pool = ThreadPoolExecutor(workers) if workers > 1 else None
        for batch in batches:
            texts = batch[prompt].tolist()
            parts = [texts[i : i + size] for i in range(0, len(texts), size)]
            if pool is None:
                found = [call(p) for p in parts]
            else:
                calls = [pool.submit(call, p) for p in parts]
                done = wait(calls, timeout=drain).done
                found = [c.result() if c in done else [TimeoutError("no answer in time")] * len(p) for c, p in zip(calls, parts, strict=True)]
            answers = [x for part in found for x in part]
            errors = [x for x in answers if isinstance(x, Exception)]
            asked, lost, last = asked + len(answers), lost + len(errors), errors[-1] if errors else last
            yield batch.assign(**{answer: ["" if isinstance(x, Exception) else x for x in answers]})
        if pool is not None:
            pool.shutdown(wait=False, cancel_futures=True)
        if last is not None and lost == asked:
            raise last

    return rows.mapInPandas(run, schema)


def mask(answer: Column) -> Column:
    """1 for an answer that is a literal equal to 1, otherwise 0."""
    return F.when(F.trim(answer).isin("1", "True", "1.0"), 1).otherwise(0)


def debug_mask(answer: Column) -> tuple[Column, Column]:
    """The mask by an answer's first character, and the rationale that follows it."""
    clean = F.trim(answer)
    return mask(F.substring(clean, 1, 1)), F.substr(clean, F.lit(2))


def kept(rows: DataFrame, flag: str = "mask") -> DataFrame:
    return rows.where(F.col(flag) == 1)


def regroup(rows: DataFrame, keys: list[str], value: str, pos: str = "pos") -> DataFrame:
    """Values of each key as a list in order of position, which is part of the rows and survives any shuffle."""
    ordered = F.array_sort(F.collect_list(F.struct(pos, value)))
    return rows.groupBy(*keys).agg(F.transform(ordered, lambda x: x[value]).alias(value))


def relevance_ratio(rows: DataFrame, keys: list[str], flag: str = "mask") -> DataFrame:
    """ratio, fraction "k/n", relevant, total and filtered of each key; a key whose rows have no article gives 0 and "0/0"."""
    n, k = F.count("pmid"), F.coalesce(F.sum(F.when(F.col("pmid").isNotNull(), F.col(flag))), F.lit(0))
    summed = rows.groupBy(*keys).agg(k.cast("long").alias("relevant"), n.alias("total"))
    ratio = F.coalesce(F.col("relevant") / F.nullif("total", F.lit(0)), F.lit(0.0))
    return summed.withColumns({"ratio": ratio, "fraction": F.concat(F.col("relevant").cast("string"), F.lit("/"), F.col("total").cast("string")), "filtered": F.col("total") - F.col("relevant")})


def flags_to_list(flags: Column, values: Column) -> Column:
    """Values whose flag at the same place is 1."""
    return F.transform(F.filter(F.arrays_zip(flags.alias("f"), values.alias("v")), lambda x: x["f"] == 1), lambda x: x["v"])


def position_in(rows: DataFrame, keys: list[str], by: str = "pmid") -> DataFrame:
    """rows with pos, their place from 0 on within each key in order of a whole number; no task holds a key."""
    return numbered(rows, keys, [F.floor(F.col(by) / RANGE)], [F.col(by)], "pos").withColumn("pos", F.col("pos") - 1)
