"""Judge prompts, verdict payloads: their schemas, checks, tallies and scores."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from attestor.sources.providers import Failed, Refused, retried

#: Names of labels and tallies in payloads.
LABELS_COMPARISON = {"support_H1": ("supports_H1",), "support_H2": ("supports_H2",), "both": ("both",), "neither_or_inconclusive": ("neither", "inconclusive")}
LABELS_SINGLE = {"support": ("supports",), "refute": ("refutes",), "inconclusive": ("inconclusive",)}
DECISIONS_COMPARISON = ("H1", "H2", "tie", "insufficient_evidence")
DECISIONS_SINGLE = ("supports", "refutes", "insufficient_evidence")

PER_ABSTRACT = "array<struct<pmid: string, evidence: array<string>, label: string>>"


def payload_schema(kind: str) -> str:
    """kind: comparison, single or chain."""
    if kind == "chain":
        return "score_rationale array<string>, score double, decision string"
    tallies = ", ".join(f"{name}: int" for name in (LABELS_COMPARISON if kind == "comparison" else LABELS_SINGLE))
    return f"per_abstract {PER_ABSTRACT}, score_rationale array<string>, tallies struct<{tallies}>, score double, decision string"


def payload(text: Column, kind: str) -> Column:
    return F.from_json(text, payload_schema(kind), {"mode": "PERMISSIVE"})


def tally(per_abstract: Column, labels: tuple[str, ...]) -> Column:
    return F.size(F.filter(F.coalesce(per_abstract, F.array().cast(PER_ABSTRACT)), lambda x: x["label"].isin(*labels)))


def problems(p: Column, kind: str, expected: Column | None = None) -> Column:
    """Names of what is wrong with a payload, in order; empty for a payload to accept."""
    checks: list[tuple[Column, str]] = [(p[name].isNull(), name) for name in ("score_rationale", "score", "decision")]
    if kind != "chain":
        names = LABELS_COMPARISON if kind == "comparison" else LABELS_SINGLE
        checks.insert(0, (p["per_abstract"].isNull(), "per_abstract"))
        if expected is not None:
            checks.append((F.size(p["per_abstract"]) != expected, "per_abstract length"))
        for name, labels in names.items():
            checks.append((p["tallies"][name].isNull(), f"tallies.{name}"))
            if kind == "comparison":
                checks.append((p["tallies"][name] != tally(p["per_abstract"], labels), name))
    return F.array_compact(F.array(*[F.when(bad, F.lit(name)) for bad, name in checks]))


def tally_warnings(p: Column) -> Column:
    """Tallies of a single hypothesis that its labels do not bear out; such payloads are accepted all the same."""
    return F.array_compact(F.array(*[F.when(p["tallies"][name] != tally(p["per_abstract"], labels), F.lit(name)) for name, labels in LABELS_SINGLE.items()]))


def expected_count(prompt: Column) -> Column:
    """How many identifiers a prompt lists as available."""
    line = F.regexp_extract(prompt, r"Available PMIDs: ([^\n]*)", 1)
    return F.size(F.regexp_extract_all(line, F.lit(r"(\d+)"), F.lit(1)))


def judge_prompt(hypotheses: list[Column], pool: Column, ids: Column, scale: str) -> Column:
    """A judge's request: the hypotheses, the identifiers it may cite, the score's scale and the evidence."""
    numbered = [part for i, h in enumerate(hypotheses, 1) for part in (F.lit(f"Hypothesis {i}: "), h, F.lit("\n"))]
    known = F.coalesce(F.nullif(F.array_join(ids, ", "), F.lit("")), F.lit("None found"))
    return F.concat(*numbered, F.lit("Available PMIDs: "), known, F.lit(f"\nScale: {scale}\n\n"), pool)


#: The range of scores by kind of question.
SCALES = {"comparison": "0 to 100, above 50 for hypothesis 1", "single": "-2 to 2", "chain": "-2 to 2", "continuous": "-100 to 100"}
INSTRUCTIONS = {
    "comparison": "Label each abstract supports_H1, supports_H2, both, neither or inconclusive, tally the labels, then score.",
    "single": "Label each abstract supports, refutes or inconclusive, tally the labels, then score.",
    "chain": "Judge the path from the first term through the second to the third as a whole, then score.",
}


def chain_pool(ab_text: Column, bc_text: Column) -> Column:
    """The pool of a chain question, its two parts under headings."""
    return F.concat(F.lit("Evidence for A and B:\n"), ab_text, F.lit("\nEvidence for B and C:\n"), bc_text)


def tally_judge(h1: Column, h2: Column) -> Column:
    """The offline stand-in for a model: 50 + 50 (h1 - h2) / (h1 + h2), null without evidence."""
    return 50 + 50 * (h1 - h2) / F.nullif(h1 + h2, F.lit(0))


def judged(rows: DataFrame, model: Callable[[], Callable[[str], str]], retries: int = 3, prompt: str = "prompt", answer: str = "payload", delay: float = 0.0, factor: float | None = None, workers: int = 1) -> DataFrame:
    """rows with the model's answer. model() is made once a partition; each call is tried `retries` times, `delay` seconds
    apart, or ever longer by `factor`; then the answer is null. `workers` calls run at a time. After a Refused a partition
    asks nothing more, beyond calls that are on their way.

    A task that is lost repeats its calls: write the result before it is used twice.
    """
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ask, refused = model(), False

        def tried(text: str) -> str | None:
            nonlocal refused
            if refused:
                return None
            try:
                return retried(lambda: ask(text), retries, delay, factor, final=(Refused, Failed, StopIteration))
            except Refused:
                refused = True
            except Exception:  # noqa: BLE001  whatever a provider raises
                pass
            return None

        with ThreadPoolExecutor(workers) as pool:
            for batch in batches:
                answers = list(pool.map(tried, batch[prompt])) if workers > 1 else [tried(t) for t in batch[prompt]]
                yield batch.assign(**{answer: answers})

    return rows.mapInPandas(run, f"{fields}, `{answer}` string")


def scores_single(records: DataFrame, p: str = "payload") -> DataFrame:
    """hypothesis, score and the three tallies of each record; a record without score keeps a null."""
    t = F.col(p)["tallies"]
    return records.select(*[c for c in records.columns if c != p], F.col(p)["score"].alias("score"), *[F.coalesce(t[name], F.lit(0)).alias(name) for name in LABELS_SINGLE])


def scores_comparison(records: DataFrame, p: str = "payload") -> DataFrame:
    t = F.col(p)["tallies"]
    return records.select(*[c for c in records.columns if c != p], F.col(p)["score"].alias("score"), F.col(p)["decision"].alias("decision"), *[F.coalesce(t[name], F.lit(0)).alias(name) for name in LABELS_COMPARISON])


RECORD = T.StructType([T.StructField("hypothesis", T.StringType()), T.StructField("iteration", T.IntegerType()), T.StructField("payload", T.StringType())])
