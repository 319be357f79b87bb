"""Remote services behind plain callables: retries by status, batches with pacing, jobs that are polled.

A transport is a callable that a partition makes for itself; what is tested is everything but the wire.
"""

from __future__ import annotations

import time
import xml.etree.ElementTree as ET
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Statuses that are worth another try, the one that ends a run, articles in a request, seconds between requests.
AGAIN, REFUSED = (429, 502, 503, 504), 402
FETCHED_AT_ONCE, PACE = 200, 0.34


class Refused(Exception):
    """The service will answer nobody any more: no further call is made."""


class Failed(Exception):
    """An answer with a status that no other try will change."""


def retried(call: Callable[[], object], retries: int = 3, delay: float = 1.0, factor: float | None = None, final: tuple[type[Exception], ...] = (Refused, Failed), sleep: Callable[[float], None] = time.sleep):
    """The result of call(), tried `retries` times, with a constant delay or one that grows by `factor`; the last error is raised, a final one at once."""
    for attempt in range(retries):
        try:
            return call()
        except final:
            raise
        except Exception:
            if attempt + 1 == retries:
                raise
            sleep(delay * (factor**attempt if factor else 1))
    raise ValueError("at least one try is needed")


def client(post: Callable[[object], tuple[int, str]], **options) -> Callable[[object], str]:
    """post(payload) -> (status, body) as a call that returns the body of status 200, tries again after AGAIN, and gives up after others."""

    def once(payload: object) -> str:
        status, body = post(payload)
        if status == REFUSED:
            raise Refused(body)
        if status in AGAIN:
            raise ConnectionError(f"status {status}")
        if status != 200:
            raise Failed(f"status {status}: {body}")
        return body

    return lambda payload: retried(lambda: once(payload), **options)


def wait_for(submit: Callable[[], str], ask: Callable[[str], tuple[str, object]], every: float = 5.0, sleep: Callable[[float], None] = time.sleep) -> object:
    """The result of a remote job: finished gives it, failed is an AssertionError, queued and started wait, any other status is a ValueError.
    Requests that fail on the way are repeated without end."""

    def sure(call: Callable):
        while True:
            try:
                return call()
            except OSError:
                sleep(every)

    job = sure(submit)
    while True:
        status, result = sure(lambda: ask(job))
        if status == "finished":
            return result
        if status == "failed":
            raise AssertionError(f"job {job} failed")
        if status not in ("queued", "started"):
            raise ValueError(f"job {job} is {status!r}")
        sleep(every)


ARTICLE = "pmid long, title string, sections array<string>, article_year string, pubdate_year string, medline_date string, completed_year string"


def parse_articles(xml: str) -> list[dict]:
    """Articles of a fetch's answer; one that cannot be read is left out."""
    out = []
    for a in ET.fromstring(xml).iter("PubmedArticle"):
        text = lambda path: next(("".join(e.itertext()).strip() for e in a.findall(path)), None)  # noqa: B023, E731
        pmid = text(".//MedlineCitation/PMID") or text(".//PMID")
        if pmid and pmid.isdigit():
            sections = ["".join(e.itertext()).strip() for e in a.findall(".//Abstract/AbstractText")]
            out.append({"pmid": int(pmid), "title": text(".//ArticleTitle"), "sections": sections, "article_year": text(".//ArticleDate/Year"), "pubdate_year": text(".//JournalIssue/PubDate/Year"), "medline_date": text(".//PubDate/MedlineDate"), "completed_year": text(".//DateCompleted/Year")})
    return out


def fetched(wanted: DataFrame, fetch: Callable[[], Callable[[list[int]], str]], size: int = FETCHED_AT_ONCE, pace: float = PACE, partitions: int = 1, **options) -> DataFrame:
    """Articles (ARTICLE) of wanted(pmid), each asked for once, `size` to a request, `pace` seconds apart in each of the partitions.

    The service's limit holds for all partitions together, so there is one by default. A request whose tries all fail is
    skipped, and its articles are missing; if all requests of a partition fail, the last error is raised.
    """
    fields = [x.split()[0] for x in ARTICLE.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ask, sent, lost, last, held = fetch(), 0, 0, None, []

        def request(ids: list[int]) -> list[dict]:
            nonlocal sent, lost, last
            if sent:
                time.sleep(pace)
            sent += 1
            try:
                return parse_articles(retried(lambda: ask(ids), **options))
            except Refused:
                raise
            except Exception as error:  # noqa: BLE001  whatever a provider raises
                lost, last = lost + 1, error
                return []

        for batch in batches:
            held += batch["pmid"].tolist()
            while len(held) >= size:
                yield pd.DataFrame(request(held[:size]), columns=fields)
                held = held[size:]
        if held:
            yield pd.DataFrame(request(held), columns=fields)
        if last is not None and lost == sent:
            raise last

    ids = wanted.select(F.col("pmid").cast("long").alias("pmid")).where("pmid IS NOT NULL").distinct()
    return ids.repartitionByRange(partitions, "pmid").sortWithinPartitions("pmid").mapInPandas(run, ARTICLE)
