"""Calls to a provider outside: a pace, attempts, and an end after failures in a row."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from urllib.request import Request, urlopen

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ragaloom.operators.skew import attach


class Busy(RuntimeError):
    """The provider asks for a pause; the call is tried again."""


class Stopped(RuntimeError):
    """Too many calls failed in a row; no more are made."""


class Paced:
    """A provider with a pause after each call, attempts after ``Busy`` with growing pauses, and an end after failures in a row.

    Other errors are failures at once, and so are empty answers, which give None. The defaults are fixed values.
    """

    def __init__(self, provider: Callable[[str], str | None], pause: float = 7.0, attempts: int = 3, backoff: float = 25.0, most_failures: int = 5, sleep: Callable[[float], None] = time.sleep) -> None:
        self.provider, self.pause, self.attempts, self.backoff, self.most_failures, self.sleep = provider, pause, attempts, backoff, most_failures, sleep
        self.failures = 0

    def __call__(self, prompt: str) -> str | None:
        if self.failures >= self.most_failures:
            raise Stopped(f"{self.failures} calls failed in a row")
        answer, error = None, None
        for attempt in range(1, self.attempts + 1):
            try:
                answer, error = self.provider(prompt), None
                break
            except Busy as e:
                error = e
                self.sleep(self.backoff * attempt)
            except Exception as e:  # noqa: BLE001
                error = e
                break
        self.failures = 0 if answer else self.failures + 1
        self.sleep(self.pause)
        if error is not None:
            raise error
        return answer or None


def generated(entries: DataFrame, held: DataFrame, paced: Callable[[], Paced], force: bool = False) -> DataFrame:
    """(composition_id, meaning, outcome) of ``entries`` (composition_id, prompt): ``stored`` ones of ``held``
    (composition_id, meaning), ``made`` ones, ``failed`` ones, and those ``left`` after too many failures in a row.

    The calls share one pace, so one task makes them all, in the order of the ids, a row at a time; the others are
    joined as usual. '' counts as no meaning; with ``force`` nothing stored is used. ``paced`` makes the provider in
    that task.
    """
    stored = F.lit(None).cast("string") if force else F.expr("nullif(stored, '')")
    known = attach(entries.select("composition_id", "prompt"), held.select("composition_id", F.col("meaning").alias("stored")), ["composition_id"]).withColumn("stored", stored)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        provider = paced()
        for batch in batches:
            rows = []
            for r in batch.itertuples():
                try:
                    answer = provider(r.prompt)
                    rows.append((r.composition_id, answer, "made" if answer else "failed"))
                except Stopped:
                    rows.append((r.composition_id, None, "left"))
                except Exception:  # noqa: BLE001
                    rows.append((r.composition_id, None, "failed"))
            yield pd.DataFrame(rows, columns=["composition_id", "meaning", "outcome"])

    asked = known.filter("stored is null").select("composition_id", "prompt").repartition(1).sortWithinPartitions("composition_id")
    made = asked.mapInPandas(run, "composition_id string, meaning string, outcome string")
    return known.filter("stored is not null").select("composition_id", F.col("stored").alias("meaning"), F.lit("stored").alias("outcome")).unionByName(made)


def fetched(urls: DataFrame, agent: str, timeout: float = 30.0, pause: float = 1.0, opener: Callable[[Request, float], bytes] | None = None, sleep: Callable[[float], None] = time.sleep) -> DataFrame:
    """(url, html) of distinct ``urls`` (one column), null where a page can't be had. One task fetches, with a pause after each.

    ``opener`` takes a request and the seconds to wait, and gives the page's bytes; by default it is that of the
    standard library. A page that isn't UTF-8 is read as Latin-1.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        get = opener or (lambda request, wait: urlopen(request, timeout=wait).read())
        for batch in batches:
            rows = []
            for url in batch["url"]:
                try:
                    data = get(Request(url, headers={"User-Agent": agent}), timeout)
                    try:
                        html = data.decode()
                    except UnicodeDecodeError:
                        html = data.decode("latin-1")
                except Exception:  # noqa: BLE001
                    html = None
                rows.append((url, html))
                sleep(pause)
            yield pd.DataFrame(rows, columns=["url", "html"])

    return urls.toDF("url").dropna().distinct().repartition(1).sortWithinPartitions("url").mapInPandas(run, "url string, html string")
