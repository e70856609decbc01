"""Search, fetch and extraction services as functions over partitions of rows.

A connector is called only for rows that the cache misses. Each gets a client
factory, so that a task opens a client of its own; tests and offline runs give one
that reads fixtures. Failures are rows with a status, never silent gaps.
"""

from __future__ import annotations

import threading
import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions import text as T
from millrace.functions.text import blocked, main_text

#: Results that a keyed search gives at most for one call.
MOST_RESULTS = 20
RESULTS = "array<struct<url:string,title:string,snippet:string>>"


class RateLimited(Exception):
    """The service asks for a pause of so many seconds."""

    def __init__(self, seconds: float = 60.0):
        super().__init__(f"wait {seconds} s")
        self.seconds = seconds


class QuotaSpent(Exception):
    """The service takes no more calls."""


class Clock:
    """The time that pace and pauses go by."""

    def now(self) -> float:
        return time.monotonic()

    def sleep(self, seconds: float) -> None:
        time.sleep(seconds)


class Caller:
    """Calls of one task: starts are `gap` apart, a limit closes the service for a time, a spent quota for good."""

    def __init__(self, call: Callable[[str], str | None], gap: float, clock: Clock):
        self.call, self.gap, self.clock = call, gap, clock
        self.next_start = self.open_again = float("-inf")
        self.spent = False
        self.lock = threading.Lock()

    def _closed(self) -> str | None:
        """Waits for the next start; the status of a service that takes no calls."""
        with self.lock:
            if self.spent:
                return "quota"
            if self.clock.now() < self.open_again:
                return "limited"
            self.clock.sleep(max(0.0, self.next_start - self.clock.now()))
            self.next_start = self.clock.now() + self.gap
            return None

    def __call__(self, value: str) -> tuple[str | None, str]:
        if state := self._closed():
            return None, state
        try:
            reply = self.call(value)
            return reply, "ok" if reply else "empty"
        except QuotaSpent:
            self.spent = True
            return None, "quota"
        except RateLimited as limit:
            with self.lock:
                self.open_again = max(self.open_again, self.clock.now() + limit.seconds)
            return None, "limited"
        except Exception:  # a service's own failure is a row's status
            return None, "failed"


def call_service(
    rows: DataFrame, column: str, client: Callable[[], Callable[[str], str | None]], gap: float = 0.0, partitions: int | None = None,
    at_once: int = 1, clock: Callable[[], Clock] = Clock,
) -> DataFrame:
    """Adds `reply` and `status` (ok, empty, limited, quota, failed) of a call with each row's column.

    `gap` is the least time between the starts of two calls of a task, `at_once` how many of them are open at most; rows keep their
    order, and a batch is answered before the next is read. One partition keeps one pace for a whole service (`streaming.gate`
    keeps it over partitions). After a spent quota no more calls are made. A client that is called at once must bear it.
    """
    fields = ", ".join(f"`{n}` {t}" for n, t in rows.dtypes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        caller = Caller(client(), gap, clock())
        with ThreadPoolExecutor(at_once) as pool:
            for batch in batches:
                answers = list(pool.map(caller, batch[column]))
                yield batch.assign(reply=[a[0] for a in answers], status=[a[1] for a in answers])

    spread = rows.repartition(partitions) if partitions else rows
    return spread.mapInPandas(run, f"{fields}, reply string, status string")


def keyed_search(query: Column, locale: Column, most: int = 10) -> Column:
    """The parameters of a call of a keyed search service."""
    language = F.when(F.length(locale) == 2, locale).otherwise("en")
    count = F.lit(str(min(most, MOST_RESULTS)))
    return F.create_map(F.lit("q"), query, F.lit("count"), count, F.lit("country"), T.api_country(locale), F.lit("search_lang"), language)


def hosted_search(query: Column, locale: Column) -> Column:
    """The parameters of a call of a self-hosted search service."""
    return F.create_map(F.lit("q"), query, F.lit("format"), F.lit("json"), F.lit("language"), T.api_language(locale), F.lit("pageno"), F.lit("1"))


def search_status(code: Column) -> Column:
    """What an answer's code means: a spent quota (402 and 429), failed (400 and above, or no answer), or ok."""
    return F.when(code.isin(402, 429), "quota").when(F.coalesce(code >= 400, F.lit(True)), "failed").otherwise("ok")


def search_results(replies: DataFrame, path: str, snippet: str, most: int = 10) -> DataFrame:
    """A row for each result of JSON replies (`reply`), numbered from 0, the first `most`; unreadable replies give none.

    `path` says where the list lies (`$.web.results` or `$.results`), `snippet` what the text is called there.
    """
    schema = f"array<struct<url:string,title:string,{snippet}:string>>"
    items = F.slice(F.from_json(F.get_json_object("reply", path), schema), 1, most)
    rows = replies.select(*[c for c in replies.columns if c != "reply"], F.posexplode(items).alias("rank", "x"))
    blank = lambda c: F.coalesce(c, F.lit(""))
    kept = [c for c in replies.columns if c != "reply"]
    return rows.select(*kept, "rank", blank(F.col("x.url")).alias("url"), blank(F.col("x.title")).alias("title"), blank(F.col(f"x.{snippet}")).alias("snippet"))


def first_urls(rows: DataFrame, by: list[str], order: str, most: int = 5) -> DataFrame:
    """The first pages of each pair that are worth fetching."""
    place = F.row_number().over(Window.partitionBy(*by).orderBy(order))
    return rows.withColumn("_place", place).where(F.col("_place") <= most).drop("_place")


def fetch_many(rows: DataFrame, client: Callable, blocked_domains: list[str], by: list[str], order: str, most: int = 5, **options) -> DataFrame:
    """(…, url, text): the first `most` URLs of each pair fetched, of which those with text stay.

    The client gives a page's HTML, or null for errors and other kinds of content; hosts that are blocked are not called.
    """
    wanted = first_urls(rows, by, order, most).where(~blocked(F.col("url"), blocked_domains))
    pages = call_service(wanted, "url", client, **options)
    return pages.withColumn("text", main_text(F.col("reply"))).where("text IS NOT NULL").drop("reply", "status")


def with_fallback(rows: DataFrame, column: str, first: Callable, second: Callable, **options) -> DataFrame:
    """The first service's replies, and the second's for the rows that the first did not take."""
    tried = call_service(rows, column, first, **options)
    again = tried.where("status NOT IN ('ok', 'empty')").drop("reply", "status")
    return tried.where("status IN ('ok', 'empty')").unionByName(call_service(again, column, second, **options))


def usable_pages(pages: DataFrame, blocked_domains: list[str], least: int = 100) -> DataFrame:
    """The text and status of fetched pages beside their other columns: refused hosts, errors, other kinds and short texts are told apart."""
    text = main_text(F.col("html"), least)
    status = (
        F.when(blocked(F.col("url"), blocked_domains), "blocked")
        .when(F.coalesce(F.col("status") >= 400, F.lit(True)), "error")
        .when(~F.coalesce(F.contains("content_type", F.lit("text/html")), F.lit(False)), "not_html")
        .when(text.isNull(), "short")
        .otherwise("ok")
    )
    kept = [c for c in pages.columns if c not in ("status", "content_type", "html")]
    return pages.select(*kept, F.when(status == "ok", text).alias("text"), status.alias("status"))
