"""A data source for published tables: `spark.read.format("published")`, one partition a locator.

Options: `locators`, a JSON object of locator to URL; `attempts` and `waits` (seconds before each further attempt,
comma-joined); `fallback`, a JSON object of locator to URL that is read when the first one fails. Each row is a line:
locator, n, line, source ("first" or "fallback"). An HTML answer where a table is due (`html` isn't "true") counts as a
failure; when all attempts and the fallback fail, the locator gives one row with the reason in `error`, so that one dead
source doesn't stop the others. URLs may be http(s) or file.
"""

from __future__ import annotations

import json
import time
import urllib.request
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "locator string, n int, line string, source string, error string"


@dataclass
class Locator(InputPartition):
    name: str
    url: str
    fallback: str | None


def got(url: str, html: bool, timeout: float = 60) -> str:
    request = urllib.request.Request(url, headers={"User-Agent": "tidemark"})
    with urllib.request.urlopen(request, timeout=timeout) as answer:  # noqa: S310
        text = answer.read().decode("utf-8", "replace")
    if not html and text.lstrip()[:9].lower().startswith(("<!doctype", "<html")):
        raise ValueError("an HTML page instead of a table")
    return text


class Reader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.urls, self.fallback = json.loads(options["locators"]), json.loads(options.get("fallback", "{}"))
        self.attempts = int(options.get("attempts", "3"))
        self.waits = [float(x) for x in options.get("waits", "30,90").split(",") if x]
        self.html = options.get("html", "false") == "true"

    def partitions(self) -> list[Locator]:
        return [Locator(k, url, self.fallback.get(k)) for k, url in sorted(self.urls.items())]

    def read(self, partition: Locator) -> Iterator[tuple]:
        why = ""
        tries = [("first", partition.url, k) for k in range(self.attempts)] + ([("fallback", partition.fallback, 0)] if partition.fallback else [])
        for source, url, nth in tries:
            if nth and self.waits:
                time.sleep(self.waits[min(nth, len(self.waits)) - 1])
            try:
                for n, line in enumerate(got(url, self.html).splitlines()):
                    yield partition.name, n, line, source, None
                return
            except (OSError, ValueError) as e:
                why = f"{type(e).__name__}: {e}"
        yield partition.name, None, None, None, why


class Published(DataSource):
    @classmethod
    def name(cls) -> str:
        return "published"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> Reader:  # noqa: ANN001
        return Reader(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(Published)
