"""A paged Atom listing as a Spark data source, and the corpus built from it."""

from __future__ import annotations

import time
import xml.etree.ElementTree as ET
from collections.abc import Iterator
from urllib.parse import urlencode
from urllib.request import urlopen

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader

from ..functions.html import html_to_markdown
from ..functions.text import file_id, listing_id, sha12

_ATOM = "{http://www.w3.org/2005/Atom}"
PAGE = 50


def entries(xml: str) -> list[tuple[str, str]]:
    """Id and title (white space collapsed) of each entry of a feed."""
    return [((e.findtext(f"{_ATOM}id") or "").rsplit("/abs/", 1)[-1], " ".join((e.findtext(f"{_ATOM}title") or "").split())) for e in ET.fromstring(xml).iter(f"{_ATOM}entry")]


class ListingReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.endpoint, self.query, self.most = options["endpoint"], options.get("query", ""), int(options.get("maxScan", "1000"))
        self.wait_s = float(options.get("wait", "3"))

    def read(self, partition) -> Iterator[tuple[int, str, str]]:
        at = 0
        while at < self.most:
            params = {"search_query": self.query, "start": at, "max_results": PAGE, "sortBy": "submittedDate", "sortOrder": "descending"}
            with urlopen(f"{self.endpoint}?{urlencode(params)}", timeout=60) as r:
                page = entries(r.read().decode())
            if not page:
                return
            for i, (listing, title) in enumerate(page[: self.most - at]):
                yield at + i, listing, title
            at += len(page)
            if at < self.most:  # one page at a time, with a pause between two
                time.sleep(self.wait_s)


class ListingSource(DataSource):
    """``spark.read.format("atom_listing")``: ord, listing_id, title, newest first, in one partition."""

    @classmethod
    def name(cls) -> str:
        return "atom_listing"

    def schema(self) -> str:
        return "ord int, listing_id string, title string"

    def reader(self, schema) -> DataSourceReader:
        return ListingReader(dict(self.options))


def fetch_pages(listed: DataFrame, base_url: str, wait_s: float = 3.0) -> DataFrame:
    """listing_id and html of each listed entry; a page that isn't answered with 200 is left out.

    One request every ``wait_s`` seconds a task: callers bound the load by the number of partitions.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for listing in b["listing_id"]:
                try:
                    with urlopen(f"{base_url}{listing}", timeout=60) as r:
                        if r.status == 200:
                            rows.append((listing, r.read().decode("utf-8", "replace")))
                except OSError:
                    pass
                time.sleep(wait_s)
            yield pd.DataFrame(rows, columns=["listing_id", "html"])

    return listed.select("listing_id").mapInPandas(run, "listing_id string, html string")


def build_corpus(listed: DataFrame, pages: DataFrame, existing: DataFrame, n: int, max_scan: int, shortest: int = 20_000, longest: int = 200_000) -> DataFrame:
    """Papers kept from a listing: paper_id, title, text, chars, sha12.

    ``listed`` has ord, listing_id and title; ``pages`` has listing_id and html; papers in ``existing``
    (paper_id) are skipped. Of the first ``max_scan`` entries the first n that have an article of the
    right length are kept.
    """
    scanned = listed.where(F.col("ord") < max_scan).withColumn("paper_id", file_id(F.col("listing_id")))
    fresh = scanned.join(existing.select("paper_id"), "paper_id", "left_anti").join(pages, "listing_id")
    text = fresh.withColumn("text", html_to_markdown(F.col("html"), F.col("title"))).where(F.length("text").between(shortest, longest))
    kept = text.orderBy("ord").limit(n)
    return kept.select("paper_id", "title", "text", F.length("text").alias("chars"), sha12(F.col("text")).alias("sha12"))


__all__ = ["ListingSource", "build_corpus", "entries", "fetch_pages", "listing_id"]
