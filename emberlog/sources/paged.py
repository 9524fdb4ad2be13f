"""A paged log source: documents in pages of a fixed snapshot, read in parallel as a table or page by page as a stream.

A snapshot is a folder of pages (line-delimited JSON documents, each with its time and its place among equal times, in that order) and a table of pages:
number, first and last cursor, rows. The cursor of a page is (time, place) of its last document. A reader plans partitions of some pages each, leaves out pages whose
cursors are outside of the times asked for, and fails if a page is missing or holds other rows than the snapshot says: fetched must equal total.

``fetch(folder, number)`` gives a page's lines. It runs in tasks, with retries; the default reads a shared folder, and a client of a log server takes its place.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual
from pyspark.sql.types import StructType

Fetch = Callable[[str, int], Iterator[str]]
PAGE_ROWS = 10_000
#: Rows that one task lays out, or reads, as pages.
TASK_ROWS = 200_000


def write_snapshot(docs: DataFrame, folder: str, at: str = "us", page_rows: int = PAGE_ROWS) -> None:
    """Documents (with a time in microseconds) laid out as the pages of a snapshot, in the order of time, then of all else.

    Ranges of a range sort are cut into pages: none is put in order in one task, and pages have about ``page_rows`` rows, not just so many. The ranges are many pages wide and
    cut by times and hashes, so that neither tasks nor what the driver samples go by the number of pages or the length of lines. Numbers of pages rise in time, with gaps.
    """
    total = docs.count()
    n = max(1, min(docs.sparkSession.sparkContext.defaultParallelism, -(-total // page_rows)), -(-total // max(page_rows, TASK_ROWS)))
    each = max(1, -(-total // max(1, n * max(1, round(total / n / page_rows)))))  # a range's rows in pages of like size
    line = F.to_json(F.struct(*docs.columns))
    rows = docs.select(F.col(at).alias("us"), line.alias("line")).withColumn("hash", F.xxhash64("line")).repartitionByRange(n, "us", "hash").sortWithinPartitions("us", "hash", "line")
    place = F.monotonically_increasing_id()  # the range, then the place in it
    rows = rows.withColumn("place", place).withColumn("page", F.shiftright("place", 33) * (1 << 20) + F.floor(F.col("place").bitwiseAND((1 << 33) - 1) / each))
    rows.sortWithinPartitions("page", "place").select("page", "us", "line").write.partitionBy("page").json(f"{folder}/pages")
    pages = docs.sparkSession.read.schema("us long, line string, page long").json(f"{folder}/pages").groupBy("page").agg(F.min("us").alias("first"), F.max("us").alias("last"), F.count("*").alias("rows"))
    pages.coalesce(1).write.json(f"{folder}/index")  # a row a page


def read_page(folder: str, number: int) -> Iterator[str]:
    """The lines of a page in a folder that every machine sees."""
    parts = sorted(Path(folder.removeprefix("file:")).glob(f"pages/page={number}/*.json"))
    if not parts:
        raise FileNotFoundError(f"page {number} is missing")
    for part in parts:
        with part.open(encoding="utf-8") as lines:
            for line in lines:
                yield json.loads(line)["line"]


class Page(InputPartition):
    def __init__(self, number: int, rows: int) -> None:
        super().__init__(number)
        self.number, self.rows = number, rows


class Stretch(InputPartition):
    """Pages that one task reads after each other."""

    def __init__(self, pages: list[Page]) -> None:
        super().__init__(pages[0].number)
        self.pages = pages


def stretches(index: list[dict], at_least: int = 16) -> list[Stretch]:
    """The pages in stretches of at most ``TASK_ROWS`` rows, shorter ones if there are few pages, so that ``at_least`` tasks share them."""
    most, out, rows = min(TASK_ROWS, sum(p["rows"] for p in index) // at_least), [], 0
    for p in index:
        if not out or rows + p["rows"] > most:
            out.append([])
            rows = 0
        out[-1].append(Page(p["page"], p["rows"]))
        rows += p["rows"]
    return [Stretch(pages) for pages in out]


class _Pages:
    """What both readers do: plan pages and fetch them."""

    def __init__(self, schema: StructType, options: dict[str, str], fetch: Fetch) -> None:
        self.names = schema.names
        self.folder, self.at, self.retries = options["path"], options.get("at", "us"), int(options.get("retries", "3"))
        self.fetch = fetch

    def index(self) -> list[dict]:
        found = [json.loads(x) for p in sorted(Path(self.folder.removeprefix("file:")).glob("index/*.json")) for x in p.read_text().splitlines()]
        return sorted(found, key=lambda p: p["page"])

    def read(self, partition: Page | Stretch) -> Iterator[tuple]:
        for page in partition.pages if isinstance(partition, Stretch) else [partition]:
            yield from self._read(page)

    def _read(self, partition: Page) -> Iterator[tuple]:
        for attempt in range(self.retries):
            try:
                lines = list(self.fetch(self.folder, partition.number))
                break
            except OSError:
                if attempt + 1 == self.retries:
                    raise
                time.sleep(0.1 * 2**attempt)
        if len(lines) != partition.rows:
            raise ValueError(f"page {partition.number}: {len(lines)} rows fetched of {partition.rows}")
        for line in lines:
            doc = json.loads(line)
            yield tuple(doc.get(n) for n in self.names)


class PagedReader(_Pages, DataSourceReader):
    def __init__(self, *args) -> None:
        super().__init__(*args)
        self.low, self.high = None, None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Bounds on the time choose pages; Spark filters their rows, so every filter is handed back."""
        for f in filters:
            if isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual)) and f.attribute == (self.at,):
                self.low = f.value if self.low is None else max(self.low, f.value)
            if isinstance(f, (EqualTo, LessThan, LessThanOrEqual)) and f.attribute == (self.at,):
                self.high = f.value if self.high is None else min(self.high, f.value)
            yield f

    def partitions(self) -> list[Page]:
        wanted = [p for p in self.index() if (self.low is None or p["last"] >= self.low) and (self.high is None or p["first"] <= self.high)]
        return stretches(wanted)


class PagedStreamReader(_Pages, DataSourceStreamReader):
    """The offset is the number of pages read; a batch takes all pages that are there by now."""

    def initialOffset(self) -> dict:
        return {"pages": 0}

    def latestOffset(self) -> dict:
        return {"pages": len(self.index())}

    def partitions(self, start: dict, end: dict) -> list[Page]:
        return stretches(self.index()[start["pages"] : end["pages"]])

    def commit(self, end: dict) -> None:
        pass


class PagedLogs(DataSource):
    """``spark.read.format("paged_logs").schema(...).load(folder)``, or ``readStream``. Options: ``at`` (column of the time), ``retries``."""

    fetch: Fetch = staticmethod(read_page)

    @classmethod
    def name(cls) -> str:
        return "paged_logs"

    def reader(self, schema: StructType) -> DataSourceReader:
        return PagedReader(schema, dict(self.options), type(self).fetch)

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return PagedStreamReader(schema, dict(self.options), type(self).fetch)


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(PagedLogs)
