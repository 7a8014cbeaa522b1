"""Landed API pages as a stream.

A folder has a folder a day (day=YYYY-MM-DD) with JSON pages, each a document {"items": [...]}, or several, a line each. A run reads the pages that have
come or changed since the run before. After the first run only the last `lookBack` days before the newest are listed, so a run costs what
that window holds; pages that come later for older days are not seen, as when the window is asked of an API.

A page (or line) that can't be parsed gives a row with the error instead of items, so it is counted and can be asked for again.
"""

from __future__ import annotations

import datetime
import io
import json
from collections.abc import Iterator, Sequence

from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from ..operators.windows import first_per
from ..sources import sinks
from ..sources.readers import files_of
from ..storage import kept

SCHEMA = "day date, page string, item string, error string"


class Page(InputPartition):
    def __init__(self, uri: str, day: str, path: str):
        self.uri, self.day, self.path = uri, day, path


class PageStream(DataSourceStreamReader):
    """An offset has the newest day, the newest time of a page, and the pages of just that time, so that pages which land at one time are told apart."""

    def __init__(self, options: dict):
        self.uri, self.back = options["path"], int(options.get("lookback", 7))

    def initialOffset(self) -> dict:
        return {"day": "", "at": -1, "names": []}

    def _days(self) -> list[str]:
        files, folder = files_of(self.uri)
        found = files.get_file_info(pafs.FileSelector(folder, allow_not_found=True))
        return sorted(x.base_name.removeprefix("day=") for x in found if x.base_name.startswith("day=") and not x.is_file)

    def _pages(self, days: Sequence[str]) -> list[tuple[int, str, str]]:
        """(time in ns, day, path) of the days' pages."""
        files, folder = files_of(self.uri)
        out = []
        for day in days:
            for x in files.get_file_info(pafs.FileSelector(f"{folder}/day={day}", allow_not_found=True)):
                if x.is_file and not x.base_name.startswith((".", "_")):
                    out.append((x.mtime_ns, day, x.path))
        return out

    def _window(self, newest: str, days: list[str]) -> list[str]:
        first = (datetime.date.fromisoformat(newest) - datetime.timedelta(days=self.back)).isoformat()
        return [d for d in days if first <= d <= newest]

    def latestOffset(self) -> dict:
        days = self._days()
        if not days:
            return self.initialOffset()
        pages = self._pages(self._window(days[-1], days))
        at = max((t for t, _, _ in pages), default=-1)
        return {"day": days[-1], "at": at, "names": sorted(p for t, _, p in pages if t == at)}

    def partitions(self, start: dict, end: dict) -> list[Page]:
        if not end["day"]:
            return []
        days = [d for d in self._days() if d <= end["day"]]
        window = self._window(end["day"], days)
        pages = self._pages(window)
        new = [x for x in pages if (x[0] > start["at"] or x[0] == start["at"] and x[2] not in start["names"]) and (x[0] < end["at"] or x[0] == end["at"] and x[2] in end["names"])]
        if not start["day"]:
            new = self._pages([d for d in days if d not in set(window)]) + new
        return [Page(self.uri, day, path) for _, day, path in sorted(new)]

    def read(self, partition: Page) -> Iterator[tuple]:
        day, name = datetime.date.fromisoformat(partition.day), partition.path.rpartition("/")[2]
        files, _ = files_of(self.uri)
        try:
            for n, page in enumerate(_documents(files, partition.path)):
                try:
                    page = json.loads(page) if isinstance(page, bytes) else page
                    items = page.get("items", page.get("results")) if isinstance(page, dict) else page
                    if not isinstance(items, list):
                        raise ValueError("no items")
                    rows = [(day, name, json.dumps(x, ensure_ascii=False), None) for x in items]
                except ValueError as e:
                    yield day, name, None, f"page {n}: {e}"[:200]
                    continue
                yield from rows
        except OSError as e:
            yield day, name, None, f"not read: {type(e).__name__}"


def _documents(files: pafs.FileSystem, path: str) -> Iterator[object]:
    """A file's documents: several, a line each as bytes, of which one is held at a time, or one over several lines, parsed."""
    with files.open_input_file(path) as f, io.BufferedReader(f) as lines:
        first = next((line for line in lines if line.strip()), b"")
        try:
            json.loads(first)
        except ValueError:
            pass
        else:
            yield first
            yield from (line for line in lines if line.strip())
            return
    # The first line is no document: the file is one, or its first line is broken.
    with files.open_input_file(path) as f:
        data = f.read()
    try:
        found = json.loads(data)
    except ValueError:
        with io.BytesIO(data) as lines:
            yield from (line for line in lines if line.strip())
    else:
        yield found


class PageStreamSource(DataSource):
    """``spark.readStream.format("landed_pages").option("lookBack", 3).load(folder)``"""

    @classmethod
    def name(cls) -> str:
        return "landed_pages"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> PageStream:
        return PageStream({k.lower(): v for k, v in self.options.items()})


def ingest(spark: SparkSession, folder: str, target: str, state: str, schema: str, keys: list[str], order: list[str], look_back: int = 7, part: str | None = None) -> dict[str, int]:
    """A run: the new pages' items, of a schema, update the table `target` by their keys, an item's latest version by `order`. `state` remembers what has been read, so a run that stops goes on where it was.

    Returns the counts of this run: pages, items and broken pages (which `target`-errors lists).
    """
    spark.dataSource.register(PageStreamSource)
    counts = {"pages": 0, "items": 0, "broken": 0}

    def put(batch: DataFrame, number: int) -> None:
        rows = kept(batch, "pages")
        found = rows.agg(F.count_distinct("day", "page").alias("pages"), F.count("item").alias("items"), F.count("error").alias("broken")).first()
        for k in counts:
            counts[k] += found[k]
        if found["broken"]:
            sinks.insert_new(rows.where("error IS NOT NULL").select("day", "page", "error", F.lit(number).alias("batch")), f"{target}-errors", ["day", "page", "error", "batch"])
        if found["items"]:
            items = rows.where("item IS NOT NULL").select(F.from_json("item", schema).alias("x")).select("x.*")
            columns = [*keys, *order, *sorted(c for c in items.columns if c not in [*keys, *order])]
            sinks.upsert(first_per(items.select(*columns), keys, order, descending=True), target, keys, newer_by=order, part=part)

    stream = spark.readStream.format("landed_pages").option("lookBack", look_back).load(folder)
    stream.writeStream.foreachBatch(put).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    return counts


def land(rows: DataFrame, day: str, size: int, folder: str) -> None:
    """Rows as pages of about `size` items in a folder a day, a line a page."""
    items = rows.select(F.date_format(day, "yyyy-MM-dd").alias("day"), F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"}).alias("item"))
    counts = items.groupBy("day").agg(F.ceil(F.count(F.lit(1)) / size).cast("int").alias("_pages"))
    paged = items.join(counts, "day").withColumn("_page", F.pmod(F.xxhash64("item"), F.col("_pages")))
    page = paged.groupBy("day", "_page").agg(F.concat(F.lit('{"items":['), F.array_join(F.collect_list("item"), ","), F.lit("]}")).alias("value"))
    page.select("day", "value").write.mode("append").partitionBy("day").text(folder)
