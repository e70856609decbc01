"""Services that list items by number, as a data source for batches and streams.

`spark.read.format("millrace_service")` and `spark.readStream...` ask a client for items from one number to another. The
reader divides the numbers into partitions of which no more than the service bears are open at once, keeps the pace of its
calls, waits where the service asks for a pause and tries failed calls again from the item where they failed, so nothing
comes twice or is left out. A stream's offsets are these numbers.

Options: `client` (module:factory; called with the options, in each task), `columns` (DDL of an item, default RAW_PAGES),
`partitions` (most, default 4), `size` (items of a call, default 100), `gap` (least seconds between the
starts of a partition's calls), `retries` (of one call, default 3), `pause` (seconds before a retry), `most` (items of a
stream's batch, default all that is there). Others are the client's.
"""

from __future__ import annotations

import importlib
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import date
from itertools import accumulate
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

from millrace import schemas
from millrace.sources.connectors import Clock, QuotaSpent, RateLimited
from millrace.storage import shared_folder

NAME = "millrace_service"


class Client(Protocol):
    """What a service must answer; either may raise RateLimited or QuotaSpent."""

    def count(self) -> int:
        """How many items there are; they are numbered from 0 and stay."""

    def items(self, first: int, last: int) -> list[dict]:
        """The items from `first` on, `last` excluded."""


def client_of(options: dict[str, str]) -> Client:
    module, _, factory = options["client"].partition(":")
    return getattr(importlib.import_module(module), factory)(options)


def recorded(rows: DataFrame, order: str, group: int = 8 << 20) -> str:
    """A folder in which `rows` lie in the order of a column, in row groups of about `group` bytes, for `Recorded`."""
    path = shared_folder(rows.sparkSession)
    rows.repartitionByRange(order).sortWithinPartitions(order).write.option("parquet.block.size", group).parquet(path)
    return path


class Recorded:
    """A client over items that were recorded as a Parquet table, in the order of a column (option `order`).

    Row groups are placed by their counts where their ranges don't meet, so a call reads those alone that hold its items and one
    is kept for the next call. Groups whose ranges meet are a run, of which the column is read as a whole.
    """

    def __init__(self, options: dict[str, str]):
        import pyarrow.dataset as ds

        table, self.order = ds.dataset(options["path"].removeprefix("file://"), format="parquet"), options["order"]
        self.names, groups = table.schema.names, []
        for group in (g for file in table.get_fragments() for g in file.split_by_row_group()):
            ends = (group.row_groups[0].statistics or {}).get(self.order, {})
            exact = isinstance(ends.get("min"), (int, date)) and isinstance(ends.get("max"), (int, date))
            groups.append((ends["min"], ends["max"], group) if exact else (None, None, group))
        if any(least is None for least, _, _ in groups):
            runs = [[g for _, _, g in groups]]
        else:
            runs, upto = [], None
            for least, most, group in sorted(groups, key=lambda g: g[:2]):
                if runs and least <= upto:
                    runs[-1].append(group)
                else:
                    runs.append([group])
                upto = most if upto is None else max(upto, most)
        self.runs = runs
        self.ends = list(accumulate(sum(g.row_groups[0].num_rows for g in run) for run in runs))
        self.held, self.rows, self.numbers = None, None, None

    def count(self) -> int:
        return self.ends[-1] if self.ends else 0

    def items(self, first: int, last: int) -> list[dict]:
        out, last = [], min(last, self.count())
        while first < last:
            run = bisect_right(self.ends, first)
            begin, upto = self.ends[run - 1] if run else 0, min(last, self.ends[run])
            out += self._of(run, first - begin, upto - begin)
            first = upto
        return out

    def _of(self, run: int, first: int, last: int) -> list[dict]:
        import pyarrow.compute as pc

        groups = self.runs[run]
        if self.held != run:
            self.held = run
            if len(groups) == 1:
                self.rows = groups[0].to_table(columns=self.names, use_threads=False).sort_by(self.order)
            else:
                self.numbers = sorted(n for g in groups for n in g.to_table(columns=[self.order])[self.order].to_pylist())
        if len(groups) == 1:
            return self.rows.slice(first, last - first).to_pylist()
        wanted = pc.field(self.order).isin(self.numbers[first:last])
        rows = [r for g in groups for r in g.to_table(columns=self.names, filter=wanted, use_threads=False).to_pylist()]
        return sorted(rows, key=lambda r: r[self.order])


@dataclass
class Range(InputPartition):
    first: int
    last: int


def ranges(first: int, last: int, most: int, size: int) -> list[Range]:
    """At most `most` partitions of whole calls over the items from `first` to `last`, as even as calls allow."""
    calls = -(-(last - first) // size)
    count = max(1, min(most, calls))
    edges = [min(last, first + calls * k // count * size) for k in range(count + 1)]
    return [Range(a, b) for a, b in zip(edges, edges[1:]) if a < b]


class Calls:
    """The calls of a partition."""

    def __init__(self, options: dict[str, str], schema: StructType, clock: Clock | None = None):
        self.options, self.names, self.clock = options, schema.fieldNames(), clock or Clock()
        self.size, self.retries = int(options.get("size", 100)), int(options.get("retries", 3))
        self.gap, self.pause = float(options.get("gap", 0)), float(options.get("pause", 1))

    def read(self, part: Range) -> Iterator[tuple]:
        client, at, failed, start = client_of(self.options), part.first, 0, float("-inf")
        while at < part.last:
            self.clock.sleep(max(0.0, start + self.gap - self.clock.now()))
            start, upto = self.clock.now(), min(part.last, at + self.size)
            try:
                items = client.items(at, upto)
                if len(items) != upto - at:
                    raise EOFError(f"{len(items)} items of {upto - at} from {at} on")
            except QuotaSpent:
                raise  # waiting doesn't help
            except Exception as error:
                failed += 1
                if failed > self.retries:
                    raise
                self.clock.sleep(error.seconds if isinstance(error, RateLimited) else self.pause)
                continue
            failed, at = 0, upto
            for item in items:
                yield tuple(item.get(n) for n in self.names)


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str], schema: StructType):
        self.options, self.schema = options, schema

    def partitions(self) -> list[Range]:
        found = ranges(0, client_of(self.options).count(), int(self.options.get("partitions", 4)), int(self.options.get("size", 100)))
        return found or [Range(0, 0)]

    def read(self, partition: Range) -> Iterator[tuple]:
        return Calls(self.options, self.schema).read(partition)


class _StreamReader(DataSourceStreamReader):
    def __init__(self, options: dict[str, str], schema: StructType):
        self.options, self.schema, self.last = options, schema, None

    def initialOffset(self) -> dict:
        return {"at": 0}

    def latestOffset(self) -> dict:
        there = client_of(self.options).count()
        if "most" in self.options and self.last is not None:
            there = min(there, self.last + int(self.options["most"]))
        elif "most" in self.options:
            there = min(there, int(self.options["most"]))
        return {"at": max(there, self.last or 0)}

    def partitions(self, start: dict, end: dict) -> list[Range]:
        self.last = end["at"]
        return ranges(start["at"], end["at"], int(self.options.get("partitions", 4)), int(self.options.get("size", 100)))

    def read(self, partition: Range) -> Iterator[tuple]:
        return Calls(self.options, self.schema).read(partition)

    def commit(self, end: dict) -> None:
        self.last = end["at"]


class Service(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return self.options.get("columns", schemas.RAW_PAGES)

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(dict(self.options), schema)

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return _StreamReader(dict(self.options), schema)


def registered(spark: SparkSession) -> SparkSession:
    """The session with the format."""
    spark.dataSource.register(Service)
    return spark
