"""Feeds as a data source: one partition a request, so requests run in tasks, are tried again with them, and none of their answers passes the driver.

``spark.read.format(name)`` gives (path, params, json, error): a row for each payload, or one row with the error of a request that failed for good.
``spark.readStream.format(name)`` goes by days: offsets are days, each micro-batch asks for the days that have passed since the one before, in
chunks, and a batch that comes again asks for the same ones.

The transport is a function (path, params) -> payload; it travels with the source, so tests need no network.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator
from datetime import date, timedelta

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from tidemark.session import ship
from tidemark.sources import landing

SCHEMA = "path string, params string, json string, error string"
#: How often a request is tried, and seconds between tries.
TRIES, PAUSE_S = 3, 0.25


class Request(InputPartition):
    """One request of a feed."""

    def __init__(self, path: str, params: dict):
        self.path, self.params = path, params


def answers(fetch: landing.Fetch, request: Request, tries: int = TRIES, pause: float = PAUSE_S) -> Iterator[tuple]:
    """The rows of one request; a failed one is told as a row, so that it doesn't end the others."""
    params = json.dumps(request.params, sort_keys=True)
    for n in range(tries):
        try:
            answer = fetch(request.path, request.params)
        except Exception as e:  # noqa: BLE001  whatever the transport raises is told
            if n == tries - 1:
                yield request.path, params, None, f"{type(e).__name__}: {e}"
                return
            time.sleep(pause * 2**n)
            continue
        for payload in answer if isinstance(answer, list) else [answer]:
            yield request.path, params, json.dumps(payload), None
        return


def _numbers(text: str | None) -> list[int]:
    return [int(x) for x in (text or "").split(",") if x]


def register(spark: SparkSession, name: str, fetch: landing.Fetch, today: Callable[[], date] = date.today, pause: float = PAUSE_S) -> None:
    """Makes a transport readable as the format ``name``. Options: kind (of ``landing.requests_for``), start, end, day (ISO dates), ids, games, events
    (comma-separated), markets, regions, tries. A stream takes kind (schedule_range or transactions) and start; ``today`` is the day that hasn't passed yet."""

    ship(spark)

    def arguments(options: dict) -> dict:
        out: dict = {k: date.fromisoformat(options[k]) for k in ("start", "end", "day") if options.get(k)}
        out |= {k: _numbers(options[k]) for k in ("ids", "games") if options.get(k)}
        out |= {k: options[k] for k in ("markets", "regions") if options.get(k)}
        return out | ({"events": options["events"].split(",")} if options.get("events") else {})

    class Reader(DataSourceReader):
        def __init__(self, options: dict):
            self.kind, self.args, self.tries = options["kind"], arguments(options), int(options.get("tries", TRIES))

        def partitions(self) -> list[Request]:
            return [Request(*r) for r in landing.requests_for(self.kind, **self.args)] or [None]

        def read(self, partition: Request) -> Iterator[tuple]:
            return answers(fetch, partition, self.tries, pause) if partition is not None else iter(())

    class Stream(DataSourceStreamReader):
        def __init__(self, options: dict):
            self.kind, self.first, self.tries = options["kind"], date.fromisoformat(options["start"]), int(options.get("tries", TRIES))

        def initialOffset(self) -> dict:
            return {"day": self.first.isoformat()}

        def latestOffset(self) -> dict:
            return {"day": max(self.first, today()).isoformat()}

        def partitions(self, start: dict, end: dict) -> list[Request]:
            a, b = date.fromisoformat(start["day"]), date.fromisoformat(end["day"]) - timedelta(days=1)
            return [Request(*r) for r in landing.requests_for(self.kind, start=a, end=b)] if a <= b else []

        def read(self, partition: Request) -> Iterator[tuple]:
            return answers(fetch, partition, self.tries, pause)

    class Feed(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return SCHEMA

        def reader(self, schema) -> DataSourceReader:
            return Reader(self.options)

        def streamReader(self, schema) -> DataSourceStreamReader:
            return Stream(self.options)

    spark.dataSource.register(Feed)
