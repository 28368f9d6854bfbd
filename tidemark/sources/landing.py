"""Feeds fetched over HTTP into a landing folder, one JSON file a request; Spark reads them from there.

The fetch function is a parameter, so that tests and other transports need no network. Requests are few and
small (days, chunks of days, batches of ids), so they run on the driver; parsing is Spark's.
"""

from __future__ import annotations

import json
import time
import urllib.parse
import urllib.request
import uuid
from collections.abc import Callable, Iterable, Iterator
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Fetch = Callable[[str, dict], object]
#: Days of a range request, ids of a people request, seconds to wait for an answer and between requests.
CHUNK_DAYS, CHUNK_IDS, TIMEOUT_S, PAUSE_S = 45, 100, 15, 0.25


def http(base: str, timeout: float = TIMEOUT_S) -> Fetch:
    """A fetch function over HTTP GET."""

    def fetch(path: str, params: dict) -> object:
        query = urllib.parse.urlencode({k: v for k, v in params.items() if v is not None})
        with urllib.request.urlopen(f"{base.rstrip('/')}/{path.lstrip('/')}{'?' + query if query else ''}", timeout=timeout) as answer:  # noqa: S310
            return json.load(answer)

    return fetch


def day_chunks(start: date, end: date, days: int = CHUNK_DAYS) -> Iterator[tuple[date, date]]:
    """[start, end] in runs of at most ``days`` days, both ends included."""
    while start <= end:
        last = min(end, start + timedelta(days=days - 1))
        yield start, last
        start = last + timedelta(days=1)


def id_chunks(ids: Iterable[int], size: int = CHUNK_IDS) -> Iterator[list[int]]:
    """Different ids in order, in batches."""
    known = sorted(set(ids))
    for a in range(0, len(known), size):
        yield known[a : a + size]


def requests_for(kind: str, **args) -> list[tuple[str, dict]]:
    """Path and parameters of each request: schedule, schedule_range, boxscores, transactions, people, odds, event_odds."""
    if kind == "schedule":
        return [("schedule", {"date": args["day"].isoformat(), "hydrate": "probablePitcher"})]
    if kind in ("schedule_range", "transactions"):
        more = {"hydrate": args.get("hydrate")} if kind == "schedule_range" else {}
        return [(kind.split("_")[0], {"startDate": a.isoformat(), "endDate": b.isoformat(), **more}) for a, b in day_chunks(args["start"], args["end"])]
    if kind == "boxscores":
        return [(f"game/{g}/boxscore", {}) for g in args["games"]]
    if kind == "people":
        return [("people", {"personIds": ",".join(map(str, c))}) for c in id_chunks(args["ids"])]
    if kind == "odds":
        return [("odds", {"markets": args["markets"], "regions": args["regions"]})]
    if kind == "event_odds":
        return [(f"events/{e}/odds", {"markets": args["markets"], "regions": args["regions"]}) for e in args["events"]]
    raise ValueError(f"no such feed: {kind}")


def fetched(fetch: Fetch, kind: str, pause: float = PAUSE_S, **args) -> tuple[list[dict], list[str]]:
    """Payloads as rows (path, json) and the requests that failed: one failure doesn't end the run."""
    rows, failed = [], []
    for k, (path, params) in enumerate(requests_for(kind, **args)):
        if k and pause:
            time.sleep(pause)
        try:
            answer = fetch(path, params)
        except Exception as e:  # noqa: BLE001  whatever the transport raises is told, and the next request is tried
            failed.append(f"{path}: {e}")
            continue
        for payload in answer if isinstance(answer, list) else [answer]:
            rows.append({"path": path, "json": json.dumps(payload)})
    return rows, failed


def land(spark: SparkSession, rows: list[dict], folder: str) -> DataFrame:
    """Appends payloads to the landing folder through Spark's writer, and gives them back as a frame."""
    df = spark.createDataFrame([(r["path"], r["json"]) for r in rows], "path string, json string")
    df.write.mode("append").json(folder)
    return df


#: Columns of a landed capture: when it was taken, each payload's place in it, the payload.
CAPTURE = "captured_at timestamp, place bigint, json string"


def land_capture(spark: SparkSession, payloads: list[dict], folder: str, captured_at) -> None:
    """Appends one capture of the price feed as one file, so that a stream sees it whole."""
    rows = [(captured_at, k, json.dumps(p)) for k, p in enumerate(payloads)]
    spark.createDataFrame(rows, CAPTURE).coalesce(1).write.mode("append").json(folder)


#: What a stream of captures reads: rows of a capture that is one file, or for a capture of many files where they lie.
LANDED = f"{CAPTURE}, parts string"


def land_whole(capture: DataFrame, folder: str, captured_at) -> None:
    """Appends one capture (place, json) of any size: first its payloads as many files beside the folder, then one file in it that names
    them, so that a stream sees the capture when it is whole. captured_at: its instant, a column or a value."""
    parts = f"{folder.rstrip('/')}.parts/{uuid.uuid4().hex}"
    capture.select("place", "json").write.json(parts)
    at = captured_at if isinstance(captured_at, Column) else F.lit(captured_at).cast("timestamp")
    capture.sparkSession.range(1).select(at.alias("captured_at"), F.lit(parts).alias("parts")).coalesce(1).write.mode("append").json(folder)


def landed(spark: SparkSession, folder: str) -> DataFrame:
    """All payloads of a landing folder (path, json)."""
    return spark.read.schema("path string, json string").json(folder)


def game_of(path):
    """The game that a box score's path names."""
    return F.regexp_extract(path, r"game/(\d+)/", 1).cast("bigint")
