"""Feeds as a data source, over a transport that counts, fails and recovers."""

import json
from datetime import date

from tidemark.sources import feeds, reader


def test_requests_are_partitions(spark, tmp_path):
    log = str(tmp_path)

    def fetch(path, params):
        import os
        import uuid

        day = params.get("startDate", path.replace("/", "_"))
        open(os.path.join(log, f"{day}.{uuid.uuid4().hex}"), "w").close()
        tried = sum(x.startswith(day) for x in os.listdir(log))
        if day == "2026-02-15" or day == "2026-04-01" and tried < 2:
            raise OSError("down")
        if path.startswith("people"):
            return [{"people": [{"id": int(i)}]} for i in params["personIds"].split(",")]
        return {"transactions": [{"id": int(day[5:7]), "person": {"id": 2}, "date": day, "typeDesc": "Status Change", "description": "placed on the injured list"}]}

    reader.register(spark, "fake_feed", fetch, pause=0.01)
    read = spark.read.format("fake_feed")
    df = read.option("kind", "transactions").option("start", "2026-01-01").option("end", "2026-06-30").load()
    assert df.rdd.getNumPartitions() == 5
    rows = df.collect()
    asked = [json.loads(r.params)["startDate"] for r in rows]
    assert sorted(asked) == ["2026-01-01", "2026-02-15", "2026-04-01", "2026-05-16", "2026-06-30"]
    failed = {json.loads(r.params)["startDate"]: r.error for r in rows if r.error}
    assert failed == {"2026-02-15": "OSError: down"}  # that of April recovered, that of February is told and ends nothing
    moves, left = feeds.transactions(df.where("error is null"))
    assert moves.count() == 4 and left.count() == 0
    people = read.option("kind", "people").option("ids", "3,1,2,3").load()
    assert sorted(json.loads(r.json)["people"][0]["id"] for r in people.collect()) == [1, 2, 3]


def test_stream_of_days(spark, tmp_path):
    """Each day is asked for once over restarts; days that haven't passed are left for later."""
    now = tmp_path / "today"

    def fetch(path, params):
        return {"from": params["startDate"], "to": params["endDate"]}

    reader.register(spark, "day_feed", fetch, today=lambda: date.fromisoformat(now.read_text()))

    def run():
        stream = spark.readStream.format("day_feed").option("kind", "schedule_range").option("start", "2026-01-01").load()
        stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
        return sorted((r["from"], r["to"]) for r in (json.loads(x.json) for x in spark.read.schema(reader.SCHEMA).parquet(str(tmp_path / "out")).collect()))

    now.write_text("2026-01-04")
    assert run() == [("2026-01-01", "2026-01-03")]
    assert run() == [("2026-01-01", "2026-01-03")]
    now.write_text("2026-03-01")
    assert run() == [("2026-01-01", "2026-01-03"), ("2026-01-04", "2026-02-17"), ("2026-02-18", "2026-02-28")]
