"""Following files that grow, across restarts."""

import json
import os
import random

import pytest
from pyspark.sql import functions as F

from veilscan.sources import tail
from veilscan.sources.tail import AppendedReader, read_appended
from veilscan.streaming.stream import tail_events


def lines_of(reader, start, end):
    return [
        (row["path"], row["position"], row["value"])
        for part in reader.partitions(start, end) for batch in reader.read(part) for row in batch.to_pylist()
    ]


@pytest.mark.parametrize("most, size", [(0, 1 << 20), (0, 5), (40, 7), (1, 1)])
def test_lines_are_read_once(tmp_path, monkeypatch, most, size):
    monkeypatch.setattr(tail, "_LOOK", 4)
    monkeypatch.setattr(tail, "_BATCH", 16)
    pick = random.Random(most + size)
    root, at = str(tmp_path), {}
    wanted, found, pending = [], [], {}
    files = ["a.log", "b.log", "sub/c.log"]
    os.makedirs(tmp_path / "sub")
    (tmp_path / "_hidden").mkdir()
    (tmp_path / "_hidden" / "x.log").write_text("no\n")
    (tmp_path / ".x").write_text("no\n")
    for _ in range(60):
        name = pick.choice(files)
        for _ in range(pick.randrange(3)):
            text = "".join(pick.choice("aé \r") for _ in range(pick.randrange(30)))
            with open(tmp_path / name, "ab") as file:
                place = file.tell() - len(pending.get(name, b""))
                cut = pick.choice([text + "\n", text])  # whole or half a line
                file.write(cut.encode())
            pending[name] = pending.get(name, b"") + cut.encode()
            if cut.endswith("\n"):
                wanted.append((name, place, pending.pop(name)[:-1].removesuffix(b"\r").decode()))
        reader = AppendedReader(root, most, size)
        reader.partitions(at, at)  # as Spark does after a restart
        end = reader.latestOffset()
        json.dumps(end)
        new = lines_of(reader, at, end)
        if most and new:
            assert sum(len(v.encode()) + 1 for *_, v in new) <= most + 2 * sum(1 for _ in files) * 31 * 4
        found += new
        at = end
    for _ in range(400):
        reader = AppendedReader(root, most, size)
        reader.partitions(at, at)
        end = reader.latestOffset()
        found += lines_of(reader, at, end)
        if end == at:
            break
        at = end
    assert sorted(found) == sorted(wanted) and len(wanted) > 15


def test_a_file_begun_anew(tmp_path):
    log = tmp_path / "x.log"
    log.write_text("one\ntwo\nthree\n")
    reader = AppendedReader(str(tmp_path), 0, 100)
    first = reader.latestOffset()
    assert [v for *_, v in lines_of(reader, {}, first)] == ["one", "two", "three"]
    log.write_text("four\n")
    second = reader.latestOffset()
    assert [v for *_, v in lines_of(reader, first, second)] == ["four"]
    log.unlink()
    assert lines_of(reader, second, reader.latestOffset()) == []
    given = AppendedReader(str(tmp_path / "y.log"), 0, 100)
    assert given.latestOffset() == {}
    (tmp_path / "y.log").write_text("alone\n")
    assert [v for *_, v in lines_of(given, {}, given.latestOffset())] == ["alone"]


def test_follows_an_open_file_across_restarts(spark, tmp_path):
    log, out = tmp_path / "log", str(tmp_path / "out")
    os.makedirs(log)

    def event(n, kind="finding"):
        return json.dumps({"event": kind, "host": f"h{n}", "category": "SSN", "confidence": "high", "path": f"/d/{n}"})

    def run(**trigger):
        alerts = tail_events(spark, str(log)).select("host", "rule_id")
        query = alerts.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "cp"))
        return query.trigger(**trigger).start()

    with open(log / "events.jsonl", "a", buffering=1) as file:
        file.write(event(1) + "\n" + event(2) + "\n" + event(3)[:20])
        run(availableNow=True).awaitTermination()
        assert sorted(r["host"] for r in spark.read.parquet(out).collect()) == ["h1", "h2"]
        file.write(event(3)[20:] + "\n" + event(4) + "\n")
        run(availableNow=True).awaitTermination()
        # a query that runs on while the file grows
        query = run(processingTime="200 milliseconds")
        for n in range(5, 9):
            file.write(event(n) + "\n")
            query.processAllAvailable()
        query.stop()
        (log / "more.jsonl").write_text(event(9) + "\n")
        run(availableNow=True).awaitTermination()
        run(availableNow=True).awaitTermination()  # nothing new
    found = spark.read.parquet(out)
    assert sorted(r["host"] for r in found.collect()) == [f"h{n}" for n in range(1, 10)]


def test_bounded_batches(spark, tmp_path):
    log, sizes = tmp_path / "log", []
    os.makedirs(log)
    with open(log / "a.log", "w") as file:
        file.writelines(f"line {n:05d}\n" for n in range(1000))
    stream = read_appended(spark, str(log), max_bytes_per_batch=4400, partition_bytes=1000)
    query = (
        stream.writeStream.foreachBatch(lambda batch, _: sizes.append((batch.count(), batch.agg(F.countDistinct("position")).head()[0])))
        .option("checkpointLocation", str(tmp_path / "cp")).trigger(processingTime="0 seconds").start()
    )
    query.processAllAvailable()
    query.stop()
    assert [n for n, _ in sizes] == [400, 400, 200] and all(n == m for n, m in sizes)
