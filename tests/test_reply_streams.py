"""Streams of events with state, across restarts."""

import json
import os
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.errors import StreamingQueryException

from sceneloom.streaming import replies as rs

START = datetime(2024, 1, 1, tzinfo=timezone.utc)
SCHEMA = "stream string, nth int, at timestamp, value string"


def line(stream, nth, second, **event):
    return json.dumps({"stream": stream, "nth": nth, "at": (START + timedelta(seconds=second)).isoformat(), "value": "data: " + json.dumps(event) if event else "noise"})


FILES = [
    [line("a", 1, 1, type="text", content="one"), line("a", 0, 0, type="tool", name="find", arguments="{}"), line("b", 0, 2, type="text", content="hello"), line("a", 2, 3)],
    [line("a", 1, 1, type="text", content="one"), line("a", 3, 4, type="result", component_ids=[4, 5], reason="there"), line("a", 4, 5, type="text", content="after the end"), line("c", 0, 6, type="error", content="broken")],
    [line("a", 5, 7, type="result", reason="again"), line("b", 1, 20, type="text", content="still here"), line(None, 0, 8, type="text", content="nobody's")],
    [line("d", 0, 300, type="text", content="much later"), line("c", 1, 301, type="text", content="too late for c")],
    [line("b", 2, 21, type="text", content="behind the watermark"), line("d", 1, 305, type="result", reason="done")],
    [line("e", 0, 900, type="error", content="moves the clock")],
]
WANT = {
    ("a", 0, "tool", None, 0), ("a", 1, "text", "one", 1000), ("a", 3, "result", None, 4000), ("b", 0, "text", "hello", 0), ("b", 1, "text", "still here", 18000), ("b", 2, "error", rs.TIMED_OUT, 78000),
    ("c", 0, "error", "broken", 0), ("d", 0, "text", "much later", 0), ("d", 1, "result", None, 5000), ("e", 0, "error", "moves the clock", 0),
}


@pytest.mark.parametrize("failing", [None, 1, 3])
def test_nothing_is_lost_or_repeated(spark, tmp_path, failing):
    rs.with_state_store(spark)
    source, out = tmp_path / "in", tmp_path / "out"
    source.mkdir()
    state = {"fails": failing}

    def write(batch, number):
        if number == state["fails"]:
            state["fails"] = None
            raise RuntimeError("lost in mid-stream")
        batch.write.mode("overwrite").parquet(f"{out}/{number}")

    def run():
        lines = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).json(str(source))
        found = rs.replies(rs.event_rows(lines))
        found.writeStream.foreachBatch(write).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()

    for i, lines in enumerate(FILES):
        (source / f"{i}.json").write_text("\n".join(lines))
        os.utime(source / f"{i}.json", (1e9 + i, 1e9 + i))  # files are taken by age
        if i in (1, 3, 5):  # the query stops and starts anew in between
            try:
                run()
            except StreamingQueryException:
                run()
    rows = spark.read.option("recursiveFileLookup", "true").parquet(str(out)).select("stream", "nth", "type", "content", "elapsed_ms", "component_ids").collect()
    got = [tuple(r)[:5] for r in rows]
    assert len(got) == len(set(got)) and set(got) == WANT
    assert next(r["component_ids"] for r in rows if (r["stream"], r["type"]) == ("a", "result")) == [4, 5]
