"""Announcements and the batch twins of the detector states."""

import pandas as pd
import pytest

from pagelathe.streaming import paper


def ticks(found, busy=None):
    return pd.DataFrame({"device": "a", "ts_ms": [400 * i for i in range(len(found))], "found": found, "busy_until": [busy] * len(found)})


@pytest.mark.parametrize(("found", "busy", "said"), [([False] * 4, None, [(1200, False)]), ([True] * 40, None, [(1200, True)]), ([True] * 20, 3000, [(3200, True)])])
def test_announcement(found, busy, said):
    assert paper.fold(ticks(found, busy))[1] == said


def test_stream_equals_batch(spark, tmp_path):
    rows = ticks([True] * 10 + [False] * 20 + [True] * 20)
    frames = spark.createDataFrame(rows.astype({"busy_until": "float"}), "device string, ts_ms bigint, found boolean, busy_until double").selectExpr("device", "ts_ms", "found", "cast(NULL as bigint) as busy_until")
    frames.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(frames.schema).parquet(str(tmp_path / "in"))
    run = paper.announce_stream(stream).writeStream.format("memory").queryName("said").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    assert run.awaitTermination(60)
    got = sorted(map(tuple, spark.table("said").collect()))
    assert got == sorted(map(tuple, paper.announce(frames).collect())) and len(got) == 3
