"""The request scheduler as a stream: rate per host, restarts, repeated batches, expiry."""

import math
from collections import defaultdict

from siltstone.streaming import scheduler as SC

SCHEMA = "url string, depth int, asked_at double"


def run(spark, folder, path, mark, rows, delays):
    if rows is not None:
        spark.createDataFrame(rows, SCHEMA).write.mode("append").parquet(folder)
    stream = spark.readStream.schema(SCHEMA).parquet(folder)
    SC.schedule_stream(stream, delays, path, mark, 1.0).awaitTermination()


def starts(spark, path):
    found = defaultdict(list)
    for r in SC.scheduled(spark, path).collect():
        found[r.host].append(r.start_at)
    return {host: sorted(s) for host, s in found.items()}


def test_hosts_keep_their_pace_over_batches_and_expire(spark, tmp_path):
    folder, path, mark = (str(tmp_path / n) for n in ("in", "out", "mark"))
    delays = spark.createDataFrame([("b.org", 3.0), ("a.org", 0.1)], "host string, crawl_delay double")
    run(spark, folder, path, mark, [(f"http://a.org/{i}", 0, 0.0) for i in range(5)] + [("http://b.org/1", 0, 0.0)], delays)
    assert starts(spark, path) == {"a.org": [0, 1, 2, 3, 4], "b.org": [0]}
    assert {r.host: r.free_at for r in SC.busy_hosts(spark, path).collect()} == {"a.org": 5.0, "b.org": 3.0}
    run(spark, folder, path, mark, [("http://a.org/x", 1, 2.0), ("http://b.org/2", 1, 2.0), ("http://c.org/1", 1, 1.0), (None, 1, 0.0)], delays)
    assert starts(spark, path) == {"a.org": [0, 1, 2, 3, 4, 5], "b.org": [0, 3], "c.org": [2]}
    run(spark, folder, path, mark, [("http://c.org/2", 2, 100.0), ("http://c.org/2", 2, 100.0)], delays)
    assert starts(spark, path)["c.org"] == [2, 100, 101]
    assert {r.host for r in SC.busy_hosts(spark, path).collect()} == {"c.org"}  # the others are free by the clock
    for host, times in starts(spark, path).items():
        pace = 3.0 if host == "b.org" else 1.0
        assert all(b - a >= pace or math.isclose(b - a, pace) for a, b in zip(times, times[1:]))


def test_a_batch_that_runs_again_gives_the_same_times(spark, tmp_path):
    folder, path = str(tmp_path / "in"), str(tmp_path / "out")
    delays = spark.createDataFrame([], "host string, crawl_delay double")
    run(spark, folder, path, str(tmp_path / "one"), [(f"http://a.org/{i}", 0, 0.0) for i in range(3)], delays)
    first = sorted(map(tuple, SC.scheduled(spark, path).collect()))
    run(spark, folder, path, str(tmp_path / "two"), None, delays)
    assert sorted(map(tuple, SC.scheduled(spark, path).collect())) == first
