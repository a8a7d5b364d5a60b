"""Windows and sessions over a growing folder: lateness, restarts, repeated batches, compaction."""

import datetime as dt

from siltstone.streaming import windows as W

SPEC = W.Windows(["who"], "at", "v", width="10 minutes", gap="5 minutes", delay=600)
SCHEMA = "who string, at timestamp, v double"


def minute(m):
    return None if m is None else dt.datetime(2024, 1, 1) + dt.timedelta(minutes=m)


def feed(spark, folder, rows):
    spark.createDataFrame([(w, minute(m), float(v)) for w, m, v in rows], SCHEMA).coalesce(1).write.mode("append").parquet(folder)


def run(spark, folder, path, checkpoint):
    stream = spark.readStream.schema(SCHEMA).parquet(folder)
    W.windowed_stream(stream, path, checkpoint, SPEC).awaitTermination()


def test_late_rows_are_kept_and_correct_the_windows(spark, tmp_path):
    folder, path, mark = (str(tmp_path / n) for n in ("in", "out", "mark"))
    feed(spark, folder, [("a", 1, 1), ("a", 3, 1), ("a", 9, 1), (None, 2, 1), ("b", None, 1)])
    run(spark, folder, path, mark)
    assert W.watermark(spark, path, SPEC.delay) == minute(-1)
    feed(spark, folder, [("a", 40, 2), ("a", 7, 2)])  # the watermark is still -1, so minute 7 is on time
    run(spark, folder, path, mark)
    feed(spark, folder, [("a", 5, 4), ("a", 30, 4)])  # the watermark is 30: minute 5 is late, minute 30 is not
    run(spark, folder, path, mark)
    late = W.late_rows(spark, path)
    assert {(r.who, r.at, r.v) for r in late.collect()} == {("a", minute(5), 4.0), ("b", None, 1.0)}

    def found(path, fn, with_late):
        return {(r.who, r.start, r.n, r.total, r.n_late, r.closed) for r in fn(spark, path, SPEC, with_late).collect()}

    on_time = {("a", minute(0), 4, 5.0, 0, True), (None, minute(0), 1, 1.0, 0, True), ("a", minute(30), 1, 4.0, 0, False), ("a", minute(40), 1, 2.0, 0, False)}
    assert found(path, W.windows, False) == on_time
    assert found(path, W.windows, True) == on_time - {("a", minute(0), 4, 5.0, 0, True)} | {("a", minute(0), 5, 9.0, 1, True)}
    apart = {("a", minute(1), 4, 5.0, 0, True), (None, minute(2), 1, 1.0, 0, True), ("a", minute(30), 1, 4.0, 0, False), ("a", minute(40), 1, 2.0, 0, False)}
    assert found(path, W.sessions, False) == apart
    assert ("a", minute(1), 5, 9.0, 1, True) in found(path, W.sessions, True)

    before = {fn: {late: found(path, fn, late) for late in (True, False)} for fn in (W.windows, W.sessions)}
    small = str(tmp_path / "small")
    W.compact(spark, path, SPEC, small)
    assert before == {fn: {late: found(small, fn, late) for late in (True, False)} for fn in (W.windows, W.sessions)}
    feed(spark, folder, [("a", 41, 1)])
    run(spark, folder, small, mark)
    assert ("a", minute(40), 2, 3.0, 0, False) in found(small, W.sessions, True)


def test_a_late_row_joins_two_sessions(spark, tmp_path):
    folder, path, mark = (str(tmp_path / n) for n in ("in", "out", "mark"))
    for rows in ([("a", 0, 1), ("a", 8, 1)], [("b", 60, 1)], [("a", 4, 1)]):
        feed(spark, folder, rows)
        run(spark, folder, path, mark)
    count = lambda late: W.sessions(spark, path, SPEC, late).filter("who = 'a'").count()
    assert (count(False), count(True)) == (2, 1)


def test_a_batch_that_runs_again_changes_nothing(spark, tmp_path):
    folder, path = str(tmp_path / "in"), str(tmp_path / "out")
    feed(spark, folder, [("a", 1, 1), ("a", 2, 1)])
    run(spark, folder, path, str(tmp_path / "one"))
    run(spark, folder, path, str(tmp_path / "two"))  # a lost checkpoint: the same rows as batch 0 again
    assert [r.n for r in W.windows(spark, path, SPEC).collect()] == [2]
