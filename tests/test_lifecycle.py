"""Stateful streams over several batches and a restart, against plain rules."""

import datetime

from geolark.streaming import lifecycle as L

T0 = datetime.datetime(2024, 1, 1)


def at(hours):
    return T0 + datetime.timedelta(hours=hours)


def run(spark, make, schema, batches, folder):
    """Each batch of rows is a file that one start of the stream reads; the checkpoint carries the state over. Rows that came out, by batch."""
    out = []
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        got = []

        def take(df, n):
            got.extend(df.collect())

        source = spark.readStream.schema(schema).parquet(f"{folder}/in")
        q = make(source).writeStream.foreachBatch(take).outputMode(make.mode).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
        q.awaitTermination()
        assert q.exception() is None
        out.append(got)
    return out


def test_life_cycle_over_restarts(spark, tmp_path):
    def make(events):
        return L.life_cycle(events, timeout_hours=6, late="0 seconds")

    make.mode = "update"
    batches = [
        [("a", 1, at(0), None), ("b", 2, at(0), None), ("c", 3, at(1), None), ("d", 4, at(1), None), ("d", 5, at(2), "failed"), ("d", 6, at(3), "completed")],
        [("a", 7, at(3.5), "completed"), ("c", 8, at(3.2), None), ("d", 14, at(1), "completed"), ("e", 9, at(5), None)],
        [("b", 10, at(9), "completed"), ("f", 11, at(9), None)],
        [("c", 12, at(9.5), "completed"), ("f", 13, at(10), "failed")],
    ]
    got = run(spark, make, "query_id string, event_id long, ts timestamp_ntz, status string", batches, str(tmp_path))
    seen = [sorted((r.query_id, r.status, (r.at_ms - int((T0 - datetime.datetime(1970, 1, 1)).total_seconds() * 1000)) / 3_600_000) for r in rows) for rows in got]
    assert seen[0] == [("a", "pending", 0), ("b", "pending", 0), ("c", "pending", 1), ("d", "failed", 2)]
    assert seen[1] == [("a", "completed", 3.5), ("e", "pending", 5)]
    # b's answer comes three hours late: whatever runs first, the timer or the row, the query has timed out
    assert seen[2] == [("b", "timed out", 6), ("c", "timed out", 7), ("f", "pending", 9)]
    assert seen[3] == [("f", "failed", 10)]


def test_cap_over_restarts(spark, tmp_path):
    def make(events):
        return L.capped(events, cap=3, late="0 seconds")

    make.mode = "append"
    batches = [[(2, at(1)), (1, at(1)), (3, at(25))], [(4, at(25.5)), (5, at(26)), (6, at(26)), (7, at(27))], [(8, at(26)), (9, at(47)), (10, at(49))]]
    got = run(spark, make, "event_id long, ts timestamp_ntz", batches, str(tmp_path))
    assert [sorted((r.day.day, r.event_id, r.n) for r in rows) for rows in got] == [[(1, 1, 1), (1, 2, 2), (2, 3, 1)], [(2, 4, 2), (2, 5, 3)], [(3, 10, 1)]]
