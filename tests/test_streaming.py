"""Episodes with keyed state over several batches of a stream."""

from datetime import datetime, timedelta

from evidencelens.streaming import capture

SCHEMA = "event_id long, kind string, ref string, ts timestamp, flag boolean"
START = datetime(2024, 1, 1)


def rows(*given):
    return [(event, kind, ref, START + timedelta(seconds=s), flag) for event, kind, ref, s, flag in given]


def test_state_lives_in_slots_and_spans_batches(spark, tmp_path):
    """The calls to the state store grow with the slots: 30 events are two rows of state; answers are those of an event's own state."""
    src, out = tmp_path / "in", tmp_path / "out"
    with capture.timed_state(spark):
        stream = lambda: capture.assemble_episodes_state(spark.readStream.schema(SCHEMA).parquet(str(src)), slots=2)

        def drained():
            q = stream().writeStream.format("parquet").option("path", str(out)).option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(availableNow=True).start()
            q.awaitTermination()
            return max((p["stateOperators"][0]["numRowsUpdated"] for p in q.recentProgress if p["stateOperators"]), default=0)

        many = [(e, kind, ref, 10, True) for e in range(100, 130) for kind, ref in (("start", "s"), ("action", "a0"))]
        first = rows((1, "start", "s", 0, None), (1, "outcome", "late", 40, True), (1, "action", "a0", 3, None), (2, "outcome", "early", 5, None), (3, "action", "lost", 6, None), *many)
        spark.createDataFrame(first, SCHEMA).coalesce(1).write.parquet(str(src))
        assert 0 < drained() < 30
        second = rows((1, "outcome", "sooner", 30, False), (1, "action", "a1", 61, None), (2, "start", "s", 1, None), (9, "start", "s", 2 * 86_400, None))
        spark.createDataFrame(second, SCHEMA).coalesce(1).write.mode("append").parquet(str(src))
        drained()
    got = {tuple(r) for r in spark.read.schema(capture.RECORD).parquet(str(out)).collect()}
    assert got == {
        (1, "rejected", "late", "already_finalized", None, None), (1, "rejected", "a1", "outside_window", None, None), (1, "episode", "sooner", None, 1, False),
        (2, "episode", "early", None, 0, None), (3, "rejected", "lost", "no_start", None, None), *[(e, "episode", None, None, 1, None) for e in range(100, 130)]}
