"""Streaming queries over the events table, drained into files, with their batch twins."""

from pyspark.sql import functions as F

from evidencelens import views
from evidencelens.catalog import query
from evidencelens.session import scratch_path
from evidencelens.streaming import capture as cap
from evidencelens.views import table

ROWS = """explode(array(named_struct('kind', 'start', 'ref', 's', 'ts', ts, 'flag', CAST(NULL AS boolean)),
 named_struct('kind', 'action', 'ref', 'a0', 'ts', ts + make_interval(0,0,0,0,0,0, event_id % 70), 'flag', CAST(NULL AS boolean)),
 named_struct('kind', 'outcome', 'ref', 'r0', 'ts', ts + make_interval(0,0,0,0,0,1, 0 - event_id % 7), 'flag', value > 20),
 named_struct('kind', 'outcome', 'ref', 'r1', 'ts', ts + make_interval(0,0,0,0,0,0, 30 + event_id % 40), 'flag', value > 30))) AS r"""


def lifecycle(events):
    """Start, action and two outcomes of every event; some starts are missing."""
    e = events.selectExpr("event_id", "CAST(ts AS timestamp) AS ts", "value").selectExpr("event_id", ROWS).select("event_id", "r.*")
    return e.where("NOT (kind = 'start' AND event_id % 19 = 0)")


def events_stream(spark, sf):
    schema = table(spark, sf, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)


def closed_stream(spark, sf):
    """The events and one record two days later, whose watermark closes every session and window before it."""
    events = table(spark, sf, "events")
    last = events.agg(F.max_by(F.struct(*events.columns), "ts").alias("e")).select("e.*").withColumns({"event_id": F.lit(-1).cast("long"), "ts": F.expr("ts + INTERVAL 2 DAYS")})
    path = scratch_path(spark, "events-in")
    events.unionByName(last).write.parquet(path)
    return spark.readStream.schema(events.schema).parquet(path)


LIFE = """WITH e AS (SELECT event_id, epoch_us(ts) AS us, value, event_id % 19 <> 0 AS has FROM events),
x AS (SELECT event_id, has, us, 'action' AS kind, 'a0' AS ref, us + (event_id % 70) * 1000000 AS t, NULL::BOOLEAN AS flag FROM e
 UNION ALL SELECT event_id, has, us, 'outcome', 'r0', us + 60000000 - (event_id % 7) * 1000000, value > 20 FROM e UNION ALL SELECT event_id, has, us, 'outcome', 'r1', us + (30 + event_id % 40) * 1000000, value > 30 FROM e),
i AS (SELECT *, has AND t - us BETWEEN 0 AND 60000000 AS ok FROM x), o AS (SELECT event_id, arg_min(ref, t * 10 + (ref = 'r1')::INT) AS ref, arg_min(flag, t * 10 + (ref = 'r1')::INT) AS flag FROM i WHERE ok AND kind = 'outcome' GROUP BY 1),
res AS (SELECT e.event_id, 'episode' AS record, o.ref, NULL AS reason, (SELECT count(*) FROM i WHERE i.event_id = e.event_id AND ok AND kind = 'action') AS n_actions, o.flag AS outcome, us FROM e LEFT JOIN o USING (event_id) WHERE has
 UNION ALL SELECT i.event_id, 'rejected', i.ref, CASE WHEN NOT has THEN 'no_start' WHEN NOT ok THEN 'outside_window' ELSE 'already_finalized' END, NULL, NULL, us FROM i LEFT JOIN o USING (event_id) WHERE NOT ok OR (kind = 'outcome' AND i.ref <> o.ref))"""
@query("assemble_episodes", "R1", LIFE + " SELECT event_id, record, ref, reason, n_actions, outcome FROM res")
def assemble(spark, sf):
    return cap.assemble_episodes(lifecycle(table(spark, sf, "events")))


@query("assemble_episodes_stream", "R1", LIFE + " SELECT event_id, record, ref, reason, n_actions, outcome FROM res")
def assemble_stream(spark, sf):
    out = scratch_path(spark, "episodes-out")
    cap.drain(cap.assemble_episodes_stream(lifecycle(closed_stream(spark, sf))), out, scratch_path(spark, "checkpoint"))
    return spark.read.schema(cap.RECORD).parquet(out)


@query("assemble_episodes_state", "R1", LIFE + " SELECT event_id, record, ref, reason, n_actions, outcome FROM res")
def assemble_state(spark, sf):
    """The same with keyed state and timers; the record that only moves the watermark is left out."""
    out = scratch_path(spark, "episodes-out")
    with cap.timed_state(spark):
        cap.drain(cap.assemble_episodes_state(lifecycle(closed_stream(spark, sf))), out, scratch_path(spark, "checkpoint"))
    return spark.read.schema(cap.RECORD).parquet(out).where("event_id >= 0")


TRACK = views.with_views("v_track") + """,
s AS (SELECT sequence_id, frame_index, CASE WHEN x <= 60 THEN 'target' ELSE 'lost' END AS state FROM v_track), l AS (SELECT *, lag(state, 1, 'target') OVER (PARTITION BY sequence_id ORDER BY frame_index) AS was FROM s)
SELECT sequence_id, frame_index, state, CASE WHEN state = 'target' THEN CASE WHEN was = 'target' THEN 'tracked' ELSE 'reacquired' END ELSE CASE WHEN was = 'target' THEN 'lost' ELSE 'remain_lost' END END AS transition FROM l"""


@query("track_state_expiring", "R2 E6", TRACK)
def track_expiring(spark, sf):
    out = scratch_path(spark, "track-out")
    frames = events_stream(spark, sf).selectExpr("event_id div 250 AS sequence_id", "event_id % 250 AS frame_index", "value <= 60 AS accepted")
    with cap.timed_state(spark, idle_batches=False):
        cap.drain(cap.track_state_expiring(frames), out, scratch_path(spark, "checkpoint"))
    return spark.read.schema("sequence_id long, frame_index long, state string, transition string").parquet(out)


@query("track_state_stream", "R2 E6", views.with_views("v_track") + """,
s AS (SELECT sequence_id, frame_index, CASE WHEN x <= 60 THEN 'target' ELSE 'lost' END AS state FROM v_track), l AS (SELECT *, lag(state, 1, 'target') OVER (PARTITION BY sequence_id ORDER BY frame_index) AS was FROM s)
SELECT sequence_id, frame_index, state, CASE WHEN state = 'target' THEN CASE WHEN was = 'target' THEN 'tracked' ELSE 'reacquired' END ELSE CASE WHEN was = 'target' THEN 'lost' ELSE 'remain_lost' END END AS transition FROM l""")
def track_stream(spark, sf):
    out = scratch_path(spark, "track-out")
    frames = events_stream(spark, sf).selectExpr("event_id div 250 AS sequence_id", "event_id % 250 AS frame_index", "value <= 60 AS accepted")
    cap.drain(cap.track_state_stream(frames), out, scratch_path(spark, "checkpoint"))
    return spark.read.schema("sequence_id long, frame_index long, state string, transition string").parquet(out)


@query("capture_status_stream", "R3 A24", """
WITH r AS (SELECT user_id % 10 AS household_id, date_trunc('day', ts) AS d, event_id % 4 < 3 AS fin, event_id % 13 <> 0 AS ok, CASE event_id % 5 WHEN 0 THEN 'unknown' WHEN 1 THEN 'other' WHEN 2 THEN 'terminated' ELSE 'continued' END AS s, ts FROM events)
SELECT epoch_us(d) AS window_us, household_id, count(*) AS records, count(*) FILTER (WHERE fin) AS finalized_records, count(*) FILTER (WHERE fin AND ok) AS ready, count(*) FILTER (WHERE NOT ok) AS invalid,
 count(*) FILTER (WHERE fin AND ok AND s = 'terminated') AS terminated, count(*) FILTER (WHERE fin AND ok AND s = 'continued') AS continued, count(*) FILTER (WHERE fin AND ok AND s = 'unknown') AS unknown
FROM r GROUP BY 1, 2""")
def status_stream(spark, sf):
    out = scratch_path(spark, "status-out")
    r = closed_stream(spark, sf).selectExpr(
        "CAST(ts AS timestamp) AS ts", "user_id % 10 AS household_id", "event_id % 4 < 3 AS finalized", "event_id % 13 <> 0 AS valid",
        "CASE event_id % 5 WHEN 0 THEN 'unknown' WHEN 1 THEN 'other' WHEN 2 THEN 'terminated' ELSE 'continued' END AS outcome_state")
    cap.drain(cap.capture_status_stream(r), out, scratch_path(spark, "checkpoint"))
    got = spark.read.parquet(out)
    return got.select(F.unix_micros("window_start").alias("window_us"), *got.columns[1:])
