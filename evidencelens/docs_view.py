"""Nested episode documents derived row by row from the ``events`` table.

The same field definitions are rendered for Spark and for the SQL check; ``i`` is the array position.
Some rows break rules on purpose so that every contract has something to find.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from evidencelens.views import spread, table


def _render(dialect: str, text: str) -> str:
    spark = dialect == "spark"
    text = text.replace("$sha(", "sha2(" if spark else "sha256(")
    text = text.replace("$256)", ", 256)" if spark else ")")
    text = text.replace("$list(", "array(" if spark else "list_value(")
    text = text.replace("$us", "unix_micros(cast(ts AS timestamp))" if spark else "epoch_us(ts)")
    return text


def first_items(count: str, i: str, item: str, most: int, position: str) -> str:
    """The first ``count`` (1 to ``most``) of ``most`` items, each written out with its position in the place of ``i``.

    Written out they are compiled; in a lambda they would be interpreted, at several times the cost. The count goes through a lambda on
    purpose: a projection that has one is compiled in many small methods, where a whole stage would be one method too large for the JVM's compiler.
    """
    one = [re.sub(rf"\b{i}\b", position.format(k), item) for k in range(most)]
    items = ", ".join([one[0], *[f"CASE WHEN {count} > {k} THEN {x} END" for k, x in enumerate(one[1:], 1)]])
    return f"slice(array({items}), 1, aggregate(array(CAST({count} AS INT)), 0, (none, n) -> n))"


def array_of(dialect: str, count: str, fields: dict[str, str], most: int = 3) -> str:
    """Array of ``count`` (1 to ``most``) structs whose fields may use the position ``i``."""
    body = {k: _render(dialect, v) for k, v in fields.items()}
    if dialect == "spark":
        inner = ", ".join(f"'{k}', {v}" for k, v in body.items())
        return first_items(count, "i", f"named_struct({inner})", most, "{}L")
    inner = ", ".join(f"'{k}': {v}" for k, v in body.items())
    return f"list_transform(range(CAST({count} AS BIGINT)), lambda i: {{{inner}}})"


ISO = {
    "spark": "date_format(cast(ts AS timestamp) + make_interval(0,0,0,0,10,0,{s}), \"yyyy-MM-dd'T'HH:mm:ss\") || '+10:00'",
    "duckdb": "strftime(ts + INTERVAL 10 HOUR + to_seconds({s}), '%Y-%m-%dT%H:%M:%S') || '+10:00'",
}

ARRAYS = {
    "observations": ("(1 + event_id % 3)", {
        "observation_ref": "'o' || CAST(i % (CASE WHEN event_id % 29 = 0 THEN 1 ELSE 9 END) AS STRING)",
        "modality": "CASE (event_id + i) % 3 WHEN 0 THEN 'visual_pose' WHEN 1 THEN 'audio_vocalisation' ELSE 'object_environment' END",
        "schema_ref": "CASE WHEN event_id % 5 = 0 THEN 'other' ELSE 'pose-package-v1' END",
        "start_offset_ms": "i * 1000 * (CASE WHEN event_id % 4 = 0 THEN 0 ELSE 1 END)",
        "end_offset_ms": "i * 1000 + (event_id * 7) % 5500 - (CASE WHEN event_id % 22 = 0 THEN 2000 ELSE 0 END)",
        "artifact_sha256": "CASE WHEN (event_id + i) % 11 = 0 THEN 'bad' ELSE $sha(CAST(event_id * 10 + i AS STRING)$256) END",
        "package_event": "CASE WHEN (event_id + i) % 13 = 0 THEN event_id + 1 ELSE event_id END",
        "sample_count": "(event_id + i) % 17",
        "sidecar_version": "CASE WHEN (event_id + i) % 19 = 0 THEN 'v9' ELSE 'v0' END",
        "artifact_kind": "CASE WHEN (event_id + i) % 23 = 0 THEN 'audio_wav' ELSE 'pose_features_json' END",
        "local_path_included": "(event_id + i) % 29 = 0",
        "reservation_sha256": "CASE WHEN (event_id + i) % 31 = 0 THEN 'bad' ELSE $sha('r'$256) END",
        "sealed_record_sha256": "CASE WHEN (event_id + i) % 37 = 0 THEN NULL ELSE $sha('s'$256) END",
        "producer_sha256": "CASE WHEN (event_id + i) % 41 = 0 THEN 'zz' ELSE $sha('p'$256) END",
        "package_version": "CASE WHEN (event_id + i) % 43 = 0 THEN 'v9' ELSE 'v0' END",
        "package_episode": "CASE WHEN (event_id + i) % 47 = 0 THEN 'ep' ELSE 'ep' || CAST(event_id AS STRING) END",
        "package_subject": "CASE WHEN (event_id + i) % 53 = 0 THEN user_id + 1 ELSE user_id END",
        "package_sequence": "CASE WHEN (event_id + i) % 59 = 0 THEN '' ELSE 's1' END",
        "window_start_ms": "i * 1000 * (CASE WHEN event_id % 4 = 0 THEN 0 ELSE 1 END) + (CASE WHEN (event_id + i) % 61 = 0 THEN 1 ELSE 0 END)",
        "window_end_ms": "i * 1000 + (event_id * 7) % 5500 - (CASE WHEN event_id % 22 = 0 THEN 2000 ELSE 0 END)",
        "observation_count": "(event_id + i) % 67",
        "source_media_count": "(event_id + i) % 71",
        "captured_us": "$us + CASE WHEN (event_id + i) % 8 = 0 THEN 1 ELSE 0 END",
        "location": "CASE WHEN event_id % 14 = 3 THEN 'moved' WHEN event_id % 12 = 0 THEN NULL ELSE event_type END",
    }),
    "hypotheses": ("(1 + event_id % 3)", {
        "hypothesis_id": "'h' || CAST(i % (CASE WHEN event_id % 31 = 0 THEN 1 ELSE 9 END) AS STRING)",
        "probability": "CASE WHEN event_id % 37 = 0 THEN CAST('NaN' AS DOUBLE) ELSE CAST(1.0 AS DOUBLE) / (1 + event_id % 3) END",
    }),
    "human_actions": ("(1 + event_id % 2)", {
        "action_id": "'a' || CAST(i AS STRING)",
        "action_type": "CASE (event_id + i * 3) % 6 WHEN 0 THEN ' Serve-Meal' WHEN 1 THEN 'open door' WHEN 2 THEN 'pet contact' WHEN 3 THEN 'Play_Toy' WHEN 4 THEN 'meal toy' ELSE 'other' END",
        "offset_ms": "((event_id * 7 + i * 11) % 61) * 1000",
    }),
    "interventions": ("(1 + event_id % 2)", {
        "intervention_id": "'x' || CAST(CASE WHEN event_id % 41 = 1 THEN 0 ELSE i END AS STRING)",
        "action_ref": "'a' || CAST(CASE WHEN event_id % 27 = 0 THEN 9 ELSE i % (1 + event_id % 2) END AS STRING)",
        "candidates": "$list('h0', 'h' || CAST(event_id % (1 + event_id % 3) + (CASE WHEN event_id % 25 = 0 THEN 5 ELSE 0 END) AS STRING))",
        "predictions": "$list('h0', 'h' || CAST(event_id % (1 + event_id % 3) + (CASE WHEN event_id % 21 = 0 THEN 3 ELSE 0 END) AS STRING))",
    }),
    "outcomes": ("(1 + event_id % 2)", {
        "outcome_id": "'r' || CAST(CASE WHEN event_id % 43 = 1 THEN 0 ELSE i END AS STRING)",
        "outcome_type": "CASE WHEN event_id % 9 = 0 THEN 'unknown' WHEN event_id % 9 = 5 THEN 'other' ELSE 'signalling_termination' END",
        "signalling_terminated": "CASE WHEN (event_id + i) % 10 = 0 THEN NULL ELSE (event_id % 6 < 4 AND (i = 0 OR event_id % 7 > 0)) END",
        "start_offset_ms": "CASE WHEN event_id % 3 = 0 THEN 60000 ELSE 1000 * (event_id % 60) END",
        "end_offset_ms": "CASE WHEN event_id % 5 = 0 THEN NULL WHEN event_id % 3 = 0 THEN 60000 WHEN event_id % 33 = 1 THEN -1000 ELSE 1000 * (event_id % 60 + event_id % 4) END",
        "supports": "$list('h' || CAST(CASE WHEN event_id % 26 = 0 THEN 7 ELSE 0 END AS STRING))",
    }),
    "objects": ("(1 + event_id % 3)", {
        "object_type": "CASE (event_id + i) % 5 WHEN 0 THEN 'Door' WHEN 1 THEN 'soft toy' WHEN 2 THEN 'shelf' WHEN 3 THEN 'food-bowl' ELSE 'chair' END",
        "object_id": "CASE WHEN (event_id + i) % 7 = 0 THEN 'garden gate' ELSE 'obj' || CAST(i AS STRING) END",
        "open": "CASE WHEN (event_id + i) % 3 = 0 THEN NULL ELSE event_id % 2 = 0 END",
    }),
    "social": ("(1 + event_id % 3)", {
        "entity_type": "CASE (event_id + i) % 4 WHEN 0 THEN 'human' WHEN 1 THEN 'peer' WHEN 2 THEN 'human' ELSE 'other' END",
        "distance_m": "CASE WHEN (event_id + i) % 5 = 0 THEN NULL ELSE CAST((event_id * 3 + i) % 50 AS DOUBLE) / 10 END",
    }),
}

SCALARS = {
    "event_id": "event_id",
    "episode_id": "'ep' || CAST(event_id AS STRING)",
    "subject_id": "user_id",
    "household_id": "user_id % 10",
    "location": "CASE WHEN event_id % 12 = 0 THEN NULL ELSE event_type END",
    "start_us": "$us",
    "end_offset_ms": "CASE WHEN event_id % 19 = 0 THEN 4000 ELSE 60000 END",
    "missing_modalities": "CASE event_id % 4 WHEN 0 THEN $list('audio_vocalisation', 'thermal') WHEN 1 THEN $list('visual_pose', 'thermal') ELSE $list('thermal', 'radar') END",
    "schema_version": "CASE WHEN event_id % 47 = 0 THEN '0.0.9' ELSE '0.1.0' END",
}


def projection(dialect: str) -> list[str]:
    out = [f"{_render(dialect, v)} AS {k}" for k, v in SCALARS.items()]
    out.append(ISO[dialect].format(s="0") + " AS start_time")
    out.append(ISO[dialect].format(s="event_id % 23 - 1") + " AS end_time")
    out += [f"{array_of(dialect, n, fields)} AS {name}" for name, (n, fields) in ARRAYS.items()]
    return out


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "events")).selectExpr(*projection("spark"))


#: Rows on which an array is absent, as readers leave it.
ABSENT = {
    "observations": "event_id % 13 = 5", "hypotheses": "event_id % 17 = 3", "human_actions": "event_id % 2 = 1", "interventions": "event_id % 11 = 4", "outcomes": "event_id % 7 = 2",
    "missing_modalities": "event_id % 23 = 6", "objects": "event_id % 9 = 1", "social": "event_id % 8 = 2",
}


def sparse_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` with absent arrays."""
    return documents(spark, sf_dir).selectExpr("* EXCEPT (" + ", ".join(ABSENT) + ")", *(f"CASE WHEN NOT ({test}) THEN {c} END AS {c}" for c, test in ABSENT.items()))


SQL_DOCS = "WITH v_docs AS (SELECT " + ",\n ".join(projection("duckdb")) + " FROM events)"
_FULL = "WITH v_full AS (SELECT " + ",\n ".join(projection("duckdb")) + " FROM events), v_docs AS (SELECT * REPLACE ("
_SPARSE = ", ".join(f"CASE WHEN NOT ({test}) THEN {c} END AS {c}" for c, test in ABSENT.items())
SQL_SPARSE = f"{_FULL}{_SPARSE}) FROM v_full)"
#: Nested files carry start times to the second.
SQL_NESTED = f"{_FULL}{_SPARSE}, start_us // 1000000 * 1000000 AS start_us) FROM v_full)"
#: The same for feature rows, which take an absent array as an empty one.
_EMPTY = ", ".join(f"CASE WHEN {test} THEN {c}[1:0] ELSE {c} END AS {c}" for c, test in ABSENT.items())
SQL_SPARSE_EMPTY = f"{_FULL}{_EMPTY}) FROM v_full)"
SQL_NESTED_EMPTY = f"{_FULL}{_EMPTY}, start_us // 1000000 * 1000000 AS start_us) FROM v_full)"
