"""Contracts of whole records as they are read: the declared schema first, then the rules between fields, then the snapshot at time zero."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidencelens.functions import iso_micros
from evidencelens.operators.contracts import rule, rules, validate_plans, with_episode_errors
from evidencelens.operators.record_schemas import EPISODE, PLAN
from evidencelens.operators.schemas import Free, Items, Record, ddl, with_problems
from evidencelens.sources.documents import flatten_episodes

#: What a time-zero snapshot says of itself, and the parts of the context that it repeats.
SNAPSHOT_MODALITY, SNAPSHOT_SCHEMA = "object_environment", "context/ct1_context_snapshot.schema.json"
SNAPSHOT_FIELDS = ("location", "objects", "social", "environment")


def validate_documents(docs: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Flat rows of nested episode documents with ``errors``: broken schema rules, or, for a sound record, broken rules between its fields."""
    staged = with_problems(docs, EPISODE, "__schema")
    flat = with_episode_errors(flatten_episodes(staged, [*keep, "__schema"]), "__deep")
    return flat.withColumn("errors", F.when(F.size("__schema") > 0, F.col("__schema")).otherwise(F.col("__deep"))).drop("__schema", "__deep")


def validate_plan_documents(plans: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Prospective plans as nested records: broken schema rules, or, for a sound plan, broken rules between its fields."""
    entry = lambda name: F.try_element_at(F.col("action.parameters"), F.lit(name))
    flag = lambda name: F.lower(entry(name)).try_cast("boolean")
    flat = with_problems(plans, PLAN, "__schema").select(
        *keep, "__schema", "plan_id", "event_id", "phase", "recorded_offset_ms", F.col("action.scheduled_offset_ms").alias("scheduled_offset_ms"),
        F.col("action.action_type").alias("action_type"), "hypotheses", F.transform("predictions", lambda p: p["hypothesis_ref"]).alias("predictions"),
        flag("feeding_due").alias("feeding_due"), flag("necessary_care_pending").alias("care_pending"), entry("duration_ms").try_cast("long").alias("duration_ms"),
        F.coalesce("selection_policy", F.lit("naturalistic")).alias("policy"))
    checked = validate_plans(flat)
    return checked.withColumn("errors", F.when(F.size("__schema") > 0, F.col("__schema")).otherwise(F.col("errors"))).drop("__schema")


# ---- the snapshot --------------------------------------------------------------------------------


def canonical(spec: object, v: Column) -> Column:
    """``v`` in a form that can be compared: free objects as sorted entries whose nested values are JSON with sorted keys."""
    if isinstance(spec, Record):
        return F.when(v.isNotNull(), F.struct(*[canonical(s, v[n]).alias(n) for n, s in spec.fields.items()]))
    if isinstance(spec, Items):
        return F.transform(v, lambda x: canonical(spec.of, x))
    if isinstance(spec, Free):
        value = lambda e: F.struct(e["key"].alias("key"), F.coalesce(F.to_json(F.try_parse_json(e["value"])), e["value"]).alias("value"))
        return F.array_sort(F.transform(F.map_entries(v), value))
    return v


def _context_specs() -> dict:
    fields = EPISODE.fields["context"].fields
    return {n: fields[n] for n in SNAPSHOT_FIELDS}


def _said(features: Column, name: str, spec: object) -> Column:
    """A part of the context as the snapshot's features state it, in the type of the context."""
    text = F.try_element_at(features, F.lit(name))
    return F.from_json(text, ddl(spec)) if isinstance(spec, (Items, Record, Free)) else text


def with_snapshot(docs: DataFrame) -> DataFrame:
    """``__shots`` (how many snapshots) and, where there is exactly one, ``__shot``: its reference, offsets, time and context parts."""
    shots = F.filter("observations", lambda o: (o["modality"] == SNAPSHOT_MODALITY) & (o["schema_ref"] == SNAPSHOT_SCHEMA))
    staged = docs.withColumn("__all", F.coalesce(shots, F.array().cast(docs.schema["observations"].dataType)))
    one = F.get("__all", F.lit(0))
    parts = [_said(one["features"], n, s).alias(n) for n, s in _context_specs().items()]
    shot = F.struct(one["observation_ref"].alias("ref"), one["start_offset_ms"].alias("start"), one["end_offset_ms"].alias("end"), one["features"].isNotNull().alias("filled"),
                    iso_micros(F.try_element_at(one["features"], F.lit("captured_at"))).alias("captured_us"), *parts)
    return staged.withColumns({"__shots": F.size("__all"), "__shot": F.when(F.size("__all") == 1, shot)}).drop("__all")


def _differs(name: str, spec: object) -> Column:
    """Whether the snapshot and the context disagree in a part; an absent environment is an empty one."""
    empty = lambda v: F.coalesce(v, F.array().cast("array<struct<key:string,value:string>>")) if isinstance(spec, Free) else v
    return ~empty(canonical(spec, F.col("__shot")[name])).eqNullSafe(empty(canonical(spec, F.col("context")[name])))


def validate_capture_documents(docs: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Episode rules plus exactly one snapshot at time zero that equals the context in location, objects, social entities and environment."""
    shot = F.col("__shot")
    staged = with_snapshot(docs)
    own = F.when(F.col("__shots") != 1, F.array(F.lit("snapshot_count_not_one"))).otherwise(rules(
        rule("snapshot_not_at_zero", (shot["start"] != 0) | (shot["end"] != 0)), rule("snapshot_without_features", ~shot["filled"]),
        rule("captured_at_differs", shot["filled"] & ~shot["captured_us"].eqNullSafe(iso_micros(F.col("time")["start_time"]))),
        *[rule(f"snapshot_{n}_differs", shot["filled"] & _differs(n, s)) for n, s in _context_specs().items()]))
    checked = validate_documents(staged.withColumn("__own", own), [*keep, "__own"])
    return checked.withColumn("errors", F.array_sort(F.concat("errors", "__own"))).drop("__own")


def snapshot_contexts(docs: DataFrame) -> DataFrame:
    """Nested documents whose context is the snapshot's: what was recorded at time zero stands for what was written later.

    Documents without exactly one snapshot are left out; ``context.routine`` is not part of a snapshot and becomes NULL.
    """
    staged = with_snapshot(docs).where(F.col("__shot").isNotNull())
    empty = F.create_map().cast("map<string,string>")
    parts = [F.coalesce(F.col("__shot")[n], empty).alias(n) if n == "environment" else F.col("__shot")[n].alias(n) for n in SNAPSHOT_FIELDS]
    routine = F.lit(None).cast("map<string,string>").alias("routine")
    return staged.withColumn("context", F.struct(*parts, routine)).drop("__shots", "__shot")
