"""Episode documents and instance annotations from JSON."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidencelens.functions import iso_micros

LOCK_SUFFIX = "lock.json"

EPISODE_DDL = """
 schema_version string, event_id string, episode_id string, subject_id string, household_id string, session_id string,
 time struct<start_time: string, end_time: string, start_offset_ms: bigint, end_offset_ms: bigint, clock_source: string, uncertainty_ms: double>,
 observations array<struct<observation_ref: string, modality: string, schema_ref: string, record_ids: array<string>, source_uri: string, start_offset_ms: bigint, end_offset_ms: bigint, features: map<string, string>, uncertainty: map<string, string>>>,
 hypotheses array<struct<hypothesis_id: string, kind: string, label: string, state_ref: string, probability: double, source: string, calibration_model: string, evidence_refs: array<string>>>,
 human_actions array<struct<action_id: string, action_type: string, offset_ms: bigint, actor_id: string, target_id: string, parameters: map<string, string>>>,
 interventions array<struct<intervention_id: string, action_ref: string, candidate_hypotheses: array<string>, predictions: array<struct<hypothesis_ref: string, expected_response: string, response_window_ms: bigint>>, selection_policy: string, safety_class: string>>,
 outcomes array<struct<outcome_id: string, outcome_type: string, start_offset_ms: bigint, end_offset_ms: bigint, observation_source: string, description: string, signalling_terminated: boolean, supports_hypotheses: array<string>, contradicts_hypotheses: array<string>>>,
 context struct<location: string, objects: array<struct<object_id: string, object_type: string, state: map<string, string>, relation_to_subject: string>>, social: array<struct<entity_id: string, entity_type: string, relationship: string, distance_m: double, orientation: string>>,
   environment: map<string, string>, routine: map<string, string>>,
 missing_modalities array<string>,
 provenance struct<source_ids: array<string>, lineage: array<string>, annotation_source: string, annotator_ids: array<string>, software_versions: map<string, string>>,
 uncertainty struct<episode_confidence: double, notes: string>,
 privacy struct<data_class: string, consent_status: string, consent_record_id: string, retention_policy: string, contains_human_audio: boolean, contains_human_image: boolean>,
 notes string"""


def read_episodes(spark: SparkSession, path: str, schema: str = EPISODE_DDL, multi_line: bool = True) -> DataFrame:
    """Episode objects: one object or an array per file, or one object per line (``multi_line`` off).

    Line files are split between tasks; a multi-line file is read by one task, so large collections belong
    in many files or in lines.
    """
    return spark.read.schema(schema).option("multiLine", multi_line).json(path)


def flatten_episodes(docs: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Rows of ``read_episodes`` in the flat shape that validators and feature operators take; one row each, with the ``keep`` columns.

    Absent arrays stay NULL, so the contract can name them. A door's state is its ``open`` entry; the snapshot's own time and
    location are taken from an observation's features.
    """
    flag = lambda state: F.lower(F.try_element_at(state, F.lit("open"))).try_cast("boolean")
    stamp = lambda o: iso_micros(F.try_element_at(o["features"], F.lit("captured_at")))
    named = lambda x, *names: [x[n].alias(n) for n in names]
    return docs.select(
        *keep, "schema_version", "event_id", "episode_id", "subject_id", "household_id", "session_id", "missing_modalities",
        F.col("time.start_time").alias("start_time"), F.col("time.end_time").alias("end_time"), F.col("time.end_offset_ms").alias("end_offset_ms"),
        iso_micros(F.col("time.start_time")).alias("start_us"), F.col("context.location").alias("location"),
        F.transform("observations", lambda o: F.struct(*named(o, "observation_ref", "modality", "schema_ref", "start_offset_ms", "end_offset_ms"), stamp(o).alias("captured_us"),
                                                       F.try_element_at(o["features"], F.lit("location")).alias("location"))).alias("observations"),
        F.transform("hypotheses", lambda h: F.struct(*named(h, "hypothesis_id", "probability"))).alias("hypotheses"),
        F.transform("human_actions", lambda a: F.struct(*named(a, "action_id", "action_type", "offset_ms"))).alias("human_actions"),
        F.transform("interventions", lambda i: F.struct(*named(i, "intervention_id", "action_ref"), i["candidate_hypotheses"].alias("candidates"),
                                                        F.transform(i["predictions"], lambda p: p["hypothesis_ref"]).alias("predictions"))).alias("interventions"),
        F.transform("outcomes", lambda o: F.struct(*named(o, "outcome_id", "outcome_type", "signalling_terminated", "start_offset_ms", "end_offset_ms"),
                                                   F.array_compact(F.array_union(F.coalesce(o["supports_hypotheses"], F.array().cast("array<string>")), F.coalesce(o["contradicts_hypotheses"], F.array().cast("array<string>")))).alias("supports"))).alias("outcomes"),
        F.transform("context.objects", lambda o: F.struct(*named(o, "object_type", "object_id"), flag(o["state"]).alias("open"))).alias("objects"),
        F.transform("context.social", lambda s: F.struct(*named(s, "entity_type", "distance_m"))).alias("social"),
    )


def discover_episodes(spark: SparkSession, path: str, composer: str, schema: str = EPISODE_DDL, version: str = "0.1.0",
                      glob: str = "*.json", multi_line: bool = True) -> DataFrame:
    """Readable canonical and derived documents below ``path`` with their file and a ``derived`` flag.

    Lock files and unreadable JSON are skipped; a document needs the schema version and an event id. Capture
    folders hold one document per file; exports with one document per line set ``multi_line`` off.
    """
    raw = (spark.read.schema(f"{schema}, _corrupt_record string").option("recursiveFileLookup", True).option("pathGlobFilter", glob).option("mode", "PERMISSIVE")
           .option("multiLine", multi_line).json(path).select("*", F.col("_metadata.file_path").alias("file_path")))
    good = raw.where(~F.col("file_path").endswith(LOCK_SUFFIX) & F.col("_corrupt_record").isNull() & (F.col("schema_version") == version) & (F.coalesce("event_id", F.lit("")) != ""))
    stamp = F.try_element_at(F.col("provenance.software_versions"), F.lit(composer))
    return good.drop("_corrupt_record").withColumn("derived", F.coalesce(stamp != "", F.lit(False)))


ANNOTATIONS = """videos array<struct<id: bigint, width: int, height: int, length: int, file_names: array<string>>>,
 annotations array<struct<id: bigint, video_id: bigint, category_id: bigint, segmentations: array<struct<counts: array<bigint>>>, bboxes: array<array<double>>>>,
 categories array<struct<id: bigint, name: string>>"""


def read_instance_annotations(spark: SparkSession, path: str, category: str, multi_line: bool = True) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(videos, annotations of the one matching category, error rows) of every annotation file."""
    raw = spark.read.schema(ANNOTATIONS).option("multiLine", multi_line).json(path).withColumn("file", F.col("_metadata.file_path"))
    if not multi_line:
        raw = raw.withColumn("file", F.concat_ws("#", "file", F.xxhash64(F.to_json("videos")).cast("string")))
    return split_annotations(raw, category)


def split_annotations(raw: DataFrame, category: str, key: str = "file") -> tuple[DataFrame, DataFrame, DataFrame]:
    if not category.strip():
        raise ValueError("category name cannot be empty")
    wanted = F.filter("categories", lambda c: F.lower(F.trim(c["name"])) == category.strip().lower())
    videos = raw.select(key, F.explode("videos").alias("v")).select(key, "v.*")
    ann = raw.where(F.size(wanted) == 1).select(key, F.get(wanted, F.lit(0))["id"].alias("wanted_id"), F.explode("annotations").alias("a")).where("a.category_id = wanted_id").select(key, "a.*")
    heads = raw.select(key, F.explode(F.array_compact(F.array(
        *[F.when(F.col(c).isNull(), F.lit(f"missing_list:{c}")) for c in ("videos", "annotations", "categories")], F.when(F.size(wanted) != 1, F.lit("category_not_unique"))))).alias("error"), F.lit(None).cast("bigint").alias("id"))
    dup = lambda c, code: raw.select(key, F.explode(c).alias("x")).groupBy(key, "x.id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(key, F.lit(code).alias("error"), "id")
    return videos, ann, heads.unionByName(dup("videos", "duplicate_video_id")).unionByName(dup("annotations", "duplicate_annotation_id"))
