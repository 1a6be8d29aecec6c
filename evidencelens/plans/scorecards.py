"""Sequence scorecard: every landmark metric of a sequence as tidy rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidencelens.operators import keypoints as kp
from evidencelens.session import materialise


def validate_sequences(frames: DataFrame, width: str, height: str, keys: Sequence[str] = kp.SEQ) -> DataFrame:
    """Rows per sequence with ``errors``: contiguous unique frame index, positive diagonal."""
    g = frames.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("frame_index").alias("u"),
        F.min("frame_index").alias("lo"), F.max("frame_index").alias("hi"),
        F.min(F.hypot(F.col(width).cast("double"), F.col(height).cast("double"))).alias("diag"))
    return g.select(*keys, F.col("n").alias("n_frames"), F.array_compact(F.array(
        F.when((F.col("u") != F.col("n")) | (F.col("hi") - F.col("lo") + 1 != F.col("n")), F.lit("frame_index_not_contiguous")),
        F.when(~(F.col("diag") > 0), F.lit("diagonal_not_positive")))).alias("errors"))


def sequence_scorecard(points: DataFrame, frames: DataFrame, *, diagonal: float, edges, depth_pairs, required,
                       keys: Sequence[str] = kp.SEQ, min_score: float = kp.MIN_SCORE) -> DataFrame:
    """Coverage, dropout, curvature, bones, depth flips, topology and latency, keyed by sequence.

    The kept keypoints are shuffled three times: by name for everything about presence, by name with neighbours for curvature, and by frame, where
    all declared pairs meet at once. What these leave is a row per name or pair and frame, and feeds the rest.
    """
    kept = materialise(kp.confident_keypoints(points, min_score, keys), "keypoints")
    frames = materialise(frames, "frames")
    counts = materialise(kp.frame_counts(frames, keys), "frame-counts")
    facts = materialise(kp.name_facts(kept, counts, keys), "names")
    met = materialise(kp.landmark_pairs(kept, list(dict.fromkeys([*edges, *depth_pairs])), keys), "pairs")
    edge_name = F.concat_ws("--", "a", "b")
    parts = [
        kp.tidy(facts, keys, "name", ["coverage", "dropout_runs", "bounded_recoveries", "max_dropout_frames", "mean_bounded_frames"]),
        kp.tidy(kp.pooled_coverage(facts, keys).withColumnRenamed("coverage", "overall_coverage"), keys, None, ["n_names", "overall_coverage"]),
        kp.tidy(kp.motion_curvature(kept, diagonal, keys), keys, None, ["mean_curvature", "spike_rate", "samples"]),
        kp.tidy(kp.bone_length_stability(kept, edges, counts, keys, met).withColumn("edge", edge_name), keys, "edge", ["samples", "mean_length", "cv"]),
        kp.tidy(kp.sign_flips(kept, depth_pairs, keys, met).withColumn("pair", edge_name).withColumnRenamed("samples", "flip_samples"), keys, "pair", ["flip_samples", "flips"]),
        kp.tidy(kp.topology_coverage(facts, required, counts, keys).withColumnRenamed("coverage", "group_coverage"), keys, "required_group", ["group_coverage"]),
        kp.tidy(kp.latency_summary(frames, keys), keys, None, ["mean_ms", "p95_ms", "fps"]),
    ]
    return kp.stack(parts)
