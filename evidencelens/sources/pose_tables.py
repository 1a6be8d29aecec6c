"""Wide and positional pose outputs to the long landmark table.

The struct array is built from column names, so no unpivot-then-pivot shuffle is needed.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidencelens.functions import finite_double


def wide_pose_to_long(df: DataFrame, columns: dict[tuple[str, str, str], str], keep: Sequence[str], frame: str, fps: float) -> DataFrame:
    """``columns`` maps (individual, bodypart, coord in x/y/likelihood) to a column; any scorer level is ignored.

    Points without finite x and y are dropped; a non-finite likelihood is 0, an absent one 1.
    """
    if fps <= 0:
        raise ValueError("fps must be positive")
    parts = sorted({(i, b) for i, b, _ in columns})

    def score(i: str, b: str) -> Column:
        name = columns.get((i, b, "likelihood"))
        return F.lit(1.0) if name is None else F.coalesce(finite_double(name), F.lit(0.0))

    points = [F.struct(F.lit(i).alias("individual"), F.lit(b).alias("native_name"),
                       finite_double(columns[i, b, "x"]).alias("x_px"), finite_double(columns[i, b, "y"]).alias("y_px"),
                       score(i, b).alias("score")) for i, b in parts]
    usable = F.filter(F.array(*points), lambda p: p["x_px"].isNotNull() & p["y_px"].isNotNull())
    return df.select(*keep, frame, (F.col(frame) / F.lit(float(fps))).alias("timestamp_s"), F.explode(usable).alias("p")).select(
        *keep, frame, "timestamp_s", "p.*")


def wide_pose3d_to_long(df: DataFrame, columns: dict[tuple[str, str, str], str], keep: Sequence[str], frame: str,
                        coordinate_frame: str) -> DataFrame:
    """x/y/z columns of exactly one individual."""
    individuals = {i for i, _, _ in columns}
    if len(individuals) != 1:
        raise ValueError(f"3D tables hold one individual, found {len(individuals)}")
    parts = sorted({(i, b) for i, b, _ in columns})
    points = [F.struct(F.lit(b).alias("native_name"), *[finite_double(columns[i, b, c]).alias(c) for c in ("x", "y", "z")])
              for i, b in parts]
    usable = F.filter(F.array(*points), lambda p: p["x"].isNotNull() & p["y"].isNotNull() & p["z"].isNotNull())
    return df.select(*keep, frame, F.explode(usable).alias("p")).select(
        *keep, frame, "p.*", F.lit(coordinate_frame).alias("coordinate_frame"))


def detections_to_keypoints(df: DataFrame, names: Sequence[str], keep: Sequence[str], points: str = "keypoints",
                            scores: str = "keypoint_scores") -> tuple[DataFrame, DataFrame]:
    """(named keypoint rows, rows with ``errors``) from positional arrays."""
    n = len(names)
    errors = F.array_compact(F.array(
        F.when(F.size(points) != n, F.lit("keypoint_count_differs_from_names")),
        F.when((F.size(scores) != 0) & (F.size(scores) != F.size(points)), F.lit("score_count_differs_from_keypoints"))))
    checked = df.withColumn("errors", errors)
    zipped = F.arrays_zip(F.array(*[F.lit(x) for x in names]).alias("name"), F.col(points).alias("xy"), F.col(scores).alias("score"))
    rows = checked.where(F.size("errors") == 0).select(*keep, F.posexplode(zipped).alias("pos", "p")).select(
        *keep, "pos", F.col("p")["name"].alias("name"), F.col("p")["xy"][0].alias("x_px"), F.col("p")["xy"][1].alias("y_px"),
        F.coalesce(F.col("p")["score"], F.lit(1.0)).alias("score"))
    return rows, checked.where(F.size("errors") > 0).select(*keep, "errors")
