"""Landmark sequences: selection, coverage, dropout, motion, pairs and scorecards.

Input is a long table ``(sequence keys…, frame_index, pos, name, x_px, y_px, z, score, …)``.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evidencelens.functions import dist2, dist3, finite_double
from evidencelens.operators.quantiles import exact_quantiles
from evidencelens.operators.segments import FRAME_BLOCK, adjacent_summary, first_per_key, gap_summary, ranked, running, segment_of, with_neighbours

SEQ = ("sequence_id",)
MIN_SCORE = 0.2
SPIKE = 0.03


def canonical_names(df: DataFrame, mapping: dict[str, str], native: str = "native_name") -> DataFrame:
    """Native to canonical landmark name; unmapped or blank keeps the native one."""
    table = F.create_map(*[F.lit(v) for kv in mapping.items() for v in kv]) if mapping else F.lit(None)
    mapped = F.nullif(F.try_element_at(table, F.col(native)), F.lit("")) if mapping else F.lit(None).cast("string")
    return df.withColumn("name", F.coalesce(mapped, F.col(native)))


def confident_keypoints(df: DataFrame, min_score: float = MIN_SCORE, keys: Sequence[str] = SEQ) -> DataFrame:
    """Score at or above the threshold (missing score counts 1.0, NaN is below any); the last kept duplicate wins."""
    kept = df.where((F.coalesce("score", F.lit(1.0)) >= min_score) & ~F.isnan(F.coalesce("score", F.lit(1.0))))
    rest = [c for c in df.columns if c not in (*keys, "frame_index", "name")]
    return first_per_key(kept, [*keys, "frame_index", "name"], [-F.col("pos")], rest)


def stride_sample(frames: DataFrame, stride: int, max_frames: int | None, fps: float, keys: Sequence[str] = SEQ,
                  frame: str = "frame_index") -> DataFrame:
    """Every ``stride``-th source frame, re-indexed from 0 without gaps, original timestamp kept."""
    if stride < 1:
        raise ValueError("stride must be at least 1")
    if fps <= 0:
        raise ValueError("fps must be positive")
    kept = frames.where(F.col(frame) % stride == 0).withColumns({"source_frame": F.col(frame), "timestamp_s": F.col(frame) / F.lit(float(fps))})
    out = ranked(kept, keys, segment_of("source_frame", FRAME_BLOCK * stride), ["source_frame"], "__rank")
    out = out.withColumn(frame, F.col("__rank") - 1).drop("__rank")
    return out.where(F.col(frame) < max_frames) if max_frames is not None else out


def frame_counts(frames: DataFrame, keys: Sequence[str] = SEQ) -> DataFrame:
    """Frames per sequence with the bounds used for leading and trailing gaps."""
    return frames.groupBy(*keys).agg(
        F.count_distinct("frame_index").alias("n_frames"),
        F.min("frame_index").alias("lo"), F.max("frame_index").alias("hi"),
    )


def coverage(kept: DataFrame, frames: DataFrame, keys: Sequence[str] = SEQ) -> DataFrame:
    """Share of frames holding each keypoint. ``kept`` is unique per (frame, name)."""
    present = kept.groupBy(*keys, "name").agg(F.count(F.lit(1)).alias("present"))
    return present.join(frame_counts(frames, keys), list(keys)).select(
        *keys, "name", "present", (F.col("present") / F.col("n_frames")).alias("coverage"), "n_frames")


def overall_coverage(kept: DataFrame, frames: DataFrame, keys: Sequence[str] = SEQ) -> DataFrame:
    """Present / (distinct observed names x frames); a never-seen landmark does not lower it."""
    return pooled_coverage(coverage(kept, frames, keys), keys)


def pooled_coverage(per: DataFrame, keys: Sequence[str] = SEQ) -> DataFrame:
    """``overall_coverage`` from the coverage of each name."""
    return per.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_names"),
        (F.sum("present") / (F.count(F.lit(1)) * F.max("n_frames"))).alias("coverage"),
    )


def name_facts(kept: DataFrame, counts: DataFrame, keys: Sequence[str] = SEQ) -> DataFrame:
    """Everything about a keypoint's presence in one pass over its frames: present, coverage and absent runs. ``counts``: see ``frame_counts``."""
    gaps = gap_summary(kept.select(*keys, "name", "frame_index"), [*keys, "name"], "frame_index")
    j = gaps.join(counts, list(keys))
    lead = F.col("first_frame_index") - F.col("lo")
    trail = F.col("hi") - F.col("last_frame_index")
    bounded = F.coalesce("bounded_gaps", F.lit(0))
    return j.select(
        *keys, "name", F.col("n_rows").alias("present"), (F.col("n_rows") / F.col("n_frames")).alias("coverage"), "n_frames",
        (bounded + (lead > 0).cast("long") + (trail > 0).cast("long")).cast("long").alias("dropout_runs"),
        bounded.cast("long").alias("bounded_recoveries"),
        F.greatest(F.coalesce("max_gap", F.lit(0)), lead, trail).cast("long").alias("max_dropout_frames"),
        F.when(bounded > 0, F.col("bounded_frames") / bounded).otherwise(F.lit(0.0)).alias("mean_bounded_frames"),
    )


def dropout_runs(kept: DataFrame, frames: DataFrame, keys: Sequence[str] = SEQ) -> DataFrame:
    """Absent runs per keypoint: all, bounded on both sides, longest, mean bounded length."""
    return name_facts(kept, frame_counts(frames, keys), keys).drop("present", "coverage", "n_frames")


def motion_curvature(kept: DataFrame, diagonal: Column | float, keys: Sequence[str] = SEQ, spike: float = SPIKE) -> DataFrame:
    """Normalised second difference over three consecutive frames: mean, spike rate, samples."""
    d = F.lit(float(diagonal)) if isinstance(diagonal, (int, float)) else diagonal
    n = with_neighbours(kept, [*keys, "name"], "frame_index", ["x_px", "y_px"])
    p, q = F.col("prev"), F.col("next")
    bend = F.hypot(q["x_px"] - 2 * F.col("x_px") + p["x_px"], q["y_px"] - 2 * F.col("y_px") + p["y_px"]) / d
    both = n.withColumn("curvature", F.when(p.isNotNull() & q.isNotNull(), bend))
    return both.groupBy(*keys).agg(
        F.avg("curvature").alias("mean_curvature"),
        F.avg((F.col("curvature") > spike).cast("double")).alias("spike_rate"),
        F.count("curvature").alias("samples"),
    )


def latency_summary(frames: DataFrame, keys: Sequence[str], latency: str = "inference_ms") -> DataFrame:
    """Mean, nearest-rank p95 and frames per second; timing scope belongs in ``keys``."""
    f = frames.withColumn("__ms", F.coalesce(F.col(latency).cast("double"), F.lit(0.0)))
    mean = f.groupBy(*keys).agg(F.avg("__ms").alias("mean_ms"), F.count(F.lit(1)).alias("n_frames"))
    p95 = exact_quantiles(f, keys, "__ms", {"p95_ms": (0.95, "nearest")})
    return mean.join(p95, list(keys)).withColumn("fps", F.when(F.col("mean_ms") > 0, 1000.0 / F.col("mean_ms")))


def pair_table(spark: SparkSession, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """Small declared table of landmark pairs."""
    return spark.createDataFrame([(a, b) for a, b in pairs], "a string, b string")


def landmark_pairs(kept3d: DataFrame, pairs: Sequence[tuple[str, str]], keys: Sequence[str] = SEQ) -> DataFrame:
    """Both landmarks of each declared pair in one frame and one coordinate frame.

    One aggregate per frame gathers the declared landmarks by name (a frame holds each once), so both
    sides meet without a self-join.
    """
    wanted = sorted({n for p in pairs for n in p})
    point = F.struct("x_px", "y_px", "z", "coordinate_frame")
    frames = kept3d.where(F.col("name").isin(*wanted)).groupBy(*keys, "frame_index").agg(
        *[F.max(F.when(F.col("name") == n, point)).alias(f"p_{i}") for i, n in enumerate(wanted)])
    at = {n: f"p_{i}" for i, n in enumerate(wanted)}
    rows = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(at[a]).alias("pa"), F.col(at[b]).alias("pb"))
                     for a, b in pairs])
    out = frames.select(*keys, "frame_index", F.explode(rows).alias("r")).select(*keys, "frame_index", "r.*")
    return out.where("pa IS NOT NULL AND pb IS NOT NULL AND pa.coordinate_frame = pb.coordinate_frame")


def _declared(pairs: DataFrame, wanted: Sequence[tuple[str, str]]) -> DataFrame:
    """Rows of ``landmark_pairs`` that belong to the wanted pairs."""
    return pairs.where(F.concat_ws("|", "a", "b").isin(*[f"{a}|{b}" for a, b in wanted]))


def bone_length_stability(kept3d: DataFrame, edges: Sequence[tuple[str, str]], sequences: DataFrame,
                          keys: Sequence[str] = SEQ, met: DataFrame | None = None) -> DataFrame:
    """Per edge: samples, mean length, population coefficient of variation; listed even at n = 0. ``met``: pairs that have met already."""
    p = landmark_pairs(kept3d, edges, keys) if met is None else _declared(met, edges)
    length = dist3(*[F.col(f"pa.{c}") for c in ("x_px", "y_px", "z")], *[F.col(f"pb.{c}") for c in ("x_px", "y_px", "z")])
    stats = p.withColumn("len", length).groupBy(*keys, "a", "b").agg(
        F.count(F.lit(1)).alias("n"), F.avg("len").alias("m"), F.stddev_pop("len").alias("s"))
    every = sequences.select(*keys).distinct().select(
        *keys, F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in edges])).alias("e")
    ).select(*keys, "e.a", "e.b")
    j = every.join(stats, [*keys, "a", "b"], "left")
    return j.select(*keys, "a", "b", F.coalesce("n", F.lit(0)).cast("long").alias("samples"), F.col("m").alias("mean_length"),
                    F.when(F.col("n").isNull(), F.lit(None).cast("double"))
                    .when((F.col("n") > 1) & (F.col("m") > 0), F.col("s") / F.col("m")).otherwise(F.lit(0.0)).alias("cv"))


def sign_flips(kept3d: DataFrame, pairs: Sequence[tuple[str, str]], keys: Sequence[str] = SEQ, met: DataFrame | None = None) -> DataFrame:
    """Changes of depth order along each declared pair, ignoring near-ties. ``met``: pairs that have met already."""
    p = (landmark_pairs(kept3d, pairs, keys) if met is None else _declared(met, pairs)).withColumn("d", F.col("pa.z") - F.col("pb.z")).where(F.abs("d") > 1e-8)
    signed = p.withColumn("sign", F.when(F.col("d") > 0, 1).otherwise(-1))
    out = adjacent_summary(
        signed, [*keys, "a", "b"], "frame_index", ["sign"],
        pair_sums={"flips": lambda u, v: (u["sign"] != v["sign"]).cast("long")},
    )
    return out.select(*keys, "a", "b", F.col("n_rows").alias("samples"), F.coalesce("flips", F.lit(0)).cast("long").alias("flips"))


def topology_coverage(kept: DataFrame, required: dict[str, Sequence[str]], sequences: DataFrame,
                      keys: Sequence[str] = SEQ, curve_group: str = "tail", minimum_curve: int = 3) -> DataFrame:
    """Per required group: present and missing names, share hit; curve capability for one group.

    The names seen per sequence are reduced to one row with a flag per required name.
    """
    wanted = sorted({n for names in required.values() for n in names})
    flags = [F.max((F.col("name") == n).cast("int")).alias(f"h_{i}") for i, n in enumerate(wanted)]
    seen = kept.where(F.col("name").isin(*wanted)).groupBy(*keys).agg(*flags)
    seen = sequences.select(*keys).distinct().join(seen, list(keys), "left")
    at = {n: F.coalesce(F.col(f"h_{i}"), F.lit(0)) == 1 for i, n in enumerate(wanted)}
    groups = []
    for group, names in required.items():
        names = sorted(set(names))
        present = F.array_compact(F.array(*[F.when(at[n], F.lit(n)) for n in names])) if names else F.array().cast("array<string>")
        missing = F.array_compact(F.array(*[F.when(~at[n], F.lit(n)) for n in names])) if names else F.array().cast("array<string>")
        share = F.size(present) / F.lit(len(names)) if names else F.lit(1.0)
        ok = F.size(present) >= minimum_curve if group == curve_group else F.lit(None).cast("boolean")
        groups.append(F.struct(F.lit(group).alias("required_group"), present.alias("present"), missing.alias("missing"),
                               share.alias("coverage"), ok.alias("curve_capable")))
    return seen.select(*keys, F.explode(F.array(*groups)).alias("g")).select(*keys, "g.*")


def consecutive_steps(track: DataFrame, diagonal: float, keys: Sequence[str] = SEQ) -> DataFrame:
    """Normalised displacement where the previous visible frame is exactly one earlier."""
    vis = track.where("visible")
    n = with_neighbours(vis, keys, "frame_index", ["x", "y"])
    return n.where("prev IS NOT NULL").select(
        *keys, "frame_index", (dist2("x", "y", F.col("prev.x"), F.col("prev.y")) / F.lit(float(diagonal))).alias("step"))


def internal_gaps(track: DataFrame, keys: Sequence[str] = SEQ, block: int = 4096) -> DataFrame:
    """One row per absence strictly between two visible frames."""
    vis = track.where("visible").select(*keys, "frame_index")
    ran = running(vis, keys, segment_of("frame_index", block), ["frame_index"],
                  lasts={"before": F.col("frame_index")}, inclusive=False)
    return ran.where(F.col("frame_index") - F.col("before") > 1).select(
        *keys, F.col("before").alias("after_frame"), (F.col("frame_index") - F.col("before") - 1).alias("gap"))


def track_state(frames: DataFrame, gate: Column, keys: Sequence[str] = SEQ, block: int = 4096) -> DataFrame:
    """TARGET/LOST from the gate of each frame and the transition from the previous record."""
    s = frames.withColumn("state", F.when(gate, F.lit("target")).otherwise(F.lit("lost")))
    ran = running(s, keys, segment_of("frame_index", block), ["frame_index"], lasts={"was": F.col("state")}, inclusive=False)
    was = F.coalesce("was", F.lit("target"))
    return ran.select(
        *keys, "frame_index", "state",
        F.when(F.col("state") == "target", F.when(was == "target", "tracked").otherwise("reacquired"))
        .otherwise(F.when(was == "target", "lost").otherwise("remain_lost")).alias("transition"))


def monotone_check(df: DataFrame, keys: Sequence[str], pos: str, cols: Sequence[str]) -> DataFrame:
    """Per key: number of steps back in each column along ``pos`` and repeated positions."""
    back = {f"{c}_steps_back": (lambda p, q, c=c: (q[c] < p[c]).cast("long")) for c in cols}
    back["repeated"] = lambda p, q: (q[pos] == p[pos]).cast("long")
    out = adjacent_summary(df, keys, pos, cols, pair_sums=back)
    return out.select(*keys, F.col("n_rows").alias("n"), *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in back])


def finite_differences(track: DataFrame, fps: float, keys: Sequence[str] = SEQ) -> DataFrame:
    """Central velocity and second difference over dt squared on interior samples."""
    n = with_neighbours(track, keys, "frame_index", ["x", "y"]).where("prev IS NOT NULL AND next IS NOT NULL")
    dt = F.lit(1.0 / fps)
    return n.select(*keys, "frame_index", *[
        e.alias(a) for c in ("x", "y") for e, a in (
            ((F.col(f"next.{c}") - F.col(f"prev.{c}")) / (2 * dt), f"v{c}"),
            ((F.col(f"next.{c}") - 2 * F.col(c) + F.col(f"prev.{c}")) / (dt * dt), f"a{c}"))])


def contact_slide(track: DataFrame, contacts: DataFrame, keys: Sequence[str], block: int = 4096) -> DataFrame:
    """Path length of a landmark inside each contact interval ``[start_frame, end_frame]``.

    A difference of two running path lengths: every contact adds two probes to the timeline of its
    landmark, so no interval join multiplies rows.
    """
    steps = with_neighbours(track, keys, "frame_index", ["x", "y"])
    moved = steps.select(*keys, F.col("frame_index").alias("t"), F.lit(0).alias("kind"),
                         F.coalesce(dist2("x", "y", F.col("prev.x"), F.col("prev.y")), F.lit(0.0)).alias("step"),
                         F.lit(None).cast("long").alias("contact_id"), F.lit(None).cast("string").alias("side"))
    probes = contacts.where("start_frame <= end_frame").select(*keys, "contact_id", F.explode(F.array(
        F.struct(F.col("start_frame").alias("t"), F.lit("a").alias("side")),
        F.struct(F.col("end_frame").alias("t"), F.lit("b").alias("side")))).alias("p")).select(
        *keys, F.col("p.t").alias("t"), F.lit(1).alias("kind"), F.lit(0.0).alias("step"), "contact_id", "p.side")
    ran = running(moved.unionByName(probes), keys, segment_of("t", block), ["t", "kind", "contact_id", "side"],
                  sums={"path": F.col("step")}).where("kind = 1")
    return ran.groupBy(*keys, "contact_id").agg(
        (F.max(F.when(F.col("side") == "b", F.col("path"))) - F.max(F.when(F.col("side") == "a", F.col("path")))).alias("slide"))


def best_individual(kp: DataFrame, keys: Sequence[str] = SEQ) -> DataFrame:
    """Individual with the highest mean finite likelihood per frame; ties go to the greatest name."""
    ok = F.when(~F.isnan("score") & (F.abs("score") < float("inf")), F.col("score"))
    mean = kp.groupBy(*keys, "frame_index", "individual").agg(F.coalesce(F.avg(ok), F.lit(float("-inf"))).alias("mean_score"))
    best = mean.groupBy(*keys, "frame_index").agg(F.max(F.struct("mean_score", "individual")).alias("b"))
    return best.select(*keys, "frame_index", "b.individual", "b.mean_score")


def best_instance(det: DataFrame, keys: Sequence[str] = SEQ) -> DataFrame:
    """Detection with the highest mean keypoint score, else box score, else 0; the first wins ties."""
    total = F.aggregate("keypoint_scores", F.lit(0.0), lambda a, s: a + s)
    mean = F.when(F.size("keypoint_scores") > 0, total / F.size("keypoint_scores"))
    s = det.withColumn("instance_score", F.coalesce(mean, F.col("bbox_score"), F.lit(0.0)))
    return first_per_key(s, [*keys, "frame_index"], [-F.col("instance_score"), F.col("pos")], ["pos", "instance_score"])


def frame_candidates(kp: DataFrame, keys: Sequence[str] = SEQ, min_score: float = 0.5) -> DataFrame:
    """Per individual and frame: scores, confident count, box and centroid of confident points, rank.

    The rank window covers the few individuals of one frame.
    """
    score = finite_double("score")
    high = F.coalesce(score >= min_score, F.lit(False))
    g = kp.groupBy(*keys, "frame_index", "individual").agg(
        F.avg(score).alias("mean_score"), F.count_if(high).alias("n_confident"),
        *[f(F.when(high, F.col(c))).alias(a) for f, c, a in (
            (F.min, "x_px", "x0"), (F.min, "y_px", "y0"), (F.max, "x_px", "x1"), (F.max, "y_px", "y1"),
            (F.avg, "x_px", "cx"), (F.avg, "y_px", "cy"))],
    ).where("n_confident > 0")
    w = Window.partitionBy(*keys, "frame_index").orderBy(F.desc("n_confident"), F.desc("mean_score"), F.desc("individual"))
    return g.withColumn("rank", F.row_number().over(w).cast("long"))


def candidate_layer_summary(candidates: DataFrame, frames: DataFrame, keys: Sequence[str] = SEQ) -> DataFrame:
    """Frames with two or more, one and no candidates; feasible when any frame has two."""
    n = candidates.groupBy(*keys, "frame_index").agg(F.count(F.lit(1)).alias("n"))
    j = frames.select(*keys, "frame_index").distinct().join(n, [*keys, "frame_index"], "left")
    n = F.coalesce("n", F.lit(0))
    return j.groupBy(*keys).agg(
        F.count_if(n >= 2).alias("frames_multiple"), F.count_if(n == 1).alias("frames_single"),
        F.count_if(n == 0).alias("frames_none"), (F.count_if(n >= 2) > 0).alias("feasible"))


def select_keyframe(kp: DataFrame, ends: tuple[str, str], diagonal: float, keys: Sequence[str] = SEQ,
                    min_score: float = MIN_SCORE, separation: float = 0.03) -> DataFrame:
    """Frame with both ends confident and apart, by (weaker score, separation); earliest wins ties. Values that are not finite are absent."""
    a, b = ends
    pick = lambda n, c: F.max(F.when(F.col("name") == n, finite_double(c)))
    f = kp.where(F.col("name").isin(a, b)).groupBy(*keys, "frame_index").agg(
        pick(a, "score").alias("sa"), pick(b, "score").alias("sb"), *[pick(n, c).alias(f"{c}_{t}") for n, t in ((a, "a"), (b, "b")) for c in ("x_px", "y_px")])
    f = f.withColumns({"weakest": F.least("sa", "sb"), "separation": dist2("x_px_a", "y_px_a", "x_px_b", "y_px_b") / F.lit(float(diagonal))})
    ok = f.where((F.col("sa") >= min_score) & (F.col("sb") >= min_score) & (F.col("separation") >= separation))
    return first_per_key(ok, keys, [-F.col("weakest"), -F.col("separation"), F.col("frame_index")],
                         ["frame_index", "weakest", "separation", "x_px_a", "y_px_a", "x_px_b", "y_px_b"])


def select_negatives(kp: DataFrame, keyframe: DataFrame, names: Sequence[str], diagonal: float, keys: Sequence[str] = SEQ,
                     min_score: float = MIN_SCORE, separation: float = 0.025) -> DataFrame:
    """Listed landmarks of the key frame, confident and away from both ends; fewer than two is an error."""
    kf = keyframe.select(*keys, "frame_index", "x_px_a", "y_px_a", "x_px_b", "y_px_b")
    near = F.lit(separation * diagonal)
    j = kp.where(F.col("name").isin(*names) & (finite_double("score") >= min_score)).join(kf, [*keys, "frame_index"])
    away = lambda end: finite_double(dist2("x_px", "y_px", f"x_px_{end}", f"y_px_{end}")) >= near
    j = j.where(away("a") & away("b"))
    n = j.groupBy(*keys).agg(F.count_distinct("name").alias("n_negatives"), F.array_sort(F.collect_set("name")).alias("negatives"))
    return keyframe.select(*keys).join(n, list(keys), "left").select(
        *keys, F.coalesce("n_negatives", F.lit(0)).cast("long").alias("n_negatives"), "negatives",
        F.when(F.coalesce("n_negatives", F.lit(0)) < 2, F.lit("too_few_negative_points")).alias("error"))


def tidy(df: DataFrame, keys: Sequence[str], detail: str | None, metrics: Sequence[str]) -> DataFrame:
    """Wide metric columns to rows ``keys…, detail, metric, value``."""
    rows = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics])
    return df.select(*keys, (F.col(detail) if detail else F.lit("")).alias("detail"), F.explode(rows).alias("m")).select(*keys, "detail", "m.*")


def stack(parts: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)
