"""Boxes, masks as runs, curves, histograms and track gates. Pixels are never materialised."""

from __future__ import annotations

import bisect
import heapq
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidencelens.functions import angle_deg, bbox_iou_xywh, dist2
from evidencelens.operators.segments import adjacent_summary, gap_summary, global_rank, ranked, running, segment_of

FRAME = ("sequence_id", "frame_index")
SEQ = ("sequence_id",)
# Visibility classes that count as directly observed.
OBSERVABLE = ("visible", "partially_visible")


def _cells(df: DataFrame, cell: float) -> DataFrame:
    span = lambda lo, size: F.sequence(F.floor(F.col(lo) / cell).cast("long"), F.floor((F.col(lo) + F.col(size)) / cell).cast("long"))
    return df.withColumn("__cx", F.explode(span("bx", "bw"))).withColumn("__cy", F.explode(span("by", "bh")))


def _usable(boxes: DataFrame) -> DataFrame:
    return boxes.where("visible AND bw > 0 AND bh > 0")


def overlapping_instances(boxes: DataFrame, keys: Sequence[str] = FRAME, cell: float = 64.0) -> DataFrame:
    """Pairs of visible boxes of one frame with IoU above 0, ``a < b``.

    Boxes meet only inside the grid cells they cover; a pair is reported by the one cell that holds the
    upper-left corner of its intersection, so no distinct is needed.
    """
    cells = _cells(_usable(boxes).select(*keys, "instance_id", "bx", "by", "bw", "bh"), cell)
    cols = ("instance_id", "bx", "by", "bw", "bh")
    a = cells.select(*keys, "__cx", "__cy", *[F.col(c).alias(f"a_{c}") for c in cols])
    b = cells.select(*keys, "__cx", "__cy", *[F.col(c).alias(f"b_{c}") for c in cols])
    box = lambda s: [F.col(f"{s}_{c}") for c in ("bx", "by", "bw", "bh")]
    iou = bbox_iou_xywh(*box("a"), *box("b"))
    home = (F.floor(F.greatest("a_bx", "b_bx") / cell) == F.col("__cx")) & (F.floor(F.greatest("a_by", "b_by") / cell) == F.col("__cy"))
    j = a.join(b, [*keys, "__cx", "__cy"]).where((F.col("a_instance_id") < F.col("b_instance_id")) & home & (iou > 0))
    return j.select(*keys, F.col("a_instance_id").alias("a"), F.col("b_instance_id").alias("b"), iou.alias("iou"))


def overlap_frames(boxes: DataFrame, keys: Sequence[str] = FRAME) -> DataFrame:
    """Frames holding any overlapping pair, one row each.

    A sweep along x: as long as nothing overlaps, the boxes under the line are disjoint intervals in y, so a new one can only meet its two
    neighbours there. The sweep of a frame ends at its first overlap; no pair is listed. An instance has one box a frame.
    """
    rows = _usable(boxes).select(*keys, *[F.col(c).cast("double").alias(c) for c in ("bx", "by", "bw", "bh")])
    width = len(keys)

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frame, found, ends, starts, stops = None, False, [], [], []  # ends: (right edge, lower edge); starts, stops: the intervals in y
        schema = None
        for batch in batches:
            schema, hits = batch.schema, []
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                key, (x, y, w, h) = row[:width], row[width:]
                if key != frame:
                    frame, found, ends, starts, stops = key, False, [], [], []
                if found:
                    continue
                while ends and ends[0][0] <= x:
                    at = bisect.bisect_left(starts, heapq.heappop(ends)[1])
                    del starts[at], stops[at]
                at = bisect.bisect_right(starts, y)
                if (at and stops[at - 1] > y) or (at < len(starts) and starts[at] < y + h):
                    found = True
                    hits.append(key)
                    continue
                starts.insert(at, y)
                stops.insert(at, y + h)
                heapq.heappush(ends, (x + w, y))
            yield pa.RecordBatch.from_arrays([pa.array([k[i] for k in hits], schema.field(i).type) for i in range(width)], schema.names[:width])

    kinds = ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keys)
    return rows.repartition(*keys).sortWithinPartitions(*keys, "bx").mapInArrow(sweep, kinds)


def interval_mask_runs(masks: DataFrame, keys: Sequence[str], counts: str = "counts") -> tuple[DataFrame, DataFrame]:
    """(foreground runs ``start, len`` in column-major order, rows with ``errors``).

    ``masks`` has ``height, width`` and uncompressed run counts that begin with background.
    """
    total = F.aggregate(counts, F.lit(0).cast("long"), lambda a, c: a + c)
    checked = masks.withColumn("errors", F.array_compact(F.array(
        F.when(F.exists(counts, lambda c: c < 0), F.lit("negative_run")),
        F.when(total != F.col("height") * F.col("width"), F.lit("runs_do_not_fill_mask")))))
    w = Window.partitionBy(*keys).orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    runs = (
        checked.where(F.size("errors") == 0)
        .select(*keys, F.posexplode(counts).alias("pos", "len"))
        .withColumn("start", F.coalesce(F.sum("len").over(w), F.lit(0)))
        .where("pos % 2 = 1 AND len > 0")
        .select(*keys, "start", "len")
    )
    return runs, checked.where(F.size("errors") > 0).select(*keys, "errors")


def overlapping_masks(runs: DataFrame, keys: Sequence[str] = FRAME, block: int = 65536) -> DataFrame:
    """Runs that begin inside an earlier run of another instance of the frame.

    Runs of one instance are disjoint, so a running maximum of the end shows every conflict in one pass.
    """
    r = runs.withColumn("stop", F.col("start") + F.col("len"))
    ran = running(r, keys, segment_of("start", block), ["start", "instance_id"],
                  maxes={"open": F.struct(F.col("stop"), F.col("instance_id").alias("owner"))}, inclusive=False)
    return ran.where((F.col("open.stop") > F.col("start")) & (F.col("open.owner") != F.col("instance_id"))).select(
        *keys, "instance_id", "start", F.col("open.owner").alias("conflict_with"))


def mask_stats(runs: DataFrame, height: int, width: int, keys: Sequence[str]) -> DataFrame:
    """Area, fraction, box and centroid; a run is cut at column edges, sums over a piece are arithmetic."""
    h = F.lit(height)
    last = F.col("start") + F.col("len") - 1
    cols = F.sequence(F.floor(F.col("start") / h).cast("long"), F.floor(last / h).cast("long"))
    p = runs.where("len > 0").withColumn("c", F.explode(cols)).select(
        *keys, "c",
        F.when(F.col("c") == F.floor(F.col("start") / h), F.col("start") % h).otherwise(F.lit(0)).alias("r0"),
        F.when(F.col("c") == F.floor(last / h), last % h).otherwise(h - 1).alias("r1"))
    n = F.col("r1") - F.col("r0") + 1
    g = p.groupBy(*keys).agg(
        F.sum(n).alias("area"), F.min("c").alias("x0"), F.max("c").alias("x1"), F.min("r0").alias("y0"), F.max("r1").alias("y1"),
        (F.sum(F.col("c") * n) / F.sum(n)).alias("cx"),
        (F.sum((F.col("r0") + F.col("r1")) * n / 2.0) / F.sum(n)).alias("cy"))
    return g.withColumn("area_fraction", F.col("area") / F.lit(height * width))


def mask_iou(a: DataFrame, b: DataFrame, keys: Sequence[str], cell: int = 256) -> DataFrame:
    """Intersection over union of two run sets per key; both empty gives 1 where the key is known."""
    def cut(df: DataFrame, side: str) -> DataFrame:
        stop = F.col("start") + F.col("len")
        c = F.explode(F.sequence(F.floor(F.col("start") / cell).cast("long"), F.floor((stop - 1) / cell).cast("long")))
        return df.where("len > 0").withColumn("__c", c).select(
            *keys, "__c", F.greatest(F.col("start"), F.col("__c") * cell).alias(f"{side}0"),
            F.least(stop, (F.col("__c") + 1) * cell).alias(f"{side}1"))

    inter = cut(a, "a").join(cut(b, "b"), [*keys, "__c"]).where("a0 < b1 AND b0 < a1").groupBy(*keys).agg(
        F.sum(F.least("a1", "b1") - F.greatest("a0", "b0")).alias("inter"))
    area = lambda df, n: df.groupBy(*keys).agg(F.sum("len").alias(n))
    known = area(a, "area_a").join(area(b, "area_b"), list(keys), "full_outer").join(inter, list(keys), "left")
    i, x, y = (F.coalesce(c, F.lit(0)) for c in ("inter", "area_a", "area_b"))
    return known.select(*keys, i.cast("long").alias("intersection"),
                        F.when(x + y - i == 0, F.lit(1.0)).otherwise(i / (x + y - i)).alias("iou"))


def instance_sequence_stats(boxes: DataFrame, keys: Sequence[str] = SEQ) -> DataFrame:
    """Per sequence: instances, visible and co-visible frames, overlap frames, longest gap, stratum hints."""
    fk = [*keys, "frame_index"]
    vis = boxes.where("visible")
    per_track = gap_summary(vis.select(*keys, "instance_id", "frame_index"), [*keys, "instance_id"], "frame_index").groupBy(*keys).agg(
        F.sum("n_rows").alias("visible_track_frames"), F.coalesce(F.max("max_gap"), F.lit(0)).alias("max_internal_gap"),
        F.coalesce(F.sum("short_gaps"), F.lit(0)).alias("s"), F.coalesce(F.sum("long_gaps"), F.lit(0)).alias("l"))
    co = vis.groupBy(*fk).agg(F.count(F.lit(1)).alias("n")).where("n >= 2").groupBy(*keys).agg(F.count(F.lit(1)).alias("co_visible_frames"))
    over = overlap_frames(boxes, fk).groupBy(*keys).agg(F.count(F.lit(1)).alias("overlap_frames"))
    count = boxes.groupBy(*keys).agg(F.count_distinct("instance_id").alias("instances"))
    j = count.join(per_track, list(keys), "left").join(co, list(keys), "left").join(over, list(keys), "left")
    z = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    hints = F.array_compact(F.array(
        F.when(z("co_visible_frames") > 0, F.lit("ordinary_continuity")),
        F.when(z("s") > 0, F.lit("short_occlusion_candidate")),
        F.when(z("l") > 0, F.lit("long_gap_reentry_candidate")),
        F.when(z("overlap_frames") > 0, F.lit("crossing_close_interaction_candidate"))))
    return j.select(*keys, "instances", *[z(c).alias(c) for c in ("visible_track_frames", "co_visible_frames", "overlap_frames", "max_internal_gap")],
                    hints.alias("hints"))


def rank_sequences(stats: DataFrame, key: str = "sequence_id", min_instances: int = 2) -> DataFrame:
    """Sequences by (instances, co-visible, gap, overlap, visible) descending, then id; global rank by ranges of that order."""
    s = stats.where(F.col("instances") >= min_instances)
    neg = lambda c: (-F.col(c)).cast("long")
    order = [neg("instances"), neg("co_visible_frames"), neg("max_internal_gap"), neg("overlap_frames"), neg("visible_track_frames"), F.col(key)]
    return global_rank(s, order, "selection_rank", start=1)


def stable_instance_ids(ann: DataFrame, keys: Sequence[str] = SEQ, limit: int = 255) -> DataFrame:
    """1..k by ascending annotation id; a sequence with more than ``limit`` carries an error."""
    ids = ann.select(*keys, "annotation_id").distinct()
    out = ranked(ids, keys, segment_of("annotation_id", 1 << 16), ["annotation_id"], "stable_id")
    return out.withColumn("error", F.when(F.col("stable_id") > limit, F.lit("too_many_instances")))


def validate_tracks(tracks: DataFrame) -> DataFrame:
    """``errors`` for per-frame arrays of the wrong length and non-positive dimensions."""
    bad = lambda c: F.col(c).isNotNull() & (F.size(c) != F.col("length"))
    return tracks.withColumn("errors", F.array_compact(F.array(
        F.when(F.col("segmentations").isNull() | bad("segmentations"), F.lit("segmentations_length_mismatch")),
        F.when(bad("bboxes"), F.lit("bboxes_length_mismatch")),
        F.when(bad("file_names"), F.lit("file_names_length_mismatch")),
        F.when(~((F.col("height") > 0) & (F.col("width") > 0)), F.lit("dimension_not_positive")))))


def detector_availability(observed: DataFrame, keys: Sequence[str] = FRAME, identity: str = "individual") -> DataFrame:
    """How many frames hold n detections; how often each identity was observed."""
    per = observed.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).groupBy("n").agg(F.count(F.lit(1)).alias("value"))
    who = observed.groupBy(identity).agg(F.count(F.lit(1)).alias("value"))
    return per.select(F.lit("detections_per_frame").alias("kind"), F.col("n").cast("string").alias("key"), "value").unionByName(
        who.select(F.lit("observations_per_identity").alias("kind"), F.col(identity).alias("key"), "value"))


# ---- histograms and identity -------------------------------------------------------------------


def quantised_histogram(pixels: DataFrame, keys: Sequence[str], bins: int = 8) -> DataFrame:
    """Normalised sparse joint histogram per region; the total is summed from the bins, not the pixels."""
    from evidencelens.functions import rgb_bin

    counts = pixels.withColumn("bin", rgb_bin("r", "g", "b", bins)).groupBy(*keys, "bin").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(*keys))).select(*keys, "bin", "share")


def js_divergence(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Base-2 Jensen-Shannon divergence of two sparse histograms per key."""
    j = a.select(*keys, "bin", F.col("share").alias("p")).join(b.select(*keys, "bin", F.col("share").alias("q")), [*keys, "bin"], "full_outer")
    p, q = F.coalesce("p", F.lit(0.0)), F.coalesce("q", F.lit(0.0))
    m = F.greatest((p + q) / 2, F.lit(1e-12))
    term = lambda x: F.when(x > 0, x * F.log2(x / m)).otherwise(F.lit(0.0))
    return j.groupBy(*keys).agg(((F.sum(term(p)) + F.sum(term(q))) / 2).alias("jsd"))


def seed_divergence(hists: DataFrame, seeds: DataFrame, keys: Sequence[str], region: str) -> DataFrame:
    """JSD of every region of a key against the seed histogram of that key.

    Sum over the bins of the region; bins only the seed has contribute share/2 each (log2 2 = 1), taken
    as the seed's total minus the matched share, so seeds are not repeated per region.
    """
    s = seeds.select(*keys, "bin", F.col("share").alias("q"))
    j = hists.select(*keys, region, "bin", F.col("share").alias("p")).join(s, [*keys, "bin"], "left")
    p, q = F.col("p"), F.coalesce("q", F.lit(0.0))
    m = F.greatest((p + q) / 2, F.lit(1e-12))
    matched = p * F.log2(p / m) + F.when(q > 0, q * F.log2(q / m)).otherwise(F.lit(0.0))
    return j.groupBy(*keys, region).agg(((F.sum(matched) + F.lit(1.0) - F.sum(q)) / 2).alias("jsd"))


def assign_target(candidates: DataFrame, frames: DataFrame, keys: Sequence[str] = SEQ, threshold: float = 0.30) -> DataFrame:
    """Best candidate per frame accepted only within the threshold; a frame is never forced.

    ``candidates``: keys, frame_index, candidate_index, jsd, n_confident, mean_score, seed_tier.
    """
    if threshold < 0:
        raise ValueError("threshold must be non-negative")
    order = F.struct(F.col("jsd").alias("a"), (-F.col("n_confident")).alias("b"), (-F.col("mean_score")).alias("c"), F.col("candidate_index").alias("d"))
    best = candidates.groupBy(*keys, "frame_index").agg(
        F.count(F.lit(1)).alias("candidate_count"), F.min_by(F.struct("candidate_index", "jsd"), order).alias("best"),
        F.bool_and(F.col("seed_tier") == "R3").alias("seed_ok"))
    j = frames.select(*keys, "frame_index").distinct().join(best, [*keys, "frame_index"], "left")
    ok = F.coalesce((F.col("best.jsd") <= threshold) & F.col("seed_ok"), F.lit(False))
    return j.select(*keys, "frame_index", F.coalesce("candidate_count", F.lit(0)).cast("long").alias("candidate_count"), ok.alias("accepted"),
                    F.when(ok, F.col("best.candidate_index")).alias("selected"), F.when(ok, F.col("best.jsd")).alias("jsd"),
                    F.when(~F.coalesce(F.col("seed_ok"), F.lit(True)), F.lit("seed_tier_not_r3")).alias("error"))


def seed_box(points: DataFrame, keys: Sequence[str] = SEQ, pad: float = 0.05) -> DataFrame:
    """Bounding box of positive points, padded by a fraction of its sides (each at least 1)."""
    g = points.groupBy(*keys).agg(F.min("x").alias("x0"), F.min("y").alias("y0"), F.max("x").alias("x1"), F.max("y").alias("y1"))
    px = F.greatest(F.lit(1.0), F.col("x1") - F.col("x0")) * pad
    py = F.greatest(F.lit(1.0), F.col("y1") - F.col("y0")) * pad
    return g.select(*keys, (F.col("x0") - px).alias("x0"), (F.col("y0") - py).alias("y0"), (F.col("x1") + px).alias("x1"), (F.col("y1") + py).alias("y1"))


def prompt_hits(points: DataFrame, runs: DataFrame, height: int, width: int, keys: Sequence[str], candidate: Sequence[str],
                positive_radius: int = 0, negative_radius: int = 0, cell: int = 256) -> DataFrame:
    """Per candidate mask: share of positive points inside and negative points outside (1.0 if none).

    ``points``: keys, point_id, positive, x, y. A point within the radius hits when any cell of its
    clamped square lies in a run; points meet runs by equi-join on a block of pixel positions.
    """
    r = F.when(F.col("positive"), F.lit(positive_radius)).otherwise(F.lit(negative_radius))
    clamp = lambda v, hi: F.greatest(F.lit(0), F.least(F.lit(hi - 1), v)).cast("long")
    col, row = clamp(F.rint("x"), width), clamp(F.rint("y"), height)
    sq = points.withColumns({"__r": r, "__col": col, "__row": row})
    spread = sq.withColumn("__x", F.explode(F.sequence(F.greatest(F.lit(0), F.col("__col") - F.col("__r")), F.least(F.lit(width - 1), F.col("__col") + F.col("__r")))))
    # One column of the square is one interval of positions in column-major order.
    span = spread.select(*keys, "point_id", "positive",
                         (F.col("__x") * height + F.greatest(F.lit(0), F.col("__row") - F.col("__r"))).cast("long").alias("p0"),
                         (F.col("__x") * height + F.least(F.lit(height - 1), F.col("__row") + F.col("__r"))).cast("long").alias("p1"))
    span = span.withColumn("__c", F.explode(F.sequence(F.floor(F.col("p0") / cell).cast("long"), F.floor(F.col("p1") / cell).cast("long"))))
    stop = F.col("start") + F.col("len") - 1
    cut = runs.where("len > 0").select(*keys, *candidate, "start", stop.alias("stop"),
                                       F.explode(F.sequence(F.floor(F.col("start") / cell).cast("long"), F.floor(stop / cell).cast("long"))).alias("__c"))
    hits = span.join(cut, [*keys, "__c"]).where("p0 <= stop AND start <= p1").select(*keys, *candidate, "point_id", "positive").distinct()
    h = hits.groupBy(*keys, *candidate).agg(F.count_if("positive").alias("hp"), F.count_if(~F.col("positive")).alias("hn"))
    n = points.groupBy(*keys).agg(F.count_if("positive").alias("np"), F.count_if(~F.col("positive")).alias("nn"))
    masks = runs.select(*keys, *candidate).distinct()
    j = masks.join(h, [*keys, *candidate], "left").join(n, list(keys))
    return j.select(*keys, *candidate, (F.coalesce("hp", F.lit(0)) / F.nullif(F.col("np"), F.lit(0))).alias("positive_inside"),
                    F.when(F.col("nn") == 0, F.lit(1.0)).otherwise((F.col("nn") - F.coalesce("hn", F.lit(0))) / F.nullif(F.col("nn"), F.lit(0))).alias("negative_outside"))


# Ranking keys per prompt profile, best first.
PROFILES = {
    "part": (("positive_inside", -1), ("negative_outside", -1), ("geometry_valid", -1), ("area_fraction", 1), ("iou", -1)),
    "curve": (("positive_inside", -1), ("negative_outside", -1), ("iou", -1), ("area_fraction", 1)),
}
PROFILES["whole"] = PROFILES["curve"]


def rank_candidates(df: DataFrame, keys: Sequence[str], profile: str) -> DataFrame:
    """1 = best; the first input position wins ties. A prompt has a handful of candidate masks."""
    order = [(F.col(c).cast("double") * sign).asc() for c, sign in PROFILES[profile]]
    w = Window.partitionBy(*keys).orderBy(*order, "pos")
    return df.withColumn("rank", F.row_number().over(w).cast("long"))


# ---- track gates ---------------------------------------------------------------------------------


def curve_track_summary(frames: DataFrame, seeds: DataFrame, diagonal: float, keys: Sequence[str] = SEQ) -> DataFrame:
    """Coverage, seed gate, expansion, degenerate curves and consecutive root/tip steps per sequence.

    ``frames``: ok, area_fraction, curve_length, root_x/y, tip_x/y. ``seeds``: seed_area, seed_iou.
    """
    f = frames.join(seeds, list(keys))
    count = f.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("frames_total"), F.count_if("ok").alias("frames_with_curve"),
        F.count_if(F.col("area_fraction") > F.greatest(F.lit(0.01), F.col("seed_area") * 4)).alias("expansion_frames"),
        F.count_if(F.col("ok") & (F.col("curve_length") < diagonal * 0.01)).alias("degenerate_frames"),
        F.max(F.col("seed_iou") >= 0.90).alias("seed_preserved"))
    step = lambda n: (lambda p, c: F.when(c["frame_index"] == p["frame_index"] + 1,
                                          dist2(c[f"{n}_x"], c[f"{n}_y"], p[f"{n}_x"], p[f"{n}_y"]) / F.lit(float(diagonal))))
    one = lambda p, c: F.when(c["frame_index"] == p["frame_index"] + 1, F.lit(1).cast("long"))
    moves = adjacent_summary(frames.where("ok"), keys, "frame_index", ["root_x", "root_y", "tip_x", "tip_y"],
                             pair_sums={"root_sum": step("root"), "tip_sum": step("tip"), "n_steps": one},
                             pair_maxes={"max_root_step": step("root"), "max_tip_step": step("tip")})
    j = count.join(moves, list(keys), "left")
    coverage = F.col("frames_with_curve") / F.col("frames_total")
    ok = (coverage >= 0.75) & F.col("seed_preserved") & (F.col("expansion_frames") == 0) & (F.col("degenerate_frames") == 0)
    return j.select(*keys, "frames_total", "frames_with_curve", coverage.alias("coverage"), "seed_preserved", "expansion_frames",
                    "degenerate_frames", (F.col("root_sum") / F.col("n_steps")).alias("mean_root_step"), "max_root_step",
                    (F.col("tip_sum") / F.col("n_steps")).alias("mean_tip_step"), "max_tip_step",
                    F.when(ok, "pass").otherwise("revise").alias("feasibility"))


def flag_track_frames(frames: DataFrame, seeds: DataFrame, diagonal: float, profile: str, keys: Sequence[str] = SEQ) -> DataFrame:
    """One row per frame and flag behind the two summaries: failed, degenerate, expansion, collapse, empty."""
    f = frames.join(seeds, list(keys))
    a = F.col("area_fraction")
    if profile == "curve":
        tests = {"failed": ~F.col("ok"), "degenerate": F.col("ok") & (F.col("curve_length") < diagonal * 0.01), "expansion": a > F.greatest(F.lit(0.01), F.col("seed_area") * 4)}
    else:
        tests = {"expansion": a > F.greatest(F.lit(0.15), F.col("seed_area") * 4), "collapse": (a > 0) & (a < F.col("seed_area") * 0.12), "empty": F.col("area_px") == 0}
    flags = F.array_compact(F.array(*[F.when(t, F.lit(n)) for n, t in tests.items()]))
    return f.select(*keys, "frame_index", F.explode(flags).alias("flag"))


def region_track_summary(frames: DataFrame, seeds: DataFrame, diagonal: float, keys: Sequence[str] = SEQ) -> DataFrame:
    """Non-empty coverage, expansion, collapse, empty frames, centroid steps and appearance drift.

    ``frames``: area_px, area_fraction, cx, cy, jsd. ``seeds``: seed_area, seed_iou.
    """
    f = frames.join(seeds, list(keys))
    a = F.col("area_fraction")
    count = f.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("frames_total"), F.avg((F.col("area_px") > 0).cast("double")).alias("coverage"),
        F.count_if(a > F.greatest(F.lit(0.15), F.col("seed_area") * 4)).alias("expansion_frames"),
        F.count_if((a > 0) & (a < F.col("seed_area") * 0.12)).alias("collapse_frames"),
        F.count_if(F.col("area_px") == 0).alias("empty_frames"),
        F.avg("jsd").alias("mean_jsd"), F.max("jsd").alias("max_jsd"), F.max(F.col("seed_iou") >= 0.90).alias("seed_preserved"))
    ok_pair = lambda p, c: (c["frame_index"] == p["frame_index"] + 1) & c["cx"].isNotNull() & p["cx"].isNotNull()
    step = lambda p, c: F.when(ok_pair(p, c), dist2(c["cx"], c["cy"], p["cx"], p["cy"]) / F.lit(float(diagonal)))
    moves = adjacent_summary(frames, keys, "frame_index", ["cx", "cy"],
                             pair_sums={"step_sum": step, "n_steps": lambda p, c: F.when(ok_pair(p, c), F.lit(1).cast("long"))},
                             pair_maxes={"max_step": step})
    j = count.join(moves, list(keys), "left")
    ok = F.col("seed_preserved") & (F.col("expansion_frames") == 0) & (F.col("collapse_frames") == 0) & (F.col("empty_frames") == 0)
    return j.select(*keys, "frames_total", "coverage", "seed_preserved", "expansion_frames", "collapse_frames", "empty_frames",
                    (F.col("step_sum") / F.col("n_steps")).alias("mean_step"), "max_step", "mean_jsd", "max_jsd",
                    F.when(ok, "pass").otherwise("revise").alias("feasibility"))


# ---- curves and ears -----------------------------------------------------------------------------


def validate_curves(curve: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``errors`` per curve: two samples, strictly increasing u, ends at 0 and 1."""
    s = adjacent_summary(curve, keys, "pos", ["u"], pair_sums={"back": lambda p, c: (c["u"] <= p["u"]).cast("long")},
                         row_aggs={"u0": ("min", F.struct("pos", "u")), "u1": ("max", F.struct("pos", "u"))})
    return s.select(*keys, F.array_compact(F.array(
        F.when(F.col("n_rows") < 2, F.lit("too_few_samples")),
        F.when(F.coalesce("back", F.lit(0)) > 0, F.lit("u_not_increasing")),
        F.when((F.abs("u0.u") > 1e-9) | (F.abs(F.col("u1.u") - 1) > 1e-9), F.lit("u_ends_not_0_1")))).alias("errors"))


def _points(curve: DataFrame, keys: Sequence[str], n: int) -> DataFrame:
    """Samples of the curves with ``points``: the targets (j, x, y) at equal arc length that fall on the segment after a sample.

    A curve is one frame's centreline, a few dozen samples, so its window is small.
    """
    w = Window.partitionBy(*keys).orderBy("pos")
    seg = curve.withColumns({"nx": F.lead("x").over(w), "ny": F.lead("y").over(w), "k": F.row_number().over(w)})
    seg = seg.withColumn("d", F.coalesce(dist2("x", "y", "nx", "ny"), F.lit(0.0)))
    seg = seg.withColumns({"c1": F.sum("d").over(w.rowsBetween(Window.unboundedPreceding, 0)),
                           "total": F.sum("d").over(Window.partitionBy(*keys)), "m": F.count(F.lit(1)).over(Window.partitionBy(*keys))})
    # Only samples with a successor have a segment; the length before it is that of the last such sample.
    before = F.last(F.when(F.col("nx").isNotNull(), F.col("c1")), True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    seg = seg.withColumn("c0", F.coalesce(before, F.lit(0.0)))
    at = lambda j: F.col("total") * j / F.lit(float(n - 1))
    flat = F.col("total") <= 1e-12
    mine = lambda j: F.when(flat, F.col("k") == 1).otherwise(
        ((F.col("k") == 1) | (at(j) > F.col("c0"))) & ((F.col("k") == F.col("m") - 1) | (at(j) <= F.col("c1"))))
    alpha = lambda j: F.when(flat | (F.col("d") <= 1e-12), F.lit(0.0)).otherwise((at(j) - F.col("c0")) / F.col("d"))
    # A segment is tried with the targets around it, one more on either side for rounding; a length that is no number with all.
    place = lambda c: F.col(c) * F.lit(float(n - 1)) / F.col("total")
    usual = (F.col("total") > 1e-12) & (F.col("total") < 1e300)
    lo = F.when(usual & (F.col("k") > 1), F.greatest(F.lit(0), F.floor(place("c0")).cast("int") - 1)).otherwise(F.lit(0))
    hi = F.when(usual & (F.col("k") < F.col("m") - 1), F.least(F.lit(n - 1), F.ceil(place("c1")).cast("int") + 1)).otherwise(F.lit(n - 1))
    point = lambda j: F.struct(j.cast("long").alias("j"), (F.col("x") + alpha(j) * (F.col("nx") - F.col("x"))).alias("x"), (F.col("y") + alpha(j) * (F.col("ny") - F.col("y"))).alias("y"))
    return seg.withColumn("points", F.when(F.col("nx").isNotNull(), F.transform(F.filter(F.sequence(F.least(lo, hi), hi), mine), point)))


def resample_curve(curve: DataFrame, keys: Sequence[str], n: int = 32) -> DataFrame:
    """``n`` points at equal arc length; every segment emits the targets that fall on it."""
    return _points(curve, keys, n).select(*keys, F.explode("points").alias("p")).select(*keys, "p.j", "p.x", "p.y")


def curve_error(ref: DataFrame, pred: DataFrame, keys: Sequence[str], diagonal: float, n: int = 32) -> DataFrame:
    """Base, tip and ordered-curve error / diagonal, the latter only for fully observable references.

    Both curves' samples meet once, by curve; the points of a curve stay one array a side and are never dealt or sorted as rows.
    """
    keys = list(keys)
    side = lambda df, pred: df.select(*keys, F.lit(pred).alias("__pred"), "pos", "x", "y", F.col("visibility").isin(*OBSERVABLE).alias("__seen"))
    both = side(ref, False).unionByName(side(pred, True)).dropna(subset=keys).repartition(*keys)
    own = Window.partitionBy(*keys).orderBy("__pred", "pos").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    of = lambda pred, c: F.when(F.col("__pred") == pred, c)
    pt = F.struct("x", "y", F.col("__seen").alias("seen"))
    found = {"__k": F.row_number().over(Window.partitionBy(*keys).orderBy("__pred", "pos")), "r_observable": F.avg(of(False, F.col("__seen").cast("double"))).over(own)}
    for t, pred_ in (("r", False), ("p", True)):
        found |= {f"{t}_base": F.min_by(pt, of(pred_, F.col("pos"))).over(own), f"{t}_tip": F.max_by(pt, of(pred_, F.col("pos"))).over(own),
                  f"{t}_n": F.count(of(pred_, F.lit(1))).over(own), f"{t}_points": F.flatten(F.collect_list(of(pred_, F.col("points"))).over(own))}
    j = _points(both, [*keys, "__pred"], n).withColumns(found).where("__k = 1 AND r_n > 0 AND p_n > 0")
    gap = lambda a, b: dist2(a["x"], a["y"], b["x"], b["y"])
    places = lambda t: F.transform(f"{t}_points", lambda p: p["j"])
    # Points of one place meet: side by side, or by search where a side lacks some.
    pairs = F.when(places("r") == places("p"), F.zip_with("r_points", "p_points", gap)).otherwise(
        F.flatten(F.transform("r_points", lambda a: F.transform(F.filter("p_points", lambda b: b["j"] == a["j"]), lambda b: gap(a, b)))))
    full = F.col("r_observable") == 1.0
    j = j.withColumn("__gaps", F.when(full, F.filter(pairs, lambda g: g.isNotNull())))
    total = F.aggregate("__gaps", F.lit(0.0), lambda s, g: s + g)
    dia = F.lit(float(diagonal))
    end = lambda t: F.when(F.col(f"r_{t}.seen") & F.col(f"p_{t}.seen"),
                           dist2(F.col(f"r_{t}.x"), F.col(f"r_{t}.y"), F.col(f"p_{t}.x"), F.col(f"p_{t}.y")) / dia)
    return j.select(*keys, F.col("r_observable").alias("observable_fraction"), end("base").alias("base_error"), end("tip").alias("tip_error"),
                    F.when(F.size("__gaps") > 0, total / F.size("__gaps") / dia).alias("curve_mean_error"), (F.array_max("__gaps") / dia).alias("curve_max_error"))


def align_frames(ref: DataFrame, pred: DataFrame, keys: Sequence[str] = SEQ) -> DataFrame:
    """Frame keys of both sides with what is wrong: one-sided frames, differing image metadata."""
    r = ref.select(*keys, "frame_index", F.struct("width", "height").alias("ri"))
    p = pred.select(*keys, "frame_index", F.struct("width", "height").alias("pi"))
    j = r.join(p, [*keys, "frame_index"], "full_outer")
    return j.select(*keys, "frame_index", F.when(F.col("ri").isNull(), "frame_only_in_prediction").when(F.col("pi").isNull(), "frame_only_in_reference")
                    .when(F.col("ri") != F.col("pi"), "image_metadata_differs").alias("error"))


EAR_POINTS = ("base_medial", "base_lateral", "tip")


def ear_error(ref: DataFrame, pred: DataFrame, keys: Sequence[str], diagonal: float) -> DataFrame:
    """Point, base-centre and axis error per side; sides without a prediction stay with a flag.

    Each side has struct columns ``base_medial, base_lateral, tip`` of ``x, y, visibility``.
    """
    p = pred.select(*keys, *[F.col(c).alias(f"p_{c}") for c in EAR_POINTS], F.lit(True).alias("has"))
    j = ref.join(p, list(keys), "left")
    dia = F.lit(float(diagonal))
    seen = lambda c: F.col(f"{c}.visibility").isin(*OBSERVABLE)
    both = {c: F.coalesce(seen(c) & seen(f"p_{c}"), F.lit(False)) for c in EAR_POINTS}
    err = {c: F.when(both[c], dist2(F.col(f"{c}.x"), F.col(f"{c}.y"), F.col(f"p_{c}.x"), F.col(f"p_{c}.y")) / dia) for c in EAR_POINTS}
    mid = lambda pre, a: (F.col(f"{pre}base_medial.{a}") + F.col(f"{pre}base_lateral.{a}")) * 0.5
    every = both["base_medial"] & both["base_lateral"] & both["tip"]
    axis = lambda pre, a: F.col(f"{pre}tip.{a}") - mid(pre, a)
    return j.select(*keys, F.col("has").isNull().alias("missing_prediction"), *[err[c].alias(f"{c}_error") for c in EAR_POINTS],
                    F.when(every, dist2(mid("", "x"), mid("", "y"), mid("p_", "x"), mid("p_", "y")) / dia).alias("base_centre_error"),
                    F.when(every, angle_deg(axis("", "x"), axis("", "y"), axis("p_", "x"), axis("p_", "y"))).alias("axis_error_deg"))


def detail_summary(ears: DataFrame, curves: DataFrame, keys: Sequence[str] = SEQ) -> DataFrame:
    """Mean ear point, ear axis and curve errors per sequence over what was comparable."""
    cols = [f"{c}_error" for c in EAR_POINTS]
    total = sum((F.coalesce(F.col(c), F.lit(0.0)) for c in cols), F.lit(0.0))
    count = sum((F.col(c).isNotNull().cast("long") for c in cols), F.lit(0))
    e = ears.groupBy(*keys).agg((F.sum(total) / F.nullif(F.sum(count), F.lit(0))).alias("mean_ear_point_error"), F.avg("axis_error_deg").alias("mean_ear_axis_error_deg"))
    c = curves.groupBy(*keys).agg(F.avg("curve_mean_error").alias("mean_curve_error"), F.count("curve_mean_error").alias("fully_observable_frames"))
    return e.join(c, list(keys), "full_outer")
