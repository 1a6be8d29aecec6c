"""Cohorts, locks, enrichment, digests, keyed comparison and ablation decisions."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidencelens.operators import context, contracts
from evidencelens.operators.contracts import merge, rule, rules

# The ablation rows, their inputs and modes.
ABLATION_ROWS = {
    "B0": ("predictive", ("context_routine",)), "V": ("predictive", ("V1",)), "A": ("predictive", ("A1",)),
    "BV": ("predictive", ("V1", "context_routine")), "BA": ("predictive", ("A1", "context_routine")), "VA": ("predictive", ("A1", "V1")),
    "BVA": ("predictive", ("A1", "V1", "context_routine")), "BVA-V": ("dropout_stress", ("A1", "context_routine")), "BVA-A": ("dropout_stress", ("V1", "context_routine")),
}
CONSTITUENTS = ("B0", "V", "A", "BV", "BA", "VA")
REQUIRED_METRICS = ("log_loss", "brier", "ece", "balanced_accuracy", "macro_f1")
PROBES = ("subject_identity", "household_owner", "time_routine", "location", "device_source", "modality_presence_missingness")
DIAGNOSTICS = ("complete_modality", "naturally_missing", "visual_dropout", "audio_dropout", "missingness_target_probe")
STRESS = {"BVA-V": ("BVA", "V1"), "BVA-A": ("BVA", "A1")}
RESAMPLING_UNITS = ("subject", "household", "day", "session")


def id_set_digest(df: DataFrame, keys: Sequence[str], id_col: str, unique: bool = False) -> DataFrame:
    """Count and SHA-256 of the sorted ids joined by newlines, per key, in one form at every size.

    Ids are dealt and sorted by ranges of (key, id), so a large set fills many tasks, each of which joins its ids into blocks of text.
    Only the digest itself is sequential: one task per key takes the finished blocks in order, in constant memory.
    ``unique``: ids given more than once count once, and ``repeated`` says whether there were any. Copies of an id meet in its range,
    so they need no grouping of their own.
    """
    keys = list(keys)
    ids = df.select(*keys, F.col(id_col).cast("string").alias("__id")).where(F.col("__id").isNotNull())
    order = [*keys, "__id"]
    kept = [(k, ids.schema[k].dataType.simpleString()) for k in keys]
    width = len(keys)

    def changes(column):
        """Whether each value but the first differs from the one before; nulls are alike."""
        a, b = column.slice(1), column.slice(0, len(column) - 1)
        same = pc.or_(pc.fill_null(pc.equal(a, b), False), pc.and_(pc.is_null(a), pc.is_null(b)))
        return ~same.to_numpy(zero_copy_only=False)

    def blocks(batches):
        """Sorted rows to (keys, task, part, n, n_repeated, text) blocks of at most about 1 MB."""
        task, part, last = TaskContext.get().partitionId(), 0, None
        for batch in batches:
            rows = batch.num_rows
            if not rows:
                continue
            columns = batch.columns
            if last is not None:
                columns = [pa.concat_arrays([x, c]) for x, c in zip(last, columns)]
            else:
                columns = [pa.concat_arrays([c.slice(0, 1), c]) for c in columns]
            keyed = reduce(np.logical_or, [changes(c) for c in columns[:width]], np.zeros(rows, bool))
            again = ~(keyed | changes(columns[width])) if unique else np.zeros(rows, bool)
            if last is None:
                again[0] = False
            last = [c.slice(rows) for c in columns]
            size = np.cumsum(np.where(again, 0, np.asarray(pc.binary_length(batch.column(width)))))
            keyed[0] = True
            keyed[1:] |= size[1:] >> 20 != size[:-1] >> 20
            starts = np.flatnonzero(keyed)
            fresh = np.concatenate(([0], np.cumsum(~again)))[np.append(starts, rows)]
            texts = batch.column(width).filter(pa.array(~again))
            joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(fresh, pa.int32()), texts), pa.scalar("\n", texts.type)).cast(pa.string())
            n = np.diff(fresh)
            numbers = [np.full(len(starts), task), part + np.arange(len(starts)), n, np.diff(np.append(starts, rows)) - n]
            part += len(starts)
            at = pa.array(starts)
            yield pa.RecordBatch.from_arrays([c.take(at) for c in batch.columns[:width]] + [pa.array(v, pa.int64()) for v in numbers] + [joined], [*keys, "__task", "__part", "__n", "__more", "__text"])

    def digests(batches):
        key, state, schema, done = None, None, None, []
        for batch in batches:
            schema = batch.schema
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if state is not None and row[:width] != key:
                    done.append((*key, state[0], state[1].hexdigest(), state[2]))
                    state = None
                n, more, text = row[width + 2 :]
                if state is None:
                    key, state = row[:width], [0, hashlib.sha256(), False]
                state[2] |= more > 0
                if n:
                    if state[0]:
                        state[1].update(b"\n")
                    state[0] += n
                    state[1].update(text.encode())
        if state is not None:
            done.append((*key, state[0], state[1].hexdigest(), state[2]))
        if done:
            types = [schema.field(i).type for i in range(width)] + [pa.int64(), pa.string(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in done], t) for i, t in enumerate(types)], [*keys, "n_ids", "digest", "repeated"])

    columns = "".join(f"`{k}` {t}, " for k, t in kept)
    cut = ids.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(blocks, f"{columns}__task long, __part long, __n long, __more long, __text string")
    dealt = cut.repartition(*keys) if keys else cut.repartition(1)  # an exchange of its own: the blocks above keep their ranges
    out = dealt.sortWithinPartitions(*keys, "__task", "__part").mapInArrow(digests, f"{columns}n_ids long, digest string, repeated boolean")
    return out if unique else out.drop("repeated")


def package_counts(obs: DataFrame, keys: Sequence[str], sample: Sequence[str] = ()) -> DataFrame:
    """Observation counts in total and by class, tier and quality as tidy rows, and the number of distinct samples where ``sample`` names them."""
    kinds = F.array(F.struct(F.lit("all").alias("kind"), F.lit("").alias("value")), *[
        F.struct(F.lit(c).alias("kind"), F.col(c).alias("value")) for c in ("observation_class", "evidence_tier", "quality")])
    counts = obs.select(*keys, F.explode(kinds).alias("__k")).select(*keys, "__k.*").groupBy(*keys, "kind", "value").agg(F.count(F.lit(1)).alias("n"))
    if not sample:
        return counts
    samples = obs.select(*keys, *sample).distinct().groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return counts.unionByName(samples.select(*keys, F.lit("samples").alias("kind"), F.lit("").alias("value"), "n"))


# ---- cohort --------------------------------------------------------------------------------------


def event_support(docs: DataFrame, checked_capture: bool = False) -> DataFrame:
    """Per event: B0, V1, A1 support, target, conflicts, eligibility and sorted reasons."""
    label, label_errors = context.termination_label()
    v = context.evidence_window("visual_pose", checked=True)
    a = context.evidence_window("audio_vocalisation")
    checked = contracts.with_capture_errors(docs, "__e") if checked_capture else contracts.with_episode_errors(docs, "__e")
    d = checked.withColumns({
        "__l": label, "__le": label_errors,
        "__v": v["eligible"], "__vi": v["invalid"], "__a": a["eligible"],
        "__c": F.array_sort(F.array_intersect(F.transform("observations", lambda o: o["modality"]), "missing_modalities"))})
    ok = F.size("__e") == 0
    missing = lambda m: F.array_contains("missing_modalities", m)
    target = ok & F.col("__l").isNotNull() & (F.size("__le") == 0)
    v1 = ok & (F.size("__v") > 0) & ~missing("visual_pose")
    a1 = ok & (F.size("__a") > 0) & ~missing("audio_vocalisation")
    conflict = F.size("__c") > 0
    reasons = merge(
        F.transform("__e", lambda e: F.concat(F.lit("contract:"), e)), F.when(ok, F.transform("__le", lambda e: F.concat(F.lit("target:"), e))).otherwise(F.array().cast("array<string>")),
        rules(F.when(conflict, F.concat(F.lit("modality_conflict:"), F.array_join("__c", ","))), rule("target:missing", F.when(ok, F.col("__l")).isNull() & (~ok | (F.size("__le") == 0))),
              F.when(F.size("__vi") > 0, F.concat(F.lit("V1:invalid_provenance:"), F.array_join("__vi", ","))), rule("V1:none_in_window", F.size("__v") == 0),
              rule("A1:none_in_window", F.size("__a") == 0)))
    return d.select("event_id", "episode_id", "household_id", ok.alias("b0"), v1.alias("v1"), a1.alias("a1"), target.alias("target"), F.when(target, F.col("__l")).alias("label"),
                    conflict.alias("conflict"), (ok & v1 & a1 & target & ~conflict).alias("eligible"), reasons.alias("reasons"))


def complete_case(support: DataFrame) -> DataFrame:
    return support.where("eligible").select("episode_id")


def cohort_support(support: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Eight support counts and the four modality patterns."""
    c = lambda e, n: F.count_if(F.expr(e)).alias(n)
    return support.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("received"), c("target", "labelled"), c("b0", "b0"), c("v1", "v1"), c("a1", "a1"), c("v1 AND a1", "v1_a1"), c("b0 AND v1 AND a1", "b0_v1_a1"),
        c("eligible", "primary_cases"), c("v1 AND a1", "pattern_both"), c("v1 AND NOT a1", "pattern_v1_only"), c("a1 AND NOT v1", "pattern_a1_only"), c("NOT v1 AND NOT a1", "pattern_neither"))


# ---- capture locks -------------------------------------------------------------------------------


def lock_integrity(events: DataFrame, locks: DataFrame, version: str = "v0") -> DataFrame:
    """Events left join locks: ``errors``, finalised flag and outcome state.

    ``events``: event_id, predictor_digest, action_digest, action_count, event_digest, n_outcomes, outcomes.
    """
    lk = locks.select(F.col("event_id"), *[F.col(c).alias(f"l_{c}") for c in (
        "version", "lock_event_id", "predictor_digest", "action_digest", "action_count", "completed_digest", "finalized")], F.lit(True).alias("has_lock"))
    j = events.join(lk, "event_id", "left")
    has = F.coalesce("has_lock", F.lit(False))
    fin = has & F.coalesce("l_finalized", F.lit(False))
    differs = lambda a, b: has & ~F.col(a).eqNullSafe(F.col(b))
    none = F.col("n_outcomes") == 0
    return j.withColumns({
        "finalized": fin, "outcome_state": context.outcome_state(fin),
        "errors": merge(rules(
            rule("lock_missing", ~has), rule("lock_version_unsupported", has & (F.col("l_version") != version)), rule("lock_event_differs", differs("event_id", "l_lock_event_id")),
            rule("predictor_digest_differs", differs("predictor_digest", "l_predictor_digest")), rule("action_digest_differs", differs("action_digest", "l_action_digest")),
            rule("action_count_differs", differs("action_count", "l_action_count")), rule("completed_digest_differs", fin & ~F.col("event_digest").eqNullSafe(F.col("l_completed_digest"))),
            rule("finalized_without_outcome", fin & none), rule("outcome_without_finalization", has & ~fin & ~none)))})


def capture_status(records: DataFrame, keys: Sequence[str] = (), target: int = 10) -> DataFrame:
    """Open, finalised, ready and invalid counts, outcome states of ready records, duplicates, target."""
    ready = F.col("finalized") & (F.size("errors") == 0)
    state = lambda s: F.count_if(ready & (F.col("outcome_state") == s)).alias(s)
    g = records.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("records"), F.count_if(~F.col("finalized")).alias("open_records"), F.count_if("finalized").alias("finalized_records"), F.count_if(ready).alias("ready"),
        F.count_if(F.size("errors") > 0).alias("invalid"), *[state(s) for s in ("terminated", "continued", "unknown")])
    dup = records.groupBy(*keys, "event_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").groupBy(*keys).agg(F.count(F.lit(1)).alias("duplicate_ids"))
    j = g.join(dup, list(keys), "left") if keys else g.crossJoin(F.broadcast(dup))
    return j.withColumns({"duplicate_ids": F.coalesce("duplicate_ids", F.lit(0)), "target_reached": F.col("ready") >= target})


def bundle_ready(records: DataFrame, keys: Sequence[str]) -> DataFrame:
    """All or nothing per key: finalised records, unless any record is invalid or duplicated."""
    dup = records.groupBy(*keys, "event_id").agg(F.count(F.lit(1)).alias("n"), F.max((F.size("errors") > 0).cast("int")).alias("bad"))
    blocked = dup.groupBy(*keys).agg(F.bool_or((F.col("n") > 1) | (F.col("bad") == 1)).alias("blocked")).where("blocked")
    return records.where("finalized").join(blocked.select(*keys), list(keys), "left_anti").select(*keys, "event_id", "start_us", "event_digest", "outcome_state")


def canonical_minus_derived(docs: DataFrame, composer: str) -> tuple[DataFrame, DataFrame]:
    """(canonical, derived): derived documents carry the composer among their software versions."""
    derived = F.coalesce(F.array_contains(F.map_keys("software_versions"), composer), F.lit(False))
    return docs.where(~derived), docs.where(derived)


def compose_enriched(events: DataFrame, sidecars: DataFrame) -> DataFrame:
    """Events with their sealed sidecars: added observations, reduced missing modalities, united sources.

    An event holds a handful of sidecars (one per modality and seal), so the gathered list is small.
    """
    g = sidecars.groupBy("event_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("ord", "observation_ref", "modality", "record_id", "local_path"))), lambda s: s).alias("s"),
        F.bool_or("human_audio").alias("ha"), F.bool_or("human_image").alias("hi"), F.bool_or(F.size("seal_errors") > 0).alias("bad"))
    j = events.join(g, "event_id")
    refs = F.transform("s", lambda x: x["observation_ref"])
    added = F.transform("s", lambda x: x["modality"])
    public = F.to_json(F.struct("event_id", refs.alias("r"), added.alias("m"), "source_ids"))
    out = j.withColumns({
        "observation_refs_all": F.concat("observation_refs", refs), "missing_after": F.filter("missing_modalities", lambda m: ~F.array_contains(added, m)),
        "source_ids_all": F.array_distinct(F.concat("source_ids", F.transform("s", lambda x: x["record_id"]))),
        "contains_human_audio": F.col("contains_human_audio") | F.col("ha"), "contains_human_image": F.col("contains_human_image") | F.col("hi"),
        "lineage_all": F.concat("lineage", F.array(F.concat(F.lit("derived sensor composition using "), F.size("s").cast("string"), F.lit(" sealed sidecar(s)")))),
        "errors": merge(rules(rule("sidecar_refs_not_unique", F.size(F.array_distinct(refs)) < F.size(refs)), rule("observation_ref_collides", F.size(F.array_intersect("observation_refs", refs)) > 0),
                              rule("sidecar_not_valid", F.col("bad")), rule("local_path_leaked", F.exists("s", lambda x: F.contains(public, x["local_path"])))))})
    return out.drop("s", "ha", "hi", "bad")


# ---- keyed comparison ----------------------------------------------------------------------------


def tolerance_diff(expected: DataFrame, actual: DataFrame, keys: Sequence[str], rel: float = 1e-10, abs_tol: float = 1e-8) -> DataFrame:
    """Differences of two flattened reports ``(keys, type, num, txt)``; types: number, boolean, text, null."""
    e = expected.select(*keys, F.struct("type", "num", "txt").alias("e"))
    a = actual.select(*keys, F.struct("type", "num", "txt").alias("a"))
    j = e.join(a, list(keys), "full_outer")
    close = F.abs(F.col("e.num") - F.col("a.num")) <= F.greatest(F.lit(rel) * F.greatest(F.abs("e.num"), F.abs("a.num")), F.lit(abs_tol))
    problem = (F.when(F.col("a").isNull(), "missing").when(F.col("e").isNull(), "unexpected").when(F.col("e.type") != F.col("a.type"), "type_change")
               .when((F.col("e.type") == "number") & ~F.coalesce(close, F.lit(False)), "value_differs").when((F.col("e.type") != "number") & ~F.col("e.txt").eqNullSafe(F.col("a.txt")), "value_differs"))
    return j.select(*keys, problem.alias("problem")).where("problem IS NOT NULL")


def named_conformance(actual: DataFrame, expected: DataFrame, name: str, components: Sequence[str], abs_tol: float) -> DataFrame:
    """Missing, unexpected, duplicate names, non-finite or out-of-tolerance components."""
    a = actual.groupBy(name).agg(F.count(F.lit(1)).alias("__n"), *[F.max(c).alias(c) for c in components])
    e = expected.select(name, *[F.col(c).alias(f"e_{c}") for c in components], F.lit(True).alias("__e"))
    j = a.join(e, name, "full_outer")
    bad = lambda c: F.coalesce(F.isnan(c) | (F.abs(c) == float("inf")), F.lit(True))
    both = F.col("__n").isNotNull() & F.col("__e").isNotNull()
    per = [F.when(both, F.when(bad(c), F.lit(f"not_finite:{c}")).when(F.abs(F.col(c) - F.col(f"e_{c}")) > abs_tol, F.lit(f"differs:{c}"))) for c in components]
    return j.select(name, merge(rules(rule("missing", F.col("__n").isNull()), rule("unexpected", F.col("__e").isNull()), rule("duplicate", F.col("__n") > 1), *per)).alias("errors"))


# ---- ablation reports ----------------------------------------------------------------------------


def metrics_wide(metrics: DataFrame) -> DataFrame:
    return metrics.groupBy("report_id", "row_id").agg(*[F.max(F.when(F.col("metric") == m, F.col("value"))).alias(m) for m in REQUIRED_METRICS])


def strongest_constituent(metrics: DataFrame) -> DataFrame:
    """Lowest log loss among single and paired inputs; the first declared wins ties."""
    order = F.create_map(*[F.lit(x) for i, r in enumerate(CONSTITUENTS) for x in (r, i)])
    c = metrics.where((F.col("metric") == "log_loss") & F.col("row_id").isin(*CONSTITUENTS))
    best = c.groupBy("report_id").agg(F.min(F.struct("value", order[F.col("row_id")].alias("o"), "row_id")).alias("b"))
    return best.select("report_id", F.col("b.row_id").alias("strongest"), F.col("b.value").alias("log_loss"))


def validate_ablation_reports(reports: DataFrame, rows: DataFrame, metrics: DataFrame, episodes: DataFrame, probes: DataFrame, diagnostics: DataFrame) -> DataFrame:
    """Errors per report from long tables; cohorts are compared by count and digest, never as lists."""
    spec = F.array(*[F.struct(F.lit(r).alias("row_id"), F.lit(mode).alias("want_mode"), F.lit(",".join(sorted(inputs))).alias("want_inputs"),
                              F.lit("/".join(STRESS[r]) if r in STRESS else None).cast("string").alias("want_stress")) for r, (mode, inputs) in ABLATION_ROWS.items()])
    want = reports.select("report_id", "split_sha256", F.explode(spec).alias("w")).select("report_id", "split_sha256", "w.*")
    # One sort of the ids finds the digest and the repeated ones; rows without an id only count as such.
    cohort = id_set_digest(episodes, ["report_id", "row_id"], "episode_id", unique=True)
    nameless = episodes.where("episode_id IS NULL").groupBy("report_id", "row_id").agg(F.count(F.lit(1)).alias("nameless"))
    cohort = cohort.join(nameless, ["report_id", "row_id"], "full_outer").select(
        "report_id", "row_id", "digest", (F.coalesce("repeated", F.lit(False)) | (F.coalesce("nameless", F.lit(0)) > 1)).alias("dup"))
    m = metrics_wide(metrics)
    finite = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    j = (want.join(rows.withColumn("present", F.lit(True)).withColumnRenamed("split_sha256", "row_split"), ["report_id", "row_id"], "left")
         .join(cohort, ["report_id", "row_id"], "left").join(m, ["report_id", "row_id"], "left"))
    here = F.col("present").isNotNull()
    item = rules(
        rule("row_missing", ~here), rule("mode_differs", here & (F.col("mode") != F.col("want_mode"))), rule("inputs_differ", here & (F.array_join(F.array_sort("inputs"), ",") != F.col("want_inputs"))),
        rule("stress_differs", here & F.col("want_stress").isNotNull() & ~F.col("stress").eqNullSafe(F.col("want_stress"))),
        rule("row_target_differs", here & ~F.col("row_target").eqNullSafe(F.lit("signalling_terminated/60"))),
        rule("split_differs", here & ~F.col("row_split").eqNullSafe(F.col("split_sha256"))), rule("episodes_empty", here & F.col("dup").isNull()), rule("episodes_repeated", here & F.col("dup")),
        rule("episode_digest_differs", here & ~F.coalesce("dup", F.lit(True)) & ~F.col("declared_sha256").eqNullSafe(F.col("digest"))),
        *[rule(f"metric_{x}", here & ~finite(x)) for x in REQUIRED_METRICS])
    row_level = j.select("report_id", "row_id", "digest", F.transform(item, lambda e: F.concat_ws(":", e, F.col("row_id"))).alias("e"))
    # Nine rows per report: the anchor digest and the error list stay tiny.
    per = row_level.groupBy("report_id").agg(F.flatten(F.collect_list("e")).alias("row_errors"), F.collect_list(F.struct("row_id", "digest")).alias("d"))
    anchor = F.get(F.filter("d", lambda x: x["row_id"] == "B0"), F.lit(0))["digest"]
    differ = F.transform(F.filter("d", lambda x: x["digest"].isNotNull() & anchor.isNotNull() & (x["digest"] != anchor)), lambda x: F.concat_ws(":", F.lit("cohort_differs"), x["row_id"]))
    k = reports.join(per, "report_id").join(_reported(probes, "probe", PROBES, ("reported", "unsupported")), "report_id", "left")
    k = k.join(_reported(diagnostics, "diagnostic", DIAGNOSTICS, ("reported", "not_present", "unsupported")), "report_id", "left")
    blank = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    head = rules(
        rule("contract_version", F.col("contract_version") != "v0"), rule("target_differs", (F.col("target_name") != "signalling_terminated") | (F.col("horizon_s") != 60)),
        rule("forbidden_target", F.col("target_name") == "true_intent"), rule("split_digest_unstable", F.coalesce(F.length("split_sha256"), F.lit(0)) < 16), rule("claim_scope_missing", blank("claim_scope")),
        *[rule(f"{t}_{c}", F.coalesce(f"{t}_{c}", F.lit(c == "missing"))) for t in ("probe", "diagnostic") for c in ("missing", "status", "reason_missing")],
        rule("resampling_unit_not_allowed", F.col("uncertainty_supported") & ~F.col("resampling_unit").isin(*RESAMPLING_UNITS)),
        rule("uncertainty_reason_missing", ~F.col("uncertainty_supported") & blank("uncertainty_reason")), rule("uncertainty_not_declared", F.col("uncertainty_supported").isNull()),
        rule("abstention_status", ~F.coalesce(F.col("abstention_status").isin("reported", "not_applicable", "unsupported"), F.lit(False))),
        rule("abstention_reason_missing", F.col("abstention_status").isin("not_applicable", "unsupported") & blank("abstention_reason")),
        rule("threshold_not_frozen", (F.col("abstention_status") == "reported") & ~F.coalesce("threshold_frozen", F.lit(False))),
        rule("advancement_not_declared", F.col("advancement_requested").isNull()))
    return k.select("report_id", merge(head, F.col("row_errors"), differ).alias("errors"))


def _reported(items: DataFrame, name: str, needed: Sequence[str], statuses: Sequence[str]) -> DataFrame:
    """Per report: a needed item is missing, has an unknown status, or lacks the reason its status requires."""
    want = F.array(*[F.lit(p) for p in needed])
    g = items.where(F.col(name).isin(*needed)).groupBy("report_id").agg(
        F.collect_set(name).alias("have"), F.bool_or(~F.col("status").isin(*statuses)).alias(f"{name}_status"),
        F.bool_or(F.col("status").isin(*[s for s in statuses if s != "reported"]) & (F.coalesce("reason", F.lit("")) == "")).alias(f"{name}_reason_missing"))
    return g.select("report_id", (F.size(F.array_except(want, "have")) > 0).alias(f"{name}_missing"), f"{name}_status", f"{name}_reason_missing")


def advancement_decision(reports: DataFrame, metrics: DataFrame, max_ece_loss: float = 0.02) -> DataFrame:
    """Whether the full model may advance: strictly better log loss, supported uncertainty, declared delta, ECE."""
    m = metrics_wide(metrics)
    best = strongest_constituent(metrics)
    full = m.where("row_id = 'BVA'").select("report_id", F.col("log_loss").alias("f_ll"), F.col("ece").alias("f_ece"))
    strong = best.join(m.select("report_id", F.col("row_id").alias("strongest"), F.col("ece").alias("s_ece")), ["report_id", "strongest"])
    j = reports.join(full, "report_id").join(strong, "report_id")
    delta = F.col("f_ll") - F.col("log_loss")
    close = F.abs(F.col("declared_delta") - delta) <= F.greatest(1e-9 * F.greatest(F.abs("declared_delta"), F.abs(delta)), F.lit(1e-12))
    errs = merge(rules(
        rule("does_not_beat_strongest", ~(F.col("f_ll") < F.col("log_loss"))), rule("uncertainty_not_supported", ~F.coalesce("uncertainty_supported", F.lit(False))),
        rule("comparator_differs", ~F.col("declared_comparator").eqNullSafe(F.col("strongest"))), rule("declared_delta_differs", ~F.coalesce(close, F.lit(False))),
        rule("ece_degradation_undisclosed", (F.col("f_ece") - F.col("s_ece") > max_ece_loss) & ~F.coalesce("ece_disclosed", F.lit(False)))))
    return j.select("report_id", "strongest", delta.alias("delta_log_loss"), (F.size(errs) == 0).alias("advances"), errs.alias("errors"))


def cohort_equality(a: DataFrame, b: DataFrame, keys: Sequence[str], id_col: str, rows: int = 1 << 20) -> DataFrame:
    """Whether two id sets per key are identical, with the counts of one-sided ids.

    Ids are dealt by (key, id) over as many tasks as hold about ``rows`` each, so a task's table of ids does not grow with the input. All
    copies of one id of one key meet in one task, which keeps a single entry for them.
    """
    tag = lambda d, t: d.select(*keys, id_col, F.lit(t).alias("s"))
    both = tag(a, 1).unionByName(tag(b, 2))
    tasks = max(1, -(-both.count() // rows))
    per = both.repartition(tasks, *keys, id_col).groupBy(*keys, id_col).agg(F.bit_or("s").alias("s"))
    return per.groupBy(*keys).agg(F.count_if(F.col("s") == 1).alias("only_a"), F.count_if(F.col("s") == 2).alias("only_b"),
                                  (F.count_if(F.col("s") != 3) == 0).alias("equal"))
