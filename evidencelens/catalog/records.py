"""Whole records against their declared schema: nested documents in which every rule fails somewhere, and the same rules rendered for SQL."""

import re

from pyspark.sql import functions as F

from evidencelens.catalog import query
from evidencelens.catalog.contracts import DEEP_SQL, DUP, UN, collect_rules
from evidencelens.docs_view import ISO
from evidencelens.operators import record_contracts as rc
from evidencelens.operators.record_schemas import EPISODE, PLAN
from evidencelens.operators.schemas import Flag, Free, Items, Number, Record, Text, ddl
from evidencelens.views import spread, table

# ---- the schema in SQL ---------------------------------------------------------------------------


def sql_checks(spec, v, path, depth):
    """(codes or NULL, lists of codes) as DuckDB expressions."""
    code = lambda keyword, bad, at=path: f"CASE WHEN {bad} THEN '{at}:{keyword}' END"
    if isinstance(spec, Text):
        out = [code("minLength", f"length({v}) < {spec.min_length}")] if spec.min_length else []
        out += [code("enum", f"{v} NOT IN ({', '.join(map(repr, spec.enum))})")] if spec.enum else []
        out += [code("const", f"{v} <> '{spec.const}'")] if spec.const is not None else []
        return out + ([code("format", f"NOT regexp_matches({v}, '^[0-9]{{4}}-.*[+]10:00$')")] if spec.bad else []), []
    if isinstance(spec, Number):
        real = f"NOT isnan({v}::DOUBLE) AND {v}"
        return [code(k, f"{real} {op} {bound}") for k, op, bound in (("minimum", "<", spec.low), ("maximum", ">", spec.high)) if bound is not None], []
    if isinstance(spec, Flag):
        return ([code("const", f"{v} <> {str(spec.const).lower()}")] if spec.const is not None else []), []
    if isinstance(spec, Items):
        out = [code("minItems", f"len({v}) < {spec.min_items}")] if spec.min_items else []
        out += [code("uniqueItems", f"len(list_distinct({v})) < len({v})")] if spec.unique else []
        x, i, e = (f"{n}{depth}" for n in "xie")
        tail = f"CASE WHEN starts_with({e}, ':') THEN {e} ELSE '.' || {e} END"
        own = f"CASE WHEN {x} IS NULL THEN [':type'] ELSE {sql_problems(spec.of, x, depth + 1)} END"
        return out, [f"coalesce(flatten(list_transform({v}, lambda {x}, {i}: list_transform({own}, lambda {e}: '{path}.' || ({i} - 1) || {tail}))), [])"]
    singles, lists = [], []
    lead = f"{path}." if path else ""
    for name, part in getattr(spec, "fields", {}).items():
        own = f"{v}.{name}" if v else name
        if name in spec.required:
            singles.append(code("required", f"{f'({v}) IS NOT NULL AND ' if v else ''}({own}) IS NULL", lead + name))
        if not isinstance(part, Free):
            s, a = sql_checks(part, own, lead + name, depth)
            singles, lists = singles + s, lists + a
    for rule in getattr(spec, "rules", ()):
        here = f"{v}.{rule.field} = '{rule.const}'"
        singles += [code("required", f"{here} AND {v}.{n} IS NULL", lead + n) for n in rule.require] + [code("not", f"{here} AND {v}.{n} IS NOT NULL", lead + n) for n in rule.forbid]
    return singles, lists


def sql_problems(spec, v="", depth=0):
    singles, lists = sql_checks(spec, v, "", depth)
    c = f"c{depth}"
    found = f"list_filter([{', '.join(singles)}]::VARCHAR[], lambda {c}: {c} IS NOT NULL)" if singles else "[]::VARCHAR[]"
    return f"flatten([{', '.join([found, *lists])}])"


# ---- documents in both dialects ------------------------------------------------------------------


class Writer:
    """Renders nested values for Spark or DuckDB; ``bad(r)`` marks the rows on which rule ``r`` is broken."""

    def __init__(self, dialect: str):
        self.spark = dialect == "spark"
        self.dialect, self.count = dialect, 0

    def bad(self) -> str:
        self.count += 1
        return f"E % 211 = {self.count}"

    def off(self, value: str, wrong: str = "CAST(NULL AS STRING)") -> str:
        return f"CASE WHEN {self.bad()} THEN {wrong} ELSE {value} END"

    def name(self, value: str) -> str:
        """A required text, missing on some rows and empty on others."""
        return self.off(self.off(value, "''"))

    def struct(self, fields: dict) -> str:
        if self.spark:
            return "named_struct(" + ", ".join(f"'{k}', {v}" for k, v in fields.items()) + ")"
        return "{" + ", ".join(f"'{k}': {v}" for k, v in fields.items()) + "}"

    def list(self, *items: str) -> str:
        return f"{'array' if self.spark else 'list_value'}({', '.join(items)})"

    def many(self, n: str, i: str, item: str) -> str:
        """``n`` items, 1 to 3; for Spark each is written out."""
        most = {"1": 1, "2": 2, "(1 + E % 2)": 2}.get(n, 3)
        written = lambda: ", ".join(re.sub(rf"\b{i}\b", str(k), item) for k in range(most))
        return f"slice(array({written()}), 1, CAST({n} AS INT))" if self.spark else f"list_transform(range(CAST({n} AS BIGINT)), lambda {i}: {item})"

    def emptied(self, items: str) -> str:
        """Without items on some rows."""
        return f"CASE WHEN {self.bad()} THEN {self.never(items)} ELSE {items} END"

    def never(self, items: str) -> str:
        """An empty list of the type of ``items``."""
        return f"filter({items}, q -> false)" if self.spark else f"list_filter({items}, lambda q: false)"

    def absent(self, value: str) -> str:
        return f"CASE WHEN {self.bad()} THEN NULL ELSE {value} END"

    def free(self, entries: dict) -> str:
        """A free object; SQL never looks inside."""
        return ("map(" if self.spark else "MAP {") + ", ".join(f"'{k}'{', ' if self.spark else ': '}{v}" for k, v in entries.items()) + (")" if self.spark else "}")


def text_of(x: str) -> str:
    return f"CAST({x} AS STRING)"


def episode_fields(dialect: str) -> dict:
    w = Writer(dialect)
    iso = {s: ISO[dialect].format(s=s) for s in ("0", "E % 23 - (CASE WHEN E % 211 = 200 THEN 23 ELSE 0 END)")}
    start, end = iso.values()
    stamp = lambda v: w.off(w.off(v, "'yesterday'"))
    offset = lambda v: w.off(w.off(v, "-1"), "NULL")
    names = lambda *v: w.list(*v)
    observation = {
        "observation_ref": w.name(f"'o' || {text_of('i')}"), "modality": w.off(w.off("CASE (E + i) % 3 WHEN 0 THEN 'visual_pose' WHEN 1 THEN 'audio_vocalisation' ELSE 'object_environment' END", "'thermal'")),
        "schema_ref": w.name("'schema'"), "record_ids": w.absent(w.emptied(names("'r0'", w.off(w.off("'r1'", "''"))))), "source_uri": "'uri'",
        "start_offset_ms": offset("i * 10"), "end_offset_ms": offset("CASE WHEN E % 211 = 201 THEN 90000 WHEN E % 211 = 202 THEN 0 ELSE i * 10 + 5 END"),
    }
    hypothesis = {
        "hypothesis_id": w.name(f"'h' || {text_of('CASE WHEN E % 211 = 203 THEN 0 ELSE i END')}"), "kind": w.off(w.off("CASE (E + i) % 3 WHEN 0 THEN 'human_label' WHEN 1 THEN 'latent_state' ELSE 'unknown' END", "'guess'")),
        "label": f"CASE WHEN (E + i) % 3 = 0 THEN {w.name("'play'")} ELSE {w.off('CAST(NULL AS STRING)', "'smuggled'")} END",
        "state_ref": f"CASE WHEN (E + i) % 3 = 1 THEN {w.name("'z1'")} ELSE {w.off('CAST(NULL AS STRING)', "'smuggled'")} END",
        "probability": w.off(w.off(w.off(w.off("CAST(0.25 AS DOUBLE)", "CAST(7.5 AS DOUBLE)"), "CAST(-0.5 AS DOUBLE)"), "CAST('NaN' AS DOUBLE)"), "CAST(NULL AS DOUBLE)"),
        "source": w.off(w.off("'model'", "'oracle'")), "calibration_model": "'c'", "evidence_refs": names("'v0'", w.off(w.off("'v1'", "'v0'"), "''")),
    }
    action = {"action_id": w.name(f"'a' || {text_of('i')}"), "action_type": w.name("'open_door'"), "offset_ms": offset("i * 100"), "actor_id": "'p'", "target_id": "'t'"}
    prediction = {"hypothesis_ref": w.name(f"'h' || {text_of('j')}"), "expected_response": w.name("'approach'"), "response_window_ms": w.off("500", "-5")}
    intervention = {
        "intervention_id": w.name(f"'x' || {text_of('i')}"), "action_ref": w.name("CASE WHEN E % 211 = 204 THEN 'a9' ELSE 'a0' END"),
        "candidate_hypotheses": w.absent(w.off(names("'h0'", w.off(w.off("CASE WHEN E % 211 = 205 THEN 'h9' ELSE 'h1' END", "'h0'"), "''")), names("'h0'"))),
        "predictions": w.absent(w.emptied(w.many("(CASE WHEN E % 211 = 206 THEN 3 ELSE 2 END)", "j", w.struct(prediction)))), "selection_policy": "'naturalistic'",
        "safety_class": w.off(w.off("'ordinary_low_risk_household_action'", "'high'")),
    }
    outcome = {
        "outcome_id": w.name(f"'r' || {text_of('i')}"), "outcome_type": w.off(w.off("'signalling_termination'", "'success'")), "start_offset_ms": offset("CASE WHEN E % 211 = 207 THEN 70000 ELSE 100 END"),
        "end_offset_ms": w.off(w.off("CASE WHEN E % 211 = 207 THEN 70001 WHEN E % 211 = 208 THEN 50 ELSE 200 END", "-1"), "NULL"), "observation_source": w.off(w.off("'sensor'", "'rumour'")), "description": "'d'",
        "signalling_terminated": "i = 0", "supports_hypotheses": names("'h0'", w.off(w.off("CASE WHEN E % 211 = 209 THEN 'h7' ELSE 'h1' END", "'h0'"), "''")), "contradicts_hypotheses": names(w.off("'h0'", "''")),
    }
    thing = {"object_id": w.name("'door'"), "object_type": w.name("'door'"), "relation_to_subject": "'near'"}
    being = {"entity_id": w.name("'p1'"), "entity_type": w.off(w.off("'human'", "'robot'")), "relationship": "'owner'", "distance_m": w.off("CAST(1.5 AS DOUBLE)", "CAST(-1.5 AS DOUBLE)"), "orientation": "'facing'"}
    return {
        "schema_version": w.off(w.off("'0.1.0'", "'0.0.9'")), "event_id": w.name(f"'e' || {text_of('E')}"), "episode_id": w.name(f"'ep' || {text_of('E')}"),
        "subject_id": w.name(text_of("user_id")), "household_id": w.name(text_of("user_id % 10")), "session_id": w.name("'s1'"),
        "time": w.absent(w.struct({"start_time": stamp(start), "end_time": stamp(end), "start_offset_ms": offset("0"), "end_offset_ms": offset("60000"), "clock_source": w.off("'clock'", "''"), "uncertainty_ms": w.off("CAST(1 AS DOUBLE)", "CAST(-1 AS DOUBLE)")})),
        "observations": w.absent(w.emptied(w.many("(1 + E % 3)", "i", w.struct(observation)))), "hypotheses": w.absent(w.emptied(w.many("(2 + E % 2)", "i", w.struct(hypothesis)))),
        "human_actions": w.absent(w.many("(1 + E % 2)", "i", w.struct(action))), "interventions": w.absent(w.many("(1 + E % 2)", "i", w.struct(intervention))), "outcomes": w.absent(w.many("(1 + E % 2)", "i", w.struct(outcome))),
        "context": w.absent(w.struct({"location": "CASE WHEN E % 5 = 0 THEN NULL ELSE 'hall' END", "objects": w.absent(w.many("1", "i", w.struct(thing))), "social": w.absent(w.many("2", "i", w.struct(being)))})),
        "missing_modalities": w.absent(names("'physiology'", w.off(w.off("'other'", "'physiology'"), "'thermal'"))),
        "uncertainty": w.struct({"episode_confidence": w.off(w.off("CAST(0.5 AS DOUBLE)", "CAST(2 AS DOUBLE)"), "CAST(-2 AS DOUBLE)"), "notes": "'n'"}),
        "provenance": w.absent(w.struct({"source_ids": w.absent(w.emptied(names("'s0'", w.off(w.off("'s1'", "'s0'"), "''")))), "lineage": w.absent(w.emptied(names(w.off("'l0'", "''")))),
                                         "annotation_source": w.off(w.off("'observed'", "'guessed'")), "annotator_ids": names("'n0'", w.off(w.off("'n1'", "'n0'"), "''"))})),
        "privacy": w.absent(w.struct({"data_class": w.off(w.off("'synthetic'", "'secret'")), "consent_status": w.off(w.off("'recorded'", "'unknown'")), "consent_record_id": "'c'", "retention_policy": "'p'",
                                      "contains_human_audio": "false", "contains_human_image": "false"})),
        "notes": "'n'",
    }


def plan_fields(dialect: str) -> dict:
    w = Writer(dialect)
    offset = lambda v: w.off(w.off(v, "-1"), "NULL")
    share = lambda v: w.off(w.off(v, "CAST(3 AS DOUBLE)"), "CAST(-3 AS DOUBLE)")
    hypothesis = {"hypothesis_id": w.name(f"'h' || {text_of('CASE WHEN E % 211 = 150 THEN 0 ELSE i END')}"), "kind": w.off(w.off("CASE WHEN (E + i) % 2 = 0 THEN 'latent_state' ELSE 'unknown' END", "'hunger'")),
                  "state_ref": f"CASE WHEN (E + i) % 2 = 0 THEN {w.name("'z1'")} ELSE NULL END", "probability": w.off(share("CASE WHEN E % 211 = 151 THEN CAST(0.6 AS DOUBLE) ELSE CAST(0.5 AS DOUBLE) END"), "CAST(NULL AS DOUBLE)")}
    observable = {"observable": w.off(w.off("'toy_engagement'", "'purr'")), "window": w.off(w.off("'short_5_30s'", "'later'")), "expectation": w.name("'rises'"), "probability": share("CAST(0.7 AS DOUBLE)")}
    prediction = {"hypothesis_ref": w.name(f"'h' || {text_of('CASE WHEN E % 211 = 152 THEN 0 WHEN E % 211 = 153 THEN i + 1 ELSE i END')}"), "observables": w.absent(w.emptied(w.many("(1 + E % 2)", "j", w.struct(observable))))}
    kinds = "CASE E % 4 WHEN 0 THEN 'continue_due_feeding_routine' WHEN 1 THEN 'brief_no_action_observation' ELSE 'present_toy' END"
    parameters = w.free({"feeding_due": "CASE WHEN E % 8 = 4 THEN 'false' ELSE 'true' END", "necessary_care_pending": "CASE WHEN E % 16 = 5 THEN 'true' ELSE 'false' END", "duration_ms": text_of("(E * 37) % 12000")})
    return {
        "plan_version": w.off(w.off("'0.1.0'", "'1.0'")), "plan_id": w.name(f"'p' || {text_of('E')}"), "event_id": w.name(f"'e' || {text_of('E')}"), "phase": w.off(w.off(f"'I1.' || {text_of('E % 3')}", "'I9'")),
        "recorded_offset_ms": offset("CASE WHEN E % 211 = 154 THEN 900 ELSE E % 50 END"), "selection_policy": w.off("CASE E % 5 WHEN 0 THEN 'expected_information_gain' WHEN 1 THEN 'randomized_safe_set' WHEN 2 THEN NULL ELSE 'naturalistic' END", "'greedy'"),
        "action": w.absent(w.struct({"action_id": w.name("'a0'"), "action_type": w.off(w.off(kinds, "'shout'")), "scheduled_offset_ms": offset("100"), "parameters": w.absent(parameters)})),
        "hypotheses": w.absent(w.emptied(w.many("2", "i", w.struct(hypothesis)))), "predictions": w.absent(w.emptied(w.many("2", "i", w.struct(prediction)))),
        "safety": w.absent(w.struct({"eligible": w.off(w.off("true", "false"), "NULL"), "safety_class": w.off(w.off("'ordinary_low_risk_household_action'", "'high'")), "stop_conditions_acknowledged": w.off(w.off("true", "false"), "NULL"),
                                     "necessary_care_pending": "false", "notes": "'n'"})),
    }


def records(spark, sf, fields: dict):
    """Records of every event in the types of their declaration, as a reader would give them, with the event's number."""
    return spread(table(spark, sf, "events")).selectExpr("event_id AS E", "user_id", "ts").selectExpr("E AS row_id", *[f"{v} AS {k}" for k, v in fields.items()])


def sql_records(fields: dict) -> str:
    return "SELECT E AS row_id, " + ",\n ".join(f"{v} AS {k}" for k, v in fields.items()) + " FROM (SELECT event_id AS E, user_id, ts FROM events)"


def declared(v, have, spec):
    """``v`` of type ``have`` in the declared type: fields by name, those that are left out NULL."""
    if have.simpleString() == "void" or have.simpleString().replace(" ", "") == ddl(spec).replace(" ", ""):
        return v.cast(ddl(spec))
    if isinstance(spec, Record):
        parts = {n: declared(v[n], have[n].dataType, s) if n in have.names else F.lit(None).cast(ddl(s)) for n, s in spec.fields.items()}
        return F.when(v.isNotNull(), F.struct(*[c.alias(n) for n, c in parts.items()]))
    if isinstance(spec, Items):
        return F.transform(v, lambda x: declared(x, have.elementType, spec.of))
    return v.cast(ddl(spec))


def typed(docs, spec):
    """Columns in the declared types; fields that the documents leave out are NULL."""
    have = {f.name: f.dataType for f in docs.schema.fields}
    return docs.select("row_id", *[(declared(F.col(n), have[n], s) if n in have else F.lit(None).cast(ddl(s))).alias(n) for n, s in spec.fields.items()])


def joined(df):
    return df.select("row_id", F.array_join("errors", ";").alias("errors"))


FLAT = """, v_docs AS (SELECT row_id AS event_id, time.start_time AS start_time, time.end_time AS end_time, time.end_offset_ms AS end_offset_ms, observations, hypotheses, human_actions,
 list_transform(interventions, lambda i: {'intervention_id': i.intervention_id, 'action_ref': i.action_ref, 'candidates': i.candidate_hypotheses, 'predictions': list_transform(i.predictions, lambda p: p.hypothesis_ref)}) AS interventions,
 list_transform(outcomes, lambda o: {'outcome_id': o.outcome_id, 'start_offset_ms': o.start_offset_ms, 'end_offset_ms': o.end_offset_ms, 'supports': list_distinct(list_concat(o.supports_hypotheses, o.contradicts_hypotheses))}) AS outcomes FROM v_doc)"""
DOCUMENT_ERRORS = f"""WITH v_doc AS ({sql_records(episode_fields("duckdb"))}), st AS (SELECT row_id, list_sort(list_distinct({sql_problems(EPISODE)})) AS errs FROM v_doc){FLAT}{UN},
deep AS ({DEEP_SQL}), dp AS (SELECT event_id AS row_id, string_agg(DISTINCT code, ';' ORDER BY code) AS codes FROM deep GROUP BY 1),
ee AS (SELECT row_id, CASE WHEN len(errs) > 0 THEN array_to_string(errs, ';') ELSE coalesce(codes, '') END AS errors FROM st LEFT JOIN dp USING (row_id))"""


@query("validate_documents", "V1", DOCUMENT_ERRORS + " SELECT row_id, errors FROM ee")
def validate_documents(spark, sf):
    return joined(rc.validate_documents(typed(records(spark, sf, episode_fields("spark")), EPISODE), ["row_id"]))


PLAN_ERRORS = f"""WITH v_doc AS ({sql_records(plan_fields("duckdb"))}), st AS (SELECT row_id, list_sort(list_distinct({sql_problems(PLAN)})) AS errs FROM v_doc),
pl AS (SELECT row_id AS event_id, recorded_offset_ms, action.scheduled_offset_ms AS scheduled_offset_ms, action.action_type AS action_type, hypotheses, list_transform(predictions, lambda p: p.hypothesis_ref) AS predictions, phase,
 coalesce(selection_policy, 'naturalistic') AS policy, action.parameters['feeding_due'] = 'true' AS feeding_due, action.parameters['necessary_care_pending'] = 'true' AS care_pending, action.parameters['duration_ms']::BIGINT AS duration_ms FROM v_doc),
ph AS (SELECT event_id, unnest(hypotheses) AS x FROM pl), ids AS (SELECT event_id, list(x.hypothesis_id) AS ids, sum(x.probability) AS s FROM ph GROUP BY 1), """
PLAN_RULES = collect_rules("pl", "event_id", [
    ("'recorded_after_action'", "pl WHERE recorded_offset_ms >= scheduled_offset_ms"), ("'hypothesis_ids_not_unique'", DUP.format(src="ph", id="hypothesis_id")),
    ("'probabilities_do_not_sum_to_one'", "ids WHERE abs(s - 1) > 1e-6"), ("'prediction_unknown'", "pl JOIN ids USING (event_id) WHERE NOT list_has_all(ids, predictions)"),
    ("'prediction_missing'", "pl JOIN ids USING (event_id) WHERE NOT list_has_all(predictions, ids)"), ("'prediction_repeated'", "pl WHERE len(list_distinct(predictions)) < len(predictions)"),
    ("'feeding_not_due'", "pl WHERE action_type = 'continue_due_feeding_routine' AND feeding_due IS NOT TRUE"), ("'care_pending'", "pl WHERE action_type = 'brief_no_action_observation' AND care_pending IS NOT FALSE"),
    ("'no_action_too_long'", "pl WHERE action_type = 'brief_no_action_observation' AND NOT duration_ms BETWEEN 1 AND 10000"),
    ("'policy_reserved_for_phase_2'", "pl WHERE policy = 'expected_information_gain' AND phase <> 'I1.2'"), ("'policy_not_before_phase_1'", "pl WHERE policy = 'randomized_safe_set' AND phase = 'I1.0'"),
])


@query("validate_plan_documents", "V3", PLAN_ERRORS + "sem AS (WITH " + PLAN_RULES + ") SELECT row_id, CASE WHEN len(errs) > 0 THEN array_to_string(errs, ';') ELSE sem.errors END AS errors FROM st JOIN sem ON sem.event_id = st.row_id")
def validate_plan_documents(spark, sf):
    return joined(rc.validate_plan_documents(typed(records(spark, sf, plan_fields("spark")), PLAN), ["row_id"]))


# ---- snapshots -----------------------------------------------------------------------------------

def snapshot_documents(spark, sf):
    """Sound documents (every document of the schema's with no broken rule) with snapshots that agree, disagree in one field, or agree in another order of keys."""
    docs = typed(records(spark, sf, sound_fields("spark")), EPISODE)
    k = F.col("row_id") % 13
    words = lambda a, b: F.concat(F.lit("{"), F.when(k == 6, F.concat(F.lit(b), F.lit(", "), F.lit(a))).otherwise(F.concat(F.lit(a), F.lit(", "), F.lit(b))), F.lit("}"))
    said = F.map_from_arrays(
        F.array(*map(F.lit, ("captured_at", "location", "objects", "social", "environment"))),
        F.array(
            F.when(k == 1, F.lit("2001-01-01T00:00:00+10:00")).otherwise(F.col("time.start_time")), F.when(k == 2, F.lit("attic")).otherwise(F.col("context.location")),
            F.concat(F.lit("["), words('"object_id": "door"', '"object_type": "door"'), F.when(k == 3, F.lit(', {"object_id": "d2", "object_type": "shelf"}')).otherwise(F.lit("")), F.lit("]")),
            F.when(k == 4, F.lit('[{"entity_id": "p2", "entity_type": "cat"}]')).otherwise(F.concat(F.lit("["), words('"entity_id": "p1"', '"entity_type": "human"'), F.lit("]"))),
            F.when(k == 5, F.lit('{"light": "off"}')).otherwise(words('"light": "on"', '"noise": {"db": 3, "from": "tv"}')),
        ))
    shot = lambda o: F.struct(
        o["observation_ref"].alias("observation_ref"), F.lit(rc.SNAPSHOT_MODALITY).alias("modality"), F.lit(rc.SNAPSHOT_SCHEMA).alias("schema_ref"), o["record_ids"].alias("record_ids"), o["source_uri"].alias("source_uri"),
        o["start_offset_ms"].alias("start_offset_ms"), F.when(k == 7, F.lit(5).cast("long")).otherwise(F.lit(0).cast("long")).alias("end_offset_ms"), F.when(k != 8, said).alias("features"), o["uncertainty"].alias("uncertainty"))
    first = F.slice("observations", 1, 1)
    rest = F.slice("observations", 2, 9)
    shots = F.when(k == 9, F.concat(F.transform(first, shot), F.transform(first, lambda o: shot(o).withField("observation_ref", F.lit("again"))), rest)).when(k == 10, F.col("observations")).otherwise(F.concat(F.transform(first, shot), rest))
    environment = F.create_map(F.lit("noise"), F.lit('{"from": "tv", "db": 3}'), F.lit("light"), F.lit("on"))
    return docs.withColumns({"observations": shots, "context": F.col("context").withField("environment", environment)})


def sound_fields(dialect: str) -> dict:
    """Fields of documents that break no rule."""
    w = Writer(dialect)
    iso = ISO[dialect].format(s="0")
    start = {"observation_ref": f"'o' || {text_of('i')}", "modality": "'visual_pose'", "schema_ref": "'schema'", "record_ids": w.list("'r0'"), "start_offset_ms": "0", "end_offset_ms": "5"}
    return {
        "schema_version": "'0.1.0'", "event_id": f"'e' || {text_of('E')}", "episode_id": f"'ep' || {text_of('E')}", "subject_id": text_of("user_id"), "household_id": text_of("user_id % 10"), "session_id": "'s1'",
        "time": w.struct({"start_time": iso, "end_time": iso, "start_offset_ms": "0", "end_offset_ms": "60000"}), "observations": w.many("(1 + E % 3)", "i", w.struct(start)),
        "hypotheses": w.many("1", "i", w.struct({"hypothesis_id": "'h0'", "kind": "'unknown'", "probability": "CAST(1 AS DOUBLE)", "source": "'prior'"})),
        "human_actions": w.never(w.many("1", "i", w.struct({"action_id": "'a0'"}))), "interventions": w.never(w.many("1", "i", w.struct({"intervention_id": "'x0'"}))), "outcomes": w.never(w.many("1", "i", w.struct({"outcome_id": "'r0'"}))),
        "context": w.struct({"location": "CASE WHEN E % 5 = 0 THEN CAST(NULL AS STRING) ELSE 'hall' END", "objects": w.list(w.struct({"object_id": "'door'", "object_type": "'door'"})), "social": w.list(w.struct({"entity_id": "'p1'", "entity_type": "'human'"}))}),
        "missing_modalities": w.list("'physiology'"), "provenance": w.struct({"source_ids": w.list("'s0'"), "lineage": w.list("'l0'"), "annotation_source": "'observed'"}), "privacy": w.struct({"data_class": "'synthetic'", "consent_status": "'recorded'"}),
    }


@query("validate_capture_documents", "V2 P9", """SELECT event_id AS row_id, CASE event_id % 13 WHEN 1 THEN 'captured_at_differs' WHEN 2 THEN 'snapshot_location_differs' WHEN 3 THEN 'snapshot_objects_differs' WHEN 4 THEN 'snapshot_social_differs'
 WHEN 5 THEN 'snapshot_environment_differs' WHEN 7 THEN 'snapshot_not_at_zero' WHEN 8 THEN 'snapshot_without_features' WHEN 9 THEN 'snapshot_count_not_one' WHEN 10 THEN 'snapshot_count_not_one' ELSE '' END AS errors FROM events""")
def validate_capture_documents(spark, sf):
    return joined(rc.validate_capture_documents(snapshot_documents(spark, sf), ["row_id"]))


@query("snapshot_contexts", "P9", """SELECT event_id AS row_id, CASE WHEN event_id % 13 = 8 THEN NULL WHEN event_id % 13 = 2 THEN 'attic' WHEN event_id % 5 = 0 THEN NULL ELSE 'hall' END AS location,
 CASE event_id % 13 WHEN 8 THEN NULL WHEN 3 THEN 'door,d2' ELSE 'door' END AS objects, CASE event_id % 13 WHEN 8 THEN NULL WHEN 4 THEN 'cat' ELSE 'human' END AS social,
 CASE event_id % 13 WHEN 8 THEN '' WHEN 5 THEN 'light' ELSE 'light,noise' END AS environment, CASE event_id % 13 WHEN 8 THEN NULL WHEN 5 THEN 'off' ELSE 'on' END AS light FROM events WHERE event_id % 13 NOT IN (9, 10)""")
def snapshot_contexts(spark, sf):
    c = rc.snapshot_contexts(snapshot_documents(spark, sf))
    ids = lambda items, name: F.array_join(F.transform(F.col(f"context.{items}"), lambda x: x[name]), ",")
    return c.select("row_id", F.col("context.location").alias("location"), ids("objects", "object_id").alias("objects"), ids("social", "entity_type").alias("social"),
                    F.array_join(F.array_sort(F.map_keys("context.environment")), ",").alias("environment"), F.try_element_at("context.environment", F.lit("light")).alias("light"))
