"""Sources and sinks: data derived from the tables is written to the shared folder and read back."""

from pyspark.sql import functions as F

from evidencelens.catalog import query
from evidencelens.functions import fingerprint, r6
from evidencelens.session import scratch_path
from evidencelens.sources import documents as doc
from evidencelens.sources import tables as tb
from evidencelens.views import table


@query("read_table_csv", "S1", "SELECT o_orderkey::VARCHAR AS o_orderkey, o_orderstatus, round(o_totalprice, 2) AS price FROM orders")
def read_csv(spark, sf):
    path = scratch_path(spark, "csv")
    table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice").write.option("header", True).csv(path)
    out = tb.read_table_csv(spark, path, ["o_orderkey", "o_totalprice"])
    return out.select("o_orderkey", "o_orderstatus", r6(F.col("o_totalprice").cast("double"), 2).alias("price"))


NAME = "CASE event_id % 3 WHEN 0 THEN 'B' WHEN 1 THEN 'F' ELSE 'I' END || '_S' || CAST(user_id AS STRING) || '_' || CASE WHEN event_id % 2 = 0 THEN 'MC' ELSE 'EU' END || '_' || CASE event_id % 4 WHEN 0 THEN 'FI' WHEN 1 THEN 'FN' WHEN 2 THEN 'MI' ELSE 'MN' END || '_O' || CAST(user_id % 12 AS STRING) || '_' || CASE WHEN event_id % 50 = 3 THEN 'x' ELSE CAST(1 + event_id % 4 AS STRING) END || CAST(10 + event_id % 90 AS STRING)"
PATH = f"'clips/' || CAST(event_id % 7 AS STRING) || '/' || {NAME} || CASE WHEN event_id % 60 = 5 THEN '.mp3' ELSE '.wav' END"


@query("manifest_from_paths", "S2", f"""
WITH p AS (SELECT {PATH} AS path FROM events), q AS (SELECT path, string_split(path, '/')[3] AS filename, regexp_replace(string_split(path, '/')[3], '\\.[^.]*$', '') AS stem, count(*) OVER (PARTITION BY path) AS c FROM p),
r AS (SELECT *, CASE WHEN regexp_full_match(stem, '[BFI]_[^_]+_(MC|EU)_(FI|FN|MI|MN)_[^_]+_[0-9][0-9][0-9]') THEN string_split(stem, '_') END AS s FROM q)
SELECT path, filename, s[1] AS context_code, s[2] AS subject_id, s[3] AS breed_code, s[4] AS sex_code, s[5] AS owner_id, substr(s[6], 1, 1)::INT AS session, substr(s[6], 2, 2)::INT AS vocalisation_index,
 CASE s[1] WHEN 'B' THEN 'brushing' WHEN 'F' THEN 'waiting_for_food' WHEN 'I' THEN 'isolation_unfamiliar_environment' END AS context,
 CASE s[4] WHEN 'FI' THEN 'female_intact' WHEN 'FN' THEN 'female_neutered' WHEN 'MI' THEN 'male_intact' WHEN 'MN' THEN 'male_neutered' END AS sex, CASE s[3] WHEN 'MC' THEN 'maine_coon' WHEN 'EU' THEN 'european_shorthair' END AS breed,
 s[2] || ':' || substr(s[6], 1, 1) AS sequence_group, concat_ws(';', CASE WHEN c > 1 THEN 'duplicate_path' END, CASE WHEN filename LIKE '%.wav' AND s IS NULL THEN 'name_outside_convention' END, CASE WHEN filename NOT LIKE '%.wav' THEN 'not_a_wav_file' END) AS errors FROM r""")
def manifest(spark, sf):
    paths = table(spark, sf, "events").selectExpr(f"{PATH} AS path")
    return tb.manifest_from_paths(paths).withColumn("errors", F.array_join(F.array_sort("errors"), ";"))


def _episode_json(spark, sf):
    """Full-schema episode documents of every event, as one struct column."""
    return table(spark, sf, "events").selectExpr(
        "IF(event_id % 47 = 0, '0.0.9', '0.1.0') AS schema_version", "IF(event_id % 53 = 0, '', concat('e', event_id)) AS event_id", "concat('ep', event_id) AS episode_id", "CAST(user_id AS string) AS subject_id",
        "CAST(user_id % 10 AS string) AS household_id",
        "named_struct('start_time', date_format(CAST(ts AS timestamp), \"yyyy-MM-dd'T'HH:mm:ss\") || '+00:00', 'start_offset_ms', 0, 'end_offset_ms', 60000) AS time",
        "transform(sequence(0, CAST(event_id % 3 AS INT)), i -> named_struct('action_id', concat('a', i), 'action_type', 'open door', 'offset_ms', i * 1000)) AS human_actions",
        "named_struct('location', event_type, 'social', array(named_struct('entity_type', 'human', 'distance_m', value))) AS context",
        "named_struct('software_versions', IF(event_id % 6 = 0, map('sensor_composer', 'v0'), map('capture', 'v1'))) AS provenance")


@query("read_episodes", "S3", """SELECT CASE WHEN event_id % 53 = 0 THEN '' ELSE 'e' || event_id END AS event_id, 'ep' || event_id AS episode_id, event_type AS location, event_id % 3 + 1 AS n_actions, round(value, 6) AS distance_m,
 strftime(ts, '%Y-%m-%dT%H:%M:%S') || '+00:00' AS start_time FROM events""")
def read_episodes(spark, sf):
    path = scratch_path(spark, "episodes")
    _episode_json(spark, sf).write.json(path)
    e = doc.read_episodes(spark, path, multi_line=False)
    return e.select("event_id", "episode_id", F.col("context.location").alias("location"), F.size("human_actions").cast("long").alias("n_actions"), r6(F.col("context.social")[0]["distance_m"]).alias("distance_m"), F.col("time.start_time").alias("start_time"))


@query("discover_episodes", "S4 T5", """SELECT event_id % 6 = 0 AS derived, count(*) AS documents, count(DISTINCT user_id % 10) AS households FROM events
 WHERE event_id % 47 > 0 AND event_id % 53 > 0 AND event_id % 31 > 0 GROUP BY 1""")
def discover(spark, sf):
    """Every 31st line is cut off in the middle, as a torn write leaves it."""
    path = scratch_path(spark, "capture")
    docs = _episode_json(spark, sf)
    line = F.to_json(F.struct(*docs.columns))
    torn = F.substring("episode_id", 3, 20).cast("long") % 31 == 0
    docs.select(F.when(torn, F.substring(line, 1, 40)).otherwise(line).alias("value")).write.text(path)
    found = doc.discover_episodes(spark, path, "sensor_composer", glob="*.txt", multi_line=False)
    return found.groupBy("derived").agg(F.count(F.lit(1)).alias("documents"), F.count_distinct("household_id").alias("households"))


@query("read_instance_annotations", "S5 F12", """
WITH e AS (SELECT event_id // 200 AS shard, event_id, event_id % 2 + 1 AS cat FROM events)
SELECT shard, 'annotation' AS kind, event_id AS id, event_id % 4 > 0 AS visible FROM e WHERE cat = 1 AND shard % 5 <> 2 AND shard % 9 <> 4
UNION ALL SELECT shard, 'error:category_not_unique', NULL, NULL FROM (SELECT DISTINCT shard FROM e) WHERE shard % 5 = 2 OR shard % 9 = 4""")
def annotations(spark, sf):
    path = scratch_path(spark, "annotations")
    e = table(spark, sf, "events").selectExpr(
        "event_id div 200 AS shard", "named_struct('id', event_id, 'video_id', event_id div 200, 'category_id', event_id % 2 + 1, 'segmentations', array(named_struct('counts', array(IF(event_id % 4 > 0, 3L, 0L), 0L)))) AS a")
    d = e.groupBy("shard").agg(F.collect_list("a").alias("annotations")).selectExpr(
        "array(named_struct('id', shard, 'width', 640, 'height', 480, 'length', 1, 'file_names', array('f'))) AS videos", "annotations",
        "CASE WHEN shard % 5 = 2 THEN array(named_struct('id', 1, 'name', 'other')) WHEN shard % 9 = 4 THEN array(named_struct('id', 1, 'name', 'target'), named_struct('id', 3, 'name', 'TARGET')) "
        "ELSE array(named_struct('id', 1, 'name', ' Target '), named_struct('id', 2, 'name', 'other')) END AS categories")
    d.write.json(path)
    from evidencelens.functions import seg_visible

    videos, ann, errors = doc.read_instance_annotations(spark, path, "target", multi_line=False)
    shard = videos.select("file", F.col("id").alias("shard"))
    rows = ann.join(shard, "file").select("shard", F.lit("annotation").alias("kind"), "id", seg_visible(F.col("segmentations")[0]["counts"]).alias("visible"))
    return rows.unionByName(errors.join(shard, "file").select("shard", F.concat(F.lit("error:"), "error").alias("kind"), "id", F.lit(None).cast("boolean").alias("visible")))


@query("file_digests", "S9")
def file_digests(spark, sf):
    actual = tb.file_digests(spark, sf, "*.parquet")
    declared = actual.withColumn("byte_length", F.when(F.col("path").contains("orders"), F.col("byte_length") + 1).otherwise(F.col("byte_length")))
    return tb.verify_digests(declared, actual).select(F.element_at(F.split("path", "/"), -1).alias("file"), "byte_length", F.array_join("errors", ";").alias("errors"))


@query("write_report", "S11", "SELECT o_orderstatus, count(*) AS orders, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1")
def write_report(spark, sf):
    path = scratch_path(spark, "report")
    rep = table(spark, sf, "orders").groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("orders"), F.sum("o_totalprice").alias("total"))
    tb.write_report(rep, path, "json")
    return spark.read.schema("o_orderstatus string, orders long, total double").json(path).withColumn("total", r6("total", 2))


@query("fingerprint", "F7", """SELECT o_orderkey, o_custkey % 5 = 0 AS tampered FROM orders""")
def fingerprint_query(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")
    sealed = o.select("o_orderkey", fingerprint("o_custkey", "o_orderstatus", "o_totalprice").alias("sealed"))
    now = o.withColumn("o_totalprice", F.when(F.col("o_custkey") % 5 == 0, F.col("o_totalprice") + 0.01).otherwise(F.col("o_totalprice")))
    j = now.join(sealed, "o_orderkey")
    return j.select("o_orderkey", (fingerprint("o_totalprice", "o_custkey", "o_orderstatus") != F.col("sealed")).alias("tampered"))
