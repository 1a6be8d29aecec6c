"""Views that give the driver tables the shapes of the data model.

Each view exists twice: as a DataFrame for the engine and as a ``WITH`` clause for the SQL check.
All are row-local projections (no window, no grouping), so they scale with the tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Rows dealt evenly over the session's shuffle partitions, at every size.

    For costly row-local work on a narrow table whose files may be few: one shuffle of the narrow rows before they grow.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


SQL_VIEWS = {
    "v_episodes": """
 SELECT event_id, user_id AS subject_id, user_id % 10 AS household_id, event_type AS location, value,
        epoch_us(ts) AS start_us,
        CASE WHEN value >= 20 THEN true WHEN value >= 2 THEN false END AS terminated,
        epoch_us(ts) + (event_id % 61) * 1000000 AS outcome_us,
        CASE event_type WHEN 'view' THEN 'serve_meal' WHEN 'click' THEN 'open_door'
             WHEN 'signup' THEN 'pet_contact' WHEN 'purchase' THEN 'play_toy' ELSE 'other' END AS action_type,
        CASE event_type WHEN 'view' THEN 'food' WHEN 'click' THEN 'access'
             WHEN 'signup' THEN 'social' WHEN 'purchase' THEN 'play' END AS category,
        epoch_us(ts) + ((event_id * 7) % 61) * 1000000 AS action_us
 FROM events""",
    "v_clips": """
 SELECT vec_id AS path, label % 3 AS context, vec_id % 21 AS group_id, (vec_id % 21) // 2 AS owner_id,
        (vec_id // 21) % 4 + 1 AS session,
        embedding[1]::DOUBLE AS f1, embedding[2]::DOUBLE AS f2, embedding[3]::DOUBLE AS f3,
        embedding[4]::DOUBLE AS f4
 FROM embeddings""",
    "v_keypoints": """
 SELECT o_orderkey // 300 AS sequence_id, o_orderkey % 300 AS frame_index, pos, name,
        o_totalprice / 1000.0 + 10 * pos AS x_px, (o_orderkey % 97) + 5::DOUBLE * pos AS y_px,
        ((o_orderkey * (pos + 3)) % 11) - 5::DOUBLE AS z,
        ((o_orderkey * (pos + 7) + o_custkey) % 10) / 10.0 AS score,
        CASE WHEN (o_custkey + pos) % 17 = 0 THEN 'camera' ELSE 'world' END AS coordinate_frame
 FROM orders CROSS JOIN (VALUES (0,'nose'),(1,'left_paw'),(2,'right_paw'),(3,'tail_tip')) n(pos, name)""",
    "v_track": """
 SELECT event_id // 250 AS sequence_id, event_id % 250 AS frame_index, value AS x, (event_id * 13 % 100)::DOUBLE AS y,
        event_type <> 'error' AS visible, event_type AS state FROM events""",
    "v_scores": """
 SELECT vec_id // 10 AS event_id, vec_id % 10 AS frame_index, u.i - 1 AS class_pos, abs(embedding[u.i]::DOUBLE) AS score
 FROM embeddings, (SELECT unnest(range(1, 65)) AS i) u""",
    "v_predictions": """
 SELECT l.doc_id, l.quality AS y, l.doc_id % 5 AS fold,
        least(0.99, greatest(0.01, d.n_chars / 4000.0)) AS p, d.lang AS stratum
 FROM labels l JOIN documents d USING (doc_id)""",
    "v_proba": """
 SELECT vec_id, y, fold, a/(a+b+c) AS p0, b/(a+b+c) AS p1, c/(a+b+c) AS p2 FROM (
   SELECT vec_id, label % 3 AS y, vec_id % 21 AS fold, exp(4 * embedding[1]::DOUBLE) AS a,
          exp(4 * embedding[2]::DOUBLE) AS b, exp(4 * embedding[3]::DOUBLE) AS c FROM embeddings)""",
    "v_runs": """
 SELECT event_id // 200 AS sequence_id, (event_id % 200) // 10 AS frame_index, event_id % 5 AS instance_id,
        (event_id * 37) % 1000 AS start, least(1 + event_id % 50, 1000 - (event_id * 37) % 1000) AS len
 FROM events""",
    "v_boxes": """
 SELECT event_id // 200 AS sequence_id, (event_id % 200) // 5 AS frame_index, event_id % 5 AS instance_id,
        value AS bx, (event_id * 13 % 100)::DOUBLE AS by, ((event_id % 40) - 2)::DOUBLE AS bw, (30 + event_id % 9)::DOUBLE AS bh,
        event_type <> 'error' AS visible
 FROM events""",
    "v_turns": """
 SELECT conv_id AS sequence_id, turn AS frame_index, role AS state, length(text) AS n_chars FROM conversations""",
}


def with_views(*names: str) -> str:
    """``WITH v_a AS (...), v_b AS (...)`` prefix; callers append ``, x AS`` or ``SELECT``."""
    return "WITH " + ",".join(f"{n} AS ({SQL_VIEWS[n]})" for n in names)


def episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = F.unix_micros(F.col("ts").cast("timestamp"))
    return table(spark, sf_dir, "events").select(
        "event_id",
        F.col("user_id").alias("subject_id"),
        (F.col("user_id") % 10).alias("household_id"),
        F.col("event_type").alias("location"),
        "value",
        start.alias("start_us"),
        F.when(F.col("value") >= 20, True).when(F.col("value") >= 2, False).alias("terminated"),
        (start + (F.col("event_id") % 61) * 1000000).alias("outcome_us"),
        F.expr(
            "CASE event_type WHEN 'view' THEN 'serve_meal' WHEN 'click' THEN 'open_door' WHEN 'signup' "
            "THEN 'pet_contact' WHEN 'purchase' THEN 'play_toy' ELSE 'other' END"
        ).alias("action_type"),
        (start + ((F.col("event_id") * 7) % 61) * 1000000).alias("action_us"),
    )


def clips(spark: SparkSession, sf_dir: str, n_features: int = 4) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("path"),
        (F.col("label") % 3).alias("context"),
        (F.col("vec_id") % 21).alias("group_id"),
        F.expr("(vec_id % 21) div 2").alias("owner_id"),
        F.expr("(vec_id div 21) % 4 + 1").alias("session"),
        *[F.col("embedding")[i].cast("double").alias(f"f{i + 1}") for i in range(n_features)],
    )


def keypoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Landmark names by position.
    names = F.array(*[F.lit(n) for n in ("nose", "left_paw", "right_paw", "tail_tip")])
    return (
        table(spark, sf_dir, "orders")
        .select("o_orderkey", "o_custkey", "o_totalprice", F.posexplode(names).alias("pos", "name"))
        .selectExpr(
            "o_orderkey div 300 AS sequence_id", "o_orderkey % 300 AS frame_index", "pos", "name",
            "o_totalprice / 1000.0D + 10 * pos AS x_px", "(o_orderkey % 97) + 5.0D * pos AS y_px",
            "((o_orderkey * (pos + 3)) % 11) - 5.0D AS z",
            "((o_orderkey * (pos + 7) + o_custkey) % 10) / 10.0D AS score",
            "CASE WHEN (o_custkey + pos) % 17 = 0 THEN 'camera' ELSE 'world' END AS coordinate_frame",
        )
    )


def track(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr(
        "event_id div 250 AS sequence_id", "event_id % 250 AS frame_index", "value AS x",
        "(event_id * 13 % 100) * 1.0D AS y", "event_type <> 'error' AS visible", "event_type AS state",
    )


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(
        F.expr("vec_id div 10").alias("event_id"),
        (F.col("vec_id") % 10).alias("frame_index"),
        F.posexplode("embedding").alias("class_pos", "raw"),
    ).select("event_id", "frame_index", "class_pos", F.abs(F.col("raw").cast("double")).alias("score"))


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("y"))
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars")
    return labels.join(docs, "doc_id").select(
        "doc_id", "y", (F.col("doc_id") % 5).alias("fold"),
        F.least(F.lit(0.99), F.greatest(F.lit(0.01), F.col("n_chars") / F.lit(4000.0))).alias("p"),
        F.col("lang").alias("stratum"),
    )


def proba(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = lambda i: F.exp(F.col("embedding")[i].cast("double") * 4)
    z = table(spark, sf_dir, "embeddings").select(
        "vec_id", (F.col("label") % 3).alias("y"), (F.col("vec_id") % 21).alias("fold"),
        e(0).alias("a"), e(1).alias("b"), e(2).alias("c"),
    )
    t = F.col("a") + F.col("b") + F.col("c")
    return z.select("vec_id", "y", "fold", (F.col("a") / t).alias("p0"), (F.col("b") / t).alias("p1"),
                    (F.col("c") / t).alias("p2"))


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr(
        "event_id div 200 AS sequence_id", "(event_id % 200) div 10 AS frame_index", "event_id % 5 AS instance_id",
        "(event_id * 37) % 1000 AS start", "least(1 + event_id % 50, 1000 - (event_id * 37) % 1000) AS len",
    )


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr(
        "event_id div 200 AS sequence_id", "(event_id % 200) div 5 AS frame_index", "event_id % 5 AS instance_id",
        "value AS bx", "(event_id * 13 % 100) * 1.0D AS by", "(event_id % 40) - 2.0D AS bw",
        "30.0D + event_id % 9 AS bh", "event_type <> 'error' AS visible",
    )


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("sequence_id"), F.col("turn").alias("frame_index"), F.col("role").alias("state"),
        F.length("text").alias("n_chars"),
    )
