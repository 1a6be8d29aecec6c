"""Skew-safe ordered computations.

A window partitioned only by household, sequence or fold puts all rows of a hot key into one
task. Here every ordered key is cut into *segments* (an hour of events, a block of frames, a hash
prefix). Windows run inside ``(key, segment)``; what crosses a segment boundary (a count, a maximum,
the last value) is summarised per segment with map-side partial aggregation, scanned over the short
list of segments of the key, and joined back. Results equal the plain window.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evidencelens.session import materialise

HOUR_US = 3_600_000_000
FRAME_BLOCK = 4096
#: Rows of a task, about, where the caller knows how many there are.
TASK_ROWS = 1 << 19


def tasks_for(spark: SparkSession, rows: int) -> int | None:
    """Tasks that hold about TASK_ROWS each; None where the session's shuffle partitions are as many."""
    tasks = -(-rows // TASK_ROWS)
    return tasks if tasks > int(spark.conf.get("spark.sql.shuffle.partitions")) else None


def digits_for(rows: int) -> int:
    """Hex digits of a digest by which a key of ``rows`` rows falls into segments of a few thousand."""
    digits = 1
    while rows > 8192 * 16**digits:
        digits += 1
    return digits


def segment_of(order: Column | str, width: int) -> Column:
    order = F.col(order) if isinstance(order, str) else order
    return F.floor(order / F.lit(width)).cast("long")


def running(
    df: DataFrame,
    keys: Sequence[str],
    segment: Column,
    order: Sequence[Column | str],
    *,
    sums: dict[str, Column] | None = None,
    maxes: dict[str, Column] | None = None,
    lasts: dict[str, Column] | None = None,
    inclusive: bool = True,
    tasks: int | None = None,
) -> DataFrame:
    """Running sum, maximum and last non-NULL value per key in ``order``.

    ``segment`` must be non-decreasing along ``order``. ``order`` must be total where ties matter. ``tasks``: over how many tasks the
    segments are dealt, otherwise the session's shuffle partitions.
    """
    sums, maxes, lasts = sums or {}, maxes or {}, lasts or {}
    keys = list(keys)
    order = [F.col(o) if isinstance(o, str) else o for o in order]
    base = df.withColumn("__seg", segment)
    inner = (
        Window.partitionBy(*keys, "__seg")
        .orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    )
    position = F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)])
    totals, carried, local, combined = [], [], {}, {}
    outer = Window.partitionBy(*keys).orderBy("__seg").rowsBetween(Window.unboundedPreceding, -1)
    for name, expr in sums.items():
        totals.append(F.sum(expr).alias(f"__t_{name}"))
        carried.append(F.sum(f"__t_{name}").over(outer).alias(f"__c_{name}"))
        local[f"__l_{name}"] = F.sum(expr).over(inner)
        combined[name] = F.coalesce(F.col(f"__l_{name}"), F.lit(0)) + F.coalesce(F.col(f"__c_{name}"), F.lit(0))
    for name, expr in maxes.items():
        totals.append(F.max(expr).alias(f"__t_{name}"))
        carried.append(F.max(f"__t_{name}").over(outer).alias(f"__c_{name}"))
        local[f"__l_{name}"] = F.max(expr).over(inner)
        combined[name] = F.greatest(F.col(f"__l_{name}"), F.col(f"__c_{name}"))
    for name, expr in lasts.items():
        totals.append(F.max_by(expr, F.when(expr.isNotNull(), position)).alias(f"__t_{name}"))
        carried.append(F.last(f"__t_{name}", ignorenulls=True).over(outer).alias(f"__c_{name}"))
        local[f"__l_{name}"] = F.last(expr, ignorenulls=True).over(inner)
        combined[name] = F.coalesce(F.col(f"__l_{name}"), F.col(f"__c_{name}"))
    summary = base.groupBy(*keys, "__seg").agg(*totals).select(*keys, "__seg", *carried)
    dealt = base.repartition(tasks, *keys, "__seg") if tasks else base
    joined = dealt.withColumns(local).join(summary, [*keys, "__seg"], "left")
    out = joined.withColumns(combined)
    return out.select(*df.columns, *combined)


def ranked(df: DataFrame, keys: Sequence[str], segment: Column, order: Sequence[Column | str], name: str, tasks: int | None = None) -> DataFrame:
    """``row_number`` over ``keys`` in ``order`` without one task per key."""
    return running(df, keys, segment, order, sums={name: F.lit(1).cast("long")}, tasks=tasks)


def hash_ranked(df: DataFrame, keys: Sequence[str], digest: Column, ties: Sequence[Column | str], name: str, digits: int = 3, tasks: int | None = None) -> DataFrame:
    """Rank by a uniformly spread hex digest; segments are its prefixes (16^digits equal shares of a key)."""
    base = df.withColumn("__h", digest)
    return ranked(base, keys, F.substring("__h", 1, digits), ["__h", *ties], name, tasks).drop("__h")


def previous_row(
    df: DataFrame, keys: Sequence[str], segment: Column, order: Sequence[Column | str], value: Column, name: str
) -> DataFrame:
    """``lag`` of a never-NULL struct, segment-wise."""
    return running(df, keys, segment, order, lasts={name: value}, inclusive=False)


def with_neighbours(
    df: DataFrame, keys: Sequence[str], frame: str, cols: Sequence[str], block: int = FRAME_BLOCK
) -> DataFrame:
    """Adds structs ``prev``/``next`` holding the rows at exactly ``frame - 1``/``frame + 1`` (else NULL).

    Rows on a block edge are copied into the adjacent block (2 in ``block`` rows), so one shuffle on
    ``(keys, block)`` answers both directions.
    """
    f = F.col(frame)
    home = F.floor(f / block).cast("long")
    halo = F.filter(
        F.array(home, F.floor((f - 1) / block).cast("long"), F.floor((f + 1) / block).cast("long")),
        lambda b: b.isNotNull(),
    )
    base = df.withColumn("__home", home).withColumn("__blk", F.explode(F.array_distinct(halo)))
    w = Window.partitionBy(*keys, "__blk").orderBy(frame)
    payload = F.struct(frame, *cols)
    out = base.withColumns({"__p": F.lag(payload).over(w), "__n": F.lead(payload).over(w)})
    return (
        out.where("__home = __blk")
        .withColumns({
            "prev": F.when(F.col(f"__p.{frame}") == f - 1, F.col("__p")),
            "next": F.when(F.col(f"__n.{frame}") == f + 1, F.col("__n")),
        })
        .drop("__home", "__blk", "__p", "__n")
    )


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column], keep: Sequence[str]) -> DataFrame:
    """Best row per key by the smallest ordering struct; an aggregate, so hot keys combine map-side."""
    return (
        df.groupBy(*keys)
        .agg(F.min_by(F.struct(*keep), F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)])).alias("__best"))
        .select(*keys, "__best.*")
    )


def adjacent_summary(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    payload: Sequence[str],
    *,
    pair_sums: dict | None = None,
    pair_maxes: dict | None = None,
    row_aggs: dict[str, tuple[str, Column]] | None = None,
    block: int = FRAME_BLOCK,
) -> DataFrame:
    """One row per key over consecutive rows in ``order``.

    ``pair_sums``/``pair_maxes`` map a name to ``fn(previous, current)`` on payload structs (NULL is
    skipped); ``row_aggs`` map a name to ``('sum' | 'max' | 'min', column)``. Blocks are reduced first,
    then only each block's first and last row meet its neighbour, so a long key is never one task.
    """
    pair_sums, pair_maxes, row_aggs = pair_sums or {}, pair_maxes or {}, row_aggs or {}
    here = F.struct(order, *payload)
    base = df.withColumns({"__blk": segment_of(order, block), "__cur": here})
    w = Window.partitionBy(*keys, "__blk").orderBy(order)
    base = base.withColumn("__prev", F.lag("__cur").over(w))
    aggs = [
        F.min_by("__cur", order).alias("__first"),
        F.max_by("__cur", order).alias("__last"),
        F.count(F.lit(1)).alias("__rows"),
    ]
    value = lambda fn: fn(F.col("__prev"), F.col("__cur"))
    aggs += [F.sum(F.when(F.col("__prev").isNotNull(), value(fn))).alias(f"s_{n}") for n, fn in pair_sums.items()]
    aggs += [F.max(F.when(F.col("__prev").isNotNull(), value(fn))).alias(f"m_{n}") for n, fn in pair_maxes.items()]
    aggs += [getattr(F, kind)(c).alias(f"r_{n}") for n, (kind, c) in row_aggs.items()]
    blocks = base.groupBy(*keys, "__blk").agg(*aggs)
    wb = Window.partitionBy(*keys).orderBy("__blk")
    edge = blocks.withColumn("__before", F.lag("__last").over(wb))
    cross = lambda fn: F.when(F.col("__before").isNotNull(), fn(F.col("__before"), F.col("__first")))
    final = [
        F.min(f"__first.{order}").alias(f"first_{order}"),
        F.max(f"__last.{order}").alias(f"last_{order}"),
        F.sum("__rows").alias("n_rows"),
    ]
    for n, fn in pair_sums.items():
        inside, between = F.col(f"s_{n}"), cross(fn)
        final.append(F.sum(F.when(inside.isNull(), between).otherwise(inside + F.coalesce(between, F.lit(0)))).alias(n))
    for n, fn in pair_maxes.items():
        final.append(F.max(F.greatest(F.col(f"m_{n}"), cross(fn))).alias(n))
    final += [getattr(F, kind)(f"r_{n}").alias(n) for n, (kind, _) in row_aggs.items()]
    return edge.groupBy(*keys).agg(*final)


def gap_summary(present: DataFrame, keys: Sequence[str], frame: str, block: int = FRAME_BLOCK) -> DataFrame:
    """Per key over its present frames: absences strictly between two of them."""
    gap = lambda p, c: c[frame] - p[frame] - 1
    when = lambda test: (lambda p, c: F.when(test(gap(p, c)), F.lit(1)).otherwise(F.lit(0)).cast("long"))
    return adjacent_summary(
        present, keys, frame, [],
        pair_sums={
            "bounded_gaps": when(lambda g: g > 0),
            "bounded_frames": lambda p, c: gap(p, c),
            "short_gaps": when(lambda g: (g >= 1) & (g <= 2)),
            "long_gaps": when(lambda g: g >= 3),
        },
        pair_maxes={"max_gap": gap},
        block=block,
    )


def global_rank(df: DataFrame, order: Sequence[Column | str], name: str, start: int = 0) -> DataFrame:
    """``row_number`` over the whole table, from ``start``, without a window over one key.

    Rows are dealt and sorted by ranges of ``order`` and written with their place in their range; the counts of the ranges, one short row a task,
    give each range its offset. ``order`` must be total where the numbering of ties matters.
    """
    order = [F.col(o) if isinstance(o, str) else o for o in order]
    keys = {f"__o{i}": o for i, o in enumerate(order)}
    dealt = df.withColumns(keys).repartitionByRange(*keys).sortWithinPartitions(*keys)
    placed = dealt.withColumns({"__task": F.spark_partition_id(), "__place": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))})
    placed = materialise(placed.drop(*keys), "ranked")
    counts = placed.groupBy("__task").agg(F.count(F.lit(1)).alias("__n"))
    before = F.sum("__n").over(Window.orderBy("__task").rowsBetween(Window.unboundedPreceding, -1))  # one row a task
    offsets = counts.select("__task", F.coalesce(before, F.lit(0)).alias("__before"))
    return placed.join(F.broadcast(offsets), "__task").withColumn(name, F.col("__before") + F.col("__place") + F.lit(start)).drop("__task", "__place", "__before")


def meet_all(rows: DataFrame, few: DataFrame, lanes: int | None = None) -> DataFrame:
    """Every row of ``rows`` with every row of ``few``, for work that is rows x few by definition (folds, parameter tables).

    An equi-join on a lane: ``rows`` are dealt over the lanes by a hash, ``few`` is repeated once a lane; nothing is collected or broadcast
    by force, and ``few`` may have any length.
    """
    lanes = lanes or max(1, rows.sparkSession.sparkContext.defaultParallelism)
    lane = F.pmod(F.xxhash64(*rows.columns), F.lit(lanes)).cast("int")
    return rows.withColumn("__lane", lane).join(few.withColumn("__lane", F.explode(F.sequence(F.lit(0), F.lit(lanes - 1)))), "__lane").drop("__lane")
