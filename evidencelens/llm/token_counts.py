"""Token counts: an exact length histogram whose suffix sums answer every context limit.

Documents are encoded once and counted by length (a partial sum in each task, so the shuffle carries lengths, not documents).
Prefix and suffix sums run in two levels: over the totals of length ranges, a list as short as the longest document
over ``RANGE``, and inside each range.

Defined results: null text has length 0; repeated rows count each; an empty table gives an empty histogram; further columns are not read.
"""

from __future__ import annotations

import base64
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialise
from .text import prepared

RANGE = 1024


def encoder(path: str, pattern: str):
    def build():
        import tiktoken

        with open(path, "rb") as file:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
        return tiktoken.Encoding("lengths", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    return prepared(("lengths", path, pattern), build)


def token_length(path: str, pattern: str):
    """A column function: text to its number of tokens; the strings of special tokens are ordinary text."""

    @F.arrow_udf("long")
    def length(text: pa.Array) -> pa.Array:
        encode = encoder(path, pattern).encode_ordinary
        return pa.array([len(encode(t.as_py() or "")) for t in text], pa.int64())

    return length


def length_histogram(lengths: DataFrame) -> DataFrame:
    """From column ``length``: one row per length with all sums below it and from it on.

    ``truncated_tokens`` is the corpus size with every document cut at ``length``; for a limit between two lengths it is
    ``tokens_below + limit * docs_from`` of the next larger length (``at_limits``).
    """
    counts = lengths.groupBy("length").agg(F.count("*").alias("n_docs")).withColumn("range", F.floor(F.col("length") / RANGE))
    # Written once: both levels read the counts, and documents are encoded a single time.
    counts = materialise(counts.withColumn("tokens", F.col("length") * F.col("n_docs")), "lengths")
    whole = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    ranges = counts.groupBy("range").agg(F.sum("n_docs").alias("d"), F.sum("tokens").alias("t"))
    ranges = ranges.select(
        "range", *(F.coalesce(F.sum(c).over(whole), F.lit(0)).alias(f"{c}_before") for c in "dt"), *(F.sum(c).over(every).alias(f"{c}_all") for c in "dt")
    )
    inside = Window.partitionBy("range").orderBy("length").rowsBetween(Window.unboundedPreceding, -1)
    out = counts.join(ranges, "range")
    out = out.withColumn("docs_below", F.col("d_before") + F.coalesce(F.sum("n_docs").over(inside), F.lit(0)))
    out = out.withColumn("tokens_below", F.col("t_before") + F.coalesce(F.sum("tokens").over(inside), F.lit(0)))
    docs_from = F.col("d_all") - F.col("docs_below")
    return out.select(
        "length", "n_docs", "docs_below", "tokens_below", docs_from.alias("docs_from"), (F.col("t_all") - F.col("tokens_below")).alias("tokens_from"),
        (F.col("tokens_below") + F.col("length") * docs_from).alias("truncated_tokens"), ((F.col("docs_below") + F.col("n_docs")) / F.col("d_all")).alias("quantile"),
    )


def at_limits(histogram: DataFrame, limits: Sequence[int]) -> DataFrame:
    """limit, docs_over (longer than the limit), truncated_tokens and total_tokens, for any stated limits."""
    total = F.sum(F.col("length") * F.col("n_docs"))
    facts = F.struct("docs_below", "tokens_below", "docs_from")
    rows = histogram.agg(total.alias("total"), F.array(*(F.struct(F.lit(c).cast("long").alias("limit"), F.min_by(F.when(F.col("length") > c, facts), F.when(F.col("length") > c, F.col("length"))).alias("f")) for c in limits)).alias("limits"))
    rows = rows.select("total", F.explode("limits").alias("x")).select("x.limit", "x.f", "total")
    cut = F.col("f.tokens_below") + F.col("limit") * F.col("f.docs_from")
    return rows.select("limit", F.coalesce("f.docs_from", F.lit(0)).alias("docs_over"), F.coalesce(cut, "total", F.lit(0)).alias("truncated_tokens"), F.coalesce("total", F.lit(0)).alias("total_tokens"))


def at_quantiles(histogram: DataFrame, shares: Sequence[float]) -> DataFrame:
    """share and the smallest length that at least this share of the documents does not exceed."""
    rows = histogram.agg(F.array(*(F.struct(F.lit(float(q)).alias("share"), F.min(F.when(F.col("quantile") >= q, F.col("length"))).alias("length")) for q in shares)).alias("q"))
    return rows.select(F.explode("q").alias("x")).select("x.*")
