"""Quality rules: hashed n-gram log-likelihood ratio between a trusted target and the raw corpus, in DataFrame functions only.

Words and pairs of words are hashed into ``BUCKETS`` buckets. Two multinomials over the buckets are counted, one over all
documents and one over the trusted ones; the weight of a bucket is the logarithm of its smoothed probability in the
target over that in the corpus. A document's score is the mean weight of its n-grams, so it does not depend on its
length, and every document is held to the same fixed threshold. Base rules on words, symbols, lines and repeated windows come first.

The counts are partial sums over a bounded number of buckets; the ``BUCKETS`` weights reach the second pass
as one literal array.

Defined results: null or wordless text has zero counts, fails the base rules and has score 0; without trusted documents all weights
are 0; documents with a null id are never trusted; repeated rows count each; an empty table gives an empty table; further columns are
not read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKETS = 1 << 14
SMOOTHING = 1.0
#: Mean log-likelihood ratio (nats an n-gram) below which a document is dropped.
THRESHOLD = -0.12
WINDOW = 5
BLANKS = r"[\x20\x09-\x0D]+"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once, also where ``body`` uses it for every element of an array."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), BLANKS), "")


def hashes_of(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def positions(count: Column) -> Column:
    """0 .. count-1, empty for a count below 1."""
    return F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>"))


def grams_of(hashes: Column) -> Column:
    """Buckets of all words and of all pairs of neighbouring words."""
    single = F.transform(hashes, lambda h: F.pmod(h, F.lit(BUCKETS)).cast("int"))
    double = F.transform(positions(F.size(hashes) - 1), lambda i: F.pmod(F.xxhash64(F.get(hashes, i), F.get(hashes, i + 1)), F.lit(BUCKETS)).cast("int"))
    return F.concat(single, double)


def repeated_words(hashes: Column) -> Column:
    """Words that lie in a window of five words found twice or more in the text."""
    windows = F.transform(positions(F.size(hashes) - (WINDOW - 1)), lambda i: F.xxhash64(*(F.get(hashes, i + k) for k in range(WINDOW))))

    def covered(w: Column) -> Column:
        ordered = F.sort_array(F.transform(w, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
        same = lambda s, j: F.coalesce(F.get(s, j)["x"] == F.get(s, j + 1)["x"], F.lit(False))
        twice = let(ordered, lambda s: F.filter(s, lambda p, j: same(s, j) | ((j > 0) & same(s, j - 1))))
        starts = F.sort_array(F.transform(twice, lambda p: p["i"]))
        add = lambda acc, p: F.struct((p + WINDOW).alias("end"), (acc["total"] + F.least(F.lit(WINDOW), p + WINDOW - acc["end"])).alias("total"))
        return F.aggregate(starts, F.struct(F.lit(0).alias("end"), F.lit(0).alias("total")), add, lambda acc: acc["total"])

    return let(windows, lambda w: F.when(F.size(F.array_distinct(w)) == F.size(w), F.lit(0)).otherwise(covered(w)))


def weights(docs: DataFrame, doc_id: Column, text: Column, trusted: DataFrame) -> DataFrame:
    """One row with ``w``, the weight of every bucket. ``trusted`` has the ids of the target in its column ``doc_id``."""
    target = trusted.filter("doc_id IS NOT NULL").select(F.col("doc_id").alias("id")).distinct().withColumn("trusted", F.lit(1))
    # Labels grow with the documents, so they are never broadcast; the texts pass one shuffle, without a sort.
    rows = docs.select(doc_id.alias("doc_id"), text.alias("text")).join(target.hint("shuffle_hash"), F.col("doc_id") == F.col("id"), "left")
    grams = let(hashes_of(words_of(F.col("text"))), grams_of)
    counted = rows.select(F.coalesce("trusted", F.lit(0)).alias("t"), F.explode(grams).alias("bucket")).groupBy("bucket").agg(F.count("*").alias("raw"), F.sum("t").alias("target"))
    buckets = docs.sparkSession.range(BUCKETS).select(F.col("id").cast("int").alias("bucket"))
    full = buckets.join(counted, "bucket", "left").select("bucket", F.coalesce("raw", F.lit(0)).alias("raw"), F.coalesce("target", F.lit(0)).alias("target"))
    sums = full.agg(F.sum("raw").alias("r"), F.sum("target").alias("t"), F.sort_array(F.collect_list(F.struct("bucket", "raw", "target"))).alias("all"))
    share = lambda n, total: F.log((n + SMOOTHING) / (total + SMOOTHING * BUCKETS))
    return sums.select(F.transform("all", lambda b: F.when(F.col("t") > 0, share(b["target"], F.col("t")) - share(b["raw"], F.col("r"))).otherwise(0.0)).alias("w"))


def constant(values: list[float]) -> Column:
    """The ``BUCKETS`` numbers as one folded literal of the plan."""
    return F.split(F.lit(",".join(map(repr, values))), ",").cast("array<double>")


def judged(docs: DataFrame, doc_id: Column, text: Column, trusted: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The base counts, score and verdicts of every document."""
    whole = F.coalesce(text, F.lit(""))
    weight = constant(weights(docs, doc_id, text, trusted).first()["w"])
    lines = F.filter(F.split(whole, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    dup_lines = let(lines, lambda a: F.size(a) - F.size(F.array_distinct(a)))
    mean = lambda g: F.when(F.size(g) > 0, F.aggregate(g, F.lit(0.0), lambda acc, b: acc + F.get(weight, b)) / F.size(g)).otherwise(0.0)

    def facts(words: Column) -> Column:
        measured = let(hashes_of(words), lambda h: F.struct(repeated_words(h).alias("repeated"), let(grams_of(h), mean).alias("score")))
        return F.struct(F.size(words).cast("long").alias("n_words"), F.char_length(F.array_join(words, "")).cast("long").alias("word_chars"), measured.alias("m"))

    rows = docs.select(
        doc_id.alias("doc_id"), let(words_of(text), facts).alias("f"), F.char_length(F.regexp_replace(whole, r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        dup_lines.cast("long").alias("n_dup_lines"),
    )
    rows = rows.select("doc_id", "f.n_words", "f.word_chars", "n_symbols", "n_dup_lines", F.col("f.m.repeated").cast("long").alias("n_repeat_words"), F.col("f.m.score").alias("score"))
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return rows.withColumn("base_failed", failed).withColumn("kept", ~failed & (F.col("score") >= threshold))
