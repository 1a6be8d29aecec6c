"""Secret scans: corpus-wide ownership frequency of candidate values.

One pass over the texts finds candidates: the three fixed kinds (``assign``, ``access``, ``hex``) and generic random-looking tokens. Each
candidate value is hashed; hashes are aggregated over the whole corpus by distinct repositories and distinct owners.
A value that many owners hold is a widely copied example; a value that stays with few owners is live. The fixed kinds are
always reported and judged by their owners alone; a generic token is a candidate only if it looks random, and becomes a span
(``live``) only by the corpus decision.

Only hashes and positions are shuffled, never texts. Counts of distinct owners are partial sums over distinct
(value, owner) pairs, so a value copied into a third of all documents is reduced before it is shuffled.

Defined results: null or empty text has no span; null repository or owner counts as one unnamed owner; a repeated
row gets its own row of the result and counts its owner once; an empty table gives an empty table; further columns
of the input are not read.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialise

# Kinds in the order in which spans at one start are listed, and their patterns.
KINDS = ("assign", "access", "hex", "live")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
WORDS = ("passw", "secret", "token", "api")

#: Generic candidates: mixed runs of this length and of at least this entropy in bits a character, corrected for their length.
GENERIC = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
MIN_ENTROPY = 3.5
#: A value is a copied example from this many distinct owners on.
EXAMPLE_OWNERS = 4

CANDIDATE = "struct<kind:int,start:int,end:int,hash:long>"


def entropy(value: str) -> float:
    n = len(value)
    return -sum(c / n * math.log2(c / n) for c in Counter(value).values())


def corrected_entropy(value: str) -> float:
    """Entropy of the source of ``value``: that of a short sample is too low by about (distinct - 1) / (2 n ln 2) bits (Miller-Madow)."""
    return entropy(value) + (len(set(value)) - 1) / (2 * len(value) * math.log(2))


def strong(value: str) -> bool:
    """Random-looking: enough entropy, letters and digits mixed, no word run of 12 letters."""
    return corrected_entropy(value) >= MIN_ENTROPY and any(c.isdigit() for c in value) and any(c.isalpha() for c in value) and not re.search(r"[a-z]{12}|[A-Z]{12}", value)


def value_hash(value: str) -> int:
    return int.from_bytes(hashlib.blake2b(value.encode(), digest_size=8).digest(), "big", signed=True)


def candidates(text: str) -> list[tuple[int, int, int, int, bool]]:
    """(kind, start, end, hash of the value, may be live) by start and kind; positions in code points.

    The fixed kinds may always be live; generic tokens that do not look random are no candidates.
    """
    found = []
    low = text.lower()
    if any(w in low for w in WORDS):
        for m in ASSIGN.finditer(text):
            if len(value := m[2]) >= 6:
                found.append((0, m.start(), m.end(), value_hash(value), True))
    if "AKIA" in text:
        found += [(1, m.start(), m.end(), value_hash(m[0]), True) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(2, m.start(), m.end(), value_hash(m[0]), True) for m in HEX.finditer(text)]
    base = [(s, e) for _, s, e, _, _ in found]
    for m in GENERIC.finditer(text):
        if strong(m[0]) and not any(s < m.end() and m.start() < e for s, e in base):
            found.append((3, m.start(), m.end(), value_hash(m[0]), True))
    return sorted(found, key=lambda c: (c[1], c[0]))


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("hash", pa.int64())]))
    names = ("kind", "start", "end", "hash")
    for batch in batches:
        found = [[dict(zip(names, c)) for c in candidates(t.as_py() or "")] for t in batch.column(3)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(found, kind)], ["doc_id", "repo", "owner", "found"])


def scan_secrets(docs: DataFrame, doc_id: Column, text: Column, repository: Column, owner: Column, example_owners: int = EXAMPLE_OWNERS) -> DataFrame:
    """One row per input row: doc_id, spans array<struct<kind,start,end,hash,owners,repositories,verdict>>.

    ``verdict`` is ``example`` (``example_owners`` distinct owners or more) or ``live`` (fewer).
    """
    rows = docs.select(doc_id.alias("doc_id"), repository.cast("string").alias("repo"), owner.cast("string").alias("owner"), text.alias("text"))
    scanned = rows.mapInArrow(_scan, f"doc_id long, repo string, owner string, found array<{CANDIDATE}>")
    scanned = materialise(scanned.withColumn("row", F.monotonically_increasing_id()), "secrets")
    flat = scanned.filter(F.size("found") > 0).select("row", "repo", "owner", F.explode("found").alias("c")).select("row", "repo", "owner", "c.*")

    def distinct_count(column: str) -> DataFrame:
        pairs = flat.select("hash", F.coalesce(column, F.lit("")).alias(column)).distinct()
        return pairs.groupBy("hash").agg(F.count("*").alias(f"{column}s"))

    spread = distinct_count("owner").join(distinct_count("repo"), "hash")
    verdict = F.when(F.col("owners") >= example_owners, "example").otherwise("live")
    kinds = F.array(*map(F.lit, KINDS))
    judged = flat.join(spread, "hash").withColumn("verdict", verdict).filter("kind < 3 OR verdict = 'live'")
    span = F.struct("start", F.col("kind").alias("order"), "end", F.get(kinds, F.col("kind")).alias("kind"), "hash", "owners", F.col("repos").alias("repositories"), "verdict")
    spans = judged.groupBy("row").agg(F.sort_array(F.collect_list(span)).alias("spans"))  # bounded by one text
    empty = F.array().cast(spans.schema["spans"].dataType)
    return scanned.select("row", "doc_id").join(spans, "row", "left").select("doc_id", F.coalesce("spans", empty).alias("spans"))


def listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest_rows(scanned: DataFrame) -> DataFrame:
    """The counts, digest and span list of each document."""
    base = F.filter("spans", lambda s: s["order"] < 3)

    def count(field: str, value: int | str) -> Column:
        return F.size(F.filter("spans", lambda s: s[field] == value)).cast("long")

    return scanned.select(
        "doc_id",
        *(count("order", k).alias(f"n_{KINDS[k]}") for k in range(3)),
        F.sha2(listed(base).cast("binary"), 256).alias("base_sha256"),
        listed(F.col("spans")).alias("spans"),
        count("verdict", "live").alias("n_live"),
        count("verdict", "example").alias("n_example"),
    )


def redacted(text: Column, spans: Column, mark: str = "[secret]") -> Column:
    """``text`` with every live span replaced by ``mark``; spans that overlap an earlier one are merged."""
    live = F.filter(spans, lambda s: s["verdict"] == "live")
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))

    def step(acc: Column, s: Column) -> Column:
        gap = F.when(s["start"] >= acc["at"], F.concat(acc["out"], F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit(mark))).otherwise(acc["out"])
        return F.struct(gap.alias("out"), F.greatest(acc["at"], s["end"]).alias("at"))

    end = lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text) - acc["at"]))
    return F.when(F.size(live) > 0, F.aggregate(live, start, step, end)).otherwise(text)


def redact(docs: DataFrame, text: str, repository: Column, owner: Column) -> DataFrame:
    """``docs`` with the live spans of column ``text`` replaced, all columns and rows kept.

    The spans of a text depend on the text and the corpus alone, so they are joined back by the text's hash.
    """
    key = F.xxhash64(F.col(text), F.length(text))
    found = scan_secrets(docs, key, F.col(text), repository, owner).filter("exists(spans, s -> s.verdict = 'live')")
    found = found.groupBy(F.col("doc_id").alias("__key")).agg(F.min("spans").alias("__spans"))  # equal texts have equal spans
    joined = docs.withColumn("__text", key).join(found, F.col("__text") == F.col("__key"), "left")
    clean = F.when(F.col("__spans").isNotNull(), redacted(F.col(text), F.col("__spans"))).otherwise(F.col(text))
    return joined.withColumn(text, clean).drop("__text", "__key", "__spans")
