"""Tables, digests and reports on storage."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Sequence

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_table_csv(spark: SparkSession, path: str, required: Sequence[str], schema: T.StructType | str | None = None) -> DataFrame:
    """Header CSV; an empty table or a missing required column is an error.

    Without a schema every column stays text, so the header is the only thing inferred.
    """
    reader = spark.read.option("header", True)
    df = (reader.schema(schema).option("enforceSchema", False) if schema else reader).csv(path)
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"missing required columns: {missing}")
    if df.isEmpty():
        raise ValueError(f"no rows in {path}")
    return df


# Fixed values of the clip file-name convention: pattern and code tables.
CLIP_PATTERN = r"^([BFI])_([^_]+)_(MC|EU)_(FI|FN|MI|MN)_([^_]+)_([0-9])([0-9]{2})$"
CLIP_PARTS = ("context_code", "subject_id", "breed_code", "sex_code", "owner_id", "session", "vocalisation_index")
CONTEXT_NAMES = {"B": "brushing", "F": "waiting_for_food", "I": "isolation_unfamiliar_environment"}
SEX_NAMES = {"FI": "female_intact", "FN": "female_neutered", "MI": "male_intact", "MN": "male_neutered"}
BREED_NAMES = {"MC": "maine_coon", "EU": "european_shorthair"}


def manifest_from_paths(paths: DataFrame, column: str = "path") -> DataFrame:
    """Thirteen manifest columns per file path, with ``errors`` for names outside the convention and repeats."""
    name = F.element_at(F.split(column, "/"), -1)
    stem = F.regexp_replace(name, r"\.[^.]*$", "")
    ok = stem.rlike(CLIP_PATTERN)
    part = {p: F.when(ok, F.regexp_extract(stem, CLIP_PATTERN, i + 1)) for i, p in enumerate(CLIP_PARTS)}
    look = lambda table, key: F.create_map(*[F.lit(x) for kv in table.items() for x in kv])[key]
    base = paths.select(F.col(column).alias("path"), name.alias("filename"), *[c.alias(p) for p, c in part.items()])
    base = base.withColumns({
        "context": look(CONTEXT_NAMES, F.col("context_code")), "sex": look(SEX_NAMES, F.col("sex_code")), "breed": look(BREED_NAMES, F.col("breed_code")),
        "session": F.col("session").cast("int"), "vocalisation_index": F.col("vocalisation_index").cast("int"),
        "sequence_group": F.concat_ws(":", F.col("subject_id"), F.col("session"))})
    # Repeated paths: an aggregate by path (combined map-side), joined back only for paths seen twice.
    repeated = paths.groupBy(F.col(column).alias("path")).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("path", F.lit(True).alias("__dup"))
    j = base.join(repeated, "path", "left")
    suffix = ~F.lower("filename").rlike(r"\.wav$")
    group = F.when(F.col("subject_id").isNotNull(), F.col("sequence_group"))
    return j.withColumns({"sequence_group": group, "errors": F.array_compact(F.array(
        F.when(suffix, F.lit("not_a_wav_file")), F.when(~suffix & F.col("subject_id").isNull(), F.lit("name_outside_convention")), F.when(F.col("__dup"), F.lit("duplicate_path"))))}).drop("__dup")


def file_digests(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """Path, byte length and SHA-256 of every file, read in pieces of 8 MB by the task that has it: any size, constant memory."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    files = reader.load(path).select("path", F.col("length").alias("byte_length"))  # the content column is not read

    def digests(batches):
        for batch in batches:
            out = []
            for name in batch.column(0).to_pylist():
                local = re.sub("^file:/+", "/", name)
                fs, at = pafs.FileSystem.from_uri(local) if "://" in local else (pafs.LocalFileSystem(), local)
                state = hashlib.sha256()
                with fs.open_input_stream(at, compression=None) as stream:
                    while piece := stream.read(8 << 20):
                        state.update(piece)
                out.append(state.hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.string())], ["path", "byte_length", "sha256"])

    return files.mapInArrow(digests, "path string, byte_length long, sha256 string")


def verify_digests(declared: DataFrame, actual: DataFrame, key: str = "path") -> DataFrame:
    """Declared rows with ``errors``: file missing, digest or length different."""
    a = actual.select(key, F.col("sha256").alias("__s"), F.col("byte_length").alias("__n"))
    j = declared.join(a, key, "left")
    gone = F.col("__s").isNull()
    return j.withColumn("errors", F.array_compact(F.array(
        F.when(gone, F.lit("file_missing")), F.when(~gone & (F.lower("sha256") != F.col("__s")), F.lit("digest_differs")),
        F.when(~gone & (F.col("byte_length") != F.col("__n")), F.lit("length_differs"))))).drop("__s", "__n")


def write_report(df: DataFrame, path: str, fmt: str = "json", partition_by: Sequence[str] = ()) -> None:
    """Report rows with columns in sorted order; every task writes its own file."""
    out = df.select(*sorted(df.columns)).write.mode("errorifexists")
    if partition_by:
        out = out.partitionBy(*partition_by)
    if fmt == "csv":
        out.option("header", True).csv(path)
    elif fmt == "json":
        out.option("ignoreNullFields", False).json(path)
    elif fmt == "parquet":
        out.parquet(path)
    else:
        raise ValueError(f"unknown report format: {fmt}")
