"""Snapshot artifacts: a directory with the tuples as Parquet and a manifest of what they are."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relgrid.errors import ArtifactError
from relgrid.functions.columns import COLUMNS, SCHEMA, invalid
from relgrid.operators.store import repeated, unknown_reference
from relgrid.plans import policy

FORMAT = 1
PROFILES = ("full", "check_only", "check_and_object_audit")


@dataclass(frozen=True)
class Loaded:
    schema: policy.Schema
    tuples: DataFrame
    revision: int
    profile: str
    #: The tuples laid out by subject, which profile full has.
    by_subject: DataFrame | None = None


def _files(spark: SparkSession, path: str) -> object:
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path


def checksum(tuples: DataFrame) -> str:
    """A number for the set of rows, whatever their order or files."""
    row = tuples.agg(F.count("*").alias("n"), F.sum(F.xxhash64(*COLUMNS).cast("decimal(38,0)")).alias("s"), F.bit_xor(F.xxhash64(F.lit(7), *COLUMNS)).alias("x")).first()
    return f"{row.n}:{row.s or 0}:{row.x or 0}"


def save(path: str, schema: policy.Schema, tuples: DataFrame, revision: int, profile: str = "full", compression: str = "zstd") -> None:
    """Writes an artifact: tuples sorted within ranges of resources, then the manifest, which makes it whole."""
    if profile not in PROFILES:
        raise ArtifactError("options", f"no such profile: {profile}")
    spark = tuples.sparkSession
    laid_out = tuples.select(COLUMNS).repartitionByRange("resource_type", "relation", "resource_id").sortWithinPartitions("resource_type", "relation", "resource_id", "subject_type", "subject_id")
    laid_out.write.mode("overwrite").option("compression", compression).parquet(f"{path}/tuples")
    if profile == "full":
        # Ranges by all columns, so that the tuples of one subject spread as well.
        by_subject = tuples.select(COLUMNS).repartitionByRange("subject_type", "subject_id", "subject_relation", "resource_type", "relation", "resource_id").sortWithinPartitions("subject_type", "subject_id")
        by_subject.write.mode("overwrite").option("compression", compression).parquet(f"{path}/by_subject")
    stored = spark.read.schema(SCHEMA).parquet(f"{path}/tuples")
    manifest = {"format": FORMAT, "schema": policy.text(schema), "schema_hash": policy.schema_hash(schema), "revision": revision, "profile": profile, "checksum": checksum(stored)}
    system, make = _files(spark, path)
    part, final = make(f"{path}/manifest.json.part"), make(f"{path}/manifest.json")
    out = system.create(part, True)
    out.write(bytearray(json.dumps(manifest, sort_keys=True).encode()))
    out.close()
    system.delete(final, False)
    if not system.rename(part, final):
        raise ArtifactError("format", f"the manifest of {path} could not be put in place")


def manifest(spark: SparkSession, path: str) -> dict:
    system, make = _files(spark, path)
    if not system.exists(make(f"{path}/manifest.json")):
        raise ArtifactError("missing", f"no artifact at {path}")
    text = "\n".join(r.value for r in spark.read.text(f"{path}/manifest.json").collect())
    try:
        found = json.loads(text)
    except ValueError as e:
        raise ArtifactError("format", f"the manifest of {path} can't be read") from e
    if found.get("format") != FORMAT:
        raise ArtifactError("format", f"format {found.get('format')}; this reads {FORMAT}")
    return found


def load(spark: SparkSession, path: str, validation: str = "full", integrity: str = "checksum", latency: bool = False) -> Loaded:
    """Reads an artifact. validation: full or trusted; integrity: checksum, or external, which only trusted data may have."""
    if validation not in ("full", "trusted") or integrity not in ("checksum", "external"):
        raise ArtifactError("options", f"no such mode: {validation}, {integrity}")
    if integrity == "external" and validation != "trusted":
        raise ArtifactError("options", "integrity from outside is for trusted artifacts")
    if latency and validation == "trusted":
        raise ArtifactError("options", "a trusted load doesn't build what low latency needs")
    found = manifest(spark, path)
    schema = policy.compile_policy(found["schema"])
    if policy.schema_hash(schema) != found["schema_hash"]:
        raise ArtifactError("schema_hash", "the schema is not the one that was saved")
    tuples = spark.read.schema(SCHEMA).parquet(f"{path}/tuples")
    if integrity == "checksum" and checksum(tuples) != found["checksum"]:
        raise ArtifactError("checksum", "the tuples are not those that were saved")
    if validation == "full":
        if repeated(tuples, int(found["checksum"].split(":")[0])) is not None:  # the checksum, which was compared, begins with the number of rows
            raise ArtifactError("duplicate", "a tuple is stored twice")
        if tuples.agg(F.coalesce(F.bool_or(invalid() | unknown_reference(schema)), F.lit(False))).first()[0]:
            raise ArtifactError("invalid_rows", "a tuple breaks the rules or is not in the schema")
    by_subject = spark.read.schema(SCHEMA).parquet(f"{path}/by_subject") if found["profile"] == "full" else None
    if by_subject is not None and integrity == "checksum" and checksum(by_subject) != found["checksum"]:
        raise ArtifactError("checksum", "the tuples by subject are not those that were saved")
    return Loaded(schema, tuples, found["revision"], found["profile"], by_subject)
