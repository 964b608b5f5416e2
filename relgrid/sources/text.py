"""Policy text: lines of tuples, whole policies, and files of them."""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from relgrid.errors import PolicyTextError
from relgrid.functions.columns import COLUMNS, format_relationship, parse_relationship
from relgrid.plans import lineage, policy

#: The names of exported files.
SCHEMA_FILE, TUPLE_FOLDER, TUPLE_SUFFIX = "schema.zed", "relationships", ".zedtuples"
#: What may stand around a line: what \s is to a Java expression.
SPACE = " \t\n\x0b\f\r"


@dataclass(frozen=True)
class PolicyText:
    """A schema's text, and tuple text by relative path."""

    schema: str
    files: dict[str, str]


def parse_lines(lines: DataFrame) -> DataFrame:
    """(line, and the six columns, null if the line is no tuple) of lines that are not blank and no comments."""
    trimmed = lines.select(F.trim(F.col(lines.columns[0]), F.lit(SPACE)).alias("line"))
    kept = trimmed.where((F.col("line") != "") & ~F.col("line").startswith("#") & ~F.col("line").startswith("//"))
    return kept.withColumn("t", parse_relationship(F.col("line"))).select("line", *(F.col(f"t.{c}").alias(c) for c in COLUMNS))


def checked(parsed: DataFrame) -> DataFrame:
    """The tuples of parse_lines(), if every line is one."""
    bad = parsed.where("resource_type is null").agg(F.min("line")).first()[0]  # by all tasks at once, while a limit starts with one
    if bad is not None:
        raise PolicyTextError("line", f"not a tuple: {bad[:200]!r}")
    return parsed.select(COLUMNS)


def read_tuples(spark: SparkSession, path: str) -> DataFrame:
    """The tuples of text files."""
    return checked(parse_lines(spark.read.text(path)))


def from_text(spark: SparkSession, text: PolicyText) -> tuple[policy.Schema, DataFrame]:
    for relative in text.files:
        if not relative or os.path.isabs(relative) or ".." in relative.replace("\\", "/").split("/"):
            raise PolicyTextError("path", f"not a path inside the policy: {relative!r}")
    files = spark.createDataFrame([(contents,) for contents in text.files.values()], "contents string")
    return policy.compile_policy(text.schema), checked(parse_lines(files.select(F.explode(F.split("contents", "\r\n|\r|\n")).alias("line"))))


def from_files(spark: SparkSession, directory: str) -> tuple[policy.Schema, DataFrame]:
    """Schema and tuples of exported files."""
    schema = "\n".join(r.value for r in spark.read.text(f"{directory}/{SCHEMA_FILE}").collect())
    lines = spark.read.option("recursiveFileLookup", "true").text(f"{directory}/{TUPLE_FOLDER}")
    return policy.compile_policy(schema), checked(parse_lines(lines))


def export_lines(tuples: DataFrame) -> DataFrame:
    """(resource_type, line), the lines of a type in order within its partition: a range of lines each, so a large type spreads."""
    lines = tuples.select("resource_type", format_relationship().alias("line"))
    return lines.repartitionByRange("resource_type", "line").sortWithinPartitions("resource_type", "line")


def export_groups(tuples: DataFrame) -> DataFrame:
    """(resource_type, contents): the file of each type. For exports that fit in a row; export_lines() and export_digests() have no such bound."""
    lines = tuples.select("resource_type", format_relationship().alias("line"))
    return lines.groupBy("resource_type").agg(F.concat(F.array_join(F.array_sort(F.collect_list("line")), "\n"), F.lit("\n")).alias("contents"))


def numbered_lines(tuples: DataFrame) -> DataFrame:
    """(resource_type, line, ordinal): every line with its place in its type's file. The ranges are written once; what is gathered is a count for each of them."""
    lines = lineage.cut(export_lines(tuples).where("line is not null").withColumn("at", F.monotonically_increasing_id()))  # the number of the range, and below it that of the row in it
    counts = lines.groupBy("resource_type", F.shiftright("at", 33).alias("part")).agg(F.min("at").alias("low"), F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("resource_type").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    ranges = counts.select("resource_type", "part", (F.coalesce(before, F.lit(0)) - F.col("low")).alias("shift"))
    found = lines.withColumn("part", F.shiftright("at", 33)).join(F.broadcast(ranges), ["resource_type", "part"])
    return found.select("resource_type", "line", (F.col("at") + F.col("shift")).alias("ordinal"))


def export_digests(tuples: DataFrame) -> DataFrame:
    """(resource_type, contents_md5, n_lines) of the file of each type. Ranges of lines are sorted by tasks and packed in compressed chunks;
    a digest is sequential, so one task takes a type's chunks in order, and holds a batch of them at a time."""
    lines = export_lines(tuples).where("line is not null").select("resource_type", F.concat("line", F.lit("\n")).alias("line"))
    chunks = lines.mapInArrow(_packed, "resource_type string, part int, k long, n long, size long, chunk binary")
    placed = chunks.repartition("resource_type").sortWithinPartitions("resource_type", "part", "k")
    return placed.mapInArrow(_digested, "resource_type string, contents_md5 string, n_lines long")


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each type in each batch: the lines, which lie one after another in the column's buffer."""
    from pyspark import TaskContext

    part, k = TaskContext.get().partitionId(), 0
    names = ["resource_type", "part", "k", "n", "size", "chunk"]
    for batch in batches:
        if not batch.num_rows:
            continue
        kinds = batch.column(0)
        data, at = _line_bytes(batch.column(1))
        ends = pc.run_end_encode(kinds).run_ends.to_pylist()
        for low, high in zip([0, *ends], ends, strict=False):
            start, size = at[low], at[high] - at[low]
            chunk = pa.compress(data.slice(start, size), codec="zstd", asbytes=True)
            columns = [[kinds[low].as_py()], pa.array([part], pa.int32()), [k], [high - low], [size], pa.array([chunk], pa.binary())]
            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names=names)
            k += 1


def _line_bytes(lines: pa.Array) -> tuple[pa.Buffer, list[int]]:
    """The buffer of a string column, and where in it its values begin, and the last one ends."""
    _, offsets, data = lines.buffers()
    kind = pa.int64() if pa.types.is_large_string(lines.type) else pa.int32()
    return data, pa.Array.from_buffers(kind, len(lines) + 1, [None, offsets], offset=lines.offset).to_pylist()


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = digest = None
    n = 0
    row = lambda: pa.RecordBatch.from_arrays([pa.array([kind]), pa.array([digest.hexdigest()]), pa.array([n])], names=["resource_type", "contents_md5", "n_lines"])
    for batch in batches:
        for at in range(batch.num_rows):
            if (new := batch.column(0)[at].as_py()) != kind or digest is None:
                if digest is not None:
                    yield row()
                kind, digest, n = new, hashlib.md5(), 0
            digest.update(pa.decompress(batch.column(5)[at].as_buffer(), decompressed_size=batch.column(4)[at].as_py(), codec="zstd"))
            n += batch.column(3)[at].as_py()
    if digest is not None:
        yield row()


def to_text(schema: policy.Schema, tuples: DataFrame) -> PolicyText:
    groups = export_groups(tuples).orderBy("resource_type").collect()
    return PolicyText(policy.text(schema), {f"{TUPLE_FOLDER}/{r.resource_type}{TUPLE_SUFFIX}": r.contents for r in groups})


def write_files(schema: policy.Schema, tuples: DataFrame, directory: str) -> None:
    """Writes a policy below a directory: the schema's text, and for each resource type a folder with its lines in ranges of their order."""
    if not directory:
        raise PolicyTextError("path", "an export needs a directory")
    spark = tuples.sparkSession
    make = spark._jvm.org.apache.hadoop.fs.Path
    folder = make(f"{directory}/{TUPLE_FOLDER}")
    system = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    system.delete(folder, True)
    write_lines(tuples, f"{directory}/{TUPLE_FOLDER}")
    for kind in schema.namespaces:
        part = make(f"{directory}/{TUPLE_FOLDER}/resource_type={kind}")
        if system.exists(part):
            system.rename(part, make(f"{directory}/{TUPLE_FOLDER}/{kind}{TUPLE_SUFFIX}"))
    out = system.create(make(f"{directory}/{SCHEMA_FILE}"), True)
    out.write(bytearray(policy.text(schema).encode()))
    out.close()


def write_lines(tuples: DataFrame, path: str) -> None:
    """Writes tuple lines to text files by resource type, without gathering a type in one task."""
    export_lines(tuples).withColumnRenamed("line", "value").write.partitionBy("resource_type").text(path)
