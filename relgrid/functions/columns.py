"""The tuple functions over columns: parsing, formatting, validation and three-valued membership. All stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relgrid.domain import ID, ID_BYTES, NAME, NAME_BYTES, TENANT, TENANT_BYTES, TUPLE_BYTES

COLUMNS = ["resource_type", "resource_id", "relation", "subject_type", "subject_id", "subject_relation"]
SCHEMA = "resource_type string, resource_id string, relation string, subject_type string, subject_id string, subject_relation string"
KEY_TEXT = "concat(resource_type, ':', resource_id, '#', relation, '@', subject_type, ':', subject_id, coalesce(concat('#', subject_relation), ''))"


def is_name(c: Column) -> Column:
    """Whether a type or relation name is valid; null is not."""
    return F.coalesce(c.rlike(rf"\A{NAME}\z") & (F.octet_length(c) <= NAME_BYTES), F.lit(False))


def is_id(c: Column) -> Column:
    return F.coalesce(c.rlike(rf"\A{ID}+\z") & (F.octet_length(c) <= ID_BYTES), F.lit(False))


def is_tenant(c: Column) -> Column:
    return F.coalesce(c.rlike(rf"\A{TENANT}+\z") & (F.octet_length(c) <= TENANT_BYTES), F.lit(False))


#: A name and an id within their lengths, which are also those in bytes: both are ASCII. Each ends where its characters do, so nothing is tried twice.
_NAME, _ID = rf"[A-Za-z][A-Za-z0-9_]{{0,{NAME_BYTES - 1}}}+", rf"{ID}{{1,{ID_BYTES}}}+"
_SUBJECT = rf"{_NAME}:{_ID}(?:#{_NAME})?"


def _subject_parts(c: Column) -> tuple[Column, Column, Column]:
    """Type, id and relation (or null) of a text known to be a subject."""
    rest = F.substring_index(c, ":", -1)
    return F.substring_index(c, ":", 1), F.substring_index(rest, "#", 1), F.when(F.contains(rest, F.lit("#")), F.substring_index(rest, "#", -1))


def parse_object(c: Column) -> Column:
    """struct(type, id), null where the text isn't type:id."""
    return F.when(c.rlike(rf"\A{_NAME}:{_ID}\z"), F.struct(F.substring_index(c, ":", 1).alias("type"), F.substring_index(c, ":", -1).alias("id")))


def parse_subject(c: Column) -> Column:
    """struct(type, id, relation), null where the text isn't type:id or type:id#relation."""
    kind, ident, relation = _subject_parts(c)
    return F.when(c.rlike(rf"\A{_SUBJECT}\z"), F.struct(kind.alias("type"), ident.alias("id"), relation.alias("relation")))


def parse_relationship(c: Column) -> Column:
    """struct of the six columns, null where the text is no tuple. One expression decides, and the parts are cut at its separators, which no part can hold."""
    left, right = F.substring_index(c, "@", 1), F.substring_index(c, "@", -1)
    parts = F.substring_index(left, ":", 1), F.substring_index(F.substring_index(left, "#", 1), ":", -1), F.substring_index(left, "#", -1), *_subject_parts(right)
    good = (F.octet_length(c) <= TUPLE_BYTES) & c.rlike(rf"\A{_NAME}:{_ID}#{_NAME}@{_SUBJECT}\z")
    return F.when(good, F.struct(*(p.alias(n) for p, n in zip(parts, COLUMNS, strict=True))))


def format_relationship() -> Column:
    """The text of the row's tuple."""
    return F.expr(KEY_TEXT)


def format_subject() -> Column:
    return F.expr("concat(subject_type, ':', subject_id, coalesce(concat('#', subject_relation), ''))")


def invalid() -> Column:
    """Whether a column of a row breaks the identifier rules."""
    relation = F.col("subject_relation")
    good = is_name(F.col("resource_type")) & is_id(F.col("resource_id")) & is_name(F.col("relation")) & is_name(F.col("subject_type")) & is_id(F.col("subject_id")) & (relation.isNull() | is_name(relation))
    return ~good


def invalid_rows(tuples: DataFrame) -> DataFrame:
    """Rows of which a column breaks the identifier rules."""
    return tuples.where(invalid())


# Three-valued membership as booleans, null being conditional.
def member_union(a: Column, b: Column) -> Column:
    return a | b


def member_intersection(a: Column, b: Column) -> Column:
    return a & b


def member_exclusion(a: Column, b: Column) -> Column:
    return a & ~b


def is_userset() -> Column:
    return F.col("subject_relation").isNotNull()


def is_user() -> Column:
    return (F.col("subject_type") == "user") & F.col("subject_relation").isNull()


def is_plain_object() -> Column:
    return (F.col("subject_type") != "user") & F.col("subject_relation").isNull()


def parse_token(value: Column) -> Column:
    """revision, schema_hash and datastore of a token's text, hexadecimal digits in lower case; null if it is none."""
    pattern = r"\Arg1:([1-9][0-9]{0,19}):([0-9a-fA-F]{64}):([0-9a-fA-F]{32})\z"
    part = lambda k: F.regexp_extract(value, pattern, k)
    revision = F.when(value.rlike(pattern), part(1).cast("decimal(20,0)"))
    found = F.struct(revision.alias("revision"), F.lower(part(2)).alias("schema_hash"), F.lower(part(3)).alias("datastore"))
    return F.when(revision < F.lit(str(1 << 64)).cast("decimal(20,0)"), found)
