"""Reads and writes over tuples as frames: filters, probes, the mutation log, preconditions and validated batches."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from relgrid.domain import Tuple
from relgrid.errors import SchemaError, StoreError
from relgrid.functions.columns import COLUMNS, KEY_TEXT
from relgrid.plans.policy import Schema

#: Rows that a query returns by default, operations and preconditions of a batch, changes that call for compaction.
QUERY_LIMIT, BATCH_LIMIT, PRECONDITION_LIMIT, COMPACT_AT = 1000, 10_000, 100, 100_000


@dataclass(frozen=True)
class SubjectFilter:
    """Subjects of a type; without an id or relation, any."""

    type: str
    id: str | None = None
    relation: str | None = None

    def column(self) -> Column:
        out = F.col("subject_type") == self.type
        if self.id is not None:
            out &= F.col("subject_id") == self.id
        if self.relation is not None:
            out &= F.col("subject_relation") == self.relation
        return out


@dataclass(frozen=True)
class TupleFilter:
    """Tuples of a resource type, and what else is given."""

    resource_type: str
    resource_id: str | None = None
    relation: str | None = None
    subject: SubjectFilter | None = None

    def column(self) -> Column:
        out = F.col("resource_type") == self.resource_type
        if self.resource_id is not None:
            out &= F.col("resource_id") == self.resource_id
        if self.relation is not None:
            out &= F.col("relation") == self.relation
        return out if self.subject is None else out & self.subject.column()


def query(tuples: DataFrame, by: TupleFilter, limit: int | None = QUERY_LIMIT) -> DataFrame:
    """Matching tuples in order, at most `limit` (None: all)."""
    found = tuples.where(by.column())
    return found if limit is None else found.orderBy(COLUMNS).limit(limit)


def reverse_query(tuples: DataFrame, by: SubjectFilter) -> DataFrame:
    """All tuples with such a subject."""
    return tuples.where(by.column())


def existing(tuples: DataFrame, probes: DataFrame) -> DataFrame:
    """The probes (six columns) that are stored."""
    return _match(probes, tuples, "left_semi")


def existing_subjects(tuples: DataFrame, subjects: DataFrame) -> DataFrame:
    """The subjects (three columns) of which a live tuple is stored."""
    names = COLUMNS[3:]
    s, t = subjects.alias("s"), tuples.select(names).alias("t")
    return s.join(t, [F.col(f"s.{c}").eqNullSafe(F.col(f"t.{c}")) for c in names], "left_semi")


def _match(left: DataFrame, right: DataFrame, how: str) -> DataFrame:
    a, b = left.alias("a"), right.alias("b")
    on = [F.col(f"a.{c}") == F.col(f"b.{c}") for c in COLUMNS[:5]] + [F.col("a.subject_relation").eqNullSafe(F.col("b.subject_relation"))]
    return a.join(b, on, how)


def without(tuples: DataFrame, gone: DataFrame) -> DataFrame:
    return _match(tuples, gone, "left_anti")


def overlay(base: DataFrame, deleted: DataFrame, inserted: DataFrame) -> DataFrame:
    """Live tuples: the base without what was deleted, and what was inserted."""
    return without(base.select(COLUMNS), deleted).unionByName(inserted.select(COLUMNS))


def as_of(base: DataFrame, log: DataFrame, revision: int) -> DataFrame:
    """Live tuples at a revision: the last operation on each key decides, or the base where there is none."""
    last = log.where(F.col("revision") <= revision).groupBy(COLUMNS).agg(F.max_by("op", F.struct("revision", "ordinal")).alias("op"))
    return overlay(base, last, last.where("op <> 'delete'"))


def unknown_reference(schema: Schema) -> Column:
    """Whether a row's relation, or its userset's relation, is not in the schema. The schema's pairs are in the expression, so no row moves."""
    pairs = [f"{n}#{r}" for n, r in schema.pairs()]
    known = lambda kind, relation: F.coalesce(F.concat(kind, F.lit("#"), relation).isin(pairs), F.lit(False))
    return ~known("resource_type", "relation") | (F.col("subject_relation").isNotNull() & ~known("subject_type", "subject_relation"))


def broken_references(tuples: DataFrame, schema: Schema) -> DataFrame:
    """Tuples of which the relation, or the userset's relation, is not in the schema."""
    return tuples.where(unknown_reference(schema)).distinct()


def check_references(tuples: DataFrame, schema: Schema) -> None:
    if (bad := tuples.where(unknown_reference(schema)).agg(F.min(F.expr(KEY_TEXT)), F.count("*").alias("n")).first()).n:
        raise SchemaError("relation_not_found", f"a relation of {bad[0]} is not in the schema")


@dataclass(frozen=True)
class Mutation:
    """op: create, touch or delete."""

    op: str
    tuple: Tuple


@dataclass(frozen=True)
class Precondition:
    """Whether a tuple must match, or none may."""

    must_match: bool
    filter: TupleFilter


def failed_precondition(tuples: DataFrame, preconditions: list[Precondition]) -> Precondition | None:
    """The first that doesn't hold; one job for all."""
    if not preconditions:
        return None
    found = tuples.agg(*(F.coalesce(F.bool_or(p.filter.column()), F.lit(False)).alias(f"p{k}") for k, p in enumerate(preconditions))).first()
    return next((p for k, p in enumerate(preconditions) if found[k] != p.must_match), None)


def near(tuples: DataFrame, batch: DataFrame) -> DataFrame:
    """The tuples of the types and relations in a batch, among which are all that its rows can be the same as. The pairs are gathered: at most as many as the schema has."""
    pairs = [(r.resource_type, r.relation) for r in batch.select("resource_type", "relation").distinct().collect()]
    kind, relation = F.col("resource_type"), F.col("relation")
    some = kind.isin(list({k for k, _ in pairs})) & relation.isin(list({r for _, r in pairs}))  # reaches the scan
    return tuples.where(some & F.concat(kind, F.lit("#"), relation).isin([f"{k}#{r}" for k, r in pairs]))


def conflicts(tuples: DataFrame, batch: DataFrame) -> DataFrame:
    """Operations (op and six columns) that can't be done: creates of stored tuples, deletes of missing ones."""
    return _match(batch.where("op = 'create'"), tuples, "left_semi").unionByName(_match(batch.where("op = 'delete'"), tuples, "left_anti"))


def duplicates(batch: DataFrame) -> DataFrame:
    """Keys on which a batch has more than one operation."""
    return batch.groupBy(COLUMNS).count().where("count > 1").select(COLUMNS)


#: Rows whose digests one task counts.
COUNTED = 500_000


def repeated(tuples: DataFrame, n: int) -> Row | None:
    """A tuple that is stored more than once, of n; None if there is none. Digests of the rows are counted, in as many tasks as the rows need;
    only where one repeats are rows compared, so the answer is exact."""
    digests = tuples.select(F.xxhash64(*COLUMNS).alias("h")).repartition(-(-n // COUNTED) or 1, "h")
    if digests.groupBy("h").count().agg(F.max("count").alias("most")).first().most in (None, 1):
        return None
    return duplicates(tuples).first()


def changes(tuples: DataFrame, batch: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(deleted, inserted) of a valid batch."""
    return batch.where("op = 'delete'").select(COLUMNS), without(batch.where("op <> 'delete'").select(COLUMNS), tuples)


def validate_batch(tuples: DataFrame, batch: DataFrame, preconditions: list[Precondition], size: int | None = None) -> None:
    """Raises what stops the batch: first its preconditions, then its size, repeated keys, and conflicts."""
    if len(preconditions) > PRECONDITION_LIMIT:
        raise StoreError("too_many_preconditions", f"{len(preconditions)} preconditions; at most {PRECONDITION_LIMIT}")
    if (p := failed_precondition(tuples, preconditions)) is not None:
        raise StoreError("precondition", f"not so: {p}")
    n = batch.count() if size is None else size
    if n > BATCH_LIMIT:
        raise StoreError("too_many_mutations", f"{n} operations; at most {BATCH_LIMIT}")
    if bad := duplicates(batch).select(F.expr(KEY_TEXT)).limit(1).collect():
        raise StoreError("duplicate_mutation", f"two operations on {bad[0][0]}")
    if bad := conflicts(near(tuples, batch), batch).select("op", F.expr(KEY_TEXT)).limit(1).collect():
        raise StoreError("exists" if bad[0][0] == "create" else "not_found", f"{bad[0][0]} of {bad[0][1]}")
