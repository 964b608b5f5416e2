"""The engine: a schema and tuples under revisions, with validated writes and reads of retained snapshots.

One driver writes. A revision is an immutable state: the schema, a base of tuples, and what was deleted and inserted since
(tables in the shared folder). Publishing adds it to the retained ones, so a failed write leaves nothing behind.
"""

from __future__ import annotations

import re
import threading
import uuid
from collections.abc import Callable, Iterable
from dataclasses import dataclass, replace
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relgrid import domain
from relgrid.domain import Object, Subject, Tuple, as_tuple
from relgrid.errors import ArtifactError, ConsistencyError, SchemaError, StoreError
from relgrid.functions.columns import COLUMNS, SCHEMA
from relgrid.operators import graph, store
from relgrid.operators.store import Mutation, Precondition, SubjectFilter, TupleFilter
from relgrid.plans import lineage, policy
from relgrid.plans.fixpoint import Evaluator, Limits, Prepared
from relgrid.sources import artifact, text
from relgrid.sources.text import PolicyText

#: Fixed value: snapshots that stay readable.
RETAINED = 32
_TOKEN = re.compile(r"rg1:([1-9][0-9]{0,19}):([0-9a-fA-F]{64}):([0-9a-fA-F]{32})")


@dataclass(frozen=True)
class Token:
    """A handle on one revision of one engine."""

    revision: int
    schema_hash: str
    datastore: str

    def __str__(self) -> str:
        return f"rg1:{self.revision}:{self.schema_hash}:{self.datastore}"

    @classmethod
    def parse(cls, value: str) -> Token:
        m = _TOKEN.fullmatch(value) if len(value) <= 122 else None
        if m is None or int(m[1]) >= 1 << 64:
            raise ConsistencyError("invalid", "not a consistency token")
        return cls(int(m[1]), m[2].lower(), m[3].lower())


@dataclass(frozen=True)
class State:
    revision: int
    schema: policy.Schema
    schema_hash: str
    base: DataFrame
    deleted: DataFrame
    inserted: DataFrame
    changes: int
    #: Kinds of stored usersets, where they are known; those of dropped tuples may be among them.
    kinds: frozenset | None = None
    #: The base laid out by subject, where an artifact has that.
    by_subject: DataFrame | None = None

    @cached_property
    def prepared(self) -> dict[int, Prepared]:
        return {}

    @property
    def tuples(self) -> DataFrame:
        return store.overlay(self.base, self.deleted, self.inserted) if self.changes else self.base


    @property
    def subject_side(self) -> DataFrame:
        """The tuples, from the table that a filter on subjects reads least of."""
        if self.by_subject is None:
            return self.tuples
        return store.overlay(self.by_subject, self.deleted, self.inserted) if self.changes else self.by_subject


class Engine:
    """Reads take `at`: None for the latest revision, or a token (or its text)."""

    def __init__(self, spark: SparkSession, limits: Limits | None = None, retained: int = RETAINED, missing: str = "error", profile: str = "full") -> None:
        self.spark, self.limits, self.retained, self.missing, self.profile = spark, limits or Limits(), retained, missing, profile
        self.datastore = uuid.uuid4().hex
        self.states: dict[int, State] = {}
        self._write = threading.Lock()
        empty = spark.createDataFrame([], SCHEMA)
        self._last = State(0, policy.Schema({}), policy.schema_hash(policy.Schema({})), empty, empty, empty, 0, frozenset())

    # -- revisions

    def _publish(self, state: State) -> Token:
        state = replace(state, revision=self._last.revision + 1, schema_hash=policy.schema_hash(state.schema))
        self.states = {**{k: v for k, v in self.states.items() if k > state.revision - self.retained}, state.revision: state}
        self._last = state
        return self.token()

    def token(self) -> Token:
        return Token(self._last.revision, self._last.schema_hash, self.datastore)

    def state(self, at: Token | str | None = None) -> State:
        if at is None:
            return self._last
        token = Token.parse(at) if isinstance(at, str) else at
        if token.datastore != self.datastore:
            raise ConsistencyError("wrong_datastore", "the token is of another engine")
        if token.revision > self._last.revision:
            raise ConsistencyError("unavailable", f"revision {token.revision} is not there yet")
        if token.revision not in self.states:
            expired = token.revision <= self._last.revision - self.retained
            raise ConsistencyError("expired" if expired else "unavailable", f"revision {token.revision} is not retained")
        if self.states[token.revision].schema_hash != token.schema_hash:
            raise ConsistencyError("schema_mismatch", f"the token's schema is not that of revision {token.revision}")
        return self.states[token.revision]

    def evaluator(self, at: Token | str | None = None) -> Evaluator:
        state = self.state(at)
        known = state.prepared.setdefault(self.limits.fanout, Prepared(state.tuples, self.limits.fanout, None if state.kinds is None else set(state.kinds)))
        return Evaluator(state.schema, state.tuples, self.limits, self.missing, known, state.subject_side)

    def tuples(self, at: Token | str | None = None) -> DataFrame:
        return self.state(at).tuples

    # -- schema

    def _set_schema(self, make: Callable[[policy.Schema], policy.Schema]) -> Token:
        with self._write:
            schema = policy.validate(make(self._last.schema))
            store.check_references(self._last.tuples, schema)
            return self._publish(replace(self._last, schema=schema))

    def apply_schema(self, dsl: str) -> Token:
        """Adds or replaces whole namespaces."""
        return self.apply_namespaces(policy.parse(dsl))

    def apply_namespaces(self, new: policy.Schema) -> Token:
        return self._set_schema(lambda old: policy.Schema({**old.namespaces, **new.namespaces}, {**{k: v for k, v in old.subject_types.items() if k[0] not in new.namespaces}, **new.subject_types}))

    def replace_schema(self, dsl: str) -> Token:
        return self._set_schema(lambda old: policy.parse(dsl))

    def delete_namespace(self, namespace: str) -> Token:
        def make(old: policy.Schema) -> policy.Schema:
            old.relations(namespace)
            self._unused(old, namespace)
            return policy.Schema({n: r for n, r in old.namespaces.items() if n != namespace}, {k: v for k, v in old.subject_types.items() if k[0] != namespace})

        return self._set_schema(make)

    def delete_relation(self, namespace: str, relation: str) -> Token:
        def make(old: policy.Schema) -> policy.Schema:
            old.rewrite(namespace, relation)
            self._unused(old, namespace, relation)
            return policy.Schema({n: {k: v for k, v in r.items() if (n, k) != (namespace, relation)} for n, r in old.namespaces.items()}, {k: v for k, v in old.subject_types.items() if k != (namespace, relation)})

        return self._set_schema(make)

    def _unused(self, schema: policy.Schema, namespace: str, relation: str | None = None) -> None:
        if used := policy.references(schema, namespace, relation):
            raise SchemaError("in_use", f"{used[0]} refers to it")
        stored = (F.col("resource_type") == namespace) | (F.col("subject_type") == namespace)
        if relation is not None:
            stored = ((F.col("resource_type") == namespace) & (F.col("relation") == relation)) | ((F.col("subject_type") == namespace) & (F.col("subject_relation") == relation))
        if not self._last.tuples.where(stored).isEmpty():
            raise SchemaError("in_use", "tuples refer to it")

    # -- writes

    def write(self, mutations: Iterable[Mutation], preconditions: Iterable[Precondition] = ()) -> Token:
        """All of the batch or nothing. An empty batch publishes a revision too."""
        ops = list(mutations)
        batch = self.spark.createDataFrame([(m.op, *m.tuple.row()) for m in ops], f"op string, {SCHEMA}")
        with self._write:
            store.check_references(batch.select(COLUMNS), self._last.schema)
            store.validate_batch(self._last.tuples, batch, list(preconditions), len(ops))
            return self._apply(batch, len(ops))

    def write_frame(self, batch: DataFrame, preconditions: Iterable[Precondition] = ()) -> Token:
        """A batch (op and the six columns) of any size, as one revision."""
        batch = lineage.cut(batch.select("op", *COLUMNS))
        with self._write:
            store.check_references(batch.select(COLUMNS), self._last.schema)
            store.validate_batch(self._last.tuples, batch, list(preconditions), 0)
            return self._apply(batch, batch.count())

    def merge(self, batch: DataFrame) -> Token:
        """Touches and deletes of what may be there; of several operations on a key any create or touch wins."""
        one = batch.groupBy(COLUMNS).agg(F.bool_and(F.col("op") == "delete").alias("gone"))
        live = lineage.cut(one.select(F.when(F.col("gone"), "delete").otherwise("touch").alias("op"), *COLUMNS))
        with self._write:
            store.check_references(live.where("op = 'touch'").select(COLUMNS), self._last.schema)
            known = store.existing(store.near(self._last.tuples, live), live.where("op = 'delete'").select(COLUMNS)).withColumn("op", F.lit("delete"))
            return self._apply(live.where("op = 'touch'").unionByName(known), live.count())

    def _apply(self, batch: DataFrame, size: int) -> Token:
        last = self._last
        if not size:
            return self._publish(last)
        gone, new = store.changes(store.near(last.tuples, batch), batch)
        # What comes back to the base is no longer deleted; the rest of the new is inserted.
        inserted = lineage.cut(store.without(last.inserted, gone).unionByName(store.without(new, last.deleted)), lasting=True)
        deleted = lineage.cut(store.without(last.deleted, new).unionByName(store.existing(store.near(last.base, batch), gone)).distinct(), lasting=True)
        kinds = last.kinds
        if kinds is not None:  # those of the new tuples, at most relations x relations
            kinds |= {tuple(r) for r in new.where("subject_relation is not null").select("resource_type", "relation", "subject_type", "subject_relation").distinct().collect()}
        state = replace(last, inserted=inserted, deleted=deleted, changes=last.changes + size, kinds=kinds)
        return self._publish(self._compacted(state) if state.changes >= store.COMPACT_AT else state)

    def _compacted(self, state: State) -> State:
        empty = self.spark.createDataFrame([], SCHEMA)
        return replace(state, base=lineage.cut(state.tuples, lasting=True), deleted=empty, inserted=empty, changes=0, by_subject=None)

    def compact(self) -> Token:
        """Rewrites the live tuples as the base of a new revision."""
        with self._write:
            return self._publish(self._compacted(self._last))

    def create(self, value: Tuple | str) -> Token:
        return self.write([Mutation("create", as_tuple(value))])

    def touch(self, value: Tuple | str) -> Token:
        return self.write([Mutation("touch", as_tuple(value))])

    def delete(self, value: Tuple | str) -> Token:
        return self.write([Mutation("delete", as_tuple(value))])

    # -- reads

    def query(self, by: TupleFilter, limit: int | None = store.QUERY_LIMIT, at: Token | str | None = None) -> DataFrame:
        return store.query(self.tuples(at), by, limit)

    def reverse_query(self, by: SubjectFilter, at: Token | str | None = None) -> DataFrame:
        return store.reverse_query(self.state(at).subject_side, by)

    def check(self, resource: Object, relation: str, subject: Subject, at: Token | str | None = None) -> bool:
        subject.queried()
        row = (resource.type, resource.id, relation, subject.type, subject.id, subject.relation)
        return graph.check(self.evaluator(at), self.spark.createDataFrame([row], SCHEMA)).first().allowed

    def check_many(self, requests: DataFrame, at: Token | str | None = None) -> DataFrame:
        return graph.check(self.evaluator(at), requests)

    def _needs_full(self, what: str) -> None:
        if self.profile != "full":
            raise ArtifactError("unsupported", f"profile {self.profile} doesn't support {what}")

    def lookup_resources(self, subject: Subject, permission: str, resource_type: str, limit: int | None = None, at: Token | str | None = None) -> DataFrame:
        self._needs_full("lookup_resources")
        return graph.lookup_resources(self.evaluator(at), subject, permission, resource_type, self.limits.results if limit is None else limit)

    def lookup_subjects(self, resource: Object, permission: str, subject_type: str, limit: int | None = None, at: Token | str | None = None) -> DataFrame:
        return graph.lookup_subjects(self.evaluator(at), resource, permission, subject_type, self.limits.results if limit is None else limit)

    def lookup_permissions(self, subject: Subject, resource: Object, at: Token | str | None = None) -> list[str]:
        return [r.relation for r in graph.lookup_permissions(self.evaluator(at), subject, resource).collect()]

    def lookup_object_permissions(self, resource: Object, subject_type: str, at: Token | str | None = None) -> dict[str, list[str]]:
        return {r.relation: r.subjects for r in graph.lookup_object_permissions(self.evaluator(at), resource, subject_type).collect()}

    def expand(self, resource: Object, relation: str, at: Token | str | None = None) -> graph.Tree:
        objects = self.spark.createDataFrame([(resource.id,)], "id string")
        return graph.tree(graph.expand(self.evaluator(at), objects, resource.type, relation).collect())

    # -- policies and artifacts

    def _replaced(self, schema: policy.Schema, tuples: DataFrame) -> Token:
        tuples, n = lineage.cut_counted(tuples, lasting=True)
        store.check_references(tuples, schema)
        if bad := store.repeated(tuples, n):
            raise StoreError("exists", f"given twice: {bad}")
        with self._write:
            empty = self.spark.createDataFrame([], SCHEMA)
            self.states = {}
            return self._publish(State(0, schema, "", tuples, empty, empty, 0))

    def replace_all(self, dsl: str, tuples: DataFrame) -> Token:
        """A policy and a frame of tuples in place of what there was; a tuple given twice stops it."""
        return self._replaced(policy.compile_policy(dsl), tuples.select(COLUMNS))

    def apply_policy_text(self, given: PolicyText) -> Token:
        """Replaces schema and tuples; a tuple given twice stops it."""
        return self._replaced(*text.from_text(self.spark, given))

    def apply_policy_files(self, directory: str) -> Token:
        """The same from files, as export_policy_files() writes them, read by tasks."""
        return self._replaced(*text.from_files(self.spark, directory))

    def export_policy_text(self, at: Token | str | None = None) -> PolicyText:
        """The policy as text of the driver: for what fits there. export_policy_files() has no such bound."""
        return text.to_text(self.state(at).schema, self.tuples(at))

    def export_policy_files(self, directory: str, at: Token | str | None = None) -> None:
        """schema.zed and relationships/<type>.zedtuples below a directory, lines in order; a type's file is a folder of ranges, written by tasks."""
        text.write_files(self.state(at).schema, self.tuples(at), directory)

    def save_snapshot(self, path: str, profile: str = "full", compression: str = "zstd", at: Token | str | None = None) -> None:
        state = self.state(at)
        artifact.save(path, state.schema, state.tuples, state.revision, profile, compression)

    @classmethod
    def load_snapshot(cls, spark: SparkSession, path: str, **options: object) -> Engine:
        """An engine with the artifact as its one revision and an id of its own."""
        found = artifact.load(spark, path, **options)
        engine = cls(spark, profile=found.profile)
        engine._last = replace(engine._last, revision=found.revision - 1)
        engine._publish(replace(engine._last, schema=found.schema, base=found.tuples, kinds=None, by_subject=found.by_subject))
        return engine


class Tenants:
    """Engines by tenant."""

    def __init__(self, make: Callable[[], Engine]) -> None:
        self._make, self._engines, self._lock = make, {}, threading.Lock()

    def get(self, tenant: str) -> Engine | None:
        return self._engines.get(domain.tenant(tenant))

    def get_or_create(self, tenant: str) -> Engine:
        domain.tenant(tenant)
        with self._lock:
            if tenant not in self._engines:
                self._engines = {**self._engines, tenant: self._make()}
        return self._engines[tenant]

    def tenants(self) -> list[str]:
        return sorted(self._engines)
