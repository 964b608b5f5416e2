"""The read queries over many objects and subjects at once: check, lookups, enumeration of permissions, and expand."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from relgrid.domain import Object, Subject
from relgrid.errors import EvaluationError, SchemaError
from relgrid.plans.fixpoint import MEMBER, Evaluator, Node
from relgrid.plans.lineage import cut, cut_observed
from relgrid.plans.policy import Computed, Exclusion, Expression, Intersection, This, Union, ViaTuples

REQUEST = ["resource_type", "resource_id", "relation", "subject_type", "subject_id", "subject_relation"]


def _external(members: DataFrame) -> DataFrame:
    return members.withColumn("subject_relation", F.nullif("subject_relation", F.lit("")))


def _one(evaluator: Evaluator, resource: Object, relations: list[str]) -> DataFrame:
    return evaluator.spark.createDataFrame([(f"{resource.type}#{r}", resource.id) for r in relations], "g string, gid string")


def check(evaluator: Evaluator, requests: DataFrame) -> DataFrame:
    """The requests (six columns) with `allowed`. Requests of unknown relations are an error, as are those that are not allowed and whose
    exploration a guard cut; repeated ones are answered each."""
    asked = [(r.resource_type, r.relation) for r in requests.select("resource_type", "relation").distinct().collect()]  # relations of the schema
    inner = requests.withColumn("subject_relation", F.coalesce("subject_relation", F.lit("")))
    key = F.concat_ws("#", "resource_type", "relation").alias("g")
    found = evaluator.evaluate(asked, None, inner.select(key, F.col("resource_id").alias("gid"), *MEMBER[1:]))
    members = None
    for (kind, relation), m in found.items():
        m = m.select(F.lit(kind).alias("resource_type"), "resource_id", F.lit(relation).alias("relation"), *MEMBER[1:])
        members = m if members is None else members.union(m)
    if members is None:
        return requests.withColumn("allowed", F.lit(False))
    out = inner.join(members.distinct().withColumn("allowed", F.lit(True)), REQUEST, "left")
    answers = out.select(*requests.columns, F.coalesce("allowed", F.lit(False)).alias("allowed"))
    if evaluator.may_be_blocked:
        answers = cut(answers)
        _guard(evaluator, answers.where("not allowed").select(key, F.col("resource_id").alias("gid"), F.to_json(F.struct(REQUEST)).alias("root")).distinct(), asked)
    return _external(answers)


def _guard(evaluator: Evaluator, denied: DataFrame, nodes: list[Node]) -> None:
    """denied: (g, gid, root) of what has no proof."""
    if (found := evaluator.blocked(denied, nodes)) is not None:
        raise EvaluationError(found[0], f"the guard on {found[0]} leaves undecided: {found[1]}")


def _limited(frame: DataFrame, limit: int | None) -> DataFrame:
    """At most `limit` rows in order, with `truncated`: whether there were more."""
    if limit is None:
        return frame.withColumn("truncated", F.lit(False))
    more = frame.orderBy(*frame.columns).limit(limit + 1)
    return more.withColumn("truncated", F.count("*").over(Window.partitionBy()) > limit).orderBy(*frame.columns).limit(limit)


def lookup_resources(evaluator: Evaluator, subject: Subject, permission: str, resource_type: str, limit: int | None = None) -> DataFrame:
    """resource_id, truncated: the objects of the type on which the subject has the permission."""
    subject.queried()
    node = (resource_type, permission)
    found = evaluator.evaluate([node], [(subject.type, subject.id, subject.relation)])[node]
    return _limited(found.select("resource_id").distinct(), limit)


def _plain_subjects(evaluator: Evaluator) -> bool:
    """Whether a reached object has a plain subject other than a user, which no query can answer with."""
    rows = evaluator.tuples.where("subject_type <> 'user' and subject_relation is null").select(F.concat_ws("#", "resource_type", "relation").alias("g"), F.col("resource_id").alias("gid"))
    return not rows.join(evaluator.reached_objects(), ["g", "gid"], "left_semi").isEmpty()


def lookup_subjects(evaluator: Evaluator, resource: Object, permission: str, subject_type: str, limit: int | None = None) -> DataFrame:
    """subject_type, subject_id, subject_relation, truncated: the users, or the usersets of a type, with the permission."""
    if subject_type != "user" and subject_type not in evaluator.schema.namespaces:
        raise SchemaError("namespace_not_found", f"no namespace {subject_type}")
    node = (resource.type, permission)
    found = evaluator.evaluate([node], None, _one(evaluator, resource, [permission]))[node]
    evaluator.guard_subjects()
    if _plain_subjects(evaluator):
        raise EvaluationError("plain_subject", "an object other than a user is stored without a relation")
    wanted = (F.col("resource_id") == resource.id) & (F.col("subject_type") == subject_type) & ((F.col("subject_relation") == "") if subject_type == "user" else (F.col("subject_relation") != ""))
    return _limited(_external(found.where(wanted).select(MEMBER[1:])), limit)


def lookup_permissions(evaluator: Evaluator, subject: Subject, resource: Object) -> DataFrame:
    """relation: those of the object that the subject has, in order of name."""
    subject.queried()
    relations = evaluator.schema.relations(resource.type)
    nodes = [(resource.type, r) for r in relations]
    found = evaluator.evaluate(nodes, [(subject.type, subject.id, subject.relation)], _one(evaluator, resource, relations))
    out = None
    for (_, relation), m in found.items():
        m = m.where(F.col("resource_id") == resource.id).select(F.lit(relation).alias("relation"))
        out = m if out is None else out.union(m)
    out = out.distinct()
    if evaluator.may_be_blocked:
        out = cut(out)
        denied = _one(evaluator, resource, relations).withColumn("root", F.substring_index("g", "#", -1)).join(out, F.col("root") == F.col("relation"), "left_anti")
        _guard(evaluator, denied, nodes)
    return out.orderBy("relation")


def permissions_of(evaluator: Evaluator, subjects: DataFrame, resource_type: str) -> DataFrame:
    """resource_id, relation and subject of all relations of a type that the subjects (type, id, relation) have."""
    inner = subjects.withColumn("subject_relation", F.coalesce("subject_relation", F.lit("")))
    nodes = [(resource_type, r) for r in evaluator.schema.relations(resource_type)]
    out = None
    for (_, relation), m in evaluator.evaluate(nodes, inner).items():
        m = m.select("resource_id", F.lit(relation).alias("relation"), *MEMBER[1:])
        out = m if out is None else out.union(m)
    return _external(out)


def lookup_object_permissions(evaluator: Evaluator, resource: Object, subject_type: str) -> DataFrame:
    """relation, subjects (sorted array of texts): of each relation of the object that has any, the users or usersets of the type."""
    relations = evaluator.schema.relations(resource.type)
    found = evaluator.evaluate([(resource.type, r) for r in relations], None, _one(evaluator, resource, relations))
    evaluator.guard_subjects()
    out = None
    for (_, relation), m in found.items():
        m = m.where((F.col("resource_id") == resource.id) & (F.col("subject_type") == subject_type) & ((F.col("subject_relation") == "") == (subject_type == "user")))
        m = m.select(F.lit(relation).alias("relation"), F.expr("concat(subject_type, ':', subject_id, if(subject_relation = '', '', concat('#', subject_relation)))").alias("s"))
        out = m if out is None else out.union(m)
    return out.groupBy("relation").agg(F.array_sort(F.collect_set("s")).alias("subjects")).orderBy("relation")


def reach_counts(evaluator: Evaluator, node: Node, usersets_only: bool = True) -> DataFrame:
    """resource_id, n, over: rows that a step on each object follows, and whether that is over the guard."""
    return evaluator.fanout(node, usersets_only).withColumn("over", F.col("n") > evaluator.limits.fanout)


# -- expand


@dataclass
class Tree:
    """A node of an expanded tree: union, intersection, exclusion, user or userset."""

    kind: str
    value: str | None
    children: list[Tree]


PATH = "root string, path string, kind string, type string, id string, relation string"


class _Expansion:
    """Trees of many objects at once, a level of computed relations and tuple links per round.

    A path is the numbers of children from the root, as text of four digits each, so paths sort as trees are written.
    """

    def __init__(self, evaluator: Evaluator) -> None:
        self.e = evaluator
        self.nodes: list[DataFrame] = []
        self.next: dict[Node, list[DataFrame]] = {}

    def _inner(self, at: DataFrame, kind: str) -> None:
        none = F.lit(None).cast("string")
        self.nodes.append(at.select("root", "path", F.lit(kind).alias("kind"), none.alias("type"), none.alias("id"), none.alias("relation")))

    def _goto(self, at: DataFrame, node: Node) -> None:
        self.next.setdefault(node, []).append(at)

    def walk(self, at: DataFrame, node: Node, e: Expression) -> None:
        """at: (root, path, id, active), places where the expression of a node is to be written for objects `id`."""
        kind, relation = node
        child = lambda f, k: f.withColumn("path", F.concat("path", F.lit(f"{k:04d}")))
        match e:
            case This():
                self._inner(at, "union")
                rows = self.e._rows(node).select(F.col("resource_id").alias("id"), *MEMBER[1:])
                found = at.join(rows, "id").withColumn("k", F.row_number().over(Window.partitionBy("root", "path").orderBy(*MEMBER[1:])) - 1)  # as many as the fanout guard lets
                self.leaves(found)
            case Computed(target):
                self._goto(at, (kind, target))
            case ViaTuples(tupleset, target):
                self._inner(at, "union")
                rows = self.e._rows((kind, tupleset)).where("subject_relation is not null").select(F.col("resource_id").alias("id"), F.col("subject_type").alias("t"), F.col("subject_id").alias("via")).distinct()
                found = at.join(rows, "id").withColumn("k", F.row_number().over(Window.partitionBy("root", "path").orderBy("t", "via")) - 1)
                placed = self.placed(found.select("root", F.concat("path", F.lpad(F.col("k").cast("string"), 4, "0")).alias("path"), F.col("via").alias("id"), "active", "t", "k"))
                for _, _, to, _ in [s for s in self.e.steps(node) if s[0] == "through" and s[1] == tupleset and s[2][1] == target]:
                    self._goto(placed.where(F.col("t") == to[0]).drop("t", "k"), to)
            case Union(operands) | Intersection(operands):
                self._inner(at, type(e).__name__.lower())
                for k, x in enumerate(operands):
                    self.walk(child(at, k), node, x)
            case Exclusion(base, exclude):
                self._inner(at, "exclusion")
                self.walk(child(at, 0), node, base)
                self.walk(child(at, 1), node, exclude)

    def placed(self, frame: DataFrame, plain: str = "false") -> DataFrame:
        """The frame, written, if no step has followed too many rows and none is `plain`."""
        out, seen = cut_observed(frame, F.max("k").alias("k"), F.count_if(F.expr(plain)).alias("plain"))
        if (seen["k"] or 0) >= min(self.e.limits.fanout, 10_000):
            raise EvaluationError("fanout", f"a step follows more than {self.e.limits.fanout} rows")
        if seen["plain"]:
            raise EvaluationError("plain_subject", "an object other than a user is stored without a relation")
        return out

    def leaves(self, found: DataFrame) -> None:
        placed = self.placed(found, "subject_type <> 'user' and subject_relation is null")
        kind = F.when(F.col("subject_relation").isNull(), "user").otherwise("userset")
        self.nodes.append(placed.select("root", F.concat("path", F.lpad(F.col("k").cast("string"), 4, "0")).alias("path"), kind.alias("kind"), F.col("subject_type").alias("type"), F.col("subject_id").alias("id"), F.col("subject_relation").alias("relation")))

    def run(self, objects: DataFrame, node: Node) -> DataFrame:
        self.e.schema.rewrite(*node)
        key = lambda n: F.concat(F.lit(f"{n[0]}#{n[1]}#"), "id")
        self.next = {node: [objects.select(F.col("id").alias("root"), F.lit("").alias("path"), "id", F.array().cast("array<string>").alias("active"))]}
        for depth in range(self.e.limits.depth + 2):
            todo, self.next = self.next, {}
            for n, frames in todo.items():
                ring = F.array_contains("active", key(n))
                at, seen = cut_observed(_union(frames), F.count_if(ring).alias("rings"), F.count_if(~ring).alias("open"))
                if seen["rings"]:
                    self._inner(at.where(ring), "union")
                if not seen["open"]:
                    continue
                open_ = at.where(~ring).withColumn("active", F.array_append("active", key(n)))
                if depth > self.e.limits.depth:
                    raise EvaluationError("depth", f"the tree is deeper than {self.e.limits.depth}")
                self.walk(open_, n, self.e.schema.rewrite(*n))
            if not self.next:
                break
        return _union(self.nodes)


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def expand(evaluator: Evaluator, objects: DataFrame, resource_type: str, relation: str) -> DataFrame:
    """(root, path, kind, type, id, relation): the nodes of the trees of all objects (column id). Stored usersets are leaves; cycles are empty unions."""
    return _Expansion(evaluator).run(objects, (resource_type, relation))


def tree(nodes: list) -> Tree:
    """The nested tree of one object's rows."""
    made: dict[str, Tree] = {}
    for row in sorted(nodes, key=lambda r: r.path):
        value = None if row.type is None else f"{row.type}:{row.id}" + (f"#{row.relation}" if row.relation else "")
        made[row.path] = Tree(row.kind, value, [])
        if row.path:
            made[row.path[:-4]].children.append(made[row.path])
    return made[""]
