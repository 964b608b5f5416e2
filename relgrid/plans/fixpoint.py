"""Evaluation of policies as stratified fixpoints of DataFrames.

The members of an object's relation are computed for whole columns of objects at once. (type, relation) nodes form a graph,
narrowed by one small job to the kinds of usersets that are stored; its strongly connected parts are evaluated from the
bottom. A part without recursion is one plan. A recursive part whose rewrites are unions is reachability: each round joins only what was new
in the last. Others repeat their plan until nothing is added. Where a part excludes itself, the alternating fixpoint decides, or reports
that the policy leaves keys undefined.

Two restrictions are applied before anything is joined: to the subjects asked for, on the rows that introduce subjects (no
operator changes one), and to the objects that the asked-for ones can reach, exclude sides included. Where pairs of object
and subject are asked for, the subject travels with the object, so that no step makes more pairs than were asked for and their reach.
Where the policy has no cycle, reached objects are found node by node, callers first; else in rounds, which the depth guard bounds.

Guards follow one rule: a request is allowed if there is a proof within the depth; if there is none, and its exploration was cut by depth
or met an object of which a step follows too many rows, it is an error; else it is denied.

Inside, an absent subject relation is the empty string, so keys join as they are.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relgrid.errors import EvaluationError, SchemaError
from relgrid.plans.lineage import cut, cut_counted
from relgrid.plans.policy import Computed, Exclusion, Expression, Intersection, Schema, This, Union, ViaTuples, leaves

Node = tuple[str, str]
#: Rounds after which what was found is written as one table.
COMPACT = 8
#: Slots in which usersets are counted before they are counted by object.
SLOTS = 1 << 20
MEMBER = ["resource_id", "subject_type", "subject_id", "subject_relation"]


@dataclass(frozen=True)
class Limits:
    """The guards' defaults."""

    depth: int = 50
    fanout: int = 1000
    results: int = 1000


def parts(graph: dict[Node, set[Node]]) -> list[list[Node]]:
    """Strongly connected parts, each after those that it depends on."""
    index: dict[Node, int] = {}
    low: dict[Node, int] = {}
    stack: list[Node] = []
    out: list[list[Node]] = []
    for start in sorted(graph):
        if start in index:
            continue
        work = [(start, iter(sorted(graph[start])))]
        index[start] = low[start] = len(index)
        stack.append(start)
        while work:
            node, following = work[-1]
            for x in following:
                if x not in index:
                    index[x] = low[x] = len(index)
                    stack.append(x)
                    work.append((x, iter(sorted(graph.get(x, ())))))
                    break
                if x in stack:
                    low[node] = min(low[node], index[x])
            else:
                work.pop()
                if work:
                    low[work[-1][0]] = min(low[work[-1][0]], low[node])
                if low[node] == index[node]:
                    at = stack.index(node)
                    out.append(sorted(stack[at:]))
                    del stack[at:]
    return out


class Prepared:
    """What evaluations of one set of tuples share, found when first needed."""

    def __init__(self, tuples: DataFrame, fanout: int, kinds: set[tuple[str, str, str, str]] | None = None) -> None:
        self.tuples, self.limit, self.known = tuples, fanout, kinds
        self._over: DataFrame | None | bool = False

    @property
    def kinds(self) -> set[tuple[str, str, str, str]]:
        """(type, relation, subject type, subject relation) of stored usersets: at most relations x relations. More than there are do no harm."""
        if self.known is None:
            found = self.tuples.where("subject_relation is not null").select("resource_type", "relation", "subject_type", "subject_relation").distinct().collect()
            self.known = {tuple(r) for r in found}
        return self.known

    @property
    def over(self) -> DataFrame | None:
        """(f, gid): relations "type#relation" and objects with more usersets than a step may follow; None if there are none."""
        if self._over is False:
            sets, key = self.tuples.where("subject_relation is not null"), ("resource_type", "relation", "resource_id")
            # Objects share slots, so where no slot has more, no object has; that takes no row for each object.
            most = sets.groupBy(F.pmod(F.xxhash64(*key), F.lit(SLOTS)).alias("slot")).count().agg(F.max("count").alias("most")).first().most
            if (most or 0) <= self.limit:
                self._over = None
                return None
            many = sets.groupBy(*key).agg(F.count("*").alias("n")).where(F.col("n") > self.limit)
            table, n = cut_counted(many.select(F.concat_ws("#", "resource_type", "relation").alias("f"), F.col("resource_id").alias("gid")), lasting=True)
            self._over = table if n else None
        return self._over


class Evaluator:
    """Members of relations over one set of tuples."""

    def __init__(self, schema: Schema, tuples: DataFrame, limits: Limits | None = None, missing: str = "error", prepared: Prepared | None = None, by_subject: DataFrame | None = None) -> None:
        self.schema, self.limits, self.missing = schema, limits or Limits(), missing
        self.tuples = tuples
        #: The same tuples, laid out by subject if there is such a table.
        self.by_subject = tuples if by_subject is None else by_subject
        self.spark = tuples.sparkSession
        self.prepared = prepared or Prepared(tuples, self.limits.fanout)
        self.stored: dict[Node, list[Node]] = {}
        for a, b, c, d in sorted(self.prepared.kinds):
            self.stored.setdefault((a, b), []).append((c, d))
        self.reached: dict[Node, DataFrame] | None = None
        #: Nodes whose reached objects are those of one other node, as they are.
        self.same_as: dict[Node, Node] = {}
        self.was_cut = False
        self.pairs = False
        self.subjects: object = None
        self.members: dict[Node, DataFrame] = {}
        #: Counters of the last evaluation: rows found in each round, by kind of work.
        self.counters: dict[str, list[int]] = {}

    # -- the graph of nodes

    def steps(self, node: Node) -> list[tuple[str, str, Node, bool]]:
        """(kind, relation of the rows followed, node reached, positive) of all that a node's members depend on."""
        kind, relation = node
        out = []
        for e, positive in leaves(self.schema.rewrite(kind, relation)):
            match e:
                case This():
                    out += [("rows", relation, x, positive) for x in sorted(set(self.stored.get(node, ()))) if self.schema.has(*x)]
                case Computed(target):
                    out.append(("same", "", (kind, target), positive))
                case ViaTuples(tupleset, target):
                    for through in sorted({t for t, _ in self.stored.get((kind, tupleset), ())}):
                        if self.schema.has(through, target):
                            out.append(("through", tupleset, (through, target), positive))
                        elif self.missing == "error":
                            raise SchemaError("relation_not_found", f"{kind}#{relation} reaches {through}, which has no relation {target}")
        return out

    def closure(self, nodes: list[Node]) -> dict[Node, set[Node]]:
        graph: dict[Node, set[Node]] = {}
        todo = list(nodes)
        while todo:
            node = todo.pop()
            if node not in graph:
                graph[node] = {x for _, _, x, _ in self.steps(node)}
                todo += graph[node]
        return graph

    # -- rows

    def _rows(self, node: Node, tuples: DataFrame | None = None) -> DataFrame:
        """Stored rows of a node."""
        return (self.tuples if tuples is None else tuples).where((F.col("resource_type") == node[0]) & (F.col("relation") == node[1]))

    def _restricted(self, rows: DataFrame, asked_by: Node) -> DataFrame:
        if self.reached is None:
            return rows
        keys = self.reached[asked_by].select(F.col("gid").alias("resource_id"))
        return rows.join(keys, "resource_id", "left_semi")

    def _asked(self, node: Node) -> DataFrame:
        """(resource_id, subject) of the pairs asked for on a node."""
        return self.reached[node].select(F.col("gid").alias("resource_id"), *MEMBER[1:])

    def _asked_only(self, members: DataFrame, node: Node) -> DataFrame:
        if self.pairs:
            return members.join(self._asked(node), MEMBER, "left_semi")
        return self._restricted(members, node)

    def _distinct(self, members: DataFrame) -> DataFrame:
        """Pairs are only ever looked for, so repeated ones do no harm before the end."""
        return members if self.pairs else members.distinct()

    def reached_objects(self, nodes: list[Node] | None = None) -> DataFrame:
        """(g, gid, and the subjects of pairs) of what was reached on nodes, of all by default."""
        out = [f.select(F.lit("#".join(n)).alias("g"), *f.columns) for n, f in self.reached.items() if nodes is None or n in nodes]
        return reduce(DataFrame.union, out)

    def _emitted(self, node: Node) -> DataFrame:
        """The subjects that a node's rows introduce: a user for every row of type user, and the userset where there is a relation."""
        few = isinstance(self.subjects, list) and not self.pairs
        rows = self._rows(node, self.by_subject if few else self.tuples)
        if few:  # reaches the scan, which what follows does not
            named = [(F.col("subject_type") == t) & (F.col("subject_id") == i) for t, i, _ in self.subjects]
            rows = rows.where(reduce(Column.__or__, named, F.lit(False)))
        rows = self._restricted(rows, node)
        user = F.when(F.col("subject_type") == "user", F.struct("subject_type", "subject_id", F.lit("").alias("subject_relation")))
        userset = F.when(F.col("subject_relation").isNotNull(), F.struct("subject_type", "subject_id", "subject_relation"))
        subject = F.explode(F.array_compact(F.array(user, userset)))
        out = rows.select("resource_id", subject.alias("s")).select("resource_id", "s.*")
        if self.pairs:
            return self._asked_only(out, node)
        if isinstance(self.subjects, list):
            wanted = [reduce(Column.__and__, (F.col(c) == F.lit(v or "") for c, v in zip(MEMBER[1:], s, strict=True))) for s in self.subjects]
            return out.where(reduce(Column.__or__, wanted, F.lit(False)))
        return out if self.subjects is None else out.join(self.subjects, MEMBER[1:], "left_semi").select(MEMBER)

    def _links(self, asked_by: Node, relation: str, to: Node, kind: str) -> DataFrame:
        """(resource_id, via): from an object to the object whose members count for it. Rows with different relations of one subject give a link each, which does no
        harm: what follows links keeps different results only."""
        rows = self._rows((asked_by[0], relation)).where((F.col("subject_type") == to[0]) & (F.col("subject_relation") == to[1] if kind == "rows" else F.col("subject_relation").isNotNull()))
        return self._restricted(rows, asked_by).select("resource_id", F.col("subject_id").alias("via"))

    def _empty(self) -> DataFrame:
        return self.spark.createDataFrame([], "resource_id string, subject_type string, subject_id string, subject_relation string")

    # -- restriction to reachable objects

    def reach(self, keys: DataFrame, nodes: list[Node]) -> dict[Node, DataFrame]:
        """Of each node the (gid) of keys (g "type#relation", gid) and of all objects whose members they may need. Further columns, the subjects of pairs, go along."""
        graph = self.closure(nodes)
        order = parts(graph)
        longest: dict[Node, int] = {}
        for part in order:
            for n in part:
                longest[n] = 1 + max((longest.get(x, 0) for x in graph[n] if x not in part), default=0)
        if all(len(p) == 1 and p[0] not in graph[p[0]] for p in order) and max(longest.values()) <= self.limits.depth:
            return self._reach_in_order(keys, nodes, [p[0] for p in reversed(order)])
        self.shared = len(nodes) > 1  # what lies too deep for one node may have been asked for on another
        seen, _ = self._reach_in_rounds(keys, graph)
        return {n: seen.where(F.col("g") == "#".join(n)).drop("g") for n in graph}

    def _reach_in_order(self, keys: DataFrame, nodes: list[Node], order: list[Node]) -> dict[Node, DataFrame]:
        """A policy without cycles: each node once, after all that call it."""
        keys, n = cut_counted(keys.distinct())
        self.counters["reached"] = [n]
        out: dict[Node, DataFrame] = {}
        coming: dict[Node, list[tuple[DataFrame, Node | None]]] = {}
        for node in order:
            found = coming.get(node, [])
            if node in nodes:
                found = [*found, (keys.where(F.col("g") == "#".join(node)).drop("g"), None)]
            same = {by for _, by in found}
            frame = found[0][0]
            steps = self.steps(node)
            if len(same) == 1 and None not in same:
                (self.same_as[node],) = same
            elif len(found) > 1 or node not in nodes:
                frame = reduce(DataFrame.union, [f for f, _ in found]).distinct()
                if steps:  # what is used once is left in the plan
                    frame, n = cut_counted(frame)
                    self.counters["reached"].append(n)
            out[node] = frame
            for kind, relation, to, _ in steps:
                if kind == "same":
                    coming.setdefault(to, []).append((frame, node))
                else:
                    moved = frame.join(self._linked(node, relation, to, kind), "gid").drop("gid").withColumnRenamed("via", "gid").select(frame.columns)
                    coming.setdefault(to, []).append((moved, None))
        return out

    def _linked(self, node: Node, relation: str, to: Node, kind: str) -> DataFrame:
        return self._links(node, relation, to, kind).withColumnRenamed("resource_id", "gid")

    def _reach_in_rounds(self, keys: DataFrame, graph: dict[Node, set[Node]]) -> tuple[DataFrame, DataFrame | None]:
        """(g, gid, ...) of all that is reached within the depth, and what lay beyond, if anything."""
        along = [c for c in keys.columns if c not in ("g", "gid")]
        moves, same = [], []
        for node in graph:
            for kind, relation, to, _ in self.steps(node):
                if kind == "same":
                    same.append(("#".join(node), "#".join(to)))
                else:
                    moves.append(self._linked(node, relation, to, kind).select(F.lit("#".join(node)).alias("g"), "gid", F.lit("#".join(to)).alias("h"), F.col("via").alias("hid")))
        edges = reduce(DataFrame.union, moves) if moves else None
        stays = self.spark.createDataFrame(same, "g string, h string") if same else None
        seen, n = cut_counted(keys.select("g", "gid", *along).distinct())
        new, rows = seen, self.counters.setdefault("reached", [])
        rows.append(n)
        for depth in range(1, 1 << 30):
            found = []
            if edges is not None:
                found.append(new.join(edges, ["g", "gid"]).select(F.col("h").alias("g"), F.col("hid").alias("gid"), *along))
            if stays is not None:
                found.append(new.join(F.broadcast(stays), "g").select(F.col("h").alias("g"), "gid", *along))  # one row per pair of relations
            if not found:
                return seen, None
            new, n = cut_counted(reduce(DataFrame.union, found).distinct().join(seen, ["g", "gid", *along], "left_anti"))
            rows.append(n)
            if not n:
                return seen, None
            if depth >= self.limits.depth:
                self.was_cut = True
                return seen, new
            seen = seen.union(new)
            if depth % COMPACT == 0:
                seen = cut(seen)
        raise AssertionError

    # -- expressions

    def _expression(self, node: Node, e: Expression, known: dict[Node, DataFrame], negative: dict[Node, DataFrame]) -> DataFrame:
        """Members by the expression; `known` for what counts, `negative` for what is excluded."""
        kind, relation = node
        match e:
            case This():
                out = [self._emitted(node)]
                for to in sorted(set(self.stored.get(node, ()))):
                    if self.schema.has(*to) and to in known:
                        out.append(self._through(node, self._links(node, relation, to, "rows"), known[to]))
                whole = reduce(DataFrame.union, out)
                return whole if len(out) == 1 and not any(t == "user" for t, _ in self.stored.get(node, ())) else self._distinct(whole)
            case Computed(target):
                found = known.get((kind, target), self._empty())
                return found if self.same_as.get((kind, target)) == node else self._asked_only(found, node)
            case ViaTuples(tupleset, target):
                out = [self._through(node, self._links(node, tupleset, to, "through"), known[to]) for k, r, to, _ in self.steps(node) if k == "through" and r == tupleset and to[1] == target and to in known]
                return self._distinct(reduce(DataFrame.union, out)) if out else self._empty()
            case Union(operands):
                return self._distinct(reduce(DataFrame.union, [self._expression(node, x, known, negative) for x in operands]))
            case Intersection(operands):
                return reduce(DataFrame.intersect, [self._expression(node, x, known, negative) for x in operands])
            case Exclusion(base, exclude):
                # Members are distinct already, so an anti-join does.
                return self._expression(node, base, known, negative).join(self._expression(node, exclude, negative, known), MEMBER, "left_anti")
        raise TypeError(e)

    def _through(self, node: Node, links: DataFrame, members: DataFrame) -> DataFrame:
        if self.pairs:
            asked = self._asked(node).join(links, "resource_id")
            return asked.join(members.withColumnRenamed("resource_id", "via"), ["via", *MEMBER[1:]], "left_semi").select(MEMBER)
        return links.join(members.withColumnRenamed("resource_id", "via"), "via").select(MEMBER)

    # -- fixpoints

    def evaluate(self, nodes: list[Node], subjects: object = None, keys: DataFrame | None = None) -> dict[Node, DataFrame]:
        """Members of the nodes. subjects: None, a list of (type, id, relation), or a frame of them; keys: a frame (g, gid) of the
        objects asked for, or with the three subject columns the pairs asked for."""
        for node in nodes:
            self.schema.rewrite(*node)
        self.subjects, self.reached, self.members, self.counters = subjects, None, {}, {}
        self.pairs, self.same_as, self.was_cut, self.shared = False, {}, False, False
        if keys is not None:
            self.reached = self.reach(keys, nodes)
            self.pairs = "subject_id" in keys.columns
        graph = self.closure(nodes)
        for part in parts(graph):
            self._part(part, graph)
        return {n: self.members[n] for n in nodes}

    def _part(self, part: list[Node], graph: dict[Node, set[Node]]) -> None:
        inside = set(part)
        if len(part) == 1 and part[0] not in graph[part[0]]:
            node = part[0]
            self.members[node] = self._expression(node, self.schema.rewrite(*node), self.members, self.members)
            return
        steps = {n: self.steps(n) for n in part}
        if any(not positive and to in inside for n in part for _, _, to, positive in steps[n]):
            self._alternate(part)
        elif all(self._is_union(self.schema.rewrite(*n)) for n in part):
            self._reachability(part, steps)
        else:
            self.members.update(self._repeat(part, self.members))

    def _is_union(self, e: Expression) -> bool:
        return all(map(self._is_union, e.operands)) if isinstance(e, Union) else not isinstance(e, Intersection | Exclusion)

    def _reachability(self, part: list[Node], steps: dict[Node, list]) -> None:
        """Union-only parts: each round follows links from what was new."""
        inside = set(part)
        tag = lambda n, f: f.withColumn("g", F.lit("#".join(n)))
        outer = {n: m for n, m in self.members.items() if n not in inside}
        seen, count = cut_counted(reduce(DataFrame.union, [tag(n, self._expression(n, self.schema.rewrite(*n), outer, outer)) for n in part]).distinct())
        new, rows = seen, self.counters.setdefault("members", [])
        rows.append(count)
        moves, same = [], []
        for n in part:
            for kind, relation, to, _ in steps[n]:
                if to in inside and kind == "same":
                    same.append(("#".join(n), "#".join(to)))
                elif to in inside:
                    moves.append(self._links(n, relation, to, kind).select("resource_id", "via", F.lit("#".join(n)).alias("h"), F.lit("#".join(to)).alias("g")))
        links = cut(reduce(DataFrame.union, moves)) if moves else None
        stays = F.broadcast(self.spark.createDataFrame(same, "h string, g string")) if same else None
        by = ["g", *(MEMBER if self.pairs else MEMBER[:1])]
        wanted = self.reached_objects(part).withColumnRenamed("gid", "resource_id") if self.reached is not None else None

        def only(f: DataFrame) -> DataFrame:
            """What was asked for."""
            return f if self.reached is None else f.join(wanted, by, "left_semi").select(*MEMBER, "g")

        for depth in range(1, 1 << 30):
            found = []
            if links is not None:
                found.append(only(new.withColumnRenamed("resource_id", "via").join(links, ["g", "via"]).select(*MEMBER, F.col("h").alias("g"))))
            if stays is not None:
                moved = only(new.join(stays, "g").select(*MEMBER, F.col("h").alias("g")))
                found.append(moved)
            new, count = cut_counted(reduce(DataFrame.union, found).distinct().join(seen, [*MEMBER, "g"], "left_anti"))
            rows.append(count)
            if not count:
                break
            if depth > self.limits.depth:
                raise EvaluationError("depth", f"members of {part} were still found after {self.limits.depth} rounds")
            seen = cut(seen.union(new)) if depth % COMPACT == 0 else seen.union(new)
        for n in part:
            self.members[n] = seen.where(F.col("g") == "#".join(n)).select(MEMBER)

    def _repeat(self, part: list[Node], negative: dict[Node, DataFrame]) -> dict[Node, DataFrame]:
        """The least fixpoint of a part, with fixed members for what is excluded."""
        known = {**self.members, **{n: self._empty() for n in part}}
        sizes = dict.fromkeys(part, 0)
        for _ in range(self.limits.depth + 1):
            found = {n: cut_counted(self._expression(n, self.schema.rewrite(*n), known, negative).distinct()) for n in part}
            grown = {n: count for n, (_, count) in found.items()}
            self.counters.setdefault("repeated", []).append(sum(grown.values()))
            known |= {n: f for n, (f, _) in found.items()}
            if grown == sizes:
                return {n: known[n] for n in part}
            sizes = grown
        raise EvaluationError("depth", f"members of {part} were still found after {self.limits.depth} rounds")

    def _alternate(self, part: list[Node]) -> None:
        """The well-founded members of a part that excludes itself: lower and upper bounds in turn."""
        low = {n: self._empty() for n in part}
        sizes: tuple = ()
        for _ in range(self.limits.depth + 1):
            high = self._repeat(part, {**self.members, **low})
            low = self._repeat(part, {**self.members, **high})
            new = tuple((low[n].count(), high[n].count()) for n in part)
            if new == sizes:
                break
            sizes = new
        if any(a != b for a, b in sizes):
            raise EvaluationError("non_stratified", f"the policy leaves members of {part} undefined")
        self.members.update(low)

    # -- guards

    def followed(self, nodes: list[Node], every_row: bool = False) -> list[tuple[str, str, bool]]:
        """(node, relation followed, whether rows of all kinds count) of the steps of nodes, as "type#relation"."""
        out = set()
        for node in nodes:
            for e, _ in leaves(self.schema.rewrite(*node)):
                if isinstance(e, This):
                    out.add(("#".join(node), "#".join(node), every_row))
                elif isinstance(e, ViaTuples):
                    out.add(("#".join(node), f"{node[0]}#{e.tupleset}", False))
        return sorted(out)

    @property
    def may_be_blocked(self) -> bool:
        return self.was_cut or self.shared or self.prepared.over is not None

    def undecided(self, keys: DataFrame, nodes: list[Node]) -> DataFrame:
        """(root, code) of the keys (g, gid, root) whose exploration the guards cut."""
        over, graph = self.prepared.over, self.closure(nodes)
        seen, beyond = self._reach_in_rounds(keys, graph)
        out = [] if beyond is None else [beyond.select("root", F.lit("depth").alias("code"))]
        steps = F.broadcast(self.spark.createDataFrame([(g, f) for g, f, _ in self.followed(list(graph))], "g string, f string"))  # pairs of relations
        if over is not None:
            out.append(seen.join(steps, "g").join(over, ["f", "gid"]).select("root", F.lit("fanout").alias("code")))
        none = self.spark.createDataFrame([], "root string, code string")
        return reduce(DataFrame.union, out, none).groupBy("root").agg(F.min("code").alias("code"))

    def blocked(self, keys: DataFrame, nodes: list[Node]) -> tuple[str, str] | None:
        """(code, root) of a key (g, gid, root) whose exploration the guards cut, if there is one."""
        found = self.undecided(keys, nodes).first()
        return None if found is None else (found.code, found.root)

    def guard_subjects(self) -> None:
        """Raises if the last evaluation's exploration was cut, or met an object with too many rows, of all kinds where they are the object's own."""
        if self.was_cut:
            raise EvaluationError("depth", f"objects were still reached after {self.limits.depth} rounds")
        counts = []
        for g, f, every in self.followed(list(self.reached), True):
            node, step = tuple(g.split("#")), tuple(f.split("#"))
            rows = self._restricted(self._rows(step), node)
            counts.append((rows if every else rows.where("subject_relation is not null")).groupBy(F.lit(f).alias("f"), "resource_id").agg(F.count("*").alias("n")))
        if counts and (found := reduce(DataFrame.union, counts).where(F.col("n") > self.limits.fanout).first()) is not None:
            raise EvaluationError("fanout", f"{found.f} of {found.resource_id} has {found.n} rows; a step follows {self.limits.fanout} at most")

    def fanout(self, node: Node, usersets_only: bool = True) -> DataFrame:
        """(resource_id, n): rows of each object that a step follows."""
        rows = self._rows(node)
        return (rows.where("subject_relation is not null") if usersets_only else rows).groupBy("resource_id").agg(F.count("*").alias("n"))
