"""The policy language: parsing, validation, canonical text and hash of a schema. Metadata only, so all on the driver."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

from relgrid.domain import name as valid_name
from relgrid.errors import DomainError, SchemaError


@dataclass(frozen=True)
class This:
    pass


@dataclass(frozen=True)
class Computed:
    relation: str


@dataclass(frozen=True)
class ViaTuples:
    """Follow the usersets stored on `tupleset` and evaluate `relation` there."""

    tupleset: str
    relation: str


@dataclass(frozen=True)
class Union:
    operands: tuple


@dataclass(frozen=True)
class Intersection:
    operands: tuple


@dataclass(frozen=True)
class Exclusion:
    base: object
    exclude: object


Expression = This | Computed | ViaTuples | Union | Intersection | Exclusion


@dataclass(frozen=True)
class Schema:
    """Namespaces: of each its relations, of each the rewrite or None. subject_types: (namespace, relation) to the types allowed as subjects, where declared."""

    namespaces: dict[str, dict[str, Expression | None]]
    subject_types: dict[tuple[str, str], tuple[str, ...]] = field(default_factory=dict)

    def relations(self, namespace: str) -> list[str]:
        """Relation names in byte order."""
        if namespace not in self.namespaces:
            raise SchemaError("namespace_not_found", f"no namespace {namespace}")
        return sorted(self.namespaces[namespace])

    def rewrite(self, namespace: str, relation: str) -> Expression:
        """What the relation means; without a rewrite, its own tuples."""
        if relation not in self.relations(namespace):
            raise SchemaError("relation_not_found", f"no relation {relation} in namespace {namespace}")
        return self.namespaces[namespace][relation] or This()

    def has(self, namespace: str, relation: str) -> bool:
        return relation in self.namespaces.get(namespace, ())

    def pairs(self) -> list[tuple[str, str]]:
        return [(n, r) for n in sorted(self.namespaces) for r in sorted(self.namespaces[n])]


def leaves(e: Expression, positive: bool = True) -> Iterator[tuple[Expression, bool]]:
    """The leaves of an expression, with whether they count for it (not on an odd number of exclude sides)."""
    if isinstance(e, Union | Intersection):
        for x in e.operands:
            yield from leaves(x, positive)
    elif isinstance(e, Exclusion):
        yield from leaves(e.base, positive)
        yield from leaves(e.exclude, not positive)
    else:
        yield e, positive


_TOKEN = re.compile(r'(?P<skip>[ \t\r\n]+|//[^\n]*)|(?P<word>[A-Za-z_][A-Za-z0-9_]*)|"(?P<text>[^"]*)"|(?P<mark>[{}(),:])')


class _Parser:
    def __init__(self, text: str) -> None:
        self.tokens: list[tuple[str, str, int]] = []
        at = 0
        while at < len(text):
            m = _TOKEN.match(text, at)
            if m is None:
                raise self.error(f"unexpected {text[at]!r}", text.count("\n", 0, at) + 1)
            if m.lastgroup != "skip":
                self.tokens.append((m.lastgroup, m[m.lastgroup], text.count("\n", 0, at) + 1))
            at = m.end()
        self.at = 0

    @staticmethod
    def error(what: str, line: int) -> SchemaError:
        return SchemaError("parse", f"line {line}: {what}")

    def next(self, kind: str, value: str | None = None) -> str:
        found = self.tokens[self.at] if self.at < len(self.tokens) else ("end", "end of text", self.tokens[-1][2] if self.tokens else 1)
        if found[0] != kind or value is not None and found[1] != value:
            raise self.error(f"expected {value or kind}, found {found[1]!r}", found[2])
        self.at += 1
        return found[1]

    def sees(self, kind: str, value: str) -> bool:
        return self.at < len(self.tokens) and self.tokens[self.at][:2] == (kind, value)

    def ident(self) -> str:
        line = self.tokens[self.at][2] if self.at < len(self.tokens) else 0
        try:
            return valid_name(self.next("word"))
        except DomainError as e:
            raise self.error(str(e), line) from e

    def file(self) -> list[tuple[str, list[tuple[str, Expression | None]]]]:
        out = []
        while self.at < len(self.tokens):
            self.next("word", "namespace")
            namespace, relations = self.ident(), []
            self.next("mark", "{")
            while not self.sees("mark", "}"):
                self.next("word", "relation")
                relation, rewrite = self.ident(), None
                self.next("mark", "{")
                if self.sees("word", "rewrite"):
                    self.at += 1
                    rewrite = self.expression()
                self.next("mark", "}")
                relations.append((relation, rewrite))
            self.next("mark", "}")
            out.append((namespace, relations))
        return out

    def named(self, label: str) -> str:
        self.next("word", label)
        self.next("mark", ":")
        return self.next("text")

    def expression(self) -> Expression:
        if self.sees("mark", "("):
            self.at += 1
            inner = self.expression()
            self.next("mark", ")")
            return inner
        line = self.tokens[self.at][2] if self.at < len(self.tokens) else 0
        kind = self.next("word")
        if kind == "this":
            return This()
        if kind not in ("computed_userset", "tuple_to_userset", "union", "intersection", "exclusion"):
            raise self.error(f"no such expression: {kind}", line)
        self.next("mark", "(")
        if kind == "computed_userset":
            out: Expression = Computed(self.named("relation"))
        elif kind == "tuple_to_userset":
            tupleset = self.named("tupleset")
            self.next("mark", ",")
            out = ViaTuples(tupleset, self.named("computed_userset"))
        else:
            operands = []
            while not self.sees("mark", ")"):
                if operands:
                    self.next("mark", ",")
                operands.append(self.expression())
            if kind == "exclusion":
                if len(operands) != 2:
                    raise self.error("exclusion takes two operands", line)
                out = Exclusion(*operands)
            else:
                out = (Union if kind == "union" else Intersection)(tuple(operands))
        self.next("mark", ")")
        return out


def parse(text: str) -> Schema:
    """A schema from policy text, with duplicates refused but references not yet checked."""
    namespaces: dict[str, dict[str, Expression | None]] = {}
    for namespace, relations in _Parser(text).file():
        if namespace in namespaces:
            raise SchemaError("duplicate_namespace", f"namespace {namespace} is defined twice")
        found = namespaces[namespace] = {}
        for relation, rewrite in relations:
            if relation in found:
                raise SchemaError("duplicate_relation", f"relation {relation} is defined twice in namespace {namespace}")
            found[relation] = rewrite
    return Schema(namespaces)


def validate(schema: Schema) -> Schema:
    """The schema, if all that its rewrites refer to is there."""

    def check(namespace: str, relation: str, e: Expression) -> None:
        where = f"{namespace}.{relation}"
        if isinstance(e, Computed) and not schema.has(namespace, e.relation):
            raise SchemaError("computed_not_found", f"{where} refers to relation {e.relation}, which {namespace} has not")
        if isinstance(e, ViaTuples):
            if not schema.has(namespace, e.tupleset):
                raise SchemaError("tupleset_not_found", f"{where} follows relation {e.tupleset}, which {namespace} has not")
            given = schema.subject_types.get((namespace, e.tupleset))
            lacking = [t for t in given if not schema.has(t, e.relation)] if given else ([] if any(e.relation in r for r in schema.namespaces.values()) else ["any namespace"])
            if lacking:
                raise SchemaError("target_not_found", f"{where} needs relation {e.relation} in {lacking[0]}")
        if isinstance(e, Union | Intersection):
            if not e.operands:
                raise SchemaError("operands", f"{where} has a {type(e).__name__.lower()} without operands")
            for x in e.operands:
                check(namespace, relation, x)
        if isinstance(e, Exclusion):
            check(namespace, relation, e.base)
            check(namespace, relation, e.exclude)

    for namespace, relation in schema.pairs():
        check(namespace, relation, schema.rewrite(namespace, relation))
    return schema


def compile_policy(text: str) -> Schema:
    return validate(parse(text))


def expression_text(e: Expression) -> str:
    match e:
        case This():
            return "this"
        case Computed(relation):
            return f'computed_userset(relation: "{relation}")'
        case ViaTuples(tupleset, relation):
            return f'tuple_to_userset(tupleset: "{tupleset}", computed_userset: "{relation}")'
        case Exclusion(base, exclude):
            return f"exclusion({expression_text(base)}, {expression_text(exclude)})"
    return f"{type(e).__name__.lower()}({', '.join(map(expression_text, e.operands))})"


def text(schema: Schema) -> str:
    """Canonical policy text: namespaces and relations in byte order."""
    blocks = []
    for namespace in sorted(schema.namespaces):
        lines = [f"namespace {namespace} {{"]
        for relation, e in sorted(schema.namespaces[namespace].items(), key=lambda x: x[0]):
            lines.append(f"    relation {relation} {{}}" if e is None else f"    relation {relation} {{\n        rewrite {expression_text(e)}\n    }}")
        blocks.append("\n".join([*lines, "}", "", ""]))
    return "".join(blocks)


def schema_hash(schema: Schema) -> str:
    """SHA-256 over length-prefixed parts, independent of the order of definitions but not of operands."""
    out = hashlib.sha256()
    for namespace, relation in schema.pairs():
        e = schema.namespaces[namespace][relation]
        for part in (namespace, relation, "" if e is None else expression_text(e), ",".join(schema.subject_types.get((namespace, relation), ()))):
            out.update(len(part.encode()).to_bytes(8, "big") + part.encode())
    for namespace in sorted(n for n, r in schema.namespaces.items() if not r):
        out.update(len(namespace).to_bytes(8, "big") + namespace.encode())
    return out.hexdigest()


def references(schema: Schema, namespace: str, relation: str | None = None) -> list[str]:
    """Rewrites outside the namespace (or relation) that name it."""
    out = []
    for n, r in schema.pairs():
        if n == namespace and relation in (None, r):
            continue
        for e, _ in leaves(schema.rewrite(n, r)):
            same = n == namespace
            if relation is not None and (isinstance(e, Computed) and same and e.relation == relation or isinstance(e, ViaTuples) and (same and e.tupleset == relation or e.relation == relation and _only(schema, namespace, relation))):
                out.append(f"{n}.{r}")
            if relation is None and isinstance(e, ViaTuples) and any(_only(schema, namespace, x) for x in schema.namespaces[namespace] if x == e.relation):
                out.append(f"{n}.{r}")
    return sorted(set(out))


def _only(schema: Schema, namespace: str, relation: str) -> bool:
    """Whether no other namespace has the relation."""
    return all(n == namespace or relation not in r for n, r in schema.namespaces.items())
