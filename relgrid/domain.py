"""Identifiers and tuples on the driver, for values in requests. functions/columns.py has the same rules over columns."""

from __future__ import annotations

import re
from dataclasses import dataclass

from relgrid.errors import DomainError

#: Byte limits and character sets of identifiers, and of a tuple's text.
NAME_BYTES, ID_BYTES, TENANT_BYTES, TUPLE_BYTES = 64, 256, 128, 768
NAME = r"[A-Za-z][A-Za-z0-9_]*"
ID = r"[!-~&&[^#@:/\\]]"  # as Java writes it: printable ASCII but # @ : / \
TENANT = r"[A-Za-z0-9_.-]"
_ID_BYTE = re.compile(r"[!\"$-.0-9;-?A-\[\]-~]")
_NAME_HEAD, _NAME_BYTE, _TENANT_BYTE = re.compile("[A-Za-z]"), re.compile("[A-Za-z0-9_]"), re.compile("[A-Za-z0-9_.-]")


def _scan(value: str, kind: str, most: int, fits: object) -> str:
    raw = value.encode()
    if not raw:
        raise DomainError("empty", f"{kind} is empty")
    if len(raw) > most:
        raise DomainError("too_long", f"{kind} has over {most} bytes")
    for k, byte in enumerate(raw):
        if not fits(k, chr(byte)):
            raise DomainError("invalid_byte", f"{kind} has an invalid byte at {k}")
    return value


def name(value: str, kind: str = "name") -> str:
    """A type or relation name."""
    return _scan(value, kind, NAME_BYTES, lambda k, c: bool((_NAME_BYTE if k else _NAME_HEAD).match(c)))


def ident(value: str, kind: str = "id") -> str:
    """An object or subject id."""
    return _scan(value, kind, ID_BYTES, lambda k, c: bool(_ID_BYTE.match(c)))


def tenant(value: str) -> str:
    return _scan(value, "tenant id", TENANT_BYTES, lambda k, c: bool(_TENANT_BYTE.match(c)))


@dataclass(frozen=True, order=True)
class Object:
    type: str
    id: str

    def __post_init__(self) -> None:
        name(self.type, "object type")
        ident(self.id, "object id")

    def __str__(self) -> str:
        return f"{self.type}:{self.id}"

    @classmethod
    def parse(cls, text: str) -> Object:
        if text.count(":") != 1:
            raise DomainError("malformed", f"not type:id: {text!r}")
        return cls(*text.split(":"))


@dataclass(frozen=True)
class Subject:
    """A stored or queried subject: an object, or with a relation the userset of that object."""

    type: str
    id: str
    relation: str | None = None

    def __post_init__(self) -> None:
        name(self.type, "subject type")
        ident(self.id, "subject id")
        if self.relation is not None:
            name(self.relation, "subject relation")

    def __str__(self) -> str:
        return f"{self.type}:{self.id}" + (f"#{self.relation}" if self.relation else "")

    @classmethod
    def user(cls, ident_: str) -> Subject:
        return cls("user", ident_)

    @classmethod
    def parse(cls, text: str) -> Subject:
        head, sep, relation = text.partition("#")
        if head.count(":") != 1 or "#" in relation or (sep and not relation):
            raise DomainError("malformed", f"not type:id or type:id#relation: {text!r}")
        return cls(*head.split(":"), relation or None)

    def queried(self) -> Subject:
        """As the subject of a query, which is a user or a userset."""
        if self.relation is None and self.type != "user":
            raise DomainError("malformed", f"a query's subject is a user or a userset, not {self}")
        return self


@dataclass(frozen=True)
class Tuple:
    resource: Object
    relation: str
    subject: Subject

    def __post_init__(self) -> None:
        name(self.relation, "relation")

    def __str__(self) -> str:
        return f"{self.resource}#{self.relation}@{self.subject}"

    def row(self) -> tuple:
        return self.resource.type, self.resource.id, self.relation, self.subject.type, self.subject.id, self.subject.relation

    @classmethod
    def parse(cls, text: str) -> Tuple:
        if len(text.encode()) > TUPLE_BYTES:
            raise DomainError("too_long", f"a tuple has over {TUPLE_BYTES} bytes")
        left, at, right = text.partition("@")
        if not at or "@" in right or left.count("#") != 1:
            raise DomainError("malformed", f"not resource#relation@subject: {text!r}")
        resource, relation = left.split("#")
        return cls(Object.parse(resource), name(relation, "relation"), Subject.parse(right))


def as_tuple(value: Tuple | str) -> Tuple:
    return Tuple.parse(value) if isinstance(value, str) else value
