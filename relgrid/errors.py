"""Typed errors. `code` names the case; callers match on the class and the code."""

from __future__ import annotations


class RelgridError(Exception):
    """Base of all errors of this library."""

    def __init__(self, code: str, message: str) -> None:
        super().__init__(message)
        self.code = code


class DomainError(RelgridError):
    """A malformed identifier or tuple: empty, too_long, invalid_byte, malformed."""


class SchemaError(RelgridError):
    """A policy that doesn't hold together: parse, duplicate_namespace, duplicate_relation, namespace_not_found, relation_not_found, computed_not_found, tupleset_not_found, target_not_found, operands, in_use."""


class StoreError(RelgridError):
    """A write that can't be done: exists, not_found, duplicate_mutation, precondition, too_many_mutations, too_many_preconditions."""


class ConsistencyError(RelgridError):
    """A token that can't be read: invalid, wrong_datastore, expired, unavailable, schema_mismatch."""


class EvaluationError(RelgridError):
    """A query that ran into a guard: depth, fanout, plain_subject, non_stratified."""


class ArtifactError(RelgridError):
    """A snapshot artifact that can't be read or written: missing, format, checksum, schema_hash, duplicate, invalid_rows, options, unsupported."""


class PolicyTextError(RelgridError):
    """Policy text that can't be read or written: path, line."""
