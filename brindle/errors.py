"""Errors of the engine; raised on the driver, when a plan is built or run."""

from __future__ import annotations


class DomainError(Exception):
    """Base of the errors below."""


class ValidationError(DomainError):
    """An argument, option or row is not acceptable."""


class NotFoundError(DomainError):
    """What was asked for does not exist."""


class ConflictError(DomainError):
    """What was asked for contradicts what exists."""


class DependencyError(DomainError):
    """An optional library is missing."""


class QueryExecutionError(Exception):
    """A failure with the stage it happened in: embedding, retrieval, postprocess or generation."""

    def __init__(self, stage: str, message: str, cause: BaseException | None = None):
        super().__init__(f"[{stage}] {message}")
        self.stage, self.message, self.cause = stage, message, cause
