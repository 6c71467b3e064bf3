"""Errors of the engine, by what went wrong."""


class EngineError(Exception):
    """Base of all."""


class RuleError(EngineError):
    """A rule cannot be parsed, checked or applied."""


class ModelNotFound(EngineError):
    """No operator is registered under that name."""


class TableError(EngineError):
    """A table is missing, exists already, or cannot be written."""


class VersionConflict(TableError):
    """Another writer committed first."""


class FixpointError(RuleError):
    """Recursion did not settle within the allowed rounds."""


class CrossProductError(RuleError):
    """A product of relations without a shared key is larger than allowed."""
