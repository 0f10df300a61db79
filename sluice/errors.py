"""Exceptions of the engine."""


class FlowError(Exception):
    """A flow that cannot be planned."""


class ExpressionError(FlowError):
    """An expression that cannot be read or compiled."""


class PackageError(FlowError):
    """A package file that cannot be read."""
